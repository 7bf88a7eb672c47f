"""Queries of W1-W6."""

from pyspark.sql import functions as F

from ..operators import mass as M
from .base import cells, particles, query, table, weighted

G = ["method", "stage"]


@query("SELECT id, method, stage, weight FROM weights", "id method stage", "weight")
def mass_weights(s, d):
    return M.mass_weights(particles(s, d), G)


SUMMARY = """SELECT method, stage, count(*) AS n, sum(exp(coalesce(log_mass, 0))) AS total_mass, 1 / sum(weight * weight) AS ess,
 1 / sum(weight * weight) / count(*) AS ess_fraction, max(weight) AS max_weight FROM weights GROUP BY ALL"""


@query(SUMMARY, "method stage n", "total_mass ess ess_fraction max_weight")
def mass_summary(s, d):
    return M.mass_summary(particles(s, d), G)


@query(f"SELECT method, stage, total_mass / first_value(total_mass) OVER (PARTITION BY method ORDER BY stage) AS relative_mass FROM ({SUMMARY})", "method stage", "relative_mass")
def relative_total_mass(s, d):
    return M.relative_total_mass(M.mass_summary(particles(s, d), G), ["method"], "stage")


def _quantile(q):
    return f"""SELECT l_returnflag, min(l_quantity) AS quantile FROM (SELECT *, sum(w) OVER (PARTITION BY l_returnflag ORDER BY l_quantity) AS upto,
 sum(w) OVER (PARTITION BY l_returnflag) AS total FROM (SELECT l_returnflag, l_quantity, sum(l_extendedprice) AS w FROM lineitem GROUP BY ALL)) WHERE upto >= {q} * total GROUP BY ALL"""


@query(_quantile(0.9), "l_returnflag", "quantile")
def weighted_quantile(s, d):
    return M.weighted_quantile(table(s, d, "lineitem"), ["l_returnflag"], "l_quantity", "l_extendedprice", 0.9)


@query(_quantile(0.5).replace("AS quantile", "AS median"), "l_returnflag", "median")
def weighted_median(s, d):
    return M.weighted_median(table(s, d, "lineitem"), ["l_returnflag"], "l_quantity", "l_extendedprice")


@query("SELECT l_linestatus, sum(l_quantity * l_extendedprice) / sum(l_extendedprice) AS mean FROM lineitem GROUP BY ALL", "l_linestatus", "mean")
def weighted_mean(s, d):
    return M.weighted_mean(table(s, d, "lineitem"), ["l_linestatus"], "l_quantity", "l_extendedprice")


def _corr(x, y, source):
    return f"""SELECT l_returnflag, count(*) AS n, (sum(w*{x}*{y})/sum(w) - sum(w*{x})/sum(w)*sum(w*{y})/sum(w)) / sqrt((sum(w*{x}*{x})/sum(w) - power(sum(w*{x})/sum(w), 2))
 * (sum(w*{y}*{y})/sum(w) - power(sum(w*{y})/sum(w), 2))) AS r FROM ({source}) GROUP BY ALL"""


ITEMS = "SELECT l_returnflag, CAST(l_quantity AS DOUBLE) AS a, CAST(l_discount AS DOUBLE) AS b, 1.0 + l_linenumber AS w FROM lineitem"


def _items(s, d):
    return table(s, d, "lineitem").selectExpr("l_returnflag", "CAST(l_quantity AS DOUBLE) AS a", "CAST(l_discount AS DOUBLE) AS b", "1.0D + l_linenumber AS w")


@query(_corr("a", "b", ITEMS), "l_returnflag n", "r")
def weighted_pearson(s, d):
    return M.weighted_pearson(_items(s, d), ["l_returnflag"], "a", "b", "w")


RANKED = f"SELECT l_returnflag, w, rank() OVER (PARTITION BY l_returnflag ORDER BY a) + (count(*) OVER (PARTITION BY l_returnflag, a) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY l_returnflag ORDER BY b) + (count(*) OVER (PARTITION BY l_returnflag, b) - 1) / 2.0 AS rb FROM ({ITEMS})"


@query(_corr("ra", "rb", RANKED).replace("AS r FROM", "AS rho FROM"), "l_returnflag n", "rho")
def weighted_spearman(s, d):
    return M.weighted_spearman(_items(s, d), ["l_returnflag"], "a", "b", "w")


def _cov(source, weight):
    return f"""SELECT p.stage, p.i, p.j, p.s / p.w - m1.m * m2.m AS cov FROM
 (SELECT stage, i, j, sum(w * x[i + 1] * x[j + 1]) AS s, sum(w) AS w FROM (SELECT stage, x[1:8] AS x, {weight} AS w FROM {source}), range(8) a(i), range(8) b(j) GROUP BY ALL) p
 JOIN (SELECT stage, i, sum(w * x[i + 1]) / sum(w) AS m FROM (SELECT stage, x[1:8] AS x, {weight} AS w FROM {source}), range(8) a(i) GROUP BY ALL) m1 ON m1.stage = p.stage AND m1.i = p.i
 JOIN (SELECT stage, i, sum(w * x[i + 1]) / sum(w) AS m FROM (SELECT stage, x[1:8] AS x, {weight} AS w FROM {source}), range(8) a(i) GROUP BY ALL) m2 ON m2.stage = p.stage AND m2.i = p.j"""


@query(
    f"SELECT o.stage, sum(o.cov * p.cov) / sqrt(sum(o.cov * o.cov) * sum(p.cov * p.cov)) AS cov_cosine, abs(ln(sum(p.cov) FILTER (o.i = o.j) / sum(o.cov) FILTER (o.i = o.j))) AS abs_log_trace_ratio"
    f" FROM ({_cov('cells', '1.0')}) o JOIN ({_cov('weights', 'weight')}) p ON o.stage = p.stage AND o.i = p.i AND o.j = p.j GROUP BY ALL",
    "stage",
    "cov_cosine abs_log_trace_ratio",
)
def weighted_covariance_metrics(s, d):
    first = F.slice("x", 1, 8).alias("x")
    o = M.weighted_covariance(cells(s, d).select("stage", first, F.lit(1.0).alias("weight")), ["stage"], "x", "weight")
    p = M.weighted_covariance(weighted(s, d).select("stage", first, "weight"), ["stage"], "x", "weight")
    return M.weighted_covariance_metrics(o, p, ["stage"])
