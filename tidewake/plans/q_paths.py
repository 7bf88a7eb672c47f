"""Queries of T1-T26."""

from pyspark.sql import functions as F

from ..operators import neighbours as K
from ..operators import paths as T
from .base import cell_labels, cells, neighbours, orders_by_year, particles, query, table, weighted

G = ["method", "stage"]
PROB = "(SELECT p.method, p.stage, k.query_id, p.source_label AS source, c.celltype AS label, count(*) / 10.0 AS prob, any_value(p.weight) AS weight FROM knn k JOIN weights p ON p.id = k.query_id JOIN cells c ON c.id = k.ref_id GROUP BY ALL)"
MATRIX = f"(SELECT source, target, s / n AS value FROM (SELECT source, label AS target, sum(prob) AS s FROM {PROB} GROUP BY ALL) a JOIN (SELECT source AS src, count(DISTINCT query_id) AS n FROM {PROB} GROUP BY ALL) b ON src = source)"


def prob(s, d):
    p = K.label_probabilities(neighbours(s, d), cell_labels(s, d), "vote")
    w = weighted(s, d).select(F.col("id").alias("query_id"), *G, F.col("source_label").alias("source"), "weight")
    return p.join(w, "query_id")


@query(f"SELECT * FROM {MATRIX}", "source target", "value")
def transition_matrix(s, d):
    return T.transition_matrix(prob(s, d))


LABELS = [str(i) for i in range(10)]


@query("SELECT source, " + ", ".join(f"coalesce(max(value) FILTER (target = '{v}'), 0) AS t{v}" for v in LABELS) + f" FROM {MATRIX} GROUP BY ALL", "source", " ".join(f"t{v}" for v in LABELS))
def transition_matrix_wide(s, d):
    m = T.wide(T.transition_matrix(prob(s, d)), ["source"], "target", "value", LABELS)
    return m.select("source", *[F.col(v).alias(f"t{v}") for v in LABELS])


@query(
    f"""SELECT source, max(target) FILTER (r = 1) AS top, max(target) FILTER (r = 2) AS second, max(value) FILTER (r = 1) AS top_value, max(value) FILTER (r = 2) AS second_value,
 max(value) FILTER (r = 1) - coalesce(max(value) FILTER (r = 2), 0) AS margin FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY round(value, 12) DESC, target) AS r FROM {MATRIX}) GROUP BY ALL""",
    "source top second",
    "top_value second_value margin",
)
def top_two_targets(s, d):
    return T.top_two_targets(T.transition_matrix(prob(s, d)))


CLASS = "CASE WHEN CAST(source AS INT) = 9 THEN NULL WHEN CAST(source AS INT) = CAST(label AS INT) THEN 'compatible' WHEN (CAST(source AS INT) + 1) % 10 = CAST(label AS INT) THEN 'ambiguous' ELSE 'incompatible' END"


def _rules(s):
    r = s.range(9).select(F.col("id").cast("string").alias("source"), F.explode(F.array(F.struct(F.col("id").cast("string").alias("target"), F.lit("compatible").alias("class")), F.struct(((F.col("id") + 1) % 10).cast("string").alias("target"), F.lit("ambiguous").alias("class")))).alias("r"))
    return r.select("source", "r.*")


@query(
    "SELECT method, stage, source, " + ", ".join(f"CASE WHEN source <> '9' THEN sum(CASE WHEN c = '{c}' THEN prob * weight ELSE 0 END) / sum(prob * weight) END AS {n}" for c, n in (("compatible", "on_lineage"), ("ambiguous", "ambiguous"), ("incompatible", "off_lineage"))) + f" FROM (SELECT *, {CLASS} AS c FROM {PROB}) GROUP BY method, stage, source",
    "method stage source",
    "on_lineage ambiguous off_lineage",
)
def lineage_mass(s, d):
    return T.lineage_mass(prob(s, d).withColumnRenamed("label", "target"), _rules(s), G)


STATUS = "(SELECT y, o_orderstatus AS label, s / sum(s) OVER (PARTITION BY y) AS share FROM (SELECT y, o_orderstatus, sum(o_totalprice) AS s FROM orders_y GROUP BY ALL))"


@query(f"SELECT y, sum(CASE WHEN label IN ('F', 'P') THEN share ELSE 0 END) AS done, 1 - sum(CASE WHEN label IN ('F', 'P') THEN share ELSE 0 END) AS not_done FROM {STATUS} GROUP BY ALL", "y", "done not_done")
def named_set_fractions(s, d):
    from ..operators.composition import composition

    return T.named_set_fractions(composition(orders_by_year(s, d), ["y"], "o_orderstatus", "o_totalprice"), ["y"], {"done": ["F", "P"]})


RHO = "SELECT l_returnflag, count(*) AS n, corr(rx, ry) AS rho FROM (SELECT l_returnflag, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY l_returnflag ORDER BY l_discount) + (count(*) OVER (PARTITION BY l_returnflag, l_discount) - 1) / 2.0 AS ry FROM lineitem) GROUP BY ALL"


@query(RHO, "l_returnflag n", "rho")
def spearman_by_group(s, d):
    return T.spearman_by_group(table(s, d, "lineitem"), ["l_returnflag"], "l_quantity", "l_discount")


@query(None, "l_returnflag n", "rho p")
def spearman_p_by_group(s, d):
    return T.spearman_by_group(table(s, d, "lineitem"), ["l_returnflag"], "l_quantity", "l_discount")


@query(
    "SELECT y, label, n, n / sum(n) OVER (PARTITION BY y) AS fraction, 100 * n / sum(n) OVER (PARTITION BY y) AS percent FROM (SELECT f.y, f.label, count(o.y) AS n FROM (SELECT * FROM (SELECT DISTINCT y FROM orders_y), (SELECT DISTINCT o_orderstatus AS label FROM orders_y)) f LEFT JOIN orders_y o ON o.y = f.y AND o.o_orderstatus = f.label GROUP BY ALL)",
    "y label n",
    "fraction percent",
)
def cohort_composition_by_step(s, d):
    return T.cohort_composition_by_step(orders_by_year(s, d).withColumnRenamed("o_orderstatus", "label"), [], "y", "label")


NEAREST = "(SELECT p.method, p.stage, p.id, p.source_label AS source, c.celltype AS label, p.weight FROM weights p JOIN knn k ON k.query_id = p.id AND k.rank = 1 JOIN cells c ON c.id = k.ref_id)"


def nearest(s, d):
    near = K.transfer_labels(neighbours(s, d, 1), cell_labels(s, d), "hard").select(F.col("query_id").alias("id"), "label")
    return weighted(s, d).withColumnRenamed("source_label", "source").join(near, "id")


@query(f"SELECT method, stage, count(*) AS n, avg(ok) AS rate, sum(ok * weight) / sum(weight) AS weighted_rate FROM (SELECT *, CASE WHEN source <> '9' AND (label = source OR CAST(label AS INT) = (CAST(source AS INT) + 1) % 10) THEN 1.0 ELSE 0 END AS ok FROM {NEAREST}) GROUP BY ALL", "method stage n", "rate weighted_rate")
def route_correct_rate(s, d):
    return T.route_correct_rate(nearest(s, d), _rules(s).withColumnRenamed("target", "label"), G)


@query(
    """SELECT a.g, peak_step, peak_share, terminal_share, ever_share FROM (SELECT g, arg_min(y, (-v, y)) AS peak_step, max(v) AS peak_share, arg_max(v, y) AS terminal_share FROM (SELECT o_custkey % 7 AS g, y, avg(CASE WHEN o_orderstatus = 'P' THEN 1.0 ELSE 0 END) AS v FROM orders_y GROUP BY ALL) GROUP BY ALL) a
 JOIN (SELECT g, avg(e) AS ever_share FROM (SELECT o_custkey % 7 AS g, o_custkey, max(CASE WHEN o_orderstatus = 'P' THEN 1.0 ELSE 0 END) AS e FROM orders_y GROUP BY ALL) GROUP BY ALL) b ON a.g = b.g""",
    "g peak_step",
    "peak_share terminal_share ever_share",
)
def routing_over_time(s, d):
    return T.routing_over_time(orders_by_year(s, d).withColumn("g", F.expr("o_custkey % 7")), ["g"], "y", "o_custkey", "o_orderstatus", "P")


@query(
    f"SELECT method, stage, count(*) AS n, sum(CASE WHEN round(p, 12) >= 0.3 THEN 1 ELSE 0 END) AS hits, 100 * avg(CASE WHEN round(p, 12) >= 0.3 THEN 1 ELSE 0 END) AS percent, avg(p) AS mean FROM (SELECT method, stage, query_id, sum(CASE WHEN label IN ('1', '2', '3') THEN prob ELSE 0 END) AS p FROM {PROB} GROUP BY ALL) GROUP BY ALL",
    "method stage n hits",
    "percent mean",
)
def threshold_routing(s, d):
    return T.threshold_routing(prob(s, d), G, "query_id", ["1", "2", "3"], 0.3)


PAIRED = "(SELECT o_orderstatus AS g, o_custkey AS pid, o_orderpriority AS l0, lead(o_orderpriority) OVER w AS l1, o_totalprice / 1e3 AS w0, lead(o_totalprice) OVER w / 1e3 AS w1 FROM orders WINDOW w AS (PARTITION BY o_orderstatus, o_custkey ORDER BY o_orderdate, o_orderkey))"


def _paired(s, d):
    w = "OVER (PARTITION BY o_orderstatus, o_custkey ORDER BY o_orderdate, o_orderkey)"
    o = table(s, d, "orders").selectExpr("o_orderstatus AS g", "o_custkey AS pid", "o_orderpriority AS l0", f"lead(o_orderpriority) {w} AS l1", "o_totalprice / 1e3 AS w0", f"lead(o_totalprice) {w} / 1e3 AS w1")
    return o.filter("l1 is not null")


HIGH0, HIGH1 = "CAST(substr(l0, 1, 1) AS INT) / 5.0", "CAST(substr(l1, 1, 1) AS INT) / 5.0"


@query(
    f"SELECT *, change - transport - reweighting AS closure, abs(reweighting) / (abs(reweighting) + abs(transport)) AS local_share FROM (SELECT g, sum(w1 * p1 - w0 * p0) AS change, sum(0.5e0 * (w0 + w1) * (p1 - p0)) AS transport, sum(0.5e0 * (p0 + p1) * (w1 - w0)) AS reweighting FROM (SELECT *, {HIGH0} AS p0, {HIGH1} AS p1 FROM {PAIRED} WHERE l1 IS NOT NULL) GROUP BY ALL)",
    "g",
    "change transport reweighting closure local_share",
)
def soft_mass_decomposition(s, d):
    p = lambda c: (F.substring(c, 1, 1).cast("int") / 5.0)
    return T.soft_mass_decomposition(_paired(s, d).withColumn("p0", p("l0")).withColumn("p1", p("l1")), ["g"])


FALL = f"(SELECT g, sum(CASE WHEN a AND b THEN w1 - w0 ELSE 0 END) AS retained, sum(CASE WHEN NOT a AND b THEN w1 ELSE 0 END) AS incoming, sum(CASE WHEN a AND NOT b THEN w0 ELSE 0 END) AS outgoing FROM (SELECT *, l0 = '1-URGENT' AS a, l1 = '1-URGENT' AS b FROM {PAIRED} WHERE l1 IS NOT NULL) GROUP BY ALL)"


@query(f"SELECT *, retained + incoming - outgoing AS change FROM {FALL}", "g", "retained incoming outgoing change")
def hard_waterfall(s, d):
    return T.hard_waterfall(_paired(s, d), ["g"], "1-URGENT")


@query(f"SELECT g, l0, l1, count(*) AS n, sum(w0) AS initial, sum(w1) AS final, sum(0.5e0 * (w0 + w1)) AS midpoint FROM {PAIRED} WHERE l1 IS NOT NULL AND (l0 = '1-URGENT' OR l1 = '1-URGENT') GROUP BY ALL", "g l0 l1 n", "initial final midpoint")
def waterfall_routes(s, d):
    return T.waterfall_routes(_paired(s, d), ["g"], "1-URGENT")


@query(
    "SELECT y, " + ", ".join(f"100 * max(v) FILTER (m = {m}) AS m{m}_v, 100 * max(u) FILTER (m = {m}) AS m{m}_u" for m in (0, 1, 2)) + " FROM (SELECT y, o_custkey % 3 AS m, avg(o_totalprice) / 1e6 AS v, sum(o_totalprice) / 1e9 AS u FROM orders_y GROUP BY ALL) GROUP BY ALL",
    "y",
    "m0_v m0_u m1_v m1_u m2_v m2_u",
)
def interval_mass_table(s, d):
    o = orders_by_year(s, d).groupBy("y", F.expr("o_custkey % 3").alias("m")).agg((F.avg("o_totalprice") / 1e6).alias("v"), (F.sum("o_totalprice") / 1e9).alias("u"))
    return T.interval_mass_table(o, ["y"], "m", [0, 1, 2], ["v", "u"])


def _ends(column):
    return f"(SELECT c_mktsegment AS g, o_custkey AS pid, arg_min({column}, (o_orderdate, o_orderkey)) AS first, arg_max({column}, (o_orderdate, o_orderkey)) AS last FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL)"


@query(f"SELECT a.g, a.first, a.last, count(*) AS n, count(*) / any_value(t) AS share FROM {_ends('o_orderstatus')} a JOIN {_ends('CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus ELSE ' + chr(39) + 'O' + chr(39) + ' END')} b ON a.g = b.g AND a.pid = b.pid AND a.first = b.first AND a.last = b.last JOIN (SELECT g, count(DISTINCT pid) AS t FROM {_ends('o_orderstatus')} GROUP BY ALL) z ON z.g = a.g GROUP BY a.g, a.first, a.last", "g first last n", "share")
def consensus_paths(s, d):
    o = table(s, d, "orders").join(table(s, d, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    at = F.struct("o_orderdate", "o_orderkey")
    ends = lambda c: o.groupBy(F.col("c_mktsegment").alias("g"), F.col("o_custkey").alias("pid")).agg(F.min_by(c, at).alias("first"), F.max_by(c, at).alias("last"))
    return T.consensus_paths(ends(F.col("o_orderstatus")), ends(F.expr("CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus ELSE 'O' END")), ["g"], "pid")


CHANGES = "(SELECT feature, grp, first, last, change, coalesce(sign(change) = CASE WHEN grp % 2 = 0 THEN 1 ELSE -1 END AND change <> 0, false) AS agrees FROM (SELECT feature, grp, arg_min(value, t) AS first, arg_max(value, t) AS last, arg_max(value, t) - arg_min(value, t) AS change FROM curves GROUP BY ALL))"


def _changes(s, d):
    from .base import curves

    return T.first_last_change(curves(s, d).withColumn("expected", F.expr("CASE WHEN grp % 2 = 0 THEN 1 ELSE -1 END")), ["feature", "grp"], "t", "value", "expected")


@query(f"SELECT * FROM {CHANGES}", "feature grp agrees", "first last change")
def first_last_change(s, d):
    return _changes(s, d)


@query(f"SELECT 1 AS k, sum(n) AS n, sum(a) / sum(n) AS accuracy, count(*) FILTER (m >= 2) AS paired, avg(same) FILTER (m >= 2) AS same_sign, avg(every) FILTER (m >= 2) AS both_agree FROM (SELECT feature, count(DISTINCT grp) AS m, count(*) AS n, sum(CAST(agrees AS INT)) AS a, CAST(min(sign(change)) = max(sign(change)) AS INT) AS same, CAST(bool_and(agrees) AS INT) AS every FROM {CHANGES} WHERE grp < 2 GROUP BY ALL)", "k n paired", "accuracy same_sign both_agree")
def change_agreement(s, d):
    """Two user groups stand for the modalities of a feature."""
    return T.change_agreement(_changes(s, d).filter("grp < 2").withColumn("k", F.lit(1)), ["k", "feature"], "grp", ["k"])


FAR = "(SELECT p.method, p.stage, k.query_id, c.celltype AS label, count(*) / 5.0 AS prob FROM (SELECT * FROM knn WHERE rank > 5) k JOIN weights p ON p.id = k.query_id JOIN cells c ON c.id = k.ref_id GROUP BY ALL)"
NEAR5 = FAR.replace("rank > 5", "rank <= 5")


@query(
    f"""WITH d AS (SELECT coalesce(a.method, b.method) AS method, coalesce(a.stage, b.stage) AS stage, coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.label, b.label) AS label, coalesce(a.prob, 0) AS a, coalesce(b.prob, 0) AS b
 FROM {NEAR5} a FULL JOIN {FAR} b ON a.query_id = b.query_id AND a.label = b.label),
 k AS (SELECT *, a / nullif(sum(a) OVER w, 0) AS p, b / nullif(sum(b) OVER w, 0) AS q FROM d WHERE label <> '9' WINDOW w AS (PARTITION BY query_id)),
 c AS (SELECT method, stage, query_id, 1 - sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) WHEN p = 0 THEN 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) WHEN q = 0 THEN 0 END) / 2 AS c FROM k GROUP BY ALL),
 u AS (SELECT method, stage, query_id, sum(CASE WHEN label = '9' THEN a ELSE 0 END) AS ua, sum(CASE WHEN label = '9' THEN b ELSE 0 END) AS ub FROM d GROUP BY ALL)
 SELECT u.method, u.stage, avg(c) AS mean, quantile_cont(c, 0.5) AS median, avg(ua) AS unknown_a, avg(ub) AS unknown_b FROM u LEFT JOIN c ON c.query_id = u.query_id GROUP BY u.method, u.stage""",
    "method stage",
    "mean median unknown_a unknown_b",
)
def cross_modal_consistency(s, d):
    w = weighted(s, d).select(F.col("id").alias("query_id"), *G)
    near = neighbours(s, d)
    a = K.label_probabilities(near.filter("rank <= 5"), cell_labels(s, d)).join(w, "query_id")
    b = K.label_probabilities(near.filter("rank > 5"), cell_labels(s, d)).join(w, "query_id")
    return T.cross_modal_consistency(a, b, G, unknown="9")


@query(
    """WITH d AS (SELECT method, stage, x[1] * 10 AS la, x[2] * 10 AS lb, 1 / (1 + exp(-x[1] * 10)) AS a, 1 / (1 + exp(-x[2] * 10)) AS b, weight AS w FROM weights),
 e AS (SELECT *, rank() OVER (PARTITION BY method, stage ORDER BY la) + (count(*) OVER (PARTITION BY method, stage, la) - 1) / 2.0e0 AS ra, rank() OVER (PARTITION BY method, stage ORDER BY lb) + (count(*) OVER (PARTITION BY method, stage, lb) - 1) / 2.0e0 AS rb, -(m * log2(m) + (1 - m) * log2(1 - m)) + (a * log2(a) + (1 - a) * log2(1 - a)) / 2 + (b * log2(b) + (1 - b) * log2(1 - b)) / 2 AS j, CASE WHEN a >= 0.5 THEN 1.0 ELSE 0 END AS fa, CASE WHEN b >= 0.5 THEN 1.0 ELSE 0 END AS fb FROM (SELECT *, (a + b) / 2 AS m FROM d)),
 o AS (SELECT method, stage, (sum(w*la*lb)/sum(w) - sum(w*la)/sum(w)*sum(w*lb)/sum(w)) / sqrt((sum(w*la*la)/sum(w) - power(sum(w*la)/sum(w), 2)) * (sum(w*lb*lb)/sum(w) - power(sum(w*lb)/sum(w), 2))) AS pearson,
 (sum(w*ra*rb)/sum(w) - sum(w*ra)/sum(w)*sum(w*rb)/sum(w)) / sqrt((sum(w*ra*ra)/sum(w) - power(sum(w*ra)/sum(w), 2)) * (sum(w*rb*rb)/sum(w) - power(sum(w*rb)/sum(w), 2))) AS spearman,
 sum(w * j) / sum(w) AS jsd, sum(CASE WHEN fa = fb THEN w ELSE 0 END) / sum(w) AS agreement, sum(w * fa) / sum(w) AS ma, sum(w * fb) / sum(w) AS mb,
 sum(CASE WHEN sure AND fa <> fb THEN w ELSE 0 END) / sum(w) AS opposite_mass, sum(CASE WHEN sure THEN w ELSE 0 END) / sum(w) AS confident_mass FROM (SELECT *, (a >= 0.8 OR a <= 0.2) AND (b >= 0.8 OR b <= 0.2) AS sure FROM e) GROUP BY ALL)
 SELECT *, CASE WHEN confident_mass > 1e-12 THEN opposite_mass / confident_mass END AS confident_discordance, (agreement - chance) / (1 - chance) AS kappa FROM (SELECT *, ma * mb + (1 - ma) * (1 - mb) AS chance FROM o)""",
    "method stage",
    "pearson spearman jsd agreement chance kappa confident_mass opposite_mass confident_discordance",
)
def fate_concordance(s, d):
    w = weighted(s, d).withColumn("a", F.col("x")[0] * 10).withColumn("b", F.col("x")[1] * 10)
    return T.fate_concordance(w, G, "a", "b", "weight")


STEPS = "(SELECT vec_id // 4 AS pid, vec_id % 4 AS step, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings)"


@query(
    f"""WITH m AS (SELECT x, y, lead(x) OVER w - x AS u, lead(y) OVER w - y AS v FROM {STEPS} WINDOW w AS (PARTITION BY pid ORDER BY step)), k AS (SELECT * FROM m WHERE u IS NOT NULL),
 q AS (SELECT quantile_cont(x, 0.05) AS x0, quantile_cont(x, 0.95) AS x1, quantile_cont(y, 0.05) AS y0, quantile_cont(y, 0.95) AS y1 FROM k),
 c AS (SELECT least(floor((x - x0) / (x1 - x0) * 6), 5) AS bx, least(floor((y - y0) / (y1 - y0) * 6), 5) AS yb, count(*) AS n, avg(u) AS u, avg(v) AS v FROM k, q WHERE x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 GROUP BY ALL)
 SELECT i AS bx, j AS yb, coalesce(n, 0) AS n, coalesce(u, 0) AS u, coalesce(v, 0) AS v, sqrt(coalesce(u * u + v * v, 0)) AS speed FROM range(6) a(i) CROSS JOIN range(6) b(j) LEFT JOIN c ON c.bx = i AND c.yb = j""",
    "bx yb n",
    "u v speed",
)
def displacement_grid(s, d):
    p = table(s, d, "embeddings").selectExpr("vec_id div 4 AS pid", "vec_id % 4 AS step", "CAST(embedding[0] AS DOUBLE) AS x", "CAST(embedding[1] AS DOUBLE) AS y")
    return T.displacement_grid(p, "pid", "step", "x", "y", 6, (0.05, 0.95)).withColumnRenamed("by", "yb")


@query(
    "SELECT g, sum(n) AS n, sum(CASE WHEN n >= 5 THEN 1 ELSE 0 END) AS samples, sum(n) >= 20 AND sum(CASE WHEN n >= 5 THEN 1 ELSE 0 END) >= 2 AS valid FROM (SELECT o_orderpriority AS g, y AS sample, count(*) AS n FROM orders_y WHERE o_orderkey % 2 = 0 AND o_orderkey % 3 = 0 GROUP BY ALL) GROUP BY ALL",
    "g n samples valid",
)
def common_retained(s, d):
    o = orders_by_year(s, d).selectExpr("o_orderkey AS k", "o_orderpriority AS g", "y AS sample")
    return T.common_retained(o.filter("k % 2 = 0"), o.filter("k % 3 = 0"), ["k", "g"], ["g"], "sample", 20, 5)


@query(
    "SELECT g, CASE WHEN a >= 0.05 AND b >= 30 THEN 'both' WHEN a >= 0.05 THEN 'a only' WHEN b >= 30 THEN 'b only' ELSE 'neither' END AS category, count(*) AS n FROM (SELECT l_linestatus AS g, l_discount AS a, l_quantity AS b FROM lineitem) GROUP BY ALL",
    "g category n",
)
def coverage_categories(s, d):
    li = table(s, d, "lineitem").selectExpr("l_linestatus AS g", "CASE WHEN l_discount >= 0.05 THEN 1.0D ELSE 0D END AS a", "CASE WHEN l_quantity >= 30 THEN 1.0D ELSE 0D END AS b")
    return T.coverage_categories(li, ["g"], "a", "b", 0.5)


@query(
    "SELECT g, method, sum(CAST(hit AS INT)) AS hits, sum(CAST(hit AND c AS INT)) AS common, sum(CAST(hit AND NOT c AS INT)) AS extra FROM (SELECT *, bool_and(hit) OVER (PARTITION BY unit) AS c FROM (SELECT o_orderkey AS unit, o_orderpriority AS g, m AS method, (o_orderkey * (m + 1)) % 3 <> 0 AS hit FROM orders, range(3) r(m))) GROUP BY ALL",
    "g method hits common extra",
)
def common_and_extra_support(s, d):
    o = table(s, d, "orders").select(F.col("o_orderkey").alias("unit"), F.col("o_orderpriority").alias("g"), F.explode(F.array(*map(F.lit, range(3)))).alias("method")).withColumn("hit", F.expr("(unit * (method + 1)) % 3 <> 0"))
    return T.common_and_extra_support(o, ["unit"], ["g"], "method")


@query(None, "stage celltype k id substate")
def substates(s, d):
    return T.substates(cells(s, d), ["stage", "celltype"], [2, 3])


@query(None, "stage celltype k n least greatest", "least_fraction mean_ari least_ari")
def substate_audit(s, d):
    return T.substate_audit(cells(s, d), ["stage", "celltype"], [2, 3], 2, starts=5)


@query(None, "stage celltype k", "ari")
def rand_index(s, d):
    g = ["stage", "celltype"]
    return T.rand_index(T.substates(cells(s, d), g, [2], 0), T.substates(cells(s, d), g, [2], 1), [*g, "k"])


@query(
    """WITH r AS (SELECT o_orderpriority AS g, o_orderstatus AS substate, (o_orderkey % 11) / 10.0 AS hit FROM orders), q AS (SELECT o_orderpriority AS g, o_orderstatus AS substate, sum(CASE WHEN o_orderkey % 4 = 0 THEN o_totalprice ELSE 0 END) / sum(o_totalprice) AS precision FROM orders GROUP BY ALL),
 p AS (SELECT g, substate, n, soft, hard, precision, 2 * precision * hard / (precision + hard) AS f1 FROM (SELECT g, substate, count(*) AS n, avg(hit) AS soft, avg(CASE WHEN hit >= 0.5 THEN 1.0 ELSE 0 END) AS hard FROM r GROUP BY ALL) LEFT JOIN q USING (g, substate)),
 m AS (SELECT g, avg(soft) AS soft_recall, avg(hard) AS recall, avg(precision) AS precision, avg(f1) AS f1, arg_min(hard, (n, substate)) AS rarest_recall FROM p GROUP BY ALL),
 h AS (SELECT o_orderpriority AS g, o_orderstatus AS substate, count(*) AS n, sum(o_totalprice) AS v FROM orders GROUP BY ALL), h2 AS (SELECT g, substate, n / sum(n) OVER k AS a, v / sum(v) OVER k AS b FROM h WINDOW k AS (PARTITION BY g)),
 j AS (SELECT g, sum(a * log2(2 * a / (a + b)) + b * log2(2 * b / (a + b))) / 2 AS composition_jsd FROM h2 GROUP BY ALL)
 SELECT m.*, composition_jsd FROM m JOIN j ON j.g = m.g""",
    "g",
    "soft_recall recall rarest_recall precision f1 composition_jsd",
)
def substate_metrics(s, d):
    o = table(s, d, "orders")
    r = o.selectExpr("o_orderpriority AS g", "o_orderstatus AS substate", "(o_orderkey % 11) / 10.0D AS hit")
    p = o.selectExpr("o_orderpriority AS g", "o_orderstatus AS substate", "o_totalprice AS weight", "o_orderkey % 4 = 0 AS supported")
    return T.substate_metrics(r, p, ["g"])


@query(
    """SELECT * FROM (SELECT t, sub, program, mean_z, row_number() OVER (PARTITION BY t, sub ORDER BY round(mean_z, 9) DESC, program) AS rank FROM (SELECT t, sub, program, avg(z) AS mean_z FROM (SELECT t, sub, program, (v - avg(v) OVER w) / stddev_pop(v) OVER w AS z FROM
 (SELECT o_orderstatus AS t, o_orderpriority AS sub, o_custkey % 8 AS program, o_totalprice AS v FROM orders) WINDOW w AS (PARTITION BY t, program)) GROUP BY ALL)) WHERE rank <= 3""",
    "t sub program rank",
    "mean_z",
)
def top_programs_per_substate(s, d):
    o = table(s, d, "orders").selectExpr("o_orderstatus AS t", "o_orderpriority AS sub", "o_custkey % 8 AS program", "o_totalprice AS v")
    return T.top_programs_per_substate(o, ["t"], "sub", "program", "v", 3)


@query("SELECT y, f, o, 1 - f - o AS p FROM (SELECT y, avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0 END) AS f, avg(CASE WHEN o_orderstatus = 'O' THEN 1.0 ELSE 0 END) AS o FROM orders_y GROUP BY ALL)", "y", "f o p")
def flow_share_table(s, d):
    share = lambda v: F.avg((F.col("o_orderstatus") == v).cast("double"))
    return T.flow_share_table(orders_by_year(s, d).groupBy("y").agg(share("F").alias("f"), share("O").alias("o"), share("P").alias("p")), ["f", "o", "p"])


ENDS = "(SELECT vec_id // 4 AS pid, CAST(embedding AS DOUBLE[]) AS x FROM embeddings WHERE vec_id % 4 = 3)"
VOTED = f"(SELECT pid, avg(CAST(celltype = '1' AS INT)) >= 0.5 AS fate, greatest(avg(CAST(celltype = '1' AS INT)), 1 - avg(CAST(celltype = '1' AS INT))) AS confidence FROM (SELECT pid, celltype, row_number() OVER (PARTITION BY pid ORDER BY list_distance(e.x, c.x), c.id) AS r FROM {ENDS} e, cells c WHERE celltype IN ('1', '2')) WHERE r <= 7 GROUP BY pid)"


def _voted(s, d):
    """The fate of a path by the vote of seven neighbours of its last point among the cells of two types."""
    ends = table(s, d, "embeddings").filter("vec_id % 4 = 3").selectExpr("vec_id div 4 AS id", "CAST(embedding AS array<double>) AS x")
    two = cells(s, d).filter("celltype IN ('1', '2')")
    return T.fate_by_vote(K.knn_join(ends, two, 7), two.select(F.col("id").alias("ref_id"), F.col("celltype").alias("label")), "1")


@query(f"SELECT pid AS query_id, fate, confidence FROM {VOTED}", "query_id fate", "confidence")
def fate_by_vote(s, d):
    return _voted(s, d)


def _early(step):
    return f"(SELECT a.g, sum(a.w * b.w * CASE WHEN a.m > b.m THEN 1.0 WHEN a.m = b.m THEN 0.5 ELSE 0 END) / sum(a.w * b.w) AS auroc FROM s a JOIN s b ON a.g = b.g AND a.step = {step} AND b.step = {step} AND a.fate AND NOT b.fate GROUP BY ALL)"


@query(
    f"""WITH s AS (SELECT pid % 5 AS g, pid, step, x - y AS m, 1.0 + pid % 3 AS w, fate, confidence FROM {STEPS} JOIN {VOTED} USING (pid)), u AS (SELECT *, CASE WHEN fate THEN m ELSE -m END AS v FROM s), r AS (SELECT *, CASE WHEN lag(v) OVER k IS NOT NULL THEN CASE WHEN v >= lag(v) OVER k THEN 1.0 ELSE 0 END END AS up FROM u WINDOW k AS (PARTITION BY pid ORDER BY step)),
 p AS (SELECT g, pid, arg_max(v, step) AS l, arg_min(v, step) AS f, avg(up) AS r, max(w) AS w, bool_or(fate) AS fate, max(confidence) AS c FROM r GROUP BY ALL)
 SELECT p.g, sum(w * l) / sum(w) AS terminal_margin, sum(w * (l - f)) / sum(w) AS gain, sum(w * r) / sum(w) AS rising_steps, sum(CASE WHEN fate THEN w ELSE 0 END) / sum(w) AS fate_share, sum(w * c) / sum(w) AS confidence, any_value(i.auroc) AS initial_auroc, any_value(e.auroc) AS early_auroc FROM p LEFT JOIN {_early(0)} i ON i.g = p.g LEFT JOIN {_early(1)} e ON e.g = p.g GROUP BY p.g""",
    "g",
    "terminal_margin gain rising_steps fate_share confidence initial_auroc early_auroc",
)
def fate_margin_dynamics(s, d):
    p = table(s, d, "embeddings").selectExpr("(vec_id div 4) % 5 AS g", "vec_id div 4 AS pid", "vec_id % 4 AS step", "CAST(embedding[0] AS DOUBLE) AS x", "CAST(embedding[1] AS DOUBLE) AS y")
    fates = _voted(s, d).selectExpr("query_id % 5 AS g", "query_id AS pid", "fate", "confidence", "1.0D + query_id % 3 AS weight")
    return T.fate_margin_dynamics(p, fates, ["g"], "pid", "step", "x", "y")


@query(
    "SELECT g, count(*) AS n, sum(CASE WHEN a = b THEN w ELSE 0 END) / sum(w) AS agreement FROM (SELECT label AS g, 1.0 + vec_id % 3 AS w, embedding[1] > embedding[2] AS a, embedding[3] > embedding[4] AS b FROM embeddings) GROUP BY ALL",
    "g n",
    "agreement",
)
def fate_agreement(s, d):
    e = table(s, d, "embeddings").selectExpr("label AS g", "vec_id", "1.0D + vec_id % 3 AS w", "embedding[0] > embedding[1] AS a", "embedding[2] > embedding[3] AS b")
    return T.fate_agreement(e.withColumn("fate", F.col("a")), e.select("g", "vec_id", F.col("b").alias("fate")), ["g"], "vec_id", "fate", "w")


SETS = "(SELECT CASE WHEN CAST(v AS INT) % 2 = 0 THEN 'even' ELSE 'odd' END AS set, v AS label FROM (SELECT CAST(i AS VARCHAR) AS v FROM range(9) r(i)))"


@query(f"SELECT a.method, a.stage, s.set, sum(a.weight / 10) / any_value(t) AS fraction FROM (SELECT p.method, p.stage, c.celltype AS label, p.weight FROM knn k JOIN weights p ON p.id = k.query_id JOIN cells c ON c.id = k.ref_id) a JOIN {SETS} s ON s.label = a.label JOIN (SELECT p.method, p.stage, sum(p.weight / 10) AS t FROM knn k JOIN weights p ON p.id = k.query_id GROUP BY ALL) z ON z.method = a.method AND z.stage = a.stage GROUP BY a.method, a.stage, s.set", "method stage set", "fraction")
def leakage_fractions(s, d):
    w = weighted(s, d).select(F.col("id").alias("query_id"), *G, "weight")
    votes = neighbours(s, d).select("query_id", "ref_id").join(cell_labels(s, d), "ref_id").join(w, "query_id")
    sets = s.range(9).select(F.expr("CASE WHEN id % 2 = 0 THEN 'even' ELSE 'odd' END").alias("set"), F.col("id").cast("string").alias("label"))
    return T.leakage_fractions(votes, sets, G, 10)
