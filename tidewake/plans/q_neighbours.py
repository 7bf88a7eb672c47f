"""Queries of K1-K14."""

from pyspark.sql import functions as F

from ..operators import neighbours as K
from .base import cell_labels, cells, neighbours, particles, query, self_neighbours, table, weighted

KNN = "query_id ref_id rank"


@query("SELECT query_id, ref_id, rank, distance FROM knn", KNN, "distance")
def knn_join(s, d):
    return neighbours(s, d)


@query("SELECT query_id AS id, max(distance) AS radius FROM self_knn WHERE rank <= 5 GROUP BY ALL", "id", "radius")
def self_knn_radius(s, d):
    return K.self_knn_radius(cells(s, d), 5, ["stage"])


@query("SELECT stage, quantile_cont(distance, 0.5) AS loo_median FROM self_knn WHERE rank = 1 GROUP BY ALL", "stage", "loo_median")
def loo_1nn_median(s, d):
    return K.loo_1nn_median(cells(s, d), ["stage"])


@query("SELECT query_id, ref_id, rank, distance FROM self_knn", KNN, "distance")
def knn_join_excluding(s, d):
    return self_neighbours(s, d)


RADII = "(SELECT stage, query_id AS id, max(distance) AS radius FROM self_knn WHERE rank <= 5 GROUP BY ALL)"
HITS = f"SELECT r.stage, r.id, coalesce(sum(w.weight / 3), 0) AS mass FROM {RADII} r LEFT JOIN pairs p ON p.ref_id = r.id AND p.distance * p.distance <= r.radius * r.radius + 1e-7 LEFT JOIN weights w ON w.id = p.query_id GROUP BY ALL"


def hit_mass(s, d):
    radii = K.self_knn_radius(cells(s, d), 5, ["stage"])
    return K.radius_mass(cells(s, d).join(radii, ["stage", "id"]), weighted(s, d).withColumn("weight", F.col("weight") / 3), ["stage"])


@query(HITS, "stage id", "mass")
def radius_mass(s, d):
    return hit_mass(s, d)


@query(
    """SELECT q.method, q.stage, median AS distance_median, median / loo_median AS projection_ratio FROM (SELECT method, stage, min(distance) AS median FROM
 (SELECT w.method, w.stage, k.distance, sum(w.weight) OVER (PARTITION BY w.method, w.stage ORDER BY k.distance) AS upto FROM knn k JOIN weights w ON w.id = k.query_id WHERE k.rank = 1) WHERE upto >= 0.5 - 1e-12 GROUP BY ALL) q
 JOIN (SELECT stage, quantile_cont(distance, 0.5) AS loo_median FROM self_knn WHERE rank = 1 GROUP BY ALL) l ON l.stage = q.stage""",
    "method stage",
    "distance_median projection_ratio",
)
def projection_ratio(s, d):
    w = weighted(s, d).select(F.col("id").alias("query_id"), "method", "stage", "weight")
    return K.projection_ratio(neighbours(s, d, 1), w, K.loo_1nn_median(cells(s, d), ["stage"]), ["method", "stage"], ["stage"])


def _transfer(weight, k=10):
    return f"""SELECT query_id, label, prob FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(prob, 12) DESC, label) AS r FROM
 (SELECT query_id, label, sum(w) AS prob FROM (SELECT query_id, c.celltype AS label, g / sum(g) OVER (PARTITION BY query_id) AS w FROM
 (SELECT *, {weight} AS g FROM knn WHERE rank <= {k}) n JOIN cells c ON c.id = n.ref_id) GROUP BY ALL)) WHERE r = 1"""


def _labels(scheme, k=10):
    return lambda s, d: K.transfer_labels(neighbours(s, d, k), cell_labels(s, d), scheme)


for _name, _weight in (
    ("hard", "CASE WHEN rank = 1 THEN 1.0 ELSE 0 END"),
    ("vote", "1.0"),
    ("inverse", "1 / distance"),
    ("inverse_floor", "1 / greatest(distance, (SELECT quantile_cont(distance, 0.5) * 1e-3 FROM knn WHERE distance > 0))"),
    ("gaussian_own", "exp(-power(distance / max(distance) OVER (PARTITION BY query_id), 2))"),
    ("gaussian_global", "exp(-power(distance / (SELECT quantile_cont(m, 0.5) FROM (SELECT max(distance) AS m FROM knn GROUP BY query_id)), 2))"),
):
    _f = _labels(_name)
    _f.__name__ = f"transfer_labels_{_name}"
    query(_transfer(_weight), "query_id label", "prob")(_f)


@query(f"SELECT query_id, CASE WHEN prob > 0.5 THEN label ELSE 'unassigned' END AS label, prob FROM ({_transfer('1.0', 5)})", "query_id label", "prob")
def transfer_labels_majority(s, d):
    return K.transfer_labels(neighbours(s, d, 5), cell_labels(s, d), "majority")


@query("SELECT method, stage, ref_id, mass FROM ref_mass", "method stage ref_id", "mass")
def soft_mass_transfer(s, d):
    w = weighted(s, d).select(F.col("id").alias("query_id"), "method", "stage", "weight")
    return K.soft_mass_transfer(neighbours(s, d), w, ["method", "stage"])


FEATURES = "(SELECT id AS ref_id, i AS feature, x[i + 1] AS value FROM cells, range(64) r(i))"


def _features(s, d):
    return cells(s, d).select(F.col("id").alias("ref_id"), F.posexplode("x").alias("feature", "value")).withColumn("feature", F.col("feature").cast("long"))


@query(f"SELECT query_id, feature, sum(w * value) AS value FROM soft JOIN {FEATURES} f USING (ref_id) GROUP BY ALL", "query_id feature", "value")
def knn_readout(s, d):
    return K.knn_readout(neighbours(s, d), _features(s, d), "gaussian_own")


@query(f"SELECT method, stage, feature, 100 * sum(mass * value) AS value FROM ref_mass JOIN {FEATURES} f USING (ref_id) GROUP BY ALL", "method stage feature", "value")
def group_curves(s, d):
    m = weighted(s, d).select(F.col("id").alias("query_id"), "method", "stage", "weight")
    return K.group_curves(m, neighbours(s, d), _features(s, d), ["method", "stage"], "gaussian_own", 100.0)


@query("SELECT k.query_id AS id, quantile_cont(c.x[1], 0.5) AS smoothed FROM self_knn k JOIN cells c ON c.id = k.ref_id WHERE k.rank <= 5 GROUP BY ALL", "id", "smoothed")
def knn_smooth(s, d):
    return K.knn_smooth(cells(s, d).withColumn("v", F.col("x")[0]), "v", 5, ["stage"])


def _suppliers(s, d):
    return table(s, d, "customer").selectExpr("c_custkey AS id", "c_mktsegment AS seg", "CAST(c_acctbal AS DOUBLE) AS bal", "CAST(c_nationkey AS DOUBLE) AS nat", "c_custkey % 4 = 0 AS treated")


ZED = """z AS (SELECT c_custkey AS id, c_mktsegment AS seg, c_custkey % 4 = 0 AS treated, [(c_acctbal - avg(c_acctbal) OVER w) / stddev_pop(c_acctbal) OVER w,
 (c_nationkey - avg(c_nationkey) OVER w) / stddev_pop(c_nationkey) OVER w] AS v FROM customer WINDOW w AS (PARTITION BY c_mktsegment))"""


@query(
    f"SELECT * FROM (WITH {ZED} SELECT a.seg, a.id AS query_id, arg_min(b.id, (list_distance(a.v, b.v), b.id)) AS ref_id, min(list_distance(a.v, b.v)) AS distance FROM z a JOIN z b ON a.seg = b.seg WHERE a.treated AND NOT b.treated GROUP BY a.seg, a.id)",
    "seg query_id ref_id",
    "distance",
)
def match_controls(s, d):
    return K.match_controls(_suppliers(s, d), "treated", ["bal", "nat"], ["seg"])


@query(
    f"""SELECT * FROM (WITH {ZED}, m AS (SELECT a.seg, a.id AS query_id, arg_min(b.id, (list_distance(a.v, b.v), b.id)) AS ref_id, min(list_distance(a.v, b.v)) AS distance FROM z a JOIN z b ON a.seg = b.seg WHERE a.treated AND NOT b.treated GROUP BY a.seg, a.id),
 c AS (SELECT c_custkey AS id, c_mktsegment AS seg, c_custkey % 4 = 0 AS treated, 'bal' AS covariate, CAST(c_acctbal AS DOUBLE) AS v FROM customer UNION ALL SELECT c_custkey, c_mktsegment, c_custkey % 4 = 0, 'nat', CAST(c_nationkey AS DOUBLE) FROM customer),
 b AS (SELECT seg, covariate, count(*) FILTER (treated) AS n_treated, count(*) FILTER (NOT treated) AS n_controls, avg(v) FILTER (treated) AS mt, avg(v) FILTER (NOT treated) AS mc, var_pop(v) FILTER (treated) AS vt, var_pop(v) FILTER (NOT treated) AS vc FROM c GROUP BY ALL),
 a AS (SELECT m.seg, covariate, avg(v) AS mm, var_pop(v) AS vm FROM m JOIN c ON c.id = ref_id GROUP BY ALL), d AS (SELECT seg, count(DISTINCT ref_id) AS n_matched, quantile_cont(distance, 0.5) AS median_distance, max(distance) AS greatest_distance FROM m GROUP BY ALL)
 SELECT b.seg, b.covariate, n_treated, n_controls, n_matched, (mt - mc) / sqrt((vt + vc) / 2) AS smd_before, (mt - mm) / sqrt((vt + vm) / 2) AS smd_after, median_distance, greatest_distance FROM b JOIN a ON a.seg = b.seg AND a.covariate = b.covariate JOIN d ON d.seg = b.seg)""",
    "seg covariate n_treated n_controls n_matched",
    "smd_before smd_after median_distance greatest_distance",
)
def match_balance(s, d):
    df = _suppliers(s, d)
    return K.balance(df, K.match_controls(df, "treated", ["bal", "nat"], ["seg"]), "treated", ["bal", "nat"], ["seg"])


@query(None, "seg query_id ref_id")
def match_negatives(s, d):
    df = _suppliers(s, d).withColumn("bal", F.abs("bal"))
    return K.match_negatives(df.filter("id % 20 = 0"), df.filter("id % 20 <> 0"), ["bal", "nat"], 2, ["seg"])


@query(None, "stage centre ref_id")
def low_overlap_aggregates(s, d):
    return K.low_overlap_aggregates(cells(s, d), 8, 0.5, 20, on=["stage"])


def _aggregates(s, d):
    return K.low_overlap_aggregates(cells(s, d), 8, 0.5, 20, on=["stage"])


@query(None, "stage centre feature", "value")
def aggregate_profiles(s, d):
    return K.aggregate_profiles(_aggregates(s, d), _features(s, d), ["stage"])


@query(None, "stage centre n dominant n_labels", "fraction")
def aggregate_labels(s, d):
    return K.aggregate_labels(_aggregates(s, d), cell_labels(s, d), ["stage"])


TIMES = "(SELECT method, query_id, weight, time, CASE WHEN time >= 3 THEN 3 ELSE CAST(floor(time) AS INT) END AS low, time - floor(time) AS alpha, x FROM (SELECT method, id AS query_id, exp(coalesce(log_mass, 0)) AS weight, id % 13 / 4.0e0 AS time, x FROM particles))"
BETWEEN = f"""(WITH m AS (SELECT method, query_id, weight, time, x, low AS stage, 1 - alpha AS part FROM {TIMES} WHERE alpha < 1 UNION ALL SELECT method, query_id, weight, time, x, low + 1, alpha FROM {TIMES} WHERE alpha > 0),
 k AS (SELECT * FROM (SELECT m.*, c.id AS ref_id, list_distance(m.x, c.x) AS distance, row_number() OVER (PARTITION BY query_id, m.stage ORDER BY list_distance(m.x, c.x), c.id) AS rank FROM m JOIN cells c ON c.stage = m.stage) WHERE rank <= 5),
 h AS (SELECT time, stage, quantile_cont(far, 0.5) AS h FROM (SELECT time, stage, query_id, max(distance) AS far FROM k GROUP BY ALL) GROUP BY ALL),
 w AS (SELECT k.*, exp(-power(distance / h, 2)) AS g FROM k JOIN h ON h.time = k.time AND h.stage = k.stage), t AS (SELECT method, time, stage, sum(weight) AS total FROM m GROUP BY ALL)
 SELECT w.method, w.time, ref_id, sum(g / sg * weight / total * part) AS c FROM (SELECT *, sum(g) OVER (PARTITION BY query_id, stage) AS sg FROM w) w JOIN t ON t.method = w.method AND t.time = w.time AND t.stage = w.stage GROUP BY ALL)"""


def _between(s, d):
    p = particles(s, d).select("method", "id", F.exp(F.coalesce("log_mass", F.lit(0.0))).alias("weight"), F.expr("id % 13 / 4.0D").alias("time"), "x")
    m = K.bracket_shares(K.stage_bracket(p, "time", [0.0, 1.0, 2.0, 3.0]))
    near = K.knn_join(m, cells(s, d), 5, ["stage"]).join(p.select(F.col("id").alias("query_id"), "time"), "query_id")
    return m.select("method", "time", F.col("id").alias("query_id"), "weight", "stage", "part"), near


@query(f"SELECT method, time, feature, 100 * sum(c * value) AS value FROM {BETWEEN} JOIN {FEATURES} f USING (ref_id) GROUP BY ALL", "method time feature", "value")
def decoded_curves(s, d):
    """All 64 coordinates as features, at times between the stages."""
    return K.decoded_curves(*_between(s, d), _features(s, d), ["method"], "time")


@query(f"SELECT method, time, feature, 1e4 * any_value(s) / any_value(depth) AS value FROM (SELECT method, time, feature, sum(c * abs(value)) AS s FROM {BETWEEN} JOIN {FEATURES} f USING (ref_id) GROUP BY ALL) JOIN (SELECT method AS m, time AS t, sum(c * (1 + ref_id % 7)) AS depth FROM {BETWEEN} GROUP BY ALL) ON m = method AND t = time GROUP BY ALL", "method time feature", "value")
def decoded_curves_by_depth(s, d):
    depth = cells(s, d).select(F.col("id").alias("ref_id"), F.expr("1.0D + id % 7").alias("depth"))
    return K.decoded_curves(*_between(s, d), _features(s, d).withColumn("value", F.abs("value")), ["method"], "time", scale=1e4, depth=depth)


@query(None, "query_id other")
def repaired(s, d):
    return K.repaired(particles(s, d).withColumnRenamed("id", "query_id"), ["source_label"], 3)


@query(
    """SELECT id, list_sum(list_transform(joint, lambda v: v * v)) AS norm2, joint[1] AS first FROM (SELECT id, list(z ORDER BY i) AS joint FROM
 (SELECT id, i, (x[i + 1] - avg(x[i + 1]) OVER (PARTITION BY i)) / stddev_pop(x[i + 1]) OVER (PARTITION BY i) / CASE WHEN i < 4 THEN 2.0 ELSE 3.0 END AS z FROM cells, range(13) r(i)) GROUP BY id)""",
    "id",
    "norm2 first",
)
def joint_embedding(s, d):
    c = cells(s, d).select("id", F.slice("x", 1, 4).alias("a"), F.slice("x", 5, 9).alias("b"))
    j = K.joint_embedding(c, "a", "b")
    return j.select("id", F.aggregate("joint", F.lit(0.0), lambda t, v: t + v * v).alias("norm2"), F.col("joint")[0].alias("first"))
