"""Queries of D1-D18; composition_jsd is the flagship."""

from pyspark.sql import functions as F

from ..operators import composition as D
from ..operators import mass as M
from ..operators import neighbours as K
from .base import cell_labels, cells, neighbours, orders_by_year, particles, query, scores, table, weighted
from .q_neighbours import HITS, hit_mass

G = ["method", "stage"]
PRED = "(SELECT method, stage, label, share / sum(share) OVER (PARTITION BY method, stage) AS share FROM (SELECT w.method, w.stage, c.celltype AS label, sum(w.weight) AS share FROM weights w JOIN knn k ON k.query_id = w.id AND k.rank = 1 JOIN cells c ON c.id = k.ref_id GROUP BY ALL))"
OBS = "(SELECT stage, label, n / sum(n) OVER (PARTITION BY stage) AS share FROM (SELECT stage, celltype AS label, count(*) AS n FROM cells GROUP BY ALL))"
COMPARED = f"""(SELECT f.method, f.stage, f.label, coalesce(p.share, 0) AS predicted, coalesce(o.share, 0) AS observed FROM
 (SELECT * FROM (SELECT DISTINCT method, stage FROM weights), (SELECT label FROM {PRED} UNION SELECT label FROM {OBS})) f
 LEFT JOIN {PRED} p ON p.method = f.method AND p.stage = f.stage AND p.label = f.label LEFT JOIN {OBS} o ON o.stage = f.stage AND o.label = f.label)"""
JSD = f"""SELECT method, stage, jsd, 1 - jsd AS similarity, 1 - sqrt(jsd) AS root_similarity FROM (SELECT method, stage, greatest(sum(CASE WHEN predicted > 0 THEN predicted * log2(predicted / m) ELSE 0 END
 + CASE WHEN observed > 0 THEN observed * log2(observed / m) ELSE 0 END) / 2, 0) AS jsd FROM (SELECT *, (predicted + observed) / 2 AS m FROM {COMPARED}) GROUP BY ALL)"""


def predicted(s, d):
    near = K.transfer_labels(neighbours(s, d, 1), cell_labels(s, d), "hard").select(F.col("query_id").alias("id"), "label")
    return D.composition(weighted(s, d).join(near, "id"), G, "label", "weight")


def observed(s, d):
    return D.composition(cells(s, d), ["stage"], "celltype")


def compared(s, d):
    return D.compare_composition(predicted(s, d), observed(s, d), G, ["stage"])


@query(f"SELECT * FROM {PRED}", "method stage label", "share")
def composition(s, d):
    return predicted(s, d)


@query(f"SELECT *, predicted - observed AS difference, abs(predicted - observed) AS absolute, 100 * (predicted - observed) AS delta_pp FROM {COMPARED}", "method stage label", "predicted observed difference absolute delta_pp")
def compare_composition(s, d):
    return compared(s, d)


@query(f"SELECT c.method, sum(n * abs(100 * (predicted - observed))) / sum(n) AS mae_pp FROM {COMPARED} c JOIN (SELECT stage, count(*) AS n FROM cells GROUP BY ALL) k ON k.stage = c.stage GROUP BY ALL", "method", "mae_pp")
def composition_mae(s, d):
    n = cells(s, d).groupBy("stage").agg(F.count(F.lit(1)).alias("n"))
    return D.composition_mae(compared(s, d).join(n, "stage"), ["method"], "n")


@query(JSD, "method stage", "jsd similarity root_similarity")
def composition_jsd(s, d):
    """Cells, weights, nearest neighbours, labels, composition, divergence: the held-out stage score."""
    return D.jsd(compared(s, d), G)


@query(
    "SELECT m.method, m.stage, power(sum(mass), 2) / sum(mass * mass) AS effective, power(sum(mass), 2) / sum(mass * mass) / any_value(n) AS coverage, max(mass) AS max_mass FROM ref_mass m JOIN (SELECT stage, count(*) AS n FROM cells GROUP BY ALL) k ON k.stage = m.stage GROUP BY ALL",
    "method stage",
    "effective coverage max_mass",
)
def effective_coverage(s, d):
    w = weighted(s, d).select(F.col("id").alias("query_id"), *G, "weight")
    n = cells(s, d).groupBy("stage").agg(F.count(F.lit(1)).alias("n_ref"))
    return D.effective_coverage(K.soft_mass_transfer(neighbours(s, d), w, G), G, n, ["stage"])


@query(
    "SELECT y, lineage, share / sum(share) OVER (PARTITION BY y) AS share FROM (SELECT y, CASE WHEN substr(o_orderpriority, 1, 1) IN ('1', '2') THEN 'high' ELSE 'low' END AS lineage, sum(o_totalprice) AS share FROM orders_y WHERE substr(o_orderpriority, 1, 1) <> '4' GROUP BY ALL)",
    "y lineage",
    "share",
)
def regroup_composition(s, d):
    comp = D.composition(orders_by_year(s, d), ["y"], "o_orderpriority", "o_totalprice")
    groups = comp.select("label").distinct().filter("label not like '4%'").withColumn("lineage", F.when(F.substring("label", 1, 1).isin("1", "2"), "high").otherwise("low"))
    return D.regroup_composition(comp, groups, ["y"])


@query("SELECT y, label, n, 100.0 * n / sum(n) OVER (PARTITION BY y) AS percent FROM (SELECT y, CASE WHEN o_orderstatus IN ('F', 'O') THEN o_orderstatus ELSE 'Other' END AS label, count(*) AS n FROM orders_y GROUP BY ALL)", "y label n", "percent")
def within_lineage_percent(s, d):
    return D.within_lineage_percent(orders_by_year(s, d), ["y"], "o_orderstatus", ["F", "O"])


@query(None, "method stage cluster", "weight")
def microclusters(s, d):
    return D.microclusters(weighted(s, d), G, 8)


def _w2(s, d, k=64):
    p = D.microclusters(weighted(s, d), G, k)
    o = D.microclusters(cells(s, d).withColumn("weight", F.lit(1.0)), ["stage"], k).join(p.select(*G).distinct(), "stage")
    return D.sinkhorn_divergence(p, o, G)


@query(None, "method stage", "divergence w2")
def sinkhorn_divergence(s, d):
    return _w2(s, d)


@query(None, "stage next_stage", "w2")
def adjacent_time_distance(s, d):
    return D.adjacent_time_distance(cells(s, d), "stage", 64)


@query(None, "", "total ends")
def total_time_distance(s, d):
    return D.total_time_distance(D.adjacent_time_distance(cells(s, d), "stage", 64))


@query(None, "stage", "mean sd median q025 q975")
def repeated_distance(s, d):
    return D.repeated_distance(cells(s, d), particles(s, d), ["stage"], 32, 5)


AXES = "(SELECT i AS direction, i AS axis FROM range(64) r(i))"


def _projected(source, weight, keys):
    return f"SELECT {keys}, direction, v, round(sum(w) OVER (PARTITION BY {keys}, direction ORDER BY v) / sum(w) OVER (PARTITION BY {keys}, direction), 12) AS q FROM (SELECT {keys}, direction, x[axis + 1] AS v, sum({weight}) AS w FROM {source}, {AXES} GROUP BY ALL)"


@query(
    f"""WITH p AS ({_projected('weights', 'weight', 'method, stage')}), o AS (SELECT m.method, z.* FROM ({_projected('cells', '1.0', 'stage')}) z JOIN (SELECT DISTINCT method, stage FROM particles) m ON m.stage = z.stage),
 q AS (SELECT method, stage, direction, q FROM p UNION SELECT method, stage, direction, q FROM o),
 s AS (SELECT q.*, q.q - coalesce(lag(q.q) OVER (PARTITION BY method, stage, direction ORDER BY q.q), 0) AS m,
 (SELECT min(v) FROM p WHERE p.method = q.method AND p.stage = q.stage AND p.direction = q.direction AND p.q >= q.q) AS a,
 (SELECT min(v) FROM o WHERE o.method = q.method AND o.stage = q.stage AND o.direction = q.direction AND o.q >= q.q) AS b FROM q)
 SELECT method, stage, sqrt(avg(t)) AS w2 FROM (SELECT method, stage, direction, sum(m * (a - b) * (a - b)) AS t FROM s GROUP BY ALL) GROUP BY ALL""",
    "method stage",
    "w2",
)
def sliced_w2(s, d):
    """All axes as directions, so that SQL can follow."""
    u = s.range(64).select(F.col("id").cast("int").alias("direction"), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: (i == F.col("id")).cast("double")).alias("u"))
    t = cells(s, d).withColumn("weight", F.lit(1.0)).join(particles(s, d).select(*G).distinct(), "stage")
    return D.sliced_w2(weighted(s, d), t, u, G)


@query(None, "method stage", "w2")
def sliced_w2_random(s, d):
    t = cells(s, d).withColumn("weight", F.lit(1.0)).join(particles(s, d).select(*G).distinct(), "stage")
    return D.sliced_w2(weighted(s, d), t, D.directions(s, 64, 64), G)


@query(None, "stage", "mean sd median q025 q975")
def sampling_floor(s, d):
    return D.sampling_floor(cells(s, d), ["stage"], 5, k=32)


RECALL = f"SELECT h.stage, avg(p) AS recall, avg(CASE WHEN mass > 0 THEN 1.0 ELSE 0 END) AS hard_recall, avg(CASE WHEN p >= 0.5 THEN 1.0 ELSE 0 END) AS share_above FROM (SELECT stage, mass, 1 - power(1 - least(mass, 1), ess) AS p FROM ({HITS}) JOIN (SELECT stage AS st, 1 / sum(weight * weight / 9) AS ess FROM weights GROUP BY ALL) ON st = stage) h GROUP BY ALL"


def _recall(s, d):
    ess = weighted(s, d).groupBy("stage").agg((1 / F.sum((F.col("weight") / 3) ** 2)).alias("ess"))
    return D.support_recall(hit_mass(s, d), ess, ["stage"], ["stage"])


@query(RECALL, "stage", "recall hard_recall share_above")
def support_recall(s, d):
    return _recall(s, d)


CENTROIDS = """(SELECT p.stage, source, target, sqrt(sum(power(p.v - c.v, 2))) AS v FROM (SELECT stage, source_label AS source, i, avg(x[i + 1]) AS v FROM particles, range(64) r(i) GROUP BY ALL) p
 JOIN (SELECT stage, celltype AS target, i, avg(x[i + 1]) AS v FROM cells, range(64) r(i) GROUP BY ALL) c ON c.stage = p.stage AND c.i = p.i GROUP BY p.stage, source, target)"""


@query(
    f"SELECT stage, source, matched, wrong, wrong - matched AS margin, matched / wrong AS ratio, best = source AS top1 FROM (SELECT stage, source, avg(v) FILTER (source = target) AS matched, avg(v) FILTER (source <> target) AS wrong, arg_min(target, (v, target)) AS best FROM {CENTROIDS} GROUP BY ALL)",
    "stage source top1",
    "matched wrong margin ratio",
)
def line_matching(s, d):
    """Distances of the mean vectors of source labels and cell types."""
    p = particles(s, d).select("stage", F.col("source_label").alias("source"), F.posexplode("x").alias("i", "v")).groupBy("stage", "source", "i").agg(F.avg("v").alias("v"))
    c = cells(s, d).select("stage", F.col("celltype").alias("target"), F.posexplode("x").alias("i", "c")).groupBy("stage", "target", "i").agg(F.avg("c").alias("c"))
    v = p.join(c, ["stage", "i"]).groupBy("stage", "source", "target").agg(F.sqrt(F.sum((F.col("v") - F.col("c")) ** 2)).alias("v"))
    return D.line_matching(v, ["stage"], "source", "target", "v")


@query("SELECT method, stage, setting, avg(score) AS mean, quantile_cont(score, 0.5) AS median, stddev(score) AS sd, count(score) AS n FROM scores GROUP BY GROUPING SETS ((method), (method, stage), (setting))", "method stage setting n", "mean median sd")
def summary_by_axes(s, d):
    return D.summary_by_axes(scores(s, d), [["method"], ["method", "stage"], ["setting"]], "score")


@query(
    "SELECT 0 AS method, avg(e) AS energy, count(*) AS n FROM (SELECT pid, sum(0.5 * power(list_distance(x, px), 2) / dt) AS e FROM (SELECT pid, x, lag(x) OVER w AS px, step - lag(step) OVER w AS dt FROM (SELECT vec_id // 4 AS pid, vec_id % 4 AS step, CAST(embedding AS DOUBLE[]) AS x FROM embeddings) WINDOW w AS (PARTITION BY pid ORDER BY step)) WHERE dt > 0 GROUP BY ALL)",
    "method n",
    "energy",
)
def path_energy(s, d):
    p = table(s, d, "embeddings").selectExpr("0 AS method", "vec_id div 4 AS pid", "vec_id % 4 AS step", "CAST(embedding AS array<double>) AS x")
    return D.path_energy(p, ["method"], "pid", "step")


@query(
    "SELECT a.method, a.stage, coordinate_sd, mass_factor FROM (SELECT method, stage, avg(sqrt(greatest(q / w - power(s / w, 2), 0))) AS coordinate_sd FROM (SELECT method, stage, i, sum(weight) AS w, sum(weight * x[i + 1]) AS s, sum(weight * x[i + 1] * x[i + 1]) AS q FROM weights, range(64) r(i) GROUP BY ALL) GROUP BY ALL) a JOIN (SELECT method, stage, avg(exp(coalesce(log_mass, 0))) AS mass_factor FROM particles GROUP BY ALL) b ON a.method = b.method AND a.stage = b.stage",
    "method stage",
    "coordinate_sd mass_factor",
)
def spread_metrics(s, d):
    return D.spread_metrics(weighted(s, d), G)


@query(None, "method stage", "w2_rna similarity recall")
def six_metric_table(s, d):
    w2 = _w2(s, d, 32).withColumn("modality", F.lit("rna"))
    rec = weighted(s, d).select(*G).distinct().join(_recall(s, d).select("stage", "recall"), "stage")
    return D.six_metric_table(w2, D.jsd(compared(s, d), G).select(*G, "similarity"), rec, G)


@query(
    "SELECT method, avg(m) AS overall, " + ", ".join(f"max(m) FILTER (stage = {y}) AS stage_{y}" for y in range(1995, 2002)) + " FROM (SELECT method, stage, avg(score) AS m FROM scores GROUP BY ALL) GROUP BY ALL",
    "method",
    "overall " + " ".join(f"stage_{y}" for y in range(1995, 2002)),
)
def stage_score_overall(s, d):
    return D.stage_score_overall(scores(s, d), "method", "stage", "score", [*range(1995, 2002)])
