"""Queries of C1-C11."""

from pyspark.sql import functions as F

from ..operators import curves as C
from .base import curves, query, table

EVENTS = "(SELECT DISTINCT feature FROM curves)"


def ids(s, d):
    return curves(s, d).withColumn("id", F.concat_ws("/", "feature", "grp"))


def pairs(s, d):
    v = ids(s, d).select("id", "grp", "feature").distinct()
    return v.selectExpr("id AS a_id", "grp").join(v.selectExpr("id AS b_id", "grp"), "grp").filter("a_id <> b_id").select("a_id", "b_id")


@query(None, "id", "first total")
def smooth_derivative(s, d):
    r = C.smooth_derivative(ids(s, d), ["id"])
    return r.select("id", F.col("d")[0].alias("first"), F.aggregate("d", F.lit(0.0), lambda a, v: a + v).alias("total"))


@query(
    """WITH c AS (SELECT feature || '/' || grp AS id, grp, list(value ORDER BY t) AS v FROM curves GROUP BY ALL),
 p AS (SELECT a.id AS a_id, b.id AS b_id, lag, CASE WHEN lag > 0 THEN a.v[1 + lag:] ELSE a.v[1:len(a.v) + lag] END AS x, CASE WHEN lag < 0 THEN b.v[1 - lag:] ELSE b.v[1:len(b.v) - lag] END AS y FROM c a JOIN c b ON a.grp = b.grp AND a.id <> b.id, range(-2, 3) r(lag)),
 s AS (SELECT a_id, b_id, lag, list_cosine_similarity(x, y) AS score FROM p)
 SELECT a_id, b_id, lag, score FROM (SELECT *, row_number() OVER (PARTITION BY a_id, b_id ORDER BY round(score, 9) DESC, abs(lag), lag) AS r FROM s) WHERE r = 1""",
    "a_id b_id lag",
    "score",
)
def lagged_cosine(s, d):
    c = C.packed(ids(s, d), ["id"]).select("id", F.col("v").alias("d"))
    return C.lagged_cosine(c, c, pairs(s, d), 2)


@query(None, "a_id b_id window lag", "score lag_time second margin range_a range_b null_median null_max")
def lag_score(s, d):
    return C.lag_score(pairs(s, d), C.packed(ids(s, d), ["id"]), (5, 7), (7, 13))


BASE = "(SELECT c_mktsegment AS m, o_orderpriority AS gene, y AS peak, o_orderstatus AS k, ln(avg(o_totalprice)) AS score FROM orders_y JOIN customer ON c_custkey = o_custkey GROUP BY ALL)"
TRUE = f"(SELECT m, gene, peak, CASE WHEN peak <> 1994 OR left(gene, 1) > '2' THEN score END AS score FROM {BASE} WHERE k = 'O')"
NULLS = f"(SELECT m, gene, peak, k, score FROM {BASE} WHERE k <> 'O' AND NOT (peak = 1996 AND m = 'BUILDING'))"


def base(s, d):
    o = table(s, d, "orders").join(table(s, d, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    return o.groupBy(F.col("c_mktsegment").alias("m"), F.col("o_orderpriority").alias("gene"), F.year("o_orderdate").alias("peak"), F.col("o_orderstatus").alias("k")).agg(F.ln(F.avg("o_totalprice")).alias("score"))


def true(s, d):
    """Scores of the first kind; of one year those of two genes are missing."""
    return base(s, d).filter("k = 'O'").withColumn("score", F.expr("CASE WHEN peak <> 1994 OR left(gene, 1) > '2' THEN score END")).drop("k")


def nulls(s, d):
    """Scores of the other kinds, of which one segment and year has none."""
    return base(s, d).filter("k <> 'O' AND NOT (peak = 1996 AND m = 'BUILDING')")


def _calibrated(true_sql, null_sql, keys, g):
    on = " AND ".join(f"n.{k} = t.{k}" for k in keys)
    cols = ", ".join(f"t.{k}" for k in keys)
    part = f"PARTITION BY {', '.join(g)}" if g else ""
    known = f"PARTITION BY {', '.join([*g, 'p IS NULL'])}"
    return f"""WITH t AS {true_sql}, j AS (SELECT {cols}, count(n.score) AS null_n, quantile_cont(n.score, 0.5) AS null_median, max(n.score) AS null_max, sum(CAST(n.score >= t.score AS INT)) AS ge FROM t JOIN {null_sql} n ON {on} GROUP BY ALL),
 c AS (SELECT t.*, coalesce(null_n, 0) AS null_n, null_median, null_max, CASE WHEN score IS NOT NULL AND null_n > 0 THEN (1 + ge) / (1 + null_n) END AS p, CASE WHEN score IS NOT NULL AND null_n > 0 THEN 1 - ge / null_n END AS percentile, score - null_median AS difference FROM t LEFT JOIN j ON {on.replace('n.', 'j.')}),
 r AS (SELECT *, p * count(*) OVER ({known}) / (rank() OVER ({known} ORDER BY p) + count(*) OVER ({known}, p) - 1) AS raw, CASE WHEN score IS NOT NULL THEN rank() OVER ({part} ORDER BY score DESC NULLS LAST) END AS rank, count(*) OVER ({part}) AS total FROM c)
 SELECT *, CASE WHEN p IS NOT NULL THEN least(min(raw) OVER ({known} ORDER BY p DESC), 1) END AS q, coalesce(rank <= greatest(ceil(0.1 * total), 1), false) AS top_decile FROM r"""


@query(_calibrated(TRUE, NULLS, ["m", "gene", "peak"], ["m"]), "m gene peak null_n top_decile", "rank score null_median null_max p percentile difference q")
def calibrate_against_nulls(s, d):
    """A third of the scores of one year is null, and a segment lacks its nulls there."""
    return C.calibrate_against_nulls(true(s, d), nulls(s, d), ["m", "gene", "peak"], ["m"])


WINNERS = f"(SELECT m, gene, peak, score, circular_median, circular_max FROM (SELECT *, row_number() OVER (PARTITION BY m, gene ORDER BY round(score, 9) DESC NULLS LAST, peak) AS w, quantile_cont(c, 0.5) OVER (PARTITION BY m, gene) AS circular_median, max(c) OVER (PARTITION BY m, gene) AS circular_max FROM (SELECT *, unnest([max(score - 0.01 * (peak % 3)) OVER k, max(score - 0.02 * (peak % 2)) OVER k, max(score - 0.03e0) OVER k]) AS c FROM {TRUE} WINDOW k AS (PARTITION BY m, gene))) WHERE w = 1)"
MAXIMA = f"(SELECT m, gene, k, max(score) AS score FROM {NULLS} GROUP BY ALL)"
WON = _calibrated(WINNERS, MAXIMA, ["m", "gene"], ["m"])


def winners(s, d):
    t = true(s, d).selectExpr("*", "score - 0.01D * (peak % 3) AS c1", "score - 0.02D * (peak % 2) AS c2", "score - 0.03D AS c3")
    return C.gene_level_winners(t, nulls(s, d), "gene", "peak", "k", model=["m"], circular=["c1", "c2", "c3"])


@query(WON, "m gene peak null_n", "rank score null_median null_max p percentile q circular_median circular_max")
def gene_level_winners(s, d):
    return winners(s, d)


@query(
    f"""WITH r AS (SELECT m, gene, peak, score, rank() OVER (PARTITION BY m ORDER BY score DESC NULLS LAST) AS rank FROM {TRUE}), a AS (SELECT m, gene, peak, rank() OVER (PARTITION BY m ORDER BY score DESC) AS alternate_rank FROM {NULLS} WHERE k = 'F'),
 l AS (SELECT m, gene, peak, count(*) AS lines, quantile_cont(score, 0.5) AS line_median, avg(CASE WHEN k = 'F' THEN 1.0 ELSE 0 END) AS share FROM {NULLS} GROUP BY ALL)
 SELECT r.m, r.gene, r.peak, r.rank, alternate_rank, lines, line_median, share AS positive_lag_share FROM r LEFT JOIN a ON a.m = r.m AND a.gene = r.gene AND a.peak = r.peak LEFT JOIN l ON l.m = r.m AND l.gene = r.gene AND l.peak = r.peak""",
    "m gene peak",
    "rank alternate_rank lines line_median positive_lag_share",
)
def stability_summary(s, d):
    from ..operators.results import equal_rank

    lines = nulls(s, d).withColumn("lag", F.expr("CASE WHEN k = 'F' THEN 1 ELSE 0 END"))
    return C.stability_summary(equal_rank(true(s, d), ["m"], "score"), equal_rank(nulls(s, d).filter("k = 'F'"), ["m"], "score"), lines, ["m", "gene", "peak"])


def _pairs(s, d):
    """Mean vectors of label by remainder stand for genes (even) and peaks (odd); neighbours are pairs."""
    from ..functions.columns import dot

    e = table(s, d, "embeddings").select(F.expr("label * 8 + vec_id % 8").cast("long").alias("id"), F.posexplode("embedding").alias("i", "v")).groupBy("id", "i").agg(F.avg("v").alias("v"))
    e = e.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("i", "v")))["v"].alias("x"))  # 80 rows of 64
    a, b = e.filter("id % 2 = 0"), e.filter("id % 2 = 1")
    every = a.selectExpr("id AS a_id", "x AS ax").crossJoin(b.selectExpr("id AS b_id", "x AS bx")).select("a_id", "b_id", dot("ax", "bx").alias("score"))
    return every, a.selectExpr("id AS a_id", "id + 1 AS b_id")


PAIRS = """(WITH e AS (SELECT label * 8 + vec_id % 8 AS id, i, avg(CAST(embedding[i + 1] AS DOUBLE)) AS v FROM embeddings, range(64) r(i) GROUP BY ALL)
 SELECT a.id AS a_id, b.id AS b_id, sum(a.v * b.v) AS score, b.id = a.id + 1 AS obs FROM e a JOIN e b ON a.i = b.i AND a.id % 2 = 0 AND b.id % 2 = 1 GROUP BY ALL)"""


@query(
    f"""WITH s AS {PAIRS}, p AS (SELECT a.a_id, a.b_id, (1 + count(*) FILTER (b.score >= a.score)) / (1 + count(*)) AS p, sum(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0 END) AS u, count(*) AS m FROM s a JOIN s b ON a.obs AND NOT b.obs GROUP BY ALL),
 q AS (SELECT least(min(raw) OVER (ORDER BY p DESC), 1) AS q FROM (SELECT *, p * count(*) OVER () / count(*) OVER (ORDER BY p) AS raw FROM p)),
 o AS (SELECT count(*) FILTER (obs) AS n, count(*) FILTER (NOT obs) AS m, quantile_cont(score, 0.5) FILTER (obs) AS median, quantile_cont(score, 0.5) FILTER (NOT obs) AS mismatched_median, avg(CAST(score > 0.5 AS INT)) FILTER (obs) AS observed_above_50, avg(CAST(score > 0.5 AS INT)) FILTER (NOT obs) AS mismatched_above_50, avg(CAST(score > 0.8 AS INT)) FILTER (obs) AS observed_above_80, avg(CAST(score > 0.8 AS INT)) FILTER (NOT obs) AS mismatched_above_80 FROM s)
 SELECT *, (SELECT sum(u) / sum(m) FROM p) AS auroc, (SELECT count(*) FILTER (q < 0.05) FROM q) AS q_below_05, (SELECT count(*) FILTER (q < 0.1) FROM q) AS q_below_10 FROM o""",
    "n m q_below_05 q_below_10",
    "median mismatched_median auroc observed_above_50 mismatched_above_50 observed_above_80 mismatched_above_80",
)
def pair_shuffle_test(s, d):
    return C.pair_shuffle_test(*_pairs(s, d), permutations=200)


@query(None, "n", "rank_p p null_median null_q025 null_q975")
def pair_shuffle_nulls(s, d):
    return C.pair_shuffle_test(*_pairs(s, d))


@query(
    f"""WITH s AS {PAIRS}, p AS (SELECT a.a_id, a.b_id, a.score, (1 + count(*) FILTER (b.score >= a.score)) / (1 + count(*)) AS p FROM s a JOIN s b ON a.obs AND NOT b.obs GROUP BY ALL),
 r AS (SELECT *, p * count(*) OVER () / count(*) OVER (ORDER BY p) AS raw FROM p) SELECT *, least(min(raw) OVER (ORDER BY p DESC), 1) AS q FROM r""",
    "a_id b_id",
    "score p q",
)
def pair_significance(s, d):
    return C.pair_significance(*_pairs(s, d))


@query(
    f"""WITH s AS {PAIRS}, u AS (SELECT sum(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0 END) AS u FROM s a JOIN s b ON a.obs AND NOT b.obs), t AS (SELECT sum(power(c, 3) - c) AS t FROM (SELECT count(*) AS c FROM s GROUP BY score)),
 k AS (SELECT count(*) FILTER (obs) AS n, count(*) FILTER (NOT obs) AS m FROM s) SELECT n, m, u, (u - n * m / 2.0 - 0.5) / sqrt(n * m / 12.0 * (n + m + 1 - t / ((n + m) * (n + m - 1.0)))) AS z FROM u, t, k""",
    "n m",
    "u z",
)
def mann_whitney(s, d):
    return C.mann_whitney(*_pairs(s, d))


@query("SELECT 'x' AS kind, count(*) AS n, avg(CASE WHEN best = 2 THEN 1.0 ELSE 0 END) AS rate FROM (SELECT feature, arg_min(grp, (-value, grp)) AS best FROM curves WHERE t = 3 GROUP BY ALL)", "kind n", "rate")
def dominant_match(s, d):
    c = curves(s, d).withColumn("kind", F.lit("x"))
    return C.dominant_match(c, c.select("feature").distinct().withColumn("annotated", F.lit(2)), 3)


@query("SELECT feature, grp, t, coalesce((value - avg(value) OVER w) / nullif(stddev_pop(value) OVER w, 0), 0) AS z FROM curves WINDOW w AS (PARTITION BY feature, grp)", "feature grp t", "z")
def curve_zscore(s, d):
    return C.curve_zscore(curves(s, d), ["feature", "grp"])


RANKED = f"(SELECT *, row_number() OVER (PARTITION BY m ORDER BY round(score, 9) DESC, gene, peak) AS model_rank, row_number() OVER (PARTITION BY m, gene ORDER BY round(score, 9) DESC, gene, peak) AS cohort_rank FROM {TRUE} WHERE score IS NOT NULL)"


def ranked(s, d):
    return C.rank_pairs(true(s, d).filter("score IS NOT NULL"), "m", "gene", ["gene", "peak"])


@query(f"SELECT m, gene, peak, model_rank, cohort_rank FROM {RANKED}", "m gene peak model_rank cohort_rank")
def rank_pairs(s, d):
    return ranked(s, d)


CONSENSUS = f"(SELECT *, row_number() OVER (ORDER BY round(mean_score, 9) DESC, round(least_score, 9) DESC, gene, peak) AS overall_rank FROM (SELECT gene, peak, count(DISTINCT m) AS models, avg(score) AS mean_score, min(score) AS least_score, max(score) AS greatest_score, avg(length(m) - 8) AS mean_lag FROM {RANKED} GROUP BY ALL))"


def _consensus(s, d):
    return C.pair_consensus(ranked(s, d).withColumn("lag", F.expr("length(m) - 8")), ["gene", "peak"], "m", lag="lag")


@query(f"SELECT * FROM {CONSENSUS}", "gene peak models overall_rank", "mean_score least_score greatest_score mean_lag")
def pair_consensus(s, d):
    return _consensus(s, d)


@query(f"SELECT gene, peak, overall_rank, row_number() OVER (ORDER BY overall_rank) AS display_order FROM (SELECT *, row_number() OVER (PARTITION BY gene ORDER BY overall_rank) AS r FROM {CONSENSUS} WHERE models = 5 AND peak % 2 = 0) WHERE r = 1 ORDER BY overall_rank LIMIT 4", "gene peak overall_rank display_order")
def select_supported(s, d):
    return C.select_supported(_consensus(s, d), "gene", 5, 4, F.expr("peak % 2 = 0"))


CAL = _calibrated(TRUE, NULLS, ["m", "gene", "peak"], ["m"])
AP = "ap AS (SELECT m, CASE WHEN sum(p1) > 0 AND sum(p1) < sum(n1) THEN sum(p1 * cp / cn) / sum(p1) END AS average_precision FROM (SELECT m, p1, n1, sum(p1) OVER w AS cp, sum(n1) OVER w AS cn FROM (SELECT m, score, sum(CAST(support AS INT)) AS p1, count(*) AS n1 FROM z WHERE score IS NOT NULL GROUP BY ALL) WINDOW w AS (PARTITION BY m ORDER BY score DESC)) GROUP BY ALL)"
SUMMARY = f"""WITH z AS (SELECT *, peak % 2 = 0 AS support FROM ({CAL})), {AP},
 o AS (SELECT m, sum(CAST(top_decile AND support AS INT)) + 0.5e0 AS a, sum(CAST(top_decile AND NOT support AS INT)) + 0.5e0 AS b, sum(CAST(NOT top_decile AND support AS INT)) + 0.5e0 AS c, sum(CAST(NOT top_decile AND NOT support AS INT)) + 0.5e0 AS d FROM z GROUP BY ALL),
 r AS (SELECT m, a * d / (b * c) AS odds_ratio, sqrt(1 / a + 1 / b + 1 / c + 1 / d) AS se FROM o)
 SELECT z.m, count(*) AS n, count(*) FILTER (support) AS supported, quantile_cont(difference, 0.5) AS median_difference, count(*) FILTER (q <= 0.1) AS significant, avg(CASE WHEN peak % 3 - 1 > 0 THEN 1.0 ELSE 0 END) AS lead_fraction, any_value(average_precision) AS average_precision,
 any_value(odds_ratio) AS odds_ratio, any_value(exp(ln(odds_ratio) - 1.96e0 * se)) AS odds_low, any_value(exp(ln(odds_ratio) + 1.96e0 * se)) AS odds_high FROM z JOIN ap ON ap.m = z.m JOIN r ON r.m = z.m GROUP BY z.m"""
GENES = f"""WITH z AS (SELECT *, left(gene, 1) IN ('1', '3', '4') AS support FROM ({WON})), {AP}
 SELECT z.m, count(*) AS n, count(*) FILTER (support) AS supported, count(*) FILTER (support AND q <= 0.1) AS significant, avg(CASE WHEN peak % 3 - 1 > 0 THEN 1.0 ELSE 0 END) FILTER (support) AS lead_fraction, quantile_cont(difference, 0.5) FILTER (support) AS median_difference, any_value(average_precision) AS average_precision FROM z JOIN ap ON ap.m = z.m GROUP BY z.m"""


def _summary(s, d):
    r = C.calibrate_against_nulls(true(s, d), nulls(s, d), ["m", "gene", "peak"], ["m"]).withColumn("support", F.expr("peak % 2 = 0")).withColumn("lag", F.expr("peak % 3 - 1"))
    return C.model_pair_summary(r, "m", "score", "support", "q", "difference", "lag")


def _gene_summary(s, d):
    w = winners(s, d).withColumn("support", F.expr("left(gene, 1) IN ('1', '3', '4')")).withColumn("lag", F.expr("peak % 3 - 1"))
    return C.model_gene_summary(w, "m", "score", "support", "q", "difference", "lag")


@query(SUMMARY, "m n supported significant", "median_difference average_precision odds_ratio odds_low odds_high lead_fraction")
def model_pair_summary(s, d):
    return _summary(s, d)


@query(GENES, "m n supported significant", "median_difference average_precision lead_fraction")
def model_gene_summary(s, d):
    return _gene_summary(s, d)


#: Models that stand for comparators, and the two classes of models.
COMPARATOR, CLASS = "m IN ('BUILDING', 'MACHINERY')", "length(m) % 2"
DELTAS = f"(WITH g AS ({GENES}) SELECT m, delta, CASE WHEN NOT ({COMPARATOR}) THEN average_precision - best END AS delta_matched, significant, median_difference FROM (SELECT *, average_precision - (SELECT max(average_precision) FROM g WHERE {COMPARATOR}) AS delta, max(CASE WHEN {COMPARATOR} THEN average_precision END) OVER (PARTITION BY {CLASS}) AS best FROM g))"


def _deltas(s, d):
    return C.comparator_deltas(_gene_summary(s, d).withColumn("class", F.expr(CLASS)), "average_precision", F.expr(COMPARATOR), ["class"])


@query(f"SELECT * FROM {DELTAS}", "m", "delta delta_matched")
def comparator_deltas(s, d):
    return _deltas(s, d)


@query(f"SELECT m, CASE WHEN significant > 0 AND median_difference >= -0.05 AND delta >= 0.02 THEN 'PASS' WHEN significant >= 0 AND median_difference >= -0.1 THEN 'PASS_PART' ELSE 'STOP' END AS decision FROM {DELTAS}", "m decision")
def decisions(s, d):
    rules = [("PASS", [("significant", ">", 0), ("median_difference", ">=", -0.05), ("delta", ">=", 0.02)]), ("PASS_PART", [("significant", ">=", 0), ("median_difference", ">=", -0.1)])]
    return C.decisions(_deltas(s, d), rules, "STOP")


@query(f"SELECT 1 AS k, avg(CASE WHEN delta >= -0.1 AND median_difference > -0.1 THEN 1.0 ELSE 0 END) AS share FROM {DELTAS} WHERE NOT ({COMPARATOR})", "k", "share")
def share_that_holds(s, d):
    return C.share_that_holds(_deltas(s, d).filter(f"NOT ({COMPARATOR})").withColumn("k", F.lit(1)), ["k"], [("delta", ">=", -0.1), ("median_difference", ">", -0.1)])
