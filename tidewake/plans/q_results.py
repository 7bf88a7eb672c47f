"""Queries of R1-R12."""

from pyspark.sql import functions as F

from ..operators import results as R
from .base import query, scores


@query("SELECT method, stage, score, CAST(stage AS DOUBLE) / 10 AS parameter FROM scores UNION ALL SELECT method, stage, score + 1, stage / 10.0 FROM scores WHERE stage > 1997", "method stage", "score parameter")
def union_scores(s, d):
    a = scores(s, d).withColumn("label", F.concat(F.lit("C_y="), (F.col("stage") / 10).cast("string")))
    b = a.filter("stage > 1997").selectExpr("method AS model", "stage", "score + 1 AS value", "label")
    return R.union_scores([a, b], [{}, {"model": "method", "value": "score"}], "score", "label")


YEARS = [*range(1995, 2002)]  # all years of the orders


@query("SELECT method, setting, " + ", ".join(f"avg(score) FILTER (stage = {y}) AS c_{y}" for y in YEARS) + ", avg(score) AS mean, avg(score) FILTER (stage <> 1996) AS mean_without FROM scores GROUP BY ALL", "method setting", " ".join(f"c_{y}" for y in YEARS) + " mean mean_without")
def pivot_with_mean(s, d):
    return R.pivot_with_mean(scores(s, d), ["method", "setting"], "stage", YEARS, "score", 1996)


@query(
    "WITH a AS (SELECT method, setting, avg(score) AS value FROM scores GROUP BY ALL), b AS (SELECT method, avg(value) AS value FROM a GROUP BY ALL) SELECT method, setting, value FROM a UNION ALL SELECT method, 'Mean', value FROM b UNION ALL SELECT 'Mean', 'Mean', avg(value) FROM b",
    "method setting",
    "value",
)
def mean_of_means(s, d):
    return R.mean_of_means(scores(s, d), ["method", "setting"], "score")


@query("SELECT method, arg_min(setting, (round(m, 9), setting)) AS lowest, min(m) AS lowest_mean, arg_min(setting, (-round(m, 9), setting)) AS highest, max(m) AS highest_mean FROM (SELECT method, setting, avg(score) AS m FROM scores GROUP BY ALL) GROUP BY ALL", "method lowest highest", "lowest_mean highest_mean")
def best_worst_setting(s, d):
    return R.best_worst_setting(scores(s, d), ["method"], "setting", "score")


@query("SELECT stage, avg(score) AS mean FROM scores GROUP BY ALL ORDER BY round(mean, 9), stage LIMIT 1", "stage", "mean")
def select_checkpoint(s, d):
    return R.select_checkpoint(scores(s, d), "stage", "score")


@query("SELECT a.method, a.stage, a.setting, CASE WHEN abs(b.score - a.score) < 5e-7 THEN 0 ELSE b.score - a.score END AS delta FROM scores a JOIN scores b ON a.stage = b.stage AND a.setting = b.setting WHERE b.method = 'BUILDING' AND a.method <> 'BUILDING'", "method stage setting", "delta")
def favorable_delta(s, d):
    return R.favorable_delta(scores(s, d), ["stage", "setting"], "method", "BUILDING", "score", True)


@query("SELECT method, sum(CASE WHEN ok THEN n * score ELSE 0 END) / sum(CASE WHEN ok THEN n ELSE 0 END) AS mean, sum(CASE WHEN ok THEN n ELSE 0 END) / sum(n) AS coverage, sum(CAST(ok AS INT)) AS n_supported, count(*) AS n, sum(n * score) / sum(n) AS mean_all FROM (SELECT *, stage % 2 = 0 AS ok FROM scores) GROUP BY ALL", "method n_supported n", "mean coverage mean_all")
def supported_weighted_mean(s, d):
    return R.supported_weighted_mean(scores(s, d).withColumn("ok", F.expr("stage % 2 = 0")), ["method"], "score", "n", "ok")


@query("SELECT method, setting, rna, atac, (rna + atac) / 2 AS mean, abs(rna - atac) AS gap, sign(rna) = 1 AND sign(atac) = 1 AS as_expected FROM (SELECT method, setting, avg(score - 150000) FILTER (stage % 2 = 0) AS rna, avg(score - 150000) FILTER (stage % 2 = 1) AS atac FROM scores GROUP BY ALL)", "method setting as_expected", "rna atac mean gap")
def paired_response(s, d):
    v = scores(s, d).selectExpr("method", "setting", "CASE WHEN stage % 2 = 0 THEN 'rna' ELSE 'atac' END AS modality", "score - 150000 AS v", "1.0D AS expected")
    return R.paired_response(v, ["method", "setting"], "modality", "v", "expected")


@query("SELECT coalesce(a.method, b.method) AS method, coalesce(a.k, b.k) AS k, rna, atac FROM (SELECT method, nullif(setting, '1-URGENT') AS k, avg(score) AS rna FROM scores WHERE stage < 1999 GROUP BY ALL) a FULL JOIN (SELECT method, nullif(setting, '1-URGENT') AS k, avg(score) AS atac FROM scores WHERE stage > 1996 AND method <> 'BUILDING' GROUP BY ALL) b ON a.method = b.method AND a.k IS NOT DISTINCT FROM b.k", "method k", "rna atac")
def modality_side_by_side(s, d):
    v = scores(s, d).withColumn("k", F.expr("nullif(setting, '1-URGENT')"))
    a = v.filter("stage < 1999").groupBy("method", "k").agg(F.avg("score").alias("v"))
    b = v.filter("stage > 1996 and method <> 'BUILDING'").groupBy("method", "k").agg(F.avg("score").alias("v"))
    return R.modality_side_by_side(a, b, ["method", "k"], "v")


@query("SELECT method, setting, avg(score) FILTER (stage = 1999) - avg(score) FILTER (stage = 1996) AS change FROM scores GROUP BY ALL", "method setting", "change")
def stage_change_matrix(s, d):
    return R.stage_change_matrix(scores(s, d), ["method", "setting"], "stage", 1996, 1999, "score")


@query("SELECT method, stage, quantile_cont(score, 0.5) AS median, avg(score) AS mean, min(score) AS low, max(score) AS high, stddev(score) AS sd FROM scores GROUP BY ALL", "method stage", "median mean low high sd")
def setting_range(s, d):
    return R.setting_range(scores(s, d), ["method", "stage"], "score")


@query("SELECT method, sum(score) AS sum, avg(score) AS mean, count(DISTINCT stage) AS times FROM scores GROUP BY ALL", "method times", "sum mean")
def sum_over_times(s, d):
    return R.sum_over_times(scores(s, d), ["method"], "stage", "score", len(YEARS))


@query("SELECT method, stage, setting, rank() OVER (PARTITION BY stage ORDER BY score DESC) AS rank FROM scores", "method stage setting rank")
def equal_rank(s, d):
    return R.equal_rank(scores(s, d), ["stage"], "score")
