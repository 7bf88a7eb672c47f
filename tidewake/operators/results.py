"""Result tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import Keys, ratio
from ..functions.lineage import settled
from .ordering import attach, running_totals


def union_scores(tables: list[DataFrame], renames: list[dict[str, str]], value: str, label: str | None = None, pattern: str = r"=([0-9.]+)") -> DataFrame:
    """Tables under common names, stacked; a number is read out of a label's text if asked for; fails on a
    value that is null or not finite."""
    named = [t.withColumnsRenamed(r) for t, r in zip(tables, renames)]
    d = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), named)
    if label:
        d = d.withColumn("parameter", F.nullif(F.regexp_extract(label, pattern, 1), F.lit("")).cast("double"))
    v = F.col(value).cast("double")
    return d.filter(F.assert_true(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")), "a score is not finite").isNull())


def pivot_with_mean(scores: DataFrame, rows: Keys, column: str, values: list, value: str, exclude=None) -> DataFrame:
    """A column c_<value> for each value, their mean, and the mean without `exclude`."""
    wide = scores.groupBy(*rows).pivot(column, values).agg(F.avg(value))
    cells = scores.groupBy(*rows, column).agg(F.avg(value).alias("_v"))
    means = cells.groupBy(*rows).agg(F.avg("_v").alias("mean"), F.avg(F.when(F.col(column) != F.lit(exclude), F.col("_v"))).alias("mean_without"))
    return wide.join(means, list(rows)).select(*rows, *[F.col(f"`{v}`").alias(f"c_{v}") for v in values], "mean", "mean_without")


def mean_of_means(df: DataFrame, levels: Keys, value: str) -> DataFrame:
    """Equal means level by level, from the finest; rows of every level, 'Mean' in place of what is averaged
    away, `value` as the mean."""
    d = df.groupBy(*levels).agg(F.avg(value).alias("value"))
    out, current = [d.select(*[F.col(c).cast("string").alias(c) for c in levels], "value")], d
    for i in range(len(levels) - 1, -1, -1):
        current = current.groupBy(*levels[:i]).agg(F.avg("value").alias("value"))
        out.append(current.select(*[F.col(c).cast("string").alias(c) if j < i else F.lit("Mean").alias(c) for j, c in enumerate(levels)], "value"))
    return reduce(DataFrame.unionByName, out)


def best_worst_setting(scores: DataFrame, g: Keys, setting: str, value: str) -> DataFrame:
    """Settings of least and greatest mean score, ties to the lowest setting."""
    m = scores.groupBy(*g, setting).agg(F.avg(value).alias("_m"))
    low, high = F.min(F.struct(F.round("_m", 9).alias("m"), F.col(setting).alias("s"))), F.min(F.struct((-F.round("_m", 9)).alias("m"), F.col(setting).alias("s")))
    d = m.groupBy(*g).agg(low.alias("_l"), high.alias("_h"))
    return d.select(*g, F.col("_l.s").alias("lowest"), F.col("_l.m").alias("lowest_mean"), F.col("_h.s").alias("highest"), (-F.col("_h.m")).alias("highest_mean"))


def select_checkpoint(metrics: DataFrame, iteration: str, value: str) -> DataFrame:
    """The iteration of least mean, ties to the lower one."""
    return metrics.groupBy(iteration).agg(F.avg(value).alias("mean")).orderBy(F.round("mean", 9), iteration).limit(1)


def favorable_delta(scores: DataFrame, keys: Keys, method: str, baseline: str, value: str, lower_is_better: bool, zero: float = 5e-7) -> DataFrame:
    """Improvement over the baseline method in the favourable direction; below `zero` it is 0."""
    b = scores.filter(F.col(method) == baseline).select(*keys, F.col(value).alias("_b"))
    d = scores.filter(F.col(method) != baseline).join(b, list(keys))
    delta = (F.col("_b") - F.col(value)) * (1.0 if lower_is_better else -1.0)
    return d.withColumn("delta", F.when(F.abs(delta) < zero, 0.0).otherwise(delta)).drop("_b")


def supported_weighted_mean(df: DataFrame, g: Keys, value: str, weight: str, supported: str) -> DataFrame:
    """Weighted mean over supported rows, the weight's coverage, counts, mean over all rows."""
    w = F.when(F.col(supported), F.col(weight)).otherwise(0.0)
    return df.groupBy(*g).agg(
        ratio(F.sum(w * F.col(value)), F.sum(w)).alias("mean"), ratio(F.sum(w), F.sum(weight)).alias("coverage"), F.sum(F.col(supported).cast("long")).alias("n_supported"), F.count(F.lit(1)).alias("n"), ratio(F.sum(F.col(weight) * F.col(value)), F.sum(weight)).alias("mean_all")
    )


def paired_response(df: DataFrame, g: Keys, modality: str, value: str, expected: str) -> DataFrame:
    """rna and atac values side by side, their mean, gap, and whether both have the expected sign."""
    d = df.groupBy(*g, expected).pivot(modality, ["rna", "atac"]).agg(F.avg(value))
    right = lambda c: F.signum(c) == F.col(expected)
    return d.withColumn("mean", (F.col("rna") + F.col("atac")) / 2).withColumn("gap", F.abs(F.col("rna") - F.col("atac"))).withColumn("as_expected", right("rna") & right("atac"))


def modality_side_by_side(a: DataFrame, b: DataFrame, keys: Keys, value: str) -> DataFrame:
    """Full outer join on keys that may be null, nulls matching nulls."""
    left, right = a.select(*keys, F.col(value).alias("rna")).alias("l"), b.select(*keys, F.col(value).alias("atac")).alias("r")
    on = reduce(lambda p, q: p & q, [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys])
    return left.join(right, on, "full_outer").select(*[F.coalesce(f"l.{k}", f"r.{k}").alias(k) for k in keys], "rna", "atac")


def stage_change_matrix(df: DataFrame, rows: Keys, stage: str, first, last, value: str) -> DataFrame:
    """Mean value at the last stage minus at the first."""
    at = lambda s: F.avg(F.when(F.col(stage) == s, F.col(value)))
    return df.groupBy(*rows).agg((at(last) - at(first)).alias("change"))


def setting_range(df: DataFrame, g: Keys, value: str) -> DataFrame:
    """median, mean, min, max, sd over settings."""
    return df.groupBy(*g).agg(F.expr(f"percentile({value}, 0.5)").alias("median"), F.avg(value).alias("mean"), F.min(value).alias("low"), F.max(value).alias("high"), F.stddev(value).alias("sd"))


def sum_over_times(scores: DataFrame, g: Keys, time: str, value: str, n_times: int) -> DataFrame:
    """Sum and mean over times; fails where a group lacks one."""
    d = scores.groupBy(*g).agg(F.sum(value).alias("sum"), F.avg(value).alias("mean"), F.count_distinct(time).alias("times"))
    return d.filter(F.assert_true(F.col("times") == n_times, "a group lacks a time").isNull())


def equal_rank(df: DataFrame, g: Keys, value: str) -> DataFrame:
    """Adds rank (the least of equals), greatest value first; rows without a value share the rank after the last. Only
    distinct values are ordered, in cells. df is settled, as a computed score that is computed again may differ in its
    last bits and then does not meet its own rank."""
    df = settled(df)
    d = df.filter(F.col(value).isNotNull()).groupBy(*g, value).agg(F.count(F.lit(1)).alias("_n"))
    d = running_totals(d, g, value, ["_n"]).select(*g, value, (F.col("_n_all") - F.col("_n_upto") + 1).alias("_rank"))
    sizes = df.groupBy(*g).agg((F.count(value) + 1).alias("_last"))
    found = attach(attach(df, d, [*g, value]), sizes, g)
    return found.withColumn("rank", F.coalesce("_rank", "_last").cast("int")).drop("_rank", "_last")
