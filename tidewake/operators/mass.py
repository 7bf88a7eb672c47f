"""Mass weights and weighted statistics."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import Keys, known, pearson, ratio
from .ordering import attach, ranked, running_totals


def mass_weights(particles: DataFrame, g: Keys, log_mass: str = "log_mass", on_missing: str = "error", clip: float | None = None) -> DataFrame:
    """Adds `weight`, the softmax of log_mass within g. A group without any log mass is uniform. Where
    some are missing: on_missing 'error' fails the query, 'uniform' makes the whole group uniform."""
    m = known(F.col(log_mass))
    if clip is not None:
        m = F.greatest(m, F.lit(-float(clip)))
    d = particles.withColumn("_m", m)
    top = d.groupBy(*g).agg(F.count(F.lit(1)).alias("_n"), F.count("_m").alias("_known"), F.max("_m").alias("_top"))
    d = attach(d, top, g).withColumn("_e", F.exp(F.col("_m") - F.col("_top")))
    d = attach(d, d.groupBy(*g).agg(F.sum("_e").alias("_all")), g)
    uniform = 1.0 / F.col("_n")
    partly = uniform if on_missing == "uniform" else F.raise_error(F.lit("log mass is missing for some particles of a group")).cast("double")
    weight = F.when(F.col("_known") == 0, uniform).when(F.col("_known") < F.col("_n"), partly).otherwise(F.col("_e") / F.col("_all"))
    return d.withColumn("weight", weight).drop("_m", "_n", "_known", "_e", "_top", "_all")


def mass_summary(particles: DataFrame, g: Keys, log_mass: str = "log_mass") -> DataFrame:
    """total_mass (sum of exp), n, ess = 1 / sum w^2, ess_fraction, max_weight by group; a group without
    log mass counts each particle as mass 1."""
    top = particles.groupBy(*g).agg(F.max(log_mass).alias("_top"))
    e = F.exp(F.coalesce(F.col(log_mass) - F.col("_top"), F.lit(0.0)))
    d = particles.join(top, list(g)).withColumn("_e", e)
    d = d.groupBy(*g).agg(F.count(F.lit(1)).alias("n"), F.sum("_e").alias("_s"), F.sum(F.col("_e") ** 2).alias("_q"), F.max("_e").alias("_x"), F.first("_top").alias("_top"))
    ess = F.col("_s") ** 2 / F.col("_q")
    return d.select(*g, "n", (F.exp(F.coalesce("_top", F.lit(0.0))) * F.col("_s")).alias("total_mass"), ess.alias("ess"), (ess / F.col("n")).alias("ess_fraction"), (F.col("_x") / F.col("_s")).alias("max_weight"))


def relative_total_mass(scores: DataFrame, by: Keys, order: str, mass: str = "total_mass") -> DataFrame:
    """Adds relative_mass: mass over the mass at the first stage of its group."""
    first = F.first(mass).over(Window.partitionBy(*by).orderBy(order))
    return scores.withColumn("relative_mass", ratio(F.col(mass), first))


def weighted_quantile(df: DataFrame, g: Keys, value: str, weight: str, q: float, name: str = "quantile") -> DataFrame:
    """The first value, in order, whose cumulative weight reaches q of the total of its group.

    Weights are summed by distinct value before anything is ordered, so ties and repeats of a value in a
    large group shrink in the map-side aggregation, and totalled in cells (see ordering)."""
    d = df.filter(F.col(value).isNotNull() & (F.col(weight) > 0)).groupBy(*g, value).agg(F.sum(weight).alias("_w"))
    d = running_totals(d, g, value, ["_w"])
    return d.filter(F.col("_w_upto") >= q * F.col("_w_all") - 1e-12).groupBy(*g).agg(F.min(value).alias(name))


def weighted_median(df: DataFrame, g: Keys, value: str, weight: str, name: str = "median") -> DataFrame:
    return weighted_quantile(df, g, value, weight, 0.5, name)


def weighted_mean(df: DataFrame, g: Keys, value: str, weight: str, name: str = "mean") -> DataFrame:
    """Mean over rows where both are known; null where no weight is left."""
    w = F.when(F.col(value).isNotNull(), F.col(weight))
    return df.groupBy(*g).agg(ratio(F.sum(w * F.col(value)), F.sum(w)).alias(name))


def _complete(df: DataFrame, x: str, y: str, w: str) -> DataFrame:
    return df.filter(F.col(x).isNotNull() & F.col(y).isNotNull() & (F.col(w) > 0))


def weighted_pearson(df: DataFrame, g: Keys, x: str, y: str, w: str, name: str = "r") -> DataFrame:
    """Null with fewer than 3 complete rows, or a flat side."""
    r = pearson(F.col(x).cast("double"), F.col(y).cast("double"), F.col(w).cast("double"))
    return _complete(df, x, y, w).groupBy(*g).agg(F.count(F.lit(1)).alias("n"), F.when(F.count(F.lit(1)) >= 3, r).alias(name))


def weighted_spearman(df: DataFrame, g: Keys, x: str, y: str, w: str, name: str = "rho") -> DataFrame:
    """Weighted Pearson correlation of the unweighted average ranks."""
    d = ranked(ranked(_complete(df, x, y, w), g, x, "_rx"), g, y, "_ry")
    return weighted_pearson(d, g, "_rx", "_ry", w, name)


def weighted_covariance(df: DataFrame, g: Keys, vector: str, weight: str) -> DataFrame:
    """i, j, cov for every pair of coordinates. A task multiplies its rows as matrices, batch by batch, and
    hands on d^2 sums for each group that it meets; rows with a null vector or weight take no part."""
    d = df.select(*g, F.col(weight).cast("double").alias("_w"), F.col(vector).cast("array<double>").alias("_x")).dropna(subset=["_w", "_x"])
    kinds = "".join(f"`{c}` {t}, " for c, t in df.select(*g).dtypes)

    def products(batches):
        for pdf in batches:
            parts = pdf.groupby(list(g), dropna=False, sort=False) if g else [((), pdf)]
            for key, part in parts:
                w, x = part["_w"].to_numpy(), np.stack(part["_x"])
                yield pd.DataFrame({**{c: [part[c].iloc[0]] for c in g}, "w": [w.sum()], "first": [w @ x], "second": [((x * w[:, None]).T @ x).ravel()]})

    s = d.mapInPandas(products, f"{kinds}w double, first array<double>, second array<double>")
    total = s.groupBy(*g).agg(F.sum("w").alias("_all"))
    m = s.select(*g, F.posexplode("first").alias("i", "v")).groupBy(*g, "i").agg(F.sum("v").alias("v"))
    m = attach(m, total, g).select(*g, "i", (F.col("v") / F.col("_all")).alias("mi"))
    width = F.sqrt(F.size("second").cast("double")).cast("int")
    c = s.select(*g, width.alias("d"), F.posexplode("second").alias("ij", "v")).groupBy(*g, F.expr("ij div d").cast("int").alias("i"), F.expr("ij % d").cast("int").alias("j")).agg(F.sum("v").alias("v"))
    c = attach(attach(attach(c, total, g), m, [*g, "i"]), m.withColumnsRenamed({"i": "j", "mi": "mj"}), [*g, "j"])
    return c.select(*g, "i", "j", (F.col("v") / F.col("_all") - F.col("mi") * F.col("mj")).alias("cov"))


def weighted_covariance_metrics(observed: DataFrame, predicted: DataFrame, g: Keys) -> DataFrame:
    """cov_cosine and abs_log_trace_ratio of two covariance tables (i, j, cov)."""
    o, p = observed.withColumnRenamed("cov", "_o"), predicted.withColumnRenamed("cov", "_p")
    d = o.join(p, [*g, "i", "j"])
    trace = lambda c: F.sum(F.when(F.col("i") == F.col("j"), F.col(c)))
    return d.groupBy(*g).agg(
        ratio(F.sum(F.col("_o") * F.col("_p")), F.sqrt(F.sum(F.col("_o") ** 2) * F.sum(F.col("_p") ** 2))).alias("cov_cosine"),
        F.abs(F.ln(trace("_p") / trace("_o"))).alias("abs_log_trace_ratio"),
    )
