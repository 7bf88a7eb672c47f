"""Feature matrices, scores, association."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions.columns import Keys, known, pearson, ratio, top_n
from ..functions.lineage import settled
from ..functions.tails import fisher_greater, normal_two_sided, t_tail, t_two_sided
from .ordering import attach, least_from, numbered, quantiles, ranked, running_totals, standardized


def log_normalize(counts: DataFrame, size_factors: DataFrame) -> DataFrame:
    """cell, feature, value = log1p(count / size factor), the factor at least 1e-12."""
    return counts.join(size_factors, "cell").select("cell", "feature", F.log1p(F.col("value") / F.greatest(F.col("size_factor"), F.lit(1e-12))).alias("value"))


def binarize(counts: DataFrame) -> DataFrame:
    """Every stored value becomes 1."""
    return counts.withColumn("value", F.lit(1.0))


def tfidf_project(counts: DataFrame, idf: DataFrame, components: DataFrame) -> DataFrame:
    """cell, component, score: log1p(1e4 idf / detected features of the cell) on frozen components."""
    n = F.count(F.lit(1)).over(Window.partitionBy("cell"))
    t = counts.withColumn("_n", n).join(idf, "feature").withColumn("_t", F.log1p(1e4 * F.col("idf") / F.col("_n")))
    return t.join(components, "feature").groupBy("cell", "component").agg(F.sum(F.col("_t") * F.col("loading")).alias("score"))


def regress_out(values: DataFrame, design: DataFrame, beta: DataFrame, scale: DataFrame) -> DataFrame:
    """cell, feature, value: (value - design . beta) / scale. design: cell, term, d; beta: feature, term, b."""
    fitted = design.join(beta, "term").groupBy("cell", "feature").agg(F.sum(F.col("d") * F.col("b")).alias("_f"))
    d = values.join(fitted, ["cell", "feature"], "left").join(scale, "feature")
    return d.select("cell", "feature", ((F.col("value") - F.coalesce("_f", F.lit(0.0))) / F.col("scale")).alias("value"))


def _dense(cells: DataFrame, features: DataFrame, counts: DataFrame) -> DataFrame:
    """Every cell by the given (few) features, absent counts as 0."""
    return cells.crossJoin(features).join(counts, ["cell", "feature"], "left").withColumn("value", F.coalesce("value", F.lit(0.0)))


def module_score(cells: DataFrame, counts: DataFrame, modules: DataFrame, by: Keys, flat: str = "drop") -> DataFrame:
    """cell, module, score: mean z of the module's genes within `by`, zeros counted. Genes without spread
    are dropped or, with flat='one', count as 0. Zero rows are made only for the module's own genes."""
    d = _dense(cells.select("cell", *by), modules.select("feature").distinct(), counts.select("cell", "feature", "value"))
    d = standardized(d, [*by, "feature"], "value", "_z", 0.0 if flat == "one" else None, 1e-12)
    return d.filter("_z is not null").join(modules, "feature").groupBy("cell", "module").agg(F.avg("_z").alias("score"))


def linked_peak_score(accessible: DataFrame, links: DataFrame, by: Keys) -> DataFrame:
    """cell, score: mean peak z of each gene, z again, equal mean over genes. accessible: cell, by, peak,
    value with a row for every cell and linked peak. Flat peaks, and genes whose mean is flat, are left out; score is
    null where none is left."""
    z = standardized(accessible, [*by, "peak"], "value", "_z", None, 1e-12).filter("_z is not null").join(links.select("gene", "peak"), "peak")
    g = z.groupBy("cell", *by, "gene").agg(F.avg("_z").alias("_g"))
    s = standardized(g, [*by, "gene"], "_g", "_z", None, 1e-12).groupBy("cell", *by).agg(F.avg("_z").alias("score"))
    return accessible.select("cell", *by).distinct().join(s, ["cell", *by], "left")


def peak_set_fraction(counts: DataFrame, sets: DataFrame) -> DataFrame:
    """cell, set, fraction of the set's peaks that are open in the cell."""
    size = sets.groupBy("set").agg(F.count(F.lit(1)).alias("_s"))
    n = counts.select("cell", "feature").distinct().join(sets, "feature").groupBy("cell", "set").agg(F.count(F.lit(1)).alias("_n"))
    return n.join(size, "set").select("cell", "set", (F.col("_n") / F.col("_s")).alias("fraction"))


def depth_normalised_score(cells: DataFrame, counts: DataFrame, sets: DataFrame) -> DataFrame:
    """cell, set, score: z over all cells of log1p(1e5 n / depth), n the set's open peaks of the cell and depth all
    its open peaks (1 at least); 0 for a flat set. Cells without a count take part with n = 0; sets are few."""
    open_ = counts.filter(F.col("value") > 0).select("cell", "feature").distinct()
    depth = open_.groupBy("cell").agg(F.count(F.lit(1)).alias("_depth"))
    n = open_.join(sets, "feature").groupBy("cell", "set").agg(F.count(F.lit(1)).alias("_n"))
    every = cells.select("cell").distinct().crossJoin(sets.select("set").distinct())
    d = every.join(n, ["cell", "set"], "left").join(depth, "cell", "left").fillna(0, ["_n", "_depth"])
    d = d.withColumn("_v", F.log1p(1e5 * F.col("_n") / F.greatest("_depth", F.lit(1))))
    return standardized(d, ["set"], "_v", "score", 0.0, 1e-12).select("cell", "set", "score")


def set_contrast(fractions: DataFrame, a: str, b: str) -> DataFrame:
    """cell, contrast = fraction of a - fraction of b, 0 where a cell has none."""
    part = lambda s: F.sum(F.when(F.col("set") == s, F.col("fraction")).otherwise(0.0))
    return fractions.groupBy("cell").agg((part(a) - part(b)).alias("contrast"))


def zscore_and_high(df: DataFrame, g: Keys, value: str, q: float) -> DataFrame:
    """Adds z (0 if flat) and high: at or above the linear q-quantile of the group."""
    cut = quantiles(df, g, value, {"_c": q})
    return attach(standardized(df, g, value, "z", 0.0), cut, g).withColumn("high", F.col(value) >= F.col("_c")).drop("_c")


def partial_spearman(df: DataFrame, g: Keys, y: str, features: Keys, covariates: Keys, extra_df: int = 2, least: int = 10) -> DataFrame:
    """g, feature, n, rho, p: Spearman correlation of y and each feature given numeric covariates (a category
    is passed as columns of 0 and 1): average ranks, residuals on intercept and z-scored covariates, Pearson, t
    with n - rank - extra_df degrees, one at least. Null with too few rows or a flat side.

    Ranks are found in cells and only sums of products of centred columns leave the tasks: a group and feature
    is one row when its residuals are taken, by the products of residuals that least squares leaves. Where no feature
    lacks a value, y is ranked and the covariates are standardised once for all features."""
    by = [*g, "feature"]
    base = df.select(*g, F.col(y).cast("double").alias("_y"), *[F.col(c).cast("double").alias(c) for c in covariates], *[F.col(f).cast("double").alias(f"_f{i}") for i, f in enumerate(features)])
    base = base.dropna(subset=["_y", *covariates, *g] if g else ["_y", *covariates])
    named = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"_f{i}").alias("v")) for i, f in enumerate(features)])).alias("_f")
    lacks = [F.count_if(F.col(f"_f{i}").isNull() | F.isnan(f"_f{i}")) for i in range(len(features))]
    whole = sum(v or 0 for v in base.agg(*lacks).first()) == 0
    keys = g if whole else by
    if not whole:
        base = base.select(*g, "_y", *covariates, named).select(*g, "_y", *covariates, "_f.feature", "_f.v").dropna()
    d = ranked(base, keys, "_y", "_ry", "_n")
    for i, c in enumerate(covariates):
        d = standardized(d, keys, c, f"_c{i}", 0.0)
    if whole:
        d = settled(d.select(*g, "_ry", "_n", *[f"_c{i}" for i in range(len(covariates))], named)).select("*", "_f.feature", "_f.v").drop("_f")
    centred = lambda c: F.col(c) / F.col("_n") - (F.col("_n") + 1) / (2 * F.col("_n"))
    d = ranked(d, by, "v", "_rv").withColumn("_ry", centred("_ry")).withColumn("_rv", centred("_rv"))
    names = [*[f"_c{i}" for i in range(len(covariates))], "_ry", "_rv"]
    sums = d.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.array(*[F.sum(F.col(a) * F.col(b)) for a in names for b in names]).alias("s"))
    kinds = ", ".join(f"`{c}` {t}" for c, t in df.select(*g).dtypes)

    def fit(n: int, s: np.ndarray) -> tuple[float | None, float | None]:
        k = len(names) - 2
        s = s.reshape(k + 2, k + 2)
        beta, _, rank, _ = np.linalg.lstsq(s[:k, :k], s[:k, k:], rcond=1e-12) if k else (np.zeros((0, 2)), None, 0, None)
        left = s[k:, k:] - s[k:, :k] @ beta
        if n < least or not all(left[i, i] > 1e-12 * max(s[k + i, k + i], 1e-300) for i in (0, 1)):
            return None, None
        rho = float(np.clip(left[0, 1] / np.sqrt(left[0, 0] * left[1, 1]), -1, 1))
        free = max(n - (int(rank) + 1) - extra_df, 1)
        return rho, t_tail(rho * np.sqrt(free / max(1 - rho * rho, 1e-300)), free)

    def solve(batches):
        for pdf in batches:
            out = pd.DataFrame([fit(n, s) for n, s in zip(pdf["n"], pdf["s"], strict=True)], columns=["rho", "p"], dtype=float)
            yield pd.concat([pdf.drop(columns="s"), out], axis=1)

    return sums.mapInPandas(solve, f"{kinds + ', ' if kinds else ''}feature string, n long, rho double, p double")


def bh_fdr(df: DataFrame, g: Keys, p: str, name: str = "q") -> DataFrame:
    """Adds the Benjamini-Hochberg q within each group; null p stay null and do not count. Distinct p are
    counted, and ranked in cells (see ordering), so a single group spreads over many tasks."""
    d = running_totals(df.filter(F.col(p).isNotNull()).groupBy(*g, p).agg(F.count(F.lit(1)).alias("_n")), g, p, ["_n"])
    d = least_from(d.withColumn("_raw", F.col(p) * F.col("_n_all") / F.col("_n_upto")), g, p, "_raw", "_q")
    return attach(df, d.select(*g, p, F.least("_q", F.lit(1.0)).alias(name)), [*g, p])


def tail_contrast(df: DataFrame, g: Keys, by: str, value: str, fraction: float, key: str) -> DataFrame:
    """Mean value over the top fraction of `by` minus the bottom fraction (floor, one row at least), ties by key.
    Rows with a null `by` take no part."""
    d = numbered(df.filter(F.col(by).isNotNull()), g, by, [key], "_a", "_all")
    d = d.withColumn("_k", F.greatest(F.floor(F.col("_all") * fraction), F.lit(1)))
    top, low = F.avg(F.when(F.col("_all") - F.col("_a") < F.col("_k"), F.col(value))), F.avg(F.when(F.col("_a") <= F.col("_k"), F.col(value)))
    return d.groupBy(*g).agg((top - low).alias("contrast"))


def joint_high_enrichment(df: DataFrame, g: Keys, x: str, scores: Keys, fraction: float, key: str, least: int = 20) -> DataFrame:
    """g, n, high_x, high_y, n_both, observed, baseline, enrichment, p: how often the top rows of x are in the top of
    every one of `scores`. The top of a column is exactly floor(fraction n) rows of a group, one at least; of equal
    values those of the greater key. Rows with a null or NaN take no part. observed = n_both / high_x, baseline =
    high_y / n, p is Fisher's one-sided. Null below `least` rows."""
    columns = [x, *scores]
    d = df.select(*g, key, *[F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(c) for c in columns]).dropna(subset=columns)
    for i, c in enumerate(columns):
        d = numbered(d, g, c, [key], f"_p{i}", "_all" if i == 0 else None)
    k = F.greatest(F.floor(F.col("_all") * fraction), F.lit(1))
    top = [(F.col("_all") - F.col(f"_p{i}") < k).cast("long") for i in range(len(columns))]
    every = top[1]
    for t in top[2:]:
        every = every * t
    d = d.groupBy(*g).agg(F.count(F.lit(1)).alias("n"), F.sum(top[0]).alias("high_x"), F.sum(every).alias("high_y"), F.sum(top[0] * every).alias("n_both"))
    enough = F.col("n") >= least
    d = d.withColumn("observed", F.when(enough, F.col("n_both") / F.col("high_x"))).withColumn("baseline", F.when(enough, F.col("high_y") / F.col("n")))
    return d.withColumn("enrichment", ratio(F.col("observed"), F.col("baseline"))).withColumn("p", F.when(enough, fisher_greater(F.col("n_both"), F.col("high_x"), F.col("high_y"), F.col("n"))))


def replicate_sign_agreement(rho: DataFrame, g: Keys, value: str, expected: float | None = None) -> DataFrame:
    """n, min, max, and whether two replicates or more all have one sign (or the expected one)."""
    s = F.signum(value)
    same = (F.min(s) == F.max(s)) & (F.min(s) != 0)
    if expected is not None:
        same = same & (F.min(s) == float(np.sign(expected)))
    return rho.filter(F.col(value).isNotNull()).groupBy(*g).agg(F.count(F.lit(1)).alias("n"), F.min(value).alias("low"), F.max(value).alias("high"), ((F.count(F.lit(1)) >= 2) & same).alias("agrees"))


def consensus_over_settings(rho: DataFrame, g: Keys, value: str, least: int) -> DataFrame:
    """n, mean, median, sd, min, max, positive fraction, sign consistency; groups with `least` values."""
    pos = F.avg((F.col(value) > 0).cast("double"))
    d = rho.filter(F.col(value).isNotNull()).groupBy(*g).agg(
        F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.expr(f"percentile({value}, 0.5)").alias("median"), F.stddev(value).alias("sd"), F.min(value).alias("low"), F.max(value).alias("high"), pos.alias("positive"),
        F.greatest(pos, 1 - pos).alias("consistency"),
    )
    return d.filter(F.col("n") >= least)


def pairwise_delta(a: DataFrame, b: DataFrame, keys: Keys, setting: Keys, value: str) -> DataFrame:
    """Over settings: mean, median, sd of the difference, positive fractions of both sides."""
    d = a.select(*keys, *setting, F.col(value).alias("_a")).join(b.select(*keys, *setting, F.col(value).alias("_b")), [*keys, *setting]).withColumn("_d", F.col("_a") - F.col("_b"))
    pos = lambda c: F.avg((F.col(c) > 0).cast("double"))
    return d.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg("_d").alias("mean"), F.expr("percentile(_d, 0.5)").alias("median"), F.stddev("_d").alias("sd"), pos("_a").alias("positive_a"), pos("_b").alias("positive_b"))


def top_bottom_n(df: DataFrame, g: Keys, name: str, value: str, n: int, drop: str | None = None) -> DataFrame:
    """The n largest ('top') and n smallest ('bottom') of each group, names that match `drop` left out."""
    d = df if drop is None else df.filter(~F.col(name).rlike(drop))
    # one order and its limit at a time: Spark then keeps n rows a group in every task before the shuffle
    top, low = top_n(d, g, [F.desc(value), F.col(name)], n), top_n(d, g, [F.col(value), F.col(name)], n)
    return top.withColumn("side", F.lit("top")).unionByName(low.withColumn("side", F.lit("bottom"))).select(*df.columns, "side", "rank")


def early_late_contrast(df: DataFrame, g: Keys, phase: str, value: str, sign: str | None = None) -> DataFrame:
    """median early, median late, late - early, times the sign column if there is one."""
    d = df.groupBy(*g, *([sign] if sign else [])).pivot(phase, ["early", "late"]).agg(F.expr(f"percentile({value}, 0.5)"))
    return d.withColumn("contrast", (F.col("late") - F.col("early")) * (F.col(sign) if sign else F.lit(1.0)))


def growth_summary(df: DataFrame, g: Keys, value: str, shares=(0.01, 0.25, 0.5, 0.75, 0.99)) -> DataFrame:
    """n, mean, sd (population), negative and positive fraction, quantiles."""
    places = {f"p{round(100 * x):02d}": x for x in shares}
    d = df.groupBy(*g).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"), F.avg((F.col(value) < 0).cast("double")).alias("negative"), F.avg((F.col(value) > 0).cast("double")).alias("positive"))
    return attach(d, quantiles(df, g, value, places), g)


def growth_by_stage(df: DataFrame, stage: Keys, celltype: str, value: str) -> tuple[DataFrame, DataFrame]:
    """The rows with centred (value less its stage's mean) and z (over the stage's population deviation; 0 if flat), and
    by stage and cell type: n, mean, mean_centred, mean_z, negative (share of values below 0)."""
    moments = df.groupBy(*stage).agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_sd"))
    d = attach(df, moments, stage).withColumn("centred", F.col(value) - F.col("_m"))
    d = d.withColumn("z", F.when(F.col("_sd") > 0, F.col("centred") / F.col("_sd")).when(F.col("_sd").isNotNull(), F.lit(0.0) * F.col("centred"))).drop("_m", "_sd")
    per = d.groupBy(*stage, celltype).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.avg("centred").alias("mean_centred"), F.avg("z").alias("mean_z"), F.avg((F.col(value) < 0).cast("double")).alias("negative"))
    return d, per


def relative_growth(df: DataFrame, g: Keys, value: str, weight: str) -> DataFrame:
    """Adds relative (growth - weighted mean, over the weighted 0.95 quantile of its size, within +-1) and
    percentile ((average rank - 0.5) / n)."""
    from .mass import weighted_quantile

    mean = df.groupBy(*g).agg((F.sum(F.col(value) * F.col(weight)) / F.sum(weight)).alias("_m"))
    d = df.join(mean, list(g)).withColumn("_c", F.col(value) - F.col("_m")).withColumn("_size", F.abs(F.round("_c", 12)))
    d = d.join(weighted_quantile(d, g, "_size", weight, 0.95, "_q"), list(g))
    clipped = F.greatest(F.least(ratio(F.col("_c"), F.col("_q")), F.lit(1.0)), F.lit(-1.0))
    d = ranked(d, g, value, "_r", "_n")
    return d.withColumn("relative", clipped).withColumn("percentile", (F.col("_r") - 0.5) / F.col("_n")).drop("_m", "_c", "_size", "_q", "_r", "_n")


def growth_agreement(d: DataFrame, g: Keys, a: str, b: str, fraction: float = 0.2) -> DataFrame:
    """Spearman, mean absolute gap of percentiles, Jaccard of the top and of the bottom fraction."""
    d = ranked(ranked(d, g, a, "_a", "_na"), g, b, "_b", "_nb")
    d = d.withColumn("_a", (F.col("_a") - 0.5) / F.col("_na")).withColumn("_b", (F.col("_b") - 0.5) / F.col("_nb"))
    top = lambda c: F.col(c) >= 1 - fraction
    low = lambda c: F.col(c) <= fraction
    both = lambda f: ratio(F.sum((f("_a") & f("_b")).cast("int")), F.sum((f("_a") | f("_b")).cast("int")))
    return d.groupBy(*g).agg(pearson(F.col("_a"), F.col("_b")).alias("spearman"), F.avg(F.abs(F.col("_a") - F.col("_b"))).alias("gap"), both(top).alias("jaccard_top"), both(low).alias("jaccard_bottom"))


def auroc(df: DataFrame, g: Keys, score: str, label: str, weight: str | None = None, least: int = 1) -> DataFrame:
    """g, positives, negatives, auroc with ties as half; null unless both sides have `least` rows. Scores are
    counted by distinct value before they are ordered."""
    w = F.lit(1.0) if weight is None else F.col(weight)
    pos = F.col(label).cast("boolean")
    d = df.filter(F.col(score).isNotNull() & pos.isNotNull()).groupBy(*g, score).agg(F.sum(F.when(pos, w).otherwise(0.0)).alias("_p"), F.sum(F.when(~pos, w).otherwise(0.0)).alias("_n"), F.sum(pos.cast("long")).alias("_cp"), F.sum((~pos).cast("long")).alias("_cn"))
    d = running_totals(d, g, score, ["_n"])
    d = d.withColumn("_u", F.col("_p") * (F.col("_n_upto") - F.col("_n") / 2)).groupBy(*g).agg(F.sum("_cp").alias("positives"), F.sum("_cn").alias("negatives"), ratio(F.sum("_u"), F.sum("_p") * F.sum("_n")).alias("auroc"))
    return d.withColumn("auroc", F.when((F.col("positives") >= least) & (F.col("negatives") >= least), F.col("auroc")))


def average_precision(df: DataFrame, g: Keys, score: str, label: str) -> DataFrame:
    """Step-wise area under precision and recall; tied scores are one step."""
    pos = F.col(label).cast("boolean").cast("long")
    d = df.filter(F.col(score).isNotNull()).groupBy(*g, score).agg(F.sum(pos).alias("_p"), F.count(F.lit(1)).alias("_n"))
    d = running_totals(d, g, score, ["_p", "_n"])
    from_here = lambda c: F.col(f"{c}_all") - F.col(f"{c}_upto") + F.col(c)
    d = d.withColumn("_t", F.col("_p") * from_here("_p") / from_here("_n"))
    return d.groupBy(*g).agg(F.sum("_p").alias("positives"), ratio(F.sum("_t"), F.sum("_p")).alias("average_precision"))


def deseq_effects(counts: DataFrame, groups: DataFrame) -> DataFrame:
    """gene, log2fc, p, q of group 'b' against 'a': median-of-ratios size factors over genes positive in all
    samples, log2 with 0.5 added, Welch t, BH. counts: sample, gene, value, complete."""
    n = groups.agg(F.count(F.lit(1)).alias("_n"))
    logs = counts.filter("value > 0").groupBy("gene").agg(F.count(F.lit(1)).alias("_c"), F.avg(F.ln("value")).alias("_l"))
    usable = logs.crossJoin(F.broadcast(n)).filter("_c = _n").select("gene", "_l")  # one row
    apart = counts.join(usable, "gene").withColumn("_r", F.ln("value") - F.col("_l"))
    sf = settled(quantiles(settled(apart.select("sample", "_r")), ["sample"], "_r", {"_m": 0.5}).select("sample", F.exp("_m").alias("_sf")))
    d = counts.join(sf, "sample").join(groups, "sample").withColumn("_v", F.log2(F.col("value") / F.col("_sf") + 0.5))
    side = lambda s: F.when(F.col("group") == s, F.col("_v"))
    raw = lambda s: F.avg(F.when(F.col("group") == s, F.col("value") / F.col("_sf")))
    t = d.groupBy("gene").agg(*[f(side(s)).alias(f"_{n}{s}") for s in "ab" for n, f in (("m", F.avg), ("v", F.variance), ("n", F.count))], F.log2((raw("b") + 0.5) / (raw("a") + 0.5)).alias("log2fc"))
    ea, eb = F.col("_va") / F.col("_na"), F.col("_vb") / F.col("_nb")
    df_ = ratio((ea + eb) ** 2, ea**2 / (F.col("_na") - 1) + eb**2 / (F.col("_nb") - 1))
    t = t.withColumn("p", t_two_sided(ratio(F.col("_mb") - F.col("_ma"), F.sqrt(ea + eb)), df_)).select("gene", "log2fc", "p")
    return bh_fdr(settled(t), [], "p")


#: Rows of a part of a bootstrap, and replicates that are drawn together.
PART, REPLICATES = 4096, 64


def bootstrap_ci(df: DataFrame, g: Keys, value: str, key: str, repeats: int = 500, seed: int = 0, other: str | None = None, statistic: str = "mean", weight: str | None = None, label: str | None = None) -> DataFrame:
    """g, estimate, low, high (2.5 and 97.5 percent over replicates) of a statistic of `value`: "mean" (with other: of the
    difference), "ratio" of the sums of value and other (+0.5), or "auroc" of value for the boolean label. A replicate
    draws as many rows as the group has, with replacement and chances by weight (equal without); rows with a null, NaN
    or negative weight take no part. A replicate without both labels has no auroc.

    Rows are dealt by key to parts of some PART rows. How many of a replicate's draws fall into each part is one draw
    over the parts' weights; inside a part they are drawn again over its rows, which together are draws over the whole
    group. Parts send sums, or for auroc counts by distinct value, so no task holds a group."""
    if statistic not in ("mean", "ratio", "auroc") or (statistic == "auroc") != (label is not None):
        raise ValueError("statistic must be mean, ratio or auroc (with a label)")
    number = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
    y = number(other) if other else F.lit(0.0)
    if label is not None:
        y = F.col(label).cast("boolean").cast("double")
    d = df.select(*g, number(value).alias("_x"), y.alias("_y"), (number(weight) if weight else F.lit(1.0)).alias("_w"), F.xxhash64(F.col(key), F.lit(seed)).alias("_h"))
    d = d.dropna(subset=["_x", "_y", "_w"]).filter("_w >= 0")
    parts = d.groupBy(*g).agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("_parts"))
    d = settled(attach(d, parts, g).withColumn("_part", F.pmod("_h", F.col("_parts")).cast("int")).drop("_parts"))
    kinds = ", ".join(f"`{c}` {t}" for c, t in df.select(*g).dtypes)
    kinds = f"{kinds}, " if kinds else ""
    sizes = d.groupBy(*g, "_part").agg(F.count(F.lit(1)).alias("_n"), F.sum("_w").alias("_w"))
    sizes = sizes.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit((repeats - 1) // REPLICATES))))

    def generator(*what):
        return np.random.default_rng(zlib.crc32(repr([str(v) for v in what]).encode()))

    def split(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_part")
        block, w = int(pdf["_block"].iloc[0]), pdf["_w"].to_numpy(float)
        r = min(REPLICATES, repeats - block * REPLICATES)
        if w.sum() <= 0:
            return pdf.iloc[:0][[*g, "_part", "_block"]].assign(_counts=[])
        counts = generator("split", *(pdf[c].iloc[0] for c in g), block, seed).multinomial(int(pdf["_n"].sum()), w / w.sum(), size=r)
        return pdf[[*g, "_part", "_block"]].assign(_counts=list(counts.T.astype(np.int64)))

    counts = sizes.groupBy(*g, "_block").applyInPandas(split, f"{kinds}_part int, _block int, _counts array<long>")

    def draws(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        columns = [*g, "r", "v", "n", "sx", "sy"]
        if rows.empty or asked.empty:
            return pd.DataFrame({c: [] for c in columns})
        rows = rows.sort_values(["_h", "_x", "_y", "_w"])
        x, y, w = (rows[c].to_numpy(float) for c in ("_x", "_y", "_w"))
        of, value_of = np.unique(x, return_inverse=True)
        out = []
        for block, each in zip(asked["_block"], asked["_counts"], strict=True):
            rng = generator("draw", *(rows[c].iloc[0] for c in g), int(rows["_part"].iloc[0]), block, seed)
            for i, n in enumerate(each):
                if not n:
                    continue
                m = rng.multinomial(int(n), w / w.sum())
                r = int(block) * REPLICATES + i
                if label is None:
                    out.append((r, 0.0, float(n), float(m @ x), float(m @ y)))
                else:
                    pos, neg = (np.bincount(value_of, weights=m * k, minlength=len(of)) for k in (y, 1 - y))
                    out += [(r, float(of[j]), float(pos[j] + neg[j]), float(pos[j]), float(neg[j])) for j in np.flatnonzero(pos + neg)]
        pdf = pd.DataFrame(out, columns=columns[len(g) :])
        for i, c in enumerate(g):
            pdf.insert(i, c, rows[c].iloc[0])
        return pdf

    key_ = [*g, "_part"]
    left = d.select(*[F.col(c).alias(f"_l{i}") for i, c in enumerate(key_)], *d.columns).groupBy(*[f"_l{i}" for i in range(len(key_))])
    s = left.cogroup(counts.groupBy(*key_)).applyInPandas(draws, f"{kinds}r int, v double, n double, sx double, sy double")
    sums = [F.sum(c).alias(c) for c in ("n", "sx", "sy")]
    if label is None:
        stat = (F.col("sx") + 0.5) / (F.col("sy") + 0.5) if statistic == "ratio" else ratio(F.col("sx") - F.col("sy"), F.col("n"))
        s = s.groupBy(*g, "r").agg(*sums).withColumn("_b", stat)
        point = d.groupBy(*g).agg(F.sum("_w").alias("n"), F.sum(F.col("_w") * F.col("_x")).alias("sx"), F.sum(F.col("_w") * F.col("_y")).alias("sy")).select(*g, stat.alias("estimate"))
    else:
        s = running_totals(settled(s.groupBy(*g, "r", "v").agg(*sums)), [*g, "r"], "v", ["sy"]).withColumn("_u", F.col("sx") * (F.col("sy_upto") - F.col("sy") / 2))
        s = s.groupBy(*g, "r").agg(ratio(F.sum("_u"), F.sum("sx") * F.sum("sy")).alias("_b"))
        point = auroc(d.withColumn("_y", F.col("_y") > 0), g, "_x", "_y", "_w").select(*g, F.col("auroc").alias("estimate"))
    spread = s.groupBy(*g).agg(F.expr("percentile(_b, 0.025)").alias("low"), F.expr("percentile(_b, 0.975)").alias("high"))  # a value a replicate
    return attach(point, spread, g)


def odds_ratio_ci(df: DataFrame, g: Keys, a: str, b: str) -> DataFrame:
    """Odds ratio of two booleans with 0.5 added to each cell, and its 95 percent interval."""
    x, y = F.col(a).cast("boolean"), F.col(b).cast("boolean")
    n = lambda c: F.sum(c.cast("long")) + 0.5
    d = df.groupBy(*g).agg(n(x & y).alias("_a"), n(x & ~y).alias("_b"), n(~x & y).alias("_c"), n(~x & ~y).alias("_d"))
    log = F.ln(F.col("_a") * F.col("_d") / (F.col("_b") * F.col("_c")))
    half = 1.96 * F.sqrt(1 / F.col("_a") + 1 / F.col("_b") + 1 / F.col("_c") + 1 / F.col("_d"))
    return d.select(*g, F.exp(log).alias("odds_ratio"), F.exp(log - half).alias("low"), F.exp(log + half).alias("high"))


def calibrate_logit(train: DataFrame, score: DataFrame, x: str, label: str) -> DataFrame:
    """Adds p: a class-balanced logistic fit of a 0/1 label on one contrast, L2 with C = 1, applied to
    `score`. The fit is pyspark.ml's, distributed over the training rows."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    w = Window.partitionBy(label)
    every = Window.partitionBy(F.lit(0))
    counts = train.filter(F.col(x).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    counts = counts.withColumn("_w", F.sum("_n").over(every) / (2 * F.sum("_n").over(w))).withColumn("_t", F.sum("_n").over(every))  # a row a class
    t = VectorAssembler(inputCols=[x], outputCol="_x").transform(train.filter(F.col(x).isNotNull()).join(counts.select(label, "_w", "_t"), label).withColumn("_y", F.col(label).cast("double")))
    n = counts.agg(F.sum("_n")).first()[0] or 1
    model = LogisticRegression(featuresCol="_x", labelCol="_y", weightCol="_w", regParam=1.0 / n, standardization=False, maxIter=100, tol=1e-10).fit(t)
    b, c = float(model.coefficients[0]), float(model.intercept)
    return score.withColumn("p", 1 / (1 + F.exp(-(F.col(x) * b + c))))


def weighted_binary_profile(coefficients: DataFrame, open_: DataFrame, g: Keys) -> DataFrame:
    """g, feature, share: the share of weight (g, ref_id, c) whose cell has the peak open."""
    total = coefficients.groupBy(*g).agg(F.sum("c").alias("_t"))
    d = coefficients.join(open_.select("ref_id", "feature").distinct(), "ref_id").groupBy(*g, "feature").agg(F.sum("c").alias("_s"))
    return (d.join(total, list(g)) if g else d.crossJoin(total)).select(*g, "feature", (F.col("_s") / F.col("_t")).alias("share"))


def observed_binary_profile(cells: DataFrame, open_: DataFrame, g: Keys) -> DataFrame:
    """g, feature, share of the group's cells (g, ref_id) with the peak open."""
    return weighted_binary_profile(cells.select(*g, "ref_id", F.lit(1.0).alias("c")), open_, g)


def contrast_metrics(profiles: DataFrame, g: Keys) -> DataFrame:
    """From rows of g, feature, predicted, observed, positive (boolean): AUROC of the predicted contrast,
    margin, margin error, Spearman and RMSE to the observed."""
    a = auroc(profiles, g, "predicted", "positive").select(*g, "auroc")
    side = lambda c, s: F.avg(F.when(F.col("positive") == s, F.col(c)))
    m = ranked(ranked(profiles, g, "predicted", "_rp"), g, "observed", "_ro").groupBy(*g).agg(
        (side("predicted", True) - side("predicted", False)).alias("margin"), (side("observed", True) - side("observed", False)).alias("_o"),
        pearson(F.col("_rp"), F.col("_ro")).alias("spearman"), F.sqrt(F.avg((F.col("predicted") - F.col("observed")) ** 2)).alias("rmse"),
    )
    return a.join(m, list(g)).withColumn("margin_error", F.abs(F.col("margin") - F.col("_o"))).drop("_o")


def background_metrics(profiles: DataFrame, g: Keys) -> DataFrame:
    """From rows of g, feature, correct, opposite, observed_correct, observed_opposite and positive (false: the
    matched background): AUROC of the correct branch, enrichment (mean of positives less that of the background)
    of both branches, their difference, that of the observed, and the error between the two."""
    lift = lambda c: F.avg(F.when(F.col("positive"), F.col(c))) - F.avg(F.when(~F.col("positive"), F.col(c)))
    m = profiles.groupBy(*g).agg(lift("correct").alias("enrichment"), lift("opposite").alias("opposite_enrichment"), (lift("observed_correct") - lift("observed_opposite")).alias("observed_specificity"))
    m = m.withColumn("specificity", F.col("enrichment") - F.col("opposite_enrichment")).withColumn("specificity_error", F.abs(F.col("specificity") - F.col("observed_specificity")))
    return auroc(profiles, g, "correct", "positive").select(*g, "auroc").join(m, list(g))


def call_peak_sets(df: DataFrame, peak: str, replicate: str, value: str, q: float) -> DataFrame:
    """peak, support (the least rank fraction over replicates), in_set (support at or above q)."""
    d = ranked(df, [replicate], value, "_r", "_n").withColumn("_r", F.col("_r") / F.col("_n")).groupBy(peak).agg(F.min("_r").alias("support"))
    return d.select(peak, "support", (F.col("support") >= q).alias("in_set"))


def call_difference_sets(df: DataFrame, peak: str, a: str, b: str, q: float) -> DataFrame:
    """peak, difference (a - b of two mean ranks), in_a (at or above the q-quantile of the difference, and a at least
    0.5) and in_b (at or below its 1 - q quantile, and b at least 0.5)."""
    d = df.select(peak, F.col(a).alias("_a"), F.col(b).alias("_b"), (F.col(a) - F.col(b)).alias("difference"))
    d = d.crossJoin(F.broadcast(quantiles(d, [], "difference", {"_high": q, "_low": 1 - q})))  # one row
    high, low = F.col("difference") >= F.col("_high"), F.col("difference") <= F.col("_low")
    return d.select(peak, "difference", (high & (F.col("_a") >= 0.5)).alias("in_a"), (low & (F.col("_b") >= 0.5)).alias("in_b"))


def active_and_neutral_sets(difference: DataFrame, bound_a: DataFrame, bound_b: DataFrame, peak: str) -> DataFrame:
    """peak, active_a (bound by a and in the difference set of a), active_b, neutral (in none of the four sets). difference:
    as call_difference_sets gives it; bound_a, bound_b: as call_peak_sets."""
    side = lambda d, n: d.select(peak, F.col("in_set").alias(n))
    d = difference.join(side(bound_a, "_a"), peak).join(side(bound_b, "_b"), peak)
    return d.select(peak, (F.col("_a") & F.col("in_a")).alias("active_a"), (F.col("_b") & F.col("in_b")).alias("active_b"), (~(F.col("in_a") | F.col("in_b") | F.col("_a") | F.col("_b"))).alias("neutral"))


@F.pandas_udf(DoubleType())
def _inner_products(a: pd.Series, b: pd.Series) -> pd.Series:
    """Of two arrays; NaN where one holds a null."""
    return pd.Series([np.asarray(x, float) @ np.asarray(y, float) for x, y in zip(a, b, strict=True)], dtype=float)


#: Positions of units that one array of link_correlation holds.
BLOCK = 4096


def link_correlation(a: DataFrame, b: DataFrame, pairs: DataFrame, permutations: int = 20, seed: int = 0, least_r: float = 0.1, most_q: float = 0.1, most_null_q: float = 0.1) -> DataFrame:
    """a_id, b_id, n, r, p, q, null_mean, null_sd, z, normal_p, null_q, exceed, selected: Pearson r of pairs over
    aggregates against permuted aggregates. a, b: id, unit, value, a row for every id and unit; null r for a flat side.
    null_sd has one degree less than permutations, 1e-12 at least; exceed is (1 + nulls of that size) / (1 +
    permutations); q and null_q are BH of p and of normal_p. selected: r >= least_r, q <= most_q, null_q <= most_null_q.

    A permutation is the order of the units by a hash of unit, seed and its number, the same for every pair; its
    positions are numbered in cells. Values are standardised by id, laid in arrays of BLOCK positions, and the
    products of a pair's arrays are summed, so neither all units nor a whole vector meets in one row."""
    every = a.select("unit").distinct().withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(permutations))))
    token = F.substring(F.md5(F.concat_ws("/", F.col("unit").cast("string"), F.lit(str(seed)), F.col("i").cast("string"))), 1, 15)
    every = every.withColumn("h", F.conv(token, 16, 10).cast("long")).withColumn("cell", F.shiftright("h", 48))
    earlier = Window.partitionBy("i").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)  # 4,096 cells
    cells = every.groupBy("i", "cell").agg(F.count(F.lit(1)).alias("_c")).select("i", "cell", F.coalesce(F.sum("_c").over(earlier), F.lit(0)).alias("before"))
    k = F.col("before") + F.row_number().over(Window.partitionBy("i", "cell").orderBy("h", "unit")) - 1
    place = every.join(cells, ["i", "cell"]).select("i", "unit", k.alias("k"))

    def packed(df: DataFrame, order: DataFrame, by: Keys, name: str) -> DataFrame:
        d = standardized(df.withColumn("value", F.col("value").cast("double")), ["id"], "value", "_z", None, 1e-12).join(order, "unit")
        d = d.groupBy("id", *by, F.floor(F.col("k") / BLOCK).alias("block")).agg(F.sort_array(F.collect_list(F.struct("k", "_z")))["_z"].alias(f"_{name}"))
        return d.withColumnRenamed("id", f"{name}_id")

    va = packed(a, place.filter("i = 0").drop("i"), [], "a")
    vb = packed(b, place, ["i"], "b")
    product = _inner_products(F.col("_a"), F.col("_b"))
    d = pairs.select("a_id", "b_id").distinct().join(va, "a_id").join(vb, ["b_id", "block"])
    d = d.groupBy("a_id", "b_id", "i").agg(F.sum(F.size("_a")).alias("n"), known(F.sum(product) / F.sum(F.size("_a"))).alias("_r"))
    # one array of permutations + 1 values, so that all who read the pairs below share one exchange
    out = d.groupBy("a_id", "b_id").agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("i", "_r")))["_r"].alias("_v"))
    out = out.withColumn("r", F.col("_v")[0]).withColumn("_null", F.slice("_v", 2, max(permutations, 1)))
    mean = lambda c: F.aggregate(c, F.lit(0.0), lambda s, v: s + v) / F.size(c)
    out = out.withColumn("null_mean", mean("_null")).withColumn("null_sd", F.sqrt(F.greatest(mean(F.transform("_null", lambda v: (v - F.col("null_mean")) ** 2)) * (permutations / max(permutations - 1, 1)), F.lit(1e-24))))
    over = F.size(F.filter("_null", lambda v: F.abs(v) >= F.abs(F.col("r"))))
    out = out.withColumn("exceed", F.when(F.col("r").isNotNull(), (1 + over) / F.lit(permutations + 1.0))).drop("_null", "_v")
    t = F.col("r") * F.sqrt((F.col("n") - 2) / F.greatest(1 - F.col("r") ** 2, F.lit(1e-300)))
    out = out.withColumn("p", t_two_sided(t, (F.col("n") - 2).cast("double")))
    out = out.withColumn("z", ratio(F.col("r") - F.col("null_mean"), F.col("null_sd"))).withColumn("normal_p", normal_two_sided(F.col("z")))
    out = bh_fdr(bh_fdr(out, [], "p"), [], "normal_p", "null_q")
    chosen = (F.col("r") >= least_r) & (F.col("q") <= most_q) & (F.col("null_q") <= most_null_q)
    return out.withColumn("selected", F.coalesce(chosen, F.lit(False)))


def standardized_delta(values: DataFrame, stats: DataFrame, feature: str, group: str, a: str, b: str) -> DataFrame:
    """feature, delta: mean z in group b minus group a, by a frozen centre and sd."""
    z = F.when(F.col("sd") > 0, (F.col("value") - F.col("centre")) / F.col("sd")).otherwise(0.0)
    side = lambda s: F.avg(F.when(F.col(group) == s, F.col("_z")))
    return values.join(stats, feature).withColumn("_z", z).groupBy(feature).agg((side(b) - side(a)).alias("delta"))


def cohort_mean(values: DataFrame, g: Keys, membership: str, mass: str) -> DataFrame:
    """Mean weighted by membership x mass, with that weight's total and effective number."""
    w = F.col(membership) * F.col(mass)
    return values.groupBy(*g).agg(ratio(F.sum(w * F.col("value")), F.sum(w)).alias("mean"), F.sum(w).alias("mass"), ratio(F.sum(w) ** 2, F.sum(w**2)).alias("ess"))


def active_links(links: DataFrame, da: str, db: str, effect: float, least: int) -> DataFrame:
    """Selected links with equal signs and both effects large; if fewer than `least`, those of equal sign."""
    same = (F.signum(da) == F.signum(db)) & (F.signum(da) != 0)
    large = same & (F.abs(da) >= effect) & (F.abs(db) >= effect)
    d = links.filter("selected").withColumn("_l", large).withColumn("_s", same)
    n = d.agg(F.sum(F.col("_l").cast("long")).alias("_n"))
    return d.crossJoin(F.broadcast(n)).filter(F.when(F.col("_n") >= least, F.col("_l")).otherwise(F.col("_s"))).drop("_l", "_s", "_n")  # one row


def edge_recovery(d: DataFrame, g: Keys, a: str = "gene", b: str = "peak") -> DataFrame:
    """From links (a, b) with pred_a, true_a (changes of a, one for all its links) and pred_b, true_b: cosine_a over the
    distinct a and cosine_b over the distinct b; over links the joint cosine, the share on which both changes have the
    true sign (a product above 0), predicted_alignment and true_alignment (cosines of the changes of a with those of b),
    their gap, and the mean absolute error; recovery is the mean of (cosine_a + 1) / 2, (cosine_b + 1) / 2 and the
    sign accuracy, nulls left out. A cosine is null where the norms' product is 1e-12 or less."""
    c = {k: F.col(k).cast("double") for k in ("pred_a", "pred_b", "true_a", "true_b")}

    def cos(*pairs: tuple[Column, Column]) -> Column:
        dot, p, t = (sum(F.sum(v) for v in vs) for vs in zip(*[(x * y, x * x, y * y) for x, y in pairs], strict=True))
        return F.when(F.sqrt(p) * F.sqrt(t) > 1e-12, dot / (F.sqrt(p) * F.sqrt(t)))

    def side(key: str, s: str) -> DataFrame:
        one = d.groupBy(*g, key).agg(F.first(f"pred_{s}").cast("double").alias("_p"), F.first(f"true_{s}").cast("double").alias("_t"))
        return one.groupBy(*g).agg(cos((F.col("_p"), F.col("_t"))).alias(f"cosine_{s}"))

    sign = ((c["pred_a"] * c["true_a"] > 0) & (c["pred_b"] * c["true_b"] > 0)).cast("double")
    links = d.groupBy(*g).agg(
        cos((c["pred_a"], c["true_a"]), (c["pred_b"], c["true_b"])).alias("cosine"), F.avg(sign).alias("sign_accuracy"),
        cos((c["pred_a"], c["pred_b"])).alias("predicted_alignment"), cos((c["true_a"], c["true_b"])).alias("true_alignment"),
        F.avg((F.abs(c["pred_a"] - c["true_a"]) + F.abs(c["pred_b"] - c["true_b"])) / 2).alias("mae"),
    )
    out = attach(attach(links, side(a, "a"), g), side(b, "b"), g)
    parts = F.filter(F.array((F.col("cosine_a") + 1) / 2, (F.col("cosine_b") + 1) / 2, F.col("sign_accuracy")), lambda v: v.isNotNull())
    mean = F.aggregate(parts, F.lit(0.0), lambda s, v: s + v) / F.size(parts)
    return out.withColumn("alignment_error", F.abs(F.col("predicted_alignment") - F.col("true_alignment"))).withColumn("recovery", F.when(F.size(parts) > 0, mean))


def paired_mse(predicted: DataFrame, observed: DataFrame, key: Keys, time: str, g: Keys, vector: str = "x", sd: Column | None = None) -> DataFrame:
    """Mean squared difference of paired vectors (over sd, if given): per row, per time, equal-time mean."""
    d = predicted.select(*g, *key, time, F.col(vector).alias("_p")).join(observed.select(*key, time, F.col(vector).alias("_o")), [*key, time])
    scale = F.lit(1.0) if sd is None else sd
    e = F.aggregate(F.zip_with("_p", "_o", lambda p, o: (p - o) * (p - o)), F.lit(0.0), lambda s, v: s + v) / F.size("_p") / scale**2
    return d.withColumn("_e", e).groupBy(*g, time).agg(F.avg("_e").alias("_t")).groupBy(*g).agg(F.avg("_t").alias("mse"), F.count(F.lit(1)).alias("times"))
