"""Time-curve scoring."""

from __future__ import annotations

import functools

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from ..functions.columns import Keys, ratio, top_n
from ..functions.lineage import settled
from ..functions.tails import normal_above
from .features import average_precision, bh_fdr, odds_ratio_ci
from .ordering import attach, numbered, quantiles, running_totals, standardized


@functools.cache
def savgol(n: int, window: int, order: int, derivative: int) -> np.ndarray:
    """The n x n matrix of a polynomial filter on an even grid of step 1; edges by the fit of the end windows."""
    window = min(window, n if n % 2 else n - 1)
    order = min(order, window - 1)
    half = window // 2
    out = np.zeros((n, n))
    for i in range(n):
        start = min(max(i - half, 0), n - window)
        t = np.arange(start, start + window) - i
        fit = np.linalg.pinv(np.vander(t, order + 1, increasing=True))
        out[i, start : start + window] = fit[derivative] * math.factorial(derivative)
    return out


def packed(curves: DataFrame, g: Keys, time: str = "t", value: str = "value") -> DataFrame:
    """g, t, v: arrays in order of time."""
    d = curves.groupBy(*g).agg(F.sort_array(F.collect_list(F.struct(F.col(time).cast("double").alias("t"), F.col(value).cast("double").alias("v")))).alias("_c"))
    return d.select(*g, F.col("_c.t").alias("t"), F.col("_c.v").alias("v"))


def smooth_derivative(curves: DataFrame, g: Keys, points: int = 41, window: int = 11, order: int = 3) -> DataFrame:
    """g, d: first derivative of log1p of the curve on `points` even points between its ends."""

    @F.pandas_udf(ArrayType(DoubleType()))
    def derive(t: pd.Series, v: pd.Series) -> pd.Series:
        m = savgol(points, window, order, 1)

        def one(a, b):
            grid = np.linspace(a[0], a[-1], points)
            step = (a[-1] - a[0]) / (points - 1) or 1.0
            return (m @ np.interp(grid, a, np.log1p(np.maximum(b, 0)))) / step

        return pd.Series([one(a, b) for a, b in zip(t, v)])

    return packed(curves, g).select(*g, derive("t", "v").alias("d"))


def lagged_cosine(a: DataFrame, b: DataFrame, pairs: DataFrame, most: int = 5) -> DataFrame:
    """a_id, b_id, lag, score: over lags -most..most the greatest cosine of a(i + lag) and b(i), so that a positive lag
    says that b leads; ties to the smaller |lag|, then the lower lag. a, b: id, d (array); pairs: a_id, b_id. Column
    expressions only."""
    d = pairs.join(a.select(F.col("id").alias("a_id"), F.col("d").alias("_a")), "a_id").join(b.select(F.col("id").alias("b_id"), F.col("d").alias("_b")), "b_id")
    d = d.withColumn("lag", F.explode(F.sequence(F.lit(-most), F.lit(most))))
    size = F.size("_a") - F.abs("lag")
    x = F.slice("_a", F.when(F.col("lag") > 0, 1 + F.col("lag")).otherwise(1), size)
    y = F.slice("_b", F.when(F.col("lag") < 0, 1 - F.col("lag")).otherwise(1), size)
    d = d.filter(size > 1).withColumn("_x", x).withColumn("_y", y)
    total = lambda p, q: F.aggregate(F.zip_with(p, q, lambda m, n: m * n), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(total("_x", "_x")) * F.sqrt(total("_y", "_y"))
    d = d.withColumn("score", F.when(norm > 1e-12, total("_x", "_y") / norm))
    return top_n(d.filter("score is not null"), ["a_id", "b_id"], [F.desc(F.round("score", 9)), F.abs("lag"), F.col("lag")], 1).select("a_id", "b_id", "lag", "score")


#: Curves of either side that one block holds.
CURVES = 512


def _derivatives(curves: DataFrame, windows: tuple[int, ...], shifts: tuple[int, ...], order: int) -> DataFrame:
    """id, window, shift, d (derivative by uneven time of the filtered log1p curve, shifted circularly), range (of the
    log1p curve), t: once for each curve, window and shift, whatever the number of its pairs."""
    kind = dict(curves.dtypes)["id"]

    def run(batches):
        for pdf in batches:
            rows = []
            for i, t, v in zip(pdf["id"], pdf["t"], pdf["v"], strict=True):
                t, v = np.asarray(t, float), np.log1p(np.asarray(v, float))
                span = float(np.ptp(v)) if len(v) else None
                for w in windows:
                    for s in shifts:
                        d = np.gradient(savgol(len(t), w, order, 0) @ np.roll(v, s), t) if len(t) >= max(w, 3) else np.full(len(t), np.nan)
                        rows.append((i, w, s, d, span, t))
            yield pd.DataFrame(rows, columns=["id", "window", "shift", "d", "range", "t"])

    return curves.select("id", "t", "v").mapInPandas(run, f"id {kind}, window int, shift int, d array<double>, range double, t array<double>")


def _best_lags(x: np.ndarray, y: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Row by row of two matrices of derivatives: cosines at the lags -most..most, NaN where there is none, and the
    lags. A positive lag pairs y(i) with x(i + lag)."""
    n = x.shape[1]
    lags = [k for k in range(-most, most + 1) if abs(k) < n]
    out = np.full((len(x), len(lags)), np.nan)
    for c, k in enumerate(lags):
        p, q = (x[:, k:], y[:, : n - k]) if k >= 0 else (x[:, :k], y[:, -k:])
        norm = np.sqrt((p * p).sum(1)) * np.sqrt((q * q).sum(1))
        good = np.isfinite(norm) & (norm > 1e-12)
        out[good, c] = (p[good] * q[good]).sum(1) / norm[good]
    return out, np.array(lags)


def lag_score(pairs: DataFrame, curves: DataFrame, windows: tuple[int, ...] = (5,), shifts: tuple[int, ...] = (), most: int = 5, order: int = 2, block: int = CURVES) -> DataFrame:
    """a_id, b_id, window, score, lag, lag_time, second, margin, range_a, range_b, circular (scores with the second curve
    shifted by each of `shifts`, in their order), null_median, null_max (of the scores in circular).

    curves: id, t, v (arrays, of equal times). Both are log1p, filtered by a polynomial of `order` over each window, and
    differentiated over uneven time. score is the greatest cosine over lags -most..most, of equal ones the lowest lag;
    a positive lag says that b leads. lag_time is the median of t(i + lag) - t(i), with the sign of the lag. Null where
    no lag has a cosine (a flat or missing curve, or one with NaN); times fewer than the window give null.

    Derivatives are made once a curve. Curves are dealt to blocks by hash, pairs to pairs of blocks, and a task scores
    the pairs of two blocks by matrix rows; only blocks that have pairs are sent."""
    kinds = dict(pairs.dtypes)
    n = curves.groupBy().agg(F.greatest(F.ceil(F.count(F.lit(1)) / block), F.lit(1)).cast("int").alias("_blocks"))  # one row
    dealt = lambda d, key, name: d.withColumn(name, F.pmod(F.xxhash64(key), F.col("_blocks")).cast("int"))
    p = dealt(dealt(pairs.select("a_id", "b_id").crossJoin(F.broadcast(n)), "a_id", "_i"), "b_id", "_j").drop("_blocks")
    used = p.select("_i", "_j").distinct()
    every = tuple(dict.fromkeys((0, *shifts)))
    d = dealt(_derivatives(curves, windows, every, order).crossJoin(F.broadcast(n)), "id", "_k").drop("_blocks")
    left = d.filter("shift = 0").join(used.withColumnRenamed("_i", "_k"), "_k").withColumnRenamed("_k", "_i").withColumn("side", F.lit(0))
    right = d.join(used.withColumnRenamed("_j", "_k"), "_k").withColumnRenamed("_k", "_j").withColumn("side", F.lit(1))
    both = left.unionByName(right).withColumnsRenamed({"_i": "_i2", "_j": "_j2"})

    def score(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        rows = []
        at = {(s, i, w, k): r for r, (s, i, w, k) in enumerate(zip(held["side"], held["id"], held["window"], held["shift"], strict=True))}
        by_size: dict[int, list[tuple[int, int]]] = {}
        for q, (a, b) in enumerate(zip(asked["a_id"], asked["b_id"], strict=True)):
            for w in windows:
                x, y = at.get((0, a, w, 0)), at.get((1, b, w, 0))
                if x is not None and y is not None and len(held["d"][x]) == len(held["d"][y]):
                    by_size.setdefault(len(held["d"][x]), []).append((q, w))
                else:  # a curve is missing
                    rows.append((a, b, w, *[None] * 7, [None] * len(shifts), None, None))
        for size, found in by_size.items():
            ids = [(asked["a_id"][q], asked["b_id"][q], w) for q, w in found]
            x = np.stack([held["d"][at[0, a, w, 0]] for a, _, w in ids]) if size else np.zeros((len(ids), 0))
            nulls = []
            for k in shifts:
                y = np.stack([held["d"][at[1, b, w, k]] for _, b, w in ids]) if size else x
                c = _best_lags(x, y, most)[0]
                nulls.append(np.where(np.isfinite(c).any(1), np.nanmax(np.where(np.isfinite(c), c, -np.inf), axis=1, initial=-np.inf), np.nan))
            y = np.stack([held["d"][at[1, b, w, 0]] for _, b, w in ids]) if size else x
            c, lags = _best_lags(x, y, most)
            c = np.round(c, 12)
            for r, (a, b, w) in enumerate(ids):
                t = np.asarray(held["t"][at[0, a, w, 0]], float)
                order_ = sorted((j for j in range(len(lags)) if np.isfinite(c[r, j])), key=lambda j: (-c[r, j], lags[j]))
                out = [None] * 5
                if order_:
                    lag = int(lags[order_[0]])
                    second = float(c[r, order_[1]]) if len(order_) > 1 else None
                    time = 0.0 if not lag else float(np.sign(lag) * np.median(t[abs(lag) :] - t[: -abs(lag)]))
                    out = [float(c[r, order_[0]]), lag, time, second, None if second is None else float(c[r, order_[0]]) - second]
                circular = [float(v[r]) if np.isfinite(v[r]) else None for v in nulls]
                known_ = [v for v in circular if v is not None]
                rows.append((a, b, w, *out, held["range"][at[0, a, w, 0]], held["range"][at[1, b, w, 0]], circular, float(np.median(known_)) if known_ else None, max(known_, default=None)))
        return pd.DataFrame(rows, columns=["a_id", "b_id", "window", "score", "lag", "lag_time", "second", "margin", "range_a", "range_b", "circular", "null_median", "null_max"]).astype({"lag": "Int32"})

    kind = f"a_id {kinds['a_id']}, b_id {kinds['b_id']}, window int, score double, lag int, lag_time double, second double, margin double, range_a double, range_b double, circular array<double>, null_median double, null_max double"
    return p.groupBy("_i", "_j").cogroup(both.groupBy("_i2", "_j2")).applyInPandas(score, kind)


def calibrate_against_nulls(true: DataFrame, null: DataFrame, keys: Keys, g: Keys, value: str = "score") -> DataFrame:
    """Null n, median, max, empirical p (1 + #>=) / (1 + n), percentile (share of nulls below), difference to the
    median, BH q and min-rank within g, top decile (rank at most ceil(0.1 rows of g), one at least). A score that is
    null or NaN, or has no null scores, gets no p, percentile and q; a null score has no rank and is in no decile."""
    seen = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
    true = settled(true.withColumn(value, seen(value)))
    pairs = settled(null.select(*keys, seen(value).alias("_v")).filter("_v is not null").join(true.select(*keys, F.col(value).alias("_t")), list(keys)))
    d = pairs.groupBy(*keys).agg(F.count("_v").alias("null_n"), F.max("_v").alias("null_max"), F.sum((F.col("_v") >= F.col("_t")).cast("long")).alias("_ge"))
    d = d.join(quantiles(pairs, keys, "_v", {"null_median": 0.5}), list(keys))
    can = F.col(value).isNotNull() & (F.col("null_n") > 0)
    d = true.join(d, list(keys), "left").withColumn("null_n", F.coalesce("null_n", F.lit(0)))
    d = d.withColumn("p", F.when(can, (1 + F.col("_ge")) / (1 + F.col("null_n")))).withColumn("percentile", F.when(can, 1 - F.col("_ge") / F.col("null_n")))
    d = bh_fdr(settled(d.withColumn("difference", F.col(value) - F.col("null_median")).drop("_ge")), g, "p")
    t = running_totals(true.filter(F.col(value).isNotNull()).groupBy(*g, value).agg(F.count(F.lit(1)).alias("_n")), g, value, ["_n"])
    t = t.select(*g, value, (F.col("_n_all") - F.col("_n_upto") + 1).cast("int").alias("rank"))
    rows = true.groupBy(*g).agg(F.greatest(F.ceil(0.1 * F.count(F.lit(1))), F.lit(1)).alias("_best"))
    d = attach(attach(d, t, [*g, value]), rows, g)
    return d.withColumn("top_decile", F.coalesce(F.col("rank") <= F.col("_best"), F.lit(False))).drop("_best")


def gene_level_winners(scores: DataFrame, null: DataFrame, gene: str, peak: str, rank: str, value: str = "score", model: Keys = (), circular: Keys = ()) -> DataFrame:
    """The best peak of each gene of a model, against the gene's best score within every null rank: p, percentile, q and
    rank within the model. Columns `circular` (scores under shifts) give the gene's greatest of each, and
    circular_median and circular_max over them."""
    g = [*model, gene]
    best = top_n(scores.drop(*circular), g, [F.desc_nulls_last(F.round(value, 9)), F.col(peak)], 1, "_n").drop("_n")
    if circular:
        most = scores.groupBy(*g).agg(*[F.max(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))).alias(c) for c in circular])
        held = F.array_sort(F.filter(F.array(*circular), lambda v: v.isNotNull()))
        n = F.size(held)
        middle = (F.get(held, ((n - 1) / 2).cast("int")) + F.get(held, (n / 2).cast("int"))) / 2
        best = best.join(most.withColumns({"circular_median": F.when(n > 0, middle), "circular_max": F.array_max(held)}), g)
    maxima = null.groupBy(*g, rank).agg(F.max(value).alias(value))
    return calibrate_against_nulls(best, maxima, g, list(model), value)


def stability_summary(ranked: DataFrame, alternate: DataFrame, lines: DataFrame, keys: Keys) -> DataFrame:
    """Adds the rank and score under the other smoothing, and over lines n, median score, positive-lag share."""
    alt = alternate.select(*keys, F.col("rank").alias("alternate_rank"), F.col("score").alias("alternate_score"))
    s = lines.groupBy(*keys).agg(F.count(F.lit(1)).alias("lines"), F.expr("percentile(score, 0.5)").alias("line_median"), F.avg((F.col("lag") > 0).cast("double")).alias("positive_lag_share"))
    return ranked.join(alt, list(keys), "left").join(s, list(keys), "left")


def pair_shuffle_test(scores: DataFrame, observed: DataFrame, permutations: int = 10_000, seed: int = 0, keep=(0.5, 0.8)) -> DataFrame:
    """One row: n and m (observed and mismatched pairs with a score), their medians, auroc and the one-sided p of the
    rank sum, p of the observed median under random re-pairing of a with b, median and quantiles of the permuted
    medians, shares of observed and of mismatched scores above each of `keep`, and how many observed pairs have a q
    (see pair_significance) below 0.05 and 0.1. scores: a_id, b_id, score for all pairs of the (few) observed ids;
    observed: a_id, b_id."""
    o = observed.select("a_id", "b_id").distinct().withColumn("_obs", F.lit(True))
    scores = settled(scores)
    d = scores.filter(F.col("score").isNotNull()).join(o, ["a_id", "b_id"], "left").withColumn("_obs", F.coalesce("_obs", F.lit(False)))
    above = [F.avg(F.when(side, (F.col("score") > k).cast("double"))).alias(f"{name}_above_{round(100 * k)}") for k in keep for name, side in (("observed", F.col("_obs")), ("mismatched", ~F.col("_obs")))]
    medians = quantiles(d, ["_obs"], "score", {"m": 0.5}).agg(F.max(F.when(F.col("_obs"), F.col("m"))).alias("median"), F.max(F.when(~F.col("_obs"), F.col("m"))).alias("mismatched_median"))
    tests = mann_whitney(scores, observed).select("n", "m", (F.col("u") / (F.col("n") * F.col("m"))).alias("auroc"), F.col("p").alias("rank_p"))
    low = pair_significance(scores, observed).agg(*[F.count_if(F.col("q") < q).alias(name) for name, q in (("q_below_05", 0.05), ("q_below_10", 0.1))])
    real = medians.crossJoin(d.agg(*above)).crossJoin(tests).crossJoin(low)  # one row each
    r = o.select("a_id", "b_id").withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(permutations - 1))))
    w = Window.partitionBy("r")
    a = r.select("r", "a_id", F.row_number().over(w.orderBy("a_id", "b_id")).alias("k"))
    b = r.select("r", "b_id", F.row_number().over(w.orderBy(F.xxhash64("r", "b_id", "a_id", F.lit(seed)), "b_id")).alias("k"))
    m = a.join(b, ["r", "k"]).join(scores, ["a_id", "b_id"]).groupBy("r").agg(F.expr("percentile(score, 0.5)").alias("m"))  # of the observed pairs
    places = quantiles(m, [], "m", {"null_median": 0.5, "null_q025": 0.025, "null_q975": 0.975})
    p = m.crossJoin(F.broadcast(medians.select("median"))).agg(((1 + F.sum((F.col("m") >= F.col("median")).cast("long"))) / (1 + F.count(F.lit(1)))).alias("p"))
    return real.crossJoin(p).crossJoin(places)  # one row each


def pair_significance(scores: DataFrame, observed: DataFrame) -> DataFrame:
    """a_id, b_id, score, p, q of the observed pairs: p = (1 + mismatched pairs that score as much) / (1 + their
    number), q by BH. Scores are counted by value and totalled in cells."""
    o = observed.select("a_id", "b_id").distinct().withColumn("_obs", F.lit(1))
    d = scores.join(o, ["a_id", "b_id"], "left").withColumn("_rest", F.when(F.col("_obs").isNull(), 1).otherwise(0))
    t = running_totals(d.filter("score is not null").groupBy("score").agg(F.sum("_rest").alias("_n")), [], "score", ["_n"])
    p = (1 + F.col("_n_all") - F.col("_n_upto") + F.col("_n")) / (1 + F.col("_n_all"))
    return bh_fdr(d.filter("_obs = 1").select("a_id", "b_id", "score").join(t.select("score", p.alias("p")), "score", "left"), [], "p")


def mann_whitney(scores: DataFrame, observed: DataFrame) -> DataFrame:
    """One row: n and m (observed and mismatched pairs), u, z and the p that observed scores are greater, by the normal
    approximation of the rank sum with half a step and the correction for ties."""
    o = observed.select("a_id", "b_id").distinct().withColumn("_obs", F.lit(1))
    d = scores.filter("score is not null").join(o, ["a_id", "b_id"], "left")
    t = d.groupBy("score").agg(F.count("_obs").alias("_o"), F.count(F.lit(1)).alias("_n"))
    t = running_totals(t, [], "score", ["_n"]).withColumn("_r", F.col("_n_upto") - (F.col("_n") - 1) / 2)
    ties = F.col("_n").cast("double") ** 3 - F.col("_n")
    s = t.agg(F.sum("_o").alias("n"), F.sum(F.col("_n") - F.col("_o")).alias("m"), F.sum(F.col("_r") * F.col("_o")).alias("_s"), F.sum(ties).alias("_t"))
    n, m, all_ = F.col("n"), F.col("m"), (F.col("n") + F.col("m")).cast("double")
    s = s.withColumn("u", F.col("_s") - n * (n + 1) / 2)
    sd = F.sqrt(n * m / 12.0 * (all_ + 1 - F.col("_t") / (all_ * (all_ - 1))))
    return s.withColumn("z", ratio(F.col("u") - n * m / 2.0 - 0.5, sd)).withColumn("p", normal_above(F.col("z"))).select("n", "m", "u", "z", "p")


def dominant_match(curves: DataFrame, audit: DataFrame, t, lineage: str = "grp", value: str = "value") -> DataFrame:
    """kind, n, rate: share of features whose greatest lineage at time t is the annotated one."""
    best = curves.filter(F.col("t") == t).groupBy("kind", "feature").agg(F.min(F.struct((-F.col(value)).alias("v"), F.col(lineage).alias("l")))["l"].alias("best"))
    return best.join(audit, "feature").groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("best") == F.col("annotated")).cast("double")).alias("rate"))


def curve_zscore(curves: DataFrame, g: Keys, value: str = "value") -> DataFrame:
    """Adds z within a curve, 0 if it is flat."""
    return standardized(curves, g, value, "z", 0.0)


def rank_pairs(scores: DataFrame, model: str, cohort: str, keys: Keys, value: str = "score") -> DataFrame:
    """Adds model_rank and cohort_rank, greatest first, ties by keys."""
    d = numbered(scores.withColumn("_down", -F.round(value, 9)), [model], "_down", keys, "model_rank")
    return numbered(d, [model, cohort], "_down", keys, "cohort_rank").drop("_down")


def pair_consensus(ranked: DataFrame, keys: Keys, model: str = "model", value: str = "score", lag: str | None = None) -> DataFrame:
    """keys, models, mean_score, least_score, greatest_score over models and, with lag, mean_lag; overall_rank by the
    mean, then the least score, greatest first, then by keys."""
    s = ranked.groupBy(*keys).agg(F.count_distinct(model).alias("models"), F.avg(value).alias("mean_score"), F.min(value).alias("least_score"), F.max(value).alias("greatest_score"), *([F.avg(lag).alias("mean_lag")] if lag else []))
    down = s.withColumns({"_m": -F.round("mean_score", 9), "_l": -F.round("least_score", 9)})
    return numbered(down, [], "_m", ["_l", *keys], "overall_rank").drop("_m", "_l")


def select_supported(consensus: DataFrame, gene: str, models: int, n: int, supported: Column | None = None) -> DataFrame:
    """From pair_consensus: pairs that all models score (and that are supported, if a condition is given), the best
    pair of each gene, and of these the n first, numbered by display_order."""
    s = consensus.filter(F.col("models") == models)
    best = top_n(s if supported is None else s.filter(supported), [gene], [F.col("overall_rank")], 1, "_n").drop("_n")
    first = best.orderBy("overall_rank").limit(n)
    return first.withColumn("display_order", F.row_number().over(Window.orderBy("overall_rank")))  # n rows


def _score_and_odds(d: DataFrame, model: str, score: str, support: str, top: Column | None) -> DataFrame:
    """By model: average_precision of support (null if all labels agree) and, with top, the odds ratio and interval."""
    label = F.coalesce(F.col(support), F.lit(False)).cast("boolean")
    d = d.withColumn("_s", label).withColumn(score, F.nanvl(F.col(score).cast("double"), F.lit(None).cast("double")))
    two = d.filter(F.col(score).isNotNull()).groupBy(model).agg((F.min(F.col("_s").cast("int")) < F.max(F.col("_s").cast("int"))).alias("_two"))
    out = average_precision(d, [model], score, "_s").join(two, model).select(model, F.when(F.col("_two"), F.col("average_precision")).alias("average_precision"))
    if top is None:
        return out
    odds = odds_ratio_ci(d.withColumn("_h", F.coalesce(top, F.lit(False))), [model], "_h", "_s").select(model, "odds_ratio", F.col("low").alias("odds_low"), F.col("high").alias("odds_high"))
    return odds.join(out, model, "left")


def model_pair_summary(ranked: DataFrame, model: str, score: str, support: str, q: str, difference: str, lag: str, top: str = "top_decile") -> DataFrame:
    """By model over its pairs: n, supported, average_precision of support, odds ratio and interval of support in the
    top decile, median difference to the nulls, pairs with q <= 0.1 (significant), share of pairs with a positive
    lag (lead_fraction)."""
    ranked = settled(ranked)
    label = F.coalesce(F.col(support), F.lit(False)).cast("boolean")
    base = ranked.groupBy(model).agg(F.count(F.lit(1)).alias("n"), F.count_if(label).alias("supported"), F.count_if(F.col(q) <= 0.1).alias("significant"), F.avg(F.coalesce((F.col(lag) > 0).cast("double"), F.lit(0.0))).alias("lead_fraction"))
    middle = quantiles(ranked, [model], difference, {"median_difference": 0.5})
    return base.join(middle, model, "left").join(_score_and_odds(ranked, model, score, support, F.col(top)), model, "left")


def model_gene_summary(winners: DataFrame, model: str, score: str, support: str, q: str, difference: str, lag: str) -> DataFrame:
    """By model over its genes (see gene_level_winners): n, average_precision of support over all genes, and over the
    supported genes their number, median difference to the nulls, those with q <= 0.1, share with a positive lag."""
    winners = settled(winners)
    held = winners.filter(F.coalesce(F.col(support), F.lit(False)).cast("boolean"))
    n = winners.groupBy(model).agg(F.count(F.lit(1)).alias("n"))
    s = held.groupBy(model).agg(F.count(F.lit(1)).alias("supported"), F.count_if(F.col(q) <= 0.1).alias("significant"), F.avg(F.coalesce((F.col(lag) > 0).cast("double"), F.lit(0.0))).alias("lead_fraction"))
    d = n.join(s, model, "left").join(quantiles(held, [model], difference, {"median_difference": 0.5}), model, "left").fillna(0, ["supported", "significant"])
    return d.join(_score_and_odds(winners, model, score, support, None), model, "left")


def comparator_deltas(summary: DataFrame, value: str, comparator: Column, matched: Keys = ()) -> DataFrame:
    """Adds delta, the value less the greatest of the comparators' (rows for which the condition holds), and for all
    other rows delta_matched, the same against the comparators that agree in `matched`. summary: a row a model."""
    summary = settled(summary)
    best = summary.agg(F.max(F.when(comparator, F.col(value))).alias("_best"))
    d = summary.crossJoin(F.broadcast(best)).withColumn("delta", F.col(value) - F.col("_best")).drop("_best")
    if not matched:
        return d
    near = summary.filter(comparator).groupBy(*matched).agg(F.max(value).alias("_best"))
    d = attach(d, near, matched)
    return d.withColumn("delta_matched", F.when(~comparator, F.col(value) - F.col("_best"))).drop("_best")


#: How a condition of a decision compares.
COMPARE = {">=": lambda a, b: a >= b, ">": lambda a, b: a > b, "<=": lambda a, b: a <= b, "<": lambda a, b: a < b, "=": lambda a, b: a == b}


def decisions(facts: DataFrame, rules: list[tuple[str, list[tuple[str, str, float]]]], otherwise: str, name: str = "decision") -> DataFrame:
    """Adds a label by the first rule whose conditions all hold. A rule is (label, conditions), a condition (measure,
    comparison, bound); rules are data, compiled into one expression. A condition on a null measure does not hold."""
    label = F.lit(otherwise)
    for text, conditions in reversed(rules):
        holds = F.lit(True)
        for measure, how, bound in conditions:
            holds = holds & F.coalesce(COMPARE[how](F.col(measure).cast("double"), F.lit(float(bound))), F.lit(False))
        label = F.when(holds, text).otherwise(label)
    return facts.withColumn(name, label)


def share_that_holds(rows: DataFrame, g: Keys, conditions: list[tuple[str, str, float]], name: str = "share") -> DataFrame:
    """g and the share of rows for which all conditions hold (see decisions)."""
    d = decisions(rows, [("yes", conditions)], "no", "_d")
    return d.groupBy(*g).agg(F.avg((F.col("_d") == "yes").cast("double")).alias(name))
