"""Composition and distribution distance."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import Keys, ratio, top_n
from ..functions.lineage import settled
from . import clusters
from .ordering import attach, running_totals


def composition(df: DataFrame, g: Keys, label: str, weight: str | None = None, name: str = "share") -> DataFrame:
    """g, label, share of each label that occurs; shares sum to 1 in a group."""
    w = F.lit(1.0) if weight is None else F.col(weight)
    d = df.groupBy(*g, F.col(label).alias("label")).agg(F.sum(w).alias("_w"))
    return d.select(*g, "label", (F.col("_w") / F.sum("_w").over(Window.partitionBy(*g))).alias(name))


def compare_composition(predicted: DataFrame, observed: DataFrame, g: Keys, on: Keys) -> DataFrame:
    """g, label, predicted, observed, difference, absolute, delta_pp with 0 for classes on one side only.
    predicted has keys g (which include `on`), observed has keys `on`. Classes are few; groups by classes
    is the size of the result."""
    packed = F.map_from_entries(F.collect_list(F.struct("label", "share")))  # a pair for each class
    p, o = predicted.groupBy(*g).agg(packed.alias("_p")), observed.groupBy(*on).agg(packed.alias("_o"))
    labels = observed.agg(F.collect_set("label").alias("_labels"))
    d = p.join(o, list(on), "left") if on else p.crossJoin(o)
    # predicted is used once: its labels are gathered over the few rows of groups, not by a second pass
    seen = F.flatten(F.collect_list(F.map_keys("_p")).over(Window.partitionBy(F.lit(0))))
    d = d.crossJoin(F.broadcast(labels)).withColumn("_seen", seen).withColumn("label", F.explode(F.array_union("_seen", "_labels")))
    share = lambda m: F.coalesce(F.try_element_at(m, F.col("label")), F.lit(0.0))
    p, o = share("_p"), share("_o")
    return d.select(*g, "label", p.alias("predicted"), o.alias("observed"), (p - o).alias("difference"), F.abs(p - o).alias("absolute"), (100 * (p - o)).alias("delta_pp"))


def composition_mae(compared: DataFrame, g: Keys, cells: str) -> DataFrame:
    """Mean absolute error in percentage points, weighted by the column of cell numbers."""
    return compared.groupBy(*g).agg(ratio(F.sum(F.col(cells) * F.abs("delta_pp")), F.sum(cells)).alias("mae_pp"))


def jsd(compared: DataFrame, g: Keys, drop: str | None = "Unknown") -> DataFrame:
    """jsd (base 2) of predicted and observed after leaving out `drop` and renormalising; 1 - jsd and
    1 - sqrt(jsd). Null where a side has nothing left."""
    d = compared if drop is None else compared.filter(F.col("label") != drop)
    w = Window.partitionBy(*g)
    p, o = ratio(F.col("predicted"), F.sum("predicted").over(w)), ratio(F.col("observed"), F.sum("observed").over(w))
    d = d.withColumn("_p", p).withColumn("_o", o).withColumn("_m", (F.col("_p") + F.col("_o")) / 2)
    term = lambda a: F.when(F.col(a) > 0, F.col(a) * F.log2(F.col(a) / F.col("_m"))).when(F.col(a) == 0, 0.0)
    d = d.groupBy(*g).agg(F.greatest(F.sum(term("_p") + term("_o")) / 2, F.lit(0.0)).alias("jsd"))
    return d.withColumn("similarity", 1 - F.col("jsd")).withColumn("root_similarity", 1 - F.sqrt("jsd"))


def effective_coverage(ref_mass: DataFrame, g: Keys, n_ref: DataFrame, on: Keys) -> DataFrame:
    """effective = (sum m)^2 / sum m^2, its share of the reference rows (on, n_ref), and the largest mass."""
    s = ref_mass.groupBy(*g).agg((F.sum("mass") ** 2 / F.sum(F.col("mass") ** 2)).alias("effective"), F.max("mass").alias("max_mass"))
    return s.join(n_ref, list(on)).select(*g, "effective", ratio(F.col("effective"), F.col("n_ref")).alias("coverage"), "max_mass")


def regroup_composition(comp: DataFrame, groups: DataFrame, g: Keys) -> DataFrame:
    """Shares of groups (label, lineage), renormalised to 1 over the labels that have one."""
    d = comp.join(groups, "label").groupBy(*g, "lineage").agg(F.sum("share").alias("_s"))
    return d.select(*g, "lineage", (F.col("_s") / F.sum("_s").over(Window.partitionBy(*g))).alias("share"))


def within_lineage_percent(df: DataFrame, g: Keys, label: str, keep: Keys) -> DataFrame:
    """Counts and percent within g of the kept labels, all others as 'Other'."""
    kept = F.when(F.col(label).isin(*keep), F.col(label)).otherwise("Other")
    d = df.groupBy(*g, kept.alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return d.withColumn("percent", 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(*g)))


# --- clouds of points -------------------------------------------------------------------------------


def _kinds(df: DataFrame, g: Keys) -> str:
    return ", ".join(f"`{c}` {t}" for c, t in df.select(*g).dtypes)


def microclusters(points: DataFrame, g: Keys, k: int, vector: str = "x", weight: str = "weight", seed: int = 0) -> DataFrame:
    """g, cluster, x, weight: at most k weighted centres for each unit, by one scheme at every size (see clusters.fit),
    with weights that sum to 1; the points themselves if there are no more than k."""
    blocks = clusters.packed(points.filter(F.col(weight) > 0), g, vector, weight)
    d = clusters.fit(settled(blocks), g, k, seed)
    d = d.select(*g, F.posexplode(F.arrays_zip("centres", "mass")).alias("cluster", "c"), F.aggregate("mass", F.lit(0.0), lambda s, v: s + v).alias("_t"))
    return d.filter("c.mass > 0").select(*g, "cluster", F.col("c.centres").alias("x"), (F.col("c.mass") / F.col("_t")).alias("weight"))


def _ot(x, a, y, b, blur: float, rounds: int = 500) -> float:
    """Dual value of entropic transport with cost |x - y|^2 / 2, log-domain with averaged updates."""
    eps = blur**2
    cost = np.maximum((x**2).sum(1)[:, None] - 2 * x @ y.T + (y**2).sum(1)[None, :], 0) / 2
    la, lb = np.log(a), np.log(b)
    f, h = np.zeros(len(a)), np.zeros(len(b))

    def soft(m):
        top = m.max(1)
        return top + np.log(np.exp(m - top[:, None]).sum(1))

    scale = max(float(cost.max()), eps)
    while scale > eps:
        f, h = (f - scale * soft((h - cost) / scale + lb)) / 2, (h - scale * soft((f[None, :] - cost.T) / scale + la)) / 2
        scale = max(scale * 0.5, eps)
    for _ in range(rounds):
        nf = -eps * soft((h - cost) / eps + lb)
        nh = -eps * soft((nf[None, :] - cost.T) / eps + la)
        done = np.abs(nf - f).max() < 1e-9 * (1 + np.abs(nf).max())
        f, h = nf, nh
        if done:
            break
    return float(a @ f + b @ h)


def sinkhorn(x, a, y, b, blur: float) -> float:
    """Debiased divergence S(x, y), at least 0."""
    a, b = np.asarray(a, float) / np.sum(a), np.asarray(b, float) / np.sum(b)
    keep_a, keep_b = a > 0, b > 0
    x, a, y, b = np.asarray(x)[keep_a], a[keep_a], np.asarray(y)[keep_b], b[keep_b]
    return max(_ot(x, a, y, b, blur) - (_ot(x, a, x, a, blur) + _ot(y, b, y, b, blur)) / 2, 0.0)


def sinkhorn_divergence(a: DataFrame, b: DataFrame, g: Keys, blur: float = 0.1) -> DataFrame:
    """g, divergence, w2 = sqrt(2 S) between two clouds (x, weight) of each unit. Meant for summaries of a
    few hundred centres (see microclusters): one unit, one task."""
    b = b.select(*[F.col(c).alias(f"_{c}") for c in g], F.col("x").alias("x"), F.col("weight").alias("weight"))
    a = a.select(*g, "x", "weight")

    def solve(key, p: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if p.empty or q.empty:
            return pd.DataFrame({c: [] for c in [*g, "divergence", "w2"]})
        p, q = (z.assign(_o=z["x"].map(tuple)).sort_values(["_o", "weight"]) for z in (p, q))
        s = sinkhorn(np.stack(p["x"]), p["weight"].to_numpy(), np.stack(q["x"]), q["weight"].to_numpy(), blur)
        return pd.DataFrame({**{c: [key[i]] for i, c in enumerate(g)}, "divergence": [s], "w2": [np.sqrt(2 * s)]})

    return a.groupBy(*g).cogroup(b.groupBy(*[f"_{c}" for c in g])).applyInPandas(solve, f"{_kinds(a, g)}, divergence double, w2 double")


def adjacent_time_distance(points: DataFrame, stage: str, k: int = 128, blur: float = 0.1, vector: str = "x") -> DataFrame:
    """stage, next_stage, w2 between every stage and the next, and between the first and the last (where
    they are not adjacent)."""
    p = points.select(F.col(stage).alias("stage"), F.col(vector).alias("x"), F.lit(1.0).alias("weight"))
    c = microclusters(p, ["stage"], k)
    every = Window.orderBy("stage")  # a row a stage
    st = p.select("stage").distinct().withColumn("next_stage", F.lead("stage").over(every)).withColumn("_first", F.min("stage").over(every)).withColumn("_last", F.max("stage").over(Window.partitionBy(F.lit(0))))
    pairs = st.select("stage", "next_stage").filter("next_stage is not null")
    ends = st.filter("stage = _last").select(F.col("_first").alias("stage"), F.col("_last").alias("next_stage")).filter("stage <> next_stage")
    pairs = pairs.unionByName(ends).distinct()
    a = pairs.join(c.select("stage", "x", "weight"), "stage")
    b = pairs.join(c.select(F.col("stage").alias("next_stage"), "x", "weight"), "next_stage")
    return sinkhorn_divergence(a, b, ["stage", "next_stage"], blur).drop("divergence")


def total_time_distance(distances: DataFrame) -> DataFrame:
    """One row: total, the sum of w2 over consecutive stages, and ends, the w2 between the first and the last
    stage (that of the one pair, if there are two). distances: as adjacent_time_distance gives them."""
    bounds = distances.agg(F.min("stage").alias("_first"), F.max("next_stage").alias("_last"), F.count(F.lit(1)).alias("_n"))
    d = distances.crossJoin(F.broadcast(bounds))  # one row
    ends = (F.col("stage") == F.col("_first")) & (F.col("next_stage") == F.col("_last"))
    return d.agg(F.sum(F.when(~ends | (F.col("_n") == 1), F.col("w2"))).alias("total"), F.max(F.when(ends, F.col("w2"))).alias("ends"))


def repeated_distance(a: DataFrame, b: DataFrame, g: Keys, size: int, repeats: int, seed: int = 0, blur: float = 0.1, vector: str = "x", key: str = "id") -> DataFrame:
    """mean, sd, median, q025, q975 of w2 between minibatches of the two clouds of each group, over repeats. A
    minibatch is the `size` rows of a cloud (all, if fewer) with the least hashes of key, repeat and seed. Rows
    are thinned by a threshold on the hash, to some four times the need, before any are ordered."""

    def drawn(df: DataFrame) -> DataFrame:
        n = df.groupBy(*g).agg(F.count(F.lit(1)).alias("_n"))
        d = attach(df.select(*g, F.col(key).alias("_key"), F.col(vector).alias("x"), F.lit(1.0).alias("weight")), n, g)
        d = d.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1)))).withColumn("_h", F.xxhash64("_key", "repeat", F.lit(seed)))
        share = 4.0 * (size + 64) / F.col("_n")  # `size` fail to pass with a chance below 1e-50
        low = (F.col("_h").cast("double") / 2.0**64 + 0.5) < share
        return top_n(d.filter(low), [*g, "repeat"], [F.col("_h"), F.col("_key")], size, "_r").select(*g, "repeat", "x", "weight")

    w2 = sinkhorn_divergence(drawn(a), drawn(b), [*g, "repeat"], blur)
    return w2.groupBy(*g).agg(F.avg("w2").alias("mean"), F.stddev("w2").alias("sd"), *[F.expr(f"percentile(w2, {q})").alias(n) for n, q in (("median", 0.5), ("q025", 0.025), ("q975", 0.975))])


def directions(spark, dim: int, n: int, seed: int = 0) -> DataFrame:
    """direction, u: n seeded unit vectors."""
    v = np.random.default_rng(seed).normal(size=(n, dim))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    return spark.createDataFrame([(i, [float(t) for t in row]) for i, row in enumerate(v)], "direction int, u array<double>")


#: Places of a running mass that are coupled together.
STEPS = 256


def sliced_w2(query: DataFrame, target: DataFrame, u: DataFrame, g: Keys, vector: str = "x", weight: str = "weight", most: int = 4096) -> DataFrame:
    """g, w2: both clouds projected on each direction (direction, u: a table of `most` rows at most, which is checked, and
    broadcast), one-dimensional W2^2 by the sorted quantile coupling, mean over directions, root.

    Running masses are totalled in cells of the projected values (see ordering), and both sides' breaks are coupled in
    cells of the mass range; what a cell needs of the next ones is one value a cell. No task holds the values of a
    group and direction."""
    if u.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} directions")

    def projected(df: DataFrame, side: int) -> DataFrame:
        d = df.select(*g, F.col(vector).alias("_x"), F.col(weight).cast("double").alias("_w")).filter("_w > 0").crossJoin(F.broadcast(u))
        v = F.aggregate(F.zip_with("_x", "u", lambda p, q: p * q), F.lit(0.0), lambda s, t: s + t)
        d = d.select(*g, "direction", v.alias("v"), "_w").groupBy(*g, "direction", "v").agg(F.sum("_w").alias("_w"))
        d = running_totals(d, [*g, "direction"], "v", ["_w"])
        q = F.round(F.col("_w_upto") / F.col("_w_all"), 12)
        return d.select(*g, "direction", q.alias("q"), F.when(F.lit(side == 0), F.col("v")).alias("a"), F.when(F.lit(side == 1), F.col("v")).alias("b"))

    by = [*g, "direction"]
    steps = projected(query, 0).unionByName(projected(target, 1)).groupBy(*by, "q").agg(F.min("a").alias("a"), F.min("b").alias("b"))
    steps = settled(steps.withColumn("cell", F.ceil(F.col("q") * STEPS).cast("int")))
    first = lambda c: F.min_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), F.col("q"))).alias(f"_{c}")
    cells = steps.groupBy(*by, "cell").agg(first("a"), first("b"), F.max("q").alias("_q"))
    later = Window.partitionBy(*by).orderBy(F.desc("cell")).rowsBetween(Window.unboundedPreceding, -1)  # STEPS rows
    cells = cells.select(*by, "cell", *[F.last(f"_{c}", ignorenulls=True).over(later).alias(f"_next_{c}") for c in "ab"], F.lag("_q", 1, 0.0).over(Window.partitionBy(*by).orderBy("cell")).alias("_before"))
    steps = attach(steps, cells, [*by, "cell"])
    inside = Window.partitionBy(*by, "cell")
    # backwards, so that the frame grows and is not read again for each row
    ahead = inside.orderBy(F.desc("q")).rowsBetween(Window.unboundedPreceding, 0)
    at = lambda c: F.coalesce(F.last(c, ignorenulls=True).over(ahead), F.col(f"_next_{c}"))
    m = F.col("q") - F.coalesce(F.lag("q").over(inside.orderBy("q")), F.col("_before"))
    per = steps.select(*by, m.alias("m"), at("a").alias("a"), at("b").alias("b")).groupBy(*by).agg(F.sum(F.col("m") * (F.col("a") - F.col("b")) ** 2).alias("w2sq"))
    return per.groupBy(*g).agg(F.sqrt(F.avg("w2sq")).alias("w2"))


def sampling_floor(points: DataFrame, g: Keys, repeats: int, seed: int = 0, k: int = 128, blur: float = 0.1, vector: str = "x") -> DataFrame:
    """mean, sd, median, q025, q975 of w2 between random halves of each group, over repeats."""
    d = points.select(*g, F.col(vector).alias("x"), F.lit(1.0).alias("weight")).withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    d = d.withColumn("_half", F.pmod(F.xxhash64("x", "repeat", F.lit(seed)), F.lit(2)))
    key = [*g, "repeat"]
    halves = [microclusters(d.filter(F.col("_half") == h), key, k) for h in (0, 1)]
    w2 = sinkhorn_divergence(halves[0], halves[1], key, blur)
    return w2.groupBy(*g).agg(F.avg("w2").alias("mean"), F.stddev("w2").alias("sd"), *[F.expr(f"percentile(w2, {q})").alias(n) for n, q in (("median", 0.5), ("q025", 0.025), ("q975", 0.975))])


def support_recall(hit_mass: DataFrame, ess: DataFrame, g: Keys, on: Keys, threshold: float = 0.5) -> DataFrame:
    """recall = mean of 1 - (1 - m)^ESS, hard recall (m > 0), share of rows at or above the threshold."""
    m = F.least(F.col("mass"), F.lit(1.0))
    p = F.when(m >= 1, 1.0).otherwise(-F.expm1(F.col("ess") * F.log1p(-m)))
    d = hit_mass.join(ess, list(on)).withColumn("_p", p)
    return d.groupBy(*g).agg(F.avg("_p").alias("recall"), F.avg((F.col("mass") > 0).cast("double")).alias("hard_recall"), F.avg((F.col("_p") >= threshold).cast("double")).alias("share_above"))


def line_matching(distances: DataFrame, g: Keys, source: str, target: str, value: str) -> DataFrame:
    """By source: matched and mean wrong distance, margin, ratio, and whether the match is the nearest
    (ties to the first name)."""
    same = F.col(source) == F.col(target)
    d = distances.groupBy(*g, source).agg(F.avg(F.when(same, F.col(value))).alias("matched"), F.avg(F.when(~same, F.col(value))).alias("wrong"), F.min_by(target, F.struct(value, target)).alias("best"))
    return d.select(*g, source, "matched", "wrong", (F.col("wrong") - F.col("matched")).alias("margin"), ratio(F.col("matched"), F.col("wrong")).alias("ratio"), (F.col("best") == F.col(source)).alias("top1"))


def summary_by_axes(scores: DataFrame, axes: list[list[str]], value: str) -> DataFrame:
    """mean, median, sd, n for each set of axes in one pass of grouping sets; other axes are null."""
    every = list(dict.fromkeys(c for a in axes for c in a))
    sets = [[F.col(c) for c in a] for a in axes]
    d = scores.groupingSets(sets, *[F.col(c) for c in every])
    return d.agg(F.avg(value).alias("mean"), F.expr(f"percentile({value}, 0.5)").alias("median"), F.stddev(value).alias("sd"), F.count(value).alias("n"))


def path_energy(path: DataFrame, g: Keys, particle: str, time: str, vector: str = "x") -> DataFrame:
    """Mean over particles of the sum over steps of |dx/dt|^2 dt / 2."""
    w = Window.partitionBy(*g, particle).orderBy(time)
    d = path.withColumn("_x", F.lag(vector).over(w)).withColumn("_dt", F.col(time) - F.lag(time).over(w)).filter("_dt > 0")
    sq = F.aggregate(F.zip_with(vector, "_x", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
    per = d.groupBy(*g, particle).agg(F.sum(0.5 * sq / F.col("_dt")).alias("energy"))
    return per.groupBy(*g).agg(F.avg("energy").alias("energy"), F.count(F.lit(1)).alias("n"))


def spread_metrics(particles: DataFrame, g: Keys, vector: str = "x", weight: str = "weight", log_mass: str = "log_mass") -> DataFrame:
    """Mean over coordinates of the weighted deviation, and the mean of exp(log mass within +-50)."""
    long = particles.select(*g, F.col(weight).alias("_w"), F.posexplode(vector).alias("i", "v"))
    s = long.groupBy(*g, "i").agg(F.sum("_w").alias("w"), F.sum(F.col("_w") * F.col("v")).alias("s"), F.sum(F.col("_w") * F.col("v") ** 2).alias("q"))
    sd = F.sqrt(F.greatest(F.col("q") / F.col("w") - (F.col("s") / F.col("w")) ** 2, F.lit(0.0)))
    spread = s.groupBy(*g).agg(F.avg(sd).alias("coordinate_sd"))
    clipped = F.greatest(F.least(F.coalesce(F.col(log_mass), F.lit(0.0)), F.lit(50.0)), F.lit(-50.0))
    return spread.join(particles.groupBy(*g).agg(F.avg(F.exp(clipped)).alias("mass_factor")), list(g))


def six_metric_table(distances: DataFrame, similarity: DataFrame, recall: DataFrame, g: Keys) -> DataFrame:
    """One row for each of g: w2 by modality (columns w2_<modality>), composition similarity, recall."""
    wide = distances.groupBy(*g).pivot("modality").agg(F.first("w2"))
    wide = wide.select(*g, *[F.col(c).alias(f"w2_{c}") for c in wide.columns if c not in g])
    return wide.join(similarity, list(g), "outer").join(recall, list(g), "outer")


def stage_score_overall(scores: DataFrame, method: str, stage: str, metric: str, stages: list) -> DataFrame:
    """method, overall (mean over stages with equal weight), a column for each stage; lowest first."""
    d = scores.groupBy(method, stage).agg(F.avg(metric).alias("_m"))
    wide = d.groupBy(method).pivot(stage, stages).agg(F.first("_m"))
    wide = wide.select(method, *[F.col(str(s)).alias(f"stage_{s}") for s in stages])
    return d.groupBy(method).agg(F.avg("_m").alias("overall")).join(wide, method).orderBy("overall", method)
