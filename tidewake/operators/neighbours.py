"""Nearest-neighbour and radius joins."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import Keys, ratio, top_n
from ..functions.lineage import settled
from . import pivots
from .mass import weighted_median
from .ordering import attach, numbered, quantiles, standardized

#: Rows of either side that one task compares.
BLOCK = 2048


def _blocks(query: DataFrame, ref: DataFrame, on: Keys, block: int) -> tuple:
    """Both sides dealt to block pairs. Blocks, not stages, are the unit of work, so a large stage is
    spread over as many tasks as its size asks for. Keys are dealt under one type a pair of columns, since an int and
    an equal long hash apart."""
    on = list(on)
    kinds = dict(query.select(*on).limit(0).union(ref.select(*on).limit(0)).dtypes)
    n_q = query.groupBy(*on).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("_nq"))
    n_r = ref.groupBy(*on).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("_nr"))
    sizes = n_q.join(n_r, on) if on else n_q.crossJoin(n_r)  # without keys: one row a side

    def dealt(df: DataFrame, own: str, other: str, mine: str, theirs: str, side: str):
        d = df.join(sizes, on) if on else df.crossJoin(F.broadcast(sizes))
        d = d.withColumn(own, F.pmod(F.xxhash64("id"), F.col(mine)).cast("int"))
        d = d.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(theirs) - 1)))
        # names of their own, so that a table can be joined with itself
        keys = [(F.col(c).cast(kinds[c]) if c in kinds else F.col(c)).alias(f"{side}{i}") for i, c in enumerate([*on, "_qb", "_rb"])]
        return d.select(*keys, *[c for c in df.columns if c not in on]).groupBy(*[f"{side}{i}" for i in range(len(keys))])

    return dealt(query, "_qb", "_rb", "_nq", "_nr", "_left"), dealt(ref, "_rb", "_qb", "_nr", "_nq", "_right")


def _squared(q: np.ndarray, r: np.ndarray) -> np.ndarray:
    return np.maximum((q**2).sum(1)[:, None] + (r**2).sum(1)[None, :] - 2 * q @ r.T, 0)


def _nearest(q_ids, q, r_ids, r, k: int):
    """Exact k nearest by (distance, ref id): the product form proposes, differences decide."""
    for at in range(0, len(q), 256):
        part = q[at : at + 256]
        d = _squared(part, r)
        kk = min(k, len(r))
        bound = np.partition(d, kk - 1, axis=1)[:, kk - 1]
        for row, (dist, limit) in enumerate(zip(d, bound)):
            near = np.flatnonzero(dist <= limit + 1e-9 * (1 + limit))
            exact = np.sqrt(((r[near] - part[row]) ** 2).sum(1))
            order = np.lexsort((r_ids[near], exact))[:kk]
            for i in order:
                yield q_ids[at + row], r_ids[near[i]], exact[i]


def _compared(q: DataFrame, r: DataFrame, k: int, on: Keys, block: int) -> DataFrame:
    """on, query_id, ref_id, distance: for each query row and block of reference rows its k nearest. Block pairs are
    compared by numpy."""
    left, right = _blocks(q, r, on, block)
    kinds = ", ".join(f"`{c}` {t}" for c, t in q.select(*on).dtypes)

    def search(group, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            found = []
        else:
            found = list(_nearest(a["id"].to_numpy(), np.stack(a["x"]), b["id"].to_numpy(), np.stack(b["x"]), k))
        out = pd.DataFrame(found, columns=["query_id", "ref_id", "distance"])
        for i, c in enumerate(on):
            out.insert(i, c, group[i])
        return out

    schema = f"{kinds + ', ' if kinds else ''}query_id long, ref_id long, distance double"
    return left.cogroup(right).applyInPandas(search, schema)


def knn_join(query: DataFrame, ref: DataFrame, k: int, on: Keys = (), vector: str = "x", block: int = BLOCK, cell: int | None = None) -> DataFrame:
    """on, query_id, ref_id, rank, distance: the exact Euclidean k nearest reference rows (id, vector) of
    each query row in the same `on` group; all of them if there are fewer; ties to the lower ref id.

    If a group has over `cell` reference rows, these are dealt to cells around pivots. A query meets its own cell
    first, whose k-th distance bounds what it looks for, and then only cells that the triangle inequality does not
    refute (see pivots.asked); it is not sent to the others. Smaller groups are compared at once. Within cells, blocks
    are the unit of work, and give k rows a query, merged by rank."""
    q = query.select(*on, F.col("id").cast("long").alias("id"), F.col(vector).cast("array<double>").alias("x"))
    r = ref.select(*on, F.col("id").cast("long").alias("id"), F.col(vector).cast("array<double>").alias("x"))
    order = [F.col("distance"), F.col("ref_id")]
    if pivots.few(r, on, cell):
        return top_n(_compared(q, r, k, on, block), [*on, "query_id"], order, k)
    held, r, extents = pivots.cells_of(r, on, cell)
    own = settled(pivots.placed(q, held, on).drop("_gap"))
    inside = [*on, "_cell"]
    near = settled(_compared(own, r.drop("_gap"), k, inside, block).drop("_cell"))
    bound = near.groupBy(*on, "query_id").agg(F.count(F.lit(1)).alias("_n"), F.max("distance").alias("_d"))
    bound = bound.select(*on, F.col("query_id").alias("id"), F.when(F.col("_n") >= k, F.col("_d")).alias("_bound"))
    more = pivots.asked(attach(own, bound, [*on, "id"]), extents, on, k, skip_own=True)
    more = more.select(*on, F.col("_ask").alias("_cell"), "id", "x")
    rest = _compared(more, r.drop("_gap"), k, inside, block).drop("_cell")
    return top_n(near.unionByName(rest), [*on, "query_id"], order, k)


def knn_join_excluding(query: DataFrame, ref: DataFrame, k: int, on: Keys = (), vector: str = "x") -> DataFrame:
    """The k nearest other than the row of the query's own id."""
    near = knn_join(query, ref, k + 1, on, vector).filter("query_id <> ref_id").drop("rank")
    return top_n(near, [*on, "query_id"], [F.col("distance"), F.col("ref_id")], k)


def self_knn_radius(ref: DataFrame, k: int, on: Keys = (), vector: str = "x") -> DataFrame:
    """on, id, radius: distance to the k-th nearest other row (the farthest, if there are fewer)."""
    near = knn_join_excluding(ref, ref, k, on, vector)
    return near.groupBy(*on, F.col("query_id").alias("id")).agg(F.max("distance").alias("radius"))


def loo_1nn_median(ref: DataFrame, on: Keys = (), vector: str = "x") -> DataFrame:
    """Median distance to the nearest other row, by group."""
    return quantiles(self_knn_radius(ref, 1, on, vector), on, "radius", {"loo_median": 0.5})


def radius_mass(ref: DataFrame, particles: DataFrame, on: Keys = (), vector: str = "x", block: int = BLOCK, cell: int | None = None) -> DataFrame:
    """on, id, mass: the weight of particles (id, vector, weight) with d^2 <= radius^2 + 1e-7 of each
    reference row (id, vector, radius). Particles of a group of over `cell` rows are dealt to cells around pivots, and
    a reference row meets those cells alone that may lie within its radius. Block pairs give one partial sum for each
    reference row."""
    q = particles.select(*on, F.col("id").cast("long").alias("id"), F.col(vector).cast("array<double>").alias("x"), F.col("weight").cast("double").alias("weight"))
    r = ref.select(*on, F.col("id").cast("long").alias("id"), F.col(vector).cast("array<double>").alias("x"), F.col("radius").cast("double").alias("radius"))
    keys = list(on)
    if not pivots.few(q, on, cell):
        _, q, extents = pivots.cells_of(q, on, cell)
        r = pivots.asked(r.withColumn("_bound", F.sqrt(F.col("radius") ** 2 + 1e-7)), extents, on, None, skip_own=False)
        r, q, keys = r.drop("_bound").withColumnRenamed("_ask", "_cell"), q.drop("_gap"), [*on, "_cell"]
    left, right = _blocks(q, r, keys, block)
    kinds = ", ".join(f"`{c}` {t}" for c, t in q.select(*keys).dtypes)

    def sums(group, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if b.empty:
            out = pd.DataFrame({"id": [], "mass": []})
        else:
            mass = np.zeros(len(b))
            x, w = np.stack(b["x"]), a["weight"].to_numpy()
            limit = b["radius"].to_numpy() ** 2 + 1e-7
            for at in range(0, len(b), 256):
                inside = _squared(x[at : at + 256], np.stack(a["x"])) <= limit[at : at + 256, None] if len(a) else np.zeros((len(x[at : at + 256]), 0))
                mass[at : at + 256] = inside @ w
            out = pd.DataFrame({"id": b["id"].to_numpy(), "mass": mass})
        for i, c in enumerate(keys):
            out.insert(i, c, group[i])
        return out

    parts = left.cogroup(right).applyInPandas(sums, f"{kinds + ', ' if kinds else ''}id long, mass double")
    found = parts.groupBy(*on, "id").agg(F.sum("mass").alias("mass"))
    return ref.select(*on, F.col("id").cast("long").alias("id")).join(found, [*on, "id"], "left").select(*on, "id", F.coalesce("mass", F.lit(0.0)).alias("mass"))


def projection_ratio(nearest: DataFrame, weights: DataFrame, loo_median: DataFrame, g: Keys, on: Keys) -> DataFrame:
    """Weighted median 1-NN distance (query_id, distance joined to query_id, weight) over the reference's
    own leave-one-out median."""
    d = nearest.select("query_id", "distance").join(weights, "query_id")
    return weighted_median(d, g, "distance", "weight", "distance_median").join(loo_median, list(on)).withColumn("projection_ratio", ratio(F.col("distance_median"), F.col("loo_median")))


SCHEMES = ("hard", "vote", "majority", "inverse", "inverse_floor", "gaussian_own", "gaussian_global")


def neighbour_weights(knn: DataFrame, scheme: str, by: Keys = ()) -> DataFrame:
    """Adds w, weights of a query's neighbours that sum to 1, by a named scheme. Gaussian weights are
    exp(-(d/h)^2), where h is the query's own distance to its k-th neighbour, or the median of these over all
    queries (of positive distances where it is 0); the floor of inverse distances is 1e-3 of the median positive one.
    A query is searched once in each group of `by` (a time, a stage), whose medians are its own."""
    q = Window.partitionBy(*by, "query_id")
    d = F.col("distance")
    if scheme == "hard":
        raw = (F.col("rank") == 1).cast("double")
    elif scheme in ("vote", "majority"):
        raw = F.lit(1.0)
    elif scheme == "inverse":
        zero = F.max((d == 0).cast("int")).over(q)
        raw = F.when(zero == 1, (d == 0).cast("double")).otherwise(1.0 / d)
    elif scheme == "inverse_floor":
        middle = quantiles(knn.filter("distance > 0"), by, "distance", {"_m": 0.5})
        knn = attach(knn, middle.select(*by, (F.col("_m") * 1e-3).alias("_floor")), by)
        raw = 1.0 / F.greatest(d, F.coalesce("_floor", F.lit(0.0)), F.lit(1e-8))
    elif scheme == "gaussian_own":
        h = F.max(d).over(q)
        raw = F.exp(-((d / F.greatest(h, F.lit(1e-12))) ** 2))
    elif scheme == "gaussian_global":
        middle = quantiles(knn.groupBy(*by, "query_id").agg(F.max("distance").alias("_far")), by, "_far", {"_k": 0.5})
        other = quantiles(knn.filter("distance > 0"), by, "distance", {"_m": 0.5})
        h = F.when(F.col("_k") > 1e-12, F.col("_k")).otherwise(F.coalesce("_m", F.lit(1.0))).alias("_h")
        knn = attach(knn, attach(middle, other, by).select(*by, h), by)
        raw = F.exp(-((d / F.col("_h")) ** 2))
    else:
        raise ValueError(f"scheme must be one of {SCHEMES}")
    return knn.withColumn("_raw", raw).withColumn("w", F.col("_raw") / F.sum("_raw").over(q)).drop("_raw", "_floor", "_h")


def label_probabilities(knn: DataFrame, labels: DataFrame, scheme: str = "vote") -> DataFrame:
    """query_id, label, prob from labels (ref_id, label)."""
    return neighbour_weights(knn, scheme).join(labels, "ref_id").groupBy("query_id", "label").agg(F.sum("w").alias("prob"))


def transfer_labels(knn: DataFrame, labels: DataFrame, scheme: str = "vote") -> DataFrame:
    """query_id, label, prob: the most probable label, ties to the first in sorted order; under 'majority'
    a label needs more than half of the votes, else 'unassigned'."""
    p = label_probabilities(knn, labels, scheme)
    best = p.groupBy("query_id").agg(F.min(F.struct((-F.round("prob", 12)).alias("p"), "label", "prob")).alias("b"))
    label = F.col("b.label").cast("string")
    if scheme == "majority":
        label = F.when(F.col("b.prob") > 0.5, label).otherwise("unassigned")
    return best.select("query_id", label.alias("label"), F.col("b.prob").alias("prob"))


def soft_mass_transfer(knn: DataFrame, weights: DataFrame, g: Keys, scheme: str = "gaussian_own") -> DataFrame:
    """g, ref_id, mass: each query's weight spread over its neighbours."""
    d = neighbour_weights(knn.select("query_id", "ref_id", "rank", "distance"), scheme).join(weights, "query_id")
    return d.groupBy(*g, "ref_id").agg(F.sum(F.col("weight") * F.col("w")).alias("mass"))


def knn_readout(knn: DataFrame, values: DataFrame, scheme: str = "vote") -> DataFrame:
    """query_id, feature, value: weighted mean of the neighbours' values (ref_id, feature, value); a
    feature that a neighbour lacks counts as 0 there."""
    d = neighbour_weights(knn, scheme).join(values, "ref_id")
    return d.groupBy("query_id", "feature").agg(F.sum(F.col("w") * F.col("value")).alias("value"))


def group_curves(members: DataFrame, knn: DataFrame, counts: DataFrame, g: Keys, scheme: str = "vote", scale: float = 1.0) -> DataFrame:
    """g, feature, value: pseudo-bulk of groups of queries. members: g, query_id, weight. Coefficients of
    the reference rows are summed first and only then joined to their sparse counts."""
    share = F.col("weight") / F.sum("weight").over(Window.partitionBy(*g))
    d = neighbour_weights(knn.select("query_id", "ref_id", "rank", "distance"), scheme).join(members.withColumn("_share", share), "query_id")
    coefficients = d.groupBy(*g, "ref_id").agg(F.sum(F.col("w") * F.col("_share")).alias("c"))
    return coefficients.join(counts, "ref_id").groupBy(*g, "feature").agg((F.sum(F.col("c") * F.col("value")) * scale).alias("value"))


def stage_bracket(df: DataFrame, time: str, stages: list[float]) -> DataFrame:
    """df with low, high (places in the list of rising stage times) and alpha: a time between two stages lies alpha of
    the way from low to high; at or beyond an end both are that end and alpha is 0."""
    last, t = len(stages) - 1, F.col(time).cast("double")
    at = F.array(*[F.lit(float(v)) for v in stages])
    low = F.size(F.filter(at, lambda v: v <= t)) - 1
    low = F.when(t <= stages[0], 0).when(t >= stages[-1], last).otherwise(low)
    high = F.when((t <= stages[0]) | (t >= stages[-1]), low).otherwise(low + 1)
    d = df.withColumn("low", low.cast("int")).withColumn("high", high.cast("int"))
    a, b = F.get(at, F.col("low")), F.get(at, F.col("high"))
    return d.withColumn("alpha", F.when(b > a, (t - a) / (b - a)).otherwise(0.0))


def bracket_shares(df: DataFrame) -> DataFrame:
    """Rows of stage_bracket, once for each stage that they are decoded in, with stage and part (1 - alpha, or alpha)."""
    both = F.array(F.struct(F.col("low").alias("stage"), (1 - F.col("alpha")).alias("part")), F.struct(F.col("high").alias("stage"), F.col("alpha").alias("part")))
    kept = F.filter(both, lambda v: v["part"] > 0)
    return df.withColumn("_s", F.explode(kept)).select(*df.columns, "_s.stage", "_s.part")


def repaired(df: DataFrame, within: Keys, seed: int = 0, key: str = "query_id") -> DataFrame:
    """key, other: a seeded permutation of the keys inside each group of `within`."""
    d = df.select(*within, key).distinct().withColumn("_h", F.xxhash64(F.col(key), F.lit(seed)))
    a = numbered(d, within, key, ["_h"], "_n")
    b = numbered(d, within, "_h", [key], "_n").select(*within, F.col(key).alias("other"), "_n")
    return attach(a.select(*within, key, "_n"), b, [*within, "_n"]).select(key, "other")


def decoded_curves(members: DataFrame, knn: DataFrame, counts: DataFrame, g: Keys, time: str, scheme: str = "gaussian_global", scale: float = 100.0, depth: DataFrame | None = None) -> DataFrame:
    """g, time, feature, value: pseudo-bulk curves of groups of queries, decoded between stages.

    members: g, time, query_id, weight, stage, part (see bracket_shares); weights are shared inside a group and time.
    knn: time, stage, query_id, ref_id, rank, distance, each query's neighbours in each of its stages; bandwidths are
    those of a time and stage. counts: ref_id, feature, value, absent ones 0. value is scale times the mean; with depth
    (ref_id, depth) it is the mean of counts over the mean of depth, taken apart between the stages and divided at the
    end (least depth 1e-30). Coefficients of reference rows are summed before they meet the sparse counts."""
    total = members.groupBy(*g, time, "stage").agg(F.sum("weight").alias("_t"))
    share = attach(members, total, [*g, time, "stage"]).withColumn("_share", F.col("weight") / F.greatest("_t", F.lit(1e-30)) * F.col("part"))
    w = neighbour_weights(knn.select(time, "stage", "query_id", "ref_id", "rank", "distance"), scheme, [time, "stage"])
    d = w.join(share.select(*g, time, "stage", "query_id", "_share"), [time, "stage", "query_id"])
    c = d.groupBy(*g, time, "ref_id").agg(F.sum(F.col("w") * F.col("_share")).alias("c"))
    if depth is None:
        return c.join(counts, "ref_id").groupBy(*g, time, "feature").agg((F.sum(F.col("c") * F.col("value")) * scale).alias("value"))
    c = settled(c)
    deep = c.join(depth, "ref_id").groupBy(*g, time).agg(F.sum(F.col("c") * F.col("depth")).alias("_depth"))
    sums = c.join(counts, "ref_id").groupBy(*g, time, "feature").agg(F.sum(F.col("c") * F.col("value")).alias("_s"))
    return attach(sums, deep, [*g, time]).select(*g, time, "feature", (F.col("_s") / F.greatest("_depth", F.lit(1e-30)) * scale).alias("value"))


def knn_smooth(df: DataFrame, value: str, k: int, on: Keys = (), vector: str = "x") -> DataFrame:
    """id, smoothed: the median of the value over a row's k nearest others."""
    near = knn_join_excluding(df, df, k, on, vector)
    values = df.select(F.col("id").cast("long").alias("ref_id"), F.col(value).alias("_v"))
    return near.join(values, "ref_id").groupBy(F.col("query_id").alias("id")).agg(F.expr("percentile(_v, 0.5)").alias("smoothed"))


def _standard(df: DataFrame, covariates: Keys, by: Keys) -> DataFrame:
    d = df
    for i, c in enumerate(covariates):
        d = standardized(d, by, c, f"_z{i}", 0.0)
    names = [f"_z{i}" for i in range(len(covariates))]
    return d.withColumn("x", F.array(*names)).drop(*names)


def match_controls(df: DataFrame, treated: str, covariates: Keys, by: Keys) -> DataFrame:
    """by, query_id, ref_id, distance: the nearest control, with replacement, of each treated row in its
    group, over z-scored covariates."""
    d = _standard(df, covariates, by)
    return knn_join(d.filter(treated), d.filter(~F.expr(treated)), 1, by).drop("rank")


def balance(df: DataFrame, matches: DataFrame, treated: str, covariates: Keys, by: Keys = ()) -> DataFrame:
    """by, covariate, n_treated, n_controls, n_matched (distinct controls used), smd_before, smd_after (standardized mean
    differences of the treated to all controls and to their matches, a match counted as often as it is used; 0 where
    the pooled deviation is below 1e-12), median_distance, greatest_distance (of matches). matches: as match_controls
    gives them. Groups without a treated or a control row have no row."""
    matches = settled(matches)
    each = F.explode(F.array(*[F.struct(F.lit(v).alias("covariate"), F.col(v).cast("double").alias("v")) for v in covariates])).alias("_c")
    t = F.expr(treated)
    long = lambda d, flag: d.select(*by, flag.alias("_t"), each).select(*by, "_t", "_c.covariate", "_c.v")
    used = df.join(matches.select(F.col("ref_id").alias("id")), "id")
    side = lambda c: [F.count(F.when(c, F.lit(1))), F.avg(F.when(c, F.col("v"))), F.var_pop(F.when(c, F.col("v")))]
    names = lambda n: [f"n_{n}", f"_m{n}", f"_v{n}"]
    before = long(df, t).groupBy(*by, "covariate").agg(*[a.alias(n) for c, s in ((F.col("_t"), "treated"), (~F.col("_t"), "controls")) for a, n in zip(side(c), names(s), strict=True)])
    after = long(used, F.lit(False)).groupBy(*by, "covariate").agg(F.avg("v").alias("_ma"), F.var_pop("v").alias("_va"))
    m = matches.groupBy(*by).agg(F.count_distinct("ref_id").alias("n_matched"), F.max("distance").alias("greatest_distance"))
    m = attach(m, quantiles(matches, by, "distance", {"median_distance": 0.5}), by)
    d = attach(attach(before.filter("n_treated > 0 and n_controls > 0"), after, [*by, "covariate"]), m, by)

    def smd(mean: str, var: str) -> Column:
        pooled = F.sqrt((F.col("_vtreated") + F.col(var)) / 2)
        return F.when(pooled < 1e-12, 0.0).otherwise((F.col("_mtreated") - F.col(mean)) / pooled)

    return d.select(*by, "covariate", "n_treated", "n_controls", "n_matched", smd("_mcontrols", "_vcontrols").alias("smd_before"), smd("_ma", "_va").alias("smd_after"), "median_distance", "greatest_distance")


def match_negatives(positives: DataFrame, candidates: DataFrame, covariates: Keys, n: int, by: Keys, most_rounds: int = 10_000) -> DataFrame:
    """by, query_id, ref_id: n candidates for each positive without reuse, nearest first over z-scored log covariates,
    positives served in order of their id. A positive looks among its max(8 n, 24) nearest.

    Deferred acceptance: in a round every positive with less than n candidates asks its next ones, and a candidate keeps
    the earliest that asked. As all candidates prefer in one order, this ends in the choice that serving positives one
    after another makes. A round is a join and an aggregate over proposals, so no group meets in one task."""
    logged = positives.withColumn("_p", F.lit(1)).unionByName(candidates.withColumn("_p", F.lit(0)))
    for c in covariates:
        logged = logged.withColumn(c, F.log1p(F.col(c).cast("double")))
    d = settled(_standard(logged, covariates, by))
    wanted = settled(knn_join(d.filter("_p = 1"), d.filter("_p = 0"), max(8 * n, 24), by).select(*by, "query_id", "ref_id", F.col("rank").cast("int").alias("rank")))
    asking = wanted.groupBy(*by, "query_id").agg(F.max("rank").alias("_last")).withColumns({"_from": F.lit(1), "_n": F.lit(n)})
    held = wanted.limit(0).select(*by, "ref_id", "query_id")
    for _ in range(most_rounds):
        asks = attach(asking, wanted, [*by, "query_id"]).filter("rank >= _from and rank < _from + _n").select(*by, "ref_id", "query_id")
        held = settled(held.unionByName(asks).groupBy(*by, "ref_id").agg(F.min("query_id").alias("query_id")))
        asking = asking.withColumn("_from", F.col("_from") + F.col("_n")).drop("_n")
        asking = attach(asking, held.groupBy(*by, "query_id").agg(F.count(F.lit(1)).alias("_h")), [*by, "query_id"])
        # a positive that has lost a candidate asks again from where it stopped
        asking = settled(asking.withColumn("_n", F.lit(n) - F.coalesce("_h", F.lit(0)).cast("int")).drop("_h"))
        if asking.filter("_n > 0 and _from <= _last").isEmpty():
            return held.select(*by, "query_id", "ref_id")
    raise RuntimeError("matching did not settle")


def low_overlap_aggregates(cells: DataFrame, k: int, cutoff: float, centres: int, seed: int = 0, on: Keys = (), most_rounds: int = 1000) -> DataFrame:
    """on, centre, ref_id: neighbourhoods of up to `centres` seeded centres of a group, accepted in the seeded order if
    they share at most `cutoff` of their members with each one accepted before.

    Centres that share more are joined on their members. In a round those are accepted that precede all undecided
    centres they conflict with, and those in conflict with them fall out; that gives what the sequential choice gives,
    in about as many rounds as the logarithm of the centres."""
    order = F.struct(F.xxhash64("id", F.lit(seed)).alias("h"), F.col("id").cast("long").alias("id"))
    chosen = top_n(cells.withColumn("_o", order), on, [F.col("_o")], centres, "_n").drop("_n")
    near = settled(attach(knn_join(chosen.drop("_o"), cells, k, on), chosen.select(*on, F.col("id").cast("long").alias("query_id"), "_o"), [*on, "query_id"]).select(*on, "query_id", "ref_id", "_o"))
    size = near.groupBy(*on, "query_id").agg(F.count(F.lit(1)).alias("_size"))
    a = near.select(*on, "ref_id", F.col("query_id").alias("a"), F.col("_o").alias("_oa"))
    b = near.select(*[F.col(c).alias(f"_k_{c}") for c in on], F.col("ref_id").alias("_r"), F.col("query_id").alias("b"), F.col("_o").alias("_ob"))
    same = (F.col("ref_id") == F.col("_r")) & (F.col("_oa") < F.col("_ob"))
    for c in on:
        same = same & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    shared = a.join(b, same).groupBy(*on, "a", "b").agg(F.count(F.lit(1)).alias("_s"))
    conflict = settled(attach(shared, size.withColumnRenamed("query_id", "b"), [*on, "b"]).filter(F.col("_s") > cutoff * F.col("_size")).select(*on, "a", "b"))
    named = lambda d, c: d.select(*on, F.col("query_id").alias(c))
    open_, accepted = settled(near.select(*on, "query_id").distinct()), []
    for _ in range(most_rounds):
        live = attach_inner(attach_inner(conflict, named(open_, "a"), [*on, "a"]), named(open_, "b"), [*on, "b"])
        blocked = live.select(*on, F.col("b").alias("query_id")).distinct().withColumn("_x", F.lit(1))
        new = settled(attach(open_, blocked, [*on, "query_id"]).filter("_x is null").drop("_x"))
        accepted.append(new)
        out = attach_inner(conflict, named(new, "a"), [*on, "a"]).select(*on, F.col("b").alias("query_id")).unionByName(new).distinct().withColumn("_x", F.lit(1))
        open_ = settled(attach(open_, out, [*on, "query_id"]).filter("_x is null").drop("_x"))
        if open_.isEmpty():
            every = reduce(DataFrame.unionByName, accepted)
            return attach_inner(near.select(*on, "query_id", "ref_id"), every, [*on, "query_id"]).withColumnRenamed("query_id", "centre").select(*on, "centre", "ref_id")
    raise RuntimeError("acceptance did not settle")


def attach_inner(left: DataFrame, right: DataFrame, keys: Keys) -> DataFrame:
    """Rows of left whose keys, null meeting null, occur in right (a table of keys)."""
    return attach(left, right.select(*keys).distinct().withColumn("_in", F.lit(1)), keys).filter("_in = 1").drop("_in")


def aggregate_profiles(aggregates: DataFrame, counts: DataFrame, on: Keys = ()) -> DataFrame:
    """on, centre, feature, value: the mean over an aggregate's members of counts (ref_id, feature, value; absent ones 0)."""
    size = aggregates.groupBy(*on, "centre").agg(F.count(F.lit(1)).alias("_n"))
    s = aggregates.join(counts, "ref_id").groupBy(*on, "centre", "feature").agg(F.sum("value").alias("_s"))
    return attach(s, size, [*on, "centre"]).select(*on, "centre", "feature", (F.col("_s") / F.col("_n")).alias("value"))


def aggregate_labels(aggregates: DataFrame, labels: DataFrame, on: Keys = ()) -> DataFrame:
    """on, centre, n, dominant (the most frequent label of the members, the first of equals), fraction of members with
    it, n_labels. labels: ref_id, label."""
    per = aggregates.join(labels, "ref_id").groupBy(*on, "centre", "label").agg(F.count(F.lit(1)).alias("_n"))
    best = F.min(F.struct((-F.col("_n")).alias("c"), "label"))
    d = per.groupBy(*on, "centre").agg(F.sum("_n").alias("n"), best.alias("_b"), F.count(F.lit(1)).alias("n_labels"))
    return d.select(*on, "centre", "n", F.col("_b.label").alias("dominant"), (-F.col("_b.c") / F.col("n")).alias("fraction"), "n_labels")


def joint_embedding(df: DataFrame, a: str, b: str, name: str = "joint") -> DataFrame:
    """id, joint: each block z-scored by coordinate, divided by the root of its width, concatenated."""

    def block(column: str) -> DataFrame:
        long = df.select("id", F.posexplode(column).alias("i", "v"))
        stats = long.groupBy("i").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
        packed = stats.agg(F.sort_array(F.collect_list(F.struct("i", "m", "s"))).alias("_st"))  # one row, a pair for each coordinate
        z = F.zip_with(F.col(column), F.col("_st"), lambda v, s: F.when(s["s"] > 0, (v - s["m"]) / s["s"]).otherwise(0.0) / F.sqrt(F.size("_st").cast("double")))
        return df.crossJoin(F.broadcast(packed)).select("id", z.alias(f"_{column}"))

    return block(a).join(block(b), "id").select("id", F.concat(f"_{a}", f"_{b}").alias(name))
