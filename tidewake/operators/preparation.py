"""Input preparation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import Keys, short_table, top_n
from .ordering import attach, numbered, running_totals


def stack_time_blocks(blocks: list[DataFrame], stages: list[str], order: str, prefix: str = "cell") -> DataFrame:
    """The stages' blocks stacked, with time_index, stage, row_in_time (from 0, by `order`) and a generated
    id prefix_00001 that counts through all blocks. Rows of a stage are numbered inside their stage, in cells of the
    order, which is a number."""
    parts = [b.withColumn("time_index", F.lit(i)).withColumn("stage", F.lit(s)) for i, (b, s) in enumerate(zip(blocks, stages))]
    d = numbered(reduce(DataFrame.unionByName, parts), ["time_index"], order, [order], "row_in_time").withColumn("row_in_time", F.col("row_in_time") - 1)
    sizes = d.groupBy("time_index").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.withColumn("_b", F.coalesce(F.sum("_n").over(Window.orderBy("time_index").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row a stage
    d = d.join(F.broadcast(before.select("time_index", "_b")), "time_index")
    return d.withColumn("cell_id", F.format_string(prefix + "_%05d", (F.col("_b") + F.col("row_in_time") + 1).cast("long"))).drop("_b")


def scale_latent(df: DataFrame, scale: float, vector: str = "x") -> DataFrame:
    """The vector over a finite, positive scale."""
    if not 0 < scale < float("inf"):
        raise ValueError("scale must be finite and positive")
    return df.withColumn(vector, F.transform(vector, lambda v: v / scale))


def audit_pairing(a: DataFrame, b: DataFrame, key: str, columns: Keys, value: str) -> DataFrame:
    """One row: rows of both, keys only on one side, repeated keys, differing annotations, values that are
    not finite, the largest absolute difference of the value."""
    l, r = a.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_l_{c}") for c in [*columns, value]]), b.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_r_{c}") for c in [*columns, value]])  # noqa: E741
    n = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long"))
    per = lambda df, s: df.groupBy("_k").agg(F.count(F.lit(1)).alias(f"_n{s}"), *[F.first(c).alias(c) for c in df.columns if c != "_k"])
    d = per(l, "l").join(per(r, "r"), "_k", "full_outer")
    differ = reduce(lambda x, y: x | y, [~F.col(f"_l_{c}").eqNullSafe(F.col(f"_r_{c}")) for c in columns], F.lit(False))
    both = F.col("_nl").isNotNull() & F.col("_nr").isNotNull()
    bad = lambda c: F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf"))
    return d.agg(
        F.sum(F.coalesce("_nl", F.lit(0))).alias("rows_a"), F.sum(F.coalesce("_nr", F.lit(0))).alias("rows_b"), n(F.col("_nr").isNull()).alias("only_a"), n(F.col("_nl").isNull()).alias("only_b"),
        n((F.col("_nl") > 1) | (F.col("_nr") > 1)).alias("repeated"), n(both & differ).alias("differing"), n(bad(F.col(f"_l_{value}")) | bad(F.col(f"_r_{value}"))).alias("not_finite"), F.max(F.abs(F.col(f"_l_{value}") - F.col(f"_r_{value}"))).alias("max_difference"),
    )


def mark_splits(cells: DataFrame, splits: dict[str, list[int]]) -> DataFrame:
    """A boolean train_<name> for each split: whether time_index is one of its times."""
    return cells.withColumns({f"train_{n}": F.col("time_index").isin(*times) for n, times in splits.items()})


def leave_one_time_out(cells: DataFrame, held_out: float, time: str = "time", reverse: bool = False) -> dict[str, DataFrame]:
    """train (with rank 0..K-1), heldout (with its fractional rank between the neighbouring times), initial
    and terminal rows. The held-out time must lie strictly between the ends. Held-out rows never touch the
    training rows: ranks come from the other times alone."""
    train = cells.filter(F.col(time) != held_out)
    times = train.select(time).distinct()
    w = Window.orderBy(F.desc(time) if reverse else F.col(time))  # a row a time
    ranks = times.withColumn("rank", (F.dense_rank().over(w) - 1).cast("double"))
    train = train.join(F.broadcast(ranks), time)
    k = ranks.withColumn("_t2", F.lead(time).over(Window.orderBy(time))).withColumn("_r2", F.lead("rank").over(Window.orderBy(time)))
    k = k.filter((F.col(time) < held_out) & (F.col("_t2") > held_out)).select((F.col("rank") + (held_out - F.col(time)) / (F.col("_t2") - F.col(time)) * (F.col("_r2") - F.col("rank"))).alias("rank"))
    inside = k.agg(F.max("rank").alias("rank")).filter(F.assert_true(F.col("rank").isNotNull(), "the held-out time must lie between the others").isNull())
    top = ranks.agg(F.max("rank").alias("_top"))
    return {
        "train": train,
        "heldout": cells.filter(F.col(time) == held_out).crossJoin(F.broadcast(inside)),
        "initial": train.filter("rank = 0"),
        "terminal": train.join(F.broadcast(top), F.col("rank") == F.col("_top")).drop("_top"),
    }


def replicate_to_counts(cells: DataFrame, targets: DataFrame, stage: str = "stage", key: str = "id", seed: int = 0, below: str = "reject") -> DataFrame:
    """Every stage's rows repeated, in a seeded order, to exactly its target (stage, target); adds copy. A target below
    the stage's rows fails ('reject'), or takes the first so many rows of the order ('take')."""
    d = numbered(cells.withColumn("_h", F.xxhash64(key, F.lit(seed))), [stage], "_h", [key], "_o", "_n").withColumn("_o", F.col("_o") - 1).drop("_h").join(targets, stage)
    if below == "reject":
        d = d.filter(F.assert_true(F.col("target") >= F.col("_n"), "a target is below its stage's rows").isNull())
    copies = F.floor(F.col("target") / F.col("_n")) + F.when(F.col("_o") < F.col("target") % F.col("_n"), 1).otherwise(0)
    d = d.withColumn("_k", copies.cast("long")).filter("_k > 0")
    return d.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_k") - 1))).drop("_o", "_n", "_k", "target")


def linspace_subsample(df: DataFrame, g: Keys, order: Keys, k: int) -> DataFrame:
    """The rows at round(linspace(0, n - 1, k)) of each group in order (its first key a number); all if there are no more
    than k. Rows are numbered in cells."""
    d = numbered(df, g, order[0], order[1:] or order, "_r", "_n").withColumn("_r", F.col("_r") - 1)
    if k == 1:
        return d.filter("_r = 0").drop("_r", "_n")
    near = F.bround(F.col("_r") * (k - 1) / (F.col("_n") - 1))
    hit = reduce(lambda a, b: a | b, [F.bround((near + i) * (F.col("_n") - 1) / (k - 1)) == F.col("_r") for i in (-1, 0, 1)])
    return d.filter((F.col("_n") <= k) | hit).drop("_r", "_n")


def stratified_sample(df: DataFrame, g: Keys, n: int, key: str, seed: int = 0) -> DataFrame:
    """Exactly n rows of each group, by a seeded hash of the key; fails if a group is short."""
    d = attach(df, df.groupBy(*g).agg(F.count(F.lit(1)).alias("_n")), g).filter(F.assert_true(F.col("_n") >= n, "a group is short").isNull()).withColumn("_o", F.xxhash64(key, F.lit(seed)))
    return top_n(d, g, [F.col("_o"), F.col(key)], n, "_r").drop("_n", "_o", "_r")


def systematic_resample(particles: DataFrame, g: Keys, n: int, key: str, weight: str = "weight") -> DataFrame:
    """n draws of each group at the cumulative masses (i + 0.5) / n in order of a numeric key, one a row; adds draw. A row
    is expanded to the draws between its cumulative bounds, so no range join is needed; masses are totalled in cells."""
    mass = running_totals(particles.groupBy(*g, key).agg(F.sum(weight).cast("double").alias("_m")), g, key, ["_m"])
    bound = lambda c: F.round(c / F.col("_m_all"), 12)
    d = attach(particles, mass.select(*g, key, bound(F.col("_m_upto")).alias("_u"), bound(F.col("_m_upto") - F.col("_m")).alias("_l")), [*g, key])
    first, last = F.ceil(F.col("_l") * n - 0.5), F.ceil(F.col("_u") * n - 0.5) - 1
    d = d.withColumn("_f", first).withColumn("_t", last).filter("_t >= _f")
    return d.withColumn("draw", F.explode(F.sequence("_f", "_t"))).drop("_u", "_l", "_f", "_t")


def interpolate_at(trajectory: DataFrame, queries: DataFrame, particle: Keys, time: str = "t", vector: str = "x", outside: str = "clamp") -> DataFrame:
    """particle, q, x: linear interpolation of arrays between the knots around each query time (column q, for all
    particles; no more than MOST_BROADCAST of them); exact at knots; outside 'clamp' or 'reject' (fails)."""
    d = trajectory.select(*particle, F.col(time).cast("double").alias("_t"), F.col(vector).alias("_x"))
    wt = Window.partitionBy(*particle).orderBy("_t")
    d = d.withColumn("_t2", F.lead("_t").over(wt)).withColumn("_x2", F.lead("_x").over(wt)).withColumn("_first", F.row_number().over(wt) == 1)
    q = F.col("q")
    inside = (F.col("_t") <= q) & ((q < F.col("_t2")) | (F.col("_t2").isNull() & (F.lit(outside == "clamp") | (q == F.col("_t")))))
    early = F.col("_first") & (q < F.col("_t"))
    j = d.join(short_table(queries.select(F.col("q").cast("double").alias("q")), "query times"), inside | early)
    if outside == "reject":
        j = j.filter(F.assert_true(~early, "a query time lies outside").isNull())
    f = F.when(early | F.col("_t2").isNull(), 0.0).otherwise((q - F.col("_t")) / (F.col("_t2") - F.col("_t")))
    x = F.when(F.col("_x2").isNull(), F.col("_x")).otherwise(F.zip_with("_x", "_x2", lambda a, b: a + (b - a) * F.col("_w")))
    return j.withColumn("_w", f).select(*particle, "q", x.alias("x"))


def remap_time_axis(times: DataFrame, knots: DataFrame, column: str = "rank", source: str = "rank", target: str = "time") -> DataFrame:
    """Adds the other clock by piecewise-linear interpolation between (rank, time) knots, clamped; there
    are no more than MOST_BROADCAST knots."""
    k = knots.select(F.col(source).cast("double").alias("_a"), F.col(target).cast("double").alias("_b"))
    wk = Window.orderBy("_a")
    k = short_table(k, "knots").withColumn("_a2", F.lead("_a").over(wk)).withColumn("_b2", F.lead("_b").over(wk)).withColumn("_first", F.row_number().over(wk) == 1)
    v = F.col(column)
    on = ((F.col("_a") <= v) & (F.col("_a2").isNull() | (v < F.col("_a2")))) | (F.col("_first") & (v < F.col("_a")))
    f = F.when((v < F.col("_a")) | F.col("_a2").isNull(), F.col("_b")).otherwise(F.col("_b") + (v - F.col("_a")) / (F.col("_a2") - F.col("_a")) * (F.col("_b2") - F.col("_b")))
    return times.join(F.broadcast(k), on).withColumn(target, f).drop("_a", "_b", "_a2", "_b2", "_first")


def nearest_step(steps: DataFrame, g: Keys, step: str, time: str, at: Column | float) -> DataFrame:
    """The step of each group whose time is nearest, ties to the lower step."""
    gap = F.abs(F.col(time) - at)
    return steps.groupBy(*g).agg(F.min(F.struct(F.round(gap, 12).alias("d"), F.col(step).alias("s")))["s"].alias(step))
