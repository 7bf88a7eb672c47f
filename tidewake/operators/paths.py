"""Trajectory, transition and mass accounting."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import Keys, pearson, ratio, top_n
from ..functions.lineage import settled
from . import clusters
from .composition import composition
from .features import auroc
from .ordering import attach, quantiles, ranked, standardized


def transition_matrix(prob: DataFrame, source: str = "source", target: str = "label", value: str = "prob", particle: str = "query_id") -> DataFrame:
    """source, target, value: mean target probability over the particles of a source label; a particle
    without a target counts as 0 there."""
    n = prob.groupBy(source).agg(F.count_distinct(particle).alias("_n"))
    return prob.groupBy(source, target).agg(F.sum(value).alias("_s")).join(n, source).select(F.col(source).alias("source"), F.col(target).alias("target"), (F.col("_s") / F.col("_n")).alias("value"))


def wide(matrix: DataFrame, rows: Keys, column: str, value: str, values: list) -> DataFrame:
    """The matrix with a column for each value of `column`, missing cells 0."""
    return matrix.groupBy(*rows).pivot(column, values).agg(F.first(value)).fillna(0.0)


def top_two_targets(matrix: DataFrame, source: str = "source", target: str = "target", value: str = "value") -> DataFrame:
    """top, second, their values and the margin; ties to the first name."""
    d = top_n(matrix, [source], [F.desc(F.round(value, 12)), F.col(target)], 2)
    pick = lambda c, r: F.max(F.when(F.col("rank") == r, F.col(c)))
    d = d.groupBy(source).agg(pick(target, 1).alias("top"), pick(target, 2).alias("second"), pick(value, 1).alias("top_value"), pick(value, 2).alias("second_value"))
    return d.withColumn("margin", F.col("top_value") - F.coalesce("second_value", F.lit(0.0)))


def lineage_mass(prob: DataFrame, rules: DataFrame, g: Keys, weight: str = "weight") -> DataFrame:
    """g, source: on, ambiguous and off lineage mass, weights renormalised inside the source. prob: g,
    source, target, prob, weight (one weight a particle); rules: source, target, class in compatible,
    ambiguous; anything else is off. Null where the source has no rule."""
    estimable = rules.select("source").distinct().withColumn("_known", F.lit(True))
    d = prob.join(rules, ["source", "target"], "left").join(estimable, "source", "left")
    m = F.col("prob") * F.col(weight)
    part = lambda c: F.when(F.first("_known", ignorenulls=True).isNotNull(), F.sum(F.when(c, m).otherwise(0.0)) / F.sum(m))
    c = F.coalesce(F.col("class"), F.lit("incompatible"))
    return d.groupBy(*g, "source").agg(part(c == "compatible").alias("on_lineage"), part(c == "ambiguous").alias("ambiguous"), part(c == "incompatible").alias("off_lineage"))


def named_set_fractions(comp: DataFrame, g: Keys, sets: dict[str, Keys]) -> DataFrame:
    """A column for each named label set, the sum of its shares, and its complement not_<name>."""
    columns = []
    for name, labels in sets.items():
        inside = F.sum(F.when(F.col("label").isin(*labels), F.col("share")).otherwise(0.0))
        columns += [inside.alias(name), (1 - inside).alias(f"not_{name}")]
    return comp.groupBy(*g).agg(*columns)


def spearman_by_group(df: DataFrame, g: Keys, x: str, y: str) -> DataFrame:
    """n, rho and the two-sided p by Student's t with n - 2 degrees of freedom; null below 3 rows."""
    from ..functions.tails import t_two_sided

    d = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    d = ranked(ranked(d, g, x, "_x"), g, y, "_y").groupBy(*g).agg(F.count(F.lit(1)).alias("n"), pearson(F.col("_x"), F.col("_y")).alias("rho"))
    d = d.withColumn("rho", F.when(F.col("n") >= 3, F.col("rho")))
    t = F.col("rho") * F.sqrt((F.col("n") - 2) / F.greatest(1 - F.col("rho") ** 2, F.lit(1e-300)))
    return d.withColumn("p", t_two_sided(t, (F.col("n") - 2).cast("double")))


def complete(df: DataFrame, left: Keys, right: Keys, values: Keys) -> DataFrame:
    """Every combination of the keys that occur, values of missing ones 0."""
    frame = df.select(*left).distinct().crossJoin(df.select(*right).distinct())
    return frame.join(df, [*left, *right], "left").fillna(0, subset=list(values))


def cohort_composition_by_step(labels: DataFrame, g: Keys, step: str, label: str) -> DataFrame:
    """Count, fraction and percent of every label at every step, absent ones with 0."""
    n = labels.groupBy(*g, step, label).agg(F.count(F.lit(1)).alias("n"))
    d = complete(n, [*g, step], [label], ["n"])
    share = F.col("n") / F.sum("n").over(Window.partitionBy(*g, step))
    return d.withColumn("fraction", share).withColumn("percent", 100 * share)


def route_correct_rate(labels: DataFrame, allowed: DataFrame, g: Keys, weight: str = "weight") -> DataFrame:
    """Plain and weighted share of rows whose (source, label) is allowed."""
    d = labels.join(allowed.select("source", "label").distinct().withColumn("_ok", F.lit(1.0)), ["source", "label"], "left").withColumn("_ok", F.coalesce("_ok", F.lit(0.0)))
    return d.groupBy(*g).agg(F.count(F.lit(1)).alias("n"), F.avg("_ok").alias("rate"), ratio(F.sum(F.col("_ok") * F.col(weight)), F.sum(weight)).alias("weighted_rate"))


def routing_over_time(labels: DataFrame, g: Keys, step: str, particle: str, label: str, target: str) -> DataFrame:
    """g: peak step (the first of equals) and share, terminal share, share of particles ever in the target."""
    hit = (F.col(label) == target).cast("double")
    by_step = labels.groupBy(*g, step).agg(F.avg(hit).alias("_s"))
    a = by_step.groupBy(*g).agg(F.min(F.struct((-F.col("_s")).alias("m"), F.col(step).alias("s"))).alias("_b"), F.max_by("_s", step).alias("terminal_share"))
    ever = labels.groupBy(*g, particle).agg(F.max(hit).alias("_e")).groupBy(*g).agg(F.avg("_e").alias("ever_share"))
    return a.join(ever, list(g)).select(*g, F.col("_b.s").alias("peak_step"), (-F.col("_b.m")).alias("peak_share"), "terminal_share", "ever_share")


def threshold_routing(prob: DataFrame, g: Keys, particle: str, labels: Keys, p: float) -> DataFrame:
    """n, hits (particles whose probability of the label set is p or more), percent and mean."""
    per = prob.groupBy(*g, particle).agg(F.sum(F.when(F.col("label").isin(*labels), F.col("prob")).otherwise(0.0)).alias("_p"))
    hit = (F.round("_p", 12) >= p).cast("int")
    return per.groupBy(*g).agg(F.count(F.lit(1)).alias("n"), F.sum(hit).alias("hits"), (100 * F.avg(hit)).alias("percent"), F.avg("_p").alias("mean"))


def soft_mass_decomposition(d: DataFrame, g: Keys, w0="w0", w1="w1", p0="p0", p1="p1") -> DataFrame:
    """change = transport + reweighting + closure, one row a particle with weights and probabilities at
    both stages. Either part is taken at the midpoint of the other: transport is the change of probability at the
    mean weight, reweighting the change of weight at the mean probability. local_share is the reweighting's part of
    the absolute parts."""
    w0, w1, p0, p1 = map(F.col, (w0, w1, p0, p1))
    change, transport, local = F.sum(w1 * p1 - w0 * p0), F.sum(0.5 * (w0 + w1) * (p1 - p0)), F.sum(0.5 * (p0 + p1) * (w1 - w0))
    out = d.groupBy(*g).agg(change.alias("change"), transport.alias("transport"), local.alias("reweighting"))
    out = out.withColumn("closure", F.col("change") - F.col("transport") - F.col("reweighting"))
    return out.withColumn("local_share", ratio(F.abs("reweighting"), F.abs("reweighting") + F.abs("transport")))


def hard_waterfall(d: DataFrame, g: Keys, target: str, l0="l0", l1="l1", w0="w0", w1="w1") -> DataFrame:
    """retained change, incoming final and outgoing initial mass of the target, and their sum."""
    a, b = F.col(l0) == target, F.col(l1) == target
    total = lambda c, v: F.sum(F.when(c, v).otherwise(0.0))
    out = d.groupBy(*g).agg(total(a & b, F.col(w1) - F.col(w0)).alias("retained"), total(~a & b, F.col(w1)).alias("incoming"), total(a & ~b, F.col(w0)).alias("outgoing"))
    return out.withColumn("change", F.col("retained") + F.col("incoming") - F.col("outgoing"))


def waterfall_routes(d: DataFrame, g: Keys, target: str, l0="l0", l1="l1", w0="w0", w1="w1") -> DataFrame:
    """Source to destination rows that touch the target, with their mass before, after and halfway."""
    d = d.filter((F.col(l0) == target) | (F.col(l1) == target))
    return d.groupBy(*g, l0, l1).agg(F.count(F.lit(1)).alias("n"), F.sum(w0).alias("initial"), F.sum(w1).alias("final"), F.sum(0.5 * (F.col(w0) + F.col(w1))).alias("midpoint"))


def interval_mass_table(decomposed: DataFrame, rows: Keys, method: str, methods: list, parts: Keys) -> DataFrame:
    """One row for each of `rows`, columns <method>_<part> in percentage points."""
    d = decomposed.groupBy(*rows).pivot(method, methods).agg(*[F.first(100 * F.col(p)).alias(p) for p in parts])
    return d.select(*rows, *[F.col(f"{m}_{p}").alias(f"m{m}_{p}") for m in methods for p in parts])


def consensus_paths(rna: DataFrame, atac: DataFrame, g: Keys, particle: str) -> DataFrame:
    """first, last: particles whose first and last labels agree in both modalities; count and share of all.
    Both: g, particle, first, last."""
    r, a = rna.select(*g, particle, F.col("first").alias("first"), F.col("last").alias("last")), atac.select(*g, particle, F.col("first").alias("_f"), F.col("last").alias("_l"))
    n = rna.groupBy(*g).agg(F.count_distinct(particle).alias("_n"))
    d = r.join(a, [*g, particle]).filter("first = _f and last = _l").groupBy(*g, "first", "last").agg(F.count(F.lit(1)).alias("n"))
    return d.join(n, list(g)).select(*g, "first", "last", "n", (F.col("n") / F.col("_n")).alias("share"))


def first_last_change(df: DataFrame, g: Keys, time: str, value: str, expected: str | None = None) -> DataFrame:
    """g (which includes a column modality, if there are several), first, last, change = last - first value of each
    group, and agrees: its sign is that of the column `expected` (1, without one; a change of 0 never agrees)."""
    sign = F.lit(1.0) if expected is None else F.first(expected).cast("double")
    d = df.groupBy(*g).agg(F.min_by(value, time).alias("first"), F.max_by(value, time).alias("last"), F.signum(sign).alias("_e")).withColumn("change", F.col("last") - F.col("first"))
    return d.withColumn("agrees", F.coalesce((F.signum("change") == F.col("_e")) & (F.col("change") != 0), F.lit(False))).drop("_e")


def change_agreement(changes: DataFrame, keys: Keys, modality: str, g: Keys) -> DataFrame:
    """g, n, accuracy (share of changes with the expected sign), paired (items, by `keys`, that have two modalities or
    more), same_sign (share of these whose changes all have one sign), both_agree (share whose changes all agree).
    changes: as first_last_change gives them, a row for each of keys and modality; g is part of keys."""
    per = changes.groupBy(*keys).agg(F.count_distinct(modality).alias("_m"), F.count(F.lit(1)).alias("_n"), F.sum(F.col("agrees").cast("int")).alias("_a"), (F.min(F.signum("change")) == F.max(F.signum("change"))).alias("_s"), F.min("agrees").alias("_b"))
    two = F.col("_m") >= 2
    share = lambda c: F.avg(F.when(two, F.col(c).cast("double")))
    return per.groupBy(*g).agg(F.sum("_n").alias("n"), ratio(F.sum("_a").cast("double"), F.sum("_n")).alias("accuracy"), F.count_if(two).alias("paired"), share("_s").alias("same_sign"), share("_b").alias("both_agree"))


def cross_modal_consistency(a: DataFrame, b: DataFrame, g: Keys, particle: str = "query_id", unknown: str = "Unknown") -> DataFrame:
    """Mean and median over particles of 1 - JSD (base 2) between label probabilities (label, prob) over the
    known labels, and the mean unknown probability of either side."""
    x, y = a.withColumnRenamed("prob", "_a"), b.withColumnRenamed("prob", "_b")
    d = x.join(y, [*g, particle, "label"], "outer").fillna(0.0, ["_a", "_b"])
    w = Window.partitionBy(*g, particle)
    known = F.col("label") != unknown
    u = d.groupBy(*g, particle).agg(F.sum(F.when(~known, F.col("_a")).otherwise(0.0)).alias("_ua"), F.sum(F.when(~known, F.col("_b")).otherwise(0.0)).alias("_ub"))
    k = d.filter(known).withColumn("_p", ratio(F.col("_a"), F.sum("_a").over(w))).withColumn("_q", ratio(F.col("_b"), F.sum("_b").over(w))).withColumn("_m", (F.col("_p") + F.col("_q")) / 2)
    term = lambda c: F.when(F.col(c) > 0, F.col(c) * F.log2(F.col(c) / F.col("_m"))).when(F.col(c) == 0, 0.0)
    per = k.groupBy(*g, particle).agg((1 - F.sum(term("_p") + term("_q")) / 2).alias("_c")).join(u, [*g, particle], "right")
    per = settled(per)
    means = per.groupBy(*g).agg(F.avg("_c").alias("mean"), F.avg("_ua").alias("unknown_a"), F.avg("_ub").alias("unknown_b"))
    return attach(means, quantiles(per, g, "_c", {"median": 0.5}), g).select(*g, "mean", "median", "unknown_a", "unknown_b")


def fate_concordance(df: DataFrame, g: Keys, a: str, b: str, w: str, confident: float = 0.8) -> DataFrame:
    """From two columns of logits: weighted Pearson, and Spearman as that of the average ranks, mean binary JSD,
    agreement, chance, Cohen's kappa, the mass that is confident on both sides, the mass confident of opposite
    fates, and the second as a share of the first (null if there is none)."""
    d = ranked(ranked(df, g, a, "_ra"), g, b, "_rb").withColumn("_a", 1 / (1 + F.exp(-F.col(a)))).withColumn("_b", 1 / (1 + F.exp(-F.col(b))))
    h = lambda p: -p * F.log2(p) - (1 - p) * F.log2(1 - p)
    a_, b_ = (F.greatest(F.least(F.col(c), F.lit(1 - 1e-12)), F.lit(1e-12)) for c in ("_a", "_b"))
    d = d.withColumn("_j", h((a_ + b_) / 2) - (h(a_) + h(b_)) / 2).withColumn("_fa", (F.col("_a") >= 0.5).cast("double")).withColumn("_fb", (F.col("_b") >= 0.5).cast("double"))
    mean = lambda c: F.sum(F.col(w) * c) / F.sum(w)
    sure = ((F.col("_a") >= confident) | (F.col("_a") <= 1 - confident)) & ((F.col("_b") >= confident) | (F.col("_b") <= 1 - confident))
    out = d.groupBy(*g).agg(
        pearson(F.col(a), F.col(b), F.col(w)).alias("pearson"), pearson(F.col("_ra"), F.col("_rb"), F.col(w)).alias("spearman"), mean(F.col("_j")).alias("jsd"), mean((F.col("_fa") == F.col("_fb")).cast("double")).alias("agreement"),
        mean(F.col("_fa")).alias("_ma"), mean(F.col("_fb")).alias("_mb"), mean(sure.cast("double")).alias("confident_mass"), mean((sure & (F.col("_fa") != F.col("_fb"))).cast("double")).alias("opposite_mass"),
    )
    out = out.withColumn("chance", F.col("_ma") * F.col("_mb") + (1 - F.col("_ma")) * (1 - F.col("_mb")))
    out = out.withColumn("confident_discordance", F.when(F.col("confident_mass") > 1e-12, F.col("opposite_mass") / F.col("confident_mass")))
    return out.withColumn("kappa", F.when(F.col("chance") < 1 - 1e-12, (F.col("agreement") - F.col("chance")) / (1 - F.col("chance")))).drop("_ma", "_mb")


def displacement_grid(steps: DataFrame, particle: str, time: str, x: str, y: str, bins: int, limits: tuple[float, float] = (0.0, 1.0)) -> DataFrame:
    """bx, by, n, u, v, speed on a grid between the given percentiles of the start points; all cells, empty
    ones with 0."""
    w = Window.partitionBy(particle).orderBy(time)
    d = steps.withColumn("_u", F.lead(x).over(w) - F.col(x)).withColumn("_v", F.lead(y).over(w) - F.col(y)).filter("_u is not null")
    edges = [quantiles(d, [], c, {f"_{n}{i}": p for i, p in enumerate(limits)}) for n, c in (("x", x), ("y", y))]
    d = d.crossJoin(F.broadcast(edges[0])).crossJoin(F.broadcast(edges[1])).filter(f"{x} between _x0 and _x1 and {y} between _y0 and _y1")
    place = lambda c, n: F.least(F.floor((F.col(c) - F.col(f"_{n}0")) / (F.col(f"_{n}1") - F.col(f"_{n}0")) * bins), F.lit(bins - 1)).cast("int")
    cells = d.groupBy(place(x, "x").alias("bx"), place(y, "y").alias("by")).agg(F.count(F.lit(1)).alias("n"), F.avg("_u").alias("u"), F.avg("_v").alias("v"))
    axis = steps.sparkSession.range(bins)
    grid = axis.select(F.col("id").cast("int").alias("bx")).crossJoin(axis.select(F.col("id").cast("int").alias("by")))
    return grid.join(cells, ["bx", "by"], "left").fillna(0).withColumn("speed", F.sqrt(F.col("u") ** 2 + F.col("v") ** 2))


def common_retained(a: DataFrame, b: DataFrame, keys: Keys, g: Keys, sample: str, least_n: int, least_sample: int) -> DataFrame:
    """By g: rows retained by both, samples with at least least_sample of them, and whether the cohort is
    valid (least_n rows and two such samples)."""
    d = a.select(*keys, sample).join(b.select(*keys), list(keys)) if sample not in keys else a.join(b.select(*keys), list(keys))
    s = d.groupBy(*g, sample).agg(F.count(F.lit(1)).alias("_n"))
    out = s.groupBy(*g).agg(F.sum("_n").alias("n"), F.sum((F.col("_n") >= least_sample).cast("int")).alias("samples"))
    return out.withColumn("valid", (F.col("n") >= least_n) & (F.col("samples") >= 2))


def coverage_categories(hits: DataFrame, g: Keys, a: str, b: str, threshold: float) -> DataFrame:
    """Counts of both, a only, b only, neither by g, where a hit is a value at or above the threshold."""
    ha, hb = F.coalesce(F.col(a), F.lit(0.0)) >= threshold, F.coalesce(F.col(b), F.lit(0.0)) >= threshold
    c = F.when(ha & hb, "both").when(ha, "a only").when(hb, "b only").otherwise("neither")
    return hits.groupBy(*g, c.alias("category")).agg(F.count(F.lit(1)).alias("n"))


def common_and_extra_support(hits: DataFrame, unit: Keys, g: Keys, method: str) -> DataFrame:
    """g, method: hits of the method, those common to all methods, and the extra ones. hits: unit, g,
    method, hit (boolean), a row for each unit and method."""
    common = F.min("hit").over(Window.partitionBy(*unit))
    d = hits.withColumn("_c", common & F.col("hit"))
    n = lambda c: F.sum(c.cast("int"))
    return d.groupBy(*g, method).agg(n(F.col("hit")).alias("hits"), n(F.col("_c")).alias("common"), n(F.col("hit") & ~F.col("_c")).alias("extra"))


def substates(cells: DataFrame, g: Keys, ks: list[int], seed: int = 0, vector: str = "x", starts: int = 10) -> DataFrame:
    """g, k, id, substate: k-means inside each group over z-scored coordinates (flat ones 0), for each k; the best of
    `starts` by inertia. Rows of a group are packed in blocks, and no task holds a group (see clusters.fit)."""
    long = cells.select(*g, F.posexplode(vector).alias("i", "v")).groupBy(*g, "i").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
    stats = long.groupBy(*g).agg(F.sort_array(F.collect_list(F.struct("i", "m", "s"))).alias("_st"))  # a pair for each coordinate
    z = F.zip_with(F.col(vector), F.col("_st"), lambda v, s: F.when(s["s"] > 0, (v - s["m"]) / s["s"]).otherwise(0.0))
    blocks = settled(clusters.packed(attach(cells.select(*g, "id", vector), stats, g).select(*g, "id", z.alias("x")), g, key="id"))
    out = [clusters.assigned(blocks, clusters.fit(blocks, g, k, seed, starts), g).select(*g, F.lit(k).alias("k"), "id", F.col("cluster").alias("substate")) for k in ks]
    return reduce(DataFrame.unionByName, out)


def substate_audit(cells: DataFrame, g: Keys, ks: list[int], repeats: int = 5, seed: int = 0, vector: str = "x", starts: int = 10) -> DataFrame:
    """g, k, n, least, greatest (sizes of substates), least_fraction, and the mean and least adjusted Rand index of the
    substates against those of `repeats` other seeds. A substate without rows counts as 0."""
    base = settled(substates(cells, g, ks, seed, vector, starts))
    other = [substates(cells, g, ks, seed + 1 + r, vector, starts).withColumn("repeat", F.lit(r)) for r in range(repeats)]
    ari = rand_index(base.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1)))), reduce(DataFrame.unionByName, other), [*g, "k", "repeat"])
    ari = ari.groupBy(*g, "k").agg(F.avg("ari").alias("mean_ari"), F.min("ari").alias("least_ari"))
    s = base.groupBy(*g, "k", "substate").agg(F.count(F.lit(1)).alias("_n")).groupBy(*g, "k").agg(F.sum("_n").alias("n"), F.min("_n").alias("_l"), F.max("_n").alias("greatest"), F.count(F.lit(1)).alias("_c"))
    s = s.withColumn("least", F.when(F.col("_c") < F.least("k", "n"), 0).otherwise(F.col("_l")))
    return attach(s.select(*g, "k", "n", "least", "greatest", (F.col("least") / F.col("n")).alias("least_fraction")), ari, [*g, "k"])


def rand_index(a: DataFrame, b: DataFrame, g: Keys, key: str = "id", label: str = "substate") -> DataFrame:
    """Adjusted Rand index of two labellings, from the contingency table."""
    t = a.select(*g, key, F.col(label).alias("_a")).join(b.select(*g, key, F.col(label).alias("_b")), [*g, key]).groupBy(*g, "_a", "_b").agg(F.count(F.lit(1)).alias("_n"))
    two = lambda c: c * (c - 1) / 2
    side = lambda c: t.groupBy(*g, c).agg(F.sum("_n").alias("_n")).groupBy(*g).agg(F.sum(two(F.col("_n"))).alias(f"_s{c}"))
    d = t.groupBy(*g).agg(F.sum(two(F.col("_n"))).alias("_s"), two(F.sum("_n")).alias("_t")).join(side("_a"), list(g)).join(side("_b"), list(g))
    expected, most = F.col("_s_a") * F.col("_s_b") / F.col("_t"), (F.col("_s_a") + F.col("_s_b")) / 2
    return d.select(*g, F.when(most == expected, 1.0).otherwise((F.col("_s") - expected) / (most - expected)).alias("ari"))


def substate_support(reference: DataFrame, predicted: DataFrame, g: Keys, threshold: float = 0.5) -> DataFrame:
    """g, substate, n, soft_recall (mean hit), recall (share of hits at or above the threshold), precision (supported
    share of the predicted weight; null without any) and f1 (of recall and precision; null without either or at 0).
    reference: g, substate, hit (0..1), a row for each observed row; predicted: g, substate, weight, supported (boolean)."""
    per = reference.groupBy(*g, "substate").agg(F.count(F.lit(1)).alias("n"), F.avg("hit").alias("soft_recall"), F.avg((F.col("hit") >= threshold).cast("double")).alias("recall"))
    p = predicted.groupBy(*g, "substate").agg(ratio(F.sum(F.col("weight") * F.col("supported").cast("double")), F.sum("weight")).alias("precision"))
    d = per.join(p, [*g, "substate"], "left")
    return d.withColumn("f1", ratio(2 * F.col("recall") * F.col("precision"), F.col("recall") + F.col("precision")))


def substate_metrics(reference: DataFrame, predicted: DataFrame, g: Keys, threshold: float = 0.5, within: Keys = ()) -> DataFrame:
    """Means over substates of soft recall, recall, precision and f1 (see substate_support; null ones left out), the
    mean recall of the rarest substate (the first, of equals) and of the JSD (base 2) between the substates' shares of
    observed rows and of predicted weight. `within` (a cell type) holds substates of its own: the rarest and the
    shares are taken in each and then averaged. The JSD is null where nothing is predicted."""
    inner = [*g, *within]
    per = substate_support(reference, predicted, inner, threshold)
    mean = [F.avg(c).alias(c) for c in ("soft_recall", "recall", "precision", "f1")]
    rarest = per.groupBy(*inner).agg(F.min_by("recall", F.struct("n", "substate")).alias("_r")).groupBy(*g).agg(F.avg("_r").alias("rarest_recall"))
    o = composition(reference, inner, "substate", name="_p")
    q = composition(predicted.filter("weight > 0"), inner, "substate", "weight", name="_q")
    any_ = q.select(*inner).distinct().withColumn("_any", F.lit(True))
    d = o.join(q, [*inner, "label"], "left").fillna(0.0, ["_q"]).withColumn("_m", (F.col("_p") + F.col("_q")) / 2)
    term = lambda c: F.when(F.col(c) > 0, F.col(c) * F.log2(F.col(c) / F.col("_m"))).otherwise(0.0)
    apart = d.groupBy(*inner).agg((F.sum(term("_p") + term("_q")) / 2).alias("_j")).join(any_, inner, "left").withColumn("_j", F.when(F.col("_any"), F.col("_j")))
    apart = apart.groupBy(*g).agg(F.avg("_j").alias("composition_jsd"))
    return per.groupBy(*g).agg(*mean).join(rarest, list(g)).join(apart, list(g))


def top_programs_per_substate(scores: DataFrame, type_: Keys, substate: str, program: str, value: str, n: int = 5) -> DataFrame:
    """The n programs of highest mean within-type z score in each substate."""
    d = standardized(scores, [*type_, program], value, "_z", 0.0).groupBy(*type_, substate, program).agg(F.avg("_z").alias("mean_z"))
    return top_n(d, [*type_, substate], [F.desc(F.round("mean_z", 9)), F.col(program)], n)


def flow_share_table(scores: DataFrame, columns: Keys, tolerance: float = 1e-8) -> DataFrame:
    """The rows as they are; fails if a row's shares do not sum to 1."""
    total = sum((F.col(c) for c in columns[1:]), F.col(columns[0]))
    return scores.filter(F.assert_true(F.abs(total - 1) <= tolerance, "shares of a row do not sum to 1").isNull())


def fate_by_vote(knn: DataFrame, labels: DataFrame, positive: str) -> DataFrame:
    """query_id, fate (whether half or more of the neighbours bear the label `positive`), confidence (the share of the
    larger side). knn: neighbours of terminal points among reference rows of the two fates; labels: ref_id, label."""
    share = knn.join(labels, "ref_id").groupBy("query_id").agg(F.avg((F.col("label") == positive).cast("double")).alias("_p"))
    return share.select("query_id", (F.col("_p") >= 0.5).alias("fate"), F.greatest("_p", 1 - F.col("_p")).alias("confidence"))


def fate_margin_dynamics(scores: DataFrame, fates: DataFrame, g: Keys, particle: str, step: str, a: str, b: str) -> DataFrame:
    """Weighted means over particles: terminal_margin, gain over the path, rising_steps (share of steps on which the
    margin does not fall), fate_share, confidence; and the weighted AUROC of the score at the first and at the second
    step for the fate. scores: g, particle, step, programs a and b; fates: g, particle, fate, confidence, weight (see
    fate_by_vote). The score is a - b, the margin its value for particles of that fate and its negative for others."""
    d = scores.join(fates.select(*g, particle, "fate", "confidence", F.col("weight").cast("double").alias("_w")), [*g, particle]).withColumn("_s", F.col(a) - F.col(b))
    path = Window.partitionBy(*g, particle).orderBy(step)
    d = d.withColumn("_m", F.when(F.col("fate"), F.col("_s")).otherwise(-F.col("_s"))).withColumn("_i", F.row_number().over(path))
    d = d.withColumn("_up", (F.col("_m") >= F.lag("_m").over(path)).cast("double"))
    at = lambda i: F.max(F.when(F.col("_i") == i, F.col("_s")))
    per = d.groupBy(*g, particle).agg(
        F.max_by("_m", step).alias("_last"), F.min_by("_m", step).alias("_first"), F.avg("_up").alias("_rise"), F.first("_w").alias("_w"), F.first("fate").alias("_fate"), F.first("confidence").alias("_c"), at(1).alias("_s1"), at(2).alias("_s2")
    )
    per = settled(per)
    mean = lambda c: ratio(F.sum(F.col("_w") * c), F.sum("_w"))
    out = per.groupBy(*g).agg(mean(F.col("_last")).alias("terminal_margin"), mean(F.col("_last") - F.col("_first")).alias("gain"), mean(F.col("_rise")).alias("rising_steps"), mean(F.col("_fate").cast("double")).alias("fate_share"), mean(F.col("_c")).alias("confidence"))
    for s, name in (("_s1", "initial_auroc"), ("_s2", "early_auroc")):
        out = attach(out, auroc(per, g, s, "_fate", "_w").select(*g, F.col("auroc").alias(name)), g)
    return out


def fate_agreement(a: DataFrame, b: DataFrame, g: Keys, particle: str, label: str, weight: str) -> DataFrame:
    """g, n, agreement: the weighted share of particles whose fate is one in both modalities; weights are a's."""
    d = a.select(*g, particle, F.col(label).alias("_a"), F.col(weight).alias("_w")).join(b.select(*g, particle, F.col(label).alias("_b")), [*g, particle])
    return d.groupBy(*g).agg(F.count(F.lit(1)).alias("n"), ratio(F.sum(F.col("_w") * (F.col("_a") == F.col("_b")).cast("double")), F.sum("_w")).alias("agreement"))


def leakage_fractions(votes: DataFrame, sets: DataFrame, g: Keys, k: int, weight: str = "weight") -> DataFrame:
    """g, set, fraction: weighted share of the k neighbour votes (one row each, with label and weight) that
    fall in each set (set, label)."""
    total = votes.groupBy(*g).agg(F.sum(F.col(weight) / k).alias("_t"))
    d = votes.join(sets, "label").groupBy(*g, "set").agg(F.sum(F.col(weight) / k).alias("_s"))
    return d.join(total, list(g)).select(*g, "set", ratio(F.col("_s"), F.col("_t")).alias("fraction"))
