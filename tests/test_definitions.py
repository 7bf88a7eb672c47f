"""Operators without SQL against plain loops over their definitions; bounds of what is broadcast."""

import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewake.functions import columns
from tidewake.operators import composition as D
from tidewake.operators import curves as C
from tidewake.operators import features as X
from tidewake.operators import paths as T
from tidewake.operators import preparation as P
from tidewake.operators import results as R


def t_two_sided(t, df):
    """The density of Student's t summed over a fine grid of the angle atan(t / sqrt(df))."""
    angle = np.linspace(math.atan(abs(t) / math.sqrt(df)), math.pi / 2, 200_001)
    density = np.cos(angle) ** (df - 1)
    whole = np.cos(np.linspace(0, math.pi / 2, 200_001)) ** (df - 1)
    return np.trapezoid(density, angle) / np.trapezoid(whole, dx=math.pi / 2 / 200_000)


def average_ranks(values):
    return np.array([sum(v < x for v in values) + (sum(v == x for v in values) + 1) / 2 for x in values])


@pytest.mark.parametrize("points, window, order", [(41, 11, 3), (15, 5, 2)])
def test_smooth_derivative_fits_a_polynomial_around_each_point(spark, points, window, order):
    rng = np.random.default_rng(points)
    rows = [(g, float(t), float(v)) for g in ("a", "b") for t, v in zip(np.sort(rng.uniform(0, 9, 12)), rng.gamma(2, 3, 12))] + [("a", 9.5, -1.0)]
    got = {r.g: r.d for r in C.smooth_derivative(spark.createDataFrame(rows, "g string, t double, value double"), ["g"], points, window, order).collect()}
    for g in ("a", "b"):
        t, v = np.array(sorted((t, v) for h, t, v in rows if h == g)).T
        grid = np.linspace(t[0], t[-1], points)
        y = np.interp(grid, t, np.log1p(np.maximum(v, 0)))
        want = []
        for i in range(points):
            start = min(max(i - window // 2, 0), points - window)
            near = slice(start, start + window)
            want.append(np.polyfit(grid[near] - grid[i], y[near], order)[-2])
        assert np.allclose(got[g], want, atol=1e-8)


def test_spearman_p_is_students_tail(spark):
    rng = np.random.default_rng(4)
    rows = [(g, float(x), float(x * w + y)) for g, w in (("near", 0.8), ("far", 0.1)) for x, y in rng.integers(0, 9, (25, 2))]
    rows += [("two", 1.0, 2.0), ("two", 2.0, 1.0), ("near", None, 3.0), ("flat", 1.0, 1.0), ("flat", 1.0, 2.0), ("flat", 1.0, 3.0)]
    got = {r.g: r for r in T.spearman_by_group(spark.createDataFrame(rows, "g string, x double, y double"), ["g"], "x", "y").collect()}
    for g in ("near", "far"):
        x, y = np.array([(x, y) for h, x, y in rows if h == g and x is not None]).T
        rho = np.corrcoef(average_ranks(x), average_ranks(y))[0, 1]
        n = len(x)
        assert got[g].n == n and got[g].rho == pytest.approx(rho, abs=1e-9)
        assert got[g].p == pytest.approx(t_two_sided(rho * math.sqrt((n - 2) / (1 - rho * rho)), n - 2), rel=1e-5)
    assert got["two"].rho is None and got["two"].p is None and got["flat"].rho is None and got["flat"].p is None


def test_deseq_effects(spark):
    rng = np.random.default_rng(8)
    group = {s: "a" if s < 4 else "b" for s in range(9)}
    counts = {(s, f"g{j}"): int(rng.poisson((20 + 15 * j) * (1 + s / 4) * (3 if j == 2 and group[s] == "b" else 1))) for s in group for j in range(7)}
    counts |= {(s, "absent"): 0 if s == 3 else 5 + s for s in group}
    d = spark.createDataFrame([(s, g, v) for (s, g), v in counts.items()], "sample long, gene string, value long")
    got = {r.gene: r for r in X.deseq_effects(d, spark.createDataFrame(list(group.items()), "sample long, group string")).collect()}

    genes = sorted({g for _, g in counts})
    log_mean = {g: np.mean([math.log(counts[s, g]) for s in group]) for g in genes if all(counts[s, g] > 0 for s in group)}
    assert "absent" not in log_mean
    factor = {s: math.exp(np.median([math.log(counts[s, g]) - m for g, m in log_mean.items()])) for s in group}
    p = {}
    for g in genes:
        scaled = {k: np.array([counts[s, g] / factor[s] for s in group if group[s] == k]) for k in "ab"}
        a, b = (np.log2(scaled[k] + 0.5) for k in "ab")
        ea, eb = a.var(ddof=1) / len(a), b.var(ddof=1) / len(b)
        df = (ea + eb) ** 2 / (ea**2 / (len(a) - 1) + eb**2 / (len(b) - 1))
        p[g] = t_two_sided((b.mean() - a.mean()) / math.sqrt(ea + eb), df)
        assert got[g].log2fc == pytest.approx(math.log2((scaled["b"].mean() + 0.5) / (scaled["a"].mean() + 0.5)), abs=1e-9)
        assert got[g].p == pytest.approx(p[g], rel=1e-4, abs=1e-12)
    order = sorted(genes, key=p.get)
    for i, g in enumerate(order):
        assert got[g].q == pytest.approx(min(1, *(p[h] * len(order) / (j + 1) for j, h in enumerate(order) if j >= i)), rel=1e-4)


def test_six_metric_table_keeps_groups_of_any_side(spark):
    w2 = spark.createDataFrame([("m", 1, "rna", 0.5), ("m", 1, "atac", 0.25), ("m", 2, "rna", 2.0)], "method string, stage int, modality string, w2 double")
    similarity = spark.createDataFrame([("m", 1, 0.9), ("n", 1, 0.8)], "method string, stage int, similarity double")
    recall = spark.createDataFrame([("m", 2, 0.7), ("n", 3, 0.6)], "method string, stage int, recall double")
    got = {(r.method, r.stage): (r.w2_rna, r.w2_atac, r.similarity, r.recall) for r in D.six_metric_table(w2, similarity, recall, ["method", "stage"]).collect()}
    assert got == {("m", 1): (0.5, 0.25, 0.9, None), ("m", 2): (2.0, None, None, 0.7), ("n", 1): (None, None, 0.8, None), ("n", 3): (None, None, None, 0.6)}


def test_consistency_is_one_less_the_divergence_of_known_labels(spark):
    rng = np.random.default_rng(2)
    labels, rows = ["A", "B", "C", "Unknown"], {}
    for side in "ab":
        for q in range(9):
            for label, w in zip(labels, rng.dirichlet(np.ones(4))):
                if rng.random() < 0.85:
                    rows[side, q, label] = float(w)
    frame = lambda side: spark.createDataFrame([("g", q, x, w) for (s, q, x), w in rows.items() if s == side], "g string, query_id int, label string, prob double")
    found = []
    for q in range(9):
        p, r = (np.array([rows.get((side, q, x), 0.0) for x in labels[:3]]) for side in "ab")
        if p.sum() == 0 or r.sum() == 0:
            continue
        p, r = p / p.sum(), r / r.sum()
        m = (p + r) / 2
        kl = lambda x: sum(a * math.log2(a / b) for a, b in zip(x, m) if a > 0)  # noqa: B023, E731
        found.append(1 - (kl(p) + kl(r)) / 2)
    (got,) = T.cross_modal_consistency(frame("a"), frame("b"), ["g"]).collect()
    assert got["mean"] == pytest.approx(np.mean(found)) and got["median"] == pytest.approx(np.median(found))
    assert got.unknown_a == pytest.approx(np.mean([rows.get(("a", q, "Unknown"), 0.0) for q in range(9)]))


def test_equal_rank_is_the_least_of_equals(spark):
    rng = np.random.default_rng(1)
    rows = [(g, float(v)) for g, v in zip(rng.choice(["a", "b"], 300).tolist(), rng.integers(-20, 20, 300) / 4)]
    rows += [("a", float("inf")), ("a", None), ("a", None), ("c", None), (None, 1.0), (None, 1.0), (None, 0.5)]
    groups = defaultdict(list)
    for g, v in rows:
        groups[g].append(v)
    want = sorted((str(g), str(v), 1 + sum(x is not None and (v is None or x > v) for x in groups[g])) for g, v in rows)
    got = R.equal_rank(spark.createDataFrame(rows, "g string, v double"), ["g"], "v")
    assert got.columns == ["g", "v", "rank"] and dict(got.dtypes)["rank"] == "int"
    assert sorted((str(r.g), str(r.v), r["rank"]) for r in got.collect()) == want


def test_long_tables_are_not_broadcast(spark, monkeypatch):
    times = spark.range(9).selectExpr("CAST(id AS DOUBLE) AS q")
    assert columns.short_table(times, "query times", 9).count() == 9
    with pytest.raises(ValueError, match="more than 8 query times"):
        columns.short_table(times, "query times", 8)
    monkeypatch.setattr(columns.short_table, "__defaults__", (5,))
    knots = times.selectExpr("q AS rank", "2 * q AS time")
    with pytest.raises(ValueError, match="more than 5 knots"):
        P.remap_time_axis(spark.createDataFrame([(1.0,)], "rank double"), knots)
    path = spark.createDataFrame([(1, 0.0, [0.0]), (1, 1.0, [1.0])], "p int, t double, x array<double>")
    with pytest.raises(ValueError, match="more than 5 query times"):
        P.interpolate_at(path, times, ["p"])


def test_replicates_below_a_stage_take_so_many_rows(spark):
    c = spark.createDataFrame([("a", i) for i in range(7)] + [("b", i) for i in range(3)], "stage string, id long")
    t = spark.createDataFrame([("a", 4), ("b", 7)], "stage string, target long")
    got = {}
    for r in P.replicate_to_counts(c, t, below="take").collect():
        got.setdefault(r.stage, []).append(r.id)
    assert len(got["a"]) == len(set(got["a"])) == 4
    assert sorted(got["b"].count(i) for i in range(3)) == [2, 2, 3]
    with pytest.raises(Exception, match="below"):
        P.replicate_to_counts(c, t).collect()


def test_equal_rank_of_a_value_that_is_not_the_same_twice(spark):
    shaken = F.udf(lambda v: v + random.SystemRandom().random() * 1e-9, "double")
    d = spark.createDataFrame([("a", float(i)) for i in range(6)], "g string, v double").withColumn("s", shaken("v"))
    assert {r.v: r["rank"] for r in R.equal_rank(d, ["g"], "s").collect()} == {float(i): 6 - i for i in range(6)}


def test_stability_summary_ranks_scores_that_are_not_the_same_twice(spark):
    shaken = F.udf(lambda v: v + random.SystemRandom().random() * 1e-9, "double")
    d = spark.createDataFrame([("a", i, float(i % 4)) for i in range(4)], "m string, k int, v double").withColumn("score", shaken("v"))
    lines = d.select("m", "k", "score", F.lit(1).alias("lag"))
    got = C.stability_summary(R.equal_rank(d, ["m"], "score"), R.equal_rank(d, ["m"], "score"), lines, ["m", "k"]).collect()
    assert {r.k: (r["rank"], r.alternate_rank, r.lines) for r in got} == {i: (4 - i, 4 - i, 1) for i in range(4)}


def test_interpolated_paths_end_where_a_knot_is_missing(spark, tmp_path):
    from tidewake.plans import registry

    rows = [(v, [float(10 * v)]) for v in (0, 1, 3, 4, 5)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {(r.pid, r.q): r.a for r in registry.queries()["interpolate_at"](spark, str(tmp_path)).collect()}
    assert got == {(0, 0.0): 0, (0, 0.5): 5, (0, 1.0): 10, (0, 1.5): 10, (0, 3.0): 30, (1, 0.0): 40, (1, 0.5): 45, (1, 1.0): 50, (1, 1.5): 50}
