"""Choices, draws and decoding against plain loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewake.operators import composition as D
from tidewake.operators import features as X
from tidewake.operators import neighbours as K
from tidewake.operators import paths as T


def test_matching_is_that_of_positives_in_order(spark):
    """Few candidates for many positives, so that most are refused at some time."""
    rng = np.random.default_rng(1)
    p, n = rng.integers(1, 10**6, (7, 2)), rng.integers(1, 10**6, (12, 2))
    rows = lambda m, at: [("g", at + i, int(a), int(b)) for i, (a, b) in enumerate(m)]
    frame = lambda r: spark.createDataFrame(r, "g string, id long, a int, b int")
    got = {(r.query_id, r.ref_id) for r in K.match_negatives(frame(rows(p, 0)), frame(rows(n, 100)), ["a", "b"], 2, ["g"]).collect()}
    z = np.log1p(np.vstack([p, n]).astype(float))
    z = (z - z.mean(0)) / z.std(0)
    used, want = set(), set()
    for i in range(7):
        order = np.lexsort((np.arange(12), np.round(((z[7:] - z[i]) ** 2).sum(1), 12)))[:24]
        own = [int(j) for j in order if int(j) not in used][:2]
        used |= set(own)
        want |= {(i, 100 + j) for j in own}
    assert got == want and len(used) < 14


def test_acceptance_is_sequential_in_the_seeded_order(spark):
    rng = np.random.default_rng(2)
    rows = [(g, 1000 * k + i, [float(v) for v in rng.normal(size=2)], "ab"[i % 3 == 0]) for k, g in enumerate(("s", "t", None)) for i in range(60)]
    d = spark.createDataFrame(rows, "g string, id long, x array<double>, label string")
    got = K.low_overlap_aggregates(d.filter("g is not null"), 6, 0.34, 40, 3, ["g"])
    held = {}
    for r in got.collect():
        held.setdefault((r.g, r.centre), set()).add(r.ref_id)
    order = {r.id: r.h for r in d.select("id", F.xxhash64("id", F.lit(3)).alias("h")).collect()}
    for g in ("s", "t"):
        own = [(i, np.array(x)) for a, i, x, _ in rows if a == g]
        centres = sorted((i for i, _ in own), key=lambda i: (order[i], i))[:40]
        place, taken = dict(own), []
        for c in centres:
            near = {i for _, i in sorted((round(float(np.linalg.norm(x - place[c])), 12), i) for i, x in own)[:6]}
            if all(len(near & t) <= 0.34 * 6 for _, t in taken):
                taken.append((c, near))
        assert {c: t for (a, c), t in held.items() if a == g} == dict(taken)
    named = K.aggregate_labels(got, d.select(F.col("id").alias("ref_id"), "label"), ["g"]).collect()
    label = {i: v for _, i, _, v in rows}
    for r in named:
        v = sorted(label[i] for i in held[r.g, r.centre])
        best = min(set(v), key=lambda k: (-v.count(k), k))
        assert (r.n, r.dominant, r.n_labels) == (6, best, len(set(v))) and r.fraction == pytest.approx(v.count(best) / 6)
    counts = spark.createDataFrame([(i, "f", 6.0) for _, i, _, _ in rows if i % 2], "ref_id long, feature string, value double")
    for r in K.aggregate_profiles(got, counts, ["g"]).collect():
        assert r.value == pytest.approx(sum(i % 2 for i in held[r.g, r.centre]))


def covered(low, high, value):
    return low <= value <= high


@pytest.mark.parametrize("part", [4096, 25])
def test_intervals_of_weighted_draws(spark, monkeypatch, part):
    """Against numpy's own draws over the whole group, in one part and in several."""
    monkeypatch.setattr(X, "PART", part)
    rng = np.random.default_rng(3)
    rows, want = [], {}
    for g in ("a", "b"):
        v, w = rng.normal(2, 1, 120), rng.uniform(0.1, 3, 120)
        y = v + rng.normal(0, 1, 120) > 2
        rows += [(g, i, float(a), float(b), bool(c)) for i, (a, b, c) in enumerate(zip(v, w, y))] + [(g, 500, None, 1.0, True), (g, 501, 5.0, -1.0, True)]
        means, aucs = [], []
        for _ in range(400):
            at = rng.choice(120, 120, p=w / w.sum())
            means.append(v[at].mean())
            pos, neg = v[at][y[at]], v[at][~y[at]]
            aucs.append(((pos[:, None] > neg).mean() + (pos[:, None] == neg).mean() / 2))
        pair = w[y][:, None] * w[~y]
        want[g] = (float(w @ v / w.sum()), np.quantile(means, [0.025, 0.975]), float((pair * (v[y][:, None] > v[~y])).sum() / pair.sum()), np.quantile(aucs, [0.025, 0.975]))
    d = spark.createDataFrame(rows, "g string, k int, v double, w double, y boolean")
    for r in X.bootstrap_ci(d, ["g"], "v", "k", 400, weight="w").collect():
        assert r.estimate == pytest.approx(want[r.g][0]) and (r.low, r.high) == pytest.approx(want[r.g][1], abs=0.06)
    for r in X.bootstrap_ci(d, ["g"], "v", "k", 100, statistic="auroc", weight="w", label="y").collect():
        assert r.estimate == pytest.approx(want[r.g][2]) and (r.low, r.high) == pytest.approx(want[r.g][3], abs=0.06)


def test_repairing_permutes_inside_groups(spark):
    d = spark.createDataFrame([("ab"[i % 2], i) for i in range(40)], "line string, query_id long")
    got = {r.query_id: r.other for r in K.repaired(d, ["line"], 1).collect()}
    assert sorted(got) == sorted(got.values()) == list(range(40)) and all(a % 2 == b % 2 for a, b in got.items()) and any(a != b for a, b in got.items())


def test_stage_brackets(spark):
    d = spark.createDataFrame([(t,) for t in (-1.0, 0.0, 0.4, 0.5, 1.1, 1.7, 2.0)], "t double")
    got = {r.t: (r.low, r.high, r.alpha) for r in K.stage_bracket(d, "t", [0.0, 0.5, 1.7]).collect()}
    want = {-1.0: (0, 0, 0), 0.0: (0, 0, 0), 0.4: (0, 1, 0.8), 0.5: (1, 2, 0), 1.1: (1, 2, 0.5), 1.7: (2, 2, 0), 2.0: (2, 2, 0)}
    assert all(got[t] == pytest.approx(w) for t, w in want.items())


def w2_by_hand(a, wa, b, wb):
    q = np.unique(np.round(np.r_[np.cumsum(wa) / wa.sum(), np.cumsum(wb) / wb.sum()], 12))
    at = lambda v, w: v[np.minimum(np.searchsorted(np.round(np.cumsum(w) / w.sum(), 12), q), len(v) - 1)]
    return float((np.diff(np.r_[0, q]) * (at(a, wa) - at(b, wb)) ** 2).sum())


def test_sliced_distance_in_random_directions(spark):
    rng = np.random.default_rng(4)
    u = D.directions(spark, 3, 5, 1)
    rows, other, want = [], [], {}
    for g, (n, m) in {"a": (37, 60), "b": (5, 3)}.items():
        x, y, w = rng.normal(size=(n, 3)), rng.normal(1, 2, size=(m, 3)), rng.uniform(0.1, 2, n)
        rows += [(g, [*map(float, v)], float(k)) for v, k in zip(x, w)] + [(g, [9.0, 9.0, 9.0], 0.0)]
        other += [(g, [*map(float, v)], 1.0) for v in y]
        each = []
        for r in u.collect():
            p, q = x @ np.array(r.u), y @ np.array(r.u)
            each.append(w2_by_hand(np.sort(p), w[np.argsort(p)], np.sort(q), np.ones(m)))
        want[g] = np.sqrt(np.mean(each))
    frame = lambda v: spark.createDataFrame(v, "g string, x array<double>, weight double")
    assert {r.g: r.w2 for r in D.sliced_w2(frame(rows), frame(other), u, ["g"]).collect()} == pytest.approx(want)


def test_margins_follow_the_voted_fate(spark):
    s = spark.createDataFrame([("g", p, t, float(a), float(b)) for p, ab in {1: [(1, 0), (2, 0), (1.5, 1)], 2: [(0, 1), (1, 0), (3, 1)], 3: [(2, 1), (0, 1), (0, 4)]}.items() for t, (a, b) in enumerate(ab)], "g string, p int, t int, a double, b double")
    f = spark.createDataFrame([("g", 1, True, 0.8, 1.0), ("g", 2, False, 0.6, 2.0), ("g", 3, False, 1.0, 1.0)], "g string, p int, fate boolean, confidence double, weight double")
    r = T.fate_margin_dynamics(s, f, ["g"], "p", "t", "a", "b").first()
    assert r.terminal_margin == pytest.approx((0.5 + 2 * -2 + 4) / 4) and r.gain == pytest.approx((-0.5 + 2 * (-2 - 1) + (4 + 1)) / 4)
    assert r.rising_steps == pytest.approx((0.5 + 0 + 1) / 4) and r.fate_share == 0.25 and r.confidence == pytest.approx((0.8 + 1.2 + 1) / 4)
    assert r.initial_auroc == pytest.approx((2 + 0.5) / 3) and r.early_auroc == 1.0


def test_agreement_of_changes(spark):
    c = spark.createDataFrame([("g", "x", "r", 1.0, True), ("g", "x", "a", 2.0, True), ("g", "y", "r", 1.0, True), ("g", "y", "a", -2.0, False), ("g", "z", "r", 0.0, False)], "g string, gene string, m string, change double, agrees boolean")
    r = T.change_agreement(c, ["g", "gene"], "m", ["g"]).first()
    assert (r.n, r.accuracy, r.paired, r.same_sign, r.both_agree) == (5, 0.6, 2, 0.5, 0.5)


def test_balance_by_group_with_distances(spark):
    rows = [("t", 1, 5.0, 2.0, True), ("t", 2, 1.0, 2.0, False), ("t", 3, 4.0, 2.0, False), ("t", 4, 3.0, 2.0, True), ("u", 5, 1.0, 1.0, True)]
    d = spark.createDataFrame(rows, "g string, id long, v double, flat double, treated boolean")
    m = K.match_controls(d, "treated", ["v", "flat"], ["g"])
    got = {r.covariate: r for r in K.balance(d, m, "treated", ["v", "flat"], ["g"]).collect()}
    assert set(got) == {"v", "flat"} and got["flat"].smd_before == got["flat"].smd_after == 0.0
    sd = np.std([5, 1, 4, 3])
    assert (got["v"].n_treated, got["v"].n_controls, got["v"].n_matched) == (2, 2, 1) and got["v"].median_distance == pytest.approx(1 / sd)
    assert got["v"].smd_before == pytest.approx(1.5 / np.sqrt((1 + 2.25) / 2)) and got["v"].smd_after == pytest.approx(0.0)
