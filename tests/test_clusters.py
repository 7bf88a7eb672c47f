"""Weighted k-means in one task and in passes."""

import numpy as np
import pytest

from tidewake.operators import clusters
from tidewake.operators import composition as D
from tidewake.operators import paths as T


def cloud(n, seed, spread=0.05):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(6, 3)) * 2
    return middles[rng.integers(0, 6, n)] + spread * rng.normal(size=(n, 3)), rng.uniform(0.1, 2, n)


def frame(spark, clouds):
    rows = [(g, 1000 * i + j, list(map(float, x)), float(w)) for i, (g, (xs, ws)) in enumerate(clouds.items()) for j, (x, w) in enumerate(zip(xs, ws))]
    return spark.createDataFrame(rows, "g string, id long, x array<double>, weight double")


def cost(x, w, centres):
    return float((w * ((x[:, None] - centres[None]) ** 2).sum(2).min(1)).sum())


def best_by_numpy(x, w, k):
    found = []
    for seed in range(20):
        found.append(cost(x, w, clusters.reduced(x, w, k, seed, 100)))
    return min(found)


@pytest.mark.parametrize("n", [40, 300, 900])
def test_inertia_is_near_the_best_of_numpy(spark, n):
    x, w = cloud(n, n)
    d = clusters.packed(frame(spark, {"a": (x, w)}), ["g"], weight="weight", block=100)
    r = clusters.fit(d, ["g"], 6, starts=3).first()
    assert r.cost == pytest.approx(cost(x, w, np.array(r.centres))) and r.cost <= 1.01 * best_by_numpy(x, w, 6)
    assert sum(r.mass) == pytest.approx(w.sum())


def test_passes_give_what_one_task_gives(spark):
    clouds = {"a": cloud(260, 1, 0.5), "b": cloud(120, 2, 0.5), "few": cloud(4, 3)}
    d = frame(spark, clouds)
    whole = {r.g: r for r in clusters.fit(clusters.packed(d, ["g"], weight="weight"), ["g"], 5).collect()}
    parts = {r.g: r for r in clusters.fit(clusters.packed(d.repartition(7), ["g"], weight="weight", block=50), ["g"], 5).collect()}
    assert set(whole) == set(parts) == set(clouds)
    for g in clouds:
        assert np.allclose(np.array(whole[g].centres), np.array(parts[g].centres)) and np.allclose(whole[g].mass, parts[g].mass)
    assert sorted(map(tuple, whole["few"].centres)) == sorted(map(tuple, clouds["few"][0].tolist()))


def test_microclusters_have_the_mass_and_mean_of_the_cloud(spark):
    x, w = cloud(200, 4, 0.4)
    got = D.microclusters(frame(spark, {"a": (x, w)}), ["g"], 16).collect()
    assert len(got) <= 16 and sum(r.weight for r in got) == pytest.approx(1)
    assert np.allclose(sum(r.weight * np.array(r.x) for r in got), w @ x / w.sum())


def test_substates_and_their_audit(spark):
    rng = np.random.default_rng(5)
    x = np.vstack([rng.normal(size=(30, 2)), rng.normal(size=(10, 2)) + 50])
    d = spark.createDataFrame([("t", i, [*map(float, v), 7.0]) for i, v in enumerate(x)], "g string, id long, x array<double>")
    own = {r.id: r.substate for r in T.substates(d, ["g"], [2]).collect()}
    assert len({own[i] for i in range(30)}) == len({own[i] for i in range(30, 40)}) == 1 and own[0] != own[39]
    r = T.substate_audit(d, ["g"], [2], 3).first()
    assert (r.n, r.least, r.greatest, r.least_fraction, r.mean_ari, r.least_ari) == (40, 10, 30, 0.25, 1.0, 1.0)
