"""Neighbour and radius joins through cells against whole comparisons."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewake.operators import neighbours as K
from tidewake.operators import pivots


def clustered(n, seed, groups=12, dim=5):
    rng = np.random.default_rng(seed)
    middles = np.random.default_rng(99).normal(size=(groups, dim)) * 20
    return middles[rng.integers(0, groups, n)] + rng.normal(size=(n, dim))


def frame(spark, x, start=0, g="s"):
    return spark.createDataFrame([(g, start + i, [*map(float, v)]) for i, v in enumerate(x)], "g string, id long, x array<double>")


def brute(q, r, k):
    d = np.sqrt(((q[:, None] - r[None]) ** 2).sum(2))
    return {i: [int(j) for j in np.lexsort((np.arange(len(r)), np.round(d[i], 12)))[:k]] for i in range(len(q))}


CLOUDS = {"clustered": clustered(400, 1), "random": np.random.default_rng(2).normal(size=(300, 8)), "ties": np.repeat(np.arange(40.0)[:, None], 9, 0), "apart": np.vstack([clustered(150, 3), clustered(3, 4) + 1e4])}


@pytest.mark.parametrize("name", CLOUDS)
def test_cells_give_what_the_whole_gives(spark, name):
    r = CLOUDS[name]
    rng = np.random.default_rng(5)
    q = r[rng.integers(0, len(r), 60)] + (0 if name == "ties" else 0.3 * rng.normal(size=(60, r.shape[1])))
    both = K.knn_join(frame(spark, q), frame(spark, r).unionByName(frame(spark, r[:7], 5000, "small")), 7, ["g"], cell=25, block=30)
    got = {}
    for row in both.orderBy("query_id", "rank").collect():
        got.setdefault(row.query_id, []).append(row.ref_id)
    assert got == brute(q, r, 7)
    few = K.knn_join(frame(spark, q), frame(spark, r), 500, ["g"], cell=60).groupBy("query_id").count().collect()
    assert {x["count"] for x in few} == {min(500, len(r))}


def test_radius_mass_through_cells(spark):
    p, r = clustered(400, 6), clustered(80, 7)
    w = np.random.default_rng(8).uniform(size=400)
    particles = spark.createDataFrame([("s", i, [*map(float, v)], float(w[i])) for i, v in enumerate(p)], "g string, id long, x array<double>, weight double")
    refs = frame(spark, r).withColumn("radius", 1.0 + F.col("id") % 5)
    want = {i: w[((p - v) ** 2).sum(1) <= (1.0 + i % 5) ** 2 + 1e-7].sum() for i, v in enumerate(r)}
    for cell in (30, 10_000):
        assert {x.id: x.mass for x in K.radius_mass(refs, particles, ["g"], cell=cell).collect()} == pytest.approx(want)


def test_refuted_cells_are_not_asked(spark):
    """On clusters that lie apart a query meets few cells; the pairs compared are a small share of all."""
    r = frame(spark, clustered(600, 9))
    q = frame(spark, clustered(100, 10))
    held, cells, extents = pivots.cells_of(r, ["g"], 25)
    own = pivots.placed(q, held, ["g"]).drop("_gap")
    near = K.knn_join(q, r, 5, ["g"]).groupBy(F.col("query_id").alias("id")).agg(F.max("distance").alias("_bound"))
    n = cells.groupBy("_cell").agg(F.count("*").alias("n"))
    asked = pivots.asked(own.join(near, "id"), extents, ["g"], 5, skip_own=False)
    compared = asked.join(n.withColumnRenamed("_cell", "_ask"), "_ask").agg(F.sum("n")).first()[0]
    assert compared <= 0.25 * 600 * 100
    loose = pivots.asked(own.withColumn("_bound", F.lit(None).cast("double")), extents, ["g"], 5, skip_own=False)
    assert loose.count() < 0.5 * 100 * n.count()  # the extents alone refute many


def _dealt_apart(spark, run):
    """Rows of run() with as many partitions as the session has, however small they are."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    try:
        return run().collect()
    finally:
        spark.conf.unset(name)


def test_groups_of_an_int_and_a_long_meet(spark):
    q = spark.range(40).selectExpr("id", "CAST(id % 8 AS INT) AS g", "array(CAST(id AS DOUBLE)) AS x")
    r = spark.range(40).selectExpr("id", "id % 8 AS g", "array(CAST(id AS DOUBLE)) AS x")
    found = _dealt_apart(spark, lambda: K.knn_join(q, r, 1, ["g"]))
    assert sorted((x.g, x.query_id, x.ref_id) for x in found) == [(i % 8, i, i) for i in sorted(range(40), key=lambda i: (i % 8, i))]
    near = _dealt_apart(spark, lambda: K.radius_mass(r.withColumn("radius", F.lit(0.5)), q.withColumn("weight", F.lit(1.0)), ["g"]))
    assert sorted((x.id, x.mass) for x in near) == [(i, 1.0) for i in range(40)]


def test_curves_by_depth_hold_every_time(spark):
    p = spark.range(24).selectExpr("id", "'m' AS method", "1.0D AS weight", "id % 13 / 4.0D AS time", "array(CAST(id AS DOUBLE)) AS x")
    cells = spark.range(16).selectExpr("id AS id", "id % 4 AS stage", "array(CAST(id AS DOUBLE)) AS x")
    m = K.bracket_shares(K.stage_bracket(p, "time", [0.0, 1.0, 2.0, 3.0]))
    members = m.select("method", "time", F.col("id").alias("query_id"), "weight", "stage", "part")
    counts, depth = cells.selectExpr("id AS ref_id", "1 AS feature", "2.0D AS value"), cells.selectExpr("id AS ref_id", "4.0D AS depth")

    def curves():
        near = K.knn_join(m, cells, 2, ["stage"]).join(p.select(F.col("id").alias("query_id"), "time"), "query_id")
        return K.decoded_curves(members, near, counts, ["method"], "time", scale=10.0, depth=depth)

    got = {x.time: x.value for x in _dealt_apart(spark, curves)}
    assert got == {i / 4: pytest.approx(5.0) for i in range(13)}
