"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _ready_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the session. It is read from spark.checkpoint.dir; only where that is unset and
    the master is local, so that all tasks share one machine, a temporary folder is set."""
    context = spark.sparkContext._jsc.sc()
    if context.getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            import tempfile

            folder = tempfile.mkdtemp(prefix="checkpoints-")
        spark.sparkContext.setCheckpointDir(folder)
    return context.getCheckpointDir().get()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with a table in the shared checkpoint folder."""
    _ready_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path below the shared checkpoint folder, for tables that are written and reread."""
    return f"{_ready_folder(spark)}/{name}-{uuid.uuid4().hex}"


#: A key that more than this share of the rows carry is hot; there are no more hot keys than this.
HOT_KEYS = 512


def join_hot(rows: DataFrame, table: DataFrame, keys: list[str], spread: list[str]) -> DataFrame:
    """rows joined on keys with table, which has one row a key and n, the number of rows that carry it (dropped).

    A key that more than 1 in HOT_KEYS of all those rows carry is salted: its rows are dealt by a hash of the
    columns `spread`, and its row of table is repeated once a salt. The driver takes hashes of these keys alone,
    HOT_KEYS at most. table should be written before (it is read again)."""
    total, highest = table.agg(F.sum("n"), F.max("n")).first()
    most = max(1, (total or 0) // HOT_KEYS)
    hot = table.filter(F.col("n") > most).select(F.xxhash64(*keys).alias("h"), "n").collect() if (highest or 0) > most else []
    table = table.drop("n")
    if not hot:
        return rows.join(table, keys)
    is_hot, salts = F.xxhash64(*keys).isin([r["h"] for r in hot]), -(-max(r["n"] for r in hot) // most)
    salted = rows.withColumn("_salt", F.when(is_hot, F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int")).otherwise(0))
    repeated = table.withColumn("_salt", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))))
    return salted.join(repeated, [*keys, "_salt"]).drop("_salt")


def _either(a: Column, b: Column, c: Column, d: Column) -> Column:
    """The edges (a, b) and (c, d) of a row, one after the other; the row is read once for both."""
    return F.inline(F.array(F.struct(a.alias("a"), b.alias("b")), F.struct(c.alias("a"), d.alias("b"))))


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over edges (a > b). Large: every greater neighbour of a node is tied to the least
    of its neighbourhood. Small: the node and its lesser neighbours are tied to the least of them."""
    a, b, m = F.col("a"), F.col("b"), F.col("m")
    both = edges if not large else edges.select(_either(a, b, b, a))
    near = both.join(both.groupBy("a").agg(F.min("b").alias("m")), "a")
    if large:
        tied = near.filter("b > a").select(b.alias("a"), F.least("m", "a").alias("b"))
    else:
        tied = near.select(_either(b, m, a, m))
    return tied.filter("a <> b").distinct()


def _are_stars(edges: DataFrame) -> bool:
    """Whether every a has one b, and that is the a of no edge."""
    a, b = F.col("a"), F.col("b")
    ends = edges.select(F.inline(F.array(F.struct(a.alias("node"), F.lit(1).alias("out")), F.struct(b.alias("node"), F.lit(0).alias("out")))))
    per = ends.groupBy("node").agg(F.sum("out").alias("out"), F.count("*").alias("n"))
    return per.filter("out > 0 and n > 1").isEmpty()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, component (the least node that it reaches) of every node with an edge.

    edges: columns a, b of long; order, repeats, loops and nulls do not matter. The edges stay in
    Spark; a round is two aggregations and joins, whose hot keys (a node with very many neighbours)
    are combined before the shuffle or, on the joined side, split by adaptive execution. Rounds grow
    with the logarithm of the longest path; each is checkpointed, so a lost executor costs one round.
    They end as soon as all edges are stars, of which one aggregation tells, and edges that are stars
    take none.
    """
    a, b = F.col("a"), F.col("b")
    e = checkpoint(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    for at in range(most_rounds + 1):
        if _are_stars(e):
            return e.select(_either(a, b, b, b)).distinct().toDF("node", "component")
        if at < most_rounds:
            e = checkpoint(_star(_star(e, large=True), large=False))
    raise RuntimeError("components did not settle")


def joined_components(parts: DataFrame, edges: DataFrame) -> DataFrame:
    """components() of the edges of which parts (node, component) are the components, and of `edges` (a, b) beside
    them. Only the components that these join are contracted, not again the edges inside them."""
    of = lambda x: parts.select(F.col("node").alias(x), F.col("component").alias(f"{x}_component"))
    between = edges.select("a", "b").join(of("a"), "a", "left").join(of("b"), "b", "left")
    tops = components(between.select(F.coalesce("a_component", "a").alias("a"), F.coalesce("b_component", "b").alias("b")))
    alone = tops.select("node", F.col("node").alias("component"))  # nodes without a component so far among them
    nodes = parts.unionByName(alone).distinct()
    tops = tops.select(F.col("node").alias("component"), F.col("component").alias("top"))
    return nodes.join(tops, "component", "left").select("node", F.coalesce("top", "component").alias("component"))
