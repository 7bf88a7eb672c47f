"""Registering queries with their SQL, and the inputs that queries derive from the tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: Decimals of computed doubles in results: sums of doubles differ in the last bits with their order.
DECIMALS = 6

# Derived inputs, in SQL; the functions below give the same rows.
WITH = """
cells AS (SELECT vec_id AS id, CAST(label AS VARCHAR) AS celltype, (vec_id // 2) % 4 AS stage,
  CAST(embedding AS DOUBLE[]) AS x FROM embeddings WHERE vec_id % 2 = 0),
particles AS (SELECT vec_id AS id, vec_id % 3 AS method, (vec_id // 2) % 4 AS stage, CAST(label AS VARCHAR) AS source_label,
  CAST(embedding AS DOUBLE[]) AS x, CASE WHEN vec_id % 3 = 0 THEN NULL ELSE CAST(embedding[1] AS DOUBLE) END AS log_mass
  FROM embeddings WHERE vec_id % 2 = 1),
weights AS (SELECT *, exp(coalesce(log_mass, 0)) / sum(exp(coalesce(log_mass, 0))) OVER (PARTITION BY method, stage) AS weight FROM particles),
pairs AS (SELECT p.stage, p.id AS query_id, c.id AS ref_id, list_distance(p.x, c.x) AS distance FROM particles p JOIN cells c ON p.stage = c.stage),
knn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, ref_id) AS rank FROM pairs) WHERE rank <= 10),
self_pairs AS (SELECT a.stage, a.id AS query_id, b.id AS ref_id, list_distance(a.x, b.x) AS distance FROM cells a JOIN cells b ON a.stage = b.stage AND a.id <> b.id),
self_knn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, ref_id) AS rank FROM self_pairs) WHERE rank <= 10),
soft AS (SELECT query_id, ref_id, k.stage, g / sum(g) OVER (PARTITION BY query_id) AS w FROM
  (SELECT *, exp(-power(distance / max(distance) OVER (PARTITION BY query_id), 2)) AS g FROM knn) k),
ref_mass AS (SELECT p.method, p.stage, s.ref_id, sum(p.weight * s.w) AS mass FROM soft s JOIN weights p ON p.id = s.query_id GROUP BY ALL),
orders_y AS (SELECT *, year(o_orderdate) AS y FROM orders),
scores AS (SELECT c_mktsegment AS method, year(o_orderdate) AS stage, o_orderpriority AS setting, avg(o_totalprice) AS score, count(*) AS n
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
curves AS (SELECT event_type AS feature, user_id % 5 AS grp, CAST(ts AS DATE) - (SELECT min(CAST(ts AS DATE)) FROM events) AS t, avg(value) AS value FROM events GROUP BY ALL),
genes AS (SELECT p_partkey AS gene, p_partkey % 5 AS chrom, (p_partkey * 7919) % 2000000 AS gstart, (p_partkey * 7919) % 2000000 + p_size * 10 AS gend FROM part),
peaks AS (SELECT l_orderkey * 8 + l_linenumber AS peak, min(l_partkey) % 5 AS chrom, (l_orderkey * 3163 + l_linenumber * 701) % 2000000 AS pstart,
  (l_orderkey * 3163 + l_linenumber * 701) % 2000000 + CAST(max(l_quantity) AS BIGINT) * 10 AS pend FROM lineitem GROUP BY l_orderkey, l_linenumber)
"""


def query(sql: str | None = None, keys: str = "", doubles: str = ""):
    """Register a function (spark, sf_dir) as a query under its name. keys: columns as they are; doubles:
    columns that are rounded, on both sides. sql: a statement over the tables and the inputs of WITH."""

    def wrap(function):
        name = function.__name__

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = function(spark, sf_dir)
            return df.select(*keys.split(), *[(F.round(F.col(c).cast("double"), DECIMALS) + 0.0).alias(c) for c in doubles.split()])

        QUERIES[name] = run
        run.__doc__ = function.__doc__
        if sql is not None:
            columns = ", ".join([*keys.split(), *[f"round(CAST({c} AS DOUBLE), {DECIMALS}) + 0.0 AS {c}" for c in doubles.split()]])
            SQL[name] = f"WITH {_needed(sql)} SELECT {columns} FROM ({sql.strip()}) AS result"
        return function

    return wrap


def _needed(sql: str) -> str:
    """Those inputs of WITH that the statement uses, directly or through another."""
    import re

    parts = {m[1]: m[0] for m in re.finditer(r"(?ms)^(\w+) AS \(.*?\)(?=,\n\w+ AS \(|\s*\Z)", WITH.strip())}
    used, text = [], sql
    for name in reversed(parts):
        if re.search(rf"\b{name}\b", text):
            used.append(parts[name])
            text += parts[name]
    return ", ".join([*reversed(used)] or ["unused AS (SELECT 1)"])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cells(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").filter("vec_id % 2 = 0")
    return e.select(F.col("vec_id").alias("id"), F.col("label").cast("string").alias("celltype"), F.expr("(vec_id div 2) % 4").alias("stage"), F.col("embedding").cast("array<double>").alias("x"))


def particles(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").filter("vec_id % 2 = 1")
    x = F.col("embedding").cast("array<double>")
    return e.select(
        F.col("vec_id").alias("id"), F.expr("vec_id % 3").alias("method"), F.expr("(vec_id div 2) % 4").alias("stage"), F.col("label").cast("string").alias("source_label"),
        x.alias("x"), F.when(F.expr("vec_id % 3 <> 0"), F.element_at(x, 1)).alias("log_mass"),
    )


def weighted(spark, sf_dir) -> DataFrame:
    from ..operators.mass import mass_weights

    return mass_weights(particles(spark, sf_dir), ["method", "stage"])


def neighbours(spark, sf_dir, k: int = 10) -> DataFrame:
    from ..operators.neighbours import knn_join

    return knn_join(particles(spark, sf_dir), cells(spark, sf_dir), k, ["stage"])


def self_neighbours(spark, sf_dir, k: int = 10) -> DataFrame:
    from ..operators.neighbours import knn_join_excluding

    return knn_join_excluding(cells(spark, sf_dir), cells(spark, sf_dir), k, ["stage"])


def cell_labels(spark, sf_dir) -> DataFrame:
    return cells(spark, sf_dir).select(F.col("id").alias("ref_id"), F.col("celltype").alias("label"))


def scores(spark, sf_dir) -> DataFrame:
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    g = [F.col("c_mktsegment").alias("method"), F.year("o_orderdate").alias("stage"), F.col("o_orderpriority").alias("setting")]
    return o.groupBy(*g).agg(F.avg("o_totalprice").alias("score"), F.count(F.lit(1)).alias("n"))


def orders_by_year(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders").withColumn("y", F.year("o_orderdate"))


def curves(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("d", F.to_date("ts"))
    first = e.agg(F.min("d").alias("d0"))  # one row
    g = [F.col("event_type").alias("feature"), F.expr("user_id % 5").alias("grp"), F.datediff("d", "d0").cast("long").alias("t")]
    return e.crossJoin(F.broadcast(first)).groupBy(*g).agg(F.avg("value").alias("value"))


def genes(spark, sf_dir) -> DataFrame:
    at = "(p_partkey * 7919) % 2000000"
    return table(spark, sf_dir, "part").selectExpr("p_partkey AS gene", "p_partkey % 5 AS chrom", f"{at} AS start", f"{at} + p_size * 10 AS end")


def peaks(spark, sf_dir) -> DataFrame:
    at = "(l_orderkey * 3163 + l_linenumber * 701) % 2000000"
    g = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"), F.max("l_quantity").alias("n"))
    return g.selectExpr("l_orderkey * 8 + l_linenumber AS peak", "p % 5 AS chrom", f"{at} AS start", f"{at} + CAST(n AS BIGINT) * 10 AS end")
