"""A corpus pipeline over `documents`: five stages, each written as Parquet and reread by the next.

Counted as part of the subpackage llm; the rest of the library does not need it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewake.llm import bpe_codec, langid, linededup, minhash, mixing
from tidewake.llm.components import shared_folder
from tidewake.llm.queries import tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with a determined language and writes the prediction to lang.

    The model is fitted on the rows that the query op4 learns from. A text that is null or has no
    letter is rejected, and every text if no row is labelled. A null lang is replaced like any other; null or
    repeated doc_ids and repeated rows stay."""
    model = langid.fit(docs.filter(~langid.held_out(F.col("doc_id"))))
    return langid.label_documents(docs, model).filter(F.col("lang") != langid.UNDETERMINED).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes later repeats of runs of lines of 50 words or more; a document of which nothing is left goes, so
    does a null or empty text. Rows with a null doc_id keep their lines, a repeated row is not its own copy."""
    cleaned = linededup.dedup_documents(docs)
    left = cleaned.filter(F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return left.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one with the least doc_id, null last.

    A document is a doc_id, null or not, with a text; a hash of both is its node. So texts that share a
    doc_id, or have none, are compared like any others; a repeated row is one document."""
    doc_id = F.col("doc_id").cast("long")
    node = F.xxhash64(doc_id.isNull(), F.coalesce(doc_id, F.lit(0)), F.col("text").isNull(), F.col("text").cast("string"))
    rows = docs.select(*COLUMNS, node.alias("node"))
    groups = minhash.near_duplicates(rows.select(F.col("node").alias("doc_id"), "text")).select(F.col("doc_id").alias("node"), "component_id")
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "node")
    least = rows.select("node", "doc_id").join(groups.distinct(), "node").groupBy("component_id").agg(F.min(place)["node"].alias("node"))
    return rows.join(least, "node", "left_semi").dropDuplicates(["node"]).select(*COLUMNS)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document once for every slot of the mix's schedule that takes it, up to three times; one that no
    slot takes goes, as does a text without words. The mix is written in the order of its slots: they are dealt to
    files by range, and sorted in each.

    Rows are joined to their slots by a digest of doc_id and text, either of which may be null, and by
    source; rows that agree in all are numbered, as one of them may come once more than another."""
    joined = docs.select(*COLUMNS, *mixing.row_key(docs))
    joined = joined.withColumn("number", F.row_number().over(Window.partitionBy(*mixing.ROW).orderBy("lang", "n_chars")).cast("long"))
    slots = joined.join(mixing.copies(docs), [*mixing.ROW, "number"]).withColumn("slot", F.explode("slots"))
    in_order = ["slot", *mixing.ROW]  # a slot may take several documents
    return slots.repartitionByRange(*in_order).sortWithinPartitions(*in_order).select(*COLUMNS)


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document of the mix, null doc_ids and repeats too."""
    return bpe_codec.encoding_digest(docs, tokenizer_path())


STAGES = [
    ("language ID", language_id),
    ("line dedup", line_dedup),
    ("MinHash near-dedup", near_dedup),
    ("mixing sources", source_mixing),
    ("BPE encoding", bpe_encoding),
]

#: Fitted models, MinHash and BPE are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def _remove(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever store it lies."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; every stage but the last is written to the shared folder and reread. A stage's
    table is deleted when the next one is written; that of the last but one stays, as the result reads it.
    An empty table gives an empty result."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = shared_folder(spark, "pipeline")
    for i, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
        if i:
            _remove(spark, f"{folder}/{i - 1}")
    return STAGES[-1][1](spark, docs, sf_dir)
