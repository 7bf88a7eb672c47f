"""Sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_table(spark: SparkSession, path: str, schema: StructType | str | None = None, required=()) -> DataFrame:
    """CSV, TSV (also gzipped) or Parquet by the path's ending, with a check of required columns. A schema
    for text formats saves the pass that would infer it; without one all columns are strings."""
    plain = path.removesuffix(".gz")
    if plain.endswith((".csv", ".tsv", ".txt")):
        reader = spark.read.option("header", True).option("sep", "," if plain.endswith(".csv") else "\t")
        df = (reader.schema(schema) if schema is not None else reader).csv(path)
    else:
        reader = spark.read
        df = (reader.schema(schema) if schema is not None else reader).parquet(path)
    return require_columns(df, required)


def require_columns(df: DataFrame, required) -> DataFrame:
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


#: start and end of a gene on + and -: offsets from the 1-based start and the end of the line.
TSS_MODES = {"zero_both": (-1, -1), "zero_start": (-1, 0), "one": (0, 0)}


def parse_gtf(lines: DataFrame, tss_mode: str = "one", feature: str = "gene", column: str = "value", gene_types=()) -> DataFrame:
    """gene, gene_id, gene_type, chrom (with chr), start, end, strand, tss of the lines of one feature ("gene" or
    "transcript", which adds transcript_id and transcript_type). Lines without a gene_name, or not of nine fields, are
    dropped; so are genes of other types, if gene_types are given. Of genes of one id and place, and of transcripts of
    one id, the first in order of all columns stays."""
    first, last = TSS_MODES[tss_mode]
    part = F.split(column, "\t")
    attribute = lambda name: F.nullif(F.regexp_extract(F.element_at("_p", 9), f'\\b{name} "([^"]*)"', 1), F.lit(""))
    d = lines.filter(~F.col(column).startswith("#")).select(part.alias("_p")).filter(F.size("_p") == 9).filter(F.element_at("_p", 3) == feature)
    chrom = F.element_at("_p", 1)
    start, end = F.element_at("_p", 4).cast("long"), F.element_at("_p", 5).cast("long")
    named = [attribute("gene_name").alias("gene"), F.coalesce(attribute("gene_id"), F.lit("")).alias("gene_id"), F.coalesce(attribute("gene_type"), attribute("gene_biotype"), F.lit("")).alias("gene_type")]
    if feature == "transcript":
        named += [F.coalesce(attribute("transcript_id"), F.lit("")).alias("transcript_id"), F.coalesce(attribute("transcript_type"), attribute("transcript_biotype"), F.lit("")).alias("transcript_type")]
    d = d.select(*named, F.when(chrom.startswith("chr"), chrom).otherwise(F.concat(F.lit("chr"), chrom)).alias("chrom"), start.alias("_s"), end.alias("_e"), F.element_at("_p", 7).alias("strand")).filter("gene is not null")
    if gene_types:
        d = d.filter(F.col("gene_type").isin(*gene_types))
    tss = F.when(F.col("strand") == "-", F.col("_e") + last).otherwise(F.col("_s") + first)
    names = [c for c in d.columns if c not in ("_s", "_e", "strand")]
    d = d.select(*names, (F.col("_s") + first).alias("start"), F.col("_e").alias("end"), "strand", tss.alias("tss"))
    same = ["transcript_id"] if feature == "transcript" else ["gene_id", "chrom", "start", "end"]
    return d.groupBy(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(same)]).agg(F.min(F.struct(*d.columns)).alias("_r")).select("_r.*")


def read_gtf(spark: SparkSession, path: str, tss_mode: str = "one", feature: str = "gene", gene_types=()) -> DataFrame:
    return parse_gtf(spark.read.text(path), tss_mode, feature, gene_types=gene_types)


#: Peak names, split from the right: separator before start, separator before end.
PEAK_STYLES = {"colon": (":", "-"), "dash": ("-", "-"), "underscore": ("_", "_")}


def parse_peak(df: DataFrame, column: str, style: str = "colon") -> DataFrame:
    """Adds chrom, start, end, midpoint (half to even) and centre; rows that do not match are dropped."""
    a, b = PEAK_STYLES[style]
    pattern = f"^(.+){a}([0-9]+){b}([0-9]+)$"
    d = df.filter(F.col(column).rlike(pattern))
    part = lambda i: F.regexp_extract(column, pattern, i)
    d = d.withColumn("chrom", part(1)).withColumn("start", part(2).cast("long")).withColumn("end", part(3).cast("long"))
    return d.withColumn("midpoint", F.bround((F.col("start") + F.col("end")) / 2).cast("long")).withColumn("centre", (F.col("start") + F.col("end")) * 0.5)


def parse_training_log(lines: DataFrame, file: str = "file", number: str = "line_no", line: str = "line") -> DataFrame:
    """file, line_no, stage, iteration, loss, avg from lines such as 'iter 10 loss 1.5e-3 avg 2.0e-3' (avg is null
    where a line has none); 'stage NAME' headers are carried forward within a file, null before the first."""
    stage = F.nullif(F.regexp_extract(line, r"(?i)^\s*stage[ :=]+(\S+)", 1), F.lit(""))
    it = F.nullif(F.regexp_extract(line, r"(?i)\b(?:iter|epoch)[ :=]+(\d+)", 1), F.lit(""))
    loss = F.nullif(F.regexp_extract(line, r"(?i)\bloss[ :=]+([-+0-9.eE]+)", 1), F.lit(""))
    mean = F.nullif(F.regexp_extract(line, r"(?i)\b(?:avg|average|mean)(?:[ _]loss)?[ :=]+([-+0-9.eE]+)", 1), F.lit(""))
    best = F.lower(line).contains("best")
    d = lines.withColumn("stage", F.last(stage, ignorenulls=True).over(Window.partitionBy(file).orderBy(number)))
    d = d.withColumn("iteration", it.cast("long") + F.when(best, 1).otherwise(0)).withColumn("loss", loss.cast("double")).withColumn("avg", mean.cast("double"))
    return d.filter("iteration is not null and loss is not null").select(file, number, "stage", "iteration", "loss", "avg")


def write_table(df: DataFrame, path: str, format: str = "parquet", overwrite: bool = False, **options) -> None:
    """CSV, JSON or Parquet; refuses to overwrite unless asked to."""
    writer = df.write.mode("overwrite" if overwrite else "errorifexists").options(**options)
    writer.format(format).option("header", True).save(path) if format == "csv" else writer.format(format).save(path)
