"""Labels, filters, predicates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import Keys


def canonical_label(df: DataFrame, column: str, aliases: dict[str, str], default: str, known: Keys | None = None) -> DataFrame:
    """Trimmed upper case through the alias table; null, '' and 'NAN' become the default, labels that are
    not known 'OTHER'."""
    v = F.upper(F.trim(F.col(column).cast("string")))
    pairs = [F.lit(x) for kv in aliases.items() for x in kv]
    alias = F.coalesce(F.try_element_at(F.create_map(*pairs), v), v) if pairs else v
    out = F.when(v.isNull() | v.isin("", "NAN"), F.lit(default)).otherwise(alias)
    if known is not None:
        out = F.when(out.isin(*known, default), out).otherwise("OTHER")
    return df.withColumn(column, out)


def group_label(df: DataFrame, column: str, groups: DataFrame) -> DataFrame:
    """Adds lineage from groups (label, lineage); fails on a label without one."""
    d = df.join(groups.withColumnRenamed("label", column), column, "left")
    return d.filter(F.assert_true(F.col("lineage").isNotNull(), "a label has no group").isNull())


def compatibility_rules(pairs: DataFrame, rules: DataFrame) -> DataFrame:
    """source, target, class: compatible, ambiguous, or incompatible where no rule (source, target, class) says."""
    return pairs.join(rules, ["source", "target"], "left").select("source", "target", F.coalesce("class", F.lit("incompatible")).alias("class"))


def eligible_groups(df: DataFrame, g: Keys, least: int, exclude: Keys = ()) -> DataFrame:
    """Groups of more than `least` rows, the first key not excluded; largest first."""
    d = df.filter(~F.col(g[0]).isin(*exclude)) if exclude else df
    return d.groupBy(*g).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > least).orderBy(F.desc("n"), *g)


def require_unique(df: DataFrame, keys: Keys) -> DataFrame:
    """The rows as they are; fails if a key occurs twice."""
    twice = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    checked = twice.filter(F.assert_true(F.col("_n") == 1, "a key is not unique").isNull()).drop("_n")
    return df.join(checked, list(keys), "left_semi")


def merge_checked(left: DataFrame, right: DataFrame, keys: Keys) -> DataFrame:
    """Left join m:1; fails if the right side repeats a key or a left row has no partner."""
    r = require_unique(right, keys).withColumn("_there", F.lit(True))
    return left.join(r, list(keys), "left").filter(F.assert_true(F.col("_there").isNotNull(), "a row has no partner").isNull()).drop("_there")
