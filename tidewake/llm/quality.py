"""Quality rules: a table of thresholds compiled into column expressions, without user functions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .mixing import WORD

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = ("the of and to in is that for with as was on at by this be are from or it an he "
              "der die das und ist von zu den mit im für auf nicht ein eine sich auch dem des als "
              "le la les et de du un une que qui pour dans est par sur au avec pas il elle "
              "el los las en y por con para una se del al lo su es").split()  # fmt: skip

#: name of the ratio, least, most (None: open); a document is kept if every ratio lies within.
RULES: tuple[tuple[str, float | None, float | None], ...] = (
    ("n_words", 50, None),
    ("mean_word_chars", 2.0, 14.0),
    ("symbols_per_word", None, 0.1),
    ("dup_line_share", None, 0.3),
    ("stop_word_share", 0.04, None),
)

_SMALL = 64


def _prefix_tree(words: list[str]) -> str:
    """A pattern for any of the words that branches on one character at a time."""
    heads = sorted({w[0] for w in words if w})
    branches = [re.escape(h) + _prefix_tree([w[1:] for w in words if w[:1] == h]) for h in heads]
    if not branches:
        return ""
    return "(?:" + "|".join(branches) + ")" + ("?" if "" in words else "")


_STOP = r"(?:^|[\x20\x09-\x0D])" + _prefix_tree(STOP_WORDS) + r"(?=[.,;:!?]*(?:[\x20\x09-\x0D]|\z))"


def _repeat_words(few: Column, placed: Column, hashes: Column, repeated: Column) -> Column:
    """Words inside 3-word windows whose hash occurs twice or more; placed: (hash, position) in order."""
    by_hash = F.transform(
        F.filter(F.transform(placed, lambda x, i: F.struct(x["i"].alias("i"), (((i > 0) & (F.get(placed, F.greatest(i - 1, F.lit(0)))["h"] == x["h"])) | F.coalesce(F.get(placed, i + 1)["h"] == x["h"], F.lit(False))).alias("twice"))), lambda x: x["twice"]),
        lambda x: x["i"],
    )
    starts = F.when(few, F.filter(F.sequence(F.lit(0), F.size(hashes) - 1), lambda i: F.array_contains(repeated, F.get(hashes, i)))).otherwise(by_hash)
    covered = F.size(F.array_distinct(F.flatten(F.transform(starts, lambda i: F.array(i, i + 1, i + 2)))))
    return F.when(F.size(repeated) == 0, 0).otherwise(covered).cast("long")


def measures(docs: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_stop_words."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    a = docs.select(F.col(id_column).cast("long").alias("doc_id"), text.alias("text"))
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    a = a.select(
        "doc_id", F.regexp_extract_all("text", F.lit(WORD), 0).alias("words"), lines.alias("lines"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"), F.regexp_count(F.lower("text"), F.lit(_STOP)).cast("long").alias("n_stop_words"),
        
    )
    windows = F.when(F.size("words") >= 3, F.transform(F.sequence(F.lit(0), F.size("words") - 3), lambda i: F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2))))
    a = a.select(
        "doc_id", F.size("words").cast("long").alias("n_words"), F.length(F.array_join("words", "")).cast("long").alias("word_chars"), "n_symbols", "n_stop_words", F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), F.coalesce(windows, F.array().cast("array<bigint>")).alias("hashes"),
    )
    a = a.withColumn("in_order", F.sort_array("hashes"))
    a = a.withColumn("repeated", F.array_distinct(F.filter("in_order", lambda x, i: (i > 0) & (x == F.get("in_order", i - 1)))))
    few = F.size("repeated") <= _SMALL
    a = a.withColumn("placed", F.when(~few, F.sort_array(F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    return a.select("doc_id", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", _repeat_words(few, F.col("placed"), F.col("hashes"), F.col("repeated")).alias("n_repeat_words"), "n_stop_words")


def verdict(rules=RULES) -> Column:
    """The rule table as one boolean expression over the measures (ratios of a text without words are null: not kept)."""
    words = F.nullif(F.col("n_words"), F.lit(0)).cast("double")
    ratio = {
        "n_words": F.col("n_words").cast("double"),
        "mean_word_chars": F.col("word_chars") / words,
        "symbols_per_word": F.col("n_symbols") / words,
        "dup_line_share": F.col("n_dup_lines") / F.nullif(F.col("n_lines"), F.lit(0)).cast("double"),
        "stop_word_share": F.col("n_stop_words") / words,
    }
    out = F.lit(True)
    for name, least, most in rules:
        if least is not None:
            out = out & (ratio[name] >= least)
        if most is not None:
            out = out & (ratio[name] <= most)
    return F.coalesce(out, F.lit(False))


def judge(docs: DataFrame, rules=RULES) -> DataFrame:
    """The measures of every row with base_failed and kept.

    base_failed: under 50 words, or more than half of the words in repeated 3-word windows. kept: not
    base_failed and within all rules. Windows are compared by a 64-bit hash of their words. A null
    text counts as empty: no words, base_failed. A null doc_id, ties and repeated rows come through;
    an empty table gives an empty result; other columns are ignored. Nothing is shuffled.
    """
    failed = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    m = measures(docs).withColumn("base_failed", failed)
    return m.withColumn("kept", ~F.col("base_failed") & verdict(rules))
