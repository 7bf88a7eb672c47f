"""Mixing sources to target weights along a low-discrepancy schedule; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The weights of the sources in order, repeating.
WEIGHTS = (5, 2, 1)
#: A target, and the use of a document, stops at this many times its size.
REPEATS = 3
#: The schedule has 2**SLOT_BITS points, and one slot more at most for each source; slots of one source
#: take blocks of equal size.
SLOT_BITS = 17
#: Hex digits of the hash that order a source's documents: 16**CELL_DIGITS cells.
CELL_DIGITS = 3

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def reversed_bits(x: Column, bits: int = SLOT_BITS) -> Column:
    """The van der Corput sequence in base 2, as integers below 2**bits."""
    out = F.lit(0).cast("long")
    for i in range(bits):
        out = out + F.shiftleft(F.shiftright(x, i).bitwiseAND(F.lit(1)), bits - 1 - i)
    return out


def _keyed(docs: DataFrame) -> DataFrame:
    """Rows as key (of the source, never null), doc_id, size, order (a digest of doc_id and text, either
    of which may be null), cell."""
    source, doc_id = F.col("source").cast("string"), F.col("doc_id").cast("long")
    return docs.select(
        *row_key(docs), source.alias("source"), doc_id.alias("doc_id"), word_count(F.col("text").cast("string")).alias("size"),
    ).withColumn("cell", F.substring("order", 1, CELL_DIGITS))


def source_plan(sizes: DataFrame) -> DataFrame:
    """From key, source, source_size: weight, target, words (the target as a whole number).

    The targets share the sum of the sizes by weight; where a share would exceed REPEATS times the
    source's size it stops there. Sources that stop are those with the least size per weight, so in
    that order one pass of running sums finds them all.
    """
    by_code_point = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.row_number().over(by_code_point) - 1) % len(WEIGHTS)) + 1)
    s = sizes.withColumn("weight", weight.cast("long")).withColumn("cap", F.col("source_size") * REPEATS)
    by_ratio = Window.orderBy((F.col("cap").cast("double") / F.col("weight")), F.col("source").asc_nulls_last())
    every = Window.partitionBy(F.lit(0))
    s = s.withColumn("total", F.sum("source_size").over(every)).withColumn("at", F.row_number().over(by_ratio))
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0))
    weights = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    s = s.withColumn("level", left.cast("double") / weights)
    stops = F.col("cap") <= F.col("level") * F.col("weight")
    free = F.min(F.when(~stops, F.struct("at", "level"))).over(every)["level"]
    s = s.withColumn("target", F.when(stops, F.col("cap").cast("double")).otherwise(free * F.col("weight")))
    return s.withColumn("words", F.least(F.floor(F.col("target") + 0.5).cast("long"), F.col("cap"))).drop("cap", "at", "level")


def _with_slots(plan: DataFrame) -> DataFrame:
    """Sources with a target: first (their first point) and slots (their number).

    A source owns the stretch of the points between the running sums of the targets, and one point at
    least, so that a source far below a slot's share of the whole still has a slot."""
    whole = float(1 << SLOT_BITS)
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    upto = F.sum("target").over(in_order.rowsBetween(Window.unboundedPreceding, 0))
    edge = F.greatest(F.least(F.round(F.col("upto") * whole / F.col("total")), F.lit(whole)), F.lit(0.0)).cast("long")
    p = plan.filter("total > 0").withColumn("upto", upto).withColumn("high", edge)
    p = p.withColumn("first", F.least(F.lag("high", 1, 0).over(in_order), F.lit((1 << SLOT_BITS) - 1).cast("long"))).filter("words > 0")
    return p.withColumn("slots", F.greatest(F.col("high") - F.col("first"), F.lit(1).cast("long"))).drop("upto", "high")


def schedule(plan: DataFrame) -> DataFrame:
    """slot, key, rank, low, high: the source of every slot and the words of the source that it takes.

    Slot k stands at the k-th van der Corput point. A source's points are generated from its stretch,
    without a join, and ranked. Its documents, laid end to end and repeated, are cut in blocks of equal
    numbers of words (to a word), as many as it has slots, which together hold its target; the slot of
    rank r takes block r, [low, high). A source's block has the source's own length, so every source
    meets its target whatever the sum of all.
    """
    p = _with_slots(plan)
    points = p.select("key", "words", "slots", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("slots") - 1)).alias("point"))
    ranked = points.withColumn("slot", reversed_bits(F.col("point")))
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy("slot")).cast("long") - 1)
    edge = lambda r: F.expr(f"({r}) * (words div slots) + ({r}) * (words % slots) div slots")  # noqa: E731  the whole part of r * words / slots
    return ranked.select("slot", "key", "rank", edge("rank").alias("low"), edge("rank + 1").alias("high"))


#: The rank of the slot whose block holds word `at` of a source; bigints hold it up to 7e13 words.
_RANK = "CAST(((%s) + 1) * slots - 1 AS BIGINT) div words"


def _laid(rows: DataFrame, words: str) -> tuple[DataFrame, DataFrame]:
    """rows (key, source, order, cell, ...) with start, the place of their `words` in their source, and
    source_size, target, words, slots; and the plan. Running sums are taken over the cells of a source and
    inside a cell, so a hot source is spread over 16**CELL_DIGITS tasks."""
    cells = rows.groupBy("key", "source", "cell").agg(F.sum(words).alias("cell_size"))
    plan = source_plan(cells.groupBy("key", "source").agg(F.sum("cell_size").alias("source_size")))
    before = Window.partitionBy("key").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("cell_start", F.coalesce(F.sum("cell_size").over(before), F.lit(0))).drop("source", "cell_size")
    cells = cells.join(plan.select("key", "source_size", "target"), "key").join(_with_slots(plan).select("key", "words", "slots"), "key", "left")
    inside = Window.partitionBy("key", "cell").orderBy("order", words)
    upto = F.sum(words).over(inside.rowsBetween(Window.unboundedPreceding, 0))
    placed = rows.drop("source").withColumn("upto", upto).withColumn("nth", F.row_number().over(inside)).join(cells, ["key", "cell"])
    return placed.withColumn("start", F.col("cell_start") + F.col("upto") - F.col(words)).drop("cell_start", "upto"), plan


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken, n_parts, first_slot of every row: the words that the mix takes from it, in
    how many pieces (one for each block of a slot that meets one of its repeats), and the first slot of the schedule in
    which words of it stand (-1 if none does).

    Sources come in the order of their code points, null last; WEIGHTS repeat over them. A source's
    documents are shuffled by a digest of doc_id and text, laid end to end and repeated; the slots of the
    schedule are joined to the blocks of this line. taken is the overlap of the document, in each of its
    repeats, with the blocks: a source gives its target, to half a word, and a document at most REPEATS
    times its size. How much is taken follows from the blocks; where it stands in the mix from the schedule: the
    points deal the slots to sources, and the slots of a source its blocks.

    A document is expanded to the blocks that it touches, in all at most the number of slots plus REPEATS
    times that of documents. Sources themselves (one row each) are summed over windows without a key.

    A null text or one without words has size 0 and taken 0. Null doc_ids, ties and repeated rows are
    rows of their own. A source without words has target 0. Other columns are ignored; an empty table
    gives an empty result. Reruns agree.
    """
    laid, plan = _laid(_keyed(docs), "size")
    again = F.expr("CASE WHEN size > 0 AND start < words THEN sequence(0L, (words - 1 - start) div source_size) END")
    laid = laid.withColumn("again", F.explode_outer(again)).withColumn("from", F.expr("start + again * source_size")).withColumn("to", F.expr("least(from + size, words)"))
    touched = laid.withColumn("rank", F.explode_outer(F.sequence(F.expr(_RANK % "from"), F.expr(_RANK % "to - 1"))))
    taken = touched.join(schedule(plan), ["key", "rank"], "left").withColumn("part", F.expr("least(to, high) - greatest(from, low)"))
    found = [F.coalesce(F.sum("part"), F.lit(0)).cast("long").alias("taken"), F.count_if(F.col("part") > 0).alias("n_parts"), F.coalesce(F.min(F.when(F.col("part") > 0, F.col("slot"))), F.lit(-1).cast("long")).alias("first_slot")]  # a block may be empty
    return taken.groupBy("key", "cell", "nth", "doc_id", "size", "source_size", "target").agg(*found).select("doc_id", "size", "source_size", "target", "taken", "n_parts", "first_slot")


#: What tells rows apart in copies(); rows that agree in it differ in nothing that mixing reads.
ROW = ["order", "key"]


def row_key(docs: DataFrame) -> list[Column]:
    """The columns ROW of documents; neither is null."""
    doc_id, text = F.col("doc_id").cast("long").cast("string"), F.col("text").cast("string")
    order = F.md5(F.concat(F.coalesce(doc_id, F.lit("")), F.lit("/"), F.coalesce(F.md5(text.cast("binary")), F.lit(""))).cast("binary"))
    return [order.alias("order"), F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("null")).alias("key")]


def copies(docs: DataFrame) -> DataFrame:
    """order, key, number, slots: the slots of the schedule that take the number-th of the rows that agree in
    ROW into a mix of whole documents. Rows without words, and such that are never taken, are not there.

    The line, blocks and slots are those of mix(); a slot takes the documents whose middle word lies in its
    block. So every source comes within half a document of its own target, whatever the total.
    """
    rows = _keyed(docs).groupBy(*ROW, "source", "cell", "size").agg(F.count("*").alias("n")).withColumn("all_words", F.expr("n * size"))
    laid, plan = _laid(rows, "all_words")
    one = laid.filter("size > 0 AND start < words").withColumn("number", F.explode(F.expr("sequence(1L, n)"))).withColumn("middle", F.expr("start + (number - 1) * size + size div 2"))
    again = F.expr("CASE WHEN middle < words THEN sequence(0L, (words - 1 - middle) div source_size) END")
    hit = one.withColumn("again", F.explode(again)).withColumn("rank", F.expr(_RANK % "middle + again * source_size"))
    return hit.join(schedule(plan), ["key", "rank"]).groupBy(*ROW, "number").agg(F.sort_array(F.collect_list("slot")).alias("slots"))
