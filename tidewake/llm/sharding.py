"""Sharding by a minimax contiguous partition of ordered atomic groups."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import checkpoint

#: Groups of equal texts are ordered by a 64-bit hash; its first UNIT_BITS bits gather them in units, whose
#: sizes the driver sees. Units in which a cut may fall are split by the next SPLIT_BITS bits, again and
#: again, down to single groups.
UNIT_BITS, SPLIT_BITS = 16, 8
#: A shard's rows are numbered in this many cells.
CELLS = 1 << 12
#: Rows of one kind that are written together.
PIECE = 1 << 16


def fits(sizes: Sequence[int], shards: int, capacity: int) -> bool:
    """Greedy check: filling shards in order, none above capacity, needs at most `shards` of them."""
    return len(cuts(sizes, capacity)) < shards


def cuts(sizes: Sequence[int], capacity: int) -> list[int]:
    """Positions at which the greedy filling starts a new shard; capacity is at least the largest size."""
    upto, out, at = np.cumsum(np.asarray(sizes, dtype=np.int64)), [], 0
    while at < len(sizes):
        full = int(upto[at - 1]) if at else 0
        at = int(np.searchsorted(upto, full + capacity, side="right"))
        if at < len(sizes):
            out.append(at)
    return out


def smallest_capacity(sizes: Sequence[int], shards: int) -> int:
    """Binary search for the smallest capacity that the greedy check finds feasible."""
    if not len(sizes):
        return 0
    total, largest = int(sum(sizes)), int(max(sizes))
    low, high = max(largest, -(-total // shards)), total // shards + largest + 1
    while low < high:
        middle = (low + high) // 2
        if fits(sizes, shards, middle):
            high = middle
        else:
            low = middle + 1
    return low


def even_cuts(sizes: Sequence[int], shards: int, capacity: int) -> list[int]:
    """Positions at which shards start when each is cut as near as it can be to its share of what is left,
    none above capacity, which is feasible. None is empty while there are units enough."""
    n, upto = len(sizes), np.r_[0, np.cumsum(np.asarray(sizes, dtype=np.int64))]
    from_ = [n]  # the least start from which 0, 1, ... shards hold all the rest
    for _ in range(shards - 1):
        from_.append(int(np.searchsorted(upto, upto[from_[-1]] - capacity)))
    out, at = [], 0
    for after in range(shards - 1, 0, -1):
        goal = upto[at] + (upto[n] - upto[at]) / (after + 1)
        end = int(np.searchsorted(upto, goal))
        end -= end > 0 and goal - upto[end - 1] < upto[end] - goal
        full = int(np.searchsorted(upto, upto[at] + capacity, side="right")) - 1
        end = max(min(end, full, n - after), from_[after], at + 1)
        if end >= n:
            break
        out.append(end)
        at = end
    return out


def balanced_cuts(sizes: Sequence[int], shards: int) -> list[int]:
    """Cuts whose largest shard is the least possible, with the other shards near equal."""
    starts = {a for a, _, _ in layout(sizes, shards)}
    for a, b, k in layout(sizes, shards):
        run = np.asarray(sizes[a:b], dtype=np.int64)
        starts |= {a + x for x in even_cuts(run, k, smallest_capacity(run, k))}
    return sorted(starts - {0})


def layout(sizes: Sequence[int], shards: int) -> list[tuple[int, int, int]]:
    """Runs of units (start, end, number of shards) that are cut on their own, in order.

    A unit above the mean of what is left would set the capacity of all; it gets a shard of its own. The runs
    between such units share the other shards, the next one going to the run of the largest capacity. Where
    that would exceed the least capacity of the whole, or shards do not suffice, fewer units stand alone."""
    sizes = np.asarray(sizes, dtype=np.int64)
    if not len(sizes):
        return []
    capacity, left = smallest_capacity(sizes, shards), int(sizes.sum())
    hot: list[int] = []
    for at in np.argsort(-sizes, kind="stable")[: shards - 1].tolist():
        if sizes[at] * (shards - len(hot)) <= left:
            break
        hot.append(at)
        left -= int(sizes[at])
    for m in range(len(hot), 0, -1):
        alone = sorted(hot[:m])
        runs = [(a, b) for a, b in zip([0, *(x + 1 for x in alone)], [*alone, len(sizes)]) if a < b]
        spare = shards - m - len(runs)
        if spare < 0 or len(sizes) <= shards:
            continue
        share = [1] * len(runs)
        need = [smallest_capacity(sizes[a:b], 1) for a, b in runs]
        for _ in range(spare):
            open_ = [i for i, (a, b) in enumerate(runs) if share[i] < b - a]
            i = max(open_, key=lambda i: need[i])
            share[i] += 1
            need[i] = smallest_capacity(sizes[runs[i][0] : runs[i][1]], share[i])
        if max(need) <= capacity:
            return sorted([(x, x + 1, 1) for x in alone] + [(a, b, k) for (a, b), k in zip(runs, share)])
    return [(0, len(sizes), shards)]


def _ends(sizes: np.ndarray, single: np.ndarray, shards: int, capacity: int, divisible: bool) -> np.ndarray:
    """Where greedy filling ends each shard, in bytes from the start. A unit that is not single may be cut
    anywhere if divisible, else nowhere; so real groups, which lie between, end between the two."""
    upto, out, at = np.r_[0, np.cumsum(sizes)], np.empty(shards, dtype=np.int64), 0
    for k in range(shards):
        goal = min(at + capacity, int(upto[-1]))
        unit = int(np.searchsorted(upto, goal, side="right")) - 1  # starts at goal or holds it
        at = max(goal if divisible and unit < len(sizes) and not single[unit] else int(upto[unit]), at)
        out[k] = at
    return out


def undecided(sizes: Sequence[int], single: Sequence[bool], shards: int) -> np.ndarray:
    """Units with several groups that have to be split before the cuts are known to be the best over single
    groups. The least capacity lies between what it would be if they could be cut anywhere and if nowhere;
    wherever a shard may end for a capacity between these, they are undecided."""
    sizes, single = np.asarray(sizes, dtype=np.int64), np.asarray(single, dtype=bool)
    large = ~single & (sizes * shards * 4 > sizes.sum())  # may hold a group that stands alone
    if large.any():
        return np.flatnonzero(large)
    out = np.zeros(len(sizes), dtype=bool)
    for a, b, k in layout(sizes, shards):
        size, one = sizes[a:b], single[a:b]
        total, high = int(size.sum()), smallest_capacity(size, k)
        low, most = max(-(-total // k), int(size[one].max(initial=0))), high
        while low < most:
            middle = (low + most) // 2
            if _ends(size, one, k, middle, True)[-1] == total:
                most = middle
            else:
                low = middle + 1
        if low < high:
            upto = np.r_[0, np.cumsum(size)]
            for first, last in zip(_ends(size, one, k, low, False), _ends(size, one, k, high, True)):
                out[a:b] |= (upto[1:] > first) & (upto[:-1] <= last)
    return np.flatnonzero(out & ~single)


def _units(digests: DataFrame, bits: int) -> DataFrame:
    """prefix, size, single (whether one group only) by the first bits of the hash."""
    h = F.shiftright("hash", 64 - bits) if bits < 64 else F.col("hash")
    return digests.groupBy(h.alias("prefix")).agg(F.sum("size").alias("size"), (F.min("hash") == F.max("hash")).alias("single"))


def starts_of_shards(digests: DataFrame, shards: int, unit_bits: int = UNIT_BITS) -> list[int]:
    """The least hash of every shard but the first, from hash and size of all rows."""
    units = sorted((r["prefix"] << (64 - unit_bits), unit_bits, r["size"], r["single"]) for r in _units(digests, unit_bits).collect())
    while units:
        open_ = undecided([u[2] for u in units], [u[3] for u in units], shards).tolist()
        if not open_:
            break
        for bits in sorted({units[i][1] for i in open_}):
            old = [units[i][0] for i in open_ if units[i][1] == bits]
            wide = min(64, bits + SPLIT_BITS)
            inside = digests.filter(F.shiftright("hash", 64 - bits).isin([h >> (64 - bits) for h in old]))
            found = [(r["prefix"] << (64 - wide), wide, r["size"], r["single"]) for r in _units(inside, wide).collect()]
            units = sorted([u for u in units if u[0] not in set(old) or u[1] != bits] + found)
    return [units[i][0] for i in balanced_cuts([u[2] for u in units], shards)]


def shard_documents(docs: DataFrame, shards: int = 24, unit_bits: int = UNIT_BITS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row, under the law `bytes`.

    size is the UTF-8 bytes of the text (null: none) plus 8. Rows of equal text (null texts too are
    equal to each other) are an atomic group; groups are ordered by hash. The smallest capacity with
    which greedy filling needs no more than `shards` shards is binary-searched; the cuts are evened out below it.
    The driver sees sizes of units of groups, at most 2**unit_bits; those in which a cut may fall (a few for
    every shard) are split until the search is decided over single groups, whatever their number. A group
    that alone is larger than a shard should be gets a shard of its own where it can, and the runs before and
    after it are searched on their own, so that the others are near equal (see layout).

    slot numbers a shard's rows from 0 without gaps: rows fall in CELLS cells by a hash of doc_id and text
    and are numbered inside a cell; counts of cells before it (at most shards * CELLS rows, broadcast) are
    added. Rows that agree in all that is returned are counted before the shuffle, numbered as one, and written
    again in pieces of PIECE rows. No task holds a whole shard, nor all copies of a row. text_crc32 is null for a null text; a null doc_id, ties and
    repeated rows are numbered like any others; an empty table gives an empty result; other columns are
    ignored. Only digests of texts leave the scan; they are written once and read by every step.
    """
    text = F.col("text").cast("string")
    doc_id = F.col("doc_id").cast("long")
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8
    hash_ = F.xxhash64(text.isNull(), text)
    digests = docs.select(
        doc_id.alias("doc_id"), size.alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), hash_.alias("hash"),
        F.pmod(F.xxhash64(doc_id, hash_, F.lit("cell")), F.lit(CELLS)).cast("int").alias("cell"),
    )
    digests = checkpoint(digests)
    shard = F.lit(0)
    for start in starts_of_shards(digests, shards, unit_bits):
        shard = shard + (F.col("hash") >= F.lit(start).cast("long")).cast("int")
    rows = digests.withColumn("shard", shard).drop("hash")
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("shard", "cell").agg(F.count("*").alias("n"))
    offsets = counts.select("shard", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    alike = ["doc_id", "size", "text_crc32", "shard", "cell"]
    inside = Window.partitionBy("shard", "cell").orderBy(F.col("doc_id").asc_nulls_first(), "text_crc32", "size").rowsBetween(Window.unboundedPreceding, 0)
    kinds = rows.groupBy(*alike).agg(F.count("*").alias("n")).withColumn("upto", F.sum("n").over(inside))
    kinds = kinds.join(F.broadcast(offsets), ["shard", "cell"]).withColumn("start", F.col("before") + F.col("upto") - F.col("n"))
    pieces = kinds.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(PIECE).cast("long"))))
    pieces = pieces.repartition("shard", "cell", "piece")  # the rows of one kind, however many, are written by many tasks
    slot = F.explode(F.sequence(F.col("start") + F.col("piece"), F.col("start") + F.least(F.col("n"), F.col("piece") + PIECE) - 1))
    return pieces.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", slot.alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
