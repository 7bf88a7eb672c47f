"""Line dedup: winnowing over line hashes, matched runs extended both ways, later repeats deleted."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from .batches import map_batches, whole_texts
from .components import checkpoint, join_hot
from .shingles import mixed

#: A run of lines counts as a repeat from this many words on.
MIN_WORDS = 50
#: Odd multipliers of the two rolling hashes of a run.
_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
ROW = ["doc_id", "text_hash"]


def _hash(raw: bytes) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(raw)


def lines_of(text: str) -> tuple[list[int], list[bytes], list[int]]:
    """Numbers, bytes and words of the lines (split at \\n) that have a word."""
    parts = [(i, raw, len(raw.split())) for i, raw in enumerate(text.encode().split(b"\n"))]
    parts = [p for p in parts if p[2]]
    return [p[0] for p in parts], [p[1] for p in parts], [p[2] for p in parts]


def _line_hashes(lines: list[bytes]) -> np.ndarray:
    """Two 64-bit hashes of each line."""
    import xxhash

    return np.frombuffer(b"".join(xxhash.xxh3_128_digest(x) for x in lines), dtype="<u8").reshape(-1, 2).T.copy()


def _run_hash(values: np.ndarray, odd: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """A hash of values[low:high] for each pair of bounds, from running sums."""
    n = len(values)
    power = np.cumprod(np.full(n, odd, dtype=np.uint64))
    back = np.cumprod(np.full(n, pow(odd, -1, 1 << 64), dtype=np.uint64))
    upto = np.r_[np.uint64(0), np.cumsum(mixed(values) * power, dtype=np.uint64)]
    return mixed((upto[high] - upto[low]) * back[low])


def _least_places(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The place of the least of values[low:high], the leftmost of equals, for each pair of bounds."""
    width = high - low
    level = np.frexp(width)[1] - 1  # the greatest power of two that fits
    place, out = np.arange(len(values)), np.empty(len(low), dtype=np.int64)
    for k in range(int(level.max(initial=0)) + 1):
        here = level == k
        a, b = place[low[here]], place[high[here] - (1 << k)]
        out[here] = np.where(values[b] < values[a], b, a)
        a, b = place[: len(place) - (1 << k)], place[1 << k :]
        place = np.where(values[b] < values[a], b, a)
    return out


def windows(words: np.ndarray, first: np.ndarray, end: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the shortest runs of lines with min_words words, from each line and up to each line, within
    the text [first, end) of the line. Of the runs with min_words words that hold a line, the least by
    inclusion are all among these; so a line stands in a run that occurs earlier if and only if it stands in
    one of these that does."""
    upto, lines = np.r_[0, np.cumsum(words)], np.arange(len(words))
    after = np.searchsorted(upto, upto[:-1] + min_words)
    low, high = lines[after <= end], after[after <= end]
    before = np.searchsorted(upto, upto[1:] - min_words, side="right") - 1
    new = (before >= first) & (after[np.maximum(before, 0)] != lines + 1)
    return np.r_[low, before[new]], np.r_[high, lines[new] + 1]


def merged(part: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs [low, high) of each part extended over those that overlap or touch them: part, low, high."""
    order = np.lexsort((low, part))
    part, low, high = part[order], low[order], high[order]
    far = int(high.max(initial=0)) + 1
    reach = np.maximum.accumulate(part * far + high)
    starts = np.flatnonzero(np.r_[np.ones(min(1, len(low)), dtype=bool), (low[1:] > reach[:-1] - part[1:] * far)])
    return part[starts], low[starts], np.maximum.reduceat(reach, starts) - part[starts] * far if len(starts) else low[:0]


def _stretches(begin: np.ndarray, size: np.ndarray, step: int) -> np.ndarray:
    """begin, begin + step, ... of each given size, one stretch after the other."""
    inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    return np.repeat(begin, size) + step * inside


def _fingerprint_rows(min_words: int):
    """A row for each selected minimum of a text: its hash and place, the windows whose minimum it is, and the
    lines as far as these windows reach, outwards from it: `right` from the place on, `left` before it, two
    numbers a line. A window that stands in its text before is not there; such windows, merged, are a row
    without a hash."""

    def rows(doc_ids, texts):
        known = [(d, t) for d, t in zip(doc_ids, texts) if d is not None and t]
        own = np.array([_hash(t.encode()) for _, t in known], dtype=np.uint64).view(np.int64)
        ids = np.array([d for d, _ in known], dtype=np.int64)
        parts = [lines_of(t) for _, t in known]
        count = np.array([len(p[0]) for p in parts], dtype=np.int64)
        ends = np.cumsum(count)
        text_of = np.repeat(np.arange(len(known)), count)
        first, end = (ends - count)[text_of], ends[text_of]
        low, high = windows(np.array([w for p in parts for w in p[2]], dtype=np.int64), first, end, min_words)
        if not len(low):
            none = pa.array([], pa.list_(pa.int32())), pa.array([], pa.list_(pa.int64()))
            return [], [], [], [], none[0], none[0], none[1], none[1], none[1], none[1]
        h = _line_hashes([x for p in parts for x in p[1]])
        k1, k2 = (_run_hash(h[i], _ODD[i], low, high).view(np.int64) for i in (0, 1))
        text, place = text_of[low], _least_places(h[0], low, high)
        order = np.lexsort((low, k2, k1, text))
        again = np.zeros(len(low), dtype=bool)
        a, b = order[:-1], order[1:]
        again[b] = (text[a] == text[b]) & (k1[a] == k1[b]) & (k2[a] == k2[b])
        new = np.flatnonzero(~again)
        new = new[np.lexsort((low[new], place[new]))]
        heads = np.flatnonzero(np.r_[True, np.diff(place[new]) > 0])
        repeats, r_low, r_high = merged(text[again], low[again], high[again])
        r_heads = np.flatnonzero(np.r_[np.ones(min(1, len(repeats)), dtype=bool), np.diff(repeats) > 0])
        at = np.r_[text[new[heads]], repeats[r_heads]]

        def lists(a, b, kind):
            offsets = np.r_[heads, len(new) + r_heads, len(new) + len(repeats)].astype(np.int32)
            return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.r_[a, b], type=kind))

        selected = place[new[heads]]

        def lines_along(begin, size, step):
            offsets = np.r_[0, np.cumsum(2 * size), np.full(len(r_heads), 2 * size.sum())].astype(np.int32)
            return pa.ListArray.from_arrays(pa.array(offsets), pa.array(h.view(np.int64)[:, _stretches(begin, size, step)].T.ravel()))

        def least(ufunc, bounds):
            return ufunc.reduceat(bounds[new], heads) if len(heads) else selected

        begin = first[low[new]]
        r_begin = (ends - count)[repeats]
        none = np.zeros(len(repeats), dtype=np.int64)
        unset = [None] * len(r_heads)
        prints = pa.array([*h[0].view(np.int64)[selected].tolist(), *unset], pa.int64())
        places = pa.array([*(selected - first[selected]).tolist(), *unset], pa.int32())
        return (
            pa.array(ids[at]), pa.array(own[at]), prints, places, lists(low[new] - begin, r_low - r_begin, pa.int32()), lists(high[new] - begin, r_high - r_begin, pa.int32()),
            lists(k1[new], none, pa.int64()), lists(k2[new], none, pa.int64()),
            lines_along(selected - 1, selected - least(np.minimum, low), -1), lines_along(selected, least(np.maximum, high) - selected, 1),
        )

    return rows


#: What a task writes for each selected position (see _fingerprint_rows).
_POSITION = "doc_id long, text_hash long, print long, at int, lows array<int>, highs array<int>, k1s array<long>, k2s array<long>, left array<long>, right array<long>"


def _equal_lines(a: str, b: str) -> Column:
    """The number of lines over which two lists of lines agree from their start on."""
    same = F.zip_with(a, b, lambda x, y: x.eqNullSafe(y))
    differs = F.array_position(same, F.lit(False))
    return F.floor(F.when(differs > 0, differs - 1).otherwise(F.size(same)) / 2).cast("int")


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, text_hash, low, high: runs of lines (places among the lines that have a word) that stand
    earlier too, in the order of doc_id and place. Runs that overlap or touch belong together (see merged).

    1. Winnowing: the windows of a text are its shortest runs of lines with min_words words (see windows); the
       least line hash of a window is selected, with its position, once for all windows that it is least in.
       Two texts that share a run of min_words words share a window and with it a fingerprint; those that occur
       in one text only are done with.
    2. Positions are joined with the earliest position of their fingerprint, and the match is extended both ways:
       line by line, left and right, over 128 bits of each line, as far as the windows of the position reach. What
       then holds a window repeats. Runs longer than that go on in the matches of the positions beside.
    3. A window that goes beyond its match may stand in some other text before. What is left of them meets by
       fingerprint and 128 bits of all its lines, each with its earliest text; no pair of texts is compared twice.

    So a run is found whatever texts its parts stand in first. Within one text windows are compared in the
    task that reads it. Hot fingerprints and windows are combined before the shuffle and salted in the joins."""
    texts = whole_texts(docs).filter("doc_id is not null")
    found = checkpoint(map_batches(texts, _fingerprint_rows(min_words), _POSITION))
    text = F.xxhash64(*ROW)  # a repeated row is the same text
    positions = found.filter("print is not null")
    often = checkpoint(positions.groupBy("print").agg(F.min(text).alias("a"), F.max(text).alias("z"), F.count("*").alias("n")).filter("a <> z").select("print", "n"))
    shared = checkpoint(join_hot(positions, often, ["print"], [*ROW, "at"]))
    place = F.struct(*ROW)
    earliest = shared.groupBy("print").agg(F.min(F.struct(*ROW, "at", "left", "right")).alias("e"), F.count("*").alias("n"))
    earliest = checkpoint(earliest.select("print", F.struct("e.doc_id", "e.text_hash").alias("first"), F.col("e.left").alias("first_left"), F.col("e.right").alias("first_right"), "n"))
    met = join_hot(shared, earliest, ["print"], [*ROW, "at"])
    met = met.withColumn("from", F.col("at") - _equal_lines("left", "first_left")).withColumn("to", F.col("at") + _equal_lines("right", "first_right"))
    window = F.arrays_zip("lows", "highs", "k1s", "k2s")
    within = lambda w: (w["lows"] >= F.col("from")) & (w["highs"] <= F.col("to"))
    met = met.withColumn("whole", F.filter(window, lambda w: within(w) & (place != F.col("first"))))
    met = met.select("print", *ROW, F.array_min("whole.lows").alias("low"), F.array_max("whole.highs").alias("high"), F.filter(window, lambda w: ~within(w)).alias("beyond"))
    met = checkpoint(met.filter("low is not null or size(beyond) > 0"))
    matched = met.filter("low is not null").select(*ROW, "low", "high")
    key = ["print", "k1", "k2"]
    left = met.select("print", *ROW, F.explode("beyond").alias("w")).select("print", *ROW, F.col("w.lows").alias("low"), F.col("w.highs").alias("high"), F.col("w.k1s").alias("k1"), F.col("w.k2s").alias("k2"))
    firsts = checkpoint(left.groupBy(*key).agg(F.min(place).alias("first"), F.max(place).alias("last"), F.count("*").alias("n")).filter("first <> last").select(*key, "first", "n"))
    later = join_hot(left, firsts, key, ROW).filter(place != F.col("first")).select(*ROW, "low", "high")
    inside = found.filter("print is null").select(*ROW, F.explode(F.arrays_zip("lows", "highs")).alias("w")).select(*ROW, F.col("w.lows").alias("low"), F.col("w.highs").alias("high"))
    return matched.unionByName(later).unionByName(inside)


def _signed(x: list[int]) -> list[int]:
    return np.array(x, dtype=np.uint64).view(np.int64).tolist()


def _packed(texts) -> list[bytes | None]:
    """Texts as they travel through the shuffle to their runs: about half of the block compression's size."""
    import zstandard

    pack = zstandard.ZstdCompressor(level=1).compress
    return [None if t is None else pack(t.encode()) for t in texts]


def _cleaned(doc_ids, packed, spans):
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    out, n_lines, removed, words = [], [], [], []
    for t, runs in zip([None if p is None else unpack(p).decode() for p in packed], spans):
        n_lines.append(0 if t is None else t.count("\n") + 1)
        if t is None or not runs:
            out.append(t)
            removed.append(0)
            words.append(0)
            continue
        numbers, _, sizes = lines_of(t)
        low, high = (np.array([r[k] for r in runs], dtype=np.int64) for k in ("low", "high"))
        gone = [k for a, b in zip(*merged(np.zeros_like(low), low, high)[1:]) for k in range(a, b)]
        drop = {numbers[k] for k in gone}
        out.append("\n".join(line for i, line in enumerate(t.split("\n")) if i not in drop))
        removed.append(len(drop))
        words.append(int(sum(sizes[k] for k in gone)))
    return doc_ids, n_lines, removed, words, out


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, n_lines, n_removed, words_removed, text of every row: the text without those runs of lines
    that repeat an earlier run of at least min_words words, wherever it stands (see repeated_runs).

    Lines without a word neither break a run nor are deleted. The first occurrence of any line stays. A
    null text stays null with no lines; a text of fewer than min_words words, or whose lines are all
    common but short, is left alone. Rows with a null doc_id are left as they are and nothing is matched
    to them. Rows of one doc_id and equal text are one document (a repeated row is not its own copy).
    Other columns are ignored; an empty table gives an empty result.
    """
    joined = _with_spans(whole_texts(docs), min_words).select("doc_id", "text", "spans")
    return map_batches(joined, _cleaned, "doc_id long, n_lines long, n_removed long, words_removed long, text string")


def dedup_documents(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """All rows and columns of docs with the text as dedup_lines leaves it."""
    names = docs.columns
    at = names.index("text")

    def clean(*columns):
        out = list(columns[:-1])
        out[at] = _cleaned(None, columns[at], columns[-1])[-1]
        return out

    return map_batches(_with_spans(docs, min_words).select(*names, "spans"), clean, docs.schema)


def _with_spans(docs: DataFrame, min_words: int) -> DataFrame:
    """docs with the text packed, text_hash, and spans, the runs to delete (null: none). Rows of one text meet its
    one row of spans; adaptive execution splits them where they are many."""
    runs = repeated_runs(docs, min_words)
    # at most a pair for each line of one text
    spans = runs.groupBy(*ROW).agg(F.sort_array(F.collect_set(F.struct("low", "high"))).alias("spans"))
    at = docs.columns.index("text")

    def hashed(*columns):
        texts = columns[at]
        return [*columns[:at], _packed(texts), *columns[at + 1 :], _signed([_hash((t or "").encode()) for t in texts])]

    fields = [StructField(f.name, BinaryType()) if i == at else f for i, f in enumerate(docs.schema.fields)]
    return map_batches(docs, hashed, StructType([*fields, StructField("text_hash", LongType())])).join(spans, ROW, "left")
