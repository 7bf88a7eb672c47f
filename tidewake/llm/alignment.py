"""Alignment of two tokenizers over the same bytes by diagonal run skipping, and counts of linked token pairs."""

from __future__ import annotations

import functools
import gc
import hashlib
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import chain, count, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from . import bpe
from .batches import whole_texts
from .components import shared_folder

#: Documents, and bytes of them, that make a chunk; a larger text is alone.
CHUNK_ROWS, CHUNK_BYTES = 4096, 1 << 21
#: Stretches, and links of them, that a task holds at most before the next chunk; so many are encoded as one text.
HELD_ROWS, HELD_LINKS, BUNCH = 300_000, 3_000_000, 256
#: Id pairs are dealt to this many buckets, whose counts a task holds at once: at most 1 / BUCKETS of the
#: pairs that two vocabularies can form.
BUCKETS = 256
#: Chunks whose requests to a bucket are answered together.
ASKED = 512


#: Splits at a single space between two characters that are no white space.
_between_words = re.compile(r" (?=\S)(?<=\S )").split


class ByteTokens:
    """A byte-level BPE file (.json). A space leads the text; special strings are ordinary text."""

    #: No token reaches over a single space between two words from the left, and none is chosen by what is beyond it:
    #: pre-tokens end there.
    splits = True

    def __init__(self, path: str):
        self.vocab = bpe.vocabulary(path)
        self.pairs = bpe.PairTable(self.vocab.merges)
        self.bytes_of = self.vocab.bytes_of
        #: Every byte has a token, and merging loses none.
        self.lossless = all(self.bytes_of[i] == bytes([b]) for b, i in enumerate(self.vocab.id_of_byte))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        split, place = [bpe.pre_tokens(" " + t) for t in texts], defaultdict(count().__next__)
        words = np.cumsum(_array(map(len, split), len(split)))
        word = _array(map(place.__getitem__, chain.from_iterable(split)), sum(map(len, split)))
        merged = bpe.merge_many(self.vocab, self.pairs, [w.encode() for w in place])
        n = _array(map(len, merged), len(merged))
        flat = _array(chain.from_iterable(merged), int(n.sum()))[_places(np.cumsum(n) - n, n, word)]
        return np.split(flat, np.r_[0, np.cumsum(n[word])][words][:-1])


class PieceTokens:
    """A sentence-piece file (.model), which leads the text with a space by itself. It may normalise a text."""

    lossless = False

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.vocab_size())]
        self.bytes_of = [b"" if self.model.is_control(i) else bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.splits = self._splits()

    def _splits(self) -> bool:
        """Whether merging is the plain one over the text as it is, and no piece has a space behind another character:
        then nothing is merged over a single space between two words."""
        try:
            from sentencepiece import sentencepiece_model_pb2
        except ImportError:
            return False
        proto = sentencepiece_model_pb2.ModelProto.FromString(self.model.serialized_model_proto())
        norm, trainer = proto.normalizer_spec, proto.trainer_spec
        as_it_is = not norm.precompiled_charsmap and not norm.normalization_rule_tsv and not norm.remove_extra_whitespaces and norm.add_dummy_prefix and norm.escape_whitespaces
        plain = trainer.model_type == trainer.BPE and not trainer.treat_whitespace_as_suffix and not any(p.type == p.USER_DEFINED for p in proto.pieces)
        return bool(as_it_is and plain and not any("▁" in p.piece.lstrip("▁") for p in proto.pieces))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(ids, dtype=np.int64) for ids in self.model.encode(texts, num_threads=1)]


def _array(values: Iterable[int], n: int) -> np.ndarray:
    return np.fromiter(values, dtype=np.int64, count=n)


def _places(starts: np.ndarray, n: np.ndarray, of: np.ndarray) -> np.ndarray:
    """The places starts[i] to starts[i] + n[i] - 1 of each i in of, one behind the other."""
    m = n[of]
    return np.repeat(starts[of] - np.cumsum(m) + m, m) + np.arange(m.sum())


@functools.cache
def tokens(path: str) -> ByteTokens | PieceTokens:
    return ByteTokens(path) if path.endswith(".json") else PieceTokens(path)


def irregular(a: list[int], b: list[int]) -> list[int]:
    """The irregular groups of two rising lists of ends with the same last value, one behind the other: the first
    place in a and in b, and those behind the last. Between them tokens go one to one.

    At the current shift between the two lists, slices that double in length are compared and, after the first
    that differs, halved again; so a stretch of n equal ends is jumped in about 2 log2(n) comparisons. At an end that
    differs the list that is behind moves on until the two meet; their new places are the new shift."""
    found: list[int] = []
    i, n, shift = 0, len(a), 0
    while i < n:
        x, y = a[i], b[i + shift]
        if x == y:
            i += 1
            step = 2
            j = i + shift
            while i < n and a[i : i + step] == b[j : j + step]:
                i += step
                j += step
                step *= 2
            while step > 1:
                step //= 2
                if a[i : i + step] == b[j : j + step]:
                    i += step
                    j += step
            if i >= n:
                break
            x, y = a[i], b[j]
        start, j = i, i + shift
        first = j
        while x != y:
            if x < y:
                i += 1
                x = a[i]
            else:
                j += 1
                y = b[j]
        i += 1
        j += 1
        found += (start, first, i, j)
        shift = j - i
    return found


def aligned(ends: tuple[np.ndarray, np.ndarray]):
    """For tokens of a and of b with these ends over the same bytes: the places in them at which groups end, and the
    places of the two tokens of each link, in any order.

    Equal ends of texts close a group, so texts that lie one behind the other are aligned in one go."""
    odd = np.array(irregular(*(e.tolist() for e in ends)), dtype=np.int64).reshape(-1, 4)
    inner, links, until = [], [], []
    for k, e in enumerate(ends):
        step = np.zeros(len(e) + 1, dtype=np.int8)
        step[odd[:, k]] += 1
        step[odd[:, k + 2]] -= 1
        inside = np.cumsum(step[:-1], dtype=np.int8).astype(bool)
        last = ~inside
        last[odd[:, k + 2] - 1] = True
        until.append(np.flatnonzero(last) + 1)
        links.append(np.flatnonzero(~inside))
        inner.append(e[inside])
    # links: one of each pair of single tokens; inside a larger group one for each stretch between neighbouring ends
    between = np.sort(np.r_[inner[0], inner[1]], kind="stable")
    between = between[np.r_[True, between[1:] != between[:-1]]] if len(between) else between
    return until, [np.r_[x, np.searchsorted(e, between)] for x, e in zip(links, ends)]


def groups_text(flat: list[np.ndarray], until: list[np.ndarray], shown: list[str], tops: tuple[int, int]) -> list[str]:
    """The tokens of all groups in order, as strings that joined give `a1,a2|b1;a3|b2,b3;`. tops: ids of a and b;
    shown: names of a followed by a comma, by a bar, names of b followed by a comma, by a semicolon."""
    last = [np.zeros(len(f), dtype=np.int32) for f in flat]
    for l, u in zip(last, until):
        l[u - 1] = 1
    group = [np.cumsum(l, dtype=np.int32) - l for l in last]
    out = np.empty(len(flat[0]) + len(flat[1]), dtype=np.int32)
    before = np.r_[0, until[1]]  # tokens of b in earlier groups
    out[np.arange(len(flat[0])) + before[group[0]]] = flat[0] + last[0] * tops[0]
    out[np.arange(len(flat[1])) + until[0][group[1]]] = flat[1] + last[1] * tops[1] + 2 * tops[0]
    return list(map(shown.__getitem__, out.tolist()))


class Stretches:
    """The stretches of texts between the single spaces over which neither tokenizer reaches (whole texts, if one may
    reach over them), each encoded and aligned once while it is held: a row each."""

    def __init__(self, path_a: str, path_b: str):
        self.both = tokens(path_a), tokens(path_b)
        self.sizes = [_array(map(len, t.bytes_of), len(t.bytes_of)) for t in self.both]
        self.tops = tops = [len(s) for s in self.sizes]
        self.shown = [f"{i}{mark}" for n, marks in zip(tops, (",|", ",;")) for mark in marks for i in range(n)]
        self.splits = all(t.splits for t in self.both)
        self.clear()

    def clear(self) -> None:
        self.row: dict[str, int] = defaultdict(count().__next__)
        #: Of each row: tokens of a, tokens of b, groups, links; whether both tokenizers give its bytes back.
        self.n, self.sound = np.zeros((4, 0), dtype=np.int64), np.zeros(0, dtype=bool)
        #: Id pairs of the links of all rows, and where those of a row start; the groups of a row as a string.
        self.codes, self.starts, self.text = np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int64), []

    def rows(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The rows of the stretches of all texts in order, and how many each text has."""
        if len(self.row) > HELD_ROWS or len(self.codes) > HELD_LINKS:
            self.clear()
        split = [(_between_words(t) if self.splits else [t]) if t else [] for t in texts]
        n = _array(map(len, split), len(split))
        known = len(self.row)
        rows = _array(map(self.row.__getitem__, chain.from_iterable(split)), int(n.sum()))
        if len(self.row) > known:
            self._learn(list(islice(self.row, known, None)))
        return rows, n

    def _bunches(self, new: list[str]) -> list[list[int]]:
        """Stretches that are encoded as one text. One that ends in white space stays alone, as that could go on."""
        if not self.splits:
            return [[i] for i in range(len(new))]
        out: list[list[int]] = []
        kinds: dict[bool, list[int]] = {True: [], False: []}
        for i, s in enumerate(new):
            if s[-1].isspace():
                out.append([i])
            else:
                kinds[s.isascii()].append(i)
        for some in kinds.values():
            out += [some[i : i + BUNCH] for i in range(0, len(some), BUNCH)]
        return out

    def _encoded(self, t: ByteTokens | PieceTokens, new: list[str], bunches: list[list[int]]) -> dict[int, tuple[list[int], np.ndarray]]:
        """By their first stretch the bunches that t gives back, with their tokens; a bunch that it does not is tried
        stretch by stretch."""
        out, again, texts = {}, [], [" ".join([new[i] for i in b]) for b in bunches]
        for b, text, ids in zip(bunches, texts, t.encode(texts)):
            if t.lossless or b"".join(map(t.bytes_of.__getitem__, ids.tolist())) == b" " + text.encode():
                out[b[0]] = b, ids
            elif len(b) > 1:
                again += [[i] for i in b]
        return out | self._encoded(t, new, again) if again else out

    def _learn(self, new: list[str]) -> None:
        first = self._encoded(self.both[1], new, self._bunches(new))
        second = self._encoded(self.both[0], new, [b for b, _ in first.values()])
        if (held := [b for b, _ in second.values()]) != [b for b, _ in first.values()]:
            first = self._encoded(self.both[1], new, held)  # b follows a into smaller bunches
        keys = list(first)
        order = _array(chain.from_iterable(first[k][0] for k in keys), sum(len(first[k][0]) for k in keys))
        flat = [np.concatenate([np.zeros(0, dtype=np.int64), *(of[k][1] for k in keys)]) for of in (second, first)]
        ends = [np.cumsum(s[f]) for s, f in zip(self.sizes, flat)]
        upto_bytes = np.cumsum(_array((len(new[i].encode()) + 1 for i in order.tolist()), len(order)))
        upto = [np.searchsorted(e, upto_bytes) + 1 for e in ends]  # tokens up to and with each stretch
        until, links = aligned(ends)
        of = np.searchsorted(upto[0], links[0], side="right")
        by = np.argsort(of, kind="stable")
        codes = (flat[0][links[0]] * self.tops[1] + flat[1][links[1]])[by]
        n_links = np.bincount(of, minlength=len(order))
        n = np.zeros((4, len(new)), dtype=np.int64)
        for k, x in enumerate((*upto, np.searchsorted(until[0], upto[0], side="right"))):
            n[k, order] = np.diff(np.r_[0, x])
        n[3, order] = n_links
        sound, starts = np.zeros(len(new), dtype=bool), np.zeros(len(new), dtype=np.int64)
        sound[order], starts[order] = True, len(self.codes) + np.cumsum(n_links) - n_links
        text, shown = [""] * len(new), groups_text(flat, until, self.shown, self.tops)
        cut = np.r_[0, upto[0] + upto[1]].tolist() if len(order) else [0]
        for i, low, high in zip(order.tolist(), cut, cut[1:]):
            text[i] = "".join(shown[low:high])
        self.n, self.sound, self.starts = np.c_[self.n, n], np.r_[self.sound, sound], np.r_[self.starts, starts]
        self.codes = np.r_[self.codes, codes.astype(np.int32)]
        self.text += text


@functools.cache
def stretches(path_a: str, path_b: str) -> Stretches:
    return Stretches(path_a, path_b)


_CHUNK = (
    "chunk long, doc_id array<long>, n_a array<int>, n_b array<int>, n_groups array<int>, n_links array<int>, groups_sha256 array<string>, "
    "codes array<int>, times array<int>, n_pairs array<int>, at array<int>, n array<int>"
)


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of CHUNK_ROWS and about CHUNK_BYTES at most."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy()) if batch.num_rows else []
    at = 0
    while at < batch.num_rows:
        most = (upto[at - 1] if at else 0) + CHUNK_BYTES
        end = min(max(at + 1, int(np.searchsorted(upto, most, side="right"))), at + CHUNK_ROWS)
        yield batch.slice(at, end - at)
        at = end


def _chunks(path_a: str, path_b: str, schema: pa.Schema):
    """One row a chunk of documents: their figures, the distinct id pairs (a * size of b + b) linked in it with their
    numbers of links, and the pairs of each document as places in that list."""

    def run(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        held = stretches(path_a, path_b)
        size = held.tops[0] * held.tops[1]
        gc.disable()  # lists of tokens hold no cycles, and are many
        try:
            for batch in batches:
                for part in _parts(batch):
                    ids, texts = (c.to_pylist() for c in part.columns)
                    row, n = held.rows(texts)
                    doc = np.repeat(np.arange(len(ids)), n)
                    lost = np.bincount(doc[~held.sound[row]], minlength=len(ids)) > 0
                    row, doc, n = row[~lost[doc]], doc[~lost[doc]], np.where(lost, 0, n)
                    figures = [np.diff(np.r_[0, np.cumsum(x[row])][np.r_[0, np.cumsum(n)]]) for x in held.n]
                    codes = held.codes[_places(held.starts, held.n[3], row)]
                    pairs, n_pair = np.unique(np.repeat(np.arange(len(ids)), figures[3]) * size + codes, return_counts=True)
                    codes, at = np.unique(pairs % size, return_inverse=True)
                    times = np.bincount(at, weights=n_pair, minlength=len(codes)).astype(np.int64)
                    text, cut = list(map(held.text.__getitem__, row.tolist())), np.r_[0, np.cumsum(n)].tolist()
                    sha = [hashlib.sha256("".join(text[low:high])[:-1].encode()).hexdigest() if low < high else "" for low, high in zip(cut, cut[1:])]
                    number += 1
                    out = [number, ids, *figures, sha, codes, times, np.bincount(pairs // size, minlength=len(ids)), at, n_pair]
                    yield pa.RecordBatch.from_arrays([pa.array([x.astype(f.type.value_type.to_pandas_dtype()) if isinstance(x, np.ndarray) else x], type=f.type) for x, f in zip(out, schema)], schema=schema)
        finally:
            gc.enable()

    return run


def _bucket(codes: np.ndarray) -> np.ndarray:
    return (codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(56)).astype(np.int64) % BUCKETS


def _requests(salts: int):
    """Each chunk's codes, dealt to buckets."""

    def run(batches):
        for batch in batches:
            for chunk, codes in zip(batch.column(0).to_pylist(), batch.column(1)):
                codes = codes.values.to_numpy(zero_copy_only=False)
                bucket = _bucket(codes)
                order = np.argsort(bucket, kind="stable")
                found, starts = np.unique(bucket[order], return_index=True)
                rows = np.split(codes[order], starts[1:]) if len(found) else []
                arrays = [pa.array(found), pa.array([((chunk >> 32) + chunk) % salts] * len(found), pa.int64()), pa.array([chunk] * len(found), pa.int64()), pa.array(rows, pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(arrays, ["bucket", "salt", "chunk", "codes"])

    return run


def _answers(counts: pa.Table, asked: pa.Table) -> pa.Table:
    code, n, best = (counts[c].to_numpy() for c in ("code", "n", "best"))
    order = np.argsort(code)
    code, n, best = code[order], n[order], best[order]
    found = [np.searchsorted(code, c.values.to_numpy(zero_copy_only=False)) for c in asked["codes"]]
    columns = [asked["bucket"], asked["chunk"], pa.array([n[x] for x in found], pa.list_(pa.int64())), pa.array([best[x] for x in found], pa.list_(pa.bool_()))]
    return pa.table(columns, names=["bucket", "chunk", "n", "best"])


def _totals(chunks: pa.Table, answers: pa.Table) -> pa.Table:
    """Rows of the documents of a chunk."""
    out = []
    for r in range(chunks.num_rows):
        row = {c: chunks[c][r] for c in chunks.column_names}
        codes = row["codes"].values.to_numpy(zero_copy_only=False)
        order = np.argsort(_bucket(codes), kind="stable")  # as the requests were laid out
        answered = np.argsort(answers["bucket"].to_numpy())
        count, best = np.zeros(len(codes), dtype=np.int64), np.zeros(len(codes), dtype=bool)
        if len(codes):
            count[order] = np.concatenate([answers["n"][int(i)].values.to_numpy(zero_copy_only=False) for i in answered])
            best[order] = np.concatenate([answers["best"][int(i)].values.to_numpy(zero_copy_only=False) for i in answered])
        at, n = (row[c].values.to_numpy(zero_copy_only=False) for c in ("at", "n"))
        upto = np.r_[0, np.cumsum(row["n_pairs"].values.to_numpy(zero_copy_only=False))]
        both = np.c_[n * best[at], n * count[at]].astype(np.int64)
        sums = np.r_[np.zeros((1, 2), dtype=np.int64), np.cumsum(both, axis=0)]
        sums = sums[upto[1:]] - sums[upto[:-1]]
        same = {c: row[c].values.cast(pa.int64()) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")}
        out.append(pa.table({**same, "n_best": sums[:, 0], "count_sum": sums[:, 1], "groups_sha256": row["groups_sha256"].values}))
    return pa.concat_tables(out)


def align_documents(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each whole text.

    Both tokenizers encode a space and the text; byte offsets at which tokens of both end cut them into groups. A
    link is a pair of token occurrences whose bytes overlap; the count of an id pair is how many links of all
    documents hold it. n_best: links whose count is the highest of their b id; count_sum: over all links.

    1. Chunks of documents are encoded and aligned in one pass, without a shuffle, and written to the shared
       folder with their distinct pairs (so nothing is encoded twice, and a lost executor costs a chunk). Where neither
       tokenizer reaches over a single space between words, a stretch between such spaces that comes again is not encoded
       again while its task holds it.
    2. Counts are summed over the distinct pairs of chunks, combined before the shuffle.
    3. Chunks ask 256 buckets of pairs for their counts, in packed arrays, and sum the answers by document. A
       bucket's counts are repeated for every 512 chunks, so no pair is hot.

    A text that is null or empty, or whose tokens do not give its bytes back, has no tokens: zeros and ''. A null
    doc_id and repeated rows come through; other columns are ignored; an empty table gives an empty result.
    Tokenizer files must be readable on every executor."""
    spark = docs.sparkSession
    folder = shared_folder(spark, "alignment")
    schema = to_arrow_schema(StructType.fromDDL(_CHUNK))
    whole_texts(docs).mapInArrow(_chunks(path_a, path_b, schema), _CHUNK).write.option("compression", "zstd").parquet(folder)
    chunks = spark.read.parquet(folder)
    salts = -(-max(1, chunks.count()) // ASKED)
    size_b = len(tokens(path_b).bytes_of)
    summed = chunks.select(F.explode(F.arrays_zip("codes", "times")).alias("x")).groupBy(F.col("x.codes").alias("code")).agg(F.sum("x.times").alias("n"))
    summed.write.parquet(f"{folder}-counts")
    counts = spark.read.parquet(f"{folder}-counts")
    highest = counts.groupBy((F.col("code") % size_b).alias("b")).agg(F.max("n").alias("most"))
    counts = counts.withColumn("b", F.col("code") % size_b).join(F.broadcast(highest), "b")  # a row for each id of b at most

    def placed(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_bucket(batch.column(0).to_numpy())), *batch.columns], ["bucket", "code", "n", "best"])

    counts = counts.select("code", "n", (F.col("n") == F.col("most")).alias("best")).mapInArrow(placed, "bucket long, code int, n long, best boolean")
    counts = counts.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    requests = chunks.select("chunk", "codes").mapInArrow(_requests(salts), "bucket long, salt long, chunk long, codes array<int>")
    answers = counts.groupBy("bucket", "salt").cogroup(requests.groupBy("bucket", "salt")).applyInArrow(_answers, "bucket long, chunk long, n array<long>, best array<boolean>")
    kind = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_totals, kind)
