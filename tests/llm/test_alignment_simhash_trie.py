"""Cross-tokenizer alignment, SimHash near-duplicates and the prefix trie against brute force and edge cases."""

import copy
import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from tidewake.llm import alignment, simhash, trie
from tidewake.llm.queries import tokenizer_path

DOCS = "doc_id long, text string, chunk string, code int, n int, key int, bucket int, fingerprint string"
PIECES = "piece_bpe_32k.model"


def frame(spark, texts, ids=None):
    """Documents with columns of clashing names beside the two."""
    return spark.createDataFrame([(i, t, "x", 1, 2, 3, 4, "y") for i, t in zip(ids or range(len(texts)), texts)], DOCS)


# --- alignment


def linked_by_hand(texts):
    """Rows of the contract by two plain pointers over the libraries' tokens."""
    import sentencepiece
    from tokenizers import Tokenizer

    a_model = Tokenizer.from_file(tokenizer_path())
    a_model.encode_special_tokens = True
    b_model = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(PIECES))
    a_bytes, b_bytes = alignment.tokens(tokenizer_path()).bytes_of, alignment.tokens(tokenizer_path(PIECES)).bytes_of
    counts, per = Counter(), []
    for t in texts:
        a = a_model.encode(" " + (t or ""), add_special_tokens=False).ids if t else []
        b = b_model.encode(t) if t else []
        want = (" " + (t or "")).encode()
        if not t or b"".join(a_bytes[x] for x in a) != want or b"".join(b_bytes[x] for x in b) != want:
            per.append(None)
            continue
        spans = [np.r_[0, np.cumsum([len(of[x]) for x in ids])].tolist() for of, ids in ((a_bytes, a), (b_bytes, b))]
        links, j = [], 0
        for i in range(len(a)):
            k = j
            while k < len(b) and spans[1][k] < spans[0][i + 1]:
                if spans[1][k + 1] > spans[0][i]:
                    links.append((a[i], b[k]))
                k += 1
            j = max(j, k - 1)
        cuts = sorted(set(spans[0]) & set(spans[1]))
        groups = []
        for low, high in zip(cuts, cuts[1:]):
            groups.append("|".join(",".join(str(x) for x, end in zip(ids, s[1:]) if low < end <= high) for ids, s in zip((a, b), spans)))
        counts.update(links)
        per.append((len(a), len(b), groups, links))
    best = defaultdict(int)
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    out = []
    for p in per:
        if p is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
        else:
            a, b, groups, links = p
            out.append((a, b, len(groups), len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return out


def test_alignment_is_that_of_two_pointers(spark):
    rng = random.Random(3)
    words = ["the", "naïve", "tokenisation", "你好", "x1²", "don't", "<|endoftext|>", "<s>", "  ", "\n\n", "\t", "qzxjv", "…", "Ａ"]
    texts = [None, "", " ", "a", "a▁b", "▁", "<unk> <0x41>", "x" * 20_000, "ab " * 9_000, "dup", "dup"]
    texts += [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 60))) for _ in range(60)]
    ids = [None, *range(1, len(texts))]
    ids[10] = 9  # a repeated row
    got = alignment.align_documents(frame(spark, texts, ids), tokenizer_path(), tokenizer_path(PIECES)).collect()
    assert Counter(tuple(r) for r in got) == Counter((i, *w) for i, w in zip(ids, linked_by_hand(texts)))
    assert got[0].__fields__ == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_alignment_of_no_documents_and_of_none_with_tokens(spark):
    assert alignment.align_documents(frame(spark, []), tokenizer_path(), tokenizer_path(PIECES)).count() == 0
    got = alignment.align_documents(frame(spark, [None, "", "▁"]), tokenizer_path(), tokenizer_path(PIECES)).collect()
    assert {tuple(r)[1:] for r in got} == {(0, 0, 0, 0, 0, 0, "")}


def test_runs_are_jumped_and_irregular_groups_found():
    rng = random.Random(4)
    for _ in range(300):
        ends = sorted(rng.sample(range(1, 200), rng.randrange(1, 60)))
        a = [x for x in ends if rng.random() < 0.9 or x == ends[-1]]
        b = [x for x in ends if rng.random() < 0.9 or x == ends[-1]]
        odd, i, j = alignment.irregular(a, b), 0, 0
        for i0, j0, i1, j1 in zip(*[iter(odd)] * 4):
            assert a[i:i0] == b[j:j0]
            assert a[i1 - 1] == b[j1 - 1] and not set(a[i0 : i1 - 1]) & set(b[j0 : j1 - 1]) and (i1 - i0, j1 - j0) != (1, 1)
            i, j = i1, j1
        assert a[i:] == b[j:]


def chunks_here(monkeypatch, texts):
    """Figures of texts without Spark, each batch a chunk of three documents."""
    import pyspark

    monkeypatch.setattr(pyspark, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    monkeypatch.setattr(alignment, "CHUNK_ROWS", 3)
    monkeypatch.setattr(alignment, "stretches", alignment.Stretches)  # none held from before
    kinds = {"long": pa.int64(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "array<string>": pa.list_(pa.string())}
    schema = pa.schema([(name, kinds[kind]) for name, kind in map(str.split, alignment._CHUNK.split(", "))])
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], ["doc_id", "text"])
    rows = []
    for chunk in alignment._chunks(tokenizer_path(), tokenizer_path(PIECES), schema)(iter([batch])):
        c = chunk.to_pylist()[0]
        rows += zip(*(c[x] for x in ("n_a", "n_b", "n_groups", "n_links", "groups_sha256")))
    return rows


def test_a_word_that_comes_again_is_not_encoded_again(monkeypatch):
    done, encode = [], alignment.PieceTokens.encode
    monkeypatch.setattr(alignment.PieceTokens, "encode", lambda self, texts: done.extend(texts) or encode(self, texts))
    rng = random.Random(8)
    texts = [" ".join(rng.choice(["alpha", "naïve", "beta,", "x1"]) for _ in range(500)) for _ in range(20)]
    got = chunks_here(monkeypatch, texts)
    assert sum(map(len, done)) < 100
    assert got == [(*w[:4], w[6]) for w in linked_by_hand(texts)]


@pytest.mark.parametrize("held", [300_000, 2])
@pytest.mark.parametrize("splits", [True, False])
def test_stretches_are_independent_of_what_is_around_them(monkeypatch, held, splits):
    monkeypatch.setattr(alignment, "HELD_ROWS", held)
    monkeypatch.setattr(alignment.ByteTokens, "splits", splits)
    rng = random.Random(9)
    gaps = [" "] * 12 + ["  ", "   ", "\n", " \n", "\n ", "\n\n ", "\t", "\u00a0", " \u00a0", "\u2028 ", "\u3000", "\x1c", " \x1c ", "\x85 ", ""]
    words = ["the", "The", "word.", "naïve", "don't", "'s", "12", "你好", "e\u0301", "\u0301", "…", "\x00", "<s>", "<0x41>", "<|endoftext|>", "🙂", "\u200b", "ab▁", "▁ab"]
    texts = ["".join(rng.choice(gaps) + rng.choice(words[: 17 + 2 * (k % 5 == 0)]) for _ in range(rng.randrange(1, 25))) + rng.choice(gaps) for k in range(150)]
    assert chunks_here(monkeypatch, texts) == [(*w[:4], w[6]) for w in linked_by_hand(texts)]


def test_a_tokenizer_that_loses_a_byte_loses_only_its_texts(monkeypatch):
    left = copy.copy(alignment.tokens(tokenizer_path()))
    left.lossless, left.bytes_of = False, [b.replace(b"q", b"") for b in left.bytes_of]
    true = alignment.tokens
    monkeypatch.setattr(alignment, "tokens", lambda path: left if path == tokenizer_path() else true(path))
    got = chunks_here(monkeypatch, ["a queue", "a word", "word queue", "▁ word", "more words"])
    assert [r[0] > 0 for r in got] == [False, True, False, False, True]
    assert [got[1], got[4]] == [(*w[:4], w[6]) for w in linked_by_hand(["a word", "more words"])]


# --- SimHash


def print_by_hand(text):
    import xxhash

    words = (text or "").encode().lower().split()
    size = min(3, len(words))
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + size]), 42) for i in range(len(words) - size + 1)] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components_by_hand(prints):
    """The least id that each row reaches over pairs at two differing bits or fewer."""
    at = list(range(len(prints)))

    def find(i):
        while at[i] != i:
            i = at[i]
        return i

    for i, (_, a) in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j][1]).bit_count() <= 2:
                x, y = sorted((find(i), find(j)))
                at[y] = x
    least = {}
    for i, (d, _) in enumerate(prints):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [least.get(find(i)) for i in range(len(prints))]


def test_fingerprints_and_components_of_texts(spark):
    rng = random.Random(5)
    words = ["Ab", "cd", "EF", "gh", "ij", "é", " x"]
    base = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 60))) for _ in range(25)]
    texts = [None, "", " \n", "a", "A", "a b", "x " * 40_000, "y" * 50_000, *base, *base[:5]]
    texts += [b + " " + rng.choice(words) for b in base]
    ids = [None, *range(100, 100 + len(texts) - 1)]
    got = simhash.near_duplicates(frame(spark, texts, ids)).collect()
    prints = [(i, print_by_hand(t)) for i, t in zip(ids, texts)]
    want = Counter((d, f"{f:016x}", c) for (d, f), c in zip(prints, components_by_hand(prints)))
    assert Counter(tuple(r) for r in got) == want
    assert got[0].__fields__ == ["doc_id", "fingerprint", "component_id"]
    assert simhash.near_duplicates(frame(spark, [])).count() == 0


@pytest.mark.parametrize("paired", [1, 4, 64])
def test_links_lose_no_pair_in_small_and_large_buckets(spark, monkeypatch, paired):
    monkeypatch.setattr(simhash, "PAIRED", paired)
    rng = random.Random(6)
    prints = set()
    for _ in range(12):
        x = rng.getrandbits(64)
        for _ in range(25):
            prints.add(x)
            for _ in range(rng.randrange(0, 4)):
                x ^= 1 << rng.randrange(64)
    prints |= {0, 1, (1 << 63), (1 << 63) | 1, (1 << 64) - 1}
    signed = [x - (1 << 64) if x >> 63 else x for x in sorted(prints)]
    links = simhash.links(spark.createDataFrame([(x,) for x in signed], "fingerprint long")).collect()
    mask = (1 << 64) - 1
    assert all(((r.a ^ r.b) & mask).bit_count() <= 2 for r in links)
    parts = {r.node: r.component for r in trie_components(spark, links)}
    by_hand = components_by_hand([(x, x & mask) for x in signed])
    assert [parts.get(x, x) for x in signed] == by_hand


def trie_components(spark, links):
    from tidewake.llm.components import components

    return components(spark.createDataFrame([(r.a, r.b) for r in links], "a long, b long")).collect()


# --- prefix trie


def trie_by_hand(rows):
    conv = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            conv[c].append((turn is not None, turn or 0, role or "", text or ""))
    whole = {}
    for c in conv:
        conv[c].sort()
    for c in conv:
        h = zlib.crc32(str(c).encode()) % 9
        base = conv.get(c - int(math.fmod(c, 5)), [])
        whole[c] = [x[2:] for x in base[:h] + conv[c][h:]]
    members = defaultdict(list)
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = Counter(k[:-1] for k in members if k)
    leaves, saved = Counter(), Counter()
    for k, m in members.items():
        for d in range(len(k) + 1):
            saved[k[:d]] += (len(m) - 1) * len(k[-1][1].encode()) if k else 0
            leaves[k[:d]] += not children[k]
    out = []
    for k, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(whole[c]) == len(k))
        out.append((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), children[k], leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return Counter(out)


def conversations(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "z") for r in rows], "conv_id long, turn long, role string, text string, stratum int, n int, k1 string")


def small_conversations():
    rng = random.Random(8)
    rows = [(c, t, rng.choice("ua"), rng.choice(["x", "y", "é" * 3])) for c in range(40) for t in range(rng.randrange(1, 14))]
    rows += [(None, 1, "u", "x"), (3, None, None, None), (3, None, "u", "q"), (3, 2, "u", "x"), (3, 2, "u", "x")]
    return rows + [(-7, 0, "u", "z"), (-6, 1, None, "x" * 30_000), (10**18, 1, "u", ""), (12, 5, "u", "t"), (12, 5, "a", "t")]


@pytest.mark.parametrize("limit, stratum, long_", [(1 << 16, 1 << 12, 1 << 16), (20, 1 << 12, 1 << 16), (6, 4, 5)])
def test_trie_has_the_nodes_of_brute_force(spark, monkeypatch, limit, stratum, long_):
    for name, value in (("LIMIT", limit), ("STRATUM", stratum), ("LONG", long_)):
        monkeypatch.setattr(trie, name, value)
    rows = small_conversations()
    got = trie.prefix_trie(conversations(spark, rows))
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert Counter(tuple(r) for r in got.collect()) == trie_by_hand(rows)


def test_a_long_prefix_of_many_is_burst_in_few_rounds(spark, monkeypatch):
    monkeypatch.setattr(trie, "LIMIT", 60)
    rng = random.Random(9)
    rows = [(c, t, "u", "same" if t < 25 else f"{c}{t}") for c in range(14) for t in range(rng.choice((20, 27, 30)))]
    assert Counter(tuple(r) for r in trie.prefix_trie(conversations(spark, rows)).collect()) == trie_by_hand(rows)


def test_no_conversations_give_no_nodes(spark):
    assert trie.prefix_trie(conversations(spark, [])).count() == 0
    assert trie.prefix_trie(conversations(spark, [(None, 1, "u", "x")])).count() == 0
