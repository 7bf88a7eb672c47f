"""Byte-level BPE: vocabulary, pre-tokens, exact merging, and the speculate-and-verify encoder.

Plain helpers that run inside Spark tasks; they hold no state that depends on the data except
memo tables, which are emptied at a fixed size.
"""

from __future__ import annotations

import functools
import heapq
import json
import re
from itertools import chain

import numpy as np

#: Words longer than this many characters are not memoised.
MEMO_CHARS = 64
#: Rank of a pair that does not merge.
NEVER = np.iinfo(np.int64).max
#: Up to this many bytes a word is merged over plain lists, or side by side with others, which beats a heap there.
SHORT_BYTES = 48
#: A memo of this many words is emptied before it grows further.
MEMO_WORDS = 100_000

# The pre-token pattern of the vocabulary, with its three character classes spelt out
# for ASCII, for code points below U+0250, and by Unicode property for any other text.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?[{L}]+| ?[{N}]+| ?[^{S}{L}{N}]+|[{S}]+(?![^{S}])|[{S}]+"
_ASCII = {"L": "A-Za-z", "N": "0-9", "S": r"\t-\r "}
_LATIN = {"L": "A-Za-zªµºÀ-ÖØ-öø-ɏ", "N": "0-9²³¹¼-¾", "S": "\\t-\\r \u0085 "}
_ANY = {"L": r"\p{L}", "N": r"\p{N}", "S": "\\t-\\r \u0085   -     　"}


def _compiled(classes: dict[str, str], compile_):
    pattern = _PATTERN
    for name, chars in classes.items():
        pattern = pattern.replace("{" + name + "}", chars)
    return compile_(pattern)


_ascii_words = _compiled(_ASCII, re.compile).findall
_latin_words = _compiled(_LATIN, re.compile).findall
_beyond_latin = re.compile("[^\x00-ɏ]").search


@functools.cache
def _any_words():
    import regex

    return _compiled(_ANY, regex.compile).findall


def pre_tokens(text: str) -> list[str]:
    """The pieces of a text that are merged each on their own; joined they give the text."""
    if text.isascii():
        return _ascii_words(text)
    if _beyond_latin(text) is None:
        return _latin_words(text)
    return _any_words()(text)


def _byte_of_char() -> dict[str, int]:
    """Printable bytes stand for themselves, the others for the code points from U+0100 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Vocabulary:
    """A tokenizer file: tokens as bytes, merges by rank, special strings."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        model, byte_of = data["model"], _byte_of_char()
        self.specials = {t["content"]: t["id"] for t in data["added_tokens"]}
        size = 1 + max([*model["vocab"].values(), *self.specials.values()])
        self.bytes_of: list[bytes] = [b""] * size
        for token, i in model["vocab"].items():
            self.bytes_of[i] = bytes(byte_of[c] for c in token)
        for token, i in self.specials.items():
            self.bytes_of[i] = token.encode()
        self.id_of_byte = [0] * 256
        for token, i in model["vocab"].items():
            if len(token) == 1:
                self.id_of_byte[byte_of[token]] = i
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            new = model["vocab"][left + right]
            self.merges[model["vocab"][left], model["vocab"][right]] = (rank, new)
        self._no_merge = (len(self.merges), -1)
        self._special_split = re.compile("|".join(map(re.escape, sorted(self.specials, key=len, reverse=True)))) if self.specials else None

    def pieces(self, text: str):
        """Stretches of ordinary text and the special strings between them, in order."""
        if self._special_split is None or not any(s in text for s in self.specials):
            yield text, None
            return
        at = 0
        for m in self._special_split.finditer(text):
            yield text[at : m.start()], self.specials[m[0]]
            at = m.end()
        yield text[at:], None

    def merge(self, word: bytes) -> list[int]:
        """Exact merging: the lowest rank first, the leftmost of equals; n log n for long words."""
        ids = [self.id_of_byte[b] for b in word]
        n, merges = len(ids), self.merges
        if n < 2:
            return ids
        if n <= SHORT_BYTES:
            return self._merge_short(ids)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(*m, i) for i in range(n - 1) if (m := merges.get((ids[i], ids[i + 1])))]
        heap = [(rank, i, new) for rank, new, i in heap]
        heapq.heapify(heap)
        while heap:
            rank, i, new = heapq.heappop(heap)
            j = after[i] if alive[i] else n
            if j >= n or merges.get((ids[i], ids[j])) != (rank, new):
                continue
            ids[i], alive[j], after[i] = new, False, after[j]
            if after[j] < n:
                before[after[j]] = i
                if m := merges.get((new, ids[after[j]])):
                    heapq.heappush(heap, (m[0], i, m[1]))
            if (h := before[i]) >= 0 and (m := merges.get((ids[h], new))):
                heapq.heappush(heap, (m[0], h, m[1]))
        return [t for t, a in zip(ids, alive) if a]

    def _merge_short(self, ids: list[int]) -> list[int]:
        get, none = self.merges.get, self._no_merge
        best = [get(p, none) for p in zip(ids, ids[1:])]
        while best:
            low = min(best)
            if low is none:
                break
            i = best.index(low)
            ids[i : i + 2] = [low[1]]
            del best[i]
            if i < len(best):
                best[i] = get((ids[i], ids[i + 1]), none)
            if i:
                best[i - 1] = get((ids[i - 1], ids[i]), none)
        return ids

    def alone(self) -> dict[bytes, int]:
        """The vocabulary strings proved, by exact merging, to encode alone as their one token."""
        special = set(self.specials.values())
        return {b: i for i, b in enumerate(self.bytes_of) if b and i not in special and self.merge(b) == [i]}


@functools.cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class PairTable:
    """The merges as an open hash table over numpy arrays: pair code to rank and new id."""

    def __init__(self, merges: dict[tuple[int, int], tuple[int, int]]):
        self._mask = (1 << max(4, (8 * len(merges)).bit_length())) - 1
        self._code = np.full(self._mask + 1, -1, dtype=np.int64)
        self._rank = np.full(self._mask + 1, NEVER, dtype=np.int64)
        self._new = np.full(self._mask + 1, -1, dtype=np.int64)
        for (a, b), (rank, new) in merges.items():
            code = (a << 32) | b
            at = int(self._slot(np.array([code], dtype=np.int64))[0])
            while self._code[at] >= 0:
                at = (at + 1) & self._mask
            self._code[at], self._rank[at], self._new[at] = code, rank, new

    def _slot(self, code: np.ndarray) -> np.ndarray:
        mixed = code.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(40)).astype(np.int64) & self._mask

    def find(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (NEVER if the pair does not merge) and new id of each pair."""
        code = (a << 32) | b
        at = self._slot(code)
        open_ = np.flatnonzero((self._code[at] != code) & (self._code[at] >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & self._mask
            seen = self._code[at[open_]]
            open_ = open_[(seen != code[open_]) & (seen >= 0)]
        found = self._code[at] == code
        return np.where(found, self._rank[at], NEVER), self._new[at]


def merge_many(vocab: Vocabulary, pairs: PairTable, words: list[bytes]) -> list[list[int]]:
    """Exact merging of many words side by side: each round merges in every word its lowest, leftmost pair."""
    out: list[list[int]] = [[] for _ in words]
    short = [i for i, w in enumerate(words) if len(w) <= SHORT_BYTES]
    for i, w in enumerate(words):
        if len(w) > SHORT_BYTES:
            out[i] = vocab.merge(w)
    ids = np.array(vocab.id_of_byte, dtype=np.int64)[np.frombuffer(b"".join(words[i] for i in short), dtype=np.uint8)]
    word = np.repeat(np.array(short, dtype=np.int64), [len(words[i]) for i in short])
    while len(ids):
        rank = np.full(len(ids), NEVER)
        new = np.empty(len(ids), dtype=np.int64)
        inner = np.flatnonzero(word[1:] == word[:-1])
        rank[inner], new[inner] = pairs.find(ids[inner], ids[inner + 1])
        starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        sizes = np.diff(np.r_[starts, len(ids)])
        low = np.minimum.reduceat(rank, starts)
        done = low == NEVER
        if done.any():
            rest = np.repeat(done, sizes)
            flat, at = ids[rest].tolist(), 0
            for i, n in zip(word[starts[done]].tolist(), sizes[done].tolist()):
                out[i] = flat[at : at + n]
                at += n
            ids, word, rank, new, low, sizes = ids[~rest], word[~rest], rank[~rest], new[~rest], low[~done], sizes[~done]
        hits = np.flatnonzero((rank == np.repeat(low, sizes)) & (rank != NEVER))
        first = hits[np.r_[True, word[hits[1:]] != word[hits[:-1]]]] if len(hits) else hits
        ids[first] = new[first]
        keep = np.ones(len(ids), dtype=bool)
        keep[first + 1] = False
        ids, word = ids[keep], word[keep]
    return out


class TokenCounts(dict):
    """Tokens by pre-token: 1 for the proved whole tokens, merged and memoised for the rest."""

    def __init__(self, path: str):
        self.vocab = vocabulary(path)
        self.pairs = PairTable(self.vocab.merges)
        for b in self.vocab.alone():
            try:
                self[b.decode()] = 1
            except UnicodeDecodeError:
                pass  # part of a character: never a whole pre-token
        self.proved = len(self)

    def of(self, texts: list[str]) -> list[int]:
        if len(self) >= self.proved + MEMO_WORDS:
            for word in list(self)[self.proved :]:
                del self[word]
        split = [[(pre_tokens(piece), special is not None) for piece, special in self.vocab.pieces(t)] for t in texts]
        missing = list(set().union(*(words for parts in split for words, _ in parts)) - self.keys())
        merged = merge_many(self.vocab, self.pairs, [w.encode() for w in missing])
        self.update(zip(missing, map(len, merged)))
        count = self.__getitem__
        out = [sum(sum(map(count, words)) + special for words, special in parts) for parts in split]
        for w in missing:
            if len(w) > MEMO_CHARS:
                del self[w]
        return out


@functools.cache
def token_counts(path: str) -> TokenCounts:
    return TokenCounts(path)


class Codec:
    """Speculate and verify: propose by greedy longest match, test all adjacent pairs, merge the rest."""

    def __init__(self, path: str):
        self.vocab = v = vocabulary(path)
        self.alone = v.alone()
        #: The longest token that starts with these three bytes.
        self.reach: dict[bytes, int] = {}
        for token in self.alone:
            self.reach[token[:3]] = max(len(token), self.reach.get(token[:3], 2))
        self.decimal = list(map(str, range(len(v.bytes_of))))
        self.memo: dict[str, list[int]] = {}
        size = len(v.bytes_of)
        left, right, rank = np.arange(size), np.arange(size), np.full(size, -1)
        for (a, b), (r, new) in v.merges.items():
            left[new], right[new], rank[new] = a, b, r
        self._left, self._left_until = self._spine(left, rank)
        self._right, self._right_until = self._spine(right, rank)
        self.pairs = PairTable(v.merges)

    @staticmethod
    def _spine(child: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each token the pieces that stand at its edge while it is built, the token itself first,
        and the rank of the merge that ends each piece (none for the token itself); -1 pads."""
        pieces, until = [np.arange(len(child))], [np.full(len(child), NEVER - 1)]
        while True:
            last = pieces[-1]
            deeper = (last >= 0) & (rank[last] >= 0)
            if not deeper.any():
                return np.stack(pieces, 1), np.stack(until, 1)
            pieces.append(np.where(deeper, child[last], -1))
            until.append(np.where(deeper, rank[last], -1))

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether token a followed by token b stays as it is: no merge across the seam comes before
        the merges that use up the two pieces beside it (of equal ranks the left one comes first)."""
        bad = np.zeros(len(a), dtype=bool)
        for k in range(self._right.shape[1]):
            rows = np.flatnonzero(~bad & (self._right[a, k] >= 0))
            if not len(rows):
                break
            for m in range(self._left.shape[1]):
                rows = rows[self._left[b[rows], m] >= 0]
                if not len(rows):
                    break
                r, _ = self.pairs.find(self._right[a[rows], k], self._left[b[rows], m])
                bad[rows] |= (r < self._right_until[a[rows], k]) & (r <= self._left_until[b[rows], m])
        return ~bad

    def propose(self, word: bytes) -> list[int]:
        out, at, n, alone, reach = [], 0, len(word), self.alone, self.reach
        while at < n:
            for end in range(min(n, at + reach.get(word[at : at + 3], 2)), at, -1):
                if (t := alone.get(word[at:end])) is not None:
                    out.append(t)
                    at = end
                    break
        return out

    def encode_words(self, words: list[str]) -> tuple[list[list[int]], int]:
        """Token ids of each word, and how many words needed exact merging."""
        raw = [w.encode() for w in words]
        tokens = [self.propose(b) for b in raw]
        lengths = np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens))
        flat = np.fromiter((t for ts in tokens for t in ts), dtype=np.int64, count=int(lengths.sum()))
        word = np.repeat(np.arange(len(words)), lengths)
        seams = np.flatnonzero(word[1:] == word[:-1])
        pairs, back = np.unique((flat[seams] << 32) | flat[seams + 1], return_inverse=True)
        fails = ~self.compatible(pairs >> 32, pairs & 0xFFFFFFFF)[back]
        failed = np.unique(word[seams[fails]])
        for i, ids in zip(failed.tolist(), merge_many(self.vocab, self.pairs, [raw[i] for i in failed.tolist()])):
            tokens[i] = ids
        return tokens, len(failed)

    def encode(self, texts: list[str]) -> list[list[int]]:
        split = [[(pre_tokens(piece), special) for piece, special in self.vocab.pieces(t)] for t in texts]
        if len(self.memo) >= MEMO_WORDS:
            self.memo.clear()
        memo = self.memo
        missing = list(set().union(*(words for parts in split for words, _ in parts)) - memo.keys())
        if missing:
            memo.update(zip(missing, self.encode_words(missing)[0]))
        out = []
        for parts in split:
            ids: list[int] = []
            for words, special in parts:
                ids.extend(chain.from_iterable(map(memo.__getitem__, words)))
                if special is not None:
                    ids.append(special)
            out.append(ids)
        for w in missing:
            if len(w) > MEMO_CHARS:
                del memo[w]
        return out

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.vocab.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


@functools.cache
def codec(path: str) -> Codec:
    return Codec(path)
