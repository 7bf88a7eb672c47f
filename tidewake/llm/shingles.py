"""Word shingles of a text as 64-bit hashes, and circulant MinHash signatures over them."""

from __future__ import annotations

import functools

import numpy as np

#: Words of a shingle.
WORDS = 5
#: Size of the permuted universe.
UNIVERSE = 1 << 20
BANDS, ROWS = 32, 6
COORDINATES = BANDS * ROWS
#: Hashed bits of a coordinate in a signature that is compared with others.
BITS = 4
#: A memo of this many word hashes is emptied before it grows further.
MEMO_WORDS = 100_000
_ODD = np.uint64(0x9E3779B97F4A7C15)


class _WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= MEMO_WORDS:
            self.clear()
        self[word] = out = xxhash.xxh3_64_intdigest(word)
        return out


_word_hash = _WordHash().__getitem__


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the runs of `words` words, A-Z lower-cased, split at ASCII white space;
    of the whole sequence if it is shorter; none for a text without words."""
    found = (text or "").encode().lower().split()
    if not found:
        return np.empty(0, dtype=np.uint64)
    w = np.fromiter(map(_word_hash, found), dtype=np.uint64, count=len(found))
    size = min(words, len(w))
    code = np.full(len(w) - size + 1, size, dtype=np.uint64)
    for i in range(size):
        code = code * _ODD + w[i : len(w) - size + 1 + i]
    return np.unique(mixed(code))


def set_key(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits that tell sets apart."""
    a = mixed(shingles ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
    b = mixed(shingles * _ODD + np.uint64(0x14057B7EF767814F)).sum(dtype=np.uint64)
    return int(a.astype(np.int64)), int(b.astype(np.int64))


@functools.cache
def _permutations() -> tuple[np.ndarray, np.ndarray]:
    """The first permutation, and the windows of the second: row p holds its values at p, p+1, ...
    around the circle, which are those that COORDINATES circular shifts put at p."""
    rng = np.random.RandomState(20200917)
    first, second = rng.permutation(UNIVERSE), rng.permutation(UNIVERSE).astype(np.int32)
    return first, np.lib.stride_tricks.sliding_window_view(np.r_[second, second[: COORDINATES - 1]], COORDINATES)


def signature(shingles: np.ndarray) -> np.ndarray:
    """COORDINATES minima, from two permutations, of a set that is not empty."""
    first, windows = _permutations()
    place = first[(shingles >> np.uint64(44)).astype(np.int64)]
    out = windows[place[:1024]].min(0)
    for at in range(1024, len(place), 1024):
        np.minimum(out, windows[place[at : at + 1024]].min(0), out=out)
    return out


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """A 64-bit key of each band (and of its number) for rows of signatures."""
    x = signatures.reshape(len(signatures), BANDS, ROWS).astype(np.uint64)
    code = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), x.shape[:2]).copy()
    for i in range(ROWS):
        code = code * _ODD + x[:, :, i]
    return mixed(code).astype(np.int64)


def signature_bits(signature: np.ndarray) -> bytes:
    """BITS hashed bits of each coordinate."""
    x = mixed(signature.astype(np.uint64) * _ODD + np.arange(len(signature), dtype=np.uint64))
    return np.packbits(np.unpackbits(x.view(np.uint8).reshape(-1, 8)[:, :1], axis=1)[:, :BITS]).tobytes()


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union, for sorted distinct hashes."""
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)
