"""Hashed byte n-grams as numpy arrays."""

from __future__ import annotations

import numpy as np


def hashed(text: str, bits: int, orders: tuple[int, ...]) -> np.ndarray:
    """A slot below 2**bits for each n-gram of the UTF-8 bytes, for each order n up to 4."""
    raw = np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8).astype(np.uint32)
    out = []
    for n in orders:
        if len(raw) >= n:
            code = np.full(len(raw) - n + 1, n, dtype=np.uint32)
            for i in range(n):
                code = code * np.uint32(0x01000193) + raw[i : len(raw) - n + 1 + i]
            out.append((code * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits))
    return np.concatenate(out) if out else np.empty(0, dtype=np.uint32)
