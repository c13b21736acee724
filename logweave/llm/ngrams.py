"""Hashed character n-grams of byte strings, vectorised over a batch of texts."""

from __future__ import annotations

import numpy as np

SPACE = 32


def letters_table(keep_digits: bool) -> np.ndarray:
    """Byte map: A-Z to a-z, letters and bytes from 0x80 kept, digits kept on demand, anything else a space."""
    t = np.full(256, SPACE, np.uint8)
    t[0x80:] = np.arange(0x80, 0x100)
    t[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
    t[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
    if keep_digits:
        t[ord("0") : ord("9") + 1] = np.arange(ord("0"), ord("9") + 1)
    return t


def joined(texts: list[bytes], table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One mapped buffer of all texts, each between spaces, with each text's first and end position."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 2
    ends = np.cumsum(sizes)
    buf = np.frombuffer(b" " + b"  ".join(texts) + b" ", np.uint8) if texts else np.zeros(0, np.uint8)
    return table[buf], ends - sizes, ends


def gram_ids(buf: np.ndarray, n: int, bits: int) -> np.ndarray:
    """A bucket for the n-gram that starts at each position; the order n goes into the hash."""
    m = len(buf) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint32)
    h = np.full(m, 0x9E3779B1 * (n + 1) & 0xFFFFFFFF, np.uint32)
    for j in range(n):
        h *= np.uint32(0x01000193)
        h ^= buf[j : j + m]
        h += h << np.uint32(7)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA6B)
    return h >> np.uint32(32 - bits)


def inside_words(buf: np.ndarray, n: int) -> np.ndarray:
    """Whether the n-gram at each position lies in one word with its two boundary spaces, and isn't blank."""
    m = len(buf) - n + 1
    if m <= 0:
        return np.zeros(0, bool)
    blank = np.zeros(len(buf) + 1, np.int32)
    np.cumsum(buf == SPACE, out=blank[1:])
    return blank[n - 1 : n - 1 + m] == blank[1 : 1 + m] if n > 2 else ~((buf[:m] == SPACE) & (buf[n - 1 :] == SPACE))


def span_sums(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Sum of the values at the n-gram starts of each text."""
    total = np.zeros((len(values) + 1,) + values.shape[1:], np.float64)
    np.cumsum(values, axis=0, out=total[1:])
    last = np.clip(ends - n + 1, 0, len(values))
    return total[np.maximum(last, np.minimum(starts, len(values)))] - total[np.minimum(starts, len(values))]
