"""Numpy helpers for texts laid end to end: word bounds and 64-bit word hashes without a loop over words."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: Bytes of text that are worked on at once; a longer text is worked on alone.
BYTES_AT_ONCE = 1_000_000
#: Odd multiplier of the polynomial hash, its inverse mod 2**64, and a seeded random value for each byte.
P = 0x9E3779B97F4A7C15
P_INV = pow(P, -1, 2**64)
BYTE = np.random.default_rng(20240601).integers(1, 2**63, 256, dtype=np.uint64)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mixed(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every bit of a 64-bit value."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def chunks(batch: pa.RecordBatch, text: int = 1, most: int = BYTES_AT_ONCE):
    """(from, to, texts as bytes) runs of a batch's rows of at most ``most`` bytes; only one run's texts are Python objects at a time."""
    col = batch.column(text)
    size = pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1
    start = 0
    while start < len(size):
        stop = max(start + 1, start + int(np.searchsorted(np.cumsum(size[start : start + most]), most, "right")))
        yield start, stop, [x.encode() if x else b"" for x in col.slice(start, stop - start).to_pylist()]
        start = stop


_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> list[np.ndarray]:
    """Powers 0 to n of P and of its inverse, kept for the process and built anew only for longer texts."""
    if len(_powers[0]) <= n:
        for k, base in enumerate((P, P_INV)):
            up = np.full(max(n, BYTES_AT_ONCE) + 2, base, np.uint64)
            up[0] = 1
            _powers[k] = np.multiply.accumulate(up, out=up)
    return _powers


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes with one newline after each, and each text's start; one more start at the end."""
    buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    return buf, np.concatenate([[0], np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))])


def lowered(buf: np.ndarray) -> np.ndarray:
    """Lower case for A-Z and the two-byte Latin-1 capitals; lengths do not change."""
    low = LOWER[buf]
    if len(low) > 1:
        cap = np.flatnonzero((low[:-1] == 0xC3) & (low[1:] >= 0x80) & (low[1:] <= 0x9E) & (low[1:] != 0x97)) + 1
        low[cap] += 32
    return low


def bounds(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True. The last byte is never inside."""
    step = np.diff(np.concatenate([[False], inside]).astype(np.int8))
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each (start, end)."""
    n = len(buf)
    up, down = powers(n)
    total = np.zeros(n + 1, np.uint64)
    np.multiply(BYTE[buf], up[:n], out=total[1:])
    np.cumsum(total[1:], out=total[1:])
    out = total[ends] - total[starts]
    out *= down[starts]
    return mixed(out)


def grams(words: np.ndarray, doc: np.ndarray, n: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every ``n`` consecutive words of one text, and the index of each one's first word."""
    if len(words) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    m = len(words) - n + 1
    h = np.full(m, U(seed + 1), np.uint64)
    for k in range(n):
        h = (h ^ words[k : k + m]) * U(P) + U(k + 1)
    first = np.flatnonzero(doc[:m] == doc[n - 1 : n - 1 + m])
    return mixed(h[first]), first
