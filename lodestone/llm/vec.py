"""Whole-batch text scans in numpy: words, hashes and n-grams of an Arrow string column, without a loop over words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_BASE = U(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
_INV = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]

#: Bytes of words: letters, digits, underscore and all of UTF-8's multi-byte sequences.
ALNUM = np.zeros(256, bool)
ALNUM[list(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_")] = True
ALNUM[128:] = True
#: Bytes that aren't white space.
DARK = np.ones(256, bool)
DARK[list(b" \t\n\r\v\f")] = False


def power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        n = max(n, 1 << 20)
        with np.errstate(over="ignore"):
            for k, b in ((0, _BASE), (1, _INV)):
                x = np.full(n, b, U)
                x[0] = 1
                _powers[k] = np.multiply.accumulate(x)
    return _powers[0][:n], _powers[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser over uint64, so that all bits of the result depend on all bits of ``h``."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> U(33))) * U(0xFF51AFD7ED558CCD)
        h = (h ^ (h >> U(33))) * U(0xC4CEB9FE1A85EC53)
        return h ^ (h >> U(33))


class Chunk:
    """Some neighbouring documents of a batch. ``buf``: their UTF-8 bytes; ``off``: where each begins, and the end."""

    def __init__(self, lo: int, buf: np.ndarray, off: np.ndarray):
        self.lo, self.buf, self.off, self.n = lo, buf, off, len(off) - 1

    def words(self, inside: np.ndarray = ALNUM) -> None:
        """Sets ws, we (bytes), wdoc (document), woff (each document's first word) for maximal runs of ``inside``."""
        ok = np.concatenate(([False], inside[self.buf], [False]))
        cut = np.zeros(len(ok), bool)
        cut[self.off[:-1] + 1] = True  # a word never spans two documents
        cut = cut[: len(ok)]
        starts = ok[1:-1] & (~ok[:-2] | cut[1:-1])
        ends = ok[1:-1] & (~ok[2:] | cut[2:])
        self.ws = np.flatnonzero(starts)
        self.we = np.flatnonzero(ends) + 1
        self.wdoc = np.searchsorted(self.off, self.ws, "right") - 1
        self.woff = np.searchsorted(self.ws, self.off)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of every word."""
        p, q = power(len(self.buf) + 1)
        with np.errstate(over="ignore"):
            s = np.zeros(len(self.buf) + 1, U)
            np.cumsum((self.buf.astype(U) + U(1)) * p[: len(self.buf)], out=s[1:])
            return mix((s[self.we] - s[self.ws]) * q[self.ws])


def strings(col: pa.Array) -> pa.Array:
    """One array of strings without nulls; a null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return pc.fill_null(col.cast(pa.large_string()), "")


def chunks(col: pa.Array, lower: bool = True, size: int = 1 << 20, rows: int = 1 << 16) -> Iterator[Chunk]:
    """The documents of a string column in runs of about ``size`` bytes, ``rows`` at most; a longer document is a run of its own."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    n, lo = len(col), 0
    ends = np.cumsum(pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    while lo < n:  # only a run at a time is copied, not the batch
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + size, "right")))
        hi = min(hi, n, lo + rows)
        part = strings(col.slice(lo, hi - lo))
        part = pc.utf8_lower(part) if lower else part
        _, o, d = part.buffers()
        off = np.frombuffer(o, np.int64)[part.offset : part.offset + hi - lo + 1]
        data = np.frombuffer(d, np.uint8) if d is not None else np.zeros(0, np.uint8)
        yield Chunk(lo, data[off[0] : off[-1]], off - off[0])
        lo = hi
    pa.default_memory_pool().release_unused()


def segment_sum(x: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sums of ``x`` between neighbouring offsets; zero where a segment is empty."""
    out = np.zeros((len(off) - 1, *x.shape[1:]), x.dtype)
    full = np.flatnonzero(off[1:] > off[:-1])
    if len(full):
        out[full] = np.add.reduceat(x, off[full], axis=0)
    return out


def char_grams(buf: np.ndarray, bits: int, off: np.ndarray | None = None) -> np.ndarray:
    """For each byte, a hash in [0, 2**bits) of the three bytes that begin there; zero bytes stand beyond a document's end."""
    b = np.concatenate((buf, np.zeros(2, np.uint8))).astype(np.uint32)
    y, z = b[1:-1], b[2:]
    if off is not None:
        full = off[1:] > off[:-1]
        y, z = y.copy(), z.copy()
        y[off[1:][full] - 1] = 0
        z[off[1:][full] - 1] = 0
        z[np.maximum(off[1:][full] - 2, 0)] = 0
    with np.errstate(over="ignore"):
        h = (b[:-2] | (y << np.uint32(8)) | (z << np.uint32(16))) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x85EBCA77)
    return (h >> np.uint32(32 - bits)).astype(np.int32)


def dense(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """``x @ w``, summed column by column: a row's result doesn't depend on its neighbours, as that of BLAS does."""
    w = w.astype(x.dtype)
    out = x[:, :1] * w[0] if w.ndim > 1 else x[:, 0] * w[0]
    for j in range(1, len(w)):
        out += x[:, j : j + 1] * w[j] if w.ndim > 1 else x[:, j] * w[j]
    return out
