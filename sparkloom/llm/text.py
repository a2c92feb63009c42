"""Vectorised work on Arrow text columns: words, hashes, windows.

A word is a run of bytes other than 0x20 and 0x09-0x0D, which for UTF-8 is the
same as ``[^\\x20\\x09-\\x0D]+`` over characters. All arithmetic is modulo 2**64.

Words are hashed by chained mixing of their 8-byte blocks and sequences of words by
sums of values mixed with their places; neither is a polynomial modulo 2**64, which
would give long patterns of two letters or words (Thue-Morse) equal hashes. Only runs
of a few dozen mixed word hashes (``rolling``) are polynomials. Hashes of different
``seed`` are independent of each other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)

U = np.uint64
SEP = np.zeros(256, dtype=bool)
SEP[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse
GOLDEN = U(0x9E3779B97F4A7C15)
LONG = 4096  # bytes of a word that is hashed apart
_LOW = np.array([(1 << 8 * i) - 1 for i in range(8)] + [2**64 - 1], dtype=np.uint64)  # keeps the first i bytes of a block
_POW: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: spreads every input bit over the result."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(n: int, base: int = BASE) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i for i in 0..n, cached."""
    have = _POW.get(base)
    if have is None or len(have[0]) <= n:
        size = max(1 << 16, 1 << int(n).bit_length())
        p = np.full(size + 1, base, dtype=np.uint64)
        q = np.full(size + 1, pow(base, -1, 1 << 64), dtype=np.uint64)
        p[0] = q[0] = 1
        _POW[base] = have = (np.multiply.accumulate(p), np.multiply.accumulate(q))
    return have


def rolling(values: np.ndarray, width: int, base: int = BASE) -> np.ndarray:
    """Hash of each run of ``width`` values; empty if there are fewer."""
    n = len(values) - width + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    p, q = powers(len(values), base)
    pre = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * p[: len(values)], out=pre[1:])
    return mix((pre[width:] - pre[:-width]) * q[:n])


def word_hash(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """Hash of the bytes buf[s:e] for each pair, block by block of 8 bytes; very long ones by BLAKE2b."""
    size = ends - starts
    out = mix(size.astype(np.uint64) * GOLDEN + U(seed * 2 + 1))
    if not len(buf):
        return out
    padded = np.zeros(len(buf) + 8, dtype=np.uint8)
    padded[: len(buf)] = buf
    block = np.ndarray(len(buf) + 1, dtype="<u8", buffer=padded, strides=(1,))
    large = np.flatnonzero(size > LONG)
    for i in large.tolist():
        digest = hashlib.blake2b(buf[starts[i] : ends[i]].tobytes(), digest_size=8, key=seed.to_bytes(8, "little")).digest()
        out[i] = int.from_bytes(digest, "little")
    left = np.flatnonzero((size > 0) & (size <= LONG))
    at = 0
    while len(left):
        rest = size[left] - at
        out[left] = mix(out[left] * GOLDEN ^ (block[starts[left] + at] & _LOW[np.minimum(rest, 8)]))
        at += 8
        left = left[rest > 8]
    return out


def sequence_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of the values[s:e] of each pair; the pairs are in order and do not overlap."""
    size = ends - starts
    first = np.cumsum(size) - size
    place = np.arange(int(size.sum())) - np.repeat(first, size)
    own = mix(values[place + np.repeat(starts, size)] + mix(place.astype(np.uint64) * GOLDEN + U(1)))
    total = np.zeros(len(own) + 1, dtype=np.uint64)
    np.cumsum(own, out=total[1:])
    return mix(total[first + size] - total[first] + size.astype(np.uint64) * U(0xD6E8FEB86659FD93))


def slide(values: np.ndarray, width: int, op) -> np.ndarray:
    """op (np.minimum or np.maximum) over each run of ``width`` values, by doubling."""
    out, have = values, 1
    while have * 2 <= width:
        out = op(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return op(out[: len(out) - rest], out[rest:]) if rest else out


class Texts:
    """The texts of one Arrow column as bytes; null counts as empty."""

    def __init__(self, col: pa.Array):
        col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
        col = col.cast(pa.large_binary()).fill_null(b"")
        offs = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset : col.offset + len(col) + 1]
        data = col.buffers()[2]
        whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, dtype=np.uint8)
        lo = int(offs[0]) if len(offs) else 0
        self.buf = whole[lo : int(offs[-1])] if len(col) else whole[:0]
        self.offs = offs - lo if len(col) else np.zeros(1, dtype=np.int64)
        self.n = len(col)

    def raw(self, i: int) -> bytes:
        return self.buf[self.offs[i] : self.offs[i + 1]].tobytes()


class Words:
    """Word bounds and hashes of texts; ``first[i]:first[i + 1]`` are the words of text i. ``sep``: the bytes between words."""

    def __init__(self, texts: Texts, lower: bool = False, sep: np.ndarray = SEP):
        self.buf = buf = LOWER[texts.buf] if lower else texts.buf
        word = ~sep[buf]
        n = len(buf)
        head = np.zeros(n + 1, dtype=bool)
        head[texts.offs] = True  # a text's first byte starts anew
        before = np.empty(n, dtype=bool)
        if n:
            before[0] = False
            before[1:] = word[:-1]
        self.starts = np.flatnonzero(word & (~before | head[:-1]))
        after = np.empty(n, dtype=bool)
        if n:
            after[-1] = False
            after[:-1] = word[1:]
        self.ends = np.flatnonzero(word & (~after | head[1:])) + 1
        self.first = np.searchsorted(self.starts, texts.offs)
        self.count = np.diff(self.first)
        self.hash = word_hash(buf, self.starts, self.ends)
        self.doc = np.repeat(np.arange(texts.n), self.count)

    def rehashed(self, seed: int) -> np.ndarray:
        """The words' hashes by another, independent function."""
        return word_hash(self.buf, self.starts, self.ends, seed)


def pieces(batch: pa.RecordBatch, column: str, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``limit`` bytes of text each; a longer text is one slice."""
    size = np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0), dtype=np.int64)
    start, total = 0, 0
    for i, s in enumerate(size):
        if i > start and total + s > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += int(s)
    if start < batch.num_rows:
        yield batch.slice(start)


def signed(x: np.ndarray) -> pa.Array:
    """64-bit hashes as Spark longs."""
    return pa.array(x.view(np.int64))


def lists(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """A list column: ``counts[i]`` consecutive values each."""
    offs = np.zeros(len(counts) + 1, dtype=np.int32)
    np.cumsum(counts, out=offs[1:])
    vals = values.view(np.int64) if values.dtype == np.uint64 else values
    return pa.ListArray.from_arrays(pa.array(offs), pa.array(vals))


def distinct_in_doc(doc: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (doc, value) pairs, by doc and then value."""
    order = np.lexsort((value, doc))
    d, v = doc[order], value[order]
    if len(d):
        keep = np.concatenate([[True], (d[1:] != d[:-1]) | (v[1:] != v[:-1])])
        d, v = d[keep], v[keep]
    return d, v
