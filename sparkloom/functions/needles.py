"""Which of many strings occur in which of many texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

LONGEST = 16  # characters of a needle that are looked up before it is compared
CHARS = 1 << 20  # of texts at a time
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)


def _hashes(codes: np.ndarray, sizes: set[int]) -> Iterator[tuple[int, np.ndarray]]:
    """(n, hash of each run of n codes) for the powers of two in ``sizes``: each from two of the half size."""
    h, n = (codes + np.uint64(1)) * _A, 1
    h ^= h >> np.uint64(29)
    while n <= max(sizes, default=0):
        if n in sizes:
            yield n, h
        if len(h) <= n:
            return
        h = h[:-n] * _B + h[n:] * _A
        h ^= h >> np.uint64(31)
        n *= 2


class Needles:
    """(key, needle) pairs, needles not empty; one pass over a text whatever their number.

    A needle is looked up by a hash of its first characters, as many as the largest power of two that it
    has (``LONGEST`` at most), at every place of the text; what has an equal hash is compared.
    """

    def __init__(self, rows: list[tuple]):
        by: dict[str, list] = {}
        for key, needle in rows:
            by.setdefault(needle, []).append(key)
        heads: dict[int, dict[int, list[str]]] = {}
        for needle in by:
            n = 1
            while n * 2 <= min(len(needle), LONGEST):
                n *= 2
            for size, h in _hashes(_codes(needle[:n]), {n}):
                heads.setdefault(size, {}).setdefault(int(h[0]), []).append(needle)
        self.keys, self.heads = by, heads
        self.sorted = {n: np.array(sorted(of), dtype=np.uint64) for n, of in heads.items()}

    def find(self, texts: list[str | None]) -> list[tuple[int, object]]:
        """(number of the text, key) of each needle in each text, once, by number and then key."""
        out, start = [], 0
        while start < len(texts):
            stop, size = start, 0
            while stop < len(texts) and (stop == start or size + len(texts[stop] or "") <= CHARS):
                size += len(texts[stop] or "")
                stop += 1
            out += self._slice(texts[start:stop], start)
            start = stop
        return out

    def _slice(self, texts: list[str | None], base: int) -> list[tuple[int, object]]:
        texts = [t or "" for t in texts]
        whole = "".join(texts)
        ends = np.cumsum([len(t) for t in texts])
        hits: set[tuple[int, str]] = set()
        for n, h in _hashes(_codes(whole), set(self.heads)):
            known = self.sorted[n]
            at = np.flatnonzero(known[np.searchsorted(known, h).clip(max=len(known) - 1)] == h)
            of = np.searchsorted(ends, at, side="right")
            for p, i, value in zip(at.tolist(), of.tolist(), h[at].tolist(), strict=True):
                for needle in self.heads[n][value]:
                    if p + len(needle) <= ends[i] and (i, needle) not in hits and whole.startswith(needle, p):
                        hits.add((i, needle))
        return sorted((base + i, key) for i, needle in hits for key in self.keys[needle])
