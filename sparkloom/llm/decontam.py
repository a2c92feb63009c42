"""Benchmark decontamination by the q-gram lemma.

Text and items are folded to lower case (Unicode case folding) with runs of white
space, punctuation and ASCII symbols as one space. An item of n bytes may be matched with up to
k = floor(EDITS * n) edits; by the q-gram lemma such a match shares at least
n - q + 1 - k * q of the item's q-grams, all within 2k + 1 diagonals (position in
the text minus position in the item). Hits are counted in bands of 3k + 3
diagonals that overlap by two thirds, so every match lies whole in one; bands
that meet the bound are verified by banded alignment (edit distance of the whole
item against any part of the region, over the diagonals a match in it can lie on; items
over ``LONG`` bytes with bands as wide as the edits allowed, few at first). Items under ``SMALL`` bytes take shorter
q-grams, so that the bound never vanishes; items too short for those are found
where they stand exactly, between spaces.

Grams that very many items share (a common prompt, say) are not looked up item by
item. The lemma holds for every subset of an item's grams: of r others, r - k * q
must be hit, which is what most items are filtered by. For items that are made of
shared grams for the most part, the text is cut into overlapping stretches; in
those with enough hits of such items' grams at all, the distinct pieces of ``PIECE``
bytes that stretch and item share are counted for all items at once, and an item
that lacks more than k edits can destroy is out. Either way no match is lost; what
is left is aligned in batches, from the item's less common end, and given up at
the first row over the budget.

The items are broadcast in blocks of at most ``BLOCK_BYTES`` of text; a larger
benchmark takes further passes over the texts, never a larger broadcast.

Edge cases: null texts and items, and items without a letter or digit, match nothing;
repeated items and repeated documents each give their rows; whole texts are
searched, a very long one as a batch of its own; ties between alignments go to the
earliest end; positions are byte offsets in the UTF-8 of the original text, never
inside a character that folding changed. Edits are counted in bytes of the folded
text, so an accented letter against a plain one costs up to two. An empty benchmark
or table gives no matches; columns other than those named pass through or are not
read, whatever their names.
"""

from __future__ import annotations

import unicodedata
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .text import Texts, mix, pieces
from .work import through

Q, SMALL_Q, SMALL = 10, 5, 30
EDITS = 0.07
BLOCK_BYTES = 4 << 20
MANY = 32  # items that may share a gram before it is counted apart
PIECE = 4
CELLS = 1 << 22  # of all alignments that run at once
LONG = 2_000  # bytes of an item that is aligned by itself, with few edits first
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[[c for c in range(128) if not chr(c).isalnum()]] = 32


def _changes() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per code point from 0x80 the number of its replacement (0: none), and the replacements' bytes and lengths."""
    of, found = np.zeros(0x20000, dtype=np.int32), [b""]
    for c in (*range(0x80, 0xD800), *range(0xE000, 0x20000)):  # no case or punctuation beyond
        x = chr(c)
        y = " " if x.isspace() or unicodedata.category(x)[0] in "PZ" else x.casefold()
        if y != x:
            of[c] = len(found)
            found.append(y.encode("utf-8"))
    size = np.array([len(y) for y in found])
    return of, np.array([list(y.ljust(size.max(), b"\0")) for y in found], dtype=np.uint8), size


_CHANGE, _NEW, _SIZE = _changes()


def folded(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Folded bytes, and the start and end in the original of what each stands for."""
    f, at = _FOLD[buf], np.arange(len(buf))
    to = at + 1
    lead = np.flatnonzero(buf >= 0xC2)
    spots, widths, kinds = [], [], []
    for width, low, high in ((2, 0xC2, 0xE0), (3, 0xE0, 0xF0), (4, 0xF0, 0xF5)):
        p = lead[(buf[lead] >= low) & (buf[lead] < high) & (lead + width <= len(buf))]
        code, whole = buf[p].astype(np.int64) & (0xFF >> (width + 1)), np.ones(len(p), dtype=bool)
        for j in range(1, width):
            code, whole = code << 6 | (buf[p + j] & 0x3F), whole & (buf[p + j] & 0xC0 == 0x80)
        kind = np.where(whole & (code < len(_CHANGE)), _CHANGE[np.minimum(code, len(_CHANGE) - 1)], 0)
        spots.append(p[kind > 0])
        kinds.append(kind[kind > 0])
        widths.append(np.full(len(spots[-1]), width))
    p, width, kind = (np.concatenate(x) for x in (spots, widths, kinds))
    if len(p):
        times = np.ones(len(buf), dtype=np.int64)
        for j in range(1, 4):
            times[p[width > j] + j] = 0
        times[p] = _SIZE[kind]
        put = np.cumsum(times)[p] - times[p]
        to[p] = p + width
        f, at, to = np.repeat(f, times), np.repeat(at, times), np.repeat(to, times)
        for j in range(_NEW.shape[1]):
            more = _SIZE[kind] > j
            f[put[more] + j] = _NEW[kind[more], j]
    keep = np.ones(len(f), dtype=bool)
    blank = f == 32
    keep[1:] = ~(blank[1:] & blank[:-1])
    return f[keep], at[keep], to[keep]


def grams(f: np.ndarray, q: int = Q) -> np.ndarray:
    """A 64-bit code of each run of ``q`` bytes (10, or 8 at most)."""
    n = len(f) - q + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    padded = np.zeros(len(f) + 8, dtype=np.uint8)
    padded[: len(f)] = f
    head = np.ndarray(n, dtype="<u8", buffer=padded, strides=(1,))
    if q <= 8:
        return mix(head & np.uint64((1 << 8 * q) - 1))
    tail = np.ndarray(n, dtype="<u2", buffer=padded, offset=8, strides=(1,))
    return mix(head * np.uint64(0x9E3779B97F4A7C15) + tail.astype(np.uint64))


def _flat(parts: list[np.ndarray], kind) -> tuple[np.ndarray, np.ndarray]:
    """The parts one after the other, and where each begins."""
    return (np.concatenate(parts) if parts else np.empty(0, dtype=kind)), np.cumsum([0, *map(len, parts)])


def _pieces(f: np.ndarray) -> np.ndarray:
    """Distinct runs of PIECE bytes, as 16-bit codes."""
    return np.unique((grams(f, PIECE) >> np.uint64(48)).astype(np.int64))


class Index:
    """An index of q-grams over folded items, each longer than q."""

    def __init__(self, texts: list[bytes], edits: float, q: int):
        self.text, self.q = texts, q
        arrays = [np.frombuffer(t, dtype=np.uint8) for t in texts]
        self.lengths = np.array([len(t) for t in texts], dtype=np.int64)
        self.budgets = (self.lengths * edits + 1e-9).astype(np.int64)
        codes, first = _flat([grams(a, q) for a in arrays], np.uint64)
        size = np.diff(first)
        item = np.repeat(np.arange(len(texts)), size)
        pos = np.arange(len(codes)) - np.repeat(first[:-1], size)
        order = np.argsort(codes, kind="stable")
        self.code, at = np.unique(codes[order], return_index=True)
        times = np.diff(np.append(at, len(codes)))
        common = np.repeat(times > MANY, times)  # per posting in order
        rare = np.bincount(item[order][~common], minlength=len(texts))
        left = rare - self.budgets * q
        self.template = left < 1  # too few grams of its own for the bound
        self.needs = np.where(self.template, size - self.budgets * q, left)
        # which end to align from: the one with fewer shared grams
        middle = pos[order] * 2 < size[item[order]]
        self.backward = np.bincount(item[order][common & middle], minlength=len(texts)) > np.bincount(item[order][common & ~middle], minlength=len(texts))
        own = ~common & ~self.template[item[order]]
        self.times = np.add.reduceat(own.astype(np.int64), at) if len(at) else np.empty(0, dtype=np.int64)
        self.first = np.cumsum(self.times) - self.times
        self.item, self.pos = item[order][own].astype(np.int32), pos[order][own].astype(np.int32)
        # of templates: by classes of length, which grams they have and their distinct pieces
        self.classes = []
        for c in np.unique(self.lengths[self.template] // 64) if self.template.any() else ():
            members = np.flatnonzero(self.template & (self.lengths // 64 == c))
            its = np.zeros(len(self.code), dtype=bool)
            its[np.searchsorted(self.code, codes[np.isin(item, members)])] = True
            flat, begin = _flat([_pieces(arrays[i]) for i in members], np.int64)
            need = np.maximum(1, np.diff(begin) - self.budgets[members] * PIECE)
            self.classes.append((members, its, flat, begin[:-1], need, int((self.lengths + self.budgets)[members].max()), int(self.needs[members].min())))
        self.bits = max(16, int(len(codes) * 8).bit_length())
        self.maybe = np.zeros(1 << self.bits, dtype=bool)
        self.maybe[self._slot(self.code)] = True

    def _slot(self, g: np.ndarray) -> np.ndarray:
        return (g >> np.uint64(64 - self.bits)).astype(np.int64)

    def candidates(self, f: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Rows (text, item, start, end) of the regions of f that may hold an item."""
        none = np.empty((0, 4), dtype=np.int64)
        g = grams(f, self.q)
        p = np.flatnonzero(self.maybe[self._slot(g)])
        where = np.searchsorted(self.code, g[p])
        real = (where < len(self.code)) & (self.code[np.minimum(where, len(self.code) - 1)] == g[p])
        p, where = p[real], where[real]
        doc = np.searchsorted(bounds, p, side="right") - 1
        inside = p + self.q <= bounds[doc + 1]
        p, where, doc = p[inside], where[inside], doc[inside]
        # a match needs this many hits within the longest item's reach
        reach = int((self.lengths + self.budgets).max())
        lo, hi = np.searchsorted(p, p - reach), np.searchsorted(p, p + reach, side="right")
        near = hi - lo >= self.needs.min()
        p, where, doc = p[near], where[near], doc[near]
        if not len(p):
            return none
        found = [self._banded(p, where, doc, bounds)]
        for members, its, flat, begin, need, width, least in self.classes:
            t = its[where]
            found.append(self._stretches(f, p[t], doc[t], bounds, members, flat, begin, need, width, least))
        return np.unique(np.concatenate(found), axis=0)

    def _banded(self, p: np.ndarray, where: np.ndarray, doc: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Regions by bands of diagonals with enough hits of grams that few items share."""
        times = self.times[where]
        src = np.repeat(np.arange(len(p)), times)
        if not len(src):
            return np.empty((0, 4), dtype=np.int64)
        post = np.arange(len(src)) - np.repeat(np.cumsum(times) - times, times) + np.repeat(self.first[where], times)
        it, j, p, doc = self.item[post].astype(np.int64), self.pos[post].astype(np.int64), p[src], doc[src]
        band = (p - j + self.lengths[it]) // (self.budgets[it] + 1)
        key = np.stack([doc, it, band], axis=1)
        # a band spans three widths and starts at each one, so any 2k + 1 diagonals lie whole in one
        triple = np.concatenate([key, key - [0, 0, 1], key - [0, 0, 2]])
        jj = np.tile(j, 3)
        order = np.lexsort((jj, triple[:, 2], triple[:, 1], triple[:, 0]))
        triple, jj = triple[order], jj[order]
        new = np.concatenate([[True], (triple[1:] != triple[:-1]).any(axis=1)])
        fresh = new | np.concatenate([[True], jj[1:] != jj[:-1]])  # an item position counts once
        start = np.flatnonzero(new)
        count = np.add.reduceat(fresh.astype(np.int64), start)
        d, i, b = triple[start[count >= self.needs[triple[start, 1]]]].T
        k, n = self.budgets[i], self.lengths[i]
        first = b * (k + 1) - n  # the band's lowest diagonal
        return np.stack([d, i, np.maximum(bounds[d], first - k), np.minimum(bounds[d + 1], first + 3 * (k + 1) + n + k)], axis=1)

    def _stretches(self, f, p, doc, bounds, members, flat, begin, need, width, least) -> np.ndarray:
        """Regions of templates: stretches of 2 * width that begin every width, so a match lies whole in one."""
        out = [np.empty((0, 4), dtype=np.int64)]
        tile = (p - bounds[doc]) // width
        key, count = np.unique(np.concatenate([np.stack([doc, tile], axis=1), np.stack([doc, tile - 1], axis=1)]), axis=0, return_counts=True)
        key = key[count >= least]
        present = np.zeros(1 << 16, dtype=bool)
        for d, t in key.tolist():
            lo, hi = int(bounds[d]) + max(0, t) * width, min(int(bounds[d + 1]), int(bounds[d]) + (t + 2) * width)
            has = _pieces(f[lo:hi])
            present[has] = True
            hit = members[np.add.reduceat(present[flat].astype(np.int64), begin) >= need]
            present[has] = False
            out.append(np.stack([np.full(len(hit), d), hit, np.full(len(hit), lo), np.full(len(hit), hi)], axis=1))
        return np.concatenate(out)

    def within(self, f: np.ndarray, regions: np.ndarray) -> list[tuple[int, int, int] | None]:
        """For each region its item's best (start, end, edits) in it, if within the budget."""
        hits: list = [None] * len(regions)
        size, long = regions[:, 3] - regions[:, 2], self.lengths[regions[:, 1]] > LONG
        maybe = np.flatnonzero(long)
        order = np.flatnonzero(~long)
        order = order[np.lexsort((self.lengths[regions[order, 1]], size[order]))]
        at = 0
        while at < len(order):
            n = max(1, CELLS // max(1, int(size[order[at]])))
            part = order[at : at + n]
            while len(part) > 1 and len(part) * int(size[part[-1]]) > 2 * CELLS:
                part = part[: len(part) // 2]
            maybe = np.append(maybe, part[self._aligned(f, regions[part])])
            at += len(part)
        for r in maybe.tolist():
            _, i, lo, hi = regions[r].tolist()
            hits[r] = align(self.text[i], f[lo:hi].tobytes(), int(self.budgets[i]))
        return hits

    def _aligned(self, f: np.ndarray, regions: np.ndarray) -> np.ndarray:
        """Which regions hold their item with no more edits than its budget.

        A row of the alignments holds, for each letter of the items, the diagonals on which a match of the budget can
        lie: those of a start anywhere in the region, and as many to both sides as there may be edits.
        """
        items, lo, hi = regions[:, 1], regions[:, 2], regions[:, 3]
        n, k = self.lengths[items], self.budgets[items]
        wide, long, side = int((hi - lo).max()), int(n.max()), int(k.max())
        band = int(np.maximum(hi - lo - n, 0).max()) + 2 * side + 1
        back = self.backward[items][:, None]
        step = np.arange(wide)
        at = np.where(back, hi[:, None] - 1 - step, lo[:, None] + step)
        there = step[None, :] < (hi - lo)[:, None]
        region = np.full((len(regions), max(side + wide, long + band)), 255, dtype=np.uint8)  # 255 is no byte of a text
        region[:, side : side + wide] = np.where(there, f[np.where(there, at, 0)], 255)
        kinds, which = np.unique(items, return_inverse=True)
        letters = np.zeros((len(kinds), long), dtype=np.uint8)
        for row, i in zip(letters, kinds.tolist(), strict=True):
            t = np.frombuffer(self.text[i], dtype=np.uint8)
            row[: len(t)] = t[::-1] if self.backward[i] else t
        out, live = np.zeros(len(regions), dtype=bool), np.arange(len(regions))
        cost = np.zeros((len(regions), band), dtype=np.int32)
        steps = np.arange(band, dtype=np.int32)
        for i in range(long):
            best = cost + (region[live, i : i + band] != letters[which[live], i][:, None])
            np.minimum(best[:, :-1], cost[:, 1:] + 1, out=best[:, :-1])
            cost = np.minimum.accumulate(best - steps, axis=1) + steps
            least = cost.min(axis=1)
            good = least <= k[live]
            done = good & (n[live] == i + 1)
            out[live[done]] = True
            keep = good & ~done
            if not keep.all():
                live, cost = live[keep], cost[keep]
            if not len(live):
                break
        return out


class Items:
    """A block of items (id, text), and the search for them."""

    def __init__(self, rows: list[tuple[int, str]], edits: float = EDITS):
        self.ids = []
        small, large, tiny = [], [], []
        for key, text in rows:
            f = folded(np.frombuffer(text.encode("utf-8"), dtype=np.uint8))[0].tobytes().strip()
            if f:
                (tiny if len(f) < Q else small if len(f) < SMALL else large).append((len(self.ids), f))
                self.ids.append(key)
        self.parts = [([i for i, _ in part], Index([t for _, t in part], edits, q)) for part, q in ((small, SMALL_Q), (large, Q)) if part]
        self.tiny: dict[int, dict[int, list[int]]] = {}
        for i, t in tiny:
            self.tiny.setdefault(len(t), {}).setdefault(int(grams(np.frombuffer(t, dtype=np.uint8), len(t) if len(t) < 9 else 8)[0]), []).append(i)
        self.tiny_text = dict(tiny)

    def search(self, buf: np.ndarray, offs: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(text, item, start, end, edits) of every match in the texts ``buf[offs[i]:offs[i + 1]]``."""
        f, at, to = folded(buf)
        bounds = np.searchsorted(at, offs)
        out = self._exact(f, bounds)
        for names, index in self.parts:
            regions = index.candidates(f, bounds)
            best: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
            for (d, i, lo, _), hit in zip(regions.tolist(), index.within(f, regions) if len(regions) else (), strict=True):
                if hit is None:
                    continue
                a, z, e = lo + hit[0], lo + hit[1], hit[2]
                have = best.setdefault((d, i), [])
                clash = [x for x in have if a < x[1] and x[0] < z]
                if all(e < x[2] for x in clash):
                    best[d, i] = [x for x in have if x not in clash] + [(a, z, e)]
            out += [(d, names[i], a, z, e) for (d, i), found in best.items() for a, z, e in found]
        return [(d, i, int(at[a]), int(to[z - 1]), e) for d, i, a, z, e in sorted(out)]

    def _exact(self, f: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """Whole-word places of the items that are too short for edits."""
        out = []
        for n, known in self.tiny.items():
            g = grams(f, min(n, 8))[: max(0, len(f) - n + 1)]
            p = np.flatnonzero(np.isin(g, np.array(list(known), dtype=np.uint64)))
            d = np.searchsorted(bounds, p, side="right") - 1
            whole = (p + n <= bounds[d + 1]) & ((p == bounds[d]) | (f[p - 1] == 32)) & ((p + n == bounds[d + 1]) | (f[np.minimum(p + n, len(f) - 1)] == 32))
            for a, t in zip(p[whole].tolist(), d[whole].tolist(), strict=True):
                out += [(t, i, a, a + n, 0) for i in known[int(g[a])] if self.tiny_text[i] == f[a : a + n].tobytes()]
        return out


def align(item: bytes, region: bytes, k: int) -> tuple[int, int, int] | None:
    """Best (start, end, edits) of the whole item in a part of the region with at most k edits, else None.

    Tried with few edits first and then four times as many, up to k: a band of the alignment is as wide
    as the edits it allows, so the work grows with the item and the edits that there are.
    """
    exact = region.find(item)
    if exact >= 0:
        return exact, exact + len(item), 0
    letters, r = np.frombuffer(item, dtype=np.uint8), np.frombuffer(region, dtype=np.uint8)
    allowed = 16
    while allowed < k:
        if hit := _in_band(letters, r, allowed):
            return hit
        allowed *= 4
    return _in_band(letters, r, k)


def _in_band(item: np.ndarray, region: np.ndarray, k: int) -> tuple[int, int, int] | None:
    """The best alignment with at most k edits: row i has the costs of the item's first i bytes ending at each place, those over k left out at both ends."""
    m = len(region)
    before = np.concatenate([[255], region]).astype(np.uint8)  # the byte before each place
    low, cost, start = 0, np.zeros(m + 1, dtype=np.int64), np.arange(m + 1)
    big, none = m + 1, 1 << 30
    for c in item.tolist():
        high = min(m + 1, low + len(cost) + 1 + k - int(cost[-1]))  # inserted bytes may lead on from the last place
        old = np.full(high - low + 1, none, dtype=np.int64)
        old[1 : 1 + len(cost)] = cost
        of = np.zeros(high - low + 1, dtype=np.int64)
        of[1 : 1 + len(cost)] = start
        change, drop = old[:-1] + (before[low:high] != c), old[1:] + 1
        best, origin = np.minimum(change, drop), np.where(change <= drop, of[:-1], of[1:])
        # runs of inserted region bytes: the best of what stands to the left plus the distance
        steps = np.arange(high - low)
        both = np.minimum.accumulate((best - steps) * big + (m - origin))
        new = both // big + steps
        origin = np.where(new < best, m - both % big, origin)
        cost = np.minimum(new, best)
        live = np.flatnonzero(cost <= k)
        if not len(live):
            return None
        a, z = int(live[0]), int(live[-1]) + 1
        low, cost, start = low + a, cost[a:z], origin[a:z]
    end = int(cost.argmin())
    return int(start[end]), low + end, int(cost[end])


def blocks(benchmark: DataFrame, limit: int = BLOCK_BYTES):
    """The benchmark's rows in lists of at most ``limit`` bytes of text, one at a time."""
    rows, size = [], 0
    for r in benchmark.filter("item_id IS NOT NULL AND text IS NOT NULL").select("item_id", "text").toLocalIterator():
        n = len(r["text"]) * 4
        if rows and size + n > limit:
            yield rows
            rows, size = [], 0
        rows.append((r["item_id"], r["text"]))
        size += n
    if rows:
        yield rows


_BUILT: dict = {}


def _items(sent, edits: float) -> Items:
    """The index of a broadcast block, built once in a Python worker; only the last few are kept."""
    key, rows = sent.value
    if (key, edits) not in _BUILT:
        while len(_BUILT) > 1:
            _BUILT.pop(next(iter(_BUILT)))
        _BUILT[key, edits] = Items(rows, edits)
    return _BUILT[key, edits]


def contaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, edits: float = EDITS) -> DataFrame:
    """(doc_id, item_id, start, end, edits) of each benchmark item found in ``docs`` (doc_id, text)."""
    schema = "doc_id long, item_id long, start long, end long, edits int"
    names = ["doc_id", "item_id", "start", "end", "edits"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]
    docs, out = docs.select("doc_id", "text"), None
    for rows in blocks(benchmark):
        sent = spark.sparkContext.broadcast((uuid.uuid4().hex, rows))

        def run(batches, sent=sent):
            items = _items(sent, edits)
            for whole in batches:
                for b in pieces(whole, "text"):
                    t = Texts(b.column("text"))
                    ids = b.column("doc_id")
                    hits = items.search(t.buf, t.offs)
                    cols = [[ids[d].as_py() for d, *_ in hits], [items.ids[i] for _, i, *_ in hits], *([h[c] - (int(t.offs[h[0]]) if c < 4 else 0) for h in hits] for c in (2, 3, 4))]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, types, strict=True)], names=names)

        part = docs.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], schema)


def without_contaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, edits: float = EDITS) -> DataFrame:
    """The rows of ``docs``, whatever their columns, whose text holds no benchmark item."""
    for rows in blocks(benchmark):
        sent = spark.sparkContext.broadcast((uuid.uuid4().hex, rows))

        def kernel(name, sent=sent):
            def run(batches):
                items = _items(sent, edits)
                for whole in batches:
                    for b in pieces(whole, name):
                        t = Texts(b.column(name))
                        clean = np.ones(t.n, dtype=bool)
                        clean[[d for d, *_ in items.search(t.buf, t.offs)]] = False
                        yield b.filter(pa.array(clean))

            return run

        docs = through(docs, "text", kernel)
    return docs


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every (document, benchmark item) match with its place and number of edits."""
    return contaminated(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
