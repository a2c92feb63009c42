"""Language-model scores: Katz back-off over words, counted on the corpus itself.

Counts of each order are discounted by Good-Turing (counts up to ``TOP``; larger
counts lose ``TAIL`` of one, so that every context keeps some mass). The counts of
counts are smoothed by a straight line through their logarithms, which keeps every
factor within 0..1 where raw ones are irregular. The mass a context loses goes to unseen words in
proportion to the lower order, with back-off weights that make each context sum to
one exactly over the vocabulary and one unknown word:

    P(w | u v) = d(c(uvw)) c(uvw) / c(uv)     if uvw was seen
               = a(uv) P(w | v)               if uv was seen, but not uvw
               = P(w | v)                     otherwise

and so on down to single words; texts begin with start marks and end with the end
token. ``order`` is the number of words of the longest n-grams.

Counts are looked up where they are: texts are cut into chunks of local word
numbers; each chunk asks for its distinct n-grams once, by level and hash bucket;
each bucket adds up the chunks' counts, which makes the partitioned count tables,
and answers in the order asked. So a hot n-gram is one entry a chunk, no bucket
holds more than its share of distinct n-grams, and nothing of the model's size is
broadcast. Sums for back-off weights go the same way, by context. Words and pairs
are asked for first. A longer n-gram is asked for only if the answer is not known:
in a training text one with a part that occurs once occurs once, and in any text one with an
unseen part is unseen. The number of buckets follows the number of tokens.
Hashes of pairs and longer are cut to as many bits as keep the chance that an
n-gram meets another of equal hash at 2 ** -``SPARE_BITS`` (or to 64).

Edge cases: a null or wordless text is the end token alone; a null doc_id hashes
as the empty string; a text of unknown words is scored by the unknown word's mass;
an empty training part gives every token the probability 1 / (V + 1) = 1; repeated
rows are separate texts; ties cannot arise; an empty table has no scores; whole texts
count, a very long one being a chunk of its own; columns other than doc_id, text and
held are not read, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import Texts, U, Words, mix, pieces
from .work import Workspace

ORDER = 3
TOP, TAIL = 5, 1e-3
SPECTRUM = 40  # counts whose numbers of types the discounts are fitted to
SPARE_BITS = 24
END, START = U(0x5851F42D4C957F2D), U(0x14057B7EF767814F)
CHUNK = 4 << 20  # bytes of text
KEYS = 2_000_000  # tokens that make up a bucket
MOST_FILES = 100_000  # buckets that Spark allows a table
_ZSTD = pa.Codec("zstd")


def pack(x: np.ndarray) -> bytes:
    """An array's bytes, place by place, compressed."""
    raw = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T.tobytes() if len(x) else b""
    return len(x).to_bytes(8, "little") + _ZSTD.compress(raw, asbytes=True)


def unpack(data: bytes, kind) -> np.ndarray:
    kind = np.dtype(kind)
    n = int.from_bytes(data[:8], "little")
    if not n:
        return np.empty(0, dtype=kind)
    raw = _ZSTD.decompress(data[8:], decompressed_size=n * kind.itemsize, asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, dtype=np.uint8).reshape(kind.itemsize, n).T).view(kind).ravel()


def pack_keys(x: np.ndarray) -> bytes:
    """Ascending hashes, as differences."""
    return pack(np.diff(x, prepend=U(0)))


def unpack_keys(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data, np.uint64), dtype=np.uint64)


def bucket_bounds(keys: np.ndarray, n: int) -> np.ndarray:
    """Where each of ``n`` equal ranges of hashes begins in ascending ``keys``."""
    edge = np.array([(i << 64) // n for i in range(n)], dtype=np.uint64)
    return np.append(np.searchsorted(keys, edge), len(keys))


class Level:
    """The distinct n-grams of one length in a chunk, by ascending hash.

    context: place of the words before the last in the level below, or its size at a
    text's start; word: the last; lower: place of the n-gram without its first word
    in the level below; count; of: each token's n-gram.
    """

    def __init__(self, key, context, word, lower, count, of):
        self.key, self.context, self.word, self.lower, self.count, self.of = key, context, word, lower, count, of


class Chunk:
    """Texts as local word numbers: ids, held, length of each; word of each token."""

    def __init__(self, ids, held: bool, sizes: np.ndarray, words: np.ndarray, tokens: np.ndarray):
        self.ids, self.held, self.sizes, self.words, self.tokens = ids, held, sizes, words, tokens

    @classmethod
    def of(cls, hashes: np.ndarray, sizes: np.ndarray, ids, held: bool) -> "Chunk":
        code, words = pd.factorize(hashes)
        order = np.argsort(words)
        place = np.empty(len(words), dtype=np.uint32)
        place[order] = np.arange(len(words), dtype=np.uint32)
        return cls(ids, held, sizes, words[order], place[code])

    def dump(self) -> dict:
        return {"held": self.held, "ids": self.ids, "sizes": pack(self.sizes), "words": pack_keys(self.words), "tokens": pack(self.tokens)}

    @classmethod
    def load(cls, row: dict) -> "Chunk":
        return cls(row["ids"], row["held"], unpack(row["sizes"], np.int64), unpack_keys(row["words"]), unpack(row["tokens"], np.uint32))

    def levels(self, order: int) -> list[Level]:
        """Levels 1 to ``order``."""
        n = len(self.words)
        out = [Level(self.words, None, None, None, np.bincount(self.tokens, minlength=n), self.tokens.astype(np.int64))]
        starts = np.cumsum(self.sizes) - self.sizes
        for _ in range(1, order):
            below = out[-1]
            context = np.empty(len(self.tokens), dtype=np.int64)
            context[1:] = below.of[:-1]
            context[starts] = len(below.key)
            code, both = pd.factorize(context * n + self.tokens)
            first = np.flatnonzero(code > np.maximum.accumulate(np.concatenate([[-1], code[:-1]])))
            context, word = both // n, both % n
            key = mix(mix(np.append(below.key, START)[context]) + self.words[word])
            order_ = np.argsort(key)
            place = np.empty(len(order_), dtype=np.int64)
            place[order_] = np.arange(len(order_))
            out.append(Level(key[order_], context[order_], word[order_], below.of[first][order_], np.bincount(code, minlength=len(both))[order_], place[code]))
        return out


CHUNKS = "chunk long, held boolean, n long, ids array<long>, sizes binary, words binary, tokens binary"


def _cut(batches):
    """Chunks of about ``CHUNK`` bytes of text, those held apart from the others."""
    part, number = TaskContext.get().partitionId(), 0
    names = ["chunk", "held", "n", "ids", "sizes", "words", "tokens"]
    parts: dict[bool, list] = {False: [], True: []}
    size = {False: 0, True: 0}

    def flush(held: bool) -> pa.RecordBatch:
        nonlocal number
        tokens, sizes, ids = (list(x) for x in zip(*parts[held], strict=True))
        c = Chunk.of(np.concatenate(tokens), np.concatenate(sizes), [i for x in ids for i in x], held).dump()
        parts[held], size[held] = [], 0
        number += 1
        return pa.RecordBatch.from_arrays([pa.array([part << 24 | number]), pa.array([held]), pa.array([sum(map(len, tokens))], pa.int64()), pa.array([c["ids"]], pa.list_(pa.int64())), *(pa.array([c[x]], pa.binary()) for x in ("sizes", "words", "tokens"))], names=names)

    for whole in batches:
        for b in pieces(whole, "text"):
            t = Texts(b.column("text"))
            w = Words(t, lower=True)
            all_held = np.asarray(b.column("held")).astype(bool)
            for held in (False, True):
                docs = np.flatnonzero(all_held == held)
                if not len(docs):
                    continue
                # the words of these texts, each followed by the end token
                sizes = w.count[docs] + 1
                stop = np.cumsum(sizes)
                tokens = np.empty(int(stop[-1]), dtype=np.uint64)
                is_end = np.zeros(len(tokens), dtype=bool)
                is_end[stop - 1] = True
                tokens[is_end] = END
                tokens[~is_end] = w.hash[all_held[w.doc] == held]
                parts[held].append((tokens, sizes, b.column("doc_id").take(pa.array(docs)).to_pylist()))
                size[held] += int(np.diff(t.offs)[docs].sum())
                if size[held] >= CHUNK:
                    yield flush(held)
    for held in (False, True):
        if parts[held]:
            yield flush(held)


ASKED = "level int, bucket int, chunk long, held boolean, keys binary, counts binary"


class Spread:
    """How n-grams are dealt into buckets, and how many bits of their hashes are sent."""

    def __init__(self, tokens: int, least: int, buckets: int | None = None):
        self.buckets = buckets or max(least, -(-tokens // KEYS))
        self.drop = max(0, 64 - max(1, tokens).bit_length() - SPARE_BITS)

    def sent(self, level: int, keys: np.ndarray) -> np.ndarray:
        return keys >> U(self.drop) if level > 1 else keys

    def parts(self, keys: np.ndarray):
        """(bucket, start, end) of each bucket that has some of the ascending ``keys``."""
        at = bucket_bounds(keys, self.buckets)
        return [(i, s, e) for i, (s, e) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)) if e > s]


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.Table:
    return pa.table([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * len(kinds), kinds, strict=True)], names=names)


_ASKED = (["level", "bucket", "chunk", "held", "keys", "counts"], [pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.binary(), pa.binary()])


def _ask(spread: Spread, level: int, row: dict, keys: np.ndarray, counts: np.ndarray) -> list[tuple]:
    sent = spread.sent(level, keys)
    return [(level, i, row["chunk"], row["held"], pack_keys(sent[s:e]), pack(counts[s:e].astype(np.uint32))) for i, s, e in spread.parts(keys)]


def _requests(spread: Spread):
    """Words and pairs of every chunk, by level and bucket."""

    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                levels = Chunk.load(row).levels(2)
                out = [r for k, x in enumerate(levels, 1) for r in _ask(spread, k, row, x.key, x.count)]
                yield from _batch(out, *_ASKED).to_batches()

    return run


class Answers:
    """Per level the counts, whether a held text has the n-gram, and whether this chunk is to add it up."""

    def __init__(self, levels: list[Level], held: bool, told: list[dict], spread: Spread, texts: int):
        by: dict[int, list] = {}
        for r in sorted(told, key=lambda r: (r["level"], r["bucket"])):
            by.setdefault(r["level"], []).append(unpack(r["counts"], np.uint64))
        self.texts, self.asked = texts, []
        self.count, self.in_held, self.own = [], [], []
        for k, x in enumerate(levels, 1):
            ask = np.ones(len(x.key), dtype=bool) if k < 3 else self.open(x, held)
            self.asked.append(ask)
            if k > 2 and k not in by and ask.any():
                break  # not asked yet
            count, in_held, own = np.full(len(x.key), 0 if held else 1, dtype=np.int64), np.zeros(len(x.key), dtype=bool), np.full(len(x.key), not held)
            if ask.any():
                got = np.concatenate(by[k]).astype(np.int64)
                count[ask], in_held[ask], own[ask] = got >> 2, got & 2 > 0, got & 1 > 0
            self.count.append(count)
            self.in_held.append(in_held)
            self.own.append(own)

    def before(self, k: int, x: Level) -> np.ndarray:
        """Counts of the contexts of level ``k``'s n-grams."""
        return np.append(self.count[k - 2], self.texts)[x.context]

    def held_before(self, k: int, x: Level) -> np.ndarray:
        return np.append(self.in_held[k - 2], True)[x.context]

    def open(self, x: Level, held: bool) -> np.ndarray:
        """Which n-grams of the level above the last known one have a count that does not follow from their parts'."""
        one, two = np.append(self.count[-1], self.texts)[x.context], self.count[-1][x.lower]
        if held:
            return (one > 0) & (two > 0)
        return (one > 1) & (two > 1) | np.append(self.in_held[-1], True)[x.context] & self.in_held[-1][x.lower]


def _more_requests(spread: Spread, level: int, texts: int):
    """The n-grams of ``level`` whose counts do not follow from those of the level below."""

    def run(key: tuple[pa.Scalar, ...], chunks: pa.Table, answers: pa.Table) -> pa.Table:
        out = []
        for row in chunks.to_pylist():
            levels = Chunk.load(row).levels(level)
            ask = Answers(levels, row["held"], answers.to_pylist(), spread, texts).asked[level - 1]
            out += _ask(spread, level, row, levels[-1].key[ask], levels[-1].count[ask])
        return _batch(out, *_ASKED)

    return run


COUNTED = "level int, bucket int, chunk long, keys binary, counts binary, spectrum array<long>"


def _count(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Adds up a bucket. With chunk null: its count table and its numbers of types of count 1..SPECTRUM, types and tokens.

    Otherwise the answer to a chunk: four times the count, plus 2 if a held text has the
    n-gram, plus 1 if this one of its chunks is to add it up.
    """
    level, bucket = (k.as_py() for k in key)
    rows = sorted(table.to_pylist(), key=lambda r: (r["held"], r["chunk"]))
    asked = [unpack_keys(r["keys"]) for r in rows]
    at = np.cumsum([0, *map(len, asked)])
    code, keys = pd.factorize(np.concatenate(asked))
    total = np.zeros(len(keys), dtype=np.int64)
    in_held = np.zeros(len(keys), dtype=bool)
    own = np.zeros(len(code), dtype=bool)
    for r, s, e in zip(rows, at[:-1], at[1:], strict=True):
        c = code[s:e]
        if r["held"]:
            in_held[c] = True
        else:
            own[s:e] = (total[c] == 0) & np.append(True, c[1:] != c[:-1])
            np.add.at(total, c, unpack(r["counts"], np.uint32).astype(np.int64))
    answer = (total[code] * 4 + in_held[code] * 2 + own).astype(np.uint64)
    order = np.argsort(keys)
    order = order[total[order] > 0]
    spectrum = np.bincount(np.minimum(total[order], SPECTRUM + 1), minlength=SPECTRUM + 2)[1 : SPECTRUM + 1].tolist()
    out = [(level, bucket, None, pack_keys(keys[order]), pack(total[order].astype(np.uint64)), [*spectrum, len(order), int(total.sum())])]
    out += [(level, bucket, r["chunk"], None, pack(answer[s:e]), None) for r, s, e in zip(rows, at[:-1], at[1:], strict=True)]
    return _batch(out, ["level", "bucket", "chunk", "keys", "counts", "spectrum"], [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64())])


def slope(spectrum: list[int]) -> float:
    """Slope of log(number of types) by log(count), numbers averaged over the gaps between counts that occur.

    -2 where fewer than two counts occur.
    """
    r = np.flatnonzero(np.asarray(spectrum[:SPECTRUM]) > 0) + 1.0
    if len(r) < 2:
        return -2.0
    before, after = np.append(0, r[:-1]), np.append(r[1:], 2 * r[-1] - r[-2])
    y = np.log(np.asarray(spectrum, dtype=np.float64)[r.astype(int) - 1] / ((after - before) / 2))
    x = np.log(r)
    return float(((x - x.mean()) * (y - y.mean())).sum() / ((x - x.mean()) ** 2).sum())


#: Good-Turing needs a slope below -1; a flatter one (no text has it) is taken as this.
FLATTEST = -1.05


def discounts(spectrum: list[int]) -> np.ndarray:
    """d(r) for r = 0..TOP by Katz's formula, from the smoothed numbers of types n(r) = r ** slope."""
    e = min(slope(spectrum), FLATTEST) + 1
    r = np.arange(1, TOP + 1)
    common = (TOP + 1.0) ** e  # (TOP + 1) n(TOP + 1) / n(1)
    return np.append(1.0, ((1 + 1 / r) ** e - common) / (1 - common))


def discounted(count: np.ndarray, d: np.ndarray) -> np.ndarray:
    """d(c) c, with the tail's loss above TOP."""
    count = count.astype(np.float64)
    return np.where(count > TOP, count - TAIL, d[np.minimum(count, TOP).astype(np.int64)] * count)


class Model:
    """The numbers that do not grow with the corpus: discounts and totals.

    ``spectra``: per level the numbers of types of count 1..SPECTRUM, types and tokens; ``texts``: training texts.
    """

    def __init__(self, spectra: list[list[int]], texts: int):
        words = spectra[0]
        self.order, self.types, self.tokens, self.texts = len(spectra), words[SPECTRUM], words[SPECTRUM + 1], texts
        # an n-gram that was not asked for occurs once
        single = [self.tokens - s[SPECTRUM + 1] for s in spectra]
        self.spectra = [[s[0] + n, *s[1:SPECTRUM]] for s, n in zip(spectra, single, strict=True)]
        self.slopes = [slope(s) for s in self.spectra]
        self.d = [discounts(s) for s in self.spectra]
        low = sum(n * self.d[0][r] * r for r, n in enumerate(words[:TOP], 1))
        high_types = self.types - sum(words[:TOP])
        high = self.tokens - sum(n * r for r, n in enumerate(words[:TOP], 1)) - TAIL * high_types
        self.unknown = 1 - (low + high) / self.tokens if self.tokens else 1.0

    def unigram(self, count: np.ndarray) -> np.ndarray:
        return np.where(count > 0, discounted(count, self.d[0]) / max(1, self.tokens), self.unknown)


#: Rows of a pass over chunks: finished texts, sums per context, and texts that wait for back-off weights.
PASSED = "kind string, level int, bucket int, chunk long, ids array<long>, numbers binary, keys binary, pending binary"


def _pass(model: Model, spread: Spread):
    def run(key: tuple[pa.Scalar, ...], chunks: pa.Table, answers: pa.Table) -> pa.Table:
        out = []
        for row in chunks.to_pylist():
            c = Chunk.load(row)
            levels = c.levels(model.order)
            a = Answers(levels, row["held"], answers.to_pylist(), spread, model.texts)
            text = np.repeat(np.arange(len(c.sizes)), c.sizes)
            known = a.count[0]
            base = np.log10((known + 1) / (model.tokens + model.types + 1))
            score = np.log10(model.unigram(known))
            for k, x in enumerate(levels[1:], 2):
                cut = discounted(a.count[k - 1], model.d[k - 1])
                score = np.where(a.count[k - 1] > 0, np.log10(np.maximum(cut, 1e-300)) - np.log10(np.maximum(a.before(k, x), 1)), score[x.lower])
            per_text = lambda v, of: np.bincount(text, v[of], len(c.sizes))
            numbers = np.stack([c.sizes.astype(np.float64), per_text(known > 0, c.tokens), per_text(base, c.tokens), per_text(score, levels[-1].of)])
            # tokens that go down from a level whose context was seen need its weight
            down = np.ones(len(c.tokens), dtype=bool)
            places, asks, links = 0, [], []
            for k in range(model.order, 1, -1):
                x = levels[k - 1]
                down &= (a.count[k - 1] == 0)[x.of]
                late = down & (a.before(k, x) > 0)[x.of]
                if row["held"] and late.any():
                    context = x.context[x.of[late]]
                    asked = np.unique(context)
                    hashes = np.append(levels[k - 2].key, START)[asked]
                    order = np.argsort(hashes)
                    place = np.empty(len(levels[k - 2].key) + 1, dtype=np.int64)
                    place[asked[order]] = np.arange(len(asked)) + places
                    links.append(np.stack([text[late], place[context]]))
                    places += len(asked)
                    # how often the context occurs, and the context that is left without its first word
                    total = np.append(a.count[k - 2], model.texts)[asked]
                    left = np.full(len(asked), model.tokens) if k == 2 else np.append(a.count[k - 3][levels[k - 2].lower], model.texts)[asked]
                    asks.append((k, hashes[order], np.stack([total, left])[:, order]))
            kind = "held" if row["held"] else "train"
            if asks:
                link = np.concatenate(links, axis=1)
                pairs, n = np.unique(link[0] * places + link[1], return_counts=True)
                out.append(("waiting", None, None, row["chunk"], c.ids, pack(numbers.ravel()), None, pack(np.stack([pairs, n]).ravel())))
                out += [("ask", k, i, row["chunk"], None, pack(m[:, s:e].ravel()), pack_keys(spread.sent(k - 1, h)[s:e]), None) for k, h, m in asks for i, s, e in spread.parts(h)]
            else:
                out.append((kind, None, None, row["chunk"], c.ids, pack(numbers.ravel()), None, None))
            for k, x in enumerate(levels[1:], 2):
                own = a.own[k - 1] & a.held_before(k, x)
                if not own.any():
                    continue
                # what this chunk adds up per context: numbers of n-grams and of their lower parts by count, as integers,
                # which take little room; with the discounts they give both sums that the weights need
                below, low = levels[k - 2], a.count[k - 2][x.lower[own]]
                some, at = np.unique(x.context[own], return_inverse=True)
                by_count = lambda c: np.bincount(at * (TOP + 1) + np.minimum(c, TOP + 1) - 1, minlength=len(some) * (TOP + 1)).reshape(-1, TOP + 1).T
                sums = np.concatenate([by_count(a.count[k - 1][own]), by_count(low), [np.bincount(at, np.where(low > TOP, low, 0), len(some)).astype(np.int64)]])
                hashes = np.append(below.key, START)[some]
                order = np.argsort(hashes)
                hashes, sums = hashes[order], sums[:, order]
                sent = spread.sent(k - 1, hashes)
                out += [("sum", k, i, row["chunk"], None, pack(sums[:, s:e].ravel()), pack_keys(sent[s:e]), None) for i, s, e in spread.parts(hashes)]
        return _batch(out, ["kind", "level", "bucket", "chunk", "ids", "numbers", "keys", "pending"], [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary()])

    return run


def _weights(model: Model):
    """log10 of the back-off weights that chunks ask for in a bucket of contexts."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        level, bucket = (k.as_py() for k in key)
        rows = sorted(table.to_pylist(), key=lambda r: r["chunk"])
        asks, sums = [r for r in rows if r["kind"] == "ask"], [r for r in rows if r["kind"] == "sum"]
        asked = [unpack_keys(r["keys"]) for r in asks]
        wanted = np.unique(np.concatenate(asked)) if asked else np.empty(0, dtype=np.uint64)
        total, counts = np.zeros((2 * TOP + 3, len(wanted)), dtype=np.int64), np.ones((2, len(wanted)))
        for r, k in zip(asks, asked, strict=True):
            counts[:, np.searchsorted(wanted, k)] = unpack(r["numbers"], np.int64).reshape(2, -1)
        for r in sums if len(wanted) else []:
            k, m = unpack_keys(r["keys"]), unpack(r["numbers"], np.int64).reshape(len(total), -1)
            at = np.searchsorted(wanted, k).clip(max=len(wanted) - 1)
            hit = wanted[at] == k
            for t, v in zip(total, m, strict=True):
                np.add.at(t, at[hit], v[hit])
        own, low, high = total[: TOP + 1], total[TOP + 1 : -1], total[-1]
        r = np.arange(1, TOP + 1)
        lost = (r * (1 - model.d[level - 1][1:])) @ own[:TOP] + TAIL * own[TOP]
        lower = (r * model.d[level - 2][1:]) @ low[:TOP] + high - TAIL * low[TOP]
        weight = np.log10(np.maximum(lost / counts[0], 1e-12) / np.maximum(1 - lower / counts[1], 1e-12))
        out = [(r["chunk"], level, bucket, pack(weight[np.searchsorted(wanted, k)])) for r, k in zip(asks, asked, strict=True)]
        return _batch(out, ["chunk", "level", "bucket", "weights"], [pa.int64(), pa.int32(), pa.int32(), pa.binary()])

    return run


def _finish(key: tuple[pa.Scalar, ...], waiting: pa.Table, weights: pa.Table) -> pa.Table:
    out = []
    for row in waiting.to_pylist():
        w = np.concatenate([unpack(r["weights"], np.float64) for r in sorted(weights.to_pylist(), key=lambda r: (-r["level"], r["bucket"]))])
        numbers = unpack(row["numbers"], np.float64).reshape(4, -1)
        links, n = unpack(row["pending"], np.int64).reshape(2, -1)
        numbers[3] += np.bincount(links // len(w), n * w[links % len(w)], numbers.shape[1])
        out.append((row["ids"], pack(numbers.ravel())))
    return _batch(out, ["ids", "numbers"], [pa.list_(pa.int64()), pa.binary()])


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def _rows(batches):
    for b in batches:
        for row in b.to_pylist():
            m = unpack(row["numbers"], np.float64).reshape(4, -1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(row["ids"], pa.int64()), pa.array([row["held"]] * m.shape[1]), pa.array(m[0].astype(np.int64)), pa.array(m[1].astype(np.int64)), pa.array(m[2]), pa.array(m[3])],
                names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"],
            )


def held_out(doc_id):
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 7 == 2


class Katz:
    """A model counted on the texts (doc_id, text, held) that are not held, and the scores of all of them."""

    def __init__(self, spark: SparkSession, docs: DataFrame, buckets: int | None = None, order: int = ORDER):
        if order < 2:
            raise ValueError("the order is 2 at least")
        self.ws = ws = Workspace(spark, "katz")
        least = int(spark.conf.get("spark.sql.shuffle.partitions"))
        cut = docs.select("doc_id", "text", "held").mapInArrow(_cut, CHUNKS)
        # bucketed by the tasks that cut them, so the passes below read chunks without a shuffle
        files = min(MOST_FILES, max(least, docs.rdd.getNumPartitions()))
        chunks = ws.bucketed(cut, "chunks", "chunk", buckets or files, dealt=True)
        tokens, texts = chunks.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.when(~F.col("held"), F.size("ids"))), F.lit(0))).first()
        spread = Spread(tokens, least, buckets)
        by = lambda df: df.repartition(spread.buckets, "level", "bucket").groupBy("level", "bucket")  # noqa: E731  tasks follow the data, too
        counted = ws.write(by(chunks.mapInArrow(_requests(spread), ASKED)).applyInArrow(_count, COUNTED), "counted", "none")
        answers = counted.filter("chunk IS NOT NULL").select("chunk", "level", "bucket", "counts")
        for level in range(3, order + 1):
            asked = chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_more_requests(spread, level, texts), ASKED)
            more = ws.write(by(asked).applyInArrow(_count, COUNTED), "counted", "none")
            counted = counted.unionByName(more)
            answers = counted.filter("chunk IS NOT NULL").select("chunk", "level", "bucket", "counts")
        #: The model's count tables: level, bucket (range of hashes), keys, counts. N-grams that follow from their parts are not in it.
        self.tables = counted.filter("chunk IS NULL").select("level", "bucket", "keys", "counts")
        spectra = counted.filter("chunk IS NULL").groupBy("level").agg(*(F.sum(F.col("spectrum")[i]).alias(f"s{i}") for i in range(SPECTRUM + 2)))
        found = {r["level"]: list(r)[1:] for r in spectra.collect()}  # a row a level
        self.model = model = Model([found.get(k, [0] * (SPECTRUM + 2)) for k in range(1, order + 1)], texts)
        passed = chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_pass(model, spread), PASSED)
        passed = ws.write(passed, "passed", "none")
        ws.drop(ws.places["chunks"])  # what is left to do reads ``passed`` alone
        weights = by(passed.filter("kind IN ('ask', 'sum')").select("kind", "level", "bucket", "chunk", "numbers", "keys")).applyInArrow(_weights(model), "chunk long, level int, bucket int, weights binary")
        waiting = passed.filter("kind = 'waiting'").select("chunk", "ids", "numbers", "pending")
        done = waiting.groupBy("chunk").cogroup(weights.groupBy("chunk")).applyInArrow(_finish, "ids array<long>, numbers binary").withColumn("held", F.lit(True))
        ready = passed.filter("kind IN ('train', 'held')").select("ids", "numbers", (F.col("kind") == "held").alias("held"))
        self.scores = ready.unionByName(done).mapInArrow(_rows, SCORES)


def op2_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all ``documents`` by a trigram model of those whose remainder is not 2, with the contract's base score."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", held_out(F.col("doc_id")).alias("held"))
    katz = Katz(spark, docs)
    return katz.scores.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(katz.model.tokens).cast("long").alias("train_tokens"), "base_score", "score")
