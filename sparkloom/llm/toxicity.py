"""Toxicity by weak supervision.

1. From bounded samples of labelled and of unlabelled rows (``SAMPLE`` and
   ``UNLABELLED`` documents, those with the smallest hashes of doc_id), the terms of
   each document are taken: words and their first 4 to 7 bytes, so that inflected
   forms meet.
2. Voters: the built-in lexicon, terms that the labelled sample associates with toxic
   or with clean text, and patterns of style. Each votes toxic, clean or abstains.
3. A generative label model: the hidden label gives each voter's vote with its
   own accuracy and coverage, estimated by EM over all rows. Known labels count in
   the estimates of accuracies, never in a row's posterior, which is that of its
   votes alone. Voters that depend on each other beyond what the label explains are
   weighed by the inverse of their estimated correlations, so that m copies of a
   voter count as one.
4. A linear classifier on the presence of terms is trained on the posterior
   labels and scores every document's whole text.

Labels, lang, source and doc_id are no inputs of a score. The fit is bounded by four
parameters: both sample sizes, ``MAX_TERMS`` terms of the classifier and
``MAX_VOTERS`` voters, the most telling ones first.

Edge cases: a null text counts as empty; an empty text, one without known terms,
and any text when there are no usable labels get the score of the bias alone;
null labels and labels of unknown documents are left out; contradictory labels
of a document count as toxic if any says so; repeated rows score alike; whole texts
count, a very long one being a batch of its own; an empty table has no scores; columns
other than doc_id and text are not read or pass through, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import LOWER, Texts, lists, pieces, word_hash
from .work import Workspace, through

SAMPLE, UNLABELLED = 12_000, 6_000
MAX_TERMS, MAX_VOTERS = 16_384, 800
PREFIXES = (4, 5, 6, 7)
#: Common insults in English, French, German and Spanish, each a voter of its own.
LEXICON = (
    "bastard", "brainless", "clown", "coward", "cretin", "crap", "damn", "despicable", "dimwit", "disgusting", "dumb", "dunce", "filth", "filthy", "fool", "freak", "garbage", "gross", "idiot", "idiotic", "ignorant", "imbecile", "jerk", "lame", "liar", "loser", "lousy",
    "lunatic", "moron", "moronic", "nasty", "nitwit", "nonsense", "pathetic", "pig", "rat", "repulsive", "revolting", "rotten", "rubbish", "scum", "scumbag", "shameful", "sick", "sleazy", "spineless", "stupid", "sucker", "swine", "trash", "ugly", "useless", "vermin", "vile", "weakling", "worthless", "wretch",
    "abruti", "connard", "cr\u00e9tin", "d\u00e9bile", "imb\u00e9cile", "minable", "ordure", "salaud", "arschloch", "bl\u00f6d", "depp", "dreck", "dummkopf", "schwachkopf", "schwein", "trottel", "basura", "cerdo", "est\u00fapido", "idiota", "imb\u00e9cil", "in\u00fatil", "mierda", "tonto",
)
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(97, 123), *range(128, 256)]] = True
TOXIC_RATIO, CLEAN_RATIO = 20.0, 40.0


def terms(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, term hash) pairs: letter runs in lower case, whole and by prefix."""
    buf = LOWER[t.buf]
    n = len(buf)
    letter = _LETTER[buf]
    head = np.zeros(n + 1, dtype=bool)
    head[t.offs] = True
    before, after = np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)
    before[1:], after[:-1] = letter[:-1], letter[1:]
    starts = np.flatnonzero(letter & (~before | head[:-1]))
    ends = np.flatnonzero(letter & (~after | head[1:])) + 1
    doc = np.searchsorted(t.offs, starts, side="right") - 1
    word = word_hash(buf, starts, ends)
    # distinct words per text first: prefixes only of these
    order = np.lexsort((word, doc))
    d, w = doc[order], word[order]
    keep = np.ones(len(d), dtype=bool)
    keep[1:] = (d[1:] != d[:-1]) | (w[1:] != w[:-1])
    at = order[keep]
    starts, ends, doc, word = starts[at], ends[at], doc[at], word[at]
    docs, out = [doc], [word]
    for k in PREFIXES:
        long = ends - starts > k
        docs.append(doc[long])
        # its own seed keeps a prefix apart from the word of the same letters
        out.append(word_hash(buf, starts[long], starts[long] + k, 1))
    doc, term = np.concatenate(docs), np.concatenate(out)
    order = np.lexsort((term, doc))
    doc, term = doc[order], term[order]
    keep = np.ones(len(doc), dtype=bool)
    keep[1:] = (doc[1:] != doc[:-1]) | (term[1:] != term[:-1])
    return doc[keep], term[keep]


def styles(t: Texts) -> np.ndarray:
    """Share of capitals, of punctuation, and length class of each text."""
    size = np.maximum(1, np.diff(t.offs))
    count = lambda m: np.diff(np.concatenate([[0], np.cumsum(m)])[t.offs])
    return np.stack([count((t.buf >= 65) & (t.buf <= 90)) / size, count(t.buf == 33) / size, count((t.buf >= 33) & (t.buf < 48)) / size], axis=1)


def term_hash(word: str) -> int:
    b = np.frombuffer(word.encode(), dtype=np.uint8)
    return int(word_hash(b, np.array([0]), np.array([len(b)]))[0])


def dependence_weights(spread: np.ndarray, n: int, apart: np.ndarray, strength: float = 3.0) -> np.ndarray:
    """A weight for each voter from ``spread``, the covariance over ``n`` documents of the votes less what the label explains.

    ``apart``: how far the label moves each voter's mean vote. In standard units that
    is t, and the best linear combination of voters of correlation R takes R^-1 t where
    independent ones take t; the weights are the quotient of the two, from 0 to 1. So m
    copies get 1 / m each, and a voter that adds nothing to another gets none.
    Correlations under ``strength`` standard errors are taken as none.
    """
    m = len(spread)
    if not m or not n:
        return np.ones(m)
    sd = np.maximum(np.sqrt(np.diag(spread)), 1e-6)
    c = spread / np.outer(sd, sd)
    c[np.abs(c) < strength / np.sqrt(n)] = 0
    np.fill_diagonal(c, 1)
    t, ridge = apart / sd, 0.1
    t = np.where(np.abs(t) < 1e-6, 1e-6, t)
    return np.clip(np.linalg.solve(c + ridge * np.eye(m), (1 + ridge) * t) / t, 0, 1)


ROWS = 1024  # of the votes that are widened to numbers at a time


def _parts(votes: np.ndarray):
    """(rows, votes for, votes against) block by block, as numbers."""
    for s in range(0, len(votes), ROWS):
        v = votes[s : s + ROWS]
        yield slice(s, s + ROWS), (v > 0).astype(np.float64), (v < 0).astype(np.float64)


def _spread(votes: np.ndarray, label: np.ndarray, share: np.ndarray, one: np.ndarray, zero: np.ndarray) -> tuple[np.ndarray, int]:
    """Covariance of the votes less their means ``one`` and ``zero`` by label, over the rows with a share, and their number."""
    m, n = votes.shape[1], 0
    total, square = np.zeros(m), np.zeros((m, m))
    for rows, pos, neg in _parts(votes):
        some = share[rows] > 0
        y = label[rows][some, None]
        rest = (pos - neg)[some] - y * one - (1 - y) * zero
        n += len(rest)
        total += rest.sum(axis=0)
        square += rest.T @ rest
    return (square / n - np.outer(total, total) / n**2, n) if n else (square, 0)


def label_model(votes: np.ndarray, gold: np.ndarray, rounds: int = 40) -> np.ndarray:
    """Posterior probability of label 1 from ``votes`` (documents x voters, of -1, 0, 1), for each row from its votes alone.

    ``gold``: 1, 0, or -1 where no label is known; used for the voters' accuracies only.
    """
    n, m = votes.shape
    known = gold >= 0
    prior = float(np.clip(gold[known].mean(), 0.005, 0.95)) if known.any() else 0.1
    start = np.log(prior / (1 - prior)) + votes.sum(axis=1, dtype=np.int64)
    post, weight = 1 / (1 + np.exp(-np.clip(start, -30, 30))), np.ones(m)
    for r in range(rounds):
        # the first estimates are from known labels alone, where there are any
        label = np.where(known, gold, post)
        share = known.astype(np.float64) if r == 0 and known.any() else np.ones(n)
        a, b = (share * label).sum(), (share * (1 - label)).sum()
        by = np.zeros((4, m))
        for rows, pos, neg in _parts(votes):
            yes, no = (share * label)[rows], (share * (1 - label))[rows]
            by += [yes @ pos, no @ pos, yes @ neg, no @ neg]
        p1, p0, q1, q0 = (by + 0.1) / (np.array([[a], [b], [a], [b]]) + 1)
        prior = float(np.clip(a / (a + b), 0.005, 0.95))
        if r == (0 if known.any() else 3):  # from known labels, as dependent voters can make up a label of their own
            weight = dependence_weights(*_spread(votes, label, share, p1 - q1, p0 - q0), p1 - q1 - p0 + q0)
        away = np.log((1 - p1 - q1).clip(1e-6)) - np.log((1 - p0 - q0).clip(1e-6))
        up, down = weight * (np.log(p1 / p0) - away), weight * (np.log(q1 / q0) - away)
        gain = np.concatenate([pos @ up + neg @ down for _, pos, neg in _parts(votes)]) + (weight * away).sum()
        new = 1 / (1 + np.exp(-np.clip(np.log(prior / (1 - prior)) + gain, -30, 30)))
        change = np.abs(new - post).max(initial=0)
        post = new
        if r > 3 and change < 1e-4:
            break
    return post


def term_statistics(rows: DataFrame, toxic: int, n: int) -> DataFrame:
    """Terms of ``rows`` (toxic, terms) worth a vote or a weight: term, df, both, odds, ratio.

    ratio is the log-likelihood ratio of term x label against independence, which
    keeps chance terms out; odds the log ratio of the term's rates.
    """
    per = rows.select("toxic", F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"), F.sum("toxic").alias("both"))
    df, both = F.col("df").cast("double"), F.col("both").cast("double")
    part = lambda x, e: F.when(x > 0, 2 * x * F.log(x / e)).otherwise(0.0)
    clean = n - toxic
    ratio = part(both, df * toxic / n) + part(df - both, df * clean / n) + part(toxic - both, (n - df) * toxic / n) + part(clean - df + both, (n - df) * clean / n)
    odds = F.log((both + 0.02) / max(1, toxic)) - F.log((df - both + 0.02) / max(1, clean))
    per = per.filter("df >= 3").withColumn("ratio", ratio).withColumn("odds", odds)
    chosen = ((F.col("odds") > 1) & (F.col("ratio") > TOXIC_RATIO)) | ((F.col("odds") < 0) & (F.col("ratio") > CLEAN_RATIO))
    common = (F.col("odds") < -0.5) & (df >= max(20, n // 50))
    listed = F.col("term").isin([int(np.uint64(term_hash(w)).view(np.int64)) for w in LEXICON])
    return per.filter(chosen | common | listed).orderBy(F.desc("ratio"), "term").limit(MAX_TERMS)


def voters(vocab, df, in_toxic, odds, ratio, doc, code, style, n: int) -> np.ndarray:
    """Votes (documents x voters) of the lexicon, of terms for toxic and for clean, and of patterns of style."""
    place = np.searchsorted(vocab, np.array([term_hash(w) for w in LEXICON], dtype=np.uint64)).clip(max=max(0, len(vocab) - 1))
    lexicon = [i for i, w in zip(place.tolist(), LEXICON, strict=True) if len(vocab) and int(vocab[i]) == term_hash(w)]
    strong = np.flatnonzero((in_toxic >= 3) & (odds > 2.5) & (ratio > TOXIC_RATIO))
    mild = np.flatnonzero((odds < -0.5) & (ratio > CLEAN_RATIO))
    chosen = np.concatenate([strong, mild])
    chosen = chosen[np.argsort(-ratio[chosen], kind="stable")]
    named = list(dict.fromkeys([*lexicon, *chosen.tolist()]))[:MAX_VOTERS]
    votes = np.zeros((n, len(named) + style.shape[1]), dtype=np.int8)
    column = np.full(len(vocab), -1)
    column[named] = np.arange(len(named))
    hit = column[code] >= 0
    sign = np.where(np.isin(np.array(named, dtype=np.int64), mild), -1, 1).astype(np.int8)
    votes[doc[hit], column[code[hit]]] = sign[column[code[hit]]]
    for s in range(style.shape[1]):
        votes[:, len(named) + s] = (style[:, s] > np.quantile(style[:, s], 0.98)).astype(np.int8)
    return votes


def fit(vocab: np.ndarray, df: np.ndarray, in_toxic: np.ndarray, odds: np.ndarray, ratio: np.ndarray, doc: np.ndarray, code: np.ndarray, style: np.ndarray, gold: np.ndarray, ids: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, float]:
    """(term hashes in order, weights, bias); (doc, code) are the pairs of documents and places in ``vocab``, ``ids`` the documents' (unused)."""
    n = len(gold)
    chosen = np.flatnonzero(((odds > 1) & (ratio > TOXIC_RATIO)) | ((odds < 0) & (ratio > CLEAN_RATIO)))
    post = label_model(voters(vocab, df, in_toxic, odds, ratio, doc, code, style, n), gold)
    # logistic regression on presence, by full-batch AdaGrad over the sparse pairs
    slot = np.full(len(vocab), -1)
    slot[chosen] = np.arange(len(chosen))
    keep = slot[code] >= 0
    d, c = doc[keep], slot[code[keep]]
    w = np.zeros(len(chosen))
    bias, seen, seen_b = float(np.log(post.mean() / (1 - post.mean()))), np.full(len(chosen), 1e-6), 1e-6
    balance = np.where(post > 0.5, 0.5 / max(1e-3, post.mean()), 0.5 / max(1e-3, 1 - post.mean()))
    for _ in range(250):
        z = np.bincount(d, w[c], n) + bias
        err = balance * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - post)
        grad = np.bincount(c, err[d], len(chosen)) / n + 1e-4 * w
        seen += grad * grad
        w -= 0.15 * grad / np.sqrt(seen)
        seen_b += err.mean() ** 2
        bias -= 0.15 * err.mean() / np.sqrt(seen_b)
    return vocab[chosen], w, bias


def _gather(schema_cols: list[str]):
    def run(batches):
        for whole in batches:
            for b in pieces(whole, "text"):
                t = Texts(b.column("text"))
                doc, term = terms(t)
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in schema_cols), lists(term, np.bincount(doc, minlength=t.n)), lists(styles(t).ravel(), np.full(t.n, 3))], names=[*schema_cols, "terms", "style"])

    return run


def _picked(spark: SparkSession, rows: DataFrame, n: int) -> DataFrame:
    """The ``n`` rows (doc_id, toxic) with the smallest hashes of doc_id."""
    got = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(n).collect()  # n rows at most
    return spark.createDataFrame([(r["doc_id"], r["toxic"]) for r in got], "doc_id long, toxic int")


def sampled(spark: SparkSession, docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, unlabelled: int = UNLABELLED) -> dict | None:
    """What ``fit`` takes, from at most ``sample`` of ``labels`` (doc_id, toxic) and ``unlabelled`` documents without any.

    The samples are a fixed number of documents whatever the input, and only their
    distinct terms reach the driver. None if there are no labels of both kinds.
    """
    known = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    named = docs.filter("doc_id IS NOT NULL").select("doc_id")
    other = named.join(known, "doc_id", "leftanti").distinct().withColumn("toxic", F.lit(-1))
    picked = _picked(spark, known, sample).unionByName(_picked(spark, other, unlabelled))
    # a repeated doc_id counts once, so the samples' bounds hold
    texts = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("doc_id", "text", "toxic")
    ws = Workspace(spark, "toxicity")
    every = texts.mapInArrow(_gather(["doc_id", "toxic"]), "doc_id long, toxic int, terms array<long>, style array<double>")
    every = ws.write(every.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min_by("terms", F.hash("terms")).alias("terms"), F.min_by("style", F.hash("terms")).alias("style")), "sample")
    rows = every.filter("toxic >= 0")
    n, toxic = rows.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not n or not toxic or toxic == n:
        return None
    stats = term_statistics(rows, toxic, n).toPandas()  # at most MAX_TERMS rows
    vocab = stats["term"].to_numpy(dtype=np.int64).view(np.uint64)
    order = np.argsort(vocab)
    vocab, (df, both, odds, ratio) = vocab[order], (stats[c].to_numpy()[order] for c in ("df", "both", "odds", "ratio"))
    sent = spark.sparkContext.broadcast(vocab)

    def known_terms(batches):
        for b in batches:
            col = b.column("terms")
            size = np.asarray(pa.compute.list_value_length(col))
            t = np.asarray(col.flatten()).view(np.uint64)
            at = np.searchsorted(sent.value, t).clip(max=max(0, len(sent.value) - 1))
            hit = (sent.value[at] == t) if len(sent.value) else np.zeros(len(t), dtype=bool)
            count = np.bincount(np.repeat(np.arange(len(size)), size)[hit], minlength=len(size))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("toxic"), b.column("style"), lists(at[hit].astype(np.int64), count)], names=["doc_id", "toxic", "style", "codes"])

    got = every.orderBy("doc_id").mapInArrow(known_terms, "doc_id long, toxic int, style array<double>, codes array<long>").toArrow()
    col = got.column("codes").combine_chunks()
    doc = np.repeat(np.arange(got.num_rows), np.asarray(pa.compute.list_value_length(col)))
    return {"vocab": vocab, "df": df, "in_toxic": both, "odds": odds, "ratio": ratio, "doc": doc, "code": np.asarray(col.flatten()), "style": np.array(got.column("style").to_pylist()), "gold": np.asarray(got.column("toxic")), "ids": np.asarray(got.column("doc_id"))}


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, unlabelled: int = UNLABELLED):
    """The classifier (terms, weights, bias) that ``fit`` makes of samples of ``labels`` (doc_id, toxic) and ``docs``."""
    got = sampled(spark, docs, labels, sample, unlabelled)
    if got is None:  # of one kind only, or none
        some = docs.select("doc_id").join(labels.filter("toxic = 1").select("doc_id"), "doc_id", "leftsemi").limit(1).count()
        return np.empty(0, dtype=np.uint64), np.empty(0), 2.0 if some else -2.0
    return fit(**got)


def scores(t: Texts, model) -> np.ndarray:
    """The classifier's probability of toxic for each text."""
    vocab, weight, bias = model
    z = np.full(t.n, bias)
    if len(vocab):
        doc, term = terms(t)
        at = np.searchsorted(vocab, term).clip(max=len(vocab) - 1)
        z += np.bincount(doc, np.where(vocab[at] == term, weight[at], 0.0), t.n)
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def scored(spark: SparkSession, docs: DataFrame, model) -> DataFrame:
    """doc_id and toxicity double in 0..1 of ``docs`` (doc_id, text), from whole texts."""
    sent = spark.sparkContext.broadcast(model)  # MAX_TERMS terms at most

    def run(batches):
        for whole in batches:
            for b in pieces(whole, "text"):
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(scores(Texts(b.column("text")), sent.value))], names=["doc_id", "toxicity"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, toxicity double")


def without_toxic(spark: SparkSession, docs: DataFrame, model, limit: float = 0.5) -> DataFrame:
    """The rows of ``docs``, whatever their columns, whose text scores below ``limit``."""
    sent = spark.sparkContext.broadcast(model)

    def kernel(name):
        def run(batches):
            for whole in batches:
                for b in pieces(whole, name):
                    yield b.filter(pa.array(scores(Texts(b.column(name)), sent.value) < limit))

        return run

    return through(docs, "text", kernel)


def _fold(doc_id, n: int):
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def held_out(doc_id):
    return _fold(doc_id, 5) == 0


def trained_on_open(spark: SparkSession, docs: DataFrame, sf_dir: str):
    """The model learnt from the labels that are not held out."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    return train(spark, docs, labels.filter(~held_out(F.col("doc_id"))))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of all ``documents``, learnt from the labels of the others than the held-out ones."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = scored(spark, docs, trained_on_open(spark, docs, sf_dir))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))
