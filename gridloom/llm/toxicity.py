"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the bag of its character n-grams, borders included; each n-gram hashes to a row of an embedding table. The rows
of the words of a short window are averaged and go through a linear softmax over the labels. A document is as toxic as its
worst window, so a few words count in a long text as in a short one. Training alternates: fit windows, then take the worst windows of
each labelled document again. Embeddings and softmax weights are learned together; for scoring, both collapse exactly into one
number per n-gram, and whole batches of bytes are scored by vector operations.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import table

BUCKETS = 1 << 18
SIZES = (3, 4, 5)
#: Words of a window and between the starts of two windows.
WINDOW, STRIDE = 12, 6
#: Bounds of the training sample: labelled rows of each class, and code points of a text that may be in it.
TRAIN_TOXIC, TRAIN_CLEAN, TRAIN_CHARS = 1200, 1800, 20_000
#: Bytes that are scored at once; a longer text is cut between words into stretches that overlap by a window, which changes no result.
CHUNK = 1 << 20

_LETTER = np.zeros(256, bool)
_LETTER[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def _grams(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of the words in ``data`` (bytes that begin and end with a border), then the bucket and word of each n-gram.

    An n-gram may begin or end with a border but holds none inside."""
    letter = _LETTER[data]
    first = np.flatnonzero(letter[1:] & ~letter[:-1]) + 1
    word = np.cumsum(letter[1:] & ~letter[:-1])  # at i: the number of words begun up to i + 1
    x = np.where(letter, data, 32).astype(np.uint32)
    inside = np.cumsum(np.concatenate([[0], ~letter]).astype(np.int32))
    buckets, words = [], []
    h = x.copy()
    for n in range(2, max(SIZES) + 1):
        h = h[:-1] * np.uint32(0x01000193) ^ x[n - 1 :]
        if n in SIZES and len(h):
            m = len(h)
            at = np.flatnonzero(inside[n - 1 : n - 1 + m] == inside[1 : 1 + m])  # the bytes between first and last are letters
            buckets.append(((h[at] * np.uint32(0x9E3779B1) + np.uint32(n)) >> np.uint32(32 - 18)).astype(np.int32))
            words.append(word[at] - 1)
    return first, np.concatenate(buckets) if buckets else np.zeros(0, np.int32), np.concatenate(words) if words else np.zeros(0, np.int64)


def _bytes(text: str | None) -> bytes:
    return (text or "").lower().encode()


def _windows(n_words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, first and end word of each window, given the number of words of each document."""
    count = np.where(n_words > 0, np.maximum(1, -(-(n_words - WINDOW) // STRIDE) + 1), 0)
    doc = np.repeat(np.arange(len(n_words)), count)
    k = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    base = np.cumsum(n_words) - n_words
    lo = base[doc] + k * STRIDE
    return doc, lo, np.minimum(lo + WINDOW, base[doc] + n_words[doc])


def _window_means(value: np.ndarray, grams: np.ndarray, lo: np.ndarray, hi: np.ndarray, owner: np.ndarray | None = None) -> np.ndarray:
    """Mean n-gram value of the words lo..hi. A word that repeats one of the three before it in its text (``owner``) adds nothing but counts in
    the mean, so that a line of one word over and over is not judged by that word alone."""
    again = np.zeros(len(value), bool)
    for k in (1, 2, 3):
        same = (value[k:] == value[:-k]) & (grams[k:] == grams[:-k])
        again[k:] |= same if owner is None else same & (owner[k:] == owner[:-k])
    total = np.concatenate([[0.0], np.cumsum(np.where(again, 0.0, value))])
    count = np.concatenate([[0], np.cumsum(grams)])
    return (total[hi] - total[lo]) / np.maximum(1, count[hi] - count[lo])


def window_logits(texts: list[bytes], value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, mean n-gram value) of each window of ``texts``."""
    data = np.frombuffer(b" " + b" ".join(texts) + b" ", np.uint8)
    at = np.cumsum([1] + [len(t) + 1 for t in texts[:-1]])
    first, bucket, word = _grams(data)
    n_words = np.diff(np.concatenate([np.searchsorted(first, at), [len(first)]]))
    doc, lo, hi = _windows(n_words)
    owner = np.repeat(np.arange(len(texts)), n_words)
    return doc, _window_means(np.bincount(word, value[bucket], len(first)), np.bincount(word, minlength=len(first)), lo, hi, owner)


def _stretches(data: bytes) -> list[tuple[bytes, bool]]:
    """Stretches of a text of about CHUNK bytes, and whether the first window of each only leads in and does not count.

    A cut lies before a word whose number is a multiple of STRIDE. What follows it begins one stride earlier and what precedes it ends with its last window, so
    the windows that count are those of the whole text, each once, with the words before them that they look at."""
    if len(data) <= CHUNK:
        return [(data, False)]
    letter = _LETTER[np.frombuffer(data, np.uint8)]
    first = np.flatnonzero(letter & ~np.concatenate([[False], letter[:-1]]))
    n = len(first)
    cuts = np.unique(np.searchsorted(first, np.arange(CHUNK, len(data), CHUNK)) // STRIDE * STRIDE)
    cuts = [0, *cuts[(cuts > 0) & (cuts < n)].tolist(), n]
    at = lambda k: int(first[k]) if k < n else len(data)
    return [(data[at(max(0, lo - STRIDE)) : at(min(n, hi - STRIDE + WINDOW)) if hi < n else len(data)], lo > 0) for lo, hi in zip(cuts, cuts[1:])]


def worst_logits(texts: list[str | None], value: np.ndarray) -> np.ndarray:
    """The largest window logit of each text; a text without words has 0."""
    out = np.full(len(texts), -np.inf)
    batch: list[bytes] = []
    owner: list[int] = []
    lead: list[bool] = []
    size = 0

    def flush():
        if batch:
            doc, v = window_logits(batch, value)
            counts = np.ones(len(doc), bool)
            counts[1:] = doc[1:] == doc[:-1]
            counts[:1] = False
            counts |= ~np.array(lead)[doc]
            np.maximum.at(out, np.array(owner)[doc[counts]], v[counts])

    for i, t in enumerate(texts):
        for part, leads in _stretches(_bytes(t)):
            if size + len(part) > CHUNK:
                flush()
                batch, owner, lead, size = [], [], [], 0
            batch.append(part)
            owner.append(i)
            lead.append(leads)
            size += len(part)
    flush()
    return np.where(np.isneginf(out), 0.0, out)


class _Doc:
    """A training text: its n-grams in the order of its words."""

    def __init__(self, text: str):
        first, bucket, word = _grams(np.frombuffer(b" " + _bytes(text) + b" ", np.uint8))
        order = np.argsort(word, kind="stable")
        self.bucket = bucket[order]
        self.grams = np.bincount(word, minlength=len(first))
        self.edge = np.concatenate([[0], np.cumsum(self.grams)])
        _, self.wlo, self.whi = _windows(np.array([len(first)]))
        self.lo, self.hi = self.edge[self.wlo], self.edge[self.whi]

    def logits(self, value: np.ndarray) -> np.ndarray:
        each = np.bincount(np.repeat(np.arange(len(self.grams)), self.grams), value[self.bucket], len(self.grams))
        return _window_means(each, self.grams, self.wlo, self.whi)


class SubwordSoftmax:
    """Embedding table and softmax weights, fitted by Adagrad on windows."""

    def __init__(self, dim: int = 8, classes: int = 2, seed: int = 11):
        self.rng = np.random.default_rng(seed)
        self.table = self.rng.uniform(-1 / dim, 1 / dim, (BUCKETS, dim)).astype(np.float32)
        self.out = np.zeros((classes, dim), np.float32)
        self.bias = np.zeros(classes, np.float32)
        self.seen = [np.full_like(self.table, 1e-6), np.full_like(self.out, 1e-6), np.full_like(self.bias, 1e-6)]

    def value(self) -> np.ndarray:
        """What each n-gram adds to the difference of the two logits."""
        return (self.table @ (self.out[1] - self.out[0])).astype(np.float64)

    def _step(self, grams: list[np.ndarray], y: np.ndarray, weight: np.ndarray, rate: float) -> None:
        n = np.array([len(g) for g in grams])
        flat, owner = np.concatenate(grams), np.repeat(np.arange(len(grams)), n)
        mean = np.add.reduceat(self.table[flat], np.cumsum(n) - n, axis=0) / n[:, None]
        z = mean @ self.out.T + self.bias
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        g = (p - np.eye(len(self.bias), dtype=np.float32)[y]) * (weight / weight.sum())[:, None]
        rows = np.unique(flat)
        slot = np.searchsorted(rows, flat)
        share = np.stack([np.bincount(slot, (g[:, c] / n)[owner], len(rows)) for c in range(len(self.bias))], 1)
        for param, seen, grad, at in ((self.table, self.seen[0], share @ self.out, rows), (self.out, self.seen[1], g.T @ mean, slice(None)), (self.bias, self.seen[2], g.sum(0), slice(None))):
            seen[at] += grad * grad
            param[at] -= rate * grad / np.sqrt(seen[at])

    def train(self, windows: list[np.ndarray], y: np.ndarray, epochs: int, rate: float, batch: int = 256) -> None:
        share = np.bincount(y, minlength=2) / len(y)
        for _ in range(epochs):
            order = self.rng.permutation(len(windows))
            for i in range(0, len(order), batch):
                part = order[i : i + batch]
                self._step([windows[k] for k in part], y[part], 0.5 / share[y[part]], rate)


def fit(texts: list[str], labels: list[int], rounds: int = 4) -> dict | None:
    """The collapsed model: a value per n-gram bucket and the two numbers that turn the worst logit into a probability."""
    docs = [(_Doc(t), int(y)) for t, y in zip(texts, labels)]
    docs = [(d, y) for d, y in docs if len(d.lo) and len(d.bucket)]
    if len({y for _, y in docs}) < 2:
        return None
    model, rng = SubwordSoftmax(), np.random.default_rng(5)
    pick = lambda d, ks: [d.bucket[d.lo[k] : d.hi[k]] for k in ks if d.hi[k] > d.lo[k]]
    clean = [w for d, y in docs if not y for w in pick(d, rng.permutation(len(d.lo))[:10])]
    toxic = [w for d, y in docs if y for w in pick(d, rng.permutation(len(d.lo))[:30])]
    for r in range(rounds):
        model.train(toxic + clean, np.array([1] * len(toxic) + [0] * len(clean)), 3 if r else 4, 0.2 if r == 0 else 0.1)
        value = model.value()
        toxic, hard = [], []
        for d, y in docs:
            worst = np.argsort(-d.logits(value))
            if y:
                toxic += pick(d, worst[:2])
            else:
                hard += pick(d, worst[:6])
        keep = rng.permutation(len(clean))[: 20_000]
        clean = [clean[k] for k in keep] + hard
    model.train(toxic + clean, np.array([1] * len(toxic) + [0] * len(clean)), 3, 0.1)
    value = model.value()
    x = np.array([d.logits(value).max() for d, _ in docs])
    y = np.array([y for _, y in docs])
    center, spread = x.mean(), x.std() + 1e-9
    u, a, b = (x - center) / spread, 1.0, 0.0
    w = np.where(y == 1, 0.2 / y.mean(), 0.8 / (1 - y.mean()))
    for _ in range(300):  # logistic fit of the worst logit; clean texts weigh more, as there are more of them than in the sample
        p = 1 / (1 + np.exp(-np.clip(a * u + b, -30, 30)))
        g = w * (p - y)
        h = w * p * (1 - p) + 1e-9
        a -= (np.mean(g * u) + 1e-4 * a) / (np.mean(h * u * u) + 1e-2)
        b -= np.mean(g) / (np.mean(h) + 1e-2)
    return {"value": value.astype(np.float32), "slope": a / spread, "shift": b - a * center / spread}


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, may_learn, toxic: int = TRAIN_TOXIC, clean: int = TRAIN_CLEAN, chars: int = TRAIN_CHARS) -> DataFrame:
    """``id, t, y``: at most ``toxic`` + ``clean`` labelled texts of ``chars`` code points or fewer (a few more where ids repeat), by the order of a hash of the id. ``may_learn`` is a predicate on column ``lid``."""
    known = labels.select(F.col(id_col).cast("long").alias("lid"), F.col(label_col).alias("y")).where("lid is not null and y is not null")
    known = known.where(may_learn(F.col("lid"))).groupBy("lid").agg(F.max((F.col("y") != 0).cast("int")).alias("y"))
    order = F.xxhash64(F.lit("train"), "lid")
    ids = known.where("y = 1").orderBy(order, "lid").limit(toxic).union(known.where("y = 0").orderBy(order, "lid").limit(clean))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t")).where(F.length("t") <= chars)
    got = rows.join(F.broadcast(ids), F.col("id") == F.col("lid")).select("id", "t", "y")  # toxic + clean ids at most
    return got.orderBy(F.xxhash64("id"), "t").limit(2 * (toxic + clean))


def _fit_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The model of all rows, pickled; of rows that share an id the one with the last text counts."""
    rows = sorted({i: (i, t, y) for pdf in batches for i, t, y in zip(pdf.id, pdf.t, pdf.y)}.values())
    yield pd.DataFrame({"model": [pickle.dumps(fit([t for _, t, _ in rows], [y for *_, y in rows]))]})


def text_scorer(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", may_learn=lambda c: F.lit(True), **bounds):
    """Fit the classifier on a bounded sample of labelled rows (see :func:`training_rows`); a function of a text column that gives the probability of label 1.

    The sample is learned from in one task, which can be run again elsewhere if its executor is lost; the driver holds the model only (a number for each of BUCKETS n-grams)."""
    rows = training_rows(docs, labels, id_col, text_col, label_col, may_learn, **bounds).repartition(1)
    model = rows.mapInPandas(_fit_rows, "model binary").first()
    shared = docs.sparkSession.sparkContext.broadcast(pickle.loads(model.model) if model else None)

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = shared.value
        for t in parts:
            yield pd.Series(np.zeros(len(t)) if m is None else 1 / (1 + np.exp(-np.clip(m["slope"] * worst_logits(list(t), m["value"]) + m["shift"], -30, 30))))

    return score


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", may_learn=lambda c: F.lit(True), **bounds) -> DataFrame:
    """``id, score`` per row of ``docs``: the probability of label 1, from the text alone.

    Null, empty and blank texts have the score of a window without n-grams; a very long text has that of its worst window, whatever its length. Without labelled rows of both classes every score is 0.
    Every row is kept, repeated rows and null ids (as null) too; an empty table gives an empty result; other columns play no part."""
    score = text_scorer(docs, labels, id_col, text_col, label_col, may_learn, **bounds)
    return docs.select(F.col(id_col).cast("long").alias("id"), score(F.col(text_col)).alias("score"))


def fold(c, n: int):
    """The fold of an id: crc32 of its decimal text, modulo n."""
    return F.crc32(F.encode(c.cast("string"), "UTF-8")) % n


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    found = score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), may_learn=lambda c: fold(c, 5) != 0)
    return found.select(F.col("id").alias("doc_id"), (fold(F.col("id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
