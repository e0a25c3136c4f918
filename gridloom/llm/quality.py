"""Quality: a factorisation machine over hashed words, structure statistics and metadata.

A document is a sparse vector: the logarithm of how often each hashed word occurs (scaled to length 1), one indicator for the
bin of each structure statistic, and one for the bin of its recorded length. Its logit is a constant, a weight per feature and the products of all pairs of
features, each pair weighed by the product of two short factor vectors. The sum over pairs is half of the square of the sum minus the sum of the squares, factor by
factor, so a document costs time linear in its features. Weights and factors are learned together by Adagrad in numpy.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import ASCII_LOWER, table
from gridloom.llm.toxicity import fold

WORD_BITS, FACTORS = 17, 8
#: Bounds of the training sample: labelled rows of each class, and code points of a text that may be in it.
TRAIN_EACH, TRAIN_CHARS = 2500, 20_000
#: Bytes that are looked at together; a longer text is read in stretches of about this size, whose counts add up.
CHUNK = 1 << 20
#: Bytes of a word that enter its hash.
WORD_BYTES = 64
BINS = 48
#: Weight of an indicator beside the words' vector of length 1.
INDICATOR = 0.5

_WORDS = 1 << WORD_BITS
_KIND = np.zeros(256, np.uint8)  # 0 blank, 1 symbol, 2 letter or digit
_KIND[33:127] = 1
_KIND[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 2
_LOWER = np.frombuffer(ASCII_LOWER, np.uint8)
_POWER = np.ones(WORD_BYTES, np.uint64)
_POWER[1:] = np.cumprod(np.full(WORD_BYTES - 1, 0x100000001B3, np.uint64))
#: What is counted of a text: sums that add up over its stretches.
_SUMS = ("bytes", "letters", "upper", "digits", "symbols", "breaks", "tokens", "words", "repeats")
STATISTICS = ("upper of letters", "digits", "symbols", "blanks", "repeats", "distinct", "most frequent", "bytes of a word", "bytes of a line", "bytes", "recorded length")
FEATURES = _WORDS + len(STATISTICS) * BINS


def _tokens(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, bucket and kind of each run of letters and digits or of symbols in ``data``; A-Z are lower-cased."""
    kind = _KIND[data]
    first = np.flatnonzero((kind > 0) & (kind != np.concatenate([[0], kind[:-1]])))
    if not len(first):
        return first, np.zeros(0, np.int64), np.zeros(0, np.uint8)
    tail, k = data[first[0] :], kind[first[0] :]
    at = first - first[0]
    pos = np.arange(len(tail)) - np.repeat(at, np.diff(np.append(at, len(tail))))
    part = np.where((k > 0) & (pos < WORD_BYTES), (_LOWER[tail].astype(np.uint64) + np.uint64(1)) * _POWER[np.minimum(pos, WORD_BYTES - 1)], np.uint64(0))
    h = np.add.reduceat(part, at)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return first, (h >> np.uint64(64 - WORD_BITS)).astype(np.int64), kind[first]


def _counts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sums of each text (rows as _SUMS); then document, bucket and count of the distinct words of all texts, in order."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    start = np.cumsum([0] + [len(t) + 1 for t in texts[:-1]])
    size = np.array([len(t) for t in texts])
    first, bucket, kind = _tokens(data)
    doc = np.searchsorted(start, first, "right") - 1
    per_byte = [_KIND[data] == 2, (data >= 65) & (data <= 90), (data >= 48) & (data <= 57), _KIND[data] == 1, data == 10]
    sums = [size, *[np.add.reduceat(x.astype(np.int64), start) for x in per_byte]]
    sums[-1] = sums[-1] - 1  # the break after the text is not its own
    again = np.zeros(len(bucket), bool)
    again[1:] = (bucket[1:] == bucket[:-1]) & (doc[1:] == doc[:-1])
    sums += [np.bincount(doc, w, len(texts)).astype(np.int64) for w in (np.ones(len(doc)), kind == 2, again)]
    key, n = np.unique(doc * _WORDS + bucket, return_counts=True)
    return np.stack(sums), key // _WORDS, key % _WORDS, n


def _stretches(data: bytes) -> Iterator[bytes]:
    """``data`` in parts of about CHUNK bytes that end at a blank; a word without any in a whole part is cut."""
    at = 0
    while len(data) - at > CHUNK:
        blank = max(data.rfind(b, at, at + CHUNK) for b in (b" ", b"\n"))
        cut = blank + 1 if blank >= at else at + CHUNK
        yield data[at:cut]
        at = cut
    yield data[at:]


def _long_counts(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As _counts, for one text of any length, in memory that does not grow with it."""
    sums, words = np.zeros(len(_SUMS), np.int64), np.zeros(_WORDS, np.int64)
    for part in _stretches(data):
        s, _, bucket, n = _counts([part])
        sums += s[:, 0]
        words[bucket] += n
    bucket = np.flatnonzero(words)
    return sums, bucket, words[bucket]


def _bins(sums: np.ndarray, distinct: np.ndarray, most: np.ndarray, recorded: np.ndarray) -> np.ndarray:
    """The bin of each statistic (rows) of each document; shares have finer bins near 0, sizes are logarithmic."""
    s = dict(zip(_SUMS, sums.astype(np.float64)))
    share = lambda a, b: np.floor(np.sqrt(np.clip(a / np.maximum(b, 1), 0, 1)) * 32)
    size = lambda a: np.minimum(np.floor(2 * np.log2(np.maximum(a, 0) + 1)), BINS - 2)
    blanks = s["bytes"] - s["letters"] - s["symbols"]
    known = np.nan_to_num(recorded, nan=0.0, posinf=0.0, neginf=0.0)
    return np.stack([
        share(s["upper"], s["letters"]), share(s["digits"], s["bytes"]), share(s["symbols"], s["bytes"]), share(blanks, s["bytes"]), share(s["repeats"], s["tokens"]), share(distinct, s["tokens"]),
        share(most, s["tokens"]), size(s["letters"] / np.maximum(s["words"], 1)), size(s["bytes"] / (s["breaks"] + 1)), size(s["bytes"]), np.where(np.isfinite(recorded), size(known), BINS - 1),
    ]).astype(np.int64)


def encode(texts: list[str | None], recorded: list[float]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``feature, x, edge``: document i has the features edge[i]..edge[i + 1]. Null counts as empty; a recorded length that is NaN as unknown."""
    data = [(t or "").encode() for t in texts]
    long = [i for i, d in enumerate(data) if len(d) > CHUNK]
    sums, doc, bucket, n = _counts([b"" if len(d) > CHUNK else d for d in data])
    for i in long:
        sums[:, i], b, c = _long_counts(data[i])
        at = np.searchsorted(doc, i)
        doc, bucket, n = np.insert(doc, at, np.full(len(b), i)), np.insert(bucket, at, b), np.insert(n, at, c)
    distinct = np.bincount(doc, minlength=len(data))
    most = np.zeros(len(data), np.int64)
    np.maximum.at(most, doc, n)
    x = np.log1p(n)
    x /= np.sqrt(np.bincount(doc, x * x, len(data)))[doc]
    bins = _bins(sums, distinct, most, np.asarray(recorded, np.float64))
    marks = _WORDS + np.arange(len(STATISTICS))[:, None] * BINS + bins
    every = np.concatenate([doc, np.tile(np.arange(len(data)), len(STATISTICS))])
    order = np.argsort(every, kind="stable")
    feature, value = np.concatenate([bucket, marks.ravel()]), np.concatenate([x, np.full(marks.size, INDICATOR)])
    return feature[order], value[order], np.concatenate([[0], np.cumsum(distinct + len(STATISTICS))])


def logits(model: dict, feature: np.ndarray, x: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """Constant, weights, and half of (square of the sum less sum of the squares) of the factors."""
    v = model["factors"][feature] * x[:, None]
    total, squares = np.add.reduceat(v, edge[:-1], 0), np.add.reduceat((v * v).sum(1), edge[:-1])
    return model["constant"] + np.add.reduceat(model["weights"][feature] * x, edge[:-1]) + 0.5 * ((total * total).sum(1) - squares)


def fit(texts: list[str], recorded: list[float], labels: list[int], share: float, epochs: int = 8, rate: float = 0.08, batch: int = 64, seed: int = 3) -> dict | None:
    """The machine learned from labelled texts; ``share`` is the part of label 1 among all labelled rows, to which the sample's classes are weighed. None without both classes."""
    y = np.array(labels, np.float64)
    if len(set(labels)) < 2:
        return None
    parts = [encode(texts[i : i + 256], recorded[i : i + 256]) for i in range(0, len(texts), 256)]
    feature, x = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
    edge = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(p[2]) for p in parts]))])
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    rng = np.random.default_rng(seed)
    model = {"constant": float(np.log(share / (1 - share))), "weights": np.zeros(FEATURES), "factors": rng.normal(0, 0.02, (FEATURES, FACTORS))}
    seen_w, seen_v = np.full(FEATURES, 1e-4), np.full((FEATURES, FACTORS), 1e-4)
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for i in range(0, len(order), batch):
            rows = order[i : i + batch]
            at = np.concatenate([np.arange(edge[r], edge[r + 1]) for r in rows])
            f, xs, cut = feature[at], x[at], np.concatenate([[0], np.cumsum(edge[rows + 1] - edge[rows])])
            p = 1 / (1 + np.exp(-np.clip(logits(model, f, xs, cut), -30, 30)))
            g = np.repeat(weight[rows] * (p - y[rows]) / len(rows), np.diff(cut)) * xs
            v = model["factors"][f]
            rest = np.repeat(np.add.reduceat(v * xs[:, None], cut[:-1], 0), np.diff(cut), 0) - v * xs[:, None]
            known, slot = np.unique(f, return_inverse=True)
            for param, seen, grad in ((model["weights"], seen_w, np.bincount(slot, g)), (model["factors"], seen_v, np.stack([np.bincount(slot, g * rest[:, k]) for k in range(FACTORS)], 1))):
                grad += 1e-5 * param[known]
                seen[known] += grad * grad
                param[known] -= rate * grad / np.sqrt(seen[known])
    return {"constant": model["constant"], "weights": model["weights"].astype(np.float32), "factors": model["factors"].astype(np.float32)}


def _rows(docs: DataFrame, id_col: str, text_col: str, length_col: str | None) -> DataFrame:
    """``id, t, recorded``; a recorded length that is missing or no number is null."""
    recorded = F.expr(f"try_cast(`{length_col}` as double)") if length_col and length_col in docs.columns else F.lit(None).cast("double")
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"), recorded.alias("recorded"))


def training_rows(rows: DataFrame, labels: DataFrame, id_col: str, label_col: str, may_learn, each: int = TRAIN_EACH, chars: int = TRAIN_CHARS) -> DataFrame:
    """``id, t, recorded, y, share``: at most ``each`` labelled texts of each class with ``chars`` code points or fewer (a few more where ids repeat), by the order of a hash
    of the id; ``share`` is the part of label 1 among all labelled ids that may be learned from. ``may_learn`` is a predicate on column ``lid``."""
    known = labels.select(F.col(id_col).cast("long").alias("lid"), F.col(label_col).alias("y")).where("lid is not null and y is not null")
    known = known.where(may_learn(F.col("lid"))).groupBy("lid").agg(F.max((F.col("y") != 0).cast("int")).alias("y"))
    order = F.xxhash64(F.lit("quality"), "lid")
    ids = known.where("y = 1").orderBy(order, "lid").limit(each).union(known.where("y = 0").orderBy(order, "lid").limit(each))
    got = rows.where(F.length("t") <= chars).join(F.broadcast(ids), F.col("id") == F.col("lid"))  # 2 x each ids at most
    share = known.agg(F.avg("y")).scalar()  # one value
    return got.select("id", "t", "recorded", "y").orderBy(F.xxhash64("id"), "t").limit(4 * each).withColumn("share", share)


def _fit_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The model of all rows, pickled; of rows that share an id the one with the last text counts."""
    rows = sorted({i: (i, t, r, y, s) for pdf in batches for i, t, r, y, s in zip(pdf.id, pdf.t, pdf.recorded, pdf.y, pdf.share)}.values(), key=lambda r: r[0])
    got = fit([r[1] for r in rows], [r[2] for r in rows], [r[3] for r in rows], rows[0][4]) if rows else None
    yield pd.DataFrame({"model": [pickle.dumps(got)]})


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", length_col: str | None = "n_chars",
                    may_learn=lambda c: F.lit(True), **bounds) -> DataFrame:
    """``id, score`` per row of ``docs``: the probability of label 1 from the text and, where column ``length_col`` exists, its recorded length.

    A null text counts as empty; empty and blank texts are scored by their statistics alone. A very long text is read in stretches whose counts add up; a word of more than CHUNK bytes counts as several. A recorded length that is
    null, missing or no number has a bin of its own. Without labelled rows of both classes every score is 0. Every row is kept, repeated rows and null ids (as null) too; an empty table gives an empty result; other columns play no part.
    The sample is learned from in one task, which can run again elsewhere; the driver holds the model only (FEATURES x (FACTORS + 1) numbers)."""
    rows = _rows(docs, id_col, text_col, length_col)
    model = training_rows(rows, labels, id_col, label_col, may_learn, **bounds).repartition(1).mapInPandas(_fit_rows, "model binary").first()
    shared = docs.sparkSession.sparkContext.broadcast(pickle.loads(model.model) if model else None)

    @F.pandas_udf("double")
    def score(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        m = shared.value
        for t, r in parts:
            out, lo, size = np.zeros(len(t)), 0, 0
            texts, known = list(t), r.to_numpy(np.float64, na_value=np.nan)
            for i in range(len(texts)):
                size += len(texts[i] or "")
                if m is not None and (size >= CHUNK or i == len(texts) - 1):
                    out[lo : i + 1] = logits(m, *encode(texts[lo : i + 1], known[lo : i + 1]))
                    lo, size = i + 1, 0
            yield pd.Series(out if m is None else 1 / (1 + np.exp(-np.clip(out, -30, 30))))

    return rows.select("id", score("t", "recorded").alias("score"))


def op13_quality(spark, sf_dir: str) -> DataFrame:
    found = score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), may_learn=lambda c: fold(c, 5) != 0)
    return found.select(F.col("id").alias("doc_id"), (fold(F.col("id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
