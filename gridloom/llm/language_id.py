"""Language identification: a bidirectional gated recurrent network over bytes, trained in numpy by backpropagation through time.

A text becomes lower-case letters with single spaces between words, cut into stretches of fixed length. Two recurrent passes read each stretch
forward and backward; every position gets a probability of each language from both states, and the mean over all
positions of a document is its result. All stretches of a batch advance together, one matrix product per position and direction.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from gridloom.llm.common import table
from gridloom.llm.toxicity import fold

#: Units of each direction, bytes of a stretch, stretches that advance together.
HIDDEN, STEPS, LANES = 8, 64, 4096
#: Bounds of the training sample: rows of a language and of all together (every language keeps one at least), code points of a text, stretches of a language and of all.
TRAIN_ROWS, TRAIN_TOTAL, TRAIN_CHARS, TRAIN_STRETCHES, ALL_STRETCHES = 300, 60_000, 20_000, 1500, 300_000

_OTHER, _ANY = regex.compile(r"[^\p{L}\p{M}]+"), regex.compile(r"\p{L}")


def letters(text: str | None) -> bytes:
    """Lower-case letters with their marks, runs of all else as one space; nothing for a text without letters."""
    return _OTHER.sub(" ", text.lower()).encode() if text and _ANY.search(text) else b""


def stretches(texts: list[bytes], steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """(steps, number of stretches) of bytes, padded with 0, and the text of each stretch."""
    count = np.array([-(-len(t) // steps) for t in texts], np.int64)
    data = b"".join(t.ljust(c * steps, b"\0") for t, c in zip(texts, count.tolist()))
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(-1, steps).T), np.repeat(np.arange(len(texts)), count)


class ByteGru:
    """Weights by direction: ``x`` (256 bytes, 3 gates), ``u`` (gates from the state), then ``v`` from both states to languages.

    Gate order: update, reset, candidate. The sigmoid is 0.5 + 0.5 tanh(x / 2)."""

    def __init__(self, classes: int, hidden: int = HIDDEN, seed: int = 3):
        rng = np.random.default_rng(seed)
        f = lambda *s, k: rng.normal(0, k, s).astype(np.float32)
        self.hidden = hidden
        self.p = {"v": f(classes, 2 * hidden, k=0.3), "c": np.zeros((classes, 1), np.float32)}
        for d in "fb":
            self.p |= {f"x{d}": f(3 * hidden, 256, k=0.5), f"u{d}": f(3 * hidden, hidden, k=0.4)}

    def states(self, data: np.ndarray, d: str, keep: bool = False):
        """States after each byte (steps, hidden, lanes), in reading order of the direction."""
        t, n = data.shape
        h, x, u = self.hidden, self.p[f"x{d}"], self.p[f"u{d}"]
        half = np.repeat([0.5, 0.5, 1.0], h).astype(np.float32)[:, None]
        xs, us, uc = x * half, (u * half)[: 2 * h], u[2 * h :]
        s, out, tape = np.zeros((h, n), np.float32), np.empty((t, h, n), np.float32), []
        xs = np.ascontiguousarray(xs.T)
        for i in range(t) if d == "f" else range(t - 1, -1, -1):
            a = xs[data[i]].T
            zr = np.tanh(a[: 2 * h] + us @ s)
            zr += 1
            zr *= 0.5
            z, r = zr[:h], zr[h:]
            c = np.tanh(a[2 * h :] + uc @ (r * s))
            if keep:
                tape.append((i, s, z, r, c))
            s = s + z * (c - s)
            out[i] = s
        return (out, tape) if keep else out

    def position_probabilities(self, data: np.ndarray) -> np.ndarray:
        """(steps, languages, lanes): the label of every position."""
        v, h = self.p["v"], self.hidden
        z = v[:, :h] @ self.states(data, "f") + v[:, h:] @ self.states(data, "b") + self.p["c"]
        z -= z.max(1, keepdims=True)
        np.exp(z, out=z)
        z /= z.sum(1, keepdims=True)
        return z

    def gradients(self, data: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        """Mean loss over all positions that hold a byte, and its gradients, through all steps of both directions."""
        t, n = data.shape
        h, v = self.hidden, self.p["v"]
        hf, tf = self.states(data, "f", True)
        hb, tb = self.states(data, "b", True)
        z = v[:, :h] @ hf + v[:, h:] @ hb + self.p["c"]
        z -= z.max(1, keepdims=True)
        p = np.exp(z)
        p /= p.sum(1, keepdims=True)
        real = (data != 0).astype(np.float32)
        total = max(1.0, float(real.sum()))
        loss = -float((np.log(p[:, y, np.arange(n)] + 1e-9) * real).sum()) / total
        p[:, y, np.arange(n)] -= 1
        g = p * (real / total)[:, None, :]
        grad = {"v": np.concatenate([np.einsum("tcn,thn->ch", g, hf), np.einsum("tcn,thn->ch", g, hb)], 1), "c": g.sum((0, 2))[:, None]}
        for d, tape, part in (("f", tf, v[:, :h]), ("b", tb, v[:, h:])):
            u = self.p[f"u{d}"]
            dx, du, ds = np.zeros((3 * h, 256), np.float32), np.zeros_like(u), np.zeros((h, n), np.float32)
            for i, s, z_, r, c in reversed(tape):
                ds = ds + part.T @ g[i]
                da_c = ds * z_ * (1 - c * c)
                back = u[2 * h :].T @ da_c
                da = np.concatenate([ds * (c - s) * z_ * (1 - z_), back * s * r * (1 - r), da_c])
                du[: 2 * h] += da[: 2 * h] @ s.T
                du[2 * h :] += da_c @ (r * s).T
                order = np.argsort(data[i], kind="stable")
                seen, first = np.unique(data[i][order], return_index=True)
                dx[:, seen] += np.add.reduceat(da[:, order], first, axis=1)
                ds = ds * (1 - z_) + back * r + u[: 2 * h].T @ da[: 2 * h]
            grad |= {f"x{d}": dx, f"u{d}": du}
        return loss, grad

    def train(self, data: np.ndarray, y: np.ndarray, steps: int = 260, lanes: int = 128, rate: float = 0.02) -> float:
        """Adam over random batches of stretches."""
        rng, loss = np.random.default_rng(8), 0.0
        m = {k: np.zeros_like(a) for k, a in self.p.items()}
        q = {k: np.zeros_like(a) for k, a in self.p.items()}
        for k in range(1, steps + 1):
            at = rng.integers(0, data.shape[1], lanes)
            loss, grad = self.gradients(data[:, at], y[at])
            now = rate * (1 - 0.8 * k / steps)
            for name, g in grad.items():
                m[name] = 0.9 * m[name] + 0.1 * g
                q[name] = 0.99 * q[name] + 0.01 * g * g
                self.p[name] -= now * (m[name] / (1 - 0.9**k)) / (np.sqrt(q[name] / (1 - 0.99**k)) + 1e-6)
        return loss

    def pooled(self, texts: list[bytes]) -> np.ndarray:
        """Mean label probabilities of the positions of each text; texts without bytes have 0 everywhere."""
        out, size = np.zeros((len(texts), len(self.p["c"]))), np.zeros(len(texts))
        data, owner = stretches(texts)
        lanes = max(64, 4 * LANES // max(4, len(self.p["c"])))  # what a step holds does not grow with the languages
        for lo in range(0, data.shape[1], lanes):
            part, own = data[:, lo : lo + lanes], owner[lo : lo + lanes]
            real = (part != 0).astype(np.float32)
            p = (self.position_probabilities(part) * real[:, None, :]).sum(0)
            np.add.at(out, own, p.T)
            np.add.at(size, own, real.sum(0))
        return out / np.maximum(size, 1)[:, None]


def fit(texts: list[str], langs: list[str]) -> tuple[list[str], ByteGru] | None:
    names = sorted(set(langs))
    rng, cols, y = np.random.default_rng(4), [], []
    for k, name in enumerate(names):
        data, _ = stretches([b for t, g in zip(texts, langs) if g == name and (b := letters(t).strip())])
        if data.shape[1]:
            at = rng.permutation(data.shape[1])[: min(TRAIN_STRETCHES, max(8, ALL_STRETCHES // len(names)))]
            cols.append(data[:, at])
            y += [k] * len(at)
    if not cols:
        return None
    model = ByteGru(len(names))
    if len(names) > 1:
        model.train(np.concatenate(cols, 1), np.array(y), steps=260 + 20 * max(0, len(names) - 8))
    return names, model


def training_rows(docs: DataFrame, id_col: str, text_col: str, lang_col: str, may_learn, rows: int = TRAIN_ROWS, total: int = TRAIN_TOTAL, chars: int = TRAIN_CHARS) -> list:
    """At most ``rows`` texts of each language, and with very many languages fewer of each so that all are about ``total``, by the order of a hash of the id; longer texts than ``chars`` code
    points are left out. No language is left out for its rank.

    The least hashes of each language are found in each partition before the shuffle, so a language that holds most rows sends no more than its share."""
    known = docs.select(F.col(id_col).cast("long").alias("lid"), F.col(lang_col).cast("string").alias("lang")).where("lid is not null and lang is not null").where(may_learn(F.col("lid")))
    names = known.select("lang").distinct().count()
    share = min(rows, max(1, total // max(1, names)))
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.xxhash64(F.lit("train"), "lid"), "lid"))
    ids = known.withColumn("k", rank).where(F.col("k") <= share).groupBy("lid").agg(F.min("lang").alias("y"))
    text = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"), F.col(lang_col).cast("string").alias("l")).where(F.length("t") <= chars)
    ids = F.broadcast(ids) if names <= total else ids  # ``total`` ids at most
    got = text.join(ids, (F.col("id") == F.col("lid")) & (F.col("l") == F.col("y"))).select("id", "t", "y")
    return sorted({r.id: (r.id, r.t, r.y) for r in got.orderBy(F.xxhash64("id"), "t").limit(2 * max(total, names)).collect()}.values())


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", may_learn=lambda c: F.lit(True), **bounds) -> DataFrame:
    """``id, lang_pred, score`` per row of ``docs``: the likeliest learned language of the text and its mean probability.

    ``und`` with score 0 stands for texts that are null, empty or have no letter, and for all where nothing could be learned. Rows with a null language or id are not
    learned from, but get a result. A very long text is read in whole, stretch by stretch; of equal probabilities the language that comes first counts. Repeated rows get equal results; an empty table gives an empty result; other columns play no part. The network is fitted on a bounded sample of rows (see :func:`training_rows`)."""
    rows = training_rows(docs, id_col, text_col, lang_col, may_learn, **bounds)
    shared = docs.sparkSession.sparkContext.broadcast(fit([t for _, t, _ in rows], [y for *_, y in rows]) if rows else None)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            names, scores = ["und"] * len(pdf), [0.0] * len(pdf)
            for lo in range(0, len(pdf), 256):  # bounds the memory of a step
                texts = [letters(t).strip() for t in pdf.t[lo : lo + 256]]
                if shared.value is None:
                    continue
                langs, model = shared.value
                p = model.pooled(texts)
                for k, best in enumerate(p.argmax(1)):
                    if texts[k]:
                        names[lo + k], scores[lo + k] = langs[best], float(min(1.0, p[k, best]))
            yield pd.DataFrame({"id": pdf.id.astype("Int64"), "lang_pred": names, "score": scores})

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t")).mapInPandas(run, "id long, lang_pred string, score double")


def op9_language_id(spark, sf_dir: str) -> DataFrame:
    found = identify(table(spark, sf_dir, "documents"), may_learn=lambda c: fold(c, 4) != 2)
    return found.select(F.col("id").alias("doc_id"), (fold(F.col("id"), 4) == 2).alias("held_out"), "lang_pred", "score")
