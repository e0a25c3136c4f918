"""Sets of word shingles: bucket keys that lose no pair of a Jaccard similarity, and exact links inside groups of candidates.

In any one order of all shingles, two sets of similarity ``t`` share a shingle among the first ``n - ceil(t n) + 1`` of each, so those prefixes are bucket keys
that lose no pair. The order puts shingles that are frequent in a sample last, which keeps buckets small and changes no result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import runs

#: The sample that says which shingles are frequent, and how many of them are held. They set an order only.
SAMPLE, FREQUENT = 3000, 200_000


def signature(s: np.ndarray) -> int:
    return int(np.array([xxhash.xxh64_intdigest(s.tobytes())], np.uint64).view(np.int64)[0])


def prefix(s: np.ndarray, threshold: float, late: np.ndarray) -> np.ndarray:
    """The first shingles of a sorted set, those of ``late`` (sorted) after all others."""
    n = len(s)
    m = n - int(np.ceil(threshold * n - 1e-9)) + 1 if n else 0
    if len(late) and n:
        at = np.minimum(np.searchsorted(late, s), len(late) - 1)
        known = late[at] == s
        s = np.concatenate([s[~known], s[known]])
    return s[:m]


def frequent(docs: DataFrame, text_col: str, hashes) -> np.ndarray:
    """Keys of the shingles that are frequent in a sample; ``hashes`` gives a text's shingles."""
    step = max(1, docs.count() // SAMPLE)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for t in pdf.t:
                yield pd.DataFrame({"k": np.unique(hashes(t)).view(np.int64)})

    some = docs.select(F.col(text_col).alias("t")).where(F.pmod(F.xxhash64(F.lit("sample"), "t"), F.lit(step)) == 0).distinct()
    top = some.mapInPandas(run, "k long").groupBy("k").count().where("count > 2").orderBy(F.desc("count"), "k").limit(FREQUENT).select("k")
    return np.sort(top.toPandas().k.to_numpy(np.int64).view(np.uint64))


def shared_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (k, sig) to those whose key has two rows or more, with a print of the bucket's members."""

    def shared(k: np.ndarray, s: np.ndarray) -> pa.RecordBatch:
        start = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        n = np.diff(np.concatenate([start, [len(k)]]))
        with np.errstate(over="ignore"):
            x = s.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            g = np.add.reduceat(x ^ (x >> np.uint64(32)), start)
        keep = np.repeat(n > 1, n)
        return pa.RecordBatch.from_arrays([pa.array(k[keep]), pa.array(s[keep]), pa.array(np.repeat(g, n)[keep].view(np.int64)), pa.array(np.repeat(n, n)[keep].astype(np.int64))], names=["k", "sig", "g", "n"])

    rest: list[tuple[np.ndarray, np.ndarray]] = []
    for b in batches:
        if not b.num_rows:
            continue
        k, s = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        if k[0] == k[-1] and (not rest or rest[0][0][0] == k[0]):
            rest.append((k, s))  # goes on with the open bucket
            continue
        at = int(np.searchsorted(k, k[-1]))
        yield shared(np.concatenate([*(r[0] for r in rest), k[:at]]), np.concatenate([*(r[1] for r in rest), s[:at]]))
        rest = [(k[at:], s[at:])]
    if rest:
        yield shared(np.concatenate([r[0] for r in rest]), np.concatenate([r[1] for r in rest]))


def linked(sets: list[np.ndarray], fps: np.ndarray, threshold: float, radius: int, side: np.ndarray | None = None) -> np.ndarray:
    """For each set the least index of its component over pairs whose similarity is ``threshold`` or above and whose fingerprints lie within ``radius`` bits. With ``side``
    only pairs of different sides are asked for. One pivot at a time meets all sets that are not yet linked to it, so a dense group costs a few pivots and not all its pairs."""
    m = len(sets)
    size = np.array([len(s) for s in sets])
    comp, todo = np.arange(m), np.ones(m, bool)
    while True:
        open_ = np.flatnonzero(todo)
        count = np.bincount(comp[open_], minlength=m)
        if (count > 0).sum() < 2:
            return comp
        p = open_[count[comp[open_]].argmin()]  # members of the largest component last: they may never be asked
        todo[p] = False
        far = todo & (comp != comp[p]) & (size >= threshold * size[p] - 1e-6) & (size[p] >= threshold * size - 1e-6)
        if side is not None:
            far &= side != side[p]
        at = np.flatnonzero(far)
        at = at[np.bitwise_count(fps[at] ^ fps[p]).sum(1) <= radius]
        both = np.array([len(np.intersect1d(sets[p], sets[k], assume_unique=True)) for k in at], np.int64)
        hit = at[both >= threshold * (size[at] + size[p] - both) - 1e-9]
        if len(hit):
            old = np.unique(np.append(comp[hit], comp[p]))
            comp[np.isin(comp, old)] = old[0]


def exact_linker(threshold: float, radius: int):
    """Rows (k, i, j, part, name, fp, data) in order of their group to links ``a, b`` of names."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in runs(batches, ["k", "i", "j"]):
            sets = [np.frombuffer(x, np.uint64) for x in pdf.data]
            fps = np.frombuffer(b"".join(pdf.fp), np.uint64).reshape(len(pdf), -1)
            c = linked(sets, fps, threshold, radius, pdf.part.to_numpy() if pdf.i.iloc[0] != pdf.j.iloc[0] else None)
            at, name = np.flatnonzero(c != np.arange(len(c))), pdf.name.to_numpy()
            if len(at):
                yield pd.DataFrame({"a": name[at], "b": name[c[at]]})
    return run
