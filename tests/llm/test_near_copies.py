"""The pipeline's near-copy stage against all pairs by Jaccard similarity of five words."""

import random

import numpy as np

from corpus_pipeline import STAGES
from gridloom.llm import shingle_sets as ss
from gridloom.llm import simhash_dedup as sd


def shingles(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def survivors(rows):
    sets, parent = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) > 0:
                parent[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min(i, least.get(find(k), i))
    return sorted(least.values())


def made(rng):
    word = lambda: f"w{rng.randrange(3000)}"
    passage = [word() for _ in range(40)]
    texts = [None, "", " ", "two words", "TWO words", "one"]
    for _ in range(60):
        base = [word() for _ in range(rng.choice([6, 30, 80, 400]))] + (passage if rng.random() < 0.5 else [])
        texts.append(" ".join(base))
        for edits in (1, 2, 3, 6):  # similarities on both sides of 0.8
            w = list(base)
            for _ in range(edits):
                w[rng.randrange(len(w))] = word()
            texts.append(" ".join(w))
    dense = [word() for _ in range(60)]
    texts += [" ".join([*dense[:k], word(), *dense[k + 1 :]]) for k in range(60)]  # two edits apart from each other
    texts += ["same line of a log file " * n for n in (3, 50)]
    return texts


def test_stage_drops_all_near_copies(spark, monkeypatch):
    rng = random.Random(5)
    rows = list(enumerate(made(rng)))
    rng.shuffle(rows)
    want = survivors(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in STAGES[1][1](spark, docs, None).collect()) == want
    monkeypatch.setattr(sd.set_components, "__defaults__", (7, 7))  # tiles
    assert sorted(r.doc_id for r in sd.drop_near_copies(docs.repartition(9)).collect()) == want
    assert sd.drop_near_copies(docs.where("doc_id < 0")).count() == 0


def test_stage_on_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert sorted(r.doc_id for r in STAGES[1][1](spark, docs, None).collect()) == survivors([(r.doc_id, r.text) for r in docs.collect()])


def test_threshold_is_met_exactly():
    a = np.arange(10, dtype=np.uint64)
    near = np.zeros((3, 4), np.uint64)
    assert ss.linked([a, a[:8], a[:7]], near, 0.8, 90).tolist() == [0, 0, 0]  # 0.8; 7 of 8
    assert ss.linked([a, a[:7]], near[:2], 0.8, 90).tolist() == [0, 1]


def test_radius_loses_no_pair_and_parts_others():
    rng, radius = np.random.default_rng(2), sd.similarity_radius(0.8)
    distance = lambda a, b: int(np.bitwise_count(sd.fingerprint(a, 4) ^ sd.fingerprint(b, 4)).sum())
    for n in (5, 6, 8, 10, 33, 100, 1000):
        for _ in range(60):
            x = rng.integers(0, 1 << 63, 2 * n).astype(np.uint64)
            m = int(np.ceil(0.8 * n))  # a subset; and two sets of one size
            k = int(np.ceil(8 * n / 9))
            assert distance(x[:n], x[:m]) <= radius and distance(x[:n], np.concatenate([x[:k], x[n : 2 * n - k]])) <= radius
    assert all(distance(*(rng.integers(0, 1 << 63, 200).astype(np.uint64) for _ in range(2))) > radius for _ in range(300))


def test_fingerprint_words():
    h = np.random.default_rng(1).integers(0, 1 << 63, 70_000).astype(np.uint64)
    votes = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    assert sd.fingerprint(h, 4)[0] == sd.fingerprint(h)[0] == np.packbits(2 * votes > len(h), bitorder="little").view(np.uint64)[0]
