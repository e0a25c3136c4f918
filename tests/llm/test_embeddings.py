"""Embedding near-duplicates against all pairs."""

import numpy as np
import pytest

from gridloom.llm import embedding_dedup as ed

ROWS = "vec_id long, embedding array<double>, label int, id string, vec int, size int, h int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, g, "x", 1, 2, 3) for i, v, g in rows], ROWS)


def brute(rows):
    ok = [k for k, (_, v, g) in enumerate(rows) if g is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    parent, n = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for key in {(rows[k][2], len(rows[k][1])) for k in ok}:
        at = [k for k in ok if (rows[k][2], len(rows[k][1])) == key]
        x = np.array([rows[k][1] for k in at])
        x = x / np.abs(x).max(1, keepdims=True)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        for a, b in zip(*np.nonzero(x @ x.T >= 0.98)):
            if a != b:
                n[at[a]] += 1
                parent[find(at[a])] = find(at[b])
    low = {}
    for k, (i, *_) in enumerate(rows):
        if i is not None:
            low[find(k)] = min(i, low.get(find(k), i))
    return [(i, n[k], low.get(find(k)), i is not None and i == low.get(find(k))) for k, (i, *_) in enumerate(rows)]


def planted(rng, n, dim, label, start):
    base = rng.normal(size=(n, dim))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    for k in range(0, n - 8, 9):  # families of near copies
        for j in range(k % 5):
            v = base[k] + rng.normal(size=dim) * 0.12 / np.sqrt(dim)
            base[k + 1 + j] = v
    return [(start + k, v.tolist(), label) for k, v in enumerate(base)]


def test_small_and_odd_rows(spark):
    rng = np.random.default_rng(3)
    rows = planted(rng, 120, 16, 0, 0) + planted(rng, 60, 16, 1, 1000)
    rows += [(5000 + k, rows[3][1], 0) for k in range(4)] + [(6000, rows[3][1], None), (6001, None, 0), (6002, [], 0), (6003, [0.0] * 16, 0), (6004, [float("nan")] * 16, 0),
             (6005, [None] * 16, 0), (6006, [float("inf")] * 16, 0), (None, rows[3][1], 0), (6007, rows[3][1][:8], 0), (6008, [x * 1e300 for x in rows[3][1]], 0), (3, rows[3][1], 0), (None, None, None)]
    got = ed.near_duplicate_vectors(frame(spark, rows)).collect()
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, brute(rows)))
    assert ed.near_duplicate_vectors(frame(spark, [])).count() == 0


def test_graph_search_recall():
    """The graph alone, from the medoid: nearly all vectors find their own vertex and their links."""
    rng = np.random.default_rng(1)
    x = np.array([v for _, v, _ in planted(rng, 1500, 64, 0, 0)])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    g = ed.build_graph(x, 1)
    f = x.astype(np.float32)
    assert (ed.greedy(f, g, ed.medoid(x), f, ed.BEAM)[0] == np.arange(len(x))[:, None]).any(1).mean() >= 0.99
    found = ed.search(x, g, x, 0.98, True)
    true = x @ x.T >= 0.98
    assert not (found & ~true).any() and (found & true).sum() >= 0.98 * true.sum() > len(x)
    for n in (1, 2, 3, 30):
        assert ed.search(x[:n], ed.build_graph(x[:n], 1), x[:n], 0.98, True).diagonal().all()


@pytest.mark.parametrize("parts", [False, True])
def test_overlapping_shards_and_parts(spark, monkeypatch, parts):
    """A dense group lies over several parts of its shard, which search each other."""
    rng = np.random.default_rng(7)
    rows = planted(rng, 2500, 32, 0, 0)
    dense = rng.normal(size=32)
    rows += [(10_000 + k, (dense + rng.normal(size=32) * 0.05).tolist(), 0) for k in range(300)]
    monkeypatch.setattr(ed, "TARGET", 400)
    if parts:
        monkeypatch.setattr(ed, "PART", 200)
    report = {}
    want, got = {r[0]: r for r in brute(rows)}, {r.id: r for r in ed.near_duplicate_vectors(frame(spark, rows), report=report).collect()}
    assert len(got) == len(rows) and report["recall"] >= ed.RECALL and report["audited"] >= ed.AUDIT_LINKED
    assert sum(r.n_links for r in got.values()) >= 0.97 * sum(r[1] for r in want.values())
    assert all(got[i].n_links <= want[i][1] for i in want)
    assert sum(got[i].component_id == want[i][2] for i in want) >= 0.98 * len(rows)


def test_one_large_label(spark):
    """20,000 vectors of one label, in many shards: recall measured over all links, by query."""
    rng = np.random.default_rng(11)
    rows = planted(rng, 20_000, 32, 0, 0)
    report = {}
    got = {r.id: r.n_links for r in ed.near_duplicate_vectors(frame(spark, rows), report=report).select("id", "n_links").collect()}
    x = np.array([v for _, v, _ in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    true = np.concatenate([(x[i : i + 1000] @ x.T >= 0.98).sum(1) - 1 for i in range(0, len(x), 1000)])
    found = np.array([got[i] for i, *_ in rows])
    assert (found <= true).all() and (found[true > 0] / true[true > 0]).mean() >= 0.95
    print(f"recall {(found[true > 0] / true[true > 0]).mean():.4f}, {report}")
    assert report["recall"] >= 0.95 and report["overlap"] is not None


def test_low_recall_is_never_returned(spark, monkeypatch):
    """If the widest overlap still misses links, all pairs are compared."""
    rows = planted(np.random.default_rng(4), 150, 16, 0, 0)
    real = ed._links
    monkeypatch.setattr(ed, "_links", lambda *a, **k: real(*a, **k) if k.get("exact") else real(*a, **k).where("false"))
    report = {}
    got = ed.near_duplicate_vectors(frame(spark, rows), overlap=24, report=report).collect()
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, brute(rows))) and report["overlap"] is None
