"""Line, SimHash and benchmark operators against plain Python on small tables."""

import hashlib
import random

import numpy as np
import xxhash

from gridloom.llm import decontaminate as dc
from gridloom.llm import line_dedup as ld
from gridloom.llm import simhash_dedup as sd
from gridloom.llm.common import connected_components

DOCS = "doc_id long, text string, id string, h int, t string"


def frame(spark, rows):
    """Documents with other columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], DOCS)


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(60)] + [(rng.randrange(100, 400), rng.randrange(100, 400)) for _ in range(200)] + [(5, 5), (None, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    assert got == {x: find(x) for x in parent}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_lines(rows):
    ws = " \t\n\x0b\x0c\r"
    lower = str.maketrans(ld.ascii_lower.__globals__["UPPER"], ld.ascii_lower.__globals__["UPPER"].lower())
    holders = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            k = line.strip(ws).translate(lower)
            if len(k) >= 20:
                holders.setdefault(k, set()).add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        keep = []
        for x in lines:
            h = holders.get(x.strip(ws).translate(lower), ())
            top = max((y for y in h if y is not None), default=None)
            if len(h) < 3 or i == top:
                keep.append(x)
        out.append((i, len(lines), len(lines) - len(keep), "\n".join(keep)))
    return sorted(out, key=str)


def test_line_dedup(spark):
    hot = "a very frequent line of some length"
    rows = [(i, f"own line number {i} with length\n  {hot.upper()}\t\nshort\n{hot}") for i in range(400)]
    rows += [(900, None), (901, ""), (902, hot), (902, hot), (None, hot + "\nx"), (903, "twice twice twice twice\ntwice twice twice twice"), (904, "twice twice twice twice"), (905, "Ünïcode line that is shared by all\n")]
    rows += [(906 + i, "Ünïcode line that is shared by all") for i in range(4)] + [(907, "same id, other text\n" + hot)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")  # runs that reach over batches
    try:
        got = ld.dedup_lines(frame(spark, rows)).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(((r.id, r.n_lines, r.n_gone, r.kept) for r in got), key=str) == brute_lines(rows)
    assert ld.dedup_lines(frame(spark, [])).count() == 0


def test_bit_planes():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 64, dtype=np.uint64)
    q = base[5]
    for radius in (1, 2, 3, 5):
        near = np.array([int(q) ^ sum(1 << int(b) for b in rng.choice(64, i % 8, replace=False)) for i in range(64)], np.uint64)
        planes = sd.bit_planes(near.reshape(1, 64, 1))
        live, mask = sd.within(planes, np.zeros(1, np.int64), np.array([[q]]), radius)
        want = [bin(int(x) ^ int(q)).count("1") <= radius for x in near]
        assert len(live) == 1 and [bool(int(mask[0]) >> i & 1) for i in range(64)] == want
    live, _ = sd.within(sd.bit_planes(~np.full((1, 64, 1), q)), np.zeros(1, np.int64), np.array([[q]]), 2)
    assert len(live) == 0


def brute_simhash(text, size=3):
    w = [x for x in dc.re.split("[\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if x]
    sh = [" ".join(w[i : i + size]) for i in range(max(len(w) - size + 1, min(1, len(w))))]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_simhash(spark):
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(300)] + ["Éa", "ZZ"]
    rows = []
    for g in range(30):
        base = [rng.choice(vocab) for _ in range(120)]
        for c in range(6):
            w = list(base)
            for _ in range(c % 3):
                w[rng.randrange(120)] = rng.choice(vocab)
            rows.append((len(rows), " ".join(w)))
    rows += [(500, None), (501, ""), (502, "one"), (503, "one TWO"), (504, "One two"), (None, rows[0][1]), (3, rows[3][1]), (505, " \n\t ")]
    fps = [brute_simhash(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if bin(fps[a] ^ fps[b]).count("1") <= 2:
                parent[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    want = sorted(((i, f, least.get(find(k))) for k, ((i, _), f) in enumerate(zip(rows, fps))), key=str)
    got = sd.near_duplicates(frame(spark, rows)).collect()
    assert sorted(((r.id, r.fp % 2**64, r.component_id) for r in got), key=str) == want
    assert sd.near_duplicates(frame(spark, [])).count() == 0


def test_large_bucket_is_tiled(spark):
    """All pairs of a bucket meet, also when it is cut into tiles."""
    fps = spark.createDataFrame([(1 << i | 1 << j | 1 << 60,) for i in range(12) for j in range(i)] + [(1 << 60,)], "fp long")
    links = sd.fingerprint_links(fps, 2, tile=7)
    comp = connected_components(links).collect()
    assert len(comp) == 67 and len({r.component for r in comp}) == 1


def test_decontaminate(spark):
    item = "Alpha beta, gamma delta epsilon zeta eta theta iota kappa lambda mu"
    bench = spark.createDataFrame([(1, item), (2, "Short item!"), (2, "Short item!"), (3, None), (4, "..."), (None, "no id here")], "item_id long, text string")
    body = "x " * 30
    rows = [(1, body + item.upper() + " tail"), (2, "short-ITEM éshort item short"), (3, None), (4, ""), (5, "alpha beta gamma delta epsilon zeta eta theta iota"), (6, "no id here"), (6, "no id here"), (None, "a short item")]
    for block_words, segment in ((1000, 20_000), (5, 20_000), (5, 1)):  # one automaton, several, items cut into segments
        got = {(r.id, r.t): r for r in dc.contamination(frame(spark, rows), bench, block_words=block_words, segment=segment, with_text=True).collect()}
        r = got[rows[0]]
        assert (r.n_words, r.hit_from, r.hit_to, r["items"]) == (43, [30], [42], [1])
        assert [(a, b) for a, b in zip(got[rows[1]].hit_from, got[rows[1]].hit_to)] == [(0, 2)]
        assert got[(3, None)].n_words == 0 and got[(4, "")].hit_from == []
        assert got[rows[4]].hit_from == []
        assert got[(6, "no id here")]["items"] == [] and got[(6, "no id here")].hit_to == [3]
        assert got[(None, "a short item")]["items"] == [2]
    spans = dc.contaminated_spans(frame(spark, rows), bench).where("id = 1").first()
    assert spans.text == item.upper() and rows[0][1][spans.start : spans.end] == item.upper()
    assert "t" not in dc.contamination(frame(spark, rows), bench, block_words=5).columns
    assert dc.contamination(frame(spark, []), bench).count() == 0
    assert dc.contamination(frame(spark, rows), bench.limit(0)).where("size(hit_from) > 0").count() == 0


def test_sha(spark):
    got = ld.op8_line_dedup(spark, "/root/testdata/sf0.001").where("doc_id = 0").first()
    assert len(got.kept_sha256) == 64 and got.n_lines >= 1
    assert hashlib.sha256(b"").hexdigest() != got.kept_sha256
