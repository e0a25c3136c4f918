"""PII, mixing and sharding against plain Python and their own laws on small tables."""

import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import xxhash
from pyspark.sql import functions as F

from gridloom.llm import mixing, pii, sharding

DOCS = "doc_id long, text string, source string, id int, h int, size string, s string, slot int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, s, 1, 2, "x", "y", 3) for i, t, s in rows], DOCS)


def luhn(m):
    d = [int(c) for c in m if c.isdigit()][::-1]
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(d)) % 10 == 0


def brute_pii(text):
    text = text or ""
    n = lambda m: sum(c.isdigit() for c in m)
    rules = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= n(m) <= 19 and luhn(m)),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= n(m) <= 15),
    ]
    return [(k, m.start(), m.end()) for k, p, ok in rules for m in re.finditer(p, text) if ok(m.group())]


def test_pii(spark):
    rng = random.Random(2)
    alphabet = "ab1290.@-+ (%_é\n5"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 160))) for _ in range(400)]
    texts += ["".join(rng.choice("0123456789 -+.") for _ in range(rng.randrange(1, 90))) for _ in range(300)]
    texts += [None, "", "x@y.zz_foo@bar.com a@b.co@c.d", "4111 1111 1111 1111 é 4111-1111-1111-1112", "ip 256.1.1.1.2.3.4 and 010.0.0.255", "+1 (456) 555-2186",
              "1 " * 30_000, "a." * 30_000 + "@" + "b." * 30_000 + "c", "1.2." * 20_000, "9" * 50_000, "+" + "1(" * 30_000 + "2"]
    rows = [(i, t, None) for i, t in enumerate(texts)] + [(None, "a@b.cd", None), (1, texts[1], "x")]
    got = pii.find_spans(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    text_of = {i: t for i, t, _ in rows}
    for r in got:
        assert [(x.kind, x.start, x.end) for k in pii.BASE_KINDS for x in r[k]] == brute_pii(text_of[r.id]), text_of[r.id]
    assert pii.find_spans(frame(spark, [])).count() == 0


def test_pii_added_kinds_and_redaction(spark):
    rows = [(1, "iban GB82 WEST 1234 5698 7654 32 ok", None), (2, "GB82 WEST 1234 5698 7654 33", None), (3, "call (456) 555-2186 now", None), (4, "nothing 456-555-2186", None),
            (5, "my ssn is 123-45-6789", None), (6, "é a@b.cd, then c@d.ef", None), (7, None, None), (8, "BE68 5390 0754 7034 OK", None), (9, "123-45-6789 es mi seguridad social", None), (10, "456-555-2186, bitte anrufen: Telefon", None)]
    got = {r.id: r for r in pii.find_spans(frame(spark, rows)).collect()}
    assert [(x.start, x.end) for x in got[1].iban] == [(5, 32)] and got[2].iban == [] and [(x.start, x.end) for x in got[8].iban] == [(0, 19)]
    assert len(got[3].local_phone) == 1 and got[4].local_phone == [] and len(got[5].ssn) == 1 == len(got[9].ssn) == len(got[10].local_phone)
    red = {r.doc_id: r.text for r in pii.redact(frame(spark, rows)).collect()}
    assert red[6] == "é [EMAIL], then [EMAIL]" and red[7] is None and red[8] == "[IBAN] OK" and red[5] == "my ssn is [SSN]" and red[4] == rows[3][1]


def test_pii_of_long_lists_takes_linear_time(spark):
    took = {}
    for n in (1, 4):
        texts = [("1.2.3.4 " * (n * 32_768))[:-1], "ab@cd.ef " * (n * 29_000), "4111 1111 1111 1111, " * (n * 9_000)]
        df = frame(spark, [(i, t, None) for i, t in enumerate(texts)]).coalesce(1)
        began = time.perf_counter()
        got = {r.id: r for r in pii.find_spans(df).select("id", *[F.size(k).alias(k) for k in pii.BASE_KINDS], F.try_element_at("ip", F.lit(-1)).alias("x")).collect()}
        took[n] = time.perf_counter() - began
        assert (got[0].ip, got[1].email, got[2].card) == (n * 32_768, n * 29_000, n * 9_000) and got[0].x.end == len(texts[0])
    assert took[4] < 60 and took[4] < 8 * took[1]


def brute_targets(sizes):
    """Shares by weight; what is above three times a size goes to the others, again and again."""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, free, out = float(sum(sizes.values())), list(order), {}
    while free:
        unit = left / sum(w[s] for s in free)
        over = [s for s in free if unit * w[s] > 3 * sizes[s]]
        if not over:
            return out | {s: unit * w[s] for s in free}
        for s in over:
            out[s] = 3.0 * sizes[s]
            left -= out[s]
            free.remove(s)
    return out


def mix_rows():
    rng = random.Random(9)
    rows = []
    for k in range(400):
        s = rng.choice(["hot"] * 6 + ["a", "b", "ü", None])
        rows.append((k, " ".join("w%d" % rng.randrange(50) for _ in range(rng.randrange(0, 60))), s))
    rows += [(1000, "tiny source", "z"), (1001, None, "z"), (1002, " \n ", "empty"), (None, "no id", "a"), (5, rows[5][1], rows[5][2]), (1003, "w " * 5000, "b")]
    return rows


def test_permutation(spark):
    for n in (1, 2, 7, 100, 513):
        got = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(3)).alias("p")).collect()
        assert sorted(r.p for r in got) == list(range(n))
    assert [r.p for r in got] != list(range(n))


def test_mix_counts(spark):
    rows = mix_rows()
    size = lambda t: len((t or "").split())
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += size(t)
    want = brute_targets(dict(sizes))
    df = frame(spark, rows)
    for block in (16, 512):
        got = mixing.mix_counts(df, block=block).collect()
        assert Counter((r.id, r.size) for r in got) == Counter((i, size(t)) for i, t, _ in rows)
        by = defaultdict(int)
        for r in got:
            assert 0 <= r.taken <= 3 * r.size
        source = {i: s for i, _, s in rows}
        for r in got:
            by[source.get(r.id)] += r.taken if r.id is not None else 0
            assert math.isclose(r.target, want[source[r.id]] if r.id is not None else want["a"], rel_tol=1e-9, abs_tol=1e-9)
        for s in sizes:
            assert abs(by[s] - want[s]) <= 7, (s, by[s], want[s])  # 7: words of the row with no id
        again = mixing.mix_counts(df.repartition(7), block=block).collect()
        assert Counter(map(str, got)) == Counter(map(str, again))
    assert mixing.mix_counts(frame(spark, [])).count() == 0


def spark_hash(*values):
    """xxhash64 of Spark: (value, bytes of a number) or strings, chained by seed; null leaves the hash as it is."""
    h = 42
    for v in values:
        if v is None or (isinstance(v, tuple) and v[0] is None):
            continue
        h = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else v[0].to_bytes(v[1], "little", signed=True), h)
    return h - (1 << 64) if h >> 63 else h


def brute_permuted(i, n, s, pas, seed):
    for r in range(1, mixing.ROUNDS + 1):
        key = [(seed, 4), (s, 8), (pas, 8), (r, 4)]
        other = (spark_hash(*key) % n - i) % n
        i = other if spark_hash(*key, (max(i, other), 8), "bit") & 1 else i
    return i


def brute_mix(rows, block, shard_slots, seed=7):
    """Per row: words taken and its shards; per shard and slot of a source: the words shown."""
    size = [len((t or "").split()) for _, t, _ in rows]
    sizes = Counter()
    for (_, _, s), n in zip(rows, size):
        sizes[s] += n
    target = brute_targets(dict(sizes))
    names = sorted(x for x in sizes if x is not None) + [None] * (None in sizes)
    plan = {}
    for s, name in enumerate(names):
        goal = min(math.floor(target[name] + 0.5), 3 * sizes[name])
        passes, rest = divmod(goal, max(1, sizes[name]))
        blocks = -(-sizes[name] // block)
        plan[s] = dict(passes=passes, rest=rest, blocks=blocks, whole=sizes[name] // block, slots=passes * blocks + -(-rest // block), size=sizes[name])
    total = sum(p["slots"] for p in plan.values())
    counts = defaultdict(Counter)
    for k in range(total):
        u, s = spark_hash((seed, 4), "draw", (k, 8)) % total, 0
        while u >= plan[s]["slots"]:
            u, s = u - plan[s]["slots"], s + 1
        counts[s][k // shard_slots] += 1
    stream = {s: [] for s in plan}
    for k in sorted(range(len(rows)), key=lambda k: spark_hash("order", (rows[k][0], 8), rows[k][1])):
        stream[names.index(rows[k][2])] += [(k, i) for i in range(size[k])]
    taken, shards, shown = Counter(), defaultdict(set), {}
    for s, p in plan.items():
        drawn, before, ranges = sum(counts[s].values()), 0, []
        for shard in sorted(counts[s], key=lambda x: spark_hash("shard", (x, 8))):
            after = before + counts[s][shard]
            ranges.append((shard, math.floor(before / drawn * p["slots"]), math.floor(after / drawn * p["slots"])))
            before = after
        for shard, lo, hi in ranges or [(0, 0, p["slots"])]:
            for k in range(lo, hi):
                pas, i = divmod(k, p["blocks"])
                at = brute_permuted(i, p["whole"], s, pas, seed) if i < p["whole"] else i
                length = block if i < p["whole"] else p["size"] - p["whole"] * block
                take = length if pas < p["passes"] else min(length, p["rest"] - i * block)
                words = stream[s][at * block : at * block + take]
                shown[s, k] = (shard, words)
                for row, _ in words:
                    taken[row] += 1
                    shards[row].add(shard)
    return taken, shards, shown, names


def test_mix_against_brute_force(spark, monkeypatch):
    rows = mix_rows()
    size = [len((t or "").split()) for _, t, _ in rows]
    same = Counter((i, t) for i, t, _ in rows)
    for block, shard_slots in ((16, 32), (40, 7)):
        taken, shards, shown, names = brute_mix(rows, block, shard_slots)
        want = Counter((rows[k][0], size[k], taken[k], tuple(sorted(shards[k]))) for k in range(len(rows)) if same[rows[k][:2]] == 1)
        got = mixing.mix_counts(frame(spark, rows), block=block, shard_slots=shard_slots).collect()
        assert want == Counter((r.id, r.size, r.taken, tuple(r.shards)) for r in got if r.id != 5 or r.size != size[5])
        assert sum(r.taken for r in got) == sum(taken.values())
        blocks = mixing.mix_blocks(frame(spark, rows), block=block, shard_slots=shard_slots).collect()
        text = lambda w: " ".join((rows[k][1] or "").split()[i] for k, i in w)
        assert Counter((r.shard, r.source, r.text) for r in blocks) == Counter((sh, names[s], text(w)) for (s, _), (sh, w) in shown.items())
        slots = defaultdict(list)
        for r in blocks:
            slots[r.shard].append(r.slot)
        assert all(sorted(v) == list(range(len(v))) for v in slots.values())
        expected = len(blocks) / len(slots)
        assert len(slots) > 5 and all(0.2 * expected < len(v) < 2 * expected for k, v in slots.items() if k < max(slots))
    monkeypatch.setattr(mixing, "draw_counts", lambda t, *a: t.where("slots > 0").select("s", F.lit(0).cast("long").alias("shard"), F.col("slots").alias("n")))
    undrawn = mixing.mix_counts(frame(spark, rows), block=block, shard_slots=shard_slots).collect()
    assert Counter(map(str, undrawn)) != Counter(map(str, got)) and {x for r in undrawn for x in r.shards} == {0}


def test_mix_documents(spark):
    rows = mix_rows()
    got = mixing.mix_documents(frame(spark, rows), block=16).collect()
    text = {i: t for i, t, _ in rows}
    shown, by_id = Counter(), Counter()
    for r in got:
        words, own = r.text.split(), Counter((text[r.doc_id] or "").split())
        assert words and not Counter(words) - own and r.size == "x" and r.id == 1
        shown[r.source] += len(words)
        by_id[r.doc_id] += len(words)
    sizes, taken = Counter(), Counter()
    for i, t, s in rows:
        sizes[s] += len((t or "").split())
    for s, w in brute_targets(dict(sizes)).items():
        assert abs(shown[s] - w) <= 1
    for r in mixing.mix_counts(frame(spark, rows), block=16).collect():
        taken[r.id] += r.taken
    assert +taken == by_id
    assert mixing.mix_documents(frame(spark, [])).count() == 0 == mixing.mix_blocks(frame(spark, [])).count()
    odd = [(1, "a b", "s"), (1, "a b", "s"), (1, "a b", "s"), (None, None, None), (None, None, None)]
    assert Counter(r.text for r in mixing.mix_documents(frame(spark, odd)).collect()) == Counter({"a b": 3})


def test_shards(spark):
    rng = random.Random(4)
    rows = [(k, "é" * rng.randrange(1, 400) + "\n" * rng.randrange(4) + str(k), None) for k in range(3000)]
    rows += [(5000 + k, "the same text again and again " * 4, None) for k in range(1500)]  # a group above a shard's size
    rows += [(7000 + k, rows[k % 40][1], None) for k in range(120)] + [(None, "x", None), (1, rows[1][1], None), (9000, None, None), (9001, "", None)]
    got = sharding.shard_documents(frame(spark, rows), 24).collect()
    assert len(got) == len(rows)
    text = {i: t or "" for i, t, _ in rows}
    by = defaultdict(list)
    for r in got:
        t = text.get(r.id, "")
        assert r.size == len(t.encode()) + 8 and r.text_crc32 == zlib.crc32(t.encode())
        by[r.shard].append(r)
    assert sorted(by) == list(range(24))
    for rs in by.values():
        assert sorted(r.slot for r in rs) == list(range(len(rs)))
    load = [sum(r.size for r in rs) for rs in by.values()]
    assert max(load) < 1.1 * sum(load) / 24 and min(load) > 0.9 * sum(load) / 24
    place = defaultdict(set)
    for r in got:
        place[text.get(r.id, "")].add(r.shard)
    assert all(len(v) == 1 for t, v in place.items() if not t.startswith("the same"))
    assert sharding.shard_documents(frame(spark, []), 24).count() == 0
    assert sharding.shard_documents(frame(spark, rows[:2]), 24).count() == 2
    assert {r.shard for r in sharding.shard_documents(frame(spark, rows), None, target_bytes=200_000).collect()} == set(range(math.ceil(sum(load) / 200_000)))


def brute_shards(rows, leaves):
    """A plain k-d tree over the same coordinates."""
    texts = [t or "" for _, t, _ in rows]
    size = [len(t.encode()) + 8 for t in texts]
    log2 = lambda x: math.log(x) / math.log(2)
    dims = [[log2(n) for n in size], [len(t.encode()) / max(1, len(t)) for t in texts], [log2(len(t) / (t.count("\n") + 1) + 1) for t in texts]]
    u = lambda h: h % (1 << 64)
    group = [u(spark_hash(t, "group")) >> 64 - sharding._GROUP for t in texts]
    row = [u(spark_hash((i, 8), t)) >> 64 - sharding._ROW for (i, _, _), t in zip(rows, texts)]
    cells = 1 << sharding._DIM
    keys = []
    for x in dims:
        lo, hi = min(x), max(x)
        keys.append([(min(int((v - lo) / (hi - lo) * cells), cells - 1) if hi > lo else 0, g, r) for v, g, r in zip(x, group, row)])
    out = [0] * len(rows)

    def cut(at, first, n):
        if n == 1 or not at:
            for k in at:
                out[k] = first
            return
        span = [max(d[k][0] for k in at) - min(d[k][0] for k in at) for d in keys]
        d = keys[span.index(max(span))]
        w = sum(size[k] for k in at)
        goal, leaf, seen = w * (n // 2) / n, w / n, 0
        order = sorted(at, key=lambda k: d[k])
        for k in order:  # the last row with no more than the goal before it
            if seen > goal:
                break
            last, seen = k, seen + size[k]
        mine = [k for k in order if d[k][:2] == d[last][:2]]
        a = sum(size[k] for k in order if d[k][:2] < d[last][:2])
        b = a + sum(size[k] for k in mine)
        if min(goal - a, b - goal) <= sharding.GROUP_TOLERANCE * leaf or d[mine[0]] == d[mine[-1]]:
            left = [k for k in order if d[k][:2] < d[last][:2] or (d[k][:2] == d[last][:2] and not goal - a < b - goal)]
        else:
            left = [k for k in order if d[k] <= d[last]]
        rest = set(at) - set(left)
        cut(left, first, n // 2)
        cut(sorted(rest), first + n // 2, n - n // 2)

    cut(list(range(len(rows))), 0, leaves)
    return out


def test_shards_against_a_plain_tree(spark):
    rng = random.Random(8)
    rows = [(k, "é" * rng.randrange(60) + "ab" * rng.randrange(1, 300) + "\n" * rng.randrange(9) + str(k), None) for k in range(500)]
    rows += [(600 + k, "the same text again and again " * 9, None) for k in range(200)] + [(900, None, None), (901, "", None)]
    for leaves in (5, 24):
        got = {r.id: r["shard"] for r in sharding.shard_documents(frame(spark, rows), leaves).collect()}
        assert [got[i] for i, _, _ in rows] == brute_shards(rows, leaves)
    assert sharding.shard_documents(frame(spark, rows[:3]), 70_000).count() == 3  # any number of leaves


def test_shards_of_one_row_many_times(spark):
    """Half of all rows are one row, id and text; a null row repeats too. The law holds, and every shard is used."""
    rng = random.Random(12)
    rows = [(k, "x" * rng.randrange(100, 400) + str(k), None) for k in range(3000)] + [(77_777, "the row that repeats " * 12, None)] * 3000 + [(None, None, None)] * 40
    got = sharding.shard_documents(frame(spark, rows), 24).collect()
    assert Counter(r.id for r in got) == Counter(i for i, *_ in rows)
    load, slots = Counter(), defaultdict(list)
    for r in got:
        load[r.shard] += r.size
        slots[r.shard].append(r.slot)
    mean = sum(load.values()) / 24
    assert sorted(load) == list(range(24)) and max(load.values()) < 1.1 * mean and min(load.values()) > 0.9 * mean
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
