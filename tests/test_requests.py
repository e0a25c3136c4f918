"""Identities of requests, and the reuse of their results in batch and on a stream."""

import json
import random

import pytest
from pyspark.sql import functions as F

from gridloom.functions.canonical import canonical_json, json_identity
from gridloom.operators.requests import HOUR, reuse


def _plain(rows, span):
    """(id, served, run) by a fold in order."""
    last, out = {}, []
    for key, t, i, ok in sorted(rows, key=lambda r: (r[1], r[2])):
        known = last.get(key)
        served = bool(known and known[2] and t <= known[0] + span)
        if not served:
            last[key] = (t, i, ok)
        out.append((i, served, last[key][1]))
    return sorted(out)


def _log(spark, rows):
    return spark.createDataFrame(rows, "key string, t long, id long, ok boolean").select("key", F.timestamp_micros("t").alias("ts"), "id", "ok")


@pytest.fixture
def store(spark, tmp_path):
    def write(d, name):
        path = str(tmp_path / name)
        d.write.parquet(path)
        return spark.read.schema(d.schema).parquet(path)

    return write


def _rows(seed, n=900):
    rnd = random.Random(seed)
    # a key with a third of all requests, ties of time, distances of exactly 24 hours, quiet weeks
    at = lambda: rnd.choice([rnd.randrange(40 * 24) * HOUR, rnd.randrange(5 * 24 * 4) * HOUR // 4, rnd.randrange(300) * 24 * HOUR])
    return [(rnd.choice(["hot", f"k{rnd.randrange(30)}", f"k{rnd.randrange(30)}"]), at(), i, rnd.random() > 0.15) for i in range(n)]


def test_canonical_json(spark):
    def shuffled(v, rnd):
        if isinstance(v, dict):
            items = list(v.items())
            rnd.shuffle(items)
            return {k: shuffled(x, rnd) for k, x in items}
        return [shuffled(x, rnd) for x in v] if isinstance(v, list) else v

    rnd = random.Random(5)
    values = [{"b": {"z": [1, {"y": None, "x": [True, {"q": 1.5, "p": "é\n\"/"}]}], "a": {}}, "": [], "Z": -3, "aa": "x", "ü": 0.25}, [{"b": 1, "a": 2}, "text", None], {"deep": {"deep": {"deep": {"b": 1, "a": [{"d": 1, "c": 2}]}}}}]
    rows = [(n, json.dumps(shuffled(v, rnd), indent=rnd.choice([None, 2]), ensure_ascii=rnd.random() < 0.5)) for n, v in enumerate(values) for _ in range(6)]
    got = spark.createDataFrame(rows, "n int, j string").select("n", canonical_json(F.col("j")).alias("c"), json_identity(F.col("j"), "aoi_").alias("i")).distinct().collect()
    assert len(got) == len(values) and all(len(r.i) == 20 for r in got)
    assert {r.n: r.c for r in got} == {n: json.dumps(v, sort_keys=True, separators=(",", ":"), ensure_ascii=False) for n, v in enumerate(values)}
    odd = spark.createDataFrame([('{"a":1,"a":2}',), ("{",), (None,), ("",)], "j string").select(json_identity(F.col("j")).alias("i")).collect()
    assert [r.i for r in odd] == [None] * 4
    one = spark.createDataFrame([('{"a":2.0,"b":1.50}',), ('{"b":1.5,"a":2}',), ('{"b":1.5,"a":[2]}',)], "j string").select(json_identity(F.col("j")).alias("i")).collect()
    assert one[0].i == one[1].i != one[2].i


def test_reuse(spark, store):
    rows = _rows(1)
    got = sorted((r.id, r.served, r.run) for r in reuse(_log(spark, rows), store).collect())
    assert got == _plain(rows, 24 * HOUR)


def test_reuse_of_odd_rows(spark, store):
    """The last moment of a result counts; failures, null outcomes, requests without key or time; no rows at all."""
    h = HOUR
    rows = [("a", 0, 1, True), ("a", 24 * h, 2, True), ("a", 24 * h + 1, 3, None), ("a", 24 * h + 2, 4, True), ("a", 24 * h + 2, 5, True), (None, 0, 6, True), (None, 1, 7, True), ("a", None, 8, True), ("b", -30 * h, 9, True), ("b", -6 * h, 10, True), ("b", -5 * h, 11, True)]
    got = {r.id: (r.served, r.run) for r in reuse(_log(spark, rows), store).collect()}
    assert got == {1: (False, 1), 2: (True, 1), 3: (False, 3), 4: (False, 4), 5: (True, 4), 6: (False, 6), 7: (False, 7), 8: (False, 8), 9: (False, 9), 10: (True, 9), 11: (False, 11)}


def test_reuse_of_nothing(spark, store):
    assert reuse(_log(spark, []), store).count() == 0


def test_reuse_on_a_stream(spark, tmp_path, store):
    """Batches in order of time with restarts from the checkpoint give what the batch form gives; state ends by event time."""
    from gridloom.streaming import requests as stream

    begin = 19_700 * 24 * HOUR  # a stream drops what is not after its first watermark, the epoch
    rows = sorted([(k, begin + t, i, ok) for k, t, i, ok in _rows(2, 400) if t < 60 * 24 * HOUR], key=lambda r: r[1])
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        schema = "key string, ts timestamp, id long, ok boolean"
        for k in range(3):
            lo, hi = len(rows) * k // 3, len(rows) * (k + 1) // 3
            part = rows[lo:hi]
            random.Random(k).shuffle(part)  # out of order inside a micro-batch
            _log(spark, part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            # each part is a run of its own that starts from the checkpoint
            q = (stream.reuse(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), delay="60 days").writeStream.format("parquet").option("path", str(tmp_path / "out"))
                 .option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").trigger(availableNow=True).start())
            q.awaitTermination()
        got = sorted((r.id, r.served, r.run) for r in spark.read.parquet(str(tmp_path / "out")).collect())
        assert got == _plain(rows, 24 * HOUR) == sorted((r.id, r.served, r.run) for r in reuse(_log(spark, rows), store).collect())

        # without delay the state of a key is gone once the watermark has passed the last moment that its result serves
        for k, part in enumerate(([("x", 0, 1, True), ("y", 1, 2, True)], [("y", 23 * HOUR, 3, True)], [("z", 72 * HOUR, 4, True)])):
            _log(spark, [(key, begin + t, i, ok) for key, t, i, ok in part]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in2"))
            q = (stream.reuse(spark.readStream.schema(schema).parquet(str(tmp_path / "in2")), delay="0 seconds").writeStream.format("parquet").option("path", str(tmp_path / "out2"))
                 .option("checkpointLocation", str(tmp_path / "ck2")).outputMode("append").trigger(availableNow=True).start())
            q.awaitTermination()
        kept = spark.read.format("statestore").option("stateVarName", "last").load(str(tmp_path / "ck2")).select("key.key").collect()
        assert [r.key for r in kept] == ["z"]
        assert sorted((r.id, r.served, r.run) for r in spark.read.parquet(str(tmp_path / "out2")).collect()) == [(1, False, 1), (2, False, 2), (3, True, 2), (4, False, 4)]
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


@pytest.mark.parametrize("stretch", [3, 65_536])
def test_monotone_times(spark, stretch):
    """Against a fold: clocks that go back, stand still, are absent; a key with most updates; no key."""
    from gridloom.operators.reviews import monotone_times

    rnd = random.Random(4)
    rows = [(rnd.choice([7, 7, 7, 8, None]), n, rnd.choice([None, 5_000, 5_000_999, rnd.randrange(10_000_000), 1_000 * n])) for n in range(200)]
    last, want = {}, []
    for key, n, us in sorted(rows, key=lambda r: r[1]):
        last[key] = max(max((us or 0) // 1000, 1), last.get(key, 0) + 1)
        want.append((key or -1, n, last[key]))
    d = spark.createDataFrame(rows, "issue_id long, event_id long, us long").withColumn("ts", F.timestamp_micros("us"))
    assert sorted((r.issue_id or -1, r.event_id, r.updated_ms) for r in monotone_times(d, "issue_id", stretch).collect()) == sorted(want)
    assert monotone_times(d.where("false"), "issue_id").count() == 0
