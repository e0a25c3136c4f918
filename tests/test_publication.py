"""Partial publication: states by hand, and a stream with restarts and a batch that is run twice."""

import pytest
from pyspark.sql import functions as F

from gridloom.operators.publication import publication_state
from gridloom.streaming import publication as stream

SCHEMA = "snapshot_id long, domain string, status string, at int"
ROWS = [(1, "power", "ready", 3), (1, "water", "failed", 1), (2, "power", "failed", 1), (2, "water", "failed", 1), (2, "gas", "failed", 2), (3, "odd", "ready", 1), (3, "gas", "needs_source", 1),
        (1, "water", "ready", 5), (4, "gas", "ready", 9), (4, "power", "ready", 2), (4, "water", "ready", 2), (4, "water", "ready", 2), (None, "gas", "ready", 1), (5, None, "ready", 1)]
WANT = {1: (2, ["power", "water"], [], ["gas"], "partial"), 2: (0, [], ["power", "water", "gas"], [], "failed"), 3: (0, [], [], ["power", "water", "gas"], "pending"), 4: (3, ["power", "water", "gas"], [], [], "ready")}


def told(d):
    return {r.snapshot_id: (r.version, r.ready, r.failed, r.pending, r.state) for r in publication_state(d, F.lit(["power", "water", "gas"])).collect()}


def test_states(spark):
    assert told(spark.createDataFrame(ROWS, SCHEMA)) == WANT
    assert told(spark.createDataFrame([], SCHEMA)) == {}


def test_stream_with_restarts(spark, tmp_path):
    """Outcomes of a snapshot come over several runs; one run fails after its batch was written and writes it again."""
    at, log = str(tmp_path / "in"), str(tmp_path / "log")

    def run(sink):
        sink.option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()

    seen = []
    for k in range(0, len(ROWS), 5):
        seen += ROWS[k : k + 5]
        spark.createDataFrame(ROWS[k : k + 5], SCHEMA).coalesce(1).write.mode("append").parquet(at)
        source = spark.readStream.schema(SCHEMA).parquet(at)
        if k == 5:
            def broken(batch, number):
                batch.write.mode("overwrite").parquet(f"{log}/batch={number}")
                raise RuntimeError("lost after the write")

            with pytest.raises(Exception, match="lost after the write"):
                run(source.writeStream.foreachBatch(broken))
        run(stream.publish_outcomes(source, log))
        assert sorted(map(str, stream.published(spark, log, SCHEMA).collect())) == sorted(map(str, spark.createDataFrame(seen, SCHEMA).collect()))
        assert told(stream.published(spark, log, SCHEMA)) == told(spark.createDataFrame(seen, SCHEMA))
    assert told(stream.published(spark, log, SCHEMA)) == WANT


def test_circuit_evidence(spark):
    """Members of all types, blank roles, repeated and missing members, a way with one node, a way without its line."""
    from gridloom.operators.circuits import circuit_evidence

    members = spark.createDataFrame([(1, "way", 10, ""), (1, "way", 11, "line"), (1, "node", 10, None), (1, "relation", 2, "part"), (1, "way", 10, ""), (1, "way", 99, "line"), (2, "way", 98, None), (2, "area", 10, None), (2, "way", None, None), (3, "way", 12, None)],
                                    "relation_id long, type string, ref long, role string")
    there = spark.createDataFrame([("way", 10, "LineString"), ("way", 11, None), ("node", 10, "Point"), ("relation", 2, None), ("way", 12, None), ("area", 10, None)], "type string, ref long, gtype string")
    ways = spark.createDataFrame([(10, 1, 5, 3), (11, 6, 7, 2), (12, 8, 8, 1)], "way_id long, first_node long, last_node long, n_nodes long")
    want = [(1, "way/10", "member", "node/1", "node/5", True, False)] * 2 + [(1, "way/11", "line", "node/6", "node/7", False, True), (1, "node/10", "member", None, None, False, False), (1, "relation/2", "part", None, None, False, False),
                                                                             (3, "way/12", "member", None, None, False, True)]
    assert sorted(str(tuple(r)) for r in circuit_evidence(members, there, ways).collect()) == sorted(map(str, want))
