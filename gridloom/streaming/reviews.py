"""Streams of review updates and job events.

The batch forms are in gridloom.operators.reviews; these give the same states when updates come one micro-batch after another.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from gridloom.operators.reviews import MOVES

# ``updated``: nanoseconds of the last change, -1 for none; an empty note is none
_STATE = "status string, updated long, note string, n_accepted long, n_conflict long, n_invalid long"
_OUT = "issue_id long, status string, note string, n_accepted long, n_conflict long, n_invalid long"


def _advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """One issue's updates of a micro-batch, in order of (ts, event_id)."""
    status, updated, note, taken, conflict, invalid = state.get if state.exists else ("open", -1, "", 0, 0, 0)
    rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
    for ts, to, new, expected in zip(rows.ts, rows.status, rows.note, rows.expected):
        if (-1 if pd.isna(expected) else pd.Timestamp(expected).value) != updated:
            conflict += 1
        elif to in MOVES[status]:
            status, updated, taken = to, pd.Timestamp(ts).value, taken + 1
            note = note if new is None else new
        else:
            invalid += 1
    state.update((status, updated, note, taken, conflict, invalid))
    yield pd.DataFrame([(key[0], status, note or None, taken, conflict, invalid)], columns=["issue_id", "status", "note", "n_accepted", "n_conflict", "n_invalid"])


def review_states(updates: DataFrame) -> DataFrame:
    """A streaming table of states: each micro-batch emits the issues it has changed (update mode).

    Updates of one issue must come in order over micro-batches; inside one they are sorted."""
    return updates.groupBy("issue_id").applyInPandasWithState(_advance, _OUT, _STATE, "update", GroupStateTimeout.NoTimeout)


def job_states(events: DataFrame) -> DataFrame:
    """Latest event and counts of each job, as a streaming aggregate."""
    return events.groupBy(F.col("user_id").alias("job_id")).agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("status"), F.count("*").alias("n_events"), F.max("ts").alias("last_ts"))


def first_requests(events: DataFrame, within: str = "24 hours") -> DataFrame:
    """Requests that no earlier one of the last ``within`` can serve, first come first served."""
    return events.withWatermark("ts", within).dropDuplicatesWithinWatermark(["user_id", "event_type"])


def publish_partial(outcomes: DataFrame, path: str):
    """A sink that overwrites the snapshots a micro-batch changes, one folder each."""
    def write(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("snapshot_id").parquet(path)

    return outcomes.writeStream.foreachBatch(write)
