"""Replay and checks on streams of events."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.functions.schema import EVENT
from tidemark.operators.replay import task_records
from tidemark.session import ship
from tidemark.sinks import store


def read_stream(spark: SparkSession, path: str, files_at_once: int = 1000) -> DataFrame:
    """Events of JSON lines files as they come in, payloads as text."""
    return spark.readStream.schema(EVENT).option("maxFilesPerTrigger", files_at_once).json(path)


def task_snapshots(events: DataFrame) -> DataFrame:
    """Task records kept up to date: the same aggregation as in batch, with its partial sums as state.

    Last-one-counts rules go by seq, so late events of a run fall into their place.
    """
    return task_records(events)


def sequence_violations(events: DataFrame, position: str = "at") -> DataFrame:
    """run_id, seq, expected: events that aren't the next of their run. The state of a run is the seq that it waits for.

    Events count in the order of position (their time, or a number that their source gives them as they arrive), those of
    a batch as well, since a shuffle doesn't keep the order of rows; equal positions go by seq.
    """
    ship(events.sparkSession)

    def check(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        expected = state.get[0] if state.exists else 0
        bad = []
        for _, seq in sorted(row for p in parts for row in zip(p[position], p["seq"])):
            if seq != expected:
                bad.append((key[0], seq, expected))
            expected = max(expected, seq + 1)
        state.update((expected,))
        yield pd.DataFrame(bad, columns=["run_id", "seq", "expected"])

    return events.groupBy("run_id").applyInPandasWithState(check, "run_id string, seq long, expected long", "expected long", "append", GroupStateTimeout.NoTimeout)


def flush_stream(events: DataFrame, path: str, checkpoint: str, listener: Callable[[DataFrame], None] | None = None, available_now: bool = True):
    """Append a stream to a store, each (run_id, seq) once however often a batch is repeated; listener gets each batch."""

    def sink(batch: DataFrame, _: int) -> None:
        store.flush(batch, path)
        if listener is not None:
            listener(batch)

    writer = events.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
