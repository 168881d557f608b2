"""Fingerprint registry as keyed streaming state: every repeat is flagged, in whichever micro-batch it arrives."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_keyed_state(spark: SparkSession) -> None:
    """Keyed state lives in RocksDB: on the executors' disks, saved with every batch to the query's checkpoint folder."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def _millis(at: dt.datetime) -> int:
    return int((at if at.tzinfo else at.astimezone()).timestamp() * 1000)


class FirstSeen(StatefulProcessor):
    """Per fingerprint the row that came first; arriving rows are flagged against it, and a timer forgets it."""

    def __init__(self, columns: list[str], row_id: str, ts: str, id_type: str, retain: dt.timedelta | None) -> None:
        self.columns, self.row_id, self.ts, self.id_type, self.retain = columns, row_id, ts, id_type, retain

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.first = handle.getValueState("first", f"id {self.id_type}")
        self.flagged = Row(*self.columns, "is_exact_duplicate", "first_id")

    def _remember(self, row_id: Any, at: dt.datetime | None) -> None:
        self.first.update((row_id,))
        if self.retain is not None and at is not None:
            self.handle.registerTimer(_millis(at + self.retain))

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        known = self.first.get()[0] if self.first.exists() else None
        if known is None:  # rows of one batch in event order; only then are they held together
            held = list(rows)
            start = min(held, key=lambda r: (r[self.ts] is None, r[self.ts], r[self.row_id]))
            known, rows = start[self.row_id], held
            self._remember(known, start[self.ts])
        for r in rows:
            yield self.flagged(*(r[c] for c in self.columns), r[self.row_id] != known, known)

    def handleInitialState(self, key: Any, initialState: Row, timerValues: Any) -> None:
        self._remember(initialState["id"], initialState["at"])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        self.first.clear()
        return iter(())

    def close(self) -> None:
        pass


def flag_repeats(
    stream: DataFrame, *, fingerprint: str = "sha256", row_id: str = "invoice_id", ts: str = "ts", registry: DataFrame | None = None,
    retain: dt.timedelta | None = None,
) -> DataFrame:
    """``stream`` with ``is_exact_duplicate`` and ``first_id`` added: was the fingerprint seen before, and in which row first.

    The first row to arrive wins; within a micro-batch the order is (ts, row_id). The row itself, delivered again, is no
    duplicate. ``registry`` (the same three columns) is loaded into the state when the query first starts. ``retain`` bounds
    the state: a fingerprint is forgotten that long after the first row's event time, by the watermark, which trails the
    newest event by ``retain`` too and behind which Spark drops rows; without it the registry keeps everything. A row without
    a fingerprint is its own first. State and output of a replayed batch are the same. ``row_id`` must not be null.

    Rows of one fingerprint meet in one state, so repeats of a common one share a task; to spread them, count them apart
    first. Only the batch that brings a new fingerprint holds its rows together; later ones are passed through one by one.
    """
    use_keyed_state(stream.sparkSession)
    id_type = stream.schema[row_id].dataType
    key = F.coalesce(F.concat(F.lit("f|"), F.col(fingerprint).cast("string")), F.concat(F.lit("row|"), F.col(row_id).cast("string")))
    extra = [T.StructField("is_exact_duplicate", T.BooleanType()), T.StructField("first_id", id_type)]
    keyed = stream.withWatermark(ts, f"{int(retain.total_seconds())} seconds") if retain else stream
    initial = None
    if registry is not None:
        first = F.min(F.struct(F.col(ts).alias("at"), F.col(row_id).alias("id"))).alias("r")
        known = registry.where(F.col(fingerprint).isNotNull()).groupBy(F.concat(F.lit("f|"), F.col(fingerprint).cast("string")).alias("_key")).agg(first)
        initial = known.select("_key", "r.id", "r.at").groupBy("_key")
    return keyed.withColumn("_key", key).groupBy("_key").transformWithState(
        statefulProcessor=FirstSeen(stream.columns, row_id, ts, id_type.simpleString(), retain),
        outputStructType=T.StructType([*stream.schema.fields, *extra]),
        outputMode="Append",
        timeMode="EventTime" if retain else "None",
        initialState=initial,
    )
