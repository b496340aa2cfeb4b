"""Keyed state of a stream of events, kept by Spark's state store (``transformWithState``).

Each key has a settled state, to which all events up to the watermark have been applied in order, and a list of the events
behind it. New events join the list; a timer of event time goes off when the watermark has passed the oldest of them, and
what has been passed is applied in order of (time, position) and leaves the list. So a batch costs what has changed, however
long the history is; events may come in any order within the allowed lateness; and a key's memory is what happens to it in
that time. The state shown for a key is the settled one with the list applied to it.

Events with a null key or time, and those behind the watermark, are left out (the batch fold keeps them).
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

#: The state store that keeps more keys than memory holds, and writes only what changed.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Settling(StatefulProcessor):
    """``step(state, event)`` gives the next state; both are dicts. ``fields`` and ``kept`` are the DDL of state and events (with ``at``, ``pos``)."""

    def __init__(self, key: str, fields: str, kept: str, start: dict[str, Any], step: Callable[[dict, dict], dict]):
        self.key, self.fields, self.kept, self.start, self.step = key, fields, kept, start, step

    def init(self, handle) -> None:
        self.handle = handle
        self.settled = handle.getValueState("settled", self.fields)
        self.pending = handle.getListState("pending", self.kept)
        self.names = [f.split()[0] for f in self.fields.split(", ")]
        self.columns = [f.split()[0] for f in self.kept.split(", ")]

    def _state(self) -> dict:
        found = self.settled.get()
        return dict(self.start) if found is None else dict(zip(self.names, found, strict=True))

    def _events(self) -> list[dict]:
        return [_timed(dict(zip(self.columns, e, strict=True))) for e in self.pending.get()]

    def _settle(self, events: list[dict], until_ms: int, waits: int | None, had: bool) -> tuple[dict, list[dict]]:
        """Apply what the watermark has passed; a timer waits for the oldest event of the rest (``waits``: for which one it is set).

        Every call goes to the state store's process, so nothing is asked that is known here.
        """
        events.sort(key=lambda e: (e["at"], e["pos"]))
        ripe = [e for e in events if _millis(e["at"]) < until_ms]
        rest = events[len(ripe) :]
        state = self._state()
        if ripe:
            for e in ripe:
                state = self.step(state, e)
            self.settled.update(tuple(state[n] for n in self.names))
        if rest:
            self.pending.put([tuple(e[c] for c in self.columns) for e in rest])
            due = _millis(rest[0]["at"]) + 1
            if waits is None or due < waits:
                if waits is not None:
                    self.handle.deleteTimer(waits)
                self.handle.registerTimer(due)
        elif had:
            self.pending.clear()
        return state, rest

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        events = self._events()
        # a timer that the watermark has passed goes off in any case, and sets the next one
        waits = min((_millis(e["at"]) + 1 for e in events), default=None)
        had = bool(events)
        events += [_timed({c: r[c] for c in self.columns}) for r in rows]
        state, rest = self._settle(events, timerValues.getCurrentWatermarkInMs(), waits, had)
        for e in rest:
            state = self.step(state, e)
        yield Row(**{self.key: key[0]} | {n: state[n] for n in self.names})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        events = self._events()
        if events:
            self._settle(events, timerValues.getCurrentWatermarkInMs(), None, True)
        return iter(())

    def close(self) -> None:
        pass


def _timed(event: dict) -> dict:
    """With ``at`` in UTC; the state store gives times of the machine's zone, without its name."""
    return event | {"at": event["at"].astimezone(dt.timezone.utc)}


def _millis(at: dt.datetime) -> int:
    """Whole milliseconds of a time, as the watermark counts them."""
    return (at - dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)) // dt.timedelta(milliseconds=1)


def session(spark: SparkSession) -> SparkSession:
    """A session of its own with the state store set, so that the caller's settings stay as they are."""
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    own.conf.set("spark.sql.session.timeZone", "UTC")
    # a task of each micro-batch opens its part of the store, whatever is in it, so there are no more parts than cores
    cores = max(2, spark.sparkContext.defaultParallelism)
    own.conf.set("spark.sql.shuffle.partitions", str(min(cores, int(spark.conf.get("spark.sql.shuffle.partitions")))))
    return own


def settled_state(events: DataFrame, key: str, at: str, pos: str, kept: str, fields: str, start: dict, step: Callable[[dict, dict], dict], lateness: str = "1 day") -> DataFrame:
    """Stream of (key, fields...): the state of each key that a micro-batch has changed. ``kept``: DDL of the event columns that ``step`` reads."""
    of = dict(events.dtypes)
    rows = events.where(F.col(key).isNotNull() & F.col(at).isNotNull()).withColumn("at", F.col(at).cast("timestamp")).withColumn("pos", F.col(pos).cast("long"))
    columns = f"at timestamp, pos long, {kept}"
    names = [f.split()[0] for f in columns.split(", ")]
    return (
        rows.select(key, *names)
        .withWatermark("at", lateness)
        .groupBy(key)
        .transformWithState(Settling(key, fields, columns, start, step), outputStructType=f"{key} {of[key]}, {fields}", outputMode="Update", timeMode="EventTime")
    )


def follow(states: DataFrame, root: str) -> None:
    """Work off what the stream has; each batch writes the states it has changed in a folder of its own, so one tried again changes nothing."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/states/batch={number}")

    states.writeStream.foreachBatch(put).outputMode("update").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()


def shown(spark: SparkSession, root: str, key: str) -> DataFrame:
    """The newest state of each key, from what the batches have written."""
    rows = spark.read.option("basePath", f"{root}/states").parquet(f"{root}/states")
    columns = [c for c in rows.columns if c not in ("batch", key)]
    return rows.groupBy(key).agg(F.max_by(F.struct(*columns), "batch").alias("s")).select(key, "s.*")


def kept(spark: SparkSession, root: str, variable: str) -> DataFrame:
    """What the state store itself holds of ``settled`` or ``pending``, read by Spark's state data source."""
    reader = session(spark).read.format("statestore").option("stateVarName", variable)
    return (reader.option("flattenCollectionTypes", "true") if variable == "pending" else reader).load(f"{root}/checkpoint")
