"""Streams: validate and quarantine, de-duplicated anomaly feed, trends per period, current state.

Sources and sinks are files with a checkpoint in the shared folder, so a restarted stream goes on
where it stopped and writes each row once.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from wardenframe.operators.contracts import Contract
from wardenframe.operators.serving import latest_state
from wardenframe.operators.validation import _error, row_checks
from wardenframe.session import scratch_path


def file_stream(spark: SparkSession, folder: str, pattern: str, schema: T.StructType, files_per_batch: int | None = None) -> DataFrame:
    """Parquet files of a folder as a stream."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def drain(stream: DataFrame, label: str, partition_by: tuple[str, ...] = (), output: str | None = None, checkpoint: str | None = None) -> str:
    """Process everything that is available into Parquet files and return their folder."""
    spark = stream.sparkSession
    output = output or scratch_path(spark, f"{label}-out")
    checkpoint = checkpoint or scratch_path(spark, f"{label}-state")
    writer = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    query = writer.trigger(availableNow=True).start(output)
    query.awaitTermination()
    return output


#: Groups that the keys of a stream with event times are dealt to, and parts that a group's memory has at most.
BUCKETS, PARTS = 2048, 16


class _Cells:
    """What is known of keys, one entry per key and horizon-wide cell: its first and last time."""

    def __init__(self, keys: np.ndarray, cells: np.ndarray, first: np.ndarray, last: np.ndarray) -> None:
        self.keys, self.cells, self.first, self.last = keys, cells, first, last

    def __len__(self) -> int:
        return len(self.keys)

    def where(self, chosen: np.ndarray) -> _Cells:
        return _Cells(self.keys[chosen], self.cells[chosen], self.first[chosen], self.last[chosen])

    def merged(self) -> _Cells:
        """One entry per key and cell; the later ones of a cell have widened it."""
        frame = pd.DataFrame({"k": self.keys, "c": self.cells, "f": self.first, "l": self.last}).groupby(["k", "c"], sort=False).agg({"f": "min", "l": "max"}).reset_index()
        return _Cells(frame["k"].to_numpy(object), frame["c"].to_numpy(np.int64), frame["f"].to_numpy(float), frame["l"].to_numpy(float))

    def pack(self) -> bytes:
        lengths = np.array([len(k) for k in self.keys], "<i8")
        numbers = (np.array([len(self)], "<i8"), self.cells.astype("<i8"), self.first.astype("<f8"), self.last.astype("<f8"), lengths)
        return b"".join([*(n.tobytes() for n in numbers), "".join(self.keys).encode()])

    @staticmethod
    def unpack(packed: bytes) -> _Cells:
        n = int(np.frombuffer(packed, "<i8", 1)[0])
        cells, first, last, lengths = (np.frombuffer(packed, t, n, 8 + 8 * n * i) for i, t in enumerate(("<i8", "<f8", "<f8", "<i8")))
        text, ends = bytes(packed[8 + 32 * n:]).decode(), np.cumsum(lengths).tolist()
        keys = np.empty(n, object)
        keys[:] = [text[a:b] for a, b in zip([0, *ends], ends)]
        return _Cells(keys, cells, first, last)

    @staticmethod
    def joined(parts: list[_Cells]) -> _Cells:
        none = _Cells(np.empty(0, object), np.zeros(0, np.int64), np.zeros(0), np.zeros(0))
        return _Cells(*(np.concatenate([getattr(p, a) for p in (none, *parts)]) for a in ("keys", "cells", "first", "last")))


class MarkRepeats(StatefulProcessor):
    """Passes every row on and marks those whose key is known, or comes more than once with them, within the horizon.

    Of a key's event times (in seconds) only the first and last of each horizon-wide cell are kept: a time of the same
    cell is near in any case, and of the two cells beside it only these can be. Where the stream has a watermark,
    cells end that no acceptable row can reach: a row may be one horizon older than the watermark and looks one more
    back, and rows that are older than that are marked late, as what they would be compared with may be gone. Rows
    without an event time repeat each other within a batch only.

    A group holds one key or many, told apart by the column ``_key``; the cost of a call is per group, not per key. A
    batch adds what it learns as one more part to the group's memory; when there are many, they become one. An
    event-time timer clears a group once half of its cells can have ended.
    """

    def __init__(self, horizon: float, columns: list[str], timed: bool) -> None:
        self.horizon, self.columns, self.timed = horizon, columns, timed

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.cells = handle.getMapState("cells", "part long", "cells binary")

    def _oldest(self, timerValues) -> float:
        """Oldest event time that is still compared."""
        mark = timerValues.getCurrentWatermarkInMs() / 1e3 if self.timed else 0
        return mark - self.horizon if mark > 0 else -np.inf

    def _cell(self, times: np.ndarray) -> np.ndarray:
        return np.floor(times / self.horizon).astype(np.int64) if self.horizon else times.astype(np.int64)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        parts = list(rows)
        batch = parts[0] if len(parts) == 1 else pd.concat(parts, ignore_index=True)
        batch.columns = self.columns  # Spark renames those that no Python field can be called
        times, names = batch["_at"].to_numpy(dtype=float), batch["_key"].to_numpy(object)
        repeat, late = np.zeros(len(batch), bool), np.zeros(len(batch), bool)
        keyed = np.flatnonzero([k.startswith("+") for k in names])  # the others have no key
        if len(keyed):
            stored = {k[0]: _Cells.unpack(v[0]) for k, v in self.cells.iterator()}
            known = _Cells.joined(list(stored.values()))
            if len(stored) > 1:
                known = known.merged()
            codes = pd.factorize(np.concatenate([known.keys, names[keyed]]))[0]
            code = np.full(len(batch), -1)
            code[keyed] = codes[len(known):]
            none = keyed[np.isnan(times[keyed])]
            repeat[none] = np.bincount(code[none], minlength=1)[code[none]] > 1
            at = keyed[~np.isnan(times[keyed])]
            order = at[np.lexsort((times[at], code[at]))]
            near = (np.diff(times[order]) <= self.horizon) & (np.diff(code[order]) == 0)
            repeat[order[:-1]] |= near
            repeat[order[1:]] |= near
            oldest = self._oldest(timerValues)
            late[at] = times[at] < oldest
            if len(at):
                self._compare(known, codes[: len(known)], code[at], times, at, repeat)
            self._remember(stored, known, names, times, at[~late[at]], oldest)
        batch["_repeat"] = repeat
        batch["_late"] = late
        yield batch

    def _compare(self, known: _Cells, known_code: np.ndarray, code: np.ndarray, times: np.ndarray, at: np.ndarray, repeat: np.ndarray) -> None:
        """Mark the rows that are near a time of an earlier batch."""
        if not len(known):
            return
        cell = self._cell(times[at])
        every = np.unique(np.concatenate([known.cells, cell - 1, cell, cell + 1]))
        entry = known_code * len(every) + np.searchsorted(every, known.cells)
        order = np.argsort(entry)
        for step in (-1, 0, 1):
            wanted = code * len(every) + np.searchsorted(every, cell + step)
            place = order[np.minimum(np.searchsorted(entry, wanted, sorter=order), len(order) - 1)]
            found = entry[place] == wanted
            if step:
                gap = times[at] - known.last[place] if step < 0 else known.first[place] - times[at]
                found &= gap <= self.horizon
            repeat[at[found]] = True

    def _remember(self, stored: dict[int, _Cells], known: _Cells, names: np.ndarray, times: np.ndarray, at: np.ndarray, oldest: float) -> None:
        """Take up the times and drop parts out of reach. A group with cells has a timer."""
        for part, cells in stored.items():
            if not (cells.last >= oldest - self.horizon).any():
                self.cells.removeKey((part,))
        fresh = _Cells(names[at], self._cell(times[at]), times[at], times[at]).merged()
        if len(known) and len(fresh):
            both = _Cells.joined([known, fresh]).merged()  # those that are known come first, in their order
            old = np.arange(len(both)) < len(known)
            old[: len(known)] = (both.first[: len(known)] == known.first) & (both.last[: len(known)] == known.last)
            fresh = both.where(~old)
            if len(stored) >= PARTS:
                fresh = both.where(both.last >= oldest - self.horizon)
                self.cells.clear()
        if len(fresh):
            self.cells.updateValue((max(stored, default=0) + 1,), (fresh.pack(),))
            if self.timed and not len(known):
                self.handle.registerTimer(self._end(fresh))

    def _end(self, cells: _Cells) -> int:
        """Watermark, in milliseconds, at which nothing acceptable can be near half of the cells any more."""
        last = float(np.sort(cells.last)[(len(cells) - 1) // 2])
        return int((last + 2 * self.horizon) * 1e3) + 1

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        known = _Cells.joined([_Cells.unpack(v[0]) for _, v in self.cells.iterator()]).merged()
        left = known.where(known.last >= self._oldest(timerValues) - self.horizon)
        self.cells.clear()
        if len(left):
            self.cells.updateValue((1,), (left.pack(),))
            self.handle.registerTimer(self._end(left))
        return iter(())

    def close(self) -> None:
        pass


def _seconds(span: str) -> float:
    count, unit = span.split()
    return dt.timedelta(**{unit.rstrip("s") + "s": float(count)}).total_seconds()


def mark_repeats(stream: DataFrame, key: str, name: str, late: str, event_time: str | None, horizon: str, lateness: str) -> DataFrame:
    """``stream`` with the flags ``name``: its key has come before, or comes again in the same batch, and ``late``: too old to be compared.

    Missing keys repeat nothing. With an event time the state of a key ends once the watermark (newest event time minus
    ``lateness``) is two horizons past it; without, it does not end.
    """
    stream.sparkSession.conf.set(
        "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    )
    columns = stream.columns
    # Rows without a key are dealt by their content, so that they do not meet in one task.
    group = F.coalesce(F.concat(F.lit("+"), F.col(key).cast("string")), F.concat(F.lit("-"), F.xxhash64(*columns).cast("string")))
    at = F.unix_micros(F.col(event_time).cast("timestamp")) / 1e6 if event_time else F.lit(0.0)
    keyed = stream.select("*", group.alias("_key"), at.cast("double").alias("_at"))
    # Each group costs calls into its task's state, so keys share groups where their state ends. Without, a key is a group: what
    # a batch reads and writes is then of its own keys only, however many there have been.
    keyed = keyed.withColumn("_group", F.pmod(F.xxhash64("_key"), F.lit(BUCKETS)).cast("string") if event_time else F.col("_key"))
    names = keyed.columns
    if event_time:
        # The watermark is kept on a column of its own, which goes: rows behind it are to reach the processor, not to be dropped.
        keyed = keyed.withColumn("_clock", F.col(event_time).cast("timestamp")).withWatermark("_clock", lateness).select(*names)
    schema = T.StructType([*keyed.schema.fields, T.StructField("_repeat", T.BooleanType()), T.StructField("_late", T.BooleanType())])
    mode = "EventTime" if event_time else "None"
    processor = MarkRepeats(_seconds(horizon) if event_time else 0.0, names, bool(event_time))
    marked = keyed.groupBy("_group").transformWithStateInPandas(processor, schema, "Append", mode)
    return marked.drop("_key", "_at", "_group").withColumnsRenamed({"_repeat": name, "_late": late})


def quarantine(stream: DataFrame, contract: Contract, event_time: str | None = None, horizon: str = "1 day", lateness: str = "30 days") -> DataFrame:
    """Arriving rows with their errors and an ``outcome`` of valid or invalid; every row is kept.

    A row whose unique key came before, or comes again in the same batch, is invalid: with an event time,
    if the two lie within the horizon, otherwise always. A first copy that an earlier batch passed on stays valid.
    What is remembered of a key ends with the watermark (``mark_repeats``); a row more than a horizon behind it, whose
    copies may be forgotten, is invalid with an error of its own.
    """
    columns = stream.columns
    checks = row_checks(contract, columns)
    for c in contract.unique:
        if c in columns:
            stream = mark_repeats(stream, c, f"_copied_{c}", f"_late_{c}", event_time, horizon, lateness)
            checks.append(_error("duplicate", c, "Duplicate value", F.col(f"_copied_{c}")))
            checks.append(_error("late", c, "Too late to be compared with earlier copies", F.col(f"_late_{c}")))
    tagged = stream.select(*columns, F.array_compact(F.array(*checks)).alias("errors"))
    return tagged.withColumn("outcome", F.when(F.size("errors") == 0, "valid").otherwise("invalid"))


def new_anomaly_feed(stream: DataFrame, event_time: str, keys: tuple[str, ...] = ("record_id", "source_dataset"), horizon: str = "7 days") -> DataFrame:
    """The first anomaly per record and data set within the horizon."""
    return stream.withWatermark(event_time, horizon).dropDuplicatesWithinWatermark(list(keys))


def _counted(stream: DataFrame, period: Column, category: str) -> DataFrame:
    counted = stream.groupBy(period.alias("period"), category).agg(F.count(F.lit(1)).alias("anomalies"))
    return counted.select(F.col("period.start").alias("period_start"), F.col("period.end").alias("period_end"), category, "anomalies")


def windowed_trend(stream: DataFrame, event_time: str, category: str, length: str, slide: str | None = None, lateness: str = "1 hour") -> DataFrame:
    """Anomalies per tumbling (or, with ``slide``, sliding) window; rows later than the lateness are dropped."""
    return _counted(stream.withWatermark(event_time, lateness), F.window(event_time, length, slide), category)


def session_trend(stream: DataFrame, event_time: str, category: str, gap: str, lateness: str = "1 hour") -> DataFrame:
    """Anomalies per burst of activity, a burst ending after a quiet gap."""
    return _counted(stream.withWatermark(event_time, lateness), F.session_window(event_time, gap), category)


STATE_SCHEMA = "at timestamp, tie string"
CURRENT_SCHEMA = "record_id string, status string, severity string, id string, at timestamp"


class KeepNewest(StatefulProcessor):
    """Remembers the newest change of a record and emits it whenever it moves forward."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.newest = handle.getValueState("newest", STATE_SCHEMA)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        """What a store that is there before the stream knows of the record."""
        top = initialState.sort_values(["at", "id"]).iloc[-1]
        self.newest.update((top["at"].to_pydatetime(), top["id"]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        best = None
        for pdf in rows:
            top = pdf.sort_values(["at", "id"]).iloc[-1]
            if best is None or (top["at"], top["id"]) > (best["at"], best["id"]):
                best = top
        known = self.newest.get() if self.newest.exists() else None
        if best is not None and (known is None or (best["at"], best["id"]) > (pd.Timestamp(known[0]), known[1])):
            self.newest.update((best["at"].to_pydatetime(), best["id"]))
            yield pd.DataFrame({"record_id": [key[0]], "status": [best["status"]], "severity": [best["severity"]], "id": [best["id"]], "at": [best["at"]]})

    def close(self) -> None:
        pass


def current_state(stream: DataFrame, store: DataFrame | None = None) -> DataFrame:
    """Status changes ``(record_id, status, severity, id, at)`` to the moves of each record's state.

    The newest row per record of the output is the current state (``serving.latest_state``). A stream that is started on
    an existing ``store`` of changes emits the moves beyond it; both together hold the current state.
    """
    stream.sparkSession.conf.set(
        "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    )
    known = None
    if store is not None:
        newest = latest_state(store.select("record_id", "id", "at"), "record_id", "at", "id")
        known = newest.groupBy("record_id")
    return stream.groupBy("record_id").transformWithStateInPandas(KeepNewest(), CURRENT_SCHEMA, "Append", "None", known)
