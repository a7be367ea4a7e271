"""Streams of files dropped into a folder: the checkpointed replacement of a polling watcher.

A file is processed once. The file source tracks names, so a file that changes later is not read again;
drop changed data under a new name.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable, Iterable, Iterator, Mapping
from datetime import timedelta, timezone
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from ..functions.names import col
from ..operators.clean import CleanPlan, apply_clean
from ..operators.pivot import PivotSpec, group_aggregate
from ..operators.sketches import profile_sketches
from ..operators.validate import gate
from ..plans.report import DEFAULT_PIVOT, build_report, write_report
from ..session import materialize
from ..sources.csv import charset_of, read_null_tokens

#: Rows of a stored drop that one file holds; tasks read whole files, so their aggregates stay small.
ROWS_PER_FILE = 100_000


def read_drops(
    spark: SparkSession, path: str, schema: T.StructType | str, files_per_batch: int | None = None, encoding: str = "utf-8"
) -> DataFrame:
    """Stream of CSV files below ``path`` with the name of the file as ``source_file``; missing-cell texts are null, as in batch.

    All files of a stream have one ``encoding``: a stream can't look into files that are not there yet.
    """
    reader = spark.readStream.schema(schema).option("header", True).option("escape", '"').option("multiLine", True)
    reader = reader.option("encoding", charset_of(spark, encoding))
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return read_null_tokens(reader.csv(path).withColumn("source_file", F.col("_metadata.file_path")))


def clean_stream(stream: DataFrame, plan: CleanPlan) -> DataFrame:
    """Clean a stream with a plan frozen on a static table; stateless, one projection."""
    return apply_clean(stream, plan)


def report_folder(target: str, source_file: str) -> str:
    """Folder of a dropped file's report: its name, and a digest of its whole path."""
    digest = hashlib.sha256(source_file.encode("utf-8")).hexdigest()[:12]
    return f"{target}/{os.path.basename(source_file)}-{digest}"


def report_drops(
    stream: DataFrame,
    target: str,
    checkpoint: str,
    spec: PivotSpec = DEFAULT_PIVOT,
    plan: CleanPlan | None = None,
    trigger: Mapping[str, Any] | None = None,
) -> StreamingQuery:
    """Write the report tables of every dropped file below ``target/<file>-<hash of its path>`` (:func:`report_folder`).

    Files of one name in several folders, or with several extensions, have reports of their own. A restarted batch overwrites its own folders, so a file has one report even after a failure.
    """
    def report_batch(batch: DataFrame, _batch_id: int) -> None:
        # Every part of a report reads the batch. One task parses a file as a stream; it is stored in files of few rows, so
        # that many tasks aggregate it. The rows' places keep the order of the file for its first rows.
        place = "__place"
        while place in batch.columns:
            place += "_"
        kept = materialize(batch.withColumn(place, F.monotonically_increasing_id()), "drop", ROWS_PER_FILE)
        for row in kept.select("source_file").distinct().collect():
            part = kept.where(F.col("source_file") == row["source_file"])
            part, in_order = (d.drop("source_file", place) for d in (part, part.orderBy(place)))
            if plan:
                part, in_order = apply_clean(part, plan), apply_clean(in_order, plan)
            write_report(build_report(part, spec, in_order=in_order), report_folder(target, row["source_file"]))

    return _start(stream, report_batch, checkpoint, trigger)


def profile_drops(stream: DataFrame, target: str, checkpoint: str, trigger: Mapping[str, Any] | None = None) -> StreamingQuery:
    """Store the profile sketches of every dropped file below ``target``; :func:`~tablesmith.operators.sketches.stored_profiles`
    merges them, so the profile of all files never reads a file twice. A restarted batch overwrites its own sketches."""
    def sketch_batch(batch: DataFrame, batch_id: int) -> None:
        profile_sketches(batch, ["source_file"]).write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    return _start(stream, sketch_batch, checkpoint, trigger)


def gated_stream(
    stream: DataFrame,
    spec: Mapping[str, Any],
    accepted: str,
    quarantine: str,
    checkpoint: str,
    threshold: float = 1.0,
    trigger: Mapping[str, Any] | None = None,
) -> StreamingQuery:
    """Check every micro-batch; write it below ``accepted`` or, when the gate stays shut, below ``quarantine``."""
    def check_batch(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        allowed = gate(batch, spec, threshold).first()["allowed"]
        # One folder per batch, overwritten on a retry, makes the write idempotent.
        batch.write.mode("overwrite").parquet(f"{accepted if allowed else quarantine}/batch={batch_id}")
        batch.unpersist()

    return _start(stream, check_batch, checkpoint, trigger)


def _start(
    stream: DataFrame, batch_function: Callable[[DataFrame, int], None], checkpoint: str, trigger: Mapping[str, Any] | None
) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(batch_function).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def dedupe_stream_first(stream: DataFrame, keys: list[str], event_time: str, delay: str) -> DataFrame:
    """First row per key among rows that arrive within ``delay``; older state is dropped."""
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(keys)


def dedupe_stream_last_by(
    stream: DataFrame, keys: list[str], by: str, tiebreak: str, event_time: str | None = None, delay: str | None = None, window: str | None = None
) -> DataFrame:
    """Row with the greatest ``by`` per key (least ``tiebreak`` of equals), for update or complete mode.

    The state holds one row per key and is combined per task before the shuffle. ``tiebreak`` must be numeric. With
    ``event_time``, ``delay`` and ``window`` the newest row is per key and window, and state older than the
    watermark goes: the form for streams whose keys never end.
    """
    groups = [col(k) for k in keys]
    if event_time:
        stream = stream.withWatermark(event_time, delay)
        groups.append(F.window(col(event_time), window).alias("__window"))
    others = [c for c in stream.columns if c not in keys]
    newest = F.max_by(F.struct(*[col(c) for c in others]), F.struct(col(by), (-col(tiebreak)).alias("__tie")))
    picked = stream.groupBy(*groups).agg(newest.alias("__row"))
    return picked.select(*[col(k) for k in keys], *[F.col("__row")[c].alias(c) for c in others])


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Newest(StatefulProcessor):
    """State of one key: its newest row so far, and the timer that ends its life."""

    def __init__(self, schema: T.StructType, by: str, tiebreak: str, event_time: str, ttl_ms: int) -> None:
        self.schema, self.columns, self.ttl_ms = schema, schema.names, ttl_ms
        self.by, self.tiebreak, self.at = (self.columns.index(c) for c in (by, tiebreak, event_time))
        self.instants = [isinstance(f.dataType, T.TimestampType) for f in schema.fields]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # Every call to a state or timer is a message to the JVM, so a key has one value: its row, and when it ends.
        self.state = handle.getValueState("state", T.StructType([T.StructField("row", self.schema), T.StructField("until", T.LongType())]))

    def _values(self, row: Iterable) -> tuple:
        """The row's values, instants with their zone: they come without it as input and with it from the state."""
        return tuple(v.replace(tzinfo=timezone.utc) if instant and v is not None and v.tzinfo is None else v for v, instant in zip(row, self.instants))

    @staticmethod
    def _rank(by: Any, tie: Any) -> tuple:
        return (by is not None, by if by is not None else 0, tie is not None, -tie if tie is not None else 0)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        found = self.state.get()
        old, until = (self._values(found[0]), found[1]) if found is not None else (None, None)
        best, latest = old, until
        # New rows are compared as they come; only the newest one is turned into values.
        newest, rank, last, places = None, None, None, None
        for row in rows:
            if places is None:
                places = [row.__fields__.index(c) for c in self.columns]
                by, tie, at = (places[i] for i in (self.by, self.tiebreak, self.at))
            own = self._rank(row[by], row[tie])
            if newest is None or own > rank:
                newest, rank = row, own
            if last is None or row[at] > last:
                last = row[at]
        if newest is not None:
            values = self._values(newest[i] for i in places)
            if best is None or self._rank(values[self.by], values[self.tiebreak]) > self._rank(best[self.by], best[self.tiebreak]):
                best = values
            if last.tzinfo is None:
                last = last.replace(tzinfo=timezone.utc)
            end = int(last.timestamp() * 1000) + self.ttl_ms
            latest = end if latest is None else max(latest, end)
        if until is None and latest is not None:
            self.handle.registerTimer(latest)
        if latest != until or best != old:
            self.state.update((best, latest))
        if best != old:
            yield Row(**dict(zip(self.columns, best)))

    def handleExpiredTimer(self, key: Any, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        """A key has one timer. Rows that came since it was set have moved the key's end, not the timer: it is set again."""
        found = self.state.get()
        if found is not None and found[1] > timerValues.getCurrentWatermarkInMs():
            self.handle.registerTimer(found[1])
        else:
            self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


def dedupe_stream_last_by_ttl(
    stream: DataFrame, keys: list[str], by: str, tiebreak: str, event_time: str, delay: str, ttl: timedelta
) -> DataFrame:
    """Changes of the row with the greatest ``by`` per key (least ``tiebreak`` of equals), in update mode.

    A key is forgotten once the watermark is ``ttl`` behind its latest ``event_time``, each key at its own time; a row
    that comes after that starts anew. Rows later than the watermark allows (``delay``) are dropped, as are rows without
    ``event_time``. So the state holds one row for each key seen within ``delay`` and ``ttl``, however many keys there
    ever are. The last change of a key is its answer: :func:`tablesmith.dedupe` over the changes equals the same over
    all rows that were not late.

    The state lies in RocksDB, which timers need; the setting holds for the queries of this session that start later.
    The session's time zone must be UTC, as :func:`tablesmith.build_session` sets it.
    """
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    kept = stream.where(col(event_time).isNotNull()).withWatermark(event_time, delay)
    processor = _Newest(stream.schema, by, tiebreak, event_time, int(ttl.total_seconds() * 1000))
    return kept.groupBy(*keys).transformWithState(processor, stream.schema, "update", "eventTime")


def pivot_stream(
    stream: DataFrame, event_time: str, category: str, values: list[tuple[str, str]], delay: str, window: str | None = "1 day"
) -> DataFrame:
    """Aggregates per time window (or per month with ``window=None``) and category.

    Rows later than ``delay`` behind the newest are dropped, so choose it from the disorder of arrivals.
    """
    watched = stream.withWatermark(event_time, delay)
    if window is None:
        keyed = watched.withColumn("period", F.date_trunc("month", col(event_time)))
        return group_aggregate(keyed, ["period", category], values)
    keyed = watched.withColumn("__window", F.window(col(event_time), window))
    return group_aggregate(keyed, ["__window", category], values).select(
        F.col("__window.start").alias("period"), col(category), *[col(c) for c, _ in values]
    )
