"""Event operators on streams; the stateless ones are the batch functions themselves."""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator, Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from rowloom.errors import ToolkitError
from rowloom.functions.columns import as_list, col, require, type_of
from rowloom.operators.json_ops import filter_by_path, json_extract
from rowloom.operators.payload import triage_payload
from rowloom.operators.quality import Rule, validate_events
from rowloom.operators.select import filter_rows
from rowloom.session import DEFAULTS

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"

# S2: the same code in batch and stream
stream_filter = filter_rows
stream_filter_by_path = filter_by_path
stream_extract = json_extract
stream_triage = triage_payload


def open_stream(
    spark: SparkSession, path: str, schema: T.StructType | str, fmt: str = "parquet", max_files: int | None = None
) -> DataFrame:
    """A stream over the files of a folder; ``max_files`` caps a micro-batch, not the stream."""
    reader = spark.readStream.schema(schema).format(fmt)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path)


def consume_available(
    stream: DataFrame, path: str, checkpoint: str, fmt: str = "parquet", wait: bool = True
) -> StreamingQuery:
    """Write everything that is available to ``path`` and stop; the next call reads only what is new.

    Progress lives in ``checkpoint``, so a run cut short goes on where it stopped, without loss or
    double records.
    """
    query = (
        stream.writeStream.format(fmt)
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    if wait:
        query.awaitTermination()
    return query


def _event_time(stream: DataFrame, ts: str) -> Column:
    """Watermarks need a timestamp with zone; a zone-less one is read in the session's zone."""
    dtype = type_of(stream, ts)
    if isinstance(dtype, T.TimestampType):
        return col(ts)
    if isinstance(dtype, T.TimestampNTZType):
        return col(ts).cast("timestamp")
    raise ToolkitError(f"column {ts!r} is not a timestamp")


def stream_dedupe(stream: DataFrame, id_cols: str | Sequence[str], ts: str, delay: str) -> DataFrame:
    """The first arrival per id; state is kept for ``delay`` beyond an id's event time.

    Records without id are skipped. Later copies that arrive after the state is gone pass again.
    """
    names = require(stream, id_cols)
    for name in names:
        stream = stream.filter(col(name).isNotNull())
    return stream.withColumn(ts, _event_time(stream, ts)).withWatermark(ts, delay).dropDuplicatesWithinWatermark(names)


def stream_correlate(stream: DataFrame, key: str, ts: str, gap: str, delay: str, batch: str | None = None) -> DataFrame:
    """Sessions of at least two events of a key, no two neighbours more than ``gap`` apart.

    Columns: ``join_key, session_start, session_end, event_count`` and, with ``batch``, the sorted
    set of its values in the session. State holds one such row per open session, never its events.
    A session is given out once the watermark has passed its end.
    """
    require(stream, [key, ts] + ([batch] if batch else []))
    kept = stream.filter(col(key).isNotNull() & col(ts).isNotNull()).withColumn(ts, _event_time(stream, ts))
    outputs = [F.count(F.lit(1)).alias("event_count")]
    if batch:
        outputs.append(F.sort_array(F.collect_set(col(batch))).alias("batches"))
    sessions = (
        kept.withWatermark(ts, delay).groupBy(F.session_window(col(ts), gap).alias("w"), col(key).alias("join_key")).agg(*outputs)
    )
    return sessions.filter(F.col("event_count") > 1).select(
        "join_key",
        F.col("w.start").alias("session_start"),
        F.col("w.end").alias("session_end"),
        "event_count",
        *(["batches"] if batch else []),
    )


class _SessionEvents(StatefulProcessor):
    """State of a key: events not yet passed by the watermark, and the session that the passed ones ended in.

    An event that the watermark has passed can get no earlier neighbour any more, so its session and its place in it are
    known; it is given out and forgotten. What stays of a session is its start, its last time and a count, until the
    watermark has passed the last time by the gap. A session that is still too short keeps its few events as well.

    State holds many events as one binary value, with the earliest time: values of any type come back as they were, and a
    row of state is not paid for each event.
    """

    EVENTS = "micros long, packed binary"
    PACKED = 1000

    def __init__(self, gap: int, least: int):
        self.gap, self.least = gap, least

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.EVENTS)
        self.short = handle.getListState("short", self.EVENTS)
        self.session = handle.getValueState("session", "start long, last long, n long")

    def _wake(self, micros: int) -> None:
        self.handle.registerTimer(-(-micros // 1000))

    @staticmethod
    def _held(state) -> list[tuple]:
        return [e for r in state.get() for e in pickle.loads(bytes(r[1]))]

    def _packed(self, events: list[tuple]) -> list[tuple[int, bytes]]:
        parts = [events[i : i + self.PACKED] for i in range(0, len(events), self.PACKED)]
        return [(min(e[0] for e in part), pickle.dumps(part, 5)) for part in parts]

    def _hold(self, state, events: list[tuple]) -> None:
        if events:
            state.put(self._packed(events))
        else:
            state.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        # columns: key, time, micros, record and what orders events of one time
        events = [(r[2], [(v is not None, v) for v in r[4:]], r[3]) for r in rows]
        self.waiting.appendList(self._packed(events))
        self._wake(min(e[0] for e in events))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        # every call of a state is a round trip, so nothing is read or written that cannot have changed
        now = timerValues.getCurrentWatermarkInMs() * 1000
        events = self._held(self.waiting)
        passed = [e for e in events if e[0] <= now]
        before = self.session.get()
        held = self._held(self.short) if before and before[2] < self.least else []
        out, session, short = self._given_out(key[0], passed, before, held)
        if passed:
            rest = [e for e in events if e[0] > now]
            self._hold(self.waiting, rest)
            if rest:
                self._wake(min(e[0] for e in rest))
        if session is not None:
            end = session[1] + self.gap
            if now >= end:
                session, short = None, []
            else:
                self._wake(end)
        if session is None and before is not None:
            self.session.clear()
        elif session is not None and passed:
            self.session.update(session)
        if short != held:
            self._hold(self.short, short)
        return iter(out)

    def _given_out(self, key, events: list[tuple], session: tuple | None, short: list[tuple]) -> tuple:
        """What comes out, the last session and its events if it is still too short."""
        if not events:
            return [], session, short
        start, last, n = session or (None, None, 0)
        out, short = [], list(short)
        for event in sorted(events, key=lambda e: e[:2]):
            if last is None or event[0] - last >= self.gap:
                start, n, short = event[0], 0, []
            last, n = event[0], n + 1
            short.append(event)
            if n >= self.least:
                for i, (micros, _, record) in enumerate(short, n - len(short) + 1):
                    out.append(Row(join_key=key, session_start=start, event_index=i, event_time=micros, record=record))
                short = []
        return out, (start, last, n), short


def stream_session_events(
    stream: DataFrame, key: str, ts: str, gap: str, delay: str, tie: str | Sequence[str] = (), min_events: int = 2
) -> DataFrame:
    """The events of the sessions that :func:`stream_correlate` counts, each with its session and its place in it.

    Columns: ``join_key, session_start, event_index, event_time, record``; a session of a key is identified by its start.
    ``tie`` names columns that order events of one time (else a hash of the record does). Sessions of fewer than
    ``min_events`` events are left out; records without key or time too.

    An event comes out once the watermark (the latest time seen less ``delay``) has passed it, which fixes its place; an
    event that arrives later than that is dropped. So state holds the events of the last ``delay`` of time, one small
    row per session not yet ended by ``gap``, and the events of sessions that are still too short. The session's state
    store is set to RocksDB.
    """
    ties = require(stream, as_list(tie))
    require(stream, [key, ts])
    if min_events < 1:
        raise ToolkitError("min_events must be positive")
    if not re.fullmatch(r"[\w .+-]+", gap):
        raise ToolkitError(f"{gap!r} is not an interval")
    # keyed state with lists and timers needs this store; a query that runs already keeps the one it started with
    stream.sparkSession.conf.set(STATE_STORE, DEFAULTS[STATE_STORE])
    pause = stream.sparkSession.range(1).select(F.unix_micros(F.timestamp_micros(F.lit(0)) + F.expr(f"INTERVAL '{gap}'")))
    plain = [f.name for f in stream.schema.fields if not any(t in f.dataType.simpleString() for t in ("map<", "variant"))]
    order = [col(t) for t in ties] or [F.xxhash64(*[col(c) for c in plain])]
    event = F.struct(*[col(c) for c in stream.columns])
    timed = stream.filter(col(key).isNotNull() & col(ts).isNotNull()).withColumn("__time", _event_time(stream, ts))
    rows = timed.withWatermark("__time", delay).select(
        col(key).alias("join_key"),
        "__time",
        F.unix_micros("__time").alias("micros"),
        event.alias("record"),
        *[tie.alias(f"tie_{i}") for i, tie in enumerate(order)],
    )
    output = T.StructType(
        [
            T.StructField("join_key", rows.schema["join_key"].dataType),
            T.StructField("session_start", T.LongType()),
            T.StructField("event_index", T.LongType()),
            T.StructField("event_time", T.LongType()),
            rows.schema["record"],
        ]
    )
    found = rows.groupBy("join_key").transformWithState(
        _SessionEvents(pause.first()[0], min_events), output, "append", "eventTime"
    )
    return found.withColumns({c: F.timestamp_micros(c) for c in ("session_start", "event_time")})


def stream_group_counts(
    stream: DataFrame, keys: str | Sequence[str], ts: str, window: str, delay: str, slide: str | None = None
) -> DataFrame:
    """(window_start, window_end, keys..., n) per tumbling or sliding window.

    A window is given out once the watermark has passed its end; later records for it are dropped.
    """
    names = require(stream, as_list(keys))
    timed = stream.withColumn(ts, _event_time(stream, ts)).withWatermark(ts, delay)
    counts = timed.groupBy(F.window(col(ts), window, slide).alias("w"), *[col(k) for k in names]).agg(
        F.count(F.lit(1)).alias("n")
    )
    return counts.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *[col(k) for k in names], "n")


def stream_quality(
    stream: DataFrame,
    column: str,
    rules: Sequence[Rule] | Mapping[str, Any],
    accepted: str,
    rejected: str,
    checkpoint: str,
    wait: bool = True,
) -> StreamingQuery:
    """Split a stream of JSON events into valid and rejected ones, the latter with their errors.

    Each micro-batch writes folders named after its id and replaces them if it is run again, so a
    restart neither loses nor doubles events.
    """

    def split(batch: DataFrame, batch_id: int) -> None:
        checked = validate_events(batch, column, rules).persist()  # used by both writes
        try:
            good = checked.filter("valid").drop("valid", "errors")
            good.write.mode("overwrite").parquet(f"{accepted}/batch_id={batch_id}")
            checked.filter("NOT valid").drop("valid").write.mode("overwrite").parquet(f"{rejected}/batch_id={batch_id}")
        finally:
            checked.unpersist()

    query = stream.writeStream.foreachBatch(split).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    if wait:
        query.awaitTermination()
    return query
