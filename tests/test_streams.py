"""Streaming forms: progress, late data, state, idempotent outputs."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from rowloom.errors import ToolkitError
from rowloom.streaming import streams

SCHEMA = "id int, k string, t timestamp"


def at(minutes: int) -> dt.datetime:
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minutes)


class Feed:
    """A folder that grows by one file per call, and a sink with its checkpoint."""

    def __init__(self, spark, path, schema=SCHEMA):
        self.spark, self.schema = spark, schema
        self.source, self.out, self.checkpoint = (str(path / n) for n in ("source", "out", "checkpoint"))

    def add(self, *data):
        self.spark.createDataFrame(list(data), self.schema).coalesce(1).write.mode("append").parquet(self.source)

    def stream(self):
        return streams.open_stream(self.spark, self.source, self.schema)

    def run(self, stream):
        streams.consume_available(stream, self.out, self.checkpoint)
        return self.spark.read.schema(stream.schema).parquet(self.out)


def test_second_run_reads_only_new_files(spark, tmp_path):
    feed = Feed(spark, tmp_path)
    feed.add((1, "a", at(0)), (2, "b", at(1)))
    assert feed.run(feed.stream()).count() == 2
    assert feed.run(feed.stream()).count() == 2
    feed.add((3, "c", at(2)))
    assert feed.run(feed.stream()).count() == 3


def test_dedupe_across_runs(spark, tmp_path, rows):
    feed = Feed(spark, tmp_path)

    def unique():
        return streams.stream_dedupe(feed.stream(), "k", "t", "1 hour")

    feed.add((1, "a", at(0)), (2, None, at(0)))
    feed.run(unique())
    feed.add((3, "a", at(5)), (4, "b", at(6)))
    assert rows(feed.run(unique()), "id", "k") == [(1, "a"), (4, "b")]


def test_late_records_are_dropped(spark, tmp_path, rows):
    feed = Feed(spark, tmp_path)

    def counts():
        return streams.stream_group_counts(feed.stream(), "k", "t", "10 minutes", "5 minutes")

    feed.add((1, "a", at(1)), (2, "a", at(2)), (3, "a", at(60)))
    feed.run(counts())
    feed.add((4, "a", at(3)), (5, "a", at(90)))  # minute 3 lies behind the watermark of minute 55
    found = feed.run(counts())
    assert rows(found, "window_start", "k", "n") == [(at(0), "a", 2), (at(60), "a", 1)]


def test_sliding_windows(spark, tmp_path):
    feed = Feed(spark, tmp_path)
    feed.add((1, "a", at(7)), (2, "a", at(200)))
    found = feed.run(streams.stream_group_counts(feed.stream(), "k", "t", "10 minutes", "1 minute", slide="5 minutes"))
    assert found.filter(F.col("n") == 1).count() == 2


def test_sessions(spark, tmp_path, rows):
    feed = Feed(spark, tmp_path)

    def sessions():
        return streams.stream_correlate(feed.stream(), "k", "t", "10 minutes", "5 minutes", batch="id")

    feed.add((1, "a", at(0)), (1, "b", at(1)), (2, "a", at(8)))
    feed.run(sessions())
    feed.add((3, "a", at(16)), (9, None, at(17)), (9, "z", at(300)))
    found = feed.run(sessions())
    assert rows(found, "join_key", "session_start", "event_count", "batches") == [("a", at(0), 3, [1, 2, 3])]


def session_rows(found):
    return sorted((r["join_key"], r["session_start"], r["event_index"], r["event_time"], r["record"]["id"]) for r in found.collect())


def test_session_events(spark, tmp_path):
    """Events come out in their order as the watermark passes them, over several runs; late ones are dropped."""
    feed = Feed(spark, tmp_path)

    def events():
        return streams.stream_session_events(feed.stream(), "k", "t", "10 minutes", "5 minutes", tie="id")

    feed.add((1, "a", at(0)), (5, "b", at(1)), (3, "a", at(8)), (2, "a", at(8)), (9, None, at(3)), (9, "a", None))
    assert session_rows(feed.run(events())) == []  # one event only lies behind the watermark of minute 3
    feed.add((4, "a", at(6)), (7, "a", at(17)), (6, "b", at(11)), (8, "c", at(30)))
    first = [("a", at(0), i, at(t), n) for i, t, n in ((1, 0, 1), (2, 6, 4), (3, 8, 2), (4, 8, 3), (5, 17, 7))]
    # b's events are ten minutes apart, so neither has a neighbour
    assert session_rows(feed.run(events())) == first
    feed.add((10, "a", at(20)), (11, "a", at(26)), (12, "a", at(29)), (13, "z", at(300)))  # minute 20 is behind 25
    assert session_rows(feed.run(events())) == [*first, ("a", at(0), 6, at(26), 11), ("a", at(0), 7, at(29), 12)]


def test_session_events_keep_values_and_drop_state(spark, tmp_path):
    schema = "k long, t timestamp_ntz, s string, d decimal(20,3), l array<int>, m map<string,double>, n struct<x:int,y:date>, b binary"
    feed = Feed(spark, tmp_path, schema)
    rest = ("é", dt.date(2024, 1, 2))
    values = [(1, at(i), rest[0], Decimal("1.250"), [1, None], {"a": 0.5}, (None, rest[1]), b"\x00") for i in range(300)]
    feed.add(*values)
    feed.add(*[(k, at(10_000), None, None, None, None, None, None) for k in range(2, 40)])
    feed.add((0, at(90_000), None, None, None, None, None, None))
    stream = streams.stream_session_events(feed.stream(), "k", "t", "90 seconds", "1 second")
    query = streams.consume_available(stream, feed.out, feed.checkpoint)
    found = spark.read.parquet(feed.out).orderBy("event_index").collect()
    assert [tuple(r["record"])[:-2] for r in found] == [v[:-2] for v in values]
    assert all(tuple(r["record"]["n"]) == (None, rest[1]) and bytes(r["record"]["b"]) == b"\x00" for r in found)
    # only the last event, which nothing has passed, is still held with its timer
    rows = query.recentProgress[-1].stateOperators[0].numRowsTotal
    assert rows <= 4


class CountedState:
    """State of one key that counts the calls, each of which is a round trip."""

    def __init__(self, calls, is_list):
        self.calls, self.is_list, self.value = calls, is_list, None

    def __getattr__(self, name):
        def call(value=None):
            self.calls.append(name)
            if name == "get":
                return iter(self.value or []) if self.is_list else self.value
            if name == "exists":
                return self.value is not None
            self.value = [*(self.value or []), *value] if name == "appendList" else value
            return None

        return call


def test_session_events_need_few_state_calls(spark):
    calls = []

    class Handle:
        def getListState(self, name, schema):
            return CountedState(calls, True)

        def getValueState(self, name, schema):
            return CountedState(calls, False)

        def registerTimer(self, at):
            calls.append("timer")

    class Now:
        def getCurrentWatermarkInMs(self):
            return 1500

    processor = streams._SessionEvents(10_000, 2)
    processor.init(Handle())
    list(processor.handleInputRows(("a",), iter([("a", None, i * 1000, (i,), i) for i in range(2000)]), None))
    assert len(processor.waiting.value) == 2 and len(calls) == 2
    found = list(processor.handleExpiredTimer(("a",), Now(), None))
    assert [r["record"][0] for r in found] == list(range(1501)) and len(processor.waiting.value) == 1
    assert len(calls) <= 8


def test_short_sessions(spark, tmp_path):
    feed = Feed(spark, tmp_path)
    feed.add(*[(i, "a", at(t)) for i, t in enumerate((0, 1, 50, 51, 52, 100))], (99, "z", at(900)))

    def starts(n):
        out = streams.stream_session_events(feed.stream(), "k", "t", "5 minutes", "0 seconds", min_events=n)
        path, progress = str(tmp_path / f"out{n}"), str(tmp_path / f"progress{n}")
        streams.consume_available(out, path, progress)
        return [r[1:4] for r in session_rows(spark.read.schema(out.schema).parquet(path))]

    long = [(at(50), 1, at(50)), (at(50), 2, at(51)), (at(50), 3, at(52))]
    pair = [(at(0), 1, at(0)), (at(0), 2, at(1))]
    assert starts(3) == long and starts(2) == pair + long
    assert starts(1)[:6] == pair + long + [(at(100), 1, at(100))]
    with pytest.raises(ToolkitError):
        starts(0)
    with pytest.raises(ToolkitError):
        streams.stream_session_events(feed.stream(), "k", "t", "5') --", "1 hour")


def test_quality_outputs(spark, tmp_path):
    feed = Feed(spark, tmp_path, "id int, j string")
    good, bad = str(tmp_path / "good"), str(tmp_path / "bad")
    schema = {"required": ["a"]}
    feed.add((1, '{"a":1}'), (2, "{}"))
    streams.stream_quality(feed.stream(), "j", schema, good, bad, feed.checkpoint)
    feed.add((3, "broken"))
    streams.stream_quality(feed.stream(), "j", schema, good, bad, feed.checkpoint)
    assert sorted(r["id"] for r in spark.read.parquet(good).collect()) == [1]
    assert sorted(r["id"] for r in spark.read.parquet(bad).collect()) == [2, 3]


def test_stateless_forms_are_the_batch_functions(spark, tmp_path, rows):
    feed = Feed(spark, tmp_path, "id int, j string")
    feed.add((1, '{"a":5}'), (2, '{"a":1}'), (3, "bad"))

    def both(df):
        return streams.stream_extract(streams.stream_filter_by_path(df, "j", "a", ">", 2), "j", {"a": "a"})

    batch = spark.read.parquet(feed.source)
    assert rows(feed.run(both(feed.stream())), "id", "a") == rows(both(batch), "id", "a") == [(1, "5")]


def test_event_time_must_be_a_timestamp(spark, tmp_path):
    feed = Feed(spark, tmp_path)
    feed.add((1, "a", at(0)))
    with pytest.raises(ToolkitError):
        streams.stream_dedupe(feed.stream(), "k", "id", "1 hour")
