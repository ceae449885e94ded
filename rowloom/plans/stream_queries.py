"""Streaming forms, run over the events table written as several files."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowloom.plans.catalog import query, table
from rowloom.plans.event_queries import _PAYLOADS, payloads
from rowloom.plans.quality_queries import _BROKEN, EVENT_SCHEMA, event_json
from rowloom.session import scratch_path
from rowloom.streaming import streams

FILES = 8


def _as_stream(spark, df, name, max_files=None):
    """The table as a stream over files in the shared folder."""
    path = scratch_path(spark, f"{name}-source")
    df.repartition(FILES).write.parquet(path)
    return streams.open_stream(spark, path, df.schema, max_files=max_files)


def _closed_events(spark, folder):
    """The events and one record of a later time, whose own window stays open."""
    events = table(spark, folder, "events")
    end = events.agg((F.max("ts") + F.expr("INTERVAL 400 DAYS")).cast(events.schema["ts"].dataType).alias("ts"))
    return events.unionByName(end.withColumn("user_id", F.lit(-1).cast(events.schema["user_id"].dataType)), allowMissingColumns=True)


def _run(spark, stream, name):
    """Everything available, through a file sink, read back as a table."""
    out = scratch_path(spark, f"{name}-sink")
    streams.consume_available(stream, out, scratch_path(spark, f"{name}-checkpoint"))
    return spark.read.schema(stream.schema).parquet(out)


@query("stream_consume", "SELECT * FROM events")
def consume(spark, folder):
    """Two runs over a growing folder: the second reads only what is new."""
    events = table(spark, folder, "events")
    source, out, progress = (scratch_path(spark, f"consume-{n}") for n in ("source", "sink", "checkpoint"))
    for part in ("event_type IN ('view', 'click')", "event_type NOT IN ('view', 'click')"):
        events.filter(part).write.mode("append").parquet(source)
        stream = streams.open_stream(spark, source, events.schema, max_files=4)
        streams.consume_available(stream, out, progress)
    return spark.read.schema(events.schema).parquet(out)


@query(
    "stream_filter_extract",
    """SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events
       WHERE event_type = 'purchase' AND CAST(json_extract(props, '$.k') AS BIGINT) >= 50""",
)
def filter_extract(spark, folder):
    stream = _as_stream(spark, table(spark, folder, "events"), "filter")
    chosen = streams.stream_filter(stream, [{"column": "event_type", "op": "==", "value": "purchase"}])
    chosen = streams.stream_filter_by_path(chosen, "props", "k", ">=", 50)
    found = streams.stream_extract(chosen, "props", {"k": "k"}, {"k": "bigint"}).select("event_id", "k")
    return _run(spark, found, "filter")


@query(
    "stream_triage",
    f"""SELECT doc_id, CASE WHEN emptied THEN 'empty' WHEN lang = 'en' THEN 'text' WHEN lang = 'de' THEN 'framed' ELSE 'binary' END AS payload_class,
              CASE WHEN lang = 'de' THEN n_chars END AS schema_id FROM {_PAYLOADS}""",
)
def triage(spark, folder):
    stream = _as_stream(spark, payloads(spark, folder, beside=True), "triage")
    return _run(spark, streams.stream_triage(stream, "payload").select("doc_id", "payload_class", "schema_id"), "triage")


@query("stream_dedupe", "SELECT DISTINCT user_id, event_type FROM events")
def dedupe(spark, folder):
    stream = _as_stream(spark, table(spark, folder, "events"), "dedupe")
    unique = streams.stream_dedupe(stream, ["user_id", "event_type"], "ts", "40 days")
    return _run(spark, unique.select("user_id", "event_type"), "dedupe")


@query(
    "stream_correlate",
    """WITH e AS (SELECT user_id, ts, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS pause FROM events),
            s AS (SELECT *, sum(CASE WHEN pause IS NULL OR pause >= INTERVAL 6 HOUR THEN 1 ELSE 0 END)
                            OVER (PARTITION BY user_id ORDER BY ts) AS session FROM e),
            g AS (SELECT user_id AS join_key, min(ts) AS session_start, max(ts) + INTERVAL 6 HOUR AS session_end, count(*) AS event_count
                  FROM s GROUP BY user_id, session)
       SELECT * FROM g WHERE event_count > 1""",
)
def correlate(spark, folder):
    """All sessions, as the batch answer has them."""
    stream = _as_stream(spark, _closed_events(spark, folder), "correlate")
    found = streams.stream_correlate(stream, "user_id", "ts", "6 hours", "1 hour")
    times = {c: F.col(c).cast("timestamp_ntz") for c in ("session_start", "session_end")}
    return _run(spark, found, "correlate").withColumns(times)


@query(
    "stream_session_events",
    """WITH e AS (SELECT *, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pause FROM events),
            s AS (SELECT *, sum(CASE WHEN pause IS NULL OR pause >= INTERVAL 6 HOUR THEN 1 ELSE 0 END)
                            OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM e)
       SELECT user_id AS join_key, min(ts) OVER w AS session_start,
              row_number() OVER (PARTITION BY user_id, session ORDER BY ts, event_id) AS event_index, ts AS event_time, event_id, value, props
       FROM s WINDOW w AS (PARTITION BY user_id, session) QUALIFY count(*) OVER w > 1""",
)
def session_events(spark, folder):
    """Every event of every session of at least two, as the batch answer has them."""
    stream = _as_stream(spark, _closed_events(spark, folder), "session-events")
    found = streams.stream_session_events(stream, "user_id", "ts", "6 hours", "1 hour", tie="event_id")
    found = found.select("join_key", "session_start", "event_index", "event_time", "record.event_id", "record.value", "record.props")
    times = {c: F.col(c).cast("timestamp_ntz") for c in ("session_start", "event_time")}
    return _run(spark, found, "session-events").withColumns(times)


@query(
    "stream_group_counts",
    """SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY AS window_end,
              event_type, count(*) AS n FROM events GROUP BY ALL""",
)
def group_counts(spark, folder):
    """All daily windows, as the batch answer has them."""
    stream = _as_stream(spark, _closed_events(spark, folder), "counts")
    found = streams.stream_group_counts(stream, "event_type", "ts", "1 day", "2 hours")
    times = {c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "window_end")}
    return _run(spark, found, "counts").withColumns(times)


@query("stream_quality", f"SELECT event_id, errors = '' AS accepted, CAST(len(string_split(errors, ';')) AS INT) AS n_errors FROM ({_BROKEN})")
def quality(spark, folder):
    stream = _as_stream(spark, event_json(spark, folder), "quality", max_files=3)
    accepted, rejected = scratch_path(spark, "accepted"), scratch_path(spark, "rejected")
    streams.stream_quality(stream, "payload", EVENT_SCHEMA, accepted, rejected, scratch_path(spark, "quality-checkpoint"))
    good = spark.read.parquet(accepted).select("event_id", F.lit(True).alias("accepted"), F.lit(1).alias("n_errors"))
    bad = spark.read.parquet(rejected).select("event_id", F.lit(False).alias("accepted"), F.size("errors").alias("n_errors"))
    return good.unionByName(bad)
