"""Queries for JSON, events, log positions and text search."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowloom.operators import events as event_ops
from rowloom.operators import flatten, json_ops, payload, positions, search
from rowloom.plans.catalog import query, table
from rowloom.sources.envelope import to_envelope

# Envelopes made from the events table. The offset is the event id, which rises within each
# partition and, as in a compacted log, leaves gaps.
_VALUE = """concat('{"user":', user_id, ',"kind":"', event_type, '","value":', value, ',"detail":', props, '}')"""
_ENVELOPE_SQL = f"""
    SELECT CAST(user_id % 4 AS INT) AS "partition", event_id AS "offset", epoch_us(ts) // 1000 AS "timestamp",
           CAST(user_id AS VARCHAR) AS "key", {_VALUE} AS "value", user_id, event_type, props, value AS amount, event_id FROM events"""


def envelope(spark, folder, value=_VALUE):
    raw = table(spark, folder, "events").select(
        F.expr("CAST(user_id % 4 AS INT)").alias("partition"),
        F.col("event_id").alias("offset"),
        F.col("ts").alias("timestamp"),
        F.col("user_id").cast("string").alias("key"),
        F.expr(value).alias("value"),
        F.expr("map('kind', event_type)").alias("headers"),
    )
    return to_envelope(raw)


# --- F1 - F3 -------------------------------------------------------------------------------------


@query("json_extract_scalar", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def extract_scalar(spark, folder):
    events = table(spark, folder, "events").select("event_id", "props")
    return json_ops.json_extract(events, "props", {"k": "k"}, {"k": "bigint"}).drop("props")


@query(
    "json_extract_nested",
    """SELECT CAST(user_id AS VARCHAR) AS "key", event_id AS "offset", CAST(json_extract(props, '$.k') AS BIGINT) AS detail_k,
              event_type AS kind, value AS amount FROM events""",
)
def extract_nested(spark, folder):
    found = json_ops.json_extract(
        envelope(spark, folder),
        "value",
        {"detail_k": "detail.k", "kind": "kind", "amount": "value"},
        {"detail_k": "bigint", "amount": "double"},
    )
    return found.select("key", "offset", "detail_k", "kind", "amount")


# orders as JSON documents: an object with an array of objects
_LINE = """concat('{"line":', l_linenumber, ',"qty":', CAST(l_quantity AS INT), ',"flag":"', l_returnflag, '"}')"""


# the documents with ``beside``: those of all orders, and the broken texts, which are not valid
_DOCUMENTS = "(SELECT *, TRUE AS valid FROM orders UNION ALL SELECT *, FALSE FROM orders WHERE o_orderpriority = '1-URGENT')"


def order_documents(spark, folder, broken=False, beside=False):
    """Every order as JSON text; ``broken`` puts a sign too many before some, ``beside`` before a second text of these."""
    lines = table(spark, folder, "lineitem").select("l_orderkey", F.expr(_LINE).alias("line"))
    arrays = lines.groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_list("line")), ",").alias("items"))
    # both sides by order key: the documents then lie in many partitions, however few files the orders have
    orders = table(spark, folder, "orders").repartition("o_orderkey").join(arrays, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    text = """concat('{"id":', o_orderkey, ',"buyer":{"key":', o_custkey, ',"segment":{"status":"', o_orderstatus, '"}},',
              '"total":', CAST(CAST(o_totalprice AS INT) AS STRING), ',"items":[', coalesce(items, ''), ']}')"""
    if broken:
        text = f"concat(CASE WHEN o_orderpriority = '1-URGENT' THEN ']' ELSE '' END, {text})"
    if beside:
        orders = orders.withColumn("sign", F.expr("explode(CASE WHEN o_orderpriority = '1-URGENT' THEN array('', ']') ELSE array('') END)"))
        text = f"concat(sign, {text})"
    return orders.select("o_orderkey", F.expr(text).alias("doc"))


@query(
    "json_extract_projection",
    f"""SELECT o_orderkey, CASE WHEN valid THEN coalesce(big, '') END AS big_flags, CASE WHEN valid THEN coalesce(n, 0) END AS n_items,
              CASE WHEN valid THEN o_orderstatus END AS status
       FROM {_DOCUMENTS} LEFT JOIN (SELECT l_orderkey,
              string_agg(l_returnflag, ',' ORDER BY '{{"line":' || l_linenumber || ',"qty":' || CAST(l_quantity AS INT) || ',"flag":"' || l_returnflag)
                FILTER (WHERE l_quantity > 30) AS big, CAST(count(*) AS INT) AS n
              FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey""",
)
def extract_projection(spark, folder):
    found = json_ops.json_extract(
        order_documents(spark, folder, beside=True),
        "doc",
        {"big": "items[?qty > `30`].flag", "lines": "items[*].line", "status": "buyer.segment.status"},
        {"big": "array<string>", "lines": "array<bigint>"},
    )
    return found.select(
        "o_orderkey",
        F.when(F.col("big").isNotNull(), F.array_join("big", ",")).alias("big_flags"),
        F.when(F.col("lines").isNotNull(), F.size("lines")).alias("n_items"),
        "status",
    )


@query(
    "json_extract_object",
    f"""SELECT o_orderkey, CASE WHEN valid THEN concat('{{"buyer":', o_custkey, ',"no":', o_orderkey, '}}') END AS picked FROM {_DOCUMENTS}""",
)
def extract_object(spark, folder):
    return json_ops.json_extract(
        order_documents(spark, folder, beside=True), "doc", {"picked": "{no: id, buyer: buyer.key}"}
    ).select("o_orderkey", "picked")


@query("filter_by_path", f"""SELECT "partition", "offset", "value" FROM ({_ENVELOPE_SQL}) WHERE user_id = 7""")
def filter_by_path(spark, folder):
    return json_ops.filter_by_path(envelope(spark, folder), "value", "user", "==", 7).select("partition", "offset", "value")


@query(
    "filter_by_path_truthy",
    f"SELECT o_orderkey FROM {_DOCUMENTS} WHERE valid AND o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 40)",
)
def filter_truthy(spark, folder):
    return json_ops.filter_by_path(order_documents(spark, folder, beside=True), "doc", "items[?qty > `40`]").select("o_orderkey")


@query(
    "group_by_path",
    f"""WITH e AS ({_ENVELOPE_SQL}), c AS (SELECT CAST(json_extract(props, '$.k') AS VARCHAR) AS k, * FROM e),
             top AS (SELECT k, count(*) AS n FROM c GROUP BY k ORDER BY n DESC, k LIMIT 20),
             r AS (SELECT c.*, row_number() OVER (PARTITION BY k ORDER BY "partition", "offset") AS rn FROM c)
        SELECT top.k AS group_key, n, string_agg(CAST("offset" AS VARCHAR), ',' ORDER BY "partition", "offset") AS examples
        FROM top JOIN r ON top.k = r.k AND rn <= 10 GROUP BY ALL""",
)
def group_by_path(spark, folder):
    groups = json_ops.group_by_path(envelope(spark, folder), "value", "detail.k", ["partition", "offset"], max_groups=20)
    offsets = F.concat_ws(",", F.transform("examples", lambda r: r["offset"].cast("string")))
    return groups.select("group_key", "n", offsets.alias("examples"))


@query(
    "group_by_path_all",
    f"""WITH e AS ({_ENVELOPE_SQL}),
             r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY "partition", "offset") AS rn,
                          count(*) OVER (PARTITION BY user_id) AS n FROM e)
        SELECT CAST(user_id AS VARCHAR) AS group_key, n, string_agg(CAST("offset" AS VARCHAR), ',' ORDER BY "partition", "offset") AS examples
        FROM r WHERE rn <= 10 GROUP BY ALL""",
)
def group_by_path_all(spark, folder):
    groups = json_ops.group_by_path(envelope(spark, folder), "value", "user", ["partition", "offset"])
    offsets = F.concat_ws(",", F.transform("examples", lambda r: r["offset"].cast("string")))
    return groups.select("group_key", "n", offsets.alias("examples"))


# --- F4, F5 --------------------------------------------------------------------------------------

@query(
    "parse_json_targets",
    f"""SELECT o_orderkey, o_orderkey AS id, o_custkey AS "buyer.key", o_orderstatus AS "buyer.segment.status",
               CAST(NULL AS VARCHAR) AS absent FROM {_DOCUMENTS} WHERE valid""",
)
def parse_targets(spark, folder):
    targets = {"id": "bigint", "buyer.key": "bigint", "buyer.segment.status": "string", "absent": "string"}
    return flatten.parse_json_column(order_documents(spark, folder, beside=True), "doc", targets)


@query(
    "parse_json_discovered",
    f"""SELECT o_orderkey, o_orderkey AS id, o_custkey AS "buyer.key", '{{"status":"' || o_orderstatus || '"}}' AS "buyer.segment",
               CAST(trunc(o_totalprice) AS BIGINT) AS total, items
        FROM orders LEFT JOIN (
          SELECT l_orderkey, '[' || string_agg(t, ',' ORDER BY s) || ']' AS items FROM (
            SELECT l_orderkey, '{{"line":' || l_linenumber || ',"qty":' || CAST(l_quantity AS INT) || ',"flag":"' || l_returnflag || '"}}' AS s,
                   '{{"flag":"' || l_returnflag || '","line":' || l_linenumber || ',"qty":' || CAST(l_quantity AS INT) || '}}' AS t
            FROM lineitem) GROUP BY l_orderkey) ON l_orderkey = o_orderkey""",
)
def parse_discovered(spark, folder):
    return flatten.parse_json_column(order_documents(spark, folder), "doc")


@query(
    "parse_json_expanded",
    """SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS line, CAST(l_quantity AS BIGINT) AS qty, l_returnflag AS flag
       FROM lineitem WHERE l_linestatus = 'O' OR l_returnflag <> 'R'""",
)
def parse_expanded(spark, folder):
    # array elements of three kinds: objects, objects as quoted text, and broken quoted text
    quoted = f"concat('\"', replace({_LINE}, '\"', '\\\\\"'), '\"')"
    item = f"""CASE WHEN l_linestatus = 'O' THEN {_LINE} WHEN l_returnflag <> 'R' THEN {quoted}
               ELSE concat('"', '{{broken ', l_linenumber, '"') END"""
    lines = table(spark, folder, "lineitem").select("l_orderkey", F.expr(item).alias("line"))
    docs = lines.groupBy("l_orderkey").agg(F.concat(F.lit("["), F.array_join(F.collect_list("line"), ","), F.lit("]")).alias("doc"))
    return flatten.parse_json_column(docs, "doc", {"line": "bigint", "qty": "bigint", "flag": "string"}, expand_arrays=True)


@query(
    "json_defects",
    """SELECT count(*) AS "rows", CAST(0 AS BIGINT) AS missing, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS invalid,
              count(*) FILTER (WHERE o_orderpriority <> '1-URGENT') AS valid FROM orders""",
)
def json_defects(spark, folder):
    return flatten.json_defects(order_documents(spark, folder, broken=True), "doc")


@query(
    "flatten_envelope",
    f"""SELECT "partition", "offset", "timestamp", "key", CAST(json_extract(props, '$.k') AS BIGINT) AS detail_k,
               CASE WHEN amount >= 5 THEN event_type END AS kind, CAST(NULL AS VARCHAR) AS header_kind_base64, event_type AS header_kind,
               CASE WHEN amount >= 5 THEN user_id END AS "user", CASE WHEN amount < 5 THEN 'plain ' || event_type END AS "value",
               CASE WHEN amount >= 5 THEN amount END AS value_value
        FROM (SELECT * REPLACE (CASE WHEN amount >= 5 THEN props END AS props) FROM ({_ENVELOPE_SQL}))""",
)
def flatten_envelope(spark, folder):
    # small amounts become plain text, which stays whole in the value column
    mixed = envelope(spark, folder, f"CASE WHEN value < 5 THEN concat('plain ', event_type) ELSE {_VALUE} END")
    return flatten.flatten_envelope(mixed)


# --- F6 - F8 -------------------------------------------------------------------------------------


@query(
    "fingerprint",
    """SELECT event_id, sha256('{"event_id": ' || event_id || ', "event_type": "' || event_type || '"}') AS fingerprint FROM events""",
)
def fingerprint(spark, folder):
    events = table(spark, folder, "events")
    return event_ops.fingerprint(events, ["event_type", "event_id", "absent"]).select("event_id", "fingerprint")


@query(
    "fingerprint_escapes",
    r"""SELECT event_id, sha256('{"t": "' || repeat('\\', event_id % 450) || '\u00c9\u00fc"}') AS fingerprint FROM events""",
)
def fingerprint_escapes(spark, folder):
    """Up to 449 backslashes before a letter that is escaped."""
    text = F.concat(F.expr(r"repeat('\\', CAST(event_id % 450 AS INT))"), F.lit("\u00c9\u00fc"))
    events = table(spark, folder, "events").select("event_id", text.alias("t"))
    return event_ops.fingerprint(events, ["t"]).select("event_id", "fingerprint")


@query(
    "fingerprint_all_fields",
    """SELECT p_partkey, sha256('{"p_brand": "' || p_brand || '", "p_name": "' || p_name || '", "p_partkey": ' || p_partkey
              || ', "p_retailprice": ' || p_retailprice || ', "p_size": ' || p_size || ', "p_type": "' || p_type || '"}') AS fingerprint
       FROM part""",
)
def fingerprint_all(spark, folder):
    return event_ops.fingerprint(table(spark, folder, "part")).select("p_partkey", "fingerprint")


@query(
    "dedupe_by_columns",
    """SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rn FROM events)
       WHERE rn = 1""",
)
def dedupe_columns(spark, folder):
    return event_ops.dedupe_by_id(table(spark, folder, "events"), ["ts", "event_id"], id_cols=["user_id", "event_type"])


@query(
    "dedupe_by_path",
    """SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey) AS rn
       FROM orders) WHERE rn = 1""",
)
def dedupe_path(spark, folder):
    # the id is an object: {"key": ..., "segment": {...}}
    docs = order_documents(spark, folder)
    return event_ops.dedupe_by_id(docs, "o_orderkey", column="doc", path="buyer").select("o_orderkey")


@query(
    "dedupe_counts",
    f"""SELECT (SELECT count(*) FROM {_DOCUMENTS}) AS original_count,
              (SELECT count(*) FROM (SELECT DISTINCT o_custkey, o_orderstatus FROM {_DOCUMENTS} WHERE valid)) AS unique_count,
              (SELECT count(*) FROM {_DOCUMENTS} WHERE NOT valid) AS skipped_count""",
)
def dedupe_counts(spark, folder):
    return event_ops.dedupe_counts(order_documents(spark, folder, beside=True), column="doc", path="buyer")


_CORRELATED = """
    SELECT * FROM (
      SELECT user_id AS join_key, count(*) OVER (PARTITION BY user_id) AS event_count,
             row_number() OVER (PARTITION BY user_id ORDER BY ts, batch, event_id) AS event_index, batch, ts AS event_time, event_id
      FROM (SELECT *, list_position(['click', 'error', 'purchase', 'signup', 'view'], event_type) - 1 AS batch FROM events))
    WHERE event_count > 1"""


def _batches(spark, folder):
    """All events, one batch for each of the types."""
    events = table(spark, folder, "events")
    return [events.filter(F.col("event_type") == kind) for kind in ("click", "error", "purchase", "signup", "view")]


@query("correlate", _CORRELATED)
def correlate(spark, folder):
    found = event_ops.correlate(_batches(spark, folder), "user_id", "ts", tie="event_id")
    return found.withColumn("event_id", F.col("record.event_id")).drop("record")


@query(
    "correlate_nested",
    f"""SELECT join_key, event_count, CAST((event_index - 1) // 25 AS INT) AS part,
               string_agg(batch || ':' || event_id, ',' ORDER BY event_index) AS events
        FROM ({_CORRELATED}) GROUP BY ALL""",
)
def correlate_nested(spark, folder):
    found = event_ops.correlate_nested(_batches(spark, folder), "user_id", "ts", tie="event_id", part_size=25)
    text = F.transform("events", lambda e: F.concat(e["batch"].cast("string"), F.lit(":"), e["record"]["event_id"].cast("string")))
    return found.withColumn("events", F.concat_ws(",", text))


# --- F9, F10 -------------------------------------------------------------------------------------


# the payloads with ``beside``: those of all documents, and the empty ones
_EMPTIED = "CASE WHEN lang IN ('en', 'de', 'fr') THEN FALSE ELSE n_chars > 500 END"
_PAYLOADS = f"(SELECT *, FALSE AS emptied FROM documents UNION ALL SELECT *, TRUE FROM documents WHERE {_EMPTIED})"


def payloads(spark, folder, beside=False):
    """Documents as log payloads: framed, text, control-heavy and invalid UTF-8; whole texts in each.

    ``beside`` adds a second, empty payload of some.
    """
    raw = """CASE lang WHEN 'en' THEN encode(text, 'UTF-8')
                       WHEN 'de' THEN unhex(concat('00', lpad(hex(n_chars), 8, '0'), hex(encode(text, 'UTF-8'))))
                       WHEN 'fr' THEN unhex(concat('FF', hex(encode(text, 'UTF-8'))))
                       ELSE unhex(concat(repeat('0102', CAST(n_chars AS INT)), hex(encode(text, 'UTF-8')))) END"""
    documents = table(spark, folder, "documents")
    if beside:
        documents = documents.withColumn("emptied", F.expr(f"explode(CASE WHEN {_EMPTIED} THEN array(false, true) ELSE array(false) END)"))
        raw = f"CASE WHEN emptied THEN CAST('' AS BINARY) ELSE {raw} END"
    return documents.select("doc_id", F.expr(raw).alias("payload"))


@query(
    "triage_payload",
    """SELECT doc_id, CASE lang WHEN 'en' THEN 'text' WHEN 'de' THEN 'framed' ELSE 'binary' END AS payload_class,
              CASE WHEN lang = 'de' THEN n_chars END AS schema_id,
              CASE lang WHEN 'en' THEN md5(text) WHEN 'fr' THEN md5(base64(from_hex('FF' || hex(encode(text)))))
                   WHEN 'es' THEN md5(base64(from_hex(repeat('0102', n_chars) || hex(encode(text))))) END AS text_md5,
              CASE WHEN lang = 'de' THEN md5(text) END AS body_md5
       FROM documents""",
)
def triage(spark, folder):
    found = payload.triage_payload(payloads(spark, folder), "payload")
    return found.select(
        "doc_id",
        "payload_class",
        "schema_id",
        F.md5(F.replace("payload_text", F.lit("\r\n"), F.lit(""))).alias("text_md5"),
        F.md5("payload_body").alias("body_md5"),
    )


@query(
    "triage_counts",
    f"""SELECT CASE WHEN emptied THEN 'empty' WHEN lang = 'en' THEN 'text' WHEN lang = 'de' THEN 'framed' ELSE 'binary' END AS payload_class,
              CASE WHEN lang = 'de' THEN n_chars END AS schema_id, count(*) AS n FROM {_PAYLOADS} GROUP BY ALL""",
)
def triage_counts(spark, folder):
    return payload.triage_counts(payload.triage_payload(payloads(spark, folder, beside=True), "payload"))


@query("base64_encode", "SELECT doc_id, base64(encode(text)) AS encoded FROM documents")
def base64_encode(spark, folder):
    return payload.base64_encode(table(spark, folder, "documents").select("doc_id", "text"), "text", "encoded").drop("text")


@query(
    "base64_decode_lenient",
    "SELECT doc_id, CASE WHEN lang = 'en' THEN text END AS decoded FROM documents",
)
def base64_decode(spark, folder):
    texts = table(spark, folder, "documents").select("doc_id", "lang", "text")
    encoded = payload.base64_encode(texts, "text", "encoded")
    # texts that are not English are made undecodable
    broken = encoded.withColumn("encoded", F.expr("CASE WHEN lang = 'en' THEN encoded ELSE concat('*', encoded) END"))
    decoded = payload.base64_decode(broken, "encoded", "bytes", lenient=True)
    return decoded.select("doc_id", F.col("bytes").cast("string").alias("decoded"))


# --- G1 - G4 -------------------------------------------------------------------------------------


@query(
    "offset_summary",
    f"""SELECT "partition", min("offset") AS low, max("offset") + 1 AS high, count(*) AS records,
               max("offset") + 1 - min("offset") - count(*) AS gaps FROM ({_ENVELOPE_SQL}) GROUP BY 1""",
)
def offset_summary(spark, folder):
    return positions.offset_summary(envelope(spark, folder))


@query(
    "offset_lag",
    f"""SELECT "partition", min("offset") AS low, max("offset") + 1 AS high, count(*) AS records,
               max("offset") + 1 - min("offset") - count(*) AS gaps, max("offset") FILTER (WHERE event_type = 'purchase') AS committed,
               max("offset") + 1 - max("offset") FILTER (WHERE event_type = 'purchase') AS lag
        FROM ({_ENVELOPE_SQL}) GROUP BY 1""",
)
def offset_lag(spark, folder):
    log = envelope(spark, folder)
    commits = log.filter(F.col("headers")["kind"] == "purchase").groupBy("partition").agg(F.max("offset").alias("committed"))
    return positions.offset_summary(log, commits)


_SHOWN = '"partition", "offset", "timestamp", "key", "value"'


@query(
    "read_range",
    f"""SELECT {_SHOWN} FROM ({_ENVELOPE_SQL}) WHERE "partition" = 2 AND "offset" >= 100 ORDER BY "offset" LIMIT 500""",
)
def read_range(spark, folder):
    return positions.read_range(envelope(spark, folder), partition=2, from_offset=100, max_records=500).drop("headers")


@query("read_range_default", f"""SELECT {_SHOWN} FROM ({_ENVELOPE_SQL}) WHERE "partition" = 2""")
def read_range_default(spark, folder):
    return positions.read_range(envelope(spark, folder), partition=2).drop("headers")


@query("read_range_all", f"""SELECT {_SHOWN} FROM ({_ENVELOPE_SQL}) WHERE "offset" >= 50""")
def read_range_all(spark, folder):
    return positions.read_range(envelope(spark, folder), from_offset=50).drop("headers")


@query(
    "read_tail",
    f"""SELECT {_SHOWN} FROM (SELECT *, row_number() OVER (PARTITION BY "partition" ORDER BY "offset" DESC) AS rn FROM ({_ENVELOPE_SQL}))
        WHERE rn <= 25 ORDER BY "partition", "offset" DESC LIMIT 100""",
)
def read_tail(spark, folder):
    return positions.read_tail(envelope(spark, folder), 100).drop("headers")


_LINES = """
    SELECT {id}, CAST(n AS INT) AS line_number, trim(line, ' ' || chr(9) || chr(13)) AS line FROM (
      SELECT {id}, unnest(string_split({text}, chr(10))) AS line, generate_subscripts(string_split({text}, chr(10)), 1) AS n FROM {source})
    WHERE regexp_matches(line, '{pattern}')"""


@query("search_documents", _LINES.format(id="doc_id", text="text", source="documents", pattern="[0-9]{3}-[0-9]+"))
def search_documents(spark, folder):
    return search.search_text(table(spark, folder, "documents"), "text", "[0-9]{3}-[0-9]+", "doc_id")


@query("search_pages", _LINES.format(id="page_id", text="html", source="pages", pattern='<(h1|h2)[ >]'))
def search_pages(spark, folder):
    return search.search_text(table(spark, folder, "pages"), "html", "<(h1|h2)[ >]", "page_id")


@query(
    "search_counts",
    "SELECT doc_id, count(*) AS n FROM ("
    + _LINES.format(id="doc_id", text="text", source="documents", pattern="the |der |les ")
    + ") GROUP BY doc_id",
)
def search_counts(spark, folder):
    return search.match_counts(search.search_text(table(spark, folder, "documents"), "text", "the |der |les ", "doc_id"), "doc_id")
