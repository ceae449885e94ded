"""Queries for charts, comparisons, validation and profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowloom.operators import charts, compare, profile, quality, sketches
from rowloom.plans.catalog import query, table
from rowloom.session import scratch_path

# --- D5 - D9 -------------------------------------------------------------------------------------


@query(
    "bar_mean",
    "SELECT event_type, round(avg(value), 4) AS value FROM events GROUP BY event_type",
)
def bar_mean(spark, folder):
    return charts.bar_data(table(spark, folder, "events"), "event_type", "value").withColumn("value", F.round("value", 4))


@query(
    "bar_unique_rows_top",
    "SELECT c_name, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_name LIMIT 15",
)
def bar_unique_rows(spark, folder):
    return charts.bar_data(table(spark, folder, "customer"), "c_name", "c_acctbal", agg="mean", top_k=15)


@query(
    "bar_count_top",
    """SELECT o_custkey, CAST(count(o_totalprice) AS DOUBLE) AS o_totalprice FROM orders GROUP BY o_custkey
       ORDER BY o_totalprice DESC, o_custkey LIMIT 20""",
)
def bar_count_top(spark, folder):
    return charts.bar_data(table(spark, folder, "orders"), "o_custkey", "o_totalprice", agg="count", top_k=20)


@query("count_bars", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type ORDER BY n DESC, event_type LIMIT 3")
def count_bars(spark, folder):
    return charts.count_bars(table(spark, folder, "events"), "event_type", 3)


@query(
    "pivot",
    """SELECT c_nationkey, """
    + ", ".join(
        f"round(avg(c_acctbal) FILTER (WHERE c_mktsegment = '{s}'), 4) AS {s}"
        for s in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
    )
    + " FROM customer GROUP BY c_nationkey",
)
def pivot(spark, folder):
    wide = charts.pivot_data(table(spark, folder, "customer"), "c_nationkey", "c_mktsegment", "c_acctbal")
    return wide.select("c_nationkey", *[F.round(c, 4).alias(c) for c in wide.columns if c != "c_nationkey"])


def _resample_sql(step, where):
    return f"""
    WITH m AS (SELECT date_trunc('{step}', ts) AS ts, avg(value) AS value FROM events WHERE {where} GROUP BY 1),
         a AS (SELECT unnest(generate_series((SELECT min(ts) FROM m), (SELECT max(ts) FROM m), INTERVAL 1 {step})) AS ts)
    SELECT a.ts::TIMESTAMP AS ts, round(m.value, 4) AS value FROM a LEFT JOIN m USING (ts)"""


@query("resample_hourly_with_gaps", _resample_sql("hour", "user_id >= 0"))
def resample_hour(spark, folder):
    return charts.resample(table(spark, folder, "events"), "ts", "value", "hour").withColumn("value", F.round("value", 4))


@query("resample_auto", _resample_sql("day", "user_id >= 0"))
def resample_auto(spark, folder):
    return charts.resample(table(spark, folder, "events"), "ts", "value", "auto").withColumn("value", F.round("value", 4))


@query(
    "histogram",
    """
    WITH s AS (SELECT min(value) AS a, max(value) AS b FROM events),
         c AS (SELECT CAST(least(floor((value - a) / ((b - a) / 30)), 29) AS INT) AS bin, count(*) AS n FROM events, s GROUP BY 1)
    SELECT CAST(r.range AS INT) AS bin, round(a + r.range * ((b - a) / 30), 6) AS low,
           round(CASE WHEN r.range = 29 THEN b ELSE a + (r.range + 1) * ((b - a) / 30) END, 6) AS high, coalesce(n, 0) AS n
    FROM s, range(30) r LEFT JOIN c ON c.bin = r.range""",
)
def histogram(spark, folder):
    bins = charts.histogram(table(spark, folder, "events"), "value")
    return bins.withColumns({"low": F.round("low", 6), "high": F.round("high", 6)})


_POINT = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice"]


@query(
    "scatter",
    f"""SELECT l_quantity, l_extendedprice FROM lineitem
        ORDER BY md5(concat_ws(':', '3', {", ".join(_POINT)})), {", ".join(_POINT)} LIMIT 500""",
)
def scatter(spark, folder):
    return charts.scatter_data(table(spark, folder, "lineitem"), "l_quantity", "l_extendedprice", 500, key=_POINT, seed=3)


# --- E1, E3: two versions of the events table -----------------------------------------------------

# views have other ids on the second side, so that each side has events of its own
_OTHER_ID = "CASE WHEN event_type = 'view' THEN event_id + 1000000000000 ELSE event_id END"
_A = "SELECT event_id, event_type, value FROM events"
_B = f"""SELECT {_OTHER_ID} AS event_id, CASE WHEN event_type <> 'click' THEN event_type END AS event_type,
               CASE WHEN event_type = 'error' AND value > 20 THEN value + 1 ELSE value END AS value
        FROM events"""


def _versions(spark, folder):
    events = table(spark, folder, "events")
    a = events.select("event_id", "event_type", "value")
    b = events.select(
        F.expr(_OTHER_ID).alias("event_id"),
        F.expr("CASE WHEN event_type <> 'click' THEN event_type END").alias("event_type"),
        F.expr("CASE WHEN event_type = 'error' AND value > 20 THEN value + 1 ELSE value END").alias("value"),
    )
    return a, b


_DIFF = f"""
    SELECT coalesce(a.event_id, b.event_id) AS event_id,
           CASE WHEN b.event_id IS NULL THEN 'only_in_a' WHEN a.event_id IS NULL THEN 'only_in_b'
                WHEN a.event_type IS DISTINCT FROM b.event_type OR a.value IS DISTINCT FROM b.value THEN 'changed'
                ELSE 'same' END AS status,
           CASE WHEN a.event_id IS NOT NULL AND b.event_id IS NOT NULL THEN concat_ws(';',
                CASE WHEN a.event_type IS DISTINCT FROM b.event_type
                     THEN 'event_type:' || coalesce(a.event_type, '-') || '>' || coalesce(b.event_type, '-') END,
                CASE WHEN a.value IS DISTINCT FROM b.value THEN 'value:' || a.value || '>' || b.value END)
                ELSE '' END AS changes
    FROM ({_A}) a FULL JOIN ({_B}) b ON a.event_id = b.event_id"""


def _change_text():
    return F.concat_ws(
        ";",
        F.transform(
            "changes",
            lambda c: F.concat(
                c["column"], F.lit(":"), F.coalesce(c["value_a"], F.lit("-")), F.lit(">"), F.coalesce(c["value_b"], F.lit("-"))
            ),
        ),
    )


@query(
    "diff_types",
    "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'changed' ELSE 'same' END AS status FROM events",
)
def diff_types(spark, folder):
    """An integer against a double, two scales of decimals, and zeros of both signs."""
    events = table(spark, folder, "events")
    a = events.selectExpr("event_id", "user_id AS n", "CAST(value AS DECIMAL(18,2)) AS d", "0.0D AS z")
    b = events.selectExpr(
        "event_id",
        "CAST(user_id AS DOUBLE) + IF(event_id % 5 = 0, 0.5D, 0D) AS n",
        "CAST(CAST(value AS DECIMAL(18,2)) AS DECIMAL(22,5)) AS d",
        "-0.0D AS z",
    )
    return compare.diff_tables(a, b, "event_id").keys.select("event_id", "status")


@query(
    "expectations_with_missing",
    """SELECT count(*) FILTER (WHERE event_type <> 'view') = 0 AS success, count(*) FILTER (WHERE event_type <> 'view') AS unexpected FROM events""",
)
def expectations_with_missing(spark, folder):
    suite = [
        {"expectation_type": "expect_column_values_to_be_in_set", "kwargs": {"column": "event_type", "value_set": ["view", None]}}
    ]
    return quality.run_expectations(table(spark, folder, "events"), suite).selectExpr("success", "CAST(unexpected AS BIGINT) AS unexpected")


@query("diff_keys", _DIFF)
def diff_keys(spark, folder):
    keys = compare.diff_tables(*_versions(spark, folder), "event_id").keys
    return keys.withColumn("changes", _change_text())


@query(
    "diff_summary",
    f"""SELECT count(*) FILTER (WHERE status = 'only_in_a') AS only_in_a, count(*) FILTER (WHERE status = 'only_in_b') AS only_in_b,
               count(*) FILTER (WHERE status IN ('same', 'changed')) AS in_both,
               count(*) FILTER (WHERE status = 'changed') AS changed, CAST(0 AS BIGINT) AS duplicate_keys FROM ({_DIFF})""",
)
def diff_summary(spark, folder):
    return compare.diff_tables(*_versions(spark, folder), "event_id").summary


@query(
    "diff_examples",
    f"SELECT event_id, changes FROM ({_DIFF}) WHERE status = 'changed' ORDER BY event_id LIMIT 200",
)
def diff_examples(spark, folder):
    examples = compare.diff_tables(*_versions(spark, folder), "event_id").examples
    return examples.withColumn("changes", _change_text())


# some orders dearer, some without a status, some gone, some new
_ORDERS = """SELECT o_orderkey + CASE WHEN o_orderkey % 500 = 3 THEN 100000000 ELSE 0 END AS o_orderkey, o_custkey,
                    CASE WHEN o_orderkey % 300 = 5 THEN NULL ELSE o_orderstatus END AS o_orderstatus,
                    CASE WHEN o_orderkey % 200 = 7 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice FROM orders"""
_ORDER_DIFF = f"""
    SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey,
           CASE WHEN b.o_orderkey IS NULL THEN 'only_in_a' WHEN a.o_orderkey IS NULL THEN 'only_in_b'
                WHEN a.o_custkey IS DISTINCT FROM b.o_custkey OR a.o_orderstatus IS DISTINCT FROM b.o_orderstatus
                  OR a.o_totalprice IS DISTINCT FROM b.o_totalprice THEN 'changed' ELSE 'same' END AS status
    FROM (SELECT * FROM orders) a FULL JOIN ({_ORDERS}) b ON a.o_orderkey = b.o_orderkey"""


def _order_versions(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    key = F.col("o_orderkey")
    return orders, orders.select(
        (key + F.when(key % 500 == 3, 100000000).otherwise(0)).alias("o_orderkey"),
        "o_custkey",
        F.when(key % 300 != 5, F.col("o_orderstatus")).alias("o_orderstatus"),
        (F.col("o_totalprice") + F.when(key % 200 == 7, 1).otherwise(0)).alias("o_totalprice"),
    )


@query("diff_by_checksum", f"SELECT * FROM ({_ORDER_DIFF}) WHERE status <> 'same'")
def diff_by_checksum(spark, folder):
    return compare.diff_by_checksum(*_order_versions(spark, folder), "o_orderkey").keys.select("o_orderkey", "status")


@query(
    "diff_by_checksum_summary",
    f"""SELECT count(*) FILTER (WHERE status = 'only_in_a') AS only_in_a, count(*) FILTER (WHERE status = 'only_in_b') AS only_in_b,
               count(*) FILTER (WHERE status IN ('same', 'changed')) AS in_both,
               count(*) FILTER (WHERE status = 'changed') AS changed, CAST(0 AS BIGINT) AS duplicate_keys FROM ({_ORDER_DIFF})""",
)
def diff_by_checksum_summary(spark, folder):
    return compare.diff_by_checksum(*_order_versions(spark, folder), "o_orderkey").summary


# repeated keys: the same order and line number occurs several times in lineitem
_LINE_KEY = "CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END * (l_orderkey * 10 + l_linenumber)"
_LINE_STATUS = "CASE WHEN l_tax > 0.05 THEN 'X' ELSE l_linestatus END"


@query(
    "diff_repeated_keys",
    f"""
    WITH a AS (SELECT l_orderkey * 10 + l_linenumber AS k, count(*) AS n, min(l_linestatus) AS s FROM lineitem GROUP BY 1),
         b AS (SELECT {_LINE_KEY} AS k, count(*) AS n, min({_LINE_STATUS}) AS s FROM lineitem GROUP BY 1)
    SELECT CASE WHEN a.n > 1 OR b.n > 1 THEN 'duplicate' WHEN b.n IS NULL THEN 'only_in_a' WHEN a.n IS NULL THEN 'only_in_b'
                WHEN a.s = b.s THEN 'same' ELSE 'changed' END AS status, count(*) AS n
    FROM a FULL JOIN b ON a.k = b.k GROUP BY 1""",
)
def diff_repeated(spark, folder):
    lines = table(spark, folder, "lineitem")
    a = lines.selectExpr("l_orderkey * 10 + l_linenumber AS line", "l_linestatus AS status")
    b = lines.selectExpr(f"{_LINE_KEY} AS line", f"{_LINE_STATUS} AS status")
    keys = compare.diff_tables(a, b, "line", ["status"]).keys
    return keys.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


# the second side has each click under another user
_OTHER_USER = "CASE event_type WHEN 'click' THEN user_id + 1 WHEN 'error' THEN -user_id ELSE user_id END"
_COUNTS = f"""
    SELECT user_id, CAST(sum(l) AS BIGINT) AS left_count, CAST(sum(r) AS BIGINT) AS right_count, CAST(sum(l) - sum(r) AS BIGINT) AS diff
    FROM (SELECT user_id, CAST(1 AS BIGINT) AS l, CAST(0 AS BIGINT) AS r FROM events UNION ALL SELECT {_OTHER_USER}, 0, 1 FROM events)
    GROUP BY user_id"""


def _users(spark, folder):
    events = table(spark, folder, "events")
    return events.select("user_id"), events.select(F.expr(_OTHER_USER).alias("user_id"))


@query("reconcile_counts", _COUNTS)
def reconcile(spark, folder):
    return compare.reconcile_counts(*_users(spark, folder), "user_id").counts


@query(
    "reconcile_summary",
    f"""SELECT CAST(sum(left_count) AS BIGINT) AS left_rows, CAST(sum(right_count) AS BIGINT) AS right_rows,
               count(*) FILTER (WHERE left_count > 0) AS left_keys, count(*) FILTER (WHERE right_count > 0) AS right_keys,
               count(*) FILTER (WHERE diff = 0) AS matched_keys, count(*) FILTER (WHERE diff <> 0) AS mismatched_keys
        FROM ({_COUNTS})""",
)
def reconcile_summary(spark, folder):
    return compare.reconcile_counts(*_users(spark, folder), "user_id").summary


@query(
    "reconcile_examples",
    f"SELECT * FROM ({_COUNTS}) WHERE diff <> 0 ORDER BY abs(diff) DESC, user_id LIMIT 200",
)
def reconcile_examples(spark, folder):
    return compare.reconcile_counts(*_users(spark, folder), "user_id").examples


# --- E2, E4, E5, E6 ------------------------------------------------------------------------------


@query(
    "schema_check",
    """
    SELECT 'required' AS "check", 'user_id' AS "column", 'present' AS expected, 'present' AS actual,
           CAST(0 AS BIGINT) AS violations, TRUE AS passed
    UNION ALL SELECT 'required', 'country', 'present', 'absent', 1, FALSE
    UNION ALL SELECT 'dtype', 'value', 'double', 'double', 0, TRUE
    UNION ALL SELECT 'dtype', 'user_id', 'string', 'bigint', 1, FALSE
    UNION ALL SELECT 'non_null', 'event_id', 'no missing values', 'bigint', 0, TRUE
    UNION ALL SELECT 'non_null', 'event_type', 'no missing values', 'string',
                     (SELECT count(*) FROM events WHERE event_type = 'signup'), FALSE
    UNION ALL SELECT 'non_null', 'value', 'no missing values', 'double',
                     (SELECT count(*) FROM events WHERE value > 100), FALSE""",
)
def schema_check(spark, folder):
    events = table(spark, folder, "events").withColumns(
        {
            "event_type": F.expr("CASE WHEN event_type <> 'signup' THEN event_type END"),
            "value": F.expr("CASE WHEN value > 100 THEN double('NaN') ELSE value END"),
        }
    )
    return quality.schema_check(
        events,
        required=["user_id", "country"],
        dtypes={"value": "double", "user_id": "string"},
        non_null=["event_id", "event_type", "value"],
    )


EVENT_SCHEMA = {
    "type": "object",
    "required": ["id", "kind", "detail"],
    "properties": {
        "id": {"type": "integer"},
        "kind": {"type": "string", "enum": ["view", "click", "purchase"], "maxLength": 7},
        "value": {"type": "number", "minimum": 5, "exclusiveMaximum": 100},
        "detail": {"type": "object", "required": ["k"], "properties": {"k": {"type": "integer", "maximum": 90}}},
    },
}


def event_json(spark, folder):
    """Events as JSON text with several defects: a sign too many, texts as numbers, absent and null fields."""
    value = "CASE WHEN event_type = 'click' THEN concat('\"', CAST(value AS STRING), '\"') ELSE CAST(value AS STRING) END"
    detail = "CASE WHEN value < 10 THEN '' WHEN value < 20 THEN ',\"detail\":null' ELSE concat(',\"detail\":', props) END"
    body = f"concat('{{\"id\":', event_id, ',\"kind\":\"', event_type, '\",\"value\":', {value}, {detail}, '}}')"
    text = f"concat(CASE WHEN value > 150 THEN ']' ELSE '' END, {body})"
    return table(spark, folder, "events").select("event_id", F.expr(text).alias("payload"))


_BROKEN = """
    SELECT event_id, concat_ws(';',
      CASE WHEN value > 150 THEN ':json' END,
      CASE WHEN value <= 150 AND value < 10 THEN 'detail:required' END,
      CASE WHEN value <= 150 AND event_type NOT IN ('view','click','purchase') THEN 'kind:enum' END,
      CASE WHEN value <= 150 AND length(event_type) > 7 THEN 'kind:maxLength' END,
      CASE WHEN value <= 150 AND event_type = 'click' THEN 'value:type:number' END,
      CASE WHEN value <= 150 AND event_type <> 'click' AND value < 5 THEN 'value:minimum' END,
      CASE WHEN value <= 150 AND event_type <> 'click' AND value >= 100 THEN 'value:exclusiveMaximum' END,
      CASE WHEN value <= 150 AND value >= 10 AND value < 20 THEN 'detail:type:object' END,
      CASE WHEN value <= 150 AND value >= 20 AND CAST(json_extract(props, '$.k') AS INT) > 90 THEN 'detail.k:maximum' END
    ) AS errors FROM events"""


@query("validate_events", f"SELECT event_id, errors, errors = '' AS valid FROM ({_BROKEN})")
def validate_events(spark, folder):
    checked = quality.validate_events(event_json(spark, folder), "payload", EVENT_SCHEMA)
    text = F.concat_ws(";", F.transform("errors", lambda e: F.concat(e["path"], F.lit(":"), e["rule"])))
    return checked.select("event_id", text.alias("errors"), "valid")


@query(
    "validate_events_summary",
    f"""SELECT split_part(e, ':', 1) AS path, substr(e, strpos(e, ':') + 1) AS rule, count(*) AS n
        FROM (SELECT unnest(string_split(errors, ';')) AS e FROM ({_BROKEN}) WHERE errors <> '') GROUP BY ALL""",
)
def validate_summary(spark, folder):
    return quality.summarize_errors(quality.validate_events(event_json(spark, folder), "payload", EVENT_SCHEMA))


ORDER_SCHEMA = {
    "type": "object",
    "required": ["lines"],
    "additionalProperties": False,
    "properties": {
        "id": {"type": "integer"},
        "status": {"enum": ["O", "F"]},
        "lines": {
            "type": "array",
            "minItems": 2,
            "maxItems": 6,
            "uniqueItems": True,
            "items": {
                "type": "object",
                "required": ["n", "qty"],
                "additionalProperties": False,
                "properties": {
                    "n": {"type": "integer"},
                    "qty": {"type": "number", "maximum": 45},
                    "flags": {"type": "array", "items": {"enum": ["A", "N", "O"]}},
                },
            },
        },
    },
}
_LINE_ORDER = "l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice"


def order_json(spark, folder):
    """Every order with its lines in an array; some lines lack a quantity or have a field that the schema does not know."""
    line = F.struct(
        *[F.col(c) for c in _LINE_ORDER.split(", ")],
        F.struct(
            F.col("l_linenumber").alias("n"),
            F.expr("CASE WHEN l_quantity > 5 THEN l_quantity END").alias("qty"),
            F.array("l_returnflag", "l_linestatus").alias("flags"),
            F.expr("CASE WHEN l_tax > 0.06 THEN l_tax END").alias("tax"),
        ).alias("line"),
    )
    lines = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line))["line"].alias("lines"))
    # by order key on both sides: the events then lie in many partitions, however few files the orders have
    orders = table(spark, folder, "orders").repartition("o_orderkey").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    none = F.array().cast(lines.schema["lines"].dataType)
    event = F.struct(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.coalesce("lines", none).alias("lines"))
    return orders.select("o_orderkey", F.to_json(event).alias("payload"))


@query(
    "validate_events_arrays",
    f"""WITH l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_LINE_ORDER}) - 1 AS i FROM lineitem),
             e AS (SELECT o_orderkey, count(l_orderkey) AS n,
                          count(DISTINCT CASE WHEN l_orderkey IS NOT NULL THEN concat_ws('|', l_linenumber,
                            CASE WHEN l_quantity > 5 THEN l_quantity ELSE -1 END, l_returnflag, l_linestatus,
                            CASE WHEN l_tax > 0.06 THEN l_tax ELSE -1 END) END) AS different
                   FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey),
             c AS (SELECT l.*, unnest([l_returnflag, l_linestatus]) AS flag, unnest([0, 1]) AS k FROM l)
        SELECT o_orderkey, 'status' AS path, 'enum' AS rule FROM orders WHERE o_orderstatus NOT IN ('O', 'F')
        UNION ALL SELECT o_orderkey, 'lines', 'minItems' FROM e WHERE n < 2
        UNION ALL SELECT o_orderkey, 'lines', 'maxItems' FROM e WHERE n > 6
        UNION ALL SELECT o_orderkey, 'lines', 'uniqueItems' FROM e WHERE different < n
        UNION ALL SELECT l_orderkey, 'lines[' || i || ']', 'additionalProperties' FROM l WHERE l_tax > 0.06
        UNION ALL SELECT l_orderkey, 'lines[' || i || '].qty', 'required' FROM l WHERE l_quantity <= 5
        UNION ALL SELECT l_orderkey, 'lines[' || i || '].qty', 'maximum' FROM l WHERE l_quantity > 45
        UNION ALL SELECT l_orderkey, 'lines[' || i || '].flags[' || k || ']', 'enum' FROM c WHERE flag NOT IN ('A', 'N', 'O')""",
)
def validate_arrays(spark, folder):
    checked = quality.validate_events(order_json(spark, folder), "payload", ORDER_SCHEMA)
    return checked.select("o_orderkey", F.inline_outer("errors")).where("rule IS NOT NULL")


SUITE = [
    {"expectation_type": "expect_table_row_count_to_be_between", "kwargs": {"min_value": 1, "max_value": 1000}},
    {"expectation_type": "expect_column_to_exist", "kwargs": {"column": "l_tax"}},
    {"expectation_type": "expect_column_values_to_not_be_null", "kwargs": {"column": "l_partkey"}},
    {"expectation_type": "expect_column_values_to_be_in_set", "kwargs": {"column": "l_returnflag", "value_set": ["A", "N"]}},
    {"expectation_type": "expect_column_values_to_be_between", "kwargs": {"column": "l_quantity", "min_value": 1, "max_value": 45, "mostly": 0.5}},
    {"expectation_type": "expect_column_values_to_match_regex", "kwargs": {"column": "l_linestatus", "regex": "^[OF]$"}},
    {"expectation_type": "expect_column_unique_value_count_to_be_between", "kwargs": {"column": "l_shipdate", "min_value": 1}},
    {"expectation_type": "expect_column_max_to_be_between", "kwargs": {"column": "l_linenumber", "max_value": 6}},
    {"expectation_type": "expect_column_values_to_be_unique", "kwargs": {"column": "l_orderkey"}},
    {"expectation_type": "expect_compound_columns_to_be_unique", "kwargs": {"column_list": ["l_orderkey", "l_linenumber"]}},
]


def _repeated(columns):
    return f"(SELECT CAST(coalesce(sum(n), 0) AS BIGINT) FROM (SELECT count(*) AS n FROM lineitem GROUP BY {columns}) WHERE n > 1)"


_SUITE_SQL = f"""
    SELECT CAST(v.position AS INT) AS position, v."column", v.success, v.observed, CAST(v.unexpected AS BIGINT) AS unexpected FROM (
      SELECT 0 AS position, NULL AS "column", c <= 1000 AS success, CAST(c AS VARCHAR) AS observed, NULL AS unexpected
        FROM (SELECT count(*) AS c FROM lineitem)
      UNION ALL SELECT 1, 'l_tax', TRUE, NULL, NULL
      UNION ALL SELECT 2, 'l_partkey', c = 0, NULL, c FROM (SELECT count(*) - count(l_partkey) AS c FROM lineitem)
      UNION ALL SELECT 3, 'l_returnflag', c = 0, NULL, c FROM (SELECT count(*) AS c FROM lineitem WHERE l_returnflag NOT IN ('A','N'))
      UNION ALL SELECT 4, 'l_quantity', c <= 0.5 * t, NULL, c
        FROM (SELECT count(*) FILTER (WHERE l_quantity NOT BETWEEN 1 AND 45) AS c, count(*) AS t FROM lineitem)
      UNION ALL SELECT 5, 'l_linestatus', c = 0, NULL, c FROM (SELECT count(*) AS c FROM lineitem WHERE l_linestatus NOT IN ('O','F'))
      UNION ALL SELECT 6, 'l_shipdate', c >= 1, CAST(c AS VARCHAR), NULL FROM (SELECT count(DISTINCT l_shipdate) AS c FROM lineitem)
      UNION ALL SELECT 7, 'l_linenumber', c <= 6, CAST(c AS VARCHAR), NULL FROM (SELECT max(l_linenumber) AS c FROM lineitem)
      UNION ALL SELECT 8, 'l_orderkey', c = 0, NULL, c FROM (SELECT {_repeated('l_orderkey')} AS c)
      UNION ALL SELECT 9, 'l_orderkey,l_linenumber', c = 0, NULL, c FROM (SELECT {_repeated('l_orderkey, l_linenumber')} AS c)) v"""


@query("run_expectations", _SUITE_SQL)
def run_expectations(spark, folder):
    return quality.run_expectations(table(spark, folder, "lineitem"), SUITE).drop("expectation_type")


@query(
    "expectation_statistics",
    f"""SELECT count(*) AS evaluated, count(*) FILTER (WHERE success) AS successful,
               count(*) - count(*) FILTER (WHERE success) AS unsuccessful,
               100.0::DOUBLE * count(*) FILTER (WHERE success) / count(*) AS success_percent,
               bool_and(success) AS success FROM ({_SUITE_SQL})""",
)
def expectation_statistics(spark, folder):
    return quality.expectation_statistics(quality.run_expectations(table(spark, folder, "lineitem"), SUITE))


def _profile_sql(source, columns):
    parts = " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", '{t}' AS dtype, (SELECT count(*) FROM {source}) AS "rows",
                   (SELECT count(*) - count({c}) FROM {source}) AS nulls, (SELECT count(DISTINCT {c}) FROM {source}) AS cardinality,
                   (SELECT coalesce(max(n), 0) FROM (SELECT count({c}) AS n FROM {source} GROUP BY {c})) AS max_repeat, '{k}' AS kind"""
        for c, t, k in columns
    )
    return f"""
    SELECT "column", dtype, "rows", nulls, nulls / "rows" AS null_ratio, cardinality, max_repeat,
           CASE WHEN kind <> '' THEN kind WHEN "rows" >= 10 AND cardinality > "rows" * 0.95 AND nulls / "rows" < 0.1 THEN 'id'
                ELSE 'categorical' END AS "class" FROM ({parts})"""


@query(
    "profile_events",
    _profile_sql(
        "(SELECT event_id, ts, user_id, CASE WHEN event_type <> 'signup' THEN event_type END AS event_type, value, props FROM events)",
        [
            ("event_id", "bigint", "numeric"),
            ("ts", "timestamp_ntz", "datetime"),
            ("user_id", "bigint", "numeric"),
            ("event_type", "string", ""),
            ("value", "double", "numeric"),
            ("props", "string", ""),
        ],
    ),
)
def profile_events(spark, folder):
    events = table(spark, folder, "events").withColumn(
        "event_type", F.expr("CASE WHEN event_type <> 'signup' THEN event_type END")
    )
    return profile.profile_columns(events).drop("position")


@query(
    "profile_documents",
    _profile_sql(
        "documents",
        [("doc_id", "bigint", "numeric"), ("text", "string", ""), ("lang", "string", ""), ("source", "string", ""), ("n_chars", "bigint", "numeric")],
    ),
)
def profile_documents(spark, folder):
    return profile.profile_columns(table(spark, folder, "documents")).drop("position")


# --- E7, E8: the suggested chart's data, and an evidence bundle read back -------------------------


@query(
    "suggested_line_chart",
    """WITH m AS (SELECT date_trunc('day', ts) AS ts, avg(value) AS value FROM events GROUP BY 1),
            a AS (SELECT unnest(generate_series((SELECT min(ts) FROM m), (SELECT max(ts) FROM m), INTERVAL 1 DAY)) AS ts)
       SELECT a.ts::TIMESTAMP AS ts, round(m.value, 4) AS value FROM a LEFT JOIN m USING (ts)""",
)
def suggested_line(spark, folder):
    events = table(spark, folder, "events").select("ts", "event_type", "value")
    spec = profile.suggest_chart(profile.profile_columns(events))
    return profile.chart_data(events, spec).withColumn("value", F.round("value", 4))


@query(
    "suggested_bar_chart",
    """SELECT p_name, round(avg(p_retailprice), 4) AS p_retailprice FROM part GROUP BY p_name
       ORDER BY avg(p_retailprice) DESC, p_name LIMIT 20""",
)
def suggested_bar(spark, folder):
    parts = table(spark, folder, "part").select("p_name", "p_retailprice")
    spec = profile.suggest_chart(profile.profile_columns(parts), top_k=20)
    return profile.chart_data(parts, spec).withColumn("p_retailprice", F.round("p_retailprice", 4))


@query(
    "evidence_bundle",
    """SELECT (SELECT count(*) FROM customer) AS "rows", 50::INT AS sampled,
              concat_ws(',', 'c_custkey', 'c_name', 'c_nationkey', 'c_acctbal', 'c_mktsegment') AS columns,
              (SELECT round(quantile_cont(c_acctbal, 0.5), 6) FROM customer) AS median_balance,
              (SELECT count(*) FROM customer) AS parquet_rows, (SELECT count(*) FROM customer) AS csv_rows""",
)
def evidence(spark, folder):
    written = profile.evidence_bundle(table(spark, folder, "customer"), scratch_path(spark, "evidence"))
    record = spark.read.json(written.metadata)
    balance = F.filter("describe", lambda d: d["column"] == "c_acctbal")[0]["p50"]
    csv_rows = spark.read.option("header", True).csv(written.csv).agg(F.count(F.lit(1)).alias("n")).scalar()
    rows = spark.read.parquet(written.parquet).agg(F.count(F.lit(1)).alias("n")).scalar()
    return record.select(
        "rows",
        F.size("sample").alias("sampled"),
        F.concat_ws(",", "columns").alias("columns"),
        F.round(balance, 6).alias("median_balance"),
        rows.alias("parquet_rows"),
        csv_rows.alias("csv_rows"),
    )


# --- E6, D3 from stored sketches ------------------------------------------------------------------

_NUMBERS = ["l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_ONE_COLUMN = """SELECT '{c}' AS "column", count(*) AS n_rows, count(*) - count({c}) AS missing, CAST(min({c}) AS DOUBLE) AS minimum,
    CAST(max({c}) AS DOUBLE) AS maximum, round(avg({c}), 4) AS mean, round(quantile_cont(CAST({c} AS DOUBLE), 0.25), 6) AS p25,
    round(quantile_cont(CAST({c} AS DOUBLE), 0.5), 6) AS p50, round(quantile_cont(CAST({c} AS DOUBLE), 0.75), 6) AS p75 FROM lineitem"""


@query("profile_from_sketches", " UNION ALL ".join(_ONE_COLUMN.format(c=c) for c in _NUMBERS))
def profile_from_sketches(spark, folder):
    """Order lines that arrive in two loads: each load's files are sketched once, quantiles are made exact in one pass."""
    lines = table(spark, folder, "lineitem").select(*_NUMBERS, "l_orderkey")
    data, store = scratch_path(spark, "sketched"), scratch_path(spark, "sketches")
    for load in (0, 1):
        lines.where(F.pmod("l_orderkey", F.lit(2)) == load).drop("l_orderkey").write.mode("append").parquet(data)
        sketches.refresh_sketches(spark, data, store)
    profile = sketches.sketched_profile(spark, data, store)
    exact = sketches.exact_quantiles_from(spark, data, store, _NUMBERS)
    wide = exact.groupBy("column").agg(
        *[F.max(F.when(F.col("q") == q, F.round("value", 6))).alias(n) for n, q in (("p25", 0.25), ("p50", 0.5), ("p75", 0.75))]
    )
    shown = profile.select(
        "column",
        "n_rows",
        "missing",
        F.col("minimum").cast("double").alias("minimum"),
        F.col("maximum").cast("double").alias("maximum"),
        F.round("mean", 4).alias("mean"),
    )
    return shown.join(wide, "column")
