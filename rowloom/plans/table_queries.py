"""Queries for row selection, joins and aggregation."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowloom.operators import aggregate, joins, select, skew
from rowloom.plans.catalog import query, table

# Text order is by bytes on both engines; money columns are summed as decimals so that the
# result does not depend on the order of addition.


def money(name: str):
    return F.col(name).cast("decimal(18,2)")


@query(
    "flagship_user_activity",
    """
    SELECT user_id, count(value) AS value_count, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS value_sum,
           round(CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) / count(value), 4) AS value_mean,
           count(DISTINCT props) AS props_nunique
    FROM events
    WHERE event_type IN ('purchase', 'click') AND ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-25 12:00:00'
    GROUP BY user_id ORDER BY value_sum DESC, user_id LIMIT 20""",
)
def flagship_user_activity(spark, folder):
    events = table(spark, folder, "events")
    chosen = select.filter_rows(events, [{"column": "event_type", "op": "in", "value": ["purchase", "click"]}])
    chosen = select.filter_time_range(chosen, "ts", "2024-01-05", "2024-01-25 12:00:00")
    totals = aggregate.group_aggregate(
        chosen.withColumn("value", money("value")), "user_id", {"value": ["count", "sum"], "props": "nunique"}
    )
    total = F.col("value_sum").cast("double")
    return (
        totals.select(
            "user_id",
            "value_count",
            total.alias("value_sum"),
            F.round(total / F.col("value_count"), 4).alias("value_mean"),
            "props_nunique",
        )
        .orderBy(F.col("value_sum").desc(), "user_id")
        .limit(20)
    )


# --- B1: one query per operator ------------------------------------------------------------------

_FILTERS = {
    "equal": ("events", ("event_type", "==", "purchase"), "event_type = 'purchase'"),
    "less": ("events", ("value", "<", 20.0), "value < 20.0"),
    "less_equal": ("lineitem", ("l_quantity", "<=", 7.0), "l_quantity <= 7.0"),
    "greater": ("orders", ("o_totalprice", ">", 250000.0), "o_totalprice > 250000.0"),
    "greater_equal": ("part", ("p_size", ">=", 25), "p_size >= 25"),
    "in": ("customer", ("c_mktsegment", "in", ["BUILDING", "MACHINERY"]), "c_mktsegment IN ('BUILDING','MACHINERY')"),
    "contains_regex": ("part", ("p_type", "contains", "^(ECO|STA).*Y$"), "regexp_matches(p_type, '^(ECO|STA).*Y$')"),
    "startswith": ("orders", ("o_orderkey", "startswith", "12"), "starts_with(CAST(o_orderkey AS VARCHAR), '12')"),
    "endswith": ("part", ("p_name", "endswith", "widget"), "suffix(p_name, 'widget')"),
}


def _register_filter(name, table_name, condition, where):
    column, op, value = condition

    @query(f"filter_{name}", f"SELECT * FROM {table_name} WHERE {where}")
    def run(spark, folder):
        return select.filter_rows(table(spark, folder, table_name), [{"column": column, "op": op, "value": value}])


for _name, (_table, _condition, _where) in _FILTERS.items():
    _register_filter(_name, _table, _condition, _where)

_NULLED = "CASE WHEN event_type <> 'signup' THEN event_type END"


@query(
    "filter_not_equal_keeps_missing",
    f"SELECT event_id, kind FROM (SELECT event_id, {_NULLED} AS kind FROM events) WHERE kind IS DISTINCT FROM 'view'",
)
def filter_not_equal(spark, folder):
    events = table(spark, folder, "events").select("event_id", F.expr(_NULLED).alias("kind"))
    return select.filter_rows(events, [{"column": "kind", "op": "!=", "value": "view"}])


@query(
    "filter_contains_literal",
    "SELECT doc_id, source FROM documents WHERE contains(text, 'the.') AND lang = 'en'",
)
def filter_contains_literal(spark, folder):
    documents = table(spark, folder, "documents")
    return select.filter_rows(
        documents,
        [
            {"column": "text", "op": "contains", "value": "the.", "literal": True},
            {"column": "lang", "op": "==", "value": "en"},
        ],
    ).select("doc_id", "source")


@query(
    "filter_time_range",
    """SELECT * FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate <= TIMESTAMP '1996-06-30'""",
)
def filter_time_range(spark, folder):
    return select.filter_time_range(table(spark, folder, "lineitem"), "l_shipdate", "1996-01-01", "1996-06-30")


@query(
    "head_tail",
    """
    SELECT *, (SELECT count(*) FROM orders) AS total_rows FROM (
      (SELECT *, 'head' AS section FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 20)
      UNION ALL
      (SELECT *, 'tail' AS section FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 20))""",
)
def head_tail(spark, folder):
    return select.head_tail(table(spark, folder, "orders"), ["o_orderdate", "o_orderkey"], head=20, tail=20)


@query(
    "sample_random",
    "SELECT * FROM events ORDER BY md5('7:' || CAST(event_id AS VARCHAR)), event_id LIMIT 50",
)
def sample_random(spark, folder):
    return select.sample_random(table(spark, folder, "events"), 50, key="event_id", seed=7)


@query(
    "sample_stratified",
    """
    SELECT * EXCLUDE (rn) FROM (
      SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY md5('7:' || CAST(event_id AS VARCHAR)), event_id) AS rn
      FROM events) WHERE rn <= 5""",
)
def sample_stratified(spark, folder):
    return select.sample_stratified(table(spark, folder, "events"), "event_type", 5, key="event_id", seed=7)


@query("preview", "SELECT least(500, count(*)) AS n, count(o_orderkey) > 500 AS cut FROM orders")
def preview(spark, folder):
    """A preview has no order, so its size is what can be compared."""
    orders = table(spark, folder, "orders")
    total = orders.agg(F.count("o_orderkey").alias("n")).scalar()
    return select.preview(orders).agg(F.count(F.lit(1)).alias("n")).withColumn("cut", total > 500)


# --- C -------------------------------------------------------------------------------------------


def _orders_customer(spark, folder):
    orders = table(spark, folder, "orders").select(
        F.col("o_custkey").alias("key"), "o_orderkey", F.col("o_orderstatus").alias("status")
    )
    customer = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("key"), "c_name", F.col("c_mktsegment").alias("status")
    )
    return orders, customer


@query(
    "join_inner",
    """SELECT o_custkey AS key, o_orderkey, o_orderstatus AS status_x, c_name, c_mktsegment AS status_y
       FROM orders JOIN customer ON o_custkey = c_custkey""",
)
def join_inner(spark, folder):
    return joins.join(*_orders_customer(spark, folder), "key", null_safe=True)


# Events with a nullable kind against one row per nullable kind: every key of the left is hot, both
# sides have a missing key and keys of their own, and no row has more than one partner.
_EVENTS = f"SELECT {_NULLED} AS kind, event_id FROM events"
_RENAMED = "CASE event_type WHEN 'click' THEN NULL WHEN 'view' THEN 'seen' ELSE event_type END"
_KINDS = f"SELECT {_RENAMED} AS kind, count(*) AS n FROM events GROUP BY 1"


def _kinds(spark, folder):
    events = table(spark, folder, "events")
    left = events.select(F.expr(_NULLED).alias("kind"), "event_id")
    right = events.groupBy(F.expr(_RENAMED).alias("kind"))
    return left, right.agg(F.count(F.lit(1)).alias("n"))


def _register_join(how, sql):
    @query(
        f"join_{how}_null_safe",
        f"""SELECT coalesce(l.kind, r.kind) AS kind, event_id, n
            FROM ({_EVENTS}) l {sql} ({_KINDS}) r ON l.kind IS NOT DISTINCT FROM r.kind""",
    )
    def run(spark, folder):
        return joins.join(*_kinds(spark, folder), "kind", how, null_safe=True)


for _how, _sql in {"inner": "JOIN", "left": "LEFT JOIN", "right": "RIGHT JOIN", "outer": "FULL JOIN"}.items():
    _register_join(_how, _sql)


@query(
    "join_outer_plain_keys",
    f"SELECT coalesce(l.kind, r.kind) AS kind, event_id, n FROM ({_EVENTS}) l FULL JOIN ({_KINDS}) r ON l.kind = r.kind",
)
def join_outer_plain(spark, folder):
    return joins.join(*_kinds(spark, folder), "kind", "outer", null_safe=False)


# a third of the events and a fiftieth of the customers share one key
_HOT_EVENT = "CASE WHEN event_id % 3 = 0 THEN 0 ELSE user_id END"
_HOT_CUSTOMER = "CASE WHEN c_custkey % 50 = 0 THEN 0 ELSE c_custkey END"


@query(
    "join_outer_skewed",
    f"""SELECT coalesce(l.key, r.key) AS key, count(*) AS n, count(event_id) AS events, count(c_custkey) AS customers,
               CAST(sum(event_id) AS BIGINT) AS event_sum, CAST(sum(c_custkey) AS BIGINT) AS customer_sum
        FROM (SELECT {_HOT_EVENT} AS key, event_id FROM events) l
        FULL JOIN (SELECT {_HOT_CUSTOMER} AS key, c_custkey FROM customer) r ON l.key = r.key GROUP BY ALL""",
)
def join_outer_skewed(spark, folder):
    left = table(spark, folder, "events").select(F.expr(_HOT_EVENT).alias("key"), "event_id")
    right = table(spark, folder, "customer").select(F.expr(_HOT_CUSTOMER).alias("key"), "c_custkey")
    names = {"n": "n", "left_n": "events", "right_n": "customers", "left_sum": "event_sum", "right_sum": "customer_sum"}
    totals = skew.join_totals(left, right, "key", "event_id", "c_custkey", "outer")
    return totals.select("key", *[F.col(c).alias(name) for c, name in names.items()])


# keys of one side only are negative or beyond all others
_ORDER_KEY = "CASE WHEN o_orderstatus <> 'P' THEN CASE WHEN o_totalprice > 400000 THEN -o_custkey ELSE o_custkey END END"
_CUSTOMER_KEY = "CASE WHEN c_mktsegment <> 'BUILDING' THEN CASE WHEN c_acctbal > 5000 THEN c_custkey + 1000000000 ELSE c_custkey END END"
_L = f"SELECT {_ORDER_KEY} AS key FROM orders"
_R = f"SELECT {_CUSTOMER_KEY} AS key FROM customer"


@query(
    "key_presence",
    f"""SELECT key, max(l) AS in_left, max(r) AS in_right FROM (
          SELECT key, TRUE AS l, FALSE AS r FROM ({_L}) UNION ALL SELECT key, FALSE, TRUE FROM ({_R})) GROUP BY key""",
)
def key_presence(spark, folder):
    orders = table(spark, folder, "orders").select(F.expr(_ORDER_KEY).alias("key"))
    customer = table(spark, folder, "customer").select(F.expr(_CUSTOMER_KEY).alias("key"))
    return joins.key_presence(orders, customer, "key")


# --- D1 - D4 -------------------------------------------------------------------------------------


@query(
    "group_aggregate",
    """
    SELECT l_returnflag, l_linestatus, count(l_quantity) AS l_quantity_count,
           CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS l_extendedprice_sum,
           min(l_quantity) AS l_quantity_min, max(l_quantity) AS l_quantity_max,
           round(avg(l_quantity), 4) AS l_quantity_mean, count(DISTINCT l_partkey) AS l_partkey_nunique,
           count(*) AS l_quantity_size
    FROM lineitem GROUP BY ALL""",
)
def group_aggregate(spark, folder):
    lineitem = table(spark, folder, "lineitem").withColumn("l_extendedprice", money("l_extendedprice"))
    return aggregate.group_aggregate(
        lineitem,
        ["l_returnflag", "l_linestatus"],
        {"l_quantity": ["count", "min", "max", "mean", "size"], "l_extendedprice": "sum", "l_partkey": "nunique"},
    ).withColumns(
        {
            "l_extendedprice_sum": F.col("l_extendedprice_sum").cast("double"),
            "l_quantity_mean": F.round("l_quantity_mean", 4),
        }
    )


_NULL_EVENTS = f"SELECT {_NULLED} AS kind, CASE WHEN value >= 50 THEN user_id END AS who FROM events"


def _null_events(spark, folder):
    return table(spark, folder, "events").select(
        F.expr(_NULLED).alias("kind"), F.expr("CASE WHEN value >= 50 THEN user_id END").alias("who")
    )


@query(
    "group_aggregate_null_key_kept",
    f"""SELECT kind, count(who) AS who_count, count(*) AS who_size,
               count(DISTINCT who) + max(CASE WHEN who IS NULL THEN 1 ELSE 0 END) AS who_nunique
        FROM ({_NULL_EVENTS}) GROUP BY kind""",
)
def group_null_kept(spark, folder):
    return aggregate.group_aggregate(
        _null_events(spark, folder), "kind", {"who": ["count", "size", "nunique"]}, distinct_counts_null=True
    )


@query(
    "group_aggregate_null_key_dropped",
    f"""SELECT kind, CAST(coalesce(sum(who), 0) AS BIGINT) AS who_sum, count(DISTINCT who) AS who_nunique
        FROM ({_NULL_EVENTS}) WHERE kind IS NOT NULL GROUP BY kind""",
)
def group_null_dropped(spark, folder):
    return aggregate.group_aggregate(
        _null_events(spark, folder), "kind", {"who": ["sum", "nunique"]}, drop_null_keys=True
    )


_LINEITEM_COLUMNS = (
    "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus"
    " l_shipdate"
).split()


@query(
    "count_distinct",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS distinct_count FROM lineitem" for c in _LINEITEM_COLUMNS
    ),
)
def count_distinct(spark, folder):
    return aggregate.count_distinct(table(spark, folder, "lineitem"))


def _describe_number_sql(source, column, dtype):
    return f"""
    SELECT '{column}' AS "column", count({column}) AS "count", round(avg({column}), 4) AS mean,
           round(stddev_samp({column}), 4) AS std, CAST(min({column}) AS DOUBLE) AS min, CAST(max({column}) AS DOUBLE) AS max,
           round(quantile_cont({column}, 0.25), 6) AS p25, round(quantile_cont({column}, 0.5), 6) AS p50,
           round(quantile_cont({column}, 0.75), 6) AS p75, '{dtype}' AS dtype FROM {source}"""


def _rounded():
    return {c: F.round(c, 4) for c in ("mean", "std")} | {c: F.round(c, 6) for c in ("p25", "p50", "p75")}


@query(
    "describe_numbers",
    " UNION ALL ".join(
        _describe_number_sql("lineitem", c, t)
        for c, t in [("l_extendedprice", "double"), ("l_quantity", "double"), ("l_partkey", "bigint")]
    ),
)
def describe_numbers(spark, folder):
    lineitem = table(spark, folder, "lineitem")
    return aggregate.describe(lineitem, ["l_extendedprice", "l_quantity", "l_partkey"]).withColumns(_rounded())


@query(
    "describe_text",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", (SELECT count({c}) FROM orders) AS "count",
                   (SELECT count(DISTINCT {c}) FROM orders) AS "unique", {c} AS top, n AS freq, 'string' AS dtype
            FROM (SELECT {c}, count(*) AS n FROM orders GROUP BY {c} ORDER BY n DESC, {c} LIMIT 1)"""
        for c in ("o_orderstatus", "o_orderpriority")
    ),
)
def describe_text(spark, folder):
    return aggregate.describe(table(spark, folder, "orders"), ["o_orderstatus", "o_orderpriority"])


@query(
    "value_counts",
    "SELECT p_name AS value, count(*) AS n FROM part GROUP BY p_name ORDER BY n DESC, value LIMIT 10",
)
def value_counts(spark, folder):
    return aggregate.value_counts(table(spark, folder, "part"), "p_name", top_k=10)
