"""Queries that pass SQL text through, one per kind of SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowloom.operators import asof as asof_joins
from rowloom.operators import sql
from rowloom.plans.catalog import query, table

# (name, tables, SQL for Spark, SQL for DuckDB or None when the same text runs on both)
_TEXTS = [
    (
        "projection_case",
        ["part"],
        """SELECT p_partkey, mod(p_size, 7) AS size_mod, round(p_retailprice * 1.1, 2) AS marked_up,
                  CASE WHEN p_size > 25 THEN 'large' WHEN p_size > 10 THEN 'medium' ELSE 'small' END AS size_class FROM part""",
        None,
    ),
    (
        "window_ranking",
        ["orders"],
        """SELECT o_orderkey, CAST(rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS BIGINT) AS rnk,
                  CAST(dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS BIGINT) AS drnk,
                  lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS previous,
                  lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS following FROM orders""",
        None,
    ),
    (
        "window_frame",
        ["orders"],
        """SELECT o_orderkey, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey
                  ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS DOUBLE) AS moving_sum FROM orders""",
        None,
    ),
    (
        "sort_limit",
        ["lineitem"],
        """SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM lineitem
           ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey LIMIT 25""",
        None,
    ),
    (
        "set_operations",
        ["supplier", "customer"],
        """SELECT k FROM (SELECT s_nationkey AS k FROM supplier INTERSECT SELECT c_nationkey FROM customer WHERE c_acctbal > 5000)
           UNION ALL (SELECT c_nationkey FROM customer EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 8000)""",
        None,
    ),
    (
        "rollup",
        ["lineitem"],
        """SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity, count(*) AS n
           FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)""",
        None,
    ),
    (
        "cube",
        ["orders"],
        "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)",
        None,
    ),
    (
        "grouping_sets",
        ["orders"],
        """SELECT o_orderstatus, o_orderpriority, count(*) AS n, max(o_orderkey) AS last_key FROM orders
           GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())""",
        None,
    ),
    (
        "semi_join",
        ["customer", "orders"],
        """SELECT c_custkey, c_name FROM customer LEFT SEMI JOIN orders ON c_custkey = o_custkey AND o_totalprice > 400000""",
        """SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE c_custkey = o_custkey AND o_totalprice > 400000)""",
    ),
    (
        "anti_join",
        ["customer", "orders"],
        "SELECT c_custkey, c_name FROM customer LEFT ANTI JOIN orders ON c_custkey = o_custkey AND o_orderpriority = '1-URGENT'",
        """SELECT c_custkey, c_name FROM customer
           WHERE NOT EXISTS (SELECT 1 FROM orders WHERE c_custkey = o_custkey AND o_orderpriority = '1-URGENT')""",
    ),
    (
        "string_functions",
        ["part"],
        """SELECT p_partkey, upper(p_name) AS name, length(p_type) AS type_length, regexp_replace(p_brand, '[^0-9]', '') AS digits,
                  concat(substr(p_type, 1, 3), '-', p_size) AS code FROM part""",
        """SELECT p_partkey, upper(p_name) AS name, CAST(length(p_type) AS INT) AS type_length,
                  regexp_replace(p_brand, '[^0-9]', '', 'g') AS digits, concat(substr(p_type, 1, 3), '-', p_size) AS code FROM part""",
    ),
    (
        "date_functions",
        ["orders"],
        """SELECT CAST(date_trunc('month', o_orderdate) AS TIMESTAMP_NTZ) AS month, count(*) AS n, min(date_add(CAST(o_orderdate AS DATE), 30)) AS due FROM orders
           GROUP BY date_trunc('month', o_orderdate)""",
        """SELECT date_trunc('month', o_orderdate) AS month, count(*) AS n, min(CAST(o_orderdate AS DATE) + 30) AS due FROM orders
           GROUP BY date_trunc('month', o_orderdate)""",
    ),
    (
        "json_and_array_functions",
        ["events"],
        """SELECT event_id, CAST(get_json_object(props, '$.k') AS INT) AS k, size(split(props, ':')) AS pieces,
                  array_max(array(user_id, event_id)) AS larger FROM events""",
        """SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k, CAST(len(string_split(props, ':')) AS INT) AS pieces,
                  list_max([user_id, event_id]) AS larger FROM events""",
    ),
    (
        "conditional_aggregates",
        ["events"],
        """SELECT user_id, count(DISTINCT event_type) AS kinds,
                  CAST(sum(CASE WHEN event_type = 'purchase' THEN CAST(value AS DECIMAL(18,2)) ELSE 0 END) AS DOUBLE) AS bought,
                  count(CASE WHEN event_type = 'error' THEN 1 END) AS errors FROM events GROUP BY user_id""",
        None,
    ),
    (
        "with_and_joins",
        ["region", "nation", "customer", "orders"],
        """WITH spend AS (SELECT o_custkey, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS total FROM orders GROUP BY o_custkey)
           SELECT r_name, count(*) AS buyers, CAST(sum(total) AS DOUBLE) AS total
           FROM spend JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey
           GROUP BY r_name ORDER BY r_name""",
        None,
    ),
    (
        "series",
        ["orders"],
        """SELECT id AS size_step, (SELECT count(*) FROM orders WHERE o_totalprice > 50000 * 3) AS over FROM range(1, 6)""",
        """SELECT range AS size_step, (SELECT count(*) FROM orders WHERE o_totalprice > 50000 * 3) AS over FROM range(1, 6)""",
    ),
]


def _register(name, tables, text, other):
    @query(f"sql_{name}", other or text)
    def run(spark, folder):
        return sql.sql_query(spark, text, {t: table(spark, folder, t) for t in tables})


for _entry in _TEXTS:
    _register(*_entry)


@query(
    "sql_asof_join",
    """SELECT p.event_id, v.event_id AS view_id
       FROM (SELECT * FROM events WHERE event_type <> 'view') p
       ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON p.user_id = v.user_id AND p.ts >= v.ts""",
)
def asof(spark, folder):
    """Last view before each other event.

    Both kinds are stacked per user and day; a running last-value fills in views of the same day,
    and the last view of the nearest earlier day fills the rest. No pairs of events are built, and
    a busy user is spread over as many tasks as there are days.
    """
    text = """
      WITH e AS (SELECT user_id, ts, event_id, event_type, CAST(ts AS DATE) AS day FROM events),
           inside AS (SELECT *, last_value(CASE WHEN event_type = 'view' THEN event_id END) IGNORE NULLS
                        OVER (PARTITION BY user_id, day ORDER BY ts, CASE WHEN event_type = 'view' THEN 0 ELSE 1 END
                              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS view_id FROM e),
           days AS (SELECT user_id, day, max_by(CASE WHEN event_type = 'view' THEN event_id END,
                           CASE WHEN event_type = 'view' THEN ts END) AS last_view FROM e GROUP BY user_id, day),
           earlier AS (SELECT user_id, day, last_value(last_view) IGNORE NULLS
                        OVER (PARTITION BY user_id ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM days)
      SELECT i.event_id, coalesce(i.view_id, d.before) AS view_id
      FROM inside i JOIN earlier d ON i.user_id = d.user_id AND i.day = d.day WHERE i.event_type <> 'view'"""
    return sql.sql_query(spark, text, {"events": table(spark, folder, "events")})


_EARLIER = """SELECT e.event_id, p.event_id AS earlier_id, p.ts AS earlier_ts, p.event_type AS earlier_type
              FROM events e ASOF LEFT JOIN events p ON e.user_id = p.user_id AND e.ts > p.ts"""


def _earlier(spark, folder, **options):
    events = table(spark, folder, "events")
    found = asof_joins.asof_join(events, events, "user_id", "ts", allow_equal=False, tie="event_id", **options)
    names = {"event_id": "event_id_x", "earlier_id": "event_id_y", "earlier_ts": "ts_y", "earlier_type": "event_type_y"}
    return found.select(*[F.col(c).alias(name) for name, c in names.items()])


@query("asof_join", _EARLIER)
def asof_join(spark, folder):
    """Each event with the user's event before it, over all events."""
    return _earlier(spark, folder)


@query(
    "asof_join_within",
    f"""SELECT event_id, earlier_id, earlier_ts, earlier_type FROM ({_EARLIER})
        JOIN (SELECT event_id, ts FROM events) USING (event_id) WHERE earlier_ts >= ts - INTERVAL 6 HOUR""",
)
def asof_within(spark, folder):
    """The same where the event before is at most six hours away."""
    return _earlier(spark, folder, tolerance="6 hours", how="inner")


@query(
    "asof_join_forward",
    """SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_quantity, l.l_extendedprice, o.o_orderdate AS next_order
       FROM lineitem l ASOF LEFT JOIN (SELECT DISTINCT o_orderdate, o_orderstatus FROM orders) o
       ON l.l_linestatus = o.o_orderstatus AND l.l_shipdate <= o.o_orderdate""",
)
def asof_forward(spark, folder):
    """Each order line with the date of the first order of its status from its shipping on: two keys own all rows."""
    lines = table(spark, folder, "lineitem").withColumnRenamed("l_linestatus", "status")
    orders = table(spark, folder, "orders").selectExpr("o_orderstatus AS status", "o_orderdate")
    found = asof_joins.asof_join(lines, orders, "status", "l_shipdate", "o_orderdate", direction="forward")
    kept = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
    return found.select(*kept, F.col("o_orderdate").alias("next_order"))


@query(
    "sql_with_parameters",
    "SELECT event_type, count(*) AS n FROM events WHERE value > 25 AND user_id <= 100 GROUP BY event_type",
)
def parameters(spark, folder):
    return sql.sql_query(
        spark,
        "SELECT event_type, count(*) AS n FROM src WHERE value > :low AND user_id <= :high GROUP BY event_type",
        {"src": f"{folder}/events.parquet"},
        args={"low": 25, "high": 100},
    )


@query("sql_explain")
def explain(spark, folder):
    """The formatted plan, one row per line. Its text is Spark's own, so there is no SQL to compare with."""
    lineitem = {"lineitem": table(spark, folder, "lineitem")}
    plan = sql.explain_query(spark, "SELECT l_returnflag, sum(l_tax) FROM lineitem GROUP BY 1", lineitem)
    return plan.select(F.explode(F.split("plan", "\n")).alias("line"))
