"""Time the headline queries and print one JSON line.

BENCH_SF_DIR: folder of the tables (default /root/testdata/sf0.1)
BENCH_CPUS:   cores of local mode (default 8)
BENCH_RUNS:   timed runs per query after one warm-up (default 3; the median counts)
BENCH_QUERIES: comma-separated names instead of the headline list, or "all"
BENCH_DUCKDB: 0 leaves out the reference times
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from rowloom.plans.catalog import TABLES, load_all  # noqa: E402
from rowloom.session import build_session  # noqa: E402

HEADLINE = (
    "flagship_user_activity filter_equal filter_not_equal_keeps_missing filter_time_range head_tail sample_random"
    " sample_stratified join_inner join_outer_null_safe key_presence group_aggregate count_distinct describe_numbers"
    " describe_text value_counts pivot resample_hourly_with_gaps histogram diff_keys diff_summary reconcile_counts"
    " schema_check validate_events run_expectations profile_events profile_documents json_extract_nested"
    " filter_by_path group_by_path parse_json_targets parse_json_discovered flatten_envelope fingerprint dedupe_by_columns"
    " correlate triage_payload offset_summary read_tail search_documents sql_with_and_joins sql_asof_join"
    " convert_parquet_to_csv stream_group_counts"
).split()


def timed(action, runs: int) -> float:
    action()
    times = []
    for _ in range(runs):
        start = time.perf_counter()
        action()
        times.append(time.perf_counter() - start)
    return statistics.median(times)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    entries = load_all()
    chosen = os.environ.get("BENCH_QUERIES")
    names = HEADLINE if not chosen else list(entries) if chosen == "all" else chosen.split(",")

    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "16g",
            "spark.checkpoint.dir": os.environ.get("BENCH_SHARED", os.path.abspath("spark-warehouse/_shared")),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds, failed = {}, {}
    for name in names:
        try:
            seconds[name] = round(
                timed(lambda: entries[name].run(spark, folder).write.format("noop").mode("overwrite").save(), runs), 4
            )
        except Exception as error:  # a broken query must not hide the others
            failed[name] = str(error).splitlines()[0][:200]
    spark.stop()

    reference = {}
    if os.environ.get("BENCH_DUCKDB", "1") != "0":
        import duckdb

        connection = duckdb.connect()
        connection.execute(f"SET threads = {cpus}")
        for name in TABLES:
            connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
        for name in seconds:
            if entries[name].sql:
                statement = f"CREATE OR REPLACE TEMP TABLE result AS {entries[name].sql}"
                reference[name] = round(timed(lambda: connection.execute(statement), 1), 4)

    result = {
        "metric": "total seconds of the headline queries",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(folder).removeprefix("sf"),
        "cpus": int(cpus),
        "duckdb": reference,
    }
    if failed:
        result["failed"] = failed
    print(json.dumps(result))


if __name__ == "__main__":
    main()
