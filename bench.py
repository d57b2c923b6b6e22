"""Headline timings: prints one JSON line.

Environment: BENCH_SF_DIR (tables), BENCH_CPUS (cores).  Each query runs once to warm up and is then
timed; the value is the sum of the seconds.
"""

from __future__ import annotations

import json
import os
import tempfile
import time

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "4")

#: Dialect statements that mirror the published micro-benchmarks, over the attached tables.
STATEMENTS = {
    "full_scan": "SELECT * FROM lineitem",
    "filter_numeric": "SELECT * FROM lineitem WHERE l_orderkey > 50000",
    "equality_lookup": "SELECT * FROM lineitem WHERE l_orderkey = 4242",
    "group_by_five_aggregates": "SELECT l_returnflag, COUNT(*), SUM(l_quantity), AVG(l_discount), MIN(l_extendedprice), MAX(l_extendedprice) FROM lineitem GROUP BY l_returnflag",
    "join_orders_customer": "SELECT c_mktsegment, COUNT(*), SUM(o_totalprice) FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment",
    "top_k": "SELECT l_orderkey, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC LIMIT 100",
}
#: Rows of the one-column table that the published figures are for.
ROWS = 10_000_000


def main() -> None:
    from pyspark.sql import SparkSession

    from tessera.plans.queries import database
    from tessera.session import Database, Executor

    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ex = Executor(database(spark, SF_DIR))
    seconds: dict[str, float] = {}

    def timed(name: str, run) -> None:
        run()
        began = time.perf_counter()
        run()
        seconds[name] = round(time.perf_counter() - began, 4)

    for name, sql in STATEMENTS.items():
        timed(name, lambda sql=sql: ex.query(sql).write.format("noop").mode("overwrite").save())

    with tempfile.TemporaryDirectory() as folder:
        own = Executor(db := Database.open(f"{folder}/db", spark))
        own.execute("CREATE TABLE t (id INT64, v FLOAT64)")
        batch = spark.range(10_000).selectExpr("id", "cast(id as double) as v")
        timed("append_10000_rows", lambda: db.append("t", batch))
        own.execute("CREATE INDEX t_id ON t (id)")
        timed("indexed_lookup", lambda: own.query("SELECT * FROM t WHERE id = 4711").collect())
        own.execute("CREATE TABLE big (id INT64)")
        began = time.perf_counter()
        db.append("big", spark.range(0, ROWS, 1, int(CPUS)).toDF("id"))
        seconds["append_10m_rows"] = round(time.perf_counter() - began, 4)
        scan = lambda sql: own.query(sql).write.format("noop").mode("overwrite").save()
        timed("full_scan_10m", lambda: scan("SELECT * FROM big"))
        timed("filter_10m", lambda: scan("SELECT * FROM big WHERE id > 50000"))
        own.execute("CREATE INDEX big_id ON big (id)")
        timed("indexed_lookup_10m", lambda: own.query("SELECT * FROM big WHERE id = 4242424").collect())
        timed("update_where", lambda: own.execute("UPDATE t SET v = 1.5 WHERE id < 100"))
        timed("delete_where", lambda: own.execute("DELETE FROM t WHERE id = 17"))
    print(json.dumps({"metric": "sum of warm query times", "value": round(sum(seconds.values()), 4), "unit": "sec", "queries": seconds, "sf": SF_DIR.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
