"""The registered queries of the dialect, each with the SQL that an oracle runs on the same tables.

``SELECTS`` are statements over attached tables; their results are brought to common column
names and types by a thin projection.  ``STORES`` run writing statements in a fresh database.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import Database, Executor
from . import fixtures
from .store import fresh_database, fresh_folder

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

_LINES = "l_orderkey, l_linenumber, l_quantity"

#: name: (statement, public names of the result, oracle). Doubles are rounded on both sides.
SELECTS: dict[str, tuple[str, list[str], str]] = {
    "scan_star": ("SELECT * FROM nation", ["n_nationkey", "n_name", "n_regionkey"], "SELECT * FROM nation"),
    "project_reorder": ("SELECT c_name, c_custkey FROM customer", ["c_name", "c_custkey"], "SELECT c_name, c_custkey FROM customer"),
    "project_repeat": ("SELECT n_name, n_nationkey, n_name FROM nation", ["n1", "k", "n2"], "SELECT n_name n1, n_nationkey k, n_name n2 FROM nation"),
    "qualified_single": ("SELECT nation.n_name FROM nation WHERE nation.n_regionkey = 1", ["n_name"], "SELECT n_name FROM nation WHERE n_regionkey = 1"),
    **{
        f"filter_int_{name}": (f"SELECT {_LINES} FROM lineitem WHERE l_linenumber {op} 4", ["l_orderkey", "l_linenumber", "l_quantity"], f"SELECT {_LINES} FROM lineitem WHERE l_linenumber {op} 4")
        for name, op in (("eq", "="), ("ne", "!="), ("lt", "<"), ("le", "<="), ("gt", ">"), ("ge", ">="))
    },
    "filter_int64_eq": ("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey = 7", ["o_orderkey", "o_custkey"], "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey = 7"),
    "filter_int_by_double": ("SELECT n_nationkey FROM nation WHERE n_nationkey > 3.5", ["n_nationkey"], "SELECT n_nationkey FROM nation WHERE n_nationkey > 3.5"),
    **{
        f"filter_float_{name}": (f"SELECT c_custkey FROM customer WHERE c_acctbal {op} 1000.5", ["c_custkey"], f"SELECT c_custkey FROM customer WHERE c_acctbal {op} 1000.5")
        for name, op in (("lt", "<"), ("le", "<="), ("gt", ">"), ("ge", ">="), ("ne", "!="))
    },
    "filter_float_by_int": ("SELECT c_custkey FROM customer WHERE c_acctbal >= 1000", ["c_custkey"], "SELECT c_custkey FROM customer WHERE c_acctbal >= 1000"),
    "filter_float_eq": ("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity = 10.0", ["l_orderkey", "l_linenumber"], "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity = 10"),
    **{
        f"filter_varchar_{name}": (f"SELECT o_orderkey FROM orders WHERE o_orderpriority {op} '3'", ["o_orderkey"], f"SELECT o_orderkey FROM orders WHERE o_orderpriority {op} '3'")
        for name, op in (("lt", "<"), ("ge", ">="), ("ne", "!="))
    },
    "filter_varchar_eq": ("SELECT n_nationkey FROM nation WHERE n_name = 'NATION_3'", ["n_nationkey"], "SELECT n_nationkey FROM nation WHERE n_name = 'NATION_3'"),
    "filter_timestamp": ("SELECT event_id, user_id FROM events WHERE ts >= 1704500000000", ["event_id", "user_id"], "SELECT event_id, user_id FROM events WHERE ts >= make_timestamp(1704500000000000)"),
    "filter_mismatch_empty": ("SELECT c_custkey FROM customer WHERE c_name = 5", ["c_custkey"], "SELECT c_custkey FROM customer WHERE FALSE"),
    "in_int": ("SELECT n_nationkey, n_name FROM nation WHERE n_nationkey IN (1, 4, 9, 99)", ["n_nationkey", "n_name"], "SELECT n_nationkey, n_name FROM nation WHERE n_nationkey IN (1, 4, 9, 99)"),
    "in_float": ("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity IN (1.0, 50.0)", ["l_orderkey", "l_linenumber"], "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity IN (1.0, 50.0)"),
    "in_varchar": ("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag IN ('A', 'R')", ["l_orderkey", "l_linenumber"], "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag IN ('A', 'R')"),
    "in_mixed_kinds": ("SELECT n_nationkey FROM nation WHERE n_nationkey IN (2, 'x')", ["n_nationkey"], "SELECT n_nationkey FROM nation WHERE n_nationkey IN (2)"),
    "and_or_parens": (
        "SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_quantity < 5 OR l_quantity > 45) AND l_returnflag = 'R'",
        ["l_orderkey", "l_linenumber"],
        "SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_quantity < 5 OR l_quantity > 45) AND l_returnflag = 'R'",
    ),
    "and_or_precedence": (
        "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity < 5 OR l_quantity > 45 AND l_returnflag = 'R'",
        ["l_orderkey", "l_linenumber"],
        "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity < 5 OR (l_quantity > 45 AND l_returnflag = 'R')",
    ),
    "agg_global": (
        "SELECT COUNT(*), COUNT(l_quantity), SUM(l_quantity), AVG(l_quantity), MIN(l_quantity), MAX(l_quantity) FROM lineitem",
        ["n", "nq", "s", "a", "lo", "hi"],
        "SELECT COUNT(*) n, COUNT(l_quantity) nq, ROUND(SUM(l_quantity), 4) s, ROUND(AVG(l_quantity), 4) a, MIN(l_quantity) lo, MAX(l_quantity) hi FROM lineitem",
    ),
    "agg_int_sum": ("SELECT SUM(l_linenumber), MIN(l_linenumber), MAX(l_linenumber) FROM lineitem", ["s", "lo", "hi"], "SELECT CAST(SUM(l_linenumber) AS DOUBLE) s, MIN(l_linenumber) lo, MAX(l_linenumber) hi FROM lineitem"),
    "agg_varchar_min_max": ("SELECT MIN(c_name), MAX(c_name) FROM customer", ["lo", "hi"], "SELECT MIN(c_name) lo, MAX(c_name) hi FROM customer"),
    "agg_filtered": ("SELECT COUNT(*), SUM(l_extendedprice) FROM lineitem WHERE l_quantity >= 25", ["n", "s"], "SELECT COUNT(*) n, ROUND(SUM(l_extendedprice), 4) s FROM lineitem WHERE l_quantity >= 25"),
    "agg_empty_zero": (
        "SELECT COUNT(*), SUM(l_quantity), AVG(l_quantity), MAX(l_linenumber) FROM lineitem WHERE l_quantity < 0",
        ["n", "s", "a", "hi"],
        "SELECT COUNT(*) n, COALESCE(SUM(l_quantity), 0.0) s, COALESCE(AVG(l_quantity), 0.0) a, COALESCE(MAX(l_linenumber), 0) hi FROM lineitem WHERE l_quantity < 0",
    ),
    "group_one": (
        "SELECT l_returnflag, COUNT(*), SUM(l_quantity) FROM lineitem WHERE l_quantity >= 10 GROUP BY l_returnflag",
        ["l_returnflag", "n", "s"],
        "SELECT l_returnflag, COUNT(*) n, ROUND(SUM(l_quantity), 4) s FROM lineitem WHERE l_quantity >= 10 GROUP BY 1",
    ),
    "group_multi": (
        "SELECT l_linestatus, l_returnflag, AVG(l_discount), MIN(l_extendedprice), MAX(l_extendedprice) FROM lineitem GROUP BY l_returnflag, l_linestatus",
        ["l_linestatus", "l_returnflag", "a", "lo", "hi"],
        "SELECT l_linestatus, l_returnflag, ROUND(AVG(l_discount), 4) a, ROUND(MIN(l_extendedprice), 4) lo, ROUND(MAX(l_extendedprice), 4) hi FROM lineitem GROUP BY 1, 2",
    ),
    "group_distinct_keys": ("SELECT l_returnflag, l_linestatus FROM lineitem GROUP BY l_returnflag, l_linestatus", ["f", "s"], "SELECT DISTINCT l_returnflag f, l_linestatus s FROM lineitem"),
    "group_empty": ("SELECT l_returnflag, COUNT(*) FROM lineitem WHERE l_quantity < 0 GROUP BY l_returnflag", ["f", "n"], "SELECT l_returnflag f, COUNT(*) n FROM lineitem WHERE FALSE GROUP BY 1"),
    "group_order_key": ("SELECT n_regionkey, COUNT(*) FROM nation GROUP BY n_regionkey ORDER BY n_regionkey DESC LIMIT 3", ["k", "n"], "SELECT n_regionkey k, COUNT(*) n FROM nation GROUP BY 1 ORDER BY 1 DESC LIMIT 3"),
    "group_order_other_min": ("SELECT n_regionkey, COUNT(*) FROM nation GROUP BY n_regionkey ORDER BY n_nationkey LIMIT 2", ["k", "n"], "SELECT n_regionkey k, COUNT(*) n FROM nation GROUP BY 1 ORDER BY MIN(n_nationkey) LIMIT 2"),
    "group_order_aggregate": ("SELECT o_custkey, SUM(o_totalprice) FROM orders GROUP BY o_custkey ORDER BY SUM(o_totalprice) DESC LIMIT 5", ["k", "s"], "SELECT o_custkey k, ROUND(SUM(o_totalprice), 4) s FROM orders GROUP BY 1 ORDER BY SUM(o_totalprice) DESC LIMIT 5"),
    "group_limit_offset": ("SELECT n_regionkey, MAX(n_nationkey) FROM nation GROUP BY n_regionkey ORDER BY n_regionkey LIMIT 2 OFFSET 1", ["k", "hi"], "SELECT n_regionkey k, MAX(n_nationkey) hi FROM nation GROUP BY 1 ORDER BY 1 LIMIT 2 OFFSET 1"),
    "order_asc": ("SELECT c_custkey, c_name FROM customer ORDER BY c_custkey ASC", ["c_custkey", "c_name"], "SELECT c_custkey, c_name FROM customer ORDER BY c_custkey"),
    "order_desc": ("SELECT o_orderkey FROM orders ORDER BY o_orderkey DESC", ["o_orderkey"], "SELECT o_orderkey FROM orders ORDER BY o_orderkey DESC"),
    "order_unprojected": ("SELECT n_name FROM nation ORDER BY n_nationkey DESC LIMIT 4", ["n_name"], "SELECT n_name FROM nation ORDER BY n_nationkey DESC LIMIT 4"),
    "topk": ("SELECT o_orderkey FROM orders ORDER BY o_orderkey DESC LIMIT 10", ["o_orderkey"], "SELECT o_orderkey FROM orders ORDER BY o_orderkey DESC LIMIT 10"),
    "limit_offset": ("SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 7 OFFSET 11", ["c_custkey"], "SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 7 OFFSET 11"),
    "offset_past_end": ("SELECT n_nationkey FROM nation ORDER BY n_nationkey LIMIT 5 OFFSET 1000", ["n_nationkey"], "SELECT n_nationkey FROM nation LIMIT 5 OFFSET 1000"),
    "limit_zero": ("SELECT n_nationkey FROM nation LIMIT 0", ["n_nationkey"], "SELECT n_nationkey FROM nation LIMIT 0"),
    "join_inner": ("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey", ["o_orderkey", "c_name"], "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey"),
    "join_star": (
        "SELECT * FROM supplier JOIN nation ON s_nationkey = n_nationkey",
        ["s_suppkey", "s_name", "s_nationkey", "s_acctbal", "n_nationkey", "n_name", "n_regionkey"],
        "SELECT s_suppkey, s_name, s_nationkey, s_acctbal, n_nationkey, n_name, n_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey",
    ),
    "join_swapped_on": ("SELECT s_suppkey, n_name FROM supplier JOIN nation ON nation.n_nationkey = supplier.s_nationkey", ["s_suppkey", "n_name"], "SELECT s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey"),
    "join_mixed_key_types": ("SELECT n_name, l_orderkey FROM lineitem JOIN nation ON l_quantity = n_nationkey WHERE l_linenumber = 1", ["n_name", "l_orderkey"], "SELECT n_name, l_orderkey FROM lineitem JOIN nation ON l_quantity = n_nationkey WHERE l_linenumber = 1"),
    "join_limit": ("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey ORDER BY o_orderkey LIMIT 9 OFFSET 3", ["o_orderkey", "c_name"], "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey ORDER BY o_orderkey LIMIT 9 OFFSET 3"),
    "join_where_group": (
        "SELECT c_mktsegment, COUNT(*), SUM(o_totalprice) FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 1000 GROUP BY c_mktsegment",
        ["k", "n", "s"],
        "SELECT c_mktsegment k, COUNT(*) n, ROUND(SUM(o_totalprice), 2) s FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 1000 GROUP BY 1",
    ),
}
#: Decimals that double results are rounded to: those sums that only match to fewer have their own.
_DECIMALS = {"join_where_group": 2}
_SUMMED = ("s", "a", "lo", "hi")


def database(spark: SparkSession, sf_dir: str) -> Database:
    """A database with the driver's tables attached; only those that a query names are read."""
    db = fresh_database(spark)
    for t in TABLES:
        db.attach(t, spark.read.parquet(f"{sf_dir}/{t}.parquet"))
    return db


def _select(name: str) -> Callable[[SparkSession, str], DataFrame]:
    sql, names, _ = SELECTS[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = Executor(database(spark, sf_dir)).query(sql).toDF(*names)
        doubles = {n for n, t in df.dtypes if t == "double" and n in _SUMMED}
        return df.select(*[F.round(n, _DECIMALS.get(name, 4)).alias(n) if n in doubles else F.col(n) for n in names])

    return run


# -- writing statements ----------------------------------------------------------------------------


def _loaded(spark: SparkSession, sf_dir: str, index: bool = False) -> tuple[Database, Executor]:
    """A fresh database with a managed copy of ``nation``'s and ``supplier``'s columns."""
    db = fresh_database(spark)
    ex = Executor(db)
    ex.execute("CREATE TABLE s (k INT64, name VARCHAR, nation INT32, bal FLOAT64)")
    if index:
        ex.execute("CREATE INDEX s_nation ON s (nation)")
    db.append("s", spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", "s_name", "s_nationkey", "s_acctbal"))
    return db, ex


_S = "SELECT k, name, nation, bal FROM s"
_ORACLE = "SELECT s_suppkey k, s_name name, s_nationkey nation, s_acctbal bal FROM supplier"


def _index_eq(spark, sf_dir):
    _, ex = _loaded(spark, sf_dir, True)
    return ex.query(f"{_S} WHERE nation = 5")


def _insert_select(spark, sf_dir):
    ex = Executor(fresh_database(spark))
    ex.execute("CREATE TABLE users (id INT32, name VARCHAR, score FLOAT64)")
    ex.execute("INSERT INTO users VALUES (1, 'Alice', 50.5), (2, 'Bob', 75.25)")
    ex.execute("INSERT INTO users VALUES (3, 'Charlie', 10.0)")
    return ex.query("SELECT id, name, score FROM users WHERE score >= 20")


def _insert_coerce(spark, sf_dir):
    ex = Executor(fresh_database(spark))
    ex.execute("CREATE TABLE t (a INT32, b FLOAT64, c VARCHAR, d BOOL)")
    ex.execute("INSERT INTO t VALUES (1.5, 2, 3, 1), ('x', 'y', 'z', 'w'), (7, 1.25, 2.5, 0)")
    return ex.query("SELECT a, b, c, d FROM t")


def _delete_where(spark, sf_dir):
    _, ex = _loaded(spark, sf_dir)
    ex.execute("DELETE FROM s WHERE nation < 10 OR bal > 5000")
    return ex.query(_S)


def _delete_all(spark, sf_dir):
    _, ex = _loaded(spark, sf_dir)
    ex.execute("DELETE FROM s")
    return ex.query("SELECT COUNT(*) FROM s").toDF("n")


def _update_where(spark, sf_dir):
    _, ex = _loaded(spark, sf_dir)
    ex.execute("UPDATE s SET bal = 0.5 WHERE nation IN (1, 2, 3)")
    return ex.query(_S)


def _update_all(spark, sf_dir):
    _, ex = _loaded(spark, sf_dir)
    ex.execute("UPDATE s SET name = 'same'")
    return ex.query(_S)


def _vacuum(spark, sf_dir):
    _, ex = _loaded(spark, sf_dir)
    ex.execute("DELETE FROM s WHERE nation >= 12")
    ex.execute("VACUUM s")
    return ex.query(_S)


def _txn_commit(spark, sf_dir):
    _, ex = _loaded(spark, sf_dir)
    ex.execute("BEGIN")
    ex.execute("INSERT INTO s VALUES (100001, 'new', 3, 1.5)")
    ex.execute("DELETE FROM s WHERE nation = 4")
    ex.execute("COMMIT")
    return ex.query(_S)


def _txn_rollback(spark, sf_dir):
    _, ex = _loaded(spark, sf_dir)
    ex.execute("BEGIN")
    ex.execute("INSERT INTO s VALUES (100001, 'new', 3, 1.5)")
    ex.execute("DELETE FROM s WHERE nation = 4")
    ex.execute("ROLLBACK")
    return ex.query(_S)


def _txn_own_writes(spark, sf_dir):
    _, ex = _loaded(spark, sf_dir)
    ex.execute("BEGIN")
    ex.execute("INSERT INTO s VALUES (100001, 'new', 3, 1.5)")
    return ex.query(_S)


def _txn_snapshot(spark, sf_dir):
    db, ex = _loaded(spark, sf_dir)
    ex.execute("BEGIN")
    Executor(db).execute("DELETE FROM s WHERE nation < 20")
    return ex.query(_S)


def _backup_restore(spark, sf_dir):
    db, ex = _loaded(spark, sf_dir)
    target = fresh_folder(spark)
    ex.execute(f"BACKUP TO '{target}'")
    ex.execute("DELETE FROM s")
    return Executor(Database.open(target, spark)).query(_S)


def _pitr(spark, sf_dir):
    db, ex = _loaded(spark, sf_dir)
    then = db.log.head().commit_time_ms
    ex.execute("DELETE FROM s WHERE nation < 15")
    return Executor(Database.open(db.path, spark, until_ms=then)).query(_S)


def _reopen(spark, sf_dir):
    db, ex = _loaded(spark, sf_dir)
    ex.execute("DELETE FROM s WHERE nation = 0")
    db.close()
    return Executor(Database.open(db.path, spark)).query(_S)


_NEW = "UNION ALL SELECT 100001, 'new', 3, 1.5"
STORES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "index_eq": (_index_eq, f"{_ORACLE} WHERE s_nationkey = 5"),
    "insert_select": (_insert_select, "SELECT CAST(id AS INTEGER) id, name, CAST(score AS DOUBLE) score FROM (VALUES (1, 'Alice', 50.5), (2, 'Bob', 75.25)) t(id, name, score)"),
    "insert_coerce": (_insert_coerce, "SELECT CAST(a AS INTEGER) a, CAST(b AS DOUBLE) b, c, d FROM (VALUES (0, 2.0, '3', TRUE), (0, 0.0, 'z', FALSE), (7, 1.25, '', FALSE)) t(a, b, c, d)"),
    "delete_where": (_delete_where, f"{_ORACLE} WHERE NOT (s_nationkey < 10 OR s_acctbal > 5000)"),
    "delete_all": (_delete_all, "SELECT CAST(0 AS BIGINT) n"),
    "update_where": (_update_where, "SELECT s_suppkey k, s_name name, s_nationkey nation, CASE WHEN s_nationkey IN (1, 2, 3) THEN 0.5 ELSE s_acctbal END bal FROM supplier"),
    "update_all": (_update_all, "SELECT s_suppkey k, 'same' name, s_nationkey nation, s_acctbal bal FROM supplier"),
    "vacuum_after_delete": (_vacuum, f"{_ORACLE} WHERE s_nationkey < 12"),
    "txn_commit": (_txn_commit, f"{_ORACLE} WHERE s_nationkey <> 4 {_NEW}"),
    "txn_rollback": (_txn_rollback, _ORACLE),
    "txn_own_writes": (_txn_own_writes, f"{_ORACLE} {_NEW}"),
    "txn_snapshot": (_txn_snapshot, _ORACLE),
    "backup_restore": (_backup_restore, _ORACLE),
    "pitr": (_pitr, f"{_ORACLE}"),
    "reopen": (_reopen, f"{_ORACLE} WHERE s_nationkey <> 0"),
}


#: Statements whose results keep the names that the dialect gives them; doubles here are exact.
NAMED: dict[str, tuple[str, str]] = {
    "names_star": ("SELECT * FROM region", "SELECT r_regionkey, r_name FROM region"),
    "names_aggregates": (
        "SELECT COUNT(*), COUNT(l_tax), SUM(l_quantity), MIN(l_quantity), MAX(l_linenumber) FROM lineitem",
        'SELECT COUNT(*) AS "COUNT(*)", COUNT(l_tax) AS "COUNT(l_tax)", SUM(l_quantity) AS "SUM(l_quantity)", MIN(l_quantity) AS "MIN(l_quantity)", MAX(l_linenumber) AS "MAX(l_linenumber)" FROM lineitem',
    ),
    "names_group": ("SELECT l_returnflag, SUM(l_quantity) FROM lineitem GROUP BY l_returnflag", 'SELECT l_returnflag, SUM(l_quantity) AS "SUM(l_quantity)" FROM lineitem GROUP BY 1'),
    "names_join": (
        "SELECT nation.n_name, r_name, region.r_regionkey FROM nation JOIN region ON n_regionkey = r_regionkey",
        'SELECT n_name AS "nation.n_name", r_name, r_regionkey AS "region.r_regionkey" FROM nation JOIN region ON n_regionkey = r_regionkey',
    ),
    "names_join_star": (
        "SELECT * FROM nation JOIN region ON n_regionkey = r_regionkey",
        'SELECT n_nationkey AS "nation.n_nationkey", n_name AS "nation.n_name", n_regionkey AS "nation.n_regionkey", r_regionkey AS "region.r_regionkey", r_name AS "region.r_name" FROM nation JOIN region ON n_regionkey = r_regionkey',
    ),
    "names_join_group": (
        "SELECT region.r_name, COUNT(nation.n_name), MAX(nation.n_nationkey) FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY region.r_name",
        'SELECT r_name AS "region.r_name", COUNT(n_name) AS "COUNT(nation.n_name)", MAX(n_nationkey) AS "MAX(nation.n_nationkey)" FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1',
    ),
}


def _named(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: Executor(database(spark, sf_dir)).query(NAMED[name][0])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {name: _select(name) for name in SELECTS} | {name: _named(name) for name in NAMED}
    return found | {name: f for name, (f, _) in (STORES | fixtures.QUERIES).items()}


def oracle_sql() -> dict[str, str]:
    found = {name: sql for name, (_, _, sql) in SELECTS.items()} | {name: sql for name, (_, sql) in NAMED.items()}
    return found | {name: sql for name, (_, sql) in (STORES | fixtures.QUERIES).items()}
