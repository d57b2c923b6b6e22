"""Registered queries over states of the store and small fixtures: what a statement leaves behind, says, names or refuses.

Each comes with the SQL that an oracle runs on the same tables.
"""

from __future__ import annotations

import io
import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..cli import Shell
from ..errors import EngineError
from ..handle import Handle
from ..session import Database, Executor
from ..streaming.schedule import BackupSchedule
from .store import fresh_database, fresh_folder

_TYPES = "CREATE TABLE t (id INT32, flag BOOL, moment TIMESTAMP, name VARCHAR)"
_ROWS = "INSERT INTO t VALUES (1, true, 1700000000000, 'b'), (2, false, 1700000001000, 'a'), (3, true, 1700000002000, 'в'), (4, false, 1700000003000, 'б')"


def _typed(spark: SparkSession) -> Executor:
    ex = Executor(fresh_database(spark))
    ex.execute(_TYPES)
    ex.execute(_ROWS)
    return ex


def _typed_query(where: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: _typed(spark).query(f"SELECT id FROM t {where}")


def _listed(spark: SparkSession, rows: list[dict], column: str) -> DataFrame:
    """Rows that came in an order, with their places."""
    return spark.createDataFrame([(k, r[column]) for k, r in enumerate(rows)], "place long, value string")


def _lines(spark: SparkSession, sf_dir: str, parts: int = 6) -> Executor:
    """A managed copy of lineitem's keys and quantities in several files."""
    db = fresh_database(spark)
    ex = Executor(db)
    ex.execute("CREATE TABLE l (k INT64, line INT32, q FLOAT64, note VARCHAR)")
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")
    db.append("l", rows.repartition(parts, "l_orderkey"))
    return ex


_L = "SELECT k, line, q, note FROM l"
_LINES = "SELECT l_orderkey k, l_linenumber line, {} q, l_returnflag note FROM lineitem"


def _update_all_lines(spark, sf_dir):
    ex = _lines(spark, sf_dir)
    ex.execute("VACUUM l")
    ex.execute("UPDATE l SET q = 5")
    return ex.query(_L)


def _update_some_lines(spark, sf_dir):
    ex = _lines(spark, sf_dir)
    ex.execute("UPDATE l SET q = 0.5 WHERE line = 2")
    ex.execute("UPDATE l SET q = 1.5 WHERE line = 2 AND q < 1")
    return ex.query(_L)


def _rows_touched(spark, sf_dir):
    ex = _lines(spark, sf_dir)
    changed = ex.execute("UPDATE l SET q = 0.5 WHERE line = 2")[0]["rows_updated"]
    gone = ex.execute("DELETE FROM l WHERE line > 3")[0]["rows_deleted"]
    return spark.createDataFrame([(changed, gone)], "updated long, deleted long")


def _nulls(spark: SparkSession, sf_dir: str) -> Executor:
    db = fresh_database(spark)
    ex = Executor(db)
    ex.execute("CREATE TABLE s (k INT64, nation INT32, bal FLOAT64, name VARCHAR)")
    some = F.when(F.col("s_suppkey") % 3 != 0, F.col("s_nationkey"))
    db.append("s", spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", some, F.when(some.isNotNull(), F.col("s_acctbal")), F.when(some.isNull(), F.col("s_name"))))
    return ex


_NULLED = "(SELECT s_suppkey k, CASE WHEN s_suppkey % 3 <> 0 THEN s_nationkey END nation, CASE WHEN s_suppkey % 3 <> 0 THEN s_acctbal END bal, CASE WHEN s_suppkey % 3 = 0 THEN s_name END name FROM supplier)"


def _null_never_matches(spark, sf_dir):
    return _nulls(spark, sf_dir).query("SELECT k, nation FROM s WHERE nation != 3 OR bal < 0.0 OR name = 'none'")


def _null_kept_by_delete(spark, sf_dir):
    ex = _nulls(spark, sf_dir)
    ex.execute("DELETE FROM s WHERE nation >= 0")
    return ex.query("SELECT k, nation, name FROM s")


def _null_aggregates(spark, sf_dir):
    return _nulls(spark, sf_dir).query("SELECT COUNT(*), COUNT(nation), MIN(nation), MAX(name) FROM s")


def _vacuum_with_index(spark, sf_dir):
    ex = _lines(spark, sf_dir)
    ex.execute("CREATE INDEX l_line ON l (line)")
    ex.execute("DELETE FROM l WHERE q > 40")
    ex.execute("VACUUM l")
    return ex.query(f"{_L} WHERE line = 3")


def _indexed_lines(where: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark, sf_dir):
        ex = _lines(spark, sf_dir)
        ex.execute("CREATE INDEX l_k ON l (k)")
        ex.execute("INSERT INTO l VALUES (-5, 1, 2.5, 'new')")
        ex.execute("UPDATE l SET q = 0 WHERE k < 100")
        return ex.query(f"{_L} WHERE {where}")

    return run


_INDEXED = "(SELECT l_orderkey k, l_linenumber line, CASE WHEN l_orderkey < 100 THEN 0 ELSE l_quantity END q, l_returnflag note FROM lineitem UNION ALL SELECT -5, 1, 0, 'new')"


def _vacuum_to_empty(spark, sf_dir):
    ex = _lines(spark, sf_dir)
    ex.execute("DELETE FROM l")
    ex.execute("VACUUM l")
    ex.execute("INSERT INTO l VALUES (1, 2, 3.5, 'x')")
    return ex.query(_L)


def _vacuum_noop(spark, sf_dir):
    ex = _typed(spark)
    ex.execute("VACUUM t")
    ex.execute("VACUUM t")
    return ex.query("SELECT id, name FROM t")


def _vacuum_open_txn(spark, sf_dir):
    """A VACUUM of one table leaves what an open transaction has staged in another."""
    db = fresh_database(spark)
    ex, other = Executor(db), Executor(db)
    for name in ("u", "w"):
        ex.execute(f"CREATE TABLE {name} (a INT32)")
        ex.execute(f"INSERT INTO {name} VALUES (1)")
    ex.execute("BEGIN")
    ex.execute("INSERT INTO w VALUES (2)")
    other.execute("DELETE FROM u")
    other.execute("VACUUM u")
    ex.execute("COMMIT")
    return ex.query("SELECT a FROM w")


def _insert_merge_order(spark, sf_dir):
    """Two transactions that insert at once both keep their rows, those of the first to commit in front."""
    db = fresh_database(spark)
    ex, other = Executor(db), Executor(db)
    ex.execute("CREATE TABLE t (name VARCHAR)")
    ex.execute("BEGIN")
    other.execute("BEGIN")
    ex.execute("INSERT INTO t VALUES ('a1'), ('a2')")
    ex.execute("INSERT INTO t VALUES ('a3')")
    other.execute("INSERT INTO t VALUES ('b1'), ('b2')")
    other.execute("COMMIT")
    ex.execute("COMMIT")
    return _listed(spark, ex.execute("SELECT name FROM t"), "name")


def _insertion_order(spark, sf_dir):
    ex = _typed(spark)
    ex.execute("UPDATE t SET flag = true WHERE id = 2")
    ex.execute("INSERT INTO t VALUES (5, true, 0, 'z')")
    ex.execute("DELETE FROM t WHERE id = 3")
    ex.execute("VACUUM t")
    return _listed(spark, ex.execute("SELECT name FROM t"), "name")


def _concurrent_inserts(spark, sf_dir):
    db = fresh_database(spark)
    Executor(db).execute("CREATE TABLE t (a INT64)")

    def work(k: int) -> None:
        own = Executor(db)
        for n in range(3):
            own.execute(f"INSERT INTO t VALUES ({10 * k + n})")

    threads = [threading.Thread(target=work, args=(k,)) for k in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    return Executor(db).query("SELECT a FROM t")


def _refused_second_writer(spark, sf_dir):
    """Of two transactions that change the same rows the second to commit is refused."""
    db = fresh_database(spark)
    ex, other = Executor(db), Executor(db)
    ex.execute("CREATE TABLE t (a INT32)")
    ex.execute("INSERT INTO t VALUES (1), (2)")
    ex.execute("BEGIN")
    other.execute("BEGIN")
    ex.execute("DELETE FROM t WHERE a = 1")
    other.execute("UPDATE t SET a = 7 WHERE a = 1")
    ex.execute("COMMIT")
    said = "committed"
    try:
        other.execute("COMMIT")
    except EngineError as e:
        said = e.code
    rows = Executor(db).execute("SELECT COUNT(*) FROM t")[0]["COUNT(*)"]
    return spark.createDataFrame([(said, rows)], "second string, n long")


def _torn_commit(spark, sf_dir):
    """Files and manifests that a writer left unfinished are no part of the database."""
    db = fresh_database(spark)
    ex = Executor(db)
    ex.execute(_TYPES)
    ex.execute(_ROWS)
    spark.range(3).write.parquet(db.uri("t/data/left-behind"))
    db.files.create(f"{db.path}/_log/{db.log.head().version + 1:020d}.json.7.part", "{")
    return Executor(Database.open(db.path, spark)).query("SELECT id, name FROM t")


def _versions_pruned(spark, sf_dir):
    """Versions that nobody can ask for go with VACUUM; one that a reader has open stays."""
    db = fresh_database(spark)
    ex, reader = Executor(db), Executor(db)
    ex.execute("CREATE TABLE t (a INT32)")
    for k in range(3):
        ex.execute(f"INSERT INTO t VALUES ({k})")
    reader.execute("BEGIN")
    ex.execute("DELETE FROM t WHERE a = 0")
    ex.execute("VACUUM t")
    held, seen = len(db.log.versions()), len(reader.execute("SELECT a FROM t"))
    reader.execute("COMMIT")
    db.collect_garbage()
    return spark.createDataFrame([(held, seen, len(db.log.versions()))], "held long, seen long, after long")


def _backup_settings(spark, sf_dir):
    """SET BACKUP, and what the schedule then makes and drops."""
    db = fresh_database(spark, nested=True)
    ex = Executor(db)
    ex.execute("CREATE TABLE t (a INT32)")
    ex.execute("INSERT INTO t VALUES (1), (2)")
    said = [ex.execute(f"SET BACKUP {o} TO {n}")[0]["status"] for o, n in (("INTERVAL", 10), ("RETENTION", 60))]
    schedule = BackupSchedule(db)
    now = schedule._last
    early, made = schedule.tick(now + 5_000), schedule.tick(now + 10_000)
    n = Executor(Database.open(made, spark)).execute("SELECT COUNT(*) FROM t")[0]["COUNT(*)"]
    schedule.tick(now + 80_000)
    return spark.createDataFrame([(said[0], said[1], early is None, n, db.files.exists(made))], "first string, second string, early boolean, n long, kept boolean")


def _cells(spark, sf_dir):
    """Cells as text, through a handle on the database."""
    handle = Handle(fresh_folder(spark), spark)
    handle.execute("CREATE TABLE t (a INT32, b FLOAT64, c BOOL, d TIMESTAMP, e VARCHAR)")
    handle.execute("INSERT INTO t VALUES (1, 1.5, true, 1700000000123, 'x'), (-7, 2, false, 0, '')")
    _, r = handle.execute("SELECT * FROM t")
    rows = [(row, r.column_name(c), r.value(row, c)) for row in range(r.row_count) for c in range(r.column_count)]
    return spark.createDataFrame([*rows, (9, "none", r.value(9, 0)), (9, str(r.column_name(9)), r.value(0, 9))], "place long, name string, cell string")


#: What is refused, or counted; behind each the status.
_TOLD = [
    ("SELECT x FROM t", 1), ("SELECT * FROM nope", 1), ("SELECT ID FROM t", 1), ("SELECT id FROM t WHERE zip = 1", 1), ("SELECT id FROM t ORDER BY zip", 1),
    ("SELECT id, COUNT(*) FROM t", 3), ("SELEC", 3), ("INSERT INTO t VALUES (1)", 3), ("COMMIT", 3), ("SELECT id FROM t JOIN u ON t.id = u.id", 3),
    ("CREATE TABLE t (a INT32)", 7), ("DELETE FROM t WHERE id = 2", 0), ("SELECT COUNT(*) FROM t", 0),
]


def _statuses(spark, sf_dir):
    handle = Handle(fresh_folder(spark), spark)
    handle.execute(_TYPES)
    handle.execute(_ROWS)
    handle.execute("CREATE TABLE u (id INT32)")
    rows = [(sql, *handle.execute(sql)) for sql, _ in _TOLD]
    return spark.createDataFrame([(sql, status, r.value(0, 0) if r else None) for sql, status, r in rows], "statement string, status long, cell string")


def _shell(spark, sf_dir):
    out = io.StringIO()
    Shell(fresh_database(spark)).run(["CREATE TABLE t (a INT32, b VARCHAR);\n", "INSERT INTO t VALUES (1, 'x'), (22, 'yy');\n", ".tables\n", ".schema t\n", "SELECT * FROM t;\n", "SELECT zip FROM t;\n", ".exit\n"], out)
    return spark.createDataFrame(list(enumerate(out.getvalue().splitlines())), "place long, line string")


_SHOWN = [
    "+---------+", "| created |", "+---------+", "| true    |", "+---------+", "(1 row)",
    "+---------------+", "| rows_inserted |", "+---------------+", "| 2             |", "+---------------+", "(1 row)",
    "t", "a INT32", "b VARCHAR",
    "+----+----+", "| a  | b  |", "+----+----+", "| 1  | x  |", "| 22 | yy |", "+----+----+", "(2 rows)", "error: column zip not found",
]


def _text(s: str | None) -> str:
    return "NULL" if s is None else "'" + s.replace("'", "''") + "'"


def _values(rows: list[tuple], names: str) -> str:
    cell = lambda v: _text(v) if v is None or isinstance(v, str) else str(v)
    typed = [n.split() for n in names.split(", ")]
    casts = ", ".join(f"CAST(c{k} AS {kind}) AS {n}" for k, (n, kind) in enumerate(typed))
    return f"SELECT {casts} FROM (VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) t({', '.join(f'c{k}' for k in range(len(typed)))})"


_ALL = [(1, "b"), (2, "a"), (3, "в"), (4, "б")]
_T = _values([(1, True, 1700000000, "b"), (2, False, 1700000001, "a"), (3, True, 1700000002, "в"), (4, False, 1700000003, "б")], "id INTEGER, flag BOOLEAN, moment BIGINT, name VARCHAR")
_SQL_CELLS = [
    (0, "a", "1"), (0, "b", "1.500000"), (0, "c", "true"), (0, "d", "2023-11-14 22:13:20"), (0, "e", "x"),
    (1, "a", "-7"), (1, "b", "2.000000"), (1, "c", "false"), (1, "d", "1970-01-01 00:00:00"), (1, "e", ""),
    (9, "none", None), (9, "None", None),
]


def _ids(where: str) -> str:
    return f"SELECT id FROM ({_T}) WHERE {where}"


QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "filter_bool_eq": (_typed_query("WHERE flag = true"), _ids("flag")),
    "filter_bool_ne": (_typed_query("WHERE flag != true"), _ids("NOT flag")),
    "filter_bool_by_int": (_typed_query("WHERE flag = 0"), _ids("NOT flag")),
    "filter_bool_order": (_typed_query("WHERE flag < true"), _ids("NOT flag")),
    "in_bool": (_typed_query("WHERE flag IN (true, 7)"), _ids("flag")),
    "in_timestamp": (_typed_query("WHERE moment IN (1700000001000, 1700000003000, 5)"), _ids("moment IN (1700000001, 1700000003)")),
    "filter_timestamp_ne": (_typed_query("WHERE moment != 1700000001000"), _ids("moment <> 1700000001")),
    "order_varchar": (lambda spark, sf_dir: _listed(spark, _typed(spark).execute("SELECT name FROM t ORDER BY name DESC"), "name"), _values([(0, "в"), (1, "б"), (2, "b"), (3, "a")], "place BIGINT, value VARCHAR")),
    "order_bool": (_typed_query("ORDER BY flag LIMIT 2"), _ids("NOT flag")),
    "order_timestamp": (_typed_query("ORDER BY moment DESC LIMIT 1"), _ids("id = 4")),
    "null_never_matches": (_null_never_matches, f"SELECT k, nation FROM {_NULLED} WHERE nation <> 3 OR bal < 0 OR name = 'none'"),
    "null_kept_by_delete": (_null_kept_by_delete, f"SELECT k, nation, name FROM {_NULLED} WHERE nation IS NULL"),
    "null_aggregates": (_null_aggregates, f'SELECT COUNT(*) AS "COUNT(*)", COUNT(nation) AS "COUNT(nation)", MIN(nation) AS "MIN(nation)", MAX(name) AS "MAX(name)" FROM {_NULLED}'),
    "update_all_lines": (_update_all_lines, _LINES.format("CAST(5 AS DOUBLE)")),
    "update_some_lines": (_update_some_lines, _LINES.format("CASE WHEN l_linenumber = 2 THEN 1.5 ELSE l_quantity END")),
    "rows_touched": (_rows_touched, "SELECT CAST(SUM(CASE WHEN l_linenumber = 2 THEN 1 ELSE 0 END) AS BIGINT) updated, CAST(SUM(CASE WHEN l_linenumber > 3 THEN 1 ELSE 0 END) AS BIGINT) deleted FROM lineitem"),
    "vacuum_with_index": (_vacuum_with_index, f"{_LINES.format('l_quantity')} WHERE l_linenumber = 3 AND l_quantity <= 40"),
    **{
        f"index_{name}": (_indexed_lines(where), f"SELECT k, line, q, note FROM {_INDEXED} WHERE {where}")
        for name, where in (("range", "k >= 90 AND k < 120"), ("in", "k IN (7, 100, 101, 999999999)"), ("or", "k = 3 OR note = 'new'"), ("ne", "k != 5 AND k <= 9"))
    },
    "vacuum_to_empty": (_vacuum_to_empty, "SELECT CAST(1 AS BIGINT) k, 2 line, CAST(3.5 AS DOUBLE) q, 'x' note"),
    "vacuum_noop": (_vacuum_noop, _values(_ALL, "id INTEGER, name VARCHAR")),
    "vacuum_open_txn": (_vacuum_open_txn, _values([(1,), (2,)], "a INTEGER")),
    "insert_merge_order": (_insert_merge_order, _values(list(enumerate(["b1", "b2", "a1", "a2", "a3"])), "place BIGINT, value VARCHAR")),
    "insertion_order": (_insertion_order, _values(list(enumerate(["b", "б", "a", "z"])), "place BIGINT, value VARCHAR")),
    "concurrent_inserts": (_concurrent_inserts, "SELECT CAST(10 * k + n AS BIGINT) a FROM range(4) x(k), range(3) y(n)"),
    "refused_second_writer": (_refused_second_writer, _values([("not_visible", 1)], "second VARCHAR, n BIGINT")),
    "torn_commit": (_torn_commit, _values(_ALL, "id INTEGER, name VARCHAR")),
    "versions_pruned": (_versions_pruned, _values([(2, 3, 1)], "held BIGINT, seen BIGINT, after BIGINT")),
    "backup_settings": (_backup_settings, "SELECT 'CONFIG UPDATED' AS first, 'CONFIG UPDATED' AS second, TRUE AS early, CAST(2 AS BIGINT) n, FALSE AS kept"),
    "handle_cells": (_cells, _values(_SQL_CELLS, "place BIGINT, name VARCHAR, cell VARCHAR")),
    "handle_statuses": (_statuses, _values([(sql, status, {"DELETE FROM t WHERE id = 2": "1", "SELECT COUNT(*) FROM t": "3"}.get(sql)) for sql, status in _TOLD], "statement VARCHAR, status BIGINT, cell VARCHAR")),
    "shell_output": (_shell, _values(list(enumerate(_SHOWN)), "place BIGINT, line VARCHAR")),
}
