"""The dialect, the store and the shell on small fixtures."""

import io
import threading

import pyarrow.parquet as pq
import pytest

from tessera.cli import Shell
from tessera.errors import AlreadyExists, Conflict, InvalidArgument, NotFound, engine_error
from tessera.functions.types import coerce, rendered
from tessera.handle import Handle
from tessera.plans import ast, queries
from tessera.plans.parser import parse
from tessera.session import Database, Executor
from tessera.streaming.schedule import BackupSchedule

from .oracle import connection, same


@pytest.fixture
def db(spark, tmp_path):
    return Database.open(str(tmp_path / "db"), spark)


@pytest.fixture
def ex(db):
    return Executor(db)


def users(ex):
    ex.execute("CREATE TABLE users (id INT32, name VARCHAR, score FLOAT64)")
    ex.execute("INSERT INTO users VALUES (1, 'Alice', 50.5), (2, 'Bob', 120.0), (3, 'Charlie', 75.25)")


# -- parser ------------------------------------------------------------------------------------


def test_parse_select():
    s = parse("select a, COUNT(*), max(t.b) FROM t join u on t.a = u.a where (a = 1 or b != 'x') and c in (1, 2.5, 'z') group by a order by a desc limit 3 offset 1;")
    assert s.columns == (ast.ColumnRef("a"), ast.ColumnRef("*", None, "COUNT"), ast.ColumnRef("b", "t", "MAX"))
    assert s.join == ast.Join("u", ast.ColumnRef("a", "t"), ast.ColumnRef("a", "u"))
    assert isinstance(s.where, ast.BoolOp) and s.where.op == "AND" and s.where.left.op == "OR"
    assert (s.descending, s.limit, s.offset) == (True, 3, 1)


def test_and_binds_tighter():
    w = parse("SELECT * FROM t WHERE a = 1 OR b = 2 AND c = 3").where
    assert w.op == "OR" and w.right.op == "AND"


@pytest.mark.parametrize(
    "sql",
    ["", "SELEC * FROM t", "SELECT * FROM", "SELECT * FROM t WHERE", "SELECT * FROM t LIMIT -1", "SELECT * FROM t LIMIT 2.5", "SELECT * FROM t OFFSET 1",
     "SELECT SUM(*) FROM t", "INSERT INTO t VALUES 1", "SELECT * FROM t; SELECT * FROM t", "SELECT * FROM t WHERE a <> 1", "CREATE TABLE t (a VARCHAR(3))",
     "SELECT * FROM t #", "CREATE INDEX i ON t (a, b)", "SET BACKUP X TO 1", "SELECT count FROM t"],
)
def test_rejected(sql):
    with pytest.raises(InvalidArgument):
        parse(sql)


def test_coerce_and_render():
    assert [coerce(1.5, "INT32"), coerce("x", "INT64"), coerce("x", "FLOAT64"), coerce(2, "FLOAT64")] == [0, 0, 0.0, 2.0]
    assert [coerce(3, "VARCHAR"), coerce(2.5, "VARCHAR"), coerce("w", "BOOL"), coerce(1, "BOOL")] == ["3", "", False, True]
    with pytest.raises(InvalidArgument):
        coerce(1 << 31, "INT32")
    assert [rendered(x) for x in (1.5, True, None, 3)] == ["1.500000", "true", "NULL", "3"]


# -- statements --------------------------------------------------------------------------------


def test_insert_select_order(ex):
    users(ex)
    assert [r["name"] for r in ex.execute("SELECT name FROM users")] == ["Alice", "Bob", "Charlie"]
    assert ex.execute("SELECT id FROM users WHERE name = 'Bob'") == [{"id": 2}]
    assert [r["id"] for r in ex.execute("SELECT id FROM users ORDER BY score DESC")] == [2, 3, 1]
    assert ex.execute("SELECT COUNT(*), SUM(score), MAX(id) FROM users") == [{"COUNT(*)": 3, "SUM(score)": 245.75, "MAX(id)": 3}]
    assert ex.execute("UPDATE users SET score = 1 WHERE id = 1") == [{"rows_updated": 1}]
    assert [r["name"] for r in ex.execute("SELECT name FROM users")] == ["Bob", "Charlie", "Alice"]
    assert ex.execute("DELETE FROM users WHERE score > 100") == [{"rows_deleted": 1}]
    assert ex.execute("VACUUM users") == [{"vacuumed": True}]
    assert ex.execute("DELETE FROM users") == [{"rows_deleted": 2}]
    assert ex.execute("SELECT * FROM users") == []


def test_types(ex):
    ex.execute("CREATE TABLE t (a INT, b BOOL, c TIMESTAMP, d whatever, e)")
    ex.execute("INSERT INTO t VALUES (1, true, 1700000000123, 'x', 5)")
    assert ex.execute("SELECT * FROM t WHERE b = true AND c > 1699999999999") == [{"a": 1, "b": True, "c": "2023-11-14 22:13:20", "d": "x", "e": "5"}]
    assert ex.execute("SELECT a FROM t WHERE b = 0") == [] and ex.execute("SELECT a FROM t WHERE d < 5") == []
    with pytest.raises(InvalidArgument):
        ex.execute("SELECT SUM(d) FROM t")


def test_utf8_order(ex):
    ex.execute("CREATE TABLE u (name VARCHAR)")
    ex.execute("INSERT INTO u VALUES ('в'), ('b'), ('а'), ('c'), ('б'), ('a')")
    assert [r["name"] for r in ex.execute("SELECT name FROM u ORDER BY name")] == ["a", "b", "c", "а", "б", "в"]


def test_join_fixture(ex):
    users(ex)
    ex.execute("CREATE TABLE orders (id INT32, user_id INT32, amount FLOAT64)")
    ex.execute("INSERT INTO orders VALUES (101, 1, 50.5), (102, 1, 120.0), (103, 2, 75.25)")
    rows = ex.execute("SELECT users.name, orders.amount FROM users JOIN orders ON users.id = orders.user_id")
    assert sorted((r["users.name"], r["orders.amount"]) for r in rows) == [("Alice", 50.5), ("Alice", 120.0), ("Bob", 75.25)]
    with pytest.raises(InvalidArgument):
        ex.execute("SELECT id FROM users JOIN orders ON users.id = orders.user_id")
    with pytest.raises(NotFound):
        ex.execute("SELECT name FROM users JOIN orders ON id = user_id")
    with pytest.raises(InvalidArgument):
        ex.execute("SELECT name FROM users JOIN orders ON users.id = users.id")


@pytest.mark.parametrize(
    ("sql", "error"),
    [("SELECT x FROM users", NotFound), ("SELECT * FROM nope", NotFound), ("SELECT NAME FROM users", NotFound), ("SELECT id, COUNT(*) FROM users", InvalidArgument),
     ("SELECT id FROM users ORDER BY zip", NotFound), ("INSERT INTO users VALUES (1)", InvalidArgument), ("UPDATE users SET zip = 1", NotFound),
     ("CREATE TABLE users (a INT32)", AlreadyExists), ("CREATE INDEX i ON users (zip)", NotFound), ("COMMIT", InvalidArgument), ("SELECT other.id FROM users", NotFound)],
)
def test_errors(ex, sql, error):
    users(ex)
    with pytest.raises(error):
        ex.execute(sql)


# -- transactions --------------------------------------------------------------------------------


def test_snapshot_isolation_and_own_writes(db, ex):
    users(ex)
    other = Executor(db)
    ex.execute("BEGIN")
    ex.execute("INSERT INTO users VALUES (4, 'Dan', 1.0)")
    assert len(ex.execute("SELECT * FROM users")) == 4 and len(other.execute("SELECT * FROM users")) == 3
    other.execute("INSERT INTO users VALUES (5, 'Eve', 2.0)")
    assert len(ex.execute("SELECT * FROM users")) == 4
    ex.execute("COMMIT")
    assert len(other.execute("SELECT * FROM users")) == 5
    with pytest.raises(InvalidArgument):
        ex.execute("COMMIT")


def test_first_committer_wins(db, ex):
    users(ex)
    other = Executor(db)
    ex.execute("BEGIN")
    other.execute("BEGIN")
    ex.execute("UPDATE users SET score = 1.0 WHERE id = 1")
    other.execute("DELETE FROM users WHERE id = 1")
    ex.execute("COMMIT")
    with pytest.raises(Conflict):
        other.execute("COMMIT")
    assert len(ex.execute("SELECT * FROM users")) == 3


def test_rollback_and_vacuum_keep_readers(db, ex):
    users(ex)
    ex.execute("BEGIN")
    ex.execute("DELETE FROM users")
    assert ex.execute("ROLLBACK") == [{"status": "OK"}]
    reader = Executor(db)
    reader.execute("BEGIN")
    ex.execute("DELETE FROM users WHERE id = 1")
    ex.execute("VACUUM users")
    assert len(reader.execute("SELECT * FROM users")) == 3 and len(ex.execute("SELECT * FROM users")) == 2
    reader.execute("COMMIT")


def test_concurrent_inserts(db, ex):
    ex.execute("CREATE TABLE test (id INT64, name VARCHAR)")

    def work(k):
        own = Executor(db)
        for n in range(3):
            own.execute(f"INSERT INTO test VALUES ({10 * k + n}, 'x')")

    threads = [threading.Thread(target=work, args=(k,)) for k in range(4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert ex.execute("SELECT COUNT(*) FROM test") == [{"COUNT(*)": 12}]


def test_index_never_changes_results(ex):
    users(ex)
    before = ex.execute("SELECT * FROM users WHERE id = 2")
    assert ex.execute("CREATE INDEX by_id ON users (id)") == [{"created": True}]
    ex.execute("INSERT INTO users VALUES (2, 'Bob2', 0.0)")
    assert ex.execute("SELECT * FROM users WHERE id = 2")[:1] == before
    assert "PushedFilters: [IsNotNull(id), EqualTo(id,2)]" in ex.query("SELECT name FROM users WHERE id = 2")._jdf.queryExecution().toString()
    with pytest.raises(AlreadyExists):
        ex.execute("CREATE INDEX by_id ON users (name)")


def test_reopen_backup_and_past(db, ex, spark, tmp_path):
    users(ex)
    then = db.log.head().commit_time_ms
    assert ex.execute(f"BACKUP TO '{tmp_path}/copy'") == [{"status": "BACKUP SUCCESS"}]
    ex.execute("DELETE FROM users WHERE id = 1")
    count = lambda d: Executor(d).execute("SELECT COUNT(*) FROM users")[0]["COUNT(*)"]
    assert count(Database.open(f"{tmp_path}/copy", spark)) == 3
    assert count(Database.open(db.path, spark)) == 2
    past = Database.open(db.path, spark, until_ms=then)
    assert count(past) == 3
    with pytest.raises(InvalidArgument):
        Executor(past).execute("DELETE FROM users")
    with pytest.raises(AlreadyExists):
        ex.execute(f"BACKUP TO '{tmp_path}/copy'")


def test_scheduled_backups(db, ex, tmp_path):
    users(ex)
    assert ex.execute("SET BACKUP INTERVAL TO 10") == [{"status": "CONFIG UPDATED"}]
    ex.execute("SET BACKUP RETENTION TO 60")
    schedule = BackupSchedule(db)
    now = schedule._last
    assert schedule.tick(now + 5_000) is None
    made = schedule.tick(now + 10_000)
    assert db.files.exists(f"{made}/backup.json")
    schedule.tick(now + 80_000)
    assert not db.files.exists(made)


def test_shell(db):
    out = io.StringIO()
    Shell(db).run(["CREATE TABLE t (a INT32,\n", "b VARCHAR);\n", "INSERT INTO t VALUES (1, 'x');\n", ".tables\n", ".schema t\n", "SELECT * FROM t;\n", "SELECT zip FROM t;\n", ".exit\n", "SELECT"], out)
    text = out.getvalue()
    assert "| a | b |" in text and "(1 row)" in text and "a INT32" in text and "error: column zip not found" in text


@pytest.mark.parametrize("name", ["index_eq", "delete_where", "vacuum_after_delete", "backup_restore", "pitr", "reopen"])
def test_stores_lie_in_the_shared_folder(spark, name):
    """Executors write a table's files where the driver can list them."""
    files = queries.STORES[name][0](spark, "/root/testdata/sf0.001").inputFiles()
    shared = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    assert files and all(f.removeprefix("file://").startswith(f"{shared}/") for f in files)


# -- no row is lost -------------------------------------------------------------------------------


@pytest.mark.parametrize("advisory", ["64m", "100k"])
def test_update_of_large_files_keeps_rows(db, ex, spark, advisory):
    """Over 100 MB in one file, rewritten under default and tiny partition sizes of the adaptive plan."""
    before = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", advisory)
    try:
        ex.execute("CREATE TABLE t (id INT64, pad VARCHAR)")
        n = 400_000
        assert db.append("t", spark.range(n).selectExpr("id", "concat(sha2(cast(id as string), 512), sha2(cast(id + 1 as string), 512))")) == n
        ex.execute("VACUUM t")
        assert sum(f.bytes for f in db.log.head().tables["t"].files) > 50 << 20
        assert ex.execute("UPDATE t SET id = 5") == [{"rows_updated": n}]
        assert ex.execute("SELECT COUNT(*), MIN(id), MAX(id) FROM t") == [{"COUNT(*)": n, "MIN(id)": 5, "MAX(id)": 5}]
        assert ex.execute("DELETE FROM t WHERE id = 5") == [{"rows_deleted": n}]
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", before)


def test_append_reads_its_source_once(db, ex, spark):
    """A source that gives other rows each time it runs is counted as it was written."""
    ex.execute("CREATE TABLE t (v FLOAT64)")
    rows = spark.range(10_000).selectExpr("rand() v").where("v < 0.5")
    assert ex.execute("SELECT COUNT(*) FROM t")[0]["COUNT(*)"] == 0
    n = db.append("t", rows)
    assert ex.execute("SELECT COUNT(*) FROM t")[0]["COUNT(*)"] == n > 0


def test_vacuum_goes_by_bytes(db, ex, spark, monkeypatch):
    """Files near the size aimed at stay; small ones become as many as their bytes need; an index deals equal keys too."""
    ex.execute("CREATE TABLE t (id INT64, k INT32, pad VARCHAR)")
    rows = spark.range(40_000).selectExpr("id", "1", "sha2(cast(id as string), 512)")
    db.append("t", rows.repartition(8))
    files = lambda: db.log.head().tables["t"].files
    total = sum(f.bytes for f in files())
    monkeypatch.setattr("tessera.session.TARGET", total // 8)
    ex.execute("VACUUM t")
    assert len(files()) == 8
    monkeypatch.setattr("tessera.session.TARGET", total // 3)
    ex.execute("VACUUM t")
    assert 3 <= len(files()) <= 4
    monkeypatch.setattr("tessera.session.TARGET", total // 6)
    ex.execute("CREATE INDEX t_k ON t (k)")
    assert 5 <= len(files()) <= 8
    assert ex.execute("SELECT COUNT(*), MAX(id) FROM t WHERE k = 1") == [{"COUNT(*)": 40_000, "MAX(id)": 39_999}]


def test_lease_that_expired_is_refused_at_commit(db, ex, monkeypatch):
    users(ex)
    ex.execute("BEGIN")
    ex.execute("INSERT INTO users VALUES (4, 'Dan', 1.0)")
    monkeypatch.setattr("tessera.session.LEASE_MS", -1)
    Executor(db).execute("VACUUM users")
    with pytest.raises(Conflict):
        ex.execute("COMMIT")
    assert len(ex.execute("SELECT * FROM users")) == 3


def test_lazy_result_outlives_vacuum(db, ex):
    users(ex)
    lazy = ex.query("SELECT id FROM users")
    ex.execute("DELETE FROM users WHERE id = 1")
    ex.execute("VACUUM users")
    assert lazy.count() == 3
    del lazy
    assert not db.pins


def test_handle_and_result(spark, tmp_path):
    handle = Handle(str(tmp_path / "db"), spark)
    assert handle.execute("CREATE TABLE t (id INT32)")[0] == 0
    handle.execute("INSERT INTO t VALUES (10), (20), (30)")
    status, r = handle.execute("DELETE FROM t WHERE id < 30")
    assert (status, r.row_count, r.column_count, r.column_name(0), r.value(0, 0)) == (0, 1, 1, "rows_deleted", "2")
    assert r.value(1, 0) is None and r.value(0, 1) is None and r.column_name(1) is None and r.value(-1, 0) is None
    assert handle.execute("SELECT * FROM t WHERE id = 0")[1].row_count == 0
    assert handle.execute("SELECT nope FROM t") == (1, None) and "nope" in handle.error_message
    handle.execute("BEGIN")
    assert handle.execute("COMMIT")[0] == 3
    handle.close()
    assert handle.execute("SELECT * FROM t")[0] == 3


def test_errors_of_spark_have_a_status():
    assert [engine_error(e).code for e in (OSError("No space left on device"), OSError("x"), RuntimeError("java.lang.OutOfMemoryError: heap"), RuntimeError("is not a Parquet file"), RuntimeError("?"))] == ["no_space", "io_error", "out_of_memory", "corrupted_data", "fatal"]


def test_index_prunes_files_by_the_manifest(db, ex, spark, monkeypatch):
    """A lookup reads only files whose bounds hold the value, in SELECT, UPDATE and DELETE; nulls and odd values do no harm."""
    ex.execute("CREATE TABLE t (id INT64, x FLOAT64, name VARCHAR)")
    rows = spark.range(8000).selectExpr("id", "CASE WHEN id % 100 = 0 THEN double('nan') ELSE id / 7 END", "CASE WHEN id % 5 = 0 THEN NULL ELSE concat('n', id) END")
    for column in ("id", "x", "name"):
        ex.execute(f"CREATE INDEX by_{column} ON t ({column})")
    db.append("t", rows)
    monkeypatch.setattr("tessera.session.TARGET", sum(f.bytes for f in db.log.head().tables["t"].files) // 8)
    ex.execute("VACUUM t")
    n = len(db.log.head().tables["t"].files)
    read = lambda where: len(ex.query(f"SELECT id FROM t WHERE {where}").inputFiles())
    assert n >= 6 and read("id = 4711") == 1 and read("t.id IN (3, 7990)") == 2 and read("id >= 0") == n and read("id < 0") == 0
    assert read("id = 4711 OR id = 12") == 2 and read("id = 'x' OR x > 1") == n and read("id > 10 AND id < 12") == 1
    assert [r["id"] for r in ex.execute("SELECT id FROM t WHERE id = 4711")] == [4711]
    assert len(ex.execute("SELECT id FROM t WHERE x > 1142.0")) == spark.range(8000).where("id % 100 = 0 OR id / 7 > 1142").count()
    assert ex.execute("SELECT id FROM t WHERE name = 'n4711'") == [{"id": 4711}] and ex.execute("SELECT id FROM t WHERE name = 'zzz'") == []
    assert ex.execute("UPDATE t SET id = 9000 WHERE id = 4711") == [{"rows_updated": 1}] and ex.execute("DELETE FROM t WHERE id = 9000") == [{"rows_deleted": 1}]
    assert ex.execute("SELECT COUNT(*) FROM t") == [{"COUNT(*)": 7999}]
    assert Executor(Database.open(db.path, spark)).query("SELECT id FROM t WHERE id = 5").count() == 1


# -- what a task sorts ----------------------------------------------------------------------------


def rows_by_file(db, table):
    return [pq.read_metadata(f"{db.path}/{f.path}").num_rows for f in db.log.head().tables[table].files]


@pytest.fixture
def written(monkeypatch):
    """Rows of the largest file of each write, while a task is to sort 100,000 bytes (775 rows of the lines)."""
    seen, write = [], Database.write
    monkeypatch.setattr("tessera.session.SORTED", 100_000, raising=False)

    def noting(self, table, state, *args):
        files = write(self, table, state, *args)
        seen.append(max(pq.read_metadata(f"{self.path}/{f.path}").num_rows for f in files))
        return files

    monkeypatch.setattr(Database, "write", noting)
    return seen


@pytest.mark.parametrize("name", ["index_ne", "index_or", "vacuum_with_index", "index_in", "index_range"])
def test_lines_are_sorted_in_bounded_parts(spark, written, name):
    """6,000 rows never meet in one task's sort, and the result is the oracle's."""
    sf_dir = "/root/testdata/sf0.001"
    ok, told = same(spark, queries.queries()[name], queries.oracle_sql()[name], sf_dir, connection(sf_dir))
    assert ok, told
    assert len(written) > 1 and max(written[1:]) <= 1100, written


def test_index_deals_rows_by_memory(db, ex, spark):
    """Rows that compress to a few MB, and take 640 MB in memory, are dealt to two tasks."""
    ex.execute("CREATE TABLE t (id INT64, pad VARCHAR)")
    db.append("t", spark.range(300_000).selectExpr("id", "repeat('x', 2000)"))
    assert sum(f.bytes for f in db.log.head().tables["t"].files) < 16 << 20
    ex.execute("CREATE INDEX t_id ON t (id)")
    assert max(rows_by_file(db, "t")) < 200_000 and sum(rows_by_file(db, "t")) == 300_000


def test_update_of_indexed_rows_is_dealt(db, ex, spark, monkeypatch):
    """An UPDATE of all rows sorts no more than a task may, also where its text makes them larger."""
    ex.execute("CREATE TABLE t (id INT64, name VARCHAR)")
    ex.execute("CREATE INDEX t_id ON t (id)")
    db.append("t", spark.range(4000).selectExpr("4000 - id", "'a'"))
    monkeypatch.setattr("tessera.session.SORTED", 100_000, raising=False)
    assert ex.execute("UPDATE t SET name = 'b'") == [{"rows_updated": 4000}]
    assert max(rows_by_file(db, "t")) <= 1200
    assert ex.execute(f"UPDATE t SET name = '{'c' * 400}'") == [{"rows_updated": 4000}]
    assert max(rows_by_file(db, "t")) <= 300
    assert ex.execute("UPDATE t SET name = 'd' WHERE id <= 100") == [{"rows_updated": 100}]
    assert ex.execute("SELECT COUNT(*), MIN(id), MAX(id) FROM t") == [{"COUNT(*)": 4000, "MIN(id)": 1, "MAX(id)": 4000}]
    assert {r["name"] for r in ex.execute("SELECT name FROM t WHERE id <= 100")} == {"d"}
    assert len(ex.query("SELECT name FROM t WHERE id = 4000").inputFiles()) == 1


def test_vacuum_merges_up_to_what_a_task_sorts(db, ex, spark, monkeypatch):
    """Small files become as many as their rows in memory need, and stay from then on; a file with many rows isn't sorted again."""
    ex.execute("CREATE TABLE t (id INT64, name VARCHAR)")
    db.append("t", spark.range(4000).selectExpr("id", "'a'").coalesce(1))
    large = db.log.head().tables["t"].files
    db.append("t", spark.range(4000, 8000).selectExpr("id", "CASE WHEN id % 2 = 0 THEN 'a' END").repartition(16, "id"))
    monkeypatch.setattr("tessera.session.SORTED", 100_000, raising=False)
    ex.execute("VACUUM t")
    files = db.log.head().tables["t"].files
    assert large[0] in files and sorted(rows_by_file(db, "t"))[-2] <= 1200 and 5 <= len(files) <= 8
    ex.execute("VACUUM t")
    assert len([f for f in db.log.head().tables["t"].files if f in files]) >= len(files) - 2
    ids = [r["id"] for r in ex.execute("SELECT id FROM t WHERE id < 4000")]
    assert ids == list(range(4000))
    assert ex.execute("UPDATE t SET name = 'b'") == [{"rows_updated": 8000}]
    assert ex.execute("SELECT COUNT(name), MIN(id), MAX(id) FROM t") == [{"COUNT(name)": 8000, "MIN(id)": 0, "MAX(id)": 7999}]


def test_delete_and_backup_of_indexed_rows_are_dealt(db, ex, spark, tmp_path, monkeypatch):
    """A DELETE that leaves rows in all files, and a backup, sort no more than a task may."""
    ex.execute("CREATE TABLE t (id INT64, k INT32)")
    ex.execute("CREATE INDEX t_k ON t (k)")
    db.append("t", spark.range(8000).selectExpr("id", "1").repartition(4, "id"))
    monkeypatch.setattr("tessera.session.SORTED", 100_000, raising=False)
    ex.execute(f"BACKUP TO '{tmp_path}/copy'")
    copy = Database.open(f"{tmp_path}/copy", spark)
    assert max(rows_by_file(copy, "t")) <= 1300 and sum(rows_by_file(copy, "t")) == 8000
    assert ex.execute("DELETE FROM t WHERE id < 100") == [{"rows_deleted": 100}]
    assert max(rows_by_file(db, "t")) <= 1300
    assert sorted(r["id"] for r in ex.execute("SELECT id FROM t")) == list(range(100, 8000))
    assert sorted(r["id"] for r in Executor(copy).execute("SELECT id FROM t WHERE k = 1")) == list(range(8000))
