from decimal import Decimal as D

import pytest

from tidemark.database import Database
from tidemark.errors import ComplianceError, CorruptionError, ReadOnlyError, SchemaError, SignatureMismatchError, TableNotFoundError, TidemarkError, UnsupportedVersionError, WasmError
from tidemark.plans import ast

ROWS = [(1, "alice", "paris", 30, D("10.50")), (2, "bob", "berlin", 25, D("20.50")), (3, "carol", "paris", 40, D("30.00")), (4, "dave", "cairo", None, D("5.00")), (5, "alice", "berlin", 25, D("15.00"))]


def make(spark, columns, rows):
    db = Database.memory(spark)
    db.create_table("t", columns)
    for r in rows:
        db.insert("t", r)
    return db


@pytest.fixture(scope="module")
def db(spark):
    return make(spark, ["id", "name", "city", "age", "score"], ROWS)


@pytest.mark.parametrize(("rest", "ids"), [
    ("WHERE age NOT IN (25)", [1, 3]), ("WHERE age NOT BETWEEN 25 AND 30", [3]), ("WHERE city NOT IN ('zzz', NULL)", []), ("WHERE city IN ('paris', NULL)", [1, 3]),
    ("ORDER BY city ASC, id DESC", [5, 2, 4, 3, 1]), ("WHERE score > 16", [2, 3]), ("WHERE score = 30", [3]), ("WHERE score BETWEEN 10 AND 20", [1, 5]), ("WHERE score IN (30,5)", [3, 4]),
    ("WHERE age > 24.5", [1, 2, 3, 5]), ("WHERE age < 30.5 AND age >= 29.5", [1]), ("WHERE age = NULL", [4]), ("WHERE age != 25", [1, 3, 4]), ("WHERE age <> NULL", [1, 2, 3, 5]),
    ("WHERE age < NULL", []), ("WHERE age BETWEEN NULL AND 30", [1, 2, 5]), ("WHERE age NOT BETWEEN 1 AND NULL", [1, 2, 3, 5]), ("WHERE name LIKE 'a%'", [1, 5]), ("WHERE name NOT LIKE '%o%'", [1, 4, 5]),
    ("WHERE id LIKE '1%'", []), ("WHERE id NOT LIKE '1%'", []), ("WHERE age > 'x'", []), ("WHERE name > 5", [1, 2, 3, 4, 5]), ("WHERE age IS NULL", [4]), ("WHERE age IS NOT NULL AND id < 3", [1, 2]),
    ("BEFORE 2", [1, 2]), ("BEFORE 0", []), ("BEFORE 99", [1, 2, 3, 4, 5]), ("LIMIT 2", [1, 2]), ("LIMIT 0", []), ("ORDER BY age DESC, id LIMIT 5", [3, 1, 2, 5, 4]), ("WHERE age > 9999999999999999999.5", []), ("WHERE age IN ('x')", []), ("WHERE age NOT IN ('x')", [1, 2, 3, 5]),
])
def test_where_order_limit(db, rest, ids):
    assert [r[0] for r in db.query(f"SELECT id FROM t {rest}").rows()] == ids


@pytest.mark.parametrize(("sql", "rows"), [
    ("SELECT city FROM t GROUP BY city HAVING COUNT(*) > 1", [("berlin",), ("paris",)]), ("SELECT city FROM t GROUP BY city HAVING SUM(age) > 60", [("paris",)]), ("SELECT city FROM t GROUP BY city HAVING AVG(score) > 16", [("berlin",), ("paris",)]),
    ("SELECT city FROM t GROUP BY city HAVING SUM(age) != 5", [("berlin",), ("cairo",), ("paris",)]), ("SELECT AVG(score), SUM(score), AVG(age), SUM(age) FROM t", [(D("16.2"), D(81), D(30), 120)]),
    ("SELECT COUNT(*), COUNT(age) FROM t", [(5, 4)]), ("SELECT age, COUNT(*) AS n FROM t GROUP BY age", [(None, 1), (25, 2), (30, 1), (40, 1)]), ("SELECT city, COUNT(*) FROM t GROUP BY city ORDER BY count DESC LIMIT 1", [("berlin", 2)]),
    ("SELECT DISTINCT city FROM t", [("paris",), ("berlin",), ("cairo",)]), ("SELECT DISTINCT city FROM t ORDER BY score DESC LIMIT 2", [("paris",), ("berlin",)]), ("SELECT DISTINCT name FROM t ORDER BY city DESC, id", [("alice",), ("carol",), ("dave",), ("bob",)]),
    ("SELECT name AS city FROM t ORDER BY city, id", [("bob",), ("alice",), ("dave",), ("alice",), ("carol",)]), ("SELECT id, id FROM t WHERE id = 1", [(1, 1)]), ("SELECT COUNT(*) FROM t WHERE id > 9 HAVING COUNT(*) = 0", [(0,)]), ("SELECT SUM(age), MIN(name), AVG(age) FROM t WHERE id > 9", [(None, None, None)]),
])
def test_grouping_and_distinct(db, sql, rows):
    assert db.query(sql).rows() == rows


def test_labels(db):
    assert db.query("SELECT city, COUNT(*), COUNT(age), SUM(age) AS s, MIN(age) FROM t GROUP BY city").columns == ["city", "count", "count(age)", "s", "min(age)"]


@pytest.mark.parametrize("sql", [
    "SELECT * FROM t GROUP BY city", "SELECT * FROM t HAVING COUNT(*) > 1", "SELECT name, COUNT(*) FROM t", "SELECT city FROM t GROUP BY city HAVING nope = 1", "SELECT city AS c FROM t GROUP BY city HAVING city = 'x'",
    "SELECT city AS c FROM t GROUP BY city ORDER BY city", "SELECT id FROM t ORDER BY nope", "SELECT id FROM t WHERE nope = 1", "SELECT nope FROM t", "SELECT SUM(name) FROM t", "SELECT ID FROM t",
])
def test_errors(db, sql):
    with pytest.raises(SchemaError):
        db.query(sql).rows()


def test_unknown_table(db):
    with pytest.raises(TableNotFoundError):
        db.query("SELECT a FROM T")


@pytest.mark.parametrize(("values", "mean"), [([2**63 - 1], "9223372036854775807"), ([5] + [0] * 7, "0.625"), ([1] + [0] * 127, "0.007813"), ([-1] + [0] * 127, "-0.007813"), ([-1, -2], "-1.5"), ([D("0.000001")] * 50 + [0] * 51, "0")])
def test_exact_average(spark, values, mean):
    assert make(spark, ["v"], [(v,) for v in values]).query("SELECT AVG(v) FROM t").rows() == [(D(mean),)]


def test_sum_accumulates_wide(spark):
    db = make(spark, ["v"], [(2**63 - 1,), (1,), (-1,)])
    assert db.query("SELECT SUM(v) FROM t").rows() == [(2**63 - 1,)]
    with pytest.raises(SchemaError):
        db.query("SELECT SUM(v) FROM t WHERE v > 0").rows()


def test_sum_of_kinds(spark):
    db = make(spark, ["g", "v"], [(1, None), (1, None), (2, "x"), (3, 1), (3, D("1.5")), (4, 7)])
    assert db.query("SELECT SUM(v) FROM t WHERE g = 1").rows() == [(None,)]
    assert db.query("SELECT g, SUM(v) FROM t WHERE g != 2 GROUP BY g").rows() == [(1, None), (3, D("2.5")), (4, 7)]
    with pytest.raises(SchemaError):
        db.query("SELECT SUM(v) FROM t").rows()


def test_kinds_in_one_column(spark):
    db = make(spark, ["i", "v"], [(1, D("2.0")), (2, 2), (3, None), (4, "a"), (5, b"\x01"), (6, 1), (7, D("1.5"))])
    ids = lambda rest: [r[0] for r in db.query(f"SELECT i FROM t {rest}").rows()]
    assert ids("ORDER BY v, i") == [3, 6, 2, 7, 1, 4, 5] and ids("ORDER BY v DESC, i") == [5, 4, 1, 7, 2, 6, 3]
    assert ids("WHERE v = 2") == [1, 2] and ids("WHERE v > 1.5") == [1, 2, 4, 5] and ids("WHERE v < 'a'") == [1, 2, 6, 7] and ids("WHERE v != 2") == [3, 4, 5, 6, 7]
    assert ids("WHERE v NOT IN (2, 'a')") == [5, 6, 7] and ids("WHERE v NOT BETWEEN 1 AND 2") == [4, 5]
    assert db.query("SELECT v, COUNT(*) FROM t GROUP BY v").rows() == [(None, 1), (1, 1), (2, 1), (D("1.5"), 1), (D(2), 1), ("a", 1), (b"\x01", 1)]
    assert db.query("SELECT MIN(v), MAX(v) FROM t").rows() == [(1, b"\x01")]
    assert db.query("SELECT MAX(v) FROM t WHERE v <= 2").rows() == [(D("2.000000"),)]  # of equal magnitudes the first


def test_transactions(spark):
    db = make(spark, ["id", "tier"], [(i, "a") for i in range(1, 6)])
    assert db.query("UPDATE t SET tier = 'b' WHERE id > 3").mutated == 2 and db.clock == 8
    assert [r[0] for r in db.query("SELECT id FROM t BEFORE 6").rows()] == [1, 2, 3]
    assert [r[0] for r in db.query("SELECT id FROM t BEFORE 7").rows()] == [1, 2, 3, 4]
    assert db.query("DELETE FROM t WHERE id = 1 OR id = 2").mutated == 2 and db.clock == 9
    assert db.query("DELETE FROM t WHERE id = 77").mutated == 0 and db.clock == 10
    assert db.query("UPDATE t SET tier = 1 WHERE id = 77").mutated == 0 and db.clock == 10
    with pytest.raises(TableNotFoundError):
        db.query("DELETE FROM nope WHERE a = 1")
    assert db.clock == 11
    with pytest.raises(SchemaError):
        db.query("INSERT INTO t VALUES (1)")
    assert db.clock == 11 and [r[0] for r in db.query("SELECT id FROM t").rows()] == [3, 4, 5]
    for t in range(12):
        assert db.query(f"SELECT COUNT(*) FROM t BEFORE {t}").rows() == [(db.row_count("t", t),)]


def test_bulk_paths_agree(spark, monkeypatch):
    import tidemark.database as m

    out = []
    for most in (50_000, 3):
        monkeypatch.setattr(m, "MEMTABLE", most)
        db = make(spark, ["id", "v"], [(i, i % 3) for i in range(20)])
        db.query("UPDATE t SET v = 'x' WHERE v != 1")
        db.query("DELETE FROM t WHERE id >= 10")
        out.append((db.clock, db.select("t"), [db.select("t", b) for b in (19, 21, 25, 34)]))
    assert out[0] == out[1]


def test_workspace_and_artifact(spark, tmp_path):
    db = Database.dev(spark, f"file://{tmp_path}/w")
    db.query("CREATE TABLE t (id, s)")
    db.set_durability("sync")
    db.query("INSERT INTO t VALUES (1, 'a')")
    db.set_autocommit(False)
    db.insert_many("t", [(2, D("1.5")), (3, None)])
    mark = db.clock
    db.query("UPDATE t SET s = 'z' WHERE id = 1")
    db.create_index("t", "id")
    db.close()
    again = Database.dev(spark, f"file://{tmp_path}/w")
    assert again.select("t") == [(2, D("1.5")), (3, None), (1, "z")] and again.clock == db.clock and again.select("t", mark) == [(1, "a"), (2, D("1.5")), (3, None)]
    again.compact("t")
    assert again.select_ordered_by_index("t", "id", True, limit=2) == [(3, None), (2, D("1.5"))]
    again.bake(f"file://{tmp_path}/a.tmrk")
    prod = Database.prod(spark, f"file://{tmp_path}/a.tmrk")
    assert prod.select("t", mark) == [(1, "a"), (2, D("1.5")), (3, None)] and not prod.is_writable()
    for sql in ("INSERT INTO t VALUES (1, 2)", "DELETE FROM t WHERE id = 1", "CREATE TABLE u (a)", "DROP TABLE t"):
        with pytest.raises(ReadOnlyError):
            prod.query(sql)
    data = again.bake_to_bytes()
    copy = Database.from_bytes(spark, data)
    copy.query("DELETE FROM t WHERE id = 2")
    assert copy.select("t") == [(3, None), (1, "z")]
    from tidemark.streaming.ranges import BytesReader

    reader = BytesReader(data)
    streamed = Database.streamed(spark, reader, len(data))
    assert len(reader.reads) == 2 and streamed.select("t") == prod.select("t") and len(reader.reads) > 2


def test_indexes(spark, tmp_path):
    """Several indexes on a table: lookups read by id, whatever was written since; a cache that keeps what is read twice."""
    db = Database.dev(spark, f"file://{tmp_path}/w")
    db.query("CREATE TABLE t (k, v, w)")
    db.insert_frame("t", spark.range(5000).selectExpr("id AS k", "concat('v', id % 100) AS v", "id % 7 AS w"))
    db.create_index("t", "k")
    db.create_index("t", "v")
    db.query("INSERT INTO t VALUES (77, 'late', 1)")
    mark = db.clock
    db.query("DELETE FROM t WHERE k = 4999")
    for sql, want in (("k = 77", [(77, "v77"), (77, "late")]), ("v = 'late'", [(77, "late")]), ("k >= 4998", [(4998, "v98")]), ("k BETWEEN 10 AND 12 AND w > 3", [(11, "v11"), (12, "v12")]), ("k IN (1, 2, 9999)", [(1, "v1"), (2, "v2")]), ("k = NULL", []), ("k = 4999", [])):
        assert db.query(f"SELECT k, v FROM t WHERE {sql}").rows() == want
        table, where = db.table("t"), db.query  # noqa: F841
    assert db.query(f"SELECT k FROM t WHERE k = 4999 BEFORE {mark}").rows() == [(4999,)]
    plan = db.query("SELECT v FROM t WHERE k = 77").df._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "_row_id" in plan.split("PushedFilters", 1)[1].split("\n")[0]
    index = db.index("t", "v")
    assert len(index) == 5000 and index.distinct_keys() == 100 and index.lookup("v5").count() == 50 and index.range("v97", "v98").count() == 100
    assert [r[0] for r in index.ordered_addresses(True).limit(2).collect()] == [100, 200] and index.pairs().first()["value"] == "v0"
    db.close()
    again = Database.dev(spark, f"file://{tmp_path}/w")
    assert again.query("SELECT w FROM t WHERE k = 8").rows() == [(1,)] and len(again.index("t", "k")) == 5000
    with pytest.raises(SchemaError):
        again.index("t", "w")


def test_cache(spark, tmp_path):
    db = Database.dev(spark, f"file://{tmp_path}/w")
    for t in "ab":
        db.query(f"CREATE TABLE {t} (k)")
        db.insert_frame(t, spark.range(20_000).selectExpr("id AS k"))
    assert db.cache_resident() == 0 and db.row_count("a") == 20_000 and db.cache_resident() == 0
    assert db.row_count("a") == 20_000 and 0 < (kept := db.cache_resident()) <= db.cache_capacity
    db.query("INSERT INTO a VALUES (5)")
    assert db.row_count("a") == 20_001  # another set of segments: what was kept goes
    db.set_cache_capacity(kept)
    for _ in range(2):
        db.row_count("b")
    assert db.cache_resident() <= kept and list(db._cached) == ["b"]
    db.set_cache_capacity(0)
    assert db.cache_resident() == 0 and db.row_count("b") == 20_000 and db.row_count("b") == 20_000 and db.cache_resident() == 0


def test_streamed_columns_and_row_groups(spark, tmp_path):
    """A streamed query reads chunks of its columns, and no row group that its condition rules out."""
    from tidemark.streaming.ranges import BytesReader

    db = Database.dev(spark, f"file://{tmp_path}/w")
    db.query("CREATE TABLE t (k, v)")
    spark.conf.set("parquet.block.size", 1 << 16)
    try:
        spark.sparkContext._jsc.hadoopConfiguration().set("parquet.block.size", str(1 << 18))
        db.insert_frame("t", spark.range(60_000).selectExpr("id AS k", "repeat(md5(cast(id AS string)), 4) AS v"))
    finally:
        spark.conf.unset("parquet.block.size")
        spark.sparkContext._jsc.hadoopConfiguration().unset("parquet.block.size")
    db.query("DELETE FROM t WHERE k = 3")
    data = db.bake_to_bytes()
    read = lambda r: sum(n for _, n in r.reads)
    one, all_ = BytesReader(data), BytesReader(data)
    streamed = Database.streamed(spark, one, len(data))
    assert streamed.query("SELECT COUNT(k) AS n, MAX(k) AS m FROM t").rows() == [(59_999, 59_999)]
    assert len(Database.streamed(spark, all_, len(data)).select("t")) == 59_999 and read(one) < read(all_) / 3
    few = BytesReader(data)
    streamed = Database.streamed(spark, few, len(data))
    assert streamed.query("SELECT k FROM t WHERE k BETWEEN 30 AND 32").rows() == [(30,), (31,), (32,)]
    assert streamed.groups_skipped > 0 and streamed.groups_read < streamed.groups_skipped
    seen = len(few.reads)
    assert streamed.query("SELECT k FROM t WHERE k BETWEEN 30 AND 32").rows() == [(30,), (31,), (32,)]
    assert read(few) < len(data) and len(few.reads) >= seen


def test_rows_are_ordered_where_they_are_read(spark):
    db = make(spark, ["a"], [(3,), (1,), (2,)])
    result = db.query("SELECT a FROM t")
    assert result.rows() == [(3,), (1,), (2,)] and "Sort" not in result.df._jdf.queryExecution().toString()


def test_transpose(spark):
    from tidemark.functions.codecs import delta_z, transpose, undelta_z, untranspose

    rows = [(i, None if i % 5 == 0 else i * i - 9, f"s{i % 3}", f"x{i}é", bytes([i % 256]) * (i % 4)) for i in range(700)]
    df = spark.createDataFrame(rows, "a long, b int, c string, d string, e binary")
    blocks = transpose(df, "a", 64)
    codecs = {(r["name"], r["codec"]) for r in blocks.collect()}
    assert {("a", "delta_z"), ("b", "raw"), ("c", "dictionary"), ("d", "dictionary"), ("e", "raw")} == codecs
    assert sorted((*r[:4], bytes(r[4])) for r in untranspose(blocks, "a long, b int, c string, d string, e binary").collect()) == rows
    with pytest.raises(ValueError):
        transpose(spark.createDataFrame([(D(1),)], "a decimal(38,6)"), "a")
    back = undelta_z(delta_z(df.select("a"), "a", "a"), "a")
    assert sorted(r["value"] for r in back.collect()) == list(range(700))


def test_corruption(spark):
    data = make(spark, ["a"], [(1,)]).bake_to_bytes()
    with pytest.raises(SignatureMismatchError):
        Database.from_bytes(spark, b"XXXX" + data[4:])
    with pytest.raises(UnsupportedVersionError):
        Database.from_bytes(spark, data[:4] + b"\x09" + data[5:])
    for bad in (data[:100], data[:40] + bytes([data[40] ^ 1]) + data[41:], data[:-1], data + b"x"):
        with pytest.raises(CorruptionError):
            Database.from_bytes(spark, bad)


def test_api_forms(db):
    assert db.select_where("t", "city", "paris")[0][0] == 1 and len(db.select_filtered("t", ast.InList("id", (1, 2)))) == 2
    assert db.table_names() == ["t"] and db.column_names("t") == ["id", "name", "city", "age", "score"] and db.current_tx() == 5
    seen = []

    def visit(row):
        seen.append(row[0])
        if row[0] == 3:
            raise KeyError("stop")

    with pytest.raises(KeyError):
        db.for_each_row("t", visit)
    assert seen == [1, 2, 3] and db.for_each_row("t", lambda r: None, before=2) == 2


def test_dump(spark):
    db = Database.memory(spark)
    r = db.import_sql("""PRAGMA foreign_keys=OFF; BEGIN; CREATE TABLE IF NOT EXISTS "users" ("id" INTEGER PRIMARY KEY, name TEXT DEFAULT 'a,b', score REAL, UNIQUE(name));
INSERT INTO "users" VALUES (1, 'it''s; ok', 1.5); INSERT INTO users VALUES (2, NULL, 2.25);
CREATE INDEX i ON users (name); CREATE TRIGGER g AFTER INSERT ON users BEGIN SELECT 1; END; -- done
COMMIT; INSERT INTO nope VALUES (1);""")
    assert r.executed == 3 and len(r.skipped) >= 4 and len(r.errors) == 1  # the chunk that begins with a comment is dropped, COMMIT included
    assert db.select("users") == [(1, "it's; ok", D("1.5")), (2, None, D("2.25"))]


def test_dump_names_and_lists(spark):
    db = Database.memory(spark)
    r = db.import_sql("""CREATE TABLE [a b] ("x""y" INT, `k` TEXT CHECK (k IN ('a,(', 'b')), PRIMARY KEY (k), unique_id INT);
/* kept */; CREATE TABLE none; CREATE TABLE open (a, b; ALTER TABLE t ADD c; END; pragma x; INSERT INTO b VALUES (1, ';--');""")
    assert [s.split(":")[0] for s in r.skipped] == ["no columns found", "no columns found", "tables keep their columns", "the end of a trigger", "a setting of the other database"]
    assert r.executed == 2 and len(r.errors) == 1 and db.table_names() == ["b"] and db.column_names("b") == ["x", "k"]
    assert all(len(s.split(": ", 1)[1]) <= 60 for s in r.skipped)


def test_json_and_drop(spark):
    db = make(spark, ["a", "b"], [(1, D("1.5")), (None, "é")])
    assert db.query("SELECT * FROM t").to_json() == '{"columns": ["a", "b"], "rows": [[1, "1.500000"], [null, "é"]]}'
    assert db.query("DROP TABLE t").to_json() == '{"done": true}'
    with pytest.raises(TableNotFoundError):
        db.query("DROP TABLE t")


def test_dbapi(spark):
    from tidemark import dbapi

    with dbapi.connect("memory", spark) as c:
        c.execute("CREATE TABLE t (a, b)")
        cur = c.cursor().executemany("INSERT INTO t VALUES (?, ?)", [(1, "x"), (2, 2.5), (3, None)])
        assert cur.rowcount == 3
        cur.execute("SELECT a, b FROM t WHERE a > ?", [1])
        assert [d[0] for d in cur.description] == ["a", "b"] and cur.fetchone() == (2, D("2.5")) and cur.fetchall() == [(3, None)]
        p = c.prepare("SELECT a FROM t WHERE a <= ? ORDER BY a")
        assert p.get(2) == {"a": 1} and p.all(2) == [{"a": 1}, {"a": 2}] and p.get(0) is None
        assert c.prepare("DELETE FROM t WHERE a = ?").run(1) == {"changes": 1}
    with pytest.raises(dbapi.InterfaceError):
        c.cursor()


def test_server_and_prompt(spark):
    import json
    import threading
    import urllib.error
    import urllib.request

    from tidemark.__main__ import answer
    from tidemark.server import make_server

    db = make(spark, ["a"], [(1,)])
    server = make_server(db, port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}"

    def post(body, path="/v1/query"):
        try:
            with urllib.request.urlopen(urllib.request.Request(url + path, data=body if isinstance(body, bytes) else json.dumps(body).encode())) as r:
                return r.status, json.loads(r.read())
        except urllib.error.HTTPError as e:
            return e.code, json.loads(e.read())

    assert post({"sql": "SELECT a FROM t WHERE a = ?", "params": [1]}) == (200, {"columns": ["a"], "rows": [[1]]})
    assert post({"sql": "SELEC"})[0] == 400 and post(b"{")[0] == 400 and post({}, "/x")[0] == 404
    assert json.loads(urllib.request.urlopen(url + "/v1/tx").read()) == {"tx": 1}
    server.shutdown()
    assert answer(db, ".tables") == "t" and answer(db, ".exit") is None and "(1 rows)" in answer(db, "SELECT a FROM t") and answer(db, "x").startswith("error")


def test_server_cancels_what_is_late(spark):
    from tidemark.server import Engine

    engine = Engine(make(spark, ["a"], [(1,)]))
    assert engine.ask(lambda d: d.spark.range(10**13).selectExpr("sum(id % 7 * (id % 11))").collect(), timeout=3)[0] == 504
    assert engine.ask(lambda d: str(d.row_count("t")), timeout=20) == (200, "1")


def test_bytes_functions_and_policy(spark):
    from tidemark.functions.wasm import INC_BYTES, SUM_BYTES, Instance, assemble

    db = Database.memory(spark)
    assert db.run_wasm_scalar(SUM_BYTES, "sum", bytes([1, 2, 3, 4, 10])) == 20 and db.run_wasm_apply(INC_BYTES, "inc", bytes([0, 9, 254])) == bytes([1, 10, 255])
    for bad in (b"", SUM_BYTES[:30], assemble("sum", 0, b"\x00"), assemble("sum", 0, b"\x20\x00\x41\x00\x6d")):
        with pytest.raises(WasmError):
            Instance(bad).scalar("sum", b"ab")
    with pytest.raises(WasmError):  # without fuel this loop would have no end
        Instance(assemble("sum", 0, b"\x03\x40\x0c\x00\x0b\x41\x00"), fuel=10_000).scalar("sum", b"ab")
    assert Instance(SUM_BYTES, fuel=10_000).scalar("sum", b"ab") == 195

    class Double:
        def __init__(self, module):
            pass

        def scalar(self, name, data):
            return 2 * len(data)

    assert db.run_wasm_scalar(b"", "x", b"abc", backend=Double) == 6
    with pytest.raises(WasmError):
        Instance(SUM_BYTES).scalar("nope", b"")
    db.assert_compliance(50_000, 10_000.0)
    db.assert_compliance(60_000, 0, True)
    with pytest.raises(ComplianceError):
        db.assert_compliance(0, 10_000.01)


def test_pushdown(spark):
    db = Database.memory(spark)
    db.register("p", "/root/testdata/sf0.001/part.parquet")
    plan = db.query("SELECT p_name FROM p WHERE p_partkey > 5 AND p_brand IN ('a', 'b') AND p_name LIKE 'x%'").df._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "GreaterThan(p_partkey,5)" in plan and "In(p_brand, [a,b])" in plan and "StringStartsWith(p_name,x)" in plan and "p_retailprice" not in plan.split("ReadSchema", 1)[1].split("\n")[0]


def test_unknown_value(spark):
    db = make(spark, ["a"], [])
    for bad in (1.5, 2**63, D("1e33"), object()):
        with pytest.raises(TidemarkError):
            db.insert("t", (bad,))
