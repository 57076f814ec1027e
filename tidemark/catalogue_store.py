"""Driver queries over databases of their own: stores, catalog, transactions, indexes, publishing, interfaces.

What an API returns on the driver (a list of rows, a report, an error) is made a small
DataFrame of it; tables are written by Spark jobs.
"""

from __future__ import annotations

import json
import threading
import urllib.request
from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import dbapi
from tidemark.database import Database
from tidemark.errors import TidemarkError
from tidemark.functions import codecs
from tidemark.plans import ast
from tidemark.server import make_server
from tidemark.sources.files import scratch
from tidemark.streaming.ranges import BytesReader

STORE: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}
_NATION = "SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name, CAST(n_regionkey AS BIGINT) AS region FROM nation"
_ORDERS = "SELECT o_orderkey AS k, o_custkey AS c, o_orderpriority AS p FROM orders"


def _store(sql: str):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        STORE[f.__name__] = (f, sql)
        return f

    return register


def _nations(spark: SparkSession, sf_dir: str, db: Database | None = None) -> Database:
    db = db or Database.memory(spark)
    db.query("CREATE TABLE n (id, name, region)")
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_name", "n_regionkey").coalesce(1).sortWithinPartitions("n_nationkey")
    db.insert_frame("n", rows)
    return db


def _orders(spark: SparkSession, sf_dir: str, db: Database | None = None) -> Database:
    db = db or Database.memory(spark)
    db.query("CREATE TABLE o (k, c, p)")
    db.insert_frame("o", spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderpriority").repartitionByRange(4, "o_orderkey").sortWithinPartitions("o_orderkey"))
    return db


# -- transactions and the catalog
@_store("SELECT (SELECT count(*) FROM nation) + n AS tx, n FROM (SELECT unnest([1, 2, 3]) AS n)")
def delete_none_tx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A DELETE takes a transaction if nothing matches, and if there is no such table; an UPDATE takes none."""
    db = _nations(spark, sf_dir)
    seen = []
    db.query("DELETE FROM n WHERE id = 1000")
    seen.append((db.current_tx(), 1))
    db.query("UPDATE n SET name = 'x' WHERE id = 1000")
    try:
        db.query("DELETE FROM nowhere WHERE id = 1")
    except TidemarkError:
        seen.append((db.current_tx(), 2))
    db.query("DELETE FROM n WHERE id = 1001")
    return spark.createDataFrame([*seen, (db.current_tx(), 3)], "tx long, n long")


@_store(f"SELECT * FROM ({_NATION}) WHERE region != 2")
def update_mid_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Between the deletion and the new versions of an UPDATE its rows are gone."""
    db = _nations(spark, sf_dir)
    at = db.current_tx() + 1
    db.query("UPDATE n SET name = 'x' WHERE region = 2")
    return db.query(f"SELECT * FROM n BEFORE {at}").df


@_store(f"SELECT row_number() OVER (ORDER BY region = 2, id) - 1 AS place, id FROM ({_NATION})")
def updated_rows_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = _nations(spark, sf_dir)
    db.query("UPDATE n SET name = 'x' WHERE region = 2")
    return spark.createDataFrame([(i, r[0]) for i, r in enumerate(db.query("SELECT id FROM n").rows())], "place long, id long")


@_store("SELECT CAST(r_regionkey AS BIGINT) AS a, r_name AS b, (SELECT 2 * count(*) FROM region) AS tx FROM region")
def drop_recreate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dropped table takes its history along; CREATE and DROP take no transaction."""
    db = Database.memory(spark)
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/region.parquet").select("r_regionkey", "r_name").collect()]  # five rows
    db.query("CREATE TABLE t (x)")
    db.insert_many("t", [(r[0],) for r in rows])
    db.query("DROP TABLE t")
    db.query("CREATE TABLE t (a, b)")
    db.insert_many("t", rows)
    return db.query("SELECT a, b FROM t").df.withColumn("tx", F.lit(db.current_tx()).cast("long"))


@_store(f"SELECT id, name FROM ({_NATION}) WHERE region != 1 AND id != 5 UNION ALL SELECT id, 'moved' FROM ({_NATION}) WHERE id = 5")
def api_equality_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = _nations(spark, sf_dir)
    db.delete("n", "region", 1)
    db.update("n", "region", 77, "id", 5)
    db.update("n", "name", "moved", "region", 77)
    found = [r for c in (0, 1, 2, 3, 4, 77) for r in db.select_where("n", "region", c)]
    return spark.createDataFrame([(r[0], r[1]) for r in found], "id long, name string")


@_store(f"SELECT id FROM ({_NATION}) WHERE region = 2 OR name LIKE 'A%'")
def api_predicate_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = _nations(spark, sf_dir)
    mark = db.current_tx()
    db.delete_where("n", ast.Between("id", 0, 30))
    return spark.createDataFrame([(r[0],) for r in db.select_filtered("n", ast.Or(ast.Compare("region", "=", 2), ast.Compare("name", "like", "A%")), mark)], "id long")


@_store("SELECT * FROM (VALUES ('n', 'id', true), ('n', 'name', true), ('n', 'region', true), ('z', 'only', true)) t(t, c, w)")
def introspection(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = _nations(spark, sf_dir)
    db.query("CREATE TABLE z (only)")
    return spark.createDataFrame([(t, c, db.is_writable()) for t in db.table_names() for c in db.column_names(t)], "t string, c string, w boolean")


@_store("SELECT * FROM (VALUES ('INSERT', 'ReadOnlyError'), ('UPDATE', 'ReadOnlyError'), ('DELETE', 'ReadOnlyError'), ('CREATE', 'ReadOnlyError'), ('DROP', 'ReadOnlyError')) t(statement, error)")
def read_only_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{scratch(spark, 'bake')}/n.tmrk"
    _nations(spark, sf_dir).bake(path)
    db, seen = Database.prod(spark, path), []
    for sql in ("INSERT INTO n VALUES (1, 2, 3)", "UPDATE n SET id = 1 WHERE id = 2", "DELETE FROM n WHERE id = 1", "CREATE TABLE m (a)", "DROP TABLE n"):
        try:
            db.query(sql)
        except TidemarkError as e:
            seen.append((sql.split()[0], type(e).__name__))
    return spark.createDataFrame(seen, "statement string, error string")


# -- order, labels and errors
_MIXED = "SELECT n_nationkey AS id, CASE n_nationkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 3 END AS kind FROM nation"


@_store(f"SELECT CAST(id AS BIGINT) AS id, row_number() OVER (ORDER BY kind DESC, CASE WHEN kind = 3 THEN n_name END DESC, id DESC) - 1 AS place FROM ({_MIXED}) JOIN nation ON id = n_nationkey")
def mixed_kind_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nulls, integers, decimals, texts, in this order, whatever their values."""
    db = Database.memory(spark)
    db.query("CREATE TABLE m (id, x)")
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_name").orderBy(F.col("n_nationkey").desc()).collect()  # 25 rows
    db.insert_many("m", [(k, (None, 1000 + k, Decimal(k) / 2, name)[k % 4]) for k, name in ((int(r[0]), r[1]) for r in rows)])
    return spark.createDataFrame([(r[0], i) for i, r in enumerate(db.query("SELECT id FROM m ORDER BY x DESC").rows())], "id long, place long")


@_store('SELECT o_orderpriority, count(*) AS "count" FROM orders GROUP BY ALL ORDER BY 2 DESC, 1 LIMIT 3')
def grouped_order_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups are sorted by names of outputs; an aggregate without an alias is named by its function."""
    db = Database.memory(spark)
    db.register("orders", f"{sf_dir}/orders.parquet")
    return db.query("SELECT o_orderpriority, COUNT(*) FROM orders GROUP BY o_orderpriority ORDER BY count DESC, o_orderpriority LIMIT 3").df


@_store('SELECT count(*) AS "count", CAST(min(o_custkey) AS BIGINT) AS "min(o_custkey)", max(o_orderpriority) AS "max(o_orderpriority)" FROM orders')
def default_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = Database.memory(spark)
    db.register("orders", f"{sf_dir}/orders.parquet")
    return db.query("SELECT COUNT(*), MIN(o_custkey), MAX(o_orderpriority) FROM orders").df


_WRONG = [
    "SELECT nope FROM n", "SELECT id FROM n WHERE nope = 1", "SELECT id FROM n ORDER BY nope", "SELECT id, COUNT(*) FROM n", "SELECT * FROM n GROUP BY id", "SELECT name FROM n GROUP BY id", "SELECT id AS x, COUNT(*) FROM n GROUP BY id ORDER BY id",
    "SELECT id FROM nowhere", "SELEC id FROM n", "SELECT id FROM n WHERE", "SELECT id FROM n WHERE name = 'open", "SELECT id\nFROM n\nWHERE id ! 3", "SELECT id FROM n LIMIT -1", "INSERT INTO n VALUES (1)", "UPDATE n SET nope = 1 WHERE id = 1", "DELETE FROM n",
    "CREATE TABLE n (a)", "CREATE TABLE e ()", "DROP TABLE nowhere", "SELECT id FROM n WHERE id = ?",
]


@_store("SELECT * FROM (VALUES " + ", ".join(f"({i}, '{e}')" for i, e in enumerate(["SchemaError"] * 7 + ["TableNotFoundError"] + ["QueryError"] * 5 + ["SchemaError"] * 2 + ["QueryError"] + ["SchemaError", "QueryError", "TableNotFoundError", "QueryError"])) + ") t(i, error)")
def errors_told(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The error of each wrong statement: unknown names, groups that don't hold, syntax, tables."""
    db, seen = _nations(spark, sf_dir), []
    for i, sql in enumerate(_WRONG):
        try:
            db.query(sql).rows()
        except TidemarkError as e:
            seen.append((i, type(e).__name__))
    return spark.createDataFrame(seen, "i int, error string")


@_store("SELECT * FROM (VALUES (1, 1), (1, 23), (3, 10)) t(line, place)")
def error_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line and column that a syntax error points at."""
    db, seen = _nations(spark, sf_dir), []
    for sql in ("SELEC id FROM n", "SELECT id FROM n WHERE", "SELECT id\nFROM n\nWHERE id ! 3"):
        try:
            db.query(sql)
        except TidemarkError as e:
            seen.append(tuple(int(x) for x in str(e).split("(line ", 1)[1].split(")", 1)[0].split(", column ")))
    return spark.createDataFrame(seen, "line int, place int")


# -- reading
@_store("SELECT event_id + 1 AS _row_id, event_id + 1 AS _tx_inserted FROM events")
def envelope_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and transactions of all versions: no value column is read."""
    from tidemark.catalogue import event_table

    return event_table(spark, sf_dir).table("events").versions(spark).select("_row_id", "_tx_inserted")


@_store("SELECT count(*) AS n FROM (SELECT event_id + 1 AS a, lead(event_id + 1) OVER (PARTITION BY user_id ORDER BY event_id) AS z FROM events) WHERE a <= 700 AND (z IS NULL OR z > 700)")
def row_count_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.catalogue import event_table

    return spark.createDataFrame([(event_table(spark, sf_dir).row_count("events", 700),)], "n long")


@_store(f"SELECT id, name FROM ({_NATION}) WHERE id < 7")
def row_visitor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows one at a time; the visitor ends the scan by raising."""
    seen: list[tuple] = []

    def visit(row: tuple) -> None:
        if row[0] == 7:
            raise StopIteration
        seen.append(row[:2])

    try:
        _nations(spark, sf_dir).for_each_row("n", visit)
    except StopIteration:
        pass
    return spark.createDataFrame(seen, "id long, name string")


@_store(f"SELECT k, p FROM ({_ORDERS}) WHERE (c BETWEEN 5 AND 9 AND k != 77) OR (c = 11 AND p != '5-LOW')")
def index_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two indexes on a table; a range by one of them and a point by the other."""
    db = _orders(spark, sf_dir)
    db.create_index("o", "k")
    db.create_index("o", "c")
    db.query("DELETE FROM o WHERE k = 77")
    return db.query("SELECT k, p FROM o WHERE c BETWEEN 5 AND 9").df.unionAll(db.query("SELECT k, p FROM o WHERE p != '5-LOW' AND c = 11").df)


@_store(f"SELECT c AS value, count(*) AS n, (SELECT count(DISTINCT c) FROM ({_ORDERS})) AS keys FROM ({_ORDERS}) GROUP BY c")
def index_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = _orders(spark, sf_dir)
    db.create_index("o", "c")
    index = db.index("o", "c")
    return index.pairs().groupBy("value").agg(F.count("_row_id").alias("n")).withColumn("keys", F.lit(index.distinct_keys()).cast("long"))


@_store(f"SELECT row_number() OVER (ORDER BY c DESC, k) - 1 AS place, k, c FROM ({_ORDERS}) ORDER BY c DESC, k LIMIT 30")
def index_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = _orders(spark, sf_dir)
    db.create_index("o", "c")
    found = db.select_ordered_by_index("o", "c", True, limit=30)
    return spark.createDataFrame([(i, r[0], r[1]) for i, r in enumerate(found)], "place long, k long, c long")


@_store(f"SELECT count(*) AS n, true AS first, true AS second, true AS none FROM ({_ORDERS})")
def cache_resident(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nothing is kept after one read, the table after two, nothing without room."""
    db = _orders(spark, sf_dir)
    db.set_cache_capacity(1 << 20)
    db.row_count("o")
    first = db.cache_resident() == 0
    n = db.row_count("o")
    second = db.cache_resident() > 0
    db.set_cache_capacity(0)
    return spark.createDataFrame([(n, first, second, db.cache_resident() == 0)], "n long, first boolean, second boolean, none boolean")


# -- storage and publishing
@_store(f"SELECT * FROM ({_NATION}) WHERE region != 3 UNION ALL SELECT 100, 'late', 9")
def workspace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A workspace that is closed and opened again, written in commits of both kinds."""
    path = scratch(spark, "workspace")
    db = _nations(spark, sf_dir, Database.dev(spark, path))
    db.set_durability("sync")
    db.query("INSERT INTO n VALUES (100, 'late', 9)")
    db.set_autocommit(False)
    db.query("DELETE FROM n WHERE region = 3")
    db.flush_now()
    db.query("INSERT INTO n VALUES (101, 'never committed', 9)")
    return Database.dev(spark, path).query("SELECT * FROM n").df


@_store(f"SELECT * FROM ({_NATION})")
def prod_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An artifact baked to a file and opened from it keeps the history."""
    path = f"{scratch(spark, 'bake')}/n.tmrk"
    db = _nations(spark, sf_dir)
    mark = db.current_tx()
    db.query("DELETE FROM n WHERE id < 20")
    db.bake(path)
    return Database.prod(spark, path).query(f"SELECT * FROM n BEFORE {mark}").df


@_store("SELECT * FROM (VALUES ('magic', 'SignatureMismatchError'), ('version', 'UnsupportedVersionError'), ('cut', 'CorruptionError'), ('member', 'CorruptionError')) t(fault, error)")
def format_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Artifacts with a fault are refused: magic, version, length, a member's checksum."""
    data, seen = _nations(spark, sf_dir).bake_to_bytes(), []
    faults = {"magic": b"X" + data[1:], "version": data[:4] + b"\xff" + data[5:], "cut": data[:-3], "member": data[:100] + bytes([data[100] ^ 1]) + data[101:]}
    for fault, bad in faults.items():
        try:
            Database.from_bytes(spark, bad)
        except TidemarkError as e:
            seen.append((fault, type(e).__name__))
    return spark.createDataFrame(seen, "fault string, error string")


@_store(f"SELECT k, c FROM ({_ORDERS}) WHERE k BETWEEN 100 AND 120")
def streamed_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two columns of three, and of the row groups those that can hold the keys, are fetched by ranges."""
    data = _orders(spark, sf_dir).bake_to_bytes()
    return Database.streamed(spark, BytesReader(data), len(data)).query("SELECT k, c FROM o WHERE k BETWEEN 100 AND 120").df


@_store("SELECT o_orderkey, o_custkey, o_orderpriority, o_orderstatus FROM orders")
def transposed_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows to encoded columns by blocks, and back."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus")
    return codecs.untranspose(codecs.transpose(o, "o_orderkey"), "o_orderkey long, o_custkey long, o_orderpriority string, o_orderstatus string")


@_store("SELECT o_orderkey, CAST(ceil(length(bin(o_orderkey)) / 7.0) AS BIGINT) AS n FROM orders")
def uvarint_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", codecs.uvarint_length(F.col("o_orderkey")).cast("long").alias("n"))


@_store("SELECT CAST(n_nationkey AS BIGINT) AS k, CAST(n_nationkey * 3 % 32 AS BIGINT) AS v, CAST(ceil(25 * 5 / 8.0) AS BIGINT) AS n_bytes FROM nation")
def packed_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of five bits, packed and unpacked."""
    packed = codecs.pack_bits([k * 3 % 32 for k in range(25)], 5)
    return spark.createDataFrame([(k, v, len(packed)) for k, v in enumerate(codecs.unpack_bits(packed, 5, 25))], "k long, v long, n_bytes long")


@_store("SELECT count(*) AS n_blobs, CAST(sum(b) AS BIGINT) AS stored_bytes, CAST(sum(b * n) AS BIGINT) AS logical_bytes FROM (SELECT strlen(text) AS b, count(*) AS n FROM documents WHERE strlen(text) > 16 GROUP BY text)")
def cas_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codecs.dedup_ratio(spark.read.parquet(f"{sf_dir}/documents.parquet"), "text")


# -- interfaces
@_store(f"SELECT id, name FROM ({_NATION}) WHERE region = 1 AND id > 2")
def dbapi_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").cast("int"), "n_name", F.col("n_regionkey").cast("int")).collect()]  # 25 rows
    with dbapi.connect("memory", spark) as c:
        c.execute("CREATE TABLE n (id, name, region)")
        c.cursor().executemany("INSERT INTO n VALUES (?, ?, ?)", rows)
        return spark.createDataFrame(c.execute("SELECT id, name FROM n WHERE region = ? AND id > ?", [1, 2]).fetchall(), "id long, name string")


@_store(f"SELECT id, name FROM ({_NATION}) WHERE region = 1")
def http_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    server = make_server(_nations(spark, sf_dir), port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        body = json.dumps({"sql": "SELECT id, name FROM n WHERE region = ?", "params": [1]}).encode()
        with urllib.request.urlopen(urllib.request.Request(f"http://127.0.0.1:{server.server_port}/v1/query", data=body)) as r:
            return spark.createDataFrame([tuple(x) for x in json.loads(r.read())["rows"]], "id long, name string")
    finally:
        server.shutdown()


@_store(f"SELECT id, name, region FROM ({_NATION})")
def json_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = json.loads(_nations(spark, sf_dir).query("SELECT id, name, region FROM n").to_json())
    return spark.createDataFrame([tuple(r) for r in found["rows"]], ", ".join(f"{c} {t}" for c, t in zip(found["columns"], ("long", "string", "long"), strict=True)))
