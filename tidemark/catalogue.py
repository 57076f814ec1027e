"""Driver queries over the test tables, each with the SQL that DuckDB answers alike."""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.database import Database
from tidemark.functions import codecs, wasm
from tidemark.functions.predicates import compile_predicate
from tidemark.plans import ast
from tidemark.sources.versions import Table
from tidemark.streaming.ranges import BytesReader

TABLES = "region nation customer supplier part orders lineitem events".split()
#: Columns of the external tables as the dialect sees them: longs, decimals of scale 6, texts.
_VIEWS = {
    "lineitem": "SELECT l_orderkey, l_partkey, l_suppkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, CAST(l_quantity AS DECIMAL(38,6)) AS l_quantity, CAST(l_extendedprice AS DECIMAL(38,6)) AS l_extendedprice, CAST(l_discount AS DECIMAL(38,6)) AS l_discount, CAST(l_tax AS DECIMAL(38,6)) AS l_tax, l_returnflag, l_linestatus, epoch_us(l_shipdate) AS l_shipdate FROM lineitem",
    "orders": "SELECT o_orderkey, o_custkey, o_orderstatus, CAST(o_totalprice AS DECIMAL(38,6)) AS o_totalprice, epoch_us(o_orderdate) AS o_orderdate, o_orderpriority FROM orders",
    "part": "SELECT p_partkey, p_name, p_brand, p_type, CAST(p_size AS BIGINT) AS p_size, CAST(p_retailprice AS DECIMAL(38,6)) AS p_retailprice FROM part",
    "partn": "SELECT p_partkey, p_name, p_brand, p_type, CAST(NULLIF(p_size, 5) AS BIGINT) AS p_size, CAST(p_retailprice AS DECIMAL(38,6)) AS p_retailprice FROM part",
    "partb": "SELECT p_partkey, replace(p_name, ' ', chr(92)) AS p_name FROM part",
    "customer": "SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, CAST(c_acctbal AS DECIMAL(38,6)) AS c_acctbal, c_mktsegment FROM customer",
    "nation": "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey FROM nation",
    "region": "SELECT CAST(r_regionkey AS BIGINT) AS r_regionkey, r_name FROM region",
}


def open_tables(spark: SparkSession, sf_dir: str, names: tuple[str, ...] = tuple(TABLES)) -> Database:
    """The tables as read-only external ones; ``partn`` is part with sizes of 5 as null, ``partb`` has backslashes in its names."""
    db = Database.memory(spark)
    for name in names:
        db.register(name, f"{sf_dir}/{name}.parquet")
    if "part" in names:
        db.register("partn", spark.read.parquet(f"{sf_dir}/part.parquet").withColumn("p_size", F.expr("nullif(p_size, 5)")))
        db.register("partb", spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.translate("p_name", " ", "\\").alias("p_name")))
    return db


#: key: (statement of the dialect, SQL over the views above)
_SQL: dict[str, tuple[str, str]] = {}


def _same(key: str, sql: str, other: str | None = None) -> None:
    _SQL[key] = (sql, other or sql)


_same("scan_all", "SELECT * FROM nation")
_same("project_columns", "SELECT o_orderkey, o_custkey FROM orders")
_same("project_alias", "SELECT c_custkey AS id, c_name AS label FROM customer")
_same("filter_eq_null_safe", "SELECT p_partkey FROM partn WHERE p_size = NULL OR p_size = 7", "SELECT p_partkey FROM partn WHERE p_size IS NULL OR p_size = 7")
_same("filter_ne_null_safe", "SELECT p_partkey, p_size FROM partn WHERE p_size != 7", "SELECT p_partkey, p_size FROM partn WHERE p_size IS DISTINCT FROM 7")
for _key, _op in (("lt", "<"), ("le", "<="), ("gt", ">"), ("ge", ">=")):
    _same(f"filter_cmp_{_key}", f"SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity {_op} 10")
_same("filter_fraction_of_int", "SELECT p_partkey FROM partn WHERE p_size > 24.5")
_same("filter_cross_kind", "SELECT n_nationkey FROM nation WHERE n_name > 5 AND n_nationkey < 'a'", "SELECT n_nationkey FROM nation")
_same("filter_bool_prec", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R' OR l_linestatus = 'O' AND l_quantity > 40")
_same("filter_parens", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_returnflag = 'R' OR l_linestatus = 'O') AND l_quantity > 40")
_same("filter_like", "SELECT p_partkey FROM part WHERE p_name LIKE '%e% b_lt'")
_same("filter_not_like", "SELECT p_partkey FROM part WHERE p_type NOT LIKE 'S%'")
_same("filter_like_backslash", "SELECT p_partkey FROM partb WHERE p_name LIKE '%d\\_olt'")
_same("filter_in", "SELECT p_partkey FROM partn WHERE p_size IN (1, 7, NULL, 9)", "SELECT p_partkey FROM partn WHERE p_size IN (1, 7, 9)")
_same("filter_not_in", "SELECT p_partkey FROM partn WHERE p_size NOT IN (1, 7, 9)")
_same("filter_not_in_null", "SELECT p_partkey FROM partn WHERE p_size NOT IN (1, NULL)", "SELECT p_partkey FROM partn WHERE false")
_same("filter_between", "SELECT o_orderkey FROM orders WHERE o_totalprice BETWEEN 1000 AND 50000.5")
_same("filter_not_between", "SELECT p_partkey FROM partn WHERE p_size NOT BETWEEN 5 AND 45")
_same("filter_between_null_low", "SELECT p_partkey FROM partn WHERE p_size BETWEEN NULL AND 5", "SELECT p_partkey FROM partn WHERE p_size <= 5")
_same("filter_between_null_high", "SELECT p_partkey FROM partn WHERE p_size NOT BETWEEN 1 AND NULL", "SELECT p_partkey FROM partn WHERE p_size IS NOT NULL")
_same("filter_is_null", "SELECT p_partkey FROM partn WHERE p_size IS NULL")
_same("filter_is_not_null", "SELECT p_partkey FROM partn WHERE p_size IS NOT NULL")
_same("count_star", "SELECT COUNT(*) AS n FROM lineitem")
_same("count_col", "SELECT COUNT(p_size) AS n FROM partn")
_same("sum_int", "SELECT SUM(p_size) AS s FROM partn", "SELECT CAST(SUM(p_size) AS BIGINT) AS s FROM partn")
_same("sum_decimal", "SELECT SUM(l_extendedprice) AS s FROM lineitem", "SELECT CAST(SUM(l_extendedprice) AS DECIMAL(38,6)) AS s FROM lineitem")
_same("min_max_text", "SELECT MIN(p_name) AS lo, MAX(p_name) AS hi FROM part")
_same("min_max_num", "SELECT MIN(l_quantity) AS lo, MAX(l_extendedprice) AS hi FROM lineitem")


def _avg(column: str) -> str:
    """Exact, half away from zero at scale 6, by whole mantissas."""
    s, n = f"CAST(sum(CAST({column} * 1000000 AS HUGEINT)) AS HUGEINT)", f"CAST(count({column}) AS HUGEINT)"
    return f"CAST(CAST(sign({s}) * ((abs({s}) * 2 + {n}) // (2 * {n})) AS DECIMAL(32,0)) * CAST('0.000001' AS DECIMAL(6,6)) AS DECIMAL(38,6))"


_same("avg_exact", "SELECT l_returnflag, AVG(l_extendedprice) AS a FROM lineitem GROUP BY l_returnflag", f"SELECT l_returnflag, {_avg('l_extendedprice')} AS a FROM lineitem GROUP BY l_returnflag")
_same("avg_int", "SELECT p_brand, AVG(p_size) AS a FROM partn GROUP BY p_brand", f"SELECT p_brand, {_avg('CAST(p_size AS DECIMAL(18,0))')} AS a FROM partn GROUP BY p_brand")
_same("group_by_1", "SELECT o_orderpriority, COUNT(*) AS n FROM orders GROUP BY o_orderpriority")
_same("group_by_2", "SELECT l_returnflag, l_linestatus, COUNT(*) AS n, SUM(l_quantity) AS q FROM lineitem GROUP BY l_returnflag, l_linestatus", "SELECT l_returnflag, l_linestatus, COUNT(*) AS n, CAST(SUM(l_quantity) AS DECIMAL(38,6)) AS q FROM lineitem GROUP BY ALL")
_same("group_keys_only", "SELECT p_brand FROM part GROUP BY p_brand")
_same("group_null_key", "SELECT p_size, COUNT(*) AS n FROM partn GROUP BY p_size")
_same("having_agg", "SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING COUNT(*) > 12")
_same("having_alias", "SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING n > 12 AND n != 14")
_same("having_unselected", "SELECT o_custkey FROM orders GROUP BY o_custkey HAVING SUM(o_totalprice) > 2000000 OR MAX(o_totalprice) < 100000")
_same("having_no_group", "SELECT COUNT(*) AS n FROM orders HAVING COUNT(*) > 1")
_same("distinct_1", "SELECT DISTINCT p_type FROM part")
_same("distinct_2", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
_same("distinct_order_hidden_limit", "SELECT DISTINCT p_brand FROM part ORDER BY p_retailprice, p_partkey LIMIT 5", "SELECT p_brand FROM part GROUP BY p_brand ORDER BY min(row(p_retailprice, p_partkey)) LIMIT 5")
_same("order_multi_limit", "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey LIMIT 50")
_same("topk", "SELECT l_orderkey, l_linenumber FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 50")
_same("order_source_not_alias", "SELECT o_custkey AS o_orderkey FROM orders ORDER BY o_orderkey LIMIT 20", "SELECT o_custkey AS o_orderkey FROM orders ORDER BY orders.o_orderkey LIMIT 20")
_same("order_nulls", "SELECT p_partkey, p_size FROM partn ORDER BY p_size, p_partkey LIMIT 40", "SELECT p_partkey, p_size FROM partn ORDER BY p_size NULLS FIRST, p_partkey LIMIT 40")
_same("pricing_summary", "SELECT l_returnflag, l_linestatus, SUM(l_quantity) AS sum_qty, SUM(l_extendedprice) AS sum_price, AVG(l_discount) AS avg_disc, COUNT(*) AS n FROM lineitem WHERE l_quantity <= 45 GROUP BY l_returnflag, l_linestatus HAVING COUNT(*) > 1 ORDER BY l_returnflag, l_linestatus", f"SELECT l_returnflag, l_linestatus, CAST(SUM(l_quantity) AS DECIMAL(38,6)) AS sum_qty, CAST(SUM(l_extendedprice) AS DECIMAL(38,6)) AS sum_price, {_avg('l_discount')} AS avg_disc, COUNT(*) AS n FROM lineitem WHERE l_quantity <= 45 GROUP BY l_returnflag, l_linestatus HAVING COUNT(*) > 1")


def _dialect(sql: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        table = sql.split(" FROM ", 1)[1].split()[0]
        return open_tables(spark, sf_dir, ("part" if table in ("partn", "partb") else table,)).query(sql).df

    return run


def _oracle(sql: str) -> str:
    """The views come before; ``WITH`` names shadow the tables they read."""
    used = [v for v in _VIEWS if f" {v}" in sql or f"{v}." in sql]
    return "WITH " + ", ".join(f"{v} AS MATERIALIZED ({_VIEWS[v].replace(f'FROM {v}', f'FROM main.{v}').replace('FROM part', 'FROM main.part')})" for v in used) + " " + sql


# -- versions: every event of a user replaces the one before
_EVENT_VERSIONS = "SELECT event_id, user_id, event_type, event_id + 1 AS tx_ins, lead(event_id + 1) OVER (PARTITION BY user_id ORDER BY event_id) AS tx_del FROM events"


def event_table(spark: SparkSession, sf_dir: str) -> Database:
    """events as a versioned table: written as segments and a deletion log, never collected."""
    db = Database.memory(spark)
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "event_type")
    over = Window.partitionBy("user_id").orderBy("event_id")
    e = e.withColumn("_tx_deleted", F.lead(F.col("event_id") + 1).over(over))
    t = Table("events", ["event_id", "user_id", "event_type"], [["i"], ["i"], ["t"]])
    t.segments, t.deletions = [f"{db.root}/data"], [f"{db.root}/deletes"]
    e.select((F.col("event_id") + 1).alias("_row_id"), (F.col("event_id") + 1).alias("_tx_inserted"), F.col("event_id").alias("c0__i"), F.col("user_id").alias("c1__i"), F.col("event_type").alias("c2__t")).write.mode("overwrite").parquet(t.segments[0])
    e.where("_tx_deleted IS NOT NULL").select((F.col("event_id") + 1).alias("_row_id"), "_tx_deleted").write.mode("overwrite").parquet(t.deletions[0])
    t.n_deleted = spark.read.parquet(t.deletions[0]).count()
    db.clock = spark.read.parquet(t.segments[0]).agg(F.max("_tx_inserted")).first()[0]
    t.next_row = db.clock + 1
    db.tables["events"] = t
    return db


def _as_of(tx: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        db = event_table(spark, sf_dir)
        at = {"0": 0, "mid": 500, "half": db.clock // 2, "latest": db.clock, "beyond": db.clock + 1000}[tx]
        return db.query(f"SELECT event_id, user_id, event_type FROM events BEFORE {at}").df

    return run


def _as_of_sql(tx: str) -> str:
    at = {"0": "0", "mid": "500", "half": "(SELECT (max(event_id) + 1) // 2 FROM events)", "latest": "(SELECT max(event_id) + 1 FROM events)", "beyond": "(SELECT max(event_id) + 1001 FROM events)"}[tx]
    return f"SELECT event_id, user_id, event_type FROM ({_EVENT_VERSIONS}) WHERE tx_ins <= {at} AND (tx_del IS NULL OR tx_del > {at})"


def version_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = event_table(spark, sf_dir)
    return db.query("SELECT event_type, COUNT(*) AS n FROM events GROUP BY event_type BEFORE 700").df


def _nation_store(spark: SparkSession, sf_dir: str) -> Database:
    db = Database.memory(spark)
    db.query("CREATE TABLE n (id, name, region)")
    db.insert_frame("n", spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_name", "n_regionkey").coalesce(1).sortWithinPartitions("n_nationkey"))
    return db


def update_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = _nation_store(spark, sf_dir)
    db.query("UPDATE n SET name = 'moved' WHERE region = 2")
    db.query("UPDATE n SET region = 9 WHERE id BETWEEN 3 AND 6")
    return db.query("SELECT * FROM n").df


def delete_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = _nation_store(spark, sf_dir)
    db.query("DELETE FROM n WHERE region = 1 OR name LIKE 'A%'")
    db.query("DELETE FROM n WHERE id > 1000")
    return db.query("SELECT * FROM n").df


def update_tx_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The transaction that wrote each version that an UPDATE made: one deletes, then one a row in order."""
    db = _nation_store(spark, sf_dir)
    db.query("UPDATE n SET name = 'x' WHERE region = 2")
    rel = db.relation("n")
    return rel.df.where(compile_predicate(ast.Compare("name", "=", "x"), rel.resolve)).select(F.col("c0__i").alias("id"), F.col("_tx_inserted").alias("tx"))


def params_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = open_tables(spark, sf_dir, ("part",))
    return db.query("SELECT p_partkey FROM part WHERE p_size >= ? AND p_type != ? AND p_retailprice < ?", [10, "it's ?", Decimal("1500.25")]).df


def insert_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = Database.memory(spark)
    db.query("CREATE TABLE o (k, c, s)")
    db.insert_frame("o", spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderstatus"))
    return db.query(f"SELECT s, COUNT(*) AS n, SUM(c) AS t FROM o GROUP BY s BEFORE {db.clock}").df


def bake_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = _nation_store(spark, sf_dir)
    db.query("DELETE FROM n WHERE id = 4")
    return Database.from_bytes(spark, db.bake_to_bytes()).query("SELECT * FROM n BEFORE 25").df


def streamed_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = _nation_store(spark, sf_dir).bake_to_bytes()
    return Database.streamed(spark, BytesReader(data), len(data)).query("SELECT name, region FROM n WHERE region >= 2").df


def dump_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/region.parquet").collect()  # five rows: a dump is a text on the driver
    dump = "PRAGMA x=1; BEGIN; CREATE TABLE \"r\" (k INTEGER PRIMARY KEY, n TEXT);" + "".join(f"INSERT INTO r VALUES ({r[0]}, '{r[1]}');" for r in rows) + "CREATE INDEX i ON r (n); COMMIT;"
    db = Database.memory(spark)
    db.import_sql(dump)
    return db.query("SELECT k, n FROM r").df


def zigzag(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = (F.col("event_id") - 500) * F.when(F.col("event_id") % 2 == 0, 1).otherwise(-7)
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", codecs.zigzag(v).alias("z"), codecs.unzigzag(codecs.zigzag(v)).alias("v"))


def delta_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_custkey", "o_orderkey")
    return codecs.delta_z(o, "o_orderkey", "o_orderkey", "o_custkey").select("o_orderkey", "dz")


def dict_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderpriority")
    return codecs.encode_dictionary(o, "o_orderpriority", "o_orderkey").select("o_orderkey", F.col("code").cast("long").alias("code"))


def bits_for_cardinality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", codecs.bits_for_cardinality(F.col("p_partkey")).cast("long").alias("bits"))


def cas_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codecs.content_blobs(spark.read.parquet(f"{sf_dir}/documents.parquet"), "text")


def wasm_scalar_sum_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    return n.select(F.col("n_nationkey").cast("long").alias("k"), wasm.sum_bytes(F.encode("n_name", "UTF-8")).cast("long").alias("s"))


def wasm_apply_inc(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    return n.select(F.col("n_nationkey").cast("long").alias("k"), F.lower(F.hex(wasm.apply_udf(wasm.INC_BYTES, "inc")(F.encode("n_name", "UTF-8")))).alias("h"))


_NATION = "SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name, CAST(n_regionkey AS BIGINT) AS region FROM nation"
_OTHER: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    **{f"time_travel_asof_{k}": (_as_of(k), _as_of_sql(k)) for k in ("0", "mid", "half", "latest", "beyond")},
    "version_counts": (version_counts, f"SELECT event_type, count(*) AS n FROM ({_EVENT_VERSIONS}) WHERE tx_ins <= 700 AND (tx_del IS NULL OR tx_del > 700) GROUP BY event_type"),
    "update_replay": (update_replay, f"SELECT id, CASE WHEN region = 2 THEN 'moved' ELSE name END AS name, CASE WHEN id BETWEEN 3 AND 6 THEN CAST(9 AS BIGINT) ELSE region END AS region FROM ({_NATION})"),
    "delete_replay": (delete_replay, f"SELECT * FROM ({_NATION}) WHERE NOT (region = 1 OR name LIKE 'A%')"),
    "update_tx_numbering": (update_tx_numbering, f"SELECT id, (SELECT count(*) FROM nation) + 1 + row_number() OVER (ORDER BY id) AS tx FROM ({_NATION}) WHERE region = 2"),
    "params_bound": (params_bound, "SELECT p_partkey FROM part WHERE p_size >= 10 AND p_type != 'it''s ?' AND CAST(p_retailprice AS DECIMAL(38,6)) < 1500.25"),
    "insert_frame": (insert_frame, "SELECT o_orderstatus AS s, count(*) AS n, CAST(sum(o_custkey) AS BIGINT) AS t FROM orders GROUP BY o_orderstatus"),
    "bake_roundtrip": (bake_roundtrip, _NATION),
    "streamed_open": (streamed_open, f"SELECT name, region FROM ({_NATION}) WHERE region >= 2"),
    "dump_import": (dump_import, "SELECT CAST(r_regionkey AS BIGINT) AS k, r_name AS n FROM region"),
    "zigzag": (zigzag, "SELECT event_id, CASE WHEN v < 0 THEN -2 * v - 1 ELSE 2 * v END AS z, v FROM (SELECT event_id, (event_id - 500) * CASE WHEN event_id % 2 = 0 THEN 1 ELSE -7 END AS v FROM events)"),
    "delta_z": (delta_z, "SELECT o_orderkey, CASE WHEN p IS NULL THEN o_orderkey ELSE 2 * (o_orderkey - p) END AS dz FROM (SELECT o_orderkey, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS p FROM orders)"),
    "dict_codes": (dict_codes, "SELECT o_orderkey, c.code FROM orders o JOIN (SELECT o_orderpriority, row_number() OVER (ORDER BY min(o_orderkey)) - 1 AS code FROM orders GROUP BY o_orderpriority) c USING (o_orderpriority)"),
    "bits_for_cardinality": (bits_for_cardinality, "SELECT p_partkey, CAST(greatest(1, least(8, CASE WHEN p_partkey <= 1 THEN 0 ELSE ceil(log2(p_partkey)) END)) AS BIGINT) AS bits FROM part"),
    "cas_dedup": (cas_dedup, "SELECT sha256(text) AS sha256, strlen(text) AS n_bytes, count(*) AS copies FROM documents WHERE strlen(text) > 16 GROUP BY ALL"),
    "wasm_scalar_sum_bytes": (wasm_scalar_sum_bytes, "SELECT CAST(n_nationkey AS BIGINT) AS k, CAST(list_sum(list_transform(string_split(n_name, ''), lambda c: ord(c))) AS BIGINT) AS s FROM nation"),
    "wasm_apply_inc": (wasm_apply_inc, "SELECT CAST(n_nationkey AS BIGINT) AS k, lower(hex(array_to_string(list_transform(string_split(n_name, ''), lambda c: chr(ord(c) + 1)), ''))) AS h FROM nation"),
}

from tidemark.catalogue_store import STORE  # noqa: E402

_OTHER |= STORE
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: _dialect(sql) for k, (sql, _) in _SQL.items()} | {k: f for k, (f, _) in _OTHER.items()}
ORACLES: dict[str, str] = {k: _oracle(sql) for k, (_, sql) in _SQL.items()} | {k: sql for k, (_, sql) in _OTHER.items() if sql is not None}
