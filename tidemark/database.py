"""The database: a catalog, a transaction clock and a store, over one SparkSession."""

from __future__ import annotations

import json
from collections import OrderedDict
from collections.abc import Callable, Sequence
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.errors import ManifestError, QueryError, ReadOnlyError, SchemaError, TableNotFoundError, UnsupportedVersionError
from tidemark.functions.predicates import compile_predicate, kind_of
from tidemark.operators.relation import Relation, external
from tidemark.operators.select import select
from tidemark.plans import ast
from tidemark.plans.lexer import I64
from tidemark.plans.parser import parse
from tidemark.policy import assert_compliance
from tidemark.result import QueryResult
from tidemark.sources.files import Files, scratch
from tidemark.sources.indexes import Index, narrowed
from tidemark.sources.versions import Table

FORMAT = 1
#: Rows gathered on the driver before they become a segment, and the most that an UPDATE collects.
MEMTABLE = 50_000
PAGE = 4096


class Database:
    """Open one with ``memory``, ``dev``, ``prod``, ``streamed`` or ``from_bytes``."""

    def __init__(self, spark: SparkSession, root: str, writable: bool = True, persistent: bool = False):
        self.spark, self.root, self.persistent = spark, root.rstrip("/"), persistent
        self.files, self.tables, self.views = Files(spark), {}, {}
        self._writable, self.clock, self.commits = writable, 0, 0
        self.autocommit, self.durability, self.stable_order, self.cache_capacity = True, "fast", True, 4096
        #: Tables read twice: their segments in Spark's storage memory, the least lately read first.
        self._cached: OrderedDict[str, tuple[tuple[str, ...], DataFrame, int]] = OrderedDict()
        self._read_once: dict[str, tuple[str, ...]] = {}

    # -- opening
    @classmethod
    def memory(cls, spark: SparkSession) -> Database:
        """A database whose segments, if any, live in a scratch folder of this application."""
        return cls(spark, scratch(spark, "db"))

    @classmethod
    def dev(cls, spark: SparkSession, path: str) -> Database:
        """A workspace folder: Parquet segments, deletions and numbered manifests."""
        db = cls(spark, path, persistent=True)
        if db.files.exists(f"{db.root}/_log/CURRENT"):
            db.load(db.files.read(f"{db.root}/_log/{db.files.read(f'{db.root}/_log/CURRENT').decode()}"))
        return db

    @classmethod
    def prod(cls, spark: SparkSession, path: str) -> Database:
        from tidemark.sources.artifact import open_artifact

        return open_artifact(spark, path)

    @classmethod
    def streamed(cls, spark: SparkSession, reader, size: int) -> Database:
        from tidemark.streaming.ranges import open_streamed

        return open_streamed(spark, reader, size)

    @classmethod
    def from_bytes(cls, spark: SparkSession, data: bytes) -> Database:
        from tidemark.sources.artifact import import_bytes

        return import_bytes(spark, data)

    def load(self, manifest: bytes) -> None:
        try:
            found = json.loads(manifest)
            version = found["version"]
        except (ValueError, KeyError, TypeError) as e:
            raise ManifestError(f"the catalog can't be read: {e}") from e
        if not isinstance(version, int) or not 1 <= version <= FORMAT:
            raise UnsupportedVersionError(f"catalog version {version}")
        try:
            self.clock, self.commits = int(found["clock"]), int(found.get("commits", 0))
            here = lambda p: p if "://" in p or p.startswith("/") else f"{self.root}/{p}"
            self.tables = {}
            for t in found["tables"]:
                indexed = {c: {here(s): here(p) for s, p in folders.items()} for c, folders in t.get("indexed", {}).items()}
                t = t | {"segments": [here(p) for p in t["segments"]], "deletions": [here(p) for p in t["deletions"]], "indexed": indexed}
                self.tables[t["name"]] = Table(**t)
        except (KeyError, TypeError, ValueError) as e:
            raise ManifestError(f"the catalog can't be read: {e}") from e

    def manifest(self) -> bytes:
        strip = lambda p: p.removeprefix(f"{self.root}/")
        tables = [
            t.manifest() | {"segments": [strip(p) for p in t.segments], "deletions": [strip(p) for p in t.deletions], "indexed": {c: {strip(s): strip(p) for s, p in folders.items()} for c, folders in t.indexed.items()}}
            for t in self.tables.values()
        ]
        return json.dumps({"version": FORMAT, "clock": self.clock, "commits": self.commits, "tables": tables}).encode()

    # -- commits
    def _mutated(self) -> None:
        big = any(len(t.rows) + len(t.gone) >= MEMTABLE for t in self.tables.values())
        if big or (self.persistent and self.autocommit):
            self.flush_now()

    def flush_now(self) -> None:
        """Data files first, then one manifest, then the pointer: a commit is seen whole or not at all."""
        for t in self.tables.values():
            t.flush(self.spark, f"{self.root}/{self._folder(t.name)}", self.files)
        if self.persistent:
            self.commits += 1
            sync = self.durability == "sync"
            self.files.write(f"{self.root}/_log/{self.commits}.json", self.manifest(), sync)
            self.files.write(f"{self.root}/_log/CURRENT", f"{self.commits}.json".encode(), sync)

    @staticmethod
    def _folder(name: str) -> str:
        return "t_" + "".join(c if c.isascii() and c.isalnum() else f"~{ord(c):x}~" for c in name)

    def set_autocommit(self, on: bool) -> None:
        self.autocommit = on

    def set_durability(self, level: str) -> None:
        if level not in ("fast", "sync"):
            raise QueryError(f"durability is fast or sync, not {level}")
        self.durability = level

    def set_cache_capacity(self, pages: int) -> None:
        """So many pages of ``PAGE`` stored bytes are kept in Spark's storage memory; 0 keeps none."""
        self.cache_capacity = pages
        self._evict(0)

    def cache_resident(self) -> int:
        """The pages of all tables that are kept now."""
        return sum(pages for _, _, pages in self._cached.values())

    def _evict(self, more: int) -> None:
        while self._cached and self.cache_resident() + more > self.cache_capacity:
            self._cached.popitem(last=False)[1][1].unpersist()

    def _from_cache(self, t: Table) -> DataFrame | None:
        """The versions of a table whose segments are kept: those of tables read before that fit."""
        key = tuple(t.segments)
        if t.name in self._cached:
            if self._cached[t.name][0] == key:
                self._cached.move_to_end(t.name)
                stored = self._cached[t.name][1]
                return stored.unionAll(t.local(self.spark)) if t.rows else stored
            self._cached.pop(t.name)[1].unpersist()
        if not key or self._read_once.get(t.name) != key:
            self._read_once[t.name] = key
            return None
        pages = -(-sum(map(self.files.size, key)) // PAGE)
        if pages > self.cache_capacity:
            return None
        self._evict(pages)
        stored = self.spark.read.schema(t.schema()).parquet(*key).persist()
        self._cached[t.name] = (key, stored, pages)
        return stored.unionAll(t.local(self.spark)) if t.rows else stored

    def compact(self, table: str) -> None:
        self._check_writable()
        t = self.table(table)
        t.compact(self.spark, f"{self.root}/{self._folder(table)}")
        self._build_indexes(t)
        if self.persistent:
            self.flush_now()

    # -- catalog
    def table(self, name: str) -> Table:
        if name not in self.tables:
            raise TableNotFoundError(name)
        return self.tables[name]

    def register(self, name: str, source: DataFrame | str) -> None:
        """A typed DataFrame, or a Parquet path, as a read-only table."""
        self.views[name] = external(self.spark.read.parquet(source) if isinstance(source, str) else source)

    def relation(self, name: str, before: int | None = None, statement: ast.Select | None = None) -> Relation:
        """The table at ``before``; for a statement, of the versions that it can need."""
        if name in self.views:
            return self.views[name]
        t = self.table(name)
        versions = narrowed(self.spark, t, statement.where) if statement is not None else None
        return t.snapshot(self.spark, before, versions if versions is not None else self._from_cache(t))

    def table_names(self) -> list[str]:
        return sorted({*self.tables, *self.views})

    def column_names(self, table: str) -> list[str]:
        return list(self.relation(table).names) if table in self.views else list(self.table(table).columns)

    def current_tx(self) -> int:
        return self.clock

    def is_writable(self) -> bool:
        return self._writable

    def _check_writable(self) -> None:
        if not self._writable:
            raise ReadOnlyError("this database is read-only")

    # -- statements
    def query(self, sql: str, params: Sequence[object] | None = None) -> QueryResult:
        return self.execute(parse(sql, params if params is not None else []) if params is not None else parse(sql))

    query_with = query

    def execute(self, statement: ast.Statement) -> QueryResult:
        match statement:
            case ast.Select():
                rel = self.relation(statement.table, statement.before, statement)
                return QueryResult(select(rel, statement, False), ordered=(lambda: select(rel, statement, True)) if self.stable_order else None)
            case ast.CreateTable(table, columns):
                self.create_table(table, columns)
                return QueryResult()
            case ast.CreateIndex(table, column):
                self.create_index(table, column)
                return QueryResult()
            case ast.DropTable(table):
                self.drop_table(table)
                return QueryResult()
            case ast.Insert(table, values):
                self.insert(table, values)
                return QueryResult(mutated=1)
            case ast.Update(table, column, value, where):
                return QueryResult(mutated=self.update_where(table, column, value, where))
            case ast.Delete(table, where):
                return QueryResult(mutated=self.delete_where(table, where))
        raise QueryError("unknown statement")

    def create_table(self, name: str, columns: Sequence[str]) -> None:
        self._check_writable()
        if name in self.tables or name in self.views:
            raise SchemaError(f"table {name} exists")
        if not columns:
            raise SchemaError("a table needs a column")
        self.tables[name] = Table(name, list(columns))
        self._mutated()

    def create_index(self, table: str, column: str) -> None:
        t = self.table(table)
        if column not in t.columns:
            raise SchemaError(f"no such column: {column}")
        if column not in t.indexes:
            t.indexes.append(column)
        if self._writable:
            t.indexed.pop(column, None)
            self._build_indexes(t)
            self._mutated()

    def _build_indexes(self, t: Table) -> None:
        """Over all versions in segments; what comes in small commits later is scanned until ``compact``."""
        for column in t.indexes:
            Index(self.spark, t, column).build(f"{self.root}/{self._folder(t.name)}")

    def index(self, table: str, column: str) -> Index:
        if column not in self.table(table).indexes:
            raise SchemaError(f"no index on {column}")
        return Index(self.spark, self.table(table), column)

    def drop_table(self, name: str) -> None:
        self._check_writable()
        self.table(name)
        del self.tables[name]
        self._mutated()

    def insert(self, table: str, values: Sequence[ast.Value]) -> None:
        self._check_writable()
        t = self.table(table)
        row = tuple(stored(v) for v in values)
        if len(row) != len(t.columns):
            raise SchemaError(f"table {table} has {len(t.columns)} columns, {len(row)} values were given")
        self.clock += 1
        t.see(row)
        t.rows.append((t.next_row, self.clock, row))
        t.next_row += 1
        self._mutated()

    def insert_many(self, table: str, rows: Sequence[Sequence[ast.Value]]) -> int:
        """Many inserts, one flush."""
        before, self.autocommit = self.autocommit, False
        try:
            for r in rows:
                self.insert(table, r)
        finally:
            self.autocommit = before
        self._mutated()
        return len(rows)

    def insert_frame(self, table: str, df: DataFrame) -> int:
        """Bulk insert of a typed DataFrame, a transaction a row, without the driver seeing any."""
        self._check_writable()
        t = self.table(table)
        rel = external(df)
        if len(rel.names) != len(t.columns):
            raise SchemaError(f"table {table} has {len(t.columns)} columns, the rows have {len(rel.names)}")
        for kinds, own in zip(t.kinds, rel.physical, strict=True):
            kinds += [k for k in own if k not in kinds]
            kinds.sort(key="idtb".index)
        self._flush_table(t)
        cells = [F.col(own[k]).alias(p) if k in own else F.lit(None).cast(kind_type(k)).alias(p) for own, phys in zip(rel.physical, t.physical(), strict=True) for k, p in phys.items()]
        at = f"{self.root}/{self._folder(table)}/data/bulk-{t.next_row}-{len(t.segments)}"
        raw = f"{at}-raw"
        rel.df.select(*cells).write.mode("overwrite").parquet(raw)
        n = self._number(raw, t, at, cells=[p for own in t.physical() for p in own.values()], first_tx=self.clock + 1)
        self.files.remove(raw)
        self._build_indexes(t)
        self._mutated()
        return n

    def _number(self, raw: str, t: Table, at: str, cells: list[str], first_tx: int) -> int:
        """Write the rows of a folder with consecutive row ids and transactions, in the order of its files.

        A row's number is its place in its file and the rows of the files before: no row is
        shuffled or sorted for it.
        """
        df = self.spark.read.parquet(raw).select("*", F.col("_metadata.file_name").alias("_f"), F.col("_metadata.row_index").alias("_i"))
        counts = df.groupBy("_f").agg(F.count(F.lit(1)).alias("_c"))
        part = F.regexp_extract("_f", r"part-(\d+)-", 1).cast("long")
        before = Window.orderBy(part, "_f").rowsBetween(Window.unboundedPreceding, -1)
        # One row for each file, in one small table.
        found = [(r["_f"], r["_s"], r["_c"]) for r in counts.withColumn("_s", F.coalesce(F.sum("_c").over(before), F.lit(0))).collect()]
        n = sum(c for _, _, c in found)
        starts = self.spark.createDataFrame([(f, s) for f, s, _ in found], "_f string, _s long")
        rows = df.join(F.broadcast(starts) if len(found) <= 100_000 else starts, "_f").withColumn("_k", F.col("_s") + F.col("_i"))
        rows.select((F.col("_k") + t.next_row).alias("_row_id"), (F.col("_k") + first_tx).alias("_tx_inserted"), *cells).write.mode("overwrite").parquet(at)
        t.segments.append(at)
        t.next_row += n
        self.clock = first_tx + n - 1
        return n

    def _flush_table(self, t: Table) -> None:
        t.flush(self.spark, f"{self.root}/{self._folder(t.name)}", self.files)

    def delete_where(self, table: str, where: ast.Predicate) -> int:
        """One transaction, also if nothing matches or the table is unknown."""
        self._check_writable()
        self.clock += 1
        if table in self.views:
            raise ReadOnlyError(f"table {table} is read-only")
        t = self.table(table)
        rel = t.snapshot(self.spark, None)
        hit = rel.df.where(compile_predicate(where, rel.resolve)).select("_row_id")
        found = hit.limit(MEMTABLE + 1).collect()
        if len(found) <= MEMTABLE:
            t.gone += [(r[0], self.clock) for r in found]
            n = len(found)
        else:
            at = f"{self.root}/{self._folder(table)}/deletes/bulk-{self.clock}"
            hit.select("_row_id", F.lit(self.clock).cast("long").alias("_tx_deleted")).write.mode("overwrite").parquet(at)
            n = self.spark.read.parquet(at).count()
            t.deletions.append(at)
            t.n_deleted += n
        self._mutated()
        return n

    def update_where(self, table: str, column: str, value: ast.Value, where: ast.Predicate) -> int:
        """No transaction if nothing matches; else one for the deletion and one for each new version."""
        self._check_writable()
        if table in self.views:
            raise ReadOnlyError(f"table {table} is read-only")
        t = self.table(table)
        if column not in t.columns:
            raise SchemaError(f"no such column: {column}")
        index, value = t.columns.index(column), stored(value)
        rel = t.snapshot(self.spark, None)
        hit = rel.df.where(compile_predicate(where, rel.resolve))
        columns = [p for own in rel.physical for p in own.values()]
        found = hit.select("_row_id", *columns).limit(MEMTABLE + 1).collect()
        if not found:
            return 0
        if len(found) <= MEMTABLE:
            self.clock += 1
            deleted = self.clock
            for r in sorted(found, key=lambda r: r[0]):
                row = [next((r[p] for p in own.values() if r[p] is not None), None) for own in rel.physical]
                row[index] = value
                row = tuple(bytes(v) if isinstance(v, bytearray) else v for v in row)
                self.clock += 1
                t.see(row)
                t.gone.append((r[0], deleted))
                t.rows.append((t.next_row, self.clock, row))
                t.next_row += 1
            n = len(found)
        else:
            n = self._bulk_update(t, hit, rel, index, value)
        self._mutated()
        return n

    def _bulk_update(self, t: Table, hit: DataFrame, rel: Relation, index: int, value: ast.Value) -> int:
        """As above by Spark jobs: matched ids and new versions are written, neither is collected."""
        old = t.physical()
        if kind_of(value) is not None and kind_of(value) not in t.kinds[index]:
            t.kinds[index] = sorted([*t.kinds[index], kind_of(value)], key="idtb".index)
        from tidemark.functions.predicates import literal

        cells, names = [], []
        for i, own in enumerate(t.physical()):
            for k, p in own.items():
                names.append(p)
                if i == index:
                    cells.append((literal(value) if k == kind_of(value) else F.lit(None).cast(kind_type(k))).alias(p))
                else:
                    cells.append(F.col(old[i][k]).alias(p))
        base = f"{self.root}/{self._folder(t.name)}"
        raw = f"{base}/data/update-{self.clock}-raw"
        hit.select("_row_id", *cells).orderBy("_row_id").write.mode("overwrite").parquet(raw)
        matched = self.spark.read.parquet(raw)
        deleted, at = self.clock + 1, f"{base}/deletes/update-{self.clock}"
        matched.select("_row_id", F.lit(deleted).cast("long").alias("_tx_deleted")).write.mode("overwrite").parquet(at)
        n = self._number(raw, t, f"{base}/data/update-{deleted}", names, deleted + 1)
        t.deletions.append(at)
        t.n_deleted += n
        self.files.remove(raw)
        return n

    # -- API forms
    def select(self, table: str, before: int | None = None) -> list[tuple]:
        return self.execute(ast.Select(table, before=before)).rows()

    def select_where(self, table: str, column: str, value: ast.Value, before: int | None = None) -> list[tuple]:
        return self.select_filtered(table, ast.Compare(column, "=", value), before)

    def select_filtered(self, table: str, where: ast.Predicate | None, before: int | None = None) -> list[tuple]:
        return self.execute(ast.Select(table, where=where, before=before)).rows()

    def select_ordered_by_index(self, table: str, column: str, descending: bool = False, before: int | None = None, limit: int | None = None) -> list[tuple]:
        if table not in self.views and column not in self.table(table).indexes:
            raise SchemaError(f"no index on {column}")
        return self.execute(ast.Select(table, order_by=(ast.OrderKey(column, descending),), before=before, limit=limit)).rows()

    def delete(self, table: str, column: str, value: ast.Value) -> int:
        return self.delete_where(table, ast.Compare(column, "=", value))

    def update(self, table: str, set_column: str, set_value: ast.Value, column: str, value: ast.Value) -> int:
        return self.update_where(table, set_column, set_value, ast.Compare(column, "=", value))

    def row_count(self, table: str, before: int | None = None) -> int:
        """Reads transaction columns only."""
        return self.relation(table, before).df.count()

    def for_each_row(self, table: str, visit: Callable[[tuple], object], before: int | None = None) -> int:
        """Visit rows one at a time; an exception of ``visit`` ends the scan and is passed on."""
        from tidemark.streaming.rows import for_each_row

        return for_each_row(self.execute(ast.Select(table, before=before)), visit)

    # -- publishing
    def bake_to_bytes(self) -> bytes:
        from tidemark.sources.artifact import bake_to_bytes

        return bake_to_bytes(self)

    def bake(self, path: str) -> None:
        """Writes the artifact from stream to stream."""
        from tidemark.sources.artifact import bake

        bake(self, path)

    export = bake_to_bytes

    def import_sql(self, dump: str):
        from tidemark.sources.dump import import_sql

        return import_sql(self, dump)

    # -- byte functions and policy
    def run_wasm_scalar(self, module: bytes, function: str, data: bytes, backend=None) -> int:
        """``backend`` makes a runner of a module; the interpreter is the default."""
        from tidemark.functions.wasm import Instance

        return (backend or Instance)(module).scalar(function, data)

    def run_wasm_apply(self, module: bytes, function: str, data: bytes, backend=None) -> bytes:
        from tidemark.functions.wasm import Instance

        return (backend or Instance)(module).apply(function, data)

    def assert_compliance(self, users: int, revenue: float, has_key: bool = False) -> None:
        assert_compliance(users, revenue, has_key)

    def close(self) -> None:
        for _, stored, _ in self._cached.values():
            stored.unpersist()
        self._cached.clear()
        if self._writable and self.persistent:
            self.flush_now()


def kind_type(kind: str) -> str:
    from tidemark.operators.relation import TYPES

    return TYPES[kind]


def stored(v: object) -> ast.Value:
    """A value as it is stored; others are errors."""
    if v is None or isinstance(v, str):
        return v
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, int):
        if not I64[0] <= v <= I64[1]:
            raise SchemaError("integer out of range")
        return v
    if isinstance(v, Decimal):
        if not v.is_finite() or abs(v) >= Decimal(10) ** 32:
            raise SchemaError("decimal out of range")
        return v.quantize(Decimal("0.000001"), rounding="ROUND_DOWN")
    if isinstance(v, bytes | bytearray):
        return bytes(v)
    raise SchemaError(f"a value can't be a {type(v).__name__}")
