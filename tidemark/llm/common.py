"""Shared helpers of the training-data operators.

Words are runs of ``[^\\x20\\x09-\\x0D]``: only the six ASCII white-space
characters separate them, so that a JVM regular expression, DuckDB and Python
agree whatever the text holds.

Names: internal columns are chosen against the columns that the caller has (``fresh``).
Where an operator keeps the caller's columns and one of them has the name of a column
that the operator adds, the added one replaces it (``without``).  Names are compared
without case, as Spark does.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator
from weakref import WeakKeyDictionary

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE_RE = r"[\x20\x09-\x0D]+"
WORD_RE = r"[^\x20\x09-\x0D]+"
_DIRS: dict[int, tuple[object, str]] = {}
_PATHS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
_FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """A folder of this application under ``spark.checkpoint.dir``.

    Only where that setting is absent and the master is this one process (local
    tests) a temporary folder is used; a cluster without the setting is an error.
    """
    sc = spark.sparkContext
    if (found := _DIRS.get(id(sc))) and found[0] is sc:
        return found[1]
    top = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not top:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        top = "file://" + tempfile.mkdtemp(prefix="tidemark-")
    path = f"{top.rstrip('/')}/tidemark-{sc.applicationId}-{uuid.uuid4().hex[:8]}"
    _DIRS[id(sc)] = (sc, path)
    atexit.register(_remove, sc, path)
    return path


def _remove(sc, path: str) -> None:
    try:
        jvm = sc._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may be gone already
        pass


@contextlib.contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Executions inside remove their shuffle files when they end."""
    before = spark.conf.get(_FREE, None)
    spark.conf.set(_FREE, "true")
    try:
        yield
    finally:
        spark.conf.unset(_FREE) if before is None else spark.conf.set(_FREE, before)


def cut(df: DataFrame, name: str = "part", codec: str = "snappy") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    It ends the lineage: a lost executor costs at most the tasks it was running,
    since every finished file is in storage that all executors see.  ``discard``
    removes the table before the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with freed_shuffles(spark):
        df.write.mode("overwrite").option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


def discard(*tables: DataFrame) -> None:
    """Removes tables that ``cut`` wrote, once all that reads them is written itself."""
    for df in tables:
        if path := _PATHS.pop(df, None):
            _remove(df.sparkSession.sparkContext, path)


def fresh(columns: list[str], *names: str) -> list[str]:
    """``names`` with as many underscores before them as no column has."""
    taken = {c.lower() for c in columns}
    prefix = "__"
    while any((prefix + n).lower() in taken for n in names):
        prefix += "_"
    return [prefix + n for n in names]


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without the columns that an operator's own of these names replace."""
    gone = {n.lower() for n in names}
    return df if not any(c.lower() in gone for c in df.columns) else df.select(*[col(c) for c in df.columns if c.lower() not in gone])


def col(name: str) -> Column:
    """A column by its exact name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def text_of(column: str = "text") -> Column:
    """The text, with null as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def row_key(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> list[Column]:
    """Two null-safe columns ``__id`` and ``__h`` that name a row by its id and whole text.

    Rows that agree in both are the same document written twice; operators that
    join on this key give every such row the same result.
    """
    return [
        F.coalesce(F.col(doc_id).cast("string"), F.lit("\u0000")).alias("__id"),
        F.xxhash64(F.concat(F.when(F.col(text).isNull(), F.lit("0")).otherwise(F.lit("1")), text_of(text))).alias("__h"),
    ]


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` for a join that broadcasts neither side, whatever size Spark expects.

    Spark doesn't count the rows that an explode adds, nor what Parquet saves on values that
    repeat, so a table that it broadcasts as small can be more than the driver's memory.
    """
    return df.hint("merge")


def copies(table: DataFrame, count: str, name: str, most: int = 100_000) -> DataFrame:
    """Each row of ``table`` (written) as often as its ``count`` says, numbered from 0 in ``name``.

    A row of very many copies is first dealt over tasks in pieces of ``most``, so that a hot
    document is no single task.
    """
    piece, = fresh(table.columns, "piece")
    few = table.where(F.col(count) <= most).withColumn(name, F.explode(F.sequence(F.lit(0).cast("long"), F.col(count) - 1)))
    many = table.where(F.col(count) > most).withColumn(piece, F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"({count} - 1) div {most}"))))
    many = many.repartition(*[F.col(c) for c in (*table.columns, piece)])
    many = many.withColumn(name, F.explode(F.sequence(F.col(piece) * most, F.least(F.col(count), (F.col(piece) + 1) * most) - 1))).drop(piece)
    return few.unionAll(many)


def map_rows(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[list[pa.Array]]], added: dict[str, str]) -> DataFrame:
    """All columns of ``df`` and ``added`` (name: type) ones, computed batch by batch without a shuffle.

    ``run`` yields lists of arrays, the batch's columns and the added ones.  It sees columns by
    position, as names with dots in them can't be told to Spark's own map.
    """
    kinds = [*(f.dataType.simpleString() for f in df.schema.fields), *added.values()]
    names = [f"c{i}" for i in range(len(kinds))]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in run(batches):
            yield pa.RecordBatch.from_arrays(columns, names)

    plain = df.toDF(*names[: len(df.columns)])
    return plain.mapInArrow(rows, ", ".join(map(" ".join, zip(names, kinds, strict=True)))).toDF(*df.columns, *added)
