"""Row versions of a table: immutable Parquet segments and a log of deletions.

A version is ``_row_id, _tx_inserted`` and the physical columns of its values.  Small
writes gather in a bounded list on the driver and become one segment when flushed;
bulk writes become segments directly.  A snapshot at tx T is the versions with
``_tx_inserted <= T`` without those that the log deletes at or before T.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.predicates import kind_of
from tidemark.operators.relation import TYPES, Relation
from tidemark.plans import ast

#: So many deletions are broadcast at most; more are joined by shuffle.
BROADCAST_DELETIONS = 500_000


@dataclass
class Table:
    name: str
    columns: list[str]
    kinds: list[list[str]] = field(default_factory=list)
    indexes: list[str] = field(default_factory=list)
    #: For each indexed column, the index folder of each segment.
    indexed: dict[str, dict[str, str]] = field(default_factory=dict)
    segments: list[str] = field(default_factory=list)
    deletions: list[str] = field(default_factory=list)
    n_deleted: int = 0
    next_row: int = 1
    rows: list[tuple[int, int, tuple[ast.Value, ...]]] = field(default_factory=list)
    gone: list[tuple[int, int]] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.kinds = self.kinds or [[] for _ in self.columns]

    # -- catalog form
    def manifest(self) -> dict:
        return {"name": self.name, "columns": self.columns, "kinds": self.kinds, "indexes": self.indexes, "indexed": self.indexed, "segments": self.segments, "deletions": self.deletions, "n_deleted": self.n_deleted, "next_row": self.next_row}

    def see(self, values: tuple[ast.Value, ...]) -> None:
        for kinds, v in zip(self.kinds, values, strict=True):
            k = kind_of(v)
            if k is not None and k not in kinds:
                kinds.append(k)
                kinds.sort(key="idtb".index)

    def physical(self) -> list[dict[str, str]]:
        """Names in storage are by place: a column name may be anything, and may repeat."""
        return [{k: f"c{i}__{k}" for k in kinds or ["i"]} for i, kinds in enumerate(self.kinds)]

    def schema(self) -> str:
        cells = [f"{p} {TYPES[k]}" for own in self.physical() for k, p in own.items()]
        return ", ".join(["_row_id bigint", "_tx_inserted bigint", *cells])

    def local(self, spark: SparkSession) -> DataFrame:
        flat = [(r, tx, *[v if kind_of(v) == k else None for own, v in zip(self.physical(), values, strict=True) for k in own]) for r, tx, values in self.rows]
        return spark.createDataFrame(flat, self.schema())

    def versions(self, spark: SparkSession) -> DataFrame:
        stored = spark.read.schema(self.schema()).parquet(*self.segments) if self.segments else None
        if stored is None:
            return self.local(spark)
        return stored.unionAll(self.local(spark)) if self.rows else stored

    def deleted(self, spark: SparkSession) -> DataFrame | None:
        schema = "_row_id bigint, _tx_deleted bigint"
        stored = spark.read.schema(schema).parquet(*self.deletions) if self.deletions else None
        local = spark.createDataFrame(self.gone, schema) if self.gone else None
        return stored.unionAll(local) if stored is not None and local is not None else stored if stored is not None else local

    def snapshot(self, spark: SparkSession, tx: int | None, versions: DataFrame | None = None) -> Relation:
        """What is visible at ``tx``, of all versions or of those given."""
        df, gone = self.versions(spark) if versions is None else versions, self.deleted(spark)
        if tx is not None:
            df = df.where(F.col("_tx_inserted") <= tx)
            gone = gone.where(F.col("_tx_deleted") <= tx) if gone is not None else None
        if gone is not None:
            gone = gone.select("_row_id")
            small = self.n_deleted + len(self.gone) <= BROADCAST_DELETIONS
            df = df.join(F.broadcast(gone) if small else gone, "_row_id", "left_anti")
        return Relation(df, list(self.columns), self.physical(), "_row_id")

    def flush(self, spark: SparkSession, path: str, files) -> bool:
        """Write what is gathered; the caller commits the catalog afterwards."""
        changed = bool(self.rows or self.gone)
        if self.rows:
            at = f"{path}/data/{len(self.segments)}-{self.rows[0][1]}-{self.rows[-1][1]}-{self.rows[0][0]}"
            self.local(spark).coalesce(1).write.mode("overwrite").parquet(at)
            self.segments.append(at)
            self.rows = []
        if self.gone:
            at = f"{path}/deletes/{len(self.deletions)}-{self.gone[0][1]}-{self.gone[-1][1]}"
            spark.createDataFrame(self.gone, "_row_id bigint, _tx_deleted bigint").coalesce(1).write.mode("overwrite").parquet(at)
            self.deletions.append(at)
            self.n_deleted += len(self.gone)
            self.gone = []
        return changed

    def compact(self, spark: SparkSession, path: str) -> None:
        """One set of segments, laid out by the first index: its statistics then prune the scan."""
        df = self.versions(spark)
        index = next((i for i, c in enumerate(self.columns) if c in self.indexes), None)
        at = f"{path}/data/compacted-{self.next_row}-{len(self.segments)}"
        by = [F.col(p) for p in self.physical()[index].values()] if index is not None else [F.col("_row_id")]
        writer = df.repartitionByRange(*by).sortWithinPartitions(*by).write.mode("overwrite")
        for p in [*self.physical()[index].values(), "_row_id"] if index is not None else []:
            writer = writer.option(f"parquet.bloom.filter.enabled#{p}", "true")
        writer.parquet(at)
        self.segments, self.rows, self.indexed = [at], [], {}
