"""Secondary indexes: the values of one column over all versions, sorted, a folder for each segment.

A table can have several.  Each folder holds the value's physical columns and ``_row_id``,
range-sorted by value and with bloom filters, so that a point or range lookup reads few row
groups of it; the rows themselves are then read by id, and the statistics of ids prune that
scan.  Segments without a folder yet, and rows still on the driver, are scanned as they are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.predicates import compile_predicate
from tidemark.operators.relation import TYPES
from tidemark.operators.select import sort_columns
from tidemark.plans import ast

#: More matches than that are not worth a lookup: the table is scanned.
MOST_IDS = 1000


class Index:
    def __init__(self, spark: SparkSession, table, column: str):
        self.spark, self.table, self.column = spark, table, column
        self.physical: dict[str, str] = table.physical()[table.columns.index(column)]

    # -- building
    def build(self, path: str) -> None:
        """Folders for the segments that have none."""
        have = self.table.indexed.setdefault(self.column, {})
        for n, segment in enumerate(self.table.segments):
            if segment not in have:
                at = f"{path}/index-{self.table.columns.index(self.column)}-{n}-{self.table.next_row}"
                self._write(self._values(segment), at)
                have[segment] = at

    def _values(self, segment: str) -> DataFrame:
        return self.spark.read.schema(self.table.schema()).parquet(segment).select(*self.physical.values(), "_row_id")

    def _write(self, values: DataFrame, at: str) -> None:
        by = [F.col(p) for p in self.physical.values()]
        writer = values.repartitionByRange(*by).sortWithinPartitions(*by, "_row_id").write.mode("overwrite")
        for p in self.physical.values():
            writer = writer.option(f"parquet.bloom.filter.enabled#{p}", "true")
        writer.parquet(at)

    # -- reading
    def entries(self) -> DataFrame:
        """(value columns, _row_id) of all versions in segments that have a folder."""
        schema = ", ".join([*(f"{p} {TYPES[k]}" for k, p in self.physical.items()), "_row_id bigint"])
        folders = list(self.table.indexed.get(self.column, {}).values())
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def _kinds(self) -> dict[str, Column]:
        return {k: F.col(p) for k, p in self.physical.items()}

    def where(self, predicate: ast.Predicate) -> DataFrame:
        return self.entries().where(compile_predicate(predicate, lambda _: self._kinds()))

    def ids(self, predicate: ast.Predicate, most: int = MOST_IDS) -> list[int] | None:
        """The row ids that match, or none if there are more than ``most``."""
        found = self.where(predicate).select("_row_id").limit(most + 1).collect()
        return sorted(r[0] for r in found) if len(found) <= most else None

    def lookup(self, value: ast.Value) -> DataFrame:
        return self.where(ast.Compare(self.column, "=", value)).select("_row_id")

    def range(self, low: ast.Value, high: ast.Value) -> DataFrame:
        return self.where(ast.Between(self.column, low, high)).select("_row_id")

    def ordered_addresses(self, descending: bool = False) -> DataFrame:
        """Row ids in order of value, equal ones in order of id."""
        by = [c.desc_nulls_last() if descending else c.asc_nulls_first() for c in sort_columns(self._kinds())]
        return self.entries().orderBy(*by, "_row_id").select("_row_id")

    def distinct_keys(self) -> int:
        return self.entries().select(*self.physical.values()).distinct().count()

    def __len__(self) -> int:
        return self.entries().count()

    def pairs(self) -> DataFrame:
        """(value, _row_id); a value of several kinds is a struct of them."""
        parts = [F.col(p).alias(k) for k, p in self.physical.items()]
        return self.entries().select((parts[0] if len(parts) == 1 else F.struct(*parts)).alias("value"), "_row_id")


def conjuncts(p: ast.Predicate | None) -> list[ast.Predicate]:
    if p is None:
        return []
    return [*conjuncts(p.left), *conjuncts(p.right)] if isinstance(p, ast.And) else [p]


def _selective(p: ast.Predicate) -> bool:
    match p:
        case ast.Compare(_, op, _):
            return op in ("=", "<", "<=", ">", ">=")
        case ast.InList(_, _, negated) | ast.Between(_, _, _, negated):
            return not negated
    return False


def narrowed(spark: SparkSession, table, where: ast.Predicate | None) -> DataFrame | None:
    """The versions that a condition on an indexed column leaves, or none where no index helps.

    The whole condition is applied again afterwards.
    """
    for p in conjuncts(where):
        if not _selective(p) or not table.indexed.get(p.column):
            continue
        ids = Index(spark, table, p.column).ids(p)
        if ids is None:
            continue
        have = table.indexed[p.column]
        stored = [s for s in table.segments if s in have]
        rest = [s for s in table.segments if s not in have]
        read = lambda paths: spark.read.schema(table.schema()).parquet(*paths)
        parts = [read(stored).where(F.col("_row_id").isin(ids) if ids else F.lit(False))] if stored else []
        parts += [read(rest)] if rest else []
        parts += [table.local(spark)] if table.rows else []
        return reduce(DataFrame.unionAll, parts) if parts else None
    return None
