"""A logical table: names, and for each the physical columns of its kinds."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.errors import SchemaError

TYPES = {"i": "bigint", "d": "decimal(38,6)", "t": "string", "b": "binary"}
_EXTERNAL = {"tinyint": "i", "smallint": "i", "int": "i", "bigint": "i", "boolean": "i", "string": "t", "binary": "b", "float": "d", "double": "d", "timestamp": "i", "timestamp_ntz": "i", "date": "i"}


@dataclass
class Relation:
    df: DataFrame
    names: list[str]
    physical: list[dict[str, str]]
    row_id: str | None = None
    hidden: list[str] = field(default_factory=list)

    def kinds(self, index: int) -> dict[str, Column]:
        return {k: F.col(p) for k, p in self.physical[index].items()}

    def find(self, name: str) -> int:
        """The first column of that name."""
        try:
            return self.names.index(name)
        except ValueError:
            raise SchemaError(f"no such column: {name}") from None

    def resolve(self, name: str) -> dict[str, Column]:
        return self.kinds(self.find(name))


def external(df: DataFrame) -> Relation:
    """A typed DataFrame as a table of single-kind columns; predicates on them reach its scan.

    Integers and texts stay as they are, which keeps pushdown; doubles are read as
    decimals of scale 6, dates and timestamps as integers (days, microseconds).
    """
    columns, physical, names = [], [], []
    for i, f in enumerate(df.schema.fields):
        kind, source = f.dataType.simpleString(), F.col(f"`{f.name}`")
        k = _EXTERNAL.get(kind) or ("d" if kind.startswith("decimal") else None)
        if k is None:
            continue  # arrays, maps and structs have no kind
        if kind in ("timestamp", "timestamp_ntz"):
            source = F.unix_micros(source.cast("timestamp"))
        elif kind == "date":
            source = F.unix_date(source)
        columns.append((source if kind == TYPES[k] else source.cast(TYPES[k])).alias(f"c{i}__{k}"))
        physical.append({k: f"c{i}__{k}"})
        names.append(f.name)
    return Relation(df.select(*columns), names, physical)
