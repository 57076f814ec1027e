"""What a statement returns."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import DataFrame

from tidemark.errors import SchemaError, TidemarkError
from tidemark.operators.relation import Relation


def engine_error(e: Exception) -> TidemarkError:
    """Spark's run-time errors of our own raise_error, and overflows, as schema errors."""
    text = str(e)
    for mark in ("USER_RAISED_EXCEPTION]", "ARITHMETIC_OVERFLOW]", "NUMERIC_VALUE_OUT_OF_RANGE", "CAST_OVERFLOW"):
        if mark in text:
            return SchemaError(text.split(mark, 1)[1].strip().splitlines()[0][:200])
    return TidemarkError(text.splitlines()[0][:300] if text else type(e).__name__)


@dataclass
class QueryResult:
    """Rows (lazy until read), a number of mutated rows, or done."""

    relation: Relation | None = None
    mutated: int | None = None
    #: Makes the relation in insertion order, for readers of rows; ``df`` has no order but that of ORDER BY.
    ordered: Callable[[], Relation] | None = None

    @property
    def kind(self) -> str:
        return "rows" if self.relation is not None else "done" if self.mutated is None else "mutated"

    @property
    def columns(self) -> list[str]:
        return list(self.relation.names) if self.relation is not None else []

    @property
    def df(self) -> DataFrame:
        """The rows as a DataFrame: a column of one kind under its own name, of several as a struct of kinds."""
        from pyspark.sql import functions as F

        out = []
        for own in self.relation.physical:
            parts = [F.col(p).alias(k) for k, p in own.items()]
            out.append(parts[0] if len(parts) == 1 else F.struct(*parts))
        return self.relation.df.select(*out).toDF(*self.relation.names)

    def iterate(self) -> Iterator[tuple]:
        """Rows one partition at a time: the driver never holds the whole result."""
        found = self.ordered() if self.ordered is not None else self.relation
        places, at = [], 0
        for own in found.physical:
            places.append(range(at, at + len(own)))
            at += len(own)
        columns = [p for own in found.physical for p in own.values()]
        try:
            for row in found.df.select(*columns).toLocalIterator():
                yield tuple(next((bytes(row[i]) if isinstance(row[i], bytearray) else row[i] for i in own if row[i] is not None), None) for own in places)
        except TidemarkError:
            raise
        except Exception as e:
            raise engine_error(e) from e

    def rows(self) -> list[tuple]:
        return list(self.iterate()) if self.relation is not None else []

    def to_json(self) -> str:
        if self.kind == "done":
            return json.dumps({"done": True})
        if self.kind == "mutated":
            return json.dumps({"mutated": self.mutated})
        return json.dumps({"columns": self.columns, "rows": [[json_value(v) for v in r] for r in self.rows()]}, ensure_ascii=False)


def json_value(v: object) -> object:
    return f"{v:.6f}" if isinstance(v, Decimal) else list(v) if isinstance(v, bytes) else v


def display(v: object) -> str:
    return "NULL" if v is None else f"{v:.6f}" if isinstance(v, Decimal) else f"<blob {len(v)} bytes>" if isinstance(v, bytes) else str(v)
