"""The statements of the dialect: the only plan we make; Catalyst makes the others."""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

Value = None | int | Decimal | str | bytes
AGGREGATES = ("count", "sum", "min", "max", "avg")


@dataclass(frozen=True)
class Compare:
    column: str
    op: str  # = != < <= > >= like not_like
    value: Value


@dataclass(frozen=True)
class InList:
    column: str
    values: tuple[Value, ...]
    negated: bool = False


@dataclass(frozen=True)
class Between:
    column: str
    low: Value
    high: Value
    negated: bool = False


@dataclass(frozen=True)
class IsNull:
    column: str
    negated: bool = False


@dataclass(frozen=True)
class And:
    left: Predicate
    right: Predicate


@dataclass(frozen=True)
class Or:
    left: Predicate
    right: Predicate


Predicate = Compare | InList | Between | IsNull | And | Or


@dataclass(frozen=True)
class Aggregate:
    func: str
    column: str | None = None

    @property
    def label(self) -> str:
        return "count" if self.column is None else f"{self.func}({self.column})"


@dataclass(frozen=True)
class Item:
    expr: str | Aggregate
    alias: str | None = None

    @property
    def name(self) -> str:
        return self.alias or (self.expr if isinstance(self.expr, str) else self.expr.label)


@dataclass(frozen=True)
class HavingCompare:
    term: str | Aggregate
    op: str
    value: Value


@dataclass(frozen=True)
class OrderKey:
    column: str
    descending: bool = False


@dataclass(frozen=True)
class Select:
    table: str
    items: tuple[Item, ...] | None = None  # none: all columns
    distinct: bool = False
    where: Predicate | None = None
    group_by: tuple[str, ...] = ()
    having: object | None = None
    before: int | None = None
    order_by: tuple[OrderKey, ...] = ()
    limit: int | None = None


@dataclass(frozen=True)
class CreateTable:
    table: str
    columns: tuple[str, ...]


@dataclass(frozen=True)
class CreateIndex:
    table: str
    column: str


@dataclass(frozen=True)
class DropTable:
    table: str


@dataclass(frozen=True)
class Insert:
    table: str
    values: tuple[Value, ...]


@dataclass(frozen=True)
class Update:
    table: str
    column: str
    value: Value
    where: Predicate


@dataclass(frozen=True)
class Delete:
    table: str
    where: Predicate


Statement = Select | CreateTable | CreateIndex | DropTable | Insert | Update | Delete
