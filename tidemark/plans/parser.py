"""Recursive descent over the tokens of one statement."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from decimal import Decimal

from tidemark.errors import QueryError
from tidemark.plans import ast
from tidemark.plans.lexer import I64, Token, error_at, tokenize

RESERVED = frozenset("from where group having order before limit by as and or select distinct".split())
COMPARISONS = ("=", "!=", "<", "<=", ">", ">=")


class Parser:
    def __init__(self, sql: str, params: Sequence[ast.Value] | None = None):
        self.sql, self.tokens, self.at = sql, tokenize(sql), 0
        marks = sum(t.kind == "symbol" and t.value == "?" for t in self.tokens)
        given = list(params or ())
        if params is not None and marks != len(given):
            raise QueryError(f"statement has {marks} parameters, {len(given)} values were given")
        self.given = iter([bound(v) for v in given])

    # -- cursor
    def peek(self, ahead: int = 0) -> Token:
        return self.tokens[min(self.at + ahead, len(self.tokens) - 1)]

    def next(self) -> Token:
        token = self.peek()
        self.at += 1
        return token

    def fail(self, token: Token, message: str) -> QueryError:
        return error_at(self.sql, token.at, message)

    def is_word(self, word: str, ahead: int = 0) -> bool:
        t = self.peek(ahead)
        return t.kind == "word" and t.value.lower() == word

    def is_symbol(self, symbol: str, ahead: int = 0) -> bool:
        t = self.peek(ahead)
        return t.kind == "symbol" and t.value == symbol

    def accept(self, word: str) -> bool:
        found = self.is_word(word)
        self.at += found
        return found

    def keyword(self, word: str) -> None:
        if not self.accept(word):
            raise self.fail(self.peek(), f"expected {word.upper()}, found {self.peek()}")

    def symbol(self, symbol: str) -> None:
        if not self.is_symbol(symbol):
            raise self.fail(self.peek(), f"expected `{symbol}`, found {self.peek()}")
        self.at += 1

    def name(self) -> str:
        t = self.next()
        if t.kind != "word":
            raise self.fail(t, f"expected a name, found {t}")
        return t.value

    def value(self) -> ast.Value:
        t = self.next()
        if t.kind in ("int", "decimal", "text"):
            return t.value
        if t.kind == "word" and t.value.lower() == "null":
            return None
        if t.kind == "symbol" and t.value == "?":
            try:
                return next(self.given)
            except StopIteration:
                raise self.fail(t, "a parameter without a value") from None
        raise self.fail(t, f"expected a value, found {t}")

    def listed(self, one: Callable) -> list:
        found = [one()]
        while self.is_symbol(","):
            self.at += 1
            found.append(one())
        return found

    # -- statements
    def statement(self) -> ast.Statement:
        t = self.next()
        word = t.value.lower() if t.kind == "word" else None
        kinds = {"select": self.select, "insert": self.insert, "update": self.update, "delete": self.delete, "create": self.create, "drop": self.drop}
        if word not in kinds:
            raise self.fail(t, f"expected SELECT, INSERT, UPDATE, DELETE, CREATE or DROP, found {t}")
        out = kinds[word]()
        if self.peek().kind != "end":
            raise self.fail(self.peek(), f"unexpected {self.peek()} after the statement")
        return out

    def create(self) -> ast.Statement:
        if self.accept("table"):
            table = self.name()
            self.symbol("(")
            columns = self.listed(self.name)
            self.symbol(")")
            return ast.CreateTable(table, tuple(columns))
        if self.accept("index"):
            self.keyword("on")
            table = self.name()
            self.symbol("(")
            column = self.name()
            self.symbol(")")
            return ast.CreateIndex(table, column)
        raise self.fail(self.peek(), f"expected TABLE or INDEX, found {self.peek()}")

    def drop(self) -> ast.Statement:
        self.keyword("table")
        return ast.DropTable(self.name())

    def insert(self) -> ast.Statement:
        self.keyword("into")
        table = self.name()
        self.keyword("values")
        self.symbol("(")
        values = self.listed(self.value)
        self.symbol(")")
        return ast.Insert(table, tuple(values))

    def update(self) -> ast.Statement:
        table = self.name()
        self.keyword("set")
        column = self.name()
        self.symbol("=")
        value = self.value()
        self.keyword("where")
        return ast.Update(table, column, value, self.predicate())

    def delete(self) -> ast.Statement:
        self.keyword("from")
        table = self.name()
        self.keyword("where")
        return ast.Delete(table, self.predicate())

    def select(self) -> ast.Select:
        distinct = self.is_word("distinct") and not self.is_symbol(",", 1) and not self.is_word("from", 1)
        self.at += distinct
        items = None
        if self.is_symbol("*"):
            self.at += 1
        else:
            items = tuple(self.listed(self.item))
        self.keyword("from")
        table = self.name()
        where = self.predicate() if self.accept("where") else None
        group: list[str] = []
        if self.accept("group"):
            self.keyword("by")
            group = self.listed(self.name)
        having = self.either(self.having_one) if self.accept("having") else None
        before = self.count("BEFORE") if self.accept("before") else None
        order: list[ast.OrderKey] = []
        if self.accept("order"):
            self.keyword("by")
            order = self.listed(self.order_key)
        limit = self.count("LIMIT") if self.accept("limit") else None
        return ast.Select(table, items, bool(distinct), where, tuple(group), having, before, tuple(order), limit)

    def count(self, clause: str) -> int:
        t = self.next()
        if t.kind == "int" and t.value >= 0:
            return t.value
        if t.kind == "symbol" and t.value == "?":
            self.at -= 1
            value = self.value()
            if isinstance(value, int) and value >= 0:
                return value
        raise self.fail(t, f"{clause} expects a non-negative integer, found {t}")

    def is_aggregate(self) -> bool:
        t = self.peek()
        return t.kind == "word" and t.value.lower() in ast.AGGREGATES and self.is_symbol("(", 1)

    def aggregate(self) -> ast.Aggregate:
        t = self.next()
        func = t.value.lower()
        self.symbol("(")
        column = None
        if self.is_symbol("*"):
            self.at += 1
            if func != "count":
                raise self.fail(t, f"{func.upper()} needs a column; only COUNT takes `*`")
        else:
            column = self.name()
        self.symbol(")")
        return ast.Aggregate(func, column)

    def item(self) -> ast.Item:
        expr = self.aggregate() if self.is_aggregate() else self.name()
        alias = None
        if self.accept("as"):
            t = self.peek()
            alias = self.name()
            if alias.lower() in RESERVED:
                raise self.fail(t, f"expected a name after AS, found keyword {t}")
        return ast.Item(expr, alias)

    def order_key(self) -> ast.OrderKey:
        column = self.name()
        descending = self.accept("desc")
        if not descending:
            self.accept("asc")
        return ast.OrderKey(column, descending)

    # -- predicates
    def either(self, one: Callable):
        left = self.both(one)
        while self.accept("or"):
            left = ast.Or(left, self.both(one))
        return left

    def both(self, one: Callable):
        left = self.unit(one)
        while self.accept("and"):
            left = ast.And(left, self.unit(one))
        return left

    def unit(self, one: Callable):
        depth = self.at
        if self.is_symbol("("):
            if depth - self.opened > 400:
                raise self.fail(self.peek(), "predicate is nested too deeply")
            self.at += 1
            inner = self.either(one)
            self.symbol(")")
            return inner
        self.opened = self.at
        return one()

    opened = 0

    def predicate(self) -> ast.Predicate:
        return self.either(self.one)

    def having_one(self) -> ast.HavingCompare:
        term = self.aggregate() if self.is_aggregate() else self.name()
        t = self.next()
        if t.kind != "symbol" or t.value not in COMPARISONS:
            raise self.fail(t, f"expected a comparison, found {t}")
        return ast.HavingCompare(term, t.value, self.value())

    def one(self) -> ast.Predicate:
        column = self.name()
        if self.accept("is"):
            negated = self.accept("not")
            self.keyword("null")
            return ast.IsNull(column, negated)
        negated = self.accept("not")
        if self.accept("in"):
            self.symbol("(")
            values = self.listed(self.value)
            self.symbol(")")
            return ast.InList(column, tuple(values), negated)
        if self.accept("between"):
            low = self.value()
            self.keyword("and")
            return ast.Between(column, low, self.value(), negated)
        if self.accept("like"):
            return ast.Compare(column, "not_like" if negated else "like", self.value())
        t = self.next()
        if negated or t.kind != "symbol" or t.value not in COMPARISONS:
            raise self.fail(t, f"expected a comparison, found {t}" if not negated else f"expected IN, BETWEEN or LIKE after NOT, found {t}")
        return ast.Compare(column, t.value, self.value())


def bound(value: object) -> ast.Value:
    """A parameter as a value: booleans are 0 or 1, floats become decimals of scale 6; bytes can't be bound."""
    if value is None or isinstance(value, str):
        return value
    if isinstance(value, bool):
        return int(value)
    if isinstance(value, int):
        if not I64[0] <= value <= I64[1]:
            raise QueryError("integer parameter out of range")
        return value
    if isinstance(value, float):
        scaled = value * 1e6
        if not abs(scaled) < 1.7e38:
            raise QueryError("number parameter out of range")
        return int(value) if value == int(value) and abs(value) < 2**53 else Decimal(round(scaled)).scaleb(-6)
    if isinstance(value, Decimal):
        if not value.is_finite() or abs(value) >= Decimal(10) ** 32:
            raise QueryError("decimal parameter out of range")
        return value.quantize(Decimal("0.000001"), rounding="ROUND_DOWN")
    raise QueryError(f"cannot bind a parameter of type {type(value).__name__}")


def parse(sql: str, params: Sequence[object] | None = None) -> ast.Statement:
    try:
        return Parser(sql, params).statement()
    except RecursionError:
        raise QueryError("statement is nested too deeply") from None
