"""Tokens with places, and errors that point at them."""

from __future__ import annotations

import re
from dataclasses import dataclass
from decimal import Decimal

from tidemark.errors import QueryError

_NUMBER = re.compile(r"-?[0-9]+(?:\.[0-9]+)?")
_SYMBOLS = ("!=", "<>", "<=", ">=", "=", "<", ">", "(", ")", ",", "*", "?")
I64 = (-(1 << 63), (1 << 63) - 1)


@dataclass(frozen=True)
class Token:
    kind: str  # word int decimal text symbol end
    value: object
    at: int

    def __str__(self) -> str:
        return "end of statement" if self.kind == "end" else repr(self.value) if self.kind == "text" else f"`{self.value}`"


def error_at(sql: str, at: int, message: str) -> QueryError:
    """The message, its line and column (from 1), the line and a caret."""
    line = sql.count("\n", 0, at) + 1
    start = sql.rfind("\n", 0, at) + 1
    end = sql.find("\n", at)
    text = sql[start : end if end >= 0 else len(sql)]
    return QueryError(f"{message} (line {line}, column {at - start + 1})\n  {text}\n  {' ' * (at - start)}^")


def truncated(text: str) -> Decimal:
    """A decimal literal at scale 6: further digits are cut off, not rounded."""
    whole, _, part = text.partition(".")
    return Decimal(f"{whole}.{part[:6]:0<6}")


def tokenize(sql: str) -> list[Token]:
    out: list[Token] = []
    at = 0
    while at < len(sql):
        c = sql[at]
        if c.isspace() or c == ";":
            at += 1
        elif c == "'":
            end, parts = at + 1, []
            while True:
                close = sql.find("'", end)
                if close < 0:
                    raise error_at(sql, at, "unterminated string literal")
                parts.append(sql[end:close])
                if sql[close + 1 : close + 2] != "'":
                    break
                end = close + 2
            out.append(Token("text", "'".join(parts), at))
            at = close + 1
        elif m := _NUMBER.match(sql, at):
            if "." in m[0]:
                value = truncated(m[0])
                if len(value.as_tuple().digits) > 38:
                    raise error_at(sql, at, "decimal literal out of range")
                out.append(Token("decimal", value, at))
            else:
                if not I64[0] <= int(m[0]) <= I64[1]:
                    raise error_at(sql, at, "integer literal out of range")
                out.append(Token("int", int(m[0]), at))
            at = m.end()
        elif c.isalnum() or c == "_":
            end = at
            while end < len(sql) and (sql[end].isalnum() or sql[end] == "_"):
                end += 1
            out.append(Token("word", sql[at:end], at))
            at = end
        elif symbol := next((s for s in _SYMBOLS if sql.startswith(s, at)), None):
            out.append(Token("symbol", "!=" if symbol == "<>" else symbol, at))
            at += len(symbol)
        else:
            raise error_at(sql, at, f"unexpected character {c!r}")
    return [*out, Token("end", None, len(sql))]
