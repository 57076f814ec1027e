"""Row-at-a-time reading, in bounded memory."""

from __future__ import annotations

from collections.abc import Callable

from tidemark.result import QueryResult


def for_each_row(result: QueryResult, visit: Callable[[tuple], object]) -> int:
    n = 0
    for row in result.iterate():
        visit(row)
        n += 1
    return n
