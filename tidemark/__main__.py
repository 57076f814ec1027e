"""python -m tidemark [path]: a prompt. .tables .help .exit"""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from tidemark.database import Database
from tidemark.errors import TidemarkError
from tidemark.result import QueryResult, display


def table_text(result: QueryResult) -> str:
    if result.kind != "rows":
        return "ok" if result.kind == "done" else f"{result.mutated} row(s)"
    cells = [result.columns, *[[display(v) for v in r] for r in result.iterate()]]
    widths = [max(len(r[i]) for r in cells) for i in range(len(cells[0]))]
    lines = [" | ".join(c.ljust(w) for c, w in zip(r, widths, strict=True)).rstrip() for r in cells]
    return "\n".join([lines[0], "-+-".join("-" * w for w in widths), *lines[1:], f"({len(cells) - 1} rows)"])


def answer(db: Database, line: str) -> str | None:
    """The text for one line, or none to leave."""
    line = line.strip()
    if line in (".exit", ".quit"):
        return None
    if line == ".tables":
        return "\n".join(db.table_names())
    if line == ".help":
        return ".tables  list tables\n.exit    leave\nanything else is a statement"
    if not line:
        return ""
    try:
        return table_text(db.query(line))
    except TidemarkError as e:
        return f"error: {e}"


def main(argv: list[str]) -> None:
    spark = SparkSession.builder.getOrCreate()
    db = Database.dev(spark, argv[0]) if argv else Database.memory(spark)
    while True:
        try:
            out = answer(db, input("tidemark> "))
        except EOFError:
            break
        if out is None:
            break
        if out:
            print(out)
    db.close()


if __name__ == "__main__":
    main(sys.argv[1:])
