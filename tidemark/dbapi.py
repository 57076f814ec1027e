"""DB-API 2.0 (PEP 249), and prepared statements with run / get / all / iterate."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import SparkSession

from tidemark import errors
from tidemark.database import Database
from tidemark.plans.parser import parse

apilevel, threadsafety, paramstyle = "2.0", 1, "qmark"


class Warning(Exception):  # noqa: A001, N818
    pass


Error = errors.TidemarkError


class InterfaceError(Error):
    pass


DatabaseError = OperationalError = ProgrammingError = DataError = IntegrityError = InternalError = Error


class NotSupportedError(Error):
    pass


def connect(target: str = "memory", spark: SparkSession | None = None) -> Connection:
    """``memory``, ``dev:path``, ``prod:path``, or a path: a workspace folder."""
    spark = spark or SparkSession.builder.getOrCreate()
    kind, _, path = target.partition(":")
    if target in ("memory", ":memory:"):
        return Connection(Database.memory(spark))
    if kind == "prod" and path:
        return Connection(Database.prod(spark, path))
    return Connection(Database.dev(spark, path if kind == "dev" and path else target))


class Connection:
    def __init__(self, db: Database):
        self.db: Database | None = db

    def _open(self) -> Database:
        if self.db is None:
            raise InterfaceError("the connection is closed")
        return self.db

    def cursor(self) -> Cursor:
        self._open()
        return Cursor(self)

    def execute(self, sql: str, params: Sequence[object] = ()) -> Cursor:
        return self.cursor().execute(sql, params)

    def prepare(self, sql: str) -> Prepared:
        return Prepared(self._open(), sql)

    def commit(self) -> None:
        """Statements commit by themselves; this writes what is gathered."""
        self._open()

    def rollback(self) -> None:
        self._open()

    def close(self) -> None:
        if self.db is not None:
            self.db.close()
        self.db = None

    def __enter__(self) -> Connection:
        return self

    def __exit__(self, *_) -> None:
        self.close()


class Cursor:
    arraysize = 1

    def __init__(self, connection: Connection):
        self.connection, self.description, self.rowcount = connection, None, -1
        self._rows: Iterator[tuple] | None = None

    def execute(self, sql: str, params: Sequence[object] = ()) -> Cursor:
        out = self.connection._open().query(sql, list(params))
        self.description = [(c, None, None, None, None, None, None) for c in out.columns] if out.kind == "rows" else None
        self._rows = out.iterate() if out.kind == "rows" else None
        self.rowcount = out.mutated if out.mutated is not None else -1
        return self

    def executemany(self, sql: str, many: Sequence[Sequence[object]]) -> Cursor:
        """One flush for all."""
        db, total = self.connection._open(), 0
        before, db.autocommit = db.autocommit, False
        try:
            for params in many:
                total += db.query(sql, list(params)).mutated or 0
        finally:
            db.autocommit = before
        if db.persistent:
            db.flush_now()
        self.description, self._rows, self.rowcount = None, None, total
        return self

    def _have(self) -> Iterator[tuple]:
        if self._rows is None:
            raise InterfaceError("no rows: execute a SELECT first")
        return self._rows

    def fetchone(self) -> tuple | None:
        return next(self._have(), None)

    def fetchmany(self, size: int | None = None) -> list[tuple]:
        rows = self._have()
        return [r for _, r in zip(range(size or self.arraysize), rows, strict=False)]

    def fetchall(self) -> list[tuple]:
        return list(self._have())

    def __iter__(self) -> Iterator[tuple]:
        return self._have()

    def setinputsizes(self, *_) -> None:
        pass

    setoutputsize = setinputsizes

    def close(self) -> None:
        self._rows = None


class Prepared:
    """A statement that is read once for each set of values."""

    def __init__(self, db: Database, sql: str):
        self.db, self.sql = db, sql

    def run(self, *params: object) -> dict[str, int]:
        return {"changes": self.db.execute(parse(self.sql, params)).mutated or 0}

    def iterate(self, *params: object) -> Iterator[dict[str, object]]:
        out = self.db.execute(parse(self.sql, params))
        for row in out.iterate():
            yield dict(zip(out.columns, row, strict=True))

    def get(self, *params: object) -> dict[str, object] | None:
        return next(self.iterate(*params), None)

    def all(self, *params: object) -> list[dict[str, object]]:
        return list(self.iterate(*params))
