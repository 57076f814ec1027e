"""Opening an artifact by ranges: two reads to open it, then what each query needs.

Members are Parquet files inside of the artifact.  A query reads their footers, and of the
row groups whose statistics and transactions it can't rule out, the chunks of the columns
it names.  The reader is an object of the driver, so that the chunks pass through it, one
member at a time; they are written to the shared folder, where Spark reads them.
"""

from __future__ import annotations

import hashlib
import io
import json
from dataclasses import replace
from typing import Protocol

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import SparkSession

from tidemark.database import Database
from tidemark.errors import CorruptionError, IoError
from tidemark.operators.relation import Relation
from tidemark.plans import ast
from tidemark.sources.artifact import HEADER, catalog, header
from tidemark.sources.files import scratch
from tidemark.sources.indexes import conjuncts
from tidemark.sources.versions import Table


class RangeReader(Protocol):
    def read_at(self, offset: int, length: int) -> bytes: ...


class BytesReader:
    """A reader of bytes at hand that counts its reads."""

    def __init__(self, data: bytes):
        self.data, self.reads = data, []

    def read_at(self, offset: int, length: int) -> bytes:
        self.reads.append((offset, length))
        return self.data[offset : offset + length]


class _Member(io.RawIOBase):
    """A range of the artifact as a file of its own."""

    def __init__(self, reader: RangeReader, offset: int, length: int):
        self.reader, self.offset, self.length, self.at = reader, offset, length, 0

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def seek(self, offset: int, whence: int = 0) -> int:
        self.at = offset + (0, self.at, self.length)[whence]
        return self.at

    def tell(self) -> int:
        return self.at

    def read(self, n: int = -1) -> bytes:
        n = min(n if n >= 0 else self.length, self.length - self.at)
        data = self.reader.read_at(self.offset + self.at, n) if n > 0 else b""
        self.at += len(data)
        return data


def needed(q: ast.Select | None) -> set[str] | None:
    """The columns that a statement names, or none for all of them."""
    if q is None or q.items is None:
        return None
    found = {k.column for k in q.order_by} | set(q.group_by)

    def visit(p: object) -> None:
        if isinstance(p, ast.And | ast.Or):
            visit(p.left)
            visit(p.right)
        elif p is not None:
            term = getattr(p, "column", None) or getattr(p, "term", None)
            found.add(term.column if isinstance(term, ast.Aggregate) else term)

    visit(q.where)
    visit(q.having)
    found |= {i.expr.column if isinstance(i.expr, ast.Aggregate) else i.expr for i in q.items}
    return found - {None}


def _outside(low: object, high: object, p: ast.Predicate) -> bool:
    """Whether no value from low to high satisfies a comparison."""
    bounds = {"=": (p.value, p.value), "<": (None, p.value), "<=": (None, p.value), ">": (p.value, None), ">=": (p.value, None)} if isinstance(p, ast.Compare) else {}
    first, last = bounds.get(getattr(p, "op", None), (None, None)) if isinstance(p, ast.Compare) else (p.low, p.high)
    alike = lambda v: type(v) is type(low) and isinstance(v, int | str)
    return (alike(first) and high < first) or (alike(last) and low > last)


class StreamedDatabase(Database):
    def __init__(self, spark: SparkSession, root: str, reader: RangeReader, members: dict):
        super().__init__(spark, root, writable=False)
        self.reader, self.members = reader, members
        self.fetched: dict[tuple, list[str]] = {}
        #: Row groups that were read, and that statistics ruled out.
        self.groups_read = self.groups_skipped = 0

    def _of(self, folder: str) -> list[tuple[str, dict]]:
        return [(name, m) for name, m in self.members.items() if f"{self.root}/{name}".startswith(folder + "/")]

    def relation(self, name: str, before: int | None = None, statement: ast.Select | None = None) -> Relation:
        if name not in self.tables:
            return super().relation(name, before, statement)
        t = self.table(name)
        columns = needed(statement)
        for folder in t.deletions:
            self._whole(folder)
        for c in columns or ():
            if c not in t.columns:
                columns = None  # an error of the statement, told by its compiler
        wanted = [p for c, own in zip(t.columns, t.physical(), strict=True) if columns is None or c in columns for p in own.values()]
        segments = [s for folder in t.segments for s in self._chunks(t, folder, wanted, before, statement.where if statement is not None else None)]
        here = replace(t, segments=segments, rows=[])
        return here.snapshot(self.spark, before)

    def _whole(self, folder: str) -> None:
        """A folder of deletions, which every snapshot needs."""
        for name, m in self._of(folder):
            if (name,) not in self.fetched:
                data = self.reader.read_at(m["offset"], m["length"])
                if hashlib.sha256(data).hexdigest() != m["sha256"]:
                    raise CorruptionError(f"member {name} fails its checksum")
                self.files.write(f"{self.root}/{name}", data)
                self.fetched[(name,)] = []

    def _chunks(self, t: Table, folder: str, wanted: list[str], before: int | None, where: ast.Predicate | None) -> list[str]:
        """Folders with the chunks that a query needs of a segment's members."""
        out = []
        for name, m in self._of(folder):
            try:
                file = pq.ParquetFile(pa.PythonFile(_Member(self.reader, m["offset"], m["length"]), mode="r"), page_checksum_verification=True)
            except (pa.ArrowException, OSError) as e:
                raise CorruptionError(f"member {name} can't be read: {e}") from e
            groups = [g for g in range(file.metadata.num_row_groups) if not self._ruled_out(t, file, g, before, where)]
            self.groups_skipped += file.metadata.num_row_groups - len(groups)
            key = (name, tuple(wanted), tuple(groups))
            if key not in self.fetched:
                self.groups_read += len(groups)
                self.fetched[key] = []
                if groups:
                    have = [c for c in ("_row_id", "_tx_inserted", *wanted) if c in file.schema_arrow.names]
                    at = f"{self.root}/chunks-{len(self.fetched)}"
                    self._copy(file, groups, have, f"{at}/part-00000.parquet", name)
                    self.fetched[key] = [at]
            out += self.fetched[key]
        return out

    def _copy(self, file: pq.ParquetFile, groups: list[int], columns: list[str], to: str, name: str) -> None:
        sink = io.BytesIO()
        try:
            first = file.read_row_group(groups[0], columns=columns)
            with pq.ParquetWriter(sink, first.schema) as writer:
                writer.write_table(first)
                for g in groups[1:]:
                    writer.write_table(file.read_row_group(g, columns=columns))
        except (pa.ArrowException, OSError) as e:
            raise CorruptionError(f"member {name} can't be read: {e}") from e
        self.files.write(to, sink.getvalue())

    @staticmethod
    def _ruled_out(t: Table, file: pq.ParquetFile, group: int, before: int | None, where: ast.Predicate | None) -> bool:
        meta = file.metadata.row_group(group)
        spans = {}
        for i in range(meta.num_columns):
            stats = meta.column(i).statistics
            if stats is not None and stats.has_min_max:
                spans[meta.column(i).path_in_schema] = (stats.min, stats.max)
        if before is not None and "_tx_inserted" in spans and spans["_tx_inserted"][0] > before:
            return True
        for p in conjuncts(where):
            if not isinstance(p, ast.Compare | ast.Between) or getattr(p, "negated", False) or p.column not in t.columns:
                continue
            own = list(t.physical()[t.columns.index(p.column)].values())
            if len(own) == 1 and own[0] in spans and _outside(*spans[own[0]], p):
                return True
        return False


def open_streamed(spark: SparkSession, reader: RangeReader, size: int) -> StreamedDatabase:
    try:
        offset, length = header(reader.read_at(0, HEADER.size), size)
        found, members = catalog(reader.read_at(offset, length), offset)
    except OSError as e:
        raise IoError(str(e)) from e
    db = StreamedDatabase(spark, scratch(spark, "streamed"), reader, members)
    db.load(json.dumps(found).encode())
    return db
