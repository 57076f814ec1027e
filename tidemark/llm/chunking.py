"""Operator 3: substring dedup by content-defined chunking with a gear rolling hash.

A text is cut where the gear hash of its last 32 bytes has ``MASK_BITS`` zero bits on
top, at least ``LEAST`` and at most ``MOST`` bytes after the cut before: cuts depend on
content, so an insertion moves cuts near it only.  Chunks are compared by 128-bit
digest.  The first occurrence in order of (doc_id with nulls last, text hash, place)
stays; every later one is removed.  Only a text's last chunk can be shorter than
``LEAST``; where that is the one later chunk at its place (a full stop that another
text ends with too) it is no passage and stays, unless it is the whole text.

Two scans: the first only counts 64-bit hashes (a combinable aggregate) and leaves a
bitmap (see ``bitmaps``) of hashes that repeat; the second emits the digests of
chunks in it, which are counted exactly.  A chunk that a third of all documents hold
is one partial aggregate a task; no group is ever collected but a document's own
chunks.

Edge cases: null and empty texts have no chunk; rows that agree in doc_id and text are
one document written twice and get equal results; chunks of one document can repeat
each other; an empty table gives no rows; very long texts are cut in slices of whole
texts; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bitmaps import bitmap
from .common import cut, read, row_key, text_of
from .flat import flat, slices

MASK_BITS, LEAST, MOST = 5, 16, 1024
RUN = LEAST
_GEAR = np.random.default_rng(7).integers(0, 1 << 32, 256, dtype=np.uint64).astype(np.uint32)


def gear(data: np.ndarray) -> np.ndarray:
    """h[i] = sum of GEAR[data[i - k]] << k over the last 32 bytes, by doubling."""
    h, span = _GEAR[data], 1
    while span < 32:
        more = h.copy()
        more[span:] += h[:-span] << np.uint32(span)
        h, span = more, span * 2
    return h


def cuts(data: np.ndarray) -> list[int]:
    """Ends of the chunks of one text. The hash of its first 31 bytes is that of what there is."""
    n = len(data)
    ends, last = [], 0
    for at in (np.flatnonzero(gear(data) >> np.uint32(32 - MASK_BITS) == 0) + 1).tolist() if n else []:
        while at - last > MOST:
            last += MOST
            ends.append(last)
        if at - last >= LEAST:
            ends.append(at)
            last = at
    while n - last > MOST:
        last += MOST
        ends.append(last)
    return [*ends, n] if last < n else ends


def _texts(column: pa.Array) -> Iterator[tuple[int, np.ndarray, bytes]]:
    data, offsets = flat(column)
    for a, z in slices(offsets):
        raw = data[offsets[a] : offsets[z]].tobytes()
        base = offsets[a]
        for i in range(a, z):
            yield i, data[offsets[i] : offsets[i + 1]], raw[offsets[i] - base : offsets[i + 1] - base]


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[int] = []
        for _, data, raw in _texts(batch.column(0)):
            at = 0
            for end in cuts(data):
                out.append(xxhash.xxh3_64_intdigest(raw[at:end]))
                at = end
            if len(out) > 100_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.array(out, np.uint64).view(np.int64))], ["v"])
                out = []
        yield pa.RecordBatch.from_arrays([pa.array(np.array(out, np.uint64).view(np.int64))], ["v"])


def _chunks(bits):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = bits.value
        for batch in batches:
            rows: list[tuple[int, int, int, bytes]] = []

            def flush() -> pa.RecordBatch:
                where = pa.array([r[0] for r in rows], pa.int64())  # noqa: B023
                made = [batch.column(i).take(where) for i in range(3)]  # noqa: B023
                out = pa.RecordBatch.from_arrays([*made, pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.binary())], ["doc_id", "__id", "__h", "lo", "hi", "d"])  # noqa: B023
                rows.clear()  # noqa: B023
                return out

            for i, data, raw in _texts(batch.column(3)):
                ends = cuts(data)
                pieces = [raw[a:z] for a, z in zip([0, *ends], ends, strict=False)]
                on = marks.has(np.array([xxhash.xxh3_64_intdigest(p) for p in pieces], np.uint64))
                for k in np.flatnonzero(on).tolist():
                    rows.append((i, ends[k] - len(pieces[k]), ends[k], xxhash.xxh3_128_digest(pieces[k])))
                if len(rows) > 50_000:
                    yield flush()
            yield flush()

    return run


def _cut_out(run: int):
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for (_, data, raw), found in zip(_texts(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                spans: list[list[int]] = []
                for x in sorted((r["lo"], r["hi"]) for r in found or []):
                    if spans and x[0] == spans[-1][1]:
                        spans[-1][1] = x[1]
                    else:
                        spans.append(list(x))
                spans = [s for s in spans if s[1] - s[0] >= min(run, len(raw))]
                digest, at = hashlib.sha256(), 0
                for a, z in spans:
                    digest.update(raw[at:a])
                    at = z
                digest.update(raw[at:])
                rows.append((len(raw), len(cuts(data)), len(found or []), sum(z - a for a, z in spans), len(spans), digest.hexdigest()))
            names = ["n_bytes", "n_chunks", "n_later_chunks", "n_removed", "n_spans"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([r[i] for r in rows], pa.int64()) for i in range(5)], pa.array([r[5] for r in rows], pa.string())], ["doc_id", *names, "kept_sha256"])

    return apply


def remove_chunks(docs: DataFrame, run: int = RUN) -> DataFrame:
    """doc_id, n_bytes, n_chunks, n_later_chunks, n_removed, n_spans, kept_sha256 of every row."""
    source = docs.select("doc_id", *row_key(docs), F.encode(text_of(), "UTF-8").alias("__t"))
    bits = bitmap(source.select("__t").mapInArrow(_hashes, "v long").groupBy("v").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    chunks = cut(source.mapInArrow(_chunks(bits), f"doc_id {kind}, __id string, __h long, lo long, hi long, d binary"), "chunks")
    bits.destroy()
    place = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id"), F.col("__h"), F.col("lo"))
    # Written, so that the join reads two plain shuffles and a frequent chunk's rows can be split.
    first = cut(chunks.groupBy("d").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("c")).where("c > 1").select("d", "first"), "first")
    later = chunks.join(first, "d").where(place != F.col("first"))
    spans = later.groupBy("__id", "__h").agg(F.collect_set(F.struct("lo", "hi")).alias("runs"))
    joined = source.join(spans, ["__id", "__h"], "left").select("doc_id", "__t", "runs")
    return joined.mapInArrow(_cut_out(run), f"doc_id {kind}, n_bytes long, n_chunks long, n_later_chunks long, n_removed long, n_spans long, kept_sha256 string")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated chunks of all documents."""
    return remove_chunks(read(spark, sf_dir, "documents"))
