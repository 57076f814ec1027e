"""Operator 9: benchmark decontamination by Wu-Manber search over words.

Patterns are windows of 13 words of the benchmark items (an item of fewer words is
one pattern of its own length).  Patterns of one length m form a search group with
the three tables of Wu and Manber, over blocks of two words (one for m = 1):

* the shift table says how far a block can be from the end of a pattern; a block in
  no pattern allows the full shift m - b + 1, so only every (m - b + 1)-th block of a
  text is looked up at all, and only the window ends that its shift leaves are
  looked at further;
* the suffix table keeps windows whose last block ends some pattern;
* the bucket of a window's hash selects patterns, which are compared byte for byte.

The scan runs batch-wise over whole Arrow columns, so all steps are array
operations; only windows whose hash is a pattern's reach Python.  Patterns come
from the benchmark in blocks of at most ``max_windows`` windows, each a broadcast of
bounded size.  One block is one scan without a shuffle.  With more, each block is a scan
of the texts that writes the hits alone, by digest of the text; their union is
small and joined to the documents once.

Edge cases: null and empty texts have no words and no hits; items without words
have no window; a null item_id counts as the empty string; items that repeat count
once by item_id; an empty benchmark hits nothing; windows don't cross documents;
ties don't arise; repeated rows get equal results; extra columns are kept by ``mark``,
but for those named like a column that it adds, which is put in their place, and all
by ``decontaminate``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import col, cut, fresh, map_rows, read, without
from .flat import LOWER, contains, flat, slices, word_bounds, word_hashes

WINDOW = 13
MAX_WINDOWS = 250_000
_Q = np.uint64(0x9E3779B97F4A7C15)


def _powers(m: int) -> np.ndarray:
    return np.cumprod(np.full(m, _Q, np.uint64), dtype=np.uint64)


def _rolling(h: np.ndarray, m: int) -> np.ndarray:
    """Hashes of all runs of m words."""
    n = len(h) - m + 1
    out = np.zeros(max(n, 0), np.uint64)
    for i, p in enumerate(_powers(m)):
        out += h[i : i + n] * p if n > 0 else out
    return out


def _words(text: bytes) -> list[bytes]:
    data = LOWER[np.frombuffer(text, np.uint8)]
    raw = data.tobytes()
    return [raw[s:e] for s, e in zip(*(x.tolist() for x in word_bounds(data, np.array([0, len(data)]))), strict=True)]


class Patterns:
    """The tables of all patterns of one block of the benchmark."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW):
        by: dict[int, dict[bytes, set[str]]] = {}
        for item, text in items:
            words = _words(text)
            m = min(window, len(words))
            for i in range(len(words) - m + 1 if words else 0):
                by.setdefault(m, {}).setdefault(b" ".join(words[i : i + m]), set()).add(item)
        self.groups = []
        for m, found in sorted(by.items()):
            texts = sorted(found)
            joined = np.frombuffer(b"\n".join(texts), np.uint8)
            starts, ends = word_bounds(joined, np.array([0, len(joined)]))
            h = word_hashes(joined, starts, ends).reshape(-1, m)
            b = 2 if m > 1 else 1
            blocks = np.stack([_rolling_rows(h[:, i : i + b]) for i in range(m - b + 1)], axis=1)
            shift: dict[int, int] = {}
            for i in range(m - b + 1):
                for x in blocks[:, i].tolist():
                    shift[x] = m - b - i  # later places are smaller shifts
            keys = np.array(sorted(shift), np.uint64)
            hashes = _rolling_rows(h)
            order = np.argsort(hashes, kind="stable")
            self.groups.append({
                "m": m, "b": b, "keys": keys, "shift": np.array([shift[int(k)] for k in keys], np.int64), "suffix": np.unique(blocks[:, -1]),
                "hashes": hashes[order], "texts": [texts[i] for i in order], "items": [sorted(found[texts[i]]) for i in order],
            })

    def search(self, data: np.ndarray, offsets: np.ndarray):
        """(starts of rows in words, hit windows as (first word, m), items by row) of lower-cased bytes."""
        starts, ends = word_bounds(data, offsets)
        first = np.searchsorted(starts, offsets)
        runs: list[tuple[int, int]] = []
        items: dict[int, set[str]] = {}
        if not len(starts):
            return first, runs, items
        h = word_hashes(data, starts, ends)
        row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
        for g in self.groups:
            m, b = g["m"], g["b"]
            step, n = m - b + 1, len(h) - m + 1
            if n <= 0:
                continue
            grid = np.arange(0, len(h) - b + 1, step)
            at = sum((h[grid + i] * p for i, p in enumerate(_powers(b))), np.zeros(len(grid), np.uint64))
            known, place = contains(g["keys"], at)
            grid, shift = grid[known], g["shift"][place[known]]
            # The block may stand in a window at every place up to the last one its shift allows.
            reach = m - b - shift
            count = reach + 1
            begin = np.repeat(grid, count) - (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count))
            begin = begin[(begin >= 0) & (begin < n)]
            begin = begin[row[begin] == row[begin + m - 1]]
            last = sum((h[begin + m - b + i] * p for i, p in enumerate(_powers(b))), np.zeros(len(begin), np.uint64))
            begin = begin[contains(g["suffix"], last)[0]]
            whole = sum((h[begin + i] * p for i, p in enumerate(_powers(m))), np.zeros(len(begin), np.uint64))
            found, place = contains(g["hashes"], whole)
            for i, k in zip(begin[found].tolist(), place[found].tolist(), strict=True):
                text = b" ".join(data[s:e].tobytes() for s, e in zip(starts[i : i + m].tolist(), ends[i : i + m].tolist(), strict=True))
                while True:  # over the bucket of this hash
                    if g["texts"][k] == text:
                        runs.append((i, m))
                        items.setdefault(int(row[i]), set()).update(g["items"][k])
                        break
                    if k + 1 >= len(g["texts"]) or g["hashes"][k + 1] != g["hashes"][k]:
                        break
                    k += 1
        return first, runs, items


def _rolling_rows(h: np.ndarray) -> np.ndarray:
    return (h * _powers(h.shape[1])).sum(axis=1, dtype=np.uint64)


def _search(table: Patterns, column: pa.Array) -> tuple[np.ndarray, list[list[tuple[int, int]]], list[set[str]]]:
    """(words, runs of hit words, items) of each text."""
    data, offsets = flat(column)
    n = len(column)
    runs_of: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    words, items_of = np.zeros(n, np.int64), [set() for _ in range(n)]
    for a, z in slices(offsets):
        part = LOWER[data[offsets[a] : offsets[z]]]
        first, runs, items = table.search(part, offsets[a : z + 1] - offsets[a])
        words[a:z] = np.diff(first)
        for i, m in runs:
            at = int(np.searchsorted(first, i, "right")) - 1
            while first[at + 1] <= i:
                at += 1
            runs_of[a + at].append((i - int(first[at]), i - int(first[at]) + m))
        for i, x in items.items():
            items_of[a + i] |= x
    return words, runs_of, items_of


def _columns(words: np.ndarray, runs_of: list[list[tuple[int, int]]], items_of: list[set[str]], window: int) -> list[pa.Array]:
    hit = np.array([_covered(r) for r in runs_of], np.int64)
    return [
        pa.array(words), pa.array(hit), pa.array([len(x) for x in items_of], pa.int64()),
        pa.array([hashlib.sha256(",".join(sorted(x)).encode()).hexdigest() for x in items_of], pa.string()),
        pa.array((hit > 0) & (20 * hit >= words)), pa.array([any(z - a == window for a, z in r) for r in runs_of], pa.bool_()),
    ]


def _one_block(patterns, text_at: int, window: int):
    """All results at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.Array]]:
        for batch in batches:
            yield [*batch.columns, *_columns(*_search(patterns.value, batch.column(text_at)), window)]

    return run


def _hits(patterns):
    """(k, runs, items) of the texts (k, text) that one block of several hits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, runs, items = _search(patterns.value, batch.column(1))
            on = [i for i, r in enumerate(runs) if r]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(on, pa.int64())), pa.array([np.array(runs[i], np.int64).tobytes() for i in on], pa.binary()), pa.array([sorted(items[i]) for i in on], pa.list_(pa.string()))], ["k", "runs", "items"])

    return run


def _joined(text_at: int, window: int):
    """The results of rows whose last column has the hits of all blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.Array]]:
        nothing = Patterns([], window)
        for batch in batches:
            words, _, _ = _search(nothing, batch.column(text_at))
            found = [x or [] for x in batch.column(batch.num_columns - 1).to_pylist()]
            runs = [[tuple(r) for h in x for r in np.frombuffer(h["runs"], np.int64).reshape(-1, 2).tolist()] for x in found]
            items = [{i for h in x for i in h["items"]} for x in found]
            yield [*batch.columns, *_columns(words, runs, items, window)]

    return run


def _covered(runs: list[tuple[int, int]]) -> int:
    total, end = 0, -1
    for a, z in sorted(runs):
        total += max(0, z - max(a, end))
        end = max(end, z)
    return total


def _blocks(benchmark: DataFrame, window: int, most: int) -> Iterator[list[tuple[str, bytes]]]:
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("i"), F.col("text").alias("t")).where("t IS NOT NULL")
    block: list[tuple[str, bytes]] = []
    held = 0
    for r in rows.toLocalIterator():
        block.append((r["i"], r["t"].encode()))
        held += max(1, len(block[-1][1]) // 6)
        if held >= most:
            yield block
            block, held = [], 0
    yield block


def _marked(docs: DataFrame, benchmark: DataFrame, names: list[str], window: int, max_windows: int, text: str) -> DataFrame:
    """All columns of ``docs`` and six more: those of ``mark`` and whether a full window occurs."""
    sc = docs.sparkSession.sparkContext
    out = dict(zip(names, ("long", "long", "long", "string", "boolean", "boolean"), strict=True))
    at = docs.columns.index(text)
    blocks = _blocks(benchmark, window, max_windows)
    block, following = next(blocks), next(blocks, None)
    if following is None:
        return map_rows(docs, _one_block(sc.broadcast(Patterns(block, window)), at, window), out)
    texts = docs.select(F.md5(col(text)).alias("k"), col(text).alias("t")).where("t IS NOT NULL")
    hits = None
    while block is not None:
        patterns = sc.broadcast(Patterns(block, window))
        found = cut(texts.mapInArrow(_hits(patterns), "k string, runs binary, items array<string>"), "hits")
        patterns.destroy()
        hits = found if hits is None else hits.unionAll(found)
        block, following = following, next(blocks, None)
    # Equal texts have equal hits; a text has at most one row a block.
    merged = cut(hits.groupBy("k").agg(F.collect_set(F.struct("runs", "items")).alias("found")), "hits")
    key, there, found = fresh(docs.columns, "key", "there", "found")
    merged = merged.select(F.col("k").alias(there), F.col("found").alias(found))
    joined = docs.withColumn(key, F.md5(col(text))).join(merged, F.col(key) == F.col(there), "left").drop(key, there)
    return map_rows(joined.select(*map(col, docs.columns), found), _joined(at, window), out).drop(found)


COLUMNS = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated"]


def mark(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_windows: int = MAX_WINDOWS, text: str = "text") -> DataFrame:
    """The columns of ``docs`` with n_words, n_hit, n_items, items_sha256 and contaminated."""
    docs = without(docs, *COLUMNS)
    full = fresh(docs.columns, "full")
    return _marked(docs, benchmark, [*COLUMNS, *full], window, max_windows, text).drop(*full)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """The rows of ``docs`` that hold no full window of an item and aren't contaminated.

    A passage of ``window`` words is a leak however long the document around it; hits of
    items of fewer words, which may be common phrases, count by their share of the words.
    """
    names = fresh(docs.columns, *COLUMNS, "full")
    marked = _marked(docs, benchmark, names, window, max_windows, "text")
    return marked.where(~(F.col(names[4]) | F.col(names[5]))).select(*map(col, docs.columns))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of all documents against all items."""
    return mark(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark")).drop("text")


_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"regexp_extract_all({_LOW}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
OP9_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item_id, {_WORDS} AS w FROM benchmark),
iw AS (SELECT item_id, w, least(13, len(w)) AS k, unnest(generate_series(1, len(w) - least(13, len(w)) + 1)) AS p FROM i WHERE len(w) > 0),
p AS (SELECT DISTINCT item_id, k, array_to_string(w[p:p + k - 1], ' ') AS s FROM iw),
ks AS (SELECT DISTINCT k FROM p),
dw AS (SELECT rid, w, ks.k, unnest(generate_series(1, len(w) - ks.k + 1)) AS p FROM d, ks WHERE len(w) >= ks.k),
h AS (SELECT rid, dw.k, dw.p, p.item_id FROM dw JOIN p ON p.k = dw.k AND p.s = array_to_string(dw.w[dw.p:dw.p + dw.k - 1], ' ')),
hw AS (SELECT rid, count(DISTINCT q) AS n_hit FROM (SELECT rid, unnest(generate_series(p, p + k - 1)) AS q FROM h) GROUP BY rid),
hi AS (SELECT rid, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT rid, item_id FROM h) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hw USING (rid) LEFT JOIN hi USING (rid)
"""
