"""Operator 1: suffix-array dedup by merging shard Burrows-Wheeler transforms.

A byte is removed if a string of ``LENGTH`` bytes that covers it starts at another
place as well, in any document, this one included.

1. Candidates.  Each window of 200 bytes has as its *mark* the least hash of its
   48-byte substrings: a function of its content, so equal windows have equal marks.
   Neighbouring windows of one mark form a *context* (the bytes of all of them, at most
   ``RUN`` windows).  Marks that occur at one place of the corpus only can't
   hold a repeat.  They are counted by a combinable aggregate, and what is left is
   told to a second scan as a bitmap (see ``bitmaps``), which only saves work: marks
   are counted exactly again afterwards.
2. Contexts that occur twice or more as they are (digests of 64 + 64 bits) are repeated
   as a whole; copies, however many, take part once in what follows.
3. Contexts that share a mark with different ones are searched.  Windows whose rolling
   hash no other window of the task's block has can't be repeated there, and most
   contexts share no more than their mark.  The bytes of the others are cut into shards, each shard's suffixes are sorted and its Burrows-Wheeler transform
   (symbols of eight bytes) taken, and the shards are merged by refining their
   interleave: a stable sort of the symbols in interleave order carries an order by t
   bytes over to t + 8, and block boundaries that appear in a round are common prefixes
   of that length (Holt and McMillan, 2014).  After 25 rounds a block of two or
   more rows is an interval of repeated 200-byte strings.  Suffixes of different shards
   are never compared.
4. A mark with over ``GROUP`` different contexts would be too much for a task.  Its
   contexts are cut where the place of the mark in a window passes a multiple of
   ``PLACES`` bytes: all windows of such a finer context share ``CORE`` bytes around the
   mark, whose hash takes the mark's part.  A window with an edit in its core is
   alone there and goes; equal finer contexts are collapsed like whole ones.  Where
   over ``GROUP`` different ones are left, they are searched in parts, and the different
   windows of the parts are counted by 128-bit digests in a combinable aggregate, which
   finds what only other parts repeat.
5. Intervals are gathered by document and cut from the text.

Edge cases: null and empty texts, and those of under 200 bytes, lose nothing; rows that
agree in doc_id and text are occurrences of their own and get equal results; very
long texts are scanned in overlapping slices; an empty table gives no rows; extra
columns are ignored; ties can't arise, as strings are judged on the input.
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
from .common import cut, discard, read, row_key, text_of
from .flat import flat, slices

LENGTH, MARK, RUN = 200, 48, 256
GROUP = 1500
TASK_BYTES = 2 << 20
SLICE = 1 << 19  # bytes whose hashes are held at a time
PLACES = 19
CORE = MARK + PLACES * ((LENGTH - MARK) // PLACES - 1)
_STEP = 8


def _rolling(data: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all substrings of k bytes, by doubling."""
    cur = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    cur ^= cur >> np.uint64(32)
    power, length, out, have = 0x9E3779B97F4A7C15, 1, None, 0
    while k:
        if k & 1:
            if out is None:
                out, have = cur, length
            else:
                n = len(data) - have - length + 1
                out, have = out[:n] * np.uint64(power) + cur[have : have + n], have + length
        k >>= 1
        if k:
            n = len(data) - 2 * length + 1
            cur = cur[:n] * np.uint64(power) + cur[length : length + n]
            power, length = power * power % (1 << 64), 2 * length
    out = (out ^ (out >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return out ^ (out >> np.uint64(29))


def _minima(h: np.ndarray, w: int) -> np.ndarray:
    length, m = 1, h
    while 2 * length <= w:
        m, length = np.minimum(m[: len(m) - length], m[length:]), 2 * length
    n = len(h) - w + 1
    return np.minimum(m[:n], m[w - length : w - length + n])


def contexts(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """(mark, row, first window, last window, whether it may repeat in itself) in places of ``data``, by slices of it."""
    for a, z in slices(offsets, SLICE):
        lo, end = int(offsets[a]), int(offsets[z])
        at = lo
        # A row longer than a slice is read on with an overlap; runs are cut at the same places of a row by RUN.
        while end - at >= LENGTH:
            stop = min(end, at + SLICE) if z - a == 1 else end
            h = _rolling(data[at:stop], MARK)
            m = _minima(h, LENGTH - MARK + 1)
            row = np.searchsorted(offsets, np.arange(at, at + len(m)), "right") - 1 if z - a > 1 else np.full(len(m), a)
            ok = np.arange(at, at + len(m)) + LENGTH <= offsets[row + 1]
            new = np.ones(len(m), bool)
            new[1:] = (m[1:] != m[:-1]) | (row[1:] != row[:-1])
            first = np.flatnonzero(new)
            run = np.repeat(first, np.diff(np.append(first, len(m))))
            new |= (np.arange(len(m)) - run) % RUN == 0
            first = np.flatnonzero(new & ok)
            # A run ends before the next start, or where the row's windows end.
            last = np.append(np.flatnonzero(new), len(m))
            last = np.minimum(last[np.searchsorted(last, first, "right")] - 1 + at, offsets[row[first] + 1] - LENGTH)
            # Equal windows of one context have their marks at different places, so some window but the last begins with the mark.
            seen = np.concatenate([[0], np.cumsum(h[: len(m)] == m)])
            inner = seen[last - at] > seen[first]
            yield m[first], row[first], first + at, last, inner
            if stop == end:
                break
            at = stop - LENGTH + 1


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = flat(batch.column(0))
        for mark, _, _, _, inner in contexts(data, offsets):
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([mark, mark[inner]]).view(np.int64))], ["v"])


def _kept_contexts(bits):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = bits.value
        for batch in batches:
            data, offsets = flat(batch.column(2))
            for mark, row, first, last, inner in contexts(data, offsets):
                on = marks.has(mark)
                mark, row, first, last, inner = mark[on], row[on], first[on], last[on], inner[on]
                for lo in range(0, len(mark), 4000):
                    part = slice(lo, lo + 4000)
                    texts = [data[a : z + LENGTH].tobytes() for a, z in zip(first[part].tolist(), last[part].tolist(), strict=True)]
                    where = pa.array(row[part])
                    yield pa.RecordBatch.from_arrays([
                        pa.array(mark[part].view(np.int64)), pa.array(np.array([xxhash.xxh3_64_intdigest(t) for t in texts], np.uint64).view(np.int64)),
                        batch.column(0).take(where), batch.column(1).take(where), pa.array(first[part] - offsets[row[part]]), pa.array(inner[part]), pa.array(texts, pa.binary()),
                    ], ["v", "c", "__id", "__h", "lo", "inner", "bytes"])

    return run


def _finer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(v, c, n, bytes) cut into windows of one core: (v, c, n, v2, c2, at, bytes), ``at`` places into the context.

    A window's core is fixed by its own bytes: it begins a multiple of ``PLACES`` before the
    first mark in the window.  The places of marks in windows of one core all differ, so
    that a finer context can't repeat in itself.
    """
    names, kinds = ["v", "c", "n", "v2", "c2", "at", "bytes"], [*[pa.int64()] * 3, pa.uint64(), pa.uint64(), pa.int64(), pa.binary()]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        made = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
        return pa.RecordBatch.from_arrays([x.view(pa.int64()) if pa.types.is_uint64(x.type) else x for x in made], names)

    for batch in batches:
        rows: list[tuple] = []
        for v, c, n, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            data = np.frombuffer(text, np.uint8)
            marks = np.flatnonzero(_rolling(data, MARK).view(np.int64) == v)
            window = np.arange(len(data) - LENGTH + 1)
            mark = marks[np.searchsorted(marks, window)]
            step = np.minimum((mark - window) // PLACES, (LENGTH - MARK) // PLACES - 1)
            first = np.flatnonzero(np.append(True, (mark[1:] != mark[:-1]) | (step[1:] != step[:-1])))
            for a, z in zip(first.tolist(), [*(first[1:] - 1).tolist(), len(window) - 1], strict=True):
                core, own = int(mark[a] - PLACES * step[a]), text[a : z + LENGTH]
                rows.append((v, c, n, xxhash.xxh3_64_intdigest(text[core : core + CORE], int(step[a])), xxhash.xxh3_64_intdigest(own), a, own))
            if len(rows) > 5000:
                yield batch_of(rows)
                rows = []
        yield batch_of(rows)


class Shard:
    """Suffix order (by 256 bytes, cyclic) and Burrows-Wheeler transform of one text."""

    def __init__(self, text: np.ndarray):
        n = len(text)
        at = np.arange(n)
        keys = np.zeros(n, np.uint64)
        for i in range(_STEP):
            keys = (keys << np.uint64(8)) | text[(at + i) % n]
        self.symbols = keys
        order = np.argsort(keys, kind="stable")
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.append(0, keys[order][1:] != keys[order][:-1]))
        h = _STEP
        while h < LENGTH and rank.max() < n - 1:
            pair = rank * (n + 1) + rank[(at + h) % n]
            order = np.argsort(pair, kind="stable")
            rank[order] = np.cumsum(np.append(0, pair[order][1:] != pair[order][:-1]))
            h *= 2
        self.order = order
        self.bwt = keys[(order - _STEP) % n]


def merge(shards: list[Shard], rounds: int = LENGTH // _STEP) -> tuple[np.ndarray, np.ndarray]:
    """(shard of each row, block of each row) of the merged order by ``rounds`` * 8 bytes.

    The symbols in interleave order are sorted stably, which is the interleave by
    eight more bytes; a row begins a block if its symbol or the block it came from differs
    from the row's before.
    """
    _, bwt = np.unique(np.concatenate([s.bwt for s in shards]), return_inverse=True)
    bwt = bwt.astype(np.uint16) if len(bwt) == 0 or bwt.max() < 1 << 16 else bwt
    interleave = np.repeat(np.arange(len(shards), dtype=np.uint16 if len(shards) > 255 else np.uint8), [len(s.order) for s in shards])
    block = np.zeros(len(interleave), np.int32)
    symbols = np.empty_like(bwt)
    for _ in range(rounds):
        symbols[np.argsort(interleave, kind="stable")] = bwt
        moved = np.argsort(symbols, kind="stable")
        interleave, came, s = interleave[moved], block[moved], symbols[moved]
        fresh = (s[1:] != s[:-1]) | (came[1:] != came[:-1])
        block = np.concatenate([[0], np.cumsum(fresh)]).astype(np.int32)
        if block[-1] == len(block) - 1:
            break
    return interleave, block


def _may_repeat(strings: list[bytes]) -> list[np.ndarray]:
    """For each string, which of its 200-byte windows have the hash of another; equal windows always have."""
    ends = np.cumsum([len(s) for s in strings])
    data = np.frombuffer(b"".join(strings), np.uint8)
    if len(data) < LENGTH:
        return [np.zeros(0, bool)] * len(strings)
    hashes = _rolling(data, LENGTH)
    windows = [slice(e - len(s), max(e - len(s), e - LENGTH + 1)) for e, s in zip(ends.tolist(), strings, strict=True)]
    inside = np.zeros(len(hashes), bool)
    for w in windows:
        inside[w] = True
    at = np.flatnonzero(inside)
    order = at[np.argsort(hashes[at])]
    same = hashes[order[1:]] == hashes[order[:-1]]
    found = np.zeros(len(hashes), bool)
    found[order[1:][same]] = found[order[:-1][same]] = True
    return [found[w] for w in windows]


def repeated_windows(strings: list[bytes], shard_bytes: int = 24_000) -> list[np.ndarray]:
    """For each string, which of its 200-byte windows start elsewhere among the strings too.

    Only stretches of windows whose hashes aren't the only ones of their value are merged.
    """
    out = _may_repeat(strings)
    where = [(i, a, z + 1) for i, f in enumerate(out) for a, z in _runs(f).tolist()]
    for (i, a, z), f in zip(where, _merged_windows([strings[i][a : z - 1 + LENGTH] for i, a, z in where], shard_bytes) if where else [], strict=True):
        out[i][a:z] = f
    return out


def _merged_windows(strings: list[bytes], shard_bytes: int) -> list[np.ndarray]:
    """``repeated_windows`` by the merge of shards alone."""
    groups: list[list[int]] = [[]]
    size = 0
    for i, s in enumerate(strings):
        if size and size + len(s) > shard_bytes:
            groups.append([])
            size = 0
        groups[-1].append(i)
        size += len(s) + _STEP
    pad = b"\0" * _STEP
    shards, starts, begins, total = [], [], np.zeros(len(strings), np.int64), 0
    for g in groups:
        text = pad.join([strings[i] for i in g] + [b""])
        at = np.cumsum([0] + [len(strings[i]) + _STEP for i in g])
        begins[g] = total + at[:-1]
        shards.append(Shard(np.frombuffer(text, np.uint8)))
        starts.append(total)
        total += len(text)
    windows = np.array([max(0, len(s) - LENGTH + 1) for s in strings])
    valid = np.zeros(total, bool)
    for b, w in zip(begins.tolist(), windows.tolist(), strict=True):
        valid[b : b + w] = True
    interleave, block = merge(shards)
    row = np.argsort(interleave, kind="stable")  # rows of the merged order, shard by shard in each one's own order
    place = np.concatenate([s.order + a for s, a in zip(shards, starts, strict=True)])
    at_place = np.empty(total, np.int32)
    at_place[place] = block[row]
    found = np.bincount(at_place[valid], minlength=int(block[-1]) + 1 if len(block) else 1) >= 2
    out = found[at_place] & valid
    return [out[b : b + w] for b, w in zip(begins.tolist(), windows.tolist(), strict=True)]


def _runs(flags: np.ndarray) -> np.ndarray:
    """(first, last) of runs of true."""
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.stack([np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1], axis=1)


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (v, c, once, part, bytes) in order of (v, part), no such pair in two tasks: searches blocks of whole groups.

    Emits (v, c, a, z), runs of repeated windows of contexts that occur once.  Where a mark's
    contexts are spread over several parts (part >= 0), also the digest of each different
    window of the part as (v, c, a, a, d, own); ``own`` are those of contexts that occur once
    which nothing in the part repeats, and that the other parts may.
    """
    held: list[tuple[int, int, bool, int, bytes]] = []
    size = 0
    names, kinds = ["v", "c", "a", "z", "d", "own"], [pa.int64()] * 4 + [pa.binary(), pa.bool_()]

    def flush() -> Iterator[pa.RecordBatch]:
        found = repeated_windows([r[4] for r in held])
        rows: list[tuple] = [(r[0], r[1], x[0], x[1], None, False) for r, f in zip(held, found, strict=True) if r[2] for x in _runs(f).tolist()]
        seen: set[bytes] = set()
        for (v, c, once, part, text), f in zip(held, found, strict=True):
            for i, twice in enumerate(f.tolist()) if part >= 0 else ():
                d = xxhash.xxh3_128_digest(text[i : i + LENGTH])
                if d not in seen:
                    seen.add(d)
                    rows.append((v, c, i, i, d, once and not twice))
                if len(rows) >= 20_000:
                    yield batch_of(rows)
                    rows = []
        held.clear()
        yield batch_of(rows)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[i]) for i in range(6)], names)

    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            if held and (held[-1][0], held[-1][3]) != (row[0], row[3]) and (size > 48_000 or row[3] >= 0 or held[-1][3] >= 0):
                yield from flush()
                size = 0
            held.append(row)
            size += len(row[4]) + _STEP
    if held:
        yield from flush()


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names = batch.schema.names
        rows: list[tuple[int, int, int, str]] = []
        for text, runs in zip(batch.column(names.index("__t")), batch.column(names.index("runs")), strict=True):
            raw = text.as_buffer().to_pybytes() if text.is_valid else b""
            spans: list[list[int]] = []
            for r in sorted((x["lo"], x["hi"]) for x in runs.as_py() or []):
                if spans and r[0] <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], r[1])
                else:
                    spans.append(list(r))
            digest, at = hashlib.sha256(), 0
            for a, z in spans:
                digest.update(raw[at:a])
                at = z
            digest.update(raw[at:])
            rows.append((len(raw), sum(z - a for a, z in spans), len(spans), digest.hexdigest()))
        kept = [n for n in names if n not in ("__t", "runs")]
        columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string()))]
        yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in kept], *columns], [*kept, "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def repeated_spans(docs: DataFrame, group: int = GROUP) -> DataFrame:
    """__id, __h, runs: for each document with repeats (see ``row_key``) the byte ranges (lo, hi), not merged."""
    source = docs.select(*row_key(docs), F.encode(text_of(), "UTF-8").alias("t"))
    marks = source.select("t").mapInArrow(_marks, "v long").groupBy("v").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    bits = bitmap(marks)
    found = cut(source.mapInArrow(_kept_contexts(bits), "v long, c long, __id string, __h long, lo long, inner boolean, bytes binary"), "contexts", "zstd")
    bits.destroy()
    distinct = cut(found.groupBy("v", "c").agg(F.count(F.lit(1)).alias("n"), F.max("inner").alias("inner"), F.any_value("bytes").alias("bytes")), "distinct", "zstd")
    marked = distinct.groupBy("v").agg(F.count(F.lit(1)).alias("nd"), F.sum((F.col("n") == 1).cast("long")).alias("once"), F.max("inner").alias("inner")).where("once > 0 AND (nd > 1 OR inner)")
    # Written, so that the join with the contexts is a broadcast where marks are few, else of plain shuffles in which a crowded mark can be split.
    marked = cut(marked.select("v", "nd"), "marked")
    work = cut(distinct.join(marked, "v").select("v", "c", "n", "nd", "bytes"), "work", "zstd")
    few = work.where(F.col("nd") <= group).select("v", "c", (F.col("n") == 1).alias("once"), F.lit(-1).alias("part"), "bytes")
    # A mark with very many contexts: by core, and where that is crowded too, in parts of about `group`.
    finer = cut(work.where(F.col("nd") > group).select("v", "c", "n", "bytes").mapInArrow(_finer, "v long, c long, n long, v2 long, c2 long, at long, bytes binary"), "finer", "zstd")
    cores = cut(finer.groupBy("v2", "c2").agg(F.sum("n").alias("n"), F.any_value("bytes").alias("bytes")), "cores", "zstd")
    shared = cores.groupBy("v2").agg(F.count(F.lit(1)).alias("nd"), F.sum((F.col("n") == 1).cast("long")).alias("once")).where("once > 0 AND nd > 1")
    spread = F.when(F.col("nd") > group, F.pmod(F.xxhash64("c2"), F.ceil(F.col("nd") / group))).otherwise(F.lit(-1)).cast("int")
    many = cores.join(shared.select("v2", "nd"), "v2").select("v2", "c2", F.col("n") == 1, spread, "bytes")
    parts = few.unionAll(many)
    # Partitions by the bytes to search, so that the longest task doesn't grow with the input.
    n = max(1, -(-(parts.agg(F.sum(F.length("bytes"))).first()[0] or 0) // TASK_BYTES))
    parts = parts.repartition(n, "v", "part").sortWithinPartitions("v", "part", "c")
    searched = cut(parts.mapInArrow(_search, "v long, c long, a long, z long, d binary, own boolean"), "searched")
    digests = searched.where("d IS NOT NULL")
    twice = digests.groupBy("d").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("d")
    across = digests.where("own").join(twice, "d").select("v", "c", "a", "z")
    whole = lambda df, v, c: df.where("n > 1").select(F.col(v).alias("v"), F.col(c).alias("c"), F.lit(0).cast("long").alias("a"), (F.length("bytes") - LENGTH).cast("long").alias("z"))
    inside = searched.where("d IS NULL").select("v", "c", "a", "z").unionAll(across)
    of_cores = inside.unionAll(whole(cores, "v2", "c2")).withColumnsRenamed({"v": "v2", "c": "c2"})
    lifted = finer.where("n = 1").select("v", "c", "v2", "c2", "at").join(of_cores, ["v2", "c2"]).select("v", "c", F.col("at") + F.col("a"), F.col("at") + F.col("z"))
    hits = cut(whole(distinct, "v", "c").unionAll(inside).unionAll(lifted), "hits")
    discard(work, finer, cores, searched, distinct, marked)
    spans = found.select("v", "c", "__id", "__h", "lo").join(hits, ["v", "c"])
    return spans.groupBy("__id", "__h").agg(F.collect_set(F.struct((F.col("lo") + F.col("a")).alias("lo"), (F.col("lo") + F.col("z") + LENGTH).alias("hi"))).alias("runs"))


def remove_repeats(docs: DataFrame, group: int = GROUP) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row of ``docs``."""
    spans = repeated_spans(docs, group)
    keyed = docs.select("doc_id", F.encode(text_of(), "UTF-8").alias("__t"), *row_key(docs))
    joined = keyed.join(spans, ["__id", "__h"], "left").select("doc_id", "__t", "runs")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return joined.mapInArrow(_cut_out, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of all documents that repeated 200-byte strings cover."""
    return remove_repeats(read(spark, sf_dir, "documents"))
