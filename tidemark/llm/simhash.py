"""Operator 7: SimHash near-duplicates by multi-index hashing.

Fingerprints: words of the lower-cased (A-Z only) text, shingles of four words,
each hashed by XXH64 (seed 42); a bit is set if it is set in over half of the
hashes.  Fingerprints that differ in at most ``MOST`` bits link, and components of
links are groups.

Links are found between *distinct* fingerprints only, in two steps, each of which ends in
connected components:

1. Hubs.  The fingerprints that agree in two of four segments of 16 bits are compared
   with the least and the greatest of them.  That is six rows for each fingerprint, however
   many agree, and contracts most of a dense group of near copies.
2. Multi-index hashing.  The 64 bits are cut into m segments, and a table holds each
   fingerprint under every j of them joined.  Two fingerprints within 4 bits differ by at
   most one bit in some j segments (pigeonhole; see ``PLANS``), so each fingerprint probes,
   in each table, the Hamming ball of radius 1 around its own value.  As one of two
   that differ in a bit has it unset, only unset bits are flipped.  Complete distances are
   verified inside the join and only links between different components leave it.

   A bucket of one component only is one row of the table, whatever its size; in others
   the largest component is one row as well, and its members are fetched for the probes
   of other components that reach it.  So a dense group is never joined with itself.

The plan (m, j) is the one of least rows for the number of fingerprints: more segments
have more tables, but chance matches fall with the bits of a key, so that rows stay
near linear.  All plans are exact, and nothing is capped.

No join is a broadcast: all tables grow with the documents, and Spark puts the size of
an exploded one at that of what it is made of, a tenth or less.

Edge cases: null and empty texts, and texts of white space, have no words: their
fingerprint is zero and links like any other; fewer than four words are one
shingle; a group whose ids are all null has a null component_id; repeated rows are
rows; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import col, cut, discard, fresh, read, shuffled, text_of
from .components import connected_components

WORDS = 4
MOST = 4
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: bytes | None, words: int = WORDS) -> int:
    """The fingerprint of one UTF-8 text as an unsigned number."""
    tokens = (text or b"").translate(_LOWER).split()  # bytes.split() takes the six ASCII spaces
    if not tokens:
        return 0
    joined = memoryview(b" ".join(tokens))
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1)
    starts = np.concatenate([[0], ends[:-1]])
    n = max(1, len(tokens) - words + 1)
    hashes, votes, digest = [], np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for lo in range(0, n, 65536):
        hi = min(n, lo + 65536)
        last = ends[lo + min(words, len(tokens)) - 1 : hi + min(words, len(tokens)) - 1] - 1
        hashes = [digest(joined[s:e], 42) for s, e in zip(starts[lo:hi].tolist(), last.tolist(), strict=True)]
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        for at in range(0, len(bits), 255):
            votes += bits[at : at + 255].sum(axis=0, dtype=np.uint8)
    return int(np.packbits(2 * votes > n, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = np.array([fingerprint(x.as_buffer().to_pybytes() if x.is_valid else b"") for x in batch.column(batch.num_columns - 1)], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(values)], [*batch.schema.names[:-1], "fp"])


def fingerprints(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and ``fp`` (signed 64 bits) of every row."""
    chosen = docs.select(*keep, F.encode(text_of(), "UTF-8").alias("__t"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1])
    return chosen.mapInArrow(_fingerprints, f"{fields}, fp long")


#: (m, j): with m segments, the j of them with fewest of 4 differing bits have at most one together.
PLANS = ((3, 1), (5, 2), (6, 3), (7, 4), (8, 5))


def masks(m: int, j: int) -> list[int]:
    """The bits of every j of m segments of 64 bits."""
    ends = [round(64 * i / m) for i in range(m + 1)]
    parts = [(1 << b) - (1 << a) for a, b in zip(ends, ends[1:], strict=False)]
    return [sum(c) for c in combinations(parts, j)]


def radius(m: int, j: int, most: int = MOST) -> int:
    """The most bits in which the best j of m segments can differ, of ``most`` bits in all."""
    each, more = divmod(most, m)
    return each * j + max(0, j - (m - more))


def plan(n: int, most: int = MOST) -> tuple[int, int]:
    """The plan of least rows: those of the tables and probes, and chance matches."""
    def cost(p: tuple[int, int]) -> float:
        return sum(n * (2 + m.bit_count() / 2) + n * n * (m.bit_count() / 2 + 1) / 2.0 ** m.bit_count() for m in masks(*p))

    return min((p for p in PLANS if radius(*p, most) <= 1), key=cost)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _distance(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def _keyed(table: DataFrame, of: list[int]) -> DataFrame:
    """A row for each mask ``s`` with the fingerprint's bits ``k`` in it."""
    return table.select("*", F.posexplode(F.lit([_signed(m) for m in of]).cast("array<long>")).alias("s", "k")).withColumn("k", F.col("fp").bitwiseAND(F.col("k")))


def _probes(table: DataFrame, of: list[int]) -> DataFrame:
    """(fp2, root2, s, k): for each mask the key itself and those with one more of its bits set."""
    ball = [(s, _signed(m), _signed(f)) for s, m in enumerate(of) for f in (0, *(1 << b for b in range(64) if m >> b & 1))]
    flips = F.array(*[F.struct(F.lit(s).alias("s"), F.lit(m).cast("long").alias("m"), F.lit(f).cast("long").alias("f")) for s, m, f in ball])
    rows = table.select(F.col("fp").alias("fp2"), F.col("root").alias("root2"), F.inline(flips)).where(F.col("fp2").bitwiseAND(F.col("f")) == 0)
    return rows.select("fp2", "root2", "s", F.col("fp2").bitwiseAND(F.col("m")).bitwiseOR(F.col("f")).alias("k"))


def link_fingerprints(fps: DataFrame, most: int = MOST, segments: tuple[int, int] | None = None) -> DataFrame:
    """(fp, root) for every fingerprint of ``fps`` (distinct ``fp``, written)."""
    keyed = _keyed(fps.select("fp"), masks(4, 2))
    hubs = keyed.groupBy("s", "k").agg(F.min("fp").alias("least"), F.max("fp").alias("most")).where("least != most")
    near = shuffled(keyed).join(cut(hubs, "hubs"), ["s", "k"]).select("fp", F.explode(F.array("least", "most")).alias("hub")).where((F.col("fp") != F.col("hub")) & (_distance("fp", "hub") <= most))
    first = connected_components(near.select(F.col("fp").alias("u"), F.col("hub").alias("v")))
    table = cut(shuffled(fps).join(first, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("root")), "fps")

    of = masks(*(segments or plan(table.count(), most)))
    index = _keyed(table, of)
    groups = index.groupBy("s", "k", "root").agg(F.count(F.lit(1)).alias("c"), F.min("fp").alias("fp"))
    buckets = cut(groups.groupBy("s", "k").agg(F.max_by(F.struct("root", "c", "fp"), "c").alias("top"), (F.count(F.lit(1)) > 1).alias("mixed")).select("s", "k", "top.*", "mixed"), "buckets")
    mixed = buckets.where("mixed").select("s", "k", F.col("root").alias("top"))
    others = shuffled(index).join(mixed, ["s", "k"]).where(F.col("root") != F.col("top")).select("s", "k", "root", "fp")
    entries = buckets.select("s", "k", "root", F.when(F.col("c") == 1, F.col("fp")).alias("fp")).unionAll(others)
    reached = shuffled(entries).join(_probes(table, of), ["s", "k"]).where((F.col("root") != F.col("root2")) & (F.col("fp").isNull() | (_distance("fp", "fp2") <= most)))
    reached = cut(reached.select("s", "k", "root", "fp", "root2", "fp2"), "reached")
    direct = reached.where("fp IS NOT NULL")
    members = index.select("s", "k", "root", F.col("fp").alias("member"))
    inside = shuffled(reached.where("fp IS NULL").drop("fp")).join(members, ["s", "k", "root"]).where(_distance("member", "fp2") <= most)
    far = direct.select("root", "root2").unionAll(inside.select("root", "root2"))
    second = connected_components(far.select(F.col("root").alias("u"), F.col("root2").alias("v"))).withColumnRenamed("root", "final")
    out = shuffled(table).join(second, F.col("root") == F.col("node"), "left").select("fp", F.coalesce("final", "root").alias("root"))
    discard(buckets, reached)
    return out


def near_duplicates(docs: DataFrame, most: int = MOST, segments: tuple[int, int] | None = None) -> DataFrame:
    """doc_id, fp, component_id: one row for each row of ``docs``."""
    rows = cut(fingerprints(docs), "fingerprints")
    distinct = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    named = cut(shuffled(distinct).join(link_fingerprints(distinct.select("fp"), most, segments), "fp"), "roots")
    # Both tables are written: the join is of plain shuffles whose skew can be split.
    least = cut(named.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    names = cut(shuffled(named).join(least, "root").select("fp", "component_id"), "names")
    return shuffled(rows).join(names, "fp")


def keep_one(docs: DataFrame, most: int = MOST) -> DataFrame:
    """The rows of ``docs`` with one row of each group: that of the least id.

    Of rows that share that id, the one with the least text hash stays, and of rows
    that agree in the text as well, one.  Nulls come last in both.
    """
    names = docs.columns
    i, h, many = fresh(names, "i", "h", "many")
    rows = cut(fingerprints(docs.select("doc_id", F.xxhash64("text").alias("__h"), "text"), ("doc_id", "__h")), "fingerprints")
    distinct = rows.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id"), F.col("__h"))).alias("best"))
    distinct = cut(distinct, "distinct")
    roots = link_fingerprints(distinct.select("fp"), most)
    best = shuffled(distinct).join(roots, "fp").groupBy("root").agg(F.min("best").alias("best")).select(F.col("best.doc_id").alias(i), F.col("best.__h").alias(h))
    copies = rows.groupBy(F.col("doc_id").alias("id2"), F.col("__h").alias("h2")).agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    best = shuffled(best).join(copies, F.col(i).eqNullSafe(F.col("id2")) & (F.col(h) == F.col("h2")), "left").select(i, h, (F.coalesce("c", F.lit(1)) > 1).alias(many))
    kept = shuffled(docs).join(best, F.col("doc_id").eqNullSafe(F.col(i)) & (F.xxhash64("text") == F.col(h)))
    kept = cut(kept.select(*map(col, names), i, h, many), "kept")
    once = kept.where(F.col(many)).dropDuplicates([i, h])
    return kept.where(~F.col(many)).select(*map(col, names)).unionAll(once.select(*map(col, names)))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint, component_id of all documents."""
    return near_duplicates(read(spark, sf_dir, "documents")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
