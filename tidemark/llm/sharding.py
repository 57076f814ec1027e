"""Operator 5: hierarchical weighted hash tree (native).

A topology is a tuple of regions, a region a tuple of racks, a rack a tuple of
``(shard, weight)`` pairs.  Every document descends region -> rack -> shard.  On
each level child ``c`` of weight ``w`` draws ``-ln(u_c) / w`` where ``u_c`` is a
hash of the document's key and the child's own name, and the smallest draw wins:
a child is chosen with probability proportional to its weight, and a change of a
weight moves rows only towards (or away from) the changed child.

``grow`` adds a shard as a region of its own.  All other draws stay as they are,
so a row either keeps its shard or goes to the new one; nothing moves between old
shards, which would happen if the new shard raised the weight of a rack that
already holds others.  This is the law ``key``: doc_id and the topology (that is,
the number of shards) decide alone.  Documents of equal text but different ids
are different keys.

Edge cases: a null doc_id is the key ``null`` and goes to one shard; a null text
has no bytes and crc32 0; empty texts, ties and repeated rows are ordinary rows,
repeated rows get slots next to each other; an empty table gives no rows; extra
columns are ignored by ``assign_slots`` and kept by ``shard_documents``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import copies, cut, read, text_of, without

Topology = tuple[tuple[tuple[tuple[int, float], ...], ...], ...]


def topology(shards: int = 24, racks_per_region: int = 3, shards_per_rack: int = 4) -> Topology:
    """Full regions first; shards beyond the last full region are regions of their own."""
    per_region = racks_per_region * shards_per_rack
    regions: list = []
    for first in range(0, shards - shards % per_region, per_region):
        regions.append(tuple(tuple((first + r * shards_per_rack + s, 1.0) for s in range(shards_per_rack)) for r in range(racks_per_region)))
    regions += [(((s, 1.0),),) for s in range(shards - shards % per_region, shards)]
    return tuple(regions)


def grow(tree: Topology, weight: float = 1.0) -> Topology:
    """One more shard, as a region of its own."""
    top = max((s for region in tree for rack in region for s, _ in rack), default=-1)
    return (*tree, (((top + 1, weight),),))


def _pick(key: Column, children: Column) -> Column:
    """Of an array of (name, weight, payload), the payload whose draw is smallest; of equal draws, the lesser name."""
    def drawn(c: Column) -> Column:
        u = (F.shiftrightunsigned(F.xxhash64(key, c["name"]), 11).cast("double") + F.lit(0.5)) * F.lit(2.0**-53)
        return F.struct((-F.ln(u) / c["w"]).alias("draw"), c["name"].alias("name"), c["below"].alias("below"))

    return F.array_min(F.transform(children, drawn))["below"]


def _nodes(children: list[tuple[str, float, Column]]) -> Column:
    return F.array(*[F.struct(F.lit(n).alias("name"), F.lit(float(w)).alias("w"), b.alias("below")) for n, w, b in children])


def shard_of(doc_id: Column, tree: Topology) -> Column:
    """The shard of a key. The tree is a nested literal; only the nodes on a row's own path are drawn."""
    key = F.coalesce(doc_id.cast("string"), F.lit("null"))
    regions = []
    for region in tree:
        racks = [(f"rack {rack[0][0]}", sum(w for _, w in rack), _nodes([(f"shard {s}", w, F.lit(s)) for s, w in rack])) for rack in region]
        regions.append((f"region {region[0][0][0]}", sum(w for _, w, _ in racks), _nodes(racks)))
    return _pick(key, _pick(key, _pick(key, _nodes(regions)))).cast("int")


def shard_documents(docs: DataFrame, tree: Topology | None = None, doc_id: str = "doc_id") -> DataFrame:
    """All columns of ``docs`` and ``shard``, which replaces one of that name: a projection, without any shuffle."""
    return without(docs, "shard").withColumn("shard", shard_of(F.col(doc_id), tree or topology()))


def assign_slots(docs: DataFrame, tree: Topology | None = None, buckets: int = 1024) -> DataFrame:
    """The digest of the whole table: one row for each document, see ``op5_sharding``.

    A shard's slots are a two-level prefix sum: rows are counted by shard and hash
    bucket (24 * ``buckets`` counts, a fixed number, are broadcast), and numbered
    inside each bucket.  Repeated rows are one row with a count until they are
    numbered, so a hot key is never sorted in one task, and dealt in pieces when it is
    told apart again.
    """
    tree = tree or topology()
    digest = docs.select(
        F.col("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.encode(text_of(), "UTF-8")).cast("long").alias("text_crc32"),
    )
    rows = digest.groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("__n"))
    rows = cut(rows.withColumns({
        "shard": shard_of(F.col("doc_id"), tree),
        "grown_shard": shard_of(F.col("doc_id"), grow(tree)),
        "__b": F.pmod(F.xxhash64("doc_id", "size", "text_crc32", F.lit("slot")), F.lit(buckets)).cast("int"),
    }), "shards")
    counts = rows.groupBy("shard", "__b").agg(F.sum("__n").alias("__c"))
    over = Window.partitionBy("shard").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "__b", F.coalesce(F.sum("__c").over(over), F.lit(0)).alias("__start"))
    within = Window.partitionBy("shard", "__b").orderBy("doc_id", "size", "text_crc32").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("__before", F.coalesce(F.sum("__n").over(within), F.lit(0))).join(F.broadcast(starts), ["shard", "__b"])
    placed = cut(placed.select("doc_id", "size", "text_crc32", "shard", (F.col("__start") + F.col("__before")).alias("__first"), "__n", "grown_shard"), "slots")
    return copies(placed, "__n", "__i").select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("__first") + F.col("__i")).alias("slot"), "grown_shard")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards 0 to 23: two regions of three racks of four shards, law ``key``."""
    return assign_slots(read(spark, sf_dir, "documents"))
