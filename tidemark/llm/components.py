"""Connected components of an undirected graph, without collecting any of it.

Each task first replaces blocks of the edges that it has by their forest, a star for
each component of the block, which links the same nodes.  Up to ``EDGES`` edges that are
left are settled the same way by one task.  More are contracted by large stars and small
stars (Kiveris et al., 2014): each round is two joins against per-node minima.  The
minima are combined on the map side and the joins are plain equi-joins whose skew AQE
can split, so a node with very many neighbours is no single task.  Each round is written
to shared storage.  Rounds are many executions of the driver, which keeps the plans,
threads and code of each; few edges aren't worth them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, discard, shuffled

EDGES = 1 << 21


def roots(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) of every node of the edges; the root is the least node reached."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b, root = at[: len(u)], at[len(u) :], np.arange(len(nodes))
    while True:  # of the roots that edges join, each that isn't the least of its neighbours is hooked below one: at least half of them
        a, b = root[a], root[b]
        a, b = np.minimum(a, b)[a != b], np.maximum(a, b)[a != b]
        if not len(a):
            return nodes, nodes[root]
        np.minimum.at(root, b, a)
        while (root[root] != root).any():
            root = root[root]


def _forests(most: int | None):
    """Rows (u, v), u > v, of the forests of blocks of about ``most`` edges; without it, of all edges as one."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            node, root = roots(*map(np.concatenate, zip(*held, strict=True)))
            u, v = node[node != root], root[node != root]
            held.clear()
            for lo in range(0, len(u), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(u[lo : lo + (1 << 16)]), pa.array(v[lo : lo + (1 << 16)])], ["u", "v"])

        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            if most and sum(len(x) for x, _ in held) >= most:
                yield from flush()
        if held:
            yield from flush()

    return run


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One half round over undirected (u, v) pairs; returns pairs (u > v)."""
    if large:
        both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    near = shuffled(both).join(least, "u")
    if large:
        out = near.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = near.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
    return out.where("u != v").distinct()


def connected_components(edges: DataFrame, most: int = EDGES) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v), longs, but roots; the root is the least node reached.

    Nodes without an edge to another node aren't listed. No edges: no rows.
    """
    now = cut(edges.select("u", "v").where("u != v").mapInArrow(_forests(EDGES // 2), "u long, v long"), "edges")
    if now.count() <= most:
        before, now = now, cut(now.coalesce(1).mapInArrow(_forests(None), "u long, v long"), "edges")
        discard(before)
        return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    seen = None
    while True:  # settles after a number of rounds that grows with the logarithm of the nodes
        before, now = now, cut(_star(_star(now, True), False), "edges")
        discard(before)
        mark = now.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))"), F.sum(F.col("v").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        seen = mark
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
