"""Bitmaps of 64-bit values, which tell a scan what can matter.

They only save work: whatever passes a bitmap is joined or counted exactly
afterwards.  The number of bits follows the number of values between 2^26 (8 MB) and
2^29 (64 MB), the bound of what is broadcast; with more values than that ever fewer
are told apart, and the exact join that follows does the work alone.

Bits are set and packed to pages of 8 KB on the executors; the driver gets at most 8192
pages as Arrow batches and never a row for each value.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, discard

LEAST, MOST = 26, 29
_PAGE = 1024  # words of 64 bits


class Bitmap:
    def __init__(self, words: np.ndarray):
        self.words = words

    def has(self, values: np.ndarray) -> np.ndarray:
        """Whether the bit of each 64-bit value is set."""
        slot = values.view(np.uint64) & np.uint64(len(self.words) * 64 - 1)
        return ((self.words[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1)).astype(bool)


def _pack(table: pa.Table) -> pa.Table:
    page = np.zeros(_PAGE, np.uint64)
    page[table.column("w").to_numpy() & (_PAGE - 1)] = table.column("b").to_numpy().view(np.uint64)
    return pa.table({"p": table.column("p").slice(0, 1), "page": pa.array([page.tobytes()], pa.binary())})


def bitmap(values: DataFrame):
    """A broadcast ``Bitmap`` of the longs ``v``; call ``destroy()`` when what reads it is written."""
    spark = values.sparkSession
    table = cut(values.select("v"), "values")
    bits = min(MOST, max(LEAST, (8 * table.count()).bit_length()))
    slot = F.col("v").bitwiseAND(F.lit((1 << bits) - 1))
    words = table.select(F.shiftright(slot, 6).cast("int").alias("w"), F.expr("shiftleft(1L, cast(v & 63 as int))").alias("b"))
    words = words.withColumn("p", F.shiftright("w", 10)).repartition("p").groupBy("p", "w").agg(F.bit_or("b").alias("b"))
    pages = words.groupBy("p").applyInArrow(_pack, "p int, page binary").toArrow()
    discard(table)
    found = np.zeros(1 << (bits - 6), np.uint64)
    for p, page in zip(pages.column(0).to_pylist(), pages.column(1), strict=True):
        found[p * _PAGE : (p + 1) * _PAGE] = np.frombuffer(page.as_buffer(), np.uint64)
    return spark.sparkContext.broadcast(Bitmap(found))
