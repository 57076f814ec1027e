"""Storage encodings as DataFrame functions; the physical encoding is Parquet's."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Texts and blobs of more bytes are stored once by content.
INTERN_BYTES = 16


def zigzag(v: Column) -> Column:
    """Signed to unsigned order: 0, -1, 1, -2, ... become 0, 1, 2, 3, ..."""
    return F.shiftleft(v, 1).bitwiseXOR(F.shiftright(v, 63))


def unzigzag(v: Column) -> Column:
    return F.shiftrightunsigned(v, 1).bitwiseXOR(-(v.bitwiseAND(F.lit(1).cast("long"))))


def uvarint_length(v: Column) -> Column:
    """Bytes of the LEB128 form of an unsigned number: seven bits a byte."""
    bits = F.length(F.bin(v))
    return F.ceil(bits / 7).cast("int")


def encode_uvarint(v: int) -> bytes:
    out = bytearray()
    while True:
        low, v = v & 0x7F, v >> 7
        out.append(low | (0x80 if v else 0))
        if not v:
            return bytes(out)


def decode_uvarint(data: bytes, at: int = 0) -> tuple[int, int]:
    """(value, next place)"""
    value = shift = 0
    while True:
        if at >= len(data) or shift > 63:
            raise ValueError("the number is cut off or too long")
        value |= (data[at] & 0x7F) << shift
        at, shift = at + 1, shift + 7
        if not data[at - 1] & 0x80:
            return value & (1 << 64) - 1, at


def _ranged(df: DataFrame, order: str) -> DataFrame:
    """Rows in ranges of ``order``, numbered by ``__p``: each range is a window, so that no task holds all rows."""
    return df.repartitionByRange(order).sortWithinPartitions(order).withColumn("__p", F.spark_partition_id())


def delta_z(df: DataFrame, value: str, order: str, part: str | None = None) -> DataFrame:
    """``dz``: the first value of each part, then zigzag differences to the value before.

    Without ``part`` the whole table is one: its ranges are taken as blocks of their own,
    told apart by ``__p``, as pages of a column file are.
    """
    ranged = _ranged(df, order) if part is None else df
    before = F.lag(value).over(Window.partitionBy(part or "__p").orderBy(order))
    return ranged.withColumn("dz", F.when(before.isNull(), F.col(value)).otherwise(zigzag(F.col(value) - before)))


def undelta_z(df: DataFrame, order: str, part: str | None = None) -> DataFrame:
    """``value`` from ``dz`` of the same parts; without ``part``, of the ranges that ``delta_z`` told."""
    over = Window.partitionBy(part or "__p").orderBy(order)
    step = F.when(F.row_number().over(over) == 1, F.col("dz")).otherwise(unzigzag(F.col("dz")))
    return df.withColumn("__s", step).withColumn("value", F.sum("__s").over(over.rowsBetween(Window.unboundedPreceding, 0))).drop("__s")


def bits_for_cardinality(n: Column) -> Column:
    """ceil(log2 n), from 1 to 8."""
    return F.greatest(F.lit(1), F.least(F.lit(8), F.when(n <= 1, F.lit(0)).otherwise(F.length(F.bin(n.cast("long") - 1))))).cast("int")


def pack_bits(values: list[int], width: int) -> bytes:
    """Least significant bit first."""
    packed = sum((v & (1 << width) - 1) << i * width for i, v in enumerate(values))
    return packed.to_bytes((len(values) * width + 7) // 8, "little")


def unpack_bits(data: bytes, width: int, count: int) -> list[int]:
    packed = int.from_bytes(data, "little")
    return [packed >> i * width & (1 << width) - 1 for i in range(count)]


def dictionary(df: DataFrame, value: str, order: str, most: int = 256) -> DataFrame | None:
    """(value, code): codes in order of first occurrence; none beyond ``most`` symbols."""
    first = df.groupBy(value).agg(F.min(order).alias("__first"))
    if first.limit(most + 1).count() > most:
        return None
    return first.withColumn("code", F.row_number().over(Window.orderBy("__first")) - 1).select(value, "code")


def encode_dictionary(df: DataFrame, value: str, order: str, most: int = 256) -> DataFrame | None:
    """Rows with ``code``; the dictionary is broadcast, as it has at most ``most`` rows."""
    codes = dictionary(df, value, order, most)
    return None if codes is None else df.join(F.broadcast(codes.withColumnRenamed(value, "__v")), F.col(value).eqNullSafe(F.col("__v"))).drop("__v")


def column_codec(df: DataFrame, column: str) -> str:
    """The encoding a column is best stored with: delta_z for integers, dictionary for few texts, else raw."""
    kind = df.schema[column].dataType.simpleString()
    if kind in ("tinyint", "smallint", "int", "bigint"):
        return "delta_z" if df.where(F.col(column).isNull()).limit(1).count() == 0 else "raw"
    if kind.startswith("decimal"):
        raise ValueError("decimals have no columnar encoding")
    return "dictionary" if kind == "string" and df.select(column).distinct().limit(257).count() <= 256 else "raw"


#: Rows of a transposed block.
BLOCK = 4096


def _encode_column(values: list, kind: str) -> tuple[str, bytes]:
    """(codec, data) of one column of a block: the shortest that its values allow."""
    if kind in ("tinyint", "smallint", "int", "bigint") and None not in values:
        out, before = bytearray(), 0
        for v in values:
            d = v - before
            out += encode_uvarint((d << 1) ^ (d >> 127))
            before = v
        return "delta_z", bytes(out)
    if kind == "string" and None not in values and len(symbols := list(dict.fromkeys(values))) <= 256:
        width = max(1, (len(symbols) - 1).bit_length())
        code = {s: i for i, s in enumerate(symbols)}
        head = b"".join(encode_uvarint(len(b)) + b for b in (s.encode() for s in symbols))
        return "dictionary", encode_uvarint(len(symbols)) + head + pack_bits([code[v] for v in values], width)
    if kind in ("string", "binary", "tinyint", "smallint", "int", "bigint"):
        out = bytearray()
        for v in values:
            b = v if isinstance(v, bytes) else str(v).encode()
            out += encode_uvarint(0) if v is None else encode_uvarint(len(b) + 1) + b
        return "raw", bytes(out)
    raise ValueError(f"a column of {kind} has no columnar encoding")


def _decode_column(codec: str, data: bytes, n: int, kind: str) -> list:
    at, out = 0, []
    if codec == "delta_z":
        before = 0
        for _ in range(n):
            z, at = decode_uvarint(data, at)
            before += (z >> 1) ^ -(z & 1)
            out.append(before)
        return out
    if codec == "dictionary":
        size, at = decode_uvarint(data)
        symbols = []
        for _ in range(size):
            length, at = decode_uvarint(data, at)
            symbols.append(data[at : at + length].decode())
            at += length
        return [symbols[c] for c in unpack_bits(data[at:], max(1, (size - 1).bit_length()), n)]
    for _ in range(n):
        length, at = decode_uvarint(data, at)
        b = data[at : at + length - 1] if length else None
        at += max(0, length - 1)
        out.append(None if b is None else b if kind == "binary" else b.decode() if kind == "string" else int(b))
    return out


def transpose(df: DataFrame, order: str, block: int = BLOCK) -> DataFrame:
    """(part, block, column, name, codec, n, data): rows in order, by blocks, a value list for each column.

    A block is encoded where it is read; decimals are refused, as they have no encoding.
    """
    kinds = [f.dataType.simpleString() for f in df.schema.fields]
    for k in kinds:
        if k not in ("string", "binary", "tinyint", "smallint", "int", "bigint"):
            raise ValueError(f"a column of {k} has no columnar encoding")
    names = df.columns
    ranged = _ranged(df, order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = 0
        for batch in batches:
            part = batch.column(len(names))
            for lo in range(0, batch.num_rows, block):
                rows = batch.slice(lo, block)
                coded = [_encode_column(rows.column(i).to_pylist(), kinds[i]) for i in range(len(names))]
                n = len(names)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part[lo].as_py()] * n, pa.int32()), pa.array([at] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array(names), pa.array([c for c, _ in coded]), pa.array([rows.num_rows] * n, pa.int32()), pa.array([d for _, d in coded], pa.binary())],
                    ["part", "block", "column", "name", "codec", "n", "data"],
                )
                at += 1

    return ranged.mapInArrow(run, "part int, block long, column int, name string, codec string, n int, data binary")


def untranspose(blocks: DataFrame, schema: str) -> DataFrame:
    """The rows of ``transpose``; ``schema`` is that of the table."""
    kinds = [f.dataType.simpleString() for f in StructType.fromDDL(schema).fields]
    arrow = {"string": pa.string(), "binary": pa.binary(), "tinyint": pa.int8(), "smallint": pa.int16(), "int": pa.int32(), "bigint": pa.int64()}
    names = [f.name for f in StructType.fromDDL(schema).fields]

    def run(table: pa.Table) -> pa.Table:
        own = {r["column"]: r for r in table.to_pylist()}
        return pa.table({n: pa.array(_decode_column(own[i]["codec"], own[i]["data"], own[i]["n"], k), arrow[k]) for i, (n, k) in enumerate(zip(names, kinds, strict=True))})

    return blocks.groupBy("part", "block").applyInArrow(run, schema)


def content_blobs(df: DataFrame, value: str) -> DataFrame:
    """Each distinct content once: sha256, length, copies; partial aggregation keeps copies from the shuffle."""
    data = F.encode(F.col(value), "UTF-8") if df.schema[value].dataType.simpleString() == "string" else F.col(value)
    hashed = df.where(F.col(value).isNotNull()).select(F.sha2(data, 256).alias("sha256"), F.length(data).cast("long").alias("n_bytes"))
    return hashed.where(F.col("n_bytes") > INTERN_BYTES).groupBy("sha256", "n_bytes").agg(F.count(F.lit(1)).alias("copies"))


def dedup_ratio(df: DataFrame, value: str) -> DataFrame:
    """One row: blobs, stored and logical bytes."""
    return content_blobs(df, value).agg(F.count(F.lit(1)).alias("n_blobs"), F.coalesce(F.sum("n_bytes"), F.lit(0)).alias("stored_bytes"), F.coalesce(F.sum(F.col("n_bytes") * F.col("copies")), F.lit(0)).alias("logical_bytes"))
