"""Operator 6: mixing sources to target weights by weighted fair queueing (native).

Documents of a source queue in a shuffled order, by a hash of id and text.  A document
finishes at the virtual time ``cumulative words of its source / target of its
source``; a second pass over a source continues where the first ended, so that every pass
of every document has a finish time of its own.  All of them are sorted by it, one
range sort over all sources, and the sorted list is truncated at the total budget, the
sum of the targets: the running total is that of whole range partitions and, in the
partition that the budget falls into, of rows.  What the budget ends in is taken in part.

All sources reach their targets at virtual time 1, and most of them serve a document
then that finishes later.  Left whole, a very long one would wait behind shorter ones of
other sources until the budget is gone, and cost its source as much as its length.  It is
sorted as two packets, cut at its source's target, each with the finish time of
its own words: a source then gets its target to within as many words as there are sources.

Hot keys: a source's queue is a two-level prefix sum, by hash bucket and within it.  Rows
that repeat in id, source and text are one row with a count until they are told
apart, other rows have hashes of their own, whatever their id.

Edge cases: a null source is a source of its own and the last; null and empty texts
have size 0 and are taken zero times; a source of size 0 has target 0; an empty
table gives no rows; null ids are ids like any other; of equal finish times the earlier
source and place goes first; extra columns are ignored by ``plan_mix`` and kept by
``mix_documents``, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD_RE, col, copies, cut, discard, fresh, read, shuffled, text_of

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
SEED = "mix-1"


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD_RE)).cast("long")


def _shuffle_key(doc_id: Column, text: Column) -> Column:
    return F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(f"|{SEED}|"), text))


def _sorted(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``rows`` range-sorted and written, with the number ``p`` of the range of each."""
    return cut(rows.orderBy(*order).withColumn("p", F.spark_partition_id()), name)


def _running(rows: DataFrame, order: list[Column], sums: dict[str, str], name: str) -> DataFrame:
    """Exclusive running sums, ``sums`` of (new name, column), in a global order.

    The window over ranges has one row for each range, the one within a range its rows.
    """
    table = _sorted(rows, order, name)
    before = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    starts = table.groupBy("p").agg(*[F.sum(c).alias(n) for n, c in sums.items()]).select("p", *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"{n}_p") for n in sums])
    inside = Window.partitionBy("p").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    table = table.withColumns({n: F.coalesce(F.sum(c).over(inside), F.lit(0)) for n, c in sums.items()})
    return table.join(F.broadcast(starts), "p").select(*rows.columns, *[(F.col(n) + F.col(f"{n}_p")).alias(n) for n in sums])


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """Targets from (source, source_size): water filling in closed form.

    With sources in order of cap / weight, the level after capping the first k is
    (budget - their caps) / (weights of the others); the highest level that doesn't pass
    its source's ratio is the answer.  Places and sums come from range sorts, for
    any number of sources.
    """
    by_name = F.col("source").asc_nulls_last()
    one = sizes.select("source", "source_size", F.lit(1).cast("long").alias("one"))
    w = _running(one, [by_name], {"i": "one"}, "mix-sources").withColumn("w", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("i") % len(weights) + 1).cast("int")))
    w = w.select("source", "source_size", "w", (F.lit(float(most)) * F.col("source_size")).alias("cap"))
    w = cut(w.withColumn("ratio", F.col("cap") / F.col("w")), "mix-weights")
    total, all_weights = w.agg(F.sum("source_size"), F.sum("w")).first()
    level = _running(w, [F.col("ratio"), by_name], {"caps": "cap", "lighter": "w"}, "mix-levels")
    level = level.withColumn("level", (F.lit(share * (total or 0)) - F.col("caps")) / (F.lit(all_weights or 0.0) - F.col("lighter")))
    final = level.agg(F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level")))).first()[0]
    return w.select("source", "source_size", F.coalesce(F.least("cap", F.lit(final).cast("double") * F.col("w")), F.col("cap")).alias("target"))


def _queues(docs: DataFrame, buckets: int, weights: tuple[int, ...], share: float, most: int) -> tuple[DataFrame, int]:
    """(doc_id, source, size, s, n, source_size, target, begin) of each different row, n its number, and the total budget in words."""
    digest = docs.select("doc_id", "source", n_words(text_of()).alias("size"), _shuffle_key(F.col("doc_id"), text_of()).alias("s"))
    rows = digest.groupBy("doc_id", "source", "size", "s").agg(F.count(F.lit(1)).alias("n"))
    rows = cut(rows.withColumn("b", F.pmod(F.conv(F.substring("s", 1, 8), 16, 10).cast("long"), F.lit(buckets)).cast("int")), "mix")
    counts = cut(rows.groupBy("source", "b").agg(F.sum(F.col("size") * F.col("n")).alias("c")), "mix-counts")
    sizes = cut(counts.groupBy("source").agg(F.sum("c").alias("source_size")), "mix-sizes")
    goal = cut(targets(sizes, weights, share, most), "mix-targets")
    before = Window.partitionBy("source").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("start", F.coalesce(F.sum("c").over(before), F.lit(0)))
    # One row for each source and bucket: joined by key, as the number of sources has no proven bound.
    starts = starts.alias("a").join(goal.alias("g"), F.expr("a.source <=> g.source")).select("a.source", "b", "start", "source_size", "target")
    within = Window.partitionBy("source", "b").orderBy("s", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("inner", F.coalesce(F.sum(F.col("size") * F.col("n")).over(within), F.lit(0)))
    placed = placed.alias("r").join(starts.alias("t"), F.expr("r.source <=> t.source AND r.b = t.b")).select("r.doc_id", "r.source", "r.size", "r.s", "r.n", "t.source_size", "t.target", (F.col("start") + F.col("inner")).alias("begin"))
    out = cut(placed, "mix-queues")
    total = sizes.agg(F.sum("source_size")).first()[0] or 0
    discard(rows, counts, sizes, goal)
    return out, int(min(share, most) * total)


def _passes(queues: DataFrame, most: int) -> DataFrame:
    """The columns of ``queues`` for each copy, ``first`` its place in the queue, and ``passes``, an array of (finish, last, source, at): the order of service."""
    each = copies(queues, "n", "c").withColumn("first", F.col("begin") + F.col("c") * F.col("size"))
    at = lambda p: F.col("first") + p * F.col("source_size")
    passes = F.array(*[_key(at(F.lit(p).cast("long")), F.col("size")) for p in range(most)])
    return each.withColumn("passes", F.when((F.col("size") > 0) & (F.col("target") > 0), passes))


def _key(at: Column, words: Column) -> Column:
    return F.struct(((at + words) / F.col("target")).alias("finish"), F.col("source").isNull().alias("last"), F.col("source").alias("source"), at.alias("at"))


_ORDER = ["finish", "last", "source", "at"]


def _packets(at: Column) -> list[tuple[Column, Column]]:
    """(key, words) of the part of a pass before the source's target and of that behind it; either can have no words."""
    before = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.floor("target") - at))
    return [(_key(at, before), before), (_key(at + before, F.col("size") - before), F.col("size") - before)]


def _truncation(queues: DataFrame, budget: int, most: int) -> tuple[Column, Column] | None:
    """(key, words) of the packet in which the sorted list reaches the budget, and what is taken of it; none if it never does."""
    packets = F.flatten(F.transform("passes", lambda x: F.array(*[F.struct(k.alias("k"), w.alias("words")) for k, w in _packets(x["at"])])))
    rows = _passes(queues, most).select(F.inline(packets)).where("words > 0").select("k.*", "words")
    table = _sorted(rows, _ORDER, "mix-order")
    # One total for each range: as many rows as the sort has partitions.
    left = budget
    for p, words in sorted(table.groupBy("p").agg(F.sum("words")).collect()):
        if words >= left:
            break
        left -= words
    else:
        discard(table)
        return None
    upto = Window.partitionBy("p").orderBy(*_ORDER).rowsBetween(Window.unboundedPreceding, 0)
    last = table.where(F.col("p") == p).withColumn("run", F.sum("words").over(upto)).where(F.col("run") >= left).orderBy("run").first()
    discard(table)
    kind = queues.schema["source"].dataType
    key = F.struct(F.lit(last["finish"]).alias("finish"), F.lit(last["last"]).alias("last"), F.lit(last["source"]).cast(kind).alias("source"), F.lit(last["at"]).cast("long").alias("at"))
    return key, F.lit(left - last["run"] + last["words"]).cast("long")


def _served(end: tuple[Column, Column] | None):
    """The words taken of a pass."""
    def of(key: Column, words: Column) -> Column:
        return words if end is None else F.when(key < end[0], words).when(key == end[0], end[1]).otherwise(F.lit(0).cast("long"))

    return lambda x: sum((of(*packet) for packet in _packets(x["at"])), F.lit(0).cast("long"))


def plan_mix(docs: DataFrame, buckets: int = 1024, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, virtual_finish: one row for each document.

    ``virtual_finish`` is the time at which the document's first pass ends.
    """
    queues, budget = _queues(docs, buckets, weights, share, most)
    served = _served(_truncation(queues, budget, most))
    taken = F.aggregate(F.transform("passes", served), F.lit(0).cast("long"), lambda a, x: a + x)
    return _passes(queues, most).select(
        "doc_id", "source", "size", "source_size", "target", F.coalesce(taken, F.lit(0)).cast("long").alias("taken"),
        F.when(F.col("target") > 0, (F.col("first") + F.col("size")) / F.col("target")).alias("virtual_finish"),
    )


def mix_documents(docs: DataFrame, buckets: int = 1024, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """The mix itself: rows of ``docs`` in order of virtual finish time, one for each copy taken.

    The copy that the budget cuts stays whole if at least half of it fits, else it is
    left out.  The order is a range sort, so the rows of a partition precede those of
    the next.  Rows that agree in id, source and text are one document written several
    times; where their other columns differ, the row of the least hash stands for all.
    """
    queues, budget = _queues(docs, buckets, weights, share, most)
    served = _served(_truncation(queues, budget, most))
    chosen = F.filter("passes", lambda key: 2 * served(key) >= F.col("size"))
    mix = _passes(queues, most).select("s", F.col("source").alias("of"), F.inline(chosen)).drop("source")
    s, of, finish, last, at, row = fresh(docs.columns, "s", "of", "finish", "last", "at", "row")
    mix = mix.toDF(s, of, finish, last, at)
    names, key = docs.columns, _shuffle_key(F.col("doc_id"), text_of())
    single = docs.withColumn(s, key)
    many = queues.where("n > 1").select(F.col("s").alias("s2"), F.col("source").alias("source2"))
    if many.limit(1).count():
        # Documents written several times go through a combinable aggregate to one row each.
        there = (F.col(s) == F.col("s2")) & F.col("source").eqNullSafe(F.col("source2"))
        hashed = F.xxhash64(*[col(f.name) for f in docs.schema.fields if "map<" not in f.dataType.simpleString()])
        repeated = single.join(many, there, "left_semi").groupBy(s, "source").agg(F.min_by(F.struct(*map(col, names)), hashed).alias(row)).select(*[F.col(row)[n].alias(n) for n in names], s)
        single = single.join(many, there, "left_anti").unionAll(repeated)
    joined = shuffled(single).join(mix, (single[s] == mix[s]) & F.col("source").eqNullSafe(F.col(of))).drop(mix[s])
    return joined.orderBy(finish, last, "source", at).select(*map(col, names))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with size, target of the source and the words taken of each."""
    return plan_mix(read(spark, sf_dir, "documents"))


OP6_SQL = f"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
         md5(concat(coalesce(CAST(doc_id AS VARCHAR), 'null'), '|{SEED}|', coalesce(text, ''))) AS s
  FROM documents),
b AS (SELECT *, row_number() OVER () AS rid, CAST(concat('0x', substr(s, 1, 8)) AS BIGINT) % 1024 AS bucket FROM d),
t AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CAST([3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS w,
             CAST(2.0 * source_size AS DOUBLE) AS cap, CAST(1.5 * sum(source_size) OVER () AS DOUBLE) AS budget FROM t),
l AS (SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev FROM w),
f AS (SELECT *, max(CASE WHEN lev <= cap / w THEN lev END) OVER () AS fin FROM l),
g AS (SELECT source, source_size, coalesce(least(cap, fin * w), cap) AS target FROM f),
c AS (SELECT b.rid, b.doc_id, b.source, b.size, g.source_size, g.target,
             coalesce(sum(size) OVER (PARTITION BY b.source ORDER BY b.bucket, b.s, b.doc_id, b.size, b.rid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
      FROM b JOIN g ON b.source IS NOT DISTINCT FROM g.source),
e AS (SELECT rid, source, target, size, start + p * source_size AS place, greatest(0, least(size, CAST(floor(target) AS BIGINT) - start - p * source_size)) AS inside
      FROM c CROSS JOIN (SELECT unnest([0, 1]) AS p) WHERE size > 0 AND target > 0),
q AS (SELECT rid, source, inside AS words, place, CAST(place + inside AS DOUBLE) / target AS finish FROM e WHERE inside > 0
      UNION ALL SELECT rid, source, size - inside, place + inside, CAST(place + size AS DOUBLE) / target FROM e WHERE inside < size),
r AS (SELECT rid, words, sum(words) OVER (ORDER BY finish, source NULLS LAST, place ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM q),
k AS (SELECT rid, sum(greatest(0, least(words, (SELECT floor(1.5 * sum(size)) FROM d) - run + words))) AS taken FROM r GROUP BY rid)
SELECT doc_id, source, size, source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken,
       CASE WHEN target > 0 THEN CAST(start + size AS DOUBLE) / target END AS virtual_finish
FROM c LEFT JOIN k USING (rid)
"""
