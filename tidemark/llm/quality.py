"""Operator 10: quality rules by a hashed n-gram log-likelihood ratio (native).

Two multinomials over ``BUCKETS`` hash buckets of word uni- and bigrams: one of the
raw corpus (counted over all documents), one of a trusted target (all documents whose
label says quality 1).  With add-one smoothing, a document's verdict is its mean
``ln(p_target / p_raw)`` over its n-grams against a fixed threshold: no random draw.

Everything is built-in JVM expressions; the counts that reach the driver are
``BUCKETS`` rows whatever the input's size, and the ratio goes back as a literal.

Edge cases: null and empty texts have no words, all counts are zero and base_failed
is true; ties on the threshold are kept; repeated rows get equal results; an empty
table gives no rows; very long texts are scored whole; without any label the ratio
is zero everywhere and the base rules decide; extra columns are kept by
``score_quality``, but for those named like one that it adds, which is put in their place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE_RE, WORD_RE, col, fresh, read, text_of, without

BUCKETS = 16384  # a power of two: a bucket is the low bits of a hash
THRESHOLD = -0.08
WINDOW = 8
BROADCAST_IDS = 500_000


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE_RE, -1), "")


def _joined(h: Column, step: int) -> Column:
    """Hashes of h[i] and h[i + step], for all i that have both."""
    n = F.greatest(F.size(h) - step, F.lit(0))
    return F.zip_with(F.slice(h, F.lit(1), n), F.slice(h, F.lit(1 + step), n), lambda x, y: F.xxhash64(x, y))


def word_hashes(docs: DataFrame, words: str, one: str, two: str) -> DataFrame:
    """``docs`` with its words, and the hashes of words and of pairs of neighbouring words."""
    return docs.withColumn(words, words_of(text_of())).withColumn(one, F.transform(words, lambda w: F.xxhash64(w))).withColumn(two, _joined(F.col(one), 1))


def ngram_ratio(docs: DataFrame, labels: DataFrame) -> list[float]:
    """ln(p_target / p_raw) for each bucket."""
    best = labels.where("quality = 1 AND doc_id IS NOT NULL").select("doc_id").distinct().withColumn("t", F.lit(1))
    # Broadcast up to a number of ids; beyond it texts are shuffled once by id.
    best = F.broadcast(best) if best.count() <= BROADCAST_IDS else best.hint("merge")
    known = docs.where("doc_id IS NOT NULL").select("doc_id", "text").join(best, "doc_id", "left")
    marked = known.unionByName(docs.where("doc_id IS NULL").select("doc_id", "text").withColumn("t", F.lit(None).cast("int")))  # not all in one task
    grams = word_hashes(marked, "w", "one", "two").select("t", F.explode(F.concat("one", "two")).alias("g")).select("t", F.col("g").bitwiseAND(F.lit(BUCKETS - 1)).alias("g"))
    counts = grams.groupBy("g").agg(F.count(F.lit(1)).alias("raw"), F.count("t").alias("good")).collect()
    raw, good = [0] * BUCKETS, [0] * BUCKETS
    for r in counts:
        raw[r["g"]], good[r["g"]] = r["raw"], r["good"]
    if not sum(good):
        return [0.0] * BUCKETS
    from math import log

    total_raw, total_good = sum(raw) + BUCKETS, sum(good) + BUCKETS
    return [log((g + 1) / total_good) - log((r + 1) / total_raw) for g, r in zip(good, raw, strict=True)]


def _repeated(windows: Column) -> Column:
    """The number of words that windows with an equal one cover; for documents that have such."""
    placed = F.sort_array(F.transform(windows, lambda x, i: F.struct(x.alias("v"), i.alias("i"))))

    def places(v: Column) -> Column:
        same = lambda x, i: F.coalesce(F.get(v, i - 1)["v"] == x["v"], F.lit(False)) | F.coalesce(F.get(v, i + 1)["v"] == x["v"], F.lit(False))
        return F.sort_array(F.transform(F.filter(v, same), lambda x: x["i"]))

    def covered(p: Column) -> Column:
        return F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW)))), F.lit(0).cast("long"), lambda a, x: a + x)

    # A lambda over a one-element array names a value that is used several times.
    return F.transform(F.array(F.transform(F.array(placed), places)[0]), covered)[0]


OUT = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr"]


def score_quality(docs: DataFrame, ratio: list[float], threshold: float = THRESHOLD) -> DataFrame:
    """All columns of ``docs``, the base counts, base_failed, llr and kept. No shuffle.

    A column of ``docs`` that has the name of an added one is replaced by it.
    """
    table = F.expr("array(" + ",".join(f"{x!r}D" for x in ratio) + ")")
    docs = without(docs, *OUT)
    words, one, two, four, eight, own = fresh(docs.columns, "words", "one", "two", "four", "eight", "own")
    text = text_of()
    d = word_hashes(docs, words, one, two)
    d = d.withColumn("n_words", F.size(words).cast("long"))
    d = d.withColumn("word_chars", F.length(F.array_join(words, "")).cast("long"))
    d = d.withColumn("n_symbols", F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long"))
    d = d.withColumn(own, F.filter(F.split(text, "\n", -1), lambda x: F.rlike(x, F.lit(WORD_RE))))
    d = d.withColumn("n_dup_lines", (F.size(own) - F.size(F.array_distinct(own))).cast("long"))
    score = lambda a, x: a + F.get(table, x.bitwiseAND(F.lit(BUCKETS - 1)).cast("int"))
    d = d.withColumn("llr", F.aggregate(two, F.aggregate(one, F.lit(0.0), score), score) / F.greatest(F.size(one) + F.size(two), F.lit(1)))
    # Windows of 8 words by doubling; their places are sorted only where two are equal.
    d = d.withColumn(four, _joined(F.col(two), 2)).withColumn(eight, _joined(F.col(four), 4))
    d = d.withColumn("n_repeat_words", F.when(F.size(eight) > F.size(F.array_distinct(eight)), _repeated(F.col(eight))).otherwise(F.lit(0).cast("long")))
    d = d.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))
    d = d.withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= threshold))
    return d.select(*map(col, docs.columns), *OUT)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base rules and the log-likelihood verdict for all documents."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    ratio = ngram_ratio(docs, read(spark, sf_dir, "labels"))
    return score_quality(docs, ratio).drop("text")
