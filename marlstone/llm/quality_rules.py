"""Operator 10 (native): quality rules with a hashed n-gram log-likelihood ratio.

Two multinomials over hashed n-grams (``buckets`` for each order) are counted over whole tables: the trusted target
(documents labelled quality 1) and the raw corpus (all documents). A document's score is the mean of
log p_target - log p_raw over its n-grams, so length does not count; it is kept if the base rules hold and the score
reaches ``threshold``. Everything is built-in expressions. The wide steps are the join that finds the target and the count
of at most ``len(orders) * buckets`` groups; the weights are one array of that length, and documents are judged row by
row, without a shuffle.

Defined results: null and empty texts have zero counts, fail the base rules and score 0; a score equal to the threshold
keeps; repeated rows are judged one by one; a document with several labels is in the target if any of them is 1; with no
labels at all the target is the raw corpus, so every score is 0; texts are read whole, of any length; an empty table
gives no rows; only ``doc_id`` and ``text`` are read, so other columns can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.common import let, unused

WORD_BREAK = "[\\x20\\x09-\\x0D]+"
BUCKETS = 32768
ORDERS = (1, 2)
#: Mean log-likelihood ratio a document must reach.
THRESHOLD = -0.2
#: Weights are whole multiples of 1 / SCALE.
SCALE = 1_000_000


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WORD_BREAK), "")


def positions(n: Column, width: int) -> Column:
    """Starts of windows of ``width`` over ``n`` elements."""
    return F.when(n >= width, F.sequence(F.lit(0), n - width)).otherwise(F.array().cast("array<int>"))


def gram_hashes(hashes: Column, width: int) -> Column:
    if width == 1:
        return hashes
    return F.transform(positions(F.size(hashes), width), lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(width)]))


def hash_words(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def buckets_of(hashes: Column, orders: tuple[int, ...] = ORDERS, buckets: int = BUCKETS) -> Column:
    """Bucket numbers of all n-grams; each order has its own range."""
    def numbered(h: Column) -> Column:
        def of_order(k: int, n: int) -> Column:
            return F.transform(gram_hashes(h, n), lambda x: (F.pmod(x, F.lit(buckets)) + k * buckets).cast("int"))

        parts = [of_order(k, n) for k, n in enumerate(orders)]
        return F.concat(*parts) if len(parts) > 1 else parts[0]

    return let(hashes, numbered)


def repeated_words(hashes: Column, width: int = 5) -> Column:
    """Words inside windows of ``width`` words that occur twice or more in the text."""

    def counted(grams: Column) -> Column:
        def covered(order: Column) -> Column:
            def shared(x: Column, j: Column) -> Column:
                after = F.get(order, j + 1)["h"].eqNullSafe(x["h"])
                return after | ((j > 0) & F.get(order, F.greatest(j - 1, F.lit(0)))["h"].eqNullSafe(x["h"]))

            twice = F.filter(order, shared)
            starts = F.sort_array(F.transform(twice, lambda x: x["i"]))
            return let(
                starts,
                lambda p: F.aggregate(
                    F.transform(p, lambda x, j: F.least(F.lit(width), F.coalesce(F.get(p, j + 1) - x, F.lit(width)))), F.lit(0).cast("long"), lambda a, x: a + x
                ),
            )

        pairs = F.sort_array(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(grams)) == F.size(grams), F.lit(0).cast("long")).otherwise(let(pairs, covered))

    return let(gram_hashes(hashes, width), counted)


def base_features(text: Column, words: Column, hashes: Column) -> list[Column]:
    whole = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    return [
        F.size(words).cast("long").alias("n_words"),
        F.length(F.translate(whole, " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length(whole) - F.length(F.translate(whole, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeated_words(hashes).alias("n_repeat_words"),
    ]


def fit_weights(docs: DataFrame, labels: DataFrame, orders: tuple[int, ...] = ORDERS, buckets: int = BUCKETS) -> DataFrame:
    """``bucket, weight``: log p_target - log p_raw in units of 1 / SCALE, with add-one smoothing."""
    target = labels.filter(F.col("quality") == 1).select("doc_id").distinct().withColumn("target", F.lit(1))
    # a broadcast of few labels would turn into this join as they grow; texts move once at any size
    marked = docs.select("doc_id", "text").join(target.hint("merge"), "doc_id", "left")
    each = marked.select(F.col("target"), F.explode(buckets_of(hash_words(words_of(F.col("text"))), orders, buckets)).alias("bucket"))
    counts = each.groupBy("bucket").agg(F.count("*").alias("raw"), F.count("target").alias("target"))
    size = len(orders) * buckets
    dense = docs.sparkSession.range(0, size, 1, 4).select(F.col("id").cast("int").alias("bucket")).join(counts, "bucket", "left").fillna(0, ["raw", "target"])
    order = (F.col("bucket") / buckets).cast("int")
    totals = dense.groupBy(order.alias("o")).agg(F.sum("raw").alias("all_raw"), F.sum("target").alias("all_target"))
    with_totals = dense.withColumn("o", order).join(totals, "o")
    weight = F.when(F.col("all_target") == 0, F.lit(0.0)).otherwise(
        F.log((F.col("target") + 1) / (F.col("all_target") + buckets)) - F.log((F.col("raw") + 1) / (F.col("all_raw") + buckets))
    )
    return with_totals.select("bucket", F.round(weight * SCALE).cast("long").alias("weight"))


def judge(docs: DataFrame, weights: DataFrame, keys: tuple[str, ...] = ("doc_id",), orders: tuple[int, ...] = ORDERS, buckets: int = BUCKETS, threshold: float = THRESHOLD) -> DataFrame:
    """For each row of ``docs``: ``keys``, the base features, ``base_failed``, ``score`` and ``kept``."""
    # one array of len(orders) * buckets whole numbers, made once; sums of whole numbers don't depend on order
    table = weights.agg(F.transform(F.sort_array(F.collect_list(F.struct("bucket", "weight"))), lambda x: x["weight"].cast("int")).alias("w")).scalar()
    name = unused("weights", docs.columns)

    def features(words: Column, hashes: Column) -> Column:
        grams = buckets_of(hashes, orders, buckets)
        totals = let(grams, lambda g: F.struct(F.size(g).alias("n"), F.aggregate(g, F.lit(0).cast("long"), lambda a, b: a + F.get(F.col(name), b)).alias("sum")))
        return F.struct(*base_features(F.col("text"), words, hashes), totals.alias("grams"))

    found = docs.withColumn(name, table).select(*keys, let(words_of(F.col("text")), lambda w: let(hash_words(w), lambda h: features(w, h))).alias("f")).select(*keys, "f.*")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    score = F.when(F.col("grams.n") > 0, F.col("grams.sum") / SCALE / F.col("grams.n")).otherwise(F.lit(0.0))
    out = found.withColumn("base_failed", failed).withColumn("score", score)
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold)).drop("grams")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = judge(docs, fit_weights(docs, labels))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")
