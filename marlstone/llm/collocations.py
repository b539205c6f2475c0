"""Operator 13: phrases of two to four words, mined level by level.

Level k counts only those runs of k words whose two overlapping runs of k - 1 words are frequent, since no other run can be:
the frequent runs of the level before reach the tasks as a Bloom filter of ``BITS`` bits, a fixed 8 MB whatever their number.
What the filter lets through by mistake is counted exactly and dropped by its count, so the result does not depend on the
filter; one that fills up costs time only. Tasks count in dictionaries of at most ``COUNTED`` runs, then runs are summed by
(language, run). Cuts and containments are scored from the level tables, without the texts.

Words and pieces are found in UTF-8 bytes, whose letters A to Z are lower-cased. Products are decimals of 38 digits.

Defined results: null texts are empty, a null lang is ``und`` and one with that name; texts without words count nothing;
repeated rows count one by one; texts are read whole, of any length; phrases with equal score and count are ordered by UTF-8;
an empty table gives no rows; only ``text`` and ``lang`` are read, so other columns can't clash.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.llm.common import materialize, remove
from marlstone.llm.hashing import WordHashes, run_hashes

LEAST = 30
LONGEST = 4
TOP = 2000
#: Percent of a phrase's occurrences that a longer phrase must cover to replace it.
COVERED = 80
BITS = 1 << 26
#: Runs a task counts before it writes them out.
COUNTED = 400_000
#: Bytes of text whose runs are hashed at once.
CHUNK = 4 << 20
#: Letters are lowered, tabs are spaces, and what ends a piece is a full stop.
_TABLE = bytes(0x20 if c == 0x09 else 0x2E if c in b".,;:!?\n\x0b\x0c\r" else c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))
_END = b"."
COUNTS = "lang string, phrase string, n long"


def tokens_of(text: str) -> list[bytes]:
    """A text's words, with ``_END`` between pieces and after the last one."""
    return [w for w in text.encode("utf-8", "surrogatepass").translate(_TABLE).replace(_END, b" . ").split(b" ") if w] + [_END]


def _start(lang: str, hashes: WordHashes) -> int:
    return hashes["\0" + lang]


def _slots(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return h & np.uint64(BITS - 1), (h >> np.uint64(34)) & np.uint64(BITS - 1)


def _in_filter(h: np.ndarray, held: np.ndarray) -> np.ndarray:
    one, two = _slots(h)
    bit = lambda s: (held[(s >> np.uint64(3)).astype(np.int64)] >> (s & np.uint64(7)).astype(np.uint8)) & 1
    return (bit(one) & bit(two)).astype(bool)


def _runs(tokens: list[bytes], lang: str, width: int, held: np.ndarray | None, hashes: WordHashes) -> list[bytes]:
    """The runs of ``width`` words, within pieces, whose shorter runs the filter holds."""
    if held is None:
        return [w for w in tokens if w != _END]
    if len(tokens) < width:
        return []
    words = hashes.of(tokens)
    shorter = _in_filter(run_hashes(words, width - 1, _start(lang, hashes)), held)
    ends = np.concatenate([[0], np.cumsum(words == np.uint64(hashes[_END]))])
    good = np.flatnonzero(shorter[:-1] & shorter[1:] & (ends[width:] == ends[:-width]))
    return [b" ".join(tokens[i : i + width]) for i in good.tolist()]


def _counted(width: int, shared, counted: int):
    """text, lang to lang, phrase, n; at the first level also n of all words, with no phrase."""

    def run(batches):
        held = None if shared is None else shared.value
        hashes = WordHashes()
        counts: dict[str, Counter] = defaultdict(Counter)
        totals: Counter = Counter()

        def rows():
            for lang, of_lang in counts.items():
                names = pa.array(list(of_lang), pa.binary()).cast(pa.string())
                table = pa.table([pa.array([lang] * len(of_lang), pa.string()), names, pa.array(list(of_lang.values()), pa.int64())], names=["lang", "phrase", "n"])
                yield from table.to_batches(max_chunksize=1 << 14)
            counts.clear()

        def take(lang: str, tokens: list[bytes]):
            found = _runs(tokens, lang, width, held, hashes)
            counts[lang].update(found)
            if width == 1:
                totals[lang] += len(found)

        for batch in batches:
            size = np.cumsum(np.asarray(pc.binary_length(batch.column("text")), dtype=np.int64)) // CHUNK
            cuts = [0, *(np.flatnonzero(np.diff(size)) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(cuts, cuts[1:]):
                some = batch.slice(lo, hi - lo)
                tokens: dict[str, list[bytes]] = defaultdict(list)
                for text, lang in zip(some.column("text").to_pylist(), some.column("lang").to_pylist()):
                    tokens[lang] += tokens_of(text)
                for lang in list(tokens):
                    take(lang, tokens.pop(lang))
                    if sum(map(len, counts.values())) >= counted:
                        yield from rows()
        yield from rows()
        if totals:
            yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.string()), pa.nulls(len(totals), pa.string()), pa.array(list(totals.values()), pa.int64())], names=["lang", "phrase", "n"])

    return run


def _set_bits(width: int):
    """lang, phrase to the filter's bytes that they set: place, bits."""

    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            found = []
            for lang, phrase in zip(batch.column("lang").to_pylist(), batch.column("phrase").to_pylist()):
                found.append(run_hashes(hashes.of(phrase.encode("utf-8", "surrogatepass").split(b" ")), width, _start(lang, hashes)))
            if not found:
                continue
            at = np.unique(np.concatenate(_slots(np.concatenate(found)))).astype(np.int64)
            place, first = np.unique(at >> 3, return_index=True)
            bits = np.bitwise_or.reduceat(1 << (at & 7), first)
            yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(bits)], names=["place", "bits"])

    return run


def frequent_filter(level: DataFrame, width: int) -> np.ndarray:
    """The Bloom filter of a level's frequent runs, BITS / 8 bytes."""
    out = np.zeros(BITS >> 3, dtype=np.uint8)
    # at most BITS / 64 rows reach the driver
    words = level.select("lang", "phrase").mapInArrow(_set_bits(width), "place long, bits long")
    joined = words.groupBy(F.expr("place div 8").alias("place")).agg(F.bit_or(F.expr("shiftleft(bits, cast(place % 8 * 8 as int))")).alias("bits")).toArrow()
    out.view("<i8")[np.asarray(joined.column("place"), dtype=np.int64)] = np.asarray(joined.column("bits"), dtype=np.int64)
    return out


def levels(spark: SparkSession, docs: DataFrame, least: int = LEAST, longest: int = LONGEST, counted: int = COUNTED) -> tuple[list[DataFrame], DataFrame, list[str]]:
    """The frequent runs of each length as tables (lang, phrase, n), the words of each language (lang, n), and paths."""
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text"), F.coalesce("lang", F.lit("und")).alias("lang"))
    found, paths, totals, shared = [], [], None, None
    for width in range(1, longest + 1):
        counts = texts.mapInArrow(_counted(width, shared, counted), COUNTS).groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
        level, path = materialize(spark, counts.filter(F.col("phrase").isNull() | (F.col("n") >= least)), f"level{width}")
        paths.append(path)
        if shared is not None:
            shared.destroy()
        if width == 1:
            totals = level.filter("phrase is null").select("lang", "n")
            level = level.filter("phrase is not null")
        found.append(level)
        if width < longest:
            shared = spark.sparkContext.broadcast(frequent_filter(level, width))
    return found, totals, paths


def score(found: list[DataFrame], covered: int = COVERED) -> DataFrame:
    """``lang, phrase, a, l, r, score`` of the candidates that no longer one covers, from the level tables."""
    each = [f.withColumn("width", F.lit(k + 1)) for k, f in enumerate(found)]
    every = reduce(DataFrame.unionByName, each)
    longer = every.filter("width > 1")
    cut = longer.select("lang", "phrase", F.col("n").alias("a"), "width", F.explode(F.expr("sequence(1, width - 1)")).alias("k"))
    parts = cut.withColumn("first", F.expr("substring_index(phrase, ' ', k)")).withColumn("rest", F.expr("substring_index(phrase, ' ', k - width)"))
    left = every.select("lang", F.col("phrase").alias("first"), F.col("n").alias("l"))
    right = every.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r"))
    value = F.expr("cast((cast(a as decimal(20, 0)) * 2000000) div (cast(l as decimal(20, 0)) + r) as bigint)")
    least = parts.join(left, ["lang", "first"]).join(right, ["lang", "rest"]).withColumn("score", value)
    best = least.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("c"))
    # runs inside a longer candidate: every start and length but the whole
    inner = longer.filter("width > 2").withColumn("size", F.explode(F.expr("sequence(2, width - 1)"))).withColumn("at", F.explode(F.expr("sequence(1, width - size + 1)")))
    inner = inner.select("lang", F.expr("array_join(slice(split(phrase, ' '), at, size), ' ')").alias("phrase"), "n")
    within = inner.groupBy("lang", "phrase").agg(F.max("n").alias("within"))
    kept = best.join(within, ["lang", "phrase"], "left").filter(f"within is null or 100 * cast(within as decimal(20, 0)) < {covered} * cast(a as decimal(20, 0))")
    return kept.select("lang", "phrase", "a", "c.l", "c.r", "c.score")


def collocations(spark: SparkSession, docs: DataFrame, top: int = TOP, least: int = LEAST, counted: int = COUNTED) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's first ``top`` phrases."""
    found, totals, paths = levels(spark, docs, least, counted=counted)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    first = score(found).withColumn("rank", rank.cast("long")).filter(F.col("rank") <= top)
    out, _ = materialize(spark, first.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score"), "collocations")
    remove(spark, *paths)
    return out


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = """
WITH piece AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS p
  FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(p, '[\\x20\\x09]+'), lambda x: x <> '') AS ws FROM piece),
size AS (SELECT unnest([1, 2, 3, 4]) AS k),
run AS (SELECT w.lang, w.ws, size.k, unnest(range(1, len(w.ws) - size.k + 2)) AS i FROM w JOIN size ON len(w.ws) >= size.k),
counted AS (SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase, count(*) AS n FROM run GROUP BY 1, 2, 3),
total AS (SELECT lang, CAST(sum(n) AS BIGINT) AS n FROM counted WHERE k = 1 GROUP BY lang),
f AS (SELECT lang, k, phrase, n FROM counted WHERE n >= 30),
c AS (SELECT lang, k, phrase, n AS a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1),
cut AS (SELECT lang, k, phrase, a, ws, unnest(range(1, k)) AS j FROM c),
part AS (SELECT lang, phrase, a, j, array_to_string(ws[1:j], ' ') AS x, array_to_string(ws[j + 1:k], ' ') AS y FROM cut),
scored AS (
  SELECT p.lang, p.phrase, p.a, p.j, l.n AS l, r.n AS r, CAST((2000000 * CAST(p.a AS HUGEINT)) // CAST(l.n + r.n AS HUGEINT) AS BIGINT) AS score
  FROM part p JOIN f l ON l.lang = p.lang AND l.phrase = p.x JOIN f r ON r.lang = p.lang AND r.phrase = p.y),
best AS (
  SELECT lang, phrase, a, l, r, score FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) AS o FROM scored) t WHERE o = 1),
span AS (SELECT c.lang, c.a, c.ws, c.k, size.k AS m, unnest(range(1, c.k - size.k + 2)) AS i FROM c JOIN size ON size.k > 1 AND size.k < c.k),
inside AS (SELECT lang, array_to_string(ws[i:i + m - 1], ' ') AS phrase, max(a) AS a FROM span GROUP BY 1, 2),
kept AS (
  SELECT b.* FROM best b LEFT JOIN inside i ON i.lang = b.lang AND i.phrase = b.phrase
  WHERE i.a IS NULL OR 100 * CAST(i.a AS HUGEINT) < 80 * CAST(b.a AS HUGEINT)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT r.lang, r.rank, r.phrase, r.a, r.l, r.r, t.n, r.score FROM ranked r JOIN total t ON t.lang = r.lang WHERE r.rank <= 2000
"""
