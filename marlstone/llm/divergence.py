"""Operator 12: how the sources of a language differ in their terms.

Each task counts terms in byte tries, one for each language, whose leaves have a counter for each source and a number of
documents, and writes the tries' leaves out when they hold ``COUNTERS`` counters. The leaves are dealt out by ranges of
(language, term): a task merges the pieces of its prefix range into tries of ``RANGE_TERMS`` terms, walks them in the order
of UTF-8 and numbers the terms that are kept in blocks of about ``BLOCK_TERMS``. Then each block meets the totals of its
language's sources; a traversal of its terms adds up the divergence of each pair of sources and holds ten candidates for each
source. A block's partial results are its own task, so neither a hot language nor a hot source is gathered anywhere, and
nothing is broadcast.

All arithmetic is on whole numbers. Shares are units of 1 / ``UNIT``; they come from a long division in base 1000, exact in
64 bits up to 9.2e15 occurrences of kept terms in a language.

Defined results: null text, lang and source are ''; a text without terms counts for its group only; texts are read whole, of
any length; repeated rows count one by one; of terms with equal values the smaller in UTF-8 comes first; a language that
keeps no term has pairs of value 0 and no terms; an empty table gives no rows; only ``text``, ``lang`` and ``source`` are
read, so other columns can't clash.
"""

from __future__ import annotations

import gc
from collections import defaultdict
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.llm.common import materialize, remove
from marlstone.llm.radix_trie import RadixTrie

UNIT = 1_000_000_000
LEAST_DOCS = 10
TOP_TERMS = 10
#: Counters a task's tries hold before they are written out.
COUNTERS = 400_000
RANGE_TERMS = 8192
BLOCK_TERMS = 4096
#: Terms of a block whose shares are held for all sources at once.
STEP = 512
#: Bytes of text that are cut into terms at once.
CHUNK = 16 << 20
#: Letters are lowered, all else in ASCII is a space.
_TABLE = bytes(c if c >= 0x80 or 0x61 <= c <= 0x7A else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))
LEAVES = "lang string, term string, docs long, sources array<string>, counts array<long>"
KEPT = "lang string, term string, block long, sources array<string>, counts array<long>"
RESULTS = "lang string, source string, part string, item string, value long"


def _without_gc(task):
    """A task's generator, run without the search for cycles: tries are many small objects and have none."""

    @wraps(task)
    def run(batches):
        was = gc.isenabled()
        gc.disable()
        try:
            yield from task(batches)
        finally:
            if was:
                gc.enable()

    return run


def _batch(rows: list[tuple], middle: str) -> pa.RecordBatch:
    """Rows of language, key, number, leaf as a batch."""
    lang, key, number, leaves = zip(*rows)
    offsets = pa.array(np.cumsum([0, *(len(x.counts) for x in leaves)]), pa.int32())
    sources = pa.array([s for x in leaves for s in x.counts], pa.string())
    counts = pa.array([n for x in leaves for n in x.counts.values()], pa.int64())
    columns = {
        "lang": pa.array(lang, pa.string()),
        "term": pa.array(key, pa.binary()).cast(pa.string()),
        middle: pa.array(number, pa.int64()),
        "sources": pa.ListArray.from_arrays(offsets, sources),
        "counts": pa.ListArray.from_arrays(offsets, counts),
    }
    return pa.RecordBatch.from_pydict(columns)


def _in_batches(rows, middle: str, size: int = 8192):
    held = []
    for r in rows:
        held.append(r)
        if len(held) == size:
            yield _batch(held, middle)
            held = []
    if held:
        yield _batch(held, middle)


def _lists(column: pa.Array) -> tuple[list, list[int]]:
    """The values of lists one after another, and where each list begins and the last ends."""
    return column.flatten().to_pylist(), np.concatenate([[0], np.cumsum(np.asarray(pc.list_value_length(column), dtype=np.int64))]).tolist()


def add_texts(tries: dict[str, RadixTrie], texts: list[str], langs: list[str], sources: list[str]) -> None:
    """Counts the terms of some texts and puts them into the tries: one descent for each term of a language."""
    spaced = pa.array([t.encode("utf-8", "surrogatepass").translate(_TABLE) for t in texts], pa.string())
    lists = pc.ascii_split_whitespace(spaced)
    doc = np.repeat(np.arange(len(texts)), np.asarray(pc.list_value_length(lists), dtype=np.int64))
    flat = lists.flatten()
    some = pc.greater(pc.binary_length(flat), 0)
    coded, doc = flat.filter(some).dictionary_encode(), doc[np.asarray(some)]
    code, terms = np.asarray(coded.indices, dtype=np.int64), coded.dictionary.cast(pa.binary()).to_pylist()
    if not len(code):
        return
    lang_names, source_names = sorted(set(langs)), sorted(set(sources))
    place = {x: i for i, x in enumerate(lang_names)}
    lang = np.array([place[x] for x in langs])
    place = {x: i for i, x in enumerate(source_names)}
    source = np.array([place[x] for x in sources])
    key, n = np.unique((lang[doc] * len(terms) + code) * len(source_names) + source[doc], return_counts=True)
    once = np.sort(doc * len(terms) + code)
    once = once[np.concatenate([[True], once[1:] != once[:-1]])]
    _, docs = np.unique(lang[once // len(terms)] * len(terms) + once % len(terms), return_counts=True)
    both, of = np.divmod(key, len(source_names))
    starts = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]]))
    cuts = [*starts.tolist(), len(both)]
    of, n = [source_names[k] for k in of.tolist()], n.tolist()
    at_lang, at_term = (x.tolist() for x in np.divmod(both[starts], len(terms)))
    for i, (x, t, d) in enumerate(zip(at_lang, at_term, docs.tolist())):
        lo, hi = cuts[i], cuts[i + 1]
        tries[lang_names[x]].add(terms[t], of[lo:hi], n[lo:hi], d)


def _counted(counters: int):
    @_without_gc
    def run(batches):
        tries: dict[str, RadixTrie] = defaultdict(RadixTrie)

        def leaves():
            yield from _in_batches(((lang, key, leaf.docs, leaf) for lang in sorted(tries) for key, leaf in tries[lang].walk()), "docs")
            tries.clear()

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("text", "lang", "source")]
            size = np.cumsum(np.asarray(pc.binary_length(batch.column("text")), dtype=np.int64)) // CHUNK
            cuts = [0, *(np.flatnonzero(np.diff(size)) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(cuts, cuts[1:]):
                if lo < hi:
                    add_texts(tries, *[c[lo:hi] for c in columns])
                if sum(t.counters for t in tries.values()) >= counters:
                    yield from leaves()
        yield from leaves()

    return run


def _merged(least_docs: int):
    """Leaves sorted by language and term; the merged leaves of enough documents out, with their block."""

    @_without_gc
    def run(batches):
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 32
        block, inside, trie, lang, last = 0, 0, RadixTrie(), None, None

        def kept():
            nonlocal block, inside
            for key, leaf in trie.walk():
                if leaf.docs >= least_docs:
                    yield lang, key, first + block, leaf
                    inside += 1
                    if inside == BLOCK_TERMS:
                        block, inside = block + 1, 0

        for batch in batches:
            terms = batch.column("term").cast(pa.binary()).to_pylist()
            (sources, cuts), (counts, _) = _lists(batch.column("sources")), _lists(batch.column("counts"))
            for i, (here, term, docs) in enumerate(zip(batch.column("lang").to_pylist(), terms, batch.column("docs").to_pylist())):
                if here != lang or (trie.keys >= RANGE_TERMS and term != last):
                    yield from _in_batches(kept(), "block")
                    trie, lang = RadixTrie(), here
                last = term
                trie.add(term, sources[cuts[i] : cuts[i + 1]], counts[cuts[i] : cuts[i + 1]], docs)
        yield from _in_batches(kept(), "block")

    return run


def shares(counts: np.ndarray, total: np.ndarray, terms: int) -> np.ndarray:
    """1 + floor(UNIT * (counts + 2) / (total + 2 * terms)), digit by digit in base 1000."""
    base = total + 2 * terms
    rest, out = counts + 2, np.zeros(np.broadcast(counts, base).shape, dtype=np.int64)
    for _ in range(3):
        rest = rest * 1000
        digit = rest // base
        rest = rest - digit * base
        out = out * 1000 + digit
    return out + 1


def differences(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def _dense(counts: pa.ChunkedArray, sources: pa.ChunkedArray, place: dict[str, int], lo: int, hi: int) -> np.ndarray:
    """Rows: sources; columns: the terms from ``lo`` to ``hi``."""
    some = sources.slice(lo, hi - lo).combine_chunks()
    term = np.repeat(np.arange(hi - lo), np.asarray(pc.list_value_length(some), dtype=np.int64))
    at = np.fromiter((place[s] for s in pc.list_flatten(some).to_pylist()), np.int64, len(term))
    out = np.zeros((len(place), hi - lo), dtype=np.int64)
    out[at, term] = np.asarray(pc.list_flatten(counts.slice(lo, hi - lo)))
    return out


def _scored(kept: pa.Table, totals: pa.Table) -> pa.Table:
    """One block: partial sums of its pairs of sources (smaller one first), and each source's first candidates."""
    kept = kept.take(pc.sort_indices(kept.column("term").cast(pa.binary())))
    totals = totals.take(pc.sort_indices(totals.column("source").cast(pa.binary())))
    lang, names, terms = kept.column("lang")[0].as_py(), totals.column("source").to_pylist(), kept.column("term").to_pylist()
    size = np.asarray(totals.column("n"), dtype=np.int64)[:, None]
    v, n_lang = totals.column("v")[0].as_py(), np.int64(totals.column("n_lang")[0].as_py())
    place = {s: i for i, s in enumerate(names)}
    pairs = [np.zeros(len(names) - s - 1, dtype=np.int64) for s in range(len(names))]
    best: list[list[tuple[int, int]]] = [[] for _ in names]
    for lo in range(0, len(terms), STEP):
        counts = _dense(kept.column("counts"), kept.column("sources"), place, lo, min(lo + STEP, len(terms)))
        p, q = shares(counts, size, v), shares(counts.sum(0), n_lang, v)
        for s in range(len(names) - 1):
            pairs[s] += differences(p[s], p[s + 1 :]).sum(1)
        for s in range(len(names)):
            at = np.flatnonzero((counts[s] > 0) & (p[s] > q))
            value = differences(p[s][at], q[at])
            first = np.lexsort((at, -value))[:TOP_TERMS]
            # ties are in the order of terms, which is that of their places
            best[s] = sorted(best[s] + [(-int(value[i]), lo + int(at[i])) for i in first])[:TOP_TERMS]
    rows = [(names[s], "pair", names[s + 1 + k], int(x)) for s in range(len(names)) for k, x in enumerate(pairs[s])]
    rows += [(names[s], "term", terms[i], -x) for s in range(len(names)) for x, i in best[s]]
    columns = list(zip(*rows)) or [(), (), (), ()]
    types = [pa.string()] * 3 + [pa.int64()]
    return pa.table([pa.array([lang] * len(rows), pa.string()), *[pa.array(c, t) for c, t in zip(columns, types)]], names=["lang", "source", "part", "item", "value"])


def kept_terms(spark: SparkSession, docs: DataFrame, least_docs: int = LEAST_DOCS, counters: int = COUNTERS) -> DataFrame:
    """``lang, term, block, sources, counts``: the terms that enough documents of a language have, merged by prefix range."""
    leaves, path = materialize(spark, docs.select("text", "lang", "source").mapInArrow(_counted(counters), LEAVES), "leaves")
    dealt = leaves.repartitionByRange("lang", "term").sortWithinPartitions("lang", "term")
    kept, _ = materialize(spark, dealt.mapInArrow(_merged(least_docs), KEPT), "kept")
    remove(spark, path)
    return kept


def audit(spark: SparkSession, docs: DataFrame, least_docs: int = LEAST_DOCS, counters: int = COUNTERS) -> DataFrame:
    """``lang, source, part, item, value, rank``: for each group the other sources of its language by divergence, and the
    terms it has more of than the language."""
    docs = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("text", "lang", "source")])
    kept = kept_terms(spark, docs, least_docs, counters)
    sums = kept.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("x")).groupBy("lang", F.col("x.sources").alias("source")).agg(F.sum("x.counts").alias("n"))
    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n_lang"))
    groups = docs.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["n", "v", "n_lang"])
    groups, _ = materialize(spark, groups, "groups")
    totals = kept.select("lang", "block").distinct().join(groups, "lang").select(F.col("lang").alias("of_lang"), F.col("block").alias("of_block"), "source", "n", "v", "n_lang")
    scored = kept.groupBy("lang", "block").cogroup(totals.groupBy("of_lang", "of_block")).applyInArrow(_scored, RESULTS)
    scored, _ = materialize(spark, scored, "scored")
    # each source of a language with each other one is the report itself
    other = groups.select("lang", F.col("source").alias("item"))
    none = groups.select("lang", "source").join(other, "lang").filter("source <> item").select("lang", "source", "item", F.lit(0).cast("long").alias("value"))
    half = scored.filter("part = 'pair'").select("lang", "source", "item", "value")
    turned = half.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")
    pairs = none.unionByName(half).unionByName(turned).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    ranked = pairs.withColumn("part", F.lit("pair")).withColumn("rank", rank)
    top = scored.filter("part = 'term'").withColumn("rank", rank).filter(F.col("rank") <= TOP_TERMS)
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return ranked.select(columns).unionByName(top.select(columns))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = """
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents),
w AS (SELECT id, lang, source, unnest(regexp_extract_all(t, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT id) >= 10),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
c AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM w JOIN kept k ON k.lang = w.lang AND k.term = w.term GROUP BY w.lang, w.source, w.term),
g AS (SELECT DISTINCT lang, source FROM d),
dense AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n
  FROM g JOIN kept k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
gn AS (SELECT lang, source, sum(n) AS total FROM dense GROUP BY lang, source),
p AS (
  SELECT dense.lang, dense.source, dense.term, dense.n, 1 + CAST((1000000000 * CAST(dense.n + 2 AS HUGEINT)) // CAST(gn.total + 2 * v.v AS HUGEINT) AS BIGINT) AS p
  FROM dense JOIN gn ON gn.lang = dense.lang AND gn.source = dense.source JOIN v ON v.lang = dense.lang),
lt AS (SELECT lang, term, sum(n) AS n FROM dense GROUP BY lang, term),
ln AS (SELECT lang, sum(n) AS total FROM lt GROUP BY lang),
q AS (
  SELECT lt.lang, lt.term, 1 + CAST((1000000000 * CAST(lt.n + 2 AS HUGEINT)) // CAST(ln.total + 2 * v.v AS HUGEINT) AS BIGINT) AS q
  FROM lt JOIN ln ON ln.lang = lt.lang JOIN v ON v.lang = lt.lang),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON b.lang = a.lang AND b.term = a.term AND b.source <> a.source GROUP BY a.lang, a.source, b.source),
every AS (
  SELECT a.lang, a.source, b.source AS item, CAST(coalesce(x.value, 0) AS BIGINT) AS value
  FROM g a JOIN g b ON b.lang = a.lang AND b.source <> a.source
  LEFT JOIN pairs x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
terms AS (
  SELECT p.lang, p.source, p.term AS item, ((p.p - q.q) * (p.p - q.q)) // (p.p + q.q) AS value
  FROM p JOIN q ON q.lang = p.lang AND q.term = p.term WHERE p.n > 0 AND p.p > q.q),
ranked AS (
  SELECT lang, source, 'pair' AS part, item, value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM every
  UNION ALL
  SELECT lang, source, 'term' AS part, item, value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM terms)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""
