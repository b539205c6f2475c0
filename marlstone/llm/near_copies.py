"""Operator 8 for the pipeline's stage: documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Equal sets are collapsed first. The SimHash fingerprints of the sets go through operator 8's byte-position index with its
count filter, and what it links is verified on the whole sets. At similarity 0.8 about ten of 64 bits differ, which no
guaranteed number of shared bytes reaches, so an exact search adds the links that fingerprints miss:

Shingles have one order, rarest first by a vector of hashed counts over all documents (any order gives the same result; a
good one keeps the lists short). Two sets of n and m shingles that reach the threshold share one of the first
n - ceil(0.8 n) + 1 and m - ceil(0.8 m) + 1 shingles, so each set enters the posting lists of its prefix only, and every
pair that can be linked meets in a list. In the list of the first shingle that two sets share, all that they share lies
from there on, so a pair is taken up only where what is left of both sets reaches the threshold; the smaller set of a pair is
then within n - ceil(8 n / 9) of its beginning (it leads), and entries that no such one can meet are dropped. A bitmap of
each set (the parity of its shingles by hash) bounds from below how many shingles two sets don't share; pairs beyond what the
threshold allows are dropped within their list. What is left is held against bitmaps of two bits a shingle and more, which
grow with the sets (a set of 2300 shingles has 1 KB, not 14 KB of text), and the few pairs that pass are verified on the
whole sets.

Components are what counts, not pairs: after the fingerprints' links each list links its members in a chain and to its
first member; then only members of different components are paired, so a large group of copies does not give its square.

A pair meets in the list of every shingle of both prefixes, often hundreds of times. Entries therefore carry the last few
shingles of their set before this one that are in lists too; where two entries have one of these in common, their pair is
left to that shingle's list. The first list that they share has none before it, so no pair is lost.

Sets are not stored: they are made from the texts where they are needed. Each set's bitmaps and the address of its first row
are kept in a table bucketed by the set's id, and that row in one bucketed by its address, by which it was dealt out for the
join that leaves one row a set. So the documents move once; verifying moves the long bitmaps of candidates and the texts of
pairs that those leave, and the kept rows are read from the table of rows, which stays until ``forget``.

Defined results: words are lower-cased and split at white space; a text of fewer than five words is one shingle; null and
empty texts and texts of white space are equal; shingles are compared by 64-bit hashes. Of a component the row of the
smallest doc_id stays, of several such rows the first in the input's files, and null doc_ids only where there is no other.
Texts are read whole; an empty table gives no rows; all columns pass through, whatever they are called.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.llm import simhash
from marlstone.llm.common import add_up, bucketed, drop_bucketed, materialize, remove, unused, with_address
from marlstone.llm.graph import components

WIDTH = 5
SEED = 42
#: The threshold as a fraction, so that comparisons are exact.
NUM, DEN = 4, 5
#: Counters of the order of shingles.
COUNTERS = 1 << 18
#: Bits of a set's bitmap within the lists; the filter is exact at any size.
BITS = 512
#: Bits of the long bitmap for each shingle, at least; their number is a power of two.
LONG_BITS = 2
#: A list's entry has the set's size and the shingle's place in its order in one number.
PLACE = 32
#: Shingles before an entry's own that it carries.
PRIOR = 4
#: Orders in which lists chain their members of one size; lists of one order make mostly the same pairs of a group of copies.
CHAINS = 4
#: A pair of sets with the addresses of their rows.
PAIR = ["a", "b", "a_file", "a_row", "b_file", "b_row"]
_BASE = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str | None) -> np.ndarray:
    """The set of a text's shingle hashes, sorted."""
    import xxhash

    words = (text or "").lower().split()
    if not words:
        return np.zeros(0, dtype=np.int64)
    w = np.array([xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass"), SEED) for x in words], dtype=np.uint64)
    with np.errstate(over="ignore"):
        width = min(WIDTH, len(w))
        n = len(w) - width + 1
        h = np.full(n, width, dtype=np.uint64)
        for k in range(width):
            h = h * _BASE + w[k : k + n]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    return np.unique(h.view(np.int64))


def prefix_length(n: int) -> int:
    return n - (n * NUM + DEN - 1) // DEN + 1 if n else 0


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets have a Jaccard similarity of at least NUM / DEN."""
    if min(len(a), len(b)) * DEN < max(len(a), len(b)) * NUM:
        return False
    common = len(a) + len(b) - len(np.union1d(a, b))
    return common * DEN >= (len(a) + len(b) - common) * NUM


MARKED = [T.StructField(c, T.LongType()) for c in ("file", "row", "fp", "n")] + [T.StructField(c, T.BinaryType()) for c in ("bits", "long", "digest", "counts")]
#: Names and paths of the tables that results are read from.
_TABLES: list[tuple[str, str]] = []


def _marked(batches):
    """file, row, doc_id, text to file, row, fp, size, bitmaps and digest of the set, doc_id; the task's last row has its counts
    of shingles and nothing else."""
    total, kind = np.zeros(COUNTERS, dtype=np.int64), None
    for batch in batches:
        kind = batch.column("doc_id").type
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            sets = [shingles(t) for t in part.column("text").to_pylist()]
            total += np.bincount(np.concatenate([np.zeros(0, np.int64), *sets]) & (COUNTERS - 1), minlength=COUNTERS)
            fps = np.array([simhash.majority(s.view(np.uint64)) for s in sets], dtype=np.uint64).view(np.int64)
            bits = pa.array([bitmap(s).tobytes() for s in sets], pa.binary())
            digests = pa.array([hashlib.md5(s.tobytes()).digest() for s in sets], pa.binary())
            sizes, longs = pa.array([len(s) for s in sets], pa.int64()), pa.array([long_bitmap(s).tobytes() for s in sets], pa.binary())
            columns = [part.column("file"), part.column("row"), pa.array(fps), sizes, bits, longs, digests, pa.nulls(len(sets), pa.binary()), part.column("doc_id")]
            yield pa.RecordBatch.from_arrays(columns, names=[*[f.name for f in MARKED], "doc_id"])
    if kind is not None:
        none = [pa.nulls(1, pa.int64())] * 4
        columns = [*none, *[pa.nulls(1, pa.binary())] * 3, pa.array([total.tobytes()], pa.binary()), pa.nulls(1, kind)]
        yield pa.RecordBatch.from_arrays(columns, names=[*[f.name for f in MARKED], "doc_id"])


def bitmap(h: np.ndarray, bits: int = BITS) -> np.ndarray:
    return np.packbits((np.bincount((h >> 32) & (bits - 1), minlength=bits) & 1).astype(np.uint8))


def long_bitmap(h: np.ndarray) -> np.ndarray:
    return bitmap(h, max(BITS, 1 << (LONG_BITS * max(len(h), 1) - 1).bit_length()))


def close(a: bytes, n: int, b: bytes, m: int) -> bool:
    """Whether the long bitmaps of sets of n and m shingles leave it possible that they reach the threshold. The longer one
    is folded to the length of the other."""
    size = min(len(a), len(b))
    x, y = (np.bitwise_xor.reduce(np.frombuffer(v, np.uint8).reshape(-1, size), axis=0) for v in (a, b))
    return int(np.bitwise_count(x ^ y).sum(dtype=np.int64)) * (DEN + NUM) <= (n + m) * (DEN - NUM)


def _close(batches):
    """Pairs that their long bitmaps leave."""
    for batch in batches:
        keep = [close(p, n, q, m) for p, n, q, m in zip(*(batch.column(c).to_pylist() for c in ("x", "n", "y", "m")))]
        yield batch.select(PAIR).filter(pa.array(keep, pa.bool_()))


def _bits(table: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(table.column("bits").to_pylist()), np.uint64).reshape(-1, BITS // 64)


def _near(bits: np.ndarray, n: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which pairs of rows x, y their bitmaps leave possible: sets at the threshold differ by (n + m) / 9 shingles at most."""
    keep = np.zeros(len(x), dtype=bool)
    for at in range(0, len(x), 1 << 14):
        i, j = x[at : at + (1 << 14)], y[at : at + (1 << 14)]
        keep[at : at + (1 << 14)] = np.bitwise_count(bits[i] ^ bits[j]).sum(1, dtype=np.int64) * (DEN + NUM) <= (n[i] + n[j]) * (DEN - NUM)
    return keep


def _postings(counts):
    def run(batches):
        often = counts.value
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                tokens, ids, spots = [], [], []
                for i, text in zip(part.column("id").to_pylist(), part.column("text").to_pylist()):
                    h = shingles(text)
                    first = h[np.lexsort((h, often[h & (COUNTERS - 1)]))][: prefix_length(len(h))]
                    tokens.append(first)
                    ids.append(np.full(len(first), i))
                    spots.append((len(h) << PLACE) + np.arange(len(first)))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in (tokens, ids, spots)], names=["token", "id", "spot"])

    return run


def _lists(batches, by: str = "token"):
    """Tables of the columns of batches sorted by ``by``, cut so that no list is split."""
    held = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.asarray(batch.column(by))
        cut = int(np.searchsorted(key, key[-1]))  # where the last list begins
        if cut or (held and held[-1].column(by)[-1].as_py() != key[0]):
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def _bounds(token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    cuts = np.flatnonzero(np.diff(token)) + 1
    return np.concatenate([[0], cuts]), np.concatenate([cuts, [len(token)]])


def _pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])


def _sizes(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Of each entry the size of its set and how many of its shingles are left from this one on."""
    spot = np.asarray(table.column("spot"))
    n = spot >> PLACE
    return n, n - (spot & ((1 << PLACE) - 1))


def _reach(n: np.ndarray, left: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which pairs can reach the threshold if this is the first shingle that they share."""
    return np.minimum(left[x], left[y]) * (NUM + DEN) >= (n[x] + n[y]) * NUM


def _leads(n: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Which entries can be the smaller set of a pair, or as large as the other."""
    return left * (NUM + DEN) >= 2 * n * NUM


def _leaders(leads: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each entry the last one before it in its list that leads, or itself where there is none."""
    at = np.arange(len(leads))
    last = np.concatenate([[-1], np.maximum.accumulate(np.where(leads, at, -1))[:-1]])
    return np.where(last >= first, last, at)


def _shared(batches):
    """The entries that can meet another in their list: entries ascend by size, those of equal size by place."""
    for table in _lists(batches):
        if not table.num_rows:
            continue
        token = np.asarray(table.column("token"))
        n, left = _sizes(table)
        starts, ends = _bounds(token)
        at, leads = np.arange(len(token)), _leads(n, left)
        before = _leaders(leads, np.repeat(starts, ends - starts))
        after = np.minimum(at + 1, len(at) - 1)
        meets = (before != at) & (n[before] * DEN >= n * NUM)
        meets |= leads & (after != at) & (token[after] == token) & (n * DEN >= n[after] * NUM)
        yield from table.filter(pa.array(meets)).to_batches()


def _with_prior(batches):
    """Entries sorted by id and spot, with the PRIOR tokens before each of the same id, 0 where there are fewer."""
    for table in _lists(batches, "id"):
        if not table.num_rows:
            continue
        token = np.asarray(table.column("token"))
        starts, ends = _bounds(np.asarray(table.column("id")))
        place = np.arange(len(token)) - np.repeat(starts, ends - starts)
        prior = np.zeros((len(token), PRIOR), dtype=np.int64)
        for k in range(1, PRIOR + 1):
            at = np.flatnonzero(place >= k)
            prior[at, k - 1] = token[at - k]
        ends = pa.py_buffer(np.arange(len(token) + 1, dtype=np.int32) * (8 * PRIOR))
        column = pa.Array.from_buffers(pa.binary(), len(token), [None, ends, pa.py_buffer(prior)])
        yield from table.append_column("prior", column).to_batches()


def _priors(table: pa.Table) -> np.ndarray | None:
    if "prior" in table.column_names:
        return np.frombuffer(b"".join(table.column("prior").to_pylist()), np.int64).reshape(-1, PRIOR)


def _met(prior: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which pairs of rows x, y have met in a list before: one of the tokens before both is the same."""
    met = np.zeros(len(x), dtype=bool)
    for at in range(0, len(x), 1 << 14):
        a, b = prior[x[at : at + (1 << 14)], :, None], prior[y[at : at + (1 << 14)], None, :]
        met[at : at + (1 << 14)] = ((a == b) & (a != 0)).any((1, 2))
    return met


def _first_pairs(batches):
    """Each member with the last one before it, by size, that leads, and with the first of its list. Members of one size are in
    one of ``CHAINS`` orders of ids."""
    for table in _lists(batches):
        if not table.num_rows:
            continue
        token, ids = (np.asarray(table.column(c)) for c in ("token", "id"))
        n, left = _sizes(table)
        starts, ends = _bounds(token)
        first = np.repeat(starts, ends - starts)
        mixed = (ids.view(np.uint64) * np.uint64(CHAINS) + token.view(np.uint64) % np.uint64(CHAINS) + np.uint64(1)) * _BASE
        order = np.lexsort((mixed ^ (mixed >> np.uint64(32)), n, first))
        at = np.arange(len(token))
        x = order[np.concatenate([first, _leaders(_leads(n, left)[order], first)])]
        y = order[np.concatenate([at, at])]
        good = (x != y) & (n[x] * DEN >= n[y] * NUM) & _reach(n, left, x, y)
        x, y = x[good], y[good]
        near = _near(_bits(table), n, x, y)
        yield _pairs(ids[x[near]], ids[y[near]])


def _other_pairs(batches):
    """All members of a list that are in different components, near enough in size and have not met before. Each step pairs all
    leading members that still have one near enough in size with the member that many places on; sizes ascend within a list, so
    who has none drops out."""
    for table in _lists(batches):
        if not table.num_rows:
            continue
        token, ids, root = (np.asarray(table.column(c)) for c in ("token", "id", "root"))
        n, left = _sizes(table)
        starts, ends = _bounds(token)
        mixed = np.minimum.reduceat(root, starts) != np.maximum.reduceat(root, starts)
        bits = _bits(table) if mixed.any() else None
        prior = _priors(table)
        end = np.repeat(ends, ends - starts)
        x, step = np.flatnonzero(np.repeat(mixed, ends - starts) & _leads(n, left)), 0
        while len(x):
            step += 1
            x = x[x + step < end[x]]
            x = x[n[x + step] * NUM <= n[x] * DEN]
            apart = x[(root[x] != root[x + step]) & _reach(n, left, x, x + step)]
            if prior is not None:
                apart = apart[~_met(prior, apart, apart + step)]
            if len(apart):
                near = apart[_near(bits, n, apart, apart + step)]
                if len(near):
                    yield _pairs(ids[near], ids[near + step])


def _verified(batches):
    """Pairs whose sets reach the threshold; the set of a text that several rows hold is made once."""
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part, made = batch.slice(at, 512), {}
            keep = []
            for a, b, p, q in zip(*(part.column(c).to_pylist() for c in ("a", "b", "x", "y"))):
                for i, text in ((a, p), (b, q)):
                    if i not in made:
                        made[i] = shingles(text)
                keep.append(similar(made[a], made[b]))
            yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _links(pairs: DataFrame, groups: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs that reach the threshold: by their long bitmaps first, then by their texts."""
    maps = groups.select("id", "n", "long", "file", "row")
    one = pairs.join(maps.toDF("a", "n", "x", "a_file", "a_row"), "a")
    both = one.join(maps.toDF("b", "m", "y", "b_file", "b_row"), "b")
    pairs = both.mapInArrow(_close, ", ".join(f"{c} long" for c in PAIR))
    whole = texts.select("file", "row", F.col("doc.text").alias("text"))
    one = pairs.join(whole.toDF("a_file", "a_row", "x"), ["a_file", "a_row"])
    both = one.join(whole.toDF("b_file", "b_row", "y"), ["b_file", "b_row"]).select("a", "b", "x", "y")
    return both.mapInArrow(_verified, "a long, b long")


def _rooted(rows: DataFrame, roots: DataFrame) -> DataFrame:
    return rows.join(roots.select(F.col("a").alias("id"), F.col("b").alias("root")), "id", "left").withColumn("root", F.coalesce("root", "id"))


def fingerprint_pairs(spark: SparkSession, groups: DataFrame) -> DataFrame:
    """``a, b``: pairs of sets (columns id, fp) that operator 8 links, enough to connect all that it connects."""
    first = groups.groupBy("fp").agg(F.min("id").alias("id"))
    link = simhash.links(first)
    found = link.join(first.select(F.col("fp").alias("a"), F.col("id").alias("x")), "a").join(first.select(F.col("fp").alias("b"), F.col("id").alias("y")), "b")
    same = groups.join(first.select("fp", F.col("id").alias("x")), "fp").filter("id <> x").select(F.col("x").alias("a"), F.col("id").alias("b"))
    return found.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).unionByName(same)


def classes(spark: SparkSession, groups: DataFrame, texts: DataFrame, counts: np.ndarray) -> DataFrame:
    """``a, b``: every set (columns id, fp, n, bits, long, file, row, bucketed by id; its row in ``texts``, bucketed by file and
    row) that is linked to one of a smaller id, and the least id of its component."""
    shared = spark.sparkContext.broadcast(counts)
    postings = texts.select("id", F.col("doc.text").alias("text")).mapInArrow(_postings(shared), "token long, id long, spot long")
    lists = postings.repartition("token").sortWithinPartitions("token", "spot", "id").mapInArrow(_shared, "token long, id long, spot long")
    lists, at_lists = materialize(spark, lists, "lists")
    bits = groups.select("id", "bits")
    ordered = lists.join(bits, "id").repartition("token").sortWithinPartitions("token", "spot", "id")
    pairs = ordered.mapInArrow(_first_pairs, "a long, b long").unionByName(fingerprint_pairs(spark, groups)).distinct()
    first, at_first = materialize(spark, _links(pairs, groups, texts), "links")
    roots = components(spark, first)
    entries = _rooted(lists.repartition("id").join(bits, "id"), roots).select("token", "id", "spot", "bits", "root").sortWithinPartitions("id", "spot")
    entries = entries.mapInArrow(_with_prior, "token long, id long, spot long, bits binary, root long, prior binary")
    ordered = entries.repartition("token").sortWithinPartitions("token", "spot", "id")
    other, at_other = materialize(spark, _links(ordered.mapInArrow(_other_pairs, "a long, b long").distinct(), groups, texts), "links")
    out = components(spark, roots.unionByName(other))
    remove(spark, at_lists, at_first, at_other)
    return out


def keep_one(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component."""
    file, row = unused("file", docs.columns), unused("row", docs.columns)
    addressed, paths = with_address(spark, docs, file, row)
    at = [F.col(file).alias("file"), F.col(row).alias("row")]
    marked = addressed.select(*at, "doc_id", "text").mapInArrow(_marked, T.StructType([*MARKED, docs.schema["doc_id"]]))
    marked, at_marked = materialize(spark, marked, "marked")
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "file", "row")
    found = [F.max(c).alias(c) for c in ("fp", "n", "bits", "long")]
    groups = marked.filter("counts is null").groupBy("digest").agg(F.min(order).alias("o"), *found)
    first = F.monotonically_increasing_id().alias("id"), "o", "o.file", "o.row", "fp", "n", "bits", "long"
    groups, at_numbered = materialize(spark, groups.select(*first), "groups")
    counts = add_up(marked.filter("counts is not null").select("counts"), COUNTERS)
    remove(spark, at_marked)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))  # as many as buckets, so each is one file
    groups, sets, at_sets = bucketed(spark, groups.repartition(parts, "id"), "sets", "id")
    remove(spark, at_numbered)
    whole = addressed.select(*at, F.struct(*[F.col(c) for c in docs.columns]).alias("doc")).repartition(parts, "file", "row")
    texts = whole.join(groups.select("id", "file", "row"), ["file", "row"])
    texts, name, at_texts = bucketed(spark, texts, "set_texts", "file", "row")
    _TABLES.append((name, at_texts))
    roots = classes(spark, groups, texts, counts)
    best = _rooted(groups.select("id", "o"), roots).groupBy("root").agg(F.min(F.struct("o", "id")).alias("m")).select("m.o.file", "m.o.row")
    best, _ = materialize(spark, best, "best")
    drop_bucketed(spark, sets, at_sets)
    remove(spark, *paths)
    return texts.join(best, ["file", "row"], "left_semi").select("doc.*")


def forget(spark: SparkSession) -> None:
    """Drops the tables that results of ``keep_one`` are read from, once those are written elsewhere."""
    while _TABLES:
        drop_bucketed(spark, *_TABLES.pop())
