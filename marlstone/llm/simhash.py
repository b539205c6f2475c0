"""Operator 8: SimHash near-duplicates through a byte-position inverted index with count filtering.

A 64-bit fingerprint has eight positional bytes. Two fingerprints that differ in at most three bits differ in at most
three bytes, so they share five positional bytes at least: the guaranteed minimum, ``SHARED``. Of any six positions such a
pair shares three, so the index has a posting list for each choice of three of the first six positions and the bytes
there. Within a list the shared positional bytes of a pair are tallied over all eight positions; pairs that reach the
guaranteed minimum are retained and their differing bits verified. A list beyond ``HOT_ENTRIES`` is split by two more of
its five other positions (ten choices; a pair at the minimum shares two of them), so it goes to many tasks and no list
holds more than 2 ** 24 fingerprints. Links within a list are sought as a forest, by comparing what is left with each
member found, so a large group of near copies does not give its square.

Equal fingerprints are collapsed before indexing, so groups of copies cost one entry. Components come from alternating
star steps, and every document gets the smallest doc_id of its component.

Defined results: null and empty texts and texts of white space have fingerprint zero and are linked like any other; a
null doc_id never becomes a component_id unless all of the component are null; repeated rows come back as often; texts are
read whole, of any length; an empty table gives no rows; columns ``fp`` and ``component_id`` of the input are replaced.
"""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.llm.common import materialize, remove
from marlstone.llm.graph import components

SEED = 42
SHINGLE = 3
MAX_BITS = 3
#: Positional bytes that a pair within MAX_BITS shares at least.
SHARED = 8 - MAX_BITS
#: Positions whose bytes make a posting list; any pair with SHARED common bytes has LIST of the first LIST + MAX_BITS.
LIST = 3
POSITIONS = list(combinations(range(LIST + MAX_BITS), LIST))
#: Entries of a posting list beyond which it is split.
HOT_ENTRIES = 1 << 16


def mask_of(positions: tuple[int, ...]) -> int:
    m = sum(0xFF << (8 * p) for p in positions)
    return m - (1 << 64) if m >= 1 << 63 else m


def majority(h: np.ndarray) -> int:
    """The bits set in over half of the 64-bit hashes, unsigned; 0 without hashes."""
    ones = np.zeros(64, dtype=np.int64)
    for lo in range(0, len(h), 1 << 14):
        ones += np.unpackbits(h[lo : lo + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    """SimHash of one whole text, unsigned."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < width:
        grams, n = [b" ".join(words)], 1
    else:
        grams, n = map(b" ".join, zip(*[words[k:] for k in range(width)])), len(words) - width + 1
    return majority(np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), dtype=np.uint64, count=n))


def _fingerprints(keep_text: bool):
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                fp = np.array([fingerprint(t) for t in part.column("text").to_pylist()], dtype=np.uint64).view(np.int64)
                names = [c for c in part.schema.names if keep_text or c != "text"]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in names], pa.array(fp)], names=[*names, "fp"])

    return run


def with_fingerprints(docs: DataFrame, keep_text: bool = True) -> DataFrame:
    """``docs`` with ``fp``, the fingerprint as a signed long."""
    docs = docs.drop("fp")
    fields = [f for f in docs.schema.fields if keep_text or f.name != "text"]
    return docs.mapInArrow(_fingerprints(keep_text), T.StructType([*fields, T.StructField("fp", T.LongType())]))


def shared_bytes(a: np.ndarray, b: np.ndarray | np.int64) -> np.ndarray:
    """The tally of positional bytes that two fingerprints have in common."""
    return (np.atleast_1d(a ^ b).view(np.uint8).reshape(-1, 8) == 0).sum(1)


def linked(a: np.ndarray, b: np.ndarray | np.int64) -> np.ndarray:
    """Count filter and verification: SHARED positional bytes at least, and then MAX_BITS differing bits at most."""
    out = shared_bytes(a, b) >= SHARED
    at = np.flatnonzero(out)
    out[at] = np.bitwise_count((a[at] ^ (b if np.isscalar(b) or not b.ndim else b[at])).view(np.uint64)) <= MAX_BITS
    return out


def forest(fps: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that connect what is connected within one posting list of distinct fingerprints."""
    out, rest = [], fps.copy()
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            one = queue.pop()
            near = linked(rest, one)
            found = rest[near]
            if len(found):
                out.append((np.full(len(found), one), found))
                queue.extend(found)
                rest = rest[~near]
    return out


def _links(batches):
    """Rows (which, key, fp) sorted by list in, links out; a list may span batches."""
    held: list[np.ndarray] = []
    last: tuple[int, int] | None = None

    def emit(found):
        a, b = (np.concatenate([x[k] for x in found]) if found else np.zeros(0, np.int64) for k in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    for batch in batches:
        which, key, fp = (np.asarray(batch.column(c)) for c in ("which", "key", "fp"))
        if not len(fp):
            continue
        cuts = np.flatnonzero((np.diff(which) != 0) | (np.diff(key) != 0)) + 1
        starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(fp)]])
        found: list[tuple[np.ndarray, np.ndarray]] = []
        inner = np.arange(1, len(starts) - 1)  # lists that lie within the batch
        if last == (int(which[0]), int(key[0])):
            held.append(fp[: ends[0]].copy())
        else:
            found += forest(np.concatenate(held)) if held else []
            held = [fp[: ends[0]].copy()]
        if len(starts) > 1:
            found += forest(np.concatenate(held))
            held = [fp[starts[-1] :].copy()]
        last = (int(which[-1]), int(key[-1]))
        sizes = (ends - starts)[inner]
        twos = starts[inner[sizes == 2]]
        near = linked(fp[twos], fp[twos + 1])
        found.append((fp[twos][near], fp[twos + 1][near]))
        for k in inner[sizes > 2].tolist():
            found += forest(fp[starts[k] : ends[k]])
        yield emit(found)
    if held:
        yield emit(forest(np.concatenate(held)))


def _entry(which: int, positions: tuple[int, ...]) -> Column:
    return F.struct(F.lit(which).cast("int").alias("which"), F.col("fp").bitwiseAND(F.lit(mask_of(positions))).alias("key"))


def links(fps: DataFrame, hot_entries: int = HOT_ENTRIES) -> DataFrame:
    """``a, b``: links of at most three bits between distinct fingerprints (column ``fp``), enough to connect all that is
    connected."""
    entries = fps.select("fp", F.inline(F.array(*[_entry(k, p) for k, p in enumerate(POSITIONS)])))
    hot = entries.groupBy("which", "key").agg(F.count("*").alias("n")).filter(F.col("n") > hot_entries).select("which", "key")
    if not hot.isEmpty():
        cold = entries.join(hot, ["which", "key"], "left_anti")
        deeper = []  # a hot list's own lists: two positions more
        for k, p in enumerate(POSITIONS):
            others = [q for q in range(8) if q not in p]
            deeper.append(F.array(*[_entry(len(POSITIONS) * (j + 1) + k, (*p, *two)) for j, two in enumerate(combinations(others, SHARED - LIST))]))
        split = entries.join(hot, ["which", "key"], "left_semi").withColumn("lists", F.get(F.array(*deeper), F.col("which")))
        entries = cold.select("which", "key", "fp").unionByName(split.select("fp", F.inline("lists")))
    return entries.repartition("which", "key").sortWithinPartitions("which", "key").mapInArrow(_links, "a long, b long").distinct()


def classes(spark: SparkSession, marked: DataFrame, hot_entries: int = HOT_ENTRIES) -> DataFrame:
    """``fp, root``: each distinct fingerprint of ``marked`` and the representative fingerprint of its component."""
    distinct, path = materialize(spark, marked.select("fp").distinct(), "fingerprints")
    roots = components(spark, links(distinct, hot_entries)).select(F.col("a").alias("fp"), F.col("b").alias("root"))
    return distinct.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(spark: SparkSession, docs: DataFrame, hot_entries: int = HOT_ENTRIES) -> DataFrame:
    """The columns of ``docs`` but ``text``, with ``fp`` and ``component_id`` (smallest doc_id of the component)."""
    marked, _ = materialize(spark, with_fingerprints(docs.drop("component_id"), keep_text=False), "marked")
    smallest, path = materialize(spark, marked.groupBy("fp").agg(F.min("doc_id").alias("d")), "smallest")
    roots, at_roots = materialize(spark, classes(spark, smallest, hot_entries).join(smallest, "fp"), "roots")
    ids = roots.groupBy("root").agg(F.min("d").alias("component_id"))
    out, _ = materialize(spark, roots.join(ids, "root").select("fp", "component_id"), "components")
    remove(spark, path, at_roots)
    return marked.join(out, "fp")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = near_duplicates(spark, docs)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
