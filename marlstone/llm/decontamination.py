"""Operator 4: benchmark decontamination by greedy string tiling.

1. Test items and documents are tokenized; a seed is a window of ``MIN_MATCH`` tokens (of all its tokens for an item that
   has fewer). The items' seeds are a table. A bitmap of them, of fixed size whatever the benchmark, goes to all tasks.
2. One pass over the documents keeps, of each, the seeds the bitmap knows and the tokens around them, as hashes; no tile
   can lie elsewhere. Where the bitmap is too full to tell, more seeds go on to the join, and nothing else changes.
3. The documents' seeds are joined to the items' seeds, and counted for each document and item with partial sums first.
   Pairs that share too few seeds to reach the threshold at all (an exact lower bound) end here.
4. The others go through Running Karp-Rabin greedy string tiling: the longest non-overlapping common runs of tokens are
   marked again and again, with search lengths that fall to ``MIN_MATCH``. The tiles' share of the item's tokens is its
   coverage, which does not depend on the passages' order; from ``COVERAGE`` on the document is contaminated.

Tokens are compared by 63-bit hashes.

Defined results: null and empty documents match nothing; null items and items without a letter or digit are skipped;
repeated items and repeated documents give a row each; equally long tiles are marked by their place in the item, then in
the text; an empty benchmark or table gives no rows; documents of any length are scanned whole; columns of any name pass
through ``without_contaminated``.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.llm.common import materialize, remove, unused, with_address

MIN_MATCH = 5
COVERAGE = 0.5
#: Bits of the bitmap of seeds (4 MB), and the groups its parts are put together in.
BITS, GROUPS = 1 << 25, 8
_WORD = re.compile(r"[^\W_]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)
BREAK = -1


class _Hashes(dict):
    """Token to its hash; emptied when it has grown to a million tokens."""

    def __missing__(self, token: str) -> int:
        import xxhash

        if len(self) >= 1 << 20:
            self.clear()
        self[token] = h = xxhash.xxh3_64_intdigest(token.encode("utf-8", "surrogatepass")) >> 1
        return h


_HASHES = _Hashes()


def tokens(text: str | None) -> np.ndarray:
    """The hashes of a text's tokens: lower-cased runs of letters and digits."""
    found = _WORD.findall(text.lower()) if text else []
    return np.fromiter(map(_HASHES.__getitem__, found), dtype=np.int64, count=len(found))


def window_hashes(ids: np.ndarray, width: int) -> np.ndarray:
    """Karp-Rabin values of all windows, modulo 2 ** 64 (by doubling, so no long products)."""
    n = len(ids) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    part, size, power = (ids + 1).astype(np.uint64), 1, _BASE
    out, done = None, 0
    with np.errstate(over="ignore"):
        w = width
        while w:
            if w & 1:
                out = part[done:].copy() if out is None else out[: len(part) - done] * power + part[done : done + len(out)]
                done += size
            w >>= 1
            if w:
                part = part[:-size] * power + part[size:] if len(part) > size else part[:0]
                power, size = power * power, 2 * size
        return ((out[:n] * _BASE) ^ (out[:n] >> np.uint64(29))).view(np.int64)


def run_length(item: np.ndarray, text: np.ndarray, free_item: np.ndarray, free_text: np.ndarray, i: int, j: int) -> int:
    """How far the free tokens from i and j on agree."""
    n, at, step = min(len(item) - i, len(text) - j), 0, 16
    while at < n:
        a, b = slice(i + at, i + min(n, at + step)), slice(j + at, j + min(n, at + step))
        same = (item[a] == text[b]) & free_item[a] & free_text[b]
        if not same.all():
            return at + int(same.argmin())
        at, step = at + step, 4 * step
    return n


def tile(item: np.ndarray, text: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Running Karp-Rabin greedy string tiling of two token arrays (BREAK matches nothing): (item at, text at, length).
    For each window of the item its places in the text are one array, so the work is that of the item's length times the
    text's in array operations at most, and only the beginnings of common runs are followed."""
    free_item, free_text = item != BREAK, text != BREAK
    tiles: list[tuple[int, int, int]] = []
    search = max(least, len(item) // 2)

    def open_windows(free: np.ndarray, width: int) -> np.ndarray:
        run = np.concatenate([[0], np.cumsum(free)])
        return np.flatnonzero(run[width:] - run[:-width] == width) if len(free) >= width else np.zeros(0, dtype=np.int64)

    while True:
        found: list[tuple[int, int, int]] = []
        a, b = open_windows(free_item, search), open_windows(free_text, search)
        longest = 0
        if len(a) and len(b):
            ha, hb = window_hashes(item, search)[a], window_hashes(text, search)[b]
            order = np.argsort(hb, kind="stable")
            lo, hi = np.searchsorted(hb[order], ha, "left"), np.searchsorted(hb[order], ha, "right")
            for i, l, h in zip(a.tolist(), lo.tolist(), hi.tolist()):
                at = b[order[l:h]]
                if i and free_item[i - 1] and len(at):  # what goes on to the left is part of a run that begins further left
                    at = at[(at == 0) | ~free_text[at - 1] | (text[at - 1] != item[i - 1])]
                for j in at.tolist():
                    k = run_length(item, text, free_item, free_text, i, j)
                    if k >= search:
                        found.append((i, j, k))
                        longest = max(longest, k)
        if longest > 2 * search:
            search = longest
            continue
        again = False
        for i, j, k in sorted(found, key=lambda x: (-x[2], x[0], x[1])):
            if free_item[i : i + k].all() and free_text[j : j + k].all():
                free_item[i : i + k] = False
                free_text[j : j + k] = False
                tiles.append((i, j, k))
            else:
                again = True  # an occluded match may leave a shorter one
        if search > least:
            search = max(least, search // 2) if not again else max(least, min(search - 1, search))
        elif not again:
            return tiles


def _items(least: int, coverage: float):
    """key, text to key, ids, width, need, and the seeds with their number of places."""

    def run(batches):
        for batch in batches:
            rows = []
            for key, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist()):
                ids = tokens(text)
                if len(ids):
                    width = min(least, len(ids))
                    seeds, times = np.unique(window_hashes(ids, width), return_counts=True)
                    # tiles of at least `width` tokens that cover a share c of n hold c * n / width seeds or more
                    rows.append((key, ids.tobytes(), width, math.ceil(coverage * len(ids) / width), seeds.tolist(), times.tolist()))
            if rows:
                kinds = [pa.binary(), pa.binary(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["key", "ids", "width", "need", "seeds", "times"])

    return run


def _bits(batches):
    out = np.zeros(BITS // 8, dtype=np.uint8)
    for batch in batches:
        at = np.asarray(batch.column("seed")) & (BITS - 1)
        np.bitwise_or.at(out, at >> 3, (1 << (at & 7)).astype(np.uint8))
    yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], names=["v"])


def _either(table: pa.Table) -> pa.Table:
    out = np.zeros(BITS // 8, dtype=np.uint8)
    for v in table.column("v"):
        out |= np.frombuffer(v.as_buffer(), np.uint8)
    return pa.table({"v": pa.array([out.tobytes()], pa.binary())})


def bitmap_of(seeds: DataFrame) -> np.ndarray:
    """The bitmap of a table's seeds: one for each task, put together in GROUPS groups, BITS / 8 bytes each."""
    out = np.zeros(BITS // 8, dtype=np.uint8)
    parts = seeds.select("seed").mapInArrow(_bits, "v binary").withColumn("g", F.pmod(F.spark_partition_id(), F.lit(GROUPS)))
    for r in parts.groupBy("g").applyInArrow(_either, "v binary").toLocalIterator():
        out |= np.frombuffer(r["v"], np.uint8)
    return out


def passages(ids: np.ndarray, widths: list[int], bitmap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The seeds of a document that the bitmap knows, and its tokens that lie in one, with a BREAK after each passage."""
    near, seeds = np.zeros(len(ids) + 1, dtype=np.int64), []
    for width in widths:
        h = window_hashes(ids, width)
        low = h & (BITS - 1)
        at = np.flatnonzero((bitmap[low >> 3] >> (low & 7).astype(np.uint8)) & 1)
        if len(at):
            seeds.append(h[at])
            np.add.at(near, at, 1)
            np.add.at(near, at + width, -1)
    if not seeds:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = np.cumsum(near)[:-1] > 0
    part = np.where(inside, ids, BREAK)
    inside[1:] |= inside[:-1].copy()
    return np.unique(np.concatenate(seeds)), part[inside]


def _hits(shared, widths: list[int]):
    def run(batches):
        bitmap = shared.value
        for batch in batches:
            rows = []
            for file, row, doc, text in zip(*(batch.column(c).to_pylist() for c in ("file", "row", "doc_id", "text"))):
                seeds, part = passages(tokens(text), widths, bitmap)
                if len(seeds):
                    rows.append((file, row, doc, seeds.tolist(), part.tobytes()))
            if rows:
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["file", "row", "doc_id", "seeds", "part"])

    return run


def _tiled(coverage: float):
    def run(batches):
        for batch in batches:
            rows = []
            for file, row, doc, key, ids, width, part in zip(*(batch.column(c).to_pylist() for c in ("file", "row", "doc_id", "key", "ids", "width", "part"))):
                item = np.frombuffer(ids, np.int64)
                lengths = [k for _, _, k in tile(item, np.frombuffer(part, np.int64), width)]
                if sum(lengths) / len(item) >= coverage:
                    rows.append((file, row, doc, key, sum(lengths) / len(item), len(lengths), max(lengths)))
            if rows:
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.float64(), pa.int32(), pa.int32()]
                names = ["file", "row", "doc_id", "key", "coverage", "tiles", "longest"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return run


def text_key(text: str = "text"):
    return F.unhex(F.md5(F.col(text).cast("binary")))


def tiled_pairs(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, least: int, coverage: float) -> DataFrame:
    """``file, row, doc_id, key, coverage, tiles, longest``, written; ``docs`` has file, row, doc_id, text, and key is the
    ``text_key`` of a test item."""
    texts = benchmark.filter(F.length("text") > 0).select(text_key().alias("key"), "text").dropDuplicates(["key"])
    items, at_items = materialize(spark, texts.mapInArrow(_items(least, coverage), "key binary, ids binary, width int, need long, seeds array<long>, times array<long>"), "items")
    seeds = items.select("key", "need", F.explode(F.arrays_zip("seeds", "times")).alias("s")).select(F.col("s.seeds").alias("seed"), F.col("s.times").alias("times"), "key", "need")
    widths = sorted(r["width"] for r in items.select("width").distinct().collect())  # `least` rows at most
    shared = spark.sparkContext.broadcast(bitmap_of(seeds))
    hits = docs.mapInArrow(_hits(shared, widths), "file long, row long, doc_id long, seeds array<long>, part binary")
    hits, at_hits = materialize(spark, hits, "hits")
    met = hits.select("file", "row", F.explode("seeds").alias("seed")).join(seeds, "seed").groupBy("file", "row", "key").agg(F.sum("times").alias("present"), F.max("need").alias("need"))
    near = met.filter("present >= need").select("file", "row", "key")
    pairs = near.join(hits.select("file", "row", "doc_id", "part"), ["file", "row"]).join(items.select("key", "ids", "width"), "key")
    out, _ = materialize(spark, pairs.mapInArrow(_tiled(coverage), "file long, row long, doc_id long, key binary, coverage double, tiles int, longest int"), "tiled")
    remove(spark, at_items, at_hits)
    return out


def _addressed(spark: SparkSession, docs: DataFrame):
    file, row = unused("file", docs.columns), unused("row", docs.columns)
    addressed, paths = with_address(spark, docs, file, row)
    return file, row, addressed, addressed.select(F.col(file).alias("file"), F.col(row).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")


def contaminated_pairs(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, least: int = MIN_MATCH, coverage: float = COVERAGE) -> DataFrame:
    """``doc_id, item_id, coverage, tiles, longest`` for each document and test item at or above the threshold."""
    *_, rows = _addressed(spark, docs)
    names = benchmark.filter(F.length("text") > 0).select(F.col("item_id").cast("long").alias("item_id"), text_key().alias("key"))
    return tiled_pairs(spark, rows, benchmark, least, coverage).join(names, "key").select("doc_id", "item_id", "coverage", "tiles", "longest")


def without_contaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, least: int = MIN_MATCH, coverage: float = COVERAGE) -> DataFrame:
    """``docs`` without the rows that any test item contaminates. Whether the contaminated rows' addresses are broadcast or
    the documents shuffled follows from their measured size."""
    file, row, addressed, rows = _addressed(spark, docs)
    found = tiled_pairs(spark, rows, benchmark, least, coverage).select(F.col("file").alias(file), F.col("row").alias(row))
    return addressed.join(found, [file, row], "left_anti").select(*docs.columns)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contaminated documents, one row for each test item found in them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return contaminated_pairs(spark, docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
