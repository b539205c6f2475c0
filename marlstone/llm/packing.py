"""Operator 6: packing documents into sequences by cutting stock with column generation.

1. Tokenize: every document becomes its ids and the end id; pieces of a full sequence are cut off its front, what
   remains is one shorter piece. The pieces with their ids are written to the shared folder.
2. The lengths of the shorter pieces are counted in classes of ``unit`` ids (a histogram of at most
   ``sequence / unit`` rows, whatever the input). ``cutting_stock.solve`` finds the patterns; it may cut pieces of one
   class into two where lengths do not combine.
3. The patterns are rounded down; what that leaves over is placed first-fit, largest class first.
4. Documents are ranked within their class, in hashed buckets so that no class is sorted in one task, and a rank finds
   its pattern, sequence and place by arithmetic against the pattern table (bounded by the square of the number of
   classes, so it is broadcast).

Defined results: a null or empty text is the end id alone; empty tables give no rows; repeated rows are packed one by
one; texts of any length are cut. Columns of the input that clash with added ones are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.llm.common import materialize
from marlstone.llm.cutting_stock import solve
from marlstone.llm.tokens import END_ID, default_tokenizer_paths, encoder

SEQUENCE = 2048
UNIT = 16
CUT_ROUNDS = 4
PIECE = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("doc_tokens", T.LongType()),
        T.StructField("ids", T.BinaryType()),
    ]
)


def _pieces(json_path: str, tiktoken_path: str, sequence: int):
    def run(batches):
        enc = encoder(json_path, tiktoken_path)
        end = np.array([END_ID], "<u4").tobytes()
        step = 4 * sequence
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                out: list[tuple] = []
                for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                    ids = enc.ids(text) + end
                    n = len(ids) // 4
                    out.extend((doc, lo // 4, min(step, len(ids) - lo) // 4, n, ids[lo : lo + step]) for lo in range(0, len(ids), step))
                if out:
                    cols = list(zip(*out))
                    kinds = [pa.int64()] * 4 + [pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=PIECE.names)

    return run


def tokenize_pieces(docs: DataFrame, sequence: int = SEQUENCE, tokenizer: tuple[str, str] | None = None) -> DataFrame:
    """One row for each piece of at most ``sequence`` ids: doc_id, start, length, doc_tokens, ids (little-endian 32-bit)."""
    json_path, tiktoken_path = tokenizer or default_tokenizer_paths()
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_pieces(json_path, tiktoken_path, sequence), PIECE)


def ranked(rows: DataFrame, by: str, key: str, buckets: int) -> DataFrame:
    """``rank`` from 0 within ``by``, gapless: ranks within hashed buckets plus the buckets' offsets."""
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64(F.lit(6), key), F.lit(buckets)))
    sizes = rows.groupBy(by, "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy(by).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(by, "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    within = Window.partitionBy(by, "bucket").orderBy(key)
    numbered = rows.withColumn("place", F.row_number().over(within) - 1)
    return numbered.join(offsets, [by, "bucket"]).withColumn("rank", F.col("first") + F.col("place")).drop("bucket", "place", "first")


def round_patterns(patterns: list[tuple[np.ndarray, float]], demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Whole patterns that cover ``demand``: rounded down, the rest first-fit with the largest class first."""
    out = [(counts, int(np.floor(x + 1e-4))) for counts, x in patterns]
    out = [(counts, times) for counts, times in out if times > 0]
    left = demand.astype(np.int64).copy()
    for counts, times in out:
        left -= counts * times
    left = np.maximum(left, 0)
    while left.any():
        counts, room = np.zeros_like(left), capacity
        for c in range(min(room, len(left)), 0, -1):
            n = min(left[c - 1], room // c)
            if n:
                counts[c - 1] += n
                room -= n * c
        times = int(min(left[counts > 0] // counts[counts > 0]))
        out.append((counts, times))
        left -= counts * times
    return out


def _cut_pieces(spark: SparkSession, rows: DataFrame, cut_rows: list[tuple[int, int, int, int]], unit: int, buckets: int) -> DataFrame:
    """``rows`` with those of the given classes and ranks (class, lo, hi, at) cut in two after ``at`` ids."""
    table = F.broadcast(spark.createDataFrame(cut_rows, "class int, lo long, hi long, at long"))  # a row for each cut column
    r = ranked(rows.withColumn("key", F.struct("piece_id", "start")), "class", "key", buckets)
    hit = (r["class"] == table["class"]) & (r["rank"] >= table["lo"]) & (r["rank"] < table["hi"])
    r = r.join(table, hit, "left").select(r["piece_id"], r["start"], r["length"], r["whole"], "at")
    halves = F.array(
        F.struct(F.col("start"), F.col("at").alias("length")),
        F.struct((F.col("start") + F.col("at")).alias("start"), (F.col("length") - F.col("at")).alias("length")),
    )
    uncut = F.array(F.struct("start", "length"))
    rows = r.select("piece_id", (F.col("whole") & F.col("at").isNull()).alias("whole"), F.inline(F.when(F.col("at").isNotNull(), halves).otherwise(uncut)))
    return rows.withColumn("class", F.ceil(F.col("length") / unit).cast("int"))


def place_pieces(spark: SparkSession, pieces: DataFrame, sequence: int = SEQUENCE, unit: int = UNIT) -> tuple[DataFrame, bool]:
    """``piece_id, start, length`` of short pieces to ``piece_id, start, length, whole, sequence_id, offset``; a piece that
    a cut divides comes back as two rows that are not ``whole``. Also whether there are cuts."""
    capacity = sequence // unit
    rows = pieces.withColumn("class", F.ceil(F.col("length") / unit).cast("int"))
    histogram = {r["class"]: r["n"] for r in rows.groupBy("class").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    demand = np.array([histogram.get(c, 0) for c in range(1, capacity + 1)], dtype=np.int64)
    buckets = max(1, int(demand.sum()) // 50_000)
    rows = rows.withColumn("whole", F.lit(True))
    any_cut = False
    for _ in range(CUT_ROUNDS):  # parts of a cut may be cut again
        cut_rows, used = [], {}
        for c, a, times in solve(demand, capacity)[1] if demand.any() else ():
            lo = used.get(c, 0)
            hi = min(int(demand[c - 1]), lo + int(times + 1e-4))
            if hi > lo:
                cut_rows.append((c, lo, hi, a * unit))
                used[c] = hi
        if not cut_rows:
            break
        any_cut = True
        rows = _cut_pieces(spark, rows, cut_rows, unit, buckets)
        for c, lo, hi, at in cut_rows:
            demand[c - 1] -= hi - lo
            demand[at // unit - 1] += hi - lo
            demand[c - at // unit - 1] += hi - lo
    patterns = solve(demand, capacity, cut_cost=np.inf)[0] if demand.any() else []
    plan = round_patterns(patterns, demand, capacity)
    slots, first, base = [], np.zeros(capacity, dtype=np.int64), 0
    for counts, times in plan:
        for c in np.flatnonzero(counts):
            slots.append((int(c) + 1, int(first[c]), int(first[c] + counts[c] * times), int(counts[c]), base))
            first[c] += counts[c] * times
        base += times
    table = F.broadcast(spark.createDataFrame(slots, "class int, lo long, hi long, per long, base long"))
    r = ranked(rows.withColumn("key", F.struct("piece_id", "start")), "class", "key", buckets).drop("key")
    placed = r.join(table, (r["class"] == table["class"]) & (r["rank"] >= table["lo"]) & (r["rank"] < table["hi"])).select(
        "piece_id", "start", "length", "whole", r["class"].alias("class"), F.expr("base + (rank - lo) div per").alias("sequence_id"), F.expr("(rank - lo) % per").alias("nth")
    )
    # a sequence holds at most `capacity` pieces
    w = Window.partitionBy("sequence_id").orderBy(F.desc("class"), "nth").rowsBetween(Window.unboundedPreceding, -1)
    out = placed.select("piece_id", "start", "length", "whole", "sequence_id", F.coalesce(F.sum("length").over(w), F.lit(0)).alias("offset"))
    return out, any_cut


def pack(spark: SparkSession, docs: DataFrame, sequence: int = SEQUENCE, unit: int = UNIT, tokenizer: tuple[str, str] | None = None, carry: list | None = None) -> DataFrame:
    """One row for each placed piece: doc_id, start, length, doc_tokens, sequence_id, offset, and the columns ``carry``
    made from ``ids`` (by default ``ids`` itself)."""
    pieces = tokenize_pieces(docs, sequence, tokenizer).withColumn("piece_id", F.monotonically_increasing_id())
    pieces, _ = materialize(spark, pieces, "pieces")
    short = pieces.filter(F.col("length") < sequence).select("piece_id", "start", "length")
    placed, any_cut = place_pieces(spark, short, sequence, unit)
    placed, _ = materialize(spark, placed, "placed")
    sequences = (placed.agg(F.max("sequence_id").alias("m")).first()["m"] or 0) + 1
    carry = carry or [F.col("ids")]
    names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", *pieces.select(*carry).columns]
    full = pieces.filter(F.col("length") == sequence).select(
        "doc_id", "start", "length", "doc_tokens", (F.col("piece_id") + sequences).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), *carry
    )
    rest = pieces.filter(F.col("length") < sequence)
    one = rest.select("piece_id", "doc_id", "doc_tokens", *carry).join(placed.filter("whole"), "piece_id")
    out = full.select(names).unionByName(one.select(names))
    if any_cut:  # the ids of a part are a slice of the piece's
        parts = rest.select("piece_id", "doc_id", "doc_tokens", "ids", F.col("start").alias("from")).join(placed.filter("not whole"), "piece_id")
        parts = parts.withColumn("ids", F.expr("substring(ids, cast(4 * (start - from) + 1 as int), cast(4 * length as int))"))
        out = out.unionByName(parts.select("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", *carry).select(names))
    return out


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    packed = pack(spark, docs, carry=[F.crc32("ids").alias("ids_crc32")])
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
