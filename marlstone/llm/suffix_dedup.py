"""Operator 1: removal of byte strings of ``LENGTH`` bytes that occur more than once, by merged Burrows-Wheeler transforms.

1. Equal texts are collapsed into one row with a count (partial sums first), in a table bucketed by a hash of the text
   (``tid``), so that later joins of spans to texts move spans only.
2. Every window of LENGTH bytes has a least hashed 32-byte gram (its minimizer); equal windows have equal minimizers.
   A text falls into runs of windows with one minimizer; a run's bytes are a string. Equal strings are collapsed: copies
   of a string repeat it whole. A string whose minimizer occurs nowhere else holds no repeat.
3. The distinct strings of a minimizer are dealt out together, their suffixes sorted in shards, and the shards' transforms
   merged by interleave refinement (``interleave``); its intervals are the windows that repeat.
4. A minimizer with more than ``HOT_BYTES`` of distinct strings (say, at the end of a passage that a third of all documents
   hold) is split: its strings are cut into pieces of few windows, by their place around the minimizer. All windows of a
   piece hold the bytes in its middle, so equal windows lie in pieces with equal middles, which take the minimizer's place.
   What is still too large is cut into single windows. Steps 2 and 3 then go on with the pieces as with any other strings.
5. Spans go back to the texts, are united and cut out.

Strings are told apart by 128 bits of hashes. Texts of any length are cut whole, and one text's repeats count.

Defined results: null texts count as empty; texts shorter than LENGTH stay; a text that occurs twice (LENGTH bytes at least)
is removed from every row; an empty table gives no rows; what remains is kept as bytes, since spans may cut characters;
only ``text`` (and ``doc_id`` in the query) is read, so other columns can't clash; repeated rows come back as often.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.common import bucketed, drop_bucketed, materialize, remove
from marlstone.llm.interleave import repeated_windows

LENGTH = 400
GRAM = 32
#: Distinct strings of one minimizer beyond this many bytes are cut into pieces, of so many windows at each cut.
HOT_BYTES = 4 << 20
PIECES = (16, 1)
BIN_BYTES = 1 << 20
SPANS = "array<struct<lo:int,hi:int>>"
RUNS = "v long, dg long, tid binary, start int, n int, inner boolean"
RUN_NAMES = ["v", "dg", "tid", "start", "n", "inner"]


def gram_hashes(b: np.ndarray, width: int = GRAM) -> np.ndarray:
    """Mixed 64-bit hashes of all grams of ``width`` (a power of two) bytes."""
    with np.errstate(over="ignore"):
        h, power, size = b.astype(np.uint64) + np.uint64(1), np.uint64(0x9E3779B97F4A7C15), 1
        while size < width:
            h = h[:-size] * power + h[size:]
            power, size = power * power, 2 * size
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    return h


def sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    out, size = h, 1
    while 2 * size <= width:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    rest = width - size
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def _runs(length: int):
    """tid, text to one row for each run: v (minimizer), dg (hash of its string), start, n (windows), inner (the minimizer
    occurs twice or more in the string)."""

    def run(batches):
        import xxhash

        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                cols: list[list] = [[], [], [], [], [], []]
                for tid, text in zip(part.column("tid").to_pylist(), part.column("text").to_pylist()):
                    raw = text.encode("utf-8", "surrogatepass")
                    if len(raw) < length:
                        continue
                    h = gram_hashes(np.frombuffer(raw, dtype=np.uint8))
                    least = sliding_min(h, length - GRAM + 1)
                    cut = np.concatenate([[0], np.flatnonzero(least[1:] != least[:-1]) + 1, [len(least)]])
                    for a, z in zip(cut[:-1].tolist(), cut[1:].tolist()):
                        v = least[a]
                        end = z - 1 + length
                        cols[0].append(int(v.view(np.int64)))
                        cols[1].append(xxhash.xxh3_64_intdigest(raw[a:end]) - (1 << 63))
                        cols[2].append(tid)
                        cols[3].append(a)
                        cols[4].append(z - a)
                        cols[5].append(int(np.count_nonzero(h[a : end - GRAM + 1] == v)) > 1)
                if cols[0]:
                    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.bool_()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=RUN_NAMES)

    return run


def _strings(length: int):
    """text and its wanted runs to v, dg, string."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                v, dg, out = [], [], []
                for text, wanted in zip(part.column("text").to_pylist(), part.column("wanted").to_pylist()):
                    raw = text.encode("utf-8", "surrogatepass")
                    for w in wanted:
                        v.append(w["v"])
                        dg.append(w["dg"])
                        out.append(raw[w["start"] : w["start"] + w["n"] - 1 + length])
                if v:
                    yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()), pa.array(dg, pa.int64()), pa.array(out, pa.binary())], names=["v", "dg", "string"])

    return run


def to_spans(flags: np.ndarray) -> list[dict]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return [{"lo": int(a), "hi": int(b)} for a, b in zip(edge[::2], edge[1::2])]


def _merge(length: int):
    """v, dg, string, sorted by v, to v, dg, spans of windows that repeat. Strings of whole minimizers are merged together
    in bins of about BIN_BYTES; other minimizers in a bin can't match, so any grouping is right."""

    def run(batches):
        keys: list[tuple[int, int]] = []
        strings: list[bytes] = []
        size = 0

        def flush():
            rows = [(v, dg, to_spans(f)) for (v, dg), f in zip(keys, repeated_windows(strings, length)) if f.any()]
            keys.clear()
            strings.clear()
            if rows:
                kinds = [pa.int64(), pa.int64(), pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["v", "dg", "spans"])

        for batch in batches:
            for v, dg, s in zip(batch.column("v").to_pylist(), batch.column("dg").to_pylist(), batch.column("string").to_pylist()):
                if size >= BIN_BYTES and keys and keys[-1][0] != v:
                    yield from flush()
                    size = 0
                keys.append((v, dg))
                strings.append(s)
                size += len(s)
        if keys:
            yield from flush()

    return run


def _pieces(length: int, width: int):
    """text and its wanted strings to rows like those of ``_runs``, one for each piece of at most ``width`` windows: v is
    the hash of the bytes that all windows of the piece hold and of the piece's place around the minimizer."""

    def run(batches):
        import xxhash

        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                rows = []
                for tid, text, wanted in zip(*(part.column(c).to_pylist() for c in ("tid", "text", "wanted"))):
                    raw = text.encode("utf-8", "surrogatepass")
                    for w in wanted:
                        string = raw[w["start"] : w["start"] + w["n"] - 1 + length]
                        places = np.arange(w["n"])
                        if width > 1:
                            grams = np.flatnonzero(gram_hashes(np.frombuffer(string, dtype=np.uint8)).view(np.int64) == w["v"])
                            first = grams[np.searchsorted(grams, places)]  # where the minimizer first lies in each window
                            group = (first - places) // width
                            cut = np.concatenate([[0], np.flatnonzero((np.diff(first) != 0) | (np.diff(group) != 0)) + 1, [w["n"]]])
                        else:
                            first, group, cut = places, np.zeros(w["n"], dtype=np.int64), np.arange(w["n"] + 1)
                        for a, z in zip(cut[:-1].tolist(), cut[1:].tolist()):
                            # the last start and the first end that a window of this group can have, cut off or not
                            last = int(first[a] - group[a] * width)
                            middle, whole = string[last : last - width + 1 + length], string[a : z - 1 + length]
                            v, dg = xxhash.xxh3_64_intdigest(middle, int(group[a]) + 1), xxhash.xxh3_64_intdigest(whole)
                            rows.append((v - (1 << 63), dg - (1 << 63), tid, w["start"] + a, z - a, False))
                if rows:
                    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.bool_()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=RUN_NAMES)

    return run


def _cut(length: int):
    """text and the spans of repeated windows to n_bytes, removed byte spans and the bytes that remain."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                out = []
                for tid, text, found in zip(*(part.column(c).to_pylist() for c in ("tid", "text", "found"))):
                    raw = text.encode("utf-8", "surrogatepass")
                    gone, spans = 0, []
                    for lo, hi in sorted((x["lo"], x["hi"] - 1 + length) for x in found):
                        if spans and lo <= spans[-1][1]:
                            spans[-1][1] = max(spans[-1][1], hi)
                        else:
                            spans.append([lo, hi])
                    kept, last = [], 0
                    for lo, hi in spans:
                        kept.append(raw[last:lo])
                        gone += hi - lo
                        last = hi
                    kept.append(raw[last:])
                    out.append((tid, [{"lo": a, "hi": b} for a, b in spans], gone, b"".join(kept)))
                if out:
                    kinds = [pa.binary(), pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())])), pa.int64(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["tid", "spans", "n_removed", "kept"])

    return run


def text_id(text: str = "text"):
    return F.substring(F.unhex(F.sha2(F.col(text), 256)), 1, 16)


def distinct_texts(spark: SparkSession, docs: DataFrame, length: int) -> tuple[DataFrame, str, str]:
    """``tid, text, copies`` of texts of ``length`` bytes at least, bucketed by tid in the shared folder; the table's name
    and path. Copies are collapsed before they are shuffled."""
    rows = docs.filter(F.octet_length("text") >= length).select(text_id().alias("tid"), "text")
    return bucketed(spark, rows.groupBy("tid").agg(F.first("text").alias("text"), F.count("*").alias("copies")), "texts", "tid")


def with_bytes(texts: DataFrame, rows: DataFrame) -> DataFrame:
    """``tid, text, wanted``: the texts that ``rows`` (tid, v, dg, start, n) name, each with its rows."""
    wanted = rows.groupBy("tid").agg(F.collect_list(F.struct("v", "dg", "start", "n")).alias("wanted"))  # strings of one text
    return texts.select("tid", "text").join(wanted, "tid")


def repeated_spans(spark: SparkSession, texts: DataFrame, length: int = LENGTH, hot_bytes: int = HOT_BYTES) -> tuple[DataFrame, list[str]]:
    """``tid, found``: spans of window starts (lo, hi) that repeat, for each text that has any; and the paths it reads."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = texts.select("tid", "text").mapInArrow(_runs(length), RUNS)
    placed, paths = None, []
    for width in (*PIECES, 0):
        rows, at_rows = materialize(spark, rows, "runs")
        # copies of a string are counted before they meet, one of them stands for all
        strings = rows.groupBy("v", "dg").agg(F.count("*").alias("c"), F.min(F.struct("tid", "start", "n")).alias("at"), F.max("inner").alias("inner"))
        strings, at_strings = materialize(spark, strings, "strings")
        groups = strings.groupBy("v").agg(F.count("*").alias("k"), F.max("inner").alias("i"), F.sum(F.col("at.n") + length - 1).alias("size"))
        # a skewed join that writes what it joins, so its large partitions can be split
        mixed, at_mixed = materialize(spark, strings.join(groups.filter("k > 1 or i").select("v", "size"), "v").select("v", "dg", "c", "at.*", "size"), "mixed")
        dealt = with_bytes(texts, mixed.filter(F.col("size") <= hot_bytes)).select("text", "wanted").mapInArrow(_strings(length), "v long, dg long, string binary")
        found = dealt.repartition(parts, "v").sortWithinPartitions("v").mapInArrow(_merge(length), f"v long, dg long, spans {SPANS}")
        # what is found in a string holds at its one place; of a string with copies all windows repeat, at every place
        single = found.join(mixed.filter("c = 1").select("v", "dg", "tid", "start"), ["v", "dg"])
        single = single.select("tid", F.expr(f"cast(transform(spans, x -> struct(x.lo + start as lo, x.hi + start as hi)) as {SPANS})").alias("s"))
        copies = rows.join(strings.filter("c > 1").select("v", "dg"), ["v", "dg"], "left_semi")
        copies = copies.select("tid", F.array(F.struct(F.col("start").alias("lo"), (F.col("start") + F.col("n")).alias("hi"))).cast(SPANS).alias("s"))
        here, at_here = materialize(spark, single.unionByName(copies), "placed")
        placed = here if placed is None else placed.unionByName(here)
        paths.append(at_here)
        hot = mixed.filter(F.col("size") > hot_bytes)
        if not width or hot.isEmpty():
            remove(spark, at_rows, at_strings, at_mixed)
            break
        rows, at_pieces = materialize(spark, with_bytes(texts, hot).mapInArrow(_pieces(length, width), RUNS), "pieces")
        remove(spark, at_rows, at_strings, at_mixed)
        paths.append(at_pieces)
    return placed.groupBy("tid").agg(F.flatten(F.collect_list("s")).alias("found")), paths


def remove_repeats(spark: SparkSession, docs: DataFrame, length: int = LENGTH, hot_bytes: int = HOT_BYTES) -> DataFrame:
    """For each distinct text that loses bytes: ``tid, spans, n_removed, kept``."""
    texts, name, path = distinct_texts(spark, docs, length)
    found, paths = repeated_spans(spark, texts, length, hot_bytes)
    once = F.array(F.struct(F.lit(0).alias("lo"), (F.octet_length("text") - length + 1).alias("hi"))).cast(SPANS)
    with_spans = texts.join(found, "tid", "left").select("tid", "text", F.when(F.col("copies") > 1, once).otherwise(F.col("found")).alias("found"))
    cut = with_spans.filter("found is not null").mapInArrow(_cut(length), f"tid binary, spans {SPANS}, n_removed long, kept binary")
    cut, _ = materialize(spark, cut, "cut")
    drop_bucketed(spark, name, path)
    remove(spark, *paths)
    return cut


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    cut = remove_repeats(spark, docs).select("tid", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha"))
    rows = docs.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("whole")).withColumn("tid", F.substring(F.unhex("whole"), 1, 16))
    return rows.join(cut, "tid", "left").select(
        "doc_id",
        "n_bytes",
        F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"),
        F.coalesce("n_spans", F.lit(0).cast("long")).alias("n_spans"),
        F.coalesce("kept_sha", "whole").alias("kept_sha256"),
    )
