"""Operator 11: document fingerprints by one-permutation MinHash.

A text's five-word shingles are hashed once. The high bits of a hash name one of ``BINS`` bins, and a bin keeps its least
hash. An empty bin takes the value of another by optimal densification: each bin has its own random order of all bins, and
the first one in it that had a hash of its own is taken; the orders are the same for every text, so two texts that agree
where they look stay alike. Each bin's value is mixed with the bin's number, so that bins of one value agree with those of
another by chance one by one, not all at once; the lowest ``BITS`` bits of that are stored, packed and written as
hexadecimal. Bins of unlike texts agree by chance once in 2 ** ``BITS``; ``likeness`` takes that off:
(agreeing - c) / (1 - c), at least 0.

``chain`` gives each document the next one by doc_id. Texts are dealt out once, by ranges of doc_id and place in the file
(so repeated ids don't fill a range), and sorted; a task streams its rows and fingerprints each text once. The last document
of a range and the first of the next range that isn't empty meet by a join on the range's number.

Defined results: words are lower-cased and split at white space; a text of fewer than five words is one shingle, null and
empty texts and texts of white space are the shingle of no word, so they are alike and unlike all others. Rows of equal
doc_id follow each other by their place in the input's files, null ids come first; a single row is its own next. Texts of
any length are read whole; an empty table gives no rows; only ``doc_id`` and ``text`` are read, so other columns can't clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.llm.common import materialize, remove, with_address
from marlstone.llm.hashing import MIX, SEED, STEP, WordHashes, run_hashes

WIDTH = 5
BINS = 512
BITS = 4
_LATER = np.iinfo(np.uint64).max


def shingle_hashes(text: str | None, words: WordHashes | None = None) -> np.ndarray:
    """64-bit hashes of a text's shingles, in order; never empty."""
    w = (WordHashes() if words is None else words).of((text or "").lower().split())
    width = min(WIDTH, len(w))
    return run_hashes(w, width, width + 1)


def _orders(bins: int = BINS) -> np.ndarray:
    """Row b: the order in which an empty bin b looks at all bins."""
    rng = np.random.Generator(np.random.PCG64(SEED))
    return np.argsort(rng.random((bins, bins)), axis=1).astype(np.int32)


def least_of_bins(hashes: np.ndarray, bins: int = BINS) -> tuple[np.ndarray, np.ndarray]:
    """Each bin's least hash, and which bins have one."""
    at = (hashes >> np.uint64(64 - (bins - 1).bit_length())).astype(np.int64)
    out = np.full(bins, _LATER, dtype=np.uint64)
    np.minimum.at(out, at, hashes)
    filled = np.zeros(bins, dtype=bool)
    filled[at] = True
    return out, filled


def densify(values: np.ndarray, filled: np.ndarray, orders: np.ndarray) -> np.ndarray:
    """Rows of bins without empty ones. ``filled`` says which bins had a hash; each row has one at least."""
    out = values.copy()
    rows, bins = np.nonzero(~filled)
    for t in range(orders.shape[1]):
        if not len(rows):
            break
        other = orders[bins, t]
        good = filled[rows, other]
        out[rows[good], bins[good]] = values[rows[good], other[good]]
        rows, bins = rows[~good], bins[~good]
    return out


def pack_bits(values: np.ndarray, bits: int = BITS) -> list[bytes]:
    """The lowest ``bits`` bits of each value mixed with its bin's number, packed row by row."""
    with np.errstate(over="ignore"):
        mixed = (values ^ (np.arange(1, values.shape[1] + 1, dtype=np.uint64) * STEP)) * MIX
        mixed = (mixed ^ (mixed >> np.uint64(32))) * STEP
    mixed ^= mixed >> np.uint64(29)
    low = (mixed[:, :, None] >> np.arange(bits - 1, -1, -1, dtype=np.uint64)) & np.uint64(1)
    return [r.tobytes() for r in np.packbits(low.astype(np.uint8).reshape(len(values), -1), axis=1)]


def unpack_bits(packed: Iterable[bytes], bits: int = BITS) -> np.ndarray:
    rows = np.stack([np.frombuffer(p, np.uint8) for p in packed])
    each = np.unpackbits(rows, axis=1).reshape(len(rows), -1, bits)
    return (each * (1 << np.arange(bits - 1, -1, -1))).sum(2)


def likeness(a: list[bytes], b: list[bytes], bits: int = BITS) -> np.ndarray:
    """Estimated Jaccard similarity of the shingle sets behind fingerprints a[i] and b[i], corrected for chance."""
    if not a:
        return np.zeros(0)
    agree = (unpack_bits(a, bits) == unpack_bits(b, bits)).mean(1)
    chance = 1.0 / (1 << bits)
    return np.maximum(0.0, (agree - chance) / (1.0 - chance))


class Fingerprints:
    """Fingerprints of batches of texts; a task keeps one."""

    def __init__(self, bins: int = BINS, bits: int = BITS):
        self.bins, self.bits, self.orders, self.words = bins, bits, _orders(bins), WordHashes()

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        if not texts:
            return []
        found = [least_of_bins(shingle_hashes(t, self.words), self.bins) for t in texts]
        return pack_bits(densify(np.stack([v for v, _ in found]), np.stack([f for _, f in found]), self.orders), self.bits)


def with_fingerprints(docs: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """``docs`` with the fingerprint of a text column as lowercase hexadecimal; a column called ``out`` is replaced."""
    docs = docs.drop(out)

    def run(batches):
        make = Fingerprints()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                made = [p.hex() for p in make(part.column(text).to_pylist())]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(made, pa.string())], names=[*part.schema.names, out])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(out, T.StringType())]))


def edited(text: str, after: str) -> str:
    """``text`` with its last half replaced by as much of the beginning of ``after``, or all of it."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


DIGEST = [T.StructField("n_chars", T.LongType()), *[T.StructField(c, T.StringType()) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")], *[T.StructField(c, T.DoubleType()) for c in ("near_edited", "near_next")]]
#: What a task adds: its number, the whole text of its last document and of its first, and the first one's fingerprint.
EDGES = [T.StructField("range", T.IntegerType()), *[T.StructField(c, T.StringType()) for c in ("tail", "head", "head_fingerprint")]]


def _digest(texts: list[str], after: list[str], prints: list[bytes], prints_after: list[bytes], make: Fingerprints) -> list[pa.Array]:
    changed = [edited(t, a) for t, a in zip(texts, after)]
    made = make(changed)
    columns = [
        pa.array([len(t) for t in texts], pa.int64()),
        pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed], pa.string()),
        pa.array([p.hex() for p in prints], pa.string()),
        pa.array([p.hex() for p in made], pa.string()),
        pa.array(likeness(prints, made), pa.float64()),
        pa.array(likeness(prints, prints_after), pa.float64()),
    ]
    return columns


def _chain(batches):
    """Sorted rows in; each with its digest out, but the last, which has its text as ``tail``. The first also gives its text
    and fingerprint in a row of its own."""
    from pyspark import TaskContext

    number, make, held = TaskContext.get().partitionId(), Fingerprints(), None
    names = ["doc_id", *[f.name for f in DIGEST], *[f.name for f in EDGES]]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def row(doc_id, prints: str | None, tail, head, head_print):
        values = [pa.nulls(1, k) for k in kinds]
        if prints:
            values[2] = pa.array([prints])
        edges = [pa.array([number], pa.int32()), *[pa.array([v], pa.string()) for v in (tail, head, head_print)]]
        return pa.RecordBatch.from_arrays([doc_id, *values, *edges], names=names)

    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            texts = [t or "" for t in part.column("text").to_pylist()]
            prints, ids = make(texts), part.column("doc_id")
            if held is None:
                yield row(pa.nulls(1, ids.type), None, None, texts[0], prints[0].hex())
            else:
                texts, prints, ids = [held[0], *texts], [held[1], *prints], pa.concat_arrays([held[2], ids])
            held = (texts[-1], prints[-1], ids.slice(len(ids) - 1))
            n = len(texts) - 1
            edges = [pa.nulls(n, pa.int32()), *[pa.nulls(n, pa.string())] * 3]
            yield pa.RecordBatch.from_arrays([ids.slice(0, n), *_digest(texts[:-1], texts[1:], prints[:-1], prints[1:], make), *edges], names=names)
    if held is not None:
        yield row(held[2], held[1].hex(), held[0], None, None)


def _joined(batches):
    """Last documents of ranges with the first ones of the next."""
    make = Fingerprints()
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            part = batch.slice(at, 64)
            get = lambda c: part.column(c).to_pylist()  # noqa: E731, B023
            made = _digest(get("tail"), get("head"), [bytes.fromhex(x) for x in get("fingerprint")], [bytes.fromhex(x) for x in get("head_fingerprint")], make)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *made], names=["doc_id", *[f.name for f in DIGEST]])


def chain(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``doc_id`` and the columns of ``DIGEST``: each document's fingerprint and that of its text as edited with the next
    document, and how alike it is to both."""
    rows, paths = with_address(spark, docs.select("doc_id", "text"), "address_file", "address_row")
    order = ["doc_id", "address_file", "address_row"]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    kept = T.StructType([docs.schema["doc_id"], *DIGEST])
    written, path = materialize(spark, dealt.mapInArrow(_chain, T.StructType([*kept.fields, *EDGES])), "chain")
    remove(spark, *paths)
    # one row for each range that isn't empty; texts join by the range's number and take no part in the window
    numbers = written.filter("head is not null").select("range")
    after = numbers.selectExpr("range", "coalesce(lead(range) over (order by range), min(range) over ()) as range_after")
    heads = written.filter("head is not null").select(F.col("range").alias("range_after"), "head", "head_fingerprint")
    tails = written.filter("tail is not null").select("doc_id", "fingerprint", "tail", "range")
    met = tails.join(after, "range").join(heads, "range_after").select("doc_id", "fingerprint", "tail", "head", "head_fingerprint")
    return written.filter("range is null").select(*kept.fieldNames()).unionByName(met.mapInArrow(_joined, kept))


def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chain(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
