"""Operator 3: quality classifier by nearest-neighbour voting in a latent semantic space.

Whole texts become hashed counts (byte trigrams, trigrams of character classes, and binned shape statistics), weighted by
the inverse document frequencies of all documents. A bounded sample of labelled texts (``PER_LABEL`` of each label) gives
the latent space (a randomized singular value decomposition) and the labelled vectors, which are broadcast:
``2 * PER_LABEL * DIMS`` floats, whatever the input. Every document is compared with all of them in exact blocked cosine
products; the nearest (half the root of the number of labelled vectors, so 24 of a full sample) vote with their
similarity as weight.

Defined results: null and empty texts have no vector and get the vote's prior as score; a document with several labels
counts with the greatest; labels that name no document, or are neither 0 nor 1, are left out before the sample is drawn;
repeated rows are scored one by one; without labels the score is 0.5; a null doc_id counts as held out and is never
learned from; texts are read whole, of any length; an empty table gives no rows; a column ``score`` is replaced, others
but ``text`` pass through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.llm.common import add_up
from marlstone.llm.language_id import held_out

PER_LABEL = 1200
DIMS = 48
THRESHOLD = 0.3
GRAMS, CLASSES = 2048, 1024
STATS = 76
WIDTH = GRAMS + CLASSES + STATS
#: Share of each block in a document's length.
BLOCKS = ((0, GRAMS, 0.5), (GRAMS, GRAMS + CLASSES, 1.0), (GRAMS + CLASSES, WIDTH, 1.0))


def class_table() -> np.ndarray:
    """Byte to character class: letters by case, digits, bytes of non-ASCII letters as lower case; others as they are."""
    t = np.arange(256, dtype=np.int64)
    t[97:123] = t[128:256] = 97
    t[65:91] = 65
    t[48:58] = 48
    return t


_CLASS = class_table()


def counts_of(text: str | None) -> np.ndarray:
    """Hashed counts of one whole text, as log(1 + n); zeros for an empty one."""
    out = np.zeros(WIDTH, dtype=np.float32)
    if not text:
        return out
    raw = text.encode("utf-8", "ignore")
    b = np.frombuffer(raw, dtype=np.uint8).astype(np.int64)
    if len(b) >= 3:
        low = np.where((b >= 65) & (b <= 90), b + 32, b)
        out[:GRAMS] = np.bincount(((low[:-2] * 65599 + low[1:-1]) * 65599 + low[2:]) % 1000003 % GRAMS, minlength=GRAMS)
        c = _CLASS[b]
        out[GRAMS : GRAMS + CLASSES] = np.bincount(((c[:-2] * 65599 + c[1:-1]) * 65599 + c[2:]) % 1000003 % CLASSES, minlength=CLASSES)
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    n = max(1, len(words))
    pairs = len(set(zip(words, words[1:]))) / max(1, n - 1) if n > 1 else 1.0
    again = sum(map(bytes.__eq__, words, words[1:])) / max(1, n - 1)
    ratio = lambda x, k: min(k - 1, int(x * k))
    at = GRAMS + CLASSES
    for value, size in (
        (ratio(pairs, 12), 12),
        (ratio(again, 12), 12),
        (ratio(len(set(lines)) / max(1, len(lines)), 6), 6),
        (min(9, int(np.log2(n + 1))), 10),
        (min(11, sum(map(len, words)) // n), 12),
        (ratio(float(np.mean(_CLASS[b] == 65)), 8), 8),
        (ratio(float(np.mean((b > 32) & (b < 48) | (b > 57) & (b < 65) | (b > 90) & (b < 97) | (b > 122) & (b < 127))), 16), 16),
    ):
        out[at + value] = 1
        at += size
    return np.log1p(out)


def weigh(rows: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = rows * idf
    for lo, hi, share in BLOCKS:
        norm = np.linalg.norm(x[:, lo:hi], axis=1, keepdims=True)
        x[:, lo:hi] *= share / np.maximum(norm, 1e-9)
    return x


def fit(rows: np.ndarray, labels: np.ndarray, prior: float, frequencies: np.ndarray, documents: int, dims: int = DIMS, seed: int = 3) -> dict:
    """Latent space and labelled vectors of the sample; ``frequencies``: in how many of all documents a feature occurs."""
    idf = (np.log((1 + documents) / (1 + frequencies)) + 1).astype(np.float32)
    x = weigh(rows, idf)
    rng = np.random.default_rng(seed)
    k = min(dims, *x.shape)
    y = x @ rng.normal(size=(x.shape[1], min(k + 12, len(x)))).astype(np.float32)
    for _ in range(3):
        q, _ = np.linalg.qr(y)
        y = x @ (x.T @ q)
    q, _ = np.linalg.qr(y)
    _, _, vt = np.linalg.svd(q.T @ x, full_matrices=False)
    basis = np.ascontiguousarray(vt[:k].T).astype(np.float32)
    return {"idf": idf, "basis": basis, "vectors": unit(x @ basis), "labels": labels.astype(np.float32), "prior": prior}


def unit(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)


def neighbours(labelled: int) -> int:
    """How many vote: half the root of the number of labelled vectors, three at least where there are as many."""
    return min(max(3, round(labelled**0.5 / 2)), labelled)


def vote(model: dict, rows: np.ndarray) -> np.ndarray:
    """Similarity-weighted share of label 1 among the nearest labelled vectors; one vote's worth of 0.01 for the prior."""
    sims = unit(weigh(rows.copy(), model["idf"]) @ model["basis"]) @ model["vectors"].T
    k = neighbours(sims.shape[1])
    near = np.argpartition(-sims, k - 1, axis=1)[:, :k]
    w = np.maximum(np.take_along_axis(sims, near, 1), 0).astype(np.float64)
    y = model["labels"][near]
    return np.clip(((w * y).sum(1) + 0.01 * model["prior"]) / (w.sum(1) + 0.01), 0, 1)


def _vectors(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            rows = [counts_of(t).astype(np.float16).tobytes() for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("quality"), pa.array(rows, pa.binary())], names=["quality", "counts"])


def _frequencies(batches):
    """In how many of the task's documents each feature occurs; last, how many there are."""
    total = np.zeros(WIDTH + 1, dtype=np.int64)
    for batch in batches:
        for t in batch.column("text").to_pylist():
            total[:WIDTH] += counts_of(t) > 0
            total[WIDTH] += 1
    yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["v"])


def _score(model_b):
    def run(batches):
        model = model_b.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = part.column("text").to_pylist()
                score = vote(model, np.stack([counts_of(t) for t in texts])) if model else np.full(len(texts), 0.5)
                names = [c for c in part.schema.names if c != "text"]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in names], pa.array(score, pa.float64())], names=[*names, "score"])

    return run


def labelled_sample(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> tuple[DataFrame, float]:
    """At most ``per_label`` texts of each label that are not held out, by a hash of doc_id; and the share of label 1."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    known = known.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    known = known.withColumn("draw", F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(1_000_000_000)))
    sizes = {r["quality"]: r["n"] for r in known.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    picked = None
    for q in sorted(sizes):
        one = known.filter(F.col("quality") == q).orderBy("draw", "doc_id").limit(per_label)
        picked = one if picked is None else picked.unionByName(one)
    if picked is None:
        return None, 0.5
    joined = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")  # 2 * per_label ids at most
    # a doc_id may stand in several rows
    first = Window.partitionBy("quality").orderBy("draw", F.xxhash64("text"))
    sample = joined.withColumn("place", F.row_number().over(first)).filter(F.col("place") <= per_label)
    return sample.select("quality", "text"), sizes.get(1, 0) / sum(sizes.values())


def classify(spark: SparkSession, docs: DataFrame, labels: DataFrame, learn_from: DataFrame | None = None, per_label: int = PER_LABEL) -> DataFrame:
    """The columns of ``docs`` but ``text``, with ``score``."""
    source = docs if learn_from is None else learn_from
    sample, prior = labelled_sample(source, labels, per_label)
    model = None
    if sample is not None:
        schema = "quality int, counts binary"
        got = sample.withColumn("quality", F.col("quality").cast("int")).mapInArrow(_vectors, schema).collect()  # 2 * per_label rows at most
        if got:
            total = add_up(source.select("text").mapInArrow(_frequencies, "v binary"), WIDTH + 1)
            rows = np.stack([np.frombuffer(r["counts"], dtype=np.float16).astype(np.float32) for r in got])
            order = np.lexsort(rows.T[:: WIDTH // 64])  # the order of collected rows does not matter
            model = fit(rows[order], np.array([r["quality"] for r in got])[order], prior, total[:WIDTH], int(total[WIDTH]))
    shared = spark.sparkContext.broadcast(model)
    rest = [c for c in docs.columns if c not in ("text", "score")]
    out = T.StructType([docs.schema[c] for c in rest] + [T.StructField("score", T.DoubleType())])
    return docs.select(*rest, "text").mapInArrow(_score(shared), out)


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    out = classify(spark, docs, labels)
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
