"""Operator 9: language identification by a byte convolutional network.

The network embeds bytes, applies filters of several widths, takes the maximum over a fixed-length window and ends in a
softmax. It is trained in numpy on windows of a bounded number of labelled texts (``TEXTS_PER_LANG`` for each language,
``TEXTS`` in all), and on as many windows of noise, which make a class of their own. Prediction covers every window of
every whole text, in batches, and averages the windows' probabilities by their length: ``score`` is the best language's
share of what the languages have, ``fit`` what the noise class leaves to all languages. For prediction the embedding and
the filters are folded into one table for each filter position, so that a convolution is a sum of table rows.

Defined results: null texts and texts without a letter are ``und`` with score and fit 0; empty texts likewise; if there is
nothing to learn from, all are ``und``; of languages with equal scores the first by name is taken; repeated rows are
predicted one by one; a null doc_id counts as held out; texts are read whole, of any length; an empty table gives no rows;
columns ``lang_pred``, ``score`` and ``fit`` of the input are replaced, others pass through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
EMBED = 12
#: Labelled texts to learn from: for a language, and in all.
TEXTS_PER_LANG, TEXTS = 800, 25_600
WINDOWS_PER_TEXT = 2
UNDETERMINED = "und"


def held_out(doc_id: str = "doc_id") -> Column:
    return (F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5) == 0


def training_windows(docs: DataFrame, texts_per_lang: int = TEXTS_PER_LANG, texts: int = TEXTS) -> tuple[list[bytes], list[str]]:
    """Windows of labelled texts, ``WINDOWS_PER_TEXT`` of each, in an order that depends on doc_id only. Every label has its
    share: ``texts_per_lang`` texts at most, and fewer where the labels would come to more than ``texts`` together (one
    each at least). So the rows that reach the driver are bounded by these parameters and the number of labels."""
    labelled = docs.filter(F.col("lang").isNotNull() & F.col("text").rlike("\\p{L}") & ~held_out())
    sizes = [(r["lang"], r["n"]) for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()]
    if not sizes:
        return [], []
    each = max(1, min(texts_per_lang, texts // len(sizes)))
    # a share of each language such that about twice the texts needed and 40 more come through, then the first of them
    shares = docs.sparkSession.createDataFrame([(k, min(1_000_000, 1_000_000 * (2 * each + 40) // n)) for k, n in sizes], "lang string, share long")
    some = labelled.withColumn("draw", F.pmod(F.xxhash64(F.lit(9), "doc_id"), F.lit(1_000_000))).join(F.broadcast(shares), "lang").filter("draw < share")
    raw = F.encode("text", "UTF-8")
    last = F.greatest(F.octet_length("text") - WINDOW, F.lit(0)) + 1
    windows = [F.substring(raw, (F.pmod(F.xxhash64(F.lit(k), "doc_id"), last) + 1).cast("int"), F.lit(WINDOW)) for k in range(WINDOWS_PER_TEXT)]
    order = ["draw", "doc_id", *[f"w{k}" for k in range(WINDOWS_PER_TEXT)]]
    picked = some.select("doc_id", "lang", "draw", *[w.alias(f"w{k}") for k, w in enumerate(windows)]).withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
    rows = picked.filter(F.col("place") <= each).orderBy("lang", "place").collect()
    return [bytes(r[f"w{k}"]) for r in rows for k in range(WINDOWS_PER_TEXT)], [r["lang"] for r in rows for _ in range(WINDOWS_PER_TEXT)]


def noise_windows(texts: list[bytes], rng: np.random.Generator) -> list[bytes]:
    """Windows of no language: every second text with its bytes in another order, and as many of random printable bytes,
    random letters of other scripts, one short string again and again, or random numbers in hexadecimal."""
    out = []
    for k, t in enumerate(texts[::2]):
        out.append(rng.permutation(np.frombuffer(t, dtype=np.uint8)).tobytes())
        n = int(rng.integers(24, WINDOW + 1))
        if k % 4 == 0:
            out.append(rng.integers(33, 127, n).astype(np.uint8).tobytes())
        elif k % 4 == 1:
            first = int(rng.integers(0x370, 0x9F00))
            out.append("".join(map(chr, rng.integers(first, first + 64, n // 3))).encode()[:WINDOW])
        elif k % 4 == 2:
            out.append(b" ".join(b"%x" % v for v in rng.integers(0, 1 << int(rng.integers(4, 60)), n))[:n])
        else:
            unit = rng.integers(32, 127, int(rng.integers(1, 12))).astype(np.uint8).tobytes()
            out.append((unit * WINDOW)[:n])
    return out


def as_windows(texts: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(t.ljust(WINDOW, b"\0") for t in texts), dtype=np.uint8).reshape(len(texts), WINDOW)


def train(texts: list[bytes], langs: list[str], epochs: int = 4, batch: int = 64, rate: float = 0.003, seed: int = 9) -> dict:
    """Adam on cross-entropy. Returns the model: names, folded tables, bias of filters, output weights; noise is the class
    after the names. A quarter of the windows are cut short, since texts can be."""
    rng = np.random.default_rng(seed)
    names = sorted(set(langs))
    number = {v: k for k, v in enumerate(names)}
    noise = noise_windows(texts, rng)
    texts = [t[: int(rng.integers(4, WINDOW))] if rng.random() < 0.25 else t for t in [*texts, *noise]]
    x, y = as_windows(texts), np.array([number[v] for v in langs] + [len(names)] * len(noise))
    p = {"E": rng.normal(0, 0.5, (256, EMBED)), "U": rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(names) + 1)), "c": np.zeros(len(names) + 1)}
    for w in WIDTHS:
        p[f"W{w}"] = rng.normal(0, 1 / np.sqrt(w * EMBED), (w * EMBED, FILTERS))
        p[f"b{w}"] = np.zeros(FILTERS)
    p = {k: v.astype(np.float32) for k, v in p.items()}
    m, v2, t = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}, 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for lo in range(0, len(x), batch):
            rows = order[lo : lo + batch]
            xb, n = x[rows], len(rows)
            e = p["E"][xb]
            pooled, where, views = [], [], []
            for w in WIDTHS:
                view = np.concatenate([e[:, j : WINDOW - w + 1 + j] for j in range(w)], axis=2)
                out = view @ p[f"W{w}"] + p[f"b{w}"]
                at = out.argmax(axis=1)
                pooled.append(np.maximum(np.take_along_axis(out, at[:, None], 1)[:, 0], 0))
                where.append(at)
                views.append(view)
            h = np.concatenate(pooled, axis=1)
            z = h @ p["U"] + p["c"]
            z -= z.max(axis=1, keepdims=True)
            q = np.exp(z)
            q /= q.sum(axis=1, keepdims=True)
            q[np.arange(n), y[rows]] -= 1
            q /= n
            g = {"U": h.T @ q, "c": q.sum(0), "E": np.zeros_like(p["E"])}
            gh = q @ p["U"].T
            for k, w in enumerate(WIDTHS):
                part = gh[:, k * FILTERS : (k + 1) * FILTERS] * (pooled[k] > 0)
                picked = views[k][np.arange(n)[:, None], where[k]]  # only the maxima pass a gradient
                g[f"W{w}"] = np.einsum("nfd,nf->df", picked, part)
                g[f"b{w}"] = part.sum(0)
                back = np.einsum("nf,df->nfd", part, p[f"W{w}"]).reshape(n, FILTERS, w, EMBED)
                for j in range(w):
                    np.add.at(g["E"], xb[np.arange(n)[:, None], where[k] + j], back[:, :, j])
            t += 1
            for k in p:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v2[k] = 0.999 * v2[k] + 0.001 * g[k] ** 2
                p[k] -= (rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v2[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    tables = {w: [np.ascontiguousarray(p["E"] @ p[f"W{w}"][j * EMBED : (j + 1) * EMBED]) for j in range(w)] for w in WIDTHS}
    return {"names": names, "tables": tables, "bias": {w: p[f"b{w}"] for w in WIDTHS}, "U": p["U"], "c": p["c"]}


def probabilities(model: dict, x: np.ndarray, block: int = 64) -> np.ndarray:
    """Softmax of windows (rows of bytes), ``block`` windows at a time."""
    out = np.empty((len(x), len(model["c"])), dtype=np.float32)
    for lo in range(0, len(x), block):
        xb = x[lo : lo + block].T  # byte position first: the maximum runs over whole planes
        pooled = []
        for w in WIDTHS:
            length = WINDOW - w + 1
            conv = model["tables"][w][0][xb[:length]]
            for j in range(1, w):
                conv += model["tables"][w][j][xb[j : length + j]]
            pooled.append(np.maximum(conv.max(axis=0) + model["bias"][w], 0))
        z = np.concatenate(pooled, axis=1) @ model["U"] + model["c"]
        z -= z.max(axis=1, keepdims=True)
        e = np.exp(z)
        out[lo : lo + block] = e / e.sum(axis=1, keepdims=True)
    return out


def _predict(model_b):
    def run(batches):
        model = model_b.value
        names = model["names"]
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = part.column("text").to_pylist()
                pred, score, fit = [UNDETERMINED] * len(texts), [0.0] * len(texts), [0.0] * len(texts)
                rows, pieces, owner, weight = [], [], [], []
                for i, t in enumerate(texts):
                    if t and names and any(map(str.isalpha, t)):
                        b = t.encode("utf-8", "ignore")
                        k = -(-len(b) // WINDOW)
                        pieces.append(b.ljust(k * WINDOW, b"\0"))
                        owner += [len(rows)] * k
                        weight += [WINDOW] * (k - 1) + [len(b) - (k - 1) * WINDOW]
                        rows.append(i)
                if rows:
                    x = np.frombuffer(b"".join(pieces), dtype=np.uint8).reshape(-1, WINDOW)
                    q = probabilities(model, x) * np.array(weight, dtype=np.float32)[:, None]
                    starts = np.searchsorted(np.array(owner), np.arange(len(rows)))
                    total = np.add.reduceat(q.astype(np.float64), starts, axis=0)
                    total /= np.add.reduceat(np.array(weight, dtype=np.float64), starts)[:, None]
                    known = total[:, :-1]
                    left = np.maximum(known.sum(axis=1), 1e-12)
                    for i, k, s, f in zip(rows, known.argmax(axis=1).tolist(), (known.max(axis=1) / left).tolist(), left.tolist()):
                        pred[i], score[i], fit[i] = names[k], min(1.0, s), min(1.0, f)
                made = [pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(fit, pa.float64())]
                yield pa.RecordBatch.from_arrays([*part.columns, *made], names=[*part.schema.names, "lang_pred", "score", "fit"])

    return run


def identify(spark: SparkSession, docs: DataFrame, learn_from: DataFrame | None = None, texts_per_lang: int = TEXTS_PER_LANG) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` and ``fit``, the network trained on ``learn_from`` (by default ``docs``)."""
    source = docs if learn_from is None else learn_from
    texts, langs = training_windows(source.select("doc_id", "text", "lang"), texts_per_lang)
    model = train(texts, langs) if texts else {"names": []}
    shared = spark.sparkContext.broadcast(model)  # a few hundred KB, and 48 numbers more for each label
    docs = docs.drop("lang_pred", "score", "fit")
    made = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("fit", T.DoubleType())]
    return docs.mapInArrow(_predict(shared), T.StructType([*docs.schema.fields, *made]))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = identify(spark, docs.select("doc_id", "text"), docs.select("doc_id", "text", "lang"))
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "fit")
