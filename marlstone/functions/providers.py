"""UDF surface: embedding providers by name, in the order in which they are tried.

A provider turns a text column into a vector column: by an expression, or by a function of a list of texts that runs in an Arrow
UDF on batches of bounded size. A batch that fails gets zero vectors, so rows keep their places, and ``embedded`` is false for
them; with a second provider those rows get its vectors instead. Null texts are empty.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.operators.corpus import hash_vector
from marlstone.session import table

Embed = Callable[[list[str]], Iterable[Iterable[float]]]
#: Numbers of the linear vector repeat after so many.
LINEAR_CYCLE = 2_000_000
LINEAR_DIMS = 1536


@dataclass(frozen=True)
class Provider:
    """``expression`` maps a text column to a vector, or ``function`` a list of texts to vectors, ``batch`` at a time."""

    name: str
    dims: int
    expression: Callable[[Column], Column] | None = None
    function: Embed | None = None
    batch: int = 100


class Providers:
    """Providers by name. The first of ``order`` that is registered is chosen."""

    def __init__(self, order: Iterable[str] = ()):
        self.order, self.by_name = list(order), {}

    def register(self, provider: Provider) -> Provider:
        if (provider.expression is None) == (provider.function is None):
            raise ValueError(f"{provider.name}: one of expression and function")
        if provider.batch < 1 or provider.dims < 1:
            raise ValueError(f"{provider.name}: batch and dims must be positive")
        self.by_name[provider.name] = provider
        if provider.name not in self.order:
            self.order.append(provider.name)
        return provider

    def choose(self, name: str | None = None) -> Provider:
        if name is not None:
            return self.by_name[name]
        found = next((n for n in self.order if n in self.by_name), None)
        if found is None:
            raise LookupError("no embedding provider is registered")
        return self.by_name[found]


def _in_batches(texts: pa.Array, provider: Provider) -> Iterator[tuple[np.ndarray, bool]]:
    for at in range(0, len(texts), provider.batch):
        some = [t or "" for t in texts.slice(at, provider.batch).to_pylist()]
        try:
            made = np.asarray([list(v) for v in provider.function(some)], dtype=np.float64)
            if made.shape != (len(some), provider.dims):
                raise ValueError(f"{provider.name}: {made.shape} is not {(len(some), provider.dims)}")
            yield made, True
        except Exception:  # whatever a provider raises fails its batch only
            yield np.zeros((len(some), provider.dims)), False


def _udf(provider: Provider) -> Callable[[Column], Column]:
    @F.arrow_udf("struct<vector:array<double>,embedded:boolean>")
    def embed(texts: pa.Array) -> pa.Array:
        found = list(_in_batches(texts, provider))
        flat = np.concatenate([v.ravel() for v, _ in found]) if found else np.zeros(0)
        good = np.repeat([ok for _, ok in found], [len(v) for v, _ in found]) if found else np.zeros(0, dtype=bool)
        vectors = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * provider.dims, pa.int32()), pa.array(flat, pa.float64()))
        return pa.StructArray.from_arrays([vectors, pa.array(good, pa.bool_())], names=["vector", "embedded"])

    return embed


def embed(rows: DataFrame, provider: Provider, text: str = "text", instead: Provider | None = None) -> DataFrame:
    """``rows`` with ``vector``, ``embedded`` and ``provider``. SRC-29: a failed batch has zero vectors; with ``instead``, an
    expression of as many numbers, its rows have that provider's vectors and name."""
    whole = F.coalesce(F.col(text), F.lit(""))
    if instead is not None and (instead.expression is None or instead.dims != provider.dims):
        raise ValueError("a fallback is an expression of the same dimension")
    if provider.expression is not None:
        return rows.withColumns({"vector": provider.expression(whole), "embedded": F.lit(True), "provider": F.lit(provider.name)})
    made = rows.withColumn("_made", _udf(provider)(F.col(text)))
    if instead is None:
        out = made.withColumns({"vector": F.col("_made.vector"), "embedded": F.col("_made.embedded"), "provider": F.lit(provider.name)})
    else:
        good = F.col("_made.embedded")
        vector = F.when(good, F.col("_made.vector")).otherwise(instead.expression(whole))
        out = made.withColumns({"vector": vector, "embedded": F.lit(True), "provider": F.when(good, provider.name).otherwise(instead.name)})
    return out.drop("_made")


def _digest_mod(text: Column, cycle: int) -> Column:
    """The 128-bit digest of a text modulo ``cycle``, 32 bits at a time."""
    rest = F.lit(0).cast("long")
    for k in range(4):
        piece = F.conv(F.substring(F.md5(text), 8 * k + 1, 8), 16, 10).cast("long")
        rest = F.pmod(rest * (1 << 32) + piece, F.lit(cycle))
    return rest


def linear_vector(text: Column, dims: int = LINEAR_DIMS) -> Column:
    """SC-07: consecutive numbers from the text's digest on, from -1 to 1."""
    return F.get(F.transform(F.array(_digest_mod(text, LINEAR_CYCLE)), lambda seed: F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: (seed + i) % LINEAR_CYCLE / 1000000.0 - 1)), F.lit(0))


def letter_shares(texts: list[str]) -> np.ndarray:
    """How often each letter from a to z occurs, by the number of characters."""
    out = np.zeros((len(texts), 26))
    for k, t in enumerate(texts):
        codes = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = (codes | 0x20) - 0x61
        out[k] = np.bincount(letter[letter < 26], minlength=26)[:26] / max(1, len(codes))
    return out


HASHED = Provider("hash", 384, expression=hash_vector)
LINEAR = Provider("linear", LINEAR_DIMS, expression=linear_vector)
LETTERS = Provider("letters", 26, function=letter_shares)


def default_providers() -> Providers:
    """Remote providers come first once they are registered; the deterministic ones need nothing."""
    out = Providers(order=("remote", "second_remote"))
    for p in (HASHED, LINEAR, LETTERS):
        out.register(p)
    return out


def _turns(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "conversations").select("conv_id", "turn", "text")


def _hashed(s: SparkSession, d: str) -> DataFrame:
    v = embed(_turns(s, d), default_providers().choose())
    each = [F.round(F.get("vector", F.lit(k)), 6).alias(f"v{k}") for k in (0, 191, 383)]
    return v.select("conv_id", "turn", "provider", F.size("vector").alias("dim"), *each)


def _linear(s: SparkSession, d: str) -> DataFrame:
    v = embed(table(s, d, "documents").select("doc_id", "text"), LINEAR)
    total = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x)
    return v.select("doc_id", F.size("vector").alias("dim"), F.round(F.get("vector", F.lit(0)), 6).alias("first"), F.round(F.get("vector", F.lit(1535)), 6).alias("last"), F.round(total, 3).alias("total"))


def _letters(s: SparkSession, d: str) -> DataFrame:
    v = embed(table(s, d, "documents").select("doc_id", "text"), LETTERS)
    return v.select("doc_id", "embedded", *[F.round(F.get("vector", F.lit(ord(c) - 97)), 6).alias(c) for c in "aeqz"])


QUERIES = {"sc06_text_vectors": _hashed, "sc07_linear_vectors": _linear, "emb_letter_provider": _letters}
_TEXT = "coalesce(text, '')"
_RAW = f"list_transform(range(384), lambda i: CAST('0x' || substr(md5({_TEXT} || '_' || i), 1, 8) AS BIGINT)::DOUBLE / 4294967295 * 2 - 1)"
_PIECE = "CAST('0x' || substr(h, {at}, 8) AS BIGINT)"
_SEED = "0"
for _at in (1, 9, 17, 25):
    _SEED = f"(({_SEED}) * 4294967296 + {_PIECE.format(at=_at)}) % {LINEAR_CYCLE}"
_SHARE = "round((length({t}) - length(replace(replace({t}, '{c}', ''), upper('{c}'), '')))::DOUBLE / greatest(1, length({t})), 6) AS {c}"
ORACLE_SQL = {
    "sc06_text_vectors": f"WITH t AS (SELECT conv_id, turn, {_RAW} AS v FROM conversations), u AS (SELECT *, sqrt(list_inner_product(v, v)) AS s FROM t) SELECT conv_id, turn, 'hash' AS provider, CAST(len(v) AS INT) AS dim, round(v[1] / s, 6) AS v0, round(v[192] / s, 6) AS v191, round(v[384] / s, 6) AS v383 FROM u",
    "sc07_linear_vectors": f"WITH t AS (SELECT doc_id, md5({_TEXT}) AS h FROM documents), u AS (SELECT doc_id, {_SEED} AS seed FROM t), v AS (SELECT doc_id, list_transform(range({LINEAR_DIMS}), lambda i: (seed + i) % {LINEAR_CYCLE} / 1000000.0::DOUBLE - 1) AS v FROM u) SELECT doc_id, CAST(len(v) AS INT) AS dim, round(v[1], 6) AS first, round(v[1536], 6) AS last, round(list_sum(v), 3) AS total FROM v",
    "emb_letter_provider": "SELECT doc_id, true AS embedded, " + ", ".join(_SHARE.format(t=_TEXT, c=c) for c in "aeqz") + " FROM documents",
}
