"""Operator 2: token counts that follow edits.

Each document keeps a segment tree: its text is cut into leaves at places that are pre-token boundaries whatever surrounds
them (before a single space that a visible character follows), a leaf holds the number of tokens of its text, and an inner
node the sum of its subtree; the root is the document's count. An edit re-encodes the leaves it touches, and the leaf before
where the edit unmakes the boundary between them; then sums change along the path to the root. All other leaves keep
their counts. The tree lies in an array (node k has children 2k + 1 and 2k + 2), so a state is a plain table.

Defined results: null and empty texts have no leaves and count 0, an insertion makes the first one; edits that reach
beyond the text are cut to it; null insertions are empty; repeated rows keep trees of their own; an empty table stays
empty.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.llm.common import materialize
from marlstone.llm.tokens import default_tokenizer_paths, encoder

LEAF_CHARS = 512
_CUT = re.compile(r" (?=\S)")
STATE = [T.StructField("leaf_chars", T.ArrayType(T.IntegerType())), T.StructField("tree", T.ArrayType(T.LongType()))]
EDITS = "array<struct<at:int,drop:int,insert:string>>"


def split_leaves(text: str, size: int = LEAF_CHARS) -> list[str]:
    out, at = [], 0
    while at < len(text):
        m = _CUT.search(text, at + size) if at + size < len(text) else None
        end = m.start() if m else len(text)
        out.append(text[at:end])
        at = end
    return out


def build_tree(counts: list[int]) -> list[int]:
    """Sums over a complete binary tree whose last level holds the counts."""
    if not counts:
        return []
    width = 1 << (len(counts) - 1).bit_length()
    tree = [0] * (width - 1) + counts + [0] * (width - len(counts))
    for k in range(width - 2, -1, -1):
        tree[k] = tree[2 * k + 1] + tree[2 * k + 2]
    return tree


def leaf_counts(tree: list[int], n: int) -> list[int]:
    width = (len(tree) + 1) // 2
    return tree[width - 1 : width - 1 + n]


def set_leaf(tree: list[int], leaf: int, count: int) -> None:
    """One leaf's count changes: sums on the path to the root follow."""
    k = (len(tree) + 1) // 2 - 1 + leaf
    delta = count - tree[k]
    tree[k] = count
    while k and delta:
        k = (k - 1) // 2
        tree[k] += delta


def is_boundary(text: str, at: int) -> bool:
    return at <= 0 or at >= len(text) or (text[at] == " " and at + 1 < len(text) and not text[at + 1].isspace())


def apply_edit(text: str, leaf_chars: list[int], tree: list[int], at: int, drop: int, insert: str, count, size: int = LEAF_CHARS):
    """The text, leaves and tree after one edit, and the number of characters encoded anew."""
    at = max(0, min(at, len(text)))
    drop = max(0, min(drop, len(text) - at))
    fresh = text[:at] + insert + text[at + drop :]
    if not leaf_chars:
        first, last, lo, hi = 0, -1, 0, len(fresh)
    else:
        starts = [0, *accumulate(leaf_chars)]
        first = min(bisect_right(starts, at) - 1, len(leaf_chars) - 1)
        last = min(max(first, bisect_right(starts, at + drop) - 1), len(leaf_chars) - 1)
        while first and not is_boundary(fresh, starts[first]):
            first -= 1
        shift = len(insert) - drop
        while last + 1 < len(leaf_chars) and not is_boundary(fresh, starts[last + 1] + shift):
            last += 1
        lo, hi = starts[first], starts[last + 1] + shift
    leaves = split_leaves(fresh[lo:hi], size)
    counts = [count(x) for x in leaves]
    if len(leaves) == last - first + 1:
        for k, n in enumerate(counts):
            set_leaf(tree, first + k, n)
    else:
        old = leaf_counts(tree, len(leaf_chars))
        tree = build_tree(old[:first] + counts + old[last + 1 :])
    leaf_chars = leaf_chars[:first] + [len(x) for x in leaves] + leaf_chars[last + 1 :]
    return fresh, leaf_chars, tree, hi - lo


def _build(paths: tuple[str, str], size: int):
    def run(batches):
        enc = encoder(*paths)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                chars, trees = [], []
                for t in part.column("text").to_pylist():
                    leaves = split_leaves(t or "", size)
                    chars.append([len(x) for x in leaves])
                    trees.append(build_tree([enc.count(x) for x in leaves]))
                columns = [*part.columns, pa.array(chars, pa.list_(pa.int32())), pa.array(trees, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names=[*part.schema.names, "leaf_chars", "tree"])

    return run


def _edit(paths: tuple[str, str], size: int):
    def run(batches):
        enc = encoder(*paths)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                get = lambda c: part.column(c).to_pylist()  # noqa: E731, B023
                texts, chars, trees, anew = [], [], [], []
                for t, lengths, tree, edits in zip(get("text"), get("leaf_chars"), get("tree"), get("edits")):
                    done = 0
                    for e in edits or ():
                        t, lengths, tree, n = apply_edit(t or "", lengths, tree, e["at"], e["drop"], e["insert"] or "", enc.count, size)
                        done += n
                    texts.append(t)
                    chars.append(lengths)
                    trees.append(tree)
                    anew.append(done)
                made = {"text": pa.array(texts, pa.string()), "leaf_chars": pa.array(chars, pa.list_(pa.int32())), "tree": pa.array(trees, pa.list_(pa.int64()))}
                names = [c for c in part.schema.names if c not in ("edits", "chars_encoded")]
                columns = [made.get(c, part.column(c)) for c in names]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(anew, pa.int64())], names=[*names, "chars_encoded"])

    return run


def build_state(docs: DataFrame, size: int = LEAF_CHARS, tokenizer: tuple[str, str] | None = None) -> DataFrame:
    """``docs`` with ``leaf_chars`` and ``tree``."""
    docs = docs.drop("leaf_chars", "tree")
    return docs.mapInArrow(_build(tokenizer or default_tokenizer_paths(), size), T.StructType([*docs.schema.fields, *STATE]))


def apply_edits(state: DataFrame, size: int = LEAF_CHARS, tokenizer: tuple[str, str] | None = None) -> DataFrame:
    """``state`` has a column ``edits`` (array of at, drop, insert, in order); the state after them, with
    ``chars_encoded``."""
    fields = [f for f in state.schema.fields if f.name not in ("edits", "chars_encoded")]
    return state.mapInArrow(_edit(tokenizer or default_tokenizer_paths(), size), T.StructType([*fields, T.StructField("chars_encoded", T.LongType())]))


def apply_edit_log(spark: SparkSession, state: DataFrame, edits: DataFrame, per_round: int = 1000) -> DataFrame:
    """Edits as a table (doc_id, seq from 0, at, drop, insert). A document's edits are ordered, so each round takes at most
    ``per_round`` of them for a document and writes the state; edits of one document never meet in one row unbounded."""
    rounds = (edits.agg(F.max("seq").alias("m")).first()["m"] or 0) // per_round + 1
    for k in range(rounds):
        some = edits.filter((F.col("seq") >= k * per_round) & (F.col("seq") < (k + 1) * per_round))
        each = some.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("seq", "at", "drop", "insert"))).alias("e"))
        each = each.select("doc_id", F.expr(f"cast(transform(e, x -> struct(x.at, x.drop, x.insert)) as {EDITS})").alias("edits"))
        state, _ = materialize(spark, apply_edits(state.join(each, "doc_id", "left")), "state")
    return state


def tokens_of(tree: str = "tree") -> Column:
    return F.coalesce(F.get(F.col(tree), F.lit(0)), F.lit(0))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every document, and after two edits of it: 16 characters dropped at a third, a note inserted at two thirds."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    state = build_state(docs).withColumn("n_tokens", tokens_of())
    n = F.length(F.coalesce("text", F.lit("")))
    edit = lambda at, drop, insert: F.struct(at.cast("int").alias("at"), drop.cast("int").alias("drop"), insert.alias("insert"))
    edits = F.array(
        edit(F.floor(n / 3), F.lit(16), F.lit("")),
        edit(F.floor(2 * n / 3), F.lit(0), F.concat(F.lit(" (revised, see note "), F.coalesce(F.col("doc_id").cast("string"), F.lit("0")), F.lit(") "))),
    )
    after = apply_edits(state.withColumn("edits", edits))
    return after.select("doc_id", "n_tokens", tokens_of().alias("n_tokens_edited"), F.size("leaf_chars").alias("n_leaves"), "chars_encoded")
