"""Operators 11 to 13 against brute force, and their edge cases."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    (None, "a null id", "en", None, 9),
    (1, None, None, None, None),
    (2, "", "en", "s", 0),
    (3, " \n\t ", None, "s", 4),
    (4, "same same", "en", "s", 9),
    (4, "same same", "en", "s", 9),
    (5, "12345 !!! 67", "en", "s", 12),
    (6, "word " * 30000, "en", "s", 150000),
    (7, "x" * 3000, "fr", "s", 3000),
    (8, "<|endoftext|> and 日本 text   é", "fr", "s", 10),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def shingle_set(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def jaccard(a, b):
    return len(a & b) / len(a | b)


def test_op11_query(spark, sf_dir):
    from marlstone.llm.minhash import op11_fingerprints

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()
    got = {r["doc_id"]: r for r in op11_fingerprints(spark, sf_dir).collect()}
    assert len(got) == len(docs)
    off_edit, off_next = [], []
    for r, after in zip(docs, docs[1:] + docs[:1]):
        text, other = r["text"] or "", after["text"] or ""
        half = len(text) // 2
        edit = text[: len(text) - half] + other[:half]
        g = got[r["doc_id"]]
        assert g["n_chars"] == len(text) and g["edited_sha256"] == hashlib.sha256(edit.encode()).hexdigest()
        off_edit.append(g["near_edited"] - jaccard(shingle_set(text), shingle_set(edit)))
        off_next.append(g["near_next"] - jaccard(shingle_set(text), shingle_set(other)))
        assert 0 <= g["near_edited"] <= 1 and 0 <= g["near_next"] <= 1
    assert abs(np.mean(off_edit)) < 0.01 and np.std(off_edit) < 0.04 and np.max(np.abs(off_edit)) < 0.2 and np.max(np.abs(off_next)) < 0.2
    by_text = defaultdict(set)
    for r in docs:
        by_text[r["text"] or ""].add(got[r["doc_id"]]["fingerprint"])
    assert all(len(x) == 1 for x in by_text.values())


def test_op11_likeness_is_unbiased():
    from marlstone.llm.minhash import Fingerprints, likeness

    rng, make = random.Random(3), Fingerprints()
    for n, shared in ((3, 1), (40, 20), (400, 300), (5000, 500)):
        off = []
        for k in range(40):
            words = [f"w{k}x{i}y{rng.random()}" for i in range(2 * n)]
            # runs that share no word give sets of known overlap
            pieces = [" ".join(f"{w}{c}" for c in "abcde") for w in words]
            a, b = pieces[:n], pieces[n - shared : 2 * n - shared]
            x, y = (make([" ".join(p)])[0] for p in (a, b))
            off.append(likeness([x], [y])[0] - jaccard(shingle_set(" ".join(a)), shingle_set(" ".join(b))))
        assert abs(np.mean(off)) < 0.05


def test_op11_brute_densification():
    from marlstone.llm.minhash import _orders, densify, least_of_bins

    rng = np.random.Generator(np.random.PCG64(1))
    orders = _orders(64)
    for n in (1, 2, 30, 500):
        hashes = rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2)
        values, filled = least_of_bins(hashes, 64)
        bins = defaultdict(list)
        for h in hashes.tolist():
            bins[h >> 58].append(h)
        want = [min(bins[b]) if b in bins else min(bins[next(o for o in orders[b].tolist() if o in bins)]) for b in range(64)]
        assert densify(values[None], filled[None], orders)[0].tolist() == want


def test_op11_edges(spark, odd, empty, tmp_path):
    from marlstone.llm.minhash import chain, edited, with_fingerprints

    assert chain(spark, empty).count() == 0
    one = chain(spark, spark.createDataFrame(ODD[4:5], SCHEMA)).collect()
    assert [(r["n_chars"], r["near_edited"], r["near_next"]) for r in one] == [(9, 1.0, 1.0)]  # its own beginning again
    clash = odd.withColumn("range", F.lit("x")).withColumn("fingerprint", F.lit(1)).withColumn("tail", F.lit(2)).withColumn("address_row", F.lit(3))
    clash.repartition(5).write.parquet(f"file://{tmp_path}/odd")
    stored = spark.read.parquet(f"file://{tmp_path}/odd")
    order = ["doc_id", F.xxhash64("_metadata.file_path"), "_metadata.row_index"]
    rows = stored.orderBy(*order).collect()  # null ids first
    want = Counter()
    for r, after in zip(rows, rows[1:] + rows[:1]):
        text, other = r["text"] or "", after["text"] or ""
        want[r["doc_id"], len(text), hashlib.sha256(edited(text, other).encode()).hexdigest()] += 1
    got = chain(spark, stored).collect()
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got) == want
    prints = {r["text"]: r["fingerprint"] for r in with_fingerprints(clash).collect()}
    assert len(prints[None]) == 512 and prints[None] == prints[""] == prints[" \n\t "] != prints["same same"]


def test_radix_trie(monkeypatch):
    from marlstone.llm import radix_trie

    monkeypatch.setattr(radix_trie, "BURST", 3)
    rng = random.Random(4)
    for _ in range(100):
        parts, want, docs = [], defaultdict(Counter), Counter()
        for _ in range(rng.randint(1, 3)):
            trie = radix_trie.RadixTrie()
            for _ in range(rng.randint(0, 200)):
                key = bytes(rng.choice(b"ab\xc3\xa9") for _ in range(rng.randint(0, 7)))
                trie.add(key, [rng.choice("xyz")] * 1, [2], 1)
                docs[key] += 1
            parts.append(trie)
            for key, leaf in trie.walk():
                want[key].update(leaf.counts)
        for other in parts[1:]:
            parts[0].merge(other)
        got = list(parts[0].walk())
        assert [k for k, _ in got] == sorted(want) and parts[0].keys == len(want)
        assert all(leaf.counts == want[k] and leaf.docs == docs[k] for k, leaf in got)
        assert parts[0].counters == sum(len(leaf.counts) for _, leaf in got)


def brute_divergence(rows, least_docs):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    docs, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        found = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", (text or "").translate(lower))
        groups[lang or ""].add(source or "")
        docs[lang or ""].update(set(found))
        counts[lang or "", source or ""].update(found)
    out = []
    for lang, sources in groups.items():
        kept = sorted(t for t, n in docs[lang].items() if n >= least_docs)
        whole = Counter()
        for s in sources:
            whole.update(counts[lang, s])

        def shares(c, kept=kept):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 2) // (total + 2 * len(kept)) for t in kept}

        q, p = shares(whole), {s: shares(counts[lang, s]) for s in sources}
        apart = lambda a, b: (a - b) * (a - b) // (a + b)
        for s in sources:
            pairs = [(o, sum(apart(p[s][t], p[o][t]) for t in kept)) for o in sources - {s}]
            terms = [(t, apart(p[s][t], q[t])) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, 10)):
                order = sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, item, value, k + 1) for k, (item, value) in enumerate(order)]
    return sorted(out)


@pytest.mark.parametrize("counters", [400_000, 20])
def test_op12(spark, empty, odd, counters):
    from marlstone.llm import divergence

    rng = random.Random(6)
    words = ["a", "B", "é", "É", "zz", "日本", "x_y", "c1d", "ß"]
    rows = [(" ".join(rng.choice(words) + rng.choice(["", "!", "a"]) for _ in range(rng.randint(0, 12))), rng.choice(["en", None, "fr"]), rng.choice(["s", "t", None, "u"])) for _ in range(120)]
    rows += [("once only", "xx", "s"), (None, "xx", "t"), ("", "yy", "s")]
    df = spark.createDataFrame(rows, "text string, lang string, source string").withColumn("item", F.lit(1)).withColumn("block", F.lit(2)).repartition(3)
    got = sorted(tuple(r) for r in divergence.audit(spark, df, 3, counters).collect())
    assert got == brute_divergence(rows, 3)
    assert divergence.audit(spark, empty).count() == 0
    if counters == 20:
        assert sorted(tuple(r) for r in divergence.audit(spark, odd, 1).collect()) == brute_divergence([r[1:4] for r in ODD], 1)


def test_op12_counts_do_not_overflow():
    from marlstone.llm.divergence import shares

    for c, total, v in ((0, 10**15, 10**6), (10**15, 9 * 10**15, 10**9), (5, 5, 1), (0, 0, 1)):
        assert shares(np.array([c]), np.array([total]), v)[0] == 1 + 10**9 * (c + 2) // (total + 2 * v)


def brute_collocations(rows, least, top):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(lower)):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, 5):
                f[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in found.items():
            longer = [q for q in found if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))]
            if any(100 * found[q] >= 80 * a for q in longer):
                continue
            cuts = [(2000000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            kept.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, p, l, r) in enumerate(sorted(kept)[:top]):
            out.append((lang, rank + 1, p.decode(), -a, l, r, n[lang], -score))
    return sorted(out)


@pytest.mark.parametrize("filled", [False, True])
def test_op13(spark, empty, odd, filled, monkeypatch):
    from marlstone.llm import collocations

    rng = random.Random(8)
    words = ["a", "B", "é", "new york", "New York City", "\x1c", "c-d", "日本"]
    texts = ["".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ". ", "\n", "!"]) for _ in range(rng.randint(0, 60))) for _ in range(60)]
    rows = [(t, rng.choice(["en", None, "und"])) for t in texts] + [(None, "en"), ("", "fr")]
    df = spark.createDataFrame(rows, "text string, lang string").withColumn("phrase", F.lit(1)).withColumn("n", F.lit(2)).repartition(3)
    if filled:  # a filter that lets everything through changes nothing
        monkeypatch.setattr(collocations, "frequent_filter", lambda level, width: np.full(collocations.BITS >> 3, 255, np.uint8))
    got = sorted(tuple(r) for r in collocations.collocations(spark, df, top=25, least=4, counted=50).collect())
    want = brute_collocations(rows, 4, 25)
    assert got == want and len(want) > 40
    if not filled:
        assert collocations.collocations(spark, empty).count() == 0
        assert sorted(tuple(r) for r in collocations.collocations(spark, odd, least=2).collect()) == brute_collocations([r[1:3] for r in ODD], 2, 2000)


@pytest.mark.parametrize("name", ["op12_source_divergence", "op13_collocations"])
def test_queries_match_sql(spark, sf_dir, name):
    import duckdb

    from marlstone.llm.queries import ORACLE_SQL, QUERIES

    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    df, want = QUERIES[name](spark, sf_dir), con.sql(ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert sorted(tuple(r[c] for c in want.columns) for r in df.collect()) == sorted(want.fetchall())


@pytest.mark.parametrize("size", [1, 5000, 9000])
def test_vectors_add_up(spark, size, monkeypatch):
    from marlstone.llm import common

    rng = np.random.Generator(np.random.PCG64(2))
    vectors = [rng.integers(-(1 << 40), 1 << 40, size) for _ in range(7)]
    rows = spark.createDataFrame([(bytearray(v.tobytes()),) for v in vectors], "counts binary").repartition(5)
    monkeypatch.setattr(common, "FAN", 2)
    assert (common.add_up(rows, size) == sum(vectors)).all()
    assert (common.add_up(rows.limit(0), size) == 0).all()
