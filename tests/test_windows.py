"""Context windows by strategy against the rules chunk by chunk, their summary and text, and odd chunks."""

import random

import pytest
from pyspark.sql import functions as F

from marlstone.operators import windows as W

SCHEMA = "q int, pos int, kind string, level int, relevance double, text string, strategy string, tokens int"
SENTENCE = "The order {k} of 1,200 pieces was shipped to the customer on day {k}"


def brute(chunks, budget, strategy):
    """pos to (place, tokens, form); chunks carry the tokens of their forms."""
    total = sum(c["tokens"] for c in chunks)
    if total <= budget and total / budget * 100 <= 80:
        return {c["pos"]: (i + 1, c["tokens"], "whole") for i, c in enumerate(chunks)}, False
    out = []

    def fill(items, used):
        for pos, n, form in items:
            if used + n <= budget:
                out.append((pos, n, form))
                used += n

    whole = lambda c: (c["pos"], c["tokens"], "whole")
    if strategy == "conservative":
        out += [whole(c) for c in chunks if c["level"] <= 2]
        fill([whole(c) for c in chunks if c["level"] == 3], sum(n for _, n, _ in out))
    elif strategy == "aggressive":
        dense = {c["pos"]: whole(c) if c["level"] == 1 else (c["pos"], c["dense_tokens"], "dense") for c in chunks}
        if sum(n for _, n, _ in dense.values()) <= budget:
            out += dense.values()
        else:
            fill([dense[c["pos"]] for c in sorted(chunks, key=lambda c: (c["level"], -c["relevance"]))], 0)
    else:
        light = {c["pos"]: (c["pos"], c["light_tokens"], "light") if c["level"] >= 3 and len(c["text"]) > 300 else whole(c) for c in chunks}
        hard = {c["pos"]: (c["pos"], c["hard_tokens"], "hard") if c["level"] == 3 and light[c["pos"]][2] == "whole" else light[c["pos"]] for c in chunks}
        if sum(n for _, n, _ in light.values()) <= budget:
            out += light.values()
        elif sum(n for _, n, _ in hard.values()) <= budget:
            out += hard.values()
        else:
            out += [hard[c["pos"]] for c in chunks if c["level"] <= 2]
            fill([hard[c["pos"]] for c in sorted((c for c in chunks if c["level"] == 3), key=lambda c: -c["relevance"])], sum(n for _, n, _ in out))
    applied = strategy == "aggressive" or (strategy == "balanced" and any(f != "whole" for _, _, f in out))
    return {pos: (i + 1, n, form) for i, (pos, n, form) in enumerate(out)}, applied


@pytest.fixture(scope="module")
def chunks(spark):
    rng, rows = random.Random(9), []
    for q in range(60):
        for pos in range(rng.randint(1, 8)):
            text = rng.choice(["", ". ".join(SENTENCE.format(k=k) for k in range(rng.randint(1, 9))), "\n".join(f"- item {k} | {k * 7}" for k in range(rng.randint(1, 12))), "plain words"])
            rows.append((q, pos, rng.choice(list(W.TITLES)), rng.randint(1, 4), rng.choice([0.1, 0.5, 0.9]), text, rng.choice(["preserve_exact", "summarize_semantic", "compress_structured", "extract_entities"]), rng.randint(0, 60) if rng.random() < 0.2 else int(len(text) * 0.7)))
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("strategy", ["conservative", "aggressive", "balanced"])
def test_windows_follow_the_rules(spark, chunks, strategy):
    forms = {}
    for r in W.with_forms(chunks).collect():
        forms.setdefault(r["q"], []).append(r.asDict())
    seen = set()
    for budget in (120, 400, 900, 4000):
        got = {}
        for r in W.optimised(chunks, ["q"], budget, F.lit(strategy)).collect():
            got.setdefault(r["q"], []).append(r)
        for q, rows in got.items():
            want, applied = brute(sorted(forms[q], key=lambda c: c["pos"]), budget, strategy)
            assert {r["pos"]: (r["place"], r["used_tokens"], r["form"]) for r in rows if r["place"] is not None} == want
            assert {r["compression_applied"] for r in rows} == {applied} and len(rows) == len(forms[q])
            seen |= {form for _, _, form in want.values()}
    assert seen == {"conservative": {"whole"}, "aggressive": {"whole", "dense"}, "balanced": {"whole", "light", "hard"}}[strategy]


def test_summary_adds_up(spark, chunks):
    windows = W.optimised(chunks, ["q"], 400, F.when(F.col("q") % 2 == 0, "aggressive").otherwise("balanced")).cache()
    rows = {}
    for r in windows.collect():
        rows.setdefault(r["q"], []).append(r)
    for s in W.summary(windows, ["q"], 400).collect():
        inside = [r for r in rows[s["q"]] if r["place"] is not None]
        assert s["final_tokens"] == sum(r["used_tokens"] for r in inside) and s["included"] == len(inside) and s["excluded"] == len(rows[s["q"]]) - len(inside)
        assert s["original_tokens"] == sum(r["tokens"] for r in rows[s["q"]])
        want = 0.0
        if inside:
            want = 0.4 * any(r["level"] == 1 for r in inside) + 0.3 * any(r["level"] == 2 for r in inside) + 0.2 * sum(r["relevance"] for r in inside) / len(inside)
        assert s["quality"] == pytest.approx(want)


def test_sections(spark):
    rows = [(1, 0, "query", 1, 1.0, "how many", "preserve_exact", 5), (1, 1, "document", 2, 0.9, "one", None, 3), (1, 2, "metadata", 4, 0.1, "meta", None, 90), (1, 3, "document", 3, 0.5, "two", None, 4), (2, 0, "metadata", 4, None, None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"document": F.when(F.col("pos") == 1, "abcdefghij"), "department": F.when(F.col("pos") == 1, "hr")})
    got = {r["q"]: r["context"] for r in W.formatted(W.optimised(df, ["q"], 100, F.lit("conservative")), ["q"], 100).collect()}
    assert got[1] == (
        "=== USER QUERY ===\nhow many\n\n=== RELEVANT DOCUMENTS ===\n--- Document 1 (ID: abcdefgh...) - Hr Department ---\none\n\n--- Document 2 ---\ntwo\n\n"
        "=== CONTEXT SUMMARY ===\nTotal Context Chunks: 3\nToken Utilization: 12.0%\nAdditional Documents Available: 1"
    )
    assert got[2] == "=== ADDITIONAL CONTEXT ===\n\n\n=== CONTEXT SUMMARY ===\nTotal Context Chunks: 1\nToken Utilization: 0.0%"
    assert W.optimised(df.limit(0), ["q"], 100, F.lit("balanced")).count() == 0


def test_structured_content(spark):
    cases = [("a | b | c", True), ("- item", True), ("text\n  * item", True), ('{ "k" : 1}', True), ("1. first", True), ("cost: $5", True), ("plain text, 5 words", False), ("", False)]
    df = spark.createDataFrame(cases, "t string, want boolean")
    assert df.filter(W.structured(F.col("t")) != F.col("want")).count() == 0
