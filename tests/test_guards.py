import random
import re

from pyspark.sql import functions as F

from marlstone.functions import questions as Q
from marlstone.operators.questions import parsed
from marlstone.plans.samples import needed, screened
from marlstone.session import table

PATTERNS = [p for p, _ in Q.REWRITES] + [p for ps in Q.INTENTS.values() for p in ps] + list(Q.AMOUNTS + Q.DATES + Q.REFERENCES + Q.RANGES + Q.TIMES) + [p for p, _ in Q.LIMITS] + [Q.DEPARTMENT]


def test_no_match_without_a_needed_literal():
    """Texts of the patterns' own words: where a pattern matches, one of its literals is there."""
    rng, hits = random.Random(5), 0
    words = sorted({w for p in PATTERNS for w in re.findall(r"[a-z]+", p)}) + ["12/03/2024", "2024-03-12", "$5", "7 bdt", ">", "<", "9", "2024", "q3", "po-7", "৳"]
    for _ in range(4000):
        text = " ".join(rng.choices(words, k=8))
        for p in PATTERNS:
            if re.search(f"(?i){p.replace('(?i)', '')}", text):
                hits += 1
                assert not needed(p) or any(t in text for t in needed(p)), (p, text)
    assert hits > 5000


def test_needed():
    assert needed(r"\bwhat.*(?:happened|status)") == ("happened", "status")
    assert needed(r"\b\d{4}\b") == () and needed("a?(?:b|c*)") == () and needed("x|") == ()
    assert all(needed(p) for p in PATTERNS if p != r"\b\d{4}\b")


SCREENED = Q.INTENT_PATTERNS + Q.ENTITY_PATTERNS + Q.CONSTRAINT_PATTERNS + Q.TIMES


def test_screens_hold_wherever_patterns_do(spark):
    """Texts of the patterns' own words and of letters beyond ASCII: the bit of each pattern that matches is set."""
    rng = random.Random(6)
    words = sorted({w for p in SCREENED for w in re.findall(r"[a-z]+", p)}) + ["12/03/2024", "2024-03-12", "$5", "7 bdt", ">", "<", "9", "2024", "q3", "po-7", "৳ 8", "no: -", "é", "noé", "éid", "-", "\x0b"]
    words += ["between 1/2/2024 and 3/4/2024", "from 1/2/24 to 3/4/24", "greater than 4", "less than 7", "above 5", "below 6,000", "> 9", "<8", "in hr dept", "for admin "] * 3
    texts = [rng.choice(["", " ", "é"]).join(rng.choices(words, k=6)) if k % 3 else " ".join(rng.choices(words, k=9)) for k in range(1500)]
    groups = (Q.INTENT_PATTERNS, Q.ENTITY_PATTERNS, Q.CONSTRAINT_PATTERNS, Q.TIMES)
    df = spark.createDataFrame([(t,) for t in texts] + [(None,), ("",)], "t string")
    hit = lambda p: F.col("t").rlike("(?i)" + p.replace("(?i)", ""))
    rows = df.select("t", *[F.array(*[hit(p) for p in ps]).alias(f"hit{k}") for k, ps in enumerate(groups)], *[screened(F.col("t"), ps).alias(f"bits{k}") for k, ps in enumerate(groups)]).collect()
    found = [[0, 0] for _ in groups]
    for r in rows:
        for k in range(len(groups)):
            bits, hits = r[f"bits{k}"], r[f"hit{k}"]
            assert (bits is None) == (r["t"] is None)
            if bits is not None:
                assert not [p for j, p in enumerate(groups[k]) if hits[j] and not bits >> j & 1], r["t"]
                found[k] = [found[k][0] + sum(hits), found[k][1] + bits.bit_count()]
    assert all(h > 100 and b < 1.5 * h + 100 for h, b in found), found


def test_patterns_run_in_plain_columns(spark, sf_dir):
    """No pattern is evaluated below a function of a lambda, which Spark interprets row by row; the pairs of date ranges are."""
    plan = parsed(table(spark, sf_dir, "documents").select(F.col("text").alias("question")))._jdf.queryExecution().optimizedPlan()
    stack, below = [(plan, None)], []

    def walk(e, lambdas):
        name = e.getClass().getSimpleName()
        if lambdas and name in ("RLike", "RegExpReplace", "RegExpExtractAll"):
            below.append(name)
        children = e.children()
        for k in range(children.size()):
            walk(children.apply(k), lambdas or name in ("ArrayTransform", "ArrayFilter", "ArraySort", "ArrayExists", "ArrayAggregate"))

    while stack:
        node, _ = stack.pop()
        expressions, children = node.expressions(), node.children()
        for k in range(expressions.size()):
            walk(expressions.apply(k), False)
        stack += [(children.apply(k), None) for k in range(children.size())]
    assert not below, below


def test_null_questions(spark):
    r = parsed(spark.createDataFrame([(None,), ("",)], "question string")).collect()
    assert r[0]["cleaned"] is None and r[0]["intent"] == "unknown" and r[0]["entities"] is None and r[0]["suggested"] == []
    assert r[1]["entities"] == [] and r[1]["constraints"] == [] and r[1]["times"] == [] and r[1]["expansion"] == []
