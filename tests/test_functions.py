import json
import random
import re

import pytest
from pyspark.sql import functions as F

from marlstone.functions import text as T
from marlstone.functions import understanding as U
from marlstone.operators.context import budget_fold, priority_pack
from marlstone.operators.rerank import diverse
from marlstone.sources import files


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'array<string>' if isinstance(v, list) else 'double' if isinstance(v, float) else 'long'}" for k, v in values.items()))
    return row.select(column.alias("x")).first()["x"]


def test_chunk_text_properties(spark):
    """Order and content are kept, no paragraph is cut, and no chunk could have taken the next paragraph."""
    rng = random.Random(3)
    texts = ["\n \n".join("".join(rng.choice("ab c") for _ in range(rng.randint(0, 40))) for _ in range(rng.randint(0, 12))) for _ in range(40)]
    for text, most in [(t, rng.choice([5, 20, 60])) for t in texts]:
        got = one(spark, T.chunk_text(F.col("t"), most), t=text)
        parts = [p.strip() for p in re.split(r"\n\s*\n", text) if p.strip()]
        assert [p for c in got for p in c.split("\n\n")] == (parts or [text.strip()])
        for a, b in zip(got, got[1:]):
            assert len(a) + 2 + len(b.split("\n\n")[0]) > most
            assert len(a) <= most or "\n\n" not in a


def test_numbers_and_times(spark):
    for text, numeric, value in (("42", True, 42), ("3.14", True, 3.14), ("1,234,567", True, 1234567), ("-99.5", True, -99.5), ("", False, 0), ("ticket 9-A", False, 0), ("n/a", False, 0)):
        assert one(spark, T.numeric_text(F.col("t")), t=text) is numeric
        assert one(spark, T.parse_number(F.col("t")), t=text) == value
    for seconds, said in ((30, "just now"), (60, "1 minute ago"), (300, "5 minutes ago"), (7200, "2 hours ago"), (259200, "3 days ago"), (61 * 86400, "2 months ago"), (-5, "just now")):
        assert one(spark, T.relative_time(F.col("s")), s=seconds) == said


def test_token_estimates(spark):
    for text, n in (("plain words only here", 14), ("| a | b |", 4), ("Total $500 due", 9), ("Jane Smith paid", 11)):
        assert one(spark, T.structured_token_estimate(F.col("t")), t=text) == n


def test_budget_fold_properties(spark):
    """The kept texts are among the given, in order, within the budget; what was left out would not have fitted then; only a
    first text that is too large is cut."""
    rng = random.Random(4)
    cases = [(["q" * rng.choice([3, 40, 90, 700]) for _ in range(rng.randint(1, 8))], rng.choice([10, 60, 300])) for _ in range(30)]
    cost = lambda t: max(1, len(t) // 4)
    for texts, budget in cases:
        got = one(spark, budget_fold(F.col("t"), budget), t=texts)
        if cost(texts[0]) > budget:
            assert got["texts"] == [texts[0][: max(200, 4 * budget)]] and got["truncated"]
            continue
        left, room = list(got["texts"]), budget
        for t in texts:
            if left and t == left[0] and cost(t) <= room:
                left.pop(0)
                room -= cost(t)
            else:
                assert cost(t) > room and got["truncated"]
        assert not left and room >= 0


def test_priority_pack(spark):
    rows = spark.sql("select array(named_struct('priority', 1, 'pos', 1, 'tokens', 60), named_struct('priority', 0, 'pos', 0, 'tokens', 50), named_struct('priority', 1, 'pos', 2, 'tokens', 40)) as c")
    got = rows.select(priority_pack(F.col("c"), 100).alias("k")).first()["k"]
    assert [(x["pos"], x["tokens"], x["compressed"]) for x in got] == [(0, 50, False), (1, 42, True)]


def test_diverse_selection(spark):
    random.seed(4)
    for k in (1, 2, 5, 8):
        items = [(1, i, random.choice("abc")) for i in range(20)]
        want, seen = [], set()
        for _, i, key in items:
            if len(want) < k // 2 or key not in seen:
                want.append(i)
            seen.add(key)
            if len(want) == k:
                break
        got = diverse(spark.createDataFrame(items, "q long, i long, key string"), "q", [F.col("i")], ["key"], k)
        assert sorted(r["i"] for r in got.collect()) == sorted(want)


@pytest.mark.parametrize("text,amount,code", [("31,400 EUR", 31400, "EUR"), ("GBP 7,250", 7250, "GBP"), ("$12.5", 12.5, "USD")])
def test_currency(spark, text, amount, code):
    got = one(spark, U.normalise_currency(F.col("t")), t=text)
    assert (got["amount"], got["currency"]) == (amount, code)


def test_dates(spark):
    assert str(one(spark, U.normalise_date(F.col("t")), t="05/04/2024")) == "2024-04-05"
    assert str(one(spark, U.normalise_date(F.col("t")), t="April 10, 2024")) == "2024-04-10"
    assert one(spark, U.normalise_date(F.col("t")), t="soon") is None


def test_questions_by_hand(spark):
    """Answers that follow from the rule tables by reading them."""
    from marlstone.functions import questions as Q
    from marlstone.operators.questions import parsed

    asked = ["Please compare profit versus loss, last quarter", "locate the file", "Is id = K9 above 1,500?", "hm"]
    got = parsed(spark.createDataFrame(list(enumerate(asked)), "n long, question string")).orderBy("n").collect()
    assert [r["cleaned"] for r in got] == ["compare profit versus loss, previous quarter", "locate the file", "is id = k9 above 1,500?", "hm"]
    assert [r["intent"] for r in got] == ["analysis_financial", "lookup_specific", "lookup_specific", "unknown"]
    assert [(e["kind"], e["value"]) for e in got[2]["entities"]] == [("reference_id", "id = k9")]
    assert [tuple(c) for c in got[2]["constraints"]] == [("amount", "greater_than", "1500")]
    assert got[0]["periods"] == ["last_quarter"] and got[0]["complexity"] == "complex" and got[3]["complexity"] == "simple"
    assert len(Q.REWRITES) == 15 and all(len(p) == 4 for p in Q.INTENTS.values()) and len(Q.INTENTS) == 9


def test_index_round_trip(spark, tmp_path):
    from marlstone.sources.store import append_texts, load_index, save_index

    path = f"file://{tmp_path}/index"
    items = spark.createDataFrame([("a", "one", {"k": "v"}, [1.0, 2.0]), ("b", "two", {}, None)], "id string, text string, metadata map<string,string>, vector array<double>")
    save_index(items, path)
    more = spark.createDataFrame([("c", "three", {}), ("a", "one", {"k": "v"})], "id string, text string, metadata map<string,string>")
    append_texts(path, more, lambda t: F.array(F.length(t).cast("double"), F.lit(0.5)))
    got = sorted((r["id"], r["text"], r["metadata"], r["vector"]) for r in load_index(spark, path).collect())
    assert [(g[0], g[3]) for g in got] == [("a", [1.0, 2.0]), ("a", [3.0, 0.5]), ("b", [0.0, 0.0]), ("c", [5.0, 0.5])]


def test_replayed_batch_changes_nothing(spark, tmp_path):
    from marlstone.streaming.jobs import ingest

    spark.createDataFrame([(1, "x"), (2, "y")], "k long, v string").write.parquet(f"file://{tmp_path}/in")
    seen = []

    def upsert(batch, number):
        seen.append(number)
        batch.write.mode("overwrite").parquet(f"file://{tmp_path}/out/batch={number}")

    for checkpoint in ("one", "two"):  # the second run has lost its checkpoint and sees the batch again
        ingest(spark.readStream.schema("k long, v string").parquet(f"file://{tmp_path}/in"), upsert, f"file://{tmp_path}/{checkpoint}")
    assert seen == [0, 0] and spark.read.parquet(f"file://{tmp_path}/out").count() == 2


def test_discover_and_index(spark, tmp_path):
    (tmp_path / "HR desk").mkdir()
    (tmp_path / "HR desk" / "leave_policy.md").write_bytes(b"Leave \xff rules")
    (tmp_path / "HR desk" / "skip.xyz").write_text("no")
    (tmp_path / "HR desk" / "empty.txt").write_text("")
    (tmp_path / "HR desk" / "NOTES.Txt").write_text("loud")
    got = files.discover(spark, f"file://{tmp_path}").orderBy(F.desc("title")).collect()
    assert [(r["title"], r["text"], r["owner_folder"]) for r in got] == [("leave policy", "Leave  rules", "HR desk"), ("NOTES", "loud", "HR desk")]
    assert one(spark, files.department_of(F.col("f"), {"hr": "HR", "ptil": "Finance"}), f="Md. X (HR)") == "HR"
    (tmp_path / "a.json").write_text(json.dumps({"dim": 2, "items": [{"id": "x", "text": "t", "metadata": {"a": "b"}, "vector": [1.0, 2.0]}]}))
    (tmp_path / "b.json").write_text(json.dumps({"version": "2", "embedding_dim": 2, "documents": ["u"], "embeddings": [[3.0, 4.0]], "metadata": [{"c": "d"}]}))
    (tmp_path / "c.json").write_text("{broken")
    rows = {r["id"]: (r["text"], list(r["vector"])) for r in files.read_index(spark, f"file://{tmp_path}/*.json").collect()}
    assert rows == {"x": ("t", [1.0, 2.0]), "doc-0": ("u", [3.0, 4.0])}


def test_adaptive_threshold_stream(spark, tmp_path):
    from marlstone.streaming.jobs import adaptive_thresholds

    schema = "intent string, at long, query_id long, quality double, threshold_seen double"
    spark.createDataFrame([("lookup_specific", 1, 1, 0.9, 0.7), ("lookup_specific", 2, 2, 0.2, 0.1), ("analysis_trend", 1, 3, 0.6, 0.3), ("summary", 1, 4, 0.9, 0.3)], schema).write.parquet(f"file://{tmp_path}/in")
    stream = adaptive_thresholds(spark.readStream.schema(schema).parquet(f"file://{tmp_path}/in"))
    q = stream.writeStream.outputMode("update").format("memory").queryName("thresholds").trigger(availableNow=True).option("checkpointLocation", f"file://{tmp_path}/cp").start()
    q.awaitTermination()
    got = {r["intent"]: (round(r["threshold"], 4), round(r["confidence"], 4), r["seen"]) for r in spark.table("thresholds").collect()}
    assert got == {"lookup_specific": (0.695, 0.89, 2), "analysis_trend": (0.25, 0.75, 1)}
