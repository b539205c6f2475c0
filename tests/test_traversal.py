"""Closures with cycles, relationship and time passes, and the versioned index with its writers."""

import random
import threading
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from marlstone.operators import traversal as T
from marlstone.sources.rebuild import Running, VersionedIndex
from marlstone.sources.store import below


def closure(edges, root, rounds=None):
    seen, frontier, k = {root: 0}, [root], 0
    while frontier and (rounds is None or k < rounds):
        k += 1
        frontier = list({b for a, b in edges if a in frontier and b is not None} - set(seen))
        seen |= dict.fromkeys(frontier, k)
    return {(root, n, h) for n, h in seen.items()}


@pytest.mark.parametrize("rounds", [None, 0, 2])
def test_reachable_on_graphs_with_cycles(spark, rounds):
    rng = random.Random(3)
    edges = [(rng.choice("abcdefghij"), rng.choice([*"abcdefghij", None])) for _ in range(18)] + [("a", "a"), ("x", "y"), ("y", "x"), ("x", "y"), (None, "a")]
    df = spark.createDataFrame([(*e, 1) for e in edges], "source string, target string, hops int")
    roots = spark.createDataFrame([("a",), ("x",), ("alone",), ("a",), (None,)], "root string")
    got = [tuple(r) for r in T.reachable(df, roots, rounds).collect()]
    want = set().union(*(closure(edges, r, rounds) for r in ("a", "x", "alone")))
    assert len(got) == len(set(got)) and set(got) == want
    both = edges + [(b, a) for a, b in edges if a is not None and b is not None]
    assert {tuple(r) for r in T.reachable(df, roots, rounds, both_ways=True).collect()} == set().union(*(closure(both, r, rounds) for r in ("a", "x", "alone")))
    assert T.reachable(df.limit(0), roots.limit(0)).count() == 0


def test_reachable_keeps_no_row_a_pair(spark, monkeypatch):
    """1100 roots (three blocks) over one hub to 40 nodes and back: rows of rounds go by node and block, not by pair."""
    edges = spark.createDataFrame([(f"r{i}", "hub") for i in range(1100)] + [("hub", f"n{i}") for i in range(40)] + [("n0", "hub"), ("n1", "r5")], "source string, target string")
    roots, rows, write = spark.createDataFrame([(f"r{i}",) for i in range(1100)], "root string"), [], T.written

    def counted(df, name):
        out = write(df, name)
        rows.append(out[0].count() if name == "frontier" else 0)
        return out

    monkeypatch.setattr(T, "written", counted)
    got = {(r.root, r.node, r.hops) for r in T.reachable(edges, roots).collect()}
    want = {(f"r{i}", n, h) for i in range(1100) for n, h in [(f"r{i}", 0), ("hub", 1)] + [(f"n{k}", 2) for k in range(40)] + ([("r5", 3)] if i != 5 else [])}
    assert got == want
    assert sum(rows) < 5000


def test_folders_in_a_circle_end(spark):
    folders = spark.createDataFrame([("b", "a"), ("c", "b"), ("a", "c"), ("d", "c"), ("e", "z"), ("c", "b")], "id string, parent string")
    assert sorted(r["id"] for r in below(folders, "a").collect()) == ["b", "c", "d"]
    assert below(folders, "nowhere").count() == 0


def test_relationship_pass(spark):
    edges = [("d1", f"t{9 - k}", kind, k) for k, kind in enumerate(["cross_reference", "mention", "temporal_sequence", "business_related", "cross_reference", "cross_reference", "cross_reference"])]
    df = spark.createDataFrame([("d1", "d1", "cross_reference", 99), *edges], "source string, target string, kind string, place int").withColumn("strength", F.lit(0.5))
    results = spark.createDataFrame([("d1", "Ref: A-1 and invoice B2, ref A-1"), ("d1", None), ("d2", ""), (None, "lc 9")], "doc string, text string")
    got = sorted(((r["doc"], r["text"], r["related_documents"], r["cross_references"]) for r in T.relationship_pass(results, df, "doc", "text").collect()), key=str)
    near = ["t9", "t7", "t6", "t5", "t4"]
    assert got == sorted([("d1", "Ref: A-1 and invoice B2, ref A-1", near, ["A-1", "B2"]), ("d1", None, near, []), ("d2", "", [], []), (None, "lc 9", [], ["9"])], key=str)
    ids = spark.createDataFrame([("d1",), ("t9",), ("zz",)], "id string")
    assert sorted((r["id"], r["target"]) for r in T.relationships_of(df, ids, "id").collect()) == sorted([("t9", "t9"), ("d1", "d1"), *(("d1", e[1]) for e in edges)])
    report = {r["kind"]: (r["edges"], r["documents"], r["loops"]) for r in T.relationship_report(df).collect()}
    assert report["cross_reference"] == (5, 5, 1) and report["mention"] == (1, 2, 0)


def brute_temporal(rows, today):
    """Rows of one question in the order and with the scores that the rules give."""
    q, intent, periods, timed = rows[0][4:8]
    trend = intent == "analysis_trend"
    if not (trend or periods or timed):
        return [(r[0], r[2]) for r in rows]

    def holds(created, p):
        lo, hi = T.period_bounds(p, today)
        return lo is None or (created >= lo and (hi is None or created <= hi))

    kept = [r for r in rows if any(holds(r[3], p) for p in periods or [])] if periods else rows
    out = []
    for r in kept or rows:
        age = (today - r[3].date()).days
        f = 1.0
        if "current" in (q or "").lower():
            f = 1.2 if age < 7 else 1.1 if age < 30 else 1.0
        elif trend and 30 < age < 365:
            f = 1.15
        out.append((r[0], r[2] * f, r[3]))
    out.sort(key=lambda x: -x[1])
    if trend and "over time" in (q or ""):
        out.sort(key=lambda x: x[2], reverse=True)
    return [(k, s) for k, s, _ in out]


def test_temporal_pass(spark):
    rng, today = random.Random(5), date(2024, 5, 20)
    groups, rows = {}, []
    for g in range(40):
        q = rng.choice(["what is the Current state", "how it changed over time", "anything", None])
        about = (q, rng.choice(["analysis_trend", "lookup", None]), rng.choice([[], [], ["last_quarter"], ["last_month", "current_quarter"], ["some year"]]), rng.random() < 0.3)
        groups[g] = [(g * 100 + k, k, float(rng.randint(1, 3)), datetime(2024, 5, 20) - timedelta(days=rng.choice([0, 3, 10, 29, 31, 60, 110, 364, 365, 700])), *about) for k in range(rng.randint(1, 7))]
        rows += [(g, *r) for r in groups[g]]
    df = spark.createDataFrame(rows, "g int, id int, place int, final_score double, created_at timestamp, question string, intent string, periods array<string>, timed boolean")
    got = {}
    for r in sorted(T.temporal_pass(df, today, ["g"], "id").collect(), key=lambda r: (r["g"], r["rank"])):
        got.setdefault(r["g"], []).append((r["id"], r["final_score"]))
    assert got.keys() == groups.keys()
    for g, found in got.items():
        assert found == [(k, pytest.approx(s)) for k, s in brute_temporal(groups[g], today)]


def test_period_bounds():
    assert T.period_bounds("last_quarter", date(2024, 2, 3)) == (datetime(2023, 10, 1), datetime(2023, 12, 31))
    assert T.period_bounds("last_quarter", date(2024, 5, 3)) == (datetime(2024, 1, 1), datetime(2024, 3, 31))
    assert T.period_bounds("last_month", date(2024, 1, 3)) == (datetime(2023, 12, 1), datetime(2023, 12, 31))
    assert T.period_bounds("current_quarter", date(2024, 12, 3)) == (datetime(2024, 10, 1), None)


@pytest.fixture()
def index(spark, tmp_path):
    return VersionedIndex(spark, f"file://{tmp_path}/index", keep=2)


def ids(index, number=None):
    found = index.read(number)
    return None if found is None else sorted(r["id"] for r in found.collect())


def test_rebuild_swaps_whole_versions(spark, index):
    assert index.read() is None and index.status()["status"] == "idle"
    assert index.rebuild(lambda: spark.range(3))["result"] == {"rows": 3, "commit": 1}
    index.append(spark.range(10, 12))
    assert ids(index) == [0, 1, 2, 10, 11] and ids(index, 1) == [0, 1, 2]
    before = index.read()  # a reader of the old version goes on
    index.rebuild(lambda: spark.range(5, 7))
    assert ids(index) == [5, 6] and before.count() == 5 and index.status()["status"] == "completed"


@pytest.mark.parametrize("failure", ["raises", "empty"])
def test_failed_rebuild_changes_nothing(spark, index, failure):
    index.rebuild(lambda: spark.range(3))

    def build():
        if failure == "raises":
            raise ValueError("source is down")
        return spark.range(0)

    with pytest.raises((ValueError, RuntimeError)):
        index.rebuild(build)
    state = index.status()
    assert state["status"] == "failed" and state["error"] in ("source is down", "no documents were found") and state["finished_at"]
    assert ids(index) == [0, 1, 2]
    index.rebuild(lambda: spark.range(1))  # the lease is free again
    assert ids(index) == [0]


def test_two_rebuilds_at_once(spark, index):
    inside, go_on, outcomes = threading.Event(), threading.Event(), []

    def slow():
        inside.set()
        go_on.wait(60)
        return spark.range(4)

    first = threading.Thread(target=lambda: outcomes.append(index.rebuild(slow)))
    first.start()
    inside.wait(60)
    assert index.status()["status"] == "running"
    with pytest.raises(Running):
        index.rebuild(lambda: spark.range(9))
    go_on.set()
    first.join()
    assert outcomes[0]["status"] == "completed" and ids(index) == [0, 1, 2, 3]


def test_lease_of_a_crashed_rebuild_is_taken_over(spark, tmp_path):
    index = VersionedIndex(spark, f"file://{tmp_path}/index", lease_seconds=3600)
    index._create("lease.json", {"owner": "dead", "until": 1.0})
    index.rebuild(lambda: spark.range(2))
    assert ids(index) == [0, 1]


def test_writers_at_once_lose_nothing(spark, index):
    index.rebuild(lambda: spark.range(1))
    threads = [threading.Thread(target=lambda k=k: index.append(spark.range(100 * k, 100 * k + 3))) for k in range(1, 6)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert ids(index) == [0, *(100 * k + j for k in range(1, 6) for j in range(3))]
    assert index.commits() == list(range(1, 7))


def test_batches_count_once(spark, index, monkeypatch):
    index.append(spark.range(2), 0)
    assert index.append(spark.range(2), 0) == 1 and ids(index) == [0, 1]
    with monkeypatch.context() as m:  # dies after its part is written, before the commit

        def die(change):
            raise OSError("lost")

        m.setattr(index, "_commit", die)
        with pytest.raises(OSError):
            index.append(spark.range(2, 4), 1)
    assert ids(index) == [0, 1]
    index.append(spark.range(2, 4), 1)
    index.append(spark.range(4, 5), 0, "other")
    assert ids(index) == [0, 1, 2, 3, 4]
