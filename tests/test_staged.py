"""The staged search where its order of retrieval is tied, and where its scores lie between two rounded ones."""

import duckdb

from marlstone.operators import staged as S

COLUMNS = "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_returnflag STRING"
SQL = S.ORACLE_SQL["dr01_staged_search"]


def found(spark, rows, path):
    spark.createDataFrame(rows, COLUMNS).coalesce(1).write.parquet(f"{path}/lineitem.parquet")
    return {tuple(r) for r in S.QUERIES["dr01_staged_search"](spark, str(path)).collect()}


def wanted(rows, sql):
    con = duckdb.connect()
    con.execute(f"CREATE TABLE lineitem ({COLUMNS})")
    con.executemany("INSERT INTO lineitem VALUES (?, ?, ?, ?, ?)", rows)
    return set(con.execute(sql).fetchall())


def test_tied_candidates_come_in_one_order(spark, tmp_path):
    """Each order has two lines of one number at one supplier."""
    rows = [(1009 * k + 1008 - k % 3, 10 * k + 3 + 4 * (k % 2) + twin * 10, k % 5, 1, "ANR"[twin]) for k in range(60) for twin in range(2)]
    got = found(spark, rows, tmp_path / "forward")
    assert got == found(spark, rows[::-1], tmp_path / "backward")
    whole = SQL.replace("ORDER BY similarity DESC, tie)", "ORDER BY similarity DESC, tie, business DESC, temporal DESC, entity DESC, document, kind)")
    assert whole != SQL and got and got == wanted(rows, whole)


def test_scores_round_as_in_the_sql(spark, tmp_path):
    """Scores of 0.5029815, which six digits cut short as doubles."""
    trend = next(k for k in range(400_000) if k * 31 % 1009 == 382 and k % 400 > 365)
    comparison = next(k for k in range(2000) if k * 31 % 1009 == 417)
    rows = [(trend, 9, 8, 1, "A"), (comparison, 5, 7, 2, "N"), (1008, 3, 5, 1, "R")]
    got = found(spark, rows, tmp_path / "once")
    assert len(got) == 3 and got == wanted(rows, SQL)
