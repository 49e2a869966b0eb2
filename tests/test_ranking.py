"""Numbering over many parts: all rows, one group over several parts, ties, null groups, no rows."""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import functions as F

from corpusjobs.operators import ranking


def rows_of(spark, n, parts=5):
    # group "hot" holds two thirds of the rows
    group = F.when(F.col("id") % 3 < 2, F.lit("hot")).when(F.col("id") % 7 == 0, F.lit(None)).otherwise(F.concat(F.lit("g"), (F.col("id") % 11).cast("string")))
    return spark.range(0, n, 1, parts).select(group.alias("g"), F.pmod(F.xxhash64("id"), F.lit(50)).alias("score"), F.col("id").alias("k"))


def expected(rows, by):
    groups, out = defaultdict(list), {}
    for r in rows:
        groups[r["g"] if by else None].append((-r["score"], r["k"]))
    for members in groups.values():
        for n, (_, k) in enumerate(sorted(members), 1):
            out[k] = n
    return out


def test_numbers_are_those_of_a_sort(spark):
    rows = rows_of(spark, 3000)
    order = [F.desc("score"), F.col("k")]
    for by in ([], ["g"]):
        got = ranking.numbered(rows, order, by, parts=7)
        assert got.columns == ["g", "score", "k", "position"]
        assert {r["k"]: r["position"] for r in got.collect()} == expected(rows.collect(), by)


def test_a_hot_group_lies_in_several_parts(spark):
    got = ranking.numbered(rows_of(spark, 3000), [F.col("score"), F.col("k")], ["g"], parts=8)
    most = got.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert most < 1000  # the hot group has 2,000 rows


def test_counts_may_join_without_a_broadcast(spark, monkeypatch):
    monkeypatch.setattr(ranking, "BROADCAST_COUNTS", 0)
    rows = rows_of(spark, 500)
    got = ranking.numbered(rows, [F.desc("score"), F.col("k")], ["g"], parts=4)
    assert {r["k"]: r["position"] for r in got.collect()} == expected(rows.collect(), True)


def test_equal_rows_and_none(spark):
    same = spark.range(10).select(F.lit(1).alias("x"))
    assert sorted(r["n"] for r in ranking.numbered(same, [F.col("x")], name="n").collect()) == list(range(1, 11))
    assert ranking.numbered(same.filter("x > 1"), [F.col("x")], parts=3).collect() == []
