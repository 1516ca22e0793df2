"""What must hold so that queries keep up with larger tables: work is dealt out, and results stay the same."""

import random

import pytest
from pyspark.sql import functions as F

from ruleweave.operators import recursion, relational
from ruleweave.operators.aggregate import aggregate_set
from ruleweave.operators.recursion import closure, counted, fixpoint
from ruleweave.operators.relational import matched, meet, within


@pytest.fixture
def small_tasks(monkeypatch):
    monkeypatch.setattr(relational, "TASK_PAIRS", 20_000, raising=False)
    monkeypatch.setattr(relational, "BLOCK_ROWS", 64, raising=False)


def sides(spark, n, m, values=1000, ids=None):
    rng = random.Random(5)
    one = lambda k: [(rng.randrange(ids or k), rng.randrange(2), float(rng.randrange(values))) for _ in range(k)]
    s, c = one(n), one(m)
    return s, c, spark.createDataFrame(s, "s long, k long, x double"), spark.createDataFrame(c, "c long, k long, y double")


def largest_share(df):
    rows = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    return max(rows) / sum(rows)


def test_comparisons_within_few_keys_are_dealt_out(spark, small_tasks):
    s, c, left, right = sides(spark, 600, 900)
    made = meet(left, right, "x < y")
    assert made.count() == sum(x < y for _, k, x in s for _, h, y in c if k == h)
    assert largest_share(made) < 0.2


def test_ranges_within_few_keys_are_dealt_out(spark, small_tasks):
    s, c, left, right = sides(spark, 600, 900)
    made = within(left.withColumn("high", F.col("x") + 500.0), right, "y", "x", "high", 500.0)
    assert made.count() == sum(x <= y <= x + 500 for _, k, x in s for _, h, y in c if k == h)
    assert largest_share(made) < 0.2


def test_pairs_of_repeated_values_come_once(spark, small_tasks):
    s, c, left, right = sides(spark, 300, 400, ids=350)
    left, right = left.union(left.limit(20)).union(spark.createDataFrame([(None, 0, 3.0), (None, 1, 3.0)], left.schema)), right.union(right.limit(20))
    want = {(i, j) for i, k, x in [*s, (None, 0, 3.0), (None, 1, 3.0)] for j, h, y in c if k == h and x < y}
    got = [tuple(r) for r in matched(left, right, "s", "c", lambda x, y: meet(x, y, "x < y")).collect()]
    assert len(got) == len(want) and set(got) == want


@pytest.mark.parametrize(("step", "limit"), ((3, 20), (1, 7), (-4, -11), (-1, 2)))
def test_counting_from_many_starts_that_run_into_one_another(spark, step, limit):
    rng = random.Random(step)
    starts = {(g, rng.randrange(-25, 25)) for g in "ab" for _ in range(14)} | {("c", limit), ("c", limit + step), ("d", None)}
    want = set(starts)
    while more := {(g, x + step) for g, x in want if x is not None and (x < limit if step > 0 else x > limit)} - want:
        want |= more
    got = [tuple(r) for r in counted(spark.createDataFrame(sorted(starts, key=str), "g string, x long"), "x", limit, step).collect()]
    assert len(got) == len(want) and set(got) == want


def test_counting_from_many_starts_is_dealt_out(spark):
    made = counted(spark.range(4000).selectExpr("id AS g", "0L AS x"), "x", 1000)
    assert largest_share(made.where("x < 1000")) < 0.4
    assert aggregate_set(made, ["g"], n=("count", "x")).agg(F.count("*"), F.min("n"), F.max("n")).first() == (4000, 1001, 1001)


def test_closure_makes_each_distance_once(spark, monkeypatch):
    """On a path all pairs are made in one way each: no more rows come out of a round's join than are new."""
    made, fresh = [], recursion._fresh
    monkeypatch.setattr(recursion, "_fresh", lambda found, *rest: made.append(found.count()) or fresh(found, *rest))
    got = {tuple(r) for r in closure(spark.range(1, 40).selectExpr("id AS a", "id - 1 AS b")).collect()}
    assert got == {(a, b) for a in range(1, 40) for b in range(a)}
    assert sum(made) == len(got) - 39


@pytest.mark.parametrize("seed", range(2))
def test_closure_with_what_comes_along(spark, seed):
    rng = random.Random(seed)
    edges = {(rng.randrange(8), rng.randrange(8), True) for _ in range(11)}
    want = set(edges)
    while more := {(a, d, not odd) for a, b, odd in want for c, d, _ in edges if b == c} - want:
        want |= more
    got = [tuple(r) for r in closure(spark.createDataFrame(sorted(edges), "a long, b long, odd boolean"), along=lambda x, y: x != y).collect()]
    assert len(got) == len(want) and set(got) == want


def test_rounds_keep_columns_and_types(spark):
    base = spark.createDataFrame([(1, "a,b", 0.5, True), (2, None, None, False)], "`x y` long, s string, d double, f boolean")
    got = fixpoint(base, lambda new, _: new.where("`x y` < 4").selectExpr("`x y` + 2", "s", "d", "f"))
    assert [(c.name, c.dataType) for c in got.schema] == [(c.name, c.dataType) for c in base.schema]
    assert {tuple(r) for r in got.collect()} == {(1, "a,b", 0.5, True), (3, "a,b", 0.5, True), (5, "a,b", 0.5, True), (2, None, None, False), (4, None, None, False)}
