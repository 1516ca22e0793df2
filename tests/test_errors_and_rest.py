"""Errors, sources, and the rest of the library."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from ruleweave import errors as E
from ruleweave.functions.scalar import quotient, remainder
from ruleweave.operators import located, recursion
from ruleweave.operators.aggregate import aggregate
from ruleweave.operators.recursion import added_up, closure, counted, fixpoint
from ruleweave.operators.relational import both, either, having, meet, minus, product, renamed, unless
from ruleweave.plans.rules import RuleBook
from ruleweave.sources.durable import DurableTable
from ruleweave.sources.tables import facts, relation, schema, ticks


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_facts_are_typed(spark):
    with pytest.raises(E.TypeMismatch):
        schema({"a": "date"})
    for bad, error in (((1,), E.WrongArity), ((1, None), E.NullValue), ((1.0, "a"), E.TypeMismatch), ((True, "a"), E.TypeMismatch), ((1, "ab"), E.TypeMismatch), ((1 << 63, "a"), E.TypeMismatch)):
        with pytest.raises(error):
            facts(spark, {"a": "int", "b": "char"}, [bad])
    assert rows(facts(spark, {"a": "int", "b": "char"}, [(-1, "x"), (-1, "x")])) == [(-1, "x")]


def test_relation_widens_and_checks(spark):
    df = spark.sql("select 1 a, timestamp_ntz'2024-01-01 00:00:01' t, cast(1.5 as float) f, true b")
    assert rows(relation(df, check=True)) == [(1, 1704067201000000, 1.5, True)]
    with pytest.raises(E.NullValue):
        relation(spark.sql("select cast(null as int) a"), check=True)
    with pytest.raises(E.TypeMismatch):
        relation(spark.sql("select array(1) a"))


def test_rule_errors(spark):
    b = RuleBook(spark)
    for t in "xyz":
        b.define(t, {"a": "int"})
    with pytest.raises(E.TableExists):
        b.define("x", {"a": "int"})
    for bad in (lambda: b.table("none"), lambda: b.rule("none", lambda x: x, ["x"]), lambda: b.rule("x", lambda n: n, {"n": "none"})):
        with pytest.raises(E.NoSuchTable):
            bad()
    with pytest.raises(E.UnsafeRule):
        b.rule("x", lambda: None)
    with pytest.raises(E.WrongArity):
        b.rule("x", lambda y: y.selectExpr("a", "a b"), ["y"])
    with pytest.raises(E.TypeMismatch):
        b.rule("x", lambda y: y.selectExpr("cast(a as double)"), ["y"])
    b.rule("x", unless, {"left": "y"}, whole={"right": "z"}, name="r")
    with pytest.raises(E.RuleError):
        b.rule("y", lambda x: x, ["x"], name="r")
    with pytest.raises(E.NotStratified):
        b.rule("z", lambda x: x, ["x"])
    assert len(b.rules) == 1 and "x from y, all of z" in b.explain()
    with pytest.raises(E.RuleError):
        b.timer("t", 0)
    with pytest.raises(E.RuleError):
        b.define("kept", {"a": "int"}, durable=True)


def test_endless_recursion_is_stopped(spark):
    with pytest.raises(E.RoundLimit):
        fixpoint(spark.range(1).toDF("a"), lambda new, _: new.selectExpr("a + 1"), 3)
    with pytest.raises(E.RoundLimit):
        added_up(spark, 1e17, 1.0, 1e18)


def test_relational_edges(spark):
    a, b, none = facts(spark, {"k": "int", "x": "int"}, [(1, 2), (3, 4)]), facts(spark, {"k": "int", "y": "int"}, [(1, 5)]), facts(spark, {"z": "int"}, [])
    with pytest.raises(E.Unconnected):
        meet(a, none)
    with pytest.raises(E.Unconnected):
        product(a, b, most=0)
    assert rows(unless(a, none)) == rows(a) and rows(unless(a, b.select("y"))) == []
    assert rows(unless(a, b, "y < x")) == rows(a) and rows(unless(a, b, "y > x")) == [(3, 4)] and rows(having(a, b)) == [(1, 2)]
    assert rows(renamed(facts(spark, {"a": "int", "b": "int", "c": "int"}, [(1, 9, 1), (1, 9, 2)]), "v", "_", "v")) == [(1,)]
    assert rows(either(a, b)) == [(1, 2), (1, 5), (3, 4)] and rows(both(a, a)) == rows(a) and rows(minus(a, a)) == []
    with pytest.raises(E.WrongArity):
        either(a, none)
    with pytest.raises(E.WrongArity):
        renamed(a, "k")


def test_aggregates_over_distinct_tuples(spark):
    t = facts(spark, {"g": "int", "u": "int", "v": "int"}, [(1, 10, 1), (1, 10, 2)])
    assert rows(aggregate(t, ["g"], a=("sum", "u"), b=("sum", "v"))) == [(1, 20, 3)]
    assert rows(aggregate(t, ["g"], a=("sum", "u"))) == [(1, 10)]
    assert rows(aggregate(t.where("g > 1"), a=("sum", "u"))) == [] and rows(aggregate(t, n=("count", "v"))) == [(2,)]
    for bad, error in ((("sum", "cast(u as double)"), E.TypeMismatch), (("avg", "u"), E.TypeMismatch), (("median", "u"), E.RuleError)):
        with pytest.raises(error):
            aggregate(t, ["g"], a=bad)


def test_whole_number_division(spark):
    t = spark.createDataFrame([(-7, 2), (7, -2), (9007199254740993, 1)], "a long, b long")
    assert t.select(quotient("a", "b"), remainder("a", "b")).collect() == [(-3, -1), (-3, 1), (9007199254740993, 0)]
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        t.select(quotient("a", 0)).collect()


@pytest.mark.parametrize("start,limit,step", [(0, 10, 1), (0, 10, 3), (0, 9, 3), (5, 5, 1), (9, 5, 1), (10, 0, -3), (-3, 4, 2)])
def test_counting_equals_rounds(spark, start, limit, step):
    base = spark.createDataFrame([(start,)], "x long")
    slow = fixpoint(base, lambda new, _: new.where(f"x {'<' if step > 0 else '>'} {limit}").selectExpr(f"x + {step}L"))
    assert rows(counted(base, "x", limit, step)) == rows(slow)


def test_repeated_sums(spark):
    x, want = 0.0, [0.0]
    while x < 2.4:
        x += 0.3
        want.append(x)
    assert [r.x for r in added_up(spark, 0.0, 0.3, 2.4).orderBy("x").collect()] == want


@pytest.mark.parametrize("seed", range(3))
def test_random_graphs(spark, seed, monkeypatch):
    monkeypatch.setattr(recursion, "MOVED_ROWS", (0, 0, 9999)[seed])
    monkeypatch.setattr(recursion, "SENT_ROWS", (0, 9999, 0)[seed])
    rng = random.Random(seed)
    edges = {(rng.randrange(9), rng.randrange(9)) for _ in range(12)}
    reach = set(edges)
    while more := {(a, d) for a, b in reach for c, d in edges if b == c} - reach:
        reach |= more
    b = RuleBook(spark)
    for t in ("edge", "reach", "apart"):
        b.define(t, {"a": "int", "b": "int"})
    b.define("far", {"a": "int", "n": "int"})
    changes = [lambda: b.rule("reach", lambda edge: edge, ["edge"]), lambda: b.rule("reach", lambda x, y: x.toDF("a", "m").join(y.toDF("m", "b"), "m").select("a", "b"), {"x": "reach", "y": "reach"}), lambda: b.rule("apart", lambda edge, reach: unless(edge.select("b", "a").toDF("a", "b"), reach), ["edge"], whole=["reach"]), lambda: b.rule("far", lambda reach: aggregate(reach, ["a"], n=("count", "b")), whole=["reach"])]
    changes += [lambda part=part: b.add("edge", part) for part in (sorted(edges)[:5], sorted(edges)[3:])]
    rng.shuffle(changes)
    for change in changes:
        change()
        b.refresh()
    assert rows(b.table("reach")) == sorted(reach) == rows(closure(facts(spark, {"a": "int", "b": "int"}, edges)))
    assert rows(b.table("apart")) == sorted((y, x) for x, y in edges if (y, x) not in reach)
    assert rows(b.table("far")) == sorted((k, len(list(g))) for k, g in itertools.groupby(sorted(reach), lambda e: e[0]))


def test_durable_and_timer(spark, tmp_path):
    b = RuleBook(spark, str(tmp_path))
    b.define("kept", {"a": "int"}, durable=True)
    b.add("kept", [(1,), (2,)])
    b.add("kept", [(2,), (3,)])
    again = RuleBook(spark, str(tmp_path))
    again.define("kept", {"a": "int"}, durable=True)
    assert again.dump("kept") == "1\n2\n3"
    assert rows(DurableTable(spark, str(tmp_path / "none"), schema({"a": "int"})).read()) == []
    b.timer("t", 10)
    b.advance(25_000)
    b.advance(25_000)
    b.advance(30_000)
    assert rows(b.table("t")) == [(10_000,), (20_000,), (30_000,)]
    assert rows(ticks(spark, 1, 0, 999)) == []


def test_locations(spark):
    for bad in (lambda: located.location("a b", 1), lambda: located.location("a", 70000), lambda: located.local(spark.range(1), "id", "here")):
        with pytest.raises(E.BadLocation):
            bad()
    t = facts(spark, {"at": "string", "x": "int"}, [("tcp:a:1", 1), ("tcp:b:2", 2)])
    assert rows(located.local(t, "at", "tcp:a:1")) == [("tcp:a:1", 1)] and rows(located.outbox(t, "at", "tcp:a:1")) == [("tcp:b:2", 2)]
    b = RuleBook(spark)
    for bad in (lambda: b.define("t", {"at": "string"}, location="at"), lambda: RuleBook(spark, here="tcp:a:1").define("t", {"at": "int"}, location="at")):
        with pytest.raises(E.BadLocation):
            bad()


def test_stream_into_rules(spark, tmp_path):
    from ruleweave.streaming.live import feed

    spark.range(5).toDF("a").write.parquet(str(tmp_path / "in"))
    b = RuleBook(spark, str(tmp_path / "durable"))
    for t in ("seen", "even"):
        b.define(t, {"a": "int"}, durable=t == "seen")
    with pytest.raises(E.RuleError):
        feed(spark.readStream.schema("a long").parquet(str(tmp_path / "in")), b, "even", str(tmp_path / "mark"))
    b.rule("even", lambda seen: seen.where("a % 2 = 0"), ["seen"])
    told = []
    b.on_change("even", lambda name, more, less: told.append(more.count()))
    feed(spark.readStream.schema("a long").parquet(str(tmp_path / "in")), b, "seen", str(tmp_path / "mark"), availableNow=True).awaitTermination(120)
    assert b.dump("even") == "0\n2\n4" and told == [3]


def test_a_stream_goes_on_after_a_restart(spark, tmp_path):
    from ruleweave.streaming.live import feed

    for k in range(2):  # a session each, with one file more
        spark.range(3 * k, 3 * k + 3).toDF("a").write.mode("append").parquet(str(tmp_path / "in"))
        b = RuleBook(spark, str(tmp_path / "durable"))
        b.define("seen", {"a": "int"}, durable=True)
        feed(spark.readStream.schema("a long").parquet(str(tmp_path / "in")), b, "seen", str(tmp_path / "mark"), availableNow=True).awaitTermination(120)
    assert rows(b.table("seen")) == [(k,) for k in range(6)]


def test_live_timer_keeps_to_the_wall_clock(spark, tmp_path):
    import time

    from ruleweave.streaming.live import live_timer

    def deadlines(period_ms, seconds):
        name = f"ticks{period_ms}"
        query = live_timer(spark, period_ms).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).start()
        time.sleep(seconds)
        query.stop()
        return sorted(r.deadline for r in spark.table(name).collect())

    began = time.time()
    found = deadlines(1000, 8)
    assert 2 <= len(found) == len(set(found)) <= 9 and all(d % 1_000_000 == 0 and began - 1 <= d / 1e6 <= time.time() for d in found)
    assert len(deadlines(3_600_000, 4)) <= 1
    with pytest.raises(E.RuleError):
        live_timer(spark, 0)


def test_what_a_book_keeps_is_deleted(spark, tmp_path):
    import os

    folder = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir")
    files = lambda: {os.path.join(d, f) for d, _, names in os.walk(folder.removeprefix("file:")) for f in names}
    before = files()
    b = RuleBook(spark)
    b.define("x", {"a": "int"})
    b.define("y", {"a": "int"})
    b.rule("y", lambda x: x, ["x"])
    b.add("x", [(1,), (2,)])
    assert b.dump("y") == "1\n2" and files() > before
    b.close()
    assert not files() - before


def test_durable_batches(spark, tmp_path):
    t = DurableTable(spark, str(tmp_path / "t"), schema({"a": "int"}))
    for part in ([(1,), (2,)], [(2,), (3,)], []):
        t.insert(facts(spark, {"a": "int"}, part))
    (tmp_path / "t" / "_new-broken").mkdir()  # a batch that was not finished
    assert rows(t.read()) == [(1,), (2,), (3,)] and len(t.batches()) == 3
    t.compact()
    assert rows(t.read()) == [(1,), (2,), (3,)] and len(t.batches()) == 1


def test_large_joins_need_an_equal_column(spark):
    a, b = spark.range(150_000).toDF("x"), spark.range(150_000).toDF("y")
    with pytest.raises(E.Unconnected):
        meet(a, b, "x < y")
    assert meet(a, b.limit(2), "x < y").count() == 1 and meet(a, b, "x = y").count() == 150_000


def test_counting_from_far_and_for_long(spark):
    got = counted(spark.range(1).selectExpr("id AS x"), "x", 200_000)
    assert got.agg(F.count("*"), F.sum("x")).first() == (200_001, 200_000 * 200_001 // 2)
    sums = added_up(spark, 0.0, 0.1, 20_000.0)
    x, n = 0.0, 1
    while x < 20_000.0:
        x, n = x + 0.1, n + 1
    assert sums.agg(F.count("*"), F.max("x")).first() == (n, x)


def test_command_line(spark, tmp_path, capsys):
    from ruleweave.plans.__main__ import main

    (tmp_path / "p.py").write_text("def program(book):\n    book.define('t', {'a': 'int'})\n    book.add('t', [(2,), (1,)])\n")
    main([str(tmp_path / "p.py"), "--dump", "t"])
    assert capsys.readouterr().out == "1\n2\n"


def test_catalogue_has_sql():
    from ruleweave.plans.catalogue import ORACLES, QUERIES

    assert set(ORACLES) == set(QUERIES) and len(QUERIES) > 60
