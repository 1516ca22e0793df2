"""Programs over made-up data that grows step by step; what must come out is worked out by plain loops over sets."""

import random
from collections import defaultdict

from pyspark.sql import functions as F

from ruleweave.functions.scalar import joined
from ruleweave.operators.aggregate import aggregate
from ruleweave.operators.relational import derive, meet, unless, within
from ruleweave.plans.rules import RuleBook


def check(spark, tables, rules, plain, steps):
    """Puts each step's facts into a book and compares its tables with plain(all facts so far)."""
    book, seen = RuleBook(spark), defaultdict(set)
    for name, columns in tables.items():
        book.define(name, columns)
    rules(book)
    for step in steps:
        for name, rows in step.items():
            book.add(name, rows)
            seen[name] |= set(rows)
        for name, want in plain(seen).items():
            assert {tuple(r) for r in book.table(name).collect()} == set(want), (name, step)
    return book


def some(rng, n, *choices):
    return sorted({tuple(rng.choice(list(c)) for c in choices) for _ in range(n)})


def test_loans_with_a_rule_that_comes_late(spark):
    rng = random.Random(11)
    readers, books = [f"reader{i}" for i in range(8)], [f"book{i}" for i in range(6)]
    two = {"a": "string", "b": "string"}

    def rules(book):
        book.rule("reads", lambda loan, topic: meet(loan.toDF("a", "m"), topic.toDF("m", "b")).select("a", "b"), ["loan", "topic"])

    def plain(f):
        return {"reads": {(a, t) for a, m in f["loan"] for b, t in f["topic"] if m == b}}

    topics = ["sea", "stars", "bread"]
    book = check(spark, {"loan": two, "topic": two, "reads": two, "known": two}, rules, plain, [{"loan": some(rng, 9, readers, books)}, {"topic": some(rng, 8, books, topics)}, {"loan": some(rng, 6, readers, books)}])
    for table in ("loan", "topic"):
        book.rule("known", lambda x: x, {"x": table})
    assert {tuple(r) for r in book.table("known").collect()} == {tuple(r) for t in ("loan", "topic") for r in book.table(t).collect()}


def test_water_that_rises_past_gauges(spark):
    """Recursion over a comparison: a level goes on as long as some gauge is at or below it."""

    def rules(book):
        book.rule("level", lambda level, gauge: meet(level, gauge.toDF("g"), "a >= g").where("a < 12").selectExpr("a + 3 AS a"), ["level", "gauge"])

    def plain(f):
        levels = set(f["level"])
        while more := {(a + 3,) for (a,) in levels for (g,) in f["gauge"] if a >= g and a < 12} - levels:
            levels |= more
        return {"level": levels}

    one = {"a": "int"}
    check(spark, {"level": one, "gauge": one}, rules, plain, [{"level": [(2,)]}, {"gauge": [(4,)]}, {"level": [(-7,), (5,)]}, {"gauge": [(-9,)]}])


def test_who_reports_to_whom(spark):
    rng = random.Random(4)
    people = [f"p{i}" for i in range(14)]
    two = {"a": "string", "b": "string"}

    def rules(book):
        book.rule("under", lambda boss: boss, ["boss"])
        book.rule("under", lambda boss, under: meet(boss.toDF("a", "m"), under.toDF("m", "b")).select("a", "b"), ["boss", "under"])

    def plain(f):
        under = set(f["boss"])
        while more := {(a, d) for a, b in f["boss"] for c, d in under if b == c} - under:
            under |= more
        return {"under": under}

    check(spark, {"boss": two, "under": two}, rules, plain, [{"boss": some(rng, 7, people, people)} for _ in range(3)])


def test_swaps_of_unlike_things(spark):
    rng = random.Random(8)
    things = ["cup", "hat", "cupboard", "Hat", ""]
    check(
        spark, {"offer": {"a": "string", "b": "string"}, "swap": {"a": "string", "b": "string"}}, lambda book: book.rule("swap", lambda offer: offer.where("a <> b"), ["offer"]),
        lambda f: {"swap": {(a, b) for a, b in f["offer"] if a != b}}, [{"offer": some(rng, 9, things, things)}, {"offer": some(rng, 9, things, things)}],
    )


def test_times_tables(spark):
    def rules(book):
        book.rule("n", lambda n: n.where("a < 9").selectExpr("a + 2"), ["n"])
        book.rule("made", lambda n: n.selectExpr("a", "a * a", "a - 40", "-a"), ["n"])
        book.rule("half", lambda half: half.where("a > 1.0").selectExpr("a / 2.0d", "b * 0.5d"), ["half"])

    def plain(f):
        n, half = set(f["n"]), set(f["half"])
        while more := {(a + 2,) for (a,) in n if a < 9} - n:
            n |= more
        while more := {(a / 2.0, b * 0.5) for a, b in half if a > 1.0} - half:
            half |= more
        return {"n": n, "made": {(a, a * a, a - 40, -a) for (a,) in n}, "half": half}

    tables = {"n": {"a": "int"}, "made": dict.fromkeys("abcd", "int"), "half": {"a": "double", "b": "double"}}
    check(spark, tables, rules, plain, [{"n": [(1,), (4,)]}, {"half": [(9.0, 3.25), (0.5, 1.0)]}, {"n": [(-3,)]}])


def test_stock_that_is_sold(spark):
    rng = random.Random(2)
    two = {"a": "string", "b": "int"}
    goods = ["pear", "plum", "fig"]
    check(
        spark, {"made": two, "sold": two, "left": two}, lambda book: book.rule("left", unless, {"left": "made"}, whole={"right": "sold"}), lambda f: {"left": f["made"] - f["sold"]},
        [{"made": some(rng, 8, goods, range(5))}, {"sold": some(rng, 5, goods, range(5))}, {"made": some(rng, 4, goods, range(9))}, {"sold": some(rng, 9, goods, range(9))}],
    )


def test_doors_behind_doors(spark):
    """Each negation rests on the one before, so that one late fact turns results over and over."""
    rng = random.Random(5)
    one = {"a": "int"}

    def rules(book):
        book.rule("open", lambda door, locked: unless(door, locked), ["door"], whole=["locked"])
        book.rule("dark", lambda lamp, open: unless(lamp, open), ["lamp"], whole=["open"])
        book.rule("lit", lambda lamp, dark: unless(lamp, dark), ["lamp"], whole=["dark"])
        book.rule("seen", lambda lit: lit, ["lit"])

    def plain(f):
        opened = f["door"] - f["locked"]
        dark = f["lamp"] - opened
        return {"open": opened, "dark": dark, "lit": f["lamp"] - dark, "seen": f["lamp"] - dark}

    rooms = range(12)
    check(spark, {t: one for t in ("door", "locked", "lamp", "open", "dark", "lit", "seen")}, rules, plain, [{"door": some(rng, 8, rooms)}, {"lamp": some(rng, 9, rooms)}, {"locked": some(rng, 3, rooms)}, {"locked": some(rng, 5, rooms), "lamp": some(rng, 2, rooms)}])


def test_guests_invited_twice(spark):
    """A row that two rules give stays while one of them still does."""
    rng = random.Random(7)
    two = {"a": "int", "b": "int"}

    def rules(book):
        book.rule("guest", lambda family: family, ["family"])
        book.rule("guest", lambda friend, away, ill: unless(unless(friend, away), ill), ["friend"], whole=["away", "ill"])

    pairs = (range(4), range(4))
    check(
        spark, {t: two for t in ("guest", "family", "friend", "away", "ill")}, rules, lambda f: {"guest": f["family"] | (f["friend"] - f["away"] - f["ill"])},
        [{"family": some(rng, 4, *pairs), "friend": some(rng, 7, *pairs)}, {"away": some(rng, 5, *pairs)}, {"ill": some(rng, 5, *pairs)}],
    )


def test_shared_hobbies_of_a_team(spark):
    """A join and its complement, and what is left of both: nothing."""
    rng = random.Random(1)
    one = {"a": "int"}

    def rules(book):
        book.rule("both", meet, {"left": "chess", "right": "chorus"})
        book.rule("only", unless, {"left": "chess"}, whole={"right": "chorus"})
        book.rule("clash", meet, {"left": "both", "right": "only"})

    def plain(f):
        return {"both": f["chess"] & f["chorus"], "only": f["chess"] - f["chorus"], "clash": set()}

    check(spark, {t: one for t in ("chess", "chorus", "both", "only", "clash")}, rules, plain, [{"chess": some(rng, 6, range(9))}, {"chorus": some(rng, 6, range(9))}, {"chess": some(rng, 3, range(9))}])


def test_addresses_of_rooms(spark):
    """Recursion that puts names together, under a negation that closes whole wings."""
    rng = random.Random(6)
    rooms = [(i, rng.randrange(i) if i else -1, f"r{i}", rng.random() < 0.6) for i in range(13)]

    def rules(book):
        book.rule("usable", lambda room, shut: unless(room.where("parent = -1"), shut), ["room"], whole=["shut"])
        book.rule("usable", lambda usable, room, shut: unless(meet(room, usable.select(F.col("id").alias("parent"))).select(*room.columns), shut), ["usable", "room"], whole=["shut"])
        book.rule("address", lambda usable: usable.where("parent = -1").select("id", "name"), ["usable"])
        book.rule("address", lambda usable, address: meet(usable, address.toDF("parent", "above")).select("id", joined("above", F.when(F.col("wing"), ">").otherwise("."), "name")), ["usable", "address"])

    def plain(f):
        shut, address, usable = {i for (i,) in f["shut"]}, {}, set()
        for i, parent, name, wing in sorted(f["room"]):
            if i not in shut and (parent == -1 or parent in address):
                address[i] = name if parent == -1 else address[parent] + (">" if wing else ".") + name
                usable.add((i, parent, name, wing))
        return {"usable": usable, "address": set(address.items())}

    room = {"id": "int", "parent": "int", "name": "string", "wing": "bool"}
    check(spark, {"room": room, "usable": room, "shut": {"id": "int"}, "address": {"id": "int", "text": "string"}}, rules, plain, [{"room": rooms[:8]}, {"room": rooms[8:]}, {"shut": [(4,), (9,)]}, {"shut": [(0,)]}])


def test_budgets_without_what_was_struck_out(spark):
    rng = random.Random(3)
    two = {"a": "int", "b": "int"}

    def rules(book):
        book.rule("total", lambda item, struck, paid: aggregate(unless(unless(item, struck), paid), ["a"], b=("sum", "b")), whole=["item", "struck", "paid"])
        book.rule("shown", lambda total: total, ["total"])

    def plain(f):
        total = defaultdict(int)
        for a, b in f["item"] - f["struck"] - f["paid"]:
            total[a] += b
        return {"total": set(total.items()), "shown": set(total.items())}

    pairs = (range(4), range(10, 15))
    check(spark, {t: two for t in ("item", "struck", "paid", "total", "shown")}, rules, plain, [{"item": some(rng, 8, *pairs)}, {"struck": some(rng, 6, *pairs)}, {"item": some(rng, 8, *pairs), "paid": some(rng, 6, *pairs)}])


def test_highest_and_lowest_that_are_withdrawn(spark):
    rng = random.Random(9)
    two = {"a": "int", "b": "int"}

    def rules(book):
        book.rule("range", lambda bid, withdrawn: aggregate(unless(bid, withdrawn), ["a"], low=("min", "b"), high=("max", "b"), n=("count", "b")), whole=["bid", "withdrawn"])

    def plain(f):
        found = defaultdict(list)
        for a, b in f["bid"]:
            if (a,) not in f["withdrawn"]:
                found[a].append(b)
        return {"range": {(a, min(x), max(x), len(x)) for a, x in found.items()}}

    check(spark, {"bid": two, "withdrawn": {"a": "int"}, "range": dict.fromkeys(("a", "low", "high", "n"), "int")}, rules, plain, [{"bid": some(rng, 9, range(5), range(-3, 30))}, {"withdrawn": [(1,), (4,)]}, {"bid": some(rng, 9, range(5), range(-3, 30))}])


def test_means_of_what_a_rule_makes(spark):
    def rules(book):
        book.rule("step", lambda step: step.where("b < a").selectExpr("a", "b + 0.75d"), ["step"])
        book.rule("mean", lambda step: aggregate(step, ["a"], x=("avg", "b"), y=("avg", "a - b")), whole=["step"])

    def plain(f):
        step = set(f["step"])
        while more := {(a, b + 0.75) for a, b in step if b < a} - step:
            step |= more
        groups = defaultdict(list)
        for a, b in step:
            groups[a].append(b)
        return {"step": step, "mean": {(a, sum(x) / len(x), sum(a - b for b in x) / len(x)) for a, x in groups.items()}}

    two = {"a": "double", "b": "double"}  # quarters add up exactly in any order
    check(spark, {"step": two, "mean": {"a": "double", "x": "double", "y": "double"}}, rules, plain, [{"step": [(2.5, 0.25)]}, {"step": [(4.0, -1.0), (-1.0, 3.0)]}])


def test_first_and_last_words_and_flags(spark):
    rng = random.Random(12)
    kinds = {"f": ("bool", (True, False)), "s": ("string", ("", "Zoo", "ant", "zoo", "é", "an"))}

    def rules(book):
        for k in kinds:
            book.rule(f"{k} ends", lambda t: aggregate(t, ["k"], low=("min", "v"), high=("max", "v")), whole={"t": k})

    def plain(f):
        out = {}
        for k in kinds:
            groups = defaultdict(set)
            for a, v in f[k]:
                groups[a].add(v)
            code = lambda v: v.encode() if isinstance(v, str) else v
            out[f"{k} ends"] = {(a, min(x, key=code), max(x, key=code)) for a, x in groups.items()}
        return out

    tables = {k: {"k": "int", "v": t} for k, (t, _) in kinds.items()} | {f"{k} ends": {"k": "int", "low": t, "high": t} for k, (t, _) in kinds.items()}
    check(spark, tables, rules, plain, [{k: some(rng, 5, range(3), v) for k, (_, v) in kinds.items()} for _ in range(2)])


def test_changes_are_told_once(spark):
    told = []
    b = RuleBook(spark)
    for name in ("x", "y", "z"):
        b.define(name, {"a": "int"})
    b.rule("z", unless, {"left": "x"}, whole={"right": "y"})
    b.on_change("z", lambda name, more, less: told.append((name, sorted(r.a for r in more.collect()), sorted(r.a for r in less.collect()))))
    b.add("x", [(10,), (20,)])
    b.refresh()
    b.add("x", [(20,)])
    b.refresh()
    b.add("y", [(10,)])
    b.refresh()
    assert told == [("z", [10, 20], []), ("z", [], [10])]
    assert derive(b.table("z"), "a").count() == 1


def test_range_joins_by_buckets(spark):
    rng = random.Random(13)
    left, right = some(rng, 40, range(3), range(-20, 20), range(-20, 30)), some(rng, 40, range(3), range(-25, 35))
    for width in (1, 7, 100):
        got = within(spark.createDataFrame(left, "k long, low long, high long"), spark.createDataFrame(right, "k long, v long"), "v", "low", "high", width)
        assert sorted(tuple(r) for r in got.select("k", "low", "high", "v").collect()) == sorted((k, a, b, v) for k, a, b in left for m, v in right if k == m and a <= v <= b)


def test_located_tables(spark):
    here, there = "tcp:a:1", "tcp:b:2"
    book = RuleBook(spark, here=here)
    book.define("note", {"at": "string", "x": "int"}, location="at")
    book.define("copy", {"x": "int"})
    book.rule("copy", lambda note: note.select("x"), ["note"])
    book.add("note", [(here, 1), (there, 2), (here, 3)])
    assert book.dump("note") == f"{here},1\n{here},3" and book.dump("copy") == "1\n3"
    assert [tuple(r) for r in book.outbox("note").collect()] == [(there, 2)]
