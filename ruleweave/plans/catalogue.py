"""A query for each feature, over the sample tables, and the same in SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalar import joined, printed, quotient, remainder
from ..operators.aggregate import aggregate, aggregate_set
from ..operators.located import outbox
from ..operators.recursion import added_up, closure, counted, fixpoint, shared_folder, written
from ..operators.relational import both, derive, either, having, matched, meet, minus, product, renamed, unless, within
from ..sources.durable import DurableTable
from ..sources.tables import load, ticks
from .rules import RuleBook

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with the SQL that must give the same rows."""

    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


# scan, filter, project


@query("SELECT DISTINCT n_nationkey, n_name, n_regionkey FROM nation")
def scan(spark, d):
    return load(spark, d, "nation").distinct()


@query("SELECT DISTINCT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 300000.0")
def filter_cmp(spark, d):
    return derive(load(spark, d, "orders").where("o_totalprice > 300000.0"), "o_orderkey", "o_totalprice")


@query("SELECT DISTINCT o_orderkey FROM orders WHERE o_totalprice >= 100000.0 AND o_custkey <= 500")
def filter_conj(spark, d):
    return derive(load(spark, d, "orders").where("o_totalprice >= 100000.0").where("o_custkey <= 500"), "o_orderkey")


@query("SELECT DISTINCT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus <> 'F'")
def filter_neq_string(spark, d):
    return derive(load(spark, d, "orders").where("o_orderstatus <> 'F'"), "o_orderkey", "o_orderstatus")


@query("SELECT DISTINCT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'")
def const_in_atom(spark, d):
    return derive(load(spark, d, "customer").where("c_mktsegment = 'BUILDING'"), "c_custkey")


@query("SELECT DISTINCT c_custkey AS k FROM customer WHERE c_custkey = c_nationkey")
def repeated_var(spark, d):
    return renamed(load(spark, d, "customer", ["c_custkey", "c_name", "c_nationkey"]), "k", "_", "k").distinct()


@query("SELECT DISTINCT c_custkey + c_nationkey AS a, c_custkey - c_nationkey AS b, c_custkey * c_nationkey AS c FROM customer")
def project_int_arith(spark, d):
    return derive(load(spark, d, "customer"), a="c_custkey + c_nationkey", b="c_custkey - c_nationkey", c="c_custkey * c_nationkey")


@query("SELECT DISTINCT o_orderkey, (o_custkey - 700) // 7 AS q, (o_custkey - 700) % 7 AS r FROM orders")
def project_int_div_mod(spark, d):
    k = F.col("o_custkey") - 700
    return derive(load(spark, d, "orders"), "o_orderkey", q=quotient(k, 7), r=remainder(k, 7))


@query("SELECT DISTINCT -c_custkey AS k FROM customer")
def project_unary_minus(spark, d):
    return derive(load(spark, d, "customer"), k="-c_custkey")


@query("SELECT DISTINCT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS net FROM lineitem")
def project_double_arith(spark, d):
    return derive(load(spark, d, "lineitem"), "l_orderkey", "l_linenumber", net="round(l_extendedprice * (1 - l_discount), 4)")


@query("SELECT DISTINCT n_name || '/' || r_name AS path FROM nation JOIN region ON n_regionkey = r_regionkey")
def project_concat(spark, d):
    n = renamed(load(spark, d, "nation"), "_", "nation", "key")
    return derive(meet(n, renamed(load(spark, d, "region"), "key", "region")), path=joined("nation", F.lit("/"), "region"))


@query("SELECT DISTINCT n_nationkey, n_nationkey = n_regionkey AS same FROM nation")
def project_bool(spark, d):
    return derive(load(spark, d, "nation"), "n_nationkey", same="n_nationkey = n_regionkey")


# joins


def _customers(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "customer").withColumnsRenamed({"c_custkey": "cust", "c_nationkey": "nation"})


@query("SELECT DISTINCT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 300000.0")
def join_equi2(spark, d):
    o = load(spark, d, "orders").where("o_totalprice > 300000.0").withColumnRenamed("o_custkey", "cust")
    return derive(meet(o, _customers(spark, d)), "o_orderkey", "c_name")


@query("SELECT DISTINCT o_orderkey, c_name, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey")
def join_equi3(spark, d):
    o = load(spark, d, "orders").withColumnRenamed("o_custkey", "cust")
    n = load(spark, d, "nation").withColumnRenamed("n_nationkey", "nation")
    return derive(meet(meet(o, _customers(spark, d)), n), "o_orderkey", "c_name", "n_name")


@query("SELECT DISTINCT s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def join_equal_qual(spark, d):
    return derive(meet(load(spark, d, "supplier"), load(spark, d, "nation"), "s_nationkey = n_nationkey"), "s_suppkey", "n_name")


def _balances(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    s, c = load(spark, d, "supplier", ["s_suppkey", "s_nationkey", "s_acctbal"]), load(spark, d, "customer", ["c_custkey", "c_nationkey", "c_acctbal"])
    return s.withColumnRenamed("s_nationkey", "nation"), c.withColumnRenamed("c_nationkey", "nation")


@query("SELECT DISTINCT s_suppkey, c_custkey FROM supplier JOIN customer ON s_nationkey = c_nationkey AND s_acctbal < c_acctbal")
def join_theta(spark, d):
    return matched(*_balances(spark, d), "s_suppkey", "c_custkey", lambda s, c: meet(s, c, "s_acctbal < c_acctbal"))


@query("SELECT DISTINCT s_suppkey, c_custkey FROM supplier JOIN customer ON s_nationkey = c_nationkey AND s_acctbal <= c_acctbal AND c_acctbal <= s_acctbal + 500.0")
def join_range(spark, d):
    s, c = _balances(spark, d)
    s = s.withColumn("high", F.col("s_acctbal") + 500.0)
    return matched(s, c, "s_suppkey", "c_custkey", lambda s, c: within(s, c, "c_acctbal", "s_acctbal", "high", 500.0))


@query("SELECT DISTINCT n_name, r_name FROM nation, region")
def join_cross(spark, d):
    return derive(product(load(spark, d, "nation"), load(spark, d, "region")), "n_name", "r_name")


@query("SELECT DISTINCT x.n_name AS a, y.n_name AS b FROM nation x JOIN nation y ON x.n_regionkey = y.n_regionkey AND x.n_nationkey < y.n_nationkey")
def join_self(spark, d):
    n = load(spark, d, "nation", ["n_nationkey", "n_name", "n_regionkey"])
    return derive(meet(renamed(n, "x", "a", "region"), renamed(n, "y", "b", "region"), "x < y"), "a", "b")


@query("SELECT DISTINCT n_nationkey FROM nation WHERE EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey)")
def join_semi(spark, d):
    return derive(having(load(spark, d, "nation"), load(spark, d, "supplier").withColumnRenamed("s_nationkey", "n_nationkey")), "n_nationkey")


@query("SELECT DISTINCT c_custkey AS cust FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def anti(spark, d):
    with_p = derive(load(spark, d, "orders").where("o_orderstatus = 'P'"), cust="o_custkey")
    return derive(unless(_customers(spark, d), with_p), "cust")


@query("SELECT DISTINCT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def anti_const(spark, d):
    return derive(unless(load(spark, d, "customer"), load(spark, d, "orders"), "o_custkey = c_custkey", "o_orderstatus = 'P'"), "c_custkey", "c_name")


@query("SELECT DISTINCT s_suppkey FROM supplier s WHERE NOT EXISTS (SELECT 1 FROM supplier t WHERE t.s_nationkey = s.s_nationkey AND t.s_acctbal > s.s_acctbal)")
def anti_theta(spark, d):
    s = load(spark, d, "supplier", ["s_suppkey", "s_nationkey", "s_acctbal"])
    return derive(unless(renamed(s, "s_suppkey", "nation", "mine"), renamed(s, "_", "nation", "other"), "mine < other"), "s_suppkey")


@query("SELECT DISTINCT c_custkey AS cust FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_totalprice < 0)")
def anti_empty(spark, d):
    none = load(spark, d, "orders", ["o_orderkey", "o_totalprice"]).where("o_totalprice < 0")
    return derive(unless(_customers(spark, d), none), "cust")


@query("""SELECT DISTINCT c_custkey AS cust FROM customer WHERE NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT o_orderstatus AS s FROM orders)
    WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = s))""")
def division(spark, d):
    o = derive(load(spark, d, "orders"), cust="o_custkey", status="o_orderstatus")
    needed = product(derive(_customers(spark, d), "cust"), derive(o, "status"))
    return unless(derive(_customers(spark, d), "cust"), derive(unless(needed, o), "cust"))


# set operations


@query("SELECT c_nationkey AS nation FROM customer WHERE c_acctbal > 9000.0 UNION SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000.0")
def union(spark, d):
    c = load(spark, d, "customer").where("c_acctbal > 9000.0").selectExpr("c_nationkey AS nation")
    return either(c, load(spark, d, "supplier").where("s_acctbal > 5000.0").select("s_nationkey"))


@query("SELECT c_nationkey AS nation FROM customer WHERE c_acctbal > 9000.0 INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000.0")
def intersect(spark, d):
    c = load(spark, d, "customer").where("c_acctbal > 9000.0").selectExpr("c_nationkey AS nation")
    return both(c, load(spark, d, "supplier").where("s_acctbal > 5000.0").select("s_nationkey"))


@query("SELECT o_custkey AS cust FROM orders EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 200000.0")
def except_(spark, d):
    o = load(spark, d, "orders")
    return minus(o.selectExpr("o_custkey AS cust"), o.where("o_totalprice > 200000.0").select("o_custkey"))


# aggregates


def _sql_aggregate(by: str, aggs: str, inner: str, table: str, rest: str = "") -> str:
    keys = f"{by}, " if by else ""
    return f"SELECT {keys}{aggs} FROM (SELECT DISTINCT {keys}{inner} FROM {table}) {f'GROUP BY {by}' if by else 'HAVING count(*) > 0'}{rest}"


@query(_sql_aggregate("c_nationkey", "count(*) AS n", "c_custkey", "customer"))
def agg_count(spark, d):
    return aggregate(load(spark, d, "customer"), ["c_nationkey"], n=("count", "c_custkey"))


@query(_sql_aggregate("o_custkey", "CAST(sum(o_orderkey) AS BIGINT) AS total", "o_orderkey", "orders"))
def agg_sum(spark, d):
    return aggregate(load(spark, d, "orders"), ["o_custkey"], total=("sum", "o_orderkey"))


@query(_sql_aggregate("c_mktsegment", "min(c_acctbal) AS low", "c_acctbal", "customer"))
def agg_min(spark, d):
    return aggregate(load(spark, d, "customer"), ["c_mktsegment"], low=("min", "c_acctbal"))


@query(_sql_aggregate("o_orderstatus", "max(o_totalprice) AS high", "o_totalprice", "orders"))
def agg_max(spark, d):
    return aggregate(load(spark, d, "orders"), ["o_orderstatus"], high=("max", "o_totalprice"))


@query(_sql_aggregate("o_orderstatus", "round(avg(o_totalprice), 4) AS mean", "o_totalprice", "orders"))
def agg_avg(spark, d):
    return aggregate(load(spark, d, "orders"), ["o_orderstatus"], mean=("avg", "o_totalprice")).withColumn("mean", F.round("mean", 4))


@query(_sql_aggregate("l_suppkey", "count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS s, max(l_quantity) AS q", "l_partkey, l_linenumber, l_quantity", "lineitem"))
def agg_multi(spark, d):
    return aggregate(load(spark, d, "lineitem"), ["l_suppkey"], n=("count", "l_partkey"), s=("sum", "l_linenumber"), q=("max", "l_quantity"))


@query("SELECT p_brand, CAST(sum(x) AS BIGINT) AS total FROM (SELECT DISTINCT p_brand, p_size + 3 AS x FROM part) GROUP BY p_brand")
def agg_expr_arg(spark, d):
    return aggregate(load(spark, d, "part"), ["p_brand"], total=("sum", "p_size + 3"))


@query("SELECT g, CAST(sum(u) AS BIGINT) AS a, CAST(sum(v) AS BIGINT) AS b FROM (SELECT DISTINCT l_suppkey AS g, l_linenumber AS u, l_partkey % 3 AS v FROM lineitem) GROUP BY g")
def agg_distinct_trap(spark, d):
    return aggregate(load(spark, d, "lineitem"), {"g": "l_suppkey"}, a=("sum", "l_linenumber"), b=("sum", "l_partkey % 3"))


@query("SELECT CAST(sum(x) AS BIGINT) AS total, count(*) AS n FROM (SELECT DISTINCT o_custkey AS x FROM orders) HAVING count(*) > 0")
def agg_global(spark, d):
    return aggregate(load(spark, d, "orders"), total=("sum", "o_custkey"), n=("count", "o_custkey"))


@query("SELECT CAST(sum(x) AS BIGINT) AS total FROM (SELECT DISTINCT o_custkey AS x FROM orders WHERE o_totalprice < 0) HAVING count(*) > 0")
def agg_global_empty(spark, d):
    return aggregate(load(spark, d, "orders").where("o_totalprice < 0"), total=("sum", "o_custkey"))


@query("SELECT n_regionkey, min(n_name) AS a, max(n_name) AS z FROM nation GROUP BY n_regionkey")
def agg_minmax_string(spark, d):
    return aggregate(load(spark, d, "nation"), ["n_regionkey"], a=("min", "n_name"), z=("max", "n_name"))


@query("SELECT c_nationkey, min(c_acctbal > 5000.0) AS every, max(c_acctbal > 5000.0) AS some FROM customer GROUP BY c_nationkey")
def agg_minmax_bool(spark, d):
    return aggregate(load(spark, d, "customer"), ["c_nationkey"], every=("min", "c_acctbal > 5000.0"), some=("max", "c_acctbal > 5000.0"))


@query("SELECT c_nationkey AS nation, count(*) AS n FROM customer GROUP BY c_nationkey UNION SELECT s_nationkey, count(*) FROM supplier GROUP BY s_nationkey")
def agg_two_rules(spark, d):
    c = aggregate(load(spark, d, "customer"), {"nation": "c_nationkey"}, n=("count", "c_custkey"))
    return either(c, aggregate(load(spark, d, "supplier"), {"nation": "s_nationkey"}, n=("count", "s_suppkey")))


@query("SELECT n, count(*) AS customers FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) GROUP BY n")
def agg_over_agg(spark, d):
    return aggregate(aggregate(load(spark, d, "orders"), ["o_custkey"], n=("count", "o_orderkey")), ["n"], customers=("count", "o_custkey"))


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 15")
def having_count(spark, d):
    return aggregate(load(spark, d, "orders"), ["o_custkey"], n=("count", "o_orderkey")).where("n > 15")


@query("SELECT c_nationkey AS nation, count(*) AS n FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') GROUP BY c_nationkey")
def agg_over_negation(spark, d):
    with_p = derive(load(spark, d, "orders").where("o_orderstatus = 'P'"), cust="o_custkey")
    return aggregate(unless(_customers(spark, d), with_p), ["nation"], n=("count", "cust"))


@query("SELECT o_custkey, max(o_totalprice) AS top FROM orders GROUP BY o_custkey")
def top_one(spark, d):
    """The largest of each group and its row: a maximum, joined back."""
    o = derive(load(spark, d, "orders"), "o_custkey", top="o_totalprice")
    return derive(meet(o, aggregate(o, ["o_custkey"], top=("max", "top"))), "o_custkey", "top")


@query("SELECT x.s_suppkey AS s, count(*) AS richer FROM supplier x JOIN supplier y ON x.s_nationkey = y.s_nationkey AND x.s_acctbal < y.s_acctbal GROUP BY x.s_suppkey")
def rank_by_count(spark, d):
    """How many of the same nation are richer: all of the buckets of balances above, and a rank within the own bucket."""
    s = derive(load(spark, d, "supplier"), s="s_suppkey", nation="s_nationkey", mine="s_acctbal").withColumn("bucket", F.floor(F.col("mine") / 100))
    sizes = aggregate(s, ["nation", "bucket"], n=("count", "s"))
    above = Window.partitionBy("nation").orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("nation", "bucket", F.coalesce(F.sum("n").over(above), F.lit(0)).alias("above"))
    rank = F.rank().over(Window.partitionBy("nation", "bucket").orderBy(F.desc("mine"))) - 1
    return s.join(sizes, ["nation", "bucket"]).select("s", (F.col("above") + rank).alias("richer")).where("richer > 0")


@query("SELECT epoch_us(ts) // 3600000000 AS hour, event_type, count(*) AS n FROM events GROUP BY ALL")
def tumbling_buckets(spark, d):
    e = load(spark, d, "events", ["event_id", "ts", "event_type"])
    return aggregate(e, {"hour": quotient("ts", 3_600_000_000), "event_type": "event_type"}, n=("count", "event_id"))


# recursion


def _parents(spark: SparkSession, d: str) -> DataFrame:
    return derive(load(spark, d, "part", ["p_partkey"]).where("p_partkey > 0"), a="p_partkey", b=quotient("p_partkey", 2))


_SQL_TREE = "e AS (SELECT p_partkey AS a, p_partkey // 2 AS b FROM part WHERE p_partkey > 0), r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)"


@query(f"WITH RECURSIVE {_SQL_TREE} SELECT a, b FROM r")
def rec_linear(spark, d):
    return closure(_parents(spark, d))


@query(f"WITH RECURSIVE {_SQL_TREE} SELECT a, b FROM r")
def rec_nonlinear(spark, d):
    """r(a, b) from r(a, m) and r(m, b): closure() joins the relation with itself."""
    return closure(_parents(spark, d))


@query("""WITH RECURSIVE e AS (SELECT p_partkey AS a, p_partkey // 2 AS b FROM part WHERE p_partkey > 0),
    r AS (SELECT a, b, 1 AS k FROM e UNION SELECT r.a, e.b, 1 - r.k FROM r JOIN e ON r.b = e.a) SELECT a, b, k = 1 AS odd FROM r""")
def rec_mutual(spark, d):
    """Odd walks are an edge, or an even one and an edge; even ones an odd one and an edge: the two relations are kept as one, and parities of parts are added."""
    return closure(_parents(spark, d).withColumn("odd", F.lit(True)), along=lambda x, y: x != y)


@query("""WITH RECURSIVE e AS (SELECT DISTINCT n_nationkey % 7 AS a, (n_nationkey * 3 + 1) % 7 AS b FROM nation),
    r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a) SELECT a, b FROM r""")
def rec_cyclic(spark, d):
    return closure(derive(load(spark, d, "nation"), a="n_nationkey % 7", b="(n_nationkey * 3 + 1) % 7"))


@query("""WITH RECURSIVE r AS (SELECT p_partkey AS a, '/' || p_partkey AS path FROM part WHERE p_partkey IN (1, 2, 3)
    UNION SELECT p_partkey, r.path || '/' || p_partkey FROM r JOIN part ON p_partkey // 2 = r.a AND p_partkey > 3) SELECT a, path FROM r""")
def rec_string_path(spark, d):
    part = written(derive(load(spark, d, "part", ["p_partkey"]), child="p_partkey", a=quotient("p_partkey", 2)))
    base = derive(part.where("child in (1, 2, 3)"), a="child", path=joined(F.lit("/"), F.col("child").cast("string")))
    return fixpoint(base, lambda new, _: new.join(part.where("child > 3"), "a").select(F.col("child").alias("a"), joined("path", F.lit("/"), F.col("child").cast("string")).alias("path")))


@query("SELECT x FROM generate_series(0, 3000) AS t(x)")
def rec_counter(spark, d):
    return counted(spark.range(1).select(F.col("id").alias("x")), "x", 3000)


@query("SELECT s_suppkey AS g, count(*) AS n FROM supplier, generate_series(0, 1000) AS t(x) GROUP BY ALL")
def rec_counter_agg(spark, d):
    start = derive(load(spark, d, "supplier", ["s_suppkey"]), g="s_suppkey", x="cast(0 as bigint)")
    return aggregate_set(counted(start, "x", 1000), ["g"], n=("count", "x"))


@query("WITH RECURSIVE t AS (SELECT CAST(0.0 AS DOUBLE) AS x UNION ALL SELECT x + CAST(0.3 AS DOUBLE) FROM t WHERE x < 60.0) SELECT round(x, 9) AS x FROM t")
def rec_counter_double(spark, d):
    return added_up(spark, 0.0, 0.3, 60.0).select(F.round("x", 9).alias("x"))


@query(f"WITH RECURSIVE {_SQL_TREE} SELECT a FROM e EXCEPT SELECT a FROM r WHERE b = 3")
def rec_then_neg(spark, d):
    edges = _parents(spark, d)
    return unless(derive(edges, "a"), derive(closure(edges).where("b = 3"), "a"))


@query(f"WITH RECURSIVE {_SQL_TREE} SELECT b, count(*) AS n FROM r GROUP BY b")
def rec_then_agg(spark, d):
    return aggregate_set(closure(_parents(spark, d)), ["b"], n=("count", "a"))


@query("""WITH a1 AS (SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'),
    a2 AS (SELECT c_custkey AS k FROM customer EXCEPT SELECT k FROM a1), a3 AS (SELECT o_custkey AS k FROM orders EXCEPT SELECT k FROM a2)
    SELECT c_custkey AS k FROM customer EXCEPT SELECT k FROM a3""")
def neg_cascade(spark, d):
    c, o = derive(load(spark, d, "customer"), k="c_custkey"), load(spark, d, "orders")
    a1 = unless(c, derive(o.where("o_orderstatus = 'P'"), k="o_custkey"))
    a3 = unless(derive(o, k="o_custkey"), unless(c, a1))
    return unless(c, a3)


# what stays, changes, and travels


def _nations(spark: SparkSession, folder: str | None = None) -> RuleBook:
    book = RuleBook(spark, folder)
    book.define("nation", {"key": "int", "name": "string", "region": "int"}, durable=folder is not None)
    book.define("pair", {"a": "string", "b": "string"})
    return book


def _pair(x: DataFrame, y: DataFrame) -> DataFrame:
    return derive(meet(x.toDF("ka", "a", "region"), y.toDF("kb", "b", "region"), "ka < kb"), "a", "b")


_SQL_PAIRS = ORACLES["join_self"]


@query(_SQL_PAIRS)
def incremental_facts(spark, d):
    book, nation = _nations(spark), load(spark, d, "nation")
    book.rule("pair", _pair, {"x": "nation", "y": "nation"})
    book.load("nation", nation.where("n_nationkey < 10"))
    book.refresh()
    book.load("nation", nation.where("n_nationkey >= 5"))
    return book.table("pair")


@query(_SQL_PAIRS)
def late_rule(spark, d):
    book = _nations(spark)
    book.load("nation", load(spark, d, "nation"))
    book.refresh()
    book.rule("pair", _pair, {"x": "nation", "y": "nation"})
    return book.table("pair")


@query("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def retraction(spark, d):
    """Rows that a later fact takes away."""
    book = RuleBook(spark)
    for name in ("customer", "pending", "calm"):
        book.define(name, {"k": "int"})
    book.rule("calm", lambda customer, pending: unless(customer, pending), ["customer"], whole=["pending"])
    book.load("customer", derive(load(spark, d, "customer"), k="c_custkey"))
    book.refresh()
    book.load("pending", derive(load(spark, d, "orders").where("o_orderstatus = 'P'"), k="o_custkey"))
    return book.table("calm")


@query("SELECT DISTINCT n_nationkey, n_name, n_regionkey FROM nation")
def persistent_table(spark, d):
    nation = load(spark, d, "nation")
    kept = DurableTable(spark, f"{shared_folder(spark)}/durable-{uuid.uuid4().hex}", nation.schema)
    for part in (nation.where("n_nationkey < 10"), nation):
        kept.insert(part)
    return kept.read()


@query("SELECT x * 250000 AS deadline FROM generate_series(1, 40) AS t(x)")
def timer_ticks(spark, d):
    book = RuleBook(spark)
    book.timer("clock", 250)
    book.advance(3_000_000)
    book.advance(10_000_000)
    return book.table("clock")


_HERE = "tcp:here:5000"
_NODE = "CASE WHEN user_id % 2 = 0 THEN 'tcp:here:5000' ELSE 'tcp:there:5000' END"


@query(f"SELECT DISTINCT {_NODE} AS node, event_id FROM events WHERE {_NODE} <> '{_HERE}'")
def located_outbox(spark, d):
    return outbox(derive(load(spark, d, "events", ["event_id", "user_id"]), "event_id", node=_NODE), "node", _HERE)


@query(f"SELECT DISTINCT node, user_id, count(*) AS n FROM (SELECT DISTINCT CASE WHEN {_NODE} = '{_HERE}' THEN 'tcp:there:5000' ELSE '{_HERE}' END AS node, user_id, event_id FROM events) GROUP BY ALL")
def located_cluster(spark, d):
    """A rule that gives its rows another location."""
    e = derive(load(spark, d, "events", ["event_id", "user_id"]), "event_id", "user_id", node=_NODE)
    sent = derive(e, "event_id", "user_id", node=f"CASE WHEN node = '{_HERE}' THEN 'tcp:there:5000' ELSE '{_HERE}' END")
    return aggregate(sent, ["node", "user_id"], n=("count", "event_id"))


@query("SELECT n_nationkey || ',' || n_name || ',' || n_regionkey AS line FROM nation")
def dump_lines(spark, d):
    return printed(load(spark, d, "nation").distinct())


@query("SELECT DISTINCT o_orderkey AS order_key, c_name AS customer FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 300000.0")
def big_orders(spark, d):
    """The flagship: large orders and who placed them."""
    o = load(spark, d, "orders", ["o_orderkey", "o_custkey", "o_totalprice"]).where("o_totalprice > 300000.0")
    return derive(meet(renamed(o, "order_key", "cust", "_"), renamed(load(spark, d, "customer", ["c_custkey", "c_name"]), "cust", "customer")), "order_key", "customer")
