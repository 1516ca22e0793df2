"""Mixing sources to target weights, by Pareto order sampling.

Each source has a target of words. Of every document as many whole copies as the target
holds of the whole source are taken for certain; the words that are left are drawn. A
longer document is drawn with a smaller probability (about by the root of its size, and 1
at most), so that few long ones don't decide a source; a source's probabilities are scaled
so that the words they promise are the words that are left. The draw ranks documents by
u / (1 - u) over p / (1 - p), where u is a random number in (0, 1) from the document and p
its inclusion probability, and takes the first ones until those words are reached, to the
nearest document: the sample's size in words is fixed.

No source is ever sorted as a whole: ranks are summed in bins, the bin where the
words run out is summed in finer bins, and only documents of the one fine bin that
holds the cut are sorted. What is decided is one small row per source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import kept, small

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_COPIES = 2
#: Bins of each of the two levels.
BINS = 1024
WORD = r"[^\x20\x09-\x0D]+"


def size(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(doc_id: Column, text: Column, seed: str = "mix") -> Column:
    """A random 52-bit number from a document's id and text: the same in every run."""
    key = F.concat(F.lit(seed), F.lit("|"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("|"), F.md5(F.coalesce(text, F.lit(""))))
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("long")


def _again(k: Column, number: Column) -> Column:
    """Another draw for the second, third, ... (number 1, 2, ...) of repeated rows."""
    key = F.concat(k.cast("string"), F.lit("|"), number.cast("string"))
    return F.when(number == 0, k).otherwise(F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("long"))


def size_class(size_: Column) -> Column:
    """Half the bits of a size: documents of class c are drawn 2^-c times as likely as those of class 0."""
    return F.floor(F.length(F.bin(size_)) / 2).cast("int")


def inclusion(scale: Column, size_: Column) -> Column:
    return F.least(F.lit(1.0), scale / F.pow(F.lit(2.0), size_class(size_)))


def rank_value(k: Column, p: Column) -> Column:
    """Random odds over inclusion odds; no value where nothing is drawn, 0 for what is drawn for certain."""
    u = (k.cast("double") + 0.5) / F.lit(float(1 << 52))
    return F.when(p >= 1, F.lit(0.0)).when(p > 0, (u / (1 - u)) / (p / (1 - p)))


def source_targets(sizes: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST_COPIES) -> DataFrame:
    """source, source_size -> source, source_size, target, copies (whole, for certain), rest (words to be drawn).

    Sources by code point, null last, take the weights in turn. They share `share`
    times all sizes; a target stops at `most` times its source's size, and the excess
    is shared again by weight until none is above. One row per source throughout.
    """
    cycle = F.array(*[F.lit(w) for w in weights])
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    rows = sizes.withColumn("w", F.element_at(cycle, (F.pmod(F.row_number().over(ordered) - 1, F.lit(len(weights))) + 1).cast("int")))
    rows = rows.withColumn("cap", F.col("source_size") * most)
    everything = Window.partitionBy()
    fill = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    below = fill.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("place", F.row_number().over(fill)).withColumn("level", (F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(below), F.lit(0))) / (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(below), F.lit(0))))
    # the first source, from the tightest cap on, that the level leaves below its cap
    settled = F.min(F.when(F.col("level") <= F.col("cap") / F.col("w"), F.struct("place", "level"))).over(everything)["level"]
    rows = rows.withColumn("target", F.least(F.col("cap").cast("double"), F.coalesce(settled * F.col("w"), F.col("cap").cast("double"))))
    due = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rows = rows.withColumn("copies", F.floor(due))
    return rows.select("source", "source_size", "target", "copies", (F.col("target") - F.col("copies") * F.col("source_size")).alias("rest"))


def _scaled(classes: DataFrame, near: DataFrame) -> DataFrame:
    """source, class, words -> source, scale: probabilities min(1, scale / 2^class) promise the source's rest. A few rows per source."""
    rows = classes.where("words > 0").join(near.select(F.col("source").alias("its"), "rest"), F.col("source").eqNullSafe(F.col("its"))).drop("its")
    own = Window.partitionBy("source").orderBy("class")
    before = F.coalesce(F.sum("words").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    onward = F.sum(F.col("words") / F.pow(F.lit(2.0), F.col("class"))).over(own.rowsBetween(0, Window.unboundedFollowing))
    rows = rows.withColumn("scale", (F.col("rest") - before) / onward)
    # the first class that isn't drawn for certain
    open_ = rows.where(F.col("scale") <= F.pow(F.lit(2.0), F.col("class")))
    return open_.groupBy("source").agg(F.min(F.struct("class", "scale")).alias("x")).select(F.col("source").alias("scaled"), F.col("x.scale").alias("scale"))


def _repeated(rows: DataFrame) -> DataFrame | None:
    """its_id, its_draw of rows that stand more than once with the same id and text; None if there are none. rows: doc_id, k."""
    found = rows.groupBy("doc_id", "k").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("its_id"), F.col("k").alias("its_draw"))
    found = kept(found, "mix-repeated")
    return None if found.isEmpty() else found


def _split(rows: DataFrame, repeated: DataFrame, ident: str, k: str) -> tuple[DataFrame, DataFrame]:
    """Rows that stand once, and rows that are repeated."""
    keys = small(repeated)
    same = rows[ident].eqNullSafe(keys["its_id"]) & (rows[k] == keys["its_draw"])
    return rows.join(keys, same, "left_anti"), rows.join(keys, same, "left_semi")


def _apart(rows: DataFrame, ident: str, k: str) -> DataFrame:
    """Repeated rows, each with a draw of its own. Many of them are numbered part by part: no part is larger than one of the table's."""
    marked = kept(rows.withColumns({"mix part": F.spark_partition_id(), "mix place": F.monotonically_increasing_id()}), "mix-parts")
    counts = marked.groupBy(ident, k, "mix part").agg(F.count("*").alias("n"))
    run = Window.partitionBy(ident, k).orderBy("mix part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(F.col(ident).alias("its_id"), F.col(k).alias("its_draw"), F.col("mix part").alias("its_part"), F.coalesce(F.sum("n").over(run), F.lit(0)).alias("before"))
    own = Window.partitionBy(ident, k, "mix part").orderBy("mix place")
    rows_ = marked.withColumn("mix number", F.row_number().over(own) - 1)
    rows_ = rows_.join(counts, rows_[ident].eqNullSafe(counts["its_id"]) & (rows_[k] == counts["its_draw"]) & (rows_["mix part"] == counts["its_part"]))
    return rows_.withColumn(k, _again(F.col(k), F.col("before") + F.col("mix number"))).select(*rows.columns)


def _bin(v: Column, level: int) -> Column:
    """The bin of a rank value at a level: 0 .. BINS^level - 1, in the values' order."""
    return F.least(F.floor(v / (1 + v) * F.lit(float(BINS**level))), F.lit(BINS**level - 1)).cast("long")


def _cut(rows: DataFrame, by: str) -> DataFrame:
    """Per source: the bin in which the words run out, and the words before it; rows: source, <by>, words, rest."""
    run = Window.partitionBy("source").orderBy(by)
    upto = rows.withColumn("upto", F.sum("words").over(run))
    return upto.where(F.col("upto") > F.col("rest")).groupBy("source").agg(F.min(F.struct(by, (F.col("rest") - F.col("upto") + F.col("words")).alias("left"))).alias("x")).select("source", F.col(f"x.{by}").alias(by), F.col("x.left").alias("left"))


def mix_plan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix", **options) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(measured, plan, repeated): doc_id, source, size, k of every row, kept in the shared folder; one row per source; see _repeated.

    The plan's columns: source, source_size, target, copies, scale, cut (rank of the
    last document drawn: value, k, size; null: none of the bin is drawn), fine (its bin;
    null: all that can be drawn are).
    """
    text, ident = F.col(text_col), F.col(id_col)
    measured = kept(docs.select(ident.alias("doc_id"), F.col(source_col).cast("string").alias("source"), size(text).alias("size"), draw(ident, text, seed).alias("k")), "mix-sizes")
    repeated = _repeated(measured)
    if repeated is not None:
        once, several = _split(measured, repeated, "doc_id", "k")
        measured = kept(once.unionByName(_apart(several, "doc_id", "k")), "mix-draws")
    classes = kept(measured.groupBy("source", size_class(F.col("size")).alias("class")).agg(F.sum("size").alias("words")), "mix-classes")
    sources = kept(source_targets(classes.groupBy("source").agg(F.sum("words").alias("source_size")), **options), "mix-targets")
    scales = _scaled(classes, sources)
    sources = sources.join(scales, F.col("source").eqNullSafe(F.col("scaled")), "left").withColumn("scale", F.coalesce("scale", F.lit(0.0))).drop("scaled")
    sources = kept(sources, "mix-sources")
    near = small(sources)
    v = rank_value(F.col("k"), inclusion(F.col("scale"), F.col("size")))
    drawn = measured.join(near, measured["source"].eqNullSafe(near["source"])).where("scale > 0").select(near["source"].alias("source"), "size", "k", "rest", v.alias("v"))
    # null is a source like others: under a name of its own in what follows
    drawn = drawn.select(F.struct(F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("name")).alias("source"), "size", "k", "rest", "v")
    first = _cut(drawn.groupBy("source", _bin(F.col("v"), 1).alias("bin")).agg(F.sum("size").alias("words"), F.first("rest").alias("rest")), "bin")
    inside = drawn.drop("rest").withColumn("bin", _bin(F.col("v"), 1)).join(small(first), ["source", "bin"]).withColumnRenamed("left", "rest")
    second = _cut(inside.groupBy("source", _bin(F.col("v"), 2).alias("fine")).agg(F.sum("size").alias("words"), F.first("rest").alias("rest")), "fine")
    last = inside.drop("rest").withColumn("fine", _bin(F.col("v"), 2)).join(small(second), ["source", "fine"])
    run = Window.partitionBy("source").orderBy("v", "k", "size").rowsBetween(Window.unboundedPreceding, 0)
    last = last.withColumn("upto", F.sum("size").over(run)).withColumn("taken", F.col("upto") - F.col("size") / 2 <= F.col("left"))
    cuts = last.groupBy("source").agg(F.max(F.when(F.col("taken"), F.struct("v", "k", "size"))).alias("cut"), F.min("fine").alias("fine"))
    cuts = cuts.select(F.when(~F.col("source.none"), F.col("source.name")).alias("cut_source"), "cut", "fine")
    plan = sources.join(small(cuts), F.col("source").eqNullSafe(F.col("cut_source")), "left")
    return measured, kept(plan.select("source", "source_size", "target", "copies", "scale", "cut", "fine"), "mix-plan"), repeated


def copies(plan: DataFrame, k: Column, size_: Column) -> Column:
    """Copies of a row that has its source's plan beside it."""
    v = rank_value(k, inclusion(plan["scale"], size_))
    here = F.struct(v.alias("v"), k.alias("k"), size_.alias("size"))
    drawn = F.when(v.isNull(), False).when(plan["fine"].isNull(), True).when(_bin(v, 2) != plan["fine"], _bin(v, 2) < plan["fine"]).otherwise(F.coalesce(here <= plan["cut"], F.lit(False)))
    return plan["copies"] + drawn.cast("long")


def mix(docs: DataFrame, **options) -> DataFrame:
    """Per row of docs: doc_id, size, source_size, target, copies, taken (words, repeats counted).

    size counts runs of characters other than ASCII white space (null text: 0). A
    source of no words has target 0. Null ids, null sources and ties are rows like
    others; each of repeated rows has a draw of its own. Other columns are ignored; no
    rows give no rows. Every run draws the same.
    """
    measured, plan, _ = mix_plan(docs, **options)
    near = small(plan)
    rows = measured.join(near, measured["source"].eqNullSafe(near["source"]))
    n = copies(near, measured["k"], measured["size"])
    return rows.select("doc_id", "size", "source_size", "target", n.alias("copies"), (n * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix", **options) -> DataFrame:
    """The rows of docs, all columns, each as often as mix() takes it."""
    _, plan, repeated = mix_plan(docs, id_col=id_col, text_col=text_col, source_col=source_col, seed=seed, **options)
    at = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    rows, near = docs.toDF(*at.values()), small(plan)
    rows = rows.withColumns({"doc size": size(F.col(at[text_col])), "doc draw": draw(F.col(at[id_col]), F.col(at[text_col]), seed)})
    if repeated is not None:
        once, several = _split(rows, repeated, at[id_col], "doc draw")
        rows = once.unionByName(_apart(several, at[id_col], "doc draw"))
    rows = rows.join(near, rows[at[source_col]].cast("string").eqNullSafe(near["source"]))
    rows = rows.withColumn("n", copies(near, rows["doc draw"], rows["doc size"]).cast("int")).where("n > 0")
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n")))).select(*at.values()).toDF(*docs.columns)
