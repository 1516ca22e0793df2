"""Near-copies among documents: MinHash by one-permutation hashing, exact in what it confirms.

Documents with equal shingle sets form a class, and classes are compared. A class has
one signature (one permutation, optimal densification), cut into bands; classes
that agree in a band share a bucket. In each bucket the class with the most
bucket mates over all bands is the centre of a star, and only links to the centre
are confirmed on full sets: pairs grow with the members of buckets, not with
their squares. Where a bucket then still holds several groups, its members outside
the centre's group are compared with the others in blocks of bounded size, so
that no link between members of a bucket is lost, but for those that signatures
estimate more than SLACK too low.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textbuf
from .components import components
from .shared import bare, kept, small
from .shingles import binaries, fingerprints, one_permutation, shingle_sets

BINS = 128
#: Rows of a band, and bands: at similarity 0.85 a pair shares no bucket with a chance below 1e-6.
BAND_ROWS = 5
#: Members of a bucket that are compared at once in what the stars leave over.
SCREEN_ROWS, CONFIRM_ROWS = 1024, 512
#: How far below the threshold a signature's estimate may lie: a pair at 0.85 lies lower with a chance of 1.4e-8, at 0.80 of 2.1e-7.
SLACK = 0.2

SIGNED = "doc_id long, text_hash long, n long, node binary, bands array<long>, sig binary"


def _sets(part: pa.RecordBatch, table: bytes, words: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    done = 0
    for shingles, begin in shingle_sets(*textbuf.as_texts(part.column("text")), table, words):
        yield part.slice(done, len(begin) - 1), shingles, begin
        done += len(begin) - 1


def _signatures(table: bytes, words: int, rows: int):
    bands = BINS // rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in textbuf.pieces(batch, "text"):
                for rows_, shingles, begin in _sets(part, table, words):
                    sig, node = one_permutation(shingles, begin, BINS), binaries(fingerprints(shingles, begin))
                    keys = np.zeros((len(sig), bands), np.uint64)
                    for j in range(rows):
                        keys = textbuf.mix(keys + sig[:, j : bands * rows : rows] + np.uint64(j))
                    keys = textbuf.mix(keys + np.arange(bands, dtype=np.uint64)).view(np.int64)
                    small_sig = (textbuf.mix(sig) & np.uint64(255)).astype(np.uint8)
                    offsets = pa.array((np.arange(len(sig) + 1) * bands).astype(np.int32))
                    yield pa.RecordBatch.from_arrays([rows_.column("doc_id"), rows_.column("text_hash"), pa.array(np.diff(begin)), node, pa.ListArray.from_arrays(offsets, pa.array(keys.ravel())), binaries(small_sig)], names=["doc_id", "text_hash", "n", "node", "bands", "sig"])

    return run


def _estimate(matches: np.ndarray) -> np.ndarray:
    """Similarity by equal bytes of two signatures; unequal bins agree in a byte once in 256."""
    return (matches / BINS - 1 / 256) / (1 - 1 / 256)


def _all_sets(table: bytes, words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in textbuf.pieces(batch, "text"):
                for _, shingles, begin in _sets(part, table, words):
                    body, at = shingles.tobytes(), (begin * 8).tolist()
                    yield pa.RecordBatch.from_arrays([binaries(fingerprints(shingles, begin)), pa.array([body[a:b] for a, b in zip(at, at[1:], strict=False)], pa.binary())], names=["node", "shingles"])

    return run


def _linked(shared_: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, threshold: tuple[int, int]) -> np.ndarray:
    return threshold[1] * shared_ >= threshold[0] * (n_a + n_b - shared_)


def _confirmed(threshold: tuple[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column("left"), batch.column("right")
            good = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                x, y = np.frombuffer(a[i].as_buffer(), "<u8"), np.frombuffer(b[i].as_buffer(), "<u8")
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                good[i] = _linked(np.count_nonzero(y[at] == x), len(x), len(y), threshold)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(good))

    return run


def _numbered(column: pa.ChunkedArray) -> np.ndarray:
    """Numbers that are equal where the column's values are."""
    return column.combine_chunks().dictionary_encode().indices.to_numpy()


def _matrix(column: pa.ChunkedArray, kind: str, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), width)


def _block_pairs(table: pa.Table, threshold: tuple[int, int], rows: int) -> Iterator[tuple[int, np.ndarray]]:
    """In a block of a bucket: each outside member's row and the rows it may be linked with and meets in no earlier band."""
    side = table.column("outside").to_numpy()
    comp, n = _numbered(table.column("comp")), table.column("n").to_numpy()
    sig = _matrix(table.column("sig"), "u1", BINS)
    bands = table.column("bands").combine_chunks().flatten().to_numpy().reshape(len(sig), -1)
    here = int(np.flatnonzero(bands[0] == table.column("key")[0].as_py())[0])
    least = threshold[0] / threshold[1]
    others = np.flatnonzero(~side)
    for i in np.flatnonzero(side):
        able = others[(comp[others] != comp[i]) & (np.minimum(n[others], n[i]) >= least * np.maximum(n[others], n[i]))]
        able = able[_estimate((sig[able] == sig[i]).sum(1)) >= least - SLACK]
        able = able[(bands[able, :here] != bands[i, :here]).all(1)]
        yield int(i), able


def _screened(threshold: tuple[int, int], rows: int):
    """The members of a block that have a partner to be confirmed."""

    def run(table: pa.Table) -> pa.Table:
        found = np.zeros(table.num_rows, bool)
        for i, able in _block_pairs(table, threshold, rows):
            found[able] = True
            found[i] |= bool(len(able))
        return table.select(["key", "node"]).filter(pa.array(found))

    return run


def _block_links(threshold: tuple[int, int], rows: int):
    """Links of a block's outside members, one to each group."""

    def run(table: pa.Table) -> pa.Table:
        sets = [np.frombuffer(s, "<u8") for s in table.column("shingles").to_pylist()]
        sizes = np.array([len(s) for s in sets])
        comp, node = _numbered(table.column("comp")), table.column("node").to_pylist()
        out = []
        for i, able in _block_pairs(table, threshold, rows):
            for part in np.array_split(able, -(-int(sizes[able].sum()) // (1 << 20)) or 1) if len(able) else ():
                flat = np.concatenate([sets[j] for j in part])
                at = np.minimum(np.searchsorted(sets[i], flat), sizes[i] - 1)
                begin = np.cumsum(sizes[part]) - sizes[part]
                shared_ = np.add.reduceat((sets[i][at] == flat).astype(np.int64), begin)
                good = part[_linked(shared_, sizes[i], sizes[part], threshold)]
                out += [(node[i], node[j]) for j in good[np.unique(comp[good], return_index=True)[1]]]
        return pa.table({"a": pa.array([x for x, _ in out], pa.binary()), "b": pa.array([y for _, y in out], pa.binary())})

    return run


def _dealt(members: DataFrame, most: int) -> DataFrame:
    """Members of buckets in blocks: outside members (of the first kind) against all (of the second), most of each in a block."""
    of = lambda n: F.greatest(F.lit(1), F.ceil(F.col(n) / most)).cast("int")
    place = lambda n: F.pmod(F.xxhash64("node"), of(n)).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), of(n) - 1))
    outside = members.where("is_outside").withColumns({"outside": F.lit(True), "block_a": place("n_outside"), "block_b": F.lit(0)}).drop("block_b").withColumn("block_b", upto("n_all"))
    everyone = members.withColumns({"outside": F.lit(False), "block_b": place("n_all")}).withColumn("block_a", upto("n_outside"))
    return outside.unionByName(everyone)


def near_classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", table: bytes = textbuf.BLANK_SEPARATED, words: int = 5, threshold: tuple[int, int] = (80, 100), band_rows: int = 4) -> tuple[DataFrame, DataFrame]:
    """(signed, classes): every row with its set's fingerprint; every class with its component (a label) where it has links."""
    texts = bare(docs, doc_id=id_col, text=text_col)
    signed = kept(texts.withColumn("text_hash", F.xxhash64("text")).mapInArrow(_signatures(table, words, band_rows), SIGNED), "signed")
    classes = kept(signed.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("sig").alias("sig")), "classes")
    member = classes.select("node", F.explode("bands").alias("key"))
    full = kept(member.groupBy("key").agg(F.count("*").alias("members")).where("members > 1"), "buckets")
    member = kept(member.join(full, "key"), "members")
    mates = kept(member.groupBy("node").agg(F.sum(F.col("members") - 1).alias("mates")), "mates")
    ranked = kept(member.join(mates, "node"), "ranked")
    centres = kept(ranked.groupBy("key").agg(F.max(F.struct("mates", "node")).alias("x")).select("key", F.col("x.node").alias("centre")), "centres")
    starred = kept(ranked.join(centres, "key").select("key", "node", "centre"), "starred")
    pairs = starred.where("node <> centre").select(F.col("node").alias("a"), F.col("centre").alias("b")).distinct()

    def side(name: str) -> DataFrame:
        return classes.select(F.col("node").alias(name), F.col("n").alias(f"n_{name}"), F.col("sig").alias(f"sig_{name}"), F.col("doc_id").alias(f"id_{name}"))

    pairs = pairs.join(side("a"), "a").join(side("b"), "b").where(threshold[1] * F.least("n_a", "n_b") >= threshold[0] * F.greatest("n_a", "n_b"))
    pairs = kept(pairs.mapInArrow(_likely(threshold), "a binary, b binary, id_a long, id_b long"), "pairs")

    def sets_of(needed: DataFrame) -> DataFrame:
        """node, shingles of the classes in needed (node, doc_id), from the documents' whole texts."""
        ids = small(needed.select(F.col("doc_id").alias("needed")).distinct())
        some = texts.join(ids, texts["doc_id"].eqNullSafe(F.col("needed")), "left_semi")
        rows = some.mapInArrow(_all_sets(table, words), "node binary, shingles binary")
        return kept(rows.join(needed.select("node").distinct(), "node", "left_semi"), "sets")

    sets = sets_of(pairs.select(F.col("a").alias("node"), F.col("id_a").alias("doc_id")).union(pairs.select("b", "id_b")).distinct())
    both = pairs.select("a", "b").join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("left")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("right")), "b")
    links = kept(both.mapInArrow(_confirmed(threshold), "a binary, b binary"), "confirmed")
    labels = components(links)

    # what the stars leave: buckets with members outside the centre's group
    label = lambda name: labels.select(F.col("node").alias(name), F.col("label").alias(f"{name}_label"))
    grouped = starred.join(label("node"), "node", "left").join(label("centre"), "centre", "left")
    grouped = kept(grouped.select("key", "node", F.coalesce("node_label", "node").alias("comp"), (F.coalesce("node_label", "node") != F.coalesce("centre_label", "centre")).alias("is_outside")), "grouped")
    open_ = kept(grouped.groupBy("key").agg(F.sum(F.col("is_outside").cast("long")).alias("n_outside"), F.count("*").alias("n_all")).where("n_outside > 0"), "open")
    info = classes.select("node", "n", "bands", "sig", "doc_id")
    inside = kept(grouped.join(open_, "key").join(info, "node"), "inside")
    screened = _dealt(inside.drop("doc_id"), SCREEN_ROWS).groupBy("key", "block_a", "block_b").applyInArrow(_screened(threshold, band_rows), "key long, node binary")
    left = kept(inside.join(screened.distinct(), ["key", "node"], "left_semi"), "left")
    sizes = kept(left.groupBy("key").agg(F.sum(F.col("is_outside").cast("long")).alias("n_outside"), F.count("*").alias("n_all")), "left-sizes")
    again = sets_of(left.select("node", "doc_id").distinct())
    rest = left.drop("n_outside", "n_all", "doc_id").join(sizes, "key").join(again, "node")
    more = kept(_dealt(rest, CONFIRM_ROWS).groupBy("key", "block_a", "block_b").applyInArrow(_block_links(threshold, band_rows), "a binary, b binary"), "more")
    if not more.isEmpty():
        labels = components(links.union(more))
    return signed, classes.select("node", "doc_id").join(labels, "node", "left")


def _likely(threshold: tuple[int, int]):
    """Pairs whose signatures leave the threshold possible."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                same = (_matrix(batch.column("sig_a"), "u1", BINS) == _matrix(batch.column("sig_b"), "u1", BINS)).sum(1)
                good = _estimate(same) >= threshold[0] / threshold[1] - SLACK
                yield batch.select(["a", "b", "id_a", "id_b"]).filter(pa.array(good))

    return run


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id, kept.

    Words are runs of characters other than ASCII white space, A-Z lower-cased, and a
    text's set is its distinct shingles of `words` words (all its words, if fewer).
    Texts whose sets' intersection is at least threshold[0] / threshold[1] of their
    union are linked; component_id is the smallest doc_id reachable, kept says that
    it is the row's own. Null and empty texts have no shingles and no links. A row
    without an id is linked like others; it never names a component, and is kept if
    no linked row has an id. Repeated rows are linked as equal texts. Other columns
    are ignored. options: id_col, text_col, table, words, threshold, band_rows.
    """
    signed, classes = near_classes(docs, **options)
    named = kept(classes.withColumn("label", F.coalesce("label", "node")), "named")
    first = kept(named.groupBy("label").agg(F.min("doc_id").alias("component")), "first")
    found = kept(named.join(first, "label").select("node", "component"), "found")
    own = F.when(signed["n"] > 0, F.col("component")).otherwise(F.col("doc_id"))
    rows = signed.select("doc_id", "n", "node").join(found, "node", "left")
    return rows.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"), F.coalesce(F.col("doc_id") == own, own.isNull()).alias("kept"))


def deduplicated(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs, all columns, one of each group of near-copies: the one with the smallest id (null ids last).

    Of repeated rows one stays; rows without shingles all stay. See near_duplicates.
    """
    signed, classes = near_classes(docs, id_col=id_col, text_col=text_col, **options)
    labels = kept(classes.select("node", F.coalesce("label", "node").alias("label")), "class-labels")
    rows = kept(signed.where("n > 0").join(labels, "node").select("doc_id", "text_hash", "label"), "row-labels")
    best = kept(rows.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("best")), "best")
    of_best = (F.col("doc_id").eqNullSafe(F.col("best.doc_id"))) & (F.col("text_hash") == F.col("best.text_hash"))
    gone = kept(rows.join(best, "label").where(~of_best).select("doc_id", "text_hash").distinct(), "gone")
    same = kept(rows.groupBy("doc_id", "text_hash").count().where("count > 1").select("doc_id", "text_hash"), "repeated")
    at = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    out = docs.toDF(*at.values()).withColumn("text hash", F.xxhash64(at[text_col]))

    def matched(df: DataFrame, keys: DataFrame, how: str) -> DataFrame:
        keys = small(keys)
        return df.join(keys, df[at[id_col]].eqNullSafe(keys["doc_id"]) & (df["text hash"] == keys["text_hash"]), how)

    out = matched(out, gone, "left_anti")
    if not same.isEmpty():
        out = matched(out, same, "left_anti").union(matched(out, same, "left_semi").dropDuplicates([at[id_col], "text hash"]))
    return out.select(*at.values()).toDF(*docs.columns)
