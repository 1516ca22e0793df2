"""Benchmark passages in training documents, by suffix arrays over shards of the documents.

Each run of documents of about SHARD_BYTES is a shard. All its word positions are
sorted by the words that follow (a suffix array, by prefix doubling, to the depth that a
search can look). Every benchmark suffix is binary-searched in it word by word, which
leaves the interval of all places where its first `window` words stand. Hits are counted
by intervals, never by pairs of a place and a window; for the matches themselves only
pairs are made that can't be extended to the left, and these are extended to the right.
The documents are read once and never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbuf
from .shared import bare, in_small_batches, written

WINDOW = 10
SHARD_BYTES = 2 << 20
#: Benchmark text that is sent to the executors at once; a larger benchmark is searched block by block.
BLOCK_BYTES = 4 << 20

MATCH = "struct<item_id: string, doc_start: int, item_start: int, length: int>"
HITS = "doc_id long, n_words long, n_hit long, items array<string>"
MATCHES = f"doc_id long, n_words long, n_hit long, matches array<{MATCH}>"


@dataclass
class Block:
    """A block of the benchmark: hashes of its words, all items end to end, and where each item begins (then the end)."""

    names: np.ndarray
    hashes: np.ndarray
    begin: np.ndarray
    window: int

    @property
    def suffixes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Items, first words and lengths of all windows: `window` words, or a whole item of fewer."""
        counts = np.diff(self.begin)
        n = np.where(counts >= self.window, counts - self.window + 1, np.minimum(counts, 1))
        item = np.repeat(np.arange(len(counts)), n)
        start = self.begin[item] + np.arange(int(n.sum())) - (np.cumsum(n) - n)[item]
        return item, start, np.minimum(counts[item], self.window)


def block(names: list[str], texts: list[str], window: int = WINDOW) -> Block:
    found = textbuf.words(*textbuf.as_texts(pa.array(texts, pa.large_string())), textbuf.ALNUM)
    return Block(np.array(names, object), found.hashes(), found.first, window)


class Shard:
    """Documents, their words as numbers from 1 on, and the suffix array."""

    def __init__(self, texts: pa.Array, depth: int = WINDOW):
        self.found = textbuf.words(*textbuf.as_texts(texts), textbuf.ALNUM)
        self.n = len(self.found.starts)
        self.vocabulary, ids = np.unique(self.found.hashes(), return_inverse=True)
        self.ids = np.append(ids + 1, 0)
        self.room = self.found.first[1:][self.found.owner] - np.arange(self.n)  # words to the end of the document
        rank, step = self.ids[:-1], 1
        order = np.argsort(rank)
        while step < depth and self.n:
            behind = np.zeros(self.n, np.int64)
            reach = np.flatnonzero(self.room > step)
            behind[reach] = rank[reach + step]
            key = rank * (self.n + 1) + behind
            order = np.argsort(key)
            key = key[order]
            rank = np.empty(self.n, np.int64)
            rank[order] = np.cumsum(np.append(1, key[1:] != key[:-1]))
            step *= 2
        self.order = order

    def numbered(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of words here, 0 for words that the shard doesn't have."""
        if not len(self.vocabulary):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at + 1, 0)

    def _word(self, place: np.ndarray, k: int) -> np.ndarray:
        """The k-th word of the suffixes at places of the order, 0 beyond the document."""
        p = self.order[place]
        return np.where(self.room[p] > k, self.ids[np.minimum(p + k, self.n)], 0)

    def _bound(self, low: np.ndarray, high: np.ndarray, word: np.ndarray, k: int, right: bool) -> np.ndarray:
        """Binary search in each interval, whose suffixes share k words, for where the next word begins or ends."""
        low, high = low.copy(), high.copy()
        while len(at := np.flatnonzero(low < high)):
            middle = (low[at] + high[at]) >> 1
            here = self._word(middle, k)
            below = here <= word[at] if right else here < word[at]
            low[at[below]] = middle[below] + 1
            high[at[~below]] = middle[~below]
        return low

    def search(self, words: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Suffixes of words (numbers of this shard) that stand here: which, and their intervals of the order."""
        left = np.arange(len(start)) if self.n else np.zeros(0, np.int64)
        low, high = np.zeros(len(left), np.int64), np.full(len(left), self.n)
        for k in range(int(length.max(initial=0))):
            at = np.flatnonzero(length[left] > k)
            word = words[start[left[at]] + k]
            able = word > 0
            low[at[~able]] = high[at[~able]] = 0
            at, word = at[able], word[able]
            high_ = self._bound(low[at], high[at], word, k, True)
            low[at], high[at] = self._bound(low[at], high[at], word, k, False), high_
            good = low < high
            left, low, high = left[good], low[good], high[good]
        return left, low, high


def _distinct(*columns: np.ndarray) -> np.ndarray:
    """The first row of each different one."""
    return np.unique(np.column_stack(columns), axis=0, return_index=True)[1] if len(columns[0]) else np.zeros(0, np.int64)


def _spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For counts of 2 and 3: rows 0 0 1 1 1 and steps 0 1 0 1 2."""
    row = np.repeat(np.arange(len(counts)), counts)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)


def _pairs_by_class(item: np.ndarray, of_item: np.ndarray, doc: np.ndarray, of_doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different (document, item) with a class in common; classes that stand for the same sets (a longer passage) count once."""
    n = int(max(of_item.max(initial=-1), of_doc.max(initial=-1))) + 1
    sets = np.zeros((n, 2), np.uint64)
    np.add.at(sets[:, 0], of_item, textbuf.mix(item.astype(np.uint64) + np.uint64(1)))
    np.add.at(sets[:, 1], of_doc, textbuf.mix(doc.astype(np.uint64) + np.uint64(1)))
    chosen = np.zeros(n, bool)
    chosen[_distinct(sets[:, 0], sets[:, 1])] = True
    item, of_item = item[chosen[of_item]], of_item[chosen[of_item]]
    doc, of_doc = doc[chosen[of_doc]], of_doc[chosen[of_doc]]
    order = np.argsort(of_item, kind="stable")
    first = np.searchsorted(of_item[order], of_doc, "left")
    row, step = _spread(np.searchsorted(of_item[order], of_doc, "right") - first)
    docs, items = doc[row], item[order][first[row] + step]
    once = _distinct(docs, items)
    return docs[once], items[once]


def shard_hits(texts: pa.Array, blocks) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words of each document, hit words of each, and different pairs of a document and an item's name); blocks: one at a time."""
    shard: Shard | None = None
    names, docs = [np.zeros(0, object)], [np.zeros(0, np.int64)]
    for x in blocks:
        if shard is None:
            shard = Shard(texts, x.window)
            cover = np.zeros(shard.n + 1, np.int64)
        item, start, length = x.suffixes
        which, low, high = shard.search(shard.numbered(x.hashes), start, length)
        # a class: an interval of a length; intervals of one length are equal or apart
        rows, of = np.unique(np.column_stack((length[which], low, high)), axis=0, return_inverse=True) if len(which) else (np.zeros((0, 3), np.int64), np.zeros(0, np.int64))
        row, step = _spread(rows[:, 2] - rows[:, 1])
        place = shard.order[rows[row, 1] + step]
        np.add.at(cover, place, 1)
        np.add.at(cover, place + rows[row, 0], -1)
        once = _distinct(item[which], of)
        doc = shard.found.owner[place]
        each = _distinct(doc, row)
        d, i = _pairs_by_class(item[which][once], of[once], doc[each], row[each])
        docs.append(d)
        names.append(x.names[i])
    hit = np.concatenate(([0], np.cumsum(np.cumsum(cover[:-1]) > 0)))
    return shard.found.counts.astype(np.int64), np.diff(hit[shard.found.first]), np.concatenate(docs), np.concatenate(names)


def shard_matches(texts: pa.Array, blocks) -> tuple[np.ndarray, ...]:
    """Longest verbatim matches: document, item's name, first word in each, and words."""
    shard: Shard | None = None
    out: list[tuple[np.ndarray, ...]] = []
    for x in blocks:
        shard = shard or Shard(texts, x.window)
        words = np.append(shard.numbered(x.hashes), 0)
        item, start, length = x.suffixes
        which, low, high = shard.search(words, start, length)
        item, start, length = item[which], start[which], length[which]
        # a match that goes on to the left is found from there: 0 stands for an edge or a word the shard doesn't have, which nothing goes beyond
        before = np.where((start > x.begin[item]) & (length == x.window), words[start - 1], 0)
        rows, of = np.unique(np.column_stack((length, low, high)), axis=0, return_inverse=True) if len(which) else (np.zeros((0, 3), np.int64), np.zeros(0, np.int64))
        row, step = _spread(rows[:, 2] - rows[:, 1])
        place = shard.order[rows[row, 1] + step]
        inner = place > shard.found.first[:-1][shard.found.owner[place]]
        previous = np.where(inner, shard.ids[place - 1], 0)
        order = np.lexsort((before, of))
        wide = np.int64(len(shard.vocabulary) + 2)
        key = (of * wide + before)[order]
        ends = np.searchsorted(key, np.arange(len(rows) + 1) * wide)
        same = np.where(previous > 0, np.searchsorted(key, row * wide + previous, "left"), ends[row + 1])
        after = np.where(previous > 0, np.searchsorted(key, row * wide + previous, "right"), ends[row + 1])
        parts = []
        for a, b in ((ends[row], same), (after, ends[row + 1])):
            r, step = _spread(b - a)
            parts.append((place[r], order[a[r] + step]))
        p, w = (np.concatenate(c) for c in zip(*parts, strict=True))
        size = length[w].astype(np.int64)
        full = size == x.window
        most = np.where(full, np.minimum(shard.room[p], x.begin[item[w] + 1] - start[w]), size)
        open_ = np.flatnonzero(size < most)
        while len(open_):
            open_ = open_[shard.ids[p[open_] + size[open_]] == words[start[w[open_]] + size[open_]]]
            size[open_] += 1
            open_ = open_[size[open_] < most[open_]]
        doc = shard.found.owner[p]
        out.append((doc, x.names[item[w]], p - shard.found.first[doc], start[w] - x.begin[item[w]], size))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


class Blocks:
    """The benchmark as broadcast blocks of bounded size, loaded one at a time; equal rows are one."""

    def __init__(self, benchmark: DataFrame, item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES):
        spark = benchmark.sparkSession
        in_small_batches(spark)
        items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("name"), F.col(item_text_col).alias("text")).where("text is not null").distinct()
        size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        n = max(1, -(-size // block_bytes))
        if n > 1:  # one folder for each block, so that each row is read once
            path = f"{written(items.limit(0), 'benchmark')}-blocks"
            items.withColumn("block", F.pmod(F.xxhash64("name", "text"), F.lit(n)).cast("int")).repartition("block").write.partitionBy("block").parquet(path)
            items = spark.read.schema("name string, text string, block int").parquet(path)
        self.parts = []
        for b in range(n):  # each is bounded by block_bytes, give or take an item
            rows = (items.where(F.col("block") == b) if n > 1 else items).select("name", "text").collect()
            self.parts.append(spark.sparkContext.broadcast(block([r[0] for r in rows], [r[1] for r in rows], window)))

    def __iter__(self) -> Iterator[Block]:
        for part in self.parts:
            yield part.value
            if len(self.parts) > 1:
                vars(part).pop("_value", None)  # it is read again from the worker's local copy


def _sorted_by_doc(doc: np.ndarray, n: int, *then: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """The order of rows by document (then by other columns, the last one first), and offsets of n documents."""
    order = np.lexsort((*then, doc))
    return order, pa.array(np.searchsorted(doc[order], np.arange(n + 1)).astype(np.int32))


def contamination(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES, **options) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256 (of the sorted item ids, comma-joined), contaminated, items.

    Words are runs of ASCII letters and digits and of characters beyond ASCII, A-Z
    lower-cased. A window is `window` consecutive words of an item, or all words of an
    item of fewer; n_hit counts words inside any window that stands in the document.
    Null and empty texts have no words and match nothing, on either side; an item with
    a null id counts under the empty name; equal items are one, repeated documents
    each count. Documents of any length are searched whole. An empty benchmark matches
    nothing. Other columns are ignored. options: item_col, item_text_col, window, block_bytes.
    """
    blocks = Blocks(benchmark, **options)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in textbuf.pieces(batch, "text", shard_bytes):
                words, hit, doc, name = shard_hits(part.column("text"), blocks)
                once = _distinct(doc, np.unique(name.astype(str), return_inverse=True)[1]) if len(doc) else np.zeros(0, np.int64)
                doc, name = doc[once], name[once]
                order, offsets = _sorted_by_doc(doc, part.num_rows, name.astype(str))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(words), pa.array(hit), pa.ListArray.from_arrays(offsets, pa.array(name[order].tolist(), pa.string()))], names=["doc_id", "n_words", "n_hit", "items"])

    found = bare(docs, doc_id=id_col, text=text_col).mapInArrow(run, HITS)
    items = F.array_sort("items")
    return found.select("doc_id", "n_words", "n_hit", F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), items.alias("items"))


def benchmark_matches(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES, **options) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, matches (item, places and length in words).

    A match is a longest run of `window` or more words that a document and an item
    share, or a whole item of fewer words. Else as contamination().
    """
    blocks = Blocks(benchmark, **options)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in textbuf.pieces(batch, "text", shard_bytes):
                words, hit, *_ = shard_hits(part.column("text"), blocks)
                doc, name, place, start, length = shard_matches(part.column("text"), blocks)
                order, offsets = _sorted_by_doc(doc, part.num_rows, start, name.astype(str), place)
                kinds = [pa.field("item_id", pa.string()), pa.field("doc_start", pa.int32()), pa.field("item_start", pa.int32()), pa.field("length", pa.int32())]
                values = pa.StructArray.from_arrays([pa.array(c[order].tolist(), f.type) for c, f in zip((name, place, start, length), kinds, strict=True)], fields=kinds)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(words), pa.array(hit), pa.ListArray.from_arrays(offsets, values)], names=["doc_id", "n_words", "n_hit", "matches"])

    return bare(docs, doc_id=id_col, text=text_col).mapInArrow(run, MATCHES)


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", shard_bytes: int = SHARD_BYTES, **options) -> DataFrame:
    """The rows of docs, all columns, whose text holds no benchmark match (see contamination)."""
    blocks, text = Blocks(benchmark, **options), f"c{docs.columns.index(text_col)}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in textbuf.pieces(batch, text, shard_bytes):
                yield part.filter(pa.array(shard_hits(part.column(text), blocks)[1] == 0))

    rows = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    return rows.mapInArrow(run, rows.schema).toDF(*docs.columns)
