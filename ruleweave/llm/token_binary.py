"""Token ids in Simple-8b blocks.

A block holds whole documents and is one binary record, little-endian:

    magic "S8B1", then uint32: documents, ids, words, escapes
    uint32 per document: its ids          (offsets within the block are their running sum)
    uint64 per word: a selector in the top 4 bits, values in the lower 60
    uint32 per escape: position of an id; uint64 per escape: its value

A word's selector names how many values it holds and of how many bits each
(SELECTORS). A value of 2^60 or more is an escape: its place holds 0 and the
value stands in the escape lists, so that decoding stays a few array operations
per selector. Blocks are rows of a Parquet table, written by Spark's committer:
a lost executor or a repeated task leaves no half-written file.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textbuf
from .shared import bare, small, written

#: Fixed values of the code: how many values a word of each selector holds, and bits of each.
SELECTORS = [(240, 0), (120, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60)]
MAGIC = b"S8B1"
BLOCK_IDS = 1 << 16
#: Words whose ids a worker remembers before it starts afresh; bounds its memory, not its results.
REMEMBERED = 1_500_000

#: Words that are encoded together.
JOINED = 128

BLOCK_SCHEMA = "shard int, block int, first long, n_ids long, doc_ids array<long>, record binary"
INDEX_SCHEMA = "shard int, doc_id long, first long, n_tokens long, ids_crc32 long"


def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Simple-8b words of unsigned numbers, with positions and values of escapes."""
    values = values.astype(np.uint64)
    escaped = np.flatnonzero(values >> np.uint64(60))
    escapes = values[escaped]
    values[escaped] = 0
    n = len(values)
    selector = np.full(n, 15, np.uint8)
    # widest[c][i]: bits of the widest of the c values from i on, from windows of powers of two
    widest = {1: np.concatenate((np.frexp(values.astype(np.float64))[1].astype(np.uint8), np.zeros(512, np.uint8)))}
    for c in (2, 4, 8, 16, 32, 64, 128):
        half = widest[c // 2]
        widest[c] = np.maximum(half[: -(c // 2)], half[c // 2 :])
    for k, (count, bits) in reversed(list(enumerate(SELECTORS[:-1]))):
        two = widest[1 << (count.bit_length() - 1)]
        rest = count - (1 << (count.bit_length() - 1))
        selector[np.maximum(two[:n], two[rest : rest + n]) <= bits] = k
    taken = np.array([c for c, _ in SELECTORS])[selector].tolist()
    at, where = 0, []
    while at < n:
        where.append(at)
        at += taken[at]
    where = np.array(where, np.int64)
    chosen = selector[where]
    out = chosen.astype(np.uint64) << np.uint64(60)
    padded = np.concatenate((values, np.zeros(240, np.uint64)))
    for k in np.unique(chosen):
        count, bits = SELECTORS[k]
        rows = np.flatnonzero(chosen == k)
        for j in range(count if bits else 0):
            out[rows] |= padded[where[rows] + j] << np.uint64(bits * j)
    return out, escaped, escapes


def unpack(words: np.ndarray, n: int, escaped: np.ndarray = (), escapes: np.ndarray = ()) -> np.ndarray:
    """The n numbers that pack() has coded."""
    chosen = (words >> np.uint64(60)).astype(np.int64)
    counts = np.array([c for c, _ in SELECTORS])[chosen]
    at = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()), np.uint64)
    for k in np.unique(chosen):
        count, bits = SELECTORS[k]
        if bits:
            rows = np.flatnonzero(chosen == k)
            body, mask = words[rows], np.uint64((1 << bits) - 1)
            for j in range(count):
                out[at[rows] + j] = (body >> np.uint64(bits * j)) & mask
    out = out[:n]
    if len(escaped):
        out[escaped] = escapes
    return out


def block_record(ids: np.ndarray, lengths: np.ndarray) -> bytes:
    body, escaped, escapes = pack(ids)
    head = np.array([len(lengths), len(ids), len(body), len(escaped)], "<u4")
    return MAGIC + head.tobytes() + lengths.astype("<u4").tobytes() + body.astype("<u8").tobytes() + escaped.astype("<u4").tobytes() + escapes.astype("<u8").tobytes()


def block_ids(record: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Ids and ids per document of a record."""
    if record[:4] != MAGIC:
        raise ValueError("not a Simple-8b block")
    docs, n, n_words, n_escapes = np.frombuffer(record, "<u4", 4, 4).tolist()
    at = 20
    lengths = np.frombuffer(record, "<u4", docs, at)
    at += 4 * docs
    body = np.frombuffer(record, "<u8", n_words, at)
    at += 8 * n_words
    escaped = np.frombuffer(record, "<u4", n_escapes, at)
    return unpack(body, n, escaped, np.frombuffer(record, "<u8", n_escapes, at + 4 * n_escapes)), lengths


def _merged(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    """Two sets of columns as one, ordered by the first column."""
    order = np.argsort(np.concatenate((a[0], b[0])), kind="stable")
    return tuple(np.concatenate(x)[order] for x in zip(a, b, strict=True))


class WordEncoder:
    """Ids of whole texts by a tokenizer that drops white space and whose words never span it.

    A text is cut at ASCII white space, and a run of letters is cut from the ASCII
    punctuation after it, where such a tokenizer cuts too; each different piece goes
    to the library once while it is remembered, by two independent hashes. `whole()` is
    the plain way: it is taken for any tokenizer that cuts PROBES otherwise.
    """

    #: Texts that a tokenizer of another kind gives other ids for if they are cut.
    PROBES = ("one two  three", " lead, (trail) ", "It's DON'T; a-b_c", "x.y!? \u00e9t\u00e9, \u00dcber", "tab\tand\nline", "12 3.4 5,6 abc123 <b>", "\u65e5\u672c \u8a9e\u3002 ok")
    SPLIT = bytes(32 if b == 32 or 9 <= b <= 13 else b for b in range(256))
    LETTER = np.array([65 <= b <= 90 or 97 <= b <= 122 for b in range(256)])
    PLAIN_TAIL = np.array([b in b"!\"#$%&()*+,-./:;=?@[\\]^_`{|}~" for b in range(256)])
    FOLD = np.frombuffer(textbuf.LOWER, np.uint8)

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.last = np.zeros(self.tokenizer.get_vocab_size(), bool)  # ids that end a word
        for word, i in self.tokenizer.get_vocab().items():
            self.last[i] = word.endswith("</w>")
        self.cuts = True
        self.forget()
        ids, lengths = self.ids(*textbuf.as_texts(pa.array(self.PROBES)), 0)
        cut = [x[:-1].tolist() for x in np.split(ids, np.cumsum(lengths)[:-1])]
        self.cuts = cut == self.whole(list(self.PROBES))

    def forget(self) -> None:
        """The remembered pieces: hashes in order, with a second hash and their ids' places, as a large and a recent part, and all ids."""
        none = (np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
        self.known = [none, none]
        self.pool = [np.zeros(0, np.uint32)]
        self.pooled = 0

    def recall(self, hashes: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each piece's ids begin in the pool (-1: not remembered) and how many they are."""
        begin, length = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
        for keys, checks, at, n in self.known:
            if len(keys):
                k = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
                same = (keys[k] == hashes) & (checks[k] == second)
                begin[same], length[same] = at[k[same]], n[k[same]]
        return begin, length

    def learn(self, hashes: np.ndarray, second: np.ndarray, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of new pieces begin, and how many they are."""
        ids, length = self.each(texts)
        begin = self.pooled + np.cumsum(length) - length
        self.pool = [np.concatenate((*self.pool, ids))]
        self.pooled = len(self.pool[0])
        self.known[1] = _merged(self.known[1], (hashes, second, begin, length))
        if 4 * len(self.known[1][0]) > len(self.known[0][0]):
            self.known = [_merged(*self.known), tuple(x[:0] for x in self.known[1])]
        return begin, length

    def each(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and how many each has. Words of letters alone go to the library in lines of JOINED: each is one word there, and ends with the id that says so."""
        got: list[list[int]] = [[] for _ in texts]
        words = [i for i, t in enumerate(texts) if t.isalpha()]
        rest = [i for i, t in enumerate(texts) if not t.isalpha()]
        lines = [words[k : k + JOINED] for k in range(0, len(words), JOINED)]
        for line, found in zip(lines, self.tokenizer.encode_batch_fast([" ".join([texts[i] for i in x]) for x in lines], add_special_tokens=False), strict=True):
            ids = found.ids
            stops = (np.flatnonzero(self.last[ids]) + 1).tolist()
            if len(stops) != len(line):  # some letter is no letter to the tokenizer
                rest += line
                continue
            for i, a, b in zip(line, [0, *stops], stops, strict=False):
                got[i] = ids[a:b]
        for i, ids in zip(rest, self.whole([texts[i] for i in rest]), strict=True):
            got[i] = ids
        return np.array([i for x in got for i in x], np.uint32), np.array([len(x) for x in got], np.int64)

    def whole(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _plainly(self, raw: np.ndarray, at: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
        body = raw.tobytes()
        got = self.whole([body[a:b].decode() for a, b in zip(at.tolist(), at[1:].tolist(), strict=False)])
        return np.array([i for x in got for i in (*x, end)], np.uint32), np.array([len(x) + 1 for x in got], np.int64)

    def ids(self, raw: np.ndarray, at: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, `end` after each, and the ids of each text."""
        import pandas as pd

        if not self.cuts:
            return self._plainly(raw, at, end)

        words = textbuf.words(raw, at, self.SPLIT)
        data, starts, ends = words.data, words.starts, words.ends
        # letters, then plain punctuation: cut between them, and fold the letters' case
        letter, tail = self.LETTER[data], self.PLAIN_TAIL[data]
        pair = np.zeros(len(data), bool)  # the second byte of a letter of U+00C0-U+024F but U+0130, whose lower case is two characters
        if len(data) > 1:
            lead, low = data[:-1], data[1:]
            pair[1:] = (lead >= 0xC3) & (lead <= 0xC9) & ~((lead == 0xC3) & ((low == 0x97) | (low == 0xB7))) & ~((lead == 0xC4) & (low == 0xB0))
        core = letter | pair
        core[:-1] |= pair[1:]
        not_core, not_tail = np.zeros(len(data) + 1, np.int32), np.zeros(len(data) + 1, np.int32)
        np.cumsum(~core, out=not_core[1:])
        np.cumsum(~tail, out=not_tail[1:])
        tails = (ends - starts) - (not_core[ends] - not_core[starts])  # bytes of letters
        cut = starts + tails
        simple = (tails > 0) & (not_core[cut] == not_core[starts]) & (not_tail[ends] == not_tail[cut])
        fold = np.zeros(len(data) + 1, np.int8)
        fold[starts[simple]] += 1
        fold[ends[simple]] -= 1
        inside = np.cumsum(fold[:-1], dtype=np.int8).view(bool)
        data = np.where(inside, self.FOLD[data], data)
        two = simple & (cut < ends)
        extra = np.cumsum(two) - two
        slot = np.arange(len(starts)) + extra
        total = len(starts) + int(two.sum())
        s2, e2 = np.empty(total, np.int64), np.empty(total, np.int64)
        s2[slot], e2[slot] = starts, np.where(two, cut, ends)
        s2[slot[two] + 1], e2[slot[two] + 1] = cut[two], ends[two]
        first = np.concatenate((slot, [total]))[words.first]
        parts = textbuf.Words(data, s2, e2, first)
        codes, seen = pd.factorize(parts.hashes())
        spots = np.zeros(len(seen), np.int64)
        spots[codes[::-1]] = np.arange(len(codes))[::-1]
        every = parts.hashes(1)
        second = every[spots]
        if (second[codes] != every).any():  # two pieces with one hash
            return self._plainly(raw, at, end)
        begin, length = self.recall(seen, second)
        fresh = np.flatnonzero(begin < 0)
        if len(fresh):
            if sum(len(x[0]) for x in self.known) + len(fresh) > REMEMBERED:
                self.forget()
                fresh = np.arange(len(seen))
            body = data.tobytes()
            texts = [body[a:b].decode() for a, b in zip(s2[spots[fresh]].tolist(), e2[spots[fresh]].tolist(), strict=True)]
            begin[fresh], length[fresh] = self.learn(seen[fresh], second[fresh], texts)
        pool = np.concatenate((self.pool[0], np.array([end], np.uint32)))
        begin, length = np.concatenate((begin, [len(pool) - 1])), np.concatenate((length, [1]))
        docs = len(at) - 1
        order = np.full(len(codes) + docs, len(begin) - 1, np.int64)
        owner = np.repeat(np.arange(docs), np.diff(first))
        order[np.arange(len(codes)) + owner] = codes
        n = length[order]
        done = np.cumsum(n)
        ids = pool[np.repeat(begin[order] - (done - n), n) + np.arange(int(done[-1]) if len(done) else 0)]
        stops = done[first[1:] + np.arange(docs)] if docs else np.zeros(0, np.int64)
        return ids, np.diff(np.concatenate(([0], stops)))


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _encode(path: str | None, end: int, block_ids_most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder = WordEncoder(path or tokenizer_path())
        shard, block, done = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            for part in textbuf.pieces(batch, "text"):
                ids, lengths = encoder.ids(*textbuf.as_texts(part.column("text")), end)
                doc_ids = part.column("doc_id")
                stops = np.cumsum(lengths)
                begin = at = 0
                rows = []
                while begin < len(lengths):
                    upto = max(begin + 1, int(np.searchsorted(stops, at + block_ids_most, side="right")))
                    n = int(stops[upto - 1]) - at
                    rows.append((shard, block, done, n, doc_ids.slice(begin, upto - begin).to_pylist(), block_record(ids[at : at + n], lengths[begin:upto])))
                    block, done, at, begin = block + 1, done + n, at + n, upto
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary()))], names=["shard", "block", "first", "n_ids", "doc_ids", "record"])

    return run


def write_token_blocks(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = 2, block_ids: int = BLOCK_IDS, path: str | None = None) -> str:
    """Writes token ids of all texts as Simple-8b blocks and returns the folder.

    docs: an id (long) and a text. Shards follow one another in ascending id order
    (null ids first; equal ids by their text's hash), so shard, block and place give the
    order of all ids. Many rows of one id, or of none, are dealt to several tasks. A null or empty text is the end id alone; a text of
    any length stays within one block. No rows: an empty folder with its schema.
    Other columns are ignored. tokenizer: a tokenizer file (each executor must have it).
    """
    rows = bare(docs, doc_id=id_col, text=text_col).withColumns({"hash": F.xxhash64("text"), "place": F.monotonically_increasing_id()})
    rows = rows.repartitionByRange("doc_id", "hash", "place").sortWithinPartitions("doc_id", "hash", "place").select("doc_id", "text")
    out = rows.mapInArrow(_encode(tokenizer, end_id, block_ids), BLOCK_SCHEMA)
    if path is None:
        return written(out, "tokens")
    out.write.parquet(path)
    return path


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(batch.num_rows):
            ids, lengths = block_ids(batch.column("record")[row].as_py())
            body = memoryview(ids.astype("<u4").tobytes())
            stops = np.cumsum(lengths, dtype=np.int64)
            starts = stops - lengths
            crc = [zlib.crc32(body[4 * a : 4 * b]) for a, b in zip(starts.tolist(), stops.tolist(), strict=True)]
            n = len(lengths)
            yield pa.RecordBatch.from_arrays([pa.array([batch.column("shard")[row].as_py()] * n, pa.int32()), batch.column("doc_ids")[row].values, pa.array(starts + batch.column("first")[row].as_py()), pa.array(lengths.astype(np.int64)), pa.array(crc, pa.int64())], names=["shard", "doc_id", "first", "n_tokens", "ids_crc32"])


def read_token_index(spark: SparkSession, path: str) -> DataFrame:
    """One row per document from the files alone: doc_id, start, n_tokens, ids_crc32."""
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(path)
    # one row per shard: running totals of a handful of numbers
    shards = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = shards.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("before"))
    rows = blocks.select("shard", "first", "doc_ids", "record").mapInArrow(_index, INDEX_SCHEMA)
    return rows.join(small(before), "shard").select("doc_id", (F.col("before") + F.col("first")).alias("start"), "n_tokens", "ids_crc32")


def read_token_ids(spark: SparkSession, path: str) -> DataFrame:
    """One row per document from the files: doc_id, ids (array of long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                ids, lengths = block_ids(batch.column("record")[row].as_py())
                offsets = pa.array(np.concatenate(([0], np.cumsum(lengths))).astype(np.int32))
                yield pa.RecordBatch.from_arrays([batch.column("doc_ids")[row].values, pa.ListArray.from_arrays(offsets, pa.array(ids.astype(np.int64)))], names=["doc_id", "ids"])

    return spark.read.schema(BLOCK_SCHEMA).parquet(path).select("doc_ids", "record").mapInArrow(run, "doc_id long, ids array<long>")
