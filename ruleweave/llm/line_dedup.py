"""Near-equal lines across documents.

Lines are normalised and equal ones taken together. Different lines are compared by
SimHash in BLOCKS blocks: a word votes, once a line, on the bits of the one block that
its hash names, so that a changed word leaves all blocks but two as they are. Pairs of
equal blocks are the keys of buckets (pigeonhole: with up to BLOCKS - 2 blocks changed,
two are still equal). Lines of a bucket are compared by edit similarity, but for those
that are connected already; of each connected group of lines one occurrence is kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbuf
from .components import components
from .shared import bare, dropped, kept, matching, parted, small
from .shingles import binaries

#: Blocks of a signature, of 16 bits each.
BLOCKS = 5
#: Different words that a pair of blocks must stand for to be a key.
KEY_WORDS = 2
SIMILARITY = 0.8
#: Rows and bytes of a bucket that are held at once; a larger bucket is dealt out by pairs of such parts.
BUCKET_ROWS, BUCKET_BYTES = 8192, 32 << 20
#: Sorted rows, and bytes of them, that are looked at together.
HELD_ROWS, HELD_BYTES = 20_000, 16 << 20

#: Lines as words of a text: separated by line feeds alone (an inner space must not separate).
_AS_LINES = bytes(32 if b == 10 else (1 if b == 32 else b) for b in range(256))
_PAIRS = list(combinations(range(BLOCKS), 2))
#: Bits of a word's hash that are sorted, below its line's and its block's number; lines that are voted on together.
_HASH_BITS, _VOTING = 41, 1 << 19

#: Hashed pairs of characters that are counted; an edit changes two of a line's pairs at most.
SLOTS = 256
#: Words on both sides that are looked at for where two lines go on alike.
AHEAD = 16

def _lines(raw: np.ndarray, at: np.ndarray) -> tuple[textbuf.Words, textbuf.Words, np.ndarray]:
    """Lines that are not empty, their words, and the first word of each line (then the end)."""
    lines = textbuf.words(raw, at, _AS_LINES)
    words = textbuf.words(raw, at, textbuf.ALNUM)
    return lines, words, np.searchsorted(words.starts, np.append(lines.starts, len(raw) + 1))


def _line_hashes(hashes: np.ndarray, first: np.ndarray, seed: int = 0) -> np.ndarray:
    """A hash of each line's words in order; other seeds give independent ones."""
    place = np.arange(len(hashes)) - np.repeat(first[:-1], np.diff(first)) if len(hashes) else np.zeros(0, np.int64)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(textbuf.mix(hashes + textbuf.mix(place.astype(np.uint64) + np.uint64(seed << 48))), dtype=np.uint64)))
    return (total[first[1:]] - total[first[:-1]]).view(np.int64)


def simhash(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """16 bits of each block of each line, lines x BLOCKS (for each bit, what most of the block's different words have; a tie: 0), and the blocks' words."""
    n = len(first) - 1
    bits, counts = np.zeros((n, BLOCKS), np.uint16), np.zeros((n, BLOCKS), np.int64)
    for i in range(0, n, _VOTING):
        own = first[i : i + _VOTING + 1]
        part = hashes[own[0] : own[-1]]
        line = np.repeat(np.arange(len(own) - 1, dtype=np.uint64), np.diff(own))
        block = (part >> np.uint64(_HASH_BITS)) % np.uint64(BLOCKS)
        votes = np.sort((line << np.uint64(_HASH_BITS + 3)) | (block << np.uint64(_HASH_BITS)) | (part & np.uint64((1 << _HASH_BITS) - 1)))
        votes = votes[np.append(True, votes[1:] != votes[:-1])] if len(votes) else votes
        slot = (votes >> np.uint64(_HASH_BITS)).astype(np.int64)
        begin = np.flatnonzero(np.diff(slot, prepend=-1))
        size = np.diff(np.append(begin, len(slot)))
        to = i + (slot[begin] >> 3), slot[begin] & 7
        counts[to] = size
        if len(begin):
            each = np.unpackbits(votes.astype("<u2").view(np.uint8).reshape(-1, 2), axis=1, bitorder="little")
            most = 2 * np.add.reduceat(each, begin, axis=0, dtype=np.int32) > size[:, None]
            bits[to] = np.packbits(most, axis=1, bitorder="little").view("<u2").ravel()
    return bits, counts


def _packed(bits: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Signatures as two numbers: four blocks, and the others with the blocks' words (up to KEY_WORDS) above them."""
    two = np.zeros((2, len(bits)), np.uint64)
    for k in range(BLOCKS):
        two[k // 4] |= bits[:, k].astype(np.uint64) << np.uint64(16 * (k % 4))
        two[1] |= np.minimum(counts[:, k], KEY_WORDS).astype(np.uint64) << np.uint64(32 + 2 * k)
    return two[0].view(np.int64), two[1].view(np.int64)


def _unpacked(sim: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values of all keys, rows x keys, and whether each is one."""
    two = (sim.view(np.uint64), rest.view(np.uint64))
    bits = [(two[k // 4] >> np.uint64(16 * (k % 4))) & np.uint64(0xFFFF) for k in range(BLOCKS)]
    counts = [(two[1] >> np.uint64(32 + 2 * k)) & np.uint64(3) for k in range(BLOCKS)]
    values = np.column_stack([bits[i] << np.uint64(16) | bits[j] for i, j in _PAIRS])
    return values, np.column_stack([counts[i] + counts[j] >= KEY_WORDS for i, j in _PAIRS])


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in textbuf.pieces(batch, "text"):
            lines, words, first = _lines(*textbuf.as_texts(part.column("text")))
            hashes, owner = words.hashes(), lines.owner
            good = np.flatnonzero(np.diff(first) > 0)
            number = np.arange(len(owner)) - lines.first[owner]
            mine = pa.array(owner[good])
            columns = (number.astype(np.int32), _line_hashes(hashes, first), _line_hashes(hashes, first, 1), *_packed(*simhash(hashes, first)))
            yield pa.RecordBatch.from_arrays([part.column("doc_id").take(mine), part.column("text_hash").take(mine), *(pa.array(c[good]) for c in columns)], names=["doc_id", "text_hash", "number", "a", "b", "sim", "rest"])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The different lines of documents, with their normalised texts."""
    for batch in batches:
        for part in textbuf.pieces(batch, "text"):
            _, words, first = _lines(*textbuf.as_texts(part.column("text")))
            hashes = words.hashes()
            a = _line_hashes(hashes, first)
            _, once = np.unique(a, return_index=True)
            once = once[np.diff(first)[once] > 0]
            body, at = textbuf.spaced(words)
            norm = pa.LargeStringArray.from_buffers(len(first) - 1, pa.py_buffer(at[first].astype(np.int64)), pa.py_buffer(body))
            norm = pc.utf8_rtrim(norm.take(pa.array(once)).cast(pa.string()), " ")
            yield pa.RecordBatch.from_arrays([pa.array(a[once]), pa.array(_line_hashes(hashes, first, 1)[once]), norm], names=["a", "b", "norm"])


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each line under all its keys."""
    for batch in batches:
        values, good = _unpacked(batch.column("sim").to_numpy(), batch.column("rest").to_numpy())
        keys = textbuf.mix(values | np.arange(len(_PAIRS), dtype=np.uint64) << np.uint64(32)).view(np.int64)
        lines = np.repeat(batch.column("a").to_numpy(), good.sum(1))
        yield pa.RecordBatch.from_arrays([pa.array(keys[good]), pa.array(lines)], names=["key", "a"])


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by key, those whose key stands more than once."""
    last: pa.RecordBatch | None = None  # the last row, and whether the one before has its key
    follows = False
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([last, batch] if last is not None else [batch]).combine_chunks().to_batches()[0]
        key = rows.column("key").to_numpy()
        same = np.concatenate(([follows], key[1:] == key[:-1], [False]))
        good = same[:-1] | same[1:]
        good[-1] = False
        yield rows.filter(pa.array(good))
        last, follows = rows.slice(len(key) - 1), bool(same[len(key) - 1])
    if last is not None and follows:
        yield last


def _runs(table: pa.Table) -> np.ndarray:
    """The number of each row's block; rows come block after block."""
    changes = np.zeros(table.num_rows, bool)
    for c in ("key", "x", "y"):
        column = table.column(c).to_numpy()
        changes[1:] |= column[1:] != column[:-1]
    return np.cumsum(changes)


def _whole_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Sorted batches, about HELD_ROWS or HELD_BYTES at a time and cut so that no block is split; no more than that and a block are held."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        for i in range(0, batch.num_rows, 1024):
            held.append(batch.slice(i, 1024))
            if sum(b.num_rows for b in held) >= HELD_ROWS or sum(b.get_total_buffer_size() * b.num_rows // max(1, batch.num_rows) for b in held) >= HELD_BYTES:
                table = pa.Table.from_batches(held).combine_chunks()
                run = _runs(table)
                last = int(np.searchsorted(run, run[-1]))
                if last:
                    yield table.slice(0, last)
                held = table.slice(last).to_batches()
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _pairs_of_letters(norm: list[str]) -> np.ndarray:
    """How often each text has each hashed pair of characters, up to 255: texts x SLOTS."""
    out = np.zeros((len(norm), SLOTS), np.uint8)
    for i in range(0, len(norm), 1024):
        part = norm[i : i + 1024]
        codes = np.frombuffer("".join(part).encode("utf-32-le"), "<u4")
        owner = np.repeat(np.arange(len(part)), [len(x) for x in part])
        inner = owner[1:] == owner[:-1]
        slot = ((codes[:-1] * np.uint32(0x9E3779B1) + codes[1:]) * np.uint32(0x85EBCA6B)) >> np.uint32(24)
        counts = np.bincount(owner[1:][inner] * SLOTS + slot[inner], minlength=len(part) * SLOTS)
        out[i : i + 1024] = np.minimum(counts, 255).reshape(-1, SLOTS)
    return out


def _links(similarity: float):
    """Verified links of blocks; lines that are already connected in what is at hand need no more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_blocks(batches):
            table = table.sort_by([("key", "ascending"), ("x", "ascending"), ("y", "ascending"), ("size", "ascending")]).combine_chunks()
            size, block, part = table.column("size").to_numpy(), _runs(table), table.column("part").to_numpy()
            of_two = table.column("x").to_numpy() != table.column("y").to_numpy()
            values, good = _unpacked(table.column("sim").to_numpy(), table.column("rest").to_numpy())
            key = table.column("key").to_numpy().view(np.uint64)
            here = (textbuf.mix(values | np.arange(len(_PAIRS), dtype=np.uint64) << np.uint64(32)) == key[:, None]).argmax(1)
            norm, nodes = table.column("norm").to_pylist(), np.column_stack((table.column("a").to_numpy(), table.column("b").to_numpy()))
            _, line = np.unique(nodes, axis=0, return_inverse=True)
            letters, most = _pairs_of_letters(norm), _edits(similarity, size)
            top, out = np.arange(int(line.max(initial=-1)) + 1), []

            def root(n: int, top: np.ndarray = top) -> int:
                while top[n] != n:
                    top[n] = top[top[n]]
                    n = top[n]
                return int(n)

            at = np.arange(table.num_rows)
            for d in range(1, table.num_rows):
                at = at[at + d < table.num_rows]
                at = at[block[at] == block[at + d]]
                if not len(at):
                    break
                # sizes ascend within a block: who is too short for this one is too short for all that follow
                at = at[size[at + d] - size[at] <= _edits(similarity, size[at + d])]
                able = at[~of_two[at] | (part[at] != part[at + d])]
                earlier = (values[able] == values[able + d]) & good[able] & good[able + d]
                able = able[earlier.argmax(1) == here[able]]
                while (up := top[top]).tobytes() != top.tobytes():
                    top[:] = up
                able = able[top[line[able]] != top[line[able + d]]]
                for k in range(0, len(able), 2048):
                    some = able[k : k + 2048]
                    apart = letters[some].astype(np.int16) - letters[some + d]
                    least = np.maximum(np.maximum(apart, 0).sum(1), np.maximum(-apart, 0).sum(1))
                    for i in some[least <= 2 * most[some + d]].tolist():
                        a, b = root(line[i]), root(line[i + d])
                        if a != b and alike(norm[i], norm[i + d], similarity):
                            top[max(a, b)] = min(a, b)
                            out.append((i, i + d))
            ends = np.array(out, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([binaries(nodes[ends[:, 0]]), binaries(nodes[ends[:, 1]])], names=["a", "b"])

    return run


def _halves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes and labels as the two numbers that each is made of."""
    for batch in batches:
        columns = [np.frombuffer(b"".join(batch.column(c).to_pylist()), np.int64).reshape(-1, 2).T for c in ("node", "label")]
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for two in columns for c in two], names=["a", "b", "to_a", "to_b"])


def _word_edits(a: list[str], b: list[str], most: int) -> int:
    """Edits that turn one line into another word by word: a bound from above; more than most, if it gives up.

    Where words differ, both lines go on at the nearest place where two words (or the last ones) are the same again.
    """
    i = j = total = 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            i, j = i + 1, j + 1
            continue
        for far in range(1, AHEAD):
            x = next((x for x in range(far + 1) if a[i + x : i + x + 2] == b[j + far - x : j + far - x + 2]), None)
            if x is not None:
                break
        else:
            return most + 1
        total += max(sum(map(len, a[i : i + x])) + x, sum(map(len, b[j : j + far - x])) + far - x)
        if total > most:
            return total
        i, j = i + x, j + far - x
    return total + max(sum(map(len, a[i:])) + len(a) - i, sum(map(len, b[j:])) + len(b) - j)


def _edits(similarity: float, longest: np.ndarray) -> np.ndarray:
    """How many edits lines of so many characters, the longer one's, may be apart."""
    return ((1 - similarity) * longest + 1e-9).astype(np.int64)


def alike(a: str, b: str, similarity: float) -> bool:
    """Whether 1 - edits / the longer one's characters is at least similarity."""
    most = int(_edits(similarity, np.asarray(max(len(a), len(b)))))
    return _word_edits(a.split(" "), b.split(" "), most) <= most or distance(a, b, most) <= most


def distance(a: str, b: str, most: int) -> int:
    """Edit distance (insert, delete, replace), by bit vectors over the shorter text; most + 1 if it is more than most."""
    if len(a) > len(b):
        a, b = b, a
    i, j = 0, 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    while j < len(a) - i and a[-1 - j] == b[-1 - j]:
        j += 1
    a, b = a[i : len(a) - j], b[i : len(b) - j]
    if len(b) - len(a) > most or not a:
        return min(len(b), most + 1)
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full, last = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, score = full, 0, len(a)
    step = max(64, len(b) // 8)
    for begin in range(0, len(b), step):
        for c in b[begin : begin + step]:
            eq = at.get(c, 0)
            x = eq | down
            d = ((((x & up) + up) ^ up) | x) & full
            plus, minus = (down | ~(d | up)) & full, up & d
            score += bool(plus & last) - bool(minus & last)
            plus, minus = (plus << 1 | 1) & full, (minus << 1) & full
            up, down = (minus | ~(d | plus)) & full, plus & d
        if begin + step < len(b) and _least(up, down, begin + step, len(a), len(b)) > most:
            return most + 1
    return min(score, most + 1)


def _least(up: int, down: int, done: int, short: int, long: int) -> int:
    """The least edits of any way through the column after `done` characters; up, down: the column's steps."""
    steps = [np.unpackbits(np.frombuffer(x.to_bytes(-(-short // 8), "little"), np.uint8), count=short, bitorder="little").astype(np.int32) for x in (up, down)]
    column = done + np.concatenate(([0], np.cumsum(steps[0] - steps[1])))
    return int((column + np.abs(short - np.arange(short + 1) - (long - done))).min())


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, gone = batch.column("text").to_pylist(), batch.column("gone").to_pylist()
        total, dropped = [], []
        for i, (text, numbers) in enumerate(zip(texts, gone, strict=True)):
            lines = (text or "").split("\n")
            full = [k for k, x in enumerate(lines) if x]
            total.append(len(full))
            dropped.append(len(numbers or ()))
            if numbers:
                away = {full[k] for k in numbers}
                texts[i] = "\n".join(x for k, x in enumerate(lines) if k not in away)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(total, pa.int64()), pa.array(dropped, pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "n_lines", "n_dropped", "text"])


def _texts_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return bare(docs, doc_id=id_col, text=text_col).withColumn("text_hash", F.xxhash64("text"))


def line_groups(texts: DataFrame, similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """(occurrences, groups): every line with words, by document; for each line that stands twice or is linked, the line that stands for its group.

    texts: doc_id, text, text_hash.
    """
    seen = kept(texts.mapInArrow(_occurrences, "doc_id long, text_hash long, number int, a long, b long, sim long, rest long"), "lines")
    lines = kept(seen.groupBy("a", "b").agg(F.first("sim").alias("sim"), F.first("rest").alias("rest"), F.count("*").alias("n")), "different-lines")
    keys = lines.select("a", "sim", "rest").mapInArrow(_keys, "key long, a long")
    near = kept(keys.repartition("key").sortWithinPartitions("key").mapInArrow(_together, "key long, a long"), "near-lines")
    needed = kept(near.select("a").distinct(), "needed-lines")
    norms = matching(texts.select("text").mapInArrow(_texts, "a long, b long, norm string"), needed, "a").groupBy("a", "b").agg(F.min("norm").alias("norm"))
    norms = norms.join(matching(lines, needed, "a").select("a", "b", "sim", "rest"), ["a", "b"])
    norms = kept(norms.withColumn("size", F.length("norm")), "norms")
    dropped(needed)
    # a large bucket: every pair of its parts is compared by itself
    sizes = near.join(norms.select("a", F.octet_length("norm").alias("bytes")), "a").groupBy("key").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    parts = F.greatest(F.ceil(F.col("n") / BUCKET_ROWS), F.ceil(F.col("bytes") / BUCKET_BYTES)).cast("int")
    large = kept(sizes.select("key", parts.alias("parts")).where("parts > 1"), "large-buckets")
    dealt = near.join(small(large), "key", "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("part", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("key", "a", F.least("part", "other").alias("x"), F.greatest("part", "other").alias("y"), "part")
    links = dealt.join(norms, "a").repartition("key", "x", "y").sortWithinPartitions("key", "x", "y").mapInArrow(_links(similarity), "a binary, b binary")
    links = kept(links, "line-links")
    dropped(near, norms, large)
    labels = kept(components(links).mapInArrow(_halves, "a long, b long, to_a long, to_b long"), "line-labels")
    several = lines.where("n > 1").select("a", "b").join(small(labels), ["a", "b"], "left_anti")
    groups = kept(labels.union(several.select("a", "b", "a", "b")), "line-groups")
    dropped(links, labels, lines)
    return seen, groups


def deduplicated_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """Per row: doc_id, n_lines, n_dropped, text without the lines whose group has an earlier occurrence.

    A line is normalised to its words of ASCII letters, digits and characters beyond
    ASCII, A-Z lower-cased, single-spaced. Lines equal in that form are linked, and so
    are lines that agree in two blocks of their signatures and are at least
    `similarity` alike (1 - edits / the longer one's characters); of a connected group
    the occurrence with the smallest doc_id (null last) and line stays. n_lines counts
    lines that are not empty; lines without words always stay. Null texts stay null;
    rows repeated in id and text are one document and lose the same lines; other
    columns are ignored.
    """
    texts = _texts_of(docs, id_col, text_col)
    seen, groups = line_groups(texts, similarity)
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash", "number")
    several, _ = parted(seen.select("a", "b", "doc_id", "text_hash", "number"), groups, "a")
    named = kept(several.join(groups, ["a", "b"]).select("to_a", "to_b", place.alias("place")), "named-lines")
    dropped(seen, groups)
    best = kept(named.groupBy("to_a", "to_b").agg(F.min("place").alias("best")), "best-lines")
    gone = named.join(best, ["to_a", "to_b"]).where(F.col("place") != F.col("best")).groupBy("place.doc_id", "place.text_hash").agg(F.sort_array(F.collect_set("place.number")).alias("gone"))
    gone = kept(gone, "gone-lines")
    dropped(named, best)
    some, others = parted(texts, gone, "text_hash")
    gone = gone.toDF("its_id", "its_hash", "gone")
    some = some.join(gone, some["doc_id"].eqNullSafe(gone["its_id"]) & (some["text_hash"] == gone["its_hash"]), "left")
    rows = some.select("doc_id", "text", "gone").union(others.select("doc_id", "text", F.lit(None).cast("array<int>")))
    return rows.mapInArrow(_without, "doc_id long, n_lines long, n_dropped long, text string")
