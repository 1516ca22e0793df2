"""Words of a whole Arrow batch of texts at once, on its UTF-8 bytes.

The word patterns used here separate words by ASCII characters only, so a byte
of 0x80 and above always belongs to a word, and cutting bytes cuts no character.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: What lower-casing A-Z does to a byte.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Words of `[^\x20\x09-\x0D]+`, lower-cased.
BLANK_SEPARATED = bytes(32 if b == 32 or 9 <= b <= 13 else LOWER[b] for b in range(256))
#: Words of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after lower-casing.
ALNUM = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in LOWER)

#: Bytes of text that are worked on together: numbers of a position take many times its byte.
PIECE = 1 << 18
#: Words of more bytes than this are hashed one by one.
LONG = 128
_STEP = np.uint64(0x9E3779B97F4A7C15)
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (wraps on purpose)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def as_texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, end to end, and each text's first and last offset (null: empty)."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_string()).fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


@dataclass
class Words:
    """Words of a batch: where each starts and ends, and the first word of each text."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def hashes(self, seed: int = 0) -> np.ndarray:
        """A 64-bit hash of each word's bytes, the same in every batch; other seeds give independent ones.

        Eight bytes at a time are taken up and mixed, so that words that differ in one
        of these steps differ in the end but for chance, whatever their bytes are.
        """
        sizes = self.ends - self.starts
        out = mix(sizes.astype(np.uint64) + np.uint64(seed) * _STEP)
        padded = np.concatenate((self.data, np.zeros(8, np.uint8)))
        lanes = np.ndarray(len(padded) - 7, "<u8", padded, strides=(1,))
        short = sizes <= LONG
        at = slice(None) if short.all() else np.flatnonzero(short)
        first, left = self.starts[at], sizes[at]
        while len(first):
            out[at] = mix(out[at] + (lanes[first] & _MASKS[np.minimum(left, 8)]) * _STEP)
            more = np.flatnonzero(left > 8)
            at = more if isinstance(at, slice) else at[more]
            first, left = first[more] + 8, left[more] - 8
        for i in np.flatnonzero(~short).tolist():
            out[i] = xxhash.xxh3_64_intdigest(memoryview(self.data[self.starts[i] : self.ends[i]]), seed)
        return out


def words(raw: np.ndarray, at: np.ndarray, table: bytes) -> Words:
    """Words of the texts raw[at[i]:at[i+1]]; table maps separators to a space."""
    data = np.frombuffer(raw.tobytes().translate(table), np.uint8)
    inside = np.empty(len(data) + 2, bool)
    inside[0] = inside[-1] = False
    np.not_equal(data, 32, out=inside[1:-1])
    begins = inside[1:] & ~inside[:-1]
    stops = inside[:-1] & ~inside[1:]
    edge = at[1:-1]
    edge = edge[(edge > 0) & (edge < len(data))]
    edge = edge[inside[edge] & inside[edge + 1]]
    begins[edge] = True
    stops[edge] = True
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops)
    return Words(data, starts, ends, np.searchsorted(starts, at))


def spaced(found: Words) -> tuple[np.ndarray, np.ndarray]:
    """The words end to end, a space after each, and where each begins (then the end)."""
    sizes = found.ends - found.starts
    at = np.concatenate(([0], np.cumsum(sizes + 1)))
    flat = np.full(int(at[-1]), 32, np.uint8)
    inside = np.zeros(len(found.data) + 1, np.int8)
    inside[found.starts] += 1
    inside[found.ends] -= 1
    put = np.ones(len(flat), bool)
    put[at[1:] - 1] = False
    flat[put] = found.data[np.cumsum(inside[:-1], dtype=np.int8).view(bool)]
    return flat, at


def pieces(batch: pa.RecordBatch, column: str, most: int = PIECE):
    """The batch cut into runs of rows with about `most` bytes of text each (a longer text is a run of its own)."""
    lengths = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), np.int64)
    begin = 0
    while begin < batch.num_rows:
        total = np.cumsum(lengths[begin:])
        n = max(1, int(np.searchsorted(total, most, side="right")))
        yield batch.slice(begin, n)
        begin += n
