"""Sets of word shingles, and their signatures by one-permutation hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from . import textbuf

#: Texts that are worked on together.
STEP = 4096


def shingle_sets(raw: np.ndarray, at: np.ndarray, table: bytes, words: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For runs of STEP texts: all distinct shingles as 64-bit hashes, text after text and in order, and where each text's begin.

    A text of fewer words than a shingle has is one shingle; a text without words has none.
    """
    for i in range(0, len(at) - 1, STEP):
        own = at[i : i + STEP + 1]
        found = textbuf.words(raw[own[0] : own[-1]], own - own[0], table)
        hashes, counts, owner = found.hashes(), found.counts, found.owner
        short = counts < words
        starts = np.flatnonzero((found.first[1:][owner] - np.arange(len(owner)) >= words) | (short[owner] & (np.arange(len(owner)) == found.first[:-1][owner])))
        doc = owner[starts]
        length = np.minimum(counts[doc], words)
        code = np.zeros(len(starts), np.uint64)
        for j in range(words):
            use = length > j
            code[use] = textbuf.mix(code[use] + hashes[starts[use] + j] + np.uint64(j + 1))
        begin = np.searchsorted(doc, np.arange(len(own)))
        for a, b in zip(begin.tolist(), begin[1:].tolist(), strict=False):
            code[a:b].sort()
        new = np.ones(len(code), bool)
        new[1:] = (code[1:] != code[:-1]) | (doc[1:] != doc[:-1])
        yield code[new], np.concatenate(([0], np.cumsum(new)))[begin]


def one_permutation(shingles: np.ndarray, begin: np.ndarray, bins: int) -> np.ndarray:
    """Signatures, texts x bins (a power of two): the least shingle of each bin of one permutation.

    A bin that no shingle fell into takes the value of another, chosen by hashing the
    bin's number again and again until a filled one is met (optimal densification).
    Texts without shingles have 0 everywhere.
    """
    docs = len(begin) - 1
    out, filled = np.zeros((docs, bins), np.uint64), np.zeros((docs, bins), bool)
    owner = np.repeat(np.arange(docs), np.diff(begin))
    slot = owner * bins + (shingles >> np.uint64(65 - bins.bit_length())).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], slot[1:] != slot[:-1]))) if len(slot) else np.zeros(0, np.int64)
    out.reshape(-1)[slot[first]] = shingles[first]  # in order within a text, so a bin's first is its least
    filled.reshape(-1)[slot[first]] = True
    row, col = np.nonzero(~filled & filled.any(1)[:, None])
    attempt = 0
    while len(row):
        attempt += 1
        other = (textbuf.mix(col.astype(np.uint64) + np.uint64(attempt << 20)) % np.uint64(bins)).astype(np.int64)
        good = filled[row, other]
        out[row[good], col[good]] = out[row[good], other[good]]
        row, col = row[~good], col[~good]
    return out


def fingerprints(shingles: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """128 bits of each text's set, texts x 2: equal sets have equal ones."""
    out = []
    for seed in (1, 2):
        values = textbuf.mix(textbuf.mix(shingles) + textbuf.mix(np.full(1, seed, np.uint64)))
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)))
        out.append(total[begin[1:]] - total[begin[:-1]])
    return np.column_stack(out)


def binaries(rows: np.ndarray) -> pa.Array:
    """Each row of a matrix as one binary value."""
    rows = np.ascontiguousarray(rows)
    width = rows.shape[1] * rows.itemsize
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer((np.arange(len(rows) + 1) * width).astype(np.int32)), pa.py_buffer(rows)])
