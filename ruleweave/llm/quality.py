"""Text quality by a generalised additive model with pairwise interactions.

A text is described by a few numbers. Boosting goes round the features in turn; each
time a shallow tree over one feature's bins corrects the model a little, and all
trees of a feature add up to one lookup table. Pairs that explain most of what is
left then get tables of their own in the same way. A score is the sum of one entry
of each table, so that a batch is scored by array look-ups and additions.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbuf
from .shared import bare, in_small_batches

#: Labelled rows the model is fitted on at most, about (chosen by hash; all if there are fewer).
FIT_ROWS = 20_000
BINS = 48
PAIR_BINS = 12
ROUNDS = 120
PAIRS = 6
RATE = 0.1

#: Byte classes.
_CLASSES = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": b"abcdefghijklmnopqrstuvwxyz", "digit": b"0123456789", "blank": b" \t\x0b\x0c\r", "line": b"\n", "stop": b".,;:?", "loud": b"!", "symbol": b"#$%&*@^~=+<>", "bar": b"|\\/_", "quote": b"\"'`()[]{}-"}
_CLASS = np.zeros(256, np.uint8)
for _k, _v in enumerate(_CLASSES.values()):
    _CLASS[list(_v)] = _k + 1
_CLASS[128:] = len(_CLASSES) + 1
_N = len(_CLASSES) + 2

FEATURES = ("log_bytes", "upper", "digit", "blank", "line", "stop", "loud", "symbol", "bar", "quote", "beyond_ascii", "word_length", "distinct_words", "repeated_lines", "log_longest_word", "words_per_line")


def features(texts: pa.Array) -> np.ndarray:
    """One row of FEATURES for each text; a null or empty text is all zeros."""
    raw, at = textbuf.as_texts(texts)
    docs, sizes = len(at) - 1, np.diff(at)
    owner = np.repeat(np.arange(docs, dtype=np.int32), sizes)
    counts = np.bincount(owner * _N + _CLASS[raw], minlength=docs * _N).reshape(docs, _N)
    share = counts / np.maximum(sizes, 1)[:, None]
    names = list(_CLASSES)
    share = {n: share[:, names.index(n) + 1] for n in names} | {"beyond_ascii": share[:, -1]}
    letters = counts[:, 1] + counts[:, 2]

    def distinct(found: textbuf.Words) -> np.ndarray:
        own = found.owner
        key = textbuf.mix(found.hashes() + textbuf.mix(own.astype(np.uint64)))
        _, first = np.unique(key, return_index=True)
        return np.bincount(own[first], minlength=docs) / np.maximum(found.counts, 1)

    words = textbuf.words(raw, at, textbuf.BLANK_SEPARATED)
    lines = textbuf.words(raw, at, _LINES)
    lengths = words.ends - words.starts
    longest = np.zeros(docs, np.int64)
    np.maximum.at(longest, words.owner, lengths)
    mean = np.bincount(words.owner, weights=lengths, minlength=docs) / np.maximum(words.counts, 1)
    return np.column_stack((np.log1p(sizes), counts[:, 1] / np.maximum(letters, 1), *(share[n] for n in FEATURES[2:11]), mean, distinct(words), np.where(lines.counts > 0, 1 - distinct(lines), 0), np.log1p(longest), np.log1p(words.counts / np.maximum(lines.counts, 1))))


#: Lines as words: separated by line ends only.
_LINES = bytes(32 if b == 10 else (1 if b == 32 else b) for b in range(256))


@dataclass
class Model:
    """score = 1 / (1 + exp(-(bias + sum of table entries)))."""

    bias: float
    cuts: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_cuts: list[np.ndarray]
    pair_tables: list[np.ndarray]

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.bias)
        for j, (cuts, table) in enumerate(zip(self.cuts, self.tables, strict=True)):
            total += table[np.searchsorted(cuts, x[:, j], side="right")]
        for (a, b), table in zip(self.pairs, self.pair_tables, strict=True):
            total += table[np.searchsorted(self.pair_cuts[a], x[:, a], side="right"), np.searchsorted(self.pair_cuts[b], x[:, b], side="right")]
        return 1 / (1 + np.exp(-np.clip(total, -500, 500)))


def _cuts(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.zeros(0)


def _tree(g: np.ndarray, h: np.ndarray, leaves: int = 3, ridge: float = 1.0) -> np.ndarray:
    """Values of a tree of a few leaves over ordered bins, by sums of gradients and curvatures."""
    spans = [(0, len(g))]
    cg, ch = np.concatenate(([0], np.cumsum(g))), np.concatenate(([0], np.cumsum(h)))
    gain_of = lambda a, b: (cg[b] - cg[a]) ** 2 / (ch[b] - ch[a] + ridge)
    while len(spans) < leaves:
        best = (1e-9, None, 0)
        for k, (a, b) in enumerate(spans):
            if b - a > 1:
                m = np.arange(a + 1, b)
                gain = gain_of(a, m) + gain_of(m, b) - gain_of(a, b)
                top = int(np.argmax(gain))
                best = max(best, (float(gain[top]), k, int(m[top])), key=lambda z: z[0])
        if best[1] is None:
            break
        a, b = spans[best[1]]
        spans[best[1] : best[1] + 1] = [(a, best[2]), (best[2], b)]
    out = np.zeros(len(g))
    for a, b in spans:
        out[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + ridge)
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray, ridge: float = 1.0) -> tuple[float, np.ndarray]:
    """The best tree of one cut on each side of a table: its gain and values."""
    grid = lambda m: np.pad(m.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    cg, ch = grid(g), grid(h)
    i, j = np.arange(1, g.shape[0])[:, None], np.arange(1, g.shape[1])[None, :]
    if not i.size or not j.size:
        return 0.0, np.zeros_like(g)

    def quarters(c: np.ndarray) -> list[np.ndarray]:
        a, left, top, everything = c[i, j], c[i, -1], c[-1, j], c[-1, -1]
        return [a, left - a, top - a, everything - left - top + a]

    gain = sum(x**2 / (y + ridge) for x, y in zip(quarters(cg), quarters(ch), strict=True))
    at = np.unravel_index(int(np.argmax(gain)), gain.shape)
    r, c = at[0] + 1, at[1] + 1
    out = np.zeros_like(g, dtype=float)
    for rows in (slice(0, r), slice(r, None)):
        for cols in (slice(0, c), slice(c, None)):
            out[rows, cols] = g[rows, cols].sum() / (h[rows, cols].sum() + ridge)
    return float(gain[at]), out


def fit(x: np.ndarray, y: np.ndarray, *, bins: int = BINS, pair_bins: int = PAIR_BINS, rounds: int = ROUNDS, pairs: int = PAIRS, rate: float = RATE) -> Model:
    """Boosts tables of single features in turn, then of the pairs that gain most. No rows: a constant of 0.5."""
    n, m = x.shape
    mean = (y.sum() + 1) / (n + 2)
    bias = float(np.log(mean / (1 - mean)))
    cuts, pair_cuts = [_cuts(x[:, j], bins) for j in range(m)], [_cuts(x[:, j], pair_bins) for j in range(m)]
    place = [np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(cuts)]
    coarse = [np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(pair_cuts)]
    tables = [np.zeros(len(c) + 1) for c in cuts]
    total = np.full(n, bias)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for j in range(m):
            g, h = slopes()
            step = rate * _tree(np.bincount(place[j], g, len(tables[j])), np.bincount(place[j], h, len(tables[j])))
            tables[j] += step
            total += step[place[j]]

    def sums(a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        g, h = slopes()
        shape = (len(pair_cuts[a]) + 1, len(pair_cuts[b]) + 1)
        at = coarse[a] * shape[1] + coarse[b]
        return np.bincount(at, g, shape[0] * shape[1]).reshape(shape), np.bincount(at, h, shape[0] * shape[1]).reshape(shape)

    chosen = sorted(((_pair_tree(*sums(a, b))[0], a, b) for a in range(m) for b in range(a)), reverse=True)[:pairs]
    chosen = [(a, b) for _, a, b in chosen]
    pair_tables = [np.zeros((len(pair_cuts[a]) + 1, len(pair_cuts[b]) + 1)) for a, b in chosen]
    for _ in range(rounds // 2):
        for k, (a, b) in enumerate(chosen):
            step = rate * _pair_tree(*sums(a, b))[1]
            pair_tables[k] += step
            total += step[coarse[a], coarse[b]]
    return Model(bias, cuts, tables, chosen, pair_cuts, pair_tables)


def fit_quality(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", fit_rows: int = FIT_ROWS, **options) -> Model:
    """A model of label_col (0 or 1; other rows are left out) from texts alone.

    Of more than fit_rows different pairs of id and label, about fit_rows are taken by a
    hash, the same in every run. A document with several labels counts with each; of
    rows with one id, one counts for each label.
    """
    marked = bare(labels, id=id_col, y=label_col).where(F.col("y").isin(0, 1) & F.col("id").isNotNull()).distinct()
    n = marked.count()
    if n > fit_rows:
        marked = marked.where(F.pmod(F.xxhash64("id", "y"), F.lit(1 << 40)) < int((1 << 40) * fit_rows / n))
    rows = bare(docs, id=id_col, text=text_col).join(F.broadcast(marked), "id").select("id", "text", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in textbuf.pieces(batch, "text"):
                x = features(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("y"), *(pa.array(c) for c in x.T)], names=["id", "y", *FEATURES])

    ident = f"id {rows.schema['id'].dataType.simpleString()}, y double"
    described = rows.withColumn("y", F.col("y").cast("double")).select("id", "text", "y").mapInArrow(run, ", ".join([ident, *(f"{c} double" for c in FEATURES)]))
    got = described.groupBy("id", "y").agg(F.max(F.struct(*FEATURES)).alias("x")).select("x.*", "y").toArrow()  # about fit_rows
    table = np.column_stack([got.column(c).to_numpy() for c in (*FEATURES, "y")])
    table = table[np.lexsort(table.T)]  # sums don't depend on the order of rows
    return fit(table[:, :-1], table[:, -1], **options)


def _scored(docs: DataFrame, model: Model, text_col: str) -> DataFrame:
    """The columns of docs as c0, c1, ..., and s, the score."""
    in_small_batches(docs.sparkSession)
    shared_model = docs.sparkSession.sparkContext.broadcast(model)
    text = f"c{docs.columns.index(text_col)}"
    rows = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in textbuf.pieces(batch, text):
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(shared_model.value.score(features(part.column(text))))], names=[*part.schema.names, "s"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{schema}, s double")


def score_quality(docs: DataFrame, model: Model, *, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """docs with a score column: how likely label 1 is, from 0 to 1.

    Whole texts are scored; a null text scores as an empty one. All columns stay as
    they are, also if they share names with ours; score_col comes last.
    """
    return _scored(docs, model, text_col).toDF(*docs.columns, score_col)


def good_quality(docs: DataFrame, model: Model, *, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, that score `least` or more."""
    return _scored(docs, model, text_col).where(F.col("s") >= least).drop("s").toDF(*docs.columns)
