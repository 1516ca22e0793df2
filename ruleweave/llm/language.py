"""Language of a text: the nearest of several centroids per language.

A text is a vector of hashed byte n-grams of its letters (1 to 3 bytes), weighted by
TF-IDF and brought to length 1. Each language's vectors are clustered, and a text
takes the language of the centroid with the largest cosine. A text further from
that centroid than nearly all texts it was learnt from is marked as rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbuf
from .shared import bare, in_small_batches, kept

DIMS = 2048
GRAMS = 3
CLUSTERS = 4
#: Different texts the centroids are learnt from at most, over all languages (chosen by hash; all if there are fewer).
FIT_ROWS = 4000
#: Share of the rows learnt from that lie further from their centroid than its reach.
OUTSIDE = 0.01
#: Hashes are taken modulo this to find the smallest.
_PLACES = 1 << 40
#: Rows that are held as dense vectors at once.
STEP = 1024

#: Letters lower-cased; all other ASCII characters are gaps.
_LETTERS = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in textbuf.LOWER)
_ODD = np.array([2654435761, 2246822519, 3266489917], np.uint32)


def gram_counts(raw: np.ndarray, at: np.ndarray, dims: int = DIMS) -> np.ndarray:
    """Counts of hashed n-grams of each text, docs x dims. Grams span one gap at an end, never a text's edge."""
    docs = len(at) - 1
    data = np.frombuffer(raw.tobytes().translate(_LETTERS), np.uint8)
    owner = np.repeat(np.arange(docs, dtype=np.int64) * (dims + 1), np.diff(at))
    gap = data == 32
    total = np.zeros(docs * (dims + 1), np.int64)
    code = np.zeros(len(data), np.uint32)
    for n in range(GRAMS):
        size = len(data) - n
        if size <= 0:
            break
        code = code[:size] + (data[n:].astype(np.uint32) + np.uint32(1)) * _ODD[n]
        slot = (code ^ (code >> np.uint32(15))) * np.uint32(2246822507)
        slot = (slot >> np.uint32(8)) % np.uint32(dims)
        # a gap alone or inside a gram, or a text's edge inside it: the spare slot
        bad = gap[:size].copy() if n == 0 else (gap[1 : size + 1] if n == 2 else gap[:size] & gap[1 : size + 1])
        if n:
            bad = bad | (owner[:size] != owner[n:])
        total += np.bincount(owner[:size] + np.where(bad, dims, slot), minlength=len(total))
    return total.reshape(docs, dims + 1)[:, :dims]


def has_letter(texts: pa.Array, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether each text has a letter of any script."""
    sums = lambda m: np.concatenate(([0], np.cumsum(m)))
    low = raw | 32
    ascii_letters = np.diff(sums((low >= 97) & (low <= 122))[at])
    out = ascii_letters > 0
    for i in np.flatnonzero(~out & (np.diff(sums(raw >= 128)[at]) > 0)):
        out[i] = any(c.isalpha() for c in texts[int(i)].as_py())
    return out


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray
    language: np.ndarray  # of each centroid
    reach: np.ndarray  # least cosine of each centroid

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        x = np.log1p(counts, dtype=np.float32) * self.idf
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)

    def nearest(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest centroid (ties: the first) and cosine."""
        cosines = self.vectors(counts) @ self.centroids.T
        best = cosines.argmax(1)
        return best, np.clip(cosines[np.arange(len(best)), best], 0, 1)


def _clusters(x: np.ndarray, k: int, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Centroids of length 1 and each row's; starts from rows far from one another."""
    centres = [x[0]]
    while len(centres) < min(k, len(x)):
        centres.append(x[int(np.argmin((x @ np.array(centres).T).max(1)))])
    c = np.array(centres)
    for _ in range(rounds):
        own = (x @ c.T).argmax(1)
        c = np.array([x[own == j].sum(0) if (own == j).any() else c[j] for j in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c, (x @ c.T).argmax(1)


def fit_languages(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", fit_rows: int = FIT_ROWS, clusters: int = CLUSTERS, outside: float = OUTSIDE, dims: int = DIMS) -> Model:
    """Learns from rows with a language and a text: document frequencies from all of them, centroids from fit_rows different texts at most, each once.

    Languages share fit_rows evenly; of more languages than that, the rarest are left out.
    """
    rows = bare(docs, text=text_col, lang=lang_col).where("lang is not null and text is not null")

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(dims, np.int64), 0
        for batch in batches:
            for part in textbuf.pieces(batch, "text"):
                raw, at = textbuf.as_texts(part.column("text"))
                for i in range(0, part.num_rows, STEP):
                    own = at[i : i + STEP + 1]
                    total += (gram_counts(raw[own[0] : own[-1]], own - own[0], dims) > 0).sum(0)
                n += part.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims + 1)), pa.array(np.append(total, n))], names=["slot", "n"])

    frequency = np.zeros(dims + 1, np.int64)
    for slot, n in rows.select("text").mapInArrow(seen, "slot long, n long").groupBy("slot").agg(F.sum("n")).collect():  # dims + 1 rows
        frequency[slot] = n
    idf = (np.log((frequency[-1] + 1) / (frequency[:-1] + 1)) + 1).astype(np.float32)
    # the different texts of a language with the smallest hashes, however often each stands there
    rows = rows.withColumn("hash", F.xxhash64("text", "lang"))
    place = F.pmod("hash", F.lit(_PLACES))
    different = kept(rows.groupBy("lang", "hash").agg(F.count("*").alias("n")).drop("n"), "different-texts")
    sizes = different.groupBy("lang").agg(F.count("*").alias("n"), F.min(place).alias("least")).orderBy(F.desc("n"), "lang").limit(fit_rows).collect()
    each = max(1, fit_rows // max(1, len(sizes)))
    # hashes are evenly spread: up to `most`, twice as many as are taken are expected, and the least one is always there
    bounds = [(r.lang, max(r.least, min(_PLACES, (2 * each + 64) * _PLACES // r.n))) for r in sizes]
    most = docs.sparkSession.createDataFrame(bounds, "lang string, most long")
    first: dict[str, list[tuple[int, int]]] = {}
    for lang, at, h in different.join(F.broadcast(most), "lang").where(place <= F.col("most")).select("lang", place, "hash").collect():  # about 2 fit_rows
        first.setdefault(lang, []).append((at, h))
    chosen = [(lang, h) for lang, found in first.items() for _, h in sorted(found)[:each]]
    sample = rows.join(F.broadcast(docs.sparkSession.createDataFrame(chosen, "lang string, hash long")), ["lang", "hash"], "left_semi").select("text", "lang", "hash")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set[int] = set()  # no more than are chosen
        for batch in batches:
            new = []
            for i, h in enumerate(batch.column("hash").to_pylist()):
                if h not in known:
                    known.add(h)
                    new.append(i)
            for part in textbuf.pieces(batch.take(pa.array(new, pa.int64())), "text"):
                raw, at = textbuf.as_texts(part.column("text"))
                for i in range(0, part.num_rows, STEP):
                    own = at[i : i + STEP + 1]
                    counts = gram_counts(raw[own[0] : own[-1]], own - own[0], dims)
                    yield pa.RecordBatch.from_arrays([part.column("lang").slice(i, STEP), part.column("hash").slice(i, STEP), pa.array([np.minimum(c, 65535).astype("<u2").tobytes() for c in counts])], names=["lang", "hash", "counts"])

    got = sample.mapInArrow(counted, "lang string, hash long, counts binary").groupBy("lang", "hash").agg(F.min("counts").alias("counts")).toArrow()  # fit_rows at most
    langs = np.array(got.column("lang").to_pylist(), object)
    bodies = got.column("counts").to_pylist()
    model = Model(sorted(set(langs)), idf, np.zeros((0, dims), np.float32), np.zeros(0, np.int64), np.zeros(0))
    for k, lang in enumerate(model.languages):
        own = sorted(bodies[i] for i in np.flatnonzero(langs == lang))  # the order of rows doesn't matter
        x = model.vectors(np.array([np.frombuffer(b, "<u2") for b in own]))
        c, mine = _clusters(x, clusters)
        near = (x * c[mine]).sum(1)
        model.centroids = np.vstack((model.centroids, c))
        model.language = np.append(model.language, np.full(len(c), k))
        model.reach = np.append(model.reach, [np.quantile(near[mine == j], outside) if (mine == j).any() else 1.0 for j in range(len(c))])
    return model


def identify_language(docs: DataFrame, model: Model, *, text_col: str = "text") -> DataFrame:
    """docs with lang_pred, score (cosine, 0 to 1) and rejected as last columns.

    lang_pred: `und` (score 0, rejected) for null texts, texts without a letter, and
    where nothing was learnt. Whole texts count. Other columns stay as they are.
    """
    in_small_batches(docs.sparkSession)
    shared_model = docs.sparkSession.sparkContext.broadcast(model)
    text = f"c{docs.columns.index(text_col)}"
    rows = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared_model.value
        names = np.array([*m.languages, "und"], object)
        for batch in batches:
            for part in textbuf.pieces(batch, text):
                raw, at = textbuf.as_texts(part.column(text))
                known = has_letter(part.column(text), raw, at) & bool(m.languages)
                lang, score, out = np.full(part.num_rows, len(m.languages)), np.zeros(part.num_rows), np.ones(part.num_rows, bool)
                for i in range(0, part.num_rows if m.languages else 0, STEP):
                    own = at[i : i + STEP + 1]
                    best, cosine = m.nearest(gram_counts(raw[own[0] : own[-1]], own - own[0], m.centroids.shape[1]))
                    to = slice(i, i + len(best))
                    lang[to], score[to], out[to] = m.language[best], cosine, cosine < m.reach[best]
                lang[~known], score[~known], out[~known] = len(m.languages), 0, True
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(names[lang].tolist(), pa.string()), pa.array(score), pa.array(out)], names=[*part.schema.names, "l", "s", "r"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{schema}, l string, s double, r boolean").toDF(*docs.columns, "lang_pred", "score", "rejected")
