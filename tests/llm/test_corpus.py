"""Operators over whole tables, against plain versions and SQL."""

import glob
import itertools
import math
import os
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ruleweave.llm import components, decontaminate, exact_search, language, line_dedup, near_dedup, quality, source_mix, textbuf
from ruleweave.llm.queries import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.001"


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def same_rows(df, sql):
    con = duckdb.connect()
    for p in glob.glob(f"{SMALL}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    columns = sorted(df.columns)
    value = lambda v: round(v, 6) if isinstance(v, float) else v
    want = con.sql(f"SELECT {', '.join(columns)} FROM ({sql})").fetchall()
    got = [tuple(r) for r in df.select(*columns).collect()]
    assert sorted(repr(tuple(map(value, r))) for r in got) == sorted(repr(tuple(map(value, r))) for r in want)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    same_rows(QUERIES[name](spark, SMALL), ORACLES[name])


# benchmark passages


def plain_contamination(text, items, window=10):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
    hit, names = set(), set()
    for name, item in items:
        item = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(item))
        for i in range(max(1, len(item) - window + 1)) if item else ():
            part = item[i : i + window]
            for j in range(len(words) - len(part) + 1):
                if words[j : j + len(part)] == part:
                    hit |= set(range(j, j + len(part)))
                    names.add(str(name))
    return len(words), len(hit), len(names)


@pytest.mark.parametrize("block_bytes", [1 << 20, 60])
def test_contamination_of_repetitive_texts(spark, block_bytes):
    rng = random.Random(5)
    make = lambda n: " ".join(rng.choice("aab") for _ in range(n))
    items = [(i, make(rng.choice((0, 1, 3, 10, 14)))) for i in range(8)] + [(8, None), (9, "b b, b"), (9, "a B b")]
    docs = [(i, make(rng.randrange(40))) for i in range(60)] + [(60, None), (61, ""), (61, "x b b b x")]
    got = decontaminate.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), block_bytes=block_bytes)
    assert sorted((r.doc_id, r.n_words, r.n_hit, r.n_items) for r in got.collect()) == sorted((i, *plain_contamination(t, items)) for i, t in docs)


def test_longest_matches(spark):
    item = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(1, "x " + " ".join(f"w{i}" for i in range(5, 25)) + " y w0 w1")], "doc_id long, text string")
    (row,) = decontaminate.benchmark_matches(docs, spark.createDataFrame([("i", item)], "item_id string, text string")).collect()
    assert [tuple(m) for m in row.matches] == [("i", 1, 5, 20)] and row.n_hit == 20


def test_decontamination_of_odd_tables(spark, odd, empty):
    bench = spark.createDataFrame([(None, "fox jumps over the lazy dog near the old river"), (2, None)], "item_id long, text string")
    out = decontaminate.decontaminate(odd, bench)
    assert out.columns == odd.columns and sorted(str(r.doc_id) for r in odd.subtract(out).collect()) == ["1", "2", "3"]
    assert decontaminate.decontaminate(odd, bench.limit(0)).count() == odd.count() and decontaminate.decontaminate(empty, bench).count() == 0


# near-copies


def plain_components(texts, words, threshold):
    def shingles(text):
        found = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
        return {tuple(found[i : i + words]) for i in range(len(found) - words + 1)} if len(found) >= words else {tuple(found)} if found else set()

    sets = {k: shingles(t) for k, t in texts.items()}
    top = {k: k for k in sets}

    def root(k):
        while top[k] != k:
            k = top[k]
        return k

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and threshold[1] * len(sets[a] & sets[b]) >= threshold[0] * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                top[y] = x
    return {k: (len(s), root(k)) for k, s in sets.items()}


@pytest.mark.parametrize("words,threshold,band_rows,seed", [(3, (85, 100), 5, 1), (5, (80, 100), 4, 2)])
def test_near_copies_of_one_text(spark, words, threshold, band_rows, seed):
    """Copies near the threshold: most links aren't with a star's centre."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(500)}" for _ in range(150)]
    texts = {}
    for i in range(120):
        copy = list(base)
        for _ in range(rng.randrange(9)):
            copy[rng.randrange(len(copy))] = f"x{rng.randrange(9999)}"
        texts[i] = " ".join(copy)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = near_dedup.near_duplicates(docs, words=words, threshold=threshold, band_rows=band_rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == plain_components(texts, words, threshold)


def test_near_copies_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "SCREEN_ROWS", 7)
    monkeypatch.setattr(near_dedup, "CONFIRM_ROWS", 5)
    test_near_copies_of_one_text(spark, 3, (85, 100), 5, 3)


def test_deduplication_of_odd_tables(spark, odd, empty):
    rows = near_dedup.near_duplicates(odd, words=5).collect()
    assert len(rows) == odd.count()
    by = defaultdict(set)
    for r in rows:
        by[r.doc_id].add((r.n_shingles, r.component_id, r.kept))
    assert {c for _, c, _ in by[2] | by[3]} == {1} and by[7] == {(1, 7, True)} and by[5] == {(0, 5, True)} and {k for _, _, k in by[None]} == {True}
    out = near_dedup.deduplicated(odd, words=5)
    left = Counter(r.doc_id for r in out.collect())
    assert out.columns == odd.columns and left == Counter({**{k: 1 for k in (1, 4, 5, 6, 7, 8, 9, 10, 11, 12)}, None: 2})
    assert near_dedup.deduplicated(empty, words=5).count() == 0 and near_dedup.near_duplicates(empty).count() == 0


def test_components_of_paths_and_stars(spark):
    rng = np.random.default_rng(1)
    names = rng.permutation(400)
    edges = [(int(names[i]), int(names[i + 1])) for i in range(150)] + [(int(names[200]), int(names[i])) for i in range(201, 300)] + [(int(names[300]), int(names[300]))]
    got = components.components(spark.createDataFrame(edges, "a long, b long"))
    groups = defaultdict(set)
    for r in got.collect():
        groups[r.label].add(r.node)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, ({int(n) for n in names[:151]}, {int(n) for n in names[200:300]})))
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_languages_of_few_different_texts(spark, monkeypatch):
    sizes, vectors = [], language.Model.vectors
    monkeypatch.setattr(language.Model, "vectors", lambda self, counts: sizes.append(len(counts)) or vectors(self, counts))
    for seed in range(3):
        rows = [(f"ein satz nummer {seed} {k % 4} über dies", "de") for k in range(3000)] + [(f"a line of number {seed} {k} about that", "en") for k in range(300)]
        model = language.fit_languages(spark.createDataFrame(rows, "text string, lang string").repartition(3), fit_rows=20)
        assert model.languages == ["de", "en"] and sizes == [4, 10]
        sizes.clear()


def test_signatures_hardly_ever_drop_a_pair_at_the_threshold():
    from math import comb

    n = near_dedup.BINS
    low = near_dedup._estimate(np.arange(n + 1))
    for s in (0.85, 0.8):
        assert sum(comb(n, k) * s**k * (1 - s) ** (n - k) for k in range(n + 1) if low[k] < s - near_dedup.SLACK) < 5e-7


# lines


def plain_lines(docs):
    """Which lines go, by comparing every pair of different lines."""
    places, sims = defaultdict(list), {}
    for doc, text in sorted(docs.items()):
        for k, line in enumerate([x for x in (text or "").split("\n") if x]):
            words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(line))
            if words:
                places[" ".join(words)].append((doc, k))
    for norm in places:
        found = textbuf.words(*textbuf.as_texts(pa.array([norm])), textbuf.ALNUM)
        bits, counts = line_dedup.simhash(found.hashes(), found.first)
        pairs = itertools.combinations(range(line_dedup.BLOCKS), 2)
        sims[norm] = {(i, j, bits[0, i], bits[0, j]) for i, j in pairs if counts[0, i] + counts[0, j] >= line_dedup.KEY_WORDS}
    norms, top = list(places), {n: n for n in places}

    def root(n):
        while top[n] != n:
            n = top[n]
        return n

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    for i, a in enumerate(norms):
        for b in norms[:i]:
            if sims[a] & sims[b] and edits(a, b) <= int(0.2 * max(len(a), len(b)) + 1e-9):
                top[root(a)] = root(b)
    groups = defaultdict(list)
    for n, at in places.items():
        groups[root(n)] += at
    return Counter(doc for at in groups.values() for doc, _ in sorted(at)[1:])


@pytest.mark.parametrize("rows", [3, 8192])
def test_lines_equal_a_plain_version(spark, texts, monkeypatch, rows):
    monkeypatch.setattr(line_dedup, "BUCKET_ROWS", rows)
    rng = random.Random(2)
    words = [f"word{i}" for i in range(60)]
    base = " ".join(rng.choice(words) for _ in range(40))
    docs = {i: "\n".join([base if i % 3 else base.replace(rng.choice(words), "other", 1), "Short Line.", "", f"unique {i} " + " ".join(rng.choice(words) for _ in range(8))]) for i in range(40)}
    docs |= {1000 + k: t for k, t in list(texts.items())[:40]}
    got = line_dedup.deduplicated_lines(spark.createDataFrame(list(docs.items()), "doc_id long, text string")).collect()
    want = plain_lines(docs)
    assert {r.doc_id: r.n_dropped for r in got} == {k: want[k] for k in docs}
    for r in got:
        assert r.n_lines == sum(bool(x) for x in docs[r.doc_id].split("\n")) and r.n_lines - r.n_dropped == sum(bool(x) for x in r.text.split("\n"))


def test_signatures_count_by_words():
    """Against a plain count, word by word."""
    rng = random.Random(3)
    lines = [" ".join(rng.choice(("aa", "b", "cdef", "gh", "ij", "k", "lm")) + str(rng.randrange(9)) for _ in range(rng.randrange(1, 60))) for _ in range(80)]
    found = textbuf.words(*textbuf.as_texts(pa.array(lines)), textbuf.ALNUM)
    bits, counts = line_dedup.simhash(found.hashes(), found.first)
    for i, line in enumerate(lines):
        word = dict(zip(line.split(), found.hashes()[found.first[i] : found.first[i + 1]].tolist()))
        for k in range(line_dedup.BLOCKS):
            mine = [h for h in word.values() if (h >> line_dedup._HASH_BITS) % line_dedup.BLOCKS == k]
            assert counts[i, k] == len(mine)
            assert int(bits[i, k]) == sum(1 << b for b in range(16) if 2 * sum(h >> b & 1 for h in mine) > len(mine))


def test_lines_alike_by_edits_are_found(texts):
    """How many pairs within the edit similarity share a bucket, whatever their signatures: lines with one and with two words changed."""
    rng = random.Random(6)
    lines = [x for x in {" ".join(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(x))) for t in texts.values() for x in (t or "").split("\n")} if len(x.split()) > 4]

    def changed(line, times):
        words = line.split(" ")
        for _ in range(times):
            k = rng.randrange(len(words))
            words[k] = rng.choice((words[k] + "x", words[k][:-1] or "q", rng.choice(rng.choice(lines).split())))
        return " ".join(words)

    def keys(some):
        found = textbuf.words(*textbuf.as_texts(pa.array(some)), textbuf.ALNUM)
        return line_dedup._unpacked(*line_dedup._packed(*line_dedup.simhash(found.hashes(), found.first)))

    recall = []
    for times in (1, 2):
        pairs = [(x, y) for x in rng.sample(lines, 600) if (y := changed(x, times)) != x and line_dedup.alike(x, y, 0.8)]
        (v, g), (w, h) = keys([x for x, _ in pairs]), keys([y for _, y in pairs])
        recall.append(((v == w) & g & h).any(1).mean())
    assert recall[0] > 0.98 and recall[1] > 0.85


def test_long_lines_and_words_that_imitate_one_another(spark):
    word = "a"
    while len(word) < 8192:
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    rng = random.Random(2)
    long = " ".join(f"w{rng.randrange(10**6)}" for _ in range(60_000))
    docs = [(1, word), (2, other), (3, long), (4, long.replace(" w5", " v5", 3)), (5, long[::-1])]
    got = line_dedup.deduplicated_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.doc_id: r.n_dropped for r in got} == {1: 0, 2: 0, 3: 0, 4: 1, 5: 0}


def test_lines_of_odd_tables(odd, empty):
    rows = line_dedup.deduplicated_lines(odd).collect()
    assert len(rows) == odd.count() and sorted(r.n_dropped for r in rows if r.doc_id in (1, 2, 3)) == [0, 2, 2, 2]
    assert {r.text for r in rows if r.doc_id == 4} == {None} and {r.n_lines for r in rows if r.doc_id in (4, 5)} == {0}
    assert line_dedup.deduplicated_lines(empty).count() == 0


def test_edit_distance():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randrange(11))) for _ in range(2))
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        for most in (0, 2, 11):
            assert line_dedup.distance(a, b, most) == min(row[-1], most + 1)


def test_alike_equals_the_edit_distance():
    rng = random.Random(7)
    for _ in range(500):
        a = [rng.choice(("aa", "ab", "b", "cdef")) for _ in range(rng.randrange(1, 8))]
        b = [w if rng.random() < 0.8 else rng.choice(("aa", "b", "xyz")) for w in a] + ["end"] * rng.randrange(2)
        a, b = " ".join(a), " ".join(b)
        most = int(0.2 * max(len(a), len(b)) + 1e-9)
        assert line_dedup.alike(a, b, 0.8) == (line_dedup.distance(a, b, most) <= most)
        assert line_dedup._word_edits(a.split(" "), b.split(" "), 99) >= line_dedup.distance(a, b, 99)


# mixture


def test_mixture_of_odd_tables(odd, empty):
    rows = source_mix.mix(odd).collect()
    assert len(rows) == odd.count() and source_mix.mix(empty).count() == 0
    total, by = sum(r.size for r in rows), defaultdict(list)
    for r in rows:
        assert r.taken in (0, r.size, 2 * r.size)
        by[r.target, r.source_size].append(r)
    assert math.isclose(sum(t for t, _ in by), 1.5 * total, rel_tol=1e-9)
    for (target, _), group in by.items():
        assert abs(sum(r.taken for r in group) - target) <= max(r.size for r in group) / 2 + 1
    out = source_mix.mixed(odd)
    assert out.columns == odd.columns and sorted(map(repr, ((r.doc_id, r.text) for r in out.collect()))) == sorted(map(repr, ((x.doc_id, x.text) for x in odd.collect() for r in [next(r for r in rows if (r.doc_id, r.size) == (x.doc_id, len((x.text or "").split())))] for _ in range(r.copies))))


def test_repeated_rows_are_drawn_one_by_one(spark):
    rows = [(7, "one two three four", "b")] * 400 + [(100 + i, "x " * 70, "a") for i in range(10)] + [(None, None, None)] * 3 + [(None, "y", "c")] * 9
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    for df, column in ((source_mix.mix(docs), "taken"), (source_mix.mixed(docs).join(source_mix.mix(docs).select("doc_id", "source_size", "target").distinct(), "doc_id"), None)):
        seven = df.where("doc_id = 7")
        taken = seven.agg(F.sum("taken")).first()[0] if column else 4 * seven.count()
        assert 1600 < seven.first().target < 3200 and abs(taken - seven.first().target) <= 3
    assert len(source_mix.mix(docs).collect()) == len(rows)


def test_documents_are_drawn_as_often_as_they_should(spark):
    """Shares drawn by size against a plain computation of the probabilities."""
    n = 6000
    sizes = {1: 0, 20: 2, 300: 4, 1000: 5}
    docs = spark.range(4 * n).selectExpr("id doc_id", f"array(1, 20, 300, 1000)[cast(id % 4 as int)] size").selectExpr("doc_id", "repeat('w ', size) text", "'s' source")
    whole = n * sum(sizes)
    rest = 0.5 * whole
    got = source_mix.mix(docs, weights=(1,), share=0.5).groupBy("size").agg(F.avg("copies").alias("share"), F.sum("taken").alias("taken")).collect()
    promised = lambda c: sum(n * s * min(1, c / 2**k) for s, k in sizes.items())
    low, high = 0.0, 64.0
    for _ in range(60):
        scale = (low + high) / 2
        low, high = (scale, high) if promised(scale) < rest else (low, scale)
    for r in got:
        p = min(1, scale / 2 ** sizes[r["size"]])
        assert abs(r.share - p) <= 4.5 * math.sqrt(p * (1 - p) / n) + 1e-9
    assert abs(sum(r.taken for r in got) - rest) <= 500 and len({round(r.share, 2) for r in got}) > 2


def test_mixture_is_near_its_targets(spark, docs, monkeypatch):
    monkeypatch.setattr(source_mix, "BINS", 4)
    one = docs.withColumn("source", F.when(F.col("doc_id") % 3 == 0, "big").otherwise(F.col("source")))
    first, second = (sorted(map(tuple, source_mix.mix(one).collect()), key=repr) for _ in range(2))
    assert first == second
    taken, target, largest = Counter(), {}, Counter()
    for _, size, source_size, t, _, n in first:
        taken[t, source_size] += n
        largest[t, source_size] = max(largest[t, source_size], size)
    for key in taken:
        assert abs(taken[key] - key[0]) <= largest[key] / 2 + 1


# languages and quality


def test_languages_of_held_out_rows(spark, docs):
    rows = QUERIES["op7_centroid_language"](spark, SMALL).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(rows) > 20 and np.mean([r.lang == r.lang_pred for r in rows]) > 0.95 and all(0 <= r.score <= 1 for r in rows)


def test_grams_and_nearest_centroids_equal_plain_ones(texts):
    """Counts gram by gram, and cosines number by number."""
    some = [*list(texts.values())[:12], "", "a", "Ab c", "日本 x", None, "  1 2 "]
    raw, at = textbuf.as_texts(pa.array(some))
    counts = language.gram_counts(raw, at)

    def slot(gram):
        code = 0
        for b, odd in zip(gram, language._ODD.tolist()):
            code = (code + (b + 1) * odd) % 2**32
        code = (code ^ code >> 15) * 2246822507 % 2**32
        return (code >> 8) % language.DIMS

    for text, got in zip(some, counts):
        body, want = (text or "").encode().translate(language._LETTERS), Counter()
        for n in (1, 2, 3):
            for i in range(len(body) - n + 1):
                gram = body[i : i + n]
                blank = [b == 32 for b in gram]
                if not (blank[0] if n == 1 else all(blank) if n == 2 else blank[1]):
                    want[slot(gram)] += 1
        assert {k: v for k, v in enumerate(got.tolist()) if v} == dict(want)
    rng = np.random.default_rng(2)
    model = language.Model(["a", "b"], rng.random(language.DIMS).astype(np.float32), rng.random((5, language.DIMS)).astype(np.float32), np.array([0, 0, 1, 1, 1]), np.zeros(5))
    model.centroids /= np.linalg.norm(model.centroids, axis=1, keepdims=True)
    best, cosine = model.nearest(counts)
    for k, row in enumerate(counts):
        x = [math.log1p(c) * float(w) for c, w in zip(row.tolist(), model.idf)]
        size = math.sqrt(sum(v * v for v in x)) or 1
        dots = [sum(v * float(c) for v, c in zip(x, centroid)) / size for centroid in model.centroids]
        assert abs(max(dots) - cosine[k]) < 1e-4 and dots[best[k]] > max(dots) - 1e-5


def test_features_and_scores_equal_plain_ones(texts):
    some = [*list(texts.values())[:25], "", None, "ONE! two\n\nONE! two", "é 1 | 2"]
    x = quality.features(pa.array(some))
    names = quality.FEATURES
    for text, row in zip(some, x):
        body = (text or "").encode()
        n, of = max(1, len(body)), lambda cs: sum(b in cs for b in body)  # noqa: B023
        words = [w for w in re.split(rb"[ \t-\r]+", body.lower() if body.isascii() else lower(text).encode()) if w]
        lines = [w for w in lower(text).encode().split(b"\n") if w.strip(b"\n")] if text else []
        want = {"log_bytes": math.log1p(len(body)), "digit": of(b"0123456789") / n, "line": body.count(b"\n") / n, "loud": body.count(b"!") / n, "beyond_ascii": sum(b > 127 for b in body) / n,
                "upper": of(range(65, 91)) / max(1, of(range(65, 91)) + of(range(97, 123))), "word_length": sum(map(len, words)) / max(1, len(words)), "distinct_words": len(set(words)) / max(1, len(words)),
                "repeated_lines": 1 - len(set(lines)) / len(lines) if lines else 0, "log_longest_word": math.log1p(max(map(len, words), default=0)), "words_per_line": math.log1p(len(words) / max(1, len(lines)))}
        for name, value in want.items():
            assert abs(row[names.index(name)] - value) < 1e-9, (name, text)
    rng = np.random.default_rng(1)
    model = quality.fit(rng.random((500, 4)), rng.integers(0, 2, 500).astype(float), rounds=5)
    for row in (rows := rng.random((40, 4))):
        total = model.bias + sum(float(t[sum(c <= v for c in cuts)]) for cuts, t, v in zip(model.cuts, model.tables, row))
        for (a, b), t in zip(model.pairs, model.pair_tables):
            total += float(t[sum(c <= row[a] for c in model.pair_cuts[a]), sum(c <= row[b] for c in model.pair_cuts[b])])
        assert abs(1 / (1 + math.exp(-total)) - model.score(row[None])[0]) < 1e-9
    assert len(model.score(rows)) == 40


def test_repeated_ids_and_labels_are_bounded(spark):
    """A document that stands very often under one id and several labels fits as one row for each label."""
    docs = spark.range(4000).selectExpr("cast(1 as long) doc_id", "concat('text number ', id % 3) text").union(spark.range(2, 40).selectExpr("id", "repeat('good words. ', id % 7)"))
    labels = spark.range(2000).selectExpr("cast(1 as long) doc_id", "cast(id % 2 as int) quality").union(spark.range(2, 40).selectExpr("id", "cast(id % 2 as int)"))
    sizes, fit = [], quality.fit
    with pytest.MonkeyPatch.context() as m:
        m.setattr(quality, "fit", lambda x, y, **k: sizes.append(len(x)) or fit(x, y, rounds=2))
        quality.fit_quality(docs, labels)
    assert sizes == [40]


def test_languages_of_odd_tables(spark, odd, empty, docs):
    model = language.fit_languages(docs)
    rows = language.identify_language(odd, model).collect()
    assert len(rows) == odd.count() and rows[0].asDict().keys() >= {"lang", "lang_pred", "rejected", "row"}
    assert {r.lang_pred for r in rows if r.doc_id in (4, 5, 6, 9)} == {"und"} and {r.lang_pred for r in rows if r.doc_id == 11} == {"en"}
    assert all(r.lang_pred in model.languages for r in rows if r.doc_id in (7, 12))
    unlearnt = language.fit_languages(empty)
    assert {r[-3] for r in language.identify_language(odd, unlearnt).collect()} == {"und"} and language.identify_language(empty, model).count() == 0
    few = language.fit_languages(docs, fit_rows=40)
    assert few.languages == model.languages and (few.idf == model.idf).all()


def test_additive_model_learns_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 4))
    y = ((x[:, 0] > 0.5) != (x[:, 1] > 0.5)).astype(float)
    alone, model = quality.fit(x[:3000], y[:3000], pairs=0), quality.fit(x[:3000], y[:3000])
    right = lambda m: ((m.score(x[3000:]) >= 0.5) == y[3000:]).mean()
    assert right(alone) < 0.7 and right(model) > 0.9 and (0, 1) in {tuple(sorted(p)) for p in model.pairs}
    assert (quality.fit(np.zeros((0, 4)), np.zeros(0)).score(x[:3]) == 0.5).all()


def test_quality_of_held_out_rows(spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = QUERIES["op8_gam_quality"](spark, "/root/testdata/sf0.01").join(labels, "doc_id").where("held_out").collect()
    good, bad = [r.score for r in rows if r.quality == 1], [r.score for r in rows if r.quality == 0]
    assert np.mean([a > b for a in good for b in bad]) > 0.95 and all(r.predicted == (r.score >= 0.5) for r in rows)


def test_quality_of_odd_tables(spark, odd, empty, docs):
    model = quality.fit_quality(docs, spark.read.parquet(f"{SMALL}/labels.parquet"))
    rows = quality.score_quality(odd, model, score_col="s").collect()
    assert len(rows) == odd.count() and all(0 <= r.s <= 1 and r.score == 0.5 for r in rows)
    kept = quality.good_quality(odd, model)
    assert kept.columns == odd.columns and kept.count() == sum(r.s >= 0.5 for r in rows) and quality.good_quality(empty, model).count() == 0
    nothing = quality.fit_quality(empty, spark.createDataFrame([(1, None), (None, 1)], "doc_id long, quality int"))
    assert {r.s for r in quality.score_quality(odd, nothing, score_col="s").collect()} == {0.5}
    assert quality.fit_quality(docs, spark.read.parquet(f"{SMALL}/labels.parquet"), fit_rows=20).score(np.zeros((1, 16))) >= 0


# vectors


@pytest.mark.parametrize("shard_rows", [40, 6, 9999])
def test_top_k_equals_a_full_search(spark, shard_rows):
    rng = np.random.default_rng(4)
    x = rng.integers(-9, 9, (300, 5))
    x[20:60] = x[20]  # ties
    rows = [(i, x[i].tolist()) for i in range(300)] + [(None, [1, 2, 3, 4, 5]), (900, None), (901, [1, None, 2, 3, 4]), (902, [5, 5]), (903, [6, 6]), (904, [])]
    vectors = spark.createDataFrame(rows, "vec_id long, vector array<long>")
    queries = vectors.where("vec_id % 20 = 0 or vec_id in (902, 904)")
    got = exact_search.exact_top_k(vectors, queries.union(queries), 5, shard_rows=shard_rows).collect()
    found = defaultdict(list)
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        found[r.query_id].append((r.rank, r.vec_id, r.score))
    whole = [(i, v) for i, v in rows if v is not None and None not in v and len(v) == 5]
    for q in range(0, 300, 20):
        best = sorted(((-sum(a * b for a, b in zip(x[q].tolist(), v)), -1 if i is None else i) for i, v in whole if i != q))[:5]
        assert found[q] == [(k + 1, None if i < 0 else i, -s) for k, (s, i) in enumerate(best)]
    assert found[902] == [(1, 903, 60)] and found[904] == []
    assert exact_search.exact_top_k(vectors.limit(0), queries, 5).count() == 0 and exact_search.exact_top_k(vectors, queries.limit(0), 5).count() == 0


def test_scaled_vectors(spark):
    df = spark.sql("select explode(array(array(0.5f, -0.001f), array(float('nan')), array(float('inf')), array(cast(null as float)), null)) v")
    assert [r.s for r in df.select(exact_search.scaled(F.col("v")).alias("s")).collect()] == [[128, -1], None, None, None, None]


# the pipeline


def test_pipeline_stages_and_result(spark, docs):
    import corpus_pipeline

    from ruleweave.llm import token_binary

    labels, bench = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("labels", "benchmark"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "decontaminate", "mix", "tokens"]
    texts = {r.doc_id: r.text for r in docs.collect()}
    model = quality.fit_quality(docs, labels)
    good = {r.doc_id for r in quality.score_quality(docs, model).where("score >= 0.5").collect()}
    top = plain_components({k: texts[k] for k in good}, 5, (80, 100))
    single = {k for k, (n, root) in top.items() if root == k}
    items = [(r.item_id, r.text) for r in bench.collect()]
    clean = {k for k in single if not plain_contamination(texts[k], items)[1]}
    assert 0 < len(clean) < len(single) < len(good) < len(texts)
    mix = Counter({r.doc_id: r.copies for r in source_mix.mix(docs.where(F.col("doc_id").isin(list(clean)))).collect()})
    rows = corpus_pipeline.run(spark, SMALL).collect()
    assert Counter(r.doc_id for r in rows) == +mix
    encoder = token_binary.WordEncoder(token_binary.tokenizer_path())
    some = sorted(rows, key=lambda r: r.start)[:30]
    assert [r.n_tokens for r in some] == [len(x) + 1 for x in encoder.whole([texts[r.doc_id] for r in some])]
    assert [r.start for r in some] == list(np.cumsum([0, *(r.n_tokens for r in some)])[:-1])


def test_pipeline_stages_of_odd_tables(spark, odd, empty):
    import corpus_pipeline

    for rows in (odd, empty):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, rows, SMALL)
            assert name == "tokens" or out.columns == odd.columns
            out.count()
