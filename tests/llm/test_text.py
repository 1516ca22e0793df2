"""Word splitting, token blocks, and what works on one text at a time."""

import datetime
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ruleweave.llm import license_scan, pseudonyms, textbuf, token_binary

BLANK, ALNUM = r"[^\x20\x09-\x0D]+", r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
TEXT = st.text(alphabet=st.sampled_from("aBz9 .,\n\té日\x00'"), max_size=30)


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.none() | TEXT, max_size=6))
def test_words_are_those_of_the_patterns(texts):
    for table, pattern in ((textbuf.BLANK_SEPARATED, BLANK), (textbuf.ALNUM, ALNUM)):
        found = textbuf.words(*textbuf.as_texts(pa.array(texts, pa.string())), table)
        body, hashes, seen = found.data.tobytes(), found.hashes(), {}
        got = [[body[a:b].decode() for a, b in zip(found.starts[x:y], found.ends[x:y])] for x, y in zip(found.first, found.first[1:])]
        assert got == [re.findall(pattern, lower(t)) for t in texts]
        for a, b, h in zip(found.starts, found.ends, hashes):
            assert seen.setdefault(body[a:b], h) == h
        assert len(set(seen.values())) == len(seen)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, (1 << 64) - 1) | st.integers(0, 60000) | st.just(0), max_size=600))
def test_simple8b_round_trip(values):
    values = np.array(values, np.uint64)
    assert (token_binary.unpack(*(lambda w, p, x: (w, len(values), p, x))(*token_binary.pack(values))) == values).all()


def test_simple8b_is_dense():
    assert len(token_binary.pack(np.zeros(240, np.uint64))[0]) == 1 and len(token_binary.pack(np.full(30, 3, np.uint64))[0]) == 1


def test_blocks_round_trip():
    ids, lengths = np.arange(5000, dtype=np.uint32) * 11 % 50000, np.array([0, 4999, 1])
    got, sizes = token_binary.block_ids(token_binary.block_record(ids, lengths))
    assert (got == ids).all() and (sizes == lengths).all()


def test_encoder_equals_the_library(texts):
    encoder = token_binary.WordEncoder(token_binary.tokenizer_path())
    odd = ["It's DON'T they'LL", "<|endoftext|> x<|startoftext|>y <|ENDOFTEXT|>", "café—, naïve× a÷, É́", "", None, "123abc 4.5,6", "x\x1cy\x85z", "ΣΑΣ σας,", "é, ́", "日本語、ok", "a'b 's", "ÉTÉ, Über!", "İstanbul İ,"]
    for _ in range(2):  # remembered the second time
        every = odd + list(texts.values())[:40]
        ids, lengths = encoder.ids(*textbuf.as_texts(pa.array(every)), 2)
        assert [x.tolist() for x in np.split(ids, np.cumsum(lengths)[:-1])] == [x + [2] for x in encoder.whole([t or "" for t in every])]


def test_token_files(odd, empty, spark):
    index = token_binary.read_token_index(spark, path := token_binary.write_token_blocks(odd, block_ids=50))
    rows = sorted(index.collect(), key=lambda r: r.start)
    encoder = token_binary.WordEncoder(token_binary.tokenizer_path())
    source = sorted(odd.withColumn("hash", F.xxhash64("text")).collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.hash))
    start = 0
    for row, want in zip(rows, source, strict=True):
        ids = encoder.whole([want.text or ""])[0] + [2]
        assert tuple(row) == (want.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert sum(len(r.ids) for r in token_binary.read_token_ids(spark, path).collect()) == start
    assert token_binary.read_token_index(spark, token_binary.write_token_blocks(empty)).collect() == []


def test_many_rows_of_one_id_are_dealt_out(spark):
    docs = spark.range(3000).selectExpr("cast(null as long) doc_id", "concat('word ', id % 2) text")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few rows would be put together again
    try:
        index = token_binary.read_token_index(spark, path := token_binary.write_token_blocks(docs)).orderBy("start").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert [r.start for r in index] == list(np.cumsum([0, *(r.n_tokens for r in index)])[:-1]) and len(index) == 3000
    assert spark.read.parquet(path).select("shard").distinct().count() > 1


def test_words_that_imitate_one_another(spark):
    """Words that a polynomial in any odd number can't tell apart."""
    from ruleweave.llm import decontaminate, near_dedup

    word = "a"
    while len(word) < 8192:
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    for n in (1024, 2048, 4096, 8192):
        hashes = textbuf.words(*textbuf.as_texts(pa.array([word[:n], other[:n]])), textbuf.ALNUM).hashes()
        assert hashes[0] != hashes[1]
    encoder = token_binary.WordEncoder(token_binary.tokenizer_path())
    ids, lengths = encoder.ids(*textbuf.as_texts(pa.array([word, other])), 2)
    assert [x.tolist() for x in np.split(ids, lengths[:1])] == [x + [2] for x in encoder.whole([word, other])]
    docs = spark.createDataFrame([(1, word), (2, other)], "doc_id long, text string")
    assert {r.doc_id: r.contaminated for r in decontaminate.contamination(docs, docs.where("doc_id = 1").toDF("item_id", "text")).collect()} == {1: True, 2: False}
    assert all(r.kept for r in near_dedup.near_duplicates(docs, words=3).collect())


def test_other_tokenizers_are_not_cut(tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    spanning = Tokenizer(models.BPE({c: i for i, c in enumerate([chr(c) for c in range(32, 127)])}, []))
    spanning.pre_tokenizer = pre_tokenizers.Split("x", "isolated")
    spanning.save(str(tmp_path / "t.json"))
    encoder = token_binary.WordEncoder(str(tmp_path / "t.json"))
    texts = ["a b", "", "x y  z"]
    ids, lengths = encoder.ids(*textbuf.as_texts(pa.array(texts)), 7)
    assert not encoder.cuts and [x.tolist() for x in np.split(ids, np.cumsum(lengths)[:-1])] == [x + [7] for x in encoder.whole(texts)]


def test_license_places_equal_a_plain_search(odd, texts):
    cases = list(texts.values()) + ["Under the MIT license under the mit license.", "CC-BY-NC cc by nc by nc", "sunder the mit license", None, "", "under the mit license2", "undr the mit licence", "apache licence version 2", "apache license version 3", "cc by nd"]
    base = {n.phrase: n.label for n in license_scan.NOTICES[: license_scan.BASE]}
    got = license_scan.Scanner(license_scan.NOTICES).batch(pa.array(range(len(cases))), pa.array(cases)).to_pylist()
    for text, row in zip(cases, got, strict=True):
        words = re.findall(ALNUM, lower(text))
        want = sorted((i, label) for p, label in base.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split())
        assert sorted((s["first_word"], s["label"]) for s in row["spans"] if s["exact"] and s["label"] in base.values()) == want
        assert row["n_words"] == len(words)
    fuzzy = [{s["label"]: s["edits"] for s in r["spans"]} for r in got[-4:]]
    assert fuzzy == [{"mit": 2}, {"apache-2": 1}, {}, {}]
    rows = license_scan.license_spans(odd).collect()
    assert len(rows) == odd.count() and all(r.spans == [] for r in rows) and {r.n_words for r in rows if r.doc_id in (4, 5, 6)} == {0}


def test_fuzzy_notices_equal_a_search_of_the_whole_text():
    import random

    import regex

    rng, scanner = random.Random(3), license_scan.Scanner(license_scan.NOTICES)
    for notice in license_scan.NOTICES:
        for _ in range(25):
            chars = list(notice.phrase)
            for _ in range(rng.randint(0, notice.edits)):
                chars[rng.randrange(len(chars))] = rng.choice("xyz")
            text = f"some words before {''.join(chars)} and words after it"
            found = [s for s in scanner.spans(text) if scanner.notices[s[0]] is notice]
            whole = regex.search(rf"\b(?:{regex.escape(notice.phrase)}){{e<={notice.edits}}}\b", text)
            core = set(notice.core) <= set(text.split())
            assert bool(found) == bool(whole and core)


def test_notices_close_together_equal_all_word_spans():
    import random

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    def plain(notice, text):
        at = [m.span() for m in re.finditer("[^ ]+", text)]
        spans = [(a, b) for i, (a, _) in enumerate(at) for _, b in at[i:] if abs(b - a - len(notice.phrase)) <= notice.edits]
        good = sorted((n, a, b) for a, b in spans if (n := edits(text[a:b], notice.phrase)) <= notice.edits and (not n or set(notice.core) <= set(text[a:b].split(" "))))
        out = [g for g in good if not g[0]]
        for n, a, b in good[len(out) :]:
            if all(b <= x or y <= a for _, x, y in out):
                out.append((n, a, b))
        return sorted((a, b, n) for n, a, b in out)

    rng, scanner = random.Random(5), license_scan.Scanner(license_scan.NOTICES)
    texts = ["gnu genral publc license or the gnu general public license", "apache licence verson 2 apache license version 1", "all rights resrvd all right reserved"]
    labels = [[(scanner.notices[s[0]].label, s[3]) for s in scanner.spans(t)] for t in texts]
    assert labels == [[("gpl", 2), ("gpl", 0)], [("apache-2", 2)], [("proprietary", 2)]]
    for _ in range(60):
        some = rng.choices(license_scan.NOTICES, k=2)
        parts = []
        for _ in range(5):
            chars = list(rng.choice(some).phrase)
            for _ in range(rng.randint(0, 4)):
                k = rng.randrange(len(chars))
                chars[k : k + 1] = rng.choice(("", "x", chars[k] + "y", " "))
            parts += ["".join(chars)] + rng.choices(("license", "under t", "or"), k=rng.randint(0, 2))
        text = " ".join(" ".join(parts).split())
        found = scanner.spans(text)
        for k, notice in enumerate(scanner.notices):
            if notice in some:
                assert [s[1:] for s in found if s[0] == k] == plain(notice, text)


def test_notices_from_a_table(spark):
    table = spark.createDataFrame([("Under the ACME licence, v1", "acme", 2, ["acme"]), ("as is", "as-is", 0, None)], "phrase string, label string, edits int, core array<string>")
    notices = license_scan.notices_of(table)
    assert [(n.phrase, n.label, n.edits, n.core) for n in notices] == [("under the acme licence v1", "acme", 2, ("acme",)), ("as is", "as-is", 0, ())]
    docs = spark.createDataFrame([(1, "sold as is, undr the acme license v1")], "doc_id long, text string")
    (row,) = license_scan.license_spans(docs, notices=notices).collect()
    assert [(s.label, s.first_word, s.edits) for s in row.spans] == [("as-is", 1, 0), ("acme", 3, 2)]
    with pytest.raises(ValueError):
        license_scan.notices_of(table.selectExpr("phrase", "label", "20 edits", "core"))


@pytest.mark.parametrize("text", ["under the mit license " * 8000, "under the mit licens under the mit license2 " * 3000, "license " * 20000, "x" * 200_000])
def test_notices_in_long_texts_take_linear_time(text):
    import time

    scanner, seconds = license_scan.Scanner(license_scan.NOTICES), []
    for part in (text[: len(text) // 4], text):
        began = time.process_time()
        scanner.batch(pa.array([1]), pa.array([part]))
        seconds.append(time.process_time() - began)
    assert seconds[1] < 10 * seconds[0] + 0.5


@pytest.mark.parametrize("unit", ["a1", "a@a1", "1 2 ", "word 12 words and ", "1.2.3.4 ", "4111 1111 1111 1111 12 ", "+1 (456) 555-2186 "])
def test_pseudonyms_of_long_texts_take_linear_time(unit):
    import time

    work, seconds = pseudonyms.Pseudonyms(b"key"), []
    for size in (20_000, 80_000):
        began = time.process_time()
        work.text("a@" + unit * (size // len(unit)))
        seconds.append(time.process_time() - began)
    assert seconds[1] < 9 * seconds[0] + 0.5


def test_prose_of_megabytes():
    import time

    began = time.process_time()
    text = "some words about 12 things in the year 1999 and no tab at all, " * 60_000
    assert pseudonyms.Pseudonyms(b"key").text(text) == (text, [0] * len(pseudonyms.KINDS)) and time.process_time() - began < 20


def test_clean_numbers_are_left_alone():
    work = pseudonyms.Pseudonyms(b"key")
    for clean in ("order 123-456-7890", "table 100 200 3000", "version 10.0.0.1 and v 1.2.3.4", "Release: 7.20.3.11", "part 555-0123", "5 000 000 people", "isbn 978-3-16-148410-0", "3.14159 2.71828", "1,000,000.50", "room 12-34-5678"):
        assert work.text(clean) == (clean, [0] * len(pseudonyms.KINDS)), clean


def test_values_equal_a_plain_search_of_tokens():
    """Values of every kind among words and numbers that are none, found token by token."""
    import random
    import string

    rng = random.Random(9)
    digits = lambda n: "".join(rng.choices(string.digits, k=n))

    def card():
        body = "4" + digits(14)
        total = sum(sum(divmod(int(c) * (2 - i % 2), 10)) for i, c in enumerate(body))
        return body + str(-total % 10)

    def iban():
        rest = digits(18)
        return f"DE{98 - int(rest + '131400') % 97:02d}{rest}"

    make = {
        "email": lambda: f"{rng.choice(('ann', 'b.c', 'x_y'))}{digits(2)}@{rng.choice(('site', 'my-mail'))}.example.{rng.choice(('com', 'org'))}",
        "phone": lambda: rng.choice((f"+1 ({rng.randint(200, 989)}) 555-{digits(4)}", f"({rng.randint(200, 989)}) {rng.randint(200, 989)}-{digits(4)}", f"{rng.randint(200, 989)}-{rng.randint(200, 989)}-{digits(4)}")),
        "ip": lambda: ".".join(str(rng.randrange(256)) for _ in range(4)), "card": card, "iban": iban,
        "ssn": lambda: f"{rng.randint(1, 665):03d}-{rng.randint(1, 99):02d}-{rng.randint(1, 9999):04d}",
        "date": lambda: f"{rng.randint(1900, 2099)}-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}", "secret": lambda: "".join(rng.choices("0123456789abcdef", k=38)) + "ab",
    }
    none = ("word", "12", "3.5", "a-b", "x@y", "1999", "12:30", "70%", "C3PO", "(see", "12,000")
    work, back = pseudonyms.Pseudonyms(b"key"), pseudonyms.Pseudonyms(b"key", back=True)
    seen = {}
    for _ in range(150):
        tokens = [(None, rng.choice(none)) if rng.random() < 0.6 else (k := rng.choice(pseudonyms.KINDS), make[k]()) for _ in range(rng.randrange(1, 30))]
        text = " | ".join(t for _, t in tokens)
        new, counts = work.text(text)
        want = {k: sum(kind == k for kind, _ in tokens) for k in pseudonyms.KINDS}
        assert dict(zip(pseudonyms.KINDS, counts)) == want and back.text(new)[0] == text
        for (kind, old), now in zip(tokens, new.split(" | "), strict=True):
            assert (old == now) == (kind is None) or kind is not None
            assert seen.setdefault(old, now) == now  # the same wherever it stands
            assert kind is None or re.sub("[a-z]", "a", re.sub(r"\d", "9", old)) == re.sub("[a-z]", "a", re.sub(r"\d", "9", now)) or kind in ("ip", "secret")


@settings(max_examples=100, deadline=None)
@given(st.integers(2, 1 << 80), st.data())
def test_permutation_turns_back(size, data):
    x = data.draw(st.integers(0, size - 1))
    y = pseudonyms.permute(x, size, b"k", "t")
    assert 0 <= y < size and pseudonyms.permute(y, size, b"k", "t", back=True) == x


def test_permutation_is_one_to_one():
    for size in (2, 3, 10, 97, 500):
        assert sorted(pseudonyms.permute(x, size, b"k", "t") for x in range(size)) == list(range(size))


def test_values_keep_their_form():
    work, back = pseudonyms.Pseudonyms(b"key"), pseudonyms.Pseudonyms(b"key", back=True)
    text = "und.34@mail7.example.com +1 (017) 555-7713 233.254.104.120 4111 1111 1111 1111 GB82 WEST 1234 5698 7654 32 123-45-6789 1999-12-31 31/12/1999 02/03/2001 " + "b4" * 20
    new, counts = work.text(text)
    assert dict(zip(pseudonyms.KINDS, counts)) == {"email": 1, "phone": 1, "ip": 1, "card": 1, "iban": 1, "ssn": 1, "date": 3, "secret": 1}
    assert re.sub("[a-z]", "a", re.sub(r"\d", "9", new.split(" ")[0])) == "aaa.99@aaaa9.aaaaaaa.aaa" and back.text(new)[0] == text
    card = re.search(r"\d{4} \d{4} \d{4} \d{4}", new).group().replace(" ", "")
    assert pseudonyms._luhn(card[:-1]) == card[-1] and datetime.date.fromisoformat(re.search(r"\d{4}-\d\d-\d\d", new).group())
    assert work.text("x" * 300 + " und.34@mail7.example.com")[0].endswith(new.split(" ")[0])  # the same in any text
    for clean in ("4111111111111112", "000-12-3456 99/99/2000 300.1.1.1", "no values here", "", "version 1.2.3, 1999 and 12,000 and 3-4"):
        assert work.text(clean) == (clean, [0] * len(pseudonyms.KINDS))


def test_cards_among_other_numbers():
    import random

    work, back, rng = pseudonyms.Pseudonyms(b"key"), pseudonyms.Pseudonyms(b"key", back=True), random.Random(4)
    card = work.text("4111 1111 1111 1111")[0]
    for text in ("{} 12/25", "{} 123", "{} 2 items", "7 {}", "12345 {}", "exp 12 25 {} 123 4", "{} 1999-12-31", "\x00 {} 12/25"):
        new, counts = work.text(text.format("4111 1111 1111 1111"))
        assert counts[pseudonyms.KINDS.index("card")] == 1 and card in new and back.text(new)[0] == text.format("4111 1111 1111 1111")
    assert "4111" not in work.text("4111-1111-1111-1111 123")[0]
    assert work.text("4111 1111 1111 1111 1999-12-31")[1][pseudonyms.KINDS.index("date")] == 1
    for _ in range(1500):  # whatever is read as a card, the way back reads the same
        text = rng.choice(("", "4111 1111 1111 1111 ", "378282246310005-")) + "".join("".join(rng.choices("0123456789", k=rng.choice((1, 2, 3, 4, 4, 4, 6, 13, 16)))) + rng.choice("  -") for _ in range(rng.randint(1, 12))) + "x"
        new, counts = work.text(text)
        kinds = {k for k, n in zip(pseudonyms.KINDS, counts) if n}
        if kinds <= {"card"}:
            groups = [m.group() for m in re.finditer(r"\d+", text)]
            assert len(new) == len(text) and len(re.findall(r"\d+", new)) == len(groups)
        run = text[:-2]
        if groups_of := re.findall(r"\d+", run):
            spans = work.cards(run, True)
            changed = run
            for a, b, v in reversed(spans):
                changed = changed[:a] + v + changed[b:]
            again = back.cards(changed, True)
            for a, b, v in reversed(again):
                changed = changed[:a] + v + changed[b:]
            assert changed == run and [s[:2] for s in spans] == [s[:2] for s in again] and groups_of


def test_pseudonyms_of_documents(odd, empty, docs, texts):
    rows = pseudonyms.pseudonymise(odd, key=b"k").collect()
    assert sorted(map(repr, ((r.doc_id, r.text) for r in rows))) == sorted(map(repr, ((r.doc_id, r.text) for r in odd.collect()))) and not any(r.n_replaced for r in rows)
    assert pseudonyms.pseudonymise(empty, key=b"k").collect() == []
    changed = pseudonyms.pseudonymise(docs, key=b"k")
    found = defaultdict(int)
    for r in changed.collect():
        found["any"] += r.n_replaced
        assert (r.text == texts[r.doc_id]) == (r.n_replaced == 0)
        assert not set(re.findall(r"\S+@mail\d\.example\.com", texts[r.doc_id])) & set(re.findall(r"\S+@\S+", r.text))
    assert found["any"] > 10
    assert {r.doc_id: r.text for r in pseudonyms.pseudonymise(changed, key=b"k", back=True).collect()} == texts
