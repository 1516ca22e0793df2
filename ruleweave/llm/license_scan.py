"""License notices in texts, with a few characters wrong.

A notice with k allowed edits is cut into k + 1 pieces; text within k edits of it
holds one of the pieces unchanged (pigeonhole). Exact search for the pieces gives
the words a match can begin with, and each candidate is verified by itself by the
regex library's bounded-error matching. Places where a notice stands word for word are found by the same
search: all of its pieces are there.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import textbuf
from .shared import bare


@dataclass(frozen=True)
class Notice:
    """A short notice in lower-case words. core: words that a match must hold unchanged."""

    phrase: str
    label: str
    edits: int
    core: tuple[str, ...] = ()

    @property
    def pieces(self) -> list[str]:
        n = self.edits + 1
        cut = [len(self.phrase) * i // n for i in range(n + 1)]
        return [self.phrase[a:b] for a, b in zip(cut, cut[1:], strict=False)]


#: The notices that are looked for, the first three as base phrases.
NOTICES = (
    Notice("under the mit license", "mit", 2, ("mit",)),
    Notice("apache license version 2", "apache-2", 2, ("2",)),
    Notice("cc by nc", "cc-by-nc", 0, ("cc", "by", "nc")),
    Notice("gnu general public license", "gpl", 3),
    Notice("mozilla public license", "mpl", 2, ("public",)),
    Notice("permission is hereby granted free of charge", "mit-text", 4),
    Notice("redistribution and use in source and binary forms", "bsd", 4),
    Notice("all rights reserved", "proprietary", 2, ("all", "rights")),
    Notice("gnu lesser general public license", "lgpl", 3, ("lesser",)),
    Notice("gnu affero general public license", "agpl", 3, ("affero",)),
    Notice("eclipse public license", "epl", 2, ("eclipse",)),
    Notice("boost software license", "bsl", 2, ("boost",)),
    Notice("creative commons attribution", "cc-by", 3, ("commons",)),
    Notice("creative commons zero", "cc0", 2, ("commons", "zero")),
    Notice("permission to use copy modify and or distribute this software", "isc-text", 5),
    Notice("the software is provided as is without warranty of any kind", "no-warranty", 5),
    Notice("this is free and unencumbered software released into the public domain", "unlicense", 5),
    Notice("licensed under the apache license", "apache", 3, ("apache",)),
    Notice("may be used to endorse or promote products derived from this software", "bsd-3", 5),
    Notice("do not redistribute without permission", "proprietary", 3, ("not",)),
)
BASE = 3

#: Notices that a table may hold: they are looked for all at once in every task.
MOST_NOTICES = 10_000

SPAN = "struct<label: string, first_char: int, last_char: int, first_word: int, n_words: int, edits: int, exact: boolean>"
SCHEMA = f"doc_id long, n_words long, spans array<{SPAN}>"


class Scanner:
    def __init__(self, notices: tuple[Notice, ...]):
        import ahocorasick

        import regex

        self.notices = notices
        # of a span as a whole: its least errors, if they are within the bound
        self.patterns = [regex.compile(f"(?b)(?:{regex.escape(n.phrase)}){{e<={n.edits}}}") for n in notices]
        self.seeds = ahocorasick.Automaton()
        for k, notice in enumerate(notices):
            offset = 0
            for piece in notice.pieces:
                self.seeds.add_word(piece, (*self.seeds.get(piece, ()), (k, len(piece), offset)))
                offset += len(piece)
        self.seeds.make_automaton()

    def edits(self, k: int, text: str, s: int, e: int) -> int | None:
        """Errors of a span against notice k; None if there are too many."""
        phrase = self.notices[k].phrase
        if e - s == len(phrase) and text.startswith(phrase, s):
            return 0
        found = self.patterns[k].fullmatch(text, s, e) if self.notices[k].edits else None
        return sum(found.fuzzy_counts) if found else None

    def spans(self, text: str) -> list[tuple[int, int, int, int]]:
        """(notice, first, end, edits) in a text of single-spaced words, each notice's matches apart from one another.

        A match holds a piece unchanged, no further from its place than the edits, so
        the words that begin about where the notice would are tried one by one.
        """
        starts: dict[int, set[int]] = {}
        for end, hits in self.seeds.iter(text):
            for k, size, offset in hits:
                first, edits = end + 1 - size - offset, self.notices[k].edits
                a, b = max(0, first - edits), first + edits
                at = 0 if a == 0 else text.find(" ", a - 1, b) + 1
                while at or a == 0:
                    if at > b:
                        break
                    starts.setdefault(k, set()).add(at)
                    a, at = -1, text.find(" ", at, b) + 1
        found = []
        for k, places in starts.items():
            notice = self.notices[k]
            size, core = len(notice.phrase), set(notice.core)
            exact, near = [], []
            for s in sorted(places):
                e = s + size - notice.edits - 1
                while e < min(len(text), s + size + notice.edits):
                    e = text.find(" ", e + 1, s + size + notice.edits + 1)
                    e = e if e >= 0 else len(text)
                    if e > s + size + notice.edits:
                        break
                    edits = self.edits(k, text, s, e)
                    if edits == 0:
                        exact.append((k, s, e, 0))  # word for word: every place
                    elif edits is not None and core <= set(text[s:e].split(" ")):
                        near.append((edits, s, e))
            found += exact
            taken = [(s, e) for _, s, e, _ in exact]
            ends = [e for _, e in taken]
            for edits, s, e in sorted(near):  # the best of those that overlap
                at = bisect.bisect_right(ends, s)
                if at == len(taken) or taken[at][0] >= e:
                    taken.insert(at, (s, e))
                    ends.insert(at, e)
                    found.append((k, s, e, edits))
        return sorted(found, key=lambda x: (x[1], x[2], x[0]))

    def batch(self, ids: pa.Array, texts: pa.Array) -> pa.RecordBatch:
        words = textbuf.words(*textbuf.as_texts(texts), textbuf.ALNUM)
        flat, at = textbuf.spaced(words)
        body = flat.tobytes()
        kinds = [("label", pa.string()), ("first_char", pa.int32()), ("last_char", pa.int32()), ("first_word", pa.int32()), ("n_words", pa.int32()), ("edits", pa.int32()), ("exact", pa.bool_())]
        rows: list[tuple] = []
        offsets = [0]
        for i in range(len(texts)):
            a, b = words.first[i], words.first[i + 1]
            text = body[at[a] : at[b] - 1].decode() if b > a else ""
            found = self.spans(text)
            blanks = np.flatnonzero(np.fromiter(map(" ".__eq__, text), bool, len(text))) if found else ()
            for k, s, e, edits in found:
                before, upto = np.searchsorted(blanks, (s, e))
                rows.append((self.notices[k].label, s, e, int(before), int(upto - before) + 1, edits, edits == 0))
            offsets.append(len(rows))
        values = pa.StructArray.from_arrays([pa.array([r[j] for r in rows], t) for j, (_, t) in enumerate(kinds)], fields=[pa.field(n, t) for n, t in kinds])
        return pa.RecordBatch.from_arrays([ids, pa.array(words.counts.astype(np.int64)), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)], names=["doc_id", "n_words", "spans"])


def notices_of(table: DataFrame) -> tuple[Notice, ...]:
    """Notices from a table phrase, label, edits, core (array of words, null: none); no more than MOST_NOTICES.

    Phrases are lower-cased and reduced to their words, as texts are. An error is
    raised for phrases without words, and for more edits than a phrase has pieces for.
    """
    rows = table.select("phrase", "label", "edits", "core").limit(MOST_NOTICES + 1).collect()
    if len(rows) > MOST_NOTICES:
        raise ValueError(f"more than {MOST_NOTICES} notices")
    out = []
    for r in sorted(rows, key=lambda r: (r.label, r.phrase)):
        flat, _ = textbuf.spaced(textbuf.words(*textbuf.as_texts(pa.array([r.phrase])), textbuf.ALNUM))
        phrase = flat.tobytes().decode().strip(" ")
        if not phrase or not 0 <= r.edits < len(phrase) // 4:
            raise ValueError(f"{r.label}: {r.phrase!r} within {r.edits} edits")
        out.append(Notice(phrase, r.label, r.edits, tuple(r.core or ())))
    return tuple(out)


def license_spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", notices: tuple[Notice, ...] = NOTICES) -> DataFrame:
    """Per document: doc_id, n_words, spans of notices.

    A text is lower-cased (A-Z) and reduced to its words of ASCII letters, digits and
    characters beyond ASCII, single-spaced; characters and words of a span are counted
    in that form, from 0. exact: word for word; such places are all reported, also
    where they overlap. Else the span is whole words within the notice's edits that
    hold its core words; of such spans of one notice that overlap, that with the fewest
    edits (then the first) is reported. Null and empty texts have no words and no spans; long texts
    are searched whole; repeated rows each count; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(notices)
        for batch in batches:
            for part in textbuf.pieces(batch, "text"):
                yield scanner.batch(part.column("doc_id"), part.column("text"))

    return bare(docs, doc_id=id_col, text=text_col).mapInArrow(run, SCHEMA)
