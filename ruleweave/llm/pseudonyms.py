"""Personal data replaced by pseudonyms of the same form.

A value's variable characters are one number of a known range, and a keyed Feistel
network permutes that range: a card number becomes another valid card number, a date
another date. Equal values become equal pseudonyms in every document, and the key's
holder can turn them back. Only values that pass their form's checks are touched.
"""

from __future__ import annotations

import bisect
import datetime
import hashlib
import ipaddress
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import textbuf
from .shared import bare

ROUNDS = 10
#: Characters around a digit or @ that are searched; no value has a longer part without either, but for white space to cut at.
REACH = 64
_SIGN = re.compile("[0-9@]+")
_BLANK = re.compile("[ \n\t]")
#: What makes four numbers with points between them a version.
_VERSION = re.compile(r"(?i)\b(?:v|ver|version|release|rev|build)[ .:]*$")
#: Digits, and letters of ASCII and Latin-1 by case.
_ALPHABETS = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "".join(chr(c) for c in range(0xDF, 0x100) if c != 0xF7), "".join(chr(c) for c in range(0xC0, 0xDF) if c != 0xD7))
KINDS = ("email", "phone", "ip", "card", "iban", "ssn", "date", "secret")
#: How cards are written, by digits of their groups, besides in one; looked for before all other groups of 13 to 19 digits.
_CARD_FORMS = {(4, 4, 4, 4), (4, 6, 5), (4, 6, 4)}
_CARD_DIGITS = 19
#: The first and last day that counts as a date.
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1), datetime.date(2099, 12, 31)


def permute(x: int, size: int, key: bytes, tweak: str, back: bool = False) -> int:
    """A keyed permutation of 0 .. size - 1: a Feistel network over a x b >= size, repeated until within the range."""
    if size < 2:
        return x
    a = int(size**0.5) if size < 1 << 52 else 1 << ((size.bit_length() + 1) // 2)
    b = -(-size // a)

    def part(step: int, right: int, modulus: int) -> int:
        body = f"{tweak}|{size}|{step}|{right}".encode()
        n = (modulus.bit_length() + 7) // 8 + 8
        return int.from_bytes(hashlib.shake_256(key + b"|" + body).digest(n), "big") % modulus

    while True:
        left, right = divmod(x, b)  # left below a, right below b
        for step in reversed(range(ROUNDS)) if back else range(ROUNDS):
            sign = -1 if back else 1
            if step % 2:
                right = (right + sign * part(step, left, b)) % b
            else:
                left = (left + sign * part(step, right, a)) % a
        x = left * b + right
        if x < size:
            return x


def _digits(value: str, new: str) -> str:
    """value with its digits replaced one by one."""
    it = iter(new)
    return "".join(next(it) if c.isdigit() else c for c in value)


def _luhn(payload: str) -> str:
    total = sum(d if i % 2 else sum(divmod(2 * d, 10)) for i, d in enumerate(map(int, reversed(payload))))
    return str(-total % 10)


def _inside(places: dict[int, int], s: int) -> bool:
    """Whether a place begins before group s and ends after it."""
    return any(places.get(i, 0) > s for i in range(s - _CARD_DIGITS, s))


def _card_at(groups: list[str], gaps: str, s: int, usable: int, usual: bool, taken: dict[int, int]) -> int:
    """The end of the card that begins with group s, the longest if there are several; 0: none.

    Of an unusual form it is the whole run, or has spaces only or dashes only and at
    least three digits before each: a date or a list beside a number is no part of it.
    """
    best = total = 0
    if groups[s][0] == "0":
        return 0
    for e in range(s, usable):
        total += len(groups[e])
        if total > _CARD_DIGITS or e in taken:
            break
        form = tuple(map(len, groups[s : e + 1]))
        alike = (len(set(gaps[s:e])) < 2 and min(form[:-1], default=3) > 2) or (s == 0 and e + 1 == len(groups))
        if total > 12 and (len(form) == 1 or form in _CARD_FORMS) == usual and (usual or alike):
            plain = "".join(groups[s : e + 1])
            if _luhn(plain[:-1]) == plain[-1]:
                best = e + 1
    return best


def _card_places(groups: list[str], gaps: str, usable: int) -> tuple[dict[int, int], dict[int, int]]:
    """Where cards stand, first group: end; those of a usual form first, others in what is left, both from the left."""
    found: list[dict[int, int]] = []
    taken: dict[int, int] = {}
    for usual in (True, False):
        places, i = {}, 0
        while i < usable:
            if i in taken:
                i = taken[i]
            elif end := _card_at(groups, gaps, i, usable, usual, taken):
                places[i] = end
                i = end
            else:
                i += 1
        found.append(places)
        taken = places
    return found[0], found[1]


class Pseudonyms:
    """Finds and replaces values; back=True turns pseudonyms into what they stand for."""

    def __init__(self, key: bytes, back: bool = False):
        self.key, self.back = key, back
        d = r"(?<![\w.+-])"
        self.forms: list[tuple[str, re.Pattern, Callable[[str], str | None], str]] = [
            ("email", re.compile(r"(?<![\w.%+-])[\w.%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"), self.email, "@"),
            ("secret", re.compile(r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,128}|[0-9A-F]{32,128})(?![0-9A-Za-z])"), self.secret, ""),
            ("iban", re.compile(rf"{d}[A-Z]{{2}}\d{{2}}(?: ?[A-Z0-9]{{4}}){{2,7}}(?: ?[A-Z0-9]{{1,3}})?(?!\w)"), self.iban, ""),
            ("card", re.compile(r"(?<![\w.+])\d(?:[ -]?\d){12,}+"), self.card, ""),
            ("ip", re.compile(r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?![\w]|\.\d)"), self.ip, "."),
            ("phone", re.compile(r"(?<![\w])(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3}[ .-]\d{4}(?!\w)|(?<![\w.-])(?:\+\d{1,3}[ .-]?\d{3}[ .-]\d{3}[ .-]\d{4}|[2-9]\d{2}([ .-])[2-9]\d{2}\1\d{4})(?![\w-])|(?<!\w)\+\d{1,3}(?:[ .-]?\d{2,4}){2,4}(?!\w)"), self.phone, ""),
            ("ssn", re.compile(rf"{d}\d{{3}}-\d{{2}}-\d{{4}}(?![\w-])"), self.ssn, "-"),
            ("date", re.compile(rf"{d}(?:\d{{4}}-\d\d-\d\d|\d\d[/.]\d\d[/.]\d{{4}})(?![\w-])"), self.date, ""),
        ]

    def _p(self, x: int, size: int, kind: str) -> int:
        return permute(x, size, self.key, kind, self.back)

    def _alnum(self, value: str, kind: str) -> str:
        """Each character of an alphabet stays in it; the value as a whole is permuted, other characters stay."""
        at = [next((k for k, alphabet in enumerate(_ALPHABETS) if c in alphabet), None) for c in value]
        x, size = 0, 1
        for c, k in zip(value, at, strict=True):
            if k is not None:
                x, size = x * len(_ALPHABETS[k]) + _ALPHABETS[k].index(c), size * len(_ALPHABETS[k])
        x = self._p(x, size, f"{kind}|{''.join('-' if k is None else str(k) for k in at)}")
        out = list(value)
        for i in reversed([i for i, k in enumerate(at) if k is not None]):
            x, r = divmod(x, len(_ALPHABETS[at[i]]))
            out[i] = _ALPHABETS[at[i]][r]
        return "".join(out)

    def email(self, value: str) -> str:
        head, _, top = value.rpartition(".")  # the top-level domain stays
        return self._alnum(head, "email") + "." + top

    def secret(self, value: str) -> str | None:
        if value.isdigit():
            return None
        new = f"{self._p(int(value, 16), 16 ** len(value), 'secret'):0{len(value)}x}"
        return new.upper() if value.upper() == value else new

    def iban(self, value: str) -> str | None:
        plain = value.replace(" ", "")
        check = lambda country, rest: int("".join(str(int(c, 36)) for c in rest + country + "00"))
        if not 15 <= len(plain) <= 34 or int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 != 1:
            return None
        rest = self._alnum(plain[4:], "iban" + plain[:2])
        new = iter(f"{plain[:2]}{98 - check(plain[:2], rest) % 97:02d}{rest}")
        return "".join(c if c == " " else next(new) for c in value)

    def card(self, value: str) -> str | None:
        plain = re.sub("[ -]", "", value)
        if plain[0] == "0" or _luhn(plain[:-1]) != plain[-1]:
            return None
        n = len(plain) - 1
        body = str(self._p(int(plain[:-1]) - 10 ** (n - 1), 9 * 10 ** (n - 1), "card") + 10 ** (n - 1))
        return _digits(value, body + _luhn(body))

    def cards(self, run: str, closed: bool) -> list[tuple[int, int, str]]:
        """(start, end, new) of the cards in a run of digits, spaces and dashes; not closed: its last group goes on as something else.

        A new number that would make the run be read otherwise is permuted again, so
        that the way back finds the same places.
        """
        at = [m.span() for m in re.finditer(r"\d+", run)]
        groups = [run[a:b] for a, b in at]
        gaps = re.sub(r"\d", "", run)
        usable = len(groups) if closed else len(groups) - 1
        usual, other = _card_places(groups, gaps, usable)
        order = sorted({**usual, **other}.items(), reverse=self.back)
        for i, j in order:
            while True:
                groups[i:j] = self.card(" ".join(groups[i:j])).split(" ")
                near = range(max(0, i - _CARD_DIGITS), j)
                if all(_card_at(groups, gaps, s, usable, True, {}) == usual.get(s, 0) for s in near if not _inside(usual, s)) and (
                    i in usual or all(_card_at(groups, gaps, s, usable, False, usual) == other.get(s, 0) for s in near if s not in usual and not _inside(usual, s) and not _inside(other, s))
                ):
                    break
        out = []
        for i, j in sorted(order):
            a, b = at[i][0], at[j - 1][1]
            out.append((a, b, _digits(run[a:b], "".join(groups[i:j]))))
        return out

    def changes(self, kind: str, change: Callable[[str], str | None], m: re.Match) -> list[tuple[int, int, str]]:
        """(start, end, new) of what changes in a match, counted from the match's start."""
        if kind == "card":
            return self.cards(m.group(), not re.match(r"[\w-]", m.string[m.end() : m.end() + 1]))
        if kind == "ip" and _VERSION.search(m.string[max(0, m.start() - 12) : m.start()]):
            return []
        new = change(m.group())
        return [] if new is None else [(0, len(m.group()), new)]

    def ip(self, value: str) -> str | None:
        try:
            x = int(ipaddress.IPv4Address(value))
        except ValueError:
            return None
        return str(ipaddress.IPv4Address(self._p(x, 1 << 32, "ip")))

    def phone(self, value: str) -> str | None:
        if value[0] not in "+(":  # a bare number: area and exchange stay such that it can be one
            a, b, c = value[:3], value[4:7], value[8:]
            x = self._p(((int(a) - 200) * 800 + int(b) - 200) * 10_000 + int(c), 800 * 800 * 10_000, "phone bare")
            x, c = divmod(x, 10_000)
            a, b = divmod(x, 800)
            return f"{a + 200}{value[3]}{b + 200}{value[7]}{c:04d}"
        country = re.match(r"\+\d{1,3}(?=[ .(-])|\+\d", value)
        head = country.group() if country else ""
        body = "".join(c for c in value[len(head) :] if c.isdigit())
        if not 7 <= len(body) <= 14:
            return None
        return head + _digits(value[len(head) :], f"{self._p(int(body), 10 ** len(body), 'phone'):0{len(body)}d}")

    def ssn(self, value: str) -> str | None:
        area, group, serial = map(int, value.split("-"))
        if area in (0, 666) or area >= 900 or not group or not serial:
            return None
        x = self._p(((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1, 898 * 99 * 9999, "ssn")
        x, serial = divmod(x, 9999)
        area, group = divmod(x, 99)
        area += 1 + (area + 1 >= 666)
        return f"{area:03d}-{group + 1:02d}-{serial + 1:04d}"

    def date(self, value: str) -> str | None:
        orders = ["%Y-%m-%d"] if value[4:5] == "-" else [f"%d{value[2]}%m{value[5]}%Y", f"%m{value[2]}%d{value[5]}%Y"]
        for form in orders:
            try:
                day = datetime.datetime.strptime(value, form).date()
            except ValueError:
                continue
            if FIRST_DAY <= day <= LAST_DAY:
                if len(orders) > 1 and (day.day > 12) is False:  # both orders can be read: stay where both can
                    size = (LAST_DAY.year - FIRST_DAY.year + 1) * 144
                    x = self._p((day.year - FIRST_DAY.year) * 144 + (day.month - 1) * 12 + day.day - 1, size, "date both")
                    return datetime.date(FIRST_DAY.year + x // 144, x % 144 // 12 + 1, x % 12 + 1).strftime(form)
                days = _one_way_days() if len(orders) > 1 else None
                if days is not None:
                    return datetime.date.fromordinal(int(days[self._p(int(np.searchsorted(days, day.toordinal())), len(days), "date one")])).strftime(form)
                return (FIRST_DAY + datetime.timedelta(self._p((day - FIRST_DAY).days, (LAST_DAY - FIRST_DAY).days + 1, "date"))).strftime(form)
        return None

    def text(self, value: str) -> tuple[str, list[int]]:
        """The text with its values replaced, and how many of each kind.

        Every form has a digit or an @, and no two of them REACH apart, so only
        stretches around those are searched, cut at white space.
        """
        out, counts, done = [], [0] * len(KINDS), 0
        stretches: list[list[int]] = []
        for m in _SIGN.finditer(value):
            a, b = max(0, m.start() - REACH), m.end() + REACH
            if stretches and a <= stretches[-1][1]:
                stretches[-1][1] = b
            else:
                stretches.append([a, b])
        for a, b in stretches:
            if b <= done:
                continue
            blank = max(value.rfind(c, done, a + 1) for c in " \n\t")
            a = done if blank < 0 else blank
            blank = _BLANK.search(value, b)
            b = blank.start() if blank else len(value)
            new, n = self._stretch(value[a:b])
            out += [value[done:a], new]
            counts = [x + y for x, y in zip(counts, n, strict=True)]
            done = min(b, len(value))
        return "".join([*out, value[done:]]), counts

    def _stretch(self, value: str) -> tuple[str, list[int]]:
        counts = [0] * len(KINDS)
        held: list[str] = []

        def put(kind: str, new: str) -> str:
            counts[KINDS.index(kind)] += 1
            held.append(new)
            return f"\x00{chr(0xE000 + (len(held) - 1) // 0x1000)}{chr(0xE000 + (len(held) - 1) % 0x1000)}\x00"  # no form matches it

        if "\x00" in value:  # such texts are put together from left to right instead
            return self._by_spans(value)
        for kind, pattern, change, needs in self.forms:
            if needs in value:

                def swap(m: re.Match, kind: str = kind, change: Callable[[str], str | None] = change) -> str:
                    old, out, done = m.group(), [], 0
                    for a, b, new in self.changes(kind, change, m):
                        out += [old[done:a], put(kind, new)]
                        done = b
                    return "".join([*out, old[done:]])

                value = pattern.sub(swap, value)
        if held:
            value = re.sub("\x00(.)(.)\x00", lambda m: held[(ord(m[1]) - 0xE000) * 0x1000 + ord(m[2]) - 0xE000], value)
        return value, counts

    def _by_spans(self, value: str) -> tuple[str, list[int]]:
        counts, spans = [0] * len(KINDS), []  # in order and apart
        for kind, pattern, change, _ in self.forms:
            for m in pattern.finditer(value):
                for a, b, new in self.changes(kind, change, m):
                    a, b = a + m.start(), b + m.start()
                    at = bisect.bisect_right(spans, a, key=lambda x: x[1])
                    if at == len(spans) or spans[at][0] >= b:
                        spans.insert(at, (a, b, new))
                        counts[KINDS.index(kind)] += 1
        out, done = [], 0
        for a, b, new in spans:
            out += [value[done:a], new]
            done = b
        return "".join([*out, value[done:]]), counts


_DAYS: list[np.ndarray] = []


def _one_way_days() -> np.ndarray:
    """Days that can be read in one order of day and month only, as ordinals."""
    if not _DAYS:
        every = range(FIRST_DAY.toordinal(), LAST_DAY.toordinal() + 1)
        _DAYS.append(np.array([d for d in every if datetime.date.fromordinal(d).day > 12]))
    return _DAYS[0]


SCHEMA = "doc_id long, text string, n_replaced long, " + ", ".join(f"n_{k} long" for k in KINDS)


def pseudonymise(docs: DataFrame, *, key: bytes, id_col: str = "doc_id", text_col: str = "text", back: bool = False) -> DataFrame:
    """Per row: doc_id, text with pseudonyms, n_replaced, and n_<kind> for each of KINDS.

    Found are e-mail addresses, runs of 32 to 128 hexadecimal digits, IBANs (check
    digits), card numbers (Luhn), IPv4 addresses (not after "version" and the like), phone
    numbers (with + or brackets, or of ten digits in three groups with an area and an
    exchange that exist), US social security numbers and dates of 1900 to 2099; what
    fails its check is left alone, and so is every other character. A card may stand among other numbers, such as its expiry;
    usual forms go before others, and of several readings the first from the left.
    Null texts stay null, and empty ones empty; repeated values
    and rows change alike; long texts are read whole; other columns are ignored.
    back: undoes the replacement by the same key. key: secret bytes of the caller.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = Pseudonyms(key, back)
        for batch in batches:
            for part in textbuf.pieces(batch, "text"):
                raw, at = textbuf.as_texts(part.column("text"))
                some = np.concatenate(([0], np.cumsum((raw == 64) | ((raw >= 48) & (raw <= 57)))))
                texts, counts = part.column("text").to_pylist(), np.zeros((part.num_rows, len(KINDS)), np.int64)
                for i in np.flatnonzero(np.diff(some[at])):
                    texts[i], counts[i] = work.text(texts[i])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(texts, pa.string()), pa.array(counts.sum(1)), *(pa.array(c) for c in counts.T)], names=["doc_id", "text", "n_replaced", *(f"n_{k}" for k in KINDS)])

    return bare(docs, doc_id=id_col, text=text_col).mapInArrow(run, SCHEMA)
