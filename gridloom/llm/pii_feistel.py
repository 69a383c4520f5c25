"""Format-preserving pseudonyms for personal data, by a keyed Feistel permutation.

A value is found by pattern and validated (check digit, ranges, calendar). What
varies in it is read as digits of mixed radices, so as one number below their
product N; a Feistel network over two factors of at least N, walked until the
result is below N again, permutes these numbers by key and kind. The result is
written back in the same format with a valid check digit. Equal values become
equal pseudonyms in every document, and the key holder can undo them.

Kinds: email (letters and digits of the local part, each within its class),
card (13 to 19 digits with a Luhn digit; the issuer's first digit stays), iban
(plain or in groups of four; check digits made anew), ssn, phone (+ and 7 to 15
digits, the country code stays; or three, three and four digits), ip (IPv4), date
(1900 to 2099, as year-month-day, year/month/day, day/month/year or, where that is no date,
month/day/year, also with dots or hyphens and with fields of one digit).

Defined results: null text stays null. Numbers that fail validation stay as they
are. Matches are leftmost; where kinds overlap the first listed that is valid
wins. Of digits in groups, the longest valid run of 13 to 19 that starts and ends
at group borders is a card, so a card beside other numbers is found. To undo, the
spans column is read if it is there; without it the places are looked for again,
and beside other numbers a pseudonym may by chance be read as another run. A column
that has the name of the spans column is replaced.
Rows pass one by one, whole; empty tables give no rows. All other columns are kept.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import hmac
import math
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from gridloom.llm.common import need_columns

#: Rounds of the network.
ROUNDS = 8
KINDS = ("email", "iban", "card", "ssn", "phone", "ip", "date")
#: What a value of each kind looks like.
FORMS = {
    "email": r"(?<![\w.+-])[A-Za-z0-9_.+-]+@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63})+",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,4})?)(?![A-Za-z0-9])",
    "card": r"(?<![\w.-])\d(?:[ -]?\d){12,18}(?![\w-]|\.\d)",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "phone": r"(?<![\w+])\+\d{1,3}[ .-]?\(\d{1,4}\)(?:[ .-]?\d){4,10}(?![\w-]|\.\d)|(?<![\w+])\+\d(?:[ .-]?\d){6,14}(?![\w-]|\.\d)"
    r"|(?<![\w+-])\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}(?![\w-])|(?<![\w.+-])\d{3}(?:-\d{3}-|\.\d{3}\.| \d{3} )\d{4}(?![\w-]|\.\d)",
    "ip": r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?!\w|\.\d)",
    "date": r"(?<![\w-])\d{4}-\d{2}-\d{2}(?![\w-])|(?<![\w/-])\d{4}/\d{2}/\d{2}(?![\w/-])|(?<![\w/.-])\d{1,2}(?:/\d{1,2}/|\.\d{1,2}\.|-\d{1,2}-)\d{4}(?![\w/-]|\.\d)",
}
PATTERN = re.compile("|".join(f"(?P<{k}>{p})" for k, p in FORMS.items()), re.A)
#: Country codes of one and of two digits (E.164); all others have three.
COUNTRY = re.compile(r"\+(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})")
#: Digits in groups, whole, from where a card starts; and a card behind a hyphen within such groups.
GROUPS = re.compile(r"\d+(?:[ -]\d+)*", re.A)
LATER_CARD = re.compile(r"(?<=\d-)\d(?:[ -]?\d){12,18}(?![\w-]|\.\d)|(?<=\d-)\d(?:[ -]?\d){12,18}(?=-\d)", re.A)
ONE = {k: re.compile(rf"(?P<{k}>{p})", re.A) for k, p in FORMS.items()}
FIRST_DAY, DAYS = dt.date(1900, 1, 1), (dt.date(2100, 1, 1) - dt.date(1900, 1, 1)).days


class Permutation:
    """A keyed permutation of the numbers below n."""

    def __init__(self, key: bytes, kind: str, n: int):
        self.key, self.kind, self.n = key, kind.encode(), n
        self.a = math.isqrt(n - 1) + 1 if n > 1 else 1
        self.b = -(-n // self.a)

    def _f(self, step: int, half: int, size: int) -> int:
        said = b"%s|%d|%d|%d" % (self.kind, self.n, step, half)
        return int.from_bytes(hmac.digest(self.key, said, hashlib.sha256), "big") % size

    def _once(self, x: int, back: bool) -> int:
        left, right = divmod(x, self.b)
        for step in reversed(range(ROUNDS)) if back else range(ROUNDS):
            sign = -1 if back else 1
            if step % 2:
                right = (right + sign * self._f(step, left, self.b)) % self.b
            else:
                left = (left + sign * self._f(step, right, self.a)) % self.a
        return left * self.b + right

    def __call__(self, x: int, back: bool = False) -> int:
        x = self._once(x, back)
        while x >= self.n:
            x = self._once(x, back)
        return x


def _alphabet(c: str) -> str:
    if c.isdigit():
        return "0123456789"
    return "ABCDEFGHIJKLMNOPQRSTUVWXYZ" if c.isupper() else "abcdefghijklmnopqrstuvwxyz"


def luhn_digit(payload: str) -> str:
    """The check digit that makes payload a valid card number."""
    total = 0
    for i, c in enumerate(reversed(payload)):
        x = int(c) * (1 if i % 2 else 2)
        total += x - 9 if x > 9 else x
    return str(-total % 10)


def _mod97(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text)) % 97


class Pseudonyms:
    def __init__(self, key: bytes):
        self.key = key
        self.of = lru_cache(maxsize=50_000)(self._of)

    def _radices(self, kind: str, text: str, back: bool) -> str:
        """Permutes the letters and digits of text, each within its class; the rest stays."""
        alphabets = [_alphabet(c) if c.isalnum() else c for c in text]
        n = math.prod(map(len, alphabets))
        x = 0
        for c, a in zip(text, alphabets):
            x = x * len(a) + a.index(c)
        x, out = Permutation(self.key, kind, n)(x, back), []
        for a in reversed(alphabets):
            x, r = divmod(x, len(a))
            out.append(a[r])
        return "".join(reversed(out))

    def _of(self, kind: str, value: str, back: bool = False) -> str | None:
        """The pseudonym of a value (or the value of a pseudonym); None if it is not valid."""
        return getattr(self, "_" + kind)(value, back)

    def _email(self, value: str, back: bool) -> str | None:
        local, _, domain = value.partition("@")
        return f"{self._radices('email', local, back)}@{domain}"

    def _iban(self, value: str, back: bool) -> str | None:
        bare = value.replace(" ", "")
        if not 15 <= len(bare) <= 34 or _mod97(bare[4:] + bare[:4]) != 1:
            return None
        rest = self._radices("iban", value[4:], back)
        return f"{value[:2]}{98 - _mod97(rest.replace(' ', '') + value[:2] + '00'):02d}{rest}"

    def _card(self, value: str, back: bool) -> str | None:
        digits = re.sub(r"\D", "", value)
        if luhn_digit(digits[:-1]) != digits[-1] or len(set(digits)) == 1:
            return None
        body = digits[0] + self._radices("card", digits[1:-1], back)
        new = iter(body + luhn_digit(body))
        return re.sub(r"\d", lambda _: next(new), value)

    def _ssn(self, value: str, back: bool) -> str | None:
        """Area 001 to 899 but 666, group 01 to 99, serial 0001 to 9999."""
        area, group, serial = map(int, value.split("-"))
        if area in (0, 666) or area > 899 or not group or not serial:
            return None
        x = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
        x, serial = divmod(Permutation(self.key, "ssn", 898 * 99 * 9999)(x, back), 9999)
        area, group = divmod(x, 99)
        area += 1 + (area >= 665)
        return f"{area:03d}-{group + 1:02d}-{serial + 1:04d}"

    def _phone(self, value: str, back: bool) -> str | None:
        """The digits after the country code."""
        found = COUNTRY.match(value)
        at = value.index("(") if "(" in value else found.end() if found else 0
        return value[:at] + self._radices("phone", value[at:], back)

    def _ip(self, value: str, back: bool) -> str | None:
        parts = value.split(".")
        if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
            return None
        x = Permutation(self.key, "ip", 1 << 32)(int.from_bytes(bytes(map(int, parts)), "big"), back)
        return ".".join(map(str, x.to_bytes(4, "big")))

    def _date(self, value: str, back: bool) -> str | None:
        """Day before month, or else month before day. A field of one digit stays one, and a day that
        stands second stays over 12, so that a pseudonym is read as its value is."""
        fields = re.split(r"[/.-]", value)
        year_first = len(fields[0]) == 4
        y, m, d = map(int, fields if year_first else fields[::-1])
        month_first = not year_first and m > 12
        if month_first:
            m, d = d, m
        try:
            day = (dt.date(y, m, d) - FIRST_DAY).days
        except ValueError:
            return None
        if not 0 <= day < DAYS:
            return None
        permutation = Permutation(self.key, "date", DAYS)
        while True:
            day = permutation(day, back)
            new = FIRST_DAY + dt.timedelta(day)
            made = [new.year, new.month, new.day] if year_first else [new.month, new.day, new.year] if month_first else [new.day, new.month, new.year]
            written = [f"{x:0{len(f)}d}" for x, f in zip(made, fields)]
            if list(map(len, written)) == list(map(len, fields)) and not (month_first and new.day <= 12):
                rest = iter(written)
                return re.sub(r"\d+", lambda _: next(rest), value)

    def _at(self, text: str, start: int, kind: str, end: int, back: bool) -> tuple[int, str, str] | None:
        """End, kind and pseudonym of what starts here, of a match of this kind and end: its
        first valid reading, the longest first, or else a valid value of a later kind."""
        while True:
            ends = [end]
            if kind == "iban":  # a word behind may look like a group
                ends += [start + m.start() for m in re.finditer(" ", text[start:end])]
            if kind == "card":  # the groups may go on behind the match
                ends += [start + m.start() for m in re.finditer("[ -]", text[start : GROUPS.match(text, start).end()])]
            for e in sorted(set(ends), reverse=True):
                if kind == "card" and not 13 <= sum(c.isdigit() for c in text[start:e]) <= 19:
                    continue
                new = self.of(kind, text[start:e], back)
                if new is not None:
                    return e, kind, new
            m = next((m for k in KINDS[KINDS.index(kind) + 1 :] if (m := ONE[k].match(text, start))), None)
            if m is None:
                return None
            kind, end = m.lastgroup, m.end()

    def find(self, text: str, back: bool = False):
        """start, end, kind and pseudonym of each valid value."""
        at, groups_end = 0, 0
        while m := PATTERN.search(text, at):
            start, kind, end = m.start(), m.lastgroup, m.end()
            later = LATER_CARD.search(text, at, groups_end) if at < groups_end else None
            if later and later.start() < start:
                start, kind, end = later.start(), "card", later.end()
            if kind == "card":
                groups_end = max(groups_end, GROUPS.match(text, start).end())
            found = self._at(text, start, kind, end, back)
            if found:
                yield start, *found
            at = found[0] if found else start + 1

    def replace(self, text: str, back: bool = False, spans: list | None = None) -> tuple[str, list[tuple[int, int, str]]]:
        """The text with pseudonyms, and start, end and kind of each in the result. Where
        the places are given (to undo), they are not looked for."""
        out, made, at, length = [], [], 0, 0
        known = None if spans is None else ((s["start"], s["end"], s["kind"], self.of(s["kind"], text[s["start"] : s["end"]], back)) for s in spans)
        for start, end, kind, new in self.find(text, back) if known is None else known:
            out += (text[at:start], new)
            length += start - at
            made.append((length, length + len(new), kind))
            length, at = length + len(new), end
        out.append(text[at:])
        return "".join(out), made


_made: dict[bytes, Pseudonyms] = {}


def pseudonymise(docs: DataFrame, key: bytes, text: str = "text", spans: str = "pii", back: bool = False) -> DataFrame:
    """All columns, the text with pseudonyms, and an array of their spans (start, end, kind)."""
    need_columns(docs, text)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))

    given = back and spans in docs.columns
    docs = docs if given else docs.drop(spans)

    def run(batches):
        own = _made.setdefault(key, Pseudonyms(key))
        for batch in batches:
            at = batch.schema.get_field_index(text)
            places = batch.column(batch.schema.get_field_index(spans)).to_pylist() if given else [None] * batch.num_rows
            made = [(None, []) if t is None else own.replace(t, back, p) for t, p in zip((v.as_py() for v in batch.column(at)), places)]
            columns = {n: c for n, c in zip(batch.schema.names, batch.columns)}
            columns[text] = pa.array([m[0] for m in made], pa.string())
            columns[spans] = pa.array([[{"start": a, "end": b, "kind": k} for a, b, k in m[1]] for m in made], kind)
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.schema if not (given and f.name == spans))
    if given:
        docs = docs.select(*[c for c in docs.columns if c != spans], spans)
    return docs.mapInArrow(run, f"{kept}`{spans}` array<struct<start:int,end:int,kind:string>>")
