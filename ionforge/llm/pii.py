"""Operator 9, format-preserving Feistel pseudonyms for personal data.

Numbers and dates are found by pattern and validated (Luhn, mod 97, octets,
numbering plans, the calendar).  Each is then read as a number within its
format's domain, permuted by a keyed Feistel network with cycle walking, and
written back in the same format: a card stays a valid card, a date a date, and
separators stay.  The permutation depends on key and kind only, so equal
values have equal pseudonyms in all documents, and different values have
different ones.  E-mail names and secrets are permuted character class by
character class in the same way.

A secret is the value behind a word such as ``password``, or a token that
begins as well-known ones do; either has a digit, a letter and enough different
characters, so that words are left alone.  A number such as 10.1.2.3 behind the
word ``version`` is no address.  A North American number behind +1 whose area
or exchange begins with 0 or 1 can't be dialled, but is taken for personal data
all the same, and stays among such numbers.  Where a card's or account's digits
are followed by more groups, shorter ends are tried.

Rows are handled alone: nothing is shuffled, and time is linear in a text's
length.  Defined results: null text stays null with no findings; empty text
stays empty; repeated rows get equal results; null ids are carried; an empty
table gives an empty result.  Extra columns are carried along by
:func:`pseudonymise`; one by the name of the result is kept as ``<name>_in``.
"""

from __future__ import annotations

import datetime
import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import kept_apart, sliced, spread, with_workers

KINDS = ("email", "secret", "date", "ip", "card", "phone", "iban", "ssn")

#: Patterns of candidates; validation follows. The order is that of KINDS.
PATTERN = re.compile(
    r"""(?P<email>(?<![\w.+-])[A-Za-z0-9][A-Za-z0-9._+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)
    |(?P<secret>(?i:\b(?:token|key|api_key|apikey|secret|password|passwd)\b)\s*[=:]\s*["']?[A-Za-z0-9](?:[\w!+/.~\#$%^&*-]*[A-Za-z0-9])["']?
        |\b(?:sk-|gh[pousr]_|xox[abprs]-|AKIA|ASIA)[A-Za-z0-9](?:[\w-]*[A-Za-z0-9]))
    |(?P<date>(?<![\w./-])(?:\d{4}(?P<s1>[-/.])\d{2}(?P=s1)\d{2}|\d{2}(?P<s2>[-/.])\d{2}(?P=s2)\d{4})(?!(?!T\d)[\w/-]|\.\d))
    |(?P<ip>(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?![\w]|\.\d))
    |(?P<card>(?<![\w.-])\d(?:[ -]?\d){12,18}(?![\w]|[.-]\d))
    |(?P<phone>(?<![\w.])(?:\+1[ .-]?)?(?:\(\d{3}\)[ .-]?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\w)|\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?!\w))
    |(?P<iban>\b[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,4})?\b)
    |(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))""",
    re.VERBOSE | re.ASCII,
)
#: A text without these has no finding.
HINT = re.compile(r"[0-9@]")
#: A secret's own characters, behind its name or its usual beginning.
SECRET = re.compile(r"""((?:.*?[=:]\s*["']?)|sk-|gh[pousr]_|xox[abprs]-|AKIA|ASIA)([^"']+)(["']?)$""", re.DOTALL)
#: Least characters of a secret, and least bits a character by their own frequencies.
SECRET_CHARS, SECRET_BITS = 10, 2.5
#: What stands before four numbers that are no address.
VERSION = re.compile(r"(?:version|ver\.?|release|build|firmware)[\s:=#]*$", re.IGNORECASE)
DAY0, DAYS = datetime.date(1900, 1, 1).toordinal(), 73414
ROUNDS = 8


class Feistel:
    """A keyed permutation of 0 .. n-1 for any n, by a balanced Feistel network and cycle walking."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()
        self.known: dict = {}

    def _round(self, tag: bytes, r: int, x: int, half: int) -> int:
        h = hashlib.blake2b(x.to_bytes((half + 7) // 8, "big"), digest_size=(half + 7) // 8 if half <= 512 else 64, key=self.key, person=tag[:15] + bytes([r]))
        return int.from_bytes(h.digest(), "big") & ((1 << half) - 1)

    def permute(self, x: int, n: int, tag: bytes) -> int:
        if n < 2:
            return x
        half = max(1, ((n - 1).bit_length() + 1) // 2)
        while True:
            a, b = x >> half, x & ((1 << half) - 1)
            for r in range(ROUNDS):
                a, b = b, a ^ self._round(tag, r, b, half)
            x = a << half | b
            if x < n:
                return x

    def chars(self, s: str, tag: bytes) -> str:
        """Permute a string of letters and digits within their classes; in pieces of 64 characters, each under its number."""
        if len(s) > 64:
            return "".join(self.chars(s[i : i + 64], tag[:10] + bytes([i // 64 % 256])) for i in range(0, len(s), 64))
        bases = [10 if c.isdigit() else 26 for c in s]
        x, n = 0, 1
        for c, b in zip(s, bases, strict=True):
            x, n = x * b + (ord(c) - ord("0" if c.isdigit() else "a" if c.islower() else "A")), n * b
        x, out = self.permute(x, n, tag), []
        for c, b in zip(reversed(s), reversed(bases), strict=True):
            x, d = divmod(x, b)
            out.append(chr(d + ord("0" if c.isdigit() else "a" if c.islower() else "A")))
        return "".join(reversed(out))


def luhn(digits: str) -> bool:
    return _luhn_sum(digits) % 10 == 0


def _luhn_sum(digits: str) -> int:
    return sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(map(int, reversed(digits))))


def _refill(shape: str, chars: str) -> str:
    it = iter(chars)
    return "".join(next(it) if c.isalnum() else c for c in shape)


def _mod97(iban: str) -> int:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def pseudonym(kind: str, value: str, f: Feistel) -> str | None:
    """The pseudonym of a candidate, or None if it isn't valid."""
    digits = "".join(c for c in value if c.isdigit())
    if kind == "card":
        if not 13 <= len(digits) <= 19 or not luhn(digits) or not int(digits):
            return None
        n = len(digits) - 1
        body = str(f.permute(int(digits[:-1]), 10**n, b"card%d" % n)).zfill(n)
        return _refill(value, body + str(-_luhn_sum(body + "0") % 10))
    if kind == "ip":
        octets = list(map(int, value.split(".")))
        if max(octets) > 255 or any(len(o) > 1 and o[0] == "0" for o in value.split(".")):
            return None
        x = f.permute(int.from_bytes(bytes(octets), "big"), 2**32, b"ip")
        return ".".join(map(str, x.to_bytes(4, "big")))
    if kind == "date":
        sep = next(c for c in value if not c.isdigit())
        a = value.split(sep)
        iso = len(a[0]) == 4
        y, m, d = map(int, a if iso else a[::-1])
        swapped = not iso and m > 12 >= d
        if swapped:
            m, d = d, m
        try:
            x = datetime.date(y, m, d).toordinal() - DAY0
        except ValueError:
            return None
        if not 0 <= x < DAYS:
            return None
        t = datetime.date.fromordinal(DAY0 + f.permute(x, DAYS, b"date"))
        if iso:
            return f"{t.year:04d}{sep}{t.month:02d}{sep}{t.day:02d}"
        one, two = (t.month, t.day) if swapped else (t.day, t.month)
        return f"{one:02d}{sep}{two:02d}{sep}{t.year:04d}"
    if kind == "phone":
        nanp = digits[1:] if len(digits) == 11 and digits[0] == "1" else digits
        if len(nanp) == 10 and (value[0] != "+" or digits[0] == "1"):
            if nanp[0] in "01" or nanp[3] in "01":
                if value[0] != "+":
                    return None
                x = int(nanp)
                while True:  # walk on to the next number that can't be dialled either
                    x = f.permute(x, 10**10, b"tel0")
                    t = f"{x:010d}"
                    if t[0] in "01" or t[3] in "01":
                        return _refill(value, digits[0] + t)
            x = ((int(nanp[0]) - 2) * 100 + int(nanp[1:3])) * 800 + (int(nanp[3]) - 2) * 100 + int(nanp[4:6])
            x = f.permute(x * 10000 + int(nanp[6:]), 800 * 800 * 10000, b"nanp")
            x, line = divmod(x, 10000)
            area, exchange = divmod(x, 800)
            return _refill(value, digits[: len(digits) - 10] + f"{area + 200}{exchange + 200}{line:04d}")
        if value[0] != "+" or not 8 <= len(digits) <= 15:
            return None
        head = re.match(r"\+(\d{1,3}?)(?=[ .-])|\+(\d{2})", value)
        code = head[1] or head[2]
        n = len(digits) - len(code)
        return _refill(value, code + str(f.permute(int(digits[len(code) :]), 10**n, b"tel%d" % n)).zfill(n))
    if kind == "ssn":
        a, b, c = map(int, value.split("-"))
        if a in (0, 666) or a >= 900 or not b or not c:
            return None
        area = a - 1 - (a > 666)
        x = f.permute((area * 99 + b - 1) * 9999 + c - 1, 898 * 99 * 9999, b"ssn")
        x, c = divmod(x, 9999)
        a, b = divmod(x, 99)
        return f"{a + 1 + (a >= 665):03d}-{b + 1:02d}-{c + 1:04d}"
    if kind == "iban":
        plain = value.replace(" ", "")
        if not 15 <= len(plain) <= 34 or _mod97(plain) != 1:
            return None
        body = f.chars(plain[4:], b"iban" + plain[:2].encode())
        check = 98 - _mod97(plain[:2] + "00" + body)
        return _refill(value, f"{plain[:2]}{check:02d}{body}")
    if kind == "email":
        name, _, domain = value.partition("@")
        parts = re.split(r"([._+-])", name)
        shape = "".join(c for p in parts[::2] for c in p)
        return _refill(name, f.chars(shape, b"email")) + "@" + domain
    name, raw, quote = SECRET.match(value).groups()
    if not is_secret(raw):
        return None
    if re.fullmatch(r"[0-9a-f]+", raw) and len(raw) <= 128:
        x = f.permute(int(raw, 16), 16 ** len(raw), b"hex%d" % len(raw))
        return name + f"{x:x}".zfill(len(raw)) + quote
    return name + _refill(raw, f.chars("".join(c for c in raw if c.isalnum()), b"secret")) + quote


def is_secret(raw: str) -> bool:
    """Are there enough characters, a letter and a digit among them, and enough different ones?"""
    if len(raw) < SECRET_CHARS or not any(c.isdigit() for c in raw) or not any(c.isalpha() for c in raw):
        return False
    n = len(raw)
    return -sum(k / n * math.log2(k / n) for k in Counter(raw).values()) >= SECRET_BITS


def _shorter(kind: str, value: str):
    """The value and, where groups may follow that are not part of it, its shorter ends."""
    yield value
    if kind in ("card", "iban"):
        for i in range(len(value) - 1, 12, -1):
            if value[i] == " ":
                yield value[:i]


def replace(text: str, f: Feistel) -> tuple[str, list[tuple[str, int, int, str]]]:
    """The text with pseudonyms, and (kind, start, end, pseudonym) of each finding in the old text."""
    if not HINT.search(text):
        return text, []
    out, spans, last, at = [], [], 0, 0
    while m := PATTERN.search(text, at):
        kind = next(k for k in KINDS if m[k] is not None)
        new = None
        if kind != "ip" or not VERSION.search(text, max(0, m.start() - 16), m.start()):
            for value in _shorter(kind, m[0]):
                key = (kind, value)
                if key not in f.known:
                    if len(f.known) > 100_000:
                        f.known.clear()
                    f.known[key] = pseudonym(kind, value, f)
                new = f.known[key]
                if new is not None:
                    break
        if new is None:
            at = m.start() + 1
            # go on behind the letters or digits that were tried, not within them
            while at < len(text) and text[at].isalnum() and at < m.end():
                at += 1
            continue
        end = m.start() + len(value)
        out += [text[last : m.start()], new]
        spans.append((kind, m.start(), end, new))
        last = at = end
    return "".join(out) + text[last:] if spans else text, spans


def pseudonymise(df: DataFrame, key: str, text_col: str = "text", result: str = "pii_spans") -> DataFrame:
    """All columns of ``df`` with the text replaced, and ``result``, the spans of what was found."""
    with_workers(df.sparkSession)
    df = kept_apart(df, result)
    schema = T.StructType([*df.schema.fields, T.StructField(result, T._parse_datatype_string("array<struct<kind:string,start:int,end:int,pseudonym:string>>"))])
    names = df.columns
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("pseudonym", pa.string())]))

    def run(batches):
        f = Feistel(key.encode())
        for b in sliced(batches):
            texts, found = [], []
            for t in b.column(names.index(text_col)).to_pylist():
                t, s = (None, []) if t is None else replace(t, f)
                texts.append(t)
                found.append([dict(zip(("kind", "start", "end", "pseudonym"), x, strict=True)) for x in s])
            cols = [pa.array(texts, b.column(i).type) if n == text_col else b.column(i) for i, n in enumerate(names)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(found, span)], [*names, result])

    return spread(df).mapInArrow(run, schema)
