"""Personal data replaced by format-preserving Feistel pseudonyms.

A validated value is read as a number within the set of all values of its format (digits of a card without its check
digit, days of a calendar, letters and digits of a mail address place by place), that set is permuted by a keyed
Feistel network with cycle walking, and the result is written back in the same format, with check digits made anew. So
equal values get equal pseudonyms in every document, different values stay different, and lengths, punctuation and
validity survive. A value written in several ways is one value: of a phone number the national digits are permuted and
the country stays, a date is a day whatever the order of its parts. Without the key the permutation cannot be undone.

The key is the session's spark.sheetweave.pii.key or the environment's SHEETWEAVE_PII_KEY. Where neither is set a key is
drawn for this program and forgotten with it: pseudonyms then link within its results only.
"""

from __future__ import annotations

import datetime
import hashlib
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetweave.llm.shared import column, free_name, pieces

ROUNDS = 8
#: Where the key is looked up.
KEY_CONF, KEY_ENV = "spark.sheetweave.pii.key", "SHEETWEAVE_PII_KEY"
_DRAWN = os.urandom(32)
_HEX = "0123456789abcdef"
_DAY0 = datetime.date(1900, 1, 1).toordinal()
_DAYS = datetime.date(2100, 1, 1).toordinal() - _DAY0


def key_of(spark: SparkSession) -> bytes:
    """The configured key, else the one drawn for this program."""
    given = spark.conf.get(KEY_CONF, None) or os.environ.get(KEY_ENV)
    return hashlib.blake2b(given.encode(), digest_size=32).digest() if given else _DRAWN


def permute(key: bytes, tweak: str, x: int, size: int) -> int:
    """A keyed permutation of 0 .. size - 1: a balanced Feistel network on the next even number of bits, walked until inside."""
    if size < 2:
        return x
    half = (max(2, (size - 1).bit_length()) + 1) // 2
    mask, width = (1 << half) - 1, (half + 7) // 8
    while True:
        a, b = x >> half, x & mask
        for i in range(ROUNDS):
            f = hashlib.blake2b(b"%d|%d|" % (i, size) + tweak.encode() + b.to_bytes(width, "big"), key=key, digest_size=max(8, width)).digest()
            a, b = b, a ^ (int.from_bytes(f, "big") & mask)
        x = a << half | b
        if x < size:
            return x


def luhn(digits: str) -> int:
    """The check digit that follows digits."""
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 else d * 2 - 9 * (d > 4)
    return -total % 10


def _classes(key: bytes, kind: str, value: str) -> str:
    """Letters and ASCII digits permuted together, place by place within their class; other characters stay."""
    sets = (_HEX,) if kind == "hex" else ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    alphabets = [next((a for a in sets if c in a), None) for c in value]
    x, size = 0, 1
    for c, a in zip(value, alphabets):
        if a:
            x, size = x * len(a) + a.index(c), size * len(a)
    # The tweak holds the format, so equal numbers of different formats are not related.
    x = permute(key, kind + "".join("." if a is None else str(len(a)) for a in alphabets), x, size)
    out = []
    for c, a in zip(reversed(value), reversed(alphabets)):
        if a:
            x, i = divmod(x, len(a))
            c = a[i]
        out.append(c)
    return "".join(reversed(out))


def _refill(value: str, digits: str) -> str:
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in value)


def _card(key: bytes, value: str) -> str | None:
    d = re.sub(r"\D", "", value)
    if not 13 <= len(d) <= 19 or luhn(d[:-1]) != int(d[-1]):
        return None
    body = f"{permute(key, f'card{len(d)}', int(d[:-1]), 10 ** (len(d) - 1)):0{len(d) - 1}d}"
    return _refill(value, body + str(luhn(body)))


def _ssn(key: bytes, value: str) -> str | None:
    area, group, serial = (int(x) for x in re.split(r"[- ]", value))
    if area in (0, 666) or area > 899 or not group or not serial:
        return None
    rank = area - 1 - (area > 666)
    x = permute(key, "ssn", (rank * 99 + group - 1) * 9999 + serial - 1, 898 * 99 * 9999)
    x, serial = divmod(x, 9999)
    rank, group = divmod(x, 99)
    return _refill(value, f"{rank + 1 + (rank >= 665):03d}{group + 1:02d}{serial + 1:04d}")


def _ip(key: bytes, value: str) -> str | None:
    parts = [int(x) for x in value.split(".")]
    if max(parts) > 255:
        return None
    x = permute(key, "ip", int.from_bytes(bytes(parts), "big"), 1 << 32)
    return ".".join(map(str, x.to_bytes(4, "big")))


def _iban(key: bytes, value: str) -> str | None:
    v = value.replace(" ", "")
    number = lambda s: int("".join(str(int(c, 36)) for c in s))
    if not 15 <= len(v) <= 34 or number(v[4:] + v[:4]) % 97 != 1:
        return None
    body = _classes(key, "iban" + v[:2], v[4:])
    new = iter(f"{v[:2]}{98 - number(body + v[:2] + '00') % 97:02d}{body}")
    return "".join(c if c == " " else next(new) for c in value)


#: Country codes of one and of two digits (fixed values); all others have three.
_COUNTRY_1 = ("1", "7")
_COUNTRY_2 = (
    "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98"
).split()


def _north_american(national: str) -> bool:
    """Ten digits whose area and exchange can be dialled."""
    return len(national) == 10 and national[0] in "23456789" and national[3] in "23456789"


def _phone(key: bytes, value: str) -> str | None:
    """The country and leading zeros stay; the national digits are permuted among those of the same length and plan."""
    d = re.sub(r"\D", "", value)
    if not 8 <= len(d) <= 15:
        return None
    country = (1 if d[0] in _COUNTRY_1 else 2 if d[:2] in _COUNTRY_2 else 3) if value.startswith("+") else 0
    national = d[country:].lstrip("0")
    if not national:
        return None
    low = 10 ** (len(national) - 1)
    plan, x = _north_american(national), int(national) - low
    while True:
        x = permute(key, f"phone{len(national)}", x, 9 * low)
        if _north_american(str(low + x)) == plan:
            return _refill(value, d[: len(d) - len(national)] + str(low + x))


def _date(key: bytes, value: str) -> str | None:
    """A day stays before or after the twelfth, so that one written day first stays readable as such only. Parts written
    without zeros may grow or lose a digit."""
    sep = re.search(r"\D", value)[0]
    p = value.split(sep)
    order = (0, 1, 2) if len(p[0]) == 4 else (2, 0, 1) if sep == "/" else (2, 1, 0)
    n = [int(x) for x in p]
    for o in dict.fromkeys((order, (2, 1, 0))):
        try:
            day = datetime.date(*(n[i] for i in o))
        except ValueError:
            continue
        at = day.toordinal() - _DAY0
        if not 0 <= at < _DAYS:
            continue
        while True:
            at = permute(key, "date", at, _DAYS)
            new = datetime.date.fromordinal(_DAY0 + at)
            if (new.day > 12) == (day.day > 12):
                break
        out = [""] * 3
        for i, x in zip(o, (new.year, new.month, new.day)):
            out[i] = f"{x:0{len(p[i])}d}"
        return sep.join(out)
    return None


def _mail(key: bytes, value: str) -> str:
    host, _, top = value.rpartition(".")
    return f"{_classes(key, 'mail', host)}.{top}"


def _secret(key: bytes, value: str) -> str:
    if not value.strip(_HEX) and not value.isalpha() and not value.isdigit():
        return _classes(key, "hex", value)  # hexadecimal numbers stay such
    at = 4 if re.match(r"A[KS]IA", value) else 0
    return value[:at] + _classes(key, "secret", value[at:])


#: kind, what a text must hold before the pattern is tried, pattern (a secret's group 1, if any, is the value), and its
#: pseudonym, None where the value is not valid. In order of precedence.
KINDS = (
    ("email", r"@", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}", _mail),
    ("secret", r"A[KS]IA", r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b", _secret),
    (
        "secret", r"[=:]",
        r"(?i:\b(?:token|secret|password|passwd|api[_-]?key)\b\"?\s*[=:]\s*[\"']?)((?=[A-Za-z+/_-]*\d)[A-Za-z0-9+/_-]{8,}|[A-Za-z0-9+/_-]{16,})",
        _secret
    ),
    ("iban", r"[A-Z]{2}\d\d", r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b", _iban),
    ("ip", r"\d\.\d", r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\.?\d)", _ip),
    ("date", r"\d[/.-]\d", r"(?<![\d/.-])(?:\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4})(?![\d/-])", _date),
    ("card", r"\d", r"(?<![\d+.-])(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{1,7}|\d{4}([ -])\d{6}\2\d{5})(?![\d-])", _card),
    ("ssn", r"\d[- ]\d", r"(?<![\d-])\d{3}([- ])\d{2}\1\d{4}(?![\d-])", _ssn),
    ("phone", r"\d", r"(?<![\w+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{3,4}[ .-]\d{3,4}(?![\w-])|(?<![\w+])\+\d{8,15}(?!\d)", _phone),
)
_PATTERNS = [(kind, re.compile(need), re.compile(p), make) for kind, need, p, make in KINDS]
#: What every kind's values hold; texts without it are passed on as they are.
_ANY = re.compile(rb"[0-9@=:]")


def pseudonymise(text: str, key: bytes) -> tuple[str, list[tuple[str, int, int]]]:
    """The text with pseudonyms, and (kind, start, end) of each in the given text. Earlier kinds win where values overlap."""
    spans: list[tuple[int, int, str, str]] = []
    rest = text  # values found are blanked out here, so that none runs into a later kind's
    for kind, need, pattern, make in _PATTERNS:
        if not need.search(rest):
            continue
        found = []
        for m in pattern.finditer(rest):
            a, b = m.span(1) if kind == "secret" and m.re.groups else m.span()
            new = make(key, text[a:b])
            if new is not None:
                found.append((a, b, kind, new))
        if found:
            rest = _filled(rest, [(a, b, chr(0) * (b - a)) for a, b, _, _ in found])
            spans += found
    spans.sort()
    return _filled(text, [(a, b, new) for a, b, _, new in spans]), [(k, a, b) for a, b, k, _ in spans]


def _filled(text: str, parts: list[tuple[int, int, str]]) -> str:
    """text with each stretch (start, end), in order, replaced."""
    out, at = [], 0
    for a, b, new in parts:
        out += [text[at:a], new]
        at = b
    return "".join(out) + text[at:]


def _batch(key: bytes, texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    kind = pa.struct([("text", pa.string()), ("spans", pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])))])
    for batch in pieces(texts):
        out = []
        for x in batch.to_pylist():
            # A null text, and bytes that are no UTF-8 without any candidate, come back from Spark unchanged (null here).
            if x is None or not _ANY.search(x):
                out.append(None)
                continue
            text, spans = pseudonymise(x.decode("utf-8", "replace"), key)
            out.append({"text": text, "spans": [{"kind": k, "start": a, "end": b} for k, a, b in spans]} if spans else None)
        yield pa.array(out, type=kind)


def mask(docs: DataFrame, text_col: str = "text", key: bytes | None = None, out: str = "pii") -> tuple[DataFrame, str]:
    """docs with text_col pseudonymised and one more column, spans (kind, start, end in the text given), named `out` or longer.

    key: key_of(session) if none is given. Null texts stay null with no spans; empty texts and texts without personal
    data stay as they are. Texts of any length are read whole, in time that grows with the length. Rows neither appear
    nor go, other columns stay whatever their names, repeated rows get equal pseudonyms, an empty table stays empty.
    """
    name = free_name(docs, out)
    key = key or key_of(docs.sparkSession)

    def pseudonyms(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return _batch(key, texts)

    found = F.arrow_udf(pseudonyms, "text string, spans array<struct<kind string, start int, end int>>")
    with_found = docs.withColumn(name, found(column(docs, text_col).cast("binary")))
    s = column(with_found, name)
    none = F.array().cast("array<struct<kind:string,start:int,end:int>>")
    return with_found.withColumns({text_col: F.coalesce(s["text"], column(with_found, text_col)), name: F.coalesce(s["spans"], none)}), name
