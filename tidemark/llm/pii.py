"""Format-preserving pseudonyms for personal data.

Numbers and dates that pass their validation (Luhn and mod-97 check digits,
octet ranges, real calendar days, areas of social security numbers) are permuted
inside their own format by a keyed Feistel network: digits stay digits, separators
stay, check digits are made valid again.  Phone numbers have no check and are told
by their grouping.  A value always gets the same pseudonym, however it is
punctuated, so records stay linked; without the key it can't be undone.

The key is an argument or the setting ``spark.tidemark.pii.key``.  Without it a key
is drawn for the application, and pseudonyms are linked within it alone.

Defined results: a null text stays null, an empty and a very long one are read
whole; text without such values is unchanged; repeated rows are rewritten alike;
overlapping finds go to the kind named first in KINDS, then the leftmost; where a
match in groups is not valid, the longest valid run of its groups is taken; a column
named like a result is replaced; an empty table gives no rows.
"""

from __future__ import annotations

import bisect
import datetime
import functools
import hashlib
import re
import secrets
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tidemark.llm.arrowmap import add_columns
from tidemark.llm.feistel import permute_number

_HEX, _DIGITS, _LETTERS = "0123456789abcdef", "0123456789", "abcdefghijklmnopqrstuvwxyz"
KEY_SETTING = "spark.tidemark.pii.key"
#: Signs that are permuted as one number.
TOGETHER = 128
_DRAWN: dict[str, bytes] = {}


def session_key(spark: SparkSession) -> bytes:
    """The key that the session names, or one drawn for this application."""
    named = spark.conf.get(KEY_SETTING, None)
    return named.encode() if named else _DRAWN.setdefault(spark.sparkContext.applicationId, secrets.token_bytes(32))


def _permuted(values: list[int], radices: list[int], key: bytes) -> list[int]:
    """Mixed-radix digits of the permuted number; very long ones in parts, each with a key of its own."""
    if len(values) > TOGETHER:
        cut = range(0, len(values), TOGETHER)
        return [v for i in cut for v in _permuted(values[i : i + TOGETHER], radices[i : i + TOGETHER], hashlib.blake2b(b"%d" % i, key=key[:64]).digest())]
    x, n = 0, 1
    for v, r in zip(values, radices, strict=True):
        x, n = x * r + v, n * r
    x = permute_number(x, n, key)
    out = []
    for r in reversed(radices):
        x, v = divmod(x, r)
        out.append(v)
    return out[::-1]


def _refill(value: str, new: list[str], take: Callable[[str], bool]) -> str:
    it = iter(new)
    return "".join(next(it) if take(c) else c for c in value)


def _digits(value: str, key: bytes) -> list[int]:
    d = [int(c) for c in value if c in _DIGITS]
    return _permuted(d, [10] * len(d), key)


def luhn(digits: list[int]) -> bool:
    rest = digits[::-1]
    return (sum(rest[0::2]) + sum(sum(divmod(2 * x, 10)) for x in rest[1::2])) % 10 == 0


def card(value: str, key: bytes) -> str | None:
    d = [int(c) for c in value if c in _DIGITS]
    if not 13 <= len(d) <= 19 or not luhn(d) or len(set(d)) == 1:
        return None
    body = _permuted(d[:-1], [10] * (len(d) - 1), key)
    check = next(c for c in range(10) if luhn([*body, c]))
    return _refill(value, [str(x) for x in [*body, check]], str.isdigit)


def phone(value: str, key: bytes) -> str | None:
    """All ten digits change; a country code stays."""
    d = [c for c in value if c in _DIGITS]
    lead = len(d) - 10
    new = [str(x) for x in _permuted([int(c) for c in d[lead:]], [10] * 10, key)]
    return _refill(value, d[:lead] + new, str.isdigit)


def ssn(value: str, key: bytes) -> str | None:
    area, group, serial = value[:3], value[4:6], value[7:]
    if area in ("000", "666") or area[0] == "9" or group == "00" or serial == "0000":
        return None
    areas = [a for a in range(1, 900) if a != 666]
    a, g, s = _permuted([areas.index(int(area)), int(group) - 1, int(serial) - 1], [len(areas), 99, 9999], key)
    return f"{areas[a]:03d}-{g + 1:02d}-{s + 1:04d}"


def ip(value: str, key: bytes) -> str | None:
    octets = [int(x) for x in value.split(".")]
    if max(octets) > 255 or any(len(x) > 1 and x[0] == "0" for x in value.split(".")):
        return None
    return ".".join(map(str, _permuted(octets, [256] * 4, key)))


def iban(value: str, key: bytes) -> str | None:
    plain = value.replace(" ", "")
    number = lambda s: int("".join(str(int(c, 36)) for c in s))
    if not 15 <= len(plain) <= 34 or number(plain[4:] + plain[:4]) % 97 != 1:
        return None
    body = [int(c) for c in plain[4:] if c in _DIGITS]
    fresh = iter(str(x) for x in _permuted(body, [10] * len(body), key))
    tail = "".join(next(fresh) if c in _DIGITS else c for c in plain[4:])
    made = plain[:2] + f"{98 - number(tail + plain[:2] + '00') % 97:02d}" + tail
    return _refill(value, list(made), lambda c: c != " ")


#: Calendar blocks inside which dates are permuted.
_BLOCKS = [(datetime.date(1900, 1, 1), datetime.date(2099, 12, 31)), (datetime.date(1000, 1, 1), datetime.date(1899, 12, 31)), (datetime.date(2100, 1, 1), datetime.date(9999, 12, 31))]


def date(value: str, key: bytes) -> str | None:
    """2024-05-06, 2024/05/06, 06.05.2024 and 05/06/2024, if there is such a day.

    With slashes the month is first where that is a day.  Else the day is, and
    stays above 12 in the pseudonym, so that no other date gets the same one.
    """
    a, b, c = re.split("[-/.]", value)
    mark = value[len(a)]
    day_first = mark == "." or (len(a) == 2 and int(a) > 12)
    y, m, d = (a, b, c) if len(a) == 4 else (c, b, a) if day_first else (c, a, b)
    try:
        day = datetime.date(int(y), int(m), int(d))
    except ValueError:
        return None
    block = next((x for x in _BLOCKS if x[0] <= day <= x[1]), None)
    if block is None:
        return None
    new = day
    while new == day or (day_first and mark == "/" and new.day <= 12):
        new = block[0] + datetime.timedelta(permute_number((new - block[0]).days, (block[1] - block[0]).days + 1, key))
        if new == day:
            break
    y, m, d = f"{new.year:04d}", f"{new.month:02d}", f"{new.day:02d}"
    return mark.join((y, m, d) if len(a) == 4 else (d, m, y) if day_first else (m, d, y))


def email(value: str, key: bytes) -> str | None:
    """Letters and digits of the local part change in their class; case and domain stay."""
    local, _, domain = value.rpartition("@")
    own = [c for c in local if c.lower() in _LETTERS or c in _DIGITS]
    if not own:
        return None
    sets = [_DIGITS if c in _DIGITS else _LETTERS for c in own]
    new = _permuted([s.index(c.lower()) for s, c in zip(sets, own, strict=True)], [len(s) for s in sets], key)
    fresh = [s[v].upper() if c.isupper() else s[v] for s, v, c in zip(sets, new, own, strict=True)]
    return _refill(local, fresh, lambda c: c.lower() in _LETTERS or c in _DIGITS) + "@" + domain


def secret(value: str, key: bytes) -> str | None:
    """Long hexadecimal tokens with digits and letters."""
    low = value.lower()
    if low.isdigit() or low.isalpha():
        return None
    new = "".join(_HEX[v] for v in _permuted([_HEX.index(c) for c in low], [16] * len(low), key))
    return new.upper() if any(c.isupper() for c in value) else new


_EDGE_L, _EDGE_R = r"(?<![0-9A-Za-z])", r"(?![0-9A-Za-z])"
#: Fixed patterns, in order of precedence.
KINDS: dict[str, tuple[str, Callable[[str, bytes], str | None]]] = {
    "email": (r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", email),
    "secret": (_EDGE_L + r"[0-9a-fA-F]{32,}" + _EDGE_R, secret),
    "iban": (_EDGE_L + r"[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,3})?" + _EDGE_R, iban),
    "ip": (r"(?<![0-9A-Za-z.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9A-Za-z]|\.[0-9])", ip),
    "date": (r"(?<![0-9A-Za-z./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{2}/[0-9]{2}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}|[0-9]{2}/[0-9]{2}/[0-9]{4})(?![0-9A-Za-z/-]|\.[0-9])", date),
    "ssn": (r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])", ssn),
    "phone": (r"(?<![0-9A-Za-z])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}" + _EDGE_R, phone),
    "card": (_EDGE_L + r"[0-9](?:[ -]?[0-9]){12,18}" + _EDGE_R, card),
}
_FIND = {k: re.compile(p) for k, (p, _) in KINDS.items()}
#: Kinds written in groups, whose matches may take in groups around the value.
_GROUPED = {"iban", "card"}
_GROUP = re.compile("[0-9A-Z]+").finditer
_DIGIT = re.compile("[0-9]").search


@functools.lru_cache(maxsize=1 << 16)
def pseudonym(kind: str, value: str, key: bytes) -> str | None:
    """The stand-in of a found value, or None if it is not valid."""
    return KINDS[kind][1](value, hashlib.blake2b(kind.encode(), key=hashlib.sha256(key).digest(), digest_size=32).digest())


def _spans(kind: str, text: str, span: tuple[int, int]) -> Iterator[tuple[int, int]]:
    """A match and, for kinds in groups, the spans of whole groups inside it that match too: the longest first, then the leftmost."""
    yield span
    if kind in _GROUPED:
        groups = [m.span() for m in _GROUP(text, *span)]
        inner = sorted((a - b, a, b) for i, (a, _) in enumerate(groups) for _, b in groups[i:] if (a, b) != span)
        yield from ((a, b) for _, a, b in inner if _FIND[kind].fullmatch(text, a, b))


def scan(text: str, key: bytes) -> list[tuple[int, int, str, str]]:
    """Spans to replace, with kind and pseudonym, from left to right and free of overlaps."""
    found: list[tuple[int, int, str, str]] = []
    starts: list[int] = []
    digits = _DIGIT(text) is not None
    for kind in KINDS:
        if kind == "email":
            if "@" not in text:
                continue
        elif not digits:
            continue
        at = 0
        while m := _FIND[kind].search(text, at):
            at = next(_GROUP(text, *m.span())).end() if kind in _GROUPED else m.end()
            for a, b in _spans(kind, text, m.span()):
                new = pseudonym(kind, text[a:b], key)
                if new is None:
                    continue
                i = bisect.bisect_left(starts, a)
                if (i and found[i - 1][1] > a) or (i < len(found) and starts[i] < b):
                    continue
                starts.insert(i, a)
                found.insert(i, (a, b, kind, new))
                at = b
                break
    return found


def rewrite(text: str | None, key: bytes) -> tuple[str | None, list[str]]:
    """The text with pseudonyms, and the kind of each."""
    if not text:
        return text, []
    spans = scan(text, key)
    if not spans:
        return text, []
    out, at = [], 0
    for a, b, _, new in spans:
        out += [text[at:a], new]
        at = b
    return "".join([*out, text[at:]]), [k for _, _, k, _ in spans]


def pseudonymize(docs: DataFrame, *, key: bytes | None = None, text: str = "text", kinds: str = "pii_kinds") -> DataFrame:
    """``docs`` with the text rewritten in place and the sorted kinds of the values replaced."""
    key = session_key(docs.sparkSession) if key is None else key
    fields = [T.StructField(text, T.StringType()), T.StructField(kinds, T.ArrayType(T.StringType()))]

    def work(column: pa.Array) -> list:
        made = [rewrite(x, key) for x in column.to_pylist()]
        return [[t for t, _ in made], [sorted(k) for _, k in made]]

    made = add_columns(docs, text, fields, work)
    return made.select(*(c for c in docs.columns if c != kinds), kinds)
