"""Personal data: format-preserving Feistel pseudonyms.

Validated values (payment cards, telephone numbers, dates, addresses, account
numbers, e-mail local parts, credentials) are permuted by a keyed Feistel network
on the set of values of their format. Numbers are permuted as integers (cycle
walking keeps the result in the set), strings place by place, each half moved by
a keyed function of the other, which takes time in proportion to their length. So
a value keeps its format and its checks (Luhn digit, calendar date, IBAN
remainder, address range), equal values get equal pseudonyms in every document,
and different values different ones. A date has one pseudonym in all spellings:
the calendar day is permuted, then spelled so that it reads back as that day.

Checks: cards by Luhn, IBAN by remainder, addresses by range, dates by the calendar, US
social numbers by their areas; numbers with a country code by that code and their length (8 to 15
digits), telephone numbers without one by the first digits of area and exchange (2 to 9).

Edge cases: a null text stays null with 0 values; text without such values is
unchanged byte for byte; the whole text is searched, in time linear in it, however
long its words are; digits are ASCII digits; where two kinds overlap,
the one listed first in KINDS wins; a value that fails its check is left alone;
other columns pass through, whatever their names; repeated rows are treated alike; an
empty table stays empty. A permutation may map a value to itself with
probability 1 / size of its set.
"""

from __future__ import annotations

import datetime
import hashlib
import hmac
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .text import Texts, pieces
from .work import free_name, through

#: For tests and the synthetic tables; give your own secret key elsewhere.
DEMO_KEY = b"sparkloom-demo-key"
ROUNDS = 8
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()


def permute(value: int, size: int, key: bytes, tweak: str, inverse: bool = False) -> int:
    """A keyed permutation of range(size): balanced Feistel, walked until the value is in range."""
    if size < 2:
        return value
    half = (max(2, (size - 1).bit_length()) + 1) // 2
    mask, width = (1 << half) - 1, (half + 7) // 8
    order = range(ROUNDS - 1, -1, -1) if inverse else range(ROUNDS)
    set_size = size.to_bytes((size.bit_length() + 7) // 8, "big").hex()

    def pad(r: int, x: int) -> int:
        out = hmac.new(key, f"{tweak}|{set_size}|{r}|".encode() + x.to_bytes(width, "big"), hashlib.sha256).digest()
        while len(out) < width:
            out += hashlib.sha256(out).digest()
        return int.from_bytes(out[:width], "big") & mask

    while True:
        a, b = value >> half, value & mask
        for r in order:
            a, b = (b ^ pad(r, a), a) if inverse else (b, a ^ pad(r, b))
        value = a << half | b
        if value < size:
            return value


def luhn_digit(digits: str) -> str:
    total = sum((d * 2 - 9 * (d > 4)) if i % 2 == 0 else d for i, d in enumerate(map(int, reversed(digits))))
    return str(-total % 10)


#: Country calling codes of two digits; 1 and 7 have one, all others three.
TWO_DIGIT_CODES = frozenset("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())


def into(shape: str, chars: str) -> str:
    """The letters and digits of ``shape`` replaced in turn by ``chars``."""
    it = iter(chars)
    return "".join(next(it) if c.isalnum() else c for c in shape)


def _digits(s: str) -> str:
    return "".join(c for c in s if c.isdigit())


def _number(digits: str, key: bytes, tweak: str) -> str:
    return str(permute(int(digits), 10 ** len(digits), key, f"{tweak}{len(digits)}")).zfill(len(digits))


_SETS = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def classes(text: str, key: bytes, tweak: str, sets=_SETS, inverse: bool = False) -> str:
    """Each ASCII letter or digit stays in its set: a Feistel network over the places of the string.

    In each round one half's characters move within their sets by amounts that a
    keyed function of the other half gives, so this is a permutation for every length.
    """
    kind = [next((n for n, s in enumerate(sets) if c in s), -1) for c in text]
    at = [i for i, k in enumerate(kind) if k >= 0]
    if len(at) < 2:
        return "".join(sets[k][permute(sets[k].index(c), len(sets[k]), key, tweak, inverse)] if k >= 0 else c for c, k in zip(text, kind, strict=True))
    size = np.array([len(sets[kind[i]]) for i in at], dtype=np.uint64)
    value = np.array([sets[kind[i]].index(text[i]) for i in at], dtype=np.uint64)
    shape = "".join(str(k) if k >= 0 else c for c, k in zip(text, kind, strict=True))
    seed = hmac.new(key, f"{tweak}:{shape}".encode(), hashlib.sha256).digest()
    left, right = slice(0, len(at) // 2), slice(len(at) // 2, len(at))
    for r in range(ROUNDS - 1, -1, -1) if inverse else range(ROUNDS):
        moved, other = (left, right) if r % 2 else (right, left)
        n = size[moved]
        pad = np.frombuffer(hashlib.shake_256(seed + bytes([r]) + value[other].astype(np.uint8).tobytes()).digest(8 * len(n)), dtype="<u8") % n
        value[moved] = (value[moved] + (n - pad if inverse else pad)) % n
    out = list(text)
    for i, v in zip(at, value.tolist(), strict=True):
        out[i] = sets[kind[i]][v]
    return "".join(out)


def card(m: re.Match, key: bytes) -> str | None:
    d = _digits(m[0])
    # network digit kept, Luhn digit recomputed
    if not 13 <= len(d) <= 19 or len(set(d)) == 1 or luhn_digit(d[:-1]) != d[-1]:
        return None
    body = d[0] + _number(d[1:-1], key, "luhn")
    return into(m[0], body + luhn_digit(body))


def _calling_code(digits: str) -> int:
    """Length of the country code that the digits of an international number begin with."""
    return 1 if digits[0] in "17" else 2 if digits[:2] in TWO_DIGIT_CODES else 3


def _american(number: str) -> bool:
    return len(number) == 10 and number[0] > "1" and number[3] > "1"


def _subscriber(code: str, number: str, key: bytes) -> str:
    """Pseudonym of a number within its country; North American numbers and others of ten digits there stay what they are."""
    kind, new = code == "1" and _american(number), number
    while True:
        new = _number(new, key, "phone" + code)
        if code != "1" or _american(new) == kind:
            return new


def phone(m: re.Match, key: bytes) -> str | None:
    rest = _digits(m["rest"])
    if m["country"] is None and not _american(rest):
        return None
    return (m[0][: m.start("rest") - m.start()]) + into(m["rest"], _subscriber(_digits(m["country"] or "1"), rest, key))


def abroad(m: re.Match, key: bytes) -> str | None:
    d = _digits(m[0])
    if not 8 <= len(d) <= 15:
        return None
    n = _calling_code(d)
    return into(m[0], d[:n] + _subscriber(d[:n], d[n:], key))


def date(m: re.Match, key: bytes) -> str | None:
    iso = m["y1"] is not None
    y, mo, d = (int(m[x]) for x in (("y1", "m1", "d1") if iso else ("y2", "m2", "d2")))
    swap = not iso and mo > 12 >= d  # month first
    try:
        day = datetime.date(y, *((d, mo) if swap else (mo, d)))
    except ValueError:
        return None
    if not FIRST_DAY <= day.toordinal() <= LAST_DAY:
        return None
    new = datetime.date.fromordinal(permute(day.toordinal() - FIRST_DAY, LAST_DAY - FIRST_DAY + 1, key, "date") + FIRST_DAY)
    if iso:
        return new.isoformat()
    # month first only where it cannot be read as day first
    one, two = (new.month, new.day) if swap and new.day > 12 else (new.day, new.month)
    wide = lambda n, name: f"{n:02d}" if len(m[name]) == 2 else str(n)
    return f"{wide(one, 'd2')}{m['sep']}{wide(two, 'm2')}{m['sep']}{new.year:04d}"


def address(m: re.Match, key: bytes) -> str | None:
    octets = [int(x) for x in m[0].split(".")]
    if max(octets) > 255:
        return None
    n = permute(int.from_bytes(bytes(octets), "big"), 1 << 32, key, "ipv4")
    return ".".join(map(str, n.to_bytes(4, "big")))


def social(m: re.Match, key: bytes) -> str | None:
    area, group, serial = (int(x) for x in m[0].split("-"))
    if area in (0, 666) or area > 899 or not group or not serial:
        return None
    areas = 898  # 1..899 without 666
    at = area - 1 - (area > 666)
    n = permute((at * 99 + group - 1) * 9999 + serial - 1, areas * 99 * 9999, key, "ssn")
    n, serial = divmod(n, 9999)
    at, group = divmod(n, 99)
    return f"{at + 1 + (at >= 665):03d}-{group + 1:02d}-{serial + 1:04d}"


def _mod97(s: str) -> int:
    return int("".join(str(int(c, 36)) for c in s)) % 97


def iban(m: re.Match, key: bytes) -> str | None:
    s = m[0].replace(" ", "")
    if not 15 <= len(s) <= 34 or _mod97(s[4:] + s[:4]) != 1:
        return None
    body = classes(s[4:], key, "iban" + s[:2])
    return into(m[0], s[:2] + f"{98 - _mod97(body + s[:2] + '00'):02d}" + body)


def email(m: re.Match, key: bytes) -> str | None:
    s, e = (x - m.start() for x in m.span("local"))
    return m[0][:s] + classes(m["local"], key, "email@" + m["host"].lower()) + m[0][e:]


def secret(m: re.Match, key: bytes) -> str | None:
    name = next(x for x in ("akia", "value") if m[x])
    s, e = (x - m.start() for x in m.span(name))
    sets = ("0123456789abcdef",) if re.fullmatch("[0-9a-f]+", m[name]) else ("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ",) if name == "akia" else _SETS
    return m[0][:s] + classes(m[name], key, "secret", sets) + m[0][e:]


#: In order of precedence.
KINDS = {
    # begins where a run of such characters begins, so each run is read once
    "email": (r"(?<![A-Za-z0-9._%+-])[._%+-]*(?P<local>[A-Za-z0-9][A-Za-z0-9._%+-]*+)@(?P<host>[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,})", email),
    "secret": (r"\bAKIA(?P<akia>[0-9A-Z]{16})\b|\b(?i:password|passwd|secret|token|api[_-]?key)\b[ ]?[=:][ ]?[\"']?(?P<value>[A-Za-z0-9+/_-]{8,})", secret),
    "iban": (r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b", iban),
    "address": (r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])", address),
    "date": (r"(?<![0-9/.-])(?:(?P<y1>[0-9]{4})-(?P<m1>[0-9]{2})-(?P<d1>[0-9]{2})|(?P<d2>[0-9]{1,2})(?P<sep>[/.])(?P<m2>[0-9]{1,2})(?P=sep)(?P<y2>[0-9]{4}))(?![0-9/-]|\.[0-9])", date),
    "social": (r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", social),
    "phone": (r"(?<![\w+])(?:(?P<country>\+[0-9]{1,3})[ .-]?)?(?P<rest>\([0-9]{3}\)[ .-]?[0-9]{3}[ .-][0-9]{4}|(?<=[0-9][ .-])[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4})(?!\w)", phone),
    "abroad": (r"(?<![\w+])\+[1-9][0-9]{0,14}(?:[ .-]?\(?[0-9]{1,12}\)?){0,6}(?![\w])", abroad),
    "card": (r"(?<![\w.-])[0-9](?:[ -]?[0-9]){12,18}(?![\w-]|\.[0-9])", card),
}


@lru_cache
def _pattern() -> re.Pattern:
    # each kind keeps its own group names; names are unique over all kinds
    return re.compile("|".join(f"(?P<{k}>{p})" for k, (p, _) in KINDS.items()))


def pseudonymise(text: str, key: bytes = DEMO_KEY) -> tuple[str, list[tuple[str, int, int]]]:
    """The text with pseudonyms, and (kind, start, end) of each value in the original, in code points."""
    found, out, at = [], [], 0
    pattern, pos = _pattern(), 0
    while m := pattern.search(text, pos):
        kind = next(k for k in KINDS if m[k] is not None)
        new = KINDS[kind][1](m, key)
        if new is None:  # a failed check: other kinds may still match here
            new, m, kind = _other(text, m.start(), kind, key)
        if new is None:
            pos = m + 1
            continue
        out += [text[at : m.start()], new]
        at = pos = m.end()
        found.append((kind, m.start("local") if kind == "email" else m.start(), m.end()))
    return "".join(out) + text[at:], found


def _other(text: str, start: int, failed: str, key: bytes):
    names = list(KINDS)
    for kind in names[names.index(failed) + 1 :]:
        m = _alone(kind).match(text, start)
        if m and (new := KINDS[kind][1](m, key)) is not None:
            return new, m, kind
    return None, start, failed


@lru_cache
def _alone(kind: str) -> re.Pattern:
    return re.compile(KINDS[kind][0])


_HINT = np.zeros(256, dtype=bool)
_HINT[[*range(48, 58), 64, 61, 58]] = True  # digits, @, =, :


def pseudonymised(docs: DataFrame, key: bytes = DEMO_KEY, text: str = "text", listed: str = "pii_values") -> DataFrame:
    """``docs`` with the text replaced, plus ``listed`` array<struct<kind, start, end>> (offsets in the original).

    Where a column has that name already, underscores are added to the new one's.
    """
    listed = free_name(docs, listed)
    entry = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
    values = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def kernel(name):
        def run(batches):
            for whole in batches:
                for b in pieces(whole, name):
                    col = b.column(name)
                    t = Texts(col)
                    hits = np.concatenate([[0], np.cumsum(_HINT[t.buf])])
                    at = np.flatnonzero(np.diff(hits[t.offs]))
                    found: list = [[] for _ in range(t.n)]
                    changed, new = [], []
                    for i in at.tolist():
                        s, f = pseudonymise(t.raw(i).decode("utf-8", "replace"), key)
                        if f:
                            found[i] = [{"kind": k, "start": a, "end": z} for k, a, z in f]
                            changed.append(i)
                            new.append(s)
                    if changed:
                        mask = np.zeros(t.n, dtype=bool)
                        mask[changed] = True
                        col = pa.compute.replace_with_mask(col, pa.array(mask), pa.array(new, col.type))
                    cols = [col if n == name else b.column(n) for n in b.schema.names]
                    yield pa.RecordBatch.from_arrays([*cols, pa.array(found, values)], names=[*b.schema.names, f"c{b.num_columns}"])

        return run

    return through(docs, text, kernel, T.StructField(listed, T.ArrayType(entry)))


def op9_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_values and the whole text with pseudonyms."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pseudonymised(docs).selectExpr("doc_id", "cast(size(pii_values) as long) AS n_values", "text")
