"""Format-preserving pseudonyms: validated values are permuted under a key within their own format.

A value is a number in the domain of its format (all card numbers of a length, all dates of a range, ...). A keyed Feistel
network with cycle walking permutes the domain, so the pseudonym is valid in the same format, equal values get equal
pseudonyms in every document, and different values never collide. Values that fail validation are no personal data and stay.
"""

from __future__ import annotations

import datetime
import hashlib
import ipaddress
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import add_columns

ROUNDS = 8
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()
#: English names of the months (fixed values); three letters are their short forms.
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
_MONTH = "|".join(f"{m[:3]}(?:{m[3:]})?" if m != "May" else m for m in MONTHS)
#: Country calling codes of one and two digits (fixed values); all others have three.
SHORT_CODES = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
#: Kinds by precedence where matches overlap.
EXPRESSIONS = {
    "email": re.compile(r"(?<![\w.%+-])\w[\w.%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}(?![\w-])"),
    "iban": re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?!\w)"),
    "card": re.compile(r"(?<![\w.+])(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{4}|\d{4}([ -])\d{6}\2\d{5})(?!\w|[.]\d)", re.A),
    "phone": re.compile(r"(?<![\w+.-])(?:(?:\+1[ .-]?)?(?:\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}([ .-])\d{3}\1\d{4})|\+1\d{10}|\+[2-9]\d{0,2}(?:[ .-]?\d{2,5}){2,5})(?![\w-]|\.\d)", re.A),
    "ssn": re.compile(r"(?<![\w-])\d{3}([ -])\d{2}\1\d{4}(?![\w-])", re.A),
    "ip": re.compile(r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?!\w|\.\d)", re.A),
    "ip6": re.compile(r"(?<![\w:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![\w:]|\.\d)", re.A),
    "date": re.compile(r"(?<![\w./-])(?:\d{4}([-/.])\d{1,2}\1\d{1,2}|\d{1,2}([-/.])\d{1,2}\2\d{4})(?=T\d{2}:\d{2})|(?<![\w./-])(?:\d{4}([-/.])\d{1,2}\3\d{1,2}|\d{1,2}([-/.])\d{1,2}\4\d{4})(?![\w/-]|\.\d)", re.A),
    "day": re.compile(rf"(?<!\w)(?:(?:{_MONTH})\.? \d{{1,2}}, \d{{4}}|\d{{1,2}} (?:{_MONTH})\.? \d{{4}})(?!\w)", re.A),
}
KINDS = tuple(EXPRESSIONS)
DIGIT = re.compile(r"[0-9]")
FIELDS = [T.StructField("n_private", T.LongType()), T.StructField("spans", T.StringType())]


def permute(value: int, size: int, key: bytes, tweak: str) -> int:
    """A keyed permutation of 0 .. size - 1."""
    if size < 2:
        return value
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask, width = (1 << half) - 1, (half + 7) // 8
    seeds = [hashlib.blake2b(f"{tweak}:{size}:{r}".encode(), key=key[:64]) for r in range(ROUNDS)]
    while True:
        left, right = value >> half, value & mask
        for seed in seeds:
            h = seed.copy()
            h.update(right.to_bytes(width, "big"))
            left, right = right, left ^ (int.from_bytes(_stretch(h.digest(), width), "big") & mask)
        value = left << half | right
        if value < size:
            return value


def _stretch(digest: bytes, width: int) -> bytes:
    while len(digest) < width:
        digest += hashlib.blake2b(digest).digest()
    return digest[:width]


def luhn(digits: str) -> int:
    """The Luhn sum of a number modulo 10; zero where it is valid."""
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) << (k & 1)
        total += d - 9 if d > 9 else d
    return total % 10


def _refill(shape: str, digits: str) -> str:
    """``shape`` with its digits replaced in order."""
    left = iter(digits)
    return "".join(next(left) if c.isdigit() else c for c in shape)


def _card(value: str, key: bytes) -> str | None:
    digits = re.sub(r"\D", "", value)
    if luhn(digits) or not digits.strip("0"):
        return None
    n = len(digits) - 2  # the issuer's digit stays and the check digit follows from the others
    body = digits[0] + str(permute(int(digits[1:-1]), 10**n, key, f"card {digits[0]}")).zfill(n)
    return _refill(value, body + str(-luhn(body + "0") % 10))


def _plan_place(digits: str) -> int | None:
    """The place of a number in the North American plan: area and exchange from 200, neither ending in 11; else None."""
    parts = [int(digits[:3]), int(digits[3:6])]
    if any(p < 200 or p % 100 == 11 for p in parts):
        return None
    area, exchange = [p - 200 - (p - 200 + 88) // 100 for p in parts]
    return (area * 792 + exchange) * 10_000 + int(digits[6:])


def _plan_number(place: int) -> str:
    rest, line = divmod(place, 10_000)
    area, exchange = [200 + p + (p + 88) // 99 for p in divmod(rest, 792)]
    return f"{area:03d}{exchange:03d}{line:04d}"


def _phone(value: str, key: bytes) -> str | None:
    """Numbers of the North American plan are permuted among themselves; those outside it, which only a country's code or
    brackets make a phone number, among those outside; those of other countries among those of their code and length."""
    digits = re.sub(r"\D", "", value)
    if value[0] == "+" and digits[0] != "1":
        code = next(n for n in (1, 2, 3) if n == 3 or digits[:n] in SHORT_CODES)
        rest = digits[code:]
        if not 8 <= len(digits) <= 15 or len(rest) < 6 or rest[0] == "0":
            return None
        low = 10 ** (len(rest) - 1)
        return _refill(value, digits[:code] + str(low + permute(int(rest) - low, 9 * low, key, f"phone {digits[:code]}")))
    own = digits[-10:]
    place = _plan_place(own)
    if place is not None:
        new = _plan_number(permute(place, 792 * 792 * 10_000, key, "phone"))
    elif value[0] in "+(":
        new = own
        while new == own or _plan_place(new) is not None:
            new = str(permute(int(new), 10**10, key, "phone outside")).zfill(10)
            if new == own:  # a cycle of its own
                break
    else:
        return None
    return _refill(value, digits[:-10] + new)


def _ssn(value: str, key: bytes) -> str | None:
    mark = value[3]
    area, group, serial = map(int, value.split(mark))
    if area in (0, 666) or area >= 900 or not group or not serial:
        return None
    place = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
    rest, serial = divmod(permute(place, 898 * 99 * 9999, key, "ssn"), 9999)
    area, group = divmod(rest, 99)
    return f"{area + 1 + (area >= 665):03d}{mark}{group + 1:02d}{mark}{serial + 1:04d}"


def _ip(value: str, key: bytes) -> str | None:
    parts = value.split(".")
    if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
        return None
    return ".".join(map(str, permute(int.from_bytes(bytes(map(int, parts)), "big"), 2**32, key, "ip").to_bytes(4, "big")))


def _ip6(value: str, key: bytes) -> str | None:
    try:
        old = ipaddress.IPv6Address(value)
    except ValueError:
        return None
    return str(ipaddress.IPv6Address(permute(int(old), 2**128, key, "ip6"))) if int(old) > 1 else None  # not "::" nor "::1"


def _other_day(day: datetime.date, key: bytes) -> datetime.date | None:
    """One permutation of the calendar, whatever a date is written like."""
    if not FIRST_DAY <= day.toordinal() <= LAST_DAY:
        return None
    return datetime.date.fromordinal(FIRST_DAY + permute(day.toordinal() - FIRST_DAY, LAST_DAY - FIRST_DAY + 1, key, "date"))


def _date(value: str, key: bytes) -> str | None:
    """Year first; else month first with / and day first with . or -, or the other order where only that is a date.

    The pseudonym keeps the order, but that of the second kind is written in the first where it could be read so.
    """
    mark = next(c for c in value if not c.isdigit())
    parts = value.split(mark)
    orders = ["ymd"] if len(parts[0]) == 4 else ["mdy", "dmy"] if mark == "/" else ["dmy", "mdy"]
    for order in orders:
        named = dict(zip(order, map(int, parts)))
        try:
            new = _other_day(datetime.date(named["y"], named["m"], named["d"]), key)
        except ValueError:
            continue
        if new is None:
            return None
        order = order if new.day > 12 else orders[0]
        padded = all(len(p) > 1 for p in parts)
        now = {"y": new.year, "m": new.month, "d": new.day}
        return mark.join(f"{now[c]:04d}" if c == "y" else f"{now[c]:02d}" if padded else str(now[c]) for c in order)
    return None


def _day(value: str, key: bytes) -> str | None:
    """A date with its month by name, long or short."""
    name = re.search(r"[A-Za-z]+", value)[0]
    month = next(n for n, m in enumerate(MONTHS, 1) if m[:3] == name[:3])
    one, two = map(int, re.findall(r"\d+", value))
    try:
        new = _other_day(datetime.date(two, month, one), key)
    except ValueError:
        return None
    if new is None:
        return None
    said = MONTHS[new.month - 1][: 3 if len(name) == 3 and name != "May" else None]
    left = iter((str(new.day), f"{new.year:04d}"))
    return re.sub(r"\d+", lambda _: next(left), value.replace(name, said))


def _iban(value: str, key: bytes) -> str | None:
    bare = value.replace(" ", "")
    check = lambda s: int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97
    if not 15 <= len(bare) <= 34 or check(bare) != 1:
        return None
    body = _characters(bare[4:], key, f"iban {bare[:2]}")
    left = iter(bare[:2] + f"{98 - check(bare[:2] + '00' + body):02d}" + body)
    return "".join(c if c == " " else next(left) for c in value)


CLASSES = ("0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _characters(value: str, key: bytes, tweak: str) -> str:
    """``value`` with its ASCII digits and letters permuted together, each within its class; others stay."""
    alphabets = [next((a for a in CLASSES if c in a), None) for c in value]
    place, size = 0, 1
    for c, a in zip(value, alphabets):
        if a:
            place, size = place * len(a) + a.index(c), size * len(a)
    place = permute(place, size, key, f"{tweak} {''.join(a[0] if a else c for c, a in zip(value, alphabets))}")
    out = []
    for c, a in zip(reversed(value), reversed(alphabets)):
        if a:
            place, at = divmod(place, len(a))
            c = a[at]
        out.append(c)
    return "".join(reversed(out))


def _email(value: str, key: bytes) -> str | None:
    """Addresses are equal whatever the case of their letters; the pseudonym's letters have the case of those they replace."""
    body, _, top = value.rpartition(".")
    low = "".join(c.lower() if c in CLASSES[1] else c for c in body)
    new = _characters(low, key, "email")
    return f"{''.join(n.upper() if c != w else n for c, w, n in zip(body, low, new))}.{top}"


PSEUDONYMS: dict[str, Callable[[str, bytes], str | None]] = {"email": _email, "iban": _iban, "card": _card, "phone": _phone, "ssn": _ssn, "ip": _ip, "ip6": _ip6, "date": _date, "day": _day}


def pseudonymise(text: str, key: bytes) -> tuple[str, list[tuple[int, int, str]]]:
    """The text with its valid personal values replaced, and their spans (start, end, kind) in it as it was."""
    found: list[tuple[int, int, str, str]] = []
    digits = DIGIT.search(text) is not None
    for kind, expression in EXPRESSIONS.items():
        if digits and kind != "email" or kind == "email" and "@" in text:
            for m in expression.finditer(text):
                if all(m.end() <= a or b <= m.start() for a, b, _, _ in found) and (new := PSEUDONYMS[kind](m[0], key)) is not None:
                    found.append((m.start(), m.end(), kind, new))
    if not found:
        return text, []
    found.sort()
    out, at = [], 0
    for a, b, _, new in found:
        out += [text[at:a], new]
        at = b
    return "".join([*out, text[at:]]), [f[:3] for f in found]


def pseudonyms(df: DataFrame, key: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The ``keep`` columns (all) with ``text`` rewritten, ``n_private`` (its values) and ``spans`` (kind:start:end, before).

    Whole texts of any length; a null text stays null with no spans, an empty one empty. Rows pass one by one, repeated
    rows too. ``key`` is the caller's secret: who holds it can undo the permutation; an empty one is refused.
    """
    if not key:
        raise ValueError("pseudonyms need a secret key")
    secret = hashlib.blake2b(key.encode()).digest()

    def work():
        def each(batch: pa.RecordBatch) -> list[pa.Array]:
            texts, counts, spans = [], [], []
            for value in batch.column(batch.schema.get_field_index(text)):
                old = value.as_py()
                new, found = (None, []) if old is None else pseudonymise(old, secret)
                texts.append(new)
                counts.append(len(found))
                spans.append(",".join(f"{k}:{a}:{b}" for a, b, k in found))
            return [pa.array(texts, pa.string()), pa.array(counts, pa.int64()), pa.array(spans, pa.string())]

        return each

    keep = df.columns if keep is None else keep
    out = add_columns(df, [T.StructField(text, T.StringType()), *FIELDS], work, [text], keep)
    new = [f.name for f in FIELDS]
    kept = [c for c in keep if c != text and c.lower() not in new]
    return out.select(*[c for c in keep if c == text or c in kept], *([] if text in keep else [text]), *new)
