"""Secret scan: Aho-Corasick keyword prefilter, anchored expressions near hits only, checksum validation.

A text is read once by an automaton of all keywords; each expression is tried only at its own keywords' places. Runs of
hexadecimal digits have no keyword and are found by their length. Access tokens with an embedded checksum count only if
the checksum holds: their last six characters are the CRC-32 of the body in base 62.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import add_columns

#: The base kinds, in order.
BASE = ("assign", "access", "hex")
#: Further kinds, in order: tokens with an embedded CRC-32, JSON web tokens, private key blocks.
MORE = ("crc_token", "web_token", "private_key")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
CRC_TOKEN = re.compile(r"(?:gh[pousr]|npm)_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
WEB_TOKEN = re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")
#: A run that a web token begins with: where a token fails, it fails all along the run.
WEB_RUN = re.compile(r"[A-Za-z0-9_-]*")
PRIVATE_KEY = re.compile(r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----[A-Za-z0-9+/=\s]+-----END (?:[A-Z]+ )*PRIVATE KEY-----")
#: Keywords by kind. They are sought in lower case, and each expression begins with one.
KEYWORDS = {
    "assign": ("password", "passwd", "secret", "token", "api_key", "apikey"),
    "access": ("akia",),
    "crc_token": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "npm_"),
    "web_token": ("eyj",),
    "private_key": ("-----begin ",),
}
EXPRESSIONS = {"assign": ASSIGN, "access": ACCESS, "crc_token": CRC_TOKEN, "web_token": WEB_TOKEN, "private_key": PRIVATE_KEY}
DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
LOWER = {c: c + 32 for c in range(65, 91)}

FIELDS = [
    *[T.StructField(f"n_{k}", T.LongType()) for k in BASE],
    T.StructField("base_sha256", T.StringType()),
    T.StructField("spans", T.StringType()),
]


def checksum(body: str) -> str:
    """The six base-62 digits of a body's CRC-32."""
    n, out = zlib.crc32(body.encode()), ""
    for _ in range(6):
        n, d = divmod(n, 62)
        out = DIGITS[d] + out
    return out


def _holds(kind: str, m: re.Match) -> bool:
    if kind == "assign":
        return len(m[2]) >= 6
    if kind == "access":
        return len(m[0]) >= 20
    return checksum(m[1]) == m[2] if kind == "crc_token" else True


def finder() -> Callable[[str], list[tuple[int, int, str]]]:
    """A function that gives a text's spans (start, end, kind), in code points, by start and then kind as listed."""
    import ahocorasick

    automaton = ahocorasick.Automaton()
    kinds: dict[str, list[str]] = {}
    for kind, words in KEYWORDS.items():
        for word in words:
            kinds.setdefault(word, []).append(kind)
    for word, of in kinds.items():
        automaton.add_word(word, (len(word), tuple(of)))
    automaton.make_automaton()
    order = {k: n for n, k in enumerate((*BASE, *MORE))}

    def find(text: str) -> list[tuple[int, int, str]]:
        found = [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
        low = text.lower() if text.isascii() else text.translate(LOWER)
        done = dict.fromkeys(EXPRESSIONS, 0)
        hits = [(end - n + 1, of) for end, (n, of) in automaton.iter(low)]
        for start, of in sorted(hits):
            for kind in of:
                if start < done[kind]:
                    continue
                if m := EXPRESSIONS[kind].match(text, start):
                    holds = _holds(kind, m)
                    if holds or kind in BASE:  # a failing match of a base kind uses up its characters as well
                        done[kind] = m.end()
                    if holds:
                        found.append((start, m.end(), kind))
                elif kind == "web_token" and text.startswith("eyJ", start):
                    done[kind] = WEB_RUN.match(text, start).end()
        return sorted(found, key=lambda s: (s[0], order[s[2]]))

    return find


def scan_secrets(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The ``keep`` columns (all) with, for each row: n_assign, n_access, n_hex, base_sha256 and spans.

    Whole texts, of any length; a null text is empty and has none. Spans are kind:start:end in code points, end exclusive,
    joined by commas; base_sha256 is taken over the base kinds' alone. Rows pass through one by one, repeated rows too.
    """

    def work():
        find = finder()

        def each(batch: pa.RecordBatch) -> list[pa.Array]:
            counts, digests, spans = {k: [] for k in BASE}, [], []
            for value in batch.column(batch.schema.get_field_index(text)):
                found = find(value.as_py() or "")
                for k in BASE:
                    counts[k].append(sum(s[2] == k for s in found))
                base = ",".join(f"{k}:{a}:{b}" for a, b, k in found if k in counts)
                digests.append(hashlib.sha256(base.encode()).hexdigest())
                spans.append(",".join(f"{k}:{a}:{b}" for a, b, k in found))
            return [*[pa.array(counts[k], pa.int64()) for k in BASE], pa.array(digests), pa.array(spans)]

        return each

    return add_columns(df, FIELDS, work, [text], df.columns if keep is None else keep)
