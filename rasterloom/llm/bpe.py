"""Byte-level BPE encoding and decoding with reuse of content-defined chunks.

A rolling hash over a text's bytes cuts it into chunks, so that shared passages give shared chunks wherever they stand. An
index of all chunks (text, place, hash) tells which occur more than once. Each of those is encoded once, where it occurs
first; texts that hold such chunks meet their ids by a join on the chunk's hash. Only the text between and around them is
encoded, and each join is re-encoded from a sure boundary before it up to boundaries inside the chunk, further and
further, until the ids agree with the chunk's own. Texts without a shared chunk are encoded where they are read, and equal
texts once. Nothing is gathered in the driver, and there is no bound on how many chunks are shared.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_columns, is_small, lookup, stored

#: Pretokens of byte-level BPE (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Texts with other characters, or with white space runs so long that an expression may give up, go to the library itself.
UNUSUAL = re.compile(r"[^\x00-ɏ‐-‧‰-⁞₠-₿]|\s{4000}")
#: Letters that every version of the Unicode tables has, and punctuation: of ASCII, general, and of East Asian scripts.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿΑ-Ρα-ωА-яא-תء-غف-يक-हก-ฮ가-힣ぁ-ゖァ-ヺ一-龥"
_SIGNS = ",.;:!?)、。「」，！？；："
#: Where a pretoken begins, whatever stands around: a blank between letters, and a sign after a letter.
SURE = re.compile(f"(?<=[{_LETTERS}]) (?=[{_LETTERS}])|(?<=[{_LETTERS}])(?=[{_SIGNS}])")
WINDOW, CHUNK_BITS, LEAST, MOST = 32, 10, 256, 64 << 10
FIELDS = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]


class Codec:
    """Encodes as the tokenizers library does with the file at ``path`` (no special tokens added), and decodes as it does."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        first = spec.get("pre_tokenizer") or {}
        if spec.get("normalizer") or first.get("type") != "ByteLevel" or first.get("add_prefix_space") or not first.get("use_regex", True):
            raise ValueError("the tokenizer's file must have no normaliser and plain byte-level pretokens")
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        odd = [b for b in range(256) if b not in plain]
        letters = {chr(c): b for c, b in [*zip(plain, plain), *zip(range(256, 256 + len(odd)), odd)]}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        vocabulary = {t: n for t, n in spec["model"]["vocab"].items() if t not in self.special}
        ranks = {bytes(letters[c] for c in t): n for t, n in vocabulary.items()}
        self.fast = tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.bytes_of = dict(zip(ranks.values(), ranks)) | {n: t.encode() for t, n in self.special.items()}
        self.size = np.zeros(max(self.bytes_of) + 1, np.int64)
        for n, b in self.bytes_of.items():
            self.size[n] = len(b)
        self.marks = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.comma = np.array([f"{n}," for n in range(max(self.bytes_of) + 1)], "S")

    def coder(self, text: str) -> Callable[[str], list[int]]:
        """What encodes a text and its parts: the fast path, or the library where a character needs it."""
        if UNUSUAL.search(text) or self.marks and self.marks.search(text):
            return lambda part: self.library.encode(part, add_special_tokens=False).ids
        return self.fast.encode_ordinary

    def encode(self, text: str) -> list[int]:
        """The ids of a whole text."""
        return self.coder(text)(text)

    def bytes(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def decode(self, ids: list[int]) -> str:
        return self.bytes(ids).decode("utf-8", "replace")

    def digest(self, ids: list[int]) -> str:
        """SHA-256 of the decimal ids joined by commas."""
        h = hashlib.sha256()
        for at in range(0, len(ids), 1 << 20):
            part = self.comma[ids[at : at + (1 << 20)]].tobytes().replace(b"\0", b"")
            h.update(part if at + (1 << 20) < len(ids) else part[:-1])
        return h.hexdigest()


def cuts(data: bytes) -> list[int]:
    """Ends of the content-defined chunks of ``data``, its own end last.

    A chunk ends where a hash of the WINDOW bytes before has its low bits zero, after LEAST bytes or more, between
    characters. MOST is a bound for texts in which no such place comes.
    """
    if len(data) <= LEAST:
        return [len(data)]
    out, last = [], 0
    for at in range(0, len(data), 4 << 20):  # blocks overlap by a window
        first = max(0, at - WINDOW + 1)
        raw = np.frombuffer(data, np.uint8)[first : at + (4 << 20)]
        h, width, factor = raw.astype(np.uint32) * np.uint32(2654435761) + np.uint32(97), 1, 1000003
        while width < WINDOW and len(h) > width:  # each doubling adds the hash of as many bytes before
            h[width:] = h[width:] + h[:-width] * np.uint32(pow(factor, width, 1 << 32))
            width *= 2
        good = (h >> np.uint32(32 - CHUNK_BITS)) == 0
        good[:-1] &= (raw[1:] & 0xC0) != 0x80
        for end in (np.flatnonzero(good) + first + 1).tolist():
            if end > at and end - last >= LEAST and end >= WINDOW and end < len(data) and data[end] & 0xC0 != 0x80:
                out.append(end)
                last = end
    ends, last = [], 0
    for end in [*out, len(data)]:
        while end - last > MOST:
            last += MOST
            while data[last] & 0xC0 == 0x80:
                last -= 1
            ends.append(last)
        if end > last:
            ends.append(end)
            last = end
    return ends


def text_key(text: str):
    """Two longs by which equal texts are known, as columns: hashes with different seeds."""
    whole = F.coalesce(F.col(text), F.lit(""))
    return F.xxhash64(whole), F.xxhash64(F.lit(1), whole, F.length(whole))


def chunk_index(keyed: DataFrame, tokenizer: str) -> DataFrame:
    """(t0, t1, start, end, h0, h1): each chunk of LEAST bytes or more of the texts (t0, t1, text), by place and hash."""

    def run(batches):
        import xxhash

        codec = None
        for batch in batches:
            codec = codec or Codec(tokenizer)
            rows = []
            for t0, t1, value in zip(*[batch.column(batch.schema.get_field_index(c)) for c in ("t0", "t1", "text")]):
                text, last = value.as_py(), 0
                if codec.marks and codec.marks.search(text):  # a special token isn't read from parts
                    continue
                data = text.encode("utf-8", "surrogatepass")
                for end in cuts(data):
                    if end - last >= LEAST:
                        h = xxhash.xxh3_128_digest(data[last:end])
                        rows.append((t0.as_py(), t1.as_py(), last, end, int.from_bytes(h[:8], "big", signed=True), int.from_bytes(h[8:], "big", signed=True)))
                    last = end
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["t0", "t1", "start", "end", "h0", "h1"])

    long = keyed.where(F.octet_length("text") >= LEAST)
    return stored(long.mapInArrow(run, "t0 long, t1 long, start long, end long, h0 long, h1 long"), "chunks")


def shared_places(index: DataFrame) -> DataFrame:
    """(t0, t1, places): the places of shared chunks in each text that has any, and whether the chunk is encoded there."""
    first = F.min(F.struct("t0", "t1", "start")).alias("first")
    shared = stored(index.groupBy("h0", "h1").agg(F.count(F.lit(1)).alias("n"), first).where("n > 1").select("h0", "h1", "first"), "shared-chunks")
    own = F.struct("t0", "t1", "start") == F.col("first")
    place = F.struct("start", "end", "h0", "h1", own.alias("own"))
    return stored(lookup(index, shared, ["h0", "h1"], "inner", 120).groupBy("t0", "t1").agg(F.sort_array(F.collect_set(place)).alias("places")), "places")


def learn(codec: Codec, chunk: bytes) -> tuple[list[int], list[int], list[int]] | None:
    """A chunk's ids and its sure boundaries, as bytes and as tokens before; None if it has too few."""
    text = chunk.decode("utf-8", "surrogatepass")
    ids = codec.encode(text)
    at = np.append(0, np.cumsum(codec.size[ids]))
    sure = np.array([m.start() for m in SURE.finditer(text)], np.int64)
    if not text.isascii():
        sure = np.append(0, np.cumsum([len(c.encode("utf-8", "surrogatepass")) for c in text]))[sure]
    token = np.searchsorted(at, sure)
    if len(sure) < 3 or (at[token] != sure).any():
        return None
    return ids, *[np.append(x[:16], x[-1:]).tolist() for x in (sure, token)]


def encode_with(codec: Codec, text: str, known: Iterable[tuple]) -> list[int]:
    """The ids of a whole text, with those of known chunks (start, end, ids, byte, token) taken over and their joins repaired."""
    code, data = codec.coder(text), text.encode("utf-8", "surrogatepass")
    out: list[int] = []
    done = 0
    for start, end, ids, byte, token in known:
        # from a sure boundary before the join to one inside the chunk, until the two agree on what lies between
        for k in range(len(byte) - 2):
            if start + byte[k] <= done:
                continue
            window = code(data[done : start + byte[k + 1]].decode("utf-8", "surrogatepass"))
            own = list(ids[token[k] : token[k + 1]])
            if own and window[-len(own) :] == own:
                if codec.bytes(ids) != data[start:end]:  # another chunk under the same hash
                    break
                out += window
                out += ids[token[k + 1] : token[-1]]
                done = start + byte[-1]
                break
    return out + code(data[done:].decode("utf-8", "surrogatepass"))


def _lists(rows: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int32), *rows])))


def _answers(codec: Codec, found: list[list[int] | None], ids: bool) -> list[pa.Array]:
    """The new columns of some texts' ids; null for None."""
    counts = [None if f is None else len(f) for f in found]
    digests = [None if f is None else codec.digest(f) for f in found]
    decoded = [None if f is None else hashlib.sha256(codec.decode(f).encode("utf-8", "surrogatepass")).hexdigest() for f in found]
    return [pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string()), *([_lists([np.array(f or [], np.int32) for f in found])] if ids else [])]


def encoded_chunks(marked: DataFrame, tokenizer: str) -> DataFrame:
    """(h0, h1, ids, byte, token): each shared chunk, encoded at the place (text, places) that it is encoded at."""

    def run(batches):
        codec, kinds = None, [pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32())]
        for batch in batches:
            codec, rows = codec or Codec(tokenizer), []
            for text, places in zip(*[batch.column(batch.schema.get_field_index(c)) for c in ("text", "places")]):
                data = text.as_py().encode("utf-8", "surrogatepass")
                for place in places.as_py():
                    if place["own"] and (known := learn(codec, data[place["start"] : place["end"]])):
                        rows.append((place["h0"], place["h1"], np.array(known[0], np.int32).tobytes(), *known[1:]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["h0", "h1", "ids", "byte", "token"])

    owners = marked.where("exists(places, p -> p.own)").select("text", "places")
    every = owners.mapInArrow(run, "h0 long, h1 long, ids binary, byte array<int>, token array<int>")
    return stored(every.dropDuplicates(["h0", "h1"]), "encoded-chunks")  # copies of an owner's text encode it as well


def _met(tokenizer: str, ids: bool):
    """Rows of a text (null start) and of its chunks, sorted by text: the new columns of each text, once."""

    def run(batches):
        codec, now, text, known = Codec(tokenizer), None, None, []

        def answer() -> pa.RecordBatch:
            new = _answers(codec, [encode_with(codec, text, known)], ids)
            return pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int64()), pa.array([now[1]], pa.int64()), *new], names=["t0", "t1", *names])

        names = [f.name for f in FIELDS] + (["ids"] if ids else [])
        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(c)) for c in ("t0", "t1", "start", "end", "text", "ids", "byte", "token")]
            for k in range(batch.num_rows):
                t0, t1, start, end = (c[k].as_py() for c in columns[:4])
                if (t0, t1) != now:
                    if now is not None:
                        yield answer()
                    now, known = (t0, t1), []
                if start is None:
                    text = columns[4][k].as_py()
                else:
                    known.append((start, end, np.frombuffer(columns[5][k].as_py(), np.int32).tolist(), columns[6][k].as_py(), columns[7][k].as_py()))
        if now is not None:
            yield answer()

    return run


def encode_documents(df: DataFrame, tokenizer: str, text: str = "text", keep: list[str] | None = None, ids: bool = False) -> DataFrame:
    """The ``keep`` columns (all) with n_tokens, ids_sha256 and decoded_sha256 of each whole text; with ``ids`` also the ids.

    As the tokenizers library encodes with add_special_tokens=False, truncation and padding unused; a special token's
    string in a text is that token. Decoding keeps special tokens. A null text is empty. Repeated rows stay; texts may have
    any length. Kept columns named as a new one (in any case) give way to it.
    """
    fields = [*FIELDS, *([T.StructField("ids", T.ArrayType(T.IntegerType()))] if ids else [])]
    new = {f.name for f in fields}
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() not in new]
    t0, t1 = text_key(text)
    whole = F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")
    places = shared_places(chunk_index(df.select(t0.alias("t0"), t1.alias("t1"), whole), tokenizer))
    # kept columns travel in a struct, so that their names can't clash with those of the work
    rows = df.select(F.struct(F.lit(0).alias("__none"), *[F.col(f"`{c}`") for c in kept]).alias("kept"), t0.alias("t0"), t1.alias("t1"), whole)
    bytes_of = F.lit(64) + 72 * F.size("places")
    small = is_small(places, bytes_of)
    rows = lookup(rows, places, ["t0", "t1"], "left", bytes_of)
    if not small:
        rows = stored(rows, "met-places")  # read twice, so that the documents are shuffled once

    def once(batches):
        seen = set()
        for batch in batches:  # a task passes a marked text on once
            t0, t1, texts = [batch.column(batch.schema.get_field_index(c)) for c in ("t0", "t1", "text")]
            first = []
            for key in zip(t0.to_pylist(), t1.to_pylist()):
                first.append(key not in seen)
                seen.add(key)
            texts = pc.if_else(pa.array(first, pa.bool_()), texts, pa.scalar(None, texts.type))
            yield batch.set_column(batch.schema.get_field_index("text"), "text", texts)

    def work():
        codec = Codec(tokenizer)
        return lambda batch: _answers(codec, [codec.encode(t.as_py()) for t in batch.column(batch.schema.get_field_index("text"))], ids)

    plain = add_columns(rows.where("places IS NULL"), fields, work, ["text"], ["kept"])
    found = rows.where("places IS NOT NULL").select("kept", "t0", "t1", "text", "places")
    done = stored(found.mapInArrow(once, T.StructType([T.StructField(f.name, f.dataType) for f in found.schema])), "marked")
    marked = done.where("text IS NOT NULL").select("t0", "t1", "text", "places")
    chunks = encoded_chunks(marked, tokenizer)
    held = lookup(marked.select("t0", "t1", F.explode("places").alias("p")).select("t0", "t1", "p.*").drop("own").distinct(), chunks, ["h0", "h1"], "inner", F.lit(400) + F.length("ids"))
    shape = "t0 long, t1 long, start long, end long, text string, ids binary, byte array<int>, token array<int>"
    none = lambda kind: F.lit(None).cast(kind)
    texts = marked.select("t0", "t1", none("long").alias("start"), none("long").alias("end"), "text", none("binary").alias("ids"), none("array<int>").alias("byte"), none("array<int>").alias("token"))
    met = texts.unionByName(held.select("t0", "t1", "start", "end", none("string").alias("text"), "ids", "byte", "token"))
    met = met.repartition("t0", "t1").sortWithinPartitions("t0", "t1", F.asc_nulls_first("start"))
    answers = met.mapInArrow(_met(tokenizer, ids), T.StructType([T.StructField("t0", T.LongType()), T.StructField("t1", T.LongType()), *fields]))
    names = [f.name for f in fields]
    out = [*[F.col(f"kept.`{c}`") for c in kept], *names]
    direct = plain.select(*out)
    met = lookup(done.select("kept", "t0", "t1"), stored(answers, "answers"), ["t0", "t1"], "inner", F.lit(300) + (4 * F.col("n_tokens") if ids else 0))
    return direct.unionByName(met.select(*out))


def decode_documents(df: DataFrame, tokenizer: str, ids: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """The ``keep`` columns (all) and ``text`` decoded from a column of ids; null ids give a null text."""

    def work():
        codec = Codec(tokenizer)

        def each(batch: pa.RecordBatch) -> list[pa.Array]:
            rows = batch.column(batch.schema.get_field_index(ids)).to_pylist()
            return [pa.array([None if r is None else codec.decode(r) for r in rows], pa.string())]

        return each

    return add_columns(df, [T.StructField("text", T.StringType())], work, [ids], df.columns if keep is None else keep)
