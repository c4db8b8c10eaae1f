"""Benchmark decontamination by edit distance: CGK embedding with bit-sampling LSH, exact verification.

Texts and items are sequences of words. An item leaks into a text if some stretch of it is at most a fifth of the item's
words away in edit distance. Windows of a text are embedded by a random walk that copies a word at each step and moves on
or not by a random bit of that word, so that windows a few edits apart agree at most steps. Over a long window with many
edits two walks drift apart and seldom meet again; the embedding of an item-sized window therefore restarts its walk every
STRIDE words, and a repetition samples steps of one restart: some restart of a leak falls on a stretch with few edits. As
restarts are the same for every window that holds them, each place of a text is walked once a repetition, whatever the
items' lengths. Windows and items that agree at the sampled steps are candidates, verified by exact edit distance. Items
too short to be walked are found by exact pieces: one more than the edits they may have, of which one occurs unedited.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_columns

#: Share of an item's words that edits may touch; items of fewer words than WALK_WORDS are searched by exact pieces.
EDITS, WALK_WORDS = 0.2, 8
#: A walk takes STEPS steps from its start, of which a repetition samples SAMPLES; items start one at every STRIDE words.
STEPS, SAMPLES, STRIDE = 10, 6, 2
#: Repetitions by the most words that an item has. By measurement (tests/llm/test_decontam_recall.py) they find at least
#: RECALL of the leaks at exactly the radius, of each length and each kind of edit.
RECALL, REPEATS = 0.95, ((11, 24), (19, 8), (math.inf, 5))
#: Items sent to the workers at once; more are searched block by block.
BLOCK_ITEMS = 10_000
#: Bytes of text taken at once (a longer text by itself).
BATCH_BYTES = 2 << 20
PRIME = 0x9E3779B97F4A7C15
#: First bits of a hash that tables go by.
SLOT_BITS = 18
LEAK = T.ArrayType(T.StructType([T.StructField("item_id", T.LongType()), T.StructField("edits", T.IntegerType()), T.StructField("item_words", T.IntegerType()), T.StructField("end_word", T.IntegerType())]))
_ALNUM = np.array([chr(b).isalnum() if b < 128 else True for b in range(256)])
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash's base and of its inverse, modulo 2 ** 64."""
    if len(_powers.get("up", ())) < n:
        inverse = pow(PRIME, -1, 1 << 64)
        for name, base in (("up", PRIME), ("down", inverse)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps)
    return _powers["up"][:n], _powers["down"][:n]


def words_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, first word of each text and their number): lower-case runs of letters and digits, all texts at once."""
    parts = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)
    word = _ALNUM[data]
    high = np.flatnonzero(data >= 0xC2)
    for lead, width, second in ((0xC2, 2, None), (0xE2, 3, 0x80)):  # Latin-1 signs and general punctuation part words
        at = high[data[high] == lead]
        at = at if second is None else at[data[at + 1] == second]
        for k in range(width):
            word[at + k] = False
    edge = np.flatnonzero(np.diff(word, prepend=False, append=False))
    starts, ends = edge[::2], edge[1::2]
    up, down = _power(len(data))
    total = np.append(np.uint64(0), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up))
    hashes = (total[ends] - total[starts]) * down[starts] if len(starts) else np.zeros(0, np.uint64)
    sizes = np.array([len(p) + 1 for p in parts])
    first = np.searchsorted(starts, np.append(0, np.cumsum(sizes)))
    return hashes * np.uint64(0xD6E8FEB86659FD93), first


def _slot(key: np.ndarray) -> np.ndarray:
    return ((key * np.uint64(PRIME)) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def repetitions(words: int) -> int:
    return next(n for most, n in REPEATS if words <= most)


class Items:
    """A block of benchmark items, ready to be searched for."""

    def __init__(self, items: list[tuple[int, str]], repeats: int | None = None, seed: int = 5):
        hashes, first = words_of([text for _, text in items])
        self.vocabulary, symbols = np.unique(hashes, return_inverse=True)
        n = len(self.vocabulary)
        self.none, self.past = n, n + 1  # a word of no item; past the end
        slots = (self.vocabulary >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        #: By the first bits of a word's hash: its symbol, or ``past`` where several words of items have them.
        self.slots = np.full(1 << SLOT_BITS, self.none, np.int32)
        self.slots[slots] = np.arange(n)
        self.slots[slots[1:][slots[1:] == slots[:-1]]] = self.past
        self.words = [symbols[a:b].astype(np.int32) for a, b in zip(first, first[1:])]
        self.ids = [i for i, _ in items]
        self.masks: dict[int, dict[int, int]] = {}
        self.held: dict[int, np.ndarray] = {}
        luck = np.random.default_rng(seed)
        walked = [k for k, w in enumerate(self.words) if len(w) >= WALK_WORDS]
        many = {k: repeats or repetitions(len(self.words[k])) for k in walked}
        #: By repetition: each word's random bits, the sampled steps, the items' keys after each, and by whole key the items and places.
        self.walks = []
        for r in range(max(many.values(), default=0)):
            bits = luck.integers(0, 1 << 64, n + 2, dtype=np.uint64)
            sampled = np.sort(luck.choice(STEPS, SAMPLES, replace=False)).tolist()
            own = [(k, at) for k in walked if r < many[k] for at in range(0, len(self.words[k]) - SAMPLES + 1, STRIDE)]
            rows = np.concatenate([np.append(self.words[k], np.full(STEPS, self.past, np.int32)) for k in walked])
            base = dict(zip(walked, np.cumsum([0, *[len(self.words[k]) + STEPS for k in walked]]).tolist()))
            keys = self.walk(rows, np.array([base[k] + at for k, at in own], np.int64), bits, sampled)
            table = defaultdict(list)
            for key, place in zip(keys[-1].tolist(), own):
                table[key].append(place)
            first_words = np.zeros(n + 2, bool)
            first_words[rows[keys[0]]] = True
            levels = []
            for level in keys[1:]:
                maybe = np.zeros(1 << SLOT_BITS, bool)
                maybe[_slot(level)] = True
                levels.append((maybe, np.unique(level)))
            self.walks.append((bits, sampled, first_words, levels, dict(table)))
        tables: dict[int, dict[int, list[tuple[int, int]]]] = defaultdict(lambda: defaultdict(list))
        for k, w in enumerate(self.words):
            if 0 < len(w) < WALK_WORDS:
                cuts = int(EDITS * len(w)) + 1
                size = len(w) // cuts
                for start in (p * len(w) // cuts for p in range(cuts)):
                    tables[size][int(self.runs(w[start : start + size], np.zeros(1, np.int64), size)[0])].append((k, start))
        #: Of short items, by length in words: the sorted keys of pieces, and for each its items and its places in them.
        self.pieces = {size: (np.array(sorted(table), np.uint64), dict(table)) for size, table in tables.items()}

    @staticmethod
    def runs(symbols: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
        """A key of the ``size`` words from each place."""
        key = np.zeros(len(at), np.uint64)
        for k in range(size):
            key = key * np.uint64(0x100000001B3) + symbols[at + k].astype(np.uint64) + np.uint64(1)
        return key

    def walk(self, symbols: np.ndarray, at: np.ndarray, bits: np.ndarray, sampled: list[int], first: np.ndarray | None = None, levels: list[tuple[np.ndarray, np.ndarray]] | None = None):
        """Walk from each place ``at``, and hash the sampled steps' words into a key, step by step.

        Without ``levels``: the places of the first sampled step and the keys after each. With the items' own first words
        and keys, a walk is dropped as soon as its key so far is no item's: the final keys, and the walks that are left.
        """
        place, key, live, seen = at.copy(), np.zeros(len(at), np.uint64), np.arange(len(at)), []
        for step in range(sampled[-1] + 1):
            out = symbols[place]
            if step in sampled:
                n = sampled.index(step)
                if levels is None:
                    seen += [place.copy()] if n == 0 else []
                elif n == 0:
                    keep = np.flatnonzero(first[out])
                    place, live, key, out = place[keep], live[keep], key[keep], out[keep]
                key = key * np.uint64(0x100000001B3) + out.astype(np.uint64) + np.uint64(1)
                if levels is None:
                    seen.append(key)
                else:
                    maybe, own = levels[n]
                    if n:  # the first word alone has been looked up
                        keep = np.flatnonzero(maybe[_slot(key)])
                        keep = keep[own[np.minimum(np.searchsorted(own, key[keep]), len(own) - 1)] == key[keep]]
                        place, key, live, out = place[keep], key[keep], live[keep], out[keep]
            place += (bits[out] >> np.uint64(step)).astype(np.int64) & 1
        return seen if levels is None else (key, live)

    def has(self, k: int) -> np.ndarray:
        """Whether each symbol is a word of item ``k``."""
        if k not in self.held:
            held = np.zeros(self.past + 1, bool)
            held[self.words[k]] = True
            self.held = {k: held} if len(self.held) > 4096 else self.held | {k: held}
        return self.held[k]

    def distance(self, k: int, region: np.ndarray) -> tuple[int, int]:
        """(edits, end) of the stretch of ``region`` nearest to item ``k``, by bit-parallel dynamic programming."""
        word = self.words[k]
        if k not in self.masks:
            mask: dict[int, int] = defaultdict(int)
            for n, s in enumerate(word.tolist()):
                mask[s] |= 1 << n
            self.masks[k] = dict(mask)
        mask, m = self.masks[k], len(word)
        full, top = (1 << m) - 1, 1 << (m - 1)
        up, down, score = full, 0, m
        best, end = m, 0
        for n, s in enumerate(region.tolist(), 1):
            eq = mask.get(s, 0)
            x = eq | down
            flat = (((eq & up) + up) ^ up) | eq
            plus, minus = down | (~(flat | up) & full), up & flat
            score += (plus & top != 0) - (minus & top != 0)
            plus, minus = plus << 1 & full, minus << 1 & full
            up, down = minus | (~(x | plus) & full), plus & x
            if score < best:
                best, end = score, n
        return best, end

    def search(self, texts: list[str]) -> list[list[dict]]:
        """For each text, its leaks by item: the fewest edits, the item's words, and the end of the stretch."""
        hashes, first = words_of(texts)
        symbols = self.slots[(hashes >> np.uint64(64 - SLOT_BITS)).astype(np.int64)]
        known = np.flatnonzero(symbols != self.none)
        place = symbols[known]
        shared = place == self.past
        place[shared] = np.minimum(np.searchsorted(self.vocabulary, hashes[known[shared]]), max(0, len(self.vocabulary) - 1))
        real = self.vocabulary[place] == hashes[known] if len(known) else np.zeros(0, bool)
        symbols[known] = np.where(real, place, np.int32(self.none))
        starts, text_of = first[:-1], lambda at: (np.searchsorted(first, at, "right") - 1).tolist()
        pairs: set[tuple[int, int, int]] = set()  # (where the item would begin, item, text)
        padded = np.append(symbols, np.full(STEPS, self.past, np.int32))
        at = np.flatnonzero(symbols != self.none)
        for bits, sampled, words, levels, table in self.walks:
            keys, live = self.walk(padded, at, bits, sampled, words, levels)
            for w, key, text in zip(at[live].tolist(), keys.tolist(), text_of(at[live])):
                pairs.update((w - place, k, text) for k, place in table[key])
        count = np.append(0, np.cumsum(symbols != self.none))
        for size, (own, table) in self.pieces.items():
            at = np.flatnonzero(count[size:] - count[:-size] == size)  # whole runs of the items' words
            keys = self.runs(symbols, at, size)
            hit = np.flatnonzero(own[np.minimum(np.searchsorted(own, keys), len(own) - 1)] == keys)
            for w, key, text in zip(at[hit].tolist(), keys[hit].tolist(), text_of(at[hit])):
                pairs.update((w - place, k, text) for k, place in table[key])
        regions: dict[tuple[int, int], list[int]] = defaultdict(list)
        for begin, k, text in sorted((begin, k, text) for begin, k, text in pairs):
            regions[text, k].append(begin)
        leaks: list[dict[int, tuple[int, int]]] = [{} for _ in texts]
        for (text, k), begins in regions.items():
            m = len(self.words[k])
            most = int(EDITS * m)
            for a, b in merged(begins, most, m + 2 * most):
                a, b = max(int(starts[text]), a), min(int(first[text + 1]), b)
                if np.count_nonzero(self.has(k)[symbols[a:b]]) < m - most:
                    continue
                edits, end = self.distance(k, symbols[a:b])
                if edits <= most and edits < leaks[text].get(k, (m + 1, 0))[0]:
                    leaks[text][k] = (edits, int(a + end - starts[text]))
        return [[{"item_id": self.ids[k], "edits": e, "item_words": len(self.words[k]), "end_word": end} for k, (e, end) in sorted(of.items())] for of in leaks]


def merged(begins: list[int], before: int, length: int) -> Iterator[tuple[int, int]]:
    """The regions from ``before`` ahead of each of the sorted ``begins``, ``length`` long, those that touch as one."""
    a = b = None
    for begin in begins:
        if b is not None and begin - before <= b:
            b = begin - before + length
            continue
        if b is not None:
            yield a, b
        a, b = begin - before, begin - before + length
    if b is not None:
        yield a, b


def leaks(df: DataFrame, benchmark: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The ``keep`` columns (all) and ``leaks``: an array of (item_id, edits, item_words, end_word) by benchmark order.

    ``benchmark`` has item_id and text; rows with a null text or without a word are not searched. An item may differ in a
    fifth of its words, rounded down: none up to four words. Items that share an id are searched each. Null and empty texts have no leaks. Whole texts of any length; rows pass one
    by one, repeated rows too. The benchmark is sent in blocks of BLOCK_ITEMS items, each searched in one more pass.
    """
    items = benchmark.where("text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("text"))
    blocks = max(1, -(-items.count() // BLOCK_ITEMS))
    keep = df.columns if keep is None else keep
    out, names = df, []
    for b in range(blocks):
        rows = items.where(F.expr(f"pmod(xxhash64(item_id, text), {blocks}) = {b}")).collect()
        block = sorted(((r["item_id"], r["text"]) for r in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1]))

        def work(block=block):
            known = Items(block) if block else None

            def each(batch: pa.RecordBatch) -> list[pa.Array]:
                found, texts, size = [], [], 0
                for value in batch.column(batch.schema.get_field_index(text)):
                    texts.append(value.as_py() or "")
                    size += len(texts[-1])
                    if size >= BATCH_BYTES:
                        found += known.search(texts) if known else [[] for _ in texts]
                        texts, size = [], 0
                if texts:
                    found += known.search(texts) if known else [[] for _ in texts]
                kind = pa.list_(pa.struct([("item_id", pa.int64()), ("edits", pa.int32()), ("item_words", pa.int32()), ("end_word", pa.int32())]))
                return [pa.array(found, kind)]

            return each

        names.append("leaks" if blocks == 1 else f"__leaks_{b}")
        out = add_columns(out, [T.StructField(names[-1], LEAK)], work, [text], list(dict.fromkeys([*keep, *names[:-1], *([text] if b < blocks - 1 else [])])))
    if blocks > 1:
        out = out.withColumn("leaks", F.concat(*[F.col(n) for n in names])).drop(*names)
    return out
