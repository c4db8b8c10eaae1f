"""SimHash fingerprints, linked within a Hamming radius by BK-trees over shards.

A fingerprint is 64 bits (or a multiple) of word shingles. Only distinct fingerprints are linked. They are dealt into shards
of about SHARD fingerprints by some of their bits, several times over: either so that any two linked fingerprints share a
shard for certain (whole blocks of bits, of more blocks than the radius), or with a stated recall (sampled bits). Each shard
grows BK-trees, whose children are keyed by their integer Hamming distance to the parent. Trees meet the fingerprints of
their shard by a broadcast while all trees are small, beyond where the shuffle of shards brought them; a search follows only edges within the
radius of its distance to the parent. It gives out a spanning forest of its links, never all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .common import add_columns, discard, lookup, stored
from .components import components

SEED, WORDS, RADIUS, BITS = 42, 4, 4, 64
#: Fingerprints of a shard on average, those up to which there is one shard only, and those of a tree (a larger shard has several).
SHARD, ONE_SHARD, TREE = 256, 2048, 4096
#: Pairs of a fingerprint and a tree's node that a search holds at once.
PAIRS = 1 << 20
FIELD = T.StructField("fingerprint", T.LongType())


def shingle_hashes(parts: list[bytes], words: int) -> np.ndarray:
    """The XXH64 hashes of the shingles of ``parts``, repeats included; fewer parts than ``words`` are one shingle, none none."""
    import xxhash

    if not parts:
        return np.zeros(0, np.uint64)
    joined, ends = b" ".join(parts), [n - 1 for n in accumulate(len(p) + 1 for p in parts)]
    starts = [0, *[n + 1 for n in ends[:-1]]]
    take, digest = ends[min(words, len(ends)) - 1 :], xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, take)], "<u8")


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half the hashes; none: zero."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8), bitorder="little").reshape(-1, 64)
        ones += bits.sum(0, dtype=np.int64)
    return sum(1 << b for b in np.flatnonzero(2 * ones > len(hashes)).tolist())


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """Bits set in over half the XXH64 hashes of a text's word shingles, repeats included; no words: zero."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()  # ASCII letters and white space only
    return majority(shingle_hashes(parts, words))


def fingerprints(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The ``keep`` columns (all) and ``fingerprint``, as a signed long. Null and blank texts have fingerprint zero."""

    def work():
        def each(batch: pa.RecordBatch) -> list[pa.Array]:
            found = [fingerprint(t.as_py()) for t in batch.column(batch.schema.get_field_index(text))]
            return [pa.array(np.array(found, np.uint64).view(np.int64))]

        return each

    return add_columns(df, [FIELD], work, [text], df.columns if keep is None else keep)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hamming distances of the rows of two arrays of words."""
    return np.bitwise_count(a ^ b).sum(1, dtype=np.int64)


class Trees:
    """BK-trees, one for each run of rows of ``prints`` (n x words) that ``starts`` begin; the first row of a run is its root.

    ``up`` is each row's parent and ``edge`` its distance to it. All trees grow together, a level at a time: of the rows
    that hang below a node at the same distance, the first becomes the child and the others go on below it.
    """

    def __init__(self, prints: np.ndarray, starts: np.ndarray, up: np.ndarray | None = None, edge: np.ndarray | None = None):
        self.prints, self.starts = prints, starts
        n = len(prints)
        if up is None:
            sizes = np.diff(np.append(starts, n))
            up, edge = np.repeat(starts, sizes), np.zeros(n, np.int64)
            going = np.setdiff1d(np.arange(n), starts, assume_unique=True)
            while len(going):
                apart = distances(prints[going], prints[up[going]])
                keys, first, child = np.unique(up[going] << 16 | apart, return_index=True, return_inverse=True)
                born = going[first]
                edge[born] = apart[first]
                rest = np.ones(len(going), bool)
                rest[first] = False
                going, below = going[rest], born[child[rest]]
                up[going] = below
        self.up, self.edge = up, edge
        key = up << 16 | edge
        key[starts] = -1  # roots hang below nothing
        self.children = np.argsort(key, kind="stable")[len(starts) :]
        self.keys = key[self.children]

    @property
    def inner(self) -> int:
        """How many nodes have children."""
        return len(np.unique(self.up[self.children]))

    def search(self, asks: np.ndarray, roots: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(places in ``asks``, nodes) at most ``radius`` apart, each ask from its root on, edge by edge within the radius."""
        ask, node = np.arange(len(asks)), roots
        while len(ask):
            apart = distances(asks[ask], self.prints[node])
            near = apart <= radius
            yield ask[near], node[near]
            low = np.searchsorted(self.keys, node << 16 | np.maximum(apart - radius, 0))
            many = np.searchsorted(self.keys, node << 16 | apart + radius, "right") - low
            ask = np.repeat(ask, many)
            node = self.children[np.repeat(low - np.cumsum(many) + many, many) + np.arange(len(ask))]


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of every id to the least id that chains of the links ``a``, ``b`` join it with."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b, label, seen = at[: len(a)], at[len(a) :], np.arange(len(ids)), None
    while seen is None or (label != seen).any():
        seen = label.copy()
        low = np.minimum(label[a], label[b])
        for ends in (a, b):
            np.minimum.at(label, label[ends], low)
            np.minimum.at(label, ends, low)
        label = label[label]
    linked = np.flatnonzero(label != np.arange(len(ids)))
    return ids[linked], ids[label[linked]]


def _links(trees: Trees, nodes: np.ndarray, asks: np.ndarray, ask_ids: np.ndarray, roots: np.ndarray, sizes: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """A forest of the links that each slice of the asks finds, so many at once that pairs stay within PAIRS."""
    group = np.cumsum(sizes) // PAIRS
    for asked in np.split(np.arange(len(asks)), np.flatnonzero(np.diff(group)) + 1):
        found = [(ask_ids[asked[at]], nodes[node]) for at, node in trees.search(asks[asked], roots[asked], radius)]
        a, b = [np.concatenate(side) for side in zip(*found)] if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        if (apart := a != b).any():
            yield stars(a[apart], b[apart])


def forest(prints: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among distinct fingerprints, by one tree: each linked one and the first of its group."""
    n, rows = len(prints), prints.reshape(-1, 1)
    trees = Trees(rows, np.zeros(min(n, 1), np.int64))
    found = list(_links(trees, np.arange(n), rows, np.arange(n), np.zeros(n, np.int64), np.full(n, n), radius))
    a, b = stars(*[np.concatenate(side) for side in zip(*found)]) if found else (np.zeros(0, np.int64),) * 2
    return prints[a], prints[b]


def ids_of(prints: np.ndarray) -> np.ndarray:
    """A fingerprint's id: its word, or its words' exclusive or. Wide ones that share an id count as one node."""
    return np.bitwise_xor.reduce(prints.view(np.int64), 1)


def _grow(lead: int):
    """Rows (key, sub if ``lead`` is 2, f0, ...) sorted by shard: a row (key, sub, n, tree) for each tree.

    A tree is an array of longs: for each of its nodes the words, and its parent and edge.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def grown(rows: np.ndarray) -> pa.RecordBatch:
            starts = np.append(0, np.flatnonzero((rows[1:, :lead] != rows[:-1, :lead]).any(1)) + 1)
            trees = Trees(np.ascontiguousarray(rows[:, lead:]).view(np.uint64), starts)
            own = np.repeat(starts, np.diff(np.append(starts, len(rows))))
            flat = np.ascontiguousarray(np.column_stack([rows[:, lead:], (trees.up - own) << 16 | trees.edge]))
            ends = np.append(starts[1:], len(rows))
            packed = [flat[a:b].tobytes() for a, b in zip(starts, ends)]
            sub = rows[starts, 1] if lead == 2 else np.zeros(len(starts), np.int64)
            return pa.RecordBatch.from_arrays([pa.array(rows[starts, 0]), pa.array(sub), pa.array(ends - starts), pa.array(packed, pa.binary())], names=["key", "sub", "n", "tree"])

        kept = None
        for batch in batches:
            now = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64, copy=False) for c in range(batch.num_columns)])
            kept = now if kept is None else np.concatenate([kept, now])
            if not len(kept):
                continue
            last = int(np.flatnonzero(np.append(True, (kept[1:, :lead] != kept[:-1, :lead]).any(1)))[-1])  # a shard may go on in the next batch
            if last:
                yield grown(kept[:last])
            kept = kept[last:]
        if kept is not None and len(kept):
            yield grown(kept)

    return run


def _searched(words: int, radius: int):
    """Rows (tree, asks), both trees of a shard: the links between the fingerprints of the two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tree, asks = [[np.frombuffer(v.as_buffer(), np.int64).reshape(-1, words + 1) for v in batch.column(batch.schema.get_field_index(c))] for c in ("tree", "asks")]
            if not tree:
                continue
            sizes = np.array([len(t) for t in tree])
            starts, asked = np.cumsum(sizes) - sizes, np.array([len(a) for a in asks])
            flat = np.concatenate(tree)
            prints, asking = [np.ascontiguousarray(rows[:, :words]).view(np.uint64) for rows in (flat, np.concatenate(asks))]
            trees = Trees(prints, starts, (flat[:, -1] >> 16) + np.repeat(starts, sizes), flat[:, -1] & 0xFFFF)
            for a, b in _links(trees, ids_of(prints), asking, ids_of(asking), np.repeat(starts, asked), np.repeat(sizes, asked), radius):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return run


def key_bits(n: int, shard: int = SHARD) -> int:
    """Bits of a shard's key that leave about ``shard`` of ``n`` fingerprints in each; none where one shard holds all."""
    return 0 if n <= ONE_SHARD else math.ceil(math.log2(n / shard))


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def masks(n: int, radius: int) -> list[int]:
    """Masks of the bits that shards go by, as signed longs; any two fingerprints within the radius agree on one mask.

    Blocks are ``same`` more than the radius, so ``same`` whole ones at least are equal; a mask takes some bits of each of
    them. The fewest blocks that give enough bits are taken, since there is a mask for each choice of ``same`` blocks.
    """
    want = key_bits(n)
    if not want:
        return [0]
    same = next((s for s in range(1, 4) if 64 // (radius + s) * s >= want), 3)
    blocks = radius + same
    edges = [64 * k // blocks for k in range(blocks + 1)]
    part = [(1 << min(b, a - (-want // same))) - (1 << a) for a, b in zip(edges, edges[1:])]
    return [_signed(sum(c)) for c in combinations(part, same)]


def sampled_masks(n: int, bits: int, share: float, radius: int, recall: float, shard: int = SHARD // 2, seed: int = SEED) -> list[tuple[int, ...]]:
    """Masks of bits drawn at random, a tuple of signed longs each: as many as find a ``recall`` of the pairs whose bits
    differ with probability ``share`` each, of those within the radius."""
    want = min(key_bits(n, shard), bits // 2)
    luck = np.random.default_rng(seed)
    far = np.arange(radius + 1)
    odds = np.array([math.comb(bits, d) * share**d * (1 - share) ** (bits - d) for d in far])
    hit = np.array([math.comb(bits - d, want) / math.comb(bits, want) for d in far])
    out: list[tuple[int, ...]] = []
    while not out or want and (odds * (1 - (1 - hit) ** len(out))).sum() < recall * odds.sum():
        mask = sum(1 << int(b) for b in luck.choice(bits, want, replace=False))
        out.append(tuple(_signed(mask >> k & (1 << 64) - 1) for k in range(0, bits, 64)))
    return out


def shard_trees(prints: DataFrame, dealing: list[tuple[int, ...]]) -> DataFrame:
    """(key, sub, n, tree): the BK-trees of all shards of ``prints`` (f0 long, ...; distinct), stored.

    A shard of more than TREE fingerprints is dealt into several trees, so that no task gathers it.
    """
    words = [f"f{k}" for k in range(len(dealing[0]))]
    key = lambda k, mask: F.xxhash64(F.lit(k), *[F.col(f).bitwiseAND(F.lit(m)) for f, m in zip(words, mask)])
    dealt = prints.select(F.explode(F.array(*[key(k, m) for k, m in enumerate(dealing)])).alias("key"), *words)
    large = stored(dealt.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > TREE), "large-shards")
    shape = "key long, sub long, n long, tree binary"
    if large.isEmpty():
        return stored(dealt.repartition("key").sortWithinPartitions("key").mapInArrow(_grow(1), shape), "shard-trees")
    sub = F.coalesce(F.expr(f"pmod(xxhash64({', '.join(words)}, 3L), n div {TREE} + 1)"), F.lit(0)).cast("long")
    placed = lookup(dealt, large, ["key"], "left", 64).select("key", sub.alias("sub"), *words)
    return stored(placed.repartition("key", "sub").sortWithinPartitions("key", "sub").mapInArrow(_grow(2), shape), "shard-trees")


def linked(prints: DataFrame, dealing: list[tuple[int, ...]], radius: int) -> DataFrame:
    """(a, b): links between the ids of ``prints`` (f0 long, ...; distinct), stored, that join every two which a chain of
    links within shards joins.

    While all trees are small they are broadcast to the fingerprints of their shard. Beyond, a shard's fingerprints search
    its tree where the shuffle of shards has brought both, and only the trees of shards that have several are joined.
    """
    trees, words = shard_trees(prints, dealing), len(dealing[0])
    asks = trees.select("key", F.col("sub").alias("asking"), F.col("tree").alias("asks"))
    held = F.sum(F.length("tree") + 80)
    if (trees.agg(held).first()[0] or 0) <= common.BROADCAST_BYTES:
        met = asks.join(F.broadcast(trees), "key").where("sub <= asking").select("tree", "asks")
    else:
        several = stored(trees.where("sub > 0").select("key").distinct(), "split-shards")
        split = lookup(trees, several, ["key"], "inner", 64)
        split = F.broadcast(split) if (split.agg(held).first()[0] or 0) <= common.BROADCAST_BYTES else split
        met = trees.select("tree", F.col("tree").alias("asks")).union(asks.join(split, "key").where("sub < asking").select("tree", "asks"))
    links = stored(met.mapInArrow(_searched(words, radius), "a long, b long"), "tree-links")
    discard(trees)
    return links


def near_duplicates(df: DataFrame, text: str = "text", key: str = "doc_id", radius: int = RADIUS) -> DataFrame:
    """(key, fingerprint, component_id): a row for each row of ``df``, with the smallest key that links reach, its own included.

    Equal fingerprints and those at most ``radius`` bits apart are linked, those of null and blank texts (zero) as well.
    A null key is passed over for the component unless all of it are null. Repeated rows and keys stay. An empty table: no
    rows. Component ids are longs.
    """
    docs = stored(fingerprints(df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")), keep=["doc_id"]), "fingerprints")
    each = stored(docs.groupBy(F.col("fingerprint").alias("fp")).agg(F.min("doc_id").alias("least")), "distinct")
    links = linked(each.select(F.col("fp").alias("f0")), [(m,) for m in masks(each.count(), radius)], radius)
    joined = stored(components(links), "components")
    named = joined.join(each, joined.node == each.fp).groupBy("root").agg(F.min("least").alias("least"))
    named = stored(joined.join(named, "root").select(F.col("node").alias("fp"), F.col("least").alias("all_least")), "named")
    ids = stored(lookup(each, named, ["fp"], "left", 80).select(F.col("fp").alias("fingerprint"), F.coalesce("all_least", "least").alias("component_id")), "component-ids")
    return lookup(docs, ids, ["fingerprint"], "left", 80).select(F.col("doc_id").alias(key), F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
