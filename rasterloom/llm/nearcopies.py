"""Near copies: texts whose sets of word shingles have a Jaccard similarity of LEAST or more, by SimHash and an exact check.

The SimHash of a set of shingles has BITS bits here, which leave sets that similar at most RADIUS bits apart. Candidates
are the groups that BK-tree searches within that radius join, in shards of sampled bits. All pairs of a group are then
compared by their shingles; the members of a large one are dealt into blocks, each pair of which is compared by itself.
Copies with equal sets are one node throughout. What is given out are links that join what the pairs join, never all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import simhash
from .common import add_columns, is_small, lookup, stored
from .components import components

SEED, WORDS, LEAST, BITS, RECALL = 42, 5, 0.8, 128, 0.985
#: Probability that a bit of two sets at the least similarity differs: the angle between them over a half turn.
SHARE = math.acos(2 * LEAST / (1 + LEAST)) / math.pi
#: Bits apart that all but a thousandth of such sets are within.
RADIUS = next(r for r in range(BITS) if sum(math.comb(BITS, d) * SHARE**d * (1 - SHARE) ** (BITS - d) for d in range(r + 1)) >= 0.999)
#: Fingerprints of a shard on average. Wide radii cut few edges, so shards are chosen for few copies of each fingerprint.
SHARD = 768
#: Nodes of a block, and their shingles; a group's nodes are compared at once where they are no more. Long texts fill a
#: block sooner, so that what a task holds doesn't grow with their length.
BLOCK, BLOCK_SHINGLES = 1024, 2 << 20
FIELDS = [T.StructField(n, T.LongType()) for n in ("__digest", "__f0", "__f1", "__size")]


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The sorted distinct XXH64 hashes of a text's lower-case word shingles; a shorter text is one, a blank one has none."""
    return np.unique(simhash.shingle_hashes([w.encode("utf-8", "surrogatepass") for w in (text or "").lower().split()], words))


def wide_print(hashes: np.ndarray) -> tuple[int, int]:
    """The SimHash of a set in two words, the second over the hashes mixed once more."""
    mixed = (hashes ^ (hashes >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return simhash.majority(hashes), simhash.majority(mixed ^ (mixed >> np.uint64(32)))


def forest(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links (by place) that join every two of the sets that a chain of pairs at least LEAST similar joins."""
    sizes = np.array([len(s) for s in sets])
    order = np.argsort(sizes, kind="stable")
    words, at = np.unique(np.concatenate([sets[k] for k in order]), return_inverse=True)
    sizes = sizes[order]
    starts = np.append(0, np.cumsum(sizes))
    label, links, mark = np.arange(len(sets)), [], np.zeros(len(words), bool)
    for k in range(len(sets)):
        end = int(np.searchsorted(sizes, sizes[k] / LEAST, "right"))  # larger sets can't be similar enough
        if end <= k + 1 or (label[k + 1 : end] == label[k]).all():
            continue
        own = at[starts[k] : starts[k + 1]]
        mark[own] = True
        both = np.add.reduceat(mark[at[starts[k + 1] : starts[end]]], starts[k + 1 : end] - starts[k + 1], dtype=np.int64)
        mark[own] = False
        for near in (k + 1 + np.flatnonzero(both >= LEAST * (sizes[k] + sizes[k + 1 : end] - both))).tolist():
            if label[near] != label[k]:
                links.append((int(order[k]), int(order[near])))
                label[label == label[near]] = label[k]
    return links


def featured(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """The ``keep`` columns, ``__digest`` of the set of shingles, its SimHash, ``__f0`` and ``__f1`` (null where it is empty),
    and its ``__size``."""

    def work():
        import xxhash

        def each(batch: pa.RecordBatch) -> list[pa.Array]:
            sets = [shingles(t.as_py()) for t in batch.column(batch.schema.get_field_index(text))]
            digests = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64)
            prints = np.array([wide_print(s) for s in sets], np.uint64).reshape(-1, 2).view(np.int64)
            blank = np.array([not len(s) for s in sets], bool)
            sizes = pa.array([len(s) for s in sets], pa.int64())
            return [pa.array(digests), *[pa.array(np.ascontiguousarray(prints[:, k]), mask=blank) for k in (0, 1)], sizes]

        return each

    return add_columns(df, FIELDS, work, [text], keep)


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of each run of rows with the same group and blocks."""
    group, nodes, sets = None, [], []

    def links() -> pa.RecordBatch:
        found = forest(sets) if len(sets) > 1 else []
        return pa.RecordBatch.from_arrays([pa.array([nodes[p[e]] for p in found], pa.int64()) for e in (0, 1)], names=["a", "b"])

    for batch in batches:
        columns = [batch.column(batch.schema.get_field_index(c)) for c in ("root", "one", "two", "digest", "text")]
        for k in range(batch.num_rows):
            *now, node, text = (c[k].as_py() for c in columns)
            if now != group:
                yield links()
                group, nodes, sets = now, [], []
            nodes.append(node)
            sets.append(shingles(text))
    yield links()


def candidate_groups(sets: DataFrame) -> DataFrame:
    """(node, root): the groups of more than one that fingerprints within the radius join, from (digest, f0, f1) by set."""
    known = sets.where("f0 IS NOT NULL").select("digest", "f0", "f1", F.col("f0").bitwiseXOR(F.col("f1")).alias("id"))
    prints = stored(known.select("f0", "f1").distinct(), "prints")
    dealing = simhash.sampled_masks(prints.count(), BITS, SHARE, RADIUS, RECALL, SHARD)
    links = simhash.linked(prints, dealing, RADIUS)
    # fingerprints stand for the sets that have them: those without a link of their own matter where several sets share one
    named = components(links).select(F.col("node").alias("id"), "root")
    grouped = known.join(named, "id", "left").select(F.col("digest").alias("node"), F.coalesce("root", "id").alias("group"))
    several = stored(grouped.groupBy("group").agg(F.min("node").alias("root"), F.count(F.lit(1)).alias("n")).where("n > 1"), "groups")
    return stored(lookup(grouped, several.drop("n"), ["group"], "inner", 64).select("node", "root"), "candidate-groups")


def one_of_each(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row of each group of near copies, that with the smallest key (a null key only where all are null).

    Groups are closed under chains of links. Null and blank texts are one group. An empty table: no rows. Other columns
    pass through whatever their names, but for those that begin with two underscores.
    """
    rows = stored(featured(df, text, df.columns).withColumn("__row", F.monotonically_increasing_id()), "featured")
    first = F.min(F.struct(F.col(key).isNull().alias("unnamed"), F.col(key).alias("key"), F.col("__row").alias("row")))
    same = [F.first(f"__{c}").alias(c) for c in ("f0", "f1", "size")]  # equal sets, equal values
    each = stored(rows.groupBy(F.col("__digest").alias("digest")).agg(first.alias("first"), *same), "distinct-sets")
    groups = candidate_groups(each.select("digest", "f0", "f1"))
    found = stored(groups.join(each.select(F.col("digest").alias("node"), F.col("first.row").alias("__row"), "size"), "node"), "candidates")
    blocks = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("size") / BLOCK_SHINGLES))
    sizes = stored(found.groupBy("root").agg(blocks.alias("blocks")), "group-sizes")
    members = lookup(found, sizes, ["root"], "inner", 48).select("__row", F.col("node").alias("digest"), "root", "blocks")
    members = F.broadcast(members) if is_small(found, 64) else members
    texts = rows.select("__row", F.col(text).alias("__text")).join(members, "__row")
    own, other = F.expr("pmod(xxhash64(digest), blocks)"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    dealt = texts.select("root", "digest", F.col("__text").alias("text"), own.alias("own"), other.alias("other")).select("root", F.least("own", "other").alias("one"), F.greatest("own", "other").alias("two"), "digest", "text")
    dealt = dealt.repartition("root", "one", "two").sortWithinPartitions("root", "one", "two", "digest")
    links = dealt.mapInArrow(_linked, "a long, b long")
    groups = stored(components(links), "near-copy-groups").withColumnRenamed("node", "digest")
    chosen = each.join(groups, "digest", "left").groupBy(F.coalesce("root", "digest")).agg(F.min("first").alias("first"))
    chosen = stored(chosen.select(F.col("first.row").alias("__row")), "chosen")
    return lookup(rows, chosen, ["__row"], "left_semi", 48).select(*df.columns)
