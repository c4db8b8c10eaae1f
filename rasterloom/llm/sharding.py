"""Uniform shuffle into shards of exact size by a hypergeometric communication matrix. DataFrame functions only.

The rows stay where they were read, in at most ``max_sources`` source partitions. Each is permuted locally, and how
many of its rows go to each cell is drawn from the multivariate hypergeometric law, so that both its row count and
each cell's size come out exactly. A row's place in its source's permutation gives its cell; one exchange brings the
cells together, and each is permuted again. A shard is one cell, or several where there are many rows; where the matrix
would grow too wide, cells are permuted in parts of bounded size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .common import stored, without

KEY, MID, SRC, POS, CELL, PART = "__shard_key", "__shard_mid", "__shard_src", "__shard_pos", "__shard_cell", "__shard_part"
#: monotonically_increasing_id() keeps the partition above this many bits.
ROW_BITS = 33


def _bind(values: str, name: str, body: str) -> str:
    """``body`` with ``name`` bound to ``values``, which is computed once."""
    return f"element_at(transform(array({values}), {name} -> {body}), 1)"


def _log_factorial(k: str) -> str:
    """SQL for ln k!, by Stirling's series beyond 20."""
    x = f"CAST({k} AS DOUBLE)"
    return f"IF({k} <= 20, ln(CAST(factorial(CAST({k} AS INT)) AS DOUBLE)), ({x} + 0.5D) * ln({x}) - {x} + 0.9189385332046728D + 1D / (12D * {x}) - 1D / (360D * pow({x}, 3)) + 1D / (1260D * pow({x}, 5)))"


def uniform(*parts: str) -> str:
    """SQL for a double above 0 and below 1 by hash."""
    return f"((CAST(shiftrightunsigned(xxhash64({', '.join(parts)}), 12) AS DOUBLE) + 0.5D) / 4503599627370496D)"


def _inverted(u: str) -> str:
    """SQL for the variate of p (pool n, good g, draws d) by inversion: weights by their ratios over 12 standard deviations
    around the mode; beyond, they are under 1e-30."""
    ratio = "CAST((w.g - k) AS DOUBLE) * (w.d - k) / (CAST(k + 1 AS DOUBLE) * (w.n - w.g - w.d + k + 1))"
    total = f"aggregate(sequence(w.a, w.b), named_struct('w', 1D, 't', 0D), (s, k) -> named_struct('w', s.w * {ratio}, 't', s.t + s.w), s -> s.t)"
    pick = f"aggregate(sequence(w.a, w.b), named_struct('w', 1D, 't', 0D, 'x', w.a), (s, k) -> named_struct('w', s.w * {ratio}, 't', s.t + s.w, 'x', IF(s.t + s.w <= {u} * t, k + 1, s.x)), s -> least(s.x, w.b))"
    low, high = "greatest(0L, p.d - (p.n - p.g))", "least(p.d, p.g)"
    ends = f"named_struct('n', p.n, 'g', p.g, 'd', p.d, 'a', least(greatest({low}, p.mode - p.spread), {high}), 'b', greatest(least({high}, p.mode + p.spread), {low}))"
    return _bind(ends, "w", _bind(total, "t", pick))


#: Trials by ratio of uniforms before inversion takes over; one is accepted with a probability above a half.
TRIALS = 40
#: Up to this many standard deviations' worth of weights, inversion is used at once.
NARROW = 40


def hypergeometric(pool: str, good: str, draws: str, *key: str) -> str:
    """SQL for a hypergeometric variate: how many of ``draws`` rows out of ``pool`` are ``good``. Its luck is a hash of ``key``.

    By ratio of uniforms, whose cost doesn't grow with the numbers: a point (v, u) of the hat's rectangle is accepted where
    2 ln v is at most the logarithm of the weight against the mode's. Narrow laws, and the unlikely case that no trial is
    accepted, are drawn by inversion.
    """
    share = "(CAST(q.d AS DOUBLE) * q.g / greatest(q.n, 1L))"
    variance = f"({share} * (1 - CAST(q.g AS DOUBLE) / greatest(q.n, 1L)) * (q.n - q.d) / greatest(q.n - 1, 1L))"
    spread = f"CAST(ceil(12 * sqrt({variance})) AS BIGINT) + 24"
    mode = "CAST(floor(CAST(q.d + 1 AS DOUBLE) * (q.g + 1) / (q.n + 2)) AS BIGINT)"
    hat = f"1.7155277699214135D * sqrt({variance} + 0.5D) + 0.8989161620588988D"  # 2 sqrt(2 / e), 3 - 2 sqrt(3 / e)
    weight = lambda k: " + ".join(_log_factorial(f"({x})") for x in (k, f"z.g - {k}", f"z.d - {k}", f"z.n - z.g - z.d + {k}"))
    top = f"named_struct('n', p.n, 'g', p.g, 'd', p.d, 'mean', p.mean, 'hat', p.hat, 'top', {weight('z.mode').replace('z.', 'p.')})"
    legal = "k >= greatest(0L, z.d - (z.n - z.g)) AND k <= least(z.d, z.g)"
    trial = _bind(f"CAST(floor(z.mean + 0.5D + z.hat * ({uniform(*key, 'j', '2L')} - 0.5D) / v) AS BIGINT)", "k", f"IF({legal}, IF(2 * ln(v) <= z.top - ({weight('k')}), k, NULL), NULL)")
    trial = _bind(uniform(*key, "j", "1L"), "v", trial)
    tries = f"aggregate(sequence(1L, {TRIALS}L), CAST(NULL AS BIGINT), (x, j) -> IF(x IS NOT NULL, x, {trial}))"
    start = f"named_struct('n', CAST({pool} AS BIGINT), 'g', CAST({good} AS BIGINT), 'd', CAST({draws} AS BIGINT))"
    known = f"named_struct('n', q.n, 'g', q.g, 'd', q.d, 'mean', {share}, 'mode', {mode}, 'spread', {spread}, 'hat', {hat})"
    slow = _inverted(uniform(*key, "0L", "3L"))
    return _bind(start, "q", _bind(known, "p", f"IF(p.spread <= {NARROW}, {slow}, coalesce({_bind(top, 'z', tries)}, {slow}))"))


def _deal(items: str, room: str, seed: int) -> str:
    """SQL for rows of the matrix: each of ``items`` (id, n) takes n places out of ``room``, cell by cell."""
    draw = hypergeometric("c.pool", "element_at(s0.room, c0)", "c.need", f"{seed}L", "i.id", "c0")
    step = _bind(draw, "x", "named_struct('need', c.need - x, 'pool', c.pool - element_at(s0.room, c0), 'take', concat(c.take, array(x)))")
    zero = "named_struct('need', i.n, 'pool', aggregate(s0.room, 0L, (a, v) -> a + v), 'take', CAST(array() AS ARRAY<BIGINT>))"
    row = f"aggregate(sequence(1, size(s0.room)), {zero}, (c, c0) -> {step}, c -> c.take)"
    after = _bind(row, "t", "named_struct('room', zip_with(s0.room, t, (a, b) -> a - b), 'out', concat(s0.out, array(named_struct('id', i.id, 'take', t))))")
    none = f"named_struct('room', {room}, 'out', CAST(array() AS ARRAY<STRUCT<id: BIGINT, take: ARRAY<BIGINT>>>))"
    return f"aggregate({items}, {none}, (s0, i) -> {after}, s0 -> s0.out)"


def communication_matrix(counts: DataFrame, capacities: list[int], seed: int, fan: int = 32) -> DataFrame:
    """(id, take): for each source of ``counts`` (id long, n long), its exact row count for each cell.

    Drawn down a tree of sources: each group deals the rows that it was dealt to its ``fan`` members. The groups of a level
    are independent and spread over tasks, so that no task draws for more than a few of them.
    """
    most = counts.agg(F.max("id")).first()[0]
    if most is None:
        return counts.selectExpr("id", "CAST(array() AS ARRAY<BIGINT>) AS take")
    levels = 1
    while fan**levels <= most:
        levels += 1
    room = ", ".join(f"{c}L" for c in capacities)
    dealt = counts.sparkSession.range(1).select(F.lit(0).cast("long").alias("grp"), F.expr(f"array({room})").alias("room"))
    for level in range(levels - 1, -1, -1):
        own = counts.groupBy(F.expr(f"id div {fan**level}L").alias("id")).agg(F.sum("n").alias("n"))
        members = own.groupBy(F.expr(f"id div {fan}L").alias("grp")).agg(F.expr("sort_array(collect_list(named_struct('id', id, 'n', n)))").alias("members"))
        tasks = max(1, min(1024, -(-(most + 1) // fan ** (level + 1))))
        rows = members.join(dealt, "grp").repartition(tasks, "grp").select(F.inline(F.expr(_deal("members", "room", seed + level))))
        dealt = stored(rows, "matrix").select(F.col("id").alias("grp"), F.col("take").alias("room"))
    return dealt.select(F.col("grp").alias("id"), F.col("room").alias("take"))


def _running(values: str) -> str:
    """SQL for the running sums of an array."""
    return f"aggregate({values}, CAST(array() AS ARRAY<BIGINT>), (a, v) -> concat(a, array(coalesce(try_element_at(a, -1), 0L) + v)))"


def _place(ends: str, at: str, n: int) -> str:
    """SQL for how many of the ``n`` ascending ``ends`` are at most ``at``, by halving."""
    halve = "IF(s.a >= s.b, s, IF(element_at(%s, CAST((s.a + s.b) div 2 AS INT) + 1) <= %s, named_struct('a', CAST((s.a + s.b) div 2 AS INT) + 1, 'b', s.b), named_struct('a', s.a, 'b', CAST((s.a + s.b) div 2 AS INT))))" % (ends, at)
    return f"aggregate(sequence(0, {n.bit_length()}), named_struct('a', 0, 'b', {n}), (s, j) -> {halve}, s -> s.a)"


def shuffle_into_shards(
    df: DataFrame,
    n_shards: int = 24,
    seed: int = 7,
    max_sources: int = 1 << 16,
    rows_per_cell: int = 100_000,
    max_cells: int = 480,
) -> DataFrame:
    """All rows with ``shard`` (int, from 0) and ``slot`` (long, gapless from 0 in each shard), in uniform random order.

    Shard sizes differ by one row at most. Any columns, nulls, repeated rows and texts of any length pass through; an
    empty table stays empty. Input columns named shard or slot are replaced. Rows are written once to the shared
    folder, so that sources stay as they were counted. The matrix has at most ``max_sources * max_cells`` entries; where
    cells of ``rows_per_cell`` rows would be more, each is permuted in parts, which random keys deal its rows into.
    """
    rows = without(df, ["shard", "slot", KEY, MID, SRC, POS, CELL, PART])
    names = rows.columns
    placed = (
        rows.coalesce(max_sources)
        .withColumn(KEY, F.xxhash64(F.lit(seed), F.monotonically_increasing_id()))
        .sortWithinPartitions(KEY)
        .withColumn(MID, F.monotonically_increasing_id())
        .drop(KEY)
    )
    placed = stored(placed, "sharding").withColumns({SRC: F.shiftright(MID, ROW_BITS), POS: F.col(MID).bitwiseAND(F.lit((1 << ROW_BITS) - 1))})
    counts = stored(placed.groupBy(F.col(SRC).alias("id")).agg(F.count(F.lit(1)).alias("n")), "source-sizes")
    n, sources = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    blocks = max(1, min(max_cells // n_shards, -(-n // (n_shards * rows_per_cell))))
    shards = [n // n_shards + (k < n % n_shards) for k in range(n_shards)]
    cells = [s // blocks + (b < s % blocks) for s in shards for b in range(blocks)]
    parts = max(1, -(-n // (len(cells) * rows_per_cell)))
    matrix = communication_matrix(counts, cells, seed).select(F.col("id").alias(SRC), F.expr(_running("take")).alias("__ends"))
    small = sources * len(cells) * 8 <= common.BROADCAST_BYTES
    luck = F.xxhash64(F.lit(seed + 3), MID)
    part = F.expr(f"pmod(xxhash64({seed + 4}, {MID}), {parts})")
    sent = placed.join(F.broadcast(matrix) if small else matrix, SRC).withColumns({CELL: F.expr(_place("__ends", POS, len(cells))), PART: part}).drop("__ends")
    again = Window.partitionBy(CELL, PART).orderBy(luck, MID)
    shard, block = F.expr(f"{CELL} div {blocks}"), F.expr(f"{CELL} % {blocks}")
    held = F.lit(n // n_shards) + F.when(shard < n % n_shards, 1).otherwise(0)
    before = block * F.floor(held / blocks) + F.least(block, held % blocks)
    if parts > 1:
        ahead = Window.partitionBy(CELL).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
        sizes = sent.groupBy(CELL, PART).agg(F.count(F.lit(1)).alias("n"))
        sizes = stored(sizes.select(CELL, PART, F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("__ahead")), "part-sizes")
        sent, before = common.lookup(sent, sizes, [CELL, PART], "inner", 64), before + F.col("__ahead")
    return sent.withColumn("slot", (before + F.row_number().over(again) - 1).cast("long")).withColumn("shard", shard.cast("int")).select(*[f"`{c}`" for c in names], "shard", "slot")


def write_shards(sharded: DataFrame, path: str, rows_per_file: int = 1_000_000) -> None:
    """The shards as Parquet, a folder each, in files of consecutive slots."""
    part = F.expr(f"slot div {rows_per_file}")
    sharded.repartition("shard", part).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
