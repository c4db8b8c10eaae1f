"""Exact token counts: one histogram of encoded lengths, whose suffix sums answer for every context limit."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import Codec
from .common import add_columns, stored

#: Lengths in a block of the suffix sums: each block is summed by itself, and then the blocks.
BLOCK = 128


def lengths(df: DataFrame, tokenizer: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The ``keep`` columns (all) and ``n_tokens`` of each whole text; a null text has none."""

    def work():
        codec = Codec(tokenizer)

        def each(batch: pa.RecordBatch) -> list[pa.Array]:
            return [pa.array([len(codec.encode(t.as_py() or "")) for t in batch.column(batch.schema.get_field_index(text))], pa.int64())]

        return each

    return add_columns(df, [T.StructField("n_tokens", T.LongType())], work, [text], df.columns if keep is None else keep)


def histogram(counted: DataFrame) -> DataFrame:
    """(n_tokens, docs, docs_from, tokens_from, tokens, truncated, quantile) for each encoded length that occurs.

    ``docs_from`` and ``tokens_from`` cover documents of at least that length, ``tokens`` is the total, ``truncated`` the
    total where that length is the context limit, and ``quantile`` the share of documents that it holds whole. Any other
    limit has the truncated total of the lengths around it, which is linear between them: see ``answer``. Null lengths
    are passed over; an empty table has no rows.
    """
    docs = stored(counted.where("n_tokens IS NOT NULL").groupBy("n_tokens").agg(F.count(F.lit(1)).alias("docs")), "lengths")
    rows = docs.withColumns({"block": F.expr(f"n_tokens div {BLOCK}"), "sum": F.col("n_tokens") * F.col("docs")})
    blocks = rows.groupBy("block").agg(F.sum("docs").alias("d"), F.sum("sum").alias("t"))
    later = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    blocks = blocks.select("block", *[F.coalesce(F.sum(c).over(later), F.lit(0)).alias(f"{c}_later") for c in "dt"], *[F.sum(c).over(everything).alias(f"{c}_all") for c in "dt"])
    within = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumns({"df": F.sum("docs").over(within), "tf": F.sum("sum").over(within)}).join(blocks, "block")
    docs_from, tokens_from = F.col("df") + F.col("d_later"), F.col("tf") + F.col("t_later")
    return out.select(
        "n_tokens",
        "docs",
        docs_from.alias("docs_from"),
        tokens_from.alias("tokens_from"),
        F.col("t_all").alias("tokens"),
        (F.col("t_all") - tokens_from + F.col("n_tokens") * docs_from).alias("truncated"),
        ((F.col("d_all") - docs_from + F.col("docs")) / F.col("d_all")).alias("quantile"),
    )


def answer(table: DataFrame, limits: list[int], shares: list[float]) -> dict:
    """Totals under each context limit and the length at each quantile, from a stored histogram."""
    total = table.agg(F.max("tokens").alias("n")).first()["n"] or 0
    from_first = {}
    for limit in limits:
        above = table.where(F.col("n_tokens") >= limit).agg(F.max("docs_from").alias("d"), F.max("tokens_from").alias("t")).first()
        from_first[limit] = total - (above["t"] or 0) + limit * (above["d"] or 0)
    at = {s: table.where(F.col("quantile") >= s).agg(F.min("n_tokens").alias("n")).first()["n"] for s in shares}
    return {"tokens": total, "truncated": from_first, "quantiles": at}


def token_histogram(df: DataFrame, tokenizer: str, text: str = "text") -> DataFrame:
    """The histogram of the encoded lengths of all texts."""
    return histogram(lengths(df.select(F.col(text).alias("text")), tokenizer, keep=[]))
