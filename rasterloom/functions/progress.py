"""Progress and log messages as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Stages with their share of the whole in percent (fixed values).
STAGES = {"prepare": (0.0, 20.0), "chunk_plan": (20.0, 35.0), "queue": (35.0, 50.0), "inference": (50.0, 80.0), "latent": (80.0, 90.0), "smooth": (90.0, 97.0), "render": (97.0, 100.0)}
#: Log lines that are kept (fixed value).
LOG_LINES = 50


def percent(message: str = "message") -> Column:
    """The first "n %", else the share of "step i/n", in whole percent from 0 to 100; null if a message has neither."""
    told = F.regexp_extract(message, r"(\d{1,3})\s*%", 1)
    at, of = F.regexp_extract(message, r"(?i)step\s+(\d+)\s*/\s*(\d+)", 1), F.regexp_extract(message, r"(?i)step\s+(\d+)\s*/\s*(\d+)", 2)
    ratio = F.least(F.lit(1.0), F.try_divide(at.try_cast("double"), of.try_cast("double")))
    return F.when(told != "", F.least(told.try_cast("int"), F.lit(100))).when((of != "") & (of.try_cast("double") > 0), F.bround(ratio * 100).cast("int"))


def stage(message: str = "message") -> Column:
    """The stage that a message's words tell; null for one without a percentage."""
    low = F.lower(message)
    has = lambda *words: F.expr(" OR ".join(f"contains(lower({message}), '{w}')" for w in words))
    told = F.when(has("latent", "knn"), "latent").when(has("smooth", "blur"), "smooth").when(has("render"), "render").when(has("prepare"), "prepare").when(has("chunk") & has("plan"), "chunk_plan").when(has("queue"), "queue").otherwise("inference")
    return F.when(low.isNotNull() & percent(message).isNotNull(), told)


def overall(stage_col: Column, percent_col: Column) -> Column:
    """A stage's percentage as one of the whole; null for an unknown stage."""
    value = None
    for name, (a, b) in STAGES.items():
        part = F.lit(a) + (b - a) * F.greatest(F.lit(0.0), F.least(F.lit(100.0), percent_col.cast("double"))) / 100.0
        value = F.when(stage_col == name, part) if value is None else value.when(stage_col == name, part)
    return value


def timeline(log: DataFrame, run: str = "run", seq: str = "seq", message: str = "message") -> DataFrame:
    """Adds stage, percent and overall progress, which never falls within a run."""
    parsed = log.withColumns({"stage": stage(message), "percent": percent(message)})
    so_far = Window.partitionBy(run).orderBy(seq).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return parsed.withColumn("overall", F.max(overall(F.col("stage"), F.col("percent"))).over(so_far))


def shown(category: str = "category", message: str = "message") -> Column:
    """General messages always, a worker's only with a count like 3/7."""
    return F.coalesce((F.col(category) == "general") | ((F.col(category) == "worker") & F.col(message).rlike(r"\b\d+\s*/\s*\d+\b")), F.lit(False))


def log_tail(log: DataFrame, lines: int = LOG_LINES) -> DataFrame:
    """The newest shown lines, newest first: a distributed top-k."""
    return log.where(shown()).orderBy(F.desc("seq")).limit(lines)
