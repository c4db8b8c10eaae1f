"""What the operators share: the cluster's shared folder, Arrow batches and joins against tables of checked size."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: An Arrow batch is worked off in pieces of about so many bytes, which bounds what a worker holds besides it.
PIECE_BYTES = 8 << 20
#: A table is broadcast up to this many bytes; a larger one is joined by a shuffle.
BROADCAST_BYTES = 32 << 20


def _qualified(spark: SparkSession, path: str):
    """(file system, path with its scheme) of a path as Spark reads it."""
    context = spark.sparkContext
    place = context._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(context._jsc.hadoopConfiguration())
    return system, system.makeQualified(place)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where it is unset (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.sparkContext.setCheckpointDir(folder)
    return _qualified(spark, folder)[1].toString()


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder in the shared one; it is deleted when the application ends."""
    system, place = _qualified(spark, f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}")
    system.deleteOnExit(place)
    return place.toString()


def make_folder(spark: SparkSession, path: str) -> str:
    """The folder, made where its store has folders."""
    system, place = _qualified(spark, path)
    system.mkdirs(place)
    return place.toString()


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: lineage ends here, and a lost executor loses nothing."""
    path = new_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._stored_at = path
    return back


def discard(df: DataFrame) -> None:
    """Delete a stored table that no plan still to be run reads."""
    system, place = _qualified(df.sparkSession, df._stored_at)
    system.delete(place, True)


def without(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """``df`` less the columns whose names clash, in any case, with ``names``."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of batches in runs of about PIECE_BYTES."""
    for batch in batches:
        step = max(1, batch.num_rows * PIECE_BYTES // max(1, batch.nbytes))
        for at in range(0, max(1, batch.num_rows), step):
            yield batch.slice(at, step)


def add_columns(
    df: DataFrame,
    fields: list[T.StructField],
    work: Callable[[], Callable[[pa.RecordBatch], list]],
    needs: list[str],
    keep: list[str],
) -> DataFrame:
    """The ``keep`` columns and, computed by piece of an Arrow batch, the ``fields``. ``work()`` runs once a task.

    Kept columns with a new field's name (in any case) give way to it. Batches are bounded in bytes by
    spark.sql.execution.arrow.maxBytesPerBatch, pieces by PIECE_BYTES (a longer row is a piece by itself).
    """
    new = {f.name.lower() for f in fields}
    keep = [c for c in keep if c.lower() not in new]
    read = list(dict.fromkeys([*keep, *needs]))
    schema = T.StructType([*[df.schema[c] for c in keep], *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = work()
        names = [*keep, *[f.name for f in fields]]
        for batch in pieces(batches):
            made = each(batch)
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)) for c in keep], *made], names=names)

    return df.select(*[F.col(f"`{c}`") for c in read]).mapInArrow(run, schema)


def is_small(df: DataFrame, row_bytes: int | Column) -> bool:
    """Whether the rows of a stored table, at ``row_bytes`` each as a hash table has them, come to at most BROADCAST_BYTES.

    A column gives the bytes row by row, where rows differ in size.
    """
    if isinstance(row_bytes, Column):
        return (df.agg(F.sum(row_bytes)).first()[0] or 0) <= BROADCAST_BYTES
    most = BROADCAST_BYTES // row_bytes
    return df.limit(most + 1).count() <= most


def lookup(big: DataFrame, table: DataFrame, on: list[str], how: str, row_bytes: int | Column) -> DataFrame:
    """Join with a stored table: broadcast where its counted size allows, else by a shuffle whose skew AQE splits."""
    return big.join(F.broadcast(table) if is_small(table, row_bytes) else table, on, how)
