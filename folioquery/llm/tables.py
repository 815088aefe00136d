"""Small helpers: reading columns safely, written intermediates."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioquery.session import new_scratch_path


_SCOPE: ContextVar[list[DataFrame] | None] = ContextVar("scope", default=None)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_bytes(column: str) -> Column:
    """UTF-8 bytes of a text column; null is empty."""
    return F.coalesce(F.col(column).cast("binary"), F.lit(b""))


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows written to the shared scratch folder and read again: cuts the lineage,
    so a lost executor costs a read, and later uses do not compute the rows anew."""
    spark = df.sparkSession
    path = new_scratch_path(spark, name)
    df.write.parquet(path)
    written = spark.read.schema(df.schema).parquet(path)
    if (held := _SCOPE.get()) is not None:
        held.append(written)
    return written


@contextmanager
def scope() -> Iterator[list[DataFrame]]:
    """Lists what is ``stored`` inside, so that it can be discarded once its result is written."""
    held: list[DataFrame] = []
    token = _SCOPE.set(held)
    try:
        yield held
    finally:
        _SCOPE.reset(token)


def discard(table: DataFrame) -> None:
    """Remove a written table. Only for tables from which nothing unwritten still reads:
    a lost executor may else ask for them again."""
    spark = table.sparkSession
    for folder in {path.rsplit("/", 1)[0] for path in table.inputFiles()}:
        at = spark._jvm.org.apache.hadoop.fs.Path(folder)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def marked_rows(rows: DataFrame, marked: DataFrame, key: str) -> DataFrame:
    """The ``rows`` whose key is among ``marked``, without moving them.

    Keys come from ``monotonically_increasing_id``, so they lie close together and go
    into bitmaps: about a bit a row is sent to the tasks.
    """
    place = F.col(key) + 1
    bitmaps = marked.groupBy(F.bitmap_bucket_number(place).alias("_bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("_marks")
    )
    at = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.substring("_marks", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    bit = F.floor(byte / F.pow(F.lit(2.0), at % 8)).cast("int") % 2
    joined = rows.withColumn("_bucket", F.bitmap_bucket_number(place)).join(F.broadcast(bitmaps), "_bucket")
    return joined.filter(bit == 1).drop("_bucket", "_marks")
