"""Session helpers: the shared scratch folder and size-checked small relations."""

from __future__ import annotations

import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL_SCRATCH: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for written intermediates.

    Comes from ``spark.checkpoint.dir``. Only a local-mode session without that
    setting gets a temporary folder of its own; on a cluster a missing setting
    is an error, because executors could not read a driver-local folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    app = context.applicationId
    if app not in _LOCAL_SCRATCH:
        _LOCAL_SCRATCH[app] = tempfile.mkdtemp(prefix="folioquery-")
    return _LOCAL_SCRATCH[app]


def new_scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


@dataclass(frozen=True)
class Small:
    """A relation whose rows were counted: at most the bound asked for."""

    df: DataFrame
    rows: list[dict]

    def values(self, column: str) -> list:
        return sorted({row[column] for row in self.rows})


def small_or_none(df: DataFrame, max_rows: int) -> Small | None:
    """The same rows as a local relation if there are at most ``max_rows``.

    Fetches one row more than the bound, so the driver never holds more than
    ``max_rows + 1`` rows. ``None`` means the relation is larger and the caller
    must take its shuffle path; no row is dropped either way.
    """
    table = df.limit(max_rows + 1).toArrow()
    if table.num_rows > max_rows:
        return None
    local = df.sparkSession.createDataFrame(table, df.schema)
    return Small(F.broadcast(local), table.to_pylist())


# Up to this many distinct keys are written into the scan filter as literals.
LITERAL_KEYS = 2000


def lookup(table: DataFrame, keys: DataFrame, on: list[str], max_rows: int) -> DataFrame:
    """Rows of a stored table whose key is asked for, joined with the asking rows.

    ``on`` names the folder column first. If at most ``max_rows`` rows ask, their
    folders (and their keys, if few) become a scan filter that prunes folders and
    row groups, and the asking side is broadcast. Otherwise the two sides meet in
    a shuffle join.
    """
    small = small_or_none(keys, max_rows)
    if small is None:
        return table.join(keys, on)
    if not small.rows:
        wanted = F.lit(False)
    else:
        wanted = F.lit(True)
        for column in on:
            values = small.values(column)
            if len(values) <= LITERAL_KEYS:
                wanted = wanted & F.col(column).isin(values)
    return table.filter(wanted).join(small.df, on)


def join_small(df: DataFrame, dimension: DataFrame, on: str, how: str, max_rows: int = 100_000) -> DataFrame:
    """Join with a dimension such as a source registry: broadcast after its rows were
    counted, so a key that holds much of ``df`` is not shuffled; a shuffle join beyond."""
    small = small_or_none(dimension, max_rows)
    return df.join(dimension if small is None else small.df, on, how)
