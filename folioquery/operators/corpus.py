"""The chunk relation: its schema and how any table becomes one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHUNK_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("doc", T.StringType()),
        T.StructField("doc_title", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("section", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("unit_parts", T.IntegerType()),
        T.StructField("chapter", T.IntegerType()),
        T.StructField("pdf_page", T.IntegerType()),
        T.StructField("pdf_page_end", T.IntegerType()),
        T.StructField("image", T.StringType()),
        T.StructField("engines", T.ArrayType(T.StringType())),
        # Pages of the part itself; ``pdf_page`` to ``pdf_page_end`` is the whole unit.
        T.StructField("part_page", T.IntegerType()),
        T.StructField("part_page_end", T.IntegerType()),
    ]
)


def as_chunks(df: DataFrame) -> DataFrame:
    """``df`` in the chunk schema: sparse fields that are absent become null."""
    present = set(df.columns)
    return df.select(
        *[
            (F.col(f.name) if f.name in present else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in CHUNK_SCHEMA.fields
        ]
    )
