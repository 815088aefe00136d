"""Reading and writing corpora and the small files that go with them."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.citation import chunk_citation
from ..operators.corpus import CHUNK_SCHEMA, as_chunks
from ..operators.units import interval_join
from ..session import join_small

SOURCE_SCHEMA = T.StructType(
    [
        T.StructField("doc", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("drive_file_id", T.StringType()),
        T.StructField("indexed", T.BooleanType()),
    ]
)

EVAL_SCHEMA = T.StructType(
    [
        T.StructField("query", T.StringType()),
        T.StructField("expect_any", T.ArrayType(T.StringType())),
        T.StructField("forbid", T.ArrayType(T.StringType())),
        T.StructField("filters", T.VariantType()),
        T.StructField("top_k", T.IntegerType()),
        T.StructField("note", T.StringType()),
    ]
)

SYNONYM_SCHEMA = T.MapType(T.StringType(), T.ArrayType(T.StringType()))

VEHICLE_SCHEMA = T.StructType(
    [
        T.StructField(
            "engines",
            T.MapType(
                T.StringType(),
                T.StructType(
                    [
                        T.StructField("aliases", T.ArrayType(T.StringType())),
                        T.StructField("timing_drive", T.StringType()),
                    ]
                ),
            ),
        ),
        T.StructField(
            "document_engines", T.MapType(T.StringType(), T.ArrayType(T.StringType()))
        ),
        T.StructField(
            "profile",
            T.StructType(
                [
                    T.StructField("platform", T.StringType()),
                    T.StructField("market", T.StringType()),
                    T.StructField("engine", T.StringType()),
                ]
            ),
        ),
    ]
)


def spread(df: DataFrame) -> DataFrame:
    """Redistribute a scan that comes in fewer pieces than the session has cores.

    A large table has far more pieces than cores and passes unchanged.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def spread_by(df: DataFrame, key: str) -> DataFrame:
    """A scan dealt by ``key`` in pieces a quarter of a split, so that what is unfolded from
    its rows can be counted by key without moving again."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(cores, 4 * df.rdd.getNumPartitions()), key)


def read_chunks(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """A corpus: JSON lines at the edge, parquet inside."""
    if fmt == "json":
        return spark.read.schema(CHUNK_SCHEMA).json(path)
    return as_chunks(spark.read.format(fmt).load(path))


def write_chunks(chunks: DataFrame, path: str, fmt: str = "json") -> None:
    """Store a corpus, one folder per document so document filters prune."""
    writer = as_chunks(chunks).write.mode("overwrite")
    if fmt == "json":
        writer.json(path)
    else:
        writer.partitionBy("doc").format(fmt).save(path)


@dataclass(frozen=True)
class Vehicle:
    """The applicability map; a handful of entries, so plain Python values."""

    engines: dict[str, dict] = field(default_factory=dict)
    document_engines: dict[str, list[str]] = field(default_factory=dict)
    profile: dict = field(default_factory=dict)


def read_synonyms(spark: SparkSession, path: str) -> DataFrame:
    """``(phrase, alternatives)`` from a JSON object phrase -> list of phrases."""
    return (
        spark.read.text(path, wholetext=True)
        .select(F.from_json("value", SYNONYM_SCHEMA).alias("entries"))
        .select(F.explode("entries").alias("phrase", "alternatives"))
    )


def synonym_table(spark: SparkSession, synonyms: dict[str, list[str]]) -> DataFrame:
    return spark.createDataFrame(
        list(synonyms.items()), "phrase string, alternatives array<string>"
    )


def read_vehicle(spark: SparkSession, path: str) -> Vehicle:
    row = (
        spark.read.text(path, wholetext=True)
        .select(F.from_json("value", VEHICLE_SCHEMA).alias("v"))
        .select("v.*")
        .first()
        .asDict(recursive=True)
    )
    return Vehicle(row["engines"] or {}, row["document_engines"] or {}, row["profile"] or {})


def read_sources(spark: SparkSession, path: str) -> DataFrame:
    """The registry: a JSON array of sources."""
    return spark.read.schema(SOURCE_SCHEMA).json(path, multiLine=True)


def indexable(pages: DataFrame, sources: DataFrame) -> DataFrame:
    """Pages of registered, indexed sources that have a text layer."""
    wanted = sources.filter("indexed").select("doc")
    return join_small(pages, wanted, "doc", "left_semi").filter(F.length(F.trim("text")) > 0)


def list_sources(chunks: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """Documents with their numbers of units and chunks.

    Units of a document are counted after a per-unit step, so a document with
    most of the rows is still counted by many tasks.
    """
    unit = F.substring_index("id", ":", 2)
    counted = (
        chunks.groupBy("doc", "lang", unit.alias("unit"))
        .agg(F.count("*").alias("n"))
        .groupBy("doc", "lang")
        .agg(F.count("*").alias("units"), F.sum("n").alias("chunks"))
    )
    if sources is None:
        return counted
    return sources.select("doc", "title", "indexed").join(counted, "doc", "left")


def corpus_stats(chunks: DataFrame) -> DataFrame:
    """Build summary per document, by the same two steps as ``list_sources``."""
    unit = F.substring_index("id", ":", 2)
    size = F.length("text")
    return (
        chunks.groupBy("doc", unit.alias("unit"))
        .agg(
            F.count("*").alias("n"),
            F.sum(size).alias("chars"),
            F.min(size).alias("lo"),
            F.max(size).alias("hi"),
            F.max("pdf_page").alias("page"),
        )
        .groupBy("doc")
        .agg(
            F.count("*").alias("units"),
            F.sum("n").alias("chunks"),
            F.sum("chars").alias("chars"),
            F.min("lo").alias("min_chars"),
            F.max("hi").alias("max_chars"),
            F.max("page").alias("max_page"),
        )
    )


def read_eval_cases(spark: SparkSession, path: str) -> DataFrame:
    """Labelled queries, one JSON object per line, blank lines skipped. ``filters`` is kept
    as a variant: a value may be a scalar or a list, under any key."""
    return (
        spark.read.text(path)
        .filter(F.trim("value") != "")
        .select(F.from_json("value", EVAL_SCHEMA).alias("c"))
        .select("c.*")
        .withColumn("top_k", F.coalesce("top_k", F.lit(5)))
    )


def image_paths(chunks: DataFrame, files: DataFrame) -> DataFrame:
    """Chunks with the path of their illustration; null when the file is missing.

    ``files(image, path)`` lists the shipped pictures. Most chunks have no picture;
    they bypass the join, where their null keys would all meet in one task.
    """
    pictured = chunks.filter(F.col("image").isNotNull()).join(files, "image", "left")
    plain = chunks.filter(F.col("image").isNull()).withColumn("path", F.lit(None).cast("string"))
    return pictured.unionByName(plain)


def list_files(spark: SparkSession, path: str, pattern: str = "*.jpg") -> DataFrame:
    """``(image, path)`` of files below a folder, contents not read."""
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", "true")
        .load(path)
        .select(F.substring_index("path", "/", -1).alias("image"), "path")
    )


def page_files(files: DataFrame) -> DataFrame:
    """``(doc, page, path)`` of rendered pages among files: ``.../<document>/<page>.jpg``."""
    number = F.regexp_extract("path", r"/(\d+)\.[^./]+$", 1)
    return files.filter(number != "").select(
        F.split_part("path", F.lit("/"), F.lit(-2)).alias("doc"), number.cast("bigint").alias("page"), "path"
    )


def page_pictures(chunks: DataFrame, pictures: DataFrame, width: int = 64) -> DataFrame:
    """``(id, pictures)``: rendered pages within each chunk's page range.

    The range is that of the part where it is known, else that of its unit, so
    pictures of a long unit stand with the part they belong to. ``pictures(doc,
    page, path)``. Ranges and pages meet per document and page bucket; the list of
    one chunk is bounded by its page range.
    """
    own = [c for c in ("part_page", "part_page_end") if c in chunks.columns]
    first = F.coalesce(*own[:1], "pdf_page")
    last = F.coalesce(*own[1:], *own[:1], "pdf_page_end", "pdf_page")
    ranges = chunks.select(
        "id", "doc", first.alias("_from"), (last + 1).alias("_after")
    ).filter(F.col("_from").isNotNull())
    return (
        interval_join(pictures, ranges, "doc", "page", "_from", "_after", width)
        .groupBy("id")
        .agg(F.sort_array(F.collect_list(F.struct("page", "path"))).alias("_p"))
        .select("id", F.col("_p.path").alias("pictures"))
    )


def select_picture_pages(
    pages: DataFrame, excluded_topics: Column, has_picture: Column
) -> DataFrame:
    """Pages worth rendering: a picture on them, and no excluded topic."""
    return pages.filter(has_picture & ~F.coalesce(excluded_topics, F.lit(False)))


def cited(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("citation", chunk_citation())
