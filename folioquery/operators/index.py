"""The inverted index as tables.

``postings`` carries everything ranking and filtering need (term counts, body
positions, length, document, language, chapter, engines), so a search reads the
rows of its own terms and joins nothing wide. A chunk is one row, so its term
counts come from its own token array: building postings never shuffles. The
stored table is laid out by term bucket and sorted by term, so a term filter
prunes folders and row groups. Within a term, chunks stand by block (similar length, then
a hash of the id); ``block_bounds`` says how well a chunk of each block can score.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lets import explode_once, let
from ..functions.lines import has_torque
from ..functions.text import (
    is_compound, stem, stem_word, surface_tokens, token_forms, tokenize, trigrams,
)
from .corpus import as_chunks

TERM_BUCKETS = 64
FILTER_COLUMNS = ["doc", "lang", "chapter", "engines"]
# Chunks wanted in a block, about; term counts up to BOUND_COUNTS - 1 get a bound of their own.
BLOCK_CHUNKS, BOUND_COUNTS = 32, 8


def occurrences(text: Column, in_title: bool) -> Column:
    """Index terms of a text with their word position; -1 marks the title.

    Every word gives one entry; the parts of compounds, rare in most texts, are
    added at the position of their word.
    """

    def entry(term: Column, i: Column) -> Column:
        position = F.lit(-1) if in_title else i
        return F.struct(stem_word(term).alias("term"), position.cast("int").alias("pos"))

    def parts(word: Column, i: Column) -> Column:
        return F.transform(
            F.when(is_compound(word), F.split(word, "-")).otherwise(
                F.array().cast("array<string>")
            ),
            lambda p: entry(p, i),
        )

    def listed(words: Column) -> Column:
        whole = F.transform(words, entry)
        return F.when(
            F.exists(words, is_compound), F.concat(whole, F.flatten(F.transform(words, parts)))
        ).otherwise(whole)

    return let(surface_tokens(F.coalesce(text, F.lit(""))), listed)


def _runs(found: Column) -> Column:
    """Group an array of occurrences by term: sort once, then cut into runs."""

    def cut(terms: Column, places: Column) -> Column:
        size = F.size(terms)
        starts = F.filter(
            F.sequence(F.lit(0), size - 1),
            lambda i: (i == 0) | (F.get(terms, i) != F.get(terms, i - 1)),
        )

        def entry(start: Column, end: Column) -> Column:
            # Reads single elements: slicing would copy the whole array per term.
            tf = end - start
            own = F.transform(F.sequence(start, end - 1), lambda i: F.get(places, i))
            return let(
                F.filter(own, lambda p: p >= 0),
                lambda body: F.struct(
                    F.get(terms, start).alias("term"),
                    tf.alias("tf"),
                    (tf - F.size(body)).alias("title_tf"),
                    body.alias("positions"),
                ),
            )

        return let(
            starts,
            lambda s: F.transform(
                s, lambda start, i: entry(start, F.coalesce(F.get(s, i + 1), size))
            ),
        )

    return let(
        F.sort_array(found),
        lambda rows: F.when(
            F.size(rows) > 0,
            let(rows["term"], lambda terms: let(rows["pos"], lambda pos: cut(terms, pos))),
        ),
    )


def term_bucket(term: Column, buckets: int = TERM_BUCKETS) -> Column:
    return F.pmod(F.hash(term), F.lit(buckets))


def id_bucket(chunk_id: Column, buckets: int = TERM_BUCKETS) -> Column:
    return F.pmod(F.hash(chunk_id), F.lit(buckets))


def suggested_blocks(n_chunks: int) -> int:
    """Hash classes of a block; lengths spread over some sixteen classes besides."""
    return max(1, n_chunks // (16 * BLOCK_CHUNKS))


def chunk_block(chunk_id: Column, chunk_len: Column, blocks: int) -> Column:
    """The block of a chunk: its length to a quarter of a doubling, then a hash class.

    Chunks of like length have like scores, so a block's bound is near what its chunks reach.
    """
    length = F.floor(4 * F.log2(F.greatest(chunk_len, F.lit(1)).cast("double"))).cast("long")
    return length * blocks + F.pmod(F.xxhash64(chunk_id), F.lit(blocks))


def chunk_terms(chunks: DataFrame) -> DataFrame:
    """One row per chunk with its entries array and length (tokens, title included)."""
    found = F.concat(occurrences(F.col("section"), True), occurrences(F.col("text"), False))
    return (
        as_chunks(chunks)
        .select(
            F.col("id").alias("chunk_id"),
            *FILTER_COLUMNS,
            has_torque(F.col("text")).alias("has_torque"),
            _runs(found).alias("entries"),
        )
        .withColumn(
            "chunk_len",
            F.coalesce(
                F.aggregate("entries", F.lit(0), lambda n, e: n + e["tf"]), F.lit(0)
            ),
        )
    )


# Up to this many asked terms, words are first told apart by their first letters.
FEW_TERMS, PREFIX_LETTERS = 100, 5


def _may_be(word: Column, terms: list[str]) -> Column:
    """Whether a word can have one of ``terms`` as its stem. Stems only cut endings off,
    so a word starts with its stem; a compound may hold a term as a part."""
    by_length: dict[int, set[str]] = {}
    for term in terms:
        start = term[:PREFIX_LETTERS]
        by_length.setdefault(len(start), set()).add(start)
    found = F.contains(word, F.lit("-"))
    for length, starts in sorted(by_length.items(), reverse=True):
        found = found | F.left(word, F.lit(length)).isin(sorted(starts))
    return found


def _n_forms(words: Column) -> Column:
    """Number of index forms of a word list: the words, and the parts of compounds."""
    parts = F.aggregate(F.filter(words, is_compound), F.lit(0), lambda n, w: n + F.size(F.split(w, "-")))
    return F.size(words) + F.when(F.exists(words, is_compound), parts).otherwise(F.lit(0))


def _asked_forms(words: Column, terms: list[str]) -> Column:
    """Every occurrence of one of ``terms`` in a word list, without its place."""
    def forms(kept: Column) -> Column:
        split = F.flatten(F.transform(kept, token_forms))
        return F.when(F.exists(kept, is_compound), split).otherwise(kept)

    kept = F.filter(words, lambda w: _may_be(w, terms)) if len(terms) <= FEW_TERMS else words
    return F.filter(F.transform(let(kept, forms), stem_word), lambda t: t.isin(terms))


def _counted(title: Column, body: Column) -> Column:
    """``_runs`` for occurrences without places: term counts alone."""

    def cut(terms: Column) -> Column:
        size = F.size(terms)
        starts = F.filter(
            F.sequence(F.lit(0), size - 1),
            lambda i: (i == 0) | (F.get(terms, i) != F.get(terms, i - 1)),
        )

        def entry(s: Column, start: Column, i: Column) -> Column:
            own = F.when(F.size(title) > 0, F.size(F.filter(title, lambda t: t == F.get(terms, start))))
            return F.struct(
                F.get(terms, start).alias("term"), (F.coalesce(F.get(s, i + 1), size) - start).alias("tf"),
                F.coalesce(own, F.lit(0)).alias("title_tf"),
            )

        return let(starts, lambda s: F.transform(s, lambda start, i: entry(s, start, i)))

    return let(F.sort_array(F.concat(title, body)), lambda terms: F.when(F.size(terms) > 0, cut(terms)))


def asked_chunks(chunks: DataFrame, terms: list[str], positions: bool = True) -> DataFrame:
    """One row per chunk with its whole length and the entries of ``terms`` alone; their
    positions only where they are wanted, since counting words is much cheaper without."""

    def placed(found: Column) -> Column:
        wanted = F.filter(found, lambda o: o["term"].isin(terms))
        return F.struct(F.size(found).alias("chunk_len"), _runs(wanted).alias("entries"))

    def listed(column: str) -> Column:
        return let(
            surface_tokens(F.coalesce(F.col(column), F.lit(""))),
            lambda words: F.struct(_n_forms(words).alias("n"), _asked_forms(words, terms).alias("found")),
        )

    def counted(both: Column) -> Column:
        return F.struct(
            (both["title"]["n"] + both["body"]["n"]).alias("chunk_len"),
            _counted(both["title"]["found"], both["body"]["found"]).alias("entries"),
        )

    if positions:
        found = F.concat(occurrences(F.col("section"), True), occurrences(F.col("text"), False))
        own = let(found, placed)
    else:
        own = let(F.struct(listed("section").alias("title"), listed("text").alias("body")), counted)
    return (
        as_chunks(chunks)
        .select(
            F.col("id").alias("chunk_id"), *FILTER_COLUMNS,
            has_torque(F.col("text")).alias("has_torque"), own.alias("_own"),
        )
        .select("chunk_id", *FILTER_COLUMNS, "has_torque", "_own.chunk_len", "_own.entries")
    )


def chunk_lengths(chunks: DataFrame) -> DataFrame:
    """Tokens per chunk, title included; tokenises only."""
    def count(text: str) -> Column:
        return F.size(tokenize(F.coalesce(F.col(text), F.lit(""))))

    return as_chunks(chunks).select(
        F.col("id").alias("chunk_id"), (count("section") + count("text")).alias("chunk_len")
    )


def build_postings(chunks: DataFrame, buckets: int = TERM_BUCKETS, blocks: int = 1) -> DataFrame:
    """``(term, chunk_id, tf, title_tf, positions, chunk_len, ...)``; map-only."""
    return (
        chunk_terms(chunks)
        .select("chunk_id", *FILTER_COLUMNS, "has_torque", "chunk_len", F.inline_outer("entries"))
        .filter(F.col("term").isNotNull())
        .withColumn("block", chunk_block(F.col("chunk_id"), F.col("chunk_len"), blocks))
        .withColumn("bucket", term_bucket(F.col("term"), buckets))
    )


def block_bounds(postings: DataFrame) -> DataFrame:
    """One row per term and block: the shortest chunk for each small term count and for all
    larger ones together, the largest count, and whether a title or a torque value occurs."""
    shortest = [
        F.min(F.when(F.col("tf") == n, F.col("chunk_len"))).alias(f"len_{n}") for n in range(1, BOUND_COUNTS)
    ]
    return postings.groupBy("bucket", "term", "block").agg(
        *shortest,
        F.min(F.when(F.col("tf") >= BOUND_COUNTS, F.col("chunk_len"))).alias("len_many"),
        F.max("tf").alias("most"),
        F.max(F.col("title_tf") > 0).alias("has_title"),
        F.max("has_torque").alias("has_torque"),
    )


def document_frequency(postings: DataFrame) -> DataFrame:
    """Chunks per term. Postings hold a chunk once per term, so a count is enough;
    it combines map-side and a term found in every chunk stays one row per task."""
    return postings.groupBy("bucket", "term").agg(F.count("*").alias("df"))


def term_documents(chunks: DataFrame) -> DataFrame:
    """``(term, df)``: chunks per term without building postings, which need every word's
    place. A chunk's different words are stemmed and counted once each."""
    words = F.concat(*[tokenize(F.coalesce(F.col(c), F.lit(""))) for c in ("section", "text")])
    terms = F.array_distinct(F.transform(F.array_distinct(words), stem_word))
    return explode_once(as_chunks(chunks), terms, "term").groupBy("term").agg(F.count("*").alias("df"))


def corpus_statistics(lengths: DataFrame) -> DataFrame:
    """One row: number of chunks and of tokens."""
    return lengths.agg(
        F.count("*").alias("n_chunks"), F.coalesce(F.sum("chunk_len"), F.lit(0)).alias("n_tokens")
    )


def surface_forms(chunks: DataFrame) -> DataFrame:
    """Distinct words as written (lower case), for the repair of unknown words."""
    text = F.concat_ws("\n", "section", "text")
    return explode_once(
        as_chunks(chunks), F.array_distinct(tokenize(text)), "surface"
    ).distinct()


def trigram_index(surfaces: DataFrame, buckets: int = TERM_BUCKETS, whole: bool = False) -> DataFrame:
    """``(gram, surface, n_grams)`` for every distinct surface form; with ``all_grams``, all
    of the form's trigrams, if ``whole``."""
    kept = [F.col("_grams").alias("all_grams")] if whole else []
    return (
        explode_once(
            surfaces.withColumn("_grams", trigrams(F.col("surface"))),
            F.col("_grams"), "gram", "surface", F.size("_grams").alias("n_grams"), *kept,
        )
        .withColumn("bucket", term_bucket(F.col("gram"), buckets))
    )


def gram_frequency(grams: DataFrame) -> DataFrame:
    """Number of surface forms that have each trigram."""
    return grams.groupBy("bucket", "gram").agg(F.count("*").alias("n"))


@dataclass(frozen=True)
class CorpusIndex:
    """The index tables plus the two corpus totals (one row, read once)."""

    chunks: DataFrame
    postings: DataFrame
    terms: DataFrame
    grams: DataFrame
    gram_counts: DataFrame
    n_chunks: int
    n_tokens: int
    buckets: int = TERM_BUCKETS
    bounds: DataFrame | None = None
    # Rows of ``asked_chunks`` with their block, if the index holds some terms alone, and
    # the bounds with all terms of a block in one row.
    asked: DataFrame | None = None
    asked_bounds: DataFrame | None = None

    @property
    def spark(self) -> SparkSession:
        return self.chunks.sparkSession

    @property
    def avg_len(self) -> float:
        return self.n_tokens / self.n_chunks if self.n_chunks else 0.0


def suggested_buckets(scan: DataFrame) -> int:
    """Buckets for an index over a table scan, from its number of input splits.

    Eight at least; at 128 MB a split, a bucket then stands for a gigabyte of text.
    """
    return min(4096, max(8, scan.rdd.getNumPartitions() // 8))


def write_index(chunks: DataFrame, path: str, buckets: int = TERM_BUCKETS, blocks: int | None = None) -> None:
    """Build and store every index table under ``path``.

    Texts are tokenised once for the postings; term counts and totals read the
    written tables. ``rebalance`` lets adaptive execution split a bucket that a
    very frequent term makes large and merge small ones. Choose ``buckets`` so
    that one bucket of postings is a few files: 64 suits gigabytes, thousands
    suit a hundred terabytes.
    """
    spark = chunks.sparkSession
    rows = as_chunks(chunks)

    def store(df: DataFrame, name: str, folder: str | None, *order: str) -> None:
        laid_out = df.hint("rebalance", buckets, folder) if folder else df
        writer = laid_out.sortWithinPartitions(*order).write.mode("overwrite")
        (writer.partitionBy(folder) if folder else writer).parquet(f"{path}/{name}")

    store(
        rows.withColumn("id_bucket", id_bucket(F.col("id"), buckets)),
        "chunks", "id_bucket", "id_bucket", "id",
    )
    if blocks is None:
        blocks = suggested_blocks(spark.read.parquet(f"{path}/chunks").count())  # from file footers
    store(build_postings(rows, buckets, blocks), "postings", "bucket", "bucket", "term", "block", "chunk_id")
    postings = spark.read.parquet(f"{path}/postings")
    store(block_bounds(postings), "bounds", "bucket", "bucket", "term", "block")
    store(document_frequency(postings), "terms", "bucket", "bucket", "term")
    store(
        trigram_index(surface_forms(rows), buckets), "grams", "bucket", "bucket", "gram", "n_grams"
    )
    store(
        gram_frequency(spark.read.parquet(f"{path}/grams")), "gram_counts", None, "bucket", "gram"
    )
    totals = postings.agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("n_tokens"))
    (
        spark.read.parquet(f"{path}/chunks").agg(F.count("*").alias("n_chunks"))
        .select("n_chunks", totals.scalar().alias("n_tokens"), F.lit(buckets).alias("buckets"))
        .write.mode("overwrite").parquet(f"{path}/totals")
    )


def open_index(spark: SparkSession, path: str) -> CorpusIndex:
    """An index written before. Its totals are one row and become plan constants."""
    totals = spark.read.parquet(f"{path}/totals").first()
    return CorpusIndex(
        chunks=spark.read.parquet(f"{path}/chunks"),
        postings=spark.read.parquet(f"{path}/postings"),
        terms=spark.read.parquet(f"{path}/terms"),
        grams=spark.read.parquet(f"{path}/grams"),
        gram_counts=spark.read.parquet(f"{path}/gram_counts"),
        n_chunks=totals["n_chunks"],
        n_tokens=totals["n_tokens"],
        buckets=totals["buckets"],
        bounds=spark.read.parquet(f"{path}/bounds"),
    )


# Matches that one task scores, about, and words whose trigrams it compares.
TASK_MATCHES = 400_000
TASK_WORDS = 100_000


def by_block(asked: DataFrame, matches: int, positions: bool = True, terms: list[str] | None = None) -> DataFrame:
    """Postings of ``asked`` chunks, all of a block in one partition; of ``terms`` alone,
    if they are given and few.

    Chunks travel as one row each, before their entries are unfolded; whatever is grouped
    by block and more afterwards needs no further shuffle. Partitions follow the number
    of ``matches`` to come, so that a task's groups stay few on any corpus. The bounds of
    an index for known questions, a row a block, are dealt and unfolded alike.
    """
    if terms is not None and len(terms) <= FEW_TERMS:
        asked = asked.withColumn("entries", F.filter("entries", lambda e: e["term"].isin(terms)))
    rows = asked.filter(F.size("entries") > 0)
    if not positions and "positions" in rows.schema["entries"].dataType.elementType.names:
        rows = rows.withColumn("entries", F.transform("entries", lambda e: e.dropFields("positions")))
    tasks = max(asked.sparkSession.sparkContext.defaultParallelism, matches // TASK_MATCHES)
    others = [c for c in rows.columns if c != "entries"]
    return rows.repartition(tasks, "block").select(*others, F.inline("entries"))


def write_index_for(
    chunks: DataFrame, terms: list[str], path: str, buckets: int = TERM_BUCKETS, bounds: bool = False,
    positions: bool = True,
) -> CorpusIndex:
    """An index that holds the postings of ``terms`` alone, for questions known beforehand.

    Every chunk is read and tokenised once and its length counted whole, so counts, totals
    and scores are those of the full index; only postings nobody asks for are not stored,
    texts are not copied, and nothing is shuffled but rows of term counts. The vocabulary
    for typo repair is not part of it. Without ``positions`` it serves no proximity bonus.
    """
    spark = chunks.sparkSession
    asked_chunks(chunks, terms, positions).write.parquet(f"{path}/asked")
    asked = spark.read.parquet(f"{path}/asked")
    totals = asked.agg(
        F.count("*").alias("n_chunks"), F.coalesce(F.sum("chunk_len"), F.lit(0)).alias("n_tokens"),
        F.coalesce(F.sum(F.greatest(F.size("entries"), F.lit(0))), F.lit(0)).alias("n_postings"),
    ).first()
    blocks = suggested_blocks(totals["n_chunks"])
    asked = asked.withColumn("block", chunk_block(F.col("chunk_id"), F.col("chunk_len"), blocks))
    others = [c for c in asked.columns if c != "entries"]
    bucket = term_bucket(F.col("term"), buckets)
    postings = asked.select(*others, F.inline("entries")).withColumn("bucket", bucket)
    document_frequency(postings).write.parquet(f"{path}/terms")
    if bounds:
        rows = block_bounds(by_block(asked, totals["n_postings"], positions=False).withColumn("bucket", bucket))
        entries = F.collect_list(F.struct(*[c for c in rows.columns if c != "block"])).alias("entries")
        rows.groupBy("block").agg(entries).write.parquet(f"{path}/bounds")
    packed = spark.read.parquet(f"{path}/bounds") if bounds else None
    none = spark.createDataFrame([], "bucket int, gram string, surface string, n_grams int, n long")
    return CorpusIndex(
        chunks=as_chunks(chunks).withColumn("id_bucket", id_bucket(F.col("id"), buckets)),
        postings=postings,
        terms=spark.read.parquet(f"{path}/terms"),
        grams=none.drop("n"),
        gram_counts=none.select("bucket", "gram", "n"),
        n_chunks=totals["n_chunks"],
        n_tokens=totals["n_tokens"],
        buckets=buckets,
        bounds=packed.select("block", F.inline("entries")) if bounds else None,
        asked=asked,
        asked_bounds=packed,
    )


def write_vocabulary(chunks: DataFrame, path: str, buckets: int = TERM_BUCKETS) -> CorpusIndex:
    """Words and trigrams of a corpus for typo repair, without postings or texts.

    Distinct words are stored; trigrams are unfolded when they are looked up, each with all
    of its word's, so that candidates are judged where they are found. Tasks follow the
    number of words.
    """
    spark = chunks.sparkSession
    surface_forms(chunks).write.parquet(f"{path}/surfaces")
    surfaces = spark.read.parquet(f"{path}/surfaces")
    tasks = max(spark.sparkContext.defaultParallelism, surfaces.count() // TASK_WORDS)  # from file footers
    grams = trigram_index(surfaces.repartition(tasks, "surface"), buckets, whole=True)
    terms = surfaces.select(stem(F.col("surface")).alias("term")).withColumn("bucket", term_bucket(F.col("term"), buckets))
    return CorpusIndex(
        chunks=as_chunks(chunks), postings=terms, terms=terms, grams=grams,
        gram_counts=gram_frequency(trigram_index(surfaces, buckets)), n_chunks=0, n_tokens=0, buckets=buckets,
    )


def index_in_memory(chunks: DataFrame) -> CorpusIndex:
    """An index over a small corpus without storing it; tables stay lazy plans."""
    rows = as_chunks(chunks)
    totals = corpus_statistics(chunk_lengths(rows)).first()
    postings = build_postings(rows, blocks=suggested_blocks(totals["n_chunks"]))
    grams = trigram_index(surface_forms(rows))
    return CorpusIndex(
        chunks=rows.withColumn("id_bucket", id_bucket(F.col("id"))),
        postings=postings,
        terms=document_frequency(postings),
        grams=grams,
        gram_counts=gram_frequency(grams),
        n_chunks=totals["n_chunks"],
        n_tokens=totals["n_tokens"],
        bounds=block_bounds(postings),
    )
