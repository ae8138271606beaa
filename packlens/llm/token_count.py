"""Token counts by a digest cache: equal contents are encoded once, ever, for a version of a tokenizer.

Each row's content (a null text is an empty one; ``normalise`` may be given where it provably leaves counts as they are) is
digested with SHA-256. Digests are joined to the stored counts of this tokenizer file's digest; distinct misses alone
are encoded, by the library's own rules and without special tokens, and appended to the cache. Copies meet in partial
aggregates before the shuffle, so a content that a third of all rows have is no heavy group.

The cache is a Parquet folder (digest, n_tokens) with a partition for each tokenizer. Of it only this tokenizer's partition is read, and
only counts of digests at hand go further. A write that fails half-way adds nothing; two writers may
add the same content, which counts once. New counts are written once, into the cache, and a result reads them there when it is
evaluated. Few files are added, however many tasks count: to write a file in a local folder, Hadoop without its native library starts two
processes (chmod), and until each is under way it holds the whole executor's memory a second time.

Defined results: rows that repeat are counted alike, an empty table gives an empty table, further columns pass through
(names starting with ``_t_`` are reserved; columns named n_bytes, n_tokens or over_limit are replaced).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cleaned, in_parts, whole_text
from .tokens import encoder, file_digest

CACHE = "digest binary, n_tokens bigint, tokenizer string"
#: Rows at hand for each file that is added to the cache; up to FILES times as many rows give FILES files at most.
FILE_ROWS, FILES = 1_000_000, 8


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def _counter(tokenizer: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(tokenizer)
        for batch in in_parts(batches):
            counts = [len(ids) // 4 for ids in code.batches(batch.column("_t_text").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("_t_digest"), pa.array(counts, pa.int64())], ["digest", "n_tokens"]
            )

    return run


def _same(text: Column) -> Column:
    return text


def _digest(content: Column) -> Column:
    return F.unhex(F.sha2(F.encode(content, "utf-8"), 256))


def _stored(asked: DataFrame, version: str, cache: str) -> DataFrame:
    """The counts that the cache now has of the digests asked for, each once."""
    stored = asked.sparkSession.read.schema(CACHE).parquet(cache).where(F.col("tokenizer") == version)
    return stored.join(asked.distinct(), "digest", "left_semi").groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def remember(docs: DataFrame, tokenizer: str, cache: str, normalise: Callable[[Column], Column] = _same) -> None:
    """Encodes the contents of ``docs`` that the cache doesn't have, and adds their counts to it."""
    spark, version, content = docs.sparkSession, file_digest(tokenizer), normalise(whole_text())
    misses = docs.select(_digest(content).alias("digest"), content.alias("_t_text"))
    if _exists(spark, cache):
        misses = misses.join(_stored(misses.select("digest"), version, cache), "digest", "left_anti")
    distinct = misses.groupBy(F.col("digest").alias("_t_digest")).agg(F.first("_t_text").alias("_t_text"))
    new = distinct.mapInArrow(_counter(tokenizer), "digest binary, n_tokens bigint")
    files = max(FILES, -(-docs.count() // FILE_ROWS))
    with cleaned(spark):
        new.repartition(files).withColumn("tokenizer", F.lit(version)).write.mode("append").partitionBy("tokenizer").parquet(cache)


def look_up(
    docs: DataFrame, tokenizer: str, cache: str, limit: int = 2048, normalise: Callable[[Column], Column] = _same
) -> DataFrame:
    """Adds n_bytes, n_tokens (long) and over_limit to the rows of ``docs``, from the cache alone: contents must be remembered."""
    digest = _digest(normalise(whole_text()))
    counts = _stored(docs.select(digest.alias("digest")), file_digest(tokenizer), cache)
    return (
        docs.withColumns({"n_bytes": F.octet_length(whole_text()).cast("long"), "_t_digest": digest})
        .join(counts.select(F.col("digest").alias("_t_digest"), F.col("n_tokens").alias("_t_n")), "_t_digest", "left")
        .withColumn("n_tokens", F.col("_t_n"))
        .drop("_t_digest", "_t_n")
        .withColumn("over_limit", F.col("n_tokens") > limit)
    )


def count_tokens(
    docs: DataFrame, tokenizer: str, cache: str, limit: int = 2048, normalise: Callable[[Column], Column] = _same
) -> DataFrame:
    """Adds n_bytes, n_tokens (long) and over_limit to the rows of ``docs``; new contents are added to the cache first."""
    remember(docs, tokenizer, cache, normalise)
    return look_up(docs, tokenizer, cache, limit, normalise)
