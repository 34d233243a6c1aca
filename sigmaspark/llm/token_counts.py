"""Token counts through a digest cache.

Every text is known by the SHA-256 of its content, every tokenizer by the SHA-256 of
its file and the library's version. Counts already stored under both digests are
joined; only distinct texts that miss are encoded, and their counts are appended.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, table
from .encoders import chunk_counter

CACHE_SCHEMA = "tokenizer string, digest binary, n_tokens bigint"


def tokenizer_digest(path: str) -> str:
    """Digest of the tokenizer: its file's bytes and the version of the library that reads it."""
    if path.endswith(".model"):
        import sentencepiece as library
    else:
        import tokenizers as library
    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + library.__version__.encode()).hexdigest()


def read_cache(spark: SparkSession, cache_path: str, tokenizer: str) -> DataFrame:
    """Stored counts of one tokenizer version; empty where nothing is stored yet."""
    where = spark._jvm.org.apache.hadoop.fs.Path(cache_path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], "digest binary, n_tokens bigint")
    stored = spark.read.schema(CACHE_SCHEMA).parquet(cache_path)
    return stored.where(F.col("tokenizer") == tokenizer).select("digest", "n_tokens")


def token_counts(docs: DataFrame, tokenizer_path: str, cache_path: str | None = None, id_col: str = "doc_id",
                 text_col: str = "text", max_tokens: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of ``docs``.

    The cache at ``cache_path`` (Parquet; one writer at a time) gains the counts of the
    texts that it lacked. Without a path, a cache of this run alone is kept in the shared
    folder. Null texts count as empty (0 tokens); null and repeated ids are carried along,
    one result row per input row; other columns of ``docs`` are not read; an empty table
    gives an empty result. Texts of any length are encoded whole.
    """
    spark = docs.sparkSession
    cache_path = cache_path or f"{shared_dir(spark)}/token_cache"
    version = tokenizer_digest(tokenizer_path)
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(F.col(id_col).alias("doc_id"), text.alias("text")).select(
        "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.unhex(F.sha2("text", 256)).alias("digest"), "text")

    # one copy of each text leaves a task, so a large group of copies does not meet in one
    distinct = keyed.groupBy("digest").agg(F.first("text").alias("text"))
    misses = distinct.join(read_cache(spark, cache_path, version), "digest", "left_anti")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = chunk_counter(tokenizer_path)
        for batch in batches:
            n = [count(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([version] * len(n), pa.string()), batch.column("digest"), pa.array(n, pa.int64())], ["tokenizer", "digest", "n_tokens"])

    misses.select("digest", "text").mapInArrow(encode, CACHE_SCHEMA).write.mode("append").parquet(cache_path)
    counts = read_cache(spark, cache_path, version)
    return keyed.drop("text").join(counts, "digest").select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > max_tokens).alias("over_limit"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
