"""The whole way of a text: train or load, tokenize, encode, decode, report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.chars import approx_tokens
from ..operators import bpe, container, unigram
from ..sources import corpus as corpora
from .config import APP_BPE, APP_SP, BpeConfig, CodecConfig, SpConfig


def bpe_results(corpus: DataFrame, vocab: DataFrame, cfg: BpeConfig = APP_BPE) -> DataFrame:
    """(doc_id, approx, pieces, ids, decoded, vocab_size); pieces are worked out once."""
    model = bpe.id_map(vocab, cfg.unknown_token)
    subwords = [r.subword for r in vocab.collect()]
    out = bpe.encode(corpus, subwords, model, cfg, approx_tokens(F.col("text")).alias("approx"))
    return out.withColumn("decoded", bpe.join_pieces(F.col("pieces"))).withColumn("vocab_size", F.lit(model.count()).cast("long"))


def sp_results(corpus: DataFrame, model: DataFrame, cfg: SpConfig = APP_SP) -> DataFrame:
    out = unigram.encode(corpus, model, cfg, approx_tokens(F.col("text")).alias("approx"))
    return out.withColumn("decoded", unigram.decode_pieces(F.col("pieces"))).withColumn("vocab_size", F.lit(model.count()).cast("long"))


def _file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def compress_files(spark: SparkSession, path: str, folder: str, cfg: CodecConfig = CodecConfig()) -> DataFrame:
    """Compress every file of a path into a container of its own in ``folder``; returns (path, name, ...) with the statistics of each.

    The chunks of all files are spread over the tasks; a file comes together in one row again.
    """
    width = spark.sparkContext.defaultParallelism
    files = corpora.files(spark, path).select(F.col("path").alias("id"), "content")
    chunks = container.compressed_chunks(files, cfg, partitions=width).persist()
    try:
        name = F.concat(F.regexp_replace(_file_name(F.col("id")), r"\.[^.]*$", ""), F.lit("_compressed.clm")).alias("name")
        corpora.write_files(container.containers(chunks, cfg.chunk_size).select(name, F.col("container").alias("content")), folder)
        stats = container.statistics(chunks).select(F.col("id").alias("path"), name, *[c for c in container.STATISTICS])
        kept = corpora.scratch(spark)  # one row per file, which need not fit the driver
        stats.write.parquet(kept)
        return spark.read.schema(stats.schema).parquet(kept)
    finally:
        chunks.unpersist()


def decompress_files(spark: SparkSession, path: str, folder: str) -> None:
    """Restore every container of a path into ``folder``: containers are taken apart, their chunks spread over the tasks and joined in order."""
    width = spark.sparkContext.defaultParallelism
    files = corpora.files(spark, path).select(F.col("path").alias("id"), F.posexplode(container.parse_column("content")).alias("chunk_idx", "c"))
    chunks = files.repartition(width).select("id", "chunk_idx", container.restore_column("c").alias("chunk"))
    stem = F.regexp_replace(F.regexp_replace(_file_name(F.col("id")), r"\.[^.]*$", ""), "_compressed$", "")
    corpora.write_files(container.join(chunks).select(F.concat(stem, F.lit("_decompressed.txt")).alias("name"), "content"), folder)
