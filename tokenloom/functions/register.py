"""SQL names for the operators that are functions of one column."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import bpe, charcodec, container, unigram
from ..plans.config import APP_BPE, APP_SP, BpeConfig, SpConfig
from ..sources.corpus import split_line_column


def register(spark: SparkSession) -> None:
    """lz_compress, lz_decompress, char_compress, char_decompress and split_csv_line for this session."""
    spark.udf.register("lz_compress", container.compress_column)
    spark.udf.register("lz_decompress", container.decompress_column)
    spark.udf.register("char_compress", charcodec.compress_column)
    spark.udf.register("char_decompress", charcodec.decompress_column)
    spark.udf.register("split_csv_line", split_line_column)


def _define(spark: SparkSession, name: str, pieces: str, ids: str) -> None:
    spark.sql(f"create or replace temporary function {name}(text string) returns array<int> return {ids}({pieces})")


def register_bpe(spark: SparkSession, vocab: DataFrame, cfg: BpeConfig = APP_BPE, name: str = "bpe_encode") -> None:
    """``bpe_encode(text)``: the ids of a text under a trained vocabulary, 0 for pieces without one."""
    rows = bpe.id_map(vocab, cfg.unknown_token).collect()
    spark.udf.register(f"{name}_ids", bpe.lookup([r.token for r in rows], [int(r.id) for r in rows]))
    spark.udf.register(f"{name}_pieces", bpe.pieces_function([r.subword for r in vocab.collect()], cfg))
    _define(spark, name, f"{name}_pieces(text)", f"{name}_ids")


def register_sp(spark: SparkSession, model: DataFrame, cfg: SpConfig = APP_SP, name: str = "sp_encode") -> None:
    """``sp_encode(text)``: the ids of a text under a trained unigram model, 0 for pieces without one."""
    rows = model.select("id", "piece", "log_prob").collect()
    spark.udf.register(f"{name}_ids", bpe.lookup([r.piece for r in rows], [int(r.id) for r in rows]))
    spark.udf.register(f"{name}_pieces", unigram.pieces_function([(r.piece, r.log_prob) for r in rows], cfg))
    _define(spark, name, f"{name}_pieces(text)", f"{name}_ids")
