"""Command line: ``tokenize`` a text, ``compress``, ``decompress`` and ``compress-text`` files, ``test``."""

from __future__ import annotations

import argparse
import sys
import time
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .functions import chars
from .operators import bpe, charcodec, container, unigram
from .plans import pipeline
from .plans.config import APP_BPE, APP_SP
from .ship import ship
from .sources import corpus, models


def _session() -> SparkSession:
    spark = SparkSession.builder.appName("tokenloom").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    return spark


def parse_mode(text: str) -> str:
    """Empty or ``bpe``; ``sp`` or ``sentencepiece``."""
    name = text.strip().lower()
    if name in ("", "bpe"):
        return "bpe"
    if name in ("sp", "sentencepiece"):
        return "sp"
    raise ValueError(f"unknown tokenizer {text!r}")


def tokenize(spark: SparkSession, mode: str, text: str, corpus_path: str, model_path: str | None = None) -> dict:
    """Train (or load a saved model), then tokenize one text; returns the report."""
    one = spark.createDataFrame([(0, text)], "doc_id long, text string")
    if parse_mode(mode) == "bpe":
        if model_path and Path(model_path).exists():
            vocab, _ = models.load_binary(spark, model_path)
        else:
            vocab = bpe.train(corpus.corpus(spark, corpus_path, APP_BPE.word_limit))
            if model_path:
                models.save_binary(vocab, model_path)
        row = pipeline.bpe_results(one, vocab).first()
        shown = row.pieces
    else:
        model = unigram.train(corpus.corpus(spark, corpus_path, APP_SP.row_limit), APP_SP)
        out = pipeline.sp_results(one, model, APP_SP)
        row = out.first()
        shown = out.select(unigram.display_pieces(F.col("pieces"))).first()[0]
    return row.asDict() | {"display": shown}


def compress_paths(spark: SparkSession, path: str, folder: str) -> DataFrame:
    """Files into containers, as Spark tasks over their chunks; returns the statistics with sizes and throughput for reading."""
    began = time.perf_counter()
    stats = pipeline.compress_files(spark, path, folder)
    millis = (time.perf_counter() - began) * 1000
    took = F.lit(millis)
    total = F.sum("original_bytes").over(Window.partitionBy())
    shown = {"original": chars.format_bytes(F.col("original_bytes")), "compressed": chars.format_bytes(F.col("compressed_bytes")), "time": chars.format_millis(took), "mb_per_s": F.round(chars.throughput_mb(total, took), 3)}
    return stats.withColumns(shown)


def print_text_files(spark: SparkSession, path: str, folder: str) -> None:
    """Text files through the character codec; a file whose round trip fails is reported and not written."""
    done = charcodec.compress_files(corpus.text_files(spark, path)).persist()
    name = F.concat(F.element_at(F.split("path", "/"), -1), F.lit(".lzh"))
    corpus.write_files(done.where("same").select(name.alias("name"), "content"), folder)
    done.drop("content").show(truncate=False)
    done.unpersist()


def self_test() -> bool:
    samples = [b"", b"A", b"ab" * 12, b"A" * 10_000 + b"B" * 10_000, b"the quick brown fox jumped over the lazy dog. " * 2000]
    return all(container.decompress(container.compress(s)) == s and charcodec.decompress(charcodec.compress(s.decode())) == s.decode() for s in samples)


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="tokenloom")
    sub = p.add_subparsers(dest="what", required=True)
    t = sub.add_parser("tokenize")
    t.add_argument("text")
    t.add_argument("--corpus", required=True)
    t.add_argument("--mode", default="bpe")
    t.add_argument("--model")
    for name in ("compress", "decompress", "compress-text"):
        s = sub.add_parser(name)
        s.add_argument("path")
        s.add_argument("folder")
    sub.add_parser("test")
    a = p.parse_args(argv)
    if a.what == "tokenize":
        if not a.text:
            print("no text", file=sys.stderr)
            return 1
        for k, v in tokenize(_session(), a.mode, a.text, a.corpus, a.model).items():
            print(f"{k}: {v}")
    elif a.what == "compress":
        compress_paths(_session(), a.path, a.folder).show(truncate=False)
    elif a.what == "decompress":
        pipeline.decompress_files(_session(), a.path, a.folder)
    elif a.what == "compress-text":
        print_text_files(_session(), a.path, a.folder)
    else:
        ok = self_test()
        print("PASS" if ok else "FAIL")
        return int(not ok)
    return 0


if __name__ == "__main__":
    sys.exit(main())
