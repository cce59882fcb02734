"""Saving and loading of tokenizer models: Parquet tables, and the binary pair-merge format."""

from __future__ import annotations

import struct
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# Fixed value of the format: magic; then u32 length + unknown token, u32 longest subword in characters, u32 count, count x (u32 length + bytes).
MAGIC = b"NKS_BPE1"


class BrokenModel(ValueError):
    """The bytes are no intact model."""


def to_bytes(subwords: list[str], unknown_token: str = "<unk>") -> bytes:
    """Little-endian; subwords in byte order."""
    text = lambda b: struct.pack("<I", len(b)) + b
    encoded = sorted({s.encode() for s in subwords})
    return b"".join([MAGIC, text(unknown_token.encode()), struct.pack("<II", max(map(len, subwords), default=0), len(encoded)), *map(text, encoded)])


def from_bytes(data: bytes) -> tuple[list[str], str]:
    """(subwords, unknown token); raises BrokenModel for a wrong magic or a truncated file."""
    if data[: len(MAGIC)] != MAGIC:
        raise BrokenModel("wrong magic")
    at = len(MAGIC)

    def take(n: int) -> bytes:
        nonlocal at
        if at + n > len(data):
            raise BrokenModel("truncated")
        at += n
        return data[at - n : at]

    number = lambda: struct.unpack("<I", take(4))[0]
    try:
        unknown = take(number()).decode()
        number()
        return [take(number()).decode() for _ in range(number())], unknown
    except UnicodeDecodeError as e:
        raise BrokenModel("not UTF-8") from e


def save_binary(vocab: DataFrame, path: str, unknown_token: str = "<unk>") -> None:
    """One small file on the driver's file system (the vocabulary is bounded by its training limits)."""
    Path(path).write_bytes(to_bytes([r.subword for r in vocab.select("subword").collect()], unknown_token))


def load_binary(spark: SparkSession, path: str) -> tuple[DataFrame, str]:
    subwords, unknown = from_bytes(Path(path).read_bytes())
    return spark.createDataFrame([(s,) for s in subwords], "subword string"), unknown


def save(model: DataFrame, path: str) -> None:
    model.write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
