"""Encoding of streams with a frozen model: stateless, so the batch expressions serve unchanged."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import bpe, unigram
from ..plans.config import APP_BPE, APP_SP, BpeConfig, SpConfig


def bpe_stream(stream: DataFrame, subwords: list[str], model: DataFrame, cfg: BpeConfig = APP_BPE) -> DataFrame:
    """(doc_id, pieces, ids); pieces without an id are 0, as first appearance has no meaning in a stream."""
    rows = model.select("token", "id").collect()
    ids = bpe.lookup([r.token for r in rows], [int(r.id) for r in rows])
    return bpe.tokenize(stream, subwords, cfg).withColumn("ids", ids("pieces"))


def sp_stream(stream: DataFrame, model: DataFrame, cfg: SpConfig = APP_SP) -> DataFrame:
    return unigram.encode(stream, model, cfg)
