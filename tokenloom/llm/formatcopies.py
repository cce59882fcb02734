"""Problem 2: copies that differ in formatting only.

The canonical key of a record is a 128-bit hash of the letters and digits of
its form (see ``lookalike``), case folded, with the leading ``name: value``
entries sorted.  Keys that hold a large share of all rows are found exactly by
partial counts and aggregated in two levels over salts; all other keys take a
single shuffle.  The representative is the smallest id of a key.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import SALTS, cut, hot_from, spread
from .lookalike import MIN_LETTERS, ScriptModel, essays_once, forms, script_model

_EMPTY_LINE = re.compile(r"\n[^\S\n]*\n")
_FIRST_NAME = re.compile(r"[\W_]{0,40}[^\W_]+[^\w\s:]{0,8}\s?:")
_NAME = re.compile(r"([^\W_]+)[^\w\s:]{0,8}\s?:")
_NOT_ALNUM = re.compile(r"[\W_]+")

#: No key with fewer rows is hot; see ``hot_from`` for the rest.
HOT_LEAST = 1000


def sort_entries(text: str) -> str:
    """The text with its leading entries (set off by an empty line) in sorted order and one layout.

    A text without such a block is returned as it is.
    """
    text = text.lstrip()
    gap = _EMPTY_LINE.search(text) if _FIRST_NAME.match(text) else None
    if not gap:
        return text
    parts = _NAME.split(text[: gap.start()])
    entries = [f"{a}:{_NOT_ALNUM.sub('', b)}" for a, b in zip(parts[1::2], parts[2::2], strict=True)]
    return "\n".join([parts[0], *sorted(entries), "", text[gap.end() :]])


def canonical(texts: list[str], model: ScriptModel) -> list[str]:
    """Case-folded forms with sorted entries; two records are copies if these have the same letters and digits."""
    folded = (t.replace("\r\n", "\n").casefold() for t in forms(texts, model))
    return [sort_entries(t) if ":" in t else t for t in folded]


def copy_keys(df: DataFrame, id_col: str = "essay_id", text_col: str = "text", model: ScriptModel | None = None) -> DataFrame:
    """(id, k1, k2): the canonical key of every record with at least 20 letters and digits, one row per id.

    Null keys and null, empty or shorter texts take no part.  Rows that repeat
    an id with another text count once, with the smallest key.
    """
    rows = essays_once(df, id_col, text_col)
    own = model or script_model(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .kernel import letters_hash

        for b in batches:
            h1, h2, n = letters_hash(canonical(b.column(1).to_pylist(), own))
            out = pa.RecordBatch.from_arrays([b.column(0), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64))], names=["id", "k1", "k2"])
            yield out.filter(pa.array(n >= MIN_LETTERS))

    keys = spread(rows).mapInArrow(run, "id long, k1 long, k2 long")
    return keys.groupBy("id").agg(F.min(F.struct("k1", "k2")).alias("k")).select("id", "k.k1", "k.k2")


def collapse(keys: DataFrame, hot_least: int = HOT_LEAST) -> tuple[DataFrame, DataFrame]:
    """From (id, k1, k2): the groups (k1, k2, keep_id, n_copies, hot) and the hot keys.

    Ties cannot arise, as ids are distinct; an empty table gives no groups.
    """
    key = ["k1", "k2"]
    counts = keys.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    least = hot_from(keys.sparkSession, keys.count(), hot_least)
    hot = F.broadcast(cut(counts.where(F.col("n") > least).select(*key)))  # few by definition
    once = (F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("n_copies"))
    salted = keys.join(hot, key, "left_semi").withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
    two_level = salted.groupBy(*key, "salt").agg(*once).groupBy(*key).agg(F.min("keep_id").alias("keep_id"), F.sum("n_copies").alias("n_copies"))
    one_level = keys.join(hot, key, "left_anti").groupBy(*key).agg(*once)
    flag: Column = F.lit(True)
    return two_level.withColumn("hot", flag).unionByName(one_level.withColumn("hot", ~flag)), hot


def copies(df: DataFrame, id_col: str = "essay_id", text_col: str = "text", **hot_rule: int) -> DataFrame:
    """(keep_id, n_copies): one row per distinct record, with the number of ids that hold it."""
    groups, _ = collapse(cut(copy_keys(df, id_col, text_col)), **hot_rule)
    return groups.select("keep_id", "n_copies")


def copy_pairs(df: DataFrame, id_col: str = "essay_id", text_col: str = "text", **hot_rule: int) -> DataFrame:
    """(keep_id, copy_id): each copy with the smallest id of its group."""
    keys = cut(copy_keys(df, id_col, text_col))
    groups, hot = collapse(keys, **hot_rule)
    many = groups.where("n_copies > 1")
    key = ["k1", "k2"]
    in_hot = keys.join(hot, key, "left_semi").join(F.broadcast(many.where("hot")), key)
    in_cold = keys.join(hot, key, "left_anti").join(many.where("not hot"), key)
    pairs = in_hot.select("keep_id", "id").unionByName(in_cold.select("keep_id", "id"))
    return pairs.where("id <> keep_id").select("keep_id", F.col("id").alias("copy_id"))
