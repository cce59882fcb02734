"""Problem 10: long exact spans shared between records, by seed and extend.

Seeds are winnowed anchors: of every ``WINDOW`` consecutive k-gram hashes the
smallest is kept, so two texts that share ``least`` characters share an anchor
inside them.  Only anchors of at least two records live on, and only texts with
such anchors are read again.  Each anchor is sent with the characters around it
(``least - GRAM`` before, ``least`` from it on), which is enough to extend a
match both ways: the extensions of neighbouring anchors overlap, so their union
on one diagonal is the maximal repeat.

An anchor that more than ``HOT`` occurrences share is never paired up.  There
every stretch of ``least`` characters around the anchor is hashed instead, and
equal stretches are joined: what comes out of that join is the result itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .frames import cut, only_ids, spread

LEAST = 250
GRAM = 100
HOT = 200


def anchors(texts: list[str], least: int = LEAST, gram: int = GRAM) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(index of text, positions, hashes) of the winnowed anchors of each text of at least ``least`` characters."""
    from .kernel import blocks, codes, mix64, prefix_hash, span_hash, window_min

    w = least - gram + 1
    for lo, hi in blocks(texts):
        cp, start = codes(texts[lo:hi])
        h = prefix_hash(cp)
        for i in range(hi - lo):
            a, b = start[i], start[i + 1] - 1
            if b - a < least:
                continue
            at = np.arange(a, b - gram + 1)
            g = mix64(span_hash(h, at, at + gram))
            low = window_min(g, w)
            # A position is an anchor if it is the least of a window that holds it.
            edge = np.zeros(w - 1, np.uint64)
            high = ~window_min(~np.concatenate([edge, low, edge]), w)
            p = np.flatnonzero(g == high)
            yield lo + i, p, g[p]


def _seeds(docs: DataFrame, least: int, gram: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy()
            for i, p, g in anchors(b.column(1).to_pylist(), least, gram):
                yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array(np.full(len(p), ids[i])), pa.array(p.astype(np.int32))], names=["h", "id", "pos"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in run(batches):
            held.append(b)
            n += b.num_rows
            if n > 50_000:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, n = [], 0
        if held:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    return spread(docs).mapInArrow(packed, "h long, id long, pos int")


def _common(x: str, y: str) -> int:
    """Length of the common prefix."""
    n = min(len(x), len(y))
    if x[:n] == y[:n]:
        return n
    a, b = (np.frombuffer(s[:n].encode("utf-32-le", "surrogatepass"), np.uint32) for s in (x, y))
    return int((a != b).argmax())


def _once(docs: DataFrame) -> DataFrame:
    """(id, text) with one text per id; only hashes are compared, and texts shuffled only if some id has several."""
    hashed = docs.select("id", F.xxhash64("text").alias("th")).groupBy("id").agg(F.min("th").alias("lo"), F.max("th").alias("hi"))
    several = cut(hashed.where("lo <> hi").select("id", "lo"))
    if several.isEmpty():
        return docs
    return docs.join(several, "id", "left").where(F.col("lo").isNull() | (F.col("lo") == F.xxhash64("text"))).select("id", "text")


def shared_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, gram: int = GRAM, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """Spans (a, b, begin_a, begin_b, length) from cool anchors, and stretches (g, id, pos) of ``least`` characters from hot ones.

    Null keys and texts take no part, texts shorter than ``least`` share
    nothing; of rows that repeat a key one text counts (that of the smallest hash).
    """
    docs = _once(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.col(id_col).isNotNull() & (F.length(text_col) >= least)))
    seeds = cut(_seeds(docs, least, gram))
    several = seeds.groupBy("h").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo <> hi").select("h", "n")
    live = cut(seeds.join(several, "h").groupBy("id").agg(F.collect_set(F.struct("pos", "h", "n")).alias("seeds")))  # bounded by the length of the text
    back = least - gram

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .kernel import codes, mix64, prefix_hash, span_hash

        for b in batches:
            out: list[tuple] = []
            for i, text, found in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                burning = sorted(s["pos"] for s in found if s["n"] > hot)
                for s in found:
                    if s["n"] <= hot:
                        p = s["pos"]
                        out.append((False, s["h"], i, p, text[max(0, p - back) : p], text[p : p + least]))
                if burning:
                    cp, _ = codes([text])
                    h = prefix_hash(cp)
                    starts = np.unique(np.concatenate([np.arange(max(0, p - back), min(p, len(text) - least) + 1) for p in burning]))
                    for p, g in zip(starts.tolist(), mix64(span_hash(h, starts, starts + least)).view(np.int64).tolist(), strict=True):
                        out.append((True, g, i, p, None, None))
            if out:
                c = list(zip(*out, strict=True))
                kinds = (pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(c, kinds, strict=True)], names=["hot", "h", "id", "pos", "before", "after"])

    there = cut(only_ids(spread(docs), live.select("id")).join(live, "id").mapInArrow(around, "hot boolean, h long, id long, pos int, before string, after string"))
    cool, burning = there.where("not hot"), there.where("hot").select(F.col("h").alias("g"), "id", "pos").distinct()

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = zip(*(c.to_pylist() for c in b.columns), strict=True)
            out = []
            for ia, ib, pa_, pb, xb, yb, xa, ya in rows:
                left, right = _common(xb[::-1], yb[::-1]), _common(xa, ya)
                if right >= gram and left + right >= least:
                    out.append((ia, ib, pa_ - left, pb - left, left + right))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()), strict=True)], names=["a", "b", "begin_a", "begin_b", "length"])

    x, y = cool.alias("x"), cool.alias("y")
    both = x.join(y, (F.col("x.h") == F.col("y.h")) & (F.col("x.id") < F.col("y.id")))
    both = both.select("x.id", F.col("y.id").alias("id_b"), "x.pos", F.col("y.pos").alias("pos_b"), "x.before", F.col("y.before").alias("before_b"), "x.after", F.col("y.after").alias("after_b"))
    spans = both.mapInArrow(extend, "a long, b long, begin_a int, begin_b int, length int")
    return spans, burning


def maximal_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, **how: int) -> DataFrame:
    """(id_a, id_b, begin_a, begin_b, length), id_a < id_b: the stretches of at least ``least`` characters two records share that can be extended neither way.

    Positions count characters from 0.  Stretches around hot anchors are given
    between every record and the first one that holds them, not between all
    pairs; where that record changes, so does the row.
    """
    spans, burning = shared_spans(df, id_col, text_col, least, **how)
    first = burning.groupBy("g").agg(F.min(F.struct("id", "pos")).alias("first"))
    to_first = burning.join(first, "g").where("id <> first.id").select(F.col("first.id").alias("a"), F.col("id").alias("b"), F.col("first.pos").alias("begin_a"), F.col("pos").alias("begin_b"), F.lit(least).alias("length"))
    rows = spans.unionByName(to_first).distinct().withColumn("diagonal", F.col("begin_a") - F.col("begin_b")).withColumn("end", F.col("begin_a") + F.col("length"))
    line = Window.partitionBy("a", "b", "diagonal").orderBy("begin_a", "end")
    opens = F.col("begin_a") > F.coalesce(F.max("end").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))
    parts = rows.withColumn("opens", opens.cast("int")).withColumn("part", F.sum("opens").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    whole = parts.groupBy("a", "b", "diagonal", "part").agg(F.min("begin_a").alias("begin_a"), F.max("end").alias("end"))
    return whole.select(F.col("a").alias("id_a"), F.col("b").alias("id_b"), "begin_a", (F.col("begin_a") - F.col("diagonal")).alias("begin_b"), (F.col("end") - F.col("begin_a")).alias("length"))


def sharing_pairs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how: int) -> DataFrame:
    """(id_a, id_b), a < b: records with a stretch of at least ``least`` characters in common."""
    spans, burning = shared_spans(df, id_col, text_col, **how)
    held = burning.select("g", "id").distinct()
    x, y = held.alias("x"), held.alias("y")
    from_hot = x.join(y, (F.col("x.g") == F.col("y.g")) & (F.col("x.id") < F.col("y.id"))).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))
    return spans.select("a", "b").unionByName(from_hot).distinct().select(F.col("a").alias("id_a"), F.col("b").alias("id_b"))


def shared_part(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, **how: int) -> DataFrame:
    """(id, n_chars, shared_chars, shared_part): for every record with a text, how much of it is shared elsewhere.

    Empty texts and records that share nothing have 0; hot stretches count
    without ever being paired.
    """
    spans, burning = shared_spans(df, id_col, text_col, least, **how)
    elsewhere = burning.groupBy("g").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo <> hi").select("g")
    reach = F.col("pos") + F.lit(least)
    pieces = (
        spans.select(F.col("a").alias("id"), F.col("begin_a").alias("lo"), (F.col("begin_a") + F.col("length")).alias("hi"))
        .unionAll(spans.select("b", "begin_b", F.col("begin_b") + F.col("length")))
        .unionAll(burning.join(elsewhere, "g", "left_semi").select("id", "pos", reach))
        .distinct()
    )
    so_far = Window.partitionBy("id").orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, -1)
    new = F.col("hi") - F.greatest("lo", F.coalesce(F.max("hi").over(so_far), F.lit(0)))
    covered = pieces.withColumn("new", F.greatest(new, F.lit(0))).groupBy("id").agg(F.sum("new").alias("shared_chars"))
    sizes = df.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(F.length(text_col)).cast("long").alias("n_chars"))
    n = F.coalesce("shared_chars", F.lit(0))
    return sizes.join(covered, "id", "left").select("id", "n_chars", n.alias("shared_chars"), F.when(F.col("n_chars") > 0, F.round(n / F.col("n_chars"), 6)).otherwise(0.0).alias("shared_part"))
