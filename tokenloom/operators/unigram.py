"""Unigram tokenizer: normalization, n-gram training, Viterbi encoding, decoding."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.chars import LOWER, UPPER, WS_SP, fold_ascii
from ..plans.config import APP_SP, SpConfig
from . import bpe

MARKER = "▁"
# The unknown piece and its score, the cost of a character without a piece, the least count of an n-gram.
UNK, UNK_LOG_PROB, FALLBACK_COST, LEAST_COUNT = "<unk>", -20.0, 20.0, 2


def normalize(text: Column, cfg: SpConfig = APP_SP) -> Column:
    """Runs of blanks and lower-to-upper borders become the marker, which also leads any text that is not empty."""
    bare = F.regexp_replace(text, f"^[{WS_SP}]+|[{WS_SP}]+$", "")
    if cfg.split_camel_case:
        bare = F.regexp_replace(bare, "([a-z])([A-Z])", f"$1{MARKER}$2")
    bare = F.regexp_replace(bare, f"[{WS_SP}]+", MARKER)
    bare = fold_ascii(bare) if cfg.lowercase else bare
    return F.when(F.length(bare) == 0, F.lit("")).otherwise(F.concat(F.lit(MARKER), bare))


def training_rows(corpus: DataFrame, cfg: SpConfig = APP_SP) -> DataFrame:
    """(doc_id, norm): the first ``row_limit`` rows that are not empty, normalized."""
    rows = bpe.first_rows(corpus.where("text is not null and text <> ''"), cfg.row_limit)
    return rows.select("doc_id", normalize(F.col("text"), cfg).alias("norm")).where("norm <> ''")


def seed_chars(rows: DataFrame) -> DataFrame:
    """(piece, n, log_prob): every character of the training text; each batch is counted at once."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            joined = "".join(batch.column(0).to_pylist())
            n = np.bincount(np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32), minlength=1)
            used = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([chr(c) for c in used.tolist()], pa.string()), pa.array(n[used])], names=["piece", "n"])

    counts = rows.select("norm").mapInArrow(count, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    return counts.withColumn("log_prob", F.log(F.col("n") / F.sum("n").over(Window.partitionBy())))


def ngram_counts(rows: DataFrame, max_chars: int) -> DataFrame:
    """(piece, n) of all n-grams of 2 to ``max_chars`` characters with at least two occurrences.

    Each batch is counted with array operations over one code-point array, so
    only distinct n-grams of a batch become rows and are summed in a shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece, n in count_ngrams(batch.column(0).to_pylist(), max_chars):
                yield pa.RecordBatch.from_arrays([piece, n], names=["piece", "n"])

    width = rows.sparkSession.sparkContext.defaultParallelism
    return rows.select("norm").repartition(width).mapInArrow(run, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def count_ngrams(texts: list[str], max_chars: int, block: int = 500_000) -> Iterator[tuple[pa.Array, pa.Array]]:
    """Distinct n-grams of the texts and their counts, by blocks of text and length."""
    for joined, at, _, first, n, k in hashed_ngrams(texts, max_chars, block):
        yield pa.array([joined[i : i + k] for i in at[first].tolist()], pa.string()), pa.array(n, pa.int64())


def hashed_ngrams(texts: list[str], max_chars: int, block: int = 500_000) -> Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]]:
    """By blocks of text and length: the block, the places of its n-grams, the distinct hashes, the first place of each, their counts, and the length."""
    lo = 0
    while lo < len(texts):
        hi, size = lo, 0
        while hi < len(texts) and (size < block or hi == lo):
            size += len(texts[hi]) + 1
            hi += 1
        joined = "\n".join(texts[lo:hi]) + "\n"
        cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        left = np.zeros(len(cp), np.int64)  # characters left in the text from here on
        for a, b in _spans(texts[lo:hi]):
            left[a:b] = np.arange(b - a, 0, -1)
        h = np.zeros(len(cp), np.uint64)
        for k in range(1, max_chars + 1):
            h = _extend(h[: len(cp) - k + 1], cp[k - 1 :])
            if k > 1:
                at = np.flatnonzero(left[: len(h)] >= k)
                hashes, first, n = np.unique(h[at], return_index=True, return_counts=True)
                yield joined, at, hashes, first, n, k
        lo = hi


def _spans(texts: list[str]) -> Iterator[tuple[int, int]]:
    at = 0
    for t in texts:
        yield at, at + len(t)
        at += len(t) + 1


def best_ngrams(rows: DataFrame, max_chars: int, room: int) -> tuple[int, list[tuple[str, int]]]:
    """The occurrences of all n-grams with at least two, and the ``room`` best of them: most frequent, longest in bytes, smallest.

    N-grams are counted by their hashes; the strings are looked up for those
    alone that are frequent enough to be among the best.
    """
    width = rows.sparkSession.sparkContext.defaultParallelism
    texts = rows.select("norm").repartition(width)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, hashes, _, n, _ in hashed_ngrams(batch.column(0).to_pylist(), max_chars):
                yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(n)], names=["h", "n"])

    counts = texts.mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT).persist()
    try:
        total = counts.agg(F.sum("n")).first()[0] or 0
        top = counts.orderBy(F.desc("n")).limit(room).agg(F.min("n")).first()[0] if room > 0 else None
        if top is None:
            return total, []
        wanted = counts.where(F.col("n") >= top)
        if wanted.count() > 50 * room:  # many ties at a low count: let Spark order the strings
            best = ngram_counts(rows, max_chars).orderBy(F.desc("n"), F.octet_length("piece").desc(), "piece").limit(room)
            return total, [(r.piece, r.n) for r in best.collect()]
        n_of = {r.h: r.n for r in wanted.collect()}
    finally:
        counts.unpersist()
    held = np.sort(np.array(list(n_of), np.int64))

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for joined, at, hashes, first, _, k in hashed_ngrams(batch.column(0).to_pylist(), max_chars):
                h = hashes.view(np.int64)
                hit = np.flatnonzero(held[np.minimum(np.searchsorted(held, h), len(held) - 1)] == h)
                yield pa.RecordBatch.from_arrays([pa.array(h[hit]), pa.array([joined[i : i + k] for i in at[first[hit]].tolist()], pa.string())], names=["h", "piece"])

    # The best n-grams are frequent: some texts hold them all, so texts are read in growing slices.
    some = 1000
    while True:
        slice_ = rows.select("norm").limit(some).repartition(width)
        named = slice_.mapInArrow(name, "h long, piece string").distinct().collect()  # at most 50 x room n-grams
        if len(named) == len(n_of):
            break
        some *= 16
    order = sorted(((n_of[r.h], r.piece) for r in named), key=lambda x: (-x[0], -len(x[1].encode()), x[1].encode()))
    return total, [(piece, n) for n, piece in order[:room]]


def train(corpus: DataFrame, cfg: SpConfig = APP_SP) -> DataFrame:
    """The model (id, piece, n, log_prob): the unknown piece, all characters, then the best n-grams up to the target size."""
    rows = training_rows(corpus, cfg).persist()
    try:
        spark = corpus.sparkSession
        chars = seed_chars(rows).orderBy(F.desc("n"), "piece").collect()  # bounded by the alphabet
        if not chars:
            raise ValueError("no training text")
        total, best = best_ngrams(rows, cfg.max_piece_chars, cfg.target_vocab - 1 - len(chars))
    finally:
        rows.unpersist()
    model = [(UNK, 0, UNK_LOG_PROB), *[(r.piece, r.n, r.log_prob) for r in chars if r.piece != UNK], *[(p, n, math.log(n / total)) for p, n in best if p != UNK]]
    return spark.createDataFrame([(i, *m) for i, m in enumerate(model)], "id int, piece string, n long, log_prob double")


#: Characters that are segmented in step; the arrays of a block take some 60 bytes for each.
BLOCK_CHARS = 1_000_000
_MULTIPLIER, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _extend(h: np.ndarray, cp: np.ndarray) -> np.ndarray:
    """Hashes of strings with one more character each."""
    h = h * _MULTIPLIER + (cp.astype(np.uint64) + np.uint64(1)) * _STEP
    return h ^ (h >> np.uint64(29))


class Segmenter:
    """Viterbi segmentation of many texts in step.

    The pieces that start at each position are found by hashes of substrings,
    one length after the other; then the cheapest way to each end position is
    worked out for all texts at once, in the order of positions, and the ways
    are walked back for all texts at once.
    """

    def __init__(self, pieces: list[str], log_prob: list[float], max_chars: int):
        self.by_length: list[tuple[np.ndarray, np.ndarray]] = []
        for k in range(1, max_chars + 1):
            some = [(p, -c) for p, c in zip(pieces, log_prob, strict=True) if len(p) == k]
            h = np.zeros(len(some), np.uint64)
            for i in range(k):
                h = _extend(h, np.array([ord(p[i]) for p, _ in some], np.uint32))
            order = np.argsort(h)
            self.by_length.append((h[order], np.array([c for _, c in some])[order] if some else np.zeros(0)))

    def lengths(self, cp: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """For each end position of each text the length of the last piece of the cheapest way there; texts are in order of falling size, each followed by one more position."""
        left = np.repeat(start + size, size + 1) - np.arange(len(cp))
        cost = []
        h = np.zeros(len(cp), np.uint64)
        alive = np.arange(len(cp))
        for k, (hashes, costs) in enumerate(self.by_length, 1):
            alive = alive[left[alive] >= k]
            h = _extend(h[: len(cp) - k + 1], cp[k - 1 :])
            c = np.full(len(cp), np.inf)
            if len(hashes):
                at = np.minimum(np.searchsorted(hashes, h[alive]), len(hashes) - 1)
                hit = hashes[at] == h[alive]
                c[alive[hit]] = costs[at[hit]]
            cost.append(c)
        longest = len(cost)
        out = np.ones(len(cp), np.uint8)
        ring = np.full((longest + 1, len(size)), np.inf)
        ring[0] = 0.0
        falling = -size
        for end in range(1, int(size.max(initial=0)) + 1):
            n = int(np.searchsorted(falling, -end, "right"))  # texts that reach so far
            here = start[:n] + end
            best, length = np.full(n, np.inf), np.zeros(n, np.uint8)
            # The earliest start is tried first, so it wins among equal costs.
            for k in range(min(longest, end), 0, -1):
                c = ring[(end - k) % (longest + 1), :n] + cost[k - 1][here - k]
                less = c < best
                best[less] = c[less]
                length[less] = k
            none = length == 0
            if none.any():
                best[none] = ring[(end - 1) % (longest + 1), :n][none] + FALLBACK_COST
                length[none] = 1
            ring[end % (longest + 1), :n] = best
            out[here] = length
        return out

    def __call__(self, norm: pa.Array) -> pa.Array:
        """Arrays of pieces; null stays null."""
        texts = norm.to_pylist()
        order = sorted((i for i, t in enumerate(texts) if t), key=lambda i: -len(texts[i]))
        parts, where = [], np.full(len(texts), -1)
        lo = done = 0
        while lo < len(order):
            hi, chars = lo, 0
            while hi < len(order) and (not chars or chars + len(texts[order[hi]]) <= BLOCK_CHARS):
                chars += len(texts[order[hi]]) + 1
                hi += 1
            parts.append(self._block([texts[i] for i in order[lo:hi]]))
            where[order[lo:hi]] = np.arange(done, done + hi - lo)
            done += hi - lo
            lo = hi
        empty = pa.array([[], None], pa.list_(pa.string()))
        whole = pa.concat_arrays([*parts, empty])
        return whole.take(pa.array([done + 1 if t is None else where[i] if t else done for i, t in enumerate(texts)], pa.int64()))

    def _block(self, texts: list[str]) -> pa.Array:
        joined = "\n".join(texts) + "\n"
        cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        size = np.array([len(t) for t in texts])
        start = np.concatenate([[0], np.cumsum(size + 1)[:-1]])
        length = self.lengths(cp, start, size)
        begins = np.zeros(len(cp) + 1, bool)
        at, first = start + size, start
        while len(at):
            at = at - length[at]
            begins[at] = True
            going = at > first
            at, first = at[going], first[going]
        begins[start + size] = True  # the line feeds, dropped below
        begins[len(cp)] = True
        width = 1 + (cp >= 0x80).astype(np.int32) + (cp >= 0x800) + (cp >= 0x10000)
        byte = np.concatenate([[0], np.cumsum(width)]).astype(np.int32)
        cuts = np.flatnonzero(begins)
        data = joined.encode()
        flat = pa.StringArray.from_buffers(len(cuts) - 1, pa.py_buffer(byte[cuts].tobytes()), pa.py_buffer(data))
        feeds = np.searchsorted(cuts, start + size)
        kept = np.ones(len(cuts) - 1, bool)
        kept[feeds] = False
        offsets = np.concatenate([[0], feeds - np.arange(len(feeds))]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), flat.filter(pa.array(kept)))


def encoder(model: list[tuple[str, float]], max_chars: int):
    """An Arrow UDF from normalized texts to arrays of pieces."""
    pieces, log_prob = [p for p, _ in model], [c for _, c in model]
    longest = max([len(p) for p in pieces if len(p) <= max_chars], default=1)

    @F.arrow_udf("array<string>")
    def run(norm: pa.Array) -> pa.Array:
        return Segmenter(pieces, log_prob, longest)(norm)

    return run


def pieces_function(model: list[tuple[str, float]], cfg: SpConfig = APP_SP):
    """An Arrow UDF from raw texts to arrays of pieces, for use by name in SQL."""
    blanks = "".join(map(chr, (*range(9, 14), 0x20, 0xA0, 0x1680, 0x2007, 0x202F, 0x3000)))
    run_of, camel, fold = re.compile(f"[{blanks}]+"), re.compile("([a-z])([A-Z])"), str.maketrans(UPPER, LOWER)
    longest = max([len(p) for p, _ in model if len(p) <= cfg.max_piece_chars], default=1)

    def norm(t: str | None) -> str | None:
        if t is None:
            return None
        t = t.strip(blanks)
        t = camel.sub(rf"\1{MARKER}\2", t) if cfg.split_camel_case else t
        t = run_of.sub(MARKER, t)
        return MARKER + (t.translate(fold) if cfg.lowercase else t) if t else ""

    @F.arrow_udf("array<string>")
    def run(text: pa.Array) -> pa.Array:
        return Segmenter([p for p, _ in model], [c for _, c in model], longest)(pa.array([norm(t) for t in text.to_pylist()], pa.string()))

    return run


def encode(corpus: DataFrame, model: DataFrame, cfg: SpConfig = APP_SP, *more: Column) -> DataFrame:
    """(doc_id, pieces, ids) and any more columns of the corpus; unseen pieces have id 0, a null text gives null."""
    rows = model.select("id", "piece", "log_prob").collect()  # bounded by the vocabulary
    cut = encoder([(r.piece, r.log_prob) for r in rows], cfg.max_piece_chars)
    ids = bpe.lookup([r.piece for r in rows], [r.id for r in rows])
    out = corpus.select("doc_id", *more, cut(normalize(F.col("text"), cfg)).alias("pieces"))
    return out.withColumn("ids", ids("pieces"))


def decode_pieces(pieces: Column) -> Column:
    return F.trim(F.replace(F.array_join(pieces, ""), F.lit(MARKER), F.lit(" ")))


def decode_ids(encoded: DataFrame, model: DataFrame) -> DataFrame:
    """(doc_id, decoded); an id out of range prints the unknown piece."""
    rows = [(r.id, r.piece) for r in model.select("id", "piece").collect()]
    return encoded.select("doc_id", decode_pieces(bpe.id_tokens(rows, UNK)("ids")).alias("decoded"))


def display_pieces(pieces: Column) -> Column:
    """Pieces glued to words at the marker for display; pieces without any marker pass through."""
    bare = lambda p: F.replace(p, F.lit(MARKER), F.lit(""))
    # A word border stands before a piece that begins with the marker; a bare marker is nothing but a border.
    marked = F.transform(pieces, lambda p: F.when(p.startswith(MARKER), F.concat(F.lit("\x00"), bare(p))).otherwise(bare(p)))
    glued = F.filter(F.split(F.array_join(marked, ""), "\x00"), lambda w: w != "")
    return F.when(F.exists(pieces, lambda p: p.contains(MARKER)), glued).otherwise(pieces)
