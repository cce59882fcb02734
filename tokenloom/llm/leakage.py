"""Problem 9: evaluation items that leak into a corpus, by BM25 with block-max WAND.

The items are the indexed side; every passage of the corpus is a query.  A
passage is 24 words long and starts every 12 words, so each 12-word stretch of
a text lies whole within one.  For every item the least BM25 score that any of
its own 12-word stretches can give is known when the index is built; a passage
that holds such a stretch scores at least that much.  Impacts are stored as
shares of that score, so 1 is the threshold of every item and retrieving all
that reach it loses nothing.

Retrieval is block-max WAND, run for many passages in step: each has a cursor
per term; the largest impacts of its lists, added up in order of the cursors,
give the pivot, the first item that could reach the threshold.  The largest
impacts within the pivot's block of items decide whether it is scored or the
block is skipped; postings in between are never looked at.  What is retrieved
is verified by 12 equal consecutive words.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import cut, spread

RUN = 12
BLOCK_ITEMS = 8
K1, B = 1.2, 0.75
#: An index holds items of about so many characters (some 20 MB); more items mean more indexes and passes, never a larger one.
SLICE_CHARS = 4_000_000
#: Passages that are searched in step.
STEP_ROWS = 8192
#: Terms in more than this share of the items bound nothing: thresholds are worked out without them.
COMMON_SHARE = 0.25
_REACHED = 1 - 1e-9


@dataclass
class Index:
    ids: np.ndarray  # item ids
    vocab: np.ndarray  # sorted word hashes
    most: np.ndarray  # largest impact of each term
    postings: np.ndarray  # sorted term * (number of items) + item
    impact: np.ndarray  # of each posting
    blocks: np.ndarray  # sorted term * (number of blocks) + block
    block_most: np.ndarray  # largest impact of each of them
    stretches: np.ndarray  # sorted keys of (RUN-word stretch, item)

    @property
    def n_blocks(self) -> int:
        return max(1, -(-len(self.ids) // BLOCK_ITEMS))


def stretch_hashes(words: np.ndarray, run: int = RUN) -> np.ndarray:
    """Hash of the ``run`` words from each position on (texts are not told apart)."""
    n = len(words) - run + 1
    h = np.zeros(max(n, 0), np.uint64)
    for j in range(run):
        h *= np.uint64(0xD6E8FEB86659FD93)
        h += words[j : j + max(n, 0)]
    return h


def _stretch_keys(stretch: np.ndarray, item: np.ndarray) -> np.ndarray:
    from .kernel import mix64

    return mix64(stretch ^ mix64(item.astype(np.uint64)))


def build(ids: list[int], texts: list[str]) -> Index:
    """The index of some items; alike ones are neighbours, so that blocks tell them apart."""
    from .kernel import Words

    order = sorted(range(len(ids)), key=lambda i: (texts[i].casefold()[:40], ids[i]))
    ids, texts = [ids[i] for i in order], [texts[i] for i in order]
    n = len(ids)
    words = Words([t.casefold() for t in texts])
    vocab, term = np.unique(words.hash, return_inverse=True)
    size = np.diff(words.first)
    pair, of, tf = np.unique(words.doc * len(vocab) + term, return_inverse=True, return_counts=True)
    item, t = np.divmod(pair, max(len(vocab), 1))
    df = np.bincount(t, minlength=len(vocab))
    idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
    norm = K1 * (1 - B + B * size / max(1.0, size.mean() if n else 1.0))
    weight = idf[t] * tf * (K1 + 1) / (tf + norm[item])
    bounding = (df <= max(2, COMMON_SHARE * n))[t]
    # The word before that is the same word of the same item; a stretch counts a word where that lies before it.
    by = np.lexsort((np.arange(len(of)), of))
    before = np.full(len(of), -1)
    same = of[by][1:] == of[by][:-1]
    before[by[1:][same]] = by[:-1][same]

    def least(w: np.ndarray) -> np.ndarray:
        starts = np.arange(max(0, len(of) - RUN + 1))
        starts = starts[words.doc[starts] == words.doc[starts + RUN - 1]] if len(starts) else starts
        total = np.zeros(len(starts))
        for j in range(RUN):
            total += w[of[starts + j]] * (before[starts + j] < starts)
        out = np.full(n, np.inf)
        np.minimum.at(out, words.doc[starts], total)
        return out

    some, whole = least(np.where(bounding, weight, 0)), least(weight)
    # Where a stretch has common terms only, its item is bounded by all its terms.
    theta = np.where(some > 0, some, whole)
    kept = (bounding | ~(some > 0)[item]) & np.isfinite(theta)[item]
    item, t, share = item[kept], t[kept], weight[kept] / theta[item[kept]]
    by = np.lexsort((item, t))
    item, t, share = item[by], t[by], share[by]
    most = np.zeros(len(vocab))
    np.maximum.at(most, t, share)
    blocks, where = np.unique(t * max(1, -(-n // BLOCK_ITEMS)) + item // BLOCK_ITEMS, return_inverse=True)
    block_most = np.zeros(len(blocks))
    np.maximum.at(block_most, where, share)
    h = stretch_hashes(words.hash)
    inside = np.flatnonzero(words.doc[: len(h)] == words.doc[RUN - 1 :][: len(h)]) if len(h) else np.zeros(0, np.int64)
    return Index(np.array(ids, np.int64), vocab, most, t * max(n, 1) + item, share, blocks, block_most, np.unique(_stretch_keys(h[inside], words.doc[inside])))


def retrieve(terms: np.ndarray, index: Index) -> tuple[np.ndarray, np.ndarray, dict[str, int]]:
    """Block-max WAND for passages in step: (row, item) of all items that reach the threshold, and how much was looked at.

    ``terms`` has one row per passage with its different terms, padded by -1.
    """
    n, nb, done = len(index.ids), index.n_blocks, len(index.ids)
    bound = np.append(index.postings, np.iinfo(np.int64).max)
    work = {"steps": 0, "scored": 0, "skipped": 0, "moved": 0}
    row = np.arange(len(terms))
    key = np.where(terms >= 0, terms, 0).astype(np.int64)
    most = np.where(terms >= 0, index.most[key], 0.0)

    def seek(t: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first item of each term from the target on (``done`` if there is none), and its posting."""
        at = np.searchsorted(index.postings, t * n + target)
        return np.where(bound[at] // n == t, bound[at] % n, done), at

    cur, at = seek(key, np.zeros_like(key))
    cur = np.where(most > 0, cur, done)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    while len(row):
        work["steps"] += 1
        order = np.argsort(cur, axis=1, kind="stable")
        sums = np.cumsum(np.take_along_axis(most, order, 1), axis=1)
        reached = sums >= _REACHED
        p = reached.argmax(1)
        ahead = np.take_along_axis(cur, order, 1)
        pivot = ahead[np.arange(len(row)), p]
        alive = reached[:, -1] & (pivot < done)
        if not alive.all():
            row, key, most, cur, at, ahead, pivot = (x[alive] for x in (row, key, most, cur, at, ahead, pivot))
            if not len(row):
                break
        with_it = cur <= pivot[:, None]
        r, c = np.nonzero(with_it)
        block = key[r, c] * nb + pivot[r] // BLOCK_ITEMS
        b = np.minimum(np.searchsorted(index.blocks, block), len(index.blocks) - 1)
        promise = np.bincount(r, np.where(index.blocks[b] == block, index.block_most[b], 0.0), minlength=len(row))
        enough = promise >= _REACHED
        # Cursors that wait beyond the pivot could join in from where they are on.
        later = np.where(with_it, done, cur).min(1)
        there = enough & (ahead[:, 0] == pivot)
        target = np.where(enough, pivot + there, np.minimum((pivot // BLOCK_ITEMS + 1) * BLOCK_ITEMS, later))
        if there.any():
            s = np.flatnonzero(there)
            on = cur[s] == pivot[s, None]
            score = np.where(on, index.impact[np.minimum(at[s], len(index.impact) - 1)], 0.0).sum(1)
            good = s[score >= _REACHED]
            found.append((row[good], pivot[good]))
            work["scored"] += len(s)
        work["skipped"] += int((~enough).sum())
        r, c = np.nonzero(cur < target[:, None])
        work["moved"] += len(r)
        cur[r, c], at[r, c] = seek(key[r, c], target[r])
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), work
    return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found]), work


def _passages(words, index: Index) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each passage that could reach the threshold at all: its different terms (one padded row each), and its first and last word."""
    local = np.arange(len(words.hash)) - words.first[:-1][words.doc]
    # Half a passage is a cell; a passage is a cell and the one after it.
    cells = np.diff(words.first) // RUN + 2
    base = np.cumsum(cells) - cells
    cell = base[words.doc] + local // RUN
    term = np.minimum(np.searchsorted(index.vocab, words.hash), len(index.vocab) - 1)
    known = np.flatnonzero((index.vocab[term] == words.hash) & (index.most[term] > 0))
    total = np.bincount(cell[known], index.most[term[known]], minlength=int(cells.sum()))
    total[:-1] += total[1:].copy()
    wanted = np.flatnonzero(total >= _REACHED)
    picks = []
    for shift in (0, 1):
        p = cell[known] - shift
        k = np.minimum(np.searchsorted(wanted, p), len(wanted) - 1)
        fits = wanted[k] == p if len(wanted) else np.zeros(len(p), bool)
        picks.append(k[fits] * len(index.vocab) + term[known][fits])
    pairs = np.unique(np.concatenate(picks))
    k, t = np.divmod(pairs, max(len(index.vocab), 1))
    rank = np.arange(len(k)) - np.searchsorted(k, k)
    terms = np.full((len(wanted), int(rank.max(initial=-1)) + 1), -1, np.int64)
    terms[k, rank] = t
    doc = np.searchsorted(base, wanted, "right") - 1
    start = words.first[doc] + (wanted - base[doc]) * RUN
    return terms, start, words.first[doc + 1]


def search(texts: list[str], index: Index) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of text, item, number of the item's stretches found) of all verified leaks."""
    from .kernel import Words, blocks

    found: list[np.ndarray] = []
    for lo, hi in blocks(texts):
        words = Words([t.casefold() for t in texts[lo:hi]])
        if len(words.hash) < RUN or not len(index.postings):
            continue
        terms, start, end = _passages(words, index)
        h = stretch_hashes(words.hash)
        for a in range(0, len(terms), STEP_ROWS):
            row, item, _ = retrieve(terms[a : a + STEP_ROWS], index)
            # Verification: a stretch that starts in the passage's first half and equals one of the item's.
            at = start[a + row][:, None] + np.arange(RUN + 1)
            fits = at + RUN <= end[a + row][:, None]
            r, c = np.nonzero(fits)
            stretch = h[at[r, c]]
            key = _stretch_keys(stretch, item[r])
            k = np.minimum(np.searchsorted(index.stretches, key), len(index.stretches) - 1)
            same = index.stretches[k] == key
            if same.any():
                found.append(np.stack([(lo + words.doc[start[a + row[r[same]]]]).astype(np.uint64), item[r[same]].astype(np.uint64), stretch[same]]))
    if not found:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    pair, n = np.unique(np.unique(np.concatenate(found, axis=1), axis=1)[:2], axis=1, return_counts=True)
    return pair[0].astype(np.int64), index.ids[pair[1].astype(np.int64)], n


def _indexes(held: DataFrame, slices: int) -> DataFrame:
    """(slice, index): the pickled index of each slice of the items, built on the executors, as a written table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, tuple[list[int], list[str]]] = {}
        for b in batches:
            for k, i, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                ids, texts = parts.setdefault(k, ([], []))
                ids.append(i)
                texts.append(text)
        for k, (ids, texts) in parts.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([pickle.dumps(build(ids, texts))], pa.binary())], names=["slice", "index"])

    sliced = held.select(F.pmod(F.xxhash64("item"), F.lit(slices)).cast("int").alias("slice"), "item", "text")
    return cut(sliced.repartition(slices, "slice").mapInArrow(run, "slice int, index binary"))


def leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text_col: str = "text", slice_chars: int = SLICE_CHARS) -> DataFrame:
    """(item_id, doc_id, stretches): the documents that hold at least 12 consecutive words of an item, and how many such stretches of it.

    Null keys and texts take no part, items of fewer than 12 words cannot
    leak, repeated rows count once.  The driver hands one index at a time on.
    """
    held = items.select(F.col(item_id).alias("item"), F.col(text_col).alias("text")).where("item is not null and text is not null").distinct()
    chars = held.agg(F.sum(F.length("text"))).first()[0] or 0
    slices = max(1, math.ceil(chars / slice_chars))
    rows = spread(docs.select(F.col(doc_id).alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null"))
    indexes = _indexes(held, slices)
    out = docs.sparkSession.createDataFrame([], "item_id long, doc_id long, stretches long")
    for k in range(slices):
        for r in indexes.where(F.col("slice") == k).collect():  # one row of bounded size
            shared = docs.sparkSession.sparkContext.broadcast(bytes(r["index"]))

            def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
                index = pickle.loads(shared.value)
                for b in batches:
                    at, item, n = search(b.column(1).to_pylist(), index)
                    yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), b.column(0).take(pa.array(at)), pa.array(n, pa.int64())], names=["item_id", "doc_id", "stretches"])

            out = out.unionByName(rows.mapInArrow(run, "item_id long, doc_id long, stretches long"))
    return out.groupBy("item_id", "doc_id").agg(F.max("stretches").alias("stretches"))
