"""Problem 5: near-duplicates with small edits, by pigeonring filtering.

A text is the set of its k-word shingles.  Its sketch is a vector of
``SEGMENTS * WIDTH`` min-hash symbols; the lowest bits of the symbols form a bit
vector, and the Hamming distance of two such vectors follows the Jaccard
distance of their sets.  By the pigeonring principle a pair within the distance
budget has a start on the ring of segments from which every chain of
consecutive segments stays within its proportional budget.

1. Buckets of equal segments of symbols give candidates together with the
   segments they share, where the distance is nought: the starts of chains.
2. From each of these starts the chain is extended segment by segment and given
   up at the first segment that takes it over its proportional budget; only
   the segments reached are ever compared.
3. Pairs with a chain that lasts go to the full Hamming check.
4. An exact comparison of the shingle sets decides.

Texts with the same words form one class and enter once.  A bucket with more
than ``RUN`` classes is not paired up: its classes go to an exact prefix filter
over their rarest shingles instead, which prunes by size and position.  With
``exact`` all classes go there, so that nothing is left to chance.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .frames import cut, expand, only_ids, spread
from .lookalike import MIN_LETTERS, ScriptModel, forms, script_model

SEGMENTS, WIDTH = 48, 4
#: Longest chain that is tested, and the largest bucket that is paired up.
CHAIN = 16
RUN = 128


def _seeds() -> tuple[np.ndarray, np.ndarray]:
    from .kernel import mix64

    x = mix64(np.arange(2 * SEGMENTS * WIDTH, dtype=np.uint64) + np.uint64(77))
    odd = (x[: SEGMENTS * WIDTH] >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    return odd, (x[SEGMENTS * WIDTH :] >> np.uint64(32)).astype(np.uint32)


def sketches(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One row of 8-bit min-hash symbols per text; values[first[i]:first[i + 1]] are the shingles of text i (never none)."""
    from .kernel import mix64

    # The symbols of one segment come from hashes of their own, so that they are independent of each other.
    own = [(mix64(values + np.uint64(i)) >> np.uint64(32)).astype(np.uint32) for i in range(WIDTH)]
    out = np.empty((len(first), SEGMENTS * WIDTH), np.uint8)
    buf = np.empty_like(own[0])
    for j, (a, b) in enumerate(zip(*_seeds(), strict=True)):
        np.multiply(own[j % WIDTH], a, out=buf)
        np.add(buf, b, out=buf)
        low = np.minimum.reduceat(buf, first)
        low ^= low >> np.uint32(15)
        low *= np.uint32(0x2C1B3C6D)
        out[:, j] = low >> np.uint32(24)
    return out


def shingle_sets(texts: list[str], k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text (already in form)."""
    from .kernel import Words, blocks, distinct_by_doc

    out: list[np.ndarray] = []
    for lo, hi in blocks(texts):
        v, d = distinct_by_doc(*Words([t.casefold() for t in texts[lo:hi]]).shingles(k))
        out += np.split(v, np.searchsorted(d, np.arange(1, hi - lo)))
    return out


def budget(threshold: float) -> int:
    """The Hamming budget that keeps a pair just at the threshold with 4.5 standard deviations to spare.

    Two bits are equal if the symbols are, else in half of all cases.
    """
    k, p = SEGMENTS * WIDTH, (1 - threshold) / 2
    return math.ceil(k * p + 4.5 * math.sqrt(k * p * (1 - p)))


_POP = np.array([i.bit_count() for i in range(256)], np.uint8)


def chains(a: np.ndarray, b: np.ndarray, starts: np.ndarray, tau: int) -> np.ndarray:
    """Which pairs of packed bit vectors (one row each) have a chain within its proportional budgets from one of their starts (a bit mask of segments)."""
    row, seg = np.nonzero((starts[:, None] >> np.arange(SEGMENTS)) & 1)
    total = np.zeros(len(row), np.int64)
    for step in range(CHAIN):
        at = (seg + step) % SEGMENTS
        byte = a[row, at >> 1] ^ b[row, at >> 1]  # two segments of four bits
        total += _POP[np.where(at & 1, byte & 15, byte >> 4)]
        alive = total * SEGMENTS <= (step + 1) * tau
        row, seg, total = row[alive], seg[alive], total[alive]
        if not len(row):
            break
    out = np.zeros(len(a), bool)
    out[row] = True
    return out


def within(a: np.ndarray, b: np.ndarray, tau: int) -> np.ndarray:
    """The full Hamming check."""
    return _POP[a ^ b].sum(1, dtype=np.int64) <= tau


def _signed(v: np.ndarray) -> pa.Array:
    return pa.array(np.asarray(v, np.uint64).view(np.int64))


def _sketched(df: DataFrame, id_col: str, text_col: str, k: int, script: ScriptModel | None, damage: np.ndarray | None) -> DataFrame:
    """(id, k1, k2, s1, s2, sketch, bits) of every record that takes part."""
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .formatcopies import sort_entries
        from .kernel import Words, blocks, distinct_by_doc, letters_hash, mix64
        from .mojibake import damaged

        for batch in batches:
            texts, ids = batch.column(1).to_pylist(), batch.column(0)
            good = np.ones(len(texts), bool)
            if damage is not None:
                good = ~damaged(texts, damage)
            at = np.flatnonzero(good)
            live = [texts[i] for i in at]
            folded = [t.replace("\r\n", "\n").casefold() for t in (forms(live, script) if script else live)]
            for lo, hi in blocks(folded):
                part = folded[lo:hi]
                h1, h2, n = letters_hash([sort_entries(t) if ":" in t else t for t in part])
                v, d = distinct_by_doc(*Words(part).shingles(k))
                first = np.searchsorted(d, np.arange(hi - lo + 1))
                live = np.flatnonzero((n >= MIN_LETTERS) & (np.diff(first) > 0))
                if not len(live):
                    continue
                # Texts without shingles have empty ranges, so the starts of the others still bound each of them.
                starts = first[live]
                sums = np.add.reduceat(np.stack([v, mix64(v)]), starts, axis=1)
                sk = sketches(v, starts)
                cols = [ids.take(pa.array(at[lo:hi][live])), _signed(h1[live]), _signed(h2[live]), _signed(mix64(sums[0])), _signed(mix64(sums[1])), *(pa.array([r.tobytes() for r in x], pa.binary()) for x in (sk, np.packbits(sk & 1, axis=1)))]
                yield pa.RecordBatch.from_arrays(cols, names=["id", "k1", "k2", "s1", "s2", "sketch", "bits"])

    return spread(rows).mapInArrow(run, "id long, k1 long, k2 long, s1 long, s2 long, sketch binary, bits binary")


def _pairs_in_runs(batches: Iterator[pa.RecordBatch], longest: int = RUN) -> Iterator[pa.RecordBatch]:
    """From rows sorted by key: all pairs of runs up to ``longest`` with the bit of their segment, and the members (b null) of longer ones; nothing unbounded is held."""

    def emit(key: np.ndarray, cid: np.ndarray, hot: bool) -> Iterator[pa.RecordBatch]:
        edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        size = np.diff(np.append(edge, len(key)))
        a, b, mask, big = [], [], [], []
        for n in np.unique(size):
            if n < 2 and not hot:
                continue
            s = edge[size == n]
            if n > longest or hot:
                big += [cid[x : x + n] for x in s]
                continue
            i, j = np.triu_indices(n, 1)
            left, right = cid[s[:, None] + i].ravel(), cid[s[:, None] + j].ravel()
            a.append(np.minimum(left, right))
            b.append(np.maximum(left, right))
            mask.append(np.repeat(np.int64(1) << (key[s] & 63), len(i)))
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (a, b, mask)], names=["a", "b", "starts"])
        if big:
            m = np.concatenate(big)
            yield pa.RecordBatch.from_arrays([pa.array(m), pa.nulls(len(m), pa.int64()), pa.nulls(len(m), pa.int64())], names=["a", "b", "starts"])

    key, cid, hot_key = np.zeros(0, np.int64), np.zeros(0, np.int64), None
    for batch in batches:
        key = np.concatenate([key, batch.column(0).to_numpy()])
        cid = np.concatenate([cid, batch.column(1).to_numpy()])
        if not len(key):
            continue
        if hot_key is not None:
            n = int(np.searchsorted(key, hot_key, "right"))
            yield from emit(key[:n], cid[:n], True)
            key, cid = key[n:], cid[n:]
            if not len(key):
                continue
            hot_key = None
        done = int(np.searchsorted(key, key[-1], "left"))
        yield from emit(key[:done], cid[:done], False)
        key, cid = key[done:], cid[done:]
        if len(key) > longest:
            hot_key = key[-1]
            yield from emit(key, cid, True)
            key, cid = key[:0], cid[:0]
    yield from emit(key, cid, False)


def segment_keys(classes: DataFrame) -> DataFrame:
    """(key, cid) for each segment of the symbols of each class; the lowest six bits of a key are its segment."""
    part = lambda i: F.substring("sketch", i * WIDTH + 1, WIDTH)
    key = lambda i: F.xxhash64(part(i)).bitwiseAND(F.lit(~63)).bitwiseOR(F.lit(i))
    return classes.select("cid", F.explode(F.array(*[key(i) for i in range(SEGMENTS)])).alias("key")).select("key", "cid")


def _texts_of(df: DataFrame, ids: DataFrame, id_col: str, text_col: str, k: int, script: ScriptModel | None) -> DataFrame:
    """(id, shingles), one row per id, of the given ids (and of a few others if a filter picks them)."""
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            sets = shingle_sets(forms(texts, script) if script else texts, k)
            flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
            offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(offsets), _signed(flat))], names=["id", "shingles"])

    return only_ids(spread(rows), ids).mapInArrow(run, "id long, shingles array<long>").groupBy("id").agg(F.min("shingles").alias("shingles"))


def prefix_candidates(sets: DataFrame, threshold: float) -> DataFrame:
    """Exact candidates (a, b) among (id, shingles), one row per id.

    With shingles in one order, rarest first, a pair at the threshold shares a
    shingle that is among the first of both: of the smaller set among those
    that leave room for the overlap with a set of its own size, of the larger
    one among those that leave room for the overlap with any set.  What is left
    of both sets from the shared shingle on must be enough, too.
    """
    rows = sets.select("id", F.size("shingles").alias("n"), F.explode("shingles").alias("h"))
    df = rows.groupBy("h").agg(F.count(F.lit(1)).alias("df"))
    rarest = Window.partitionBy("id").orderBy("df", "h")
    least = lambda share, n: F.ceil(F.lit(share) * n - 1e-9)
    own = 2 * threshold / (1 + threshold)
    ranked = rows.join(df, "h").withColumn("r", F.row_number().over(rarest))
    prefix = ranked.where(F.col("r") <= F.col("n") - least(threshold, F.col("n")) + 1).where("df > 1")
    side = lambda s: prefix.select(F.col("id").alias(s), F.col("n").alias(f"n{s}"), F.col("r").alias(f"r{s}"), "h")
    small, large = side("a").where(F.col("ra") <= F.col("na") - least(own, F.col("na")) + 1), side("b")
    ordered = (F.col("na") < F.col("nb")) | (F.col("na") == F.col("nb")) & (F.col("a") < F.col("b"))
    size = F.col("na") >= F.lit(threshold) * F.col("nb") - 1e-9
    left = F.least(F.col("na") - F.col("ra"), F.col("nb") - F.col("rb")) + 1
    enough = left >= least(threshold / (1 + threshold), F.col("na") + F.col("nb"))
    pairs = small.join(large, "h").where(ordered & size & enough)
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def candidates(classes: DataFrame, threshold: float, sets_of, exact: bool = False, longest: int | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Candidates (a, b, starts) from buckets of equal segments, and exact ones (a, b) among the classes of crowded buckets (None if there are none).

    ``sets_of`` gives the shingle sets of ids.
    """
    longest = longest or RUN
    if exact:
        return classes.select(F.col("cid").alias("a"), F.col("cid").alias("b"), F.lit(0).cast("long").alias("starts")).limit(0), prefix_candidates(cut(sets_of(classes.select(F.col("cid").alias("id")))), threshold)
    rows = segment_keys(classes).repartition("key").sortWithinPartitions("key").mapInArrow(lambda batches: _pairs_in_runs(batches, longest), "a long, b long, starts long")
    runs = cut(rows.groupBy("a", "b").agg(F.bit_or("starts").alias("starts")))
    hot = runs.where("b is null").select(F.col("a").alias("id"))
    crowded = None if hot.isEmpty() else prefix_candidates(cut(sets_of(hot)), threshold)
    return runs.where("b is not null"), crowded


def prune(tau: int):
    """Chain, then full Hamming check, for rows (a, b, starts, bits_a, bits_b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for i in (3, 4))
            kept = np.flatnonzero(chains(x, y, batch.column(2).to_numpy(), tau))
            kept = kept[within(x[kept], y[kept], tau)]
            yield batch.select([0, 1]).take(pa.array(kept))

    return run


def near_copies(df: DataFrame, id_col: str = "essay_id", text_col: str = "text", k: int = 5, threshold: float = 0.8, skip_damaged: bool = True, formed: bool = True, exact: bool = False) -> tuple[DataFrame, DataFrame]:
    """Links (a, b, k-shingle Jaccard ``j``) between class representatives, and membership (id, cid).

    Null keys and texts, texts with fewer than 20 letters and digits or fewer
    than k words, and (unless told otherwise) garbled texts take no part.
    Copies of each other in formatting only are never linked.  Of rows that
    repeat a key with other texts the smallest sketch counts.  ``formed``
    compares texts in the form of ``lookalike``, else as they are; ``exact``
    finds candidates by prefixes alone.
    """
    rows = df.select(F.col(id_col), F.col(text_col))
    script = script_model(rows, text_col) if formed else None
    damage = None
    if skip_damaged:
        from .mojibake import bigram_model

        damage = bigram_model(rows, text_col)
    docs = cut(_sketched(rows, id_col, text_col, k, script, damage))
    cls = ["k1", "k2", "s1", "s2"]
    classes = cut(docs.groupBy(*cls).agg(F.min(F.struct("id", "sketch", "bits")).alias("m")).select("m.*", *cls).withColumnRenamed("id", "cid"))
    members = expand(classes.select("cid", *cls), docs.select("id", *cls), cls).select("id", "cid").distinct()

    sets_of = lambda ids: _texts_of(rows, ids, id_col, text_col, k, script)
    found, crowded = candidates(classes, threshold, sets_of, exact)
    side = lambda s: classes.select(F.col("cid").alias(s), F.col("bits").alias(f"bits_{s}"), F.col("k1").alias(f"k1_{s}"), F.col("k2").alias(f"k2_{s}"))
    no_copies = lambda pairs: pairs.join(side("a"), "a").join(side("b"), "b").where("k1_a <> k1_b or k2_a <> k2_b")
    close = no_copies(found).select("a", "b", "starts", "bits_a", "bits_b").mapInArrow(prune(budget(threshold)), "a long, b long")
    if crowded is not None:
        close = close.unionByName(no_copies(crowded).select("a", "b")).distinct()
    close = cut(close)
    ids = cut(close.select(F.col("a").alias("id")).union(close.select("b")).distinct())
    sets = cut(sets_of(ids))
    left, right = sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), sets.select(F.col("id").alias("b"), F.col("shingles").alias("y"))

    def exactly(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            xs, ys = batch.column("x"), batch.column("y")
            j = np.zeros(batch.num_rows)
            for i in range(batch.num_rows):
                x, y = xs[i].values.to_numpy(), ys[i].values.to_numpy()
                both = len(np.intersect1d(x, y, assume_unique=True))
                j[i] = both / (len(x) + len(y) - both)
            out = pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(j)], names=["a", "b", "j"])
            yield out.filter(pa.array(j >= threshold - 1e-12))

    links = close.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(exactly, "a long, b long, j double")
    return links, members


def near_copy_pairs(df: DataFrame, id_col: str = "essay_id", text_col: str = "text", k: int = 5, threshold: float = 0.8, **how: bool) -> DataFrame:
    """(id_a, id_b), a < b: all linked records, class links expanded to their members."""
    links, members = near_copies(df, id_col, text_col, k, threshold, **how)
    held = cut(members)
    once = expand(links.select("a", "b"), held.select(F.col("id").alias("x"), F.col("cid").alias("a")), ["a"])
    both = expand(once, held.select(F.col("id").alias("y"), F.col("cid").alias("b")), ["b"])
    return both.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
