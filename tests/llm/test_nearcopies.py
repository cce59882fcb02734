import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tokenloom.llm import frames, nearcopies
from tokenloom.llm.nearcopies import SEGMENTS, WIDTH, budget, chains, within


def texts(seed, n=60):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    out = []
    for _ in range(n):
        base = [rng.choice(words) for _ in range(60)]
        out.append(base)
        for _ in range(rng.choice([0, 0, 1, 3])):
            edit = list(base)
            for _ in range(rng.randint(1, 9)):
                edit[rng.randrange(len(edit))] = rng.choice(words)
            out.append(edit)
    return [(i, " ".join(t)) for i, t in enumerate(out)]


def brute(rows, k, threshold):
    sets = {i: {tuple(t.split()[j : j + k]) for j in range(len(t.split()) - k + 1)} for i, t in rows}
    pairs = set()
    for i in sets:
        for j in sets:
            if i < j and rows[i][1] != rows[j][1] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]):
                pairs.add((i, j))
    return pairs


@pytest.mark.parametrize(("k", "threshold", "run", "exact"), [(3, 0.6, 256, False), (5, 0.8, 256, False), (3, 0.6, 2, False), (3, 0.6, 256, True), (5, 0.8, 256, True)])
def test_all_pairs_are_found(spark, monkeypatch, k, threshold, run, exact):
    """With tiny runs most buckets take the exact prefix filter, with ``exact`` all classes do."""
    monkeypatch.setattr(nearcopies, "RUN", run)
    rows = texts(k)
    df = spark.createDataFrame(rows, "essay_id long, text string")
    got = {tuple(r) for r in nearcopies.near_copy_pairs(df, k=k, threshold=threshold, exact=exact).collect()}
    assert got == brute(rows, k, threshold) and got


def vectors(rng, share):
    """Symbols of pairs that agree in a share of them, packed lowest bits, and the mask of equal segments."""
    x = rng.integers(0, 256, (3000, SEGMENTS * WIDTH), np.uint8)
    y = np.where(rng.random(x.shape) < share, x, rng.integers(0, 256, x.shape, np.uint8))
    equal = (x == y).reshape(-1, SEGMENTS, WIDTH).all(2)
    starts = (equal.astype(np.int64) << np.arange(SEGMENTS)).sum(1)
    return np.packbits(x & 1, axis=1), np.packbits(y & 1, axis=1), starts, equal.any(1)


def test_chains_prune_before_the_hamming_check_and_lose_next_to_nothing():
    rng, tau = np.random.default_rng(1), budget(0.6)
    for share, low, high in ((0.6, 0.99, 1), (0.7, 0.9999, 1), (0.3, 0, 0.45), (0.2, 0, 0.25)):
        a, b, starts, candidate = vectors(rng, share)
        kept = chains(a, b, starts, tau)
        assert not (kept & ~candidate).any()
        assert low <= kept.sum() / candidate.sum() <= high
        # What the chains prune are pairs the full check would have had to look at.
        assert share > 0.5 or (candidate & ~kept).sum() > 50
    flips = np.unpackbits(a ^ b, axis=1).sum(1)
    assert (within(a, b, tau) == (flips <= tau)).all()


def test_a_large_family_below_the_threshold_gives_few_candidates(spark):
    """1,200 texts that share a core, any two at a similarity of 0.54: no pair is a result, and none is a candidate."""
    core = [f"c{i}" for i in range(150)]
    rows = [(i, " ".join(core + [f"u{i}x{j}" for j in range(62)])) for i in range(1200)]
    assert not brute(rows[:2], 3, 0.6) and brute(rows[:2], 3, 0.53)
    df = spark.createDataFrame(rows, "essay_id long, text string")
    sets = nearcopies._texts_of(df, df.select(F.col("essay_id").alias("id")), "essay_id", "text", 3, None)
    docs = nearcopies._sketched(df, "essay_id", "text", 3, None, None)
    light, crowded = nearcopies.candidates(docs.withColumnRenamed("id", "cid"), 0.6, lambda ids: sets.join(ids, "id", "left_semi"))
    assert crowded is not None and crowded.count() == 0
    # Buckets that are paired up have at most RUN classes, so their pairs grow with the number of texts only.
    assert light.count() < 1200 * nearcopies.RUN
    assert nearcopies.near_copy_pairs(df, k=3, threshold=0.6, formed=False, skip_damaged=False).count() == 0


def test_a_large_family_above_the_threshold_is_found_whole(spark):
    core = [f"c{i}" for i in range(150)]
    rows = [(i, " ".join(core + [f"u{i}x{j}" for j in range(20)])) for i in range(300)]
    df = spark.createDataFrame(rows, "essay_id long, text string")
    assert nearcopies.near_copy_pairs(df, k=3, threshold=0.6, formed=False, skip_damaged=False).count() == 300 * 299 // 2


@pytest.mark.parametrize("most", [0, 1_000_000])
def test_only_ids(spark, most):
    rows = spark.range(20_000).select(F.col("id"), F.lit("x").alias("text"))
    ids = spark.range(0, 20_000, 7)
    got = {r.id for r in frames.only_ids(rows, ids, most).collect()}
    wanted = set(range(0, 20_000, 7))
    assert wanted <= got and len(got - wanted) < (150 if most else 1)
    assert frames.only_ids(rows, ids.limit(0)).count() < 50


def test_hot_classes_are_dealt_over_salts(spark):
    members = spark.createDataFrame([(i, 1 if i < 500 else i) for i in range(700)], "x long, a long")
    pairs = spark.createDataFrame([(1, 600), (600, 601), (2, 3)], "a long, b long")
    got = {tuple(r) for r in frames.expand(pairs, members, ["a"], hot_least=100).select("x", "a", "b").collect()}
    assert got == {(i, 1, 600) for i in range(500)} | {(600, 600, 601)}


def test_runs_of_every_size():
    import pyarrow as pa

    keys = [1] * 3 + [2] + [3] * (nearcopies.RUN + 5) + [4] * 2
    ids = list(range(len(keys)))
    for step in (2, 7, 1000):
        batches = [pa.RecordBatch.from_arrays([pa.array(keys[i : i + step]), pa.array(ids[i : i + step])], names=["key", "cid"]) for i in range(0, len(keys), step)]
        out = [r for b in nearcopies._pairs_in_runs(iter(batches)) for r in b.to_pylist()]
        pairs = {(r["a"], r["b"]) for r in out if r["b"] is not None}
        hot = {r["a"] for r in out if r["b"] is None}
        assert {r["starts"] for r in out if r["b"] is not None} == {1 << 1, 1 << 4}
        assert pairs == {(0, 1), (0, 2), (1, 2), (len(keys) - 2, len(keys) - 1)}
        assert hot == set(range(4, 4 + nearcopies.RUN + 5))


def test_edges(spark):
    base = " ".join(f"word{i}" for i in range(40))
    near = base.replace("word39", "other")
    rows = [(1, base, 0), (2, base.upper() + "!", 0), (3, near, 0), (3, near, 0), (4, None, 0), (5, "", 0), (6, "one two", 0), (None, base, 0), (7, near + " cafÃ©", 0), (8, "long " * 50_000, 0)]
    df = spark.createDataFrame(rows, "essay_id long, text string, cid int")
    got = {tuple(r) for r in nearcopies.near_copy_pairs(df, k=3, threshold=0.6).collect()}
    assert got == {(1, 3), (2, 3)}
    assert nearcopies.near_copy_pairs(df.limit(0)).count() == 0
    _, members = nearcopies.near_copies(df.where(F.col("essay_id") < 3))
    assert {tuple(r) for r in members.collect()} == {(1, 1), (2, 1)}


def test_rows_repeated_in_hot_buckets(spark, monkeypatch):
    """Every bucket takes the exact prefix filter, and every row is delivered three times."""
    monkeypatch.setattr(nearcopies, "RUN", 1)
    rows = texts(3)
    df = spark.createDataFrame(rows * 3, "essay_id long, text string")
    got = {tuple(r) for r in nearcopies.near_copy_pairs(df, k=3, threshold=0.6).collect()}
    assert got == brute(rows, 3, 0.6)
