import itertools
import math
import random
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tokenloom.operators import unigram
from tokenloom.plans.config import SpConfig


def viterbi(text, pieces, longest):
    """The recurrence position by position: strictly cheaper ways only, so the earliest start wins."""
    n = len(text)
    cost, back = [0.0] + [math.inf] * n, [-1] * (n + 1)
    for i in range(n):
        for j in range(i + 1, min(n, i + longest) + 1):
            p = pieces.get(text[i:j])
            if p is not None and cost[i] - p < cost[j]:
                cost[j], back[j] = cost[i] - p, i
        if back[i + 1] < 0 and cost[i] + 20 < cost[i + 1]:
            cost[i + 1], back[i + 1] = cost[i] + 20, i
    out, at = [], n
    while at > 0:
        out.append(text[back[at] : at])
        at = back[at]
    return out[::-1]


def segment(texts, pieces, longest):
    return unigram.Segmenter(list(pieces), list(pieces.values()), longest)(pa.array(texts, pa.string())).to_pylist()


@pytest.mark.parametrize("block", [40, 1000, 1_000_000])
def test_segments_in_step_equal_a_plain_loop(monkeypatch, block):
    monkeypatch.setattr(unigram, "BLOCK_CHARS", block)
    rng = random.Random(block)
    for _ in range(40):
        letters = "abcé▁😀"[: rng.randint(2, 6)]
        pieces = {"".join(rng.choice(letters) for _ in range(rng.randint(1, 5))): -rng.choice([1.0, 2.0, 3.0, rng.random() * 6]) for _ in range(rng.randint(1, 30))}
        texts = ["".join(rng.choice(letters + "z") for _ in range(rng.choice([0, 1, 2, 5, 30, 200]))) for _ in range(20)] + [None, ""]
        longest = max(map(len, pieces))
        assert segment(texts, pieces, longest) == [None if t is None else viterbi(t, pieces, longest) for t in texts]


def test_viterbi_is_optimal():
    rng = random.Random(2)
    for _ in range(60):
        pieces = {"".join(rng.choice("ab") for _ in range(rng.randint(1, 3))): -rng.random() * 5 for _ in range(5)}
        text = "".join(rng.choice("abc") for _ in range(rng.randint(1, 8)))
        (got,) = segment([text], pieces, 3)
        assert "".join(got) == text
        cost = lambda ps: sum(-pieces[p] if p in pieces else 20.0 for p in ps)  # noqa: B023, E731
        best = math.inf
        for cuts in itertools.product([0, 1], repeat=len(text) - 1):
            ps, start = [], 0
            for i, c in enumerate(cuts, 1):
                if c:
                    ps.append(text[start:i])
                    start = i
            ps.append(text[start:])
            if all(p in pieces or len(p) == 1 for p in ps):
                best = min(best, cost(ps))
        assert cost(got) <= best + 1e-9


def test_ngram_counts_equal_a_plain_count():
    texts = ["▁abab▁ab", "x", "", "▁ab😀ab"]
    got = Counter()
    for piece, n in unigram.count_ngrams(texts, 3, block=6):
        got.update(dict(zip(piece.to_pylist(), n.to_pylist(), strict=True)))
    want = Counter(t[i : i + k] for t in texts for k in (2, 3) for i in range(len(t) - k + 1))
    assert got == want


@pytest.mark.parametrize("room", [1, 5, 30, 10_000])
def test_best_ngrams_equal_an_ordering_of_all(spark, room):
    rng = random.Random(4)
    rows = spark.createDataFrame([("▁" + "".join(rng.choice("abé") for _ in range(30)),) for _ in range(40)], "norm string")
    every = unigram.ngram_counts(rows, 4)
    want = every.orderBy(F.desc("n"), F.octet_length("piece").desc(), "piece").limit(room).collect()
    total, best = unigram.best_ngrams(rows, 4, room)
    assert total == every.agg(F.sum("n")).first()[0] and best == [(r.piece, r.n) for r in want]


def test_model_and_round_trip(spark):
    docs = spark.createDataFrame([(0, "Hello myWorld hello"), (1, ""), (2, None), (3, "hello zz")], "doc_id long, text string")
    cfg = SpConfig(target_vocab=30, max_piece_chars=4)
    model = unigram.train(docs, cfg)
    rows = model.orderBy("id").collect()
    assert (rows[0].piece, rows[0].log_prob) == ("<unk>", -20.0)
    seeds = [r for r in rows[1:] if len(r.piece) == 1]
    assert [(-r.n, r.piece) for r in seeds] == sorted((-r.n, r.piece) for r in seeds)
    out = unigram.encode(docs, model, cfg)
    text = {r.doc_id: r.t for r in out.select("doc_id", unigram.decode_pieces(F.col("pieces")).alias("t")).collect()}
    assert text == {0: "hello my world hello", 1: "", 2: None, 3: "hello zz"}
    unseen = unigram.encode(spark.createDataFrame([(0, "qé")], "doc_id long, text string"), model, cfg).first()
    assert unseen.ids[-1] == 0 and unseen.pieces[-1] == "é"
    assert unigram.decode_ids(spark.createDataFrame([(0, [0, 10_000])], "doc_id long, ids array<int>"), model).first().decoded == "<unk><unk>"


def test_display(spark):
    rows = [(0, ["▁he", "llo", "▁", "w", "▁my", "▁"]), (1, ["un", "##do"]), (2, ["a▁b", "c"]), (3, [])]
    df = spark.createDataFrame(rows, "i long, p array<string>")
    got = [r.x for r in df.orderBy("i").select(unigram.display_pieces(df.p).alias("x")).collect()]
    assert got == [["hello", "w", "my"], ["un", "##do"], ["abc"], []]


def test_queries_run_the_application_settings(spark):
    from tokenloom import queries
    from tokenloom.plans.config import APP_SP

    _, model, cfg = queries._sp(spark, "/root/testdata/sf0.001")
    assert cfg == APP_SP
    assert model.where("length(piece) > 5 and piece <> '<unk>'").count() and 1000 < model.count() <= 2000
