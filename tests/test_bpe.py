import random

import pytest

from tokenloom.operators import bpe
from tokenloom.plans.config import BpeConfig
from tokenloom.sources import models


def corpus(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_hand_vector(spark):
    docs = corpus(spark, "aaa aaa")
    types = bpe.word_types(bpe.training_words(docs))
    counts = {(r.l, r.r): r.n for r in bpe.pair_counts(bpe.seed_symbols(types)).collect()}
    assert counts == {("a", "a"): 2, ("a", "</w>"): 1}
    vocab = bpe.train(docs)
    model = [r.token for r in bpe.id_map(vocab).orderBy("id").collect()]
    assert model[:6] == ["<unk>", "aa", "##aa", "a", "##a", "."] and len(model) == 25
    assert bpe.encode(corpus(spark, "aaaa"), [r.subword for r in vocab.collect()], bpe.id_map(vocab)).first().ids == [1, 2]


def naive(words, weights, ops):
    """Recount everything at each step."""
    for _ in range(ops):
        counts = {}
        for w, k in zip(words, weights, strict=True):
            for p in zip(w, w[1:], strict=False):
                counts[p] = counts.get(p, 0) + k
        best = min(counts, key=lambda p: (-counts[p], p), default=None)
        if best is None or counts[best] < 2:
            return
        for i, w in enumerate(words):
            out = []
            for s in w:
                if out and out[-1] == best[0] and s == best[1] and not isinstance(out[-1], Joined):
                    out[-1] = Joined(best[0] + best[1])
                else:
                    out.append(s)
            words[i] = [str(s) for s in out]


class Joined(str):
    __str__ = str.__str__


@pytest.mark.parametrize("seed", range(8))
def test_incremental_equals_recount(seed):
    rng = random.Random(seed)
    words = [[*(rng.choice("abc") for _ in range(rng.randint(1, 9))), bpe.END] for _ in range(40)]
    weights = [rng.randint(1, 5) for _ in words]
    fast, slow = [list(w) for w in words], [list(w) for w in words]
    bpe.learn(fast, weights, 12)
    naive(slow, weights, 12)
    assert fast == slow


def test_native_merge_step(spark):
    rows = spark.createDataFrame([("aaaaa", 1, [*"aaaaa", bpe.END])], "word string, freq long, symbols array<string>")
    assert bpe.merge_pair(rows, "a", "a").first().symbols == ["aa", "aa", "a", bpe.END]


def greedy(word, vocab):
    out, at = [], 0
    while at < len(word):
        n = next((n for n in range(len(word) - at, 0, -1) if word[at : at + n] in vocab), 1)
        out.append(("##" if out else "") + word[at : at + n])
        at += n
    return out


def test_longest_match_equals_greedy_loop(spark):
    rng = random.Random(1)
    vocab = {"".join(rng.choice("ab.*é") for _ in range(rng.randint(1, 5))) for _ in range(60)}
    words = ["".join(rng.choice("ab.*é😀") for _ in range(rng.randint(1, 14))) for _ in range(200)]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    got = [r.p for r in df.select(bpe.word_pieces(df.w, bpe.longest_match_pattern(sorted(vocab))).alias("p")).collect()]
    assert got == [greedy(w, vocab) for w in words]
    rows = [(i, words[i : i + i % 7]) for i in range(0, 200, 3)] + [(900, None), (901, [])]
    held = spark.createDataFrame(rows, "i long, t array<string>").repartition(2)
    got = {r.i: r.p for r in held.select("i", bpe.pieces_of_tokens(sorted(vocab))("t").alias("p")).collect()}
    assert got == {i: None if t is None else [p for w in t for p in greedy(w, vocab)] for i, t in rows}


def test_oov_by_first_appearance_and_unknown(spark):
    docs = corpus(spark, "b$a", "$é a", "", None)
    vocab = spark.createDataFrame([("a",)], "subword string")
    model = bpe.id_map(vocab)
    n = model.count()
    assert {r.token: r.id for r in bpe.oov_ids(docs, ["a"], model).collect()} == {"b": n, "$": n + 1, "é": n + 2}
    ids = {r.doc_id: r.ids for r in bpe.encode(docs, ["a"], model).collect()}
    assert ids == {0: [n, n + 1, 1], 1: [n + 1, n + 2, 1], 2: [], 3: None}
    plain = {r.doc_id: r.ids for r in bpe.encode(docs, ["a"], model, BpeConfig(preserve_unknown=False)).collect()}
    assert plain[0] == [0, 0, 1]


@pytest.mark.parametrize("split", [True, False])
@pytest.mark.parametrize("closed", [True, False])
def test_unseen_pieces_equal_those_of_the_tokens(spark, split, closed):
    rng = random.Random(5)
    docs = corpus(spark, *["".join(rng.choice("abxyé$. -A") for _ in range(rng.randint(0, 12))) for _ in range(60)], None)
    subwords, cfg = ["ab", "bab", "a", *("b" * closed)], BpeConfig(split_on_punctuation=split)
    model = bpe.id_map(spark.createDataFrame([(s,) for s in subwords], "subword string"))
    known, order = {r.token for r in model.collect()}, []
    for r in bpe.tokenize(docs, subwords, cfg).orderBy("doc_id").collect():
        order += [p for p in r.pieces or [] if p not in known and p not in order]
    got = {r.token: r.id for r in bpe.oov_ids(docs, subwords, model, cfg).collect()}
    assert got == {p: len(known) + i for i, p in enumerate(dict.fromkeys(order))}


def test_training_words_read_on_until_there_are_enough(spark):
    docs = corpus(spark, *[f"w{i} ," if i % 3 else "..." for i in range(400)])
    words = [r.word for r in bpe.training_words(docs, BpeConfig(word_limit=250)).orderBy("doc_id", "pos").collect()]
    assert words == [f"w{i}" for i in range(250) if i % 3]
    assert bpe.training_words(docs, BpeConfig(word_limit=390)).count() == 260


def test_decode(spark):
    rows = spark.createDataFrame([(0, ["it", "'", "s"]), (1, ["un", "##do", "!"]), (2, [])], "doc_id long, p array<string>")
    assert [r.x for r in rows.orderBy("doc_id").select(bpe.join_pieces(rows.p).alias("x")).collect()] == ["it' s", "undo!", ""]
    ids = spark.createDataFrame([(0, [0, 1, 99]), (1, None)], "doc_id long, ids array<int>")
    assert [r.decoded for r in bpe.decode(ids, [(0, "<unk>"), (1, "##a")]).orderBy("doc_id").collect()] == ["<unk>a <unk>", None]


def test_nothing_to_learn(spark):
    with pytest.raises(ValueError, match="no training words"):
        bpe.train(corpus(spark, "", " , ", None))


def test_binary_model(tmp_path, spark):
    data = models.to_bytes(["b", "aé"], "<unk>")
    assert data[:8] == b"NKS_BPE1" and models.from_bytes(data) == (["aé", "b"], "<unk>")
    for broken in (data[:-1], b"x" + data[1:], data[:10]):
        with pytest.raises(models.BrokenModel):
            models.from_bytes(broken)
    vocab = spark.createDataFrame([("b",), ("aé",)], "subword string")
    models.save_binary(vocab, str(tmp_path / "m"))
    assert sorted(r.subword for r in models.load_binary(spark, str(tmp_path / "m"))[0].collect()) == ["aé", "b"]


def test_word_limit_is_applied_to_rows_and_words(spark):
    docs = corpus(spark, "a b c", "d e", "f")
    words = [r.word for r in bpe.training_words(docs, BpeConfig(word_limit=2)).orderBy("doc_id", "pos").collect()]
    assert words == ["a", "b"]
