import random
import string
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tokenloom.llm import kernel, leakage, packing, quality, sharedspans, termstats


def rand_text(rng, n):
    return "".join(rng.choice(string.ascii_lowercase + " é") for _ in range(n))


# --- kernel ---------------------------------------------------------------


def test_window_min():
    rng = np.random.default_rng(0)
    for n, w in ((10, 3), (7, 7), (5, 6), (100, 1), (64, 8)):
        x = rng.integers(0, 50, n).astype(np.uint64)
        want = [x[i : i + w].min() for i in range(n - w + 1)]
        assert kernel.window_min(x, w).tolist() == want


def test_words_and_hashes():
    w = kernel.Words(["a1 b-c", "", "日本 b"])
    assert np.diff(w.first).tolist() == [3, 0, 2] and w.hash[1] == w.hash[4] and len(set(w.hash.tolist())) == 4
    h1, _, n = kernel.letters_hash(["a b!", "ab", "", "ba"])
    assert h1[0] == h1[1] != h1[3] and n.tolist() == [2, 2, 0, 2]
    big = kernel.blocks(["x" * 600_000, "y" * 600_000, "z"])
    assert list(big) == [(0, 2), (2, 3)]


# --- quality --------------------------------------------------------------

PROSE = "The house was old and the garden had not been touched, so we sat there in the sun."


COMMON = kernel.Words(["the was and had not been so we in a it as were on to is"]).hash
COMMON.sort()
OTHERS = [
    "Die alte Bücherei war kalt, doch wir saßen lange dort und sprachen über jeden neuen Roman, den Ayşe gelesen hatte.",
    "Después de comer fuimos a la plaza y hablamos con todos los vecinos, porque hacía sol y nadie quería volver.",
    "Nous avons visité le musée avant midi, puis nous avons marché jusqu’au port en parlant de ses vieux bateaux.",
    "Ben de evde kaldım, çünkü dışarıda yağmur yağıyordu; sonra uzun bir mektup yazdım ve erken uyudum.",
    "Bu kitap çok güzel ama biraz uzun; yüzlerce sayfa boyunca hep aynı evin bahçesi anlatılıyor, orada oturan insanlar konuşuyor.",
]
TURKISH = "Evin bahçesi çok eskiydi, bu yüzden orada güneşte oturduk ve uzun süre konuştuk."


def test_statistics():
    s = quality.statistics(["- One two.\n- three 44\n\nend!", ""], COMMON)
    assert s["n_words"].tolist() == [5, 0]
    assert s["mean_word_length"][0] == pytest.approx(16 / 5) and s["letter_words"][0] == pytest.approx(0.8)
    assert s["lines_ending_in_punctuation"][0] == pytest.approx(2 / 3) and s["bullet_lines"][0] == pytest.approx(2 / 3)
    assert all(v[1] == 0 for v in s.values())


def test_quality(spark):
    kinds = [
        (PROSE, True), (PROSE.upper().replace(",", ""), True), ("\n".join(f"{i}. apple pear" for i in range(9)), False), ("a1 | b2 | c3\n" * 9, False), ("x", True), ("", True),
        ("�� ��� " * 20, True), ("o kettle pan\n" * 8, False), (TURKISH, True), ("xqzj kvvw qqpt zzkx wjqf " * 5, False), ("pots pans lamps\nforks spoons\nknives plates trays\n", False),
    ]
    rows = [(i, t, "en", 0) for i, (t, _) in enumerate(kinds)] + [(500, None, "en", 0), (None, PROSE, "en", 0), (0, PROSE, "en", 0)]
    rows += [(100 + i, PROSE.replace("garden", f"garden{i}"), "en", 0) for i in range(60)]
    rows += [(200 + i, t, None, 0) for i, t in enumerate(OTHERS)]
    out = {r.id: r for r in quality.quality(spark.createDataFrame(rows, "essay_id long, text string, lang string, prose int")).collect()}
    assert {i: out[i].prose for i in range(len(kinds))} == {i: p for i, (_, p) in enumerate(kinds)}
    assert "bullet_lines" in out[2].reasons and "mean_word_length" in out[3].reasons and out[9].reasons.startswith("common_words, lines_ending_in_punctuation")
    # A language without texts to know its words by fails one of three rules only.
    assert out[8].reasons == "common_words" and out[1].reasons is None
    assert set(out) == set(range(len(kinds))) | set(range(100, 160)) | set(range(200, 200 + len(OTHERS))) and out[5].n_words == 0
    assert quality.quality(spark.createDataFrame([], "essay_id long, text string")).count() == 0
    assert quality.quality(spark.createDataFrame(rows[:3], "essay_id long, text string, lang string, prose int")).where("prose").count() == 2
    assert quality.plain_statistics(spark.createDataFrame([(1, PROSE, 0), (1, PROSE, 0), (2, None, 0), (3, "", 0)], "doc_id long, text string, id int")).count() == 2


# --- term statistics ------------------------------------------------------


def test_term_counts(spark):
    rng = random.Random(3)
    rows = [(i, [rng.choice(["a", "b", "hot", "", "z" * 300]) if rng.random() < 0.6 else "hot" for _ in range(rng.randint(0, 6))], rng.choice([None, 0, -1, 1, 7]), "x") for i in range(300)]
    rows += rows[:40] + [(None, ["a"], 5, "x"), (900, None, 5, "x"), (901, [None], 5, "x"), (902, ["once", None], 1, "x")]
    df = spark.createDataFrame(rows, "ws_id long, symbols array<string>, freq long, term string")
    occurrences, records, counted = defaultdict(int), defaultdict(set), set()
    for i, symbols, freq, _ in {r[0]: r for r in rows if r[0] is not None}.values():
        kept = [s for s in symbols or [] if s is not None]
        if freq and freq > 0 and kept:
            counted.add(i)
            for s in kept:
                occurrences[s] += freq
                records[s].add(i)
    want = {s: (n, len(records[s]), "rare" if n < 10 else "common" if len(records[s]) > 0.05 * len(counted) else None) for s, n in occurrences.items()}
    got = {r.term: (r.occurrences, r.records, r.mark) for r in termstats.term_counts(df).collect()}
    assert got == want
    assert termstats.term_counts(df.limit(0)).count() == 0


# --- packing --------------------------------------------------------------


@pytest.mark.parametrize("seed", range(12))
def test_plan_is_a_packing(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 97, 512])
    histogram = {rng.randint(1, capacity): rng.choice([1, 2, 3, 50]) for _ in range(rng.randint(1, 60))}
    slots, windows = packing.plan(histogram, capacity)
    fill, placed, large = [0] * windows, defaultdict(int), [0] * windows
    for size, rank, n, first, per in slots:
        assert rank == placed[size]
        placed[size] += n
        for i in range(n):
            fill[first + i // per] += size
            large[first + i // per] += 3 * size > capacity
    assert dict(placed) == histogram and max(fill) <= capacity and min(fill) > 0 and max(large) <= 2
    total = sum(s * n for s, n in histogram.items())
    big = sum(n for s, n in histogram.items() if 2 * s > capacity)
    assert windows <= max(-(-total // capacity), big) * 1.35 + 1


@pytest.mark.parametrize("rows", [500_000, 2])
def test_packed(spark, monkeypatch, rows):
    """Also with far more parts than rows of a size."""
    monkeypatch.setattr(packing, "ROWS_PER_PART", rows)
    monkeypatch.setattr(packing, "BROADCAST_SLOTS", rows)
    rng = random.Random(4)
    docs = [(i, "x" * rng.randint(0, 250), None if i % 2 else rng.randint(1, 260), "w") for i in range(400)]
    docs += docs[:20] + [(900, None, None, "w"), (None, "abc", 4, "w"), (901, "é" * 60, None, "w")]
    df = spark.createDataFrame(docs, "doc_id long, text string, n_tokens int, window_key string")
    windows = spark.createDataFrame([("s", 64), ("l", 100), ("none", 0)], "window_key string, capacity int")
    sizes = {i: n if n is not None else len(t.encode()) + 1 for i, t, n, _ in docs if i is not None and t is not None}
    for key, capacity in (("s", 64), ("l", 100)):
        rows = packing.packed(df, windows).where(F.col("window_key") == key).collect()
        fill, got = defaultdict(int), defaultdict(int)
        for r in rows:
            fill[r.window_id] += r.tokens
            got[r.doc_id] += r.tokens
        assert dict(got) == sizes and max(fill.values()) <= capacity
        assert sorted(fill) == list(range(len(fill)))
        pieces = defaultdict(list)
        for r in rows:
            pieces[r.doc_id].append(r.piece)
        assert all(sorted(p) == list(range(-(-sizes[d] // capacity))) for d, p in pieces.items())
    split = {tuple(r) for r in packing.split_documents(df, windows).collect()}
    assert split == {(k, d) for k, c in (("s", 64), ("l", 100)) for d, s in sizes.items() if s > c}
    assert packing.packed(df.limit(0), windows).count() == 0 and packing.packed(df, windows.limit(0)).count() == 0


# --- leakage --------------------------------------------------------------


def test_leaks_equal_brute_force(spark):
    rng = random.Random(6)
    words = ["the", "a", "of"] * 6 + [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(8, 40)))) for i in range(60)] + [(100, None), (101, ""), (0, None)]
    docs = []
    for i in range(150):
        t = [rng.choice(words) for _ in range(rng.randint(0, 120))]
        if rng.random() < 0.5:
            source = rng.choice(items[:60])[1].split()
            n = rng.choice([11, 12, 13, 20])
            at = rng.randrange(max(1, len(source) - n + 1))
            k = rng.randrange(len(t) + 1)
            t[k:k] = [w.upper() for w in source[at : at + n]]
        docs.append((i, rng.choice([" ", ", ", "\n-"]).join(t), "x"))
    docs += docs[:10] + [(None, items[0][1], "x"), (999, None, "x")]
    want = set()
    for q, item in items:
        w = (item or "").split()
        runs = {tuple(w[i : i + 12]) for i in range(len(w) - 11)}
        for d, text, _ in docs:
            t = [x.strip("-,").lower() for x in (text or "").split()]
            if d is not None and any(tuple(t[i : i + 12]) in runs for i in range(len(t) - 11)):
                want.add((q, d))
    df = spark.createDataFrame(docs, "doc_id long, text string, item_id string")
    held = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.item_id, r.doc_id) for r in leakage.leaks(df, held).collect()}
    assert got == want and len(want) > 20
    assert {(r.item_id, r.doc_id) for r in leakage.leaks(df, held, slice_chars=2000).collect()} == want
    assert leakage.leaks(df.limit(0), held).count() == 0 and leakage.leaks(df, held.limit(0)).count() == 0


def test_wand_retrieves_all_that_reach_the_threshold_and_skips_the_rest():
    rng = random.Random(2)
    words = [f"w{i}" for i in range(300)] + ["the", "of"] * 20
    texts = [" ".join(rng.choice(words) for _ in range(30)) for _ in range(400)]
    index = leakage.build(list(range(400)), texts)
    n = len(index.ids)
    dense = np.zeros((len(index.vocab), n))
    dense[index.postings // n, index.postings % n] = index.impact
    terms = np.full((200, 12), -1)
    for row in terms:
        own = np.flatnonzero(dense[:, rng.randrange(n)])
        some = rng.sample(own.tolist(), min(len(own), rng.choice([3, 6, 10])))
        row[: len(some)] = some
    score = np.array([dense[row[row >= 0]].sum(0) for row in terms])
    row, item, work = leakage.retrieve(terms, index)
    assert set(zip(row.tolist(), item.tolist(), strict=True)) == set(zip(*(x.tolist() for x in np.nonzero(score >= leakage._REACHED)), strict=True)) and len(row)
    # Far fewer items are scored than share a term with a passage.
    assert work["skipped"] > 0 and work["scored"] < 0.2 * (score > 0).sum()


# --- shared spans ---------------------------------------------------------


@pytest.mark.parametrize("hot", [200, 1])
def test_shared_spans_equal_brute_force(spark, hot):
    rng = random.Random(8)
    blocks = [rand_text(rng, n) for n in (30, 59, 60, 61, 90, 200)]
    docs = []
    for i in range(60):
        t = rand_text(rng, rng.randint(0, 200))
        for _ in range(rng.choice([0, 1, 2])):
            k = rng.randrange(len(t) + 1)
            t = t[:k] + rng.choice(blocks) + t[k:]
        docs.append((i, t))
    docs += [(70, "z" * 500), (71, "z" * 80), (72, blocks[5]), (73, None), (74, ""), (75, blocks[5])]
    held = defaultdict(set)
    for i, t in docs:
        for k in range(len(t or "") - 59):
            held[t[k : k + 60]].add(i)
    pairs = {(a, b) for ids in held.values() for a in ids for b in ids if a < b}
    df = spark.createDataFrame([(i, t, 1) for i, t in docs] + [(5, docs[5][1], 1), (None, blocks[5], 1)], "doc_id long, text string, id int")
    how = {"least": 60, "gram": 20, "hot": hot}
    assert {tuple(r) for r in sharedspans.sharing_pairs(df, **how).collect()} == pairs and pairs
    covered = {}
    for i, t in docs:
        if t is not None:
            mark = [False] * len(t)
            for k in range(len(t) - 59):
                if len(held[t[k : k + 60]]) > 1:
                    mark[k : k + 60] = [True] * 60
            covered[i] = sum(mark)
    assert {r.id: r.shared_chars for r in sharedspans.shared_part(df, **how).collect()} == covered
    texts = dict(docs)
    repeats = {tuple(r) for r in sharedspans.maximal_repeats(df, **how).collect()}
    for a, b, i, j, n in repeats:
        x, y = texts[a], texts[b]
        if a == 70:  # one letter only: its anchors are hot whatever the limit
            continue
        assert n >= 60 and x[i : i + n] == y[j : j + n] and (hot == 1 or i == 0 or j == 0 or x[i - 1] != y[j - 1])
        assert hot == 1 or i + n == len(x) or j + n == len(y) or x[i + n] != y[j + n]
    if hot > 1:
        assert {r[:2] for r in repeats} == pairs
    else:
        assert {i for r in repeats for i in r[:2]} == {i for p in pairs for i in p}
    assert sharedspans.sharing_pairs(df.limit(0)).count() == 0
    # Of two texts of one key one counts, and they share nothing with each other.
    twice = spark.createDataFrame([(1, blocks[5]), (1, blocks[5] + "x" * 99)], "doc_id long, text string")
    assert sharedspans.sharing_pairs(twice, **how).count() == 0 and sharedspans.maximal_repeats(twice, **how).count() == 0


def test_lists_fail_by_their_bullets_even_with_lost_characters():
    prose = "the teacher was in the house and it was not so strange as the people had thought"
    rows = ["\n".join(f"{mark} {prose} {i}" for i in range(6)) for mark in ("-", "•", "—", "–")]
    rows += [rows[1].replace("house", "h��se"), "- " + prose, rows[2].replace("house", "h��se")]
    stats = quality.statistics(rows, COMMON)
    prose, _ = quality.judge(stats, np.array([len(t) for t in rows]))
    assert stats["lost_chars"][4] >= quality.LOST
    assert prose.tolist() == [False, False, True, True, False, True, True]
