import itertools
import random

import numpy as np
import pytest

from tokenloom.llm import formatcopies, lookalike
from tokenloom.llm.lookalike import ScriptModel, form

MODEL = ScriptModel(np.ones((128, 128)))
LONG = "The quick brown fox jumps over the lazy dog and keeps running through green gardens. "
CYR = str.maketrans({row[0]: row[1] for row in lookalike.ALIKE if row[1] != "."})


def test_every_folded_character_is_noticed():
    assert all(lookalike._TO_FOLD.match(chr(c)) for c in lookalike._FOLD)


@pytest.mark.parametrize(
    ("a", "b"),
    [
        ("ｔｈｅ １２３，", "the 123,"),
        ("café", "café"),
        ("traﬃc", "traffic"),
        ("a b c　d", "a b c d"),
        ("w​o­r﻿d⁠", "word"),
        ("sеcrеt расе", "secret pace"),
        ("Ηοuse οf Κings", "House of Kings"),
        ("naïve іt", "naïve it"),
    ],
)
def test_same_looking_texts_become_equal(a, b):
    assert form(LONG + a, MODEL) == form(LONG + b, MODEL) == LONG + b


@pytest.mark.parametrize(("a", "b"), [("a b", "a  b"), ("a b", "a\nb"), ("'a'", "’a’"), ("a-b", "a–b"), ("...", "…"), ("A", "a"), ("m²", "m2"), ("é", "e")])
def test_what_looks_different_stays_different(a, b):
    assert form(LONG + a, MODEL) != form(LONG + b, MODEL)


@pytest.mark.parametrize(("a", "b"), [("hօuse", "house"), ("ᎢHE", "THE"), ("ⲟf", "of"), ("ꓔHE", "THE"), ("ıt", "it"), ("ѵery", "very"), ("woㅤrd", "word"), ("woᅠrd", "word")])
def test_letters_of_all_scripts(spark, a, b):
    model = ScriptModel(MODEL.counts, lookalike.confusable_letters(spark))
    assert form(LONG + a, model) == form(LONG + b, model) == LONG + b


def test_other_scripts_keep_their_words(spark):
    model = ScriptModel(MODEL.counts, lookalike.confusable_letters(spark))
    armenian = "Բարեւ ձեզ, ինչպես եք դուք այսօր, շատ լավ եմ, շնորհակալություն"
    assert form(armenian, model) == armenian
    assert form(armenian.replace("օ", "o").replace("ո", "n"), model) == armenian
    assert len(model.alike) > 150 and all(len(x) == 1 and x.isascii() for x in model.alike.values())


def test_one_different_string_among_many_equal_ones(spark):
    rows = [(i, LONG + ("sеcret" if i == 7 else "secret"), 0) for i in range(3000)]
    got = [tuple(r) for r in lookalike.same_looking_pairs(frame(spark, rows)).collect()]
    assert sorted(got) == sorted((min(i, 7), max(i, 7)) for i in range(3000) if i != 7)
    groups = lookalike.same_looking_groups(frame(spark, rows)).collect()
    assert len(groups) == 3000 and {(r.class_id, r.n_strings) for r in groups} == {(0, 2)}
    assert lookalike.same_looking_groups(frame(spark, rows).limit(0)).count() == 0


def test_batches_equal_single_texts():
    parts = [LONG + x for x in ("", "ｔｈｅ", "café", "cafe\u0301", "\u212bngstr\u00f6m \u2126", "“a” – b… it’s", "sеcret", "\u1100\u1161", "€ 5", "w\u00adord")]
    parts += ["", "a", "соса", "Когда ночь открыла эту дорогу", *parts, "é" * 30]
    assert lookalike.forms(parts, MODEL) == [form(t, MODEL) for t in parts]


def test_russian_stays_russian():
    text = "Когда ночь открыла эту дорогу, старая газета уже была там. Сосна и роса, нора, сор."
    assert form(text, MODEL) == text
    assert form(text.replace("о", "o").replace("а", "a").replace("С", "C"), MODEL) == text


@pytest.mark.parametrize("seed", range(30))
def test_result_depends_only_on_what_is_seen(seed):
    rng = random.Random(seed)
    base = LONG if seed % 2 else "Через двенадцать лет погода показала то, что раньше открыла. "
    base += rng.choice(["сосо a o", "Title: COP x", "мир world", ""])
    swapped = "".join(c.translate(CYR) if rng.random() < 0.5 else c for c in base)
    back = {row[1]: row[0] for row in lookalike.ALIKE if row[1] != "."}
    swapped = "".join(back.get(c, c) if rng.random() < 0.3 else c for c in swapped)
    model = ScriptModel(np.random.default_rng(seed).integers(0, 50, (128, 128)))
    assert form(swapped, model) == form(base, model)


@pytest.mark.parametrize("seed", range(10))
def test_quick_way_equals_the_search(seed):
    """A Latin text that is returned at once is also what the lattice search gives."""
    model = ScriptModel(np.random.default_rng(seed).integers(0, 50, (128, 128)))
    prior = tuple(round(2 * x) / 2 for x in (np.log(21 / 23), np.log(1 / 23), np.log(1 / 23)))
    for word in LONG.replace(".", "").split() + ["a", "coo", "XO", "COP", "hey"]:
        assert model.resolve(word, prior) == word


@pytest.mark.parametrize("seed", range(10))
def test_search_finds_the_best_path(seed):
    rng = random.Random(seed)
    model = ScriptModel(np.random.default_rng(seed).integers(0, 50, (128, 128)))
    prior = (-1.0, -0.5, -3.0)
    word = "".join(rng.choice("aceopx") for _ in range(5))

    def score(path):
        total, last = 0.0, None
        for s, c in path:
            if last is None or last[0] == s:
                total += model.log[lookalike._index_of(last[1]) if last else 0, lookalike._index_of(c)]
            else:
                total += lookalike._SWITCH
            total += lookalike._PRIOR_WEIGHT * prior[s]
            last = (s, c)
        return total

    paths = itertools.product(*(lookalike._ALTERNATIVES[c] for c in word))
    best = max(paths, key=score)
    got = model.resolve(word, prior)
    assert score([(lookalike._script(c), c) for c in got]) == pytest.approx(score(best))


ROWS = [
    (1, LONG + "secret", 0),
    (2, LONG + "sеcret", 0),
    (3, LONG + "ｓｅｃｒｅｔ", 0),
    (3, LONG + "ｓｅｃｒｅｔ", 0),
    (4, LONG + "secret", 0),
    (5, LONG.upper() + "SECRET!", 0),
    (6, "short", 0),
    (7, "shоrt", 0),
    (8, "", 0),
    (9, None, 0),
    (None, LONG, 0),
    (10, "Grade: 5\nTitle: Some Name\n\n" + LONG, 0),
    (11, "title: *some* name; grade: 5\n  \n" + LONG.lower().replace(" ", "\t "), 0),
    (12, "Title: Some Name | Grade: 5 |\n\n" + LONG, 0),
    (13, "Title: Other Name | Grade: 5\n\n" + LONG, 0),
    (14, "x" * 200_000 + LONG, 0),
]


def frame(spark, rows=ROWS):
    return spark.createDataFrame(rows, "essay_id long, text string, id int")


def test_pairs(spark):
    got = {tuple(r) for r in lookalike.same_looking_pairs(frame(spark)).collect()}
    assert got == {(1, 2), (1, 3), (2, 3), (2, 4), (3, 4)}
    assert lookalike.same_looking_pairs(frame(spark).limit(0)).count() == 0
    forms = {r.id: r.form for r in lookalike.with_form(frame(spark)).collect()}
    assert forms[2] == LONG + "secret" and forms[8] == "" and 9 not in forms and len(forms[14]) > 200_000


@pytest.mark.parametrize("rule", [{}, {"hot_least": 1}])
def test_copies_hot_and_cold(spark, rule):
    got = {tuple(r) for r in formatcopies.copy_pairs(frame(spark), **rule).collect()}
    assert got == {(1, 2), (1, 3), (1, 4), (1, 5), (10, 11), (10, 12)}
    counts = {r.keep_id: r.n_copies for r in formatcopies.copies(frame(spark), **rule).collect()}
    assert counts == {1: 5, 10: 3, 13: 1, 14: 1}
    assert formatcopies.copies(frame(spark).limit(0), **rule).count() == 0


def test_a_third_of_all_rows_in_one_group(spark):
    rows = [(i, LONG + (str(i) * 3 if i % 3 else ""), 0) for i in range(600)]
    groups = formatcopies.copies(frame(spark, rows), hot_least=10)
    assert sorted(r.n_copies for r in groups.collect())[-1] == 200
