import numpy as np
import pytest

from tokenloom.llm import mojibake
from tokenloom.llm.mojibake import repair, repairs, undo_utf8

TEXTS = [
    "La élève que Marie a quitté était plus étrange que la règle, où l’on a traversé un musée fragile.",
    "Die Bücher, die Jürgen gewünscht hat, waren für München wichtiger als jede größere Übung.",
    "¿Por qué encontró José la niña después de la reunión, si la canción ya no era última?",
    "Não é só a família: a informação de João mudou a lição rápida, até amanhã.",
    "Через двенадцать лет погода показала то, что раньше открыла только добрая мечта.",
    "Według Łukasza aż sto osób widziało, jak świetna mysł zmieniła też inną książkę.",
    "“The coin is dusty,” said Mia — “and don’t…”",
]


@pytest.fixture(scope="module")
def model():
    counts = np.zeros((256, 256))
    for t in TEXTS * 40:
        ids = mojibake.letter_classes()[np.frombuffer((" " + t + " ").encode("utf-32-le"), np.uint32)]
        np.add.at(counts, (ids[:-1], ids[1:]), 1)
    return mojibake.to_model(counts)


def misread(text, codec):
    """UTF-8 bytes read as a legacy encoding, undefined bytes as control characters."""
    chars = mojibake.byte_chars(codec)
    return "".join(chr(b) if b < 0x80 else chars[b - 0x80] for b in text.encode())


@pytest.mark.parametrize("codec", mojibake.LEGACY)
@pytest.mark.parametrize("text", TEXTS)
def test_utf8_misread_is_restored(text, codec, model):
    """Two of the many are also well-formed in an alike encoding or letters that could stand there: there one letter may be left."""
    restored = undo_utf8(misread(text, codec), model)
    assert restored == text or codec in ("iso8859_2", "iso8859_5") and sum(c not in restored for c in text) <= 2


@pytest.mark.parametrize("text", TEXTS)
def test_misread_twice(text):
    assert undo_utf8(misread(misread(text, "cp1252"), "cp1252")) == text


def test_only_the_damaged_part_changes():
    assert undo_utf8("café and cafÃ© — “ok”") == "café and café — “ok”"


@pytest.mark.parametrize("text", [*TEXTS, "NÃO É SÓ A AÇÃO", "É»", "СССР» и «ЕЁ»", "ŻÓŁTA ZAMKNĘŁA", "Ñandú PIÑATA", "Σωκράτης", "日本語", "m³ ± 5 °C", "« Été »…", "tНIS wаѕ sеen", "x à y"])
def test_correct_text_is_left_alone(text, model):
    assert repair(text, model)[:2] == (False, text)


@pytest.mark.parametrize(("written", "read", "n"), [("cp1251", "latin_1", 4), ("koi8_r", "cp1251", 4), ("cp866", "cp1251", 4), ("iso8859_2", "latin_1", 5), ("latin_1", "mac_roman", 2), ("latin_1", "mac_roman", 3)])
def test_one_legacy_encoding_read_as_another(written, read, n, model):
    text = TEXTS[n]
    damaged = "".join(chr(b) if b < 0x80 else mojibake.byte_chars(read)[b - 0x80] for b in text.encode(written))
    hit, now, complete = repair(damaged, model)
    assert repairs(["", damaged, "x"], model) == [(1, now, complete)]
    assert hit and complete and sum(a != b for a, b in zip(now, text, strict=True)) <= 2


def test_lost_characters_are_found(model):
    assert repair("Voil� pourquoi", model) == (True, "Voil� pourquoi", False)


def confused(text, written, read):
    """Text written in one one-byte encoding and read as another; what the first lacks is left out."""
    return "".join(chr(b) if b < 0x80 else mojibake.byte_chars(read)[b - 0x80] for b in text.encode(written, "ignore"))


@pytest.mark.parametrize(("written", "read", "n"), [("latin_1", "cp1251", 1), ("latin_1", "cp1251", 2), ("latin_1", "cp1251", 3), ("cp1252", "cp1251", 0), ("cp1250", "cp1251", 5), ("cp1252", "cp1250", 0), ("cp1252", "iso8859_2", 3)])
def test_western_text_with_isolated_letters(written, read, n, model):
    damaged = confused(TEXTS[n], written, read)
    hit, now, complete = repair(damaged, model)
    assert repairs(["", damaged, "x"], model) == [(1, now, complete)]
    assert hit and complete and sum(a != b for a, b in zip(now, TEXTS[n], strict=True)) <= 2


def test_sentence_with_look_alikes_only_is_restored_with_the_rest(model):
    damaged = confused("La niña encontró la canción. " + TEXTS[2], "latin_1", "cp1251")
    assert repair(damaged, model)[1].startswith("La niña encontró la canción. ")
    assert not repair("Тhе саt sаt оn thе mаt аnd аtе а сakе. " * 5, model)[0]


@pytest.mark.parametrize("codec", mojibake.LEGACY)
def test_batches_find_what_single_texts_find(codec, model):
    parts = [x for t in TEXTS for x in (t, misread(t, codec), "", misread(t.split()[1], codec), "\n" + t + "\n")]
    single = [(i, r[1], r[2]) for i, r in enumerate(repair(t, model) for t in parts) if r[0]]
    assert repairs(parts, model) == single
    assert np.flatnonzero(mojibake.damaged(parts, model)).tolist() == [i for i, _, _ in single]


@pytest.mark.parametrize(("written", "read"), mojibake.CONFUSED)
def test_batches_find_confused_encodings(written, read, model):
    parts = [confused(t, written, read) for t in TEXTS + [w + " " + w for t in TEXTS for w in t.split()]]
    single = [(i, r[1], r[2]) for i, r in enumerate(repair(t, model) for t in parts) if r[0]]
    assert repairs(parts, model) == single
    assert np.flatnonzero(mojibake.damaged(parts, model)).tolist() == [i for i, _, _ in single]


def test_records(spark):
    essays = spark.createDataFrame(
        [(1, TEXTS[0], 0), (2, misread(TEXTS[0], "cp1252"), 0), (2, misread(TEXTS[0], "cp1252"), 0), (3, None, 0), (4, "", 0), (None, misread(TEXTS[0], "cp1252"), 0), (5, "y" * 100_000 + "Ã©", 0)],
        "essay_id long, text string, id int",
    )
    results = spark.createDataFrame(
        [(1, "bpe", ["caf", "##Ã", "©", None]), (2, "sentencepiece", ["▁caf", "é"]), (3, "sentencepiece", ["▁d", "├", "®", "j", "├", "á"]), (4, "bpe", []), (5, "bpe", None), (6, "bpe", ["voil", "├", "á", "pour"])],
        "result_id long, tok_mode string, pieces array<string>",
    )
    got = {(r.record_set, r.record_id): r for r in mojibake.damaged_records(essays, results).collect()}
    assert set(got) == {("essay", 2), ("essay", 5), ("result", 1), ("result", 3), ("result", 6)}
    assert got["essay", 2].restored == TEXTS[0] and got["result", 3].restored.strip() == "déjà"
    assert mojibake.damaged_records(essays.limit(0), results.limit(0)).count() == 0


def test_restoration(spark):
    rows = [(i, TEXTS[i % 6], 0) for i in range(600)] + [(None, TEXTS[0], 0), (700, None, 0), (701, "", 0)]
    got = mojibake.restoration(spark.createDataFrame(rows, "essay_id long, text string, pair int")).collect()
    byte = [r for r in got if r.written == "utf_8"]
    assert len(byte) == len(mojibake.LEGACY) and sum(r.found for r in byte) == sum(r.texts for r in byte)
    assert sum(r.restored for r in byte) >= 0.95 * sum(r.texts for r in byte)
    assert mojibake.restoration(spark.createDataFrame([], "essay_id long, text string")).count() == 0
