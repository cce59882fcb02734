"""Problem 3: text that was decoded with the wrong character encoding.

Two kinds of damage are found and, where possible, undone:

* UTF-8 read as a one-byte encoding.  Characters are mapped back to their
  legacy bytes; an automaton over the structure of UTF-8 (a regular expression
  on the characters that stand for lead and continuation bytes) finds the
  maximal well-formed multibyte spans, and only those are decoded, again and
  again for text damaged twice.
* One one-byte encoding read as another.  There is no byte structure to see, so
  a letter-bigram model counted over the whole collection compares each
  sentence before and after the inverse mapping.

A replacement character marks damage that cannot be undone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import spread
from .lookalike import ALIKE

# Encodings text is commonly misread in, and pairs (written in, misread as).
LEGACY = ("cp1252", "latin_1", "cp1250", "cp1251", "cp437", "cp850", "mac_roman", "cp866", "koi8_r", "iso8859_2", "cp1254", "cp1257", "cp852", "cp1253", "cp1258", "mac_cyrillic", "iso8859_5")
CONFUSED = (
    ("cp1251", "latin_1"), ("cp1251", "cp1252"), ("koi8_r", "cp1251"), ("cp1251", "koi8_r"), ("cp866", "cp1251"), ("cp1251", "cp866"),
    ("koi8_r", "latin_1"), ("cp866", "cp1252"), ("iso8859_2", "latin_1"), ("iso8859_2", "cp1252"), ("cp1250", "cp1252"), ("cp1250", "latin_1"),
    ("latin_1", "mac_roman"), ("cp1252", "mac_roman"), ("mac_roman", "cp1252"), ("mac_roman", "latin_1"), ("cp850", "cp1252"), ("cp437", "cp1252"),
    ("cp850", "latin_1"), ("cp437", "latin_1"), ("latin_1", "cp437"), ("latin_1", "cp850"), ("latin_1", "cp1251"), ("cp1252", "cp1251"), ("cp1250", "cp1251"), ("cp1252", "cp1250"), ("cp1252", "iso8859_2"),
)
# Letters and signs a restored span may hold.
_LATIN_A = "ĀāĂăĄąĆćČčĎďĐđĒēĖėĘęĚěĞğĢģĪīĮįİıĶķĹĺĻļĽľŁłŃńŅņŇňŌōŐőŒœŔŕŘřŚśŞşŠšŢţŤťŪūŮůŰűŲųŸŹźŻżŽž"
_SIGNS = "ƒˆ˜–—‘’‚“”„†‡•…‰‹›€™№−\ufeff"
_FINE = frozenset(_LATIN_A + _SIGNS + "".join(map(chr, (*range(0x80, 0x100), *range(0x386, 0x3CF), *range(0x410, 0x450)))) + "ЁёЄєІіЇїҐґЎў")
_STRONG = frozenset("¿¡«»–—‘’“”„…€")
_QUIET = frozenset("’‘“”–—…«»¿¡ ­​‌‍⁠﻿•°§№€☐☑")


def byte_chars(codec: str) -> list[str]:
    """The character each byte 0x80-0xFF is read as; undefined bytes pass as control characters."""
    out = []
    for b in range(0x80, 0x100):
        try:
            out.append(bytes([b]).decode(codec))
        except UnicodeDecodeError:
            out.append(chr(b))
    return out


@lru_cache(1)
def _automata() -> list[tuple[re.Pattern, dict[str, int]]]:
    out = []
    for codec in LEGACY:
        chars = byte_chars(codec)
        some = lambda a, b: "[" + "".join(re.escape(chars[x - 0x80]) for x in range(a, b + 1)) + "]"  # noqa: B023, E731
        more = some(0x80, 0xBF)
        form = (
            f"{some(0xC2, 0xDF)}{more}|{some(0xE0, 0xE0)}{some(0xA0, 0xBF)}{more}|{some(0xED, 0xED)}{some(0x80, 0x9F)}{more}"
            f"|(?:{some(0xE1, 0xEC)}|{some(0xEE, 0xEF)}){more}{more}|{some(0xF0, 0xF0)}{some(0x90, 0xBF)}{more}{more}|{some(0xF1, 0xF3)}{more}{more}{more}"
        )
        out.append((re.compile(f"(?:{form})+"), {c: i + 0x80 for i, c in enumerate(chars)}))
    return out


def _script(c: str) -> str:
    if not c.isalpha():
        return ""
    p = ord(c)
    return "L" if p < 0x250 else "G" if 0x370 <= p < 0x400 else "C" if 0x400 <= p < 0x530 else "O"


def _believable(text: str, a: int, b: int, now: str) -> bool:
    """Whether decoding text[a:b] to ``now`` gives something a writer could have meant."""
    far = sum(c not in _FINE for c in now)
    if far:
        wide = all(c in _FINE or 0x2E80 <= ord(c) <= 0xD7A3 or 0x1F300 <= ord(c) <= 0x1FAFF for c in now)
        return wide and (len(now) > 1 or ord(now[0]) > 0x1F000) and not text[a:b].isalpha()
    before, after = text[a - 1 : a], text[b : b + 1]
    if len(now) == 1 and not now.isalpha() and now not in "’‘–­" and before.isalpha() and after.isalpha() and b - a < 3:
        return False
    first, last = _script(now[0]), _script(now[-1])
    if first and before and _script(before) not in ("", first) or last and after and _script(after) not in ("", last):
        return False
    if now[0].islower() and before.isupper() and text[a - 2 : a - 1].isupper():
        return False
    if text[a:b].isalpha() and _script(text[a]) != "L":
        # Letters that could stand there: a run, a case no writer uses, a rare letter or a Latin word around it must speak for the damage.
        span = text[a:b]
        mixed_case = any(x.islower() and y.isupper() for x, y in zip(span, span[1:], strict=False))
        rare = any(not 0x410 <= ord(c) < 0x450 for c in span)
        if len({_script(c) for c in span}) > 1 or now in _STRONG and any(_script(c) not in ("", _script(text[a])) for c in (before, after)):
            return True
        return len(now) > 2 or len(now) == 2 and (rare or mixed_case) or not first and mixed_case or first == "L" and "L" in (_script(before), _script(after))
    return True


def _codecs_with_spans(text: str) -> int:
    """Bits of the encodings in which the text has the beginning of a multibyte character."""
    lead2, lead3, lead4, more = _byte_tables()
    cp = np.frombuffer((text + "\n\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    at = np.flatnonzero(cp >= 0x80)
    pair = more[cp[at + 1]]
    return int(np.bitwise_or.reduce((lead2[cp[at]] & pair) | ((lead3[cp[at]] | lead4[cp[at]]) & pair & more[cp[at + 2]]))) if len(at) else 0


_FOREIGN = re.compile("[^\x00-\x7f]{2,}")


def undo_utf8(text: str, model: np.ndarray | None = None) -> str:
    """Decode the well-formed spans of the encoding that explains most characters; repeat for damage upon damage.

    Of encodings that explain equally much the likeliest text wins if there is
    a model, else the first.  Each pass shortens the text, so they end.
    """
    while True:
        mask = _codecs_with_spans(text)
        runs = [m.span() for m in _FOREIGN.finditer(text)] if mask else []
        # Encodings that decode the same spans to the same text are one; those that could explain most are looked at first.
        ways: dict[tuple, int] = {}
        for k, (automaton, to_byte) in enumerate(_automata()):
            if mask >> k & 1:
                spans = tuple((*m.span(), bytes([to_byte[c] for c in m[0]]).decode("utf-8")) for lo, hi in runs for m in automaton.finditer(text, lo, hi))
                if spans:
                    ways.setdefault(spans, sum(b - a for a, b, _ in spans))
        best, texts = 0, []
        for spans, most in sorted(ways.items(), key=lambda x: -x[1]):
            if most < best:
                break
            out, at, size = [], 0, 0
            for a, b, now in spans:
                if _believable(text, a, b, now):
                    out += text[at:a], now
                    at = b
                    size += b - a
            if size and size >= best:
                texts = [*(texts if size == best else []), "".join(out) + text[at:]]
                best = size
        if not texts:
            return text
        text = texts[0] if model is None or len(set(texts)) < 2 else max(texts, key=lambda t: likelihood(t, model))


def likelihood(text: str, model: np.ndarray) -> float:
    """Mean log probability of the text's letters."""
    ids = letter_classes()[np.frombuffer((" " + text + " ").encode("utf-32-le", "surrogatepass"), np.uint32)]
    return float(model[ids[:-1], ids[1:]].mean())


# --- letter bigrams -------------------------------------------------------

_ALPHABET = "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, (*range(0xDF, 0xF7), *range(0xF8, 0x100)))) + "".join(c for c in _LATIN_A if c.islower()) + "".join(map(chr, range(0x430, 0x460)))
_N = 256
_ODD = 255  # a sign that is neither a letter nor common beside letters


@lru_cache(1)
def letter_classes() -> np.ndarray:
    lut = np.zeros(0x110000, np.uint8)
    lut[0xA0:0x3000] = _ODD
    lut[0x80:0xA0] = _ODD
    for c in _QUIET:
        lut[ord(c)] = 0
    lut[0x250:0x2B0] = lut[0x300:0x400] = lut[0x460:0x2000] = 0
    for i, c in enumerate(_ALPHABET):
        lut[ord(c)] = i + 1
        if len(c.upper()) == 1:
            lut[ord(c.upper())] = i + 1
    return lut


def count_letters(texts: list[str]) -> np.ndarray:
    from .kernel import blocks, codes

    sums = np.zeros(_N * _N, np.int64)
    for lo, hi in blocks(texts):
        ids = letter_classes()[codes(texts[lo:hi])[0]]
        sums += np.bincount((ids[:-1].astype(np.uint16) << np.uint16(8)) + ids[1:], minlength=_N * _N)
    return sums


def bigram_model(df: DataFrame, text_col: str = "text") -> np.ndarray:
    """Log probability of each letter after each other one, counted over all texts (at most 65,536 sums reach the driver)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(_N * _N, np.int64)
        for batch in batches:
            sums += count_letters([t for t in batch.column(0).to_pylist() if t])
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[at])], names=["pair", "n"])

    rows = spread(df.select(F.col(text_col))).mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    return sums_to_model(dict(rows.collect()))


def sums_to_model(sums: dict[int, int]) -> np.ndarray:
    counts = np.zeros(_N * _N)
    for pair, n in sums.items():
        counts[pair] = n
    return to_model(counts.reshape(_N, _N))


def to_model(counts: np.ndarray) -> np.ndarray:
    """Log probabilities; odd signs beside letters are marked down, as damaged texts were counted too."""
    out = np.log((counts + 0.1) / (counts.sum(1, keepdims=True) + 0.1 * _N)).astype(np.float32)
    out[1:_ODD, _ODD] -= 5
    out[_ODD, 1:_ODD] -= 5
    return out


_TOP = 0x3000


@lru_cache(1)
def _inverse() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row 0 leaves text as it is, row k undoes CONFUSED[k - 1]; and the class of what comes out, and whether it is upper or lower case."""
    out = np.tile(np.arange(_TOP, dtype=np.uint32), (len(CONFUSED) + 1, 1))
    for k, (written, read) in enumerate(CONFUSED):
        for was, now in zip(byte_chars(read), byte_chars(written), strict=True):
            if ord(was) < _TOP:
                out[k + 1, ord(was)] = ord(now)
    chars = [chr(c) for c in range(0x10000)]
    return out, letter_classes()[out], np.array([c.isupper() for c in chars])[out], np.array([c.islower() for c in chars])[out]


_FROM_CYRILLIC = np.array([read in ("cp1251", "koi8_r", "cp866") for _, read in CONFUSED])
_ALIKE = np.isin(np.arange(_TOP), [ord(c) for row in ALIKE for c in row[1:] if c != "."])
_STOP = np.isin(np.arange(_TOP), [ord(c) for c in ".!?\n;|"])
GAIN_PER_PAIR, GAIN_IN_ALL, LEAST_PAIRS = 1.0, 14.0, 3
_WRONG_CASE, _LETTER_LOST = 6.0, 6.0


def _gains(cp: np.ndarray, model: np.ndarray) -> tuple[np.ndarray, ...]:
    """For each sentence with a non-ASCII character: its first such position, its number, and under each inverse mapping the gain, whether that is clear, and whether it counts as evidence."""
    pairs = np.flatnonzero((cp[1:] >= 0x80) | (cp[:-1] >= 0x80))
    tables, classes, upper, lower = _inverse()
    sentence = np.cumsum(_STOP[cp])
    first = np.flatnonzero(np.diff(sentence[pairs], prepend=-1))
    # Every different stretch of three characters is scored once.
    at = pairs.astype(np.int64)
    threes, inverse = np.unique((cp[at - 1].astype(np.int64) * _TOP + cp[at]) * _TOP + cp[at + 1], return_inverse=True)
    before, here, after = threes // (_TOP * _TOP), threes // _TOP % _TOP, threes % _TOP
    now, ids = tables[:, here], classes[:, here]
    score = model[ids, classes[:, after]].astype(np.float64)
    odd_case = (lower[:, before] & upper[:, here] & ~upper[:, after]) & (now >= 0x80)
    score -= _WRONG_CASE * odd_case
    control = (now >= 0x7F) & (now < 0xA0)
    score -= _WRONG_CASE * control
    letter = (ids > 0) & (ids < _ODD)
    score[1:] -= _LETTER_LOST * (letter[0] & ~letter[1:])
    # A sign no writer puts beside a letter must not appear where there was none.
    score[1:] -= 2 * _WRONG_CASE * ((ids[1:] == _ODD) & (ids[0] != _ODD))
    score = score[:, inverse]
    sums = np.add.reduceat(score, first, axis=1)
    n = np.diff(np.append(first, len(pairs)))
    gain = sums[1:] - sums[0]
    clear = gain > GAIN_PER_PAIR * n
    # Look-alike letters alone inside Latin words are no sign of a Cyrillic encoding.
    counts = clear.copy()
    at = pairs[first]
    counts[np.ix_(_FROM_CYRILLIC, _disguised(cp, sentence)[sentence[at]])] = False
    return at, sentence, gain, clear, counts


def confused(texts: list[str], model: np.ndarray) -> np.ndarray:
    """Which texts ``undo_confusion`` changes, all at once: no sentence reaches over the line feed between two texts."""
    from .kernel import blocks, codes

    out = np.zeros(len(texts), bool)
    for lo, hi in blocks(texts, 300_000):
        cp, start = codes(texts[lo:hi])
        if cp.max() < 0x80:
            continue
        cp = np.concatenate([[10], np.minimum(cp, _TOP - 1)]).astype(np.uint32)
        at, _, gain, _, counts = _gains(cp, model)
        doc = np.searchsorted(start, at, "right") - 1
        edge = np.flatnonzero(np.diff(doc, prepend=-1))
        total = np.add.reduceat(np.where(counts, gain, 0), edge, axis=1)
        odd = np.concatenate([[0], np.cumsum((cp[1:] >= 0x80) | (cp[:-1] >= 0x80))])
        enough = odd[np.minimum(start[doc[edge] + 1], len(odd) - 1)] - odd[start[doc[edge]]] >= LEAST_PAIRS
        out[lo + doc[edge]] = (total.max(0) > GAIN_IN_ALL) & enough
    return out


def undo_confusion(text: str, model: np.ndarray) -> str:
    """Undo a one-byte encoding read as another.

    Every sentence is scored as it stands and under each inverse mapping, over
    the bigrams with a non-ASCII character.  A mapping is accepted if the
    sentences it makes clearly more likely gain enough in all.
    """
    whole = np.frombuffer(("\n" + text + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    cp = np.minimum(whole, _TOP - 1)
    if np.count_nonzero((cp[1:] >= 0x80) | (cp[:-1] >= 0x80)) < LEAST_PAIRS:
        return text
    at, sentence, gain, clear, counts = _gains(cp, model)
    total = np.where(counts, gain, 0).sum(1)
    best = int(total.argmax())
    if total[best] <= GAIN_IN_ALL:
        return text
    take = np.isin(sentence, sentence[at][clear[best]])
    out = np.where(take & (whole < _TOP), _inverse()[0][best + 1][cp], whole)
    return out[1:-1].astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")


def _disguised(cp: np.ndarray, sentence: np.ndarray) -> np.ndarray:
    """Which sentences have words of ASCII and Cyrillic letters, all of the latter with a Latin look-alike."""
    size = int(sentence[-1]) + 1
    cyrillic = (cp >= 0x370) & (cp < 0x460)
    if not cyrillic.any():
        return np.zeros(size, bool)
    latin = (cp | 32 >= 0x61) & (cp | 32 <= 0x7A) & (cp < 0x80)
    word = np.cumsum(~(latin | cyrillic))
    mixed = cyrillic & (np.bincount(word[latin], minlength=word[-1] + 1) > 0)[word]
    count = lambda x: np.bincount(sentence[x], minlength=size) > 0
    return count(mixed) & ~count(mixed & ~_ALIKE[cp])


def structured(texts: list[str]) -> np.ndarray:
    """The texts with the beginning of a multibyte character of any encoding or a replacement character: all that ``undo_utf8`` can change or that are lost."""
    from .kernel import blocks, codes

    lead2, lead3, lead4, more = _byte_tables()
    out = np.zeros(len(texts), bool)
    for lo, hi in blocks(texts):
        cp, start = codes(texts[lo:hi])
        if cp.max() < 0x80:
            continue
        at = np.flatnonzero(cp[:-1] >= 0x80)
        a, b = cp[at], cp[at + 1]
        c = cp[np.minimum(at + 2, len(cp) - 1)]
        pair = more[b]
        hit = (lead2[a] & pair) | ((lead3[a] | lead4[a]) & pair & more[c]) > 0
        hit |= a == 0xFFFD
        out[lo + np.searchsorted(start, at[hit], "right") - 1] = True
    return out


@lru_cache(1)
def _byte_tables() -> tuple[np.ndarray, ...]:
    lead2, lead3, lead4, more = (np.zeros(0x110000, np.uint32) for _ in range(4))
    for k, codec in enumerate(LEGACY):
        for i, c in enumerate(byte_chars(codec)):
            b = i + 0x80
            for table, lo, hi in ((more, 0x80, 0xBF), (lead2, 0xC2, 0xDF), (lead3, 0xE0, 0xEF), (lead4, 0xF0, 0xF3)):
                if lo <= b <= hi:
                    table[ord(c)] |= 1 << k
    return lead2, lead3, lead4, more


def repair(text: str, model: np.ndarray) -> tuple[bool, str, bool]:
    """(damaged, text restored as far as possible, whether no known damage is left)."""
    now = _restored(text, undo_utf8(text, model), True, True, model)
    lost = "�" in now
    return now != text or lost, now, not lost


def _restored(text: str, decoded: str, confused_before: bool, confused_after: bool, model: np.ndarray) -> str:
    now = undo_confusion(decoded, model) if confused_after else decoded
    if decoded != text and confused_before:
        # What looks like multibyte spans may come from a one-byte encoding, too.
        other = undo_confusion(text, model)
        if other != text:
            now = max(now, undo_utf8(other, model), key=lambda t: likelihood(t, model))
    return now


def repairs(texts: list[str], model: np.ndarray) -> list[tuple[int, str, bool]]:
    """(index, restored, complete) of the damaged texts; only those that can be damaged are looked at one by one."""
    before, shaped = confused(texts, model), structured(texts)
    maybe = np.flatnonzero(before | shaped).tolist()
    decoded = [undo_utf8(texts[i], model) if shaped[i] else texts[i] for i in maybe]
    after = confused(decoded, model)
    out = []
    for i, d, c in zip(maybe, decoded, after.tolist(), strict=True):
        now = _restored(texts[i], d, bool(before[i]), c, model)
        lost = "�" in now
        if lost or now != texts[i]:
            out.append((i, now, not lost))
    return out


def damaged(texts: list[str], model: np.ndarray) -> np.ndarray:
    """Which texts are damaged, without restoring them."""
    out = confused(texts, model)
    for i in np.flatnonzero(structured(texts) & ~out):
        out[i] = "\ufffd" in texts[i] or _has_span(texts[i])
    return out


def _has_span(text: str) -> bool:
    mask = _codecs_with_spans(text)
    runs = [m.span() for m in _FOREIGN.finditer(text)] if mask else []
    for k, (automaton, to_byte) in enumerate(_automata()):
        if mask >> k & 1:
            for m in (m for lo, hi in runs for m in automaton.finditer(text, lo, hi)):
                if _believable(text, m.start(), m.end(), bytes(to_byte[c] for c in m[0]).decode("utf-8")):
                    return True
    return False


def repaired(df: DataFrame, id_col: str, text_col: str, model: np.ndarray) -> DataFrame:
    """(id, restored, complete) of the damaged records only.

    Null keys and texts take no part; empty texts are never damaged; a record
    that is repeated comes out once (of differing texts, the smallest).
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            found = repairs(texts, model)
            ids = b.column(0).take(pa.array([x[0] for x in found], pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array([x[1] for x in found], pa.string()), pa.array([x[2] for x in found], pa.bool_())], names=["id", "restored", "complete"])

    out = spread(rows).mapInArrow(run, "id long, restored string, complete boolean")
    return out.groupBy("id").agg(F.min(F.struct("restored", "complete")).alias("r")).select("id", "r.*")


def join_pieces(pieces: str = "pieces", mode: str = "tok_mode") -> F.Column:
    """The text of tokenizer pieces put together again; null pieces count as nothing.

    Pieces that begin a word are set off by a blank only where they begin with
    a letter or digit, so a damaged character spread over pieces comes together.
    """
    p = F.filter(F.col(pieces), lambda x: x.isNotNull())
    sp = F.translate(F.array_join(p, ""), "▁", " ")
    bpe = F.array_join(F.transform(p, lambda x: F.when(x.startswith("##"), F.substring(x, 3, 1 << 30)).when(x.rlike(r"^[\p{L}\p{N}]"), F.concat(F.lit(" "), x)).otherwise(x)), "")
    # A sign outside ASCII may be the first part of a damaged character whose next part looks like a word of its own.
    bpe = F.regexp_replace(bpe, r"([^\p{L}\p{N}\x00-\x7F]) (?=[^\x00-\x7F])", "$1")
    return F.when(F.col(mode) == "sentencepiece", sp).otherwise(bpe)


def damaged_records(essays: DataFrame, results: DataFrame) -> DataFrame:
    """(record_set, record_id, restored, complete) over essays and tokenization results."""
    model = bigram_model(essays)
    glued = results.select(F.col("result_id"), join_pieces().alias("text"))
    a = repaired(essays, "essay_id", "text", model).withColumn("record_set", F.lit("essay"))
    b = repaired(glued, "result_id", "text", model).withColumn("record_set", F.lit("result"))
    return a.unionByName(b).select("record_set", F.col("id").alias("record_id"), "restored", "complete")


def misread(text: str, written: str, read: str) -> str | None:
    """The text written in one encoding and read in another; None if the first lacks a character of it."""
    chars = byte_chars(read)
    try:
        return "".join(chr(b) if b < 0x80 else chars[b - 0x80] for b in text.encode(written))
    except UnicodeEncodeError:
        return None


def restoration(essays: DataFrame, id_col: str = "essay_id", text_col: str = "text") -> DataFrame:
    """(written, read, texts, found, restored): what repair makes of sound texts that are damaged on purpose.

    Every sound text with a non-ASCII character is written and read in one pair
    of encodings, chosen by its key; counted are the texts, those found, and
    those restored exactly.  Texts a pair cannot write or does not change take
    no part, nor do null keys and texts; an empty table gives no rows.
    """
    rows = essays.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")
    model = bigram_model(rows)
    pairs = [("utf_8", c) for c in LEGACY] + list(CONFUSED)
    which = F.pmod(F.xxhash64("id"), F.lit(len(pairs))).cast("int").alias("pair")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(pairs), 3), np.int64)
        for b in batches:
            texts = b.column(1).to_pylist()
            sick = {i for i, _, _ in repairs(texts, model)}
            made = [(k, t, misread(t, *pairs[k])) for i, (k, t) in enumerate(zip(b.column(0).to_pylist(), texts, strict=True)) if i not in sick and not t.isascii()]
            made = [x for x in made if x[2] is not None and x[2] != x[1]]
            back = {i: now for i, now, _ in repairs([x[2] for x in made], model)}
            for i, (k, t, _) in enumerate(made):
                sums[k] += (1, i in back, back.get(i) == t)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(pairs), dtype=np.int32)), *(pa.array(c) for c in sums.T)], names=["pair", "texts", "found", "restored"])

    counts = spread(rows.select(which, "text")).mapInArrow(run, "pair int, texts long, found long, restored long").groupBy("pair").agg(*(F.sum(c).alias(c) for c in ("texts", "found", "restored"))).where("texts > 0")
    name = lambda i: F.element_at(F.array(*[F.lit(x[i]) for x in pairs]), F.col("pair") + 1)
    return counts.select(name(0).alias("written"), name(1).alias("read"), "texts", "found", "restored")
