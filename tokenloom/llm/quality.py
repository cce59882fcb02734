"""Problem 6: per-document text statistics, and the documents that are not prose.

Nothing is taken from word lists: the words common in a language are those that
a fifth of its texts hold, and how letters follow each other is counted over
the whole collection, in one pass before the judging one.

A text is no prose if it fails one of the rules on its shape, or two of the
three rules that prose in unusual dress may fail one of.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import cut, spread
from .lookalike import ScriptModel, count_script, forms, to_script_model

# Fixed values of published quality rules for web text: mean word length 3 to 10, at most 0.1 symbols, 0.8 of the words
# with a letter and at most 0.9 bullet lines (MassiveText); at least 0.12 of the lines end in punctuation (FineWeb).
MEAN_WORD_LENGTH = (3.0, 10.0)
SYMBOL_RATIO = 0.1
LETTER_WORDS = 0.8
BULLET_LINES = 0.9
PUNCTUATED_LINES = 0.12
#: Two common words are asked for by the published rule; as share of all words and mean log probability of a letter after another.
COMMON_WORDS = 0.2
LIKELIHOOD = -4.0
#: A word is common in a language if this share of its texts holds it; a language is known by so many texts.
COMMON_SHARE = 0.2
LEAST_TEXTS = 20
#: From this share of replacement characters on, words cannot be known, and only the bullet rule is applied.
LOST = 0.02
MIN_CHARS = 40
SHAPE = ("letter_words", "mean_word_length", "symbol_ratio", "bullet_lines")
SOFT = ("common_words", "lines_ending_in_punctuation", "likelihood")

BULLET = r"(?m)^[^\S\n]*(?:[-*+>•·▪‣◦–—☐☑○●]|\(?\d{1,3}(?:[.)\]:]| -)|\(?[a-zA-Z][.)]|o|\[[ xX]?\])[^\S\n]+"
PLAIN = " .,;:!?'\"()-–—…’‘“”„«»¿¡/\n\r\t�"
END = ".!?…:;\"'”’»)"
SPACE = (*range(9, 14), 0x20, 0x85, 0xA0)
_BULLET = re.compile(BULLET)


@lru_cache(1)
def _tables() -> tuple[np.ndarray, ...]:
    from .kernel import alnum_table

    space, plain, end, digit = (np.zeros(0x110000, bool) for _ in range(4))
    space[list(SPACE)] = True
    plain[[ord(c) for c in PLAIN]] = True
    end[[ord(c) for c in END]] = True
    digit[0x30:0x3A] = True
    return space, plain | space | alnum_table(), end, digit


STATS = ("n_words", "mean_word_length", "symbol_ratio", "letter_words", "lines_ending_in_punctuation", "bullet_lines", "common_words", "likelihood", "lost_chars", "list_lines")
SHOWN = STATS[1:8]


def statistics(texts: list[str], common: np.ndarray, letters: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """The statistics of texts, one array each; ``common`` holds hashes of words, ``letters`` the log probabilities of bigrams."""
    from .kernel import Words, blocks
    from .mojibake import letter_classes

    space, usual, end, digit = _tables()
    out = {name: np.zeros(len(texts)) for name in STATS}
    for lo, hi in blocks(texts):
        part, bullets, lists = [], [], []
        for t in texts[lo:hi]:
            marks = _BULLET.findall(t)
            part.append((_BULLET.sub("", t) if marks else t).lower())
            bullets.append(len(marks))
            # Dialogue opens its lines with dashes, and one line is no list.
            items = sum(x.strip() not in ("–", "—") for x in marks)
            lists.append(items if items > 1 else 0)
        words = Words(part)
        cp, start = words.cp, words.start
        n = np.diff(words.first)
        per_doc = lambda x: np.add.reduceat(x, start[:-1], dtype=float)  # noqa: B023, E731
        per_word = lambda x: np.bincount(words.doc, x, minlength=hi - lo)  # noqa: B023, E731
        ink = ~space[cp]
        size = np.maximum(per_doc(ink), 1)
        some = np.maximum(n, 1)
        digits = np.concatenate([[0], np.cumsum(digit[cp])])
        # A line counts if it has ink; its last ink is the nearest before its line feed.
        feed = np.flatnonzero(cp == 10)
        at = np.maximum.accumulate(np.where(ink, np.arange(len(cp)), -1))
        last, before = at[feed], np.concatenate([[-1], feed[:-1]])
        inked = last > before
        doc = np.searchsorted(start, feed, "right") - 1
        lines = np.maximum(np.bincount(doc[inked], minlength=hi - lo), 1)
        s = slice(lo, hi)
        out["n_words"][s] = n
        out["mean_word_length"][s] = per_word(words.end - words.begin) / some
        out["symbol_ratio"][s] = per_doc(~usual[cp]) / size
        out["letter_words"][s] = per_word(digits[words.end] - digits[words.begin] < words.end - words.begin) / some
        out["lines_ending_in_punctuation"][s] = np.bincount(doc[inked], end[cp[np.maximum(last[inked], 0)]], minlength=hi - lo) / lines
        out["bullet_lines"][s] = np.minimum(np.array(bullets) / lines, 1)
        out["list_lines"][s] = np.minimum(np.array(lists) / lines, 1)
        out["common_words"][s] = per_word(np.isin(words.hash, common)) / some
        out["lost_chars"][s] = per_doc(cp == 0xFFFD) / size
        if letters is not None:
            kind = letter_classes()[cp]
            both = np.append((kind[:-1] > 0) & (kind[1:] > 0), False)
            score = np.append(letters[kind[:-1], kind[1:]], 0.0)
            pairs = per_doc(both)
            # Ink without any two letters in a row is as unlikely as can be.
            out["likelihood"][s] = np.where(pairs > 0, per_doc(np.where(both, score, 0)) / np.maximum(pairs, 1), np.where(per_doc(ink) > 0, -20.0, 0.0))
    return out


def rules(stats: dict[str, np.ndarray], known_words: bool = True) -> dict[str, np.ndarray]:
    """For each rule which texts fail it."""
    sure = stats["lost_chars"] < LOST
    length = stats["mean_word_length"]
    return {
        "letter_words": sure & (stats["letter_words"] < LETTER_WORDS),
        "mean_word_length": sure & ((length < MEAN_WORD_LENGTH[0]) | (length > MEAN_WORD_LENGTH[1])),
        "symbol_ratio": sure & (stats["symbol_ratio"] > SYMBOL_RATIO),
        "bullet_lines": stats["list_lines"] > BULLET_LINES,
        "common_words": sure & (stats["common_words"] < COMMON_WORDS) & known_words,
        "lines_ending_in_punctuation": sure & (stats["lines_ending_in_punctuation"] < PUNCTUATED_LINES),
        "likelihood": sure & (stats["likelihood"] < LIKELIHOOD),
    }


def judge(stats: dict[str, np.ndarray], n_chars: np.ndarray, known_words: bool = True) -> tuple[np.ndarray, list[str | None]]:
    """Which texts are prose, and every rule each text fails; texts under 40 characters are not judged."""
    failed = rules(stats, known_words)
    no_prose = np.any([failed[r] for r in SHAPE], axis=0) | (np.sum([failed[r] for r in SOFT], axis=0) >= 2)
    judged = n_chars >= MIN_CHARS
    reasons: list[list[str]] = [[] for _ in n_chars]
    for name in (*SHAPE, *SOFT):
        for i in np.flatnonzero(failed[name] & judged):
            reasons[i].append(name)
    return ~(no_prose & judged), [", ".join(r) or None for r in reasons]


@dataclass
class Collection:
    """What is known of all texts: how letters follow each other, by script and in all, and the hashes of common words."""

    script: ScriptModel
    letters: np.ndarray
    common: np.ndarray


SCRIPTS, LETTERS, WORDS, TEXTS = range(4)


def survey(rows: DataFrame) -> Collection:
    """One pass over (text, lang): bigram counts and the number of texts of each language that hold each word.

    Sums are made within each batch first.  What reaches the driver is bounded
    by the alphabets and, as each common word takes a fifth of a language's
    texts, by five times the words of a mean text for each language with
    enough texts.  A null language is one of its own.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .kernel import Words, blocks, distinct_by_doc, mix64
        from .mojibake import count_letters

        def emit(kind: int, lang: list[str], key: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(key), kind, np.int32)), pa.array(lang, pa.string()), pa.array(np.asarray(key).astype(np.int64)), pa.array(n.astype(np.int64))], names=["kind", "lang", "key", "n"])

        both = {SCRIPTS: 0, LETTERS: 0}
        for batch in batches:
            texts, langs = batch.column(0).to_pylist(), [x or "" for x in batch.column(1).to_pylist()]
            both[SCRIPTS] += count_script(texts)
            both[LETTERS] += count_letters(texts)
            names, code = np.unique(np.array(langs, object), return_inverse=True)
            yield emit(TEXTS, names.tolist(), np.zeros(len(names)), np.bincount(code))
            for lo, hi in blocks(texts):
                w = Words([t.lower() for t in texts[lo:hi]])
                h, doc = distinct_by_doc(w.hash, w.doc)
                c = code[lo:hi][doc]
                _, first, n = np.unique(h ^ mix64(c), return_index=True, return_counts=True)
                yield emit(WORDS, names[c[first]].tolist(), h[first].view(np.int64), n)
        for kind, sums in both.items():
            at = np.flatnonzero(sums)
            yield emit(kind, [""] * len(at), at, np.asarray(sums)[at] if len(at) else at)

    found = spread(rows.select("text", "lang")).mapInArrow(count, "kind int, lang string, key long, n long")
    sums = cut(found.groupBy("kind", "lang", "key").agg(F.sum("n").alias("n")))
    bigrams = sums.where(F.col("kind") < WORDS).select("kind", "key", "n").collect()
    sizes = sums.where(f"kind = {TEXTS} and n >= {LEAST_TEXTS}").select("lang", F.col("n").alias("texts"))
    held = sums.where(f"kind = {WORDS}").join(F.broadcast(sizes), "lang").where(F.col("n") >= COMMON_SHARE * F.col("texts"))
    common = np.array([r.key for r in held.select("key").distinct().collect()], np.int64).view(np.uint64)
    from .mojibake import sums_to_model

    of = lambda kind: {r.key: r.n for r in bigrams if r.kind == kind}
    return Collection(to_script_model(of(SCRIPTS), rows.sparkSession), sums_to_model(of(LETTERS)), common)


_SCHEMA = "id long, n_chars long, n_words long, " + ", ".join(f"{c} double" for c in SHOWN) + ", prose boolean, reasons string"


def quality(df: DataFrame, id_col: str = "essay_id", text_col: str = "text", lang_col: str | None = "lang") -> DataFrame:
    """Statistics, whether it is prose, and the rules failed (null for none) of every record with a text.

    Damaged encodings are undone and the text is brought into form first, so
    that garbled or disguised prose is judged by its words.  Null keys and
    texts take no part; an empty text has statistics of 0 and is not judged;
    repeated rows come out once.  Without any language of enough texts, common
    words are unknown and their rule fails nobody.
    """
    lang = F.col(lang_col).cast("string") if lang_col and lang_col in df.columns else F.lit("")
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), lang.alias("lang")).where("id is not null and text is not null")
    known = survey(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .mojibake import repairs

        for b in batches:
            texts = b.column(1).to_pylist()
            n_chars = np.array([len(t) for t in texts], np.int64)
            for i, now, _ in repairs(texts, known.letters):
                texts[i] = now
            stats = statistics(forms(texts, known.script), known.common, known.letters)
            prose, reasons = judge(stats, n_chars, len(known.common) > 0)
            shown = [pa.array(np.round(stats[c], 6)) for c in SHOWN]
            cols = [b.column(0), pa.array(n_chars), pa.array(stats["n_words"].astype(np.int64)), *shown, pa.array(prose), pa.array(reasons, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=["id", "n_chars", "n_words", *SHOWN, "prose", "reasons"])

    out = spread(rows.select("id", "text")).mapInArrow(run, _SCHEMA)
    rest = [f.name for f in out.schema.fields if f.name != "id"]
    return out.groupBy("id").agg(F.min(F.struct(*rest)).alias("s")).select("id", "s.*")


def plain_statistics(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The statistics that need no knowledge of other texts, of the texts as they stand; nulls and repeats as in ``quality``."""
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")
    shown = SHOWN[:5]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            stats = statistics(b.column(1).to_pylist(), np.zeros(0, np.uint64))
            cols = [b.column(0), pa.array(stats["n_words"].astype(np.int64)), *(pa.array(stats[c]) for c in shown)]
            yield pa.RecordBatch.from_arrays(cols, names=["id", "n_words", *shown])

    exact = spread(rows).mapInArrow(run, "id long, n_words long, " + ", ".join(f"{c} double" for c in shown))
    out = exact.select("id", "n_words", *(F.round(c, 6).alias(c) for c in shown))
    return out.groupBy("id").agg(F.min(F.struct("n_words", *shown)).alias("s")).select("id", "s.*")
