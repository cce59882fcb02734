"""Problem 1: one form for text that looks the same but is stored with different characters.

Three steps bring a text into its form:

1. compatibility normalization of what differs in width or ligature only, and
   deletion of what has no width;
2. decomposition, so that an accent is one thing however it was written;
3. for every token a lattice of the look-alike letters of each position is
   searched with Viterbi under script-consistent character bigram scores.

The lattice of a position holds *all* letters that look like the one stored,
and neither the scores nor the prior know which one was stored; so the result
depends only on what is seen, and texts that look the same become equal.

Latin, Cyrillic and Greek letters are told apart by a fixed table; the letters
of all other scripts (and the rarer ones of these) come from the public list of
confusable characters that Spark's ICU library carries: a letter whose skeleton
is one ASCII letter of the same case looks like it.
"""

from __future__ import annotations

import math
import re
import unicodedata
import warnings
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .frames import cut, expand, spread

LATIN, CYRILLIC, GREEK, OTHER = 0, 1, 2, 3
# Letters that look alike, as (Latin, Cyrillic, Greek); "." where a script has none.
ALIKE = """
AАΑ BВΒ CСϹ EЕΕ F.Ϝ HНΗ IІΙ JЈ. KКΚ MМΜ N.Ν OОΟ PРΡ SЅ. TТΤ XХΧ YУΥ Z.Ζ
aаα cсϲ eе. hһ. iіι jј. oоο pрρ qԛ. sѕ. u.υ v.ν wԝ. xхχ yуγ dԁ. lӏ.
""".split()
# Letters without a look-alike that show which script a text is in.
EVIDENCE = ("gkmnrtbfz", "бвгджзиклмнптчшыья", "βδεηθλμξπσςτφψω")
EVIDENCE_ENOUGH = 20
_FLOOR, _PRIOR_WEIGHT, _SWITCH = -9.0, 3.2, -1000.0

_ALTERNATIVES: dict[str, list[tuple[int, str]]] = {}
for _row in ALIKE:
    _ALTERNATIVES[next(c for c in _row if c != ".")] = [(s, c) for s, c in enumerate(_row) if c != "."]
_SKELETON = {ord(c): seen for seen, row in _ALTERNATIVES.items() for _, c in row if c != seen}
_SKELETON |= {0x04C0: "I", 0x04AE: "Y", 0x0261: "g", 0x0251: "a"}
# The code points without width (Default_Ignorable_Code_Point), and the alphabets where the table above decides or nothing looks Latin.
IGNORABLE = ((0xAD, 0xAD), (0x34F, 0x34F), (0x61C, 0x61C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFA0, 0xFFA0), (0xFFF0, 0xFFF8), (0x1BCA0, 0x1BCA3), (0x1D173, 0x1D17A), (0xE0000, 0xE0FFF))
DECIDED = ((0x00, 0x130), (0x132, 0x17F), (0x386, 0x3CE), (0x400, 0x45F), (0x590, 0x8FF), (0x3400, 0x9FFF), (0xAC00, 0xD7A3), (0xFB1D, 0xFEFC))


def _in(c: int, ranges: tuple[tuple[int, int], ...]) -> bool:
    return any(a <= c <= b for a, b in ranges)


def _fold_table() -> dict[int, str | None]:
    """By rule: blanks to one blank, nothing for what has no width, plain letters for wide and ligature forms."""
    out: dict[int, str | None] = {}
    for c in range(0x80, 0x30000):
        ch = chr(c)
        kind = unicodedata.category(ch)
        if kind == "Zs":
            out[c] = " "
        elif kind == "Cf" and not 0x600 <= c <= 0x605 or _in(c, IGNORABLE):
            out[c] = None
        else:
            tag, _, rest = unicodedata.decomposition(ch).partition(" ")
            if tag in ("<wide>", "<narrow>", "<font>", "<noBreak>") or (
                tag == "<compat>" and all(unicodedata.category(chr(int(x, 16)))[0] == "L" for x in rest.split())
            ):
                out[c] = "".join(chr(int(x, 16)) for x in rest.split())
    for c in range(0xE0000, 0xE1000):
        out[c] = None
    return out


_FOLD = _fold_table()


# A quick superset of what the table folds, in few ranges (a test holds it against the table).
_TO_FOLD = re.compile(
    "[\u00a0\u00ad\u00b5\u0132\u0133\u013f\u0140\u0149\u017f\u01c4-\u01cc\u01f1-\u01f3\u034f\u0370-\u03ff"
    "\u0530-\u200f\u2011\u2028-\u202f\u205f-\u218f\u2460-\u24ff\u2c60-\U0010ffff]"
)
_UNUSUAL = "ɡɑ̀-ͯͰ-ϿЀ-ԯ᪰-᫿᷀-᷿ἀ-῿"
_TOKEN = re.compile("[^\\W\\d_](?:[^\\W\\d_]|[̀-ͯ])*")
_HAS_ALIKE = re.compile("[" + "".join(_ALTERNATIVES) + "]")

# Compact alphabet of the bigram model: 0 is "anything else" and the word edge.
_LETTERS = "".join(chr(c) for c in (*range(0x61, 0x7B), *range(0x3B1, 0x3CA), *range(0x430, 0x460)))
_INDEX = {c: i + 1 for i, c in enumerate(_LETTERS)}
_N = 128


def _index_of(c: str) -> int:
    return _INDEX.get(c.lower(), 0)


def _script_name(c: str) -> str:
    return unicodedata.name(c, "?").split()[0]


@lru_cache(1)
def confusable_letters(spark: SparkSession) -> dict[str, str]:
    """Letters outside the decided alphabets that look like one ASCII letter of their case, by the skeletons of Spark's ICU library."""
    letters = [chr(c) for c in range(0x80, 0x20000) if unicodedata.category(chr(c)) in ("Lu", "Ll", "Lo") and not _in(c, DECIDED) and c not in _FOLD and c not in _SKELETON]
    try:
        skeletons = spark._jvm.com.ibm.icu.text.SpoofChecker.Builder().build().getSkeleton("\n".join(letters)).split("\n")
    except (AttributeError, TypeError):
        warnings.warn("no ICU library in this session: only Latin, Cyrillic and Greek look-alikes are known", stacklevel=2)
        return {}
    same_case = {"Lu": str.isupper, "Ll": str.islower, "Lo": str.isalpha}
    out: dict[str, str] = {}
    taken: set[tuple[str, str]] = set()
    for c, seen in zip(letters, skeletons, strict=True):
        if len(seen) == 1 and seen.isascii() and seen.isalpha() and same_case[unicodedata.category(c)](seen):
            # Of several letters of another script only the first is meant: they are told apart in its words.
            known = (_script_name(c), seen)
            if known not in taken or known[0] in ("LATIN", "CYRILLIC", "GREEK"):
                out[c] = seen
                taken.add(known)
    return out


@dataclass
class ScriptModel:
    """Log scores of a letter after another of its script, counted over all texts, and the letters of other scripts that look like an ASCII one."""

    counts: np.ndarray
    alike: dict[str, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        total = self.counts.sum(1, keepdims=True) + 0.5 * _N
        self.log = np.maximum(np.log((self.counts + 0.5) / total), _FLOOR)
        self.memo: dict[tuple[float, ...], dict[str, str]] = {}
        self.skeleton = np.arange(0x110000, dtype="<u4")
        for c, seen in (_SKELETON | {ord(c): seen for c, seen in self.alike.items()}).items():
            self.skeleton[c] = ord(seen)
        self.unusual = re.compile(f"[{_UNUSUAL}{''.join(map(re.escape, self.alike))}]")
        # By script the letter that stands for each ASCII letter in its words: the first one.
        self.own: dict[str, dict[str, str]] = {}
        for c, seen in self.alike.items():
            self.own.setdefault(_script_name(c), {}).setdefault(seen, c)
        for name in ("LATIN", "CYRILLIC", "GREEK"):
            self.own.pop(name, None)

    def __reduce__(self):
        return ScriptModel, (self.counts, self.alike)

    def resolve(self, token: str, prior: tuple[float, ...]) -> str:
        """The best look-alike path for one token given as seen (Latin representatives)."""
        known = self.memo.setdefault(prior, {})
        found = known.get(token)
        if found is None:
            if len(known) > 200_000 or len(self.memo) > 1000:
                self.memo.clear()
                known = self.memo[prior] = {}
            open_ = _HAS_ALIKE.search(token) or self.own and not token.isascii()
            found = known[token] = self._viterbi(token, prior) if open_ else token
        return found

    def seen(self, text: str) -> str:
        """The text with the letter that stands for all that look like it."""
        cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        return self.skeleton[cp].tobytes().decode("utf-32-le", "surrogatepass")

    def _viterbi(self, token: str, prior: tuple[float, ...]) -> str:
        # A letter without a look-alike fixes the script of its token; only without one does the text's script count.
        fixed = [c for c in token if c not in _ALTERNATIVES and not unicodedata.combining(c)]
        named = [] if token.isascii() else [_script_name(c) for c in fixed if _script(c) < 0]
        own = next((self.own[x] for x in named if x in self.own), {})
        weight = 0.0 if own or any(_script(c) >= 0 for c in fixed) else _PRIOR_WEIGHT
        best: list[tuple[float, int, str, tuple]] = [(0.0, -1, "", ())]
        for c in token:
            options = _ALTERNATIVES.get(c)
            if options is None:
                if unicodedata.combining(c):
                    best = [(score, s, last, (path, c)) for score, s, last, path in best]
                    continue
                options = [(OTHER if own and _script(c) < 0 else _script(c), c)]
            if c in own:
                options = [*options, (OTHER, own[c])]
            step = []
            for s, letter in options:
                top = None
                for score, before, last, path in best:
                    if before == s or before == -1 or s == -1:
                        value = score + float(self.log[_index_of(last) if last else 0, _index_of(letter)])
                    else:
                        value = score + _SWITCH
                    if weight and s >= 0:
                        value += weight * prior[s]
                    if top is None or value > top[0]:
                        top = (value, s, letter, (path, letter))
                step.append(top)
            best = step
        path, out = max(best, key=lambda x: (x[0], -x[1]))[3], []
        while path:
            path, c = path
            out.append(c)
        return "".join(reversed(out))


def _script(c: str) -> int:
    p = ord(c)
    return GREEK if 0x370 <= p < 0x400 or 0x1F00 <= p < 0x2000 else CYRILLIC if 0x400 <= p < 0x530 else LATIN if p < 0x250 or 0x1E00 <= p < 0x1F00 else -1


def _evidence(text: str, letters: str) -> int:
    return sum(map(text.count, letters))


def form(text: str, model: ScriptModel) -> str:
    """The one form of a text.

    A text without any character to bring into form is returned at once if it
    shows enough Latin evidence: by the weight of the prior its all-Latin path
    is then the best one of every lattice, as the tests check.
    """
    if not text.isascii():
        text = _TO_FOLD.sub(lambda m: _FOLD.get(ord(m[0]), m[0]) or "", text)
        text = unicodedata.normalize("NFC", text)
    if (text.isascii() or not model.unusual.search(text)) and _evidence(text, EVIDENCE[LATIN]) >= EVIDENCE_ENOUGH:
        return text
    seen = model.seen(unicodedata.normalize("NFD", text))
    known = [_evidence(seen, letters) for letters in EVIDENCE]
    total = sum(known) + 3
    prior = tuple(round(2 * math.log((k + 1) / total)) / 2 for k in known)
    resolve, known = model.resolve, model.memo.setdefault(prior, {})
    return unicodedata.normalize("NFC", _TOKEN.sub(lambda m: known.get(m[0]) or resolve(m[0], prior), seen))


@lru_cache(4)
def _plain(unusual: re.Pattern) -> tuple[np.ndarray, np.ndarray]:
    """Characters that call for no step of ``form``, and the letters that show the Latin script."""
    plain, shows = np.zeros(0x110000, bool), np.zeros(0x110000, bool)
    plain[:0x250] = [not _TO_FOLD.match(chr(c)) and not unusual.match(chr(c)) for c in range(0x250)]
    for a, b in ((0x2010, 0x2010), (0x2012, 0x2027), (0x2030, 0x205E)):
        plain[a : b + 1] = True
    shows[[ord(c) for c in EVIDENCE[LATIN]]] = True
    return plain, shows


def forms(texts: list[str], model: ScriptModel) -> list[str]:
    """The forms of texts; those of plain characters that show enough Latin are told at once and stay as they are."""
    from .kernel import blocks, codes

    plain, shows = _plain(model.unusual)
    out = list(texts)
    for lo, hi in blocks(texts):
        cp, start = codes(texts[lo:hi])
        odd = np.add.reduceat(~plain[cp], start[:-1], dtype=np.int64) > 0
        known = np.add.reduceat(shows[cp], start[:-1], dtype=np.int64) >= EVIDENCE_ENOUGH
        for i in np.flatnonzero(odd | ~known).tolist():
            out[lo + i] = form(texts[lo + i], model)
    return out


def count_script(texts: list[str]) -> np.ndarray:
    """Counts of letter bigrams within each script."""
    from .kernel import blocks, codes

    lut, allowed = _script_tables()
    sums = np.zeros(_N * _N, np.int64)
    for lo, hi in blocks(texts):
        ids = lut[codes(texts[lo:hi])[0]]
        sums += np.bincount(ids[:-1].astype(np.uint16) * np.uint16(_N) + ids[1:], minlength=_N * _N)
    return sums * allowed


@lru_cache(1)
def _script_tables() -> tuple[np.ndarray, np.ndarray]:
    lut = np.zeros(0x110000, np.uint8)
    for c, i in _INDEX.items():
        lut[ord(c)] = i
        if len(c.upper()) == 1:
            lut[ord(c.upper())] = i
    script = np.array([-1] + [_script(c) for c in _LETTERS] + [-1] * (_N - 1 - len(_LETTERS)))
    a, b = np.divmod(np.arange(_N * _N), _N)
    return lut, ~((b == 0) | ((a != 0) & (script[a] != script[b])))


def to_script_model(sums: dict[int, int], spark: SparkSession) -> ScriptModel:
    counts = np.zeros(_N * _N, np.int64)
    for pair, n in sums.items():
        counts[pair] = n
    return ScriptModel(counts.reshape(_N, _N), confusable_letters(spark))


def script_model(df: DataFrame, text_col: str = "text") -> ScriptModel:
    """Count letter bigrams within each script over all texts.

    At most 128 x 128 sums reach the driver, whatever the number of texts.
    Null texts count as empty; an empty table gives a uniform model.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(_N * _N, np.int64)
        for batch in batches:
            sums += count_script([t for t in batch.column(0).to_pylist() if t])
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[at])], names=["pair", "n"])

    rows = spread(df.select(F.col(text_col))).mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    return to_script_model(dict(rows.collect()), df.sparkSession)  # bounded by the alphabet: 16,384 rows


def essays_once(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text) without null keys and null texts; clashing extra columns never matter."""
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")


MIN_LETTERS = 20


def with_form(df: DataFrame, id_col: str = "essay_id", text_col: str = "text", model: ScriptModel | None = None) -> DataFrame:
    """(id, text, form): every row with a key and a text, brought into form.

    Empty texts have an empty form; repeated rows stay; ties cannot arise.
    """
    rows = essays_once(df, id_col, text_col)
    own = model or script_model(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = pa.array(forms(b.column(1).to_pylist(), own), pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), out], names=["id", "text", "form"])

    return spread(rows).mapInArrow(run, "id long, text string, form string")


def form_keys(df: DataFrame, id_col: str = "essay_id", text_col: str = "text", model: ScriptModel | None = None) -> DataFrame:
    """(id, f1, f2, raw): 128-bit key of the form and 64-bit key of the stored string of each record with at least 20 letters and digits."""
    rows = essays_once(df, id_col, text_col)
    own = model or script_model(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .kernel import letters_hash

        for b in batches:
            texts = b.column(1).to_pylist()
            formed = forms(texts, own)
            keep = letters_hash(formed)[2] >= MIN_LETTERS
            digest = [xxhash.xxh3_128_intdigest(x.encode("utf-8", "surrogatepass")) for x in formed]
            signed = lambda v: np.array(v, np.uint64).view(np.int64)
            cols = [
                b.column(0),
                pa.array(signed([d >> 64 for d in digest])),
                pa.array(signed([d & (1 << 64) - 1 for d in digest])),
                pa.array(signed([xxhash.xxh3_64_intdigest(x.encode("utf-8", "surrogatepass")) for x in texts])),
            ]
            yield pa.RecordBatch.from_arrays(cols, names=["id", "f1", "f2", "raw"]).filter(pa.array(keep))

    return spread(rows).mapInArrow(run, "id long, f1 long, f2 long, raw long")


_CLASS = ["f1", "f2", "raw"]


def _keys_once(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The form keys of one row per id (of differing ones the smallest keys), as a written table."""
    return cut(form_keys(df, id_col, text_col).groupBy("id").agg(F.min(F.struct(*_CLASS)).alias("k")).select("id", "k.*"))


def same_looking_pairs(df: DataFrame, id_col: str = "essay_id", text_col: str = "text") -> DataFrame:
    """(id_a, id_b), a < b: records equal in form but not as strings.

    Repeated rows of a key count once (of differing ones the smallest keys).
    Equal strings are one class; classes of one form are joined with each
    other, and only those pairs of classes are expanded to their members, the
    members of hot classes over salts.
    """
    keys = _keys_once(df, id_col, text_col)
    classes = keys.groupBy(*_CLASS).agg(F.count(F.lit(1)).alias("n"))
    mixed = classes.groupBy("f1", "f2").agg(F.count(F.lit(1)).alias("strings")).where("strings > 1").select("f1", "f2")
    held = cut(classes.join(mixed, ["f1", "f2"], "left_semi").select(*_CLASS))
    pairs = held.join(held.select("f1", "f2", F.col("raw").alias("raw_b")), ["f1", "f2"]).where("raw < raw_b")
    once = expand(pairs, keys.withColumnRenamed("id", "x"), _CLASS).select("x", "f1", "f2", F.col("raw_b").alias("raw"))
    both = expand(once, keys.withColumnRenamed("id", "y"), _CLASS)
    return both.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))


def same_looking_groups(df: DataFrame, id_col: str = "essay_id", text_col: str = "text") -> DataFrame:
    """(id, class_id, n_strings): every record that takes part, the smallest id that looks the same, and the number of different strings that do.

    Classes are counted by form and string first, so no class meets in one task.
    """
    keys = _keys_once(df, id_col, text_col)
    classes = keys.groupBy(*_CLASS).agg(F.min("id").alias("least"))
    forms = classes.groupBy("f1", "f2").agg(F.min("least").alias("class_id"), F.count(F.lit(1)).alias("n_strings"))
    return expand(forms, keys.select("id", "f1", "f2"), ["f1", "f2"]).select("id", "class_id", "n_strings")
