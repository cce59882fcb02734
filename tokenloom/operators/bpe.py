"""Pair-merge subword tokenizer: training, vocabulary, encoding and decoding.

The vocabulary is what survives in the final segmentation plus all single
characters, not the list of merges; encoding is greedy longest match on it.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.chars import PUNCT
from ..plans.config import APP_BPE, BpeConfig
from .pretokenize import is_punct_token, normalized_tokens

END = "</w>"
OPEN, CLOSE = "\x01", "\x02"
# The punctuation marks with ids of their own, in order.
STATIC_MARKS = tuple(".,!?:;()[]{}<>-_/+'\"")


# --- training -------------------------------------------------------------


def first_rows(corpus: DataFrame, limit: int) -> DataFrame:
    """The first rows by ``doc_id`` (which is unique); only ids are ordered, texts stay where they are."""
    last = corpus.select("doc_id").orderBy("doc_id").limit(limit).agg(F.max("doc_id")).first()[0]
    return corpus.where(F.col("doc_id") <= F.lit(last)) if last is not None else corpus.limit(0)


def training_words(corpus: DataFrame, cfg: BpeConfig = APP_BPE) -> DataFrame:
    """(doc_id, pos, word): the first ``word_limit`` words of the first ``word_limit`` rows that are not empty.

    Rows are read in growing slices by ``doc_id`` until they hold enough words,
    so only a few rows more than needed are ever taken apart.
    """
    filled = corpus.where("text is not null and text <> ''")
    n_words = F.size(normalized_tokens(F.col("text"), replace(cfg, keep_punctuation=False)))
    rows, last = 64, None
    while True:
        rows = min(rows, cfg.word_limit)
        sized = filled.select("doc_id", "text").orderBy("doc_id").limit(rows).select("doc_id", n_words.alias("n")).collect()  # bounded by the word limit
        total = 0
        for r in sorted(sized, key=lambda r: r.doc_id):
            last, total = r.doc_id, total + r.n
            if total >= cfg.word_limit:
                break
        if total >= cfg.word_limit or len(sized) < rows or rows == cfg.word_limit:
            break
        rows *= 4
    needed = filled.where(F.col("doc_id") <= F.lit(last)) if last is not None else filled.limit(0)
    tokens = needed.select("doc_id", F.posexplode(normalized_tokens(F.col("text"), cfg)).alias("pos", "word"))
    return tokens.where(~is_punct_token(F.col("word"), cfg)).orderBy("doc_id", "pos").limit(cfg.word_limit)


def word_types(words: DataFrame) -> DataFrame:
    """(word, freq)."""
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("freq"))


def seed_symbols(types: DataFrame) -> DataFrame:
    """(word, freq, symbols): every word as its characters and the boundary marker."""
    return types.select("word", "freq", F.concat(F.split("word", ""), F.array(F.lit(END))).alias("symbols"))


def pair_counts(segmented: DataFrame, weighting: str = "type") -> DataFrame:
    """(l, r, n): adjacent symbols; every occurrence counts, by default once per word type."""
    pairs = F.transform(F.sequence(F.lit(1), F.size("symbols") - 1), lambda i: F.struct(F.element_at("symbols", i).alias("l"), F.element_at("symbols", i + 1).alias("r")))
    weight = F.lit(1) if weighting == "type" else F.col("freq")
    rows = segmented.where(F.size("symbols") > 1).select(F.explode(pairs).alias("p"), weight.alias("w"))
    return rows.groupBy("p.l", "p.r").agg(F.sum("w").cast("long").alias("n"))


def best_pair(counts: DataFrame) -> DataFrame:
    """The most frequent pair of at least 2; ties go to the smaller left, then right symbol."""
    return counts.where("n >= 2").orderBy(F.desc("n"), "l", "r").limit(1)


def to_text(symbols: Column) -> Column:
    return F.array_join(F.transform(symbols, lambda s: F.concat(F.lit(OPEN), s, F.lit(CLOSE))), "")


def from_text(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"{OPEN}([^{CLOSE}]*){CLOSE}"), F.lit(1))


def merge_pair(segmented: DataFrame, left: str, right: str) -> DataFrame:
    """One merge, left to right and without overlap, natively."""
    old, new = f"{OPEN}{left}{CLOSE}{OPEN}{right}{CLOSE}", f"{OPEN}{left}{right}{CLOSE}"
    return segmented.withColumn("symbols", from_text(F.replace(to_text(F.col("symbols")), F.lit(old), F.lit(new))))


def learn(words: list[list[str]], weights: list[int], merge_ops: int) -> list[tuple[str, str]]:
    """Run up to ``merge_ops`` merges in place with incremental pair counts; returns the merges."""
    counts: Counter[tuple[str, str]] = Counter()
    where: dict[tuple[str, str], set[int]] = defaultdict(set)
    for i, symbols in enumerate(words):
        for p in zip(symbols, symbols[1:], strict=False):
            counts[p] += weights[i]
            where[p].add(i)
    heap = [(-n, p) for p, n in counts.items()]
    heapq.heapify(heap)
    merges: list[tuple[str, str]] = []
    while heap and len(merges) < merge_ops:
        n, pair = heapq.heappop(heap)
        if counts.get(pair, 0) != -n:
            if counts.get(pair, 0) > 0:
                heapq.heappush(heap, (-counts[pair], pair))
            continue
        if -n < 2:
            break
        merges.append(pair)
        joined, touched = pair[0] + pair[1], set()
        for i in where.pop(pair):
            symbols = words[i]
            for p in zip(symbols, symbols[1:], strict=False):
                counts[p] -= weights[i]
                touched.add(p)
            out, k = [], 0
            while k < len(symbols):
                if k + 1 < len(symbols) and symbols[k] == pair[0] and symbols[k + 1] == pair[1]:
                    out.append(joined)
                    k += 2
                else:
                    out.append(symbols[k])
                    k += 1
            words[i] = out
            for p in zip(out, out[1:], strict=False):
                counts[p] += weights[i]
                where[p].add(i)
                touched.add(p)
        for p in touched:
            if counts[p] > 0:
                heapq.heappush(heap, (-counts[p], p))
            else:
                del counts[p]
    return merges


def segment_types(types: DataFrame, cfg: BpeConfig = APP_BPE) -> DataFrame:
    """(word, freq, symbols) after training.

    The merge loop is a fixed point over the word types, of which there are at
    most ``word_limit``; it runs in one task, with the histogram made in Spark.
    """
    limit, ops, by_token = cfg.word_limit, cfg.merge_ops, cfg.weighting == "token"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
        if len(rows) > limit:
            raise ValueError(f"{len(rows)} word types, more than the word limit of {limit}")
        rows.sort()
        words = [[*w, END] for w, _ in rows]
        learn(words, [n if by_token else 1 for _, n in rows], ops)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in rows]), pa.array([n for _, n in rows], pa.int64()), pa.array(words)], names=["word", "freq", "symbols"])

    return types.select("word", "freq").repartition(1).mapInArrow(run, "word string, freq long, symbols array<string>")


def harvest(segmented: DataFrame) -> DataFrame:
    """(subword): all characters of the words and the symbols left at the end, without the boundary marker."""
    chars = segmented.select(F.explode(F.split("word", "")).alias("subword"))
    left = segmented.select(F.explode("symbols").alias("s")).select(F.regexp_replace("s", f"{END}$", "").alias("subword"))
    return chars.unionAll(left).where("subword <> ''").distinct()


def id_map(vocab: DataFrame, unknown_token: str = "<unk>") -> DataFrame:
    """(id, token): 0 the unknown token; then each subword, longest in bytes first, followed by its continuation form; then the marks.

    A token that is already there is skipped.  The vocabulary is small (it is
    bounded by the word limit), so one global window numbers it.
    """
    order = Window.orderBy(F.octet_length("subword").desc(), "subword")
    ranked = vocab.select("subword", F.row_number().over(order).alias("k"))
    both = ranked.select((F.col("k") * 2).alias("o"), F.col("subword").alias("token")).unionAll(ranked.select(F.col("k") * 2 + 1, F.concat(F.lit("##"), "subword")))
    first = F.array(*[F.struct(F.lit(-1 if i == 0 else (1 << 30) + i).alias("o"), F.lit(t).alias("token")) for i, t in enumerate((unknown_token, *STATIC_MARKS))])
    fixed = vocab.sparkSession.range(1).select(F.inline(first))
    once = both.unionByName(fixed).groupBy("token").agg(F.min("o").alias("o"))
    return once.select((F.row_number().over(Window.orderBy("o")) - 1).alias("id"), "token")


def train(corpus: DataFrame, cfg: BpeConfig = APP_BPE) -> DataFrame:
    """The vocabulary (subword) of a corpus (doc_id, text); raises if there is no word to learn from."""
    segmented = segment_types(word_types(training_words(corpus, cfg)), cfg).persist()  # at most ``word_limit`` rows, read twice
    try:
        found = [r.subword for r in harvest(segmented).collect()]  # bounded by the word limit
    finally:
        segmented.unpersist()
    if not found:
        raise ValueError("no training words")
    return corpus.sparkSession.createDataFrame([(s,) for s in sorted(found)], "subword string")


# --- encoding -------------------------------------------------------------


def _escape(c: str) -> str:
    return "\\x{%x}" % ord(c)


def longest_match_pattern(subwords: list[str]) -> str:
    """A trie-shaped regular expression that matches the longest subword at a position, else one character."""
    trie: dict = {}
    for s in subwords:
        node = trie
        for c in s:
            node = node.setdefault(c, {})
        node[""] = {}

    def render(node: dict) -> str:
        options = [_escape(c) + render(child) for c, child in sorted(node.items()) if c]
        if not options:
            return ""
        body = options[0] if len(options) == 1 and "" not in node else f"(?:{'|'.join(options)})"
        return f"{body}?" if "" in node else body

    return f"(?s){render(trie)}|." if trie else "(?s)."


def word_pieces(word: Column, pattern: str) -> Column:
    """Greedy longest-match pieces of one word; all but the first carry ``##``."""
    return F.transform(F.regexp_extract_all(word, F.lit(pattern), F.lit(0)), lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.lit("##"), p)))


def piece_array(text: Column, pattern: str, cfg: BpeConfig = APP_BPE) -> Column:
    """Pieces of a whole text, in one narrow expression.

    The words are joined by blanks, which none of them holds, and matched in a
    single scan; a blank tells the first piece of a word.
    """
    words = F.concat(F.lit(" "), F.array_join(normalized_tokens(text, cfg), " "))
    scan = f"(?s) ?(?:{pattern.removeprefix('(?s)').removesuffix('|.')}|[^ ])" if pattern != "(?s)." else " ?[^ ]"
    found = F.regexp_extract_all(words, F.lit(scan), F.lit(0))
    return F.transform(found, lambda p: F.when(p.startswith(" "), F.substring(p, 2, 1 << 30)).otherwise(F.concat(F.lit("##"), p)))


def pieces_of_tokens(subwords: list[str]):
    """An Arrow UDF from arrays of normalized tokens to arrays of pieces.

    Each different token of a batch is matched once, and known tokens of
    earlier batches are not matched again.
    """
    known = frozenset(subwords)
    longest = max(map(len, known), default=1)
    memo: dict[str, list[str]] = {}

    def cut(word: str) -> list[str]:
        out, at, n = [], 0, len(word)
        while at < n:
            k = min(longest, n - at)
            while k > 1 and word[at : at + k] not in known:
                k -= 1
            out.append(word[at : at + k] if not at else f"##{word[at : at + k]}")
            at += k
        return out

    @F.arrow_udf("array<string>")
    def run(tokens: pa.Array) -> pa.Array:
        if len(memo) > 500_000:
            memo.clear()
        flat = tokens.flatten().dictionary_encode()
        words = flat.dictionary.to_pylist()
        for w in words:
            if w not in memo:
                memo[w] = cut(w)
        each = pa.array([memo[w] for w in words], pa.list_(pa.string()))
        lists = each.take(flat.indices)
        sizes = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64))])
        per_text = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        offsets = pa.array(sizes[np.concatenate([[0], np.cumsum(per_text)])].astype(np.int32))
        return pa.ListArray.from_arrays(offsets, lists.flatten(), mask=tokens.is_null()) if tokens.null_count else pa.ListArray.from_arrays(offsets, lists.flatten())

    return run


def tokenize(corpus: DataFrame, subwords: list[str], cfg: BpeConfig = APP_BPE, *more: Column) -> DataFrame:
    """(doc_id, pieces) and any more columns of the corpus; a null text gives null, an empty one no pieces."""
    return corpus.select("doc_id", *more, pieces_of_tokens(subwords)(normalized_tokens(F.col("text"), cfg)).alias("pieces"))


def pieces_function(subwords: list[str], cfg: BpeConfig = APP_BPE):
    """An Arrow UDF that does what ``piece_array`` does, for use by name in SQL."""
    from ..functions.chars import LOWER, UPPER, WS_BPE

    python = lambda p: re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: re.escape(chr(int(m[1], 16))), p)
    word = f"[^{WS_BPE}{PUNCT}]+"
    split = f"[{PUNCT}]|{word}" if cfg.keep_punctuation else word
    token = re.compile(python(split if cfg.split_on_punctuation else f"[^{WS_BPE}]+"))
    piece = re.compile(python(longest_match_pattern(subwords).removeprefix("(?s)")), re.DOTALL)
    camel = re.compile("([a-z])([A-Z])")
    fold = str.maketrans(UPPER, LOWER, "\0") if cfg.lowercase else str.maketrans("", "", "\0")

    @F.arrow_udf("array<string>")
    def run(text: pa.Array) -> pa.Array:
        out = []
        for t in text.to_pylist():
            if t is None:
                out.append(None)
                continue
            t = (camel.sub(r"\1 \2", t) if cfg.split_camel_case else t).translate(fold)
            out.append([p if not i else "##" + p for w in token.findall(t) for i, p in enumerate(piece.findall(w))])
        return pa.array(out, pa.list_(pa.string()))

    return run


def lookup(tokens: list[str], ids: list[int], default: int = 0):
    """An Arrow UDF that maps arrays of pieces to arrays of ids, vectorized over the flat values."""
    keys, values = pa.array(tokens, pa.string()), pa.array(ids, pa.int32())

    @F.arrow_udf("array<int>")
    def run(pieces: pa.Array) -> pa.Array:
        flat = pieces.flatten()
        found = pc.take(values, pc.index_in(flat, value_set=keys))
        found = pc.fill_null(found, default)
        lengths = pc.fill_null(pc.list_value_length(pieces), 0).to_numpy(zero_copy_only=False)
        offsets = pa.array([0, *lengths.cumsum().tolist()], pa.int32())
        out = pa.ListArray.from_arrays(offsets, found, mask=pieces.is_null()) if pieces.null_count else pa.ListArray.from_arrays(offsets, found)
        return out

    return run


def _outside(known: list[str]) -> str:
    return f"[^ {''.join(_escape(c) for c in sorted(known))}]"


def unseen_pieces(text: Column, subwords: list[str], known: list[str], cfg: BpeConfig = APP_BPE) -> Column:
    """The different pieces of a text without an id, in order of first appearance.

    Pieces without an id are single characters.  If the characters of all
    subwords are subwords too, which training provides for, no longer piece
    holds such a character, so it is enough to look for the characters; a
    vocabulary from elsewhere without that takes the pieces themselves.
    """
    held = set(known)
    if any(c not in held or f"##{c}" not in held for s in subwords for c in s):
        return F.array_distinct(F.filter(piece_array(text, longest_match_pattern(subwords), cfg), lambda p: ~p.isin(known)))
    words = F.concat(F.lit(" "), F.array_join(normalized_tokens(text, cfg), " "))
    first, later = ([t for t in held if len(t) == 1], [t[2:] for t in held if len(t) == 3 and t.startswith("##")])
    found = F.array_distinct(F.regexp_extract_all(words, F.lit(f"(?s) {_outside(first)}|(?<! ){_outside(later)}"), F.lit(0)))
    return F.transform(found, lambda p: F.when(p.startswith(" "), F.substring(p, 2, 2)).otherwise(F.concat(F.lit("##"), p)))


def oov_ids(corpus: DataFrame, subwords: list[str], model: DataFrame, cfg: BpeConfig = APP_BPE) -> DataFrame:
    """(id, token) of the pieces of a corpus (doc_id, text) without an id, numbered after the model in order of first appearance.

    Their number is bounded by the alphabet.
    """
    known = [r.token for r in model.select("token").collect()]  # bounded by the word limit
    rows = corpus.select("doc_id", F.posexplode(unseen_pieces(F.col("text"), subwords, known, cfg)).alias("pos", "token"))
    fresh = rows.groupBy("token").agg(F.min(F.struct("doc_id", "pos")).alias("at"))
    return fresh.select((F.row_number().over(Window.orderBy("at")) - 1 + len(known)).cast("int").alias("id"), "token")


def all_ids(corpus: DataFrame, subwords: list[str], model: DataFrame, cfg: BpeConfig = APP_BPE) -> list[tuple[int, str]]:
    """(id, token) of the model and, if they are preserved, of the unseen pieces; bounded by the word limit and the alphabet."""
    rows = model.select("id", "token")
    if cfg.preserve_unknown:
        rows = rows.unionAll(oov_ids(corpus, subwords, model, cfg))
    return [(int(r.id), r.token) for r in rows.collect()]


def encode(corpus: DataFrame, subwords: list[str], model: DataFrame, cfg: BpeConfig = APP_BPE, *more: Column) -> DataFrame:
    """(doc_id, pieces, ids) and any more columns of the corpus: static ids, then those of unseen pieces if they are preserved, else 0."""
    rows = all_ids(corpus, subwords, model, cfg)
    return tokenize(corpus, subwords, cfg, *more).withColumn("ids", lookup([t for _, t in rows], [i for i, _ in rows])("pieces"))


def join_pieces(pieces: Column) -> Column:
    """Text of decoded tokens: no blank before continuations and single punctuation marks, which connectors are too.

    Tokens hold no blanks, so the rules can work on the joined text.
    """
    joined = F.array_join(pieces, " ")
    tight = F.regexp_replace(joined, f" ([{PUNCT}])(?= |$)", "$1")
    return F.regexp_replace(tight, "(^| )##", "")


def id_tokens(model_rows: list[tuple[int, str]], unknown: str = "<unk>"):
    """An Arrow UDF from arrays of ids back to arrays of tokens."""
    known = dict(model_rows)
    size = max(known, default=-1) + 1
    values = pa.array([known.get(i, unknown) for i in range(size)] + [unknown], pa.string())

    @F.arrow_udf("array<string>")
    def run(ids: pa.Array) -> pa.Array:
        flat = ids.flatten()
        inside = pc.and_(pc.greater_equal(flat, 0), pc.less(flat, size))
        found = pc.take(values, pc.fill_null(pc.if_else(inside, flat, size), size))
        lengths = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False)
        offsets = pa.array([0, *lengths.cumsum().tolist()], pa.int32())
        return pa.ListArray.from_arrays(offsets, found, mask=ids.is_null()) if ids.null_count else pa.ListArray.from_arrays(offsets, found)

    return run


def decode(encoded: DataFrame, model_rows: list[tuple[int, str]], unknown: str = "<unk>") -> DataFrame:
    """(doc_id, decoded) from (doc_id, ids)."""
    return encoded.select("doc_id", join_pieces(id_tokens(model_rows, unknown)("ids")).alias("decoded"))
