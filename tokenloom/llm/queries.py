"""Registry of the queries over training data (problems 1-3 and 5-10)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import formatcopies, leakage, lookalike, mojibake, nearcopies, packing, quality, sharedspans, termstats
from .frames import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _essays(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "training_essay_data")


@_query
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = lookalike.same_looking_pairs(_essays(spark, d))
    return pairs.select(F.col("id_a").alias("essay_id_a"), F.col("id_b").alias("essay_id_b"))


@_query
def p1_groups(spark: SparkSession, d: str) -> DataFrame:
    """One row per essay that takes part: the class of what looks the same and its number of different strings."""
    return lookalike.same_looking_groups(_essays(spark, d)).withColumnRenamed("id", "essay_id")


@_query
def p1_form(spark: SparkSession, d: str) -> DataFrame:
    forms = lookalike.with_form(_essays(spark, d))
    return forms.select(F.col("id").alias("essay_id"), "form").distinct()


@_query
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return formatcopies.copy_pairs(_essays(spark, d))


@_query
def p2_copies(spark: SparkSession, d: str) -> DataFrame:
    return formatcopies.copies(_essays(spark, d))


@_query
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.damaged_records(_essays(spark, d), table(spark, d, "tokenization_result")).select("record_set", "record_id")


@_query
def p3_restored(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.damaged_records(_essays(spark, d), table(spark, d, "tokenization_result"))


@_query
def p3_restoration(spark: SparkSession, d: str) -> DataFrame:
    """How much of sound essays damaged on purpose is found and restored exactly, by pair of encodings."""
    return mojibake.restoration(_essays(spark, d))


@_query
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = nearcopies.near_copy_pairs(_essays(spark, d), k=3, threshold=0.6)
    return pairs.select(F.col("id_a").alias("essay_id_a"), F.col("id_b").alias("essay_id_b"))


@_query
def p5_groups(spark: SparkSession, d: str) -> DataFrame:
    """One row per essay that takes part: its class and the class's number of links to other classes."""
    links, members = nearcopies.near_copies(_essays(spark, d), k=3, threshold=0.6)
    ends = links.select(F.col("a").alias("cid")).unionAll(links.select("b")).groupBy("cid").agg(F.count(F.lit(1)).alias("n_links"))
    return members.join(ends, "cid", "left").select(F.col("id").alias("essay_id"), F.col("cid").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


@_query
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return quality.quality(_essays(spark, d)).where("not prose").select(F.col("id").alias("essay_id"))


@_query
def p6_statistics(spark: SparkSession, d: str) -> DataFrame:
    return quality.quality(_essays(spark, d)).withColumnRenamed("id", "essay_id")


@_query
def p6_plain_statistics(spark: SparkSession, d: str) -> DataFrame:
    """The statistics that need no knowledge of other texts, of the documents as they stand."""
    return quality.plain_statistics(table(spark, d, "documents")).withColumnRenamed("id", "doc_id")


@_query
def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return termstats.term_counts(table(spark, d, "word_symbols")).where("mark is not null").select(F.col("term").alias("symbol"), "mark")


@_query
def p7_terms(spark: SparkSession, d: str) -> DataFrame:
    return termstats.term_counts(table(spark, d, "word_symbols")).withColumnRenamed("term", "symbol")


@_query
def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return packing.split_documents(table(spark, d, "documents"), table(spark, d, "context_windows"))


@_query
def p8_packing(spark: SparkSession, d: str) -> DataFrame:
    return packing.packed(table(spark, d, "documents"), table(spark, d, "context_windows"))


@_query
def p8_covered(spark: SparkSession, d: str) -> DataFrame:
    """Per capacity and document the tokens packed and the number of pieces."""
    packed = packing.packed(table(spark, d, "documents"), table(spark, d, "context_windows"))
    return packed.groupBy("window_key", "doc_id").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("pieces"))


@_query
def p8_windows(spark: SparkSession, d: str) -> DataFrame:
    """Per capacity the tokens packed, the least number of windows that could hold them, and whether all windows hold what they may and at most 1 % more of them were opened."""
    windows = table(spark, d, "context_windows").select("window_key", F.col("capacity").cast("long").alias("capacity"))
    packed = packing.packed(table(spark, d, "documents"), windows)
    used = packed.groupBy("window_key", "window_id").agg(F.sum("tokens").alias("t"))
    sums = used.groupBy("window_key").agg(F.count(F.lit(1)).alias("n"), F.sum("t").alias("tokens"), F.max("t").alias("fullest")).join(F.broadcast(windows), "window_key")
    bound = F.ceil(F.col("tokens") / F.col("capacity")).cast("long")
    return sums.select("window_key", "tokens", bound.alias("lower_bound"), (F.col("fullest") <= F.col("capacity")).alias("all_fit"), (F.col("n") <= F.ceil(1.01 * bound)).alias("close"))


@_query
def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).select("item_id", "doc_id")


@_query
def p9_leaks(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


@_query
def p10_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = sharedspans.sharing_pairs(table(spark, d, "documents"))
    return pairs.select(F.col("id_a").alias("doc_id_a"), F.col("id_b").alias("doc_id_b"))


@_query
def p10_repeats(spark: SparkSession, d: str) -> DataFrame:
    """The maximal repeats of two documents: where they begin in each, and how long they are."""
    spans = sharedspans.maximal_repeats(table(spark, d, "documents"))
    return spans.select(F.col("id_a").alias("doc_id_a"), F.col("id_b").alias("doc_id_b"), "begin_a", "begin_b", "length")


@_query
def p10_shared_part(spark: SparkSession, d: str) -> DataFrame:
    return sharedspans.shared_part(table(spark, d, "documents")).withColumnRenamed("id", "doc_id")


_COUNTED = """
    select ws_id, max_by(freq, freq) as freq, any_value(symbols) as symbols from (
        select ws_id, freq, list_filter(symbols, lambda x: x is not null) as symbols from word_symbols where freq > 0
    ) where len(symbols) > 0 group by ws_id
"""
_TERMS = f"""
    with counted as ({_COUNTED}), places as (select ws_id, freq, unnest(symbols) as symbol from counted),
    sums as (select symbol, cast(sum(freq) as bigint) as occurrences, count(distinct ws_id) as records from places group by symbol)
    select symbol, occurrences, records, case when occurrences < 10 then 'rare' when records > 0.05 * (select count(*) from counted) then 'common' end as mark from sums
"""
ORACLES["p7_terms"] = _TERMS
ORACLES["p7_found"] = f"select symbol, mark from ({_TERMS}) where mark is not null"
_SIZES = "(select doc_id, min(coalesce(cast(n_tokens as bigint), strlen(text) + 1)) as tokens from documents where doc_id is not null group by doc_id)"
ORACLES["p8_found"] = f"select window_key, doc_id from {_SIZES} s, context_windows w where s.tokens > w.capacity"
ORACLES["p8_covered"] = f"select window_key, doc_id, tokens, cast(ceil(tokens / capacity) as bigint) as pieces from {_SIZES} s, context_windows w where tokens > 0"
ORACLES["p8_windows"] = f"""select window_key, cast(sum(tokens) as bigint) as tokens, cast(ceil(sum(tokens) / max(capacity)) as bigint) as lower_bound, true as all_fit, true as close
    from {_SIZES} s, context_windows w where tokens > 0 group by window_key"""
ORACLES["p9_found"] = """
    with words as (select doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') as w from documents),
    runs as (select doc_id, array_to_string(w[i : i + 11], ' ') as run from (select doc_id, w, unnest(range(1, len(w) - 10)) as i from words)),
    items as (select item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') as w from eval_items),
    item_runs as (select item_id, array_to_string(w[i : i + 11], ' ') as run from (select item_id, w, unnest(range(1, len(w) - 10)) as i from items))
    select distinct item_id, doc_id from runs join item_runs using (run)
"""

_SPACE = "".join(f"\\x{{{c:x}}}" for c in quality.SPACE)
_SIGNS = "".join(f"\\x{{{ord(c):x}}}" for c in quality.PLAIN)
_ENDS = "".join(f"\\x{{{ord(c):x}}}" for c in quality.END)
ORACLES["p6_plain_statistics"] = f"""
    with once as (select doc_id, min(text) as text from documents where doc_id is not null and text is not null group by doc_id),
    marked as (select *, cast(len(regexp_extract_all(text, '{quality.BULLET}')) as double) as marks, lower(regexp_replace(text, '{quality.BULLET}', '', 'g')) as body from once),
    parts as (select *, regexp_extract_all(body, '[\\p{{L}}\\p{{N}}]+') as words, list_filter(string_split(body, chr(10)), lambda l: regexp_matches(l, '[^{_SPACE}]')) as lines,
        length(regexp_replace(body, '[{_SPACE}]+', '', 'g')) as ink from marked),
    counts as (select *, cast(len(words) as bigint) as n_words, greatest(len(words), 1) as per_word, greatest(len(lines), 1) as n_lines from parts)
    select doc_id, n_words, round(coalesce(list_sum(list_transform(words, lambda w: length(w))), 0) / per_word, 6) as mean_word_length,
        round(length(regexp_replace(body, '[\\p{{L}}\\p{{N}}{_SPACE}{_SIGNS}]+', '', 'g')) / cast(greatest(ink, 1) as double), 6) as symbol_ratio,
        round(len(list_filter(words, lambda w: regexp_matches(w, '[^0-9]'))) / cast(per_word as double), 6) as letter_words,
        round(len(list_filter(lines, lambda l: regexp_matches(l, '[{_ENDS}][{_SPACE}]*$'))) / cast(n_lines as double), 6) as lines_ending_in_punctuation,
        round(least(marks / n_lines, 1), 6) as bullet_lines from counts
""".replace("\\\\", "\\")

_LEAST = sharedspans.LEAST
_WINDOWS = f"""windows as materialized (select doc_id, i, hash(substring(text, cast(i as bigint), {_LEAST})) as g from (
        select doc_id, text, unnest(range(1, length(text) - {_LEAST - 2})) as i from documents where doc_id is not null and length(text) >= {_LEAST})),
    shared as materialized (select doc_id, i, g from windows where g in (select g from windows group by g having count(distinct doc_id) > 1)),
    hits as materialized (select distinct x.doc_id as a, y.doc_id as b, x.i as i, y.i as j from shared x join shared y using (g) where x.doc_id < y.doc_id)"""
ORACLES["p10_found"] = f"with {_WINDOWS} select distinct a as doc_id_a, b as doc_id_b from hits"
ORACLES["p10_repeats"] = f"""with {_WINDOWS},
    runs as (select a, b, i - j as diagonal, i, i - row_number() over (partition by a, b, i - j order by i) as run from hits)
    select a as doc_id_a, b as doc_id_b, cast(min(i) - 1 as integer) as begin_a, cast(min(i) - diagonal - 1 as integer) as begin_b, cast(max(i) - min(i) + {_LEAST} as integer) as length from runs group by a, b, diagonal, run"""
ORACLES["p10_shared_part"] = f"""with {_WINDOWS},
    steps as (select doc_id, i, lag(i) over (partition by doc_id order by i) as last from (select distinct doc_id, i from shared)),
    covered as (select doc_id, cast(sum(least({_LEAST}, coalesce(i - last, {_LEAST}))) as bigint) as shared_chars from steps group by doc_id)
    select doc_id, n_chars, coalesce(shared_chars, 0) as shared_chars, case when n_chars > 0 then round(coalesce(shared_chars, 0) / n_chars, 6) else 0.0 end as shared_part
    from (select doc_id, cast(max(length(text)) as bigint) as n_chars from documents where doc_id is not null and text is not null group by doc_id) left join covered using (doc_id)"""

_RUNS = ORACLES["p9_found"].split("select distinct item_id")[0]
ORACLES["p9_leaks"] = f"{_RUNS} select item_id, doc_id, cast(count(distinct run) as bigint) as stretches from runs join item_runs using (run) group by item_id, doc_id"
