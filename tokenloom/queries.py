"""Registry of the queries outside ``llm`` and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import chars
from .functions.chars import PUNCT, WS_BPE, WS_SP
from .operators import bpe, charcodec, container, pretokenize, unigram
from .plans import pipeline
from .plans.config import APP_BPE, APP_SP, BpeConfig, CodecConfig, SpConfig
from .sources import corpus as corpora
from .sources import models, strictcsv

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _query(oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def _spread(df: DataFrame) -> DataFrame:
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def _docs(spark: SparkSession, d: str, *more: str) -> DataFrame:
    return _spread(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text", *more))


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# --- pre-tokens -----------------------------------------------------------

_CAMEL = "regexp_replace(text, '([a-z])([A-Z])', '\\1 \\2', 'g')"
_ALL = f"[{PUNCT}]|[^{WS_BPE}{PUNCT}]+"


def _unnested(pattern: str, text: str = _CAMEL, source: str = "documents") -> str:
    array = f"regexp_extract_all({text}, '{pattern}')"
    return f"(select *, unnest(list_zip(range(len(ts)), ts)) as z from (select *, {array} as ts from {source} where text is not null))"


def _tokens_sql(source: str) -> str:
    token = f"trim(translate(z[2], '{chars.UPPER}', '{chars.LOWER}'), ' ')"
    return f"(select doc_id, lang, cast(z[1] as integer) as pos, {token} as token, regexp_matches(z[2], '^[{PUNCT}]$') as is_punct from {_unnested(_ALL, source=source)})"


_TOKENS = _tokens_sql("documents")
_WORDS = f"(select * from {_TOKENS} where not is_punct and token <> '')"


@_query("select doc_id, cast(ceil(octet_length(encode(text)) / 4.0) as bigint) as approx from documents where text is not null")
def approx_tokens(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).where("text is not null").select("doc_id", chars.approx_tokens(F.col("text")).alias("approx"))


def _pretokens(spark: SparkSession, d: str, cfg: BpeConfig = APP_BPE, *more: str) -> DataFrame:
    rows = _docs(spark, d, *more).select("doc_id", *more, F.posexplode(pretokenize.normalized_tokens(F.col("text"), cfg)).alias("pos", "token"))
    return rows.withColumn("is_punct", pretokenize.is_punct_token(F.col("token"), cfg))


@_query(f"select doc_id, pos, token, is_punct from {_TOKENS}")
def pretokenize_tokens(spark: SparkSession, d: str) -> DataFrame:
    return _pretokens(spark, d)


@_query(f"select token, count(*) as n, count(distinct doc_id) as n_docs from {_TOKENS} group by token")
def pretoken_counts(spark: SparkSession, d: str) -> DataFrame:
    per_doc = _pretokens(spark, d).groupBy("token", "doc_id").agg(F.count(F.lit(1)).alias("k"))
    return per_doc.groupBy("token").agg(F.sum("k").alias("n"), F.count(F.lit(1)).alias("n_docs"))


@_query(f"select lang, count(*) as n_tokens, cast(count(*) filter (where is_punct) as bigint) as n_punct, count(distinct token) as n_types from {_TOKENS} group by lang")
def pretoken_by_lang(spark: SparkSession, d: str) -> DataFrame:
    """Aggregates each (language, token) first, so that distinct tokens never meet in one task."""
    each = _pretokens(spark, d, APP_BPE, "lang").groupBy("lang", "token").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_punct").alias("p"))
    return each.groupBy("lang").agg(F.sum("n").alias("n_tokens"), F.sum("p").alias("n_punct"), F.count(F.lit(1)).alias("n_types"))


@_query(f"select doc_id, cast(count(*) as bigint) as n_words from {_unnested(f'[^{WS_BPE}{PUNCT}]+')} group by doc_id")
def pretokenize_drop_punct(spark: SparkSession, d: str) -> DataFrame:
    words = pretokenize.pretoken_strings(F.col("text"), BpeConfig(keep_punctuation=False))
    return _docs(spark, d).select("doc_id", F.size(words).cast("long").alias("n_words")).where("n_words > 0")


@_query(f"select doc_id, cast(count(*) as bigint) as n_words, cast(max(length(z[2])) as bigint) as longest from {_unnested(f'[^{WS_BPE}]+')} group by doc_id")
def pretokenize_no_split(spark: SparkSession, d: str) -> DataFrame:
    words = pretokenize.pretoken_strings(F.col("text"), BpeConfig(split_on_punctuation=False))
    sizes = F.array_max(F.transform(words, lambda w: F.length(w))).cast("long")
    return _docs(spark, d).select("doc_id", F.size(words).cast("long").alias("n_words"), sizes.alias("longest")).where("n_words > 0")


@_query(f"select token as word, count(*) as freq from {_WORDS} group by token")
def word_type_counts(spark: SparkSession, d: str) -> DataFrame:
    return bpe.word_types(_pretokens(spark, d).where("not is_punct and token <> ''").withColumnRenamed("token", "word"))


@_query("select prompt_key, count(*) as n_essays, cast(sum(ceil(octet_length(encode(text)) / 4.0)) as bigint) as approx from training_essay_data where text is not null group by prompt_key")
def essay_token_budget(spark: SparkSession, d: str) -> DataFrame:
    """Token budget by prompt; partial sums keep the largest prompt from meeting in one task."""
    rows = _table(spark, d, "training_essay_data").where("text is not null")
    return rows.groupBy("prompt_key").agg(F.count(F.lit(1)).alias("n_essays"), F.sum(chars.approx_tokens(F.col("text"))).alias("approx"))


# --- pair merging ---------------------------------------------------------

_LIMIT = APP_BPE.word_limit
_FIRST_ROWS = f"(select * from documents where text is not null and length(text) > 0 order by doc_id limit {_LIMIT})"
_TRAIN = f"(select token as word from {_tokens_sql(_FIRST_ROWS)} where not is_punct and token <> '' order by doc_id, pos limit {_LIMIT})"
_TYPES = f"(select word, count(*) as freq from {_TRAIN} group by word)"
_SEEDS = f"(select word, freq, regexp_replace(word, '(.)', chr(1) || '\\1' || chr(2), 'gs') || chr(1) || '</w>' || chr(2) as s from {_TYPES})"
_PAIRS_OF = "(select l, r, count(*) as n from (select unnest(list_zip(a[:-2], a[2:])) as p, p[1] as l, p[2] as r from (select regexp_extract_all(s, '\\x01([^\\x02]*)\\x02', 1) as a from {0}) where len(a) > 1) group by l, r)"


def _types(spark: SparkSession, d: str) -> DataFrame:
    return bpe.word_types(bpe.training_words(_docs(spark, d)))


@_query(f"select l, r, n from {_PAIRS_OF.format(_SEEDS)}")
def bpe_pair_counts(spark: SparkSession, d: str) -> DataFrame:
    return bpe.pair_counts(bpe.seed_symbols(_types(spark, d)))


@_query(f"select l, r, n from {_PAIRS_OF.format(_SEEDS)} where n >= 2 order by n desc, l, r limit 1")
def bpe_best_pair(spark: SparkSession, d: str) -> DataFrame:
    return bpe.best_pair(bpe.pair_counts(bpe.seed_symbols(_types(spark, d))))


_OLD, _NEW = "chr(1) || l || chr(2) || chr(1) || r || chr(2)", "chr(1) || l || r || chr(2)"


def _merged_sql(k: int) -> str:
    """Word types after up to k merges, as ``learnt``: each step counts all pairs anew, merges the best one, and ends when none occurs twice."""
    return f"""with recursive seeds as materialized (select word, freq, s from {_SEEDS}), w as (select 0 as k, word, freq, s from seeds union all select * from (
        with now as (select * from w), pair as (select l, r from {_PAIRS_OF.format("now")} where n >= 2 order by n desc, l, r limit 1)
        select k + 1 as k, word, freq, replace(s, {_OLD}, {_NEW}) as s from now, pair where k < {k})),
    learnt as materialized (select word, freq, s from w where k = (select max(k) from w))"""


_K = APP_BPE.merge_ops
_SYMBOLS = "regexp_extract_all(s, '\\x01([^\\x02]*)\\x02', 1)"
_HARVEST = f"(select distinct x as subword from (select unnest(regexp_extract_all(word, '(?s).')) as x from learnt union all select regexp_replace(unnest({_SYMBOLS}), '</w>$', '') from learnt) where x <> '')"


@_query(f"{_merged_sql(_K)} select word, freq, array_to_string({_SYMBOLS}, ' ') as symbols from learnt")
def bpe_merges_k(spark: SparkSession, d: str) -> DataFrame:
    done = bpe.segment_types(_types(spark, d))
    return done.select("word", "freq", F.array_join("symbols", " ").alias("symbols"))


@_query(f"{_merged_sql(1)} select word, array_to_string({_SYMBOLS}, ' ') as symbols from learnt")
def bpe_merge_step(spark: SparkSession, d: str) -> DataFrame:
    seeds = bpe.seed_symbols(_types(spark, d))
    pair = bpe.best_pair(bpe.pair_counts(seeds)).first()
    merged = bpe.merge_pair(seeds, pair.l, pair.r) if pair else seeds
    return merged.select("word", F.array_join("symbols", " ").alias("symbols"))


@_query(f"{_merged_sql(_K)} select subword, cast(length(subword) as bigint) as n_chars from {_HARVEST}")
def bpe_vocab_k(spark: SparkSession, d: str) -> DataFrame:
    return _vocab(spark, d).select("subword", chars.char_count(F.col("subword")).alias("n_chars"))


_MARKS = ", ".join(f"({(1 << 30) + i + 1}, '{m.replace(chr(39), chr(39) * 2)}')" for i, m in enumerate(bpe.STATIC_MARKS))
_IDS = f"""(select cast(row_number() over (order by o) - 1 as bigint) as id, token from (select token, min(o) as o from (
    select -1 as o, '<unk>' as token union all
    select 2 * k, subword from ranked union all select 2 * k + 1, '##' || subword from ranked union all
    select * from (values {_MARKS}) m(o, token)) group by token))"""
_RANKED = f"ranked as (select subword, row_number() over (order by octet_length(encode(subword)) desc, subword) as k from {_HARVEST})"


def _vocab(spark: SparkSession, d: str) -> DataFrame:
    """The vocabulary trained on all documents with the application's settings."""
    return bpe.train(_docs(spark, d))


def _subwords(vocab: DataFrame) -> list[str]:
    return [r.subword for r in vocab.collect()]


@_query(f"{_merged_sql(_K)}, {_RANKED} select id, token from {_IDS}")
def bpe_id_map(spark: SparkSession, d: str) -> DataFrame:
    return bpe.id_map(_vocab(spark, d)).select(F.col("id").cast("long").alias("id"), "token")


@_query(f"{_merged_sql(_K)}, {_RANKED} select 1 + 20 + 2 * count(*) - (select count(*) from ranked where subword in ({', '.join(repr(m) if m != chr(39) else chr(39) * 4 for m in bpe.STATIC_MARKS)})) as vocab_size from ranked")
def bpe_vocab_size(spark: SparkSession, d: str) -> DataFrame:
    """Ids of the model: the unknown piece, subwords and their continuations, and the marks that are no subwords."""
    return bpe.id_map(_vocab(spark, d)).agg(F.count(F.lit(1)).alias("vocab_size"))


# Greedy longest match in SQL: an ordered alternation of the vocabulary trained in the same statement.
_NORMAL = f"list_filter(list_transform(regexp_extract_all({_CAMEL}, '{_ALL}'), lambda t: trim(translate(t, '{chars.UPPER}', '{chars.LOWER}'), ' ')), lambda t: t <> '')"
_SPLIT = "list_transform(regexp_extract_all({0}, (select p from scan)), lambda x: case when x like ' %' then x[2:] else '##' || x end)"
_TRAINED = f"""{_merged_sql(_K)}, {_RANKED}, ids as materialized (select * from {_IDS}),
    scan as materialized (select '(?s) ?(?:' || string_agg(subword, '|' order by length(subword) desc, subword) || '|[^ ])' as p from ranked),
    pieces as materialized (select doc_id, lang, ts, {_SPLIT.format("' ' || array_to_string(ts, ' ')")} as ps from (select doc_id, lang, {_NORMAL} as ts from documents)),
    flat as materialized (select doc_id, lang, unnest(ps) as piece, cast(generate_subscripts(ps, 1) - 1 as integer) as pos from pieces),
    oov as (select piece as token, (select count(*) from ids) - 1 + row_number() over (order by at_doc, at_pos) as id from (
        select piece, min(doc_id) as at_doc, arg_min(pos, struct_pack(a := doc_id, b := pos)) as at_pos from flat where piece not in (select token from ids) group by piece)),
    known as (select token, id from ids union all select token, id from oov)"""
_PER_DOC = "select d.doc_id, case when d.text is not null then coalesce(x.v, '') end as {0} from documents d left join ({1}) x using (doc_id)"


@_query(f"{_TRAINED} select word, array_to_string({_SPLIT.format(chr(39) + ' ' + chr(39) + ' || word')}, ' ') as pieces from (select distinct token as word from {_WORDS})")
def bpe_word_segments(spark: SparkSession, d: str) -> DataFrame:
    words = _pretokens(spark, d).where("not is_punct and token <> ''").select(F.col("token").alias("word")).distinct()
    return words.select("word", F.array_join(bpe.word_pieces(F.col("word"), bpe.longest_match_pattern(_subwords(_vocab(spark, d)))), " ").alias("pieces"))


@_query(f"{_TRAINED} {_PER_DOC.format('pieces', 'select doc_id, string_agg(piece, chr(32) order by pos) as v from flat group by doc_id')}")
def bpe_tokenize(spark: SparkSession, d: str) -> DataFrame:
    return bpe.tokenize(_docs(spark, d), _subwords(_vocab(spark, d))).select("doc_id", F.array_join("pieces", " ").alias("pieces"))


def _encoded(spark: SparkSession, d: str, cfg: BpeConfig = APP_BPE) -> DataFrame:
    vocab = _vocab(spark, d)
    return bpe.encode(_docs(spark, d), _subwords(vocab), bpe.id_map(vocab), cfg)


@_query(f"{_TRAINED} {_PER_DOC.format('ids', 'select doc_id, string_agg(cast(id as varchar), chr(32) order by pos) as v from flat join known on piece = token group by doc_id')}")
def bpe_encode(spark: SparkSession, d: str) -> DataFrame:
    return _encoded(spark, d).select("doc_id", F.array_join(F.col("ids").cast("array<string>"), " ").alias("ids"))


@_query(f"""{_TRAINED}, per_doc as (select doc_id, count(*) as n, count(*) filter (where piece not in (select token from ids)) as u from flat group by doc_id)
    select d.doc_id, case when d.text is not null then cast(coalesce(n, 0) as bigint) end as n_ids, case when d.text is not null then cast(coalesce(u, 0) as bigint) end as n_unknown from documents d left join per_doc using (doc_id)""")
def bpe_encode_plain(spark: SparkSession, d: str) -> DataFrame:
    """Unknown pieces not preserved: they have id 0."""
    ids = _encoded(spark, d, BpeConfig(preserve_unknown=False))
    size = lambda c: F.when(F.col("ids").isNotNull(), F.size(c).cast("long"))
    return ids.select("doc_id", size(F.col("ids")).alias("n_ids"), size(F.filter("ids", lambda i: i == 0)).alias("n_unknown"))


@_query(f"{_TRAINED} select cast(id as bigint) as id, token from oov")
def bpe_oov_ids(spark: SparkSession, d: str) -> DataFrame:
    vocab = _vocab(spark, d)
    return bpe.oov_ids(_docs(spark, d), _subwords(vocab), bpe.id_map(vocab)).select(F.col("id").cast("long").alias("id"), "token")


@_query(f"{_TRAINED} select piece, count(*) as n from flat group by piece")
def bpe_token_freq(spark: SparkSession, d: str) -> DataFrame:
    return bpe.tokenize(_docs(spark, d), _subwords(_vocab(spark, d))).select(F.explode("pieces").alias("piece")).groupBy("piece").agg(F.count(F.lit(1)).alias("n"))


_SPOKEN = f"case when pos = 0 or piece like '##%' or regexp_matches(piece, '^[{PUNCT}]$') then regexp_replace(piece, '^##', '') else ' ' || piece end"


@_query(f"{_TRAINED} {_PER_DOC.format('decoded', f'select doc_id, string_agg({_SPOKEN}, repeat(chr(32), 0) order by pos) as v from flat group by doc_id')}")
def bpe_decode(spark: SparkSession, d: str) -> DataFrame:
    """Ids back to text; the ids of unseen pieces are known to the decoder too."""
    docs, vocab = _docs(spark, d), _vocab(spark, d)
    subwords = _subwords(vocab)
    rows = bpe.all_ids(docs, subwords, bpe.id_map(vocab))
    encoded = bpe.tokenize(docs, subwords).select("doc_id", bpe.lookup([t for _, t in rows], [i for i, _ in rows])("pieces").alias("ids"))
    return bpe.decode(encoded, rows)


@_query(f"""{_TRAINED} select lang, round(cast(sum(len(ps)) as double) / sum(len(ws)), 9) as fertility from (
    select lang, ws, {_SPLIT.format("' ' || array_to_string(ws, ' ')")} as ps from (select lang, list_filter(ts, lambda t: not regexp_matches(t, '^[{PUNCT}]$')) as ws from pieces) where len(ws) > 0) group by lang""")
def bpe_fertility_by_lang(spark: SparkSession, d: str) -> DataFrame:
    """Pieces per word by language."""
    cfg = BpeConfig(keep_punctuation=False)
    words = pretokenize.normalized_tokens(F.col("text"), cfg)
    pieces = bpe.piece_array(F.col("text"), bpe.longest_match_pattern(_subwords(_vocab(spark, d))), cfg)
    per_doc = _docs(spark, d, "lang").where("text is not null").select("lang", F.size(pieces).alias("pieces"), F.size(words).alias("words")).where("words > 0")
    return per_doc.groupBy("lang").agg(F.round(F.sum("pieces").cast("double") / F.sum("words"), 9).alias("fertility"))


@_query(f"""{_TRAINED}, per_doc as (select doc_id, string_agg(piece, ' ' order by pos) as v, string_agg(cast(id as varchar), ' ' order by pos) as i, string_agg({_SPOKEN}, '' order by pos) as t from flat join known on piece = token group by doc_id)
    select d.doc_id, cast(ceil(octet_length(encode(d.text)) / 4.0) as bigint) as approx, case when d.text is not null then coalesce(v, '') end as pieces, case when d.text is not null then coalesce(i, '') end as ids,
        case when d.text is not null then coalesce(t, '') end as decoded, (select count(*) from ids) as vocab_size from documents d left join per_doc using (doc_id)""")
def bpe_train_encode(spark: SparkSession, d: str) -> DataFrame:
    """The whole way with the default settings: train, tokenize, encode, decode, report."""
    docs = _docs(spark, d)
    out = pipeline.bpe_results(docs, bpe.train(docs))
    return out.withColumn("pieces", F.array_join("pieces", " ")).withColumn("ids", F.array_join(F.col("ids").cast("array<string>"), " "))


# --- unigram --------------------------------------------------------------

_BARE = f"regexp_replace(text, '^[{WS_SP}]+|[{WS_SP}]+$', '', 'g')"
_NORM_BODY = f"translate(regexp_replace(regexp_replace({_BARE}, '([a-z])([A-Z])', '\\1▁\\2', 'g'), '[{WS_SP}]+', '▁', 'g'), '{chars.UPPER}', '{chars.LOWER}')"
_NORM = f"(select doc_id, case when length(b) = 0 then '' else '▁' || b end as norm from (select doc_id, {_NORM_BODY} as b from documents where text is not null))"
_SP_ROWS = _NORM.replace("from documents where text is not null", "from (select * from documents where text is not null and length(text) > 0 order by doc_id limit 25000)")


@_query(f"select doc_id, norm from {_NORM}")
def sp_normalize(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).where("text is not null").select("doc_id", unigram.normalize(F.col("text")).alias("norm"))


_SEED_CHARS = f"(select piece, n, round(ln(n / sum(n) over ()), 9) as log_prob from (select piece, count(*) as n from (select unnest(regexp_extract_all(norm, '(?s).')) as piece from {_SP_ROWS}) group by piece))"


@_query(f"select * from {_SEED_CHARS}")
def sp_seed_chars(spark: SparkSession, d: str) -> DataFrame:
    return unigram.seed_chars(unigram.training_rows(_docs(spark, d), SpConfig(row_limit=25_000))).withColumn("log_prob", F.round("log_prob", 9))


_GRAM_CHARS = APP_SP.max_piece_chars
# Texts are cut into overlapping stretches first, as substrings of long texts are slow.
_STRETCHES = f"(select substring(norm, 64 * i + 1, {64 + _GRAM_CHARS - 1}) as part from (select norm, unnest(range(0, cast(ceil(length(norm) / 64.0) as bigint))) as i from {_SP_ROWS}))"
_GRAMS = f"(select piece, count(*) as n from (select unnest(list_transform(range(1, least(64, length(part) - k + 1) + 1), lambda i: substring(part, i, k))) as piece from {_STRETCHES}, (select unnest(range(2, {_GRAM_CHARS + 1})) as k) where length(part) >= k) group by piece having count(*) >= 2)"


@_query(f"select piece, n from {_GRAMS}")
def sp_ngrams(spark: SparkSession, d: str) -> DataFrame:
    return unigram.ngram_counts(unigram.training_rows(_docs(spark, d), APP_SP), _GRAM_CHARS)


_SP_MODEL = f"""grams as materialized {_GRAMS}, seeds as materialized {_SEED_CHARS.replace("round(ln(n / sum(n) over ()), 9)", "ln(n / sum(n) over ())")},
    best as (select piece, n from grams order by n desc, octet_length(encode(piece)) desc, piece limit (select greatest({APP_SP.target_vocab} - 1 - count(*), 0) from seeds)),
    model as materialized (select cast(0 as bigint) as id, '<unk>' as piece, -20.0::double as log_prob union all
    select row_number() over (order by n desc, piece), piece, log_prob from seeds union all
    select (select count(*) from seeds) + row_number() over (order by n desc, octet_length(encode(piece)) desc, piece), piece, ln(n / (select sum(n) from grams)) from best)"""


@_query(f"with {_SP_MODEL} select id, piece, round(log_prob, 9) as log_prob from model")
def sp_model(spark: SparkSession, d: str) -> DataFrame:
    model = unigram.train(_docs(spark, d), APP_SP)
    return model.select(F.col("id").cast("long").alias("id"), "piece", F.round("log_prob", 9).alias("log_prob"))


def _sp(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, SpConfig]:
    docs = _docs(spark, d)
    return docs, unigram.train(docs, APP_SP), APP_SP


@_query(f"select doc_id, trim(replace(norm, '▁', ' '), ' ') as decoded from {_NORM}")
def sp_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Pieces back to the normalized text."""
    docs, model, cfg = _sp(spark, d)
    return unigram.encode(docs.where("text is not null"), model, cfg).select("doc_id", unigram.decode_pieces(F.col("pieces")).alias("decoded"))


# The cheapest way to each position of every item, worked out position by position: costs of the last positions, newest first, and the lengths of the last pieces.
_ITEM_NORM = _NORM.replace("doc_id", "item_id").replace("documents", "eval_items")
_WAYS = "list_transform(range(1, least(8, pos + 1) + 1), lambda k: costs[k] - coalesce(m[substring(norm, pos + 2 - k, k)], '-infinity'::double))"
_SP_ITEMS = f"""with recursive {_SP_MODEL}, scores as materialized (select map(list(piece), list(log_prob)) as m from model), texts as materialized (select item_id, norm from {_ITEM_NORM}),
    way as (select item_id, norm, 0 as pos, [0.0::double] as costs, []::integer[] as lens from texts union all
        select item_id, norm, pos + 1, list_prepend(cost, costs[:8]), list_append(lens, len) from (
            select item_id, norm, pos, costs, lens, case when least_cost < 'infinity'::double then least_cost else costs[1] + 20.0 end as cost,
                case when least_cost < 'infinity'::double then cast(len(ways) + 1 - list_position(list_reverse(ways), least_cost) as integer) else 1 end as len
            from (select *, list_min(ways) as least_cost from (select way.*, {_WAYS} as ways from way, scores where pos < length(norm))))),
    back as (select item_id, norm, lens, length(norm) as still, []::varchar[] as pieces from way where pos = length(norm) union all
        select item_id, norm, lens, still - lens[still], list_prepend(substring(norm, still - lens[still] + 1, lens[still]), pieces) from back where still > 0),
    cut as materialized (select item_id, pieces from back where still = 0),
    flat as materialized (select item_id, unnest(pieces) as piece, generate_subscripts(pieces, 1) as i from cut)"""


def _items(spark: SparkSession, d: str) -> DataFrame:
    """The evaluation items as a corpus: short enough for SQL to work out the cheapest way, too."""
    return _table(spark, d, "eval_items").where("text is not null").select(F.col("item_id").alias("doc_id"), "text")


def _encoded_items(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    _, model, cfg = _sp(spark, d)
    return unigram.encode(_items(spark, d), model, cfg), model


@_query(f"{_SP_ITEMS} select item_id, string_agg(piece, ' ' order by i) as pieces, string_agg(cast(coalesce(id, 0) as varchar), ' ' order by i) as ids from flat left join model using (piece) group by item_id")
def sp_encode_items(spark: SparkSession, d: str) -> DataFrame:
    """Pieces and ids of the evaluation items under the model trained on all documents."""
    encoded, _ = _encoded_items(spark, d)
    return encoded.select(F.col("doc_id").alias("item_id"), F.array_join("pieces", " ").alias("pieces"), F.array_join(F.col("ids").cast("array<string>"), " ").alias("ids"))


@_query(f"{_SP_ITEMS} select item_id, trim(replace(string_agg(case when id is null then '<unk>' else piece end, '' order by i), '▁', ' '), ' ') as decoded from flat left join model using (piece) group by item_id")
def sp_decode_items(spark: SparkSession, d: str) -> DataFrame:
    encoded, model = _encoded_items(spark, d)
    return unigram.decode_ids(encoded, model).select(F.col("doc_id").alias("item_id"), "decoded")


@_query(f"""{_SP_ITEMS} select item_id, array_to_string(list_filter(string_split(string_agg(case when piece like '▁%' then chr(1) || replace(piece, '▁', '') else replace(piece, '▁', '') end, '' order by i), chr(1)), lambda w: w <> ''), ' ') as words
    from flat group by item_id""")
def sp_display_items(spark: SparkSession, d: str) -> DataFrame:
    encoded, _ = _encoded_items(spark, d)
    return encoded.select(F.col("doc_id").alias("item_id"), F.array_join(unigram.display_pieces(F.col("pieces")), " ").alias("words"))


@_query()
def sp_encode_ids(spark: SparkSession, d: str) -> DataFrame:
    return unigram.encode(*_sp(spark, d))


@_query()
def sp_decode_ids(spark: SparkSession, d: str) -> DataFrame:
    docs, model, cfg = _sp(spark, d)
    return unigram.decode_ids(unigram.encode(docs, model, cfg), model)


@_query()
def sp_display(spark: SparkSession, d: str) -> DataFrame:
    """Pieces glued to words for display; a piece that holds a marker inside does not end a word."""
    docs, model, cfg = _sp(spark, d)
    pieces = unigram.encode(docs, model, cfg)
    return pieces.select("doc_id", unigram.display_pieces(F.col("pieces")).alias("words"))


@_query()
def sp_train_encode(spark: SparkSession, d: str) -> DataFrame:
    docs, model, cfg = _sp(spark, d)
    return pipeline.sp_results(docs, model, cfg)


# --- codecs ---------------------------------------------------------------

_CHUNK = 4096


def _bytes(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).where("text is not null").select(F.col("doc_id").alias("id"), F.encode("text", "UTF-8").alias("content"))


@_query("select cast(b as integer) as byte, count(*) as n from (select ('0x' || unnest(regexp_extract_all(hex(encode(text)), '..')))::integer as b from documents where text is not null) group by b")
def byte_histogram(spark: SparkSession, d: str) -> DataFrame:
    return container.byte_histogram(_bytes(spark, d))


_CHUNKS = f"(select doc_id, octet_length(encode(text)) as size, unnest(range(greatest(1, cast(ceil(octet_length(encode(text)) / {_CHUNK}.0) as bigint)))) as i from documents where text is not null)"


@_query(f"select doc_id as id, cast(i as integer) as chunk_idx, cast(least({_CHUNK}, size - i * {_CHUNK}) as bigint) as n_bytes from {_CHUNKS}")
def chunk_sizes(spark: SparkSession, d: str) -> DataFrame:
    return container.split(_bytes(spark, d), _CHUNK).select("id", "chunk_idx", F.octet_length("chunk").cast("long").alias("n_bytes"))


@_query("select doc_id as id, sha256(text) as h from documents where text is not null")
def chunk_roundtrip_hash(spark: SparkSession, d: str) -> DataFrame:
    return container.join(container.split(_bytes(spark, d), _CHUNK)).select("id", F.sha2("content", 256).alias("h"))


@_query("select doc_id as id, sha256(text) as h from documents where text is not null")
def lz_roundtrip_hash(spark: SparkSession, d: str) -> DataFrame:
    """Every document through compressed chunks, a container and back."""
    cfg = CodecConfig(chunk_size=_CHUNK)
    packed = container.containers(container.compressed_chunks(_bytes(spark, d), cfg), _CHUNK)
    return packed.select("id", F.sha2(container.decompress_column("container"), 256).alias("h"))


@_query(f"""select doc_id as id, '434C4D0100000000' as magic, cast(size as bigint) as original_bytes, cast(count(*) as bigint) as num_chunks, cast({24} as bigint) + 265 * count(*) as overhead
    from {_CHUNKS} group by doc_id, size""")
def container_header(spark: SparkSession, d: str) -> DataFrame:
    cfg = CodecConfig(chunk_size=_CHUNK)
    packed = container.containers(container.compressed_chunks(_bytes(spark, d), cfg), _CHUNK).withColumn("chunks", container.parse_column("container"))
    data = F.aggregate("chunks", F.lit(0).cast("long"), lambda a, c: a + F.octet_length(c["data"]))
    orig = F.aggregate("chunks", F.lit(0).cast("long"), lambda a, c: a + c["orig_size"])
    return packed.select("id", F.hex(F.substring("container", 1, 8)).alias("magic"), orig.alias("original_bytes"), F.size("chunks").cast("long").alias("num_chunks"), (F.octet_length("container") - data).alias("overhead"))


@_query()
def compression_stats(spark: SparkSession, d: str) -> DataFrame:
    return container.statistics(container.compressed_chunks(_bytes(spark, d)))


@_query(f"""select doc_id as id, cast(octet_length(encode(text)) as bigint) as original_bytes, cast(greatest(1, ceil(octet_length(encode(text)) / {float(CodecConfig.chunk_size)})) as bigint) as num_chunks,
    octet_length(encode(text)) as covered, true as size_of_container, true as shares_agree, octet_length(encode(text)) > 2000 as must_shrink from documents where text is not null""".replace("octet_length(encode(text)) as covered", "cast(octet_length(encode(text)) as bigint) as covered"))
def compression_laws(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of the statistics: sizes are those of the containers, tokens cover all bytes, shares follow from sizes, and long texts shrink."""
    folder = corpora.scratch(spark)
    container.compressed_chunks(_bytes(spark, d)).write.parquet(f"{folder}/chunks")  # compressed once, and not kept in memory
    chunks = spark.read.parquet(f"{folder}/chunks").where("id is not null")  # the same rows for the join and the tokens, so containers are put together once
    packed = container.containers(chunks)
    tokens = container.token_rows(packed).groupBy("id").agg(F.sum(F.when(F.col("flag") == 0, 1).otherwise(F.col("length"))).cast("long").alias("covered"), F.count_if(F.col("flag") == 0).alias("lits"), F.count_if(F.col("flag") == 1).alias("refs"))
    both = container.statistics(chunks).join(packed.select("id", F.octet_length("container").alias("held")), "id").join(tokens, "id", "left")
    counted = (F.coalesce("lits", F.lit(0)) == F.col("lz77_literals")) & (F.coalesce("refs", F.lit(0)) == F.col("lz77_refs"))
    share = F.col("compressed_bytes") / F.nullif("original_bytes", F.lit(0))
    agree = F.coalesce((F.abs(F.col("ratio") - share) < 1e-9) & (F.abs(F.col("saving_pct") - (1 - share) * 100) < 1e-6), F.col("ratio").isNull()) & counted
    must = (F.col("original_bytes") > 2000) & (F.col("ratio") < 1)
    laws = both.select("id", "original_bytes", "num_chunks", F.coalesce("covered", F.lit(0).cast("long")).alias("covered"), (F.col("held") == F.col("compressed_bytes")).alias("size_of_container"), agree.alias("shares_agree"), must.alias("must_shrink"))
    laws.write.parquet(f"{folder}/laws")
    corpora.remove(f"{folder}/chunks")
    return spark.read.parquet(f"{folder}/laws")


@_query("select doc_id as id, cast(octet_length(encode(text)) as bigint) as n_bytes from documents where text is not null and text <> ''")
def lz_token_cover(spark: SparkSession, d: str) -> DataFrame:
    """Tokens read back from the containers as rows: literals and reference lengths add up to the bytes, offsets stay within two bytes."""
    packed = container.containers(container.compressed_chunks(_bytes(spark, d)))
    tokens = container.token_rows(packed).where("offset < 65536")
    return tokens.groupBy("id").agg(F.sum(F.when(F.col("flag") == 0, 1).otherwise(F.col("length"))).cast("long").alias("n_bytes"))


@_query(f"select doc_id as id, cast(i as integer) as chunk_idx, case when size > 0 then 1.0::double else 0.0::double end as kraft from {_CHUNKS.replace(str(_CHUNK), str(CodecConfig.chunk_size))}")
def huffman_lengths(spark: SparkSession, d: str) -> DataFrame:
    """(id, chunk_idx, kraft): the code lengths of every chunk; a code that wastes nothing has a sum of 1."""
    lengths = F.transform(F.regexp_extract_all(F.hex("lengths"), F.lit("(..)"), F.lit(1)), lambda h: F.conv(h, 16, 10).cast("int"))
    kraft = F.aggregate(F.filter(lengths, lambda n: n > 0), F.lit(0.0), lambda a, n: a + F.pow(F.lit(2.0), -n))
    return container.compressed_chunks(_bytes(spark, d)).select("id", "chunk_idx", kraft.alias("kraft"))


@_query("""with recursive counts as (select doc_id, b, count(*) as k from (select doc_id, unnest(regexp_extract_all(hex(encode(text)), '..')) as b from documents where text is not null) group by doc_id, b),
    merged as (select doc_id, list_sort(list(k)) as l, cast(count(*) as bigint) as n, cast(case when count(*) = 1 then sum(k) else 0 end as bigint) as bits from counts group by doc_id union all
        select doc_id, list_sort(list_append(l[3:], l[1] + l[2])), n, bits + l[1] + l[2] from merged where len(l) > 1)
    select doc_id as id, n as n_symbols, bits from merged where len(l) = 1""")
def huffman_cost(spark: SparkSession, d: str) -> DataFrame:
    """Bits of every document under the prefix code of its bytes: no code has fewer."""
    return container.code_cost(_bytes(spark, d))


@_query("select doc_id as id, sha256(text) as h from documents where text is not null")
def charcodec_roundtrip_hash(spark: SparkSession, d: str) -> DataFrame:
    packed = _docs(spark, d).where("text is not null").select("doc_id", charcodec.compress_column("text").alias("z"))
    return packed.select(F.col("doc_id").alias("id"), F.sha2(charcodec.decompress_column("z"), 256).alias("h"))


@_query("""select doc_id as id, cast(octet_length(encode(text)) as bigint) as text_bytes, true as same, true as counts_agree from documents where text is not null""")
def charcodec_stats(spark: SparkSession, d: str) -> DataFrame:
    """Statistics of the character codec: the round trip, and the counts against the header of the stream."""
    s = _docs(spark, d).where("text is not null").select("doc_id", charcodec.statistics_column("text").alias("s"), charcodec.compress_column("text").alias("z"))
    in_header = F.conv(F.hex(F.substring("z", 5, 4)), 16, 10).cast("long")
    agree = (F.col("s.literals") + F.col("s.refs") == in_header) & (F.col("s.compressed_bytes") == F.octet_length("z"))
    return s.select(F.col("doc_id").alias("id"), "s.text_bytes", "s.same", agree.alias("counts_agree"))


# --- line CSV -------------------------------------------------------------


_LENIENT = """list_transform(regexp_extract_all(',' || line, ',((?:[^",]|"(?:[^"]|"")*(?:"|$))*)', 1), lambda f: replace(regexp_replace(f, '"((?:[^"]|"")*)(?:"|$)', '\\1', 'g'), '""', '"'))"""


@_query(f"select line_id, array_to_string({_LENIENT}, chr(31)) as fields from (select line_id, min(line) as line from essay_csv_lines where line is not null group by line_id)")
def csv_lenient_fields(spark: SparkSession, d: str) -> DataFrame:
    """The lenient line parser: a quote anywhere toggles quoting."""
    lines = _table(spark, d, "essay_csv_lines").where("line is not null").groupBy("line_id").agg(F.min("line").alias("line"))
    return lines.select("line_id", F.array_join(corpora.split_line_column("line"), "\x1f").alias("fields"))


# One line per place in a file, as files hold them.
_FILE_LINES = "(select file_name, line_no, min(line) as line from essay_csv_lines where file_name is not null and line is not null and line_no is not null and not contains(line, chr(10)) group by file_name, line_no)"


@_query(f"""with rows as (select file_name, line, row_number() over (partition by file_name order by line_no) as i, {_LENIENT} as f from {_FILE_LINES}),
    heads as (select file_name, coalesce(list_position(list_transform(f, lambda x: lower(x)), 'text'), 1) as c from rows where i = 1),
    texts as (select file_name, i, case when len(f) >= c then f[c] else f[1] end as text from rows join heads using (file_name) where i > 1 and line <> '')
    select cast(row_number() over (order by file_name, i) as bigint) as place, text from texts where text <> ''""")
def csv_corpus_files(spark: SparkSession, d: str) -> DataFrame:
    """The texts of several CSV files, each with its own header, in file order: the files are written first, then scanned."""
    rows = _table(spark, d, "essay_csv_lines").where("file_name is not null and line is not null and line_no is not null and not contains(line, '\n')")
    once = rows.groupBy("file_name", "line_no").agg(F.min("line").alias("line"))
    whole = once.groupBy("file_name").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("text"))
    folder = corpora.scratch(spark)
    corpora.write_files(whole.select(F.col("file_name").alias("name"), F.encode("text", "UTF-8").alias("content")), folder)
    return corpora.placed_texts(spark, folder, csv=True)


@_query("""select cast(row_number() over (order by doc_id, i) as bigint) as place, line as text from (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as i from documents where text is not null) where line <> ''""")
def text_corpus_files(spark: SparkSession, d: str) -> DataFrame:
    """The lines of text files in file order: one file is written for each document, then all are scanned."""
    folder = corpora.scratch(spark)
    # Names of one length, so that they sort as the numbers do, the negative ones too.
    number = F.lpad((F.col("doc_id").cast("decimal(20,0)") + F.lit(str(1 << 63)).cast("decimal(20,0)")).cast("string"), 20, "0")
    named = _docs(spark, d).where("text is not null").select(F.concat(number, F.lit(".txt")).alias("name"), F.encode("text", "UTF-8").alias("content"))
    corpora.write_files(named, folder)
    return corpora.placed_texts(spark, folder)


@_query("select cast(d.doc_id as varchar) || '.txt' as name, sha256(text) as h, cast(octet_length(encode(text)) as bigint) as size from documents d where text is not null")
def whole_files(spark: SparkSession, d: str) -> DataFrame:
    """Whole files written and read again, as bytes."""
    folder = corpora.scratch(spark)
    corpora.write_files(_bytes(spark, d).select(F.concat(F.col("id").cast("string"), F.lit(".txt")).alias("name"), "content"), folder)
    return corpora.files(spark, folder).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("h"), "size")


@_query("select cast(d.doc_id as varchar) || '_decompressed.txt' as name, sha256(text) as h from documents d where text is not null")
def file_codec_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Files compressed to containers and restored, all on Spark."""
    folder = corpora.scratch(spark)
    corpora.write_files(_bytes(spark, d).select(F.concat(F.col("id").cast("string"), F.lit(".txt")).alias("name"), "content"), f"{folder}/in")
    pipeline.compress_files(spark, f"{folder}/in", f"{folder}/packed", CodecConfig(chunk_size=_CHUNK))
    corpora.remove(f"{folder}/in")
    pipeline.decompress_files(spark, f"{folder}/packed", f"{folder}/out")
    corpora.remove(f"{folder}/packed")
    return corpora.files(spark, f"{folder}/out").select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("h"))


@_query(f"{_merged_sql(_K)} select subword from {_HARVEST}")
def bpe_model_file(spark: SparkSession, d: str) -> DataFrame:
    """A trained vocabulary saved as a table and read again."""
    path = f"{corpora.scratch(spark)}/model"
    models.save(_vocab(spark, d), path)
    return models.load(spark, path)


@_query("select doc_id, case when b < 1024 then printf('%d B', b) when b < 1048576 then printf('%.2f KB', b / 1024.0) else printf('%.2f MB', b / 1048576.0) end as size from (select doc_id, octet_length(encode(text)) as b from documents where text is not null)")
def byte_sizes_shown(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).where("text is not null").select("doc_id", chars.format_bytes(F.octet_length("text")).alias("size"))


_LONG = "case " + " ".join(f"when b < {1024 ** (k + 1)} then printf('%.1f {u}', b / {float(1024**k)})" for k, u in enumerate(("B", "KB", "MB", "GB", "TB"))) + f" else printf('%.1f PB', b / {float(1024**5)}) end"


@_query(f"""select doc_id, {_LONG} as size, case when ms < 1000 then printf('%.2f ms', ms) else printf('%.2f s', ms / 1000.0) end as took, round((b / 1048576.0) / (ms / 1000.0), 9) as mb_per_s
    from (select doc_id, cast(octet_length(encode(text)) as bigint) * doc_id * doc_id as b, cast(10 * (octet_length(encode(text)) + 1) as double) as ms from documents where text is not null)""")
def long_sizes_shown(spark: SparkSession, d: str) -> DataFrame:
    """The long ladder of sizes, times and throughput, of figures made from the texts.

    Products of large ids pass 64 bits, so they are decimals, exact to 38 digits.
    """
    squared = F.col("doc_id").cast("decimal(19,0)") * F.col("doc_id").cast("decimal(19,0)")
    b = (squared * F.octet_length("text").cast("decimal(10,0)")).cast("decimal(38,0)")
    rows = _docs(spark, d).where("text is not null").select("doc_id", b.alias("b"), (10 * (F.octet_length("text").cast("long") + 1)).cast("double").alias("ms"))
    # As the database rounds: the scaled number to a whole one, then back.
    rate = F.round(chars.throughput_mb(F.col("b").cast("double"), F.col("ms")) * 1e9, 0) / F.lit(1e9)
    return rows.select("doc_id", chars.format_bytes_long(F.col("b")).alias("size"), chars.format_millis(F.col("ms")).alias("took"), rate.alias("mb_per_s"))


@_query(f"""select c, regexp_matches(c, '^[{WS_BPE}]$') as blank, regexp_matches(c, '^[{WS_SP}]$') as blank_sp, regexp_matches(c, '^[{PUNCT}]$') as punct, c in ('-', '_', '/', chr(39)) as connector, c between 'a' and 'z' as lower, c between 'A' and 'Z' as upper, count(*) as n
    from (select unnest(regexp_extract_all(text, '(?s).')) as c from documents where text is not null) group by c""")
def character_classes(spark: SparkSession, d: str) -> DataFrame:
    """The classes of every character of the documents."""
    counts = _docs(spark, d).where("text is not null").select(F.explode(chars.split_chars(F.col("text"))).alias("c")).groupBy("c").agg(F.count(F.lit(1)).alias("n"))
    c = F.col("c")
    return counts.select("c", chars.is_whitespace(c).alias("blank"), chars.is_whitespace(c, sp=True).alias("blank_sp"), chars.is_punctuation(c).alias("punct"), chars.is_connector(c).alias("connector"), chars.is_ascii_lower(c).alias("lower"), chars.is_ascii_upper(c).alias("upper"), "n")


# --- rows that fail to parse (problem 4) ----------------------------------

_CELL = '(?:"(?:[^"]|"")*"|[^",]*)'
_P4 = f"""
    with lines as (select line_id, file_name, line_no, rtrim(line, chr(13)) as line from (select line_id, r.line_no as line_no, r.file_name as file_name, r.line as line from (select line_id, min(struct_pack(line_no, file_name, line)) as r from essay_csv_lines group by line_id))),
    heads as (select file_name, list_transform(regexp_extract_all(replace(rtrim(line, chr(13)), chr(65279), ''), '[A-Za-z_]+'), lambda x: lower(x)) as names from essay_csv_lines where line_no = 1 qualify row_number() over (partition by file_name order by line) = 1),
    data as (select l.*, h.names, regexp_full_match(l.line, '{_CELL}(?:,{_CELL})*') as quoted_well, regexp_extract_all(',' || l.line, ',({_CELL})', 1) as cells
        from lines l left join heads h using (file_name) where l.line_no <> 1 and regexp_matches(l.line, '[^\\s]')),
    plain as (select *, list_transform(cells, lambda c: case when c like '"%' then replace(c[2:-2], '""', '"') else c end) as f from data),
    typed as (select *, f[list_position(names, 'essay_id')] as k, f[list_position(names, 'text')] as t, f[list_position(names, 'is_generated')] as g, f[list_position(names, 'grade')] as gr, f[list_position(names, 'submitted_at')] as s from plain)
    select line_id, case when not quoted_well then 'quoting' when len(f) <> len(names) then 'column_count'
        when not regexp_full_match(k, '[0-9]{{1,15}}') or cast(k as bigint) = 0 or not regexp_matches(t, '[^\\s\\p{{Z}}]') or g not in ('0', '1') or not regexp_full_match(gr, '|0*([1-9]|1[0-2])')
            or not regexp_full_match(s, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}} [0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}') or try_strptime(s, '%Y-%m-%d %H:%M:%S') is null then 'invalid_value' end as reason
    from typed
"""


@_query(f"select line_id, reason from ({_P4}) where reason is not null")
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return strictcsv.rejected(_table(spark, d, "essay_csv_lines"))


@_query(f"select line_id, cast(k as bigint) as essay_id, t as text, cast(g as integer) as is_generated, cast(nullif(gr, '') as integer) as grade, strptime(s, '%Y-%m-%d %H:%M:%S') as submitted_at from ({_P4.replace('select line_id, case', 'select *, case')}) where reason is null")
def p4_valid(spark: SparkSession, d: str) -> DataFrame:
    return strictcsv.valid(_table(spark, d, "essay_csv_lines"))
