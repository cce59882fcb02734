from pyspark.sql import functions as F

from tokenloom.functions import chars
from tokenloom.operators import pretokenize, unigram
from tokenloom.plans.config import BpeConfig, SpConfig


def column(spark, texts, expr):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    return [r.x for r in rows.select("doc_id", expr.alias("x")).orderBy("doc_id").collect()]


def test_pretokens(spark):
    texts = ["helloWorld, it's", "ABCdef aB1C", "x y᠎z w　v u", "«hola» ¿qué?", "a\r\n\tb", "#tag $5", "", "  ", None]
    got = column(spark, texts, pretokenize.pretoken_strings(F.col("text")))
    assert got == [
        ["hello", "World", ",", "it", "'", "s"],
        ["ABCdef", "a", "B1C"],
        ["x", "y", "z", " ", "w", "v", "u"],
        ["«hola»", "¿qué", "?"],
        ["a", "b"],
        ["#", "tag", "$", "5"],
        [],
        [],
        None,
    ]


def test_flags(spark):
    text = F.col("text")
    assert column(spark, ["a,b cD"], pretokenize.pretoken_strings(text, BpeConfig(split_on_punctuation=False, split_camel_case=False))) == [["a,b", "cD"]]
    assert column(spark, ["a,b cD"], pretokenize.pretoken_strings(text, BpeConfig(keep_punctuation=False))) == [["a", "b", "c", "D"]]


def test_normalize_folds_ascii_only(spark):
    assert column(spark, ["ÉCOLE A\tB\n", None], chars.normalize_token(F.col("text"))) == ["École ab", None]


def test_sp_normalize(spark):
    texts = ["  Hello  myWorld ", "   ", "", "▁x", "x᠎y", None]
    assert column(spark, texts, unigram.normalize(F.col("text"), SpConfig())) == ["▁hello▁my▁world", "", "", "▁▁x", "▁x᠎y", None]


def test_approx_tokens_counts_bytes(spark):
    assert column(spark, ["The quick brown fox jumps over it", "é", "", None], chars.approx_tokens(F.col("text"))) == [9, 1, 0, None]


def test_scalars(spark):
    n = F.length("text") * 1024
    assert column(spark, ["a", "a" * 1024], chars.format_bytes(n)) == ["1.00 KB", "1.00 MB"]
    assert column(spark, ["a"], chars.format_bytes_long(n)) == ["1.0 KB"]
    assert column(spark, ["a", ""], chars.ratio(F.lit(5), F.length("text"))) == [5.0, None]
    assert column(spark, ["é", ""], chars.split_chars(F.col("text"))) == [["é"], []]


def test_config_minimums():
    assert BpeConfig().with_merge_ops(0).merge_ops == 600 and BpeConfig().with_training(0, -1).word_limit == 1
    assert SpConfig().with_target_vocab(3).target_vocab == 8000 and SpConfig().with_training(3, 1, 0).target_vocab == 64
    assert BpeConfig().with_unknown_token(" <UNK> ").unknown_token == "<unk>" and BpeConfig().with_unknown_token(" \t").unknown_token == "<unk>"
