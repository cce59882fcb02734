"""Words and punctuation of a text, natively in Catalyst."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.chars import LOWER, PUNCT, UPPER, WS_BPE
from ..plans.config import APP_BPE, BpeConfig


def pretoken_strings(text: Column, cfg: BpeConfig = APP_BPE) -> Column:
    """Array of pre-tokens: blanks end a token, punctuation stands alone if it splits and is dropped if not kept."""
    if cfg.split_camel_case:
        text = F.regexp_replace(text, "([a-z])([A-Z])", "$1 $2")
    if not cfg.split_on_punctuation:
        return F.regexp_extract_all(text, F.lit(f"[^{WS_BPE}]+"), F.lit(0))
    word = f"[^{WS_BPE}{PUNCT}]+"
    return F.regexp_extract_all(text, F.lit(f"[{PUNCT}]|{word}" if cfg.keep_punctuation else word), F.lit(0))


def is_punct_token(token: Column, cfg: BpeConfig = APP_BPE) -> Column:
    return token.rlike(f"^[{PUNCT}]$") if cfg.split_on_punctuation else F.lit(False)


def pretokens(corpus: DataFrame, cfg: BpeConfig = APP_BPE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, pos, token, is_punct), one row per pre-token; null texts give none."""
    out = corpus.select(F.col(id_col).alias("doc_id"), F.posexplode(pretoken_strings(F.col(text_col), cfg)).alias("pos", "token"))
    return out.select("doc_id", "pos", "token", is_punct_token(F.col("token"), cfg).alias("is_punct"))


def prepared(text: Column, cfg: BpeConfig = APP_BPE) -> Column:
    """The text with camel borders split, NUL dropped and ASCII case folded, so that its pre-tokens need no normalization.

    Equal to normalizing every pre-token: the other characters that does away
    with are blanks, which never are inside one.
    """
    if cfg.split_camel_case:
        text = F.regexp_replace(text, "([a-z])([A-Z])", "$1 $2")
    return F.translate(text, UPPER + "\0", LOWER) if cfg.lowercase else F.translate(text, "\0", "")


def normalized_tokens(text: Column, cfg: BpeConfig = APP_BPE) -> Column:
    """Array of normalized pre-tokens that are not empty."""
    return pretoken_strings(prepared(text, cfg), replace(cfg, split_camel_case=False))
