"""Character classes and scalar text functions, as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The character classes that decide token borders.  The second
# blank class lacks U+180E; only three ranges of non-ASCII signs are punctuation.
WS_BPE = r"\x{09}-\x{0d}\x{20}\x{a0}\x{1680}\x{180e}\x{2007}\x{202f}\x{3000}"
WS_SP = r"\x{09}-\x{0d}\x{20}\x{a0}\x{1680}\x{2007}\x{202f}\x{3000}"
PUNCT = r"\x{21}-\x{2f}\x{3a}-\x{40}\x{5b}-\x{60}\x{7b}-\x{7e}\x{2000}-\x{2006}\x{2008}-\x{202e}\x{2030}-\x{206f}\x{3001}-\x{303f}\x{ff01}-\x{ff65}"
CONNECTORS = ("-", "_", "/", "'")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def fold_ascii(text: Column) -> Column:
    """Lower case of ASCII letters only; all other letters stay as they are."""
    return F.translate(text, UPPER, LOWER)


def split_chars(text: Column) -> Column:
    """The code points of a text, empty for an empty one."""
    return F.when(F.length(text) == 0, F.array().cast("array<string>")).otherwise(F.split(text, ""))


def is_whitespace(c: Column, sp: bool = False) -> Column:
    return c.rlike(f"^[{WS_SP if sp else WS_BPE}]$")


def is_punctuation(c: Column) -> Column:
    return c.rlike(f"^[{PUNCT}]$")


def is_connector(c: Column) -> Column:
    return c.isin(*CONNECTORS)


def is_ascii_lower(c: Column) -> Column:
    return c.rlike("^[a-z]$")


def is_ascii_upper(c: Column) -> Column:
    return c.rlike("^[A-Z]$")


def trim_spaces(text: Column) -> Column:
    """Drop U+0020 at both ends, and nothing else."""
    return F.trim(text)


def normalize_token(token: Column, lowercase: bool = True) -> Column:
    """Drop line breaks, tabs and NUL, fold ASCII case if asked, trim blanks; may become empty."""
    bare = F.regexp_replace(token, r"[\r\n\t\x00]", "")
    return F.trim(fold_ascii(bare) if lowercase else bare)


def char_count(text: Column) -> Column:
    return F.length(text).cast("long")


def approx_tokens(text: Column) -> Column:
    """A quarter of the UTF-8 bytes, rounded up; null for null."""
    return F.ceil(F.octet_length(text) / F.lit(4.0)).cast("long")


def ratio(out_bytes: Column, in_bytes: Column) -> Column:
    """Output per input; null for empty input."""
    return out_bytes / F.nullif(in_bytes, F.lit(0))


def saving_percent(out_bytes: Column, in_bytes: Column) -> Column:
    return (1 - ratio(out_bytes, in_bytes)) * 100


def throughput_mb(n_bytes: Column, millis: Column) -> Column:
    """MiB per second; null for no time."""
    return (n_bytes / F.lit(1048576.0)) / (F.nullif(millis, F.lit(0)) / F.lit(1000.0))


def _decimals(n: Column, unit: int, places: int) -> Column:
    """n / unit as text, exact ties to the even digit, as the C library prints it."""
    exact = n.cast("decimal(26,6)") / F.lit(unit).cast("decimal(20,0)")
    return F.bround(exact, places).cast("string")


def _decimals_wide(n: Column, unit: int, places: int) -> Column:
    """The same for whole numbers of up to 38 digits: whole units and the rest apart, so that no digit of the rest is cut."""
    n = n.cast("decimal(38,0)")
    rest = n % F.lit(unit).cast("decimal(20,0)")
    whole = ((n - rest) / F.lit(unit).cast("decimal(20,0)")).cast("decimal(32,0)")
    part = F.bround(rest.cast("decimal(26,6)") / F.lit(unit).cast("decimal(20,0)"), places)
    return (whole + part.cast(f"decimal({places + 1},{places})")).cast("string")


def format_bytes(n: Column) -> Column:
    """The short ladder: B, KB, MB."""
    return (
        F.when(n < 1024, F.format_string("%d B", n.cast("long")))
        .when(n < 1048576, F.concat(_decimals(n, 1024, 2), F.lit(" KB")))
        .otherwise(F.concat(_decimals(n, 1048576, 2), F.lit(" MB")))
    )


def format_bytes_long(n: Column) -> Column:
    """The long ladder: B to PB, one decimal; sizes may be decimals of up to 38 digits."""
    out = F.concat(_decimals_wide(n, 1024**5, 1), F.lit(" PB"))
    for k, unit in reversed(list(enumerate(("B", "KB", "MB", "GB", "TB")))):
        out = F.when(n < 1024 ** (k + 1), F.concat(_decimals(n, 1024**k, 1), F.lit(f" {unit}"))).otherwise(out)
    return out


def format_millis(ms: Column) -> Column:
    return F.when(ms < 1000, F.concat(_decimals(ms, 1, 2), F.lit(" ms"))).otherwise(F.concat(_decimals(ms, 1000, 2), F.lit(" s")))
