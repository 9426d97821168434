"""Text keys and tokens. Everything but NFKC and full case folding stays in the JVM."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Words that the lexical engine leaves out.
STOP_WORDS = (
    "a an the and or but of to in on at by for from with as i me my we our you your he she it its they their this that these those is are was were be been being "
    "am have has had do does did would could should can will just very also here there"
).split()
#: Words of the lexical engine: letters and digits, joined by apostrophes.
WORD = r"[\p{L}\p{N}]+(?:['’][\p{L}\p{N}]+)*"
#: Words of the linear control: two or more word characters.
TERM = r"[\p{L}\p{N}_]{2,}"
_space = re.compile(r"\s+")


def normalize_text(text: str | None) -> str | None:
    """NFKC, white space collapsed and stripped, case folded; null stays null."""
    if text is None:
        return None
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    return _space.sub(" ", text).strip().casefold()


@F.pandas_udf(StringType())
def normalize(text: pd.Series) -> pd.Series:
    """normalize_text of a column, in Arrow batches."""
    return text.map(normalize_text, na_action="ignore")


@F.pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Unicode NFKC of a column."""
    return text.map(lambda x: x if x.isascii() else unicodedata.normalize("NFKC", x), na_action="ignore")


def register(spark: SparkSession) -> None:
    """Make the functions that Spark lacks callable from SQL: normalize_text, nfkc."""
    spark.udf.register("normalize_text", normalize)
    spark.udf.register("nfkc", nfkc)


def words(text: Column) -> Column:
    """All words of the lexical engine in order, stop words included."""
    return F.regexp_extract_all(F.lower(nfkc(text)), F.lit(WORD), F.lit(0))


def canonical(text: Column) -> Column:
    """The comparison key of the lexical engine: its words joined by one space. Punctuation is lost, unlike in normalize."""
    return F.array_join(words(text), " ")


def without_stop_words(tokens: Column) -> Column:
    """Stop words left out, repetitions kept."""
    stop = F.array(*map(F.lit, STOP_WORDS))
    return F.filter(tokens, lambda w: ~F.array_contains(stop, w))


def with_bigrams(tokens: Column) -> Column:
    """The tokens and each pair of neighbours."""
    pairs = F.zip_with(F.slice(tokens, 1, F.greatest(F.size(tokens) - 1, F.lit(0))), F.slice(tokens, 2, F.greatest(F.size(tokens), F.lit(1))), lambda a, b: F.concat_ws(" ", a, b))
    return F.when(F.size(tokens) > 1, F.concat(tokens, pairs)).otherwise(tokens)


def lexical_terms(text: Column) -> Column:
    """Unigrams and bigrams of the lexical engine; bigrams are made after stop words are gone."""
    return with_bigrams(without_stop_words(words(text)))


def control_terms(text: Column) -> Column:
    """Unigrams and bigrams of the linear control."""
    return with_bigrams(F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0)))


def fnv1a(text: Column) -> Column:
    """FNV-1a of 32 bits over UTF-16 units, as eight hex digits; null stays null."""
    units = F.encode(text, "UTF-16BE")
    n = (F.octet_length(units) / 2).cast("int")
    unit = lambda i: F.conv(F.hex(F.substring(units, i * 2 + 1, F.lit(2))), 16, 10).cast("bigint")
    seq = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    h = F.aggregate(seq, F.lit(2166136261).cast("bigint"), lambda h, i: (h.bitwiseXOR(unit(i)) * F.lit(16777619)).bitwiseAND(F.lit(4294967295)))
    return F.lpad(F.lower(F.hex(h)), 8, "0")


def head_tail(tokens: Column, limit: int) -> Column:
    """Tokens beyond the limit are cut from the middle: three quarters of it stay at the head, the rest at the tail."""
    head = limit * 3 // 4
    cut = F.concat(F.slice(tokens, 1, head), F.slice(tokens, -(limit - head), limit - head))
    return F.when(F.size(tokens) > limit, cut).otherwise(tokens)


def escaped_html(text: Column) -> Column:
    """& < > " and ' as references."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def lines(text: Column) -> Column:
    """The lines that are not blank, trimmed."""
    return F.filter(F.transform(F.split(text, r"\r?\n"), lambda x: F.trim(x)), lambda x: x != "")
