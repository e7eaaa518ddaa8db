"""Text functions as Column expressions: flattening, normalising, hashing, shingles, keywords."""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Element names and characters that decide the flattened text.
RAW_ELEMENTS = ("script", "style")
BLOCK_ELEMENTS = ("p", "div", "tr", "table", "br", "h1", "h2", "h3", "h4", "h5", "h6", "li", "ul", "ol", "section")
PLAIN_CHARACTERS = (("‘", "'"), ("’", "'"), ("“", '"'), ("”", '"'), (" ", " "))
SHINGLE_WORDS = 5
HASH_CHARS = 16


@F.pandas_udf(T.StringType())
def unescape_entities(texts: pd.Series) -> pd.Series:
    """HTML character references to characters; null stays null. No built-in does this."""
    return texts.map(html.unescape, na_action="ignore")


def strip(c: Column) -> Column:
    """Unicode white space off both ends; F.trim only takes U+0020."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def flatten_html(c: Column) -> Column:
    """Plain text of a page: script and style to a blank, block tags to line breaks,
    other tags to blanks, then entities, plain quotes, single blanks, stripped lines and at
    most one empty line in a row. Entities are decoded after tags are gone, so an
    escaped tag stays as text."""
    for name in RAW_ELEMENTS:
        c = F.regexp_replace(c, rf"(?is)<{name}[^>]*>.*?</{name}>", " ")
    c = F.regexp_replace(c, rf"(?i)</?(?:{'|'.join(BLOCK_ELEMENTS)})\b[^>]*>", "\n")
    c = unescape_entities(F.regexp_replace(c, r"<[^>]+>", " "))
    c = F.translate(c, "".join(a for a, _ in PLAIN_CHARACTERS), "".join(b for _, b in PLAIN_CHARACTERS))
    c = F.regexp_replace(c, r"[ \t\r\f\x0B]+", " ")  # \v in a class would take line breaks in Java
    lines = F.array_join(F.transform(F.split(c, "\n"), strip), "\n")
    return strip(F.regexp_replace(lines, r"\n{3,}", "\n\n"))


def normalise(c: Column) -> Column:
    """Lower case, numbers as 0, anything but a-z, 0-9 and blanks gone, single blanks.
    The look-ahead spares a Unicode word test at every character; one pattern takes what isn't a-z or 0-9 and the blanks around it."""
    c = F.regexp_replace(F.lower(c), r"(?U)(?=\d)\b\d[\d,\.]*\b", " 0 ")
    return F.trim(F.regexp_replace(c, r"[^a-z0-9]+", " "))


def text_hash(c: Column) -> Column:
    """First 16 hex digits of SHA-256 of the normalised text."""
    return F.substring(F.sha2(normalise(c), 256), 1, HASH_CHARS)


def with_shingles(df: DataFrame, text_col: str, out: str, size: int = SHINGLE_WORDS, *, hashed: bool = False) -> DataFrame:
    """df with ``out``, the distinct word shingles of the normalised text: all words as one if there are
    fewer than ``size``, none if there are none. With ``hashed``, a 64-bit hash of the words stands for each.
    The words are a column of their own, as a lambda would otherwise find them anew for each shingle."""
    words = F.filter(F.split(normalise(F.col(text_col)), " "), lambda w: w != "")
    split = df.withColumn("tw_words", words)
    w = F.col("tw_words")
    # words side by side, so that the lambda sees nothing but its own element
    rows = F.arrays_zip(*[F.slice(w, i + 1, 1 << 30).alias(f"w{i}") for i in range(size)])
    one = F.xxhash64 if hashed else lambda *words: F.concat_ws(" ", *words)  # both pass over the nulls of a short text
    runs = F.transform(F.slice(rows, 1, F.greatest(F.size(w) - (size - 1), F.lit(1))), lambda z: one(*[z[f"w{i}"] for i in range(size)]))
    none = F.array().cast("array<bigint>" if hashed else "array<string>")
    return split.withColumn(out, F.when(F.size(w) == 0, none).otherwise(F.array_distinct(runs))).drop("tw_words")


def jaccard(a: Column, b: Column) -> Column:
    """Share of common members of two arrays of distinct members; 0 if either is empty."""
    common = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.coalesce(F.try_divide(common.cast("double"), F.size(a) + F.size(b) - common), F.lit(0.0)))


def keyword_pattern(keywords) -> str:
    """One alternation of literal keywords with an optional plural, not within a word."""
    quoted = "|".join("\\Q" + k.replace("\\E", "\\E\\\\E\\Q") + "\\E" for k in keywords)
    return rf"(?iu)(?<![a-z0-9])(?:{quoted})(?:es|s)?(?![a-z0-9])"


def keyword_labels(c: Column, taxonomy) -> Column:
    """Sorted ids of the themes of which a keyword occurs; an empty array is an answer."""
    hits = [F.when(F.coalesce(c.rlike(keyword_pattern(t.keywords)), F.lit(False)), F.lit(t.id)) for t in taxonomy.themes if t.keywords]
    return F.array_sort(F.array_compact(F.array(*hits))) if hits else F.array().cast("array<string>")


def cache_key(text: Column, version: str, model: str) -> Column:
    """Key of a label cache: 32 hex digits over model, version and the text as it is."""
    return F.substring(F.sha2(F.concat_ws("|", F.lit(model), F.lit(version), text), 256), 1, 32)


def keyword_regex_python(keywords) -> re.Pattern:
    """The same pattern for callers outside Spark."""
    return re.compile(rf"(?<![a-z0-9])(?:{'|'.join(map(re.escape, keywords))})(?:es|s)?(?![a-z0-9])", re.IGNORECASE)
