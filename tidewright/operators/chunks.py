"""Paragraph chunks as folds over arrays: no user functions, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip, text_hash

# The sizes that decide where chunks end.
MIN_CHUNK_CHARS = 200
MAX_CHUNK_CHARS = 4000
_SENTENCE_END = r"(?U)(?<=[\.\?\!])\s+(?=[A-Z(])"
_STATE = "struct<out:array<string>,held:string>"


def _empty() -> Column:
    return F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("held")).cast(_STATE)


def _state(out: Column, held: Column) -> Column:
    return F.struct(out.alias("out"), held.alias("held")).cast(_STATE)


def paragraphs(c: Column) -> Column:
    """Stripped, non-empty lines, each joined to those before it until it has 200
    characters; what is left over joins the last paragraph, or is one if it is alone."""
    lines = F.filter(F.transform(F.split(c, "\n"), strip), lambda x: x != "")

    def merge(s: Column, line: Column) -> Column:
        joined = F.when(s["held"] == "", line).otherwise(F.concat(s["held"], F.lit(" "), line))
        full = F.length(joined) >= MIN_CHUNK_CHARS
        return F.when(full, _state(F.concat(s["out"], F.array(joined)), F.lit(""))).otherwise(_state(s["out"], joined))

    def finish(s: Column) -> Column:
        last = F.concat(F.element_at(s["out"], -1), F.lit(" "), s["held"])
        return (
            F.when(s["held"] == "", s["out"])
            .when(F.size(s["out"]) == 0, F.array(s["held"]))
            .otherwise(F.concat(F.slice(s["out"], 1, F.greatest(F.size(s["out"]) - 1, F.lit(0))), F.array(last)))
        )

    return F.aggregate(lines, _empty(), merge, finish)


def hard_wrap(c: Column) -> Column:
    """Paragraphs over 4,000 characters as runs of whole sentences of at most that; a
    longer sentence stays whole."""

    def pack(s: Column, sentence: Column) -> Column:
        over = (F.length(s["held"]) + F.length(sentence) + 1 > MAX_CHUNK_CHARS) & (s["held"] != "")
        more = strip(F.concat(s["held"], F.lit(" "), sentence))
        return F.when(over, _state(F.concat(s["out"], F.array(strip(s["held"]))), sentence)).otherwise(_state(s["out"], more))

    def finish(s: Column) -> Column:
        return F.when(s["held"] == "", s["out"]).otherwise(F.concat(s["out"], F.array(strip(s["held"]))))

    return F.when(F.length(c) <= MAX_CHUNK_CHARS, F.array(c)).otherwise(F.aggregate(F.split(c, _SENTENCE_END), _empty(), pack, finish))


def chunk_sections(sections: DataFrame, *, min_chars: int = MIN_CHUNK_CHARS) -> DataFrame:
    """sections: ticker, fiscal_year, item, text and, if known, accession and filing_date. One row
    for each chunk, with ordinal (of the kept chunks of a section), chunk_id, text_hash
    and the novelty columns at their defaults. ``min_chars`` only decides what is kept."""
    pieces = F.flatten(F.transform(paragraphs(F.col("text")), hard_wrap))
    kept = F.filter(pieces, lambda p: F.length(p) >= min_chars)
    extra = [F.col(c) if c in sections.columns else F.lit("").alias(c) for c in ("accession", "filing_date")]
    rows = sections.select("ticker", "fiscal_year", "item", *extra, F.posexplode_outer(kept).alias("ordinal", "text")).where("text IS NOT NULL")
    return rows.select(
        F.format_string("%s-%d-%s-%04d", "ticker", "fiscal_year", "item", "ordinal").alias("chunk_id"),
        "ticker",
        "fiscal_year",
        "item",
        "ordinal",
        "text",
        text_hash(F.col("text")).alias("text_hash"),
        F.col("accession").alias("filing_accession"),
        "filing_date",
        F.lit(False).alias("is_new_language"),
        F.lit(0.0).alias("similarity_to_prior"),
    )
