"""Sections of long filings: split at headings, keep the longest run for each item."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import flatten_html, strip

# The headings that bound sections.
HEADINGS = (
    ("item1", r"item\s*1\s*[\.\:\-–—]?\s*business"),
    ("item1a", r"item\s*1a\s*[\.\:\-–—]?\s*risk\s*factors"),
    ("item1b", r"item\s*1b\s*[\.\:\-–—]?\s*unresolved"),
    ("item2", r"item\s*2\s*[\.\:\-–—]?\s*properties"),
    ("item3", r"item\s*3\s*[\.\:\-–—]?\s*legal\s*proceedings"),
    ("item5", r"item\s*5\s*[\.\:\-–—]?\s*market\s*for"),
    ("item7", r"item\s*7\s*[\.\:\-–—,]?\s*management\W{0,3}s?\W{0,3}discussion"),
    ("item7a", r"item\s*7a\s*[\.\:\-–—]?\s*quantitative"),
    ("item8", r"item\s*8\s*[\.\:\-–—]?\s*financial\s*statements"),
    ("item9a", r"item\s*9a\s*[\.\:\-–—]?\s*controls"),
)
MIN_SECTION_CHARS = 1500


def _split_pattern(headings) -> str:
    """Where a heading begins; what all of them begin with is tested once."""
    stem = r"item\s*"
    if all(p.startswith(stem) for _, p in headings):
        return rf"(?iU)(?={stem}(?:{'|'.join(p[len(stem):] for _, p in headings)}))"
    return "(?iU)(?=" + "|".join(p for _, p in headings) + ")"


def _found(text: Column, headings) -> Column:
    """Headings of a text in order as structs pos, item, body (stripped), start, end (offsets of the unstripped body).
    A filing is one row, so all of this is done within the row."""
    parts = F.split(text, _split_pattern(headings))
    whole = "(?iU)^(?:" + "|".join(p for _, p in headings) + ")"
    zero = F.struct(F.array().cast("array<int>").alias("ends"), F.lit(0).alias("sum"))
    ends = F.aggregate(parts, zero, lambda a, x: F.struct(F.concat(a["ends"], F.array(a["sum"] + F.length(x))).alias("ends"), (a["sum"] + F.length(x)).alias("sum")), lambda a: a["ends"])
    headed = F.transform(F.arrays_zip(parts.alias("part"), ends.alias("end")), lambda z, i: F.struct(i.alias("pos"), F.regexp_extract(z["part"], whole, 0).alias("head"), z["part"].alias("part"), z["end"].alias("end")))
    item = lambda h: F.coalesce(*[F.when(h.rlike(f"(?iU)^(?:{p})"), F.lit(i)) for i, p in headings])
    return F.transform(
        F.filter(headed, lambda z: z["head"] != ""),
        lambda z: F.struct(
            z["pos"].alias("pos"), item(z["head"]).alias("item"), strip(F.substring(z["part"], F.length(z["head"]) + 1, F.length(z["part"]))).alias("body"),
            (z["end"] - F.length(z["part"]) + F.length(z["head"])).alias("start"), z["end"].alias("end"),
        ),
    )


def candidates(filings: DataFrame, keys: list[str], text_col: str = "text", headings=HEADINGS) -> DataFrame:
    """Every heading and what follows it up to the next heading of any kind: keys, pos, item,
    body (stripped), start and end (offsets of the unstripped body)."""
    return filings.select(*keys, F.inline(_found(F.col(text_col), headings)))


def split_items(filings: DataFrame, keys: list[str], text_col: str = "text", *, min_chars: int = MIN_SECTION_CHARS, headings=HEADINGS) -> DataFrame:
    """One row for each filing and item: keys, item, text, start, end, char_count. The longest
    body wins, the earliest of equals; items whose longest body is shorter than
    ``min_chars`` are left out after that choice. Filings without headings have no rows. No shuffle."""
    rows = filings.select(*keys, _found(F.col(text_col), headings).alias("tw_found"))
    longest = lambda i: F.array_max(F.transform(F.filter("tw_found", lambda z: z["item"] == i), lambda z: F.struct(F.length(z["body"]).alias("n"), (-z["pos"]).alias("order"), z["item"].alias("item"), z["body"].alias("body"), z["start"].alias("start"), z["end"].alias("end"))))
    best = F.filter(F.array(*[longest(i) for i, _ in headings]), lambda z: z["n"] >= min_chars)
    return rows.select(*keys, F.inline(best)).select(*keys, "item", F.col("body").alias("text"), "start", "end", F.col("n").alias("char_count"))


def extract_sections(filings: DataFrame, keys: list[str], wanted: list[str] | None = None, html_col: str = "html", *, min_chars: int = MIN_SECTION_CHARS) -> DataFrame:
    """Sections of raw HTML filings; only the wanted items, if given. Missing ones are absent."""
    flat = filings.select(*keys, flatten_html(F.col(html_col)).alias("text"))
    found = split_items(flat, keys, min_chars=min_chars)
    return found if wanted is None else found.where(F.col("item").isin(list(wanted)))


def missing_sections(filings: DataFrame, sections: DataFrame, keys: list[str], scope: list[str]) -> DataFrame:
    """keys and missing, the sorted items in scope that a filing lacks; only filings that lack any."""
    wanted = filings.select(*keys).distinct().withColumn("item", F.explode(F.array(*[F.lit(i) for i in scope])))
    lacking = wanted.join(sections.select(*keys, "item"), [*keys, "item"], "left_anti")
    return lacking.groupBy(*keys).agg(F.array_sort(F.collect_list("item")).alias("missing"))
