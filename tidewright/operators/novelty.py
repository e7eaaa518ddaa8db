"""Language that is new against the filing before.

A chunk whose hash occurs anywhere in the previous filing is carried over. The others are
compared with the previous filing's chunks of the same item by ``overlap``: the Jaccard index comes from the
count of common shingles and the two set sizes. That is exact: pairs without a common shingle score 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .overlap import closest

THRESHOLD = 0.6


def filing_ranks(chunks: DataFrame, order_cols: list[str] | None = None) -> DataFrame:
    """ticker, filing_accession, fiscal_year, rank: a ticker's filings in order of year, then of
    ``order_cols`` (the accession by default)."""
    filings = chunks.select("ticker", "filing_accession", "fiscal_year", *[c for c in order_cols or [] if c not in ("ticker", "filing_accession", "fiscal_year")]).distinct()
    by = Window.partitionBy("ticker").orderBy("fiscal_year", *(order_cols or ["filing_accession"]))
    return filings.withColumn("rank", F.row_number().over(by)).select("ticker", "filing_accession", "fiscal_year", "rank")


def check_years(chunks: DataFrame) -> DataFrame:
    """Fails the job if two filings of a ticker have the same fiscal year: their chunks would share ids."""
    twice = chunks.groupBy("ticker", "fiscal_year").agg(F.count_distinct("filing_accession").alias("n")).where("n > 1")
    bad = twice.select(F.concat_ws(" ", "ticker", "fiscal_year").alias("k")).take(5)
    if bad:
        raise ValueError("several filings for one fiscal year: " + ", ".join(r["k"] for r in bad))
    return chunks


def mark_novelty(chunks: DataFrame, *, threshold: float = THRESHOLD, unique_years: bool = True) -> DataFrame:
    """Chunks with is_new_language and similarity_to_prior (four decimals) set.

    The prior filing is the one before in the ticker's order, however many years earlier.
    The similarity is the first score at or over the threshold in the prior's order, else
    the highest score, else 0; the flag is decided before rounding."""
    if unique_years:
        check_years(chunks)
    known = chunks.drop("is_new_language", "similarity_to_prior").withColumn("doc", F.xxhash64("chunk_id", "ordinal", "text"))
    base = known.join(F.broadcast(filing_ranks(chunks).select("ticker", "filing_accession", "rank")), ["ticker", "filing_accession"])  # a row a filing
    hashes = base.select("ticker", (F.col("rank") + 1).alias("rank"), "text_hash").distinct()
    carried = base.join(hashes.withColumn("seen", F.lit(True)), ["ticker", "rank", "text_hash"], "left")
    best = closest(base.select("ticker", "rank", "item", "doc", "ordinal", "text"), threshold=threshold)
    joined = carried.join(best, ["ticker", "rank", "item", "doc"], "left")
    value = F.when(F.col("seen"), 1.0).otherwise(F.coalesce("sim", F.lit(0.0)))
    out = joined.withColumn("value", value)
    names = [c for c in chunks.columns if c not in ("is_new_language", "similarity_to_prior")]
    return out.select(*names, (~F.coalesce("seen", F.lit(False)) & (F.col("value") < threshold)).alias("is_new_language"), F.round("value", 4).alias("similarity_to_prior"))
