"""Filings that arrive over time, chunked as they land.

Sections and chunks need one filing only, so the stream is stateless; novelty is set by the
batch job over the chunk table, since a filing may arrive before the one it follows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.chunks import chunk_sections
from ..operators.sections import MIN_SECTION_CHARS, extract_sections

FILING = "ticker string, fiscal_year int, accession string, filing_date string, html string"


def ingest_filings(spark: SparkSession, source: str, sink: str, checkpoint: str, *, scope: list[str], min_chars: int = MIN_SECTION_CHARS):
    """Reads filings that are new in ``source`` (Parquet), appends their chunks to ``sink`` and stops.
    Each micro-batch overwrites a folder of its own number, so a batch that is run again after a failure
    writes nothing twice."""

    def write(batch: DataFrame, number: int) -> None:
        keys = ["ticker", "fiscal_year", "accession", "filing_date"]
        chunk_sections(extract_sections(batch, keys, scope, min_chars=min_chars)).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    stream = spark.readStream.schema(FILING).parquet(source)
    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
