"""Filings and point-in-time financial facts from landed JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Tags in order of preference for each metric.
TAG_PRIORITY = {
    "revenue": ("RevenueFromContractWithCustomerExcludingAssessedTax", "RevenueFromContractWithCustomerIncludingAssessedTax", "Revenues", "SalesRevenueNet"),
    "operating_income": ("OperatingIncomeLoss",),
    "net_income": ("NetIncomeLoss",),
}
ANNUAL_FORMS = ("10-K", "10-K/A")
ARCHIVE = "https://www.sec.gov/Archives/edgar/data"


def resolve_ciks(tickers: DataFrame, entries: DataFrame) -> DataFrame:
    """tickers with ``cik``: case-insensitive, the first entry in document order; a miss fails the job.
    entries: pos, cik_str, ticker."""
    first = entries.groupBy(F.upper("ticker").alias("u")).agg(F.min_by("cik_str", "pos").alias("cik"))
    joined = tickers.join(first, F.upper(tickers["ticker"]) == F.col("u"), "left").drop("u")
    return joined.withColumn("cik", F.when(F.col("cik").isNull(), F.raise_error(F.concat(F.lit("no CIK for ticker "), F.coalesce("ticker", F.lit("null")))).cast("bigint")).otherwise(F.col("cik")))


def unresolved(tickers: DataFrame, entries: DataFrame) -> DataFrame:
    """Tickers without an entry, to report and skip."""
    return tickers.join(entries.select(F.upper("ticker").alias("u")).distinct(), F.upper("ticker") == F.col("u"), "left_anti")


def fiscal_year(report_date: Column) -> Column:
    """The year in which the period ends; the filing date says nothing about it."""
    return F.substring(report_date, 1, 4).try_cast("int")


def filing_url(cik: Column, accession: Column, document: Column) -> Column:
    return F.concat_ws("/", F.lit(ARCHIVE), cik.cast("string"), F.replace(accession, F.lit("-"), F.lit("")), document)


def list_filings(submissions: DataFrame, *, forms=("10-K",), start_year: int = 2019, end_year: int = 2100) -> DataFrame:
    """submissions: cik, ticker and recent, a struct of parallel arrays -> one row a filing in the
    forms and years, ordered by ticker and report date. Arrays count up to the shortest."""
    names = ("form", "accessionNumber", "filingDate", "reportDate", "primaryDocument")
    arrays = [F.col(f"recent.{n}") for n in names]
    zipped = F.slice(F.arrays_zip(*[a.alias(n) for a, n in zip(arrays, names, strict=True)]), 1, F.least(*[F.size(a) for a in arrays]))
    rows = submissions.select("cik", F.upper("ticker").alias("ticker"), F.posexplode(zipped).alias("pos", "z")).select("cik", "ticker", "pos", "z.*")
    year = fiscal_year(F.col("reportDate"))
    kept = rows.where(F.upper("form").isin([f.upper() for f in forms]) & (F.coalesce("reportDate", F.lit("")) != "") & year.between(start_year, end_year))
    return kept.select(
        "cik", "ticker", "form", F.col("accessionNumber").alias("accession"), F.col("filingDate").alias("filing_date"), F.col("reportDate").alias("report_date"), F.col("primaryDocument").alias("primary_document"),
        year.alias("fiscal_year"), filing_url(F.col("cik"), F.col("accessionNumber"), F.col("primaryDocument")).alias("url"), "pos",
    ).orderBy("ticker", "report_date", "pos").drop("pos")


def facts_long(facts: DataFrame, *, taxonomy: str = "us-gaap") -> DataFrame:
    """facts: ticker and facts, maps by taxonomy, tag and unit -> ticker, tag, unit, pos and an entry's columns."""
    tags = facts.select("ticker", F.explode(F.col("facts")[taxonomy]).alias("tag", "body"))
    units = tags.select("ticker", "tag", F.explode("body.units").alias("unit", "entries"))
    return units.select("ticker", "tag", "unit", F.posexplode("entries").alias("pos", "e")).select("ticker", "tag", "unit", "pos", "e.*")


def annual_metric(entries: DataFrame, *, unit: str = "USD") -> DataFrame:
    """What was first reported for each period: for (ticker, tag, end) the annual entry filed first, the
    earliest in the array of equals. The fiscal year is fy, or the year of the end where fy is null or 0."""
    annual = entries.where((F.col("unit") == unit) & (F.col("fp") == "FY") & F.col("form").isin(*ANNUAL_FORMS) & (F.coalesce("end", F.lit("")) != "") & (F.coalesce("filed", F.lit("")) != "") & F.col("val").isNotNull())
    row = F.struct("fy", "fp", "form", "filed", "accn", F.col("val").cast("double").alias("val"))
    picked = annual.groupBy("ticker", "tag", "end").agg(F.min_by(row, F.struct("filed", "pos")).alias("r"))
    year = F.when(F.coalesce("r.fy", F.lit(0)) != 0, F.col("r.fy")).otherwise(fiscal_year(F.col("end")))
    return picked.select("ticker", "tag", F.lit(unit).alias("unit"), year.cast("int").alias("fiscal_year"), F.col("r.fp").alias("fiscal_period"), F.col("end").alias("period_end"), F.col("r.val").alias("value"), F.col("r.filed").alias("filed"), F.col("r.accn").alias("accession"), F.col("r.form").alias("form"))


def first_available(points: DataFrame, priorities: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """points of the first tag in order that a company has at all, for each metric: one tag a company, never
    mixed by year."""
    order = [(m, i, t) for m, tags in (priorities or TAG_PRIORITY).items() for i, t in enumerate(tags)]
    dim = points.sparkSession.createDataFrame(order, "metric string, priority int, tag string")
    ranked = points.join(F.broadcast(dim), "tag")
    best = F.min("priority").over(Window.partitionBy("ticker", "metric"))
    return ranked.withColumn("best", best).where("priority = best").drop("best", "priority")


def yearly_series(points: DataFrame, metric: str = "revenue") -> DataFrame:
    """ticker, fiscal_year, value: the latest period end of a fiscal year wins."""
    return points.where(F.col("metric") == metric).groupBy("ticker", "fiscal_year").agg(F.max_by("value", "period_end").alias("value"))
