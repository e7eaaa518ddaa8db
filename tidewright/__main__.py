"""Command line: python -m tidewright COMMAND, over landed files and tables.

Tables are Parquet folders under --data: filings (ticker, fiscal_year, accession, filing_date, html), chunks,
predictions, points (annual metrics), panel.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .config import load_study, load_taxonomy
from .operators import filings as fl
from .plans import jobs
from .sources import landing


def fetch(spark, study, tax, a):
    """Manifest and annual metrics from the landed ticker map, submissions and facts."""
    entries = landing.ticker_entries(spark, f"{a.data}/raw/tickers.json")
    manifest, missing = jobs.fetch_manifest(study.table(spark).select("ticker"), entries, landing.submissions(spark, f"{a.data}/raw/submissions"), study, only=[a.ticker] if a.ticker else None)
    for r in missing.collect():
        print(f"no CIK for {r['ticker']}, skipped")
    landing.with_pages(manifest, f"{a.data}/raw/filings").write.mode("overwrite").parquet(f"{a.data}/filings")
    known = fl.resolve_ciks(manifest.select("ticker").distinct(), entries)
    facts = landing.company_facts(spark, f"{a.data}/raw/facts").join(known, "cik")
    fl.annual_metric(fl.facts_long(facts)).write.mode("overwrite").parquet(f"{a.data}/points")


def parse(spark, study, tax, a):
    """Sections, chunks and novelty of all filings; tells which sections are missing."""
    chunks, missing = jobs.parse(spark.read.parquet(f"{a.data}/filings"), tax)
    jobs.write_chunks(chunks, f"{a.data}/chunks")
    for r in missing.orderBy("ticker", "fiscal_year").collect():
        print(f"{r['ticker']} {r['fiscal_year']}: no {', '.join(r['missing'])}")


def goldset(spark, study, tax, a):
    """Draws the gold set and writes the worksheet to label."""
    rows = jobs.goldset(spark.read.parquet(f"{a.data}/chunks"), study, tax, f"{a.data}/worksheet", n=a.n, enriched_share=a.enriched_share, blind=not a.show_baseline)
    print(f"{rows.count()} rows in {a.data}/worksheet")


def classify(spark, study, tax, a):
    """Labels chunks with the keyword labeler; a model labeler is plugged in through jobs.classify."""
    preds, odd = jobs.classify(spark.read.parquet(f"{a.data}/chunks"), tax, limit=a.limit)
    preds.write.mode("overwrite").parquet(f"{a.data}/predictions")
    print(f"{odd.count()} chunks on which the keyword labeler disagrees")


def benchmark(spark, study, tax, a):
    """Scores predictions and keywords against the labelled worksheet; writes benchmark.json."""
    import json
    from pathlib import Path

    out = jobs.benchmark(spark, f"{a.data}/worksheet", spark.read.parquet(f"{a.data}/predictions"), tax, by_stratum=a.by_stratum)
    Path(a.data, "benchmark.json").write_text(json.dumps(jobs.benchmark_record(out, tax), indent=2), encoding="utf-8")
    for name, df in out.items():
        print(name)
        df.show(truncate=False)


def analyze(spark, study, tax, a):
    """Panel, first mentions and growth, as JSON."""
    out = jobs.analyze(spark.read.parquet(f"{a.data}/chunks"), spark.read.parquet(f"{a.data}/predictions"), spark.read.parquet(f"{a.data}/points"), study, tax, a.theme)
    for name, df in out.items():
        df.write.mode("overwrite").json(f"{a.data}/{name}")
    out["panel"].write.mode("overwrite").parquet(f"{a.data}/panel_table")


def memo(spark, study, tax, a):
    """A memo for each company with filings, and the findings across companies."""
    from pathlib import Path

    t = {k: spark.read.parquet(f"{a.data}/{k}") for k in ("chunks", "predictions", "points", "panel_table")}
    folder = Path(a.data) / "memos"
    folder.mkdir(parents=True, exist_ok=True)
    for name, text in jobs.memos(t["chunks"], t["predictions"], t["points"], t["panel_table"], study, tax, a.theme).items():
        (folder / f"{name}.md").write_text(text, encoding="utf-8")


COMMANDS = {f.__name__: f for f in (fetch, parse, goldset, classify, benchmark, analyze, memo)}


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="tidewright")
    p.add_argument("command", choices=COMMANDS)
    p.add_argument("--data", default="data")
    p.add_argument("--peers")
    p.add_argument("--taxonomy")
    p.add_argument("--theme", default="")
    p.add_argument("--ticker", default="")
    p.add_argument("--limit", type=int, default=0)
    p.add_argument("-n", type=int, default=400)
    p.add_argument("--enriched-share", type=float, default=0.5)
    p.add_argument("--show-baseline", action="store_true")
    p.add_argument("--by-stratum", action="store_true")
    a = p.parse_args(argv)
    study, tax = load_study(a.peers), load_taxonomy(a.taxonomy)
    a.theme = a.theme or tax.ids[0]
    COMMANDS[a.command](SparkSession.builder.appName("tidewright").getOrCreate(), study, tax, a)


if __name__ == "__main__":
    main()
