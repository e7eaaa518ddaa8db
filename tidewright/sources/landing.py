"""Landed raw files as frames: ticker map, submissions, facts, filing pages, JSON lines.

Fetching is a driver-side client (``FilingClient``) that fills the landing folder; every
reader below is a distributed scan of it.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECENT = "struct<form:array<string>,accessionNumber:array<string>,filingDate:array<string>,reportDate:array<string>,primaryDocument:array<string>>"
ENTRY = "struct<fy:int,fp:string,form:string,end:string,filed:string,accn:string,val:double>"
CHUNK = (
    "chunk_id string, ticker string, fiscal_year int, item string, ordinal int, text string, text_hash string, filing_accession string, filing_date string, is_new_language boolean, similarity_to_prior double"
)


class RateLimiter:
    """Keeps calls apart by at least 1 / rate seconds of a monotonic clock."""

    def __init__(self, requests_per_second: float = 8.0, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.gap, self.clock, self.sleep, self.last = 1.0 / requests_per_second, clock, sleep, None

    def wait(self) -> None:
        if self.last is not None and (left := self.last + self.gap - self.clock()) > 0:
            self.sleep(left)
        self.last = self.clock()


def cache_name(url: str) -> str:
    """File name of a URL in the landing folder: no scheme, / and ? as _, at most 200 characters."""
    return url.split("://", 1)[-1].replace("/", "_").replace("?", "_")[:200]


class FilingClient:
    """Fetches documents into the landing folder. ``transport(url, headers)`` returns (status, text)."""

    def __init__(self, user_agent: str, folder: str, transport: Callable[[str, dict], tuple[int, str]], requests_per_second: float = 8.0, sleep: Callable[[float], None] = time.sleep):
        if not user_agent or "@" not in user_agent:
            raise ValueError("the user agent must name a contact address")
        self.headers, self.folder, self.transport, self.sleep = {"User-Agent": user_agent}, Path(folder), transport, sleep
        self.limiter = RateLimiter(requests_per_second, sleep=sleep)

    def get_text(self, url: str, *, use_cache: bool = True) -> str:
        """The landed copy, else a fetch: four attempts with growing pauses on 429 and 503, any other failure at once."""
        path = self.folder / cache_name(url)
        if use_cache and path.exists():
            return path.read_text(encoding="utf-8")
        for attempt in range(4):
            self.limiter.wait()
            status, text = self.transport(url, self.headers)
            if status == 200:
                path.parent.mkdir(parents=True, exist_ok=True)
                path.write_text(text, encoding="utf-8")
                return text
            if status not in (429, 503):
                break
            self.sleep(2**attempt)
        raise RuntimeError(f"{url}: HTTP {status}")

    def get_json(self, url: str):
        return json.loads(self.get_text(url))


def _whole(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True)


def ticker_entries(spark: SparkSession, path: str) -> DataFrame:
    """pos, cik_str, ticker, title from the object of objects, in document order."""
    parsed = _whole(spark, path).select(F.from_json("value", "map<string,struct<cik_str:bigint,ticker:string,title:string>>").alias("m"))
    return parsed.select(F.posexplode(F.map_values("m")).alias("pos", "e")).select("pos", "e.*")


def submissions(spark: SparkSession, path: str) -> DataFrame:
    """cik, name, recent: one row a landed file."""
    s = f"struct<cik:bigint,name:string,filings:struct<recent:{RECENT}>>"
    return _whole(spark, path).select(F.from_json("value", s).alias("s")).select("s.cik", "s.name", F.col("s.filings.recent").alias("recent"))


def company_facts(spark: SparkSession, path: str) -> DataFrame:
    """cik, facts: maps by taxonomy and tag."""
    s = f"struct<cik:bigint,facts:map<string,map<string,struct<units:map<string,array<{ENTRY}>>>>>>"
    return _whole(spark, path).select(F.from_json("value", s).alias("s")).select("s.cik", "s.facts")


def with_pages(manifest: DataFrame, folder: str) -> DataFrame:
    """The manifest with ``html``, joined on its path column; a filing without a file is an error."""
    spark = manifest.sparkSession
    pages = spark.read.text(folder, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"[^/]+$", 0).alias("file"), F.col("value").alias("html"))
    joined = manifest.withColumn("file", F.regexp_extract("path", r"[^/]+$", 0)).join(pages, "file", "left")
    return joined.withColumn("html", F.when(F.col("html").isNull(), F.raise_error(F.concat(F.lit("no landed page: "), "path")).cast("string")).otherwise(F.col("html"))).drop("file")


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Chunks from JSON lines; a missing file names the stage that makes it."""
    try:
        return spark.read.schema(CHUNK).json(path)
    except Exception as e:
        raise FileNotFoundError(f"{path} can't be read: run the parse job first") from e


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
