"""End to end over our own small filings, the incremental ingest, and the entry points."""

from pathlib import Path

from tidewright.plans import jobs
from tidewright.config import Cohort, Peer, Study, Taxonomy, Theme
from tidewright.streaming.ingest import ingest_filings

TAX = Taxonomy("1", (Theme("isv", "ISV", keywords=("software vendor",)), Theme("fx", "FX", keywords=("currency",))))
STUDY = Study("s", 2020, 2023, (Cohort("old", "", ""),), (Peer("AA", "A Co", "old", 0),))



BASE = "Our merchants rely on many partners, and fees are set by contract with each of them in turn. "


def filing(year, extra=""):
    body = "".join(f"<p>{BASE * 3} part {i} &amp; more.</p>" for i in range(6))
    return f"<html><body><p>Item 1. Business</p><p>Item 1A. Risk Factors</p><h2>Item 1. Business</h2>{body}<h2>Item 1A. Risk Factors</h2>{body}{extra}<h2>Item 8. Financial Statements</h2></body></html>"


def test_parse_analyze_and_memos(spark):
    new = "<p>" + "Every software vendor now bundles payments, which takes our merchants away from us. " * 4 + "</p>"
    rows = [("AA", 2020, "a0", "2021-02-01", filing(2020)), ("AA", 2021, "a1", "2022-02-01", filing(2021, new))]
    f = spark.createDataFrame(rows, "ticker string, fiscal_year int, accession string, filing_date string, html string")
    chunks, missing = jobs.parse(f, TAX, min_chars=200)
    chunks = chunks.persist()
    fresh = [r for r in chunks.where("is_new_language AND fiscal_year = 2021").collect()]
    assert len(fresh) == 1 and "software vendor" in fresh[0]["text"] and fresh[0]["similarity_to_prior"] == 0.0
    assert {tuple(r["missing"]) for r in missing.collect()} == {("item7",)}
    preds, odd = jobs.classify(chunks, TAX)
    assert odd.count() == 0
    points = spark.createDataFrame([("AA", "Revenues", "USD", 2020, "FY", "2020-12-31", 1e9, "2021-02-01", "a", "10-K")], "ticker string, tag string, unit string, fiscal_year int, fiscal_period string, period_end string, value double, filed string, accession string, form string")
    out = jobs.analyze(chunks, preds, points, STUDY, TAX, "isv")
    assert out["first_mentions"].where("theme = 'isv'").first()["year"] == 2021
    texts = jobs.memos(chunks, preds, points, out["panel"], STUDY, TAX, "isv")
    assert set(texts) == {"AA", "crosscut"} and "| 2020 | 1,000 |" in texts["AA"]


def test_ingest_reads_each_filing_once(spark, tmp_path):
    src, sink, mark = (str(tmp_path / x) for x in ("src", "sink", "mark"))
    one = spark.createDataFrame([("AA", 2020, "a0", "2021-02-01", filing(2020))], "ticker string, fiscal_year int, accession string, filing_date string, html string")
    one.write.parquet(src)
    ingest_filings(spark, src, sink, mark, scope=["item1", "item1a"], min_chars=200)
    n = spark.read.parquet(sink).count()
    ingest_filings(spark, src, sink, mark, scope=["item1", "item1a"], min_chars=200)
    assert n > 0 and spark.read.parquet(sink).count() == n


def test_entry_points(spark):
    import __spark_entry__ as e

    q, o = e.queries(), e.oracle_sql()
    assert set(o) <= set(q) and e.entry(spark).count() > 0


def test_import_without_session():
    """Modules must import before a session exists."""
    import subprocess
    import sys

    root = Path(__file__).resolve().parent.parent
    assert subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; e.queries()"], cwd=root).returncode == 0


def test_cagr_join_reads_every_nation(spark, tmp_path):
    from tidewright.plans import queries as pq

    n = 1200
    spark.range(n).selectExpr("id AS n_nationkey", "concat('n', id) AS n_name").coalesce(1).write.parquet(f"{tmp_path}/nation.parquet")
    spark.range(n).selectExpr("id AS c_custkey", "id AS c_nationkey").write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(2 * n).selectExpr("id % 1200 AS o_custkey", "date'1996-05-01' AS o_orderdate", "100.0D AS o_totalprice").write.parquet(f"{tmp_path}/orders.parquet")
    assert pq.cagr_join(spark, str(tmp_path)).count() == n


def test_predictions_given_twice_count_once(spark):
    from pyspark.errors import PySparkException
    import pytest

    from tidewright.operators import labels as lb
    from tidewright.operators import panel as pn

    c = spark.createDataFrame([("a", "AA", 2020, True), ("b", "AA", 2020, False)], "chunk_id string, ticker string, fiscal_year int, is_new_language boolean")
    p = spark.createDataFrame([("a", ["isv"], 0), ("a", ["isv"], 1), ("b", ["fx"], 2), ("b", ["isv"], 3)], "chunk_id string, labels array<string>, pos int")
    mentions = {(r["theme"]): r["mentions"] for r in pn.build_panel(c, p, STUDY.table(spark), TAX.table(spark)).collect()}
    assert mentions == {"isv": 2, "fx": 0}
    same = p.drop("pos").where("chunk_id = 'a'")
    assert {r["theme"]: r["mentions"] for r in pn.build_panel(c, same, STUDY.table(spark), TAX.table(spark)).collect()} == {"isv": 1, "fx": 0}
    with pytest.raises(PySparkException):
        lb.one_prediction(p.drop("pos")).collect()


def test_classify_keeps_a_cache(spark, tmp_path):
    import json

    sent = spark.sparkContext.accumulator(0)

    def model(texts):
        sent.add(len(texts))
        return json.dumps([{"index": i, "labels": ["isv"] if "vendor" in t else []} for i, t in enumerate(texts)])

    c = spark.createDataFrame([(f"c{i}", "a vendor" if i % 2 else f"text {i}") for i in range(10)], "chunk_id string, text string")
    for _ in range(2):
        preds, _odd = jobs.classify(c, TAX, model=model, model_name="m", cache_path=str(tmp_path / "cache"))
        assert {r["chunk_id"]: r["labels"] for r in preds.collect()} == {f"c{i}": ["isv"] if i % 2 else [] for i in range(10)}
        assert sent.value == 10
    assert spark.read.parquet(str(tmp_path / "cache")).count() == 6
