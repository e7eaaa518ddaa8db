"""Jobs: what a stage reads, which operators it chains, what it writes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chunks as ch
from ..operators import evaluate as ev
from ..operators import filings as fl
from ..operators import goldset as gs
from ..operators import labels as lb
from ..operators import novelty as nv
from ..operators import panel as pn
from ..operators import render as rd
from ..operators import sections as sc
from ..sources import landing


def fetch_manifest(tickers: DataFrame, entries: DataFrame, submissions: DataFrame, study, *, only: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(manifest, unresolved tickers). The manifest has a row for each filing of the study, with the path of
    its landed page."""
    wanted = tickers.where(F.upper("ticker").isin([t.upper() for t in only])) if only else tickers
    missing = fl.unresolved(wanted, entries)
    known = fl.resolve_ciks(wanted.join(missing.select("ticker"), "ticker", "left_anti"), entries)
    rows = fl.list_filings(submissions.join(known.select("cik", "ticker"), "cik"), forms=study.forms, start_year=study.start_year, end_year=study.end_year)
    return rows.withColumn("path", F.concat(F.format_string("%s-%d", "ticker", "fiscal_year"), F.lit(".html"))), missing


def parse(filings: DataFrame, taxonomy, *, min_chars: int = sc.MIN_SECTION_CHARS) -> tuple[DataFrame, DataFrame]:
    """filings: ticker, fiscal_year, accession, filing_date, html -> (annotated chunks, missing sections).
    All filings are chunked in parallel; novelty needs only the raw chunks of the filing before."""
    keys = ["ticker", "fiscal_year", "accession", "filing_date"]
    sections = sc.extract_sections(filings, keys, list(taxonomy.sections_in_scope), min_chars=min_chars).persist()
    return nv.mark_novelty(ch.chunk_sections(sections)), sc.missing_sections(filings, sections, ["ticker", "fiscal_year"], list(taxonomy.sections_in_scope))


def classify(chunks: DataFrame, taxonomy, *, model=None, model_name: str = "keywords", cache_path: str | None = None, limit: int = 0) -> tuple[DataFrame, DataFrame]:
    """(predictions, chunks on which the keyword labeler disagrees). A model's answers are appended to the Parquet
    table at ``cache_path``, and predictions are read from it: no chunk is sent twice, and no text that an earlier run has sent."""
    todo = chunks.orderBy("chunk_id").limit(limit) if limit else chunks
    if model is None:
        predicted = lb.keyword_predictions(todo, taxonomy)
    else:
        if cache_path is None:
            raise ValueError("a model needs a cache_path")
        spark = chunks.sparkSession
        held = lambda: spark.read.schema("key string, labels array<string>, rationale string").parquet(cache_path)
        spark.createDataFrame([], "key string, labels array<string>, rationale string").write.mode("append").parquet(cache_path)
        lb.classify(todo, taxonomy, model, model_name=model_name, cache=held())[1].write.mode("append").parquet(cache_path)
        predicted = lb.classify(todo, taxonomy, model, model_name=model_name, cache=held())[0]
    return predicted, lb.disagreements(todo, predicted, taxonomy)


def goldset(chunks: DataFrame, study, taxonomy, path: str, *, n: int = 400, enriched_share: float = 0.5, blind: bool = True) -> DataFrame:
    """Draws the gold set and writes its worksheet."""
    from ..config import with_cohort

    rows = gs.stratified_sample(with_cohort(chunks, study.table(chunks.sparkSession)), taxonomy, target_n=n, enriched_share=enriched_share).persist()
    gs.write_worksheet(rows, path, blind=blind)
    return rows


def benchmark(spark: SparkSession, worksheet: str, predictions: DataFrame, taxonomy, *, rounds: int = 1000, by_stratum: bool = False) -> dict[str, DataFrame]:
    """Scores predictions and keywords against the labelled rows of a worksheet: per theme, summaries,
    confusion; with ``by_stratum`` also summaries of the enriched and random rows."""
    gold = gs.labelled_only(gs.read_worksheet(spark, worksheet, taxonomy)).persist()
    if gold.isEmpty():
        raise ValueError("the worksheet has no labelled rows")
    none = F.array().cast("array<string>")
    base = gold.select(F.col("chunk_id").alias("id"), "stratum", "text", F.col("gold_labels").alias("gold"))
    model = base.join(lb.one_prediction(predictions).select(F.col("chunk_id").alias("id"), "labels"), "id", "left").select("id", "stratum", "gold", F.coalesce("labels", none).alias("pred")).persist()
    keywords = base.select("id", "stratum", "gold", lb.keyword_labels(F.col("text"), taxonomy).alias("pred")).persist()
    per, total = ev.evaluate(model, taxonomy.ids, rounds=rounds)
    k_per, k_total = ev.evaluate(keywords, taxonomy.ids, rounds=rounds)
    out = {"per_theme": per, "summary": total, "keyword_per_theme": k_per, "keyword_summary": k_total, "confusion": ev.confusion_pairs(model)}
    if by_stratum:
        out |= {f"summary_{s}": ev.summary(model.where(F.col("stratum") == s), taxonomy.ids) for s in ("enriched", "random")}
    return out


def benchmark_record(out: dict[str, DataFrame], taxonomy) -> dict:
    """The tables of ``benchmark`` as one record."""
    one = lambda name: out[name].first().asDict()
    model, keywords = one("summary"), one("keyword_summary")
    return {
        "n": model["n"],
        "taxonomy_version": taxonomy.version,
        "llm": {"micro_f1": model["micro_f1"], "macro_f1": model["macro_f1"], "ci": [model["micro_f1_low"], model["micro_f1_high"]], "per_theme": [r.asDict() for r in ev.as_rows(out["per_theme"]).collect()]},
        "keyword_baseline": {"micro_f1": keywords["micro_f1"], "macro_f1": keywords["macro_f1"]},
        "confusions": [[r["missed"], r["spurious"], r["n"]] for r in out["confusion"].collect()],
    }


def analyze(chunks: DataFrame, predictions: DataFrame, points: DataFrame, study, taxonomy, theme: str) -> dict[str, DataFrame]:
    """Panel, first mentions and the line-up with revenue growth. The panel is persisted: it is small and all else reads it."""
    spark = chunks.sparkSession
    panel = pn.build_panel(chunks, predictions, study.table(spark), taxonomy.table(spark)).persist()
    first = pn.first_mentions(panel, study.start_year)
    series = fl.yearly_series(fl.first_available(points))
    return {"panel": panel, "first_mentions": first, "theme_vs_financials": pn.join_financials(first, series, theme, start_year=study.start_year, end_year=study.end_year)}


def memos(chunks: DataFrame, predictions: DataFrame, points: DataFrame, panel: DataFrame, study, taxonomy, theme: str) -> dict[str, str]:
    """Markdown by name: one memo for each company with filings, and the findings across companies."""
    have = {r[0] for r in panel.select("ticker").distinct().collect()}
    years = list(range(study.start_year, study.end_year + 1))
    matrix = pn.theme_matrix(panel, years).persist()
    said = pn.quotes(chunks, predictions).persist()
    money = fl.first_available(points).persist()
    out = {t: rd.company_memo(t, study, taxonomy, years=years, points=money, matrix=matrix, quote_rows=said) for t in study.tickers if t in have}
    out["crosscut"] = rd.crosscut(panel, pn.first_mentions(panel, study.start_year), study, taxonomy, theme)
    return out


def write_chunks(chunks: DataFrame, path: str, *, fmt: str = "parquet") -> None:
    """Parquet by ticker, or JSON lines."""
    w = chunks.write.mode("overwrite")
    w.json(path) if fmt == "json" else w.partitionBy("ticker").parquet(path)


read_chunks = landing.read_chunks
