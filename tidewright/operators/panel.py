"""Company x theme x year panel and what is read off it: first mentions, adoption,
escalation, growth. The panel is small (companies x themes x years); chunks are
aggregated once, before any dense grid is made."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import with_cohort
from .evaluate import ratio
from .labels import one_prediction


def build_panel(chunks: DataFrame, labels: DataFrame | None, peers: DataFrame, themes: DataFrame) -> DataFrame:
    """ticker, cohort, theme, fiscal_year, mentions, new_mentions, total_chunks, salience, new_salience.

    Every company-year with chunks has a row for every theme. All chunks count in the total, labelled or
    not; labels that are no theme vanish; a label given twice counts twice. labels: chunk_id,
    labels, one prediction a chunk (see ``one_prediction``); None if the chunks have a labels column of their own,
    which saves the join. themes: theme, ord (the dimension of the taxonomy)."""
    base = chunks.select("chunk_id", "ticker", "fiscal_year", "is_new_language", *(["labels"] if labels is None else []))
    totals = base.groupBy("ticker", "fiscal_year").agg(F.count(F.lit(1)).alias("total_chunks"))
    told = base if labels is None else base.join(one_prediction(labels), "chunk_id")
    said = told.select("ticker", "fiscal_year", "is_new_language", F.explode("labels").alias("theme"))
    mentions = said.groupBy("ticker", "fiscal_year", "theme").agg(F.count(F.lit(1)).alias("mentions"), F.count_if("is_new_language").alias("new_mentions"))
    ordered = themes.agg(F.array_sort(F.collect_list(F.struct("ord", "theme"))).alias("t"))  # one row: a taxonomy is a short list
    grid = totals.crossJoin(F.broadcast(ordered)).select("ticker", "fiscal_year", "total_chunks", F.explode("t").alias("z")).select("ticker", "fiscal_year", "total_chunks", F.col("z.theme").alias("theme"), F.col("z.ord").alias("theme_ord"))
    full = with_cohort(grid.join(mentions, ["ticker", "fiscal_year", "theme"], "left"), peers)
    m, n = F.coalesce("mentions", F.lit(0)).cast("long"), F.coalesce("new_mentions", F.lit(0)).cast("long")
    return full.select(
        "ticker", "cohort", "theme", "fiscal_year", m.alias("mentions"), n.alias("new_mentions"), "total_chunks",
        ratio(m.cast("double"), F.col("total_chunks")).alias("salience"), ratio(n.cast("double"), F.col("total_chunks")).alias("new_salience"), "first_covered_year", "theme_ord",
    )


def first_mentions(panel: DataFrame, start_year: int, *, min_mentions: int = 1) -> DataFrame:
    """ticker, cohort, theme, year, censored, lag_vs_peers for every company and theme of the panel.

    The lag is the year less the median year of the companies covered from the start. Censored: coverage
    began after the start, and the first mention falls in that first year."""
    years = panel.groupBy("ticker", "cohort", "first_covered_year", "theme").agg(F.min(F.when(F.col("mentions") >= min_mentions, F.col("fiscal_year"))).alias("year"))
    medians = years.where((F.col("first_covered_year") <= start_year) & F.col("year").isNotNull()).groupBy("theme").agg(F.median("year").alias("mid"))
    late = (F.col("first_covered_year") > start_year) & (F.col("year") == F.col("first_covered_year"))
    return years.join(medians, "theme", "left").select("ticker", "cohort", "theme", "year", F.coalesce(late, F.lit(False)).alias("censored"), F.round(F.col("year") - F.col("mid"), 2).alias("lag_vs_peers"))


def adoption_long(panel: DataFrame, theme: str) -> DataFrame:
    """fiscal_year, cohort, share (null where nobody is covered; three decimals), n: every year with every cohort of the panel."""
    grid = panel.select("fiscal_year").distinct().crossJoin(F.broadcast(panel.agg(F.collect_set("cohort").alias("c")))).select("fiscal_year", F.explode("c").alias("cohort"))
    rows = panel.where((F.col("theme") == theme) & (F.col("first_covered_year") <= F.col("fiscal_year")))
    cells = rows.groupBy("fiscal_year", "cohort").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("mentions") > 0).alias("k"))
    return grid.join(cells, ["fiscal_year", "cohort"], "left").select("fiscal_year", "cohort", F.round(F.try_divide(F.col("k").cast("double"), F.col("n")), 3).alias("share"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def adoption_curve(panel: DataFrame, theme: str, cohorts: list[str] | None = None) -> DataFrame:
    """The same, wide: for each cohort its share and ``{cohort}_n``."""
    long = adoption_long(panel, theme)
    names = cohorts or sorted(r[0] for r in panel.select("cohort").distinct().collect())
    wide = long.groupBy("fiscal_year").pivot("cohort", names).agg(F.first("share").alias("share"), F.first("n").alias("n"))
    return wide.select("fiscal_year", *[c for k in names for c in (F.col(f"`{k}_share`").alias(k), F.coalesce(f"`{k}_n`", F.lit(0)).alias(f"{k}_n"))]).orderBy("fiscal_year")


def escalation(panel: DataFrame, theme: str, *, top: int = 15, metric: str = "salience") -> DataFrame:
    """The largest rises over the year before: ticker, cohort, fiscal_year, salience, prior_salience, delta (four
    decimals), new_language_mentions. A gap year has no prior. Sorted by the rounded delta, then
    ticker and year. ``metric="new_salience"`` restricts it to new language."""
    rows = panel.where(F.col("theme") == theme)
    prior = rows.select("ticker", (F.col("fiscal_year") + 1).alias("fiscal_year"), F.col(metric).alias("prior"))
    both = rows.join(prior, ["ticker", "fiscal_year"])
    out = both.select(
        "ticker", "cohort", "fiscal_year", F.round(metric, 4).alias("salience"), F.round("prior", 4).alias("prior_salience"), F.round(F.col(metric) - F.col("prior"), 4).alias("delta"), F.col("new_mentions").alias("new_language_mentions")
    )
    return out.orderBy(F.desc("delta"), "ticker", "fiscal_year").limit(top)


def join_financials(first: DataFrame, series: DataFrame, theme: str, *, start_year: int, end_year: int) -> DataFrame:
    """ticker, cohort, first_mention_year, censored, lag_vs_peers, revenue_cagr for companies that mention the theme.
    series: ticker, fiscal_year, value, unique. The growth rate needs both end values, the first above and the
    last not below zero, and is null otherwise."""
    who = first.where((F.col("theme") == theme) & F.col("year").isNotNull())
    begin = series.where(F.col("fiscal_year") == start_year).select("ticker", F.col("value").alias("a"))
    end = series.where(F.col("fiscal_year") == end_year).select("ticker", F.col("value").alias("b"))
    span = end_year - start_year
    rate = F.when((F.col("a") > 0) & (F.col("b") > 0), F.round(F.pow(F.col("b") / F.col("a"), F.lit(1.0 / span)) - 1, 4)) if span > 0 else F.lit(None).cast("double")
    joined = who.join(begin, "ticker", "left").join(end, "ticker", "left")
    return joined.select("ticker", "cohort", F.col("year").alias("first_mention_year"), "censored", "lag_vs_peers", rate.alias("revenue_cagr")).orderBy("first_mention_year", "ticker")


def theme_matrix(panel: DataFrame, years: list[int], *, top_themes: int = 6) -> DataFrame:
    """For each company its most mentioned themes by year: ticker, rank, theme, one column a year ("0.123", with * for
    new language, null without filing). Ties in taxonomy order."""
    from pyspark.sql import Window

    totals = panel.groupBy("ticker", "theme", "theme_ord").agg(F.sum("mentions").alias("m"))
    best = totals.withColumn("rank", F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("m"), "theme_ord"))).where(F.col("rank") <= top_themes).select("ticker", "theme", "rank")
    cell = F.concat(F.format_string("%.3f", "salience"), F.when(F.col("new_mentions") > 0, "*").otherwise(""))
    return panel.join(best, ["ticker", "theme"]).groupBy("ticker", "rank", "theme").pivot("fiscal_year", years).agg(F.first(cell)).orderBy("ticker", "rank")


def quotes(chunks: DataFrame, labels: DataFrame, *, each: int = 5) -> DataFrame:
    """ticker, theme, fiscal_year, excerpt, rn: the newest new-language chunks of each company, one row a label; over
    400 characters are cut to 397 and three dots."""
    from pyspark.sql import Window

    rows = chunks.where("is_new_language").select("ticker", "fiscal_year", "chunk_id", "text").join(one_prediction(labels), "chunk_id").select("ticker", "fiscal_year", "chunk_id", "text", F.posexplode("labels").alias("p", "theme"))
    by = Window.partitionBy("ticker").orderBy(F.desc("fiscal_year"), "chunk_id", "p")
    short = F.when(F.length("text") <= 400, F.col("text")).otherwise(F.concat(F.substring("text", 1, 397), F.lit("...")))
    return rows.withColumn("rn", F.row_number().over(by)).where(F.col("rn") <= each).select("ticker", "theme", "fiscal_year", short.alias("excerpt"), "rn")
