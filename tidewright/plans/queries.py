"""Queries of the disclosure operators over the driver's tables, and the same in DuckDB's SQL.

A document stands for a chunk: its source is the company, its id decides the fiscal year, and its language is
the item. Every query reads whole tables.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Cohort, Peer, Study, Taxonomy, Theme
from ..functions import text as tx
from ..operators import chunks as ch
from ..operators import evaluate as ev
from ..operators import filings as fl
from ..operators import goldset as gs
from ..operators import labels as lb
from ..operators import novelty as nv
from ..operators import panel as pn
from ..operators import sections as sc

#: A taxonomy of words that occur in the tables.
TAXONOMY = Taxonomy(
    "1",
    (
        Theme("able", "Ability", keywords=("thble", "theable")),
        Theme("action", "Action", keywords=("thtion", "thetion")),
        Theme("denial", "Denial", keywords=("nicht", "not")),
        Theme("object", "Object", keywords=("thing",)),
        Theme("state", "State", keywords=("étion", "menttion")),
        Theme("unused", "Unused", keywords=()),
    ),
)
THEME = "object"
COHORTS = ("incumbent", "software_led", "specialist")
STUDY = Study(
    "tables",
    2020,
    2025,
    tuple(Cohort(c, c, "") for c in COHORTS),
    tuple(Peer(f"src{i}", f"Source {i}", COHORTS[i % 3], i) for i in range(20)),
    {f"src{i}": 2021 for i in range(3, 20, 4)},
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunk_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chunks."""
    d = _table(spark, sf_dir, "documents")
    year = (F.lit(2020) + F.pmod(F.floor(F.col("doc_id") / 20), F.lit(6))).cast("int")
    return d.select(
        F.col("doc_id").cast("string").alias("chunk_id"), F.col("source").alias("ticker"), year.alias("fiscal_year"), F.col("lang").alias("item"), F.col("doc_id").alias("ordinal"), "text",
        tx.text_hash(F.col("text")).alias("text_hash"), F.concat_ws("-", "source", year).alias("filing_accession"), F.lit("").alias("filing_date"), (F.col("doc_id") % 3 == 0).alias("is_new_language"), F.lit(0.0).alias("similarity_to_prior"),
    )


def _labels(chunks: DataFrame) -> DataFrame:
    return chunks.select("chunk_id", tx.keyword_labels(F.col("text"), TAXONOMY).alias("labels"))


def _panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = chunk_rows(spark, sf_dir)
    return pn.build_panel(c.withColumn("labels", tx.keyword_labels(F.col("text"), TAXONOMY)), None, STUDY.table(spark), TAXONOMY.table(spark))


def keyword_labels(spark, sf_dir):
    d = _table(spark, sf_dir, "documents")
    return d.select("doc_id", F.array_join(tx.keyword_labels(F.col("text"), TAXONOMY), "|").alias("labels"))


def text_hash(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", tx.text_hash(F.col("text")).alias("text_hash"))


def theme_panel(spark, sf_dir):
    return _panel(spark, sf_dir).select("ticker", "cohort", "theme", "fiscal_year", "mentions", "new_mentions", "total_chunks", "salience", "new_salience")


def first_mention(spark, sf_dir):
    return pn.first_mentions(_panel(spark, sf_dir), STUDY.start_year)


def first_mention_min3(spark, sf_dir):
    return pn.first_mentions(_panel(spark, sf_dir), STUDY.start_year, min_mentions=3)


def adoption_curve(spark, sf_dir):
    return pn.adoption_curve(_panel(spark, sf_dir), THEME, list(COHORTS))


def escalation_topk(spark, sf_dir):
    return pn.escalation(_panel(spark, sf_dir), THEME)


def escalation_new_language(spark, sf_dir):
    return pn.escalation(_panel(spark, sf_dir), THEME, metric="new_salience")


def novelty(spark, sf_dir):
    return nv.mark_novelty(chunk_rows(spark, sf_dir)).select("chunk_id", "is_new_language", "similarity_to_prior")


def chunk_paragraphs(spark, sf_dir):
    d = _table(spark, sf_dir, "documents")
    s = d.select(F.col("source").alias("ticker"), F.lit(2020).alias("fiscal_year"), F.col("doc_id").cast("string").alias("item"), "text")
    return ch.chunk_sections(s).select("chunk_id", "ordinal", F.length("text").alias("n_chars"), "text_hash")


def html_flatten(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", F.md5(tx.flatten_html(F.col("html"))).alias("text_md5"))


def _filing_text():
    """A text with a contents list, two sections and a cross-reference."""
    t = F.regexp_replace("text", r"\s+", " ")
    t = F.trim(t)
    return F.concat(F.lit("Item 1. Business 3\nItem 1A. Risk Factors 9\nItem 1. Business\n"), t, F.lit("\nItem 1A: Risk  Factors\n"), t, F.lit(" "), t, F.lit("\nsee ITEM 1. BUSINESS above\nItem 9A Controls\n"), F.substring(t, 1, 100))


def section_longest(spark, sf_dir):
    d = _table(spark, sf_dir, "documents").select("doc_id", _filing_text().alias("text"))
    return sc.split_items(d, ["doc_id"], min_chars=300).select("doc_id", "item", "char_count", F.md5("text").alias("text_md5"))


def missing_sections(spark, sf_dir):
    d = _table(spark, sf_dir, "documents").select("doc_id", _filing_text().alias("text"))
    found = sc.split_items(d, ["doc_id"], min_chars=300)
    return sc.missing_sections(d, found, ["doc_id"], ["item1", "item1a", "item7"]).select("doc_id", F.array_join("missing", "|").alias("missing"))


def list_filings(spark, sf_dir):
    o = _table(spark, sf_dir, "orders")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    e = o.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", F.col("o_orderpriority").alias("f"), day.alias("d")))).alias("e"))
    accession = F.transform("e", lambda x: F.concat(F.lit("a-"), x["o_orderkey"].cast("string")))
    recent = F.struct(F.col("e.f").alias("form"), accession.alias("accessionNumber"), F.col("e.d").alias("filingDate"), F.col("e.d").alias("reportDate"), accession.alias("primaryDocument"))
    s = e.select(F.col("o_custkey").alias("cik"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("ticker"), recent.alias("recent"))
    return fl.list_filings(s, forms=("1-urgent", "2-HIGH"), start_year=1996, end_year=1999).select("cik", "ticker", "form", "accession", "report_date", "fiscal_year", "url")


def point_in_time(spark, sf_dir):
    li = _table(spark, sf_dir, "lineitem")
    e = li.select(
        F.col("l_suppkey").cast("string").alias("ticker"), F.col("l_returnflag").alias("tag"), F.lit("USD").alias("unit"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"), F.lit(None).cast("int").alias("fy"),
        F.when(F.col("l_linestatus") == "F", "FY").otherwise("Q2").alias("fp"), F.lit("10-K").alias("form"), F.date_format("l_shipdate", "yyyy-MM").alias("end"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("filed"), F.col("l_orderkey").cast("string").alias("accn"), F.col("l_extendedprice").alias("val"),
    )
    return fl.annual_metric(e).select("ticker", "tag", "period_end", "fiscal_year", "value", "filed", "accession")


def first_available(spark, sf_dir):
    e = _table(spark, sf_dir, "events")
    points = e.groupBy(F.col("user_id").alias("ticker"), F.col("event_type").alias("tag")).agg(F.count(F.lit(1)).alias("n"))
    return fl.first_available(points, {"intent": ("purchase", "signup", "click"), "trouble": ("error",)}).select("ticker", "metric", "tag", "n")


def cagr_join(spark, sf_dir):
    o = _table(spark, sf_dir, "orders").join(_table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(_table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    rows = o.groupBy(F.col("n_name").alias("ticker"), F.year("o_orderdate").alias("fiscal_year")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("value"), F.count(F.lit(1)).alias("k"))
    first = rows.groupBy("ticker").agg(F.min(F.when(F.col("k") % 2 == 0, F.col("fiscal_year"))).alias("year")).select("ticker", F.lit("c").alias("cohort"), F.lit("t").alias("theme"), "year", F.lit(False).alias("censored"), F.lit(None).cast("double").alias("lag_vs_peers"))
    return pn.join_financials(first, rows.select("ticker", "fiscal_year", "value"), "t", start_year=1996, end_year=2000).select("ticker", "first_mention_year", "revenue_cagr")


def _scored(spark, sf_dir):
    """Labels as gold, a rule on the text as prediction."""
    pick = lambda *pairs: F.array_compact(F.array(*[F.when(c, F.lit(v)) for c, v in pairs]))
    gold = pick((F.col("quality") == 0, "poor"), (F.col("toxic") == 1, "toxic"))
    pred = pick((F.col("text").contains("|") | F.col("text").contains("!!"), "poor"), (F.col("text").contains("trash") | F.col("text").contains("scum"), "toxic"), (F.length("text") > 6000, "long"))
    d = _table(spark, sf_dir, "documents").select("doc_id", pred.alias("pred"))  # before the join, which then shuffles no text
    return _table(spark, sf_dir, "labels").join(d, "doc_id").select(F.col("doc_id").alias("id"), gold.alias("gold"), "pred")


SCORED_THEMES = ["poor", "toxic", "long"]


def evaluate_themes(spark, sf_dir):
    return ev.with_prf(ev.counts(_scored(spark, sf_dir), SCORED_THEMES)).drop("ord")


def evaluate_summary(spark, sf_dir):
    return ev.summary(_scored(spark, sf_dir), SCORED_THEMES)


def confusion_pairs(spark, sf_dir):
    return ev.confusion_pairs(_scored(spark, sf_dir))


def cohens_kappa(spark, sf_dir):
    return ev.kappa(_scored(spark, sf_dir), "toxic")


def bootstrap_ci(spark, sf_dir):
    return ev.bootstrap(_scored(spark, sf_dir), SCORED_THEMES).select(F.coalesce("theme", F.lit("micro")).alias("theme"), "f1_low", "f1_high")


def stratified_sample(spark, sf_dir):
    from ..config import with_cohort

    c = with_cohort(chunk_rows(spark, sf_dir), STUDY.table(spark))
    return gs.stratified_sample(c, TAXONOMY).select("chunk_id", "cohort", "fiscal_year", "item", "stratum", F.array_join("baseline_labels", "|").alias("baseline_labels"))


def label_disagreements(spark, sf_dir):
    c = chunk_rows(spark, sf_dir)
    p = c.select("chunk_id", F.when(F.length("text") % 2 == 0, F.array(F.lit("object"))).otherwise(F.array().cast("array<string>")).alias("labels"))
    return lb.disagreements(c, p, TAXONOMY).select("chunk_id", F.array_join("keyword_labels", "|").alias("keyword_labels"), F.array_join("labels", "|").alias("labels"))


def label_cache(spark, sf_dir):
    """Keys of the chunks whose label a cache of every third one lacks."""
    c = chunk_rows(spark, sf_dir).select("chunk_id", "ordinal", tx.cache_key(F.col("text"), "1", "m").alias("key"))
    held = c.where(F.col("ordinal") % 3 == 0).select("key").distinct()
    return c.join(held, "key", "left_anti").select("chunk_id", "key")


def _model(texts: list[str]) -> str:
    """Stands for a model: its answer as text, around the JSON that is asked for."""
    return "Labels: " + json.dumps([{"index": i, "labels": ["object", "no theme"] if "thing" in t else []} for i, t in enumerate(texts)])


def classify_chunks(spark, sf_dir):
    """Labels of all chunks: those of every third one from a cache, the others from a model."""
    c = chunk_rows(spark, sf_dir)
    held = c.where(F.col("ordinal") % 3 == 0).select(tx.cache_key(F.col("text"), TAXONOMY.version, "m").alias("key"), F.array(F.lit("able")).alias("labels"), F.lit("").alias("rationale"))
    return lb.classify(c, TAXONOMY, _model, model_name="m", cache=held)[0].select("chunk_id", F.array_join("labels", "|").alias("labels"), "model")


def yearly_series(spark, sf_dir):
    """The last order of a customer's year stands for the latest period."""
    o = _table(spark, sf_dir, "orders")
    end = F.concat_ws("-", F.date_format("o_orderdate", "yyyy-MM-dd"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0"))
    points = o.select(F.col("o_custkey").cast("string").alias("ticker"), F.lit("revenue").alias("metric"), F.year("o_orderdate").alias("fiscal_year"), end.alias("period_end"), F.col("o_totalprice").alias("value"))
    return fl.yearly_series(points).select("ticker", "fiscal_year", "value")


def parse_response(spark, sf_dir):
    """Responses made of conversations: the object of turn 1 has no index, turn 2 has two objects."""
    t = _table(spark, sf_dir, "conversations").where(F.col("turn").isNotNull())
    obj = F.when(F.col("turn") == 1, F.format_string('{"labels": ["l%d"]}', F.length("text"))).otherwise(F.format_string('{"index": %d, "labels": ["l%d"], "rationale": "%s"}', "turn", F.length("text"), "role"))
    g = t.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text", obj.alias("o")))).alias("s"), F.count(F.lit(1)).alias("n"))
    raw = F.concat(F.lit("Here: ["), F.array_join("s.o", ", "), F.lit("] done"))
    r = lb.parse_response(g.select("conv_id", raw.alias("raw"), F.col("n").cast("int").alias("n")), keys=["conv_id"])
    return r.select("conv_id", "index", F.array_join("labels", "|").alias("labels"), "rationale")


def quotes_topk(spark, sf_dir):
    c = chunk_rows(spark, sf_dir)
    return pn.quotes(c, _labels(c)).select("ticker", "theme", "fiscal_year", "rn", F.md5("excerpt").alias("excerpt_md5"))


def theme_matrix(spark, sf_dir):
    m = pn.theme_matrix(_panel(spark, sf_dir), list(range(2020, 2026)))
    return m.select("ticker", "rank", "theme", *[F.col(str(y)).alias(f"fy{y}") for y in range(2020, 2026)])


QUERIES = {
    f.__name__: f
    for f in (
        keyword_labels, text_hash, theme_panel, first_mention, first_mention_min3, adoption_curve, escalation_topk, escalation_new_language, novelty, chunk_paragraphs, html_flatten, section_longest, missing_sections,
        list_filings, point_in_time, first_available, cagr_join, evaluate_themes, evaluate_summary, confusion_pairs, cohens_kappa, bootstrap_ci, stratified_sample, label_disagreements, classify_chunks, yearly_series, label_cache, parse_response, quotes_topk, theme_matrix,
    )
}


def _keyword_sql(theme: Theme) -> str:
    words = "|".join(theme.keywords)
    return f"regexp_matches(lower(text), '(^|[^a-z0-9])({words})(es|s)?([^a-z0-9]|$)')"


_NORM = "trim(regexp_replace(regexp_replace(regexp_replace(lower(text), '\\b\\d[\\d,\\.]*\\b', ' 0 ', 'g'), '[^a-z0-9 ]+', ' ', 'g'), ' +', ' ', 'g'))"
_LABELS = "list_filter([" + ", ".join(f"CASE WHEN {_keyword_sql(t)} THEN '{t.id}' END" for t in TAXONOMY.themes if t.keywords) + "], lambda x: x IS NOT NULL)"
_CHUNKS = f"""c AS (SELECT doc_id, doc_id::VARCHAR AS chunk_id, source AS ticker, (2020 + (doc_id // 20) % 6)::INT AS fiscal_year, lang AS item, text, doc_id % 3 = 0 AS is_new, {_LABELS} AS labels FROM documents)"""
_PEERS = "peers AS (SELECT * FROM (VALUES " + ", ".join(f"('{p.ticker}', '{p.cohort}', {STUDY.first_covered_year(p.ticker)})" for p in STUDY.peers) + ") v(ticker, cohort, covered))"
_THEMES = "themes AS (SELECT * FROM (VALUES " + ", ".join(f"('{t.id}', {i})" for i, t in enumerate(TAXONOMY.themes)) + ") v(theme, ord))"
_PANEL = f"""{_CHUNKS}, {_PEERS}, {_THEMES},
totals AS (SELECT ticker, fiscal_year, count(*) AS total_chunks FROM c GROUP BY ALL),
said AS (SELECT ticker, fiscal_year, is_new, unnest(labels) AS theme FROM c),
m AS (SELECT ticker, fiscal_year, theme, count(*) AS mentions, count(*) FILTER (is_new) AS new_mentions FROM said GROUP BY ALL),
panel AS (SELECT t.ticker, p.cohort, p.covered, h.theme, h.ord, t.fiscal_year, coalesce(m.mentions, 0) AS mentions, coalesce(m.new_mentions, 0) AS new_mentions, t.total_chunks,
 coalesce(m.mentions, 0)::DOUBLE / t.total_chunks AS salience, coalesce(m.new_mentions, 0)::DOUBLE / t.total_chunks AS new_salience
 FROM totals t CROSS JOIN themes h JOIN peers p USING (ticker) LEFT JOIN m ON m.ticker = t.ticker AND m.fiscal_year = t.fiscal_year AND m.theme = h.theme)"""


def _first_sql(least: int) -> str:
    return f"""WITH {_PANEL}, y AS (SELECT ticker, cohort, covered, theme, min(fiscal_year) FILTER (mentions >= {least}) AS year FROM panel GROUP BY ALL),
med AS (SELECT theme, median(year) AS mid FROM y WHERE covered <= 2020 AND year IS NOT NULL GROUP BY theme)
SELECT ticker, cohort, y.theme, year, coalesce(covered > 2020 AND year = covered, false) AS censored, round(year - mid, 2)::DOUBLE AS lag_vs_peers FROM y LEFT JOIN med ON y.theme = med.theme"""


def _escalation_sql(metric: str) -> str:
    return f"""WITH {_PANEL}, r AS (SELECT * FROM panel WHERE theme = '{THEME}')
SELECT a.ticker, a.cohort, a.fiscal_year, round(a.{metric}, 4) AS salience, round(b.{metric}, 4) AS prior_salience, round(a.{metric} - b.{metric}, 4) AS delta, a.new_mentions AS new_language_mentions
FROM r a JOIN r b ON a.ticker = b.ticker AND a.fiscal_year = b.fiscal_year + 1 ORDER BY delta DESC, ticker, fiscal_year LIMIT 15"""


_FLAT = "html"
for _name in tx.RAW_ELEMENTS:
    _FLAT = f"regexp_replace({_FLAT}, '<{_name}[^>]*>.*?</{_name}>', ' ', 'gis')"
_FLAT = f"regexp_replace({_FLAT}, '</?({'|'.join(tx.BLOCK_ELEMENTS)})\\b[^>]*>', chr(10), 'gi')"
_FLAT = f"regexp_replace({_FLAT}, '<[^>]+>', ' ', 'g')"
# the references that the pages have; without a semicolon &amp and &quot also count
_FLAT = f"replace(regexp_replace(regexp_replace(replace(replace({_FLAT}, '&middot;', '·'), '&copy;', '©'), '&quot;?', '\"', 'g'), '&amp;?', '&', 'g'), chr(160), ' ')"
_FLAT = f"regexp_replace({_FLAT}, '[ \\t\\r\\f\\x0B]+', ' ', 'g')"
_FLAT = f"regexp_replace({_FLAT}, '(?m)^ +| +$', '', 'g')"
_FLAT = f"trim(regexp_replace({_FLAT}, '\\n{{3,}}', chr(10) || chr(10), 'g'), ' ' || chr(10))"

_FILING = r"""f AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents),
parts AS (SELECT doc_id, 'item1' AS item, t AS body FROM f UNION ALL SELECT doc_id, 'item1a', t || ' ' || t || chr(10) || 'see' FROM f UNION ALL SELECT doc_id, 'item9a', trim(left(t, 100)) FROM f),
found AS (SELECT * FROM parts WHERE length(body) >= 300)"""
_SCORED = """s AS (SELECT doc_id AS id, list_filter([CASE WHEN quality = 0 THEN 'poor' END, CASE WHEN toxic = 1 THEN 'toxic' END], lambda x: x IS NOT NULL) AS gold,
list_filter([CASE WHEN contains(text, '|') OR contains(text, '!!') THEN 'poor' END, CASE WHEN contains(text, 'trash') OR contains(text, 'scum') THEN 'toxic' END, CASE WHEN length(text) > 6000 THEN 'long' END], lambda x: x IS NOT NULL) AS pred
FROM labels JOIN documents USING (doc_id)),
th AS (SELECT * FROM (VALUES ('poor', 0), ('toxic', 1), ('long', 2)) v(theme, ord))"""
_PRF = "CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) ELSE 0 END AS recall"
_F1 = "CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1"
_COUNTS = f"""{_SCORED}, k AS (SELECT theme, count(*) FILTER (list_contains(gold, theme)) AS support, count(*) FILTER (list_contains(gold, theme) AND list_contains(pred, theme)) AS tp, count(*) FILTER (NOT list_contains(gold, theme) AND list_contains(pred, theme)) AS fp,
count(*) FILTER (list_contains(gold, theme) AND NOT list_contains(pred, theme)) AS fn FROM s CROSS JOIN th GROUP BY theme), pr AS (SELECT *, {_PRF} FROM k), f1 AS (SELECT *, {_F1} FROM pr)"""

_STRIP = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"
#: What follows the last chr(1) of a.
_HELD = "string_split(a, chr(1))[-1]"

ORACLE_SQL = {
    "keyword_labels": f"SELECT doc_id, array_to_string({_LABELS}, '|') AS labels FROM documents",
    "text_hash": f"SELECT doc_id, left(sha256({_NORM}), 16) AS text_hash FROM documents",
    "theme_panel": f"WITH {_PANEL} SELECT ticker, cohort, theme, fiscal_year, mentions, new_mentions, total_chunks, salience, new_salience FROM panel",
    "first_mention": _first_sql(1),
    "first_mention_min3": _first_sql(3),
    "adoption_curve": f"""WITH {_PANEL}, y AS (SELECT DISTINCT fiscal_year FROM panel), r AS (SELECT * FROM panel WHERE theme = '{THEME}' AND covered <= fiscal_year)
SELECT y.fiscal_year, """
    + ", ".join(f"round(count(*) FILTER (cohort = '{c}' AND mentions > 0)::DOUBLE / nullif(count(*) FILTER (cohort = '{c}'), 0), 3) AS {c}, count(*) FILTER (cohort = '{c}') AS {c}_n" for c in COHORTS)
    + " FROM y LEFT JOIN r USING (fiscal_year) GROUP BY y.fiscal_year",
    "escalation_topk": _escalation_sql("salience"),
    "escalation_new_language": _escalation_sql("new_salience"),
    "chunk_paragraphs": f"""WITH l AS (
    SELECT doc_id, source, list_filter(list_transform(string_split(text, chr(10)), lambda x: {_STRIP.format("x")}), lambda x: x <> '') AS lines FROM documents),
-- a fold over texts: what is finished ends with chr(1), what is held follows
m AS (SELECT doc_id, source, string_split(list_reduce(list_prepend('', lines), lambda a, x: a || CASE WHEN {_HELD} = '' THEN '' ELSE ' ' END || x
    || CASE WHEN length({_HELD}) + CASE WHEN {_HELD} = '' THEN 0 ELSE 1 END + length(x) >= {ch.MIN_CHUNK_CHARS} THEN chr(1) ELSE '' END), chr(1)) AS parts FROM l),
p AS (SELECT doc_id, source, unnest(CASE WHEN parts[-1] = '' THEN parts[:-2] WHEN len(parts) = 1 THEN parts
    ELSE list_append(parts[:-3], parts[-2] || ' ' || parts[-1]) END) AS para, unnest(range(len(parts))) AS i FROM m),
w AS (SELECT doc_id, source, i, CASE WHEN length(para) <= {ch.MAX_CHUNK_CHARS} THEN [para] ELSE string_split(list_reduce(
    list_prepend('', string_split(regexp_replace(para, '([.?!])\\s+([A-Z(])', '\\1' || chr(2) || '\\2', 'g'), chr(2))),
    lambda a, x: CASE WHEN {_HELD} <> '' AND length({_HELD}) + length(x) + 1 > {ch.MAX_CHUNK_CHARS} THEN a || chr(1) || x WHEN {_HELD} = '' THEN a || x ELSE a || ' ' || x END), chr(1)) END AS pieces FROM p WHERE para IS NOT NULL),
k AS (SELECT doc_id, source, i, unnest(pieces) AS text, unnest(range(len(pieces))) AS j FROM w),
o AS (SELECT doc_id, source, text, row_number() OVER (PARTITION BY doc_id ORDER BY i, j) - 1 AS ordinal FROM k WHERE length(text) >= {ch.MIN_CHUNK_CHARS})
SELECT source || '-2020-' || doc_id || '-' || printf('%04d', ordinal) AS chunk_id, ordinal::INT AS ordinal, length(text)::INT AS n_chars, left(sha256({_NORM}), 16) AS text_hash FROM o""",
    "novelty": f"""WITH {_CHUNKS}, n AS (SELECT *, {_NORM} AS norm FROM c), w AS (SELECT *, list_filter(string_split(norm, ' '), lambda x: x <> '') AS words FROM n),
s AS (SELECT chunk_id, doc_id, ticker, fiscal_year, item, norm, CASE WHEN len(words) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(len(words) - 4, 1) + 1), lambda i: array_to_string(words[i : i + 4], ' '))) END AS sh FROM w),
rk AS (SELECT ticker, fiscal_year, row_number() OVER (PARTITION BY ticker ORDER BY fiscal_year) AS r FROM (SELECT DISTINCT ticker, fiscal_year FROM c)),
x AS (SELECT s.*, rk.r FROM s JOIN rk USING (ticker, fiscal_year)),
pairs AS (SELECT a.chunk_id, b.doc_id AS p, a.norm = b.norm AS same, a.item = b.item AS near, len(list_intersect(a.sh, b.sh)) AS i, len(a.sh) AS la, len(b.sh) AS lb FROM x a JOIN x b ON a.ticker = b.ticker AND a.r = b.r + 1),
sc AS (SELECT chunk_id, p, same, CASE WHEN near AND la > 0 AND lb > 0 THEN i::DOUBLE / (la + lb - i) ELSE 0 END AS sim FROM pairs),
best AS (SELECT chunk_id, bool_or(same) AS seen, coalesce(arg_min(sim, p) FILTER (sim >= 0.6), max(sim)) AS v FROM sc GROUP BY chunk_id),
o AS (SELECT c.chunk_id, CASE WHEN seen THEN 1.0 ELSE coalesce(v, 0.0) END AS v, coalesce(seen, false) AS seen FROM c LEFT JOIN best USING (chunk_id))
SELECT chunk_id, NOT seen AND v < 0.6 AS is_new_language, round(v::DOUBLE, 4) AS similarity_to_prior FROM o""",
    "html_flatten": f"SELECT page_id, md5({_FLAT}) AS text_md5 FROM pages",
    "section_longest": f"WITH {_FILING} SELECT doc_id, item, length(body)::INT AS char_count, md5(body) AS text_md5 FROM found",
    "missing_sections": f"""WITH {_FILING}, sc AS (SELECT * FROM (VALUES ('item1'), ('item1a'), ('item7')) v(item))
SELECT doc_id, string_agg(item, '|' ORDER BY item) AS missing FROM f CROSS JOIN sc WHERE NOT EXISTS (SELECT 1 FROM found WHERE found.doc_id = f.doc_id AND found.item = sc.item) GROUP BY doc_id""",
    "list_filings": f"""SELECT o_custkey AS cik, 'C' || o_custkey AS ticker, o_orderpriority AS form, 'a-' || o_orderkey AS accession, strftime(o_orderdate, '%Y-%m-%d') AS report_date, year(o_orderdate)::INT AS fiscal_year,
'{fl.ARCHIVE}/' || o_custkey || '/a' || o_orderkey || '/a-' || o_orderkey AS url FROM orders WHERE upper(o_orderpriority) IN ('1-URGENT', '2-HIGH') AND year(o_orderdate) BETWEEN 1996 AND 1999""",
    "point_in_time": """SELECT l_suppkey::VARCHAR AS ticker, l_returnflag AS tag, strftime(l_shipdate, '%Y-%m') AS period_end, min(year(l_shipdate))::INT AS fiscal_year, arg_min(l_extendedprice, (strftime(l_shipdate, '%Y-%m-%d'), l_orderkey * 10 + l_linenumber)) AS value,
min(strftime(l_shipdate, '%Y-%m-%d')) AS filed, arg_min(l_orderkey::VARCHAR, (strftime(l_shipdate, '%Y-%m-%d'), l_orderkey * 10 + l_linenumber)) AS accession FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1, 2, 3""",
    "first_available": """WITH p AS (SELECT user_id AS ticker, event_type AS tag, count(*) AS n FROM events GROUP BY ALL), d AS (SELECT * FROM (VALUES ('intent', 0, 'purchase'), ('intent', 1, 'signup'), ('intent', 2, 'click'), ('trouble', 0, 'error')) v(metric, priority, tag))
SELECT ticker, metric, tag, n FROM p JOIN d USING (tag) QUALIFY priority = min(priority) OVER (PARTITION BY ticker, metric)""",
    "cagr_join": """WITH r AS (SELECT n_name AS ticker, year(o_orderdate)::INT AS fiscal_year, sum(o_totalprice::DECIMAL(18, 2))::DOUBLE AS value, count(*) AS k FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL),
f AS (SELECT ticker, min(fiscal_year) FILTER (k % 2 = 0) AS year FROM r GROUP BY ticker)
SELECT f.ticker, year AS first_mention_year, CASE WHEN a.value > 0 AND b.value > 0 THEN round(pow(b.value / a.value, 0.25) - 1, 4) END AS revenue_cagr FROM f LEFT JOIN r a ON a.ticker = f.ticker AND a.fiscal_year = 1996 LEFT JOIN r b ON b.ticker = f.ticker AND b.fiscal_year = 2000 WHERE year IS NOT NULL""",
    "evaluate_themes": f"WITH {_COUNTS} SELECT theme, support, tp, fp, fn, precision, recall, f1 FROM f1",
    "evaluate_summary": f"""WITH {_COUNTS}, t AS (SELECT sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn, avg(f1) AS macro_f1 FROM f1), tp AS (SELECT macro_f1, {_PRF} FROM t), tf AS (SELECT macro_f1, {_F1} FROM tp),
w AS (SELECT count(*) AS n, count(*) FILTER (list_sort(gold) = list_sort(pred))::DOUBLE / count(*) AS exact_match_rate, coalesce(count(*) FILTER (len(gold) = 0 AND len(pred) = 0)::DOUBLE / nullif(count(*) FILTER (len(gold) = 0), 0), 0) AS abstain_accuracy FROM s)
SELECT f1 AS micro_f1, macro_f1, n, exact_match_rate, abstain_accuracy FROM tf CROSS JOIN w""",
    "confusion_pairs": f"""WITH {_SCORED}, a AS (SELECT gold, pred, unnest(list_filter(gold, lambda x: NOT list_contains(pred, x))) AS missed FROM s), b AS (SELECT missed, unnest(list_filter(pred, lambda x: NOT list_contains(gold, x))) AS spurious FROM a)
SELECT missed, spurious, count(*) AS n FROM b GROUP BY ALL ORDER BY n DESC, missed, spurious LIMIT 10""",
    "cohens_kappa": f"""WITH {_SCORED}, x AS (SELECT list_contains(gold, 'toxic') AS a, list_contains(pred, 'toxic') AS b FROM s), y AS (SELECT count(*) FILTER (a = b)::DOUBLE / count(*) AS po, count(*) FILTER (a)::DOUBLE / count(*) AS pa, count(*) FILTER (b)::DOUBLE / count(*) AS pb FROM x)
SELECT 'toxic' AS theme, (po - (pa * pb + (1 - pa) * (1 - pb))) / (1 - (pa * pb + (1 - pa) * (1 - pb))) AS kappa FROM y""",
    "bootstrap_ci": f"""WITH {_SCORED}, ix AS (SELECT row_number() OVER (ORDER BY id) - 1 AS i, gold, pred FROM s), nn AS (SELECT count(*) AS n FROM s),
dr AS (SELECT r.range AS round, ('0x' || left(md5('17|' || r.range || '|' || d.range), 8))::BIGINT % n AS i FROM range(1000) r CROSS JOIN nn CROSS JOIN range((SELECT n FROM nn)) d),
o AS (SELECT round, theme, list_contains(gold, theme) AS g, list_contains(pred, theme) AS p FROM dr JOIN ix USING (i) CROSS JOIN th),
k AS (SELECT round, coalesce(theme, 'micro') AS theme, count(*) FILTER (g AND p) AS tp, count(*) FILTER (NOT g AND p) AS fp, count(*) FILTER (g AND NOT p) AS fn FROM o GROUP BY GROUPING SETS ((round, theme), (round))),
pr AS (SELECT round, theme, {_PRF} FROM k), f AS (SELECT round, theme, {_F1} FROM pr), rr AS (SELECT theme, f1, row_number() OVER (PARTITION BY theme ORDER BY f1, round) - 1 AS q FROM f)
SELECT theme, max(f1) FILTER (q = 25) AS f1_low, max(f1) FILTER (q = 975) AS f1_high FROM rr GROUP BY theme""",
    "stratified_sample": f"""WITH {_CHUNKS}, {_PEERS}, x AS (SELECT chunk_id, cohort, fiscal_year, item, labels, len(labels) > 0 AS hit, md5('20260101|' || chunk_id) AS h FROM c JOIN peers USING (ticker)),
t AS (SELECT *, row_number() OVER (PARTITION BY hit, cohort, fiscal_year, item ORDER BY h, chunk_id) AS rn FROM x), q AS (SELECT *, row_number() OVER (PARTITION BY hit ORDER BY rn, cohort, fiscal_year, item) AS k FROM t),
e AS (SELECT * FROM q WHERE hit AND k <= 200), p AS (SELECT * FROM q WHERE NOT hit AND k <= 400 - (SELECT count(*) FROM e))
SELECT chunk_id, cohort, fiscal_year, item, CASE WHEN hit THEN 'enriched' ELSE 'random' END AS stratum, array_to_string(labels, '|') AS baseline_labels FROM (SELECT * FROM e UNION ALL SELECT * FROM p)""",
    "label_disagreements": f"WITH {_CHUNKS}, p AS (SELECT chunk_id, array_to_string(labels, '|') AS keyword_labels, CASE WHEN length(text) % 2 = 0 THEN 'object' ELSE '' END AS labels FROM c) SELECT * FROM p WHERE keyword_labels <> labels",
    "label_cache": "WITH k AS (SELECT doc_id, left(sha256('m|1|' || text), 32) AS key FROM documents) SELECT doc_id::VARCHAR AS chunk_id, key FROM k WHERE key NOT IN (SELECT key FROM k WHERE doc_id % 3 = 0)",
    "classify_chunks": """WITH k AS (SELECT doc_id, text, left(sha256('m|1|' || text), 32) AS key FROM documents), h AS (SELECT DISTINCT key FROM k WHERE doc_id % 3 = 0)
SELECT doc_id::VARCHAR AS chunk_id, CASE WHEN h.key IS NOT NULL THEN 'able' WHEN contains(text, 'thing') THEN 'object' ELSE '' END AS labels, 'm' AS model FROM k LEFT JOIN h USING (key)""",
    "yearly_series": """SELECT o_custkey::VARCHAR AS ticker, year(o_orderdate)::INT AS fiscal_year, arg_max(o_totalprice, strftime(o_orderdate, '%Y-%m-%d') || '-' || lpad(o_orderkey::VARCHAR, 12, '0')) AS value
FROM orders GROUP BY 1, 2""",
    "parse_response": """WITH g AS (SELECT conv_id, count(*) AS n FROM conversations WHERE turn IS NOT NULL GROUP BY conv_id), w AS (SELECT conv_id, unnest(range(n)) AS index FROM g)
SELECT w.conv_id, w.index::INT AS index, coalesce('l' || length(text), '') AS labels, coalesce(CASE WHEN turn = 1 THEN '' ELSE role END, '') AS rationale FROM w LEFT JOIN conversations c ON c.conv_id = w.conv_id AND c.turn = w.index""",
    "quotes_topk": f"""WITH {_CHUNKS}, q AS (SELECT ticker, fiscal_year, chunk_id, text, unnest(labels) AS theme, generate_subscripts(labels, 1) AS p FROM c WHERE is_new), r AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY fiscal_year DESC, chunk_id, p) AS rn FROM q)
SELECT ticker, theme, fiscal_year, rn::INT AS rn, md5(CASE WHEN length(text) <= 400 THEN text ELSE left(text, 397) || '...' END) AS excerpt_md5 FROM r WHERE rn <= 5""",
    "theme_matrix": f"""WITH {_PANEL}, t AS (SELECT ticker, theme, ord, sum(mentions) AS m FROM panel GROUP BY ALL), b AS (SELECT ticker, theme, row_number() OVER (PARTITION BY ticker ORDER BY m DESC, ord) AS rank FROM t QUALIFY rank <= 6)
SELECT p.ticker, rank::INT AS rank, p.theme, """
    + ", ".join(f"max(printf('%.3f', salience) || CASE WHEN new_mentions > 0 THEN '*' ELSE '' END) FILTER (fiscal_year = {y}) AS fy{y}" for y in range(2020, 2026))
    + " FROM panel p JOIN b USING (ticker, theme) GROUP BY p.ticker, rank, p.theme",
}
