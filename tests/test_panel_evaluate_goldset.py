"""Panel, evaluation, gold set, filings and labels on hand-computed cases."""

import json

import pytest
from pyspark.sql import functions as F

from tidewright.config import Cohort, Peer, Study, Taxonomy, Theme, load_study, load_taxonomy, with_cohort
from tidewright.operators import evaluate as ev
from tidewright.operators import filings as fl
from tidewright.operators import goldset as gs
from tidewright.operators import labels as lb
from tidewright.operators import panel as pn
from tidewright.operators import render as rd
from tidewright.sources import landing

TAX = Taxonomy("1", (Theme("isv", "ISV", keywords=("software vendor",)), Theme("fx", "FX", keywords=("currency",))))
STUDY = Study("s", 2020, 2023, (Cohort("old", "", ""), Cohort("new", "", "")), (Peer("AA", "A Co", "old", 0), Peer("BB", "B Co", "old", 1), Peer("CC", "C Co", "new", 2)), {"CC": 2021})


def plan(spark):
    """AA mentions in all years, BB only in 2023, CC from its first year 2021; four chunks a company-year."""
    rows = []
    for t, years in (("AA", range(2020, 2024)), ("BB", range(2020, 2024)), ("CC", range(2021, 2024))):
        for y in years:
            for i in range(4):
                hit = i == 0 and (t != "BB" or y == 2023)
                rows.append((f"{t}{y}{i}", t, y, i == 0, "a software vendor" if hit else "plain text", ["isv"] if hit else []))
    d = spark.createDataFrame(rows, "chunk_id string, ticker string, fiscal_year int, is_new_language boolean, text string, labels array<string>")
    return d, pn.build_panel(d, d.select("chunk_id", "labels"), STUDY.table(spark), TAX.table(spark)).persist()


def test_panel_first_mentions_adoption(spark):
    d, panel = plan(spark)
    assert panel.count() == 11 * 2 and panel.where("theme = 'isv' AND ticker = 'AA'").first()["salience"] == 0.25
    first = {(r["ticker"], r["theme"]): r for r in pn.first_mentions(panel, 2020).collect()}
    assert [first[t, "isv"]["year"] for t in ("AA", "BB", "CC")] == [2020, 2023, 2021]
    assert [first[t, "isv"]["lag_vs_peers"] for t in ("AA", "BB")] == [-1.5, 1.5]
    assert [first[t, "isv"]["censored"] for t in ("AA", "BB", "CC")] == [False, False, True]
    assert first["AA", "fx"]["year"] is None and first["CC", "fx"]["censored"] is False
    curve = {r["fiscal_year"]: r for r in pn.adoption_curve(panel, "isv").collect()}
    assert curve[2020]["old"] == 0.5 and curve[2023]["old"] == 1.0 and curve[2020]["new"] is None and curve[2020]["new_n"] == 0 and curve[2021]["new_n"] == 1
    up = pn.escalation(panel, "isv").collect()
    assert (up[0]["ticker"], up[0]["fiscal_year"], up[0]["delta"]) == ("BB", 2023, 0.25) and len(up) == 8
    text = rd.crosscut(panel, pn.first_mentions(panel, 2020), STUDY, TAX, "isv")
    assert "| 2020 | 0.5 (2) | - |" in text and "| BB | old | 2023 | 1.5 |" in text
    matrix = pn.theme_matrix(panel, [2020, 2021, 2022, 2023])
    assert matrix.where("ticker = 'BB' AND theme = 'isv'").first()["2023"] == "0.250*"
    points = spark.createDataFrame([("AA", "revenue", 2020, "2020-12-31", 1.5e9)], "ticker string, metric string, fiscal_year int, period_end string, value double")
    memo = rd.company_memo("AA", STUDY, TAX, years=[2020, 2021], points=points, matrix=matrix, quote_rows=pn.quotes(d, d.select("chunk_id", "labels")))
    assert "| 2020 | 1,500 |" in memo and "| 2021 |  |" in memo and "> a software vendor" in memo


def test_escalation_ignores_gap_years(spark):
    rows = [("AA", "old", "isv", y, m, 0, 10, m / 10, 0.0) for y, m in ((2020, 1), (2022, 9), (2023, 8))]
    p = spark.createDataFrame(rows, "ticker string, cohort string, theme string, fiscal_year int, mentions long, new_mentions long, total_chunks long, salience double, new_salience double")
    assert [(r["fiscal_year"], r["delta"]) for r in pn.escalation(p, "isv").collect()] == [(2023, -0.1)]


def test_growth_needs_both_ends(spark):
    first = spark.createDataFrame([(t, "c", "isv", 2021, False, None) for t in "ABCD"], "ticker string, cohort string, theme string, year int, censored boolean, lag_vs_peers double")
    s = spark.createDataFrame([("A", 2020, 100.0), ("A", 2025, 200.0), ("B", 2020, 100.0), ("B", 2025, 100.0), ("C", 2020, 5.0), ("D", 2020, 5.0), ("D", 2025, -5.0)], "ticker string, fiscal_year int, value double")
    got = {r["ticker"]: r["revenue_cagr"] for r in pn.join_financials(first, s, "isv", start_year=2020, end_year=2025).collect()}
    assert got == {"A": round(2 ** (1 / 5) - 1, 4), "B": 0.0, "C": None, "D": None}


def test_unknown_ticker_fails(spark):
    rows = spark.createDataFrame([("ZZ",)], "ticker string")
    with pytest.raises(Exception, match="unknown ticker: ZZ"):
        with_cohort(rows, STUDY.table(spark)).collect()
    assert STUDY.first_covered_year("ZZ") == 2020
    with pytest.raises(KeyError):
        STUDY.cohort_of("ZZ")


def scored(spark, pairs):
    return spark.createDataFrame([(i, g, p) for i, (g, p) in enumerate(pairs)], "id int, gold array<string>, pred array<string>")


def test_scores_by_hand(spark):
    rows = scored(spark, [(["a"], ["a"]), (["a", "b"], ["a"]), ([], ["a"]), (["b"], ["b"])])
    got = {r["theme"]: r for r in ev.with_prf(ev.counts(rows, ["a", "b", "c"])).collect()}
    assert (got["a"]["tp"], got["a"]["fp"], got["a"]["fn"]) == (2, 1, 0) and (got["b"]["tp"], got["b"]["fp"], got["b"]["fn"]) == (1, 0, 1)
    assert got["c"]["f1"] == 0.0 and got["c"]["support"] == 0
    s = ev.summary(rows, ["a", "b", "c"]).first()
    assert s["exact_match_rate"] == 0.5 and s["abstain_accuracy"] == 0.0 and s["n"] == 4 and abs(s["micro_f1"] - 0.75) < 1e-12
    assert ev.summary(rows.where("id < 0"), ["a"]).first()["micro_f1"] == 0.0


def test_duplicate_labels_count_once(spark):
    r = ev.counts(scored(spark, [(["a", "a"], ["a", "a", "a"])]), ["a"]).first()
    assert (r["tp"], r["fp"]) == (1, 0)


def test_bootstrap_brackets_the_point(spark):
    rows = scored(spark, [(["a"], ["a"]), (["a"], []), ([], ["a"]), (["a"], ["a"]), ([], []), (["b"], ["b"]), (["b"], ["a"]), (["a"], ["a"])]).persist()
    per, total = ev.evaluate(rows, ["a", "b"], rounds=300, seed=3)
    for r in per.collect():
        assert r["f1_low"] <= r["f1"] <= r["f1_high"]
    t = total.first()
    assert t["micro_f1_low"] < t["micro_f1"] <= t["micro_f1_high"]
    again = ev.bootstrap(rows, ["a", "b"], rounds=300, seed=3).collect()
    assert again == ev.bootstrap(rows, ["a", "b"], rounds=300, seed=3).collect()
    assert ev.bootstrap(rows.where("id < 0"), ["a"], rounds=10).collect()[0]["f1_high"] == 0.0


def test_kappa_and_confusion(spark):
    same = scored(spark, [(["a"], ["a"]), ([], [])])
    assert ev.kappa(same, "a").first()["kappa"] == 1.0 and ev.kappa(same, "z").first()["kappa"] == 1.0
    assert ev.kappa(scored(spark, [(["a"], []), ([], ["a"]), *[([], [])] * 8]), "a").first()["kappa"] < 0.5
    assert ev.kappa(same.where("id < 0"), "a").first()["kappa"] == 0.0
    pairs = ev.confusion_pairs(scored(spark, [(["a"], ["b"]), (["a"], ["b"]), (["a"], ["c"]), (["a"], ["a"])])).collect()
    assert [tuple(r) for r in pairs] == [("a", "b", 2), ("a", "c", 1)]


def test_lengths_that_differ_fail(spark):
    g = spark.createDataFrame([(1, ["a"]), (2, [])], "id int, labels array<string>")
    with pytest.raises(ValueError):
        ev.aligned(g, g.where("id = 1"))
    assert ev.aligned(g, g).count() == 2


def gold_chunks(spark):
    rows = [(f"c{i}", ("AA", "BB", "CC")[i % 3], 2020 + i % 2, "item1", "a software vendor" if i % 4 == 0 else "x, \"q\"\ny", "old" if i % 3 < 2 else "new", False) for i in range(60)]
    return spark.createDataFrame(rows, "chunk_id string, ticker string, fiscal_year int, item string, text string, cohort string, is_new_language boolean")


def test_sample_quotas_and_worksheet(spark, tmp_path):
    c = gold_chunks(spark)
    rows = gs.stratified_sample(c, TAX, target_n=40).persist()
    assert rows.where("stratum = 'enriched'").count() == 15 and rows.where("stratum = 'random'").count() == 25  # the shortfall is filled up
    assert [r[0] for r in rows.select("chunk_id").collect()] == [r[0] for r in gs.stratified_sample(c, TAX, target_n=40).select("chunk_id").collect()]
    gs.write_worksheet(rows, str(tmp_path / "w"), blind=True)
    back = gs.read_worksheet(spark, str(tmp_path / "w"), TAX)
    assert back.count() == 40 and back.where(F.size("baseline_labels") > 0).count() == 0 and {r[0] for r in back.select("text").distinct().collect()} == {"a software vendor", 'x, "q"\ny'}
    assert gs.labelled_only(back).count() == 0
    bad = rows.limit(2).withColumn("baseline_labels", F.array(F.lit("isv"), F.lit("typo")))
    ws = gs.worksheet(bad, blind=False).withColumn("gold_labels", F.col("baseline_labels"))
    ws.coalesce(1).write.csv(str(tmp_path / "b"), header=True, escape='"', quoteAll=True)
    with pytest.raises(ValueError, match="typo"):
        gs.read_worksheet(spark, str(tmp_path / "b"), TAX)


def test_filings_and_facts(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps({"0": {"cik_str": 7, "ticker": "abc", "title": "A"}, "1": {"cik_str": 8, "ticker": "ABC", "title": "B"}}))
    entries = landing.ticker_entries(spark, str(tmp_path / "t.json"))
    want = spark.createDataFrame([("ABC",)], "ticker string")
    assert fl.resolve_ciks(want, entries).first()["cik"] == 7
    with pytest.raises(Exception, match="no CIK"):
        fl.resolve_ciks(spark.createDataFrame([("NO",)], "ticker string"), entries).collect()
    recent = {"form": ["10-K", "10-k", "10-Q", "8-K", "10-K"], "accessionNumber": ["a-1-2", "a-3", "a-4", "a-5", "a-6"], "filingDate": ["2025-02-20", "2024-02-01", "x", "x", "2021-01-01"], "reportDate": ["2024-12-31", "2023-12-31", "2023-09-30", "", "2020-12-31"], "primaryDocument": ["d1", "d2", "d3", "d4"]}
    (tmp_path / "s.json").write_text(json.dumps({"cik": 7, "name": "A", "filings": {"recent": recent}}))
    rows = fl.list_filings(landing.submissions(spark, str(tmp_path / "s.json")).withColumn("ticker", F.lit("abc")), start_year=2020, end_year=2025).collect()
    assert [r["fiscal_year"] for r in rows] == [2023, 2024] and rows[1]["ticker"] == "ABC" and rows[1]["url"].endswith("/7/a12/d1")
    e = lambda fy, end, val, filed, fp="FY", form="10-K": {"fy": fy, "fp": fp, "end": end, "val": val, "filed": filed, "form": form, "accn": "x"}
    facts = {"cik": 7, "facts": {"us-gaap": {"Revenues": {"units": {"USD": [e(2022, "2022-12-31", 1000, "2023-02-20"), e(2023, "2022-12-31", 1050, "2024-02-22"), e(2023, "2023-12-31", 1200, "2024-02-22"), e(2023, "2023-06-30", 600, "2023-08-01", "Q2", "10-Q"), e(0, "2021-12-31", 900, "2022-02-01")]}}}}}
    (tmp_path / "f.json").write_text(json.dumps(facts))
    points = fl.annual_metric(fl.facts_long(landing.company_facts(spark, str(tmp_path / "f.json")).withColumn("ticker", F.lit("ABC")))).persist()
    got = {r["period_end"]: (r["value"], r["filed"], r["fiscal_year"]) for r in points.collect()}
    assert got == {"2022-12-31": (1000.0, "2023-02-20", 2022), "2023-12-31": (1200.0, "2024-02-22", 2023), "2021-12-31": (900.0, "2022-02-01", 2021)}
    assert {r["tag"] for r in fl.first_available(points).where("metric = 'revenue'").collect()} == {"Revenues"}


def test_one_tag_a_company(spark):
    p = spark.createDataFrame([("A", "Revenues", 2020, "2020-12-31", 1.0), ("A", "SalesRevenueNet", 2019, "2019-12-31", 2.0), ("B", "SalesRevenueNet", 2019, "2019-12-31", 3.0), ("A", "Revenues", 2020, "2021-01-02", 9.0)], "ticker string, tag string, fiscal_year int, period_end string, value double")
    got = sorted((r["ticker"], r["fiscal_year"], r["value"]) for r in fl.yearly_series(fl.first_available(p)).collect())
    assert got == [("A", 2020, 9.0), ("B", 2019, 3.0)]


def test_client_and_cache(tmp_path):
    calls, pauses = [], []

    def transport(url, headers):
        calls.append(url)
        return (429, "") if len(calls) < 3 else (200, "ok")

    with pytest.raises(ValueError):
        landing.FilingClient("nobody", str(tmp_path), transport)
    c = landing.FilingClient("me@example.org", str(tmp_path), transport, 1e9, sleep=pauses.append)
    assert c.get_text("https://h/a?b") == "ok" and len(calls) == 3 and [p for p in pauses if p >= 1] == [1, 2]
    assert c.get_text("https://h/a?b") == "ok" and len(calls) == 3 and (tmp_path / "h_a_b").exists()
    with pytest.raises(RuntimeError, match="404"):
        landing.FilingClient("me@example.org", str(tmp_path), lambda u, h: (404, "")).get_text("https://h/x")


def test_responses_and_labeler(spark):
    raw = 'Sure: [{"labels": ["fx"]}, {"index": 2, "labels": ["isv"], "rationale": "r"}, {"index": 2, "labels": ["fx", "zz"]}, {"index": 9, "labels": []}] bye'
    d = spark.createDataFrame([("k", raw, 4)], "k string, raw string, n int")
    got = {r["index"]: (r["labels"], r["rationale"]) for r in lb.parse_response(d, keys=["k"]).collect()}
    assert got == {0: (["fx"], ""), 1: ([], ""), 2: (["fx", "zz"], ""), 3: ([], "")}
    with pytest.raises(Exception, match="no JSON array"):
        lb.parse_response(spark.createDataFrame([("k", "sorry", 1)], "k string, raw string, n int"), keys=["k"]).collect()
    c = spark.createDataFrame([("1", "a software vendor"), ("2", "plain"), ("3", "currency")], "chunk_id string, text string")
    model = lambda texts: json.dumps([{"index": i, "labels": ["isv", "bogus"] if "vendor" in t else []} for i, t in enumerate(texts)])
    preds, fresh = lb.classify(c, TAX, model, model_name="m")
    assert {r["chunk_id"]: r["labels"] for r in preds.collect()} == {"1": ["isv"], "2": [], "3": []}
    boom = lambda texts: 1 / 0
    again, _ = lb.classify(c, TAX, boom, model_name="m", cache=fresh)
    assert {r["chunk_id"]: r["labels"] for r in again.collect()} == {"1": ["isv"], "2": [], "3": []}
    assert [r["chunk_id"] for r in lb.disagreements(c, preds, TAX).collect()] == ["3"]
    assert "[isv]" in lb.system_prompt(TAX)


def test_config_files(tmp_path):
    (tmp_path / "p.yaml").write_text("study: {name: s, start_fiscal_year: 2020, end_fiscal_year: 2025}\ncohorts:\n  - {id: a, members: [{ticker: X, name: Ex}]}\npartial_history: {X: 2021}\n")
    (tmp_path / "t.yaml").write_text('version: "2"\nthemes:\n  - {id: k, name: K, keywords: [one]}\n')
    s, t = load_study(str(tmp_path / "p.yaml")), load_taxonomy(str(tmp_path / "t.yaml"))
    assert s.tickers == ["X"] and s.first_covered_year("X") == 2021 and s.forms == ("10-K",) and t.ids == ["k"] and t.version == "2"
    with pytest.raises(KeyError):
        t.get("nope")


def test_bootstrap_is_that_of_its_draws(spark, monkeypatch):
    """Bounds by brute force over pieces of rounds; no draw is a row of a join or a shuffle."""
    import hashlib

    labels = [[t for t, m in (("a", 2), ("b", 3), ("c", 7)) if i % m == 0] for i in range(47)]
    pred = [labels[(i * 5 + 1) % 47] if i % 4 else labels[i] for i in range(47)]
    rows = spark.createDataFrame([(i, g, p) for i, (g, p) in enumerate(zip(labels, pred, strict=True))], "id int, gold array<string>, pred array<string>").repartition(3)
    themes, scores = ["a", "b", "c", "unused"], {}
    for r in range(60):
        drawn = [int(hashlib.md5(f"5|{r}|{d}".encode()).hexdigest()[:8], 16) % 47 for d in range(47)]
        each = {t: [sum(w(t in labels[i], t in pred[i]) for i in drawn) for w in (lambda g, p: g and p, lambda g, p: p and not g, lambda g, p: g and not p)] for t in themes}
        each[None] = [sum(x[k] for x in each.values()) for k in range(3)]
        for t, (tp, fp, fn) in each.items():
            p, c = (tp / (tp + fp) if tp + fp else 0.0), (tp / (tp + fn) if tp + fn else 0.0)
            scores.setdefault(t, []).append(2 * p * c / (p + c) if p + c else 0.0)
    right = [(t, sorted(s)[1], sorted(s)[58]) for t, s in scores.items()]
    for piece in (1 << 20, 10):
        monkeypatch.setattr(ev, "PIECE", piece)
        out = ev.bootstrap(rows, themes, rounds=60, seed=5)
        assert [tuple(r) for r in out.collect()] == right
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join Inner") == 1  # with the names of the themes


def test_draws_are_md5():
    import hashlib

    import numpy as np

    from tidewright.functions.draws import md5_numbers

    for prefix in (b"", b"17|3|", b"17|12|", b"17|123|", b"-4|999999|", b"x" * 49, b"y" * 60):
        for lo, hi in ((0, 1203), (9995, 10011), (99990, 100003), (1234567, 1234599)):
            assert np.concatenate(list(md5_numbers(prefix, lo, hi))).tolist() == [int(hashlib.md5(prefix + str(d).encode()).hexdigest()[:8], 16) for d in range(lo, hi)]
