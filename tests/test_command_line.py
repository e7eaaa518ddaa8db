"""The commands in order, over small landed files."""

import json

from tidewright.__main__ import main

BODY = "<p>Our merchants rely on many partners, and fees are set by contract with each of them in turn. </p>" * 30


def test_commands(spark, tmp_path, capsys):
    raw = tmp_path / "raw"
    for d in ("submissions", "facts", "filings"):
        (raw / d).mkdir(parents=True)
    (tmp_path / "p.yaml").write_text("study: {name: s, start_fiscal_year: 2020, end_fiscal_year: 2021}\ncohorts:\n  - {id: a, members: [{ticker: AA, name: A}, {ticker: ZZ, name: Z}]}\n")
    (tmp_path / "t.yaml").write_text('version: "1"\nthemes:\n  - {id: isv, name: ISV, keywords: ["software vendor"]}\n')
    (raw / "tickers.json").write_text(json.dumps({"0": {"cik_str": 7, "ticker": "AA", "title": "A"}}))
    recent = {"form": ["10-K"] * 2, "accessionNumber": ["x-1", "x-2"], "filingDate": ["2022-02-01", "2021-02-01"], "reportDate": ["2021-12-31", "2020-12-31"], "primaryDocument": ["a", "b"]}
    (raw / "submissions" / "7.json").write_text(json.dumps({"cik": 7, "name": "A", "filings": {"recent": recent}}))
    entry = {"fy": 2020, "fp": "FY", "form": "10-K", "end": "2020-12-31", "filed": "2021-02-01", "accn": "x-2", "val": 2e9}
    (raw / "facts" / "7.json").write_text(json.dumps({"cik": 7, "facts": {"us-gaap": {"Revenues": {"units": {"USD": [entry]}}}}}))
    for y in (2020, 2021):
        new = "<p>" + "A software vendor takes our merchants away, one by one, year after year. " * 4 + "</p>" if y == 2021 else ""
        (raw / "filings" / f"AA-{y}.html").write_text(f"<h2>Item 1. Business</h2>{BODY}{new}<h2>Item 1A. Risk Factors</h2>{BODY}")
    base = ["--data", str(tmp_path), "--peers", str(tmp_path / "p.yaml"), "--taxonomy", str(tmp_path / "t.yaml")]
    for command in ("fetch", "parse", "classify", "goldset", "analyze", "memo"):
        main([command, *base])
    sheet = spark.read.csv(str(tmp_path / "worksheet"), header=True, multiLine=True, escape='"').toPandas().fillna("")
    sheet["notes"], sheet["gold_labels"] = "NONE", ["isv" if "software vendor" in t else "" for t in sheet["text"]]
    for f in (tmp_path / "worksheet").glob("*"):
        f.unlink()
    sheet.to_csv(tmp_path / "worksheet" / "labelled.csv", index=False)
    main(["benchmark", *base])
    told = json.loads((tmp_path / "benchmark.json").read_text())
    assert told["llm"]["micro_f1"] == told["keyword_baseline"]["micro_f1"] == 1.0 and told["n"] == len(sheet) and told["llm"]["per_theme"][0]["theme"] == "isv" and told["confusions"] == []
    said = capsys.readouterr().out
    assert "no CIK for ZZ" in said and "AA 2020: no item7" in said and "0 chunks on which" in said
    assert "| 2020 | 2,000 |" in (tmp_path / "memos" / "AA.md").read_text() and "| AA | a | 2021 |" in (tmp_path / "memos" / "crosscut.md").read_text()
    assert spark.read.json(str(tmp_path / "first_mentions")).where("theme = 'isv'").first()["year"] == 2021
