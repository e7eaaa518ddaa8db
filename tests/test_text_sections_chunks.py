"""Flattening, sections, chunks and novelty against plain Python on our own fixtures."""

import hashlib
import re
from html import unescape

from pyspark.sql import functions as F

from tidewright.functions import text as tx
from tidewright.operators import chunks as ch
from tidewright.operators import novelty as nv
from tidewright.operators import sections as sc

LOREM = "Merchants buy terminals from many vendors and compare fees with care. "


def one(spark, c, **cols):
    return spark.createDataFrame([tuple(cols.values())], ", ".join(f"{k} string" for k in cols)).select(c).first()[0]


def py_paragraphs(text):
    out, held = [], ""
    for line in (x.strip() for x in text.split("\n")):
        if not line:
            continue
        joined = f"{held} {line}" if held else line
        if len(joined) >= 200:
            out.append(joined)
            held = ""
        else:
            held = joined
    if held:
        if out:
            out[-1] += " " + held
        else:
            out.append(held)
    return out


def test_flatten_order_and_entities(spark):
    html = "<style>x<p>y</style><p>A&nbsp;&lt;b&gt; \t\x0b c</p><SCRIPT>1</SCRIPT><h2>It&#8217;s</h2><br/><br/><br/>\n\n<i>z</i>w"
    assert one(spark, tx.flatten_html(F.col("h")), h=html) == "A <b> c\n\nIt's\n\nz w"
    assert one(spark, tx.flatten_html(F.col("h")), h=None) is None


def test_normalise_hash_and_unicode_digits(spark):
    a, b = "Fees rose 1,234.5 percent – très!", "fees ROSE 7 percent   tr s"
    assert one(spark, tx.normalise(F.col("t")), t=a) == "fees rose 0 percent tr s"
    assert one(spark, tx.text_hash(F.col("t")), t=a) == one(spark, tx.text_hash(F.col("t")), t=b) == hashlib.sha256(b"fees rose 0 percent tr s").hexdigest()[:16]
    assert one(spark, tx.text_hash(F.col("t")), t="fees fell 7 percent tr s") != one(spark, tx.text_hash(F.col("t")), t=a)


def test_shingles_and_jaccard(spark):
    d = spark.createDataFrame([("a b c d e f a b c d e",), ("a b",), ("",), ("!!",)], "t string")
    got = [r["s"] for r in tx.with_shingles(d, "t", "s").collect()]
    assert got == [["a b c d e", "b c d e f", "c d e f a", "d e f a b", "e f a b c", "f a b c d"], ["a b"], [], []]
    sims = spark.createDataFrame([(["a", "b"], ["b", "c"]), ([], ["a"]), ([], [])], "x array<string>, y array<string>").select(tx.jaccard(F.col("x"), F.col("y"))).collect()
    assert [r[0] for r in sims] == [1 / 3, 0.0, 0.0]


def test_keywords_not_within_words(spark):
    from tidewright.config import Taxonomy, Theme

    tax = Taxonomy("1", (Theme("yield", "Y", keywords=("yield",)), Theme("api", "A", keywords=("api-based", "c++")), Theme("none", "N")))
    rows = spark.createDataFrame([("Unyielding",), ("Yields and API-based",), ("c++s",), ("",), (None,)], "t string")
    assert [r[0] for r in rows.select(tx.keyword_labels(F.col("t"), tax)).collect()] == [[], ["api", "yield"], ["api"], [], []]


def test_sections_longest_run(spark):
    body = LOREM * 30
    text = f"Item 1. Business 3\nItem 1A. Risk Factors 9\nItem 1. Business\n{body}\nITEM 1A – Risk  Factors\n{body}{body}\nas in Item 1A. Risk Factors above\nItem 8 Financial Statements\nshort"
    f = spark.createDataFrame([(1, text), (2, "no headings"), (3, None)], "k int, text string")
    got = {(r["k"], r["item"]): r for r in sc.split_items(f, ["k"]).collect()}
    assert set(got) == {(1, "item1"), (1, "item1a")}
    assert got[1, "item1"]["text"] == body.strip() and got[1, "item1a"]["text"] == (body + body + "\nas in").strip()
    r = got[1, "item1a"]
    assert text[r["start"] : r["end"]].strip() == r["text"] and r["char_count"] == len(r["text"])
    gone = sc.missing_sections(f, sc.split_items(f, ["k"]), ["k"], ["item1", "item7", "item1a"]).collect()
    assert {r["k"]: r["missing"] for r in gone} == {1: ["item7"], 2: ["item1", "item1a", "item7"], 3: ["item1", "item1a", "item7"]}


def test_ties_between_runs_go_to_the_first(spark):
    f = spark.createDataFrame([("item 2 properties aaaa item 2 properties bbbb",)], "text string").withColumn("k", F.lit(1))
    assert sc.split_items(f, ["k"], min_chars=1).first()["text"] == "aaaa"


def test_paragraph_fold_and_wrap(spark):
    texts = ["short\nline", LOREM * 4 + "\n\n tail \n", "a" * 199 + "\n" + "b" + "\nrest", LOREM * 200, "x" * 5000 + ". Y" + "z" * 100, "", "\n \n"]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r["i"]: r["p"] for r in d.select("i", ch.paragraphs(F.col("t")).alias("p")).collect()}
    assert [got[i] for i in range(len(texts))] == [py_paragraphs(t) for t in texts]
    wrapped = {r["i"]: r["w"] for r in d.select("i", ch.hard_wrap(F.trim("t")).alias("w")).collect()}
    assert all(len(x) <= 4000 for x in wrapped[3]) and " ".join(wrapped[3]) == (LOREM * 200).strip()
    assert [len(x) for x in wrapped[4]] == [5001, 101]


def test_chunk_ids_and_min_chars(spark):
    s = spark.createDataFrame([("T", 2023, "item1", LOREM * 10 + "\n" + LOREM * 3 + "\nend"), ("T", 2023, "item7", "tiny")], "ticker string, fiscal_year int, item string, text string")
    rows = ch.chunk_sections(s).orderBy("chunk_id").collect()
    assert [r["chunk_id"] for r in rows] == ["T-2023-item1-0000", "T-2023-item1-0001"] and rows[1]["text"].endswith("end")
    assert ch.chunk_sections(s, min_chars=1).count() == 3


def chunk(ticker, year, item, ordinal, text):
    return (f"{ticker}-{year}-{item}-{ordinal}", ticker, year, item, ordinal, text, f"{ticker}{year}")


def py_novelty(chunks):
    norm = lambda t: re.sub(r" +", " ", re.sub(r"[^a-z0-9 ]+", " ", re.sub(r"\b\d[\d,\.]*\b", " 0 ", t.lower()))).strip()
    sh = lambda t: {" ".join(w[i : i + 5]) for w in [norm(t).split()] for i in range(max(1, len(w) - 4)) if w}
    out, by = {}, {}
    for c in chunks:
        by.setdefault((c[1], c[2]), []).append(c)
    for ticker in {k[0] for k in by}:
        prior = []
        for year in sorted(y for t, y in by if t == ticker):
            for c in by[ticker, year]:
                if norm(c[5]) in {norm(p[5]) for p in prior}:
                    out[c[0]] = (False, 1.0)
                    continue
                best = 0.0
                for p in sorted((p for p in prior if p[3] == c[3]), key=lambda p: p[4]):
                    a, b = sh(c[5]), sh(p[5])
                    s = len(a & b) / len(a | b) if a and b else 0.0
                    best = max(best, s)
                    if best >= 0.6:
                        break
                out[c[0]] = (best < 0.6, round(best, 4))
            prior = by[ticker, year]
    return out


def test_novelty_rules(spark):
    w = [f"w{i}" for i in range(40)]
    base, near, nearer = " ".join(w), " ".join([*w[:34], "x1", "x2", "x3"]), " ".join([*w[:38], "y"])
    rows = [
        chunk("A", 2020, "item1", 0, near), chunk("A", 2020, "item1", 1, nearer), chunk("A", 2020, "item7", 0, "numbers 1,000 rose a b c d"),
        chunk("A", 2022, "item1", 0, base), chunk("A", 2022, "item1", 1, "numbers 2 rose a b c d"), chunk("A", 2022, "item7", 0, base), chunk("A", 2022, "item1", 2, ""),
        chunk("B", 2021, "item1", 0, base), chunk("B", 2023, "item1", 0, " ".join(w[:20] + w[30:])), chunk("B", 2023, "item1", 1, "short"),
    ]
    d = spark.createDataFrame(rows, "chunk_id string, ticker string, fiscal_year int, item string, ordinal int, text string, filing_accession string").withColumn("text_hash", tx.text_hash(F.col("text")))
    got = {r["chunk_id"]: (r["is_new_language"], r["similarity_to_prior"]) for r in nv.mark_novelty(d).collect()}
    assert got == py_novelty(rows)
    assert got["A-2022-item1-0"][1] < 1 and not got["A-2022-item1-0"][0]  # the first over the threshold, not the best
    assert got["A-2022-item1-1"] == (False, 1.0)  # equal up to numbers, in another item


def test_two_filings_in_a_year_fail(spark):
    rows = [("c1", "A", 2020, "item1", 0, "t", "a1", "h"), ("c2", "A", 2020, "item1", 0, "t", "a2", "h")]
    d = spark.createDataFrame(rows, "chunk_id string, ticker string, fiscal_year int, item string, ordinal int, text string, filing_accession string, text_hash string")
    try:
        nv.mark_novelty(d)
        raise AssertionError
    except ValueError as e:
        assert "A 2020" in str(e)


def test_unescape_is_pythons():
    assert unescape("&eacute;&amp") == "é&"
