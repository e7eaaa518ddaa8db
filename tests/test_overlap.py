"""The closest earlier text against brute force, and what boilerplate costs."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tidewright.functions import text as tx
from tidewright.operators import novelty as nv
from tidewright.operators import overlap as ov

from test_text_sections_chunks import chunk, py_novelty


def corpus():
    """Three filings whose chunks share boilerplate, near copies, exact copies, short texts and texts without words."""
    rng, rows = random.Random(5), []
    line = [f"all rights of page {c} are held by us" for c in "abc"]
    seed = [f"v{i}" for i in range(60)]
    for year in (2020, 2021, 2023):
        for item in ("item1", "item7"):
            for i in range(60):
                own = [f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(5, 60))]
                kind = i % 6
                if kind == 0:
                    text = seed[: rng.randrange(30, 60)] + own[: rng.randrange(20)]
                elif kind == 1:
                    text = [w if rng.random() > 0.03 else "x" for w in seed]
                elif kind == 2:
                    text = ["same", "copy", "for", "all", "of", "them"] if i % 4 else ["two", rng.choice(["words", "more"])]
                elif kind == 3 and i < 12:
                    text = [] if i < 6 else ["—"]
                else:
                    text = own
                rows.append(chunk("T", year, item, i, " ".join([*text, *(w for x in line if rng.random() < 0.7 for w in x.split())]) if kind not in (2, 3) else " ".join(text)))
    rng.shuffle(rows)
    return rows


SCHEMA = "chunk_id string, ticker string, fiscal_year int, item string, ordinal int, text string, filing_accession string"


def test_closest_is_exact_over_parts_and_blocks(spark):
    rows = corpus()
    d = spark.createDataFrame(rows, SCHEMA).withColumn("text_hash", tx.text_hash(F.col("text"))).persist()
    right = py_novelty(rows)
    got = {r["chunk_id"]: (r["is_new_language"], r["similarity_to_prior"]) for r in nv.mark_novelty(d).collect()}
    assert got.keys() == right.keys() and all(got[k][0] == right[k][0] and abs(got[k][1] - right[k][1]) < 1.01e-4 for k in right)  # Python rounds 0.15625 down
    assert len({v for v in right.values()}) > 50
    texts = d.select("ticker", F.when(F.col("fiscal_year") == 2023, 3).otherwise(F.col("fiscal_year") - 2019).alias("rank"), "item", F.xxhash64("chunk_id").alias("doc"), "ordinal", "text")
    sims = lambda t, n: {(r["rank"], r["doc"]): r["sim"] for r in ov.closest(t, threshold=0.6, part_chars=n).collect()}
    whole = sims(texts, ov.PART_CHARS)
    assert len(whole) > 100 and sims(texts, 3000) == whole
    assert sims(texts.unionAll(texts), 3000) == whole  # rows that are repeated count once


def test_boilerplate_makes_no_pairs():
    """A line in all texts of two filings: as many pairs as the square before, now rows by the text."""
    k = 500
    shared = ov.shingle_sets(pa.array(["one line that stands in every text of all filings"]))[0]
    t = pa.table({
        "rank": pa.array([1] * k + [2] * k, pa.int32()), "doc": pa.array(range(2 * k), pa.int64()), "ordinal": pa.array(range(2 * k), pa.int64()),
        "n": pa.array([len(shared)] * 2 * k, pa.int32()), "hs": pa.array([shared.tobytes()] * 2 * k, pa.binary()),
    })
    assert ov._met((pa.scalar("T"), pa.scalar("item1"), pa.scalar(0)), t).num_rows == 2 * k


def test_shingles_are_those_of_the_words(spark):
    texts = ["", "a", "a b c d", "a b c d e", "a b c d e f", "a b c d e a b c d e", "x" * 100 + " y z " + "x" * 99, "1 2 3 4 5678901234567890 6"]
    names = [{" ".join(w[i : i + 5]) for w in [t.split()] for i in range(max(1, len(w) - 4)) if w} for t in texts]
    got = ov.shingle_sets(pa.array(texts))
    assert [len(g) for g in got] == [len(n) for n in names]
    assert len(np.unique(np.concatenate(got))) == len(set().union(*names))
    assert all((a == b).all() for a, b in zip(ov.shingle_sets(pa.array(["skip", *texts]).slice(1)), got, strict=True))


def test_normalise_is_the_chain_of_its_steps(spark):
    odd = ["a1,000.5b 7 8", "١٢٣ 4", "x٣4 _5 5_ -6", "é9 9é 9", "1́ 2", "\t 3,\n4. ", "12.", "1,2.3 4", "ÀB  C—D", "", " ", None, "9", "²3", "a b"]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(odd)], "i int, t string")
    c = F.regexp_replace(F.lower("t"), r"(?U)\b\d[\d,\.]*\b", " 0 ")
    chain = F.trim(F.regexp_replace(F.regexp_replace(c, r"[^a-z0-9 ]+", " "), r" +", " "))
    assert not d.where(~chain.eqNullSafe(tx.normalise(F.col("t")))).count()
