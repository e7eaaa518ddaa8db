"""Quality, language, segmentation, chat and page extraction, and the pipeline."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from tidewright.llm import chat
from tidewright.llm import langid as li
from tidewright.llm import pages as pg
from tidewright.llm import quality as qu
from tidewright.llm import queries as q
from tidewright.llm import segment as sg
from tidewright.llm import simhash as si

BIG = "/root/testdata/sf0.01"
DATA = "/root/testdata/sf0.001"


def test_language_held_out_accuracy(spark, docs, edge, none):
    rows = q.op3_language(spark, BIG).join(spark.read.parquet(f"{BIG}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(rows) > 200 and sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.99 * len(rows) and all(0 <= r["score"] <= 1 for r in rows)
    p = li.learn_profiles(docs)
    got = {r["doc_id"]: r for r in li.identify_language(edge, p).collect()}
    assert [got[i]["lang_pred"] for i in (1, 2, 3)] == ["und"] * 3 and got[4]["lang_pred"] in p
    assert li.identify_language(none, p).count() == 0 and {r["lang_pred"] for r in li.identify_language(edge, {}).collect()} == {"und"}
    assert li.learn_profiles(docs.limit(0)) == {} and li.learn_profiles(docs.withColumn("lang", F.lit(None).cast("string"))) == {}


def test_numerals_are_no_letters(spark, docs):
    p = li.learn_profiles(docs)
    rows = [(1, "½ ² ³ ①"), (2, "Ⅷ Ⅻ 一二"), (3, "1234 _ -"), (4, "ab½cd"), (5, "ªº")]
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in li.identify_language(spark.createDataFrame(rows, "doc_id long, text string"), p).collect()}
    assert got[1] == got[3] == ("und", 0.0) and all(got[i][0] in p for i in (2, 4, 5))
    assert li.gram_codes("ab½cd").tolist() == li.gram_codes("ab cd").tolist() and not len(li.gram_codes("Ⅷ"))
    with pytest.raises(ValueError):
        li.learn_profiles(docs.withColumn("lang", F.col("doc_id").cast("string")), max_languages=20)


def brute_grams(text):
    """n-grams of one to three letters of words padded with _, with counts."""
    words = "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()
    out = Counter()
    for w in words:
        out.update(w)
        for n in (2, 3):
            out.update(f"_{w}_"[i : i + n] for i in range(len(w) + 3 - n))
    return out


def brute_rank(counts, size=400):
    # ties: shorter first, then by code points
    return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], len(x[0]), x[0]))[:size]]


def test_language_query_is_brute_force(spark, docs):
    import zlib

    rows = docs.collect()
    held = {r["doc_id"]: zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1 for r in rows}
    by = {}
    for r in rows:
        if not held[r["doc_id"]] and r["lang"] is not None:
            by.setdefault(r["lang"], Counter()).update(brute_grams(r["text"]))
    profiles = {k: {g: i for i, g in enumerate(brute_rank(c))} for k, c in by.items()}
    want = {}
    for r in rows:
        mine = brute_rank(brute_grams(r["text"]))
        far = min((sum(abs(i - p[g]) if g in p else 400 for i, g in enumerate(mine)), k) for k, p in profiles.items())
        want[r["doc_id"]] = (held[r["doc_id"]], far[1], 1 - far[0] / (400 * len(mine))) if mine else (held[r["doc_id"]], "und", 0.0)
    assert {r["doc_id"]: (r["held_out"], r["lang_pred"], r["score"]) for r in q.op3_language(spark, DATA).collect()} == want


def test_out_of_place_is_brute_force():
    rng = random.Random(2)
    for _ in range(50):
        pool = rng.sample(range(1, 500), 60)
        mine, prof = np.array(rng.sample(pool, 30)), rng.sample(pool, 40)
        want = sum(abs(i - prof.index(g)) if g in prof else 40 for i, g in enumerate(mine.tolist()))
        assert li.Profile(prof, 40).distance(mine) == want
    c = Counter(li.gram_codes("Ab a").tolist())
    assert {li.decode_gram(k): n for k, n in c.items()} == {"a": 2, "b": 1, "_a": 2, "ab": 1, "b_": 1, "a_": 1, "_ab": 1, "ab_": 1, "_a_": 1}


def test_quality_held_out_accuracy(spark, edge, none):
    rows = q.op2_quality(spark, BIG).join(spark.read.parquet(f"{BIG}/labels.parquet"), "doc_id").where("held_out").collect()
    assert len(rows) > 50 and sum(r["predicted"] == r["quality"] for r in rows) >= 0.95 * len(rows)
    assert all(r["predicted"] == (r["score"] >= 0.7) and 0 <= r["score"] <= 1 for r in rows)
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    got = qu.classify_quality(edge, labels.limit(0)).collect()
    assert len(got) == 8 and {r["score"] for r in got} == {0.5}
    odd = spark.createDataFrame([(4, 1), (4, None), (5, 7), (None, 0), (2, 0), (3, 0), (6, 1)], "doc_id long, quality int")
    assert qu.classify_quality(edge, odd).count() == 8 and qu.classify_quality(none, odd).count() == 0


def test_discriminant_is_the_gaussian_formula(spark):
    rng = np.random.default_rng(1)
    d = len(qu.FEATURES)
    x = np.concatenate([rng.normal(0, 1, (60, d)), rng.normal(0.7, 2, (80, d))])
    y = [0] * 60 + [1] * 80
    df = spark.createDataFrame([(int(a), [float(v) for v in b]) for a, b in zip(y, x, strict=True)], "label int, features array<double>")
    m = qu.fit_discriminant(df, pool=0.1, ridge=0.02)
    log = []
    own = [np.cov(x[np.array(y) == k].T, bias=True) for k in (0, 1)]
    pooled = (60 * own[0] + 80 * own[1]) / 140
    for k, n in ((0, 60), (1, 80)):
        s = 0.9 * own[k] + 0.1 * pooled
        s = 0.98 * s + 0.02 * np.trace(s) / d * np.eye(d)
        z = x - x[np.array(y) == k].mean(0)
        log.append(np.log(n / 140) - 0.5 * np.linalg.slogdet(s)[1] - 0.5 * np.einsum("ij,jk,ik->i", z, np.linalg.inv(s), z))
    assert np.allclose(m.scores(x), 1 / (1 + np.exp(log[0] - log[1])))


def brute_statistics(text):
    """The fourteen statistics, from their definitions, over the UTF-8 bytes of a text."""
    t = (text or "").encode()
    words = t.split()
    n = len(words)
    if not n:
        return [0.0] * 14
    chars = len(t) - n + 1
    share = lambda pick: math.sqrt(sum(c in pick for c in t) / chars)
    lines = [x for x in t.split(b"\n") if x.strip()]
    ends = sum(c in b".!?" for c in t)
    top = Counter(words).most_common(1)[0][1]
    pairs = [(words[i], words[i + 1]) for i in range(n - 1)]
    return [
        math.log(1 + n), math.log(1 + sum(len(w) for w in words) / n), share(b"#*$%&|<>~^=+_{}[]\\/@"), share(b"!"), share(bytes(range(65, 91))), share(b"0123456789"), share(b",;:"),
        math.log(1 + n / (ends + 1)), math.log(len(set(words)) / n) / (1 + math.log(n)), math.sqrt(1 - len(set(lines)) / len(lines)), math.sqrt(top / n),
        math.sqrt(1 - len(set(pairs)) / max(1, n - 1)) if n > 1 else 0.0, math.log(1 + n / len(lines)), math.sqrt(sum(x.rstrip()[-1:] in (b".", b"!", b"?") for x in lines) / len(lines)),
    ]


def test_quality_query_is_brute_force(spark, docs):
    import zlib

    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    x = {i: np.array(brute_statistics(t)) for i, t in texts.items()}
    marks = [(r["doc_id"], r["quality"]) for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()]
    own = [np.array([x[i] for i, y in marks if y == k and not held(i) and i in x]) for k in (0, 1)]
    total, d = sum(map(len, own)), 14
    cov = [np.cov(a.T, bias=True) for a in own]
    pooled = sum(len(a) * c for a, c in zip(own, cov, strict=True)) / total
    ids, log = sorted(x), []
    for a, c in zip(own, cov, strict=True):
        c = 0.9 * c + 0.1 * pooled
        c = 0.98 * c + 0.02 * np.trace(c) / d * np.eye(d)
        z = np.array([x[i] for i in ids]) - a.mean(0)
        log.append(np.log(len(a) / total) - 0.5 * np.linalg.slogdet(c)[1] - 0.5 * np.einsum("ij,jk,ik->i", z, np.linalg.inv(c), z))
    want = dict(zip(ids, 1 / (1 + np.exp(np.clip(log[0] - log[1], -700, 700))), strict=True))
    rows = q.op2_quality(spark, DATA).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r["held_out"] == held(r["doc_id"]) and abs(r["score"] - want[r["doc_id"]]) < 1e-6 and r["predicted"] == (r["score"] >= 0.7)


V = sg.vocabulary(sg.DEFAULT_MODEL, 2e-4)
LAT = sg.Lattices(V)


def all_paths(text, V=V):
    s, out = "▁" + text.replace(" ", "▁"), {}

    def go(i, ids, w):
        if i == len(s):
            out[tuple(ids)] = w
            return
        go(i + 1, [*ids, int(V.single[ord(s[i])])], w + float(V.single_weight[ord(s[i])]))
        state, j = V.next[0, V.letter[ord(s[i])]], i + 1
        while state and j < len(s):
            state = V.next[state, V.letter[ord(s[j])]]
            j += 1
            if state and V.piece[state] >= 0:
                go(j, [*ids, int(V.piece[state])], w + float(V.weight[state]))

    go(0, [], 0.0)
    z = np.logaddexp.reduce(list(out.values()))
    return {k: v - z for k, v in out.items()}


def sampled(text, n, k, lat=LAT):
    return [x for i in range(0, n, 1000) for x in sg.sample_batch([text] * 1000, sg.mix(np.arange(i, i + 1000).astype(np.uint64)), lat, k)]


def test_segmentations_follow_the_law_without_replacement():
    law, n = all_paths("to be"), 20000
    got = sampled("to be", n, 2)
    first = Counter(tuple(x[0][0]) for x in got)
    pairs = Counter((tuple(x[0][0]), tuple(x[1][0])) for x in got)
    assert all(len(x) == 2 and tuple(x[0][0]) != tuple(x[1][0]) for x in got)
    assert max(abs(first[k] / n - math.exp(w)) for k, w in law.items()) < 0.01
    assert max(abs(c / n - math.exp(law[a] + law[b]) / (1 - math.exp(law[a]))) for (a, b), c in pairs.items()) < 0.01
    assert all(abs(s[1] - law[tuple(s[0])]) < 1e-9 for x in got[:200] for s in x)
    # inverse inclusion probabilities estimate the number one
    assert abs(np.mean([sum(math.exp(s[1] - s[2]) for s in x) for x in got]) - 1) < 0.02


@pytest.mark.parametrize("alpha", [1e-5, 2e-4, 0.01, 0.1, 1.0])
def test_few_segmentations_are_all_given(alpha):
    # the least likely of these has a log probability below -30,000 for an alpha of 1
    v = sg.vocabulary(sg.DEFAULT_MODEL, alpha)
    law = all_paths("abc", v)
    got = sampled("abc", 1000, 20, sg.Lattices(v))
    assert len(law) > 2
    assert all(len(x) == len(law) and all(abs(s[1] - law[tuple(s[0])]) <= 1e-9 * max(1, -s[1]) and s[2] == 0.0 for s in x) for x in got)
    assert all({tuple(s[0]) for s in x} == set(law) for x in got)


@pytest.mark.parametrize("alpha", [2e-4, 0.01, 0.1, 1.0])
@pytest.mark.parametrize("letters", [1, 90, 500])
def test_long_words_and_large_alphas_have_finite_sums(alpha, letters):
    rng = random.Random(letters)
    word = "".join(rng.choice("abcdefghij") for _ in range(letters)) + " the"
    v = sg.vocabulary(sg.DEFAULT_MODEL, alpha)
    for x in sampled(word, 1000, 4, sg.Lattices(v))[:50]:
        assert len(x) == len({tuple(s[0]) for s in x}) >= 2
        assert all(math.isfinite(s[1]) and s[1] <= 1e-12 and math.isfinite(s[2]) and s[2] <= 0 for s in x)
        assert all(b"".join(v.bytes[i] for i in s[0]).decode() == " " + word for s in x)


def test_backward_sums_are_exact():
    # log probability of a path is its score less the log of the sum over all paths, here by a plain recursion
    for alpha in (2e-4, 0.1):
        v = sg.vocabulary(sg.DEFAULT_MODEL, alpha)
        text = "international bananas " + "xyz" * 40
        s = "▁" + text.replace(" ", "▁")
        after = [0.0] * (len(s) + 1)
        for i in range(len(s) - 1, -1, -1):
            terms = [float(v.single_weight[ord(s[i])]) + after[i + 1]]
            state, j = v.next[0, v.letter[ord(s[i])]], i + 1
            while state and j < len(s):
                state = v.next[state, v.letter[ord(s[j])]]
                j += 1
                if state and v.piece[state] >= 0:
                    terms.append(float(v.weight[state]) + after[j])
            after[i] = float(np.logaddexp.reduce(terms))
        scores = {i: w for w, i in [(v.weight[n], i) for n, i in enumerate(v.piece) if i >= 0]}
        scores |= {int(i): float(w) for i, w in zip(v.single, v.single_weight, strict=True) if i >= 0}
        for ids, log, _ in sampled(text, 1000, 2, sg.Lattices(v))[0]:
            assert abs(sum(scores[int(i)] for i in ids) - after[0] - log) < 1e-6 * max(1, abs(after[0]))


def test_kept_lattices_change_nothing(monkeypatch):
    rng = random.Random(6)
    texts = [" ".join("".join(rng.choice("etaoin\n.") for _ in range(rng.randint(1, 9))) for _ in range(30)) for _ in range(40)]
    keys = np.arange(40).astype(np.uint64)
    want = [sg.sample_batch([t], keys[i : i + 1], sg.Lattices(V), 3)[0] for i, t in enumerate(texts)]
    monkeypatch.setattr(sg, "HELD_NODES", 500)
    lat = sg.Lattices(V)
    got = [x for a in range(0, 40, 5) for x in sg.sample_batch(texts[a : a + 5], keys[a : a + 5], lat, 3)]
    assert str([[(s[0].tolist(), s[1], s[2]) for s in x] for x in got]) == str([[(s[0].tolist(), s[1], s[2]) for s in x] for x in want])


def test_segmentations_decode_exactly(spark, docs, edge, none):
    d = docs.select("doc_id", "text").unionByName(edge.select("doc_id", "text")).unionByName(spark.createDataFrame([(7, "  two  spaces "), (8, "▁▁ \t\u0000x"), (9, "q" * 3000)], "doc_id long, text string"))
    rows = sg.decode_segmentations(sg.sample_segmentations(d, keep=["doc_id", "text"]), keep=["doc_id", "text", "segmentations"]).collect()
    assert len(rows) == d.count()
    for r in rows:
        assert all(t == (r["text"] or "") for t in r["decoded_texts"]) and len({tuple(s) for s in r["segmentations"]}) == len(r["segmentations"])
    again = {(r["doc_id"], str(r["segmentations"])) for r in sg.sample_segmentations(d.repartition(7)).collect()}
    assert again == {(r["doc_id"], str(r["segmentations"])) for r in rows}
    assert sg.sample_segmentations(d).where("NOT decodes").count() == 0
    assert sg.sample_segmentations(edge).count() == 8 and sg.sample_segmentations(none).count() == 0
    with pytest.raises(ValueError):
        sg.sample_segmentations(d, samples=0)


def test_greedy_pieces_agree_with_the_library():
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=sg.DEFAULT_MODEL)
    t = "Hello world, été\nx"
    for ids, _, _ in sg.sample_batch([t], np.array([5], dtype=np.uint64), LAT, 3)[0]:
        assert p.decode([int(i) for i in ids]) == t


def test_chat_round_trips():
    c, rng = chat.codec(chat.DEFAULT_RANKS), random.Random(4)
    parts = ["\\", "### User: ", "### Assistant: ", "</turn>", "\n", "x", "### ", "<", "/turn>", "é", "### Role: ", "### Text: ", " ", ""]
    for _ in range(1500):
        turns = [(rng.choice(["user", "assistant", "system", "tool", "odd\n### Text: ", ""]), "".join(rng.choice(parts) for _ in range(rng.randint(0, 7)))) for _ in range(3)]
        ids = [i for r, t in turns for i in c.turn(r, t)[0]]
        assert c.read(ids) == turns and chat.read_text(c.render(ids)) == turns


def test_chat_query_is_brute_force(spark):
    got = {r["conv_id"]: r for r in q.op6_chat(spark, DATA).collect()}
    by = {-7: [("user", q.HOSTILE), ("assistant", q.HOSTILE)]}
    for r in spark.read.parquet(f"{DATA}/conversations.parquet").orderBy("conv_id", "turn").collect():
        by.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    assert set(got) == set(by)
    for k, turns in by.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        want = (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert (got[k]["n_turns"], got[k]["turns_sha256"], got[k]["loss_chars"], got[k]["loss_sha256"]) == want
    assert got[-7]["formatted_chars"] == len("### User: ") + len("### Assistant: ") + 2 * (len(q.HOSTILE) + 3 + len("</turn>\n"))


def test_chat_masks_and_edges(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (1, None, None, None), (1, 1, "assistant", "b"), (None, 0, "assistant", ""), (2, 0, "assistant", "x" * 50000)]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("ids", F.lit(1)).withColumn("conv", F.lit(2))
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_turns(d)).collect()}
    assert (got[1]["n_turns"], got[1]["loss_chars"], got[None]["n_turns"], got[2]["loss_chars"]) == (4, 2, 1, 50000)
    turns = chat.format_turns(d).where("conv = 1").orderBy("position").collect()
    assert [t["position"] for t in turns] == [0, 1, 2, 3] and all(b["token_start"] - a["token_start"] == len(a["ids"]) for a, b in zip(turns, turns[1:], strict=False))
    c = chat.codec(chat.DEFAULT_RANKS)
    assert [c.text([i for i, m in zip(t["ids"], t["mask"], strict=True) if m]) for t in turns] == ["", "", "b", "b"]
    whole = chat.format_conversations(d).where("conv = 1").first()
    assert whole["ids"] == [i for t in turns for i in t["ids"]] and len(whole["mask"]) == len(whole["ids"])
    assert chat.read_back(chat.format_turns(d.limit(0))).count() == 0


def test_pages_of_the_table(spark):
    import re
    from html import unescape

    got = {r["page_id"]: r for r in q.op10_extract(spark, BIG).collect()}
    for r in spark.read.parquet(f"{BIG}/pages.parquet").collect():
        a = re.sub(r"<[^>]*$", "", re.search(r"<article>(.*?)(?:</article>|\Z)", r["html"], re.DOTALL)[1])
        want = "\n\n".join(z for z in (" ".join(unescape(re.sub(r"<[^>]*>", "", y.replace("<br>", " "))).split()) for y in re.split(r"</?(?:p|h1)>", a)) if z)
        assert got[r["page_id"]]["text"] == want and got[r["page_id"]]["n_chars"] == len(want)


def test_other_pages_and_edges(spark):
    w = pg.learn_weights(spark.read.parquet(f"{BIG}/pages.parquet"))
    html = (
        '<html><body><div id="cookie-notice">We use cookies, please accept them all now</div><header><h1>Site</h1></header><div class="sidebar"><p>foo bar</p></div><div class="post"><h1>T&eacute;st &lt;b&gt;</h1>'
        "<p>Hello <b>wor</b>ld this is the\n first of many words.</p><ul><li>one item</li><li>two</li></ul><p>Last.</p></div><section class='comments'><p>I like this post very much, thanks for it all</p></section><footer>&copy; x</footer></body></html>"
    )
    assert pg.extract(html, w) == "Tést <b>\n\nHello world this is the first of many words.\n\none item\n\ntwo\n\nLast."
    article = "<article><p>One two three.</p><aside>not this one</aside><div class='ad'>nor this</div><script>var a='<p>x</p>'</script><p>End"
    assert pg.extract(article, w) == "One two three.\n\nEnd" and pg.extract(None, w) == pg.extract("", w) == pg.extract("<nav>x</nav><p", w) == ""
    d = spark.createDataFrame([(1, None), (1, ""), (None, article), (2, "<p>" + "w " * 50000)], "page_id long, html string").withColumn("main_text", F.lit("x")).withColumn("url", F.lit("u"))
    rows = pg.extract_pages(d, w).collect()
    assert len(rows) == 4 and pg.extract_pages(d.limit(0), w).count() == 0 and pg.learn_weights(d.limit(0)) == pg.weights_of({})


def test_pages_with_ends_left_out_and_names_of_sections():
    w = pg.weights_of({})
    body = "<article><p>One two three four five six.</p></article>"
    want = "One two three four five six."
    for head in ("<head><title>x</title><body>", "<head><title>x<body>", "<head><meta charset=x><body>", "<head><title>x</title></head>", "<body><select><option>a<option>b<p>", "<body><textarea>", "<svg><path d=1>"):
        assert pg.extract(f"<html>{head}{body}", w).endswith(want), head
    kept = "<article><h2 id='related-work'>Related work</h2><p class=search>A search is here now.</p><div class='notice-of-motion'>Notice of a motion given.</div><p>x <math>a b</math> <object>c d</object></p><div class='cookie-notice'>no</div><p class=ad>no</p></article>"
    assert pg.extract(kept, w) == "Related work\n\nA search is here now.\n\nNotice of a motion given.\n\nx a b c d"
    assert pg.extract("<p>1 < 2 and a<b>c</b> <3</p>", w) == "1 < 2 and ac <3"


def test_hostile_pages_take_linear_time():
    import time

    for bit, tail in (("<p '", ""), ('<p a="', ""), ("<p a='x>", ""), ("<div>", "</b>" * 8000), ("<!-", ""), ("<title>", ""), ("<", ""), ("<b><p>", "</i>" * 8000), ("<select><option>", "<p>x")):
        begun = time.process_time()
        list(pg.events(bit * 8000 + tail))
        assert time.process_time() - begun < 2.0, bit


def test_max_scoring_run_is_brute_force():
    rng = random.Random(3)
    weights = pg.weights_of({})
    for _ in range(300):
        bits = [rng.choice(["<p>", "</p>", "<nav>a b c d</nav>", " word more ", "<i>", "</i>", "<div class=ad>x y</div>", "once"]) for _ in range(rng.randint(1, 9))]
        html = "".join(bits)
        seen = list(pg.events(html))
        scores = []
        for kind, name, text, skip, _ in seen:
            n = len(text.split())
            scores.append(n * (weights["word:skipped"] if skip else weights["word:content"]) if kind == "text" else weights.get("tag:skipped", weights["tag"]) if skip else weights.get(f"tag:{name}", weights["tag"]))
        sums = {(i, j): sum(scores[i:j]) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)}
        top = max(sums.values(), default=0)
        best = {(i, j) for (i, j), x in sums.items() if x > top - 1e-9}
        texts = {" ".join("".join(" " if k in ("break", "space") else x for k, _, x, skip, _ in seen[i:j] if not skip or k in ("break", "space")).split()) for i, j in best}
        got = " ".join(pg.extract(html, weights).split())
        assert got in texts if top > 1e-9 else got == "", (html, got, texts)


def test_pipeline_is_its_stages_by_brute_force(spark, docs, edge):
    got = {r["doc_id"]: r for r in cp.run(spark, DATA).collect()}
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    texts = {i: t for i, t in rows.items() if any(c.isalpha() for c in t)}
    from test_search_operators import all_similar, brute_hits
    from tidewright.llm.secrets import find_secrets, redact

    comp = all_similar(texts)
    texts = {i: t for i, t in texts.items() if comp[i] == i}
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    texts = {i: redact(t, find_secrets(t)) for i, t in texts.items() if not brute_hits(t, items)[2]}
    assert set(got) == set(texts)
    assert all(b"".join(V.bytes[x] for x in s)[1:].decode() == texts[i] for i, r in got.items() for s in r["segmentations"])


def test_pipeline_stages_take_edges(spark, edge):
    d = edge.select("doc_id", "text").withColumn("lang", F.lit("en")).withColumn("source", F.lit(None).cast("string")).withColumn("n_chars", F.length("text").cast("long"))
    for name, stage in cp.STAGES:
        out = stage(spark, d, DATA)
        assert out.count() <= 8 and (name == "segmentation" or out.columns == cp.COLUMNS)
        assert stage(spark, d.limit(0), DATA).count() == 0
    kept = {r["doc_id"] for r in cp.language(spark, d, DATA).collect()}
    assert not {1, 2, 3} & kept


def test_nothing_is_sampled_from_one_fingerprint(spark):
    d = spark.range(500).select(F.col("id").alias("doc_id"), F.lit("a b c d e f").alias("text"))
    assert {r["component_id"] for r in si.near_duplicates(d).collect()} == {0}
