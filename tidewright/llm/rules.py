"""Quality rules: a threshold table compiled into one projection.

``RULES`` states each rule as (name, measure, lowest, highest); ``apply_rules`` turns
it into plain column expressions over one row, without user functions, shuffles or
joins. Counts come from array functions of the same row, so any text length is
handled in one pass over that text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import col

#: Frequent function words of the languages that the rules are meant for.
STOP_WORDS = (
    "the of and to in is that for it was on are as with by this be from or have an not but at they we you a",
    "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er",
    "de la le et les des en un du une que est pour qui dans par sur il au avec ce pas plus on sont",
    "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus",
)
#: (rule, measure, lowest, highest): a document is kept if every measure is within its bounds.
RULES: tuple[tuple[str, str, float | None, float | None], ...] = (
    ("length", "n_words", 50, None),
    ("word length", "mean_word_chars", 2, 16),
    ("symbols", "symbol_ratio", None, 0.1),
    ("stop words", "stop_word_ratio", 0.03, None),
    ("repeated lines", "dup_line_ratio", None, 0.6),
    ("repeated words", "repeat_word_ratio", None, 0.5),
    ("marked words", "shouted_ratio", None, 0.3),
)
_ALL = 1 << 30
_SPACE = " \t\n\x0b\x0c\r"
_SPLIT = r"[\x20\x09-\x0D]+"
_SYMBOLS = "#*$%&|<>"


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def measure(docs: DataFrame, *, text_col: str = "text", keep: list[str]) -> DataFrame:
    """The kept columns (as k0, k1, ...) and the base counts of each text."""
    stops = sorted({w for line in STOP_WORDS for w in line.split()})
    text = F.coalesce(col(text_col).cast("string"), F.lit(""))
    one = docs.select(*[col(c).alias(f"k{i}") for i, c in enumerate(keep)], text.alias("t"))
    two = one.withColumn("u", F.btrim("t", F.lit(_SPACE)))
    three = two.withColumn("w", F.when(F.col("u") == "", F.array().cast("array<string>")).otherwise(F.split("u", _SPLIT)))
    four = three.withColumn("n", F.size("w")).withColumn("l", F.filter(F.split("t", "\n"), lambda x: F.btrim(x, F.lit(_SPACE)) != ""))
    # Lambdas see nothing but their own element: a column named in one would be computed again for each
    # element wherever Catalyst moves the expression, as into a filter on the result. So neighbours are zipped.
    w = F.col("w")
    triples = F.slice(F.arrays_zip(w.alias("a"), F.slice(w, 2, _ALL).alias("b"), F.slice(w, 3, _ALL).alias("c")), 1, F.greatest(F.col("n") - 2, F.lit(0)))
    five = four.withColumn("h", F.transform(triples, lambda z: F.xxhash64(z["a"], z["b"], z["c"])))
    # only a text with a window found twice needs the sorted windows
    twice = F.size(F.array_distinct("h")) < F.size("h")
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    six = five.withColumn("s", F.when(twice, F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))).otherwise(none))
    last = F.array(F.struct(F.lit(None).cast("bigint").alias("h"), F.lit(None).cast("int").alias("i")))
    sides = F.arrays_zip(F.col("s").alias("x"), F.concat(last, F.col("s")).alias("before"), F.concat(F.slice("s", 2, _ALL), last).alias("after"))
    same = lambda x, y: F.coalesce(x["h"] == y["h"], F.lit(False))
    seven = six.withColumn("p", F.transform(F.filter(sides, lambda z: same(z["x"], z["before"]) | same(z["x"], z["after"])), lambda z: z["x"]["i"]))
    covered = F.array_distinct(F.concat("p", F.transform("p", lambda x: x + 1), F.transform("p", lambda x: x + 2)))
    return seven.select(
        *[f"k{i}" for i in range(len(keep))],
        F.col("n").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", _SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        F.size(covered).cast("long").alias("n_repeat_words"),
        F.size("l").cast("long").alias("n_lines"),
        F.size(F.filter("w", lambda x: F.lower(x).isin(stops))).cast("long").alias("n_stop_words"),
        F.size(F.filter("w", lambda x: F.endswith(x, F.lit("!!")))).cast("long").alias("n_shouted"),
    )


def apply_rules(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, rules=RULES) -> DataFrame:
    """The kept columns (the id by default), the counts n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words, n_lines, n_stop_words, n_shouted, base_failed, failed
    (names of the rules that a text breaks) and kept.

    Words are runs of anything but ASCII white space. Null and empty texts count as zero
    words and fail the base; ratios over nothing are 0. Windows of three words are
    compared by 64-bit hashes. Repeated rows get equal results; an empty table gives no rows.
    """
    kept = list(keep or [id_col])
    base = measure(docs, text_col=text_col, keep=kept)
    n, lines = F.col("n_words"), F.col("n_lines")
    values = {
        "n_words": n,
        "mean_word_chars": _ratio(F.col("word_chars"), n),
        "symbol_ratio": _ratio(F.col("n_symbols"), n),
        "stop_word_ratio": _ratio(F.col("n_stop_words"), n),
        "dup_line_ratio": _ratio(F.col("n_dup_lines"), lines),
        "repeat_word_ratio": _ratio(F.col("n_repeat_words"), n),
        "shouted_ratio": _ratio(F.col("n_shouted"), n),
    }
    broken = []
    for name, what, low, high in rules:
        out = F.lit(False)
        out = out | (values[what] < low) if low is not None else out
        out = out | (values[what] > high) if high is not None else out
        broken.append(F.when(out, F.lit(name)))
    failed = F.array_compact(F.array(*broken)) if broken else F.array().cast("array<string>")
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop_words", "n_shouted"]
    base_failed = (n < 50) | (100 * F.col("n_repeat_words") > 50 * n)
    judged = base.select(*[f"k{i}" for i in range(len(kept))], *counts, base_failed.alias("base_failed"), failed.alias("failed"))
    mine = {*counts, "base_failed", "failed", "kept"}
    return judged.select(
        *[F.col(f"k{i}").alias(c) for i, c in enumerate(kept) if c not in mine],
        *counts,
        "base_failed",
        "failed",
        (~F.col("base_failed") & (F.size("failed") == 0)).alias("kept"),
    )
