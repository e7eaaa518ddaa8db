"""Scoring of multi-label predictions: counts, P/R/F1, bootstrap, kappa, confusion.

Frames hold one row an example with ``id``, ``gold`` and ``pred`` (arrays of labels).
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.draws import md5_numbers


def ratio(a, b) -> Column:
    """a / b, 0 where b is 0 (ANSI division would fail)."""
    return F.coalesce(F.try_divide(F.expr(a) if isinstance(a, str) else a, F.expr(b) if isinstance(b, str) else b), F.lit(0.0))


def aligned(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """id, gold, pred from (id, labels) frames; sets that differ are an error."""
    g = gold.groupBy("id").agg(F.first("labels").alias("gold"), F.count(F.lit(1)).alias("gold_rows"))
    p = pred.groupBy("id").agg(F.first("labels").alias("pred"), F.count(F.lit(1)).alias("pred_rows"))
    both = g.join(p, "id", "full_outer").persist()
    try:
        if both.where("gold_rows IS DISTINCT FROM 1 OR pred_rows IS DISTINCT FROM 1").limit(1).count():
            raise ValueError("gold and predictions have different rows")
    finally:
        both.unpersist()
    return both.select("id", "gold", "pred")


def counts(rows: DataFrame, themes: list[str]) -> DataFrame:
    """theme, support, tp, fp, fn for every theme, in one pass: themes are a short list, so rows are
    exploded in the task and combined there before the shuffle."""
    one = rows.select("gold", "pred", F.posexplode(F.array(*[F.lit(t) for t in themes])).alias("ord", "theme"))
    g, p = F.array_contains("gold", F.col("theme")), F.array_contains("pred", F.col("theme"))
    found = one.groupBy("ord", "theme").agg(F.count_if(g).alias("support"), F.count_if(g & p).alias("tp"), F.count_if(~g & p).alias("fp"), F.count_if(g & ~p).alias("fn"))
    dim = rows.sparkSession.createDataFrame([(i, t) for i, t in enumerate(themes)], "ord int, theme string")
    filled = F.broadcast(dim).join(found, ["ord", "theme"], "left")
    return filled.select("ord", "theme", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("support", "tp", "fp", "fn")])


def with_prf(table: DataFrame) -> DataFrame:
    """Adds precision, recall and f1; 0 over an empty denominator."""
    t = table.withColumn("precision", ratio("cast(tp as double)", "tp + fp")).withColumn("recall", ratio("cast(tp as double)", "tp + fn"))
    return t.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def summary(rows: DataFrame, themes: list[str]) -> DataFrame:
    """One row: micro_f1, macro_f1 (mean over all themes), exact_match_rate (whole sets, labels outside the themes
    included), abstain_accuracy (share of empty golds predicted empty, 0 if there are none), n."""
    per = with_prf(counts(rows, themes))
    total = with_prf(per.agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"), F.avg("f1").alias("macro_f1")))
    g, p = F.array_sort(F.array_distinct("gold")), F.array_sort(F.array_distinct("pred"))
    whole = rows.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(g == p).alias("exact"), F.count_if(F.size("gold") == 0).alias("empty"), F.count_if((F.size("gold") == 0) & (F.size("pred") == 0)).alias("kept")
    ).select("n", ratio("cast(exact as double)", "n").alias("exact_match_rate"), ratio("cast(kept as double)", "empty").alias("abstain_accuracy"))
    return total.select(F.col("f1").alias("micro_f1"), F.coalesce("macro_f1", F.lit(0.0)).alias("macro_f1")).crossJoin(whole)


#: Draws of a bootstrap that are one piece of work.
PIECE = 1 << 20


def _packed(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
    """Arrays of bytes to one value a batch, in order."""
    for b in batches:
        if b.num_rows:
            yield pa.RecordBatch.from_arrays([pa.array([b.column(0).flatten().to_numpy().astype(np.uint8).tobytes()], pa.binary())], names=["o"])


def _codes(packed: bytes, themes: int) -> tuple[np.ndarray, np.ndarray]:
    """The different outcomes (a byte a theme) as rows of 0 and 1 for tp, fp and fn of each theme, and which one each example has."""
    each = np.frombuffer(packed, np.dtype((np.void, themes)))
    kinds, code = np.unique(each, return_inverse=True)
    values = kinds.view(np.uint8).reshape(len(kinds), themes)
    hits = (values[:, :, None] == np.array([1, 2, 3], np.uint8)).astype(np.int64).reshape(len(kinds), themes * 3)
    return hits, code.astype(np.min_scalar_type(len(kinds)))


def _tallied(shared, pieces: int, seed: int) -> Callable[[Iterable[pa.RecordBatch]], Iterable[pa.RecordBatch]]:
    """round, t, tp, fp, fn of pieces of rounds, the sum of all themes last; piece p of round r has the number r * pieces + p."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        code, hits = shared.value
        n, themes = len(code), hits.shape[1] // 3
        for b in batches:
            for unit in b.column(0).to_pylist():
                r, p = divmod(unit, pieces)
                drawn = np.zeros(len(hits), np.int64)
                for x in md5_numbers(f"{seed}|{r}|".encode(), p * PIECE, min(n, (p + 1) * PIECE)):
                    drawn += np.bincount(code[x % np.uint32(n) if n < 1 << 32 else x], minlength=len(hits))
                tally = (drawn @ hits).reshape(themes, 3)
                tally = np.vstack([tally, tally.sum(0)])
                columns = [np.full(themes + 1, r, np.int64), np.arange(themes + 1, dtype=np.int32), tally[:, 0], tally[:, 1], tally[:, 2]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["round", "t", "tp", "fp", "fn"])

    return run


def bootstrap(rows: DataFrame, themes: list[str], *, rounds: int = 1000, seed: int = 17, alpha: float = 0.05) -> DataFrame:
    """theme (null: micro), f1_low, f1_high: order statistics of resampled scores, without
    interpolation. Draw d of round r takes row md5(seed|r|d) mod n of the rows in the order of their ids, the same for all
    themes. Rows are sorted in parallel; their outcomes go to every task, a number of one, two or four bytes a row by how many
    different ones there are. Draws are made and tallied in arrays, so nothing but the tallies of a round is shuffled; no rounds or rows give zeros."""
    spark = rows.sparkSession
    names = [*themes, None]
    outcome = F.array(*[F.when(F.array_contains("gold", t), F.when(F.array_contains("pred", t), 1).otherwise(3)).when(F.array_contains("pred", t), 2).otherwise(0).cast("tinyint") for t in themes])
    sorted_rows = rows.select("id", outcome.alias("o")).orderBy("id").select("o") if themes and rounds > 0 else None
    packed = b"".join(r["o"] for r in sorted_rows.mapInArrow(_packed, "o binary").collect()) if sorted_rows is not None else b""
    if not packed:
        return spark.createDataFrame([(t, 0.0, 0.0) for t in names], "theme string, f1_low double, f1_high double")
    hits, code = _codes(packed, len(themes))
    n, shared = len(code), spark.sparkContext.broadcast((code, hits))
    pieces = -(-n // PIECE)
    units = rounds * pieces
    tasks = min(units, max(rounds * n // PIECE, 2 * spark.sparkContext.defaultParallelism))
    tallies = spark.range(0, units, 1, tasks).mapInArrow(_tallied(shared, pieces, seed), "round long, t int, tp long, fp long, fn long")
    per = tallies.groupBy("round", "t").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    scored = with_prf(per)
    ranked = scored.withColumn("k", F.row_number().over(Window.partitionBy("t").orderBy("f1", "round")) - 1)
    low, high = int(alpha / 2 * rounds), min(rounds - 1, int((1 - alpha / 2) * rounds))
    bounds = ranked.groupBy("t").agg(F.max(F.when(F.col("k") == low, F.col("f1"))).alias("f1_low"), F.max(F.when(F.col("k") == high, F.col("f1"))).alias("f1_high"))
    dim = spark.createDataFrame(list(enumerate(names)), "t int, theme string")
    return F.broadcast(dim).join(bounds, "t").orderBy("t").select("theme", "f1_low", "f1_high")


def evaluate(rows: DataFrame, themes: list[str], *, rounds: int = 1000, seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """(per theme, summary), both with bootstrap bounds."""
    bounds = bootstrap(rows, themes, rounds=rounds, seed=seed).persist()
    per = with_prf(counts(rows, themes)).join(bounds.where("theme IS NOT NULL"), "theme").orderBy("ord").drop("ord")
    micro = bounds.where("theme IS NULL").select(F.col("f1_low").alias("micro_f1_low"), F.col("f1_high").alias("micro_f1_high"))
    return per, summary(rows, themes).crossJoin(micro)


def kappa(rows: DataFrame, theme: str) -> DataFrame:
    """Cohen's kappa of two labelers (gold and pred) on one theme; 0 for no rows; where chance alone
    agrees always: 1 if they do, else 0."""
    a, b = F.array_contains("gold", theme), F.array_contains("pred", theme)
    s = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(a == b).alias("same"), F.count_if(a).alias("a"), F.count_if(b).alias("b"))
    observed, pa, pb = ratio("cast(same as double)", "n"), ratio("cast(a as double)", "n"), ratio("cast(b as double)", "n")
    t = s.select("n", observed.alias("po"), (pa * pb + (1 - pa) * (1 - pb)).alias("pe"))
    value = F.when(F.col("n") == 0, 0.0).when(F.col("pe") >= 1, F.when(F.col("po") >= 1, 1.0).otherwise(0.0)).otherwise(F.try_divide(F.col("po") - F.col("pe"), 1 - F.col("pe")))
    return t.select(F.lit(theme).alias("theme"), value.alias("kappa"))


def confusion_pairs(rows: DataFrame, *, top: int = 10) -> DataFrame:
    """missed, spurious, n: labels missed together with a wrong one, most frequent first, ties by name."""
    pairs = rows.select("pred", "gold", F.explode(F.array_except("gold", "pred")).alias("missed")).select("missed", F.explode(F.array_except("pred", "gold")).alias("spurious"))
    return pairs.groupBy("missed", "spurious").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "missed", "spurious").limit(top)


def as_rows(per: DataFrame) -> DataFrame:
    """Scores as text: three decimals, intervals as [low, high]."""
    return per.select("theme", "support", *[F.format_string("%.3f", c).alias(c) for c in ("precision", "recall", "f1")], F.format_string("[%.2f, %.2f]", "f1_low", "f1_high").alias("ci"))
