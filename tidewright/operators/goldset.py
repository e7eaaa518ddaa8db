"""A stratified gold set and its CSV worksheet."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import keyword_labels

SEED = 20260101
# The worksheet's columns, in order.
FIELDS = ("chunk_id", "ticker", "cohort", "fiscal_year", "item", "stratum", "is_new_language", "baseline_labels", "gold_labels", "notes", "text")


def round_half_even(x: float) -> int:
    return round(x)


def stratified_sample(
    chunks: DataFrame, taxonomy, *, target_n: int = 400, enriched_share: float = 0.5, seed: int = SEED, buckets: list[str] | None = None, id_col: str = "chunk_id", text_col: str = "text"
) -> DataFrame:
    """chunks (with cohort, one row an id) -> the drawn rows with stratum ("enriched": a keyword hit, or
    "random") and baseline_labels, ordered by a seeded hash. Each pool is drawn round robin over its sorted buckets. The
    plain quota fills up what the enriched pool lacks; the reverse doesn't hold.

    Ids, buckets and labels alone are ranked, and a bucket gives ``target_n`` rows at most to the draw; texts are
    joined to the drawn ids."""
    by = buckets or ["cohort", "fiscal_year", "item"]
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(id_col).cast("string")))
    slim = chunks.select(F.col(id_col).alias("tw_id"), *by, keyword_labels(F.col(text_col), taxonomy).alias("baseline_labels"), key.alias("h")).withColumn("hit", F.size("baseline_labels") > 0)
    turns = slim.withColumn("rn", F.row_number().over(Window.partitionBy("hit", *by).orderBy("h", "tw_id"))).where(F.col("rn") <= target_n)
    placed = turns.withColumn("k", F.row_number().over(Window.partitionBy("hit").orderBy("rn", *by)))
    quota = round_half_even(target_n * enriched_share)
    enriched = F.col("hit") & (F.col("k") <= quota)
    near = placed.where(F.col("k") <= target_n).withColumn("enriched", F.count_if(enriched).over(Window.partitionBy()))  # two pools of target_n rows
    drawn = near.where(enriched | (~F.col("hit") & (F.col("k") <= target_n - F.col("enriched"))))
    picked = drawn.select("tw_id", F.when(F.col("hit"), "enriched").otherwise("random").alias("stratum"), "baseline_labels")
    both = chunks.drop("stratum", "baseline_labels").join(F.broadcast(picked), F.col(id_col) == F.col("tw_id")).drop("tw_id")
    return both.orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit("order"), F.col(id_col).cast("string"))), id_col)


def worksheet(rows: DataFrame, *, blind: bool = True) -> DataFrame:
    """The columns of the worksheet as text; labels and notes to fill in are empty."""
    shown = F.lit("") if blind else F.concat_ws("|", "baseline_labels")
    cells = {"is_new_language": F.col("is_new_language").cast("int").cast("string"), "baseline_labels": shown, "gold_labels": F.lit(""), "notes": F.lit("")}
    return rows.select(*[cells.get(c, F.col(c).cast("string")).alias(c) for c in FIELDS])


def write_worksheet(rows: DataFrame, path: str, *, blind: bool = True) -> None:
    """One CSV file in a folder; a gold set is a few hundred rows."""
    worksheet(rows, blind=blind).coalesce(1).write.mode("overwrite").csv(path, header=True, escape='"', emptyValue="", quoteAll=True)


def read_worksheet(spark, path: str, taxonomy) -> DataFrame:
    """Rows of a worksheet with typed columns. Unknown labels anywhere are one error that
    names them all, sorted."""
    raw = spark.read.csv(path, header=True, schema=", ".join(f"{c} string" for c in FIELDS), multiLine=True, escape='"')
    split = lambda c: F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"\|"), F.trim), lambda x: x != "")
    rows = raw.select(
        "chunk_id", "ticker", "cohort", F.expr("try_cast(fiscal_year AS int)").alias("fiscal_year"), "item", F.coalesce(F.nullif("stratum", F.lit("")), F.lit("random")).alias("stratum"),
        (F.coalesce(F.expr("try_cast(trim(is_new_language) AS int)"), F.lit(0)) != 0).alias("is_new_language"), split(F.col("baseline_labels")).alias("baseline_labels"), split(F.col("gold_labels")).alias("gold_labels"), F.coalesce("notes", F.lit("")).alias("notes"), F.coalesce("text", F.lit("")).alias("text"),
    )
    known = F.array(*[F.lit(i) for i in taxonomy.ids])
    unknown = sorted(r[0] for r in rows.select(F.explode(F.array_except("gold_labels", known)).alias("l")).distinct().collect())
    if unknown:
        raise ValueError("unknown theme ids in the worksheet: " + ", ".join(unknown))
    return rows


def labelled_only(rows: DataFrame) -> DataFrame:
    """Rows with gold labels, or with NONE in the notes."""
    return rows.where((F.size("gold_labels") > 0) | (F.upper(F.trim("notes")) == "NONE"))
