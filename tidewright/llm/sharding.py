"""Size-balanced shards by sampled splitters.

1. Each record has a key, the hash of its text, so that copies are neighbours, and a
   size. A sample is drawn with a chance in proportion to size (a hash of the record
   decides, so a rerun draws the same), hence its quantiles are quantiles of bytes.
2. ``ranges_per_shard`` quantile boundaries for each shard split the keys into ranges.
3. Ranges are measured. One that is overfull in bytes or rows, as one that holds a
   hot key, is subdivided evenly by a second hash, of the id.
4. Ranges in key order are laid end to end; a range belongs to the shard that holds
   its middle byte. Slots count on from the ranges before it in the shard.

The driver sees the sample (its expected size is a parameter) and one row a range.
DataFrame functions only; texts are read once, later steps use a narrow table.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import col, materialize, uniform


def _range_of(key: Column, bounds: list[int]) -> Column:
    """How many bounds are at or below the key, by halving steps."""
    if not bounds:
        return F.lit(0)
    step, steps = 1, []
    while step <= len(bounds):
        steps.insert(0, step)
        step *= 2
    held = F.array(*[F.lit(b).cast("long") for b in bounds])
    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), lambda at, s: at + F.when(F.coalesce(F.get(held, at + s - 1) <= key, F.lit(False)), s).otherwise(0))


def assign_shards(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shards: int = 16, ranges_per_shard: int = 32, sample: int = 8192, seed: int = 17
) -> DataFrame:
    """One row for each record: the id, size (UTF-8 bytes of the text, null: none, plus
    1), text_crc32, shard (0 to shards - 1), slot (gapless from 0 in each shard).

    Sizes of shards differ by about one range, and by no less than the largest record
    allows. Null and empty texts have size 1 and share a key. Repeated rows each
    get a slot of their own; records that are equal in text and id stay in one range.
    With fewer records than shards some shards are empty; an empty table gives no rows.
    """
    if shards < 1 or ranges_per_shard < 1 or sample < 1:
        raise ValueError("shards, ranges_per_shard and sample must be positive")
    text = col(text_col).cast("string")
    held = F.coalesce(text, F.lit(""))
    slim = materialize(
        docs.select(
            col(id_col).alias("id"),
            (F.octet_length(held) + 1).cast("long").alias("size"),
            F.crc32(held.cast("binary")).alias("text_crc32"),
            F.xxhash64(held).alias("k1"),
            F.xxhash64(col(id_col).cast("string"), held).alias("k2"),
        )
    )
    total, rows = slim.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    target, rows_target = max(1.0, total / (shards * ranges_per_shard)), max(1.0, rows / (shards * ranges_per_shard))
    drawn = slim.where(uniform(F.col("k2"), F.lit(seed)) * F.lit(float(max(total, 1))) < F.col("size") * F.lit(float(sample))).select("k1").collect()
    keys = sorted(r["k1"] for r in drawn)
    n = shards * ranges_per_shard
    bounds = sorted({keys[len(keys) * i // n] for i in range(1, n)}) if keys else []
    ranged = slim.withColumn("r", _range_of(F.col("k1"), bounds))
    found = {x["r"]: (x["b"], x["c"]) for x in ranged.groupBy("r").agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("c")).collect()}
    # an overfull range: so many parts, at most one for each row
    parts = []
    for r in range(len(bounds) + 1):
        b, c = found.get(r, (0, 0))
        over = max(b / target, c / rows_target)
        parts.append(min(max(c, 1), int(over) + 1) if over > 2 else 1)
    starts = [0]
    for p in parts:
        starts.append(starts[-1] + p)
    part = F.shiftright(F.shiftrightunsigned("k2", 33) * F.get(F.array(*[F.lit(p).cast("long") for p in parts]), F.col("r")), 31).cast("int")
    fine = ranged.withColumn("f", F.get(F.array(*[F.lit(s) for s in starts[:-1]]), F.col("r")) + part)
    sizes = {x["f"]: (x["b"], x["c"]) for x in fine.groupBy("f").agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("c")).collect()}
    edges = [total * (s + 1) / shards for s in range(shards - 1)]
    shard_of, offset, filled, taken = [], [], 0, [0] * shards
    for f in range(starts[-1]):
        b, c = sizes.get(f, (0, 0))
        s = bisect_right(edges, filled + b / 2)
        shard_of.append(s)
        offset.append(taken[s])
        filled, taken[s] = filled + b, taken[s] + c
    place = Window.partitionBy("f").orderBy("k1", "k2", "id", "size", "text_crc32")
    out = fine.select(
        "id",
        "size",
        "text_crc32",
        F.get(F.array(*[F.lit(s) for s in shard_of]), F.col("f")).alias("shard"),
        (F.get(F.array(*[F.lit(o).cast("long") for o in offset]), F.col("f")) + F.row_number().over(place) - 1).alias("slot"),
    )
    return out.withColumnRenamed("id", id_col) if id_col != "id" else out


def write_shards(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", shards: int = 16) -> None:
    """Writes whole records as Parquet, one folder for each shard, range-partitioned so
    that a shard is written by several tasks. Ids must be unique and not null."""
    placed = assign_shards(docs, id_col=id_col, text_col=text_col, shards=shards).select(col(id_col).alias("tw_id"), "shard", "slot")
    names = [c for c in docs.columns if c not in ("shard", "slot")]
    whole = docs.select(*[col(c) for c in names]).join(placed, col(id_col) == F.col("tw_id")).drop("tw_id")
    whole.repartitionByRange(4 * shards, "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
