"""What the corpus operators share: whole-row Arrow mapping, shared-folder tables, hashing.

Every operator takes the names of the columns that it reads and returns its own
columns beside the ones named in ``keep``; other columns of the input are never
touched, so they may have any name. A kept column that has the name of a result
column gives way to the result.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows that a Python worker holds at once; long texts make a row large.
SLICE_ROWS = 256
_BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def col(name: str) -> Column:
    """A column by its literal name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def map_arrow(
    df: DataFrame,
    inputs: Sequence[Column],
    keep: Sequence[str],
    fields: Sequence[tuple[str, T.DataType]],
    make: Callable[[], Callable[..., Sequence[pa.Array]]],
) -> DataFrame:
    """Row-wise Arrow mapping. ``make`` builds the step once in each task; the step
    gets one Arrow array for each of ``inputs`` and returns one for each of
    ``fields``, with as many rows. Narrow: no shuffle, lost tasks are simply rerun.
    """
    small_batches(df.sparkSession)
    names = {n for n, _ in fields}
    kept = [c for c in keep if c not in names]
    kinds = {f.name: f.dataType for f in df.schema.fields}
    n, m = len(kept), len(inputs)
    plain = df.select(*[col(c).alias(f"k{i}") for i, c in enumerate(kept)], *[c.alias(f"i{i}") for i, c in enumerate(inputs)])
    schema = T.StructType([T.StructField(f"k{i}", kinds[c]) for i, c in enumerate(kept)] + [T.StructField(f"r{i}", t) for i, (_, t) in enumerate(fields)])
    labels = [f.name for f in schema.fields]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        step = make()
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE_ROWS):
                b = whole.slice(at, SLICE_ROWS)
                out = step(*[b.column(n + i) for i in range(m)])
                yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(n)], *out], names=labels)

    done = plain.mapInArrow(run, schema)
    return done.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(kept)], *[F.col(f"r{i}").alias(c) for i, (c, _) in enumerate(fields)])


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of ``SLICE_ROWS`` rows in this session, unless its configuration names a size of its own."""
    if not spark.sparkContext.getConf().contains(_BATCH_ROWS):
        spark.conf.set(_BATCH_ROWS, SLICE_ROWS)


def raw(texts: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text, null as empty."""
    return [x or b"" for x in texts.cast(pa.binary()).to_pylist()]


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Only a
    local session without that setting gets a folder of its own."""
    said = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if said:
        return said.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="tidewright-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def _file_system(spark: SparkSession, path: str):
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), there


def materialize(df: DataFrame) -> DataFrame:
    """Writes the rows to the shared folder and reads them back: lineage ends there,
    and a lost executor costs at most a reread. The table goes when the driver ends, or before that by ``release``."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidewright-{uuid.uuid4().hex}"
    plain = df.select(*[col(c).alias(f"c{i}") for i, c in enumerate(df.columns)])
    plain.write.parquet(path)
    fs, there = _file_system(spark, path)
    fs.deleteOnExit(there)
    back = spark.read.schema(plain.schema).parquet(path)
    out = back.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(df.columns)])
    out.tidewright_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Deletes tables of ``materialize`` that nothing reads any more."""
    for df in tables:
        fs, there = _file_system(df.sparkSession, df.tidewright_path)
        fs.delete(there, True)


#: At most so many keys have more than this share of all rows: what a broadcast of hot keys is bounded by.
HOT_KEYS = 4096


def join_keyed(rows: DataFrame, table: DataFrame, keys: list[str], many: str, total: int) -> DataFrame:
    """Inner join of rows with a table that has each key once. ``many`` (a column of the table, which the result
    lacks) is the number of rows with the key, ``total`` of all rows. Keys with over one row in
    ``HOT_KEYS`` are fewer than that by their count, so they are broadcast and their rows stay where they are; only the rest are shuffled."""
    hot = F.col(many) * F.lit(HOT_KEYS) > F.lit(total)
    top = F.broadcast(table.where(hot).drop(many))
    rest = rows.join(F.broadcast(table.where(hot).select(*keys)), keys, "left_anti")
    return rows.join(top, keys).unionByName(rest.join(table.where(~hot).drop(many), keys))


def crc_mod(id_col: str, n: int) -> Column:
    """crc32 of the id as text, mod n; a null id counts as empty text."""
    return F.crc32(F.coalesce(col(id_col).cast("string"), F.lit("")).cast("binary")) % F.lit(n)


def uniform(*cols: Column) -> Column:
    """A number in [0, 1) that depends on the values alone."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11) / F.lit(float(1 << 53))
