"""Labelling chunks: a pluggable labeler behind a cache table.

The default labeler is the keyword one. A model is a callable from a list of texts to a raw
response, called in batches inside ``mapInPandas`` on the executors.
"""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import cache_key, keyword_labels

BATCH_SIZE = 6
ATTEMPTS = 3
RATIONALE_CHARS = 300
PREDICTION = "chunk_id string, labels array<string>, model string, taxonomy_version string, rationale string"


def keyword_predictions(chunks: DataFrame, taxonomy, *, text_col: str = "text", id_col: str = "chunk_id") -> DataFrame:
    """The keyword labeler's prediction of each chunk."""
    return chunks.select(
        F.col(id_col).alias("chunk_id"), keyword_labels(F.col(text_col), taxonomy).alias("labels"), F.lit("keywords").alias("model"), F.lit(taxonomy.version).alias("taxonomy_version"), F.lit("").alias("rationale")
    )


def system_prompt(taxonomy) -> str:
    """Instructions for a model labeler: every theme with its bounds and first examples, the rule
    to abstain, and the answer's form."""
    out = ["Label each numbered paragraph of an annual filing with the themes below.", ""]
    for t in taxonomy.themes:
        out.append(f"[{t.id}] {t.name}: {t.definition.strip()}")
        out += [f"  include: {x}" for x in t.includes] + [f"  exclude: {x}" for x in t.excludes]
        out += [f"  yes: {x}" for x in t.positive[:1]] + [f"  no: {x}" for x in t.negative[:1]]
    out += [
        "",
        "A paragraph may have several themes; most have none, and an empty list is then the right answer. "
        "A keyword alone is no reason for a theme. Use the ids in brackets only.",
        'Answer with a JSON array alone, an object a paragraph: {"index": number, "labels": [ids], "rationale": "a few words"}.',
    ]
    return "\n".join(out)


def parse_response(rows: DataFrame, *, raw_col: str = "raw", size_col: str = "n", keys: list[str]) -> DataFrame:
    """keys, index, labels, rationale for each index below the batch size. The outermost
    brackets hold the answer; none is an error. An object without an index has that of its
    place; of several the last counts; missing indices have no labels, others are ignored."""
    held = F.regexp_extract(raw_col, r"(?s)\[.*\]", 0)
    checked = F.when(held == "", F.raise_error(F.lit("no JSON array in the response")).cast("string")).otherwise(held)
    parsed = F.from_json(checked, "array<struct<index:int,labels:array<string>,rationale:string>>")
    base = rows.select(*keys, F.col(size_col).alias("n"), parsed.alias("p"))
    objects = F.transform("p", lambda x, i: F.struct(F.coalesce(x["index"], i).alias("index"), x["labels"].alias("labels"), x["rationale"].alias("rationale")))
    wanted = base.withColumn("o", objects).select(*keys, "o", F.explode(F.when(F.col("n") > 0, F.sequence(F.lit(0), F.col("n") - 1)).otherwise(F.array().cast("array<int>"))).alias("index"))
    last = F.element_at(F.filter("o", lambda x: x["index"] == F.col("index")), -1)
    found = F.when(F.size(F.filter("o", lambda x: x["index"] == F.col("index"))) > 0, last)
    none = F.array().cast("array<string>")
    return wanted.select(*keys, "index", F.coalesce(found["labels"], none).alias("labels"), F.coalesce(found["rationale"], F.lit("")).alias("rationale"))


def _answers(raw: str, n: int) -> list[tuple[list[str], str]]:
    """The same reading for one response on an executor."""
    held = re.search(r"\[.*\]", raw, re.DOTALL)
    if not held:
        raise ValueError("no JSON array in the response")
    by_index = {x.get("index", i): x for i, x in enumerate(json.loads(held[0]))}
    return [((by_index.get(i) or {}).get("labels") or [], (by_index.get(i) or {}).get("rationale") or "") for i in range(n)]


def _call(model: Callable[[list[str]], str], texts: list[str]) -> list[tuple[list[str], str]]:
    for attempt in range(ATTEMPTS):
        try:
            return _answers(model(texts), len(texts))
        except Exception:
            if attempt == ATTEMPTS - 1:
                raise
            time.sleep(2**attempt)
    raise AssertionError


def classify(chunks: DataFrame, taxonomy, model: Callable[[list[str]], str], *, model_name: str, cache: DataFrame | None = None, batch_size: int = BATCH_SIZE, limit: int = 0, order_col: str = "chunk_id") -> tuple[DataFrame, DataFrame]:
    """(predictions, new cache rows). cache: key, labels, rationale; rows without labels count as
    misses. Misses are sent in batches; labels are validated on either way. A limit takes the first
    chunks in order before anything is sent. Either frame asks the model when it is computed: append the second
    to the cache table, then call again with that table, as ``jobs.classify`` does."""
    todo = chunks.orderBy(order_col).limit(limit) if limit else chunks
    keyed = todo.select("chunk_id", "text", cache_key(F.col("text"), taxonomy.version, model_name).alias("key"))
    known = (cache if cache is not None else chunks.sparkSession.createDataFrame([], "key string, labels array<string>, rationale string")).where("labels IS NOT NULL")
    known = known.groupBy("key").agg(F.min(F.struct("labels", "rationale")).alias("c"))
    hits = keyed.join(known, "key").select("chunk_id", "key", F.col("c.labels").alias("labels"), F.col("c.rationale").alias("rationale"))
    misses = keyed.join(known, "key", "left_anti")

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for at in range(0, len(f), batch_size):
                part = f.iloc[at : at + batch_size]
                got = _call(model, part["text"].tolist())
                yield pd.DataFrame({"chunk_id": part["chunk_id"].tolist(), "key": part["key"].tolist(), "labels": [x[0] for x in got], "rationale": [x[1][:RATIONALE_CHARS] for x in got]})

    fresh = misses.mapInPandas(ask, "chunk_id string, key string, labels array<string>, rationale string")
    valid = taxonomy.valid_labels(F.col("labels")).alias("labels")
    both = hits.unionByName(fresh).select("chunk_id", valid, F.lit(model_name).alias("model"), F.lit(taxonomy.version).alias("taxonomy_version"), F.coalesce("rationale", F.lit("")).alias("rationale"))
    return both, fresh.select("key", valid, "rationale").dropDuplicates(["key"])


def disagreements(chunks: DataFrame, predictions: DataFrame, taxonomy) -> DataFrame:
    """chunk_id, keyword_labels, labels where the sets differ."""
    both = chunks.select("chunk_id", keyword_labels(F.col("text"), taxonomy).alias("keyword_labels")).join(predictions.select("chunk_id", "labels"), "chunk_id")
    return both.where(F.array_sort("keyword_labels") != F.array_sort(F.array_distinct("labels")))


def one_prediction(predictions: DataFrame) -> DataFrame:
    """chunk_id, labels: one row a chunk. Of several predictions the last by ``pos`` wins, if there is such a column;
    without it equal ones are one and different ones fail the job."""
    by = predictions.groupBy("chunk_id")
    if "pos" in predictions.columns:
        return by.agg(F.max_by("labels", "pos").alias("labels"))
    found = by.agg(F.min("labels").alias("labels"), F.max("labels").alias("other"))
    clash = F.raise_error(F.concat(F.lit("different predictions for chunk "), F.col("chunk_id").cast("string"))).cast("array<string>")
    return found.select("chunk_id", F.when(F.col("labels") == F.col("other"), F.col("labels")).when(F.col("labels").isNull(), F.col("labels")).otherwise(clash).alias("labels"))
