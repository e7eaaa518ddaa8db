"""Language identification by rank-order n-gram profiles.

A profile is the list of the most frequent letter n-grams (1 to 3 letters, words
padded with ``_``) of a language; a document's own list is compared with each by the
out-of-place distance: the sum over its n-grams of how far the ranks are apart, and
``profile_size`` for an n-gram that the profile lacks.

Profiles are learned from at most about ``max_docs`` documents of each language: a
fixed share of its rows, chosen by a hash of the id. Counts are combined in
each task before they are shuffled. Prediction reads whole texts, row by row.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import SLICE_ROWS, col, map_arrow, uniform

_LETTERS = re.compile(r"[^\W\d_]+")  # numerals such as ½ besides, which gram_codes takes out
_EDGE = ord("_")
UNKNOWN = "und"


def gram_codes(text: str | None) -> np.ndarray:
    """Every n-gram (1 to 3 letters, repeats included) of the words as one number:
    21 bits for each code point, so shorter n-grams have smaller numbers."""
    words = _LETTERS.findall(text.lower()) if text else []
    if not all(map(str.isalpha, words)):
        words = "".join(c if c.isalpha() else " " for c in " ".join(words)).split()
    if not words:
        return np.zeros(0, dtype=np.int64)
    c = np.frombuffer(f"_{'_'.join(words)}_".encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
    inner = c != _EDGE
    two = (c[:-1] << 21) | c[1:]
    three = (two[:-1] << 21) | c[2:]
    return np.concatenate([c[inner], two, three[inner[1:-1]]])


def decode_gram(code: int) -> str:
    return "".join(chr(x) for x in ((code >> 42) & 0x1FFFFF, (code >> 21) & 0x1FFFFF, code & 0x1FFFFF) if x)


def ranked(codes: np.ndarray, size: int) -> np.ndarray:
    """The most frequent n-grams; ties by their numbers."""
    distinct, counts = np.unique(codes, return_counts=True)
    return distinct[np.argsort(-counts, kind="stable")[:size]]


def learn_profiles(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", profile_size: int = 400, max_docs: int = 2000, max_languages: int = 1000
) -> dict[str, list[int]]:
    """Profile of each non-null language; texts without letters teach nothing. The
    driver holds one count a language and ``profile_size`` n-grams of each; a column with over
    ``max_languages`` values names no languages and is an error."""
    known = docs.where(col(lang_col).isNotNull()).groupBy(col(lang_col).alias("l")).agg(F.count(F.lit(1)).alias("n"))
    sizes = {r["l"]: r["n"] for r in known.limit(max_languages + 1).collect()}
    if not sizes:
        return {}
    if len(sizes) > max_languages:
        raise ValueError(f"{lang_col} has over {max_languages} values")
    share = F.create_map(*chain.from_iterable((F.lit(k), F.lit(min(1.0, max_docs / n))) for k, n in sorted(sizes.items())))
    chosen = docs.where(col(lang_col).isNotNull()).where(uniform(col(id_col)) < share[col(lang_col)]).select(col(lang_col).alias("l"), col(text_col).cast("string").alias("t"))

    def run(batches):
        found = defaultdict(Counter)
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE_ROWS):
                b, parts = whole.slice(at, SLICE_ROWS), defaultdict(list)
                for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    parts[lang].append(gram_codes(text))
                for lang, codes in parts.items():
                    distinct, counts = np.unique(np.concatenate(codes), return_counts=True)
                    found[lang].update(dict(zip(distinct.tolist(), counts.tolist(), strict=True)))
        flat = [(lang, g, n) for lang, c in found.items() for g, n in c.items()]
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in flat], pa.string()), pa.array([x[1] for x in flat], pa.int64()), pa.array([x[2] for x in flat], pa.int64())], names=["l", "g", "n"])

    counted = chosen.mapInArrow(run, "l string, g bigint, n bigint").groupBy("l", "g").agg(F.sum("n").alias("n"))
    top = counted.withColumn("r", F.row_number().over(Window.partitionBy("l").orderBy(F.desc("n"), "g"))).where(F.col("r") <= profile_size)
    out: dict[str, list[int]] = {}
    for r in sorted(top.collect(), key=lambda r: (r["l"], r["r"])):
        out.setdefault(r["l"], []).append(r["g"])
    return out


class Profile:
    """Ranks of a language's n-grams, ready for look-ups of whole lists."""

    def __init__(self, grams: list[int], size: int):
        order = np.argsort(np.array(grams, dtype=np.int64), kind="stable")
        self.grams, self.ranks, self.size = np.array(grams, dtype=np.int64)[order], order, size

    def distance(self, mine: np.ndarray) -> int:
        """Out-of-place distance of a list of at most ``size`` n-grams."""
        at = np.minimum(np.searchsorted(self.grams, mine), len(self.grams) - 1)
        apart = np.abs(self.ranks[at] - np.arange(len(mine)))
        return int(np.where(self.grams[at] == mine, apart, self.size).sum())


def classify(mine: np.ndarray, profiles: dict[str, Profile], size: int) -> tuple[str, float]:
    """The nearest language (ties: first by name), and one less its distance as a
    share of the largest possible one."""
    if not len(mine) or not profiles:
        return UNKNOWN, 0.0
    far, lang = min((p.distance(mine), lang) for lang, p in profiles.items())
    return lang, 1.0 - far / (size * len(mine))


def identify_language(
    docs: DataFrame, profiles: dict[str, list[int]], *, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, profile_size: int = 400
) -> DataFrame:
    """The kept columns (the id by default), lang_pred and score (0 to 1: one less the
    distance as a share of the largest possible one).

    A text that is null or without letters gets ``und`` and score 0; so does every text
    if there are no profiles. Repeated rows get equal results; ties between languages go
    to the first name; an empty table gives no rows.
    """
    ranks = docs.sparkSession.sparkContext.broadcast({k: v for k, v in profiles.items() if v})

    def make():
        known = {k: Profile(v, profile_size) for k, v in ranks.value.items()}

        def step(texts):
            got = [classify(ranked(gram_codes(t), profile_size), known, profile_size) for t in texts.to_pylist()]
            return [pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.float64())]

        return step

    return map_arrow(docs, [col(text_col).cast("string")], keep or [id_col], [("lang_pred", T.StringType()), ("score", T.DoubleType())], make)
