"""Quality classifier: regularised quadratic discriminant over document statistics.

Each text is reduced to transformed statistics (logs of lengths, square roots of
shares). For each class k the mean and covariance of the labelled rows are found from
sums that tasks combine before they are shuffled. The covariance is shrunk twice:
towards the pooled one (``pool``) and towards its own mean variance (``ridge``).
A score is the logistic of the difference of log densities, from Mahalanobis
distances over Cholesky factors that are computed once and cached in each task.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import col, map_arrow, materialize, raw

#: Characters whose shares are statistics.
_UPPER = bytes(range(65, 91))
_DIGITS = b"0123456789"
_SYMBOLS = b"#*$%&|<>~^=+_{}[]\\/@"
_STOPS = b".!?"
_PAUSES = b",;:"
FEATURES = ("log_words", "word_length", "symbols", "bang", "upper", "digits", "pauses", "sentence_words", "distinct_words", "repeated_lines", "top_word", "repeated_pairs", "line_words", "closed_lines")


def statistics(text: bytes) -> list[float]:
    """The transformed statistics of a whole text; zeros where there are no words."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    chars = len(text) - n + 1
    share = lambda drop: (len(text) - len(text.translate(None, drop))) / chars
    lines = [x for x in text.split(b"\n") if x.strip()]
    ends = len(text) - len(text.translate(None, _STOPS))
    counts = Counter(words)
    pairs = len(set(zip(words, words[1:], strict=False)))
    return [
        float(np.log1p(n)),
        float(np.log1p(sum(map(len, words)) / n)),
        share(_SYMBOLS) ** 0.5,
        share(b"!") ** 0.5,
        share(_UPPER) ** 0.5,
        share(_DIGITS) ** 0.5,
        share(_PAUSES) ** 0.5,
        float(np.log1p(n / (ends + 1))),
        float(np.log(len(counts) / n) / (1 + np.log(n))),
        (1 - len(set(lines)) / len(lines)) ** 0.5,
        (max(counts.values()) / n) ** 0.5,
        (1 - pairs / max(1, n - 1)) ** 0.5 if n > 1 else 0.0,
        float(np.log1p(n / len(lines))),
        (sum(x.rstrip()[-1:] in (b".", b"!", b"?") for x in lines) / len(lines)) ** 0.5,
    ]


def features(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The kept columns and ``features``, an array of doubles in the order of FEATURES."""

    def make():
        def step(texts):
            flat = np.array([statistics(t) for t in raw(texts)], dtype=np.float64).reshape(-1)
            return [pa.ListArray.from_arrays(np.arange(0, len(flat) + 1, len(FEATURES), dtype=np.int32), pa.array(flat))]

        return step

    return map_arrow(docs, [col(text_col).cast("string")], keep or [id_col], [("features", T.ArrayType(T.DoubleType()))], make)


@dataclass(frozen=True)
class Discriminant:
    """Means, Cholesky factors of the shrunk covariances and log terms of two classes."""

    means: tuple[np.ndarray, np.ndarray]
    factors: tuple[np.ndarray, np.ndarray]
    offsets: tuple[float, float]

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 for each row."""
        log = []
        for mean, factor, offset in zip(self.means, self.factors, self.offsets, strict=True):
            z = np.linalg.solve(factor, (x - mean).T)
            log.append(offset - 0.5 * (z * z).sum(axis=0))
        return 1.0 / (1.0 + np.exp(np.clip(log[0] - log[1], -700, 700)))


def fit_discriminant(labelled: DataFrame, *, label_col: str = "label", pool: float = 0.1, ridge: float = 0.02) -> Discriminant | None:
    """labelled: features and a 0/1 label; rows with other labels teach nothing. None
    if a class has fewer than two rows. Sums cover all rows; the driver gets two
    classes of d * d + d + 1 sums."""
    d = len(FEATURES)

    def run(batches):
        sums = {}
        for b in batches:
            y = np.array(b.column(0).to_pylist(), dtype=np.int64)
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            for k in np.unique(y):
                own = x[y == k]
                sums[k] = sums.get(k, 0) + np.concatenate([[len(own)], own.sum(0), (own.T @ own).reshape(-1)])
        keys = [int(k) for k in sums for _ in range(1 + d + d * d)]
        at = [i for _ in sums for i in range(1 + d + d * d)]
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(at, pa.int64()), pa.array(np.concatenate(list(sums.values())) if sums else np.zeros(0), pa.float64())], names=["k", "i", "v"])

    rows = labelled.where(col(label_col).isin(0, 1)).select(col(label_col).cast("bigint").alias("y"), "features")
    got = rows.mapInArrow(run, "k bigint, i bigint, v double").groupBy("k", "i").agg(F.sum("v").alias("v")).collect()
    sums = np.zeros((2, 1 + d + d * d))
    for r in got:
        sums[r["k"], r["i"]] = r["v"]
    counts = sums[:, 0]
    if counts.min() < 2:
        return None
    means = [sums[k, 1 : 1 + d] / counts[k] for k in (0, 1)]
    own = [sums[k, 1 + d :].reshape(d, d) / counts[k] - np.outer(means[k], means[k]) for k in (0, 1)]
    pooled = sum(counts[k] * own[k] for k in (0, 1)) / counts.sum()
    factors, offsets = [], []
    for k in (0, 1):
        s = (1 - pool) * own[k] + pool * pooled
        s = (1 - ridge) * s + ridge * max(np.trace(s) / d, 1e-9) * np.eye(d)
        factor = np.linalg.cholesky(s)
        factors.append(factor)
        offsets.append(float(np.log(counts[k] / counts.sum()) - np.log(np.diag(factor)).sum()))
    return Discriminant(tuple(means), tuple(factors), tuple(offsets))


def score_features(rows: DataFrame, model: Discriminant | None, *, keep: list[str], threshold: float = 0.7) -> DataFrame:
    """The kept columns, score and predicted (1 from the threshold up). Without a model
    every score is 0.5."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def make():
        known = shared.value

        def step(x):
            flat = x.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
            got = np.full(len(flat), 0.5) if known is None else known.scores(flat)
            return [pa.array(got, pa.float64()), pa.array((got >= threshold).astype(np.int32))]

        return step

    return map_arrow(rows, [col("features")], keep, [("score", T.DoubleType()), ("predicted", T.IntegerType())], make)


def classify_quality(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_id_col: str = "doc_id", label_col: str = "quality", keep: list[str] | None = None, train=None, pool: float = 0.1, ridge: float = 0.02, threshold: float = 0.7
) -> DataFrame:
    """Fits on the labelled rows (those of ``labels`` for which ``train``, a condition on
    the label's id, holds) and scores every document. Statistics are computed once.

    Empty and null texts are scored by their zero statistics. Null labels and labels
    other than 0 and 1 teach nothing; a label given several times counts as often; a null
    id has no label. With fewer than two rows of a class every score is 0.5. Repeated rows
    get equal scores; an empty table gives no rows.
    """
    kept = list(keep or [id_col])
    seen = materialize(features(docs, id_col=id_col, text_col=text_col, keep=list(dict.fromkeys([*kept, id_col]))))
    marks = labels.where(col(label_col).isin(0, 1))
    if train is not None:
        marks = marks.where(train)
    marks = marks.select(col(label_id_col).alias("tw_id"), col(label_col).alias("label"))
    model = fit_discriminant(seen.select(col(id_col).alias("id"), "features").join(marks, F.col("id") == F.col("tw_id")).select("label", "features"), pool=pool, ridge=ridge)
    return score_features(seen, model, keep=kept, threshold=threshold)
