"""Quality classifier: regularised quadratic discriminant on document statistics.

Each text becomes a short vector of transformed statistics. Training adds up first and
second moments of each class per task, then over tasks; covariances are shrunk towards
the pooled one and towards its diagonal. A score is the logistic of the difference of
the classes' log densities (Mahalanobis distances by cached Cholesky factors) and priors.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import blocks, bounded, extended, remainder, texts
from weftline.llm.tokens import mix, word_hashes

THRESHOLD = 0.3
SHRINK = 0.1

# classes of bytes: other, upper, lower, digit, white space but line ends, line end, sentence marks, symbols, beyond ASCII
_CLASS = np.zeros(256, np.int64)
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58], _CLASS[128:] = 1, 2, 3, 8
_CLASS[[9, 11, 12, 13, 32]], _CLASS[10] = 4, 5
_CLASS[[ord(c) for c in ".,;:?'\"()-"]] = 6
_CLASS[[ord(c) for c in "!#$%&*+/<=>@[\\]^_`{|}~"]] = 7

NAMES = ("words", "word_length", "word_spread", "upper", "digits", "marks", "symbols", "beyond", "lines", "distinct", "repeats", "commonest", "pairs")


def _log(x: np.ndarray, least: float = 1e-3) -> np.ndarray:
    return np.log(x + least)


def features(many: list[str]) -> np.ndarray:
    """A row of transformed statistics for each text; defined for the empty text too."""
    raw = [t.encode("utf-8", "surrogatepass") for t in many]
    size = np.fromiter(map(len, raw), np.int64, len(raw))
    data = np.frombuffer(b"".join(raw), np.uint8)
    doc = np.repeat(np.arange(len(raw)), size)
    by = np.bincount(doc * 9 + _CLASS[data], minlength=9 * len(raw)).reshape(-1, 9).astype(float)
    words, counts = word_hashes(many)
    n = np.maximum(counts, 1)
    solid = by.sum(1) - by[:, 4] - by[:, 5]
    letters = np.maximum(by[:, 1] + by[:, 2] + by[:, 8], 1)
    some = np.maximum(solid, 1)
    distinct, repeats, commonest, pairs = np.zeros((4, len(raw)))
    at = 0
    for i, c in enumerate(counts.tolist()):
        if c:
            own = words[at : at + c]
            _, often = np.unique(own, return_counts=True)
            distinct[i], commonest[i] = len(often), often.max()
            if c > 1:
                repeats[i] = (own[1:] == own[:-1]).sum()
                pairs[i] = len(np.unique(mix(own[:-1]) + own[1:]))
            at += c
    mean = solid / n
    # the spread of word lengths from the ends of words; a text's end is one
    full = ~np.isin(_CLASS[data], (4, 5))
    inner = full[1:] & full[:-1] & (doc[1:] == doc[:-1])  # a byte and the next one are in one word
    starts = np.flatnonzero(full & ~np.concatenate(([False], inner))[: len(full)])
    ends = np.flatnonzero(full & ~np.concatenate((inner, [False]))[: len(full)]) + 1
    owner = doc[starts] if len(starts) else np.empty(0, np.int64)
    squares = np.bincount(owner, weights=(ends - starts).astype(float) ** 2, minlength=len(raw))
    spread = np.sqrt(np.maximum(squares / n - mean**2, 0))
    return np.column_stack((
        np.log1p(counts), np.log1p(mean), np.log1p(spread), _log(by[:, 1] / letters), _log(by[:, 3] / some), _log(by[:, 6] / some), _log(by[:, 7] / some), _log(by[:, 8] / some),
        _log(by[:, 5] / n), np.log1p(distinct) / np.log(n + 2), _log(repeats / n), _log(commonest / n), np.log1p(pairs) / np.log(n + 2),
    ))


class Model(NamedTuple):
    """Per class (0, 1): mean, inverse Cholesky factor of the covariance, log determinant, log prior."""

    means: list[np.ndarray]
    factors: list[np.ndarray]
    logdets: list[float]
    priors: list[float]
    constant: float | None  # the score where one class has no rows

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for rows of statistics."""
        if self.constant is not None:
            return np.full(len(x), self.constant)
        logs = [p - 0.5 * (d + (((x - m) @ f.T) ** 2).sum(1)) for m, f, d, p in zip(self.means, self.factors, self.logdets, self.priors)]
        return 1 / (1 + np.exp(-np.clip(logs[1] - logs[0], -500, 500)))


def build(moments: dict[int, np.ndarray], shrink: float = SHRINK) -> Model:
    """Model from sums over each class: count, sums, and sums of products (row by row)."""
    d = len(NAMES)
    counts = [moments[c][0] if c in moments else 0.0 for c in (0, 1)]
    if min(counts) < 2:
        total = sum(counts)
        return Model([], [], [], [], counts[1] / total if total else 0.5)
    means, scatters = [], []
    for c in (0, 1):
        m = moments[c][1 : 1 + d] / counts[c]
        means.append(m)
        scatters.append(moments[c][1 + d :].reshape(d, d) - counts[c] * np.outer(m, m))
    pooled = sum(scatters) / sum(counts)
    factors, logdets = [], []
    for c in (0, 1):
        cov = (1 - shrink) * scatters[c] / counts[c] + shrink * (0.5 * pooled + 0.5 * np.diag(np.diag(pooled))) + 1e-6 * np.eye(d)
        chol = np.linalg.cholesky(cov)
        factors.append(np.linalg.inv(chol))
        logdets.append(2 * float(np.log(np.diag(chol)).sum()))
    return Model(means, factors, logdets, [float(np.log(c / sum(counts))) for c in counts], None)


def fit(docs: DataFrame, labels: DataFrame, fold: int = 5, held_out: int = 0, shrink: float = SHRINK) -> Model:
    """Model from all labelled rows whose crc32(doc_id) modulo ``fold`` isn't ``held_out``.

    Labels other than 0 and 1 and null labels are left out; a row that is repeated counts as
    often as it stands there, a label that is repeated counts once. Only moments (one row of
    sums per class) reach the driver.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where(F.col("quality").isin(0, 1) & (remainder("doc_id", fold) != held_out)).distinct()
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(remainder("doc_id", fold) != held_out)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            x = features(texts(block))
            yield pa.RecordBatch.from_arrays([block.column(0), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))], ["doc_id", "x"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            if batch.num_rows:
                x = np.array(batch.column(1).to_pylist())
                y = np.array(batch.column(0).to_pylist())
                for c in np.unique(y).tolist():
                    own = x[y == c]
                    part = np.concatenate(([len(own)], own.sum(0), (own.T @ own).ravel()))
                    sums[c] = sums.get(c, 0) + part
        for c, part in sums.items():
            n = len(part)
            yield pa.RecordBatch.from_arrays([pa.array([c] * n, pa.int32()), pa.array(range(n), pa.int32()), pa.array(part)], ["quality", "place", "part"])

    described = bounded(source).mapInArrow(describe, "doc_id long, x array<double>")
    parts = described.join(known, "doc_id").select("quality", "x").mapInArrow(add, "quality int, place int, part double")
    moments: dict[int, np.ndarray] = {}
    d = len(NAMES)
    for quality, place, part in parts.groupBy("quality", "place").agg(F.sum("part")).collect():  # 2 x (1 + d + d * d) rows
        moments.setdefault(quality, np.zeros(1 + d + d * d))[place] = part
    return build(moments, shrink)


def score(df: DataFrame, model: Model, text_col: str = "text", column: str = "score") -> DataFrame:
    """``df`` with the probability of label 1 for each whole text; null is the empty text.

    Other columns are passed on as they are, one named ``column`` is replaced. A narrow map.
    """
    kept = df.drop(column)
    names = kept.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, text_col):
            yield pa.RecordBatch.from_arrays([*block.columns, pa.array(model.score(features(texts(block, text_col))))], [*names, column])

    return bounded(kept).mapInArrow(run, extended(kept, column, "double"))
