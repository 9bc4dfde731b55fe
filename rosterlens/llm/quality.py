"""Quality classifier: ordinal cumulative-link regression on hashed text.

Ratings are graded 0, 1, ...; one weight vector over hashed features is shared by all grades and ordered thresholds cut
its score: P(grade >= k) = sigmoid(score - threshold[k]). A document gets its expected grade and the probability of the
top grades, by which it is selected. Features are the distinct words of the whole text, their first bytes, and how large a
share of it is capitals, symbols, repeated words and so on, so they cover every script and do not depend on length.

The model is fitted on a bounded sample of rated documents (the smallest id hashes: at most ``TRAIN_ROWS`` documents with at most
``TRAIN_FEATURES`` features in all); scoring covers all documents. Reruns on the same rows give the same model.

Edge cases. A null or blank text has no words and grade features of its own; it is rejected unless the ratings say
otherwise. Rows with a null id or grade are not trained on; they are scored like others. Of rows that repeat a rated id one text
(the smallest hash) is trained on. Without ratings nothing can be
told apart and every document is kept. An empty table gives an empty result. Repeated rows get the same score; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rosterlens.llm.wordhash import mix, word_groups
from rosterlens.session import written_table

TRAIN_ROWS = 12_000
TRAIN_FEATURES = 10_000_000
BITS = 18
PREFIXES = (4, 5)  # bytes
BINS = 16


@dataclass
class OrdinalModel:
    weights: np.ndarray  # float32, one per hashed feature
    thresholds: np.ndarray  # ordered, one per grade above the lowest

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ... (one column each)."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - scores[:, None], -50, 50)))


def _share_feature(kind: int, share: np.ndarray) -> np.ndarray:
    """One hashed feature for the bin of a share in [0, 1]; the bins are finer near 0."""
    level = np.minimum(np.sqrt(np.clip(share, 0, 1)) * BINS, BINS - 1).astype(np.uint64)
    return mix(level + np.uint64(1000 * (kind + 1)))


def text_features(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Groups of (first_row, number of features per row, hashed feature indices)."""
    for row, counts, words, *heads in word_groups(texts, PREFIXES):
        raw = texts.slice(row, len(counts)).fill_null("") if texts.null_count else texts.slice(row, len(counts))
        ends_of = np.cumsum(counts)
        out, sizes = [], []
        strings = raw.to_pylist()
        for i, n in enumerate(counts):
            own = slice(ends_of[i] - n, ends_of[i])
            if n == 0:
                found = mix(np.array([1], np.uint64))
            else:
                w = words[own]
                data = np.frombuffer(strings[i].encode(), np.uint8)
                letters = ((data | 32) >= 97) & ((data | 32) <= 122) | (data >= 128)
                upper = (data >= 65) & (data <= 90)
                white = (data == 32) | ((data >= 9) & (data <= 13))
                solid = max(1, len(data) - int(white.sum()))
                distinct = np.unique(w)
                shares = (
                    upper.sum() / max(1, letters.sum()), 1 - letters.sum() / solid, (w[1:] == w[:-1]).mean() if n > 1 else 0.0,
                    len(distinct) / n, min(1.0, solid / n / 32), (data == 10).sum() / n, ((data >= 48) & (data <= 57)).sum() / solid,
                )
                found = np.concatenate([distinct, *(np.unique(h[own]) for h in heads), *(_share_feature(k, np.array([s])) for k, s in enumerate(shares))])
            index = (found >> np.uint64(64 - BITS)).astype(np.int32)
            out.append(index)
            sizes.append(len(index))
        yield row, np.array(sizes), np.concatenate(out)


def _feature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, sizes, index in text_features(batch.column(1)):
            lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), index)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, len(sizes)), lists, batch.column(2).slice(row, len(sizes))], names=["grade", "features", "id"])


def fit_ordinal(
    index: np.ndarray, sizes: np.ndarray, grades: np.ndarray, levels: int,
    least_rows: int = 5, least_errors: float = 3.0, steps: int = 250, ridge: float = 1e-3, rate: float = 0.2,
) -> OrdinalModel:
    """Maximum likelihood with a ridge penalty, by full-batch Adam with falling steps; gaps of the thresholds are kept positive by exp.

    A feature enters with the size of its smoothed log ratio between lower grades and the top grade; those in fewer than
    ``least_rows`` rows, or with a ratio within ``least_errors`` standard errors of 0, are left out.
    """
    n, dim = len(grades), 1 << BITS
    low = np.repeat(grades < levels - 1, sizes)
    df_low, df_top = np.bincount(index[low], minlength=dim), np.bincount(index[~low], minlength=dim)
    n_low = int((grades < levels - 1).sum())
    ratio = np.log((df_low + 1) / (n_low + 2)) - np.log((df_top + 1) / (n - n_low + 2))
    df = df_low + df_top
    scale = np.abs(ratio)
    scale[(df < least_rows) | (scale < least_errors * np.sqrt(1 / (df_low + 1) + 1 / (df_top + 1)))] = 0.0
    features = np.flatnonzero(scale)
    number = np.full(dim, -1, np.int32)
    number[features] = np.arange(len(features), dtype=np.int32)
    column = number[index]
    used = column >= 0
    rows = np.repeat(np.arange(n, dtype=np.int32), sizes)[used].astype(np.intp)
    column = column[used].astype(np.intp)
    value = scale[features][column]
    weights, first, gaps = np.zeros(len(features)), np.array([-1.0]), np.zeros(max(0, levels - 2))
    state = [(np.zeros_like(x), np.zeros_like(x)) for x in (weights, first, gaps)]
    for step in range(1, steps + 1):
        cut = np.concatenate([first, first + np.cumsum(np.exp(gaps))])
        scores = np.bincount(rows, weights[column] * value, n)
        # P(grade = k) = F(cut[k] - score) - F(cut[k - 1] - score), F logistic
        upper = np.concatenate([cut, [np.inf]])[grades]
        lower = np.concatenate([[-np.inf], cut])[grades]
        a, b = 1 / (1 + np.exp(-np.clip(upper - scores, -40, 40))), 1 / (1 + np.exp(-np.clip(lower - scores, -40, 40)))
        a[grades == levels - 1], b[grades == 0] = 1.0, 0.0
        p = np.maximum(a - b, 1e-12)
        da, db = a * (1 - a) / p, b * (1 - b) / p
        by_score = (da - db) / n
        by_cut = np.array([(db[grades == k + 1].sum() - da[grades == k].sum()) / n for k in range(levels - 1)])
        by_weight = np.bincount(column, by_score[rows] * value, len(features)) + ridge * weights
        by_gap = np.array([np.exp(gaps[k]) * by_cut[k + 1 :].sum() for k in range(levels - 2)])
        for x, g, (m, v) in zip((weights, first, gaps), (by_weight, np.array([by_cut.sum()]), by_gap), state):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x -= rate * (1 - step / (steps + 1)) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    hashed = np.zeros(dim, np.float32)
    hashed[features] = weights * scale[features]
    return OrdinalModel(hashed, np.concatenate([first, first + np.cumsum(np.exp(gaps))]))


def train_quality(docs: DataFrame, ratings: DataFrame, grade: Column, doc_id: str = "doc_id", text: str = "text", levels: int = 3,
                  train_rows: int = TRAIN_ROWS, train_features: int = TRAIN_FEATURES) -> OrdinalModel | None:
    """Fit on at most ``train_rows`` rated documents with at most ``train_features`` features; None where there are no ratings."""
    rated = ratings.select(F.col("doc_id").alias("_id"), grade.cast("int").alias("_grade")).where("_id IS NOT NULL AND _grade IS NOT NULL")
    rated = rated.groupBy("_id").agg(F.min("_grade").alias("_grade"))
    sample = rated.orderBy(F.xxhash64("_id"), "_id").limit(train_rows)
    # The sample has at most train_rows narrow rows, so the texts need no shuffle.
    chosen = docs.select(F.col(doc_id).alias("_doc"), F.col(text).alias("_text")).join(F.broadcast(sample), F.col("_doc") == F.col("_id"))
    # One text per id, combined before the shuffle.
    chosen = chosen.groupBy("_id", "_grade").agg(F.min(F.struct(F.xxhash64("_text").alias("h"), "_text")).alias("row")).select("_id", "_grade", "row._text")
    found = chosen.select("_grade", "_text", "_id").mapInArrow(_feature_batches, f"grade int, features array<int>, id {rated.schema['_id'].dataType.simpleString()}")
    found = written_table(found, "features")
    # At most train_rows narrow rows are ordered; the features of those within the bound come to the driver.
    before = F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy(F.xxhash64("id"), "id"))
    within = found.select("id", F.size("features").alias("n")).withColumn("to", before).where(F.col("to") <= train_features).select("id")
    rows = found.join(F.broadcast(within), "id").select("grade", "features").toArrow()
    if rows.num_rows == 0:
        return None
    grades = np.clip(rows["grade"].to_numpy(), 0, levels - 1).astype(np.int64)
    sizes = np.concatenate([chunk.value_lengths().to_numpy() for chunk in rows["features"].chunks])
    index = np.concatenate([chunk.flatten().to_numpy() for chunk in rows["features"].chunks])
    del rows
    return fit_ordinal(index, sizes, grades, levels)


def _score_batches(model: OrdinalModel | None, weights):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "expected_grade", "tail"]
        for batch in batches:
            if model is None:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.nulls(batch.num_rows, pa.float64()), pa.array(np.ones(batch.num_rows))], names=names)
                continue
            fitted = OrdinalModel(weights.value, model.thresholds)
            for row, sizes, index in text_features(batch.column(1)):
                scores = np.add.reduceat(fitted.weights[index].astype(np.float64), np.concatenate([[0], np.cumsum(sizes)[:-1]]))
                tails = fitted.tails(scores)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, len(sizes)), pa.array(tails.sum(axis=1)), pa.array(tails[:, -1].copy())], names=names)

    return run


def score_quality(docs: DataFrame, model: OrdinalModel | None, doc_id: str = "doc_id", text: str = "text", least_tail: float = 0.5) -> DataFrame:
    """doc_id, expected_grade, tail (probability of the top grade) and keep (tail >= least_tail) of every row.

    The weights sent to the executors are 2 ** BITS floats (1 MB), whatever the size of the data.
    """
    weights = docs.sparkSession.sparkContext.broadcast(model.weights) if model else None
    slim = OrdinalModel(np.zeros(0, np.float32), model.thresholds) if model else None
    kind = docs.schema[doc_id].dataType.simpleString()
    scored = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(_score_batches(slim, weights), f"doc_id {kind}, expected_grade double, tail double")
    return scored.withColumn("keep", F.col("tail") >= least_tail)


def keep_good(docs: DataFrame, model: OrdinalModel | None, text: str = "text", least_tail: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose text is kept, columns unchanged; no shuffle."""
    if model is None:
        return docs
    weights = docs.sparkSession.sparkContext.broadcast(model.weights)
    thresholds = model.thresholds
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = OrdinalModel(weights.value, thresholds)
        for batch in batches:
            good = np.zeros(batch.num_rows, bool)
            for row, sizes, index in text_features(batch.column(at)):
                scores = np.add.reduceat(fitted.weights[index].astype(np.float64), np.concatenate([[0], np.cumsum(sizes)[:-1]]))
                good[row : row + len(sizes)] = fitted.tails(scores)[:, -1] >= least_tail
            yield batch.filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema)


def document_grade() -> Column:
    """Grades of the labels table: 0 poor, 1 well written but toxic, 2 good."""
    return F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).when((F.col("quality") == 1) & (F.col("toxic") == 0), 2)
