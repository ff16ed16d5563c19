"""Quality by ordinal regression: one set of hashed-text weights, ordered thresholds between grades.

The cumulative-link model says P(grade <= k) = sigmoid(threshold k - weights . features).  All grades
share the weights; thresholds are kept in order by fitting the logarithms of their gaps.  The
expected grade and the probability of a grade from ``tail`` on follow directly.

Features are hashed: words with their stems, shapes of tokens (letters, digits and marks in runs), and
bands of simple measures of the text.  The model is fitted on a bounded sample of rated rows
(``sample_rows``, see ``linear``); every text is scored whole.

Null and empty texts are scored from their bands alone.  With fewer than two grades in the sample every
row gets that grade (or 0).  Rows are scored one by one; repeated rows and other columns don't matter.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vozlake.llm import linear
from vozlake.llm.common import bounded_batches, in_fold
from vozlake.llm.linear import BUCKETS, WORD, Rows, sigmoid

SAMPLE_ROWS = 6_000
SHAPE_LENGTH = 12
RUNS = [(re.compile("[A-Z]+"), "X"), (re.compile("[a-z]+"), "x"), (re.compile("[0-9]+"), "9"), (re.compile(r"[^\W\d_A-Za-z]+"), "é")]
_shapes: dict[str, int] = {}


def shape_number(token: str) -> int:
    found = _shapes.get(token)
    if found is None:
        if len(_shapes) >= linear.CACHED:
            _shapes.clear()
        shape = token[: 4 * SHAPE_LENGTH]
        for run, sign in RUNS:
            shape = run.sub(sign, shape)
        found = _shapes[token] = linear.number("shape " + shape[:SHAPE_LENGTH])
    return found


def bands(text: str, tokens: Counter[str], words: int) -> list[str]:
    """Measures of the whole text, as names of bands."""
    n, lines = max(1, sum(tokens.values())), text.split("\n")
    upper = sum(count for token, count in tokens.items() if token.isupper() and len(token) > 1)
    measures = {
        "length": np.log2(1 + words),
        "shouted": 10 * upper / n,
        "distinct": 10 * len(tokens) / n,
        "unwordly": 10 * (n - min(n, words)) / n,
        "lines": 10 * len(set(lines)) / len(lines),
        "long": 2 * np.log2(1 + len(text) / n),
    }
    return [f"{name} {int(value)}" for name, value in measures.items()]


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Three groups (words, shapes, bands), each of norm one."""
    text = text or ""
    tokens = Counter(text.split())
    shapes: dict[int, int] = {}
    for token, count in tokens.items():
        key = shape_number(token)
        shapes[key] = shapes.get(key, 0) + count
    slots, values = linear.word_features(text)
    shape_values = np.sqrt(np.fromiter(shapes.values(), np.float64, len(shapes)))
    marks = bands(text, tokens, len(WORD.findall(text)))
    return (
        np.concatenate([slots, np.fromiter(shapes, np.int64, len(shapes)), np.array([linear.number(m) for m in marks], np.int64)]),
        np.concatenate([values, shape_values / (np.sqrt(shape_values @ shape_values) or 1.0), np.full(len(marks), len(marks) ** -0.5)]),
    )


@dataclass
class Cumulative:
    """``grades`` in order, one threshold between neighbours."""

    grades: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def above(self, scores: np.ndarray) -> np.ndarray:
        """P(grade > k-th grade), a column for each threshold."""
        return sigmoid(scores[:, None] - self.thresholds[None, :])

    def judge(self, text: str | None, tail: float) -> tuple[float, float]:
        """Expected grade, and probability of a grade of ``tail`` or more."""
        slots, values = features(text)
        above = self.above(np.array([self.weights[slots % BUCKETS] @ values]))[0]
        expected = float(self.grades[0] + np.diff(self.grades) @ above)
        at = int(np.searchsorted(self.grades, tail))
        return expected, 1.0 if at == 0 else 0.0 if at == len(self.grades) else float(above[at - 1])


def train(rows: Rows, ratings: np.ndarray, cost: float = 0.0005) -> Cumulative:
    """Maximum likelihood with a small ridge on the weights."""
    grades, rank = np.unique(ratings, return_inverse=True)
    if len(grades) < 2:
        return Cumulative(grades if len(grades) else np.zeros(1), np.zeros(BUCKETS, np.float32), np.zeros(0))
    cuts, n = len(grades) - 1, len(ratings)
    share = np.cumsum(np.bincount(rank, minlength=cuts + 1))[:-1] / n
    first = np.log(share / (1 - share))
    start = np.concatenate([np.zeros(BUCKETS), first[:1], np.log(np.maximum(np.diff(first), 1e-2))])

    def thresholds(x: np.ndarray) -> np.ndarray:
        return x[BUCKETS] + np.concatenate([[0], np.cumsum(np.exp(x[BUCKETS + 1 :]))])

    def loss(x: np.ndarray) -> tuple[float, np.ndarray]:
        weights, cut = x[:BUCKETS], thresholds(x)
        below = sigmoid(np.concatenate([[-1e9], cut, [1e9]])[None, :] - rows.times(weights)[:, None])
        slope = below * (1 - below)
        each = np.arange(n)
        chance = np.maximum(below[each, rank + 1] - below[each, rank], 1e-12)
        upper, lower = slope[each, rank + 1] / chance, slope[each, rank] / chance
        by_cut = np.zeros(cuts + 2)
        np.add.at(by_cut, rank + 1, -upper / n)
        np.add.at(by_cut, rank, lower / n)
        by_cut = by_cut[1:-1]
        later = np.cumsum(by_cut[::-1])[::-1]
        gaps = later[1:] * np.exp(x[BUCKETS + 1 :])
        gradient = np.concatenate([rows.back((upper - lower) / n, BUCKETS) + cost * weights, [by_cut.sum()], gaps])
        return float(-np.log(chance).mean() + cost / 2 * weights @ weights), gradient

    x = linear.minimise(loss, start)
    return Cumulative(grades.astype(float), x[:BUCKETS].astype(np.float32), thresholds(x))


def fit(texts: DataFrame, told: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Cumulative:
    """``texts``: the documents' texts; ``told``: text_hash and a numeric rating; rows without a rating are left out."""
    rated = told.select("text_hash", F.col("rating").cast("double").alias("rating")).where(F.col("rating").isNotNull() & ~F.isnan("rating"))

    def learn(sample: Rows, other: pd.DataFrame) -> linear.Arrays:
        model = train(sample.hashed(), other["rating"].to_numpy(float))
        return {"grades": model.grades, "weights": model.weights, "thresholds": model.thresholds}

    return Cumulative(**linear.fit_sample(texts, rated, features, sample_rows, learn))


def judge(df: DataFrame, model: Cumulative, tail: float, text: str = "text", out: str = "quality") -> DataFrame:
    """Add a struct (expected, tail) for each whole text."""
    bounded_batches(df.sparkSession)
    shipped = df.sparkSession.sparkContext.broadcast(model)  # one megabyte of weights, whatever the input

    @F.pandas_udf(T.StructType([T.StructField("expected", T.DoubleType()), T.StructField("tail", T.DoubleType())]))
    def judged(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([shipped.value.judge(x, tail) for x in texts], columns=["expected", "tail"], dtype="float64")

    return df.withColumn(out, judged(F.col(f"`{text}`")))


def ratings(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Text hash and grade of the training documents: 0 poor, 1 fair but toxic, 2 fair.  Of several labels the worst counts."""
    grade = F.when(F.col("quality") == 0, 0).when((F.col("quality") == 1) & (F.col("toxic") == 1), 1).when(F.col("quality") == 1, 2)
    told = labels.select(F.col("doc_id").alias("id"), grade.alias("rating")).where("rating is not null").groupBy("id").agg(F.min("rating").alias("rating"))
    own = docs.where(~in_fold(F.col("doc_id"), 5, 0) & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("id"), linear.text_hash(F.col("text")).alias("text_hash"))
    return own.join(told, "id").select("text_hash", "rating")


def digest(docs: DataFrame, labels: DataFrame, tail: float = 1, at_least: float = 0.5) -> DataFrame:
    """Each document with its expected grade, P(grade >= tail), and whether it is selected by that."""
    model = fit(docs.select("text"), ratings(docs, labels))
    rows = judge(docs.select("doc_id", F.col("text").alias("body")), model, tail, "body", "q")
    return rows.select(
        "doc_id",
        in_fold(F.col("doc_id"), 5, 0).alias("held_out"),
        F.col("q.expected").alias("expected_grade"),
        F.col("q.tail").alias("tail_probability"),
        (F.col("q.tail") >= at_least).alias("selected"),
    )
