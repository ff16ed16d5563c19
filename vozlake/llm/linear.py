"""Hashed text features and a small sparse solver for the linear models.

A model is fitted on a bounded sample of labelled rows (``sample_rows``, a parameter of each operator):
the rows with the smallest hashes of their texts, each text once.  Executors turn texts into
features, one task fits, and only the fitted arrays reach the driver.  Everything else reads all rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vozlake.llm.common import bounded_batches

BUCKETS = 1 << 18
WORD = re.compile(r"[^\W\d_]+")
CACHED = 500_000
STEMS = (4, 5)
_slots: dict[str, tuple[int, ...]] = {}


def number(feature: str) -> int:
    return zlib.crc32(feature.encode("utf-8", "surrogatepass"))


def slots_of(word: str) -> tuple[int, ...]:
    """Numbers (32 bits) of a word and of its stems, its first four and five letters; frequent words are remembered."""
    found = _slots.get(word)
    if found is None:
        if len(_slots) >= CACHED:
            _slots.clear()
        found = _slots[word] = (number(word), *(number(f"{word[:n]}~") for n in STEMS if len(word) > n))
    return found


def word_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the lower-cased words and their stems, and weights: damped counts with norm one."""
    counts: dict[int, int] = {}
    for word, n in Counter(WORD.findall((text or "").lower())).items():
        for slot in slots_of(word):
            counts[slot] = counts.get(slot, 0) + n
    slots, values = np.fromiter(counts, np.int64, len(counts)), np.log1p(np.fromiter(counts.values(), np.float64, len(counts)))
    return slots, values / (np.sqrt(values @ values) or 1.0)


@dataclass
class Rows:
    """Sparse rows: numbers and values one after the other, and where each row starts."""

    slots: np.ndarray
    values: np.ndarray
    starts: np.ndarray

    @classmethod
    def of(cls, rows: Sequence[tuple[np.ndarray, np.ndarray]]) -> Rows:
        starts = np.concatenate([[0], np.cumsum([len(s) for s, _ in rows], dtype=np.int64)])
        slots, values = np.empty(starts[-1], np.uint32), np.empty(starts[-1], np.float32)
        for at, (s, v) in zip(starts, rows, strict=False):
            slots[at : at + len(s)], values[at : at + len(v)] = s, v
        return cls(slots, values, starts)

    def hashed(self) -> Rows:
        """The same rows with numbers folded into buckets."""
        return Rows((self.slots % BUCKETS).astype(np.int32), self.values, self.starts)

    def times(self, weights: np.ndarray) -> np.ndarray:
        sums = np.cumsum(self.values * weights.astype(np.float32)[self.slots], dtype=np.float64)
        sums = np.concatenate([[0.0], sums])
        return sums[self.starts[1:]] - sums[self.starts[:-1]]

    def back(self, each: np.ndarray, size: int) -> np.ndarray:
        return np.bincount(self.slots, self.values * np.repeat(each.astype(np.float32), np.diff(self.starts)), size)


def minimise(loss: Callable[[np.ndarray], tuple[float, np.ndarray]], start: np.ndarray, steps: int = 100, rate: float = 0.3) -> np.ndarray:
    """Full-batch Adam with a rate that falls to zero; deterministic."""
    x, mean, square = start.copy(), np.zeros_like(start), np.zeros_like(start)
    for t in range(1, steps + 1):
        _, gradient = loss(x)
        mean = 0.9 * mean + 0.1 * gradient
        square = 0.99 * square + 0.01 * gradient**2
        step = rate * (1 - (t - 1) / steps)
        x -= step * (mean / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.99**t)) + 1e-8)
    return x


FEATURES = T.StructType([T.StructField("slots", T.ArrayType(T.LongType())), T.StructField("values", T.ArrayType(T.FloatType()))])
Featurise = Callable[[str | None], tuple[np.ndarray, np.ndarray]]
Arrays = dict[str, np.ndarray]


def text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def fit_sample(
    texts: DataFrame, told: DataFrame, featurise: Featurise, sample_rows: int, fit: Callable[[Rows, pd.DataFrame], Arrays], more: Mapping[str, Column] | None = None
) -> Arrays:
    """Call ``fit`` on the features of at most ``sample_rows`` texts and what is told of them.

    ``texts`` has the column text; ``told`` has text_hash and columns about that text, so that only chosen texts
    are shuffled.  ``more`` adds columns that are computed from the chosen texts.  The choice depends on the texts alone, not on the order or the partitions of the rows.  One task on an
    executor holds the sample; only the fitted arrays reach the driver."""

    @F.pandas_udf(FEATURES)
    def features(texts: pd.Series) -> pd.DataFrame:
        made = [featurise(text) for text in texts]
        return pd.DataFrame({"slots": [s for s, _ in made], "values": [v.astype(np.float32) for _, v in made]})

    def fitted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made: list[tuple[np.ndarray, np.ndarray]] = []
        seen = []
        for batch in batches:
            made += [(s.astype(np.uint32), v) for s, v in zip(batch.pop("slots"), batch.pop("values"), strict=True)]
            seen.append(batch)
        if made:
            packed = Rows.of(made)
            made.clear()
            out = fit(packed, pd.concat(seen, ignore_index=True))
            yield pd.DataFrame({"name": list(out), "kind": [a.dtype.str for a in out.values()], "data": [a.tobytes() for a in out.values()]})

    bounded_batches(texts.sparkSession)
    others = [c for c in told.columns if c != "text_hash"]
    # Of what is told of one text, the least stands for all.
    chosen = told.groupBy("text_hash").agg(F.min(F.struct(*others)).alias("o")).orderBy("text_hash").limit(sample_rows)
    once = texts.select("text", text_hash(F.col("text")).alias("text_hash")).join(F.broadcast(chosen), "text_hash").dropDuplicates(["text_hash"])
    extra = [c.alias(name) for name, c in (more or {}).items()]
    sample = once.select("text_hash", F.col("o.*"), *extra, features("text").alias("f")).select("text_hash", *others, *(more or {}), "f.slots", "f.values")
    ordered = sample.repartition(1).sortWithinPartitions("text_hash").drop("text_hash")
    got = {r["name"]: np.frombuffer(r["data"], r["kind"]) for r in ordered.mapInPandas(fitted, "name string, kind string, data binary").collect()}
    return got or fit(Rows.of([]), pd.DataFrame({c: [] for c in (*others, *(more or {}))}))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))
