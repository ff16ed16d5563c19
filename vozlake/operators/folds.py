"""Greedy segmentations that walk through a sequence with a little state.

The sequence is first cut where the walk must restart whatever came before, so
that one long recording spreads over many tasks.  Each run is then read as a
sorted stream: a task holds the state of one run and one Arrow batch, never a
whole run.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def walk(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    inputs: Sequence[str],
    step: Callable[[tuple | None, tuple], tuple[tuple, object]],
    out: str,
    kind: T.DataType = T.BooleanType(),
) -> DataFrame:
    """Add the column ``out`` that ``step(state, values) -> (state, value)`` gives for each row.

    ``state`` is None at the first row of a run (a combination of ``keys``).
    """
    schema = T.StructType([*df.schema.fields, T.StructField(out, kind)])
    keys, inputs = list(keys), list(inputs)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, None
        for batch in batches:
            values_out = []
            for key, values in zip(zip(*[batch[k] for k in keys]), zip(*[batch[c] for c in inputs])):
                if key != current:
                    current, state = key, None
                state, value = step(state, values)
                values_out.append(value)
            yield batch.assign(**{out: values_out})

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


class Rule(Protocol):
    """Where a greedy segmentation cuts, for many rows at once.

    Columns come as arrays with the rows of a run in order.  What a segment remembers of its beginning is a
    tuple of numbers, each an array with one entry for a run.
    """

    columns: Sequence[str]

    def hits(self, columns: dict[str, np.ndarray], rows: np.ndarray, begun: tuple[np.ndarray, ...]) -> np.ndarray:
        """Whether each of ``rows`` cuts, if its segment began like that."""

    def fresh(self, columns: dict[str, np.ndarray], rows: np.ndarray) -> tuple[np.ndarray, ...]:
        """How the segment begins that follows a cut at each of ``rows``."""

    def opens(self, columns: dict[str, np.ndarray], rows: np.ndarray) -> tuple[tuple[np.ndarray, ...], bool]:
        """For the first rows of runs: how the first segment begins, and whether these rows cut."""


#: Rows of each run that are looked at together.
AHEAD = 16


def cuts(columns: dict[str, np.ndarray], ends: np.ndarray, rule: Rule, begun: tuple[np.ndarray, ...], place: np.ndarray) -> np.ndarray:
    """Mark the rows that cut, in all runs side by side: each looks for its next cut from ``place`` up to its end.

    ``begun`` and ``place`` move along with the runs."""
    marked = np.zeros(len(columns[rule.columns[0]]), bool)
    active = np.flatnonzero(place < ends)
    while len(active):
        rows = place[active, None] + np.arange(AHEAD)
        inside = rows < ends[active, None]
        hit = inside & rule.hits(columns, np.minimum(rows, ends[active, None] - 1), tuple(b[active, None] for b in begun))
        found, first = hit.any(axis=1), hit.argmax(axis=1)
        place[active] += np.where(found, first + 1, AHEAD)
        done = active[found]
        marked[place[done] - 1] = True
        for b, value in zip(begun, rule.fresh(columns, place[done] - 1), strict=True):
            b[done] = value
        active = active[place[active] < ends[active]]
    return marked


def segment(df: DataFrame, keys: Sequence[str], order: Sequence[str], rule: Rule, out: str, placed: bool = False) -> DataFrame:
    """Add the boolean column ``out``: the rows at which the greedy ``rule`` cuts each run (a combination of ``keys``).

    Runs are read as a sorted stream.  A task holds one Arrow batch and, for a run that goes on, how its
    segment began; so a run may be of any length.  ``placed`` says that a window over some of the keys made ``df``,
    so that no run lies in two partitions.
    """
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.BooleanType())])
    keys = list(keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, ()
        for batch in batches:
            if not len(batch):
                continue
            columns = {c: batch[c].to_numpy() for c in rule.columns}
            new = np.zeros(len(batch), bool)
            for k in keys:
                values = batch[k]
                new |= ~(values.eq(values.shift()) | (values.isna() & values.shift().isna())).to_numpy()
            new[0] = True
            starts = np.flatnonzero(new)
            begun, opens = rule.opens(columns, starts)
            begun, place = tuple(np.array(b, float) for b in begun), starts + opens
            marked = np.zeros(len(batch), bool)
            marked[starts] = opens
            if tuple(batch[keys].iloc[0]) == key:
                place[0], marked[0] = 0, False
                for b, value in zip(begun, state, strict=True):
                    b[0] = value
            marked |= cuts(columns, np.r_[starts[1:], len(batch)], rule, begun, place)
            key, state = tuple(batch[keys].iloc[-1]), tuple(b[-1] for b in begun)
            yield batch.assign(**{out: marked})

    rows = df if placed else df.repartition(*keys)
    return rows.sortWithinPartitions(*keys, *order).mapInPandas(run, schema)
