"""Word error rate and word alignment."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vozlake.functions.text import normalize_for_wer, unicode_words

# Pairs with at most this many words are compared as strings of one character
# per word; longer pairs go through the vectorised function below.
SHORT_PAIR = 512
OPS_TYPE = T.StructType([T.StructField(name, T.ArrayType(T.StringType())) for name in ("op", "ref", "hyp")])


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, even when ``body`` uses it inside lambdas."""
    return F.get(F.transform(F.array(value), body), 0)


def _codes(words: Column, vocabulary: Column) -> Column:
    """One private character per word."""
    char = lambda w: F.decode(F.unhex(F.lpad(F.hex(F.array_position(vocabulary, w) + 256), 4, "0")), "UTF-16BE")
    return F.array_join(F.transform(words, char), "")


def _row_distances(prev: np.ndarray, cost: np.ndarray, first: int) -> np.ndarray:
    """Next row of the edit-distance table."""
    m = cost.size
    best = np.empty(m + 1, dtype=np.int64)
    best[0] = first
    best[1:] = np.minimum(prev[1:] + 1, prev[:-1] + cost)
    steps = np.arange(m + 1)
    return np.minimum.accumulate(best - steps) + steps


def _encode(ref: list[str], hyp: list[str]) -> tuple[np.ndarray, np.ndarray]:
    ids: dict[str, int] = {}
    r = np.fromiter((ids.setdefault(w, len(ids)) for w in ref), dtype=np.int64, count=len(ref))
    h = np.fromiter((ids.setdefault(w, len(ids)) for w in hyp), dtype=np.int64, count=len(hyp))
    return r, h


def word_distance(ref: list[str], hyp: list[str]) -> int:
    """Edit distance between two word lists, one vector operation per reference word."""
    r, h = _encode(ref, hyp)
    row = np.arange(h.size + 1)
    for i, w in enumerate(r):
        row = _row_distances(row, (h != w).astype(np.int64), i + 1)
    return int(row[-1])


# Moves of a trace, in the order in which ties are settled.
OPERATIONS = np.array(["ok", "sub", "del", "ins"], dtype=object)
#: Reference words and hypothesis words that each move takes.
TAKES_REF, TAKES_HYP = np.array([1, 1, 1, 0]), np.array([1, 1, 0, 1])


def _moves(above: np.ndarray, row: np.ndarray, same: np.ndarray) -> np.ndarray:
    """The preferred move into every cell of ``row``, as a number of ``OPERATIONS``."""
    rise = row[1:] - above[:-1]
    move = np.full(row.size, 3, dtype=np.uint8)
    move[row == above + 1] = 2
    inner = move[1:]
    inner[rise == 1] = 1
    inner[same & (rise == 0)] = 0
    return move


def _trace(r: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Moves from the first to the last word.

    One row of distances is kept for each stretch of about ``sqrt`` rows; moves are worked out for
    one stretch at a time, from the last to the first, so memory stays near ``sqrt(ref) * hyp``.
    """
    stretch = max(1, int(np.sqrt(r.size)))
    anchors = [np.arange(h.size + 1)]
    row = anchors[0]
    for i, word in enumerate(r, 1):
        row = _row_distances(row, (h != word).astype(np.int64), i)
        if i % stretch == 0:
            anchors.append(row)
    parts, j = [], h.size
    for start in range((r.size - 1) // stretch * stretch, -1, -stretch) if r.size else ():
        rows = [anchors[start // stretch]]
        moves = []
        for i in range(start, min(start + stretch, r.size)):
            rows.append(_row_distances(rows[-1], (h != r[i]).astype(np.int64), i + 1))
            moves.append(_moves(rows[-2], rows[-1], h == r[i]))
        own = []
        i = len(moves)
        while i:
            own.append(moves[i - 1][j])
            i, j = i - TAKES_REF[own[-1]], j - TAKES_HYP[own[-1]]
        parts.append(np.array(own[::-1], dtype=np.uint8))
    # What is left of the hypothesis comes before the first reference word.
    parts.append(np.full(j, 3, dtype=np.uint8))
    return np.concatenate(parts[::-1])


def word_operations(ref: list[str], hyp: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Operation, reference word and hypothesis word of each step, in three arrays; absent words are None."""
    moves = _trace(*_encode(ref, hyp))
    columns = []
    for words, takes in ((ref, TAKES_REF), (hyp, TAKES_HYP)):
        used = takes[moves] == 1
        column = np.full(moves.size, None, dtype=object)
        column[used] = words
        columns.append(column)
    return OPERATIONS[moves], *columns


@F.pandas_udf(T.IntegerType())
def _long_distance(ref: pd.Series, hyp: pd.Series) -> pd.Series:
    pairs = [None if a is None or b is None else word_distance(list(a), list(b)) for a, b in zip(ref, hyp)]
    return pd.Series(pairs, dtype="Int32")


@F.pandas_udf(OPS_TYPE)
def _operations(ref: pd.Series, hyp: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([word_operations(list(a), list(b)) for a, b in zip(ref, hyp)], columns=["op", "ref", "hyp"])


def edit_distance(ref: Column, hyp: Column) -> Column:
    """Word edit distance between two token arrays."""

    def quick(pair: Column) -> Column:
        vocabulary = F.array_distinct(F.concat(pair["r"], pair["h"]))
        return let(vocabulary, lambda v: F.levenshtein(_codes(pair["r"], v), _codes(pair["h"], v)))

    short = F.size(ref) + F.size(hyp) <= SHORT_PAIR
    near = let(F.when(short, F.struct(ref.alias("r"), hyp.alias("h"))), lambda p: F.when(p.isNotNull(), quick(p)))
    return F.coalesce(near, _long_distance(F.when(~short, ref), F.when(~short, hyp)))


def wer_tokens(text: Column) -> Column:
    return F.filter(F.split(normalize_for_wer(text), " "), lambda w: w != "")


def rate(ref: Column, hyp: Column) -> Column:
    """Edit distance over reference words of two token arrays; may exceed 1.

    An empty reference scores 0 against an empty hypothesis and 1 otherwise.
    """
    empty_ref = F.when(F.size(hyp) == 0, 0.0).otherwise(1.0)
    return F.when(F.size(ref) == 0, empty_ref).otherwise(edit_distance(ref, hyp) / F.size(ref))


def alignment(ref_text: Column, hyp_text: Column) -> Column:
    """Array of (op, ref, hyp) over lower-case words."""
    return let(_operations(unicode_words(F.lower(ref_text)), unicode_words(F.lower(hyp_text))), lambda o: F.arrays_zip(o["op"], o["ref"], o["hyp"]))

