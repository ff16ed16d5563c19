"""Which filter removes what, in which order: an audit of filters that are applied one after the other.

Every document has one mark for each filter that it fails.  Documents are only counted: one row for each part
of the corpus and combination of marks, so what is audited has at most 2^filters rows a part, however many
documents there are.  A part's counts are reshaped to a tensor with one axis of length 2 for each filter.  One
einsum selects pass, fail or all along every axis, which gives the counts of all 3^filters selections; each
step of each order reads its numbers there.

1. Marks that a text decides by itself, and a digest of the text, come from one pass over the texts.
2. A repeated text fails "repeated" unless its id is the smallest one with that text.  The smallest ids are
   found by grouping digests, and met again by digest *and* id, so a text with a third of all rows is no hot key.
3. Counts per part and combination; then the tensor.

Words are what ASCII white space separates.  A null text is an empty one; a null part is the empty string.  A
null id is smaller or larger than no other, so its text never counts as repeated and it has no labels.
Repeated rows count each; a repeated id with one text is no repetition of itself.  A document is good (toxic)
if any of its labels says so.  An empty table has no parts, so no rows.  Other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vozlake.llm.common import materialize, only

FEW_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT = 200, 50, 3
REPEATED = "E"
MEASURES = ("n", "good", "toxic")
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
PASS, FAIL, ALL = range(3)


def text_marks(text: Column) -> dict[str, Column]:
    """Filters that a text passes or fails by itself; true is failure."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    count = lambda x: F.size(x).cast("long")
    capitals = F.char_length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long")
    return {
        "A": count(words) < FEW_WORDS,
        "B": 100 * count(F.array_distinct(words)) < DISTINCT_PERCENT * count(words),
        "C": 100 * capitals > CAPITAL_PERCENT * F.char_length(text).cast("long"),
        "D": text.rlike("[#$%&*|]"),
    }


def marked(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """(id, part, marks of each filter, n): equal rows counted."""
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    own = docs.select(F.col(f"`{doc_id}`").alias("id"), F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"), body.alias("body"))
    marks = text_marks(F.col("body"))
    seen = own.select("id", "part", F.unhex(F.sha2("body", 256)).alias("digest"), *[c.alias(k) for k, c in marks.items()])
    counted = materialize(seen.groupBy(*seen.columns).agg(F.count(F.lit(1)).alias("n")), "marked")
    first = counted.groupBy("digest").agg(F.min("id").alias("id")).where("id is not null").withColumn("first", F.lit(True))
    return counted.join(first, ["digest", "id"], "left").withColumn(REPEATED, F.col("id").isNotNull() & F.col("first").isNull()).select("id", "part", *marks, REPEATED, "n")


def contingency(marks: DataFrame, labels: DataFrame, filters: Sequence[str], doc_id: str = "doc_id") -> DataFrame:
    """(part, the filters, n, good, toxic) for each part and combination of marks."""
    said = lambda name: F.max(F.coalesce(F.col(f"`{name}`") == 1, F.lit(False)))
    judged = only(labels, doc_id, "quality", "toxic").where(F.col(f"`{doc_id}`").isNotNull())
    judged = judged.groupBy(F.col(f"`{doc_id}`").alias("id")).agg(said("quality").alias("is_good"), said("toxic").alias("is_toxic"))
    joined = marks.join(judged, "id", "left")
    total = lambda mark: F.sum(F.when(F.col(mark), F.col("n")).otherwise(0))
    return joined.groupBy("part", *filters).agg(F.sum("n").alias("n"), total("is_good").alias("good"), total("is_toxic").alias("toxic"))


def tensor(cells: pd.DataFrame, filters: Sequence[str]) -> np.ndarray:
    """Counts by measure and then by filter, 1 for a failure."""
    out = np.zeros((len(MEASURES), 2 ** len(filters)), np.int64)
    places = cells[list(filters)].to_numpy(bool) @ (1 << np.arange(len(filters))[::-1])
    for row, name in enumerate(MEASURES):
        np.add.at(out[row], places, cells[name].to_numpy(np.int64))
    return out.reshape(len(MEASURES), *[2] * len(filters))


def selections(counts: np.ndarray) -> np.ndarray:
    """Counts for pass, fail or all along every axis, by measure."""
    select = np.array([[1, 0], [0, 1], [1, 1]])  # PASS, FAIL, ALL by the axis's two places
    axes = counts.ndim - 1
    operands = [x for axis in range(axes) for x in (select, [1 + axes + axis, 1 + axis])]
    return np.einsum(counts, [0, *range(1, axes + 1)], *operands, [0, *range(1 + axes, 1 + 2 * axes)], optimize=True)


def steps(cells: pd.DataFrame, filters: Sequence[str]) -> pd.DataFrame:
    """One row for each order of the filters and each of its steps."""
    chosen, n = selections(tensor(cells, filters)), len(filters)

    def pick(**choice: int) -> np.ndarray:
        return chosen[(slice(None), *[choice.get(name, ALL) for name in filters])]

    rows = []
    for order in permutations(filters):
        for step, name in enumerate(order):
            before = dict.fromkeys(order[:step], PASS)
            removed, failing = pick(**before, **{name: FAIL}), pick(**{name: FAIL})[0]
            alone = pick(**(dict.fromkeys(filters, PASS) | {name: FAIL}))[0]
            rows.append(("".join(order), step + 1, name, pick(**before, **{name: PASS})[0], removed[0], failing - removed[0], alone, removed[1], removed[2]))
    out = pd.DataFrame(rows, columns=["filter_order", "step", "filter", *COUNTS[:-1]])
    out["shapley"] = out.groupby("filter")["removed"].transform("sum")
    return out[["filter_order", "step", *COUNTS]] if n else out


def audit(cells: DataFrame, filters: Sequence[str]) -> DataFrame:
    """part, filter_order, step and ``COUNTS`` from a contingency table; a part's rows are at most 2^filters."""
    names = list(filters)

    def of(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        found = steps(rows, names)
        found.insert(0, "part", key[0])
        return found

    return cells.groupBy("part").applyInPandas(of, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS))


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    filters = [*text_marks(F.lit("")), REPEATED]
    return audit(contingency(marked(docs), labels, filters), filters)


SQL = r"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM t),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, (len(words) < 200)::INT + 2 * (100 * len(list_distinct(words)) < 50 * len(words))::INT
                   + 4 * (100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 3 * length(t))::INT
                   + 8 * regexp_matches(t, '[#$%&*|]')::INT
                   + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)::INT AS fails,
             coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
      FROM w LEFT JOIN l USING (doc_id)),
cells AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY ALL),
f AS (SELECT chr(64 + k::INT) AS name FROM range(1, 6) r(k)),
orders AS (SELECT a.name || b.name || c.name || d.name || e.name AS filter_order FROM f a, f b, f c, f d, f e
           WHERE len(list_distinct([a.name, b.name, c.name, d.name, e.name])) = 5),
steps AS (SELECT filter_order, step::INT AS step, (1 << (ascii(filter_order[step]) - 65))::INT AS own,
                 list_sum(list_transform(range(1, step), lambda k: 1 << (ascii(filter_order[k]) - 65)))::INT AS earlier
          FROM orders, range(1, 6) r(step)),
found AS (SELECT part, filter_order, step, own,
                 sum(n) FILTER (fails & (own | coalesce(earlier, 0)) = 0) AS kept,
                 sum(n) FILTER (fails & own > 0 AND fails & coalesce(earlier, 0) = 0) AS removed,
                 sum(n) FILTER (fails & own > 0 AND fails & coalesce(earlier, 0) > 0) AS redundant,
                 sum(n) FILTER (fails = own) AS unique_fails,
                 sum(good) FILTER (fails & own > 0 AND fails & coalesce(earlier, 0) = 0) AS good_lost,
                 sum(toxic) FILTER (fails & own > 0 AND fails & coalesce(earlier, 0) = 0) AS toxic_lost
          FROM cells, steps GROUP BY ALL)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed,
       coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
       coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
       coalesce(sum(removed) OVER (PARTITION BY part, own), 0)::BIGINT AS shapley
FROM found
"""
