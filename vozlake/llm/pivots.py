"""Exact top-k search by inner product with a pivot table.

Distances from every vector to many pivots are computed once.  By the triangle inequality
|d(q, p) - d(c, p)| is a lower bound of d(q, c) for any pivot p, and the largest of them bounds the score
from above, because the score is (|q|^2 + |c|^2 - d(q, c)^2) / 2.  Candidates with the highest bounds are
evaluated first; the k-th best score then is a floor, and only candidates whose bound reaches it can matter.

1. Pivots are chosen from a bounded sample, each far from the others.
2. A vector belongs to the cell of its nearest pivot; large cells are cut into shards by a hash.
3. Each query is answered in its own shard first.  The k-th score there is its floor.
4. A query then visits the shards of those cells whose bound reaches its floor, in blocks of queries
   against shards of candidates, both of bounded size; a shard is sent to the blocks that visit it.
   Bounds and scores of a block are matrices.  Pivots are used in groups, as long as a group still eliminates.
5. The best of all visits are ranked.

Only pivots, and one line of ranges per cell, reach the driver.  Where vectors have no structure (random
directions) pivots eliminate next to nothing, and the work is that of comparing all queries with all rows.

Rows with a null id, and vectors that are null or hold a null or a non-finite component, take no part.
Every other row is a candidate for every other row: repeated rows and ids count each, and a repeated query row
has an answer for each repetition.  Missing components of a shorter vector are 0.  Components are
floor(scale * x); scores are exact, and an error is raised where a component or a score doesn't fit 64 bits.
Equal scores go to the smaller id.  Other columns don't matter; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vozlake.llm.common import bounded_batches, materialize

PIVOTS, SAMPLED = 64, 1024
#: Pivots used at a time, and the share of candidates that a group has to eliminate for the next to be used.
GROUP, WORTH = 16, 0.05
SHARD_ROWS, QUERY_BLOCK = 8192, 8192
#: Queries whose bounds and scores are worked out together.
TOGETHER = 64
#: Share of lengths by which a difference of distances, in single precision, may be wrong.
SLACK = 1e-6


def quantised(embedding: Column, scale: int) -> Column:
    def whole(x: Column) -> Column:
        y = F.lit(float(scale)) * x.cast("double")
        return F.when(F.abs(y) < float(1 << 62), F.floor(y)).otherwise(F.raise_error(F.lit("a component doesn't fit 64 bits")).cast("long"))

    return F.transform(embedding, whole)


def vectors_of(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = 64) -> DataFrame:
    """(id, row, v) of the vectors that take part; ``row`` tells rows of one id apart."""
    own = df.select(F.col(f"`{vec_id}`").cast("long").alias("id"), F.col(f"`{embedding}`").alias("e"))
    finite = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    counted = own.where(F.col("id").isNotNull() & F.col("e").isNotNull() & finite).select("id", quantised(F.col("e"), scale).alias("v")).groupBy("id", "v").agg(F.count(F.lit(1)).alias("n"))
    each = counted.select("id", "v", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("copy"))
    return each.select("id", F.xxhash64("id", "v", "copy").alias("row"), "v")


def matrix(vectors: pd.Series, width: int) -> np.ndarray:
    """Rows of equal width, shorter ones filled with zeros."""
    out = np.zeros((len(vectors), width))
    for k, v in enumerate(vectors):
        out[k, : len(v)] = v
    return out


def whole_matrix(vectors: pd.Series, width: int, kind: type) -> np.ndarray:
    out = np.zeros((len(vectors), width), kind)
    for k, v in enumerate(vectors):
        out[k, : len(v)] = [int(x) for x in v]
    return out


def choose_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Each next pivot is the sampled vector farthest from those chosen."""
    if not len(sample):
        return sample
    chosen = [int(np.argmax(((sample - sample.mean(axis=0)) ** 2).sum(axis=1)))]
    away = ((sample - sample[chosen[0]]) ** 2).sum(axis=1)
    while len(chosen) < min(count, len(sample)) and away.max() > 0:
        chosen.append(int(np.argmax(away)))
        away = np.minimum(away, ((sample - sample[chosen[-1]]) ** 2).sum(axis=1))
    return sample[chosen]


def distances(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    squares = (points**2).sum(axis=1)[:, None] + (pivots**2).sum(axis=1)[None, :] - 2 * points @ pivots.T
    return np.sqrt(np.maximum(squares, 0))


@dataclass
class Cells:
    """Ranges of each cell's distances to all pivots, its largest squared norm, and its shards."""

    low: np.ndarray
    high: np.ndarray
    norm: np.ndarray
    first_shard: np.ndarray
    shards: np.ndarray

    def best(self, to_pivots: np.ndarray, norms: np.ndarray) -> np.ndarray:
        """The highest score that a query can have in each cell."""
        gap = np.maximum(self.low[None] - to_pivots[:, None, :], to_pivots[:, None, :] - self.high[None]).max(axis=2)
        far = np.maximum(self.high, 0).max(axis=1, initial=0) + np.sqrt(np.maximum(self.norm, 0))
        gap -= SLACK * ((to_pivots.max(axis=1, initial=0) + np.sqrt(norms))[:, None] + far[None, :])
        both = norms[:, None] + self.norm[None, :]
        return (both + SLACK * (1 + np.maximum(both, 0)) - np.maximum(gap, 0) ** 2) / 2


class Shard:
    """Candidates of one shard: ids, rows, vectors, distances to the pivots, squared norms."""

    def __init__(self, rows: pd.DataFrame, width: int):
        self.ids, self.rows = rows["id"].to_numpy(np.int64), rows["row"].to_numpy(np.int64)
        self.whole = rows["v"]
        self.points = matrix(rows["v"], width)
        self.to_pivots = np.ascontiguousarray(np.stack(rows["d"].to_numpy()).astype(np.float32).T)
        self.norms = (self.points**2).sum(axis=1)
        self.largest, self.width = np.abs(self.points).max(initial=0), width

    def bounds(self, to_pivots: np.ndarray, norms: np.ndarray, floors: np.ndarray) -> np.ndarray:
        """Upper bounds of the scores by query and candidate."""
        both = norms[:, None] + self.norms[None, :]
        both += SLACK * (1 + both)
        far = to_pivots.max(axis=1, initial=0) + np.sqrt(norms), self.to_pivots.max(axis=0, initial=0) + np.sqrt(self.norms)
        wrong = (SLACK * (far[0][:, None] + far[1][None, :])).astype(np.float32)
        gap, one = np.zeros(both.shape, np.float32), np.empty(both.shape, np.float32)
        bound, alive = both / 2, both.size
        for at in range(0, len(self.to_pivots), GROUP):
            for p in range(at, min(at + GROUP, len(self.to_pivots))):
                np.subtract(to_pivots[:, p, None], self.to_pivots[p][None, :], out=one)
                np.abs(one, out=one)
                np.maximum(gap, one, out=gap)
            bound = (both - np.maximum(gap - wrong, 0).astype(np.float64) ** 2) / 2
            left = int((bound >= floors[:, None]).sum())
            if left >= alive * (1 - WORTH):
                break
            alive = left
        return bound

    def scores(self, vectors: np.ndarray, whole: pd.Series, chosen: np.ndarray | None = None) -> np.ndarray:
        """Exact scores of queries with all candidates, or with the chosen ones of each query."""
        limit = float(self.largest) * float(np.abs(vectors).max(initial=0)) * max(1, self.width)
        if limit < 2.0**53:
            got = vectors @ self.points.T if chosen is None else np.einsum("qd,qcd->qc", vectors, self.points[chosen])
            return got.astype(np.int64)
        # Whole numbers beyond double precision; Python's own where 64 bits might not do.
        kind = np.int64 if limit < 2.0**62 else object
        own, asked = whole_matrix(self.whole, self.width, kind), whole_matrix(whole, self.width, kind)
        got = asked @ own.T
        if kind is object and any(not -(1 << 63) <= x < 1 << 63 for x in got.flat):
            raise OverflowError("a score doesn't fit 64 bits")
        got = got.astype(np.int64)
        return got if chosen is None else np.take_along_axis(got, chosen, axis=1)

    def best(self, asked: pd.DataFrame, floors: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(queries, candidates, scores) of blocks: for each query its best k candidates that reach its floor."""
        for at in range(0, len(asked), TOGETHER):
            part, floor = asked.iloc[at : at + TOGETHER], floors[at : at + TOGETHER].copy()
            vectors = matrix(part["v"], self.width)
            d = np.stack(part["d"].to_numpy()).astype(np.float32)
            bound = self.bounds(d, (vectors**2).sum(axis=1), floor)
            bound[part["row"].to_numpy(np.int64)[:, None] == self.rows[None, :]] = -np.inf
            first = 8 * k
            if np.isneginf(floor).any() and bound.shape[1] > first:
                # The highest bounds first: their k-th score is a floor for the rest.
                top = np.argpartition(-bound, first, axis=1)[:, :first]
                got = np.where(np.isneginf(np.take_along_axis(bound, top, axis=1)), np.iinfo(np.int64).min, self.scores(vectors, part["v"], top))
                floor = np.maximum(floor, np.partition(got, first - k, axis=1)[:, first - k])
            alive = (bound >= floor[:, None]) & ~np.isneginf(bound)
            asks = np.flatnonzero(alive.any(axis=1))
            if not len(asks):
                continue
            got = self.scores(vectors[asks], part["v"].iloc[asks])
            query, candidate = np.nonzero(alive[asks] & (got >= floor[asks][:, None]))
            score = got[query, candidate]
            order = np.lexsort((self.rows[candidate], self.ids[candidate], -score, query))
            query, candidate, score = query[order], candidate[order], score[order]
            starts = np.searchsorted(query, np.arange(len(asks)))
            keep = np.arange(len(query)) - starts[query] < k
            yield asks[query[keep]] + at, candidate[keep], score[keep]


def search(df: DataFrame, is_query: Column, k: int = 20, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = 64, pivots: int = PIVOTS, shard_rows: int = SHARD_ROWS, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the best ``k`` other vectors of every vector for which ``is_query`` (on column id) holds."""
    spark = df.sparkSession
    bounded_batches(spark)
    plain = materialize(vectors_of(df, vec_id, embedding, scale), "vectors")
    width, rows = plain.agg(F.max(F.size("v")), F.count(F.lit(1))).first()
    width = width or 0
    sample = plain.orderBy(F.xxhash64("row"), "row").limit(SAMPLED).select("v").toPandas()["v"]
    chosen = choose_pivots(matrix(sample, width), pivots)
    shipped = spark.sparkContext.broadcast(chosen)  # a few vectors
    # Cells are those of the first pivots, no more than shards are needed; their ranges are kept for as many.
    n = min(len(chosen), max(1, rows // shard_rows))
    ranged = min(len(chosen), GROUP)

    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            points = matrix(batch["v"], width)
            d = distances(points, shipped.value)
            yield batch.assign(d=list(d), norm=(points**2).sum(axis=1), cell=d[:, :n].argmin(axis=1) if len(d) else [])

    table = materialize(plain.mapInPandas(measured, "id long, row long, v array<long>, d array<double>, norm double, cell int"), "pivot-table")
    ranges = table.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("norm").alias("norm"), *[f(F.get("d", F.lit(p))).alias(f"{name}{p}") for p in range(ranged) for f, name in ((F.min, "low"), (F.max, "high"))])
    ranges = ranges.orderBy("cell").toPandas()
    shards = np.zeros(n, np.int64)
    low, high, norm = np.full((n, ranged), np.inf), np.full((n, ranged), -np.inf), np.full(n, -np.inf)
    for r in ranges.itertuples():
        shards[r.cell] = -(-r.n // shard_rows)
        low[r.cell], high[r.cell], norm[r.cell] = [getattr(r, f"low{p}") for p in range(ranged)], [getattr(r, f"high{p}") for p in range(ranged)], r.norm
    cells = Cells(low, high, norm, np.cumsum(shards) - shards, shards)
    number = lambda values: F.get(F.array(*[F.lit(int(x)) for x in values] or [F.lit(0)]), F.col("cell"))
    placed = table.withColumn("shard", (number(cells.first_shard) + F.pmod(F.col("row"), F.greatest(number(shards), F.lit(1)))).cast("int"))
    queries = placed.where(is_query)

    def floors(rows: pd.DataFrame) -> pd.DataFrame:
        asked, shard = rows[rows["asks"]], Shard(rows, width)
        found = np.full(len(asked), -np.inf)
        for query, _, score in shard.best(asked, found, k):
            worst, count = np.full(len(asked), np.inf), np.bincount(query, minlength=len(asked))
            np.minimum.at(worst, query, score)
            found = np.where(count == k, worst, found)
        return pd.DataFrame({"row": asked["row"], "floor": found})

    known = placed.withColumn("asks", is_query).groupBy("shard").applyInPandas(floors, "row long, floor double")
    asked = materialize(queries.join(known, "row").select("id", "row", "v", "d", "norm", "floor"), "queries")
    blocks = max(1, -(-asked.count() // query_block))

    def visits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                norms = batch["norm"].to_numpy()
                best = cells.best(np.stack(batch["d"].to_numpy())[:, :ranged], norms)
                row, cell = np.nonzero((best >= batch["floor"].to_numpy()[:, None]) & (shards[None, :] > 0))
                times = shards[cell]
                shard = np.repeat(cells.first_shard[cell], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                yield batch.iloc[np.repeat(row, times)].assign(shard=shard)[["id", "row", "v", "d", "floor", "shard"]]

    block = F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int")
    visiting = asked.mapInPandas(visits, "id long, row long, v array<long>, d array<double>, floor double, shard int").withColumn("block", block)
    visited = visiting.groupBy(F.col("shard").alias("visited"), F.col("block").alias("by")).agg(F.count(F.lit(1)).alias("n"))
    candidates = placed.join(visited, F.col("shard") == F.col("visited")).select("id", "row", "v", "d", "shard", F.col("by").alias("block"))

    def meet(own: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(own) and len(asking):
            shard = Shard(own, width)
            ids, rows = asking["id"].to_numpy(np.int64), asking["row"].to_numpy(np.int64)
            for query, candidate, score in shard.best(asking, asking["floor"].to_numpy(float), k):
                found.append(pd.DataFrame({"query_id": ids[query], "row": rows[query], "vec_id": shard.ids[candidate], "other": shard.rows[candidate], "score": score}))
        return pd.concat(found) if found else pd.DataFrame({"query_id": [], "row": [], "vec_id": [], "other": [], "score": []}, dtype="int64")

    pairs = candidates.groupBy("shard", "block").cogroup(visiting.groupBy("shard", "block")).applyInPandas(meet, "query_id long, row long, vec_id long, other long, score long")
    best = Window.partitionBy("query_id", "row").orderBy(F.col("score").desc(), "vec_id", "other")
    return pairs.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def digest(embeddings: DataFrame) -> DataFrame:
    return search(embeddings, F.col("id") % 20 == 0)


SQL = """
WITH v AS (SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS c FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, q.r, o.vec_id, list_inner_product(q.c::DOUBLE[], o.c::DOUBLE[])::BIGINT AS score
      FROM v q JOIN v o ON q.vec_id % 20 = 0 AND q.r <> o.r)
SELECT query_id, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM p QUALIFY rank <= 20
"""
