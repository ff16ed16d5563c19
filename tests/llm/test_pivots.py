import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from vozlake.llm import pivots as pv


def plain(rows, asks, k=20, scale=64):
    vectors = []
    for key, e in rows:
        if key is None or e is None or any(x is None or not math.isfinite(x) for x in e):
            continue
        vectors.append((key, [math.floor(scale * float(x)) for x in e]))
    out = []
    for q, (key, own) in enumerate(vectors):
        if asks(key):
            scores = sorted((-sum(a * b for a, b in zip(own, other, strict=False)), c) for r, (c, other) in enumerate(vectors) if r != q)
            out += [(key, rank, c, -s) for rank, (s, c) in enumerate(scores[:k], 1)]
    return sorted(out)


def rows():
    rng = np.random.default_rng(8)
    out = [(k, [float(x) for x in rng.normal(size=6) * rng.choice([0.1, 1, 3])]) for k in range(-40, 500)]
    common = [0.5] * 6
    out += [(k, common) for k in range(500, 800)]
    out += [(820, None), (840, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (860, [math.nan] + [0.0] * 5), (880, [math.inf] + [0.0] * 5), (None, common), (900, []), (901, [2.0]), (920, [0.0] * 6), (960, [3e6, -2999999.3, 1e6 + 0.3, 0.1, 7.0, 3e6]), (980, [3e6, -2999999.4, 1e6 + 0.2, 0.1, 7.0, 3e6]), (40, [9.0] * 6), (60, out[100][1]), (60, out[100][1]), (940, [0.0] * 6)]
    return out


@pytest.mark.parametrize("options", [{}, {"shard_rows": 40, "query_block": 9, "pivots": 5}, {"k": 1000}])
def test_equals_a_plain_search(spark, options):
    data = rows()
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>").withColumn("id", F.lit(1)).withColumn("Score", F.lit(2)).withColumn("a.b", F.lit(3))
    got = sorted(map(tuple, pv.search(df, F.col("id") % 20 == 0, **options).collect()))
    assert got == plain(data, lambda q: q % 20 == 0, options.get("k", 20))


def test_few_rows(spark):
    schema = "vec_id long, embedding array<float>"
    assert pv.digest(spark.createDataFrame([], schema)).count() == 0
    assert pv.digest(spark.createDataFrame([(20, [1.0])], schema)).count() == 0
    assert list(map(tuple, pv.digest(spark.createDataFrame([(20, [1.0]), (21, [0.5])], schema)).collect())) == [(20, 1, 21, 64 * 32)]


def test_bounds_skip_most_of_what_lies_apart():
    rng = np.random.default_rng(3)
    points = np.concatenate([rng.normal(size=(200, 4)) + centre for centre in (0, 40)]).round()
    chosen = pv.choose_pivots(points, 4)
    own = pd.DataFrame({"id": range(400), "row": range(400), "v": list(points), "d": list(pv.distances(points, chosen))})
    shard = pv.Shard(own, 4)
    (query, candidate, scores), *more = shard.best(own[399:], np.array([-np.inf]), 5)
    want = np.lexsort((np.arange(399), -(points[:399] @ points[399])))[:5]
    assert not more and list(query) == [0] * 5 and list(shard.ids[candidate]) == list(want)
    bound = shard.bounds(np.stack(own["d"][399:]).astype(np.float32), (points[399:] ** 2).sum(axis=1), np.array([-np.inf]))
    assert (bound >= scores.min()).sum() < 250
    assert (bound[0, :399] >= points[:399] @ points[399]).all()


def test_scores_beyond_64_bits_are_refused(spark):
    schema = "vec_id long, embedding array<double>"
    for value in (1e30, 1e12):
        with pytest.raises(Exception, match="fit 64 bits"):
            pv.digest(spark.createDataFrame([(20, [value]), (21, [value])], schema)).collect()
