"""The sliced plans must give what a plain window gives, whatever the skew."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from vozlake.operators import dialogue as dg
from vozlake.operators.ordered import Ordered, exclusive, hash_bottom, hot_groups, linear, nest, nth, quantiles, salted_join


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(5)
    rows = [("hot", i, rng.choice([0.0, 1.5, 2.0, rng.random()]), i) for i in range(400)]
    rows += [(f"k{i % 9}", i, rng.random(), 1000 + i) for i in range(120)]
    rows += [(None, i, rng.random(), 5000 + i) for i in range(40)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "k string, t int, v double, id long").cache()


def by_key(skewed):
    groups = {}
    for r in skewed.collect():
        groups.setdefault(r.k, []).append(r)
    return {k: sorted(v, key=lambda r: (r.t, r.id)) for k, v in groups.items()}


@pytest.mark.parametrize("limit", [10**6, 150, 30])
def test_running_values_and_neighbours(skewed, limit):
    o = Ordered(skewed, ["k"], "t", ["id"], rows_per_task=limit)
    assert o.split == (limit < 400)
    got = (
        o.row_number("rn", total="n")
        .cumsum("before", F.col("v"), exclusive=True, total="all")
        .lag("prev", "id")
        .lead("next", "id")
        .lags("ctx", "id", 3)
        .df.collect()
    )
    assert len(got) == 560
    want = by_key(skewed)
    for r in got:
        group = want[r.k]
        i = r.rn - 1
        assert group[i].id == r.id and r.n == len(group)
        assert r.prev == (group[i - 1].id if i else None)
        assert r.next == (group[i + 1].id if i + 1 < len(group) else None)
        assert r.ctx == [x.id for x in group[max(0, i - 3) : i]]
        assert r.before == pytest.approx(sum(x.v for x in group[:i]))
        assert r.all == pytest.approx(sum(x.v for x in group))


@pytest.mark.parametrize("limit", [10**6, 100])
def test_global_order(skewed, limit):
    got = Ordered(skewed, [], F.col("id"), rows_per_task=limit).row_number("rn").df.select("id", "rn").collect()
    ids = sorted(r.id for r in got)
    assert {r.id: r.rn for r in got} == {x: i + 1 for i, x in enumerate(ids)}


@pytest.mark.parametrize("limit", [10**6, 60])
def test_quantiles(skewed, limit):
    spec = {"med": linear(0.5), "p90": linear(0.9), "x95": exclusive(95), "q1": nth(lambda n: F.floor(n / 4))}
    got = {r.k: r for r in quantiles(skewed, ["k"], F.col("v"), spec, limit).collect()}
    for k, group in by_key(skewed).items():
        vals = sorted(r.v for r in group)
        assert got[k].n == len(vals)
        assert got[k].med == pytest.approx(statistics.median(vals))
        assert got[k].q1 == vals[len(vals) // 4]
        assert got[k].x95 == pytest.approx(statistics.quantiles(vals, n=100)[94])
        pos = 0.9 * (len(vals) - 1)
        lo = int(pos)
        hi = min(lo + 1, len(vals) - 1)
        assert got[k].p90 == pytest.approx(vals[lo] + (vals[hi] - vals[lo]) * (pos - lo))


def test_hash_bottom_takes_exactly_the_quota(skewed):
    rows = skewed.where("k is not null")
    got = hash_bottom(rows, "k", F.col("id"), lambda n, g: F.floor(n / 3), "s").groupBy("k").agg(
        F.count("*").alias("c"), F.max("n").alias("n"), F.sum(F.col("selected").cast("int")).alias("s")
    ).collect()
    for r in got:
        assert r.c == r.n and r.s == r.n // 3
    again = hash_bottom(rows.orderBy("v"), "k", F.col("id"), lambda n, g: F.floor(n / 3), "s")
    first = hash_bottom(rows, "k", F.col("id"), lambda n, g: F.floor(n / 3), "s")
    assert first.exceptAll(again).count() == 0


@pytest.mark.parametrize("how", ["inner", "left"])
def test_salted_join(skewed, spark, how):
    right = spark.createDataFrame([("hot", "H"), ("k1", "A"), ("k2", "B")], "k string, name string")
    plain = skewed.join(right, ["k"], how)
    salted = salted_join(skewed, right, ["k"], ["id"], how, rows_per_task=50)
    cols = plain.columns
    assert plain.count() == salted.count()
    assert plain.exceptAll(salted.select(*cols)).count() == 0


def test_nest_keeps_every_row_in_order(skewed):
    got = nest(skewed, ["k"], "t", F.col("id"), "ids", ["id"]).collect()
    assert {r.k: list(r.ids) for r in got} == {k: [x.id for x in v] for k, v in by_key(skewed).items()}


def test_hot_groups_reports_only_large_groups(skewed):
    assert hot_groups(skewed, ["k"], 100) == [(("hot",), 400)]


def test_long_groups_stay_whole(spark):
    turns = spark.range(5000).select(F.lit(7).alias("conv_id"), ((F.col("id") * 37) % 5000).alias("turn"), F.lit("user").alias("role"), F.col("id").cast("string").alias("text"))
    rows = dg.nested_dialogues(turns).collect()
    assert len(rows) == 1 and [int(t.text) * 37 % 5000 for t in rows[0].turns] == list(range(5000))
    one = dg.alignment_json(turns.withColumns({"start": F.col("turn"), "end": F.col("turn") + 1, "role_label": F.lit("x")})).collect()
    assert len(one) == 1 and one[0].json.count('"x"') == 5000
