import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from vozlake.llm import raking as rk


def plain_fit(rows, share, powers):
    """Raking over a dense cube; rows are (source, language, topic, tokens)."""
    names = [sorted({r[k] for r in rows if r[3]}, key=str) for k in range(3)]
    cube = np.zeros([len(n) for n in names])
    for r in rows:
        if r[3]:
            cube[tuple(n.index(x) for n, x in zip(names, r, strict=False))] += r[3]
    wants = []
    for k in range(3):
        own = cube.sum(axis=tuple(x for x in range(3) if x != k)) / cube.sum()
        wants.append(own ** powers[k] / (own ** powers[k]).sum())
    ratio = np.ones_like(cube)
    for _ in range(500):
        for k in range(3):
            now = (cube * ratio).sum(axis=tuple(x for x in range(3) if x != k))
            ratio = ratio * np.expand_dims(wants[k] / now, tuple(x for x in range(3) if x != k))
    low, high = 0.0, 1e12
    for _ in range(400):
        mid = (low + high) / 2
        low, high = (mid, high) if (cube * np.minimum(1, mid * ratio)).sum() < share * cube.sum() else (low, mid)
    return names, ratio, high


def table(spark, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for key in range(900):
        source = "hot" if rng.random() < 0.4 else f"s{rng.integers(6)}" if rng.random() < 0.95 else None
        lang = rng.choice(["en", "de", "fr"], p=[0.7, 0.2, 0.1]) if rng.random() < 0.97 else None
        text = " ".join(["word"] * int(rng.integers(1, 60))) + rng.choice(["", " copyright", " a|b|c|d|e|f|g|h|i|j"], p=[0.6, 0.3, 0.1])
        rows.append((key, text, None if lang is None else str(lang), source))
    rows += [(900, None, "en", "hot"), (901, "", "de", None), (902, " \n", "xx", "empty only"), (903, "w " * 300_000, "en", "hot"), (None, "a b c", "en", "s1"), (5, rows[5][1], rows[5][2], rows[5][3])]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("Topic", F.lit("t")).withColumn("a.b", F.lit(1)).withColumn("a", F.lit(2)).withColumn("k", F.lit(2))


@pytest.mark.parametrize("broadcast", [100, 0])
def test_equals_a_plain_cube(spark, broadcast):
    rows, df = table(spark)
    got = rk.mix(df, broadcast_sources=broadcast)
    assert [c for c in got.columns if not c.startswith("mix_")] == df.columns
    got = got.collect()
    assert len(got) == len(rows)
    cells = [(r.source, r.lang, r.mix_topic, r.mix_tokens) for r in got]
    names, ratio, scale = plain_fit(cells, 0.5, (0.5, 0.5, 1.0))
    for r in got:
        assert r.mix_tokens == len(re.findall(r"\S+", r.text or ""))
        if r.mix_tokens:
            want = ratio[names[0].index(r.source), names[1].index(r.lang), names[2].index(r.mix_topic)]
            assert np.isclose(r.mix_probability, min(1, scale * want), rtol=1e-5)
    expected = sum(r.mix_probability * r.mix_tokens for r in got)
    assert np.isclose(expected, 0.5 * sum(r.mix_tokens for r in got), rtol=1e-6)
    drawn = sum(r.mix_tokens for r in got if r.mix_drawn and r.mix_tokens < 1000)
    assert drawn > 0 and len({r.mix_drawn for r in got if r.doc_id == 5}) == 1


def test_given_targets_are_met(spark):
    _, df = table(spark, 1)
    small = df.where("doc_id < 900 and source is not null and lang is not null")
    targets = {"source": {"=hot": 0.1, **{f"=s{k}": 0.15 for k in range(6)}}, "language": {"=en": 0.4, "=de": 0.3, "=fr": 0.3}}
    got = rk.mix(small, share=0.05, targets=targets)
    total = got.agg(F.sum(F.col("mix_weight") * F.col("mix_tokens"))).first()[0]
    for dimension, column in (("source", "source"), ("language", "lang")):
        shares = {r[0]: r[1] / total for r in got.groupBy(column).agg(F.sum(F.col("mix_weight") * F.col("mix_tokens"))).collect()}
        assert all(np.isclose(shares[k[1:]], v, atol=1e-6) for k, v in targets[dimension].items())


def test_sampling_ignores_order_and_empty_tables_work(spark):
    _, df = table(spark, 2)
    ids = lambda x: sorted((str(r.doc_id) for r in x.collect()))
    assert ids(rk.sample(df)) == ids(rk.sample(df.repartition(9).orderBy(F.rand(4))))
    assert rk.sample(df.limit(0)).count() == 0 and rk.mix(df.where("doc_id in (900, 901)")).where("mix_drawn").count() == 0
    assert rk.sample(df).columns == [*df.columns, "mix_probability"]


def test_texts_without_tokens_have_the_plain_share(spark):
    _, df = table(spark, 3)
    empty = spark.range(2000).select((F.col("id") + 10_000).alias("doc_id"), F.lit(" ").alias("text"), F.lit("en").alias("lang"), F.lit("empty only").alias("source"))
    rows = rk.mix(df.select(empty.columns).unionAll(empty), share=0.3).where("mix_tokens = 0").collect()
    assert len(rows) == 2003 and {r.mix_probability for r in rows} == {0.3}
    assert 500 < sum(r.mix_drawn for r in rows) < 700
