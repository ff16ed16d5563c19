"""Words and frames are shuffled once, and rows that come twice or lack a clip are treated alike however they are dealt."""

import random

import pytest
from pyspark.sql import functions as F

from vozlake.operators import ordered
from vozlake.operators import prosody as pr
from vozlake.plans import speech
from vozlake.plans.registry import Tables
from vozlake.session import materialize, where_dealt


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def plain(df):
    return sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def recorded(spark):
    rng, words, frames = random.Random(4), [], []
    for clip in (1, 2, 3, None):
        t = 0.0
        for pos in range(60 if clip == 1 else 12):
            end = t + rng.choice([0.2, 0.5, 1.3])
            words += [(clip, pos, rng.choice(["quem", "foi", "né", "casa.", "é", "…"]), t, end)] * (2 if pos % 7 == 3 else 1)
            t = end + rng.choice([0.0, 0.2, 0.4, 0.9])
        frames += [(clip, i, i * 0.05, rng.choice([0.0, 90.0, 120.0, 200.5])) for i in range(int(t / 0.05))] * (2 if clip == 2 else 1)
    frames += [(9, 0, 0.0, 100.0)]
    return (
        spark.createDataFrame(words, "clip_id long, pos long, word string, start double, end double").repartition(3),
        spark.createDataFrame(frames, "clip_id long, i long, t double, value double").repartition(3),
    )


def test_words_and_frames_are_shuffled_once(spark, sf_dir):
    t = Tables(spark, sf_dir)
    marked = pr.boundaries(speech.words(t), speech.pitch(t))
    with where_dealt(spark):
        # Words, words for their pitch, frames, and tables by clip: two quantiles of two steps, and their join.
        assert exchanges(marked) <= 8
    assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == "true"


def test_units_take_one_shuffle_of_points(spark, recorded, monkeypatch):
    seen = []
    monkeypatch.setattr(pr, "materialize", lambda df, label: seen.append((label, exchanges(df))) or materialize(df, label))
    pr.intonation_units(materialize(pr.boundaries(*recorded))).collect()
    assert dict(seen) == {"clip-ends": 1, "closed-units": 2}


def features_loop(words, frames):
    """For each word its place and the means around its end; words of one place share what all of them meet."""
    words, frames = ([r for r in df.collect()] for df in (words, frames))
    found = {}
    for clip in {r.clip_id for r in words}:
        own = sorted((r for r in words if r.clip_id == clip), key=lambda r: r.pos)
        heard = [f for f in frames if clip is not None and f.clip_id == clip and f.value > 0]
        for r, after in zip(own, own[1:] + [None]):
            at = found.setdefault((clip, r.pos), ([], [], []))
            at[0].extend(f.value for f in heard if max(0.0, r.end - 0.15) <= f.t <= r.end)
            at[1].extend(f.value for f in heard if after and after.start <= f.t <= after.start + 0.15)
            at[2].append(1)
    mean = lambda values: round(sum(values) / len(values), 9) if values else None
    return sorted(((c, p, mean(b), mean(a)) for (c, p), (b, a, n) in found.items() for _ in n), key=repr)


def test_pitch_equals_a_loop(spark, recorded):
    words, frames = recorded
    want = features_loop(words, frames)
    got = pr.pitch_features(words, frames)
    assert plain(got.select("clip_id", "pos", "f0_before", "f0_after")) == want
    there = pr.pitch_features(words.repartition(5, "clip_id"), frames, many=5)
    with where_dealt(spark):
        assert plain(materialize(there)) == plain(got)


@pytest.mark.parametrize("limit", [10**6, 20])
def test_boundaries_and_units_do_not_depend_on_dealing(spark, recorded, limit):
    words, frames = recorded
    once = words.dropDuplicates(["clip_id", "pos"]).where("clip_id is not null")
    usual = pr.boundaries(once, frames)
    got = pr.boundaries(once, frames, rows_per_task=limit)
    assert plain(got) == plain(usual) and got.count() == once.count()
    with where_dealt(spark):
        assert plain(materialize(got)) == plain(usual)
    twice = pr.boundaries(words, frames, rows_per_task=limit)
    # Words that share a place meet each other's pitch; without a clip there is no pitch.
    assert twice.groupBy("clip_id", "pos").count().where("clip_id is not null and count > 1").agg(F.max("count")).first()[0] == 4
    assert twice.where("clip_id is null and (f0_before is not null or rise_st is not null)").count() == 0
    marked = materialize(usual)
    assert plain(pr.intonation_units(marked, rows_per_task=limit)) == plain(pr.intonation_units(marked))


@pytest.mark.parametrize("limit", [10**6, 3])
def test_nth_row_of_a_group(spark, limit):
    rows = spark.createDataFrame([(k, i, f"{k}{i}") for k, n in ((1, 9), (2, 1), (None, 4)) for i in range(n)], "k long, i long, v string")
    got = ordered.Ordered(rows, ["k"], "i", rows_per_task=limit).nth("first", "v", 1).nth("second", "v", 2).df
    assert plain(got.groupBy("k", "first", "second").count()) == sorted([(1, "10", "11", 9), (2, "20", None, 1), (None, None, None, 4)], key=repr)
