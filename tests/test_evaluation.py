"""Rows without a partner (runs, ratings and metrics that only one side has), and folds."""

import random

import pytest
from pyspark.sql import functions as F

from vozlake.operators import accent, gates, scoring
from vozlake.operators import ratings as rt


def test_manifest_without_benchmark_or_sentence(spark):
    wavs = spark.createDataFrame([("r", "a", "r/a.wav"), ("r", "b", "r/b.wav"), ("s", "c", "s/c.wav")], "run string, id string, wav string")
    bench = spark.createDataFrame([("a", "text a", "feliz", "carioca"), ("z", "unused", "triste", "carioca")], "id string, text string, emotion string, accent string")
    sent = spark.createDataFrame([("r", "b", 0.5, 2.0, "ref b", "hyp b")], "run string, id string, wer double, dur_s double, ref string, hyp string")
    got = {r.id: (r.emotion, r.accent, r.text, r.wer, r.hyp) for r in rt.manifest(wavs, bench, sent).collect()}
    assert got == {"a": ("feliz", "carioca", "text a", None, ""), "b": ("?", "?", "ref b", 0.5, "hyp b"), "c": ("?", "?", "", None, "")}


def test_metrics_of_unknown_sentences(spark):
    rows = spark.createDataFrame([("r", "a", 0.1), ("r", "b", 0.2)], "run string, id string, wer double")
    sim = spark.createDataFrame([("r", "a", 0.9), ("x", "a", 0.8)], "run string, id string, spk_sim double")
    pros = spark.createDataFrame([("r", "b", 3)], "run string, id string, taxa int")
    got = {r.id: (r.wer, r.spk_sim, r.taxa) for r in scoring.attach_metrics(rows, sim, pros, ["run", "id"]).collect()}
    assert got == {"a": (0.1, 0.9, None), "b": (0.2, None, 3)}


def test_emotions_break_rules_only_together(spark):
    rows = spark.createDataFrame([(1, ["neutral"]), (2, ["neutral", "happy"]), (3, ["a", "b", "c"]), (4, ["a", "b", "c", "d"]), (5, []), (6, ["neutral", "a", "b", "c"])], "id int, emocoes array<string>")
    got = {r.id: len(r.violations) for r in rt.emotion_rule_violations(rows).collect()}
    assert got == {2: 1, 4: 1, 6: 2}


def test_runs_without_enough_files_or_a_result(spark):
    runs = spark.createDataFrame([("full",), ("few",), ("none",), ("lost",)], "run string")
    wavs = spark.range(14).select(F.lit("full").alias("run"), F.col("id").cast("string")).union(spark.range(13).select(F.lit("few"), F.col("id").cast("string"))).union(spark.range(20).select(F.lit("lost"), F.col("id").cast("string")))
    got = {r.run: (r.wavs, r.has_result, r.complete) for r in gates.artifact_completeness(runs, wavs, runs.where("run <> 'lost'")).collect()}
    assert got == {"full": (14, True, True), "few": (13, True, False), "none": (0, True, False), "lost": (20, False, False)}


@pytest.mark.parametrize("speakers, folds", [(3, 3), (17, 5), (64, 4), (1, 2)])
def test_speakers_are_dealt_evenly_to_folds(spark, speakers, folds):
    rng = random.Random(speakers)
    sizes = {s: (rng.choice([0, 1, 5, 40]), rng.choice([0, 2, 7, 60])) for s in range(speakers)}
    rows = [(s, float(label), k) for s, n in sizes.items() for label in (0, 1) for k in range(n[label])] or [(0, 1.0, 0)]
    df = spark.createDataFrame(rows, "speaker_id int, label double, k int").repartition(4)
    got = accent.speaker_folds(df, folds).collect()
    assert len(got) == len(rows) and len({(r.speaker_id, r.fold) for r in got}) == len({r.speaker_id for r in got})
    assert {r.fold for r in got} <= set(range(folds))
    for label in (0, 1):
        held = [sum(r.fold == f and r.label == label for r in got) for f in range(folds)]
        assert max(held) - min(held) <= max(n[label] for n in sizes.values())


@pytest.mark.parametrize("limit", [10**6, 30])
def test_rows_of_each_class_are_dealt_evenly_to_folds(spark, limit):
    df = spark.range(203).select("id", F.when(F.col("id") % 7 == 0, 1.0).otherwise(0.0).alias("label"))
    got = accent.row_folds(df, "id", 5, rows_per_task=limit).collect()
    for label in (0.0, 1.0):
        held = [sum(r.fold == f and r.label == label for r in got) for f in range(5)]
        assert sum(held) == sum(r.label == label for r in got) and max(held) - min(held) <= 1


def test_cross_domain_tells_shifted_domains_apart(spark):
    rng = random.Random(5)

    def rows(shift, speakers, count):
        out = []
        for k in range(count):
            opened = rng.random() < 0.4
            base = 1.5 if opened else -1.5
            out.append((k, rng.randrange(speakers), "open" if opened else "closed", base + rng.gauss(0, 0.5) + shift, rng.gauss(0, 1), rng.gauss(0, 1), 100.0 + rng.gauss(0, 5), 90.0 + rng.gauss(0, 5)))
        return spark.createDataFrame(out, "id int, speaker_id int, aperture string, F1_z double, F2_z double, F3_z double, B1_Hz double, duration_ms double")

    got = {r.test: r.macro_f1 for r in accent.cross_domain(rows(0, 6, 240), rows(6, 1, 200), "id", forest=False).collect()}
    assert got["HH"] > 0.95 and got["TTStoTTS"] > 0.95 and got["HtoTTS"] < 0.5 and got["TTStoH"] < 0.5
