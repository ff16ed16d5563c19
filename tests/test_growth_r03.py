"""Work that must not grow faster than the tables: partitions follow the rows, texts move and not their words."""

import itertools
import random
import threading

import pandas as pd
from pyspark.sql import functions as F

from vozlake.functions import frontend as fe
from vozlake.functions import phones as ph
from vozlake.operators import accent
from vozlake.operators import frames as fr
from vozlake.operators import ordered
from vozlake.operators.turns import Listener, Run, TurnRules
from vozlake.streaming.jobs import TurnProcessor


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_partitions_follow_the_rows(spark, monkeypatch):
    rows = spark.range(4000).select((F.col("id") % 40).alias("k"), F.col("id").alias("i"))
    monkeypatch.setattr(ordered, "ROWS_PER_PARTITION", 100)
    dealt = ordered.Ordered(rows, ["k"], "i").row_number("n", total="of").df
    assert dealt.rdd.getNumPartitions() >= 40 and dealt.where("n = (i - k) / 40 + 1 and of = 100").count() == 4000
    tops = rows.groupBy("k").agg(F.max("i").alias("top"))
    for limit in (30, 2000):
        joined = ordered.Ordered(rows, ["k"], "i", rows_per_task=limit).attach(tops.hint("merge")).row_number("n").df
        assert joined.rdd.getNumPartitions() >= 40 and joined.where("n = (i - k) / 40 + 1 and top = 3960 + k").count() == 4000
    hot = ordered.Ordered(rows, ["k"], "i", rows_per_task=30).row_number("n", total="of").df
    assert hot.rdd.getNumPartitions() >= 40 and hot.where("n = (i - k) / 40 + 1 and of = 100").count() == 4000


def test_frames_dealt_out_give_the_same_rows(spark, monkeypatch):
    dice = random.Random(5)
    kept = [(k, i, i * 0.01, float(dice.choice([20, 20, 60, 62, 64])), dice.random() < 0.7) for k in [None, 1, 2, 3] for i in range(300)]
    df = spark.createDataFrame(kept, "clip_id long, i long, t double, db double, voiced boolean")
    both = lambda: (sorted(map(repr, fr.silent_pauses(df, 0.01, 25.0, 0.02, 0.02).collect())), sorted(map(repr, fr.syllable_nuclei(df).collect())))
    whole = both()
    monkeypatch.setattr(ordered, "ROWS_PER_PARTITION", 50)
    assert both() == whole and len(whole[1]) > 20


def test_phones_of_texts_move_texts_alone(spark):
    df = spark.createDataFrame([(1, "Chave, chave - carro"), (2, None), (3, ""), (4, "quem  bom!")], "doc_id long, text string")
    got = ph.text_phones(df)
    assert "Join" not in plan(got) and "Sort" not in plan(got)
    speller = ph.Speller()
    for r in got.collect():
        words = ["chave", "chave", "carro"] if r.doc_id == 1 else ["quem", "bom"] if r.doc_id == 4 else []
        assert r.phones == [p for w in words for p in speller.word(w)]


def test_windows_of_large_lexicons(spark):
    texts = spark.createDataFrame([(1, "A b, c d"), (2, "- a b -"), (3, "x"), (4, "!?"), (5, "a b a b a")], "__d long, text string").withColumn("pieces", fe.pieces_of(F.col("text")))
    places = F.explode(F.sequence(F.lit(0), F.size("pieces") - 1)).alias("pos")
    begins = {True: F.get("pieces", F.col("pos")).rlike(r"^[\p{L}\p{N}_]"), False: ~F.get("pieces", F.col("pos")).rlike(r"^[\p{L}\p{N}_]")}
    for kinds in ([True], [False], [True, False]):
        want = set()
        for n in (1, 2, 3, 5):
            each = texts.select("__d", "pieces", places).withColumn("word", fe._window(F.col("pieces"), F.col("pos"), n))
            for kind in kinds:
                want |= {(r["__d"], r.pos, n, r.word) for r in each.where(begins[kind]).where("word is not null").collect()}
        assert {tuple(r) for r in fe._windows(texts, [5, 3, 2, 1], kinds).collect()} == want


def test_texts_are_compared_before_they_are_cut(spark):
    texts = spark.createDataFrame([(1, "a b c"), (2, "a b c"), (3, None), (4, "")], "doc_id long, text string")
    entries = spark.createDataFrame([("a b", "x", 0), ("c", "y", 1)], "word string, phones string, seq long")
    found = fe.found_entries(texts, entries, literal_limit=0)
    moved = plan(found).split("dropDuplicates")[0]
    below = [line for line in moved.splitlines() if "Exchange" in line or "Aggregate" in line]
    assert below and not any("first(pieces" in line for line in below)
    assert sorted((r.doc_id, [c.phones for c in r.chosen]) for r in found.collect()) == [(1, ["x", "y"]), (2, ["x", "y"]), (3, []), (4, [])]


def test_short_sessions_are_not_grouped(monkeypatch):
    def refuse(*args, **kwargs):
        raise AssertionError("a grouping for one session")

    monkeypatch.setattr(pd.DataFrame, "groupby", refuse)
    rules = TurnRules(endpoint_ms=96, short_ms=64, min_turn_ms=64)

    class Value:
        kept = None

        def get(self):
            return self.kept

        def exists(self):
            return self.kept is not None

        def update(self, value):
            self.kept = value

    processor = TurnProcessor(rules, ["mark_playing", "mark_strong", "mark_speech", "mark_likely"], ["i"], None)
    processor.value = Value()
    speech = [True] * 5 + [False] * 4 + [True] * 3 + [False] * 9
    rows = pd.DataFrame({"i": range(len(speech)), "mark_playing": False, "mark_strong": False, "mark_speech": speech, "mark_likely": False})
    got = [tuple(r)[1:] for part in (rows[9:0:-1], rows[10:]) for r in next(iter(processor.handleInputRows((7,), iter([part]), None))).itertuples(index=False)]
    listener, want = Listener(), []
    for first, n, on in ((1, 4, True), (5, 4, False), (9, 1, True), (10, 2, True), (12, 9, False)):
        want.append(listener.hear(rules, Run(first, n, False, False, on, False)))
    assert got == [w for w in want if w] and len(got) == 2


def vowels(spark, speakers, count, seed):
    dice = random.Random(seed)
    rows = [(k, k % speakers, dice.choice(["open", "open", "closed"])) for k in range(count)]
    out = [(k, s, a, (0.5 if a == "open" else -0.5) + dice.gauss(0, 1), dice.gauss(0, 1), dice.gauss(0, 1), dice.gauss(100, 5), dice.gauss(90, 5)) for k, s, a in rows]
    return spark.createDataFrame(out, "id int, speaker_id int, aperture string, F1_z double, F2_z double, F3_z double, B1_Hz double, duration_ms double")


def test_models_are_fitted_side_by_side_on_even_partitions(spark, monkeypatch):
    monkeypatch.setattr(accent, "ROWS_BEFORE_DEALING", 100, raising=False)
    sizes, turn, meet, fit = [], itertools.count(), threading.Barrier(2, timeout=60), accent.fit

    def watched(rows, model):
        if next(turn) < 2:
            meet.wait()
        sizes.append([r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()])
        return fit(rows, model)

    monkeypatch.setattr(accent, "fit", watched)
    got = accent.cross_domain(vowels(spark, 3, 600, 1), vowels(spark, 1, 500, 2), "id", folds=2, forest=False).collect()
    assert [(r.model, r.test) for r in got] == [("LR", test) for test in ("HH", "HtoTTS", "TTStoTTS", "TTStoH")]
    assert sorted(map(sum, sizes))[-2:] == [500, 600] and len(sizes) == 6
    for held in sizes:
        assert max(held) < 1.5 * sum(held) / spark.sparkContext.defaultParallelism


def test_scores_over_folds_are_those_of_all_predictions(spark):
    human, tts = vowels(spark, 5, 300, 3), vowels(spark, 1, 200, 4)
    got = {r.test: r.macro_f1 for r in accent.cross_domain(human, tts, "id", folds=2, forest=False).collect()}
    model = accent.models(False)["LR"]
    h, t = accent.speaker_folds(accent.labelled(human), 2), accent.row_folds(accent.labelled(tts), "id", 2)
    for test, rows in (("HH", h), ("TTStoTTS", t)):
        parts = [accent.fit(rows.where(F.col("fold") != k), model).transform(rows.where(F.col("fold") == k)).select("label", "prediction") for k in range(2)]
        assert abs(got[test] - accent.macro_f1(parts[0].union(parts[1])).first()[0]) < 1e-12
    assert abs(got["HtoTTS"] - accent.macro_f1(accent.fit(h, model).transform(t)).first()[0]) < 1e-12


def test_dealt_rows_are_the_same_rows(spark, monkeypatch):
    monkeypatch.setattr(accent, "ROWS_BEFORE_DEALING", 100)
    rows = accent.row_folds(accent.labelled(vowels(spark, 2, 300, 5).unionByName(vowels(spark, 2, 300, 5))), "id", 3).cache()
    dealt = accent.evenly(rows, 600)
    assert sorted(map(repr, dealt.collect())) == sorted(map(repr, rows.collect()))
    assert accent.evenly(rows, 100) is rows
