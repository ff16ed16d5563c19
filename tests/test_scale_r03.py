"""Queries on copies of the tables: no table made from texts is broadcast, tables may be folders, nothing is cut."""

import shutil

import pytest
from pyspark.sql import functions as F

from vozlake.operators import markers as mk
from vozlake.operators import prosody as pr
from vozlake.operators import splits as sp
from vozlake.plans import catalog, dialogues, speech
from vozlake.plans.registry import Tables
from vozlake.session import materialize


def broadcasts(df):
    return "BroadcastExchange" in df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def tables(spark, sf_dir):
    return Tables(spark, sf_dir)


def test_words_and_pitch_are_not_broadcast(tables):
    words, pitch = speech.words(tables), speech.pitch(tables)
    marked = pr.boundaries(words, pitch)
    assert not broadcasts(pr.pitch_features(words, pitch)) and not broadcasts(marked)
    units = materialize(marked.limit(200), "some")
    assert not broadcasts(pr.intonation_units(units)) and not broadcasts(pr.punctuated_text(marked))


def test_phones_are_not_broadcast(tables):
    markers, phones = materialize(speech.timed_markers(tables), "markers"), speech.timeline(tables)
    assert not broadcasts(mk.overlapping(markers, phones)) and not broadcasts(mk.expected_phone(markers, phones))
    records = markers.groupBy("clip_id").agg(F.collect_list(F.struct("t_start", "t_end", "tag", "sev", "note")).alias("markers"))
    assert not broadcasts(mk.enrich(records, phones))


@pytest.mark.parametrize("name", ["streamed_edit_log", "streamed_sentences"])
def test_streams_read_tables_that_are_folders(spark, sf_dir, tmp_path, name):
    for table in ("labels", "conversations"):
        (tmp_path / f"{table}.parquet").mkdir()
        shutil.copy(f"{sf_dir}/{table}.parquet", tmp_path / f"{table}.parquet/part-0.parquet")
    query = catalog.QUERIES[name]
    want, got = query(spark, sf_dir), query(spark, str(tmp_path))
    assert got.count() and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_every_document_is_a_card(spark):
    class Both:
        documents = spark.createDataFrame([(1, "a b", "en", "src1", 3), (2, "c\nd", "en", "src1", 3)], "doc_id long, text string, lang string, source string, n_chars long")
        benchmark = spark.createDataFrame([(1, "x"), (2, "y")], "item_id long, text string")

    found = {(r.seq, r.block, r.intensity): r.n for r in dialogues.emotion_prompts(Both()).collect()}
    assert found == {(k, b, i): n for k, lines in ((1, 1), (2, 2)) for b, i, n in ((1, "media", 2), (2, "leve", lines), (2, "forte", lines), (3, "media", 1))}


def test_first_rows_with_ties_and_nulls(spark):
    numbers = [None, 5, 3, 3, 3, 9, 1, None, 7]
    rows = spark.createDataFrame([(k, n) for k, n in enumerate(numbers)], "id long, seq long")
    order = sorted(numbers, key=lambda n: -1 if n is None else n)
    for n in (0, 1, 4, 5, 20):
        got = [r.seq for r in sp.first_rows(rows, "seq", n, rows_per_task=2).collect()]
        assert sorted(got, key=lambda n: -1 if n is None else n) == order[:n]
    assert sp.first_rows(rows.limit(0), "seq", 3).count() == 0
