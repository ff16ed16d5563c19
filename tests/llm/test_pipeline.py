import importlib
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from test_copies import plain_groups
from tests_llm_plain import contaminated_plain, raked_plain
from vozlake.llm import raking, secrets, toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    steps, rows = [], [docs.select(COLUMNS).collect()]
    for _, stage in cp.STAGES:
        docs = cp.materialize(stage(spark, docs, sf_dir), "test")
        steps.append(docs)
        rows.append(docs.collect())
    return steps, rows


def test_each_stage_equals_its_plain_version(spark, sf_dir, stages):
    steps, rows = stages
    labels, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("labels", "benchmark"))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    by_id = lambda x: {r.doc_id: r for r in x}

    model = toxicity.fit(docs.select("text"), toxicity.training_labels(docs, labels))
    assert by_id(rows[1]).keys() == {r.doc_id for r in rows[0] if model.score(r.text) < toxicity.THRESHOLD}
    assert len(rows[1]) < len(rows[0])

    roots = plain_groups([r.text for r in rows[1]])
    least = {}
    for r, root in zip(rows[1], roots, strict=True):
        least[root] = min(least.get(root, r.doc_id), r.doc_id)
    assert sorted(r.doc_id for r in rows[2]) == sorted(least.values())

    items = [r.text for r in benchmark.collect()]
    assert by_id(rows[3]).keys() == {r.doc_id for r in rows[2] if not contaminated_plain(r.text, items)}
    assert len(rows[3]) < len(rows[2])

    kept = by_id(rows[3])
    assert {(r.doc_id, r.text, r.n_chars) for r in rows[4]} == {(k, secrets.masked(r.text), len(secrets.masked(r.text))) for k, r in kept.items()}

    topics = {r.doc_id: r.t for r in steps[3].select("doc_id", raking.topic_of(F.col("text")).alias("t")).collect()}
    chance = raked_plain([(r.source, r.lang, topics[r.doc_id], len(r.text.split())) for r in rows[4]], cp.MIXED_SHARE)
    draws = {r.doc_id: r.u for r in steps[3].select("doc_id", raking.draw(F.col("doc_id"), F.col("text"), 17).alias("u")).collect()}
    want = {r.doc_id: p for r, p in zip(rows[4], chance, strict=True) if draws[r.doc_id] < p}
    assert by_id(rows[5]).keys() == want.keys()
    assert all(np.isclose(r.mix_probability, want[r.doc_id], rtol=1e-5) for r in rows[5])


def test_columns_and_whole_run(spark, sf_dir, stages):
    steps, rows = stages
    assert all(s.columns == COLUMNS for s in steps[:-1]) and steps[-1].columns == [*COLUMNS, "mix_probability"]
    assert sorted(cp.run(spark, sf_dir).collect()) == sorted(rows[-1])


def test_empty_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, sf_dir)
        assert docs.count() == 0


def odd_documents(spark, sf_dir):
    """Some documents of the table, and rows with nulls, repeats, very long texts and columns with clashing names."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    long = " ".join(f"w{k}" for k in range(100_000))
    rows = [(None, "a text without an id", "en", "s", 20), (None, None, None, None, None), (900001, None, "en", "s", 0), (900002, "", None, None, 0), (900003, " \n\t", "en", None, 3)]
    rows += [(900004, "the same row twice, with password=abcdefgh12 in it", "en", "s", 50)] * 2 + [(900004, "another text under a known id", "fr", "t", 29)]
    rows += [(900005, long, "en", "s", len(long)), (900006, long + " more", "en", "s", len(long) + 5), (900007, "ﬁ ß İ \0 \U0001f600", "und", "", 9)]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(COLUMNS).unionByName(spark.createDataFrame(rows, schema))
    clashing = ["key", "node", "size", "keys", "id", "body", "first", "root", "text_hash", "mix_tokens", "mix_topic", "label", "score", "fp", "hits", "spans", "a.b"]
    return docs.select("*", *[F.lit(f"own {c}").alias(c) for c in clashing]), [*COLUMNS, *clashing]


def test_odd_rows_in_every_stage(spark, sf_dir):
    docs, columns = odd_documents(spark, sf_dir)
    all_rows = {(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()}
    odd = {(k, t) for k, t in all_rows if k is None or k > 900_000}
    for name, stage in cp.STAGES:
        out = stage(spark, docs, sf_dir)
        assert out.columns == [*columns, *(["mix_probability"] if name == "source mixing" else [])]
        kept = out.collect()
        assert all(r["a.b"] == "own a.b" and r.mix_tokens == "own mix_tokens" and r.key == "own key" for r in kept)
        found = {(r.doc_id, r.text) for r in kept}
        if name in ("toxicity", "benchmark decontamination"):
            assert odd <= found <= all_rows
            assert sum(r.doc_id == 900004 for r in kept) == 3
        elif name == "near-duplicates":
            # Null ids come first; texts without words are one group, repeated rows another, the long texts a third.
            assert {x for x in found if x in odd} == {(None, "a text without an id"), (None, None), (900004, "the same row twice, with password=abcdefgh12 in it"), (900004, "another text under a known id"), (900007, "ﬁ ß İ \0 \U0001f600")} | {x for x in odd if x[0] == 900005}
            assert sum(r.doc_id == 900004 for r in kept) == 2
        elif name == "secret scan":
            assert len(kept) == docs.count() and {k for k, _ in found} == {k for k, _ in all_rows}
            assert not any("abcdefgh12" in (t or "") for _, t in found) and (None, None) in found and (900002, "") in found
            assert all(r.n_chars == len(r.text) for r in kept if r.text is not None)
        else:
            assert found <= all_rows and all(0 <= r.mix_probability <= 1 for r in kept)
            assert sum(r.doc_id == 900004 and r.text.startswith("the same") for r in kept) in (0, 2)


def test_secret_scan_without_lengths(spark, sf_dir):
    docs = spark.createDataFrame([(1, "token = abcdefgh12345"), (2, None)], "doc_id long, text string")
    out = cp.without_secrets(spark, docs, sf_dir)
    assert out.columns == ["doc_id", "text"] and "abcdefgh" not in "".join(r.text or "" for r in out.collect())


def test_entry_without_the_subpackage(monkeypatch):
    import __spark_entry__ as entry

    assert {"pipeline", "op7_decontamination"} <= entry.queries().keys()
    monkeypatch.setitem(sys.modules, "vozlake.llm", None)
    monkeypatch.delitem(sys.modules, "corpus_pipeline")
    alone = importlib.reload(entry)
    assert "pipeline" not in alone.queries() and len(alone.queries()) > 100
    monkeypatch.undo()
    importlib.reload(entry)
