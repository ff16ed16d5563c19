import corpus_pipeline as cp
from vozlake.llm import copies, simhash


def test_the_pipeline_links_what_fingerprints_link(spark, sf_dir):
    chorus = " ".join(["one two three four five"] * 400)
    texts = [chorus + " " + " ".join(f"{side}{k}" for k in range(12)) for side in "ab"] + ["something else is said here today", None]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    assert len({r.root for r in copies.groups(docs).collect()}) == 4
    assert len({r.root for r in simhash.groups(docs, shingle=copies.SHINGLE).collect()}) == 3
    assert sorted(r.doc_id for r in cp.without_copies(spark, docs, sf_dir).collect()) == [0, 2, 3]


def test_given_links_join_groups(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (1, "g h i j k l"), (1, "m n o p q r"), (2, "g h i j k l")], "doc_id long, text string")
    own = copies.groups(docs)
    given = own.where("id is null or id = 2").selectExpr("id", "text_hash", "7L AS root")
    roots = {(r.id, r.text_hash): r.root for r in copies.groups(docs, linked=given).collect()}
    assert len(roots) == 4 and len(set(roots.values())) == 2
