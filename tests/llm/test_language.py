import itertools
import zlib

import numpy as np
from pyspark.sql import functions as F

from vozlake.llm import language as lg


def cuts(line, index, longest):
    for marks in itertools.product((0, 1), repeat=len(line) - 1):
        places = [0, *(k + 1 for k, m in enumerate(marks) if m), len(line)]
        parts = [line[a:b] for a, b in zip(places, places[1:], strict=False)]
        if all(len(p) <= longest and (p in index or len(p) == 1) for p in parts):
            yield [index.get(p, len(index) + 1) for p in parts]


def test_sums_equal_all_segmentations():
    rng = np.random.default_rng(4)
    pieces = ["▁", "▁a", "a", "b", "ab", "ba", "aba", "▁ab", "bb"]
    index = {p: k for k, p in enumerate(pieces)}
    table = rng.random((len(pieces) + 2, 3))
    table[len(pieces)] = 0
    for length in (1, 2, 5, 7):
        words = list({"".join(rng.choice(list("abz"), length)) for _ in range(12)})
        lattice = lg.Lattice(words, lg.Pieces(pieces))
        sums = lattice.forward(table)[-1]
        use = lattice.expected(table[:, :1], np.arange(1.0, len(words) + 1))
        want_use = np.zeros(len(table))
        for k, word in enumerate(words):
            ways = list(cuts("▁" + word, index, 4))
            chances = [np.prod(table[way], axis=0) for way in ways]
            assert np.allclose(sums[k], np.sum(chances, axis=0))
            for way, chance in zip(ways, chances, strict=True):
                for piece in way:
                    want_use[piece] += (k + 1) * chance[0] / sums[k, 0]
        assert np.allclose(use, want_use)


def test_words_are_runs_of_letters():
    text = "Ünïcode ½ x2y ² Ⅷ _a_ 12 don't ﬁn İx " + "q" * 95 + "\u0301\n漢字"
    plain = ["".join(run) for alpha, run in itertools.groupby(text.lower(), str.isalpha) if alpha]
    want = [word[at : at + 40] for word in plain for at in range(0, len(word), 40)]
    assert lg.words_of(text) == want and lg.words_of("½ 12 _") == lg.words_of("") == []
    assert all(p == "▁" or p.removeprefix("▁").isalpha() for p in lg.load_pieces()) and max(map(len, lg.load_pieces())) > 12


def test_pieces_of_a_language_sum_to_one(spark):
    rows = [(x, "en") for x in ENGLISH] + [(x, "de") for x in GERMAN * 50] + [("½", "xx")]
    model = lg.fit(spark.createDataFrame(rows, "text string, lang string"))
    assert model.languages == ["de", "en"] and np.allclose(model.table[: model.pieces.count].sum(axis=0), 1)
    floors = model.table[: model.pieces.count].min(axis=0)
    assert np.allclose(floors, floors[0]) and floors[0] > 0


ENGLISH = ["the weather is fine and the children play in the garden", "where have you been this morning with that book", "nothing of this would have happened without them"]
GERMAN = ["das Wetter ist schön und die Kinder spielen im Garten", "wo bist du heute morgen mit dem Buch gewesen", "nichts davon wäre ohne sie geschehen"]


def test_edge_rows(spark):
    rows = [(k, f"{(ENGLISH if k % 2 else GERMAN)[k % 3]}", "en" if k % 2 else "de") for k in range(120)]
    rows += [(200, None, "en"), (201, "", None), (202, "12 ?! _", "de"), (203, "the " * 100_000, None), (204, "x" * 5000, None), (None, "die Kinder", "de"), (205, "漢字", None), (7, rows[7][1], "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("s")).withColumn("Word", F.lit(1)).withColumn("a.b", F.lit(1))
    got = lg.digest(docs).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    assert all(by_id[k].lang_pred == ("en" if k % 2 else "de") and by_id[k].score > 0.9 for k in range(120))
    assert [by_id[k].lang_pred for k in (200, 201, 202)] == ["und"] * 3 and by_id[200].score == 0
    assert by_id[203].lang_pred == "en" and by_id[None].lang_pred == "de" and not by_id[None].held_out
    assert by_id[205].lang_pred in ("de", "en") and 0 <= by_id[204].score <= 1
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    assert lg.digest(docs.limit(0)).count() == 0
    assert {r.lang_pred for r in lg.digest(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_held_out_documents_of_the_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = lg.digest(docs).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(held) > 150 and np.mean([r.lang == r.lang_pred for r in held]) > 0.97
