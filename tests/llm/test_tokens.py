import random

import pytest
import sentencepiece

from vozlake.llm import tokens as tk


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=tk.VOCABULARY)


@pytest.fixture(scope="module")
def words():
    return tk.Vocabulary.read(tk.VOCABULARY)


def random_text(rng, pieces):
    kind = rng.randrange(4)
    if kind == 0:
        return "".join(rng.choice(pieces).replace(tk.SPACE, " ") for _ in range(rng.randrange(12)))
    if kind == 1:
        return "".join(rng.choice("abcde  \n\t\0▁éß漢字\U0001f600<0x>") for _ in range(rng.randrange(40)))
    if kind == 2:
        return "".join(rng.choice("aeinrst") for _ in range(rng.randrange(60)))
    return "".join(rng.choice(pieces).replace(tk.SPACE, rng.choice(["", "  ", " "])) for _ in range(rng.randrange(30)))


def test_counts_equal_the_library(words, library):
    rng, machine = random.Random(1), tk.Transducer(words)
    texts = [random_text(rng, list(words.scores)) for _ in range(4000)]
    texts += [" " * k + w for k in range(70) for w in ("", "the", "xq", "\n", "漢")]
    assert [machine.count(t) for t in texts] == [len(x) for x in library.encode(texts)]


def test_chunks_and_forgotten_states_change_nothing(words, library):
    rng, machine = random.Random(2), tk.Transducer(words, most_states=50)
    for chunk in (1, 2, 3, 7, 50):
        texts = [random_text(rng, list(words.scores)) for _ in range(200)]
        assert [machine.count(t, chunk) for t in texts] == [len(x) for x in library.encode(texts)]


def test_composition_is_associative(words):
    rng, machine = random.Random(3), tk.Transducer(words)
    for _ in range(200):
        a, b, c = (machine.chunk_map("".join(rng.choice("ab▁c漢▁") for _ in range(rng.randrange(6)))) for _ in range(3))
        assert machine.compose(machine.compose(a, b), c) == machine.compose(a, machine.compose(b, c))


def test_a_small_vocabulary_equals_plain_merging():
    rng = random.Random(4)
    for _ in range(30):
        pieces = list("ab") + [tk.SPACE]
        while len(pieces) < 14:
            new = rng.choice(pieces) + rng.choice(pieces)
            if new not in pieces and tk.SPACE not in new[1:]:
                pieces.append(new)
        machine = tk.Transducer(tk.Vocabulary({p: float(-k) for k, p in enumerate(pieces)}))
        for _ in range(100):
            text = "".join(rng.choice("aabb ") for _ in range(rng.randrange(1, 25)))
            assert machine.count(text, rng.choice([2, 5, 99])) == len(machine.words.merge(tk.SPACE + text.replace(" ", tk.SPACE)))


def test_edge_rows(spark, library):
    long = "word " * 100_000 + "x" * 100_000
    rows = [(None, "a b", 1), (1, None, 2), (1, None, 2), (2, "", 3), (3, long, 4), (3, "é 漢 \U0001f600", 5), (5, "<s> </s> <unk> <0x41>", 6)]
    got = tk.digest(spark.createDataFrame(rows, "doc_id long, text string, N_TOKENS int").withColumn("n_bytes", tk.F.lit("x")))
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    want = [(k, len((t or "").encode()), n := len(library.encode(t or "")), n > 4096) for k, t, _ in rows]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert tk.digest(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_whole_table_equals_the_library(spark, sf_dir, library):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = {r.doc_id: (len((r.text or "").encode()), len(library.encode(r.text or ""))) for r in docs.collect()}
    assert {r.doc_id: (r.n_bytes, r.n_tokens) for r in tk.digest(docs).collect()} == want
