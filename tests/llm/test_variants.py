import random
import re
import zlib
from collections import Counter
from itertools import combinations

import pandas as pd

from vozlake.llm import variants as vr

SCHEMA = "doc_id long, text string"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_words(rows):
    found = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(UPPER)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= 6 and n >= 5}


def one_apart(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain(words):
    near = {w: [o for o in words if one_apart(w, o)] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-words[o], o), default=None)
        form[w] = best if best and words[best] >= 5 * words[w] else None
    rows = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        rows.append((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return sorted(rows, key=repr)


def changed(rng, word, alphabet):
    at, kind = rng.randrange(len(word)), rng.randrange(3)
    return word[:at] + ("" if kind == 0 else rng.choice(alphabet)) + word[at + (kind != 1) :]


def got(df):
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted(map(tuple, df.collect()), key=repr)


def test_texts_equal_a_plain_search(spark):
    rng, words = random.Random(8), {}
    for _ in range(40):
        word = "".join(rng.choice("aábcÉ÷") for _ in range(rng.randrange(5, 10)))
        for n in (300, 40, 6):
            words[word] = n
            word = changed(rng, word, "aábcÉ÷")
    flat = [w for w, n in words.items() for _ in range(n)]
    rng.shuffle(flat)
    rows = [(k, rng.choice([" ", "-", "\n", "1"]).join(flat[k * 30 : k * 30 + 30]).replace("b", "B")) for k in range(-(-len(flat) // 30))]
    rows += [(None, "summer " * 3), (None, "summer " * 2), (3, None), (3, ""), (4, "x" * 100_000), (4, "x" * 100_000), (5, "Straße ŒUVRE " * 9)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as n", "'x' as word", "2 as signature").repartition(3)
    assert got(vr.digest(df)) == plain(plain_words(rows))


def test_words_equal_a_plain_search(spark):
    rng, words = random.Random(9), {}
    for _ in range(60):
        word = "".join(rng.choice("abc") for _ in range(rng.randrange(6, 12)))
        for _ in range(6):
            words[word] = rng.choice([5, 5, 25, 26, 125, 700, 4000])
            word = changed(rng, word, "abcd")
    table = spark.createDataFrame(list(words.items()), "word string, n long")
    assert got(vr.group(table).select("word", "form", "root", "n", "n_near", "form_n")) == plain(words)
    assert vr.group(table.limit(0)).count() == 0


def test_long_chains_reach_their_root(spark):
    words = {"abcdef" + "g" * k: 5**k for k in range(1, 14)}
    rows = got(vr.group(spark.createDataFrame(list(words.items()), "word string, n long")).select("word", "form", "root", "n", "n_near", "form_n"))
    assert rows == plain(words) and {r[2] for r in rows} == {"abcdef" + "g" * 13}


def test_near_words_share_a_signature():
    rng = random.Random(10)
    for parts in (3, 5, 7):
        assert len(list(combinations(range(parts), vr.PLACES))) == vr.signatures(pd.Series(["abcdef"]), parts).shape[1]
        for _ in range(300):
            word = "".join(rng.choice("aabcdeéz") for _ in range(rng.randrange(2, 15)))
            a, b = vr.signatures(pd.Series([word, changed(rng, word, "abxyé")]), parts)
            assert (a == b).any()


def test_no_table_of_words_is_broadcast(spark):
    table = spark.createDataFrame([("abcdef", 500), ("abcdeg", 20), ("abcdegh", 5)], "word string, n long")
    for df in (vr.near_pairs(vr.materialize(table)), vr.group(table)):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, vr.near_pairs(table).collect())) == [("abcdef", 500, "abcdeg", 20), ("abcdeg", 20, "abcdegh", 5)]
