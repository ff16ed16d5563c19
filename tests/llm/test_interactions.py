import random
import re
from collections import Counter
from itertools import permutations

from vozlake.llm import interactions as ia

SCHEMA = "doc_id long, text string, lang string"


def plain(rows, labels):
    """One row for each part, order and step, by walking the documents through the filters."""
    rows = [(k, t or "", p or "") for k, t, p in rows]
    least = {}
    for k, t, _ in rows:
        if k is not None:
            least[t] = min(least.get(t, k), k)
    good, toxic = ({k for k, *x in labels if k is not None and x[i] == 1} for i in (0, 1))

    def fails(k, t):
        words = [w for w in re.split("[\x20\x09-\x0d]+", t) if w]
        out = {"A"} if len(words) < 200 else set()
        out |= {"B"} if 100 * len(set(words)) < 50 * len(words) else set()
        out |= {"C"} if 100 * len(re.findall("[A-Z]", t)) > 3 * len(t) else set()
        out |= {"D"} if re.search("[#$%&*|]", t) else set()
        return out | ({"E"} if k is not None and least[t] < k else set())

    out, shapley = {}, Counter()
    for part in {p for *_, p in rows}:
        own = [(k, fails(k, t)) for k, t, p in rows if p == part]
        for order in permutations("ABCDE"):
            left = own
            for step, name in enumerate(order, 1):
                gone = [(k, f) for k, f in left if name in f]
                left = [(k, f) for k, f in left if name not in f]
                failing = [f for _, f in own if name in f]
                shapley[part, name] += len(gone)
                out[part, "".join(order), step] = (len(left), len(gone), len(failing) - len(gone), sum(f == {name} for f in failing), sum(k in good for k, _ in gone), sum(k in toxic for k, _ in gone))
    return sorted((p, o, s, *v, shapley[p, o[s - 1]]) for (p, o, s), v in out.items())


def check(spark, rows, labels):
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as n", "'x' as part", "2 as digest", "true as A").repartition(3)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").selectExpr("*", "0 as n", "1 as id")
    got = ia.digest(docs, marks)
    assert got.columns == ["part", "filter_order", "step", *ia.COUNTS]
    assert sorted(map(tuple, got.collect())) == plain(rows, labels)


def random_text(rng):
    words = [rng.choice(["a", "b", "Ab", "é", "W", "x#"] if rng.random() < 0.3 else [f"w{k}" for k in range(300)]) for _ in range(rng.choice([0, 3, 199, 200, 260]))]
    return rng.choice([" ", "\n", "\t \x0b", "  "]).join(words)


def test_equals_a_walk_through_the_filters(spark):
    rng = random.Random(5)
    texts = [random_text(rng) for _ in range(40)]
    rows = [(k, rng.choice(texts), rng.choice(["en", "fr", "", None])) for k in range(150)]
    check(spark, rows, [(k, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for k in range(0, 150, 2)])


def test_edge_rows(spark):
    long = "Word " * 100_000
    rows = [(None, "same", "en"), (None, "same", "en"), (1, "same", "en"), (1, "same", "en"), (1, "same", None), (2, "same", "fr"), (3, None, "en"), (4, "", "en"), (5, long, "de"), (6, long, "de"), (7, " \t ", None)]
    check(spark, rows, [(1, 1, 0), (1, 0, 1), (2, 1, 1), (None, 1, 1), (9, 1, 1), (6, None, 1)])
    assert ia.digest(spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


def test_other_numbers_of_filters(spark):
    cells = spark.createDataFrame([("p", True, False, 3, 1, 0), ("p", True, True, 2, 0, 2), ("p", False, True, 5, 5, 0)], "part string, x boolean, y boolean, n long, good long, toxic long")
    got = sorted(map(tuple, ia.audit(cells, ["x", "y"]).collect()))
    assert got == [("p", "xy", 1, 5, 5, 0, 3, 1, 2, 8), ("p", "xy", 2, 0, 5, 2, 5, 5, 0, 12), ("p", "yx", 1, 3, 7, 0, 5, 5, 2, 12), ("p", "yx", 2, 0, 3, 2, 3, 1, 0, 8)]
