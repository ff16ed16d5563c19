import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from vozlake.llm import decontaminate as dc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items):
    out = []
    for key, text in docs:
        mine, hit, ids = words(text), set(), set()
        for item, body in items:
            other = words(body)
            n = min(13, len(other))
            for i in range(len(other) - n + 1) if n else ():
                for j in range(len(mine) - n + 1):
                    if mine[j : j + n] == other[i : i + n]:
                        hit.update(range(j, j + n))
                        ids.update([] if item is None else [str(item)])
        joined = ",".join(sorted(ids))
        out.append((key, len(mine), len(hit), len(ids), hashlib.sha256(joined.encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(mine)))
    return sorted(out, key=repr)


def cases():
    rng = random.Random(5)
    vocabulary = ["Ab", "b", "C", "É", "ünd", "7x", "ß"]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(1, say(30)), (2, say(13)), (3, say(13)), (10, "b c"), (11, say(7)), (12, say(5)), (4, None), (5, ""), (None, "zz zz zz"), (2, "again twice")]
    docs = [(0, None), (1, ""), (2, " ... "), (3, "b, C!"), (4, "b-c zz ZZ zz"), (5, items[0][1].replace(" ", "--")), (5, items[0][1].replace(" ", "--")), (None, "x " + items[1][1]), (None, say(20))]
    for key in range(6, 60):
        body = say(rng.randrange(60)).split(" ")
        for _ in range(rng.randrange(3)):
            at, item = rng.randrange(len(body) + 1), words(rng.choice(items[:6])[1])
            start = rng.randrange(len(item))
            body[at:at] = item[start : start + rng.choice((5, 12, 13, 20))]
        docs.append((key, " ".join(body)))
    return docs, items


@pytest.mark.parametrize("broadcast", [10**6, 0])
def test_equals_a_plain_search(spark, broadcast):
    docs, items = cases()
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("window", F.lit("w")).withColumn("a.b", F.lit(2)).withColumn("Spans", F.lit(1)).withColumn("id", F.lit(1))
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("items", F.lit(1))
    found = dc.measure(df, bench, broadcast_windows=broadcast)
    assert found.columns == [*df.columns, "contamination"]
    c = F.col("contamination")
    got = found.select("doc_id", c["n_words"], c["n_hit"], F.size(c["items"]), F.sha2(F.array_join(c["items"], ","), 256), dc.contaminated(c)).collect()
    assert sorted([tuple(r) for r in got], key=repr) == brute(docs, items)


def test_digest_with_long_text_and_empty_tables(spark):
    long = " ".join(f"w{i}" for i in range(100_000))
    docs = [(1, long), (2, "a b")]
    items = [(7, " ".join(f"w{i}" for i in range(50_000, 50_020)))]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert sorted([tuple(r) for r in dc.digest(df, bench).collect()], key=repr)[0][1:4] == (100_000, 20, 1)
    assert dc.digest(df.limit(0), bench).count() == 0
    assert [r.n_hit for r in dc.digest(df, bench.limit(0)).collect()] == [0, 0]


def test_removal_of_spans_and_documents(spark):
    item = " ".join(f"w{i}" for i in range(15))
    docs = [(1, f"keep, {item.upper()}; this. " + "word " * 500), (2, f"«{item}»"), (3, "clean Text"), (4, None)]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string")
    kept = {r.doc_id for r in dc.remove(df, bench).collect()}
    assert kept == {1, 3, 4}
    cut = {r.doc_id: r.text for r in dc.remove(df, bench, mode="spans").collect()}
    assert words(cut[1]) == ["keep", "this"] + ["word"] * 500 and cut[3] == "clean Text" and cut[4] is None and cut.keys() == {1, 2, 3, 4}


def test_no_python_in_the_plan(spark, sf_dir):
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    plan = dc.digest(read("documents"), read("benchmark"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan) and "BroadcastHashJoin" in plan
