import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from vozlake.llm import simhash as sh


def plain_print(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, bits=2):
    root = list(range(len(prints)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= bits:
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(k) for k in range(len(prints))]


def plain_digest(rows):
    prints = [plain_print(text) for _, text in rows]
    roots = plain_components(prints)
    least = {}
    for (key, _), root in zip(rows, roots, strict=True):
        least[root] = min((x for x in (least.get(root), key) if x is not None), default=None)
    return sorted(((key, f"{p:016x}", least[r]) for (key, _), p, r in zip(rows, prints, roots, strict=True)), key=repr)


def test_fingerprints_equal_the_definition(spark):
    rng = random.Random(1)
    texts = [None, "", " \t\n", "One", "one\x0btwo", "A  b\x85c d É é"] + [" ".join(rng.choice(["Aa", "b", "ccc", "É"]) for _ in range(rng.randrange(1, 60))) for _ in range(200)]
    assert [sh.fingerprint(t) for t in texts] == [plain_print(t) for t in texts]
    df = spark.createDataFrame([(t,) for t in ("one", "one two three")], "text string")
    native = df.select(F.xxhash64("text").alias("h")).collect()
    assert [sh.signed(sh.fingerprint(t)) for t in ("one", "one two three")] == [r.h for r in native]


@pytest.mark.parametrize("leaf_rows", [5, 40, 10_000])
def test_components_of_dense_and_sparse_points(spark, leaf_rows):
    rng = random.Random(leaf_rows)
    points = {rng.getrandbits(64) for _ in range(150)}
    centre = rng.getrandbits(64)
    for _ in range(250):  # a dense ball, with chains that leave it
        point = centre
        for _ in range(rng.randrange(8)):
            point ^= 1 << rng.randrange(14)
        points.add(point)
    walk = rng.getrandbits(64)
    for _ in range(60):
        walk ^= 3 << rng.randrange(63)
        points.add(walk)
    points = sorted(points)
    nodes = spark.createDataFrame([(sh.signed(p),) for p in points], "fp long")
    sample = np.array(points[:: 1 if leaf_rows < 10 else 3], np.uint64)
    tree = sh.grow(sample, len(points) // leaf_rows, 2)
    assert tree.leaves >= len(points) // leaf_rows // 2
    labels = {r.fp & (1 << 64) - 1: r.root for r in sh.components(sh.find_links(nodes, tree)).collect()}
    got = {}
    for p in points:
        got.setdefault(labels.get(p, sh.signed(p)), set()).add(p)
    want = {}
    for p, root in zip(points, plain_components(points), strict=True):
        want.setdefault(root, set()).add(p)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_links_stay_few_in_a_dense_group(spark):
    points = np.array([a ^ b for a in (1 << k for k in range(40)) for b in (1 << k for k in range(40))], np.uint64)
    nodes = spark.createDataFrame([(int(p),) for p in np.unique(points)], "fp long")
    n = nodes.count()
    tree = sh.grow(np.unique(points), 4, 2)
    assert sh.find_links(nodes, tree).count() <= 2 * tree.leaves * n


def rows_with_copies():
    rng = random.Random(9)
    say = lambda n: " ".join(rng.choice("abcdefghij") + rng.choice("klmnop") for _ in range(n))
    rows = [(1, None), (2, ""), (3, "x"), (None, "x"), (3, "x"), (3, say(50)), (None, None), (None, "only here"), (8, "word " * 30_000)]
    for key in range(10, 60):
        base = say(300)
        rows.append((key, base))
        for copy in range(rng.randrange(3)):
            words = base.split()
            for _ in range(copy):
                words[rng.randrange(len(words))] = "zz"
            rows.append((key + 100 * (copy + 1), " ".join(words)))
    return rows


def test_digest_and_deduplication_equal_a_plain_search(spark):
    rows = rows_with_copies()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("Root", F.lit(1)).withColumn("fp", F.lit("x")).withColumn("a.b", F.lit(1))
    want = plain_digest(rows)
    assert sorted(map(tuple, sh.digest(df).collect()), key=repr) == want
    kept = sh.deduplicate(df, leaf_rows=20)
    assert kept.columns == df.columns
    prints = [plain_print(t) for _, t in rows]
    assert kept.count() == len(set(plain_components(prints)))
    by_group = {}
    for (key, _), root in zip(rows, plain_components(prints), strict=True):
        by_group.setdefault(root, []).append(key)
    assert sorted([r.doc_id for r in kept.collect()], key=repr) == sorted([None if None in ids else min(ids) for ids in by_group.values()], key=repr)
    assert sh.digest(df.limit(0)).count() == 0 and sh.deduplicate(df.limit(0)).count() == 0


def test_whole_table_equals_a_plain_search(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert sorted(map(tuple, sh.digest(docs).collect()), key=repr) == plain_digest([(r.doc_id, r.text) for r in docs.collect()])
