import random

import corpus_pipeline as cp
from test_simhash import rows_with_copies
from vozlake.llm import copies as cs


def plain_set(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} or ({tuple(words)} if words else set())


def plain_groups(texts):
    sets, root = [plain_set(t) for t in texts], list(range(len(texts)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(k) for k in range(len(texts))]


def replaced(rng, words, count):
    words = list(words)
    for k in rng.sample(range(len(words)), count):
        words[k] = f"new{rng.randrange(10**9)}"
    return words


def kept_plain(rows):
    by_group = {}
    for (key, _), root in zip(rows, plain_groups([t for _, t in rows]), strict=True):
        by_group.setdefault(root, []).append(key)
    return sorted((None if None in ids else min(ids) for ids in by_group.values()), key=repr)


def kept(stage):
    return sorted((r.doc_id for r in stage.collect()), key=repr)


def test_stage_finds_copies_with_replaced_words(spark):
    rng, rows = random.Random(3), []
    for k, (length, count) in enumerate([(100, 1), (300, 1), (300, 5), (1000, 5), (1000, 20)] * 12):
        words = [f"w{rng.randrange(5000)}" for _ in range(length)]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(replaced(rng, words, count)).upper())]
    got = kept(cp.without_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), ""))
    assert got == [k for k in sorted(range(0, 120, 2), key=repr)] == kept_plain(rows)


def test_groups_with_chains_equal_a_plain_search(spark):
    rng, rows = random.Random(4), rows_with_copies()
    base = [f"h{k}" for k in range(200)]
    # Around the least similarity: the first text of a bucket isn't similar to all others.
    rows += [(1000 + k, " ".join(replaced(rng, base, rng.randrange(6)))) for k in range(150)]
    walk = base[::-1]
    for k in range(30):
        walk = replaced(rng, walk, 3)
        rows.append((2000 + k, " ".join(walk)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert kept(cs.deduplicate(df)) == kept_plain(rows)
    assert cs.deduplicate(df.limit(0)).count() == 0


def test_whole_table_equals_a_plain_search(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert kept(cp.without_copies(spark, docs, sf_dir)) == kept_plain(rows)


def test_slices_of_a_bucket_change_nothing(spark):
    rng, rows = random.Random(6), []
    base = [f"s{k}" for k in range(120)]
    for k in range(120):
        rows.append((k, " ".join(replaced(rng, base, rng.randrange(9)))))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for slices in ({}, {"slice_nodes": 7}, {"slice_bytes": 2000}):
        assert kept(cs.deduplicate(df, **slices)) == kept_plain(rows)


def test_shared_counts():
    rng = random.Random(7)
    for _ in range(200):
        one, other = (set(rng.sample(range(40), rng.randrange(20))) for _ in range(2))
        a, b = (cs.np.array(sorted(x), cs.np.uint64) for x in (one, other))
        assert cs.shared(a, b) == len(one & other)
        up, down = cs.SIMILAR
        assert cs.similar(a.tobytes(), b.tobytes()) == (len(one & other) * down >= up * len(one | other))


def test_edge_rows(spark):
    long = " ".join(f"w{k}" for k in range(100_000))
    rows = [(None, "a b"), (None, "a b"), (None, "c"), (1, None), (2, ""), (2, ""), (3, " \t"), (4, long), (5, long + " more"), (6, "A B"), (7, "c"), (7, "d")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as node", "'x' as key", "2 as size", "3 as id", "4 as root", "5 as text_hash")
    got = cs.deduplicate(df)
    assert got.columns == df.columns
    assert sorted((r.doc_id, (r.text or "")[:9]) for r in got.collect() if r.doc_id) == [(1, ""), (4, long[:9]), (7, "d")]
    assert sorted(r.text for r in got.collect() if r.doc_id is None) == ["a b", "c"]
