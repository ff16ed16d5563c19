import hashlib
import random
import re

from pyspark.sql import functions as F

from vozlake.llm import secrets as sc

ASSIGN = re.compile(r"""((?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def brute(text):
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return [(sc.KINDS[k], s, e) for s, k, e in sorted(found)]


def base(text):
    return [x for x in sc.find_spans(text) if x[0] in sc.BASE]


def test_base_spans_equal_a_plain_search():
    rng = random.Random(3)
    parts = ["password", "PassWD", "secret", "ToKen", "api_key", "apikey", "AKIA", "akia", " ", "=", ":", '"', "'", "0123456789abcdef", "f", "a1", "Z", "é", "ſecret", "İ", "toKen", "\n", "_", "AB12"]
    for _ in range(6000):
        text = "".join(rng.choice(parts) * rng.choice((1, 1, 2)) for _ in range(rng.randrange(24)))
        assert base(text) == brute(text), text


def test_hex_runs_of_every_length_and_place():
    for lead in range(40):
        for length in range(28, 70):
            text = "g" * lead + "a" * length + "g" + "b" * 31 + "-" + "c" * 33
            assert base(text) == brute(text)


def test_checksums_decide_on_tokens():
    body = "abcdefghijklmnopqrstuvwxyz0123"
    good = body + sc.checksum62(body)
    bad = body + ("0" if good[-6] != "0" else "1") + good[-5:]
    text = f"x ghp_{good} ghp_{bad} npm_{good} ghs_{good}0 é"
    assert [k for k, _, _ in sc.find_spans(text)] == ["github", "npm"]


def test_edge_rows_and_clashing_columns(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "token = abcdefgh1", "y"), (3, "token = abcdefgh1", "y"), (None, "é AKIA" + "B" * 12, "z"), (5, "z" * 300_000 + " secret:12345678", "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string").withColumn("a.b", F.lit(1))
    got = {(r.doc_id, r.spans) for r in sc.digest(df).collect()}
    assert got == {(1, ""), (2, ""), (3, "assign:0:17"), (None, "access:2:18"), (5, "assign:300001:300016")}
    assert sc.digest(df).count() == 6
    empty = [r for r in sc.digest(df).collect() if r.doc_id == 1][0]
    assert empty.base_sha256 == hashlib.sha256(b"").hexdigest() and empty.n_hex == 0
    masked = {r.text for r in sc.redact(df).collect() if r.text is not None and len(r.text) < 99}
    assert masked == {"", "[secret]", "é [secret]"} and sc.redact(df).columns == df.columns
    assert sc.digest(df.limit(0)).count() == 0


def test_whole_table_equals_a_plain_search(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = {r.doc_id: ",".join(f"{k}:{s}:{e}" for k, s, e in brute(r.text)) for r in docs.collect()}
    got = {r.doc_id: r for r in sc.digest(docs).collect()}
    assert got.keys() == want.keys()
    assert all(hashlib.sha256(want[k].encode()).hexdigest() == got[k].base_sha256 for k in want)
