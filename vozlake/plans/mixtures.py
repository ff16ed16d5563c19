"""Queries on splits, mixtures, caps and fingerprints."""

from __future__ import annotations

from pyspark.sql import functions as F

from vozlake.functions import text as tx
from vozlake.operators import splits as sp
from vozlake.plans import roles
from vozlake.plans.curation import _OK
from vozlake.plans.registry import query
from vozlake.plans.roles import s_tokens, using

WEIGHTS = {"src0": 0.15, "src1": 2.0, "src2": 2.5, "src3": 0.0, "src4": 0.3}


def rows(t):
    return roles.clips(t).withColumnRenamed("speaker", "source")


_HOLD = """c AS (SELECT *, speaker AS source FROM clips),
        h AS (SELECT *, count(*) OVER (PARTITION BY source) AS n,
        row_number() OVER (PARTITION BY source ORDER BY md5('777|' || audio)) AS rn FROM c),
        s AS (SELECT * EXCLUDE (n, rn), CASE WHEN n >= 2 AND rn <= least(greatest(1, floor(n * 0.05::DOUBLE + 0.5)), n - 1) THEN 'holdout' ELSE 'train' END AS split FROM h)"""


@query("holdout_split", using("clips", body=f"WITH {_HOLD} SELECT id, source, split FROM s"))
def holdout_split(t):
    return sp.split_holdout(rows(t), 0.05).select("id", "source", "split")


@query("holdout_sizes", using("clips", body=f"WITH {_HOLD} SELECT source, split, count(*) AS n, round(sum(dur_s), 2) AS seconds FROM s GROUP BY 1, 2"))
def holdout_sizes(t):
    return sp.split_holdout(rows(t), 0.05).groupBy("source", "split").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("dur_s"), 2).alias("seconds"))


_MIX = f"""{_HOLD}, tr AS (SELECT * FROM s WHERE split = 'train'),
        w AS (SELECT source, count(*) AS n, CASE source WHEN 'src0' THEN 0.15::DOUBLE WHEN 'src1' THEN 2.0 WHEN 'src2' THEN 2.5 WHEN 'src3' THEN 0.0 WHEN 'src4' THEN 0.3 ELSE 1.0 END AS weight FROM tr GROUP BY 1),
        u AS (SELECT *, CASE WHEN weight > 0 THEN greatest(1, floor(n * weight + 0.5))::BIGINT ELSE 0 END AS used FROM w),
        k AS (SELECT tr.*, u.n, u.used, row_number() OVER (PARTITION BY source ORDER BY md5('42|' || audio)) AS rn FROM tr JOIN u USING (source)),
        m AS (SELECT id, audio, source, unnest(range(used // n + CASE WHEN rn <= used % n THEN 1 ELSE 0 END)) AS pass FROM k)"""


@query("weighted_mixture", using("clips", body=f"WITH {_MIX} SELECT id, source, pass, md5('42-mix|' || pass || '|' || source || '|' || audio) AS mix_key FROM m"))
def weighted_mixture(t):
    train = sp.split_holdout(rows(t), 0.05).where("split = 'train'")
    return sp.apply_mix(train, WEIGHTS).select("id", "source", "pass", "mix_key")


@query("mixture_composition", using("clips", body=f"WITH {_MIX} SELECT source, weight, n AS clips, used FROM u"))
def mixture_composition(t):
    train = sp.split_holdout(rows(t), 0.05).where("split = 'train'")
    return sp.composition(sp.apply_mix(train, WEIGHTS), train, WEIGHTS)


@query("mixture_leaks", using("clips", body=f"WITH {_MIX} SELECT audio FROM m INTERSECT SELECT audio FROM s WHERE split = 'holdout'"))
def mixture_leaks(t):
    split = sp.split_holdout(rows(t), 0.05)
    return sp.leaks(sp.apply_mix(split.where("split = 'train'"), WEIGHTS), split.where("split = 'holdout'"))


@query(
    "weights_without_match",
    using("clips", body="SELECT DISTINCT speaker AS source, 'no weight' AS problem FROM clips WHERE speaker NOT IN ('src0','src1','src2','src3','src4') UNION ALL SELECT w, 'no source' FROM (VALUES ('src0'),('src1'),('src2'),('src3'),('src4')) v(w) WHERE w NOT IN (SELECT speaker FROM clips)"),
)
def weights_without_match(t):
    return sp.unknown_weights(rows(t), WEIGHTS)


@query(
    "train_val_split",
    using(
        "clips",
        body="""SELECT id, CASE WHEN row_number() OVER (ORDER BY md5('42|' || id)) <= greatest(1, floor(count(*) OVER () * 0.03::DOUBLE)) THEN 'val' ELSE 'train' END AS split FROM clips""",
    ),
)
def train_val_split(t):
    return sp.split_validation(rows(t)).select("id", "split")


@query(
    "hours_cap",
    using(
        "clips",
        body="""SELECT source, count(*) AS kept, round(sum(dur_s), 2) AS seconds FROM (SELECT speaker AS source, dur_s,
        coalesce(sum(dur_s) OVER (PARTITION BY speaker ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM clips)
        WHERE before < 180 GROUP BY 1""",
    ),
)
def hours_cap(t):
    return sp.hours_cap(rows(t), 0.05).groupBy("source").agg(F.count(F.lit(1)).alias("kept"), F.round(F.sum("dur_s"), 2).alias("seconds"))


@query(
    "first_per_source",
    using("clips", body="SELECT id, speaker AS source FROM clips QUALIFY row_number() OVER (PARTITION BY speaker ORDER BY seq) <= 5"),
)
def first_per_source(t):
    return sp.first_n(rows(t), 5).select("id", "source")


@query(
    "text_extremes",
    using(
        "clips",
        body="""(SELECT id, length(text) AS chars, 'short' AS "end" FROM clips ORDER BY length(text), id LIMIT 2)
        UNION ALL (SELECT id, length(text), 'long' FROM clips ORDER BY length(text) DESC, id LIMIT 2)""",
    ),
)
def text_extremes(t):
    return sp.extremes(rows(t)).select("id", F.length("text").alias("chars"), "end")


@query(
    "anchor_positions",
    using(
        "clips",
        body="""WITH r AS (SELECT speaker, audio, row_number() OVER (PARTITION BY speaker ORDER BY audio) - 1 AS position, count(*) OVER (PARTITION BY speaker) AS n FROM clips)
        SELECT speaker, audio, position FROM r WHERE n <= 3 OR position IN (0, (n - 1) // 2, n - 1)""",
    ),
)
def anchor_positions(t):
    return sp.pick_anchors(roles.clips(t)).select("speaker", "audio", "position")


@query(
    "reference_clips",
    using(
        "clips",
        body=f"""SELECT speaker, id, 'auto' AS pick FROM clips WHERE dur_s BETWEEN 5 AND 10 AND len({s_tokens("text")}) >= 8
        QUALIFY row_number() OVER (PARTITION BY speaker ORDER BY seq) <= 2
        UNION ALL SELECT speaker, id, 'neutral' FROM clips WHERE style = 'neutro' AND dur_s BETWEEN 3 AND 10
        QUALIFY row_number() OVER (PARTITION BY speaker ORDER BY seq) <= 1""",
    ),
)
def reference_clips(t):
    c = roles.clips(t)
    auto = sp.first_n(c.where(F.col("dur_s").between(5, 10) & (tx.token_count(F.col("text")) >= 8)), 2, "speaker")
    neutral = sp.first_n(c.where((F.col("style") == "neutro") & F.col("dur_s").between(3, 10)), 1, "speaker")
    return auto.select("speaker", "id", F.lit("auto").alias("pick")).unionByName(neutral.select("speaker", "id", F.lit("neutral").alias("pick")))


@query(
    "corpus_hours",
    using(
        "manifest",
        body=f"""WITH x AS (SELECT source, dur_s, coalesce(shippable, {_OK}) AS ship FROM manifest)
        SELECT coalesce(source, 'TOTAL') AS source, count(*) AS clips, round(sum(dur_s) / 3600, 6) AS hours, count(*) FILTER (ship) AS shippable,
        count(*) FILTER (NOT ship) AS research FROM x GROUP BY ROLLUP (source)""",
    ),
)
def corpus_hours(t):
    return sp.corpus_hours(roles.manifest(t))


@query(
    "estimated_hours",
    using(
        "clips",
        body="""SELECT (SELECT count(*) FROM clips) AS clips, round((SELECT avg(dur_s) FROM clips WHERE ('0x' || substr(md5('42|' || seq), 1, 8))::BIGINT < 429496729) * (SELECT count(*) FROM clips) / 3600, 6) AS estimated_hours,
        round((SELECT sum(dur_s) FROM clips) / 3600, 6) AS exact_hours""",
    ),
)
def estimated_hours(t):
    return sp.estimated_hours(rows(t))


_LANES = ", ".join(f"sum(('0x' || substr(d, {1 + 10 * i}, 10))::HUGEINT)::VARCHAR AS s{i}" for i in range(4))


@query(
    "content_fingerprint",
    using(
        "clips",
        body=f"""WITH d AS (SELECT speaker, sha1(concat_ws('|', audio, text)) AS d FROM clips),
        x AS (SELECT count(*) AS n, {_LANES} FROM d)
        SELECT m AS mode, n AS rows, substr(sha1(concat_ws('|', m, n::VARCHAR, s0, s1, s2, s3)), 1, 16) AS fingerprint FROM x, (VALUES ('raw'), ('normalize')) v(m)""",
    ),
)
def content_fingerprint(t):
    c = roles.clips(t)
    one = lambda mode: sp.fingerprint(c, ["audio", "text"], mode).select(F.lit(mode).alias("mode"), "rows", "fingerprint")
    return one("raw").unionByName(one("normalize"))


@query(
    "speaker_buckets",
    """SELECT source, list_reduce(
        list_transform(string_split(md5(source), ''), lambda c: instr('0123456789abcdef', c) - 1), lambda a, b: (a * 16 + b) % 10, 0)::INTEGER AS bucket, count(*) AS n
        FROM documents GROUP BY 1""",
)
def speaker_buckets(t):
    return t.documents.groupBy("source").agg(F.count(F.lit(1)).alias("n")).select("source", sp.speaker_bucket(F.col("source")).alias("bucket"), "n")


@query(
    "clip_references",
    using("clips", body=f"""WITH f AS (SELECT speaker, id, seq FROM clips WHERE dur_s BETWEEN 5 AND 10 AND len({s_tokens("text")}) >= 8 QUALIFY row_number() OVER (PARTITION BY speaker ORDER BY seq) <= 3),
        r AS (SELECT c.id, f.id AS ref, f.seq FROM clips c JOIN f ON f.speaker = c.speaker AND f.id <> c.id QUALIFY row_number() OVER (PARTITION BY c.id ORDER BY f.seq) <= 2)
        SELECT id, coalesce(string_agg(ref, ',' ORDER BY r.seq), '') AS refs FROM clips LEFT JOIN r USING (id) GROUP BY 1"""),
)
def clip_references(t):
    c = roles.clips(t)
    return sp.references(c, F.col("dur_s").between(5, 10) & (tx.token_count(F.col("text")) >= 8)).select("id", F.array_join("references", ",").alias("refs"))


#: Clips of the half and half mix.
MIXED_CLIPS = 1000


@query(
    "half_half_mix",
    f"""SELECT source, audio, md5(text) AS text_md5, md5(concat_ws('|', '42', source, audio)) AS mix_key FROM (
        SELECT 'docs' AS source, 'd' || doc_id AS audio, text FROM documents QUALIFY row_number() OVER (ORDER BY doc_id) <= {MIXED_CLIPS // 2}
        UNION ALL SELECT 'talk', 'c' || conv_id || '-' || turn, text FROM conversations QUALIFY row_number() OVER (ORDER BY conv_id, turn) <= {MIXED_CLIPS // 2})""",
)
def half_half_mix(t):
    name = lambda *cols: F.concat(*[F.lit(c) if c in "dc-" else F.col(c).cast("string") for c in cols])
    docs = t.documents.select(F.col("doc_id").alias("seq"), name("d", "doc_id").alias("audio"), "text")
    talk = t.conversations.select((F.col("conv_id") * roles.TURNS + F.col("turn")).alias("seq"), name("c", "conv_id", "-", "turn").alias("audio"), F.col("text").alias("transcript"))
    return sp.half_half(docs, talk, MIXED_CLIPS, names=("docs", "talk")).select("source", "audio", F.md5("text").alias("text_md5"), "mix_key")


@query(
    "corpora_union",
    """SELECT source, count(*) AS n, count(*) FILTER (text = '') AS empty, min(mix_key) AS first_key FROM (
        SELECT source, text, md5(concat_ws('|', '42', source, audio)) AS mix_key FROM (
        SELECT 'docs' AS source, 'd' || doc_id AS audio, text FROM documents
        UNION ALL SELECT 'bench', 'b' || item_id, text FROM benchmark
        UNION ALL SELECT 'talk', 'c' || conv_id || '-' || turn, text FROM conversations)) GROUP BY 1""",
)
def corpora_union(t):
    text = lambda prefix, col: F.concat(F.lit(prefix), F.col(col).cast("string"))
    docs = t.documents.select(text("d", "doc_id").alias("audio"), "text")
    bench = t.benchmark.select(text("b", "item_id").alias("audio"), F.col("text").alias("sentence"))
    talk = t.conversations.select(F.concat(text("c", "conv_id"), text("-", "turn")).alias("audio"), F.col("text").alias("transcript"))
    mixed = sp.shuffled_order(sp.unify({"docs": docs, "bench": bench, "talk": talk}))
    return mixed.groupBy("source").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("text") == "").alias("empty"), F.min("mix_key").alias("first_key")
    )


@query(
    "manifest_differences",
    using("clips", body="SELECT id, dur_s, 'left' AS side FROM clips WHERE dur_s > 30 UNION ALL SELECT id, dur_s, 'right' FROM clips WHERE dur_s < 1"),
)
def manifest_differences(t):
    c = roles.clips(t).select("id", "dur_s")
    return sp.differences(c.where("dur_s >= 1"), c.where("dur_s <= 30"))


@query(
    "mixture_spec_values",
    using(
        "clips",
        body="""SELECT id, 'voz' AS name, (seq % 5)::VARCHAR AS value FROM clips UNION ALL SELECT id, 'base', (seq % 3)::VARCHAR FROM clips""",
    ),
)
def mixture_spec_values(t):
    c = roles.clips(t)
    spec = F.concat(F.lit(" voz = "), (F.col("seq") % 5).cast("string"), F.lit(",, base="), (F.col("seq") % 3).cast("string"), F.lit(" ,"))
    return c.select("id", F.explode(tx.key_values(spec)).alias("x")).select("id", "x.name", "x.value")


@query(
    "benchmark_passages_in_documents",
    """SELECT d.doc_id, b.item_id FROM (SELECT doc_id, unnest(list_distinct(string_split(text, chr(10)))) AS line FROM documents) d
        JOIN (SELECT item_id, unnest(list_distinct(string_split(text, chr(10)))) AS line FROM benchmark) b USING (line)
        WHERE trim(line) <> '' GROUP BY 1, 2""",
)
def benchmark_passages_in_documents(t):
    lines = lambda df, key: df.select(key, F.explode(F.array_distinct(F.split("text", "\n"))).alias("line")).where("trim(line) <> ''")
    docs, bench = lines(t.documents, "doc_id"), lines(t.benchmark, "item_id")
    return docs.join(bench, "line").select("doc_id", "item_id").distinct()
