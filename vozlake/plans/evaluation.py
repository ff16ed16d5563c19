"""Queries on word error rates, ratings and run results."""

from __future__ import annotations

from pyspark.sql import functions as F

from vozlake.functions import tables
from vozlake.functions import text as tx
from vozlake.functions import wer as w
from vozlake.operators import edits as ed
from vozlake.operators import ratings as rt
from vozlake.operators import scoring as sc
from vozlake.plans import roles
from vozlake.plans.registry import query
from vozlake.plans.roles import s_norm, using
from vozlake.session import materialize


def turn_pairs(t):
    """Each turn as reference, the next turn of the conversation as hypothesis."""
    a = roles.turns(t)
    b = a.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("hyp"))
    return a.join(b, ["conv_id", "turn"]).select("turn_id", "conv_id", "role", F.col("text").alias("ref"), "hyp", "dur_s")


_PAIRS = """pairs AS (SELECT a.turn_id, a.conv_id, a.role, a.text AS ref, b.text AS hyp, a.dur_s FROM turns a JOIN turns b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)"""
_DP = f"""{_PAIRS}, toks AS (SELECT turn_id, role, dur_s, list_filter(string_split({s_norm("ref")}, ' '), lambda w: w <> '') AS r,
        list_filter(string_split({s_norm("hyp")}, ' '), lambda w: w <> '') AS h FROM pairs),
        dp AS (SELECT turn_id, 0::BIGINT AS i, range(0, len(h) + 1) AS line FROM toks
        UNION ALL SELECT dp.turn_id, i + 1, list_transform(range(0, len(h) + 1), lambda j: list_min(list_concat([i + 1], list_transform(range(1, len(h) + 1),
          lambda k: least(line[k + 1] + 1, line[k] + (CASE WHEN h[k] = r[i + 1] THEN 0 ELSE 1 END)) - k))[1:j + 1]) + j)
        FROM dp JOIN toks USING (turn_id) WHERE i < len(r)),
        scored AS (SELECT toks.turn_id, role, dur_s, CASE WHEN len(r) = 0 THEN CASE WHEN len(h) = 0 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END ELSE line[len(h) + 1] / len(r)::DOUBLE END AS wer
        FROM toks JOIN dp ON dp.turn_id = toks.turn_id AND dp.i = len(toks.r))"""


def scored(t):
    return sc.score(turn_pairs(t))


@query("turn_wer", using("turns", body=f"WITH RECURSIVE {_DP} SELECT turn_id, round(wer, 8) AS wer FROM scored"))
def turn_wer(t):
    return scored(t).select("turn_id", F.round("wer", 8).alias("wer"))


@query(
    "wer_summary",
    using(
        "turns",
        body=f"""WITH RECURSIVE {_DP} SELECT role, 'raw' AS mode, count(*) AS n, round(median(wer), 8) AS median, round(avg(wer), 8) AS mean FROM scored GROUP BY 1
        UNION ALL SELECT role, 'capped', count(*), round(median(least(wer, 1)), 8), round(avg(least(wer, 1)), 8) FROM scored GROUP BY 1""",
    ),
)
def wer_summary(t):
    rows = materialize(scored(t).select("role", "wer"), "scores")
    out = lambda mode, cap: sc.wer_summary(rows, ["role"], cap).select("role", F.lit(mode).alias("mode"), "n", F.round("median", 8).alias("median"), F.round("mean", 8).alias("mean"))
    return out("raw", None).unionByName(out("capped", 1.0))


@query("misread_turns", using("turns", body=f"WITH RECURSIVE {_DP} SELECT turn_id FROM scored WHERE wer > 0.95 AND role IN ('user', 'assistant')"))
def misread_turns(t):
    rows = turn_pairs(t).withColumn("kind", F.col("role"))
    return sc.misread_takes(rows, 0.95, ("user", "assistant")).select("turn_id")


_OPS = f"""{_PAIRS}, toks AS (SELECT turn_id, regexp_extract_all(lower(ref), '[\\p{{L}}\\p{{N}}_]+') AS r, regexp_extract_all(lower(hyp), '[\\p{{L}}\\p{{N}}_]+') AS h FROM pairs),
        dp AS (SELECT turn_id, 0::BIGINT AS i, range(0, len(h) + 1) AS line FROM toks
        UNION ALL SELECT dp.turn_id, i + 1, list_transform(range(0, len(h) + 1), lambda j: list_min(list_concat([i + 1], list_transform(range(1, len(h) + 1),
          lambda k: least(line[k + 1] + 1, line[k] + (CASE WHEN h[k] = r[i + 1] THEN 0 ELSE 1 END)) - k))[1:j + 1]) + j)
        FROM dp JOIN toks USING (turn_id) WHERE i < len(r)),
        back AS (SELECT turn_id, len(r)::BIGINT AS i, len(h)::BIGINT AS j, 0 AS step, NULL::VARCHAR AS op, NULL::VARCHAR AS ref, NULL::VARCHAR AS hyp FROM toks
          UNION ALL SELECT turn_id, i - (m <> 'ins')::BIGINT, j - (m <> 'del')::BIGINT, step + 1, m, CASE WHEN m <> 'ins' THEN r[i] END, CASE WHEN m <> 'del' THEN h[j] END
          FROM (SELECT x.*, toks.r, toks.h, CASE WHEN x.i > 0 AND j > 0 AND r[x.i] = h[j] AND a.line[j + 1] = b.line[j] THEN 'ok' WHEN x.i > 0 AND j > 0 AND a.line[j + 1] = b.line[j] + 1 THEN 'sub'
                       WHEN x.i > 0 AND a.line[j + 1] = b.line[j + 1] + 1 THEN 'del' ELSE 'ins' END AS m
                FROM back x JOIN toks ON toks.turn_id = x.turn_id JOIN dp a ON a.turn_id = x.turn_id AND a.i = x.i LEFT JOIN dp b ON b.turn_id = x.turn_id AND b.i = x.i - 1 WHERE x.i + j > 0)),
        ops AS (SELECT turn_id, (max(step) OVER (PARTITION BY turn_id) - step)::INTEGER AS pos, op, ref, hyp FROM back QUALIFY step > 0)"""


@query("wer_operations", using("turns", body=f"WITH RECURSIVE {_OPS} SELECT * FROM ops"))
def wer_operations(t):
    return sc.operations(turn_pairs(t), ["turn_id"])


@query(
    "wer_operation_totals",
    using(
        "turns",
        body=f"""WITH RECURSIVE {_PAIRS}, toks AS (SELECT turn_id, regexp_extract_all(lower(ref), '[\\p{{L}}\\p{{N}}_]+') AS r, regexp_extract_all(lower(hyp), '[\\p{{L}}\\p{{N}}_]+') AS h FROM pairs),
        dp AS (SELECT turn_id, 0::BIGINT AS i, range(0, len(h) + 1) AS line FROM toks
        UNION ALL SELECT dp.turn_id, i + 1, list_transform(range(0, len(h) + 1), lambda j: list_min(list_concat([i + 1], list_transform(range(1, len(h) + 1),
          lambda k: least(line[k + 1] + 1, line[k] + (CASE WHEN h[k] = r[i + 1] THEN 0 ELSE 1 END)) - k))[1:j + 1]) + j)
        FROM dp JOIN toks USING (turn_id) WHERE i < len(r))
        SELECT toks.turn_id, line[len(h) + 1]::BIGINT AS errors, len(r)::BIGINT AS ref_words, len(h)::BIGINT AS hyp_words
        FROM toks JOIN dp ON dp.turn_id = toks.turn_id AND dp.i = len(toks.r)""",
    ),
)
def wer_operation_totals(t):
    return sc.operation_totals(turn_pairs(t), ["turn_id"])


@query("sql_wer_operations", using("turns", body=f"WITH RECURSIVE {_OPS} SELECT op, ref, hyp, count(*) AS n FROM ops GROUP BY ALL"))
def sql_wer_operations(t):
    """Operations counted through the table function, in SQL."""
    tables.register(t.spark)
    words = lambda c: w.unicode_words(F.lower(F.col(c))).alias(f"{c}_words")
    pairs = turn_pairs(t).select("turn_id", words("ref"), words("hyp"))
    return t.spark.sql("SELECT o.op, o.ref, o.hyp, count(*) AS n FROM {pairs} p, LATERAL word_operations(p.ref_words, p.hyp_words) o GROUP BY ALL", pairs=pairs)


@query("word_confusions", using("turns", body=f"WITH RECURSIVE {_OPS} SELECT op, ref, hyp, count(*) AS n FROM ops WHERE op <> 'ok' GROUP BY ALL"))
def word_confusions(t):
    return sc.confusions(sc.operations(turn_pairs(t), ["turn_id"]))


@query(
    "run_on_clips",
    using("turns", body='SELECT role, count(*) AS clips, count(*) FILTER (dur_s >= 12.7) AS at_cap, round(avg(dur_s), 6) AS mean_s, count(*) FILTER (dur_s >= 12.7) > count(*) // 2 AS run_on FROM turns GROUP BY 1'),
)
def run_on_clips(t):
    return sc.run_on(roles.turns(t), 12.7, ["role"]).withColumn("mean_s", F.round("mean_s", 6))


@query(
    "codec_delta",
    """WITH x AS (SELECT value / 100.0::DOUBLE AS o, value / 100.0::DOUBLE + (event_id % 17) / 100.0::DOUBLE AS r FROM events)
        SELECT count(*) AS clips, round(median(o), 8) AS original, round(median(r), 8) AS resynth, round(median(r) - median(o), 8) AS delta,
        CASE WHEN median(r) - median(o) < 0.10 THEN 'freeze' ELSE 'investigate' END AS verdict FROM x""",
)
def codec_delta(t):
    o = F.col("value") / F.lit(100.0)
    rows = t.events.select(o.alias("wer_original"), (o + (F.col("event_id") % 17) / F.lit(100.0)).alias("wer_resynth"))
    got = sc.codec_delta(rows)
    return got.select("clips", *[F.round(c, 8).alias(c) for c in ("original", "resynth", "delta")], "verdict")


# ---- ratings --------------------------------------------------------------


def marker_type() -> str:
    return "array<struct<t_start:double,t_end:double,tag:string,sev:string,note:string>>"


def merged_ratings(t):
    """Field-wise merge of the rating log, with problems and markers as arrays."""
    r = roles.ratings(t)
    start = (F.col("seq") % 50) / F.lit(10.0)
    one = F.struct(start.alias("t_start"), (start + 0.35).alias("t_end"), F.col("marker_tag").alias("tag"), (F.col("seq") % 7).cast("string").alias("sev"), F.lit("").alias("note"))
    rows = r.select(
        "run", "id", "ts", "seq", "geral", "nativo", "natural", "voz", "parou",
        F.when(F.col("geral") > 3, "sim").alias("carioca"), F.lit(None).cast("string").alias("nota"),
        F.when(F.col("problema").isNotNull(), F.array("problema")).alias("problemas"),
        F.when(F.col("marker_tag").isNotNull(), F.array(one)).cast(marker_type()).alias("markers"),
    )
    return ed.merge_fields(rows, ["run", "id"])


_RATED = """rated AS (SELECT run, id, max(seq) AS seq, max(ts) AS ts, arg_max(geral, seq) FILTER (geral IS NOT NULL) AS geral, arg_max(nativo, seq) FILTER (nativo IS NOT NULL) AS nativo,
        arg_max("natural", seq) FILTER ("natural" IS NOT NULL) AS "natural", arg_max(voz, seq) FILTER (voz IS NOT NULL) AS voz, arg_max(parou, seq) FILTER (parou IS NOT NULL) AS parou,
        arg_max(CASE WHEN geral > 3 THEN 'sim' END, seq) FILTER (geral > 3) AS carioca, arg_max(problema, seq) FILTER (problema IS NOT NULL) AS problema,
        arg_max(marker_tag, seq) FILTER (marker_tag IS NOT NULL) AS marker_tag, max(seq) FILTER (marker_tag IS NOT NULL) AS marker_seq FROM ratings GROUP BY 1, 2)"""
_CLIPS = """bench AS (SELECT 'it' || item_id AS id, text, (['feliz', 'triste', 'neutro'])[(item_id % 3 + 1)::BIGINT] AS emotion, 'carioca' AS accent FROM benchmark),
        wavs AS (SELECT run, id, count(*) AS takes FROM ratings GROUP BY 1, 2),
        sent AS (SELECT run, id, round(avg(coalesce(geral, 0)) / 5, 6) AS wer, count(*) / 4.0::DOUBLE AS dur_s, 'ref ' || id AS ref, 'hyp ' || run AS hyp FROM ratings GROUP BY 1, 2),
        man AS (SELECT w.run, w.id, coalesce(b.emotion, '?') AS emotion, coalesce(b.accent, '?') AS accent, coalesce(b.text, s.ref, '') AS text, s.wer, s.dur_s, coalesce(s.hyp, '') AS hyp
        FROM wavs w LEFT JOIN bench b USING (id) LEFT JOIN sent s ON s.run = w.run AND s.id = w.id)"""


def benchmark(t):
    item = F.col("item_id")
    return t.benchmark.select(
        F.concat(F.lit("it"), item.cast("string")).alias("id"), "text", roles.one_of(["feliz", "triste", "neutro"], item % 3).alias("emotion"), F.lit("carioca").alias("accent")
    )


def manifest(t):
    r = roles.ratings(t)
    wavs = r.select("run", "id").distinct().withColumn("wav", F.concat_ws("/", "run", F.concat("id", F.lit(".wav"))))
    sent = (
        r.groupBy("run", "id")
        .agg(F.round(F.avg(F.coalesce("geral", F.lit(0))) / 5, 6).alias("wer"), (F.count(F.lit(1)) / F.lit(4.0)).alias("dur_s"))
        .withColumn("ref", F.concat(F.lit("ref "), "id"))
        .withColumn("hyp", F.concat(F.lit("hyp "), "run"))
    )
    return rt.manifest(wavs, benchmark(t), sent)


@query("rating_manifest", using("ratings", body=f"WITH {_CLIPS} SELECT run, id, emotion, accent, md5(text) AS text_md5, wer, dur_s, hyp, run || '/' || id || '.wav' AS wav FROM man"))
def rating_manifest(t):
    return manifest(t).select("run", "id", "emotion", "accent", F.md5("text").alias("text_md5"), "wer", "dur_s", "hyp", "wav")


@query(
    "feedback_records",
    using(
        "ratings",
        body=f"""WITH {_RATED}, {_CLIPS} SELECT 1 AS schema_version, m.run, m.id, m.emotion, geral, nativo, voz, parou, carioca, coalesce(problema, '') AS problems,
        CASE WHEN marker_tag IS NULL THEN 0 ELSE 1 END AS n_markers, r.ts AS rated_ts FROM man m LEFT JOIN rated r USING (run, id)""",
    ),
)
def feedback_records(t):
    got = rt.feedback_records(manifest(t), merged_ratings(t))
    r = lambda c: F.col(f"ratings.{c}").alias(c)
    return got.select(
        "schema_version", "run", "id", "emotion", r("geral"), r("nativo"), r("voz"), r("parou"), r("carioca"),
        F.array_join("problems", ",").alias("problems"), F.size("markers").alias("n_markers"), "rated_ts",
    )


def _r1(x: str) -> str:
    return f"printf('%.1f', avg({x}))::DOUBLE"


_AGG = f"""count(*) AS n, {_r1("geral")} AS geral, {_r1("nativo")} AS nativo, {_r1('"natural"')} AS "natural", {_r1("voz")} AS voz,
        round_even(100 * avg(CASE WHEN parou THEN 1 WHEN NOT parou THEN 0 END), 0) AS parou_pct"""


@query(
    "rating_insights",
    using(
        "ratings",
        body=f"""WITH {_RATED}, {_CLIPS}, j AS (SELECT m.emotion, r.* FROM man m JOIN rated r USING (run, id) WHERE geral IS NOT NULL)
        SELECT 'run' AS axis, run AS name, {_AGG} FROM j GROUP BY run UNION ALL SELECT 'emotion', emotion, {_AGG} FROM j GROUP BY emotion""",
    ),
)
def rating_insights(t):
    return rt.insights(manifest(t).select("run", "id", "emotion").join(merged_ratings(t), ["run", "id"], "left"))


@query(
    "problem_ranking",
    using("ratings", body=f"WITH {_RATED}, {_CLIPS} SELECT problema AS problem, count(*) AS n FROM man JOIN rated USING (run, id) WHERE geral IS NOT NULL AND problema IS NOT NULL GROUP BY 1"),
)
def problem_ranking(t):
    rated = manifest(t).select("run", "id").join(merged_ratings(t), ["run", "id"], "left")
    return rt.problem_ranking(rated).orderBy(F.desc("n"), "problem")


@query(
    "marker_coverage",
    using(
        "ratings",
        body=f"""WITH {_RATED} SELECT 'clips' AS metric, count(marker_tag) AS n FROM rated UNION ALL SELECT 'markers', count(marker_tag) FROM rated
        UNION ALL SELECT 'tag:' || marker_tag, count(*) FROM rated WHERE marker_tag IS NOT NULL GROUP BY 1""",
    ),
)
def marker_coverage(t):
    return rt.marker_coverage(merged_ratings(t))


_MISS = """array_to_string(list_filter([CASE WHEN geral IS NULL THEN 'geral' END, CASE WHEN nativo IS NULL THEN 'nativo' END, CASE WHEN "natural" IS NULL THEN 'natural' END,
        CASE WHEN parou IS NULL THEN 'parou' END, CASE WHEN carioca IS NULL THEN 'carioca' END, CASE WHEN run2 LIKE '%voz%' AND voz IS NULL THEN 'voz' END], lambda x: x IS NOT NULL), ',')"""


@query(
    "rating_completeness",
    using(
        "ratings",
        body=f"""WITH {_RATED}, {_CLIPS}, j AS (SELECT m.run, m.id, CASE WHEN m.run IN ('run1', 'run4') THEN m.run || '_voz' ELSE m.run END AS run2, r.* EXCLUDE (run, id) FROM man m LEFT JOIN rated r USING (run, id))
        SELECT run2 AS run, id, {_MISS} AS missing, {_MISS} = '' AS complete FROM j""",
    ),
)
def rating_completeness(t):
    voice = lambda df: df.withColumn("run", F.when(F.col("run").isin("run1", "run4"), F.concat("run", F.lit("_voz"))).otherwise(F.col("run")))
    got = rt.completeness(voice(manifest(t)), voice(merged_ratings(t)))
    return got.select("run", "id", F.array_join("missing", ",").alias("missing"), "complete")


@query(
    "severity_levels",
    """SELECT event_id, s AS sev, CASE WHEN TRY_CAST(s AS INTEGER) IS NOT NULL THEN least(greatest(s::INTEGER, 1), 5) WHEN lower(s) = 'grave' THEN 5 WHEN lower(s) = 'leve' THEN 1 ELSE 3 END AS level,
        CASE WHEN CASE WHEN TRY_CAST(s AS INTEGER) IS NOT NULL THEN least(greatest(s::INTEGER, 1), 5) WHEN lower(s) = 'grave' THEN 5 WHEN lower(s) = 'leve' THEN 1 ELSE 3 END <= 2 THEN 'leve'
        WHEN CASE WHEN TRY_CAST(s AS INTEGER) IS NOT NULL THEN least(greatest(s::INTEGER, 1), 5) WHEN lower(s) = 'grave' THEN 5 WHEN lower(s) = 'leve' THEN 1 ELSE 3 END <= 3 THEN 'medio' ELSE 'grave' END AS bucket
        FROM (SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'Grave' WHEN 1 THEN 'médio' WHEN 2 THEN 'leve' WHEN 3 THEN event_type ELSE (event_id % 11 - 2)::VARCHAR END AS s FROM events)""",
)
def severity_levels(t):
    e = F.col("event_id")
    s = F.when(e % 6 == 0, "Grave").when(e % 6 == 1, "médio").when(e % 6 == 2, "leve").when(e % 6 == 3, F.col("event_type")).otherwise((e % 11 - 2).cast("string"))
    return t.events.select("event_id", s.alias("sev")).select("event_id", "sev", rt.severity(F.col("sev")).alias("level"), rt.severity_bucket(F.col("sev")).alias("bucket"))


@query(
    "emotion_suggestions",
    """WITH s AS (SELECT doc_id, [('愤怒/angry', (doc_id * 37 % 101) / 100.0::DOUBLE), ('x/fearful', (doc_id * 53 % 89) / 100.0::DOUBLE), ('happy', (doc_id * 71 % 79) / 100.0::DOUBLE), ('other', (doc_id * 13 % 61) / 100.0::DOUBLE)] AS a FROM documents),
        o AS (SELECT doc_id, unnest(a) AS p, unnest(range(4)) AS k FROM s),
        r AS (SELECT doc_id, p[1] AS lab, p[2] AS sc, row_number() OVER (PARTITION BY doc_id ORDER BY p[2] DESC, k) AS rn FROM o),
        m AS (SELECT doc_id, rn, sc, CASE WHEN lab LIKE '%angry' THEN 'angry' WHEN lab LIKE '%fearful' THEN 'anxious' WHEN lab = 'happy' THEN 'happy' END AS e FROM r WHERE rn <= 2),
        p AS (SELECT doc_id, max(e) FILTER (rn = 1) AS e1, max(e) FILTER (rn = 2) AS e2, max(sc) FILTER (rn = 2) AS s2 FROM m GROUP BY 1)
        SELECT doc_id, array_to_string(list_filter([e1, CASE WHEN s2 > 0.15 OR e1 IS NULL THEN e2 END], lambda x: x IS NOT NULL), ',') AS emotions FROM p""",
)
def emotion_suggestions(t):
    d = F.col("doc_id")
    pair = lambda label, a, b: F.struct(F.lit(label).alias("label"), (d * a % b / F.lit(100.0)).alias("score"))
    scores = F.array(pair("愤怒/angry", 37, 101), pair("x/fearful", 53, 89), pair("happy", 71, 79), pair("other", 13, 61))
    return t.documents.select("doc_id", F.array_join(rt.emotion_suggestion(scores), ",").alias("emotions"))


@query(
    "emotion_rule_violations",
    """SELECT user_id, array_to_string(list_filter([CASE WHEN list_contains(e, 'neutral') AND len(e) > 1 THEN 'neutral with others' END, CASE WHEN len(e) > 3 THEN 'more than three' END], lambda x: x IS NOT NULL), ',') AS violations
        FROM (SELECT user_id, list_distinct(list(CASE WHEN event_type = 'view' THEN 'neutral' ELSE event_type END)) AS e FROM events GROUP BY 1)
        WHERE (list_contains(e, 'neutral') AND len(e) > 1) OR len(e) > 3""",
)
def emotion_rule_violations(t):
    kind = F.when(F.col("event_type") == "view", "neutral").otherwise(F.col("event_type"))
    rows = t.events.groupBy("user_id").agg(F.collect_set(kind).alias("emocoes"))
    return rt.emotion_rule_violations(rows).select("user_id", F.array_join("violations", ",").alias("violations"))


@query("clips_without_emotion", "SELECT doc_id FROM documents WHERE doc_id % 3 = 0 AND source = 'src1'")
def clips_without_emotion(t):
    auto = F.when(F.col("doc_id") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("happy")))
    rows = t.documents.select("doc_id", F.col("source").alias("usuario"), auto.alias("emocoes_auto"))
    return rt.without_suggestion(rows, "src1").select("doc_id")


def runs(t):
    e = t.events.groupBy((F.col("user_id") % 40).alias("u")).agg(F.round(F.avg("value") / 100, 6).alias("w"), F.count(F.lit(1)).alias("clips"))
    return e.select(
        F.concat(F.lit("run"), F.col("u").cast("string")).alias("tag"), F.concat(F.lit("s"), (F.col("u") % 6).cast("string")).alias("source"), F.when(F.col("u") % 7 != 0, F.col("w")).alias("wer"), "clips"
    )


_RUNS = "runs AS (SELECT 'run' || u AS tag, 's' || (u % 6) AS source, CASE WHEN u % 7 <> 0 THEN w END AS wer, clips FROM (SELECT user_id % 40 AS u, round(avg(value) / 100, 6) AS w, count(*) AS clips FROM events GROUP BY 1))"


@query("run_leaderboard", f"WITH {_RUNS} SELECT tag, source, wer, clips, coalesce(wer, 9) AS sort_wer FROM runs")
def run_leaderboard(t):
    return sc.leaderboard(runs(t))


@query("best_run_per_source", f"WITH {_RUNS} SELECT source, min(coalesce(wer, 9)) AS best_wer, arg_min(tag, (coalesce(wer, 9), tag)) AS best_tag FROM runs GROUP BY 1")
def best_run_per_source(t):
    return sc.best_per_source(runs(t))


@query(
    "sentence_metrics",
    using(
        "ratings",
        body=f"""WITH {_CLIPS}, sim AS (SELECT run, id, round(avg(nativo), 6) AS spk_sim FROM ratings GROUP BY 1, 2), pros AS (SELECT run, id, count(*) AS taxa FROM ratings GROUP BY 1, 2)
        SELECT run, id, wer, spk_sim, taxa FROM man LEFT JOIN sim USING (run, id) LEFT JOIN pros USING (run, id)""",
    ),
)
def sentence_metrics(t):
    r = roles.ratings(t)
    sim = r.groupBy("run", "id").agg(F.round(F.avg("nativo"), 6).alias("spk_sim"))
    pros = r.groupBy("run", "id").agg(F.count(F.lit(1)).alias("taxa"))
    return sc.attach_metrics(manifest(t).select("run", "id", "wer"), sim, pros, ["run", "id"])


@query(
    "config_violations",
    """SELECT user_id, array_to_string(list_filter([CASE WHEN user_id % 5 = 0 THEN 'warmup_steps must be a whole number' END, CASE WHEN user_id % 7 = 0 THEN 'eos_fix must be set' END,
        CASE WHEN user_id % 6 = 1 THEN 'max_text_len below 256' END, CASE WHEN user_id % 2 = 0 AND lr > 1e-4 THEN 'stage B learning rate above 1e-4' END], lambda x: x IS NOT NULL), '; ') AS violations
        FROM (SELECT user_id, max(value) / 1e6::DOUBLE AS lr FROM events GROUP BY 1) WHERE user_id % 5 = 0 OR user_id % 7 = 0 OR user_id % 6 = 1 OR (user_id % 2 = 0 AND lr > 1e-4)""",
)
def config_violations(t):
    from vozlake.operators.gates import config_violations as audit

    u = F.col("user_id")
    cfg = t.events.groupBy("user_id").agg((F.max("value") / F.lit(1e6)).alias("lr")).select(
        "user_id", "lr", F.when(u % 5 == 0, "0.1").otherwise("20").alias("warmup_steps"), (u % 7 != 0).alias("eos_fix"), F.lit(True).alias("real_audio"),
        F.when(u % 6 == 1, 128).otherwise(384).alias("max_text_len"), F.when(u % 2 == 0, "B").otherwise("A").alias("stage"),
    )
    return audit(cfg).select("user_id", F.array_join("violations", "; ").alias("violations"))


@query(
    "artifact_completeness",
    using(
        "ratings",
        body="""WITH w AS (SELECT run, count(DISTINCT id) AS wavs FROM ratings GROUP BY 1)
        SELECT run, coalesce(wavs, 0) AS wavs, run <> 'run3' AS has_result, run <> 'run3' AND coalesce(wavs, 0) >= 14 AS complete FROM (SELECT DISTINCT run FROM ratings) LEFT JOIN w USING (run)""",
    ),
)
def artifact_completeness(t):
    from vozlake.operators.gates import artifact_completeness as complete

    r = roles.ratings(t)
    return complete(r, r.select("run", "id").distinct(), r.where("run <> 'run3'"))


@query(
    "sorted_markers",
    """SELECT user_id, string_agg(event_type, '>' ORDER BY t, event_id) AS tags, round(min(t), 6) AS first_start FROM (SELECT user_id, event_id, event_type, value + event_id / 1e7 AS t FROM events) GROUP BY 1""",
)
def sorted_markers(t):
    from vozlake.operators.ordered import nest

    start = F.col("value") + F.col("event_id") / F.lit(1e7)
    one = F.struct(start.alias("t_start"), F.col("event_type").alias("tag"))
    lists = nest(t.events, ["user_id"], F.col("event_id"), one, "markers")
    got = lists.select("user_id", rt.sorted_markers(F.col("markers")).alias("m"))
    return got.select("user_id", F.array_join(F.transform("m", lambda x: x["tag"]), ">").alias("tags"), F.round(F.col("m")[0]["t_start"], 6).alias("first_start"))


@query("rating_times", using("ratings", body="SELECT seq, ts // 1000 AS seconds FROM ratings"))
def rating_times(t):
    return roles.ratings(t).select("seq", F.unix_seconds(rt.rated_at(F.col("ts"))).alias("seconds"))
