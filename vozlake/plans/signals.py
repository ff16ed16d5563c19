"""Queries on frames, samples, speakers, accents and latencies."""

from __future__ import annotations

from pyspark.sql import functions as F

from vozlake.functions import signal as sg
from vozlake.operators import accent as ac
from vozlake.operators import frames as fr
from vozlake.operators import gates
from vozlake.operators import latency as lt
from vozlake.operators import speakers as sk
from vozlake.plans import roles
from vozlake.plans.registry import query
from vozlake.plans.roles import using
from vozlake.session import materialize


def samples(t):
    """Audio samples played by event values: clip = user, i = event number."""
    return t.events.select(F.col("user_id").alias("clip_id"), F.col("event_id").alias("i"), ((F.col("value") - 50) / F.lit(250.0)).alias("x"))


_S = "smp AS (SELECT user_id AS clip_id, event_id AS i, (value - 50) / 250.0::DOUBLE AS x FROM events)"
_DB = "20.0::DOUBLE * log10(greatest({}, 1e-9))"


@query(
    "frame_levels",
    f"""WITH {_S} SELECT clip_id, i // 500 AS frame, count(*) AS samples, round(sqrt(avg(x * x)), 8) AS rms, round(max(abs(x)), 8) AS peak, round({_DB.format("sqrt(avg(x * x))")}, 6) AS db FROM smp GROUP BY 1, 2""",
)
def frame_levels(t):
    got = fr.frame_levels(samples(t), 500)
    return got.select("clip_id", "frame", "samples", F.round("rms", 8).alias("rms"), F.round("peak", 8).alias("peak"), F.round("db", 6).alias("db"))


@query("clip_levels", f"WITH {_S} SELECT clip_id, round(max(abs(x)), 8) AS peak, round(sqrt(avg(x * x)), 8) AS rms FROM smp GROUP BY 1")
def clip_levels(t):
    return fr.clip_levels(samples(t)).select("clip_id", F.round("peak", 8).alias("peak"), F.round("rms", 8).alias("rms"))


@query(
    "take_metrics",
    f"""WITH {_S}, f AS (SELECT clip_id, i // 5 AS frame, count(*) AS n, sqrt(avg(x * x)) AS rms FROM smp GROUP BY 1, 2),
        q AS (SELECT clip_id, quantile_cont(rms, 0.05) AS p5, quantile_cont(rms, 0.9) AS p90 FROM f WHERE n = 5 GROUP BY 1),
        m AS (SELECT clip_id, count(*) AS n, max(abs(x)) AS peak, avg(CASE WHEN abs(x) >= 0.985 THEN 1 ELSE 0 END) AS ratio FROM smp GROUP BY 1),
        z AS (SELECT clip_id, n, {_DB.format("peak")} AS peak_dbfs, ratio, CASE WHEN n >= 20 THEN coalesce({_DB.format("p90")} - {_DB.format("p5")}, 0) ELSE 0 END AS snr, n / 100.0::DOUBLE AS dur FROM m LEFT JOIN q USING (clip_id))
        SELECT clip_id, round(peak_dbfs, 6) AS peak_dbfs, round(ratio, 8) AS clip_ratio, round(snr, 6) AS snr_db, dur AS dur_s, concat_ws('; ', CASE WHEN ratio > 1e-4 THEN 'clipping' END, CASE WHEN peak_dbfs < -24 THEN 'weak signal' END,
        CASE WHEN peak_dbfs > -3 THEN 'too hot' END, CASE WHEN snr < 32 AND snr > 0 THEN 'low SNR' END, CASE WHEN dur < 0.6::DOUBLE THEN 'too short' END) AS issues FROM z""",
)
def take_metrics(t):
    grouped = samples(t).withColumn("i", F.col("i"))
    got = fr.take_metrics(grouped, 100)
    return got.select("clip_id", F.round("peak_dbfs", 6).alias("peak_dbfs"), F.round("clip_ratio", 8).alias("clip_ratio"), F.round("snr_db", 6).alias("snr_db"), "dur_s", F.array_join("issues", "; ").alias("issues"))


@query("room_noise", f"WITH {_S} SELECT clip_id, round({_DB.format('sqrt(avg(x * x))')}, 6) AS floor_db, {_DB.format('sqrt(avg(x * x))')} < -60 AS quiet FROM smp GROUP BY 1")
def room_noise(t):
    return fr.room_noise(samples(t)).withColumn("floor_db", F.round("floor_db", 6))


_TAKES = """tk AS (SELECT *, CASE WHEN seq % 3 = 0 THEN 0.0::DOUBLE ELSE (seq % 60)::DOUBLE END AS snr FROM clips)"""


@query(
    "qc_minutes",
    using(
        "clips",
        body="""SELECT CASE grouping_id(s, a, k) WHEN 3 THEN 'style' WHEN 5 THEN 'accent' WHEN 6 THEN 'kind' ELSE 'total' END AS axis, coalesce(s, a, k, 'total') AS name, count(*) AS takes, round(sum(dur_s) / 60, 6) AS minutes
        FROM (SELECT coalesce(style, '-') AS s, coalesce(accent, '-') AS a, coalesce(kind, '-') AS k, dur_s FROM clips) GROUP BY GROUPING SETS ((s), (a), (k), ())""",
    ),
)
def qc_minutes(t):
    return fr.qc_minutes(roles.clips(t)).withColumn("minutes", F.round("minutes", 6))


@query(
    "qc_problems",
    using("clips", body="SELECT id AS clip_id, concat_ws('; ', CASE WHEN dur_s < 2 THEN 'too short' END, CASE WHEN dur_s > 30 THEN 'too long' END) AS problem FROM clips WHERE dur_s < 2 OR dur_s > 30"),
)
def qc_problems(t):
    takes = roles.clips(t).select(F.col("id").alias("clip_id"), gates.some([(F.col("dur_s") < 2, "too short"), (F.col("dur_s") > 30, "too long")]).alias("issues"))
    return fr.qc_problems(takes)


@query("snr_summary", using("clips", body=f"WITH {_TAKES} SELECT count(*) AS n, median(snr) AS median, min(snr) AS lowest FROM tk WHERE snr <> 0"))
def snr_summary(t):
    snr = F.when(F.col("seq") % 3 == 0, F.lit(0.0)).otherwise((F.col("seq") % 60).cast("double"))
    return fr.snr_summary(roles.clips(t).withColumn("snr_db", snr))


@query(
    "peak_normalized",
    """WITH b AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x FROM embeddings), p AS (SELECT label, max(abs(x)) AS top FROM b GROUP BY 1)
        SELECT vec_id, round(max(abs(x * (power(10, -0.15::DOUBLE) / top))), 6) AS peak, round(sum(x * (power(10, -0.15::DOUBLE) / top)), 6) AS total FROM b JOIN p USING (label) GROUP BY 1""",
)
def peak_normalized(t):
    blocks = t.embeddings.select("vec_id", F.col("label").alias("clip_id"), F.col("embedding").alias("samples"))
    got = fr.normalize_peak(blocks).select("vec_id", F.explode("samples").alias("x"))
    return got.groupBy("vec_id").agg(F.round(F.max(F.abs("x")), 6).alias("peak"), F.round(F.sum("x"), 6).alias("total"))


@query(
    "downmixed",
    """SELECT vec_id, round(sum(x), 6) AS total FROM (SELECT vec_id, unnest(list_transform(range(1, len(embedding) + 1), lambda i: (embedding[i]::DOUBLE + embedding[len(embedding) + 1 - i]::DOUBLE) / 2 * i)) AS x FROM embeddings) GROUP BY 1""",
)
def downmixed(t):
    e = F.transform("embedding", lambda x: x.cast("double"))
    mix = sg.downmix(F.array(e, F.reverse(e)))
    rows = t.embeddings.select("vec_id", F.posexplode(mix).alias("i", "x"))
    return rows.groupBy("vec_id").agg(F.round(F.sum(F.col("x") * (F.col("i") + 1)), 6).alias("total"))


# ---- runs of frames --------------------------------------------------------


def frames(t):
    """Hour slots of a user as frames; loud slots are speech."""
    return roles.frames(t).select("clip_id", "i", (F.col("level") - 85).alias("db"))


def frame_clips(t):
    n = F.max("i") + 1 + F.col("clip_id") % 20
    return frames(t).groupBy("clip_id").agg(n.alias("n_frames")).withColumn("n_samples", F.col("n_frames") * 20 + F.col("clip_id") % 19)


_FR = """fr AS (SELECT clip_id, i, level - 85 AS db FROM frames), fc AS (SELECT clip_id, max(i) + 1 + clip_id % 20 AS n_frames, (max(i) + 1 + clip_id % 20) * 20 + clip_id % 19 AS n_samples FROM fr GROUP BY clip_id),
        vo AS (SELECT clip_id, i, lag(i) OVER (PARTITION BY clip_id ORDER BY i) AS p FROM fr WHERE db > -42),
        ru AS (SELECT clip_id, run, min(i) AS a, max(i) AS b, count(*) AS v FROM (SELECT *, sum(CASE WHEN p IS NULL OR i - p - 1 >= 17 THEN 1 ELSE 0 END) OVER (PARTITION BY clip_id ORDER BY i)::BIGINT AS run FROM vo) GROUP BY 1, 2)"""


@query("voiced_runs", using("frames", body=f"WITH {_FR} SELECT clip_id, run, a AS first, b AS last, v AS voiced FROM ru"))
def voiced_runs(t):
    return fr.voiced_runs(frames(t), F.col("db") > -42, 17)


@query(
    "energy_segments",
    using(
        "frames",
        body=f"""WITH {_FR}, s AS (SELECT clip_id, greatest(0, a * 20 - 150) AS s, least(n_samples, (CASE WHEN n_frames - 1 - b < 17 THEN n_frames ELSE b + 1 END) * 20 + 150) AS e FROM ru JOIN fc USING (clip_id)),
        k AS (SELECT clip_id, s, e, unnest(range(greatest(ceil((e - s) / 20000.0::DOUBLE)::BIGINT, 1))) AS j FROM s WHERE (e - s) / 1000.0::DOUBLE >= 1.0)
        SELECT clip_id, s + j * 20000 AS "start", least(s + j * 20000 + 20000, e) AS "end" FROM k""",
    ),
)
def energy_segments(t):
    return fr.energy_segments(frames(t), frame_clips(t), 1000)


@query(
    "trimmed_clips",
    using("frames", body=f"""WITH {_FR}, x AS (SELECT clip_id, min(i) AS a, max(i) AS b FROM fr WHERE db > -42 GROUP BY 1)
        SELECT clip_id, coalesce(greatest(0, a * 20 - 250), 0) AS "start", coalesce(least(n_samples, (b + 1) * 20 + 250), n_samples) AS "end" FROM fc LEFT JOIN x USING (clip_id)"""),
)
def trimmed_clips(t):
    return fr.trim_silence(frames(t), frame_clips(t), 1000)


def dense(t):
    """Frames without holes, as a table: characters of a turn as 10 ms steps."""
    c = F.split(F.lower("text"), "")
    rows = roles.turns(t).select(F.col("turn_id").alias("clip_id"), F.posexplode(c).alias("i", "ch"))
    level = F.when(F.col("ch").rlike("[a-z]"), 60.0 + F.ascii("ch") % 7).otherwise(F.lit(20.0))
    frames_ = rows.select("clip_id", F.col("i").cast("long").alias("i"), (F.col("i") * F.lit(0.01)).alias("t"), level.alias("db"), F.col("ch").isin(*"aeiourstl").alias("voiced"))
    return materialize(frames_, "frames")


_DENSE = """de AS (SELECT turn_id AS clip_id, i, i * 0.01::DOUBLE AS t, CASE WHEN regexp_matches(ch, '[a-z]') THEN 60.0::DOUBLE + ascii(ch) % 7 ELSE 20.0::DOUBLE END AS db, instr('aeiourstl', ch) > 0 AS voiced
        FROM (SELECT turn_id, unnest(string_split(lower(text), '')) AS ch, unnest(range(len(string_split(lower(text), '')))) AS i FROM turns)),
        pk AS (SELECT * FROM (SELECT *, lag(db) OVER w AS a, lead(db) OVER w AS b, max(db) OVER (PARTITION BY clip_id) AS top FROM de WINDOW w AS (PARTITION BY clip_id ORDER BY i)) WHERE db > top - 4 AND db >= a AND db > b),
        ch AS (SELECT *, sum(CASE WHEN p IS NULL OR i - p >= 3 THEN 1 ELSE 0 END) OVER (PARTITION BY clip_id ORDER BY i) AS c FROM (SELECT *, lag(i) OVER (PARTITION BY clip_id ORDER BY i) AS p FROM pk)),
        nu AS (SELECT clip_id, i, t FROM (SELECT *, row_number() OVER (PARTITION BY clip_id, c ORDER BY i) AS k FROM ch) WHERE k % 2 = 1 AND voiced)"""


@query("syllable_nuclei", using("turns", body=f"WITH {_DENSE} SELECT clip_id, i, t FROM nu"))
def syllable_nuclei(t):
    return fr.syllable_nuclei(dense(t))


def durations(t):
    return roles.turns(t).select(F.col("turn_id").alias("clip_id"), (F.length("text") * F.lit(0.01)).alias("dur_s"))


_RHY = f"""{_DENSE}, gp AS (SELECT clip_id, (lead(t) OVER (PARTITION BY clip_id ORDER BY t) - t) * 1000 AS g FROM nu),
        rh AS (SELECT clip_id, count(*) AS syllables, avg(g) AS mean_ms, max(g) AS longest_ms, stddev_pop(g) AS sd_ms FROM gp GROUP BY 1 HAVING count(*) >= 2),
        rt AS (SELECT rh.*, length(text) * 0.01::DOUBLE AS dur_s, syllables / greatest(0.1::DOUBLE, length(text) * 0.01::DOUBLE) AS rate FROM rh JOIN turns ON turn_id = clip_id)"""


@query("speech_rhythm", using("turns", body=f"WITH {_RHY} SELECT clip_id, syllables, round(mean_ms, 4) AS mean_ms, round(longest_ms, 4) AS longest_ms, round(sd_ms, 4) AS sd_ms, dur_s, round(rate, 6) AS rate FROM rt"))
def speech_rhythm(t):
    got = fr.rhythm(fr.syllable_nuclei(dense(t)), durations(t))
    return got.select("clip_id", "syllables", *[F.round(c, 4).alias(c) for c in ("mean_ms", "longest_ms", "sd_ms")], "dur_s", F.round("rate", 6).alias("rate"))


_PAU = f"""{_DENSE}, s0 AS (SELECT clip_id, i, db < max(db) OVER (PARTITION BY clip_id) - 25 AS silent FROM de),
        r0 AS (SELECT clip_id, min(i) AS i, count(*) AS n, any_value(silent) AS silent FROM (SELECT *, i - row_number() OVER (PARTITION BY clip_id, silent ORDER BY i) AS g FROM s0) GROUP BY clip_id, silent, g),
        s1 AS (SELECT clip_id, i, n, silent OR n * 0.01::DOUBLE < 0.02::DOUBLE AS silent FROM r0),
        r1 AS (SELECT clip_id, sum(n) AS n, any_value(silent) AS silent FROM (SELECT *, sum(f) OVER (PARTITION BY clip_id ORDER BY i) AS g FROM (SELECT *, CASE WHEN lag(silent) OVER (PARTITION BY clip_id ORDER BY i) = silent THEN 0 ELSE 1 END AS f FROM s1)) GROUP BY clip_id, g),
        pa AS (SELECT clip_id, count(*) FILTER (silent AND n * 0.01::DOUBLE >= 0.02::DOUBLE) AS pauses FROM r1 GROUP BY 1)"""


@query("silent_pauses", using("turns", body=f"WITH {_PAU} SELECT clip_id, pauses FROM pa"))
def silent_pauses(t):
    return fr.silent_pauses(dense(t), 0.01, 25.0, 0.02, 0.02)


@query(
    "prosody_scorecard",
    using(
        "turns",
        body=f"""WITH {_RHY}, {_PAU[len(_DENSE) + 2:]}, al AS (SELECT t.role, rt.*, pauses FROM rt JOIN pa USING (clip_id) JOIN turns t ON t.turn_id = clip_id),
        sm AS (SELECT role, count(*) AS n, printf('%.1f', avg(rate))::DOUBLE AS rate, printf('%.1f', avg(mean_ms))::DOUBLE AS mean_ms, printf('%.1f', avg(longest_ms))::DOUBLE AS longest_ms, printf('%.1f', avg(sd_ms))::DOUBLE AS sd_ms, printf('%.1f', avg(pauses))::DOUBLE AS pauses FROM al GROUP BY 1)
        SELECT *, CASE WHEN f = '' THEN 'natural' ELSE f END AS flags FROM (SELECT *, concat_ws('; ', CASE WHEN rate > 8 THEN 'too fast' END, CASE WHEN longest_ms <> 0 AND longest_ms < 220 THEN 'short nuclear syllable' END, CASE WHEN pauses < 0.5 THEN 'hardly any pause' END, CASE WHEN sd_ms <> 0 AND sd_ms < 40 THEN 'monotonous rhythm' END) AS f FROM sm)""".replace("SELECT *, CASE WHEN f = ''", "SELECT * EXCLUDE (f), CASE WHEN f = ''"),
    ),
)
def prosody_scorecard(t):
    d = dense(t)
    clips = fr.rhythm(fr.syllable_nuclei(d), durations(t)).join(fr.silent_pauses(d, 0.01, 25.0, 0.02, 0.02), "clip_id")
    roles_ = roles.turns(t).select(F.col("turn_id").alias("clip_id"), "role")
    return fr.prosody_summary(clips.join(roles_, "clip_id"), ["role"]).withColumn("flags", F.array_join("flags", "; "))


# ---- speakers, accents, latencies ------------------------------------------

_U = "list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE))))"


def _sim(mean_of: str, eps: str) -> str:
    return f"""WITH u AS (SELECT label, unnest(range(len(embedding))) AS d, unnest({mean_of}) AS x FROM embeddings WHERE vec_id % 3 = 0),
        c AS (SELECT label, d, avg(x) AS m FROM u GROUP BY 1, 2), z AS (SELECT label, sqrt(sum(m * m)) + {eps} AS n FROM c GROUP BY 1),
        e AS (SELECT vec_id, label, unnest(range(len(embedding))) AS d, unnest(embedding)::DOUBLE AS x FROM embeddings WHERE vec_id % 3 <> 0),
        s AS (SELECT vec_id, label AS speaker, sum(x * m / n) / (sqrt(sum(x * x)) + {eps}) AS sim FROM e JOIN c USING (label, d) JOIN z USING (label) GROUP BY 1, 2)"""


def _vectors(t):
    return t.embeddings.withColumnRenamed("label", "speaker")


@query("speaker_similarity", _sim(_U, "0") + " SELECT vec_id, speaker, round(sim, 6) AS spk_sim FROM s")
def speaker_similarity(t):
    v = _vectors(t)
    got = sk.similarity(v.where("vec_id % 3 <> 0"), v.where("vec_id % 3 = 0"))
    return got.select("vec_id", "speaker", F.round("spk_sim", 6).alias("spk_sim"))


@query("anchor_similarity", _sim("list_transform(embedding, lambda x: x::DOUBLE)", "1e-9") + " SELECT speaker, count(*) AS n, round(avg(sim), 6) AS mean, round(median(sim), 6) AS median FROM s GROUP BY 1")
def anchor_similarity(t):
    v = _vectors(t)
    got = sk.similarity_summary(sk.similarity(v.where("vec_id % 3 <> 0"), v.where("vec_id % 3 = 0"), raw_mean=True, eps=1e-9))
    return got.select("speaker", "n", F.round("mean", 6).alias("mean"), F.round("median", 6).alias("median"))


def formants(t):
    """Vowel measurements played by vector dimensions."""
    e = lambda i: F.col("embedding")[i].cast("double")
    aperture = F.when(e(0) > 0, "open").otherwise("closed")
    return t.embeddings.select(
        "vec_id", F.col("label").alias("speaker_id"), aperture.alias("aperture"), F.when(aperture == "open", "ɛ").otherwise("e").alias("vowel_label"),
        (e(0) * 600 + 500).alias("F1_Hz"), (e(1) * 900 + 1900).alias("F2_Hz"), (e(2) * 900 + 2700).alias("F3_Hz"), (e(3) * 300 + 120).alias("B1_Hz"), (e(4) * 100 + 90).alias("duration_ms"),
    )


_FO = """fo AS (SELECT vec_id, label AS speaker_id, embedding[1]::DOUBLE * 600 + 500 AS F1_Hz, embedding[2]::DOUBLE * 900 + 1900 AS F2_Hz, embedding[3]::DOUBLE * 900 + 2700 AS F3_Hz, embedding[4]::DOUBLE * 300 + 120 AS B1_Hz FROM embeddings),
        ok AS (SELECT * FROM fo WHERE F1_Hz BETWEEN 150 AND 1100 AND F2_Hz BETWEEN 500 AND 3200 AND F3_Hz BETWEEN 1800 AND 4200 AND B1_Hz BETWEEN 0 AND 400)"""


@query("plausible_formants", f"WITH {_FO} SELECT vec_id, round(F1_Hz, 4) AS F1_Hz FROM ok")
def plausible_formants(t):
    return ac.plausible(formants(t)).select("vec_id", F.round("F1_Hz", 4).alias("F1_Hz"))


@query(
    "formant_scores",
    f"""WITH {_FO} SELECT vec_id, round((F1_Hz - avg(F1_Hz) OVER w) / CASE WHEN stddev_samp(F1_Hz) OVER w = 0 THEN 1e-6 ELSE stddev_samp(F1_Hz) OVER w END, 6) AS F1_z, round((F2_Hz - avg(F2_Hz) OVER ()) / stddev_samp(F2_Hz) OVER (), 6) AS F2_global FROM ok WINDOW w AS (PARTITION BY speaker_id)""",
)
def formant_scores(t):
    rows = ac.plausible(formants(t))
    whole = ac.overall(rows).select("vec_id", F.round("F2_z", 6).alias("F2_global"))
    return ac.by_speaker(rows).select("vec_id", F.round("F1_z", 6).alias("F1_z")).join(whole, "vec_id")


def _accent_sets(t):
    rows = ac.plausible(formants(t))
    return ac.by_speaker(rows.where("speaker_id < 7")), ac.overall(rows.where("speaker_id >= 7"))


@query("accent_cross_domain")
def accent_cross_domain(t):
    return ac.cross_domain(*_accent_sets(t), "vec_id")


@query("accent_error_direction")
def accent_error_direction(t):
    return ac.error_direction(*_accent_sets(t))


@query(
    "latency_summary",
    """WITH x AS (SELECT event_type, value / 60 * 1000 AS ms, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS ix, count(*) OVER (PARTITION BY event_type) AS n FROM events)
        SELECT event_type, any_value(n) AS n, round(median(ms), 6) AS p50_ms, round(max(ms) FILTER (ix = least(n - 1, floor(0.95::DOUBLE * n))), 6) AS p95_ms, median(ms) < 800 AS pass FROM x GROUP BY 1""",
)
def latency_summary(t):
    got = lt.summarize(t.events, ["event_type"], F.col("value") / 60)
    return got.select("event_type", "n", F.round("p50_ms", 6).alias("p50_ms"), F.round("p95_ms", 6).alias("p95_ms"), "pass")


@query("real_time_factor", "SELECT role, count(*) AS n, round(median(CASE WHEN turn % 5 = 4 THEN 'inf'::DOUBLE ELSE length(text) / 100.0::DOUBLE / (turn % 5 + 1) END), 6) AS rtf FROM conversations GROUP BY 1")
def real_time_factor(t):
    from vozlake.operators.ordered import linear, quantiles

    audio = F.when(F.col("turn") % 5 == 4, 0.0).otherwise(F.col("turn") % 5 + 1.0)
    rows = t.conversations.select("role", lt.real_time_factor(F.length("text") / F.lit(100.0), audio).alias("rtf"))
    return quantiles(rows, ["role"], F.col("rtf"), {"rtf": linear(0.5)}).select("role", "n", F.round("rtf", 6).alias("rtf"))


@query(
    "endpoint_percentiles",
    """WITH x AS (SELECT event_type, list_sort(list(value)) AS v, count(*) AS n FROM events GROUP BY 1),
        q AS (SELECT event_type, n, v, unnest([50, 95]) AS p FROM x), j AS (SELECT *, least(greatest(p * (n + 1) // 100, 1), n - 1) AS j FROM q)
        SELECT event_type, n, round(max(((v[j] * (100 - (p * (n + 1) - j * 100)) + v[j + 1] * (p * (n + 1) - j * 100)) / 100.0::DOUBLE)) FILTER (p = 50), 6) AS p50,
        round(max(((v[j] * (100 - (p * (n + 1) - j * 100)) + v[j + 1] * (p * (n + 1) - j * 100)) / 100.0::DOUBLE)) FILTER (p = 95), 6) AS p95 FROM j GROUP BY 1, 2""",
)
def endpoint_percentiles(t):
    got = lt.endpoint_percentiles(t.events, ["event_type"], F.col("value"))
    return got.select("event_type", "n", F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"))


@query(
    "reply_bench",
    r"""WITH s AS (SELECT role, 0.5::DOUBLE + length(text) / 60.0::DOUBLE AS v, len(list_filter(list_transform(string_split(regexp_replace(text, '([.!?…])\s', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x, chr(9) || chr(10) || chr(13) || ' ')), lambda x: x <> '')) AS k FROM conversations),
        x AS (SELECT role, list_sort(list(v)) AS v, count(*) AS n, avg(k) AS sentences FROM s GROUP BY 1),
        q AS (SELECT *, unnest([50, 95]) AS p FROM x), j AS (SELECT *, least(greatest(p * (n + 1) // 100, 1), n - 1) AS j FROM q),
        r AS (SELECT role, n, sentences, p, (v[j] * (100 - (p * (n + 1) - j * 100)) + v[j + 1] * (p * (n + 1) - j * 100)) / 100.0::DOUBLE AS val FROM j)
        SELECT role, n, round(max(val) FILTER (p = 50), 6) AS p50, round(max(val) FILTER (p = 95), 6) AS p95, round(max(sentences), 6) AS sentences FROM r GROUP BY 1, 2""",
)
def reply_bench(t):
    seconds = F.lit(0.5) + F.length("text") / F.lit(60.0)
    got = lt.reply_bench(t.conversations, ["role"], seconds, F.col("text"))
    return got.select("role", "n", *[F.round(c, 6).alias(c) for c in ("p50", "p95", "sentences")])


@query(
    "cascade_floor",
    """WITH x AS (SELECT event_type, value / 100 AS asr, (event_id % 7) / 10.0::DOUBLE AS llm, (event_id % 5) / 10.0::DOUBLE AS tts FROM events),
        y AS (SELECT event_type, 'asr' AS stage, asr AS v FROM x UNION ALL SELECT event_type, 'llm', llm FROM x UNION ALL SELECT event_type, 'tts', tts FROM x UNION ALL SELECT event_type, 'total', asr + llm + tts FROM x)
        SELECT event_type, stage, count(*) AS n, round(median(v * 1000), 6) AS p50_ms, CASE WHEN stage = 'total' THEN median(v * 1000) < 800 END AS "within" FROM y GROUP BY 1, 2""",
)
def cascade_floor(t):
    e = F.col("event_id")
    rows = t.events.select("event_type", (F.col("value") / 100).alias("asr"), (e % 7 / F.lit(10.0)).alias("llm"), (e % 5 / F.lit(10.0)).alias("tts"))
    return lt.cascade_floor(rows, ["asr", "llm", "tts"], ["event_type"]).withColumn("p50_ms", F.round("p50_ms", 6))
