"""Queries on curation, gates, licences and their reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from vozlake.functions import license as lic
from vozlake.functions import text as tx
from vozlake.operators import edits as ed
from vozlake.operators import gates
from vozlake.plans import roles
from vozlake.plans.registry import query
from vozlake.plans.roles import s_alnum, s_strip, s_tokens, s_words, using
from vozlake.session import materialize


def resolved(t):
    return ed.resolve(roles.clips(t), roles.edits(t), ("estilo_nl",))


def gated(t):
    return gates.export_gates(resolved(t))


@query(
    "export_scoreboard",
    using(
        "gated",
        body="""SELECT CASE WHEN grouping(speaker) = 1 THEN 'TOTAL' ELSE speaker END AS speaker, count(*) AS total,
        count(*) FILTER (reason IS NULL) AS kept, round(coalesce(sum(dur_s) FILTER (reason IS NULL) / 60, 0), 4) AS minutes,
        round(100.0::DOUBLE * count(*) FILTER (reason IS NULL) / count(*), 4) AS keep_pct,
        count(*) FILTER (reason IS NOT NULL) AS rejected FROM gated GROUP BY ROLLUP (speaker)""",
    ),
)
def export_scoreboard(t):
    return gates.scoreboard(gates.decisions(resolved(t)))


@query(
    "export_reject_histogram",
    using(
        "gated",
        body=f"""SELECT speaker, {s_strip("regexp_extract(reason, '^([^:(]*)', 1)")} AS reason_head, count(*) AS n
        FROM gated WHERE reason IS NOT NULL GROUP BY 1, 2""",
    ),
)
def export_reject_histogram(t):
    return gates.reject_histogram(gates.decisions(resolved(t)))


@query(
    "export_gate_reasons",
    using("gated", body="SELECT id, speaker, dur_s, reason FROM gated"),
)
def export_gate_reasons(t):
    return gated(t).select("id", "speaker", "dur_s", "reason")


@query(
    "edits_resolved",
    using(
        "resolved",
        body="SELECT id, keep, edited, array_to_string(flags, ',') AS flags, estilo_nl, md5(text) AS text_md5, length(text) AS chars FROM resolved",
    ),
)
def edits_resolved(t):
    return resolved(t).select(
        "id", "keep", "edited", F.array_join("flags", ",").alias("flags"), "estilo_nl", F.md5("text").alias("text_md5"), F.length("text").alias("chars")
    )


@query(
    "kept_table",
    using("resolved", body="SELECT id, audio, dur_s, md5(text) AS text_md5 FROM resolved WHERE keep"),
)
def kept_table(t):
    return ed.kept_table(resolved(t)).select("id", "audio", "dur_s", F.md5("text").alias("text_md5"))


@query(
    "edits_field_merge",
    using(
        "edits",
        body="""SELECT id, max(seq) AS seq, arg_max(keep, seq) AS keep, arg_max(text, seq) FILTER (text IS NOT NULL) IS NOT NULL AS has_any_text,
        array_to_string(arg_max(flags, seq), ',') AS flags FROM edits GROUP BY id""",
    ),
)
def edits_field_merge(t):
    merged = ed.merge_fields(roles.edits(t), ["id"])
    return merged.select("id", "seq", "keep", F.col("text").isNotNull().alias("has_any_text"), F.array_join("flags", ",").alias("flags"))


@query(
    "clips_not_edited",
    using("clips", "edits", body="SELECT id, speaker FROM clips WHERE id NOT IN (SELECT id FROM edits)"),
)
def clips_not_edited(t):
    return ed.not_done(roles.clips(t), roles.edits(t)).select("id", "speaker")


@query(
    "segments_upsert",
    using(
        "clips",
        body=f"""SELECT id, max(seq) AS seq, arg_max(dur_s, seq) AS dur_s FROM (SELECT id, seq, dur_s FROM clips
        UNION ALL SELECT id, seq + {roles.LATE}, dur_s + 1 FROM clips WHERE seq % 3 = 0) GROUP BY id""",
    ),
)
def segments_upsert(t):
    now = roles.clips(t).select("id", "seq", "dur_s")
    new = now.where(F.col("seq") % 3 == 0).select("id", (F.col("seq") + roles.LATE).alias("seq"), (F.col("dur_s") + 1).alias("dur_s"))
    return ed.upsert(now, new, ["id"])


_LEVELS = "CASE WHEN seq % 13 = 0 THEN 0.001::DOUBLE ELSE (seq % 97 + 1) / 97.0::DOUBLE END"


def _with_levels(t):
    rms = F.when(F.col("seq") % 13 == 0, F.lit(0.001)).otherwise((F.col("seq") % 97 + 1) / F.lit(97.0))
    return roles.clips(t).withColumn("rms", rms).withColumn("peak", rms)


@query(
    "auto_curation_reasons",
    using(
        "clips",
        body=f"""WITH x AS (SELECT id, dur_s, {s_strip("coalesce(text, '')")} AS t, {_LEVELS} AS lev FROM clips),
        y AS (SELECT *, len({s_tokens("t")}) AS w, {s_tokens("lower(t)")} AS toks FROM x),
        z AS (SELECT *, list_filter([CASE WHEN t = '' THEN 'vazio' END, CASE WHEN w BETWEEN 1 AND 2 THEN 'fragmento (' || w::VARCHAR || ' pal)' END,
        CASE WHEN dur_s < 1 THEN 'curto ' || printf('%.1fs', dur_s) END, CASE WHEN dur_s > 12 THEN 'longo ' || printf('%.1fs', dur_s) END,
        CASE WHEN (len(toks) >= 4 AND len(list_distinct(toks)) <= 2) OR length(t) BETWEEN 1 AND 2 THEN 'repetição/garbage' END,
        CASE WHEN lev < 0.004 THEN printf('quase-silêncio (rms %.3f)', lev) END,
        CASE WHEN lev > 0.995 THEN printf('clipping (peak %.3f)', lev) END], lambda r: r IS NOT NULL) AS rs FROM y)
        SELECT id, array_to_string(rs, '; ') AS reasons, len(rs) > 0 AS dropped,
        CASE WHEN len(rs) = 0 THEN array_to_string(list_filter([CASE WHEN regexp_matches(t, '[0-9]') THEN 'tem número (alvo de re-transcrição)' END,
        CASE WHEN dur_s > 10.5 THEN 'quase no teto (' || printf('%.1fs', dur_s) || ')' END,
        CASE WHEN w > 40 THEN 'run-on (' || w::VARCHAR || ' pal)' END], lambda r: r IS NOT NULL), '; ') ELSE '' END AS suspicions FROM z""",
    ),
)
def auto_curation_reasons(t):
    return gates.auto_reasons(_with_levels(t), "rms", "peak").select("id", "reasons", "dropped", "suspicions")


@query(
    "auto_curation_histogram",
    using(
        "clips",
        body=f"""WITH y AS (SELECT dur_s, {s_strip("coalesce(text, '')")} AS t FROM clips),
        z AS (SELECT CASE WHEN t = '' THEN 'vazio' WHEN len({s_tokens("t")}) BETWEEN 1 AND 2 THEN 'fragmento'
        WHEN dur_s < 1 THEN 'curto ' || printf('%.1fs', dur_s) WHEN dur_s > 12 THEN 'longo ' || printf('%.1fs', dur_s)
        WHEN (len({s_tokens("t")}) >= 4 AND len(list_distinct({s_tokens("lower(t)")})) <= 2) OR length(t) BETWEEN 1 AND 2 THEN 'repetição/garbage' END AS head FROM y)
        SELECT head, count(*) AS n FROM z WHERE head IS NOT NULL GROUP BY 1""",
    ),
)
def auto_curation_histogram(t):
    rows = materialize(gates.auto_reasons(roles.clips(t)).select("reasons", "dropped"), "reasons").where("dropped")
    return rows.groupBy(tx.first_reason_head(F.col("reasons")).alias("head")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "pre_flags",
    using(
        "clips",
        body=f"""SELECT id, array_to_string(list_filter([CASE WHEN {s_strip("coalesce(text, '')")} = '' THEN 'vazio' END,
        CASE WHEN dur_s <> 0 AND dur_s < 2 THEN 'curto' END, CASE WHEN dur_s <> 0 AND dur_s > 12 THEN 'longo' END],
        lambda r: r IS NOT NULL), ',') AS pre FROM clips""",
    ),
)
def pre_flags(t):
    return gates.pre_flags(roles.clips(t)).select("id", F.array_join("pre", ",").alias("pre"))


@query(
    "hygiene_presets",
    using(
        "clips",
        body=f"""WITH p(preset, lo, hi, w) AS (VALUES ('export', 1.0::DOUBLE, 12.0::DOUBLE, 2), ('base_train', 1.5, 12.0, 3), ('language', 1.5, 20.0, 3),
        ('base_corpus', 1.0, 20.0, 1), ('conversation', 1.5, NULL, 3)),
        c AS (SELECT dur_s, len({s_tokens("text")}) AS n FROM clips)
        SELECT preset, count(*) AS clips, round(sum(dur_s) / 60, 4) AS minutes FROM p, c
        WHERE dur_s >= lo AND (hi IS NULL OR dur_s <= hi) AND n >= w GROUP BY 1""",
    ),
)
def hygiene_presets(t):
    rows = roles.clips(t)
    words, dur = tx.token_count(F.col("text")), F.col("dur_s")
    fits = gates.some(
        [((dur >= lo) & (F.lit(True) if hi is None else dur <= hi) & (words >= w), name) for name, (lo, hi, w) in gates.HYGIENE.items()]
    )
    return (
        rows.select("dur_s", F.explode(fits).alias("preset"))
        .groupBy("preset")
        .agg(F.count(F.lit(1)).alias("clips"), F.round(F.sum("dur_s") / 60, 4).alias("minutes"))
    )


_BOUNDS = f"""ok AS (SELECT * FROM gated WHERE reason IS NULL),
        r AS (SELECT *, dur_s / greatest({s_alnum("text")}, 1)::DOUBLE AS rate FROM ok),
        k AS (SELECT *, row_number() OVER (PARTITION BY speaker ORDER BY rate) - 1 AS ix, count(*) OVER (PARTITION BY speaker) AS cnt FROM r),
        b AS (SELECT speaker, any_value(cnt) AS cnt, max(rate) FILTER (ix = cnt // 4) AS q1, max(rate) FILTER (ix = 3 * cnt // 4) AS q3 FROM k GROUP BY 1)"""


@query(
    "duration_char_bounds",
    using(
        "gated",
        body=f"""WITH {_BOUNDS} SELECT speaker, cnt AS n, round(q1, 8) AS q1, round(q3, 8) AS q3, round(q1 - 1.5 * (q3 - q1), 8) AS lo,
        round(q3 + 1.5 * (q3 - q1), 8) AS hi FROM b""",
    ),
)
def duration_char_bounds(t):
    got = gates.duration_char_bounds(gates.decisions(resolved(t)).where("reason is null"))
    return got.select("speaker", "n", *[F.round(c, 8).alias(c) for c in ("q1", "q3", "lo", "hi")])


@query(
    "duration_char_gate",
    using(
        "gated",
        body=f"""WITH {_BOUNDS} SELECT id, speaker, round(rate, 8) AS rate,
        cnt >= 12 AND NOT rate BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS outlier FROM r JOIN b USING (speaker)""",
    ),
)
def duration_char_gate(t):
    got = gates.duration_char_gate(gates.decisions(resolved(t)).where("reason is null"))
    return got.select("id", "speaker", F.round("rate", 8).alias("rate"), "outlier")


@query(
    "strict_export_scoreboard",
    using(
        "gated",
        body=f"""WITH {_BOUNDS}, o AS (SELECT id FROM r JOIN b USING (speaker) WHERE cnt >= 12 AND NOT rate BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)),
        g AS (SELECT speaker, dur_s, reason IS NULL AND id NOT IN (SELECT id FROM o) AS good FROM gated)
        SELECT CASE WHEN grouping(speaker) = 1 THEN 'TOTAL' ELSE speaker END AS speaker, count(*) AS total, count(*) FILTER (good) AS kept,
        round(coalesce(sum(dur_s) FILTER (good) / 60, 0), 4) AS minutes, round(100.0::DOUBLE * count(*) FILTER (good) / count(*), 4) AS keep_pct,
        count(*) FILTER (NOT good) AS rejected FROM g GROUP BY ROLLUP (speaker)""",
    ),
)
def strict_export_scoreboard(t):
    g = gates.decisions(resolved(t))
    passed = gates.strict_duration_char(gates.duration_char_gate(g.where("reason is null")))
    cols = ["speaker", "dur_s", "reason"]
    return gates.scoreboard(passed.select(*cols).unionByName(g.where("reason is not null").select(*cols)))


@query(
    "segments_replace_parents",
    using(
        "clips",
        body="""SELECT kind, count(*) AS n, round(sum(dur_s), 2) AS seconds FROM (SELECT kind, dur_s FROM clips WHERE kind NOT IN ('monologo', 'dialogo', 'found')
        UNION ALL SELECT 'segment', dur_s / 2 FROM clips WHERE kind IN ('monologo', 'dialogo') AND seq % 2 = 0 AND text <> '') GROUP BY 1""",
    ),
)
def segments_replace_parents(t):
    rows = roles.clips(t)
    parents = rows.where(F.col("kind").isin("monologo", "dialogo"))
    segments = parents.select(
        "id", F.lit("segment").alias("kind"), (F.col("dur_s") / 2).alias("dur_s"), F.when(F.col("seq") % 2 == 0, F.col("text")).alias("text")
    )
    out = gates.without_parent_kinds(rows, segments)
    return out.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("dur_s"), 2).alias("seconds"))


@query(
    "curation_progress",
    using(
        "resolved",
        body="""SELECT unnest(['total', 'reviewed', 'keep', 'drop', 'minutes_kept']) AS metric, unnest([count(*)::DOUBLE, count(*) FILTER (edited),
        count(*) FILTER (keep), count(*) FILTER (NOT keep), round(sum(dur_s) FILTER (keep) / 60, 1)]) AS value FROM resolved
        UNION ALL SELECT 'flag:' || f, count(*) FROM (SELECT unnest(flags) AS f FROM resolved) GROUP BY 1""",
    ),
)
def curation_progress(t):
    return gates.curation_progress(resolved(t))


@query(
    "curation_by_user",
    using(
        "resolved",
        body="SELECT speaker, count(*) AS total, count(*) FILTER (edited) AS edited, count(*) FILTER (NOT keep) AS dropped FROM resolved GROUP BY 1",
    ),
)
def curation_by_user(t):
    return gates.user_progress(resolved(t))


@query(
    "scripted_digits",
    using("clips", body="SELECT id, kind FROM clips WHERE kind IN ('sentenca', 'emocao', 'sotaque', 'dialogo') AND regexp_matches(text, '[0-9]')"),
)
def scripted_digits(t):
    return gates.scripted_digits(roles.clips(t)).select("id", "kind")


_OK = """(regexp_matches(lower(license), 'cc-by-4|cc-by-3|cc0|mit|apache|própria|propria') AND NOT regexp_matches(lower(license),
        '-nc|nc-|noncomm|-nd|nd-|sem licença|sem licenca|pago|bloqueado|nc|nd'))"""
_RESEARCH = "(NOT regexp_matches(lower(license), 'sem acesso|sem dado|bloqueado|pago|elra'))"


@query(
    "license_tiers",
    using(
        "manifest",
        body=f"""SELECT id, CASE WHEN NOT {_OK} THEN 'T2 eval-only / T3 judge-only'
        WHEN contains(kind || accent, 'judicial') AND NOT consent THEN 'T4 bloqueado'
        WHEN dnsmos < 3 THEN 'T0 base-pretrain'
        WHEN contains(accent, 'carioca') OR contains(lower(license), 'própr') THEN 'T1 fine-tune-voz'
        WHEN regexp_matches(kind, 'espont|convers|diálogo') THEN 'T1 fine-tune' ELSE 'T0 base-pretrain' END AS tier,
        {_OK} AND NOT (contains(kind || accent, 'judicial') AND NOT consent) AS shippable, {_RESEARCH} AS research FROM manifest""",
    ),
)
def license_tiers(t):
    c = F.col
    got = roles.manifest(t).withColumn("v", lic.tier(c("license"), c("accent"), c("kind"), c("dnsmos"), c("consent")))
    return got.select("id", c("v.tier").alias("tier"), c("v.shippable").alias("shippable"), lic.research_ok(c("license")).alias("research"))


@query(
    "license_violations",
    using(
        "manifest",
        body=f"""SELECT 'commercial' AS mode, source, count(*) AS n FROM manifest WHERE NOT {_OK} GROUP BY 2
        UNION ALL SELECT 'research', source, count(*) FROM manifest WHERE NOT {_RESEARCH} GROUP BY 2""",
    ),
)
def license_violations(t):
    rows = roles.manifest(t)
    count = lambda mode: gates.license_violations(rows, mode).groupBy(F.lit(mode).alias("mode"), "source").agg(F.count(F.lit(1)).alias("n"))
    return count("commercial").unionByName(count("research"))


@query(
    "license_asserted_manifest",
    using("manifest", body=f"SELECT id, source, license FROM manifest WHERE {_RESEARCH}"),
)
def license_asserted_manifest(t):
    usable = roles.manifest(t).where(lic.research_ok(F.col("license")))
    return gates.assert_licenses(usable, "research").select("id", "source", "license")


def _registry(t):
    """One registry entry per source of the manifest."""
    rows = roles.manifest(t).groupBy(F.col("source").alias("nome")).agg(F.max("license").alias("licenca"), F.count(F.lit(1)).alias("clips"))
    marked = F.when(F.replace(F.col("nome"), F.lit("src"), F.lit("")).cast("long") % 2 == 0, "true").otherwise("false")
    tier = F.when(lic.commercial_ok(F.col("licenca")), "T0 base").otherwise("T2 eval")
    return rows.withColumn("shippable", marked).withColumn("tier", tier)


_REG = f"""reg AS (SELECT source AS nome, max(license) AS licenca, CASE WHEN replace(source, 'src', '')::BIGINT % 2 = 0 THEN 'true' ELSE 'false' END AS shippable,
        CASE WHEN {_OK.replace("license", "max(license)")} THEN 'T0 base' ELSE 'T2 eval' END AS tier FROM manifest GROUP BY 1)"""


@query(
    "registry_violations",
    using("manifest", body=f"WITH {_REG} SELECT nome, licenca FROM reg WHERE shippable = 'true' AND NOT {_OK.replace('license', 'licenca')}"),
)
def registry_violations(t):
    return gates.registry_violations(_registry(t)).select("nome", "licenca")


@query(
    "tier_manifest",
    using("manifest", body=f"WITH {_REG} SELECT nome, licenca AS license, tier, nome AS source, shippable = 'true' AS shippable FROM reg WHERE starts_with(tier, 'T0')"),
)
def tier_manifest(t):
    return gates.tier_manifest(_registry(t), "T0")


@query(
    "volume_preflight",
    using("clips", body="SELECT speaker, floor(sum(dur_s) / 60)::BIGINT AS minutes, floor(sum(dur_s) / 60) >= 10 AS enough FROM clips GROUP BY 1"),
)
def volume_preflight(t):
    return gates.volume_preflight(roles.clips(t), 10.0)


@query(
    "text_measures",
    using(
        "clips",
        body=f"""SELECT id, len({s_words("text")}) AS unicode_words, len({s_tokens("text")}) AS tokens, {s_alnum("text")} AS alnum,
        round(dur_s / greatest({s_alnum("text")}, 1), 8) AS rate FROM clips""",
    ),
)
def text_measures(t):
    x = F.col("text")
    return roles.clips(t).select(
        "id",
        tx.unicode_word_count(x).alias("unicode_words"),
        tx.token_count(x).alias("tokens"),
        tx.alnum_chars(x).alias("alnum"),
        F.round(tx.seconds_per_char(F.col("dur_s"), x), 8).alias("rate"),
    )
