"""Queries on dialogues, meetings and recording plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from vozlake.functions import text as tx
from vozlake.operators import dialogue as dg
from vozlake.operators import splits as sp
from vozlake.plans import roles
from vozlake.plans.registry import query
from vozlake.plans.roles import s_tokens, using


@query(
    "turn_context",
    using(
        "turns",
        body="""SELECT turn_id, count(b.text) AS n, coalesce(string_agg(b.role, ',' ORDER BY b.turn), '') AS context_roles, coalesce(sum(length(b.text)), 0)::BIGINT AS chars
        FROM (SELECT a.turn_id, a.conv_id, a.turn AS t FROM turns a) a LEFT JOIN turns b ON b.conv_id = a.conv_id AND b.turn < a.t AND b.turn >= a.t - 4 GROUP BY 1""".replace("SELECT turn_id, count", "SELECT a.turn_id, count"),
    ),
)
def turn_context(t):
    got = dg.turn_context(roles.turns(t), 4)
    chars = F.aggregate("context", F.lit(0), lambda s, c: s + F.length(c["text"]))
    return got.select("turn_id", F.size("context").alias("n"), F.array_join(F.transform("context", lambda c: c["role"]), ",").alias("context_roles"), chars.cast("long").alias("chars"))


def spoken(t):
    rows = roles.turns(t)
    return rows.select(
        "conv_id", "turn", "text", F.floor(F.col("dur_s") * 24000).alias("samples"), (F.col("turn") % 3 == 2).alias("bc"), F.when(F.col("role") == "assistant", "A").otherwise("B").alias("spk")
    )


_SP = """sp AS (SELECT conv_id, turn, text, floor(dur_s * 24000)::BIGINT AS samples, turn % 3 = 2 AND turn > min(turn) OVER (PARTITION BY conv_id) AS bc, CASE WHEN role = 'assistant' THEN 'A' ELSE 'B' END AS spk FROM turns),
        cu AS (SELECT *, coalesce(sum(CASE WHEN bc THEN 0 ELSE samples + 9600 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS cursor,
          sum(CASE WHEN bc THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY turn) AS g, sum(samples) OVER (PARTITION BY conv_id) + count(*) OVER (PARTITION BY conv_id) * 9600 AS total FROM sp),
        ba AS (SELECT conv_id, g, cursor AS bs, samples AS bd FROM cu WHERE NOT bc),
        ti AS (SELECT cu.*, least(CASE WHEN bc THEN bs + floor(0.6::DOUBLE * bd) ELSE cursor END, total - samples)::BIGINT AS st FROM cu LEFT JOIN ba USING (conv_id, g))"""


@query(
    "dialogue_timeline",
    using("turns", body=f"WITH {_SP} SELECT conv_id, turn, st AS \"start\", st + samples AS \"end\", CASE WHEN spk = 'A' THEN 'left' ELSE 'right' END AS channel, CASE WHEN spk = 'A' THEN 'SPEAKER_MAIN' ELSE 'SPEAKER_OTHER' END AS role_label FROM ti"),
)
def dialogue_timeline(t):
    return dg.dialogue_timeline(spoken(t)).select("conv_id", "turn", "start", "end", "channel", "role_label")


@query(
    "dialogue_alignments",
    using(
        "turns",
        body=f"""WITH {_SP} SELECT conv_id, md5('{{{{"alignments": [' || string_agg('[' || to_json(text)::VARCHAR || ', [' || round(st / 24000.0::DOUBLE, 3) || ', ' || round((st + samples) / 24000.0::DOUBLE, 3) || '], '
        || CASE WHEN spk = 'A' THEN '"SPEAKER_MAIN"' ELSE '"SPEAKER_OTHER"' END || ']', ', ' ORDER BY turn) || ']}}}}') AS json_md5 FROM ti GROUP BY 1""".replace("{{", "{").replace("}}", "}"),
    ),
)
def dialogue_alignments(t):
    return dg.alignment_json(dg.dialogue_timeline(spoken(t))).select("conv_id", F.md5("json").alias("json_md5"))


@query("nested_dialogues", using("turns", body="SELECT conv_id, count(*) AS turns, string_agg(role, '>' ORDER BY turn) AS roles, md5(string_agg(text, '|' ORDER BY turn)) AS text_md5 FROM turns GROUP BY 1"))
def nested_dialogues(t):
    got = dg.nested_dialogues(roles.turns(t))
    pick = lambda f: F.transform("turns", lambda x: x[f])
    return got.select("conv_id", F.size("turns").alias("turns"), F.array_join(pick("role"), ">").alias("roles"), F.md5(F.array_join(pick("text"), "|")).alias("text_md5"))


def diarized(t):
    return dg.dialogue_timeline(spoken(t)).select("conv_id", F.col("spk").alias("speaker"), (F.col("start") / F.lit(24000.0)).alias("start"), (F.col("end") / F.lit(24000.0)).alias("end"))


@query("speaking_time", using("turns", body=f"WITH {_SP} SELECT conv_id, spk AS speaker, round(sum((st + samples) / 24000.0::DOUBLE - st / 24000.0::DOUBLE), 6) AS seconds FROM ti GROUP BY 1, 2"))
def speaking_time(t):
    return dg.speaking_time(diarized(t)).withColumn("seconds", F.round("seconds", 6))


_MAIN = f"{_SP}, sm AS (SELECT conv_id, arg_max(spk, s) AS main FROM (SELECT conv_id, spk, sum((st + samples) / 24000.0::DOUBLE - st / 24000.0::DOUBLE) AS s FROM ti GROUP BY 1, 2) GROUP BY 1)"


@query("main_speakers", using("turns", body=f"WITH {_MAIN}, fs AS (SELECT conv_id, min(spk) AS first FROM sp GROUP BY 1) SELECT conv_id, main, first FROM sm JOIN fs USING (conv_id)"))
def main_speakers(t):
    times = dg.speaking_time(diarized(t))
    return dg.main_speaker(times).join(dg.main_speaker(times, auto=False).withColumnRenamed("main", "first"), "conv_id")


@query(
    "channel_masks",
    using(
        "turns",
        body=f"""WITH {_MAIN}, f AS (SELECT conv_id, i, i * 0.5::DOUBLE AS t FROM (SELECT conv_id, unnest(range(n)) AS i FROM (SELECT conv_id, floor(max(st + samples) / 12000.0::DOUBLE)::BIGINT AS n FROM ti GROUP BY 1)))
        SELECT f.conv_id, f.i, bool_or(spk = main) AS "left", bool_or(spk <> main) AS "right" FROM f JOIN ti ON ti.conv_id = f.conv_id AND t >= st / 24000.0::DOUBLE AND t < (st + samples) / 24000.0::DOUBLE JOIN sm ON sm.conv_id = f.conv_id GROUP BY 1, 2""",
    ),
)
def channel_masks(t):
    d = diarized(t)
    ends = d.groupBy("conv_id").agg(F.floor(F.max("end") * 2).alias("n"))
    frames = ends.where("n > 0").select("conv_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("i")).withColumn("t", F.col("i") * F.lit(0.5))
    return dg.channel_masks(d, frames, dg.main_speaker(dg.speaking_time(d)))


def meeting(t):
    """Meeting samples: session = user group, speaker = event type, i = hour."""
    i = F.floor(roles.epoch_us(F.col("ts")) / 3600000000) - 473352
    rows = t.events.select((F.col("user_id") % 10).alias("session"), F.col("event_type").alias("speaker"), i.alias("i"), ((F.col("value") - 50) / F.lit(150.0)).alias("x"))
    return rows.groupBy("session", "speaker", "i").agg(F.avg("x").alias("x"))


_ME = "me AS (SELECT user_id % 10 AS session, event_type AS speaker, (epoch_us(ts) // 3600000000)::BIGINT - 473352 AS i, avg((value - 50) / 150.0::DOUBLE) AS x FROM events GROUP BY 1, 2, 3)"


@query("meeting_blocks", f"WITH {_ME} SELECT session, speaker, i // 100 AS block, count(*) AS samples, round(sqrt(avg(x * x)), 6) AS rms FROM me GROUP BY 1, 2, 3 HAVING count(*) >= 20 AND sqrt(avg(x * x)) >= 1e-3")
def meeting_blocks(t):
    return dg.blocks(meeting(t), 100, min_samples=20).withColumn("rms", F.round("rms", 6))


#: The same samples as whole steps of 16 bits, so that sums over speakers are exact.
STEPS = 32767
_MS = f"ms AS (SELECT session, speaker, i, round(x * {STEPS}) AS x FROM me)"


@query(
    "meeting_role_pairs",
    f"""WITH {_ME}, {_MS}, c AS (SELECT session, min(m) AS m, count(*) AS k0 FROM (SELECT session, speaker, max(i) AS m FROM ms GROUP BY 1, 2) GROUP BY 1), cl AS (SELECT ms.* FROM ms JOIN c USING (session) WHERE i <= m),
        k AS (SELECT session, count(DISTINCT speaker) AS k FROM cl GROUP BY 1),
        p AS (SELECT a.session, a.speaker AS agent, a.i, any_value(a.x) AS l, coalesce(sum(b.x), 0) / greatest(1, any_value(k) - 1) AS r FROM cl a LEFT JOIN cl b ON a.session = b.session AND a.i = b.i AND a.speaker <> b.speaker JOIN k ON k.session = a.session GROUP BY 1, 2, 3),
        t AS (SELECT session, agent, max(abs(r)) AS top FROM p GROUP BY 1, 2)
        SELECT session, agent, count(*) AS samples, round(sum(l) / {STEPS}::DOUBLE, 3) AS "left", round(sum(r * CASE WHEN top > {0.99 * STEPS}::DOUBLE THEN {0.99 * STEPS}::DOUBLE / top ELSE 1 END) / {STEPS}::DOUBLE, 3) AS "right" FROM p JOIN t USING (session, agent) GROUP BY 1, 2""",
)
def meeting_role_pairs(t):
    got = dg.role_pairs(meeting(t).withColumn("x", F.round(F.col("x") * STEPS)), peak=0.99 * STEPS)
    total = lambda side: F.round(F.sum(side) / STEPS, 3).alias(side)
    return got.groupBy("session", "agent").agg(F.count(F.lit(1)).alias("samples"), total("left"), total("right"))


_EST = "CASE kind WHEN 'monologo' THEN 110 WHEN 'dialogo' THEN 90 ELSE 12 END"


@query(
    "recording_plan",
    using("clips", body=f"SELECT id, est FROM (SELECT id, {_EST} AS est, sum({_EST}) OVER (ORDER BY seq) AS used FROM clips) WHERE used <= 2700 * 0.4::DOUBLE".replace("SELECT id, est FROM", "SELECT id, est AS est_s FROM")),
)
def recording_plan(t):
    items = roles.clips(t).select("id", "seq", dg.estimate_of(F.col("kind")).alias("est_s"))
    return sp.time_budget(items, 45 * 60 * dg.MIX["core"]).select("id", "est_s")


_PARTS = {"core": "kind = 'sentenca'", "emotion": "kind = 'emocao'", "accent": "kind = 'sotaque'", "conversation": "kind IN ('monologo', 'dialogo')"}


@query(
    "recording_session",
    using("clips", body=" UNION ALL ".join(
        f"SELECT '{name}' AS part, {k} AS part_no, id, est AS est_s FROM (SELECT id, {_EST} AS est, sum({_EST}) OVER (ORDER BY seq) AS used FROM clips WHERE {_PARTS[name]}) WHERE used <= 2700 * {share}::DOUBLE" for k, (name, share) in enumerate(dg.MIX.items()))),
)
def recording_session(t):
    items = roles.clips(t).withColumn("est_s", dg.estimate_of(F.col("kind")))
    parts = {name: items.where(where).select("id", "seq", "est_s") for name, where in _PARTS.items()}
    return dg.recording_mix(parts).select("part", "part_no", "id", "est_s")


@query("session_minutes", using("clips", body=f"SELECT count(*) AS items, round(sum({_EST}) / 60.0::DOUBLE, 6) AS minutes FROM clips"))
def session_minutes(t):
    return dg.session_minutes(roles.clips(t)).withColumn("minutes", F.round("minutes", 6))


def cards(t):
    d = F.col("doc_id")
    return t.documents.select(
        d.alias("seq"), F.concat(F.lit("s"), d.cast("string")).alias("style"), F.col("lang").alias("accent"), F.concat(F.lit("Fala "), "lang").alias("direction"),
        F.array(F.lit("leve"), F.lit("forte")).alias("intensities"), F.split("text", "\n").alias("sentences"),
    )


@query(
    "emotion_prompts",
    """WITH c AS (SELECT doc_id AS seq, 's' || doc_id AS style, 'Fala ' || lang AS direction, string_split(text, chr(10)) AS sen FROM documents),
        o AS (SELECT seq, 1 AS block, 'emo_' || style || '_anchor_' || item_id AS id, b.text, 'media' AS intensity FROM c, benchmark b
        UNION ALL SELECT seq, 2, 'emo_' || style || '_' || lv || '_' || lpad(k::VARCHAR, greatest(2, length(k::VARCHAR))::INTEGER, '0'), line, lv FROM (SELECT seq, style, lv, unnest(sen) AS line, unnest(range(len(sen))) AS k FROM c, (VALUES ('leve'), ('forte')) v(lv))
        UNION ALL SELECT seq, 3, 'emo_' || style || '_freeform', '[IMPROVISO 2–3min no estilo ' || style || ']', 'media' FROM c)
        SELECT seq, block, intensity, count(*) AS n, min(id) AS first_id, max(id) AS last_id, md5(min(text)) AS text_md5 FROM o GROUP BY 1, 2, 3""",
)
def emotion_prompts(t):
    anchors = t.benchmark.select(F.col("item_id").alias("seq"), F.col("item_id").alias("id"), "text")
    got = dg.emotion_prompts(cards(t), anchors)
    return got.groupBy("seq", "block", "intensity").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.md5(F.min("text")).alias("text_md5"))


@query(
    "accent_prompts",
    "SELECT seq, n, 'acc_' || lang || '_' || lpad(n::VARCHAR, 2, '0') AS id, md5(text) AS text_md5 FROM (SELECT doc_id AS seq, lang, unnest(string_split(text, chr(10))) AS text, unnest(range(len(string_split(text, chr(10))))) AS n FROM documents)",
)
def accent_prompts(t):
    return dg.accent_prompts(cards(t)).select("seq", "n", "id", F.md5("text").alias("text_md5"))


@query(
    "conversation_prompts",
    """WITH n AS (SELECT conv_id, string_agg('  ' || role || ': ' || text, chr(10) ORDER BY turn) AS lines, arg_min(text, turn) AS topic FROM conversations GROUP BY 1)
        SELECT conv_id AS seq, CASE conv_id % 3 WHEN 0 THEN 'mono_' WHEN 1 THEN 'dial_' ELSE 'para_' END || lpad(conv_id::VARCHAR, 2, '0') AS id, CASE conv_id % 3 WHEN 0 THEN 'monologo' WHEN 1 THEN 'dialogo' ELSE 'paralinguistico' END AS kind,
        md5(CASE conv_id % 3 WHEN 0 THEN '[IMPROVISO 60–90s] Tema: ' || topic WHEN 1 THEN '[DIÁLOGO — Conversa ' || conv_id || ']' || chr(10) || lines ELSE '[riso] — 3 a 5 repetições variadas' END) AS text_md5, CASE conv_id % 3 WHEN 0 THEN 110 WHEN 1 THEN 90 ELSE 60 END AS est_s FROM n""",
)
def conversation_prompts(t):
    c = F.col("conv_id")
    nested = dg.nested_dialogues(roles.turns(t).withColumn("who", F.col("role")), fields=("who", "text"))
    prompts = nested.select(
        c.alias("seq"), F.when(c % 3 == 0, "monologo").when(c % 3 == 1, "dialogo").otherwise("riso").alias("kind"), F.col("turns")[0]["text"].alias("topic"),
        F.concat(F.lit("Conversa "), c.cast("string")).alias("title"), "turns", F.lit("riso").alias("item"),
    )
    return dg.conversation_prompts(prompts).select("seq", "id", "kind", F.md5("text").alias("text_md5"), "est_s")


_POOL = {"nome": ["Ana", "Beto", "Caio"], "lugar": ["o museu", "a feira"]}


@query(
    "dialogue_variants",
    r"""WITH l AS (SELECT conv_id, turn, 'Poxa {nome}, valeu! Tá bom, beleza em {lugar}? Da hora. ' || text AS x FROM conversations), v AS (SELECT *, unnest(range(6)) AS v FROM l),
        a AS (SELECT *, CASE WHEN v % 7 > 0 THEN regexp_replace(x, '(?i)\bbeleza\b', 'tranquilo', 'g') ELSE x END AS x1 FROM v), b AS (SELECT *, CASE WHEN v % 7 > 1 THEN regexp_replace(x1, '(?i)\bda hora\b', 'massa', 'g') ELSE x1 END AS x2 FROM a),
        c AS (SELECT *, CASE WHEN v % 7 > 2 THEN regexp_replace(x2, '(?i)\bvaleu\b', 'obrigado', 'g') ELSE x2 END AS x3 FROM b), d AS (SELECT *, CASE WHEN v % 7 > 3 THEN regexp_replace(x3, '(?i)\btá bom\b', 'tudo certo', 'g') ELSE x3 END AS x4 FROM c),
        e AS (SELECT *, CASE WHEN v % 7 > 4 THEN regexp_replace(x4, '(?i)\bpoxa\b', 'puxa', 'g') ELSE x4 END AS x5 FROM d)
        SELECT conv_id, turn, v AS variant, md5(replace(replace(x5, '{nome}', (['Ana', 'Beto', 'Caio'])[v % 3 + 1]), '{lugar}', (['o museu', 'a feira'])[v % 2 + 1])) AS text_md5 FROM e""",
)
def dialogue_variants(t):
    lines = t.conversations.select("conv_id", "turn", F.concat(F.lit("Poxa {nome}, valeu! Tá bom, beleza em {lugar}? Da hora. "), "text").alias("text"))
    return dg.dialogue_variants(lines, _POOL).select("conv_id", "turn", "variant", F.md5("text").alias("text_md5"))


@query(
    "interrupted_replies",
    using("turns", body=f"""SELECT turn_id, CASE WHEN f >= 0.99::DOUBLE THEN md5(text) ELSE md5(array_to_string(w[1:greatest(1, floor(len(w) * f))::BIGINT], ' ') || ' … [interrompido pelo usuário]') END AS heard_md5
        FROM (SELECT turn_id, text, (conv_id * 7 + turn) % 11 / 10.0::DOUBLE AS f, {s_tokens("text")} AS w FROM turns)"""),
)
def interrupted_replies(t):
    f = (F.col("conv_id") * 7 + F.col("turn")) % 11 / F.lit(10.0)
    return roles.turns(t).select("turn_id", F.md5(tx.heard_part(F.col("text"), f)).alias("heard_md5"))
