"""The driver's tables in the roles of a speech corpus, for Spark and, as CTEs, for SQL.

``documents`` play clips, ``labels`` play the edit log, ``conversations`` play
dialogue turns, ``events`` play frames, ratings and latencies, ``embeddings``
play speaker vectors.  Both forms of a role must say the same thing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vozlake.plans.registry import Tables

LATE = 1_000_000_000_000  # sequence offset of second edits


# ---- SQL fragments -------------------------------------------------------

_WS = r"\s\p{Z}\x1c-\x1f\x85"


def s_strip(x: str) -> str:
    return rf"regexp_replace({x}, '^[{_WS}]+|[{_WS}]+$', '', 'g')"


def s_words(x: str) -> str:
    return rf"regexp_extract_all({x}, '[\p{{L}}\p{{N}}_]+')"


def s_tokens(x: str) -> str:
    return rf"regexp_extract_all({x}, '[^{_WS}]+')"


def s_alnum(x: str) -> str:
    return rf"length(regexp_replace({x}, '[^\p{{L}}\p{{N}}_]', '', 'g'))"


def s_norm(x: str) -> str:
    return s_strip(rf"regexp_replace(regexp_replace(lower({x}), '\p{{P}}', '', 'g'), '[{_WS}]+', ' ', 'g')")


_CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "clips": (
        (),
        """SELECT lpad(doc_id::VARCHAR, 12, '0') AS id, doc_id AS seq, lpad(doc_id::VARCHAR, 12, '0') || '.wav' AS audio,
        source AS speaker, 'ses' || (doc_id % 7)::VARCHAR AS session,
        (['sentenca','emocao','sotaque','monologo','dialogo'])[(doc_id % 5 + 1)::BIGINT] AS kind,
        CASE doc_id % 4 WHEN 0 THEN 'neutro' WHEN 1 THEN 'animado' WHEN 2 THEN 'conversa' END AS style,
        CASE doc_id % 3 WHEN 0 THEN 'carioca-medio' WHEN 1 THEN 'zona-sul' END AS accent,
        round(n_chars / 150.0::DOUBLE, 2) AS dur_s, text, CASE WHEN doc_id % 2 = 0 THEN 'neutro' END AS estilo_nl
        FROM documents""",
    ),
    "edits": (
        (),
        f"""SELECT lpad(doc_id::VARCHAR, 12, '0') AS id, doc_id AS seq, FALSE AS has_text, NULL::VARCHAR AS text,
        quality = 1 AS keep, CASE WHEN toxic = 1 THEN ['corte ruim'] ELSE ([]::VARCHAR[]) END AS flags,
        CASE WHEN doc_id % 3 = 0 THEN 'calmo' ELSE '' END AS estilo_nl FROM labels
        UNION ALL
        SELECT lpad(doc_id::VARCHAR, 12, '0'), doc_id + {LATE}, doc_id % 2 = 0,
        CASE WHEN doc_id % 2 = 0 THEN 'Editado. ' || text END, TRUE, ['ruído'], '' FROM documents WHERE doc_id % 7 = 0""",
    ),
    "resolved": (
        ("clips", "edits"),
        f"""SELECT c.id, c.seq, c.audio, c.speaker, c.session, c.kind, c.style, c.accent, c.dur_s, c.text AS text_orig,
        {s_strip("coalesce(CASE WHEN coalesce(e.has_text, FALSE) THEN e.text ELSE c.text END, '')")} AS text,
        coalesce(e.keep, TRUE) AS keep, coalesce(e.flags, ([]::VARCHAR[])) AS flags, e.seq IS NOT NULL AS edited,
        coalesce(nullif(e.estilo_nl, ''), nullif(c.estilo_nl, '')) AS estilo_nl
        FROM clips c LEFT JOIN (SELECT * FROM edits QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC) = 1) e USING (id)""",
    ),
    "gated": (
        ("clips", "edits", "resolved"),
        f"""SELECT *, CASE
        WHEN NOT keep THEN 'descartado na curadoria (keep=false)'
        WHEN list_has_any(flags, ['2 vozes', 'sobreposição', 'corte ruim'])
          THEN 'flag de descarte: ' || array_to_string(list_sort(list_intersect(flags, ['2 vozes', 'sobreposição', 'corte ruim'])), ', ')
        WHEN len({s_words("text")}) < 2 THEN 'texto <2 palavras: ' || text
        WHEN dur_s IS NULL THEN 'sem duração conhecida'
        WHEN NOT dur_s BETWEEN 1 AND 12 THEN 'duração fora de 1-12s (' || dur_s::VARCHAR || 's)' END AS reason
        FROM resolved""",
    ),
    "manifest": (
        (),
        """SELECT lpad(doc_id::VARCHAR, 12, '0') AS id, source, round(n_chars / 150.0::DOUBLE, 2) AS dur_s, text, lang AS accent,
        (['CC-BY-4.0','CC0','CC-BY-NC-4.0','CC-BY-NC-ND-4.0','Apache-2.0','pago (ELRA)','gravação própria','sem licença','CC-BY-SA-4.0'])
          [(replace(source, 'src', '')::BIGINT % 9 + 1)::BIGINT] AS license,
        (['lido','espontâneo','judicial','conversa'])[(doc_id % 4 + 1)::BIGINT] AS kind,
        CASE WHEN doc_id % 5 < 3 THEN 2.0::DOUBLE + (doc_id % 21) / 10.0::DOUBLE END AS dnsmos, doc_id % 11 = 0 AS consent,
        CASE WHEN doc_id % 3 = 0 THEN TRUE END AS shippable FROM documents""",
    ),
    "turns": (
        (),
        """SELECT conv_id, turn, role, text, conv_id * 4294967296 + turn AS turn_id,
        round(0.5::DOUBLE + length(text) / 60.0::DOUBLE, 3) AS dur_s FROM conversations""",
    ),
    "words": (
        ("turns",),
        f"""SELECT turn_id, conv_id, pos::BIGINT AS pos, word, pos * 0.6::DOUBLE + ((pos * 37) % 10) * 0.03::DOUBLE AS "start",
        pos * 0.6::DOUBLE + ((pos * 37) % 10) * 0.03::DOUBLE + least(0.05::DOUBLE + 0.04::DOUBLE * length(word), 0.6::DOUBLE) AS "end"
        FROM (SELECT turn_id, conv_id, unnest(w) AS word, unnest(range(len(w))) AS pos FROM
        (SELECT turn_id, conv_id, {s_tokens("text")} AS w FROM turns))""",
    ),
    "f0": (
        ("turns",),
        """SELECT turn_id, i, i * 0.05::DOUBLE AS t, CASE WHEN regexp_matches(ch, '[a-z]') THEN 80.0::DOUBLE + 6 * (ascii(ch) - 96) ELSE 0.0::DOUBLE END AS value
        FROM (SELECT turn_id, unnest(string_split(lower(text), '')) AS ch, unnest(range(len(string_split(lower(text), ''))))::BIGINT AS i FROM turns)""",
    ),
    "frames": (
        (),
        """SELECT user_id AS clip_id, (epoch_us(ts) // 3600000000)::BIGINT - 473352 AS i, avg(value) AS level, max(value) AS peak, count(*)::BIGINT AS n
        FROM events GROUP BY 1, 2""",
    ),
    "ratings": (
        (),
        """SELECT 'run' || (user_id % 12)::VARCHAR AS run, 'it' || (event_id % 40)::VARCHAR AS id, epoch_us(ts) // 1000 AS ts, event_id AS seq,
        CASE WHEN event_id % 9 <> 0 THEN (floor(value)::BIGINT % 5 + 1)::INTEGER END AS geral,
        CASE WHEN event_id % 4 <> 0 THEN (floor(value * 3)::BIGINT % 5 + 1)::INTEGER END AS nativo,
        CASE WHEN event_id % 5 <> 0 THEN (floor(value * 7)::BIGINT % 5 + 1)::INTEGER END AS "natural",
        CASE WHEN event_id % 3 = 0 THEN (floor(value * 11)::BIGINT % 5 + 1)::INTEGER END AS voz,
        CASE WHEN event_id % 6 <> 0 THEN value > 40 END AS parou, CASE WHEN event_id % 2 = 0 THEN event_type END AS problema,
        CASE WHEN event_id % 7 = 0 THEN event_type END AS marker_tag FROM events""",
    ),
}


def using(*names: str, body: str) -> str:
    """``WITH`` the named roles (and what they need) in front of ``body``."""
    order: list[str] = []

    def add(name: str) -> None:
        for need in _CTES[name][0]:
            add(need)
        if name not in order:
            order.append(name)

    for n in names:
        add(n)
    head = ",\n".join(f"{n} AS ({_CTES[n][1]})" for n in order)
    body = body.strip()
    recursive = "RECURSIVE " if "WITH RECURSIVE" in body else ""
    if body[:5].upper() == "WITH ":
        return f"WITH {recursive}{head},\n{body[5:].removeprefix('RECURSIVE ')}"
    return f"WITH {head}\n{body}"


# ---- the same roles in Spark ---------------------------------------------


def clip_key() -> Column:
    return F.lpad(F.col("doc_id").cast("string"), 12, "0")


def one_of(values: list[str], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def clips(t: Tables) -> DataFrame:
    d = F.col("doc_id")
    return t.documents.select(
        clip_key().alias("id"),
        d.alias("seq"),
        F.concat(clip_key(), F.lit(".wav")).alias("audio"),
        F.col("source").alias("speaker"),
        F.concat(F.lit("ses"), (d % 7).cast("string")).alias("session"),
        one_of(["sentenca", "emocao", "sotaque", "monologo", "dialogo"], d % 5).alias("kind"),
        F.when(d % 4 == 0, "neutro").when(d % 4 == 1, "animado").when(d % 4 == 2, "conversa").alias("style"),
        F.when(d % 3 == 0, "carioca-medio").when(d % 3 == 1, "zona-sul").alias("accent"),
        F.round(F.col("n_chars") / F.lit(150.0), 2).alias("dur_s"),
        "text",
        F.when(d % 2 == 0, "neutro").alias("estilo_nl"),
    )


def edits(t: Tables) -> DataFrame:
    d = F.col("doc_id")
    none = F.array().cast("array<string>")
    firsts = t.labels.select(
        clip_key().alias("id"),
        d.alias("seq"),
        F.lit(False).alias("has_text"),
        F.lit(None).cast("string").alias("text"),
        (F.col("quality") == 1).alias("keep"),
        F.when(F.col("toxic") == 1, F.array(F.lit("corte ruim"))).otherwise(none).alias("flags"),
        F.when(d % 3 == 0, "calmo").otherwise("").alias("estilo_nl"),
    )
    seconds = t.documents.where(d % 7 == 0).select(
        clip_key().alias("id"),
        (d + LATE).alias("seq"),
        (d % 2 == 0).alias("has_text"),
        F.when(d % 2 == 0, F.concat(F.lit("Editado. "), F.col("text"))).alias("text"),
        F.lit(True).alias("keep"),
        F.array(F.lit("ruído")).alias("flags"),
        F.lit("").alias("estilo_nl"),
    )
    return firsts.unionByName(seconds)


LICENSES = [
    "CC-BY-4.0",
    "CC0",
    "CC-BY-NC-4.0",
    "CC-BY-NC-ND-4.0",
    "Apache-2.0",
    "pago (ELRA)",
    "gravação própria",
    "sem licença",
    "CC-BY-SA-4.0",
]


def manifest(t: Tables) -> DataFrame:
    d = F.col("doc_id")
    return t.documents.select(
        clip_key().alias("id"),
        "source",
        F.round(F.col("n_chars") / F.lit(150.0), 2).alias("dur_s"),
        "text",
        F.col("lang").alias("accent"),
        one_of(LICENSES, F.replace(F.col("source"), F.lit("src"), F.lit("")).cast("long") % 9).alias("license"),
        one_of(["lido", "espontâneo", "judicial", "conversa"], d % 4).alias("kind"),
        F.when(d % 5 < 3, F.lit(2.0) + (d % 21) / F.lit(10.0)).alias("dnsmos"),
        (d % 11 == 0).alias("consent"),
        F.when(d % 3 == 0, F.lit(True)).alias("shippable"),
    )


#: A conversation, turn or piece number takes up to 32 bits, so keys made of two of them can't collide.
TURNS = 1 << 32


def turns(t: Tables) -> DataFrame:
    return t.conversations.select(
        "conv_id",
        "turn",
        "role",
        "text",
        (F.col("conv_id") * TURNS + F.col("turn")).alias("turn_id"),
        F.round(F.lit(0.5) + F.length("text") / F.lit(60.0), 3).alias("dur_s"),
    )


def words(t: Tables) -> DataFrame:
    from vozlake.functions.text import tokens

    pos = F.col("pos")
    start = pos * F.lit(0.6) + ((pos * 37) % 10) * F.lit(0.03)
    rows = turns(t).select("turn_id", "conv_id", F.posexplode(tokens(F.col("text"))).alias("p", "word"))
    rows = rows.withColumn("pos", F.col("p").cast("long"))
    length = F.least(F.lit(0.05) + F.lit(0.04) * F.length("word"), F.lit(0.6))
    return rows.select("turn_id", "conv_id", "pos", "word", start.alias("start"), (start + length).alias("end"))


def f0(t: Tables) -> DataFrame:
    chars = F.split(F.lower(F.col("text")), "")
    rows = turns(t).select("turn_id", F.posexplode(chars).alias("p", "ch"))
    value = F.when(F.col("ch").rlike("[a-z]"), F.lit(80.0) + 6 * (F.ascii("ch") - 96)).otherwise(F.lit(0.0))
    return rows.select("turn_id", F.col("p").cast("long").alias("i"), (F.col("p") * F.lit(0.05)).alias("t"), value.alias("value"))


def epoch_us(ts: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", F.expr("timestamp_ntz'1970-01-01'"), ts)


def frames(t: Tables) -> DataFrame:
    i = F.floor(epoch_us(F.col("ts")) / 3600000000) - 473352
    return t.events.groupBy(F.col("user_id").alias("clip_id"), i.cast("long").alias("i")).agg(
        F.avg("value").alias("level"), F.max("value").alias("peak"), F.count(F.lit(1)).alias("n")
    )


def ratings(t: Tables) -> DataFrame:
    e, v = F.col("event_id"), F.col("value")
    score = lambda x: (F.floor(x).cast("long") % 5 + 1).cast("int")
    return t.events.select(
        F.concat(F.lit("run"), (F.col("user_id") % 12).cast("string")).alias("run"),
        F.concat(F.lit("it"), (e % 40).cast("string")).alias("id"),
        F.floor(epoch_us(F.col("ts")) / 1000).alias("ts"),
        e.alias("seq"),
        F.when(e % 9 != 0, score(v)).alias("geral"),
        F.when(e % 4 != 0, score(v * 3)).alias("nativo"),
        F.when(e % 5 != 0, score(v * 7)).alias("natural"),
        F.when(e % 3 == 0, score(v * 11)).alias("voz"),
        F.when(e % 6 != 0, v > 40).alias("parou"),
        F.when(e % 2 == 0, F.col("event_type")).alias("problema"),
        F.when(e % 7 == 0, F.col("event_type")).alias("marker_tag"),
    )
