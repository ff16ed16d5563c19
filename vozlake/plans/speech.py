"""Queries on words, pitch, boundaries, phones, markers and text front-ends."""

from __future__ import annotations

from pyspark.sql import functions as F

from vozlake.functions import frontend, numbers, phones, tables
from vozlake.functions import text as tx
from vozlake.operators import markers as mk
from vozlake.operators import prosody as pr
from vozlake.operators.ordered import attach, beside, shuffled
from vozlake.plans import roles
from vozlake.plans.registry import query
from vozlake.plans.roles import s_alnum, s_strip, s_tokens, using
from vozlake.session import materialize, where_dealt


def words(t):
    return roles.words(t).withColumnRenamed("turn_id", "clip_id")


def pitch(t):
    return roles.f0(t).withColumnRenamed("turn_id", "clip_id")


def boundaries(t):
    """Marked words; written out, because every reader would otherwise repeat the pitch join."""
    marked = pr.boundaries(words(t), pitch(t))
    with where_dealt(t.spark):
        return materialize(marked, "boundaries")


_ST = "12.0::DOUBLE * log2(greatest({}, 1e-6) / 100.0::DOUBLE)"
_FEATS = f"""v AS (SELECT turn_id, t, value FROM f0 WHERE value > 0),
        w AS (SELECT *, lead("start") OVER (PARTITION BY turn_id ORDER BY pos) AS next_start, lag(word) OVER (PARTITION BY turn_id ORDER BY pos) AS prev_word,
          first_value(word) OVER (PARTITION BY turn_id ORDER BY pos) AS w0, nth_value(word, 2) OVER (PARTITION BY turn_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS w1 FROM words),
        x AS (SELECT turn_id, pos, v.t, value,
          v.t >= greatest(0.0::DOUBLE, w."end" - 0.15::DOUBLE) AND v.t <= w."end" AS bef,
          v.t >= next_start AND v.t <= next_start + 0.15::DOUBLE AS aft, v.t >= w."end" - 0.28::DOUBLE AND v.t <= w."end" AS ris
          FROM w JOIN v USING (turn_id) WHERE v.t >= w."end" - 0.5 AND v.t <= coalesce(next_start, w."end") + 0.5),
        p AS (SELECT turn_id, pos, avg(value) FILTER (bef) AS f0_before, avg(value) FILTER (aft) AS f0_after, coalesce(list(value ORDER BY t) FILTER (ris), ([]::DOUBLE[])) AS pts FROM x GROUP BY 1, 2),
        q AS (SELECT turn_id, pos, f0_before, f0_after, CASE WHEN len(pts) >= 4 THEN {_ST.format("list_sum(pts[-greatest(2, len(pts) // 3):]) / greatest(2, len(pts) // 3)")} - {_ST.format("list_sum(pts[:greatest(2, len(pts) // 3)]) / greatest(2, len(pts) // 3)")} ELSE 0.0::DOUBLE END AS rise_st FROM p),
        feats AS (SELECT w.*, f0_before, f0_after, coalesce(rise_st, 0.0::DOUBLE) AS rise_st FROM w LEFT JOIN q USING (turn_id, pos))"""


@query(
    "pitch_features",
    using("words", "f0", body=f"WITH {_FEATS} SELECT turn_id AS clip_id, pos, round(f0_before, 6) AS f0_before, round(f0_after, 6) AS f0_after, round(rise_st, 6) AS rise_st FROM feats"),
)
def pitch_features(t):
    got = pr.pitch_features(words(t), pitch(t))
    return got.select("clip_id", "pos", *[F.round(c, 6).alias(c) for c in ("f0_before", "f0_after", "rise_st")])


_LEVELS = """lv AS (SELECT turn_id, max(value) FILTER (ix = n // 2) AS f0_median, max(value) FILTER (ix = floor(n * 0.25::DOUBLE)) AS f0_low FROM
        (SELECT turn_id, value, row_number() OVER (PARTITION BY turn_id ORDER BY value) - 1 AS ix, count(*) OVER (PARTITION BY turn_id) AS n FROM f0 WHERE value > 0) GROUP BY 1)"""


@query("pitch_levels", using("f0", body=f"WITH {_LEVELS} SELECT turn_id AS clip_id, f0_median, f0_low FROM lv"))
def pitch_levels(t):
    return pr.pitch_levels(pitch(t))


_EDGE = r"^[\s,.;:!?…]+|[\s,.;:!?…]+$"
_START = "o que|que|quem|qual|quais|quando|onde|aonde|como|por que|pra que|cadê|será|quanto|quanta|quantos|quantas|você|vocês|tu|cê"
_FILL = ", ".join(f"'{f}'" for f in pr.FILLERS)
_BOUND = f"""{_FEATS}, {_LEVELS},
        rm AS (SELECT turn_id, max(r) FILTER (ix = n // 2) AS rate_med FROM (SELECT turn_id, r, row_number() OVER (PARTITION BY turn_id ORDER BY r) - 1 AS ix, count(*) OVER (PARTITION BY turn_id) AS n
          FROM (SELECT turn_id, ("end" - "start") / greatest({s_alnum("word")}, 1) AS r FROM words WHERE "end" > "start")) GROUP BY 1),
        g AS (SELECT f.*, regexp_replace(word, '{_EDGE}', '', 'g') AS core, next_start - "end" AS gap, coalesce(f0_low, 0.0::DOUBLE) AS f0_low, coalesce(rate_med, 0.08::DOUBLE) AS rate_med
          FROM feats f LEFT JOIN lv USING (turn_id) LEFT JOIN rm USING (turn_id)),
        h AS (SELECT *, coalesce({_ST.format("f0_after")} - {_ST.format("f0_before")}, 0.0::DOUBLE) AS reset,
          lower(core) IN ({_FILL}) OR ("end" - "start") / greatest({s_alnum("core")}, 1) > 2.2::DOUBLE * rate_med AS hes,
          regexp_matches({s_strip("concat_ws(' ', w0, w1)")}, '(?i)^\\s*({_START})([^\\p{{L}}\\p{{N}}_]|$)') OR
          regexp_matches(regexp_replace({s_strip("concat_ws(' ', prev_word, word)")}, '[^\\p{{L}}\\p{{N}}_\\s]', '', 'g'), '(?i)(^|[^\\p{{L}}\\p{{N}}_])(né|não é|ou não|certo|tá|entendeu|sacou|beleza)\\s*$') AS asks FROM g),
        i AS (SELECT *, coalesce(gap >= 0.6::DOUBLE OR (gap >= 0.32::DOUBLE AND f0_before <= f0_low) OR (gap >= 0.32::DOUBLE AND reset >= 3), FALSE) AS closes FROM h),
        j AS (SELECT *, CASE WHEN core = '' THEN NULL WHEN gap IS NULL THEN 'terminal' WHEN gap < 0.15::DOUBLE THEN NULL WHEN hes AND NOT closes THEN 'hesitation' WHEN closes THEN 'terminal' ELSE 'nonterminal' END AS kind FROM i),
        b AS (SELECT *, CASE kind WHEN 'terminal' THEN CASE WHEN rise_st < 2.5 THEN '.' WHEN asks THEN '?' ELSE '…' END WHEN 'hesitation' THEN '…' WHEN 'nonterminal' THEN ',' END AS mark FROM j)"""


@query(
    "word_boundaries",
    using("words", "f0", body=f"WITH {_BOUND} SELECT turn_id AS clip_id, pos, kind, mark, round(CASE WHEN kind IS NOT NULL THEN coalesce(gap, 0.0::DOUBLE) END, 6) AS pause, CASE WHEN core <> '' THEN core || coalesce(mark, '') ELSE '' END AS token FROM b"),
)
def word_boundaries(t):
    return boundaries(t).select("clip_id", "pos", "kind", "mark", F.round("pause", 6).alias("pause"), "token")


@query(
    "boundary_statistics",
    using("words", "f0", body=f"WITH {_BOUND} SELECT turn_id AS clip_id, count(*) AS words, count(*) FILTER (kind = 'terminal') AS terminal, count(*) FILTER (kind = 'nonterminal') AS nonterminal, count(*) FILTER (kind = 'hesitation') AS hesitation, count(*) FILTER (mark = '?') AS question FROM b GROUP BY 1"),
)
def boundary_statistics(t):
    n = lambda kind: F.count_if(F.coalesce(F.col("kind") == kind, F.lit(False))).alias(kind)
    return boundaries(t).groupBy("clip_id").agg(
        F.count(F.lit(1)).alias("words"), n("terminal"), n("nonterminal"), n("hesitation"), F.count_if(F.coalesce(F.col("mark") == "?", F.lit(False))).alias("question")
    )


def _capitals(rows: str, key: str, text: str) -> str:
    """CTEs that read a text character by character: ``lifted`` (key, text) has the first letter of each sentence upper-cased."""
    return f"""chars AS (SELECT {key}, unnest(string_split({text}, '')) AS c, unnest(range(len(string_split({text}, '')))) AS k FROM {rows}),
        sorts AS (SELECT *, CASE WHEN regexp_matches(c, '\\p{{L}}') THEN 'letter' WHEN c IN ('.', '?', '!', '…') THEN 'end' END AS sort FROM chars),
        before AS (SELECT *, last_value(sort IGNORE NULLS) OVER (PARTITION BY {key} ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM sorts),
        lifted AS (SELECT {key}, string_agg(CASE WHEN sort = 'letter' AND coalesce(last, 'end') = 'end' THEN CASE WHEN c = 'ß' THEN 'SS' ELSE upper(c) END ELSE c END, '' ORDER BY k) AS text FROM before GROUP BY 1)"""


@query(
    "punctuated_text",
    using("words", "f0", body=f"""WITH {_BOUND}, said AS (SELECT turn_id AS clip_id, string_agg(core || coalesce(mark, ''), ' ' ORDER BY pos) AS said FROM b WHERE core <> '' GROUP BY 1),
        {_capitals("said", "clip_id", "said")} SELECT clip_id, CASE WHEN regexp_matches(text, '[.?!…]$') THEN text ELSE text || '.' END AS text FROM lifted"""),
)
def punctuated_text(t):
    return pr.punctuated_text(boundaries(t))


@query(
    "intonation_units",
    using(
        "words",
        "f0",
        body=f"""WITH RECURSIVE {_BOUND}, s AS (SELECT turn_id, pos, "start", "end", next_start, kind, row_number() OVER (PARTITION BY turn_id ORDER BY pos) AS rn FROM b),
        r AS (SELECT turn_id, rn, "start" AS cs, pos AS cp, kind IS NOT NULL AND ((kind = 'terminal' AND "end" - "start" >= 3) OR "end" - "start" > 12) AS closed, pos, "end", next_start FROM s WHERE rn = 1
        UNION ALL SELECT s.turn_id, s.rn, CASE WHEN r.closed THEN s."start" ELSE r.cs END, CASE WHEN r.closed THEN s.pos ELSE r.cp END,
          s.kind IS NOT NULL AND ((s.kind = 'terminal' AND s."end" - (CASE WHEN r.closed THEN s."start" ELSE r.cs END) >= 3) OR s."end" - (CASE WHEN r.closed THEN s."start" ELSE r.cs END) > 12), s.pos, s."end", s.next_start
          FROM r JOIN s ON s.turn_id = r.turn_id AND s.rn = r.rn + 1)
        SELECT turn_id AS clip_id, round(cs, 6) AS "start", round("end", 6) AS "end", cp AS first, pos AS last FROM r WHERE closed OR next_start IS NULL""",
    ),
)
def intonation_units(t):
    got = pr.intonation_units(boundaries(t))
    return got.select("clip_id", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"), "first", "last")


def segments(t):
    """Recogniser segments played by the events of a user."""
    us = roles.epoch_us(F.col("ts")) - 1704067200000000
    start = us / F.lit(4e9)
    mark = F.when(F.col("event_id") % 3 == 0, ".").otherwise("")
    text = F.when(F.col("event_id") % 10 == 7, "").otherwise(F.concat("event_type", mark))
    return t.events.select(F.col("user_id").alias("track_id"), F.col("event_id").alias("pos"), start.alias("start"), (start + F.col("value") / 20).alias("end"), text.alias("text"))


_SEG = """seg AS (SELECT user_id AS track_id, event_id AS pos, (epoch_us(ts) - 1704067200000000) / 4e9 AS s, (epoch_us(ts) - 1704067200000000) / 4e9 + value / 20 AS e,
        CASE WHEN event_id % 10 = 7 THEN '' ELSE event_type || CASE WHEN event_id % 3 = 0 THEN '.' ELSE '' END END AS t FROM events)"""


@query(
    "phrase_groups",
    f"""WITH RECURSIVE {_SEG}, n AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY pos) AS rn FROM seg),
        r AS (SELECT track_id, rn, s AS cs, e AS ce, t LIKE '%.' AS fin, 1 AS chunk, t, pos FROM n WHERE rn = 1
        UNION ALL SELECT track_id, rn, CASE WHEN nw THEN s ELSE cs END, e, CASE WHEN t <> '' THEN t LIKE '%.' WHEN nw THEN FALSE ELSE fin END, chunk + CASE WHEN nw THEN 1 ELSE 0 END, t, pos
          FROM (SELECT n.track_id, n.rn, n.s, n.e, n.t, n.pos, r.cs, r.fin, r.chunk, (r.ce - r.cs >= 3 AND (r.fin OR n.s - r.ce >= 0.6::DOUBLE)) OR (r.ce - r.cs + (n.e - n.s) > 12) AS nw
          FROM r JOIN n ON n.track_id = r.track_id AND n.rn = r.rn + 1)),
        c AS (SELECT track_id, chunk, min(cs) AS cs, arg_max(ce, rn) AS ce FROM r GROUP BY 1, 2),
        m AS (SELECT track_id, chunk, sum(CASE WHEN ce - cs >= 1.5 OR chunk = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY track_id ORDER BY chunk)::BIGINT AS phrase, cs FROM c)
        SELECT track_id, phrase, round(min(m.cs), 6) AS "start", round(arg_max(ce, rn), 6) AS "end", coalesce(string_agg(t, ' ' ORDER BY rn) FILTER (t <> ''), '') AS text, count(*) AS segments,
        arg_max(ce, rn) - min(m.cs) > 15 AS "long" FROM r JOIN m USING (track_id, chunk) GROUP BY 1, 2""",
)
def phrase_groups(t):
    got = pr.phrases(segments(t))
    return got.select("track_id", "phrase", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"), "text", "segments", "long")


@query(
    "sql_split_segments",
    f"""WITH {_SEG}, c AS (SELECT track_id, s, e, pos, unnest(range(greatest(1, ceil((e - s) / 2.0::DOUBLE)::BIGINT))) AS k FROM seg)
        SELECT track_id AS clip_id, row_number() OVER (PARTITION BY track_id ORDER BY s, pos, k)::INTEGER AS n, round(s + k * 2.0::DOUBLE, 6) AS "start", round(least(s + (k + 1) * 2.0::DOUBLE, e), 6) AS "end" FROM c""",
)
def sql_split_segments(t):
    """Segments cut every two seconds and numbered per clip by the table function, in SQL."""
    tables.register(t.spark)
    rows = segments(t).select(F.col("track_id").alias("clip_id"), "pos", "start", "end")
    got = t.spark.sql("SELECT * FROM split_segments(TABLE(SELECT * FROM {rows}) PARTITION BY clip_id ORDER BY (start, pos), 2.0D)", rows=rows)
    return got.select("clip_id", "n", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"))


def heard_clips(t):
    """Turns with the words a recogniser might have heard: every fifth word is heard as another one."""
    word = F.lower(F.when(F.col("pos") % 5 == 3, F.concat("word", F.lit("x"))).otherwise(F.col("word")))
    one = F.struct("pos", word.alias("word"), "start", "end")
    heard = roles.words(t).groupBy("turn_id").agg(F.sort_array(F.collect_list(one)).alias("h"))
    asr = F.transform("h", lambda x: F.struct(x["word"].alias("word"), x["start"].alias("start"), x["end"].alias("end")))
    return roles.turns(t).join(heard.select("turn_id", asr.alias("heard")), "turn_id")


def _key(x: str) -> str:
    return rf"regexp_replace(strip_accents(lower({x})), '[^\p{{L}}\p{{N}}_]', '', 'g')"


@query(
    "aligned_words",
    using("words", body=f"""WITH RECURSIVE h AS (SELECT turn_id, pos AS j, {_key("CASE WHEN pos % 5 = 3 THEN word || 'x' ELSE word END")} AS key, "start" AS s, "end" AS e FROM words),
        c AS (SELECT turn_id, unnest(w) AS word, unnest(range(len(w))) AS i FROM (SELECT turn_id, list_filter({s_tokens("regexp_replace(text, '[" + chr(34) + "“”]', '', 'g')")}, lambda w: {_key("w")} <> '') AS w FROM turns WHERE turn_id IN (SELECT turn_id FROM h))),
        m AS (SELECT turn_id, i, j - i AS d, i - row_number() OVER (PARTITION BY turn_id, j - i ORDER BY i) AS g FROM (SELECT *, {_key("word")} AS key FROM c) JOIN h USING (turn_id, key)),
        run AS (SELECT turn_id, d, min(i) AS i0, max(i) AS i1 FROM m GROUP BY turn_id, d, g),
        size AS (SELECT * FROM (SELECT turn_id, count(*) AS na FROM c GROUP BY 1) JOIN (SELECT turn_id, count(*) AS nb, min(s) AS first, arg_max(e, j) AS last FROM h GROUP BY 1) USING (turn_id)),
        part AS (SELECT turn_id, 0::BIGINT AS alo, na AS ahi, 0::BIGINT AS blo, nb AS bhi FROM size
          UNION ALL SELECT turn_id, CASE WHEN side = 0 THEN alo ELSE b.i - b.n END, CASE WHEN side = 0 THEN b.i ELSE ahi END, CASE WHEN side = 0 THEN blo ELSE b.i + b.d - b.n END, CASE WHEN side = 0 THEN b.i + b.d ELSE bhi END
          FROM (SELECT p.turn_id, alo, ahi, blo, bhi, min({{'n': greatest(i0, alo, blo - d) - least(i1 + 1, ahi, bhi - d), 'i': greatest(i0, alo, blo - d), 'd': d}}) AS b FROM part p JOIN run r ON r.turn_id = p.turn_id AND greatest(i0, alo, blo - d) < least(i1 + 1, ahi, bhi - d) GROUP BY ALL), (VALUES (0), (1)) v(side)),
        block AS (SELECT p.turn_id, alo, ahi, blo, bhi, min({{'n': greatest(i0, alo, blo - d) - least(i1 + 1, ahi, bhi - d), 'i': greatest(i0, alo, blo - d), 'd': d}}) AS b FROM part p JOIN run r ON r.turn_id = p.turn_id AND greatest(i0, alo, blo - d) < least(i1 + 1, ahi, bhi - d) GROUP BY ALL),
        hit AS (SELECT turn_id, unnest(range(b.i, b.i - b.n)) AS i, b.d AS d FROM block),
        t AS (SELECT c.turn_id, c.i, c.word, h.s, h.e FROM c LEFT JOIN hit USING (turn_id, i) LEFT JOIN h ON h.turn_id = c.turn_id AND h.j = c.i + hit.d),
        w AS (SELECT t.*, na, first, last, count(s) OVER (PARTITION BY turn_id) AS hits, last_value(e IGNORE NULLS) OVER up AS pe, last_value(CASE WHEN s IS NOT NULL THEN i END IGNORE NULLS) OVER up AS pi,
              first_value(s IGNORE NULLS) OVER down AS ns, first_value(CASE WHEN s IS NOT NULL THEN i END IGNORE NULLS) OVER down AS ni FROM t JOIN size USING (turn_id)
              WINDOW up AS (PARTITION BY turn_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), down AS (PARTITION BY turn_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
        x AS (SELECT *, coalesce(pe, first) AS l, greatest(coalesce(pe, first), coalesce(ns, last)) AS top, i - coalesce(pi, -1) AS nth, greatest(0.12::DOUBLE, (greatest(coalesce(pe, first), coalesce(ns, last)) - coalesce(pe, first)) / greatest(1, coalesce(ni, na) - coalesce(pi, -1) - 1)) AS share FROM w)
        SELECT turn_id, i::INTEGER AS pos, round(hits / na::DOUBLE, 6) AS coverage, word, round(CASE WHEN s IS NOT NULL THEN s ELSE least(top, l + (nth - 1) * share) END, 6) AS "start", round(CASE WHEN s IS NOT NULL THEN e ELSE least(top, l + nth * share) END, 6) AS "end" FROM x"""),
)
def aligned_words(t):
    got = pr.align_words(heard_clips(t)).select("turn_id", "coverage", F.posexplode("aligned").alias("pos", "w"))
    return got.select("turn_id", "pos", F.round("coverage", 6).alias("coverage"), "w.word", F.round("w.start", 6).alias("start"), F.round("w.end", 6).alias("end"))


def pairs(t):
    """Clips before and after punctuation, played by documents with replaced marks."""
    d = F.col("doc_id")
    after = F.regexp_replace(F.regexp_replace("text", r"\. ", "… "), ", ", F.when(d % 3 == 0, " ").otherwise(", "))
    after = F.when(d % 4 == 0, F.col("text")).otherwise(after)
    return t.documents.select(
        roles.clip_key().alias("id"), F.concat(roles.clip_key(), F.lit(".wav")).alias("audio"), F.col("text").alias("text_orig"), after.alias("text_pros"), ((d * 37 % 101) / F.lit(100.0)).alias("align_cov")
    )


_PP = r"""pp AS (SELECT lpad(doc_id::VARCHAR, 12, '0') AS id, text AS text_orig, (doc_id * 37 % 101) / 100.0::DOUBLE AS align_cov,
        CASE WHEN doc_id % 4 = 0 THEN text ELSE regexp_replace(regexp_replace(text, '\. ', '… ', 'g'), ', ', CASE WHEN doc_id % 3 = 0 THEN ' ' ELSE ', ' END, 'g') END AS text_pros FROM documents)"""


def _n(x: str, marks: str) -> str:
    return f"len(regexp_extract_all({x}, '[{marks}]'))"


@query(
    "punctuation_report",
    f"""WITH {_PP}, w AS (SELECT sum(len({s_tokens("text_orig")})) AS w FROM pp)
        SELECT count(*) AS clips, round(100.0::DOUBLE * sum({_n("text_orig", ",")}) / any_value(w), 6) AS commas_before, round(100.0::DOUBLE * sum({_n("text_pros", ",")}) / any_value(w), 6) AS commas_after,
        round(100.0::DOUBLE * sum({_n("text_orig", ".!")}) / any_value(w), 6) AS terminals_before, round(100.0::DOUBLE * sum({_n("text_pros", ".!")}) / any_value(w), 6) AS terminals_after,
        sum({_n("text_orig", "?")})::BIGINT AS questions_before, sum({_n("text_pros", "?")})::BIGINT AS questions_after, sum({_n("text_pros", "…")})::BIGINT AS hesitations_after,
        count(*) FILTER (regexp_replace(text_orig, '\\s', '', 'g') <> regexp_replace(text_pros, '\\s', '', 'g')) AS changed, count(*) FILTER (align_cov < 0.7::DOUBLE) AS low_coverage,
        list_sort(list(align_cov))[count(*) // 2 + 1] AS coverage FROM pp, w""",
)
def punctuation_report(t):
    got = pr.punctuation_report(pairs(t))
    rates = [F.round(c, 6).alias(c) for c in ("commas_before", "commas_after", "terminals_before", "terminals_after")]
    return got.select("clips", *rates, "questions_before", "questions_after", "hesitations_after", "changed", "low_coverage", "coverage")


@query(
    "most_changed_clips",
    f"""WITH {_PP} SELECT id, abs({_n("text_orig", ",")} - {_n("text_pros", ",")}) + 2 * {_n("text_pros", "…")} AS score FROM pp ORDER BY score DESC, id LIMIT 12""",
)
def most_changed_clips(t):
    return pr.most_changed(pairs(t)).select("id", "score")


@query("covered_clips", f"WITH {_PP} SELECT id, md5(text_pros) AS text_md5 FROM pp WHERE align_cov >= 0.7::DOUBLE")
def covered_clips(t):
    clips = roles.clips(t).withColumn("audio", F.concat(F.lit("segments/"), "audio"))
    return pr.emit_covered(clips, pairs(t)).select("id", F.md5("text").alias("text_md5"))


@query(
    "sentences",
    using("turns", body=rf"""SELECT turn_id, md5(s) AS sentence_md5, count(*) AS n FROM (SELECT turn_id, {s_strip(r"unnest(string_split(regexp_replace(text, '([.!?…])\s', '\1' || chr(1), 'g'), chr(1)))")} AS s FROM turns) WHERE s <> '' GROUP BY 1, 2"""),
)
def sentences(t):
    got = roles.turns(t).select("turn_id", F.explode(tx.sentences(F.col("text"))).alias("s"))
    return got.groupBy("turn_id", F.md5("s").alias("sentence_md5")).agg(F.count(F.lit(1)).alias("n"))


@query("capitalized_turns", using("turns", body=f"WITH {_capitals('turns', 'turn_id', 'lower(text)')} SELECT turn_id, text FROM lifted"))
def capitalized_turns(t):
    return roles.turns(t).select("turn_id", tx.capitalize_sentences(F.lower("text")).alias("text"))


@query(
    "punctuation_density",
    f"""SELECT doc_id, {_n("text", ",")} AS commas, {_n("text", ".!")} AS terminals, {_n("text", "?")} AS questions, {_n("text", "…")} AS dots FROM documents""",
)
def punctuation_density(t):
    c = lambda marks, name: tx.mark_count(F.col("text"), marks).alias(name)
    return t.documents.select("doc_id", c(",", "commas"), c(".!", "terminals"), c("?", "questions"), c("…", "dots"))


@query(
    "control_tags",
    using(
        "clips",
        body=r"""SELECT id, CASE WHEN s IS NULL AND a IS NULL THEN '' ELSE '<' || concat_ws('|', s, a) || '> ' END AS prefix, md5(regexp_replace(regexp_replace('<x> ' || text, '<[^>]*>\s*', '', 'g'), '^\s+|\s+$', '', 'g')) AS bare_md5
        FROM (SELECT id, text, CASE WHEN style NOT IN ('neutro', 'conversa') THEN style END AS s, CASE WHEN accent <> 'carioca-medio' THEN accent END AS a FROM clips)""",
    ),
)
def control_tags(t):
    return roles.clips(t).select("id", tx.style_prefix(F.col("style"), F.col("accent")).alias("prefix"), F.md5(tx.strip_tags(F.concat(F.lit("<x> "), "text"))).alias("bare_md5"))


@query(
    "segment_ids",
    r"""SELECT doc_id, sid, regexp_replace(sid, '[-_]seg\d+$', '') AS session_id FROM (SELECT doc_id, regexp_replace(regexp_replace(lower(source || '-Reunião ' || lang), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') || '-seg' || lpad(doc_id::VARCHAR, greatest(3, length(doc_id::VARCHAR))::INTEGER, '0') AS sid FROM documents)""",
)
def segment_ids(t):
    sid = tx.segment_id(F.col("source"), F.concat(F.lit("Reunião "), "lang"), F.col("doc_id"))
    return t.documents.select("doc_id", sid.alias("sid")).withColumn("session_id", tx.session_of_segment(F.col("sid")))


# ---- phones and markers ---------------------------------------------------


def _one_of(x: str, letters) -> str:
    return f"{x} IN ({', '.join(repr(c) for c in letters)})"


def _mapped(x: str, table: dict[str, str]) -> str:
    return f"CASE {x} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + " END"


def _phones_sql() -> str:
    """CTEs that read the distinct words of ``documents`` letter by letter: spoken (word, n, phones)."""
    vowel = lambda x: _one_of(x, phones.VOWELS)
    soft = lambda x, of: f"({x} = '' OR {_one_of(x, phones.SOFTENING[of])})"
    family = lambda table: "CASE " + " ".join(f"WHEN {_one_of('c', f)} THEN '{v}'" for f, v in table.items()) + " END"
    cell = lambda sound, used: f"{{'p': {sound}, 'u': {used}}}"
    cases = [
        (f"{vowel('c')} AND a IN ('m', 'n') AND NOT {vowel('b')}", f"coalesce(CASE WHEN a = 'm' AND b = '' THEN {family(phones.FINAL_NASAL)} END, {family(phones.NASAL)})", 2),
        (f"{vowel('c')} AND a = ''", family(phones.NASAL), 1),
        (_one_of("c || a", phones.NASAL_GLIDES), _mapped("c || a", phones.NASAL_GLIDES), 2),
        (f"{_one_of('c', phones.BEFORE_GLIDE)} AND {_one_of('a', phones.GLIDES)}", f"{_mapped('c', phones.BEFORE_GLIDE)} || {_mapped('a', phones.GLIDES)}", 2),
        (vowel("c"), _mapped("c", phones.VOWELS), 1),
        (_one_of("c || a", phones.PAIRS), _mapped("c || a", phones.PAIRS), 2),
        (f"c || a IN ('sc', 'sç', 'xc') AND {soft('b', 'sc')}", "'s'", 2),
        (f"c || a = 'gu' AND {soft('b', 'gu')}", "'g'", 2),
        ("c || a = 'qu'", f"CASE WHEN {soft('b', 'qu')} THEN 'k' ELSE 'k w' END", 2),
        ("c = 'c'", f"CASE WHEN {soft('a', 'c')} THEN 's' ELSE 'k' END", 1),
        ("c = 'g'", f"CASE WHEN {soft('a', 'g')} THEN 'ʒ' ELSE 'g' END", 1),
        ("c IN ('t', 'd') AND (a IN ('i', 'í', '') OR (a = 'e' AND b = ''))", _mapped("c", phones.PALATAL), 1),
        (f"c = 's' AND (o = '' OR {vowel('o')}) AND (a = '' OR {vowel('a')})", "'z'", 1),
        ("c = 's'", f"CASE WHEN a <> '' AND {_one_of('a', phones.VOICED)} THEN 'ʒ' WHEN {vowel('a')} THEN 's' ELSE 'ʃ' END", 1),
        ("c = 'x'", f"CASE WHEN i = 2 AND o = 'e' AND (a = '' OR {vowel('a')}) THEN 'z' ELSE 'ʃ' END", 1),
        ("c = 'z'", "CASE WHEN a = '' THEN 'ʃ' ELSE 'z' END", 1),
        ("c = 'r'", f"CASE WHEN i > 1 AND {vowel('a')} THEN 'ɾ' ELSE 'χ' END", 1),
        ("c = 'l'", f"CASE WHEN {vowel('a')} THEN 'l' ELSE 'w' END", 1),
    ]
    choice = "CASE " + " ".join(f"WHEN {when} THEN {cell(sound, used)}" for when, sound, used in cases) + f" ELSE {cell(f'coalesce({_mapped("c", phones.PLAIN)}, {chr(39) * 2})', 1)} END"
    return f"""dw AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(regexp_replace(replace(lower(text), '-', ' '), '[^\\p{{L}}\\p{{N}}_ ]', ' ', 'g'), '\\s+'), lambda w: w <> '')) AS word FROM documents),
        cw AS (SELECT word, count(*) AS n FROM dw GROUP BY 1),
        st AS (SELECT word, 1::BIGINT AS i, '' AS said FROM cw
          UNION ALL SELECT word, i + r.u, said || ' ' || r.p FROM (SELECT word, i, said, {choice} AS r FROM (SELECT word, i, said, word[i] AS c, word[i + 1] AS a, word[i + 2] AS b, CASE WHEN i > 1 THEN word[i - 1] ELSE '' END AS o FROM st WHERE i <= length(word)))),
        spoken AS (SELECT word, n, list_filter(string_split(said, ' '), lambda p: p <> '') AS phones FROM st JOIN cw USING (word) WHERE i > length(word))"""


_INVENTORY = "inv AS (SELECT unnest([" + ", ".join(f"'{p}'" for p in phones.INVENTORY) + f"]) AS phone, unnest(range({len(phones.INVENTORY)})) AS bit)"


@query(
    "phone_coverage",
    f"""WITH RECURSIVE {_phones_sql()}, {_INVENTORY}, l AS (SELECT phone, sum(n)::BIGINT AS n FROM (SELECT unnest(phones) AS phone, n FROM spoken) GROUP BY 1)
        SELECT coalesce(l.phone, inv.phone) AS phone, coalesce(n, 0) AS n, CASE WHEN inv.phone IS NULL THEN 'outside' WHEN coalesce(n, 0) = 0 THEN 'missing' WHEN n < 5 THEN 'rare' ELSE 'covered' END AS status FROM l FULL JOIN inv USING (phone)""",
)
def phone_coverage(t):
    return mk.phone_coverage(phones.word_table(t.documents), phones.INVENTORY)


@query(
    "letter_coverage",
    """WITH l AS (SELECT ch AS phone, count(*) AS n FROM (SELECT unnest(string_split(lower(text), '')) AS ch FROM documents) WHERE regexp_matches(ch, '[a-zé]') GROUP BY 1),
        i AS (SELECT unnest(string_split('abcdefghijklmnopqrstuvwxyzç', '')) AS phone)
        SELECT coalesce(l.phone, i.phone) AS phone, coalesce(n, 0) AS n, CASE WHEN i.phone IS NULL THEN 'outside' WHEN coalesce(n, 0) = 0 THEN 'missing' WHEN n < 200 THEN 'rare' ELSE 'covered' END AS status FROM l FULL JOIN i USING (phone)""",
)
def letter_coverage(t):
    letters = F.regexp_extract_all(F.lower("text"), F.lit("([a-zé])"), F.lit(1))
    rows = t.documents.select(letters.alias("phones"), F.lit(1).alias("n"))
    return mk.phone_coverage(rows, list("abcdefghijklmnopqrstuvwxyzç"), 200)


@query("word_phones", f"WITH RECURSIVE {_phones_sql()} SELECT word, n, array_to_string(phones, ' ') AS phones FROM spoken")
def word_phones(t):
    return phones.word_table(t.documents).select("word", "n", F.array_join("phones", " ").alias("phones"))


@query(
    "greedy_phone_coverage",
    f"""WITH RECURSIVE {_phones_sql()}, {_INVENTORY}, wm AS (SELECT word, bit_or(1::BIGINT << bit::INT) AS mask FROM (SELECT word, unnest(phones) AS phone FROM spoken) JOIN inv USING (phone) GROUP BY 1),
        dm AS (SELECT documents.doc_id, coalesce(bit_or(mask), 0) AS mask FROM documents LEFT JOIN (SELECT DISTINCT * FROM dw) d USING (doc_id) LEFT JOIN wm USING (word) GROUP BY 1),
        sets AS (SELECT mask, min(doc_id) AS first FROM dm GROUP BY 1),
        picked AS (SELECT 0::BIGINT AS seen, 0 AS step, NULL::BIGINT AS first, 0::BIGINT AS gain
          UNION ALL SELECT seen | b.mask, step + 1, -b.neg, b.gain FROM (SELECT seen, step, max({{'gain': bit_count(mask & ~seen)::BIGINT, 'neg': -sets.first, 'mask': mask}}) AS b FROM picked, sets GROUP BY 1, 2) WHERE b.gain > 0)
        SELECT doc_id, step, gain::INTEGER AS gain, CASE WHEN step IS NULL THEN md5('7|' || doc_id) END AS order_key FROM dm LEFT JOIN (SELECT step, first AS doc_id, gain FROM picked WHERE step > 0) USING (doc_id)""",
)
def greedy_phone_coverage(t):
    rows = phones.text_phones(t.documents.select("doc_id", "text"), "text")
    return mk.greedy_coverage(rows, phones.INVENTORY, "doc_id", "doc_id").select("doc_id", "step", "gain", "order_key")


def timeline(t):
    letters = F.filter(F.split(F.lower("text"), ""), lambda c: c.rlike("[a-z]"))
    return mk.uniform_timeline(roles.turns(t).withColumnRenamed("turn_id", "clip_id"), letters)


def timed_markers(t):
    """Every event is a marker on a turn: users speak in conversations in turn, events lie on their turns in turn."""
    held = roles.turns(t).groupBy("conv_id").agg(F.min("turn").alias("__first"), F.max("turn").alias("__last"))
    every = beside(t.events, held.agg((F.max("conv_id") + 1).alias("__convs"))).withColumn("conv_id", F.col("user_id") % F.col("__convs"))
    turn_id = F.col("conv_id") * roles.TURNS + F.col("__first") + F.col("event_id") % (F.col("__last") - F.col("__first") + 1)
    sev = F.when(F.col("event_id") % 6 == 0, "grave").otherwise((F.col("event_id") % 9).cast("string"))
    start = F.col("value") % F.lit(7.0)
    return attach(every, held, ["conv_id"]).select(
        turn_id.alias("clip_id"), F.col("event_id").alias("marker"), start.alias("t_start"), (start + 0.35).alias("t_end"), F.col("event_type").alias("tag"), sev.alias("sev"), F.lit("").alias("note")
    )


_TL = """tl AS (SELECT turn_id, k, ch, n, dur_s, k * (dur_s / n) AS s, (k + 1) * (dur_s / n) AS e FROM
        (SELECT turn_id, dur_s, len(l) AS n, unnest(l) AS ch, unnest(range(len(l))) AS k FROM (SELECT turn_id, dur_s, regexp_extract_all(lower(text), '[a-z]') AS l FROM turns))),
        held AS (SELECT conv_id, min(turn) AS f, max(turn) AS l FROM turns GROUP BY 1),
        mkr AS (SELECT conv_id * 4294967296 + f + event_id % (l - f + 1) AS turn_id, event_id AS marker, value % 7.0::DOUBLE AS t0, value % 7.0::DOUBLE + 0.35::DOUBLE AS t1
                FROM (SELECT *, user_id % (SELECT max(conv_id) + 1 FROM turns) AS conv_id FROM events) LEFT JOIN held USING (conv_id)),
        ov AS (SELECT marker, ch, k, s, least(e, t1) - greatest(s, t0) AS o FROM mkr JOIN tl USING (turn_id) WHERE s < t1 AND e > t0)"""


@query("phone_timeline", using("turns", body=f"WITH {_TL} SELECT turn_id AS clip_id, k AS pos, ch AS phone, s AS \"start\", e AS \"end\" FROM tl"))
def phone_timeline(t):
    return timeline(t).select("clip_id", "pos", "phone", "start", "end")


@query("marker_overlaps", using("turns", body=f"WITH {_TL} SELECT marker, count(*) AS phones, round(sum(o), 6) AS seconds FROM ov GROUP BY 1"))
def marker_overlaps(t):
    return mk.overlapping(timed_markers(t), timeline(t)).groupBy("marker").agg(F.count(F.lit(1)).alias("phones"), F.round(F.sum("overlap"), 6).alias("seconds"))


@query(
    "marker_phones",
    using("turns", body=f"WITH {_TL}, bst AS (SELECT marker, ch FROM ov QUALIFY row_number() OVER (PARTITION BY marker ORDER BY o DESC, s) = 1) SELECT marker, turn_id AS clip_id, ch AS expected_phoneme FROM mkr LEFT JOIN bst USING (marker)"),
)
def marker_phones(t):
    return mk.expected_phone(timed_markers(t), timeline(t)).select("marker", "clip_id", "expected_phoneme")


@query(
    "enriched_records",
    using(
        "turns",
        body=f"""WITH {_TL}, lst AS (SELECT turn_id, marker, row_number() OVER (PARTITION BY turn_id ORDER BY t0, marker) AS rn FROM mkr),
        hit AS (SELECT DISTINCT marker FROM ov) SELECT t.turn_id AS clip_id, count(lst.marker) AS markers, count(hit.marker) AS enriched FROM turns t LEFT JOIN lst USING (turn_id) LEFT JOIN hit USING (marker) GROUP BY 1""",
    ),
)
def enriched_records(t):
    kind = "array<struct<t_start:double,t_end:double,tag:string,sev:string,note:string>>"
    one = F.struct("t_start", "t_end", "tag", "sev", "note")
    lists = timed_markers(t).groupBy("clip_id").agg(F.sort_array(F.collect_list(one)).alias("markers"))
    records = roles.turns(t).select(F.col("turn_id").alias("clip_id")).join(shuffled(lists), "clip_id", "left").withColumn("markers", F.coalesce("markers", F.array().cast(kind)))
    got = mk.enrich(records, timeline(t))
    return got.select("clip_id", F.size("markers").alias("markers"), F.size(F.filter(F.coalesce("enriched", F.array().cast(dict(got.dtypes)["enriched"])), lambda m: m["expected_phoneme"].isNotNull())).alias("enriched"))


# ---- corpus text jobs -----------------------------------------------------


@query("spoken_numbers")
def spoken_numbers(t):
    return numbers.verbalized(t.documents.select("doc_id", "text")).select("doc_id", "spoken")


@query("number_rule_counts")
def number_rule_counts(t):
    return numbers.rule_counts(numbers.counted(t.documents.select("text")))


_LEX = {"the": "ðə", "and": "ænd", "of": "ʌv", "le": "lə", "und": "ʊnt"}


@query(
    "lexicon_text",
    "SELECT doc_id, md5(array_to_string(list_transform(regexp_extract_all(text, '[\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_]+'), lambda p: CASE lower(p) "
    + " ".join(
        f"WHEN '{w}' THEN CASE WHEN p[1] = upper(p[1]) AND p[1] <> lower(p[1]) THEN '{ph[0].upper() + ph[1:]}' ELSE '{ph}' END" for w, ph in {**frontend.DEFAULT_LEXICON, **_LEX}.items()
    )
    + " ELSE p END), '')) AS text_md5 FROM documents",
)
def lexicon_text(t):
    got = frontend.apply_lexicon(t.documents.select("doc_id", "text"), frontend.lexicon(t.spark, _LEX))
    return got.select("doc_id", F.md5("text").alias("text_md5"))


def phrase_lexicon(t):
    """Every two and three words in a row of the benchmark as an entry; its phones are played by a digest."""
    cut = t.benchmark.select(frontend.pieces_of(F.col("text")).alias("p"))
    runs = cut.select("p", F.posexplode("p").alias("k", "piece"), F.lit([3, 5]).alias("sizes")).where(F.col("piece").rlike(r"[\p{L}\p{N}_]"))
    words = runs.select("p", "k", F.explode("sizes").alias("n")).where("k + n <= size(p)").select(F.lower(F.array_join(F.slice("p", F.col("k") + 1, F.col("n")), "")).alias("word"))
    return words.distinct().select("word", F.substring(F.md5("word"), 1, 6).alias("phones"), F.lit(0).cast("long").alias("seq"))


@query(
    "lexicon_phrases",
    r"""WITH RECURSIVE b AS (SELECT regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_]+') AS p FROM benchmark),
        e AS (SELECT DISTINCT lower(array_to_string(p[k:k + n - 1], '')) AS word, n FROM (SELECT p, unnest(range(1, len(p) + 1)) AS k FROM b), (VALUES (3), (5)) v(n) WHERE k + n - 1 <= len(p) AND regexp_matches(p[k], '[\p{L}\p{N}_]')),
        d AS (SELECT doc_id, regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_]+') AS p FROM documents),
        pl AS (SELECT doc_id, k, t FROM (SELECT doc_id, unnest(p) AS t, unnest(range(1, len(p) + 1)) AS k FROM d)),
        nx AS (SELECT *, t || lead(t) OVER o || lead(t, 2) OVER o AS w3, lead(t, 3) OVER o || lead(t, 4) OVER o AS w2 FROM pl WINDOW o AS (PARTITION BY doc_id ORDER BY k)),
        w AS (SELECT doc_id, k, 3 AS n, lower(w3) AS word FROM nx UNION ALL SELECT doc_id, k, 5, lower(w3 || w2) FROM nx),
        c AS (SELECT doc_id, k, max(w.n) AS n, arg_max(word, w.n) AS word FROM w JOIN e USING (word) GROUP BY 1, 2),
        s AS (SELECT c.*, c2.k AS following FROM c ASOF LEFT JOIN (SELECT doc_id, k FROM c) c2 ON c.doc_id = c2.doc_id AND c.k + c.n <= c2.k),
        taken AS (SELECT s.* FROM s JOIN (SELECT doc_id, min(k) AS k FROM c GROUP BY 1) USING (doc_id, k) UNION ALL SELECT s.* FROM taken t JOIN s ON s.doc_id = t.doc_id AND s.k = t.following),
        shown AS (SELECT pl.doc_id, string_agg(CASE WHEN t.k IS NULL THEN pl.t WHEN t.k < pl.k THEN '' WHEN pl.t[1] = upper(pl.t[1]) AND pl.t[1] <> lower(pl.t[1]) THEN upper(md5(t.word)[1]) || md5(t.word)[2:6] ELSE md5(t.word)[1:6] END, '' ORDER BY pl.k) AS text
                  FROM pl LEFT JOIN (SELECT doc_id, k, word, unnest(range(k, k + n)) AS place FROM taken) t ON t.doc_id = pl.doc_id AND t.place = pl.k GROUP BY 1),
        n AS (SELECT doc_id, count(*) AS phrases, sum(n) AS pieces FROM taken GROUP BY 1)
        SELECT doc_id, coalesce(phrases, 0) AS phrases, coalesce(pieces, 0)::BIGINT AS taken, md5(coalesce(shown.text, documents.text)) AS text_md5 FROM documents LEFT JOIN shown USING (doc_id) LEFT JOIN n USING (doc_id)""",
)
def lexicon_phrases(t):
    found = frontend.found_entries(t.documents.select("doc_id", "text"), phrase_lexicon(t))
    taken = F.aggregate("chosen", F.lit(0).cast("long"), lambda n, c: n + c["size"])
    return found.select("doc_id", F.size("chosen").cast("long").alias("phrases"), taken.alias("taken"), F.md5(frontend.replaced_text(F.col("text"))).alias("text_md5"))


@query("front_end_text")
def front_end_text(t):
    d = t.documents.select("doc_id", "text")
    one = lambda mode: frontend.front_end(d, mode).select("doc_id", F.lit(mode).alias("mode"), "text")
    return one("raw").unionByName(one("normalize")).unionByName(one("lexicon"))
