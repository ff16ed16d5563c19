"""Queries that run a stream over the given tables to its end and read the result."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from vozlake.functions import text as tx
from vozlake.operators import turns as tn
from vozlake.plans import roles
from vozlake.plans.evaluation import _RATED
from vozlake.plans.registry import query
from vozlake.plans.roles import using
from vozlake.session import scratch_path
from vozlake.streaming import jobs


def table_stream(t, name: str, files: int | None = None):
    """A table as a stream, be it one file or a folder of files: a pattern may stand for either, a plain path for a folder alone."""
    path = t.path(name)
    return jobs.file_stream(t.spark, f"{path[:-1]}[{path[-1]}]", t.read(name).schema, files=files)


def event_stream(t, files: int | None = None):
    return table_stream(t, "events", files)


def clocked(df):
    """Event time as a timestamp, which watermarks need."""
    return df.withColumn("ts", F.col("ts").cast("timestamp"))


def frames_of(df):
    """Hour slots of a user as frames; the value of the event decides probability and playback."""
    i = F.floor(roles.epoch_us(F.col("ts")) / 60000000) - 28401120
    v = F.col("value")
    return df.select(
        F.col("user_id").alias("session"), i.alias("i"), F.least(v / 50, F.lit(1.0)).alias("prob"), (F.col("event_type") == "error").alias("playing"),
        F.when(F.col("event_id") % 3 != 0, (F.col("event_id") % 10) / F.lit(10.0)).alias("complete"), "event_id",
    )


# Frames of the events table lie minutes apart, so the limits count events of a user.
RULES = tn.TurnRules(endpoint_ms=96, short_ms=64, min_turn_ms=64, cooldown_s=0.064, barge_in=True, barge_frames=2, barge_prob=0.8)


@query("recorded_turns")
def recorded_turns(t):
    return tn.turns(frames_of(t.events), RULES, ties=["event_id"])


@query("streamed_turns")
def streamed_turns(t):
    out = scratch_path(t.spark, "turns")
    stream = jobs.turn_stream(frames_of(event_stream(t)), RULES, ["event_id"])
    jobs.drain_to_files(stream, scratch_path(t.spark, "checkpoint"), out)
    return t.spark.read.schema(stream.schema).parquet(out)


@query(
    "barge_ins",
    """WITH f AS (SELECT user_id AS session, (epoch_us(ts) // 60000000)::BIGINT - 28401120 AS i, event_id, event_type = 'error' AND least(value / 50, 1) >= 0.2::DOUBLE AS s FROM events),
        g AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY i, event_id) - row_number() OVER (PARTITION BY session, s ORDER BY i, event_id) AS g FROM f),
        k AS (SELECT session, g, i, row_number() OVER (PARTITION BY session, g ORDER BY i, event_id) AS k, count(*) OVER (PARTITION BY session, g) AS frames FROM g WHERE s)
        SELECT session, i AS at, frames FROM k WHERE k = 2""",
)
def barge_ins(t):
    return tn.barge_ins(frames_of(t.events), tn.TurnRules(barge_prob=0.2, barge_frames=2), ties=["event_id"])


@query(
    "frames_outside_echo",
    """WITH f AS (SELECT event_id, user_id AS session, epoch_us(ts) / 3.6e9 AS t FROM events), p AS (SELECT user_id AS session, epoch_us(ts) / 3.6e9 AS s, epoch_us(ts) / 3.6e9 + value / 50 AS e FROM events WHERE event_type = 'view')
        SELECT event_id FROM f WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.session = f.session AND f.t >= p.s AND f.t < p.e + 0.35::DOUBLE)""",
)
def frames_outside_echo(t):
    hours = roles.epoch_us(F.col("ts")) / F.lit(3.6e9)
    f = t.events.select("event_id", F.col("user_id").alias("session"), hours.alias("t"))
    p = t.events.where("event_type = 'view'").select(F.col("user_id").alias("session"), hours.alias("start"), (hours + F.col("value") / 50).alias("end"))
    return tn.outside_echo(f, p).select("event_id")


@query("heard_fractions", "SELECT event_id, CASE WHEN k > 0 THEN least(1.0::DOUBLE, value / k) ELSE 1.0::DOUBLE END AS fraction FROM (SELECT event_id, value, event_id % 100 AS k FROM events)")
def heard_fractions(t):
    return t.events.select("event_id", tn.heard_fraction(F.col("value"), F.col("event_id") % 100).alias("fraction"))


@query(
    "streamed_stage_latency",
    """SELECT epoch_us(date_trunc('hour', ts)) // 1000000 AS start, event_type AS stage, count(*) AS n, round(avg(value), 6) AS mean_s, quantile_disc(value, 0.5) AS p50_s, quantile_disc(value, 0.95) AS p95_s FROM events GROUP BY 1, 2""",
)
def streamed_stage_latency(t):
    stream = clocked(event_stream(t)).select("ts", F.col("event_type").alias("stage"), F.col("value").alias("seconds"))
    got = jobs.updating(jobs.stage_latency(stream), scratch_path(t.spark, "latency"), scratch_path(t.spark, "checkpoint"), ["start", "stage"])
    return got.select(F.unix_seconds("start").alias("start"), "stage", "n", F.round("mean_s", 6).alias("mean_s"), "p50_s", "p95_s")


@query(
    "streamed_level_meter",
    "SELECT epoch_us(time_bucket(INTERVAL '1 hour', ts)) // 1000000 AS start, event_type AS channel, max(abs(value - 50)) AS peak FROM events GROUP BY 1, 2",
)
def streamed_level_meter(t):
    stream = clocked(event_stream(t)).select("ts", F.col("event_type").alias("channel"), (F.col("value") - 50).alias("x"))
    got = jobs.updating(jobs.level_meter(stream, "1 hour"), scratch_path(t.spark, "levels"), scratch_path(t.spark, "checkpoint"), ["start", "channel"])
    return got.select(F.unix_seconds("start").alias("start"), "channel", "peak")


def staged(t, name: str, parts: int):
    """The events as ``parts`` files that arrive one after another, dealt by event number."""
    path = scratch_path(t.spark, name)
    for k in range(parts):
        t.events.where(F.col("event_id") % parts == k).coalesce(1).write.mode("append").parquet(path)
    return path


@query(
    "streamed_rating_upsert",
    using("ratings", body=f"""WITH {_RATED} SELECT run, id, geral, nativo, voz, parou, 'treino-1' AS block FROM rated"""),
)
def streamed_rating_upsert(t):
    schema = T.StructType(
        [T.StructField(n, k) for n, k in (("run", T.StringType()), ("id", T.StringType()), ("seq", T.LongType()), ("geral", T.IntegerType()), ("nativo", T.IntegerType()), ("voz", T.IntegerType()), ("parou", T.BooleanType()), ("block", T.StringType()))]
    )
    path = staged(t, "ratings-in", 3)

    class Source(type(t)):
        events = jobs.file_stream(t.spark, path, t.events.schema, files=1)

    stream = roles.ratings(Source(t.spark, t.folder)).withColumn("block", F.lit(""))
    store = jobs.DeltaStore(t.spark, scratch_path(t.spark, "ratings"), schema, ["run", "id"], "seq", by_field=True)
    got = jobs.upsert_ratings(stream.select(*schema.names), store, scratch_path(t.spark, "checkpoint"))
    return got.select("run", "id", "geral", "nativo", "voz", "parou", "block")


@query("streamed_edit_log", "SELECT doc_id AS id, quality = 1 AS keep FROM labels")
def streamed_edit_log(t):
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("seq", T.LongType()), T.StructField("keep", T.BooleanType())])
    raw = table_stream(t, "labels")
    final = raw.select(F.col("doc_id").alias("id"), F.lit(2).cast("long").alias("seq"), (F.col("quality") == 1).alias("keep"))
    log = final.unionByName(final.select("id", F.lit(1).cast("long").alias("seq"), (~F.col("keep")).alias("keep")))
    store = jobs.DeltaStore(t.spark, scratch_path(t.spark, "edits"), schema, ["id"], "seq", by_field=False)
    return jobs.resolve_edits(log, store, scratch_path(t.spark, "checkpoint")).select("id", "keep")


@query(
    "streamed_sentences",
    r"""SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, k) - 1 AS seq, md5(s) AS sentence_md5 FROM (SELECT conv_id, turn, k, regexp_replace(s, '^\s+|\s+$', '', 'g') AS s FROM
        (SELECT conv_id, turn, unnest(p) AS s, unnest(range(len(p))) AS k FROM (SELECT conv_id, turn, string_split(regexp_replace(text, '([.!?…])\s', '\1' || chr(1), 'g'), chr(1)) AS p FROM conversations))) WHERE s <> ''""",
)
def streamed_sentences(t):
    raw = table_stream(t, "conversations")
    pieces = raw.select("conv_id", "turn", F.posexplode(F.split("text", "(?<= )")).alias("k", "piece"), F.size(F.split("text", "(?<= )")).alias("n"))
    chunks = pieces.select("conv_id", (F.col("turn") * roles.TURNS + F.col("k")).alias("pos"), "piece", (F.col("k") == F.col("n") - 1).alias("last"))
    out = scratch_path(t.spark, "sentences")
    stream = jobs.sentence_stream(chunks)
    jobs.drain_to_files(stream, scratch_path(t.spark, "checkpoint"), out)
    return t.spark.read.schema(stream.schema).parquet(out).select("conv_id", "seq", F.md5("sentence").alias("sentence_md5"))


@query("resumed_files", "SELECT event_id, event_type FROM events")
def resumed_files(t):
    folder, out, checkpoint = scratch_path(t.spark, "new-files"), scratch_path(t.spark, "done"), scratch_path(t.spark, "checkpoint")
    work = lambda df: df.select("event_id", "event_type")
    got = None
    for k in range(2):
        t.events.where(F.col("event_id") % 2 == k).write.mode("append").parquet(folder)
        got = jobs.process_new_files(t.spark, folder, t.events.schema, work, out, checkpoint)
    return got


@query(
    "late_events",
    """WITH b AS (SELECT *, event_id % 3 AS k FROM events), m AS (SELECT k, max(ts) AS m FROM b GROUP BY 1)
        SELECT event_id, k AS batch FROM b WHERE ts < (SELECT max(m) FROM m WHERE m.k < b.k) - INTERVAL 10 MINUTE""",
)
def late_events(t):
    stream = jobs.file_stream(t.spark, staged(t, "late-in", 3), t.events.schema, files=1)
    _, late = jobs.split_late(stream, scratch_path(t.spark, "late"), scratch_path(t.spark, "checkpoint"))
    return late.select("event_id", "batch")


@query("interrupted_reply_stream", "SELECT event_id AS reply_id, round(least(1.0::DOUBLE, value / 100), 6) AS fraction FROM events")
def interrupted_reply_stream(t):
    rows = clocked(event_stream(t))
    replies = rows.select(F.col("event_id").alias("reply_id"), "ts", F.concat_ws(" ", "event_type", "props").alias("text"))
    plays = rows.select(F.col("event_id").alias("reply_id"), "ts", F.col("value").alias("played"), F.lit(100.0).alias("total"))
    stream = jobs.heard_replies(replies, plays, tn.heard_fraction(F.col("p.played"), F.col("p.total")), tx.heard_part)
    out = scratch_path(t.spark, "heard")
    jobs.drain_to_files(stream, scratch_path(t.spark, "checkpoint"), out)
    got = t.spark.read.schema(stream.schema).parquet(out)
    return got.select("reply_id", F.round("fraction", 6).alias("fraction"))
