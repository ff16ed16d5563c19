"""Queries that write derived files to the shared folder and read them through the sources."""

from __future__ import annotations

import struct as st
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.errors import SparkRuntimeException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vozlake import schemas as sm
from vozlake.functions import license as lic
from vozlake.operators import edits as ed
from vozlake.operators import frames as fr
from vozlake.operators import gates
from vozlake.operators import prosody as pr
from vozlake.plans import roles
from vozlake.plans.curation import _OK, _RESEARCH, gated
from vozlake.plans.evaluation import _RUNS, runs
from vozlake.plans.registry import query
from vozlake.plans.roles import using
from vozlake.plans.speech import pairs
from vozlake.session import scratch_path
from vozlake.sinks import exports as ex
from vozlake.sinks.json_array import read_json_array
from vozlake.sources import audio as au
from vozlake.sources import files as fl


def to_text(df, path: str):
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("overwrite").text(path)
    return path


_CLIP = sm.struct(("id", T.StringType()), ("speaker", T.StringType()), ("dur_s", T.DoubleType()), ("text", T.StringType()))


@query("scan_json_lines", using("clips", body="SELECT id, speaker, dur_s, md5(text) AS text_md5 FROM clips"))
def scan_json_lines(t):
    path = to_text(roles.clips(t).select("id", "speaker", "dur_s", "text"), scratch_path(t.spark, "clips"))
    none = fl.read_jsonl(t.spark, path + "-missing", _CLIP)
    return fl.read_jsonl(t.spark, path, _CLIP).unionByName(none).select("id", "speaker", "dur_s", F.md5("text").alias("text_md5"))


@query(
    "scan_tolerant_lines",
    using("clips", body="SELECT 'good' AS part, count(*) AS n FROM clips WHERE seq % 9 <> 0 UNION ALL SELECT 'quarantine', count(*) FROM clips WHERE seq % 9 = 0"),
)
def scan_tolerant_lines(t):
    path = scratch_path(t.spark, "broken")
    c = roles.clips(t)
    row = F.to_json(F.struct("id", "speaker", "dur_s", "text"))
    c.select(F.when(F.col("seq") % 9 == 0, F.concat(F.lit("SPK_SIM: "), "id")).otherwise(row).alias("value")).write.text(path)
    good, bad = fl.read_tolerant(t.spark, path, _CLIP)
    n = lambda df, part: df.agg(F.lit(part).alias("part"), F.count(F.lit(1)).alias("n"))
    return n(good, "good").unionByName(n(bad, "quarantine"))


@query("scan_sessions", using("clips", body="SELECT session, count(*) AS n, round(sum(dur_s), 2) AS seconds FROM clips GROUP BY 1"))
def scan_sessions(t):
    root = scratch_path(t.spark, "sessions")
    rows = roles.clips(t).select("session", F.to_json(F.struct("id", "speaker", "dur_s", "text")).alias("value"))
    rows.repartition("session").write.partitionBy("session").text(root)
    found = fl.read_sessions(t.spark, root, _CLIP, name="*.txt")
    return found.groupBy(F.replace("session", F.lit("session="), F.lit("")).alias("session")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("dur_s"), 2).alias("seconds"))


@query(
    "scan_edit_log_order",
    "SELECT lpad(doc_id::VARCHAR, 12, '0') AS id, 'second' AS text FROM labels",
)
def scan_edit_log_order(t):
    """Two lines per id in one file: the later line wins by its place in the file."""
    schema = sm.struct(("id", T.StringType()), ("text", T.StringType()))
    lines = F.array(*[F.to_json(F.struct(roles.clip_key().alias("id"), F.lit(x).alias("text"))) for x in ("first", "second")])
    path = scratch_path(t.spark, "log")
    t.labels.select(F.array_join(lines, "\n").alias("value")).write.text(path)
    return ed.last_rows(fl.read_jsonl(t.spark, path, schema, ("line_order",)), ["id"], "line_order").select("id", "text")


@query(
    "curation_table",
    """SELECT source || '-m_seg' || lpad(doc_id::VARCHAR, 9, '0') AS id, CASE WHEN doc_id % 5 = 0 THEN 'desconhecido' ELSE source END AS speaker, source || '-m' AS session, doc_id % 3 <> 1 AS keep, md5(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS text_md5 FROM documents""",
)
def curation_table(t):
    d = F.col("doc_id")
    landed = t.documents.select(
        F.concat("source", F.lit("-m_seg"), F.lpad(d.cast("string"), 9, "0")).alias("id"), F.when(d % 5 != 0, F.col("source")).alias("usuario"), F.lit("a.wav").alias("audio"),
        F.col("text").alias("text_orig"), F.when(d % 2 == 0, "").otherwise(F.col("text")).alias("texto"), F.when(d % 3 == 0, None).otherwise(d % 3 == 2).alias("manter"),
        F.lit(None).cast("array<string>").alias("flags"), F.lit(1.0).alias("dur_s"),
    )
    path = scratch_path(t.spark, "landed") + ".parquet"
    landed.write.parquet(path)
    got = fl.curation_table(fl.read_table(t.spark, path, landed.schema))
    return got.select("id", "speaker", "session", "keep", F.md5("text").alias("text_md5"))


@query(
    "registry_scan",
    using("manifest", body=f"""SELECT source AS nome, max(license) AS licenca, {_OK.replace("license", "max(license)")} AS ok, CASE WHEN count(*) > 40 THEN 'true' ELSE 'false' END AS shippable FROM manifest GROUP BY 1"""),
)
def registry_scan(t):
    from vozlake.functions.license import commercial_ok

    rows = roles.manifest(t).groupBy("source").agg(F.max("license").alias("l"), F.count(F.lit(1)).alias("n"))
    item = F.concat(F.lit('- nome: "'), "source", F.lit('"\n  licenca: "'), "l", F.lit('"\n  tier: T0\n  shippable: '), F.when(F.col("n") > 40, "true").otherwise("false"))
    path = scratch_path(t.spark, "registry")
    rows.select(item.alias("value")).coalesce(1).write.text(path)
    got = fl.read_registry(t.spark, path)
    return got.select("nome", "licenca", commercial_ok(F.col("licenca")).alias("ok"), "shippable")


@query("formant_table_csv", "SELECT label::VARCHAR AS speaker_id, count(*) AS n, round(sum(embedding[1]::DOUBLE), 5) AS f1 FROM embeddings GROUP BY 1")
def formant_table_csv(t):
    path = scratch_path(t.spark, "formants")
    rows = t.embeddings.select(F.col("label").cast("string").alias("speaker_id"), F.col("embedding")[0].cast("double").alias("F1_Hz"))
    rows.write.csv(path, header=True)
    got = fl.read_table(t.spark, path, rows.schema)
    return got.groupBy("speaker_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("F1_Hz"), 5).alias("f1"))


@query(
    "run_results",
    "SELECT 'run=' || r AS run, clips, round(wer, 8) AS wer FROM (SELECT user_id % 12 AS r, count(*) AS clips, avg(value) / 100 AS wer FROM events GROUP BY 1) WHERE r <> 5",
)
def run_results(t):
    rows = t.events.groupBy((F.col("user_id") % 12).alias("run")).agg(F.count(F.lit(1)).alias("clips"), (F.avg("value") / 100).alias("wer"))
    body = F.when(F.col("run") == 5, '{"clips": ').otherwise(F.concat(F.lit("["), F.to_json(F.struct("clips", "wer")), F.lit("]")))
    root = scratch_path(t.spark, "runs")
    rows.select("run", body.alias("value")).repartition("run").write.partitionBy("run").text(root)
    schema = sm.struct(("clips", T.LongType()), ("wer", T.DoubleType()))
    got = fl.read_results(t.spark, f"{root}/*/*.txt", schema)
    return got.select("run", "clips", F.round("wer", 8).alias("wer"))


@query("benchmark_scan", "SELECT item_id::VARCHAR AS id, md5(text) AS text_md5 FROM benchmark")
def benchmark_scan(t):
    rows = t.benchmark.select(F.col("item_id").cast("string").alias("id"), "text", F.lit("neutro").alias("emotion"))
    path = to_text(rows, scratch_path(t.spark, "bench"))
    return fl.read_benchmark(t.spark, path, sm.BENCHMARK).select("id", F.md5("text").alias("text_md5"))


# ---- audio ------------------------------------------------------------------


def _wave(text: bytes, rate: int) -> bytes:
    """Bytes as 8-bit mono samples with a wave header."""
    return b"RIFF" + st.pack("<I", 36 + len(text)) + b"WAVEfmt " + st.pack("<IHHIIHH", 16, 1, 1, rate, rate, 1, 8) + b"data" + st.pack("<I", len(text)) + text


def wavs(t, rate: int = 100):
    """One small wave file per turn, made of the bytes of its text."""
    root = scratch_path(t.spark, "wavs")
    rows = roles.turns(t).select(F.concat(F.lit("run"), (F.col("conv_id") % 5).cast("string")).alias("run"), F.col("turn_id").cast("string").alias("id"), "text")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        plain = root[5:] if root.startswith("file:") and not root.startswith("file://") else root
        system, base = fs.FileSystem.from_uri(plain) if "://" in plain else (fs.LocalFileSystem(), plain)
        for batch in batches:
            for run, id_, text in zip(batch["run"], batch["id"], batch["text"]):
                system.create_dir(f"{base}/{run}", recursive=True)
                with system.open_output_stream(f"{base}/{run}/{id_}.wav") as out:
                    out.write(_wave(text.encode("utf-8"), rate))
            yield pd.DataFrame({"n": [len(batch)]})

    rows.mapInPandas(write, "n long").agg(F.sum("n")).collect()
    return root


@query("audio_inventory", using("turns", body="SELECT 'run' || (conv_id % 5) AS run, turn_id::VARCHAR AS id, 100 AS sr, strlen(text) AS frames, round(strlen(text) / 100.0::DOUBLE, 6) AS dur_s FROM turns"))
def audio_inventory(t):
    files = au.listing(t.spark, wavs(t))
    got = au.inventory(files).join(au.run_files(files).withColumnRenamed("wav", "path"), "path")
    return got.select("run", "id", "sr", "frames", F.round("dur_s", 6).alias("dur_s"))


@query(
    "resolved_audio_rows",
    using("turns", body="SELECT CASE WHEN turn % 2 = 0 THEN 'used' ELSE 'missed' END AS part, count(*) AS n FROM turns GROUP BY 1"),
)
def resolved_audio_rows(t):
    root = wavs(t)
    files = au.listing(t.spark, root)
    plain = root.removeprefix("file://").removeprefix("file:")
    name = F.concat(F.lit("run"), (F.col("conv_id") % 5).cast("string"), F.lit("/"), F.col("turn_id").cast("string"), F.when(F.col("turn") % 2 == 0, ".wav").otherwise(".mp3"))
    used, missed = au.load_rows(roles.turns(t).select(name.alias("audio"), "text"), files, plain)
    n = lambda df, part: df.agg(F.lit(part).alias("part"), F.count(F.lit(1)).alias("n"))
    return n(used, "used").unionByName(n(missed, "missed"))


@query("manifest_without_audio", using("turns", body="SELECT turn_id FROM turns WHERE turn % 3 = 1"))
def manifest_without_audio(t):
    files = au.listing(t.spark, wavs(t))
    suffix = F.when(F.col("turn") % 3 == 1, "-x.wav").otherwise(".wav")
    rows = roles.turns(t).select("turn_id", F.concat(F.lit("segments/"), F.col("turn_id").cast("string"), suffix).alias("audio"))
    return au.missing_audio(rows, files).select("turn_id")


@query("transcribed_audio", using("turns", body=r"SELECT turn_id::VARCHAR AS wav, md5(regexp_replace(text, '\n', ' ', 'g')) AS text_md5 FROM turns"))
def transcribed_audio(t):
    files = au.listing(t.spark, wavs(t))
    line = F.concat(F.lit("wavs/"), F.col("turn_id").cast("string"), F.lit(".wav == "), F.regexp_replace("text", "\n", " "))
    path = scratch_path(t.spark, "transcripts")
    roles.turns(t).select(line.alias("value")).coalesce(1).write.text(path)
    noise = scratch_path(t.spark, "notes-with-a-longer-path")
    t.benchmark.select(F.concat_ws("|", F.col("item_id").cast("string"), F.lit("x")).alias("value")).coalesce(1).write.text(noise)
    got = au.with_audio(au.transcripts(t.spark, [path, noise]), files)
    return got.select("wav", F.md5("text").alias("text_md5"))


# ---- sinks ------------------------------------------------------------------


@query(
    "written_train_and_rejects",
    using("gated", body="SELECT 'train' AS part, speaker, count(*) AS n, min(id) AS first FROM gated WHERE reason IS NULL GROUP BY 2 UNION ALL SELECT 'rejects', speaker, count(*), min(id) FROM gated WHERE reason IS NOT NULL GROUP BY 2"),
)
def written_train_and_rejects(t):
    path = scratch_path(t.spark, "export")
    ex.write_train(gated(t), path)
    n = lambda part: t.spark.read.schema("id string, speaker string").json(f"{path}/{part}").groupBy("speaker").agg(F.lit(part).alias("part"), F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    return n("train").unionByName(n("rejects")).select("part", "speaker", "n", "first")


@query(
    "written_formats",
    using("clips", body="SELECT 'canonical' AS format, count(*) AS n FROM clips UNION ALL SELECT 'csm', count(*) FROM clips WHERE kind <> 'dialogo' UNION ALL SELECT 'orpheus', count(*) FROM clips UNION ALL SELECT 'ljspeech', count(*) FROM clips UNION ALL SELECT 'conversations', count(*) FROM clips"),
)
def written_formats(t):
    path = scratch_path(t.spark, "formats")
    rows = export_rows(t)
    ex.write_formats(rows, path, ["canonical", "csm", "orpheus", "ljspeech"])
    ex.write_conversations(rows, f"{path}/conversations")
    held = {name: t.spark.read.text(f"{path}/{name}") for name in ("canonical", "orpheus", "ljspeech")}
    held |= {name: read_json_array(t.spark, f"{path}/{name}", kind) for name, kind in ARRAYS.items()}
    parts = [rows.agg(F.lit(name).alias("format"), F.count(F.lit(1)).alias("n")) for name, rows in held.items()]
    return reduce(DataFrame.unionByName, parts)


ARRAYS = {"csm": "struct<speaker:int,text:string,audio:string>", "conversations": "array<struct<text:string,audio_path:string,speaker:int>>"}


def export_rows(t):
    return roles.clips(t).withColumn("kind", F.when(F.col("kind") == "dialogo", "paralinguistico").otherwise(F.col("kind")))


@query(
    "written_arrays",
    using("clips", body="""WITH p AS (SELECT *, CASE WHEN style IN ('neutro', 'conversa') OR style IS NULL THEN '' ELSE style END AS s, CASE WHEN accent = 'carioca-medio' OR accent IS NULL THEN '' ELSE accent END AS a FROM clips)
        SELECT 'csm' AS format, audio, 0 AS speaker, md5(CASE WHEN s || a = '' THEN '' ELSE '<' || s || CASE WHEN s <> '' AND a <> '' THEN '|' ELSE '' END || a || '> ' END || text) AS text_md5 FROM p WHERE kind <> 'dialogo'
        UNION ALL SELECT 'conversations', audio, 0, md5(text) FROM p"""),
)
def written_arrays(t):
    path = scratch_path(t.spark, "arrays")
    ex.write_formats(export_rows(t), path, ["csm"])
    ex.write_conversations(export_rows(t), f"{path}/conversations")
    turn = read_json_array(t.spark, f"{path}/csm", ARRAYS["csm"]).select(F.lit("csm").alias("format"), "item.audio", "item.speaker", F.md5("item.text").alias("text_md5"))
    talk = read_json_array(t.spark, f"{path}/conversations", ARRAYS["conversations"]).select(F.explode("item").alias("turn"))
    return turn.unionByName(talk.select(F.lit("conversations").alias("format"), F.col("turn.audio_path").alias("audio"), "turn.speaker", F.md5("turn.text").alias("text_md5")))


def _gate_sql(run: str, mode: str, bad: str, rows: str) -> str:
    held = f"count(*) FILTER ({bad}) > 0"
    return f"""SELECT '{run}' AS run, '{mode}' AS mode, CASE WHEN {held} THEN 'blocked' ELSE 'written' END AS outcome, CASE WHEN NOT {held} THEN count(*) END AS rows,
        CASE WHEN NOT {held} THEN count(*) FILTER (NOT {_OK}) END AS research_only, CASE WHEN NOT {held} THEN min(source) FILTER (NOT {_OK}) END AS research_only_source FROM {rows}"""


@query(
    "license_gate_runs",
    using("manifest", body=" UNION ALL ".join([
        _gate_sql("everything", "commercial", f"NOT {_OK}", "manifest"),
        _gate_sql("everything", "research", f"NOT {_RESEARCH}", "manifest"),
        _gate_sql("usable", "research", "FALSE", f"(SELECT * FROM manifest WHERE {_RESEARCH})"),
        _gate_sql("usable", "commercial", f"NOT {_OK}", f"(SELECT * FROM manifest WHERE {_RESEARCH})"),
        _gate_sql("shippable", "commercial", "FALSE", f"(SELECT * FROM manifest WHERE {_OK})"),
    ])),
)
def license_gate_runs(t):
    """Manifests written through the gate in both modes: what was blocked, and the report of what was written."""
    manifest = roles.manifest(t)
    usable, shippable = manifest.where(lic.research_ok(F.col("license"))), manifest.where(lic.commercial_ok(F.col("license")))
    out = []
    for run, rows, mode in [("everything", manifest, "commercial"), ("everything", manifest, "research"), ("usable", usable, "research"), ("usable", usable, "commercial"), ("shippable", shippable, "commercial")]:
        try:
            report = ex.write_licensed(rows, scratch_path(t.spark, "licensed"), mode)
            out.append((run, mode, "written", report["rows"], report["research_only"], report["research_only_source"]))
        except SparkRuntimeException as error:
            if "gate blocks source" not in str(error):
                raise
            out.append((run, mode, "blocked", None, None, None))
    return t.spark.createDataFrame(out, "run string, mode string, outcome string, rows long, research_only long, research_only_source string")


@query("appended_pairs", using("turns", body="SELECT 'p' || turn_id AS path, dur_s AS duration FROM turns"))
def appended_pairs(t):
    path = scratch_path(t.spark, "pairs")
    rows = roles.turns(t).select(F.concat(F.lit("p"), F.col("turn_id").cast("string")).alias("path"), F.col("dur_s").alias("duration"))
    ex.append_unseen(rows.where("duration < 5"), path)
    ex.append_unseen(rows, path)
    return t.spark.read.schema(rows.schema).parquet(path)


@query(
    "curation_report",
    using("gated", body="SELECT 'speakers' AS section, speaker AS key, unnest(['total', 'rejected']) AS metric, unnest([count(*)::DOUBLE, count(reason)]) AS value FROM gated GROUP BY 2"),
)
def curation_report(t):
    board = gates.scoreboard(gated(t)).where("speaker <> 'TOTAL'")
    lines = ex.long_report("speakers", board, F.col("speaker"), ["total", "rejected"])
    return reread(t, lines)


def reread(t, lines):
    """Report lines as they stand in the written report."""
    path = scratch_path(t.spark, "report")
    ex.write_report(lines, path)
    return ex.read_report(t.spark, path)


@query(
    "written_reports",
    using("clips", body=f"""WITH {_RUNS}, q AS (SELECT style, sum(dur_s) / 60 AS minutes, count(*) AS takes FROM (SELECT coalesce(style, '-') AS style, dur_s FROM clips) GROUP BY 1)
        SELECT 'leaderboard' AS section, tag AS key, 'wer' AS metric, round(wer, 4) AS value FROM runs UNION ALL SELECT 'leaderboard', tag, 'clips', clips::DOUBLE FROM runs
        UNION ALL SELECT 'minutes by style', style, 'minutes', round(minutes, 4) FROM q UNION ALL SELECT 'minutes by style', style, 'takes', takes::DOUBLE FROM q
        UNION ALL SELECT 'punctuation', 'all', 'clips', count(*)::DOUBLE FROM documents UNION ALL SELECT 'punctuation', 'all', 'changed', count(*) FILTER (a <> b)::DOUBLE FROM
          (SELECT regexp_replace(text, '\\s', '', 'g') AS a, regexp_replace(CASE WHEN doc_id % 4 = 0 THEN text ELSE regexp_replace(regexp_replace(text, '\\. ', '… ', 'g'), ', ', CASE WHEN doc_id % 3 = 0 THEN ' ' ELSE ', ' END, 'g') END, '\\s', '', 'g') AS b FROM documents)"""),
)
def written_reports(t):
    """Leaderboard, recorded minutes and punctuation, written as one report and read again."""
    styles = fr.qc_minutes(roles.clips(t)).where("axis = 'style'")
    marks = pr.punctuation_report(pairs(t))
    lines = ex.long_report("leaderboard", runs(t), F.col("tag"), ["wer", "clips"])
    lines = lines.unionByName(ex.long_report("minutes by style", styles, F.col("name"), ["minutes", "takes"]))
    return reread(t, lines.unionByName(ex.long_report("punctuation", marks, F.lit("all"), ["clips", "changed"])))
