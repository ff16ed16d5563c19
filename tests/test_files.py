import struct
import wave

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import __spark_entry__ as entry
from vozlake import schemas as sm
from vozlake.operators import edits as ed
from vozlake.operators import gates
from vozlake.plans import roles
from vozlake.plans.registry import Tables
from vozlake.sources import audio as au
from vozlake.sources import files as fl

SIM = sm.SIMILARITY


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_strict_lines(spark, tmp_path):
    good = put(tmp_path / "a.jsonl", '{"wav": "x", "spk_sim": 0.5}\n\n  \n{"wav": "y"}\n')
    assert sorted((r.wav, r.spk_sim) for r in fl.read_jsonl(spark, good, SIM).collect()) == [("x", 0.5), ("y", None)]
    assert fl.read_jsonl(spark, str(tmp_path / "none.jsonl"), SIM).count() == 0
    bad = put(tmp_path / "b.jsonl", '{"wav": "x"}\nnot json\n')
    with pytest.raises(Exception, match="broken line"):
        fl.read_jsonl(spark, bad, SIM).collect()


def test_result_files_with_a_trailing_line(spark, tmp_path):
    path = put(tmp_path / "_spksim.jsonl", '{"wav": "x", "spk_sim": 0.5}\n\nSPK_SIM (w, ref n=3): 0.5000\n')
    good, rest = fl.read_tolerant(spark, path, SIM)
    assert [r.wav for r in good.collect()] == ["x"] and [r.value[:7] for r in rest.collect()] == ["SPK_SIM"]


def test_sessions_and_last_take(spark, tmp_path):
    put(tmp_path / "ses1" / "metadata.jsonl", '{"id": "a", "text": "um"}\n{"id": "a", "text": "dois"}\n')
    put(tmp_path / "ses2" / "metadata.jsonl", '{"id": "a", "text": "três"}\n')
    takes = fl.read_sessions(spark, str(tmp_path), sm.TAKES)
    best = ed.last_rows(takes.select("session", "id", "text", "line_order"), ["session", "id"], "line_order")
    assert sorted((r.session, r.text) for r in best.collect()) == [("ses1", "dois"), ("ses2", "três")]
    assert fl.read_sessions(spark, str(tmp_path), sm.TAKES, ["ses2"]).count() == 1


def test_registry(spark, tmp_path):
    path = put(tmp_path / "r.yaml", '# head\n- nome: "Um: A"\n  licenca: CC-BY-4.0\n  tier: T0 x\n  shippable: true\n- nome: Dois\n  licenca: "CC-BY-NC"\n  shippable: true\n')
    rows = {r.nome: r for r in fl.read_registry(spark, path).collect()}
    assert rows["Um: A"].licenca == "CC-BY-4.0" and rows["Dois"].licenca == "CC-BY-NC" and rows["Dois"].tier is None
    assert [r.nome for r in gates.registry_violations(fl.read_registry(spark, path)).collect()] == ["Dois"]
    assert [r.nome for r in gates.tier_manifest(fl.read_registry(spark, path), "T0").collect()] == ["Um: A"]


def test_results_skip_unreadable_files(spark, tmp_path):
    put(tmp_path / "r1" / "result.json", '{\n "wer": 0.2,\n "tag": "a"}')
    put(tmp_path / "r2" / "result.json", '[{"wer": 0.1, "tag": "b"}, {"wer": null, "tag": "c"}]')
    put(tmp_path / "r3" / "result.json", '{"wer": ')
    got = fl.read_results(spark, f"{tmp_path}/*/result.json", T.StructType([f for f in sm.RUN_RESULTS.fields if f.name != "run"]))
    assert sorted((r.run, r.tag) for r in got.collect()) == [("r1", "a"), ("r2", "b"), ("r2", "c")]


def test_audio_headers_and_paths(spark, tmp_path):
    (tmp_path / "segments").mkdir()
    for name, frames in (("a", 2400), ("b", 1200)):
        with wave.open(str(tmp_path / "segments" / f"{name}.wav"), "wb") as w:
            w.setnchannels(2), w.setsampwidth(2), w.setframerate(2400)
            w.writeframes(struct.pack("<hh", 1, 1) * frames)
    (tmp_path / "segments" / "bad.wav").write_bytes(b"RIFFxxxx")
    files = au.listing(spark, str(tmp_path))
    got = {fl_name(r.path): (r.sr, r.channels, r.frames, r.dur_s) for r in au.inventory(files).collect()}
    assert got == {"a": (2400, 2, 2400, 1.0), "b": (2400, 2, 1200, 0.5)}
    rows = spark.createDataFrame([("a.wav", "oi"), ("segments/b.wav", "oi"), ("c.wav", "oi"), ("b.wav", " ")], "audio string, text string")
    used, missed = au.load_rows(rows, files, str(tmp_path))
    assert (used.count(), missed.count()) == (2, 2)
    assert [r.audio for r in au.missing_audio(rows, files).collect()] == ["c.wav"]


def fl_name(path):
    return path.rsplit("/", 1)[1][:-4]


def test_every_oracle_has_its_query_and_most_queries_an_oracle():
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries) and len(oracles) > 0.85 * len(queries)


def test_flagship(spark):
    rows = {r.speaker: r for r in entry.entry(spark).collect()}
    total = rows.pop("TOTAL")
    assert total.total == sum(r.total for r in rows.values()) and total.kept + total.rejected == total.total


def plan(df):
    return df._jdf.queryExecution().toString()


def test_filters_and_columns_reach_the_scan(spark, tmp_path, sf_dir):
    path = str(tmp_path / "clips.parquet")
    roles.clips(Tables(spark, sf_dir)).write.parquet(path)
    kept = gates.hygiene(spark.read.parquet(path), "export").select("id")
    text = plan(kept)
    assert "PushedFilters: [IsNotNull(dur_s), GreaterThanOrEqual(dur_s,1.0), LessThanOrEqual(dur_s,12.0)" in text
    assert "ReadSchema: struct<id:string,dur_s:double,text:string>" in text


@pytest.mark.parametrize("name", ["export_scoreboard", "marker_overlaps", "meeting_role_pairs", "weighted_mixture", "pitch_features"])
def test_no_cartesian_products(spark, sf_dir, name):
    text = plan(entry.queries()[name](spark, sf_dir))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_delta_store_merges_fields_whatever_the_order_of_batches(spark, tmp_path):
    from vozlake.streaming.jobs import DeltaStore

    schema = sm.struct(("id", T.StringType()), ("seq", T.LongType()), ("a", T.IntegerType()), ("b", T.IntegerType()))
    store = DeltaStore(spark, str(tmp_path / "s"), schema, ["id"], "seq", by_field=True)
    store.add(spark.createDataFrame([("x", 5, None, 1), ("x", 1, 7, None)], schema), 0)
    store.add(spark.createDataFrame([("x", 3, 8, 2), ("y", 9, 1, None)], schema), 1)
    store.add(spark.createDataFrame([("x", 3, 8, 2), ("y", 9, 1, None)], schema), 1)
    want = [("x", 5, 8, 1), ("y", 9, 1, None)]
    assert sorted(tuple(r) for r in store.read().select("id", "seq", "a", "b").collect()) == want
    packed = store.compact(str(tmp_path / "c"))
    assert sorted(tuple(r) for r in packed.read().select("id", "seq", "a", "b").collect()) == want
    assert packed.read().where(F.col("id") == "x").count() == 1


def wave_bytes(before: bytes = b"", frames: int = 100, rf64: bool = False) -> bytes:
    fmt = b"fmt " + struct.pack("<IHHIIHH", 16, 1, 2, 8000, 32000, 4, 16)
    large = b"ds64" + struct.pack("<IQQQI", 28, 0, frames * 4, frames, 0) if rf64 else b""
    size = 0xFFFFFFFF if rf64 else frames * 4
    return (b"RF64" if rf64 else b"RIFF") + struct.pack("<I", 0) + b"WAVE" + large + before + fmt + b"data" + struct.pack("<I", size)


def test_headers_far_into_a_file_and_unreadable_files(spark, tmp_path):
    junk = b"JUNK" + struct.pack("<I", 100_001) + b"\0" * 100_002
    for name, data in {"a": wave_bytes(), "b": wave_bytes(junk), "c": wave_bytes(junk, 5_000_000_000, True), "d": b"RIFF", "e": b"RIFF\0\0\0\0WAVEfmt ", "f": b""}.items():
        (tmp_path / f"{name}.wav").write_bytes(data)
    files = au.listing(spark, str(tmp_path))
    got = {r.path[-5]: (r.sr, r.channels, r.frames) for r in au.inventory(files).collect()}
    assert got == {"a": (8000, 2, 100), "b": (8000, 2, 100), "c": (8000, 2, 5_000_000_000)}
    assert {r.path[-5] for r in au.unreadable(files).where("reason <> ''").collect()} == {"d", "e"}  # Spark lists no empty file


def test_separator_that_shows_late(spark, tmp_path):
    (tmp_path / "t.txt").write_text("# head\n" * 3000 + "".join(f"w{k}.wav == words {k}\n" for k in range(60)))
    got = {r.wav: r.text for r in au.transcripts(spark, [str(tmp_path)]).collect()}
    assert len(got) == 60 and "words 7" in got.values()
