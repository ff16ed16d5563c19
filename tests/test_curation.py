import json

import pytest
from pyspark.sql import functions as F

from vozlake.functions import license as lic
from vozlake.operators import edits as ed
from vozlake.operators import gates, splits
from vozlake.operators import ratings as rt
from vozlake.sinks import exports, json_array
from vozlake.functions import text as tx

CLIP = "id string, seq long, text string, dur_s double, speaker string, estilo_nl string"
EDIT = "id string, seq long, has_text boolean, text string, keep boolean, flags array<string>, estilo_nl string"


def test_last_edit_wins_as_a_whole_row_and_fields_fall_back(spark):
    clips = spark.createDataFrame([("a", 1, " um dois ", 2.0, "s", "base"), ("b", 2, "três quatro", 3.0, "s", None)], CLIP)
    edits = spark.createDataFrame(
        [("a", 1, True, "novo texto", False, ["ruído"], "calmo"), ("a", 2, False, None, None, None, ""), ("b", 3, True, "", True, [], None)], EDIT
    )
    got = {r.id: r for r in ed.resolve(clips, edits).collect()}
    assert (got["a"].text, got["a"].keep, got["a"].flags, got["a"].estilo_nl) == ("um dois", True, [], "base")
    assert (got["b"].text, got["b"].edited, got["b"].estilo_nl) == ("", True, None)
    merged = {r.id: r for r in ed.merge_fields(edits, ["id"]).collect()}
    assert (merged["a"].text, merged["a"].keep, merged["a"].estilo_nl) == ("novo texto", False, "")


def test_only_the_first_failing_gate_is_reported(spark):
    rows = [
        ("1", False, ["corte ruim"], "a", 99.0),
        ("2", True, ["eco", "sobreposição", "2 vozes"], "a", 99.0),
        ("3", True, [], "um", None),
        ("4", True, ["ruído"], "um dois", None),
        ("5", True, [], "um dois", 12.01),
        ("6", True, [], "um_dois três", 12.0),
    ]
    df = spark.createDataFrame(rows, "id string, keep boolean, flags array<string>, text string, dur_s double")
    got = {r.id: r.reason for r in gates.export_gates(df).collect()}
    assert got == {
        "1": "descartado na curadoria (keep=false)",
        "2": "flag de descarte: 2 vozes, sobreposição",
        "3": "texto <2 palavras: um",
        "4": "sem duração conhecida",
        "5": "duração fora de 1-12s (12.01s)",
        "6": None,
    }


def test_auto_curation_reports_every_reason(spark):
    df = spark.createDataFrame([("a", "oi", 0.5), ("b", "sim sim sim SIM", 5.0), ("c", None, 13.0), ("d", "são 3 " + "x " * 40, 11.0)], "id string, text string, dur_s double")
    got = {r.id: r for r in gates.auto_reasons(df).collect()}
    assert got["a"].reasons == "fragmento (1 pal); curto 0.5s; repetição/garbage"
    assert got["b"].reasons == "repetição/garbage" and got["c"].reasons == "vazio; longo 13.0s"
    assert got["d"].suspicions == "tem número (alvo de re-transcrição); quase no teto (11.0s); run-on (42 pal)"


@pytest.mark.parametrize("limit", [10**6, 10])
def test_duration_char_gate_uses_plain_elements(spark, limit):
    rows = [(f"r{i}", "big", float(1 + i % 7), "abcde") for i in range(30)] + [("slow", "big", 50.0, "ab!")] + [(f"s{i}", "small", float(i), "ab") for i in range(1, 12)]
    df = spark.createDataFrame(rows, "id string, speaker string, dur_s double, text string")
    rates = sorted([(1 + i % 7) / 5 for i in range(30)] + [25.0])
    q1, q3 = rates[31 // 4], rates[3 * 31 // 4]
    bounds = {r.speaker: r for r in gates.duration_char_bounds(df, rows_per_task=limit).collect()}
    assert (bounds["big"].q1, bounds["big"].q3) == (pytest.approx(q1), pytest.approx(q3))
    out = {r.id for r in gates.duration_char_gate(df, rows_per_task=limit).collect() if r.outlier}
    assert out == {"slow"}


def test_license_rules(spark):
    names = ["CC-BY-4.0", "CC0", "CC-BY-NC-4.0", "Apache-2.0", "pago ELRA", "gravação própria", "sem licença", None, "MIT"]
    df = spark.createDataFrame([(n,) for n in names], "l string")
    got = [(r.c, r.r) for r in df.select(lic.commercial_ok(F.col("l")).alias("c"), lic.research_ok(F.col("l")).alias("r")).collect()]
    assert got == [(True, True), (True, True), (False, True), (True, True), (False, False), (True, True), (False, True), (False, True), (True, True)]
    bad = spark.createDataFrame([("x", "pago")], "source string, license string")
    assert gates.license_violations(bad).count() == 1
    with pytest.raises(Exception, match="gate blocks source x"):
        gates.assert_licenses(bad).collect()


# ---- data path of a training mixture -----------------------------------------


def source(spark, name, n):
    return spark.createDataFrame([(name, f"{name}/{i:02d}.wav", f"clipe {i}") for i in range(n)], "source string, audio string, text string")


def test_holdout_then_mixture(spark):
    rows = source(spark, "voz", 3).unionByName(source(spark, "base", 20))
    voz = splits.split_holdout(rows.where("source = 'voz'"), 0.34)
    base = splits.split_holdout(rows.where("source = 'base'"), 0.05)
    sizes = lambda df: {r.split: r["count"] for r in df.groupBy("split").count().collect()}
    assert sizes(voz) == {"train": 2, "holdout": 1} and sizes(base) == {"train": 19, "holdout": 1}
    both = voz.unionByName(base)
    train, held = both.where("split = 'train'"), both.where("split = 'holdout'")
    used = lambda w: {r.source: r["count"] for r in splits.apply_mix(train, w).groupBy("source").count().collect()}
    assert used({"voz": 1.0, "base": 0.15}) == {"voz": 2, "base": 3}
    assert used({"voz": 1.0, "base": 0.30}) == {"voz": 2, "base": 6}
    assert used({"voz": 2.0, "base": 0.0}) == {"voz": 4}
    mixed = splits.apply_mix(train, {"voz": 2.0, "base": 0.15})
    assert splits.leaks(mixed, held).count() == 0
    order = [r.mix_key for r in mixed.orderBy("mix_key").collect()]
    again = [r.mix_key for r in splits.apply_mix(train.repartition(3), {"voz": 2.0, "base": 0.15}).orderBy("mix_key").collect()]
    assert order == again and len(set(order)) == len(order)
    same = splits.split_holdout(rows.where("source = 'base'").orderBy(F.desc("audio")), 0.05)
    assert same.select("audio", "split").exceptAll(base.select("audio", "split")).count() == 0


def test_single_row_sources_are_never_held_out(spark):
    assert splits.split_holdout(source(spark, "one", 1), 0.5).first().split == "train"


def test_anchors_drop_replicas_and_spread(spark):
    rows = source(spark, "v", 11).unionByName(source(spark, "v", 11))
    got = [r.audio for r in splits.pick_anchors(rows, 3, "source").orderBy("position").collect()]
    assert got == ["v/00.wav", "v/05.wav", "v/10.wav"]
    assert splits.pick_anchors(source(spark, "w", 2), 3, "source").count() == 2
    hot = [r.audio for r in splits.pick_anchors(rows, 3, "source", rows_per_task=3).orderBy("position").collect()]
    assert hot == got


def test_fingerprint_sees_text_mode_and_multiplicity_but_not_order(spark):
    rows = source(spark, "v", 5)
    mark = lambda df, mode="raw": splits.fingerprint(df, ["audio", "text"], mode).first().fingerprint
    assert mark(rows) == mark(rows.repartition(4).orderBy(F.desc("audio")))
    assert len({mark(rows), mark(rows, "normalize"), mark(rows.unionByName(rows)), mark(rows.withColumn("text", F.concat("text", F.lit("!"))))}) == 4


def test_caps(spark):
    rows = spark.createDataFrame([("s", i, 1800.0) for i in range(6)], "source string, seq long, dur_s double")
    assert splits.hours_cap(rows, 1.25).count() == 3 and splits.hours_cap(rows, 1.25, rows_per_task=2).count() == 3
    plan = rows.withColumn("est_s", F.lit(14))
    assert splits.time_budget(plan, 40).count() == 2 and splits.time_budget(plan, 42, rows_per_task=2).count() == 3


def test_speaker_bucket_is_the_exact_modulus(spark):
    import hashlib

    names = ["a", "b", "çé", "12345"]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "s string").select(splits.speaker_bucket(F.col("s"))).collect()]
    assert got == [int(hashlib.md5(n.encode()).hexdigest(), 16) % 10 for n in names]


def test_unknown_item_in_a_mixture_spec_is_an_error(spark):
    with pytest.raises(Exception, match="item without"):
        spark.createDataFrame([("voz",)], "s string").select(tx.key_values(F.col("s"))).collect()


def test_severity_and_markers(spark):
    df = spark.createDataFrame([("9",), ("-1",), ("Grave",), ("médio",), ("x",), (None,)], "s string")
    assert [r[0] for r in df.select(rt.severity(F.col("s"))).collect()] == [5, 1, 5, 3, 3, 3]


def test_append_unseen_keeps_each_key_once(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("a", 1.0)], "path string, duration double")
    target = str(tmp_path / "pairs")
    exports.append_unseen(rows.where("path = 'a'"), target)
    exports.append_unseen(rows, target)
    assert sorted(r.path for r in spark.read.parquet(target).collect()) == ["a", "b"]


def array_in(folder):
    return json.loads("".join(p.read_text() for p in sorted(folder.glob("*.json"))))


def test_one_json_array_from_many_tasks(spark, tmp_path):
    texts = ['a "quoted" one', "two\nlines", "é, ß", "", ",", "]"]
    rows = [(k % 50, f"clip{k}.wav", texts[k % 6], "paralinguistico" if k % 9 == 0 else "sentenca", "animado" if k % 4 == 0 else None, None) for k in range(400)]
    df = spark.createDataFrame(rows, "seq long, audio string, text string, kind string, style string, accent string").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    exports.write_conversations(df, str(tmp_path / "talk"))
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    ordered = sorted(rows, key=lambda r: (r[0], r[1]))
    assert array_in(tmp_path / "talk") == [[{"text": r[2], "audio_path": r[1], "speaker": 0}] for r in ordered]
    assert len(list((tmp_path / "talk").glob("*.json"))) > 5

    exports.write_formats(df.withColumn("style", F.coalesce("style", F.lit(""))).withColumn("accent", F.lit("")), str(tmp_path / "f"), ["csm"])
    assert array_in(tmp_path / "f" / "csm") == [{"speaker": 0, "text": ("<animado> " if r[4] else "") + r[2], "audio": r[1]} for r in ordered if r[3] != "paralinguistico"]
    back = json_array.read_json_array(spark, str(tmp_path / "talk"), "array<struct<text:string,audio_path:string,speaker:int>>")
    assert sorted(r["item"][0].audio_path for r in back.collect()) == sorted(r[1] for r in rows)

    # Written again with less, nothing of the old array stays; without rows it is an empty array.
    exports.write_conversations(df.where("seq = 3"), str(tmp_path / "talk"))
    assert len(array_in(tmp_path / "talk")) == 8
    exports.write_conversations(df.limit(0), str(tmp_path / "talk"))
    assert array_in(tmp_path / "talk") == [] and not [p for p in (tmp_path / "talk").iterdir() if p.name.startswith("_")]


def test_licence_gate_in_both_modes(spark, tmp_path):
    rows = [("a", "s1", "CC-BY-4.0", 1.0), ("b", "s2", "CC-BY-NC-4.0", 2.0), ("c", "s0", "sem licença", 4.0)]
    df = spark.createDataFrame(rows, "id string, source string, license string, dur_s double")
    report = exports.write_licensed(df, str(tmp_path / "research"))
    assert (report["rows"], report["seconds"], report["research_only"], report["research_only_source"], list(report["sources"])) == (3, 7.0, 2, "s0", ["s0", "s1", "s2"])
    assert {r.id for r in spark.read.parquet(str(tmp_path / "research")).where("research_only").collect()} == {"b", "c"}
    with pytest.raises(Exception, match="commercial gate blocks source s"):
        exports.write_licensed(df, str(tmp_path / "commercial"), "commercial")
    assert not list((tmp_path / "commercial").glob("part-*"))
    assert exports.write_licensed(df.where("id = 'a'"), str(tmp_path / "commercial"), "commercial")["research_only"] == 0
    with pytest.raises(Exception, match="research gate blocks source s9"):
        exports.write_licensed(df.unionByName(spark.createDataFrame([("d", "s9", "pago (ELRA)", 1.0)], df.schema)), str(tmp_path / "blocked"))
