"""Gates: which clips pass, and why the others do not."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vozlake.functions import license as lic
from vozlake.functions import text as tx
from vozlake.operators.ordered import ROWS_PER_TASK, attach, nth, quantiles
from vozlake.session import materialize

# Flags that drop a clip even when the curator kept it.
DROP_FLAGS = ["2 vozes", "sobreposição", "corte ruim"]
DUR_MIN, DUR_MAX, MIN_WORDS = 1.0, 12.0, 2

# Fixed values: (minimum seconds, maximum seconds, minimum words) per consumer.
HYGIENE = {
    "export": (1.0, 12.0, 2),
    "base_train": (1.5, 12.0, 3),
    "language": (1.5, 20.0, 3),
    "base_corpus": (1.0, 20.0, 1),
    "conversation": (1.5, None, 3),
}

KEPT, DROPPED = "kept", "rejected"


def some(conditions: Sequence[tuple[Column, Column | str]]) -> Column:
    """Array of the reasons whose condition holds, in the order given."""
    labels = [F.when(cond, label if isinstance(label, Column) else F.lit(label)) for cond, label in conditions]
    return F.filter(F.array(*labels), lambda r: r.isNotNull())


def first(conditions: Sequence[tuple[Column, Column | str]]) -> Column:
    """The first reason whose condition holds, or null."""
    return F.coalesce(*[F.when(c, r if isinstance(r, Column) else F.lit(r)) for c, r in conditions])


def export_gates(resolved: DataFrame, readable: str | None = None) -> DataFrame:
    """Add ``reason``: the first export gate a clip fails, null when it passes.

    Expects ``keep``, ``flags``, ``text`` and ``dur_s``; ``readable`` names an
    optional boolean column saying whether the audio could be opened.
    """
    bad = F.array_intersect(F.array_sort(F.array_distinct("flags")), F.array(*[F.lit(f) for f in DROP_FLAGS]))
    dur = F.col("dur_s")
    rules = [
        (~F.col("keep"), "descartado na curadoria (keep=false)"),
        (F.size(bad) > 0, F.concat(F.lit("flag de descarte: "), F.array_join(F.array_sort(bad), ", "))),
        (tx.unicode_word_count(F.col("text")) < MIN_WORDS, F.concat(F.lit("texto <2 palavras: "), F.col("text"))),
    ]
    if readable:
        rules.append((~F.coalesce(F.col(readable), F.lit(False)), "wav ilegível"))
    rules += [
        (dur.isNull(), "sem duração conhecida"),
        (~dur.between(DUR_MIN, DUR_MAX), F.concat(F.lit("duração fora de 1-12s ("), dur.cast("string"), F.lit("s)"))),
    ]
    return resolved.withColumn("reason", first(rules))


def _chars(rows: DataFrame) -> Column:
    """Characters that are spoken: the column ``chars`` when it is there, else from the text."""
    return F.col("chars") if "chars" in rows.columns else tx.alnum_chars(F.col("text"))


def _rate(rows: DataFrame) -> Column:
    return F.col("dur_s") / F.greatest(_chars(rows), F.lit(1)).cast("double")


def decisions(resolved: DataFrame, readable: str | None = None) -> DataFrame:
    """Gate results without the texts (id, speaker, dur_s, reason, chars, text_chars), written to the shared folder.

    Several sinks and reports read them, and the texts need to be looked at once only.
    """
    cols = ["id", "speaker", "dur_s", "reason", tx.alnum_chars(F.col("text")).alias("chars"), F.length("text").alias("text_chars")]
    return materialize(export_gates(resolved, readable).select(*cols), "decisions")


def duration_char_bounds(rows: DataFrame, key: str = "speaker", rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Per-speaker limits on seconds per character, from plain quartile elements."""
    rate = _rate(rows)
    spec = {"q1": nth(lambda n: F.floor(n / 4)), "q3": nth(lambda n: F.floor(3 * n / 4))}
    timed = rows.where((F.col("dur_s").isNotNull()) & (F.col("dur_s") != 0))
    got = quantiles(timed, [key], rate, spec, rows_per_task)
    iqr = F.col("q3") - F.col("q1")
    return got.select(key, "n", "q1", "q3", (F.col("q1") - 1.5 * iqr).alias("lo"), (F.col("q3") + 1.5 * iqr).alias("hi"))


def duration_char_gate(
    rows: DataFrame, key: str = "speaker", min_rows: int = 12, rows_per_task: int = ROWS_PER_TASK
) -> DataFrame:
    """Add ``rate`` and ``outlier``; speakers with fewer than ``min_rows`` rows are never outliers."""
    sizes = rows.groupBy(key).agg(F.count(F.lit(1)).alias("__rows"))
    bounds = sizes.join(duration_char_bounds(rows, key, rows_per_task), key, "left").select(key, "lo", "hi", "__rows")
    rate = F.when(F.col("dur_s") != 0, _rate(rows))
    out = attach(rows, bounds, [key]).withColumn("rate", rate)
    wrong = (F.col("__rows") >= min_rows) & ~F.col("rate").between(F.col("lo"), F.col("hi"))
    return out.withColumn("outlier", F.coalesce(wrong, F.lit(False))).drop("__rows")


def strict_duration_char(gated: DataFrame) -> DataFrame:
    """Turn outliers into rejects (the strict mode of the export)."""
    size = F.col("text_chars") if "text_chars" in gated.columns else F.length("text")
    label = F.concat(
        F.lit("outlier duração/char (gate): "), F.col("dur_s").cast("string"), F.lit("s p/ "), size.cast("string"), F.lit(" chars")
    )
    return gated.withColumn("reason", F.coalesce("reason", F.when(F.col("outlier"), label)))


def with_garbage(rows: DataFrame, text: str, out: str) -> DataFrame:
    """Add whether a stripped text has four or more tokens but at most two different ones, or one or two characters.

    The token array is a column of its own, because it is looked at several times.
    """
    low = rows.withColumn("__low", F.split(F.lower(text), f"{tx.SPACE}+"))
    rest = low.withColumn("__rest", F.array_remove("__low", F.get("__low", F.lit(0))))
    third = F.size(F.array_remove("__rest", F.get("__rest", F.lit(0))))
    repeated = (F.size("__low") >= 4) & ((F.size("__rest") == 0) | (third == 0))
    return rest.withColumn(out, repeated | F.length(text).between(1, 2)).drop("__low", "__rest")


def auto_reasons(rows: DataFrame, rms: str | None = None, peak: str | None = None, readable: str | None = None) -> DataFrame:
    """Add ``reasons`` (all that hold, joined by ``; ``), ``dropped`` and ``suspicions``."""
    text, words, dur = F.col("__text"), F.col("__words"), F.col("dur_s")
    seconds = F.concat(tx.fixed(dur, 1), F.lit("s"))
    # Each measure is a column of its own, so that it is taken once per row.
    measured = rows.withColumn("__text", tx.strip(F.coalesce(F.col("text"), F.lit(""))))
    measured = with_garbage(measured, "__text", "__garbage").withColumn("__words", tx.token_count(text)).withColumn("__seconds", seconds)
    seconds = F.col("__seconds")
    rules = [
        (text == "", "vazio"),
        (words.between(1, 2), F.concat(F.lit("fragmento ("), words.cast("string"), F.lit(" pal)"))),
        (dur < 1.0, F.concat(F.lit("curto "), seconds)),
        (dur > 12.0, F.concat(F.lit("longo "), seconds)),
        (F.col("__garbage"), "repetição/garbage"),
    ]
    if rms:
        rules.append((F.col(rms) < 0.004, F.concat(F.lit("quase-silêncio (rms "), tx.fixed(F.col(rms), 3), F.lit(")"))))
    if peak:
        rules.append((F.col(peak) > 0.995, F.concat(F.lit("clipping (peak "), tx.fixed(F.col(peak), 3), F.lit(")"))))
    if readable:
        rules.append((~F.coalesce(F.col(readable), F.lit(False)), "wav ilegível: sem wav"))
    doubts = [
        (text.rlike(r"\d"), "tem número (alvo de re-transcrição)"),
        (dur > 10.5, F.concat(F.lit("quase no teto ("), seconds, F.lit(")"))),
        (words > 40, F.concat(F.lit("run-on ("), words.cast("string"), F.lit(" pal)"))),
    ]
    listed = measured.withColumn("__found", some(rules))
    dropped = F.size("__found") > 0
    return (
        listed.withColumn("reasons", F.array_join("__found", "; "))
        .withColumn("dropped", dropped)
        .withColumn("suspicions", F.when(~dropped, F.array_join(some(doubts), "; ")).otherwise(""))
        .drop("__text", "__words", "__garbage", "__seconds", "__found")
    )


def pre_flags(rows: DataFrame) -> DataFrame:
    dur = F.coalesce(F.col("dur_s"), F.lit(0.0))
    rules = [
        (tx.strip(F.coalesce(F.col("text"), F.lit(""))) == "", "vazio"),
        ((dur != 0) & (dur < 2), "curto"),
        ((dur != 0) & (dur > 12), "longo"),
    ]
    return rows.withColumn("pre", some(rules))


def hygiene(rows: DataFrame, preset: str) -> DataFrame:
    """Rows inside a duration and word preset; with a stored ``dur_s`` the range reaches the scan."""
    low, high, words = HYGIENE[preset]
    inside = F.col("dur_s") >= low if high is None else F.col("dur_s").between(low, high)
    return rows.where(inside & (tx.token_count(F.col("text")) >= words))


def without_parent_kinds(takes: DataFrame, segments: DataFrame, excluded: Sequence[str] = ("monologo", "dialogo", "found")) -> DataFrame:
    """Takes of other kinds plus the transcribed segments of the excluded ones."""
    own = takes.where(~F.coalesce(F.col("kind"), F.lit("")).isin(list(excluded)))
    return own.unionByName(segments.where(F.coalesce(F.col("text"), F.lit("")) != ""), allowMissingColumns=True)


def scoreboard(gated: DataFrame, key: str = "speaker") -> DataFrame:
    """Kept clips, minutes, keep rate and rejects per speaker, plus TOTAL."""
    ok = F.col("reason").isNull()
    out = gated.rollup(key).agg(
        F.grouping(key).alias("__all"),
        F.count(F.lit(1)).alias("total"),
        F.count_if(ok).alias("kept"),
        F.coalesce(F.sum(F.when(ok, F.col("dur_s"))) / 60, F.lit(0.0)).alias("minutes"),
        F.count_if(~ok).alias("rejected"),
    )
    name = F.when(F.col("__all") == 1, "TOTAL").otherwise(F.col(key))
    rate = F.round(100.0 * F.col("kept") / F.col("total"), 4)
    return out.select(name.alias(key), "total", "kept", F.round("minutes", 4).alias("minutes"), rate.alias("keep_pct"), "rejected")


def reject_histogram(gated: DataFrame, key: str | None = "speaker") -> DataFrame:
    head = tx.reason_head(F.col("reason")).alias("reason_head")
    keys = [key, head] if key else [head]
    return gated.where("reason is not null").groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def curation_progress(resolved: DataFrame) -> DataFrame:
    """Long report (metric, value): totals, minutes kept and one line per flag."""
    totals = resolved.agg(
        F.count(F.lit(1)).cast("double").alias("total"),
        F.count_if(F.col("edited")).cast("double").alias("reviewed"),
        F.count_if(F.col("keep")).cast("double").alias("keep"),
        F.count_if(~F.col("keep")).cast("double").alias("drop"),
        tx.rounded(F.sum(F.when(F.col("keep"), F.coalesce(F.col("dur_s"), F.lit(0.0)))) / 60, 1).alias("minutes_kept"),
    )
    names = ["total", "reviewed", "keep", "drop", "minutes_kept"]
    rows = totals.select(F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in names])).alias("x")).select("x.*")
    flags = resolved.select(F.explode("flags").alias("f")).groupBy(F.concat(F.lit("flag:"), F.col("f")).alias("metric"))
    return rows.unionByName(flags.agg(F.count(F.lit(1)).cast("double").alias("value")))


def user_progress(resolved: DataFrame, user: str = "speaker") -> DataFrame:
    return resolved.groupBy(user).agg(
        F.count(F.lit(1)).alias("total"), F.count_if("edited").alias("edited"), F.count_if(~F.col("keep")).alias("dropped")
    )


def scripted_digits(items: DataFrame, scripted: Sequence[str] = ("sentenca", "emocao", "sotaque", "dialogo")) -> DataFrame:
    """Scripted items whose text still holds digits."""
    return items.where(F.col("kind").isin(list(scripted)) & F.coalesce(F.col("text"), F.lit("")).rlike(r"\d"))


def license_violations(manifest: DataFrame, mode: str = "research") -> DataFrame:
    """Rows that may not be used in ``commercial`` or ``research`` mode."""
    ok = lic.commercial_ok(F.col("license")) if mode == "commercial" else lic.research_ok(F.col("license"))
    return manifest.where(~ok)


def assert_licenses(manifest: DataFrame, mode: str = "research") -> DataFrame:
    """The manifest itself; reading a row that breaks the gate raises an error."""
    ok = lic.commercial_ok(F.col("license")) if mode == "commercial" else lic.research_ok(F.col("license"))
    fail = F.raise_error(F.concat(F.lit(f"{mode} gate blocks source "), F.coalesce(F.col("source"), F.lit("?"))))
    return manifest.withColumn("license", F.when(ok, F.col("license")).otherwise(fail.cast("string")))


def registry_violations(registry: DataFrame) -> DataFrame:
    """Registry entries marked shippable although their licence blocks it."""
    return registry.where((F.col("shippable") == "true") & ~lic.commercial_ok(F.col("licenca")))


def tier_manifest(registry: DataFrame, tier: str) -> DataFrame:
    """Registry entries of a tier as manifest rows; unusable sources raise an error."""
    rows = registry.where(F.coalesce(F.col("tier"), F.lit("")).startswith(tier)).select(
        "nome",
        F.coalesce("licenca", F.lit("")).alias("license"),
        F.coalesce("tier", F.lit("")).alias("tier"),
        F.col("nome").alias("source"),
        (F.col("shippable") == "true").alias("shippable"),
    )
    return assert_licenses(rows, "research")


def volume_preflight(rows: DataFrame, min_minutes: float = 300.0, key: str = "speaker") -> DataFrame:
    """Whole minutes per voice and whether they reach the minimum."""
    out = rows.groupBy(key).agg(F.floor(F.sum("dur_s") / 60).alias("minutes"))
    return out.withColumn("enough", F.col("minutes") >= min_minutes)


def config_violations(runs: DataFrame) -> DataFrame:
    """Runs that repeat a known configuration error, with the list of rules they break."""
    rules = [
        (~F.coalesce(F.col("warmup_steps").rlike(r"^\d+$"), F.lit(False)), "warmup_steps must be a whole number"),
        (~F.coalesce(F.col("eos_fix"), F.lit(False)), "eos_fix must be set"),
        (~F.coalesce(F.col("real_audio"), F.lit(False)), "real_audio must be set"),
        (F.coalesce(F.col("max_text_len"), F.lit(0)) < 256, "max_text_len below 256"),
        ((F.col("stage") == "B") & (F.coalesce(F.col("lr"), F.lit(1.0)) > 1e-4), "stage B learning rate above 1e-4"),
    ]
    return runs.withColumn("violations", some(rules)).where(F.size("violations") > 0)


def artifact_completeness(runs: DataFrame, wavs: DataFrame, results: DataFrame, need: int = 14) -> DataFrame:
    """Per run: whether a result file exists, how many wavs there are, and whether that is complete."""
    counts = wavs.groupBy("run").agg(F.count(F.lit(1)).alias("wavs"))
    have = results.select("run").distinct().withColumn("has_result", F.lit(True))
    out = runs.select("run").distinct().join(counts, "run", "left").join(have, "run", "left")
    out = out.select("run", F.coalesce("wavs", F.lit(0)).alias("wavs"), F.coalesce("has_result", F.lit(False)).alias("has_result"))
    return out.withColumn("complete", F.col("has_result") & (F.col("wavs") >= need))
