"""Human ratings: manifests, feedback records, completeness and insights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vozlake.functions.text import rounded
from vozlake.operators.ordered import ROWS_PER_TASK, attach, salted_join

SCORES = ("geral", "nativo", "natural", "voz")

# Emotion labels of the recogniser and the labels used here.
EMOTION_MAP = {
    "angry": "angry",
    "disgusted": "disgusted",
    "fearful": "anxious",
    "happy": "happy",
    "neutral": "neutral",
    "sad": "sad",
    "surprised": "surprised",
}
# Substrings of the run name that mark a voice run.
VOICE_RUN_MARKS = ("stage", "voz")


def manifest(wavs: DataFrame, benchmark: DataFrame, per_sentence: DataFrame, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Generated clips with benchmark text and per-sentence scores, defaults where either is missing."""
    b = benchmark.select("id", F.col("text").alias("b_text"), F.col("emotion").alias("b_emotion"), F.col("accent").alias("b_accent"))
    withb = salted_join(wavs, b, ["id"], ["run", "id"], "left", rows_per_task)
    scores = per_sentence.select("run", "id", "wer", "dur_s", "ref", F.col("hyp").alias("s_hyp"))
    joined = withb.join(scores, ["run", "id"], "left")
    return joined.select(
        "run",
        "id",
        F.coalesce("b_emotion", F.lit("?")).alias("emotion"),
        F.coalesce("b_accent", F.lit("?")).alias("accent"),
        F.coalesce("b_text", "ref", F.lit("")).alias("text"),
        "wer",
        "dur_s",
        F.coalesce("s_hyp", F.lit("")).alias("hyp"),
        *[c for c in wavs.columns if c not in ("run", "id")],
    )


def feedback_records(clips: DataFrame, ratings: DataFrame) -> DataFrame:
    """Clips with nested ratings, problems and markers (schema version 1)."""
    r = ratings.select("run", "id", *SCORES, "parou", "carioca", "nota", "problemas", "markers", "ts")
    joined = clips.join(r, ["run", "id"], "left")
    tags = F.coalesce("problemas", F.array().cast("array<string>"))
    kind = dict(ratings.dtypes)["markers"]
    return joined.select(
        F.lit(1).alias("schema_version"),
        "run",
        "id",
        F.col("wav").alias("audio"),
        F.col("text").alias("ref_text"),
        F.col("hyp").alias("asr_hyp"),
        "emotion",
        "accent",
        "wer",
        "dur_s",
        F.struct(*SCORES, "parou", "carioca", "nota").alias("ratings"),
        tags.alias("problems"),
        F.coalesce("markers", F.array().cast(kind)).alias("markers"),
        F.col("ts").alias("rated_ts"),
    )


def rated_at(ms: Column) -> Column:
    return F.timestamp_millis(ms)


def insights(rated: DataFrame) -> DataFrame:
    """Per run and per emotion: rated clips, mean scores (one decimal) and stop rate."""
    rows = rated.where(F.col("geral").isNotNull())
    stop = F.avg(F.when(F.col("parou").isNotNull(), F.col("parou").cast("int")))
    aggs = [F.count(F.lit(1)).alias("n"), *[rounded(F.avg(c), 1).alias(c) for c in SCORES], F.bround(100 * stop).alias("parou_pct")]
    both = rows.groupingSets([[F.col("run")], [F.col("emotion")]], F.col("run"), F.col("emotion")).agg(F.grouping("run").alias("__g"), *aggs)
    axis = F.when(F.col("__g") == 0, "run").otherwise("emotion")
    name = F.when(F.col("__g") == 0, F.col("run")).otherwise(F.col("emotion"))
    return both.select(axis.alias("axis"), name.alias("name"), "n", *SCORES, "parou_pct")


def problem_ranking(rated: DataFrame) -> DataFrame:
    return rated.where(F.col("geral").isNotNull()).select(F.explode("problemas").alias("problem")).groupBy("problem").agg(F.count(F.lit(1)).alias("n"))


def marker_coverage(ratings: DataFrame) -> DataFrame:
    """Long report over all ratings: marked clips, markers, markers per tag."""
    n = F.size(F.coalesce(F.col("markers"), F.array().cast(dict(ratings.dtypes)["markers"])))
    totals = ratings.agg(F.count_if(n > 0).alias("a"), F.coalesce(F.sum(n), F.lit(0)).cast("long").alias("b"))
    lines = F.array(F.struct(F.lit("clips").alias("metric"), F.col("a").alias("n")), F.struct(F.lit("markers").alias("metric"), F.col("b").alias("n")))
    tags = ratings.select(F.explode("markers").alias("m")).groupBy(F.concat(F.lit("tag:"), F.coalesce("m.tag", F.lit("?"))).alias("metric"))
    return totals.select(F.explode(lines).alias("x")).select("x.*").unionByName(tags.agg(F.count(F.lit(1)).alias("n")))


def required_fields(run: Column, voice_marks: tuple[str, ...] = VOICE_RUN_MARKS) -> Column:
    """Fields a rating needs; runs whose name holds a voice mark also need ``voz``."""
    base = F.array(*[F.lit(c) for c in ("geral", "nativo", "natural", "parou", "carioca")])
    voice = F.lit(False)
    for mark in voice_marks:
        voice = voice | F.contains(run, F.lit(mark))
    return F.when(voice, F.concat(base, F.array(F.lit("voz")))).otherwise(base)


def completeness(clips: DataFrame, ratings: DataFrame, voice_marks: tuple[str, ...] = VOICE_RUN_MARKS) -> DataFrame:
    """Per clip the required fields that are still missing."""
    fields = ("geral", "nativo", "natural", "parou", "carioca", "voz")
    given = F.filter(F.array(*[F.when(F.coalesce(F.col(f"r.{c}").cast("string"), F.lit("")) != "", F.lit(c)) for c in fields]), lambda x: x.isNotNull())
    joined = clips.alias("c").join(ratings.alias("r"), ["run", "id"], "left")
    missing = F.array_except(required_fields(F.col("run"), voice_marks), given)
    return joined.select("run", "id", missing.alias("missing"), (F.size(missing) == 0).alias("complete"))


def severity(sev: Column) -> Column:
    """Whole numbers clamped to 1..5; words grave 5, médio 3, leve 1; anything else 3."""
    number = sev.try_cast("int")
    low = F.lower(sev.cast("string"))
    words = F.when(low == "grave", 5).when(low.isin("medio", "médio"), 3).when(low == "leve", 1).otherwise(3)
    return F.when(number.isNotNull(), F.least(F.greatest(number, F.lit(1)), F.lit(5))).otherwise(words)


def severity_bucket(sev: Column) -> Column:
    level = severity(sev)
    return F.when(level <= 2, "leve").when(level <= 3, "medio").otherwise("grave")


def sorted_markers(markers: Column) -> Column:
    """Markers by start time."""
    return F.array_sort(markers, lambda a, b: F.when(a["t_start"] < b["t_start"], -1).when(a["t_start"] > b["t_start"], 1).otherwise(0))


def emotion_suggestion(scores: Column) -> Column:
    """Top two recogniser labels mapped to ours; the second only above 0.15 or when the first is unknown.

    ``scores`` is an array of (label, score).
    """
    ordered = F.array_sort(scores, lambda a, b: F.when(a["score"] > b["score"], -1).when(a["score"] < b["score"], 1).otherwise(0))
    english = lambda p: F.lower(F.trim(F.element_at(F.split(p["label"], "/"), -1)))
    mapped = F.create_map(*[F.lit(x) for kv in EMOTION_MAP.items() for x in kv])
    top = F.transform(F.slice(ordered, 1, 2), lambda p: F.struct(F.try_element_at(mapped, english(p)).alias("m"), p["score"].alias("s")))
    one, two = F.get(top, 0), F.get(top, 1)
    second = F.when(two["m"].isNotNull() & ((two["s"] > 0.15) | one["m"].isNull()), two["m"])
    return F.array_distinct(F.filter(F.array(one["m"], second), lambda x: x.isNotNull()))


def emotion_rule_violations(rows: DataFrame, column: str = "emocoes") -> DataFrame:
    """Rows whose emotion set breaks a rule: neutral stands alone, at most three."""
    e = F.col(column)
    rules = F.filter(
        F.array(
            F.when(F.array_contains(e, "neutral") & (F.size(e) > 1), F.lit("neutral with others")),
            F.when(F.size(e) > 3, F.lit("more than three")),
        ),
        lambda x: x.isNotNull(),
    )
    return rows.withColumn("violations", rules).where(F.size("violations") > 0)


def without_suggestion(rows: DataFrame, user: str | None = None) -> DataFrame:
    """Rows that have no automatic emotion yet, optionally of one user."""
    out = rows.where(F.coalesce(F.size("emocoes_auto"), F.lit(0)) <= 0)
    return out if user is None else out.where(F.col("usuario") == user)


def per_user_totals(rated: DataFrame, clips: DataFrame) -> DataFrame:
    """Clips and rated clips per run."""
    total = clips.groupBy("run").agg(F.count(F.lit(1)).alias("clips"))
    done = rated.where(F.col("geral").isNotNull()).groupBy("run").agg(F.count(F.lit(1)).alias("rated"))
    return attach(total, done, ["run"]).withColumn("rated", F.coalesce("rated", F.lit(0)))
