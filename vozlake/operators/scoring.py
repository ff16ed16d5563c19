"""Word error rates: per sentence, in aggregate and as operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vozlake.functions import wer as w
from vozlake.operators.ordered import ROWS_PER_TASK, beside, linear, quantiles
from vozlake.session import bounded_batches, materialize


def score(rows: DataFrame, ref: str = "ref", hyp: str = "hyp", training: bool = False) -> DataFrame:
    """Add ``wer``; the training variant scores an empty hypothesis 1."""
    split = rows.withColumn("__r", w.wer_tokens(F.col(ref))).withColumn("__h", w.wer_tokens(F.col(hyp)))
    value = w.rate(F.col("__r"), F.col("__h"))
    if training:
        value = F.when(F.coalesce(F.col(hyp), F.lit("")) == "", 1.0).otherwise(value)
    return split.withColumn("wer", value).drop("__r", "__h")


def wer_summary(scored: DataFrame, keys: list[str] | None = None, cap: float | None = None, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Exact median, mean and number of scored rows; ``cap`` bounds only the aggregate.

    The scores are written out first: they are far dearer than what follows.
    """
    keys = keys or []
    value = F.col("wer") if cap is None else F.least(F.col("wer"), F.lit(float(cap)))
    scored = materialize(scored.select(*keys, "wer"), "scores")
    med = quantiles(scored, keys, value, {"median": linear(0.5)}, rows_per_task)
    mean = scored.groupBy(*keys).agg(F.avg(value).alias("mean"))
    joined = med.join(mean, keys) if keys else beside(med, mean)
    return joined.select(*keys, "n", "median", "mean")


def operations(rows: DataFrame, keep: list[str], ref: str = "ref", hyp: str = "hyp") -> DataFrame:
    """One row per alignment operation (pos, op, ref, hyp); empty texts give none.

    Python workers get small batches: a pair of words grows many times as three lists of operations."""
    bounded_batches(rows.sparkSession, "1m")
    usable = rows.where((F.coalesce(F.col(ref), F.lit("")) != "") & (F.coalesce(F.col(hyp), F.lit("")) != ""))
    ops = usable.select(*keep, F.posexplode(w.alignment(F.col(ref), F.col(hyp))).alias("pos", "o"))
    return ops.select(*keep, "pos", "o.op", "o.ref", "o.hyp")


def operation_totals(rows: DataFrame, keep: list[str], ref: str = "ref", hyp: str = "hyp") -> DataFrame:
    """Errors, reference words and hypothesis words of each pair; pairs without any word give no row."""
    usable = rows.where((F.coalesce(F.col(ref), F.lit("")) != "") & (F.coalesce(F.col(hyp), F.lit("")) != ""))
    words = usable.select(*keep, *[w.unicode_words(F.lower(F.col(c))).alias(name) for c, name in ((ref, "__r"), (hyp, "__h"))])
    counted = words.where(F.size("__r") + F.size("__h") > 0)
    sizes = [F.size(c).cast("long").alias(name) for c, name in (("__r", "ref_words"), ("__h", "hyp_words"))]
    return counted.select(*keep, w.edit_distance(F.col("__r"), F.col("__h")).cast("long").alias("errors"), *sizes)


def confusions(ops: DataFrame) -> DataFrame:
    return ops.where("op <> 'ok'").groupBy("op", "ref", "hyp").agg(F.count(F.lit(1)).alias("n"))


def run_on(rows: DataFrame, cap_s: float, keys: list[str] | None = None) -> DataFrame:
    """Clips that hit the generation ceiling, and whether they are the majority."""
    hits = F.count_if(F.col("dur_s") >= cap_s)
    return rows.groupBy(*(keys or [])).agg(
        F.count(F.lit(1)).alias("clips"), hits.alias("at_cap"), F.avg("dur_s").alias("mean_s"), (hits > F.floor(F.count(F.lit(1)) / 2)).alias("run_on")
    )


def misread_takes(rows: DataFrame, limit: float = 0.12, kinds: tuple[str, ...] = ("sentenca", "emocao", "sotaque")) -> DataFrame:
    """Scripted takes whose transcript strays from the script."""
    return score(rows.where(F.col("kind").isin(list(kinds)))).where(F.col("wer") > limit)


def codec_delta(rows: DataFrame, limit: float = 0.10, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Median WER before and after resynthesis and the verdict on their difference."""
    long = rows.select(F.explode(F.array(F.struct(F.lit("o").alias("side"), F.col("wer_original").alias("wer")), F.struct(F.lit("r").alias("side"), F.col("wer_resynth").alias("wer")))).alias("x")).select("x.*")
    med = quantiles(long, ["side"], F.col("wer"), {"m": linear(0.5)}, rows_per_task)
    both = med.agg(F.max(F.when(F.col("side") == "o", F.col("m"))).alias("original"), F.max(F.when(F.col("side") == "r", F.col("m"))).alias("resynth"), F.max("n").alias("clips"))
    delta = F.col("resynth") - F.col("original")
    return both.select("clips", "original", "resynth", delta.alias("delta"), F.when(delta < limit, "freeze").otherwise("investigate").alias("verdict"))


def leaderboard(runs: DataFrame, keys: tuple[str, ...] = ("tag",)) -> DataFrame:
    """Runs with their sort key: missing scores count as 9."""
    return runs.withColumn("sort_wer", F.coalesce("wer", F.lit(9.0))).orderBy("sort_wer", *keys)


def best_per_source(runs: DataFrame) -> DataFrame:
    score_ = F.coalesce(F.col("wer"), F.lit(9.0))
    return runs.groupBy("source").agg(F.min(score_).alias("best_wer"), F.min_by("tag", F.struct(score_, F.col("tag"))).alias("best_tag"))


def attach_metrics(per_sentence: DataFrame, similarity: DataFrame, prosody: DataFrame, keys: list[str]) -> DataFrame:
    """Speaker similarity and prosody next to each sentence; missing ones stay null."""
    return per_sentence.join(similarity, keys, "left").join(prosody, keys, "left")
