"""Latencies and speed: exact percentiles against a budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vozlake.functions.text import sentences
from vozlake.operators.ordered import ROWS_PER_TASK, exclusive, linear, nth, quantiles


def summarize(rows: DataFrame, keys: list[str], seconds: Column, budget_ms: float = 800.0, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """p50 (true median), p95 (element int(0.95 n)) and whether the median is within budget."""
    near = lambda n: F.least(n - 1, F.floor(F.lit(0.95) * n))
    got = quantiles(rows, keys, seconds * 1000, {"p50_ms": linear(0.5), "p95_ms": nth(near)}, rows_per_task)
    return got.withColumn("pass", F.col("p50_ms") < budget_ms)


def real_time_factor(generation_s: Column, audio_s: Column) -> Column:
    """Generation over audio seconds; infinite without audio."""
    return F.when(audio_s > 0, generation_s / F.nullif(audio_s, F.lit(0.0))).otherwise(F.lit(float("inf")))


def endpoint_percentiles(rows: DataFrame, keys: list[str], seconds: Column, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Percentiles by the exclusive rule (p50, p95)."""
    return quantiles(rows, keys, seconds, {"p50": exclusive(50), "p95": exclusive(95)}, rows_per_task)


def reply_bench(replies: DataFrame, keys: list[str], seconds: Column, text: Column, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Percentiles of the reply times (exclusive rule) and the mean number of sentences of a reply."""
    means = replies.groupBy(*keys).agg(F.avg(F.size(sentences(text))).alias("sentences"))
    return endpoint_percentiles(replies, keys, seconds, rows_per_task).join(means, keys)


def cascade_floor(rows: DataFrame, stages: list[str], keys: list[str], target_ms: float = 800.0, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Median per stage and of their sum, as long rows (stage, p50_ms, within)."""
    total = sum((F.col(s) for s in stages[1:]), F.col(stages[0]))
    parts = F.array(*[F.struct(F.lit(s).alias("stage"), F.col(s).alias("v")) for s in stages], F.struct(F.lit("total").alias("stage"), total.alias("v")))
    long = rows.select(*keys, F.explode(parts).alias("x")).select(*keys, "x.*")
    got = quantiles(long, [*keys, "stage"], F.col("v") * 1000, {"p50_ms": linear(0.5)}, rows_per_task)
    return got.withColumn("within", F.when(F.col("stage") == "total", F.col("p50_ms") < target_ms))
