"""Sinks: training files, reports and keyed appends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vozlake.functions import text as tx
from vozlake.functions.license import commercial_ok
from vozlake.operators.gates import assert_licenses
from vozlake.sinks.json_array import write_json_array
from vozlake.sources.files import base_name


def write_train(gated: DataFrame, path: str, speaker: str = "speaker", key: str = "id") -> None:
    """Kept and rejected rows as JSON lines per speaker, ordered by (speaker, id).

    A range partitioning on both columns keeps the order and gives a large
    speaker several files.
    """
    ordered = lambda df: df.repartitionByRange(speaker, key).sortWithinPartitions(speaker, key)
    kept = gated.where("reason is null").drop("dur_s", "reason", "keep", "flags")
    rejects = gated.where("reason is not null").select(speaker, key, F.col("reason").alias("motivo"), "text", "dur_s", "flags")
    ordered(kept).write.mode("overwrite").partitionBy(speaker).json(f"{path}/train")
    ordered(rejects).write.mode("overwrite").partitionBy(speaker).json(f"{path}/rejects")


def write_formats(rows: DataFrame, path: str, formats: list[str], by: str = "seq") -> None:
    """One split in several training formats.

    ``canonical`` JSON lines; ``csm`` one JSON array of turns without sound events; ``orpheus`` JSON lines
    with the control prefix; ``ljspeech`` lines ``name|text``.
    """
    prefixed = F.concat(tx.style_prefix(F.col("style"), F.col("accent")), "text")
    if "canonical" in formats:
        rows.drop(by).write.mode("overwrite").json(f"{path}/canonical")
    if "csm" in formats:
        talk = rows.where(F.coalesce(F.col("kind"), F.lit("")) != "paralinguistico")
        item = F.struct(F.lit(0).alias("speaker"), prefixed.alias("text"), F.col("audio"))
        write_json_array(talk, item, f"{path}/csm", [by, "audio"])
    if "orpheus" in formats:
        rows.select("audio", prefixed.alias("text")).write.mode("overwrite").json(f"{path}/orpheus")
    if "ljspeech" in formats:
        line = F.concat_ws("|", base_name("audio"), F.regexp_replace("text", r"\s*\n\s*", " "))
        rows.select(line.alias("value")).write.mode("overwrite").text(f"{path}/ljspeech")


def write_conversations(rows: DataFrame, path: str, by: str = "seq") -> None:
    """Conversations of one segment each: one array of one-element arrays."""
    item = F.array(F.struct("text", F.col("audio").alias("audio_path"), F.lit(0).alias("speaker")))
    write_json_array(rows, item, path, [by, "audio"])


def write_licensed(manifest: DataFrame, path: str, mode: str = "research") -> dict:
    """Write a manifest through the licence gate and return a report of what was written.

    In ``commercial`` mode a row that may not be shipped, in ``research`` mode a row that may not be used at all,
    raises an error and nothing is committed.  Research rows that may not be shipped are marked ``research_only``.
    The report holds rows, seconds, sources, research_only rows and the least source among these.  It is counted
    on the written table: an observation would leave the session in a state that Spark ML models can't ship.
    """
    marked = assert_licenses(manifest, mode).withColumn("research_only", ~commercial_ok(F.col("license")))
    marked.write.mode("overwrite").parquet(path)
    only = F.col("research_only")
    return manifest.sparkSession.read.schema(marked.schema).parquet(path).agg(
        F.count(F.lit(1)).alias("rows"), F.sum("dur_s").alias("seconds"), F.count_if(only).alias("research_only"),
        F.min(F.when(only, F.col("source"))).alias("research_only_source"), F.array_sort(F.collect_set("source")).alias("sources"),
    ).first().asDict()


def append_unseen(rows: DataFrame, path: str, key: str = "path") -> None:
    """Append rows whose key the target does not hold yet (the target may be missing)."""
    from vozlake.sources.files import exists

    fresh = rows.dropDuplicates([key])
    if exists(rows.sparkSession, path):
        held = rows.sparkSession.read.schema(rows.schema).parquet(path).select(key)
        fresh = fresh.join(held, key, "left_anti")
    fresh.write.mode("append").parquet(path)


def long_report(section: str, rows: DataFrame, key: Column, metrics: list[str]) -> DataFrame:
    """Report lines (section, key, metric, value)."""
    values = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])
    return rows.select(F.lit(section).alias("section"), key.alias("key"), F.explode(values).alias("x")).select("section", "key", "x.*")


def write_report(lines: DataFrame, path: str) -> None:
    """Report lines as text, ordered by section, key and metric; numbers with four decimals, ``-`` for none."""
    value = F.when(F.col("value").isNull(), "-").otherwise(F.format_string("%.4f", "value"))
    text = F.concat_ws(" | ", "section", F.coalesce("key", F.lit("-")), "metric", value)
    lines.orderBy("section", "key", "metric").select(text.alias("value")).write.mode("overwrite").text(path)


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """The lines of a written report; a key may hold bars."""
    parts = lambda k: F.regexp_extract("value", r"^(.*?) \| (.*) \| (.*?) \| (\S+)$", k)
    number = F.when(parts(4) != "-", parts(4).cast("double"))
    return spark.read.text(path).select(parts(1).alias("section"), parts(2).alias("key"), parts(3).alias("metric"), number.alias("value"))
