"""Audio files as tables: where they are, how long they are, which text belongs to them.

Only headers are read.  File contents never enter a plan: the listing selects
path and size, and a task opens each file and seeks from chunk to chunk.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from typing import BinaryIO

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vozlake.functions import text as tx
from vozlake.sources.files import base_name
from vozlake.sources.streams import open_file


def listing(spark: SparkSession, root: str, glob: str = "*.wav") -> DataFrame:
    """Paths and sizes below ``root``; no content is read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(root)
    return files.select("path", "length")


#: Sizes of this value stand in the ds64 chunk of a file beyond 4 GB.
ELSEWHERE = 0xFFFFFFFF


def wav_header(stream: BinaryIO) -> tuple[int, int, int]:
    """(sample rate, channels, frames) of a RIFF or RF64 wave file; reads chunk heads only, wherever they lie."""
    head = stream.read(12)
    if head[:4] not in (b"RIFF", b"RF64") or head[8:12] != b"WAVE":
        raise ValueError("not a wave file")
    rate = channels = align = large = 0
    while len(head := stream.read(8)) == 8:
        name, size = head[:4], struct.unpack("<I", head[4:])[0]
        after = stream.tell() + size + size % 2
        if name == b"ds64":
            large = struct.unpack("<8xQ", stream.read(16))[0]
        elif name == b"fmt ":
            channels, rate, _, align = struct.unpack("<HIIH", stream.read(14)[2:])
        elif name == b"data":
            if not rate or not align:
                raise ValueError("no format")
            return rate, channels, (large if size == ELSEWHERE and large else size) // align
        stream.seek(after)
    raise ValueError("no data")


_HEAD = T.StructType(
    [T.StructField("path", T.StringType()), T.StructField("sr", T.IntegerType()), T.StructField("channels", T.IntegerType()), T.StructField("frames", T.LongType()), T.StructField("problem", T.StringType())]
)


def headers(files: DataFrame) -> DataFrame:
    """(path, sr, channels, frames, problem) of every file; ``problem`` says why a header can't be read.

    A file that can't be opened fails the task, so that Spark tries again; only the file's own content makes a problem.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path in batch["path"]:
                with open_file(path) as stream:
                    try:
                        rows.append((path, *wav_header(stream), None))
                    except (ValueError, struct.error) as problem:
                        rows.append((path, None, None, None, str(problem)))
            yield pd.DataFrame(rows, columns=["path", "sr", "channels", "frames", "problem"]).astype({"sr": "Int32", "channels": "Int32", "frames": "Int64"})

    return files.select("path").repartition(F.col("path")).mapInPandas(read, _HEAD)


def inventory(files: DataFrame) -> DataFrame:
    """(path, sr, channels, frames, dur_s) of the readable files."""
    return headers(files).where("problem is null and sr > 0").drop("problem").withColumn("dur_s", F.col("frames") / F.col("sr"))


def unreadable(files: DataFrame) -> DataFrame:
    """(path, reason) of the files that ``inventory`` leaves out."""
    bad = headers(files).where("problem is not null or sr <= 0")
    return bad.select("path", F.coalesce("problem", F.lit("no sample rate")).alias("reason"))


def run_files(files: DataFrame, root_depth: int = 2) -> DataFrame:
    """One row per generated file with its run (the folder below the root) and id (the file name)."""
    run = F.regexp_extract("path", rf"([^/]+)/(?:[^/]+/){{{root_depth - 2}}}[^/]+$", 1)
    return files.select(run.alias("run"), base_name("path").alias("id"), F.col("path").alias("wav"))


def transcripts(spark: SparkSession, globs: list[str], least: int = 50) -> DataFrame:
    """(wav, text) from the first transcript file, by path length, that has more than ``least`` valid lines.

    The separator is ``==`` if any line of the file has it, else ``|``.
    """
    lines = spark.read.text(globs).select(F.col("_metadata.file_path").alias("file"), tx.strip(F.col("value")).alias("line"))

    shows = lambda mark: F.bool_or(F.instr("line", mark) > 0)
    seps = lines.groupBy("file").agg(F.when(shows("=="), "==").when(shows("|"), "|").alias("sep")).where("sep is not null")
    joined = lines.join(seps, "file").where(F.instr("line", F.col("sep")) > 0)
    at = F.instr("line", F.col("sep"))
    wav = base_name(tx.strip(F.substring("line", F.lit(1), at - 1)))
    text = F.regexp_replace(tx.strip(F.substring("line", at + F.length("sep"), F.length("line"))), '^"+|"+$', "")
    rows = joined.select("file", wav.alias("wav"), text.alias("text")).where("wav <> '' and text <> ''")
    counts = rows.groupBy("file").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > least)
    chosen = counts.agg(F.min_by("file", F.struct(F.length("file"), "file")).alias("file"))
    return rows.join(F.broadcast(chosen), "file", "left_semi").select("wav", "text")


def with_audio(texts: DataFrame, files: DataFrame) -> DataFrame:
    """Transcripts joined with audio by file name."""
    return texts.join(files.select("path", base_name("path").alias("wav")), "wav")


def resolve_paths(rows: DataFrame, files: DataFrame, folder: str) -> DataFrame:
    """Add ``path``: ``folder/audio`` when that file exists, else ``folder/segments/name``, else null.

    An absolute ``audio`` stands for itself.
    """
    known = files.select(F.regexp_replace("path", "^file:(//)?", "").alias("path")).distinct()
    base = folder.rstrip("/")
    direct = F.when(F.col("audio").startswith("/"), F.col("audio")).otherwise(F.concat(F.lit(base + "/"), "audio"))
    named = F.when(~F.col("audio").startswith("/"), F.concat(F.lit(base + "/segments/"), F.regexp_extract("audio", r"([^/]*)$", 1)))
    wanted = rows.withColumn("__a", direct).withColumn("__b", named)
    a = known.select(F.col("path").alias("__a"), F.col("path").alias("__pa"))
    b = known.select(F.col("path").alias("__b"), F.col("path").alias("__pb"))
    joined = wanted.join(a, "__a", "left").join(b, "__b", "left")
    return joined.withColumn("path", F.coalesce("__pa", "__pb")).drop("__a", "__b", "__pa", "__pb")


def load_rows(rows: DataFrame, files: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """(usable rows, misses): a usable row has text and an audio file."""
    resolved = resolve_paths(rows.withColumn("text", tx.strip(F.coalesce("text", F.lit("")))), files, folder)
    usable = F.col("path").isNotNull() & (F.col("text") != "")
    return resolved.where(usable).withColumn("audio", F.col("path")).drop("path"), resolved.where(~usable).drop("path")


def missing_audio(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Manifest rows whose audio file name is not in the listing."""
    return manifest.withColumn("wav", base_name("audio")).join(files.select(base_name("path").alias("wav")), "wav", "left_anti").drop("wav")
