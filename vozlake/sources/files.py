"""Readers for JSON lines, result files, delimited transcripts and plain tables."""

from __future__ import annotations

import io
import itertools
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vozlake.functions import text as tx
from vozlake.sources.streams import open_stream

BAD = "__bad"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path or glob matches anything."""
    return bool(_glob(spark, path))


def _glob(spark: SparkSession, path: str) -> list[str]:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where)
    return [status.getPath().toString() for status in found or []]


_LINE = T.StructType([T.StructField("value", T.StringType()), T.StructField("file", T.StringType()), T.StructField("n", T.LongType())])


def _hidden_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of files whose name starts with ``_``, which Spark's own readers leave out."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file in batch["file"]:
                with io.TextIOWrapper(io.BufferedReader(open_stream(file)), encoding="utf-8") as text:
                    numbered = enumerate(text)
                    while rows := [(line.rstrip("\n"), file, n) for n, line in itertools.islice(numbered, 10_000)]:
                        yield pd.DataFrame(rows, columns=["value", "file", "n"])

    names = spark.createDataFrame([(f,) for f in _glob(spark, path)], "file string").repartition(F.col("file"))
    order = F.struct(F.col("file"), F.lit(0).cast("long"), F.col("n"))
    return names.mapInPandas(read, _LINE).select("value", "file", order.alias("line_order"))


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Non-blank lines with their file and place.

    ``line_order`` sorts lines of a file as written: block start, then the
    position inside the block.
    """
    if path.rstrip("/").rsplit("/", 1)[-1].startswith("_"):
        return _hidden_lines(spark, path).where(tx.strip(F.col("value")) != "")
    rows = spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("line_order"),
    )
    return rows.where(tx.strip(F.col("value")) != "")


def parse_lines(lines: DataFrame, schema: T.StructType) -> DataFrame:
    """Add ``row`` (the parsed struct) and ``__bad`` (the raw text when it is not valid JSON)."""
    wide = T.StructType([*schema.fields, T.StructField(BAD, T.StringType())])
    parsed = F.from_json("value", wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD})
    return lines.withColumn("row", parsed).withColumn(BAD, F.when(F.col("row").isNull(), F.col("value")).otherwise(F.col(f"row.{BAD}")))


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType, extra: tuple[str, ...] = ()) -> DataFrame:
    """JSON lines; blank lines are skipped, a broken line is an error, a missing file is an empty table.

    ``extra`` may name ``file`` and ``line_order``.
    """
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    parsed = parse_lines(_lines(spark, path), schema)
    fail = F.raise_error(F.concat(F.lit("broken line in "), F.col("file"))).cast(T.BooleanType())
    checked = parsed.where(F.when(F.col(BAD).isNull(), True).otherwise(fail))
    return checked.select(*[F.col(f"row.{f.name}").alias(f.name) for f in schema.fields], *extra)


def read_tolerant(spark: SparkSession, path: str, schema: T.StructType, extra: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(good rows, quarantined lines); also reads result files that end in a plain-text line."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema), spark.createDataFrame([], "file string, value string")
    parsed = parse_lines(_lines(spark, path), schema)
    good = parsed.where(F.col(BAD).isNull()).select(*[F.col(f"row.{f.name}").alias(f.name) for f in schema.fields], *extra)
    return good, parsed.where(F.col(BAD).isNotNull()).select("file", "value")


def read_sessions(spark: SparkSession, root: str, schema: T.StructType, sessions: list[str] | None = None, name: str = "metadata.jsonl") -> DataFrame:
    """All sessions below ``root`` (or the named ones), with the session taken from the folder."""
    rows = read_jsonl(spark, f"{root}/*/{name}", schema, ("file", "line_order")) if exists(spark, f"{root}/*/{name}") else None
    if rows is None:
        empty = T.StructType([*[f for f in schema.fields if f.name != "session"], T.StructField("session", T.StringType())])
        return spark.createDataFrame([], empty)
    out = rows.withColumn("session", F.regexp_extract("file", r"([^/]+)/[^/]+$", 1)).drop("file")
    return out if sessions is None else out.where(F.col("session").isin(sessions))


def curation_table(rows: DataFrame) -> DataFrame:
    """A landed copy of the curation table in clip terms: defaults, renames, session from the id."""
    truthy = lambda c: F.when(F.col(c) != "", F.col(c))
    return rows.select(
        "id",
        F.coalesce("usuario", F.lit("desconhecido")).alias("speaker"),
        tx.strip(F.coalesce(truthy("texto"), truthy("text_orig"), F.lit(""))).alias("text"),
        F.coalesce("manter", F.lit(True)).alias("keep"),
        F.coalesce("flags", F.array().cast("array<string>")).alias("flags"),
        "dur_s",
        "audio",
        tx.session_of_segment(F.col("id")).alias("session"),
    )


def jdbc_table(spark: SparkSession, url: str, table: str, column: str, lower: int, upper: int, partitions: int, properties: dict[str, str] | None = None) -> DataFrame:
    """A database table read in ``partitions`` ranges of a numeric column."""
    return spark.read.jdbc(url, table, column=column, lowerBound=lower, upperBound=upper, numPartitions=partitions, properties=properties or {})


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """Dataset registry: a flat list of ``- nome:`` items with ``key: value`` lines below."""
    text = spark.read.text(path, wholetext=True)
    items = text.select(F.posexplode(F.slice(F.split("value", r"(?m)^- nome:"), 2, F.lit(2**31 - 1))).alias("seq", "item"))
    unquote = lambda c: F.regexp_replace(tx.strip(c), '^"+|"+$', "")
    lines = F.regexp_extract_all("item", F.lit(r"(?m)^(\s+\w+:.*)$"), F.lit(1))
    pairs = F.transform(lines, lambda l: F.struct(tx.strip(F.substring_index(l, ":", 1)).alias("k"), unquote(F.regexp_replace(l, r"^[^:]*:", "")).alias("v")))
    field = lambda name: F.get(F.filter("pairs", lambda p: p["k"] == name), F.size(F.filter("pairs", lambda p: p["k"] == name)) - 1)["v"]
    rows = items.withColumn("pairs", pairs).withColumn("nome", unquote(F.regexp_extract("item", r"^([^\n]*)", 1)))
    names = ("horas", "tipo", "sotaque", "licenca", "tier", "camada", "shippable", "obs")
    return rows.select("seq", "nome", *[field(n).alias(n) for n in names])


def read_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Parquet or CSV with a header, by extension."""
    if path.rstrip("/").endswith(".parquet"):
        return spark.read.schema(schema).parquet(path)
    return spark.read.csv(path, header=True, schema=schema)


def read_results(spark: SparkSession, glob: str, schema: T.StructType) -> DataFrame:
    """One JSON document per file (an object or a list); unreadable files are skipped, ``run`` is the folder."""
    wide = T.StructType([*schema.fields, T.StructField(BAD, T.StringType())])
    rows = spark.read.schema(wide).option("multiLine", True).option("columnNameOfCorruptRecord", BAD).json(glob)
    run = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1)
    return rows.withColumn("run", run).where(F.col(BAD).isNull()).drop(BAD)


def read_benchmark(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A frozen sentence set keyed by id; the last line of an id wins."""
    from vozlake.operators.edits import last_rows

    return last_rows(read_jsonl(spark, path, schema, ("line_order",)), ["id"], "line_order").drop("line_order")


def base_name(path: Column | str) -> Column:
    """File name without folder and extension."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"\.[^.]*$", "")
