"""The operators over the driver's tables: one query for each, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vozlake.llm import decontaminate, extract, hosts, interactions, language, ordinal, pivots, raking, secrets, simhash, tokens, toxicity, variants

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{table}.parquet")


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


@query("op1_secrets")
def op1_secrets(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.digest(read(spark, folder, "documents"))


@query("op7_decontamination", decontaminate.SQL)
def op7_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.digest(read(spark, folder, "documents"), read(spark, folder, "benchmark"))


@query("op4_simhash")
def op4_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.digest(read(spark, folder, "documents"))


@query("op9_toxicity")
def op9_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.digest(read(spark, folder, "documents"), read(spark, folder, "labels"))


@query("op8_quality")
def op8_quality(spark: SparkSession, folder: str) -> DataFrame:
    return ordinal.digest(read(spark, folder, "documents"), read(spark, folder, "labels"))


@query("op10_raking")
def op10_raking(spark: SparkSession, folder: str) -> DataFrame:
    return raking.digest(read(spark, folder, "documents"))


@query("op5_language")
def op5_language(spark: SparkSession, folder: str) -> DataFrame:
    return language.digest(read(spark, folder, "documents"))


@query("op3_hosts", hosts.SQL)
def op3_hosts(spark: SparkSession, folder: str) -> DataFrame:
    return hosts.digest(read(spark, folder, "pages"), read(spark, folder, "labels"))


@query("op6_extraction")
def op6_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return extract.digest(read(spark, folder, "pages"))


@query("op2_pivots", pivots.SQL)
def op2_pivots(spark: SparkSession, folder: str) -> DataFrame:
    return pivots.digest(read(spark, folder, "embeddings"))


@query("op11_tokens")
def op11_tokens(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.digest(read(spark, folder, "documents"))


@query("op12_variants", variants.SQL)
def op12_variants(spark: SparkSession, folder: str) -> DataFrame:
    return variants.digest(read(spark, folder, "documents"))


@query("op13_interactions", interactions.SQL)
def op13_interactions(spark: SparkSession, folder: str) -> DataFrame:
    return interactions.digest(read(spark, folder, "documents"), read(spark, folder, "labels"))
