"""Speaker vectors: centroids, similarities and spread."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vozlake.functions import signal as sg
from vozlake.operators.ordered import ROWS_PER_TASK, attach, linear, quantiles


def mean_vector(rows: DataFrame, keys: list[str], vector: Column) -> DataFrame:
    """Mean per dimension; partial sums are taken per dimension before the shuffle."""
    each = rows.select(*keys, F.posexplode(vector).alias("__d", "__x"))
    dims = each.groupBy(*keys, "__d").agg(F.avg(F.col("__x").cast("double")).alias("__m"))
    packed = F.sort_array(F.collect_list(F.struct("__d", "__m")))
    return dims.groupBy(*keys).agg(packed.alias("__p")).select(*keys, F.transform("__p", lambda p: p["__m"]).alias("centroid"))


def similarity(
    generated: DataFrame, references: DataFrame, key: str = "speaker", vector: str = "embedding", raw_mean: bool = False, eps: float = 0.0
) -> DataFrame:
    """Cosine of each generated clip with the unit centroid of its speaker's references.

    The centroid averages unit vectors, or the raw ones with ``raw_mean``.
    """
    base = F.col(vector) if raw_mean else F.col("__u")
    refs = references.withColumn("__u", sg.unit(F.col(vector), eps))
    centers = mean_vector(refs, [key], base)
    centers = centers.withColumn("__n", sg.norm(F.col("centroid")) + F.lit(eps)).select(key, F.transform("centroid", lambda x: x / F.col("__n")).alias("__c"))
    joined = attach(generated, centers, [key], "inner")
    return joined.withColumn("spk_sim", sg.dot(F.col("__c"), F.col(vector)) / (sg.norm(F.col(vector)) + F.lit(eps))).drop("__c")


def similarity_summary(scored: DataFrame, key: str = "speaker", rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    med = quantiles(scored, [key], F.col("spk_sim"), {"median": linear(0.5)}, rows_per_task)
    return scored.groupBy(key).agg(F.avg("spk_sim").alias("mean")).join(med, key).select(key, "n", "mean", "median")
