"""Queries and jobs that do the whole of their work."""

from pyspark.sql import functions as F

from vozlake.plans import signals
from vozlake.streaming import jobs


def test_accent_query_grows_the_operators_trees(monkeypatch):
    given = {}
    monkeypatch.setattr(signals, "_accent_sets", lambda t: (None, None))
    monkeypatch.setattr(signals.ac, "cross_domain", lambda *sets, trees=200, **options: given.update(trees=trees))
    signals.accent_cross_domain(None)
    assert given == {"trees": 200}


def test_stage_latency_is_exact_beyond_ten_thousand_rows(spark):
    n = 300_000
    rows = spark.range(n).select(F.timestamp_seconds(F.lit(0)).alias("ts"), F.lit("asr").alias("stage"), ((F.col("id") * 7919) % n + 1).cast("double").alias("seconds"))
    got = jobs.stage_latency(rows).first()
    assert (got.n, got.p50_s, got.p95_s) == (n, n // 2, n * 95 // 100)
