"""Table functions for SQL: alignment operations of word lists, and the splitting of long segments.

    register(spark)
    SELECT t.id, o.* FROM pairs t, LATERAL word_operations(t.ref_words, t.hyp_words) o
    SELECT * FROM split_segments(TABLE(segments) PARTITION BY clip_id ORDER BY (start), 20.0D)
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from vozlake.functions.wer import word_operations


@udtf(returnType="pos int, op string, ref string, hyp string")
class WordOperations:
    """One row per operation of a shortest alignment; nothing where either list is null or empty."""

    def eval(self, ref: list[str], hyp: list[str]) -> Iterator[tuple]:
        if ref and hyp:
            yield from ((k, *step) for k, step in enumerate(zip(*word_operations(list(ref), list(hyp)), strict=True)))


class _Splitter:
    """Segments of one clip, numbered in order; one that is longer than ``longest`` is cut every ``longest`` seconds."""

    def __init__(self):
        self.n = 0

    @staticmethod
    def analyze(segments: AnalyzeArgument, longest: AnalyzeArgument) -> AnalyzeResult:
        names = [f.name for f in segments.dataType.fields]
        if not {"clip_id", "start", "end"} <= set(names):
            raise ValueError("segments need the columns clip_id, start and end")
        schema = T.StructType([segments.dataType["clip_id"], T.StructField("n", T.IntegerType()), *[T.StructField(c, T.DoubleType()) for c in ("start", "end")]])
        return AnalyzeResult(schema)

    def eval(self, row: Row, longest: float) -> Iterator[tuple]:
        start, end = float(row["start"]), float(row["end"])
        parts = max(1, math.ceil((end - start) / longest))
        for k in range(parts):
            self.n += 1
            yield row["clip_id"], self.n, start + k * longest, min(start + (k + 1) * longest, end)


SplitSegments = udtf(_Splitter)


def register(spark: SparkSession) -> None:
    spark.udtf.register("word_operations", WordOperations)
    spark.udtf.register("split_segments", SplitSegments)
