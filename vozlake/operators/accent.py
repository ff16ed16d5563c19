"""Accent score card: normalised formants, cross-domain classification and error direction."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vozlake.operators.ordered import ROWS_PER_PARTITION, ROWS_PER_TASK, Ordered, attach, beside
from vozlake.session import materialize

# Features, plausible ranges and the phone pairs under test.
FEATURES = ["F1_z", "F2_z", "F3_z", "B1_Hz", "duration_ms"]
RANGES = {"B1_Hz": (0, 400), "F1_Hz": (150, 1100), "F2_Hz": (500, 3200), "F3_Hz": (1800, 4200)}
CONTRASTS = {"mid_e": {"open": "ɛ", "closed": "e"}, "mid_o": {"open": "ɔ", "closed": "o"}}
FORMANTS = ("F1", "F2", "F3")
#: Models that are fitted side by side: planning, growing trees on the driver and short jobs of one leave cores to the others.
FITS_AT_ONCE = 4
#: Tables of more rows are dealt evenly over all cores before they are fitted.
ROWS_BEFORE_DEALING = 20_000


def plausible(rows: DataFrame) -> DataFrame:
    """Rows whose formants lie in range; ranges of columns that are absent do not apply."""
    tests = [F.col("F1_Hz").isNotNull()] + [F.col(c).between(lo, hi) for c, (lo, hi) in RANGES.items() if c in rows.columns]
    return rows.where(reduce(lambda a, b: a & b, tests))


def _scores(rows: DataFrame, stats: DataFrame, keys: list[str]) -> DataFrame:
    joined = attach(rows, stats, keys) if keys else beside(rows, stats)
    for f in FORMANTS:
        spread = F.coalesce(F.when(F.col(f"__sd_{f}") != 0, F.col(f"__sd_{f}")), F.when(F.col(f"__sd_{f}") == 0, F.lit(1e-6)))
        joined = joined.withColumn(f"{f}_z", (F.col(f"{f}_Hz") - F.col(f"__mu_{f}")) / spread)
    return joined.drop(*[f"__{s}_{f}" for s in ("mu", "sd") for f in FORMANTS])


def _moments() -> list[Column]:
    return [a for f in FORMANTS for a in (F.avg(f"{f}_Hz").alias(f"__mu_{f}"), F.stddev_samp(f"{f}_Hz").alias(f"__sd_{f}"))]


def by_speaker(rows: DataFrame, speaker: str = "speaker_id") -> DataFrame:
    """z-scores per speaker with the sample spread; a spread of 0 counts as 1e-6."""
    return _scores(rows, rows.groupBy(speaker).agg(*_moments()), [speaker])


def overall(rows: DataFrame) -> DataFrame:
    """z-scores over all rows (a synthetic voice is one speaker)."""
    return _scores(rows, rows.agg(*_moments()), [])


def labelled(rows: DataFrame) -> DataFrame:
    """Add ``label`` (open = 1) and a weight that balances the two classes."""
    out = rows.withColumn("label", (F.col("aperture") == "open").cast("double"))
    sizes = out.groupBy("label").agg(F.count(F.lit(1)).alias("__c"))
    whole = sizes.agg(F.sum("__c").alias("__t"), F.count(F.lit(1)).alias("__k"))
    weights = beside(sizes, whole).select("label", (F.col("__t") / (F.col("__k") * F.col("__c"))).alias("weight"))
    return out.join(F.broadcast(weights), "label")


def models(forest: bool = True, trees: int = 200) -> dict[str, object]:
    """Logistic regression (ridge, C = 1) and a random forest, both on balanced classes."""
    out = {"LR": LogisticRegression(featuresCol="scaled", weightCol="weight", elasticNetParam=0.0, maxIter=100, standardization=False)}
    if forest:
        out["RF"] = RandomForestClassifier(featuresCol="scaled", weightCol="weight", numTrees=trees, maxDepth=8, minInstancesPerNode=5, seed=42)
    return out


def fit(rows: DataFrame, model):
    """Scale, then fit.  Weights are balanced and add up to the rows, so C = 1 is a ridge of one over their number."""
    if isinstance(model, LogisticRegression):
        model = model.copy({model.regParam: 1.0 / max(1, rows.count())})
    stages = [VectorAssembler(inputCols=FEATURES, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="scaled", withMean=True, withStd=True), model]
    return Pipeline(stages=stages).fit(rows)


def confusion(predicted: DataFrame) -> DataFrame:
    """One count ``c`` per (label, prediction)."""
    return predicted.groupBy("label", "prediction").agg(F.count(F.lit(1)).alias("c"))


def _mean_f1() -> Column:
    cell = lambda a, b: F.sum(F.when((F.col("label") == a) & (F.col("prediction") == b), F.col("c")).otherwise(0))
    tp, fp, fn, tn = cell(1, 1), cell(0, 1), cell(1, 0), cell(0, 0)
    one = lambda t: F.when(2 * t + fp + fn > 0, 2.0 * t / (2 * t + fp + fn)).otherwise(0.0)
    return ((one(tp) + one(tn)) / 2).alias("macro_f1")


def macro_f1(predicted: DataFrame) -> DataFrame:
    """Mean F1 of the two classes from one count per (label, prediction)."""
    return confusion(predicted).agg(_mean_f1())


def _counted(name: str, train: DataFrame, model, test: str, rows: DataFrame) -> list[tuple]:
    """Fit on ``train`` and count the predictions for ``rows``: (name, test, label, prediction, count), four at most."""
    return [(name, test, *r) for r in confusion(fit(train, model).transform(rows)).collect()]


def _side_by_side(spark: SparkSession, jobs: list) -> list:
    """What the ``jobs`` return, in their order; ``FITS_AT_ONCE`` of them run at a time."""
    pool = ThreadPool(FITS_AT_ONCE)
    try:
        return pool.map(lambda job: job(), [inheritable_thread_target(spark)(job) for job in jobs], chunksize=1)
    finally:
        pool.terminate()


def class_sizes(rows: DataFrame) -> list[int]:
    return [r["count"] for r in rows.groupBy("label").count().collect()]


def evenly(rows: DataFrame, n: int) -> DataFrame:
    """Deal a large training table of ``n`` rows over all cores: by speaker or by class it would keep few of them busy.

    Rows are ordered inside a partition, so that the samples of the trees don't depend on the order of arrival."""
    if n <= ROWS_BEFORE_DEALING:
        return rows
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, -(-n // ROWS_PER_PARTITION))
    return rows.repartition(parts).sortWithinPartitions(*FEATURES, "label", "fold")


def row_folds(rows: DataFrame, row_id: str, folds: int, label: str = "label", rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Add ``fold``: the rows of each class dealt in turn, in a scattered order, so that folds differ by one row a class."""
    scattered = F.xxhash64(F.col(row_id).cast("string"))
    numbered = Ordered(rows, [label], scattered, [row_id], rows_per_task).row_number("__rn").df
    return numbered.withColumn("fold", ((F.col("__rn") - 1) % folds).cast("int")).drop("__rn")


def _deal(folds: int):
    """Speakers come with the most rows of class 1 first.  Each ``folds`` of them go to different folds, the one with
    the most rows of class 0 to the fold that has the fewest: then neither class differs by more than one speaker's rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, waiting = np.zeros(folds, np.int64), None
        for batch in batches:
            waiting = batch if waiting is None else pd.concat([waiting, batch])
            whole = len(waiting) // folds * folds
            yield dealt(waiting.iloc[:whole], held)
            waiting = waiting.iloc[whole:]
        if waiting is not None:
            yield dealt(waiting, held)

    def dealt(speakers: pd.DataFrame, held: np.ndarray) -> pd.DataFrame:
        other = speakers["zeros"].to_numpy()
        fold = np.zeros(len(speakers), np.int32)
        for at in range(0, len(speakers), folds):
            group = at + np.argsort(-other[at : at + folds], kind="stable")
            takes = np.argsort(held, kind="stable")[: len(group)]
            fold[group], held[takes] = takes, held[takes] + other[group]
        return speakers[[speakers.columns[0]]].assign(fold=fold)

    return run


def speaker_folds(rows: DataFrame, folds: int, speaker: str = "speaker_id", label: str = "label") -> DataFrame:
    """Add ``fold``, the same for all rows of a speaker; each class is spread evenly, up to one speaker's rows.

    One row a speaker passes through one sorted stream, which remembers ``folds`` numbers."""
    ones = F.sum((F.col(label) == 1).cast("long"))
    counted = rows.groupBy(speaker).agg(ones.alias("ones"), (F.count(F.lit(1)) - ones).alias("zeros"))
    order = [F.desc("ones"), F.desc("zeros"), F.md5(F.col(speaker).cast("string"))]
    stream = counted.repartition(1).sortWithinPartitions(*order)
    schema = T.StructType([counted.schema[speaker], T.StructField("fold", T.IntegerType())])
    dealt = attach(rows, materialize(stream.mapInPandas(_deal(folds), schema), "folds"), [speaker])
    return dealt.withColumn("fold", F.coalesce("fold", F.lit(0)))


def cross_domain(human: DataFrame, tts: DataFrame, row_id: str, speaker: str = "speaker_id", folds: int = 5, forest: bool = True, trees: int = 200) -> DataFrame:
    """Macro-F1 of human→human (folds by speaker), human→tts, tts→tts (folds by row) and tts→human.

    Each fold is predicted by a model that was fitted on the others; the counts of all folds make one score."""
    spark = human.sparkSession
    h, t = labelled(human), labelled(tts)
    voices = h.select(speaker).distinct().limit(folds).count()
    human_sizes, tts_sizes = class_sizes(h), class_sizes(t)
    by_voice, by_row = min(folds, max(2, voices)), min(folds, max(2, min(tts_sizes, default=0)))
    h = evenly(speaker_folds(h, by_voice, speaker), sum(human_sizes)).cache()
    t = evenly(row_folds(t, row_id, by_row), sum(tts_sizes)).cache()
    h.count(), t.count()
    jobs, scored = [], models(forest, trees)
    for name, model in reversed(scored.items()):
        whole = [(h, "HtoTTS", t), (t, "TTStoH", h)]
        parts = [(rows.where(F.col("fold") != k), test, rows.where(F.col("fold") == k)) for test, rows, n in (("HH", h, by_voice), ("TTStoTTS", t, by_row)) for k in range(n)]
        jobs += [partial(_counted, name, train, model.copy(), test, rows) for train, test, rows in whole + parts]
    counts = [row for rows in _side_by_side(spark, jobs) for row in rows]
    h.unpersist(), t.unpersist()
    counted = spark.createDataFrame(counts, "model string, test string, label double, prediction double, c long")
    f1 = {(r.model, r.test): r.macro_f1 for r in counted.groupBy("model", "test").agg(_mean_f1()).collect()}
    rows = [(name, test, f1.get((name, test), 0.0)) for name in scored for test in ("HH", "HtoTTS", "TTStoTTS", "TTStoH")]
    return spark.createDataFrame(rows, "model string, test string, macro_f1 double")


def error_direction(human: DataFrame, tts: DataFrame) -> DataFrame:
    """Which way a synthetic voice errs: overall, per vowel, and as open / closed rates."""
    model = fit(labelled(human), models(False)["LR"])
    got = model.transform(labelled(tts))
    wrong = (F.col("label") != F.col("prediction")).cast("int")
    rate = lambda gold, pred: F.sum(((F.col("label") == gold) & (F.col("prediction") == pred)).cast("int")) / F.greatest(F.lit(1), F.sum((F.col("label") == gold).cast("int")))
    out = got.rollup("vowel_label").agg(F.count(F.lit(1)).alias("n"), F.avg(wrong).alias("mismatch"), rate(0, 1).alias("over_open"), rate(1, 0).alias("over_close"))
    return out.withColumn("vowel_label", F.coalesce("vowel_label", F.lit("ALL")))
