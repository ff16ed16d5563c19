"""Splits, mixtures, caps and fingerprints; all sampling ranks by a seeded md5 of the row key.

A hash rank depends on neither input order nor partitioning, so the same rows
are drawn wherever and however often a task runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vozlake.functions import license as lic
from vozlake.operators.ordered import ROWS_PER_TASK, Ordered, attach, beside, hash_bottom, pick_ranks, rank_by_text

HOLDOUT_SEED, MIX_SEED = "777", "42"


def holdout_quota(fraction: float):
    """``min(max(1, int(n * f + 0.5)), n - 1)``; nothing for fewer than two rows."""

    def quota(n: Column, _group: Column) -> Column:
        wanted = F.greatest(F.lit(1), F.floor(n * F.lit(float(fraction)) + 0.5))
        return F.when((n < 2) | F.lit(fraction <= 0), 0).otherwise(F.least(wanted, n - 1))

    return quota


def split_holdout(rows: DataFrame, fraction: float, group: str = "source", key: str = "audio", seed: str = HOLDOUT_SEED) -> DataFrame:
    """Add ``split`` (train or holdout) per source.  Cut this before any weighting."""
    marked = hash_bottom(rows, group, F.col(key), holdout_quota(fraction), seed, "__hold").drop("n")
    return marked.withColumn("split", F.when(F.col("__hold"), "holdout").otherwise("train")).drop("__hold")


def split_validation(rows: DataFrame, fraction: float = 0.03, key: str = "id", seed: str = MIX_SEED) -> DataFrame:
    """Add ``split`` (train or val) over the whole table; ``max(1, int(n * f))`` rows validate."""
    quota = lambda n, _g: F.greatest(F.lit(1), F.floor(n * F.lit(float(fraction))))
    marked = hash_bottom(rows.withColumn("__one", F.lit(1)), "__one", F.col(key), quota, seed, "__val").drop("n", "__one")
    return marked.withColumn("split", F.when(F.col("__val"), "val").otherwise("train")).drop("__val")


def weight_of(weights: dict[str, float], source: Column, default: float = 1.0) -> Column:
    """The weight of a source; sources that are not named weigh ``default``."""
    out = F.lit(float(default))
    for name, w in weights.items():
        out = F.when(source == name, float(w)).otherwise(out)
    return out


def apply_mix(rows: DataFrame, weights: dict[str, float], group: str = "source", key: str = "audio", seed: str = MIX_SEED) -> DataFrame:
    """Repeat or thin each source to ``max(1, int(n * w + 0.5))`` rows.

    Whole passes repeat every row; the remainder takes the rows with the
    smallest hash.  Adds ``pass`` and ``mix_key``; sorting by ``mix_key``
    interleaves the sources.
    """

    def used(n: Column, source: Column) -> Column:
        w = weight_of(weights, source)
        return F.when(w > 0, F.greatest(F.lit(1), F.floor(n * w + 0.5))).otherwise(0)

    marked = hash_bottom(rows, group, F.col(key), lambda n, g: used(n, g) % n, seed, "__rest")
    whole = F.floor(used(F.col("n"), F.col(group)) / F.col("n"))
    passes = (whole + F.when(F.col("__rest"), 1).otherwise(0)).cast("int")
    repeated = marked.withColumn("__p", passes).where("__p > 0").withColumn("pass", F.explode(F.sequence(F.lit(0), F.col("__p") - 1)))
    digest = F.md5(F.concat_ws("|", F.lit(f"{seed}-mix"), F.col("pass").cast("string"), F.col(group), F.col(key)))
    return repeated.withColumn("mix_key", digest).drop("__rest", "__p", "n")


def composition(mixed: DataFrame, sources: DataFrame, weights: dict[str, float], group: str = "source") -> DataFrame:
    """weight, clips and used rows per source."""
    size = sources.groupBy(group).agg(F.count(F.lit(1)).alias("clips"))
    used = mixed.groupBy(group).agg(F.count(F.lit(1)).alias("used"))
    out = size.join(used, group, "left")
    return out.select(group, weight_of(weights, F.col(group)).alias("weight"), "clips", F.coalesce("used", F.lit(0)).alias("used"))


def unknown_weights(rows: DataFrame, weights: dict[str, float], group: str = "source") -> DataFrame:
    """Names that occur on one side only: weights without source, sources without weight."""
    spark = rows.sparkSession
    named = spark.createDataFrame([(k,) for k in weights], f"{group} string").withColumn("__w", F.lit(True))
    seen = rows.select(group).distinct().withColumn("__s", F.lit(True))
    both = named.join(seen, group, "full").where("__w is null or __s is null")
    return both.select(group, F.when(F.col("__w").isNull(), "no weight").otherwise("no source").alias("problem"))


def hours_cap(rows: DataFrame, hours: float, group: str = "source", by: str = "seq", dur: str = "dur_s", rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Keep rows in order until the budget of the source is reached; the row that reaches it stays."""
    o = Ordered(rows, [group], by, rows_per_task=rows_per_task).cumsum("__before", F.col(dur), exclusive=True)
    return o.df.where(F.col("__before") < F.lit(float(hours) * 3600)).drop("__before")


def time_budget(items: DataFrame, budget_s: float, by: str = "seq", dur: str = "est_s", rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Items in order up to, not including, the one that overflows the budget."""
    o = Ordered(items, [], by, rows_per_task=rows_per_task).cumsum("__used", F.col(dur))
    return o.df.where(F.col("__used") <= F.lit(float(budget_s))).drop("__used")


def first_n(rows: DataFrame, n: int, group: str = "source", by: str = "seq") -> DataFrame:
    """The first ``n`` rows per source; map tasks drop the rest before the shuffle."""
    over = Window.partitionBy(group).orderBy(by)
    return rows.withColumn("__rn", F.row_number().over(over)).where(F.col("__rn") <= n).drop("__rn")


def extremes(rows: DataFrame, n: int = 2, text: str = "text", tie: str = "id") -> DataFrame:
    """The ``n`` shortest and ``n`` longest texts."""
    size = F.length(text)
    short = rows.orderBy(size, tie).limit(n).withColumn("end", F.lit("short"))
    return short.unionByName(rows.orderBy(size.desc(), tie).limit(n).withColumn("end", F.lit("long")))


def pick_anchors(rows: DataFrame, k: int = 3, group: str = "speaker", key: str = "audio", rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """``k`` clips per speaker spread over the clips sorted by path; replicas count once."""
    unique = rows.dropDuplicates([group, key])
    ranked = rank_by_text(unique, group, key, rows_per_task).df.withColumn("__i", F.col("__rn") - 1)
    n = F.col("__n")
    if k == 1:
        wanted = F.col("__i") == 0
    else:
        slots = [F.floor(F.lit(i) * (n - 1) / (k - 1)) for i in range(k)]
        wanted = F.when(n <= k, True).otherwise(F.col("__i").isin(slots))
    return ranked.where(wanted).withColumnRenamed("__i", "position").drop("__rn", "__n")


def leaks(train: DataFrame, holdout: DataFrame, key: str = "audio") -> DataFrame:
    """Keys present on both sides; empty when the split is clean."""
    return train.select(key).intersect(holdout.select(key))


def differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that only one of two manifests holds, with the side; empty when they are equal."""
    cols = left.columns
    a = left.exceptAll(right.select(*cols)).withColumn("side", F.lit("left"))
    return a.unionByName(right.select(*cols).exceptAll(left).withColumn("side", F.lit("right")))


def fingerprint(rows: DataFrame, columns: list[str], mode: str) -> DataFrame:
    """One row with a 16-digit fingerprint of the multiset of rows and the text mode.

    Row digests are added up in four lanes, so partial sums combine before the
    shuffle and neither row order nor partitioning matters.
    """
    digest = F.sha1(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("?")) for c in columns]))
    lane = lambda i: F.conv(F.substring("__d", 1 + 10 * i, 10), 16, 10).cast("decimal(20,0)")
    sums = rows.select(digest.alias("__d")).agg(F.count(F.lit(1)).alias("rows"), *[F.sum(lane(i)).alias(f"__s{i}") for i in range(4)])
    parts = [F.lit(mode), F.col("rows").cast("string"), *[F.coalesce(F.col(f"__s{i}").cast("string"), F.lit("0")) for i in range(4)]]
    return sums.select("rows", F.substring(F.sha1(F.concat_ws("|", *parts)), 1, 16).alias("fingerprint"))


def speaker_bucket(speaker: Column, buckets: int = 10) -> Column:
    """The 128-bit md5 of the speaker modulo ``buckets``, from its four 32-bit words."""
    digest = F.md5(speaker.cast("string"))
    out = F.lit(0).cast("long")
    for i in range(4):
        word = F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long")
        out = (out * F.lit(2**32 % buckets) + word) % F.lit(buckets)
    return out.cast("int")


def unify(sources: dict[str, DataFrame], candidates: tuple[str, ...] = ("text", "sentence", "transcript")) -> DataFrame:
    """Corpora with different text columns as one table (source, audio, text)."""
    out = None
    for name, df in sources.items():
        have = [F.when(F.col(c) != "", F.col(c)) for c in candidates if c in df.columns]
        text = F.coalesce(*have, F.lit("")) if have else F.lit("")
        one = df.select(F.lit(name).alias("source"), F.col("audio"), text.alias("text"))
        out = one if out is None else out.unionByName(one)
    return out


def shuffled_order(rows: DataFrame, key: str = "audio", seed: str = MIX_SEED) -> DataFrame:
    """Add ``mix_key``; sorting by it is a seeded shuffle that any partitioning repeats."""
    return rows.withColumn("mix_key", F.md5(F.concat_ws("|", F.lit(seed), F.col("source"), F.col(key))))


def first_rows(df: DataFrame, by: str, n: int, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """The first ``n`` rows in the order of the number ``by`` (nulls first; of equal ones any).

    The number at the cut is found on counts of equal numbers; of the rows only those that have it are ordered."""
    rows = df.withColumn("__v", F.coalesce(F.col(by).cast("double"), F.lit(float("-inf"))))
    cut = pick_ranks(rows, [], F.col("__v"), {"__cut": lambda size: F.least(F.lit(n).cast("long"), size)}, rows_per_task).select("__cut").first()
    if cut is None or cut["__cut"] is None:
        return df.limit(0)
    below, at = rows.where(F.col("__v") < F.lit(cut["__cut"])), rows.where(F.col("__v") == F.lit(cut["__cut"]))
    rest = n - below.count()
    ties = Ordered(at, [], "__v", rows_per_task=rows_per_task).row_number("__rn").df.where(F.col("__rn") <= rest).drop("__rn")
    return below.unionByName(ties).drop("__v")


def half_half(first: DataFrame, second: DataFrame, clips: int, by: str = "seq", names: tuple[str, str] = ("first", "second"), rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """The first ``clips // 2`` rows of each of two corpora (ordered by ``by``), unified, in a seeded shuffle order (``mix_key``)."""
    head = lambda df: first_rows(df, by, clips // 2, rows_per_task).drop(by)
    return shuffled_order(unify({names[0]: head(first), names[1]: head(second)}))


def references(clips: DataFrame, usable: Column, n: int = 2, group: str = "speaker", by: str = "seq", key: str = "id") -> DataFrame:
    """For each clip the first ``n`` usable clips of its speaker other than itself (column ``references``, in order)."""
    firsts = first_n(clips.where(usable), n + 1, group, by)
    held = firsts.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(by, key))).alias("__held"))
    others = F.filter(F.transform("__held", lambda c: c[key]), lambda c: c != F.col(key))
    found = F.slice(F.coalesce(others, F.array().cast(f"array<{clips.schema[key].dataType.simpleString()}>")), 1, n)
    return attach(clips, held, [group]).withColumn("references", found).drop("__held")


def corpus_hours(manifest: DataFrame) -> DataFrame:
    """Clips, hours and the shippable / research split per source and in total."""
    ships = F.coalesce(F.col("shippable"), lic.commercial_ok(F.col("license")))
    out = manifest.withColumn("__ship", ships).groupBy("source").agg(
        F.count(F.lit(1)).alias("clips"),
        F.sum(F.coalesce(F.col("dur_s"), F.lit(0.0))).alias("__s"),
        F.count_if("__ship").alias("shippable"),
        F.count_if(~F.col("__ship")).alias("research"),
    )
    total = out.agg(
        F.lit("TOTAL").alias("source"), F.sum("clips").alias("clips"), F.sum("__s").alias("__s"), F.sum("shippable").alias("shippable"), F.sum("research").alias("research")
    )
    return out.unionByName(total).select("source", "clips", F.round(F.col("__s") / 3600, 6).alias("hours"), "shippable", "research")


def estimated_hours(rows: DataFrame, share: float = 0.1, seed: int = 42, key: str = "seq", dur: str = "dur_s") -> DataFrame:
    """Hours from the mean of a seeded ``share`` of the rows, next to the exact sum."""
    draw = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.col(key))), 1, 8), 16, 10).cast("long")
    head = rows.where(draw < F.lit(int(share * 2**32))).agg(F.avg(dur).alias("__mean"))
    whole = rows.agg(F.count(F.lit(1)).alias("clips"), F.sum(dur).alias("__sum"))
    return beside(whole, head).select(
        "clips",
        F.round(F.col("__mean") * F.col("clips") / 3600, 6).alias("estimated_hours"),
        F.round(F.col("__sum") / 3600, 6).alias("exact_hours"),
    )
