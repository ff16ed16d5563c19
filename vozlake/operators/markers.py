"""Timed markers: which phone was under a remark, and how phones are covered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vozlake.operators.ordered import ROWS_PER_TASK, nest, salted_join, shuffled
from vozlake.operators.ratings import severity
from vozlake.session import materialize


def uniform_timeline(clips: DataFrame, phones: Column, dur: str = "dur_s", clip: str = "clip_id") -> DataFrame:
    """The k-th of n phones lasts from k*d/n to (k+1)*d/n, with confidence 0.5."""
    rows = clips.select(clip, F.col(dur).alias("__d"), phones.alias("__p"))
    each = rows.select(clip, "__d", F.size("__p").alias("__n"), F.posexplode("__p").alias("pos", "phone"))
    one = F.col("__d") / F.col("__n")
    return each.select(
        clip, "pos", "phone", F.col("phone").alias("grapheme"), (F.col("pos") * one).alias("start"), ((F.col("pos") + 1) * one).alias("end"), F.lit(0.5).alias("confidence")
    )


def overlapping(markers: DataFrame, phones: DataFrame, clip: str = "clip_id", width: float = 1.0, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Pairs of marker and phone that share time, with the overlap.

    Both sides are keyed by clip and time bucket; a pair that meets in several
    buckets counts in the first one.
    """
    bucket = lambda c: F.floor(c / F.lit(width))
    m = markers.withColumn("__b", F.explode(F.sequence(bucket(F.col("t_start")), bucket(F.greatest("t_end", "t_start")))))
    p = phones.withColumn("__b", F.explode(F.sequence(bucket(F.col("start")), bucket(F.greatest("end", "start")))))
    pairs = salted_join(m, p, [clip, "__b"], [clip, "marker"], "inner", rows_per_task)
    meet = (F.col("start") < F.col("t_end")) & (F.col("end") > F.col("t_start"))
    first = F.col("__b") == F.greatest(bucket(F.col("t_start")), bucket(F.col("start")))
    shared = F.least("end", "t_end") - F.greatest("start", "t_start")
    return pairs.where(meet & first).drop("__b").withColumn("overlap", shared)


def expected_phone(markers: DataFrame, phones: DataFrame, clip: str = "clip_id", rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Markers with the phone they overlap most (the earliest of equals); none stays null."""
    pairs = overlapping(markers, phones, clip, rows_per_task=rows_per_task)
    best = F.max_by(F.struct("phone", "grapheme", "confidence"), F.struct("overlap", -F.col("start")))
    found = pairs.groupBy(clip, "marker").agg(best.alias("__best"))
    out = markers.join(shuffled(found), [clip, "marker"], "left")
    return out.select(
        *markers.columns, F.col("__best.phone").alias("expected_phoneme"), F.col("__best.grapheme").alias("expected_grapheme"), F.col("__best.confidence").alias("confidence")
    )


def enrich(
    records: DataFrame, phones: DataFrame, score: Column | None = None, clip: str = "clip_id", rows_per_task: int = ROWS_PER_TASK
) -> DataFrame:
    """Records with their markers rewritten: clamped severity, expected phone and score.

    A record with a marker that lacks ``t_start`` or ``sev`` passes through
    unchanged.  ``score`` is an expression over the marker columns; the default
    is 0.5.  Records with very many markers give several parts.
    """
    broken = F.exists("markers", lambda m: m["t_start"].isNull() | m["sev"].isNull())
    flagged = records.withColumn("__bad", F.coalesce(broken, F.lit(False)))
    good = flagged.where(~F.col("__bad"))
    each = good.select(clip, F.posexplode("markers").alias("marker", "m")).select(clip, "marker", "m.*")
    found = expected_phone(each, phones, clip, rows_per_task)
    known = F.col("expected_phoneme").isNotNull()
    item = F.struct(
        "t_start", "t_end", "tag", severity(F.col("sev")).alias("sev"), "note", "expected_phoneme", "expected_grapheme",
        F.when(known, F.round(score if score is not None else F.lit(0.5), 3)).alias("gop_score"),
    )
    lists = nest(found, [clip], "marker", item, "enriched")
    out = good.drop("__bad").join(shuffled(lists), clip, "left")
    passed = flagged.where("__bad").drop("__bad")
    return out.unionByName(passed, allowMissingColumns=True)


def phone_coverage(word_phones: DataFrame, inventory: list[str], rare_below: int = 5) -> DataFrame:
    """Counts per phone of the inventory and of any other phone; ``word_phones`` is (phones, n)."""
    # The outer form: a filter on the size of the array would move below the grouping that made the words.
    counts = word_phones.select(F.explode_outer("phones").alias("phone"), "n").where("phone is not null").groupBy("phone").agg(F.sum("n").alias("n"))
    spark = word_phones.sparkSession
    target = spark.createDataFrame([(p, True) for p in inventory], "phone string, target boolean")
    out = counts.join(F.broadcast(target), "phone", "full")
    n = F.coalesce("n", F.lit(0))
    status = F.when(F.col("target").isNull(), "outside").when(n == 0, "missing").when(n < rare_below, "rare").otherwise("covered")
    return out.select("phone", n.alias("n"), status.alias("status"))


def greedy_coverage(sentences: DataFrame, inventory: list[str], by: str = "seq", key: str = "id", seed: str = "7") -> DataFrame:
    """Order sentences so that each adds the most unseen phones; ``step`` is null once nothing is new.

    Every step adds a phone, so there are at most as many steps as phones.  Each
    step looks at the distinct phone sets only, stored as bit masks.
    """
    if len(inventory) > 63:
        raise ValueError("an inventory of more than 63 phones doesn't fit a mask")
    bit = {p: i for i, p in enumerate(inventory)}
    lookup = F.create_map(*[x for p, i in bit.items() for x in (F.lit(p), F.lit(1 << i).cast("long"))])
    # A phone counts once, however often a text has it.
    mask = F.aggregate(F.array_distinct("phones"), F.lit(0).cast("long"), lambda m, p: m.bitwiseOR(F.coalesce(F.try_element_at(lookup, p), F.lit(0).cast("long"))))
    masked = sentences.withColumn("__mask", mask)
    sets = materialize(masked.groupBy("__mask").agg(F.min(F.col(by)).alias("__first")), "phone-sets")
    chosen: list[tuple[int, int, int]] = []
    seen = 0
    while True:
        gain = F.bit_count(F.col("__mask").bitwiseAND(F.lit(~seen).cast("long")))
        best = sets.agg(F.max(F.struct(gain.alias("gain"), (-F.col("__first")).alias("neg"), F.col("__mask").alias("mask"))).alias("b")).first()
        if best is None or best.b is None or best.b.gain == 0:
            break
        chosen.append((-best.b.neg, len(chosen) + 1, best.b.gain))
        seen |= best.b.mask
    steps = sentences.sparkSession.createDataFrame(chosen, f"`{by}` long, step int, gain int")
    tail = F.md5(F.concat_ws("|", F.lit(seed), F.col(key).cast("string")))
    out = masked.drop("__mask").join(F.broadcast(steps), by, "left")
    return out.withColumn("order_key", F.when(F.col("step").isNull(), tail))


