"""Frame and sample tables: levels, take quality, segments, syllables and pauses.

Frames are rows (clip_id, i, ...).  Runs of frames are found with ``Ordered``,
so one very long recording is cut into slices instead of being sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vozlake.functions import signal as sg
from vozlake.functions import text as tx
from vozlake.operators.gates import some
from vozlake.operators.ordered import ROWS_PER_TASK, Ordered, attach, beside, linear, quantiles
from vozlake.session import materialize

# Segmentation.
FRAME_S, SILENCE_DB, MIN_SILENCE_S, PAD_S, MIN_SEGMENT_S, MAX_SEGMENT_S = 0.02, -42.0, 0.35, 0.15, 1.0, 20.0
TRIM_PAD_S = 0.25
# Take quality.
CLIP_LEVEL, CLIP_RATIO_MAX, SNR_MIN_DB, PEAK_LOW_DB, PEAK_HIGH_DB, MIN_TAKE_S, ROOM_DB = 0.985, 1e-4, 32.0, -24.0, -3.0, 0.6, -60.0


def frame_levels(samples: DataFrame, frame: int, clip: str = "clip_id") -> DataFrame:
    """RMS, decibels and peak per whole frame of ``frame`` samples (clip, i, x)."""
    return samples.groupBy(clip, F.floor(F.col("i") / frame).alias("frame")).agg(
        F.count(F.lit(1)).alias("samples"), sg.rms(F.col("x")).alias("rms"), F.max(F.abs("x")).alias("peak")
    ).withColumn("db", sg.db(F.col("rms")))


def clip_levels(samples: DataFrame, step: int = 1, clip: str = "clip_id") -> DataFrame:
    """Peak and RMS from all samples, or from every ``step``-th one."""
    return samples.where(F.pmod("i", F.lit(step)) == 0).groupBy(clip).agg(F.max(F.abs("x")).alias("peak"), sg.rms(F.col("x")).alias("rms"))


def take_metrics(samples: DataFrame, rate: int, clip: str = "clip_id", rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Peak, clip ratio, signal-to-noise ratio, duration and the list of issues per take.

    Noise and speech levels are the 5th and 90th percentile of 50 ms frames;
    takes shorter than four frames get a ratio of 0.
    """
    window = max(1, int(0.05 * rate))
    whole = samples.groupBy(clip).agg(
        F.count(F.lit(1)).alias("samples"), F.max(F.abs("x")).alias("peak"), F.avg((F.abs("x") >= CLIP_LEVEL).cast("int")).alias("clip_ratio")
    )
    full = frame_levels(samples, window, clip).where(F.col("samples") == window)
    levels = quantiles(full, [clip], F.col("rms"), {"noise": linear(0.05), "speech": linear(0.9)}, rows_per_task)
    joined = whole.join(levels.select(clip, "noise", "speech"), clip, "left")
    ratio = sg.db(F.col("speech")) - sg.db(F.col("noise"))
    snr = F.when(F.col("samples") >= window * 4, F.coalesce(ratio, F.lit(0.0))).otherwise(0.0)
    out = joined.withColumn("snr_db", snr).withColumn("peak_dbfs", sg.db(F.col("peak"))).withColumn("dur_s", F.col("samples") / F.lit(float(rate)))
    issues = some(
        [
            (F.col("clip_ratio") > CLIP_RATIO_MAX, "clipping"),
            (F.col("peak_dbfs") < PEAK_LOW_DB, "weak signal"),
            (F.col("peak_dbfs") > PEAK_HIGH_DB, "too hot"),
            ((F.col("snr_db") < SNR_MIN_DB) & (F.col("snr_db") > 0), "low SNR"),
            (F.col("dur_s") < MIN_TAKE_S, "too short"),
        ]
    )
    return out.withColumn("issues", issues).select(clip, "peak_dbfs", "clip_ratio", "snr_db", "dur_s", "issues")


def room_noise(samples: DataFrame, clip: str = "clip_id") -> DataFrame:
    """Noise floor of a silent recording and whether the room is quiet enough."""
    floor = sg.db(sg.rms(F.col("x")))
    return samples.groupBy(clip).agg(floor.alias("floor_db")).withColumn("quiet", F.col("floor_db") < ROOM_DB)


def qc_minutes(takes: DataFrame) -> DataFrame:
    """Minutes by style, accent, kind and in total, in one pass."""
    t = takes.select(*[F.coalesce(F.col(c), F.lit("-")).alias(c) for c in ("style", "accent", "kind")], F.coalesce("dur_s", F.lit(0.0)).alias("d"))
    style, accent, kind = F.col("style"), F.col("accent"), F.col("kind")
    out = t.groupingSets([[style], [accent], [kind], []], style, accent, kind).agg(
        F.grouping_id().alias("g"), F.count(F.lit(1)).alias("takes"), (F.sum("d") / 60).alias("minutes")
    )
    axis = F.when(F.col("g") == 3, "style").when(F.col("g") == 5, "accent").when(F.col("g") == 6, "kind").otherwise("total")
    return out.select(axis.alias("axis"), F.coalesce("style", "accent", "kind", F.lit("total")).alias("name"), "takes", "minutes")


def qc_problems(takes: DataFrame, clip: str = "clip_id") -> DataFrame:
    return takes.where(F.size("issues") > 0).select(clip, F.array_join("issues", "; ").alias("problem"))


def snr_summary(takes: DataFrame, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Median and minimum signal-to-noise ratio over takes that have one."""
    rows = takes.where(F.col("snr_db") != 0)
    med = quantiles(rows, [], F.col("snr_db"), {"median": linear(0.5)}, rows_per_task)
    return beside(med, rows.agg(F.min("snr_db").alias("lowest")))


def normalize_peak(blocks: DataFrame, peak_dbfs: float = -3.0, clip: str = "clip_id") -> DataFrame:
    """Scale the sample blocks of a clip so that its peak lands on ``peak_dbfs``; silent clips stay."""
    top = F.aggregate("samples", F.lit(0.0), lambda m, x: F.greatest(m, F.abs(x.cast("double"))))
    peaks = blocks.groupBy(clip).agg(F.max(top).alias("__peak"))
    gain = F.when(F.col("__peak") < 1e-9, 1.0).otherwise(F.lit(10 ** (peak_dbfs / 20)) / F.col("__peak"))
    scaled = F.transform("samples", lambda x: x.cast("double") * F.col("__gain"))
    return attach(blocks, peaks, [clip]).withColumn("__gain", gain).withColumn("samples", scaled).drop("__peak", "__gain")


def voiced_runs(
    frames: DataFrame, voiced: Column, gap_frames: int, clip: str = "clip_id", rows_per_task: int = ROWS_PER_TASK
) -> DataFrame:
    """Runs of voiced frames; a run ends after ``gap_frames`` silent ones.  Columns: clip, run, first, last, voiced."""
    o = Ordered(frames.where(voiced).select(clip, "i"), [clip], "i", rows_per_task=rows_per_task).lag("__prev", "i")
    new = F.col("__prev").isNull() | (F.col("i") - F.col("__prev") - 1 >= gap_frames)
    rows = o.cumsum("run", F.when(new, 1).otherwise(0)).df
    return rows.groupBy(clip, "run").agg(F.min("i").alias("first"), F.max("i").alias("last"), F.count(F.lit(1)).alias("voiced"))


def energy_segments(
    frames: DataFrame,
    clips: DataFrame,
    rate: int,
    level: str = "db",
    clip: str = "clip_id",
    rows_per_task: int = ROWS_PER_TASK,
    silence_db: float = SILENCE_DB,
) -> DataFrame:
    """Utterances as sample ranges (start, end); ``clips`` gives ``n_frames`` and ``n_samples``.

    A run that the recording cuts off before the silence limit reaches the last
    frame.  Segments under the minimum are dropped; long ones are cut.
    """
    window, gap, pad = max(1, int(FRAME_S * rate)), int(MIN_SILENCE_S / FRAME_S), int(PAD_S * rate)
    runs = voiced_runs(frames, F.col(level) > silence_db, gap, clip, rows_per_task)
    joined = runs.join(clips.select(clip, "n_frames", "n_samples"), clip)
    open_end = F.col("n_frames") - 1 - F.col("last") < gap
    stop = F.when(open_end, F.col("n_frames")).otherwise(F.col("last") + 1)
    start = F.greatest(F.lit(0), F.col("first") * window - pad)
    end = F.least(F.col("n_samples"), stop * window + pad)
    whole = joined.select(clip, start.alias("__s"), end.alias("__e")).where((F.col("__e") - F.col("__s")) / F.lit(float(rate)) >= MIN_SEGMENT_S)
    most = int(MAX_SEGMENT_S * rate)
    pieces = F.greatest(F.ceil((F.col("__e") - F.col("__s")) / F.lit(float(most))), F.lit(1)).cast("int")
    cut = whole.withColumn("__k", F.explode(F.sequence(F.lit(0), pieces - 1)))
    from_ = F.col("__s") + F.col("__k") * most
    return cut.select(clip, from_.alias("start"), F.least(from_ + most, F.col("__e")).alias("end"))


def trim_silence(
    frames: DataFrame, clips: DataFrame, rate: int, level: str = "db", clip: str = "clip_id", silence_db: float = SILENCE_DB
) -> DataFrame:
    """Sample range of a clip without silence at its ends; clips without speech stay whole."""
    window, pad = max(1, int(FRAME_S * rate)), int(TRIM_PAD_S * rate)
    ends = frames.where(F.col(level) > silence_db).groupBy(clip).agg(F.min("i").alias("__a"), F.max("i").alias("__b"))
    joined = clips.select(clip, "n_samples").join(ends, clip, "left")
    start = F.coalesce(F.greatest(F.lit(0), F.col("__a") * window - pad), F.lit(0))
    end = F.coalesce(F.least(F.col("n_samples"), (F.col("__b") + 1) * window + pad), F.col("n_samples"))
    return joined.select(clip, start.alias("start"), end.alias("end"))


def syllable_nuclei(frames: DataFrame, clip: str = "clip_id", rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Voiced intensity peaks within 4 dB of the clip maximum (clip, i, t, db, voiced).

    Two peaks are never adjacent, and after a peak the next two frames are
    skipped, so only chains of peaks two frames apart compete: of such a chain
    every second peak counts.  The peaks are written out, because they are few
    next to the frames and ordered twice.
    """
    tops = frames.where(~F.isnan("db")).groupBy(clip).agg(F.max("db").alias("__top"))
    o = Ordered(frames, [clip], "i", rows_per_task=rows_per_task).attach(tops).lag("__a", "db").lead("__b", "db")
    peak = (F.col("db") > F.col("__top") - 4.0) & (F.col("db") >= F.col("__a")) & (F.col("db") > F.col("__b"))
    found = materialize(o.df.where(peak).select(clip, "i", "t", "voiced"), "peaks")
    chain = Ordered(found, [clip], "i", rows_per_task=rows_per_task).lag("__p", "i")
    new = F.col("__p").isNull() | (F.col("i") - F.col("__p") >= 3)
    rows = chain.cumsum("__chain", F.when(new, 1).otherwise(0)).df
    counted = Ordered(rows, [clip, "__chain"], "i", rows_per_task=rows_per_task, placed=True).row_number("__k").df
    return counted.where((F.col("__k") % 2 == 1) & F.col("voiced")).select(clip, "i", "t")


def rhythm(nuclei: DataFrame, durations: DataFrame, clip: str = "clip_id", rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Speech rate and mean, longest and population spread of the gaps between nuclei; clips with two or more."""
    o = Ordered(nuclei, [clip], "t", rows_per_task=rows_per_task).lead("__next", "t")
    gap = (F.col("__next") - F.col("t")) * 1000
    per = o.df.groupBy(clip).agg(
        F.count(F.lit(1)).alias("syllables"), F.avg(gap).alias("mean_ms"), F.max(gap).alias("longest_ms"), F.stddev_pop(gap).alias("sd_ms")
    )
    out = per.where(F.col("syllables") >= 2).join(durations.select(clip, "dur_s"), clip)
    return out.withColumn("rate", F.col("syllables") / F.greatest(F.lit(0.1), F.col("dur_s")))


def silent_pauses(
    frames: DataFrame, hop_s: float, below_db: float = 25.0, min_silent_s: float = 0.3, min_sounding_s: float = 0.1,
    clip: str = "clip_id", rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Number of silent intervals per clip: short sounds join the silence around them, then short silences drop."""
    tops = frames.groupBy(clip).agg(F.max("db").alias("__top"))
    frames_ = Ordered(frames, [clip], "i", rows_per_task=rows_per_task).attach(tops)
    marked = frames_.with_column("silent", F.col("db") < F.col("__top") - below_db).drop("__top").with_column("n", F.lit(1))

    def runs(o: Ordered) -> DataFrame:
        o = o.lag("__was", "silent")
        new = F.col("__was").isNull() | (F.col("silent") != F.col("__was"))
        numbered = o.cumsum("__run", F.when(new, 1).otherwise(0)).df
        return numbered.groupBy(clip, "__run").agg(F.min("i").alias("i"), F.sum("n").alias("n"), F.first("silent").alias("silent")).drop("__run")

    first = materialize(runs(marked), "runs")
    long_enough = F.col("n") * F.lit(hop_s) >= min_sounding_s
    merged = runs(Ordered(first.withColumn("silent", F.col("silent") | ~long_enough), [clip], "i", rows_per_task=rows_per_task))
    pauses = F.count_if(F.col("silent") & (F.col("n") * F.lit(hop_s) >= min_silent_s))
    return merged.groupBy(clip).agg(pauses.alias("pauses"))


def prosody_summary(clips: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Means with one decimal and the verdict flags."""
    means = {c: tx.rounded(F.avg(c), 1).alias(c) for c in ("rate", "mean_ms", "longest_ms", "sd_ms", "pauses")}
    out = clips.groupBy(*(keys or [])).agg(F.count(F.lit(1)).alias("n"), *means.values())
    flags = some(
        [
            (F.col("rate") > 8, "too fast"),
            ((F.col("longest_ms") != 0) & (F.col("longest_ms") < 220), "short nuclear syllable"),
            (F.col("pauses") < 0.5, "hardly any pause"),
            ((F.col("sd_ms") != 0) & (F.col("sd_ms") < 40), "monotonous rhythm"),
        ]
    )
    return out.withColumn("flags", F.when(F.size(flags) == 0, F.array(F.lit("natural"))).otherwise(flags))
