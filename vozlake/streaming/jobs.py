"""Structured Streaming jobs.

Sources are file streams with ``maxFilesPerTrigger`` / ``maxBytesPerTrigger``
as the bound on a micro-batch.  Every job takes its checkpoint from the caller,
so a restarted job goes on where it stopped.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from vozlake.operators import edits as ed
from vozlake.operators.turns import TIES, Listener, Run, TurnRules, marks

WATERMARK = "10 minutes"


def file_stream(spark: SparkSession, folder: str, schema: T.StructType, glob: str | None = None, files: int | None = None, format: str = "parquet") -> DataFrame:
    reader = spark.readStream.schema(schema).format(format)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if files:
        reader = reader.option("maxFilesPerTrigger", files)
    return reader.load(folder)


def drain(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Process everything available, batch by batch, then stop."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    writer.foreachBatch(each).start().awaitTermination()


def drain_to_files(stream: DataFrame, checkpoint: str, path: str) -> None:
    """Append everything available to parquet files, exactly once."""
    writer = stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True)
    writer.format("parquet").option("path", path).start().awaitTermination()


# ---- keyed stores ----------------------------------------------------------


class DeltaStore:
    """A keyed table kept as one folder per micro-batch.

    A batch writes only its own merged rows, into a folder named after the
    batch, so a repeated batch replaces itself.  ``read`` resolves the folders;
    ``compact`` writes the resolved table to a new place.  With ``by_field``
    every field remembers the sequence number it came from, so rows that arrive
    late cannot undo newer fields.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, keys: list[str], seq: str, by_field: bool):
        self.spark, self.path, self.schema, self.keys, self.seq, self.by_field = spark, path, schema, keys, seq, by_field
        self.fields = [f.name for f in schema.fields if f.name not in (*keys, seq)]

    @staticmethod
    def _mark(field: str) -> str:
        return f"{field}__seq"

    def _stored_schema(self) -> T.StructType:
        marks = [T.StructField(self._mark(f), self.schema[self.seq].dataType) for f in self.fields] if self.by_field else []
        return T.StructType([*self.schema.fields, *marks])

    def _resolve(self, rows: DataFrame) -> DataFrame:
        """One row per key; ``rows`` carry the field marks when fields merge one by one."""
        if not self.by_field:
            return ed.last_rows(rows, self.keys, self.seq)
        newest = [F.max_by(F.col(f), F.when(F.col(f).isNotNull(), F.col(self._mark(f)))).alias(f) for f in self.fields]
        marks = [F.max(F.when(F.col(f).isNotNull(), F.col(self._mark(f)))).alias(self._mark(f)) for f in self.fields]
        return rows.groupBy(*self.keys).agg(F.max(self.seq).alias(self.seq), *newest, *marks)

    def _write(self, rows: DataFrame, path: str) -> None:
        rows.select(*self._stored_schema().names).write.mode("overwrite").parquet(path)

    def add(self, batch: DataFrame, batch_id: int) -> None:
        marks = [F.col(self.seq).alias(self._mark(f)) for f in self.fields] if self.by_field else []
        self._write(self._resolve(batch.select(*self.schema.names, *marks)), f"{self.path}/batch={batch_id}")

    def _merged(self) -> DataFrame:
        stored = self._stored_schema()
        return self._resolve(self.spark.read.schema(stored).parquet(self.path).select(*stored.names))

    def read(self) -> DataFrame:
        return self._merged().select(*self.schema.names)

    def compact(self, path: str) -> "DeltaStore":
        self._write(self._merged(), f"{path}/batch=-1")
        return DeltaStore(self.spark, path, self.schema, self.keys, self.seq, self.by_field)


def upsert_ratings(stream: DataFrame, store: DeltaStore, checkpoint: str, default_block: str = "treino-1") -> DataFrame:
    """Ratings merged field by field per (run, id); a missing block gets the default."""
    blocks = F.coalesce(F.when(F.col("block") != "", F.col("block")), F.lit(default_block))
    drain(stream.withColumn("block", blocks), checkpoint, store.add)
    return store.read()


def resolve_edits(stream: DataFrame, store: DeltaStore, checkpoint: str) -> DataFrame:
    """The last edit per id as a whole row."""
    drain(stream, checkpoint, store.add)
    return store.read()


# ---- windows ---------------------------------------------------------------


def _within(stream: DataFrame, watermark: str | None) -> DataFrame:
    """History comes in any order: without a watermark no row is late, and totals don't depend on the batches.

    A live stream sets one to bound its state, and loses what comes later than that."""
    return stream.withWatermark("ts", watermark) if watermark else stream


#: Size of a latency sketch: ranks are off by at most half a percent of the values, almost surely.
SKETCH_K = 1024


def stage_latency(stream: DataFrame, window: str = "1 hour", watermark: str | None = None, sketch: int | None = None) -> DataFrame:
    """Count, mean, p50 and p95 per window and stage (ts, stage, seconds).

    Exact for history: equal values are counted, not repeated, but all different values of a window stay in its
    state.  With ``sketch`` (its size, 8 to 65535) the state of a window is a mergeable quantile sketch of bounded
    size; a quantile is then a value whose rank is off by at most about 2.3 / sketch^0.9 of the values.
    """
    quantiles = {"p50_s": 0.5, "p95_s": 0.95}
    if sketch is None:
        kept = [F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY seconds)").alias(name) for name, p in quantiles.items()]
        shown = list(quantiles)
    else:
        kept = [F.kll_sketch_agg_double("seconds", sketch).alias("sketch")]
        shown = [F.kll_sketch_get_quantile_double("sketch", F.lit(p)).alias(name) for name, p in quantiles.items()]
    groups = _within(stream, watermark).groupBy(F.window("ts", window).alias("w"), "stage")
    return groups.agg(F.count(F.lit(1)).alias("n"), F.avg("seconds").alias("mean_s"), *kept).select(F.col("w.start").alias("start"), "stage", "n", "mean_s", *shown)


def level_meter(stream: DataFrame, window: str = "5 seconds", watermark: str | None = None) -> DataFrame:
    """Peak per channel and window (ts, channel, x)."""
    peaks = _within(stream, watermark).groupBy(F.window("ts", window).alias("w"), "channel").agg(F.max(F.abs("x")).alias("peak"))
    return peaks.select(F.col("w.start").alias("start"), "channel", "peak")


def updating(stream: DataFrame, path: str, checkpoint: str, keys: list[str]) -> DataFrame:
    """Drain an updating aggregate into batch folders and read the last value per key."""
    spark = stream.sparkSession

    def each(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("__batch", F.lit(batch_id).cast("long")).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    drain(stream, checkpoint, each, "update")
    schema = T.StructType([*stream.schema.fields, T.StructField("__batch", T.LongType())])
    rows = spark.read.schema(schema).parquet(path).select(*[f.name for f in schema.fields])
    return ed.last_rows(rows, keys, "__batch").drop("__batch")


def split_late(stream: DataFrame, path: str, checkpoint: str, ts: str = "ts", delay: str = "10 minutes") -> tuple[DataFrame, DataFrame]:
    """Sort rows into on-time and late ones: late rows lie ``delay`` behind the newest row of earlier batches."""
    spark = stream.sparkSession
    mark_schema = T.StructType([T.StructField("newest", stream.schema[ts].dataType), T.StructField("at", T.LongType())])

    def each(batch: DataFrame, batch_id: int) -> None:
        seen = batch.agg(F.max(ts).alias("newest"), F.lit(batch_id).cast("long").alias("at"))
        seen.coalesce(1).write.mode("overwrite").parquet(f"{path}/marks/batch={batch_id}")
        marks = spark.read.schema(mark_schema).parquet(f"{path}/marks").where(F.col("at") < batch_id).agg(F.max("newest").alias("__newest"))
        late = F.coalesce(F.col(ts) < F.col("__newest") - F.expr(f"interval {delay}"), F.lit(False))
        rows = batch.crossJoin(F.broadcast(marks)).withColumn("late", late).drop("__newest")
        rows.write.mode("overwrite").partitionBy("late").parquet(f"{path}/rows/batch={batch_id}")

    drain(stream, checkpoint, each)
    schema = T.StructType([*stream.schema.fields, T.StructField("late", T.BooleanType()), T.StructField("batch", T.LongType())])
    rows = spark.read.schema(schema).parquet(f"{path}/rows")
    return rows.where(~F.col("late")).drop("late"), rows.where(F.col("late")).drop("late")


def process_new_files(spark: SparkSession, folder: str, schema: T.StructType, work: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, glob: str | None = None) -> DataFrame:
    """Apply ``work`` to files not seen before; what earlier runs produced stays."""
    produced = work(file_stream(spark, folder, schema, glob))
    drain_to_files(produced, checkpoint, out)
    return spark.read.schema(produced.schema).parquet(out)


# ---- stateful operators ----------------------------------------------------

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Kept(StatefulProcessor):
    """One value per key, which goes when the watermark is ``idle`` milliseconds past the key's last row (None: it stays)."""

    def __init__(self, schema: T.StructType, idle: int | None):
        self.schema, self.idle = schema, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.value = handle, handle.getValueState("kept", self.schema)

    def keep(self, value: tuple, rows: pd.DataFrame) -> None:
        self.value.update(value)
        if self.idle is not None:
            timers, due = list(self.handle.listTimers()), int(rows["ts"].max().timestamp() * 1000) + self.idle
            if not timers or max(timers) < due:
                for timer in timers:
                    self.handle.deleteTimer(timer)
                self.handle.registerTimer(due)

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.value.clear()
        return iter(())

    def close(self) -> None:
        pass


def with_state(rows: DataFrame, key: str, processor: Kept, out: T.StructType, watermark: str) -> DataFrame:
    """Run ``processor`` over the groups of a stream; state with timers needs the store named above."""
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    clocked = rows if processor.idle is None else rows.withWatermark("ts", watermark)
    return clocked.groupBy(key).transformWithStateInPandas(processor, out, "append", "none" if processor.idle is None else "eventTime")


def in_order(rows: Iterator[pd.DataFrame], columns: Sequence[str], order: Sequence[str]) -> pd.DataFrame:
    """What a micro-batch holds of one key, sorted, with the named columns alone."""
    return pd.concat([part[list(columns)] for part in rows]).sort_values(list(order), kind="stable")


_TURN_OUT = T.StructType(
    [T.StructField("session", T.LongType()), T.StructField("first", T.LongType()), T.StructField("last", T.LongType()), T.StructField("frames", T.LongType()), T.StructField("reason", T.StringType())]
)
_LISTENER = T.StructType([*[T.StructField(name, T.LongType()) for name in ("start", "kept", "voiced", "quiet", "strong", "played")], T.StructField("cut", T.BooleanType())])


class TurnProcessor(Kept):
    def __init__(self, rules: TurnRules, names: list[str], order: list[str], idle: int | None):
        super().__init__(_LISTENER, idle)
        self.rules, self.names, self.order = rules, names, order

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        listener = Listener(*(self.value.get() or ()))
        clock = [] if self.idle is None else ["ts"]
        frames = in_order(rows, dict.fromkeys(["i", *self.order, *self.names, *clock]), self.order)
        # Plain arrays: sessions are many and short, and a grouping costs more than all else that is done for one.
        i, marked = frames["i"].to_numpy(), frames[self.names].to_numpy(bool)
        starts = np.flatnonzero(np.r_[True, (marked[1:] != marked[:-1]).any(axis=1) | (i[1:] != i[:-1] + 1)][: len(frames)])
        lengths = np.diff(np.r_[starts, len(frames)])
        heard = (listener.hear(self.rules, Run(int(first), n, *flags)) for first, n, flags in zip(i[starts], lengths.tolist(), marked[starts].tolist(), strict=True))
        out = [(key[0], *turn) for turn in heard if turn]
        self.keep((listener.start, listener.kept, listener.voiced, listener.quiet, listener.strong, listener.played, listener.cut), frames)
        yield pd.DataFrame(out, columns=_TURN_OUT.names)


def turn_stream(frames: DataFrame, rules: TurnRules = TurnRules(), ties: Sequence[str] = TIES, idle_ms: int | None = None, watermark: str = WATERMARK) -> DataFrame:
    """Finished turns of a frame stream; the open turn of a session is its state.

    Frames of a session must arrive in order across batches; inside a batch they
    are sorted here, ``ties`` settling equal numbers.  With ``idle_ms`` frames have a time ``ts``: a session whose
    last frame lies that far behind the watermark is forgotten with its open turn, and starts afresh if it comes back.
    """
    # Names that begin with an underscore don't reach a processor.
    flags = {f"mark_{name}": mark for name, mark in marks(rules).items()}
    columns = dict.fromkeys(["session", "i", *ties, *flags, *([] if idle_ms is None else ["ts"])])
    return with_state(frames.withColumns(flags).select(*columns), "session", TurnProcessor(rules, list(flags), ["i", *ties], idle_ms), _TURN_OUT, watermark)


_SENTENCE_OUT = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("seq", T.LongType()), T.StructField("sentence", T.StringType())])
_SENTENCE_STATE = T.StructType([T.StructField("buffer", T.StringType()), T.StructField("seq", T.LongType())])


class SentenceProcessor(Kept):
    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        buffer, seq = self.value.get() if self.value.exists() else ("", 0)
        pieces = in_order(rows, ["pos", "piece", "last", *([] if self.idle is None else ["ts"])], ["pos"])
        pieces["piece"] = pieces["piece"].fillna("")
        out = []
        for _, reply in pieces.groupby(pieces["last"].shift(fill_value=False).cumsum(), sort=False):
            # A reply's pieces are joined once; what follows its last mark waits, unless the reply is over.
            *closed, buffer = re.split(r"(?<=[.!?…])\s", buffer + "".join(reply["piece"]))
            if reply["last"].iloc[-1]:
                closed, buffer = [*closed, buffer], ""
            out += [sentence.strip() for sentence in closed if sentence.strip()]
        self.keep((buffer, seq + len(out)), pieces)
        yield pd.DataFrame([(key[0], k, sentence) for k, sentence in enumerate(out, seq)], columns=_SENTENCE_OUT.names)


def sentence_stream(chunks: DataFrame, idle_ms: int | None = None, watermark: str = WATERMARK) -> DataFrame:
    """Sentences as soon as they close, from text pieces (conv_id, pos, piece, last).

    A piece marked ``last`` flushes what is left of the reply.  With ``idle_ms`` pieces have a time ``ts``: a
    conversation that far behind the watermark is forgotten, with the beginning of a sentence that may be open, and
    counts from 0 if it comes back.
    """
    return with_state(chunks, "conv_id", SentenceProcessor(_SENTENCE_STATE, idle_ms), _SENTENCE_OUT, watermark)


def heard_replies(replies: DataFrame, playbacks: DataFrame, fraction: Column, cut: Callable[[Column, Column], Column], watermark: str = WATERMARK) -> DataFrame:
    """Replies (reply_id, ts, text) joined with their playback (reply_id, ts, played, total), cut to what was heard."""
    r = replies.withWatermark("ts", watermark).alias("r")
    p = playbacks.withWatermark("ts", watermark).alias("p")
    near = F.expr("r.reply_id = p.reply_id AND p.ts BETWEEN r.ts AND r.ts + interval 1 hour")
    return r.join(p, near).select(F.col("r.reply_id").alias("reply_id"), fraction.alias("fraction"), cut(F.col("r.text"), fraction).alias("text"))
