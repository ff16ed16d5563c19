"""Turn taking over frames: endpoints, interruptions and echo.

A frame is (session, i, prob, playing, complete): speech probability, whether
the agent is playing, and the probability that the turn is complete.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vozlake.operators.folds import walk
from vozlake.operators.ordered import ROWS_PER_TASK, Ordered


@dataclass(frozen=True)
class TurnRules:
    """A frame lasts 32 ms; limits are in whole frames."""

    frame_ms: int = 32
    speech: float = 0.5
    endpoint_ms: int = 600
    short_ms: int = 280
    min_turn_ms: int = 300
    barge_in: bool = False
    barge_prob: float = 0.85
    barge_frames: int = 8
    cooldown_s: float = 0.35
    complete: float = 0.5

    @property
    def endpoint(self) -> int:
        return max(1, self.endpoint_ms // self.frame_ms)

    @property
    def short(self) -> int:
        return max(1, self.short_ms // self.frame_ms)

    @property
    def least(self) -> int:
        return max(1, self.min_turn_ms // self.frame_ms)

    @property
    def cooldown(self) -> int:
        """Frames whose time since the end of playback is below the limit."""
        return int(-(-self.cooldown_s * 1000 // self.frame_ms))


class Run(NamedTuple):
    """Frames in a row with the same marks: ``first``, ``first + 1``, ... ``first + n - 1``."""

    first: int
    n: int
    playing: bool
    strong: bool
    speech: bool
    likely: bool


@dataclass
class Listener:
    """What is known between two runs: the open turn (its first frame, its frames, those of speech, the silence at
    its end), strong frames in a row, the last frame of playback, and whether the user cut the playback."""

    start: int | None = None
    kept: int = 0
    voiced: int = 0
    quiet: int = 0
    strong: int = 0
    played: int | None = None
    cut: bool = False

    def hear(self, rules: TurnRules, run: Run) -> tuple | None:
        """Take in a run.  A turn that ends in it is (first, last, frames, reason)."""
        if run.playing and not self.cut:
            used = self._play(rules, run)
            run = run._replace(first=run.first + used, n=run.n - used)
        if not run.n:
            return None
        self.cut = self.cut and run.playing
        if self.start is None:
            if self.played is not None:  # the echo of the playback is passed over
                echo = max(0, min(run.n, self.played + rules.cooldown + 1 - run.first))
                run = run._replace(first=run.first + echo, n=run.n - echo)
            if not run.speech or not run.n:
                return None
            self.start, self.kept, self.voiced = run.first, 0, 0
        if run.speech:
            self.kept, self.voiced, self.quiet = self.kept + run.n, self.voiced + run.n, 0
            return None
        return self._pause(rules, run)

    def _play(self, rules: TurnRules, run: Run) -> int:
        """Frames that the playback takes: all, or those up to the frame that cuts it."""
        missing = rules.barge_frames - self.strong
        if rules.barge_in and run.strong and run.n >= missing:
            used = max(1, missing)
            self.played = run.first + used - 1
            self.start, self.kept, self.voiced, self.quiet, self.strong, self.cut = self.played, 1, 1, 0, 0, True
            return used
        if rules.barge_in:
            self.strong = self.strong + run.n if run.strong else 0
        self.played = run.first + run.n - 1
        return run.n

    def _pause(self, rules: TurnRules, run: Run) -> tuple | None:
        """Silence in an open turn: it ends at a full endpoint, or earlier where the words seem complete."""
        to_end, to_short = max(1, rules.endpoint - self.quiet), rules.short - self.quiet
        early = run.likely and 1 <= to_short < to_end
        length = to_short if early else to_end
        if self.voiced < rules.least or length > run.n:
            self.kept, self.quiet = self.kept + run.n, self.quiet + run.n
            return None
        turn = (self.start, run.first + length - 1, self.kept + length, "complete" if early else "silence")
        self.start, self.kept, self.voiced, self.quiet, self.strong = None, 0, 0, 0, 0
        return turn


def marks(rules: TurnRules) -> dict[str, Column]:
    """What a run's frames have in common."""
    prob, complete = F.col("prob"), F.col("complete")
    return {
        "playing": F.coalesce("playing", F.lit(False)),
        "strong": F.coalesce(prob >= rules.barge_prob, F.lit(False)),
        "speech": F.coalesce(prob >= rules.speech, F.lit(False)),
        "likely": F.coalesce(complete > rules.complete, F.lit(False)),
    }


_TURN = T.StructType(
    [T.StructField("first", T.LongType()), T.StructField("last", T.LongType()), T.StructField("frames", T.LongType()), T.StructField("reason", T.StringType())]
)
#: Orders frames with one number; what is equal in all of them is interchangeable.
TIES = ("playing", "prob", "complete")


def turns(frames: DataFrame, rules: TurnRules = TurnRules(), session: str = "session", rows_per_task: int = ROWS_PER_TASK, ties: Sequence[str] = TIES) -> DataFrame:
    """Finished turns of recorded frames: (session, first, last, frames, reason, dur_s).

    Frames are gathered into runs with the same marks; the listener takes a run at a time.  It starts afresh
    where no turn can be open: after a run of speech that is long enough by itself and then a full
    endpoint of silence, all of it outside playback.
    """
    named = {f"__{name}": mark for name, mark in marks(rules).items()}
    o = Ordered(frames.withColumns(named), [session], "i", list(ties), rows_per_task=rows_per_task)
    o = o.with_column("__v", F.struct(*named)).lag("__w", "__v").lag("__before", "i")
    same = (F.col("__v") == F.col("__w")) & (F.col("i") == F.col("__before") + 1)
    o = o.cumsum("__r", F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1))
    runs = o.df.groupBy(session, "__r").agg(F.min("i").cast("long").alias("first"), F.count(F.lit(1)).alias("n"), *[F.bool_or(c).alias(c) for c in named])
    kind = F.when(F.col("__playing"), 2).when(F.col("__speech"), 1).otherwise(0)
    r = Ordered(runs.withColumn("__kind", kind), [session], "__r", rows_per_task=rows_per_task)
    r = r.lag("__pk", "__kind").lag("__pl", "n").lag("__pf", "first").lead("__nk", "__kind")
    after_speech = (F.col("__pk") == 1) & (F.col("__pl") >= rules.least + rules.cooldown) & (F.col("__pf") + F.col("__pl") == F.col("first"))
    settled = (F.col("__kind") == 0) & (F.col("n") >= rules.endpoint) & after_speech & (F.coalesce("__nk", F.lit(0)) != 2)
    r = r.with_column("__settled", F.when(settled, 1).otherwise(0)).cumsum("__run", F.col("__settled"), exclusive=True)

    def step(listener, values):
        listener = listener or Listener()
        return listener, listener.hear(rules, Run(*values))

    walked = walk(r.df, [session, "__run"], ["__r"], ["first", "n", *named], step, "turn", _TURN)
    done = walked.where("turn is not null").select(session, "turn.*")
    return done.withColumn("dur_s", F.col("frames") * F.lit(rules.frame_ms / 1000.0))


def barge_ins(frames: DataFrame, rules: TurnRules = TurnRules(), session: str = "session", rows_per_task: int = ROWS_PER_TASK, ties: Sequence[str] = TIES) -> DataFrame:
    """Runs of strong frames during playback that are long enough to interrupt: (session, at, frames)."""
    ties = list(ties)
    o = Ordered(frames, [session], "i", ties, rows_per_task=rows_per_task).with_column("__s", F.col("playing") & (F.col("prob") >= rules.barge_prob))
    o = o.lag("__p", "__s").cumsum("__run", F.when(F.col("__s") & ~F.coalesce("__p", F.lit(False)), 1).otherwise(0))
    runs = o.df.where("__s").groupBy(session, "__run").agg(F.min("i").alias("__a"), F.count(F.lit(1)).alias("frames"))
    nth = Ordered(o.df.where("__s").select(session, "__run", "i", *ties), [session, "__run"], "i", ties, rows_per_task=rows_per_task).row_number("__k").df
    hit = nth.where(F.col("__k") == rules.barge_frames).select(session, "__run", F.col("i").alias("at"))
    return runs.join(hit, [session, "__run"]).select(session, "at", "frames")


def outside_echo(frames: DataFrame, playbacks: DataFrame, cooldown_s: float = 0.35, session: str = "session", width: float = 5.0) -> DataFrame:
    """Frames (session, t) that lie neither in a playback nor within the cooldown after it."""
    bucket = lambda c: F.floor(c / F.lit(width))
    covered = playbacks.select(session, F.col("start").alias("__s"), (F.col("end") + cooldown_s).alias("__e"))
    covered = covered.withColumn("__b", F.explode(F.sequence(bucket(F.col("__s")), bucket(F.col("__e")))))
    f = frames.withColumn("__b", bucket(F.col("t")))
    hit = (f[session] == covered[session]) & (f["__b"] == covered["__b"]) & (f["t"] >= covered["__s"]) & (f["t"] < covered["__e"])
    return f.join(covered, hit, "left_anti").drop("__b")


def heard_fraction(played: Column, total: Column) -> Column:
    """Share of a reply that was heard; 1 when nothing was to be played."""
    return F.when(total > 0, F.least(F.lit(1.0), played / F.nullif(total, F.lit(0)))).otherwise(1.0)
