"""Ordered work inside groups that stays spread out when one group is huge.

A plain window sends every row of a group to one task.  ``Ordered`` keeps that
plan while all groups are small.  Groups above ``rows_per_task`` are cut into
consecutive slices at approximate quantiles of the order column; the window
then runs per slice, and one summary row per slice carries the running total or
the neighbouring row across the cut.  Results are the same either way: the
cuts only decide which task does the work.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vozlake.session import materialize

ROWS_PER_TASK = 2_000_000
#: Rows that one partition of an ordered table holds on average; larger tables get more partitions, not larger ones.
ROWS_PER_PARTITION = 500_000
#: Slices of one group, and copies of one row in a salted join, at most; beyond that slices grow.
MOST_SLICES = 1 << 16
_BY, _SLICE = "__o_by", "__o_slice"


def _same(left: str, right: str, keys: Sequence[str]) -> Column:
    """Null-safe equality on all keys between two aliased frames."""
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}"))
    return cond


def hot_groups(df: DataFrame, keys: Sequence[str], rows_per_task: int = ROWS_PER_TASK) -> list[tuple[tuple, int]]:
    """Groups too large for one task, as ``[(key values, rows)]``.

    There are at most rows / ``rows_per_task`` of them, so few keys reach the driver.
    """
    return counted_groups(df, keys, rows_per_task)[0]


def counted_groups(df: DataFrame, keys: Sequence[str], rows_per_task: int) -> tuple[list[tuple[tuple, int]], int]:
    """``hot_groups``, and the number of all rows, from one pass."""
    if not keys:
        n = df.count()
        return ([((), n)] if n > rows_per_task else []), n
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    large = F.collect_list(F.when(F.col("__n") > rows_per_task, F.struct(*keys, "__n")))
    found = sizes.agg(large.alias("large"), F.coalesce(F.sum("__n"), F.lit(0)).alias("rows")).first()
    return [(tuple(r[k] for k in keys), r["__n"]) for r in found["large"]], found["rows"]


def hot_frame(df: DataFrame, keys: Sequence[str], hot: list[tuple[tuple, int]]) -> DataFrame:
    """The hot keys as a small DataFrame."""
    schema = T.StructType([T.StructField(k, df.schema[k].dataType) for k in keys] + [T.StructField("__n", T.LongType())])
    return df.sparkSession.createDataFrame([(*k, n) for k, n in hot], schema)


class Ordered:
    """Rows of ``df`` grouped by ``keys`` and ordered by ``by`` then ``ties``.

    ``by`` is a numeric column expression without nulls; ``ties`` make the order
    total.  Methods add columns and return a new ``Ordered``; ``.df`` is the result.
    The number of partitions follows the number of rows, so that a task's memory does not grow with the table;
    ``placed`` says that an ``Ordered`` over some of the keys has dealt the rows already.
    """

    def __init__(
        self,
        df: DataFrame,
        keys: Sequence[str],
        by: Column | str,
        ties: Sequence[str] = (),
        rows_per_task: int = ROWS_PER_TASK,
        placed: bool = False,
    ):
        by = F.col(by) if isinstance(by, str) else by
        self.keys = list(keys)
        self.ties = list(ties)
        self._rows = df.withColumn(_BY, by.cast("double"))
        hot, n = counted_groups(df, self.keys, rows_per_task)
        self.split = bool(hot)
        if self.split:
            self._rows = self._cut(self._rows, hot, rows_per_task)
        self._many = None
        if (self.keys or self.split) and n > ROWS_PER_PARTITION and (self.split or not placed):
            self._many = max(-(-n // ROWS_PER_PARTITION), df.sparkSession.sparkContext.defaultParallelism)
            self._rows = self._dealt(self._rows)

    def _cut(self, rows: DataFrame, hot: list[tuple[tuple, int]], rows_per_task: int) -> DataFrame:
        """Add the slice number; rows of small groups get slice -1."""
        total = sum(n for _, n in hot)
        per_slice = max(rows_per_task, total // MOST_SLICES)
        parts = {k: -(-n // per_slice) for k, n in hot}
        steps = max(parts.values())
        probs = F.split(F.lit(",".join(str(i / steps) for i in range(1, max(steps, 2)))), ",").cast("array<double>")
        accuracy = max(10_000, 10 * steps)
        if not self.keys:
            cuts = rows.agg(F.percentile_approx(_BY, probs, accuracy).alias("__o_cuts"))
            cut_rows = [tuple(r) for r in cuts.collect()]
            schema = T.StructType([T.StructField("__o_cuts", T.ArrayType(T.DoubleType()))])
        else:
            only = rows.alias("r").join(
                F.broadcast(hot_frame(rows, self.keys, hot)).alias("h"), _same("r", "h", self.keys), "left_semi"
            )
            cuts = only.groupBy(*self.keys).agg(F.percentile_approx(_BY, probs, accuracy).alias("__o_cuts"))
            cut_rows = []
            for r in cuts.collect():
                key = tuple(r[k] for k in self.keys)
                want, have = parts[key], r["__o_cuts"]
                picked = sorted({have[min(len(have) - 1, max(0, round(i * len(have) / want) - 1))] for i in range(1, want)})
                cut_rows.append((*key, picked))
            schema = T.StructType(
                [T.StructField(k, rows.schema[k].dataType) for k in self.keys]
                + [T.StructField("__o_cuts", T.ArrayType(T.DoubleType()))]
            )
        local = rows.sparkSession.createDataFrame(cut_rows, schema)
        joined = rows.alias("r").join(F.broadcast(local).alias("c"), _same("r", "c", self.keys), "left")
        slice_no = F.when(
            F.col("c.__o_cuts").isNotNull(), F.size(F.filter(F.col("c.__o_cuts"), lambda c: c < F.col(f"r.{_BY}")))
        ).otherwise(-1)
        return joined.select("r.*", slice_no.alias(_SLICE))

    def _dealt(self, rows: DataFrame) -> DataFrame:
        return rows.repartition(self._many, *self.keys, *([_SLICE] if self.split else []))

    def _with(self, rows: DataFrame) -> "Ordered":
        other = object.__new__(Ordered)
        other.keys, other.ties, other.split, other._many, other._rows = self.keys, self.ties, self.split, self._many, rows
        return other

    def _order(self) -> list[Column]:
        return [F.col(_BY), *[F.col(t) for t in self.ties]]

    def _window(self):
        parts = [*self.keys, _SLICE] if self.split else self.keys
        return Window.partitionBy(*([F.col(p) for p in parts] or [F.lit(0)])).orderBy(*self._order())

    def _slices(self, *aggs: Column) -> DataFrame:
        """One row per slice of a hot group; bounded by the number of cuts."""
        return self._rows.where(F.col(_SLICE) >= 0).groupBy(*self.keys, _SLICE).agg(*aggs)

    def _attach(self, rows: DataFrame, summary: DataFrame, cols: Sequence[str]) -> DataFrame:
        on = _same("r", "s", [*self.keys, _SLICE])
        joined = rows.alias("r").join(F.broadcast(summary).alias("s"), on, "left")
        return joined.select("r.*", *[F.col(f"s.{c}") for c in cols])

    @property
    def df(self) -> DataFrame:
        return self._rows.drop(_BY, _SLICE)

    def select(self, *cols) -> DataFrame:
        return self.df.select(*cols)

    def attach(self, small: DataFrame) -> "Ordered":
        """Add the columns of a table with one row for each group."""
        if self._many is None:
            return self._with(attach(self._rows, small, self.keys))
        # A join takes the partitions of its other side, if only that one was left to the optimizer.
        rows = attach(self._rows, small.repartition(self._many, *self.keys), self.keys)
        return self._with(self._dealt(rows) if self.split else rows)

    def with_column(self, name: str, value: Column) -> "Ordered":
        return self._with(self._rows.withColumn(name, value))

    def drop(self, *names: str) -> "Ordered":
        return self._with(self._rows.drop(*names))

    def cumsum(self, out: str, value: Column, exclusive: bool = False, total: str | None = None) -> "Ordered":
        """Running sum of ``value``; ``exclusive`` leaves the current row out."""
        zero = F.lit(0)
        frame = self._window().rowsBetween(Window.unboundedPreceding, -1 if exclusive else 0)
        rows = self._rows.withColumn(out, F.coalesce(F.sum(value).over(frame), zero))
        if not self.split:
            if total:
                whole = Window.partitionBy(*([F.col(k) for k in self.keys] or [F.lit(0)]))
                rows = rows.withColumn(total, F.sum(value).over(whole))
            return self._with(rows)
        per_slice = self._slices(F.sum(value).alias("__o_part"))
        keys = [F.col(k) for k in self.keys] or [F.lit(0)]
        before = Window.partitionBy(*keys).orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, -1)
        summary = per_slice.select(
            *self.keys,
            _SLICE,
            F.coalesce(F.sum("__o_part").over(before), zero).alias("__o_before"),
            F.sum("__o_part").over(Window.partitionBy(*keys)).alias("__o_all"),
        )
        if total:
            local = Window.partitionBy(*[F.col(k) for k in [*self.keys, _SLICE]])
            rows = rows.withColumn("__o_local", F.sum(value).over(local))
        rows = self._attach(rows, summary, ["__o_before", "__o_all"])
        rows = rows.withColumn(out, F.col(out) + F.coalesce("__o_before", zero))
        if total:
            rows = rows.withColumn(total, F.coalesce("__o_all", "__o_local")).drop("__o_local")
        return self._with(rows.drop("__o_before", "__o_all"))

    def row_number(self, out: str = "rn", total: str | None = None) -> "Ordered":
        """1-based position; optionally also the group size."""
        return self.cumsum(out, F.lit(1).cast("long"), total=total)

    def lag(self, out: str, col: Column | str) -> "Ordered":
        """The value of the previous row of the group."""
        return self._neighbour(out, col, back=True)

    def lead(self, out: str, col: Column | str) -> "Ordered":
        """The value of the next row of the group."""
        return self._neighbour(out, col, back=False)

    def _neighbour(self, out: str, col: Column | str, back: bool) -> "Ordered":
        value = F.col(col) if isinstance(col, str) else col
        window = self._window()
        near = F.lag(value).over(window) if back else F.lead(value).over(window)
        if not self.split:
            return self._with(self._rows.withColumn(out, near))
        edge = F.lag if back else F.lead
        pick = F.max_by if back else F.min_by
        order = F.struct(*self._order())
        keys = [F.col(k) for k in self.keys] or [F.lit(0)]
        over = Window.partitionBy(*keys).orderBy(_SLICE)
        summary = self._slices(pick(F.struct(value.alias("v")), order).alias("__o_edge")).select(
            *self.keys, _SLICE, edge("__o_edge").over(over).alias("__o_near")
        )
        at_cut = (F.lag(F.lit(1)) if back else F.lead(F.lit(1))).over(window).isNull()
        rows = self._rows.withColumn(out, near).withColumn("__o_cut", at_cut)
        rows = self._attach(rows, summary, ["__o_near"])
        rows = rows.withColumn(out, F.when(F.col("__o_cut"), F.col("__o_near.v")).otherwise(F.col(out)))
        return self._with(rows.drop("__o_cut", "__o_near"))

    def nth(self, out: str, col: Column | str, n: int) -> "Ordered":
        """The value of the group's row ``n``, counted from 1, on all its rows; null in shorter groups and where a key is null."""
        value = F.col(col) if isinstance(col, str) else col
        if not self.split:
            whole = self._window().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
            known = F.lit(True)
            for k in self.keys:
                known = known & F.col(k).isNotNull()
            return self._with(self._rows.withColumn(out, F.when(known, F.nth_value(value, n).over(whole))))
        numbered = self.row_number("__o_rn")._rows.where(F.col("__o_rn") == n)
        return self._with(attach(self._rows, shuffled(numbered.select(*self.keys, value.alias(out))), self.keys))

    def lags(self, out: str, col: Column | str, depth: int) -> "Ordered":
        """Array of the previous ``depth`` values, oldest first, shorter at the start of a group."""
        value = F.col(col) if isinstance(col, str) else col
        if not self.split:
            frame = self._window().rowsBetween(-depth, -1)
            return self._with(self._rows.withColumn(out, F.collect_list(value).over(frame)))
        step, names = self.with_column("__o_l0", F.struct(value.alias("v"))), []
        for i in range(1, depth + 1):
            step = step.lag(f"__o_l{i}", f"__o_l{i - 1}")
            names.insert(0, f"__o_l{i}")
        found = F.filter(F.array(*names), lambda x: x.isNotNull())
        rows = step._rows.withColumn(out, F.transform(found, lambda x: x["v"]))
        return self._with(rows.drop("__o_l0", *names))


def islands(ordered: Ordered, out: str, starts: Column) -> Ordered:
    """Number the runs of rows of each group: a new run begins wherever ``starts`` is true."""
    return ordered.cumsum(out, F.when(starts, 1).otherwise(0))


def pick_ranks(
    df: DataFrame,
    keys: Sequence[str],
    value: Column,
    picks: dict[str, Callable[[Column], Column]],
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Exact order statistics per group.

    ``picks`` maps an output name to a function from the group size to a 1-based
    rank.  Equal values are counted before anything is ordered, so ties cost one
    row, and the order itself goes through ``Ordered``.
    """
    keys = list(keys)
    counted = df.where(value.isNotNull()).groupBy(*keys, value.cast("double").alias("__v")).agg(F.count(F.lit(1)).alias("__c"))
    ranked = Ordered(counted, keys, "__v", rows_per_task=rows_per_task).cumsum("__hi", F.col("__c"), total="__n").df
    hit = {name: (F.col("__hi") - F.col("__c") < rank(F.col("__n"))) & (rank(F.col("__n")) <= F.col("__hi")) for name, rank in picks.items()}
    out = ranked.groupBy(*keys).agg(
        F.max("__n").alias("n"), *[F.max(F.when(cond, F.col("__v"))).alias(name) for name, cond in hit.items()]
    )
    return out.where(F.col("n").isNotNull())


def linear(p: float) -> tuple[Callable, Callable, Callable]:
    """Interpolated quantile at position ``p * (n - 1)``; the usual median and percentile."""

    def pos(n: Column) -> Column:
        return F.lit(float(p)) * (n - 1)

    return (
        lambda n: F.floor(pos(n)) + 1,
        lambda n: F.ceil(pos(n)) + 1,
        lambda n: pos(n) - F.floor(pos(n)),
    )


def exclusive(percent: int) -> tuple[Callable, Callable, Callable]:
    """Percentile with the exclusive rule: position ``percent * (n + 1) / 100``, kept inside the data."""

    def low(n: Column) -> Column:
        return F.least(F.greatest(F.floor(F.lit(percent) * (n + 1) / 100), F.lit(1)), F.greatest(n - 1, F.lit(1)))

    return (
        low,
        lambda n: F.least(low(n) + 1, n),
        lambda n: (F.lit(percent) * (n + 1) - low(n) * 100) / 100.0,
    )


def nth(index: Callable[[Column], Column]) -> tuple[Callable, Callable, Callable]:
    """The plain element at a 0-based index, without interpolation."""
    return (lambda n: index(n) + 1, lambda n: index(n) + 1, lambda n: F.lit(0.0))


def quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: Column,
    spec: dict[str, tuple[Callable, Callable, Callable]],
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Exact quantiles per group; one output column per entry of ``spec`` plus the size ``n``."""
    picks = {}
    for name, (lo, hi, _) in spec.items():
        picks[f"__{name}_lo"], picks[f"__{name}_hi"] = lo, hi
    got = pick_ranks(df, keys, value, picks, rows_per_task)
    cols = []
    for name, (_, _, frac) in spec.items():
        lo, hi = F.col(f"__{name}_lo"), F.col(f"__{name}_hi")
        cols.append((lo + (hi - lo) * frac(F.col("n"))).alias(name))
    return got.select(*keys, "n", *cols)


def attach(rows: DataFrame, small: DataFrame, on: Sequence[str], how: str = "left") -> DataFrame:
    """Join a per-group table to its rows.

    Nothing runs here: the optimizer sees the table's size when it is there, broadcasts a small one and
    splits the hot keys of a large one.
    """
    return rows.join(small, list(on), how)


def shuffled(rows: DataFrame) -> DataFrame:
    """``rows`` as a side of a join that is not to be broadcast.

    The optimizer takes rows made from texts or arrays for no larger than the compressed file they come from, and
    would send all of them through the driver.  Hot keys are still split by adaptive execution.
    """
    return rows.hint("merge")


def clip_partitions(clip: str, rows_per_task: int, *tables: DataFrame) -> int | None:
    """Into how many partitions tables are ``dealt`` by clip, so that they are shuffled once and joined where they lie;
    None if one of them has a clip too large for one task."""
    counts = [counted_groups(t, [clip], rows_per_task) for t in tables]
    if any(hot for hot, _ in counts):
        return None
    return max(-(-max(n for _, n in counts) // ROWS_PER_PARTITION), tables[0].sparkSession.sparkContext.defaultParallelism)


def dealt(rows: DataFrame, many: int | None, *keys: str) -> DataFrame:
    """``rows`` by their keys in ``many`` partitions; as they are without a number."""
    return rows if many is None else rows.repartition(many, *keys)


def beside(rows: DataFrame, one: DataFrame) -> DataFrame:
    """Add the values of a one-row table to every row, as literals."""
    row = one.first()
    return rows.withColumns({f.name: F.lit(row[f.name]).cast(f.dataType) for f in one.schema.fields})


def hash_bottom(
    df: DataFrame,
    group: str,
    key: Column,
    quota: Callable[[Column, Column], Column],
    seed: str,
    out: str = "selected",
) -> DataFrame:
    """Mark, per group, the ``quota`` rows with the smallest seeded hash of ``key``.

    ``key`` must identify a row.  Rows are counted per (group, hash prefix)
    before any shuffle; only the one prefix that holds the boundary is ranked,
    so no task orders a whole group.  Adds ``out`` and the group size ``n``.
    """
    digest = F.md5(F.concat_ws("|", F.lit(seed), key.cast("string")))
    rows = df.withColumn("__h", digest).withColumn("__p", F.substring("__h", 1, 4))
    counts = rows.groupBy(group, "__p").agg(F.count(F.lit(1)).alias("__c"))
    over = Window.partitionBy(group)
    stepped = counts.withColumn("__hi", F.sum("__c").over(over.orderBy("__p"))).withColumn("n", F.sum("__c").over(over))
    stepped = stepped.withColumn("__k", quota(F.col("n"), F.col(group)).cast("long"))
    at_edge = (F.col("__hi") - F.col("__c") < F.col("__k")) & (F.col("__k") <= F.col("__hi"))
    edge = stepped.groupBy(group).agg(
        F.max("n").alias("n"),
        F.max("__k").alias("__k"),
        F.max(F.when(at_edge, F.col("__p"))).alias("__p"),
        F.max(F.when(at_edge, F.col("__k") - F.col("__hi") + F.col("__c"))).alias("__need"),
    )
    near = attach(rows.select(group, "__h", "__p"), edge.select(group, "__p", "__need"), [group, "__p"], "inner")
    cut = (
        near.withColumn("__rn", F.row_number().over(Window.partitionBy(group, "__p").orderBy("__h")))
        .where(F.col("__rn") == F.col("__need"))
        .select(group, F.col("__h").alias("__cut"))
    )
    everything = F.when(F.col("__k") >= F.col("n"), F.lit("g"))
    marks = edge.join(cut, group, "left").select(group, "n", F.coalesce("__cut", everything).alias("__cut"))
    chosen = F.coalesce(F.col("__h") <= F.col("__cut"), F.lit(False))
    return attach(rows, marks, [group]).withColumn(out, chosen).drop("__h", "__p", "__cut")


def rank_by_text(rows: DataFrame, group: str, key: str, rows_per_task: int = ROWS_PER_TASK) -> "Ordered":
    """Rank (``__rn``) and size (``__n``) per group by a text key.

    The order column is a number made of the six bytes that follow the prefix
    all keys of the group share; the key itself breaks ties.
    """
    ends = rows.groupBy(group).agg(F.min(key).alias("__lo"), F.max(key).alias("__hi"))
    same = F.filter(
        F.sequence(F.lit(1), F.greatest(F.length("__lo"), F.lit(1))),
        lambda i: F.substring("__lo", F.lit(1), i) == F.substring("__hi", F.lit(1), i),
    )
    shared = ends.select(group, F.size(same).alias("__skip"))
    tail = F.encode(F.substring(key, F.col("__skip") + 1, F.lit(6)), "UTF-8")
    image = F.conv(F.rpad(F.substring(F.hex(tail), 1, 12), 12, "0"), 16, 10).cast("long")
    placed = attach(rows, shared, [group]).withColumn("__image", image).drop("__skip")
    return Ordered(placed, [group], "__image", [key], rows_per_task).row_number("__rn", total="__n").drop("__image")


def salted_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    salt_by: Sequence[str],
    how: str = "inner",
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Equi-join that spreads the hot keys of ``left``.

    Rows of a hot key get a salt; the matching rows of ``right`` are repeated
    once per salt.  The salt is a hash of ``salt_by``, columns that identify a
    row of ``left``, so a recomputed task repeats it and copies still spread.
    Neither side is broadcast.
    ``how`` is ``inner`` or ``left``.
    """
    hot = hot_groups(left, on, rows_per_task)
    if not hot:
        return left.join(shuffled(right), list(on), how)
    salts = F.least(F.ceil(F.col("__n") / F.lit(rows_per_task)), F.lit(MOST_SLICES)).cast("int")
    spread = F.broadcast(hot_frame(left, on, hot).select(*on, salts.alias("__salts")))
    pick = F.coalesce(F.pmod(F.xxhash64(*salt_by), F.col("__salts").cast("long")).cast("int"), F.lit(0))
    copies = F.explode(F.sequence(F.lit(0), F.coalesce(F.col("__salts"), F.lit(1)) - 1))
    salted = left.join(spread, list(on), "left").withColumn("__salt", pick).drop("__salts")
    copied = right.join(spread, list(on), "left").withColumn("__salt", copies).drop("__salts")
    return salted.join(shuffled(copied), [*on, "__salt"], how).drop("__salt")


def nest(df: DataFrame, keys: Sequence[str], by: Column | str, item: Column, out: str, ties: Sequence[str] = ()) -> DataFrame:
    """Collect the rows of each group into one array of ``item``, ordered by ``by``, then ``ties``, then the item itself.

    For formats that ask for an array.  A group is one row however long it is; where that must not grow,
    stay with the rows.
    """
    order = [F.col(by) if isinstance(by, str) else by, *[F.col(c) for c in ties]]
    entry = F.struct(*[c.alias(f"o{k}") for k, c in enumerate(order)], item.alias("item"))
    grouped = df.groupBy(*keys).agg(F.array_sort(F.collect_list(entry)).alias("__entries"))
    return grouped.select(*keys, F.transform("__entries", lambda e: e["item"]).alias(out))
