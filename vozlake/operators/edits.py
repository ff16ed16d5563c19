"""Edit logs: which version of a clip counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vozlake.functions.text import strip


def last_rows(log: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """The last row per key, as a whole row.  Partial maxima are taken before the shuffle."""
    rest = [c for c in log.columns if c not in keys]
    newest = F.max_by(F.struct(*rest), F.col(seq)).alias("__last")
    return log.groupBy(*keys).agg(newest).select(*keys, "__last.*")


def merge_fields(log: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """Per key and column, the last value that was given (field-wise merge)."""
    rest = [c for c in log.columns if c not in [*keys, seq]]
    newest = [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(seq))).alias(c) for c in rest]
    return log.groupBy(*keys).agg(*newest, F.max(seq).alias(seq))


def _truthy(value: Column, kind: str) -> Column:
    if kind.startswith("array"):
        return F.when(F.size(value) > 0, value)
    if kind == "string":
        return F.when(value != "", value)
    if kind == "boolean":
        return F.when(value, value)
    return F.when(value != 0, value)


def or_else(first: Column, second: Column, kind: str) -> Column:
    """``first`` when it holds something, else ``second`` when it does, else null."""
    return F.coalesce(_truthy(first, kind), _truthy(second, kind))


EXTRAS = ("estilo_nl", "emocoes", "t_start", "t_end")


def resolve(clips: DataFrame, edits: DataFrame, extras: tuple[str, ...] = EXTRAS) -> DataFrame:
    """Clips with the last edit applied.

    ``edits`` has ``has_text``: text and keep fall back to the clip only when the
    edit does not carry the field; the extra fields fall back when they are empty.
    """
    last = last_rows(edits, ["id"])
    renamed = last.select("id", *[F.col(c).alias(f"__e_{c}") for c in last.columns if c != "id"])
    joined = clips.join(renamed, "id", "left")
    text = F.when(F.coalesce(F.col("__e_has_text"), F.lit(False)), F.col("__e_text")).otherwise(F.col("text"))
    out = (
        joined.withColumn("text_orig", F.col("text"))
        .withColumn("text", strip(F.coalesce(text, F.lit(""))))
        .withColumn("keep", F.coalesce("__e_keep", F.lit(True)))
        .withColumn("flags", F.coalesce("__e_flags", F.array().cast("array<string>")))
        .withColumn("edited", F.col("__e_seq").isNotNull())
    )
    for name in extras:
        edit = F.col(f"__e_{name}") if f"__e_{name}" in joined.columns else None
        base = F.col(name) if name in clips.columns else None
        if edit is None and base is None:
            continue
        kind = dict(joined.dtypes)[f"__e_{name}" if edit is not None else name]
        null = F.lit(None).cast(kind)
        out = out.withColumn(name, or_else(edit if edit is not None else null, base if base is not None else null, kind))
    return out.drop(*[c for c in out.columns if c.startswith("__e_")])


def not_done(todo: DataFrame, done: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose key has not been processed yet."""
    return todo.join(done.select(key), key, "left_anti")


def upsert(current: DataFrame, incoming: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """Keyed merge of new rows over old ones; the row with the highest ``seq`` stays."""
    return last_rows(current.unionByName(incoming, allowMissingColumns=True), keys, seq)


def kept_table(resolved: DataFrame) -> DataFrame:
    return resolved.where("keep").select("id", "audio", "text", "dur_s")
