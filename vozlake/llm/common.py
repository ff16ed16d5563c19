"""Small helpers that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vozlake.session import bounded_batches, materialize

__all__ = ["ascii_lower", "bounded_batches", "in_fold", "materialize", "only", "unused"]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else.

    ``lower`` is much faster than ``translate`` and does the same where every other
    character is left alone by it, so ``translate`` only sees the other texts.
    """
    other = F.regexp_replace(text, r"[\x00-\x7F]+", "")
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).when(F.lower(other) == other, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def in_fold(key: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the key's text falls into ``fold``; a null key is in no fold."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % folds == fold, F.lit(False))


def unused(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` doesn't have, in any case."""
    taken, name = {c.lower() for c in df.columns}, f"_{stem}"
    while name.lower() in taken:
        name = f"_{name}"
    return name


def only(df: DataFrame, *columns: str) -> DataFrame:
    """These columns alone, quoted, so that dots in other names do no harm."""
    return df.select(*[F.col(f"`{c}`") for c in columns])
