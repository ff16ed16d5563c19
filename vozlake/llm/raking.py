"""Mixing sources to target weights: iterative proportional fitting, then sampling by calibrated probability.

Documents fall into cells (source, language, topic).  Each cell's tokens are weighted by
``a(source) * b(language) * c(topic)``; the factors are raked in turn until the weighted tokens have the
wanted share for every source, language and topic.  The probability of a document is its cell's weight
times one scale, at most 1, with the scale chosen so that the expected tokens are ``share`` of all tokens.

Sources may be many, so they stay a table: one row per source with its counts by (language, topic).
Fitting a source's factor is local to its row, and a round sends one sum per (language, topic) to the
driver.  Languages and topics are closed sets; their product is what the driver and the plan hold.
The factor table is broadcast up to ``broadcast_sources`` sources and joined by shuffle beyond.

A null source, language or text topic is a category of its own.  Tokens are runs of anything but white
space; null and empty texts have none, weigh nothing, and are drawn with the plain share (never if no text has
tokens).  A category without tokens has no target.  The draw depends on id, text and seed alone, so repeated rows go together and
order doesn't matter.  Other columns are kept, but for those that start with the prefix, which are replaced.  An empty
table gives an empty sample.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vozlake.llm.common import materialize, unused

ROUNDS, TOLERANCE = 60, 1e-9
BROADCAST_SOURCES = 100_000
DIMENSIONS = ("source", "language", "topic")

#: Topics by what a text holds, first match wins.
TOPICS = (
    ("empty", r"^\s*$"),
    ("licence", r"(?i)\b(licen[cs]e|copyright|all rights reserved)\b"),
    ("listing", r"(\|[^|\n]*){8}"),
    ("contact", r"[A-Za-z0-9._]+@[A-Za-z0-9]+\."),
    ("marked", r"([%#$&*!]{2,}\s+\S+?){5}"),
)


def topic_of(text: Column) -> Column:
    body = F.coalesce(text, F.lit(""))
    out = F.when(body.rlike(TOPICS[0][1]), TOPICS[0][0])
    for name, pattern in TOPICS[1:]:
        out = out.when(body.rlike(pattern), name)
    return out.otherwise("prose")


def tokens_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long")


def category(value: Column) -> Column:
    """A name for every value, nulls too."""
    return F.when(value.isNull(), F.lit("null")).otherwise(F.concat(F.lit("="), value.cast("string")))


def tempered(shares: Mapping[str, float], power: float) -> dict[str, float]:
    """Shares to a power, normalised: 1 keeps them, 0 makes them even."""
    raised = {k: v**power for k, v in shares.items() if v > 0}
    total = sum(raised.values())
    return {k: v / total for k, v in raised.items()}


@dataclass
class Factors:
    """a by source as a table (source, a); b and c by name; the scale; how many sources there are."""

    sources: DataFrame
    language: dict[str, float]
    topic: dict[str, float]
    scale: float
    n_sources: int


def lookup(values: Mapping[str, float], key: Column) -> Column:
    """The value for a key out of a closed set."""
    if not values:
        return F.lit(0.0)
    pairs = F.create_map(*[F.lit(x) for pair in sorted(values.items()) for x in pair])
    return F.coalesce(F.try_element_at(pairs, key), F.lit(0.0))


def fit(cells: DataFrame, share: float, powers: Mapping[str, float], targets: Mapping[str, Mapping[str, float]] | None = None, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> Factors:
    """``cells``: source, language, topic (as category names) and tokens.

    A dimension's target shares are its own shares to its power, or what ``targets`` names for it:
    categories that ``targets`` leaves out get nothing."""
    counted = materialize(cells.groupBy(*DIMENSIONS).agg(F.sum("tokens").cast("double").alias("tokens")).where("tokens > 0"), "cells")
    inner = [(r["language"], r["topic"], r["tokens"]) for r in counted.groupBy("language", "topic").agg(F.sum("tokens").alias("tokens")).orderBy("language", "topic").collect()]
    total = sum(n for _, _, n in inner)
    languages, topics = sorted({r[0] for r in inner}), sorted({r[1] for r in inner})
    given = targets or {}

    def wanted(name: str, at: int, known: list[str]) -> np.ndarray:
        own = given.get(name) or tempered({k: sum(r[2] for r in inner if r[at] == k) / total for k in known}, powers[name])
        share_of = np.array([max(0.0, own.get(k, 0.0)) for k in known])
        return share_of / (share_of.sum() or 1.0)

    want_language, want_topic = (wanted("language", 0, languages), wanted("topic", 1, topics)) if inner else (np.zeros(0), np.zeros(0))
    number = lambda names, key: lookup({name: k for k, name in enumerate(names)}, F.col(key)).cast("int")
    rows = counted.withColumn("k", number(languages, "language") * len(topics) + number(topics, "topic"))
    by_source = rows.groupBy("source").agg(F.collect_list(F.struct("k", "tokens")).alias("cells"), F.sum("tokens").alias("own"))
    if given.get("source"):
        by_source = by_source.withColumn("want", lookup(given["source"], F.col("source")))
    else:
        by_source = by_source.withColumn("want", F.pow(F.col("own") / F.lit(total or 1.0), F.lit(powers["source"])))
    by_source = materialize(by_source, "sources")
    sums = by_source.agg(F.sum("want").alias("want"), F.count(F.lit(1)).alias("n")).first()
    whole, n_sources = sums["want"] or 1.0, sums["n"]

    b, c = np.ones(len(languages)), np.ones(len(topics))

    def weights() -> Column:
        """b times c for every (language, topic), in the order of their numbers."""
        return F.array(*[F.lit(float(x)) for x in np.outer(b, c).ravel()]) if inner else F.array(F.lit(0.0))

    def with_factor() -> DataFrame:
        """Each source's factor for the present b and c."""
        weight = weights()
        inside = F.aggregate("cells", F.lit(0.0), lambda s, x: s + x["tokens"] * F.get(weight, x["k"]))
        return by_source.withColumn("weight", weight).withColumn("a", F.when(inside > 0, F.col("want") / F.lit(whole) / inside).otherwise(0.0))

    for _ in range(rounds if inner else 0):
        sums = with_factor().select("a", "weight", F.explode("cells").alias("x")).groupBy("x.k").agg(F.sum(F.col("a") * F.col("x.tokens") * F.get("weight", F.col("x.k"))).alias("m")).collect()
        m = np.zeros((len(languages), len(topics)))
        for r in sums:
            m[divmod(r["k"], len(topics))] = r["m"]
        by_language = m.sum(axis=1)
        up = np.divide(want_language, by_language, out=np.zeros_like(b), where=by_language > 0)
        b, m = b * up, m * up[:, None]
        by_topic = m.sum(axis=0)
        off = max(np.abs(by_language - want_language).max(), np.abs(by_topic - want_topic).max())
        c = c * np.divide(want_topic, by_topic, out=np.zeros_like(c), where=by_topic > 0)
        if off < tolerance:
            break
    factors = materialize(with_factor().drop("weight"), "factors")
    weight = weights()
    each = factors.select("a", F.explode("cells").alias("x")).select(F.col("x.tokens").alias("n"), (F.col("a") * F.get(weight, F.col("x.k"))).alias("r"))
    # Solve sum n * min(1, scale * r) = share * total.  Each step fixes the cells that are full; there are finitely many.
    scale, goal = 0.0, share * total
    for _ in range(rounds if inner else 0):
        full = F.col("r") * F.lit(scale) >= 1.0
        got = each.agg(F.sum(F.when(full, F.col("n")).otherwise(0.0)).alias("full"), F.sum(F.when(full, 0.0).otherwise(F.col("n") * F.col("r"))).alias("rest")).first()
        if not got["rest"]:
            break
        after = max(scale, (goal - got["full"]) / got["rest"])
        if after <= scale * (1 + 1e-12):
            break
        scale = after
    return Factors(factors.select("source", "a"), dict(zip(languages, b.tolist(), strict=True)), dict(zip(topics, c.tolist(), strict=True)), scale, n_sources)


def draw(key: Column, text: Column, seed: int) -> Column:
    """A number in [0, 1) from id, text and seed."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), key, F.coalesce(text, F.lit(""))), 11) * F.lit(2.0**-53)


def measure(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", topic: Column | None = None, seed: int = 17, prefix: str = "mix_") -> DataFrame:
    """Add what the texts are read for: topic, tokens and the row's draw."""
    body = F.col(f"`{text}`")
    return docs.withColumns({f"{prefix}topic": topic_of(body) if topic is None else topic, f"{prefix}tokens": tokens_of(body), f"{prefix}draw": draw(F.col(f"`{doc_id}`"), body, seed)})


def weigh(
    measured: DataFrame,
    share: float = 0.5,
    powers: Mapping[str, float] | None = None,
    targets: Mapping[str, Mapping[str, float]] | None = None,
    source: str = "source",
    language: str = "lang",
    broadcast_sources: int = BROADCAST_SOURCES,
    prefix: str = "mix_",
) -> DataFrame:
    """Rake over measured rows and add weight, probability and whether the row is drawn; the draw goes."""
    topic = category(F.col(f"{prefix}topic"))
    own_source, own_language = category(F.col(f"`{source}`")), category(F.col(f"`{language}`"))
    cells = measured.select(own_source.alias("source"), own_language.alias("language"), topic.alias("topic"), F.col(f"{prefix}tokens").alias("tokens"))
    factors = fit(cells, share, {"source": 0.5, "language": 0.5, "topic": 1.0} | dict(powers or {}), targets)
    key, a = unused(measured, "mix_source"), unused(measured, "mix_factor")
    table = factors.sources.select(F.col("source").alias(key), F.col("a").alias(a))
    if factors.n_sources <= broadcast_sources:
        table = F.broadcast(table)
    weight = F.coalesce(F.col(a), F.lit(0.0)) * lookup(factors.language, own_language) * lookup(factors.topic, topic)
    out = measured.join(table, own_source == F.col(key), "left").withColumn(f"{prefix}weight", weight).drop(key, a)
    raked = F.least(F.lit(1.0), F.col(f"{prefix}weight") * F.lit(factors.scale))
    plain = F.lit(float(share) if factors.scale else 0.0)
    out = out.withColumn(f"{prefix}probability", F.when(F.col(f"{prefix}tokens") > 0, raked).otherwise(plain))
    return out.withColumn(f"{prefix}drawn", F.col(f"{prefix}draw") < F.col(f"{prefix}probability")).drop(f"{prefix}draw")


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", topic: Column | None = None, seed: int = 17, prefix: str = "mix_", **options) -> DataFrame:
    """All rows and columns of ``docs`` with the topic, tokens, weight, probability and whether the row is drawn."""
    return weigh(measure(docs, doc_id, text, topic, seed, prefix), prefix=prefix, **options)


def sample(docs: DataFrame, **options) -> DataFrame:
    """The drawn rows of ``docs`` with their columns, and the probability that each was drawn with (``mix_probability``, which replaces a column of that name)."""
    prefix = "mix_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix = f"_{prefix}"
    mixed = mix(docs, prefix=prefix, **options)
    own = [F.col(f"`{c}`") for c in docs.columns if c.lower() != "mix_probability"]
    return mixed.where(F.col(f"{prefix}drawn")).select(*own, F.col(f"{prefix}probability").alias("mix_probability"))


def digest(docs: DataFrame) -> DataFrame:
    """The texts are read once: what is measured is written without them, and all the rest works on that."""
    narrow = materialize(measure(docs).select("doc_id", "source", "lang", "mix_topic", "mix_tokens", "mix_draw"), "measured")
    return weigh(narrow).select("doc_id", "mix_topic", "mix_tokens", "mix_weight", "mix_probability", "mix_drawn")
