"""Secret scan: keyword automaton, anchored patterns near its hits, checksums inside tokens.

One pass of an Aho-Corasick automaton over the lower-cased text finds all keywords of all rules.
A rule's pattern is only tried at the places where one of its keywords starts, so the cost of a
text without keywords doesn't depend on the number of rules.  Runs of hexadecimal digits have no
keyword: every run of 32 covers two neighbouring places of a grid of step 16, so the text is probed
on that grid and only runs around such probes are measured.  Tokens with an embedded checksum
count only if it holds.

Null and empty texts have no spans.  Positions count code points; ends are exclusive.  Every row
is scanned on its own, so ties, repeated rows and other columns don't matter.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vozlake.llm.common import bounded_batches

MARK = "[secret]"
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
STEP = 16
LONGEST_KEYWORD = 16
ASCII_LOWER = {upper: upper + 32 for upper in range(65, 91)}
SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def checksum62(body: str) -> str:
    """CRC-32 of the body in base 62, six digits, as such tokens carry it at their end."""
    value, digits = zlib.crc32(body.encode()), ""
    for _ in range(6):
        value, digit = divmod(value, 62)
        digits = BASE62[digit] + digits
    return digits


@dataclass(frozen=True)
class Rule:
    """``pattern`` is tried where a keyword starts; ``keep`` decides on a match."""

    kind: str
    keywords: tuple[str, ...]
    pattern: str
    keep: Callable[[re.Match], bool]


def sums_up(match: re.Match) -> bool:
    return checksum62(match[1][:-6]) == match[1][-6:]


#: The base rules' patterns and least lengths; the token formats are public.
RULES = (
    Rule("assign", ("password", "passwd", "secret", "token", "api_key", "apikey"), r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 8),
    Rule("access", ("akia",), r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 16),
    Rule("hex", (), r"[0-9a-f]+", lambda m: len(m[0]) >= 32),
    Rule("github", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), r"gh[pousr]_([A-Za-z0-9]{36})(?![A-Za-z0-9])", sums_up),
    Rule("npm", ("npm_",), r"npm_([A-Za-z0-9]{36})(?![A-Za-z0-9])", sums_up),
)
KINDS = tuple(rule.kind for rule in RULES)
BASE = ("assign", "access", "hex")


@cache
def automaton():
    import ahocorasick

    made = ahocorasick.Automaton()
    users: dict[str, list[int]] = {}
    for number, rule in enumerate(RULES):
        for word in rule.keywords:
            users.setdefault(word, []).append(number)
    for word, numbers in users.items():
        made.add_word(word, (len(word), tuple(numbers)))
    made.make_automaton()
    return made, [re.compile(rule.pattern, re.ASCII) for rule in RULES]


HEX_PROBES = re.compile("[0-9a-f]{2,}")
HEX_RUN = re.compile("[0-9a-f]+")
HEX_DIGITS = "0123456789abcdef"


def hex_runs(text: str) -> Iterator[re.Match]:
    """Whole runs of hexadecimal digits around two neighbouring probes, from left to right."""
    done = 0
    for probes in HEX_PROBES.finditer(text[STEP - 1 :: STEP]):
        for probe in range(probes.start(), probes.end() - 1):
            at = STEP * (probe + 1) - 1
            if at < done:
                continue
            # A run that also covers the probe to the left was met there.
            before = text[max(done, at - STEP + 1) : at]
            run = HEX_RUN.match(text, at - len(before) + len(before.rstrip(HEX_DIGITS)))
            done = run.end()
            yield run


def find_spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end), by start and then by the order of the rules."""
    if not text:
        return []
    made, patterns = automaton()
    lower = text.lower()
    if len(lower) != len(text):
        lower = text.translate(ASCII_LOWER)
    hits: dict[int, set[int]] = {}
    for last, (length, numbers) in made.iter(lower):
        for number in numbers:
            hits.setdefault(number, set()).add(last - length + 1)
    found = [(run.start(), KINDS.index("hex"), run.end()) for run in hex_runs(text) if RULES[KINDS.index("hex")].keep(run)]
    for number, starts in hits.items():
        free = 0
        for start in sorted(starts):
            if start >= free and (match := patterns[number].match(text, start)):
                free = match.end()
                if RULES[number].keep(match):
                    found.append((start, number, free))
    return [(KINDS[number], start, end) for start, number, end in sorted(found)]


def masked(text: str | None) -> str | None:
    """The text with each stretch of overlapping secrets replaced by a mark."""
    out, at = [], 0
    for _, start, end in find_spans(text):
        if start >= at:
            out += [text[at:start], MARK]
        at = max(at, end)
    return text if not out else "".join(out) + text[at:]


@F.pandas_udf(SPANS)
def _spans(texts: pd.Series) -> pd.Series:
    return texts.map(lambda text: [{"kind": k, "start": s, "end": e} for k, s, e in find_spans(text)], na_action=None)


@F.pandas_udf(T.StringType())
def _masked(texts: pd.Series) -> pd.Series:
    return texts.map(masked, na_action=None)


def scan(df: DataFrame, text: str = "text", out: str = "secret_spans") -> DataFrame:
    """Add all secrets of each whole text as an array of (kind, start, end)."""
    bounded_batches(df.sparkSession)
    return df.withColumn(out, _spans(F.col(f"`{text}`")))


def redact(df: DataFrame, text: str = "text") -> DataFrame:
    """The same rows with secrets masked in the text; null texts stay null."""
    bounded_batches(df.sparkSession)
    return df.withColumn(text, _masked(F.col(f"`{text}`")))


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def digest(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: the key, counts and a hash of the base spans, and all spans as text."""
    spans = F.col("spans")
    base = F.filter(spans, lambda s: s["kind"].isin(*BASE))
    rows = scan(df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("body")), "body", "spans")
    counts = lambda kinds: [count_of(spans, kind).alias(f"n_{kind}") for kind in kinds]
    return rows.select(F.col("key").alias(key), *counts(BASE), F.sha2(listed(base), 256).alias("base_sha256"), listed(spans).alias("spans"), *counts(k for k in KINDS if k not in BASE))
