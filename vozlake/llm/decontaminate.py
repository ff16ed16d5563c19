"""Benchmark decontamination with DataFrame functions only.

A window is 13 consecutive words of a benchmark item, or all words of a shorter one.  A document
word inside an occurrence of any window is hit.

Every window of ``length`` words covers exactly one document position that is a multiple of
``length - gram + 1`` together with the ``gram`` words from there.  So a document is probed
only at those positions: the hash of the words there meets the set of all benchmark grams,
and only places that are found there are compared with the windows themselves, word by word.
No occurrence is lost, and a ninth of the positions is looked up.

The gram and window tables come from the benchmark alone.  They are broadcast up to
``broadcast_windows`` windows (counted first) and joined by shuffle beyond; the rows are the same.

Null and empty texts have no words and are never contaminated; items without words have no
windows.  Items with a null id hit words but aren't counted or listed.  Every input row gives one
row; rows with the same id and text get the same result.  Other columns are kept as they are.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vozlake.llm.common import ascii_lower, unused

WINDOW, GRAM = 13, 5
BROADCAST_WINDOWS = 500_000
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same words in a text that isn't lower-cased.
WORD_ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BREAK), "")


def gram_hash(words: Column, at: Column, gram: int) -> Column:
    return F.xxhash64(*[F.get(words, at + k) for k in range(gram)])


def windows_of(words: Column, length: int) -> Column:
    """All runs of ``length`` words, as (offset, window); words hold no blanks, so joining is exact."""
    starts = F.sequence(F.lit(0), F.size(words) - length)
    return F.when(F.size(words) >= length, F.transform(starts, lambda i: F.struct(i.alias("offset"), F.array_join(F.slice(words, i + 1, length), " ").alias("window"))))


@dataclass
class Windows:
    """The windows of a benchmark: (length, window, items), the lengths that occur, and whether they may be broadcast."""

    table: DataFrame
    lengths: list[int]
    small: bool

    def hinted(self, df: DataFrame) -> DataFrame:
        return F.broadcast(df) if self.small else df


def benchmark_windows(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", window: int = WINDOW, broadcast_windows: int = BROADCAST_WINDOWS) -> Windows:
    items = benchmark.select(F.col(f"`{item_id}`").cast("string").alias("item"), words_of(F.col(f"`{text}`")).alias("words")).where(F.size("words") > 0)
    length = F.least(F.size("words"), F.lit(window))
    starts = F.sequence(F.lit(0), F.size("words") - length)
    each = items.select("item", length.alias("length"), F.explode(F.transform(starts, lambda i: F.array_join(F.slice("words", i + 1, length), " "))).alias("window"))
    table = each.groupBy("length", "window").agg(F.collect_set("item").alias("items"))
    sizes = {r["length"]: r["n"] for r in each.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    return Windows(table, sorted(sizes), sum(sizes.values()) <= broadcast_windows)


def probes(words: Column, length: int, gram: int) -> Column:
    """(length, first, gram hash, nearby words) at every place that a window of ``length`` can't avoid.

    ``near`` starts at word ``first`` and holds every window that covers the place."""
    step = length - gram + 1

    def probe(at: Column) -> Column:
        first = F.greatest(at - (step - 1), F.lit(0))
        near = F.slice(words, first + 1, at + length - first)
        return F.struct(F.lit(length).alias("length"), first.alias("first"), gram_hash(words, at, gram).alias("gram"), near.alias("near"))

    places = F.sequence(F.lit(0), F.size(words) - gram, F.lit(step))
    return F.when(F.size(words) >= length, F.transform(places, probe)).otherwise(F.array())


def find_hits(keyed: DataFrame, windows: Windows, gram: int = GRAM) -> DataFrame:
    """All occurrences of windows in ``keyed`` (id, text_hash, words): one row each with start, end and items."""
    schema = "id, text_hash, start, end, items"
    parts = []
    for length in windows.lengths:
        size = min(gram, length)
        own = windows.table.where(F.col("length") == length)
        inside = F.sequence(F.lit(0), F.lit(length - size))
        grams = own.select(F.explode(F.transform(inside, lambda k: gram_hash(F.split("window", " "), k, size))).alias("gram")).distinct()
        near = keyed.select("id", "text_hash", F.explode(probes(F.col("words"), length, size)).alias("p")).select("id", "text_hash", "p.first", "p.gram", "p.near")
        met = near.join(windows.hinted(grams), "gram", "left_semi")
        opened = met.select("id", "text_hash", "first", F.explode(windows_of(F.col("near"), length)).alias("w"))
        opened = opened.select("id", "text_hash", (F.col("first") + F.col("w.offset")).alias("start"), "w.window")
        parts.append(opened.join(windows.hinted(own.select("window", "items")), "window").withColumn("end", F.col("start") + length).select(*schema.split(", ")))
    if not parts:
        return keyed.where(F.lit(False)).select("id", "text_hash", F.lit(0).alias("start"), F.lit(0).alias("end"), F.array(F.lit("")).alias("items"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionAll(part)
    return out


def merged(spans: Column) -> Column:
    """Sorted spans that overlap or touch, as one."""

    def add(done: Column, span: Column) -> Column:
        last = F.element_at(done, -1)
        longer = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], span["end"]).alias("end"))))
        return F.when((F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["end"] >= span["start"]), longer).otherwise(F.concat(done, F.array(span)))

    return F.aggregate(spans, F.array().cast("array<struct<start:int,end:int>>"), add)


def covered(spans: Column) -> Column:
    """How many places lie in any of the sorted spans."""

    def add(done: Column, span: Column) -> Column:
        more = F.greatest(F.lit(0), span["end"] - F.greatest(span["start"], done["upto"]))
        return F.struct((done["total"] + more).alias("total"), F.greatest(done["upto"], span["end"]).alias("upto"))

    return F.aggregate(spans, F.struct(F.lit(0).cast("long").alias("total"), F.lit(0).alias("upto")), add, lambda done: done["total"])


def measure(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, gram: int = GRAM, broadcast_windows: int = BROADCAST_WINDOWS, out: str = "contamination") -> DataFrame:
    """All rows and columns of ``docs``, and a struct ``out``: n_words, n_hit, items (sorted), spans of word numbers."""
    windows = benchmark_windows(benchmark, window=window, broadcast_windows=broadcast_windows)
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    key, number = F.col(f"`{doc_id}`"), F.xxhash64(body)
    keyed = docs.select(key.alias("id"), number.alias("text_hash"), words_of(F.col(f"`{text}`")).alias("words"))
    per_doc = (
        find_hits(keyed, windows, gram)
        .groupBy("id", "text_hash")
        .agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    )
    hash_name, id_name = unused(docs, "text_hash"), unused(docs, "hit_id")
    per_doc = per_doc.select(F.col("id").alias(id_name), F.col("text_hash").alias(f"{hash_name}_hit"), "spans", "items").select(id_name, f"{hash_name}_hit", F.struct("spans", "items").alias(unused(docs, "hits")))
    hits = F.col(unused(docs, "hits"))
    # The words' number goes into the join in place of a second reading of the text.
    n_name = unused(docs, "n")
    left = docs.withColumn(hash_name, number).withColumn(n_name, F.regexp_count(body, F.lit(WORD_ANY_CASE)).cast("long"))
    both = left.join(per_doc, F.col(f"`{doc_id}`").eqNullSafe(F.col(id_name)) & (F.col(hash_name) == F.col(f"{hash_name}_hit")), "left")
    found = F.struct(
        F.col(n_name).alias("n_words"),
        F.coalesce(covered(hits["spans"]), F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce(hits["items"], F.array().cast("array<string>")).alias("items"),
        F.coalesce(merged(hits["spans"]), F.array().cast("array<struct<start:int,end:int>>")).alias("spans"),
    )
    return both.withColumn(out, found).select(*[F.col(f"`{c}`") for c in docs.columns if c != out], out)


def contaminated(found: Column) -> Column:
    """At least a twentieth of the words are hit."""
    return (found["n_hit"] > 0) & (20 * found["n_hit"] >= found["n_words"])


def remove(docs: DataFrame, benchmark: DataFrame, mode: str = "documents", text: str = "text", **options) -> DataFrame:
    """``documents``: drop contaminated documents.  ``spans``: keep all documents and cut the hit words out of their texts."""
    mark = unused(docs, "contamination")
    found = measure(docs, benchmark, text=text, out=mark, **options)
    if mode == "documents":
        return found.where(~contaminated(F.col(mark))).drop(mark)
    if mode != "spans":
        raise ValueError(f"mode {mode!r} is neither 'documents' nor 'spans'")
    pieces = F.regexp_extract_all(F.col(f"`{text}`"), F.lit(f"({WORD_ANY_CASE}|{WORD_ANY_CASE.replace('[^', '[')})"), F.lit(1))
    # Words and the stretches between them alternate, so a word's number follows from its place.
    lead = F.when(F.col(f"`{text}`").rlike(f"^{WORD_ANY_CASE}"), 0).otherwise(1)

    def stays(piece: Column, at: Column) -> Column:
        inside = F.exists(F.col(mark)["spans"], lambda s: (s["start"] * 2 + lead <= at) & (at < s["end"] * 2 + lead))
        return ~(inside & (F.pmod(at - lead, F.lit(2)) == 0))

    cut = F.when(F.col(mark)["n_hit"] > 0, F.array_join(F.filter(pieces, stays), "")).otherwise(F.col(f"`{text}`"))
    return found.withColumn(text, cut).drop(mark)


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    mark = "found"
    found = F.col(mark)
    return measure(docs.select("doc_id", "text"), benchmark, out=mark).select(
        "doc_id",
        found["n_words"].alias("n_words"),
        found["n_hit"].alias("n_hit"),
        F.size(found["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(found["items"], ","), 256).alias("items_sha256"),
        contaminated(found).alias("contaminated"),
    )


_LETTERS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_WORDS = rf"list_filter(regexp_split_to_array(translate(coalesce(text, ''), {_LETTERS}), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS win
       FROM (SELECT *, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS win
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)),
h AS (SELECT dw.doc_id, dw.i, dw.n, iw.item_id FROM dw JOIN iw ON dw.n = iw.n AND dw.win = iw.win),
p AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS pos FROM h) GROUP BY 1),
q AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h) GROUP BY 1)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN q USING (doc_id)
"""
