"""The text front-end: one choice, applied the same way to training and evaluation text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vozlake.functions.numbers import verbalized
from vozlake.functions.text import strip
from vozlake.functions.wer import let

# Spellings whose pronunciation the rules get wrong.
DEFAULT_LEXICON = {
    "poxa": "poʃa",
    "sesc": "se.ski",
    "ia": "i.a",
    "rato": "χato",
    "porta": "poχta",
    "mar": "maχ",
    "tio": "tʃi.o",
    "dia": "dʒi.a",
    "bora": "bo.ɾa",
    "ajudar": "a.ʒu.daχ",
}
LITERAL_LIMIT = 256
_WORD = r"[\p{L}\p{N}_]+"
_PIECE = rf"({_WORD}|[^\p{{L}}\p{{N}}_]+)"
_CANDIDATES = "array<struct<pos:int,size:int,phones:string>>"


def lexicon(spark, entries: dict[str, str] | None = None) -> DataFrame:
    """The lexicon as a table (word, phones, seq); later entries win.  An entry may hold several words."""
    rows = [(w, p, i) for i, (w, p) in enumerate([*DEFAULT_LEXICON.items(), *(entries or {}).items()])]
    return spark.createDataFrame(rows, "word string, phones string, seq long")


def latest(entries: DataFrame) -> DataFrame:
    """One row per lower-case entry, the last one added."""
    low = entries.select(F.lower("word").alias("word"), "phones", "seq").where("word <> ''")
    return low.groupBy("word").agg(F.max_by("phones", "seq").alias("phones"))


def pieces_of(text: Column) -> Column:
    """Words and what lies between them, in turn; joined they are the text."""
    return F.regexp_extract_all(text, F.lit(_PIECE), F.lit(1))


def _capital_kept(token: Column, phones: Column) -> Column:
    first = F.substring(token, 1, 1)
    upper = (first == F.upper(first)) & (first != F.lower(first))
    return F.when(upper, F.concat(F.upper(F.substring(phones, 1, 1)), F.substring(phones, F.lit(2), F.length(phones)))).otherwise(phones)


def _window(pieces: Column, at: Column, size: int) -> Column:
    """``size`` pieces from place ``at`` on, in lower case; null where an entry can't stand.

    An entry that begins or ends with a mark needs a word beside it, as one that begins or ends with a word
    needs a mark or an edge."""
    is_word = lambda k: F.get(pieces, k).rlike(f"^{_WORD}$")
    whole = at + size <= F.size(pieces)
    left, right = is_word(at) | (at > 0), is_word(at + size - 1) | (at + size < F.size(pieces))
    text = F.get(pieces, at) if size == 1 else F.array_join(F.slice(pieces, at + 1, size), "")
    return F.when(whole & left & right, F.lower(text))


def _choose(candidates: Column) -> Column:
    """Leftmost candidates that don't overlap; ``candidates`` has the longest one of each place, in order.

    Only candidates of several pieces cover other places, so the fold runs over these alone."""
    several = F.filter(candidates, lambda c: c["size"] > 1)

    def take(done: Column, c: Column) -> Column:
        free = F.coalesce(F.try_element_at(done, F.lit(-1))["pos"] + F.try_element_at(done, F.lit(-1))["size"], F.lit(0)) <= c["pos"]
        return F.when(free, F.concat(done, F.array(c))).otherwise(done)

    taken = F.aggregate(several, F.array().cast(_CANDIDATES), take)
    covers = lambda t, c: (t["pos"] < c["pos"] + c["size"]) & (c["pos"] < t["pos"] + t["size"])
    kept = let(taken, lambda done: F.filter(candidates, lambda c: ((c["size"] > 1) & F.array_contains(done, c)) | ((c["size"] == 1) & ~F.exists(done, lambda t: covers(t, c)))))
    return F.when(F.size(several) == 0, candidates).otherwise(kept)


def _replaced(pieces: Column, chosen: Column) -> Column:
    """The text with the chosen places replaced: each with what lies between it and the one before."""

    def part(c: Column, k: Column) -> Column:
        before = F.get(chosen, k - 1)
        start = F.when(k > 0, before["pos"] + before["size"]).otherwise(0)
        return F.concat(F.array_join(F.slice(pieces, start + 1, c["pos"] - start), ""), _capital_kept(F.get(pieces, c["pos"]), c["phones"]))

    last = F.try_element_at(chosen, F.lit(-1))
    rest = F.coalesce(last["pos"] + last["size"], F.lit(0))
    return F.concat(F.array_join(F.transform(chosen, part), ""), F.array_join(F.slice(pieces, rest + 1, F.size(pieces) - rest), ""))


def _windows(texts: DataFrame, sizes: list[int], begins: list[bool]) -> DataFrame:
    """The windows (__d, pos, size, word) of ``texts`` (__d, pieces) that ``_window`` lets stand, as rows.

    Words and marks take turns, so a place says which of them it is.  ``begins`` has true if entries begin with a word
    and false if some begin with a mark; windows that begin otherwise are left out."""
    shown = [F.col("pieces"), *[F.slice("pieces", k + 1, F.size("pieces")) for k in range(1, max(sizes))]]
    zipped = F.arrays_zip(F.sequence(F.lit(0), F.size("pieces") - 1).alias("pos"), *[c.alias(f"p{k}") for k, c in enumerate(shown)])
    first = F.when(F.get("pieces", F.lit(0)).rlike(f"^{_WORD}"), 0).otherwise(1)
    counted = texts.select("__d", "pieces", F.size("pieces").alias("__n"), first.alias("__first"))
    rows = counted.select("__d", "__n", "__first", F.inline_outer(zipped))
    is_word = lambda k: k % 2 == F.col("__first")
    rows = rows.where(is_word(F.col("pos")).isin(begins))

    def window(n: int) -> Column:
        end = F.col("pos") + n
        left, right = is_word(F.col("pos")) | (F.col("pos") > 0), is_word(end - 1) | (end < F.col("__n"))
        word = F.when((end <= F.col("__n")) & left & right, F.lower(F.concat(*[F.col(f"p{k}") for k in range(n)])))
        return F.struct(F.lit(n).alias("size"), word.alias("word"))

    each = rows.select("__d", "pos", F.explode_outer(F.array(*[window(n) for n in sizes])).alias("w"))
    return each.select("__d", "pos", "w.size", "w.word").where("word is not null")


def found_entries(texts: DataFrame, entries: DataFrame, text: str = "text", literal_limit: int = LITERAL_LIMIT) -> DataFrame:
    """Add ``pieces`` of each text and ``chosen``: the places (pos, size, phones) that lexicon entries take.

    At each place the longest entry wins, and from left to right a place that is taken is not taken again.  A lexicon
    of up to ``literal_limit`` entries becomes part of the expression.  A larger one is a table of token windows by
    length: the windows of the distinct texts are joined to it.
    """
    table = latest(entries).withColumn("size", F.size(pieces_of(F.col("word"))))
    sizes = sorted((r["size"] for r in table.select("size").distinct().collect()), reverse=True)
    cut = texts.withColumn("pieces", pieces_of(F.coalesce(F.col(text), F.lit(""))))
    if not sizes:
        return cut.withColumn("chosen", F.array().cast(_CANDIDATES))
    places = F.sequence(F.lit(0), F.size("pieces") - 1)
    small = table.limit(literal_limit + 1).collect()
    if len(small) <= literal_limit:
        of_size = {n: F.create_map(*[F.lit(x) for r in small if r["size"] == n for x in (r.word, r.phones)]) for n in sizes}

        def entry(at: Column, n: int) -> Column:
            phones = F.try_element_at(of_size[n], _window(F.col("pieces"), at, n))
            return let(phones, lambda p: F.when(p.isNotNull(), F.struct(at.alias("pos"), F.lit(n).alias("size"), p.alias("phones"))))

        def longest(at: Column) -> Column:
            return F.coalesce(*[entry(at, n) for n in sizes])

        candidates = F.when(F.size("pieces") > 0, F.filter(F.transform(places, longest), lambda c: c.isNotNull())).otherwise(F.array().cast(_CANDIDATES))
        return cut.withColumn("candidates", candidates.cast(_CANDIDATES)).withColumn("chosen", _choose(F.col("candidates"))).drop("candidates")
    digest = F.sha2(F.coalesce(F.col(text), F.lit("")), 256)
    # Texts move, not their pieces, which take many times the room.
    own = texts.select(digest.alias("__d"), F.col(text).alias("__t")).where(F.length("__t") > 0).dropDuplicates(["__d"])
    own = own.select("__d", pieces_of(F.col("__t")).alias("pieces"))
    each = _windows(own, sizes, [r["w"] for r in table.select(F.col("word").rlike(f"^{_WORD}").alias("w")).distinct().collect()])
    best = each.join(table.select("word", "phones"), "word").groupBy("__d", "pos").agg(F.max(F.struct("size", "phones")).alias("b"))
    lists = best.groupBy("__d").agg(F.array_sort(F.collect_list(F.struct("pos", "b.size", "b.phones"))).cast(_CANDIDATES).alias("candidates"))
    chosen = lists.select("__d", _choose(F.col("candidates")).alias("chosen"))
    joined = texts.withColumn("__d", digest).join(chosen, "__d", "left").drop("__d")
    return joined.withColumn("pieces", pieces_of(F.coalesce(F.col(text), F.lit("")))).withColumn("chosen", F.coalesce("chosen", F.array().cast(_CANDIDATES)))


def replaced_text(text: Column) -> Column:
    """The text of a row of ``found_entries`` with its entries replaced."""
    return F.when(F.size("chosen") == 0, text).otherwise(_replaced(F.col("pieces"), F.col("chosen")))


def apply_lexicon(rows: DataFrame, entries: DataFrame, text: str = "text", out: str = "text", literal_limit: int = LITERAL_LIMIT) -> DataFrame:
    """Replace words and phrases of the lexicon by their phones; an initial capital stays.  Null texts stay null."""
    return found_entries(rows, entries, text, literal_limit).withColumn(out, replaced_text(F.col(text))).drop("pieces", "chosen")


TextHook = Callable[[DataFrame, str, str], DataFrame]


def front_end(rows: DataFrame, mode: str = "raw", text: str = "text", out: str = "text", hook: TextHook | None = None, entries: DataFrame | None = None) -> DataFrame:
    """``raw``, ``normalize`` (numbers in words) or ``lexicon`` (numbers, then lexicon); then an optional hook."""
    if mode not in ("raw", "normalize", "lexicon"):
        raise ValueError(f"unknown text mode {mode}")
    done = rows.withColumn(out, strip(F.col(text)))
    if mode != "raw":
        done = verbalized(done, out, out).drop("hits")
    if mode == "lexicon":
        table = entries if entries is not None else lexicon(rows.sparkSession)
        done = apply_lexicon(done, table, out, out)
    return hook(done, out, out) if hook else done
