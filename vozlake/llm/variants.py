"""Words that differ in one letter, grouped around their frequent form.

One inserted or deleted letter changes a word's multiset of letters by one, one replaced letter by two.  So
near words, seen as binary vectors with a place for every (letter, occurrence), have a Hamming distance of at
most two.  PartEnum finds all such pairs by equality: the places are divided among ``parts`` parts; a pair
that differs in two places differs in at most two parts; so there is a choice of ``parts - 2`` parts on which
both vectors are equal.  Every word gives one signature for each choice.  Words that share a signature are
compared letter by letter (edit distance exactly one).

1. Runs of letters are counted over whole texts; a known share of them loses a letter on the way (``damaged``).
2. Signatures of the counted words are joined by equality, with the comparison inside the join, so that only
   near pairs come out of it.  No table of words is broadcast, here or below, whatever its size.
3. A word's form is its most frequent near word if that is ``ratio`` times as frequent.  Frequencies rise by
   that ratio along a chain of forms, so chains are short; following them doubles its reach each round.

Letters are A-Z, a-z and U+00C0 to U+00FF; only A-Z are lower-cased.  Null and empty texts have no words; a null
id counts as empty text in the hash.  Repeated rows count each time.  Equal frequencies go to the smaller word in
code-point order.  Words and texts may be of any length; memory holds one word's letters.  Other columns don't
matter; an empty table gives no rows.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vozlake.llm.common import ascii_lower, bounded_batches, materialize, only
from vozlake.operators.ordered import shuffled

LETTERS = r"a-zÀ-ÿ"
LEAST_LENGTH, LEAST_COUNT, RATIO, DAMAGED = 6, 5, 5, 199
#: Differing places of near words, and parts of the places: 21 signatures, each of five parts.
PLACES, PARTS = 2, 7


def damaged(run: Column, key: Column, every: int = DAMAGED) -> Column:
    """The run without one letter if ``every`` divides the checksum of ``key:run``, else the run."""
    check = F.crc32(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (check % F.char_length(run)).cast("int")
    return F.when(check % every == 0, F.concat(F.substr(run, F.lit(1), at), F.substr(run, at + 2))).otherwise(run)


def counted_words(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, every: int = DAMAGED) -> DataFrame:
    """(word, n) of the words that are long and frequent enough."""
    own = docs.select(F.col(f"`{doc_id}`").alias("id"), ascii_lower(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("body"))
    runs = own.select("id", F.explode(F.split("body", f"[^{LETTERS}]+")).alias("run")).where(F.char_length("run") >= least_length)
    words = runs.select(damaged(F.col("run"), F.col("id"), every).alias("word")).where(F.char_length("word") >= least_length)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)


def mixed(value: int) -> int:
    """A 64-bit number's bits, scattered."""
    value = (value ^ (value >> 30)) * 0xBF58476D1CE4E5B9 & (1 << 64) - 1
    value = (value ^ (value >> 27)) * 0x94D049BB133111EB & (1 << 64) - 1
    return value ^ (value >> 31)


def part_sums(word: str, parts: int = PARTS) -> list[int]:
    """What the word's vector holds in each part, as sums of scattered place numbers."""
    seen: dict[str, int] = {}
    sums = [0] * parts
    for letter in word:
        seen[letter] = k = seen.get(letter, 0) + 1
        # Neighbours in the alphabet and repeats of one letter go to different parts.
        sums[(ord(letter) + 3 * k) % parts] += mixed(ord(letter) << 32 | k)
    return sums


def signatures(words: pd.Series, parts: int = PARTS, places: int = PLACES) -> np.ndarray:
    """One row a word, one 64-bit signature for each choice of parts."""
    choices = np.array(list(combinations(range(parts), parts - places)))
    sums = np.array([[x & (1 << 64) - 1 for x in part_sums(w, parts)] for w in words], np.uint64).reshape(-1, parts)
    scattered = sums * np.array([mixed(k + 1) | 1 for k in range(parts)], np.uint64)
    scattered ^= scattered >> np.uint64(29)
    total = scattered[:, choices].sum(axis=2, dtype=np.uint64) + np.array([mixed(~k & (1 << 64) - 1) for k in range(len(choices))], np.uint64)
    return total.view(np.int64)


def near_pairs(words: DataFrame, parts: int = PARTS, places: int = PLACES) -> DataFrame:
    """(word, n, other, other_n), word < other: all pairs of ``words`` (word, n) that one letter turns into each other."""

    @F.pandas_udf("array<long>")
    def signed(texts: pd.Series) -> pd.Series:
        return pd.Series(list(signatures(texts, parts, places)))

    bounded_batches(words.sparkSession)
    keyed = words.select("word", "n", F.explode(signed("word")).alias("signature"))
    other = keyed.select(F.col("word").alias("other"), F.col("n").alias("other_n"), "signature")
    # The optimizer doesn't count that a word becomes a row for each signature: a table under its limit would be broadcast 21-fold.
    met = keyed.join(shuffled(other), "signature").where((F.col("word") < F.col("other")) & (F.levenshtein("word", "other", 1) == 1))
    return met.select("word", "n", "other", "other_n").distinct()


def roots(forms: DataFrame, hops: int) -> DataFrame:
    """(word, root) for chains of at most ``hops`` steps in ``forms`` (word, form)."""
    reach, found = 1, forms.select("word", F.col("form").alias("root"))
    while reach < hops:
        further = found.select(F.col("word").alias("root"), F.col("root").alias("next"))
        found = materialize(found.join(shuffled(further), "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")
        reach *= 2
    return found


def group(words: DataFrame, ratio: int = RATIO, parts: int = PARTS) -> DataFrame:
    """word, n, form, form_n, n_near, root for every one of ``words`` (word, n)."""
    words = materialize(words, "words")
    pairs = materialize(near_pairs(words, parts), "near-pairs")
    both = pairs.unionAll(pairs.select("other", "other_n", "word", "n"))
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best"))
    joined = words.join(shuffled(best), "word", "left").withColumn("form_n", F.when(-F.col("best.less") >= ratio * F.col("n"), -F.col("best.less")))
    named = materialize(joined.select("word", "n", F.when(F.col("form_n").isNotNull(), F.col("best.other")).alias("form"), "form_n", F.coalesce("n_near", F.lit(0)).alias("n_near")), "forms")
    most, hops = named.agg(F.max("n")).first()[0] or 0, 0
    while ratio ** (hops + 1) <= most:
        hops += 1
    ends = roots(named.where("form is not null").select("word", "form"), hops)
    return named.join(shuffled(ends), "word", "left").withColumn("root", F.coalesce("root", "word"))


def digest(docs: DataFrame) -> DataFrame:
    return group(counted_words(only(docs, "doc_id", "text"))).select("word", "form", "root", "n", "n_near", "form_n")


SQL = r"""
WITH RECURSIVE table_of AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: xor(c >> 1, (c & 1) * 3988292384))) AS crc),
runs AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents WHERE text IS NOT NULL),
low AS (SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
        FROM runs WHERE length(run) >= 6 GROUP BY ALL),
bytes AS (SELECT run, n, flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''),
                                        lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [195, unicode(c)::BIGINT - 64] END)) AS b FROM low),
hashed AS (SELECT run, n, xor(4294967295, list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c >> 8, crc[(xor(c, x) & 255) + 1]))) AS h FROM bytes, table_of),
left_over AS (SELECT CASE WHEN h % 199 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, n FROM hashed),
words AS (SELECT word, sum(n)::BIGINT AS n FROM left_over WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
cuts AS (SELECT word, n, i, left(word, i::INT - 1) || substr(word, i::INT + 1) AS cut FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (SELECT DISTINCT a.word, b.word AS other, b.n AS other_n FROM cuts a JOIN cuts b ON a.i = b.i AND a.cut = b.cut AND a.word <> b.word
         UNION SELECT a.word, b.word, b.n FROM cuts a JOIN words b ON a.cut = b.word
         UNION SELECT b.word, a.word, a.n FROM cuts a JOIN words b ON a.cut = b.word),
best AS (SELECT word, count(*) AS n_near, arg_min(other, (-other_n, other)) AS other, max(other_n) AS other_n FROM near GROUP BY word),
formed AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 5 * n THEN other END AS form, CASE WHEN other_n >= 5 * n THEN other_n END AS form_n
           FROM words LEFT JOIN best USING (word)),
chain AS (SELECT word, word AS place, 0 AS hop FROM formed
          UNION ALL SELECT c.word, f.form, hop + 1 FROM chain c JOIN formed f ON c.place = f.word WHERE f.form IS NOT NULL),
ends AS (SELECT word, arg_max(place, hop) AS root FROM chain GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN ends USING (word)
"""
