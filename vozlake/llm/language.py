"""Language identification: unigram pieces per language, marginalised over all segmentations.

The vocabulary is that of a public tokenizer, fixed and the same for all languages.  Every language has a
probability for every piece.  The probability of a word is the sum over all ways to cut it into pieces
(the forward algorithm), and that of a text the product over its words; the language with the largest
posterior wins.

Training counts words per language over all training rows, then runs expectation maximisation: the
forward-backward pass gives the expected use of each piece over all segmentations of every word.  The
first round starts from even probabilities.  Only (language, piece) sums reach the driver: at most
vocabulary times languages.

``und`` with score 0 is the answer for null, for texts without a letter, and where nothing was
learned.  Texts are read whole; rows are judged one by one; repeated rows and other columns don't matter.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vozlake.llm.common import bounded_batches, in_fold, materialize

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
ROUNDS, SMOOTHING, OTHER = 2, 0.1, 0.1
COUNTED, REMEMBERED, BLOCK, TEXTS = 200_000, 400_000, 4096, 1000
SMALL = 1e-300
UNKNOWN = "und"
#: Longer runs of letters are cut into words of this length, so that no probability underflows on known pieces.
LONGEST_WORD = 40


def load_pieces(path: str = VOCABULARY) -> list[str]:
    """All letter pieces of the vocabulary, lower-cased; ▁ marks the start of a word."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = (model.id_to_piece(k) for k in range(model.get_piece_size()) if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k)))
    lower = {piece.lower() for piece in found}
    return sorted(p for p in lower if p == "▁" or p.removeprefix("▁").isalpha())


class Letters(dict):
    """A translation that leaves letters alone and makes a blank of everything else."""

    def __missing__(self, code: int) -> int:
        self[code] = found = code if chr(code).isalpha() else 32
        return found


LETTERS = Letters()


def words_of(text: str) -> list[str]:
    """Runs of letters, in lower case; number signs such as ½ are no letters."""
    words = text.lower().translate(LETTERS).split()
    if max(map(len, words), default=0) <= LONGEST_WORD:
        return words
    return [word[at : at + LONGEST_WORD] for word in words for at in range(0, len(word), LONGEST_WORD)]


class Pieces:
    """Finds pieces by 64-bit hashes of their characters, for many substrings at once."""

    BASE = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, pieces: list[str]):
        hashes = np.array([self.hash_of(piece) for piece in pieces], np.uint64)
        self.count, self.longest = len(pieces), max(map(len, pieces), default=1)
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]
        # One bit for each value of a hash's first 22 bits tells most other substrings apart at once.
        self.marked, self.begun = np.zeros(1 << 22, bool), np.zeros(1 << 22, bool)
        self.marked[hashes >> np.uint64(42)] = True
        beginnings = {piece[:k] for piece in pieces for k in range(1, len(piece))}
        self.begun[np.array([self.hash_of(x) for x in beginnings], np.uint64) >> np.uint64(42)] = True

    @classmethod
    def hash_of(cls, piece: str) -> int:
        value = 0
        for character in piece:
            value = (value * int(cls.BASE) + ord(character)) % (1 << 64)
        return value

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Number of each piece; the number of pieces where there is none."""
        out = np.full(len(hashes), self.count, np.int32)
        likely = np.flatnonzero(self.marked[hashes >> np.uint64(42)])
        if len(likely):
            at = np.minimum(np.searchsorted(self.hashes, hashes[likely]), self.count - 1)
            hit = self.hashes[at] == hashes[likely]
            out[likely[hit]] = self.order[at[hit]]
        return out


class Lattice:
    """All segmentations of words of one length: which piece lies between which places of which words."""

    def __init__(self, words: list[str], pieces: Pieces):
        self.places, self.words = len(words[0]) + 1, len(words)
        letters = np.array(["▁" + word for word in words], f"<U{self.places}").view(np.uint32).reshape(len(words), self.places).astype(np.uint64)
        #: (start, end, numbers of the words, their pieces), by end and then by start.
        self.spans: list[tuple[int, int, np.ndarray | slice, np.ndarray]] = []
        running: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        every = np.arange(len(words))
        for end in range(1, self.places + 1):
            last = letters[:, end - 1]
            for start in range(max(0, end - pieces.longest), end):
                if end - start == 1:
                    alive, hashes = every, last
                    found = pieces.find(hashes)
                    found[found == pieces.count] = pieces.count + 1  # an unknown character
                    self.spans.append((start, end, slice(None), found))
                else:
                    alive, hashes = running[start]
                    if not len(alive):
                        continue
                    hashes = hashes * Pieces.BASE + last[alive]
                    found = pieces.find(hashes)
                    hit = np.flatnonzero(found != pieces.count)
                    if len(hit):
                        self.spans.append((start, end, alive[hit], found[hit]))
                # What begins no piece is followed no further.
                on = pieces.begun[hashes >> np.uint64(42)]
                running[start] = alive[on], hashes[on]

    def forward(self, table: np.ndarray) -> list[np.ndarray]:
        """Sums over all cuts of the first letters, one row per word; ``table`` has a row per piece."""
        shape = (self.words, table.shape[1])
        sums = [np.ones(shape)] + [np.zeros(shape) for _ in range(self.places)]
        for start, end, rows, piece in self.spans:
            sums[end][rows] += sums[start][rows] * table[piece]
        return sums

    def expected(self, table: np.ndarray, times: np.ndarray) -> np.ndarray:
        """Expected use of every piece, over all cuts of every word, each word ``times``; ``table`` has one column."""
        before = self.forward(table)
        after = [np.zeros((self.words, 1)) for _ in range(self.places)] + [np.ones((self.words, 1))]
        use = []
        share = times[:, None] / np.maximum(before[-1], SMALL)
        for start, end, rows, piece in reversed(self.spans):
            onward = table[piece] * after[end][rows]
            after[start][rows] += onward
            use.append((before[start][rows] * onward * share[rows])[:, 0])
        return np.bincount(np.concatenate([piece for *_, piece in reversed(self.spans)]), np.concatenate(use), len(table))


def by_length(words: Iterable[str]) -> dict[int, list[str]]:
    groups: dict[int, list[str]] = {}
    for word in words:
        groups.setdefault(len(word), []).append(word)
    return groups


@dataclass
class Model:
    """A column per language; a row per piece, then one of zeros, then that of an unknown character."""

    languages: list[str]
    pieces: Pieces
    table: np.ndarray
    known: dict[str, int] = field(default_factory=dict)
    logs: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))

    def learn(self, words: set[str]) -> None:
        """Remember the logarithm of each word's probability in every language, over all segmentations."""
        if len(self.known) + len(words) > REMEMBERED:
            self.known, self.logs = {}, np.zeros((0, 0))
        found = [self.logs.reshape(-1, len(self.languages))]
        for group in by_length(word for word in words if word not in self.known).values():
            for at in range(0, len(group), BLOCK):
                part = group[at : at + BLOCK]
                sums = Lattice(part, self.pieces).forward(self.table)[-1]
                for word in part:
                    self.known[word] = len(self.known)
                found.append(np.log(np.maximum(sums, SMALL)))
        self.logs = np.concatenate(found)

    def judge(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Best language and posterior of each text; words are learnt for many texts at a time."""
        counts = [Counter(words_of(text or "")) for text in texts]
        if self.languages:
            self.learn(set().union(*counts))
        out = []
        for own in counts:
            if not own or not self.languages:
                out.append((UNKNOWN, 0.0))
                continue
            total = np.fromiter(own.values(), float, len(own)) @ self.logs[[self.known[word] for word in own]]
            chance = np.exp(total - total.max())
            best = int(np.argmax(chance))
            out.append((self.languages[best], float(chance[best] / chance.sum())))
        return out


def word_counts(rows: DataFrame) -> DataFrame:
    """(lang, word, n) over all rows of (text, lang); each task adds up what it can hold before it sends."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tally: Counter[tuple[str, str]] = Counter()

        def table() -> pd.DataFrame:
            made = pd.DataFrame([(a, b, n) for (a, b), n in tally.items()], columns=["lang", "word", "n"])
            tally.clear()
            return made

        for batch in batches:
            for text, lang in zip(batch["text"], batch["lang"], strict=True):
                for word, n in Counter(words_of(text or "")).items():
                    tally[lang, word] += n
                if len(tally) > COUNTED:
                    yield table()
        yield table()

    bounded_batches(rows.sparkSession)
    return rows.select("text", "lang").mapInPandas(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def expected_counts(words: DataFrame, languages: list[str], pieces: Pieces, table: np.ndarray) -> np.ndarray:
    """Expected use of each piece per language, summed over all words."""
    shipped = words.sparkSession.sparkContext.broadcast((languages, pieces, table))  # at most vocabulary times languages

    def expect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, known, chances = shipped.value
        sums = np.zeros_like(chances)
        for batch in batches:
            for lang, own in batch.groupby("lang"):
                column = names.index(lang)
                times = dict(zip(own["word"], own["n"], strict=True))
                for group in by_length(times).values():
                    for at in range(0, len(group), BLOCK):
                        part = group[at : at + BLOCK]
                        each = np.array([times[word] for word in part], float)
                        sums[:, column] += Lattice(part, known).expected(chances[:, column : column + 1], each)
        piece, column = np.nonzero(sums)
        yield pd.DataFrame({"piece": piece, "column": column, "x": sums[piece, column]})

    out = np.zeros_like(table)
    for r in words.mapInPandas(expect, "piece long, column long, x double").groupBy("piece", "column").agg(F.sum("x").alias("x")).collect():
        out[r["piece"], r["column"]] = r["x"]
    return out


def fit(rows: DataFrame, vocabulary: str = VOCABULARY, rounds: int = ROUNDS, smoothing: float = SMOOTHING) -> Model:
    """``rows``: text and lang of the training documents; rows without a language are left out."""
    pieces = Pieces(load_pieces(vocabulary))
    n = pieces.count
    words = materialize(word_counts(rows.where(F.col("lang").isNotNull())), "words")
    languages = sorted(r["lang"] for r in words.select("lang").distinct().collect())
    table = np.full((n + 2, len(languages)), 1.0 / n)
    table[n:] = [[0.0], [OTHER / n]]
    for _ in range(rounds if languages else 0):
        counts = expected_counts(words, languages, pieces, table)[:n]
        total = counts.sum(axis=0)
        # A language with little text has a large floor; one floor for all keeps that from deciding.  Pieces sum to one.
        floor = (smoothing / (total + smoothing * n)).max()
        table[:n] = floor + (1 - n * floor) * counts / np.maximum(total, SMALL)
        table[n + 1] = OTHER * floor
    return Model(languages, pieces, table)


def identify(df: DataFrame, model: Model, text: str = "text", out: str = "language") -> DataFrame:
    """Add a struct (lang, score) for each whole text."""
    bounded_batches(df.sparkSession)
    shipped = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType())]))
    def judged(texts: pd.Series) -> pd.DataFrame:
        whole = texts.tolist()
        parts = (shipped.value.judge(whole[at : at + TEXTS]) for at in range(0, len(whole), TEXTS))
        return pd.DataFrame([answer for part in parts for answer in part], columns=["lang", "score"])

    return df.withColumn(out, judged(F.col(f"`{text}`")))


def digest(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    held: Column = in_fold(F.col("doc_id"), 5, 0)
    model = fit(docs.where(~held).select("text", F.col("lang").cast("string").alias("lang")), vocabulary)
    rows = identify(docs.select("doc_id", F.col("text").alias("body")), model, "body", "l")
    return rows.select("doc_id", held.alias("held_out"), F.col("l.lang").alias("lang_pred"), F.col("l.score").alias("score"))
