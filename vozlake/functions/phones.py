"""Phones of Portuguese words (Rio accent) by a transducer over letters.

A state says what lies to the left: nothing, an e that began the word, a vowel, another letter, or that the
letter at hand was already read as the second half of a pair.  A symbol is a letter with the classes of the
next two.  One table gives the next state and the phones; it is worked out from the spelling tables below, and
a word is read by walking it.  Letters that nothing is known about are silent.
"""

from __future__ import annotations

from functools import cache
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vozlake.functions.wer import let

# The phone inventory that coverage is measured against.
INVENTORY = [
    "a", "ɐ", "e", "ɛ", "i", "o", "ɔ", "u", "ã", "ẽ", "ĩ", "õ", "ũ",
    "aj", "ej", "ɛj", "oj", "ɔj", "uj", "aw", "ew", "iw", "ow", "ãw̃", "ãj̃", "õj̃",
    "p", "b", "t", "d", "k", "g", "tʃ", "dʒ", "f", "v", "s", "z", "ʃ", "ʒ", "m", "n", "ɲ", "l", "ʎ", "ɾ", "χ", "w", "j",
]

# The sounds of letters.
VOWELS = {"a": "a", "á": "a", "à": "a", "â": "ɐ", "ã": "ã", "e": "e", "é": "ɛ", "ê": "e", "i": "i", "í": "i", "o": "o", "ó": "ɔ", "ô": "o", "õ": "õ", "u": "u", "ú": "u", "ü": "u"}
NASAL = {"aáàâã": "ã", "eéê": "ẽ", "ií": "ĩ", "oóôõ": "õ", "uúü": "ũ"}
FINAL_NASAL = {"aáàâã": "ãw̃", "eéê": "ãj̃"}
RAISED = {"e": "i", "o": "u"}
NASAL_GLIDES = {"ão": "ãw̃", "ãe": "ãj̃", "õe": "õj̃", "iu": "iw", "ui": "uj"}
BEFORE_GLIDE = {"a": "a", "á": "a", "à": "a", "â": "ɐ", "e": "e", "é": "ɛ", "ê": "e", "í": "í", "o": "o", "ó": "ɔ", "ô": "o", "ú": "ú", "ü": "ü"}
GLIDES = {"i": "j", "u": "w"}
PAIRS = {"ch": "ʃ", "lh": "ʎ", "nh": "ɲ", "rr": "χ", "ss": "s"}
PLAIN = {"b": "b", "ç": "s", "d": "d", "f": "f", "j": "ʒ", "k": "k", "m": "m", "n": "n", "p": "p", "t": "t", "v": "v", "w": "w", "y": "j"}
HARD_SOFT = {"c": ("k", "s"), "g": ("g", "ʒ")}
SOFTENING = {"c": "eéêiíè", "qu": "eéêiíè", "g": "eéêií", "gu": "eéêií", "sc": "eéêií", "sç": "eéêií", "xc": "eéêií"}
PALATAL = {"t": "tʃ", "d": "dʒ"}
CLOSING = {"r": ("ɾ", "χ"), "l": ("l", "w"), "s": ("s", "ʃ")}
VOICED = "bdgvzjmnlrw"

LETTERS = "".join(VOWELS) + "bcçdfghjklmnpqrstvwxyzè"
START, AFTER_E, AFTER_VOWEL, AFTER_OTHER, PAIRED = range(5)


def _in_family(letter: str, table: dict[str, str]) -> str | None:
    return next((phones for family, phones in table.items() if letter in family), None)


def _vowel(left: int, letter: str, after: str, second: str, edges: bool) -> tuple[str, int]:
    if after in ("m", "n") and second not in VOWELS:
        return (not second and after == "m" and _in_family(letter, FINAL_NASAL)) or _in_family(letter, NASAL), 2
    if not after and edges:
        return _in_family(letter, NASAL), 1
    if letter + after in NASAL_GLIDES:
        return NASAL_GLIDES[letter + after], 2
    if after in GLIDES and letter in BEFORE_GLIDE:
        return BEFORE_GLIDE[letter] + GLIDES[after], 2
    raised = not after and left != START
    return (raised and RAISED.get(letter)) or VOWELS[letter], 1


def _consonant(left: int, letter: str, after: str, second: str, edges: bool) -> tuple[str, int]:
    member = lambda x, letters: x in letters if x else edges
    pair = letter + after
    if after and pair in PAIRS:
        return PAIRS[pair], 2
    if after and pair in SOFTENING and pair != "qu" and member(second, SOFTENING[pair]):
        return HARD_SOFT["g"][0] if pair == "gu" else PLAIN["ç"], 2
    if pair == "qu":
        return ("k" if member(second, SOFTENING["qu"]) else "k w"), 2
    if letter in HARD_SOFT:
        return HARD_SOFT[letter][member(after, SOFTENING[letter])], 1
    if letter in PALATAL and (after in ("i", "í") or (after == "e" and not second) or (not after and edges)):
        return PALATAL[letter], 1
    if letter in ("s", "x"):
        # Between vowels both are voiced, x only behind a first e.
        open_left = left == AFTER_E if letter == "x" else left in (AFTER_E, AFTER_VOWEL) or (left == START and edges)
        if open_left and member(after, VOWELS):
            return "z", 1
        if letter == "x" or (after and after in VOICED):
            return ("ʃ" if letter == "x" else "ʒ"), 1
    if letter == "z":
        return ("z" if after else "ʃ"), 1
    if letter in CLOSING:
        closed = after not in VOWELS or (letter == "r" and left == START)
        return CLOSING[letter][closed], 1
    return PLAIN.get(letter, ""), 1


class Table(NamedTuple):
    """``states[k]`` and ``phones[k]`` for k = ((state * letters + letter) * nexts + next) * seconds + second.

    ``next_of`` and ``second_of`` number the letters (0 for others, the last for the end of the word) by what they
    do to the letter one and two places to their left; ``nexts`` and ``seconds`` say how many numbers there are."""

    states: list[int]
    phones: list[str]
    next_of: list[int]
    second_of: list[int]
    nexts: int
    seconds: int

    def cell(self, state, code, after, second):
        return ((state * (len(LETTERS) + 1) + code) * self.nexts + after) * self.seconds + second


def _step(state: int, letter: str, after: str, second: str, edges: bool) -> tuple[int, str]:
    left = AFTER_VOWEL if letter in VOWELS else AFTER_OTHER
    if state == PAIRED or letter not in LETTERS or not letter:
        return left, ""
    phones, used = (_vowel if letter in VOWELS else _consonant)(state, letter, after, second, edges)
    return (PAIRED if used == 2 else AFTER_E if state == START and letter == "e" else left), phones


def _numbered(symbols: list[str], effect) -> tuple[list[int], list[str]]:
    """A number for each symbol, equal for equal effects, and a symbol that stands for each number."""
    numbers: dict[object, int] = {}
    stands: list[str] = []
    for x in symbols:
        if effect(x) not in numbers:
            numbers[effect(x)] = len(stands)
            stands.append(x)
    return [numbers[effect(x)] for x in symbols], stands


@cache
def transitions(edges: bool = True) -> Table:
    """The table; with ``edges`` the edge of a word counts as a member of every letter class."""
    symbols = ["?", *LETTERS, ""]
    softens = lambda x: tuple(x in s for s in SOFTENING.values())
    next_of, nexts = _numbered(symbols, lambda x: (x if x in "mnhcçrsuioe" else "?", x in VOWELS, softens(x), x in "ií", x in VOICED, x == ""))
    second_of, seconds = _numbered(symbols, lambda x: (x in VOWELS, softens(x), x == ""))
    cells = [_step(state, letter, after, second if after else "", edges) for state in range(5) for letter in symbols[:-1] for after in nexts for second in seconds]
    return Table([s for s, _ in cells], [p for _, p in cells], next_of, second_of, len(nexts), len(seconds))


def spelled(word: Column, edges_match: bool = True) -> Column:
    """Phones of a word, separated by blanks."""
    table, end = transitions(edges_match), len(LETTERS) + 1
    row = end * table.nexts * table.seconds
    # One literal each, folded once; an array of thousands of literals would be walked by every rule of the optimizer.
    literal = lambda items, kind: F.split(F.lit(",".join(map(str, items))), ",").cast(kind)
    # The last cell stands for the time before the first letter.
    begins = literal([state * row for state in [*table.states, START]], "array<int>")
    said = literal([f" {p}" if p else "" for p in [*table.phones, ""]], "array<string>")
    # What a letter, the next and the second next one add to the number of a cell.
    own = literal([code * table.nexts * table.seconds for code in range(end)], "array<int>")
    after, second = literal([kind * table.seconds for kind in table.next_of], "array<int>"), literal(table.second_of, "array<int>")

    def walk(codes: Column) -> Column:
        places = F.transform(F.slice(codes, 1, F.size(codes) - 2), lambda c, k: F.get(own, c) + F.get(after, F.get(codes, k + 1)) + F.get(second, F.get(codes, k + 2)))
        # The state is a cell: where the next one is looked for, and what is said when the walk goes on.
        empty = F.struct(F.lit(len(table.states)).alias("cell"), F.lit("").alias("out"))

        def read(done: Column, place: Column) -> Column:
            return F.struct((F.get(begins, done["cell"]) + place).alias("cell"), F.concat(done["out"], F.get(said, done["cell"])).alias("out"))

        return F.aggregate(places, empty, read, lambda done: F.trim(F.concat(done["out"], F.get(said, done["cell"]))))

    codes = F.concat(F.transform(F.split(word, ""), lambda c: F.instr(F.lit(LETTERS), c)), F.array(F.lit(end), F.lit(end)))
    return F.when(F.length(word) > 0, let(codes, walk)).when(word.isNotNull(), F.lit(""))


class Speller:
    """Reads single words on the driver, by the same table."""

    def __init__(self, edges_match: bool = True):
        self.table = transitions(edges_match)

    def word(self, word: str) -> list[str]:
        table, state, out = self.table, START, []
        codes = [LETTERS.find(c) + 1 for c in word] + [len(LETTERS) + 1] * 2
        for code, after, second in zip(codes, codes[1:], codes[2:], strict=False):
            cell = table.cell(state, code, table.next_of[after], table.second_of[second])
            state = table.states[cell]
            out += table.phones[cell].split()
        return out


def text_words(text: Column) -> Column:
    """Lower-case words; hyphens separate, other marks go."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "-", " "), r"[^\p{L}\p{N}_ ]", " ")
    return F.filter(F.split(bare, r"\s+"), lambda w: w != "")


def _listed(phones: Column) -> Column:
    return F.array_remove(F.split(phones, " "), "")


def word_table(texts: DataFrame, text: str = "text", edges_match: bool = True) -> DataFrame:
    """Each distinct word of a corpus once: (word, n, phones)."""
    counted = texts.select(F.explode(text_words(F.col(text))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("phones", _listed(spelled(F.col("word"), edges_match)))


def text_phones(texts: DataFrame, text: str = "text", out: str = "phones", edges_match: bool = True) -> DataFrame:
    """Add the phones of each text.  Every word is read where its text lies: texts are dealt out once, no row is made per word."""
    read = F.transform(text_words(F.col(text)), lambda w: spelled(w, edges_match))
    rows = texts.drop(out)
    return rows.repartition(F.xxhash64(*rows.columns)).withColumn(out, _listed(F.array_join(read, " ")))
