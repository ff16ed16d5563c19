"""Text expressions: Column in, Column out, all inside the JVM."""

from __future__ import annotations

from functools import cache
from unicodedata import category, normalize

from pyspark.sql import Column
from pyspark.sql import functions as F

# Character classes.
SPACE = r"[\s\p{Z}\x1c-\x1f\x85]"
SPACES = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
WORD_CHAR = r"[\p{L}\p{N}_]"
NOT_WORD_CHAR = r"[^\p{L}\p{N}_]"

# Pt-BR control-tag defaults that add no prefix.
PLAIN_STYLES = ["neutro", "conversa"]
PLAIN_ACCENT = "carioca-medio"

INTERRUPTED_MARK = " … [interrompido pelo usuário]"


def strip(text: Column) -> Column:
    """Remove white space at both ends."""
    return F.btrim(text, F.lit(SPACES))


def unicode_words(text: Column) -> Column:
    """Runs of letters, digits and underscore."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({WORD_CHAR}+)"), F.lit(1))


def unicode_word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(f"{WORD_CHAR}+"))


def tokens(text: Column) -> Column:
    """White-space tokens."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"{SPACE}+"), lambda t: t != "")


def token_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(rf"[^\s\p{{Z}}\x1c-\x1f\x85]+"))


def alnum_chars(text: Column) -> Column:
    """Characters left after dropping everything that is not a word character."""
    return F.length(F.regexp_replace(F.coalesce(text, F.lit("")), NOT_WORD_CHAR, ""))


def seconds_per_char(dur_s: Column, text: Column) -> Column:
    return dur_s / F.greatest(alnum_chars(text), F.lit(1)).cast("double")


@cache
def accented() -> tuple[str, str]:
    """Characters that decompose to one base character and marks, and their base characters."""
    pairs = []
    for code in range(0xA0, 0x10000):
        base = [c for c in normalize("NFD", chr(code)) if category(c) != "Mn"]
        if len(base) == 1 and base[0] != chr(code):
            pairs.append((chr(code), base[0]))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def strip_accents(text: Column) -> Column:
    """Without accents: composed letters become their base letters, marks of their own go."""
    return F.regexp_replace(F.translate(text, *accented()), r"\p{Mn}+", "")


def normalize_for_wer(text: Column) -> Column:
    """Lower case, no punctuation, single spaces."""
    bare = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\p{P}", "")
    return strip(F.regexp_replace(bare, f"{SPACE}+", " "))


def match_key(token: Column) -> Column:
    """Lower case without accents and without anything but word characters."""
    return F.regexp_replace(strip_accents(F.lower(token)), NOT_WORD_CHAR, "")


def sentences(text: Column) -> Column:
    """Sentences: each closes at ``. ! ? …`` followed by white space; the rest is kept."""
    parts = F.split(F.coalesce(text, F.lit("")), r"(?<=[.!?…])\s")
    return F.filter(F.transform(parts, strip), lambda s: s != "")


def mark_count(text: Column, marks: str) -> Column:
    """Occurrences of any of the characters in ``marks``."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[" + marks.replace("]", r"\]") + "]"))


def capitalize_sentences(text: Column) -> Column:
    """Upper-case the first letter of the text and the first letter after ``. ? ! …``."""
    pieces = F.regexp_extract_all(text, F.lit(r"([^.?!…]*[.?!…]?)"), F.lit(1))

    def lift(piece: Column) -> Column:
        head = F.regexp_extract(piece, r"^(\P{L}*)\p{L}", 1)
        at = F.length(head)
        has = piece.rlike(r"\p{L}")
        up = F.concat(head, F.upper(F.substring(piece, at + 1, F.lit(1))), F.substring(piece, at + 2, F.length(piece)))
        return F.when(has, up).otherwise(piece)

    return F.array_join(F.transform(pieces, lift), "")


def style_prefix(style: Column, accent: Column) -> Column:
    """``<style|accent> `` with default values left out; empty when both are defaults."""
    parts = F.array(
        F.when((style != "") & ~style.isin(PLAIN_STYLES), style),
        F.when((accent != "") & (accent != PLAIN_ACCENT), accent),
    )
    shown = F.filter(parts, lambda p: p.isNotNull())
    return F.when(F.size(shown) > 0, F.concat(F.lit("<"), F.array_join(shown, "|"), F.lit("> "))).otherwise("")


def strip_tags(text: Column) -> Column:
    return strip(F.regexp_replace(text, r"<[^>]*>\s*", ""))


def session_of_segment(segment_id: Column) -> Column:
    """Drop the trailing segment number."""
    return F.regexp_replace(segment_id, r"[-_]seg\d+$", "")


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def segment_id(user: Column, meeting: Column, number: Column) -> Column:
    base = slug(F.concat_ws("-", user, meeting))
    width = F.greatest(F.lit(3), F.length(number.cast("string")))
    return F.concat(base, F.lit("-seg"), F.lpad(number.cast("string"), width, "0"))


def heard_part(text: Column, fraction: Column, mark: str = INTERRUPTED_MARK) -> Column:
    """The words that were heard of an interrupted reply; replies heard to 0.99 stay whole."""
    words = tokens(text)
    keep = F.greatest(F.lit(1), F.floor(F.size(words) * fraction).cast("int"))
    cut = F.concat(F.array_join(F.slice(words, F.lit(1), keep), " "), F.lit(mark))
    return F.when(fraction >= 0.99, text).otherwise(cut)


def key_values(spec: Column) -> Column:
    """``k=v,k=v`` as an ordered array of (name, value); blank items are skipped."""
    items = F.filter(F.transform(F.split(spec, ","), strip), lambda i: i != "")

    def pair(item: Column) -> Column:
        at = F.instr(item, "=")
        name = F.when(at > 0, strip(F.substring(item, F.lit(1), at - 1))).otherwise(
            F.raise_error(F.concat(F.lit("item without '=': "), item))
        )
        return F.struct(name.alias("name"), strip(F.substring(item, at + 1, F.length(item))).alias("value"))

    return F.transform(items, pair)


def reason_head(reason: Column) -> Column:
    """The part of an export reject reason before ``:`` and ``(``."""
    return strip(F.regexp_extract(reason, r"^([^:(]*)", 1))


def first_reason_head(reasons: Column) -> Column:
    """The first of several ``; `` separated reasons, without its detail in brackets."""
    return strip(F.regexp_extract(reasons, r"^([^;(]*)", 1))


def fixed(value: Column, digits: int) -> Column:
    """A non-negative double with ``digits`` decimals, rounded on its exact binary value, ties to even.

    ``format_string`` rounds the shortest decimal form instead, which differs at
    values such as 35.05.
    """
    whole = F.floor(value)
    bits = ((value - whole) * F.lit(float(2**62))).cast("long").cast("decimal(19,0)")
    unit = F.lit(2**62).cast("decimal(19,0)")
    scaled = bits * F.lit(10**digits).cast("decimal(6,0)")
    low = F.floor(scaled / unit).cast("long")
    rest = scaled - low.cast("decimal(6,0)") * unit
    half = F.lit(2**61).cast("decimal(19,0)")
    up = (rest > half) | ((rest == half) & (low % 2 == 1))
    steps = low + F.when(up, 1).otherwise(0)
    full = whole + F.floor(steps / F.lit(10**digits))
    return F.concat(full.cast("string"), F.lit("."), F.lpad((steps % F.lit(10**digits)).cast("string"), digits, "0"))


def rounded(value: Column, digits: int) -> Column:
    """``round`` on the exact binary value with ties to even, as a double; negative values keep their sign."""
    return F.signum(value) * fixed(F.abs(value), digits).cast("double")
