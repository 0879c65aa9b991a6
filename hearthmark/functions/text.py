"""Text normalisation, token sets and set similarities as Column expressions."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the characters that count as white space in listing texts
# (ASCII blanks, no-break and typographic spaces, byte-order mark).
WHITESPACE = r"[\t\n\x0B\f\r \xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"

# Fixed value: French stop-words ignored by the token similarity.
STOPWORDS = (
    "le la les un une des de du et a au aux en pour avec sur dans ce cet cette "
    "ses son sa plus tres tout toute par est vous votre"
).split()

_BLANKS = "\t\n\x0b\f\r\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
# a blank between words stays as it is
_GAP = re.compile(f"[ {_BLANKS}]{{2,}}|[{_BLANKS}]")
_WORD_BYTES = b"abcdefghijklmnopqrstuvwxyz0123456789"
_ONLY_WORDS = bytes(c if c in _WORD_BYTES else 32 for c in range(256))
_ONE_BLANK = bytes(32 if c in b"\t\n\x0b\f\r" else c for c in range(256))
# stop-words and single characters
_NO_WORDS = {w.encode() for w in STOPWORDS} | {bytes([c]) for c in _WORD_BYTES}


def _accent_table() -> tuple[str, str]:
    """Letters whose canonical decomposition is one base character plus marks."""
    accented, plain = [], []
    for code in range(0xC0, 0x2000):
        letter = chr(code)
        decomposed = unicodedata.normalize("NFD", letter)
        base = "".join(c for c in decomposed if not 0x300 <= ord(c) <= 0x36F)
        if len(base) == 1 and base != letter:
            accented.append(letter)
            plain.append(base)
    return "".join(accented), "".join(plain)


_ACCENTED, _PLAIN = _accent_table()


def fold(text: Column) -> Column:
    """Lower case without diacritics. Pure ASCII rows skip the letter table."""
    stripped = F.regexp_replace(F.translate(text, _ACCENTED, _PLAIN), r"[\x{300}-\x{36F}]", "")
    return F.lower(F.when(text.rlike(r"[^\x00-\x7f]"), stripped).otherwise(text))


def trim_blank(text: Column) -> Column:
    return F.regexp_replace(text, f"^{WHITESPACE}+|{WHITESPACE}+$", "")


def squash(text: Column) -> Column:
    """One blank between words, none at the ends."""
    return F.trim(F.regexp_replace(text, f"{WHITESPACE}+", " "))


def blank_to_null(text: Column) -> Column:
    return F.nullif(trim_blank(text), F.lit(""))


def tokens(text: Column) -> Column:
    """Folded alphanumeric words of two or more characters, stop-words removed."""
    words = F.regexp_extract_all(fold(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]{2,}"), F.lit(0))
    return F.filter(words, lambda w: ~w.isin(STOPWORDS))


def token_set(text: Column) -> Column:
    return folded_words(fold(F.coalesce(text, F.lit(""))))


def folded_words(folded: Column) -> Column:
    """Token set of a text that is folded already."""
    words = F.regexp_extract_all(folded, F.lit("[a-z0-9]{2,}"), F.lit(0))
    return F.array_except(words, F.array(*[F.lit(w) for w in STOPWORDS]))


def folded_word_set(folded: str) -> set[bytes]:
    """:func:`folded_words` of one text, outside of Spark."""
    return set(folded.encode().translate(_ONLY_WORDS).split()) - _NO_WORDS


def trigram_set(text: Column) -> Column:
    """Distinct character trigrams of the padded text.

    A zero-width look-ahead yields the overlapping windows in one pass, so the
    cost is linear in the text length.
    """
    padded = F.concat(F.lit("  "), squash(fold(F.coalesce(text, F.lit("")))), F.lit(" "))
    return F.array_distinct(F.regexp_extract_all(padded, F.lit("(?s)(?=(.{3}))"), F.lit(1)))


def packed(grams: Column) -> Column:
    """Trigrams as whole numbers, 21 bits per character: smaller to move, quicker to intersect."""

    def code(gram: Column, place: int) -> Column:
        return F.ascii(F.substring(gram, place, 1)).cast("bigint")

    return F.transform(
        grams, lambda g: F.shiftleft(code(g, 1), 42) + F.shiftleft(code(g, 2), 21) + code(g, 3)
    )


def _gram_codes(texts: pd.Series) -> pd.Series:
    return texts.map(_gram_codes_of, na_action="ignore")


def _gram_codes_of(text: str) -> np.ndarray:
    units = np.frombuffer(text.encode("utf-16-le", "surrogatepass"), dtype="<u2").astype(np.int64)
    high, low = units >> 10 == 0x36, units >> 10 == 0x37
    if not low.any():
        return np.unique((units[:-2] << 42) + (units[1:-1] << 21) + units[2:])
    # a window may start inside a pair of surrogates; such a half counts as a question mark
    paired = np.append(high[:-1] & low[1:], False)
    points = np.where(high | low, ord("?"), units)
    at = np.flatnonzero(paired)
    points[at] = 0x10000 + ((units[at] & 0x3FF) << 10) + (units[at + 1] & 0x3FF)
    size = len(units)
    after = np.append(np.arange(size) + 1 + paired, [size + 1, size + 1])
    second = after[:size]
    third = after[np.minimum(second, size)]
    first = np.flatnonzero(third < size)
    return np.unique((points[first] << 42) + (points[second[first]] << 21) + points[third[first]])


def squashed(text: str) -> str:
    """:func:`squash` of one text, outside of Spark."""
    if not text.isascii():
        return _GAP.sub(" ", text).strip(" ")
    short = text.encode().translate(_ONE_BLANK)
    while b"  " in short:
        short = short.replace(b"  ", b" ")
    return short.strip(b" ").decode()


def folded_gram_codes(folded: str) -> np.ndarray:
    """:func:`gram_codes` of one text, outside of Spark."""
    if not folded.isascii():
        return _gram_codes_of(f"  {squashed(folded)} ")
    units = np.frombuffer(f"  {squashed(folded)} ".encode(), dtype=np.uint8).astype(np.int32)
    # seven bits a character while they are sorted
    codes = np.sort((units[:-2] << 14) + (units[1:-1] << 7) + units[2:])
    codes = codes[np.diff(codes, prepend=-1) != 0].astype(np.int64)
    return (codes >> 14 << 42) + ((codes >> 7 & 127) << 21) + (codes & 127)


def gram_codes(folded: Column) -> Column:
    """``packed(trigram_set(text))`` of a folded text in rising order, without a string per character.

    The Arrow batch version works on code units side by side and is many times
    faster on long texts.  Pure ASCII rows have six white characters to look for,
    and a blank between words stays as it is.
    """
    short = F.trim(F.regexp_replace(folded, r"[\t\n\x0B\f\r ]{2,}|[\t\n\x0B\f\r]", " "))
    squashed = F.when(folded.rlike(r"[^\x00-\x7f]"), squash(folded)).otherwise(short)
    return F.pandas_udf(_gram_codes, "array<bigint>")(F.concat(F.lit("  "), squashed, F.lit(" ")))


def jaccard(left: Column, right: Column) -> Column:
    """Jaccard index of two sets given as duplicate-free arrays."""
    common = F.size(F.array_intersect(left, right))
    return (
        F.when((F.size(left) == 0) & (F.size(right) == 0), F.lit(1.0))
        .when((F.size(left) == 0) | (F.size(right) == 0), F.lit(0.0))
        .otherwise(common / (F.size(left) + F.size(right) - common))
    )


def dice(left: Column, right: Column) -> Column:
    """Dice coefficient of two sets given as duplicate-free arrays."""
    total = F.size(left) + F.size(right)
    return F.when(total == 0, F.lit(1.0)).otherwise(
        F.size(F.array_intersect(left, right)) * F.lit(2.0) / total
    )


def _folded_overlaps(left: pd.Series, right: pd.Series) -> pd.DataFrame:
    @lru_cache(maxsize=256)
    def sets(text: str) -> tuple[set[bytes], np.ndarray]:
        return folded_word_set(text), folded_gram_codes(text)

    found = []
    for a, b in zip(left, right, strict=True):
        (words, grams), (other_words, other_grams) = sets(a), sets(b)
        common, total = len(words & other_words), len(words) + len(other_words)
        both = np.sort(np.concatenate([grams, other_grams]))
        found.append((common / (total - common) if total else 1.0, int((both[1:] == both[:-1]).sum()) * 2.0 / len(both)))
    return pd.DataFrame(found, columns=["words", "grams"])


def folded_overlaps(left: Column, right: Column) -> Column:
    """Overlaps ``words`` (:func:`jaccard`) and ``grams`` (:func:`dice`) of two folded texts, whose sets are not moved."""
    return F.pandas_udf(_folded_overlaps, "words double, grams double")(left, right)


def listing_text(title: Column, description: Column) -> Column:
    """Title and description without white space at the ends. Pure ASCII rows need no search for it."""
    joined = F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(description, F.lit("")))
    return F.when(joined.rlike(r"[^\x00-\x7f]"), trim_blank(joined)).otherwise(F.btrim(joined, F.lit("\t\n\x0b\f\r ")))


# Share of word overlap and of trigram overlap in the text score.
WORD_SHARE, TRIGRAM_SHARE = 0.6, 0.4


def text_similarity(
    left_blank: Column, right_blank: Column, word_overlap: Column, trigram_overlap: Column
) -> Column:
    """Blend of both overlaps; blank texts match only each other."""
    return (
        F.when(left_blank & right_blank, F.lit(1.0))
        .when(left_blank | right_blank, F.lit(0.0))
        .otherwise(F.lit(WORD_SHARE) * word_overlap + F.lit(TRIGRAM_SHARE) * trigram_overlap)
    )


def contains_folded(folded_haystack: Column, keyword: Column) -> Column:
    """Keyword test on an already folded text; a blank keyword never matches."""
    needle = trim_blank(fold(keyword))
    return (needle != "") & F.contains(folded_haystack, needle)


def contains_keyword(haystack: Column, keyword: Column) -> Column:
    return contains_folded(fold(haystack), keyword)


def split_keywords(text: Column) -> Column:
    """Comma-separated words, trimmed, empties dropped; null gives an empty array."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), ","), trim_blank)
    return F.filter(parts, lambda p: p != "")


def capitalise(word: Column) -> Column:
    return F.concat(F.upper(F.substring(word, 1, 1)), F.substring(word, 2, 1 << 30))
