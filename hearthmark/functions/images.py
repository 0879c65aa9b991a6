"""Perceptual hashes: building them from luminance and comparing them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


# Luminance values of a 9x8 image, and what is said about any other number of them.
GRAY_VALUES = 72
GRAY_ERROR = "dHashFromGray9x8 attend 72 valeurs (9×8)."


def dhash_error(gray: Column) -> Column:
    """Message for an array that has no hash, null for others."""
    return F.when(gray.isNull() | (F.size(gray) != GRAY_VALUES), F.lit(GRAY_ERROR))


def dhash(gray: Column) -> Column:
    """16 hex digits from a 9x8 luminance array: is each pixel darker than its right one?

    Null for an array of any other size (see :func:`dhash_error`).
    """
    bits = F.transform(
        F.sequence(F.lit(0), F.lit(63)),
        lambda i: F.when(
            F.get(gray, F.floor(i / 8).cast("int") * 9 + i % 8)
            < F.get(gray, F.floor(i / 8).cast("int") * 9 + i % 8 + 1),
            F.lit("1"),
        ).otherwise(F.lit("0")),
    )
    return F.when(dhash_error(gray).isNull(), F.lpad(F.lower(F.conv(F.array_join(bits, ""), 2, 16)), 16, "0"))


def _digits(code: Column) -> Column:
    return F.transform(
        F.regexp_extract_all(F.lower(code), F.lit("(?s)(.)"), F.lit(1)),
        lambda d: (F.instr(F.lit("0123456789abcdef"), d) - 1),
    )


def hash_codes(hashes: Column) -> Column:
    """Hex hashes parsed once: length, 64-bit word (up to 16 digits) and text; invalid ones dropped."""
    valid = F.filter(hashes, lambda h: h.rlike("^[0-9a-fA-F]*$"))
    return F.transform(
        valid,
        lambda h: F.struct(
            F.length(h).alias("length"),
            F.when(F.length(h) == 0, F.lit(0)).when(F.length(h) <= 16, F.conv(h, 16, -10)).cast("bigint").alias("word"),
            F.lower(h).alias("text"),
        ),
    )


def _distance(left: Column, right: Column) -> Column:
    words = F.bit_count(left["word"].bitwiseXOR(right["word"]))
    by_digit = F.aggregate(
        F.zip_with(_digits(left["text"]), _digits(right["text"]), lambda a, b: F.bit_count(a.bitwiseXOR(b))),
        F.lit(0),
        lambda total, bits: total + bits,
    )
    same = left["length"] == right["length"]
    return F.when(same & (left["length"] <= 16), words).when(same, by_digit).cast("int")


def best_hamming(left: Column, right: Column) -> Column:
    """Smallest number of differing bits over all pairs of two parsed hash lists; null when none compares."""
    return F.array_min(F.flatten(F.transform(left, lambda a: F.transform(right, lambda b: _distance(a, b)))))


def hamming(left: Column, right: Column) -> Column:
    """Differing bits of two hex hashes; null when they cannot be compared."""
    return best_hamming(hash_codes(F.array(left)), hash_codes(F.array(right)))


def image_similarity(left: Column, right: Column, bits: int = 64) -> Column:
    """Best closeness over two parsed hash lists (see :func:`hash_codes`); null when none compares."""
    near = F.lit(1.0) - best_hamming(left, right) / F.lit(float(bits))
    return F.when(near < 0, F.lit(0.0)).otherwise(near)
