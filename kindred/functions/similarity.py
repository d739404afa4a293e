"""Trigram and bigram similarity as column expressions. Sets of grams are arrays of numbers, to be made once per record and not per pair."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def code(gram: Column) -> Column:
    """A text of up to three characters as a number: texts are equal if and only if their numbers are."""
    at = lambda k: F.ascii(F.substring(gram, k, 1)).cast("long")
    return F.shiftleft(at(1), 42).bitwiseOR(F.shiftleft(at(2), 21)).bitwiseOR(at(3))


def trigrams(c: Column) -> Column:
    """Distinct 3-grams of the words of a folded text, each word padded by two spaces before and one after."""
    words = F.filter(F.split(c, "[^\\p{L}\\p{N}]+"), lambda w: w != "")
    return F.array_distinct(F.flatten(F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3))))))


def trigram_codes(c: Column) -> Column:
    return F.transform(trigrams(c), code)


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard of two arrays of distinct values; 0 if both are empty."""
    both = F.size(F.array_intersect(a, b))
    return F.coalesce(F.try_divide(both, F.size(a) + F.size(b) - both), F.lit(0.0))


def similarity(a: Column, b: Column) -> Column:
    return jaccard(trigrams(a), trigrams(b))


def bigrams(c: Column) -> Column:
    """Pairs of neighbouring characters, repeats kept."""
    return F.when(F.length(c) >= 2, F.transform(F.sequence(F.lit(1), F.length(c) - 1), lambda i: F.substring(c, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), value being made once however often f names it: as the element of an array."""
    return F.transform(F.array(value), f)[0]


def bigram_codes(c: Column) -> Column:
    """The multiset of bigrams as a set: the number of each and which occurrence it is, so that shared occurrences are what two sets share."""
    # Sorted, equal numbers stand together; the place within them is the distance from their first.
    tag = lambda s: F.transform(s, lambda v, i: v + (i + 1 - F.array_position(s, v)))
    return bound(c, lambda t: bound(F.sort_array(F.transform(bigrams(t), code)), tag))


def dice_of(a: Column, b: Column, x: Column, y: Column) -> Column:
    """Dice of the texts a and b from their bigram_codes x and y; 1 for equal texts, else 0 for texts under two characters."""
    return F.when(a == b, F.lit(1.0)).when((F.length(a) < 2) | (F.length(b) < 2), F.lit(0.0)).otherwise(F.lit(2.0) * F.size(F.array_intersect(x, y)) / (F.size(x) + F.size(y)))


def dice(a: Column, b: Column) -> Column:
    """Dice coefficient of the bigram multisets, for a single pair; where a text meets many others, make bigram_codes once and use dice_of."""
    return bound(F.struct(a.alias("a"), b.alias("b")), lambda t: dice_of(t["a"], t["b"], bigram_codes(t["a"]), bigram_codes(t["b"])))
