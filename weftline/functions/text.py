"""Text expressions that stay in the JVM: numbers in text, folding, terms, bigram overlap."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python's str.split sees it; Java's \s alone is ASCII.
SPACE = r"[\s\p{Z}]"
NUMBER = r"-?[0-9][0-9,]*\.?[0-9]*"


def to_num(value: Column) -> Column:
    """The first number in a text as double, thousands commas removed; null if there is none."""
    found = F.nullif(F.regexp_extract(value.cast("string"), NUMBER, 0), F.lit(""))
    return F.replace(found, F.lit(","), F.lit("")).try_cast("double")


def folded(value: Column) -> Column:
    """Without any white space."""
    return F.regexp_replace(value, f"{SPACE}+", "")


def collapsed(value: Column) -> Column:
    """Key canonicalisation: null is empty, ends stripped, runs of white space one space; case stays."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(value.cast("string"), F.lit("")), f"{SPACE}+", " "), r"^ | $", "")


def stripped(value: Column) -> Column:
    return F.regexp_replace(value, f"^{SPACE}+|{SPACE}+$", "")


def has_text(value: Column, needle: str) -> Column:
    """Case-insensitive substring test; false where the value is null."""
    return F.coalesce(F.contains(F.lower(value.cast("string")), F.lit(needle.lower())), F.lit(False))


def tokens(value: Column, separators: str = "[;,]") -> Column:
    """Different lower-cased, trimmed, non-empty parts of a delimited text; never null."""
    parts = F.transform(F.split(F.lower(F.coalesce(value.cast("string"), F.lit(""))), separators), stripped)
    return F.array_distinct(F.filter(parts, lambda x: x != ""))


def char_grams(value: Column, n: int) -> Column:
    """All windows of n code points, repeats kept; empty for shorter texts and null. Linear: nothing that reads the whole text stands in a lambda, where it would run once for each window."""
    text = F.coalesce(value, F.lit(""))
    last = F.char_length(text) - n + 1
    chars = F.split(text, "")
    grams = chars
    for i in range(1, n):
        grams = F.zip_with(grams, F.slice(chars, i + 1, F.char_length(text)), lambda a, b: F.concat(a, b))
    return F.when(last >= 1, F.slice(grams, 1, last)).otherwise(F.array().cast("array<string>"))


def terms(value: Column) -> Column:
    """different code points and neighbouring pairs of the text without white space."""
    text = folded(F.coalesce(value, F.lit("")))
    return F.array_union(char_grams(text, 1), char_grams(text, 2))


def multiset_overlap(a: Column, b: Column) -> Column:
    """Size of the multiset intersection of two arrays."""
    count = lambda xs, g: F.size(F.filter(xs, lambda x: x == g))
    return F.aggregate(F.array_intersect(a, b), F.lit(0), lambda n, g: n + F.least(count(a, g), count(b, g)))


def char_bigram_f1(a: Column, b: Column) -> Column:
    """F1 of multiset character bigrams of folded texts; 1 if neither has any, 0 if one has none."""
    x, y = char_grams(folded(a), 2), char_grams(folded(b), 2)
    both = F.size(x) + F.size(y)
    f1 = 2.0 * multiset_overlap(x, y) / F.greatest(both, F.lit(1))
    return F.when(both == 0, F.lit(1.0)).otherwise(f1)


def numbers_grounded(statement: Column, source: Column) -> Column:
    """Every number of the statement occurs in the source."""
    found = F.regexp_extract_all(F.coalesce(statement, F.lit("")), F.lit(r"(\d+(?:\.\d+)?)"), F.lit(1))
    return F.forall(found, lambda x: F.contains(F.coalesce(source, F.lit("")), x))


def any_keyword(value: Column, keywords: Sequence[str]) -> Column:
    out = F.lit(False)
    for k in keywords:
        out = out | has_text(value, k)
    return out
