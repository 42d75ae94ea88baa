"""Scalar functions on names and paths, as column expressions.

Word characters and blanks are ASCII where the rules they follow are: the classes
are spelled out instead of ``\\w`` and ``\\b``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Suffixes that a stem loses, the longest first.
SUFFIXES = ["ation", "ing", "ment", "ence", "ance", "ion", "ity", "ed", "es", "s"]
# What makes a path a test, and what makes it support rather than product code.
TEST_PATH = (
    r"(^|/)(test|tests|__tests__|spec)/",
    r"(^|/)[A-Za-z0-9_]*Test/",
    r"\.(test|spec)\.[^/]+$",
    r"(^|/)test[-_][^/]+\.[^/]+$",
    r"_test\.[^/]+$",
)
SUPPORT_PATH = (
    r"^bundled://",
    r"(^|/)(deps|node_modules|vendor|site-packages)/",
    r"(^|/)(test|tests|__tests__|spec|sample|samples|fixture|fixtures|__fixtures__|example|examples)/",
    r"\.(test|spec)\.[^/]+$",
    r"_test\.[^/]+$",
    r"(^|/)typings\.[cm]?ts$",
    r"\.d\.[cm]?ts$",
    r"(^|/)(dist|build|coverage|generated|__generated__|gen)/",
)
EXTERNAL_PATH = r"^bundled://|(^|/)(node_modules|vendor|site-packages)/"


def subwords(text: Column) -> Column:
    """Lower-case words of a name: camel humps, runs of capitals, digits stay with their word."""
    humps = F.regexp_replace(F.regexp_replace(text, r"([a-z0-9])([A-Z])", "$1 $2"), r"([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.transform(F.filter(F.split(humps, "[^a-zA-Z0-9]+"), lambda w: F.length(w) > 0), F.lower)


def _any(path: Column, patterns: tuple[str, ...]) -> Column:
    return F.rlike(path, F.lit("|".join(f"(?:{p})" for p in patterns)))


def is_test_path(path: Column) -> Column:
    return _any(path, TEST_PATH)


def is_support_path(path: Column) -> Column:
    return (path == "") | _any(path, SUPPORT_PATH)


def is_public_api_noise(path: Column) -> Column:
    return is_support_path(path) | F.rlike(path, F.lit(r"(^|/|\.)typings\.[cm]?ts$|(^|/)internal/"))


def is_external(external: Column, path: Column) -> Column:
    return F.coalesce(external, F.lit(False)) | F.rlike(path, F.lit(EXTERNAL_PATH))


def stem_word(word: Column) -> Column:
    """A word without its first matching suffix (of which more than three letters stay), then without a final e."""
    cut = word
    for suffix in reversed(SUFFIXES):
        fits = F.endswith(word, F.lit(suffix)) & (F.length(word) > len(suffix) + 3)
        cut = F.when(fits, F.substring(word, F.lit(1), F.length(word) - len(suffix))).otherwise(cut)
    ends = F.endswith(cut, F.lit("e")) & (F.length(cut) > 4)
    return F.when(ends, F.substring(cut, F.lit(1), F.length(cut) - 1)).otherwise(cut)


def matched_terms(words: Column, terms: Column) -> Column:
    """The terms that a word equals, shares the stem of, or shares the first six letters of the stem with."""

    def alike(word: Column, term: Column) -> Column:
        a, b = stem_word(word), stem_word(term)
        long = (F.length(a) >= 6) & (F.length(b) >= 6) & (F.substring(a, 1, 6) == F.substring(b, 1, 6))
        return (word == term) | (a == b) | long

    return F.filter(terms, lambda t: F.exists(words, lambda w: alike(w, t)))


def is_production(external: Column, ignored: Column, path: Column) -> Column:
    """What a tour is about: neither external, ignored, a test nor support."""
    return ~F.coalesce(external, F.lit(False)) & ~F.coalesce(ignored, F.lit(False)) & ~is_test_path(path) & ~is_support_path(path)


def is_private_like(name: Column) -> Column:
    """Names that begin with an underscore, or whose member does."""
    return F.startswith(name, F.lit("_")) | F.contains(name, F.lit("._"))


def dirname(path: Column) -> Column:
    return F.when(F.contains(path, F.lit("/")), F.regexp_extract(path, r"^(.*)/[^/]*$", 1)).otherwise(F.lit(""))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def file_stem(path: Column) -> Column:
    return F.lower(F.regexp_replace(basename(path), r"(.)\.[^.]*$", "$1"))


def shared_path_depth(a: Column, b: Column) -> Column:
    """How many leading folders two paths share."""
    x, y = F.split(a, "/"), F.split(b, "/")
    n = F.least(F.size(x), F.size(y)) - 1
    same = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.slice(x, 1, i) == F.slice(y, 1, i))
    return F.when(n > 0, F.size(F.filter(same, lambda s: s))).otherwise(F.lit(0))


def callable_base(name: Column) -> Column:
    """The text before the first parenthesis, unless the name begins with it."""
    at = F.instr(name, "(")
    return F.when(at > 1, F.rtrim(F.substring(name, F.lit(1), at - 1))).otherwise(name)


def member_key(name: Column) -> Column:
    return F.trim(F.regexp_replace(name, r"\s+", " "))


def owner_key(name: Column) -> Column:
    """The dotted name without its last part; null for a name of one part."""
    return F.when(F.contains(name, F.lit(".")), F.regexp_extract(name, r"^(.*)\.[^.]*$", 1))
