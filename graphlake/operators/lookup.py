"""Ranked search for declarations by name."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphlake.functions.text import is_external, is_private_like, is_support_path, is_test_path, subwords

# Patterns of words in a query and the kinds of declarations that they ask for.
KIND_WORDS = {
    r"methods?": ["method", "constructor"],
    r"functions?": ["function", "method", "variable"],
    r"class(es)?": ["class"],
    r"interfaces?": ["interface"],
    r"types?": ["type"],
    r"variables?|const|let": ["variable"],
}
# Words that ask for tests and generated code, and for what is internal.
SUPPORT_WORDS = "test tests spec fixture fixtures sample samples example examples generated build dist".split()
INTERNAL_WORDS = "internal private implementation impl".split()
_NAME = r"[A-Za-z_$][A-Za-z0-9_$]*"
#: Names that a query spells out: between backticks, before the word for a kind, and dotted.
_CODE = (re.compile(r"`([^`]+)`"), re.compile(rf"\b({_NAME})\s+(?:method|function|class|interface|type|variable)\b", re.I | re.A), re.compile(rf"\b({_NAME}(?:\.{_NAME})+)\b", re.A))


def query_words(query: str) -> list[str]:
    """The lower-case words of a query, as names are split."""
    humps = re.sub(r"([A-Z]+)([A-Z][a-z])", r"\1 \2", re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", query))
    return [w.lower() for w in re.split(r"[^a-zA-Z0-9]+", humps) if w]


def code_terms(query: str) -> list[str]:
    """Names that a query spells out, lower-cased, each once."""
    found = [m[1].strip().lower() for pattern in _CODE for m in pattern.finditer(query)]
    return list(dict.fromkeys(t for t in found if re.fullmatch(rf"{_NAME}(\.{_NAME})*", t)))


# Kinds of declarations whose id a question may hold.
MENTIONED = "class interface type enum function method variable property field constructor".split()


def mentions(query: str) -> tuple[list[str], list[str]]:
    """Ids and names that a question holds: words that look like the id of a declaration; names between backticks, and dotted ones."""
    ids, names = [], []
    shape = re.compile(rf"[^\s#]+#[^\s#]+:({'|'.join(MENTIONED)})")
    bare = lambda t: re.sub(r"[`\"',.;:)\]}]+$", "", re.sub(r"^[`\"'(\[{]+", "", t.strip()))
    for word in query.split():
        if shape.fullmatch(bare(word)):
            ids.append(bare(word))
    for m in _CODE[0].finditer(query):
        if shape.fullmatch(bare(m[1])):
            ids.append(bare(m[1]))
        elif re.fullmatch(rf"{_NAME}(\.{_NAME})*", m[1].strip()):
            names.append(m[1].strip())
    names += [m[1] for m in _CODE[2].finditer(query)]
    return list(dict.fromkeys(ids)), list(dict.fromkeys(names))


def spells_out(query: str) -> bool:
    """Whether a question names code: something between backticks, or a dotted name."""
    return any(_CODE[i].search(query) for i in (0, 2))


def _has(query: str, words: str) -> bool:
    return re.search(rf"\b({words})\b", query.lower(), re.A) is not None


def asked_kinds(query: str) -> list[str]:
    return sorted({k for words, kinds in KIND_WORDS.items() if _has(query, words) for k in kinds})


def score(nodes: DataFrame, degree: DataFrame, query: str, include_external: bool = False) -> DataFrame:
    """``id``, ``file`` and ``score`` (a whole number) of the nodes that match.

    One select over the nodes: the query's terms are constants of the
    expression, and degrees are joined after nodes without a match are gone. A
    term that stands twice in the query counts twice.
    """
    terms, codes, kinds, whole = query_words(query), code_terms(query), asked_kinds(query), query.strip().lower()
    if not terms:
        return nodes.select("id", "file", F.lit(0).cast("long").alias("score")).limit(0)
    name, full = F.lower("name"), F.lower(F.coalesce("qualified_name", "name"))
    # The words of a name are kept with the snapshot where it has them.
    words = lambda column, text: F.col(column) if column in nodes.columns else subwords(text)

    def points(*cases: tuple[Column, float]) -> Column:
        out = F.lit(0.0)
        for cond, value in reversed(cases):
            out = F.when(cond, F.lit(float(value))).otherwise(out)
        return out

    base = points(
        ((name == whole) | (full == whole), 100),
        (F.contains(full, F.lit(".")) & F.contains(F.lit(whole), full), 85),
        (F.lit("." in whole) & F.contains(full, F.lit(whole)), 60),
    )
    for code in codes:
        base = base + points(((name == code) | (full == code), 110), (F.endswith(full, F.lit("." + code)), 95), (F.lit("." in code) & F.endswith(full, F.lit(code)), 85))
    covered = F.lit(True)
    for term in terms:
        inside = F.array_contains("__nw", term) | F.array_contains("__fw", term) | F.contains(name, F.lit(term))
        base = base + points((F.array_contains("__nw", term), 12), (F.array_contains("__fw", term), 8), (F.contains(name, F.lit(term)), 5), (F.array_contains("__pw", term), 3))
        covered = covered & inside
    base = base + F.when(covered, 10.0).otherwise(0.0) + F.when(F.startswith(name, F.lit(terms[0])), 4.0).otherwise(0.0)
    if kinds:
        base = base + F.when(F.col("kind").isin(kinds), 16.0).otherwise(0.0)
    own = nodes.filter(F.col("kind") != "file")
    if not include_external:
        own = own.filter(~is_external(F.col("external"), F.col("file")))
    full_name = F.coalesce("qualified_name", "name")
    own = own.withColumns({"__nw": words("name_words", F.col("name")), "__fw": words("full_words", full_name), "__pw": words("path_words", F.col("file"))})
    own = own.withColumn("base", base).filter("base > 0")
    joined = own.join(degree.select("id", (F.col("in_real") + F.col("out_real")).alias("d"), "export_fan_in"), "id", "left").fillna(0, ["d", "export_fan_in"])
    value = F.col("base") + F.least(F.lit(8.0), 2 * F.log2(1 + F.col("d")))
    value = value * (1 + F.least(F.lit(0.4), 0.14 * F.log2(1 + F.col("export_fan_in"))))
    value = value * F.when(F.col("ignored"), 0.3).otherwise(1.0) * F.when(is_test_path(F.col("file")), 0.7).otherwise(1.0)
    if not _has(query, "|".join(SUPPORT_WORDS)):
        value = value * F.when(is_support_path(F.col("file")), 0.35).otherwise(1.0)
    if not _has(query, "|".join(INTERNAL_WORDS)) and not any(c.startswith("_") or "internal" in c for c in codes):
        internal = is_private_like(full_name) | F.arrays_overlap("__fw", F.array(F.lit("internal"), F.lit("internals")))
        value = value * F.when(internal, 0.82).otherwise(1.0)
    return joined.select("id", "file", F.floor(F.round(value, 6) + 0.5).cast("long").alias("score"))


def with_words(nodes: DataFrame) -> DataFrame:
    """Nodes with the words of their names and paths, which a snapshot keeps so that a search does not split them again."""
    full = F.coalesce("qualified_name", "name")
    return nodes.withColumns({"name_words": subwords(F.col("name")), "full_words": subwords(full), "path_words": subwords(F.col("file"))})


def top(scored: DataFrame, limit: int = 5, per_file: int = 3) -> DataFrame:
    """The best, no more than ``per_file`` of one file."""
    rank = F.row_number().over(W.partitionBy("file").orderBy(F.desc("score"), "id"))
    return scored.withColumn("r", rank).filter(F.col("r") <= per_file).drop("r").orderBy(F.desc("score"), "id").limit(limit)


def lookup(nodes: DataFrame, degree: DataFrame, query: str, limit: int = 5, include_external: bool = False) -> DataFrame:
    """The best matches of a query; at most 6."""
    return top(score(nodes, degree, query, include_external), max(1, min(6, limit)))
