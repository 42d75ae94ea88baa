"""What a file forwards from other files: barrels of TypeScript, Python and Rust."""

from __future__ import annotations

import posixpath
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The statements that forward, by language; a forwarded name is an ASCII identifier.
_STAR = re.compile(r"(?:^|[\n;])\s*export\s+\*\s+from\s+[\"']([^\"']+)[\"']")
_LISTED = re.compile(r"(?:^|[\n;])\s*export\s+(?:type\s+)?\{([^}]*)\}\s*from\s+[\"']([^\"']+)[\"']")
_FROM = re.compile(r"(?:^|\n)\s*from\s+(\.[A-Za-z0-9_.]*)\s+import\s+([^\n#]+)")
_USE = re.compile(r"(?:^|[\n;])\s*pub\s+use\s+([^;]+);")
_IDENTIFIER = re.compile(r"[A-Za-z_$][A-Za-z0-9_$]*")
# What a path without an end may stand for, in the order in which it is tried.
SUFFIXES = {
    "typescript": ["", ".ts", ".tsx", ".mts", ".cts", ".js", ".jsx", ".mjs", ".cjs", "/index.ts", "/index.tsx", "/index.js", "/index.jsx"],
    "python": [".py", "/__init__.py"],
    "rust": [".rs", "/mod.rs"],
}


def _listed(clause: str) -> list[str]:
    """Names of a list as the file that they come from spells them."""
    parts = (re.split(r"\s+as\s+", re.sub(r"^type\s+", "", p.strip()))[0].strip() for p in clause.split(","))
    return [p for p in parts if _IDENTIFIER.fullmatch(p)]


def reexports(language: str, file: str, text: str) -> list[tuple[str, list[str] | None]]:
    """Where a file forwards names from, and which; ``None`` are all."""
    if language == "typescript":
        found = [(m[1], None) for m in _STAR.finditer(text)]
        return found + [(m[2], names) for m in _LISTED.finditer(text) if (names := _listed(m[1]))]
    if language == "python" and posixpath.basename(file) == "__init__.py":
        out = []
        for m in _FROM.finditer(text):
            clause = m[2].strip()
            names = None if clause.startswith("*") else _listed(clause.removeprefix("(").removesuffix(")"))
            if names is None or names:
                out.append((m[1], names))
        return out
    if language == "rust":
        out = []
        for m in _USE.finditer(text):
            clause = m[1].strip()
            if group := re.fullmatch(r"(.*?)::\{([^}]*)\}", clause):
                if names := _listed(group[2]):
                    out.append((group[1], names))
                continue
            path, cut, last = re.split(r"\s+as\s+", clause)[0].strip().rpartition("::")
            if cut:
                out.append((path, None if last == "*" else [last]))
        return out
    return []


def module_paths(language: str, file: str, specifier: str) -> list[str]:
    """The paths that a specifier may stand for, without their ends, in the order in which they are tried."""
    here = posixpath.dirname(file)
    if language == "typescript":
        if not specifier.startswith("."):
            return []
        parts = here.split("/") if here else []
        for step in specifier.split("/"):
            if step == "..":
                parts = parts[:-1]
            elif step not in ("", "."):
                parts.append(step)
        return ["/".join(parts)]
    if language == "python":
        dots = len(specifier) - len(specifier.lstrip("."))
        if not dots:
            return []
        for _ in range(dots - 1):
            here = posixpath.dirname(here)
        return ["/".join(p for p in [here, *specifier[dots:].split(".")] if p)]
    if language == "rust":
        steps = [s.strip() for s in specifier.split("::")]
        steps = [s for s in steps if s and s != "crate"]
        folders, at = file.split("/"), 0
        root = "/".join(folders[: len(folders) - folders[::-1].index("src")]) if "src" in folders else ""
        if steps and steps[0] in ("self", "super"):
            root = here
            while at < len(steps) and steps[at] in ("self", "super"):
                root = posixpath.dirname(root) if steps[at] == "super" else root
                at += 1
        return ["/".join(p for p in [root, *steps[at:end]] if p) for end in range(len(steps), at, -1)]
    return []


def forwards(sources: DataFrame) -> DataFrame:
    """``file``, ``source``, ``name`` (null: all) of sources (file, language, text), as ``export_surface`` takes them.

    The specifiers are read in Arrow batches; which path is a file is a join.
    """

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for file, language, text in zip(part["file"], part["language"], part["text"], strict=True):
                for n, (specifier, names) in enumerate(reexports(language, file, text or "")):
                    tries = [p + end for p in module_paths(language, file, specifier) for end in SUFFIXES[language]]
                    rows.append((file, n, tries, names))
            yield pd.DataFrame(rows, columns=["file", "n", "tries", "names"])

    found = sources.select("file", "language", "text").mapInPandas(read, "file string, n int, tries array<string>, names array<string>")
    tried = found.select("file", "n", "names", F.posexplode("tries").alias("rank", "source"))
    hits = tried.join(sources.select(F.col("file").alias("source")).distinct(), "source", "left_semi")
    first = hits.groupBy("file", "n").agg(F.min_by(F.struct("source", "names"), "rank").alias("f")).filter("f.source <> file")
    null = F.array(F.lit(None).cast("string"))
    return first.select("file", F.col("f.source").alias("source"), F.explode(F.coalesce("f.names", null)).alias("name")).distinct()
