"""Functions on source lines and ids that have no form in SQL; Arrow batches."""

from __future__ import annotations

import json
import re
from urllib.parse import quote

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAFE = "!'()*-._~"  # fixed value: what URI components leave as it is, beside letters and digits


def doc_text(lines: list[str], line: int) -> str | None:
    """The first sentence of the doc comment right above a line (from 1), 200 characters at most."""
    i = line - 2
    while i >= 0 and not lines[i].strip():
        i -= 1
    if i < 0 or not lines[i].rstrip().endswith("*/"):
        return None
    end = i
    while i >= 0 and "/**" not in lines[i]:
        if "/*" in lines[i]:
            return None
        i -= 1
    if i < 0:
        return None
    body = "\n".join(lines[i : end + 1])
    body = body[body.index("/**") + 3 :].rsplit("*/", 1)[0]
    prose = []
    for part in body.split("\n"):
        part = re.sub(r"^\s*\*? ?", "", part).strip()
        if part.startswith("@"):
            break
        prose.append(part)
    text = re.sub(r"\s+", " ", " ".join(prose)).strip()
    if not text:
        return None
    m = re.search(r"[.!?](?=\s|$)", text)
    text = text[: m.end()] if m else text
    return text if len(text) <= 200 else text[:200] + "…"


def signature_text(signature: str | None, lines: list[str], line: int | None) -> str | None:
    """A declaration's own signature, else up to four lines of its source, up to a brace or semicolon."""
    if signature and signature.strip():
        return signature
    if not line or line > len(lines):
        return None
    out = []
    for text in lines[line - 1 : line + 3]:
        out.append(text.strip())
        if "{" in text or text.rstrip().endswith(";"):
            break
    return " ".join(x for x in out if x) or None


def describe(nodes: DataFrame, sources: DataFrame) -> DataFrame:
    """``id``, ``doc``, ``signature`` of nodes (id, file, line, signature) from consistent sources (file, text)."""

    def run(parts):
        for part in parts:
            rows = []
            for id_, text, line, signature in zip(part["id"], part["text"], part["line"], part["signature"], strict=True):
                lines = text.split("\n") if isinstance(text, str) else []
                at = None if pd.isna(line) else int(line)
                rows.append((id_, doc_text(lines, at) if at else None, signature_text(signature, lines, at)))
            yield pd.DataFrame(rows, columns=["id", "doc", "signature"])

    joined = nodes.select("id", "file", "line", "signature").join(sources.select("file", "text"), "file", "left")
    return joined.select("id", "text", "line", "signature").mapInPandas(run, "id string, doc string, signature string")


def encode_component(text: Column) -> Column:
    """The text as a URI component."""

    @F.pandas_udf("string")
    def encoded(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else quote(t, safe=SAFE))

    return encoded(text)


def decorators_of(decorators: Column) -> Column:
    """A declaration's decorators, or null for none."""
    return F.when(F.size(decorators) > 0, decorators)


def canonical_json(value) -> str:
    """Keys sorted, nothing between the parts, nulls of objects left out."""

    def clean(x):
        if isinstance(x, dict):
            return {k: clean(v) for k, v in x.items() if v is not None}
        return [clean(v) for v in x] if isinstance(x, list | tuple) else x

    return json.dumps(clean(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def escape_part(text: str) -> str:
    return text.replace("\\", "\\\\").replace("#", "\\#")


def write_id(file: str, name: str, kind: str) -> str:
    return f"{escape_part(file)}#{escape_part(name)}:{kind}"


def parse_id(node_id: str) -> tuple[str, str, str] | None:
    """File, name and kind of an id: at the first # that is not escaped, and the last colon."""
    i = 0
    while i < len(node_id) and node_id[i] != "#":
        i += 2 if node_id[i] == "\\" else 1
    if i >= len(node_id):
        return None
    rest, unescape = node_id[i + 1 :], lambda t: re.sub(r"\\(.)", r"\1", t)
    at = rest.rfind(":")
    return None if at < 0 else (unescape(node_id[:i]), unescape(rest[:at]), rest[at + 1 :])
