"""Comments and literals blanked, with every offset kept.

A single pass over the text with a table for each language: what begins a line
comment, what encloses a block comment, what encloses a string, and whether
strings may span lines. Literals that a table cannot hold (heredocs, percent
literals, regular expressions, long brackets, templates with code in them) have a
rule each. Replaced characters become blanks; line ends stay.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache


@dataclass(frozen=True)
class Lexicon:
    line: tuple[str, ...] = ("//",)
    block: tuple[tuple[str, str], ...] = (("/*", "*/"),)
    strings: tuple[tuple[str, str, bool], ...] = (('"', '"', False), ("'", "'", False))  # begin, end, spans lines
    nested: bool = False


_TEMPLATE = ('"', '"', False), ("'", "'", False), ("`", "`", True)
_PLAIN = Lexicon()
LEXICONS: dict[str, Lexicon] = {
    "typescript": Lexicon(strings=_TEMPLATE),
    "go": Lexicon(strings=_TEMPLATE),
    "python": Lexicon(("#",), (), (('"""', '"""', True), ("'''", "'''", True), ('"', '"', False), ("'", "'", False))),
    "ruby": Lexicon(("#",), (("\n=begin", "\n=end"),)),
    "php": Lexicon(("//", "#"), strings=(('"', '"', True), ("'", "'", True))),
    "lua": Lexicon(("--",), (("--[[", "]]"),), (("[[", "]]", True), ('"', '"', False), ("'", "'", False))),
    "zig": Lexicon(("//",), (), (("\\\\", "\n", False), ('"', '"', False), ("'", "'", False))),
    "rust": Lexicon(strings=(('r#"', '"#', True), ('"', '"', True)), nested=True),
    "swift": Lexicon(strings=(('"""', '"""', True), ('"', '"', False)), nested=True),
    "kotlin": Lexicon(strings=(('"""', '"""', True), ('"', '"', False), ("'", "'", False)), nested=True),
    "scala": Lexicon(strings=(('"""', '"""', True), ('"', '"', False)), nested=True),
    "csharp": Lexicon(strings=(('@"', '"', True), ('"""', '"""', True), ('"', '"', False), ("'", "'", False))),
    "java": Lexicon(strings=(('"""', '"""', True), ('"', '"', False), ("'", "'", False))),
    "dart": Lexicon(strings=(("'''", "'''", True), ('"""', '"""', True), ('"', '"', False), ("'", "'", False)), nested=True),
}


_LONG = re.compile(r"(--)?\[(=*)\[")
_HEREDOC = {"ruby": re.compile(r"<<([~-]?)([\"'`]?)([A-Z_][A-Za-z0-9_]*)\2"), "php": re.compile(r"<<<()([\"']?)([A-Za-z_][A-Za-z0-9_]*)\2(?=\r?\n)")}
_PERCENT = re.compile(r"%[qQwWiIrsx]?([^A-Za-z0-9\s=])")
_CLOSERS = {"(": ")", "[": "]", "{": "}", "<": ">"}
#: What may stand before a slash that begins a regular expression.
_BEFORE_REGEX = re.compile(r"(^|[(,=:\[!&|?{};+\-*%^~<>]|\b(return|typeof|case|in|of|do|else|when|and|or|not|if|unless))\s*$")


def _long_bracket(text: str, i: int) -> tuple[int, int] | None:
    """Lua: the inside of a long string, or all of a long comment."""
    if m := _LONG.match(text, i):
        end = text.find(f"]{m[2]}]", m.end())
        inner = len(text) if end < 0 else end
        after = len(text) if end < 0 else end + 2 + len(m[2])
        return (i, after) if m[1] else (m.end(), inner)
    return None


def _heredocs(text: str, language: str) -> list[tuple[int, int]]:
    """The bodies of heredocs; several that begin on one line follow each other."""
    out, taken = [], 0
    pattern = _HEREDOC.get(language)
    for m in pattern.finditer(text) if pattern else ():
        if m.start() < taken and out and m.start() >= out[-1][0]:
            continue  # inside of a body
        line = text.find("\n", m.end())
        if line < 0:
            continue
        start = max(line + 1, taken)
        indent = r"[ \t]*" if m[1] or language == "php" else ""
        end = re.compile(rf"^{indent}{m[3]}\b", re.M).search(text, start)
        if end:
            out.append((start, end.start()))
            taken = text.find("\n", end.end()) + 1 or len(text)
    return out


def _percent(text: str, i: int) -> tuple[int, int] | None:
    """Ruby: the inside of a percent literal; brackets nest."""
    m = _PERCENT.match(text, i)
    if not m or re.search(r"[\w)\]}]\s*$", text[max(0, i - 20) : i]):
        return None
    opener, closer = m[1], _CLOSERS.get(m[1], m[1])
    depth, j = 1, m.end()
    while j < len(text):
        if text[j] == "\\":
            j += 1
        elif text[j] == closer:
            depth -= 1
            if not depth:
                return m.end(), j
        elif text[j] == opener:
            depth += 1
        j += 1
    return None


def _regex(text: str, i: int) -> tuple[int, int] | None:
    """The inside of a regular expression that begins at a slash; a slash in a class does not end it."""
    line = text.rfind("\n", 0, i) + 1
    if not _BEFORE_REGEX.search(text[line:i]):
        return None
    j, inside = i + 1, False
    while j < len(text) and text[j] != "\n":
        if text[j] == "\\":
            j += 1
        elif text[j] == "[":
            inside = True
        elif text[j] == "]":
            inside = False
        elif text[j] == "/" and not inside:
            return i + 1, j
        j += 1
    return None


def _template(text: str, i: int) -> tuple[list[tuple[int, int]], list[tuple[int, int]], int]:
    """A template from its backtick on: its literal parts, its code, and its end."""
    parts, code, j, at = [], [], i + 1, i + 1
    while j < len(text) and text[j] != "`":
        if text[j] == "\\":
            j += 2
        elif text.startswith("${", j):
            parts.append((at, j))
            depth, k = 1, j + 2
            while k < len(text) and depth:
                if text[k] == "`":
                    k = _template(text, k)[2]
                    continue
                depth += (text[k] == "{") - (text[k] == "}")
                k += 1
            code.append((j + 2, k - 1))
            j = at = k
        else:
            j += 1
    parts.append((at, min(j, len(text))))
    return parts, code, min(j + 1, len(text))


@lru_cache(64)
def _starts(language: str) -> re.Pattern:
    """Characters that may begin a comment or a literal; between them nothing is looked at."""
    lex = LEXICONS.get(language, _PLAIN)
    own = {"lua": "[-", "typescript": "`/", "ruby": "%/"}.get(language, "")
    first = {*own, *(a[0] for a, _ in lex.block), *(c[0] for c in lex.line), *(q[0][0] for q in lex.strings)}
    return re.compile("[" + "".join(map(re.escape, sorted(first))) + "]")


@lru_cache(4)  # a text is asked for more than once in a row
def mask(text: str, language: str) -> str:
    """The text with comments and literals as blanks, line ends kept."""
    lex = LEXICONS.get(language, _PLAIN)
    out, i, n = list(text), 0, len(text)
    starts = _starts(language)

    def blank(a: int, b: int) -> None:
        for k in range(a, min(b, n)):
            if out[k] != "\n":
                out[k] = " "

    bodies = dict(_heredocs(text, language))
    while i < n:
        if i not in bodies:
            m = starts.search(text, i)
            i = min([m.start() if m else n, *(k for k in bodies if k > i)])
            if i >= n:
                break
        if i in bodies:
            blank(i, bodies[i])
            i = max(bodies[i], i + 1)
            continue
        if language == "lua" and (long := _long_bracket(text, i)):
            blank(*long)
            i = max(long[1], i + 1)
            continue
        if language == "typescript" and text[i] == "`":
            parts, code, end = _template(text, i)
            for part in parts:
                blank(*part)
            for lo, hi in code:
                out[lo:hi] = mask(text[lo:hi], language)
            i = end
            continue
        if language == "ruby" and text[i] == "%" and (inner := _percent(text, i)):
            blank(*inner)
            i = inner[1] + 1
            continue
        if language in ("typescript", "ruby") and text[i] == "/" and text[i + 1 : i + 2] not in ("/", "*") and (inner := _regex(text, i)):
            blank(*inner)
            i = inner[1] + 1
            continue
        opened = next(((a, b) for a, b in lex.block if text.startswith(a, i)), None)
        if opened:
            a, b = opened
            depth, j = 1, i + len(a)
            while j < n and depth:
                if lex.nested and text.startswith(a, j):
                    depth, j = depth + 1, j + len(a)
                elif text.startswith(b, j):
                    depth, j = depth - 1, j + len(b)
                else:
                    j += 1
            blank(i, j)
            i = j
            continue
        if any(text.startswith(c, i) for c in lex.line):
            j = text.find("\n", i)
            j = n if j < 0 else j
            blank(i, j)
            i = j
            continue
        quote = next((q for q in lex.strings if text.startswith(q[0], i)), None)
        if quote:
            a, b, spans = quote
            j = i + len(a)
            while j < n and not text.startswith(b, j):
                if text[j] == "\\" and len(b) == 1 and a != "\\\\":
                    j += 1
                elif text[j] == "\n" and not spans:
                    break
                j += 1
            end = min(j + len(b), n) if text.startswith(b, j) and b != "\n" else j
            blank(i + len(a), j)
            i = max(end, i + 1)
            # A body that begins inside of a line's last string is met at its start.
            i = min([i, *(k for k in bodies if i > k >= j)])
            continue
        i += 1
    return "".join(out)
