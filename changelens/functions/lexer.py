"""Literals whose end a single pattern cannot find: code inside strings, and JavaScript's regular expressions.

A small lexer with a stack of modes walks over such a file once; all other files are blanked by patterns. A mode is code (with the number of brackets that are open in
it) or the text of a template string or formatted string. Code inside of such a string stays code: its braces become parentheses, so that no block opens.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from changelens.functions.text import ColumnLike, as_column

_JS = re.compile(r"""//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)|"(?:[^"\\\n]|\\[\s\S])*"|'(?:[^'\\\n]|\\[\s\S])*'|[`{}/]""")
_JS_TEXT = re.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*")
_JS_PATTERN = re.compile(r"/(?![*/])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")
#: After these words a slash begins a regular expression, after other words it divides.
_BEFORE_PATTERN = {"return", "typeof", "case", "in", "of", "delete", "void", "throw", "new", "else", "do", "instanceof", "yield", "await"}
_PY = re.compile(r"""#[^\n]*|(?:(?<!\w)((?i:[bruf]{1,2})))?("{3}|'{3}|"|')|[()\[\]{}:!]""")
_PY_REST = {
    '"': re.compile(r'(?:[^"\\\n]|\\[\s\S])*"'), "'": re.compile(r"(?:[^'\\\n]|\\[\s\S])*'"),
    '"""': re.compile(r'[\s\S]*?(?:(?<!\\)"""|\Z)'), "'''": re.compile(r"[\s\S]*?(?:(?<!\\)'''|\Z)"),
}
Spans = Iterator[tuple[int, int, str]]


def _javascript(text: str) -> Spans:
    """(start, end, class): c comment, s string, ( and ) the edges of code inside a template."""
    open_braces, at = [0], 0
    while found := _JS.search(text, at):
        at, piece = found.end(), found[0]
        if piece[0] in "\"'":
            yield found.start(), at, "s"
        elif piece[:2] in ("//", "/*"):
            yield found.start(), at, "c"
        elif piece == "/":
            pattern = _JS_PATTERN.match(text, found.start()) if _pattern_follows(text, found.start()) else None
            if pattern:
                at = pattern.end()
                yield found.start(), at, "s"
        elif piece == "{":
            open_braces[-1] += 1
        elif piece == "`" or (piece == "}" and open_braces[-1] == 0 and len(open_braces) > 1):
            if piece == "}":
                open_braces.pop()
                yield found.start(), at, ")"
            start = found.start() if piece == "`" else at
            at = _JS_TEXT.match(text, at).end()
            if text.startswith("${", at):
                yield start, at, "s"
                yield at, at + 2, "("
                at += 2
                open_braces.append(0)
            else:
                at = min(at + 1, len(text))
                yield start, at, "s"
        elif piece == "}":
            open_braces[-1] = max(0, open_braces[-1] - 1)


def _pattern_follows(text: str, at: int) -> bool:
    before = text[max(0, at - 40) : at].rstrip()
    if not before:
        return True
    word = re.search(r"[\w$]+$", before)
    return word[0] in _BEFORE_PATTERN if word else before.endswith("=>") or before[-1] not in ")]}\"'`<>.$"


def _python(text: str) -> Spans:
    modes: list[list] = []  # [delimiter, open brackets] of the formatted strings whose code is read
    at = 0
    while found := _PY.search(text, at):
        at, quote = found.end(), found[2]
        if quote and "f" not in (found[1] or "").lower():
            rest = _PY_REST[quote].match(text, at)
            if rest:
                at = rest.end()
                yield found.start(2), at, "s"
        elif quote:
            at = yield from _formatted(text, found.start(2), at, quote, modes, False)
        elif found[0][0] == "#":
            yield found.start(), at, "c"
        elif modes:
            piece, mode = found[0], modes[-1]
            if piece in "([{":
                mode[1] += 1
            elif piece in ")]}" and mode[1] > 0:
                mode[1] -= 1
            elif piece == "}":
                modes.pop()
                yield found.start(), at, ")"
                at = yield from _formatted(text, at, at, mode[0], modes, mode[2])
            elif mode[1] == 0 and (piece == ":" or (piece == "!" and text[at : at + 1] in "rsa" and text[at + 1 : at + 2] in ":}")) and text[at : at + 1] != "=":
                modes.pop()
                at = yield from _formatted(text, found.start(), at, mode[0], modes, mode[2], True)


def _formatted(text: str, start: int, at: int, quote: str, modes: list[list], nested: bool, spec: bool = False):
    """The text of a formatted string from ``at`` to its end or to the next code in it; where to go on is returned. ``spec``: behind the colon of a field."""
    multi = len(quote) == 3
    while at < len(text):
        if text.startswith(quote, at):
            yield start, at + len(quote), "s"
            return at + len(quote)
        here = text[at]
        if here == "\\":
            at += 2
        elif here == "{" and text.startswith("{{", at) and not spec:
            at += 2
        elif here == "{":
            yield start, at, "s"
            yield at, at + 1, "("
            modes.append([quote, 0, spec])
            return at + 1
        elif here == "}" and spec:
            yield start, at, "s"
            yield at, at + 1, ")"
            start, at, spec = at + 1, at + 1, False
        elif here == "\n" and not multi:
            break
        else:
            at += 1
    yield start, at, "s"
    return at


def blank(text: str, spans: Spans, keep_strings: bool) -> str:
    """Comments become spaces, strings quotes (``~`` first on continued lines), edges of inner code parentheses. Positions do not move."""
    out, last = [], 0
    for start, end, kind in spans:
        piece = text[start:end]
        if kind == "c":
            made = re.sub(r"[^\n]", " ", piece)
        elif kind == "s":
            made = piece if keep_strings else re.sub(r'\n"', "\n~", re.sub(r"[^\n]", '"', piece))
        else:
            made = piece if keep_strings else ('"(' if len(piece) == 2 else kind)
        out += (text[last:start], made)
        last = end
    return "".join(out) + text[last:]


_LEXED = StructType([StructField("blanked", StringType()), StructField("commentless", StringType())])


@F.pandas_udf(_LEXED)
def _lexed(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for texts, families in batches:
        rows = []
        for text, family in zip(texts, families):
            spans = None if text is None else list(_javascript(text) if family == "js" else _python(text))
            rows.append((None, None) if spans is None else (blank(text, spans, False), blank(text, spans, True)))
        yield pd.DataFrame(rows, columns=["blanked", "commentless"])


def needs_lexer(content: ColumnLike, family: ColumnLike) -> Column:
    """Whether a file holds code inside strings, or a slash that can begin a regular expression."""
    content, family = as_column(content), as_column(family)
    js = content.rlike(r"\$\{") | content.rlike(r"(?:^|[=(,:\[!&|?{};+*%~^>-]|\b(?:return|typeof|case|in|of|delete|void|throw|new|else|do|instanceof|yield|await))\s*/(?![/*])[^\n]*/")
    return F.when(family == "js", js).when(family == "python", content.rlike(r"(?i)\b(?:f|rf|fr)[\"']")).otherwise(F.lit(False))


def lexed(content: ColumnLike, family: ColumnLike) -> Column:
    """struct<blanked, commentless> of the files that need it, null for the others."""
    content = as_column(content)
    return _lexed(F.when(needs_lexer(content, family), content), as_column(family))
