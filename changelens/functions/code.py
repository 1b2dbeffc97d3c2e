"""Definitions, references and imports of one source file, computed inside its row.

A file is one cell of bounded size (``snapshot_max_file_bytes``), so nothing here shuffles: literals are blanked first
(same length, same line breaks), then one pass over the lines or statements tracks the open blocks. This is a line
operator, not a parser; see the README for what it does not see.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from changelens import rules
from changelens.functions import paths
from changelens.functions.text import as_column, built_once, ColumnLike, let

DEFINITION = (
    "struct<name:string,kind:string,start_line:int,end_line:int,signature_end_line:int,container:string>"
)
REFERENCE = "struct<name:string,line:int,kind:string>"
IMPORT = "struct<spec:string,names:array<string>,level:int,wildcard:boolean,static:boolean,line:int,end_line:int>"
MAX_INT = 2147483647

# part, family, place -> pattern. A string is a quoted piece; what is no comment, no quote and no plain run is a piece of one character.
_DOUBLE, _SINGLE = r'"[^"\\\n]*+(?:\\[\s\S][^"\\\n]*+)*+"', r"'[^'\\\n]*+(?:\\[\s\S][^'\\\n]*+)*+'"
_BLOCK = r'"""[\s\S]*?(?:"""|\z)'


@dataclass(frozen=True)
class Family:
    """How the languages of a family are read. Headers and statements are (kind, pattern, only inside a type); the name is the pattern's second group.

    ``layout``: ``indent`` as in Python, ``braces`` as in Java, ``lines`` as in JavaScript, where a line break may end a statement.
    """

    layout: str
    comments: tuple[str, ...]
    quoted: tuple[str, ...]
    plain: str = r"[\w \t\n]++"
    headers: tuple[tuple[str, str, bool], ...] = ()
    statements: tuple[tuple[str, str, bool], ...] = ()
    imports: tuple[str, ...] = ()


@dataclass(frozen=True, eq=False)
class Grammar:
    """Languages by suffix and the families they belong to; see :mod:`changelens.operators.rulebook` for grammars from tables."""

    languages: dict[str, tuple[str, str]]
    families: dict[str, Family]

    def language_of(self, path: ColumnLike) -> Column:
        return self._by_suffix(path, 0)

    def family_of(self, path: ColumnLike) -> Column:
        return self._by_suffix(path, 1)

    def _by_suffix(self, path: ColumnLike, at: int) -> Column:
        table = F.create_map(*[F.lit(item) for ending, told in self.languages.items() for item in (ending, told[at])])
        return F.try_element_at(table, paths.suffix(path))


def by_family(family: ColumnLike, build, otherwise: Column, grammar: Grammar | None = None) -> Column:
    """One branch per language family; only the branch of the row's family is evaluated."""
    family, chosen = as_column(family), otherwise
    for name in reversed((grammar or GRAMMAR).families):
        chosen = F.when(family == name, build(name)).otherwise(chosen)
    return chosen


def _blank(content: Column, how: Family, keep_strings: bool) -> Column:
    comments, quoted = "|".join(how.comments), "|".join(how.quoted)
    pieces = F.regexp_extract_all(content, F.lit(f"({comments}|{quoted}|{how.plain}|[\\s\\S])"), 1)

    def piece(p: Column) -> Column:
        string = p if keep_strings else F.regexp_replace(F.regexp_replace(p, r"[^\n]", '"'), '\n"', "\n~")
        return (
            F.when(p.rlike(f"^(?:{comments})"), F.regexp_replace(p, r"[^\n]", " "))
            .when((F.length(p) > 1) & p.rlike("^[\"'`]"), string)
            .otherwise(p)
        )

    return F.array_join(F.transform(pieces, piece), "")


@built_once
def blank_literals(content: ColumnLike, family: ColumnLike, grammar: Grammar | None = None) -> Column:
    """Comments become spaces, strings become quotes (``~`` first on continued lines). Positions do not move."""
    content, known = as_column(content), grammar or GRAMMAR
    return by_family(family, lambda fam: _blank(content, known.families[fam], False), content, known)


@built_once
def blank_comments(content: ColumnLike, family: ColumnLike, grammar: Grammar | None = None) -> Column:
    content, known = as_column(content), grammar or GRAMMAR
    return by_family(family, lambda fam: _blank(content, known.families[fam], True), content, known)


# ----------------------------------------------------------------------------- definitions: Python ---
# The folds are written as SQL text: one call builds them, however many branches they have.
def quote(text: str) -> str:
    """A Spark SQL string literal."""
    escaped = text.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n")
    return f"'{escaped}'"


def _count(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def _sql_count(text: str, chars: str) -> str:
    return f"(length({text}) - length(translate({text}, {quote(chars)}, '')))"


_OPEN_PY = "array<struct<name:string,kind:string,indent:int,start:int,sig:int,container:string>>"
_PY_HEADER_PATTERN = r"(?U)^\s*(?:async\s+)?(def|class)\s+([^\W\d]\w*)"
_PY_HEADER = quote(_PY_HEADER_PATTERN)


def _python_definitions(blanked: str) -> str:
    """Fold over the lines: a line that starts a statement ends every open block that is not outside of it."""
    lines = f"""transform(split({blanked}, '\\n', -1), (x, i) -> named_struct(
        'line', i + 1,
        'blank', trim(translate(x, '\\t\\r', '  ')) = '',
        'inside', startswith(x, '~'),
        'continues', endswith(x, '\\\\'),
        'indent', length(x) - length(ltrim(translate(x, '\\t', ' '))),
        'delta', {_sql_count('x', '([{')} - {_sql_count('x', ')]}')},
        'word', regexp_extract(x, {_PY_HEADER}, 1),
        'name', regexp_extract(x, {_PY_HEADER}, 2)))"""
    start = f"""named_struct('depth', 0, 'continues', false, 'last', 0,
        'open', cast(array() AS {_OPEN_PY}), 'done', cast(array() AS array<{DEFINITION}>))"""
    close = """named_struct('name', o.name, 'kind', o.kind, 'start_line', o.start, 'end_line', greatest(o.start, acc.last),
        'signature_end_line', coalesce(o.sig, o.start), 'container', o.container)"""
    carried = """named_struct('depth', acc.depth + x.delta, 'continues', x.continues, 'last', x.line,
        'open', acc.open, 'done', acc.done)"""
    signed = """transform(kept, o -> named_struct('name', o.name, 'kind', o.kind, 'indent', o.indent, 'start', o.start,
        'sig', coalesce(o.sig, greatest(o.start, x.line - 1)), 'container', o.container))"""
    header = """named_struct('name', x.name,
        'kind', CASE WHEN x.word = 'class' THEN 'class' WHEN owner <> '' THEN 'method' ELSE 'function' END,
        'indent', x.indent, 'start', x.line, 'sig', cast(null AS int), 'container', owner)"""
    owner = "coalesce(try_element_at(filter(kept, o -> o.kind = 'class'), -1).name, '')"
    logical = f"""transform(array(filter(acc.open, o -> o.indent < x.indent)), kept -> named_struct(
        'depth', x.delta, 'continues', x.continues, 'last', x.line,
        'open', CASE WHEN x.word <> '' THEN concat({signed}, transform(array({owner}), owner -> {header})) ELSE {signed} END,
        'done', CASE WHEN size(kept) < size(acc.open)
            THEN concat(acc.done, transform(filter(acc.open, o -> o.indent >= x.indent), o -> {close})) ELSE acc.done END))[0]"""
    return f"""aggregate({lines}, {start},
        (acc, x) -> CASE WHEN x.blank THEN acc WHEN acc.depth > 0 OR acc.continues OR x.inside THEN {carried} ELSE {logical} END,
        acc -> concat(acc.done, transform(acc.open, o -> {close})))"""


# ----------------------------------------------------------------------------- definitions: braces ---
_WORD = r"[A-Za-z_$][\w$]*"
_ARGS = r"\((?:[^()]|\([^()]*\))*\)"
_KEYWORD = r"(?!(?:" + "|".join(rules.NOT_DEFINITIONS) + r"|synchronized|import|export|package|instanceof)\b)"
_TYPED = r"(?:\s*:\s*[^;{}=]+)?"
_ARROW = rf"(?:export\s+)?(?:default\s+)?(?:const|let|var)\s+({_WORD})\s*(?::[^=;{{}}]+)?=\s*"
_PARAMS = rf"(?:async\s*)?(?:{_ARGS}|{_WORD}){_TYPED}\s*=>"
_ANNOTATED = r"(?:@[\w.]+(?:\([^()]*\))?\s+)*"
_MODIFIED = r"(?:(?:public|protected|private|static|final|abstract|synchronized|native|default|sealed|strictfp)\s+)*"
_JAVA_TYPE = r"[\w.$]+(?:\s*<[^;{}()]*>)?(?:\s*\[\s*\])*"

# (kind, pattern, only inside a type body). Patterns end where the block or statement ends.
_HEADERS = {
    "js": (
        ("class", rf"((?:abstract\s+)?\bclass\s+({_WORD})[^{{}}();]*)\z", False),
        ("interface", rf"(\binterface\s+({_WORD})[^{{}}();]*)\z", False),
        ("enum", rf"(\benum\s+({_WORD})\s*)\z", False),
        ("type", rf"(\btype\s+({_WORD})\s*(?:<[^=;{{}}]*>)?\s*=\s*)\z", False),
        ("function", rf"((?:async\s+)?\bfunction\s*\*?\s*({_WORD})\s*(?:<[^{{}};]*?>)?\s*{_ARGS}{_TYPED}\s*)\z", False),
        ("function", rf"({_ARROW}{_PARAMS}\s*)\z", False),
        ("function", rf"({_ARROW}(?:async\s+)?function\s*\*?\s*(?:{_WORD})?\s*{_ARGS}\s*)\z", False),
        ("method", rf"((?:(?:public|private|protected|static|readonly|override)\s+)*({_WORD})\s*(?::[^=;{{}}]+)?=\s*{_PARAMS}\s*)\z", True),
        ("method", rf"((?:(?:public|private|protected|static|async|readonly|override|abstract|get|set)\s+|\*\s*)*{_KEYWORD}({_WORD})\s*(?:<[^{{}};()]*>)?\s*{_ARGS}{_TYPED}\s*)\z", True),
    ),
    "java": (
        ("class", rf"({_ANNOTATED}{_MODIFIED}\b(?:class|record)\s+({_WORD})[^{{}};]*)\z", False),
        ("interface", rf"({_ANNOTATED}{_MODIFIED}@?\binterface\s+({_WORD})[^{{}};]*)\z", False),
        ("enum", rf"({_ANNOTATED}{_MODIFIED}\benum\s+({_WORD})[^{{}};]*)\z", False),
        ("method", rf"({_ANNOTATED}{_MODIFIED}(?:<[^;{{}}()]*>\s*)?(?:{_JAVA_TYPE}\s+)?{_KEYWORD}({_WORD})\s*{_ARGS}\s*(?:throws\s+[\w.,\s$]+)?)\z", True),
    ),
}


@built_once
def header_names(rows: ColumnLike, family: ColumnLike, grammar: Grammar | None = None) -> Column:
    """Names of the definitions whose header stands in a row by itself; an argument list that goes on in the next row is closed."""
    known = grammar or GRAMMAR

    def of(fam: str) -> Column:
        how = known.families[fam]
        if how.layout == "indent":
            found = F.transform(as_column(rows), lambda row: F.regexp_extract(row, _PY_HEADER_PATTERN, 2))
            return F.filter(found, lambda name: name != "")

        def header(row: Column) -> Column:
            head = F.regexp_replace(F.substring_index(row, "{", 1), r"=>(?!.*=>).*$", "=> ")
            missing = F.greatest(_count(head, "(") - _count(head, ")"), F.lit(0))
            return F.concat(F.regexp_replace(head, r"^\s*(?:(?:export|default)\s+)*", ""), F.repeat(F.lit(")"), missing))

        def names(row: Column) -> Column:
            # without its block a method is told from a call by what stands before its name
            stated = F.contains(row, F.lit("{")) | (F.lit(how.layout == "braces") & ~row.rlike(r"^\s*(?:return|new|throw|else|await|case)\b") & row.rlike(r"^\s*[\w<>\[\],.]+\s+[^=]*\("))

            def name(head: Column, kind: str, pattern: str) -> Column:
                found = F.regexp_extract(head, "(?U)^" + pattern, 2)
                return F.when(stated, found).otherwise("") if kind == "method" else found

            return let(header(row), lambda head: F.array(*[name(head, kind, pattern) for kind, pattern, _ in how.headers]))

        return F.filter(F.flatten(F.transform(as_column(rows), names)), lambda name: (name != "") & ~name.isin(*rules.NOT_DEFINITIONS))

    return by_family(family, of, F.array().cast("array<string>"), known)


# statements that define something without a block of their own
_STATEMENTS = {
    "js": (
        ("function", rf"({_ARROW}{_PARAMS}\s*[^\s{{}};][^{{}};]*)\z", False),
        ("type", rf"(\btype\s+({_WORD})\s*(?:<[^=;{{}}]*>)?\s*=\s*[^\s;{{}}=][^;{{}}=]*)\z", False),
        ("method", rf"((?:(?:public|private|protected|static|readonly|override)\s+)*({_WORD})\s*=\s*{_PARAMS}\s*[^\s{{}};][^{{}};]*)\z", True),
    ),
    "java": (
        ("method", rf"({_ANNOTATED}{_MODIFIED}(?:<[^;{{}}()]*>\s*)?{_JAVA_TYPE}\s+{_KEYWORD}({_WORD})\s*{_ARGS}\s*(?:throws\s+[\w.,\s$]+)?)\z", True),
    ),
}
_TYPES = "('class', 'interface', 'enum')"
_PIECE = r"([^{};\n]*+[{};\n]|[^{};\n]++)"
_PIECE_END = r"(?:[{};]|\s*\n)\z"
_LEADING_SPACE = r"^\s+"
_OPEN_BRACE = "array<struct<name:string,kind:string,start:int,sig:int,container:string,saved:string>>"


def _match(buffer: str, patterns, in_type: str) -> str:
    """First pattern that matches the end of the buffer, as struct<kind, name, text>; null when none does."""
    cases = " ".join(
        f"""WHEN {buffer} RLIKE {quote(pattern)}{f" AND {in_type}" if only_in_type else ""} THEN named_struct('kind', '{kind}',
            'name', regexp_extract({buffer}, {quote(pattern)}, 2), 'text', regexp_extract({buffer}, {quote(pattern)}, 1))"""
        for kind, pattern, only_in_type in patterns
    )
    return f"CASE {cases} END" if patterns else "cast(null AS struct<kind:string,name:string,text:string>)"


def _brace_definitions(blanked: str, how: Family) -> str:
    """Fold over the statements: text up to the next brace, semicolon or line break is matched where it ends."""
    pieces = f"regexp_extract_all({blanked}, {quote(_PIECE)}, 1)"
    start = f"""named_struct('line', 1, 'buffer', '', 'open', cast(array() AS {_OPEN_BRACE}),
        'done', cast(array() AS array<{DEFINITION}>))"""
    top = "try_element_at(acc.open, -1)"
    in_type = f"coalesce({top}.kind IN {_TYPES}, false)"
    owner = f"coalesce(try_element_at(filter(acc.open, o -> o.kind IN {_TYPES}), -1).name, '')"
    shown = f"regexp_replace(m.text, {quote(_LEADING_SPACE)}, '')"
    first_line = f"(acc.line - {_sql_count(shown, chr(10))})"
    balanced = f"({_sql_count('b', '(')} <= {_sql_count('b', ')')})"
    without_block = f"""CASE WHEN m IS NOT NULL THEN concat(acc.done, array(named_struct('name', m.name, 'kind', m.kind,
        'start_line', {first_line}, 'end_line', acc.line,
        'signature_end_line', CASE WHEN m.kind = 'function' THEN {first_line} ELSE acc.line END, 'container', {owner})))
        ELSE acc.done END"""
    opening = f"""named_struct('line', acc.line, 'buffer', '', 'open', concat(acc.open, array(named_struct(
        'name', m.name, 'kind', m.kind, 'start', {first_line}, 'sig', acc.line, 'container', {owner},
        'saved', CASE WHEN {balanced} THEN '' ELSE concat(b, '{{') END))), 'done', acc.done)"""
    closing = f"""named_struct('line', acc.line,
        'buffer', CASE WHEN coalesce({top}.saved, '') = '' THEN '' ELSE concat({top}.saved, '}}') END,
        'open', slice(acc.open, 1, greatest(size(acc.open) - 1, 0)),
        'done', CASE WHEN {top}.name IS NULL THEN {without_block} ELSE concat({without_block}, array(named_struct(
            'name', {top}.name, 'kind', {top}.kind, 'start_line', {top}.start, 'end_line', acc.line,
            'signature_end_line', CASE WHEN {top}.kind = 'type' THEN acc.line ELSE {top}.sig END, 'container', {top}.container))) END)"""
    ended = f"named_struct('line', acc.line, 'buffer', '', 'open', acc.open, 'done', {without_block})"
    next_line = "named_struct('line', acc.line + 1, 'buffer', concat(acc.buffer, p), 'open', acc.open, 'done', acc.done)"
    broken = f"named_struct('line', acc.line + 1, 'buffer', '', 'open', acc.open, 'done', {without_block})"
    maybe = "contains(b, '=>') OR contains(b, 'type ')" if how.layout == "lines" else "contains(b, '(')"
    match = f"""CASE WHEN right(p, 1) = '{{' THEN CASE WHEN {balanced} THEN {_match('b', how.headers, in_type)} END
        WHEN {maybe} THEN {_match('b', how.statements, in_type)} END"""
    # a line break ends a JS statement that is complete on its own (no semicolon)
    complete = quote(
        rf"{_ARROW}{_PARAMS}\s*[^\s{{}};][^{{}};]*[\w\)\]\"'`]\s*\z|\btype\s+{_WORD}[^;{{}}=]*=\s*[^;{{}}=]*[\w\)\]\"'`]\s*\z"
    )
    stays = f"right(p, 1) = '\\n' AND NOT (({maybe.replace('(b,', '(concat(acc.buffer, p),')}) AND concat(acc.buffer, p) RLIKE {complete})"
    stays = stays if how.layout == "lines" else "right(p, 1) = '\\n'"
    buffer = f"regexp_replace(concat(acc.buffer, p), {quote(_PIECE_END)}, '')"
    return f"""aggregate({pieces}, {start}, (acc, p) -> CASE WHEN {stays} THEN {next_line} ELSE
        transform(array({buffer}), b -> transform(array({match}), m -> CASE right(p, 1)
            WHEN '{{' THEN {opening} WHEN '}}' THEN {closing} WHEN ';' THEN {ended}
            WHEN '\\n' THEN {broken} ELSE {ended} END)[0])[0] END,
        acc -> acc.done)"""


@built_once
def definitions(blanked: str, family: str, grammar: Grammar | None = None) -> Column:
    """array<definition> of a column with blanked source text, ordered by start and end line."""
    folds = " ".join(
        f"WHEN {quote(name)} THEN {_python_definitions(blanked) if how.layout == 'indent' else _brace_definitions(blanked, how)}" for name, how in (grammar or GRAMMAR).families.items()
    )
    found = f"CASE {family} {folds} ELSE cast(array() AS array<{DEFINITION}>) END"
    return F.expr(
        f"transform(array_sort(transform({found}, d -> named_struct('a', d.start_line, 'b', d.end_line, 'd', d))), k -> k.d)"
    )


_SLASHES = (r"//[^\n]*+", r"/\*[\s\S]*?(?:\*/|\z)")
GRAMMAR = Grammar(
    {ending: (name, "js" if name in rules.JS_LANGUAGES else name) for ending, name in rules.LANGUAGE_BY_SUFFIX.items()},
    {
        "python": Family("indent", (r"#[^\n]*+",), (_BLOCK, _BLOCK.replace('"', "'"), _DOUBLE, _SINGLE), r"""[^"'#]++"""),
        "js": Family("lines", _SLASHES, (_DOUBLE, _SINGLE, r"`[^`\\]*+(?:\\[\s\S][^`\\]*+)*+`"), r"""[^"'`/]++""", _HEADERS["js"], _STATEMENTS["js"]),
        "java": Family("braces", _SLASHES, (_BLOCK, _DOUBLE, _SINGLE), r"""[^"'/]++""", _HEADERS["java"], _STATEMENTS["java"]),
    },
)


# ----------------------------------------------------------------------------- imports ---
_FROM = r"(?Um)^[ \t]*from[ \t]+(\.*[\w.]*)[ \t]+import[ \t]+(?:\(([^()]*)\)|([^\n(]+))"
_IMPORT = r"(?Um)^[ \t]*import[ \t]+([^\n(]+)"
_ANY_PY = r"(?Um)^[ \t]*(?:from[ \t]+\.*[\w.]*[ \t]+import[ \t]+(?:\([^()]*\)|[^\n(]+)|import[ \t]+[^\n(]+)"
_ANY_JS = (
    r"(?:\bimport\s*(?:[\w$*{}\s,]+?\bfrom\s*)?[\"'][^\"'\n]+[\"']|\bexport\s+[\w$*{}\s,]+?\bfrom\s*[\"'][^\"'\n]+[\"']"
    r"|(?<![\w$.])require\s*\(\s*[\"'][^\"'\n]+[\"'])"
)
_ANY_JAVA = r"(?m)^\s*import\s+(?:static\s+)?[\w$.]+?(?:\.\*)?\s*;"


def _located(text: Column, pattern: str) -> Column:
    """Matches with the first and last line they cover: the text is cut around the matches and line breaks counted."""
    parts = F.regexp_extract_all(text, F.lit(f"({pattern})"), 1)
    rest = F.split(F.regexp_replace(text, pattern, "\u0001"), "\u0001", -1)
    breaks = F.zip_with(
        F.transform(rest, lambda r: _count(r, "\n")),
        F.transform(parts, lambda p: _count(p, "\n")),
        lambda r, p: F.struct(r.alias("before"), F.coalesce(p, F.lit(0)).alias("inside")),
    )

    def place(breaks: Column) -> Column:
        return F.transform(
            parts,
            lambda text, i: let(
                F.aggregate(F.slice(breaks, F.lit(1), i), F.lit(1), lambda n, b: n + b["before"] + b["inside"])
                + F.get(breaks, i)["before"],
                lambda line: F.struct(text.alias("text"), line.alias("line"), (line + F.get(breaks, i)["inside"]).alias("end_line")),
            ),
        )

    return let(breaks, place)


def _names(listing: Column) -> Column:
    """Imported names of ``a as b, c``; a wildcard stays ``*``."""
    parts = F.transform(F.split(F.regexp_replace(listing, r"[\\\s]+", " "), ","), lambda n: F.trim(n))
    return F.transform(F.filter(parts, lambda n: n != ""), lambda n: F.regexp_extract(n, r"^(\S+)", 1))


def _import(spec: Column, found: Column, names=None, level=None, wildcard=None, static=None) -> Column:
    return F.struct(
        spec.alias("spec"),
        (F.array().cast("array<string>") if names is None else names).alias("names"),
        (F.lit(0) if level is None else level).alias("level"),
        (F.lit(False) if wildcard is None else wildcard).alias("wildcard"),
        (F.lit(False) if static is None else static).alias("static"),
        found["line"].alias("line"),
        found["end_line"].alias("end_line"),
    )


def _python_imports(text: Column) -> Column:
    def one(found: Column) -> Column:
        shown = found["text"]
        first = F.regexp_replace(shown, r"^\s+", "")
        module = F.regexp_extract(shown, _FROM, 1)
        listing = F.concat(F.regexp_extract(shown, _FROM, 2), F.regexp_extract(shown, _FROM, 3))
        dots = F.regexp_extract(module, r"^(\.*)", 1)
        from_import = F.array(
            _import(F.regexp_replace(module, r"^\.+", ""), found, names=_names(listing), level=F.length(dots))
        )
        plain = F.transform(_names(F.regexp_extract(shown, _IMPORT, 1)), lambda spec: _import(spec, found))
        return F.when(first.startswith("from"), from_import).otherwise(plain)

    return F.flatten(F.transform(_located(text, _ANY_PY), one))


def _js_imports(text: Column) -> Column:
    return F.transform(
        _located(text, _ANY_JS), lambda found: _import(F.regexp_extract(found["text"], "[\"']([^\"'\n]+)[\"']", 1), found)
    )


def _java_imports(text: Column) -> Column:
    shown = r"import\s+(static\s+)?([\w$.]+?)(\.\*)?\s*;"

    def one(found: Column) -> Column:
        lead = _count(F.regexp_extract(found["text"], r"^(\s*)", 1), "\n")
        at = F.struct((found["line"] + lead).alias("line"), found["end_line"].alias("end_line"))
        return _import(
            F.regexp_extract(found["text"], shown, 2), at,
            wildcard=F.regexp_extract(found["text"], shown, 3) != "", static=F.regexp_extract(found["text"], shown, 1) != "",
        )

    return F.transform(_located(text, _ANY_JAVA), one)


@built_once
def imports(commentless: ColumnLike, blanked: ColumnLike, family: ColumnLike, grammar: Grammar | None = None) -> Column:
    """array<import>. Python and Java read the blanked text; other specs may be strings, so comments alone are blanked."""
    commentless, blanked, known = as_column(commentless), as_column(blanked), grammar or GRAMMAR
    build = {
        "python": lambda: _python_imports(F.regexp_replace(blanked, r"\\\n", " \n")),
        "js": lambda: _js_imports(commentless),
        "java": lambda: _java_imports(blanked),
    }

    def of(fam: str) -> Column:
        patterns = known.families[fam].imports
        if fam in build:
            return build[fam]()
        one = lambda pattern: lambda found: _import(F.regexp_extract(found["text"], pattern, 1), found)
        found = [F.transform(_located(commentless, _all_but_first(p)), one(p)) for p in patterns]
        return F.concat(*found) if found else F.array().cast(f"array<{IMPORT}>")

    return by_family(family, of, F.array().cast(f"array<{IMPORT}>"), known)


def _all_but_first(pattern: str) -> str:
    """The pattern with its first group turned into a plain one, to be put into a group itself."""
    return re.sub(r"(?<!\\)\((?!\?)", "(?:", pattern, count=1)


# ----------------------------------------------------------------------------- references ---
_TOKEN = r"([^\w$\s\"]?)\s*(?<![\w$])([A-Za-z_$\u0080-￿][\w$\u0080-￿]*)(?=(\s*(?:==|=>|[^\s])?))"
_DECLARING = ("def", "class", "function", "interface", "enum", "type", "const", "let", "var", "record")


_BETWEEN = r"[^\w$]+"


def identifiers(content: ColumnLike) -> Column:
    """The distinct words of a text, in one pass; the index that searched names are joined with."""
    return F.array_distinct(F.split(as_column(content), _BETWEEN, -1))


@built_once
def mentioned_names(content: ColumnLike, names: ColumnLike) -> Column:
    """The wanted names that occur as whole words: two hash sets meet, however many names there are."""
    return F.array_sort(F.array_intersect(as_column(names), identifiers(content)))


@built_once
def references(blanked: ColumnLike, names: ColumnLike, defs: ColumnLike, imps: ColumnLike, family: ColumnLike) -> Column:
    """array<reference>: uses of wanted names. Definition, parameter and keyword names are not uses."""
    blanked, names, defs, imps, family = (as_column(c) for c in (blanked, names, defs, imps, family))
    python, java = family == "python", family == "java"

    def tokens(line: Column) -> Column:
        part = lambda g: F.regexp_extract_all(line["text"], F.lit(_TOKEN), g)
        return F.zip_with(
            F.zip_with(part(1), part(2), lambda p, n: F.struct(p.alias("before"), n.alias("name"))),
            part(3),
            lambda a, s: F.struct(a["before"].alias("before"), a["name"].alias("name"), F.ltrim(s).alias("after"), s.alias("raw")),
        )

    def lambda_parameter(found: Column, at: Column, token: Column) -> Column:
        """Between a ``lambda`` of the line and the colon that ends its parameters, as a name of its own and not as a default."""
        ahead = F.slice(found, F.lit(1), at)
        starts = F.filter(F.transform(ahead, lambda t, i: F.when(t["name"] == "lambda", i)), lambda i: i.isNotNull())
        open_ = let(F.array_max(starts), lambda first: F.coalesce(~F.exists(F.slice(ahead, first + 2, F.size(ahead)), lambda t: t["after"] == ":"), F.lit(False)))
        return open_ & token["before"].isin("", ",", "*") & token["after"].isin(",", ":", "=")

    def classify(line: Column, token: Column, previous: Column, imported: Column, header: Column, declared: Column, parameter: Column) -> Column:
        before, after = token["before"], token["after"]
        word = F.when(before == "", F.coalesce(previous["name"], F.lit(""))).otherwise("")
        called = after == "("
        listed = before.isin("(", ",", "*", "") & after.isin(",", ")", ":", "=", "", "?")
        drop = (
            word.isin(*_DECLARING)
            | (python & parameter)
            | (declared & called & ~before.isin(".") & (word != "new") & ~python)
            | (header & listed & ~called & F.when(java, (word != "") & after.isin(",", ")")).otherwise(word == ""))
            | (python & ~header & (after == "=") & (before.isin("(", ",") | ((before == "") & (token["raw"] == "=") & (word == "") & line["text"].rlike(r"^\s+\w+=[^=]"))))
            | (java & (word != "") & ~word.isin("return", "new", "throw", "extends", "implements", "throws", "else", "case", "instanceof") & after.isin("=", ";"))
        )
        typed = F.when(
            java, after.rlike(r"^[\w$]") | word.isin("extends", "implements", "throws", "instanceof") | (before == "<")
        ).when(family == "js", before.isin(":", "<") & ~called & (after != ",")).otherwise(F.lit(False))
        jsx = (family == "js") & (before == "<") & after.rlike(r"^[\w/>]") & line["text"].rlike(r"<[A-Z][\w$]*(\s|/|>)")
        kind = (
            F.when(imported, "import")
            .when(called | (word == "new") | jsx, "call")
            .when((before == ".") & ~java, "attr")
            .when(typed, "type")
            .otherwise("ref")
        )
        return F.when(~drop | imported, kind)

    def in_line(line: Column) -> Column:
        at = line["line"]
        imported = F.exists(imps, lambda i: (i["line"] <= at) & (at <= i["end_line"]))
        header = F.exists(
            defs, lambda d: d["kind"].isin("function", "method") & (d["start_line"] <= at) & (at <= d["signature_end_line"])
        )

        def all_tokens(found: Column) -> Column:
            placed = F.transform(found, lambda t, i: F.struct(t.alias("t"), i.alias("i")))
            wanted = F.filter(placed, lambda p: F.array_contains(names, p["t"]["name"]))
            judged = F.transform(
                wanted,
                lambda p: F.struct(
                    p["t"]["name"].alias("name"),
                    at.alias("line"),
                    classify(
                        line, p["t"], F.get(found, p["i"] - 1), imported, header,
                        F.exists(
                            defs,
                            lambda d: (d["name"] == p["t"]["name"]) & (d["start_line"] <= at) & (at <= d["signature_end_line"]),
                        ),
                        F.contains(line["text"], F.lit("lambda")) & lambda_parameter(found, p["i"], p["t"]),
                    ).alias("kind"),
                ),
            )
            return F.filter(judged, lambda r: r["kind"].isNotNull())

        return let(tokens(line), all_tokens)

    lines = F.transform(F.split(blanked, "\n", -1), lambda x, i: F.struct((i + 1).alias("line"), x.alias("text")))
    hit = F.filter(lines, lambda line: F.arrays_overlap(F.split(line["text"], _BETWEEN, -1), names))
    found = F.flatten(F.transform(hit, in_line))
    ordered = F.array_sort(F.transform(found, lambda r: F.struct(r["line"], r["name"], r["kind"])))
    return F.transform(
        ordered, lambda r: F.struct(r["name"].alias("name"), r["line"].alias("line"), r["kind"].alias("kind"))
    )


def enclosing(defs: ColumnLike, line: ColumnLike) -> Column:
    """Innermost definition that contains the line; the later one on ties; null at module level."""
    line = as_column(line)
    around = F.filter(as_column(defs), lambda d: (d["start_line"] <= line) & (line <= d["end_line"]))
    ranked = F.transform(
        around, lambda d, i: F.struct((d["end_line"] - d["start_line"]).alias("span"), (-i).alias("order"), d.alias("d"))
    )
    return F.array_min(ranked)["d"]


def snippet(lines: ColumnLike, hit: ColumnLike, low: ColumnLike, high: ColumnLike, width: int = 160, around: int = 5) -> Column:
    """Rows around a hit inside its definition, the header row first when it is further up."""
    lines, hit, low, high = (as_column(c) for c in (lines, hit, low, high))
    first = F.greatest(low, hit - around)
    last = F.least(high, hit + around, F.size(lines))
    number = lambda n: F.lpad(n.cast("string"), 5, " ")
    shown = lambda n: F.substring(F.get(lines, n - 1), 1, width)
    head = F.when(
        (first > low) & (low <= F.size(lines)),
        F.concat(
            F.array(F.concat(number(low), F.lit(" | "), shown(low))),
            F.when(first > low + 1, F.array(F.lit("      | ..."))).otherwise(F.array().cast("array<string>")),
        ),
    ).otherwise(F.array().cast("array<string>"))
    rows = F.when(
        last >= first,
        F.transform(
            F.sequence(first, F.greatest(first, last)),
            lambda n: F.concat(number(n), F.when(n == hit, ">").otherwise(" "), F.lit("| "), shown(n)),
        ),
    ).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.concat(head, rows), "\n")
