"""Code inside strings, regular expressions, lambda parameters; alignment of lines against brute force."""

import ast
import itertools
import random
import textwrap

import pytest

from changelens.functions import lexer
from changelens.operators import diff, symbols

def test_javascript_literals():
    told = lambda text: lexer.blank(text, list(lexer._javascript(text)), False)
    assert told("const a = `x ${foo(b, `in ${bar}`)} y`;") == 'const a = """"(foo(b, """""(bar)"))""";'
    assert told("const r = /[\"'{]/g.test(s); b = a / 2 / c;") == 'const r = """""""".test(s); b = a / 2 / c;'
    assert told("if (/}/.test(x)) { y() }") == 'if (""".test(x)) { y() }'
    assert told("x = `a ${ {k: fn(1)}.k } c`;") == 'x = """"( {k: fn(1)}.k )""";'
    assert told("return /`/.exec(t) // not `open") == 'return """.exec(t)             '
    assert told("a = `\\`${b}\\${c}`") == 'a = """"(b)""""""'
    assert told("<a>{b}</a> / c / <d/>") == "<a>{b}</a> / c / <d/>"
    assert told("`open\nto the end") == '"""""\n~"""""""""'
    assert told("") == ""


def test_formatted_strings_hold_the_names_the_parser_finds():
    cases = [
        'a = f"x {foo(b)!r:>{width}} y" + bar', 'b = f"{d["k"]:{w}.{p}f} {{no}} {call(x=1)}"  # gone(', "c = rf'''a\n{multi(\n1)}\n'''", 'd = f"{x:%Y-%m}" "q"',
        'e = f"{a if b else {1: 2}[1]}" f\'{f"{deep}"}\'', "g = F'{h!s}' 'no'", 'i = {1: f"{j}", "k": [l]}', 'm = f"{n=}" "{o}"',
    ]
    for text in cases:
        out = lexer.blank(text, list(lexer._python(text)), False)
        assert len(out) == len(text) and out.count("\n") == text.count("\n")
        names = {node.id for node in ast.walk(ast.parse(text)) if isinstance(node, ast.Name)}
        seen = set("".join(c if c.isalnum() or c == "_" else " " for c in out).split())
        assert names <= seen, (text, out)
        assert not seen & {"no", "gone", "q"}, (text, out)


SOURCE = {
    "m.py": textwrap.dedent("""
        def outer(total):
            label = f"{price(total)} of {total}"
            pick = lambda price, other=price: other
            return list(map(lambda x: price(x), label))
    """),
    "t.ts": textwrap.dedent("""
        export function show(a: string) {
          const re = /["'`{]/;
          return `<b>${price(a)}</b> ${ [a].map((x) => { return price(x); }).join(`,${price}`) }`;
        }
        function after() { return price(1); }
    """),
}


def test_uses_inside_strings_and_lambda_parameters(spark):
    files = spark.createDataFrame([("r", "c", p, t) for p, t in SOURCE.items()], "repo string, sha string, path string, content string")
    names = spark.createDataFrame([("r", "c", "price")], "repo string, sha string, name string")
    found = sorted((r.path, r.line, r.kind, r.enclosing) for r in symbols.hits(symbols.scan(files, names)).collect())
    assert found == [
        ("m.py", 3, "call", "outer"), ("m.py", 4, "ref", "outer"), ("m.py", 5, "call", "outer"),
        ("t.ts", 4, "call", "show"), ("t.ts", 4, "call", "show"), ("t.ts", 4, "ref", "show"), ("t.ts", 6, "call", "after"),
    ]


def longest(values):
    return max((len(c) for n in range(len(values) + 1) for c in itertools.combinations(values, n) if list(c) == sorted(set(c))), default=0)


def test_longest_increasing_equals_brute_force():
    rng = random.Random(3)
    for _ in range(200):
        values = [rng.randint(0, 9) for _ in range(rng.randint(0, 9))]
        run = [values[i] for i in diff._longest_increasing(values)]
        assert run == sorted(set(run)) and len(run) == longest(values)


def test_alignment_is_in_order_and_keeps_the_most_of_unique_lines():
    rng = random.Random(5)
    for number in range(300):
        old = list(range(8)) if number % 2 else [rng.randint(0, 4) for _ in range(rng.randint(0, 9))]
        new = rng.sample(old, len(old)) if number % 2 else [rng.randint(0, 4) for _ in range(rng.randint(0, 9))]
        kept = diff._align(old, new)
        assert all(old[p] == new[q] for p, q in kept)
        assert all(a[0] < b[0] and a[1] < b[1] for a, b in zip(kept, kept[1:]))
        if number % 2:
            assert len(kept) >= longest([new.index(v) for v in old]) - 2 and len(kept) <= longest([new.index(v) for v in old])
        if old == new:
            assert len(kept) == len(old)


@pytest.mark.parametrize("old, new, want", [
    ("a\nb\nc\nd", "b\nc\nd\na", {("-", 1, "a", 4), ("+", 4, "a", 1)}),
    ("x\n\ny\n\nz", "x\n\nnew\n\ny\n\nz", {("+", 3, "new", None), ("+", 4, "", None)}),
    (None, "a\na", {("+", 1, "a", None), ("+", 2, "a", None)}),
    ("a", None, {("-", 1, "a", None)}), ("same", "same", set()), ("", "a", {("+", 1, "a", None)}),
])
def test_aligned_diff(spark, old, new, want):
    schema = "case string, path string, content string"
    base = spark.createDataFrame([("1", "f", old)] if old is not None else [], schema)
    head = spark.createDataFrame([("1", "f", new)] if new is not None else [], schema)
    assert {(r.op, r.line, r.text, r.moved_line) for r in diff.aligned_diff(base, head).collect()} == want
