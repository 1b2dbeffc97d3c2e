"""Main text of web pages with a site style tree.

The pages of one host are merged into one style tree over all their elements: a node is the chain of block elements (with their classes and ids) that
leads to it, the page itself is the root. What a node shows on a page is its presentation (the labels of all elements below it, in order) with its texts.
A node's importance is the joint entropy of presentation and contents over the pages, divided by the logarithm of its pages: menus, adverts and footers
draw on few and come near 0, articles differ from page to page and come near 1. A node of one page stays at 1. Branches of low importance are removed whole.

A node such as an article's ``p`` has several branches on a page. Each of them, and each text that stands beside child elements, is a feature with an
importance of its own, 1 - log(pages that show it) / log(pages of the node): so a notice that is repeated in a plain ``p`` goes and the other ``p`` stay.

A small site cannot show what repeats, and adverts or comments may differ on every page. So for every page elements that are no text by their meaning
(:data:`NEVER`, or a class, id or role that :func:`furniture` names as a whole) are left out too, and if a page marks its article, only that counts.

Pages are parsed by one small tokenizer twice: for the nodes, which are counted as rows of (host, style, content), combined before the shuffle,
so that one host may hold any part of all pages; and for the text, with what is unimportant on the page's host beside it.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changelens.llm.common import filled, materialize

# Elements by their meaning in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template".split())
NEVER = RAW | frozenset("nav footer aside form button select option dialog head svg canvas object audio video menu map annotation annotation-xml".split())
#: Formulas are text within a line; browsers do not show their annotations.
MATH = "math semantics mrow mi mn mo ms mtext mspace mfrac msqrt mroot mstyle mpadded mphantom menclose msub msup msubsup munder mover munderover mtable mtr mtd merror"
INLINE = frozenset(f"{MATH} a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rb rp rt s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote center details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SAME_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: Words in class, id or role that name what is around an article.
FURNITURE = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promotion banner cookie cookies consent gdpr popup modal overlay "
    "newsletter subscribe subscription signup login sidebar sidenav rail menu menubar nav navbar navigation breadcrumb breadcrumbs pagination pager footer masthead topbar "
    "toolbar comment comments commentlist respond disqus share sharing social related recommended widget widgets skip search complementary contentinfo".split()
)
#: Words that leave the meaning of those as it is. Others change it: has-sidebar, menu-open, share-price, related-work.
BESIDE = frozenset("bar line box list link links item items icon icons button buttons btn wrap wrapper container inner outer area block form top bottom left right site page global main primary secondary post posts article entry".split())
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*|[^>]*)(?:>|\Z)", re.S)
NAMED = re.compile(r"""(?:^|[\s"'])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I | re.S)
#: The unimportant styles of all hosts are broadcast up to so many characters; beyond, a host's pages are dealt to so many tasks.
BROADCAST_CHARS, SALTS = 8_000_000, 64
#: Names a page's head, outside of articles.
HEADER = frozenset(["header"])
WORDS = re.compile(r"[a-z]+")
NUMBERS = re.compile(r"\d+")


def furniture(value: str, words: frozenset[str] = FURNITURE) -> bool:
    """Whether one class, id or role names furniture as a whole: one of ``words`` at least, and nothing that changes its meaning."""
    found = WORDS.findall(value.lower())
    return not words.isdisjoint(found) and all(w in words or w in BESIDE or w in FURNITURE for w in found)


class _Element:
    """An element of a page; ``first`` and ``last`` bound the blocks inside, ``parts`` is what it shows, ``own`` its blocks outside of child elements."""

    __slots__ = ("first", "last", "name", "named", "own", "parent", "parts", "shown", "style")

    def __init__(self, name: str, style: str, parent: int, named: list[str], first: int) -> None:
        self.name, self.style, self.parent, self.named, self.first, self.last = name, style, parent, named, first, first
        self.parts: list[str] = []
        self.own: list[int] = []
        self.shown = ""


#: (block element, pieces of text with the element that holds each)
Block = tuple[int, list[tuple[int, str]]]


def _clean(pieces: list[str]) -> str:
    return " ".join(html.unescape("".join(pieces)).split())


def parse(page: str) -> tuple[list[_Element], list[Block]]:
    """All elements of a page (the first is the page itself, parents before children) and its text blocks in page order.

    A block is the text between the borders of block elements and line breaks, references decoded and white space runs turned into one space.
    Unclosed elements end where their parents end; an end tag without a start is passed over. A page without a tag is one block.
    """
    elements = [_Element("", "", -1, [], 0)]
    blocks: list[Block] = []
    run: list[tuple[int, str]] = []
    stack = [0]

    def border() -> None:
        if run and (text := _clean([t for _, t in run])):
            at = next(i for i in reversed(stack) if elements[i].name not in INLINE)
            elements[at].own.append(len(blocks))
            elements[at].parts.append(f"#{text}")
            blocks.append((at, run.copy()))
        run.clear()

    def close(depth: int) -> None:
        if any(elements[i].name not in INLINE for i in stack[depth:]):
            border()
        for i in reversed(stack[depth:]):
            e = elements[i]
            e.last = len(blocks)
            if e.name not in INLINE:
                e.shown = f"{xxhash.xxh64_intdigest(chr(0).join(e.parts)):x}"
                up = e.parent
                while elements[up].name in INLINE and up:
                    up = elements[up].parent
                elements[up].parts.append(f"<{e.style.rpartition('>')[2]} {e.shown}")
        del stack[depth:]

    at, lowered = 0, None
    while True:
        found = TOKEN.search(page, at)
        end = found.start() if found else len(page)
        if end > at and elements[stack[-1]].name not in RAW:
            run.append((stack[-1], page[at:end]))
        if found is None:
            break
        at = found.end()
        name = (found[2] or "").lower()
        if not name:
            continue
        if found[1]:
            depth = next((i for i in range(len(stack) - 1, 0, -1) if elements[stack[i]].name == name), 0)
            if depth:
                close(depth)
            continue
        if name in ("br", "hr"):
            border()
            continue
        if name in VOID:
            continue
        ends = SAME_CLOSES.get(name, ()) or (("p",) if name in CLOSES_P else ())
        for i in range(len(stack) - 1, 0, -1):
            open_name = elements[stack[i]].name
            if open_name in ends:
                close(i)
                break
            if open_name not in INLINE and not (name in SAME_CLOSES and open_name == "p"):
                break
        if name not in INLINE:
            border()
        if name in RAW:
            lowered = lowered if lowered is not None else page.lower()
            end = lowered.find(f"</{name}", at) if len(lowered) == len(page) else (m.start() if (m := re.compile(f"</{name}", re.I).search(page, at)) else -1)
            at = len(page) if end < 0 else end
            if at == len(page):
                continue
        named = [n[2] or n[3] or n[4] or "" for n in NAMED.finditer(found[3])] if found[3] else []
        above = elements[stack[-1]].style
        style = above if name in INLINE else f"{above}>{name}{''.join('.' + NUMBERS.sub('0', v).replace('>', '') for v in named)}"
        elements.append(_Element(name, style, stack[-1], named, len(blocks)))
        stack.append(len(elements) - 1)
    border()
    close(1)
    elements[0].last = len(blocks)
    elements[0].shown = f"{xxhash.xxh64_intdigest(chr(0).join(elements[0].parts)):x}"
    return elements, blocks


def _told(elements: list[_Element], by_words: bool) -> tuple[list[bool], list[int]]:
    """Per element whether it is no text by its meaning, and how it is marked: 2 inside an article, 1 inside the main element."""
    holds_main = {0}
    for i, e in enumerate(elements):
        if e.name == "main":
            while i > 0:
                holds_main.add(i)
                i = elements[i].parent
    parents = {"html", "body", "article", "main"}

    def judged(holds: set[int]) -> tuple[list[bool], list[int]]:
        dead, marks = [False], [0]
        for i, e in enumerate(elements[1:], 1):
            values = [v for value in e.named for v in value.split()]
            heading = by_words and not re.fullmatch("h[1-6]", e.name) and any(furniture(v, HEADER) for v in values)
            aside = by_words and e.name not in parents and any(furniture(v) for v in values)
            head = (e.name == "header" or heading) and not marks[e.parent] and e.name not in parents
            no_text = e.name in RAW or i not in holds and (e.name in NEVER or aside or head)
            dead.append(dead[e.parent] or no_text)
            marks.append(max(marks[e.parent], 2 if e.name == "article" else int(e.name == "main")))
        return dead, marks

    dead, marks = judged(holds_main)
    marked = [i for i, e in enumerate(elements) if e.name in ("article", "main") and e.last > e.first]
    if marked and all(dead[i] for i in marked):  # what holds the article is no furniture
        holds = set(holds_main)
        for i in marked:
            while i > 0:
                holds.add(i)
                i = elements[i].parent
        dead, marks = judged(holds)
    return dead, marks


def _text_of(block: Block, dead: list[bool]) -> str:
    return _clean([t for i, t in block[1] if not dead[i]])


def _chosen(elements: list[_Element], blocks: list[Block]) -> tuple[list[bool], list[int]]:
    """Dead elements by their meaning, and the blocks that can be main text: those of its articles, else of its main element, else all.

    Names that would leave no text at all do not count.
    """
    for by_words in (True, False):
        dead, marks = _told(elements, by_words)
        alive = [b for b, block in enumerate(blocks) if _text_of(block, dead)]
        if alive:
            break
    best = max((marks[blocks[b][0]] for b in alive), default=0)
    return dead, [b for b in alive if marks[blocks[b][0]] == best]


def content_blocks(page: str, low: frozenset[str] = frozenset(), repeated: frozenset[int] = frozenset()) -> list[tuple[str, str]]:
    """(style, text) of the blocks that are main text, without the branches of the styles ``low`` and the ``repeated`` ones.

    Repeated branches that are more than half of what is left are the text of a copy and stay.
    """
    elements, blocks = parse(page)
    dead, chosen = _chosen(elements, blocks)
    out = [(b, text) for b in chosen if (text := _text_of(blocks[b], dead))]
    if low:
        gone = [False] * len(elements)
        for i, e in enumerate(elements[1:], 1):
            gone[i] = gone[e.parent] or e.name not in INLINE and e.style in low
        out = [(b, t) for b, t in out if not gone[blocks[b][0]] and f"{elements[blocks[b][0]].style}#" not in low]
    if repeated:
        again = {b for b, _ in out if _feature(f"{elements[blocks[b][0]].style}#", _clean([t for _, t in blocks[b][1]])) in repeated}
        for e in elements[1:]:
            if e.name not in INLINE and e.last > e.first and _feature(e.style, e.shown) in repeated:
                again.update(range(e.first, e.last))
        if 2 * sum(len(t) for b, t in out if b in again) <= sum(len(t) for _, t in out):
            out = [(b, t) for b, t in out if b not in again]
    return [(elements[blocks[b][0]].style, text) for b, text in out]


def _feature(style: str, shown: str) -> int:
    return xxhash.xxh64_intdigest(f"{style} {shown}") - 2**63


def nodes_of(page: str) -> Iterator[tuple[str, int, int, int]]:
    """(style, content, page, feature) of a page's tree: what each node shows on the whole page (page is 1) and its different branches (feature is 1).

    Elements in which there is no text are no nodes of their own, and below an element of :data:`NEVER` there are none: it goes whole. The style of texts
    beside child elements ends in ``#``.
    """
    elements, blocks = parse(page)
    never, held = [False] * len(elements), {"": [elements[0].shown]}
    for i, e in enumerate(elements):
        never[i] = i > 0 and (never[e.parent] or e.name in NEVER and e.name not in ("form", "aside"))
        if e.name in INLINE or never[i] or e.last == e.first:
            continue
        if i:
            held.setdefault(e.style, []).append(e.shown)
        if len(e.own) < len(e.parts):
            held.setdefault(f"{e.style}#", []).extend(_clean([t for _, t in blocks[b][1]]) for b in e.own)
    for style, shown in held.items():
        if len(shown) == 1:
            yield style, _feature(style, shown[0]), 1, 1
        elif shown:
            yield style, _feature(style, chr(0).join(shown)), 1, 0
            for one in set(shown):
                yield style, _feature(style, one), 0, 1


def _hosted(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    host = F.lower(F.regexp_extract(filled(url_col), r"://([^/?#]*)", 1))
    return pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), filled(html_col).alias("html"), host.alias("host"))


def _counted(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """``host``, ``style``, ``content``, the number of ``pages`` whose node shows it and of those with such a branch (``features``)."""

    def nodes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            n: dict[tuple[str, str, int], list[int]] = {}
            for host, page in zip(batch.host, batch.html, strict=True):
                for style, content, whole, feature in nodes_of(page):
                    row = n.setdefault((host, style, content), [0, 0])
                    row[0] += whole
                    row[1] += feature
            yield pd.DataFrame([(*key, *row) for key, row in n.items()], columns=["host", "style", "content", "pages", "features"])

    seen = _hosted(pages, id_col, url_col, html_col).select("host", "html").mapInPandas(nodes, "host string, style string, content long, pages long, features long")
    return seen.groupBy("host", "style", "content").agg(F.sum("pages").alias("pages"), F.sum("features").alias("features"))


def _importance(counted: DataFrame) -> DataFrame:
    n, c = F.sum("pages"), F.col("pages").cast("double")
    entropy = F.log(n.cast("double")) - F.sum(F.when(c > 0, c * F.log(c)).otherwise(0.0)) / n
    return counted.groupBy("host", "style").agg(
        n.alias("pages"), F.count_if(c > 0).alias("contents"), F.when(n > 1, entropy / F.log(n.cast("double"))).otherwise(1.0).alias("importance")
    )


def style_tree(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``host``, ``style``, ``pages``, ``contents`` and ``importance`` (0 to 1) of every node of every host's merged tree.

    The content of a node on a page is the hash of all labels and texts below it. Importance is 1 for a node of a single page.
    """
    return _importance(_counted(pages, id_col, url_col, html_col))


def extract(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_importance: float = 0.3, least_pages: int = 20,
) -> DataFrame:
    """Per row: ``page_id``, ``url``, ``text`` (main text, blocks in page order joined by one space; empty if none) and ``n_chars``.

    A branch is removed if its node stands on at least ``least_pages`` pages of the host and its importance is below ``least_importance`` times that
    of the host's most important such node: copies of pages lower all nodes alike. A null page is an empty one; a null url, or one without a host,
    belongs to the host of the empty name. Repeated rows are extracted each and, in the tree, count as pages each; on a host of nothing but copies of
    one page everything stays. An empty table gives an empty result; other columns are not read.
    """
    counted = _counted(pages, id_col, url_col, html_col)
    tree = _importance(counted).filter(F.col("pages") >= least_pages)
    most = tree.groupBy("host").agg((F.max("importance") * least_importance).alias("least"))  # a row per host
    tree = materialize(tree.join(most, "host"))
    low = tree.filter((F.col("importance") < F.col("least")) & (F.col("style") != "")).select("host", "style", F.lit(None).cast("long").alias("feature"))
    often = counted.filter(F.col("features") >= least_pages ** (1 - least_importance)).select("host", "style", "content", "features")
    again = often.join(tree.select("host", "style", "pages", "least"), ["host", "style"]).filter(
        (1 - F.log(F.col("features").cast("double")) / F.log(F.col("pages").cast("double")) < F.col("least")) & (F.col("style") != "")
    )
    low = low.unionByName(again.select("host", F.lit(None).cast("string").alias("style"), F.col("content").alias("feature")))
    told = materialize(low.groupBy("host").agg(F.collect_set("style").alias("low"), F.collect_set("feature").alias("repeated")))  # of a site's templates

    @F.pandas_udf("string")
    def main_text(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for host, page, low, repeated in batches:
            told: dict[str, tuple[frozenset[str], frozenset[int]]] = {}
            out = []
            for h, p, g, r in zip(host, page, low, repeated, strict=True):
                if h not in told:
                    told[h] = (frozenset(), frozenset()) if g is None else (frozenset(g), frozenset(map(int, r)))
                out.append(" ".join(text for _, text in content_blocks(p, *told[h])))
            yield pd.Series(out, dtype=str)

    size = told.agg(F.sum(F.length(F.array_join("low", " ")) + F.length("host") + 8 * F.size("repeated"))).first()[0] or 0
    hosted = _hosted(pages, id_col, url_col, html_col)
    if size <= BROADCAST_CHARS:
        joined = hosted.join(F.broadcast(told), "host", "left")
    else:  # every host's pages go to SALTS tasks
        salted = told.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = hosted.withColumn("salt", F.pmod(F.xxhash64("page_id", "html"), F.lit(SALTS)).cast("int")).join(salted, ["host", "salt"], "left")
    found = joined.select("page_id", "url", main_text("host", "html", "low", "repeated").alias("text"))
    return found.withColumn("n_chars", F.length("text").cast("long"))
