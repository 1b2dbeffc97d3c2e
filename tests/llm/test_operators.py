"""The operators against brute force, on small tables with nulls, empty texts, ties, repeated rows and columns of clashing names."""

import hashlib
import json
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from changelens.llm import chat, decontamination, fingerprints, html_text, katz, languages, packing, quality, similar, url_filters
from changelens.llm.components import components

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, length int, node string, text_key int, block string, label double"


def docs_of(spark, pairs):
    """Documents with further columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, 7, "x", 1, "b", 0.5) for i, t in pairs], DOCS)


def words_of(text):
    return re.sub(r"[\W_]+", " ", (text or "").lower()).split()


def shingles_of(text):
    words = words_of(text)
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def prose(rng, n, words=400):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


@pytest.fixture(scope="module")
def mixed():
    """Ids and texts: copies, near copies, chains of near copies, edge cases."""
    rng = random.Random(5)
    out = []
    for i in range(40):
        out.append((i, prose(rng, rng.choice([3, 5, 30, 120, 300]))))
    base = prose(rng, 200).split()
    for i in range(40, 75):  # a group of near copies, of which some are linked through others only
        copy = list(base)
        for _ in range(rng.randrange(0, 8)):
            copy[rng.randrange(200)] = f"x{rng.randrange(10**6)}"
        out.append((i, " ".join(copy)))
    out += [(75, out[3][1]), (76, (out[3][1] or "").upper() + "!"), (77, None), (78, ""), (79, " \n "), (80, "..."), (41, out[41][1]), (None, out[5][1]), (81, "one two"), (82, "One, two")]
    return out


@pytest.mark.parametrize("block", [512, 8])
def test_jaccard_join_equals_brute_force(spark, mixed, monkeypatch, block):
    monkeypatch.setattr(similar, "BLOCK", block)
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.class_id if r.class_id is not None else -1, r.n_links) for r in similar.classes(docs_of(spark, mixed)).collect())
    sets = [shingles_of(t) for _, t in mixed]
    near = [[j for j in range(len(sets)) if i != j and sets[i] and sets[j] and 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j])] for i in range(len(sets))]
    want = []
    for i, (doc_id, _) in enumerate(mixed):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        ids = [mixed[j][0] for j in seen if mixed[j][0] is not None]
        want.append((doc_id if doc_id is not None else -1, min(ids, default=-1), len(near[i])))
    assert got == sorted(want)


def test_one_of_each_keeps_columns_and_the_smallest_id(spark, mixed):
    docs = docs_of(spark, mixed)
    kept = similar.one_of_each(docs)
    assert kept.columns == docs.columns
    classes = {r.doc_id: r.class_id for r in similar.classes(docs).collect() if r.doc_id is not None}
    assert Counter(r.doc_id for r in kept.collect()) == Counter(i for i, _ in mixed if i is None or classes[i] == i)


def test_components_of_chains_stars_and_nothing(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(5, j) for j in range(6, 30)] + [(50, 50), (None, 3)]
    found = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {i: 100 for i in range(100, 141)} | {i: 5 for i in range(5, 30)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_matched_depth_is_the_longest_with_the_recall():
    depth = similar.matched_depth(24, 8, 0.8, 0.9999)
    recall = lambda d: 1 - (1 - 0.8**d) ** 24
    assert recall(depth) >= 0.9999 > recall(depth + 1)


def test_packing_round_trip(spark):
    rng = random.Random(1)
    pairs = [(i, prose(rng, rng.choice([0, 1, 20, 300, 900, 3000]))) for i in range(60)]
    pairs += [(60, None), (61, ""), (62, "a  b \n\n c\t "), (63, "x<|endoftext|> y"), (64, " lead"), (65, "nul\0 byte"), (3, pairs[3][1]), (None, "no id")]
    pieces = packing.pieces(docs_of(spark, pairs), TOKENIZER, keep_ids=True).cache()
    packed = packing.pack(pieces).toPandas()
    assert packed.groupby("sequence_id").length.sum().max() <= 1024
    placed = packed.sort_values(["sequence_id", "offset"])
    assert ((placed.groupby("sequence_id").length.cumsum() - placed.length) == placed.offset).all()
    from tokenizers import Tokenizer

    encoder = Tokenizer.from_file(TOKENIZER)
    want = Counter()
    for doc_id, text in pairs:
        ids = [*encoder.encode(text or "", add_special_tokens=False).ids, 2]
        start = 0
        for number, end in enumerate([*range(len(ids) % 1024 or 1024, len(ids), 1024), len(ids)] if len(ids) > 1024 else [len(ids)]):
            want[doc_id if doc_id is not None else -1, number, start, end - start, zlib.crc32(np.array(ids[start:end], "<u4").tobytes())] += 1
            start = end
    assert Counter(zip(packed.doc_id.fillna(-1).astype(int), packed.piece, packed.start, packed.length, packed.ids_crc32)) == want
    free: list[int] = []
    for length in sorted(packed.length, reverse=True):  # first fit, the longest first
        fits = next((i for i, room in enumerate(free) if room >= length), None)
        free.append(1024 - length) if fits is None else free.__setitem__(fits, free[fits] - length)
    assert packed.sequence_id.nunique() <= len(free) + 1
    whole = {r.sequence_id: r for r in packing.sequences(pieces, packing.pack(pieces)).collect()}
    part = packed[(packed.doc_id == 62)].iloc[0]
    holding = next(r for r in whole.values() if 62 in r.doc_ids)
    start, length = holding.starts[holding.doc_ids.index(62)], int(part.length)
    assert zlib.crc32(np.array(holding.ids[start : start + length], "<u4").tobytes()) == part.ids_crc32


def test_best_two_fit_swaps_the_smallest_for_a_tighter_pair():
    counts = np.zeros(11, np.int64)
    counts[[6, 3, 2]] = [1, 1, 2]
    assert next(iter(packing.best_two_fit(counts))) == ((6, 2, 2), 1)  # 6 + 3 leaves 1; 2 + 2 fill the gap of 4
    rng = np.random.default_rng(0)
    counts = np.bincount(rng.integers(1, 1025, 5000), minlength=1025)
    bins = list(packing.best_two_fit(counts))
    used = np.zeros(1025, np.int64)
    for inside, times in bins:
        assert sum(inside) <= 1024
        used += times * np.bincount(inside, minlength=1025)
    assert (used == counts).all() and sum(t for _, t in bins) <= 1.01 * math.ceil((counts * np.arange(1025)).sum() / 1024)


ARTICLE = "<html><head><title>t</title><style>p{{}}</style></head><body><nav><a href=/>Home</a></nav><article><header><h1>T &amp;amp; {0}</h1></header><p>One <b>bold</b>\n {0}<p>Two<br>three <!-- no --><ul><li>a<li>b</ul><div class='share-bar'>Share</div><p class=promo-line>{1}</p></article><div id='comments'>c</div><footer>f</footer>"


def test_extraction_of_one_page_and_of_a_site(spark):
    pages = [(i, f"http://Host.example/{i}", ARTICLE.format(f"page {i}", "x"), "c") for i in range(3)]
    pages += [(10, None, None, "c"), (11, "http://a.b/", "", "c"), (12, "no url", "just text &lt;", "c"), (13, "http://a.b/2", "<p>open <script>var a='</p>'", "c"), (0, pages[0][1], pages[0][2], "c")]
    found = [(r.page_id, r.text, r.n_chars) for r in html_text.extract(spark.createDataFrame(pages, "page_id long, url string, html string, host string")).collect()]
    want = lambda i: f"T &amp; page {i} One bold page {i} Two three a b"
    texts = [(i, want(i)) for i in (0, 0, 1, 2)] + [(10, ""), (11, ""), (12, "just text <"), (13, "open")]
    assert sorted(found) == sorted((i, t, len(t)) for i, t in texts)
    site = [(i, f"http://s.example/{i}", f"<div class=top>Welcome to {i % 2}</div><div class=body>text {i} {i * i}</div>", "") for i in range(40)]
    tree = {r.style: r for r in html_text.style_tree(spark.createDataFrame(site, "page_id long, url string, html string, host string")).collect()}
    assert tree[">div.top"].importance == pytest.approx(math.log(2) / math.log(40)) and tree[">div.body"].importance == pytest.approx(1)
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(site, "page_id long, url string, html string, host string")).collect()}
    assert got == {i: f"text {i} {i * i}" for i in range(40)}
    copies = spark.createDataFrame([(i, "http://c.example/", "<p>same</p>") for i in range(50)], "page_id long, url string, html string")
    assert {r.text for r in html_text.extract(copies).collect()} == {"same"}


def test_marked_parts_of_a_page():
    text = lambda page: " ".join(t for _, t in html_text.content_blocks(page))
    assert text("<div class=page-header>Site</div><h1 class=header>Title</h1><p>One</p><div role=search>Find</div>") == "Title One"
    assert text("<main><p>Path > here</p><article><h1>T</h1>a</article><aside>x</aside></main><p>out</p>") == "T a"
    assert text("<main><header><h1>T</h1></header><p>m</p><form>f</form></main><p>out</p>") == "T m"
    assert text("<p title='a > b' class=x>q<br/>r &#233;&eacute;&nbsp;s<p>t</b></div>u") == "q r éé s tu"
    assert text("<ul><li>1<ul><li>2</ul><li>3</ul><dl><dt>a<dd>b</dl>") == "1 2 3 a b"
    assert text("<table><tr><td>1<td>2<tr><th>3</table><select><option>no</select>") == "1 2 3"


def test_branches_that_repeat_on_a_site(spark):
    page = lambda i: f"<div class=zz>Our <div class=yy>shop</div> {i % 2}</div><article><p>text {i} of {i * i}</p><p>more words {i + 7} {i % 9}</p><p>Join us</p></article>"
    plain = lambda i: f"<div class=zz>Our <div class=yy>shop</div> {i % 2}</div><div class=b><p>text {i} {i * i}</p><div>Join us</div></div>"
    rows = [(i, f"http://a.example/{i}", page(i)) for i in range(40)] + [(100 + i, f"http://b.example/{i}", plain(i)) for i in range(40)]
    rows += [(200 + i, "http://c.example/", f"<article><p>a text that is copied</p><p>and another one</p><p>{i}</p></article>") for i in range(40)] + [(300, "http://d.example/", page(3))]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    want = {i: f"text {i} of {i * i} more words {i + 7} {i % 9}" for i in range(40)} | {100 + i: f"text {i} {i * i}" for i in range(40)}
    want |= {200 + i: f"a text that is copied and another one {i}" for i in range(40)} | {300: "text 3 of 9 more words 10 3 Join us"}  # copies, and one page of a host
    assert got == want


def test_names_of_wrappers_and_parts_of_an_article():
    text = lambda page: " ".join(t for _, t in html_text.content_blocks(page))
    for wrapper in ("class='layout has-sidebar'", "class=no-sidebar", "class='with-comments'", "class=menu-open", "id=comments", "class=sidebar"):
        assert text(f"<nav>n</nav><div {wrapper}><article>a</article></div>") == "a"
    assert text("<form class=cookie><main><p>m</p></main></form>") == "m" and text("<div class=has-sidebar>a<div class=left-sidebar>s</div></div>") == "a"
    assert text("<article>a<section class=related-work>r</section><p class=notice>n</p><div id=share-price>s</div></article>") == "a r n s"
    assert text("<p>so <math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>x=1</annotation></math></p>") == "so x=1"
    assert text("<article>a</article><div id=comments><article>c</article></div>") == "a" and text("<div class=sidebar>all</div>") == "all"


def test_leaks_equal_brute_force(spark):
    rng = random.Random(9)
    items = [(i, prose(rng, rng.choice([3, 5, 16, 40]))) for i in range(12)] + [(12, None), (13, ""), (14, "w1 w1 w1 w1 w1 w1 w1 w1 w1"), (15, "one two")]
    pairs = []
    for i in range(40):
        text = prose(rng, rng.choice([0, 4, 60, 200])).split()
        for _ in range(rng.randrange(3)):
            leak = items[rng.randrange(16)][1] or ""
            leak = leak.split()
            if rng.random() < 0.5 and len(leak) > 30:
                leak[rng.randrange(len(leak))] = "changed"
            at = rng.randrange(len(text) + 1)
            text[at:at] = leak if rng.random() < 0.5 else [w.upper() + "," for w in leak]
        pairs.append((i, " ".join(text)))
    pairs += [(40, None), (41, items[3][1]), (42, " ".join((items[2][1] or "").split()[:-1])), (3, pairs[3][1])]
    table = spark.createDataFrame([(i, t, 1, "n") for i, t in items], "item_id long, text string, n int, shingles string")
    got = {(r.doc_id, r.item_id): (r.start, r.n_words, round(r.similarity, 9)) for r in decontamination.find_leaks(docs_of(spark, pairs), table).collect()}

    def bag(words):
        return Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4)) or Counter([tuple(words)] if words else [])

    want = {}
    for doc_id, text in pairs:
        words = words_of(text)
        for item_id, item in items:
            target, n = bag(words_of(item)), len(words_of(item))
            for start in range(max(1, len(words) - n + 1)) if n else ():
                window = bag(words[start : start + n])
                likeness = sum((window & target).values()) / max(1, sum((window | target).values()))
                if likeness >= 0.8 and likeness > want.get((doc_id, item_id), (0, 0, 0))[2] + 1e-12:
                    want[doc_id, item_id] = (start, n, round(likeness, 9))
    assert got == want
    docs = docs_of(spark, pairs)
    clean = decontamination.clean(docs, table)
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == {i for i, _ in pairs} - {d for d, _ in want}


def test_simhash_blocks_find_all_within_the_radius(spark):
    rng = random.Random(2)
    base = [rng.getrandbits(64) - 2**63 for _ in range(20)]
    near = []
    for b in base:
        for flips in (0, 1, 7, 20):
            mask = sum(1 << k for k in rng.sample(range(64), flips))
            near.append(((b & (2**64 - 1)) ^ mask) - (2**64 if ((b & (2**64 - 1)) ^ mask) >= 2**63 else 0))
    from pyspark.sql import functions as F

    a = spark.createDataFrame([(b,) for b in base], "a long").select("a", F.explode(decontamination.near_block_values(F.col("a"), 20)).alias("v"))
    b = spark.createDataFrame([(x,) for x in near], "b long").select("b", F.explode(decontamination.block_values(F.col("b"))).alias("v"))
    found = {(r.a, r.b) for r in a.join(b, "v").select("a", "b").distinct().collect()}
    assert {(x, y) for x in base for y in near if ((x ^ y) & (2**64 - 1)).bit_count() <= 20} <= found


def test_fingerprints_estimate_the_likeness(spark, mixed):
    pairs = [(i if i is not None else None, t) for i, t in mixed]
    rows = fingerprints.fingerprint_documents(docs_of(spark, pairs)).select("doc_id", "text", "fingerprint", "n_chars", "next").collect()
    assert len(rows) == len(pairs)
    by_text = {}
    for r in rows:
        assert by_text.setdefault(r.text, r.fingerprint) == r.fingerprint and len(r.fingerprint) == 256
    ids = [r.doc_id for r in rows]
    assert sorted((i for i, _ in mixed if i is not None)) == sorted(i for i in ids if i is not None)
    order = sorted(((i is not None, i if i is not None else 0), t or "") for i, t in pairs)
    nexts = {(r.doc_id, r.text): r.next.text for r in rows}
    unique = [i for i, n in Counter(i for i, _ in pairs).items() if n == 1 and i is not None]
    text_of = dict(pairs)
    for i in unique:
        below = [j for j, _ in pairs if j is not None and j < i]
        if below and below.count(max(below)) == 1:
            assert nexts[i, text_of[i] or ""] == (text_of[max(below)] or "")
    assert order and nexts[None, text_of[None]] == (text_of[82] or "")  # after the last comes the first
    from pyspark.sql import functions as F

    some = [t for _, t in mixed if t and len(t) > 400][:25]
    crossed = spark.createDataFrame([(a, b) for a in some for b in some], "a string, b string").select("a", "b", fingerprints.likeness(fingerprints.fingerprint(F.col("a")), fingerprints.fingerprint(F.col("b"))).alias("near")).collect()
    wrong = [r.near - len(shingles_of(r.a) & shingles_of(r.b)) / len(shingles_of(r.a) | shingles_of(r.b)) for r in crossed]
    assert max(map(abs, wrong)) < 0.16 and abs(sum(wrong) / len(wrong)) < 0.02


def test_next_rows_of_hot_and_null_ids(spark):
    rng = random.Random(3)
    pairs = [(rng.choice([7, 7, None, i]), f"text {i}") for i in range(300)]
    rows = fingerprints.with_next(
        docs_of(spark, pairs).selectExpr("doc_id", "text", "xxhash64(text) AS text_key"), ["doc_id", "text_key"], range_rows=38
    ).collect()
    order = sorted(((r.doc_id is not None, r.doc_id or 0, r.text_key) for r in rows), reverse=True)
    following = dict(zip(order, [*order[1:], order[0]]))
    assert len(rows) == 300 and all(following[r.doc_id is not None, r.doc_id or 0, r.text_key] == (r.next.doc_id is not None, r.next.doc_id or 0, r.next.text_key) for r in rows)


def test_many_null_ids_do_not_multiply(spark):
    rng = random.Random(11)
    base = [prose(rng, 60) for _ in range(30)]
    rows = [(None, t) for t in base for _ in range(3)] + [(None, t + " end") for t in base]
    got = similar.classes(docs_of(spark, rows)).collect()
    assert len(got) == 120 and {r.n_links for r in got} == {3} and {r.class_id for r in got} == {None}


def test_edited_text(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([("abcdefg", "XY"), ("", "Z"), ("ab", "Q"), ("héllo wörld", "ñandú")], "t string, n string")
    got = [r[0] for r in rows.select(fingerprints.edited(F.col("t"), F.length("t"), F.col("n"))).collect()]
    assert got == ["abcdeXY", "", "ab", "héllo wöñan"]
    assert hashlib.sha256(got[3].encode()).hexdigest()


def test_language_filters(spark):
    rng = random.Random(4)
    syllables = {"aa": ["tha", "ing", "ere"], "bb": ["sch", "ung", "ber"], "cc": ["eau", "ment", "éux"]}
    make = lambda lang: " ".join("".join(rng.choice(syllables[lang]) for _ in range(3)) for _ in range(40))
    rows = [(i, make(lang), lang) for i, lang in enumerate(["aa", "bb", "cc"] * 40)] + [(200, None, "aa"), (201, "", None), (202, "123 !?", "bb"), (203, make("aa").upper(), None), (None, make("cc"), None)]
    docs = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, lang string, score double")
    filters = languages.fit(docs)
    got = {r.doc_id: r for r in languages.identify(docs, filters).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang in rows[:120])
    assert [got[i].lang_pred for i in (200, 201, 202, 203, None)] == ["und", "und", "und", "aa", "cc"]
    assert all(0 <= r.score <= 1 for r in got.values()) and got[5].held_out == (zlib.crc32(b"5") % 4 == 2)
    text = "x" * 5 + make("aa")
    assert filters.predict([text, "a", make("bb")])[1][0] == pytest.approx(filters.predict([text])[1][0])  # other texts of a batch do not count
    empty = docs.filter("false")
    assert languages.identify(empty, languages.fit(empty)).count() == 0
    assert {r.lang_pred for r in languages.identify(docs, languages.fit(empty)).collect()} == {"und"}


def test_rare_and_many_languages(spark):
    rng = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyz"
    syllables = [["".join(rng.choice(letters) for _ in range(4)) for _ in range(4)] for _ in range(70)]
    make = lambda n: " ".join("".join(rng.choice(syllables[n]) for _ in range(2)) for _ in range(40))
    rows = [(i, make(n), f"l{n:02}") for i, n in enumerate([0] * 2000 + [n for n in range(1, 70) for _ in range(8)])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(2)
    few = docs.filter("lang IN ('l00', 'l01')")
    filters = languages.fit(few, max_train=200)  # l01 has 8 rows: all of them count
    assert filters.languages == ("l00", "l01") and set(filters.predict([t for _, t, lang in rows if lang == "l01"])[0]) == {"l01"}
    every = languages.fit(docs, max_train=200)
    assert len(every.languages) == 70
    names, scores = every.predict([t for _, t, _ in rows[1990:]])
    assert names == [lang for _, _, lang in rows[1990:]] and min(scores) > 0.5
    table = np.zeros((1, 1024), np.uint64)  # a winner of 0.9 with eleven others of half of it is a clear one
    alike = languages.Filters(tuple("abcdefghijkl"), (2,), 2, table)
    object.__setattr__(alike, "shares", lambda values: np.array([[0.9] + [0.45] * 11] * len(values)))
    assert alike.predict(["some text"])[1][0] == pytest.approx(0.9)


def test_url_rules_equal_brute_force(spark):
    rules = [url_filters.Rule("allow", "com", "/"), url_filters.Rule("block", "example.com", "/en/"), url_filters.Rule("allow", "www.example.com", "/en/"), url_filters.Rule("block", "net", "/es"), url_filters.Rule("block", "", "")]
    rules = rules[:-1]
    rng = random.Random(6)
    urls = [None, "", "no scheme", "http://", "https://com", "https://COM/", "x://www.Example.com/en/1?a#b", "http://a.net/esx", "http://a.net?/es", "http://notexample.com/en/", "http://a..com//", "a://b://c"]
    urls += [f"http://{rng.choice(['', 'a.', 'www.'])}{rng.choice(['example.com', 'Net', 'net', 'org', 'com'])}{rng.choice(['', '/', '/en/', '/en', '/es/x'])}{rng.choice(['', '?q=/en/', '#x'])}" for _ in range(200)]
    pages = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(urls)], "page_id long, url string, host string, rule string")

    def split(u):
        if not u or "://" not in u:
            return "", ""
        rest = u.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        return host.lower(), re.match(r"[^?#]*", rest[len(host) :])[0]

    want = {}
    for i, u in enumerate(urls):
        host, path = split(u)
        fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        best = max(fits, key=lambda r: len(r.text), default=None)
        want[i] = (host, path, best and best.text, best.action if best else "allow")
    for bits in (1 << 20, 0):
        assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filters.judge(pages, rules, max_bits=bits).collect()} == want
    assert url_filters.judge(pages.filter("false"), rules).count() == 0
    assert {r.verdict for r in url_filters.judge(pages, [], default="block").collect()} == {"block"}


def test_a_cascade_is_exact_over_its_universe(spark):
    from pyspark.sql import functions as F

    universe = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = spark.range(0, 3500, 7).select(F.concat(F.lit("k"), "id").alias("key"))
    cascade = url_filters.build_cascade(universe, listed, 1 << 20)
    assert len(cascade.levels) > 2
    got = {r.key for r in universe.filter(cascade.contains(F.col("key"))).collect()}
    assert got == {f"k{i}" for i in range(0, 3000, 7)}
    assert url_filters.build_cascade(universe, listed, 64) is None


def test_boosted_trees(spark):
    rng = random.Random(8)
    good = lambda: ". ".join(prose(rng, 12) for _ in range(5))
    bad = lambda: " ".join(["w1"] * 30) if rng.random() < 0.5 else "!! ".join(prose(rng, 40).upper().split())
    rows = [(i, good() if i % 2 else bad()) for i in range(300)] + [(300, None), (301, ""), (None, good()), (5, good())]
    docs = docs_of(spark, rows)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(300)] + [(None, 1, 0), (7, None, 0), (7, 1, 1)], "doc_id long, quality int, toxic int")
    got = quality.classify(docs, quality.fit(docs, labels)).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    held = [r for r in got if r.held_out and r.doc_id < 300]
    assert held and sum(r.predicted == r.doc_id % 2 for r in held) / len(held) > 0.95
    assert {r.score for r in quality.classify(docs, quality.fit(docs, labels.filter("false"))).collect()} == {0.5}
    assert quality.classify(docs.filter("false"), quality.fit(docs.filter("false"), labels)).count() == 0


def test_flat_trees_walk_as_nested_ones():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 3))
    y = ((x[:, 0] > 0.2) ^ (x[:, 1] > -0.1)).astype(float)
    trees = quality.grow(x, y, trees=30, depth=3)

    def walk(row):
        margin = trees.start
        for f, t, leaf in zip(trees.feature, trees.threshold, trees.leaf):
            node = 0
            while node < len(f):
                node = 2 * node + (2 if row[f[node]] > t[node] else 1)
            margin += leaf[node - len(f)]
        return 1 / (1 + math.exp(-margin))

    assert np.allclose(trees.score(x), [walk(r) for r in x]) and ((trees.score(x) > 0.5) == (y == 1)).mean() > 0.97


def katz_model(train, order):
    """Brute force: counts in dictionaries, the same losses, weights from sums over the whole vocabulary."""
    counts = [Counter() for _ in range(order + 1)]
    for tokens in train:
        padded = ["<s>"] * (order - 1) + tokens
        for i in range(order - 1, len(padded)):
            for k in range(1, order + 1):
                counts[k][tuple(padded[i - k + 1 : i + 1])] += 1
    lost = [None] + [katz.discounts(np.array([0, *[sum(v == r for v in counts[k].values()) for r in range(1, katz.LARGE + 2)]])) for k in range(1, order + 1)]
    total, vocabulary = sum(counts[1].values()), sorted(w for (w,) in counts[1])
    back = lambda k, c: lost[k][min(c, katz.LARGE)]
    unknown = sum(back(1, c) for c in counts[1].values()) / total

    followers = {}
    for k in range(2, order + 1):
        for gram, c in counts[k].items():
            followers.setdefault(gram[:-1], {})[gram[-1]] = c

    def chance(word, history):
        if not history:
            c = counts[1][(word,)]
            return (c - back(1, c)) / total if c else unknown
        after = followers.get(history)
        if after is None:
            return chance(word, history[1:])
        k, of = len(history) + 1, sum(after.values())
        if word in after:
            return (after[word] - back(k, after[word])) / of
        kept = sum(back(k, c) for c in after.values()) / of
        return kept / (1 - sum(chance(w, history[1:]) for w in after)) * chance(word, history[1:])

    return chance, vocabulary, counts, total


@pytest.mark.parametrize(("order", "gram_limit"), [(2, 2_000_000), (3, 40)])
def test_katz_equals_brute_force_and_sums_to_one(spark, monkeypatch, order, gram_limit):
    monkeypatch.setattr(katz, "BLOCK_TOKENS", 300)
    monkeypatch.setattr(katz, "BUCKET_GRAMS", gram_limit)
    rng = random.Random(7)
    rows = [(i, " ".join(f"W{min(int(rng.expovariate(0.08)), 90)}" for _ in range(rng.choice([0, 1, 30, 80])))) for i in range(60)]
    rows += [(60, None), (61, "new words here W1 W2"), (62, "Été W1\x0bW2\u00a0W3"), (None, "W1 W2"), (4, rows[4][1])]
    tokens = [[*re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in t or "")), "</s>"] for _, t in rows]
    train = [t for (i, _), t in zip(rows, tokens) if i is not None and zlib.crc32(str(i).encode()) % 5 != 1]
    chance, vocabulary, counts, total = katz_model(train, order)
    for history in [("w1",), ("w2",), ("<s>",)] if order == 2 else [("w1", "w2"), ("<s>", "<s>"), ("w3", "w1")]:
        assert sum(chance(w, history) for w in vocabulary) + chance("never", history) == pytest.approx(1)
    got = Counter()
    for r in katz.score(docs_of(spark, rows), order=order).collect():
        got[r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 3)] += 1
    want = Counter()
    for (i, _), text in zip(rows, tokens):
        padded = ["<s>"] * (order - 1) + text
        model = sum(math.log10(chance(padded[j], tuple(padded[j - order + 1 : j]))) for j in range(order - 1, len(padded)))
        base = sum(math.log10((counts[1][(w,)] + 0.5) / (total + 0.5 * (len(vocabulary) + 1))) for w in text)
        want[i, i is not None and zlib.crc32(str(i).encode()) % 5 == 1, len(text), sum(counts[1][(w,)] > 0 for w in text), total, round(base, 6), round(model, 3)] += 1
    assert got == want


def test_katz_of_empty_and_untrained_tables(spark):
    docs = docs_of(spark, [(1, "a b")])
    assert katz.score(docs.filter("false")).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1)
    row = katz.score(docs_of(spark, [(held, "a b")])).first()
    assert (row.held_out, row.n_tokens, row.n_known, row.train_tokens, row.base_score, row.score) == (True, 3, 0, 0, 0.0, 0.0)


CALLS = json.dumps({"content": None, "tool_calls": [{"id": "b", "name": "add", "arguments": {"x": 1.0, "y": "$a"}}, {"id": "a", "name": "add", "arguments": "{\"x\": \"no\", \"é\": 2}"}]})
CHAT = [
    (1, 0, "user", "hi \"you\" é\n"), (1, 1, "assistant", CALLS), (1, 2, "tool", json.dumps({"tool_call_id": "a", "content": {"z": 1, "b": [2.5]}})),
    (1, 3, "tool", json.dumps({"tool_call_id": "a", "content": "again"})), (1, 4, "tool", json.dumps({"tool_call_id": "zz", "content": 1})), (1, 5, None, None),
    (2, 0, "tool", json.dumps({"tool_call_id": "a", "content": 5})), (2, 1, "assistant", json.dumps({"tool_calls": [{"id": "a", "name": "t", "arguments": {}}]})),
    (3, 0, "assistant", json.dumps({"tool_calls": [{"id": "p", "name": "t", "arguments": {"v": "$q"}}, {"id": "q", "name": "t", "arguments": {"v": "$p"}}]})),
    (3, 1, "assistant", "{broken"), (None, 0, "tool", json.dumps({"tool_call_id": "a", "content": 0})), (4, 0, "user", ""), (4, 0, "user", ""),
]


def test_chat_links_orders_and_validates(spark):
    table = spark.createDataFrame([(*r, "k", "c") for r in CHAT], "conv_id long, turn long, role string, text string, kind string, calls string")
    schema = {"add": {"type": "object", "properties": {"x": {"type": "number"}, "y": {"type": "string"}}, "required": ["x"], "additionalProperties": False}}
    rows = chat.format_chat(table, schema).collect()
    assert len(rows) == len(CHAT)
    by = {(r.conv_id, r.turn): r for r in rows}
    assert [by[1, t].status for t in range(6)] == ["plain", "open", "linked", "repeated", "orphan", "plain"]
    assert (by[2, 0].status, by[2, 0].order_turn, by[2, 0].order_rank) == ("linked", 1, 1) and by[2, 1].status == "answered"
    assert (by[3, 0].status, by[3, 1].status, by[None, 0].status) == ("cyclic", "plain", "orphan")
    assert (by[1, 1].n_calls, by[1, 1].n_invalid) == (2, 1)
    message = json.loads(by[1, 1].message)
    assert [c["id"] for c in message["tool_calls"]] == ["a", "b"]  # b uses a's result
    assert by[1, 0].message == '{"content":"hi \\"you\\" é\\n","role":"user"}'
    assert by[1, 2].message == '{"content":{"b":[2.5],"z":1},"name":"add","role":"tool","tool_call_id":"a"}'
    for r in rows:
        assert json.dumps(json.loads(r.message), sort_keys=True, separators=(",", ":"), ensure_ascii=False) == r.message
    assert chat.format_chat(table.filter("false")).count() == 0


def test_schema_problems():
    schema = {"type": "object", "properties": {"n": {"type": "integer", "minimum": 1}, "k": {"enum": ["a"]}, "l": {"type": "array", "items": {"type": ["string", "null"]}}}}
    problems = [chat.problem_of(v, schema) for v in ({"n": 1, "l": ["x", None]}, {"n": 0}, {"n": True}, {"n": 1.5}, {"k": "b"}, {"l": ["x", 1]}, [])]
    assert problems == [None, "$.n: bounds", "$.n: type", "$.n: type", "$.k: enum", "$.l[1]: type", "$: type"]


def test_empty_tables(spark):
    none = docs_of(spark, [(1, "x")]).filter("false")
    items = spark.createDataFrame([(1, "a b c d e f g")], "item_id long, text string")
    assert similar.classes(none).count() == 0
    assert packing.pack_documents(none, TOKENIZER).count() == 0
    assert fingerprints.fingerprint_documents(none).count() == 0
    assert decontamination.find_leaks(none, items).count() == 0 and decontamination.find_leaks(docs_of(spark, [(1, "x y")]), items.filter("false")).count() == 0
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


@pytest.mark.parametrize("ids", [[5], [5, 5], [None], [3, 9], list(range(0, 2_000, 3))])
def test_next_rows_over_many_ranges(spark, ids):
    from pyspark.sql import functions as F

    frame = spark.createDataFrame([(i, f"t{n}") for n, i in enumerate(ids)], "doc_id long, text string").withColumn("text_key", F.xxhash64("text"))
    rows = fingerprints.with_next(frame, ["doc_id", "text_key"], range_rows=7).collect()
    place = lambda r: (r.doc_id is not None, r.doc_id or 0, r.text_key)
    order = sorted(map(place, rows), reverse=True)
    following = dict(zip(order, [*order[1:], order[0]]))
    assert len(rows) == len(ids) and all(following[place(r)] == place(r.next) for r in rows)


@pytest.mark.parametrize("n", [0, 1, 2, 20, 255, 256, 5_000])
def test_packed_keys_come_back_and_small_rows_stay_small(n):
    keys = np.unique(np.random.default_rng(n).integers(0, 2**48, n, dtype=np.uint64))
    data = katz._write_keys(keys)
    assert (katz._read_keys(data) == keys).all()
    assert len(data) <= 40 + 5.2 * len(keys)
    same = np.arange(n, dtype=np.uint64)  # all in one run
    assert (katz._read_keys(katz._write_keys(same)) == same).all()
