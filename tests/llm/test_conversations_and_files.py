"""Conversation repair, prefix trie and token files against brute force, round trips and hard cases."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from changelens.llm import prefix_trie, repair, token_files

TURNS = "conv_id bigint, turn bigint, role string, text string"
LEGAL = re.compile(r"(s?(ua)+)?")
SPACE = " \t\n\x0b\x0c\r"


# ----------------------------------------------------------------------------- op11 ---
def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if v is None else v for v in (role, text))
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        hit = zlib.crc32(key.encode()) % 20
        row = (turn, "user" if hit == 4 else role, "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text)
        out += [(conv, row)] * (hit != 0) * (2 if hit == 3 else 1)
    return out


def by_definition(rows):
    """The repair of one conversation's (turn, role, text) by trying every sequence of edits that can still be best."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, told, counts = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
    for _, role, text in rows:
        core = text.rstrip(SPACE)
        fault = "blank" if not core else "duplicate" if (role, text) in seen else "truncated" if core[-1] not in ".!?" else None
        seen.add((role, text))
        told.append((role, text, fault))
        if fault:
            counts[fault] += 1
    best = [(10**9, "", None)]

    def walk(at, cost, audit, turns):
        initials = "".join(role[:1] if role else "-" for role, _ in turns)
        if (cost, audit) >= best[0][:2] and cost > best[0][0] or cost > best[0][0] or not re.fullmatch(r"s?(ua)*u?", initials):
            return
        if at == len(told) and LEGAL.fullmatch(initials) and (cost, audit) < best[0][:2]:
            best[0] = (cost, audit, turns)
        if audit[-2:] != "II":
            for role in ("user", "assistant"):
                walk(at, cost + 5, audit + "I", turns + [(role, "")])
        if at < len(told):
            role, text, fault = told[at]
            walk(at + 1, cost + 2, audit + "D", turns)
            if fault not in ("blank", "duplicate"):
                more = 5 * (fault == "truncated")
                walk(at + 1, cost + more, audit + "K", turns + [(role, text)])
                for other in ("user", "assistant"):
                    walk(at + 1, cost + 1 + more, audit + "R", turns + [(other, text)])

    best[0] = (2 * len(told) + 1, "", None)
    walk(0, 0, "", [])
    cost, audit, turns = best[0]
    known = [r[0] for r in rows if r[0] is not None]
    pairs = ["".join(r[1][:1] for r in pair) for pair in itertools.pairwise(rows)]
    return {
        "gaps": max(known) - min(known) + 1 - len(set(known)) if known else 0, **counts, "illegal": sum(p not in ("su", "ua", "au") for p in pairs), "cost": cost, "audit": audit,
        "repaired_sha256": hashlib.sha256("\n".join(f"{a}:{b}" for a, b in turns).encode()).hexdigest(),
    }, turns


def conversations(seed, n=120):
    rng = random.Random(seed)
    texts = ["One.", "Two!", "cut off", "", "  \n", "Three?", "One. ", "é.", "tail.\x0b", None]
    rows = []
    for conv in range(n):
        for turn in rng.sample(range(9), rng.randint(0, 5)):
            rows.append((conv, turn if rng.random() > 0.1 else None, rng.choice(["user", "assistant", "system", "tool", "", None]), rng.choice(texts)))
    return rows


@pytest.mark.parametrize("segment", [512, 2])
def test_repair_equals_every_sequence_of_edits(spark, monkeypatch, segment):
    monkeypatch.setattr(repair, "SEGMENT", segment)
    rows = conversations(11)
    frame = spark.createDataFrame(rows, TURNS).withColumn("fault", F.lit("x")).withColumn("copy", F.lit(1)).withColumn("gone", F.lit(True))
    if segment == 2:  # workers do not see what was patched here
        got = {}
        order = sorted(damaged(rows), key=lambda r: (r[0], r[1][0] is not None, r[1][0] or 0, r[1][1], r[1][2]))
        for conv, group in itertools.groupby(order, key=lambda r: r[0]):
            now, seen = repair.Conversation(conv, True), set()
            for _, (turn, role, text) in group:
                core = text.rstrip(SPACE)
                now.add(turn, role, text, "b" if not core else "d" if (role, text) in seen else "t" if core[-1] not in ".!?" else "")
                seen.add((role, text))
            got[conv] = now.result()
    else:
        got = {r.conv_id: r.asDict(recursive=True) for r in repair.repair(frame, damaged=True, turns=True).collect()}
        assert got.keys() == {r[0] for r in rows}
    for conv in got:
        want, turns = by_definition([row for c, row in damaged(rows) if c == conv])
        assert {k: got[conv][k] for k in want} == want, conv
        assert [(t["role"], t["text"]) for t in got[conv]["turns"]] == turns


def test_repair_of_plain_rows_and_hard_cases(spark):
    rows = [
        (1, 0, "user", "Hi."), (1, 1, "assistant", "Yes."), (2, None, "user", "a."), (2, None, "user", "a."), (3, 5, "system", "Rules."),
        (None, 0, "user", "Who?"), (None, 1, "assistant", "Me."), (4, 0, "user", "x" * 300_000), (4, 0, "assistant", "y" * 300_000 + "."),
    ]
    got = {r.conv_id: r for r in repair.repair(spark.createDataFrame(rows, TURNS), turns=True).collect()}
    assert got[1].audit == "KK" and got[1].cost == 0 and len(got[1].turns) == 2
    assert got[2].duplicate == 1 and got[2].audit == "DD" and got[2].cost == 4 and got[2].gaps == 0
    assert got[3].audit == "D" and got[3].turns == [] and got[3].repaired_sha256 == hashlib.sha256(b"").hexdigest()
    assert got[None].audit == "KK" and got[4].truncated == 1 and got[4].audit == "DD" and got[4].cost == 4
    assert repair.repair(spark.createDataFrame([], TURNS), damaged=True).count() == 0


def test_conversations_beyond_a_segment_and_search_equal_dynamic_programming():
    def least(codes):
        spread = lambda open_: [open_ := {**open_, to: min(v, open_.get(to, v))} for s, (c, a) in sorted(open_.items()) for to in [repair.FILL[s][1]] for v in [(c + 5, a + "I")]][-1]
        open_ = spread(spread(spread({0: (0, "")})))
        for code in codes:
            after = {}
            for state, (cost, audit) in open_.items():
                for letter, price, used, to in repair.edits(code, state):
                    if used and (cost + price, audit + letter) < after.get(to, (10**9, "")):
                        after[to] = (cost + price, audit + letter)
            open_ = spread(spread(spread(after)))
        return min(open_[s] for s in (0, 3) if s in open_)

    rng = random.Random(2)
    for number in range(200):
        codes = "".join(rng.choices("uuuaaasoxUAS", k=rng.randint(0, 60)))
        assert repair.search(codes, 0, (0, 3)) == least(codes)
    codes = rng.choices("uuuuaaaasoxUAS", k=5_000)  # ten segments
    now = repair.Conversation(1, True)
    for at, code in enumerate(codes):
        role = {"u": "user", "a": "assistant", "s": "system", "o": "tool", "x": "user"}[code.lower()]
        now.add(at, role, f"t{at}", "b" if code == "x" else "t" if code.isupper() else "")
    found = now.result()
    assert (found["cost"], found["audit"]) == least(codes)
    assert LEGAL.fullmatch("".join(t["role"][0] for t in found["turns"]))
    assert found["repaired_sha256"] == hashlib.sha256("\n".join(f"{t['role']}:{t['text']}" for t in found["turns"]).encode()).hexdigest()


# ----------------------------------------------------------------------------- op13 ---
def trie_by_definition(rows, rebuild):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            mark = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16]
            own.setdefault(conv, []).append(((turn is not None, turn or 0, mark), (role, text)))
    own = {c: [t for _, t in sorted(turns)] for c, turns in own.items()}
    head = {c: zlib.crc32(str(c).encode()) % 9 for c in own}
    whole = {c: own.get(c - c % 5, [])[: head[c]] + own[c][head[c] :] if rebuild else own[c] for c in own}
    members = {}
    for c, turns in whole.items():
        for depth in range(len(turns) + 1):
            members.setdefault(tuple(turns[:depth]), []).append(c)
    out = {}
    for node, convs in members.items():
        below = [n for n in members if n[: len(node)] == node]
        kids = [n for n in below if len(n) == len(node) + 1]
        ends = sorted(c for c in convs if len(whole[c]) == len(node))
        out[min(convs), len(node)] = (
            min(members[node[:-1]]) if node else None, len(convs), len(kids), sum(not any(m[: len(n)] == n and len(m) == len(n) + 1 for m in below) for n in below),
            sum((len(members[n]) - 1) * len(n[-1][1].encode()) for n in below if n), hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
        )
    return out


def found_trie(frame, rebuild):
    rows = (prefix_trie.rebuilt_sequences if rebuild else prefix_trie.sequences)(frame)
    got = prefix_trie.trie(rows, prefix_trie.levels_of(frame)).collect()
    out = {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in got}
    assert len(out) == len(got)
    return out


@pytest.mark.parametrize("rebuild", [True, False])
def test_trie_equals_brute_force(spark, rebuild):
    rng = random.Random(4)
    rows = []
    for conv in rng.sample(range(400), 90):
        for turn in range(rng.randint(1, 14)):
            rows.append((conv, turn if rng.random() > 0.05 else None, rng.choice(["u", None]), rng.choice(["a", "é", None, "bb"])))
    rows += [(1000 + i, t, "u", f"same {t}") for i in range(40) for t in range(11)]  # copies of a deep conversation
    frame = spark.createDataFrame(rows, TURNS).withColumn("depth", F.lit("x")).withColumn("family", F.lit(7)).withColumn("a", F.lit(1))
    assert found_trie(frame, rebuild) == trie_by_definition(rows, rebuild)


def test_trie_of_long_conversations_with_late_forks(spark):
    rng = random.Random(6)
    stem = [("u", f"t{i}") for i in range(130)]
    rows = []
    for conv in range(12):
        cut = rng.choice([0, 1, 63, 64, 65, 127, 128, 129])
        rows += [(conv, i, r, t) for i, (r, t) in enumerate(stem[:cut] + [("a", f"own {conv % 3} {i}") for i in range(rng.randint(0, 5))])]
    assert found_trie(spark.createDataFrame(rows, TURNS), False) == trie_by_definition(rows, False)


def test_trie_hard_cases(spark):
    assert found_trie(spark.createDataFrame([], TURNS), True) == {}
    rows = [(None, 0, "u", "lost"), (7, 0, "u", "x" * 200_000), (7, 0, "u", "x" * 200_000), (-3, 1, None, None), (2**40 + 1, 0, "u", "alone")]
    frame = spark.createDataFrame(rows, TURNS)
    for rebuild in (True, False):
        assert found_trie(frame, rebuild) == trie_by_definition(rows, rebuild)
    many = spark.range(9_000).selectExpr("id * 5 AS conv_id", "0L AS turn", "'u' AS role", "'t' AS text")  # one node where all end
    got = found_trie(many, False)
    assert got[0, 1] == (0, 9_000, 0, 1, 8_999, hashlib.sha256(",".join(str(5 * i) for i in range(9_000)).encode()).hexdigest())


# ----------------------------------------------------------------------------- op12 ---
WORDS = public_tokenizers.path("word_bpe_49k.json")
ODD = ["a", "B", "!", "The", "ing", "œ", "Ÿ", "ñ", "–", "İ", "é", "é", " ", "  ", "\n", "\t", " ", "<|endoftext|>", "'s", "'", "1", "２", "Σ", "ß", "\x00", "​", "😀", "中", "-", "."]


def test_words_equal_the_library():
    rng = random.Random(8)
    made, library = token_files.Words(WORDS, keep=500), Tokenizer.from_file(WORDS)
    assert made.by_word and made.ranked
    for _ in range(5):
        texts = ["".join(rng.choices(ODD, k=rng.randint(0, 14))) for _ in range(1_500)]
        want = [np.array(e.ids, "<u4").tobytes() for e in library.encode_batch(texts, add_special_tokens=False)]
        assert made.encode(texts) == want
    other = token_files.Words(public_tokenizers.path("byte_bpe_50k.json"))
    assert not other.by_word and other.encode(["a b", ""])[1] == b""


@pytest.mark.parametrize("planes", [4, 32])
def test_files_round_trip(planes):
    rng = np.random.default_rng(1)
    texts = [rng.integers(0, high, n).astype("<u4") for high, n in ((2**32, 1_000), (50_000, 0), (1, 70_000), (50_000, 5), (300, 2_500))]
    writer, content = token_files.Writer(planes, 1_024), b""
    for number, ids in enumerate(texts):
        content += b"".join(part + b"\n" for part in writer.add(number if number else None, ids.tobytes()))
    content += b"".join(part + b"\n" for part in writer.close())
    reader, whole = token_files.Reader(content), np.concatenate(texts)
    assert reader.doc_ids == [None, 1, 2, 3, 4] and reader.lengths == [len(t) for t in texts] and reader.header["ids"] == len(whole)
    for start, stop in ((0, 10**9), (0, 0), (1_000, 1_030), (1_024, 2_048), (len(whole) - 1, len(whole) + 9)):
        assert (reader.slice(start, stop) == whole[start:stop]).all()
    held = {row: [] for row in range(5)}
    for row, at, ids in reader.pieces():
        assert at == sum(map(len, held[row]))
        held[row].append(ids)
    assert all((np.concatenate([np.zeros(0, "<u4"), *held[row]]) == texts[row]).all() for row in range(5))
    assert all(len(sizes) == planes for _, _, sizes in reader.header["chunks"])
    with pytest.raises(ValueError):
        token_files.Reader(content[:-30])


def test_documents_come_back_from_the_files(spark, tmp_path):
    rng = random.Random(9)
    texts = {i: "".join(rng.choices(ODD, k=rng.randint(0, 40))) for i in rng.sample(range(10_000), 60)} | {5: None, 20_001: "word " * 60_000, 20_002: ""}
    rows = [*texts.items(), (None, "no id"), (20_003, "twice"), (20_003, "twice")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("place", F.lit(1)).withColumn("file", F.lit("x")).withColumn("value", F.lit("y"))
    library = Tokenizer.from_file(WORDS)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    ids = [[*library.encode(t or "", add_special_tokens=False).ids, 1] for _, t in order]
    folder = str(tmp_path / "files")
    token_files.write(frame, folder, WORDS, planes=32, block=1_000)
    got = sorted(token_files.read(spark, folder, ids=True).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [i for i, _ in order] and [r.ids for r in got] == ids
    assert [r.start for r in got] == [0, *itertools.accumulate(map(len, ids))][:-1] and [r.n_tokens for r in got] == [len(i) for i in ids]
    assert [r.ids_crc32 for r in got] == [zlib.crc32(np.array(i, "<u4").tobytes()) for i in ids]
    flat = list(itertools.chain(*ids))
    for start, stop in ((0, 40), (len(flat) - 50_000, len(flat) - 49_000), (len(flat) - 5, len(flat) + 5)):
        assert [(r.position, r.id) for r in sorted(token_files.slice_of(spark, folder, start, stop).collect())] == [(p, flat[p]) for p in range(start, min(stop, len(flat)))]


def test_no_documents_no_rows(spark, tmp_path):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    token_files.write(empty, str(tmp_path / "none"), WORDS)
    assert token_files.read(spark, str(tmp_path / "none")).count() == 0
