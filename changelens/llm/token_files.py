"""Token-id files with bit-plane shuffling.

The ids of all documents in ascending order of their id are one long sequence, cut into files and these into blocks of :data:`BLOCK` ids. A block is transposed
into planes: the four byte planes of its little-endian 32-bit ids, or their 32 bit planes; every plane is compressed by zstandard on its own, so the
high planes, nearly all zeros, shrink to a few bytes. A file is

    the planes of every block, in order, and a line break after each block
    the index: length of the header (uint32), the header (JSON: planes, block, ids, documents and, per chunk, its offset, ids and sizes of its planes),
        then zstandard of the documents' ids (int64), which of them are null (uint8), and their numbers of tokens (int64), and a line break
    a trailer of 17 bytes: offset of the index (uint64), ``IDPLANE1`` and a line break

Files are written by Spark's text writer, which only adds the line breaks, through its commit protocol: a task that is lost or runs twice leaves one whole
file, on any file system that Spark writes. They are read by Spark's scan of binary files; a slice of the ids is decoded from the chunks that hold it alone.

Documents are dealt by ranges of their id in one shuffle of texts and encoded where they land, block after block, so a task holds a block of ids and the narrow
list of its documents at any length of its texts. Null text is empty: a document of the end id alone. Documents of null id come first; rows of equal id are
documents of their own, in no promised order; an empty table gives no file and an empty result; further columns are ignored.
"""

from __future__ import annotations

import json
import math
import os
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from changelens.llm.common import texts

BLOCK = 65_536
MAGIC = b"IDPLANE1\n"
#: Bytes of text that a file is meant to hold the ids of.
FILE_BYTES = 64 << 20
#: A document's ids are summed up in pieces of so many.
PIECE = 1 << 20


# ----------------------------------------------------------------------------- planes ---
def to_planes(ids: np.ndarray, planes: int) -> list[bytes]:
    """The byte planes (4) or bit planes (32) of 32-bit ids, lowest first."""
    table = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4).T
    if planes == 32:
        bits = (table[:, None, :] >> np.arange(8, dtype=np.uint8)[None, :, None]) & 1
        table = np.packbits(bits.reshape(32, -1), axis=1)
    return [np.ascontiguousarray(row).tobytes() for row in table]


def from_planes(rows: list[bytes], n: int) -> np.ndarray:
    table = np.stack([np.frombuffer(row, np.uint8) for row in rows])
    if len(rows) == 32:
        bits = np.unpackbits(table, axis=1)[:, :n].reshape(4, 8, n)
        table = (bits << np.arange(8, dtype=np.uint8)[None, :, None]).sum(1, dtype=np.uint8)
    return np.ascontiguousarray(table.T).view("<u4").ravel()


class Writer:
    """Gathers ids and gives the sections of one file, each without the line break that the text writer adds."""

    def __init__(self, planes: int, block: int, level: int = 3) -> None:
        self.planes, self.block, self.pack = planes, block, zstandard.ZstdCompressor(level=level).compress
        self.ids, self.pending, self.at, self.total = [], 0, 0, 0
        self.chunks: list[list] = []
        self.doc_ids: list[int | None] = []
        self.lengths: list[int] = []

    def add(self, doc_id: int | None, ids: bytes) -> Iterator[bytes]:
        self.doc_ids.append(doc_id)
        self.lengths.append(len(ids) // 4)
        self.ids.append(ids)
        self.pending += len(ids) // 4
        if self.pending >= self.block:
            held = np.frombuffer(b"".join(self.ids), "<u4")
            whole = len(held) // self.block * self.block
            for start in range(0, whole, self.block):
                yield self._chunk(held[start : start + self.block])
            self.ids, self.pending = [held[whole:].tobytes()], len(held) - whole

    def _chunk(self, ids: np.ndarray) -> bytes:
        packed = [self.pack(plane) for plane in to_planes(ids, self.planes)]
        out = b"".join(packed)
        self.chunks.append([self.at, len(ids), [len(p) for p in packed]])
        self.at += len(out) + 1
        self.total += len(ids)
        return out

    def close(self) -> Iterator[bytes]:
        if self.pending:
            yield self._chunk(np.frombuffer(b"".join(self.ids), "<u4"))
        said = {"planes": self.planes, "block": self.block, "ids": self.total, "documents": len(self.doc_ids), "chunks": self.chunks}
        header = json.dumps(said, separators=(",", ":")).encode()
        documents = np.array([d or 0 for d in self.doc_ids], "<i8").tobytes() + np.array([d is None for d in self.doc_ids], np.uint8).tobytes() + np.array(self.lengths, "<i8").tobytes()
        yield struct.pack("<I", len(header)) + header + self.pack(documents)
        yield struct.pack("<Q", self.at) + MAGIC[:-1]


class Reader:
    """One file's contents."""

    def __init__(self, content: bytes) -> None:
        if len(content) < 17 or content[-9:] != MAGIC:
            raise ValueError("no file of token ids, or one that was cut")
        self.content, self.unpack = memoryview(content), zstandard.ZstdDecompressor().decompress
        (at,) = struct.unpack("<Q", content[-17:-9])
        (size,) = struct.unpack_from("<I", content, at)
        self.header = json.loads(content[at + 4 : at + 4 + size])
        n = self.header["documents"]
        told = self.unpack(content[at + 4 + size : -18])
        nulls = np.frombuffer(told, np.uint8, n, 8 * n)
        self.doc_ids = [None if null else d for d, null in zip(np.frombuffer(told, "<i8", n).tolist(), nulls, strict=True)]
        self.lengths = np.frombuffer(told, "<i8", n, 9 * n).tolist()

    def chunk(self, number: int) -> np.ndarray:
        at, n, sizes = self.header["chunks"][number]
        ends = [at, *accumulate(sizes, initial=at)][1:]
        return from_planes([self.unpack(self.content[a:b]) for a, b in zip(ends, ends[1:])], n)

    def slice(self, start: int, stop: int) -> np.ndarray:
        """Ids from ``start`` to before ``stop``; only the chunks that hold them are decoded."""
        block, stop = self.header["block"], min(stop, self.header["ids"])
        found = [self.chunk(c)[max(0, start - c * block) : stop - c * block] for c in range(start // block, -(-stop // block))] if start < stop else []
        return np.concatenate(found) if found else np.zeros(0, "<u4")

    def pieces(self) -> Iterator[tuple[int, int, np.ndarray]]:
        """(document, its first id here, ids) in order, every chunk decoded once and let go; a document has a piece in each chunk it lies in."""
        ends = list(accumulate(self.lengths, initial=0))
        row = 0
        for number, (_, n, _) in enumerate(self.header["chunks"]):
            ids, low = self.chunk(number), number * self.header["block"]
            while row < len(self.lengths) and ends[row] < low + n:
                a, b = max(ends[row], low), min(ends[row + 1], low + n)
                yield row, a - ends[row], ids[a - low : b - low]
                if ends[row + 1] > low + n:
                    break
                row += 1


# ----------------------------------------------------------------------------- encoding ---
#: Words of these characters are their own composed form and have plain lower-case letters. Others go to the library.
PLAIN = re.compile(r"[\x21-\x7e\xa1-\xac\xae-\xff\u0100-\u017f\u2010-\u2027]+")
#: Stands for the end of a word; no plain word holds it.
END = b"\x00"


class Words:
    """Ids of whole texts, equal to the library's: a vocabulary that drops white space has no token across a blank, so texts are cut at blanks and
    the ids of a word are kept for its next occurrence. At most about ``keep`` words are kept; then the store starts anew.

    A new word of plain characters goes through the merge ranks of the same file, where the end of a word is a byte of its own that is merged first; that costs a
    fraction of the library's call. Other words, vocabularies that do not drop white space or have no ends of words, and texts with an added token go to the
    library.
    """

    def __init__(self, path: str, keep: int = 400_000) -> None:
        from tokenizers import Tokenizer

        self.tokenizer, self.keep, self.known = Tokenizer.from_file(path), keep, {}
        self.added = re.compile("|".join(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()) or r"(?!)")
        with open(path, encoding="utf-8") as file:
            said = json.load(file)
        steps = (said.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        pattern = steps[0].get("pattern", {}).get("Regex", " ") if steps[0].get("invert") and steps[0].get("behavior") == "Removed" else " "
        #: No part of the pattern looks around or takes a blank.
        self.by_word = not re.search(r"\(\?|\\s|\.| ", pattern.replace(r"[^\s", "[")) and not self.tokenizer.pre_tokenizer.pre_tokenize_str(" \t\n")
        self.ranked = self._ranked(said, pattern, steps[1:]) if self.by_word else None

    @staticmethod
    def _ranked(said: dict, pattern: str, steps: list[dict]):
        import regex
        import tiktoken

        model, normal = said["model"], [n["type"] for n in (said.get("normalizer") or {}).get("normalizers", [])]
        suffix, vocab = model.get("end_of_word_suffix"), model.get("vocab", {})
        if model["type"] != "BPE" or not suffix or model.get("continuing_subword_prefix") or normal != ["NFC", "Replace", "Lowercase"] or [s["type"] for s in steps] != ["ByteLevel"]:
            return None
        merged = [vocab.get("".join(m.split(" ") if isinstance(m, str) else m), -1) for m in model["merges"]]
        if merged != sorted(merged) or -1 in merged:
            return None
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; the others follow from 256 on
        byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(plain)))}
        special = {t["content"] for t in said["added_tokens"]}
        spelled = {token: bytes(map(byte_of.__getitem__, token.removesuffix(suffix))) for token in vocab.keys() - special}
        ranks = {text + (END if token.endswith(suffix) else b""): vocab[token] for token, text in spelled.items() if END not in text}
        ranks[END] = max(vocab.values()) + 1
        if any(bytes([b]) + END not in ranks or ranks[bytes([b]) + END] >= min(merged) for b in range(33, 127)):
            return None
        run = tiktoken.Encoding("ranked", pat_str=r"[^\x00]+\x00", mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        part, ends = regex.compile(pattern), np.zeros(ranks[END] + 1, bool)
        ends[[rank for text, rank in ranks.items() if text.endswith(END)]] = True

        def encode(words: list[str]) -> list[bytes]:
            """All words at once: a line of marked parts each; a word ends where its last part does."""
            lines = part.sub("\\g<0>\0", "\n".join(words).lower()).split("\n")
            ids = np.array(run("".join(lines)), "<u4")
            last = np.flatnonzero(ends[ids])[np.cumsum([line.count("\0") for line in lines]) - 1]
            flat, cuts = ids.tobytes(), [0, *(4 * (last + 1)).tolist()]
            return [*map(flat.__getitem__, map(slice, cuts, cuts[1:]))]

        return encode

    def _library(self, values: list[str]) -> list[bytes]:
        return [np.array(found.ids, "<u4").tobytes() for found in self.tokenizer.encode_batch(values, add_special_tokens=False)]

    def _learn(self, new: list[str]) -> None:
        if self.ranked:
            plain = [word for word in new if PLAIN.fullmatch(word)]
            if plain:
                self.known.update(zip(plain, self.ranked(plain), strict=True))
            new = [word for word in new if word not in self.known]
        if new:
            self.known.update(zip(new, self._library(new), strict=True))

    def encode(self, values: list[str]) -> list[bytes]:
        if not self.by_word:
            return self._library(values)
        cut = [text.replace("\n", " ").split(" ") for text in values]
        if len(self.known) > self.keep:
            self.known.clear()
        self._learn(list(set().union(*cut) - self.known.keys()))
        out = [b"".join(map(self.known.__getitem__, words)) for words in cut]
        for row, text in enumerate(values):
            if self.added.search(text):
                (out[row],) = self._library([text])
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> Words:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return Words(path)


# ----------------------------------------------------------------------------- tables ---
def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 1, planes: int = 4, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the ids of all documents, each with ``end_id`` behind it, in ascending order of their id into files below ``folder``.

    ``tokenizer`` is the path of a vocabulary file that every executor has; ``planes`` is 4 for byte planes, 32 for bit planes. The number in a file's name
    is its place in the order.
    """
    rows = texts(docs, id_col, text_col)
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    files = max(math.ceil(size / FILE_BYTES), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # rows of one id may be many: their place in the input keeps a range from holding all of them
    placed = rows.withColumn("place", F.monotonically_increasing_id())
    order = [F.col("doc_id").asc_nulls_first(), F.col("place")]
    dealt = placed.repartitionByRange(files, *order).sortWithinPartitions(*order).select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, writer, end = encoder(tokenizer), Writer(planes, block), struct.pack("<I", end_id)
        section = lambda values: pa.RecordBatch.from_arrays([pa.array(values, pa.binary())], names=["section"])
        for batch in batches:
            for first in range(0, batch.num_rows, 200):
                part = batch.slice(first, 200)
                for doc_id, ids in zip(part.column(0).to_pylist(), made.encode(part.column(1).to_pylist()), strict=True):
                    for out in writer.add(doc_id, ids + end):
                        yield section([out])
        if writer.doc_ids:
            yield section(list(writer.close()))

    dealt.mapInArrow(run, "section binary").select(F.col("section").cast("string").alias("value")).write.text(folder)


def _scan(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select(F.regexp_extract("path", r"part-(\d+)", 1).cast("int").alias("file"), "content")


def read(spark: SparkSession, folder: str, ids: bool = False) -> DataFrame:
    """Per document, from the files: ``doc_id``, ``start`` (ids of all documents before it), ``n_tokens``, ``ids_crc32`` and, if wanted, its ``ids``."""
    fields = "file int, place long, doc_id long, first long, n_tokens long, ids_crc32 long" + (", ids array<bigint>" if ids else "")
    types = [("file", pa.int32()), ("place", pa.int64()), ("doc_id", pa.int64()), ("first", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]
    schema = pa.schema(types + ([("ids", pa.list_(pa.int64()))] if ids else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                reader, first, crc, held, out = Reader(content.as_py()), 0, 0, [], []
                for row, at, part in reader.pieces():
                    crc = zlib.crc32(part.tobytes(), crc)
                    if ids:
                        held.append(part)
                    if at + len(part) < reader.lengths[row]:
                        continue
                    out.append([file, row, reader.doc_ids[row], first, reader.lengths[row], crc, *([np.concatenate(held).tolist()] if ids else [])])
                    first, crc, held = first + reader.lengths[row], 0, []
                    if len(out) == 2_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                        out = []
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    found = _scan(spark, folder).mapInArrow(run, fields)
    return found.join(F.broadcast(starts(spark, folder)), "file").select("doc_id", (F.col("before") + F.col("first")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if ids else []))


def totals(spark: SparkSession, folder: str) -> DataFrame:
    """(file, ids) from the files' headers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [(file, Reader(content.as_py()).header["ids"]) for file, content in zip(batch.column(0).to_pylist(), batch.column(1))]
            yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in made], pa.int32()), pa.array([m[1] for m in made], pa.int64())], names=["file", "ids"])

    return _scan(spark, folder).mapInArrow(run, "file int, ids long")


def starts(spark: SparkSession, folder: str) -> DataFrame:
    """(file, before): ids of all files before it, a row of two numbers per file of :data:`FILE_BYTES` of text."""
    upto = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    return totals(spark, folder).select("file", F.coalesce(F.sum("ids").over(upto), F.lit(0)).alias("before"))


def slice_of(spark: SparkSession, folder: str, start: int, stop: int) -> DataFrame:
    """(position, id) of the ids from ``start`` to before ``stop`` of the whole sequence; chunks outside of it stay compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for before, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                reader = Reader(content.as_py())
                for low in range(max(0, start - before), min(stop - before, reader.header["ids"]), PIECE):
                    found = reader.slice(low, min(low + PIECE, stop - before))
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(low, low + len(found)) + before, pa.int64()), pa.array(found, pa.int64())], names=["position", "id"])

    joined = _scan(spark, folder).join(F.broadcast(starts(spark, folder)), "file")
    return joined.select("before", "content").mapInArrow(run, "position long, id long")
