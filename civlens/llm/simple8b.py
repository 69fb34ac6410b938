"""Token-ID / binary output: Simple-8b word-aligned coding of token ids.

A file holds blocks of BLOCK ids. In each 64-bit word the top 4 bits select how many ids of how
many bits fill the other 60 (SELECTORS); an id too wide for the two-id layout takes the escape
selector and a word of its own. Per-block word offsets let a reader decode any block alone, all
words of a selector at once.

File: MAGIC | words (uint64) | block offsets (uint64, in words) | documents (DOC records: doc_id,
is_null, first id, number of ids) | trailer (uint64: ids, words, blocks, documents) | MAGIC.
All numbers are little-endian.

Null text: empty, so its document holds only the end id. Null doc_id: kept, first in the order.
Repeated rows: each is a document of its own, side by side in the files. Empty table: no file and
no row. Other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from civlens.llm.common import scratch, written
from civlens.llm.tokens import default_path, tokenizer

MAGIC = b"S8BTOK01"
BLOCK = 1024
#: Fixed values of the format: (ids, bits of an id) by selector; 0 is the escape, one raw value.
SELECTORS = [
    (1, 60),
    (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7),
    (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30),
]
COUNTS = np.array([c for c, _ in SELECTORS], np.int64)
DOC = np.dtype([("doc_id", "<i8"), ("null", "<u1"), ("first", "<u8"), ("n", "<u8")])
FLUSH_BLOCKS = 1024
#: Texts that are encoded together.
TEXTS = 1024
#: Documents that one reading task handles.
SPLIT_DOCS = 4096
MAX_TASKS = 20_000


def _windows(widths: np.ndarray, counts: list[int]) -> dict[int, np.ndarray]:
    """Largest width among each position and the count - 1 after it, for each count."""
    out = {1: widths}

    def shifted(a, k):
        b = np.zeros_like(a)
        b[:, :-k] = a[:, k:]
        return b

    for c in sorted(set(counts) | {2, 4, 8, 16, 32}):
        if c == 1:
            continue
        half = max(k for k in out if k < c and 2 * k >= c)
        out[c] = np.maximum(out[half], shifted(out[half], c - half))
    return out


def encode(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of the ids and each block's first word; blocks advance in lockstep."""
    n = len(ids)
    if not n:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    blocks = -(-n // BLOCK)
    grid = np.zeros((blocks, BLOCK + 64), np.uint64)  # ids past a block's end read as zeros
    padded = np.zeros(blocks * BLOCK, np.uint64)
    padded[:n] = ids
    grid[:, :BLOCK] = padded.reshape(blocks, BLOCK)
    widths = np.frexp(grid.astype(np.float32 if int(ids.max()) < 1 << 24 else np.float64))[1].astype(np.uint8)
    most = _windows(widths, [c for c, _ in SELECTORS])
    choice = np.zeros(grid.shape, np.uint8)
    for s in range(len(SELECTORS) - 1, 0, -1):
        count, bits = SELECTORS[s]
        np.copyto(choice, np.uint8(s), where=most[count] <= bits)
    choice, row = choice.ravel(), grid.shape[1]
    ends = np.arange(blocks) * row + BLOCK
    ends[-1] += n - blocks * BLOCK
    at = np.arange(blocks) * row
    taken = np.zeros(grid.size, bool)
    while len(at):
        taken[at] = True
        at = at + COUNTS[choice[at]]
        keep = at < ends
        if not keep.all():
            at, ends = at[keep], ends[keep]
    start = np.flatnonzero(taken)
    pick = choice[start]
    out = pick.astype(np.uint64) << np.uint64(60)
    flat = grid.ravel()
    for s, (count, bits) in enumerate(SELECTORS):
        rows = np.flatnonzero(pick == s)
        if len(rows):
            first, word = start[rows], out[rows]
            for k in range(count):
                word |= flat[first + k] << np.uint64(bits * k)
            out[rows] = word
    return out, np.searchsorted(start, np.arange(blocks) * row).astype(np.uint64)


def decode(words: np.ndarray, first: np.ndarray, n: int) -> np.ndarray:
    """The n ids of consecutive whole blocks; first: each block's first word."""
    pick = (words >> np.uint64(60)).astype(np.uint8)
    counts = COUNTS[pick]
    before = np.cumsum(counts) - counts
    first = np.asarray(first, np.int64)
    lens = np.diff(np.append(first, len(words)))
    # a block's last word may hold zeros past its end: each block gets a row with room for them
    row = BLOCK + 64
    at = before + np.repeat(np.arange(len(first)) * row - before[first], lens)
    out = np.zeros(len(first) * row, np.uint64)
    for s, (count, bits) in enumerate(SELECTORS):
        rows = np.flatnonzero(pick == s)
        if len(rows):
            to, word, mask = at[rows], words[rows], np.uint64((1 << bits) - 1)
            for k in range(count):
                out[to + k] = (word >> np.uint64(bits * k)) & mask
    return out.reshape(-1, row)[:, :BLOCK].ravel()[:n]


class Writer:
    """Streams ids of documents into one file; only the tables of offsets stay in memory."""

    def __init__(self, sink):
        self.sink, self.pending, self.held = sink, [], 0
        self.offsets: list[np.ndarray] = []
        self.docs: list[tuple] = []
        self.n_ids = self.n_words = 0
        sink.write(MAGIC)

    def add(self, doc_id, *ids: np.ndarray):
        n = sum(map(len, ids))
        self.docs.append((0 if doc_id is None else doc_id, doc_id is None, self.n_ids, n))
        self.n_ids += n
        self.pending += ids
        self.held += n
        if self.held >= FLUSH_BLOCKS * BLOCK:
            self._flush(self.held // BLOCK * BLOCK)

    def _flush(self, n: int):
        ids = np.concatenate(self.pending) if self.pending else np.empty(0, np.uint32)
        words, first = encode(ids[:n])
        self.sink.write(words.astype("<u8").tobytes())
        self.offsets.append(first + np.uint64(self.n_words))
        self.n_words += len(words)
        self.pending, self.held = [ids[n:]], len(ids) - n

    def close(self) -> dict:
        self._flush(self.held)
        offsets = np.concatenate(self.offsets).astype("<u8")
        self.sink.write(offsets.tobytes())
        self.sink.write(np.array(self.docs, DOC).tobytes())
        tail = [self.n_ids, self.n_words, len(offsets), len(self.docs)]
        self.sink.write(np.array(tail, "<u8").tobytes() + MAGIC)
        self.sink.close()
        return dict(zip(["n_ids", "n_words", "n_blocks", "n_docs"], tail, strict=True))


class Reader:
    """Random access by document number or by id position."""

    def __init__(self, source):
        self.f = source
        size = source.size()
        tail = self._at(size - 40, 40)
        if tail[-8:] != MAGIC or self._at(0, 8) != MAGIC:
            raise ValueError("not a Simple-8b token file, or cut short")
        self.n_ids, self.n_words, self.n_blocks, self.n_docs = (int(x) for x in np.frombuffer(tail[:32], "<u8"))

    def _at(self, at: int, n: int) -> bytes:
        self.f.seek(at)
        return self.f.read(n)

    def docs(self, a: int, b: int) -> np.ndarray:
        at = 8 + 8 * (self.n_words + self.n_blocks)
        b = min(b, self.n_docs)
        return np.frombuffer(self._at(at + a * DOC.itemsize, (b - a) * DOC.itemsize), DOC)

    def ids(self, a: int, b: int) -> np.ndarray:
        """Ids a to b of the file: only their blocks are read and decoded."""
        if a >= b:
            return np.empty(0, np.uint32)
        first, last = a // BLOCK, (b - 1) // BLOCK + 1
        more = last < self.n_blocks
        table = np.frombuffer(self._at(8 + 8 * (self.n_words + first), 8 * (last - first + more)), "<u8")
        start, stop = int(table[0]), int(table[-1]) if more else self.n_words
        words = np.frombuffer(self._at(8 + 8 * start, 8 * (stop - start)), "<u8")
        n = min(last * BLOCK, self.n_ids) - first * BLOCK
        got = decode(words, table[: last - first].astype(np.int64) - start, n)
        return got[a - first * BLOCK : b - first * BLOCK].astype(np.uint32)


def write_tokens(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = 2) -> DataFrame:
    """Encode and write all documents in ascending doc_id order; one file a range partition.

    Returns the manifest (part, file, n_ids, n_words, n_blocks, n_docs), one row a file. A task
    writes under a name of its own attempt; only files that the written manifest names count, so
    a lost or repeated task leaves no double ids.
    """

    def write(batches):
        import pyarrow.fs

        fs, root = pyarrow.fs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        context, tok, out = TaskContext.get(), tokenizer(tokenizer_path), None
        name = f"part-{context.partitionId():06d}-{context.taskAttemptId()}.s8b"
        end = np.array([end_id], np.uint32)
        for pdf in batches:
            texts, ids = pdf["text"].tolist(), pdf["doc_id"].tolist()
            for a in range(0, len(texts), TEXTS):
                flat, ends = tok.encode([t or "" for t in texts[a : a + TEXTS]])
                out = out or Writer(fs.open_output_stream(f"{root}/{name}"))
                begin = 0
                for doc_id, stop in zip(ids[a : a + TEXTS], ends.tolist(), strict=True):
                    out.add(None if pd.isna(doc_id) else int(doc_id), flat[begin:stop], end)
                    begin = stop
        if out:
            yield pd.DataFrame([{"part": context.partitionId(), "file": f"{folder}/{name}"} | out.close()])

    rows = docs.select("doc_id", "text")
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    # doc_id travels as text: pandas would turn nullable longs into floats
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).select(F.col("doc_id").cast("string"), "text")
    manifest = ranged.mapInPandas(write, "part int, file string, n_ids long, n_words long, n_blocks long, n_docs long")
    return written(manifest, "s8b-manifest")


def read_tokens(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files of the manifest."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    splits = (
        manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
        .select("file", "base", F.explode(F.sequence(F.lit(0), F.col("n_docs") - 1, F.lit(SPLIT_DOCS))).alias("a"))
    )
    # a number of its own: few bytes name much work, so sizes must not merge the splits
    n = manifest.agg(F.sum(F.ceil(F.col("n_docs") / SPLIT_DOCS))).first()[0] or 1
    splits = splits.repartition(min(int(n), MAX_TASKS), "file", "a")

    def read(batches):
        import pyarrow.fs

        for pdf in batches:
            for row in pdf.itertuples():
                fs, path = pyarrow.fs.FileSystem.from_uri(row.file)
                with fs.open_input_file(path) as f:
                    reader = Reader(f)
                    docs = reader.docs(row.a, row.a + SPLIT_DOCS)
                    yield pd.DataFrame(_rows(reader, docs, row.base))

    def _rows(reader, docs, base):
        out, at = [], 0
        while at < len(docs):
            # documents of about a million ids are decoded together
            stop = max(at + 1, int(np.searchsorted(docs["first"], docs["first"][at] + np.uint64(1 << 20))))
            first = int(docs["first"][at])
            ids = reader.ids(first, int(docs["first"][stop - 1] + docs["n"][stop - 1])).astype("<u4")
            for d in docs[at:stop]:
                a = int(d["first"]) - first
                crc = zlib.crc32(ids[a : a + int(d["n"])].tobytes())
                doc_id = None if d["null"] else str(d["doc_id"])
                out.append((doc_id, base + int(d["first"]), int(d["n"]), crc))
            at = stop
        return {k: v for k, v in zip(["doc_id", "start", "n_tokens", "ids_crc32"], zip(*out, strict=True), strict=True)}

    got = splits.mapInPandas(read, "doc_id string, start long, n_tokens long, ids_crc32 long")
    return got.withColumn("doc_id", F.col("doc_id").cast("long"))


def op5_simple8b(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return read_tokens(write_tokens(docs, scratch(spark, "s8b"), default_path()))
