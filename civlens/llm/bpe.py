"""Byte-level BPE: encoding by vectorised pre-tokenisation and cached pair merging, and decoding.

A text becomes an array of code points and these an array of classes (letter, number, other, white
space and a few that look at the next characters). Where a piece of the public split pattern begins
depends on a small automaton over those classes. Each class is a function from state to state;
functions compose associatively, and the few that occur form a finite monoid, so the states in front
of all characters come from a blocked scan of table look-ups in numpy: compose within blocks, scan the
blocks' functions, run the blocks from their entering states. No regular expression is used.

The slices between piece starts are looked up in a cache of two generations, unseen ones are merged:
many short pieces at once in numpy, long ones with a heap. Both do what the rank file says: the
adjacent pair whose bytes have the lowest rank merges first, the leftmost among equals.

``encoded`` adds the ids and the byte offset at which each token begins; ``decoded`` puts the bytes of
ids back at those offsets.

Nulls count as empty texts; an empty text has no ids and decodes to no bytes. Very long texts are
encoded whole: their characters are scanned in one go, a batch holds at least one text. Rows are
independent, so ties, repeated rows and null ids are kept as they are. An empty table gives an empty
one. Further columns are kept by ``encoded`` and ``decoded``; a column with the name of a result is
replaced.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from itertools import product, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from civlens.llm.tokens import HASHED_BYTES, byte_tables

# Classes of code points
LETTER, NUMBER, OTHER, QUOTE_1, QUOTE_2, INNER, GLUE, LAST = range(8)
#: Kind of a code point before its neighbours are looked at; white space is INNER there.
KINDS = (LETTER, NUMBER, OTHER, INNER)
# The states in front of a character
BEGIN, LETTERS, NUMBERS, OTHERS, GLUED, WHITE, ONE_MORE, TWO_MORE = range(8)
#: What follows an apostrophe in a contraction, by length.
SHORT, LONG = "stmd", ("re", "ve", "ll")

#: Characters that are scanned together: a block's functions are composed one after the other.
BLOCK = 64
#: Characters of texts that are encoded in one go (one text at least).
BATCH_CHARS = 1 << 20
#: Pieces that one generation of the cache holds.
GENERATION = 150_000
#: Longer pieces are merged one by one with a heap.
SHORT_PIECE = 48


def step(state: int, kind: int) -> tuple[int, bool]:
    """The state behind a character of class ``kind``, and whether a piece begins at it."""
    if state == TWO_MORE:
        return ONE_MORE, False
    if state == ONE_MORE:
        return BEGIN, False
    if kind == LETTER:
        return LETTERS, state not in (LETTERS, GLUED)
    if kind == NUMBER:
        return NUMBERS, state not in (NUMBERS, GLUED)
    if kind in (OTHER, QUOTE_1, QUOTE_2):
        inside = state in (OTHERS, GLUED)
        return (OTHERS if inside or kind == OTHER else ONE_MORE if kind == QUOTE_1 else TWO_MORE), not inside
    if kind == INNER:
        return WHITE, state != WHITE
    return (GLUED if kind == GLUE else BEGIN), True


class Automaton:
    """Tables of the scan: ``function`` numbers the function of each symbol, ``compose[f, g]`` is "f,
    then g", ``after[f]`` the state behind f from BEGIN; ``following`` and ``begins`` are the steps. A
    symbol is a class, plus 8 at the first character of a text, where the state before is forgotten."""

    def __init__(self):
        n = 8
        self.following = np.zeros((n, 2 * n), np.uint8)
        self.begins = np.zeros((n, 2 * n), bool)
        for state, symbol in product(range(n), range(2 * n)):
            at = step(BEGIN if symbol >= n else state, symbol % n)
            self.following[state, symbol], self.begins[state, symbol] = at
        identity = tuple(range(n))
        generators = [tuple(self.following[:, s].tolist()) for s in range(2 * n)]
        number = {identity: 0}
        todo = [identity]
        for f in todo:
            for g in generators:
                h = tuple(g[x] for x in f)
                if h not in number:
                    number[h] = len(number)
                    todo.append(h)
        self.function = np.array([number[g] for g in generators], np.uint16)
        m = len(number)
        self.compose = np.zeros((m, m), np.uint16)
        for f, g in product(todo, todo):
            self.compose[number[f], number[g]] = number[tuple(g[x] for x in f)]
        self.after = np.array([f[BEGIN] for f in todo], np.uint8)

    def starts(self, symbols: np.ndarray) -> np.ndarray:
        """Whether a piece begins at each of the symbols."""
        n, size = len(symbols), len(self.compose)
        rows = -(-n // BLOCK)
        padded = np.full(rows * BLOCK, OTHER, np.uint8)
        padded[:n] = symbols
        by_step = np.ascontiguousarray(padded.reshape(rows, BLOCK).T)
        flat = self.compose.ravel()
        whole = self.function[by_step[0]].astype(np.intp)
        for k in range(1, BLOCK):
            whole = flat[whole * size + self.function[by_step[k]]].astype(np.intp)
        reach = 1
        while reach < rows:
            whole[reach:] = flat[whole[:-reach] * size + whole[reach:]]
            reach *= 2
        state = np.zeros(rows, np.intp)
        state[1:] = self.after[whole[:-1]]
        following, begins = self.following.ravel(), self.begins.ravel()
        out = np.empty((BLOCK, rows), bool)
        for k in range(BLOCK):
            at = state * 16 + by_step[k]
            out[k] = begins[at]
            state = following[at].astype(np.intp)
        return out.T.ravel()[:n]


def code_point_kinds() -> np.ndarray:
    """The kind of every code point, as the library's own character classes have it: versions of
    Unicode differ, so the classes are asked for once (each with a pattern of one class)."""
    import tiktoken

    one_byte = {bytes([b]): b for b in range(256)}
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    kinds = np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (INNER, r"\s+")):
        probe = tiktoken.Encoding("probe", pat_str=pattern, mergeable_ranks=one_byte, special_tokens={})
        found = bytes(probe.encode_ordinary(every)).decode()
        kinds[np.frombuffer(found.encode("utf-32-le"), np.uint32)] = kind
    return kinds


def symbols_of(points: np.ndarray, first: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Symbols of the code points of several texts, which begin at the positions ``first``."""
    n = len(points)
    kind = kinds[points]
    opens = np.zeros(n + 3, bool)  # of a text; behind the last one, too
    opens[first] = opens[n:] = True
    white = np.zeros(n + 1, bool)
    white[:n] = kind == INNER
    last = white[:n] & ~white[1:] & ~opens[1 : n + 1]
    kind[last] = np.where(points[last] == 0x20, GLUE, LAST)
    quote = np.flatnonzero(points == 0x27)
    quote = quote[~opens[quote + 1]]
    next_1 = points[quote + 1]
    short = np.isin(next_1, [ord(c) for c in SHORT])
    kind[quote[short]] = QUOTE_1
    quote, next_1 = quote[~short], next_1[~short]
    inside = ~opens[quote + 2]
    quote, next_1 = quote[inside], next_1[inside]
    next_2 = points[quote + 2]
    long = np.zeros(len(quote), bool)
    for a, b in LONG:
        long |= (next_1 == ord(a)) & (next_2 == ord(b))
    kind[quote[long]] = QUOTE_2
    kind[first] += 8
    return kind


class Ranks:
    """A rank file: the bytes of each id, the id of each byte string, and which pairs of ids merge."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            pairs = [line.split() for line in f if line.strip()]
        self.rank = {base64.b64decode(a): int(b) for a, b in pairs}
        self.token = {r: t for t, r in self.rank.items()}
        self.of_byte = np.array([self.rank[bytes([b])] for b in range(256)], np.int64)
        size = max(self.token) + 1
        self.width = np.zeros(size, np.int64)
        for r, t in self.token.items():
            self.width[r] = len(t)
        self.place = np.cumsum(self.width) - self.width
        self.blob = np.frombuffer(b"".join(self.token.get(r, b"") for r in range(size)), np.uint8)
        merges = {}
        for t, r in self.rank.items():
            for cut in range(1, len(t)):
                a, b = self.rank.get(t[:cut]), self.rank.get(t[cut:])
                if a is not None and b is not None:
                    merges[a << 32 | b] = r
        self.key = np.fromiter(sorted(merges), np.int64, len(merges))
        self.merged = np.fromiter((merges[k] for k in self.key.tolist()), np.int64, len(merges))
        self.none = size
        self._merges: dict[int, int] | None = None

    @property
    def merges(self) -> dict[int, int]:
        """Merged ids by pair, for pieces that are merged one by one; made when first needed."""
        if self._merges is None:
            self._merges = dict(zip(self.key.tolist(), self.merged.tolist(), strict=True))
        return self._merges

    def of_pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each merged pair, ``none`` if it is no token."""
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[at] == key, self.merged[at], self.none)

    def merge_long(self, piece: bytes) -> list[int]:
        """Merge one piece: a heap of (rank, place) and a chain of the parts that are left."""
        ids = self.of_byte[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        merged = self.merges
        rank = lambda i: merged.get(ids[i] << 32 | ids[after[i]]) if after[i] < n else None
        heap = [(r, i) for i in range(n) if (r := rank(i)) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            if ids[i] is None or rank(i) != r:
                continue
            gone = after[i]
            ids[i], ids[gone], after[i] = r, None, after[gone]
            if after[i] < n:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and (r := rank(k)) is not None:
                    heapq.heappush(heap, (r, k))
        return [x for x in ids if x is not None]

    def merge_short(self, pieces: list[bytes]) -> list[bytes]:
        """Merge many pieces, one pair of each piece a pass; ids as little-endian bytes."""
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ids = self.of_byte[np.frombuffer(b"".join(pieces), np.uint8)]
        owner = np.repeat(np.arange(len(pieces)), size)
        pair = np.full(len(ids), self.none, np.int64)
        same = np.flatnonzero(owner[1:] == owner[:-1])
        pair[same] = self.of_pairs(ids[same], ids[same + 1])
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(ids):
            head = np.flatnonzero(np.diff(owner, prepend=-1))
            at = np.arange(len(ids))
            best = np.minimum.reduceat(pair << 32 | at, head)
            ready = (best >> 32) == self.none
            over = np.repeat(ready, np.diff(head, append=len(ids)))
            if over.any():
                done.append((owner[over], ids[over]))
            place = best[~ready] & 0xFFFFFFFF
            ids[place] = pair[place]
            keep = ~over
            keep[place + 1] = False
            shift = np.cumsum(keep) - 1
            ids, owner, pair, place = ids[keep], owner[keep], pair[keep], shift[place]
            for spot in (place, place[place > 0] - 1):
                inside = spot[spot + 1 < len(ids)]
                inside = inside[owner[inside] == owner[inside + 1]]
                pair[spot] = self.none
                pair[inside] = self.of_pairs(ids[inside], ids[inside + 1])
        owner = np.concatenate([o for o, _ in done])
        flat = np.concatenate([i for _, i in done])
        order = np.argsort(owner, kind="stable")
        raw = flat[order].astype("<u4").tobytes()
        ends = (np.cumsum(np.bincount(owner, minlength=len(pieces))) * 4).tolist()
        return [raw[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


class Encoder:
    """Encodes batches of texts; one per Python worker and rank file."""

    def __init__(self, path: str):
        self.ranks = Ranks(path)
        self.kinds = code_point_kinds()
        self.automaton = Automaton()
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def _lookup(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of different pieces, as little-endian bytes. Pieces unused for a generation are
        forgotten."""
        if len(self.young) > GENERATION:
            self.young, self.old = {}, self.young
        young, old, rank = self.young, self.old, self.ranks.rank
        found = list(map(young.get, pieces))
        short, long = [], []
        for k, ids in enumerate(found):
            if ids is not None:
                continue
            piece = pieces[k]
            ids = old.get(piece)
            if ids is None and (whole := rank.get(piece)) is not None:
                ids = whole.to_bytes(4, "little")
            if ids is None:
                (short if len(piece) <= SHORT_PIECE else long).append(k)
            else:
                found[k] = young[piece] = ids
        if short:
            for k, ids in zip(short, self.ranks.merge_short([pieces[k] for k in short]), strict=True):
                found[k] = young[pieces[k]] = ids
        for k in long:
            found[k] = np.array(self.ranks.merge_long(pieces[k]), "<u4").tobytes()
        return found

    def slices(self, texts: list[str]) -> tuple[bytes, np.ndarray, np.ndarray]:
        """The bytes of all texts, where pieces begin in them, and where texts begin."""
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        first = np.cumsum(sizes) - sizes
        width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
        offset = np.zeros(len(points) + 1, np.int64)
        np.cumsum(width, out=offset[1:])
        starts = self.automaton.starts(symbols_of(points, first[sizes > 0], self.kinds)) if len(points) else []
        return "".join(texts).encode("utf-8", "surrogatepass"), offset[np.flatnonzero(starts)], offset[first]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all texts, and how many ids each text has."""
        blob, first, begins = self.slices(texts)
        if not len(first):
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        data = np.frombuffer(blob, np.uint8)
        stop = np.append(first[1:], len(data))
        byte, up, down = byte_tables(len(data))
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(byte[data] * up[: len(data)], out=sums[1:])
        key = (sums[stop] - sums[first]) * down[first]
        long = np.flatnonzero(stop - first > HASHED_BYTES)
        key[long] = long
        _, place, piece = np.unique(key, return_index=True, return_inverse=True)
        different = [blob[a:b] for a, b in zip(first[place].tolist(), stop[place].tolist(), strict=True)]
        coded = self._lookup(different)
        size = np.fromiter(map(len, coded), np.int64, len(coded)) >> 2
        flat = np.frombuffer(b"".join(coded), "<u4")
        count = size[piece]
        ends = np.cumsum(count)
        ids = flat[np.repeat((np.cumsum(size) - size)[piece] - (ends - count), count) + np.arange(ends[-1])]
        upto = np.concatenate([[0], ends])[np.searchsorted(first, np.append(begins, len(data)))]
        return ids, np.diff(upto)

    def offsets(self, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The byte at which each token begins in its own text; text t has ``counts[t]`` tokens."""
        width = self.ranks.width[ids]
        begin = np.cumsum(width) - width
        head = (np.cumsum(counts) - counts)[counts > 0]
        return begin - np.repeat(begin[head], counts[counts > 0])

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> bytes:
        """The bytes of tokens that follow each other at ``offsets`` (the first one's is 0)."""
        width = self.ranks.width[ids]
        total = int(offsets[-1] + width[-1]) if len(ids) else 0
        return self.ranks.blob[np.repeat(self.ranks.place[ids] - offsets, width) + np.arange(total)].tobytes()

    def decode_all(self, ids: np.ndarray, offsets: np.ndarray, ends: np.ndarray) -> pa.Array:
        """The bytes of several texts; text t has the tokens from ``ends[t]`` to ``ends[t + 1]``."""
        cuts = zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)
        return pa.array([self.decode(ids[a:b], offsets[a:b]) for a, b in cuts], pa.binary())


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per Python worker, kept between tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def parts_of(sizes: list[int], most: int = BATCH_CHARS) -> Iterator[tuple[int, int]]:
    """Runs (first, behind the last) of rows of about ``most`` in all, one row at least."""
    first, held = 0, 0
    for k, size in enumerate(sizes, 1):
        held += size
        if held >= most or k == len(sizes):
            yield first, k
            first, held = k, 0


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def lists(values: np.ndarray, ends: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.int32()))


def _with(batch: pa.RecordBatch, schema: T.StructType, new: dict[str, pa.Array]) -> pa.RecordBatch:
    columns = [new[f.name] if f.name in new else batch.column(f.name) for f in schema]
    return pa.RecordBatch.from_arrays(columns, [f.name for f in schema])


def _schema(of: DataFrame, new: dict[str, T.DataType]) -> T.StructType:
    kept = [f for f in of.schema if f.name not in new]
    return T.StructType(kept + [T.StructField(name, kind) for name, kind in new.items()])


def encoded(docs: DataFrame, path: str, text: str = "text", decode: bool = False) -> DataFrame:
    """``docs`` with ``token_ids`` array<int> and ``token_offsets`` array<int>, the byte of the UTF-8
    text at which each token begins. ``decode`` adds ``decoded`` as the function of that name does, in
    the same pass."""
    ints = T.ArrayType(T.IntegerType())
    new = {"token_ids": ints, "token_offsets": ints} | ({"decoded": T.BinaryType()} if decode else {})
    schema = _schema(docs, new)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for batch in batches:
            column = batch.column(text)
            sizes = pc.fill_null(pc.utf8_length(column), 0).to_pylist()
            for a, b in parts_of(sizes):
                part = batch.slice(a, b - a)
                ids, counts = coder.encode([t or "" for t in part.column(text).to_pylist()])
                ends = np.concatenate([[0], np.cumsum(counts)])
                begins = coder.offsets(ids, counts)
                out = {"token_ids": lists(ids.astype(np.int32), ends), "token_offsets": lists(begins, ends)}
                if decode:
                    out["decoded"] = coder.decode_all(ids, begins, ends)
                yield _with(part, schema, out)

    return docs.mapInArrow(encode, schema)


def decoded(tokens: DataFrame, path: str) -> DataFrame:
    """Rows of ``encoded`` with ``decoded`` binary: the bytes of their ids."""
    schema = _schema(tokens, {"decoded": T.BinaryType()})

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for batch in batches:
            sizes = pc.list_value_length(batch.column("token_ids")).to_pylist()
            for a, b in parts_of(sizes):
                part = batch.slice(a, b - a)
                ids, begins = part.column("token_ids"), part.column("token_offsets")
                ends = np.concatenate([[0], np.cumsum(sizes[a:b], dtype=np.int64)])
                values = np.asarray(ids.flatten()), np.asarray(begins.flatten(), dtype=np.int64)
                yield _with(part, schema, {"decoded": coder.decode_all(*values, ends)})

    return tokens.mapInArrow(decode, schema)


def op13_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode every whole text of documents by the rank file, decode the ids; digests of both."""
    path = default_ranks()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = encoded(docs, path, decode=True)
    decimal = F.concat_ws(",", F.col("token_ids").cast("array<string>"))
    return rows.select(
        "doc_id",
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(decimal.cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
