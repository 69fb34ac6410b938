"""Packing: lexical retrieval packing with a sharded BM25 inverted index.

Terms are the words of a text (told apart by 53-bit hashes); their document frequencies are those of
the whole input. Documents are put in an order of their content: each has BANDS min-hashes of its
terms, but for those that over 1/COMMON of all documents hold, and takes the smallest key among all
documents with which it shares one; a key begins with the document's most frequent term, which parts
languages. The order, without the texts, is range-partitioned, and each range is cut into shards of
about SHARD_BYTES, one after the other, so near copies and texts of one kind meet in a shard.

Document frequencies are exact for every term, however many there are. Every task knows those of the
terms that over 1/COMMON of all documents hold: 64 times as many at most as a document has on
average. A document without any of them looks its terms up in a join. Each shard asks for the terms that
meet in it (others have no part in its scores): they go to the buckets of counts, and the
frequencies come back, so no task holds the whole table.

A task indexes a shard with BM25 weights of the whole input's statistics, all terms of all documents,
and fills windows of ``window`` ids: a seed document first; then, while room is left, the unused
documents that score highest for the seed's terms; then the next seed. What a window cuts off goes
on in the next one, so only a shard's last window can be short; it is cut into sequences of descending
powers of two, which need no padding.

Null text: empty; its document holds only the end id. Null doc_id: kept. Repeated rows and ties: each
row is packed by itself; equal scores go by the place in the shard, equal rows stand side by side, over
several shards if they are many. Empty table: no rows. A text longer than a shard: its shard is as
long. Extra columns are ignored.

The order and the scores shape which documents stand together, never which ids are packed.
"""

from __future__ import annotations

import functools
import math
import zlib

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from civlens.llm.common import release, written
from civlens.llm.jaccard_join import slices
from civlens.llm.tokens import batches, byte_tables, default_path, tokenizer

WINDOW = 1024
SHARD_BYTES = 4 << 20
#: A shard's scores are a square of this side at most.
SHARD_ROWS = 2048
ROW_BITS = np.uint64(11)
TERM_BITS = 53
SLOT_BITS = 19
#: Shards a task packs, and a range of the order has, about; a task holds one at a time, so any number will do.
TASK_SHARDS = 4
MAX_TASKS = 10_000
BANDS = 6
COMMON = 64
#: Different terms that a task counts before it passes them on.
COUNTED = 1 << 20
#: Bits of a term that choose its bucket of counts, at least; a bucket stands for up to BUCKET_BYTES of text.
BUCKET_BITS = 10
BUCKET_BYTES = 16 << 20
#: The same of the buckets that shards ask.
ASKED_BITS = 6
ASKED_BYTES = 128 << 20
#: Characters hashed at once: their numbers stay in the processor's cache.
HASHED_CHARS = 1 << 17
#: The usual BM25 parameters.
K1, B = 1.2, 0.75
PIECES = "doc_id string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A 53-bit hash of each word of all texts, the same in any worker, and each text's number of words."""
    keys, counts = [np.empty(0, np.int64)], np.zeros(len(texts), np.int64)
    for owner, parts in batches(texts, HASHED_CHARS):
        raw = [p.encode() for p in parts]
        data = np.frombuffer(b"\n".join([*raw, b""]), np.uint8)
        inside = (data != 32) & ((data < 9) | (data > 13))
        edge = np.flatnonzero(np.diff(inside, prepend=False))
        first, stop = edge[::2], edge[1::2]
        byte, up, down = byte_tables(len(data))
        sums = np.zeros(len(data) + 1, np.uint64)
        value = byte[data]
        value *= up[: len(data)]
        np.cumsum(value, out=sums[1:])
        keys.append((((sums[stop] - sums[first]) * down[first]) >> ROW_BITS).view(np.int64))
        ends = np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)) + 1)
        np.add.at(counts, owner, np.diff(np.searchsorted(first, ends), prepend=0))
    return np.concatenate(keys), counts


def term_frequencies(flat: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(term, document, tf) of the different terms of at most SHARD_ROWS documents, by term, then document."""
    key = (flat.view(np.uint64) << ROW_BITS) | np.repeat(np.arange(len(counts), dtype=np.uint64), counts)
    key.sort()
    at = np.flatnonzero(np.concatenate([np.ones(len(key[:1]), bool), key[1:] != key[:-1]]))
    key, tf = key[at], np.diff(at, append=len(key))
    return (key >> ROW_BITS).view(np.int64), (key & np.uint64(SHARD_ROWS - 1)).astype(np.int64), tf


def run_starts(term: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.concatenate([np.ones(len(term[:1]), bool), term[1:] != term[:-1]]))


class Corpus:
    """Number of documents, their mean length, and the document frequencies ``dfs`` of the sorted ``terms``."""

    def __init__(self, total: int, mean: float, terms: np.ndarray, dfs: np.ndarray):
        order = np.argsort(terms)
        self.total, self.mean, self.terms, self.dfs = total, mean, terms[order], dfs[order]

    def whole(self, term: np.ndarray, df: np.ndarray) -> np.ndarray:
        """Document frequencies in the whole input of a shard's sorted terms, of which ``df`` are the shard's."""
        return np.maximum(self.df(term), df)

    @functools.cached_property
    def begins(self) -> np.ndarray:
        """Where the terms of each value of the leading SLOT_BITS bits begin."""
        return np.searchsorted(self.terms, np.arange((1 << SLOT_BITS) + 1) << (TERM_BITS - SLOT_BITS)).astype(np.int32)

    def df(self, term: np.ndarray) -> np.ndarray:
        """0 for terms that are not known."""
        out = np.zeros(len(term), np.int64)
        slot = term >> (TERM_BITS - SLOT_BITS)
        at, stop = self.begins[slot], self.begins[slot + 1]
        left = np.flatnonzero(at < stop)
        at, stop = at[left], stop[left]
        while len(left):
            same = self.terms[at] == term[left]
            out[left[same]] = self.dfs[at[same]]
            at = at + 1
            on = ~same & (at < stop)
            left, at, stop = left[on], at[on], stop[on]
        return out


class ShardCorpus(Corpus):
    """What one shard knows: the document frequencies ``dfs`` of its terms of several documents, by term.
    A term of one document only has no part in the scores."""

    def __init__(self, total: int, mean: float, dfs: np.ndarray):
        self.total, self.mean, self.dfs = total, mean, dfs

    def whole(self, term: np.ndarray, df: np.ndarray) -> np.ndarray:
        out, met = df.copy(), df > 1
        if met.sum() != len(self.dfs):
            raise ValueError(f"{met.sum()} terms meet in the shard, {len(self.dfs)} are known")
        out[met] = self.dfs
        return out


class Index:
    """BM25 inverted index of one shard and, made from its postings, ``scores[a, b]`` of document b for
    all terms of document a. Without ``corpus`` the shard is the whole input."""

    def __init__(self, flat: np.ndarray, counts: np.ndarray, corpus: Corpus | None = None):
        self.n = n = len(counts)
        term, doc, tf = term_frequencies(flat, counts)
        first = run_starts(term)
        df = np.diff(first, append=len(term))
        total, mean, often = n, counts.mean() if n else 1, df
        if corpus is not None:
            total, mean, often = corpus.total, corpus.mean, corpus.whole(term[first], df)
        idf = np.log1p((total - often + 0.5) / (often + 0.5))
        norm = K1 * (1 - B + B * counts / max(mean, 1))
        weight = (np.repeat(idf, df) * tf * (K1 + 1) / (tf + norm[doc])).astype(np.float32)
        self.scores = np.zeros((n, n), np.float32)
        rare = max(8, n // 16)
        cells = self.scores.reshape(-1)
        for d in np.unique(df[(df > 1) & (df <= rare)]).tolist():
            some, step = first[df == d], max(1, (1 << 20) // (d * d))
            for k in range(0, len(some), step):
                spot = some[k : k + step, None] + np.arange(d)
                docs = doc[spot]
                pairs = docs[:, :, None] * n + docs[:, None, :]
                np.add.at(cells, pairs.ravel(), np.broadcast_to(weight[spot][:, None, :], pairs.shape).ravel())
        wide = np.flatnonzero(df > rare)
        for k in range(0, len(wide), 256):
            some = wide[k : k + 256]
            spot = np.concatenate([np.arange(first[t], first[t] + df[t]) for t in some])
            column = np.repeat(np.arange(len(some)), df[some])
            held = np.zeros((n, len(some)), np.float32)
            weighed = held.copy()
            held[doc[spot], column] = 1
            weighed[doc[spot], column] = weight[spot]
            self.scores += held @ weighed.T

    def neighbours(self, seed: int, unused: np.ndarray) -> np.ndarray:
        """Unused documents by falling score, then by number."""
        found = np.flatnonzero(unused & (self.scores[seed] > 0))
        return found[np.argsort(-self.scores[seed][found], kind="stable")]


def order_documents(index: Index, lens: np.ndarray, window: int) -> list[int]:
    """The order in which the documents fill windows."""
    unused, out, at = np.ones(index.n, bool), [], 0

    def take(d: int):
        nonlocal at
        unused[d] = False
        out.append(d)
        at += int(lens[d])

    for seed in range(index.n):
        current = seed
        while unused[current]:
            take(current)
            full = at // window
            scores = np.where(unused, index.scores[current], 0)
            while at % window and at // window == full:
                best = int(scores.argmax())
                if scores[best] <= 0:
                    break
                scores[best] = 0
                take(best)
            if at % window and at // window > full:
                # the cut document goes on in a new window and is its seed
                scores = np.where(unused, index.scores[out[-1]], 0)
                best = int(scores.argmax())
                if scores[best] > 0:
                    current = best
    return out


def pack_shard(doc_ids: list, texts: list[str], path: str, window: int, end_id: int, base: int, corpus: Corpus) -> pd.DataFrame:
    flat, ends = tokenizer(path).encode(texts)
    ids = np.insert(flat, ends, end_id).astype("<u4")  # of all documents, an end id after each
    lens = np.diff(ends, prepend=0) + 1
    begins = np.cumsum(lens) - lens
    order = order_documents(Index(*word_hashes(texts), corpus), lens, window)
    held = int(lens.sum())
    # where sequences end: full windows, then powers of two
    cuts, rest, at = [], held % window, held - held % window
    for bit in reversed(range(rest.bit_length())):
        if rest >> bit & 1:
            at += 1 << bit
            cuts.append(at)
    full = held // window * window
    rows, pos, tail = [], 0, 0
    for d in order:
        done, n = 0, int(lens[d])
        while done < n:
            if pos < full:
                sequence, offset = divmod(pos, window)
                take = min(n - done, window - offset)
            else:
                while cuts[tail] <= pos:
                    tail += 1
                offset = pos - (cuts[tail - 1] if tail else full)
                sequence = full // window + tail
                take = min(n - done, cuts[tail] - pos)
            a = int(begins[d]) + done
            crc = zlib.crc32(ids[a : a + take])
            rows.append((doc_ids[d], done, take, crc, n, base + sequence, offset))
            done += take
            pos += take
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    return pd.DataFrame(rows, columns=names)


def term_counts(rows: DataFrame, bits: int = BUCKET_BITS, single: bool = True) -> DataFrame:
    """(term, df, tf) of the whole input. Counts go by the leading ``bits`` of the term, those of a task
    and bucket in one row. Without ``single``, the terms of one document only are summed in rows of
    term -1."""

    def merged(parts):
        term, df, tf = (np.concatenate(c) for c in zip(*parts, strict=True))
        order = np.argsort(term)
        term = term[order]
        first = run_starts(term)
        return term[first], np.add.reduceat(df[order], first), np.add.reduceat(tf[order], first)

    def dealt(counts):
        ends = np.searchsorted(counts[0], np.arange(1, 1 << bits) << (TERM_BITS - bits))
        tables = np.split(np.stack(counts), ends, axis=1)
        found = [(k, t.tobytes()) for k, t in enumerate(tables) if t.size]
        return pd.DataFrame(found, columns=["bucket", "counts"])

    def run(pdfs):
        parts, held = [], 0
        for part in slices(pdfs, SHARD_ROWS):
            flat, counts = word_hashes([t or "" for t in part["text"]])
            if not len(flat):
                continue
            term, _, tf = term_frequencies(flat, counts)
            first = run_starts(term)
            parts.append((term[first], np.diff(first, append=len(term)), np.add.reduceat(tf, first)))
            held += len(first)
            if held > 2 * COUNTED:
                parts = [merged(parts)]
                held = len(parts[0][0])
                if held > COUNTED:
                    yield dealt(parts.pop())
                    held = 0
        if parts:
            yield dealt(merged(parts))

    def summed(pdf):
        term, df, tf = merged([np.frombuffer(c, np.int64).reshape(3, -1) for c in pdf["counts"]])
        if not single:
            one = df == 1
            rest = tf[one].sum()
            term, df, tf = (np.append(c[~one], x) for c, x in ((term, -1), (df, 1), (tf, rest)))
        return pd.DataFrame({"term": term, "df": df, "tf": tf})

    some = rows.select("text").mapInPandas(run, "bucket int, counts binary")
    return some.groupBy("bucket").applyInPandas(summed, "term long, df long, tf long")


def mixed(x: np.ndarray) -> np.ndarray:
    """Well-spread 64-bit numbers of ``x``."""
    x = (x.view(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def content_keys(rows: DataFrame, shared) -> DataFrame:
    """(row, size, key, b0, b1, ..., terms, marks) of every document: its length, its own key, 15 bits (the
    mark) of its most frequent term before 48 of the row's, and its min-hashes (-1: it has no term for one).
    A document that holds none of the terms in ``shared`` has no key, but its terms and their marks."""
    names = [f"b{k}" for k in range(BANDS)]
    # odd factors, which give each min-hash its own order of the terms' numbers
    factors = mixed(np.arange(BANDS)) | np.uint64(1)

    def run(pdfs):
        corpus = shared.value
        for part in slices(pdfs, 512):
            texts = [t or "" for t in part["text"]]
            term, counts = word_hashes(texts)
            df = corpus.df(term)
            # texts follow each other, so a document's least and greatest are those of its stretch
            has = counts > 0
            ends = np.cumsum(counts)
            first = (ends - counts)[has]
            most = np.zeros(len(part), np.uint64)
            row = part["row"].to_numpy(np.int64)
            out = {"row": row, "size": [len(t) for t in texts], "key": most}
            for name in names:
                out[name] = np.full(len(part), -1)
            terms, marks = [None] * len(part), [None] * len(part)
            if len(first):
                value = mixed(term)
                mark = value >> np.uint64(49)
                top = np.maximum.reduceat((df.astype(np.uint64) << np.uint64(15)) | mark, first)
                most[has] = top & np.uint64((1 << 15) - 1)
                for k in np.flatnonzero(has)[top >> np.uint64(15) == 0]:
                    own = slice(ends[k] - counts[k], ends[k])
                    terms[k], at = np.unique(term[own], return_index=True)
                    marks[k] = mark[own][at].view(np.int64)
                rare = df * COMMON <= corpus.total
                few = np.add.reduceat(rare, first, dtype=np.int64)
                told = np.flatnonzero(has)[few > 0]
                few, value = few[few > 0], value[rare]
                if len(told):
                    for name, factor in zip(names, factors, strict=True):
                        out[name][told] = np.minimum.reduceat(value * factor, np.cumsum(few) - few).view(np.int64)
            out["key"] = ((most << np.uint64(48)) | (row.view(np.uint64) >> np.uint64(16))).view(np.int64)
            yield pd.DataFrame(out | {"terms": terms, "marks": marks})

    bands = ", ".join(f"{b} long" for b in names)
    schema = f"row long, size long, key long, {bands}, terms array<long>, marks array<long>"
    return rows.select("row", "text").mapInPandas(run, schema)


def with_rare_keys(keys: DataFrame, known: DataFrame) -> DataFrame:
    """The keys of all documents, from the document frequencies ``known`` of all terms of several documents."""
    held = keys.where("terms is not null").select("row", F.explode(F.arrays_zip("terms", "marks")).alias("t"))
    held = held.select("row", F.col("t.terms").alias("term"), F.col("t.marks").alias("mark"))
    top = F.max(F.coalesce("df", F.lit(1)) * (1 << 15) + F.col("mark"))
    most = held.join(known, "term", "left").groupBy("row").agg((top % (1 << 15)).alias("most"))
    key = F.shiftleft("most", 48).bitwiseOR(F.shiftrightunsigned("row", 16))
    names = [c for c in keys.columns if c not in ("terms", "marks")]
    rare = keys.where("terms is not null").drop("key").join(most, "row").withColumn("key", key)
    return keys.where("terms is null").select(names).union(rare.select(names))


def placed(keys: DataFrame) -> DataFrame:
    """(row, lead, size, copies): the smallest key of the documents that share a min-hash with the row's, and
    how often the row comes."""
    own = keys.select("row", "key", F.explode(F.array(*[f"b{k}" for k in range(BANDS)])).alias("band")).where("band <> -1")
    leads = own.groupBy("band").agg(F.min("key").alias("lead"), F.count("*").alias("n")).where("n > 1").select("band", "lead")
    found = own.join(leads, "band").select("row", "lead", F.lit(0).cast("long").alias("size"), F.lit(0).alias("copies"))
    found = found.union(keys.select("row", "key", "size", F.lit(1)))
    return found.groupBy("row").agg(F.min("lead").alias("lead"), F.max("size").alias("size"), F.sum("copies").alias("copies"))


def in_shards(places: DataFrame, tasks: int, shard_bytes: int) -> DataFrame:
    """(row, shard, at, first, each): the row's copies are number ``at`` of their range of the order; the first
    ``first`` of them stand in ``shard``, the others, ``each`` at a time, in the shards after it. A shard ends
    once it holds ``shard_bytes`` or SHARD_ROWS rows."""

    def run(pdfs):
        shard, held, n, at = TaskContext.get().partitionId() << 20, 0, 0, 0
        for pdf in pdfs:
            out = []
            for row, size, copies in zip(*(pdf[c].tolist() for c in ("row", "size", "copies")), strict=True):
                size = max(size, 1)
                each = min(SHARD_ROWS, -(-shard_bytes // size))
                first = min(copies, SHARD_ROWS - n, -((held - shard_bytes) // size))
                out.append((row, shard, at, first, each))
                at, held, n = at + 1, held + first * size, n + first
                if held >= shard_bytes or n >= SHARD_ROWS:
                    shard, held, n = shard + 1, 0, 0
                if copies > first:
                    # the open shard was full
                    full, n = divmod(copies - first, each)
                    shard, held = shard + full, n * size
            yield pd.DataFrame(out, columns=["row", "shard", "at", "first", "each"])

    ranged = places.repartitionByRange(tasks, "lead", "row").sortWithinPartitions("lead", "row")
    return ranged.select("row", "size", "copies").mapInPandas(run, "row long, shard long, at long, first long, each long")


def shard_frequencies(dealt: DataFrame, known: DataFrame, bits: int = ASKED_BITS) -> DataFrame:
    """(shard, bucket, dfs): the document frequencies ``known`` of the terms that several documents of a shard
    hold, by term, those of a bucket (the leading ``bits`` of the term) in one row."""

    def asked(pdf):
        term, _, _ = term_frequencies(*word_hashes([t or "" for t in pdf["text"]]))
        first = run_starts(term)
        met = term[first][np.diff(first, append=len(term)) > 1]
        parts = np.split(met, np.searchsorted(met, np.arange(1, 1 << bits) << (TERM_BITS - bits)))
        found = [(k, t.tobytes()) for k, t in enumerate(parts) if len(t)]
        return pd.DataFrame(found, columns=["bucket", "terms"]).assign(shard=pdf["shard"].iloc[0])

    def answered(asks, counts):
        order = np.argsort(counts["term"].to_numpy(np.int64))
        term, df = (counts[c].to_numpy(np.int64)[order] for c in ("term", "df"))
        dfs = []
        for terms in asks["terms"]:
            met = np.frombuffer(terms, np.int64)
            at = np.searchsorted(term, met)
            if not np.array_equal(term[at[at < len(term)]], met):
                raise ValueError("a shard holds terms that were not counted")
            dfs.append(df[at].tobytes())
        return pd.DataFrame({"shard": asks["shard"], "bucket": asks["bucket"], "dfs": dfs})

    asks = dealt.groupBy("shard").applyInPandas(asked, "shard long, bucket int, terms binary")
    dealt_counts = known.withColumn("bucket", F.shiftright("term", TERM_BITS - bits).cast("int"))
    return asks.groupBy("bucket").cogroup(dealt_counts.groupBy("bucket")).applyInPandas(answered, "shard long, bucket int, dfs binary")


def pack(docs: DataFrame, path: str, window: int = WINDOW, end_id: int = 0, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """A row for each piece of a document in a sequence of at most ``window`` ids."""
    spark = docs.sparkSession
    rows = docs.select(F.xxhash64("doc_id", "text").alias("row"), F.col("doc_id").cast("string").alias("doc_id"), "text")
    size, total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count("*")).first()
    bits = max(BUCKET_BITS, (size // BUCKET_BYTES).bit_length())
    counts = written(term_counts(rows, bits, single=False), "pack-terms")
    mean = (counts.agg(F.sum("tf")).first()[0] or 0) / max(total, 1)
    known = counts.where("df > 1").select("term", "df")
    common = known.where(F.col("df") * COMMON > total).toPandas()
    shared = spark.sparkContext.broadcast(Corpus(total, mean, common["term"].to_numpy(np.int64), common["df"].to_numpy(np.int64)))
    release(spark)
    tasks = min(MAX_TASKS, max(1, math.ceil(size / (TASK_SHARDS * shard_bytes))))
    keys = with_rare_keys(written(content_keys(rows, shared), "pack-keys"), known)
    places = written(in_shards(placed(keys), tasks, shard_bytes), "pack-places")
    release(spark)
    # equal rows have one place; the number of the copy parts them where they are many
    copy = F.row_number().over(Window.partitionBy("row").orderBy("row")) - 1
    numbered = rows.withColumn("copy", copy).join(places, "row")
    later = F.when(F.col("copy") >= F.col("first"), F.expr("1 + (copy - first) div each")).otherwise(0)
    dealt = numbered.select((F.col("shard") + later).alias("shard"), "at", "doc_id", "text").repartition(tasks, "shard")
    dfs = shard_frequencies(dealt, known, max(ASKED_BITS, (size // ASKED_BYTES).bit_length()))

    def run(pdf, dfs):
        pdf = pdf.sort_values("at", kind="stable")
        found = [np.frombuffer(d, np.int64) for d in dfs.sort_values("bucket")["dfs"]]
        corpus = ShardCorpus(total, mean, np.concatenate([*found, np.empty(0, np.int64)]))
        texts = [t or "" for t in pdf["text"]]
        return pack_shard(pdf["doc_id"].tolist(), texts, path, window, end_id, int(pdf["shard"].iloc[0]) << 28, corpus)

    pieces = dealt.groupBy("shard").cogroup(dfs.groupBy("shard")).applyInPandas(run, PIECES)
    return pieces.withColumn("doc_id", F.col("doc_id").cast("long"))


def op6_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_path())
