"""Ranked lexical search by dual trees: the best documents of every item, exactly.

Items are taken in blocks of a bounded size. For a block, each document is cut into terms once and
keeps its length and the counts of the block's terms (a table in the shared folder); lengths and
document frequencies over all documents give the weights. Each task then walks its documents, a few
thousand at a time: both items and documents are halved again and again along the widest of some random
directions, which gives binary hierarchies whose nodes hold, for each term, the maximum over what lies
below. The product of two nodes bounds every score between them. A pair of nodes goes on only if its bound reaches the weakest k-th
score among the items below, so whole batches are passed over without loss; pairs of leaves are scored
exactly, best bound first. A task returns at most k rows an item, a window picks the best of all tasks.

All numbers are integers. They are multiplied as doubles while no sum can reach 2^53, else as 64-bit
integers.

Nulls and texts without terms: such items return nothing, such documents count nowhere. Long texts are
taken whole. Equal scores go by ascending doc_id, null ids last. Every row of the items is an item of
its own (repeated ones get equal lists), every row of the documents a document. Empty tables give an
empty result. Further columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from civlens.llm.common import with_global_index, written

#: Bytes that part terms, and what A-Z become: a table for bytes.translate.
_PARTS = [*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]
TERM_BYTES = bytes(
    0x20 if b in _PARTS else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)
)
#: Items of a block, and bytes of its terms (a block of one item may be larger: it is one row).
BLOCK_ITEMS, BLOCK_BYTES = 256, 4 << 20
#: Items and documents in a leaf of their hierarchies.
ITEM_LEAF, DOC_LEAF = 1, 8
#: Numbers in the maxima of the documents' leaves in a batch.
BATCH_CELLS = 2 << 20
#: Random directions into which weights are folded to find out what lies near.
DIRECTIONS = 32
#: The largest impact of a term, as the formula has it.
TOP_IMPACT = 1_000_000


def terms_of(text: str | None) -> list[bytes]:
    """The terms of a text in order: runs of ASCII letters and digits and all other characters."""
    return (text or "").encode().translate(TERM_BYTES).split()


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impacts(tf: np.ndarray, length: np.ndarray, n_docs: int, total: int) -> np.ndarray:
    m = 25 + (75 * length * n_docs) // total
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def term_rows(items: DataFrame) -> DataFrame:
    """idx, item_id, term, uses: the distinct terms of each item."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            idx, ids, texts = (c.to_pylist() for c in batch.columns)
            for i, item, text in zip(idx, ids, texts, strict=True):
                count = Counter(terms_of(text))
                n = len(count)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i] * n, pa.int64()), pa.array([item] * n, pa.int64()),
                     pa.array(list(count), pa.binary()), pa.array(list(count.values()), pa.int64())],
                    ["idx", "item_id", "term", "uses"],
                )

    return items.select("idx", "item_id", "text").mapInArrow(cut, "idx long, item_id long, term binary, uses long")


def item_blocks(terms: DataFrame) -> Iterator[list]:
    """Rows of ``term_rows``, block by block: at most BLOCK_ITEMS items and, but for a single larger
    item, BLOCK_BYTES bytes at a time. The driver holds one block."""
    bins = terms.groupBy(F.floor(F.col("idx") / BLOCK_ITEMS).alias("bin"))
    todo = [(r.bin * BLOCK_ITEMS, (r.bin + 1) * BLOCK_ITEMS, r.held) for r in
            bins.agg(F.sum(F.length("term") + 24).alias("held")).orderBy(F.desc("bin")).collect()]
    while todo:
        low, high, held = todo.pop()
        rows = terms.where(F.col("idx").between(low, high - 1))
        if held > BLOCK_BYTES and high - low > 1:
            middle = (low + high) // 2
            half = lambda a, b: rows.where(F.col("idx").between(a, b - 1)).agg(F.sum(F.length("term") + 24)).first()[0] or 0  # noqa: E731, B023
            todo += [(middle, high, half(middle, high)), (low, middle, half(low, middle))]
        elif held:
            yield rows.collect()


def counted(docs: DataFrame, vocabulary) -> DataFrame:
    """doc_id, length (terms with repeats), ``term_ids`` and ``tfs`` of the vocabulary's terms."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = vocabulary.value
        for batch in batches:
            lengths, sizes, ids, tfs = [], [], [], []
            for text in batch.column(1):
                terms = terms_of(text.as_py())
                found = Counter(map(number.get, terms))
                found.pop(None, None)
                lengths.append(len(terms))
                sizes.append(len(found))
                ids.extend(found)
                tfs.extend(found.values())
            ends = pa.array(np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(x, pa.int32())) for x in (ids, tfs)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(lengths, pa.int64()), *lists], ["doc_id", "length", "term_ids", "tfs"]
            )

    return docs.select("doc_id", "text").mapInArrow(count, "doc_id long, length long, term_ids array<int>, tfs array<int>")


def arranged(points: np.ndarray, leaf: int) -> np.ndarray:
    """An order of the points in which the nodes of a binary hierarchy over leaves of ``leaf`` points hold
    near ones: each node is halved along its widest direction."""
    order, todo = np.arange(len(points)), [(0, len(points))]
    while todo:
        low, high = todo.pop()
        if high - low <= leaf:
            continue
        of = points[order[low:high]]
        of = of - of.mean(axis=0)
        along = of @ np.linalg.eigh(of.T @ of)[1][:, -1]
        order[low:high] = order[low:high][np.argsort(along, kind="stable")]
        leaves = -(-(high - low) // leaf)
        middle = low + leaf * (1 << ((leaves - 1).bit_length() - 1))
        todo += [(low, middle), (middle, high)]
    return order


def halved(levels: list[np.ndarray], best: np.ufunc) -> list[np.ndarray]:
    """Levels of a binary hierarchy from its leaves' values."""
    while len(levels[-1]) > 1:
        levels.append(best.reduceat(levels[-1], np.arange(0, len(levels[-1]), 2)))
    return levels


class Search:
    """The items' hierarchy and the best documents so far. ``weights`` is items x terms."""

    def __init__(self, weights: np.ndarray, k: int):
        exact = int(weights.max(axis=0).sum()) * TOP_IMPACT < 1 << 53
        self.kind = np.float64 if exact else np.int64
        n, self.n_terms = weights.shape
        signs = np.random.default_rng(1).choice([-1.0, 1.0], (self.n_terms, DIRECTIONS))
        self.order = arranged(weights @ signs, ITEM_LEAF)
        self.weights = weights[self.order].astype(self.kind)
        self.levels = halved([np.maximum.reduceat(self.weights, np.arange(0, n, ITEM_LEAF))], np.maximum)
        self.signs = signs * weights.max(axis=0)[:, None]
        self.k, self.scored = k, 0
        self.score, self.doc = np.zeros((n, k), np.int64), np.zeros((n, k), np.int64)
        self.missing = np.zeros((n, k), bool)

    def weakest(self) -> list[np.ndarray]:
        """The weakest k-th score below each node of the items' levels."""
        last = self.score[:, -1]
        return halved([np.minimum.reduceat(last, np.arange(0, len(last), ITEM_LEAF))], np.minimum)

    def add(self, owner: np.ndarray, term: np.ndarray, impact: np.ndarray, doc: np.ndarray, missing: np.ndarray):
        """Search the items in some documents. Entry e says that ``term[e]`` has ``impact[e]`` in the
        document numbered ``owner[e]``; entries come by document."""
        points = np.zeros((len(doc), DIRECTIONS))
        starts = np.flatnonzero(np.diff(owner, prepend=-1))
        if not len(starts):
            return
        points[owner[starts]] = np.add.reduceat(self.signs[term] * impact[:, None], starts)
        order = arranged(points, DOC_LEAF)
        place = np.empty(len(doc), np.int64)
        place[order] = np.arange(len(doc))
        at = place[owner]
        by_place = np.argsort(at, kind="stable")
        at, term, impact = at[by_place], term[by_place], impact[by_place].astype(self.kind)
        doc, missing = doc[order], missing[order]
        leaves = np.zeros((-(-len(doc) // DOC_LEAF), self.n_terms), self.kind)
        np.maximum.at(leaves, (at // DOC_LEAF, term), impact)
        pairs, bound = self._reached(halved([leaves], np.maximum))
        top = np.zeros(len(leaves), self.kind)
        np.maximum.at(top, pairs[:, 1], bound)
        by_leaf = np.argsort(pairs[:, 1], kind="stable")
        pairs, bound = pairs[by_leaf], bound[by_leaf]
        for d in np.argsort(-top, kind="stable").tolist():
            low, high = np.searchsorted(pairs[:, 1], [d, d + 1])
            weakest = np.minimum.reduceat(self.score[:, -1], np.arange(0, len(self.score), ITEM_LEAF))
            near = pairs[low:high, 0][bound[low:high] >= weakest[pairs[low:high, 0]]]
            if not len(near):
                continue
            items = (near[:, None] * ITEM_LEAF + np.arange(ITEM_LEAF)).ravel()
            items = items[items < len(self.weights)]
            some = slice(d * DOC_LEAF, (d + 1) * DOC_LEAF)
            low, high = np.searchsorted(at, [some.start, some.stop])
            part = np.zeros((len(doc[some]), self.n_terms), self.kind)
            part[at[low:high] - some.start, term[low:high]] = impact[low:high]
            self._take(items, (self.weights[items] @ part.T).astype(np.int64), doc[some], missing[some])

    def _reached(self, docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of leaves (of items, of documents) that may hold a better score, and their bounds."""
        a, b = len(self.levels) - 1, len(docs) - 1
        pairs, weakest = np.zeros((1, 2), np.int64), self.weakest()
        while True:
            bound = (self.levels[a] @ docs[b].T)[pairs[:, 0], pairs[:, 1]]
            reach = (bound > 0) & (bound >= weakest[a][pairs[:, 0]])
            pairs, bound = pairs[reach], bound[reach]
            if a == b == 0 or not len(pairs):
                return pairs, bound
            for side, deeper in ((0, a > 0), (1, b > 0)):
                if deeper:
                    below = len((self.levels[a - 1], docs[b - 1])[side])
                    pairs = np.repeat(pairs, 2, axis=0)
                    pairs[:, side] = 2 * pairs[:, side] + np.tile([0, 1], len(pairs) // 2)
                    pairs = pairs[pairs[:, side] < below]
            a, b = max(a - 1, 0), max(b - 1, 0)

    def _take(self, items: np.ndarray, scores: np.ndarray, doc: np.ndarray, missing: np.ndarray):
        self.scored += scores.size
        better = (scores > 0) & (scores >= self.score[items, -1:])
        for row in np.flatnonzero(better.any(axis=1)):
            item, new = items[row], better[row]
            score = np.concatenate([self.score[item], scores[row, new]])
            docs = np.concatenate([self.doc[item], doc[new]])
            lost = np.concatenate([self.missing[item], missing[new]])
            best = np.lexsort((docs, lost, -score))[: self.k]
            self.score[item], self.doc[item], self.missing[item] = score[best], docs[best], lost[best]


def searched(table: DataFrame, payload, n_docs: int, total: int, k: int) -> DataFrame:
    """idx, item_id, doc_id, score: each task's best documents of each item of the block."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idx, item_ids, rows, cols, values, shape = payload.value
        weights = np.zeros(shape, np.int64)
        weights[rows, cols] = values
        state = Search(weights, k)
        step = DOC_LEAF * max(1, BATCH_CELLS // shape[1])
        for batch in batches:
            doc, length, ids, tfs = batch.columns
            lost = np.asarray(doc.is_null())
            doc = np.asarray(doc.fill_null(0))
            ends = np.asarray(ids.offsets)
            flat, tf = np.asarray(ids.values), np.asarray(tfs.values).astype(np.int64)
            owner = np.repeat(np.arange(len(doc)), np.diff(ends))
            flat, tf = flat[ends[0] : ends[-1]], tf[ends[0] : ends[-1]]
            value = impacts(tf, np.asarray(length)[owner], n_docs, total)
            for at in range(0, len(doc), step):
                low, high = np.searchsorted(owner, [at, at + step])
                state.add(owner[low:high] - at, flat[low:high], value[low:high], doc[at : at + step], lost[at : at + step])
        row, place = np.nonzero(state.score)
        item = state.order[row]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.array(idx, np.int64)[item]),
                pa.array([item_ids[i] for i in item.tolist()], pa.int64()),
                pa.array(state.doc[row, place], mask=state.missing[row, place]),
                pa.array(state.score[row, place]),
            ],
            ["idx", "item_id", "doc_id", "score"],
        )

    return table.mapInArrow(search, "idx long, item_id long, doc_id long, score long")


def ranked(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of each row of ``items`` (item_id, text)."""
    spark = docs.sparkSession
    numbered = with_global_index(items.select("item_id", "text"), ["item_id", "text"], "items")
    terms = written(term_rows(numbered), "item-terms")
    found = spark.createDataFrame([], "idx long, item_id long, doc_id long, score long")
    for rows in item_blocks(terms):
        number = {t: j for j, t in enumerate(dict.fromkeys(bytes(r.term) for r in rows))}
        vocabulary = spark.sparkContext.broadcast(number)
        table = written(counted(docs, vocabulary), "term-counts")
        n_docs, total = table.where("length > 0").agg(F.count("*"), F.sum("length")).first()
        if not n_docs:
            return found.selectExpr("item_id", "1 AS rank", "doc_id", "score")
        df = dict(table.select(F.explode("term_ids").alias("t")).groupBy("t").count().collect())
        place = {i: (j, item) for j, (i, item) in enumerate(dict.fromkeys((r.idx, r.item_id) for r in rows))}
        payload = (
            list(place),
            [item for _, item in place.values()],
            np.array([place[r.idx][0] for r in rows]),
            np.array([number[bytes(r.term)] for r in rows]),
            np.array([r.uses * weight(n_docs, df.get(number[bytes(r.term)], 0)) for r in rows], np.int64),
            (len(place), len(number)),
        )
        relevant = table.where(F.size("term_ids") > 0)
        hits = searched(relevant, spark.sparkContext.broadcast(payload), n_docs, total, k)
        found = found.union(hits)
    best = Window.partitionBy("idx").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten highest-scoring documents of each benchmark item."""
    return ranked(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
