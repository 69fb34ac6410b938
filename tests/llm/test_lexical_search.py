"""Dual-tree search against scoring every document."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from civlens.llm import lexical_search as L

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return ["".join(c.lower() if "A" <= c <= "Z" else c for c in t) for t in TERM.findall(text or "")]


def brute(docs, items, k=10):
    rows = [(i, Counter(terms(t))) for i, t in docs]
    n_docs, total = sum(1 for _, c in rows if c), sum(sum(c.values()) for _, c in rows)
    df = Counter(t for _, c in rows for t in c)
    postings = defaultdict(list)
    for j, (_, c) in enumerate(rows):
        n = sum(c.values())
        for t, f in c.items():
            postings[t].append((j, (1_000_000_000 * f) // (1000 * f + 8 * (100 - 75 + (75 * n * n_docs) // total))))
    for item, text in items:
        score = Counter()
        for t, uses in Counter(terms(text)).items():
            w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
            for j, x in postings[t]:
                score[j] += uses * w * x
        best = sorted((-s, rows[j][0] is None, rows[j][0] or 0, rows[j][0]) for j, s in score.items() if s > 0)[:k]
        yield from ((item, r, b[3], -b[0]) for r, b in enumerate(best, 1))


def in_order(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x or 0) for x in r))


def items_of(spark, rows):
    return spark.createDataFrame([(i, t, 7, 7) for i, t in rows], "item_id long, text string, idx int, rank int")


def check(spark, frame, docs, items):
    got = [tuple(r) for r in L.ranked(frame([(i, t, "s") for i, t in docs]), items_of(spark, items)).collect()]
    assert in_order(got) == in_order(brute(docs, items))
    return got


def test_odd_rows(spark, frame, odd):
    docs = [(r.doc_id, r.text) for r in odd.collect()]
    items = [(1, "the QUICK fox, an id and w5x5"), (2, None), (3, ""), (4, "... !!"), (5, "漢字 ✓ É é"), (6, "one one one"),
             (7, "nowhere"), (None, "lazy dog"), (8, "w1x1 " * 5000), (6, "one one one")]
    got = check(spark, frame, docs, items)
    assert {r[0] for r in got} == {1, 5, 6, None, 8}


def test_ties_and_copies(spark, frame):
    docs = [(k, "same words here") for k in range(60, 0, -1)] + [(5, "same words here")] * 3 + [(None, "same words here")] * 4
    docs += [(1000 + k, f"other {k}") for k in range(50)]
    got = check(spark, frame, docs, [(1, "same"), (2, "words words"), (3, "other 7")])
    assert [r[2] for r in sorted(got) if r[0] == 1] == [1, 2, 3, 4, 5, 5, 5, 5, 6, 7]


def test_empty_tables(spark, frame, empty):
    assert L.ranked(empty, items_of(spark, [(1, "a b")])).collect() == []
    assert L.ranked(frame([(1, "a b", "s")]), items_of(spark, [])).collect() == []
    assert L.ranked(frame([(1, None, "s")]), items_of(spark, [(1, "a b")])).collect() == []


@pytest.mark.parametrize("items, size", [(7, 1 << 22), (256, 300)])
def test_blocks_of_items(spark, frame, monkeypatch, items, size):
    monkeypatch.setattr(L, "BLOCK_ITEMS", items)
    monkeypatch.setattr(L, "BLOCK_BYTES", size)
    rng = random.Random(3)
    some = lambda n: " ".join(rng.choices("abcdefghijklmnop", weights=range(1, 17), k=n))
    check(spark, frame, [(k, some(rng.randint(0, 30))) for k in range(300)], [(k, some(rng.randint(0, 9))) for k in range(40)])


def test_whole_table(spark):
    d = "/root/testdata/sf0.01"
    docs, items = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "benchmark"))
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert in_order(tuple(r) for r in L.op12_lexical_search(spark, d).collect()) == in_order(want)


@pytest.mark.parametrize("big", [False, True])
def test_trees_leave_batches_out_and_stay_exact(big):
    rng = np.random.default_rng(4)
    n, v = 3000, 120
    weights = np.where(rng.random((40, v)) < 0.08, rng.integers(1, 9000, (40, v)), 0) * (10**6 if big else 1)
    weights[7] = 0
    topic = rng.integers(0, 12, n)
    part = (rng.random((n, v)) < 0.3) & (np.arange(v)[None] // 10 == topic[:, None])
    impact = np.where(part, rng.integers(1, 10**6, (n, v)), 0)
    search = L.Search(weights, 10)
    assert search.kind == (np.int64 if big else np.float64)
    for at in range(0, n, 500):
        owner, term = np.nonzero(impact[at : at + 500])
        search.add(owner, term, impact[at + owner, term], np.arange(at, at + 500), np.zeros(500, bool))
    scores = weights @ impact.T
    for row, item in enumerate(search.order):
        want = np.lexsort((np.arange(n), -scores[item]))[:10]
        if item != 7:
            assert search.doc[row].tolist() == want.tolist()
        assert (search.score[row] == scores[item][want]).all()
    assert search.scored < 0.4 * scores.size
