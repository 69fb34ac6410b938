"""Fingerprints, Jaccard join, mixing and the pipeline."""

import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import accumulate

import duckdb
import numpy as np
import pytest
import tokenizers

import corpus_pipeline
from civlens.llm import fingerprints, jaccard_join, mixing
from civlens.llm.common import small_batches

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, n, lower=False):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or "") if lower else text or "")
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def edited_rows(docs):
    """Brute force over the distinct (doc_id, text) in descending doc_id order."""
    chain = sorted({(-1 if i is None else i, t or "") for i, t in docs}, key=lambda r: -r[0])
    for k, (i, text) in enumerate(chain):
        following = chain[(k + 1) % len(chain)][1]
        m = len(text) // 3
        yield i, text, text[: len(text) - m] + following[:m], following


def test_fingerprints_of_edited_texts(frame):
    rng = random.Random(3)
    words = [f"w{k}é" for k in range(3000)]
    docs = [(k, " ".join(rng.choices(words, k=rng.choice([0, 1, 3, 40, 200, 900]))), "s") for k in range(150)]
    docs += [(None, "null id \U0001f600 text", "s"), (200, None, "s"), (7, docs[7][1], "s")]
    made = fingerprints.edited_pairs(frame(docs))
    got = {(-1 if r.doc_id is None else r.doc_id): r for r in made.select(
        "doc_id", "n_chars", "edited", fingerprints.packed(made["bits"]).alias("own"),
        fingerprints.likeness(made["bits"], made["edited_bits"]).alias("near"),
        fingerprints.likeness(made["bits"], made["next_bits"]).alias("next"),
    ).collect()}
    assert made.count() == len(docs)
    errors = []
    for i, text, edited, following in edited_rows([d[:2] for d in docs]):
        a, b, c = shingles(text, 5), shingles(edited, 5), shingles(following, 5)
        assert (got[i].n_chars, got[i].edited) == (len(text), edited)
        assert len(got[i].own) == (256 if a else 0)
        if a | b:
            errors.append(got[i].near - len(a & b) / len(a | b))
        assert abs(got[i].next - (len(a & c) / len(a | c) if a | c else 1)) < 0.15
    assert abs(sum(errors) / len(errors)) < 0.02 and max(map(abs, errors)) < 0.25


def test_fingerprints_are_equal_for_equal_texts_only(frame, odd, empty):
    got = {}
    made = fingerprints.edited_pairs(odd)
    for r in made.select("doc_id", "n_chars", fingerprints.packed(made["bits"]).alias("f")).collect():
        got.setdefault(r.f, set()).add(r.n_chars)
    assert got[""] == {0, 5} and all(len(v) == 1 for f, v in got.items() if f)
    assert fingerprints.edited_pairs(empty).count() == 0
    alone = fingerprints.edited_pairs(frame([(1, "abcdef", "s")])).collect()
    assert alone[0].edited == "abcdab"


def test_densification_is_even(spark):
    """Which element an empty bin copies is even over the non-empty bins."""
    rows = spark.createDataFrame([(" ".join(f"{k}x{j}" for j in range(8)),) for k in range(300)], "text string")
    full = rows.select(fingerprints.densified(fingerprints.bin_minima(fingerprints.shingle_hashes(rows.text))).alias("v"))
    low = (1 << fingerprints._TOP) - 1
    for r in full.collect():
        assert len(r.v) == fingerprints.BINS and [x >> fingerprints._TOP for x in r.v] == list(range(fingerprints.BINS))
        counts = [[x & low for x in r.v].count(v) for v in {x & low for x in r.v}]
        assert len(counts) <= 4 and max(counts) < 80


def brute_components(docs, n, num, den):
    sets = [shingles(t, n, True) for _, t in docs]
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(docs)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and den * both >= num * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(docs):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return [(i, len(sets[k]), least.get(find(k))) for k, (i, _) in enumerate(docs)]


def near_copies(seed):
    """Texts with copies, chains of edits, shared passages and a dense group."""
    rng = random.Random(seed)
    word = lambda: f"W{rng.randrange(4000)}"
    passage = [word() for _ in range(60)]
    texts = []
    for _ in range(30):
        base = [word() for _ in range(rng.choice([4, 30, 120, 200]))]
        for _ in range(rng.randrange(1, 8)):
            texts.append(base)
            if rng.random() < 0.6 and len(base) > 20:
                base = [word() if rng.random() < 0.012 else w for w in base]
    base = [word() for _ in range(150)]
    for _ in range(110):  # more than HOT near copies of one text
        texts.append([word() if rng.random() < rng.choice([0, 0.01, 0.03]) else w for w in base])
    for k in range(90):  # more than HOT texts share a passage, some hold little else
        own = [word() for _ in range(rng.choice([2, 10, 100]))]
        texts.append(own[: k % 7] + passage + own[k % 7 :])
    out = [(k, " ".join(t).lower() if k % 3 else " ".join(t)) for k, t in enumerate(texts)]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("n,num,hot", [(3, 90, 5), (5, 80, 64)])
def test_join_equals_brute_force(frame, monkeypatch, n, num, hot):
    monkeypatch.setattr(jaccard_join, "HOT", hot)
    monkeypatch.setattr(jaccard_join, "TILE", 16)
    docs = [*near_copies(n + hot), (None, "alone without an id"), (900, None), (901, ""), (902, " \n")]
    got = sorted(rows_of(jaccard_join.linked(frame([(i, t, "s") for i, t in docs]), n, num, 100)), key=str)
    assert got == sorted(brute_components(docs, n, num, 100), key=str)


def test_join_on_odd_rows(odd, empty, frame):
    got = rows_of(jaccard_join.linked(odd, 3, 90, 100))
    assert sorted(r for r in got if r[0] in (1, 10)) == [(1, 11, 1), (10, 11, 1)]
    assert (2, 0, 2) in got and got.count((5, 1, 5)) == 2 and (5, 4, 5) in got and len(got) == odd.count()
    kept = jaccard_join.one_of_each(odd, 5, 80, 100)
    assert kept.columns == odd.columns
    want = {(r.doc_id, r.text) for r in odd.collect() if r.doc_id != 10}  # copies of 1 and of 5 go
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(want, key=str)
    assert jaccard_join.linked(empty, 3, 90, 100).count() == 0
    assert jaccard_join.one_of_each(empty, 3, 90, 100).count() == 0


def test_one_of_each_goes_by_component_not_by_id(frame):
    text = lambda w: " ".join(f"{w}{k}" for k in range(40))
    rows = [(None, text(w), "s") for w in "abcdef"] + [(None, text("a"), "s"), (None, text("a") + " end", "s")]
    rows += [(7, text("p"), "s"), (7, text("q"), "s"), (7, text("q"), "s"), (3, text("p") + " end", "s")]
    rows += [(9, text("f") + " end", "s"), (None, None, "s"), (None, "", "s"), (4, " \n", "s")]
    kept = [(r.doc_id, r.text) for r in jaccard_join.one_of_each(frame(rows), 5, 80, 100).collect()]
    fixed = [*((None, text(w)) for w in "bcde"), (7, text("q")), (3, text("p") + " end"), (9, text("f") + " end")]
    fixed += [(None, None), (None, ""), (4, " \n")]
    either = [r for r in kept if r not in fixed]  # of two near copies without an id, one
    assert len(kept) == len(fixed) + 1 and sorted(kept, key=str) == sorted(fixed + either, key=str)
    assert either[0] in ((None, text("a")), (None, text("a") + " end"))


def mixed_rows(frame, docs):
    planned = mixing.schedule(mixing.document_sizes(frame(docs)))
    return planned, rows_of(mixing.mix(planned).groupBy("source").sum("taken"))


def test_mixing_meets_targets(frame):
    rng = random.Random(2)
    docs = [(k, " ".join(["w"] * rng.randrange(0, 40)), "abcd"[min(k % 9, 3)]) for k in range(400)] + [(999, "x y z", None)]
    planned, taken = mixed_rows(frame, docs)
    target = {r.source: (r.target, r.source_size) for r in planned.collect()}
    total = sum(len((t or "").split()) for _, t, _ in docs)
    assert abs(sum(t for t, _ in target.values()) - total) < 1e-6
    for source, words in taken:
        assert abs(words - target[source][0]) <= 1 and target[source][0] <= 3 * target[source][1]
    free = {s: t for s, (t, n) in target.items() if t < 3 * n}
    weight = {"a": 1, "b": 2, "c": 3, "d": 1, None: 2}
    assert len({round(t / weight[s], 6) for s, t in free.items()}) == 1 and target[None][0] == 9
    order = [r.virtual_finish for r in mixing.mix(planned).collect()]
    assert order == sorted(order)


def test_mixing_equals_sql(spark, tmp_path):
    source = "/root/testdata/sf0.001"
    docs = duckdb.sql(f"SELECT doc_id, text, source FROM '{source}/documents.parquet'").df()
    docs.loc[docs.doc_id % 3 == 0, "source"] = "src0"  # a third of all rows
    docs.loc[docs.doc_id % 17 == 1, "source"] = None
    docs.to_parquet(tmp_path / "documents.parquet")
    got = mixing.op4_mixing(spark, str(tmp_path)).toPandas().sort_values("doc_id").reset_index(drop=True)
    con = duckdb.connect()
    con.register("documents", docs)
    want = con.sql(mixing.OP4_SQL).df().sort_values("doc_id").reset_index(drop=True)[list(got.columns)]
    assert (got == want).all().all()


def test_mixed_documents(odd, empty, frame):
    out = mixing.mixed_documents(odd)
    assert out.columns == odd.columns
    planned = mixing.schedule(mixing.document_sizes(odd))
    words = sum(len(WORD.findall(r.text)) for r in out.collect())
    assert words == mixing.mix(planned).groupBy().sum("taken").first()[0]
    assert all(r.n_chars == len(r.text) for r in out.collect())
    assert mixing.mixed_documents(empty).count() == 0
    blank = frame([(1, "", "a"), (2, None, None)])
    assert mixing.mixed_documents(blank).count() == 0
    assert {r.target for r in mixing.schedule(mixing.document_sizes(blank)).collect()} == {0.0}


def test_pipeline_stages(spark):
    sf_dir = "/root/testdata/sf0.001"
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs = rows = table
    for name, stage in corpus_pipeline.STAGES[:4]:
        rows = corpus_pipeline.written(stage(spark, docs, sf_dir), name)
        assert rows.columns == table.columns
        if name == "near_duplicates":
            pairs = [(r.doc_id, r.text) for r in docs.collect()]
            keep = {i for i, _, c in brute_components(pairs, 5, 80, 100) if i == c}
            assert {r.doc_id for r in rows.collect()} == keep
        if name == "pii":
            assert {r.doc_id for r in rows.collect()} == {r.doc_id for r in docs.collect()}
            assert not any("@" in r.text for r in rows.where("text like '%@%.com%'").collect())
        docs = rows
    packed = corpus_pipeline.STAGES[4][1](spark, docs, sf_dir).collect()
    coder = tokenizers.Tokenizer.from_file(corpus_pipeline.default_path())
    coder.encode_special_tokens = True
    ids = [(r.doc_id, [*coder.encode(r.text, add_special_tokens=False).ids, 0]) for r in docs.collect()]
    assert Counter((r.doc_id, r.doc_tokens) for r in packed if r.start == 0) == Counter((i, len(x)) for i, x in ids)
    assert sum(r.length for r in packed) == sum(len(x) for _, x in ids)
    crc = lambda x, r: zlib.crc32(np.array(x[r.start : r.start + r.length], "<u4").tobytes())
    assert all(any(crc(x, r) == r.ids_crc32 for i, x in ids if i == r.doc_id and len(x) == r.doc_tokens) for r in packed)
    places = defaultdict(list)
    for r in packed:
        places[r.sequence_id].append((r.offset, r.length))
    for parts in places.values():
        ends = list(accumulate(n for _, n in sorted(parts)))
        assert [o for o, _ in sorted(parts)] == [0, *ends[:-1]] and ends[-1] <= 1024


def test_small_batches_only_lower(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    usual = spark.conf.get(key)
    try:
        for before, after in (("10000", "1000"), ("200", "200"), ("0", "1000")):
            spark.conf.set(key, before)
            small_batches(spark, 1000)
            assert spark.conf.get(key) == after
    finally:
        spark.conf.set(key, usual)
