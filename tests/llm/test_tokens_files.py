"""Token ids, Simple-8b files, packing and WARC."""

import gzip
import io
import random
import zlib
from collections import Counter
from string import ascii_letters

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from civlens.llm import packing, simple8b, tokens, warc
from civlens.llm.common import scratch

PATH = tokens.default_path()
BITS = [" ", "  ", "\n", "\t", " \n ", ".", ",", "a", "bc", "Zed", "é", "ß", "1", "½", "'s", "'", "!", "　", "\xa0",
        " ", "“", "—", "\x85", "\x1f", " ", "<|endoftext|>", "漢", "_", "-", "\U0001f600"]


def ids_of(text, end):
    return Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids + [end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("segment", [1 << 20, 7])
def test_ids_equal_whole_text_encoding(monkeypatch, segment):
    monkeypatch.setattr(tokens, "SEGMENT_CHARS", segment)
    rng, whole = random.Random(3), Tokenizer.from_file(PATH)
    texts = ["", " ", "  a", "a  b", "it's. x², y³;", "foo.. bar!? baz,, . , ;", "x" * 700 + " y", "\n\nq"]
    texts += ["".join(rng.choices(BITS, k=30)) for _ in range(1500)]
    flat, ends = tokens.PieceTokenizer(PATH).encode(texts)
    begin = 0
    for text, end in zip(texts, ends, strict=True):
        assert flat[begin:end].tolist() == whole.encode(text, add_special_tokens=False).ids, repr(text)
        begin = end


def test_words_are_learnt_once_whatever_mark_follows():
    words, marks = [f"Wo{'xyz'[k % 3] * (k // 3 + 1)}ß{'e' * (k % 2)}" for k in range(30)], [".", ",", ",###", "***", "'", "|", "<|"]
    texts = [" ".join(["to", *(w + m for w in words)]) for m in marks]
    tok, whole = tokens.PieceTokenizer(PATH), Tokenizer.from_file(PATH)
    flat, ends = tok.encode(texts)
    assert [x.tolist() for x in np.split(flat, ends)[:-1]] == [whole.encode(t, add_special_tokens=False).ids for t in texts]
    # a vertical bar may belong to a special token and stays with its word
    assert len(tok.code) <= 1 + 2 * len(words) + len(marks)


def test_cache_may_be_cleared_between_batches(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_PIECES", 3)
    tok, texts = tokens.PieceTokenizer(PATH), [f"alpha{k} beta, gamma" for k in range(40)]
    first = tok.encode(texts)[0]
    assert first.tolist() == tok.encode(texts)[0].tolist()


@pytest.mark.parametrize("n", [0, 1, 59, 60, 61, 1023, 1024, 1025, 4000])
@pytest.mark.parametrize("high", [1, 2, 300, 50257, 2**20, 2**32 - 1])
def test_simple8b_round_trip(n, high):
    ids = np.random.default_rng(n).integers(0, high, n, dtype=np.uint64)
    words, first = simple8b.encode(ids)
    if n:
        assert (simple8b.decode(words, first, n) == ids).all()
        assert len(words) <= n


def test_simple8b_reader_takes_any_range():
    sink, kept = io.BytesIO(), []
    sink.close = lambda: None
    writer, rng = simple8b.Writer(sink), np.random.default_rng(1)
    for k in range(300):
        ids = rng.integers(0, 2**32 if k % 50 == 0 else 60000, rng.integers(0, 90)).astype(np.uint32)
        kept.append(ids)
        writer.add(None if k == 3 else k, ids)
    told = writer.close()

    class Source(io.BytesIO):
        def size(self):
            return len(self.getbuffer())

    reader, flat = simple8b.Reader(Source(sink.getvalue())), np.concatenate(kept)
    assert told["n_ids"] == len(flat) and reader.n_docs == 300
    for a, b in [(0, len(flat)), (5, 5), (1000, 1100), (len(flat) - 3, len(flat)), (1023, 1025)]:
        assert reader.ids(a, b).tolist() == flat[a:b].tolist()
    assert reader.docs(2, 5)["null"].tolist() == [0, 1, 0]
    with pytest.raises(ValueError, match="token file"):
        simple8b.Reader(Source(sink.getvalue()[:-1]))


def test_op5_on_odd_rows(spark, odd, empty):
    manifest = simple8b.write_tokens(odd, scratch(spark, "t"), PATH)
    got = sorted(map(tuple, simple8b.read_tokens(manifest).collect()), key=lambda r: r[1])
    rows = [(r.doc_id, ids_of(r.text, 2)) for r in odd.collect()]
    assert sorted((r[0] or -1, r[2], r[3]) for r in got) == sorted((i or -1, len(x), crc(x)) for i, x in rows)
    assert [r[1] for r in got] == np.cumsum([0, *(r[2] for r in got)])[:-1].tolist()
    known = [r[0] for r in got if r[0] is not None]
    assert known == sorted(known) and [r[0] for r in got[:2]] == [None, None]
    assert simple8b.read_tokens(simple8b.write_tokens(empty, scratch(spark, "t"), PATH)).count() == 0


def check_packing(rows, texts, window):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for own in by_sequence.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == np.cumsum([0, *(r.length for r in own)])[:-1].tolist()
        n = sum(r.length for r in own)
        assert n <= window and n & (n - 1) == 0  # no padding at all
    pieces = sorted((r.doc_id or -1, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows)
    for doc_id, texts_of in texts.items():
        for text in texts_of:
            ids = ids_of(text, 0)
            own = [p for p in pieces if p[0] == (doc_id or -1) and p[4] == len(ids)]
            assert all(crc(ids[s : s + n]) == c for _, s, n, c, _ in own) or len(texts_of) > 1
    assert sum(r.length for r in rows) == sum(len(ids_of(t, 0)) for ts in texts.values() for t in ts)


@pytest.mark.parametrize("window,shard", [(64, 400), (1024, 4 << 20)])
def test_packing_odd_rows(spark, odd, empty, window, shard):
    texts = {}
    for r in odd.collect():
        texts.setdefault(r.doc_id, []).append(r.text)
    got = packing.pack(odd, PATH, window, 0, shard)
    check_packing(got.collect(), texts, window)
    assert sorted(got.collect(), key=str) == sorted(packing.pack(odd.repartition(1), PATH, window, 0, shard).collect(), key=str)
    assert packing.pack(empty, PATH).count() == 0


def flat_index(docs, corpus=None):
    return packing.Index(np.concatenate(docs), np.array([len(d) for d in docs]), corpus)


def test_packing_puts_lexical_neighbours_together():
    topics = [[f"{t}word{k}" for k in range(30)] for t in ("sun", "sea", "ice")]
    codes = {w: k for k, w in enumerate(w for t in topics for w in t)}
    rng = random.Random(1)
    docs = [np.array([codes[w] for w in rng.choices(topics[k % 3], k=20)]) for k in range(30)]
    index = flat_index(docs)
    near = index.neighbours(0, np.array([False] + [True] * 29))
    assert set(near[:9] % 3) == {0}
    order = packing.order_documents(index, np.full(30, 100), 1000)
    assert sorted(order) == list(range(30)) and len({k % 3 for k in order[:10]}) == 1


def test_packing_scores_equal_naive_bm25():
    rng = random.Random(3)
    texts = [" ".join(rng.choices([f"w{int(rng.paretovariate(0.7))}" for _ in range(400)], k=rng.randrange(90))) for _ in range(200)]
    docs = [t.split() for t in texts]
    mean = sum(map(len, docs)) / len(docs)
    df = {}
    for d in docs:
        for w in set(d):
            df[w] = df.get(w, 0) + 1
    index = packing.Index(*packing.word_hashes(texts))
    for a in range(0, 200, 7):
        for b in range(200):
            want = 0.0
            for w in set(docs[a]) & set(docs[b]):
                tf = docs[b].count(w)
                norm = packing.K1 * (1 - packing.B + packing.B * len(docs[b]) / mean)
                want += np.log1p((200 - df[w] + 0.5) / (df[w] + 0.5)) * tf * (packing.K1 + 1) / (tf + norm)
            if a != b:
                assert abs(index.scores[a, b] - want) < 1e-3 * max(1, want)


def test_packing_counts_terms_of_whole_input(frame):
    texts = ["a b b", "b c", None, "", "a a", "\x0bd\tb\n"]
    got = packing.term_counts(frame([(k, t, "s") for k, t in enumerate(texts)])).collect()
    names = dict(zip(packing.word_hashes(["a b c d"])[0].tolist(), "abcd", strict=True))
    assert {names[r.term]: (r.df, r.tf) for r in got} == {"a": (2, 3), "b": (3, 4), "c": (1, 1), "d": (1, 1)}


def test_packing_deals_terms_in_few_rows(frame):
    """Counts cross the shuffle in a row for each task and bucket; terms of one document are summed."""
    texts = [f"a b b w{k}" for k in range(500)]
    rows = frame([(k, t, "s") for k, t in enumerate(texts)]).repartition(2)
    names = dict(zip(packing.word_hashes(["a b"])[0].tolist(), "ab", strict=True)) | {-1: ""}
    for bits in (1, 4):
        got = packing.term_counts(rows, bits, single=False).collect()
        assert len(got) <= 2 + (1 << bits)
        assert {names[r.term]: (r.df, r.tf) for r in got if r.term != -1} == {"a": (500, 500), "b": (500, 1000)}
        assert sum(r.tf for r in got if r.term == -1) == 500 and {r.df for r in got if r.term == -1} == {1}


def test_packing_brings_near_copies_together(frame):
    """Near copies of other ids come into one shard or one next to it, among many shards."""
    rng = random.Random(7)
    rows = []
    for k in range(150):
        base = [f"p{k}q{j}" for j in range(20)] + rng.choices([f"c{j}" for j in range(300)], k=60)
        for copy in range(2):
            rows.append((1000 * copy + k, " ".join(w if rng.random() > 0.05 else f"z{rng.random()}" for w in base), "s"))
    rows += [(5000 + k, "the same words in many a text " * 4, "s") for k in range(192)]
    shards = {}
    for r in packing.pack(frame(rows), PATH, 256, 0, 4000).collect():
        shards[r.doc_id] = r.sequence_id >> 28
    assert len(shards) == len(rows) and len(set(shards.values())) > 10
    place = {s: k for k, s in enumerate(sorted(set(shards.values())))}
    apart = [abs(place[shards[k]] - place[shards[1000 + k]]) for k in range(150)]
    assert sum(a == 0 for a in apart) > 110 and sum(a <= 1 for a in apart) > 145


def test_packing_spreads_repeated_rows(frame):
    rows = [(7, "one and the same text of a row that comes often", "s")] * 2000
    got = packing.pack(frame(rows), PATH, 256, 0, 5000).collect()
    shards = {}
    for r in got:
        shards[r.sequence_id >> 28] = shards.get(r.sequence_id >> 28, 0) + r.length
    assert len(shards) > 15 and max(shards.values()) < 3 * sum(shards.values()) / len(shards)


def test_packing_weights_are_of_the_whole_input():
    docs = [np.array([1, 2]), np.array([1, 3]), np.array([2, 3])]
    corpus = packing.Corpus(1000, 2.0, np.array([1, 2, 3]), np.array([900, 2, 2]))
    index = flat_index(docs, corpus)
    # in the shard all terms are in two documents; in the input term 1 is common
    assert index.neighbours(0, np.array([False, True, True])).tolist() == [2, 1]


def test_packing_weighs_rare_terms_by_the_whole_input(frame):
    """Behind more than 2^17 more frequent terms, too: what follows the first document of a shard in its first
    window is the unused document that scores highest by naive BM25 of the whole input."""
    rng, window = random.Random(5), 512
    often = [a + b + c for a in ascii_letters for b in ascii_letters for c in ascii_letters]
    texts = [" ".join(often)] * 7
    for _ in range(1500):
        texts.append(" ".join(rng.choices([f"r{j}" for j in range(5000)], k=12) + rng.choices([f"c{j}" for j in range(8)], k=12)))
    words = [t.split() for t in texts]
    mean = sum(map(len, words)) / len(words)
    df = Counter(w for d in words for w in set(d))
    assert sum(n < 7 for n in df.values()) > 4000 and sum(n >= 7 for n in df.values()) > 1 << 17

    def score(a, b):
        norm = packing.K1 * (1 - packing.B + packing.B * len(words[b]) / mean)
        weight = lambda w, tf: np.log1p((len(texts) - df[w] + 0.5) / (df[w] + 0.5)) * tf * (packing.K1 + 1) / (tf + norm)
        return sum(weight(w, words[b].count(w)) for w in set(words[a]) & set(words[b]))

    shards = {}
    for r in packing.pack(frame([(k, t, "s") for k, t in enumerate(texts)]), PATH, window, 0, 20_000).collect():
        if r.start == 0:
            shards.setdefault(r.sequence_id >> 28, []).append((r.sequence_id, r.offset, r.doc_id))
    checked = 0
    for own in map(sorted, shards.values()):
        seed, unused = own[0][2], [d for *_, d in own[1:]]
        for _, _, d in (x for x in own[1:] if x[0] == own[0][0] and seed > 6):
            best = max(score(seed, b) for b in unused)
            assert abs(score(seed, d) - best) < 1e-3 * best
            unused.remove(d)
            checked += 1
    assert checked > 200


def test_packing_keys_of_documents_of_rare_terms(spark, frame):
    """A document without any common term is told by its most frequent one, which a join finds."""
    texts = [f"the w{k}" for k in range(100)] + ["x y z", "y z", "z", "", None, "p", "y z"]
    rows = frame([(k, t, "s") for k, t in enumerate(texts)]).withColumn("row", F.xxhash64("doc_id", "text"))
    codes = dict(zip(["the", "x", "y", "z", "p"], packing.word_hashes(["the x y z p"])[0], strict=True))
    known = spark.createDataFrame([(int(codes[w]), n) for w, n in (("the", 100), ("y", 3), ("z", 4))], "term long, df long")
    shared = spark.sparkContext.broadcast(packing.Corpus(len(texts), 2.0, np.array([codes["the"]]), np.array([100])))
    keys = packing.with_rare_keys(packing.content_keys(rows, shared), known)
    got = {r.doc_id: (r.key >> 48, r.key & ((1 << 48) - 1), r.row) for r in keys.join(rows.select("doc_id", "row"), "row").collect()}
    marks = {w: int(packing.mixed(np.array([c]))[0] >> np.uint64(49)) for w, c in codes.items()}
    want = ["the"] * 100 + ["z", "z", "z", None, None, "p", "z"]
    assert [got[k][0] for k in range(len(texts))] == [marks[w] if w else 0 for w in want]
    assert all(low == (row % (1 << 64)) >> 16 for _, low, row in got.values())


def test_warc_ranges_own_each_record_once():
    rng, sink, want = random.Random(1), io.BytesIO(), []
    for k in range(120):
        payload = bytes(rng.randrange(256) for _ in range(rng.randrange(200))) + warc.MAGIC * (k % 3)
        sink.write(gzip.compress(warc.record(str(k), "u", payload), 0 if k % 3 == 0 else 6, mtime=0))
        want.append(str(k))
    size = sink.tell()
    for step in (1, 7, 100, 1000, size):
        got = [
            str(warc.parse(d)["page_id"])
            for a in range(0, size, step)
            for d in warc.members(sink, size, a, min(size, a + step))
        ]
        assert got == want


def test_warc_round_trip_odd_rows(spark):
    html = ["<p>same</p>", "<p>same</p>", None, "", "é\U0001f600" * 50, "<p>same</p>", "x" * 300_000]
    rows = [(k, None if k == 4 else f"http://h/{k} a\r\nb", h, 1, 2) for k, h in enumerate(html)]
    rows += [(None, "u", "<p>same</p>", 1, 2), (None, "u", "only null", 1, 2), (9, "v", "twice", 1, 2), (9, "v", "twice", 1, 2)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest int, refers_to int").repartition(3)
    got = warc.read_warc(warc.write_warc(pages, scratch(spark, "t")), split_bytes=500).collect()
    assert len(got) == len(rows)
    payloads = {}
    for page_id, _, h, *_ in rows:
        payloads.setdefault((h or "").encode(), []).append(-1 if page_id is None else page_id)
    want = []
    for payload, ids in payloads.items():
        for i in ids:
            first = i == max(ids)
            kind = ("response", -2) if first else ("revisit", max(ids))
            want.append((i, len(payload), warc.base32_sha1(payload), *kind))
    code = lambda v, none: none if v is None else v
    have = [(code(r.page_id, -1), r.payload_bytes, r.payload_digest, r.record_type, code(r.refers_to, -2)) for r in got]
    assert sorted(have) == sorted(want)
    none = spark.createDataFrame([], pages.schema)
    assert warc.read_warc(warc.write_warc(none, scratch(spark, "t"))).count() == 0
