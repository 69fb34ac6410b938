"""Byte-level BPE against the tiktoken library, and round trips."""

import random
from hashlib import sha256

import numpy as np
import pytest
import tiktoken

from civlens.llm import bpe

PATH = bpe.default_ranks()


@pytest.fixture(scope="module")
def coder():
    return bpe.encoder(PATH)


@pytest.fixture(scope="module")
def library(coder):
    import public_tokenizers

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=coder.ranks.rank, special_tokens={})


def test_random_texts_equal_the_library(coder, library):
    rng = random.Random(1)
    letters = [*"abst'mdrevl  \n\t .,!?019'", "é", "漢", "字", " ", "　", "́", "½", "٣", "😀", "\x1c", "​",
               "'s", "'re", "  ", "'ll've", "ᲊ", "𞗰", "\r\n", "<|endoftext|>"]
    for _ in range(400):
        texts = ["".join(rng.choices(letters, k=rng.randint(0, 80))) for _ in range(20)]
        ids, counts = coder.encode(texts)
        assert [a.tolist() for a in np.split(ids, np.cumsum(counts)[:-1])] == [library.encode_ordinary(t) for t in texts]


@pytest.mark.parametrize("text", ["a" * 5000, "é" * 999, " " * 3000 + "x", "ab" * 4000 + "'s", "\n" * 50, "漢字" * 700, "'" * 99, "x'll" * 300])
def test_long_runs(coder, library, text):
    assert coder.encode([text])[0].tolist() == library.encode_ordinary(text)


def test_forgetting_pieces_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(bpe, "GENERATION", 20)
    own, rng = bpe.Encoder(PATH), random.Random(2)
    for _ in range(60):
        text = " ".join(f"w{rng.randint(0, 90)}y{rng.choice('abc')}" for _ in range(40))
        assert own.encode([text])[0].tolist() == library.encode_ordinary(text)


def test_scan_equals_stepping(coder):
    rng = np.random.default_rng(3)
    for n in (1, 63, 64, 65, 1000, 4097):
        symbols = rng.integers(0, 16, n).astype(np.uint8)
        symbols[0] |= 8
        state, want = bpe.BEGIN, []
        for s in symbols.tolist():
            state, begins = bpe.step(bpe.BEGIN if s >= 8 else state, s % 8)
            want.append(begins)
        assert coder.automaton.starts(symbols).tolist() == want


def test_odd_rows(odd, library):
    rows = bpe.decoded(bpe.encoded(odd, PATH), PATH).collect()
    at_once = bpe.encoded(odd, PATH, decode=True)
    assert at_once.columns == [*odd.columns, "token_ids", "token_offsets", "decoded"]
    assert sorted(map(str, at_once.collect())) == sorted(map(str, rows))
    assert len(rows) == odd.count() and {"idx", "token", "size", "source"} <= set(rows[0].asDict())
    for r in rows:
        text = r.text or ""
        want = library.encode_ordinary(text)
        assert r.token_ids == want and bytes(r.decoded) == text.encode()
        sizes = [len(library.decode_single_token_bytes(i)) for i in want]
        assert r.token_offsets == [sum(sizes[:k]) for k in range(len(want))] if len(want) < 500 else True


def test_empty_table(empty):
    assert bpe.decoded(bpe.encoded(empty, PATH), PATH).collect() == []


def test_query_equals_the_library(spark, library):
    d = "/root/testdata/sf0.01"
    texts = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()
    want = set()
    for r in texts:
        ids = library.encode_ordinary(r.text or "")
        want.add((r.doc_id, len(ids), sha256(",".join(map(str, ids)).encode()).hexdigest(), sha256((r.text or "").encode()).hexdigest()))
    got = [tuple(r) for r in bpe.op13_bpe(spark, d).collect()]
    assert len(got) == len(texts) and set(got) == want
