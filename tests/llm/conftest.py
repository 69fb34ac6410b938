import pytest

#: Names that operators use inside, as further columns of the inputs.
CLASHES = ["idx", "k", "n", "cid", "size", "start", "token", "score", "shard", "label", "key", "prefix", "taken", "bits"]


@pytest.fixture(scope="session")
def frame(spark):
    """documents rows (doc_id, text, source) with all columns of the table and clashing ones."""

    def make(rows):
        fields = "doc_id long, text string, lang string, source string, n_chars long, "
        fields += ", ".join(f"{c} int" for c in CLASHES)
        data = [(i, t, None, s, None if t is None else len(t), *([7] * len(CLASHES))) for i, t, s in rows]
        return spark.createDataFrame(data, fields).repartition(3)

    return make


LONG = " ".join(f"w{k % 997}x{k % 13}" for k in range(60_000))
ODD = [
    (1, "The quick brown fox jumps over the lazy dog near the old mill.", "a"),
    (2, None, "a"),
    (3, "", None),
    (4, "  \n\t ", ""),
    (5, "one", "b"),
    (5, "one", "b"),
    (5, "another text of the same id", "b"),
    (None, "a row without an id but with text", "c"),
    (None, None, None),
    (8, "Ünïcödé ✓ 漢字 \U0001f600 emoji text with é and ß", "é"),
    (9, LONG, "a"),
    (10, "The quick brown fox jumps over the lazy dog near the old mill.", None),
]


@pytest.fixture
def odd(frame):
    return frame(ODD)


@pytest.fixture
def empty(frame):
    return frame([])
