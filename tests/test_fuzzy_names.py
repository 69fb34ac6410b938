"""The pruned search for the best official name equals scoring every pair."""

import random

import pytest

from civlens.functions import fuzzy
from civlens.operators import fuzzy_correct as FC

WORDS = "affiches graffitis tags autocollants objets abandonnés poubelles trottoir chaussée éclairage arbres bancs voirie panneau eau".split()


def some_names(rng, n):
    return sorted({" ".join(rng.sample(WORDS, rng.randint(1, 4))).capitalize() for _ in range(n)})


def edited(rng, text):
    t = list(text)
    for _ in range(rng.randint(0, 4)):
        i = rng.randrange(len(t))
        t[i : i + 1] = rng.choice([[], [rng.choice("abcdez -é")], [t[i], rng.choice("xy")]])
        t = t or ["a"]
    return "".join(t)


def brute(text, names):
    done = fuzzy.default_process(text)
    return min((-fuzzy.partial_ratio(done, fuzzy.default_process(n)), i) for i, n in enumerate(names))


@pytest.mark.parametrize("seed", range(3))
def test_equal_to_all_pairs_with_a_fifth_of_the_scores(seed):
    rng = random.Random(seed)
    names = some_names(rng, 150)
    of = fuzzy.Names(names)
    texts = [edited(rng, rng.choice(names)) for _ in range(200)] + ["", "?!", "zzz", None]
    scored = 0
    for t in texts:
        score, i, tried = of.best(t)
        assert (-score, i) == brute(t, names)
        scored += tried if t in texts[:200] else 0
    assert scored * 5 < 200 * len(names)


def test_bounds_hold():
    rng = random.Random(9)
    names = ["".join(rng.choices("abc ", k=rng.randint(0, 12))) for _ in range(60)]
    of = fuzzy.Names(names)
    for _ in range(200):
        text = fuzzy.default_process("".join(rng.choices("abcd ", k=rng.randint(0, 14))))
        assert all(b >= fuzzy.partial_ratio(text, n) for b, n in zip(of.bounds(text), of.text, strict=True))


def test_best_names_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(FC, "TEXTS_CHUNK", 30)
    monkeypatch.setattr(FC, "NAMES_CHUNK", 20)
    rng = random.Random(4)
    lists = {c: some_names(rng, 60) for c in "ab"} | {"empty": []}
    texts = {(c, edited(rng, rng.choice(lists["a"]))) for c in "aaab" for _ in range(60)} | {("empty", "x"), ("a", "")}
    official = spark.createDataFrame([(c, n, i) for c, names in lists.items() for i, n in enumerate(names)], "__cat string, __name string, __ord int")
    got = FC.best_names(spark.createDataFrame(sorted(texts), "__cat string, __txt string"), official).collect()
    want = {(c, t, lists[c][i], -s) for c, t in texts if lists[c] for s, i in [brute(t, lists[c])]}
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_registered_query(spark):
    from civlens.plans import catalog

    catalog.load_all()
    d = "/root/testdata/sf0.001"
    got = [tuple(r) for r in catalog.QUERIES["t07_fuzzy_best_name"](spark, d).collect()]
    names = {}
    for r in spark.read.parquet(f"{d}/part.parquet").select("p_type", "p_name").distinct().collect():
        names.setdefault(r.p_type, []).append(r.p_name)
    for cat, text, name, score in got:
        of = sorted(names[cat])
        s, i = brute(text, of)
        assert (name, score) == (of[i], -s)
    assert len(got) > 50 and {s for *_, s in got if s < 70} and {s for *_, s in got if 70 <= s < 100}
