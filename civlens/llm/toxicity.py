"""Toxicity: subsequence string-kernel SVM with Nyström landmarks, trained on labelled sentences.

Kernel: two words are as alike as the gap-weighted subsequences of three characters that they share;
each character inside a gap multiplies the weight by DECAY, up to two of them, so ``idiot``,
``idixot`` and ``i-d-i-o-t`` stay close. Sentences are bags of words: a sentence scores as its
highest word, and a document by the TOP highest scores in it and its number of distinct words, as a
long clean text has more chances of one high word. Spaced-out letters count as one word.

Training, from a bounded sample of labelled documents (``MAX_TOXIC`` and ``MAX_CLEAN`` by the order
of a hash of the id):
1. each sentence takes its document's label; Spark counts words by label over distinct sentences, so
   that copies of a document weigh no more than it;
2. witnesses, words seen almost only in toxic sentences and too often for chance, are the positives
   (every word of a clean sentence is clean, a toxic sentence has a toxic word at least); the most
   frequent and some hashed other words of clean sentences are the negatives; both lists are bounded;
   variants of the strongest witnesses with a character put in join the positives;
3. landmarks are chosen among both, farthest first; a squared-hinge SVM is fitted on their Nyström
   features; the highest-scoring words of clean sentences join the negatives and it is fitted again;
4. a logistic regression maps the documents' measures to 0..1.
The model is one weight for each of 2^18 three-character features: the landmarks' expansion summed.

Null or empty text: the score of no words (the lowest). Null doc_id: scored, held_out false. Repeated
label rows of a document: toxic if any says so; null labels are no labels. Labels of one class only,
or none: every document scores 0. Repeated documents: equal scores. Empty table: no rows. Extra
columns are ignored (scored) or kept (without_toxic).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from heapq import nlargest

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civlens.llm.common import written

MAX_TOXIC, MAX_CLEAN = 2000, 4000
#: Bounds of what the driver collects: words of each kind, landmarks.
MAX_WITNESSES, MAX_FREQUENT, MAX_OTHERS, MAX_HARD, MAX_VARIED, LANDMARKS = 600, 3000, 6000, 2000, 60, 192
#: A witness's sentences, their evidence (G2), and the toxic share of them at least.
MIN_SENTENCES, MIN_G2, MIN_PURITY = 4, 30.0, 0.9
DECAY = 0.6
TOP, FEW = 3, 20
THRESHOLD = 0.3
WORD_CHARS = 40  # a longer word is scored in overlapping windows of this length
CACHE_WORDS = 300_000
#: Words whose subsequences are held at a time.
PART_WORDS = 8_000

_SENTENCE = re.compile(r"[.!?\n]+")
#: Three or more single characters in a row, parted by single spaces.
_SPACED = re.compile(r"(?<!\S)\S(?: \S){2,}(?!\S)")
#: Offsets of the second and third character of a subsequence: at most two characters in gaps.
_OFFSETS = [(1, 2), (1, 3), (2, 3), (1, 4), (2, 4), (3, 4)]
_FIRST, _LAST = 27, 28


def _codes() -> np.ndarray:
    """Six-bit character codes of the basic plane: letters, digits, word edges, and other letters
    by remainder; 0 for what is skipped inside a word."""
    table = np.zeros(1 << 16, np.int32)
    for k in range(1 << 16):
        c = chr(k)
        if "a" <= c <= "z":
            table[k] = k - 96
        elif "0" <= c <= "9":
            table[k] = 29 + k - 48
        elif c.isalnum():
            table[k] = 39 + k % 25
    return table


_TABLE: np.ndarray | None = None


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(part, feature, normalised weight) of all subsequences, and the word of each part."""
    global _TABLE
    if _TABLE is None:
        _TABLE = _codes()
    # longer words: overlapping windows, all of the same word number
    parts, owner = [], []
    for k, w in enumerate(words):
        for a in range(0, max(1, len(w) - WORD_CHARS // 2), WORD_CHARS // 2) if len(w) > WORD_CHARS else (0,):
            parts.append(w[a : a + WORD_CHARS])
            owner.append(k)
    points = np.frombuffer(("\x00".join(parts) + "\x00").encode("utf-32-le", "surrogatepass"), np.uint32)
    part = np.cumsum(points == 0) - (points == 0)
    code = np.where(points < 1 << 16, _TABLE[np.minimum(points, (1 << 16) - 1)], 39 + points % 25)
    keep = (code > 0) & (points != 0)
    lens = np.bincount(part[keep], minlength=len(parts)) + 2
    ends = np.cumsum(lens)
    line = np.empty(int(ends[-1]) if len(ends) else 0, np.int64)
    line[ends - lens], line[ends - 1] = _FIRST, _LAST
    inner = np.ones(len(line), bool)
    inner[ends - lens] = inner[ends - 1] = False
    line[inner] = code[keep]
    last = np.repeat(ends, lens)
    place = np.arange(len(line))
    rows, keys, weights = [], [], []
    number = np.repeat(np.arange(len(parts)), lens)
    for j, k in _OFFSETS:
        at = np.flatnonzero(place + k < last)
        keys.append((line[at] << 12) | (line[at + j] << 6) | line[at + k])
        rows.append(number[at])
        weights.append(np.full(len(at), DECAY ** (k - 2)))
    rows, keys, weights = map(np.concatenate, (rows, keys, weights))
    # scaled by the root of the squared weights, so that long words gain nothing
    norm = np.sqrt(np.bincount(rows, weights**2, len(parts)))
    return rows, keys, weights / np.maximum(norm, 1e-9)[rows], np.array(owner)


def word_scores(words: list[str], weights: np.ndarray, bias: float) -> np.ndarray:
    if not words:
        return np.empty(0)
    rows, keys, values, owner = features(words)
    parts = np.bincount(rows, values * weights[keys], len(owner)) + bias
    out = np.full(len(words), -np.inf)
    np.maximum.at(out, owner, parts)
    return out


def words_of(text: str) -> set[str]:
    low = text.lower()
    out = set(low.split())
    out.update(m[0].replace(" ", "") for m in _SPACED.finditer(low))
    return out


class Bag:
    """Sparse features of a bounded word list (each word short enough to be one part)."""

    def __init__(self, words: list[str]):
        self.words = [w[:WORD_CHARS] for w in words]
        self.rows, self.keys, self.values, _ = features(self.words)
        # one row a word and feature
        pair, at = np.unique((self.rows << 18) | self.keys, return_inverse=True)
        self.values = np.bincount(at, self.values, len(pair))
        self.rows, self.keys = pair >> 18, pair & ((1 << 18) - 1)
        self.first = np.searchsorted(self.rows, np.arange(len(words) + 1))
        self.square = np.bincount(self.rows, self.values**2, len(words))

    def dense(self, k: int) -> np.ndarray:
        out = np.zeros(1 << 18)
        a, b = self.first[k], self.first[k + 1]
        out[self.keys[a:b]] = self.values[a:b]
        return out

    def dot(self, vector: np.ndarray) -> np.ndarray:
        return np.bincount(self.rows, self.values * vector[self.keys], len(self.words))


def landmarks(bag: Bag, of: np.ndarray, count: int) -> list[int]:
    """Farthest-first choice among the words numbered ``of``, from the first of them."""
    chosen, far = [int(of[0])], np.full(len(of), np.inf)
    while len(chosen) < min(count, len(of)):
        k = chosen[-1]
        far = np.minimum(far, bag.square[of] + bag.square[k] - 2 * bag.dot(bag.dense(k))[of])
        far[of == k] = -1
        chosen.append(int(of[far.argmax()]))
    return chosen


def _svm(z: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float = 10.0) -> np.ndarray:
    """Squared-hinge linear SVM by Newton steps; the last coefficient is the bias."""
    z = np.hstack([z, np.ones((len(z), 1))])
    ridge = np.diag([1.0] * (z.shape[1] - 1) + [1e-3])
    w = np.zeros(z.shape[1])
    for _ in range(50):
        active = y * (z @ w) < 1
        za, ca = z[active], c * weight[active]
        new = np.linalg.solve(ridge + (za.T * ca) @ za, (za.T * ca) @ y[active])
        if np.abs(new - w).max() < 1e-8:
            return new
        w = new
    return w


def variants(words: list[str]) -> list[str]:
    """Each word with one more character at each inner place; which one varies by place and word."""
    out = []
    for n, w in enumerate(words):
        if 5 <= len(w) <= 16 and w.isalnum():
            out += [f"{w[:k]}{chr(97 + (7 * n + 11 * k) % 26)}{w[k:]}" for k in range(1, len(w))]
    return out


def fit_words(positive: list[str], negative: list[str]) -> tuple[np.ndarray, float]:
    """Weights of the three-character features, and the bias."""
    bag, p = Bag(positive + negative), len(positive)
    n = len(bag.words)
    y = np.where(np.arange(n) < p, 1.0, -1.0)
    weight = np.where(y > 0, 0.5 * n / p, 0.5 * n / (n - p))
    places = landmarks(bag, np.arange(p), LANDMARKS // 2)
    places += landmarks(bag, np.arange(p, n), LANDMARKS - len(places))
    kernel = np.stack([bag.dot(bag.dense(k)) for k in places], axis=1)
    value, vector = np.linalg.eigh(kernel[places])
    keep = value > 1e-6 * value[-1]
    root = vector[:, keep] / np.sqrt(value[keep])  # K^-1/2 on its range
    solved = _svm(kernel @ root, y, weight)
    weights = np.zeros(1 << 18)
    for k, a in zip(places, root @ solved[:-1], strict=True):
        weights += a * bag.dense(k)
    return weights.astype(np.float32), float(solved[-1])


def _logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Logistic regression with Platt's smoothed targets, by damped Newton steps; n: rows' counts."""
    pos, neg = n[y > 0].sum(), n[y <= 0].sum()
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    x = np.c_[x, np.ones(len(x))]
    a, ridge = np.zeros(x.shape[1]), np.eye(x.shape[1]) * 0.1

    def loss(a):
        return n @ np.logaddexp(0, x @ a) - (n * t) @ (x @ a) + a @ ridge @ a / 2

    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ a, -500, 500)))
        step = np.linalg.solve((x.T * (n * p * (1 - p))) @ x + ridge, x.T @ (n * (t - p)) - ridge @ a)
        size = 1.0
        while size > 1e-6 and loss(a + size * step) > loss(a):
            size /= 2
        if np.abs(size * step).max() < 1e-9:
            break
        a = a + size * step
    return a


class Model:
    """Fixed size: 2^18 weights, bias, coefficients. weights None: no two classes were seen."""

    def __init__(self, weights, bias=0.0, coefficients=None):
        self.weights, self.bias, self.coefficients = weights, bias, coefficients

    def measures(self, texts: list[str], cache: dict[str, float]) -> np.ndarray:
        """The TOP highest word scores, between -1 and 1.5 (-1 where there are fewer words), and the
        logarithm of the number of distinct words, FEW at least."""
        bags = [words_of(t) for t in texts]
        if len(cache) > CACHE_WORDS:
            cache.clear()
        new = list(set().union(*bags) - cache.keys()) if bags else []
        for a in range(0, len(new), PART_WORDS):
            part = new[a : a + PART_WORDS]
            cache.update(zip(part, word_scores(part, self.weights, self.bias).tolist(), strict=True))
        out = np.full((len(texts), TOP + 1), -1.0)
        for k, bag in enumerate(bags):
            top = nlargest(TOP, map(cache.__getitem__, bag))
            out[k, : len(top)] = top
            out[k, TOP] = np.log(max(len(bag), FEW))
        out[:, :TOP] = np.clip(out[:, :TOP], -1, 1.5)
        return out

    def scores(self, measures: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(measures @ self.coefficients[:-1] + self.coefficients[-1], -500, 500)))


def _batches(texts: list[str], chars: int = 1_000_000):
    at, size = 0, 0
    for k, t in enumerate(texts):
        size += len(t)
        if size >= chars:
            yield at, k + 1
            at, size = k + 1, 0
    if at < len(texts):
        yield at, len(texts)


def held_out():
    """The rows that no label is learnt from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def sampled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, toxic) of at most MAX_TOXIC + MAX_CLEAN labelled documents outside the held-out part."""
    known = labels.where("toxic is not null and doc_id is not null").where(~held_out())
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).withColumn("h", F.xxhash64("doc_id"))
    # only documents that have a text here count towards the bound
    known = known.join(docs.where("text is not null").select("doc_id").distinct(), "doc_id")
    picked = None
    for toxic, most in ((1, MAX_TOXIC), (0, MAX_CLEAN)):
        part = known.where(F.col("toxic") == toxic).orderBy("h", "doc_id").limit(most).select("doc_id", "toxic")
        picked = part if picked is None else picked.unionByName(part)
    # at most MAX_TOXIC + MAX_CLEAN rows of two numbers
    return docs.where("text is not null").select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("text", "toxic")


def train(docs: DataFrame, labels: DataFrame) -> Model:
    sample = written(sampled(docs, labels), "tox-sample")

    def sentences(batches):
        for pdf in batches:
            for text, toxic in zip(pdf["text"], pdf["toxic"], strict=True):
                own = list({x.strip() for x in _SENTENCE.split(text)} - {""})
                if own:
                    yield pd.DataFrame({"sentence": own, "toxic": toxic})

    def count(batches):
        for pdf in batches:
            rows = {}
            for sentence, toxic in zip(pdf["sentence"], pdf["toxic"], strict=True):
                for w in words_of(sentence):
                    rows.setdefault(w, [0, 0])[toxic] += 1
            if rows:
                yield pd.DataFrame([(w, *n) for w, n in rows.items()], columns=["word", "clean", "toxic"])

    bags = sample.repartition(F.xxhash64("text")).mapInPandas(sentences, "sentence string, toxic int").distinct()
    counts = bags.mapInPandas(count, "word string, clean long, toxic long")
    counts = written(counts.groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")), "tox-words")
    clean, toxic = counts.agg(F.sum("clean"), F.sum("toxic")).first()
    if not clean or not toxic:
        return Model(None)
    # G2 of a word's counts against the labels' shares
    n, share = F.col("clean") + F.col("toxic"), toxic / (toxic + clean)
    term = lambda k, e: F.when(k > 0, k * F.log(k / e)).otherwise(0.0)
    g2 = 2 * (term(F.col("toxic"), n * share) + term(F.col("clean"), n * (1 - share)))
    pure = (F.col("toxic") > n * share) & (F.col("toxic") >= MIN_PURITY * n)
    told = counts.where((n >= MIN_SENTENCES) & pure).withColumn("g2", g2)
    told = told.where(F.col("g2") >= MIN_G2).orderBy(F.desc("g2"), "word").limit(MAX_WITNESSES)
    positive = [r["word"] for r in told.select("word").collect()]
    if not positive:
        return Model(None)
    seen = set(positive)
    positive += [w for w in variants(positive[:MAX_VARIED]) if w not in seen]
    usual = counts.where("clean > 0").withColumn("h", F.xxhash64("word"))
    usual = usual.join(F.broadcast(told.select("word")), "word", "left_anti")
    frequent = usual.orderBy(F.desc("clean"), "word").limit(MAX_FREQUENT).select("word").collect()
    others = usual.orderBy("h", "word").limit(MAX_OTHERS).select("word").collect()
    negative = list(dict.fromkeys(r["word"] for r in [*frequent, *others]))
    if not negative:
        return Model(None)
    spark = docs.sparkSession
    for _ in range(2):
        weights, bias = fit_words(positive, negative)
        model = spark.sparkContext.broadcast(Model(weights, bias))

        def score(batches, model=model):
            for pdf in batches:
                yield pdf.assign(f=word_scores(pdf["word"].tolist(), model.value.weights, model.value.bias))

        hard = usual.select("word").mapInPandas(score, "word string, f double").where("f > -1")
        found = hard.orderBy(F.desc("f"), "word").limit(MAX_HARD).select("word").collect()
        negative = list(dict.fromkeys([*negative, *(r["word"] for r in found)]))
    weights, bias = fit_words(positive, negative)
    model = spark.sparkContext.broadcast(Model(weights, bias))

    names = [f"m{k}" for k in range(TOP + 1)]

    def measure(batches):
        cache: dict[str, float] = {}
        for pdf in batches:
            texts = pdf["text"].tolist()
            for a, b in _batches(texts):
                rows = pd.DataFrame(model.value.measures(texts[a:b], cache), columns=names)
                yield rows.assign(toxic=pdf["toxic"].to_numpy()[a:b])

    rows = sample.mapInPandas(measure, "".join(f"{c} double, " for c in names) + "toxic int")
    # at most MAX_TOXIC + MAX_CLEAN rows of numbers: repeated documents are counted first
    rows = np.array(rows.groupBy(*names, "toxic").count().orderBy(*names, "toxic").collect(), float)
    return Model(weights, bias, _logistic(rows[:, : TOP + 1], rows[:, TOP + 1], rows[:, TOP + 2]))


def score_of(model: Model, text, spark):
    """Column: the score of a text."""
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        cache: dict[str, float] = {}
        for series in batches:
            texts, m = [t or "" for t in series], shared.value
            if m.weights is None:
                yield pd.Series(np.zeros(len(texts)))
                continue
            parts = [m.scores(m.measures(texts[a:b], cache)) for a, b in _batches(texts)]
            yield pd.Series(np.concatenate(parts) if parts else np.empty(0))

    return F.pandas_udf(run, "double")(text)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, predicted) of every document."""
    out = docs.select("doc_id", score_of(model, F.col("text"), docs.sparkSession).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not predicted toxic, with their columns."""
    return docs.where(score_of(train(docs, labels), F.col("text"), docs.sparkSession) < THRESHOLD)


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows = scored(docs, model)
    return rows.select("doc_id", held_out().alias("held_out"), "score", "predicted")
