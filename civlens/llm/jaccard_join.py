"""N-gram Jaccard join with adaptive multi-match prefixes.

Documents with the same set of word shingles form a class; classes are joined. All sets are in one
order (by hash). Two sets that are similar enough share at least l elements of their l-prefixes, the
first n - ceil(t n) + l elements. Each class gets its own l:

1. every class sends its longest prefix; Spark counts in how many classes each
   prefix element occurs. Elements of one class only can't match and are dropped;
2. a class takes the l of least estimated cost: the candidates its prefix generates, and their
   checks, of which a longer prefix with more required matches leaves fewer. Elements in more than
   HOT classes generate nothing: with h of them in its l-prefix a class still shares l - h others
   with each partner, and needs l > h;
3. classes with no such l (mostly of passages that very many classes share) are joined among
   themselves by whole sets, rarest elements first, so that a hot element lies in a prefix only where
   a set holds little else; the place of a match bounds the overlap that is still possible. Before
   that, the classes of each hot element are compared with one of them, the one with fewest rarer
   elements, and those found alike are one component, inside which no more pairs are made;
4. candidates are checked on whole sets. Pairs are grouped into tiles of about TILE classes, so that
   a set is sent once a tile and not once a pair.

Links make components (labels spread by minimum and pointer jumping, in written tables). Hot keys:
element counts are pre-aggregated; joins on elements are sort-merge joins that Spark may split.

Shingles, sets and classes are told apart by 64-bit hashes (sets are compared by 48 bits of each
element). Words are runs of other characters than space and tab to carriage return; A-Z become
lower case. Fewer words than a shingle: the whole sequence is the one shingle. Null or empty text,
or no words: an empty set, linked with nothing, its own component. Null doc_id: kept; a component
with any doc_id takes the smallest. Repeated rows: in one class. Empty table: no rows. Extra columns
are ignored (linked) or kept (one_of_each). one_of_each goes by component, never by doc_id: different
texts that share a doc_id, or have none, are told apart by a 64-bit hash of the text.
"""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civlens.llm.common import WORD_PATTERN, release, written
from civlens.llm.tokens import batches, byte_tables

#: The l a class may choose: numbers, and 4 plus a share of its size.
MATCHES, MORE_MATCHES = (1, 2, 4), (24, 12)
HOT = 128
#: Cost of checking a candidate, in generated ones.
CHECK_COST = 4.0
TILE = 64
BITMAP_BITS = 1 << 23
_M1, _M2, _M3 = (np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[str], n: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words: list[list[np.ndarray]] = [[] for _ in texts]
    joins: set[int] = set()
    for owner, parts in batches(texts):  # long texts come in parts that are cut at a space
        raw = [p.encode() for p in parts]
        data = _LOWER[np.frombuffer(b" ".join(raw) + b" ", np.uint8)]
        space = (data == 32) | ((data >= 9) & (data <= 13))
        edge = np.diff(space.astype(np.int8), prepend=1)
        first, stop = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        byte, up, down = byte_tables(len(data))
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(byte[data] * up[: len(data)], out=sums[1:])
        hashed = mixed((sums[stop] - sums[first]) * down[first] + (stop - first).astype(np.uint64) * _M3)
        ends = np.cumsum(np.fromiter((len(r) + 1 for r in raw), np.int64, len(raw)))
        for k, own in zip(owner, np.split(hashed, np.searchsorted(first, ends[:-1])), strict=True):
            words[k].append(own)
    out = []
    with np.errstate(over="ignore"):
        for parts in words:
            w = np.concatenate(parts) if parts else np.empty(0, np.uint64)
            size = min(n, len(w))
            if not size:
                out.append(np.empty(0, np.uint64))
                continue
            h = np.full(len(w) - size + 1, size, np.uint64)
            for k in range(size):
                h = h * _M3 + w[k : len(w) - size + 1 + k]
            h = np.sort(mixed(h))
            out.append(h[np.append(True, h[1:] != h[:-1])])
    return out


def set_key(s: np.ndarray) -> int:
    """A signed 64-bit hash of a set."""
    with np.errstate(over="ignore"):
        total = (mixed(s * _M3 + _M1)).sum(dtype=np.uint64) + np.uint64(len(s))
    return int(total.astype(np.int64))


class Rule:
    """Shingles of n words, linked when den * intersection >= num * union."""

    def __init__(self, n: int, num: int, den: int):
        self.n, self.num, self.den = n, num, den

    def common(self, size):
        """Elements that a set shares with any similar one, at least (column)."""
        return F.ceil(size * self.num / self.den).cast("int")

    def prefix(self, size, matches):
        return F.least(size, size - self.common(size) + matches)

    def choices(self, size):
        """The l that a set of ``size`` may choose (columns, ascending)."""
        return [F.lit(m) for m in MATCHES] + [(F.floor(size / d) + max(MATCHES)).cast("int") for d in MORE_MATCHES]

    def longest(self, size: int) -> int:
        """Elements of the longest prefix."""
        return min(size, size - -(-size * self.num // self.den) + max(MATCHES) + size // min(MORE_MATCHES))

    def overlap(self, a, b):
        """Elements that two similar sets share, at least (column)."""
        return F.ceil((a + b) * self.num / (self.den + self.num)).cast("int")


def slices(pdfs, rows: int = 256):
    """Smaller frames, so that what is made of one stays small."""
    for pdf in pdfs:
        for a in range(0, len(pdf), rows):
            yield pdf.iloc[a : a + rows]


def class_rows(docs: DataFrame, rule: Rule) -> DataFrame:
    """(doc_id, digest, cid, n, prefix) of every document: the hash of its text, its class, set size
    and longest prefix."""

    def run(pdfs):
        for pdf in slices(pdfs):
            rows = []
            sets = shingle_sets([t or "" for t in pdf["text"]], rule.n)
            for doc_id, digest, s in zip(pdf["doc_id"], pdf["digest"], sets, strict=True):
                rows.append((doc_id, digest, set_key(s), len(s), s[: rule.longest(len(s))].astype(np.int64)))
            yield pd.DataFrame(rows, columns=["doc_id", "digest", "cid", "n", "prefix"])

    rows = docs.select(F.col("doc_id").cast("string"), F.xxhash64("text").alias("digest"), "text").mapInPandas(
        run, "doc_id string, digest long, cid long, n int, prefix array<long>"
    )
    return rows.withColumn("doc_id", F.col("doc_id").cast("long"))


def bitmap_of(ids, bits: int = BITMAP_BITS) -> np.ndarray:
    """A bitmap of the hashes of the column values ``ids`` (one column); at most bits / 64 words, one
    row each, reach the driver, however many values there are."""
    place = F.pmod(F.xxhash64(F.col(ids.columns[0])), F.lit(bits))
    words = ids.select((place / 64).cast("int").alias("w"), (place % 64).cast("int").alias("b"))
    rows = words.groupBy("w").agg(F.bit_or(F.expr("shiftleft(1L, b)")).alias("v")).toPandas()
    out = np.zeros(bits // 64, np.int64)
    out[rows["w"].to_numpy(int)] = rows["v"].to_numpy(np.int64)
    return out


def sets_of(docs: DataFrame, wanted: DataFrame, rule: Rule) -> DataFrame:
    """(cid, n, elements) of the classes ``wanted`` (cid, doc_id): six bytes an element, sorted.

    Texts aren't shuffled: tasks skip the documents whose doc_id isn't in a bitmap of fixed size.
    What it lets pass by chance is dropped by class; a full one only costs time.
    """
    id_key = F.coalesce(F.col("doc_id").cast("string"), F.lit("~"))
    bitmap = docs.sparkSession.sparkContext.broadcast(bitmap_of(wanted.select(id_key)))
    place = F.pmod(F.xxhash64(id_key), F.lit(BITMAP_BITS))

    def run(pdfs):
        for pdf in pdfs:
            at = pdf["at"].to_numpy(np.int64)
            kept = pdf["text"][(bitmap.value[at >> 6] >> (at & 63)) & 1 == 1].tolist()
            for a in range(0, len(kept), 256):
                rows = []
                for s in shingle_sets([t or "" for t in kept[a : a + 256]], rule.n):
                    six = np.ascontiguousarray(s.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :6]
                    rows.append((set_key(s), len(s), six.tobytes()))
                yield pd.DataFrame(rows, columns=["cid", "n", "elements"])

    made = docs.select(place.alias("at"), "text").mapInPandas(run, "cid long, n int, elements binary")
    return made.join(wanted.select("cid").distinct(), "cid", "left_semi").dropDuplicates(["cid"])


def unpacked(elements: bytes) -> np.ndarray:
    raw = np.frombuffer(elements, np.uint8).reshape(-1, 6)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :6] = raw
    return np.sort(out.view("<u8").ravel())


def checked(pairs: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """The pairs (a, b) of classes that are similar, by whole sets."""
    ways = pairs.select("a", "b").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    label = ways.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("l"))
    marked = written(pairs.select("a", "b").join(label, "a"), "join-pairs")
    group = marked.groupBy("l").count()
    tiles = F.ceil(F.sqrt(2 * F.col("count")) / TILE).cast("int")
    small = group.where(tiles <= 1).agg(F.sum("count")).first()[0] or 0
    shared = max(1, small // (TILE * TILE // 4))
    tile = lambda c: F.pmod(F.xxhash64(c), F.col("tiles")).cast("int")
    keyed = marked.join(group.withColumn("tiles", tiles), "l").select(
        "a",
        "b",
        F.when(F.col("tiles") <= 1, F.struct(F.pmod(F.xxhash64("l"), F.lit(shared)).alias("l"), F.lit(-1).alias("i"), F.lit(-1).alias("j")))
        .otherwise(F.struct("l", F.least(tile("a"), tile("b")).alias("i"), F.greatest(tile("a"), tile("b")).alias("j")))
        .alias("key"),
    )
    keyed = written(keyed.select("a", "b", "key.l", "key.i", "key.j"), "join-tiles")
    keys = ["l", "i", "j"]
    sent = keyed.select(F.col("a").alias("cid"), *keys).union(keyed.select(F.col("b").alias("cid"), *keys)).distinct()
    sent = sent.toDF("cid", "sl", "si", "sj").join(sets, "cid")

    def check(own, rows):
        values = {c: unpacked(e) for c, e in zip(rows["cid"], rows["elements"], strict=True)}
        good = []
        for a, b in zip(own["a"].tolist(), own["b"].tolist(), strict=True):
            x, y = values[a], values[b]
            if len(x) > len(y):
                x, y = y, x
            if rule.den * len(x) < rule.num * len(y):
                continue
            both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
            if rule.den * both >= rule.num * (len(x) + len(y) - both):
                good.append((a, b))
        return pd.DataFrame(good, columns=["a", "b"])

    return keyed.groupBy(*keys).cogroup(sent.groupBy("sl", "si", "sj")).applyInPandas(check, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(v, label) of the vertices of ``links`` (a, b): the smallest vertex of each component."""
    ways = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    ways = written(ways, "join-ways")
    labels = written(ways.groupBy(F.col("a").alias("v")).agg(F.least(F.col("a"), F.min("b")).alias("label")), "join-labels")
    while True:
        near = ways.join(labels, ways["b"] == labels["v"]).groupBy("a").agg(F.min("label").alias("near"))
        hooked = labels.join(near, labels["v"] == near["a"]).select("v", "label", F.least("label", "near").alias("new"))
        # a vertex also takes the label that its label has: paths halve in each round
        over = labels.select(F.col("v").alias("u"), F.col("label").alias("further"))
        moved = hooked.join(over, hooked["new"] == over["u"], "left").select(
            "v", F.least("new", F.coalesce("further", "new")).alias("label"), F.col("label").alias("old")
        )
        moved = written(moved, "join-labels")
        if not moved.where("label <> old").limit(1).count():
            return moved.select("v", "label")
        labels = moved.select("v", "label")


def planned(live: DataFrame, sizes: DataFrame, rule: Rule) -> DataFrame:
    """(cid, n, matches, need, heavy) of every class with live elements: its l, and the matches
    outside hot elements. live: (token, cid, pos, df); sizes: (cid, n)."""
    sums = []
    known = live.join(sizes, "cid")
    for k, m in enumerate(rule.choices(F.col("n"))):
        inside = F.col("pos") < rule.prefix(F.col("n"), m)
        sums.append(F.count_if(inside & (F.col("df") > HOT)).cast("int").alias(f"h{k}"))
        sums.append(F.sum(F.when(inside & (F.col("df") <= HOT), F.col("df") - 1).otherwise(0)).alias(f"g{k}"))
    per = known.groupBy("cid", "n").agg(*sums)
    costs = []
    for k, m in enumerate(rule.choices(F.col("n"))):
        need = m - F.col(f"h{k}")
        cost = F.col(f"g{k}") * (1 + CHECK_COST / F.greatest(need, F.lit(1)))
        costs.append(F.when(need > 0, F.struct(cost.alias("cost"), m.alias("m"), need.alias("need"))))
    best = F.array_min(F.filter(F.array(*costs), lambda x: x.isNotNull()))
    return per.withColumn("best", best).select(
        "cid",
        "n",
        F.coalesce("best.m", rule.choices(F.col("n"))[-1]).alias("matches"),
        F.coalesce("best.need", F.lit(0)).alias("need"),
        F.col("best").isNull().alias("heavy"),
    )


def fits(rule: Rule, a: str, b: str):
    """Whether a match at places ``pos`` leaves room for the overlap of similar sets."""
    n, i = (lambda s: F.col(f"{s}.n")), (lambda s: F.col(f"{s}.pos"))
    rest = F.least(n(a) - i(a), n(b) - i(b))
    sizes = (F.greatest(n(a), n(b)) * rule.num) <= (F.least(n(a), n(b)) * rule.den)
    return sizes, rest, rule.overlap(n(a), n(b))


def light_pairs(live: DataFrame, plan: DataFrame, rule: Rule) -> DataFrame:
    """Candidates of which one class at least has an l of its own."""
    gen = live.where(F.col("df") <= HOT).join(plan, "cid").where(F.col("pos") < rule.prefix(F.col("n"), F.col("matches")))
    gen = gen.select("token", "cid", "n", "pos", "matches", "need", "heavy")
    sizes, rest, least = fits(rule, "x", "y")
    before = F.least(F.col("x.pos"), F.col("y.pos"))
    met = gen.alias("x").join(
        gen.alias("y"),
        (F.col("x.token") == F.col("y.token")) & (F.col("x.cid") < F.col("y.cid"))
        & ~(F.col("x.heavy") & F.col("y.heavy")) & sizes & (rest + before >= least),
    )
    need = (
        F.when(F.col("x.matches") < F.col("y.matches"), F.col("x.need"))
        .when(F.col("x.matches") > F.col("y.matches"), F.col("y.need"))
        .otherwise(F.greatest("x.need", "y.need"))
    )
    met = met.select(F.col("x.cid").alias("a"), F.col("y.cid").alias("b"), need.alias("need"))
    return met.groupBy("a", "b").agg(F.count("*").alias("shared"), F.max("need").alias("need")).where("shared >= need").select("a", "b")


def heavy_prefixes(sets: DataFrame, heavy: DataFrame, rule: Rule) -> DataFrame:
    """(token, cid, n, pos, df) of the heavy classes' prefixes, rarest elements first."""

    def explode(pdfs):
        for pdf in slices(pdfs, 64):
            tokens = [unpacked(e).astype(np.int64) for e in pdf["elements"]]
            lens = list(map(len, tokens))
            yield pd.DataFrame({"cid": np.repeat(pdf["cid"], lens), "n": np.repeat(pdf["n"], lens), "token": np.concatenate(tokens)})

    own = sets.join(heavy.select("cid"), "cid", "left_semi")
    # dealt out evenly: these classes come from few files
    own = own.repartition(int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    tokens = written(own.mapInPandas(explode, "cid long, n int, token long"), "join-heavy")
    counts = tokens.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    ranked = (
        tokens.join(counts, "token")
        .groupBy("cid", "n")
        .agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("row"))  # a set's own elements
        # elements of one class stand before all others
        .select("cid", "n", (F.col("n") - F.size("row")).alias("alone"), F.posexplode("row").alias("k", "e"))
        .select(F.col("e.token").alias("token"), "cid", "n", (F.col("alone") + F.col("k")).alias("pos"), F.col("e.df").alias("df"))
    )
    return written(ranked.where(F.col("pos") < rule.prefix(F.col("n"), F.lit(1))), "join-heavy-prefix")


def heavy_pairs(prefix: DataFrame, rule: Rule, sets: DataFrame) -> DataFrame:
    """Links among heavy classes."""
    often = prefix.groupBy("token").agg(F.count("*").alias("c"), F.min(F.struct("pos", "cid")).alias("first"))
    hub = often.where(F.col("c") > HOT).select("token", F.col("first.cid").alias("hub"))
    star = prefix.join(hub, "token").where("cid <> hub")
    star = star.select(F.least("cid", "hub").alias("a"), F.greatest("cid", "hub").alias("b")).distinct()
    found = written(checked(star, sets, rule), "join-star")
    label = components(found)
    known = prefix.join(label, prefix["cid"] == label["v"], "left").select(
        "token", "cid", "n", "pos", F.coalesce("label", "cid").alias("label")
    )
    known = written(known, "join-known")
    # of each element's classes, those outside its largest component meet all others
    largest = known.groupBy("token", "label").count().groupBy("token").agg(
        F.max(F.struct("count", "label")).alias("m"), F.sum("count").alias("c")
    ).where("c > 1").select("token", F.col("m.label").alias("most"))
    outer = known.join(largest, "token").where("label <> most")
    sizes, rest, least = fits(rule, "x", "y")
    apart = (F.col("x.label") != F.col("y.label")) & ((F.col("y.label") == F.col("x.most")) | (F.col("x.cid") < F.col("y.cid")))
    # rarest first: a pair's first common element has no common one before it, so that ``rest`` alone
    # bounds the overlap there
    met = outer.alias("x").join(
        known.alias("y"), (F.col("x.token") == F.col("y.token")) & apart & sizes & (rest >= least)
    )
    more = met.select(F.least("x.cid", "y.cid").alias("a"), F.greatest("x.cid", "y.cid").alias("b")).distinct()
    return found.union(checked(more, sets, rule))


def labelled(docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """(doc_id, digest, n, label) of every document: the label is its component's."""
    rule = Rule(n, num, den)
    spark = docs.sparkSession
    rows = written(class_rows(docs, rule), "join-classes")
    classes = rows.where("n > 0").dropDuplicates(["cid"])
    tokens = classes.select("cid", F.posexplode("prefix").alias("pos", "token"))
    counts = tokens.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    live = written(tokens.join(counts, "token"), "join-live")
    release(spark)
    firsts = rows.where("n > 0").groupBy("cid", "n").agg(F.min("doc_id").alias("doc_id"))
    plan = written(planned(live, firsts.select("cid", "n"), rule), "join-plan")
    pairs = written(light_pairs(live, plan, rule), "join-candidates")
    heavy = plan.where("heavy").select("cid")
    wanted = functools.reduce(DataFrame.union, [pairs.select("a"), pairs.select("b"), heavy]).toDF("cid").distinct()
    wanted = written(firsts.join(wanted, "cid", "left_semi").select("cid", "doc_id"), "join-wanted")
    release(spark)
    sets = written(sets_of(docs, wanted, rule), "join-sets")
    release(spark)
    links = checked(pairs, sets, rule).union(heavy_pairs(heavy_prefixes(sets, heavy, rule), rule, sets))
    label = components(written(links, "join-links"))
    own = rows.select("doc_id", "digest", "cid", "n").join(label, rows["cid"] == label["v"], "left")
    return own.select("doc_id", "digest", "n", F.coalesce("label", "cid").alias("label"))


def linked(docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document."""
    own = labelled(docs, n, num, den)
    least = own.where("n > 0").groupBy("label").agg(F.min("doc_id").alias("least"))
    full = own.where("n > 0").join(least, "label").select("doc_id", "n", F.col("least").alias("component_id"))
    bare = own.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return full.union(bare).select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id")


def one_of_each(docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """One document of each component, with its columns: the one of the smallest (doc_id, text hash),
    rows without a doc_id last; of equal ones, one. Every document without words is kept."""
    names = docs.columns
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "digest")
    first = labelled(docs, n, num, den).where("n > 0").groupBy("label").agg(F.min(order).alias("m"))
    keep = first.select(F.col("m.doc_id").alias("__id"), F.col("m.digest").alias("__kept"))
    own = docs.withColumn("__digest", F.xxhash64("text"))
    worded = F.coalesce(F.col("text"), F.lit("")).rlike(WORD_PATTERN)
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__digest") == F.col("__kept"))
    kept = own.where(worded).join(keep, same, "left_semi").dropDuplicates(["doc_id", "__digest"])
    return kept.union(own.where(~worded)).select(*names)


def op3_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return linked(spark.read.parquet(f"{sf_dir}/documents.parquet"), 3, 90, 100)
