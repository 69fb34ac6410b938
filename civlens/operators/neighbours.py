"""Exact nearest neighbours as a distributed join, and what builds on it: k-NN voting (M-14) and SMOTE
over-sampling (M-13).

Points are dealt to the nearest of some pivots (a Voronoi partition). A pivot's part keeps the least and
largest distance to its points and its k least ones. Triangle inequalities then give, for each query,
a distance within which k points must lie and a lower bound of its distance to each part, so that a
query is sent only to the parts that may hold one of its k nearest points: nothing is lost. Parts next
to each other make up a chunk, a large part is cut into several; queries are dealt to turns. A chunk
meets a turn as one block of distances, so that rows travel once a chunk or turn, packed as bytes.

Distances are sums of squared differences in double. Ties go to the smaller key. Rows without a vector
take no part. Keys are integers.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from civlens.operators.components import fixed
from civlens.operators.ranking import hash_order, mark_first_by_hash

#: Pivots: the square root of the points, within these bounds.
PIVOTS = (1, 256)
#: Parts (pivots x groups) whose bounds the driver and the tasks may hold.
MAX_PARTS = 1 << 16
#: Rows of a side of a block: CHUNK at least, SIDE numbers at most, between these so many that all
#: queries and points make about BLOCKS blocks.
CHUNK, SIDE, BLOCKS = 2048, 1 << 22, 64
#: Queries and points whose products are taken at once.
TILE = (256, 4096)
#: Stands for a null key: after all others.
LAST = (1 << 63) - 1
#: Numbers of a block of differences.
BLOCK = 1 << 21


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of ``a`` and of ``b``, a block at a time."""
    out = np.empty((len(a), len(b)))
    step = max(1, BLOCK // max(1, b.size))
    for k in range(0, len(a), step):
        out[k : k + step] = ((a[k : k + step, None] - b) ** 2).sum(-1)
    return out


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_list()).astype(np.float64)


def closest(a: np.ndarray, b: np.ndarray, k: int, ids: np.ndarray, own: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """(i, j, squared distance) of the k rows ``b[j]`` nearest to each ``a[i]``, ties to the smaller of
    ``ids``; ``own`` are ids that the rows of ``a`` must not get. Matrix products give distances with
    a bounded error; pairs they cannot rule out get the exact one, so the result is that of ``squares``."""
    real = np.isfinite(b).all(axis=1)
    middle = b[real].mean(axis=0) if real.any() else np.zeros(b.shape[1])
    stride = -(-len(b) // TILE[1])
    dealt = np.concatenate([np.arange(s, len(b), stride) for s in range(stride)])  # each tile holds rows from all over
    out = []
    with np.errstate(all="ignore"):
        q, p = a - middle, b[dealt] - middle
        q2, p2 = (q * q).sum(axis=1), (p * p).sum(axis=1)
        error = 32 * (a.shape[1] + 8) * np.finfo(float).eps * (q2 + np.max(p2, initial=0, where=np.isfinite(p2)))
        q, p = np.column_stack([-2 * q, np.ones(len(q))]), np.column_stack([p, p2]).T
        for at in range(0, len(a), TILE[0]):
            rows = slice(at, at + TILE[0])
            limit = np.full(len(a[rows]), np.inf)  # of products, that is distances less q2
            best = (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
            for start in range(0, len(b), TILE[1]):
                near = q[rows] @ p[:, start : start + TILE[1]]
                taken = k if own is None else k + 1
                if not start and near.shape[1] >= taken:
                    limit = np.partition(near, taken - 1, axis=1)[:, taken - 1] + 2 * error[rows]
                i, j = np.divmod(np.flatnonzero(~(near > limit[:, None])), near.shape[1])
                i, j = i + at, dealt[j + start]
                if own is not None:
                    other = own[i] != ids[j]
                    i, j = i[other], j[other]
                step = max(1, BLOCK // max(1, a.shape[1]))
                parts = [((a[i[s : s + step]] - b[j[s : s + step]]) ** 2).sum(-1) for s in range(0, len(i), step)]
                far = np.concatenate([np.zeros(0), *parts])
                keep = np.isfinite(far)
                i, j, far = (np.concatenate([x, y[keep]]) for x, y in zip(best, (i, j, far), strict=True))
                order = np.lexsort((ids[j], far, i))
                i, j, far = i[order], j[order], far[order]
                rank = np.arange(len(i)) - np.searchsorted(i, i)
                best = tuple(x[rank < k] for x in (i, j, far))
                full = rank == k - 1
                reach = far[full] - q2[i[full]] + error[i[full]]
                limit[i[full] - at] = np.fmin(limit[i[full] - at], reach)
            out.append(best)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _rows(df: DataFrame, key: str, vector: str, by: str | None, carry: Sequence[str] = ()) -> DataFrame:
    group = F.col(by).cast("string") if by else F.lit("")
    real = df.where(F.col(vector).isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x)))
    narrow = df.schema[vector].dataType.elementType == T.FloatType()
    return real.where(group.isNotNull()).select(
        F.coalesce(F.col(key).cast("long"), F.lit(LAST)).alias("id"), group.alias("g"),
        (F.col(vector) if narrow else F.col(vector).cast("array<double>")).alias("v"),
        *[F.col(c).alias(f"carried_{c}") for c in carry],
    )


def _packed(frame: pd.DataFrame, **more) -> dict:
    """Rows as one row of bytes."""
    whole = {c: frame[c].to_numpy().tobytes() for c in ("id", "row") if c in frame}
    return {**more, **whole, "v": np.stack(frame["v"].to_list()).tobytes()}


def _in_line(pivots: np.ndarray) -> np.ndarray:
    """Pivots along their main direction: neighbours in number lie near each other."""
    if not pivots.size or not np.isfinite(pivots).all():
        return pivots
    way = np.linalg.svd(pivots - pivots.mean(axis=0), full_matrices=False)[2][0]
    return pivots[np.argsort(pivots @ way, kind="stable")]


def _chunks(rows, side: int) -> dict[tuple[str, int], tuple[int, int]]:
    """The first chunk of each part and their number: small parts of a group share chunks of ``side`` rows."""
    out, following, room, last = {}, 0, 0, None
    for r in sorted(rows, key=lambda r: (r.g, r.part)):
        if r.g != last or r.size > room:
            n = -(-r.size // side)
            out[r.g, r.part] = (following, n)
            following, room, last = following + n, side - r.size, r.g
        else:
            out[r.g, r.part] = (following - 1, 1)
            room -= r.size
    return out


class Bounds:
    """What the parts of one group say about distances: ``reach`` are each part's least radii."""

    def __init__(self, rows, k: int):
        self.part = np.array([r.part for r in rows])
        self.low, self.high = (np.array([r[c] for r in rows]) for c in ("low", "high"))
        self.reach = np.full((len(rows), k), np.inf)
        for i, r in enumerate(rows):
            self.reach[i, : len(r.least)] = r.least

    def parts(self, far: np.ndarray) -> np.ndarray:
        """Whether a query at the distances ``far`` (queries x pivots) needs each part."""
        far = far[:, self.part]
        k = self.reach.shape[1]
        ways = (far[:, :, None] + self.reach).reshape(len(far), -1)
        within = np.partition(ways, k - 1, axis=1)[:, k - 1 : k]
        least = np.maximum(far - self.high, self.low - far)
        return least <= within * (1 + 1e-9) + 1e-12


def _placed(points: DataFrame, pivots) -> DataFrame:
    """Points with the number of the nearest pivot and their distance to it."""
    schema = T.StructType([*points.schema.fields, T.StructField("part", T.IntegerType()), T.StructField("far", T.DoubleType())])

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                far = squares(_matrix(frame["v"]), pivots.value)
                part = far.argmin(axis=1)
                yield frame.assign(part=part, far=np.sqrt(far[np.arange(len(frame)), part]))

    return points.mapInPandas(place, schema)


def _asked(queries: DataFrame, pivots, bounds, chunks, turns: int) -> DataFrame:
    """Each query once for each chunk that may hold one of its nearest points, packed by chunk and turn."""

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = 0
        for frame in frames:
            turn = (seen + np.arange(len(frame))) % turns
            seen += len(frame)
            for g, some in frame.assign(turn=turn).groupby("g"):
                if g not in bounds.value:
                    continue
                of, vectors = bounds.value[g], _matrix(some["v"])
                step = max(1, BLOCK // of.reach.size)
                steps = range(0, len(some), step)
                parts = np.concatenate([of.parts(np.sqrt(squares(vectors[a : a + step], pivots.value))) for a in steps])
                first, n = (np.array(x) for x in zip(*[chunks.value[g, part] for part in of.part], strict=True))
                for chunk in range(first.min(), (first + n).max()):
                    asking = some[parts[:, (first <= chunk) & (chunk < first + n)].any(axis=1)]
                    packs = [_packed(pack, chunk=chunk, turn=t) for t, pack in asking.groupby("turn")]
                    if packs:
                        yield pd.DataFrame(packs)

    return queries.mapInPandas(ask, "chunk int, turn int, id binary, v binary")


def _held(placed: DataFrame, chunks) -> DataFrame:
    """Points packed by chunk; a part of several chunks is dealt to them in turn."""

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = 0
        for frame in frames:
            if len(frame):
                where = [chunks.value[of] for of in zip(frame["g"], frame["part"], strict=True)]
                first, n = (np.array(x) for x in zip(*where, strict=True))
                chunk = first + (seen + np.arange(len(frame))) % n
                seen += len(frame)
                yield pd.DataFrame([_packed(some, chunk=c) for c, some in frame.groupby(chunk)])

    return placed.select("g", "part", "id", "row", "v").mapInPandas(pack, "chunk int, id binary, row binary, v binary")


def nearest(
    queries: DataFrame, points: DataFrame, key: str, vector: str, k: int, by: str | None = None, carry: Sequence[str] = (),
    exclude_self: bool = False,
) -> DataFrame:
    """id, rank (1..k), neighbour, distance (squared) and ``carry`` columns of the neighbour as
    ``carried_<name>``: the k nearest ``points`` of each query, of the same value of ``by`` if that is
    given (at most MAX_PARTS parts in all). ``exclude_self`` leaves out the point of the query's key.
    Builds an index (pivots and bounds of parts) when called."""
    spark = points.sparkSession
    held, asking = _rows(points, key, vector, by, carry), _rows(queries, key, vector, by)
    carried = [f for f in held.schema.fields if f.name.startswith("carried_")]
    wanted = k + 1 if exclude_self else k
    n_points, n_queries = held.count(), asking.count()
    n_pivots = max(PIVOTS[0], min(PIVOTS[1], int(n_points**0.5)))
    chosen = held.orderBy(hash_order(["id"], 14), "id").limit(n_pivots).select("v").collect()
    if not chosen:
        none = T.StructType([T.StructField(c, T.LongType()) for c in ("id", "neighbour")] + [T.StructField("distance", T.DoubleType()), *carried])
        return spark.createDataFrame([], none).select("id", F.lit(1).alias("rank"), "neighbour", "distance", *[f.name for f in carried])
    middles = _in_line(np.unique(np.array([r.v for r in chosen], np.float64), axis=0))
    pivots = spark.sparkContext.broadcast(middles)
    placed = fixed(_placed(held.withColumn("row", F.monotonically_increasing_id()), pivots))
    nearby = Window.partitionBy("g", "part").orderBy("far")
    least = placed.select("g", "part", "far", F.row_number().over(nearby).alias("r")).where(F.col("r") <= wanted)
    least = least.groupBy("g", "part").agg(F.sort_array(F.collect_list("far")).alias("least"))
    stats = placed.groupBy("g", "part").agg(F.min("far").alias("low"), F.max("far").alias("high"), F.count(F.lit(1)).alias("size"))
    rows = stats.join(least, ["g", "part"]).limit(MAX_PARTS + 1).collect()
    if len(rows) > MAX_PARTS:
        raise ValueError(f"more than {MAX_PARTS} parts: fewer groups are needed")
    groups: dict[str, list] = {}
    for r in rows:
        groups.setdefault(r.g, []).append(r)
    bounds = spark.sparkContext.broadcast({g: Bounds(of, wanted) for g, of in groups.items()})
    side = max(CHUNK, min(int((n_points * n_queries / BLOCKS) ** 0.5), SIDE // max(1, middles.shape[1])))
    turns = max(1, -(-n_queries // side))
    chunks = spark.sparkContext.broadcast(_chunks(rows, side))
    left = _asked(asking, pivots, bounds, chunks, turns)
    right = _held(placed, chunks).withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(turns - 1))))
    narrow = held.schema["v"].dataType.elementType == T.FloatType()
    width = middles.shape[1]

    def best(some: pd.DataFrame, of: pd.DataFrame) -> pd.DataFrame:
        whole = lambda frame, c, kind=np.int64: np.frombuffer(b"".join(frame[c]), kind)
        asked, ids, numbers = whole(some, "id"), whole(of, "id"), np.zeros(0, np.int64)
        i = j = numbers
        far = np.zeros(0)
        if len(asked) and len(ids):
            numbers = whole(of, "row")
            a, b = (whole(x, "v", np.float32 if narrow else np.float64).reshape(n, width).astype(np.float64) for x, n in ((some, len(asked)), (of, len(ids))))
            i, j, far = closest(a, b, k, ids, asked if exclude_self else None)
        return pd.DataFrame({"id": asked[i], "neighbour": ids[j], "distance": far, "row": numbers[j]})

    met = left.groupBy("chunk", "turn").cogroup(right.groupBy("chunk", "turn"))
    met = met.applyInPandas(best, "id long, neighbour long, distance double, row long")
    ranked = Window.partitionBy("id").orderBy("distance", "neighbour")
    out = met.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)
    if carried:
        out = out.join(placed.select("row", *[f.name for f in carried]), "row")
    known = lambda c: F.when(F.col(c) != LAST, F.col(c)).alias(c)
    return out.select(known("id"), "rank", known("neighbour"), "distance", *[f.name for f in carried])


def knn_classify(train: DataFrame, rows: DataFrame, key: str, vector: str, label: str, k: int = 8) -> DataFrame:
    """M-14: key and ``predicted`` for each of ``rows``: the commonest label of the k nearest rows of
    ``train`` (the smallest one of equally common ones)."""
    votes = nearest(rows, train, key, vector, k, carry=[label]).groupBy("id", F.col(f"carried_{label}").alias("predicted"))
    first = Window.partitionBy("id").orderBy(F.desc("n"), "predicted")
    best = votes.agg(F.count(F.lit(1)).alias("n")).withColumn("__rn", F.row_number().over(first)).where("__rn = 1")
    return best.select(F.col("id").alias(key), "predicted")


def _draw(what: str, seed: int) -> Column:
    """A 60-bit number for a copy of a row and a purpose, which SQL engines can reproduce."""
    text = F.concat_ws(":", F.lit(str(seed)), F.lit(what), F.col("base").cast("string"), F.col("copy").cast("string"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def smote(df: DataFrame, key: str, vector: str, label: str, k: int = 5, seed: int = 0) -> DataFrame:
    """M-13: synthetic rows (label, base, copy, neighbour, u, vector) that bring every class up to the
    size of the largest one.

    A class of n rows that lacks m makes m div n points of each of its rows, and one more of the m mod n
    rows that come first in hash order. A point lies at the share u of the way from its row to one of
    the row's k nearest rows of the class (all others, if there are fewer); both are drawn by hash, so
    the result does not depend on partitioning. A class of one row has no neighbours and stays.
    """
    of = df.select(F.col(key).cast("long").alias("base"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("a"))
    of = of.where("a is not null and label is not null")
    sizes = of.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    largest = sizes.agg(F.max("n")).scalar()
    marked = mark_first_by_hash(of, "base", (largest - F.col("total")) % F.col("total"), group=["label"], seed=seed, out="extra")
    counted = marked.join(sizes, "label").withColumn("largest", largest)
    times = F.floor((F.col("largest") - F.col("n")) / F.col("n")).cast("int") + F.col("extra").cast("int")
    copies = counted.withColumn("copies", times).where("copies > 0 and n > 1")
    copies = copies.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    drawn = copies.withColumn("rank", (F.pmod(_draw("neighbour", seed), F.least(F.lit(k), F.col("n") - 1)) + 1).cast("int"))
    drawn = drawn.withColumn("u", _draw("share", seed) / F.lit(float(1 << 60)))
    # only rows that copies are made of need neighbours
    asking = df.join(copies.select(F.col("base").alias(key)).distinct(), key, "left_semi")
    near = nearest(asking, df, key, vector, k, by=label, carry=[vector], exclude_self=True)
    near = near.select(F.col("id").alias("base"), "rank", "neighbour", F.col(f"carried_{vector}").cast("array<double>").alias("b"))
    return drawn.join(near, ["base", "rank"]).select(
        "label", "base", "copy", "neighbour", "u", F.zip_with("a", "b", lambda a, b: a + F.col("u") * (b - a)).alias(vector)
    )
