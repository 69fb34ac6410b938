"""Mixing sources to target weights by weighted fair queueing, in native expressions.

Each source is a queue of its documents in shuffled order, repeated up to MAX_COPIES times. A copy's
virtual finish time is the source's cumulative size up to and with it, divided by the source's
target. Sorting all copies by that time interleaves the sources by weight, and the budget is used
up at virtual time 1, as the targets sum to it; the copy that crosses it is cut to whole words.

Targets: sources in code-point order, null last, weigh ``weights`` in turn and share the sum of all
sizes; a target stops at MAX_COPIES times its source's size and the excess goes to the others by
weight until none is above.

Cumulative sizes are two-level: a source's shuffled order is cut into about sqrt(rows) buckets by
the shuffle key, sums of buckets run over buckets and sizes run within a bucket, so a source that
holds a third of all rows is spread over as many tasks.

Null or empty text: size 0, never taken. Null source: a source of its own. Repeated rows: each is
taken by itself; equal rows may swap places, which changes no result as a multiset. Empty table or
all sizes 0: targets and takes are 0. Extra columns are ignored (mix) or kept (mixed_documents).
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from civlens.llm.common import WORD_PATTERN, WORD_SPACE, with_global_index, written

MAX_COPIES = 3
WEIGHTS = (1, 2, 3)
KEY_BITS = 60


def n_words(text):
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS) -> DataFrame:
    """(source, source_size, target) of every source."""
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = with_global_index(by_source, [F.col("source").asc_nulls_last()], "mix-sources")
    turn = F.array(*[F.lit(int(w)) for w in weights])
    known = written(ranked.withColumn("weight", F.get(turn, F.col("idx") % len(weights))).drop("idx"), "mix-weights")
    cap = F.col("source_size") * MAX_COPIES
    total = known.agg(F.sum("source_size")).first()[0] or 0
    share, capped = 0.0, -1
    while True:
        # two sums a pass; a source that reached its cap stays there, so the passes end
        full = F.col("weight") * share >= cap if capped >= 0 else F.lit(False)
        n, used, rest = known.agg(
            F.count_if(full), F.sum(F.when(full, cap)), F.sum(F.when(~full, F.col("weight")))
        ).first()
        if n == capped or not rest or not total:
            break
        capped, share = n, (total - (used or 0)) / rest
    return known.select("source", "source_size", F.least(cap, F.col("weight") * share).cast("double").alias("target"))


def schedule(sizes: DataFrame, seed: int = 0, weights=WEIGHTS) -> DataFrame:
    """Rows (doc_id, source, size) with source_size, target, and start: the sizes before it in the
    first round of its source's shuffled order."""
    goal = targets(sizes, weights)
    text = F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    key = F.conv(F.substring(F.md5(text.cast("binary")), 1, KEY_BITS // 4), 16, 10).cast("long")
    buckets = max(1, math.isqrt(sizes.count()))
    dealt = sizes.withColumn("key", key).withColumn("bucket", F.floor(F.col("key") / ((1 << KEY_BITS) // buckets)))
    sums = dealt.groupBy("source", "bucket").agg(F.sum("size").alias("in_bucket"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("base", F.coalesce(F.sum("in_bucket").over(before), F.lit(0))).drop("in_bucket")
    within = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size")
    within = within.rowsBetween(Window.unboundedPreceding, -1)
    local = dealt.withColumn("local", F.coalesce(F.sum("size").over(within), F.lit(0)))
    placed = local.alias("d").join(
        sums.alias("s"),
        F.col("d.source").eqNullSafe(F.col("s.source")) & (F.col("d.bucket") == F.col("s.bucket")),
    )
    placed = placed.select("doc_id", F.col("d.source").alias("source"), "size", (F.col("base") + F.col("local")).alias("start"))
    return placed.alias("p").join(goal.alias("g"), F.col("p.source").eqNullSafe(F.col("g.source"))).select(
        "doc_id", F.col("p.source").alias("source"), "size", "source_size", "target", "start"
    )


def mix(planned: DataFrame) -> DataFrame:
    """The mix in order: a row for each copy taken, with virtual_finish, copy and taken (words)."""
    rounds = F.explode(F.sequence(F.lit(0), F.lit(MAX_COPIES - 1)))
    copies = planned.where("size > 0").withColumn("copy", rounds)
    begin = F.col("copy") * F.col("source_size") + F.col("start")
    budget = F.floor(F.col("target"))
    return (
        copies.withColumn("virtual_finish", (begin + F.col("size")) / F.col("target"))
        .withColumn("taken", F.least(F.col("size"), budget - begin))
        .where("taken > 0")
        .orderBy("virtual_finish", F.col("source").asc_nulls_last(), "doc_id", "copy")
    )


def document_sizes(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", n_words(F.col("text")).alias("size"))


def mixed_documents(docs: DataFrame, seed: int = 0, weights=WEIGHTS) -> DataFrame:
    """The rows of ``docs`` that the mix takes, in its order, once a copy, with the columns of
    ``docs``; a copy that the budget cuts keeps its first words as they stand."""
    digest = F.sha2(F.encode(F.coalesce("text", F.lit("")), "utf-8"), 256)
    keyed = docs.withColumn("__digest", digest).withColumn("__size", n_words(F.col("text")))
    narrow = keyed.select("doc_id", "source", F.col("__size").alias("size"))
    planned = written(schedule(written(narrow, "mix-sizes"), seed, weights), "mix-plan")
    taken = mix(planned).select("doc_id", "source", "size", "copy", "start", "virtual_finish", "taken")
    # rows that share doc_id, source and size are told apart by their rank in the start order
    same = ["doc_id", "source", "size"]
    rank = planned.select(*same, "start", F.row_number().over(Window.partitionBy(*same).orderBy("start")).alias("__k"))
    own = keyed.withColumn(
        "__k", F.row_number().over(Window.partitionBy("doc_id", "source", "__size").orderBy("__digest"))
    ).where("__size > 0")
    ranked = taken.alias("t").join(
        rank.alias("r"),
        F.col("t.source").eqNullSafe(F.col("r.source")) & F.col("t.doc_id").eqNullSafe(F.col("r.doc_id"))
        & (F.col("t.start") == F.col("r.start")) & (F.col("t.size") == F.col("r.size")),
    ).select("t.*", "__k")
    both = own.alias("d").join(
        ranked.alias("t"),
        F.col("d.doc_id").eqNullSafe(F.col("t.doc_id")) & F.col("d.source").eqNullSafe(F.col("t.source"))
        & (F.col("d.__size") == F.col("t.size")) & (F.col("d.__k") == F.col("t.__k")),
    )
    pieces = F.split(F.col("d.text"), f"(?<=[^{WORD_SPACE}])(?=[{WORD_SPACE}])")
    cut = F.array_join(F.slice(pieces, F.lit(1), F.col("t.taken").cast("int")), "")
    text = F.when(F.col("t.taken") < F.col("t.size"), cut).otherwise(F.col("d.text"))
    out = {c: F.col(f"d.{c}") for c in docs.columns} | {"text": text}
    if "n_chars" in out:
        out["n_chars"] = F.length(text).cast(docs.schema["n_chars"].dataType)
    return both.orderBy("t.virtual_finish", F.col("d.source").asc_nulls_last(), "d.doc_id", "t.copy").select(
        *[c.alias(k) for k, c in out.items()]
    )


def op4_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    planned = written(schedule(written(document_sizes(docs), "mix-sizes")), "mix-plan")
    made = written(mix(planned).select("source", "start", "taken", "virtual_finish"), "mix")
    # sizes above 0 give each row of a source a start of its own
    sums = made.groupBy("source", "start").agg(F.sum("taken").alias("taken"))
    pairs = planned.alias("p").join(
        sums.alias("t"),
        F.col("p.source").eqNullSafe(F.col("t.source")) & (F.col("p.start") == F.col("t.start")) & (F.col("size") > 0),
        "left",
    )
    return pairs.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


#: The same mix in SQL: targets by filling the sources in the order of cap over weight.
OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight
  FROM d GROUP BY source
), f AS (
  SELECT *, sum(source_size) OVER () AS total,
         coalesce(sum(3 * source_size) OVER (ORDER BY 3 * source_size / weight::DOUBLE, source NULLS LAST
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used,
         sum(weight) OVER (ORDER BY 3 * source_size / weight::DOUBLE, source NULLS LAST
                  ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest
  FROM s
), w AS (
  SELECT max((total - used) / rest::DOUBLE) AS share FROM f
), t AS (
  SELECT source, source_size, least(3.0::DOUBLE * source_size, weight * coalesce(share, 0)) AS target FROM f, w
), o AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
         coalesce(sum(d.size) OVER (PARTITION BY d.source
           ORDER BY ('0x' || substr(md5('0:' || coalesce(d.doc_id::VARCHAR, '')), 1, 15))::BIGINT, d.doc_id, d.size
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       CAST(greatest(0, least(size, floor(target) - start))
          + greatest(0, least(size, floor(target) - start - source_size))
          + greatest(0, least(size, floor(target) - start - 2 * source_size)) AS BIGINT) AS taken
FROM o
"""
