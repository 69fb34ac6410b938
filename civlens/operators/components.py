"""Connected components over an edge table, by hooking roots and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civlens.session import ensure_checkpoint_dir

#: Rows of one hot label are dealt over so many keys where labels are looked up.
SALTS = 32


def fixed(df: DataFrame) -> DataFrame:
    """``df`` cut from its lineage by a checkpoint in the folder that the session names."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def followed(hooks: DataFrame) -> DataFrame:
    """Each root ``r`` of a forest (r -> q, q < r) with the end of its chain: the length of what a
    pointer jumps over doubles in each round."""
    while True:
        further = hooks.select(F.col("r").alias("q"), F.col("q").alias("__end"))
        jumped = fixed(hooks.join(further, "q", "left").select("r", F.coalesce("__end", "q").alias("q"), F.col("__end").isNotNull().alias("__moved")))
        moved = not jumped.where("__moved").isEmpty()
        hooks = jumped.select("r", "q")
        if not moved:
            return hooks


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that the edges (u, v) lead to, for each row of ``nodes``
    (node, unique). Ids may be of any ordered type.

    Each round looks up the labels of both ends of the edges that still join different labels, hooks
    every label onto the smallest one next to it and follows the chains. At least every second label
    with a neighbour goes in a round, so the rounds grow with the logarithm of the nodes. Edges keep
    the degree they came with; labels, of which one may hold most nodes, are looked up by salted keys.
    """
    labels = fixed(nodes.select("node", F.col("node").alias("component")))
    edges = edges.where("u <> v").select("u", "v")
    while True:
        of = lambda end: labels.select(F.col("node").alias(end), F.col("component").alias(f"of_{end}"))  # noqa: E731, B023
        edges = fixed(edges.join(of("u"), "u").join(of("v"), "v").where("of_u <> of_v").select("u", "v", "of_u", "of_v"))
        if edges.isEmpty():
            return labels
        hooks = edges.groupBy(F.greatest("of_u", "of_v").alias("r")).agg(F.min(F.least("of_u", "of_v")).alias("q"))
        hooks = followed(fixed(hooks)).withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salted = labels.withColumn("__salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int"))
        found = salted.join(hooks, (salted.component == hooks.r) & (salted["__salt"] == hooks["__salt"]), "left")
        labels = fixed(found.select("node", F.coalesce("q", "component").alias("component")))
        edges = edges.select("u", "v")
