"""Sub-category correction against official lists (T-06, T-08).

Distinct (category, text) pairs are compared with the official names of their category. A text that
holds a name, or that a name holds, scores 100 by definition and is settled by built-in functions;
the others are scored against the names that their letters do not rule out; the best name wins from
MATCH_THRESHOLD on. Below it, a small table of rules (category, pattern, label) decides, then the
category's fallback. Results are joined back on (category, text); Python never runs per report.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from civlens.functions import fuzzy
from civlens.operators.joins import with_group_row

MATCH_THRESHOLD = 70
#: Texts and names of a category that meet in one task.
TEXTS_CHUNK, NAMES_CHUNK = 4096, 1024
OTHER = "Autres"

#: Category (empty: any), text to compare with, label of a text that is close to it.
#: The first rule that holds decides.
RULES = [
    ("", "a requalifier", "A requalifier"),
    ("Objets abandonnés", "Objets abandonnés rubalisés", "Autres objets encombrants abandonnés"),
    ("Objets abandonnés", "Objets appartenant à des personnes à la rue", "Autres objets encombrants abandonnés"),
    ("Objets abandonnés", "Objets infestés", "Objets infestés de punaises de lit"),
    ("Graffitis, tags, affiches et autocollants", "...sur [a-z]",
     "Affiches, autocollants ou graffitis sur autres supports"),
    ("Graffitis, tags, affiches et autocollants", "Affiche à plus de ",
     "Affiches, autocollants ou graffitis sur autres supports"),
    ("Graffitis, tags, affiches et autocollants", "Graffitis à plus de ",
     "Affiches, autocollants ou graffitis sur autres supports"),
    ("Graffitis, tags, affiches et autocollants", "circonscription fonctionnelle",
     "Affiches ou graffitis à traiter per Circonscription Fonctionnelle"),
    ("Propreté", "Hors champ", "Hors champ de compétence"),
]
#: Label of a category's texts that no rule takes.
FALLBACKS = {
    "Objets abandonnés": "Autres objets encombrants abandonnés",
    "Graffitis, tags, affiches et autocollants": "Affiches, autocollants ou graffitis sur autres supports",
    "Propreté": OTHER,
}
#: Fixed value: in categories without a fallback, a text close to this is OTHER; else the best name stays.
LAST_RULE = "autre problème "
#: Rules that any likeness at all satisfies unless ``strict`` (Q-07).
LOOSE = {"Objets appartenant à des personnes à la rue"}


def label_below_threshold(category: str, text: str, best: str, strict: bool = False) -> str:
    """Label of a text whose best official name scores below MATCH_THRESHOLD."""
    for rule_category, pattern, label in RULES:
        if rule_category in ("", category):
            least = 0 if pattern in LOOSE and not strict else MATCH_THRESHOLD
            if fuzzy.ratio(text, pattern) > least:
                return label
    if category in FALLBACKS:
        return FALLBACKS[category]
    return OTHER if fuzzy.ratio(text, LAST_RULE) > MATCH_THRESHOLD else best


def best_names(texts: DataFrame, official: DataFrame) -> DataFrame:
    """(__cat, __txt, __name, __score): the name of the text's category (of ``official``: __cat, __name,
    __ord) with the highest partial score, the smallest (__ord, __name) of equal ones. ``texts`` are
    distinct (__cat, __txt).

    Texts and names of a category meet in chunks of bounded size; in each, a text is scored only
    against names whose letters and letter pairs let them reach its best score so far.
    """
    parts = lambda df, size, n: df.groupBy("__cat").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias(n))
    sizes = parts(texts, TEXTS_CHUNK, "__turns").join(parts(official, NAMES_CHUNK, "__blocks"), "__cat")
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = with_group_row(texts, sizes, ["__cat"], "__txt").select(
        "__cat", "__txt", deal("__txt", "__turns").alias("__turn"), every("__blocks").alias("__block")
    )
    right = with_group_row(official, sizes, ["__cat"], "__name").select(
        "__cat", "__name", "__ord", deal("__name", "__blocks").alias("__block"), every("__turns").alias("__turn")
    )
    kind = official.schema["__ord"].dataType
    schema = T.StructType([T.StructField("__cat", T.StringType()), T.StructField("__txt", T.StringType()), T.StructField("__name", T.StringType()),
                           T.StructField("__ord", kind), T.StructField("__score", T.IntegerType())])

    def choose(some: pd.DataFrame, of: pd.DataFrame) -> pd.DataFrame:
        of = of.sort_values(["__ord", "__name"], ignore_index=True)
        names = fuzzy.Names(of["__name"].tolist())
        found = [names.best(t)[:2] for t in some["__txt"]] if len(of) else []
        chosen = of.iloc[[i for _, i in found]].reset_index(drop=True)
        out = some[["__cat", "__txt"]].iloc[: len(found)].reset_index(drop=True)
        return out.assign(__name=chosen["__name"], __ord=chosen["__ord"], __score=[s for s, _ in found])

    group = ["__cat", "__block", "__turn"]
    met = left.groupBy(*group).cogroup(right.groupBy(*group)).applyInPandas(choose, schema)
    first = Window.partitionBy("__cat", "__txt").orderBy(F.desc("__score"), "__ord", "__name")
    return met.withColumn("__rn", F.row_number().over(first)).where("__rn = 1").select("__cat", "__txt", "__name", "__score")


def correct_subcategories(
    df: DataFrame,
    official: DataFrame,
    category: str = "category_FR",
    text: str = "subcategory_FR",
    name: str = "name_FR",
    order: str | None = None,
    out: str = "subcategory_FR",
    strict: bool = False,
) -> DataFrame:
    """T-06 / T-08: replace ``text`` by its corrected official sub-category.

    ``official`` holds (category, name[, order]); ties on the score go to the smallest
    ``order`` (default: the name). Categories with no official list get "Autres";
    groups with a null category keep a null result (Q-08).
    """
    order = order or name
    off = official.select(F.col(category).alias("__cat"), F.col(name).alias("__name"), F.col(order).alias("__ord"))
    pairs = df.select(F.col(category).alias("__cat"), F.col(text).alias("__txt")).distinct()
    told = pairs.where("__cat is not null and __txt is not null and __txt <> ''")
    # names of one category are few by nature; a pair meets each name of its own category once
    plain = lambda c: F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", " "))
    met = told.withColumn("__t", plain(F.col("__txt"))).join(off.withColumn("__n", plain(F.col("__name"))), "__cat")
    held = (F.col("__t") != "") & (F.col("__n") != "") & (F.contains("__t", "__n") | F.contains("__n", "__t"))
    first = F.min(F.struct("__ord", "__name"))["__name"]
    exact = met.where(held).groupBy("__cat", "__txt").agg(first.alias("__fixed"))
    best = best_names(told.join(exact, ["__cat", "__txt"], "left_anti"), off)

    @F.pandas_udf("string")
    def labelled(cats: pd.Series, texts: pd.Series, names: pd.Series, scores: pd.Series) -> pd.Series:
        rows = zip(cats, texts, names, scores, strict=True)
        return pd.Series([n if s >= MATCH_THRESHOLD else label_below_threshold(c, t, n, strict) for c, t, n, s in rows], dtype="object")

    fixed = best.select("__cat", "__txt", labelled("__cat", "__txt", "__name", "__score").alias("__fixed"))
    fixed = fixed.union(exact)
    has_list = off.select("__cat").distinct().withColumn("__has", F.lit(True))
    lookup = pairs.join(has_list, "__cat", "left").join(fixed, ["__cat", "__txt"], "left")
    lookup = lookup.select(
        "__cat", "__txt",
        F.when(F.col("__cat").isNull(), F.lit(None).cast("string"))
        .when(F.col("__has").isNull(), F.lit(OTHER))
        .otherwise(F.col("__fixed")).alias("__fixed"),
    )
    joined = df.join(lookup, (df[category].eqNullSafe(lookup["__cat"])) & (df[text].eqNullSafe(lookup["__txt"])), "left")
    return joined.drop(text, "__cat", "__txt").withColumnRenamed("__fixed", out)
