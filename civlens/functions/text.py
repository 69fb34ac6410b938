"""String, JSON and map column expressions (T-01..T-05, T-09..T-13)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# French report category -> English label (10 entries). Unknown -> null.
CATEGORY_FR_TO_EN = {
    "Activités commerciales et professionnelles": "commercial_activities",
    "Autos, motos, vélos...": "vehicles",
    "Graffitis, tags, affiches et autocollants": "graffities",
    "Mobiliers urbains": "street_furniture",
    "Objets abandonnés": "abandon_objects",
    "Propreté": "cleanliness",
    "Voirie et espace public": "public_space",
    "Éclairage / Électricité": "public_lightning",
    "Arbres, végétaux et animaux": "vegetation_animals",
    "Eau": "water_service",
}

# Unicode whitespace at either end (Spark's trim only removes spaces).
_EDGE_SPACE = r"(?U)^\s+|\s+$"


def utrim(c: Column) -> Column:
    """T-03: trim Unicode whitespace (spaces, tabs, newlines, NBSP) at both ends."""
    return F.regexp_replace(c, _EDGE_SPACE, "")


def parse_soustype(c: Column) -> Column:
    """T-01: "main : extra [] ..." -> struct(main, extra).

    Literal "[]" removed, split on ':', parts 1 and 2 trimmed, later parts ignored.
    No colon -> extra is null. Null input -> both null.
    """
    cleaned = F.replace(c, F.lit("[]"), F.lit(""))
    parts = F.split(cleaned, ":")
    main = utrim(F.get(parts, 0))
    extra = F.when(F.size(parts) > 1, utrim(F.get(parts, 1)))
    return F.when(c.isNull(), F.struct(F.lit(None).cast("string").alias("main"),
                                       F.lit(None).cast("string").alias("extra"))).otherwise(
        F.struct(main.alias("main"), extra.alias("extra"))
    )


def translate_category(c: Column, mapping: dict[str, str] | None = None) -> Column:
    """T-02: literal-map lookup after trim; unknown or null -> null."""
    mapping = mapping or CATEGORY_FR_TO_EN
    kv = []
    for k, v in mapping.items():
        kv += [F.lit(k), F.lit(v)]
    return F.try_element_at(F.create_map(*kv), utrim(c))


def postcode_long(code: Column, template: str = "75000") -> Column:
    """T-04: overwrite the tail of the template with the code ("5" -> "75005");
    a code as long as the template or longer is returned as is."""
    s = code.cast("string")
    n = F.length(s)
    keep = F.greatest(F.lit(len(template)) - n, F.lit(0))
    return F.concat(F.left(F.lit(template), keep), s)


def suffix_ids(c: Column, ids: list[str], suffix: str = "_OLD") -> Column:
    """T-05: rename merged ids (1..4 -> 1_OLD ..), others unchanged."""
    s = c.cast("string")
    return F.when(s.isin(*ids), F.concat(s, F.lit(suffix))).otherwise(s)


def first_of_list(c: Column, sep: str = ";") -> Column:
    """T-09: first element of a ';'-separated tag value, null when missing."""
    return F.get(F.split(c, sep), 0)


def normalise_apostrophes(c: Column) -> Column:
    """T-10: the typographic apostrophe to ASCII."""
    return F.translate(c, "’", "'")


def is_ascii(c: Column) -> Column:
    """T-12: true when every character is ASCII."""
    return c.rlike(r"^[\x00-\x7F]*$")


def json_field(c: Column, path: str) -> Column:
    """T-13: one field of JSON text."""
    return F.get_json_object(c, path)
