"""File sources (S-01, S-02, S-05..S-09, S-16).

All readers take explicit schemas or read text columns and cast with ``try_cast``, so no
inference pass runs over the data. Files of one header are one Spark read; only the header line of
each file is looked at while the query is built.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from civlens.functions import geo, text

BOM = "\ufeff"
#: The byte order mark as ISO-8859-1 reads it.
BOM_BYTES = "\xef\xbb\xbf"


def _bare(name: str) -> str:
    return name.removeprefix(BOM).removeprefix(BOM_BYTES)


def _strip_bom(df: DataFrame) -> DataFrame:
    return df.withColumnRenamed(df.columns[0], _bare(df.columns[0]))


def _files(spark: SparkSession, paths: Sequence[str]) -> list[str]:
    """The data files that paths (files, folders or globs) name, through Hadoop's file systems."""
    out = []
    hadoop = spark._jvm.org.apache.hadoop.fs
    for path in paths:
        where = hadoop.Path(path)
        fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
        found = fs.globStatus(where)
        if not found:
            raise FileNotFoundError(path)
        for status in found:
            inside = fs.listStatus(status.getPath()) if status.isDirectory() else [status]
            out += [x.getPath().toString() for x in inside if not x.isDirectory() and x.getPath().getName()[0] not in "._"]
    return out


def _decoded(c: Column) -> Column:
    """Text whose bytes were read as ISO-8859-1: as UTF-8 if they are valid in it."""
    raw = F.encode(c, "ISO-8859-1").cast("string")
    return F.when(F.is_valid_utf8(raw), raw).otherwise(c)


def read_delimited(
    spark: SparkSession,
    paths: str | Sequence[str],
    sep: str = ";",
    decimal: str = ",",
    numeric: Sequence[str] = (),
    schema: Mapping[str, str] | None = None,
    encoding: str | None = None,
    quoted_newlines: bool = False,
) -> DataFrame:
    """S-01 / S-02 / S-05 / S-06: delimited text files with a header each.

    Files may differ in their columns: those of one header are read together and the parts are
    unioned by name, with nulls for what a file lacks. Every column is text; ``numeric`` columns
    get the decimal mark replaced and become doubles, and ``schema`` (column to type) pins others;
    a value that doesn't fit is null. Without ``encoding`` a value is UTF-8 if its bytes are valid
    UTF-8 and ISO-8859-1 otherwise, in the same pass. ``quoted_newlines`` keeps line breaks inside
    quotes; such files can't be split, so each one is a task.

    Adds ``_file_name`` and ``_seq``, the source order: (file name, row number within the read).
    """
    options = {"header": True, "sep": sep, "quote": '"', "escape": '"', "multiLine": quoted_newlines}
    reader = spark.read.options(encoding=encoding or "ISO-8859-1", **options)
    groups: dict[tuple, list[str]] = {}
    for path in _files(spark, [paths] if isinstance(paths, str) else paths):
        groups.setdefault(tuple(reader.csv(path).columns), []).append(path)
    out = None
    for names, files in groups.items():
        part = reader.schema(T.StructType([T.StructField(c, T.StringType()) for c in names])).csv(files)
        file_name = F.col("_metadata.file_name")
        columns = [(F.col(f"`{c}`") if encoding else _decoded(F.col(f"`{c}`"))) for c in names]
        labels = [_bare(c) if encoding else _bare(c.encode("iso-8859-1").decode("utf-8", "replace")) for c in names]
        if not encoding:
            labels = [c if "\ufffd" not in c else _bare(n) for c, n in zip(labels, names, strict=True)]
        part = part.select(
            *[c.alias(n) for c, n in zip(columns, labels, strict=True)],
            file_name.alias("_file_name"),
            F.struct(file_name.alias("file"), F.monotonically_increasing_id().alias("row")).alias("_seq"),
        )
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    for c in numeric:
        if c in out.columns:
            out = out.withColumn(c, F.replace(F.col(c), F.lit(decimal), F.lit(".")).try_cast("double"))
    for c, kind in (schema or {}).items():
        out = out.withColumn(c, F.col(c).try_cast(kind) if c in out.columns else F.lit(None).cast(kind))
    return out


def year_from_file(file_col: str = "_file_name", pattern: str = r"(\d{4})") -> F.Column:
    """S-02: year of a yearly file from its name (DMR_2021.csv -> 2021)."""
    return F.regexp_extract(F.col(file_col), pattern, 1).try_cast("int")


def read_columns(spark: SparkSession, paths: str | Sequence[str], columns: Sequence[str], sep: str = ";") -> DataFrame:
    """S-07: many text files by glob, only ``columns`` kept, found by name in each file's header; a
    file without one of them gives nulls."""
    df = read_delimited(spark, paths, sep)
    return df.select(*[F.col(f"`{c}`") if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns])


def read_geojson_features(spark: SparkSession, path: str) -> DataFrame:
    """S-08: GeoJSON FeatureCollection files -> one row per feature with its properties
    flattened, ``geometry`` as GeoJSON text, a multipolygon column ``geom``, its ``wkt``, and
    ``lat`` / ``lon`` where the properties hold a ``geom_x_y`` point."""
    fc = spark.read.option("multiLine", True).option("primitivesAsString", False).json(path)
    feats = fc.select(F.explode("features").alias("f"))
    props = feats.select("f.properties.*", F.to_json("f.geometry").alias("geometry"))
    props = props.withColumn("geom", geo.geojson_to_multipolygon(F.col("geometry")))
    props = props.withColumn("wkt", geo.multipolygon_to_wkt(F.col("geom")))
    if "geom_x_y" in props.columns:
        props = props.withColumn("lon", F.col("geom_x_y.lon")).withColumn("lat", F.col("geom_x_y.lat"))
    return props


OSM_ELEMENT_SCHEMA = T.StructType([
    T.StructField("elements", T.ArrayType(T.StructType([
        T.StructField("type", T.StringType()),
        T.StructField("id", T.LongType()),
        T.StructField("lat", T.DoubleType()),
        T.StructField("lon", T.DoubleType()),
        T.StructField("center", T.StructType([T.StructField("lat", T.DoubleType()), T.StructField("lon", T.DoubleType())])),
        T.StructField("geometry", T.ArrayType(T.StructType([T.StructField("lat", T.DoubleType()),
                                                            T.StructField("lon", T.DoubleType())]))),
        T.StructField("members", T.ArrayType(T.StructType([
            T.StructField("lat", T.DoubleType()),
            T.StructField("lon", T.DoubleType()),
            T.StructField("geometry", T.ArrayType(T.StructType([T.StructField("lat", T.DoubleType()),
                                                                T.StructField("lon", T.DoubleType())])))]))),
        T.StructField("tags", T.MapType(T.StringType(), T.StringType())),
    ])))
])


def read_osm_elements(spark: SparkSession, path: str, key: str) -> DataFrame:
    """S-09 / T-09..T-11: OSM JSON export -> id, lat, lon, category, subcategory, name,
    geometry (WKT).

    An element with more than 2 members is the MULTIPOINT of its members' centroids, at their mean; a
    point is itself; another shape is the point of its centroid (of the area of a closed ring, else of
    the line), or of its centre if the export has no geometry.
    """
    doc = spark.read.option("multiLine", True).schema(OSM_ELEMENT_SCHEMA).json(path)
    el = doc.select(F.explode("elements").alias("e")).select("e.*")

    def shape_centroid(points: Column) -> Column:
        line = F.transform(points, lambda p: geo.pt(p["lon"], p["lat"]))
        closed = (F.size(line) > 3) & (F.get(line, 0) == F.get(line, F.size(line) - 1))
        inside = geo.centroid(F.array(F.array(line)))
        return F.when(geo.line_length(line) == 0, F.get(line, 0)).when(closed & inside["x"].isNotNull(), inside).otherwise(geo.line_centroid(line))

    # a member is a point or a line; one without either is skipped
    placed = F.filter("members", lambda m: m["lat"].isNotNull() | (F.size(m["geometry"]) > 0))
    member_centroids = F.transform(placed, lambda m: F.when(m["lat"].isNotNull(), geo.pt(m["lon"], m["lat"])).otherwise(
        shape_centroid(m["geometry"])))
    many = (F.size("members") > 2) & (F.size(placed) > 0)
    c = (
        F.when(many, geo.points_centroid(member_centroids))
        .when(F.col("lat").isNotNull(), geo.pt(F.col("lon"), F.col("lat")))
        .when(F.size("geometry") > 0, shape_centroid(F.col("geometry")))
        .when(F.col("center").isNotNull(), geo.pt(F.col("center.lon"), F.col("center.lat")))
    )
    out = el.withColumn("__c", c).withColumn("__many", F.when(many, geo.multipoint_to_wkt(member_centroids)))
    return out.select(
        F.col("id").cast("string").alias("id_"),
        F.col("__c.y").alias("lat"),
        F.col("__c.x").alias("lon"),
        F.lit(key).alias("category"),
        text.first_of_list(F.col("tags")[key]).alias("subcategory"),
        text.normalise_apostrophes(F.col("tags")["name"]).alias("name"),
        F.coalesce("__many", F.when(F.col("__c").isNotNull(), geo.point_to_wkt(F.col("__c.x"), F.col("__c.y")))).alias("geometry"),
    )


# Report status descriptions, ids 1..12 in this order.
ETAT_DESCRIPTIONS = [
    "Service fait", "Rejeté", "Nouveau", "Transféré à un tiers", "Service programmé", "Sous surveillance",
    "A traiter", "Service programmé tiers", "A requalifier", "A faire terrain", "A faire bureau",
    "Echec d'envoi par WS",
]


def etat_dimension(spark: SparkSession) -> DataFrame:
    """S-16: literal status dimension (etat_id 1..12, description)."""
    return spark.createDataFrame(list(enumerate(ETAT_DESCRIPTIONS, start=1)), "etat_id int, description string")
