"""Readers, sinks, fuzzy scores and the correction ladder."""

import json
import random

import pytest
from pyspark.sql import functions as F

from civlens.functions import fuzzy
from civlens.operators import fuzzy_correct as FC
from civlens.sources import readers, sinks


def _lcs_dp(a, b):
    prev = [0] * (len(b) + 1)
    for ca in a:
        cur = [0]
        for j, cb in enumerate(b):
            cur.append(prev[j] + 1 if ca == cb else max(prev[j + 1], cur[j]))
        prev = cur
    return prev[-1]


def test_lcs_bit_parallel_equals_dp():
    random.seed(0)
    for _ in range(500):
        a = "".join(random.choice("abcé ") for _ in range(random.randint(0, 12)))
        b = "".join(random.choice("abcé ") for _ in range(random.randint(0, 12)))
        assert fuzzy.lcs_length(a, b) == _lcs_dp(a, b)


def test_ratio_and_partial_ratio():
    assert fuzzy.ratio("abc", "abc") == 100
    assert fuzzy.ratio("", "abc") == 0
    assert fuzzy.ratio("abcd", "abce") == 75
    assert fuzzy.partial_ratio("graffiti", "tags et graffiti sur mur") == 100
    assert fuzzy.default_process("  Objets-Abandonnés! ") == "objets abandonnés"


def test_correction_ladder(spark):
    official = spark.createDataFrame(
        [("Propreté", "Déchets"), ("Propreté", "Déjections canines"), ("Objets abandonnés", "Meubles")],
        "category_FR string, name_FR string")
    rows = [("Propreté", "dechets"), ("Propreté", "Hors champs"), ("Propreté", "zzzz"),
            ("Objets abandonnés", "Objets infestés!"), ("Eau", "fuite"), ("Propreté", None)]
    df = spark.createDataFrame(rows, "category_FR string, subcategory_FR string")
    got = {(r.category_FR, r.t): r.subcategory_FR for r in FC.correct_subcategories(
        df.withColumn("t", F.col("subcategory_FR")), official).collect()}
    assert got[("Propreté", "dechets")] == "Déchets"
    assert got[("Propreté", "Hors champs")] == "Hors champ de compétence"
    assert got[("Propreté", "zzzz")] == "Autres"
    # any nonzero score on the second abandoned-object test wins (parity rule)
    assert got[("Objets abandonnés", "Objets infestés!")] == "Autres objets encombrants abandonnés"
    assert got[("Eau", "fuite")] == "Autres"  # no official list for the category
    assert got[("Propreté", None)] is None


def test_read_delimited_with_fallback_encoding(spark, tmp_path):
    (tmp_path / "DMR_2021.csv").write_bytes("﻿ID;X;TYPE\n1;2,5;Propreté\n".encode("utf-8"))
    (tmp_path / "DMR_2022.csv").write_bytes("ID;X;TYPE\n2;3,25;Propreté\n".encode("latin-1"))
    df = readers.read_delimited(spark, [str(tmp_path / "DMR_2021.csv"), str(tmp_path / "DMR_2022.csv")],
                                numeric=["X"])
    rows = sorted((r.ID, r.X, r.TYPE, r._file_name) for r in df.collect())
    assert rows == [("1", 2.5, "Propreté", "DMR_2021.csv"), ("2", 3.25, "Propreté", "DMR_2022.csv")]
    years = sorted(r[0] for r in df.select(readers.year_from_file()).collect())
    assert years == [2021, 2022]


def test_geojson_and_osm_readers(spark, tmp_path):
    fc = ('{"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"c_ar": 5, "l_ar": "5e"},'
          ' "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 1], [0, 0]]]}}]}')
    (tmp_path / "a.geojson").write_text(fc)
    g = readers.read_geojson_features(spark, str(tmp_path / "a.geojson")).first()
    assert g.c_ar == 5 and g.l_ar == "5e" and len(g.geom[0][0]) == 5
    osm = ('{"elements": [{"type": "node", "id": 1, "lat": 48.8, "lon": 2.3, "tags": {"shop": "bakery;cafe",'
           ' "name": "Chez l’ami"}}, {"type": "way", "id": 2, "center": {"lat": 48.9, "lon": 2.4}, "tags": {"shop": "books"}}]}')
    (tmp_path / "o.json").write_text(osm)
    rows = sorted(readers.read_osm_elements(spark, str(tmp_path / "o.json"), "shop").collect(), key=lambda r: r.id_)
    assert (rows[0].subcategory, rows[0].name, rows[0].geometry) == ("bakery", "Chez l'ami", "POINT (2.3 48.8)")
    assert (rows[1].lat, rows[1].lon, rows[1].category) == (48.9, 2.4, "shop")


def test_sinks(spark, tmp_path):
    from pyspark.sql import types as T

    df = spark.createDataFrame([("a", 2021), ("bb", 2022)], "s string, year int")
    schema = T.StructType([T.StructField("s", T.StringType())])
    sinks.write_typed_table(df, str(tmp_path / "t"), schema, varchar_limits={"s": 5})
    back = spark.read.parquet(str(tmp_path / "t"))
    assert sorted((r.s, r.year) for r in back.collect()) == [("a", 2021), ("bb", 2022)]
    with pytest.raises(Exception, match="longer than 1"):
        sinks.write_typed_table(df, str(tmp_path / "t2"), schema, varchar_limits={"s": 1})
    sinks.write_new_table(df, str(tmp_path / "n"))
    with pytest.raises(Exception):
        sinks.write_new_table(df, str(tmp_path / "n"))
    assert readers.etat_dimension(spark).count() == 12


def test_yearly_files_with_different_headers_to_clean_table(spark, tmp_path):
    """CSV to partitioned Parquet: other headers by year, a Latin-1 file, a folder with a space, a
    quoted line break, a repeated id (the last row counts), a report without a postcode."""
    from civlens.plans.cleaning import CLEAN_SCHEMA, clean_reports

    folder = tmp_path / "années brutes"
    folder.mkdir()
    (folder / "DMR_2020.csv").write_bytes(
        "\ufeffID_DMR;TYPE;SOUSTYPE;DATEDECL;X;Y;OID_\n1;Propreté;Déchets;2020-03-01 10:00:00;2,3;48,85;9\n"
        "2;Propreté;Déchets;2020-03-02 10:00:00;9,9;48,85;9\n".encode()
    )
    (folder / "DMR_2021.csv").write_bytes(
        'ID_DMR;TYPE;SOUSTYPE;ADRESSE;DATEDECL;ETAT;X;Y\n3;Propreté;Déchets;"1 rue\nhaute";04/05/2021 10:00;Nouveau;2,3;48,86\n'
        "4;Eau;Fuite;x;04/05/2021 11:00;Nouveau;;\n".encode("latin-1")
    )
    (folder / "DMR_2022.csv").write_bytes(
        "ID_DMR;TYPE;SOUSTYPE;ADRESSE;DATEDECL;ETAT;X;Y\n3;Propreté;dechets;b;01/01/2022 09:00:00;Rejeté;2,3;48,86\n".encode()
    )
    raw = readers.read_delimited(spark, str(folder / "*.csv"), numeric=["X", "Y"], quoted_newlines=True)
    got = {r.ID_DMR + r._file_name: r for r in raw.collect()}
    assert got["1DMR_2020.csv"].ETAT is None and got["1DMR_2020.csv"].X == 2.3
    assert got["3DMR_2021.csv"].ADRESSE == "1 rue\nhaute" and got["3DMR_2021.csv"].TYPE == "Propreté"
    ring = "array(array(array(struct(2.2D as x, 48.8D as y), struct(2.4D as x, 48.8D as y), struct(2.4D as x, 48.9D as y), struct(2.2D as x, 48.9D as y), struct(2.2D as x, 48.8D as y))))"
    districts = spark.range(1).selectExpr("'q1' quartier_id", "'75001' code_postal_id", f"{ring} geometry")
    official = spark.createDataFrame([("Propreté", "Déchets")], "category_FR string, name_FR string")
    cleaned = clean_reports(raw, districts, official)
    sinks.write_typed_table(cleaned, str(tmp_path / "clean"), CLEAN_SCHEMA, varchar_limits={"etat": 20})
    back = {r.id_dmr: r for r in spark.read.parquet(str(tmp_path / "clean")).collect()}
    assert set(back) == {"1", "3"}
    assert (back["3"].year, back["3"].etat, back["3"].subcategory_FR) == (2022, "Rejeté", "Déchets")
    assert (back["1"].quartier_id, back["1"].code_postal_id) == ("q1", "75001")


def test_osm_members_without_geometry_are_skipped(spark, tmp_path):
    osm = ('{"elements": [{"type": "relation", "id": 3, "tags": {"shop": "mall"}, "members": [{"lat": 1.0, "lon": 2.0},'
           ' {"type": "way"}, {"geometry": [{"lat": 3.0, "lon": 4.0}, {"lat": 3.0, "lon": 4.0}]}]}]}')
    (tmp_path / "m.json").write_text(osm)
    row = readers.read_osm_elements(spark, str(tmp_path / "m.json"), "shop").first()
    assert (row.lat, row.lon, row.geometry) == (2.0, 3.0, "MULTIPOINT ((2.0 1.0), (4.0 3.0))")


def test_osm_shapes(spark, tmp_path):
    ring = [(0, 0), (4, 0), (4, 1), (1, 1), (1, 4), (0, 4), (0, 0)]
    points = lambda of: [{"lon": float(x), "lat": float(y)} for x, y in of]
    elements = [
        {"id": 1, "geometry": points(ring), "center": {"lat": 9.0, "lon": 9.0}},
        {"id": 2, "geometry": points([(0, 0), (3, 0), (3, 1)])},
        {"id": 3, "geometry": points([(2, 2), (2, 2), (2, 2), (2, 2)])},
        {"id": 4, "members": [{"lat": 1.0, "lon": 1.0}, {"lat": 3.0, "lon": 3.0}], "center": {"lat": 7.0, "lon": 8.0}},
    ]
    (tmp_path / "s.json").write_text(json.dumps({"elements": elements}))
    rows = {r.id_: r for r in readers.read_osm_elements(spark, str(tmp_path / "s.json"), "shop").collect()}
    # an L of the areas 4 and 3, centred at (2, 0.5) and (0.5, 2.5)
    assert abs(rows["1"].lon - 9.5 / 7) < 1e-12 and abs(rows["1"].lat - 9.5 / 7) < 1e-12
    assert abs(rows["2"].lon - (1.5 * 3 + 3) / 4) < 1e-12 and abs(rows["2"].lat - 0.5 / 4) < 1e-12
    assert rows["3"].geometry == "POINT (2.0 2.0)" and rows["4"].geometry == "POINT (8.0 7.0)"


def test_columns_of_many_files_by_name(spark, tmp_path):
    (tmp_path / "a.txt").write_text("iu_ac;t_1h;q\n1;2020-01-01;5\n")
    (tmp_path / "b.txt").write_text("q;iu_ac\n7;2\n8;3\n")
    rows = readers.read_columns(spark, str(tmp_path / "*.txt"), ["iu_ac", "q", "t_1h"]).collect()
    assert sorted(map(tuple, rows)) == [("1", "5", "2020-01-01"), ("2", "7", None), ("3", "8", None)]
