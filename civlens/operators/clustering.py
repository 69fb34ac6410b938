"""SP-16: density clustering (DBSCAN) of geographic points by great-circle distance.

The sphere is cut into rows of latitude and each row into equal columns, so that any two points of one
cell lie within eps. Consequences that keep the work near linear:

  * equal locations are counted first, a location is one weighted row;
  * a cell that holds ``min_samples`` points needs no distance at all: all its points are core. Only
    points of thinner cells count their neighbours, so each point is met by fewer than ``min_samples``
    points of each of about 24 cells near it;
  * the core points of a cell form one node. Two nodes are linked if two of their points lie within
    eps; crowded pairs of nodes are settled by boxes that are quartered until the boxes' distance or
    two of their points decide, never by all pairs of points;
  * clusters are the components of the nodes; border points take the smallest cluster within eps.

A crowded cell is dealt over chunks of about CHUNK locations in every join.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civlens.operators.components import components, fixed

#: Mean radius of the earth in km that the distance uses (fixed value).
RADIUS_KM = 6371.0088
#: Locations of a cell that meet a point in one task.
CHUNK = 4096
#: Two boxes with so many pairs of locations or fewer are compared point by point.
PAIRS = 4096

PLACE = ["lat", "lon"]


def half_chord(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Square of the half chord between two points (radians): grows with their distance."""
    a, b = F.sin((lat2 - lat1) / 2), F.sin((lon2 - lon1) / 2)
    return a * a + F.cos(lat1) * F.cos(lat2) * b * b


class Grid:
    """Cells of which any two points are within eps: rows of height ``side``, columns no wider."""

    def __init__(self, eps_km: float):
        angle = min(eps_km / RADIUS_KM, math.pi)
        self.limit = math.sin(angle / 2) ** 2  # of half_chord
        self.chord = math.sin(angle / 2)
        self.side = math.sqrt(2) * self.chord

    def row(self, lat: Column) -> Column:
        return F.floor(lat / F.lit(self.side)).cast("long")

    def _lowest(self, row: Column) -> Column:
        """The smallest absolute latitude in a row."""
        return F.when(row >= 0, row * self.side).otherwise(-(row + 1) * self.side)

    def _highest(self, row: Column) -> Column:
        return F.least(F.lit(math.pi / 2), self._lowest(row) + self.side)

    def columns(self, row: Column) -> Column:
        around = F.lit(2 * math.pi) * F.cos(self._lowest(row)) / F.lit(self.side)
        return F.greatest(F.lit(1), F.ceil(around)).cast("long")

    def column(self, lon: Column, row: Column) -> Column:
        turn = lon / F.lit(2 * math.pi)
        n = self.columns(row)
        return F.least(n - 1, F.floor((turn - F.floor(turn)) * n)).cast("long")

    def near(self, cells: DataFrame) -> DataFrame:
        """Rows of ``cells`` (row, col) once for each cell (row2, col2) that may hold points within
        eps of theirs, the cell itself included."""
        rows = cells.withColumn("row2", F.explode(F.sequence(F.col("row") - 2, F.col("row") + 2)))
        row, row2 = F.col("row"), F.col("row2")
        top = F.greatest(self._highest(row), self._highest(row2))
        sine = F.lit(self.chord) / F.cos(top)
        reach = F.when((sine >= 1) | (F.cos(top) <= 0), F.lit(math.pi)).otherwise(2 * F.asin(F.least(F.lit(1.0), sine)))
        width, n2 = F.lit(2 * math.pi) / self.columns(row), self.columns(row2)
        slack = F.lit(1e-9)
        first = F.floor((F.col("col") * width - reach) / F.lit(2 * math.pi) * n2 - slack)
        last = F.floor(((F.col("col") + 1) * width + reach) / F.lit(2 * math.pi) * n2 + slack)
        last = F.least(last, first + n2 - 1)
        return rows.withColumn("col2", F.explode(F.sequence(first, last))).withColumn("col2", F.pmod("col2", self.columns(row2)))


def _locations(points: DataFrame, grid: Grid, key: str, lat: str, lon: str) -> DataFrame:
    """Distinct locations in radians: their cell, weight and smallest id."""
    real = points.where(f"`{lat}` is not null and `{lon}` is not null and not isnan(`{lat}`) and not isnan(`{lon}`)")
    of = real.groupBy((F.radians(lat) + F.lit(0.0)).alias("lat"), (F.radians(lon) + F.lit(0.0)).alias("lon")).agg(
        F.count(F.lit(1)).alias("weight"), F.min(key).alias("id")
    )
    of = of.withColumn("row", grid.row(F.col("lat")))
    return of.withColumn("col", grid.column(F.col("lon"), F.col("row")))


def _chunked(places: DataFrame, cells: DataFrame) -> DataFrame:
    """``places`` (with row, col) dealt over the chunks of their cells (row, col, chunks), as the side
    that is met: row2, col2, chunk and the place."""
    of = places.join(cells.select("row", "col", "chunks"), ["row", "col"])
    chunk = F.pmod(F.xxhash64("lat", "lon"), F.col("chunks")).alias("chunk")
    rest = [c for c in places.columns if c not in ("row", "col")]
    return of.select(F.col("row").alias("row2"), F.col("col").alias("col2"), chunk, *[F.col(c).alias(f"{c}2") for c in rest])


def _met(grid: Grid, thin: DataFrame, others: DataFrame) -> DataFrame:
    """Pairs within eps of the locations of thin cells and of ``others``."""
    cells = others.groupBy("row", "col").agg(F.ceil(F.count(F.lit(1)) / CHUNK).alias("chunks"))
    wide = cells.select(F.col("row").alias("row2"), F.col("col").alias("col2"), "chunks")
    asked = grid.near(thin.select(*PLACE, "row", "col")).join(wide, ["row2", "col2"])
    asked = asked.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    pairs = asked.join(_chunked(others, cells), ["row2", "col2", "chunk"])
    return pairs.where(half_chord(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2")) <= F.lit(grid.limit))


def _gap(low1: Column, high1: Column, low2: Column, high2: Column) -> Column:
    return F.greatest(F.lit(0.0), low2 - high1, low1 - high2)


def _boxes(core: DataFrame, depth: int, grid: Grid) -> DataFrame:
    """Boxes of the core locations of each cell after ``depth`` quarterings: bounds, one of the
    locations and how many there are."""
    return core.groupBy(*_quarter_columns(depth, grid)).agg(
        F.min("lat").alias("s"), F.max("lat").alias("n"), F.min("lon").alias("w"), F.max("lon").alias("e"),
        F.min(F.struct("lat", "lon")).alias("at"), F.count(F.lit(1)).alias("places"),
    )


def _side(boxes: DataFrame, k: int) -> DataFrame:
    return boxes.select(*[F.col(c).alias(f"{c}{k}") for c in boxes.columns])


def linked_cells(core: DataFrame, grid: Grid) -> DataFrame:
    """(u, v) of the cells (structs of row, col) whose core locations come within eps, u < v."""
    cells = core.select("row", "col").distinct()
    pairs = grid.near(cells).where("row2 > row or (row2 = row and col2 > col)")
    pairs = pairs.select(F.col("row").alias("row1"), F.col("col").alias("col1"), "row2", "col2").distinct()
    pairs = pairs.join(_side(cells, 2), ["row2", "col2"], "left_semi")
    key = ["row1", "col1", "row2", "col2"]
    quarter = ["qy1", "qx1", "qy2", "qx2"]
    zero = F.lit(0).cast("long")
    pairs = fixed(pairs.select(*key, *[zero.alias(q) for q in quarter]))
    links, depth = [], 0
    while not pairs.isEmpty():
        boxes = _boxes(core, depth, grid)
        both = pairs.join(_side(boxes, 1), ["row1", "col1", "qy1", "qx1"]).join(_side(boxes, 2), ["row2", "col2", "qy2", "qx2"])
        far = lambda k: F.greatest(F.abs(F.col(f"s{k}")), F.abs(F.col(f"n{k}")))
        dy = F.sin(_gap(F.col("s1"), F.col("n1"), F.col("s2"), F.col("n2")) / 2)
        turns = [_gap(F.col("w1") + t, F.col("e1") + t, F.col("w2"), F.col("e2")) for t in (-2 * math.pi, 0.0, 2 * math.pi)]
        dx = F.sin(F.least(F.lit(math.pi), *turns) / 2)
        least = dy * dy + F.cos(far(1)) * F.cos(far(2)) * dx * dx
        linked = half_chord(F.col("at1.lat"), F.col("at1.lon"), F.col("at2.lat"), F.col("at2.lon")) <= F.lit(grid.limit)
        judged = fixed(
            both.where(least <= F.lit(grid.limit * (1 + 1e-12)))
            .withColumn("linked", linked)
            .withColumn("few", F.col("places1") * F.col("places2") <= PAIRS)
            .select(*key, *quarter, "linked", "few")
        )
        links.append(judged.where("linked").select(*key).distinct())
        rest = judged.join(links[-1], key, "left_anti")
        small = rest.where("few")
        inside = core.select(*_quarter_columns(depth, grid), *PLACE)
        compared = small.join(_side(inside, 1), ["row1", "col1", "qy1", "qx1"]).join(_side(inside, 2), ["row2", "col2", "qy2", "qx2"])
        near = half_chord(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2")) <= F.lit(grid.limit)
        links.append(fixed(compared.where(near).select(*key).distinct()))
        halves = F.array(zero, F.lit(1).cast("long"))
        pairs = rest.where("not few").join(links[-1], key, "left_anti").select(*key, *quarter)
        for q in quarter:
            pairs = pairs.withColumn("__h", F.explode(halves)).withColumn(q, F.col(q) * 2 + F.col("__h")).drop("__h")
        pairs, depth = fixed(pairs), depth + 1
    found = links[0] if links else pairs.select(*key)
    for more in links[1:]:
        found = found.union(more)
    node = lambda k: F.struct(F.col(f"row{k}").alias("row"), F.col(f"col{k}").alias("col"))
    return found.distinct().select(node(1).alias("u"), node(2).alias("v"))


def _quarter_columns(depth: int, grid: Grid) -> list[Column]:
    """row, col, qy, qx of a core location after ``depth`` quarterings."""
    parts = F.lit(float(1 << depth))
    turn = F.col("lon") / F.lit(2 * math.pi)
    along = (turn - F.floor(turn)) * grid.columns(F.col("row"))
    up = F.col("lat") / F.lit(grid.side)
    return [
        F.col("row"), F.col("col"),
        F.floor((up - F.floor(up)) * parts).alias("qy"),
        F.least(parts - 1, F.floor((along - F.col("col")) * parts)).cast("long").alias("qx"),
    ]


def dbscan(points: DataFrame, key: str, lat: str, lon: str, eps_km: float, min_samples: int, out: str = "cluster") -> DataFrame:
    """SP-16: ``points`` with their cluster: the smallest key among its core points, -1 for noise,
    null without coordinates (degrees).

    A point is core if at least ``min_samples`` points, itself included, lie within ``eps_km``. A border
    point of several clusters belongs to the one with the smallest key.
    """
    grid = Grid(eps_km)
    places = fixed(_locations(points, grid, key, lat, lon))
    cells = places.groupBy("row", "col").agg(F.sum("weight").alias("held"))
    judged = places.join(cells, ["row", "col"])
    thin = judged.where(F.col("held") < min_samples)
    weights = _met(grid, thin, places).groupBy(*PLACE).agg(F.sum("weight2").alias("around"))
    found = thin.join(weights.where(F.col("around") >= min_samples), PLACE, "left_semi")
    core = fixed(judged.where(F.col("held") >= min_samples).unionByName(found).select(*places.columns))
    node = F.struct("row", "col").alias("node")
    of_cell = components(core.select(node).distinct(), linked_cells(core, grid))
    of_cell = of_cell.select("node.row", "node.col", "component")
    # the smallest id of a cluster names it; cells first, so that one large cluster is counted in parts
    smallest = core.groupBy("row", "col").agg(F.min("id").alias("id")).join(of_cell, ["row", "col"])
    names = smallest.groupBy("component").agg(F.min("id").alias("name"))
    named = fixed(of_cell.join(names, "component").select("row", "col", "name"))
    inner = core.join(named, ["row", "col"]).select(*PLACE, "row", "col", "name")
    outer = thin.join(core, PLACE, "left_anti")
    border = _met(grid, outer, inner).groupBy(*PLACE).agg(F.min("name2").alias("name"))
    by_place = inner.select(*PLACE, "name").union(border.select(*PLACE, "name"))
    spot = points.withColumn("__lat", F.radians(lat) + F.lit(0.0)).withColumn("__lon", F.radians(lon) + F.lit(0.0))
    by_place = by_place.select(F.col("lat").alias("__lat"), F.col("lon").alias("__lon"), "name")
    placed = F.col("__lat").isNotNull() & F.col("__lon").isNotNull() & ~F.isnan("__lat") & ~F.isnan("__lon")
    labelled = spot.join(by_place, ["__lat", "__lon"], "left")
    return labelled.select(
        *[F.col(f"`{c}`") for c in points.columns], F.when(placed, F.coalesce("name", F.lit(-1).cast("long"))).alias(out)
    )
