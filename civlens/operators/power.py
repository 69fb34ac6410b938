"""M-11: Yeo-Johnson power transform with maximum-likelihood lambdas, then standardisation.

The log-likelihood of a column is concave in lambda, so its maximum on a grid of STEP is found by
refining: each round evaluates some lambdas of every column in ONE aggregate over the table and goes on
around the best ones with a tenth of the spacing. The driver sees a few numbers a column and round.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Lambdas are multiples of this; spacings of the rounds, in these units.
STEP = 1e-4
SPACINGS = (50_000, 5_000, 500, 50, 5, 1)
#: Lambdas are looked for from -BOUND to BOUND (in the same units, -50 to 50).
BOUND = 500_000
#: A lambda that leaves less variance than this, relative to the squared mean, leaves only rounding.
FLAT = 1e-20


def yeo_johnson(x: Column, lam: float | Column) -> Column:
    """The transform of a double column for a lambda."""
    lam = lam if isinstance(lam, Column) else F.lit(float(lam))
    up = F.when(lam == 0, F.log1p(x)).otherwise((F.pow(x + 1, lam) - 1) / lam)
    down = F.when(lam == 2, -F.log1p(-x)).otherwise(-(F.pow(1 - x, 2 - lam) - 1) / (2 - lam))
    return F.when(x >= 0, up).otherwise(down)


def _real(name: str) -> Column:
    """The column as a double, null for NaN and infinities."""
    x = F.col(f"`{name}`").cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def fit_lambdas(df: DataFrame, columns: Sequence[str]) -> dict[str, float | None]:
    """The most likely lambda of each column; None for one without two different values."""
    best: dict[str, int] = {}
    for spacing in SPACINGS:
        if spacing == SPACINGS[0]:
            ask = {c: list(range(-BOUND, BOUND + 1, spacing)) for c in columns}
        else:
            ask = {c: [k + j * spacing for j in range(-10, 11)] for c, k in best.items()}
        found = _likelihoods(df, ask) if ask else {}
        usable = {c: {k: v for k, v in of.items() if v is not None} for c, of in found.items()}
        best = {c: max(of, key=of.get) for c, of in usable.items() if of}
    return {c: best[c] * STEP if c in best else None for c in columns}


def _likelihoods(df: DataFrame, ask: dict[str, list[int]]) -> dict[str, dict[int, float | None]]:
    """Log-likelihoods of lambdas (in steps) of columns: one aggregate by column and lambda, to which
    each row contributes within its task."""
    names = list(ask)
    steps = F.array(*[F.array(*[F.lit(k).cast("long") for k in ask[c]]) for c in names])
    cells = df.select(F.posexplode(F.array(*map(_real, names))).alias("i", "x")).where("x is not null")
    asked = cells.select("i", "x", F.explode(F.element_at(steps, F.col("i") + 1)).alias("k"))
    moved = yeo_johnson(F.col("x"), F.col("k") * STEP)
    sums = asked.groupBy("i", "k").agg(
        F.count("x").alias("n"), F.sum(F.signum("x") * F.log1p(F.abs("x"))).alias("s"), F.var_pop(moved).alias("v"),
        F.avg(moved).alias("m"), F.min("x").alias("low"), F.max("x").alias("high"),
    )
    out: dict[str, dict[int, float | None]] = {c: {} for c in names}
    for r in sums.collect():
        usable = r.low < r.high and FLAT * max(1.0, r.m * r.m) < r.v < math.inf
        out[names[r.i]][r.k] = -r.n / 2 * math.log(r.v) + (r.k * STEP - 1) * r.s if usable else None
    return out


def power_apply(df: DataFrame, train: DataFrame, lambdas: dict[str, float | None], suffix: str = "") -> DataFrame:
    """M-11: columns transformed by ``lambdas`` and standardised by the mean and population deviation
    of the transformed ``train``; constant columns become 0."""
    usable = {c: lam for c, lam in lambdas.items() if lam is not None}
    moments = [f(yeo_johnson(_real(c), lam)).alias(f"{n}{i}") for i, (c, lam) in enumerate(usable.items()) for n, f in (("m", F.avg), ("d", F.stddev_pop))]
    stats = train.agg(*moments) if moments else None
    new = {}
    for i, (c, lam) in enumerate(usable.items()):
        mean, deviation = stats.select(f"m{i}").scalar(), stats.select(f"d{i}").scalar()
        new[c] = F.when(deviation == 0, F.lit(0.0)).otherwise((yeo_johnson(_real(c), lam) - mean) / deviation)
    for c in lambdas.keys() - usable.keys():
        new[c] = F.when(_real(c).isNotNull(), F.lit(0.0))
    keep = [F.col(f"`{c}`") for c in df.columns if suffix or c not in new]
    return df.select(*keep, *[new[c].alias(c + suffix) for c in lambdas])
