"""Yeo-Johnson lambdas against a dense search in numpy."""

import numpy as np
import pytest

from civlens.operators import power as P


def transform(x, lam):
    up = np.log1p(np.abs(x)) if lam == 0 else ((np.abs(x) + 1) ** lam - 1) / lam
    down = -np.log1p(np.abs(x)) if lam == 2 else -((np.abs(x) + 1) ** (2 - lam) - 1) / (2 - lam)
    return np.where(x >= 0, up, down)


def likelihood(x, lam):
    return -len(x) / 2 * np.log(transform(x, lam).var()) + (lam - 1) * (np.sign(x) * np.log1p(np.abs(x))).sum()


def samples():
    rng = np.random.default_rng(8)
    return {
        "skewed": rng.lognormal(1, 0.8, 400),
        "mixed": rng.normal(0, 2, 400) ** 3,
        "left": -rng.exponential(3, 400),
        "normal": rng.normal(0.5, 1, 400),
    }


@pytest.fixture(scope="module")
def table(spark):
    rows = [tuple(map(float, r)) for r in zip(*samples().values(), strict=True)]
    rows = [(*r, 4.0) for r in rows] + [(None, float("nan"), float("inf"), None, 4.0)]
    return spark.createDataFrame(rows, ", ".join(f"{c} double" for c in [*samples(), "constant"])).repartition(3)


def test_lambdas_are_the_best_of_the_grid(table):
    got = P.fit_lambdas(table, [*samples(), "constant"])
    assert got.pop("constant") is None
    for c, x in samples().items():
        lam = got[c]
        around = [likelihood(x, lam + j * P.STEP) for j in range(-40, 41)]
        assert likelihood(x, lam) >= max(around) - 1e-9 * abs(max(around)), c
        far = [likelihood(x, lam + j * 0.05) for j in range(-60, 61)]
        assert likelihood(x, lam) >= max(far) - 1e-9 * abs(max(far)), c
    assert abs(got["normal"] - 1) < 0.2 and got["skewed"] < 0.3


def test_transformed_columns_are_standard(table):
    lambdas = P.fit_lambdas(table, ["skewed", "mixed", "constant"])
    rows = P.power_apply(table, table, lambdas, "_p").collect()
    for c in ("skewed", "mixed"):
        y = np.array([r[f"{c}_p"] for r in rows if r[f"{c}_p"] is not None])
        assert len(y) == 400 and abs(y.mean()) < 1e-9 and abs(y.std() - 1) < 1e-9
        x = np.array([r[c] for r in rows if r[f"{c}_p"] is not None])
        want = transform(x, lambdas[c])
        assert np.allclose(y, (want - want.mean()) / want.std(), atol=1e-9)
    assert {r["constant_p"] for r in rows} == {0.0}


def test_empty_table(table):
    assert P.fit_lambdas(table.where("skewed < -1"), ["skewed"]) == {"skewed": None}
