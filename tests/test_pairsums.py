"""Sums over pairs against the pairs themselves."""

import numpy as np
import pytest

from chronoloom.operators import pairsums


@pytest.mark.parametrize("n", [0, 1, 7, 300])
def test_sums_are_those_of_the_pairs(spark, n):
    """More vectors in a year than dimensions and fewer, zero vectors, rows without a year or vector."""
    rng = np.random.default_rng(n)
    rows = [(t, int(rng.integers(1700, 1712)), rng.normal(size=5).tolist()) for t in (0, 3) for _ in range(n)]
    rows += [(0, None, [1.0] * 5), (0, 1705, None), (3, 1705, [0.0] * 5)]
    moments = pairsums.year_moments(spark.createDataFrame(rows, "t int, year int, v array<double>"))
    found = {r["t"]: r for r in pairsums.pair_moments(moments).join(pairsums.gap_moments(moments).drop("n"), "t").collect()}
    for t in {r[0] for r in rows if r[1] is not None and r[2] is not None}:
        own = [(y, np.array(v)) for s, y, v in rows if s == t and y is not None and v is not None]
        pairs = [(float(v @ w), z - y) for y, v in own for z, w in own if y < z]
        d, g = np.array(pairs, float).reshape(-1, 2).T
        expected = [len(pairs), d.sum(), (d * d).sum(), g.sum(), (g * g).sum(), (d * g).sum()]
        assert np.allclose([found[t][c] for c in ("n", "total", "squares", "gap", "gap_squares", "gap_products")], expected)
