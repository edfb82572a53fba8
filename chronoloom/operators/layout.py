"""Placing of labels."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame


def lanes(rows: DataFrame, width: float, n: int) -> DataFrame:
    """rows: author_id, x, band.  Adds the lane: the first of n whose last label ends before x, else the one that ends first.

    Each label depends on those before it, so a band (the labels of one picture) is folded in one task.
    """

    def work(band: pd.DataFrame) -> pd.DataFrame:
        band = band.sort_values(["x", "author_id"])
        ends, found = [-1.0] * n, []
        for x in band["x"].tolist():
            free = next((i for i, e in enumerate(ends) if e <= x), min(range(n), key=ends.__getitem__))
            ends[free] = x + width
            found.append(free)
        return band.assign(lane=found)

    return rows.groupBy("band").applyInPandas(work, "author_id long, x double, band int, lane int")
