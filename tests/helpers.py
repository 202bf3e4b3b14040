"""Helpers of the tests."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame

DATA = "/root/testdata/sf0.001"


def rows(df: DataFrame) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=repr)


def canonical(frame):  # noqa: ANN001, ANN201
    def cell(x):  # noqa: ANN001, ANN202
        if x is None or pd.isna(x):
            return None
        if isinstance(x, float):
            return round(float(x), 9)
        return x.item() if hasattr(x, "item") else x

    frame = frame[sorted(frame.columns)]
    return sorted(repr(tuple(cell(x) for x in r)) for r in frame.astype(object).itertuples(index=False, name=None))
