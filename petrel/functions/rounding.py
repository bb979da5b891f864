"""Rounding to four places."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def round4(c: Column) -> Column:
    """Half up, the same double in any engine: floor(x * 10000 + 0.5) / 10000."""
    return F.floor(c.cast("double") * F.lit(10000.0) + F.lit(0.5)).cast("double") / F.lit(10000.0)


def exact_round(c: Column, places: int = 4) -> Column:
    """Half even on the exact binary value, as Python rounds. For the few rows of a metrics table; runs in an Arrow UDF."""
    @F.pandas_udf("double")
    def rounded(x: pd.Series) -> pd.Series:
        return x.map(lambda v: round(v, places), na_action="ignore")

    return rounded(c.cast("double"))
