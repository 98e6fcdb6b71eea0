"""Comparable output: doubles rounded to six places, NaN and infinities as NULL, no negative zero.

The engines round exact ties differently; both sides add TIE first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuesta.functions.numeric import Name, col, finite


TIE = 1e-10


def rounded(c: Name, places: int = 6) -> Column:
    return F.when(finite(c), F.round(col(c) + F.lit(TIE), places) + F.lit(0.0))


def comparable(df: DataFrame, places: int = 6) -> DataFrame:
    """df with every double column rounded."""
    return df.select(*(rounded(f.name, places).alias(f.name) if f.dataType.typeName() == "double" else F.col(f.name) for f in df.schema.fields))


def r(sql: str, name: str, places: int = 6) -> str:
    """The same for an expression of the oracle."""
    return f"(CASE WHEN isfinite(CAST({sql} AS DOUBLE)) THEN round(CAST({sql} AS DOUBLE) + {TIE}, {places}) + 0.0 END) AS {name}"
