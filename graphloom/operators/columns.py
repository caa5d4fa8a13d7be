"""Columns that are computed once a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def computed(rows: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``rows`` with new ``columns``, each computed once a row, however often later filters and expressions name it.

    Spark writes the expression of a plain column into whatever uses it, and moves filters on it below distinct and joins,
    where it is computed again for every row and use. It does neither with columns that come out of an array.
    """
    return rows.select("*", F.inline(F.array(F.struct(*(c.alias(name) for name, c in columns.items())))))
