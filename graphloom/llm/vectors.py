"""Vectors as whole numbers, and matrices that are summed over partitions."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def whole_vectors(vectors: DataFrame, scale: int, limit: float, *keep: str) -> DataFrame:
    """``keep`` and x: floor(scale * component) as longs, of the rows whose vector is there and finite throughout.

    Scaled components beyond ``limit`` on either side are held at it, so that what is made of them fits its type.
    """
    finite = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    held = lambda c: F.greatest(F.least(F.lit(float(scale)) * c.cast("double"), F.lit(limit)), F.lit(-limit))
    rows = vectors.where(F.col("embedding").isNotNull() & finite & (F.size("embedding") > 0))
    return rows.select(*keep, F.transform("embedding", lambda c: F.floor(held(c))).alias("x"))


def whole_matrix(column) -> np.ndarray:
    """The (rows, width) 64-bit integers of an Arrow list column whose lists have one length."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1)


def summed_product(rows: DataFrame, features, width: int) -> np.ndarray:
    """Z'Z over all ``rows``, where ``features(Arrow batch)`` gives a batch's rows of Z in the tasks.

    Each task adds up its own product and hands over one record a matrix row; those of one matrix row are added by one
    group on Spark, so that a group holds as many records as there are tasks. ``width`` squared numbers reach the driver.
    """

    def sums(batches):
        total = None
        for b in batches:
            if b.num_rows:
                z = features(b)
                total = z.T @ z if total is None else total + z.T @ z
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(width)), pa.array(list(total))], names=["at", "line"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"at": pdf["at"][:1], "line": [np.sum(np.stack(pdf.line.to_numpy()), axis=0)]})

    kind = "at long, line array<double>"
    out = np.zeros((width, width))
    for r in rows.mapInArrow(sums, kind).groupBy("at").applyInPandas(add, kind).toLocalIterator():
        out[r["at"]] = r.line
    return out
