"""Dense numbers for rows in an order, without a window over all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import settle

#: Low bits of ``monotonically_increasing_id``, the place of a row in its partition. Fixed value.
PLACE_BITS = 33


def numbered(rows: DataFrame, order: list[str | Column], name: str = "number") -> DataFrame:
    """``rows`` with a whole number from 0 in ``order``, which should tell all rows apart.

    Rows are dealt out by ranges of the order and sorted there; a partition's rows are numbered on from what the partitions
    before it hold. One count a partition is all that meets in one place.
    """
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.repartitionByRange(partitions, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    # the numbers stand before anything else is done with them
    placed = settle(placed)
    part = F.shiftright("_at", PLACE_BITS)
    counts = sorted((r.part, r.n) for r in placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())
    before, starts = 0, []
    for p, n in counts:
        starts += [F.lit(p), F.lit(before)]
        before += n
    start = F.element_at(F.create_map(*starts), part) if starts else F.lit(0)
    return placed.withColumn(name, (start + F.col("_at").bitwiseAND((1 << PLACE_BITS) - 1)).cast("long")).drop("_at")


def ranked(rows: DataFrame, keys: list[str], order: list[str | Column], name: str = "rank") -> DataFrame:
    """``rows`` with a whole number from 0 within each value of ``keys``, in ``order``; one key may hold most of the rows.

    Keys with null values are groups of their own as well.
    """
    every = numbered(rows, [*keys, *order], "_number")
    first = every.groupBy(*(F.col(k).alias(f"_{k}") for k in keys)).agg(F.min("_number").alias("_first"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    out = every.join(first, same).withColumn(name, F.col("_number") - F.col("_first"))
    return out.select(*rows.columns, name)
