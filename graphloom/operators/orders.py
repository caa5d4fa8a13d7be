"""Partial orders: rows that no other dominates, sets that no other contains, tuples that no other completes."""

from __future__ import annotations

import itertools
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scratch import settle


def maxima(rows: DataFrame, columns: list[str], least: bool = False) -> DataFrame:
    """Distinct rows that no other row dominates: at least as great in each column and greater in one.

    ``least`` turns the order round. Rows with a null in ``columns`` are not comparable and drop out. One or two columns are
    numbers, dates or times, and are scanned by ranges; more are whole numbers or floats.
    """
    kinds = {f.name: f.dataType.typeName() for f in rows.select(*columns).schema}
    if odd := [c for c in columns if kinds[c] in ("string", "binary", "boolean", "array", "struct", "map")]:
        raise TypeError(f"numbers, dates and times are compared, not {odd}")
    d = rows.select(*columns).where(reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in columns)))
    if len(columns) == 1:
        top = F.min(columns[0]) if least else F.max(columns[0])
        return d.agg(top.alias(columns[0])).where(F.col(columns[0]).isNotNull())
    return _staircase(d, *columns, least) if len(columns) == 2 else _by_cells(d.distinct(), columns, -1 if least else 1)


def _staircase(d: DataFrame, x: str, y: str, least: bool) -> DataFrame:
    """Of two columns: from the best x on, the rows whose y is better than any before.

    Rows are dealt out by ranges of x and sorted there. A range knows the best y of those before it, one value each; within
    it a running one is kept. Nothing is compared with everything, whatever the number of maxima.
    """
    best, order = (F.min, F.asc) if least else (F.max, F.desc)
    better = (lambda a, b: a < b) if least else (lambda a, b: a > b)
    partitions = int(d.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    one = d.groupBy(x).agg(best(y).alias(y)).repartitionByRange(partitions, order(x)).withColumn("_part", F.spark_partition_id())
    one = settle(one)
    # as many rows as there are ranges
    parts = one.groupBy("_part").agg(best(y).alias("_y"))
    parts = parts.select("_part", best("_y").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)).alias("_before"))
    own = W.partitionBy("_part").orderBy(order(x)).rowsBetween(W.unboundedPreceding, -1)
    done = one.withColumn("_own", best(y).over(own)).join(F.broadcast(parts), "_part")
    return done.where(F.coalesce(better(F.col(y), F.col("_own")), F.lit(True)) & F.coalesce(better(F.col(y), F.col("_before")), F.lit(True))).select(x, y)


def _local_maxima(columns: list[str], sign: int):
    def keep(batches):
        held = None
        for pdf in batches:
            every = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            values = np.stack([sign * every[c].to_numpy(np.float64) for c in columns], axis=1)
            # none is dominated by one with a lesser sum of places
            order = np.argsort(-np.argsort(np.argsort(values, axis=0), axis=0).sum(axis=1), kind="stable")
            kept = np.zeros((0, len(columns)))
            rows: list[int] = []
            for at in range(0, len(order), 512):
                block = order[at : at + 512]
                v = values[block]
                over = np.zeros(len(v), bool)
                for start in range(0, len(kept), 4096):
                    k = kept[start : start + 4096]
                    over |= ((k[None] >= v[:, None]).all(axis=2) & (k[None] > v[:, None]).any(axis=2)).any(axis=1)
                v, block = v[~over], block[~over]
                inner = ((v[None] >= v[:, None]).all(axis=2) & (v[None] > v[:, None]).any(axis=2)).any(axis=1)
                kept, rows = np.concatenate([kept, v[~inner]]), rows + block[~inner].tolist()
            held = every.iloc[rows]
        if held is not None:
            yield held

    return keep


def _by_cells(d: DataFrame, columns: list[str], sign: int, most: int = 1024) -> DataFrame:
    """Of three columns and more: tasks keep their own maxima, then cells of a grid are compared.

    The grid has ``most`` cells at most, between quantiles of each column. Rows of a cell that another is above in every
    column are dominated, whatever they are. Others are compared with the rows of those cells alone that are nowhere below
    theirs, in a join on the cell that Spark can split.
    """
    kinds = {f.name: f.dataType.typeName() for f in d.schema}
    if odd := [c for c in columns if kinds[c] not in ("byte", "short", "integer", "long", "float", "double")]:
        raise TypeError(f"more than two columns are compared as whole numbers or floats, not {odd}")
    d = settle(d.mapInPandas(_local_maxima(columns, sign), d.schema))
    sides = max(2, int(most ** (1 / len(columns))))
    cuts = d.approxQuantile(columns, [i / sides for i in range(1, sides)], 0.01)
    place = [reduce(lambda a, q: a + F.when(F.col(c) * sign > sign * q, 1).otherwise(0), sorted(set(qs)), F.lit(0)) for c, qs in zip(columns, cuts)]
    d = settle(d.withColumn("_cell", F.concat_ws(",", *place)))
    occupied = [tuple(map(int, r._cell.split(","))) for r in d.select("_cell").distinct().collect()]
    grid = np.array(occupied, np.int64).reshape(len(occupied), len(columns))
    # places count in the direction of the order
    kept = np.array([not (grid > c).all(axis=1).any() for c in grid], bool)
    name = lambda c: ",".join(map(str, c))
    pairs = [(name(c), name(v)) for c in grid[kept] for v in grid[kept][(grid[kept] >= c).all(axis=1)]]
    cells = F.broadcast(d.sparkSession.createDataFrame(pairs, "_cell string, _from string"))
    visitors = d.withColumnRenamed("_cell", "_from").join(cells, "_from").select(F.col("_cell").alias("_target"), *(F.col(c).alias(f"_{c}") for c in columns))
    own = d.join(F.broadcast(d.sparkSession.createDataFrame([(name(c),) for c in grid[kept]], "_cell string")), "_cell")
    ge = reduce(lambda a, b: a & b, (F.col(f"_{c}") * sign >= F.col(c) * sign for c in columns))
    gt = reduce(lambda a, b: a | b, (F.col(f"_{c}") * sign > F.col(c) * sign for c in columns))
    return own.join(visitors, (F.col("_cell") == F.col("_target")) & ge & gt, "left_anti").select(*columns)


def most_complete(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Distinct tuples of ``columns`` that no other of the same ``keys`` completes: equal where known, and known in more.

    A tuple is completed by another if it is what remains of that when some of its known members are left out. So each
    tuple is once reduced in every such way, and one grouping tells which are among these: work is rows times
    2 to the number of columns, however many rows a key has.
    """
    known = [F.col(c).isNotNull() for c in columns]
    masks = itertools.product((True, False), repeat=len(columns))
    kept = lambda m: reduce(lambda a, b: a & b, (k for k, keep in zip(known, m) if not keep), F.lit(True))
    ways = F.array(*(F.when(kept(m), F.struct(F.lit(not all(m)).alias("_less"), *(F.when(F.lit(keep), F.col(c)).alias(c) for c, keep in zip(columns, m)))) for m in masks))
    every = rows.select(*keys, F.inline(F.array_compact(ways)))
    return every.groupBy(*keys, *columns).agg(F.bool_or("_less").alias("_less")).where("not _less").select(*keys, *columns)


def maximal_sets(rows: DataFrame, items: str) -> DataFrame:
    """Distinct sets (sorted arrays) of the array column ``items`` that no other set contains; nulls and empty sets are left out.

    A set can be in those only that hold its rarest item. So sets are listed under each of their items, each set looks
    under its rarest, and the few found there that are larger are compared with it in full.
    """
    sets = rows.select(F.array_sort(F.array_distinct(items)).alias(items)).where(F.size(items) > 0).distinct()
    # short ids: they are moved with every item, and stand once they are written
    sets = settle(sets.withColumn("_id", F.monotonically_increasing_id()))
    each = sets.select("_id", F.explode(items).alias("_item"))
    often = each.groupBy("_item").agg(F.count("*").alias("_n"))
    rare = each.join(often, "_item").groupBy("_id").agg(F.min(F.struct("_n", "_item")).alias("_r")).select("_id", F.col("_r._item").alias("_item"))
    small = sets.join(rare, "_id").select(F.col("_id").alias("_small"), F.col(items).alias("_set"), "_item")
    # a set of one item holds no other
    large = sets.where(F.size(items) > 1).select(F.col(items).alias("_other"), F.explode(items).alias("_item"))
    inside = small.join(large, "_item").where((F.size("_other") > F.size("_set")) & (F.size(F.array_except("_set", "_other")) == 0))
    return sets.join(inside.select(F.col("_small").alias("_id")), "_id", "left_anti").select(items)
