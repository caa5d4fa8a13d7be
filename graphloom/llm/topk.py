"""Exact top-k search by tiled matrix products."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import array_matrix, table


def _product(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact integer products: through doubles while every sum stays below 2**53, else in 64-bit integers."""
    bound = np.abs(q).max(initial=0) * np.abs(c).max(initial=0) * q.shape[1]
    return q @ c.T if bound < 2**53 else q.astype(np.int64) @ c.astype(np.int64).T


def tile_top(q_id: np.ndarray, q: np.ndarray, c_id: np.ndarray, c: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """(query, candidate, score) of the k best candidates of each query in a tile; ties go to smaller ids."""
    order = np.argsort(c_id, kind="stable")
    c_id, c = c_id[order], c[order]
    out = []
    step = max(1, 8_000_000 // max(1, len(c_id)))
    for at in range(0, len(q_id), step):
        ids = q_id[at : at + step]
        s = _product(q[at : at + step], c).astype(np.float64 if c.dtype != np.int64 else np.int64)
        own = ids[:, None] == c_id[None, :]
        s = np.where(own, -np.inf if s.dtype.kind == "f" else np.iinfo(np.int64).min, s)
        n = min(k, s.shape[1])
        least = np.partition(s, s.shape[1] - n, axis=1)[:, s.shape[1] - n]
        row, col = np.nonzero((s >= least[:, None]) & ~own)
        by = np.lexsort((col, -s[row, col], row))
        row, col = row[by], col[by]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        row, col = row[rank < k], col[rank < k]
        out.append((ids[row], c_id[col], s[row, col].astype(np.int64)))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 3


def exact_top_k(vectors: DataFrame, queries: Column, k: int = 5, scale: int = 256, tile: int = 16_384, shard: int = 8192, fan_in: int = 16) -> DataFrame:
    """The ``k`` best other rows for every row of ``vectors(vec_id, embedding)`` that ``queries`` selects.

    Components become ``floor(scale * x)``. Queries are dealt over tiles and rows over shards, both by hash;
    each (tile, shard) cell is one matrix product that keeps k partial results a query, and the partial lists
    meet in a tree of merges. Work is queries x rows; a cell holds ``tile`` queries and ``shard`` rows, about. A row
    travels once for each tile of queries, a query once for each shard, as integers of 32 bits where they fit.

    Rows whose vec_id or vector is null or holds null, NaN or infinite components take no part; only vectors of one length are
    compared; repeated rows count as often as they stand there, but a row never meets rows of its own id.
    Columns of other names are ignored. No rows or no queries give an empty result.
    Returns query_id long, rank int from 1, vec_id long, score long.
    """
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    q = F.transform("embedding", lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("double"))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite & (F.size("embedding") > 0))
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), q.alias("v"), queries.alias("is_query"), F.size("embedding").alias("dim"))
    n = rows.agg(F.count("*").alias("n"), F.coalesce(F.count_if("is_query"), F.lit(0)).alias("q"), F.max(F.array_max(F.transform("v", F.abs))).alias("top")).first()
    if n.top is not None and n.top < 2**31:
        rows = rows.withColumn("v", F.col("v").cast("array<int>"))
    tiles, shards = max(1, -(-n.q // tile)), max(1, -(-n.n // shard))
    h = F.xxhash64("vec_id")
    left = rows.where("is_query").select("vec_id", "v", "dim", F.pmod(h, F.lit(tiles)).alias("tile"), F.explode(F.expr(f"sequence(0L, {shards - 1}L)")).alias("shard"))
    right = rows.select("vec_id", "v", "dim", F.explode(F.expr(f"sequence(0L, {tiles - 1}L)")).alias("tile"), F.pmod(h, F.lit(shards)).alias("shard")).toDF("c_id", "c_v", "c_dim", "c_tile", "c_shard")

    def cell(a: pa.Table, b: pa.Table) -> pa.Table:
        part = ()
        if a.num_rows and b.num_rows:
            part = tile_top(a["vec_id"].to_numpy(), array_matrix(a["v"]), b["c_id"].to_numpy(), array_matrix(b["c_v"]), k)
        ids = part or (np.zeros(0, np.int64),) * 3
        at = b["c_shard"][0].as_py() if b.num_rows else 0
        return pa.table({"query_id": ids[0], "vec_id": ids[1], "score": ids[2], "shard": np.full(len(ids[0]), at)})

    cells = right.groupBy("c_tile", "c_shard", "c_dim")
    top = left.groupBy("tile", "shard", "dim").cogroup(cells).applyInArrow(cell, "query_id long, vec_id long, score long, shard long")
    order = [F.desc("score"), F.asc("vec_id")]
    while shards > fan_in:
        shards = -(-shards // fan_in)
        top = top.withColumn("shard", F.expr(f"shard div {fan_in}"))
        top = top.withColumn("rank", F.row_number().over(W.partitionBy("query_id", "shard").orderBy(*order))).where(F.col("rank") <= k).drop("rank")
    top = top.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= k)
    return top.select("query_id", "rank", "vec_id", "score")


def op1_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


ORACLE_SQL = {
    "op1_exact_top_k": """
WITH ok AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM ok q JOIN ok c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
SELECT query_id, n::INTEGER AS rank, vec_id, score FROM r WHERE n <= 5
"""
}
