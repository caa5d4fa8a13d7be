"""Near-duplicate vectors: spherical k-means cells, blocked cosine products, one kept vector a component."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from .common import array_matrix, connected_components, cut, drop, local_forest, table

#: Rows of a tile of a product, on its two sides; and rows shuffled at once, as a multiple of the vectors. Fixed values.
TILE, ROUND = (2048, 4096), 4


def unit(m: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, safe for very large and very small components."""
    m = m / np.abs(m).max(axis=1, keepdims=True)
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def spherical_kmeans(m: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """k unit centres of the unit rows of m; starts from evenly spaced rows, empty cells keep their centre."""
    centres = m[np.linspace(0, len(m) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        cell = (m @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, cell, m)
        size = np.sqrt((sums * sums).sum(axis=1))
        centres[size > 0] = sums[size > 0] / size[size > 0, None]
    return centres


def reachable(m: np.ndarray, centres: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(home cell, rows x cells mask of the cells where a vector within the threshold may live).

    If y lives in cell j then y.c_j >= y.c_i; for x in cell i with x.y >= t the angle between x and the
    bisecting plane of i and j is at most acos(t), so x.(c_i - c_j) <= sqrt(1 - t*t) * |c_i - c_j|.
    """
    dot = m @ centres.T
    home = dot.argmax(axis=1)
    gap = np.sqrt(np.maximum(0, 2 - 2 * np.clip(centres @ centres.T, -1, 1)))[home]
    ok = dot[np.arange(len(m)), home][:, None] - dot <= np.sqrt(max(0.0, 1 - threshold**2)) * gap + 1e-9
    ok[np.arange(len(m)), home] = True
    return home, ok


def linked(home: np.ndarray, seen: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs with cosine >= threshold: screened in single precision, decided in double."""
    a, b = np.nonzero(home.astype(np.float32) @ seen.astype(np.float32).T >= threshold - 1e-4)
    keep = np.zeros(len(a), bool)
    for at in range(0, len(a), 200_000):
        s = slice(at, at + 200_000)
        keep[s] = np.einsum("ij,ij->i", home[a[s]], seen[b[s]]) >= threshold
    return a[keep], b[keep]


def embedding_near_dedup(vectors: DataFrame, threshold: float = 0.9, cell_rows: int = 2048, seen_rows: int = 8192, max_cells: int = 1024, sample_rows: int = 20_000) -> DataFrame:
    """Links ``vectors(vec_id, embedding)`` by cosine >= ``threshold`` and keeps one vector a component.

    Equal vectors are folded into classes first. Centres are fitted on at most ``sample_rows`` classes, chosen by
    hash; every class then gets a home cell and visits each cell that could hold a partner (see ``reachable``:
    no link is lost). Neighbouring cells are put together, and large ones cut, into blocks of up to ``8 * cell_rows``
    residents; a visitor goes to a block once, however many of its cells it visits, and a block's visitors come in blocks of
    up to ``2 * seen_rows``. A task compares one pair of blocks, tile by tile, and returns counts and a spanning forest, never
    pairs. Pairs of blocks are taken in rounds that shuffle about ``ROUND`` rows a vector each, so that the work may grow
    with the square of the rows, but not the disk that it takes.

    Vectors that are null, empty, zero, or hold null or non-finite components, and rows without vec_id, link with
    nothing: n_links 0, component_id the own id. Vectors of different length are not compared. Rows repeated with
    one vec_id link with each other (as other rows). No rows give an empty result; other columns are ignored.
    Returns vec_id, n_links long, component_id long, kept boolean.
    """
    # floats are moved as such; what is computed of them is the same
    kind = "array<float>" if isinstance(vectors.schema["embedding"].dataType.elementType, FloatType) else "array<double>"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("v"))
    valid = F.coalesce((F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0), F.lit(False)) & F.col("vec_id").isNotNull()
    keyed = rows.withColumn("key", F.when(valid, F.sha2(F.concat_ws(",", F.transform("v", lambda x: (x + F.lit(0.0)).cast("string"))), 256)))
    classes = cut(keyed.where("key is not null").groupBy("key").agg(F.min("vec_id").alias("cid"), F.count("*").alias("n"), F.any_value("v").alias("v")), "vec-classes")
    sizes = {r.dim: r.n for r in classes.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).collect()}
    spark = vectors.sparkSession
    out = spark.createDataFrame([], "cid long, links long, root long")
    for dim, n in sorted(sizes.items()):
        part = classes.where(F.size("v") == dim)
        out = out.union(_one_dim(part, dim, n, threshold, cell_rows, seen_rows, max_cells, sample_rows))
    by_class = classes.select("key", "cid", "n").join(out, "cid", "left")
    by_class = by_class.select("key", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("root", "cid").alias("root"))
    done = keyed.select("vec_id", "key").join(by_class, "key", "left")
    return done.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("root", "vec_id").alias("component_id"), F.coalesce(F.col("root") == F.col("vec_id"), F.lit(True)).alias("kept"))


def _one_dim(part: DataFrame, dim: int, n: int, threshold: float, cell_rows: int, seen_rows: int, max_cells: int, sample_rows: int) -> DataFrame:
    share = min(1.0, sample_rows / n)
    sample = part.where(F.pmod(F.xxhash64("key"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).select("key", "v").limit(2 * sample_rows).toPandas()
    m = unit(np.stack(sample.sort_values("key").v.to_numpy()).astype(np.float64)) if len(sample) else np.eye(1, dim)
    centres = spherical_kmeans(m, int(min(max_cells, max(1, n // cell_rows), len(m))))

    def assign(batches):
        for b in batches:
            if b.num_rows:
                home, ok = reachable(unit(array_matrix(b["v"])), centres, threshold)
                cells = [np.flatnonzero(x) for x in ok]
                yield pa.RecordBatch.from_arrays([b["cid"], b["n"], b["v"], pa.array(home.astype(np.int64)), pa.array(cells, pa.list_(pa.int64()))], names=["cid", "n", "v", "home", "cells"])

    kind = part.schema["v"].dataType.simpleString()
    placed = cut(part.select("cid", "n", "v").mapInArrow(assign, f"cid long, n long, v {kind}, home long, cells array<long>"), "vec-cells")
    # one row a cell, max_cells at most
    homes = {r.home: r.h for r in placed.groupBy("home").agg(F.count("*").alias("h")).collect()}
    own_rows, seen_block = (min(most, max(cell_rows, n // 8)) for most in (8 * cell_rows, 2 * seen_rows))
    blocks = _blocks([homes.get(c, 0) for c in range(len(centres))], own_rows)
    first, wide = (np.array(x, dtype=np.int64) for x in zip(*blocks))

    def visit(batches):
        for b in batches:
            if b.num_rows:
                seen = [np.unique(np.concatenate([np.arange(first[c], first[c] + wide[c]) for c in cells])) for cells in b["cells"].to_pylist()]
                yield pa.RecordBatch.from_arrays([b["cid"], b["n"], b["v"], b["home"], pa.array(seen, pa.list_(pa.int64()))], names=["cid", "n", "v", "home", "blocks"])

    spread = cut(placed.mapInArrow(visit, f"cid long, n long, v {kind}, home long, blocks array<long>"), "vec-blocks")
    drop(placed)
    seen = {r.block: r.s for r in spread.select(F.explode("blocks").alias("block")).groupBy("block").agg(F.count("*").alias("s")).collect()}
    cut_in = {g: -(-s // seen_block) for g, s in seen.items()}
    # blocks of residents, each of which has visitors, as all are their own
    where = spread.sparkSession.createDataFrame([(c, int(first[c]), int(wide[c])) for c in homes] or [(0, 0, 1)], "home long, first long, wide long")
    times = spread.sparkSession.createDataFrame([(g, k) for g, k in cut_in.items()] or [(0, 1)], "block long, times long")
    x = F.xxhash64("cid")
    left = spread.select("cid", "v", "home", x.alias("x")).join(F.broadcast(where), "home").withColumn("block", F.expr("first + pmod(x, wide)"))
    left = left.join(F.broadcast(times), "block")
    right = spread.select("cid", "n", "v", "home", x.alias("x"), F.explode("blocks").alias("block")).join(F.broadcast(times), "block")

    def compare(a: pa.Table, b: pa.Table) -> pa.Table:
        forest, links = [np.zeros((2, 0), np.int64)], np.zeros(a.num_rows, np.int64)
        ia = a["cid"].to_numpy() if a.num_rows else np.zeros(0, np.int64)
        if a.num_rows and b.num_rows:
            ib, nb, va, vb = b["c_id"].to_numpy(), b["c_n"].to_numpy(), unit(array_matrix(a["v"])), unit(array_matrix(b["c_v"]))
            cell, own = a["home"].to_numpy(), centres[b["c_home"].to_numpy()]
            at_home = np.einsum("ij,ij->i", vb, own)
            for c in np.unique(cell):
                # as in ``reachable``, for the cells of this block
                gap = np.sqrt(np.maximum(0, 2 - 2 * np.clip(own @ centres[c], -1, 1)))
                here, come = np.flatnonzero(cell == c), np.flatnonzero((at_home - vb @ centres[c] <= np.sqrt(max(0.0, 1 - threshold**2)) * gap + 1e-9) | (b["c_home"].to_numpy() == c))
                for i in range(0, len(here), TILE[0]):
                    for j in range(0, len(come), TILE[1]):
                        s, t = here[i : i + TILE[0]], come[j : j + TILE[1]]
                        x, y = linked(va[s], vb[t], threshold)
                        keep = ia[s[x]] != ib[t[y]]
                        x, y = s[x[keep]], t[y[keep]]
                        if len(x):
                            links += np.bincount(x, weights=nb[y], minlength=len(ia)).astype(np.int64)
                            forest.append(np.stack(local_forest(ia[x], ib[y])))
        node, other = np.concatenate(forest, axis=1)
        if len(node):
            node, other = local_forest(node, other)
            count = np.zeros(len(node), np.int64)
            order = np.argsort(ia)
            at = np.minimum(np.searchsorted(ia, node, sorter=order), len(ia) - 1)
            here = ia[order[at]] == node
            count[here] = links[order[at[here]]]
            links = count
        else:
            links = np.zeros(0, np.int64)
        return pa.table({"node": node, "root": other, "links": links})

    residents = {}
    for c, h in homes.items():
        for g in range(first[c], first[c] + wide[c]):
            residents[g] = residents.get(g, 0) + -(-h // int(wide[c]))
    found = None
    for some in _rounds([(g, residents.get(g, 0) * cut_in[g] + s) for g, s in sorted(seen.items())], ROUND * n):
        here = F.col("block").isin(some)
        own = left.where(here).select("cid", "v", "home", "block", F.explode(F.expr("sequence(0, times - 1)")).alias("j"))
        visitors = right.where(here).select(F.col("cid").alias("c_id"), F.col("n").alias("c_n"), F.col("v").alias("c_v"), F.col("home").alias("c_home"), F.col("block").alias("c_block"), F.expr("pmod(shiftright(x, 20), times)").alias("c_j"))
        part_found = cut(own.groupBy("block", "j").cogroup(visitors.groupBy("c_block", "c_j")).applyInArrow(compare, "node long, root long, links long"), "vec-links")
        if found is None:
            found = part_found
        else:
            before, found = found, cut(found.union(part_found).groupBy("node", "root").agg(F.sum("links").alias("links")), "vec-links")
            drop(before, part_found)
    drop(spread)
    links = found.groupBy(F.col("node").alias("cid")).agg(F.sum("links").alias("links"))
    roots = connected_components(found.select(F.col("node").alias("u"), F.col("root").alias("v")), "vec-roots")
    return links.join(roots.withColumnRenamed("node", "cid"), "cid", "left").select("cid", "links", "root")


def _blocks(homes: list[int], rows: int) -> list[tuple[int, int]]:
    """For each cell of ``homes`` residents the first of its blocks and how many it is cut into; cells that fit share a block of up to ``rows``."""
    out, block, held = [], 0, 0
    for h in homes:
        wide = max(1, -(-h // rows))
        if held and (wide > 1 or held + h > rows):
            block, held = block + 1, 0
        out.append((block, wide))
        block, held = (block + wide, 0) if wide > 1 else (block, held + h)
    return out


def _rounds(costs: list[tuple[int, int]], most: int) -> list[list[int]]:
    """Blocks dealt into rounds, in order, of a cost of up to ``most`` together or one block each."""
    out, held = [], 0
    for block, cost in costs:
        if out and held + cost <= most:
            out[-1].append(block)
            held += cost
        else:
            out.append([block])
            held = cost
    return out


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_near_dedup(table(spark, sf_dir, "embeddings"))


ORACLE_SQL = {
    "op10_embedding_near_dedup": """
WITH RECURSIVE ok AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
      WHERE list_cosine_similarity(a.v, b.v) >= 0.9),
r AS (SELECT a AS s, a AS e FROM l UNION SELECT r.s, l.b FROM r JOIN l ON r.e = l.a),
c AS (SELECT s, min(e) AS root FROM r GROUP BY s),
n AS (SELECT a, count(*) AS k FROM l GROUP BY a)
SELECT e.vec_id, coalesce(n.k, 0)::BIGINT AS n_links, coalesce(c.root, e.vec_id) AS component_id, coalesce(c.root, e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN n ON n.a = e.vec_id LEFT JOIN c ON c.s = e.vec_id
"""
}
