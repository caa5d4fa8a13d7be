"""What the text and vector operators share: scratch tables, held-out rows, word caches, components."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of text that a Python task works on at once; larger batches are cut at rows.
SLICE_CHARS = 2_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; where that is unset, a local one if the master is."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="graphloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/graphloom/{spark.sparkContext.applicationId}"


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package's modules to the workers of the session's application, once."""
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        package = Path(__file__).resolve().parent.parent
        archive = f"{tempfile.mkdtemp(prefix='graphloom-')}/graphloom_modules.zip"
        with zipfile.ZipFile(archive, "w") as z:
            for f in sorted(package.rglob("*.py")):
                z.write(f, f.relative_to(package.parent))
        context.addPyFile(archive)
        _SHIPPED.add(context.applicationId)


#: Spark removes a query's shuffle files as soon as the query has ended.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here, and lost executors lose nothing.

    The write's shuffle files are of no use once it has ended, and go. ``drop`` deletes the table itself.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(FREE_SHUFFLES, None)
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if before is None:
            spark.conf.unset(FREE_SHUFFLES)
        else:
            spark.conf.set(FREE_SHUFFLES, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.written = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables that ``cut`` has written, once nothing reads them any more."""
    for t in tables:
        spark, path = t.sparkSession, t.written
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """crc32 of the decimal doc_id is a multiple of 5; rows without a doc_id are held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def slices(texts: pd.Series, limit: int = SLICE_CHARS) -> Iterator[slice]:
    """Row ranges of about ``limit`` characters; a longer text is a range of its own."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t is not None else 0
        if size and size + n > limit:
            yield slice(start, i)
            start, size = i, 0
        size += n
    if start < len(texts):
        yield slice(start, len(texts))


class Memo(dict):
    """word -> fn(word), emptied when it holds ``bound`` entries."""

    def __init__(self, fn, bound: int = 400_000):
        super().__init__()
        self.fn, self.bound = fn, bound

    def __missing__(self, key):
        if len(self) >= self.bound:
            self.clear()
        out = self[key] = self.fn(key)
        return out


def local_forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) of the components of the edges a-b; root is the smallest node."""
    nodes, inv = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = inv[: len(a)], inv[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        for side in (u, v):
            np.minimum.at(new, label[side], low)
            np.minimum.at(new, side, low)
        new = new[new]
        if np.array_equal(new, label):
            return nodes, nodes[label]
        label = new


def _forest_batches(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        if len(pdf):
            node, root = local_forest(pdf.u.to_numpy(), pdf.v.to_numpy())
            keep = node != root
            yield pd.DataFrame({"u": node[keep], "v": root[keep]})


#: Edges (2 MB) that one task joins at most; components of more are joined by shuffles.
EDGES = 1 << 17


def _whole_forest(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(node, root) of all nodes of the edges of a partition."""
    every = [pdf for pdf in batches if len(pdf)]
    if every:
        node, root = local_forest(*(np.concatenate([pdf[c].to_numpy() for pdf in every]) for c in "uv"))
        yield pd.DataFrame({"node": node, "root": root})


def connected_components(edges: DataFrame, name: str) -> DataFrame:
    """(node, root) for every node of ``edges(u long, v long)``; root is the component's smallest node.

    Each task first replaces its edges by stars. Up to EDGES of these are joined in one task; of more, alternating star
    contractions run on Spark until nothing changes. Every step is a min-aggregation with map-side combining and an equi-join, so a hub
    with any number of neighbours never meets in one task. No edges give no rows; loops and nulls are ignored.
    The rows are a written table, for the caller to ``drop``.
    """
    e = edges.select(F.col("u").cast("long"), F.col("v").cast("long")).where("u <> v")
    e = cut(e.mapInPandas(_forest_batches, "u long, v long"), name)
    if e.count() <= EDGES:
        found = cut(e.coalesce(1).mapInPandas(_whole_forest, "node long, root long"), name)
        drop(e)
        return found
    before = None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        last = e
        e = small.select("v", "m").where("v <> m").toDF("u", "v").union(small.select("u", "m").toDF("u", "v")).distinct()
        e = cut(e, name)
        drop(last)
        row = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h"), F.countDistinct("u").alias("k")).first()
        if (row.n, row.h) == before or row.n == row.k and _flat(e):
            roots = e.select(F.col("v").alias("node")).distinct().withColumn("root", F.col("node"))
            found = cut(e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots), name)
            drop(e)
            return found
        before = (row.n, row.h)


def _flat(e: DataFrame) -> bool:
    """Every edge leads straight to a root."""
    return e.select("v").join(e.select(F.col("u").alias("v")), "v", "left_semi").isEmpty()


def array_matrix(column) -> np.ndarray:
    """A (rows, dim) double matrix of an Arrow list column whose lists have one length."""
    column = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return np.asarray(flat, dtype=np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 0))
