"""Whitening: vectors along the principal axes of their covariance, each axis scaled to variance 1."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, drop, table
from .vectors import summed_product, whole_matrix, whole_vectors

#: Scaled components are held within this on either side.
LIMIT = 2.0**40


def jacobi(a: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and unit eigenvectors (columns) of a symmetric matrix, by falling eigenvalue.

    A sweep meets every pair of axes once, in rounds of disjoint pairs that are rotated together, until each
    off-diagonal entry is nothing beside the geometric mean of its two diagonal ones; so small eigenvalues of a
    covariance come out as exactly as large ones. Each axis points to where its largest component is positive.
    """
    a, d = a.astype(np.float64).copy(), len(a)
    v = np.eye(d)
    ring = [*range(d), *[-1] * (d % 2)]
    eps = np.finfo(np.float64).eps
    for _ in range(sweeps if d > 1 else 0):
        size = np.sqrt(np.abs(np.diag(a)))
        if (np.abs(a - np.diag(np.diag(a))) <= eps * np.outer(size, size) + eps * eps * np.abs(np.diag(a)).max()).all():
            break
        for _ in range(len(ring) - 1):
            p, q = (np.array(x) for x in zip(*((x, y) for x, y in zip(ring[: len(ring) // 2], ring[: len(ring) // 2 - 1 : -1]) if x >= 0 and y >= 0)))
            off = a[p, q]
            with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
                theta = (a[q, q] - a[p, p]) / (2 * off)
                t = np.where(theta < 0, -1.0, 1.0) / (np.abs(theta) + np.sqrt(theta * theta + 1))
            t = np.where(off == 0, 0.0, t)
            c = 1 / np.sqrt(t * t + 1)
            s = t * c
            for m in (a, v):
                m[:, p], m[:, q] = c * m[:, p] - s * m[:, q], s * m[:, p] + c * m[:, q]
            a[p], a[q] = c[:, None] * a[p] - s[:, None] * a[q], s[:, None] * a[p] + c[:, None] * a[q]
            a[p, q] = a[q, p] = 0
            ring = [ring[0], ring[-1], *ring[1:-1]]
    order = np.argsort(-np.diag(a), kind="stable")
    e, v = np.diag(a)[order], v[:, order]
    return e, v * np.where(v[np.abs(v).argmax(axis=0), np.arange(d)] < 0, -1.0, 1.0)


class Centre:
    """n and the sums S of the fit list; x - S/n keeps all digits, as the whole part of S/n comes off in whole numbers."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.sums = n, sums
        self.whole = np.array([s // n for s in sums], np.int64)
        self.rest = [s % n for s in sums]
        self.part = np.array([r / n for r in self.rest])

    def apply(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole).astype(np.float64) - self.part

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum of (n * x - S)**2 over the dimensions, exact; None where it exceeds 64 bits."""
        y = x - self.whole
        if not len(y):
            return []
        bound = (int(np.abs(y).max()) + 1) * self.n
        if bound * bound * y.shape[1] < 2**62:
            y = y * self.n - np.array(self.rest, np.int64)
            return (y * y).sum(axis=1).tolist()
        exact = [sum((int(v) * self.n - r) ** 2 for v, r in zip(line, self.rest)) for line in y.tolist()]
        return [d if d < 2**63 else None for d in exact]


def whiten(vectors: DataFrame, components: int = 16, scale: int = 64, offset: int = 1_000_000) -> DataFrame:
    """Whitens ``vectors(vec_id, embedding)`` along the first ``components`` axes of their covariance.

    Components become x = floor(scale * c) + offset. The fit list holds each distinct x vector once. Its sums are added up
    on Spark in whole numbers; then each task centres its rows and adds up their products, and the driver, which gets
    the summed matrix of dim x dim numbers, turns it by cyclic Jacobi rotations. The whitening matrix goes to the tasks with
    their code. ``identity_error`` is measured over the fit list in one more pass.

    Rows whose vector is null, empty, or holds null or non-finite entries drop out. Vectors of different length are fitted
    by themselves, one after the other. Axes without variance (an eigenvalue of rounding size) can't be scaled and are left
    out, so fewer than ``components`` may come back, and none where all vectors are equal. Repeated rows are in the fit list
    once and returned as often as they stand there; rows without vec_id are fitted and returned. Scaled entries beyond 2**40
    are held there, and a deviation that exceeds 64 bits is null. No rows give an empty result; other columns are ignored.
    Returns vec_id, component int, n long, deviation long, whitened, explained and identity_error double.
    """
    rows = whole_vectors(vectors, scale, LIMIT, F.col("vec_id").cast("long").alias("vec_id"))
    rows = cut(rows.withColumn("x", F.transform("x", lambda c: c + F.lit(offset))), "whiten-rows")
    fit = cut(rows.select("x").distinct(), "whiten-fit")
    out = rows.sparkSession.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    for dim, n in sorted((r.dim, r.n) for r in fit.groupBy(F.size("x").alias("dim")).agg(F.count("*").alias("n")).collect()):
        own = F.size("x") == dim
        out = out.union(_one_length(rows.where(own), fit.where(own), dim, n, components))
    drop(fit)
    return out


def _one_length(rows: DataFrame, fit: DataFrame, dim: int, n: int, components: int) -> DataFrame:
    sums = fit.select(F.posexplode("x").alias("at", "v")).groupBy("at").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("s")).collect()
    centre = Centre(n, [int(r.s) for r in sorted(sums)])
    scatter = summed_product(fit, lambda b: centre.apply(whole_matrix(b.column("x"))), dim) / n
    e, axes = jacobi((scatter + scatter.T) / 2)
    trace = float(np.trace(scatter))
    kept = int((e[:components] > dim * np.finfo(np.float64).eps * trace).sum())
    matrix = axes[:, :kept] / np.sqrt(e[:kept])
    explained = [float(x) / trace for x in e[:kept]]
    whitened = lambda b: centre.apply(whole_matrix(b.column("x"))) @ matrix
    error = 0.0
    if kept:
        # a last column of ones sums the values themselves, which are centred up to rounding
        total = summed_product(fit, lambda b: np.column_stack([whitened(b), np.ones(b.num_rows)]), kept + 1) / n
        error = float(np.abs(total[:kept, :kept] - np.outer(total[kept, :kept], total[kept, :kept]) - np.eye(kept)).max())

    def project(batches):
        for b in batches:
            if b.num_rows:
                deviation = pa.array(centre.deviation(whole_matrix(b.column("x"))), pa.int64())
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), deviation, pa.array(list(whitened(b)), pa.list_(pa.float64()))], names=["vec_id", "deviation", "w"])

    done = rows.mapInArrow(project, "vec_id long, deviation long, w array<double>").select("vec_id", "deviation", F.posexplode("w").alias("at", "whitened"))
    share = F.get(F.array(*map(F.lit, explained)) if kept else F.array().cast("array<double>"), F.col("at"))
    return done.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", share.alias("explained"), F.lit(error).alias("identity_error"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
