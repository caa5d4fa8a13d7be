"""Partition-summed normal equations, shared by the ridge models."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of the Gram matrix in one shuffled block.
BLOCK = 128


def _blocks(rows: DataFrame, features, targets: int, parts: int) -> DataFrame:
    """(at, n, gram, cross): blocks of BLOCK rows of Z'Z and Z'Y, summed over ``rows``."""

    def sums(batches):
        gram = cross = None
        n = 0
        for pdf in batches:
            if not len(pdf):
                continue
            z, y = features(pdf)
            if gram is None:
                gram, cross = np.zeros((z.shape[1],) * 2), np.zeros((z.shape[1], targets))
            gram += z.T @ z
            cross += z.T @ y
            n += len(z)
        if gram is not None:
            for at in range(0, len(gram), BLOCK):
                s = slice(at, at + BLOCK)
                yield pd.DataFrame({"at": [at], "n": [n], "gram": [gram[s].tobytes()], "cross": [cross[s].tobytes()]})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = [np.sum([np.frombuffer(x) for x in pdf[c]], axis=0).tobytes() for c in ("gram", "cross")]
        return pd.DataFrame({"at": pdf["at"][:1], "n": [pdf.n.sum()], "gram": [total[0]], "cross": [total[1]]})

    kind = "at long, n long, gram binary, cross binary"
    return rows.repartition(parts).mapInPandas(sums, kind).groupBy("at").applyInPandas(add, kind)


def _joined(gram, cross, targets: int) -> tuple[np.ndarray, np.ndarray]:
    cross = np.concatenate([np.frombuffer(c).reshape(-1, targets) for c in cross])
    return np.concatenate([np.frombuffer(g).reshape(-1, len(cross)) for g in gram]), cross


def ridge(rows: DataFrame, features, targets: int, parts: int = 8) -> tuple[np.ndarray, np.ndarray, float]:
    """(Z'Z, Z'Y, number of rows) summed over ``rows``.

    ``features(pandas frame) -> (Z, Y)`` runs in the tasks. Each of the ``parts`` tasks sums its rows into one
    Gram matrix; blocks of BLOCK matrix rows are added up on Spark. What reaches the driver is the square of the
    number of features, whatever the number of rows.
    """
    found = _blocks(rows, features, targets, parts).orderBy("at").collect()
    if not found:
        return np.zeros((0, 0)), np.zeros((0, targets)), 0
    return *_joined([r.gram for r in found], [r.cross for r in found], targets), found[0].n


def ridge_weights(rows: DataFrame, features, targets: int, penalty: float, parts: int = 8) -> tuple[np.ndarray, np.ndarray, int]:
    """(W, g, n): the ridge weights of the sums above, and by how much each target's squares fall with them.

    The system is solved in one task, which gets the square of the number of features, whatever the number of rows; the
    driver gets the weights alone. ``penalty`` is a share of the rows. Without rows W has none, and n is 0.
    """

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("at")
        gram, cross = _joined(pdf["gram"], pdf["cross"], targets)
        n = int(pdf.n.iloc[0])
        w = np.linalg.solve(gram + penalty * n * np.eye(len(gram)), cross)
        fall = 2 * (w * cross).sum(axis=0) - (w * (gram @ w)).sum(axis=0)
        return pd.DataFrame({"n": [n], "w": [w.tobytes()], "fall": [fall.tobytes()]})

    found = _blocks(rows, features, targets, parts).groupBy().applyInPandas(solve, "n long, w binary, fall binary").first()
    if found is None:
        return np.zeros((0, targets)), np.zeros(targets), 0
    return np.frombuffer(found.w).reshape(-1, targets), np.frombuffer(found.fall), found.n


def bounded(rows: DataFrame, key, total: int, most: int) -> DataFrame:
    """About ``most`` of ``total`` rows, chosen by a hash of ``key``: the documented bound of a training sample."""
    if total <= most:
        return rows
    return rows.where(F.pmod(F.xxhash64(key, F.lit(17)), F.lit(1 << 30)) < int(most / total * (1 << 30)))
