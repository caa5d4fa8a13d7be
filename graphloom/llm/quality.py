"""Quality scores: random Fourier features of document statistics, ridge, isotonic calibration."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, slices, table
from .normal import bounded, ridge_weights

#: Random features, and the ridge penalty as a share of the rows.
FEATURES, PENALTY = 384, 1e-4
UPPER, LOWER, DIGIT, SPACE, HIGH = (np.isin(np.arange(256), list(x)) for x in (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" \t\n\r\x0b\x0c", range(128, 256)))
SYMBOLS = [ord(c) for c in "#$%&*|!?.,:;<>@/=-_()[]{}\"'"]


def document_statistics(text: str) -> list[float]:
    """Shares and averages that describe how a text is written, not what it says; empty texts give zeros."""
    data = text.encode("utf-8", "replace")
    n = len(data)
    if not n:
        return [0.0] * (17 + len(SYMBOLS))
    hist = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    share = hist / n
    letters = float(share[UPPER].sum() + share[LOWER].sum() + share[HIGH].sum())
    words = data.split()
    lines = [x for x in data.split(b"\n") if x.strip()]
    w, kinds = max(1, len(words)), len(set(words))
    seen = share[share > 0]
    ends = hist[ord(".")] + hist[ord("!")] + hist[ord("?")]
    return [
        np.log1p(n),
        np.log1p(len(words)),
        np.log1p(n / w),
        float(share[UPPER].sum()) / max(letters, 1e-9),
        float(share[DIGIT].sum()),
        float(share[SPACE].sum()),
        float(share[HIGH].sum()),
        letters,
        1 - letters - float(share[DIGIT].sum() + share[SPACE].sum()),
        kinds / np.sqrt(w),
        kinds / w,
        np.log1p(len(lines)),
        1 - len(set(lines)) / max(1, len(lines)),
        np.log1p(w / max(1, len(lines))),
        np.log1p(w / (1 + ends)),
        float(-(seen * np.log2(seen)).sum()),
        np.log1p(max(map(len, words), default=0)),
        *np.sqrt(share[SYMBOLS]),
    ]


class QualityModel:
    """Standardised statistics to kernel features to a ridge score to a calibrated probability."""

    def __init__(self, mean, spread, directions, phases, weights, knots, values):
        self.mean, self.spread, self.directions, self.phases = mean, spread, directions, phases
        self.weights, self.knots, self.values = weights, knots, values

    def kernel(self, stats: np.ndarray) -> np.ndarray:
        x = np.clip((stats - self.mean) / self.spread, -6, 6)
        z = np.sqrt(2 / self.directions.shape[1]) * np.cos(x @ self.directions + self.phases)
        return np.column_stack([z, np.ones(len(z))])

    def raw(self, texts) -> np.ndarray:
        return self.kernel(np.array([document_statistics(t or "") for t in texts])) @ self.weights

    def score(self, texts) -> np.ndarray:
        return np.interp(self.raw(texts), self.knots, self.values)


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots and values of the non-decreasing step means of y along x (pool adjacent violators)."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []
    for a, b in zip(x[order], y[order]):
        blocks.append([a, a, b, 1.0])
        while len(blocks) > 1 and blocks[-2][2] >= blocks[-1][2]:
            low, high = blocks[-2], blocks.pop()
            low[2] = (low[2] * low[3] + high[2] * high[3]) / (low[3] + high[3])
            low[1], low[3] = high[1], low[3] + high[3]
    knots, values = [], []
    for a, b, v, k in blocks:
        v = (v * k + 0.5) / (k + 1)
        knots += [a] if a == b else [a, b]
        values += [v] if a == b else [v, v]
    return np.array(knots), np.maximum.accumulate(np.array(values))


def fit_quality(docs: DataFrame, labels: DataFrame, most: int = 20_000, seed: int = 7) -> QualityModel:
    """Learns ``labels(doc_id, quality)`` from rows of ``docs(doc_id, text)`` that are not held out.

    Uses a sample of about ``most`` labelled rows, chosen by hash; a tenth of it is kept for the calibration.
    Without labelled rows every score is 0.5.
    """
    spark = docs.sparkSession
    named = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max(F.col("quality").cast("double")).alias("y"))
    # most doc_ids at about, each once: small enough to send to every task; of rows that repeat a doc_id, one text counts
    chosen = bounded(named, "doc_id", named.count(), most)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text")).select("text", "y", (F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(10)) == 0).alias("calibrate"))

    def stats(batches):
        for pdf in batches:
            for s in slices(pdf.text):
                yield pd.DataFrame({"x": [document_statistics(t or "") for t in pdf.text[s]], "y": pdf.y[s], "calibrate": pdf.calibrate[s]})

    from .common import cut

    sample = cut(rows.mapInPandas(stats, "x array<double>, y double, calibrate boolean"), "quality-sample")
    dim = 17 + len(SYMBOLS)
    m = sample.agg(F.count("*").alias("n"), *(f(F.col("x")[i]).alias(f"{k}{i}") for i in range(dim) for k, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
    rng = np.random.default_rng(seed)
    width = 1 / np.sqrt(2.0 * dim)
    mean = np.array([m[f"m{i}"] or 0.0 for i in range(dim)])
    spread = np.array([max(m[f"s{i}"] or 0.0, 1e-3) for i in range(dim)])
    model = QualityModel(mean, spread, rng.normal(0, width, (dim, FEATURES)), rng.uniform(0, 2 * np.pi, FEATURES), np.zeros(FEATURES + 1), np.array([0.0]), np.array([0.5]))
    fit = sample.where("not calibrate")
    weights, _, n = ridge_weights(fit.select("x", "y"), lambda pdf: (model.kernel(np.stack(pdf.x)), pdf.y.to_numpy()[:, None]), 1, PENALTY)
    if not n:
        return model
    model.weights = weights[:, 0]

    def raw(batches):
        for pdf in batches:
            if len(pdf):
                yield pd.DataFrame({"x": model.kernel(np.stack(pdf.x)) @ model.weights, "y": pdf.y})

    rest = sample.where("calibrate").select("x", "y").mapInPandas(raw, "x double, y double").toPandas()
    if len(rest):
        model.knots, model.values = isotonic(rest.x.to_numpy(), rest.y.to_numpy())
    else:
        model.knots, model.values = np.array([0.0, 1.0]), np.array([0.0, 1.0])
    return model


def score_quality(docs: DataFrame, model: QualityModel, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out boolean, score double, predicted int of ``docs(doc_id, text)``; nothing else is read.

    Null texts count as empty; empty texts get the score of their (zero) statistics. One row out for each row in.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def score(batches):
        for pdf in batches:
            for s in slices(pdf.text):
                p = model.score(pdf.text[s].tolist())
                yield pd.DataFrame({"doc_id": pdf.doc_id[s], "held_out": pdf.held_out[s], "score": p, "predicted": (p >= threshold).astype("int32")})

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), held_out(F.col("doc_id")).alias("held_out"))
    return rows.mapInPandas(score, f"doc_id {kind}, held_out boolean, score double, predicted int")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_quality(docs, fit_quality(docs, table(spark, sf_dir, "labels")))
