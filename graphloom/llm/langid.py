"""Language identification by error-correcting output codes over byte n-grams."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, slices, table
from .normal import ridge_weights

#: Hashed features, n-gram lengths in bytes, bits of a code word, ridge penalty (as a share of the rows).
DIM, GRAMS, BITS, PENALTY = 1024, (1, 2, 3, 4), 15, 1e-5
#: Upper case ASCII to lower case; digits, punctuation and white space to blanks.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
MIX = np.uint32(0x9E3779B1)


def n_gram_features(text: str) -> np.ndarray:
    """Square roots of the shares of hashed byte n-grams, and a constant; blocks keep long texts within memory."""
    data = np.frombuffer(b" " + text.encode("utf-8", "replace").translate(FOLD) + b" ", np.uint8)
    count = np.zeros(DIM)
    for at in range(0, len(data), 1 << 20):
        block = data[at : at + (1 << 20) + max(GRAMS) - 1].astype(np.uint32)
        gram = np.zeros(len(block), np.uint32)
        for n in range(1, max(GRAMS) + 1):
            gram = (gram[: len(block) - n + 1] << np.uint32(8)) | block[n - 1 :]
            if n in GRAMS and len(gram):
                own = gram[: 1 << 20]
                count += np.bincount(((own * MIX) ^ np.uint32(n * 0x85EBCA6B & 0xFFFFFFFF)) * MIX >> np.uint32(22), minlength=DIM)
    return np.append(np.sqrt(count / max(1.0, count.sum())), 1.0)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def code_words(k: int, bits: int = BITS) -> np.ndarray:
    """k code words of +-1, far apart: the best of many seeded random books, without constant bits where k > 1."""
    if k < 2:
        return np.ones((k, bits))
    bits = max(bits, 4 * int(np.ceil(np.log2(k))))
    best, far = None, -1
    for seed in range(400 if k <= 64 else 20):
        book = np.random.default_rng(seed).choice([-1.0, 1.0], (k, bits))
        if (np.abs(book.sum(axis=0)) == k).any():
            book[0, np.abs(book.sum(axis=0)) == k] *= -1
        gap = bits - book @ book.T
        np.fill_diagonal(gap, 2 * bits)
        if gap.min() > far:
            best, far = book, gap.min()
    return best


class LanguageModel:
    """Ridge classifiers of the bits, the weight of each bit's loss, and the book of code words."""

    def __init__(self, langs: list[str], book: np.ndarray, weights: np.ndarray, losses: np.ndarray, margin: float = 0.05):
        self.langs, self.book, self.weights, self.losses, self.margin = langs, book, weights, losses, margin

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language, score, ambiguous): exponential losses of the bits, weighted, decide between code words."""
        known = np.array([bool(self.langs) and t is not None and has_letter(t) for t in texts], bool)
        lang, score, unclear = ["und"] * len(texts), np.zeros(len(texts)), ~known
        at = np.flatnonzero(known)
        if len(at):
            bits = np.stack([n_gram_features(texts[i]) for i in at]) @ self.weights
            loss = np.exp(-np.clip(bits, -4, 4)[:, None, :] * self.book[None]) @ self.losses
            p = np.exp(-3.0 * (loss - loss.min(axis=1, keepdims=True)))
            p /= p.sum(axis=1, keepdims=True)
            best = loss.argmin(axis=1)
            for i, b in zip(at, best):
                lang[i] = self.langs[b]
            score[at] = p[np.arange(len(at)), best]
            if len(self.langs) > 1:
                two = np.partition(loss, 1, axis=1)[:, :2]
                unclear[at] = two[:, 1] - two[:, 0] < self.margin
        return lang, score, unclear


def fit_languages(docs: DataFrame, most: int = 12_000) -> LanguageModel:
    """Learns from the text and non-null lang of rows of ``docs(doc_id, text, lang)`` that are not held out.

    Fits on a sample of about ``most`` doc_ids, spread evenly over the languages (all of a rare one), one text of each. Bits are
    weighted by how well they tell their sides apart on the sample. No labelled rows give a model that answers ``und``.
    """
    rows = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.length("text") > 0))
    # doc_ids, not rows, are counted and chosen, so that one that many rows repeat is one row of the sample
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.approx_count_distinct("doc_id", 0.01).alias("n")).collect()}
    langs = sorted(counts)
    if not langs:
        return LanguageModel([], np.zeros((0, BITS)), np.zeros((DIM + 1, BITS)), np.ones(BITS))
    share = max(1, most // len(langs))
    bounds = rows.sparkSession.createDataFrame([(la, int(min(1.0, share / max(1, counts[la])) * (1 << 30))) for la in langs], "lang string, bound long")
    chosen = rows.join(F.broadcast(bounds), "lang").where(F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1 << 30)) < F.col("bound"))
    sample = chosen.groupBy("doc_id", "lang").agg(F.min("text").alias("text"))
    book = code_words(len(langs))
    code = dict(zip(langs, book))

    def features(pdf: pd.DataFrame):
        return np.stack([n_gram_features(t) for t in pdf.text]), np.stack([code[x] for x in pdf.lang])

    weights, explained, n = ridge_weights(sample.select("text", "lang"), features, book.shape[1], PENALTY)
    if not n:
        return LanguageModel([], np.zeros((0, BITS)), np.zeros((DIM + 1, BITS)), np.ones(BITS))
    # |y|^2 - |y - Zw|^2 of each bit, whose |y|^2 is n: the share that a bit explains is its weight
    trust = np.clip(explained / n, 0.05, None)
    return LanguageModel(langs, book, weights, trust / trust.sum())


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, held_out boolean, lang_pred string, score double, ambiguous boolean of ``docs(doc_id, text)``.

    Texts that are null or hold no letter are ``und`` with score 0. One row out for each row in, whatever the
    doc_ids (a null one counts as held out); whole texts are read; other columns are ignored.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def score(batches):
        for pdf in batches:
            for s in slices(pdf.text):
                lang, p, unclear = model.predict(pdf.text[s].tolist())
                yield pd.DataFrame({"doc_id": pdf.doc_id[s], "held_out": pdf.held_out[s], "lang_pred": lang, "score": p, "ambiguous": unclear})

    rows = docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))
    return rows.mapInPandas(score, f"doc_id {kind}, held_out boolean, lang_pred string, score double, ambiguous boolean")


def language_udf(model: LanguageModel):
    """Column function of a text: struct of lang, score and ambiguous."""

    @F.pandas_udf("lang string, score double, ambiguous boolean")
    def language(text: pd.Series) -> pd.DataFrame:
        parts = [pd.DataFrame(dict(zip(("lang", "score", "ambiguous"), model.predict(text[s].tolist())))) for s in slices(text)]
        return pd.concat(parts, ignore_index=True) if parts else pd.DataFrame({"lang": [], "score": [], "ambiguous": []})

    return language


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, fit_languages(docs))
