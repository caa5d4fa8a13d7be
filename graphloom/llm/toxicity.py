"""Toxic spans by a linear-chain conditional random field, document scores from its marginals."""

from __future__ import annotations

import re
import zlib
from array import array
from collections import Counter
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Memo, held_out, slices, table
from .normal import bounded

#: Hashed features; lengths of the word beginnings that are features beside the word.
DIM, HEADS = 1 << 18, (3, 4, 5, 6)
EDGE = re.compile(r"^[\W\d_]+|[\W\d_]+$")
SENTENCE_END = (".", "!", "?")


def word_features(raw: str) -> list[str]:
    """The folded word and its beginnings."""
    w = EDGE.sub("", raw.lower())
    return [f"w={w}"] + [f"{n}={w[:n]}" for n in HEADS if len(w) >= n] if w else []


def hashed(features: list[str]) -> list[int]:
    return [zlib.crc32(f.encode("utf-8", "replace")) % DIM for f in features]


def chain_logits(e: np.ndarray, first: np.ndarray, size: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward log-odds of the toxic state at each position of sequences laid end to end.

    ``e`` holds the log-odds that a word itself gives, ``move`` the scores of 0 to 1, 1 to 0 and 1 to 1 (0 to 0 is
    0). Sequences are stepped through together, longest first, so a step touches those that are long enough.
    """
    order = np.argsort(-size, kind="stable")
    first, size = first[order], size[order]
    t01, t10, t11 = move
    r, b = e.copy(), np.zeros_like(e)
    active = np.searchsorted(-size, -np.arange(int(size[0]) if len(size) else 0), side="left")
    for t in range(1, len(active)):
        at = first[: active[t]] + t
        before = r[at - 1]
        r[at] += np.logaddexp(t01, t11 + before) - np.logaddexp(0.0, t10 + before)
    last = first + size - 1
    for t in range(1, len(active)):
        at = last[: active[t]] - t
        after = e[at + 1] + b[at + 1]
        b[at] = np.logaddexp(t10, t11 + after) - np.logaddexp(0.0, t01 + after)
    return r, b


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class ToxicModel:
    """Weights of hashed word features, a bias, the three moves between states, and weights of document features."""

    def __init__(self, weights: np.ndarray, bias: float, move: np.ndarray, document: np.ndarray | None = None):
        # most features are never seen: only those with a weight are sent to the tasks
        self.at = np.flatnonzero(weights)
        self.value, self.bias, self.move, self.document = weights[self.at].astype(np.float32), bias, move, document
        self._ready()

    def _ready(self) -> None:
        self.known = dict(zip(self.at.tolist(), self.value.tolist()))
        self.words = Memo(self._word, 400_000)

    def __getstate__(self):
        return self.at, self.value, self.bias, self.move, self.document

    def __setstate__(self, state):
        self.at, self.value, self.bias, self.move, self.document = state
        self._ready()

    def _word(self, raw: str) -> int:
        """Log-odds of one word in thousandths, doubled; odd where the word ends a sentence."""
        e = self.bias + sum(self.known.get(f, 0.0) for f in hashed(word_features(raw)))
        return 2 * round(1000 * float(e)) + raw.endswith(SENTENCE_END)

    def marginals(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Probability that each word is toxic, and where each text's words begin."""
        words = [t.split() for t in texts]
        offsets = np.cumsum([0, *map(len, words)])
        packed = np.fromiter((x for w in words for x in map(self.words.__getitem__, w)), np.int64, offsets[-1])
        e, ends = (packed >> 1) / 1000, packed % 2 == 1
        ends[offsets[1:][np.diff(offsets) > 0] - 1] = True
        last = np.flatnonzero(ends)
        first = np.append(0, last[:-1] + 1) if len(last) else last
        r, b = chain_logits(e, first, last - first + 1, self.move)
        return _sigmoid(r + b), offsets

    def score(self, texts: list[str]) -> tuple[np.ndarray, list[list[tuple[int, int]]]]:
        """A probability for each text from its marginals together, and character spans of words at 0.5 or more.

        Texts without words, and all texts where nothing toxic was learned, get 0.
        """
        p, offsets = self.marginals(texts)
        x = document_features(p, offsets)
        best = np.zeros(len(texts)) if self.document is None else _sigmoid(x @ self.document) * (np.diff(offsets) > 0)
        spans: list[list[tuple[int, int]]] = [[] for _ in texts]
        for i in np.flatnonzero(x[:, 1] >= 0.5):
            hit = p[offsets[i] : offsets[i + 1]] >= 0.5
            for k, m in enumerate(re.finditer(r"[^\s\x1c-\x1f\x85]+", texts[i])):
                if k < len(hit) and hit[k]:
                    spans[i].append((m.start(), m.end()))
        return best, spans


def label_words(texts: list[str], toxic: np.ndarray, least: int = 4, odds: float = 2.3, evidence: float = 15.0) -> set[str]:
    """Features that mark toxic words: many times as frequent in toxic documents as in the others.

    ``evidence`` is the least likelihood ratio (G) of the documents that hold a feature: few labelled rows show little.
    Documents count by a sketch of their words, so that a group of near copies counts about once.
    """
    marks, features = [], Memo(word_features, 50_000)
    for i, t in enumerate(texts):
        words = set(t.split())
        if words:
            marks.append((min(zlib.crc32(w.encode("utf-8", "replace")) for w in words), i))
    # documents and occurrences of each feature; of clean documents, only features that toxic ones have count
    documents, occurrences, n = (Counter(), Counter()), (Counter(), Counter()), [0, 0]
    need = 0
    for y in (1, 0):
        for _, group in groupby(sorted(m for m in marks if toxic[m[1]] == y), key=lambda m: m[0]):
            most: Counter = Counter()
            for _, i in group:
                own: Counter = Counter()
                for w, k in Counter(texts[i].split()).items():
                    for f in features[w]:
                        if y or f in documents[1]:
                            own[f] += k
                most |= own
            n[y] += 1
            documents[y].update(most.keys())
            occurrences[y].update(most)
        if y:
            need = max(least, int(0.005 * n[1]))
            for f in [f for f, k in documents[1].items() if k < need]:
                del documents[1][f], occurrences[1][f]
    n0, n1 = max(1, n[0]), max(1, n[1])
    out = set()
    for f, k1 in documents[1].items():
        k0 = documents[0][f]
        g = 2 * sum(k * np.log(k * (n0 + n1) / ((k0 + k1) * m)) for k, m in ((k1, n1), (k0, n0)) if k)
        if g >= evidence and np.log((occurrences[1][f] + 0.5) / n1) - np.log((occurrences[0][f] + 0.5) / n0) >= odds:
            out.add(f)
    return out


def document_features(p: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """What a document's marginals say together: the largest, their sum, and their sum against its length."""
    n = np.diff(offsets)
    top, total = np.zeros(len(n)), np.zeros(len(n))
    full = np.flatnonzero(n)
    if len(full):
        top[full], total[full] = np.maximum.reduceat(p, offsets[full]), np.add.reduceat(p, offsets[full])
    share = np.log((total + 0.05) / (n + 20.0))
    return np.column_stack([np.ones(len(n)), top, top * top, np.log(total + 0.05), share, share * top])


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 0.05) -> np.ndarray:
    """Weights of a logistic regression with a ridge penalty, by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(40):
        p = _sigmoid(x @ w)
        h = (x * (p * (1 - p))[:, None]).T @ x + penalty * np.eye(len(w))
        w = w + np.clip(np.linalg.solve(h, x.T @ (y - p) - penalty * w), -2, 2)
    return w


def fit_toxicity(docs: DataFrame, labels: DataFrame, most: int = 3000, longest: int = 50_000, rounds: int = 60, clean_of: int = 8) -> ToxicModel:
    """Learns ``labels(doc_id, toxic)`` from rows of ``docs(doc_id, text)`` that are not held out.

    Uses a sample of about ``most`` labelled rows of either label, chosen by hash among texts of up to ``longest``
    characters; a quarter is kept to fit the document weights. Words of toxic documents are labelled by the features
    of ``label_words``, all words of other documents are clean. The chain learns from every sentence of the sample that
    holds a labelled word and from one in ``clean_of`` of the rest; the likelihood of the label sequences is climbed
    with adaptive steps. These bounds are on what is learned from; scores read every whole text.
    Without toxic rows all scores are 0.
    """
    named = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("y"))
    counts = {r.y: r.n for r in named.groupBy("y").agg(F.count("*").alias("n")).collect()}
    chosen = None
    for y in (0, 1):
        part = bounded(named.where(F.col("y") == y), "doc_id", counts.get(y, 0), most)
        chosen = part if chosen is None else chosen.union(part)
    # 2 * most doc_ids at about, each once: small enough to send to every task; of rows that repeat a doc_id, one text counts
    rows = docs.select("doc_id", "text").where(F.length("text").between(1, longest)).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    sample = rows.select("text", "y").orderBy(F.xxhash64("text")).toPandas()
    texts, toxic = sample.text.tolist(), sample.y.to_numpy()
    rest = np.arange(len(texts)) % 4 == 0
    own = np.flatnonzero(~rest)
    marks = label_words([texts[i] for i in own], toxic[own])
    vocabulary: dict[str, int] = {}
    ids, truth, ends = array("q"), array("b"), array("q")
    kept = 0
    for t, y in ((texts[i], toxic[i]) for i in own):
        sentence: list[str] = []
        for raw in [*t.split(), None]:
            if raw is not None:
                sentence.append(raw)
            if sentence and (raw is None or raw.endswith(SENTENCE_END)):
                hit = [bool(y) and not marks.isdisjoint(word_features(w)) for w in sentence]
                kept += 1
                if any(hit) or kept % clean_of == 0:
                    ids.extend(vocabulary.setdefault(w, len(vocabulary)) for w in sentence)
                    truth.extend(hit)
                    ends.append(len(ids))
                sentence = []
    weights, bias, move = np.zeros(DIM), -6.0, np.array([-1.0, 0.0, 0.0])
    if not any(truth):
        return ToxicModel(weights, bias, move)
    flat_list, lengths = array("q"), array("q")
    for w in vocabulary:
        own_features = hashed(word_features(w))
        flat_list.extend(own_features)
        lengths.append(len(own_features))
    kinds = len(lengths)
    owner, flat = np.repeat(np.arange(kinds), np.array(lengths)), np.array(flat_list)
    del vocabulary
    ids, y, ends = np.array(ids), np.array(truth, float), np.array(ends)
    first = np.append(0, ends[:-1])
    size = ends - first
    inner = np.ones(len(ids), bool)
    inner[ends - 1] = False
    left = np.flatnonzero(inner)
    speed, speed_b, speed_m = np.full(DIM, 1e-8), 1e-8, np.full(3, 1e-8)
    for _ in range(rounds):
        e = bias + np.bincount(owner, weights[flat], kinds)[ids]
        r, b = chain_logits(e, first, size, move)
        gap = y - _sigmoid(r + b)
        by_word = np.bincount(ids, gap, kinds)
        g = np.bincount(flat, by_word[owner], DIM) - 0.01 * weights
        after = e[left + 1] + b[left + 1]
        logs = np.stack([np.zeros(len(left)), move[0] + after, move[1] + r[left], move[2] + r[left] + after])
        p = np.exp(logs - np.logaddexp.reduce(logs, axis=0))
        y0, y1 = y[left], y[left + 1]
        gm = np.array([((1 - y0) * y1 - p[1]).sum(), (y0 * (1 - y1) - p[2]).sum(), (y0 * y1 - p[3]).sum()]) - 0.01 * move
        gb = gap.sum()
        speed, speed_b, speed_m = speed + g * g, speed_b + gb * gb, speed_m + gm * gm
        weights += g / np.sqrt(speed)
        bias += 0.3 * gb / np.sqrt(speed_b)
        move = move + 0.3 * gm / np.sqrt(speed_m)
    weights[np.abs(weights) < 1e-3] = 0
    model = ToxicModel(weights, float(bias), move)
    # the document weights are fitted where the chain was not, as long as that leaves enough toxic texts
    use = rest if toxic[rest].sum() >= 20 and (toxic[rest] == 0).sum() >= 20 else np.ones(len(toxic), bool)
    at = np.flatnonzero(use)
    model.document = logistic(document_features(*model.marginals([texts[i] for i in at])), toxic[at].astype(float))
    return model


def score_toxicity(docs: DataFrame, model: ToxicModel, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out boolean, score double, predicted int, spans of ``docs(doc_id, text)``; nothing else is read.

    The score joins the marginals of all words of the whole text: 0 for null texts and texts without words.
    ``spans`` are character ranges of words whose marginal is 0.5 or more. One row out for each row in.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def score(batches):
        for pdf in batches:
            for s in slices(pdf.text):
                p, spans = model.score(pdf.text[s].tolist())
                yield pd.DataFrame({"doc_id": pdf.doc_id[s], "held_out": pdf.held_out[s], "score": p, "predicted": (p >= threshold).astype("int32"), "spans": [[{"start": a, "end": b} for a, b in x] for x in spans]})

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), held_out(F.col("doc_id")).alias("held_out"))
    return rows.mapInPandas(score, f"doc_id {kind}, held_out boolean, score double, predicted int, spans array<struct<start: int, end: int>>")


def score_udf(model: ToxicModel):
    """Column function of a text: its score; 0 for null."""

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        parts = [model.score([t or "" for t in text[s]])[0] for s in slices(text)]
        return pd.Series(np.concatenate(parts) if parts else [])

    return score


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns, and ``spans``: where each text's toxic words begin and end."""
    docs = table(spark, sf_dir, "documents")
    return score_toxicity(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))
