"""Token counts, byte BPE and packing against the tokenizer libraries."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from graphloom.llm import bpe, packing
from graphloom.llm.common import shared_dir
from graphloom.llm.tokens import count_tokens, token_counts

WORDS, RANKS = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PIECES = ["a", "B", "é", " ", "  ", "\n", "\t", "\r\n", " ", "́", "'s", "12", "!", "<|endoftext|>", " ", "\x1c", "\x85", "日本", "İ", "Σ", "😀", " \n", "\x0b", "word", "Ünder"]


def fuzz(n=2500, seed=5):
    rng = random.Random(seed)
    return ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 25))) for _ in range(n)]


def code_points(step=1):
    return [f"a{chr(c)}b {chr(c)}{chr(c)} {chr(c)}x" for c in [*range(1, 0x250), *range(0x250, 0x30000, step)] if not 0xD800 <= c < 0xE000]


def test_words_count_as_in_the_library():
    texts = fuzz() + code_points(17)
    library = Tokenizer.from_file(WORDS)
    assert count_tokens(texts, WORDS) == [len(x.ids) for x in library.encode_batch_fast(texts, add_special_tokens=False)]


def test_ranks_encode_as_in_the_library():
    encoder = bpe.rank_encoder(RANKS)
    for t in fuzz() + code_points(17):
        ids = encoder.encode(t)
        assert np.frombuffer(ids, "<u4").tolist() == encoder.library.encode_ordinary(t) and encoder.decode(ids) == t.encode()


def test_both_libraries_make_the_ids_that_are_packed():
    texts = fuzz() + code_points(17)
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for t, x in zip(texts, library.encode_batch_fast(texts, add_special_tokens=False)):
        assert np.frombuffer(packing.encode_text(t, 2), "<u4").tolist() == [*x.ids, 2]


def test_token_counts(spark, odd_docs):
    cache = f"{shared_dir(spark)}/test-token-cache"
    docs = odd_docs.withColumn("content", F.lit("x")).withColumn("n_tokens", F.lit(1))
    library = Tokenizer.from_file(WORDS)
    for _ in range(2):
        got = token_counts(docs, WORDS, cache, limit=100).collect()
        want = [(r.doc_id, len((r.text or "").encode()), n := len(library.encode(r.text or "", add_special_tokens=False).ids), n > 100) for r in odd_docs.collect()]
        assert Counter(map(tuple, got)) == Counter(want)
    stored = spark.read.parquet(cache)
    assert stored.count() == stored.select("content").distinct().count()


def check_bpe(docs, got):
    library = bpe.rank_encoder(RANKS).library
    want = []
    for r in docs.collect():
        ids = library.encode_ordinary(r.text or "")
        want.append((r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert Counter(map(tuple, got.collect())) == Counter(want)


def test_encode_documents(odd_docs):
    check_bpe(odd_docs, bpe.encode_documents(odd_docs.withColumn("rid", F.lit(1)), RANKS))


def test_chunks_stitch(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice(PIECES) for _ in range(300)) for _ in range(25)] + ["y" * 500, " " * 400, "\n \t" * 150, "a b " * 200]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    check_bpe(docs, bpe.encode_documents(docs, RANKS, chunk=60, overlap=25))


def check_packing(docs, got):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = got.collect()
    pieces = Counter()
    for r in docs.collect():
        ids = np.array([*library.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4")
        n, first = len(ids), len(ids) % 1024 or 1024
        for i, (a, b) in enumerate(zip([0, *range(first, n, 1024)], [*range(first, n, 1024), n])):
            pieces[(r.doc_id, i, a, b - a, zlib.crc32(ids[a:b].tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == pieces
    at = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == at.get(r.sequence_id, 0)
        at[r.sequence_id] = r.offset + r.length
    assert all(n <= 1024 for n in at.values())
    return len(at), -(-sum(r.length for r in rows) // 1024)


def test_pack_documents(odd_docs, no_docs):
    used, bound = check_packing(odd_docs, packing.pack_documents(odd_docs.withColumn("bucket", F.lit(1)).withColumn("length", F.lit(9))))
    assert used <= bound + 1
    assert packing.pack_documents(no_docs).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_plans_use_up_the_histogram(seed):
    rng = random.Random(seed)
    counts = dict(Counter(rng.randint(1, 1024) if seed % 2 else rng.choice([1, 5, 500, 524, 1023]) for _ in range(3000)))
    plan = packing.plan(counts, 1024)
    used = Counter()
    for p, k in plan.items():
        assert sum(p) <= 1024 and k > 0
        for x in p:
            used[x] += k
    assert used == counts and sum(plan.values()) <= sum(packing.best_fit(counts, 1024).values())


@pytest.mark.parametrize("scale", ["sf0.001", "sf0.01", "sf0.1"])
def test_fitted_patterns_decide(spark, scale):
    """Nine in ten sequences of several pieces are fitted counts, and there are no more sequences than by plain best fit."""
    docs = spark.read.parquet(f"/root/testdata/{scale}/documents.parquet").select(F.lit(1).alias("doc_id"), "text")
    rows = docs.mapInPandas(lambda batches: (pd.DataFrame({"n": [n for t in b.text for _, n in packing.cut_points(len(packing.encode_text(t, 2)) // 4, 1024)]}) for b in batches), "n long")
    counts = {r.n: r["count"] for r in rows.groupBy("n").count().collect()}
    plan = packing.plan(counts, 1024)
    several = lambda p: sum(k for x, k in p.items() if len(x) > 1)
    fitted = [packing.fitted_plan(counts, 1024, *schedule) for schedule in packing.SCHEDULES]
    own, rest = min(fitted, key=lambda f: (f[0].total() + sum(packing.best_fit(f[1], 1024).values()), -f[0].total()))
    assert all(plan[p] >= k for p, k in own.items())
    assert several(own) >= 0.9 * several(plan) and sum(plan.values()) <= sum(packing.best_fit(counts, 1024).values())


def test_one_encoding_a_content(spark, tmp_path):
    """Rows that repeat a doc_id with its text, and rows without one, are encoded once a content."""
    rows = [(7, "some words")] * 500 + [(None, "more  words")] * 300 + [(8, "some words"), (9, "other")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert token_counts(docs, WORDS, str(tmp_path)).count() == 802
    stored = spark.read.parquet(str(tmp_path) + "/*")
    assert stored.count() == stored.select("content").distinct().count() == 3
    assert token_counts(docs, WORDS, str(tmp_path)).count() == 802 and spark.read.parquet(str(tmp_path) + "/*").count() == 3


def test_empty_tables(spark, no_docs):
    assert token_counts(no_docs, WORDS, f"{shared_dir(spark)}/none").count() == 0
    assert bpe.encode_documents(no_docs, RANKS).count() == 0


def test_texts_of_packing_are_encoded_by_few_calls(monkeypatch):
    # words that stand once cost a call of the library each before (op5: 525 CPU seconds a GB)
    texts = [" ".join(f"w{i}x{j}" for j in range(40)) + f"\nline {i}" for i in range(50)]
    texts += ["", "a", " a", "a ", "a\n\nb", "a  b", "é ß\nü", "x <|endoftext|> y", "ж a", "\x00 \x00", "a\tb \tc", "a\x85 b", "ɏ ɐ"]
    library = packing._library(public_tokenizers.path(packing.VOCABULARY[0]))
    expected = [[*library.encode(t, add_special_tokens=False).ids, 2] for t in texts]
    calls, whole = [], bpe.RankEncoder.whole
    monkeypatch.setattr(bpe.RankEncoder, "whole", lambda self, t: calls.append(t) or whole(self, t))
    assert [np.frombuffer(x, "<u4").tolist() for x in packing.encode_texts(texts, 2)] == expected
    assert len(calls) < 2 * len(texts)
