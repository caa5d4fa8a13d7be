"""Every opN_ query by name on the smallest tables, and the pipeline's stages on odd input, against brute force."""

import base64
import hashlib
import os
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from graphloom.llm import langid, quality, registry, toxicity
from graphloom.llm.normal import ridge, ridge_weights
from graphloom.llm.suffix_dedup import remove_repeats

from .conftest import ODD, SCHEMA, make_docs
from .test_dedup import brute_repeats

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables here")


@pytest.fixture(scope="module")
def docs():
    return pq.read_table(f"{DIR}/documents.parquet").to_pylist()


@pytest.fixture(scope="module")
def labels():
    return pq.read_table(f"{DIR}/labels.parquet").to_pylist()


def run(spark, name):
    return registry.queries()[name](spark, DIR).collect()


def is_held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_with_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DIR):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DIR}/{f}'")
    want = con.execute(registry.oracle_sql()[name]).df()
    got = registry.queries()[name](spark, DIR).toPandas()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert sorted(got[columns].astype(str).values.tolist()) == sorted(want[columns].astype(str).values.tolist())


def test_op2_counts_as_the_library(spark, docs):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {}
    for d in docs:
        n = len(library.encode(d["text"] or "", add_special_tokens=False).ids)
        want[d["doc_id"]] = (len((d["text"] or "").encode()), n, n > 2048)
    assert {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in run(spark, "op2_token_counts")} == want


def test_op4_encodes_as_the_library(spark, docs):
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
    library = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {}
    for d in docs:
        text = d["text"] or ""
        ids = library.encode_ordinary(text)
        want[d["doc_id"]] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in run(spark, "op4_byte_bpe")} == want


def test_op5_packs_all_ids(spark, docs):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in run(spark, "op5_pattern_packing"):
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    assert set(pieces) == {d["doc_id"] for d in docs}
    total = 0
    for d in docs:
        ids = [*library.encode(d["text"] or "", add_special_tokens=False).ids, 2]
        total, at = total + len(ids), 0
        own = sorted(pieces[d["doc_id"]], key=lambda r: r.piece)
        for k, r in enumerate(own):
            assert (r.piece, r.start) == (k, at) and r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            assert len(ids) <= 1024 and len(own) == 1 or k == 0 or r.length == 1024
            at += r.length
        assert at == len(ids)
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(sequences) <= 1.02 * (total / 1024) + 1


def test_op8_removes_what_brute_force_removes(spark, docs):
    want = {d["doc_id"]: x for d, x in zip(docs, brute_repeats([d["text"] for d in docs]))}
    got = run(spark, "op8_repeated_strings")
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == want and len(got) == len(docs)


def test_op3_equals_normal_equations_of_all_rows(spark, docs, labels):
    """All labelled rows fit in the sample here, so that numpy can repeat the fit without Spark."""
    y = {x["doc_id"]: x["quality"] for x in labels if x["quality"] in (0, 1) and not is_held_out(x["doc_id"])}
    got = run(spark, "op3_quality")
    frame = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", (F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(10)) == 0).alias("c"))
    calibrate = {r.doc_id for r in frame.where("c").collect()}
    rows = [d for d in docs if d["doc_id"] in y]
    x = np.array([quality.document_statistics(d["text"] or "") for d in rows])
    t = np.array([float(y[d["doc_id"]]) for d in rows])
    rest = np.array([d["doc_id"] in calibrate for d in rows])
    rng, dim = np.random.default_rng(7), x.shape[1]
    model = quality.QualityModel(x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3), rng.normal(0, 1 / np.sqrt(2.0 * dim), (dim, quality.FEATURES)), rng.uniform(0, 2 * np.pi, quality.FEATURES), None, None, None)
    z = model.kernel(x)
    fit = z[~rest]
    model.weights = np.linalg.solve(fit.T @ fit + quality.PENALTY * len(fit) * np.eye(fit.shape[1]), fit.T @ t[~rest])
    model.knots, model.values = quality.isotonic(z[rest] @ model.weights, t[rest])
    want = dict(zip([d["doc_id"] for d in docs], model.score([d["text"] for d in docs])))
    assert len(got) == len(docs)
    for r in got:
        assert abs(r.score - want[r.doc_id]) < 1e-6 and r.predicted == int(r.score >= 0.3) and r.held_out == is_held_out(r.doc_id)


def test_op7_decodes_as_explicit_loops(spark, docs):
    got = {r.doc_id: r for r in run(spark, "op7_language_id")}
    rows = [d for d in docs if d["text"] and d["lang"] is not None and not is_held_out(d["doc_id"])]
    langs = sorted({d["lang"] for d in rows})
    book = langid.code_words(len(langs))
    z = np.stack([langid.n_gram_features(d["text"]) for d in rows])
    y = np.stack([book[langs.index(d["lang"])] for d in rows])
    weights = np.linalg.solve(z.T @ z + langid.PENALTY * len(z) * np.eye(z.shape[1]), z.T @ y)
    trust = [max(0.05, 1 - np.mean((y[:, b] - z @ weights[:, b]) ** 2)) for b in range(book.shape[1])]
    assert len(got) == len(docs)
    for d in docs:
        text = d["text"]
        if not text or not any(c.isalpha() for c in text):
            assert got[d["doc_id"]].lang_pred == "und"
            continue
        bits = langid.n_gram_features(text) @ weights
        losses = [sum(w / sum(trust) * np.exp(-min(4, max(-4, v)) * c) for w, v, c in zip(trust, bits, word)) for word in book]
        share = [np.exp(-3 * (x - min(losses))) for x in losses]
        assert got[d["doc_id"]].lang_pred == langs[int(np.argmin(losses))]
        assert abs(got[d["doc_id"]].score - max(share) / sum(share)) < 1e-6


def test_op9_scores_as_a_plain_forward_backward(spark, docs):
    frame = spark.read.parquet(f"{DIR}/documents.parquet")
    model = toxicity.fit_toxicity(frame, spark.read.parquet(f"{DIR}/labels.parquet"))
    got = {r.doc_id: r for r in run(spark, "op9_toxicity")}
    assert len(got) == len(docs)
    step = np.exp([[0.0, model.move[0]], [model.move[1], model.move[2]]])
    for d in docs[:150]:
        words, p = (d["text"] or "").split(), []
        sentence: list[str] = []
        for k, w in enumerate(words):
            sentence.append(w)
            if w.endswith(toxicity.SENTENCE_END) or k == len(words) - 1:
                emit = [np.exp([0.0, round(1000 * (model.bias + sum(model.known.get(f, 0.0) for f in toxicity.hashed(toxicity.word_features(x))))) / 1000]) for x in sentence]
                ahead, behind = [emit[0]], [np.ones(2)]
                for e in emit[1:]:
                    v = ahead[-1] @ step * e
                    ahead.append(v / v.sum())
                for e in emit[:0:-1]:
                    v = step @ (e * behind[-1])
                    behind.append(v / v.sum())
                for a, b in zip(ahead, reversed(behind)):
                    p.append(a[1] * b[1] / (a @ b))
                sentence = []
        row = got[d["doc_id"]]
        if not words or model.document is None:
            assert row.score == 0
            continue
        top, total = max(p), sum(p)
        share = np.log((total + 0.05) / (len(p) + 20))
        x = np.array([1, top, top * top, np.log(total + 0.05), share, share * top])
        assert abs(row.score - 1 / (1 + np.exp(-x @ model.document))) < 1e-4
        assert abs(len(row.spans) - sum(v >= 0.5 for v in p)) <= sum(abs(v - 0.5) < 1e-6 for v in p)


def test_ridge_sums_equal_numpy(spark):
    rng = np.random.default_rng(3)
    z, y = rng.normal(size=(500, 150)), rng.normal(size=(500, 3))
    frame = spark.createDataFrame([(a.tolist(), b.tolist()) for a, b in zip(z, y)], "z array<double>, y array<double>")
    gram, cross, n = ridge(frame, lambda pdf: (np.stack(pdf.z), np.stack(pdf.y)), 3)
    assert n == 500 and np.allclose(gram, z.T @ z) and np.allclose(cross, z.T @ y)
    weights, fall, n = ridge_weights(frame, lambda pdf: (np.stack(pdf.z), np.stack(pdf.y)), 3, 0.01)
    want = np.linalg.solve(z.T @ z + 0.01 * n * np.eye(150), z.T @ y)
    assert n == 500 and np.allclose(weights, want) and np.allclose(fall, (y * y).sum(axis=0) - ((y - z @ want) ** 2).sum(axis=0))
    assert ridge_weights(frame.where("false"), lambda pdf: (np.stack(pdf.z), np.stack(pdf.y)), 3, 0.01)[2] == 0


def test_languages_learn_each_doc_id_once(spark):
    """A doc_id that half of the rows repeat weighs as one document, and the bound holds for doc_ids."""
    rows = [(i, ("the cat and the hat " if i % 2 else "der hund und die katze ") * (1 + i % 5), "en" if i % 2 else "de") for i in range(40)]
    once = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    often = once.union(once.where("doc_id = 3").crossJoin(spark.range(40)).select("doc_id", "text", "lang"))
    a, b = langid.fit_languages(once), langid.fit_languages(often)
    assert a.langs == b.langs == ["de", "en"] and np.allclose(a.weights, b.weights) and np.allclose(a.losses, b.losses)


def test_texts_longer_than_a_block(spark):
    """Repeats across the blocks of 524,288 bytes, and n-grams across those of 1,048,576."""
    rng = np.random.default_rng(8)
    long = "".join(map(chr, rng.integers(97, 123, 1_100_000)))
    edge, later = long[524_288 - 700 : 524_288 + 300], long[1_048_576 - 200 : 1_048_576 + 600]
    texts = [long, "1" * 50 + edge, later + "2" * 50]
    got = remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [(r.n_removed, r.n_spans) for r in got] == [(1800, 2), (1000, 1), (800, 1)]
    data = np.frombuffer((" " + long + " ").encode().translate(langid.FOLD), np.uint8).astype(np.uint64)
    count = np.zeros(langid.DIM)
    for n in langid.GRAMS:
        g = np.zeros(len(data) - n + 1, np.uint64)
        for i in range(n):
            g = (g << np.uint64(8) | data[i : len(data) - n + 1 + i]) & np.uint64(2**32 - 1)
        h = (g * np.uint64(int(langid.MIX)) & np.uint64(2**32 - 1)) ^ np.uint64(n * 0x85EBCA6B & 0xFFFFFFFF)
        count += np.bincount((h * np.uint64(int(langid.MIX)) & np.uint64(2**32 - 1)) >> np.uint64(22), minlength=langid.DIM)
    assert np.allclose(langid.n_gram_features(long)[:-1], np.sqrt(count / count.sum()))


@pytest.mark.parametrize("rows", [[], ODD, [*make_docs(20), *make_docs(20)]])
def test_stages_on_odd_input(spark, tmp_path, rows):
    """Empty tables, nulls, repeated rows, clashing columns and no labels: a defined result at every stage."""
    df = spark.createDataFrame(rows, SCHEMA)
    wide = df.withColumns({c: F.lit("x") for c in ("rid", "digest", "first", "score", "spans", "kept_text", "_language", "_toxic", "n_bytes")})
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, wide, str(tmp_path))
        assert out.columns == corpus_pipeline.COLUMNS
        left, before = Counter(map(tuple, out.collect())), Counter(rows)
        if name in ("toxicity", "near_duplicates"):
            assert left <= before
        if name == "toxicity":
            assert left == before
        if name == "language_id":
            assert left <= before and not any(not r[1] for r in left)
        if name == "repeated_strings":
            assert sum(left.values()) == len(rows)
    packed = corpus_pipeline.pack(spark, wide, str(tmp_path)).collect()
    assert Counter(r.doc_id for r in packed if r.piece == 0) == Counter(r[0] for r in rows)
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} <= {r[0] for r in rows}


def test_repeats_leave_whole_characters(spark, tmp_path):
    """The stage's text is what brute force leaves, without the halves of characters that a removed run has cut."""
    passage = "é" * 150 + "".join(chr(97 + i * i % 26) for i in range(300))
    texts = ["a" + passage + "b", "ü" + passage[:-1], "plain", None, "x" + "".join(chr(97 + i * i % 26) for i in range(300)) + passage[:250]]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMA)
    got = {r.doc_id: r.text for r in corpus_pipeline.remove_repeated_strings(spark, df, str(tmp_path)).collect()}
    data = [(t or "").encode() for t in texts]
    seen = Counter(b[p : p + 400] for b in data for p in range(len(b) - 399))
    for i, b in enumerate(data):
        gone = {q for p in range(len(b) - 399) if seen[b[p : p + 400]] > 1 for q in range(p, p + 400)}
        kept = bytes(c for q, c in enumerate(b) if q not in gone)
        assert got[i] == (kept.decode("utf-8", "ignore") if gone else texts[i])
