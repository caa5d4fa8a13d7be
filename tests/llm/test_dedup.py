"""Near duplicates, repeated strings and the pipeline against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from graphloom.llm import minhash
from graphloom.llm.suffix_dedup import merged, remove_repeats, sampled_positions

from .conftest import ODD, SCHEMA, make_docs


def near_copies(seed=3):
    """Chains and stars of edited texts: some pairs above the limit, many just below."""
    rng = random.Random(seed)
    docs = make_docs(30, seed)
    at = 100
    for base in docs[:8]:
        words = base[1].split()
        for _ in range(10):
            copy = list(words)
            for _ in range(rng.randint(0, max(1, len(words) // 25))):
                copy[rng.randrange(len(copy))] = rng.choice(["new", "other", "word"]) + str(rng.randint(0, 99))
            docs.append((at, " ".join(copy), "en", "s", 0))
            at += 1
    return docs


def shingles(text, size):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def brute_components(docs, size, percent):
    sets = [shingles(d[1], size) for d in docs]
    root = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = [new if r == old else r for r in root]
    least = {}
    for r, d in zip(root, docs):
        if d[0] is not None:
            least[r] = min(least.get(r, d[0]), d[0])
    return Counter((d[0], len(s), least.get(r)) for d, s, r in zip(docs, sets, root))


@pytest.mark.parametrize("block, pivots", [(256, 3), (4, 0)])
def test_near_duplicates(spark, block, pivots):
    docs = near_copies() + ODD
    df = spark.createDataFrame(docs, SCHEMA).withColumns({c: F.lit("x") for c in ("rid", "digest", "first", "regs", "cid", "root", "row")})
    done = minhash.near_duplicate_rows(df, 3, 85, block=block, pivots=pivots)
    assert done.columns == [*(c for c in df.columns if c != "first"), "n_shingles", "component_id", "first"]
    got = done.collect()
    assert all(r.rid == r.digest == r.regs == r.row == "x" for r in got)
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(docs, 3, 85)
    assert Counter(r.component_id for r in got if r["first"] and r.n_shingles) == Counter({r.component_id for r in got if r.n_shingles})
    kept = minhash.minhash_near_dedup(df).collect()
    assert all(r.kept == (r.doc_id == r.component_id) for r in kept if r.doc_id is not None)


def template_pages(n, seed=9, own=12, form=80, twins=20):
    """Pages of one form, alike at 73 %, each with words of its own; the first few have a near copy."""
    rng = random.Random(seed)
    frame = [f"form{i}" for i in range(form)]
    pages = [(i, " ".join([*frame[: form // 2], *(f"own{i}x{rng.randint(0, 10**9)}" for _ in range(own)), *frame[form // 2 :]])) for i in range(n)]
    return pages + [(n + i, t + " more") for i, t in pages[:twins]]


def test_rooms_hold_every_link(spark):
    """Two sets that meet the limit are in one room, whatever else is there; pages of one form are in none."""
    rng = np.random.default_rng(8)
    pool = rng.integers(0, 2**63, 400, np.uint64)
    sets = [rng.choice(pool[: rng.integers(40, 400)], rng.integers(1, 40), replace=False) for _ in range(150)]
    for base in sets[:60]:
        sets.append(np.concatenate([base[rng.random(len(base)) < 0.95], rng.integers(0, 2**63, 1, np.uint64)]))
    sets = [np.unique(s) for s in sets]
    rows = spark.createDataFrame([(i, i % 170, s.tobytes()) for i, s in enumerate(sets)], "cid long, root long, set binary").repartition(5)
    for percent in (50, 80, 85, 100):
        room = {r.node: r.root for r in minhash.rooms_of(rows, percent).collect()}
        for i in range(len(sets)):
            for j in range(i):
                both = len(np.intersect1d(sets[i], sets[j]))
                if i % 170 != j % 170 and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                    assert room[i] == room[j]
    form = rng.integers(0, 2**63, 80, np.uint64)
    pages = [np.unique(np.concatenate([form, rng.integers(0, 2**63, 20, np.uint64)])) for _ in range(500)]
    rows = spark.createDataFrame([(i, i, s.tobytes()) for i, s in enumerate(pages)], "cid long, root long, set binary")
    assert minhash.rooms_of(rows, 80).isEmpty()
    assert minhash.rooms_of(rows.limit(0), 80).isEmpty()


@pytest.mark.parametrize("block, pivots", [(256, 3), (16, 0)])
def test_pages_of_one_form(spark, block, pivots):
    """The form does not link pages, their own words do; SetSketch buckets hold most pages at once."""
    docs = template_pages(600)
    got = minhash.near_duplicate_rows(spark.createDataFrame(docs, "doc_id long, text string"), 3, 85, block=block, pivots=pivots).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(docs, 3, 85)
    assert sum(r.component_id != r.doc_id for r in got) == 20


def test_registers_estimate_similarity():
    rng = np.random.default_rng(4)
    pool = rng.integers(0, 2**63, 3000, np.uint64)
    sets = [np.unique(pool[:2000]), np.unique(pool[200:2200]), np.unique(pool[1000:3000])]
    regs = minhash.sketch_all(sets, minhash.Sketch(bands=100, rows=6))
    n = np.array([float(len(s)) for s in sets])
    est = minhash.joint_similarity(regs[[0, 0]], regs[[1, 2]], n[[0, 0]], n[[1, 2]], minhash.Sketch(bands=100, rows=6))
    assert abs(est[0] - 1800 / 2200) < 0.08 and abs(est[1] - 1000 / 3000) < 0.08
    both = minhash.sketch_all([np.unique(np.concatenate(sets[:2]))], minhash.Sketch(bands=100, rows=6))
    assert (both[0] == np.maximum(regs[0], regs[1])).all()


def test_no_documents(no_docs):
    assert minhash.minhash_near_dedup(no_docs).count() == 0
    assert remove_repeats(no_docs).count() == 0


def brute_repeats(texts, length=400):
    data = [(t or "").encode() for t in texts]
    seen = Counter(b[p : p + length] for b in data for p in range(len(b) - length + 1))
    out = []
    for b in data:
        cover = np.zeros(len(b) + 1, int)
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                cover[p] += 1
                cover[p + length] -= 1
        c = np.cumsum(cover)[:-1] > 0
        kept = bytes(np.frombuffer(b, np.uint8)[~c]) if b else b""
        out.append((len(b), int(c.sum()), int((np.diff(np.append(0, c.astype(int))) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def planted(seed=6):
    rng = random.Random(seed)
    docs = [d[1] for d in make_docs(40, seed)]
    passage = " ".join(docs[:6])
    cuts = [passage[i : i + n] for i, n in ((0, 400), (0, 399), (1, 400), (50, 700), (130, 450), (300, 401), (0, len(passage)))]
    docs += [docs[rng.randrange(30)] + " " + c + " " + docs[rng.randrange(30)] for c in cuts for _ in range(2)]
    return docs + [passage[:500] + "é" + passage[:500], "z" * 1500, "ab" * 900, "q" * 399, "q" * 400, passage, passage, None, "", docs[3], docs[3]]


def test_repeated_strings(spark):
    docs = planted()
    df = spark.createDataFrame([(i, t) for i, t in enumerate(docs)], "doc_id long, text string").withColumns({c: F.lit("x") for c in ("rid", "copies", "start")})
    got = remove_repeats(df).orderBy("doc_id").collect()
    assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got] == brute_repeats(docs)
    assert [hashlib.sha256(r.kept_bytes).hexdigest() for r in got] == [r.kept_sha256 for r in got]


def test_equal_windows_choose_equal_positions():
    rng = np.random.default_rng(1)
    data = rng.integers(97, 101, 3000).astype(np.uint8)
    name, at, first, last = sampled_positions(np.concatenate([data, data[500:1500]]), 400, 32)
    chosen = {p: a - p for a, f, z in zip(at, first, last) for p in range(f, z + 1)}
    assert sorted(chosen) == list(range(4000 - 400 + 1))
    assert all(chosen[500 + i] == chosen[3000 + i] for i in range(601)) and all(0 <= v <= 368 for v in chosen.values())


def test_runs_merge():
    assert merged(np.array([5, 0, 10, 30]), np.array([12, 5, 11, 31])) == [(0, 12), (30, 31)]


def test_pipeline(spark, tmp_path):
    docs = near_copies() + ODD + [(900 + i, planted()[40 + i], "en", "s", 0) for i in range(14)]
    df = spark.createDataFrame(docs, SCHEMA)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    labels = df.where("doc_id is not null").select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic")).distinct()
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    kept = corpus_pipeline.identify_language(spark, df, str(tmp_path))
    assert kept.columns == corpus_pipeline.COLUMNS
    assert df.count() - kept.count() == sum(1 for d in docs if not d[1] or not any(map(str.isalpha, d[1])))
    assert corpus_pipeline.reject_toxic(spark, kept, str(tmp_path)).count() == kept.count()
    one = corpus_pipeline.drop_near_duplicates(spark, kept, str(tmp_path))
    left = [tuple(r) for r in kept.collect()]
    assert one.count() == len({c for _, _, c in brute_components(left, 5, 80)})
    text = corpus_pipeline.remove_repeated_strings(spark, one, str(tmp_path))
    rows = one.collect()
    want = Counter(n - k for n, k, _, _ in brute_repeats([r.text for r in rows]))
    assert Counter(len(r.text.encode()) for r in text.collect()) == want or abs(sum(want.elements()) - sum(len(r.text.encode()) for r in text.collect())) < 8
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert {r.doc_id for r in out.collect()} == {r.doc_id for r in rows}
