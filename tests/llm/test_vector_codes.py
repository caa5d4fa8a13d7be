"""Vector codes, whitening and URL filters against brute force and SQL."""

import hashlib
import math
import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import url_filter, vector_codes, whitening
from graphloom.llm.url_filter import judge_urls
from graphloom.llm.vector_codes import code_vectors
from graphloom.llm.whitening import jacobi, whiten

SCHEMA = "vec_id long, embedding array<float>, label int, x string, dim string, part long, entry string, rid string, at string"
EXTRA = ("x", "d", 3, "e", "r", "a")


def good(v):
    return v is not None and len(v) > 0 and all(c is not None and math.isfinite(c) for c in v)


def vectors(seed=5, n=120, width=16):
    rng = np.random.default_rng(seed)
    m = rng.normal(0, 0.3, (n, width)).astype(np.float32)
    m[10:60] = m[7]  # a third and more are copies
    m[60:80, :4] = m[3, :4]
    rows = [(1000 - 3 * i, m[i].tolist(), [1, 2, None][i % 3], *EXTRA) for i in range(n)]
    odd = [None, [], [float("nan")] + [1.0] * (width - 1), [None] * width, [float("-inf")] * width]
    return rows + [(2000 + i, v, 1, *EXTRA) for i, v in enumerate(odd)] + rows[:2] + [(None, m[1].tolist(), 1, *EXTRA)]


def brute_codes(rows, parts=8, entries=16, rounds=6):
    kept = [(r[0], r[2], [math.floor(4096 * float(np.float32(c))) for c in r[1]]) for r in rows if good(r[1])]
    width = len(kept[0][2]) // parts
    cut = lambda x, p: x[p * width : (p + 1) * width]
    first = {}
    for i, _, x in kept:
        if i is not None:
            first[i] = min(x, first.get(i, x))
    seeds = [first[i] for i in sorted(first)[:entries]]
    books = [[cut(x, p) for x in seeds] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, c)), i) for i, c in enumerate(book))
    for _ in range(rounds):
        for p, book in enumerate(books):
            own = {}
            for _, _, x in kept:
                own.setdefault(near(cut(x, p), book)[1], []).append(cut(x, p))
            books[p] = [[sum(c) // len(own[i]) for c in zip(*own[i])] if i in own else entry for i, entry in enumerate(book)]
    h = hashlib.sha256(",".join(str(v) for book in books for entry in book for v in entry).encode()).hexdigest()
    done = [(i, label, [near(cut(x, p), books[p]) for p in range(parts)]) for i, label, x in kept]
    total = {}
    for _, label, n in done:
        total[label] = total.get(label, 0) + sum(e for e, _ in n)
    return [(i, "".join(f"{c:02x}" for _, c in n), sum(e for e, _ in n), total[label], h) for i, label, n in done]


def key(rows):
    return sorted((tuple(r) for r in rows), key=str)


def test_codes(spark):
    rows = vectors()
    got = code_vectors(spark.createDataFrame(rows, SCHEMA).repartition(5))
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert key(got.collect()) == key(brute_codes(rows))


def test_codes_of_few_none_and_other_lengths(spark):
    rows = vectors()
    few = rows[:5]
    assert key(code_vectors(spark.createDataFrame(few, SCHEMA)).collect()) == key(brute_codes(few))
    assert code_vectors(spark.createDataFrame([], SCHEMA)).collect() == []
    short = vectors(6, 30, 8)
    mixed = spark.createDataFrame([*rows[:40], *[r for r in short if good(r[1])], (1, [1.0] * 7, 1, *EXTRA)], SCHEMA)
    one, two = brute_codes(rows[:40]), brute_codes([r for r in short if good(r[1])])
    assert sorted((r.code, r.error) for r in code_vectors(mixed).collect()) == sorted((c, e) for _, c, e, _, _ in one + two)
    huge = spark.createDataFrame([(1, [3e38] * 8, 1, *EXTRA), (2, [-3e38] * 8, 1, *EXTRA), (3, [0.0] * 8, None, *EXTRA)], SCHEMA)
    assert {(r.code, r.error) for r in code_vectors(huge).collect()} == {("00" * 8, 0), ("01" * 8, 0), ("02" * 8, 0)}


def test_jacobi():
    rng = np.random.default_rng(2)
    q, _ = np.linalg.qr(rng.normal(size=(21, 21)))
    want = 10.0 ** -np.arange(21)
    scaled = np.sqrt(want)[:, None] * (np.eye(21) + 0.1 * q @ q.T) * np.sqrt(want)
    e, v = jacobi(scaled)
    assert np.allclose(v.T @ v, np.eye(21), atol=1e-13) and np.allclose(scaled @ v, v * e, atol=1e-15)
    # small eigenvalues of a graded matrix keep their digits
    assert np.allclose(e, 1.1 * want, rtol=1e-10)
    for a in (np.zeros((3, 3)), np.array([[2.0]]), np.ones((4, 4)), np.diag([1.0, 5.0])):
        e, v = jacobi(a)
        assert np.allclose(a @ v, v * e) and np.allclose(e, np.linalg.eigvalsh(a)[::-1])


def check_whitened(rows, got, most=16):
    kept = [(r[0], [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in r[1]]) for r in rows if good(r[1])]
    fit = np.array(sorted({tuple(x) for _, x in kept}), np.int64)
    n, total = len(fit), fit.sum(axis=0)
    z = fit - total / n
    cov = z.T @ z / n
    e = np.linalg.eigvalsh(cov)[::-1]
    k = min(most, fit.shape[1])
    by = {}
    for r in got:
        by.setdefault(r.vec_id, []).append(r)
    assert len(got) == k * len(kept)
    weights = np.linalg.lstsq(z, np.array([[next(r.whitened for r in by[next(i for i, x in kept if tuple(x) == tuple(f))] if r.component == c) for c in range(1, k + 1)] for f in fit]), rcond=None)[0]
    for c in range(k):
        axis = weights[:, c] * math.sqrt(e[c])
        assert abs(axis @ axis - 1) < 1e-8 and np.allclose(cov @ axis, e[c] * axis, atol=1e-8 * e[0])
    for i, x in kept:
        exact = sum((n * v - int(s)) ** 2 for v, s in zip(x, total))
        for r in by[i]:
            assert (r.n, r.deviation) == (n, exact) and abs(r.explained - e[r.component - 1] / e.sum()) < 1e-10
            assert abs(r.whitened - (np.array(x) - total / n) @ weights[:, r.component - 1]) < 1e-8
            assert 0 <= r.identity_error < 1e-9


def test_whitening(spark):
    rows = vectors()
    got = whiten(spark.createDataFrame(rows, SCHEMA).repartition(5))
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    check_whitened(rows, got.collect())


def test_whitening_of_few_equal_and_other_lengths(spark):
    frame = lambda rows: spark.createDataFrame(rows, SCHEMA)
    rows = [r for r in vectors() if good(r[1])]
    assert whiten(frame([])).collect() == []
    assert whiten(frame(rows[10:20])).collect() == []  # copies of one vector have no axis
    two = whiten(frame([rows[0], rows[1], rows[1]])).collect()
    assert sorted((r.component, round(abs(r.whitened), 9)) for r in two) == [(1, 1.0)] * 3
    short = [(i, [float(i % 3), float(i % 5)], 1, *EXTRA) for i in range(30)]
    mixed = whiten(frame(short + rows[:50])).collect()
    check_whitened(short, [r for r in mixed if r.vec_id < 30])
    far = whiten(frame([(1, [1e20, 0.0], 1, *EXTRA), (2, [0.0, 1e38], 1, *EXTRA), (3, [5.0, 5.0], 1, *EXTRA)])).collect()
    assert all(math.isfinite(r.whitened) for r in far) and {r.deviation is None for r in far} == {True}


URLS = [
    "https://example.com/en/a", "http://www.example.com/en/b", "https://WWW.Example.COM/en/", "https://www.example.com/EN/", "https://a.b.example.com/en/x?y#z",
    "https://example.com", "https://example.com/", "https://notexample.com/en/", "https://example.com.net/es/1", "https://x.net/fr/", "https://x.net/fr", "https://x.net/de/",
    "https://x.net?/fr/", "https://x.net#/es/", "ftp://net/es/", "no scheme/en/", "://com/", "", None, "a://b://com/x", "https://example.com:80/en/", "https://u@example.com/en/",
    "https://example.com//en/", "https://example.com./en/", "https://.com/", "https://éxample.İcom.com/é", "https://com/ \n/x", "x\n://com/y", "https://" + "a." * 3000 + "com/" + "d/" * 3000, "https://" + "x" * 100_000,
]


def brute_judge(url, rules, otherwise="allow"):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        at = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, path = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:at]), rest[at:]
        path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, 0, None, otherwise))
    return host, path, best[2], best[3]


def test_urls(spark):
    rules = [*url_filter.RULES, ("b.example.com", "/en/x", "allow"), ("example.com", "/e", "block"), ("com", "/d/d/d/", "block"), ("com", "", "block"), ("", "/es/1", "block")]
    pages = spark.createDataFrame([(i % 25, u, "h", "p", 1, "r") for i, u in enumerate(URLS + URLS[:3])], "page_id long, url string, host string, path string, rid int, rule string")
    for own in (url_filter.RULES, rules):
        frame = spark.createDataFrame([*own, own[0], (None, "/", "block"), ("com", None, "block"), ("com", "/", "maybe")], "host string, path string, verdict string")
        got = judge_urls(pages, frame)
        assert got.columns == ["page_id", "host", "path", "rule", "verdict"]
        assert key(got.collect()) == key((i % 25, *brute_judge(u, own)) for i, u in enumerate(URLS + URLS[:3]))
    both = spark.createDataFrame([("com", "/", "allow"), ("com", "/", "block")], "host string, path string, verdict string")
    assert {r.verdict for r in judge_urls(pages.where("url = 'https://example.com/'"), both).collect()} == {"block"}
    assert {r.verdict for r in judge_urls(pages, both.where("host is null"), "block").collect()} == {"block"}
    assert judge_urls(pages.where("false"), both).collect() == []


DIR = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables here")
def test_queries(spark):
    con = duckdb.connect()
    for t in ("embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    for module, name in ((vector_codes, "op11_vector_codes"), (url_filter, "op13_url_filter")):
        got, want = getattr(module, name)(spark, DIR), con.execute(module.ORACLE_SQL[name])
        assert got.columns == [c[0] for c in want.description]
        assert key(got.collect()) == key(want.fetchall())
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{DIR}/embeddings.parquet").collect()]
    check_whitened(rows, whitening.op12_whitening(spark, DIR).select("*", F.lit(1)).collect())


def test_urls_are_never_sent_to_all_tasks(spark, monkeypatch):
    pages = spark.createDataFrame([(i, f"https://www.example.com/en/{i % 3}") for i in range(2000)], "page_id long, url string")
    rules = spark.createDataFrame(url_filter.RULES, "host string, path string, verdict string")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    few = judge_urls(pages, rules)
    assert "BuildLeft" not in plan(few) and "BuildRight" in plan(few)
    monkeypatch.setattr(url_filter, "RULES_SENT", 0)
    many = judge_urls(pages, rules)
    assert "BroadcastExchange" not in plan(many)
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, many.collect()))
