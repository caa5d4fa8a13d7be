"""Top-k search, embedding near-duplicates and components against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import common, embed_dedup
from graphloom.llm.common import connected_components
from graphloom.llm.embed_dedup import embedding_near_dedup
from graphloom.llm.topk import exact_top_k

SCHEMA = "vec_id long, embedding array<float>, label int, v string, cell long, shard long, key string"
EXTRA = (0, "x", 1, 2, "k")


def vectors(spark, seed=3, n=150):
    rng = np.random.default_rng(seed)
    m = rng.normal(0, 1, (n, 8)).astype(np.float32)
    m[20:40] = m[0]
    m[40:60] = m[1] + rng.normal(0, 0.25, (20, 8))
    rows = [(i, m[i].tolist(), *EXTRA) for i in range(n)]
    rows += [(500, None, *EXTRA), (501, [], *EXTRA), (502, [0.0] * 8, *EXTRA), (503, [float("nan")] + [1.0] * 7, *EXTRA), (550, [None] + [1.0] * 7, *EXTRA), (504, [float("inf")] * 8, *EXTRA), (505, [1.0] * 3, *EXTRA), (None, m[0].tolist(), *EXTRA)]
    return spark.createDataFrame(rows, SCHEMA), rows


def ok(v):
    return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v)


def test_top_k(spark):
    df, rows = vectors(spark)
    good = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v, *_ in rows if i is not None and ok(v)]
    want = []
    for i, v in good:
        if i % 10 == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in good if j != i and len(w) == len(v))
            want += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scores[:5])]
    got = exact_top_k(df, F.col("vec_id") % 10 == 0, tile=4, shard=16, fan_in=2)
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_top_k_of_few_or_none(spark):
    df, _ = vectors(spark)
    assert exact_top_k(df.where("vec_id < 3"), F.col("vec_id") == 0).count() == 2
    assert exact_top_k(df.where("vec_id < 0"), F.col("vec_id") == 0).count() == 0
    assert exact_top_k(df, F.lit(False)).count() == 0


def brute_links(rows, threshold):
    good = [(i, np.array(v, np.float64)) for i, v, *_ in rows if i is not None and ok(v) and any(v)]
    links = {i: set() for i, *_ in rows}
    for i, a in good:
        for j, b in good:
            if i != j and len(a) == len(b) and a @ b / np.sqrt(a @ a) / np.sqrt(b @ b) >= threshold:
                links[i].add(j)
    root = {i: i for i in links}
    for _ in root:
        for i in links:
            for j in links[i]:
                root[i] = root[j] = min(root[i], root[j])
    return links, root


def test_embedding_near_dedup(spark):
    df, rows = vectors(spark)
    links, root = brute_links(rows, 0.9)
    assert max(map(len, links.values())) > 10
    for sizes in ({}, {"cell_rows": 20, "seen_rows": 30}):
        got = embedding_near_dedup(df, **sizes).collect()
        assert len(got) == len(rows)
        assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got} == {i: (len(links[i]), root[i], i is None or root[i] == i) for i in links}


def test_no_vectors(spark):
    df, _ = vectors(spark)
    assert embedding_near_dedup(df.where("vec_id < 0")).count() == 0
    assert embedding_near_dedup(df.where("vec_id >= 500 and vec_id < 505")).where("kept and n_links = 0").count() == 5


def test_components(spark):
    rng = np.random.default_rng(0)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(1000, i) for i in range(1001, 1100)] + [(2000 + i, 2001 + i) for i in range(60)]
    root = {x: x for e in edges for x in e}
    for _ in range(70):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "u long, v long").repartition(6), "t").collect()}
    assert got == {k: v for k, v in root.items() if k in got} and set(root) - set(got) <= {a for a, b in edges if a == b}
    assert connected_components(spark.createDataFrame([], "u long, v long"), "t").count() == 0


@pytest.mark.parametrize("edges_a_task", [0, 1 << 17])
def test_components_by_shuffles_and_in_one_task(spark, monkeypatch, edges_a_task):
    # few edges took a dozen written tables before, each a job of all partitions (op6 on check_h)
    tables, write = [], common.cut
    monkeypatch.setattr(common, "EDGES", edges_a_task)
    monkeypatch.setattr(common, "cut", lambda df, name: tables.append(name) or write(df, name))
    edges = [(i, i + 1) for i in range(0, 60) if i % 20 != 19] + [(100, 101), (101, 100), (7, 7), (None, 3)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "u long, v long").repartition(5), "t").collect()}
    assert got == {i: i // 20 * 20 for i in range(60)} | {100: 100, 101: 100}
    assert not edges_a_task or len(tables) == 2


def test_rounds_bound_what_is_shuffled_and_change_nothing(spark, monkeypatch):
    df, _ = vectors(spark)
    want = sorted(map(str, embedding_near_dedup(df).collect()))
    costs = [(g, 3) for g in range(7)] + [(7, 50), (8, 1)]
    assert embed_dedup._rounds(costs, 6) == [[0, 1], [2, 3], [4, 5], [6], [7], [8]]
    assert embed_dedup._blocks([4, 0, 5, 25, 3, 8], 10) == [(0, 1), (0, 1), (0, 1), (1, 3), (4, 1), (5, 1)]
    monkeypatch.setattr(embed_dedup, "ROUND", 1)
    monkeypatch.setattr(embed_dedup, "TILE", (7, 5))
    assert sorted(map(str, embedding_near_dedup(df, cell_rows=4, seen_rows=16).collect())) == want
