"""Recall of the graphs against brute force, and rows that take no part."""

from __future__ import annotations

import numpy as np
import pytest
from conftest import SMALL

from intake.llm import graph
from intake.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>"


def nearest(spark, rows, k=20, step=20):
    vectors = graph.vectors_of(spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'a' AS dim", "1 AS shard", "2 AS ids", "3 AS rank", "4 AS block"))
    found = graph.search(graph.index(vectors, k), vectors.where(f"vec_id % {step} = 0"), k).collect()
    out: dict = {}
    for r in sorted(found, key=lambda r: (r.query_id, r["rank"])):
        assert r["rank"] == len(out.setdefault(r.query_id, [])) + 1
        out[r.query_id].append((r.vec_id, r.score))
    return out


def brute(rows, k=20, step=20):
    rows = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    best: dict = {}
    for i, q in rows:
        if i % step == 0:
            for j, v in rows:
                if j != i and len(v) == len(q):
                    mine = best.setdefault(i, {})
                    mine[j] = max(mine.get(j, -np.inf), float(np.dot(q, v)))
    return {i: sorted(mine.items(), key=lambda x: (-x[1], x[0]))[:k] for i, mine in best.items()}


def same(a, b):
    assert {k: [x[0] for x in v] for k, v in a.items()} == {k: [x[0] for x in v] for k, v in b.items() if v}
    for k in a:
        assert np.allclose([x[1] for x in a[k]], [x[1] for x in b[k]], rtol=1e-12)


def test_recall_over_the_table(spark):
    table = spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()
    rows = [(r.vec_id, r.embedding) for r in table]
    true, found = brute(rows), {}
    for r in QUERIES["op12_graph"](spark, SMALL).collect():
        found.setdefault(r.query_id, []).append(r.vec_id)
    assert set(found) == set(true) and all(len(v) == 20 for v in found.values())
    assert sum(len({j for j, _ in true[q]} & set(v)) for q, v in found.items()) >= 0.9 * 20 * len(true)


@pytest.mark.parametrize("spread", [1.0, 50.0])
def test_recall_of_one_graph(spread):
    """A shard far larger than the beam, vectors of unlike length among them."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(6000, 24)) * rng.uniform(1, spread, (6000, 1))
    edges, entries = graph.build_graph(x)
    assert (edges < 6000).sum(axis=1).max() <= graph.DEGREE
    long = graph._lengthened(x)
    norms = np.append((long[:-1] ** 2).sum(axis=1), np.inf).astype(np.float32)
    q = x[:200] / np.linalg.norm(x[:200], axis=1, keepdims=True)
    found, _ = graph._search(long, norms, np.concatenate([edges, np.full((1, graph.DEGREE), 6000, np.int32)]), entries, np.concatenate([q, np.zeros((200, 1))], axis=1).astype(np.float32), graph.BEAM)
    true = np.argsort(-(q @ x.T), axis=1)[:, :20]
    assert np.mean([len(set(a) & set(b)) / 20 for a, b in zip(found.tolist(), true.tolist())]) >= 0.9


def test_few_vectors_are_found_whole(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 4)]) for i in range(90)]  # many ties and equal vectors
    same(nearest(spark, rows), brute(rows))


def test_rows_without_part_repeats_and_dimensions(spark):
    bad = [(None, [1.0, 0.0]), (0, None), (20, []), (40, [0.0, 0.0]), (60, [1.0, None]), (80, [float("nan"), 1.0]), (100, [float("inf"), 1.0])]
    good = [(120, [1.0, 2.0]), (120, [1.0, 2.0]), (120, [-1.0, 0.5]), (140, [3.0, 1.0]), (1, [2.0, 2.0]), (2, [2.0, 2.0]), (3, [-4.0, 1.0]), (160, [1.0, 1.0, 1.0]), (4, [0.5, 1.0, 2.0]), (180, [1.0])]
    same(nearest(spark, bad + good), brute(bad + good))
    assert nearest(spark, []) == {} and nearest(spark, bad) == {}


def test_one_vector_in_a_third_of_all_rows(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [1.0, 1.0, 0.0] if i % 3 == 0 else [float(x) for x in rng.normal(size=3)]) for i in range(600)]
    same(nearest(spark, rows, step=100), brute(rows, step=100))
