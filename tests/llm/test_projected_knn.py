from __future__ import annotations

import math

import numpy as np
from pyspark.sql import types as T
from weftlink.llm import projected_knn
from weftlink.llm.projected_knn import chi2_cdf, nearest

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("rank", T.StringType()), T.StructField("dim", T.StringType())])


def vectors(n=3000, dim=24):
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((40, dim))
    x = (centres[rng.integers(0, 40, n)] + 0.4 * rng.standard_normal((n, dim))).astype(np.float32)
    x[100:400] = x[100]  # a hot vector
    x[500] = 2 * x[501]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(9000, None), (9050, [0.0] * dim), (9100, [float("nan")] * dim), (9150, [None] * dim), (None, x[0].tolist()), (9200, [1.0, 2.0]), (9201, [2.0, 1.0]), (9250, []), (50, x[50].tolist())]
    return rows


def brute(rows, k=5, modulus=50):
    good = {}
    for i, v in rows:
        if i is not None and v and None not in v and all(map(math.isfinite, v)) and any(v):
            good[i] = np.array(np.float32(v), np.float64)
    out = {}
    for q, v in good.items():
        if q % modulus == 0:
            own = [(-float(np.cumsum(v * w)[-1] / np.sqrt(np.cumsum(w * w)[-1] * np.cumsum(v * v)[-1])), i) for i, w in good.items() if i != q and len(w) == len(v)]
            out[q] = [(i, -s) for s, i in sorted(own)[:k]]
    return out


def test_recall_ties_and_cells(spark):
    rows = vectors()
    df = spark.createDataFrame([(i, v, "a", "b") for i, v in rows], SCHEMA).repartition(4)
    want = brute(rows)
    for cell in (projected_knn.CELL, 500):
        got: dict = {}
        for r in nearest(df, cell=cell).orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
            assert r["rank"] == len(got[r["query_id"]])
        assert {q for q, v in want.items() if v} == set(got)
        hits = sum(len({i for i, _ in want[q]} & {i for i, _ in got[q]}) for q in got)
        assert hits >= 0.95 * sum(len(v) for v in want.values())
        assert [i for i, _ in got[150]] == [100, 101, 102, 103, 104]
        assert [i for i, _ in got[100]] == [101, 102, 103, 104, 105]
        assert got[9200] == [(9201, got[9200][0][1])] and abs(got[9200][0][1] - 0.8) < 1e-12


def test_many_ties(spark):
    base = [0.3, -1.7, 2.25, 0.0, 5.5, -0.1, 3.0, 7.0]
    rows = [(0, base)] + [(i, [np.float32(i * c).item() if i % 2 else i * c for c in map(np.float32, base)]) for i in range(1, 21)]
    ones = np.eye(8).tolist()
    rows += [(50, [0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0])] + [(30 + i, ones[i % 4]) for i in range(19)]
    df = spark.createDataFrame([(i, [float(np.float32(c)) for c in v], "a", "b") for i, v in rows], SCHEMA).repartition(3)
    exact = spark.createDataFrame([(i, [float(i or 1) * c for c in (1.5, -2.0, 0.25, 3.0)], "a", "b") for i in range(0, 21)], SCHEMA)
    assert [(r["vec_id"], round(r["score"], 12)) for r in nearest(exact).orderBy("rank").collect()] == [(i, 1.0) for i in range(1, 6)]
    got = [(r["query_id"], r["vec_id"]) for r in nearest(df).orderBy("query_id", "rank").collect()]
    assert [v for q, v in got if q == 50][1:] != [] and len([v for q, v in got if q == 50]) == 5
    lone = [r for r in rows if r[0] >= 30]
    df = spark.createDataFrame([(i, v, "a", "b") for i, v in lone], SCHEMA).repartition(3)
    assert [r["vec_id"] for r in nearest(df).orderBy("rank").collect()] == [30, 31, 32, 33, 34]


def test_order_by_scores_that_hardly_differ(spark):
    rows = [(0, [1.0, 0.0])] + [(k, [1.0, (8 - k) * 1e-7 * 1.5]) for k in range(1, 8)]  # the larger the id, the nearer
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(2)
    got = [(r["vec_id"], r["score"]) for r in nearest(df).orderBy("rank").collect()]
    assert [i for i, _ in got] == [7, 6, 5, 4, 3]
    assert all(a > b for (_, a), (_, b) in zip(got, got[1:]))


def test_vectors_of_one_direction_have_their_own_scores(spark):
    base = np.array([0.1, 0.7, -0.3, 2.3])
    rows = [(0, base.tolist())] + [(k, (base * f).tolist()) for k, f in enumerate((3.0, 7.0, 0.3, 11.0, 1.0, 5.0, 1.1), 1)]
    got = [(r["vec_id"], r["score"]) for r in nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).orderBy("rank").collect()]
    own = {i: projected_knn._cosines(np.array([v]), base)[0] for i, v in rows}
    assert len(got) == 5 and all(s == own[i] for i, s in got) and got == sorted(got, key=lambda x: (-x[1], x[0]))


def test_chi_square():
    draws = (np.random.default_rng(1).standard_normal((200_000, projected_knn.M)) ** 2).sum(1)
    for x in (2.0, 8.0, 15.0):
        assert abs(chi2_cdf(np.array(x)) - (draws <= x).mean()) < 0.01


def test_empty_table(spark):
    assert nearest(spark.createDataFrame([], SCHEMA)).collect() == []


def test_memory_of_a_search_is_bounded_by_slots_of_leaves():
    import tracemalloc

    rng = np.random.default_rng(3)
    points, queries = (projected_knn.unit(rng.standard_normal((n, 16))) for n in (6_000, 2_000))
    ways = projected_knn.directions(16)
    tree = projected_knn.Tree(points @ ways)
    tracemalloc.start()
    best, _ = projected_knn.search(tree, points, queries, queries @ ways, 3, confidence=1.1)  # never stops early
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    exact = np.argsort(-(queries @ points.T), axis=1)[:, :3]
    assert (np.sort(best, 1) == np.sort(exact, 1)).all()
    assert peak < 120e6


def test_visitors_in_parts_find_the_same(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.standard_normal((600, 12)))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    find = lambda: sorted(map(tuple, projected_knn.nearest(df, query_modulus=3, cell=100).collect()))
    whole = find()
    monkeypatch.setattr(projected_knn, "VISITORS", 7)
    monkeypatch.setattr(projected_knn, "TOGETHER", 5)
    monkeypatch.setattr(projected_knn, "SLOTS", 1)
    assert find() == whole and len(whole) == 200 * 5
