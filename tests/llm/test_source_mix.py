from __future__ import annotations

import hashlib
import random
import re
from collections import Counter
from fractions import Fraction

import pytest
from pyspark.sql import types as T
from weftlink.llm.scratch import Scratch
from weftlink.llm.source_mix import mix_sources, mixed_texts, prefix_sums

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("source", T.StringType()), T.StructField("_key", T.StringType()), T.StructField("size", T.StringType())])


@pytest.fixture(autouse=True)
def many_ranges(spark):
    """Small tables are not put together into one range."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def targets(sizes, weights, most):
    """Shares by weight; what lies above a source's most is shared again, round by round, in exact numbers."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    left, free, out = Fraction(sum(sizes.values())), set(names), {}
    while free:
        unit = left / sum(weight[s] for s in free)
        above = {s for s in free if unit * weight[s] > most * sizes[s]}
        if not above:
            return out | {s: unit * weight[s] for s in free}
        for s in above:
            out[s] = Fraction(most * sizes[s])
            left -= out[s]
        free -= above
    return out


def brute(rows, weights=(5, 2, 1), most=3):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    key = lambda d, t: hashlib.md5(":".join([str(x) for x in (d, t) if x is not None]).encode()).hexdigest()
    totals = Counter()
    for _, t, s in rows:
        totals[s] += size(t)
    goal, out, before = targets(totals, weights, most), [], Counter()
    for d, t, s in sorted(rows, key=lambda r: (key(r[0], r[1]), r[0] or 0, size(r[1]))):
        n, total = size(t), totals[s]
        budget = min(most * total, int(goal[s] + Fraction(1, 2)))
        epochs = budget // total if total else 0
        cut = min(n, max(0, budget - epochs * total - before[s]))
        before[s] += n
        out.append((d, n, total, float(goal[s]), epochs * n + cut))
    return out


def table(seed, n, sources):
    rng = random.Random(seed)
    rows = [(rng.choice([None, rng.randint(0, n), k]), rng.choice([None, "", " \t", "a", "é 漢\x0bb", " ".join(["w"] * rng.randint(1, 60))]), rng.choice(sources)) for k in range(n)]
    return rows + [(7, "same words here again", sources[0])] * (n // 3)


@pytest.mark.parametrize("seed, sources, weights, most", [(1, ["b", "a", None, "c", "é", "Z"], (5, 2, 1), 3), (2, ["x"], (5, 2, 1), 3), (3, [None], (1,), 1), (4, [f"s{k}" for k in range(40)], (5, 2, 1), 3), (5, ["big", *[f"s{k}" for k in range(9)]], (1, 90, 3), 2)])
def test_against_brute_force(spark, seed, sources, weights, most):
    rows = table(seed, 300, sources)
    results = []
    for parts in (1, 6):
        random.Random(parts).shuffle(rows)
        docs = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).repartition(parts)
        got = mix_sources(docs, weights=weights, most=most).select("doc_id", "size", "source_size", "target", "taken").collect()
        results.append(sorted(map(tuple, got), key=str))
    assert results[0] == results[1]
    want = sorted(brute(rows, weights, most), key=str)
    assert [r[:3] + r[4:] for r in results[0]] == [r[:3] + r[4:] for r in want]
    assert [r[3] for r in results[0]] == pytest.approx([r[3] for r in want], rel=1e-12)
    assert all(r[4] <= most * r[1] for r in results[0])


def test_mixed_texts_hold_what_was_taken(spark):
    rows = table(9, 200, ["a", "b", None, "d"])
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    taken, held = Counter(), Counter()
    for r in mix_sources(docs).collect():
        taken[r["source"]] += r["taken"]
    for r in mixed_texts(docs).collect():
        held[r["source"]] += r["times"] * len(r["text"].split())
    assert held == taken and sum(taken.values()) > 0


def test_no_words_and_empty_table(spark):
    docs = spark.createDataFrame([(1, None, "a", "", ""), (2, "", None, "", ""), (2, "", None, "", "")], SCHEMA)
    assert {tuple(r)[2:] for r in mix_sources(docs).collect()} == {(0, 0, 0.0, 0, 0, 0)}
    assert mix_sources(docs.limit(0)).collect() == [] and mixed_texts(docs.limit(0)).collect() == []


def test_prefix_sums_cut_a_hot_value(spark):
    df = spark.range(40_000).selectExpr("if(id % 3 = 0, 'hot', concat('k', id % 50)) AS g", "xxhash64(id) AS o", "id % 7 AS a")
    got = prefix_sums(df, "g", ["o"], ["a"], scratch := Scratch(spark, "t"), "p").toPandas().sort_values(["g", "o"])
    assert (got.groupby("g")["a"].cumsum() - got["a"] == got["a_before"]).all()
    parts = spark.read.parquet(f"{scratch.root}/p").groupBy("_part").count().toPandas()["count"]
    assert parts.max() < 40_000 / 4
