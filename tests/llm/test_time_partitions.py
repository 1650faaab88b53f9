from __future__ import annotations

import hashlib
import os
import random
import zlib
from collections import Counter
from datetime import datetime, timedelta

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from weftlink.llm.time_partitions import _day, _year, clicks_layout, describe_files, layout, write_layout

SCHEMA = "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, client_id long, kind string, _row string, _hour long, part double"
EPOCH, CUT = datetime(1970, 1, 1), datetime(2024, 3, 1)


@pytest.fixture(autouse=True)
def many_ranges(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def moment(click_id, ts):
    k = None if click_id is None else zlib.crc32(str(click_id).encode()) % 128
    if ts is None or k is None:
        return ts
    if k < 16:
        return ts - timedelta(days=(k + 6) ** 3)
    if k > 111:
        day = datetime(ts.year, ts.month, ts.day)
        return day - timedelta(days=day.weekday())
    return ts


def plain_leaves(moments, most):
    """name -> moments of the leaf, straight from the rules; siblings are found by stepping through the calendar."""
    out = {}

    def visit(siblings, parents, depth):
        run = None
        for label, inside in siblings:
            if len(inside) > most and depth < 3:
                visit(parts(inside, depth, label, parents), parents + label + "/", depth + 1)
                run = None
            elif run is not None and len(run[2]) + len(inside) <= most:
                run[1], run[2] = label, run[2] + inside
            else:
                run = [label, label, list(inside)]
                runs.append((parents, run))

    def parts(inside, depth, label, parents):
        whole = parents + label
        if depth == 0:
            labels = [f"{m:02d}" for m in range(1, 13)]
            of = lambda t: f"{t.month:02d}"
        elif depth == 1:
            y, m = map(int, whole.split("/"))
            d, labels = datetime(y, m, 1), []
            while d.month == m:
                labels.append(f"{d.day:02d}")
                d += timedelta(days=1)
            of = lambda t: f"{t.day:02d}"
        else:
            labels = [f"{h:02d}" for h in range(24)]
            of = lambda t: f"{t.hour:02d}"
        return [(x, [t for t in inside if of(t) == x]) for x in labels]

    runs: list = []
    if moments:
        years = range(min(moments).year, max(moments).year + 1)
        visit([(f"{y:04d}", [t for t in moments if t.year == y]) for y in years], "", 0)
    for parents, (a, b, inside) in runs:
        if inside:
            out[f"{parents}{a}-{b}"] = inside
    return out


def planned(rows, most):
    """(leaf, part) -> rows in order."""
    dated = [r for r in rows if moment(r[0], r[1]) is not None]
    leaves, out = plain_leaves([moment(r[0], r[1]) for r in dated], most), {}
    of = {t: name for name, inside in leaves.items() for t in inside}
    groups = {}
    for r in rows:
        m = moment(r[0], r[1])
        groups.setdefault("null" if m is None else of[m], []).append(r)
    low = lambda x: (x is not None, x if x is not None else 0)
    for name, inside in groups.items():
        inside.sort(key=lambda r: (low(moment(r[0], r[1])), r[2] is not None, r[2] or EPOCH, low(r[0])))
        for k in range(0, len(inside), most):
            out[name, k // most + 1] = inside[k : k + most]
    return out


def table(seed, n):
    rng, rows = random.Random(seed), []
    while len(rows) < n:
        ts = datetime(2024, 1, 1) + timedelta(seconds=rng.choice([rng.randint(0, 120 * 86_400), rng.randint(0, 7200)]), microseconds=rng.randint(0, 999_999))
        late = ts + timedelta(seconds=rng.choice([1, 5, 400_000]))
        row = (len(rows), None if rng.random() < 0.03 else ts, None if rng.random() < 0.01 else late, rng.randint(0, 5), rng.choice(["a", None]), "x", 1, 0.5)
        rows += [row] * rng.choice([1, 1, 1, 3])
    return rows + [(None, datetime(2024, 2, 3, 4), CUT, None, None, "", None, None), (None, None, None, None, None, None, None, None)]


def test_calendar():
    for day in range(-400_000, 400_000, 97):
        d = EPOCH + timedelta(days=day)
        assert _year(day) == d.year and _day(d.year, d.month, d.day) == day


def test_leaves_of_hours():
    rng = random.Random(4)
    for n, most in ((3000, 4), (3000, 60), (500, 1), (50, 1000)):
        times = [datetime(rng.choice([1999, 2003, 2004, 2024]), rng.randint(1, 12), rng.randint(1, 28), rng.choice([0, 0, 5, 23])) for _ in range(n)]
        times += [datetime(2024, 2, 29, 7)] * (n // 5)
        counts = Counter(int((t - EPOCH).total_seconds() // 3600) for t in times)
        hours = sorted(counts)
        got = layout(np.array(hours), np.array([counts[h] for h in hours]), most)
        assert {x.name: x.rows for x in got} == {k: len(v) for k, v in plain_leaves(times, most).items()}
        assert all(a.end <= b.first for a, b in zip(got, got[1:], strict=False))
    assert layout(np.zeros(0, np.int64), np.zeros(0, np.int64), 5) == []


def plain(path):
    return path.removeprefix("file://").removeprefix("file:")


@pytest.mark.parametrize("seed, n", [(1, 2500), (2, 700)])
def test_files_against_brute_force(spark, tmp_path, seed, n):
    rows = table(seed, n)
    most, folder = 1 + len(rows) // 650, f"{tmp_path}/out"
    random.Random(seed).shuffle(rows)
    clicks = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = {(r["leaf"], r["part"]): r for r in clicks_layout(clicks, folder).collect()}
    start, final = planned([r for r in rows if r[2] is not None and r[2] < CUT], most), planned(rows, most)
    assert set(got) == set(final)
    kept = 0
    for f, inside in final.items():
        r = got[f]
        ids = ",".join("" if x[0] is None else str(x[0]) for x in inside)
        assert r["ids_sha256"] == hashlib.sha256(ids.encode()).hexdigest()
        assert r["n_rows"] == len(inside) and r["n_new"] == sum(x[2] is None or x[2] >= CUT for x in inside)
        assert r["columns"] == ",".join(clicks.columns) and r["rewritten"] == (start.get(f) != inside)
        kept += not r["rewritten"]
        held = pq.ParquetFile(plain(r["path"])).read()
        assert held.column_names == clicks.columns and held["click_id"].to_pylist() == [x[0] for x in inside]
    assert kept > 5
    files = {os.path.join(d, x) for d, _, names in os.walk(folder) for x in names if x.endswith(".parquet")}
    assert files == {plain(r["path"]) for r in got.values()}
    assert Counter(map(tuple, spark.read.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(folder).collect())) == Counter(rows)


def test_a_hot_hour_is_cut_by_ranges(spark, tmp_path):
    t = datetime(2024, 1, 1)
    rows = [(k // 3, t, t, k % 2, "same", "", 0, 0.0) for k in range(9000)] + [(7, None, t, 1, "", "", 0, 0.0)] * 50
    clicks = spark.createDataFrame(rows, SCHEMA).repartition(3)
    files = write_layout(clicks, f"{tmp_path}/out", F.col("ts"), ["arrived_at", "click_id"], 13)
    got = describe_files(spark, f"{tmp_path}/out", clicks.schema, files, "click_id", F.lit(False)).collect()
    assert Counter(r["n_rows"] for r in got) == Counter({13: 692 + 3, 4: 1, 11: 1})
    expect = {("2024/01/01/00-00", p + 1): [k // 3 for k in range(13 * p, min(9000, 13 * p + 13))] for p in range(693)}
    expect |= {("null", p + 1): [7] * min(13, 50 - 13 * p) for p in range(4)}
    assert {(r["leaf"], r["part"]): r["ids_sha256"] for r in got} == {f: hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest() for f, ids in expect.items()}
    again = write_layout(clicks, f"{tmp_path}/out", F.col("ts"), ["arrived_at", "click_id"], 13)
    assert {f: p for f, (p, _) in again.items()} == {f: p for f, (p, _) in files.items()} and not any(new for _, new in again.values())


def test_empty_table_and_clashing_names(spark, tmp_path):
    empty = spark.createDataFrame([], SCHEMA)
    assert clicks_layout(empty, f"{tmp_path}/none").collect() == []
    with pytest.raises(ValueError):
        write_layout(empty.withColumn("_leaf", F.lit(1)), f"{tmp_path}/none", F.col("ts"), [], 5)
