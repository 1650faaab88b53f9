"""Approximate nearest neighbours by low-dimensional stable projections and kd-trees (the SRS scheme).

Unit vectors are projected by M Gaussian directions. For a vector at distance d, the squared projected distance
is d**2 times a chi-square variable with M degrees of freedom. A query meets projected neighbours in growing
order of projected distance, leaf by leaf of a kd-tree, verifies them on the original vectors, and stops when
    P(chi2_M <= r**2 / d_k**2) >= CONFIDENCE,
r being the next leaf's projected distance and d_k the k-th true distance so far: a nearer vector is then still
unseen with probability 1 - CONFIDENCE at most.

Scale: vectors of one direction are first merged to their k + 1 smallest ids, so a hot vector and all its multiples are
one point: vectors divided by their largest component are equal exactly where one is a multiple of the other. The upper levels
of the kd-tree are fitted on a bounded sample (SAMPLE vectors) and cut the space into cells of about CELL points;
every vector is put in its cell, and each cell builds its own tree. Queries visit their home cell first, then
just the cells whose box fails the same stopping test. A cell with over VISITORS of them serves them in parts, each in a
task of its own, and a part is searched TOGETHER queries and SLOTS leaves at a time, so a task's memory doesn't grow with the queries.

Null vectors or ids, vectors with null or non-finite components and zero vectors take no part. Vectors are only
compared with vectors of the same length. Results: (query_id, rank, vec_id, score), ordered by the score as computed in
double precision, of the id's own vector; equal scores go by the smaller id. Of vectors of one direction, whose cosines
differ by rounding at most, the k + 1 smallest ids are candidates. An id with several vectors is several candidates and,
if it is asked for, has a result list for each; equal rows are one. Other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftlink.llm.scratch import Scratch
from weftlink.llm.sessions import released, released_pair

M = 8
CONFIDENCE = 0.98
LEAF = 64
CELL = 16_384
SAMPLE = 20_000
SPARE = 8
BUCKET_ROWS = 20_000
VISITORS = 50_000
TOGETHER = 4096
SLOTS = 8


def chi2_cdf(x: np.ndarray, m: int = M) -> np.ndarray:
    """For even m."""
    half = np.minimum(np.asarray(x, np.float64) / 2, 700)
    return 1 - np.exp(-half) * sum(half**i / math.factorial(i) for i in range(m // 2))


def directions(dim: int) -> np.ndarray:
    return np.random.default_rng(77).standard_normal((dim, M))


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1, keepdims=True))


class Tree:
    """A kd-tree over projected points: leaves are runs of `order`, each with its box."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.order = np.arange(len(points))
        bounds, todo = [], [(0, len(points))]
        while todo:
            a, b = todo.pop()
            if b - a <= leaf:
                bounds.append((a, b))
                continue
            own = points[self.order[a:b]]
            axis, mid = int(np.argmax(own.max(0) - own.min(0))), (b - a) // 2
            self.order[a:b] = self.order[a:b][np.argpartition(own[:, axis], mid)]
            todo += [(a, a + mid), (a + mid, b)]
        self.bounds = np.array(sorted(bounds)).reshape(-1, 2)
        p = points[self.order]
        self.low = np.array([p[a:b].min(0) for a, b in self.bounds])
        self.high = np.array([p[a:b].max(0) for a, b in self.bounds])


def box_distance2(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distances of points to boxes, one row for each point."""
    out = np.zeros((len(q), len(low)))
    for j in range(q.shape[1]):
        x = q[:, j : j + 1]
        d = np.maximum(0, np.maximum(low[:, j] - x, x - high[:, j]))
        out += d * d
    return out


def _smallest(key: np.ndarray, then: np.ndarray, k: int) -> np.ndarray:
    """Places of the k smallest (key, then) of every row."""
    if key.shape[1] <= k:
        return np.argsort(key, axis=1)
    edge = np.partition(key, k - 1, axis=1)[:, k - 1 : k]
    # what is over the edge goes; of what is on it the smallest `then` stay
    on = key == edge
    order = np.where(key < edge, -2, np.where(on, then, np.iinfo(np.int64).max))
    return np.argpartition(order, k - 1, axis=1)[:, :k]


def search(tree: Tree, points: np.ndarray, queries: np.ndarray, projected: np.ndarray, k: int, bound: np.ndarray | None = None, confidence: float = CONFIDENCE) -> tuple[np.ndarray, np.ndarray]:
    """(places, cosines) of up to k points for each query, -1 where none; bound: a squared distance known beforehand."""
    n = len(queries)
    best, sim = np.full((n, k), -1), np.full((n, k), -np.inf)
    near2 = box_distance2(projected, tree.low, tree.high)
    turn = np.argsort(near2, axis=1)
    live, at, step = np.arange(n), 0, 2
    while len(live) and at < len(tree.bounds):
        take = turn[live, at : at + step]
        for slot in range(0, take.shape[1], SLOTS):
            some = take[:, slot : slot + SLOTS]
            width = LEAF * some.shape[1]
            cand, cos = np.full((len(live), width), -1), np.full((len(live), width), -np.inf)
            for s in range(some.shape[1]):
                by = np.argsort(some[:, s], kind="stable")
                cut = np.flatnonzero(np.diff(some[by, s])) + 1
                for rows in np.split(by, cut):
                    a, b = tree.bounds[some[rows[0], s]]
                    own = tree.order[a:b]
                    cand[rows, s * LEAF : s * LEAF + b - a] = own
                    cos[rows, s * LEAF : s * LEAF + b - a] = queries[live[rows]] @ points[own].T
            cand, cos = np.concatenate([best[live], cand], 1), np.concatenate([sim[live], cos], 1)
            # ties go to the earlier point
            key = np.where(cand >= 0, -cos, np.inf)
            top = _smallest(key, cand, k)
            best[live], sim[live] = np.take_along_axis(cand, top, 1), np.take_along_axis(cos, top, 1)
        at += take.shape[1]
        step = min(64, step * 2)
        if at >= len(tree.bounds):
            break
        d2 = np.maximum(2 - 2 * sim[live].min(1), 1e-12)
        if bound is not None:
            d2 = np.minimum(d2, np.maximum(bound[live], 1e-12))
        r2 = near2[live, turn[live, at]]
        live = live[chi2_cdf(np.where(np.isfinite(d2), r2 / d2, 0)) < confidence]
    return best, sim


_VEC = "dim int, vec binary, ids array<long>, more array<binary>"
_DIRECTION = "dim int, way binary, vec binary, ids array<long>, more array<binary>"


def _merge(keep: int):
    def run(table: pa.Table) -> pa.Table:
        held: dict[tuple, list] = {}
        for d, w, v, ids, more in zip(*(table.column(c).to_pylist() for c in ("dim", "way", "vec", "ids", "more")), strict=True):
            _put(held, (d, w), zip(ids, [v, *more], strict=True), keep)
        return _table(held)

    return run


def _put(held: dict, key: tuple, vectors, keep: int) -> None:
    """A direction keeps its smallest ids, each with its own vector."""
    held[key] = sorted({*held.get(key, ()), *vectors})[:keep]


def _table(held: dict) -> pa.Table:
    cols = [[d for d, _ in held], [w for _, w in held], [x[0][1] for x in held.values()], [[i for i, _ in x] for x in held.values()], [[v for _, v in x[1:]] for x in held.values()]]
    kinds = (pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.binary()))
    return pa.table([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["dim", "way", "vec", "ids", "more"])


def _valid(batch: pa.RecordBatch):
    """(id, vector as doubles) of the rows that take part."""
    ids, lists = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
    flat = lists.flatten().cast(pa.float64())
    values, there = flat.fill_null(np.nan).to_numpy(zero_copy_only=False), lists.is_valid().to_numpy(zero_copy_only=False)
    size = np.array(lists.value_lengths().fill_null(0))
    at = np.concatenate([[0], np.cumsum(size)])
    for i in range(len(ids)):
        v = values[at[i] : at[i + 1]]
        if there[i] and size[i] and np.isfinite(v).all() and v.any() and np.isfinite((v * v).sum()) and (v * v).sum() > 0:
            yield int(ids[i]), v


def _directions_of(keep: int):
    """Vectors as packed doubles, those of one direction merged within the task in runs."""

    def run(batches):
        held: dict[tuple, tuple] = {}
        for batch in batches:
            for i, v in _valid(batch):
                way = (v / np.abs(v).max() + 0.0).tobytes()
                _put(held, (len(v), way), [(i, v.tobytes())], keep)
                if len(held) >= 10_000:
                    yield from _table(held).to_batches()
                    held = {}
        yield from _table(held).to_batches()

    return run


def _asked(batches):
    for batch in batches:
        got = [(len(v), v.tobytes(), i) for i, v in _valid(batch)]
        yield pa.RecordBatch.from_arrays([pa.array([g[j] for g in got], t) for j, t in enumerate((pa.int32(), pa.binary(), pa.int64()))], ["dim", "vec", "q"])


def _matrix(col) -> np.ndarray:
    return np.stack([np.frombuffer(v.as_py(), np.float64) for v in col])


def _cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of the rows of x with y; sums go term by term in order, as SQL has them."""
    norms = np.cumsum(x * x, 1)[:, -1] * np.cumsum(y * y)[-1]
    return np.clip(np.cumsum(x * y, 1)[:, -1] / np.sqrt(norms), -1.0, 1.0)


class Cells:
    """The upper kd-tree of each vector length: splits from a sample."""

    def __init__(self, sample: list, counts: dict[int, int], cell: int):
        self.trees = {}
        for dim, n in counts.items():
            x = [np.frombuffer(r["vec"], np.float64) for r in sample if r["dim"] == dim]
            depth = max(0, math.ceil(math.log2(max(1, n / cell))))
            p = unit(np.stack(x)) @ directions(dim) if x else np.zeros((0, M))
            self.trees[dim] = self._split(p, depth)

    def _split(self, p: np.ndarray, depth: int):
        if depth == 0 or len(p) < 2:
            return None
        axis = int(np.argmax(p.max(0) - p.min(0)))
        at = float(np.median(p[:, axis]))
        return axis, at, self._split(p[p[:, axis] < at], depth - 1), self._split(p[p[:, axis] >= at], depth - 1)

    def cell(self, dim: int, p: np.ndarray) -> np.ndarray:
        out = np.ones(len(p), np.int64)

        def walk(node, rows, name):
            if node is None:
                out[rows] = name
                return
            axis, at, left, right = node
            less = p[rows, axis] < at
            walk(left, rows[less], 2 * name)
            walk(right, rows[~less], 2 * name + 1)

        walk(self.trees[dim], np.arange(len(p)), 1)
        return out


def nearest(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 5, query_modulus: int = 50, cell: int = CELL, confidence: float = CONFIDENCE) -> DataFrame:
    """Queries are the rows whose id is divisible by query_modulus; candidates are all other rows."""
    spark = vectors.sparkSession
    scratch, keep = Scratch(spark, "projected-knn"), k + 1
    plain = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v")).where("id is not null and v is not null")
    # copies are merged in each task first, so a bucket grows with the directions in it, of which it gets BUCKET_ROWS or so
    buckets = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), plain.count() // BUCKET_ROWS)
    dealt = plain.mapInArrow(released(_directions_of(keep)), _DIRECTION).withColumn("bucket", F.pmod(F.xxhash64("way"), F.lit(buckets)))
    points = scratch.save(dealt.groupBy("bucket").applyInArrow(_merge(keep), _DIRECTION), "points").select("dim", "vec", "ids", "more")
    counts = {r["dim"]: r["count"] for r in points.groupBy("dim").count().collect()}
    sample = points.select("dim", "vec").orderBy(F.xxhash64("vec"), "vec").limit(SAMPLE).collect() if any(n > cell for n in counts.values()) else []
    cells = spark.sparkContext.broadcast(Cells(sample, counts, cell))

    def place(batches):
        for batch in batches:
            dims = batch.column(0).to_numpy()
            for dim in np.unique(dims).tolist():
                rows = np.flatnonzero(dims == dim)
                part = batch.take(pa.array(rows))
                p = unit(_matrix(part.column(1))) @ directions(dim)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cells.value.cell(dim, p)), pa.array(list(p), pa.list_(pa.float64()))], ["dim", "vec", "ids", "more", "cell", "p"])

    placed = points.mapInArrow(place, _VEC + ", cell long, p array<double>")
    boxed = placed.groupBy("dim", "cell").agg(*[F.min(F.col("p")[j]).alias(f"l{j}") for j in range(M)], *[F.max(F.col("p")[j]).alias(f"h{j}") for j in range(M)]).collect()
    boxes = spark.sparkContext.broadcast([(r["dim"], r["cell"], [r[f"l{j}"] for j in range(M)], [r[f"h{j}"] for j in range(M)]) for r in boxed])
    queries = plain.where(F.col("id") % query_modulus == 0).mapInArrow(_asked, "dim int, vec binary, q long").distinct()
    vecs = queries.select("dim", "vec").distinct().withColumns({"ids": F.array().cast("array<long>"), "more": F.array().cast("array<binary>")})
    home = vecs.mapInArrow(place, _VEC + ", cell long, p array<double>").withColumn("bound", F.lit(None).cast("double"))

    found_schema = "dim int, vec binary, near array<struct<score: double, id: long>>, bound double"

    kind = pa.list_(pa.struct([("score", pa.float64()), ("id", pa.int64())]))

    def probe(left: pa.Table, right: pa.Table) -> pa.Table:
        """Points of a cell, queries that visit it."""
        if not left.num_rows or not right.num_rows:
            near, bound = pa.array([[]] * right.num_rows, kind), np.full(right.num_rows, math.inf)
        else:
            left = left.take(pa.array(np.argsort([i[0] for i in left.column("ids").to_pylist()], kind="stable")))
            x = _matrix(left.column("vec"))
            a, ways = unit(x), directions(x.shape[1])
            p = a @ ways
            tree, ids, more = Tree(p), left.column("ids").to_pylist(), left.column("more").to_pylist()
            near, bound = [], []
            for at in range(0, right.num_rows, TOGETHER):
                part = right.slice(at, TOGETHER)
                y = _matrix(part.column("vec"))
                b = unit(y)
                given = part.column("bound").combine_chunks().fill_null(math.inf).to_numpy(zero_copy_only=False)
                # some more than asked for: the products above may differ from the scores in the last place
                best, _ = search(tree, a, b, b @ ways, keep + SPARE, given, confidence)
                lists = []
                for i in range(len(y)):
                    found = best[i][best[i] >= 0].tolist()
                    own = [x[found], *(np.frombuffer(v, np.float64)[None] for j in found for v in more[j])]
                    own = sorted(zip((-_cosines(np.concatenate(own), y[i])).tolist(), [ids[j][0] for j in found] + [v for j in found for v in ids[j][1:]], strict=True))[:keep]
                    lists.append([{"score": -s, "id": v} for s, v in own])
                    bound.append(2 + 2 * own[-1][0] if len(own) == keep else math.inf)
                near.append(pa.array(lists, kind))
            near = pa.chunked_array(near)
        return pa.table({"dim": right.column("dim"), "vec": right.column("vec"), "near": near, "bound": pa.array(bound, pa.float64())})

    def visit(asking: DataFrame) -> DataFrame:
        asking, points = asking.select("dim", "vec", "cell", "bound"), placed.select("dim", "vec", "ids", "more", "cell")
        busy = asking.groupBy("dim", "cell").count().where(F.col("count") > VISITORS).select("dim", "cell", F.ceil(F.col("count") / VISITORS).cast("int").alias("parts")).collect()  # cells at most
        if busy:
            parts = F.broadcast(spark.createDataFrame(busy, "dim int, cell long, parts int"))
            asking, points = (side.join(parts, ["dim", "cell"], "left").withColumn("parts", F.coalesce("parts", F.lit(1))) for side in (asking, points))
            asking = asking.withColumn("part", F.pmod(F.xxhash64("vec"), F.col("parts")).cast("int"))
            points = points.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        else:
            asking, points = (side.withColumn("part", F.lit(0)) for side in (asking, points))
        asking, points = asking.select("dim", "vec", "bound", "cell", "part"), points.select("dim", "vec", "ids", "more", "cell", "part")
        return points.groupBy("dim", "cell", "part").cogroup(asking.groupBy("dim", "cell", "part")).applyInArrow(released_pair(probe), found_schema)

    first = scratch.save(visit(home), "first")

    def others(batches):
        """The cells that a query must still visit."""
        for whole in batches:
            for at in range(0, len(whole), 512):
                batch = whole.slice(at, 512)
                dims, bound = batch.column(0).to_numpy(), batch.column(3).fill_null(math.inf).to_numpy(zero_copy_only=False)
                for dim in np.unique(dims).tolist():
                    rows = np.flatnonzero(dims == dim)
                    own = [b for b in boxes.value if b[0] == dim]
                    p = unit(_matrix(batch.column(1).take(pa.array(rows)))) @ directions(dim)
                    r2 = box_distance2(p, np.array([b[2] for b in own]), np.array([b[3] for b in own]))
                    names = np.array([b[1] for b in own])
                    d2 = np.maximum(bound[rows], 1e-12)[:, None]
                    go = (cells.value.cell(dim, p)[:, None] != names) & (chi2_cdf(np.where(np.isfinite(d2), r2 / d2, 0)) < confidence)
                    i, j = np.nonzero(go)
                    for k in range(0, len(i), 8192):
                        some = slice(k, k + 8192)
                        which = rows[i[some]]
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(which), dim), pa.int32()), batch.column(1).take(pa.array(which)), pa.array(names[j[some]], pa.int64()), pa.array(bound[which], pa.float64())], ["dim", "vec", "cell", "bound"])

    found = first
    if len(boxed) > 1:
        found = first.unionByName(visit(first.mapInArrow(released(others), "dim int, vec binary, cell long, bound double")))
    best = F.slice(F.array_sort(F.transform(F.flatten(F.collect_list("near")), lambda x: F.struct((-x["score"]).alias("s"), x["id"].alias("id"), x["score"].alias("score")))), 1, keep)
    merged = found.groupBy("dim", "vec").agg(best.alias("near"))  # at most k + 1 entries from each visited cell
    each = queries.join(merged, ["dim", "vec"]).select("q", "vec", F.slice(F.filter("near", lambda x: x["id"] != F.col("q")), 1, k).alias("near"))
    return each.select(F.col("q").alias("query_id"), F.posexplode("near").alias("place", "x")).select("query_id", (F.col("place") + 1).cast("int").alias("rank"), F.col("x.id").alias("vec_id"), F.col("x.score").alias("score"))
