"""Time partitions that follow the data: calendar nodes split where they hold too many rows, small neighbours share a leaf.

1. Rows are counted by hour; the counts, at most one for each hour of the calendar span, go to the driver.
2. The driver splits years with more than `most` rows into months, those into days, those into hours; going through the
   siblings in order, one within `most` joins the run of the sibling before it if both fit, else starts a run. Leaves are
   the runs with rows, the hours above `most`, and one for rows without a moment.
3. The map of hours to leaves is broadcast: one short row for each hour that has rows, whatever their number.
4. A leaf above `most` is cut into parts of `most` rows: it is range partitioned by its order, row_number counts inside
   each range, and the rows of earlier ranges are added, so not even an hour that holds all rows meets in one task.
5. Each part is one file, written by one task from a sort that may spill; files are dealt to tasks by their rows.

Writing into a folder that holds such files keeps each file whose leaf, part and rows recur (by row count and sums of
two hashes), writes the others, and then deletes what was replaced. A job that breaks off before that leaves old and new
files side by side; written again, it ends as it should, as files without a plan are deleted.

Rows are ordered by moment, then the given columns, nulls first, then a hash of the row; repeated rows all stay. Rows
without a moment are the leaf `null`. Leaf and part are names of folders, `_leaf=2024.03.05.07-07/_part=1`, that no
column of the table may have; all other columns pass through. An empty table writes nothing. Maps cannot be hashed and
are refused by Spark.
"""

from __future__ import annotations

import calendar
import hashlib
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftlink.llm.scratch import Scratch, collect_garbage
from weftlink.llm.sessions import released

LEAVES = 650
NULL_LEAF = "null"
_NO_HOUR = -(2**63)


@dataclass
class Leaf:
    """Hours first <= h < end; name as parents and first-last member."""

    name: str
    first: int
    end: int
    rows: int


def _day(year: int, month: int = 1, day: int = 1) -> int:
    """Days since 1970-01-01 in the calendar that Spark uses for all years."""
    y = year - 1
    days = 365 * y + y // 4 - y // 100 + y // 400 - 719_162
    return days + sum(calendar.mdays[m] + (m == 2 and calendar.isleap(year)) for m in range(1, month)) + day - 1


def _year(day: int) -> int:
    year = 1970 + day * 400 // 146_097
    while _day(year) > day:
        year -= 1
    while _day(year + 1) <= day:
        year += 1
    return year


def _children(path: tuple[int, ...]) -> list[tuple[int, int, int]]:
    """(member, first hour, end) of a year's months, a month's days or a day's hours."""
    if len(path) == 1:
        starts = [_day(*path, m) for m in range(1, 13)] + [_day(path[0] + 1)]
    elif len(path) == 2:
        n = calendar.mdays[path[1]] + (path[1] == 2 and calendar.isleap(path[0]))
        starts = [_day(*path, d) for d in range(1, n + 1)] + [_day(*path, n) + 1]
    else:
        return [(h, 24 * _day(*path) + h, 24 * _day(*path) + h + 1) for h in range(24)]
    return [(k + 1, 24 * a, 24 * b) for k, (a, b) in enumerate(zip(starts[:-1], starts[1:], strict=True))]


def layout(hours: np.ndarray, counts: np.ndarray, most: int) -> list[Leaf]:
    """The leaves of rows counted by hour since 1970, in time order; hours rise."""
    leaves: list[Leaf] = []
    if not len(hours):
        return leaves
    total = np.concatenate([[0], np.cumsum(counts)])

    def rows(first: int, end: int) -> int:
        a, b = np.searchsorted(hours, [first, end])
        return int(total[b] - total[a])

    def place(siblings: list[tuple[int, int, int]], path: tuple[int, ...]) -> None:
        parents = "".join(f"{x:0{2 if k else 4}d}/" for k, x in enumerate(path))
        run, width = None, 2 if path else 4
        for member, first, end in siblings:
            n = rows(first, end)
            if n > most and len(path) < 3:
                place(_children((*path, member)), (*path, member))
                run = None
            elif run and run.rows + n <= most:
                run.name, run.end, run.rows = f"{run.name.rpartition('-')[0]}-{member:0{width}d}", end, run.rows + n
            else:
                run = Leaf(f"{parents}{member:0{width}d}-{member:0{width}d}", first, end, n)
                leaves.append(run)

    years = range(_year(int(hours[0]) // 24), _year(int(hours[-1]) // 24) + 1)
    place([(y, 24 * _day(y), 24 * _day(y + 1)) for y in years], ())
    return sorted((x for x in leaves if x.rows), key=lambda x: x.first)


def hour_of(moment: Column) -> Column:
    """Hours since 1970-01-01 00:00 of a time without a zone."""
    return F.datediff(moment.cast("date"), F.lit("1970-01-01").cast("date")).cast("long") * 24 + F.hour(moment)


def _folder_of(leaf: str) -> str:
    return leaf.replace("/", ".")


def _fs(spark: SparkSession, folder: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _files(spark: SparkSession, folder: str) -> list[tuple[str, int, str]]:
    """(leaf folder, part, path) of all data files."""
    path, fs = _fs(spark, folder)
    out, listed = [], fs.listFiles(path, True) if fs.exists(path) else None
    while listed is not None and listed.hasNext():
        p = listed.next().getPath()
        if p.getName().startswith(("_", ".")):
            continue
        leaf, part = p.getParent().getParent().getName(), p.getParent().getName()
        out.append((leaf.removeprefix("_leaf="), int(part.removeprefix("_part=")), p.toString()))
    return out


def read_layout(spark: SparkSession, folder: str, schema) -> DataFrame:
    """The rows of all files, with _leaf (its folder's name) and _part behind them."""
    schema = spark.createDataFrame([], schema).schema.add("_leaf", "string").add("_part", "long")
    key = "spark.sql.sources.parallelPartitionDiscovery.threshold"  # else a job with a task for each folder lists the few thousand there are at most
    before = spark.conf.get(key)
    spark.conf.set(key, "1000000")
    try:
        return spark.read.schema(schema).parquet(folder)
    finally:
        spark.conf.set(key, before)


def _digest(columns: Sequence[str]) -> list[Column]:
    """Row count and sums over the rows' hashes: what two files with the same rows share, and others by chance at 2**-96."""
    quoted = [F.col(f"`{c}`") for c in columns]
    wide = F.xxhash64(*quoted)
    low = lambda c: c.bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))
    return [F.count("*").alias("_n"), F.sum(low(wide)).alias("_a"), F.sum(low(F.shiftrightunsigned(wide, 32))).alias("_b"), F.sum(low(F.hash(*quoted).cast("long"))).alias("_c")]


def _numbered(rows: DataFrame, order: list[str], most: int, scratch: Scratch) -> DataFrame:
    """_part of every row of leaves above `most`: ranges of the leaf's order, row_number in each, plus the rows of earlier ranges."""
    ranged = rows.repartitionByRange("_leaf", *order).withColumn("_range", F.spark_partition_id())
    ranged = scratch.save_freeing(ranged, "ranged")
    earlier = F.sum("_size").over(Window.partitionBy("_leaf").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    sizes = ranged.groupBy("_leaf", "_range").agg(F.count("*").alias("_size")).select("_leaf", "_range", F.coalesce(earlier, F.lit(0)).alias("_earlier"))
    number = F.row_number().over(Window.partitionBy("_leaf", "_range").orderBy(*order))
    both = ranged.withColumn("_number", number).join(sizes, ["_leaf", "_range"])
    return both.withColumn("_part", F.expr(f"(_earlier + _number - 1) div {most} + 1")).drop("_range", "_number", "_earlier")


def write_layout(table: DataFrame, folder: str, moment: Column, order_by: Sequence[str], most: int) -> dict[tuple[str, int], tuple[str, bool]]:
    """Writes the table's rows into the folder, one Parquet file for each leaf and part.

    (leaf, part) -> (path, whether this call wrote the file). `moment` is a time without a zone, or null.
    """
    spark, columns = table.sparkSession, table.columns
    if {c.lower() for c in columns} & {"_leaf", "_part"}:
        raise ValueError("_leaf and _part name the folders of a layout")
    scratch = Scratch(spark, "layout")
    old = _files(spark, folder)
    # columns of the table travel as one struct, so that names made here never clash with theirs
    rows = table.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("_row"), moment.alias("_moment"), *(F.col(f"`{c}`").alias(f"_o{k}") for k, c in enumerate(order_by)))
    rows = rows.select("*", F.coalesce(hour_of(F.col("_moment")), F.lit(_NO_HOUR)).alias("_hour"), F.xxhash64(*(F.col("_row").getField(c) for c in columns)).alias("_tie"))
    order = ["_moment", *(f"_o{k}" for k in range(len(order_by))), "_tie"]
    counted = sorted((r["_hour"], r["count"]) for r in rows.groupBy("_hour").count().collect())
    hours, counts = np.array([h for h, _ in counted], np.int64), np.array([n for _, n in counted], np.int64)
    dated = hours != _NO_HOUR
    leaves = layout(hours[dated], counts[dated], most)
    if not dated.all():
        leaves.insert(0, Leaf(NULL_LEAF, _NO_HOUR, _NO_HOUR + 1, int(counts[~dated].sum())))
    names = {_folder_of(x.name): x.name for x in leaves}
    leaf_of = np.searchsorted([x.first for x in leaves], hours, "right") - 1
    known = pa.table({"_hour": hours, "_leaf": pa.array([_folder_of(leaves[k].name) for k in leaf_of], pa.string()), "_large": np.array([leaves[k].rows > most for k in leaf_of], bool)})
    placed = rows.join(F.broadcast(spark.createDataFrame(known)), "_hour").drop("_hour")
    parted = placed.where("NOT _large").withColumn("_part", F.lit(1).cast("long")).drop("_large")
    if any(x.rows > most for x in leaves):
        parted = parted.unionByName(_numbered(placed.where("_large").drop("_large"), order, most, scratch))
    files = {(_folder_of(x.name), p + 1): min(most, x.rows - p * most) for x in leaves for p in range(-(-x.rows // most))}
    kept: dict[tuple[str, int], str] = {}
    if old:
        stood = read_layout(spark, folder, table.schema).groupBy("_leaf", "_part").agg(*_digest(columns))
        stood = {tuple(r)[:2]: tuple(r)[2:] for r in stood.collect()}
        now = parted.groupBy("_leaf", "_part").agg(*_digest([f"_row`.`{c}" for c in columns])).collect()
        same = {tuple(r)[:2] for r in now if stood.get(tuple(r)[:2]) == tuple(r)[2:]}
        for leaf, part, path in old:
            if (leaf, part) in same:
                kept.setdefault((leaf, part), path)
        doubled = {f for f in kept if sum((leaf, part) == f for leaf, part, _ in old) > 1}
        kept = {f: p for f, p in kept.items() if f not in doubled}
    todo = {f: n for f, n in files.items() if f not in kept}
    if todo:
        dealt, tasks = _dealt(spark, todo)
        changed = parted.join(F.broadcast(dealt), ["_leaf", "_part"])
        changed = changed.withColumn("_leaf", F.coalesce("_leaf", F.lit(""))).repartitionById(tasks, "_task").sortWithinPartitions("_leaf", "_part", *order)
        changed = changed.select(*(F.col("_row").getField(c).alias(c) for c in columns), "_leaf", "_part")
        changed.write.partitionBy("_leaf", "_part").option("maxRecordsPerFile", 0).mode("append").parquet(folder)
    stay, gone = set(kept.values()), [path for _, _, path in old]
    _delete(spark, [p for p in gone if p not in stay])
    scratch.drop()
    collect_garbage(spark)
    found = {(leaf, part): path for leaf, part, path in _files(spark, folder)}
    if set(found) != set(files):
        raise RuntimeError(f"{len(found)} files instead of {len(files)}")
    return {(names[leaf], part): (path, (leaf, part) not in kept) for (leaf, part), path in found.items()}


def _dealt(spark: SparkSession, files: dict[tuple[str, int], int]) -> tuple[DataFrame, int]:
    """Files in order, dealt to tasks by their rows; no more tasks than shuffle partitions. A file is never over `most` rows, so there are few files however many rows."""
    tasks = max(1, min(len(files), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    size = np.array([files[f] for f in sorted(files)], np.int64)
    task = (np.cumsum(size) - size) * tasks // max(1, int(size.sum()))
    table = {"_leaf": [f[0] for f in sorted(files)], "_part": [f[1] for f in sorted(files)], "_task": task.astype(np.int32)}
    return spark.createDataFrame(pa.table(table)), tasks


def _delete(spark: SparkSession, paths: list[str]) -> None:
    """Deletes files, and the folders that this empties."""
    for p in paths:
        path, fs = _fs(spark, p)
        fs.delete(path, False)
        for x in (path.getParent(), path.getParent().getParent()):
            if not fs.listStatus(x):
                fs.delete(x, False)


def _file_rows(columns: str):
    """One row for each file of a partition sorted by file and row: number of rows and of new ones, digest of the keys in order."""

    @released
    def run(batches):
        now, n, new, sha = None, 0, 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            leaf, part = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            cut = np.flatnonzero(np.concatenate([[True], (part[1:] != part[:-1]) | np.array([a != b for a, b in zip(leaf[1:], leaf[:-1])], bool)]))
            for a, b in zip(cut.tolist(), [*cut[1:].tolist(), batch.num_rows], strict=True):
                if (leaf[a], int(part[a])) != now:
                    if now:
                        yield _file_row(now, n, new, sha, columns)
                    now, n, new, sha = (leaf[a], int(part[a])), 0, 0, hashlib.sha256()
                ids = ",".join(x or "" for x in batch.column(2).slice(a, b - a).to_pylist())
                sha.update((f",{ids}" if n else ids).encode())
                n, new = n + b - a, new + int(batch.column(3).slice(a, b - a).to_numpy(zero_copy_only=False).sum())
        if now:
            yield _file_row(now, n, new, sha, columns)

    return run


def _file_row(file, n, new, sha, columns) -> pa.RecordBatch:
    values = [[file[0]], [file[1]], [columns], [sha.hexdigest()], [n], [new]]
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()], strict=True)], ["_leaf", "_part", "columns", "ids_sha256", "n_rows", "n_new"])


def describe_files(spark: SparkSession, folder: str, schema, files: dict[tuple[str, int], tuple[str, bool]], key: str, new: Column) -> DataFrame:
    """(leaf, part, columns, ids_sha256, n_rows, n_new, path, rewritten) of every file, read from the files themselves.

    ids_sha256 is the digest of the decimal keys in file order, joined by commas (a null key is empty); a file streams through one task.
    """
    if not files:
        return spark.createDataFrame([], "leaf string, part long, columns string, ids_sha256 string, n_rows long, n_new long, path string, rewritten boolean")
    rows = read_layout(spark, folder, schema)
    columns = ",".join(c for c in rows.columns if c not in ("_leaf", "_part"))
    counted = rows.select("_leaf", "_part", F.col(f"`{key}`").cast("string").alias("_key"), F.coalesce(new, F.lit(True)).alias("_new"), F.col("_metadata.row_index").alias("_at"))
    dealt, tasks = _dealt(spark, {(_folder_of(leaf), part): 1 for leaf, part in files})
    sorted_rows = counted.join(F.broadcast(dealt), ["_leaf", "_part"]).repartitionById(tasks, "_task").sortWithinPartitions("_leaf", "_part", "_at").select("_leaf", "_part", "_key", "_new")
    found = sorted_rows.mapInArrow(_file_rows(columns), "_leaf string, _part long, columns string, ids_sha256 string, n_rows long, n_new long")
    told = [(_folder_of(leaf), part, leaf, path, wrote) for (leaf, part), (path, wrote) in files.items()]
    told = spark.createDataFrame(told, "_leaf string, _part long, leaf string, path string, rewritten boolean")
    return found.join(F.broadcast(told), ["_leaf", "_part"]).select("leaf", F.col("_part").alias("part"), "columns", "ids_sha256", "n_rows", "n_new", "path", "rewritten")


def shifted_moment(ts: Column, click_id: Column) -> Column:
    """The time by which the clicks are laid out: an eighth of them years back, an eighth at the start of their week."""
    k = F.crc32(click_id.cast("long").cast("string").cast("binary")) % 128
    ts = ts.cast("timestamp_ntz")
    days = ((k + 6) * (k + 6) * (k + 6)).cast("int")
    monday = F.date_sub(ts.cast("date"), F.weekday(ts.cast("date"))).cast("timestamp_ntz")
    return F.when(k < 16, ts - F.make_dt_interval(days)).when(k > 111, monday).otherwise(ts)


def clicks_layout(clicks: DataFrame, folder: str) -> DataFrame:
    """Writes the clicks that arrived before March, then all, into the folder; describes the files that are there in the end."""
    spark, early = clicks.sparkSession, F.col("arrived_at") < F.lit("2024-03-01 00:00:00").cast("timestamp_ntz")
    most, moment = 1 + clicks.count() // LEAVES, shifted_moment(F.col("ts"), F.col("click_id"))
    write_layout(clicks.where(early), folder, moment, ["arrived_at", "click_id"], most)
    files = write_layout(clicks, folder, moment, ["arrived_at", "click_id"], most)
    return describe_files(spark, folder, clicks.schema, files, "click_id", ~early)
