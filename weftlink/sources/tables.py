"""Tables written in between: they cut lineage, are read many times, and outlive lost executors."""

from __future__ import annotations

import re
import tempfile
import time
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; where that is unset, and driver and executors are one process, a folder of our own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if spark.sparkContext.applicationId not in _OWN:
        _OWN[spark.sparkContext.applicationId] = "file://" + tempfile.mkdtemp(prefix="weftlink-")
    return _OWN[spark.sparkContext.applicationId]


def parts_of(rows: int, each: int) -> int:
    """Partitions of about `each` rows; stated where a row costs more than its bytes tell, as Spark joins small partitions by bytes."""
    return max(1, -(-rows // each))


@dataclass(frozen=True)
class Stage:
    """What writing a table took."""

    name: str
    rows: int
    seconds: float


def written(df: DataFrame, name: str, stages: list[Stage] | None = None) -> DataFrame:
    """df, written under a name of its own and read again; the shuffle files of the write go at once. stages gets the rows, counted on their way, and the seconds."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex[:12]}"
    schema, began = df.schema, time.perf_counter()
    if stages is not None:
        seen = Observation(f"{name}-{uuid.uuid4().hex[:12]}")
        df = df.observe(seen, F.count(F.lit(1)).alias("rows"))
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key, None)
    conf.set(key, "true")  # else they stay until the driver happens to collect its garbage
    try:
        df.write.parquet(path)
    finally:
        conf.unset(key) if before is None else conf.set(key, before)
    if stages is not None:
        stages.append(Stage(name, seen.get["rows"], round(time.perf_counter() - began, 3)))
    return df.sparkSession.read.schema(schema).parquet(path)
