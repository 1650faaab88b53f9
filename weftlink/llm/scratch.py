"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from weftlink.llm.sessions import give_back

_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. A folder of our own serves only where driver and executors are one process."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if spark.sparkContext.applicationId not in _OWN:
        _OWN[spark.sparkContext.applicationId] = "file://" + tempfile.mkdtemp(prefix="weftlink-")
    return _OWN[spark.sparkContext.applicationId]


def collect_garbage(spark: SparkSession) -> None:
    """Lets Spark delete shuffle files and broadcasts that no DataFrame refers to; else they wait for the driver's next full collection."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


class Scratch:
    """Written tables cut lineage and survive the loss of executors."""

    opened: list[Scratch] = []

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        Scratch.opened.append(self)

    def save_freeing(self, df: DataFrame, name: str, **options: str) -> DataFrame:
        """save, after which Spark deletes the shuffle files of this write at once; df must not be used again."""
        key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
        before = self.spark.conf.get(key, None)
        self.spark.conf.set(key, "true")
        try:
            return self.save(df, name, **options)
        finally:
            self.spark.conf.unset(key) if before is None else self.spark.conf.set(key, before)

    def save(self, df: DataFrame, name: str, **options: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.options(**options).parquet(path)
        give_back()
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Frees tables that nothing reads any more; without names all of them."""
        jvm = self.spark.sparkContext._jvm
        for path in [f"{self.root}/{name}" for name in names] or [self.root]:
            path = jvm.org.apache.hadoop.fs.Path(path)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    @classmethod
    def drop_since(cls, mark: int) -> None:
        """Frees the tables of every operator called since opened had this length; their results must have been written."""
        while len(cls.opened) > mark:
            cls.opened.pop().drop()
