"""Tab-separated tables of entities, links and id lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

ENTITY = StructType([StructField(c, StringType()) for c in ("entity_id", "business_name", "business_address", "country")])
GROUND_TRUTH = StructType([StructField(c, StringType()) for c in ("source1_entity_id", "matched_entity_ids")])
CANDIDATES = StructType([StructField(c, StringType()) for c in ("source1_entity_id", "candidate_entity_ids")])
_OPTIONS = {"sep": "\t", "header": "true", "encoding": "UTF-8", "quote": ""}


def read_tsv(spark: SparkSession, path: str, schema: StructType = ENTITY) -> DataFrame:
    """Always by an explicit schema of strings: ids of digits stay strings."""
    return spark.read.schema(schema).options(**_OPTIONS).csv(path)


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").options(**_OPTIONS, emptyValue="", nullValue="").csv(path)


def write_tsv_file(df: DataFrame, path: str, order: str) -> None:
    """One file with one header, sorted by `order`: ranges are written by their tasks, then joined by the file system in their order, stream by stream."""
    spark, parts = df.sparkSession, f"{path}.parts"
    df.repartitionByRange(order).sortWithinPartitions(order).write.mode("overwrite").options(**_OPTIONS | {"header": "false"}, emptyValue="", nullValue="").csv(parts)
    hadoop = spark._jvm.org.apache.hadoop
    source, target = hadoop.fs.Path(parts), hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = fs.create(target, True)
    try:
        out.write(("\t".join(df.columns) + "\n").encode())
        for part in sorted(x.getPath().toString() for x in fs.listStatus(source) if x.getPath().getName().startswith("part-")):
            held = fs.open(hadoop.fs.Path(part))
            try:
                hadoop.io.IOUtils.copyBytes(held, out, 4 << 20, False)
            finally:
                held.close()
    finally:
        out.close()
    fs.delete(source, True)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """Distinct trimmed first fields of non-blank lines behind the header."""
    return ids_of(read_lines(spark, path).where(F.col("line") > 1))


def first_fields(lines: DataFrame) -> DataFrame:
    """Trimmed first fields of non-blank lines, repeats included."""
    return lines.where(F.trim("value") != "").select(F.trim(F.substring_index("value", "\t", 1)).alias("entity_id"))


def ids_of(lines: DataFrame) -> DataFrame:
    return first_fields(lines).distinct()


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line from 1, value) of a file, or of the files of a folder by name, each of which repeats the header.

    A split's rows are numbered in its task; lines before it come from the row counts of the splits, so nothing but
    one row for each split is ever sorted.
    """
    file, start = F.col("_metadata.file_path"), F.col("_metadata.file_block_start")
    text = spark.read.text(path).select("value", file.alias("file"), start.alias("start"), F.monotonically_increasing_id().alias("at"))
    splits = text.groupBy("file", "start").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    order = Window.orderBy("file", "start")  # one row for each split
    before = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    splits = splits.select("file", "start", "first", before.alias("before"), F.first("file").over(order).alias("leading"))
    line = F.col("at") - F.col("first") + F.col("before") + 1
    head = (F.col("start") == 0) & (F.col("at") == F.col("first")) & (F.col("file") != F.col("leading"))
    return text.join(splits, ["file", "start"]).where(~head).select(line.alias("line"), "value")


def parse_id_lists(df: DataFrame, key: str, lists: str) -> DataFrame:
    """(s1_id, ids): comma lists as arrays of trimmed ids; null, blank and 'None' are empty and stay."""
    ids = F.filter(F.transform(F.split(F.coalesce(F.col(lists), F.lit("")), ","), lambda x: F.trim(x)), lambda x: (x != "") & (x != "None"))
    return df.select(F.col(key).alias("s1_id"), ids.alias("ids"))


def save_model(model, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str):
    from pyspark.ml import PipelineModel

    return PipelineModel.load(path)
