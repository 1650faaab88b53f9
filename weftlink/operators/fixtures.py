"""Linkage inputs made from customer, part and nation; ground truth is by construction (the same k)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftlink.sources.tables import parts_of


def _base(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, p, n = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("customer", "part", "nation"))
    k = F.col("c_custkey")
    return (
        c.repartition(parts_of(c.count(), 5_000), "c_custkey")
        .join(p, p["p_partkey"] == k)
        .join(F.broadcast(n), n["n_nationkey"] == c["c_nationkey"])  # 25 nations by definition
        .select(
            k.alias("k"),
            F.split("p_name", " ")[0].alias("w1"),
            F.split("p_name", " ")[1].alias("w2"),
            F.lower("c_mktsegment").alias("seg"),
            (100 + (k * 37) % 900).cast("string").alias("num"),
            F.lower(F.replace("n_name", F.lit("_"), F.lit(" "))).alias("nat"),
            (10000 + (k * 7919) % 80000).cast("string").alias("pc"),
            F.expr("case c_nationkey % 3 when 0 then 'US' when 1 then 'India' else 'France' end").alias("country"),
            ((k * 31) % 9973).cast("string").alias("tag"),
        )
    )


def sources(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(source1, source2, source3): transposed, accented, dotted, doubled and fused spellings of the same entities."""
    b = _base(spark, sf_dir)
    s1 = b.selectExpr("concat('S1-', k) entity_id", "concat(w1, ' ', w2, ' ', seg, ' ', tag, if(k % 6 = 0, ' L.L.C.', ' Pvt Ltd')) business_name", "concat(if(k % 12 = 0, concat('Plot ', num, '-', k % 50, '/2, '), concat(num, ' ')), seg, ' Road, ', nat, ' ', pc) business_address", "country")
    s2 = b.where("k % 4 <> 0").selectExpr(
        "concat('S2-', k) entity_id",
        "concat(if(k % 10 = 1, replace(w2, 'e', 'é'), w2), ' ', w1, ' ', seg, ' ', tag, ' Limited') business_name",
        "if(k % 5 = 0, '', concat(num, ' ', seg, ' Rd ', nat)) business_address",
        "country",
    )
    s3 = b.where("k % 3 = 0").selectExpr(
        "concat('S3-', k) entity_id",
        "concat(if(k % 9 = 0, 'www.', ''), w1, if(k % 2 = 0, ' ', ''), replace(w2, 'a', 'aa'), ' ', seg, ' ', tag) business_name",
        "concat('Near ATM ', num, '-', k % 50, '/2 ', nat, ' ', pc) business_address",
        "country",
    )
    return s1, s2, s3


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, s2, s3 = sources(spark, sf_dir)
    return s2.unionByName(s3)


def ground_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source1_entity_id, matched_entity_ids) with empty lists for entities without a match."""
    ids = "concat_ws(',', if(k % 4 <> 0, concat('S2-', k), null), if(k % 3 = 0, concat('S3-', k), null))"
    return _base(spark, sf_dir).selectExpr("concat('S1-', k) source1_entity_id", f"{ids} matched_entity_ids")
