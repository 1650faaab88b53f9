"""Validation samples: entities per country, their truth, and targets with distractors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def first_per_country(source1: DataFrame, n: int, countries: tuple[str, ...] | None = None) -> DataFrame:
    """The first n entities of each country by id (a grouped limit, not a sort of everything)."""
    rows = source1 if countries is None else source1.where(F.col("country").isin(*countries))
    w = Window.partitionBy("country").orderBy("entity_id")
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def truth_of(truth: DataFrame, entities: DataFrame) -> DataFrame:
    return truth.join(entities.select(F.col("entity_id").alias("source1_entity_id")), "source1_entity_id", "left_semi")


def targets_with_distractors(targets: DataFrame, links: DataFrame, n: int) -> DataFrame:
    """True targets of links(tgt_id) and the first n targets by id, each once."""
    true = targets.join(links.select(F.col("tgt_id").alias("entity_id")), "entity_id", "left_semi")
    return true.unionByName(targets.orderBy("entity_id").limit(n)).dropDuplicates(["entity_id"])


def one_per_entity(df: DataFrame) -> DataFrame:
    """Of rows that share an id the one with the smallest name, then address."""
    w = Window.partitionBy("entity_id").orderBy("business_name", "business_address", "country")
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
