from __future__ import annotations

import time

from pyspark.sql import functions as F
from weftlink.sources.tables import written


def _shuffle_files(spark):
    blocks = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
    return {name for i in range(blocks.size()) if (name := blocks.apply(i).getName()).startswith("shuffle_")}


def test_a_written_table_leaves_no_shuffle_files(spark):
    df = spark.range(1000).repartition(5).groupBy((F.col("id") % 7).alias("k")).count()
    before = _shuffle_files(spark)
    out = written(df, "counts")
    until = time.time() + 10
    while (left := _shuffle_files(spark) - before) and time.time() < until:
        time.sleep(0.2)
    assert not left
    assert sorted(r["count"] for r in out.collect()) == [142, 143, 143, 143, 143, 143, 143]
