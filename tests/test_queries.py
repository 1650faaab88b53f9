from __future__ import annotations

import math

import duckdb
import pytest
from weftlink import plans
from weftlink.operators.fixtures import sources, targets
from weftlink.streaming.arrivals import stream_candidates

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUICK = ["normalize_name", "address_anchors", "metaphone_keys", "score_channel_wp", "score_channel_ph", "score_channel_pn", "candidates_with_phonetics", "topk_candidates", "plain_features", "macro_f05", "threshold_sweep", "grid_sweep", "roc_auc", "candidate_recall", "validator_outside_candidates", "validator_findings", "sampled_targets"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def rows(frame):
    cols = sorted(frame.columns)
    return cols, sorted(tuple("" if v is None or v is math.nan else str(round(v, 6) + 0.0) if isinstance(v, float) else str(v) for v in r) for r in frame[cols].itertuples(index=False))


@pytest.mark.parametrize("name", QUICK)
def test_against_sql(spark, con, name):
    assert rows(plans.queries()[name](spark, DATA).toPandas()) == rows(con.sql(plans.oracle_sql()[name]).df())


def test_every_sql_has_a_query():
    assert set(plans.oracle_sql()) <= set(plans.queries())


def test_entry_imports():
    import __spark_entry__ as entry

    assert set(plans.queries()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_stream_equals_batch(spark, tmp_path):
    s1, _, _ = sources(spark, DATA)
    s1.write.parquet(f"{tmp_path}/in")
    config = plans.queries and __import__("weftlink.operators.blocking", fromlist=["BlockingConfig"]).BlockingConfig(channels=("tok",))
    arrivals = spark.readStream.schema(s1.schema).parquet(f"{tmp_path}/in")
    stream_candidates(arrivals, targets(spark, DATA), f"{tmp_path}/out", f"{tmp_path}/check", config).awaitTermination(120)
    from weftlink.operators.blocking import candidates

    want = {tuple(r) for r in candidates(s1, targets(spark, DATA), config).collect()}
    assert {tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").drop("batch").collect()} == want
