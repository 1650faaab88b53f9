from __future__ import annotations

from pyspark.sql import functions as F
from weftlink.functions import kernels as K
from weftlink.operators import fixtures, linkage
from weftlink.operators import validate as V
from weftlink.operators.blocking import BlockingConfig, prepare
from weftlink.operators.features import pair_features, pair_records, plain_features
from weftlink.sources import tsv

DATA = "/root/testdata/sf0.001"


def test_training_and_inference_give_valid_files(spark, tmp_path):
    s1, s2, s3 = fixtures.sources(spark, DATA)
    for n, s in ((1, s1), (2, s2), (3, s3)):
        tsv.write_tsv(s, f"{tmp_path}/test_source{n}.tsv")
    truth = tsv.parse_id_lists(fixtures.ground_truth(spark, DATA), "source1_entity_id", "matched_entity_ids")
    config = BlockingConfig(channels=("wp", "cmp", "sh", "npc", "nat", "cpd"))
    source1, *others = (tsv.read_tsv(spark, f"{tmp_path}/test_source{n}.tsv") for n in (1, 2, 3))
    targets = others[0].unionByName(others[1])
    report = linkage.train(source1, targets, truth, f"{tmp_path}/model", config, trees=4)
    assert report.recall_pct > 95 and report.auc > 0.9 and report.macro_f05 > 0.5 and len(report.importances) == 20
    assert [s.name for s in report.stages] == ["records", "records", "candidates", "features", "model", "scored"]
    assert report.stages[0].rows == s1.count() and report.stages[2].rows == report.stages[3].rows > 0 and all(s.seconds > 0 for s in report.stages)
    linkage.generate(source1, targets, f"{tmp_path}/model", f"{tmp_path}/out", config, report.rule)
    errors, warnings = V.validate_outputs(spark, f"{tmp_path}/out/{linkage.MATCHES}", f"{tmp_path}/out/{linkage.CANDIDATES}", str(tmp_path), True)
    assert (errors, warnings) == ([], [])
    lines = (tmp_path / "out" / linkage.MATCHES).read_text().splitlines()
    assert lines[0] == "source1_entity_id\tmatched_entity_ids" and lines[1:] == sorted(lines[1:]) and lines.count(lines[0]) == 1
    assert V.main(["-m", f"{tmp_path}/out/{linkage.MATCHES}", "-c", f"{tmp_path}/out/{linkage.CANDIDATES}", "-t", str(tmp_path), "--check-ids"]) == 0
    found = tsv.read_tsv(spark, f"{tmp_path}/out/{linkage.MATCHES}", tsv.GROUND_TRUTH)
    assert found.count() == s1.count() and found.where("matched_entity_ids <> ''").count() > 50


def test_unknown_targets_go_and_ranks_keep_gaps(spark):
    from weftlink.operators.blocking import prepare

    one = spark.createDataFrame([("S1-1", "a", "b", "US")], tsv.ENTITY)
    two = spark.createDataFrame([("S2-1", "a", "b", "US"), ("S2-3", "a", "b", "US")], tsv.ENTITY)
    pairs = spark.createDataFrame([("S1-1", f"S2-{i}", i) for i in (1, 2, 3)], "s1_id string, tgt_id string, rank int")
    got = pair_records(pairs, prepare(one), prepare(two)).select("tgt_id", "rank").collect()
    assert sorted(map(tuple, got)) == [("S2-1", 1), ("S2-3", 3)]


def test_lines_are_numbered_across_splits_and_files(spark, tmp_path):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
    try:
        want = ["head"] + [f"row {i} " + "x" * (i % 17) for i in range(200)]
        (tmp_path / "one.tsv").write_text("\n".join(want) + "\n")
        assert [tuple(r) for r in tsv.read_lines(spark, f"{tmp_path}/one.tsv").orderBy("line").collect()] == list(enumerate(want, 1))
        folder = tmp_path / "many"
        folder.mkdir()
        (folder / "part-1").write_text("head\n" + "a\n" * 90)
        (folder / "part-2").write_text("head\n" + "b\n" * 300)
        got = [r["value"] for r in tsv.read_lines(spark, str(folder)).orderBy("line").collect()]
        assert got == ["head"] + ["a"] * 90 + ["b"] * 300
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_texts_that_are_not_utf8_fail(spark, tmp_path, capsys):
    (tmp_path / "test_source1.tsv").write_text("entity_id\tbusiness_name\tbusiness_address\tcountry\nS1-1\tn\ta\tUS\n")
    (tmp_path / "m.tsv").write_bytes(b"source1_entity_id\tmatched_entity_ids\nS1-1\tS2-\xe9\n")
    argv = ["-m", f"{tmp_path}/m.tsv", "-c", f"{tmp_path}/none.tsv", "-t", str(tmp_path)]
    assert V.main(argv) == 1 and "not UTF-8 text" in capsys.readouterr().out
    (tmp_path / "m.tsv").write_text("source1_entity_id\tmatched_entity_ids\nS1-1\t \t\n")
    assert V.main(argv) == 0 and "1 rows (1 empty, 0 with ids)" in capsys.readouterr().out


def test_words_are_split_for_records_not_for_pairs(spark):
    names = [(f"S-{i}", n, a, "US") for i, (n, a) in enumerate([("Red Box Red Ltd", "12 Oak Road"), ("box red", "12 road oak"), ("", ""), ("Éclat d'or", None), (None, "5 elm")])]
    one = prepare(spark.createDataFrame(names, "entity_id string, business_name string, business_address string, country string"))
    pairs = spark.createDataFrame([(a[0], b[0], 1) for a in names for b in names], "s1_id string, tgt_id string, rank int")
    paired = pair_records(pairs, one, one)
    made = pair_features(paired)
    above = made._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]
    assert "name_words" in above and "split(" not in above and "array_sort(" not in above
    # the same as from whole names and addresses
    address = lambda f: F.when(F.col("a_is_empty") | F.col("b_is_empty"), 0.0).otherwise(f(F.col("a_address"), F.col("b_address")))
    plain = {"name_token_sort": K.token_sort_of(F.col("a_name"), F.col("b_name")), "name_token_set": K.token_set_of(F.col("a_name"), F.col("b_name")), "addr_token_sort": address(K.token_sort_of), "addr_token_set": address(K.token_set_of)}
    plain |= {c: plain_features()[c] for c in ("shared_token_count", "first_token_match")}
    want = paired.select("s1_id", "tgt_id", *(x.cast("float").alias(c) for c, x in plain.items()))
    assert sorted(map(tuple, made.select(*want.columns).collect())) == sorted(map(tuple, want.collect())) and want.count() == 25
