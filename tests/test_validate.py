from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from weftlink.operators import validate as V
from weftlink.sources import tsv

HEAD = "source1_entity_id\tmatched_entity_ids\n"
GOOD = "S1-1\tS2-1,S3-1\nS1-2\t\n"


@pytest.fixture
def folder(tmp_path):
    for n, ids in (("1", ["S1-1", "S1-2"]), ("2", ["S2-1", "S2-2"]), ("3", ["S3-1"])):
        (tmp_path / f"test_source{n}.tsv").write_text("entity_id\tbusiness_name\tbusiness_address\tcountry\n" + "".join(f"{i}\tn\ta\tUS\n" for i in ids) + "\n")
    (tmp_path / "candidate.tsv").write_text("source1_entity_id\tcandidate_entity_ids\nS1-1\tS2-1,S2-2,S3-1\nS1-2\tS2-2\n")
    return tmp_path


def check(spark, folder, text, ids=True):
    (folder / "matching.tsv").write_text(text)
    errors, warnings = V.validate_outputs(spark, f"{folder}/matching.tsv", f"{folder}/candidate.tsv", str(folder), ids)
    return [e[1] for e in errors], [w[1] for w in warnings]


@pytest.mark.parametrize(
    "text,rule",
    [
        (HEAD.replace("\t", ",") + GOOD, "fields are separated by commas; tabs are needed"),
        ("", "the file is empty"),
        (HEAD + GOOD + "oops\n", "no tab"),
        (HEAD + GOOD + "S1-1\tS2-1\n", "entity on several rows"),
        (HEAD + "S1-1\tS2-1,S2-1\nS1-2\t\n", "id repeated in a list"),
        (HEAD + "S1-1\tS1-2\nS1-2\t\n", "source-1 id in a list"),
        (HEAD + "S1-1\tX2-1\nS1-2\t\n", "id without S2- or S3-"),
        (HEAD + "S1-1\tS2-1,\nS1-2\t\n", "id without S2- or S3-"),
        (HEAD + 'S1-1\tS2-1\nS1-2\t""\n', "id without S2- or S3-"),
        (HEAD + "S1-1\tS2-77\nS1-2\t\n", "unknown id"),
        (HEAD + "S1-1\tS2-1\n", "required entity missing"),
        (HEAD + GOOD + "S1-3\tS2-1\n", "entity not asked for"),
    ],
)
def test_rules(spark, folder, text, rule):
    assert rule in check(spark, folder, text)[0]


def test_good_files_and_warnings(spark, folder):
    assert check(spark, folder, HEAD + GOOD) == ([], [])
    assert check(spark, folder, HEAD + "\nS1-1\tS2-1\nS1-2\tS2-1\n") == ([], ["match is no candidate"])
    assert check(spark, folder, HEAD + GOOD, ids=False) == ([], ["existence isn't checked"])
    assert V.validate_outputs(spark, f"{folder}/none.tsv", None, str(folder))[0][0][:2] == ("matching", "not found")
    assert V.validate_outputs(spark, "x", None, f"{folder}/none")[0][0][0] == "test_source1.tsv"


def test_written_lists_are_valid(spark, folder):
    df = spark.createDataFrame([("S1-1", "S2-1"), ("S1-2", "")], "source1_entity_id string, matched_entity_ids string").coalesce(1)
    tsv.write_tsv(df, f"{folder}/out")
    part = next((folder / "out").glob("part-*"))
    assert part.read_text() == HEAD + "S1-1\tS2-1\nS1-2\t\n"
    back = tsv.read_tsv(spark, f"{folder}/out", tsv.GROUND_TRUTH)
    assert tsv.parse_id_lists(back, *tsv.GROUND_TRUTH.names).where(F.size("ids") == 0).count() == 1


def test_all_findings_in_one_pass(spark, folder):
    """Both files are sent by one exchange and summed by another; an id of all lists and an entity of all rows are summed before."""
    rows = spark.range(3000).select(F.col("id").alias("line"), F.when(F.col("id") % 3 == 0, F.lit("S1-1")).otherwise(F.concat(F.lit("S1-"), "id")).alias("s1"), F.array(F.lit("S2-1"), F.lit("S1-9"), F.concat(F.lit("X"), F.col("id") % 7)).alias("ids"))
    required = spark.createDataFrame([("S1-1",), ("S1-1",), ("S1-x",)], "entity_id string")
    found = V.summary(V.offences({n: V.row_messages(rows, n) for n in ("matching", "candidate")}, required, required.select(F.lit("S2-2").alias("entity_id"))))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and "Join" not in plan
    got = {(r["file"], r["rule"]): (r["n"], r["examples"]) for r in found.collect()}
    others = sorted(f"S1-{i}" for i in range(3000) if i % 3)
    want = {"rows": (3000, []), V.SEVERAL: (1, ["S1-1"]), V.SELF: (1, ["S1-9"]), V.PREFIX: (7, [f"X{i}" for i in range(5)]), V.MISSING: (1, ["S1-x"]), V.EXTRA: (1999, [i for i in others if i != "S1-1"][:5]), V.UNKNOWN: (1, ["S2-1"])}
    assert got == {(f, r): v for f in ("matching", "candidate") for r, v in want.items()}


def test_rows_of_an_entity_that_repeats(spark):
    """The last row is compared with the candidates; an entity without a candidate row has none; empty files give no findings."""
    rows = lambda *r: spark.createDataFrame(list(r), "line long, s1 string, ids array<string>")
    matching = rows((2, "S1-1", ["S2-1"]), (3, "S1-1", ["S2-9"]), (4, "S1-2", ["S2-1"]), (5, "S1-3", []), (6, "S1-4", ["S2-2", "S2-2"]))
    candidate = rows((2, "S1-1", ["S2-1"]), (2, "S1-4", ["S2-2"]))
    assert {r["item"] for r in V.outside_candidates(matching, candidate).collect()} == {"S1-1", "S1-2"}
    assert {r["item"] for r in V.repeated_ids(matching).collect()} == {"S1-4"}
    assert V.summary(V.offences({"matching": V.row_messages(matching.limit(0), "matching")})).collect() == []


def test_files_that_are_no_lists(spark, folder):
    (folder / "candidate.tsv").write_bytes(b"source1_entity_id\tcandidate_entity_ids\nS1-1\t\xff\n")
    assert check(spark, folder, HEAD + "\nS1-1\tS2-1\noops\n") == (["not UTF-8 text", "no tab", "required entity missing"], [])
    assert V.validate_outputs(spark, f"{folder}/matching.tsv", f"{folder}/none.tsv", str(folder))[1] == [("ids", "existence isn't checked", 1, []), ("candidate", "not found", 1, [])]
