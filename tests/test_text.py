from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from weftlink.functions import scripts
from weftlink.functions import text as T

NAMES = {
    "L.L.C. Cafe Pvt. Ltd.": "cafe",
    "Raam Innvestments Private Limited": "ram investments",
    "Coffee Company": "cofe",
    "www.example.co.in": "example",
    "https://www.acme.com": "acme",
    "Limmited Traders": "limited traders",
    "Service 1100": "1100",
    "A & B Co": "a b",
    "U.S. Steel Corp": "us stel",
    "a.b.c.d": "abc d",
    "Group Services Ltd": "",
    "Société Générale SA": "societe generale",
    "Straße": "strase",
    "nan": "",
    "None": "",
    "": "",
}


def test_normalize_text(spark):
    df = spark.createDataFrame([(k, v) for k, v in NAMES.items()] + [(None, "")], "raw string, want string")
    bad = df.withColumn("got", T.normalize_text(F.col("raw"))).where("got <> want").collect()
    assert bad == []


@pytest.mark.parametrize(
    "raw,numbers,postal,words,empty",
    [
        ("Flat 12, 12 MG Road, Near SBI ATM, Bengaluru 560001", ["12", "12", "560001"], "560001", ["flat", "sbi", "atm", "bengaluru"], False),
        ("12345 Main Street, Springfield, IL 62704-1234", ["12345", "62704", "1234"], "12345", ["main", "stret", "springfield"], False),
        ("39-17-48/1 Opp. Null Floor", ["39", "17", "48"], None, ["nul", "flor"], False),
        ("1234567 x ३९", ["३९"], None, [], False),
        ("  ", [], None, [], False),
        ("", [], None, [], True),
        ("nan", [], None, [], True),
        (None, [], None, [], True),
    ],
)
def test_address_anchors(spark, raw, numbers, postal, words, empty):
    a = spark.createDataFrame([(raw,)], "raw string").select(T.address_anchors(F.col("raw")).alias("a")).first()["a"]
    assert (a["numbers"], a["postal_code"], a["clean_address_tokens"], a["is_empty"]) == (numbers, postal, words, empty)


def test_tokens_and_shingles(spark):
    df = spark.createDataFrame([("ab abc abcd a abc",)], "c string")
    r = df.select(T.name_tokens(F.col("c")).alias("t"), T.prefix_shingles(T.name_tokens(F.col("c"))).alias("s"), T.token_sorted(F.col("c")).alias("o"), T.compressed_shingles(F.col("c")).alias("z"), T.soundex_keys(F.array(F.lit("ashcraft"), F.lit("3mcorp"), F.lit("123"))).alias("x")).first()
    assert r["t"] == ["ab", "abc", "abcd", "abc"]
    assert r["s"] == ["abc", "abcd"]
    assert r["o"] == "a ab abc abc abcd"
    assert r["z"] == ["abab", "ababc"]
    assert r["x"] == ["sx:A261", "sx:3mcorp"]


def test_compound_numbers(spark):
    rows = {"39-17-48/1 X": ["39-17-48/1"], "J-3/299": ["j-3/299"], "foo-bar": [], "nan": [], "AF-684 and b/2": ["af-684", "b/2"]}
    got = spark.createDataFrame([(k,) for k in [*rows, None]], "raw string").select("raw", T.compound_numbers(F.col("raw")).alias("c")).collect()
    assert {r["raw"]: r["c"] for r in got} == rows | {None: []}


SCRIPTS = {
    "École": "ecole",
    "ﬁne Ｗｏｒｋ": "fine work",
    "Газпром": "gazprom",
    "Щербаков и Сын": "shcherbakov i syn",
    "больница": "bolnitsa",
    "ΑΘΗΝΑ": "athena",
    "Σίγμα": "sigma",
    "Ψυχή": "psukhe",
    "شركة": "shrkh",
    "בנק": "bnq",
    "Երևան": "erevan",
    "თბილისი": "tbilisi",
    "한국전력": "hangugjeonryeog",
    "값 없음": "gabs eobseum",
    "टाटा": "ttaattaa",
    "नमस्ते": "nmste",
    "กรุง": "krung",
    "ひらがな カタカナ": "hiragana katakana",
    "३९": "39",
    "a—b": "a b",
    "北京": " u21271  u20140 ",
    "x🙂y": "x y",
    "é́": "e",
}


def test_every_script_has_its_sounds(spark):
    df = spark.createDataFrame([(k,) for k in [*SCRIPTS, "", None]], "t string").select("t", T.any_ascii(F.col("t")).alias("got"))
    assert {r["t"]: r["got"] for r in df.collect()} == SCRIPTS | {"": "", None: None}


def test_every_syllable_and_table_entry(spark):
    hangul = "".join(chr(c) for c in range(0xAC00, 0xD7A4))
    table = scripts.sounds()
    df = spark.createDataFrame([(hangul,), *[(c,) for c in table]], "t string").select("t", T.romanised(F.col("t")).alias("got"))
    got = {r["t"]: r["got"] for r in df.collect()}
    lead, vowel, tail = ([x.strip("-") for x in part] for part in scripts.HANGUL)
    assert got.pop(hangul) == "".join(a + b + c for a in lead for b in vowel for c in tail)
    assert got == table and all(s == "" or s.isascii() and s == s.lower() for s in table.values())


def test_normalisation_takes_every_script_without_python(spark):
    cases = {"टाटा Steel Ltd": "tata stel", "École—Straße № 5": "ecole strase no 5", "Газпром ООО": "gazprom o", "plain Name": "plain name", "北京银行 Ltd": "u21271 u20140 u38134 u34892", "(주)한국전력": "ju hangugjeonryeog"}
    df = spark.createDataFrame([(k,) for k in cases], "t string").select("t", T.normalize_text(F.col("t")).alias("n"))
    assert {r["t"]: r["n"] for r in df.collect()} == cases
    assert "Python" not in df._jdf.queryExecution().toString() and "Arrow" not in df._jdf.queryExecution().toString()


def test_metaphone_strips_a_word_once(spark):
    """Not anew for every rule of every letter."""
    words = spark.createDataFrame([("knight",), ("",), (None,), ("42",)], "w string").select(T.metaphone(F.col("w")).alias("code"))
    assert words._jdf.queryExecution().analyzed().toString().count("regexp_replace") == 4
    assert [r["code"] for r in words.collect()] == ["NT", "", None, ""]


def test_inputs_are_spread_by_their_rows(spark, tmp_path):
    """A narrow table of many rows is dealt out by rows, not by its few bytes."""
    from weftlink.operators import fixtures

    data = "/root/testdata/sf0.001"
    spark.read.parquet(f"{data}/nation.parquet").write.parquet(f"{tmp_path}/nation.parquet")
    for table, key in (("customer", "c_custkey"), ("part", "p_partkey")):
        spark.range(12_000).join(spark.read.parquet(f"{data}/{table}.parquet").drop(key).limit(1)).withColumnRenamed("id", key).write.parquet(f"{tmp_path}/{table}.parquet")
    assert fixtures.sources(spark, str(tmp_path))[0].rdd.getNumPartitions() == 3
