"""One query for each operator, over linkage inputs made from the driver's tables.

List results are joined strings and doubles are rounded, so that SQL can state the same rows. Where a query needs
probabilities, a fixed blend of plain features stands in for the trained model.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftlink.functions import text as T
from weftlink.operators import blocking as B
from weftlink.operators import decide as D
from weftlink.operators import evaluate as E
from weftlink.operators import features as X
from weftlink.operators import fixtures
from weftlink.operators import model as M
from weftlink.operators import sample as S
from weftlink.operators import validate as V
from weftlink.sources.tables import written
from weftlink.sources.tsv import ids_of, parse_id_lists

PLAIN = B.BlockingConfig(channels=B.NO_PHONETICS)
Query = Callable[[SparkSession, str], DataFrame]
_REGISTRY: dict[str, Query] = {}


def _query(f: Query) -> Query:
    _REGISTRY[f.__name__] = f
    return f


def _all(spark: SparkSession, d: str) -> DataFrame:
    s1, s2, s3 = fixtures.sources(spark, d)
    return s1.unionByName(s2).unionByName(s3)


def _join(c: str, sep: str = "|"):
    return F.array_join(c, sep)


# --- relational ---------------------------------------------------------------------------------


@_query
def filter_country(spark, d):
    return _all(spark, d).where(F.col("country") == "India").select("entity_id", "business_name")


@_query
def union_targets(spark, d):
    return fixtures.targets(spark, d)


@_query
def semi_join(spark, d):
    s1, s2, _ = fixtures.sources(spark, d)
    links = E.truth_pairs(_truth(spark, d))
    return s2.join(links.select(F.col("tgt_id").alias("entity_id")), "entity_id", "left_semi")


@_query
def limit_per_order(spark, d):
    return fixtures.targets(spark, d).orderBy("entity_id").limit(100)


@_query
def distinct_entities(spark, d):
    t = fixtures.targets(spark, d)
    return S.one_per_entity(t.unionByName(t.withColumn("business_name", F.upper("business_name")))).select("entity_id", "business_name")


@_query
def distinct_countries(spark, d):
    return _all(spark, d).select("country").distinct()


@_query
def explode_links(spark, d):
    return E.truth_pairs(_truth(spark, d))


@_query
def singleton_flags(spark, d):
    return _truth(spark, d).select("s1_id", (F.size("ids") == 0).alias("is_singleton"))


@_query
def id_lines(spark, d):
    lines = spark.read.parquet(f"{d}/conversations.parquet").select(F.concat_ws("\t", F.concat(F.lit(" c"), "conv_id"), "role", F.col("turn").cast("string")).alias("value"))
    return ids_of(lines)


# --- text ---------------------------------------------------------------------------------------


@_query
def normalize_name(spark, d):
    return _all(spark, d).select("entity_id", T.normalize_text(F.col("business_name")).alias("clean"))


@_query
def normalize_documents(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", T.normalize_text(F.col("text")).alias("clean"))


@_query
def fold_acronyms(spark, d):
    return _all(spark, d).select("entity_id", T.fold_acronyms(F.lower("business_name")).alias("folded"))


@_query
def strip_domains(spark, d):
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", T.strip_domains(F.lower("url")).alias("bare"))


@_query
def collapse_letters(spark, d):
    return spark.read.parquet(f"{d}/part.parquet").select("p_partkey", T.collapse_letters(F.lower("p_name")).alias("collapsed"))


@_query
def token_sorted_name(spark, d):
    return _prepared(spark, d).select("entity_id", T.token_sorted(F.col("name")).alias("sorted_name"))


@_query
def compressed_name(spark, d):
    return _prepared(spark, d).select("entity_id", T.compressed(F.col("name")).alias("fused"))


@_query
def name_tokens(spark, d):
    return _prepared(spark, d).select("entity_id", _join("tokens").alias("tokens"))


@_query
def prefix_shingles(spark, d):
    return _prepared(spark, d).select("entity_id", F.array_join(F.array_sort(F.array_union(T.prefix_shingles(F.col("tokens")), T.compressed_shingles(F.col("name")))), "|").alias("shingles"))


@_query
def soundex_keys(spark, d):
    return _prepared(spark, d).select("entity_id", F.array_join(T.soundex_keys(F.col("tokens")), "|").alias("keys"))


@_query
def metaphone_keys(spark, d):
    return _prepared(spark, d).select("entity_id", F.array_join(F.transform("tokens", T.metaphone), "|").alias("keys"))


@_query
def transliterate(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", T.any_ascii(F.col("text")).alias("ascii_text"))


@_query
def address_anchors(spark, d):
    a = T.address_anchors(F.col("business_address"))
    return _all(spark, d).select("entity_id", a.alias("a")).select("entity_id", F.array_join("a.numbers", "|").alias("numbers"), "a.postal_code", F.array_join("a.clean_address_tokens", "|").alias("words"), "a.is_empty")


@_query
def compound_numbers(spark, d):
    return _all(spark, d).select("entity_id", F.array_join(T.compound_numbers(F.col("business_address")), "|").alias("compounds"))


# --- blocking -----------------------------------------------------------------------------------


def _prepared(spark, d):
    return B.prepare(_all(spark, d))


@_query
def key_frequencies(spark, d):
    index = B.keys(B.prepare(fixtures.targets(spark, d)), PLAIN.channels, True)
    return B.key_frequencies(index).where(F.col("n") <= B.cutoff(PLAIN))


def _six_digits(c: str):
    """round(c, 6) of a number that is not negative and has nine digits at most, without a decimal for each of very many rows."""
    return F.floor(F.col(c) * 1e6 + 0.5) / 1e6


def _channel(channel: str) -> Query:
    def run(spark, d):
        s1, _, _ = fixtures.sources(spark, d)
        config = B.BlockingConfig(channels=(channel,))
        phonetic = channel in ("ph", "pn")
        scored = B.score_pairs(B.records(s1, phonetic), B.records(fixtures.targets(spark, d), phonetic), config)
        return scored.select("s1_id", "tgt_id", *[_six_digits(c).alias(c) for c in ("name_score", "addr_score")])

    return run


for _c in B.CHANNELS:
    _REGISTRY[f"score_channel_{_c}"] = _channel(_c)


def _records(spark, d):
    """Both sides, prepared, numbered and written."""
    s1, _, _ = fixtures.sources(spark, d)
    return B.records(s1), B.records(fixtures.targets(spark, d))


@_query
def dual_evidence(spark, d):
    return B.dual_evidence(B.score_pairs(*_records(spark, d), PLAIN)).select("s1_id", "tgt_id", F.round("score", 5).alias("score"))


def _ranked(spark, d):
    return B.ranked_candidates(*_records(spark, d), PLAIN)


@_query
def topk_candidates(spark, d):
    return _ranked(spark, d).select("s1_id", "tgt_id", "rank", F.round("score", 5).alias("score"))


@_query
def candidate_lists(spark, d):
    s1, _, _ = fixtures.sources(spark, d)
    return B.with_empty(s1, _ranked(spark, d))


@_query
def candidates_with_phonetics(spark, d):
    s1, _, _ = fixtures.sources(spark, d)
    return B.candidates(s1, fixtures.targets(spark, d)).select("s1_id", "tgt_id", "rank", F.round("score", 5).alias("score"))


# --- features and model -------------------------------------------------------------------------


def _paired(spark, d):
    records = _records(spark, d)
    return X.pair_records(B.ranked_candidates(*records, PLAIN), *records)


@_query
def plain_features(spark, d):
    return _paired(spark, d).withColumns(X.plain_features(True)).select("s1_id", "tgt_id", "rank", *[F.round(c, 6).alias(c) for c in X.plain_features()])


@_query
def jaro_winkler_features(spark, d):
    p = _paired(spark, d)
    f = X.kernel_features()
    return p.select("s1_id", "tgt_id", F.round(f["name_jaro_winkler"], 6).alias("name_jaro_winkler"), F.round(f["addr_jaro_winkler"], 6).alias("addr_jaro_winkler"))


@_query
def pair_features(spark, d):
    return X.pair_features(_paired(spark, d))


@_query
def labelled_pairs(spark, d):
    return M.label_pairs(_ranked(spark, d), E.truth_pairs(_truth(spark, d))).select("s1_id", "tgt_id", "rank", "label")


@_query
def sample_counts(spark, d):
    return E.sample_counts(labelled_pairs(spark, d))


@_query
def group_split(spark, d):
    parts = M.split_groups(labelled_pairs(spark, d), 60, 20)
    out = parts[0].withColumn("part", F.lit("train"))
    for name, p in zip(("valid", "test"), parts[1:], strict=True):
        out = out.unionByName(p.withColumn("part", F.lit(name)))
    return out.groupBy("part").agg(F.count("*").alias("n"), F.countDistinct("s1_id").alias("n_groups"))


@_query
def trained_matches(spark, d):
    """Training on one part of the entities, matches of the rest."""
    records = _records(spark, d)
    labelled = M.label_pairs(B.ranked_candidates(*records, PLAIN), E.truth_pairs(_truth(spark, d)))
    features = written(X.pair_features(X.pair_records(labelled, *records)), "features")
    train, valid, test = M.split_groups(features, 60, 20)
    scored = M.predict(M.train_matcher(train, valid), test)
    return D.decide(scored).select("s1_id", "tgt_id", F.round("prob", 6).alias("prob"), "rank")


# --- decisions and evaluation -------------------------------------------------------------------


def _truth(spark, d):
    return parse_id_lists(fixtures.ground_truth(spark, d), "source1_entity_id", "matched_entity_ids")


def _probabilities(spark, d):
    """(s1_id, tgt_id, rank, prob): a blend that SQL can state."""
    p = _paired(spark, d).withColumns(X.plain_features(True))
    blend = 0.1 + F.col("shared_token_count") * 0.12 + F.col("first_token_match") * 0.1 + F.col("name_exact_match") * 0.2 + F.col("postal_match") * 0.1 + F.col("addr_num_jaccard") * 0.2 - F.col("rank") * 0.01
    return p.select("s1_id", "tgt_id", "rank", F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), blend)), 6).alias("prob"))


@_query
def threshold_matches(spark, d):
    return D.above(_probabilities(spark, d), 0.70)


@_query
def decide_matches(spark, d):
    return D.decide(_probabilities(spark, d), D.DecisionRule(match=0.55, singleton=0.6, cap=2))


@_query
def decide_by_default(spark, d):
    """The default rule: 0.70 for a match, 0.60 for any, at most 8."""
    return D.decide(_probabilities(spark, d))


@_query
def match_lists(spark, d):
    s1, _, _ = fixtures.sources(spark, d)
    return B.with_empty(s1, decide_matches(spark, d), "matched_entity_ids")


@_query
def entity_scores(spark, d):
    return E.entity_scores(_truth(spark, d), decide_matches(spark, d)).withColumn("f05", F.round("f05", 6))


@_query
def macro_f05(spark, d):
    return E.macro_f05(_truth(spark, d), decide_matches(spark, d))


@_query
def candidate_recall(spark, d):
    return E.candidate_recall(_truth(spark, d), _ranked(spark, d), _truth(spark, d).select("s1_id"))


@_query
def country_recall(spark, d):
    s1, _, _ = fixtures.sources(spark, d)
    return E.country_recall(_truth(spark, d), _ranked(spark, d), s1)


@_query
def roc_auc(spark, d):
    labelled = M.label_pairs(_probabilities(spark, d), E.truth_pairs(_truth(spark, d)))
    return E.roc_auc(labelled)


@_query
def threshold_sweep(spark, d):
    return E.threshold_sweep(_truth(spark, d), _probabilities(spark, d))


@_query
def grid_sweep(spark, d):
    return E.grid_sweep(_truth(spark, d), _probabilities(spark, d))


# --- validation and sampling --------------------------------------------------------------------


def _faulty_rows(spark, d):
    """Match rows with faults put in by rule: a doubled row, a repeated id, a self match, a bad prefix, an unknown id."""
    t = fixtures.ground_truth(spark, d)
    k = F.substring_index("source1_entity_id", "-", -1).cast("long")
    extra = F.when(k % 50 == 1, F.concat(F.lit(",S2-"), k)).when(k % 50 == 2, F.lit(",S1-7")).when(k % 50 == 3, F.lit(",X9")).when(k % 50 == 4, F.lit(",")).when(k % 50 == 5, F.lit(",S3-999999999")).otherwise(F.lit(""))
    ids = F.concat("matched_entity_ids", extra)
    once = t.where(k % 41 != 40).select(k.alias("line"), F.when(k % 43 == 0, F.concat("source1_entity_id", F.lit("x"))).otherwise(F.col("source1_entity_id")).alias("s1"), F.when(F.trim(ids) == "", F.array().cast("array<string>")).otherwise(F.split(ids, ",")).alias("ids"))
    return once.unionByName(once.where("line % 47 = 1").withColumn("line", F.col("line") + 1_000_000_000).withColumn("ids", F.array(F.lit("S2-1"))))


def _candidate_rows(spark, d):
    return fixtures.ground_truth(spark, d).select(F.lit(1).alias("line"), F.col("source1_entity_id").alias("s1"), F.split("matched_entity_ids", ",").alias("ids"))


@_query
def validator_duplicate_rows(spark, d):
    return V.duplicate_rows(_faulty_rows(spark, d))


@_query
def validator_repeated_ids(spark, d):
    return V.repeated_ids(_faulty_rows(spark, d))


@_query
def validator_self_matches(spark, d):
    return V.self_matches(_faulty_rows(spark, d))


@_query
def validator_wrong_prefixes(spark, d):
    return V.wrong_prefixes(_faulty_rows(spark, d))


@_query
def validator_unknown_ids(spark, d):
    return V.unknown_ids(_faulty_rows(spark, d), fixtures.targets(spark, d))


@_query
def validator_missing_rows(spark, d):
    return V.missing_rows(_faulty_rows(spark, d), fixtures.sources(spark, d)[0])


@_query
def validator_extra_rows(spark, d):
    return V.extra_rows(_faulty_rows(spark, d), fixtures.sources(spark, d)[0])


@_query
def validator_outside_candidates(spark, d):
    return V.outside_candidates(_faulty_rows(spark, d), _candidate_rows(spark, d))


@_query
def validator_findings(spark, d):
    """All rules over both lists at once."""
    sent = {"matching": V.row_messages(_faulty_rows(spark, d), "matching"), "candidate": V.row_messages(_candidate_rows(spark, d), "candidate")}
    return V.summary(V.offences(sent, fixtures.sources(spark, d)[0], fixtures.targets(spark, d))).withColumn("examples", _join("examples"))


@_query
def validator_counts(spark, d):
    return V.counts(_faulty_rows(spark, d))


@_query
def validation_sample(spark, d):
    s1, _, _ = fixtures.sources(spark, d)
    return S.first_per_country(s1, 120, ("US", "India"))


@_query
def sampled_truth(spark, d):
    return S.truth_of(fixtures.ground_truth(spark, d), validation_sample(spark, d))


@_query
def sampled_targets(spark, d):
    links = E.truth_pairs(parse_id_lists(sampled_truth(spark, d), "source1_entity_id", "matched_entity_ids"))
    return S.targets_with_distractors(fixtures.targets(spark, d), links, 200)


def entry_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_candidates(spark, sf_dir)


def queries() -> dict[str, Query]:
    return dict(_REGISTRY)
