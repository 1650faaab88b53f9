from __future__ import annotations

import importlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from weftlink.operators import blocking as B
from weftlink.operators import decide as D
from weftlink.operators import evaluate as E
from weftlink.operators import features as X
from weftlink.operators import model as M
from weftlink.operators import sample as S
from weftlink.sources import tsv

ENTITY = "entity_id string, business_name string, business_address string, country string"


def chosen(rows, k):
    """The same choice, entity by entity: main places, then six names, then the rest."""
    by_score = sorted(rows, key=lambda r: (-r[3], r[0]))
    out = [r[0] for r in by_score[: k - 6]]
    named = [r for r in sorted(rows, key=lambda r: (-r[1], r[0])) if r[1] > 0][:6]
    out += [r[0] for r in named if r[0] not in out]
    out += [r[0] for r in by_score if r[0] not in out]
    return out[:k]


def test_top_candidates_against_lists(spark):
    rng = random.Random(4)
    rows, want = [], {}
    for e in range(60):
        own = [(f"t{i:03d}", float(rng.choice([0, 0, 1, 2, 3])), float(rng.choice([0, 1, 2]))) for i in range(rng.randint(0, 40))]
        full = [(t, n, a, round((n + a) * 3 + n * a if n and a else n * 1.5 if n else a, 9)) for t, n, a in own]
        rows += [(f"s{e}", *r) for r in full]
        want[f"s{e}"] = chosen(full, 10)
    df = spark.createDataFrame(rows, "s1_id string, tgt_id string, name_score double, addr_score double, score double")
    got = {}
    for r in B.top_candidates(df, 10).orderBy("s1_id", "rank").collect():
        got.setdefault(r["s1_id"], []).append(r["tgt_id"])
    assert got == {k: v for k, v in want.items() if v}
    with pytest.raises(ValueError):
        B.BlockingConfig(top_k=5)


def test_address_keys_count_on_the_query_side(spark):
    row = ("x", "Alpha", "Flat 12, 12 MG Road, Near SBI ATM, Bengaluru 560001", "India")
    df = B.prepare(spark.createDataFrame([row], ENTITY))
    count = lambda one, channel: {r["key"]: r["n"] for r in B.keys(df, (channel,), one).groupBy("key").agg(F.count("*").alias("n")).collect()}
    assert count(False, "npc") == {"npc:12_560001": 2, "npc:560001_560001": 1}
    assert count(True, "npc") == {"npc:12_560001": 1, "npc:560001_560001": 1}
    assert set(count(False, "at2")) == {"at2:flat_sbi", "at2:atm_flat", "at2:atm_sbi"}


def test_pruning_and_null_countries(spark):
    targets = spark.createDataFrame([(f"S2-{i}", "common word", "", "US") for i in range(8)] + [("S2-9", "common rare", "", "US"), ("S2-10", "common rare", "", None)], ENTITY)
    source = spark.createDataFrame([("S1-1", "common rare", None, "US"), ("S1-2", "common rare", "", None)], ENTITY)
    config = B.BlockingConfig(channels=("tok",), max_token_freq=5)
    got = B.candidates(source, targets, config)
    assert [(r["s1_id"], r["tgt_id"]) for r in got.collect()] == [("S1-1", "S2-9")]
    lists = {r["source1_entity_id"]: r["candidate_entity_ids"] for r in B.with_empty(source, got).collect()}
    assert lists == {"S1-1": "S2-9", "S1-2": ""}


def test_dual_evidence(spark):
    df = spark.createDataFrame([(2.0, 3.0, 21.0), (2.0, 0.0, 3.0), (0.0, 3.0, 3.0)], "name_score double, addr_score double, want double")
    assert B.dual_evidence(df).where("score <> want").count() == 0


def test_postal_features(spark):
    rows = [("560001", "560001", 1, 1), ("560001", "560099", -1, 1), ("560001", "110001", -1, 0), (None, "110001", 0, 0)]
    df = spark.createDataFrame([(a, b, m, p, "x", "x", ["1"], ["1"], False, False, "", "") for a, b, m, p in rows], "a_postal string, b_postal string, m int, p int, a_name string, b_name string, a_numbers array<string>, b_numbers array<string>, a_is_empty boolean, b_is_empty boolean, a_address string, b_address string")
    assert df.withColumns(X.plain_features()).where("postal_match <> m or postal_prefix_match <> p").count() == 0


def test_lists_rank_like_dataframes(spark):
    rng = random.Random(4)
    words = [f"{a}{b}xy" for a in "abcdef" for b in "ghijkl"]
    rows = lambda p, n: [(f"{p}-{i}", " ".join(rng.choices(words, k=rng.randint(1, 4))), rng.choice(["", f"{rng.randint(1, 9)} {rng.choice(words)} {rng.choice(words)} 5600{rng.randint(10, 15)}"]), rng.choice(["US", "India", None])) for i in range(n)]
    a, b = (B.records(spark.createDataFrame(x, ENTITY)) for x in (rows("S1", 150), rows("S2", 400)))
    config = B.BlockingConfig(top_k=12, channels=B.NO_PHONETICS, max_token_freq=60)
    want = B.top_candidates(B.dual_evidence(B.score_pairs(a, b, config)), 12)
    got, want = (sorted(map(tuple, x.collect())) for x in (B.ranked_candidates(a, b, config), want))
    assert [r[:3] for r in got] == [r[:3] for r in want] and len(got) > 800
    assert [r[3] for r in got] == pytest.approx([r[3] for r in want], abs=2e-9)


def test_numbers_rise_with_ids(spark):
    rows = [(f"S2-{i % 700}", f"name {i}", "", "US") for i in range(1000)] + [(None, "x", "", "US")]
    got = B.records(spark.createDataFrame(rows, ENTITY).repartition(7)).select("entity_id", "uid").collect()
    assert len(got) == 1001 and len({r["uid"] for r in got}) == 701
    by_id = sorted((r for r in got if r["entity_id"]), key=lambda r: r["entity_id"])
    assert [r["uid"] for r in by_id] == sorted(r["uid"] for r in by_id)


def test_a_key_with_half_of_all_probes_is_split(spark):
    """One key in every second record: the result is the same, and no task fetches more of its probes than allowed."""
    source = [(f"S1-{i}", f"{'common' if i % 2 else f'rare{i % 50}'} zz{i % 97}", "", "US") for i in range(4000)]
    target = [(f"S2-{i}", f"{'common' if i % 10 == 0 else f'rare{i % 50}'} yy{i % 97}", "", "US") for i in range(300)]
    source, target = (B.records(spark.createDataFrame(x, ENTITY)) for x in (source, target))
    one, many = B.BlockingConfig(channels=("tok",)), B.BlockingConfig(channels=("tok",), probes_per_task=150)
    want = {tuple(r) for r in B.score_pairs(source, target, one).collect()}
    assert {tuple(r) for r in B.score_pairs(source, target, many).collect()} == want and len(want) > 2000 * 30
    probes = B.salted_probes(B._hashed_keys(source, many.channels, False), many)[0]
    sizes = probes.groupBy("k", "salt").count().toPandas()["count"]
    assert sizes.max() < 2 * 150 and (sizes > 100).sum() >= 10


def test_decisions(spark):
    df = spark.createDataFrame([("a", "x", 1, 0.95), ("a", "y", 2, 0.72), ("a", "z", 3, 0.69)], "s1_id string, tgt_id string, rank int, prob double")
    names = lambda rule: [r["tgt_id"] for r in D.decide(df, rule).orderBy("rank").collect()]
    assert names(D.DecisionRule()) == ["x", "y"]
    assert names(D.DecisionRule(singleton=0.96)) == []
    assert names(D.DecisionRule(cap=1)) == ["x"]


def test_metrics(spark):
    truth = spark.createDataFrame([("a", ["S2-47", "S3-812"]), ("b", []), ("c", []), ("d", ["S2-1"])], "s1_id string, ids array<string>")
    pred = spark.createDataFrame([("a", "S2-47"), ("a", "S2-193"), ("a", "S3-812"), ("c", "S2-5")], "s1_id string, tgt_id string")
    got = {r["s1_id"]: round(r["f05"], 3) for r in E.entity_scores(truth, pred).collect()}
    assert got == {"a": 0.714, "b": 1.0, "c": 0.0, "d": 0.0}
    scored = spark.createDataFrame([(0.9, 1), (0.8, 0), (0.8, 1), (0.1, 0)], "prob double, label int")
    assert E.roc_auc(scored).first()["auc"] == 0.875


def plain_f05(true, pred):
    tp = len(true & pred)
    if not true and not pred:
        return 1.0
    return 1.25 * tp / (len(pred) + 0.25 * len(true)) if tp else 0.0


def test_sweeps_against_brute_force(spark):
    rng = random.Random(8)
    truth, scored = {}, []
    for e in range(120):
        truth[f"e{e}"] = {f"t{k}" for k in rng.sample(range(12), rng.randint(0, 4))}
        for rank in range(1, rng.choice([1, 2, 9, 13])):
            scored.append((f"e{e}" if e % 10 else f"unknown{e}", f"t{rank - 1}", rank, rng.choice([0.4, 0.55, 0.6, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95, rng.random()])))
    t = spark.createDataFrame([(e, sorted(ids)) for e, ids in truth.items()], "s1_id string, ids array<string>")
    df = spark.createDataFrame(scored, "s1_id string, tgt_id string, rank int, prob double").repartition(5)
    ordered: dict = {}
    for s1, tgt, rank, prob in sorted(scored, key=lambda r: (-r[3], r[2])):
        ordered.setdefault(s1, []).append((prob, tgt))

    def macro(keep):
        return round(sum(plain_f05(ids, keep(ordered.get(e, []))) for e, ids in truth.items()) / len(truth), 6)

    got = {(r["match"], r["singleton"], r["cap"]): (r["macro_f05"], r["best"]) for r in E.grid_sweep(t, df).collect()}
    want = {(m, s, c): macro(lambda own: {x for p, x in own[:c] if p >= m} if own and own[0][0] >= s else set()) for m in E.MATCH_GRID for s in E.SINGLETON_GRID for c in E.CAP_GRID}  # noqa: B023
    assert {k: v for k, (v, _) in got.items()} == pytest.approx(want, abs=2e-6)
    assert [k for k, (_, best) in got.items() if best] == [min(want, key=lambda k: (-got[k][0], k))]
    got = {r["threshold"]: r["macro_f05"] for r in E.threshold_sweep(t, df).collect()}
    assert got == pytest.approx({k / 100: macro(lambda own: {x for p, x in own if p >= k / 100}) for k in range(40, 100, 5)}, abs=2e-6)  # noqa: B023


def training_pairs(spark, n=400, noise=0.0):
    rng = random.Random(3)
    rows = []
    for i in range(n):
        y = i % 2
        seen = y if rng.random() >= noise else 1 - y
        rows.append((f"s{i // 4}", f"t{i}", 1 + i % 4, y, *[float(seen) * (j == 0) + rng.random() for j in range(len(X.FEATURE_NAMES))]))
    cols = ["s1_id string", "tgt_id string", "place int", "label int", *[f"{c} float" for c in X.FEATURE_NAMES]]
    return spark.createDataFrame(rows, ", ".join(cols))


def test_training_and_model_files(spark, tmp_path):
    train, valid, test = M.split_groups(training_pairs(spark), 60, 20)
    assert train.join(test, "s1_id").count() == 0
    model = M.train_matcher(train, valid, trees=5)
    tsv.save_model(model, f"{tmp_path}/model")
    scored = M.predict(tsv.load_model(f"{tmp_path}/model"), test)
    assert E.roc_auc(scored).first()["auc"] > 0.9
    gains = M.importances(model)
    nodes = M.tree_nodes(model)
    inner = nodes[nodes["left"] >= 0]
    assert gains[0][0] == "name_ratio" and len(gains) == 20
    assert sum(g for _, g in gains) == pytest.approx((inner["gain"] * inner["weight"]).sum())


def test_boosting_ends_at_the_best_area(spark):
    assert M.best_prefix([0.5, 0.9, 0.8, 0.9, 0.8], 3) == (2, True)  # the area peaks while a loss might still fall
    assert M.best_prefix([0.5, 0.9, 0.8, 0.95, 0.8], 3) == (4, False)
    assert M.best_prefix([None, None], 3) == (0, False)
    train, valid, _ = M.split_groups(training_pairs(spark, 800, 0.35), 50, 40)
    train, valid = train.persist(), valid.persist()
    whole = M.train_matcher(train, None, trees=12)
    aucs = M.prefix_auc(M.prefix_margins(whole, valid))
    assert len(aucs) == 12
    for k in (1, 5, 12):
        scored = M.predict(M.first_trees(whole, k), valid)
        assert E.roc_auc(scored).first()["auc"] == pytest.approx(aucs[k - 1], abs=1e-6)
    cut = M.train_matcher(train, valid, trees=12, patience=2)
    best, _ = M.best_prefix(aucs, 2)
    assert cut.stages[-1].getNumTrees == best
    again = M.predict(cut, valid).select("tgt_id", "prob").collect()
    assert again == M.predict(M.first_trees(whole, best), valid).select("tgt_id", "prob").collect()


def test_samples(spark):
    df = spark.createDataFrame([(f"S1-{i}", "n", "a", "US" if i % 2 else "India") for i in range(10)], ENTITY)
    assert S.first_per_country(df, 2).count() == 4
    links = spark.createDataFrame([("S1-9",)], "tgt_id string")
    assert {r["entity_id"] for r in S.targets_with_distractors(df, links, 2).collect()} == {"S1-9", "S1-0", "S1-1"}


def test_a_left_entitys_lists_are_summed_in_groups_of_many(spark):
    """Neither a Python group for each left entity, nor pairs that are shuffled to look up their ids, nor keys that are made twice."""
    rows = [(f"S{1 + i % 2}-{i}", f"name{i % 40} word{i % 7}", "", "US") for i in range(1200)]
    a, b = (B.records(spark.createDataFrame([r for r in rows if r[0].startswith(p)], ENTITY)) for p in ("S1", "S2"))
    config = B.BlockingConfig(channels=("tok",))
    fetched = B._fetched(a, b, config)
    assert fetched.select("bucket").distinct().count() == 3 and fetched.rdd.getNumPartitions() == 1
    plan = B.score_pairs(a, b, config)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("FlatMapGroupsInArrow") < plan.index("Join") and "transform(" not in plan


def test_any_id_comes_back(spark):
    ids = ["S2-1", "a\nb", "a\\nb", "\\", "\\0", "", None, "é\\\n"]
    a = B.records(spark.createDataFrame([("S1\n1", "rare", "", "US"), (None, "rare", "", "US")], ENTITY))
    b = B.records(spark.createDataFrame([(i, "rare", "", "US") for i in ids], ENTITY))
    got = B.score_pairs(a, b, B.BlockingConfig(channels=("tok",))).collect()
    assert {(r["s1_id"], r["tgt_id"]) for r in got} == {(s, t) for s in ("S1\n1", None) for t in ids} and len(got) == 2 * len(ids)


def test_lists_travel_as_bytes_without_gaps(spark):
    """Targets' numbers lie 2**33 apart between partitions; in lists they take four bytes, and ranks and ids are the same with eight."""
    rows = [(f"S{1 + i % 2}-{i}", f"name{i % 40} word{i % 7}", "", "US") for i in range(1200)]
    a, b = (B.records(spark.createDataFrame([r for r in rows if r[0].startswith(p)], ENTITY)) for p in ("S1", "S2"))
    config = B.BlockingConfig(channels=("tok",))
    step, width = B._step(b)
    uids = {r["uid"] for r in b.select("uid").collect()}
    assert width == 4 and max(uids) > 1 << 33 and step >= 600 // 8
    sizes = set()
    for numbering in ((step, 4), (step, 8), (B.PLACES, 8)):
        found = B._fetched(a, b, config, numbering=numbering)
        lists = [B._numbers([bytes(r["found"])], numbering[1]) for r in found.select("found").distinct().collect()]
        assert all((x[1:] > x[:-1]).all() for x in lists)
        assert {int(n) // numbering[0] * B.PLACES + int(n) % numbering[0] for x in lists for n in x} == uids
        sizes.add(frozenset(map(len, lists)))
    assert len(sizes) == 1
    assert B._step(b.where("false")) == (1, 4)


def test_a_querys_repeated_address_keys_are_rows(spark):
    row = ("x", "Alpha Alpha", "Flat 12, 12 MG Road, Near SBI ATM, Bengaluru 560001", "India")
    df = B.records(spark.createDataFrame([row], ENTITY))
    keys = lambda index: B._hashed_keys(df, ("tok", "npc"), index)
    count = lambda index: {c: sorted(r["n"] for r in keys(index).where(F.col("channel") == c).groupBy("k").agg(F.count("*").alias("n")).collect()) for c in ("tok", "npc")}
    assert count(False) == {"tok": [1], "npc": [1, 2]} and count(True) == {"tok": [1], "npc": [1, 1]}


def test_best_of_runs_against_sorting():
    rng = np.random.default_rng(5)
    for _ in range(60):
        sizes = rng.integers(1, 900, 5)
        begin, top_k = np.cumsum(sizes) - sizes, int(rng.integers(6, 30))
        score = np.round(rng.random(sizes.sum()), int(rng.integers(0, 4)))
        name = np.round(rng.random(len(score)), 1) * (rng.random(len(score)) < 0.5)
        at, run, rank = B._chosen(name, score, begin, top_k)
        for r, (b, n) in enumerate(zip(begin.tolist(), sizes.tolist(), strict=True)):
            want = chosen([(i, name[i], 0.0, score[i]) for i in range(b, b + n)], top_k)
            assert at[run == r].tolist() == want and rank[run == r].tolist() == list(range(1, len(want) + 1))


def test_six_digits_like_round(spark):
    df = spark.range(0, 40000).select((F.col("id") * 0.000123457 + F.lit(0.0)).alias("x"), F.lit(0.0).alias("y")).select(F.round("x", 9).alias("x"), "y")
    six = importlib.import_module("weftlink.plans.queries")._six_digits
    assert df.where((F.abs(six("x") - F.round("x", 6)) > 1.1e-6) | (six("y") != 0)).count() == 0
    assert df.where((six("x") != F.round("x", 6)) & (F.pmod(F.round(F.col("x") * 1e9), F.lit(1000)) != 500)).count() == 0
