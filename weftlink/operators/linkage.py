"""Whole runs: training with tuning of the decision rule, and inference into the two result files."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftlink.operators.blocking import BlockingConfig, ranked_candidates, records, with_empty
from weftlink.operators.decide import DecisionRule, decide, within_candidates
from weftlink.operators.evaluate import candidate_recall, grid_sweep, roc_auc, truth_pairs
from weftlink.operators.features import pair_features, pair_records
from weftlink.operators.model import importances, label_pairs, predict, split_groups, train_matcher
from weftlink.sources.tables import Stage, written
from weftlink.sources.tsv import load_model, save_model, write_tsv_file

MATCHES, CANDIDATES = "matching_results.tsv", "candidate_pairs.tsv"


@dataclass(frozen=True)
class Report:
    """What a training run found on the groups it did not learn from; importances are total gains, stages the tables written on the way."""

    recall_pct: float
    auc: float
    macro_f05: float
    rule: DecisionRule
    importances: list[tuple[str, float]]
    stages: list[Stage]


def _records(source1: DataFrame, targets: DataFrame, config: BlockingConfig, stages: list[Stage] | None = None) -> tuple[DataFrame, DataFrame]:
    phonetic = bool({"ph", "pn"} & set(config.channels))
    return records(source1, phonetic, stages=stages), records(targets, phonetic, stages=stages)


def train(source1: DataFrame, targets: DataFrame, truth: DataFrame, path: str, config: BlockingConfig = BlockingConfig(), trees: int = 400, split: tuple[int, int] = (60, 20)) -> Report:
    """Candidates of the left entities with truth (s1_id, ids), a model of one part of them saved at path, and the best cell of the rule's grid on the last part."""
    stages: list[Stage] = []
    searched = source1.join(truth.select(F.col("s1_id").alias("entity_id")), "entity_id", "left_semi")
    queries, index = _records(searched, targets, config, stages)
    ranked = ranked_candidates(queries, index, config, stages)
    features = written(pair_features(pair_records(label_pairs(ranked, truth_pairs(truth)), queries, index)), "features", stages)
    learn, valid, test = split_groups(features, *split)
    began = time.perf_counter()
    model = train_matcher(learn, valid, trees)
    save_model(model, path)
    stages.append(Stage("model", model.stages[-1].getNumTrees, round(time.perf_counter() - began, 3)))
    scored = written(predict(model, test), "scored", stages)
    best = grid_sweep(split_groups(truth, *split)[2], scored).where("best").first()
    recall = candidate_recall(truth, ranked, truth).first()["recall_pct"]
    return Report(recall, roc_auc(scored).first()["auc"], best["macro_f05"], DecisionRule(best["match"], best["singleton"], best["cap"]), importances(model), stages)


def generate(source1: DataFrame, targets: DataFrame, model: PipelineModel | str, folder: str, config: BlockingConfig = BlockingConfig(), rule: DecisionRule = DecisionRule()) -> list[Stage]:
    """Writes the candidates and the matches of every left entity, each as one tab-separated file with a header; matches are candidates always."""
    if isinstance(model, str):
        model = load_model(model)
    stages: list[Stage] = []
    queries, index = _records(source1, targets, config, stages)
    ranked = ranked_candidates(queries, index, config, stages)
    matches = decide(predict(model, pair_features(pair_records(ranked, queries, index))), rule)
    matches = written(within_candidates(matches, ranked), "matches", stages)
    write_tsv_file(with_empty(source1, ranked), f"{folder}/{CANDIDATES}", "source1_entity_id")
    write_tsv_file(with_empty(source1, matches, "matched_entity_ids"), f"{folder}/{MATCHES}", "source1_entity_id")
    return stages
