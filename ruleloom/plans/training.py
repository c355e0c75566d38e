"""Train all bags of an ensemble in one plan: sample, mine, cover."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ruleloom.operators.coverage import cover
from ruleloom.operators.gain import mine_gain
from ruleloom.operators.items import bag_totals, compact, label_counts
from ruleloom.operators.sampling import bag_by_partition, bag_sample, check_bagging
from ruleloom.operators.support import mine_support
from ruleloom.staging import spread, stage, stage_observed


@dataclass(frozen=True)
class TrainingSettings:
    num_models: int = 100
    sample_size: float = 0.01
    min_support: float = 0.2
    min_confidence: float = 0.5
    min_chi2: float = 3.841
    strategy: str = "support"
    min_info_gain: float = 0.0
    rules_max_len: int = 10
    with_coverage: bool = True
    save_spare: bool = True
    with_shuffling: bool = True
    with_replacement: bool = True
    filter_singletons: bool = False
    seed: int = 0

    def check(self) -> None:
        check_bagging(self.strategy, self.num_models, self.with_shuffling, self.with_replacement)


def draw_bags(tx: DataFrame, settings: TrainingSettings) -> DataFrame:
    settings.check()
    if settings.with_shuffling:
        return bag_sample(
            tx, settings.num_models, settings.sample_size, settings.with_replacement, settings.seed
        )
    return bag_by_partition(tx, settings.num_models, settings.sample_size, settings.seed)


def mine(bagged: DataFrame, settings: TrainingSettings, counts: DataFrame | None = None) -> DataFrame:
    if settings.strategy == "gain":
        return mine_gain(
            bagged,
            settings.min_support,
            settings.min_confidence,
            settings.min_chi2,
            settings.min_info_gain,
            counts=counts,
        )
    return mine_support(
        bagged,
        settings.min_support,
        settings.min_confidence,
        settings.min_chi2,
        settings.rules_max_len,
        settings.filter_singletons,
        counts=counts,
    )


def training_input(bagged: DataFrame) -> DataFrame:
    """The compacted sample, staged: training reads it several times, and the bags must not change in between."""
    table, seen = stage_observed(compact(bagged), "bags")
    return spread(table, seen["rows"])


def train_bags(bagged: DataFrame, settings: TrainingSettings) -> tuple[DataFrame, DataFrame]:
    """(rules, bags) of transactions that already carry a bag_id. `bags` has bag_id, n_total, default_class, classes."""
    settings.check()
    sample = training_input(bagged)
    counts = stage(label_counts(sample), "label-counts")
    rules = mine(sample, settings, counts)
    if settings.with_coverage:
        rules = cover(rules, sample, settings.save_spare)
    bags = bag_totals(counts).drop("squares")
    return stage(rules, "model-rules"), stage(bags, "model-bags")


def train_ensemble(tx: DataFrame, settings: TrainingSettings) -> tuple[DataFrame, DataFrame]:
    """Sample `tx` into bags and train them all."""
    return train_bags(draw_bags(tx, settings), settings)
