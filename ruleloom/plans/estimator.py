"""The classifier as a pyspark.ml estimator: fit mines the bags, transform classifies, models are parquet tables."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ruleloom.operators.coverage import cover
from ruleloom.operators.merge import merge_rules
from ruleloom.operators.rules import model_stats, rules_text, write_text
from ruleloom.operators.scoring import (
    VoteSettings,
    ensemble_default,
    ensemble_majority,
    ensemble_predict,
    ensemble_proba,
    ensemble_weighted,
    first_match,
    probabilities,
    uniform_proba,
    vote_predict,
)
from ruleloom.plans.training import TrainingSettings, train_ensemble

_TRAINING = {
    "numModels": ("num_models", TypeConverters.toInt, "bags, each giving one model"),
    "sampleSize": ("sample_size", TypeConverters.toFloat, "share of the data in one bag"),
    "minSupport": ("min_support", TypeConverters.toFloat, "least share of a bag with antecedent and class"),
    "minConfidence": ("min_confidence", TypeConverters.toFloat, "least confidence of a rule"),
    "minChi2": ("min_chi2", TypeConverters.toFloat, "least chi-square of a rule"),
    "strategy": ("strategy", TypeConverters.toString, "support or gain"),
    "minInfoGain": ("min_info_gain", TypeConverters.toFloat, "gain a tree node must exceed"),
    "rulesMaxLen": ("rules_max_len", TypeConverters.toInt, "longest antecedent of the support strategy"),
    "withCoverage": ("with_coverage", TypeConverters.toBoolean, "prune rules by coverage of their bag"),
    "saveSpare": ("save_spare", TypeConverters.toBoolean, "keep spare rules as level 2"),
    "withShuffling": ("with_shuffling", TypeConverters.toBoolean, "deal records at random instead of by partition"),
    "withReplacement": ("with_replacement", TypeConverters.toBoolean, "sample with replacement"),
    "filterSingletons": ("filter_singletons", TypeConverters.toBoolean, "hold one-item rules to the bounds too"),
    "seed": ("seed", TypeConverters.toInt, "seed of all draws"),
}


class _RuleParams(Params):
    def __init__(self) -> None:
        super().__init__()
        defaults = TrainingSettings()
        for name, (field, converter, doc) in _TRAINING.items():
            self._declare(name, doc, converter, getattr(defaults, field))
        self._declare("idCol", "record id column", TypeConverters.toString, "rec_id")
        self._declare("itemsCol", "item array column", TypeConverters.toString, "items")
        self._declare("labelCol", "class column", TypeConverters.toString, "label")
        self._declare("withWeight", "bags vote by probability instead of first match", TypeConverters.toBoolean, False)
        self._declare("classes", "all classes in order; empty: those in the bags, sorted", TypeConverters.toList, [])
        self._declare("preferredClass", "list of at most one class predicted by default", TypeConverters.toList, [])
        self._declare("preferredProba", "default probabilities in class order", TypeConverters.toListFloat, [])

    def _declare(self, name, doc, converter, default) -> None:
        setattr(self, name, Param(self, name, doc, converter))
        self._setDefault(**{name: default})

    def value(self, name: str):
        return self.getOrDefault(getattr(self, name))

    def settings(self) -> TrainingSettings:
        return TrainingSettings(**{field: self.value(name) for name, (field, _, _) in _TRAINING.items()})

    def _columns(self, df: DataFrame, *names: str) -> DataFrame:
        wanted = {"rec_id": "idCol", "items": "itemsCol", "label": "labelCol"}
        return df.select(*[F.col(self.value(wanted[n])).alias(n) for n in names])


class RuleEstimator(Estimator, _RuleParams):
    """Mines an ensemble of associative classifiers from (id, items, label) records."""

    @keyword_only
    def __init__(self, **kwargs) -> None:
        super().__init__()
        _RuleParams.__init__(self)
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> RuleModel:
        tx = self._columns(dataset, "rec_id", "items", "label")
        rules, bags = train_ensemble(tx, self.settings())
        classes = self.value("classes")
        if not classes:
            seen = bags.select(F.explode("classes").alias("c")).distinct().collect()
            classes = sorted(r["c"] for r in seen)
        model = RuleModel(rules, bags, classes)
        self._copyValues(model)
        return model


class _ModelWriter(MLWriter):
    """Metadata with the parameters, as other pyspark.ml stages have it, and two parquet tables."""

    def __init__(self, model: RuleModel) -> None:
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        spark = self.model.rules.sparkSession
        DefaultParamsWriter.saveMetadata(self.model, path, spark, extraMetadata={"classes": self.model.class_list})
        self.model.rules.write.parquet(f"{path}/rules")
        self.model.bags.write.parquet(f"{path}/bags")


class _ModelReader(MLReader):
    def load(self, path: str) -> RuleModel:
        spark = SparkSession.active()
        metadata = DefaultParamsReader.loadMetadata(path, spark)
        model = RuleModel(spark.read.parquet(f"{path}/rules"), spark.read.parquet(f"{path}/bags"), metadata["classes"])
        model._resetUid(metadata["uid"])
        model._set(**metadata["paramMap"])
        return model


class RuleModel(Model, _RuleParams, MLWritable, MLReadable):
    """Rule tables of all bags: `rules`, and `bags` with each bag's size and default class."""

    def __init__(self, rules: DataFrame, bags: DataFrame, classes: list) -> None:
        super().__init__()
        _RuleParams.__init__(self)
        self.rules, self.bags, self.class_list = rules, bags, list(classes)

    @property
    def default_class(self):
        preferred = self.value("preferredClass")
        return ensemble_default(self.bags, preferred[0] if preferred else None)

    @property
    def default_proba(self) -> list[float]:
        return self.value("preferredProba") or uniform_proba(self.class_list)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        """Adds `prediction` by majority of the bags to every row, whatever its id: item sets are scored and joined back once."""
        rows = dataset.select(F.struct("*").alias("_row"), F.col(self.value("itemsCol")).alias("items"))
        return self._predict(rows, ("_row",)).select("_row.*", "prediction")

    def predict(self, dataset: DataFrame) -> DataFrame:
        """(rec_id, prediction) by majority of the bags; without a match in any bag, the default class."""
        return self._predict(self._columns(dataset, "rec_id", "items"))

    def _predict(self, tx: DataFrame, id_cols: Sequence[str] = ("rec_id",)) -> DataFrame:
        if self.value("withWeight"):
            return ensemble_weighted(
                tx, self.rules, self.bags.count(), self.class_list, default_proba=self.default_proba, id_cols=id_cols
            )
        return ensemble_predict(tx, self.rules, self.class_list, self.default_class, id_cols)

    def predict_majority(self, dataset: DataFrame) -> DataFrame:
        """Like `predict`, but a bag without a match votes for its own default class."""
        tx = self._columns(dataset, "rec_id", "items")
        return ensemble_majority(tx, self.rules, self.bags, self.class_list)

    def predict_proba(self, dataset: DataFrame, settings: VoteSettings | None = None) -> DataFrame:
        tx = self._columns(dataset, "rec_id", "items")
        return ensemble_proba(tx, self.rules, self.bags.count(), self.class_list, settings, self.default_proba)

    def covered_on(self, dataset: DataFrame, save_spare: bool = True) -> RuleModel:
        """All bags pruned by coverage of one common data set."""
        rules = cover(self.rules, self._columns(dataset, "items", "label"), save_spare, shared=True)
        return self.copy_with(rules)

    def copy_with(self, rules: DataFrame) -> RuleModel:
        model = RuleModel(rules, self.bags, self.class_list)
        self._copyValues(model)
        return model

    def light(self, method: str = "max") -> LightModel:
        first = self.bags.agg(F.min_by("default_class", "bag_id").alias("c")).first()["c"]
        return LightModel(merge_rules(self.rules, method), self.class_list, first, self.default_proba)

    def stats(self) -> DataFrame:
        return model_stats(self.rules, self.bags)

    def text(self) -> DataFrame:
        return rules_text(self.rules)

    def write_text(self, path: str) -> None:
        write_text(self.rules, path)

    def write(self) -> MLWriter:
        return _ModelWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _ModelReader()

    @classmethod
    def load(cls, *where) -> RuleModel:
        """load(path), as pipelines do, or load(spark, path)."""
        return cls.read().load(where[-1])


class LightModel:
    """One rule table for scoring by votes or first match."""

    def __init__(self, rules: DataFrame, classes: list, default_class, default_proba: list[float]) -> None:
        self.rules, self.classes = rules, list(classes)
        self.default_class, self.default_proba = default_class, list(default_proba)

    def predict_proba(self, tx: DataFrame, settings: VoteSettings | None = None) -> DataFrame:
        return probabilities(tx, self.rules, self.classes, settings, self.default_proba)

    def predict(self, tx: DataFrame, with_voting: bool = True, settings: VoteSettings | None = None) -> DataFrame:
        if with_voting:
            return vote_predict(self.predict_proba(tx, settings), self.classes)
        return first_match(tx, self.rules, self.classes, self.default_class)

    def covered_on(self, tx: DataFrame, save_spare: bool = True) -> LightModel:
        rules = cover(self.rules, tx, save_spare, shared=True)
        return LightModel(rules, self.classes, self.default_class, self.default_proba)

    def stats(self) -> DataFrame:
        """Rules, antecedent items and mean antecedent length per level."""
        return model_stats(self.rules, self.rules.sparkSession.createDataFrame([(0,)], "bag_id int"))

    def text(self) -> DataFrame:
        return rules_text(self.rules)

    def write_text(self, path: str) -> None:
        write_text(self.rules, path)

    def save(self, path: str) -> None:
        self.rules.write.parquet(f"{path}/rules")
        record = json.dumps({"classes": self.classes, "default_class": self.default_class, "default_proba": self.default_proba})
        self.rules.sparkSession.createDataFrame([(record,)], "value string").coalesce(1).write.text(f"{path}/settings")

    @staticmethod
    def load(spark: SparkSession, path: str) -> LightModel:
        record = json.loads(spark.read.text(f"{path}/settings").first()["value"])
        return LightModel(spark.read.parquet(f"{path}/rules"), record["classes"], record["default_class"], record["default_proba"])
