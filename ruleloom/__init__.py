"""Bagged associative classification of categorical tables as Spark DataFrame plans."""

from ruleloom.plans.estimator import RuleEstimator, RuleModel

__all__ = ["RuleEstimator", "RuleModel"]
