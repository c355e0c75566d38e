"""Cross-validate on a text file of discretised records, class last.

    python -m ruleloom.plans.cli multi   FILE NUM_MODELS SAMPLE_SIZE MIN_SUPPORT [--out DIR]
    python -m ruleloom.plans.cli binary  FILE NUM_MODELS SAMPLE_SIZE MIN_SUPPORT [--out DIR]

`multi` reports the confusion matrix over ten folds, accuracy and rule counts of the support strategy; `binary` reports
a grid of over- and undersampling and votes of the gain strategy, with model sizes, and the ROC points of every fold. With --out the reports are also written as CSV.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ruleloom.operators.evaluate import confusion, cv_confusion
from ruleloom.operators.sampling import balancing_fractions
from ruleloom.plans import crossval
from ruleloom.plans.training import TrainingSettings
from ruleloom.sources import text
from ruleloom.staging import stage


def read_transactions(spark: SparkSession, path: str, separator: str = ",") -> tuple[DataFrame, int]:
    """Encoded transactions of a text file and the number of classes. Records are numbered by file and line order."""
    records = stage(
        text.parse_records(text.read_lines(spark, path), separator).withColumn(
            "rec_id", F.monotonically_increasing_id()
        ),
        "records",
    )
    dictionary = stage(text.build_dictionary(records), "dictionary")
    encoded = stage(text.encode(records, dictionary), "encoded")
    k = text.class_count(encoded, dictionary)
    return text.to_transactions(encoded, k), k


def multi_class(tx: DataFrame, num_classes: int, settings: TrainingSettings, k: int = 10) -> dict[str, DataFrame]:
    rules, bags = crossval.train_folds(tx, settings, k)
    predictions = stage(crossval.predict_folds(tx, rules, bags, list(range(num_classes)), k), "predictions")
    return {
        "confusion": cv_confusion(confusion(predictions, ["fold"])),
        "summary": crossval.cv_summary(crossval.fold_measures(predictions, rules)),
    }


def binary(
    tx: DataFrame, settings: TrainingSettings, k: int = 10, preferred_proba: list[float] | None = None
) -> dict[str, DataFrame]:
    counts, _ = crossval.class_shares(tx, [0, 1])
    samplings = {f"{mode}sampling": balancing_fractions(counts, mode) for mode in ("over", "under")}
    return crossval.binary_reports(tx, settings, samplings, k=k, default_proba=preferred_proba)


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("task", choices=["multi", "binary"])
    parser.add_argument("file")
    parser.add_argument("num_models", type=int)
    parser.add_argument("sample_size", type=float)
    parser.add_argument("min_support", type=float)
    parser.add_argument("--folds", type=int, default=10)
    parser.add_argument("--separator", default=",")
    parser.add_argument("--no-shuffling", action="store_true", help="binary: bags from neighbouring partitions of the file")
    parser.add_argument("--preferred-proba", type=float, nargs=2, help="binary: class probabilities where no rule votes")
    parser.add_argument("--out")
    a = parser.parse_args(arguments)
    spark = SparkSession.builder.appName("ruleloom").getOrCreate()
    tx, classes = read_transactions(spark, a.file, a.separator)
    common = {"num_models": a.num_models, "sample_size": a.sample_size, "min_support": a.min_support}
    if a.task == "multi":
        reports = multi_class(tx, classes, TrainingSettings(**common), a.folds)
    else:
        gain = TrainingSettings(strategy="gain", with_coverage=False, with_replacement=False, save_spare=False,
                                with_shuffling=not a.no_shuffling, **common)
        reports = binary(tx, gain, a.folds, a.preferred_proba)
    for name, report in reports.items():
        report.show(200, truncate=False)
        if a.out:
            report.coalesce(1).write.csv(f"{a.out}/{name}", header=True)


if __name__ == "__main__":
    main()
