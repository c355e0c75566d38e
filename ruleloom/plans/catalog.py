"""Named queries: every operator run over whole warehouse tables. `oracle.py` has the same results as SQL.

Queries on models share the mined rules of a session through `_shared`; the bench clears it between measurements.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ruleloom.functions.hashing import hash32
from ruleloom.operators import coverage, evaluate, gain, items, merge, prefix, rules, sampling, scoring, support
from ruleloom.plans import crossval, tables
from ruleloom.plans.estimator import RuleModel
from ruleloom.plans.training import TrainingSettings, train_bags, train_ensemble, training_input
from ruleloom.sources import text
from ruleloom.staging import stage, stage_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
_SHARED: dict[tuple[str, str, str], object] = {}

LINE_CLASSES = ["A", "N", "R"]
ORDER_CLASSES = ["F", "O", "P"]
BINARY = [0, 1]
LINES = {"min_support": 0.01, "min_confidence": 0.34, "min_chi2": 0.0}
DOCS = {"min_support": 0.1, "min_confidence": 0.5, "min_chi2": 0.0}
DOCS_GAIN = {"min_support": 0.02, "min_confidence": 0.5, "min_chi2": 0.0}
BASKETS = {"min_support": 0.005, "min_confidence": 0.3, "min_chi2": 0.0, "max_length": 10}
BAGS, BAG_SHARE, SEED = 5, 0.4, 7
FOLDS, FOLD_SEED = 5, 12345
FRACTIONS = {0: 2.0, 1: 0.5}
SUFFIX = "Brand#3"


def query(name: str) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[name] = f
        return f

    return register


def clear_shared() -> None:
    _SHARED.clear()


def _shared(spark: SparkSession, folder: str, name: str, build: Callable[[], object]):
    key = (spark.sparkContext.applicationId, folder, name)
    if key not in _SHARED:
        _SHARED[key] = build()
    return _SHARED[key]


def _words(array: str | Column) -> Column:
    column = F.col(array) if isinstance(array, str) else array
    return F.array_join(column.cast("array<string>"), " ")


def _six(value: str | Column) -> Column:
    column = F.col(value) if isinstance(value, str) else value
    return F.round(F.nanvl(column, F.lit(None).cast("double")), 6)


def _show_rules(table: DataFrame, *first: str) -> DataFrame:
    return table.select(
        *[F.col(c).cast("bigint").alias(c) for c in first],
        _words("antecedent").alias("antecedent"),
        F.col("consequent").cast("string").alias("consequent"),
        *[_six(c).alias(c) for c in ("support", "confidence", "chi2")],
    )


# --- transactions ------------------------------------------------------------------------------------------------


def lines(spark: SparkSession, folder: str) -> DataFrame:
    return sampling.one_bag(tables.line_transactions(spark, folder))


def line_input(spark: SparkSession, folder: str) -> DataFrame:
    return _shared(spark, folder, "line_input", lambda: training_input(lines(spark, folder)))


def line_bag_input(spark: SparkSession, folder: str) -> DataFrame:
    return _shared(spark, folder, "line_bag_input", lambda: training_input(line_bags(spark, folder)))


def docs(spark: SparkSession, folder: str) -> DataFrame:
    return sampling.one_bag(tables.document_transactions(spark, folder))


def baskets(spark: SparkSession, folder: str) -> DataFrame:
    return sampling.one_bag(tables.order_baskets(spark, folder))


def basket_input(spark: SparkSession, folder: str) -> DataFrame:
    return _shared(spark, folder, "basket_input", lambda: training_input(baskets(spark, folder)))


def line_bags(spark: SparkSession, folder: str) -> DataFrame:
    return sampling.bag_sample(tables.line_transactions(spark, folder), BAGS, BAG_SHARE, True, SEED)


def doc_bags(spark: SparkSession, folder: str) -> DataFrame:
    return sampling.bag_sample(tables.document_transactions(spark, folder), BAGS, BAG_SHARE, True, SEED)


# --- shared models -----------------------------------------------------------------------------------------------


def line_rules(spark: SparkSession, folder: str) -> DataFrame:
    return _shared(
        spark, folder, "line_rules", lambda: stage(support.mine_support(line_input(spark, folder), **LINES), "line-rules")
    )


def doc_rules(spark: SparkSession, folder: str) -> DataFrame:
    return _shared(
        spark, folder, "doc_rules", lambda: stage(support.mine_support(docs(spark, folder), **DOCS), "doc-rules")
    )


def doc_ensemble(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    settings = TrainingSettings(with_coverage=False, **DOCS)
    return _shared(spark, folder, "doc_ensemble", lambda: train_bags(doc_bags(spark, folder), settings))


def covered_docs(spark: SparkSession, folder: str) -> DataFrame:
    def build() -> DataFrame:
        return stage(coverage.cover(doc_rules(spark, folder), docs(spark, folder)), "covered")

    return _shared(spark, folder, "covered_docs", build)


def covered_ensemble(spark: SparkSession, folder: str) -> DataFrame:
    def build() -> DataFrame:
        data = docs(spark, folder).drop("bag_id")
        return stage(coverage.cover(doc_ensemble(spark, folder)[0], data, shared=True), "covered")

    return _shared(spark, folder, "covered_ensemble", build)


def line_predictions(spark: SparkSession, folder: str) -> DataFrame:
    return scoring.first_match(
        lines(spark, folder), line_rules(spark, folder), LINE_CLASSES, "N", id_cols=("rec_id", "label")
    )


def doc_folds(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    settings = TrainingSettings(
        num_models=2, sample_size=0.5, strategy="gain", with_coverage=False, seed=SEED, **DOCS_GAIN
    )
    tx = tables.document_transactions(spark, folder)
    return _shared(
        spark, folder, "doc_folds", lambda: crossval.train_folds(tx, settings, FOLDS, FOLD_SEED)
    )


def fold_predictions(spark: SparkSession, folder: str) -> DataFrame:
    tx = tables.document_transactions(spark, folder)
    fold_rules, bags = doc_folds(spark, folder)
    return crossval.predict_folds(tx, fold_rules, bags, BINARY, FOLDS, FOLD_SEED)


def fold_scores(spark: SparkSession, folder: str) -> DataFrame:
    def build() -> DataFrame:
        tx = tables.document_transactions(spark, folder)
        _, shares = crossval.class_shares(tx, BINARY)
        light = stage(crossval.light_fold_rules(doc_folds(spark, folder)[0]), "light-rules")
        vote = scoring.VoteSettings("max", "confidence", "none")
        return stage(crossval.score_folds(tx, light, vote, shares, FOLDS, FOLD_SEED), "fold-scores")

    return _shared(spark, folder, "fold_scores", build)


# --- sources and preparation -------------------------------------------------------------------------------------


@query("text_prep")
def text_prep(spark, folder):
    records = text.parse_records(tables.ragged_text(spark, folder))
    return records.select("rec_id", F.size("fields").cast("bigint").alias("n_fields"), F.array_join("fields", "|").alias("fields"))


@query("dictionary")
def dictionary(spark, folder):
    entries = text.build_dictionary(text.parse_records(tables.line_text(spark, folder)))
    return entries.select(F.col("pos").cast("bigint").alias("pos"), "value", F.col("item_id").cast("bigint").alias("item_id"))


@query("encode")
def encode(spark, folder):
    records = text.parse_records(tables.line_text(spark, folder))
    dictionary = stage(text.build_dictionary(records), "dictionary")
    encoded = text.encode(records, dictionary)
    k = text.class_count(encoded, dictionary)
    tx = text.to_transactions(encoded, k)
    return tx.select("rec_id", _words("items").alias("items"), F.col("label").alias("label"), F.lit(k).cast("bigint").alias("num_classes"))


@query("encode_least_id")
def encode_least_id(spark, folder):
    records = text.parse_records(tables.line_text(spark, folder))
    encoded = text.encode(records, text.build_dictionary(records))
    found, label = text.least_id_label(F.col("ids"))
    return encoded.select("rec_id", _words(found).alias("items"), label.alias("label"))


@query("class_prior")
def class_prior(spark, folder):
    counts = stage(items.label_counts(line_bag_input(spark, folder)), "label-counts")
    return items.class_priors(counts).select(
        F.col("bag_id").cast("bigint").alias("bag_id"), "label", "n_class", "n_total", _six("prior").alias("prior"), "default_class",
    )


@query("rules_text")
def rules_text(spark, folder):
    return rules.rules_text(covered_docs(spark, folder)).select(
        F.col("level").cast("bigint").alias("level"), F.col("rank").cast("bigint").alias("rank"), "line"
    )


# --- sampling ----------------------------------------------------------------------------------------------------


@query("bag_sample")
def bag_sample(spark, folder):
    return line_bags(spark, folder).select(
        "rec_id", F.col("copy").cast("bigint").alias("copy"), F.col("bag_id").cast("bigint").alias("bag_id")
    )


@query("bag_without_replacement")
def bag_without_replacement(spark, folder):
    tx = tables.line_transactions(spark, folder)
    return sampling.bag_sample(tx, 4, 0.2, False, SEED).select("rec_id", F.col("bag_id").cast("bigint").alias("bag_id"))


@query("bag_even")
def bag_even(spark, folder):
    """Copies dealt in turn: bags of equal sizes up to one record."""
    tx = tables.line_transactions(spark, folder)
    return sampling.bag_sample(tx, 4, 0.2, False, SEED, even=True).select("rec_id", F.col("bag_id").cast("bigint").alias("bag_id"))


@query("bag_contiguous")
def bag_contiguous(spark, folder):
    tx = tables.order_baskets(spark, folder)
    return sampling.bag_contiguous(tx, 8, 0.1, SEED).select("rec_id", F.col("bag_id").cast("bigint").alias("bag_id"))


@query("bag_by_partition")
def bag_by_partition(spark, folder):
    """Rows of the unshuffled sample, and of how many partitions any is in more than one bag."""
    key = F.concat_ws(":", "l_orderkey", "l_linenumber", "l_partkey").alias("rec_id")
    facts = tables.load_facts(spark, folder, "lineitem", "l_orderkey", "l_linenumber", "l_partkey").select(key)
    bags = sampling.bag_by_partition(facts, 2, 0.3, SEED).withColumn("part", F.spark_partition_id())
    of_part = bags.groupBy("part").agg(F.count("*").alias("n"), F.min("bag_id").alias("low"), F.max("bag_id").alias("high"))
    return of_part.agg(
        F.sum("n").alias("sampled"), F.count(F.when(F.col("low") != F.col("high"), 1)).alias("split_partitions")
    )


@query("stratified_resample")
def stratified_resample(spark, folder):
    tx = sampling.stratified_resample(tables.document_transactions(spark, folder), FRACTIONS, SEED)
    return tx.select("rec_id", "label", F.col("copy").cast("bigint").alias("copy"))


@query("kfold")
def kfold(spark, folder):
    tx = sampling.kfold(tables.line_transactions(spark, folder), 10, FOLD_SEED)
    train, test = sampling.train_test_split(tx, 0.7, SEED)
    both = train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))
    return both.select("rec_id", F.col("fold").cast("bigint").alias("fold"), "part")


# --- item statistics ---------------------------------------------------------------------------------------------


@query("item_support")
def item_support(spark, folder):
    counts = stage(items.label_counts(line_bag_input(spark, folder)), "label-counts")
    ranked = items.rank_items(counts, LINES["min_support"], "support")
    return ranked.select(*[F.col(c).cast("bigint").alias(c) for c in ("bag_id", "rank", "n", "n_max", "min_count")], "item")


@query("item_gain")
def item_gain(spark, folder):
    counts = stage(items.label_counts(line_bag_input(spark, folder)), "label-counts")
    ranked = items.rank_items(counts, LINES["min_support"], "gain")
    return ranked.select(
        *[F.col(c).cast("bigint").alias(c) for c in ("bag_id", "rank", "n")], "item",
        _six("gini").alias("gini"), F.round("gain", 9).alias("gain"),
    )


@query("feature_select")
def feature_select(spark, folder):
    tx = lines(spark, folder)
    counts = stage(items.label_counts(tx), "label-counts")
    return items.select_positions(tx, counts, 3).select("rec_id", _words("items").alias("items"))


@query("rank_tx")
def rank_tx(spark, folder):
    tx = stage(lines(spark, folder), "transactions")
    counts = stage(items.label_counts(items.compact(tx)), "label-counts")
    ranks, by_map = items.stage_ranks(items.rank_items(counts, LINES["min_support"], "gain"))
    encoded = items.rank_encode(tx, ranks, by_map)
    return encoded.select("rec_id", _words("ranks").alias("ranks"))


# --- prefix tree -------------------------------------------------------------------------------------------------


def _line_paths(spark: SparkSession, folder: str) -> DataFrame:
    def build() -> DataFrame:
        tx = line_input(spark, folder)
        counts = stage(items.label_counts(tx), "label-counts")
        ranks, by_map = items.stage_ranks(items.rank_items(counts, LINES["min_support"], "gain"))
        return stage(items.ranked_baskets(tx, ranks, by_map), "paths")

    return _shared(spark, folder, "line_paths", build)


@query("prefix_nodes")
def prefix_nodes(spark, folder):
    nodes = prefix.prefix_nodes(_line_paths(spark, folder))
    return nodes.select(_words("prefix").alias("prefix"), "label", "n")


@query("prefix_merge")
def prefix_merge(spark, folder):
    tx = baskets(spark, folder)
    halves = tx.withColumn("half", hash32(F.col("rec_id"), "half") % 2)
    paths = halves.select("half", "bag_id", F.col("items").alias("ranks"), "label", F.lit(1).cast("bigint").alias("n"))
    left, right = (prefix.prefix_nodes(paths.where(F.col("half") == h)) for h in (0, 1))
    return prefix.merge_nodes(left, right).select(_words("prefix").alias("prefix"), "label", "n")


@query("tree_transactions")
def tree_transactions(spark, folder):
    stored = prefix.stored_paths(prefix.prefix_nodes(_line_paths(spark, folder)))
    return stored.select(_words("ranks").alias("ranks"), "label", "n")


@query("conditional_base")
def conditional_base(spark, folder):
    tx = baskets(spark, folder)
    paths = tx.groupBy("bag_id", F.col("items").alias("ranks"), "label").agg(F.count("*").alias("n"))
    base = prefix.conditional_base(paths, F.lit(SUFFIX))
    return base.select(_words("ranks").alias("ranks"), "label", "n")


@query("header_summary")
def header_summary(spark, folder):
    summary = prefix.header_summary(_line_paths(spark, folder))
    return summary.select(F.col("item").cast("bigint").alias("item"), "label", "n")


# --- mining ------------------------------------------------------------------------------------------------------


@query("rules_support")
def rules_support(spark, folder):
    return _show_rules(line_rules(spark, folder), "rank")


@query("rules_support_filtered")
def rules_support_filtered(spark, folder):
    settings = {**LINES, "min_chi2": 3.841}
    return _show_rules(support.mine_support(line_input(spark, folder), filter_singletons=True, **settings), "rank")


@query("rules_support_baskets")
def rules_support_baskets(spark, folder):
    return _show_rules(support.mine_support(basket_input(spark, folder), **BASKETS), "rank")


@query("rules_support_weekly")
def rules_support_weekly(spark, folder):
    tx = sampling.one_bag(tables.weekly_activity(spark, folder))
    return _show_rules(support.mine_support(tx, 0.01, 0.5, 0.0), "rank")


@query("rules_gain")
def rules_gain(spark, folder):
    return _show_rules(gain.mine_gain(docs(spark, folder), **DOCS_GAIN), "rank")


@query("rules_gain_bags")
def rules_gain_bags(spark, folder):
    return _show_rules(gain.mine_gain(line_bag_input(spark, folder), 0.005, 0.34, 0.0), "bag_id", "rank")


@query("rules_gain_presorted")
def rules_gain_presorted(spark, folder):
    return _show_rules(gain.mine_gain(line_input(spark, folder), 0.005, 0.34, 0.0, presorted=True), "rank")


@query("node_gain")
def node_gain(spark, folder):
    paths = _line_paths(spark, folder)
    limits = lines(spark, folder).groupBy("bag_id").agg(items.min_count(F.count("*"), 0.001).alias("min_count"))
    nodes = stage(gain.node_table(paths, LINE_CLASSES).join(F.broadcast(limits), "bag_id"), "tree-nodes")
    judged = gain.node_gain(nodes, nodes)
    return judged.select(
        _words("prefix").alias("prefix"), "n", "n_max", F.round("gain", 9).alias("gain"),
        F.col("passes").cast("bigint").alias("passes"), F.col("pure").cast("bigint").alias("pure"),
    )


@query("rule_metrics")
def rule_metrics(spark, folder):
    counts = stage(items.label_counts(baskets(spark, folder)), "label-counts")
    singles = items.item_counts(counts)
    n_ant = singles.groupBy("bag_id", "item").agg(F.sum("n").alias("n_ant"))
    found = singles.join(n_ant, ["bag_id", "item"]).select(
        "bag_id", F.array("item").alias("antecedent"), F.col("label").alias("consequent"), "n_ant", F.col("n").alias("n_hit")
    )
    measured = rules.measure(found, counts)
    return measured.select(
        _words("antecedent").alias("item"), "consequent", "n_ant", "n_hit", "n_class", "n_total",
        *[_six(c).alias(c) for c in ("support", "confidence", "chi2")],
    )


@query("rules_ordered")
def rules_ordered(spark, folder):
    by_length = rules.order_rules(line_rules(spark, folder).withColumn("length", F.size("antecedent")), ["length"])
    return by_length.select(
        F.col("length").cast("bigint").alias("length"), F.col("rank").cast("bigint").alias("rank"),
        _words("antecedent").alias("antecedent"), "consequent",
    )


@query("rules_classtoken")
def rules_classtoken(spark, folder):
    settings = {k: v for k, v in BASKETS.items() if k != "max_length"}
    return _show_rules(support.mine_class_tokens(basket_input(spark, folder), **settings), "rank")


@query("ensemble_rules")
def ensemble_rules(spark, folder):
    return _show_rules(doc_ensemble(spark, folder)[0], "bag_id", "rank")


# --- coverage and merging ----------------------------------------------------------------------------------------


@query("coverage_used")
def coverage_used(spark, folder):
    return _show_rules(covered_docs(spark, folder).where(F.col("level") == 1), "rank")


@query("coverage_spare")
def coverage_spare(spark, folder):
    return _show_rules(covered_docs(spark, folder).where(F.col("level") == 2), "rank")


@query("coverage_flat")
def coverage_flat(spark, folder):
    return _show_rules(coverage.flatten_levels(covered_docs(spark, folder)), "rank")


@query("coverage_ensemble")
def coverage_ensemble(spark, folder):
    return _show_rules(covered_ensemble(spark, folder), "bag_id", "level", "rank")


@query("coverage_lines")
def coverage_lines(spark, folder):
    return _show_rules(coverage.cover(line_rules(spark, folder), line_input(spark, folder)), "level", "rank")


def _merged(method: str) -> Query:
    def run(spark, folder):
        return _show_rules(merge.merge_rules(covered_ensemble(spark, folder), method), "level", "rank")

    return run


for _method in merge.METHODS:
    QUERIES[f"merge_{_method}"] = _merged(_method)


# --- scoring -----------------------------------------------------------------------------------------------------


@query("rule_match")
def rule_match(spark, folder):
    pairs = scoring.rule_matches(docs(spark, folder), doc_rules(spark, folder), BINARY)
    return pairs.select("rec_id", F.col("rank").cast("bigint").alias("rank"))


@query("first_match")
def first_match(spark, folder):
    return line_predictions(spark, folder).select("rec_id", "prediction")


@query("first_match_levels")
def first_match_levels(spark, folder):
    covered = covered_docs(spark, folder)
    return scoring.first_match(docs(spark, folder), covered, BINARY, 1).select(
        "rec_id", F.col("prediction").cast("bigint").alias("prediction")
    )


def _show_proba(scored: DataFrame, classes: list) -> DataFrame:
    return scored.select(
        "rec_id", *[F.round(F.get("probability", F.lit(i)), 6).alias(f"p_{c}") for i, c in enumerate(classes)]
    )


def _probabilities(vote: scoring.VoteSettings) -> Query:
    def run(spark, folder):
        scored = scoring.probabilities(lines(spark, folder), line_rules(spark, folder), LINE_CLASSES, vote)
        return _show_proba(scored, LINE_CLASSES)

    return run


VOTES = {
    "proba_max_confidence": scoring.VoteSettings("max", "confidence", "none"),
    "proba_mean": scoring.VoteSettings("mean", "confidence", "none"),
    "proba_min": scoring.VoteSettings("min", "confidence", "none"),
    "proba_max_support": scoring.VoteSettings("max", "support", "none"),
    "proba_numrules": scoring.VoteSettings("mean", "confidence", "numRules"),
}
for _name, _vote in VOTES.items():
    QUERIES[_name] = _probabilities(_vote)


@query("vote_predict")
def vote_predict(spark, folder):
    scored = scoring.probabilities(lines(spark, folder), line_rules(spark, folder), LINE_CLASSES, VOTES["proba_max_confidence"])
    return scoring.vote_predict(scored, LINE_CLASSES).select("rec_id", "prediction")


@query("ensemble_predict")
def ensemble_predict(spark, folder):
    table, bags = doc_ensemble(spark, folder)
    default = scoring.ensemble_default(bags)
    predicted = scoring.ensemble_predict(docs(spark, folder), table, BINARY, default)
    return predicted.select("rec_id", F.col("prediction").cast("bigint").alias("prediction"))


@query("saved_model_predict")
def saved_model_predict(spark, folder):
    """Predictions of an ensemble that was written to the shared folder and read back."""
    table, bags = doc_ensemble(spark, folder)
    path = stage_path(spark, "model")
    RuleModel(table, bags, BINARY).save(path)
    predicted = RuleModel.load(spark, path).predict(docs(spark, folder))
    return predicted.select("rec_id", F.col("prediction").cast("bigint").alias("prediction"))


@query("ensemble_majority")
def ensemble_majority(spark, folder):
    table, bags = doc_ensemble(spark, folder)
    predicted = scoring.ensemble_majority(docs(spark, folder), table, bags, BINARY)
    return predicted.select("rec_id", F.col("prediction").cast("bigint").alias("prediction"))


@query("ensemble_proba")
def ensemble_proba(spark, folder):
    table, _ = doc_ensemble(spark, folder)
    scored = scoring.ensemble_proba(docs(spark, folder), table, BAGS, BINARY, VOTES["proba_max_confidence"])
    return _show_proba(scored, BINARY)


@query("ensemble_weighted")
def ensemble_weighted(spark, folder):
    table, _ = doc_ensemble(spark, folder)
    predicted = scoring.ensemble_weighted(docs(spark, folder), table, BAGS, BINARY, VOTES["proba_max_confidence"])
    return predicted.select("rec_id", F.col("prediction").cast("bigint").alias("prediction"))


# --- evaluation --------------------------------------------------------------------------------------------------


@query("model_stats")
def model_stats(spark, folder):
    stats = rules.model_stats(covered_ensemble(spark, folder), doc_ensemble(spark, folder)[1])
    counts = [F.col(c).cast("bigint").alias(c) for c in ("rules_1", "rules_2", "items_1", "items_2")]
    return stats.select(*counts, _six("length_1").alias("length_1"), _six("length_2").alias("length_2"))


@query("confusion")
def confusion(spark, folder):
    return evaluate.confusion(line_predictions(spark, folder))


@query("accuracy")
def accuracy(spark, folder):
    measured = evaluate.accuracy(line_predictions(spark, folder))
    return measured.select("n", _six("accuracy").alias("accuracy"), _six("test_error").alias("test_error"))


@query("cv_confusion")
def cv_confusion(spark, folder):
    cells = evaluate.cv_confusion(evaluate.confusion(fold_predictions(spark, folder), ["fold"]))
    return cells.select(
        *[F.col(c).cast("bigint").alias(c) for c in ("label", "prediction", "n")], _six("share").alias("share")
    )


@query("cv_summary")
def cv_summary(spark, folder):
    measures = crossval.fold_measures(fold_predictions(spark, folder), doc_folds(spark, folder)[0])
    summary = crossval.cv_summary(measures)
    return summary.select("measure", *[_six(c).alias(c) for c in ("mean", "variance", "stddev")])


@query("roc")
def roc(spark, folder):
    curve = evaluate.roc(fold_scores(spark, folder))
    return curve.select(
        *[F.col(c).cast("bigint").alias(c) for c in ("fold", "part")],
        *[_six(c).alias(c) for c in ("score", "fpr", "tpr")],
    )


@query("auc")
def auc(spark, folder):
    areas = evaluate.auc(fold_scores(spark, folder))
    return areas.select(F.col("fold").cast("bigint").alias("fold"), _six("auc").alias("auc"))


@query("accuracy_curve")
def accuracy_curve(spark, folder):
    curve = evaluate.accuracy_curve(fold_scores(spark, folder))
    return curve.select(
        F.col("fold").cast("bigint").alias("fold"), F.round("threshold", 1).alias("threshold"), _six("accuracy").alias("accuracy")
    )


@query("best_threshold")
def best_threshold(spark, folder):
    best = evaluate.best_threshold(evaluate.accuracy_curve(fold_scores(spark, folder)))
    return best.select(F.round("threshold", 1).alias("threshold"), _six("mean").alias("mean"), _six("stddev").alias("stddev"))


@query("grid")
def grid(spark, folder):
    tx = tables.document_transactions(spark, folder)
    counts, _ = crossval.class_shares(tx, BINARY)
    samplings = {f"{m}sampling": sampling.balancing_fractions(counts, m) for m in ("over", "under")}
    settings = TrainingSettings(
        num_models=2, sample_size=0.5, strategy="gain", with_coverage=False, with_replacement=False,
        seed=SEED, **DOCS_GAIN,
    )
    summary = crossval.binary_grid(tx, settings, samplings, k=FOLDS, seed=FOLD_SEED)
    return summary.select("sampling", "voting", "weight", "measure", _six("mean").alias("mean"), _six("stddev").alias("stddev"))


@query("ensemble_training")
def ensemble_training(spark, folder):
    """Flagship: sample order lines into bags, mine and cover all bags, merge them into one model."""
    settings = TrainingSettings(num_models=4, sample_size=0.25, seed=SEED, **LINES)
    table, _ = train_ensemble(tables.line_transactions(spark, folder), settings)
    return _show_rules(merge.merge_rules(table), "level", "rank")
