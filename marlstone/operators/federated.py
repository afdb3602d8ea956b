"""Federated training and prediction on logs, from labelled rows to written results.

One organisation's rows are one value of ``org_index``.  The flow is: load, split, tokens by
subcategory, vocabularies and tags, rounds of training and averaging, fusion, evaluation, predictions with
explanations, artifacts.  Every step is a table that is written once (``keep``), since several later steps read it.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions.keyed import key_of, tag
from marlstone.functions.text import clean_id, joined_text, label as clean_label
from marlstone.operators import metrics, model, orgs, signals, subcategories, vocabulary
from marlstone.sources import artifacts, sinks, tables


@dataclass(frozen=True)
class Config:
    """Settings of a run; ``checked`` refuses what cannot work."""

    org_data: tuple[str, ...] = ()
    org_groundtruth: tuple[str, ...] = ()
    label_column: str | None = None
    text_columns: tuple[str, ...] = ()
    output_dir: str = ""
    test_size: float = 0.2
    num_features: int = 1000
    max_df: float = 0.95
    min_df: int = 2
    vocabulary_source: str = "train"
    context_window_minutes: float = 15.0
    context_timestamp_iso_field: str | None = "event_time_iso"
    context_timestamp_epoch_field: str | None = "event_time_epoch"
    federation_iterations: int = 3
    local_epochs: int = 1
    learning_rate: float = 0.05
    regularization: float = 1e-4
    class_weight: str = "balanced"
    batch_size: int = 64
    aggregation_weighting: str = "sample_size"
    seed: int = 42
    hierarchy: dict | None = None
    ensemble_method: str | None = None
    logit_weights: dict[str, float] = field(default_factory=dict)
    risk_threshold: float = 0.75

    def checked(self) -> "Config":
        wrong = [
            text
            for bad, text in (
                (len(self.org_data) != len(self.org_groundtruth), "as many ground truths as logs are needed"),
                (self.num_features < 1, "num_features must be positive"),
                (self.federation_iterations < 0, "federation_iterations must not be negative"),
                (self.min_df < 1 or self.max_df <= 0, "min_df must be 1 or more and max_df positive"),
                (self.batch_size < 1, "batch_size must be positive"),
                (self.local_epochs < 0, "local_epochs must not be negative"),
                (not 0 <= self.risk_threshold <= 1, "risk_threshold must lie in 0 to 1"),
                (not 0 < self.test_size < 1, "test_size must lie between 0 and 1"),
                (self.class_weight not in ("balanced", "none"), "class_weight is balanced or none"),
                (self.vocabulary_source not in ("train", "all"), "vocabulary_source is train or all"),
                (self.aggregation_weighting not in ("sample_size", "uniform"), "aggregation_weighting is sample_size or uniform"),
                (self.context_window_minutes not in (0.0, 15.0), "the window is 15 minutes, or 0 for rows by themselves"),
                (self.context_window_minutes > 0 and not (self.context_timestamp_epoch_field or self.context_timestamp_iso_field), "a window needs a column of times"),
                (self.context_window_minutes > 0 and self.context_timestamp_epoch_field is not None and self.context_timestamp_epoch_field == self.context_timestamp_iso_field, "the two columns of times must differ"),
                (self.ensemble_method not in (None, "average_logits", "weighted_average_logits"), "unknown ensemble_method"),
            )
            if bad
        ]
        if wrong:
            raise ValueError("; ".join(wrong))
        return self

    @classmethod
    def of(cls, d: dict) -> "Config":
        if unknown := set(d) - set(cls.__dataclass_fields__):
            raise ValueError(f"unknown settings {sorted(unknown)}")
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in d.items()}).checked()

    def to_json(self) -> str:
        """The settings with what the weights depend on: context, tag form and the fixed vocabulary."""
        import hashlib

        more = {
            "cross_context": {"version": 1, "causal": True, "window_minutes": self.context_window_minutes, "timestamp_epoch_field": self.context_timestamp_epoch_field, "timestamp_iso_field": self.context_timestamp_iso_field},
            "tags": {"version": 2, "format": "subcategory|token"},
            "weights": "tf",
            "cross_vocabulary": {"version": 2, "size": len(signals.TOKENS), "sha256": hashlib.sha256("\n".join(signals.TOKENS).encode()).hexdigest()},
        }
        return json.dumps(asdict(self) | more, sort_keys=True)


Keep = Callable[[DataFrame, str], DataFrame]


def written(df: DataFrame, name: str) -> DataFrame:
    """A table in the shared folder, read back."""
    path = artifacts.scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def load(spark: SparkSession, logs: Sequence[str], truths: Sequence[str], label_column: str | None = None, text_columns: Sequence[str] = ()) -> DataFrame:
    """All organisations' rows with ``org_index`` and ``row_index`` (from 0), ``internal_log_id``, ``source_log_id``, ``text`` and ``label``.

    Logs and ground truths agree row by row; different numbers of rows are an error, blank labels too.
    """
    out = None
    for k, (log, truth) in enumerate(zip(logs, truths, strict=True)):
        raw, gold = (tables.read_csv_lines(spark, [p]).withColumn("row_index", F.col("source_row_number") - 1).drop(*tables.PROVENANCE) for p in (log, truth))
        name = orgs.label_column([c for c in gold.columns if c != "row_index"], label_column)
        columns = [c for c in raw.columns if c != "row_index"]
        raw = tables.canonical_numbers(raw, "row_index")
        source = orgs.source_id_column(columns)
        raw = raw.select("*", joined_text(orgs.text_columns(columns, text_columns or None)).alias("text") if "text" not in columns else F.col("row_index").alias("__r"), (clean_id(F.col(f"`{source}`")) if source else F.lit(None).cast("string")).alias("source_log_id")).drop("__r")
        both = orgs.zipped(raw.drop("label"), gold.select("row_index", clean_label(F.col(f"`{name}`")).alias("label")), "row_index")
        both = both.withColumn("org_index", F.lit(k)).withColumn("internal_log_id", orgs.internal_id(F.col("org_index"), F.col("row_index")))
        out = both if out is None else out.unionByName(both, allowMissingColumns=True)
    if out is None:
        raise ValueError("there is no log")
    return out


def unknown_labels(rows: DataFrame, known: DataFrame) -> DataFrame:
    """(org_index, label, n): labels of rows that a model does not know."""
    return rows.groupBy("org_index", "label").agg(F.count("*").alias("n")).join(known.select("label").distinct(), "label", "left_anti").select("org_index", "label", "n")


def known_only(rows: DataFrame, known: DataFrame) -> DataFrame:
    """The rows; an unknown label is an error that lists them all."""
    if bad := unknown_labels(rows, known).collect():  # organisations times labels
        raise ValueError(f"labels that the model does not know: {sorted((r['org_index'], r['label']) for r in bad)}")
    return rows


@dataclass
class Trained:
    """Weights and all that is needed to use them."""

    config: Config
    labels: list[str]
    hierarchy: model.Hierarchy
    axis: DataFrame
    weights: DataFrame
    biases: DataFrame
    baseline: DataFrame | None

    def save(self, path: str) -> None:
        more = {"baseline": self.baseline} if self.baseline is not None else {}
        sinks.save_model(path, {"labels": self.labels, "hierarchy": self.hierarchy.to_json(), "config": self.config.to_json()}, axis=self.axis, weights=self.weights, biases=self.biases, **more)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "Trained":
        manifest, t = sinks.load_model(spark, path)
        settings = json.loads(manifest["config"])
        if settings["cross_vocabulary"] != json.loads(Config().to_json())["cross_vocabulary"]:
            raise ValueError("the model was made for another cross vocabulary")
        own = {k: v for k, v in settings.items() if k in Config.__dataclass_fields__}
        return cls(Config.of(own), manifest["labels"], model.Hierarchy.from_json(manifest["hierarchy"]), t["axis"], t["weights"], t["biases"], t.get("baseline"))


def _features(rows: DataFrame, config: Config, wanted: Sequence[str], baseline: DataFrame | None) -> DataFrame:
    """(org_index, row_index, subcategory, token, tf)."""
    novel = None
    if baseline is not None:
        rows = signals.with_novelty(rows.withColumn("__id", F.concat_ws("_", "org_index", "row_index")), baseline, key_of(config.seed), "__id").drop("__id")
        novel = F.col("__novel")
    found = subcategories.tokens(rows, "row_index", wanted, ("org_index",), config.context_window_minutes, novel)
    return found.select("org_index", "row_index", "subcategory", F.explode("tokens").alias("token")).groupBy("org_index", "row_index", "subcategory", "token").agg(F.count("*").alias("tf"))


def _on_axis(tf: DataFrame, axis: DataFrame, key: bytes) -> DataFrame:
    """(org_index, row_index, subcategory, gv_index, value); each token is hashed once."""
    found = tf.select("subcategory", "token").distinct()
    by = F.lit(None).cast("string")
    for s in subcategories.COLUMNS:
        by = F.when(F.col("subcategory") == s, tag(key, s, F.col("token"))).otherwise(by)
    found = found.withColumn("tag", by).join(axis, ["subcategory", "tag"]).select("subcategory", "token", "gv_index")
    return tf.join(found, ["subcategory", "token"]).select("org_index", "row_index", "subcategory", "gv_index", F.col("tf").cast("double").alias("value"))


def train(rows: DataFrame, config: Config, keep: Keep = written) -> tuple[Trained, DataFrame]:
    """A model of the rows of ``load``, and the rows' split (org_index, row_index, label, is_test)."""
    spark = rows.sparkSession
    split = keep(model.stratified_split(rows.select("org_index", "row_index", "label"), "row_index", config.test_size, config.seed, "org_index"), "split")
    labels = [r["label"] for r in split.select("label").distinct().orderBy("label").collect()]  # the classes
    hierarchy = model.Hierarchy.default(labels, config.hierarchy)
    wanted = subcategories.checked([s for subs in hierarchy.subcategories.values() for s in subs])
    key = key_of(config.seed)
    training = split.where("not is_test").select("org_index", "row_index")
    baseline = keep(signals.baseline(rows.join(training, ["org_index", "row_index"], "left_semi"), key), "baseline") if "cross" in wanted else None
    tf = keep(_features(rows, config, wanted, baseline), "features")
    seen = tf if config.vocabulary_source == "all" else tf.join(training, ["org_index", "row_index"], "left_semi")
    numbers = split.where("true" if config.vocabulary_source == "all" else "not is_test").groupBy("org_index").agg(F.count("*").alias("n"))
    local = []
    for s in wanted:  # a handful
        if s == "cross":  # a fixed vocabulary, the same everywhere
            fixed = spark.createDataFrame([(t, i) for i, t in enumerate(signals.TOKENS)], "token string, position int")
            df = vocabulary.document_frequency(seen.where("subcategory = 'cross'"), "org_index")
            own = fixed.crossJoin(F.broadcast(numbers.select("org_index"))).join(df, ["org_index", "token"], "left").select("org_index", "token", F.coalesce("df", F.lit(0)).alias("df"))
        else:
            df = vocabulary.document_frequency(seen.where(F.col("subcategory") == s), "org_index")
            own = vocabulary.local_vocabulary(df, numbers, config.num_features, config.min_df, config.max_df, "org_index").select("org_index", "token", "df")
        local.append(vocabulary.idf(vocabulary.tagged(own, key, s), numbers, "org_index").select(F.lit(s).alias("subcategory"), F.col("org_index").cast("string").alias("org"), "tag", "idf"))
    vocab = local[0]
    for more in local[1:]:
        vocab = vocab.unionByName(more)
    vocab = keep(vocab, "vocabulary")
    axes = [vocabulary.global_axis(vocab.where(F.col("subcategory") == s)).withColumn("subcategory", F.lit(s)) for s in wanted]
    axis = axes[0]
    for more in axes[1:]:
        axis = axis.unionByName(more)
    axis = keep(axis, "axis")
    index = vocab.join(axis, ["subcategory", "tag"]).select("subcategory", "org", "gv_index", "idf")
    table = hierarchy.table(spark).select("label", "subcategory")
    weights = keep(axis.join(F.broadcast(table), "subcategory").select("label", "subcategory", "gv_index", model.initial_weight(config.seed, F.col("label"), F.col("subcategory"), F.col("gv_index").cast("string")).alias("weight")), "weights")
    biases = table.withColumn("bias", F.lit(0.0))
    features = _on_axis(tf.join(training, ["org_index", "row_index"], "left_semi"), axis, key)
    lists = features.groupBy("org_index", "row_index", "subcategory").agg(F.sort_array(F.collect_list(F.struct("gv_index", "value"))).alias("features"))
    every = split.where("not is_test").crossJoin(F.broadcast(table.withColumnRenamed("label", "target"))).join(lists, ["org_index", "row_index", "subcategory"], "left")
    y = F.col("label") == F.col("target")
    pairs = split.where("not is_test").crossJoin(F.broadcast(table.select(F.col("label").alias("target")).distinct()))
    balance = model.class_weights(pairs, y, "org_index", "target") if config.class_weight == "balanced" else pairs.select("org_index", "target", F.lit(1.0).alias("positive_weight"), F.lit(1.0).alias("negative_weight")).distinct()
    examples = every.join(F.broadcast(balance), ["org_index", "target"])  # organisations times labels
    examples = examples.select(F.col("target").alias("label"), "subcategory", F.col("org_index").cast("string").alias("org"), F.col("row_index").alias("row"), y.cast("int").alias("y"), "positive_weight", "negative_weight", F.coalesce("features", F.array().cast("array<struct<gv_index:bigint,value:double>>")).alias("features"))
    examples = keep(examples, "examples")
    for k in range(config.federation_iterations):
        updates = keep(model.train_round(examples, weights, biases, index, config.learning_rate, config.batch_size, config.local_epochs, config.regularization, config.seed, k), "updates")
        weights, biases = model.averaged(weights, updates, config.aggregation_weighting)
        weights, biases = keep(weights, "weights"), keep(biases, "biases")
    return Trained(config, labels, hierarchy, axis, weights, biases, baseline), split


@dataclass
class Scored:
    """``predictions`` (org_index, row_index, internal_log_id, predicted_label, max_risk_probability, is_high_risk, probabilities) and ``explanations`` of the high-risk rows."""

    predictions: DataFrame
    explanations: DataFrame


def predict(rows: DataFrame, trained: Trained, keep: Keep = written) -> Scored:
    """Every row's label and probabilities, and for high-risk rows what counted most in each specialist of the predicted label."""
    config, hierarchy = trained.config, trained.hierarchy
    if config.ensemble_method:
        hierarchy = hierarchy.averaged(**(config.logit_weights if config.ensemble_method == "weighted_average_logits" else {}))
    wanted = subcategories.checked([s for subs in hierarchy.subcategories.values() for s in subs])
    features = keep(_on_axis(_features(rows, config, wanted, trained.baseline), trained.axis, key_of(config.seed)), "features")
    keys = ("org_index", "row_index")
    fused = model.fused(model.logits(features, trained.weights, trained.biases, rows.select(*keys), *keys), hierarchy, *keys)
    predictions = keep(model.predictions(fused, config.risk_threshold, *keys).withColumn("internal_log_id", orgs.internal_id(F.col("org_index"), F.col("row_index"))), "predictions")
    risky = predictions.where("is_high_risk")
    tops = model.top_contributions(features, trained.weights, trained.axis.select("subcategory", "gv_index", "tag"), risky, *keys)
    tops = tops.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("subcategory", "rank", "tag", "feature_value", "weight", "contribution"))).alias("top_contributions"))
    explanations = risky.join(tops, list(keys), "left").select(*keys, "internal_log_id", "predicted_label", "max_risk_probability", "top_contributions")
    return Scored(predictions, explanations)


def evaluate(predictions: DataFrame, truth: DataFrame, keys: Sequence[str] = ("org_index", "row_index"), org: str = "org_index") -> tuple[DataFrame, DataFrame]:
    """(accuracy by organisation, with ``all`` for all of them; report) of predictions against true labels; rows without a label don't count."""
    scored = predictions.join(truth.select(*keys, F.col("label").alias("true_label")), list(keys))
    right = F.avg((F.col("predicted_label") == F.col("true_label")).cast("double")).alias("accuracy")
    by = scored.groupBy(F.col(org).cast("string").alias("org")).agg(F.count("*").alias("rows"), right)
    total = scored.agg(F.count("*").alias("rows"), right).select(F.lit("all").alias("org"), "rows", "accuracy")
    return by.unionByName(total), metrics.report(metrics.confusion(scored, "true_label", "predicted_label"))


def run(spark: SparkSession, config: Config) -> Trained:
    """Train on the configured logs and write model, predictions, evaluation of the held-out rows and settings to ``output_dir``."""
    config.checked()
    rows = written(load(spark, config.org_data, config.org_groundtruth, config.label_column, config.text_columns), "rows")
    trained, split = train(rows, config)
    trained.save(f"{config.output_dir}/model")
    if trained.baseline is not None:
        artifacts.write_baseline(trained.baseline, f"{config.output_dir}/baseline", rows.where("label = 'benign'").groupBy("org_index").agg(F.count("*").alias("n")))
    scored = predict(rows, trained)
    artifacts.write_predictions(scored.predictions, f"{config.output_dir}/predictions", scored.explanations)
    accuracy, report = evaluate(scored.predictions, split.where("is_test"))
    sinks.write_json(accuracy.coalesce(1), f"{config.output_dir}/accuracy")
    sinks.write_json(report.coalesce(1), f"{config.output_dir}/report")
    artifacts.write_document(spark, json.loads(config.to_json()), f"{config.output_dir}/config")
    return trained


def test(spark: SparkSession, config: Config, model_dir: str) -> Scored:
    """Use a saved model on labelled logs and write the test outputs to ``output_dir``; a label that it does not know is an error."""
    trained = Trained.load(spark, model_dir)
    own = asdict(trained.config) | {"risk_threshold": config.risk_threshold, "ensemble_method": config.ensemble_method, "logit_weights": config.logit_weights}
    trained.config = Config(**own)
    rows = written(load(spark, config.org_data, config.org_groundtruth, config.label_column, config.text_columns), "rows")
    known_only(rows, spark.createDataFrame([(c,) for c in trained.labels], "label string"))
    scored = predict(rows, trained)
    labelled = scored.predictions.join(rows.select("org_index", "row_index", "label"), ["org_index", "row_index"])
    artifacts.write_testing(labelled, f"{config.output_dir}", explanations=scored.explanations)
    return scored
