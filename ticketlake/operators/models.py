"""Multiclass training, scoring, evaluation and diagnostic probes on ``pyspark.ml``."""

import json
from dataclasses import dataclass, field

import numpy as np
from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    GBTClassifier,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    OneVsRest,
)
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler, VectorSizeHint
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ticketlake.functions import tags
from ticketlake.functions.text import concat_separated, concat_training
from ticketlake.operators.evaluation import classification_report, f1_weighted
from ticketlake.operators.features import (
    CLASSIFIER_TEXT,
    NETWORK_TEXT,
    UNKNOWN,
    CenterScaleModel,
    TfidfModel,
    fit_center_scale,
    fit_tfidf,
    scale_divisors,
)
from ticketlake.operators.forest import fit_forest
from ticketlake.operators.linear import fit_multinomial
from ticketlake.operators.metrics import with_class_weight
from ticketlake.operators.projection import SvdModel, fit_svd, vector_parts
from ticketlake.operators.splits import shuffle_labels
from ticketlake.schema import CATEGORICAL_COLUMNS, NUMERIC_COLUMNS, TEXT_COLUMNS
from ticketlake.session import materialize

_NULL = "<null>"

# Dense dimensions of the two networks.
TEXT_DIMENSIONS = 256
FULL_DIMENSIONS = 512


@dataclass(frozen=True)
class FeatureBlocks:
    """Which columns feed the model; an empty list leaves the block out."""

    text: list[str] = field(default_factory=lambda: list(TEXT_COLUMNS))
    categorical: list[str] = field(default_factory=lambda: list(CATEGORICAL_COLUMNS))
    numeric: list[str] = field(default_factory=lambda: list(NUMERIC_COLUMNS))

    def text_only(self) -> "FeatureBlocks":
        return FeatureBlocks(self.text, [], [])

    def without_text(self) -> "FeatureBlocks":
        return FeatureBlocks([], self.categorical, self.numeric)


@dataclass(frozen=True)
class FeatureModel:
    """Fitted featuriser: text block, then one-hot block, then scaled numbers, as one vector."""

    blocks: FeatureBlocks
    tfidf: TfidfModel | None
    divisors: dict[str, float]
    stages: PipelineModel

    @property
    def width(self) -> int:
        """Length of the feature vector."""
        text = max(len(self.tfidf.terms), 1) if self.tfidf else 0
        hot = sum(len(labels) for stage in self.stages.stages if hasattr(stage, "labelsArray") for labels in stage.labelsArray)
        return text + hot + len(self.blocks.numeric)

    def transform(self, df: DataFrame, out: str = "features") -> DataFrame:
        staged = _prepare(df, self.blocks, self.divisors)
        if self.tfidf:
            staged = self.tfidf.transform_vector(staged, concat_training(*self.blocks.text), "_text")
        # The assembler names every vector slot in the column metadata; with a large vocabulary each later
        # schema lookup would carry all those names, so the metadata is dropped at once.
        vector = F.col("_features").alias(out, metadata={})
        return self.stages.transform(staged).select(*df.columns, vector)

    def save(self, spark: SparkSession, path: str) -> None:
        """Settings as JSON, the vectoriser as a table, the stages as stored by Spark; replaces what is there."""
        blocks = {"text": self.blocks.text, "categorical": self.blocks.categorical, "numeric": self.blocks.numeric}
        _write_settings(spark, {"blocks": blocks, "divisors": self.divisors, "vectoriser": self.tfidf is not None}, f"{path}/settings")
        if self.tfidf:
            self.tfidf.save(spark, f"{path}/vectoriser")
        self.stages.write().overwrite().save(f"{path}/stages")

    @staticmethod
    def load(spark: SparkSession, path: str) -> "FeatureModel":
        kept = _read_settings(spark, f"{path}/settings")
        tfidf = TfidfModel.load(spark, f"{path}/vectoriser") if kept["vectoriser"] else None
        return FeatureModel(FeatureBlocks(**kept["blocks"]), tfidf, kept["divisors"], PipelineModel.load(f"{path}/stages"))


def _write_settings(spark: SparkSession, settings: dict, path: str) -> None:
    spark.createDataFrame([(json.dumps(settings),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def _read_settings(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first()["value"])


def _prepare(df: DataFrame, blocks: FeatureBlocks, divisors: dict[str, float]) -> DataFrame:
    named = {f"_c_{c}": F.coalesce(F.col(c).cast("string"), F.lit(_NULL)) for c in blocks.categorical}
    scaled = {f"_n_{c}": F.coalesce(F.col(c).cast("double") / divisors[c], F.lit(0.0)) for c in blocks.numeric}
    return df.withColumns({**named, **scaled}) if named or scaled else df


def fit_features(train: DataFrame, blocks: FeatureBlocks, text_settings: dict | None = None) -> FeatureModel:
    """Fit on training rows only. Values never seen in training become all-zero one-hot blocks."""
    divisors = scale_divisors(train, blocks.numeric) if blocks.numeric else {}
    tfidf = None
    staged = _prepare(train, blocks, divisors)
    if blocks.text:
        text = concat_training(*blocks.text)
        tfidf = fit_tfidf(train, text, **(text_settings or CLASSIFIER_TEXT))
        staged = tfidf.transform_vector(staged, text, "_text")
    stages, inputs = [], (["_text"] if blocks.text else [])
    if tfidf:
        stages.append(VectorSizeHint(inputCol="_text", size=max(len(tfidf.terms), 1), handleInvalid="optimistic"))
    if blocks.categorical:
        names = [f"_c_{c}" for c in blocks.categorical]
        coded = [f"_i_{c}" for c in blocks.categorical]
        hot = [f"_h_{c}" for c in blocks.categorical]
        # 'keep' reserves a last slot for unseen values, which dropLast then removes.
        stages.append(StringIndexer(inputCols=names, outputCols=coded, handleInvalid="keep"))
        stages.append(OneHotEncoder(inputCols=coded, outputCols=hot, dropLast=True))
        inputs += hot
    inputs += [f"_n_{c}" for c in blocks.numeric]
    stages.append(VectorAssembler(inputCols=inputs, outputCol="_features", handleInvalid="keep"))
    return FeatureModel(blocks, tfidf, divisors, Pipeline(stages=stages).fit(staged))


def _label(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(UNKNOWN))


def _classes(train: DataFrame, label: str) -> list[str]:
    """Sorted label values; one per class of the model."""
    return [r[0] for r in train.select(_label(label).alias("l")).distinct().orderBy("l").collect()]


def _with_code(df: DataFrame, label: str, classes: list[str]) -> DataFrame:
    code = F.array_position(F.lit(classes), _label(label)) - 1
    known = F.when(code >= 0, code).otherwise(F.raise_error(F.concat(F.lit("unseen label: "), _label(label))))
    return df.withColumn("_y", known.cast("double"))


def _estimator(kind: str, n_classes: int, **options):
    common = {"featuresCol": "features", "labelCol": "_y"}
    if kind == "logistic":
        return LogisticRegression(
            family="multinomial", weightCol="_weight", maxIter=options.get("max_iter", 50),
            regParam=options.get("reg_param", 1e-4), standardization=False, **common,
        )
    if kind == "boosted":
        one = GBTClassifier(
            maxIter=options.get("rounds", 1200), maxDepth=options.get("max_depth", 8),
            stepSize=options.get("learning_rate", 0.1), subsamplingRate=options.get("subsample", 0.9),
            validationIndicatorCol="_validation", validationTol=0.0, seed=options.get("seed", 42),
        )
        return OneVsRest(classifier=one, weightCol="_weight", rawPredictionCol="rawPrediction", parallelism=4, **common)
    raise ValueError(f"unknown kind of model: {kind}")


@dataclass(frozen=True)
class Classifier:
    """A fitted classifier: features, model, class names and a constant model name."""

    name: str
    features: FeatureModel
    model: object
    classes: list[str]

    def score(self, df: DataFrame) -> DataFrame:
        """Add ``predicted`` (class name) and ``confidence`` (its probability). Batch and streaming frames."""
        return _decode(self.model.transform(self.features.transform(df)), self.classes).drop("features")

    def save(self, spark: SparkSession, path: str) -> None:
        """Everything that scoring needs, for another session; replaces what is there."""
        _write_settings(spark, {"name": self.name, "classes": self.classes}, f"{path}/settings")
        self.features.save(spark, f"{path}/features")
        PipelineModel([self.model]).write().overwrite().save(f"{path}/model")

    @staticmethod
    def load(spark: SparkSession, path: str) -> "Classifier":
        kept = _read_settings(spark, f"{path}/settings")
        model = PipelineModel.load(f"{path}/model").stages[0]
        return Classifier(kept["name"], FeatureModel.load(spark, f"{path}/features"), model, kept["classes"])


def _decode(scored: DataFrame, classes: list[str]) -> DataFrame:
    if "probability" in scored.columns:
        confidence = F.array_max(vector_to_array("probability"))
    else:
        raw = vector_to_array("rawPrediction")
        total = F.aggregate(F.transform(raw, F.exp), F.lit(0.0), lambda a, x: a + x)
        confidence = F.exp(F.array_max(raw)) / total
    return scored.withColumns({
        "predicted": F.get(F.lit(classes), F.col("prediction").cast("int")), "confidence": confidence,
    }).drop("rawPrediction", "probability", "prediction")


def train_classifier(
    train: DataFrame, label: str, blocks: FeatureBlocks, kind: str = "logistic", validation: DataFrame | None = None,
    weighted: bool = True, text_settings: dict | None = None, **options,
) -> Classifier:
    """Fit features and a class-weighted model; ``boosted`` stops early on the validation rows."""
    classes = _classes(train, label)
    features = fit_features(train, blocks, text_settings)

    def coded(df: DataFrame, held_out: bool) -> DataFrame:
        rows = df.withColumn("_validation", F.lit(held_out))
        if weighted and not held_out:
            rows = with_class_weight(rows, label, "_weight")
        else:
            rows = rows.withColumn("_weight", F.lit(1.0))
        return _with_code(rows, label, classes)

    if kind == "forest":
        # It stores its own form of the rows, by far the smaller one.
        own = {c: options[c] for c in ("trees", "max_depth", "seed") if c in options}
        model = fit_forest(coded(train, False), features.width, len(classes), vectors=features.transform, **own)
        return Classifier(f"{kind}_category", features, model, classes)

    def ready(df: DataFrame, held_out: bool) -> DataFrame:
        return features.transform(coded(df, held_out)).select("features", "_y", "_weight", "_validation")

    rows = ready(train, False)
    if kind == "boosted" and validation is not None:
        rows = rows.unionByName(ready(validation, True))
    # Written, not cached: the estimators cache their own form of the rows, and two copies would not fit. A partition gives a
    # whole gradient in every iteration, so there are no more of them than run at once.
    rows = materialize(rows, "training-rows").coalesce(train.sparkSession.sparkContext.defaultParallelism)
    model = _estimator(kind, len(classes), **options).fit(rows)
    return Classifier(f"{kind}_category", features, model, classes)


@dataclass(frozen=True)
class TextModel:
    """Fitted featuriser of text alone: trimmed columns, joined by a separator line, as one vector."""

    text: list[str]
    tfidf: TfidfModel

    def transform(self, df: DataFrame, out: str = "features") -> DataFrame:
        return self.tfidf.transform_vector(df, concat_separated(*self.text), out)

    def save(self, spark: SparkSession, path: str) -> None:
        _write_settings(spark, {"text": list(self.text)}, f"{path}/settings")
        self.tfidf.save(spark, f"{path}/vectoriser")

    @staticmethod
    def load(spark: SparkSession, path: str) -> "TextModel":
        return TextModel(_read_settings(spark, f"{path}/settings")["text"], TfidfModel.load(spark, f"{path}/vectoriser"))


@dataclass(frozen=True)
class NetworkClassifier:
    """Features, truncated SVD, centring and scaling, then a feed-forward network."""

    name: str
    features: TextModel | FeatureModel
    svd: SvdModel
    scaler: CenterScaleModel
    model: object
    classes: list[str]

    def score(self, df: DataFrame) -> DataFrame:
        ready = _dense(self.features.transform(df, "_sparse"), self.svd, self.scaler)
        return _decode(self.model.transform(ready), self.classes).drop("features")

    def save(self, spark: SparkSession, path: str) -> None:
        """Everything that scoring needs, for another session; replaces what is there."""
        kept = {"name": self.name, "classes": self.classes, "text_only": isinstance(self.features, TextModel),
                "mean": self.scaler.mean, "std": self.scaler.std}
        _write_settings(spark, kept, f"{path}/settings")
        self.features.save(spark, f"{path}/features")
        self.svd.save(spark, f"{path}/svd")
        PipelineModel([self.model]).write().overwrite().save(f"{path}/model")

    @staticmethod
    def load(spark: SparkSession, path: str) -> "NetworkClassifier":
        kept = _read_settings(spark, f"{path}/settings")
        features = (TextModel if kept["text_only"] else FeatureModel).load(spark, f"{path}/features")
        scaler = CenterScaleModel(kept["mean"], kept["std"])
        model = PipelineModel.load(f"{path}/model").stages[0]
        return NetworkClassifier(kept["name"], features, SvdModel.load(spark, f"{path}/svd"), scaler, model, kept["classes"])


def _dense(df: DataFrame, svd: SvdModel, scaler: CenterScaleModel | None, vector: str = "_sparse") -> DataFrame:
    idx, val = vector_parts(vector)
    dense = svd.transform(df.withColumns({"idx": idx, "val": val}), "_dense").drop("idx", "val", vector)
    if scaler is None:
        return dense
    return scaler.transform(dense, "_dense", "_scaled").withColumn("features", array_to_vector("_scaled")).drop(
        "_dense", "_scaled"
    )


def _train_network(train, label, features, name, svd_dim, hidden, max_iter, seed) -> NetworkClassifier:
    classes = _classes(train, label)
    rows = _with_code(features.transform(train, "_sparse"), label, classes).select("_sparse", "_y").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        svd = fit_svd(rows, "_sparse", svd_dim)
        scaler = fit_center_scale(_dense(rows, svd, None), "_dense")
        layers = [len(svd.singular_values), hidden, max(64, hidden // 2), len(classes)]
        network = MultilayerPerceptronClassifier(
            layers=layers, featuresCol="features", labelCol="_y", maxIter=max_iter, seed=seed
        )
        model = network.fit(_dense(rows, svd, scaler))
    finally:
        rows.unpersist()
    return NetworkClassifier(name, features, svd, scaler, model, classes)


def train_text_network(
    train: DataFrame, label: str, text: list[str], svd_dim: int = TEXT_DIMENSIONS, hidden: int = 256, max_iter: int = 50,
    seed: int = 42, text_settings: dict | None = None,
) -> NetworkClassifier:
    """Text-only network on TF-IDF reduced to ``svd_dim`` dimensions."""
    joined = concat_separated(*text)
    tfidf = fit_tfidf(train, joined, **(text_settings or NETWORK_TEXT))
    return _train_network(train, label, TextModel(list(text), tfidf), "text_network", svd_dim, hidden, max_iter, seed)


def train_full_network(
    train: DataFrame, label: str, blocks: FeatureBlocks, svd_dim: int = FULL_DIMENSIONS, hidden: int = 256, max_iter: int = 50,
    seed: int = 42, text_settings: dict | None = None,
) -> NetworkClassifier:
    """Network on all feature blocks; the number of classes follows from the data."""
    features = fit_features(train, blocks, text_settings)
    return _train_network(train, label, features, "full_network", svd_dim, hidden, max_iter, seed)


def predictions(scored: DataFrame, model_name: str, from_text: bool = False) -> DataFrame:
    """The answer record of each scored ticket: class, confidence and rule-based tags."""
    sentiment = tags.text_sentiment() if from_text else tags.structured_sentiment()
    priority = tags.text_priority() if from_text else tags.structured_priority()
    return scored.select(
        "ticket_id", F.col("predicted").alias("category"), F.lit(None).cast("string").alias("subcategory"),
        priority.alias("priority"), sentiment.alias("sentiment"), "confidence", F.lit(model_name).alias("model"),
        F.array().cast("array<string>").alias("top_features"),
    )


def evaluate(classifier, test: DataFrame, label: str) -> DataFrame:
    return classification_report(classifier.score(test.withColumn("_actual", _label(label))), "_actual", "predicted")


def weighted_f1(classifier, test: DataFrame, label: str) -> DataFrame:
    return f1_weighted(classifier.score(test.withColumn("_actual", _label(label))), "_actual", "predicted")


def token_probe(train: DataFrame, label: str, text: list[str], top: int = 10, max_iter: int = 1000) -> DataFrame:
    """(class, rank, term, coefficient): the strongest terms of each class in a text-only linear model."""
    classes, joined = _classes(train, label), concat_training(*text)
    tfidf = fit_tfidf(train, joined, **CLASSIFIER_TEXT)
    rows = tfidf.transform(_with_code(train, label, classes), joined).select("idx", "val", F.col("_y").alias("y"))
    # A term of many documents has a small weight, so the weights order the terms by frequency.
    weights, _ = fit_multinomial(rows, len(classes), len(tfidf.terms), 1.0 / train.count(), np.argsort(tfidf.idf, kind="stable"), max_iter)
    terms = np.array(tfidf.terms, dtype=object)
    rows = []
    for name, row in zip(classes, weights):
        best = np.lexsort((terms.astype(str), -row))[:top]
        rows += [(name, i + 1, str(terms[j]), float(row[j])) for i, j in enumerate(best)]
    return train.sparkSession.createDataFrame(rows, "class string, rank int, term string, coefficient double")


def ablation(train: DataFrame, test: DataFrame, label: str, blocks: FeatureBlocks, **options) -> DataFrame:
    """(variant, f1_weighted, accuracy) of the same model on text alone and on everything but text."""
    parts = {"text_only": blocks.text_only(), "without_text": blocks.without_text()}
    scores = [
        weighted_f1(train_classifier(train, label, b, **options), test, label).withColumn("variant", F.lit(v))
        for v, b in parts.items()
    ]
    return scores[0].unionByName(scores[1]).select("variant", "f1_weighted", "accuracy")


def shuffle_sanity(
    train: DataFrame, test: DataFrame, label: str, id_col: str, blocks: FeatureBlocks, seed: int = 42, **options
) -> DataFrame:
    """Scores of a model trained on permuted labels; anything above chance means leakage."""
    permuted = shuffle_labels(train, id_col, label, seed, "_permuted").drop(label).withColumnRenamed("_permuted", label)
    # Training reads its rows several times; the permutation moves every text and is done once.
    permuted = materialize(permuted, "permuted-labels")
    return weighted_f1(train_classifier(permuted, label, blocks, **options), test, label)
