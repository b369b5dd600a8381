"""Per-target text classifiers with class weights, run selection and scoring
(T1, T2, C1), re-aimed from a GPU transformer to Spark ML.

Layout of a model bundle: one shared feature pipeline (tokens -> hashed term
counts -> IDF) under ``features`` and one multinomial logistic regression per
target under the target's name, as the reference shares one tokenizer between
per-target models.  Training reads the train split only; the class weights of
A1 are joined in as a weight column (the weight table has one row per class
and is broadcast).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textstrata.operators.pick import rank_scores
from textstrata.operators.stats import balanced_class_weights

FEATURES = "features"
NUM_FEATURES = 1 << 16
EPOCHS = 10


def _featuriser(text_col: str, num_features: int) -> tuple[RegexTokenizer, HashingTF]:
    return (RegexTokenizer(inputCol=text_col, outputCol="_ts_tokens", pattern=r"[^\p{L}\p{N}]+",
                           toLowercase=True),
            HashingTF(inputCol="_ts_tokens", outputCol="_ts_tf", numFeatures=num_features))


def featurise_for_training(train: DataFrame, text_col: str, keep: Sequence[str],
                           num_features: int = NUM_FEATURES) -> tuple[PipelineModel, DataFrame, DataFrame]:
    """Fit the featuriser; returns it, the training features and the persisted term counts.

    Texts are tokenised and hashed once: the term counts are persisted, IDF is
    fitted on them and the features are derived from them.  The caller
    unpersists the last frame; persisted blocks lost with an executor are
    recomputed from the lineage.
    """
    tok, tf = _featuriser(text_col, num_features)
    # Every optimiser iteration is a pass over these rows: even them out once, in
    # partitions of the advisory size, before tokenising and persisting them.
    spread = train.hint("rebalance")
    counts = tf.transform(tok.transform(spread)).select("_ts_tf", *keep) \
        .persist(StorageLevel.MEMORY_AND_DISK)
    idf = IDF(inputCol="_ts_tf", outputCol=FEATURES).fit(counts)
    return PipelineModel(stages=[tok, tf, idf]), idf.transform(counts), counts


def _with_weights(df: DataFrame, label_col: str, weights: DataFrame | None) -> DataFrame:
    if weights is None:
        return df.withColumn("_ts_w", F.lit(1.0))
    w = weights.select(F.col("label_id").alias(label_col), F.col("weight").alias("_ts_w"))
    # one row per class: by a shuffle all rows of a class would meet in one task, and AQE keeps that shuffle
    # where most of its partitions are empty
    return df.join(F.broadcast(w), label_col, "left").withColumn("_ts_w", F.coalesce("_ts_w", F.lit(1.0)))


def fit_target(featured: DataFrame, label_col: str, weights: DataFrame | None = None,
               max_iter: int = EPOCHS, reg_param: float = 0.0, target: str = "t") -> PipelineModel:
    """T1 for one target: weighted multinomial logistic regression on the features."""
    rows = _with_weights(featured.where(F.col(label_col).isNotNull()), label_col, weights)
    lr = LogisticRegression(featuresCol=FEATURES, labelCol=label_col, weightCol="_ts_w",
                            family="multinomial", maxIter=max_iter, regParam=reg_param,
                            predictionCol=f"_ts_pred_{target}", probabilityCol=f"_ts_prob_{target}",
                            rawPredictionCol=f"_ts_raw_{target}")
    return Pipeline(stages=[lr]).fit(rows)


def train_models(train: DataFrame, text_col: str, label_cols: Mapping[str, str],
                 weights: Mapping[str, DataFrame] | None = None, max_iter: int = EPOCHS,
                 reg_param: float = 0.0, num_features: int = NUM_FEATURES,
                 weight_mapping: Mapping[str, int] | None = None) -> dict[str, PipelineModel]:
    """The shared featuriser and one classifier per target.

    Class weights come from ``weights`` (one ``(label_id, weight)`` table per
    target) or, with ``weight_mapping``, are computed as balanced weights (A1)
    from the persisted training rows themselves.
    """
    features, featured, cached = featurise_for_training(train, text_col, list(label_cols.values()), num_features)
    try:
        models: dict[str, PipelineModel] = {"features": features}
        for target, label_col in label_cols.items():
            w = (weights or {}).get(target)
            if w is None and weight_mapping is not None:
                w = balanced_class_weights(featured, label_col, weight_mapping, split_col=None)
            models[target] = fit_target(featured, label_col, w, max_iter, reg_param, target)
        return models
    finally:
        cached.unpersist()


def accuracy(model: PipelineModel, featured: DataFrame, label_col: str, target: str) -> DataFrame:
    """Share of rows whose predicted id equals ``label_col``; one row."""
    scored = model.transform(featured.where(F.col(label_col).isNotNull()))
    hit = (F.col(f"_ts_pred_{target}").cast("int") == F.col(label_col)).cast("double")
    return scored.agg(F.avg(hit).alias("accuracy"))


def best_run(train: DataFrame, test: DataFrame, text_col: str, label_cols: Mapping[str, str],
             candidates: Sequence[Mapping[str, float]], weights: Mapping[str, DataFrame] | None = None,
             num_features: int = NUM_FEATURES) -> tuple[DataFrame, dict[str, PipelineModel]]:
    """Fit every candidate setting per target, evaluate accuracy on the test
    split, keep the best per target (ties: the first run).

    Returns the ``(target, run, max_iter, reg_param, accuracy, best)`` table and
    the chosen models.  Each fit and evaluation is a distributed job; only one
    number per run reaches the driver.
    """
    spark = train.sparkSession
    features, f_train, cached = featurise_for_training(train, text_col, list(label_cols.values()), num_features)
    f_test = features.transform(test).select(FEATURES, *label_cols.values()).persist(StorageLevel.MEMORY_AND_DISK)
    rows, chosen = [], {"features": features}
    try:
        for target, label_col in label_cols.items():
            best_acc, best_model = None, None
            for run, params in enumerate(candidates):
                m = fit_target(f_train, label_col, (weights or {}).get(target),
                               int(params.get("max_iter", EPOCHS)), float(params.get("reg_param", 0.0)), target)
                acc = accuracy(m, f_test, label_col, target).first()["accuracy"]
                rows.append((target, run, int(params.get("max_iter", EPOCHS)),
                             float(params.get("reg_param", 0.0)), acc))
                if best_acc is None or (acc is not None and acc > best_acc):
                    best_acc, best_model = acc, m
            chosen[target] = best_model
    finally:
        cached.unpersist()
        f_test.unpersist()
    table = spark.createDataFrame(rows, "target string, run int, max_iter int, reg_param double, accuracy double")
    first_best = F.min_by("run", F.struct(-F.col("accuracy"), F.col("run"))).over(
        Window.partitionBy("target"))
    return table.withColumn("best", F.col("run") == first_best), chosen


def score(df: DataFrame, models: Mapping[str, PipelineModel], targets: Sequence[str],
          num_labels: int, out_prefix: str = "s_") -> DataFrame:
    """The full class distribution per target as ``<prefix><target>: array<double>``
    of length ``num_labels`` (classes the model never saw score 0)."""
    out = models["features"].transform(df)
    for t in targets:
        out = models[t].transform(out)
        arr = vector_to_array(F.col(f"_ts_prob_{t}"))
        out = out.withColumn(f"{out_prefix}{t}", F.concat(
            arr, F.array_repeat(F.lit(0.0), F.greatest(F.lit(num_labels) - F.size(arr), F.lit(0)))))
        out = out.drop(f"_ts_prob_{t}", f"_ts_raw_{t}", f"_ts_pred_{t}")
    return out.drop("_ts_tokens", "_ts_tf", FEATURES)


def ranked_scores(df: DataFrame, targets: Sequence[str], id2name: Mapping[int, str],
                  prefix: str = "s_") -> DataFrame:
    """C1 output form: per target the ranked ``(label_id, label, score)`` list."""
    return df.select("*", *[rank_scores(f"{prefix}{t}", id2name).alias(f"{t}_ranked") for t in targets])
