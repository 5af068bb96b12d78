"""Customer-value classifier on MLlib: scaler + class-balanced random forest over the 14
features, hold-out stratified exactly by label, metrics from (label, prediction) aggregates, k-fold CV."""

from __future__ import annotations

import math

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import CV_FOLDS, MAX_DEPTH, N_TREES, SPLIT_SEED, TRAIN_FRACTION, VALUE_FEATURES
from ..functions.ranking import running_total
from ..session import materialize


def with_rank(labeled: DataFrame, key: str = "user_id", label: str = "value_label", seed: int = SPLIT_SEED) -> DataFrame:
    """Each row's place ``_rank`` (from 0) among those of its label, in the order of a keyed hash, and
    their number ``_n``: any cut of the places is a split stratified exactly by label."""
    h = labeled.withColumn("_h", F.md5(F.concat(F.lit(f"{seed}:"), F.col(key)))).withColumn("_one", F.lit(1))
    ranked = running_total(h, ["_h", key], "_one", "_rank", [label]).drop("_h", "_one")
    sizes = ranked.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    return ranked.join(sizes, label)


def held_out(fraction: float = 1 - TRAIN_FRACTION):
    """The first ``fraction`` of each label's places, rounded, is the test set."""
    return F.col("_rank") < F.round(F.col("_n") * fraction)


def class_weights(train: DataFrame, label: str = "value_label") -> DataFrame:
    """Balanced weight n / (k * n_label) per row (k = number of labels present)."""
    counts = train.groupBy(label).agg(F.count(F.lit(1)).alias("_nl"))
    n = train.agg(F.count(F.lit(1))).scalar()
    k = counts.agg(F.count(F.lit(1))).scalar()
    w = counts.select(label, (n / (k * F.col("_nl"))).alias("weight"))
    return train.join(F.broadcast(w), label)  # one row per label: bounded by the label set


def build_pipeline(num_trees: int = N_TREES, max_depth: int = MAX_DEPTH, seed: int = SPLIT_SEED) -> Pipeline:
    va = VectorAssembler(inputCols=VALUE_FEATURES, outputCol="raw_features", handleInvalid="keep")
    sc = StandardScaler(inputCol="raw_features", outputCol="features", withMean=True, withStd=True)
    rf = RandomForestClassifier(labelCol="value_label", featuresCol="features", weightCol="weight",
                                numTrees=num_trees, maxDepth=max_depth, seed=seed)
    return Pipeline(stages=[va, sc, rf])


def _prepare(df: DataFrame) -> DataFrame:
    return df.select("user_id", "value_label", *[F.col(c).cast("double").alias(c) for c in VALUE_FEATURES])


def train_value_model(labeled: DataFrame, train_fraction: float = TRAIN_FRACTION,
                      num_trees: int = N_TREES, max_depth: int = MAX_DEPTH):
    """Returns (fitted PipelineModel, test predictions DataFrame)."""
    # the forest makes one pass per tree level: materialise the features once
    d = materialize(with_rank(_prepare(labeled)).withColumn("_test", held_out(1 - train_fraction)))
    train = class_weights(d.filter("not _test"))
    test = d.filter("_test")
    model = build_pipeline(num_trees, max_depth).fit(train)
    return model, model.transform(test)


def classification_metrics(pred: DataFrame, label: str = "value_label",
                           prediction: str = "prediction") -> DataFrame:
    """Per label: precision, recall, F1, support; plus accuracy, macro F1 and weighted F1 on
    every row. Pure aggregations over (label, prediction)."""
    pairs = pred.select(F.col(label).cast("int").alias("y"), F.col(prediction).cast("int").alias("p"))
    # the only pass over the predictions: one row per (label, prediction)
    seen = materialize(pairs.groupBy("y", "p").agg(F.count(F.lit(1)).alias("n")))
    sides = seen.select(F.explode(F.array(
        F.struct(F.col("y").alias("label"), F.col("n").alias("is"), F.lit(0).cast("bigint").alias("said"), F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0).alias("both")),
        F.struct(F.col("p").alias("label"), F.lit(0).cast("bigint").alias("is"), F.col("n").alias("said"), F.lit(0).cast("bigint").alias("both")))).alias("s")).select("s.*")
    m = sides.groupBy("label").agg(F.sum("is").alias("support"), F.sum("said").alias("said"), F.sum("both").alias("both"))
    share = lambda of: F.when(F.col(of) > 0, F.col("both") / F.col(of)).otherwise(0.0)
    m = m.withColumn("precision", share("said")).withColumn("recall", share("support"))
    f1 = 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))
    m = m.withColumn("f1", F.when(F.col("both") > 0, f1).otherwise(0.0))
    every = Window.partitionBy()  # one row per label
    return m.select(
        "label", "precision", "recall", "f1", F.col("support").cast("bigint").alias("support"),
        (F.sum("both").over(every) / F.sum("support").over(every)).alias("accuracy"), F.avg("f1").over(every).alias("macro_f1"),
        (F.sum(F.col("f1") * F.col("support")).over(every) / F.sum("support").over(every)).alias("weighted_f1"))


def with_folds(labeled: DataFrame, folds: int = CV_FOLDS) -> DataFrame:
    """Each row's fold ``_fold``: the folds share out each label's rows evenly."""
    return with_rank(labeled).withColumn("_fold", F.col("_rank") % folds)


def cross_validate(labeled: DataFrame, folds: int = CV_FOLDS, num_trees: int = N_TREES,
                   max_depth: int = MAX_DEPTH) -> DataFrame:
    """k stratified folds; one fit per fold (a distributed fit each); macro F1 per fold, then mean
    and population std (ddof 0) as one row."""
    d = materialize(with_folds(_prepare(labeled), folds))
    scores = []
    for k in range(folds):
        train = class_weights(d.filter(F.col("_fold") != k))
        test = d.filter(F.col("_fold") == k)
        model = build_pipeline(num_trees, max_depth).fit(train)
        mf = classification_metrics(model.transform(test)).select("macro_f1").limit(1).collect()
        scores.append(float(mf[0][0]) if mf else 0.0)
    mean = sum(scores) / len(scores)
    std = math.sqrt(sum((s - mean) ** 2 for s in scores) / len(scores))
    spark = labeled.sparkSession
    return spark.createDataFrame([(folds, mean, std)], "folds int, cv_macro_f1_mean double, cv_macro_f1_std double")


def feature_importance(model: PipelineModel) -> DataFrame:
    """Importances of the 14 features, descending, 4 decimals (14 rows: bounded)."""
    from pyspark.sql import SparkSession
    vals = model.stages[-1].featureImportances.toArray().tolist()
    s = SparkSession.getActiveSession()
    rows = [(f, round(float(v), 4)) for f, v in zip(VALUE_FEATURES, vals)]
    return s.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"))


def unlabeled_rows(users: DataFrame, labeled: DataFrame, cart: DataFrame) -> DataFrame:
    """A mostly-zero feature row for each user without a label: add_count = their cart size,
    unique_sessions = 1 (the notifier's fallback)."""
    uid = users.select(F.col("id").cast("string").alias("user_id"))
    missing = uid.join(labeled.select("user_id"), "user_id", "left_anti")
    size = cart.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_items"))
    return missing.join(size, "user_id", "left").select(
        "user_id", *[(F.coalesce(F.col("n_items"), F.lit(0)) if c == "add_count"
                      else F.lit(1) if c == "unique_sessions" else F.lit(0)).cast("double").alias(c)
                     for c in VALUE_FEATURES])


def score_unlabeled(model: PipelineModel, users: DataFrame, labeled: DataFrame, cart: DataFrame) -> DataFrame:
    """Users without a label get a prediction from their fallback row."""
    return model.transform(unlabeled_rows(users, labeled, cart)).select("user_id", F.col("prediction").cast("int").alias("value_label"))
