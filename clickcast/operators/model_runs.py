"""Model runs: fitted models saved with their metric, champions among them, rollback, scoring.

A folder holds the models (``models/<run>``) and an append-only log of events (``log``). A model is
saved before its run is logged, so a logged run always has a whole model. A run that is withdrawn
counts no more, and the champion is the one that the remaining runs give.
"""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import champion as CH
from . import value_model as VM
from .sinks import read_parquet_or_empty

LOG = "model_name string, run_id string, run_time timestamp, event string, metric double, params string"


def _log(spark: SparkSession, root: str, row: tuple) -> None:
    spark.createDataFrame([row], LOG).coalesce(1).write.mode("append").parquet(f"{root}/log")


def _now() -> dt.datetime:
    return dt.datetime.now(dt.timezone.utc)


def log(spark: SparkSession, root: str) -> DataFrame:
    """All events, none before the first run."""
    return read_parquet_or_empty(spark, f"{root}/log", LOG)


def record(spark: SparkSession, root: str, model_name: str, model: PipelineModel, metric: float | None, params: str = "",
           run_id: str | None = None, run_time: dt.datetime | None = None) -> str:
    """Saves the model, then logs its run; returns the run's id. A run without a metric is never champion."""
    run_id = run_id or uuid.uuid4().hex
    if log(spark, root).filter((F.col("event") == "fitted") & (F.col("run_id") == run_id)).head(1):
        raise ValueError(f"run {run_id} is logged already")
    model.write().overwrite().save(f"{root}/models/{run_id}")  # a save that broke off may be there
    _log(spark, root, (model_name, run_id, run_time or _now(), "fitted", metric, params))
    return run_id


def withdraw(spark: SparkSession, root: str, run_id: str) -> None:
    """Rolls back: the run counts no more. Withdrawing it twice changes nothing."""
    found = log(spark, root).filter((F.col("event") == "fitted") & (F.col("run_id") == run_id)).select("model_name").head(1)
    if not found:
        raise ValueError(f"no run {run_id}")
    _log(spark, root, (found[0][0], run_id, _now(), "withdrawn", None, ""))


def runs(spark: SparkSession, root: str) -> DataFrame:
    """The runs that count: (model_name, run_id, run_time, metric, params)."""
    events = log(spark, root)
    gone = events.filter("event = 'withdrawn'").select("run_id").distinct()
    return events.filter("event = 'fitted'").join(gone, "run_id", "left_anti").select("model_name", "run_id", "run_time", "metric", "params")


def history(spark: SparkSession, root: str) -> DataFrame:
    return CH.champion_history(runs(spark, root))


def champion(spark: SparkSession, root: str, model_name: str) -> tuple[str, PipelineModel]:
    """The reigning champion's run and model."""
    found = CH.current_champions(history(spark, root).filter(F.col("model_name") == model_name)).head(1)
    if not found:
        raise LookupError(f"{model_name} has no champion")
    return found[0].champion_run, PipelineModel.load(f"{root}/models/{found[0].champion_run}")


def fit_value_model(labeled: DataFrame, root: str, model_name: str = "customer_value", num_trees: int = VM.N_TREES, max_depth: int = VM.MAX_DEPTH,
                    run_id: str | None = None, run_time: dt.datetime | None = None) -> str:
    """A fit on the training rows, recorded with the macro F1 of the held-out ones (none: no metric)."""
    model, held_out = VM.train_value_model(labeled, num_trees=num_trees, max_depth=max_depth)
    got = VM.classification_metrics(held_out).select("macro_f1").head(1)
    return record(labeled.sparkSession, root, model_name, model, got[0][0] if got else None, f"trees={num_trees} depth={max_depth}", run_id, run_time)


def score_by_champion(users: DataFrame, labeled: DataFrame, cart: DataFrame, root: str, model_name: str = "customer_value") -> DataFrame:
    """Users without a label -> (user_id, value_label, champion_run) by the reigning champion."""
    run_id, model = champion(users.sparkSession, root, model_name)
    return VM.score_unlabeled(model, users, labeled, cart).withColumn("champion_run", F.lit(run_id))
