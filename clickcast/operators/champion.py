"""Champion selection over a table of model runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def champion_history(runs: DataFrame, model: str = "model_name", run: str = "run_id",
                     order: str = "run_time", metric: str = "metric",
                     higher_is_better: bool = True) -> DataFrame:
    """A run becomes champion iff its metric is strictly better than the reigning
    champion's (or there is none yet); a run without the metric, or with NaN, is never promoted.

    The reigning champion's metric is the best metric of all earlier runs (a running
    max/min over the rows before the current one), so promotions need no iteration."""
    runs = runs.withColumn(metric, F.when(~F.isnan(metric), F.col(metric)))
    w = Window.partitionBy(model).orderBy(order, run).rowsBetween(Window.unboundedPreceding, -1)
    best_before = F.max(metric).over(w) if higher_is_better else F.min(metric).over(w)
    better = (F.col(metric) > F.col("_best")) if higher_is_better else (F.col(metric) < F.col("_best"))
    h = runs.withColumn("_best", best_before).withColumn(
        "promoted", F.col(metric).isNotNull() & (F.col("_best").isNull() | better))
    wc = Window.partitionBy(model).orderBy(order, run).rowsBetween(Window.unboundedPreceding, 0)
    h = h.withColumn("champion_run", F.last(F.when(F.col("promoted"), F.col(run)), ignorenulls=True).over(wc))
    return h.withColumnRenamed("_best", "champion_metric_before")


def current_champions(history: DataFrame, model: str = "model_name", order: str = "run_time",
                      run: str = "run_id") -> DataFrame:
    """The latest promoted run per model (an aggregate, no window)."""
    p = history.filter(F.col("promoted"))
    return p.groupBy(model).agg(F.max(F.struct(order, run)).alias("c")).select(
        model, F.col(f"c.{run}").alias("champion_run"))
