"""A registry of fitted models (S11): parameters per run, and one row of metrics that makes a run visible.

A registry folder holds runs of one kind: scoring models (``load``) or text models (``load_text``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonality.functions.text import run_stamp
from tonality.operators.model import TextBaseline
from tonality.operators.text_model import load_text_model, save_text_model
from tonality.plans.scoring import ScoringModel, load_scoring_model, save_scoring_model


def register(spark: SparkSession, path: str, run_id: str, model: ScoringModel | TextBaseline, metrics: dict[str, float]) -> None:
    """Store the model of a run, then its row ``run_id, at, stamp, metrics``: a run that broke off before the row is never loaded."""
    if isinstance(model, TextBaseline):
        save_text_model(model, f"{path}/models/{run_id}")
    else:
        save_scoring_model(spark, model, f"{path}/models/{run_id}")
    row = spark.createDataFrame([(run_id, metrics)], "run_id string, metrics map<string,double>")
    row.select("run_id", F.current_timestamp().alias("at"), run_stamp().alias("stamp"), "metrics").write.mode("append").parquet(f"{path}/runs")


def runs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/runs")


def chosen(found: DataFrame, metric: str | None = None, largest: bool = False) -> str:
    """The run with the smallest (or ``largest``) value of a metric, ties to the newest; without a metric the newest run."""
    newest = [F.col("at"), F.col("run_id")]
    if metric is None:
        order = F.struct(*newest)
    else:
        value = F.col("metrics")[metric]
        found = found.where(value.isNotNull() & ~F.isnan(value))
        order = F.struct(value if largest else -value, *newest)
    run = found.agg(F.max_by("run_id", order)).first()[0]
    if run is None:
        raise ValueError("no run" if metric is None else f"no run with {metric}")
    return run


def load(spark: SparkSession, path: str, metric: str | None = None, largest: bool = False) -> ScoringModel:
    """The model of the best run by ``metric``, or of the newest."""
    return load_scoring_model(spark, f"{path}/models/{chosen(runs(spark, path), metric, largest)}")


def load_text(spark: SparkSession, path: str, metric: str | None = None, largest: bool = False) -> TextBaseline:
    """The text model of the best run by ``metric``, or of the newest."""
    return load_text_model(spark, f"{path}/models/{chosen(runs(spark, path), metric, largest)}")
