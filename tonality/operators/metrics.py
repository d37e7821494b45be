"""Evaluation: confusion matrix, classification report, F1 scores, weighted log loss, records.

The big input is touched once, by a ``groupBy(truth, prediction).count()`` with map-side
partial counts; everything after works on at most classes^2 rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonality.functions.labels import CLASS_NAMES
from tonality.functions.text import run_stamp


def literal_rows(spark: SparkSession, rows: list[tuple], names: list[str], types: list[str]) -> DataFrame:
    """A small literal table built on the JVM (no Python-side row shipping)."""
    structs = [F.struct(*[F.lit(v).cast(t).alias(n) for v, n, t in zip(r, names, types)]) for r in rows]
    return spark.range(1).select(F.explode(F.array(*structs)).alias("_r")).select("_r.*")


def _grid(spark: SparkSession, labels, truth: str, pred: str) -> DataFrame:
    rows = [(int(t), int(p)) for t in labels for p in labels]
    return literal_rows(spark, rows, [truth, pred], ["int", "int"])


def confusion_counts(df: DataFrame, truth: str = "truth", pred: str = "prediction") -> DataFrame:
    """Pair counts of the input (the only pass over the data)."""
    return (df.groupBy(F.col(truth).cast("int").alias(truth), F.col(pred).cast("int").alias(pred))
            .agg(F.count(F.lit(1)).alias("count")))


def confusion_matrix(df: DataFrame, truth: str = "truth", pred: str = "prediction", labels=(0, 1, 2),
                     from_counts: bool = False) -> DataFrame:
    """Long form ``truth, prediction, count`` on the fixed label grid (rows = truth); pairs with a
    label outside the grid are left out, as with an explicit label list."""
    counts = df if from_counts else confusion_counts(df, truth, pred)
    grid = _grid(df.sparkSession, labels, truth, pred)
    return (grid.join(counts, [truth, pred], "left")
            .select(truth, pred, F.coalesce("count", F.lit(0)).cast("long").alias("count")))


def matrix_rows(cm: DataFrame, truth: str = "truth", pred: str = "prediction", labels=(0, 1, 2)) -> DataFrame:
    """A6 as one row: ``array<array<bigint>>`` with rows = truth, columns = prediction."""
    k = len(labels)
    return cm.agg(F.array(*[
        F.array(*[F.sum(F.when((F.col(truth) == t) & (F.col(pred) == p), F.col("count")).otherwise(0)).cast("long")
                  for p in labels]) for t in labels]).alias("confusion_matrix")) if k else cm


def _class_totals(cm: DataFrame, truth: str, pred: str) -> DataFrame:
    """Per label: ``support`` (truth count), ``predicted`` and ``tp``, in one aggregate over the pair counts."""
    both = F.array(
        F.struct(F.col(truth).alias("label"), F.col("count").alias("s"), F.lit(0).cast("long").alias("q"),
                 F.when(F.col(truth) == F.col(pred), F.col("count")).otherwise(0).cast("long").alias("t")),
        F.struct(F.col(pred).alias("label"), F.lit(0).cast("long").alias("s"), F.col("count").alias("q"),
                 F.lit(0).cast("long").alias("t")))
    return (cm.select(F.explode(both).alias("e")).select("e.*").groupBy("label")
            .agg(F.sum("s").alias("support"), F.sum("q").alias("predicted"), F.sum("t").alias("tp")))


def _ratios(j: DataFrame) -> DataFrame:
    p = F.coalesce(F.try_divide(F.col("tp"), F.nullif(F.col("predicted"), F.lit(0.0))), F.lit(0.0))
    r = F.coalesce(F.try_divide(F.col("tp"), F.nullif(F.col("support"), F.lit(0.0))), F.lit(0.0))
    j = j.withColumn("precision", p).withColumn("recall", r)
    f1 = F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"),
                                 F.nullif(F.col("precision") + F.col("recall"), F.lit(0.0))), F.lit(0.0))
    return j.withColumn("f1", f1)


def _per_class(cm: DataFrame, truth: str, pred: str, labels) -> DataFrame:
    spark = cm.sparkSession
    lab = literal_rows(spark, [(int(c), CLASS_NAMES[c] if 0 <= c < len(CLASS_NAMES) else str(c)) for c in labels],
                       ["label", "class"], ["int", "string"])
    tot = _class_totals(cm, truth, pred)
    j = (lab.join(tot, "label", "left")
         .select("label", "class",
                 F.coalesce("support", F.lit(0)).cast("double").alias("support"),
                 F.coalesce("predicted", F.lit(0)).cast("double").alias("predicted"),
                 F.coalesce("tp", F.lit(0)).cast("double").alias("tp")))
    return _ratios(j)


def classification_report(df: DataFrame, truth: str = "truth", pred: str = "prediction", labels=(0, 1, 2),
                          from_counts: bool = False) -> DataFrame:
    """Rows per class (precision, recall, f1, support) plus ``accuracy``, ``macro avg``, ``weighted avg``.

    Undefined ratios count as 0. Averages run over the fixed ``labels`` list. The accuracy row
    carries the accuracy in ``f1`` (precision and recall null), like the text report.
    """
    cm = df if from_counts else confusion_counts(df, truth, pred)
    pc = _per_class(cm, truth, pred, labels)
    cls = pc.select("label", "class", "precision", "recall", "f1", "support")
    n = F.sum("support")
    summary = pc.agg(
        F.avg("precision").alias("m_p"), F.avg("recall").alias("m_r"), F.avg("f1").alias("m_f"),
        F.try_divide(F.sum(F.col("precision") * F.col("support")), n).alias("w_p"),
        F.try_divide(F.sum(F.col("recall") * F.col("support")), n).alias("w_r"),
        F.try_divide(F.sum(F.col("f1") * F.col("support")), n).alias("w_f"),
        F.try_divide(F.sum("tp"), n).alias("acc"), n.alias("n"))
    def row(i, name, p, r, f):
        return F.struct(F.lit(i).cast("int").alias("label"), F.lit(name).alias("class"),
                        p.cast("double").alias("precision"), r.cast("double").alias("recall"),
                        f.cast("double").alias("f1"), F.col("n").cast("double").alias("support"))

    k = len(labels)
    avg_rows = summary.select(F.explode(F.array(
        row(k, "accuracy", F.lit(None), F.lit(None), F.coalesce("acc", F.lit(0.0))),
        row(k + 1, "macro avg", F.col("m_p"), F.col("m_r"), F.col("m_f")),
        row(k + 2, "weighted avg", F.coalesce("w_p", F.lit(0.0)), F.coalesce("w_r", F.lit(0.0)),
            F.coalesce("w_f", F.lit(0.0))),
    )).alias("r")).select("r.*")
    return cls.unionByName(avg_rows).orderBy("label").drop("label")


def f1_scores(df: DataFrame, truth: str = "truth", pred: str = "prediction", from_counts: bool = False) -> DataFrame:
    """``f1_macro`` over the classes seen in truth or prediction (no fixed list, as the
    reference's f1 call), ``f1_weighted`` (weights = truth support) and ``accuracy``; one row."""
    tot = _class_totals(df if from_counts else confusion_counts(df, truth, pred), truth, pred)
    j = tot.select(F.col("support").cast("double").alias("s"), F.col("predicted").cast("double").alias("q"),
                   F.col("tp").cast("double").alias("t"))
    # f1 = 2 tp / (support + predicted); 0 when both are 0
    j = j.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("t"), F.nullif(F.col("s") + F.col("q"), F.lit(0.0))),
                                      F.lit(0.0)))
    return j.agg(F.avg("f1").alias("f1_macro"),
                 F.coalesce(F.try_divide(F.sum(F.col("f1") * F.col("s")), F.sum("s")), F.lit(0.0)).alias("f1_weighted"),
                 F.coalesce(F.try_divide(F.sum("t"), F.sum("s")), F.lit(0.0)).alias("accuracy"))


def weighted_log_loss(df: DataFrame, probs: str, label: str, weight: str = "weight",
                      by: list[str] | tuple = ()) -> DataFrame:
    """A10: ``sum(w * -log p[label]) / sum(w)`` over each group of ``by`` (the weighted cross-entropy
    over a whole split, independent of batch size).

    Rows whose label has no entry in the vector, or without a weight, count in ``rows`` only; no
    weight at all gives a null loss."""
    p = F.try_element_at(F.col(probs), (F.when(F.col(label) >= 0, F.col(label)) + 1).cast("int"))
    nll = F.when(p.isNotNull(), -F.log(F.greatest(p, F.lit(1e-300))))
    w = F.when(nll.isNotNull(), F.col(weight))
    return df.groupBy(*by).agg(
        F.try_divide(F.sum(w * nll), F.sum(w)).alias("log_loss"),
        F.count(F.lit(1)).alias("rows"))


def evaluation_record(df: DataFrame, run_id: str, truth: str = "truth", pred: str = "prediction",
                      weights: list[float] | None = None, labels=(0, 1, 2)) -> DataFrame:
    """One-row record ``run_id, stamp, f1_weighted, f1_macro, accuracy, confusion_matrix,
    per_class_metrics (map<string, struct>), weights_used``."""
    from tonality.session import materialize

    # one pass over the input: everything is derived from its pair counts, written once
    counts = materialize(confusion_counts(df, truth, pred), "confusion")
    mat = matrix_rows(confusion_matrix(counts, truth, pred, labels, from_counts=True), truth, pred, labels)
    rep = classification_report(counts, truth, pred, labels, from_counts=True)
    per = rep.agg(F.map_from_entries(F.collect_list(F.struct(
        "class", F.struct("precision", "recall", "f1", "support")))).alias("per_class_metrics"))
    f1s = f1_scores(counts, truth, pred, from_counts=True)
    w = F.array(*[F.lit(float(x)) for x in weights]) if weights else F.lit(None).cast("array<double>")
    one = F.lit(1).alias("_k")
    rec = (f1s.select("*", one).join(mat.select("*", one), "_k").join(per.select("*", one), "_k")
           .select(F.lit(run_id).alias("run_id"),
                   run_stamp().alias("stamp"),
                   "f1_weighted", "f1_macro", "accuracy", "confusion_matrix", "per_class_metrics",
                   w.alias("weights_used")))
    return rec


def latest_record(records: DataFrame) -> DataFrame:
    """The newest record (largest stamp, then run_id) as one row."""
    return records.orderBy(F.desc("stamp"), F.desc("run_id")).limit(1)


def csv_record(records: DataFrame) -> DataFrame:
    """A8 as CSV columns: the nested ones become JSON text (lists of lists, objects by class)."""
    as_json = {c: F.to_json(c).alias(c) for c in ("confusion_matrix", "per_class_metrics", "weights_used")}
    return records.select(*[as_json.get(c, F.col(c)) for c in records.columns])


def read_csv_record(df: DataFrame) -> DataFrame:
    """The inverse of ``csv_record`` for a headed CSV read with every field as text."""
    kinds = {"f1_weighted": "double", "f1_macro": "double", "accuracy": "double"}
    nested = {"confusion_matrix": "array<array<bigint>>", "weights_used": "array<double>",
              "per_class_metrics": "map<string,struct<precision:double,recall:double,f1:double,support:double>>"}
    return df.select(*[F.from_json(c, nested[c]).alias(c) if c in nested
                       else F.col(c).cast(kinds.get(c, "string")).alias(c) for c in df.columns])


def latest_summary(records: DataFrame) -> DataFrame:
    """The three-column record of the newest run: ``F1_weighted, F1_macro, Confusion_matrix`` (JSON text)."""
    return latest_record(records).select(F.col("f1_weighted").alias("F1_weighted"), F.col("f1_macro").alias("F1_macro"),
                                         F.to_json("confusion_matrix").alias("Confusion_matrix"))


def append_records(records: DataFrame, path: str) -> None:
    """Add evaluation records to a Parquet table (one row per run, keyed by ``run_id``)."""
    records.write.mode("append").parquet(path)
