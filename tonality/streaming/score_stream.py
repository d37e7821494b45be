"""ST1: stateless scoring of a stream of ``text, emoji, sticker`` requests.

The request route of the reference becomes a Structured Streaming query: JSON files (or any
streaming source with the same schema) in, ``request_id, sentiment, confidence`` out, with a
checkpoint so a restarted query neither loses nor repeats a file.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tonality.plans.scoring import ScoringModel, score_messages

REQUEST_SCHEMA = T.StructType([
    T.StructField("request_id", T.StringType(), True),
    T.StructField("text", T.StringType(), True),
    T.StructField("emoji", T.StringType(), True),
    T.StructField("sticker", T.StringType(), True),
])


def request_stream(spark: SparkSession, source_dir: str, max_files_per_trigger: int | None = None) -> DataFrame:
    r = spark.readStream.schema(REQUEST_SCHEMA)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.json(source_dir)


def parse_requests(df: DataFrame, value_col: str = "value") -> DataFrame:
    """JSON request text (e.g. a Kafka ``value``) -> ``request_id, text, emoji, sticker`` with the
    declared schema (``from_json``; a missing field reads as null, so each input is optional)."""
    from pyspark.sql import functions as F
    return df.select(F.from_json(F.col(value_col).cast("string"), REQUEST_SCHEMA).alias("r")).select("r.*")


def score_stream(requests: DataFrame, model: ScoringModel) -> DataFrame:
    """The scoring transformation for any frame with ``REQUEST_SCHEMA``: a file stream
    (``request_stream``), a Kafka stream through ``parse_requests``, or a batch frame."""
    return score_messages(requests, model, "request_id")


def start_scoring(spark: SparkSession, source_dir: str, sink_dir: str, checkpoint_location: str,
                  model: ScoringModel | None = None, available_now: bool = False,
                  processing_time: str | None = None) -> StreamingQuery:
    """Start the stream: parquet sink, append mode, exactly-once file bookkeeping via the checkpoint."""
    model = model or ScoringModel.closed_form()
    out = score_stream(request_stream(spark, source_dir), model)
    w = out.writeStream.format("parquet").option("checkpointLocation", checkpoint_location).outputMode("append")
    if available_now:
        w = w.trigger(availableNow=True)
    elif processing_time:
        w = w.trigger(processingTime=processing_time)
    return w.start(sink_dir)


# ---------------------------------------------------------------- table sink with a ledger and a quarantine

def _part(tables: str, table: str, run: str, batch_id: int) -> str:
    return f"{tables}/{table}/run={run}/batch_id={batch_id}"


def _is_committed(spark: SparkSession, tables: str, run: str, batch_id: int) -> bool:
    try:
        return spark.read.schema("rows long").parquet(_part(tables, "ledger", run, batch_id)).limit(1).count() > 0
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return False


def commit_batch(lines: DataFrame, batch_id: int, tables: str, model: ScoringModel, run: str = "scoring") -> bool:
    """Score a batch of JSON lines (``value``) into ``tables``; false if the ledger already has the batch.

    Good requests go to ``scored``, malformed lines and those without a ``request_id`` to ``quarantine``; the
    ledger's row is written last and makes the batch visible. A batch that is replayed, after its commit or after a failure
    halfway, leaves the tables as one pass would: committed batches are left alone, others overwrite their own parts.
    """
    spark = lines.sparkSession
    if _is_committed(spark, tables, run, batch_id):
        return False
    schema = T.StructType([*REQUEST_SCHEMA.fields, T.StructField("_bad", T.StringType(), True)])
    parsed = lines.select("value", F.from_json("value", schema, {"columnNameOfCorruptRecord": "_bad"}).alias("r"))
    bad: Column = F.col("r").isNull() | F.col("r._bad").isNotNull() | F.col("r.request_id").isNull()
    good = parsed.where(~bad).select(*[f"r.{c}" for c in REQUEST_SCHEMA.names])
    score_stream(good, model).write.mode("overwrite").parquet(_part(tables, "scored", run, batch_id))
    parsed.where(bad).select("value").write.mode("overwrite").parquet(_part(tables, "quarantine", run, batch_id))
    rows = spark.read.parquet(_part(tables, "scored", run, batch_id)).count()
    spark.createDataFrame([(rows,)], "rows long").coalesce(1).write.mode("overwrite").parquet(_part(tables, "ledger", run, batch_id))
    return True


def start_scoring_tables(spark: SparkSession, source_dir: str, tables: str, checkpoint_location: str, model: ScoringModel | None = None,
                         run: str = "scoring", max_files_per_trigger: int | None = None) -> StreamingQuery:
    """Score all JSON-lines files of a folder exactly once into ``tables``. A new checkpoint numbers its batches anew: give it a new ``run``."""
    model = model or ScoringModel.closed_form()
    r = spark.readStream.option("maxFilesPerTrigger", max_files_per_trigger) if max_files_per_trigger else spark.readStream
    return (r.text(source_dir).writeStream.foreachBatch(lambda lines, batch_id: commit_batch(lines, batch_id, tables, model, run) and None)
            .option("checkpointLocation", checkpoint_location).trigger(availableNow=True).start())


def committed_rows(spark: SparkSession, tables: str, table: str = "scored") -> DataFrame:
    """Rows of ``scored`` or ``quarantine`` whose batches are committed, with ``run`` and ``batch_id``."""
    kinds = "run string, batch_id long"
    schema = f"value string, {kinds}" if table == "quarantine" else f"request_id string, predicted int, sentiment string, confidence double, {kinds}"
    ledger = spark.read.schema(f"rows long, {kinds}").parquet(f"{tables}/ledger").select("run", "batch_id").distinct()
    return spark.read.schema(schema).parquet(f"{tables}/{table}").join(ledger, ["run", "batch_id"], "left_semi")
