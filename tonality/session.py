"""Session helpers: one place for the Spark settings every operator relies on."""

from __future__ import annotations

import atexit
import os
import tempfile

from pyspark.sql import SparkSession

LABEL_CLASSES = ("negative", "neutral", "positive")


def get_spark(master: str | None = None, app: str = "tonality", shuffle_partitions: int | None = None,
              extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with AQE on and the UI off.

    On a cluster the master comes from spark-submit; ``master`` is for local runs and tests.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    return spark


def cluster_conf(input_bytes: int, cores: int, target_partition_bytes: int = 256 << 20,
                 image_rows: bool = False) -> dict[str, str]:
    """Settings sized from the input volume, for ``get_spark(extra=...)`` or ``spark-submit --conf``.

    Shuffle partitions ~ input / 256 MB (at least 2 x cores), so each reducer's share fits in
    executor memory and spills little; AQE coalesces small ones and splits skewed ones at run
    time. Scan splits of 256 MB. Arrow batches of 10k rows, 64 for image rows (3 x 128 x 128
    float32 = 196 KB each).
    """
    parts = max(2 * cores, -(-input_bytes // target_partition_bytes))
    return {
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.files.maxPartitionBytes": str(target_partition_bytes),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes // 2),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
        "spark.sql.autoBroadcastJoinThreshold": str(64 << 20),
        "spark.sql.execution.arrow.maxRecordsPerBatch": "64" if image_rows else "10000",
    }




def ship_package(spark: SparkSession) -> None:
    """Make ``tonality`` importable by the Python workers that run Arrow-batch operators.

    A local session gets the package's parent folder on the workers' ``PYTHONPATH``; any other
    master receives the package as a zip through ``addPyFile`` (what ``--py-files`` does).
    Idempotent per Spark context.
    """
    sc = spark.sparkContext
    if getattr(sc, "_tonality_shipped", False):  # a mark on the context itself: a new context starts without it
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    if sc.master.startswith("local"):
        paths = [p for p in sc.environment.get("PYTHONPATH", "").split(os.pathsep) if p]
        if root not in paths:
            sc.environment["PYTHONPATH"] = os.pathsep.join(paths + [root])
    else:
        import shutil
        base = os.path.join(tempfile.mkdtemp(prefix="tonality-pkg-"), "tonality")
        archive = shutil.make_archive(base, "zip", root_dir=root, base_dir="tonality")
        sc.addPyFile(archive)
    sc._tonality_shipped = True


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for reliable checkpoints and intermediate tables.

    Read from ``spark.checkpoint.dir``; only a local-mode session (tests) gets a fresh
    temporary folder when the setting is missing. A cluster must name a shared folder.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        master = spark.sparkContext.master
        if not master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        d = tempfile.mkdtemp(prefix="tonality-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(d)
    return d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A sub-path of the checkpoint folder for a written intermediate table."""
    return os.path.join(checkpoint_dir(spark), name)


_WRITTEN: list[tuple] = []


def materialize(df, name: str):
    """Write ``df`` once as Parquet under the shared checkpoint folder and read it back.

    Cuts the lineage like a reliable checkpoint, but computes the frame only once (an eager
    ``checkpoint()`` of an unpersisted frame computes it a second time to write it). Survives
    executor loss: the copy lives in the shared folder, not on executors. The copies belong to
    the driver process: ``drop_scratch`` deletes one or all of them, and leaving Python does too.
    """
    import uuid

    spark = df.sparkSession
    path = scratch_path(spark, f"{name}-{uuid.uuid4().hex}")
    schema = df.schema
    df.write.mode("overwrite").parquet(path)
    if not _WRITTEN:
        atexit.register(drop_scratch)
    _WRITTEN.append((spark, path))
    out = spark.read.schema(schema).parquet(path)
    out._scratch_path = path
    return out


def drop_scratch(df=None) -> None:
    """Delete the written copy behind ``df`` (as ``materialize`` returned it), or all of this process."""
    wanted = None if df is None else df._scratch_path
    for spark, path in [w for w in _WRITTEN if wanted in (None, w[1])]:
        _WRITTEN.remove((spark, path))
        try:
            jvm = spark._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session has ended: nothing can be deleted through it
            if df is not None:
                raise
