"""Session settings and durable intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str, master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on; ``master`` is left to spark-submit when None."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        # Recording the call site of every column expression makes wide projections slow to build.
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables: the cluster's ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder; on a cluster a machine-local
    folder would not be visible to the other executors.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        configured = context.getConf().get("spark.checkpoint.dir")
        if configured is None:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a shared folder")
            configured = tempfile.mkdtemp(prefix="segmart-")
        context.setCheckpointDir(configured)
    return context.getCheckpointDir()


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder, which ``release`` deletes."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}.parquet"
    _stored.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


# Tables of whole lines, which zstandard makes about a third smaller than the session's codec does.
_WIDE = ("sales", "transaction")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    This cuts the lineage with reliable, columnar storage: later stages prune columns,
    push filters and survive lost executors without recomputing what came before.
    """
    path = new_path(df.sparkSession, name)
    writer = df.write.mode("errorifexists")
    if name in _WIDE:
        writer = writer.option("compression", "zstd")
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_stored: dict[str, list[str]] = {}


def release(spark: SparkSession) -> None:
    """Delete the tables that ``materialise`` stored for this application; their results are read by then."""
    context = spark.sparkContext
    configuration = context._jsc.hadoopConfiguration()
    for path in _stored.pop(context.applicationId, []):
        place = context._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(configuration).delete(place, True)
