"""Session defaults and the shared folder for written intermediates."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from rowloom.errors import ToolkitError

# Fixed defaults. Shuffle partitions are left to the cluster: AQE coalesces small ones, and a job
# over many terabytes sets spark.sql.shuffle.partitions to about total shuffle bytes / 200 MB.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
    "spark.ui.enabled": "false",
}

def build_session(app_name: str = "rowloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the toolkit's defaults; keyword names use ``_`` for ``.`` only in ``conf`` dicts."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir`` of the session.

    A session without that setting uses the folder of its warehouse. On a cluster one of the two has
    to be a folder that all executors share; Spark's own default for the warehouse is a folder of the
    driver's machine, which suits local mode only.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    warehouse = spark.conf.get("spark.sql.warehouse.dir", None)
    if not warehouse:
        raise ToolkitError("set spark.checkpoint.dir to a folder shared by all executors")
    return f"{warehouse.rstrip('/')}/_scratch"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unused path below the shared folder; Hadoop removes it when the application ends."""
    path = f"{scratch_root(spark)}/rowloom/{name}-{uuid.uuid4().hex}"
    on_hadoop(spark, path, "deleteOnExit")
    return path


def on_hadoop(spark: SparkSession, path: str, method: str, *args):
    """Call a method of the file system that holds ``path``."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return getattr(system, method)(place, *args)


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete written intermediates that no later step reads."""
    for path in paths:
        on_hadoop(spark, path, "delete", True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage and freezes values that depend on the physical layout, so that a lost
    executor cannot change them when a stage is run again.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
