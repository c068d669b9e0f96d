"""Session helpers: settings the jobs rely on and the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# A group with more rows than this is split over several tasks.
HOT_ROWS = 200_000


def build_session(app: str = "foliant", master: str | None = None, partitions: int | None = None,
                  memory: str | None = None) -> SparkSession:
    builder = (SparkSession.builder.appName(app)
               .config("spark.sql.session.timeZone", "UTC")
               .config("spark.sql.adaptive.enabled", "true")
               .config("spark.sql.adaptive.skewJoin.enabled", "true")
               .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true"))
    if master:
        builder = (builder.master(master).config("spark.ui.enabled", "false")
                   .config("spark.ui.showConsoleProgress", "false"))
    if memory:
        builder = builder.config("spark.driver.memory", memory)
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    return builder.getOrCreate()


def hot_rows(spark: SparkSession) -> int:
    return int(spark.conf.get("foliant.hotRows", str(HOT_ROWS)))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _own_folder(spark: SparkSession, name: str) -> str:
    """A temporary folder of this machine; only a session without other machines may use one."""
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return tempfile.mkdtemp(prefix=f"foliant-{name}-")


def save(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the cluster's shared folder."""
    spark = df.sparkSession
    context = spark.sparkContext
    if not context.getCheckpointDir():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        context.setCheckpointDir(shared or _own_folder(spark, "checkpoint"))
    return df.checkpoint()


def save_rows(df: DataFrame) -> DataFrame:
    """Cut the lineage of wide rows with a table in the shared folder: compressed columns, where ``save`` keeps whole rows as they are in memory.

    Unlike ``save``, it does not keep how the rows are partitioned. Columns of no type, which parquet has not, are saved by ``save``.
    """
    if "void" in df.schema.simpleString():
        return save(df)
    path = scratch(df.sparkSession, "rows")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder for intermediate files, in the shared folder when the cluster names one."""
    base = spark.conf.get("foliant.scratch", None) or spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    return _own_folder(spark, name) + "/data"
