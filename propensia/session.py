"""Session construction and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_session(app_name: str = "propensia", master: str | None = None, folder: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings the library relies on; ``folder`` is shared by all executors.

    The time zone is pinned so dates do not move with the host, and AQE is left
    to coalesce shuffles and split skewed join sides. ``conf`` overrides anything.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
        # Call-site capture costs more than the plan nodes it annotates.
        "spark.python.sql.dataFrameDebugging.enabled": "false",
    }
    if folder:
        settings["spark.checkpoint.dir"] = folder
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach: the cluster's ``spark.checkpoint.dir``.

    Only a local session that names none (a test on one machine) gets a folder of its own;
    on a cluster that would be a folder of the driver's, so it is refused.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    configured = configured or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    configured = configured or spark.sparkContext.getCheckpointDir()
    if not configured:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="propensia-")
        spark.sparkContext.setCheckpointDir(configured)
        configured = spark.sparkContext.getCheckpointDir()
    return configured.rstrip("/")


def staging_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; never reused between calls."""
    return f"{shared_folder(spark)}/propensia/{name}-{uuid.uuid4().hex}"


def discard(df: DataFrame) -> None:
    """Delete the staged copies that ``df`` reads; nothing else may still need them.

    Only files below the shared folder are touched.
    """
    spark, root = df.sparkSession, shared_folder(df.sparkSession)
    jvm = spark.sparkContext._jvm
    marker = f"{root.split(':', 1)[-1].lstrip('/')}/propensia/"
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles() if marker in f}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as a columnar table and read it back.

    Cuts the lineage before a multi-pass fit; unlike an RDD checkpoint the copy
    still prunes columns and pushes filters, and it survives lost executors.
    """
    path = staging_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
