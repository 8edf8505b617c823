"""Session construction for local use; on a cluster the submitted session is used as it is."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | None = None, shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the settings the queries are tested under."""
    builder = SparkSession.builder.master(f"local[{cores or os.cpu_count()}]").appName("corpusmill")
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = (
        builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, named by the cluster in ``spark.checkpoint.dir``.

    Only where that is unset and the master is this machine alone, as in tests, a
    temporary folder serves instead, one for the application."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if context.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and the executors share")
    if not hasattr(context, "_corpusmill_folder"):
        context._corpusmill_folder = "file://" + tempfile.mkdtemp(prefix="corpusmill-")
    return context._corpusmill_folder


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read back: it is computed once, and lineage ends here."""
    path = f"{shared_folder(df.sparkSession)}/corpusmill/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once an application, so that
    functions run there wherever the repository lies."""
    context = spark.sparkContext
    if getattr(context, "_corpusmill_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="corpusmill-code-"), "corpusmill.zip")
    with zipfile.ZipFile(path, "w") as archive:
        for folder, _, names in os.walk(os.path.join(root, "corpusmill")):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    archive.write(full, os.path.relpath(full, root))
    context.addPyFile(path)
    context._corpusmill_shipped = True
