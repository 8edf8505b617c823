"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextvars
import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.session import shared_folder

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def row_key() -> Column:
    """A hash of a document's id and text: equal for repeated rows alone."""
    return F.xxhash64(F.col("doc_id").isNull(), F.col("doc_id").cast("long"), "text")


#: The folder below the shared one that new tables go to.
PLACE = contextvars.ContextVar("place", default="corpusmill")


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{PLACE.get()}/{label}-{uuid.uuid4().hex}"


def settled(spark: SparkSession, label: str, make: Callable[[], DataFrame]) -> DataFrame:
    """What ``make`` gives, stored; the tables that were stored on the way to it are deleted."""
    path = scratch_path(spark, label)
    token = PLACE.set(f"{PLACE.get()}/{label}-tables-{uuid.uuid4().hex}")
    try:
        df = make()
        df.write.parquet(path)
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/{PLACE.get()}")
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
    finally:
        PLACE.reset(token)
    return spark.read.schema(df.schema).parquet(path)


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read back: lineage ends here, and
    a lost executor costs no more than the tasks it was running."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*frames: DataFrame) -> None:
    """Delete the files of frames made by ``stored`` that no later plan reads."""
    for df in frames:
        spark = df.sparkSession
        jvm = spark.sparkContext._jvm
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        folders = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
        for folder in folders:
            if "/corpusmill/" in folder:
                path = jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(conf).delete(path, True)


def small_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few rows of the driver as a frame that the JVM alone builds."""
    names = [field.split()[0] for field in schema.split(", ")]
    text = json.dumps([dict(zip(names, row, strict=True)) for row in rows])
    kind = ", ".join(field.replace(" ", ": ", 1) for field in schema.split(", "))
    return spark.range(1).select(F.inline(F.from_json(F.lit(text), f"array<struct<{kind}>>")))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z alone. Pure ASCII takes the fast built-in."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, UPPER.lower())
    )
