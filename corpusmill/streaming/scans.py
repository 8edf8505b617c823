"""Micro-batches with a memory of their own: feed scans that skip what they saw, and repairs a bounded few at a time.

Each batch reads the state that the batch before it wrote and writes its own under its number, so a batch that is tried
again starts from the same state and ends with the same files."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: New items of a source and scan, items that are remembered, files repaired at a time, seconds between repairs.
PER_SOURCE, REMEMBERED, AT_A_TIME, PAUSE = 15, 2000, 8, 2


@dataclass
class Numbered:
    """A table a batch, below ``folder``."""

    spark: SparkSession
    folder: str

    def path(self, number: int) -> str:
        return f"{self.folder}/batch={number}"

    def fs(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def numbers(self) -> list[int]:
        top = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        names = [s.getPath().getName() for s in self.fs().listStatus(top)] if self.fs().exists(top) else []
        done = self.spark._jvm.org.apache.hadoop.fs.Path
        return sorted(int(n[6:]) for n in names if n.startswith("batch=") and self.fs().exists(done(f"{self.folder}/{n}/_SUCCESS")))

    def before(self, number: int, schema: str) -> DataFrame:
        held = [n for n in self.numbers() if n < number]
        return self.spark.read.schema(schema).parquet(self.path(held[-1])) if held else self.spark.createDataFrame([], schema)

    def write(self, rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(self.path(number))

    def forget(self, number: int) -> None:
        for n in self.numbers():
            if n < number:
                self.fs().delete(self.spark._jvm.org.apache.hadoop.fs.Path(self.path(n)), True)


@dataclass
class FeedScan:
    """Items (source, key, place, ...) of scans: of each source the first ``per_source`` whose key isn't remembered, each key once.
    Sources in ``always`` are never skipped, for their key doesn't change. The ``remembered`` keys met last are kept."""

    spark: SparkSession
    folder: str
    per_source: int = PER_SOURCE
    remembered: int = REMEMBERED
    always: tuple[str, ...] = ()

    SEEN = "key string, scan long, place long"

    def scan(self, batch: DataFrame, number: int) -> None:
        seen, out = Numbered(self.spark, f"{self.folder}/seen"), Numbered(self.spark, f"{self.folder}/items")
        known = seen.before(number, self.SEEN)
        own = Window.partitionBy("source").orderBy("place", "key")
        exempt = F.col("source").isin(*self.always) if self.always else F.lit(False)
        fresh = batch.join(known.select("key").withColumn("known", F.lit(True)), "key", "left").where(F.col("known").isNull() | exempt).drop("known")
        first = fresh.withColumn("again", F.row_number().over(Window.partitionBy("key").orderBy("source", "place")))
        taken = first.where((F.col("again") == 1) | exempt).drop("again").withColumn("n", F.row_number().over(own)).where(F.col("n") <= self.per_source).drop("n")
        out.write(taken.select(batch.columns), number)
        new = self.spark.read.schema(batch.schema).parquet(out.path(number)).groupBy("key").agg(F.lit(number).cast("long").alias("scan"), F.min("place").cast("long").alias("place"))
        both = known.join(new.select("key"), "key", "left_anti").unionByName(new)
        seen.write(both.orderBy(F.desc("scan"), F.desc("place"), "key").limit(self.remembered), number)
        seen.forget(number - 1)

    def items(self, schema: str) -> DataFrame:
        out = Numbered(self.spark, f"{self.folder}/items")
        paths = [out.path(n) for n in out.numbers()]
        return self.spark.read.schema(schema).option("basePath", out.folder).parquet(*paths) if paths else self.spark.createDataFrame([], schema)


@dataclass
class SelfHeal:
    """Changes (path, mtime, ...) repaired newest first, at most ``at_a_time`` a batch; the others wait. Of several
    changes of a path the last counts. What waits is a table a batch; nothing is lost while batches come, and ``rest`` empties it."""

    spark: SparkSession
    folder: str
    schema: str
    at_a_time: int = AT_A_TIME

    def step(self, batch: DataFrame, number: int) -> None:
        waiting, done = Numbered(self.spark, f"{self.folder}/waiting"), Numbered(self.spark, f"{self.folder}/healed")
        columns = self.spark.createDataFrame([], self.schema).columns
        every = waiting.before(number, self.schema).unionByName(batch.select(columns))
        last = every.groupBy("path").agg(F.max(F.struct("mtime", *[c for c in columns if c not in ("path", "mtime")])).alias("c")).select("path", "c.*").select(columns)
        done.write(last.orderBy(F.desc("mtime"), "path").limit(self.at_a_time), number)
        healed = self.spark.read.schema(self.schema).parquet(done.path(number))
        waiting.write(last.join(healed.select("path"), "path", "left_anti"), number)
        waiting.forget(number - 1)

    def rest(self) -> int:
        """Batches without new changes until nothing waits; how many it took."""
        waiting = Numbered(self.spark, f"{self.folder}/waiting")
        steps = 0
        while True:
            number = (waiting.numbers() or [-1])[-1] + 1
            if waiting.before(number, self.schema).isEmpty():
                return steps
            self.step(self.spark.createDataFrame([], self.schema), number)
            steps += 1

    def healed(self) -> DataFrame:
        """Every repaired change with the batch that did it."""
        return self.spark.read.schema(f"{self.schema}, batch int").parquet(f"{self.folder}/healed")

    def start(self, changes: DataFrame, checkpoint: str, once: bool = True):
        """Run over a stream: all there is, or for good with ``PAUSE`` seconds between batches."""
        writer = changes.writeStream.foreachBatch(self.step).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{PAUSE} seconds")).start()
