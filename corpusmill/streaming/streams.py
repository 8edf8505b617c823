"""Streams: deduplicated intake, windows, keyed state. Each has a batch twin in ``plans``."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corpusmill.session import shared_folder
from corpusmill.sources.notes import append_new


def parquet_stream(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """Files of a folder (or one file) as a stream."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    return reader.option("pathGlobFilter", name).parquet(folder) if name.endswith(".parquet") else reader.parquet(path)


#: Batches that a table is cut into at least, rows of a file and files of a batch at most (where rows lie evenly in time).
SLICES, SLICE_ROWS, FILES = 6, 1_000_000, 8
#: Tasks that read a slice at most; with so many rows for each file and task, no file of a slice is empty.
READERS = 64


def in_slices(spark: SparkSession, path: str, column: str = "ts") -> DataFrame:
    """A table as a stream of several batches: equal stretches of time, written and read one after the other,
    so that state is carried from batch to batch.

    The table is read once and laid out by stretch; then each stretch is written from its own part alone, into as many files as a
    batch takes. A stretch with too few rows for that goes with the next one."""
    rows = spark.read.parquet(path)
    micros = F.unix_micros(F.col(column).cast("timestamp"))
    first, last, count = rows.agg(F.min(micros), F.max(micros), F.count("*")).first()
    folder = scratch(spark, "slices")
    if first is None:
        rows.write.parquet(folder)
        return parquet_stream(spark, folder)
    parts = max(SLICES, -(-count // (SLICE_ROWS * FILES)))
    number = F.least(F.floor((micros - first) / (last - first + 1) * parts), F.lit(parts - 1)).cast("int")
    laid = scratch(spark, "stretches")
    numbered = rows.where(F.col(column).isNotNull()).withColumn("stretch", number)
    numbered.write.partitionBy("stretch").parquet(laid)
    held = spark.read.schema(numbered.schema).parquet(laid)
    counts = {r["stretch"]: r["count"] for r in held.groupBy("stretch").count().collect()}
    files = max(FILES, -(-max(counts.values()) // SLICE_ROWS)) if max(counts.values()) > SLICE_ROWS // FILES else 1
    for begin, end in stretches([counts.get(i, 0) for i in range(parts)], READERS * files if files > 1 else 0):
        part = held.where(F.col("stretch").between(begin, end)).select(*rows.columns)
        (part.coalesce(READERS).repartition(files) if files > 1 else part.coalesce(1)).write.mode("append").parquet(folder)
    return parquet_stream(spark, folder, files)


def stretches(counts: list[int], least: int) -> list[tuple[int, int]]:
    """(first, last) of neighbours that have at least so many rows together, in order; all are in one of them."""
    out, begin, held, left = [], 0, 0, sum(counts)
    for i, n in enumerate(counts):
        held, left = held + n, left - n
        if i == len(counts) - 1 or (held >= least and left >= least):
            out.append((begin, i))
            begin, held = i + 1, 0
    return out


def timed(events: DataFrame, delay: str = "60 days") -> DataFrame:
    """Events with a zoned ``at`` and a watermark: later rows than ``delay`` are dropped."""
    return events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", delay)


def deduplicated(events: DataFrame, keys: list[str]) -> DataFrame:
    """The first event of each key; state is kept as long as the watermark tells."""
    return events.dropDuplicatesWithinWatermark(keys)


def tumbling(events: DataFrame, width: str = "1 day") -> DataFrame:
    grouped = events.groupBy(F.window("at", width).alias("w"), "event_type")
    return grouped.agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select("w.start", "event_type", "n", "total")


def sliding(events: DataFrame, width: str = "7 days", step: str = "1 day") -> DataFrame:
    return events.groupBy(F.window("at", width, step).alias("w")).agg(F.count("*").alias("n")).select("w.start", "n")


def debounced(events: DataFrame, gap: str = "6 hours") -> DataFrame:
    """Bursts of a key's events, closed by a quiet gap."""
    grouped = events.groupBy(F.session_window("at", gap).alias("w"), "user_id")
    return grouped.agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("started"), "n")


#: What each event does to a task.
MOVES = {
    ("", "signup"): "pending", ("pending", "view"): "running", ("retry", "view"): "running", ("running", "purchase"): "succeeded",
    ("running", "error"): "failed", ("running", "click"): "retry", ("failed", "click"): "retry",
}


#: Keys' states lie together in so many groups: a call of Python for each key and batch costs far more than its events.
GROUPS = 1024


def task_states(events: DataFrame, lease: int = 300) -> DataFrame:
    """(user_id, status, moves, ignored) after each batch: a state machine for each key, with
    events in time order; the state's lease ends in event time."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = {who: (status, moves, ignored, due) for who, status, moves, ignored, due in json.loads(state.get[0])} if state.exists else {}
        now, met = state.getCurrentWatermarkMs(), {}
        parts = [] if state.hasTimedOut else list(batches)
        if parts:
            at, event, kinds, keys = (np.concatenate([part[c].to_numpy() for part in parts]) for c in ("at", "event_id", "event_type", "who"))
            order = np.lexsort((event, at))
            for who, kind, ms in zip(keys[order].tolist(), kinds[order].tolist(), (at[order].astype("datetime64[us]").astype(np.int64) // 1000).tolist(), strict=True):
                status, moves, ignored, _ = held.get(who, ("", 0, 0, None))
                new = MOVES.get((status, kind))
                held[who] = met[who] = (new, moves + 1, ignored, max(ms, now) + lease * 1000) if new else (status, moves, ignored + 1, max(ms, now) + lease * 1000)
        for who, (status, moves, ignored, due) in held.items():
            if who not in met and due is not None and due < now:
                met[who] = ("pending" if status == "running" else status, moves, ignored, None)
        held |= met
        state.update((json.dumps([(who, *value) for who, value in held.items()]),))
        ends = [value[3] for value in held.values() if value[3] is not None]
        if ends:
            state.setTimeoutTimestamp(min(ends))
        users = pd.Series([None if who is None else int(who) for who in met], dtype="Int64" if None in met else "int64")
        yield pd.DataFrame({"user_id": users} | {c: [value[i] for value in met.values()] for i, c in enumerate(("status", "moves", "ignored"))})

    dealt = events.select(F.pmod(F.xxhash64("user_id"), F.lit(GROUPS)).alias("at_once"), F.col("user_id").cast("string").alias("who"), "at", "event_id", "event_type")
    return dealt.groupBy("at_once").applyInPandasWithState(
        step, "user_id long, status string, moves long, ignored long", "held string", "update", GroupStateTimeout.EventTimeTimeout
    )


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the one that driver and executors share."""
    return f"{shared_folder(spark)}/corpusmill/{name}-{uuid.uuid4().hex}"


def drained(stream: DataFrame, name: str, mode: str) -> DataFrame:
    """Everything a stream gives for the input there is, from Parquet files that its tasks
    write: of the last batch in mode ``complete``, else of all batches."""
    spark = stream.sparkSession
    folder = scratch(spark, name)
    written: dict[int, str] = {}

    def keep(batch: DataFrame, number: int) -> None:
        path = f"{folder}/batch-{number}"
        batch.write.mode("overwrite").parquet(path)
        written[number] = path

    run = stream.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    run.awaitTermination()
    paths = [written[n] for n in sorted(written)]
    paths = paths[-1:] if mode == "complete" else paths
    return spark.read.schema(stream.schema).parquet(*paths) if paths else spark.createDataFrame([], stream.schema)


def intake(stream: DataFrame, target: str, key: list[str], checkpoint: str):
    """Appends to the Parquet folder ``target`` the rows whose key it lacks, batch by batch. Of the
    target the key columns alone are read; only a folder that isn't there counts as empty."""

    def add(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(target)
        there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
        known = spark.read.schema(batch.schema).parquet(target).select(*key) if there else batch.select(*key).limit(0)
        append_new(batch, known, key).write.mode("append").parquet(target)

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
