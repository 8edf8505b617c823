"""A stored table that is changed in place by key: insert or ignore, replace, or update on conflict.

The rows lie in a fixed number of buckets by a hash of their key. A merge rewrites the buckets that its changes touch, in
files of their own, and then writes a manifest that names, for each bucket, the folder it is in. Manifests are numbered; the
highest is the table. So a reader sees the table before a merge or after it, a merge that dies before its manifest changes
nothing, and of two merges from one version the second to finish fails instead of undoing the first.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

NAME = "{:012d}.json"


class Conflict(Exception):
    """Another merge has changed the table since this one read it."""


@dataclass
class KeyedTable:
    """``key``: the columns that tell rows apart; nulls are a value of their own. ``buckets`` is fixed when the table is made."""

    spark: SparkSession
    path: str
    key: list[str]
    buckets: int = 64
    _fs: object = field(default=None, repr=False)

    # --- manifests ---------------------------------------------------------------------
    @property
    def jvm(self):
        return self.spark.sparkContext._jvm

    def where(self, *parts: str):
        return self.jvm.org.apache.hadoop.fs.Path("/".join([self.path.rstrip("/"), *parts]))

    @property
    def fs(self):
        if self._fs is None:
            self._fs = self.where().getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return self._fs

    def versions(self) -> list[int]:
        folder = self.where("manifests")
        if not self.fs.exists(folder):
            return []
        return sorted(int(s.getPath().getName()[:-5]) for s in self.fs.listStatus(folder) if s.getPath().getName().endswith(".json"))

    def manifest(self, version: int) -> dict:
        rows = self.spark.read.text(self.where("manifests", NAME.format(version)).toString(), wholetext=True).collect()
        return json.loads(rows[0].value)

    def publish(self, version: int, manifest: dict) -> None:
        """Write the manifest under another name and give it its number, which fails if that is taken."""
        draft, final = self.where("manifests", f"_{uuid.uuid4().hex}"), self.where("manifests", NAME.format(version))
        out = self.fs.create(draft, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.where().toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(context.makeQualified(draft), context.makeQualified(final), options)
        except Exception as error:
            self.fs.delete(draft, False)
            if self.fs.exists(final):
                raise Conflict(f"version {version} of {self.path} exists") from error
            raise

    # --- rows --------------------------------------------------------------------------
    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int").alias("_bucket")

    def store(self, rows: DataFrame, label: str) -> dict[str, str]:
        """Write rows by bucket to a new folder; the folder of each bucket that has rows."""
        folder = f"data/{label}-{uuid.uuid4().hex}"
        rows.withColumn("_bucket", self.bucket()).repartition("_bucket").write.partitionBy("_bucket").parquet(self.where(folder).toString())
        found = [s.getPath().getName() for s in self.fs.listStatus(self.where(folder)) if s.isDirectory()]
        return {name.split("=")[1]: f"{folder}/{name}" for name in found if name.startswith("_bucket=")}

    def rows_of(self, manifest: dict, buckets: list[str] | None = None) -> DataFrame:
        schema = StructType.fromJson(manifest["schema"])
        folders = [f for b, f in manifest["buckets"].items() if buckets is None or b in buckets]
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[self.where(f).toString() for f in folders])

    def read(self, version: int | None = None) -> DataFrame:
        """The table as it is, or as it was."""
        return self.rows_of(self.manifest(self.versions()[-1] if version is None else version))

    def replace_all(self, rows: DataFrame) -> int:
        """A snapshot in place of whatever the table held."""
        version = (self.versions() or [0])[-1] + 1
        self.publish(version, {"schema": rows.schema.jsonValue(), "buckets": self.store(rows, "snapshot")})
        return version

    def merge(self, changes: DataFrame, matched: str | dict[str, str] = "ignore", insert: bool = True, condition: str | None = None, order: list[str] | None = None) -> int:
        """Change the table by the rows of ``changes``, which has its columns; the new version's number.

        ``matched``: "ignore" keeps a known row, "replace" takes the new one, a dict sets columns by expressions over ``old`` and
        ``new``; with ``condition`` only where that holds. Of changes with one key the last by ``order`` counts, by all columns if none is given."""
        version = self.versions()[-1]
        manifest = self.manifest(version)
        schema = StructType.fromJson(manifest["schema"])
        new = changes.select([F.col(f.name).cast(f.dataType) for f in schema.fields])
        whole = F.struct(*schema.names)
        last = F.max_by(whole, F.struct(*(order or schema.names)))
        one = new.groupBy(*[F.col(c).alias(f"_{c}") for c in self.key]).agg(last.alias("new"))
        touched = [str(r[0]) for r in one.select("new.*").select(self.bucket()).distinct().collect()]
        old = self.rows_of(manifest, touched).select(*[F.col(c).alias(f"_old_{c}") for c in self.key], whole.alias("old"))
        on = [F.col(f"_{c}").eqNullSafe(F.col(f"_old_{c}")) for c in self.key]
        both = old.join(one, on, "full_outer")
        if matched == "ignore":
            changed = F.col("old")
        elif matched == "replace":
            changed = F.col("new")
        else:
            changed = F.struct(*[(F.expr(matched[c]).cast(schema[c].dataType) if c in matched else F.col(f"old.{c}")).alias(c) for c in schema.names])
        if condition:
            changed = F.when(F.expr(condition), changed).otherwise(F.col("old"))
        row = F.when(F.col("new").isNull(), F.col("old")).when(F.col("old").isNull(), F.col("new") if insert else F.col("old")).otherwise(changed)
        rows = both.select(row.alias("row")).where("row IS NOT NULL").select("row.*")
        written = self.store(rows, f"merge-{version + 1}")
        kept = {b: f for b, f in manifest["buckets"].items() if b not in touched}
        self.publish(version + 1, {"schema": manifest["schema"], "buckets": kept | written})
        return version + 1

    def vacuum(self, keep: int = 1) -> int:
        """Delete manifests but the last ``keep`` and the folders that none of those names; how many folders went."""
        held = self.versions()
        used = {f.rsplit("/", 1)[0] for v in held[-keep:] for f in self.manifest(v)["buckets"].values()}
        for v in held[:-keep]:
            self.fs.delete(self.where("manifests", NAME.format(v)), False)
        gone = [s.getPath() for s in self.fs.listStatus(self.where("data")) if f"data/{s.getPath().getName()}" not in used]
        for folder in gone:
            self.fs.delete(folder, True)
        return len(gone)
