"""Copies that differ only in formatting, counted batch by batch in a bucketed ledger.

The ledger is a table of canonical keys with their number of copies and their earliest
representative, cut into hash buckets. A batch is first aggregated on its own (with map-side
combining, so a key with a third of all rows is a few rows a task), then full-outer-joined with
the buckets it touches; only these are written anew. A manifest names each bucket's folder. Every
version has a manifest of its own, put in place by a rename to a name that wasn't there; the
newest one counts. So whatever step a run dies at, the ledger is as before it or as after it.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.session import drop_path


class Ledger:
    """Counts by canonical key. `path` is a folder that all executors share; `keys` name the key's columns.

    buckets holds for a new ledger; one that is there keeps the number it was made with.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], buckets: int = 32) -> None:
        self.spark, self.path, self.keys, self.buckets = spark, path.rstrip("/"), keys, buckets
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _versions(self) -> list[int]:
        if not self._fs.exists(self._path(self.path)):
            return []
        names = [x.getPath().getName() for x in self._fs.listStatus(self._path(self.path))]
        return sorted(int(n[9:]) for n in names if n.startswith("manifest-") and n[9:].isdigit())

    def _manifest(self) -> dict:
        there = self._versions()
        if not there:
            return {"version": 0, "buckets": {}, "schema": None, "n_buckets": self.buckets, "batches": []}
        return json.loads("".join(r.value for r in self.spark.read.text(f"{self.path}/manifest-{there[-1]}").collect()))

    def _commit(self, manifest: dict) -> None:
        fresh, at = self._path(f"{self.path}/fresh-{uuid.uuid4().hex}"), self._path(f"{self.path}/manifest-{manifest['version']}")
        out = self._fs.create(fresh, True)
        out.writeBytes(json.dumps(manifest))
        out.close()
        if not self._fs.rename(fresh, at):
            self._fs.delete(fresh, False)
            raise RuntimeError(f"version {manifest['version']} was written by another run")

    def _read(self, manifest: dict, wanted: set[int] | None = None) -> DataFrame | None:
        """The buckets wanted (all if None), by the version that wrote them last."""
        by: dict[int, list[int]] = {}
        for b, v in manifest["buckets"].items():
            if wanted is None or int(b) in wanted:
                by.setdefault(v, []).append(int(b))
        df = None
        for v, bs in sorted(by.items()):
            part = self.spark.read.schema(manifest["schema"]).parquet(f"{self.path}/v{v}").where(F.col("bucket").isin(bs))
            df = part if df is None else df.unionByName(part)
        return df

    def _folders(self, at: str) -> set[int]:
        return {int(s.getPath().getName().split("=")[1]) for s in self._fs.listStatus(self._path(at)) if "=" in s.getPath().getName()}

    def add(self, batch: DataFrame, representative: str, batch_id: str | None = None) -> bool:
        """Count a batch in: one row per record, with the key columns and a representative's id. False if a batch of this id was counted before.

        Null key values form a key of their own. An empty batch changes nothing. Of all records
        of a key the smallest id stays as representative, whichever batch brought it.
        """
        manifest = self._manifest()
        if batch_id is not None and batch_id in manifest["batches"]:
            return False
        version = manifest["version"] + 1
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(manifest["n_buckets"])).cast("int")
        counted = batch.groupBy(*self.keys).agg(F.count(F.lit(1)).alias("n_copies"), F.min(representative).alias("first_id")).withColumn("bucket", bucket)
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in counted.schema)
        held = self._read(manifest)
        if held is not None:
            # The batch's own buckets, few numbers, say which part of the ledger it meets.
            new = f"{self.path}/batch{version}"
            counted.write.mode("overwrite").parquet(new)
            counted = self.spark.read.schema(schema).parquet(new)
            wanted = {r.bucket for r in counted.select("bucket").distinct().collect()}
            held = self._read(manifest, wanted)
        if held is not None:
            k = [*self.keys, "bucket"]
            old = held.select(*[F.col(c).alias(f"o_{c}") for c in [*k, "n_copies", "first_id"]])
            on = F.lit(True)
            for c in k:
                on = on & F.col(c).eqNullSafe(F.col(f"o_{c}"))
            both = counted.join(old, on, "full_outer")
            counted = both.select(
                *[F.when(F.col("o_bucket").isNull(), F.col(c)).otherwise(F.col(f"o_{c}")).alias(c) for c in self.keys],
                (F.coalesce("n_copies", F.lit(0)) + F.coalesce("o_n_copies", F.lit(0))).alias("n_copies"),
                F.least("first_id", "o_first_id").alias("first_id"),
                F.coalesce("bucket", "o_bucket").alias("bucket"),
            )
        at = f"{self.path}/v{version}"
        counted.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(at)
        written = self._folders(at)
        before = set(manifest["buckets"].values())
        buckets = manifest["buckets"] | {str(b): version for b in written}
        self._commit({"version": version, "buckets": buckets, "schema": schema, "n_buckets": manifest["n_buckets"], "batches": manifest["batches"] + ([batch_id] if batch_id is not None else [])})
        # The new version counts from here on; what follows only tidies up.
        for v in self._versions()[:-1]:
            self._fs.delete(self._path(f"{self.path}/manifest-{v}"), False)
        for v in before - set(buckets.values()):  # every bucket of that version was written anew
            drop_path(self.spark, f"{self.path}/v{v}")
        drop_path(self.spark, f"{self.path}/batch{version}")
        return True

    def read(self) -> DataFrame:
        """keys..., n_copies, first_id, bucket."""
        manifest = self._manifest()
        if manifest["version"] == 0:
            raise ValueError("nothing was counted yet")
        df = self._read(manifest)
        return df if df is not None else self.spark.createDataFrame([], manifest["schema"])


def in_batches(records: DataFrame, at: str) -> list[DataFrame]:
    """The backlog and the newest calendar year of `at`, as a first load and an update would bring them; rows without a time are in the backlog."""
    cut = records.agg(F.date_trunc("year", F.max(at).cast("timestamp_ntz")).alias("cut")).first()["cut"]
    if cut is None:
        return [records]
    newest: Column = F.coalesce(F.col(at) >= F.lit(cut).cast(records.schema[at].dataType), F.lit(False))
    return [records.where(~newest), records.where(newest)]
