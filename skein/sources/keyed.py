"""Keyed tables in files: batches are merged by key, read back merged, and compacted bucket by bucket.

A table is a folder of data folders and of numbered manifests.  Rows are dealt to buckets by a hash of their key.  A batch is
written as a delta folder and becomes visible by the next manifest, which is created only if no other writer has made it;
until then nobody reads the delta.  A batch that is in the manifest is not merged again, so a job may be run again after any
failure.  A read takes the newest row of each key over base and deltas.  Compaction rewrites the buckets that deltas touch and
leaves the others where they are.

A key that stands twice in a batch with different rows is a conflict, and the batch is refused as a whole before anything is
visible; equal rows count once.  A null in the key is refused too.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as ty

BUCKETS = 16


class Conflict(ValueError):
    """Rows of a batch that can't be merged."""


class Lost(RuntimeError):
    """Another writer was first."""


@dataclass
class Manifest:
    """base: the data folder of each bucket; deltas: data folders since, the oldest first; batches: ids of all merged ones."""

    base: dict[str, str] = field(default_factory=dict)
    deltas: list[str] = field(default_factory=list)
    batches: list[str] = field(default_factory=list)


class KeyedTable:
    def __init__(self, spark: SparkSession, path: str, schema: str | ty.StructType, key: list[str], buckets: int = BUCKETS):
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets
        self.schema = schema if isinstance(schema, ty.StructType) else ty.StructType.fromDDL(schema)
        self._at = spark._jvm.org.apache.hadoop.fs.Path
        self._files = self._at(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    # Manifests.

    def _number(self) -> int:
        """The newest manifest; 0 if there is none."""
        at = self._at(f"{self.path}/manifests")
        if not self._files.exists(at):
            return 0
        return max((int(s.getPath().getName().split(".")[0]) for s in self._files.listStatus(at) if s.getPath().getName().endswith(".json")), default=0)

    def manifest(self, number: int | None = None) -> Manifest:
        number = self._number() if number is None else number
        if not number:
            return Manifest()
        return Manifest(**json.loads(self.spark.read.text(f"{self.path}/manifests/{number:08d}.json", wholetext=True).first()[0]))

    def _commit(self, number: int, new: Manifest) -> None:
        """Makes manifest `number`; raises Lost if there is one."""
        # Written under another name first: a manifest is whole or not there.
        draft = self._at(f"{self.path}/manifests/.{uuid.uuid4().hex}")
        out = self._files.create(draft)
        out.write(bytearray(json.dumps(new.__dict__).encode()))
        out.close()
        to = self._at(f"{self.path}/manifests/{number:08d}.json")
        if self._files.exists(to) or not self._files.rename(draft, to):
            self._files.delete(draft, False)
            raise Lost(f"{self.path}: manifest {number} is another writer's")

    # Data.

    def _write(self, rows: DataFrame, name: str) -> str:
        bucket = F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")
        rows.withColumn("_bucket", bucket).repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{self.path}/data/{name}")
        return name

    def _folder(self, name: str, buckets=None) -> DataFrame:
        root = f"{self.path}/data/{name}"
        paths = [root] if buckets is None else [f"{root}/_bucket={b}" for b in buckets]
        return self.spark.read.schema(ty.StructType([*self.schema, ty.StructField("_bucket", ty.IntegerType())])).option("basePath", root).parquet(*paths)

    def _merged(self, m: Manifest, only: list[str] | None = None) -> DataFrame:
        """The newest row of each key; only: of these buckets."""
        held: dict[str, list[str]] = {}
        for bucket, name in m.base.items():
            if only is None or bucket in only:
                held.setdefault(name, []).append(bucket)
        parts = [(self._folder(name, buckets), 0) for name, buckets in held.items()]
        parts += [(d if only is None else d.where(F.col("_bucket").isin(*map(int, only))), k + 1) for k, d in enumerate(map(self._folder, m.deltas))]
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        every = None
        for df, age in parts:
            df = df.withColumn("_age", F.lit(age))
            every = df if every is None else every.unionByName(df)
        rest = [c for c in self.schema.names if c not in self.key]
        newest = every.groupBy(*self.key).agg(F.max_by(F.struct(*map(F.col, [*rest, "_bucket"])), "_age").alias("_row"))
        return newest.select(*[F.col(c) if c in self.key else F.col(f"_row.{c}").alias(c) for c in self.schema.names])

    def read(self) -> DataFrame:
        """The table as its newest manifest has it."""
        return self._merged(self.manifest())

    def merge(self, rows: DataFrame, batch: str) -> bool:
        """Merges a batch by key; False if it has been merged before."""
        number = self._number()
        now = self.manifest(number)
        if batch in now.batches:
            return False
        rows = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema])
        bad = rows.distinct().groupBy(*self.key).count().where(F.greatest(F.col("count") > 1, *[F.col(c).isNull() for c in self.key])).limit(3).collect()
        if bad:
            raise Conflict(f"{self.path}, batch {batch}: " + "; ".join(", ".join(str(r[c]) for c in self.key) for r in bad))
        name = self._write(rows.distinct(), f"delta-{uuid.uuid4().hex}")
        self._commit(number + 1, Manifest(now.base, [*now.deltas, name], [*now.batches, batch]))
        return True

    def compact(self) -> list[str]:
        """Rewrites the buckets that deltas touch; returns them.  Folders that nothing refers to any more stay for those who read."""
        number = self._number()
        now = self.manifest(number)
        if not now.deltas:
            return []
        touched = sorted({str(r[0]) for d in map(self._folder, now.deltas) for r in d.select("_bucket").distinct().collect()}, key=int)
        name = self._write(self._merged(now, touched), f"base-{uuid.uuid4().hex}")
        self._commit(number + 1, Manifest(now.base | dict.fromkeys(touched, name), [], now.batches))
        return touched

    def vacuum(self) -> int:
        """Deletes data folders that the newest manifest doesn't name, such as those of failed batches; returns how many."""
        now = self.manifest()
        used = {*now.base.values(), *now.deltas}
        at = self._at(f"{self.path}/data")
        gone = [s.getPath() for s in self._files.listStatus(at) if s.getPath().getName() not in used] if self._files.exists(at) else []
        for path in gone:
            self._files.delete(path, True)
        return len(gone)
