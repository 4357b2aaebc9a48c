"""A keyed index for streaming jobs, in levels.

A batch adds one part at level 0, a folder of the batch's size. ``fan`` parts of a level are merged
into one of the next, which is written by bucket: rows whose keys hash alike lie in one folder, and
rows that a later batch replaced are left out. A lookup reads the parts of level 0 whole and only the
buckets of its own keys elsewhere, so its cost follows the batch, and the number of parts grows with
the logarithm of the number of batches.

What is current after a batch is said by a manifest of that batch's number, written last. A batch that
runs again starts from the manifest before it. Parts that no manifest from the previous batch on names
are removed when the next batch has started, so readers of the last manifest are not disturbed.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Buckets of a merged part, and parts of a level that are merged.
BUCKETS, FAN = 256, 8


class Part(NamedTuple):
    name: str
    level: int
    buckets: list[int] | None


class LevelIndex:
    """Rows of ``schema`` found by the hash of ``keys``; ``part_no`` is added and holds the batch of a row."""

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType, keys: Sequence[str], buckets: int = BUCKETS, fan: int = FAN):
        self.spark, self.root, self.keys, self.buckets, self.fan = spark, root, list(keys), buckets, fan
        self.schema = T.StructType([*schema.fields, T.StructField("part_no", T.LongType())])
        self._paths = spark._jvm.org.apache.hadoop.fs.Path
        self._files = self._paths(root).getFileSystem(spark._jsc.hadoopConfiguration())
        ids = self._manifests()
        if ids:  # the number of buckets stays that of the parts written so far
            self.buckets = self._said(ids[-1])["buckets"]

    @classmethod
    def stored(cls, spark: SparkSession, root: str) -> LevelIndex:
        """The index that lies in ``root``."""
        found = cls(spark, root, T.StructType(), [])
        said = found._said(found._manifests()[-1])
        found.keys, found.schema = said["keys"], T.StructType.fromJson(said["schema"])
        return found

    def bucket(self):
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    # --- manifests

    def _names(self, folder: str) -> list[str]:
        path = self._paths(f"{self.root}/{folder}")
        return [s.getPath().getName() for s in self._files.listStatus(path)] if self._files.exists(path) else []

    def _manifests(self) -> list[int]:
        return sorted(int(n.split(".")[0]) for n in self._names("manifest") if n.endswith(".json"))

    def _said(self, batch_id: int) -> dict:
        stream = self._files.open(self._paths(f"{self.root}/manifest/{batch_id}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _manifest(self, batch_id: int) -> list[Part]:
        return [Part(*p) for p in self._said(batch_id)["parts"]]

    def parts(self, before: int | None = None) -> list[Part]:
        """The current parts, or those that batch ``before`` starts from."""
        ids = [i for i in self._manifests() if before is None or i < before]
        return self._manifest(ids[-1]) if ids else []

    def _publish(self, batch_id: int, parts: list[Part]) -> None:
        folder = f"{self.root}/manifest"
        temporary, target = self._paths(f"{folder}/_{batch_id}.tmp"), self._paths(f"{folder}/{batch_id}.json")
        stream = self._files.create(temporary, True)
        stream.write(json.dumps({"buckets": self.buckets, "keys": self.keys, "schema": self.schema.jsonValue(), "parts": parts}).encode())
        stream.close()
        self._files.delete(target, False)
        self._files.rename(temporary, target)

    def _sweep(self, batch_id: int) -> None:
        """Remove what only manifests older than the one that this batch starts from name."""
        older = [i for i in self._manifests() if i < batch_id]
        for i in older[:-1]:
            self._files.delete(self._paths(f"{self.root}/manifest/{i}.json"), False)
        if older:
            kept = {p.name for p in self._manifest(older[-1])}
            for name in self._names("parts"):
                if name not in kept and int(name.split("-")[1]) < older[-1]:
                    self._files.delete(self._paths(f"{self.root}/parts/{name}"), True)

    # --- rows

    def _read(self, parts: Sequence[Part], touched: set[int] | None) -> DataFrame:
        folders = []
        for p in parts:
            if p.buckets is None:
                folders.append(f"{self.root}/parts/{p.name}")
            else:
                folders += [f"{self.root}/parts/{p.name}/bucket={b}" for b in p.buckets if touched is None or b in touched]
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*folders)

    def rows(self, before: int | None = None) -> DataFrame:
        """All rows, replaced ones included where they have not been merged yet."""
        return self._read(self.parts(before), None)

    def lookup(self, keys: DataFrame, before: int) -> DataFrame:
        """Rows whose keys are among ``keys``, as batch ``before`` finds them; only the buckets of these keys are read."""
        parts = self.parts(before)
        wanted = keys.select(*self.keys).distinct()
        touched = None
        if any(p.buckets for p in parts):
            touched = {r[0] for r in wanted.select(self.bucket()).distinct().collect()}  # at most ``buckets`` numbers
        return self._read(parts, touched).join(wanted, self.keys, "left_semi")

    def add(self, rows: DataFrame, batch_id: int, current: Callable[[DataFrame], DataFrame]) -> None:
        """Add a batch and merge full levels. ``current`` drops replaced rows; merging may leave some in."""
        self._sweep(batch_id)
        fields = [f.name for f in self.schema.fields[:-1]]
        name = f"0-{batch_id}-{batch_id}"
        rows.select(*fields, F.lit(batch_id).cast("long").alias("part_no")).write.mode("overwrite").parquet(f"{self.root}/parts/{name}")
        parts, level = [*self.parts(batch_id), Part(name, 0, None)], 0
        while len(full := [p for p in parts if p.level == level]) >= self.fan:
            level += 1
            first = min(int(p.name.split("-")[2]) for p in full)
            name = f"{level}-{batch_id}-{first}"
            merged = current(self._read(full, None)).withColumn("bucket", self.bucket())
            merged.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/parts/{name}")
            found = sorted(int(n.split("=")[1]) for n in self._names(f"parts/{name}") if n.startswith("bucket="))
            parts = [p for p in parts if p not in full] + [Part(name, level, found)]
        self._publish(batch_id, parts)


def newest(keys: Sequence[str]) -> Callable[[DataFrame], DataFrame]:
    """Keeps the row of the last batch of every key."""

    def current(rows: DataFrame) -> DataFrame:
        fields = [c for c in rows.columns if c not in (*keys, "part_no")]
        return rows.groupBy(*keys).agg(F.max_by(F.struct(*fields, "part_no"), "part_no").alias("r")).select(*keys, "r.*")

    return current
