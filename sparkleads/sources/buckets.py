"""Tables kept in parts by a hash of their key, changed by copying the parts that a change touches.

A part is a folder of Parquet files that is never written twice. A manifest names the parts of a version, and a version counts once its
manifest can be read, so readers see the version before a change or the one after it, also if the run breaks off between. A change reads the rows of the parts that
its keys fall into, nothing else, and a batch number in the manifest makes a repeated batch do nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.latest import best_per_key
from ..operators.settle import file_system, settled, small

#: Parts of a table by key, times its days if it is kept by day too.
BUCKETS = 64


class BucketTable:
    """A table at `path`; `key` columns choose a row's bucket (null is a key like others), `day`, a time column, a day within it."""

    def __init__(self, spark: SparkSession, path: str, key: Sequence[str], buckets: int = BUCKETS, day: str | None = None) -> None:
        self.spark, self.path, self.key, self.buckets, self.day = spark, path.rstrip("/"), list(key), buckets, day

    def _bucket(self):
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("string")

    def placed(self, rows: DataFrame) -> DataFrame:
        """`rows` with `_part`, the name of their part."""
        within = [F.coalesce(F.date_format(self.day, "yyyyMMdd"), F.lit("none"))] if self.day else []
        return rows.withColumn("_part", F.concat_ws("-", self._bucket(), *within))

    def _manifests(self) -> list[str]:
        """Names of manifests, newest first; one that can't be read is of a writer that broke off."""
        fs, folder = file_system(self.spark, f"{self.path}/manifest")
        return sorted((x.getPath().getName() for x in fs.listStatus(folder)), reverse=True) if fs.exists(folder) else []

    def manifest(self) -> dict:
        """The newest version whose manifest can be read."""
        fs, _ = file_system(self.spark, self.path)
        for name in self._manifests():
            stream = fs.open(file_system(self.spark, f"{self.path}/manifest/{name}")[1])
            try:
                return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
            except ValueError:  # its writer broke off
                continue
            finally:
                stream.close()
        return {"version": 0, "batch": None, "schema": None, "parts": {}}

    def read(self, parts: Sequence[str] | None = None, like: StructType | None = None) -> DataFrame:
        """The rows of the newest version, or of some of its parts. `like`: the schema of a table that has no version yet."""
        now = self.manifest()
        schema = StructType.fromJson(now["schema"]) if now["schema"] else like
        if schema is None:
            raise FileNotFoundError(f"no table at {self.path}")
        paths = [f"{self.path}/{p}" for name, p in now["parts"].items() if parts is None or name in parts]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def touched(self, rows: DataFrame) -> list[str]:
        """The parts that `rows` fall into: at most as many as the table has."""
        return sorted(r[0] for r in self.placed(rows).select("_part").distinct().collect())

    def merge(self, fresh: DataFrame, combine: Callable[[DataFrame, DataFrame], DataFrame], batch: int | None = None) -> list[str]:
        """Puts `combine(old, fresh)` in the place of the parts that `fresh` touches, `old` being their rows; their names. `batch`: does nothing if the
        newest version is of this batch. An empty `fresh` changes no part."""
        if batch is not None and self.manifest()["batch"] == batch:
            return []
        fresh = settled(fresh)
        parts = self.touched(fresh)
        self.replace(parts, combine(self.read(parts, fresh.schema), fresh), batch)
        return parts

    def replace(self, parts: Sequence[str], rows: DataFrame, batch: int | None = None) -> None:
        """Puts `rows`, all of them of `parts`, in the place of those parts, as the next version."""
        before, data = self.manifest(), f"data/{uuid.uuid4().hex}"
        # Rebalanced: a part with a frequent key is written by several tasks.
        self.placed(rows).hint("rebalance", "_part").write.partitionBy("_part").parquet(f"{self.path}/{data}")
        fs, folder = file_system(self.spark, f"{self.path}/{data}")
        made = {x.getPath().getName().partition("=")[2]: f"{data}/{x.getPath().getName()}" for x in fs.listStatus(folder) if x.isDirectory() and "=" in x.getPath().getName()}
        if stray := sorted(set(made) - set(parts)):
            raise ValueError(f"rows outside the parts that are replaced: {', '.join(stray)}")
        kept = {name: p for name, p in before["parts"].items() if name not in set(parts)}
        newest = self._manifests()[:1]
        self._commit(int(newest[0].split(".")[0]) + 1 if newest else 1, {"batch": batch, "schema": json.loads(rows.schema.json()), "parts": kept | made})

    def _commit(self, version: int, content: dict) -> None:
        fs, path = file_system(self.spark, f"{self.path}/manifest/{version:012}.json")
        out = fs.create(path, False)  # fails if another writer was first
        out.write(bytearray(json.dumps({"version": version, **content}).encode()))
        out.close()

    def vacuum(self) -> int:
        """Removes what the newest version doesn't name: older versions and what broken runs left; how many folders."""
        now, gone = self.manifest(), 0
        fs, data = file_system(self.spark, f"{self.path}/data")
        held = {p.split("/")[1] for p in now["parts"].values()}
        for x in fs.listStatus(data) if fs.exists(data) else []:
            if x.getPath().getName() not in held:
                gone += bool(fs.delete(x.getPath(), True))
        for x in fs.listStatus(file_system(self.spark, f"{self.path}/manifest")[1]) if now["version"] else []:
            if x.getPath().getName() != f"{now['version']:012}.json":
                fs.delete(x.getPath(), False)
        return gone


def upsert(table: BucketTable, fresh: DataFrame, verdict: str, time: str = "checked_at", batch: int | None = None) -> list[str]:
    """Verdicts newer than those the table has for their key take their place; equal times go to the fresh one. Unknown verdicts are refused before anything is written."""
    if not fresh.filter(F.col(verdict).isNull()).isEmpty():
        raise ValueError(f"{verdict} must be known")

    def newest(old: DataFrame, new: DataFrame) -> DataFrame:
        both = new.withColumn("_new", F.lit(1)).unionByName(old.withColumn("_new", F.lit(0)))
        return best_per_key(both, table.key, [F.desc(time), F.desc("_new")]).drop("_new")

    return table.merge(fresh, newest, batch)


def backfill(table: BucketTable, updates: DataFrame, columns: Sequence[str], batch: int | None = None) -> list[str]:
    """Fills missing values of `columns` from `updates` (the key, columns; a key once). Only parts with a row that gets a value are written anew; values that are there stay."""
    if batch is not None and table.manifest()["batch"] == batch:
        return []
    updates = settled(updates.select(*table.key, *[F.col(c).alias(f"_u_{c}") for c in columns]))
    wanted = {r[0] for r in updates.select(table._bucket()).distinct().collect()}
    near = [p for p in table.manifest()["parts"] if p.partition("-")[0] in wanted]
    joined = table.placed(table.read(near)).join(small(updates), table.key, "left")
    gains = F.lit(False)
    for c in columns:
        gains = gains | (F.col(c).isNull() & F.col(f"_u_{c}").isNotNull())
    parts = sorted(r[0] for r in joined.filter(gains).select("_part").distinct().collect())
    if parts:
        old = table.read(parts)
        filled = old.join(small(updates), table.key, "left").withColumns({c: F.coalesce(c, f"_u_{c}") for c in columns}).select(*old.columns)
        table.replace(parts, filled, batch)
    return parts
