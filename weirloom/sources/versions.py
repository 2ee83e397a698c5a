"""Versioned tables: several tables change in one commit, readers see one version of all of them.

Files are never changed. A commit writes new folders and then a manifest, the list of folders
of each table, under the next number; renaming a draft to that name is the commit, and of two writers that
began from one version only one can take it. A write that fails before leaves folders that no
manifest names, and readers at the old version. Tables are kept in buckets by a key, and a
commit writes anew only those buckets in which something changed.

Defined results: a table that no commit has written reads as None; version 0 is the empty store;
rows without a key are in bucket 0.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 32
#: The column that folders of a table are named by.
BUCKET = "_bucket"


class Conflict(RuntimeError):
    """Another commit has taken the next version."""


class Store:
    """Versioned tables below a folder that the driver and all executors reach."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def _file(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def version(self) -> int:
        """The number of the last commit."""
        files, folder = self._file("manifests")
        names = [f.getPath().getName() for f in files.listStatus(folder)] if files.exists(folder) else []
        return max((int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0] != "."), default=0)

    def manifest(self, version: int | None = None) -> dict[str, dict[str, list[str]]]:
        """The folders of each bucket of each table."""
        version = self.version() if version is None else version
        if version == 0:
            return {}
        return json.loads("\n".join(r["value"] for r in self.spark.read.text(f"{self.path}/manifests/{version:010d}.json").collect()))

    def bucket(self, key: Column) -> Column:
        return F.coalesce(F.pmod(F.xxhash64(key), F.lit(self.buckets)), F.lit(0)).cast("int")

    def read(self, name: str, version: int | None = None, buckets: list[int] | None = None) -> DataFrame | None:
        """A table as of a version, the last one unless told otherwise, of all or some buckets."""
        return self.table(self.manifest(version).get(name), buckets)

    def table(self, folders: dict[str, list[str]] | None, buckets: list[int] | None = None) -> DataFrame | None:
        """The table that a manifest's folders make, or None for none."""
        if folders is None:
            return None
        schema, parts = folders["schema"][0], [f for b, fs in folders.items() if b != "schema" and (buckets is None or int(b) in buckets) for f in fs]
        if not parts:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/{f}" for f in parts))

    def begin(self) -> Commit:
        return Commit(self, self.version())


class Commit:
    """Changes to some tables that become visible together."""

    def __init__(self, store: Store, base: int):
        self.store, self.base, self.tables = store, base, store.manifest(base)

    def read(self, name: str, buckets: list[int] | None = None) -> DataFrame | None:
        """A table as it will be with the changes so far, before they are visible to others."""
        return self.store.table(self.tables.get(name), buckets)

    def _write(self, name: str, rows: DataFrame, key: str, dealt: bool = False) -> dict[str, list[str]]:
        """dealt: a task's rows are of few buckets already, by their column BUCKET or as they were read from them, so nothing is shuffled."""
        folder, s = f"data/{name}/{uuid.uuid4().hex}", self.store
        rows = rows if BUCKET in rows.columns else rows.withColumn(BUCKET, s.bucket(F.col(key)))
        (rows if dealt else rows.repartition(BUCKET)).write.option("compression", "zstd").partitionBy(BUCKET).parquet(f"{s.path}/{folder}")
        files, path = s._file(folder)
        made = [f.getPath().getName() for f in files.listStatus(path)]
        return {n.removeprefix("_bucket="): [f"{folder}/{n}"] for n in made if n.startswith("_bucket=")}

    def put(self, name: str, rows: DataFrame, key: str, buckets: list[int] | None = None, dealt: bool = False) -> Commit:
        """The table's rows, or those of some buckets, from now on."""
        kept = {b: f for b, f in self.tables.get(name, {}).items() if buckets is not None and (b == "schema" or int(b) not in buckets)}
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != BUCKET)
        self.tables[name] = kept | self._write(name, rows, key, dealt) | {"schema": [schema]}
        return self

    def add(self, name: str, rows: DataFrame, key: str) -> Commit:
        """More rows of a table."""
        own = self.tables.setdefault(name, {"schema": [", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)]})
        for b, folders in self._write(name, rows, key).items():
            own[b] = [*own.get(b, []), *folders]
        return self

    def commit(self) -> int:
        """Makes the changes visible; Conflict if another commit came between."""
        s = self.store
        files, draft = s._file(f"manifests/.{uuid.uuid4().hex}")
        _, path = s._file(f"manifests/{self.base + 1:010d}.json")
        stream = files.create(draft, True)
        stream.write(bytearray(json.dumps(self.tables).encode()))
        stream.close()
        fs = s.spark._jvm.org.apache.hadoop.fs
        mode = s.spark.sparkContext._gateway.new_array(fs.Options.Rename, 1)
        mode[0] = fs.Options.Rename.NONE
        try:
            fs.FileContext.getFileContext(path.toUri(), s.spark._jsc.hadoopConfiguration()).rename(draft, path, mode)
        except Py4JJavaError as e:  # a rename that does not overwrite fails if the name is taken
            files.delete(draft, False)
            raise Conflict(f"version {self.base + 1} is taken") from e
        return self.base + 1
