"""Atomic multi-table commits on plain files.

A commit writes changed tables to new folders and then one manifest that names the folder of every table. The manifest appears
by a rename that fails if it exists, so readers see all of a commit or nothing. A writer names the version that it has read; of
two that read the same one, the second is refused. That the rename is atomic holds for HDFS and local file systems; an object
store needs a file system with conditional creation in its place.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession


class ConflictError(RuntimeError):
    pass


class Snapshots:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(f"{self.root}/manifests"))

    def _name(self, version: int) -> str:
        return f"{self.root}/manifests/{version:012d}.json"

    def version(self) -> int:
        """The newest version; 0 before the first commit."""
        names = (s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.root}/manifests")))
        return max((int(n[:12]) for n in names if n.endswith(".json") and n[0] != "."), default=0)

    def manifest(self, version: int | None = None) -> dict[str, str]:
        version = self.version() if version is None else version
        if not version:
            return {}
        stream = self._fs.open(self._path(self._name(version)))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def read(self, table: str, version: int | None = None) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{self.manifest(version)[table]}")

    def has(self, table: str, version: int | None = None) -> bool:
        return table in self.manifest(version)

    def commit(self, tables: Mapping[str, DataFrame], base: int | None = None) -> int:
        """Write tables on top of a version, the newest by default; the others stay as they are there."""
        base = self.version() if base is None else base
        folders = self.manifest(base)
        tag = uuid.uuid4().hex
        for name, df in tables.items():
            folders[name] = f"data/{name}/{base + 1:012d}-{tag}"
            df.write.parquet(f"{self.root}/{folders[name]}")
        draft = self._path(f"{self.root}/manifests/.{tag}")
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps(folders).encode()))
        out.close()
        final = self._path(self._name(base + 1))
        if self._fs.exists(final) or not self._fs.rename(draft, final):
            self._fs.delete(draft, False)
            raise ConflictError(f"version {base + 1} is there already")
        return base + 1
