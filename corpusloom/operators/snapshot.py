"""Tables of snapshots on any store that Spark reads: a repository's new version is written beside the old, then named current.

Layout: <root>/<table>/version=<v>/repo=<r>/kind=<k>/*.parquet and <root>/<table>/_current/<r>/<n>.json, which names a version; the largest n is current.
A change of one repository rewrites that one and adds a number, so manifests are never replaced, and writers of different repositories don't meet. Two
writers of one repository want the same number, and the second fails. The version before the current one stays until the next write, so what
was read from it can still be used.
"""

from __future__ import annotations

import json
import uuid
from urllib.parse import quote, unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom import schema


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.shapes = {"fragment": schema.FRAGMENT, "edge": schema.EDGE}

    def _fs(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def migrate(self) -> int:
        """Makes the root and notes the schema's version; again and again does nothing more."""
        fs, at = self._fs(f"{self.root}/_schema.json")
        if not fs.exists(at):
            self._put(f"{self.root}/_schema.json", {"version": schema.VERSION})
        return json.loads(self._get(f"{self.root}/_schema.json"))["version"]

    def _put(self, path: str, value: dict) -> None:
        """Writes beside and renames, so a reader never sees half a file; what is there already is not replaced."""
        fs, at = self._fs(path)
        new = self.spark._jvm.org.apache.hadoop.fs.Path(at.getParent(), f"_{uuid.uuid4().hex}")
        out = fs.create(new, True)
        out.write(bytearray(json.dumps(value, sort_keys=True).encode()))
        out.close()
        if fs.exists(at) or not fs.rename(new, at):
            fs.delete(new, False)
            raise OSError(f"{path} is there already: another writer was first")

    def _get(self, path: str) -> str | None:
        fs, at = self._fs(path)
        if not fs.exists(at):
            return None
        with_ = fs.open(at)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(with_, "UTF-8")
        finally:
            with_.close()

    def _numbers(self, table: str, repo: str) -> list[int]:
        """Numbers of a repository's manifests, ascending."""
        fs, at = self._fs(f"{self.root}/{table}/_current/{quote(repo, safe='')}")
        names = [x.getPath().getName() for x in fs.listStatus(at)] if fs.exists(at) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def _named(self, table: str, repo: str, number: int) -> str | None:
        return json.loads(self._get(f"{self.root}/{table}/_current/{quote(repo, safe='')}/{number:012}.json") or "{}").get("version")

    def current(self, table: str, repo: str | None = None) -> dict[str, str]:
        """The version of each repository, or of one."""
        fs, at = self._fs(f"{self.root}/{table}/_current")
        repos = [repo] if repo is not None else [unquote(x.getPath().getName()) for x in fs.listStatus(at)] if fs.exists(at) else []
        found = {r: self._named(table, r, n[-1]) for r in repos if (n := self._numbers(table, r))}
        return {r: v for r, v in found.items() if v}

    def read(self, table: str, repo: str | None = None) -> DataFrame:
        """The current rows, of one repository or of all; only their folders are listed."""
        shape, versions = self.shapes[table], self.current(table, repo)
        if not versions:
            return self.spark.createDataFrame([], T.StructType([T.StructField(f.name, f.dataType) for f in shape.fields]))
        full = T.StructType([*[T.StructField(f.name, f.dataType) for f in shape.fields if f.name not in ("repo", "kind")], T.StructField("version", T.StringType()), T.StructField("repo", T.StringType()), T.StructField("kind", T.StringType())])
        paths = [f"{self.root}/{table}/version={v}" for v in versions.values()]
        found = self.spark.read.schema(full).option("basePath", f"{self.root}/{table}").parquet(*paths)
        return found.select(*[f.name for f in shape.fields])

    def write(self, table: str, repo: str, rows: DataFrame) -> None:
        """Makes rows the repository's current ones. Rows may be made from the current version: that stays until the new one is named."""
        version, numbers = uuid.uuid4().hex, self._numbers(table, repo)
        shape = self.shapes[table]
        at = f"{self.root}/{table}/version={version}"
        rows.where(F.col("repo") == repo).select(*[f.name for f in shape.fields]).write.partitionBy("repo", "kind").parquet(at)
        fs, path = self._fs(at)
        if not any(s.isDirectory() for s in fs.listStatus(path)):  # no rows: the repository goes
            fs.delete(path, True)
            version = None
        self._put(f"{self.root}/{table}/_current/{quote(repo, safe='')}/{numbers[-1] + 1 if numbers else 0:012}.json", {"version": version})
        for n in numbers[:-1]:
            if old := self._named(table, repo, n):
                fs.delete(self._fs(f"{self.root}/{table}/version={old}")[1], True)
            fs.delete(self._fs(f"{self.root}/{table}/_current/{quote(repo, safe='')}/{n:012}.json")[1], False)
