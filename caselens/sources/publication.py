"""Several artifacts published as one set: readers see all of the old set or all of the new.

A set is staged in a folder of its own. Its manifest names every file with its
size and SHA-256, computed by Spark where the files are. The set becomes current
when one small pointer file is renamed over the old one; until then, and after a
stop at any place before, readers resolve the old pointer. Staged sets that the
pointer doesn't name can be cleared.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POINTER, MANIFEST = "CURRENT", "MANIFEST.json"


class Publication:
    """A root folder with sets below ``sets/`` and the pointer to the current one."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
        self._overwrite = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE

    def _put(self, name: str, text: str) -> None:
        out = self._fs.create(self._path(name), True)
        out.write(bytearray(text.encode()))
        out.close()

    def _get(self, name: str) -> str:
        lines = self.spark.read.option("wholetext", True).text(name).collect()
        return lines[0][0] if lines else ""

    def current(self) -> str | None:
        """The id of the current set; None before the first."""
        return self._get(f"{self.root}/{POINTER}").strip() if self._fs.exists(self._path(f"{self.root}/{POINTER}")) else None

    def stage(self, artifacts: dict[str, DataFrame]) -> str:
        """Writes all artifacts and their manifest beside the current set; returns the staged set's id."""
        staged = uuid.uuid4().hex
        for name, df in artifacts.items():
            df.write.parquet(f"{self.root}/sets/{staged}/{name}")
        self._put(f"{self.root}/sets/{staged}/{MANIFEST}", json.dumps(self._files(staged, sorted(artifacts)), sort_keys=True))
        return staged

    def _files(self, staged: str, names: list[str]) -> list[dict]:
        """Path within the set, size and SHA-256 of every file; digests are computed in tasks, a row a file comes back."""
        found = []
        for name in names:
            files = self.spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(f"{self.root}/sets/{staged}/{name}")
            rows = files.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))
            found += [{"artifact": name, **r.asDict()} for r in rows.collect()]
        return sorted(found, key=lambda f: (f["artifact"], f["file"]))

    def switch(self, staged: str) -> None:
        """Makes a staged set current, if its files still are what its manifest says."""
        manifest = json.loads(self._get(f"{self.root}/sets/{staged}/{MANIFEST}"))
        if self._files(staged, sorted({f["artifact"] for f in manifest})) != manifest:
            raise ValueError(f"set {staged} differs from its manifest")
        self._put(f"{self.root}/.{staged}", staged)
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri())
        options = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = self._overwrite
        context.rename(self._path(f"{self.root}/.{staged}"), self._path(f"{self.root}/{POINTER}"), options)

    def publish(self, artifacts: dict[str, DataFrame]) -> str:
        staged = self.stage(artifacts)
        self.switch(staged)
        return staged

    def read(self, name: str) -> DataFrame:
        """An artifact of the current set."""
        if (staged := self.current()) is None:
            raise FileNotFoundError(f"nothing is published under {self.root}")
        return self.spark.read.parquet(f"{self.root}/sets/{staged}/{name}")

    def clear_staged(self) -> list[str]:
        """Deletes sets that aren't current, such as those of a run that stopped; returns their ids."""
        sets, kept = self._path(f"{self.root}/sets"), self.current()
        gone = [s.getPath().getName() for s in self._fs.listStatus(sets)] if self._fs.exists(sets) else []
        gone = sorted(s for s in gone if s != kept)
        for name in gone:
            self._fs.delete(self._path(f"{self.root}/sets/{name}"), True)
            self._fs.delete(self._path(f"{self.root}/.{name}"), False)
        return gone
