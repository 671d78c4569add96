"""Tables that change together: each state is a set of Parquet tables, and one renamed manifest makes it the current one."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession


class Snapshots:
    """States of a set of tables in a shared folder.

    A new state is staged beside the current one, in a folder that nobody reads.  Only the rename of its
    manifest, the last step, makes it current, and fails if another writer has made that number meanwhile.
    A run that is lost before leaves the old state readable and only unread folders behind."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.staged = spark, root.rstrip("/"), {}
        self.folder = f"{self.root}/data/{uuid.uuid4().hex}"
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self._path(self.root).getFileSystem(self._conf)
        self.number, self._places = self._latest()

    def _path(self, name: str):
        return self._hadoop.Path(name)

    def _latest(self) -> tuple[int, dict[str, str]]:
        top = self._path(f"{self.root}/manifests")
        names = sorted(s.getPath().getName() for s in self._fs.listStatus(top)) if self._fs.exists(top) else []
        if not names:
            return 0, {}
        return int(names[-1]), json.loads(self.spark.read.text(f"{self.root}/manifests/{names[-1]}", wholetext=True).first()[0])

    def current(self) -> dict[str, DataFrame]:
        """The tables of the state that was current when this object was made."""
        return {name: self.spark.read.parquet(place) for name, place in self._places.items()}

    def stage(self, name: str, rows: DataFrame) -> DataFrame:
        """Writes a table of the next state, and reads it again, so that what follows is cut off from its lineage."""
        place = f"{self.folder}/{name}"
        rows.write.parquet(place)
        self.staged[name] = place
        return self.spark.read.parquet(place)

    def commit(self) -> int:
        """Makes the staged tables current, with the tables that weren't staged as they were; gives the state's number."""
        draft, at = self._path(f"{self.folder}/manifest"), self._path(f"{self.root}/manifests/{self.number + 1:012d}")
        self._fs.mkdirs(at.getParent())
        out = self._fs.create(draft, True)
        out.write(bytearray(json.dumps(self._places | self.staged), "utf-8"))
        out.close()
        options = self.spark.sparkContext._gateway.new_array(self._hadoop.Options.Rename, 0)  # none: never over an existing manifest
        self._hadoop.FileContext.getFileContext(self._fs.getUri(), self._conf).rename(draft, at, options)
        return self.number + 1
