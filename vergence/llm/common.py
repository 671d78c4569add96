"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of a shingle, and the similarity in per cent from which two sets are near duplicates.
SHINGLE_WORDS = 5
NEAR_PERCENT = 75
#: Rows of an Arrow batch of texts in the pipeline.
BATCH_ROWS = 500
#: Rows of a packed partition.
PART_ROWS = 100_000
_BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share; set only where the session names none and runs on one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    held = spark.sparkContext.getCheckpointDir()
    if held is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="vergence-"))
        held = spark.sparkContext.getCheckpointDir()
    return held


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's rows of an Arrow batch (Spark's are 10,000) to BATCH_ROWS, so that a task and its Python worker hold few texts at once."""
    if not 0 < int(spark.conf.get(_BATCH_ROWS)) <= BATCH_ROWS:
        spark.conf.set(_BATCH_ROWS, BATCH_ROWS)


def cut(df: DataFrame) -> DataFrame:
    """Ends the lineage of a small result in reliable storage.

    Spark drops the files with the last reference where spark.cleaner.referenceTracking.cleanCheckpoints
    is on; what is large goes to a Scratch, which drops its tables itself."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


class Scratch:
    """Parquet tables in the shared folder that end the lineage, in a folder for each run of an operator.

    drop() deletes tables whose readers are done.  Of a run that ends well only last() is left: the
    table that the returned frame, which is lazy, still reads.  All go when the session's JVM ends."""

    def __init__(self, spark: SparkSession):
        self.spark, self.top, self.made = spark, f"{shared_dir(spark)}/vergence-{uuid.uuid4().hex}", 0
        self._path(self.top).getFileSystem(self._conf()).deleteOnExit(self._path(self.top))

    def _conf(self):
        return self.spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)

    def table(self, df: DataFrame) -> DataFrame:
        self.made += 1
        path = f"{self.top}/{self.made}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *frames: DataFrame) -> None:
        """Deletes the files of tables, whose readers must have ended."""
        for df in frames:
            for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
                path = self._path(name)
                path.getFileSystem(self._conf()).delete(path, True)

    def last(self, df: DataFrame) -> DataFrame:
        """The table of df; all others of this run are deleted, so nothing else may read them any more."""
        before, path = self.made, self._path(self.top)
        out = self.table(df)
        for i in range(1, before + 1):
            path.getFileSystem(self._conf()).delete(self._path(f"{self.top}/{i}"), True)
        return out


def stored(df: DataFrame, name: str) -> DataFrame:
    """As cut(), but as a Parquet table, for what is large and read more than once."""
    path = f"{shared_dir(df.sparkSession)}/vergence-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def packed(df: DataFrame, rows: int) -> DataFrame:
    """df, of at most so many narrow rows, in one partition for each PART_ROWS of them: a small table is few tasks and few files, whatever number the session's shuffles have."""
    return df.coalesce(max(1, -(-rows // PART_ROWS)))


def sized_broadcast(df: DataFrame, rows: int, most: int = 1_000_000) -> DataFrame:
    """Hints a broadcast if the counted rows (narrow ones) are few enough; else the join shuffles."""
    return F.broadcast(df) if rows <= most else df
