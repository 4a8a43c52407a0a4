"""Tables in the folder that the driver and all executors share: written once to cut lineage, or in generations."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Generations of a store that stay: a lost task of the job that writes the newest reads the one before.
KEPT = 2


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one, set for later calls, where Spark runs on this machine
    alone and none is named. On a cluster without one, a ValueError."""
    named = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="spatialfactor-shared-")
        spark.sparkContext.setCheckpointDir(named)
    return named


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as parquet in the shared folder, read back: its rows are settled and its lineage is cut."""
    path = f"{shared_folder(df.sparkSession)}/tables/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder in whatever store holds it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


class Generations:
    """Bucketed tables under one folder, each the successor of the one before; all but the newest ``KEPT`` go from the
    catalog and from disk, unless they are pinned. A generation may carry notes, by which a later session goes on from it.

    Notes are written after their table, so a generation with notes is whole.
    """

    def __init__(self, spark: SparkSession, folder: str, buckets: int, column: str):
        self.spark, self.folder, self.buckets, self.column = spark, folder.rstrip("/"), buckets, column
        self.live: list[str] = []
        self.pinned: set[str] = set()

    def put(self, df: DataFrame, notes: dict | None = None) -> DataFrame:
        """Write the next generation and read it back."""
        name = f"g{uuid.uuid4().hex}"
        df.write.option("path", f"{self.folder}/{name}").bucketBy(self.buckets, self.column).sortBy(self.column).saveAsTable(name)
        self.live.append(name)
        if notes is not None:
            self.note(name, notes)
        return self.spark.table(name)

    def note(self, name: str, notes: dict) -> None:
        """Attach notes to a generation; the newest by their ``order`` is where a resumed run starts."""
        self.spark.createDataFrame([(json.dumps(notes | {"table": name, "buckets": self.buckets}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.folder}/notes/{name}")

    @property
    def newest(self) -> str:
        return self.live[-1]

    def pin(self, name: str) -> None:
        """Keep a generation for good."""
        self.pinned.add(name)

    def prune(self, keep: int = KEPT) -> None:
        """Drop what is older than the newest ``keep`` generations."""
        old = [n for n in (self.live[:-keep] if keep else self.live) if n not in self.pinned]
        for name in old:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            delete(self.spark, f"{self.folder}/{name}")
            delete(self.spark, f"{self.folder}/notes/{name}")
            self.live.remove(name)

    def last(self) -> dict | None:
        """The notes of the newest generation that has any, None where there is none."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/notes")
        if not at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at):
            return None
        found = [json.loads(r["value"]) for r in self.spark.read.text(f"{self.folder}/notes/*").collect()]
        return max(found, key=lambda n: n["order"], default=None)

    def reopen(self, name: str, schema: str, buckets: int) -> DataFrame:
        """A generation of an earlier session, put into this session's catalog again with its buckets."""
        if not self.spark.catalog.tableExists(name):
            self.spark.sql(f"CREATE TABLE {name} ({schema}) USING parquet OPTIONS (path '{self.folder}/{name}') CLUSTERED BY ({self.column}) SORTED BY ({self.column}) INTO {buckets} BUCKETS")
        if name not in self.live:
            self.live.append(name)
        return self.spark.table(name)
