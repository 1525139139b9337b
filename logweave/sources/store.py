"""The stored index: immutable snapshots of the sessions table behind a pointer.

A write makes a new snapshot directory and then one small pointer directory; readers follow the
newest complete pointer, so they never see half a write.  A sync reads file times first, parses
only the files of new or changed sessions, and writes upserts and deletes as one snapshot.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave import schema as S
from logweave.operators.search import recency, with_lower
from logweave.operators.sessionize import sessionize
from logweave.sources import logs


def stale(files: DataFrame, stored: DataFrame) -> DataFrame:
    """Files whose session is not stored or is stored with an earlier time."""
    known = stored.select("sid", F.col("mtime_epoch").alias("stored_epoch"), F.lit(True).alias("known"))
    return files.join(known, "sid", "left").where(F.col("known").isNull() | (F.col("stored_epoch") < F.col("mtime_epoch"))).drop("stored_epoch", "known")


def prune(stored: DataFrame, files: DataFrame) -> DataFrame:
    """Stored rows whose session still has a file."""
    return stored.join(files.select("sid").distinct(), "sid", "left_semi")


def upsert(stored: DataFrame, new: DataFrame) -> DataFrame:
    """New rows replace stored ones of the same id; a replaced row's embedding is gone with it."""
    if "embedding" not in new.columns:
        new = new.withColumn("embedding", F.lit(None).cast("array<float>"))
    return stored.join(new.select("sid"), "sid", "left_anti").unionByName(new.select(*stored.columns))


def newest_files(files: DataFrame) -> DataFrame:
    """One file per session: the latest, then the greatest path."""
    return files.groupBy("sid").agg(F.max(F.struct("mtime_epoch", "path")).alias("f")).select("sid", "f.path", "f.mtime_epoch")


def with_embeddings(stored: DataFrame, new: DataFrame) -> DataFrame:
    """New embeddings set by id, others kept."""
    return stored.join(new.select("sid", F.col("embedding").alias("new_embedding")), "sid", "left").withColumn("embedding", F.coalesce("new_embedding", "embedding")).drop("new_embedding")


def pending(stored: DataFrame) -> DataFrame:
    """``sid``, ``label`` of rows that have no embedding yet and can get one."""
    return stored.where(F.col("embedding").isNull() & (F.octet_length("label") >= S.EMBED_LABEL_BYTES)).select("sid", "label")


class SessionStore:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _versions(self) -> list[int]:
        fs, root = self._fs(f"{self.folder}/current")
        if not fs.exists(root):
            return []
        found = [s.getPath().getName() for s in fs.listStatus(root)]
        return sorted(int(n) for n in found if n.isdigit() and fs.exists(self._fs(f"{self.folder}/current/{n}/_SUCCESS")[1]))

    def read(self) -> DataFrame:
        """The stored sessions; an empty table before the first write."""
        versions = self._versions()
        if not versions:
            return self.spark.createDataFrame([], S.SESSIONS)
        name = self.spark.read.text(f"{self.folder}/current/{versions[-1]}").first().value
        return self.spark.read.parquet(f"{self.folder}/snapshots/{name}")

    def load(self) -> DataFrame:
        return self.read().orderBy(*recency())

    def write(self, sessions: DataFrame) -> None:
        """A new snapshot with lower-case search columns, then the pointer to it."""
        name = uuid.uuid4().hex
        columns = [f.split(" ")[0] for f in S.SESSIONS.split(", ")]
        with_lower(sessions.select(*columns)).write.parquet(f"{self.folder}/snapshots/{name}")
        version = (self._versions() or [0])[-1] + 1
        self.spark.createDataFrame([(name,)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.folder}/current/{version}")

    def sync(self, root: str, force: bool = False) -> dict[str, int]:
        """Brings the index up to date with the files under ``root``; gives the counts of what was done.

        A root that cannot be listed raises and nothing is pruned.  A changed file that holds no
        message keeps its old row.
        """
        fs, path = self._fs(root)
        if not fs.exists(path):
            raise FileNotFoundError(root)
        files = newest_files(logs.list_sessions(self.spark, root)) if fs.globStatus(self._fs(f"{root}/*/*.jsonl")[1]) else self.spark.createDataFrame([], "sid string, path string, mtime_epoch long")
        stored = self.spark.createDataFrame([], S.SESSIONS) if force else self.read().select(*[f.split(" ")[0] for f in S.SESSIONS.split(", ")])
        todo = stale(files, stored)
        paths = [r.path for r in todo.select("path").collect()]  # file names, which the scan needs as a list
        new = self.spark.createDataFrame([], S.SESSIONS)
        if paths:
            new = sessionize(logs.events(logs.read_lines(self.spark, paths)), files)
            new = new.withColumn("embedding", F.lit(None).cast("array<float>"))
        kept = prune(stored, files)
        counts = {"files": len(paths), "gone": stored.count() - kept.count()}
        self.write(upsert(kept, new))
        return counts

    def drop(self) -> None:
        fs, path = self._fs(self.folder)
        fs.delete(path, True)
