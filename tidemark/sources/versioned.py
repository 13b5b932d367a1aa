"""Tables of versions with optimistic commits: a writer names the version it has read, and is refused if another came first.

A version is a manifest, a small JSON file that lists the folders of Parquet files which make up the table. Files are
written aside first; then the manifest is written under a name of its own and renamed to the version's, a step that a
file system does for one writer only. Readers see whole versions, old ones stay readable, and a run that breaks off leaves
folders that no manifest names. On object stores without atomic renames, give a folder on a file system that has them.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Conflict(RuntimeError):
    """Another writer has committed the version."""


class Versioned:
    """A table at a path of any file system that Spark knows."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _manifest(self, version: int) -> str:
        return f"{self.path}/versions/{version:012d}.json"

    def version(self) -> int:
        """The last version, 0 for a table that isn't there."""
        fs, p = self._fs(f"{self.path}/versions")
        if not fs.exists(p):
            return 0
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        return max((int(n[:12]) for n in names if n.endswith(".json") and n[:12].isdigit()), default=0)

    def folders(self, version: int) -> list[str]:
        if version == 0:
            return []
        return json.loads(self.spark.read.text(self._manifest(version), wholetext=True).first()[0])

    def read(self, schema: str, version: int | None = None) -> tuple[int, DataFrame]:
        """A version, the last if None, and its rows."""
        version = self.version() if version is None else version
        found = self.folders(version)
        return version, self.spark.read.schema(schema).parquet(*found) if found else self.spark.createDataFrame([], schema)

    def _written(self, rows: DataFrame) -> str:
        folder = f"{self.path}/data/{uuid.uuid4().hex}"
        rows.write.parquet(folder)
        return folder

    def append(self, rows: DataFrame, read_version: int) -> int:
        return self._commit([*self.folders(read_version), self._written(rows)], read_version)

    def replace(self, rows: DataFrame, read_version: int) -> int:
        return self._commit([self._written(rows)], read_version)

    def _commit(self, folders: list[str], read_version: int) -> int:
        """Makes the folders the version after the one read, or raises Conflict."""
        aside, target = f"{self.path}/versions/_{uuid.uuid4().hex}", self._manifest(read_version + 1)
        fs, p = self._fs(aside)
        out = fs.create(p, False)
        out.write(bytearray(json.dumps(folders).encode()))
        out.close()
        _, to = self._fs(target)
        if fs.exists(to) or not fs.rename(p, to):
            fs.delete(p, False)
            raise Conflict(f"version {read_version + 1} of {self.path} is there already")
        return read_version + 1


CLAIMS = "key string, owner string"


def claim(table: Versioned, key: str, owner: str) -> bool:
    """Whether owner has the key: the first to claim it has it for good, whoever asks again."""
    while True:
        version, rows = table.read(CLAIMS)
        held = rows.where(F.col("key") == key).first()
        if held:
            return held["owner"] == owner
        try:
            table.append(table.spark.createDataFrame([(key, owner)], CLAIMS), version)
            return True
        except Conflict:
            continue


CHAMPIONS = "id string, since timestamp_ntz, until timestamp_ntz, score double"


def crown(table: Versioned, challenger: str, score: float, at: str, ratio: float = 1.1) -> bool:
    """Makes the challenger champion if there is none or it beats the one there is by `ratio`; the old one keeps its time."""
    while True:
        version, rows = table.read(CHAMPIONS)
        now = F.lit(at).cast("timestamp_ntz")
        ruling = rows.where("until is null").first()
        if ruling and (ruling["id"] == challenger or score < ratio * ruling["score"]):
            return ruling["id"] == challenger
        closed = rows.withColumn("until", F.coalesce("until", now))
        new = table.spark.range(1).select(F.lit(challenger).alias("id"), now.alias("since"), F.lit(None).cast("timestamp_ntz").alias("until"), F.lit(float(score)).alias("score"))
        try:
            table.replace(closed.unionByName(new), version)
            return True
        except Conflict:
            continue


def uncrown(table: Versioned, at: str) -> str | None:
    """Ends the champion's time and gives the one before it a new one; its id, or None."""
    while True:
        version, rows = table.read(CHAMPIONS)
        now = F.lit(at).cast("timestamp_ntz")
        ruling = rows.where("until is null").first()
        if not ruling:
            return None
        before = rows.where(F.col("until").isNotNull() & (F.col("id") != ruling["id"])).orderBy(F.desc("until"), F.desc("since")).first()
        closed = rows.withColumn("until", F.coalesce("until", now))
        if before:
            closed = closed.unionByName(rows.limit(1).select(F.lit(before["id"]).alias("id"), now.alias("since"), F.lit(None).cast("timestamp_ntz").alias("until"), F.lit(before["score"]).alias("score")))
        try:
            table.replace(closed, version)
            return before["id"] if before else None
        except Conflict:
            continue
