"""Tables of snapshots, each laid out in ranges of its keys with an index of its files.

A snapshot is a folder that is written whole and never changed. What makes it the
table's is one small file in `_versions`, put there by a rename that doesn't
replace: of two writers who started from the same version one is refused, and a
reader, who takes the greatest version there is, never sees a part of a snapshot.
Rolling back is committing an earlier snapshot again; `vacuum` deletes folders that
no version kept needs.

The index has a row a file with the least and the greatest value of each key and
the number of rows. A lookup takes the files that may hold its values, from the
index alone, and reads no others; within a file, Parquet's own statistics skip row
groups, as rows are sorted. A value that many rows share goes on over several
files if further keys tell its rows apart.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Values of a key that one lookup takes at most: they become part of the plan.
MOST_VALUES = 1000


class Conflict(RuntimeError):
    """Another writer committed a version in the meantime."""


class Withdrawn(RuntimeError):
    """The writer's own check, made just before the commit, said no."""


class SnapshotTable:
    """A table at `path` of any file system that Spark writes."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path("").getFileSystem(conf)
        self._files = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), conf)

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def versions(self) -> list[int]:
        folder = self._path("_versions")
        if not self._fs.exists(folder):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(folder)]
        return sorted(int(n) for n in names if n.isdigit())

    def version(self) -> int:
        """The current version; 0 if there is none yet."""
        return max(self.versions(), default=0)

    def _entry(self, version: int) -> dict:
        stream = self._fs.open(self._path(f"_versions/{version:012d}"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def read(self, version: int | None = None) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{self._entry(version or self.version())['folder']}/data")

    def index(self, version: int | None = None) -> DataFrame:
        """file, n and, for each key, least_<key> and most_<key>."""
        return self.spark.read.parquet(f"{self.path}/{self._entry(version or self.version())['folder']}/index")

    def replace(self, rows: DataFrame, *keys: str, files: int | None = None, base: int | None = None, check: Callable[[], bool] | None = None) -> int:
        """Commit `rows`, in ranges of `keys`, as the version after `base` (default: the version now); returns it.

        `base` is the version that rows were made from: where another has been committed since, Conflict is raised. `check` is asked
        just before the commit (is the document canceled by now?); if it says no, Withdrawn is raised. In both cases what was written goes.
        """
        base = self.version() if base is None else base
        folder = f"snapshot-{uuid.uuid4().hex}"
        dealt = rows.repartitionByRange(files, *keys) if files else rows.repartitionByRange(*keys)
        try:
            dealt.sortWithinPartitions(*keys).write.parquet(f"{self.path}/{folder}/data")
            written = self.spark.read.schema(rows.schema).parquet(f"{self.path}/{folder}/data")
            bounds = [f(k).alias(f"{name}_{k}") for k in keys for f, name in ((F.min, "least"), (F.max, "most"))]
            per_file = written.select(F.col("_metadata.file_name").alias("file"), *keys).groupBy("file").agg(F.count(F.lit(1)).alias("n"), *bounds)
            per_file.coalesce(1).write.parquet(f"{self.path}/{folder}/index")
            if check is not None and not check():
                raise Withdrawn(f"version {base + 1} of {self.path}")
            self._commit(base + 1, {"folder": folder, "keys": list(keys)})
        except BaseException:
            self._fs.delete(self._path(folder), True)
            raise
        return base + 1

    def _commit(self, version: int, entry: dict) -> None:
        self._fs.mkdirs(self._path("_versions"))
        draft, final = self._path(f"_versions/.{uuid.uuid4().hex}"), self._path(f"_versions/{version:012d}")
        stream = self._fs.create(draft, True)
        stream.write(bytearray(json.dumps(entry).encode()))
        stream.close()
        rename = getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename")
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.NONE
        try:
            self._files.rename(draft, final, options)
        except Py4JJavaError as error:
            self._fs.delete(draft, False)
            if "FileAlreadyExistsException" in str(error.java_exception):
                raise Conflict(f"version {version} of {self.path} is there already") from error
            raise

    def roll_back(self, version: int) -> int:
        """Commit an earlier version's snapshot as the newest."""
        now = self.version()
        self._commit(now + 1, self._entry(version))
        return now + 1

    def vacuum(self, keep: int = 2) -> None:
        """Forget all but the newest versions, and delete the snapshots that only those had; nobody may still read or write them."""
        versions = self.versions()
        entries = {v: self._entry(v)["folder"] for v in versions}
        kept = {entries[v] for v in versions[-keep:]}
        for v in versions[:-keep]:
            self._fs.delete(self._path(f"_versions/{v:012d}"), False)
            if entries[v] not in kept:
                self._fs.delete(self._path(entries[v]), True)

    @staticmethod
    def _within(values: list, least: Column, most: Column) -> Column:
        return F.exists(F.array(*map(F.lit, values)), lambda v: (least <= v) & (v <= most)) if values else F.lit(False)

    def lookup(self, version: int | None = None, **values) -> DataFrame:
        """Rows whose keys have the given values (one or a list each), from the files that may hold them."""
        entry = self._entry(version or self.version())
        may: Column = F.lit(True)
        exact: Column = F.lit(True)
        for key, wanted in values.items():
            if key not in entry["keys"]:
                raise ValueError(f"the table is laid out by {entry['keys']}, not {key}")
            wanted = list(dict.fromkeys(wanted)) if isinstance(wanted, list | tuple) else [wanted]
            if len(wanted) > MOST_VALUES:
                raise ValueError(f"a lookup takes {MOST_VALUES} values of a key at most; these are {len(wanted)}")
            may = may & self._within(wanted, F.col(f"least_{key}"), F.col(f"most_{key}"))
            exact = exact & F.col(key).isin(wanted)
        folder = f"{self.path}/{entry['folder']}"
        files = [r["file"] for r in self.spark.read.parquet(f"{folder}/index").where(may).select("file").collect()]
        if not files:
            return self.spark.read.parquet(f"{folder}/data").where(F.lit(False))
        return self.spark.read.parquet(*[f"{folder}/data/{f}" for f in files]).where(exact)


def shared_folder(spark: SparkSession) -> str:
    """A folder that driver and executors share: spark.checkpoint.dir, or where that is unset the warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/docloom-tables/{spark.sparkContext.applicationId}"
