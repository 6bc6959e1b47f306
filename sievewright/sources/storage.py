"""Files of any store that Spark can reach, by way of Hadoop's file systems on the driver; and the shared folder."""

from __future__ import annotations

import json
import re
import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

_OWN_DIR: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. On one machine, as in tests, a temporary one if that is unset."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    application = spark.sparkContext.applicationId
    if application not in _OWN_DIR:
        _OWN_DIR[application] = tempfile.mkdtemp(prefix="sievewright-")
    return _OWN_DIR[application]


def _scratch(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/sievewright-{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{_scratch(spark)}/{uuid.uuid4().hex}/{name}"


def clear_scratch(spark: SparkSession) -> None:
    """Deletes what this application has written to the shared folder; results that aren't stored yet are lost."""
    Store(spark, shared_dir(spark)).delete(_scratch(spark).rsplit("/", 1)[-1])


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written as Parquet in the shared folder and read back: lineage ends there, and lost executors cost nothing."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables that written() gave and that nothing reads any more."""
    for df in tables:
        folder, _, name = df._scratch.rpartition("/")
        Store(df.sparkSession, folder).delete(name)


class Store:
    """A folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def names(self) -> list[str]:
        root = self._path(self.root)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(root)) if self._fs.exists(root) else []

    def read_json(self, name: str) -> dict:
        stream = self._fs.open(self._path(self.path(name)))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def put_json(self, name: str, value: dict) -> None:
        """The file appears whole or not at all; an existing one is an error."""
        final, part = self._path(self.path(name)), self._path(self.path(f".{name}.{uuid.uuid4().hex}"))
        scheme, data = self._fs.getScheme(), bytearray(json.dumps(value).encode())
        # Each kind of store has its own way to make a whole file appear under a name that is free. A store of objects
        # shows one when it is closed, and refuses a name that is taken if it is asked not to overwrite.
        direct = scheme not in ("file", "hdfs")
        try:
            stream = self._fs.create(final if direct else part, False)
            try:
                stream.write(data)
            finally:
                stream.close()
            if scheme == "file":
                files = self.spark._jvm.java.nio.file
                files.Files.createLink(*(files.Path.of(p.toUri().getPath(), self.spark._sc._gateway.new_array(self.spark._jvm.String, 0)) for p in (final, part)))
            elif not direct and not self._fs.rename(part, final):
                raise FileExistsError(f"{final} was written by somebody else")
        except Py4JJavaError as e:
            if "AlreadyExists" not in e.java_exception.getClass().getName():
                raise
            raise FileExistsError(f"{final} was written by somebody else") from None
        finally:
            if not direct:
                self._fs.delete(part, False)

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(self.path(name)), True)

    def fingerprints(self, paths: list[str]) -> list[tuple[int, int] | None]:
        """Size and time of change of files anywhere, by one listing a folder; None for those that aren't there."""
        found: dict[str, tuple[int, int]] = {}
        for folder in sorted({p.rpartition("/")[0] for p in paths}):
            at = self._path(folder)
            fs = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
            for status in fs.listStatus(at) if fs.exists(at) else ():
                found[_one_slash(status.getPath().toString())] = (status.getLen(), status.getModificationTime())
        named = [self._path(p).getFileSystem(self.spark._jsc.hadoopConfiguration()).makeQualified(self._path(p)).toString() if ":/" not in p else p for p in paths]
        return [found.get(_one_slash(p)) for p in named]


def _one_slash(path: str) -> str:
    """A path in one spelling: stores name the same file with one slash or three after the scheme."""
    return re.sub(r"^([A-Za-z0-9+.\-]+):/+", r"\1:/", path)
