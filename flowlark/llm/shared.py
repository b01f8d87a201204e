"""Input tables and files of the shared folder; tables that cut lineage are in ``flowlark.storage``."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

from ..storage import discard, materialize, new_path, shared_dir, unused

__all__ = ["Files", "discard", "materialize", "new_path", "shared_dir", "table", "unused"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Files:
    """Small files and listings in whatever store holds ``path``, by the driver."""

    def __init__(self, spark: SparkSession, path: str):
        self._jvm = jvm = spark.sparkContext._jvm
        self._gateway = spark.sparkContext._gateway
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._path = jvm.org.apache.hadoop.fs.Path
        self._utils = jvm.org.apache.commons.io.IOUtils
        self._fs = self._path(path).getFileSystem(self._conf)

    def sizes(self, folder: str) -> dict[str, int]:
        """Paths of the data files in a folder and their bytes."""
        found = self._fs.listStatus(self._path(folder))
        return {
            x.getPath().toString(): x.getLen()
            for x in found
            if x.isFile() and not x.getPath().getName().startswith(("_", "."))
        }

    def exists(self, path: str) -> bool:
        return self._fs.exists(self._path(path))

    def read(self, path: str) -> str:
        stream = self._fs.open(self._path(path))
        try:
            return self._utils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def commit(self, path: str, text: str) -> bool:
        """Create ``path`` with ``text`` whole or not at all; False if it is there already.

        A draft is written and then named, by an operation of the store that
        fails where the name is taken: a hard link on a local or mounted file
        system, elsewhere a rename that doesn't overwrite, which HDFS does in
        one step.  A store without either must not hold manifests.
        """
        draft = f"{path}.{uuid.uuid4().hex}.draft"
        stream = self._fs.create(self._path(draft), False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        try:
            self._name(draft, path)
            return True
        except Py4JJavaError as e:
            if not _taken(e.java_exception):
                raise
            return False
        finally:
            self._fs.delete(self._path(draft), False)

    def _name(self, draft: str, path: str) -> None:
        source, folder, name = self._fs.resolvePath(self._path(draft)), *path.rsplit("/", 1)
        target = self._path(self._fs.resolvePath(self._path(folder)), name)
        if source.toUri().getScheme() == "file":
            nio, uri = self._jvm.java.nio.file, self._jvm.java.net.URI
            local = lambda p: nio.Paths.get(uri("file://" + p.toUri().getRawPath()))
            nio.Files.createLink(local(target), local(source))
        else:
            self._rename(source, target)

    def _rename(self, source: object, target: object) -> None:
        rename = self._jvm.org.apache.hadoop.fs.Options.Rename
        kept = self._gateway.new_array(rename, 1)
        kept[0] = rename.NONE
        self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self._conf).rename(source, target, kept)

    def remove(self, path: str) -> None:
        self._fs.delete(self._path(path), True)


def _taken(error: object) -> bool:
    """Whether a store's error says that a name is there already."""
    return error.getClass().getSimpleName() in ("FileAlreadyExistsException",)
