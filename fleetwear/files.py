"""File operations in whatever file system a folder lives in."""

from __future__ import annotations

from py4j.java_gateway import JavaObject
from pyspark.sql import SparkSession


class Folder:
    """File operations under a table root, in the file system the root lives in."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self._new = spark._jvm.org.apache.hadoop.fs.Path
        self._jvm = spark._jvm
        self.root = self._new(root)
        self.fs: JavaObject = self.root.getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, name: str) -> JavaObject:
        return self._new(self.root, name) if name else self.root

    def names(self, name: str) -> list[str]:
        """Entries of a folder; none where it is absent."""
        path = self.path(name)
        if not self.fs.exists(path):
            return []
        return sorted(s.getPath().getName() for s in self.fs.listStatus(path))

    def sizes(self, name: str) -> list[int]:
        """Bytes of the data files of a folder."""
        path = self.path(name)
        found = self.fs.listStatus(path) if self.fs.exists(path) else []
        return [s.getLen() for s in found if not s.getPath().getName().startswith(("_", "."))]

    def exists(self, name: str) -> bool:
        return self.fs.exists(self.path(name))

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)

    def move(self, name: str, to: str) -> None:
        target = self.path(to)
        self.fs.mkdirs(target.getParent())
        self.fs.delete(target, False)  # what a broken copy may have left
        if not self.fs.rename(self.path(name), target):
            raise OSError(f"could not move {name} to {to}")

    def write(self, name: str, text: str) -> None:
        """All of the text or nothing under this name."""
        part = self.path(name + ".part")
        stream = self.fs.create(part, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        if not self.fs.rename(part, self.path(name)):
            raise OSError(f"could not write {name}")

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()
