"""Small files on any Hadoop file system; a file has its name only when it is whole, and only one writer gets a name."""

from __future__ import annotations

import uuid

from pyspark import SparkContext
from pyspark.sql import SparkSession


class NameTaken(Exception):
    """Another writer has published this file."""


class Files:
    """A folder on the file system that its address names."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self.root = root.rstrip("/")
        self.system = self._path("").getFileSystem(self.conf)
        self.context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.system.getUri(), self.conf)
        self.no_options = SparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0)

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def address(self, name: str) -> str:
        return f"{self.root}/{name}"

    def names(self, folder: str) -> list[str]:
        path = self._path(folder)
        return sorted(s.getPath().getName() for s in self.system.listStatus(path)) if self.system.exists(path) else []

    def below(self, folder: str) -> list[str]:
        """All files in a folder and its folders, by their names from there."""
        path, out = self._path(folder), []
        if self.system.exists(path):
            start, found = len(self.system.makeQualified(path).toString()) + 1, self.system.listFiles(path, True)
            while found.hasNext():
                out.append(found.next().getPath().toString()[start:])
        return sorted(out)

    def read(self, name: str) -> bytes:
        return self._read(self._path(name))

    def read_path(self, address: str) -> bytes:
        """The bytes of a file by its whole address."""
        return self._read(self.jvm.org.apache.hadoop.fs.Path(address))

    def _read(self, path) -> bytes:
        stream = self.system.open(path)
        try:
            return bytes(stream.readAllBytes())
        finally:
            stream.close()

    def publish(self, name: str, data: bytes) -> None:
        """Write a file under a temporary name, then give it `name`; NameTaken if that exists."""
        folder, _, last = name.rpartition("/")
        hidden = self._path(f"{folder}/.{last}.{uuid.uuid4().hex}".lstrip("/"))
        stream = self.system.create(hidden, False)
        try:
            stream.write(bytearray(data))
            stream.hsync()
        finally:
            stream.close()
        try:
            self.context.rename(hidden, self._path(name), self.no_options)
        except Exception as e:
            self.system.delete(hidden, False)
            if "FileAlreadyExists" in str(e):
                raise NameTaken(name) from e
            raise

    def delete(self, name: str) -> None:
        self.system.delete(self._path(name), True)

    def size(self, name: str) -> int:
        return self.system.getContentSummary(self._path(name)).getLength()
