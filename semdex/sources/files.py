"""Small files and folders wherever Spark can read: local disks, HDFS, object stores."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Folder:
    """A folder by path or URI, reached through Hadoop's file systems."""

    def __init__(self, spark: SparkSession, at: str):
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self._gateway = spark.sparkContext._gateway
        self._fs_package = self._jvm.org.apache.hadoop.fs
        path = self._fs_package.Path(at)
        self._fs = path.getFileSystem(self._conf)
        self._at = self._fs.makeQualified(path)
        self.uri = self._at.toString()

    def _path(self, name: str):
        return self._fs_package.Path(self._at, name)

    def read(self, name: str) -> str | None:
        """A small text file's content; None if there is no such file."""
        if not self._fs.exists(self._path(name)):
            return None
        stream = self._fs.open(self._path(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        """Put a small text file in the place of what is there, at once: readers see the old or the new."""
        new = self._path(f".{name}.new")
        stream = self._fs.create(new, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        context = self._fs_package.FileContext.getFileContext(self._at.toUri(), self._conf)
        kind = self._fs_package.Options.Rename
        options = self._gateway.new_array(kind, 1)
        options[0] = kind.OVERWRITE
        context.rename(new, self._path(name), options)

    def names(self) -> list[str]:
        return [s.getPath().getName() for s in self._fs.listStatus(self._at)] if self._fs.exists(self._at) else []

    def remove(self, name: str) -> None:
        self._fs.delete(self._path(name), True)

    def size(self) -> int:
        """Bytes of all files."""
        return self._fs.getContentSummary(self._at).getLength() if self._fs.exists(self._at) else 0
