"""Small text records and files, on whatever file system Spark can reach."""

from __future__ import annotations

from pyspark import SparkContext
from pyspark.sql import SparkSession


class FileSystem:
    def __init__(self, spark: SparkSession):
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):
        where = self.jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.conf), where

    def read_text(self, path: str) -> str | None:
        """The whole text, or None where there is no such file."""
        fs, where = self._at(path)
        if not fs.exists(where):
            return None
        stream = fs.open(where)
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8")
        finally:
            stream.close()

    def create_text(self, path: str, text: str) -> bool:
        """Writes a new file as a whole; False where the name is taken."""
        fs, where = self._at(path)
        if fs.exists(where):
            return False
        fs.mkdirs(where.getParent())
        # written beside and renamed: a reader never sees half a record, and of two writers one fails
        beside = self.jvm.org.apache.hadoop.fs.Path(f"{path}.{self.jvm.java.util.UUID.randomUUID().toString()}")
        stream = fs.create(beside, False)
        try:
            stream.write(bytearray(text.encode("utf-8")))
        finally:
            stream.close()
        options = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(where.toUri(), self.conf)
        try:
            options.rename(options.makeQualified(beside), options.makeQualified(where), self._no_options())
        except Exception:
            fs.delete(beside, False)
            if fs.exists(where):
                return False
            raise
        return True

    def _no_options(self):
        return SparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0)

    def delete(self, path: str) -> None:
        fs, where = self._at(path)
        fs.delete(where, True)
