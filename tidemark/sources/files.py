"""Files by Hadoop's FileSystem, so that a workspace can be in any store that Spark reaches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import SparkSession


def scratch(spark: SparkSession, name: str, key: str | None = None) -> str:
    """A folder under ``spark.checkpoint.dir``: new, or one for each ``key``.

    Without that setting a temporary folder, if all executors are in this process; on a
    cluster its files would be seen by nobody else.
    """
    sc = spark.sparkContext
    top = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not top:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        top = f"file://{tempfile.gettempdir()}"
    return f"{top.rstrip('/')}/tidemark-{name}-{key or uuid.uuid4().hex}"


class Files:
    def __init__(self, spark: SparkSession):
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.conf), p

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def read(self, path: str, offset: int = 0, length: int | None = None) -> bytes:
        fs, p = self._at(path)
        length = fs.getFileStatus(p).getLen() - offset if length is None else length
        stream = fs.open(p)
        try:
            stream.seek(offset)
            return bytes(stream.readNBytes(length))
        finally:
            stream.close()

    def write(self, path: str, data: bytes, sync: bool = False) -> None:
        """Write beside, then rename over: a reader sees the old file or the new one."""
        fs, p = self._at(path)
        tmp = self.jvm.org.apache.hadoop.fs.Path(path + ".tmp")
        stream = fs.create(tmp, True)
        try:
            stream.write(bytearray(data))
            if sync:
                stream.hsync()
        finally:
            stream.close()
        self._rename(fs, tmp, p)

    def _rename(self, fs, tmp, p) -> None:
        options = self.jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename")
        overwrite = self.jvm.java.lang.reflect.Array.newInstance(options, 1)
        overwrite[0] = self.jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), self.conf).rename(fs.makeQualified(tmp), fs.makeQualified(p), overwrite)

    def size(self, path: str) -> int:
        """Bytes of a file, or of all files of a folder."""
        fs, p = self._at(path)
        return fs.getContentSummary(p).getLength()

    def _copy(self, source: str, offset: int, length: int, out) -> str:
        """Copies a range into an open stream of the JVM and returns its SHA-256; nothing of it reaches Python."""
        java = self.jvm.java.security
        fs, p = self._at(source)
        stream = fs.open(p)
        try:
            stream.seek(offset)
            digest = java.MessageDigest.getInstance("SHA-256")
            bounded = self.jvm.org.apache.commons.io.input.BoundedInputStream(stream, length)
            self.jvm.org.apache.hadoop.io.IOUtils.copyBytes(java.DigestInputStream(bounded, digest), out, 1 << 20, False)
            return bytes(digest.digest()).hex()
        finally:
            stream.close()

    def extract(self, source: str, offset: int, length: int, to: str) -> str:
        """A range of a file as a file of its own; returns its SHA-256."""
        fs, p = self._at(to)
        out = fs.create(p, True)
        try:
            return self._copy(source, offset, length, out)
        finally:
            out.close()

    def concatenate(self, path: str, head: bytes, sources: Iterable[tuple[str, int]], tail, sync: bool = False) -> None:
        """Head, the files (path, length) one after the other, and ``tail(their digests)``: written beside, then renamed."""
        fs, p = self._at(path)
        tmp = self.jvm.org.apache.hadoop.fs.Path(path + ".tmp")
        out = fs.create(tmp, True)
        try:
            out.write(bytearray(head))
            out.write(bytearray(tail([self._copy(source, 0, length, out) for source, length in sources])))
            if sync:
                out.hsync()
        finally:
            out.close()
        self._rename(fs, tmp, p)

    def remove(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)

    def parts(self, path: str) -> list[str]:
        """The Parquet files of a folder that Spark wrote, in name order."""
        fs, p = self._at(path)
        return sorted(s.getPath().toString() for s in fs.listStatus(p) if s.getPath().getName().endswith(".parquet"))
