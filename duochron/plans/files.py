"""Small files and folders through Hadoop's file systems, so they work where executors and driver share only a store."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which driver and executors share; a temporary one only in local sessions that name none."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = f"file://{tempfile.mkdtemp(prefix='duochron-')}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


class Files:
    def __init__(self, spark: SparkSession):
        self.spark, self.jvm = spark, spark.sparkContext._jvm
        self.conf = spark._jsparkSession.sessionState().newHadoopConf()

    def _path(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.conf)

    def exists(self, path: str) -> bool:
        p, fs = self._path(path)
        return fs.exists(p)

    def delete(self, path: str) -> None:
        p, fs = self._path(path)
        fs.delete(p, True)

    def names(self, path: str) -> list[str]:
        p, fs = self._path(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def move(self, old: str, new: str) -> None:
        a, fs = self._path(old)
        b, _ = self._path(new)
        if not fs.rename(a, b):
            raise OSError(f"{old} can't be moved to {new}")

    def copy(self, old: str, new: str) -> None:
        a, fs = self._path(old)
        b, other = self._path(new)
        self.jvm.org.apache.hadoop.fs.FileUtil.copy(fs, a, other, b, False, True, self.conf)

    def qualified(self, path: str) -> str:
        p, fs = self._path(path)
        return fs.makeQualified(p).toString().rstrip("/")

    def read(self, path: str) -> str:
        p, fs = self._path(path)
        stream = fs.open(p)
        try:
            return bytes(b & 255 for b in stream.readAllBytes()).decode()
        finally:
            stream.close()

    def create(self, path: str, text: str) -> bool:
        """False if the file is there already: the creation is the lock."""
        p, fs = self._path(path)
        if fs.exists(p):
            return False
        try:
            stream = fs.create(p, False)
        except Exception:  # noqa: BLE001  another writer was first
            return False
        stream.write(bytearray(text.encode()))
        stream.close()
        return True

    def replace(self, path: str, text: str) -> None:
        """Write beside and rename over, so that readers see the old file or the new one."""
        beside = f"{path}.new"
        p, fs = self._path(beside)
        stream = fs.create(p, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri() if p.toUri().getScheme() else fs.getUri(), self.conf)
        options = self.spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = self.jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(p, self.jvm.org.apache.hadoop.fs.Path(path), options)
