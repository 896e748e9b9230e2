"""Small files on whatever file system the cluster uses."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


class Folder:
    """Small files under a root that any file system of the cluster may hold."""

    def __init__(self, spark: SparkSession, root: str):
        self.root, self._paths = root.rstrip("/"), spark._jvm.org.apache.hadoop.fs
        self._system = self._paths.Path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, *names: str) -> str:
        return "/".join((self.root, *names))

    def _at(self, *names: str):
        return self._paths.Path(self.path(*names))

    def exists(self, *names: str) -> bool:
        return self._system.exists(self._at(*names))

    def names(self) -> list[str]:
        if not self._system.exists(self._at()):
            return []
        return sorted(f.getPath().getName() for f in self._system.listStatus(self._at()))

    def read(self, *names: str) -> str:
        stream = self._system.open(self._at(*names))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write(self, text: str, *names: str) -> None:
        """Whole or not at all: written under another name, then renamed."""
        temporary, target = self._at(*names[:-1], f".{uuid.uuid4().hex}"), self._at(*names)
        self._system.mkdirs(target.getParent())
        stream = self._system.create(temporary, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        if self._system.exists(target):
            self._system.delete(target, False)
        if not self._system.rename(temporary, target):
            raise OSError(f"can't write {target}")
