"""Files and folders on any file system that Spark reads: listing, whole-file reads, and writes that are there whole or not at all."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import SparkSession


class Folder:
    """A folder by URI. Names that begin with ``_`` are hidden from Spark's readers."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._new = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self._new(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def at(self, name: str = ""):
        return self._new(f"{self.path}/{name}" if name else self.path)

    def has(self, name: str = "") -> bool:
        return self.fs.exists(self.at(name))

    def names(self, name: str = "") -> list[str]:
        """Names in the folder, in order; none where it isn't there."""
        return sorted(f.getPath().getName() for f in self.fs.listStatus(self.at(name))) if self.has(name) else []

    def move(self, source: str, target: str) -> None:
        """Rename within the folder. The target appears whole; it must not be there yet."""
        if self.has(target):
            raise FileExistsError(f"{self.path}/{target}")
        self.fs.mkdirs(self.at(target).getParent())
        if not self.fs.rename(self.at(source), self.at(target)):
            raise OSError(f"{self.path}/{source} can't be renamed to {target}")

    def drop(self, name: str = "") -> None:
        self.fs.delete(self.at(name), True)

    def read(self, name: str) -> bytes:
        stream = self.fs.open(self.at(name))
        try:
            return bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def put(self, name: str, data: bytes, staging: str = "_staging") -> None:
        """Write a file under another name, then rename it; a file of that name is replaced."""
        temp = f"{staging}/{uuid.uuid4().hex}"
        stream = self.fs.create(self.at(temp), True)
        try:
            stream.write(bytearray(data))
        finally:
            stream.close()
        if self.has(name):
            self.fs.delete(self.at(name), False)
        self.move(temp, name)


def cas_put(folder: Folder, data: bytes) -> str:
    """Store bytes under their sha256 and return it; what is there already stays."""
    sha = hashlib.sha256(data).hexdigest()
    if not folder.has(f"{sha[:2]}/{sha}"):
        folder.put(f"{sha[:2]}/{sha}", data)
    return sha


def cas_get(folder: Folder, sha: str) -> bytes:
    """The bytes of a hash; an error where they aren't there or aren't those."""
    name = f"{sha[:2]}/{sha}"
    if not folder.has(name):
        raise FileNotFoundError(f"nothing is stored under {sha}")
    data = folder.read(name)
    if hashlib.sha256(data).hexdigest() != sha:
        raise ValueError(f"the bytes stored under {sha} have another hash")
    return data


def submit(folder: Folder, name: str, doc: dict) -> str:
    """Write a draft's canonical JSON to ``staging`` and rename it to ``pending``, so that who follows that never sees half of it. A pending draft of that name is replaced."""
    from marlstone.functions.scalar import canonical

    folder.put(f"pending/{name}.json", canonical(doc), staging="staging")
    return f"{folder.path}/pending/{name}.json"
