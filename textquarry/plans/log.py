"""A log of versions in a folder that any session may open: each version is a small file that is made once."""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import SparkSession


class VersionLog:
    """Versions are numbered from 1; who makes the file of the next number first has committed it.

    A version's file is written under another name and takes its number in one step: by a link on a mounted folder, by a
    rename, which doesn't replace a file, in other file systems that Hadoop knows.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.jvm = spark, spark._jvm
        self.folder = folder.rstrip("/")
        self.fs = self.path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())
        self.fs.mkdirs(self.path(self.folder))
        self.local = self.fs.getUri().getScheme() == "file"

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def place(self, name: str) -> str:
        """The place of a file on a mounted folder."""
        return self.path(f"{self.folder}/{name}").toUri().getPath()

    def latest(self) -> int:
        names = [s.getPath().getName() for s in self.fs.listStatus(self.path(self.folder))]
        return max((int(n) for n in names if n.isdigit()), default=0)

    def read(self, version: int) -> dict:
        stream = self.fs.open(self.path(f"{self.folder}/{version:020d}"))
        try:
            return json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def commit(self, version: int, what: dict) -> bool:
        """Make a version, unless somebody else has made it."""
        draft, name = f"draft-{uuid.uuid4().hex}", f"{version:020d}"
        out = self.fs.create(self.path(f"{self.folder}/{draft}"), False)
        out.write(bytearray(json.dumps(what).encode()))
        out.close()
        try:
            if not self.local:
                return bool(self.fs.rename(self.path(f"{self.folder}/{draft}"), self.path(f"{self.folder}/{name}")))
            os.link(self.place(draft), self.place(name))
            return True
        except FileExistsError:
            return False
        finally:
            self.fs.delete(self.path(f"{self.folder}/{draft}"), False)

    def remove(self, name: str) -> None:
        self.fs.delete(self.path(name), True)

    def names(self, folder: str) -> list[str]:
        return [s.getPath().getName() for s in self.fs.listStatus(self.path(folder))] if self.fs.exists(self.path(folder)) else []
