"""A log of numbered commits in a folder: compare-and-set for states and manifests.

Commit n is the file ``n.json``.  It appears whole or not at all, and of those who
want to write the same number one does: the content is written aside and then given its
name, which fails where the name is taken (a hard link on a local file system; a rename
elsewhere, as HDFS has it).  Readers follow the last number, so a writer that dies
leaves nothing behind that anyone would read.
"""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import SparkSession


class CommitLog:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.jvm = spark.sparkContext._jvm
        self.root = self.jvm.org.apache.hadoop.fs.Path(self.folder)
        self.fs = self.root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def numbers(self) -> list[int]:
        """Numbers of the commits, ascending."""
        if not self.fs.exists(self.root):
            return []
        names = [x.getPath().getName() for x in self.fs.listStatus(self.root)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n.removesuffix(".json").isdigit())

    def read(self, number: int) -> dict:
        stream = self.fs.open(self._path(f"{number}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def last(self) -> tuple[int, dict]:
        """Number and content of the last commit; (0, {}) if there is none."""
        numbers = self.numbers()
        return (numbers[-1], self.read(numbers[-1])) if numbers else (0, {})

    def commit(self, number: int, content: dict) -> bool:
        """Writes commit ``number`` unless it is there; whether it was written."""
        aside, target = self._path(f"_{uuid.uuid4().hex}"), self._path(f"{number}.json")
        self.fs.mkdirs(self.root)
        stream = self.fs.create(aside)
        stream.write(json.dumps(content, ensure_ascii=False).encode())
        stream.close()
        try:
            if self.fs.getScheme() == "file":
                os.link(aside.toUri().getPath(), target.toUri().getPath())
                return True
            return bool(self.fs.rename(aside, target))
        except FileExistsError:
            return False
        finally:
            self.fs.delete(aside, False)
