"""Numbered commits: small JSON files that come into being whole, once, and never change.

Whoever puts a number first has it; a second writer of the same number is told so and tries the next one, on top of what the
first one did. What is written under a number of its own and only then put is never seen half-way.
"""

from __future__ import annotations

import contextlib
import json
import os
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class CommitLog:
    """The commits below a folder, which may be on any file system that Spark reads.

    A commit is written under a name of its own and moved to its number. On a local folder that is a hard link, elsewhere a
    rename, which file systems made for clusters refuse if the name is taken.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self._spark, self.folder = spark, folder.rstrip("/")

    def _path(self, name: str):
        return self._spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def _system(self):
        return self._path("").getFileSystem(self._spark.sparkContext._jsc.hadoopConfiguration())

    def numbers(self) -> list[int]:
        """The numbers that are taken, in order."""
        try:
            names = [status.getPath().getName() for status in self._system().listStatus(self._path(""))]
        except Py4JJavaError as error:
            if "FileNotFoundException" not in error.java_exception.getClass().getName():
                raise
            return []
        return sorted(int(name[:-5]) for name in names if name.endswith(".json") and name[:-5].isdigit())

    def last(self, below: int | None = None) -> int | None:
        """The largest number taken, below a bound if there is one; None if there is none."""
        taken = [n for n in self.numbers() if below is None or n < below]
        return taken[-1] if taken else None

    def read(self, number: int) -> dict | None:
        """What was put under a number; None if nothing was."""
        system, path = self._system(), self._path(_name(number))
        if not system.exists(path):
            return None
        stream = system.open(path)
        try:
            return json.loads(self._spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def put(self, number: int, content: dict) -> bool:
        """Take a number. False, changing nothing, if it is taken."""
        text = json.dumps(content).encode()
        system, own = self._system(), f"_{uuid.uuid4().hex}"
        if system.getUri().getScheme() == "file":
            return self._put_local(own, _name(number), text)
        stream = system.create(self._path(own), False)
        stream.write(text)
        stream.close()
        taken = system.exists(self._path(_name(number))) or not system.rename(self._path(own), self._path(_name(number)))
        if taken:
            system.delete(self._path(own), False)
        return not taken

    def _put_local(self, own: str, name: str, text: bytes) -> bool:
        folder = self._path("").toUri().getPath()
        os.makedirs(folder, exist_ok=True)
        with open(f"{folder}/{own}", "wb") as file:
            file.write(text)
        try:
            os.link(f"{folder}/{own}", f"{folder}/{name}")
        except FileExistsError:
            return False
        finally:
            os.unlink(f"{folder}/{own}")
        return True


def _name(number: int) -> str:
    return f"{number:010d}.json"


def discard(spark: SparkSession, folder: str) -> None:
    """Remove a folder that no commit names; it does not matter if that fails."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    with contextlib.suppress(Py4JJavaError):
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
