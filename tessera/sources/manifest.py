"""A log of published versions: data is staged beside it, and one atomic rename makes it count.

The folder ``log`` holds one small file for each version, named by its number. A version's entry is written under a passing name first and then renamed to the next
number; a rename onto a name that exists fails, so of two writers one gets the number and the other one learns that it has lost. Whatever died before
its rename left files that no entry names; ``recover`` finds and deletes them.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class Conflict(RuntimeError):
    """Another writer has published since the version that this one began from."""


class Manifest:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        where = self._file(self.path)
        self._fs = where.getFileSystem(self._conf)
        self._context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf)

    def _file(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def names(self, folder: str) -> list[str]:
        where = self._file(f"{self.path}/{folder}")
        return sorted(f.getPath().getName() for f in self._fs.listStatus(where)) if self._fs.exists(where) else []

    def versions(self) -> list[int]:
        return [int(n) for n in self.names("log") if n.isdigit()]

    def last(self) -> int:
        """The number of the last version; 0 before the first."""
        return max(self.versions(), default=0)

    def _read(self, name: str) -> dict:
        stream = self._fs.open(self._file(f"{self.path}/log/{name}"))
        try:
            return json.loads(str(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
        finally:
            stream.close()

    def entry(self, version: int | None = None) -> dict:
        number = self.last() if version is None else version
        if number not in self.versions():
            raise LookupError(f"no version {number} in {self.path}")
        return self._read(f"{number:012d}")

    def entries(self, upto: int | None = None) -> list[tuple[int, dict]]:
        return [(v, self._read(f"{v:012d}")) for v in self.versions() if upto is None or v <= upto]

    def publish(self, entry: dict, after: int | None = None) -> int:
        """Makes ``entry`` the version after ``after`` (the last one if none is named) and gives its number. Raises ``Conflict`` if that exists."""
        number = (self.last() if after is None else after) + 1
        staged, final = (self._file(f"{self.path}/log/{name}") for name in (f"_{uuid.uuid4().hex}", f"{number:012d}"))
        out = self._fs.create(staged, False)
        out.write(json.dumps(entry).encode())
        out.close()
        rename = self._jvm.org.apache.hadoop.fs.Options.Rename
        how = self.spark.sparkContext._gateway.new_array(rename, 1)
        how[0] = rename.NONE
        try:
            self._context.rename(staged, final, how)
        except Exception as e:
            self._fs.delete(staged, False)
            if self._fs.exists(final):
                raise Conflict(f"version {number} of {self.path} is another writer's") from e
            raise
        return number

    def recover(self, used: set[str], folder: str = "data") -> list[str]:
        """Deletes what stands in ``folder`` that isn't ``used``, and entries that were never renamed; gives their names. For a time when nobody writes."""
        gone = [f"{folder}/{n}" for n in self.names(folder) if n not in used] + [f"log/{n}" for n in self.names("log") if not n.isdigit() and n.startswith("_")]
        for name in gone:
            self._fs.delete(self._file(f"{self.path}/{name}"), True)
        return gone

    def delete(self, name: str) -> None:
        self._fs.delete(self._file(f"{self.path}/{name}"), True)
