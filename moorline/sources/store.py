"""A folder on the storage that all executors share, reached through Spark's own file systems: texts, locks, inventories."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Store:
    """Files below one root. Names are relative and stay below it."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.jvm = spark, spark.sparkContext._jvm
        given = self.jvm.org.apache.hadoop.fs.Path(str(root))
        self.fs = given.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.root = self.fs.makeQualified(given).toString()

    def path(self, *names: str) -> str:
        for n in names:
            if not n or n.startswith("/") or "\\" in n or ".." in n.split("/"):
                raise ValueError(f"{n!r} is no name below {self.root}")
        return "/".join([self.root.rstrip("/"), *names])

    def _at(self, *names: str):  # noqa: ANN202
        return self.jvm.org.apache.hadoop.fs.Path(self.path(*names))

    def exists(self, *names: str) -> bool:
        return self.fs.exists(self._at(*names))

    def names(self, *below: str) -> list[str]:
        """What a folder holds, sorted; hidden files left out."""
        if not self.exists(*below):
            return []
        found = (s.getPath().getName() for s in self.fs.listStatus(self._at(*below)))
        return sorted(n for n in found if n[0] not in "._")

    def text(self, *names: str) -> str:
        stream = self.fs.open(self._at(*names))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def put(self, value: str, *names: str) -> str:
        """A text, whole or not at all: it is written under another name first and then takes its name."""
        at, aside = self._at(*names), self._at(*names[:-1], f"_{names[-1]}.{uuid.uuid4().hex}")
        stream = self.fs.create(aside, True)
        try:
            stream.write(bytearray(value.encode()))
            stream.hsync()
        finally:
            stream.close()
        self.fs.delete(at, False)
        if not self.fs.rename(aside, at):
            self.fs.delete(aside, False)
            raise OSError(f"{at.toString()} could not be written")
        return at.toString()

    def put_json(self, value: object, *names: str) -> str:
        return self.put(json_text(value), *names)

    def json(self, *names: str) -> object:
        return json.loads(self.text(*names))

    def claim(self, *names: str) -> bool:
        """Create an empty file; False where it is there already. One of any number of claimants wins."""
        self.fs.mkdirs(self._at(*names[:-1]) if names[:-1] else self._at("."))
        return self.fs.createNewFile(self._at(*names))

    def age(self, *names: str) -> float:
        """Seconds since a file was written."""
        import time

        return time.time() - self.fs.getFileStatus(self._at(*names)).getModificationTime() / 1000

    def remove(self, *names: str) -> None:
        self.fs.delete(self._at(*names), True)

    def put_csv(self, df: DataFrame, order: list[str], *names: str) -> str:
        """One CSV file with header. The rows reach one task: for results that a single file is meant to hold."""
        aside = f"_{names[-1]}.{uuid.uuid4().hex}"
        df.repartition(1).sortWithinPartitions(*order).write.options(header=True, quote='"', escape='"').csv(self.path(*names[:-1], aside))
        part = next(s.getPath() for s in self.fs.listStatus(self._at(*names[:-1], aside)) if s.getPath().getName().startswith("part-"))
        at = self._at(*names)
        self.fs.delete(at, False)
        self.fs.rename(part, at)
        self.remove(*names[:-1], aside)
        return at.toString()

    def inventory(self, *below: str) -> DataFrame:
        """path (below the folder), bytes, sha256 of every file, digested by the executors."""
        at = self.path(*below) if below else self.root
        files = self.spark.read.format("binaryFile").option("recursiveFileLookup", True).load(at)
        place = F.expr(f"substring(path, instr(path, '{_tail(at)}') + {len(_tail(at))} + 1)")
        return files.select(place.alias("path"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256")).filter(~F.col("path").rlike(r"(^|/)[._]"))


def _tail(path: str) -> str:
    """The path without scheme and host, as Spark lists it, quoted for SQL."""
    rest = path.split(":", 1)[1] if ":" in path.split("/", 1)[0] else path
    return ("/" + rest.lstrip("/")).replace("'", "\\'")


def json_text(value: object) -> str:
    """Indented JSON with a line end; NaN is refused."""
    return json.dumps(value, indent=2, allow_nan=False) + "\n"
