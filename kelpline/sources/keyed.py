"""A stored table that is changed by merges: only the parts that change are written again, and a merge that is run again changes nothing.

Below its folder lie ``v=<n>``, what the n-th merge wrote, by ``_part``; ``commits/<n>``, which tells by its existence that the merge is whole, and of every part the merge whose folder
holds it; and ``tokens/<digest>``, which merges have been done. A merge names itself by a token: the batch of a stream, the run of a job. Readers take the newest commit; parts that no
commit needs any more are deleted ``KEEP`` commits later. A table has one writer at a time: a second one finds its commit taken and is refused.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from kelpline.sources.shared import checkpointed

PART = "_part"
#: Commits whose parts stay readable after newer ones.
KEEP = 2

Combine = Callable[[DataFrame, DataFrame], DataFrame]


class Folder:
    """A folder of any store that Spark writes to."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self._path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def exists(self, name: str) -> bool:
        return self.fs.exists(self._path(f"{self.path}/{name}"))

    def names(self, name: str) -> list[str]:
        return [s.getPath().getName() for s in self.fs.listStatus(self._path(f"{self.path}/{name}"))] if self.exists(name) else []

    def read(self, name: str) -> str:
        return self.spark.read.text(f"{self.path}/{name}", wholetext=True).first()[0]

    def write(self, name: str, text: str) -> None:
        """A new file; one that exists is an error."""
        out = self.fs.create(self._path(f"{self.path}/{name}"), False)
        out.write(bytearray(text.encode()))
        out.close()

    def delete(self, name: str) -> None:
        self.fs.delete(self._path(f"{self.path}/{name}"), True)


def _digest(token: str) -> str:
    return hashlib.sha256(token.encode()).hexdigest()[:32]


def _commits(folder: Folder) -> list[int]:
    return sorted(int(n) for n in folder.names("commits") if n.isdigit())


def _frame(spark: SparkSession, path: str, commit: dict, parts: list[str] | None = None) -> DataFrame:
    """The rows of a commit, of some parts if they are given."""
    schema = StructType.fromJson(commit["schema"])
    paths = [f"{path}/v={n}/{PART}={p}" for p, n in commit["parts"].items() if parts is None or p in parts]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def load(spark: SparkSession, path: str) -> DataFrame | None:
    """The table as its newest commit left it; None before the first."""
    folder = Folder(spark, path)
    numbers = _commits(folder)
    return _frame(spark, path, json.loads(folder.read(f"commits/{numbers[-1]}"))) if numbers else None


def is_done(spark: SparkSession, path: str, token: str) -> bool:
    """Whether the merge of this token is part of the table. The newest commit tells its token itself: its writer may have broken before it noted it."""
    folder = Folder(spark, path)
    numbers = _commits(folder)
    return bool(numbers) and (folder.exists(f"tokens/{_digest(token)}") or json.loads(folder.read(f"commits/{numbers[-1]}"))["token"] == token)


def merge(rows: DataFrame, path: str, part: Column, combine: Combine, token: str, order: list[str] | None = None) -> bool:
    """Puts ``combine(what the touched parts hold, rows)`` in place of these parts; False if the token says that this was done before.

    part: to which part a row goes, by the columns of its key; the number of parts bounds what the driver gets. order: how the rows of a part are sorted, for its readers' filters.
    """
    spark = rows.sparkSession
    if is_done(spark, path, token):
        return False
    folder = Folder(spark, path)
    numbers = _commits(folder)
    old = json.loads(folder.read(f"commits/{numbers[-1]}")) if numbers else None
    if old and not folder.exists(f"tokens/{_digest(old['token'])}"):
        folder.write(f"tokens/{_digest(old['token'])}", old["token"])
    number = numbers[-1] + 1 if numbers else 0
    label = part.cast("string")
    rows = checkpointed(rows)
    touched = [r[0] for r in rows.select(label).distinct().collect()]
    if None in touched:
        raise ValueError("a row has no part: its key is null")
    held = _frame(spark, path, old, touched) if old else spark.createDataFrame([], rows.schema)
    after = combine(held, rows)
    placed = after.withColumn(PART, label).repartition(PART).sortWithinPartitions(PART, *(order or []))
    placed.write.mode("overwrite").partitionBy(PART).parquet(f"{path}/v={number}")
    written = [n.removeprefix(f"{PART}=") for n in folder.names(f"v={number}") if n.startswith(f"{PART}=")]
    parts = {p: n for p, n in (old["parts"] if old else {}).items() if p not in touched} | dict.fromkeys(written, number)
    folder.write(f"commits/{number}", json.dumps({"token": token, "parts": parts, "schema": after.schema.jsonValue()}))
    folder.write(f"tokens/{_digest(token)}", token)
    _clean(folder, numbers)
    return True


def _clean(folder: Folder, numbers: list[int]) -> None:
    """Deletes the parts of the oldest commits that newer ones replaced, and their commit files."""
    for number in numbers[: -KEEP or None]:
        later = json.loads(folder.read(f"commits/{number + 1}"))["parts"]
        for part, held in json.loads(folder.read(f"commits/{number}"))["parts"].items():
            if later.get(part) != held:
                folder.delete(f"v={held}/{PART}={part}")
        folder.delete(f"commits/{number}")
