"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as the contracts of the line and word operators spell it.
ASCII_SPACE = "\x20\x09\x0a\x0b\x0c\x0d"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder, so that a lost executor recomputes nothing before it.

    The folder is the session's ``spark.checkpoint.dir``; without one this is an error, as any other folder might not be shared.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


class CharClass:
    """A test of characters as a look-up of code points: a table of the first plane, the others asked one by one as they come."""

    def __init__(self, test: Callable[[str], bool]):
        self.test = test
        self.first = np.array([test(chr(i)) for i in range(1 << 16)])

    def __call__(self, codes: np.ndarray) -> np.ndarray:
        mask = self.first[np.minimum(codes, (1 << 16) - 1)]
        high = np.flatnonzero(codes >= 1 << 16)
        if len(high):
            kinds, at = np.unique(codes[high], return_inverse=True)
            mask[high] = np.array([self.test(chr(i)) for i in kinds.tolist()])[at]
        return mask


def n_partitions(df: DataFrame) -> int:
    """Partitions for an explicit exchange: the session's own setting."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def utf8_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def slices(sizes: list[int], limit: int) -> Iterator[tuple[int, int]]:
    """Ranges [a, b) of rows whose sizes add up to at most ``limit``; a larger row stands alone."""
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if i > start and held + n > limit:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield start, len(sizes)


#: Groups that are broadcast at most, as those with more than one row in so many of the table.
MAX_HOT_GROUPS = 100_000


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str) -> DataFrame:
    """``rows`` joined with one row for each group of them, without a task that holds a large group.

    size: the column of ``groups`` with the number of a group's rows. Groups of more than 1,000 rows and of more than 1 / MAX_HOT_GROUPS of all rows
    are MAX_HOT_GROUPS at most, so they are broadcast and their rows stay where they are; all others are joined by a shuffle.
    """
    total = groups.agg(F.sum(size)).first()[0] or 0
    least = max(1000, total // MAX_HOT_GROUPS)
    added = [c for c in groups.columns if c not in keys]
    hot = groups.filter(F.col(size) > least)
    marked = rows.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), keys, "left")
    cold = marked.filter("_hot is null").drop("_hot", *added).join(groups.filter(F.col(size) <= least), keys)
    return marked.filter("_hot").drop("_hot").unionByName(cold)
