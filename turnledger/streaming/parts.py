"""Rows that batches add one after the other, kept so that a reader opens few folders.

Batch n writes a folder of its own at level 0. Then folders are merged like the
digits of a binary counter: after 2^k more batches the folders of level k - 1 become
one of level k. After n batches the rows stand in one folder per set bit of n, and
a row is written again about log2(n) times in all. Older folders stay where they are;
a reader that began earlier is not disturbed.

With ``by``, rows lie in hash buckets of that column. A level that holds twice as
many batches has twice as many buckets, so a bucket does not grow with the history,
and a reader that names its keys opens their buckets only.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Buckets of level 0 and the most of any level.
BUCKETS, MOST_BUCKETS = 8, 4096


class Parts:
    """``schema`` as DDL text; without one it is that of the rows written, and there must be some to read."""

    def __init__(self, spark: SparkSession, path: str, schema: str | None = None, by: str | None = None, fold: Callable[[DataFrame], DataFrame] | None = None):
        self.spark, self.path, self.schema, self.by, self.fold = spark, path.rstrip("/"), schema, by, fold

    # -- where the rows are ------------------------------------------------------

    def _folder(self, level: int, batch: int) -> str:
        return f"{self.path}/level={level}/batch={batch}"

    @staticmethod
    def places(count: int) -> list[tuple[int, int]]:
        """(level, last batch) of the folders that hold the first ``count`` batches, oldest first."""
        found, upto = [], 0
        for level in reversed(range(count.bit_length())):
            if count >> level & 1:
                upto += 1 << level
                found.append((level, upto - 1))
        return found

    def _is_there(self, folder: str) -> bool:
        try:
            self.spark.read.schema("n bigint").parquet(folder)
        except AnalysisException:
            return False
        return True

    def _done(self, batch: int) -> str:
        return f"{self.path}/done/batch={batch}"

    def count(self) -> int:
        """Batches that were added completely; looked up in logarithmically many steps."""
        if not self._is_there(self._done(0)):
            return 0
        step = 1
        while self._is_there(self._done(step)):
            step *= 2
        low, high = step // 2, step  # low is there, high is not
        while high - low > 1:
            middle = (low + high) // 2
            low, high = (middle, high) if self._is_there(self._done(middle)) else (low, middle)
        return low + 1

    def _buckets(self, level: int) -> int:
        return min(BUCKETS << level, MOST_BUCKETS)

    def _bucket(self, level: int) -> Column:
        return F.pmod(F.xxhash64(self.by), F.lit(self._buckets(level))).cast("int")

    # -- writing -----------------------------------------------------------------

    def _write(self, rows: DataFrame, level: int, batch: int) -> None:
        if self.by is None:
            rows.write.mode("overwrite").parquet(self._folder(level, batch))
        else:
            placed = rows.withColumn("bucket", self._bucket(level)).hint("rebalance", "bucket").sortWithinPartitions("bucket", self.by)
            placed.write.mode("overwrite").option(f"parquet.bloom.filter.enabled#{self.by}", "true").partitionBy("bucket").parquet(self._folder(level, batch))

    def prepare(self, rows: DataFrame, batch: int) -> None:
        """Write the rows of a batch; readers do not see them before ``finish``."""
        self._write(rows if self.schema is None else rows.select(*self.spark.createDataFrame([], self.schema).columns), 0, batch)

    def finish(self, batch: int) -> None:
        """Merge the folders that are due and show the batch to readers; may be run again."""
        level = 1
        while (batch + 1) % (1 << level) == 0:
            both = self._load(level - 1, batch - (1 << (level - 1))).unionByName(self._load(level - 1, batch))
            self._write(self.fold(both) if self.fold else both, level, batch)
            level += 1
        self.spark.createDataFrame([(batch,)], "n bigint").write.mode("overwrite").parquet(self._done(batch))

    def add(self, rows: DataFrame, batch: int) -> None:
        self.prepare(rows, batch)
        self.finish(batch)

    # -- reading -----------------------------------------------------------------

    def _load(self, level: int, batch: int, buckets: list[int] | None = None) -> DataFrame:
        reader = self.spark.read
        if self.schema is not None:
            reader = reader.schema(self.schema if self.by is None else f"{self.schema}, bucket int")
        rows = reader.parquet(self._folder(level, batch))
        if buckets is not None:
            rows = rows.filter(F.col("bucket").isin(buckets))
        return rows.drop("bucket")

    def prepared(self, batch: int) -> DataFrame | None:
        """Rows of a batch that was begun, or None."""
        return self._load(0, batch) if self._is_there(self._folder(0, batch)) else None

    def read(self, before: int | None = None, near: DataFrame | None = None) -> DataFrame:
        """Rows of all batches, or of those before one; with ``near``, only from the buckets its values of ``by`` fall in."""
        places = self.places(self.count() if before is None else before)
        loaded = []
        most = max((level for level, _ in places), default=0)
        touched = None
        if near is not None and places:  # buckets of the largest level, a bounded list, name those of the others
            touched = [r[0] for r in near.select(self._bucket(most).alias("b")).distinct().toLocalIterator()]
        for level, batch in places:
            own = None if touched is None else sorted({b % self._buckets(level) for b in touched})
            loaded.append(self._load(level, batch, own))
        if not loaded:
            return self.spark.createDataFrame([], self.schema)
        rows = reduce(DataFrame.unionByName, loaded)
        return self.fold(rows) if self.fold else rows
