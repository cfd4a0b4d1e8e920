"""State between runs: versions of a parquet table, the newest of which is complete."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class State:
    """Versions are folders v=1, v=2, ... Spark's committer leaves _SUCCESS in a whole one; readers take the newest such."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def version(self) -> int:
        if not self._fs.exists(self._path(self.path)):
            return 0
        names = [f.getPath().getName() for f in self._fs.listStatus(self._path(self.path))]
        return max([int(n[2:]) for n in names if n.startswith("v=") and self._fs.exists(self._path(f"{self.path}/{n}/_SUCCESS"))], default=0)

    def load(self) -> DataFrame | None:
        n = self.version()
        return self.spark.read.parquet(f"{self.path}/v={n}") if n else None

    def save(self, df: DataFrame, keep: int = 2) -> bool:
        """Write a new version, unless the rows are those of the last one."""
        n, old = self.version(), self.load()
        if old is not None and old.columns == df.columns and _sum(old) == _sum(df):
            return False
        df.write.mode("overwrite").parquet(f"{self.path}/v={n + 1}")
        for gone in range(max(1, n + 2 - keep - 1), n + 2 - keep):
            self._fs.delete(self._path(f"{self.path}/v={gone}"), True)
        return True

    def reset(self) -> None:
        self._fs.delete(self._path(self.path), True)


def _sum(df: DataFrame) -> tuple:
    return tuple(df.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(struct(*)))"), F.expr("sum(xxhash64(struct(*)) % 1000003)")).first())
