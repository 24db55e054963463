"""What the corpus operators share: word rule, portable hashes, staged tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than ASCII white space; it reads the same in Java, RE2 and Python.
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of words of a text as a long; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hash32(key: Column) -> Column:
    """32 bits of MD5 as a long: the same number in Spark and in DuckDB."""
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long")


def in_fold(doc_id: Column, folds: int = 5) -> Column:
    """True for rows held out of learning: crc32 of the id as text, mod ``folds``, is 0. A null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(True))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


class Staging:
    """Tables written as Parquet below the cluster's shared checkpoint folder.

    A written table cuts lineage and outlives any executor. ``drop`` removes a
    table once nothing that is still to run reads it. Without
    ``spark.checkpoint.dir`` a temporary folder serves a local session only.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            master = spark.sparkContext.master
            if master != "local" and not master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            base = "file://" + tempfile.gettempdir()
        self.root = f"{base.rstrip('/')}/tallyweave-{label}-{uuid.uuid4().hex[:12]}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str, compression: str = "snappy", level: int = 3) -> DataFrame:
        """``level`` is that of zstd."""
        df.write.mode("overwrite").option("compression", compression).option("parquet.compression.codec.zstd.level", level).parquet(self.path(name))
        return self.load(name, df)

    def save_tidy(self, df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
        """``save``, after which Spark removes the shuffle files of the write; what follows reads the table alone."""
        key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
        before = self.spark.conf.get(key, None)
        self.spark.conf.set(key, "true")
        try:
            return self.save(df, name, compression)
        finally:
            if before is None:
                self.spark.conf.unset(key)
            else:
                self.spark.conf.set(key, before)

    def load(self, name: str, like: DataFrame) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def join_counted(rows: DataFrame, sums: DataFrame, key: str, count: str) -> DataFrame:
    """``rows`` joined with ``sums`` (a row for each key, ``count`` its number of rows; best a written table).

    Keys of very many rows are broadcast and their rows stay where they are,
    so no task gathers one key; the bound grows with the sum of ``count``, so
    at most some 5,000 keys lie above it.
    """
    total = sums.agg(F.sum(count)).first()[0] or 0
    bound = max(20_000, int(total) // 5_000)
    if total <= bound:
        return rows.join(sums, key)
    hot = F.broadcast(sums.where(F.col(count) > bound))
    cold = rows.join(hot.select(key), key, "left_anti").join(sums.where(F.col(count) <= bound), key)
    return rows.join(hot, key).unionByName(cold)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
