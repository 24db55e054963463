"""Readers and writers of record, signal and document files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The columns of a record table.
RECORDS = "record_id long, patient_id long, age double, sex int, device string, site string, rec_ts timestamp, fold int, codes string"


def parse_codes(df: DataFrame, column: str) -> DataFrame:
    """A map of code to likelihood from text such as {'A': 100.0, 'B': 0.0}; broken text gives null."""
    return df.withColumn(column, F.from_json(column, "map<string,double>"))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """The record table from CSV with a header; columns are matched by their order, bad values become null."""
    return parse_codes(spark.read.schema(RECORDS).option("header", True).option("escape", '"').csv(path), "codes")


def write_manifests(df: DataFrame, path: str) -> None:
    """One folder for each value of ``split``, the whole table as their union."""
    df.write.mode("overwrite").partitionBy("split").parquet(path)


def write_lines(df: DataFrame, path: str) -> None:
    """One JSON object a line; null fields are left out."""
    df.write.mode("overwrite").json(path)


def read_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines under a stated schema."""
    return spark.read.schema(schema).json(path)


def read_signals(spark: SparkSession, path: str, leads: int = 12) -> tuple[DataFrame, DataFrame]:
    """(path, fs, signal) of the signal files below ``path``, and the rejected (path, reason).

    JSON is an object with ``signal`` (rows of numbers) and ``fs`` or
    ``sampling_rate``, which must be positive, or the rows alone. Files that
    end in csv or txt hold a row of numbers a line, parted by commas if the
    first line has one, else by space; text after # is left out. Rows alone
    and delimited files have a null rate. The axis of length ``leads`` is the
    lead axis; a signal that stands the other way is turned. Other endings,
    values that are no numbers, rows of unequal length and signals without a
    lead axis are rejected; one bad file stops no other.
    """
    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
    raw = raw.withColumn("ending", F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)))
    whole = F.from_json("value", "fs double, sampling_rate double, signal array<array<double>>")
    alone = F.from_json("value", "array<array<double>>")
    lines = F.filter(F.transform(F.split(F.col("value"), r"\r?\n"), lambda x: F.trim(F.regexp_replace(x, "#.*", ""))), lambda x: x != "")
    by = F.when(F.get(lines, F.lit(0)).contains(","), F.lit(r"\s*,\s*")).otherwise(F.lit(r"\s+"))
    table = F.transform(lines, lambda x: F.transform(F.split(x, by), lambda v: v.try_cast("double")))
    text = F.col("ending").isin("csv", "txt")
    s = raw.select("path", "ending", whole.alias("x"), alone.alias("y"), F.when(text, table).alias("z"))
    s = s.select("path", "ending", F.coalesce("x.fs", "x.sampling_rate").alias("fs"), F.col("x.signal").isNotNull().alias("object"), F.coalesce("x.signal", "y", "z").alias("signal"))
    lengths = F.array_distinct(F.transform("signal", F.size))
    even = F.coalesce(F.size(lengths) == 1, F.lit(False))
    first = F.when(even, F.get(lengths, F.lit(0)))
    turned = F.transform(F.sequence(F.lit(0), first - 1), lambda i: F.transform("signal", lambda row: F.get(row, i)))
    broken = F.exists("signal", lambda row: row.isNull() | F.exists(row, lambda v: v.isNull()))
    reason = (
        F.when(~F.col("ending").isin("json", "csv", "txt"), "unknown ending").when(F.col("signal").isNull() | (F.size("signal") == 0), "no signal").when(broken, "no number").when(~even, "ragged")
        .when((F.size("signal") != leads) & (first != leads), "no lead axis").when(F.col("object") & ~(F.coalesce("fs", F.lit(0.0)) > 0), "no rate")
    )
    good = s.where(reason.isNull()).select("path", "fs", F.when(F.size("signal") == leads, F.col("signal")).otherwise(turned).alias("signal"))
    return good, s.where(reason.isNotNull()).select("path", reason.alias("reason"))


def cached_split(spark: SparkSession, df: DataFrame, split: str, path: str) -> DataFrame:
    """The rows of one split, written on the first call and read back on later ones."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/split={split}/_SUCCESS")
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        df.where(F.col("split") == split).write.mode("overwrite").parquet(f"{path}/split={split}")
    return spark.read.schema(df.schema).parquet(f"{path}/split={split}")


def write_review(review: DataFrame, path: str) -> str:
    """Append a review (finding_id, verdict, ...) whole or not at all.

    A verdict that is not correct, incorrect or uncertain refuses the batch
    before anything is written.
    """
    bad = review.where(~F.coalesce(F.col("verdict").isin("correct", "incorrect", "uncertain"), F.lit(False)))
    if not bad.isEmpty():
        raise ValueError("a verdict must be correct, incorrect or uncertain")
    review.write.mode("append").parquet(path)
    return path


def chunk_stream(spark: SparkSession, path: str, schema: str, files: int = 1) -> DataFrame:
    """A folder of Parquet chunks as a stream, at most ``files`` new ones in a batch; the schema is given, not inferred.

    Files are taken by age, so chunks written in order arrive in order; within
    a source the rows carry their own clock.
    """
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)
