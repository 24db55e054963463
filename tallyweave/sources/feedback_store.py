"""A store of reviewed reports: sessions, reports, findings, ratings and missed labels, appended whole or not at all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("sessions", "reports", "findings", "ratings", "missed")
VERDICTS = ("correct", "incorrect", "uncertain")
#: One row for each reviewed report.
REVIEWS = """review_id string, session_id string, started_at timestamp, reviewer_id string, model_version string, created_at timestamp, record_ref string,
thresholds map<string,double>, review_recommended boolean,
findings array<struct<label:string,description:string,confidence:double,threshold:double,exploratory:boolean,sampling_rate:double,verdict:string,comment:string>>,
missed array<struct<label:string,confidence:double,comment:string>>"""


def _id(*parts: Column) -> Column:
    return F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]))


class FeedbackStore:
    """Five Parquet tables below ``path``, each a folder by batch, and the list of finished batches.

    A batch counts once its name stands in ``commits``, which is written last:
    readers see all of it or nothing, and a batch that broke off can be
    appended again under its name. Ids hang on review and position, so a
    repeated attempt gives the same rows.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _exists(self, name: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def commits(self) -> DataFrame:
        kind = "batch string"
        return self.spark.read.schema(kind).parquet(f"{self.path}/commits") if self._exists("commits") else self.spark.createDataFrame([], kind)

    def append(self, reviews: DataFrame, batch: str) -> bool:
        """Append a batch of ``REVIEWS``; False if a batch of this name is finished already.

        A finding without a known verdict, or without label or confidence,
        refuses the batch before anything is written. The thresholds in force
        are kept with each report, what a finding faced and the rate at which
        it was shown (1 if not given) with the finding.
        """
        if not self.commits().where(F.col("batch") == batch).isEmpty():
            return False
        f = F.explode("findings").alias("f")
        bad = ~F.coalesce(F.col("f.verdict").isin(*VERDICTS), F.lit(False)) | F.col("f.label").isNull() | F.col("f.confidence").isNull()
        if not reviews.select(f).where(bad).isEmpty():
            raise ValueError(f"every finding needs a label, a confidence and a verdict of {', '.join(VERDICTS)}")
        report = _id(F.col("review_id")).alias("report_id")
        seen = reviews.select(report, "reviewer_id", "created_at", F.posexplode("findings").alias("at", "f")).withColumn("finding_id", _id(F.col("report_id"), F.col("at")))
        lost = reviews.select(report, "reviewer_id", "created_at", F.posexplode("missed").alias("at", "m"))
        rows = {
            "sessions": reviews.where("session_id is not null").groupBy("session_id").agg(F.min("started_at").alias("started_at"), F.min("reviewer_id").alias("reviewer_id"), F.min("model_version").alias("model_version")),
            "reports": reviews.select(report, "session_id", "created_at", "record_ref", "thresholds", F.coalesce("review_recommended", F.lit(False)).alias("review_recommended")),
            "findings": seen.select("finding_id", "report_id", "f.label", "f.description", "f.confidence", "f.threshold", F.coalesce("f.exploratory", F.lit(False)).alias("exploratory"), F.coalesce("f.sampling_rate", F.lit(1.0)).alias("sampling_rate")),
            "ratings": seen.select("finding_id", "f.verdict", "reviewer_id", "created_at", "f.comment"),
            "missed": lost.select(_id(F.col("report_id"), F.lit("missed"), F.col("at")).alias("missed_id"), "report_id", "m.label", "m.confidence", "reviewer_id", "created_at", "m.comment"),
        }
        for name in TABLES:
            rows[name].write.mode("overwrite").parquet(f"{self.path}/{name}/batch={batch}")
        self.spark.createDataFrame([(batch,)], "batch string").coalesce(1).write.mode("append").parquet(f"{self.path}/commits")
        return True

    def read(self, name: str) -> DataFrame:
        """The rows of a table's finished batches; a session of several batches stands once for each."""
        return self.spark.read.parquet(f"{self.path}/{name}").join(self.commits(), "batch", "left_semi")

    def rated(self) -> DataFrame:
        """finding_id, label, confidence, threshold, exploratory, sampling_rate, verdict, reviewer_id: what the feedback operators read."""
        both = self.read("findings").join(self.read("ratings").select("finding_id", "verdict", "reviewer_id"), "finding_id")
        return both.select("finding_id", "label", "confidence", "threshold", "exploratory", "sampling_rate", "verdict", "reviewer_id")
