"""A ledger of model calls: each distinct prompt is asked once, and all later steps read the reply."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared

_ROWS = "key string, reply string"


class Ledger:
    """Replies of models under ``root``, a folder for each model, by the hash of what it was asked.

    ``ask`` writes the replies of prompts that are not there yet before it goes on, so a plan that is
    computed again reads them. Null replies are kept out and asked for again the next time. Two jobs that
    ask at once may both ask; the smaller reply counts for both.
    """

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark, self.root = spark, (root or f"{shared(spark)}/ledger-{uuid.uuid4().hex}").rstrip("/")

    def read(self, name: str) -> DataFrame:
        """(key, reply) of a model, one row a key."""
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        at = hadoop.Path(f"{self.root}/{name}")
        if not at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            return self.spark.createDataFrame([], _ROWS)
        return self.spark.read.schema(_ROWS).parquet(at.toString()).where("reply is not null").groupBy("key").agg(F.min("reply").alias("reply"))

    def ask(self, rows: DataFrame, name: str, model, *inputs: str) -> DataFrame:
        """``rows`` with ``reply``: what ``model``, a function of columns, says to the columns ``inputs``."""
        keyed = rows.drop("reply").withColumn("__key", _key(inputs))
        new = keyed.select("__key", *inputs).dropDuplicates(["__key"]).join(self.read(name).select(F.col("key").alias("__key")), "__key", "left_anti")
        made = new.select(F.col("__key").alias("key"), model(*[F.col(c) for c in inputs]).cast("string").alias("reply"))
        made.write.mode("append").parquet(f"{self.root}/{name}")
        return keyed.join(self.read(name).withColumnRenamed("key", "__key"), "__key", "left").drop("__key")


def _key(inputs: tuple[str, ...]) -> Column:
    return F.sha2(F.to_json(F.struct(*[F.col(c).cast("string").alias(f"p{i}") for i, c in enumerate(inputs)]), {"ignoreNullFields": "false"}), 256)
