"""JSON decisions in, JSON lines and JSON arrays out."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import blank_to_null
from ..schemas import DECISION_FIELDS
from ..session import shared
from .json_arrays import elements
from .seed import SEED

def read_decisions(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Files that hold one JSON array of decisions; missing keys are null, missing lists empty; anything
    else in a file raises. ``pos`` is the order of files and of their elements. Tasks read large files in parts."""
    rows = elements(spark, paths).select("file", "n", F.from_json("item", DECISION_FIELDS).alias("d")).select("file", "n", "d.*")
    for c in ("related_regulations", "topics_and_keywords"):
        rows = rows.withColumn(c, F.coalesce(c, F.array().cast("array<string>")))
    return rows.withColumn("pos", F.struct("file", "n")).drop("file", "n")


def seed_corpus(spark: SparkSession, seed=SEED) -> DataFrame:
    rows = spark.createDataFrame(list(seed), "id string, text string")
    nothing = F.lit("")
    return rows.select("id", "text", F.col("id").alias("case_reference"), nothing.alias("ecli"), nothing.alias("decision_date"), nothing.alias("judge"), nothing.alias("text_url"), F.lit(0).alias("chunk_index"), F.lit(None).cast("long").alias("document_id"))


def or_seed(chunks: DataFrame, seed=SEED) -> DataFrame:
    """The chunks, or the seed corpus if there are none."""
    return chunks if not chunks.isEmpty() else seed_corpus(chunks.sparkSession, seed)


def chunk_records(chunks: DataFrame, source: str = "corpus") -> DataFrame:
    """One JSON text for each chunk; nulls are kept."""
    metadata = F.struct("case_reference", "ecli", "decision_date", "judge", "text_url", "chunk_index", F.lit(source).alias("source"))
    return chunks.select(F.to_json(F.struct("id", "text", metadata.alias("metadata")), {"ignoreNullFields": "false"}).alias("value"))


def write_jsonl(chunks: DataFrame, path: str, source: str = "corpus") -> None:
    chunk_records(chunks, source).write.mode("overwrite").text(path)


def write_json(rows: DataFrame, path: str) -> None:
    """Lines of JSON, one folder; for tables of any size."""
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


@F.pandas_udf(T.StringType())
def _indented(rows: pd.Series) -> pd.Series:
    return rows.map(lambda row: "\n  " + json.dumps(json.loads(row), ensure_ascii=False, indent=2).replace("\n", "\n  "))


def write_json_array(rows: DataFrame, path: str) -> int:
    """One local file with a JSON array, indented by 2, other characters than ASCII as they are and nulls kept. Tasks write
    the elements to the shared folder; the driver copies these files one behind the other and gets no rows.
    Returns the number of elements."""
    spark = rows.sparkSession
    parts, seen = f"{shared(spark)}/array-{uuid.uuid4().hex}", Observation()
    items = rows.select(_indented(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).alias("value"))
    items.observe(seen, F.count(F.lit(1)).alias("n")).write.option("lineSep", ",").text(parts)
    n = int(seen.get["n"] or 0)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    folder = jvm.org.apache.hadoop.fs.Path(parts)
    held = folder.getFileSystem(conf)
    found = sorted((f.getPath().getName(), f.getLen()) for f in held.listStatus(folder) if f.getPath().getName().startswith("part-"))
    with open(path, "wb") as made:
        made.write(b"[")
    out = jvm.java.io.FileOutputStream(os.path.abspath(path), True)
    try:
        for name in (name for name, size in found if size):
            part = held.open(jvm.org.apache.hadoop.fs.Path(f"{parts}/{name}"))
            try:
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, out, 1 << 16, False)  # by a buffer of this size
            finally:
                part.close()
    finally:
        out.close()
    with open(path, "r+b") as made:
        made.seek(-1 if n else 0, os.SEEK_END)  # over the last comma
        made.write(b"\n]" if n else b"]")
    held.delete(folder, True)
    return n


def output_name(slug: str = "results", most: int | None = None, pages: tuple[int, int] | None = None, bulk: bool = False) -> str:
    if pages:
        return f"results_{slug}_pages_{pages[0]}_{pages[1]}.json"
    if bulk:
        return f"results_{slug}_bulk.json"
    return "results.json" if most is None else f"results_{slug}_{most}.json"


def resolved(path: str, root: str = ".") -> str:
    """A relative path under ``root``; absolute paths and URIs as they are."""
    return path if os.path.isabs(path) or "://" in path else os.path.join(root, path)


def batches_folder(default: str = "batches", root: str = ".") -> str:
    """The folder of batch files: TESSERA_BATCHES_DIR, else that of TESSERA_RESULTS_PATH, else the default."""
    results = os.environ.get("TESSERA_RESULTS_PATH")
    return resolved(os.environ.get("TESSERA_BATCHES_DIR") or (os.path.dirname(results) if results else default), root)


def decision_identity() -> Column:
    """A crawled decision's ecli, else its reference; one without either raises."""
    return F.coalesce(F.nullif("ecli", F.lit("")), F.nullif("case_reference", F.lit("")), F.raise_error(F.lit("a decision lacks both ecli and reference")))


def collect_results(
    pages: DataFrame, texts: DataFrame | Callable[[DataFrame], DataFrame] | None = None, page_start: int = 0, page_end: int | None = None,
    max_results: int | None = None, skip_duplicates: bool = False,
) -> DataFrame:
    """Decisions of parsed result pages, in page order: cut to the limit before texts are joined.

    ``texts`` has (text_url, full_text), or is a function that fetches them for the decisions that stay. An
    empty page raises, as does a decision without ecli and reference. One that occurs twice, by ecli or else
    reference, on the pages that the limit needs raises, or is passed over with ``skip_duplicates``; so do
    decisions without a reference, a text url or (if texts are asked for) a full text.
    """
    from ..operators.corpus import enrich, numbered, require_unique

    if page_start < 0 or (page_end is not None and page_end < page_start):
        raise ValueError("pages must be a range of non-negative numbers")
    if max_results is not None and max_results <= 0:
        raise ValueError("the limit must be positive")
    rows = pages.where(F.col("page_index") >= page_start)
    if page_end is not None:
        rows = rows.where(F.col("page_index") <= page_end)
    empty = F.raise_error(F.concat(F.lit("empty page "), F.col("page_index") + 1)).cast(pages.schema["results"].dataType)
    rows = rows.withColumn("results", F.when(F.coalesce(F.size("results"), F.lit(0)) > 0, F.col("results")).otherwise(empty))
    if max_results is not None and not skip_duplicates:
        # Of the pages, a row each, those on which results before the limit begin.
        ahead = Window.partitionBy(F.lit(0)).orderBy("page_index").rangeBetween(Window.unboundedPreceding, -1)
        sizes = rows.select("page_index", F.size("results").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(ahead), F.lit(0)))
        last = sizes.where(F.col("before") < max_results).agg(F.max("page_index").alias("__last"))
        rows = rows.join(F.broadcast(last), F.col("page_index") <= F.col("__last")).drop("__last")  # one row
    rows = rows.select("page_index", F.posexplode("results").alias("n", "r")).select(F.struct("page_index", "n").alias("pos"), "r.*")
    rows = rows.withColumn("__identity", decision_identity())
    if skip_duplicates:
        kept = rows.columns
        rows = rows.groupBy("__identity").agg(F.min_by(F.struct(*kept), "pos").alias("x")).select("x.*")
    else:
        rows = require_unique(rows, "__identity", "decision")
    if max_results is not None:
        rows = numbered(rows, "pos", "__place").where(F.col("__place") < max_results).drop("__place")  # a limit would hold its rows in one task
    # The identity is read here, so that Spark can't leave its check out.
    rows = rows.where(F.col("__identity").isNotNull()).drop("__identity")
    if texts is not None:
        rows = enrich(rows, texts(rows) if callable(texts) else texts)
    needed = ["case_reference", "text_url"] + (["full_text"] if texts is not None else [])
    bad = F.lit(False)
    for c in needed:
        bad = bad | blank_to_null(F.col(c)).isNull()
    return rows.withColumn("case_reference", F.when(bad, F.raise_error(F.lit("a decision lacks its reference, url or text"))).otherwise(F.col("case_reference")))
