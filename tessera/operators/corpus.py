"""Decisions to a corpus of chunks."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import blank_to_null, clean_chunk_text, reference_prefix, strip
from ..session import shared

CHUNK_SIZE, OVERLAP = 1500, 200
IDENTITY = ("ecli", "case_reference", "detail_url", "text_url", "result_id")
COMPLETENESS = ("case_reference", "ecli", "judge_rapporteur", "petitioner", "popular_name", "decision_date", "announcement_date", "filing_date", "publication_date", "decision_form", "importance", "verdict", "detail_url", "text_url")


def identity(columns: tuple[str, ...] = IDENTITY) -> Column:
    """First column that is not blank; rows without any raise."""
    return F.coalesce(*[blank_to_null(F.col(c).cast("string")) for c in columns], F.raise_error(F.lit("a decision has no identity")))


def completeness(columns: tuple[str, ...] = COMPLETENESS) -> Column:
    found = F.lit(0)
    for c in columns:
        found = found + F.when(F.coalesce(strip(F.col(c)), F.lit("")) != "", 1).otherwise(0)
    return found


def dedup_best(rows: DataFrame, key: Column, rank: list[Column], pos: str) -> DataFrame:
    """One row for each key: the greatest rank (booleans and whole numbers), ties to the smaller ``pos``;
    ``pos`` becomes the key's smallest, which is its place in first-seen order.

    An aggregation with a partial step: a key's rows are cut to one in each partition before the shuffle,
    so a key with very many rows makes no large task.
    """
    order = F.struct(*[(-r.cast("long")).alias(f"r{i}") for i, r in enumerate(rank)], F.col(pos).alias("pos"))
    best = rows.groupBy(key.alias("__key")).agg(F.min_by(F.struct(*rows.columns), order).alias("__best"), F.min(pos).alias("__pos"))
    return best.select(*[F.col("__pos").alias(c) if c == pos else F.col(f"__best.{c}").alias(c) for c in rows.columns])


def dedup_decisions(decisions: DataFrame, pos: str = "pos") -> DataFrame:
    """The most complete decision of each identity: with text, more fields, longer text, more lists."""
    text = F.coalesce(strip("full_text"), F.lit(""))
    lists = F.coalesce(F.size("related_regulations"), F.lit(0)) + F.coalesce(F.size("topics_and_keywords"), F.lit(0))
    return dedup_best(decisions, identity(), [text != "", completeness(), F.length(text), lists], pos)


def chunk(rows: DataFrame, text_col: str = "text", size: int = CHUNK_SIZE, overlap: int = OVERLAP) -> DataFrame:
    """One row for each chunk, with chunk_index and chunk_text, of cleaned texts; blank texts give none.

    One pass over a text cuts all its chunks: a match goes on by a step and takes the characters of a
    chunk from there. A row holds its own chunk, so the work and the rows' bytes grow with the text."""
    if size <= overlap or overlap < 0:
        raise ValueError("the chunk size must exceed the overlap, which must not be negative")
    step = size - overlap
    cleaned = rows.withColumn("__t", clean_chunk_text(F.col(text_col)))  # a filter on it would clean each text again
    n = F.greatest(F.ceil((F.length("__t") - overlap) / step), F.lit(1)).cast("int")
    pieces = F.slice(F.regexp_extract_all("__t", F.lit(f"(?s)(?=(.{{1,{size}}})).{{1,{step}}}"), 1), F.lit(1), n)
    others = [F.col(f"`{c}`") for c in cleaned.columns if c not in ("__t", "chunk_index", "chunk_text")]
    return cleaned.select(*others, F.posexplode(pieces).alias("chunk_index", "chunk_text"))


def chunk_decisions(decisions: DataFrame, size: int = CHUNK_SIZE, overlap: int = OVERLAP) -> DataFrame:
    rows = chunk(decisions, "full_text", size, overlap)
    return rows.select(
        F.concat_ws("_", reference_prefix("case_reference"), "chunk_index").alias("id"), F.col("chunk_text").alias("text"), "case_reference", "ecli",
        "decision_date", F.col("judge_rapporteur").alias("judge"), "text_url", "chunk_index", F.col("result_id").alias("document_id"),
    )


def require_unique(rows: DataFrame, column: str, what: str | None = None) -> DataFrame:
    """The rows; an id that occurs twice raises when they are computed. Only ids are counted and shuffled;
    the ids that repeat, none as a rule, are joined to the rows."""
    twice = rows.groupBy(F.col(column).alias("__id")).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1 and __id is not null")
    checked = rows.join(twice, F.col(column) == F.col("__id"), "left")
    failed = F.raise_error(F.concat(F.lit(f"duplicate {what or column}: "), F.col(column).cast("string"))).cast(rows.schema[column].dataType)
    return checked.withColumn(column, F.when(F.col("__n").isNotNull(), failed).otherwise(F.col(column))).drop("__id", "__n")


def build_corpus(decisions: DataFrame, size: int = CHUNK_SIZE, overlap: int = OVERLAP, pos: str = "pos") -> DataFrame:
    return require_unique(chunk_decisions(dedup_decisions(decisions, pos), size, overlap), "id")


def chunk_stats(chunks: DataFrame, doc: str, text: str = "chunk_text") -> DataFrame:
    return chunks.agg(F.countDistinct(doc).alias("documents"), F.count(F.lit(1)).alias("chunks"), F.bround(F.avg(F.length(text))).cast("long").alias("mean_length"))


def enrich(results: DataFrame, texts: DataFrame, url: str = "text_url", text: str = "full_text") -> DataFrame:
    """Left join of texts by url; rows without a url or text keep a null."""
    held = texts.select(F.col(url).alias("__url"), F.col(text).alias("__text"))
    return results.join(held, F.col(url) == F.col("__url"), "left").withColumn(text, F.col("__text")).drop("__url", "__text")


def corpus_version(files: DataFrame, *by: str) -> DataFrame:
    """First 16 hex digits of a digest over (name, size, modified) in order, of each corpus that ``by`` tells
    apart; 'seed-corpus' without files. A corpus's files, not their contents, go through one group."""
    parts = F.array_sort(F.collect_list(F.concat_ws("|", "name", "size", "modified")))
    return files.groupBy(*by).agg(F.when(F.count(F.lit(1)) == 0, F.lit("seed-corpus")).otherwise(F.substring(F.sha2(F.array_join(parts, "\n"), 256), 1, 16)).alias("version"))


def numbered(rows: DataFrame, order: str, name: str = "n") -> DataFrame:
    """``rows`` with their place, from 0, in the order of a column: sorted by range, numbered in each
    partition, and moved on by the sizes of the partitions before, a row each. The numbered rows are
    written once, as a second computation might draw other ranges."""
    spark = rows.sparkSession
    path = f"{shared(spark)}/numbered-{uuid.uuid4().hex}"
    placed = rows.repartitionByRange(F.col(order)).sortWithinPartitions(order).withColumn("__m", F.monotonically_increasing_id())
    placed.withColumns({"__p": F.shiftright("__m", 33), "__i": F.col("__m").bitwiseAND((1 << 33) - 1)}).drop("__m").write.parquet(path)
    split = spark.read.parquet(path)
    ahead = Window.partitionBy(F.lit(0)).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    sizes = split.groupBy("__p").agg(F.count(F.lit(1)).alias("__c")).select("__p", F.coalesce(F.sum("__c").over(ahead), F.lit(0)).alias("__before"))
    return split.join(F.broadcast(sizes), "__p").withColumn(name, F.col("__before") + F.col("__i")).drop("__p", "__i", "__before")
