"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word: a run of anything but the ASCII white space characters.
WORD = r"[^\x20\x09-\x0D]+"
#: Maps A-Z to a-z and leaves every other character alone.
LOWER_AZ = {c: c + 32 for c in range(65, 91)}

_own_folder: str | None = None
#: The folders of the block that is being run, if any.
_owner: ContextVar[list | None] = ContextVar("owner", default=None)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where that setting is absent a temporary folder is made, and only for a local session: the
    executors of a cluster would not see it.
    """
    global _own_folder
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if _own_folder is None:
        _own_folder = "file://" + tempfile.mkdtemp(prefix="tessera-")
    return _own_folder


class Owned:
    """A block that owns the scratch folders opened in it, by its own thread and not by other queries of the
    driver, so that it can discard them once the result that they led to is written."""

    def __enter__(self) -> Owned:
        self.held: list[Scratch] = []
        self._token = _owner.set(self.held)
        return self

    def __exit__(self, *_) -> None:
        _owner.reset(self._token)

    def discard(self) -> None:
        for scratch in self.held:
            scratch.discard()
        self.held.clear()


class Scratch:
    """Tables written to the shared folder and read again: cuts lineage and survives lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self.written: list[str] = []
        if (held := _owner.get()) is not None:
            held.append(self)

    def path(self, tag: str) -> str:
        return f"{self.root}/{tag}"

    def write(self, df: DataFrame, tag: str, partition_by: list[str] | None = None, **options: str) -> DataFrame:
        writer = df.write.mode("overwrite").option("compression", "zstd")
        for key, value in options.items():
            writer = writer.option(key.replace("__", "."), value)
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(self.path(tag))
        self.written.append(tag)
        return self.read(tag, df.schema)

    def read(self, tag: str, schema: T.StructType) -> DataFrame:
        return self.spark.read.schema(schema).parquet(self.path(tag))

    def drop(self, tag: str) -> None:
        """Deletes a table that no later step reads."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path(tag))
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        self.written = [t for t in self.written if t != tag]

    def discard(self, *keep: str) -> None:
        """Deletes all tables but those to ``keep``, which a result still reads."""
        for tag in set(self.written) - set(keep):
            self.drop(tag)

    def free_shuffles(self) -> None:
        """Lets Spark's cleaner remove shuffle files of plans that are no longer referenced."""
        self.spark.sparkContext._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 1000, size: str = "8m") -> None:
    """Bounds the Arrow batches that Python workers get, so that very long texts can't pile up in one."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def map_texts(
    df: DataFrame,
    function: Callable[[list[str]], dict],
    fields: dict[str, T.DataType],
    text_col: str = "text",
    keep: list[str] | None = None,
) -> DataFrame:
    """Adds columns computed from batches of texts; null counts as the empty text.

    Columns of ``df`` that have the name of an added one are replaced. ``function`` gets the texts
    of an Arrow batch and returns a list or array for each field.
    """
    kept = [c for c in (keep if keep is not None else df.columns) if c not in fields]
    texts = "__text"
    while texts in kept:
        texts += "_"
    whole = F.col(f"`{text_col}`")
    nothing = F.lit("").cast(df.schema[text_col].dataType)  # the texts may be bytes too
    source = df.select(*[F.col(f"`{c}`") for c in kept], F.coalesce(whole, nothing).alias(texts))
    schema = T.StructType([*source.schema.fields[:-1], *[T.StructField(n, t) for n, t in fields.items()]])
    kinds = _arrow(T.StructType([T.StructField(n, t) for n, t in fields.items()]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = function(batch.column(batch.num_columns - 1).to_pylist())
            arrays = [*batch.columns[:-1], *[pa.array(made[f.name], type=f.type) if not isinstance(made[f.name], pa.Array) else made[f.name] for f in kinds]]
            yield pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names[:-1], *[f.name for f in kinds]])

    return source.mapInArrow(run, schema)


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, max_chars: int, where=None) -> list[tuple[str, int]]:
    """(text, label) of a bounded sample of labelled rows: for each of the labels 0 and 1 the
    ``per_class`` rows with the smallest hash of doc_id, of texts with at most ``max_chars`` characters.

    The labels are cut to the bound first, so at most 2 * per_class ids are broadcast and collected.
    """
    rows = labels.select("doc_id", F.col(label).cast("int").alias("label")).where("doc_id is not null and label in (0, 1)")
    if where is not None:
        rows = rows.where(where)
    picked = None
    for value in (0, 1):
        part = rows.where(F.col("label") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        picked = part if picked is None else picked.unionByName(part)
    picked = picked.groupBy("doc_id").agg(F.min("label").alias("label"))  # a doc_id with both labels counts as 0
    texts = docs.select("doc_id", "text").where(F.col("text").isNotNull() & (F.length("text") <= max_chars))
    found = texts.join(F.broadcast(picked), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * per_class).collect()
    return [(r["text"], r["label"]) for r in found]
