"""A table of vector points: payloads, idempotent merges, duplicate reports, repair and aliases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import CHECKSUM_KEYS, POINT_PREFIX, SCHEME, canonical_json, payload_checksum, point_id
from .corpus import dedup_best

SOURCE = "corpus"
COMPLETENESS = ("text", "case_reference", "ecli", "decision_date", "judge", "text_url", "chunk_index")


def make_points(chunks: DataFrame, source: str = SOURCE, prefix: str = POINT_PREFIX) -> DataFrame:
    """(id, payload) of chunks; the payload's checksum is over its other fields. A column ``pos`` of the
    chunks, their order, is kept."""
    fields = {k: F.col(k) for k in ("text", "case_reference", "ecli", "decision_date", "judge", "text_url", "chunk_index", "document_id")}
    fields |= {"original_id": F.col("id"), "source": F.lit(source), "point_id_scheme": F.lit(SCHEME)}
    checksum = F.sha2(canonical_json(fields), 256)
    payload = F.struct(*[fields[k].alias(k) for k in CHECKSUM_KEYS], checksum.alias("content_checksum"))
    return chunks.select(point_id("id", prefix).alias("id"), payload.alias("payload"), *[c for c in ("pos",) if c in chunks.columns])


def classify(new: DataFrame, existing: DataFrame, complete: bool = False) -> DataFrame:
    """New points with ``action``: insert, update or skip (same original id and checksum). A stored point
    without a checksum gets the one that its payload has; where ``complete`` says that all have one, only
    ids and checksums are read."""
    checksum = F.nullif(F.col("payload.content_checksum"), F.lit(""))
    checksum = checksum if complete else F.coalesce(checksum, payload_checksum("payload"))
    return classify_by_sums(new, existing.select("id", F.coalesce("payload.original_id", "id").alias("oid"), checksum.alias("sum")))


def classify_by_sums(new: DataFrame, sums: DataFrame) -> DataFrame:
    """``classify`` against the ids, original ids and checksums of stored points: (id, oid, sum)."""
    held = sums.select(F.col("id").alias("__id"), F.col("oid").alias("__oid"), F.col("sum").alias("__sum"))
    same = (F.col("__oid") == F.col("payload.original_id")) & F.col("__sum").eqNullSafe(F.col("payload.content_checksum"))
    action = F.when(F.col("__id").isNull(), "insert").when(same, "skip").otherwise("update")
    return new.join(held, F.col("id") == F.col("__id"), "left").withColumn("action", action).drop("__id", "__oid", "__sum")


def ingest_stats(classified: DataFrame) -> DataFrame:
    count = lambda a: F.count_if(F.col("action") == a)
    return classified.agg(F.count(F.lit(1)).alias("total_chunks"), count("insert").alias("inserted_points"), count("update").alias("updated_points"), count("skip").alias("skipped_points"))


def changed_points(classified: DataFrame, embed) -> DataFrame:
    """(id, vector, payload) of inserted and updated points, the only ones that are embedded. Of rows that
    repeat an id the last by ``pos`` counts, or the one with the greatest checksum where there is no such column."""
    last = F.struct(*[c for c in ("pos",) if c in classified.columns], F.col("payload.content_checksum"))
    rows = classified.where("action <> 'skip'").groupBy("id").agg(F.max_by("payload", last).alias("payload"))
    return rows.select("id", embed(F.col("payload.text")).alias("vector"), "payload")


def merge(existing: DataFrame, classified: DataFrame, embed) -> DataFrame:
    """The next version of the table."""
    changed = changed_points(classified, embed)
    return existing.join(changed.select("id"), "id", "left_anti").select("id", "vector", "payload").unionByName(changed)


def duplicate_report(points: DataFrame, key: Column | str = "payload.original_id") -> DataFrame:
    groups = points.groupBy((F.col(key) if isinstance(key, str) else key).alias("key")).agg(F.count(F.lit(1)).alias("n"))
    return groups.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_points"), F.count(F.lit(1)).alias("unique_ids"), F.count_if(F.col("n") > 1).alias("duplicate_groups"),
        (F.coalesce(F.sum("n"), F.lit(0)) - F.count(F.lit(1))).alias("extra_points"),
    )


def payload_completeness(payload: str = "payload") -> Column:
    found = F.lit(0)
    for k in COMPLETENESS:
        c = F.col(f"{payload}.{k}")
        found = found + F.when(c.isNotNull() & (c.cast("string") != ""), 1).otherwise(0)
    return found


def repair(points: DataFrame, prefix: str = POINT_PREFIX) -> DataFrame:
    """One point for each logical id: deterministic id first, then complete payload, long text, a
    vector, smaller id; it gets its deterministic id and payload defaults."""
    logical = F.coalesce(F.nullif(F.col("payload.original_id"), F.lit("")), F.col("id"))
    rows = points.withColumns({"__oid": logical, "__want": point_id(logical, prefix), "__cur": F.col("id")})
    rank = [F.col("id") == F.col("__want"), payload_completeness(), F.length(F.coalesce("payload.text", F.lit(""))), F.col("vector").isNotNull() & (F.size("vector") > 0)]
    best = dedup_best(rows, F.col("__oid"), rank, "__cur")
    fields = {k: F.col(f"payload.{k}") for k in CHECKSUM_KEYS} | {"original_id": F.col("__oid"), "point_id_scheme": F.lit(SCHEME)}
    fields["text"] = F.coalesce("payload.text", F.lit(""))
    fields["source"] = F.coalesce("payload.source", F.lit(SOURCE))
    payload = F.struct(*[fields[k].alias(k) for k in CHECKSUM_KEYS], F.sha2(canonical_json(fields), 256).alias("content_checksum"))
    return best.select(F.col("__want").alias("id"), "vector", payload.alias("payload"))


def supports_stable_sync(points: DataFrame, prefix: str = POINT_PREFIX) -> DataFrame:
    """One row: whether all points have an original id, the scheme and the id that follows."""
    ok = F.col("payload.original_id").isNotNull() & (F.col("payload.point_id_scheme") == SCHEME) & (F.col("id") == point_id(F.coalesce("payload.original_id", "id"), prefix))
    return points.agg(F.coalesce(F.bool_and(F.coalesce(ok, F.lit(False))), F.lit(True)).alias("stable"))


def write_version(points: DataFrame, path: str, expected: int | None = None, recreate: bool = False) -> DataFrame:
    """A new version of the table; an existing one raises unless ``recreate``; the count is asserted."""
    points.write.mode("overwrite" if recreate else "errorifexists").parquet(path)
    out = points.sparkSession.read.parquet(path)
    if expected is not None and (n := out.count()) != expected:
        raise RuntimeError(f"the new version has {n} points, not {expected}")
    return out


def require_vectors(points: DataFrame, dim: int) -> DataFrame:
    """The points; a vector that is not of ``dim`` components raises when they are computed."""
    size = F.coalesce(F.size("vector"), F.lit(0))
    failed = F.raise_error(F.concat(F.lit(f"a vector has not {dim} components: "), size.cast("string"))).cast(points.schema["vector"].dataType)
    return points.withColumn("vector", F.when(size == dim, F.col("vector")).otherwise(failed))


class Collections:
    """Named tables of points under ``root``, each a folder of its own, and aliases of them.

    An alias is a small file that names its collection; it is replaced by a rename, so readers see the
    old target or the new one, and it outlives the session."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._files = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._hadoop.Path(f"{self.root}/{name}" if name else self.root)

    def path(self, name: str) -> str:
        """The folder of a collection or of an alias's collection."""
        return f"{self.root}/{self.aliases().get(name, name)}"

    def aliases(self) -> dict[str, str]:
        folder = self._path("aliases.d")
        if not self._files.exists(folder):
            return {}
        names = [f.getPath().getName() for f in self._files.listStatus(folder)]
        return {n: self._text(f"aliases.d/{n}").strip() for n in names if not n.startswith((".", "_"))}

    def _text(self, name: str) -> str:
        """A small file, read without a job."""
        held = self._files.open(self._path(name))
        try:
            return self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(held, "UTF-8")
        finally:
            held.close()

    def exists(self, name: str) -> bool:
        """Whether a collection or an alias has that name."""
        return name in self.aliases() or self._files.exists(self._path(name))

    def create(self, name: str, dim: int, recreate: bool = False) -> bool:
        """Makes an empty collection of vectors of ``dim`` components, compared by cosine, unless there is
        one of that name already; whether it did."""
        if self.exists(name) and not recreate:
            held = self.properties(name)
            if held and held.get("dim") != str(dim):
                raise ValueError(f"collection {name} holds vectors of {held.get('dim')} components, not {dim}")
            return False
        from ..schemas import POINT_FIELDS

        self.spark.createDataFrame([], POINT_FIELDS).write.mode("overwrite").parquet(f"{self.root}/{name}")
        self._describe(name, {"dim": str(dim), "distance": "cosine"})
        return True

    def create_like(self, name: str, source: str, recreate: bool = False) -> None:
        """An empty collection with the properties of another; an existing one raises unless ``recreate``."""
        if self.exists(name) and not recreate:
            raise ValueError(f"collection {name} exists")
        self.create(name, int(self.properties(source).get("dim", 0)), recreate=True)

    def properties(self, name: str) -> dict[str, str]:
        held = f"properties.d/{self.aliases().get(name, name)}"
        if not self._files.exists(self._path(held)):
            return {}
        return dict(line.split("=", 1) for line in self._text(held).splitlines() if "=" in line)

    def _describe(self, name: str, values: dict[str, str]) -> None:
        self._put(f"properties.d/{name}", "\n".join(f"{k}={v}" for k, v in values.items()))

    def _put(self, name: str, text: str) -> None:
        """A small file, written beside its place and moved there."""
        folder, _, last = name.rpartition("/")
        self._files.mkdirs(self._path(folder))
        beside, at = self._path(f"{folder}/_{last}.new"), self._path(name)
        out = self._files.create(beside, True)
        out.write(bytearray(text.encode()))
        out.close()
        rename = getattr(self._hadoop, "Options$Rename")
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.OVERWRITE
        self._hadoop.FileContext.getFileContext(at.toUri() if at.toUri().getScheme() else self._files.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration()).rename(beside, at, options)

    def swap_alias(self, alias: str, name: str) -> None:
        """Points ``alias`` at another collection."""
        if not self._files.exists(self._path(name)):
            raise ValueError(f"no collection {name}")
        self._put(f"aliases.d/{alias}", name)

    def read(self, name: str) -> DataFrame:
        from ..schemas import POINT_FIELDS

        return self.spark.read.schema(POINT_FIELDS).parquet(self.path(name))

    def report(self, name: str) -> dict[str, int]:
        return duplicate_report(self.read(name)).first().asDict()

    def repair(self, source: str, destination: str, prefix: str = POINT_PREFIX, recreate: bool = False) -> dict[str, int]:
        """Writes one point for each logical id of ``source`` to ``destination`` and checks their number."""
        if destination == self.aliases().get(source, source):
            raise ValueError("a collection can't be repaired into itself")
        found = self.report(source)
        self.create_like(destination, source, recreate)
        write_version(repair(self.read(source), prefix), f"{self.root}/{destination}", found["unique_ids"], recreate=True)
        return found | {"written_points": found["unique_ids"]}


def swap_alias(spark: SparkSession, alias: str, path: str) -> None:
    """Points the session's view ``alias`` at another version; Collections.swap_alias lasts longer."""
    spark.read.parquet(path).createOrReplaceTempView(alias)
