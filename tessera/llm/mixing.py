"""Mixing sources to target weights by Sainte-Laguë apportionment.

Equal blocks of words are apportioned to the sources by highest quotients, then within each source
to its shards, which gives every shard an integer quota; a seeded systematic selection picks that
many of the shard's blocks. Only DataFrame functions are used. The hot source is split into as many
shards as its size asks for, so no task gets a whole source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, Scratch, table

CYCLE = (5, 2, 1)
CAP = 3
SEED = 17
SHARD_WORDS = 1 << 17
MAX_SHARDS = 1 << 20
BLOCK_WORDS = 4096
#: Documents of one size that the pipeline stage numbers in one window, about.
LINE = 2000
#: Distinct sizes of a source that are gone through at once.
CHUNK = 256


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def sainte_lague(rows: DataFrame, part: list[str], key: str, weight: str, seats: str, out: str) -> DataFrame:
    """Adds ``out``: the seats that each row gets of its part's ``seats`` by highest quotients
    weight / (2 k - 1), ties to the smaller key.

    Rounding weight * seats / total is off by at most half a seat a row, so only that many
    quotients around it are made and ranked: a few per row, however many seats there are.
    """
    w = Window.partitionBy(*part)
    share = F.when(F.col("__sum") > 0, F.col(weight) * F.col(seats) / F.col("__sum")).otherwise(F.lit(0.0))
    rows = rows.withColumns({"__sum": F.sum(F.col(weight).cast("double")).over(w), "__n": F.count(F.lit(1)).over(w)})
    rows = rows.withColumn("__share", share)
    rows = rows.withColumn("__slack", (F.ceil(F.col("__share") * F.col("__n") / (2 * F.greatest(F.col(seats), F.lit(1)))) + 1).cast("long"))
    rows = rows.withColumn("__base", F.greatest(F.lit(0), F.round("__share").cast("long") - F.col("__slack")))
    rows = rows.withColumn("__open", F.col(seats) - F.sum("__base").over(w))
    quotients = rows.where(F.col(weight) > 0).select(
        *part, key, "__open", F.col(weight).alias("__w"), F.explode(F.sequence(F.col("__base") + 1, F.col("__base") + 2 * F.col("__slack") + 1)).alias("__k")
    )
    ranked = quotients.withColumn("__q", F.col("__w") / (2 * F.col("__k") - 1)).withColumn(
        "__rank", F.row_number().over(Window.partitionBy(*part).orderBy(F.desc("__q"), F.asc_nulls_last(key), "__k"))
    )
    won = ranked.where(F.col("__rank") <= F.col("__open")).groupBy(*part, key).agg(F.count(F.lit(1)).alias("__won"))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in (*part, key)]
    cond = same[0]
    for c in same[1:]:
        cond = cond & c
    kept = [c for c in rows.columns if not c.startswith("__")]
    return rows.alias("a").join(won.alias("b"), cond, "left").select(*[f"a.{c}" for c in kept], (F.col("a.__base") + F.coalesce("b.__won", F.lit(0))).alias(out))


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size) to targets: weights 5, 2, 1 repeat over the sources by code point, null
    last; they share the sum of all sizes; a target stops at three times its source's size and the
    excess goes to the others by weight until none is above.

    That rule is a water level: source i gets min(3 size, weight * level). A source is full when its
    3 size / weight is below the level, so the sources are sorted by that ratio and the level is the
    first at which what is left for the others, by weight, does not fill the next one.
    """
    one = Window.partitionBy(F.lit(0))
    order = one.orderBy(F.asc_nulls_last("source"))
    rows = sizes.withColumn("__i", F.row_number().over(order) - 1)
    weight = F.element_at(F.array(*[F.lit(float(x)) for x in CYCLE]), (F.col("__i") % len(CYCLE) + 1).cast("int"))
    rows = rows.withColumn("weight", weight).withColumn("__cap", CAP * F.col("source_size").cast("double"))
    by_ratio = one.orderBy(F.col("__cap") / F.col("weight"), "__i")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(one) - F.coalesce(F.sum("__cap").over(before), F.lit(0.0))
    rest = F.sum("weight").over(one) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    rows = rows.withColumn("__level", F.when(left / rest <= F.col("__cap") / F.col("weight"), left / rest))
    rows = rows.withColumn("__first", F.min(F.when(F.col("__level").isNotNull(), F.struct((F.col("__cap") / F.col("weight")).alias("r"), F.col("__i").alias("i"), F.col("__level").alias("v")))).over(one))
    level = F.col("__first.v")
    target = F.when(level.isNull(), F.col("__cap")).otherwise(F.least(F.col("__cap"), F.col("weight") * level))
    return rows.select("source", "source_size", "weight", F.coalesce(target, F.lit(0.0)).alias("target"))


def mix(docs: DataFrame, text_col: str = "text", seed: int = SEED, scratch: Scratch | None = None) -> DataFrame:
    """``docs`` without the text, with size, source_size, target and taken (words that the mix takes,
    repeats counted).

    Null source is a source of its own; null or empty texts have size 0 and nothing is taken of them; a
    very long text spans many blocks; an empty table stays empty; equal rows are interchangeable, so
    reruns give the same rows. Columns with the names of added ones are replaced; names starting with
    two underscores are reserved. The sources, one row each, are apportioned in one task, and so are the
    shards of a source.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "mix")
    added = ("size", "source_size", "target", "taken")
    kept = [c for c in docs.columns if c not in added and c != text_col]
    hashed = F.xxhash64(F.col("doc_id"), F.col(text_col), F.lit(seed))
    rows = scratch.write(docs.select(*kept, n_words(F.col(text_col)).alias("size"), hashed.alias("__h")), "sized")

    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    goals = targets(sources)
    one = Window.partitionBy(F.lit(0))
    goals = goals.withColumn("__total", F.sum("source_size").over(one))
    least = F.min(F.when(F.col("target") > 0, F.col("target"))).over(one)
    goals = goals.withColumn("__block", F.greatest(F.lit(1), F.least(F.lit(BLOCK_WORDS), F.floor(least / 200))).cast("long"))
    goals = goals.withColumn("__one", F.lit(0)).withColumn("__seats", F.round(F.sum("target").over(one) / F.coalesce("__block", F.lit(1))).cast("long"))
    goals = goals.withColumn("__shards", F.least(F.lit(MAX_SHARDS), F.ceil(F.greatest(F.col("source_size"), F.lit(1)) / SHARD_WORDS)).cast("long"))
    goals = goals.select("source", "source_size", "target", F.col("__block").alias("block"), F.col("__seats").alias("seats"), F.col("__shards").alias("shards"), F.col("__one").alias("one"))
    goals = scratch.write(sainte_lague(goals, ["one"], "source", "target", "seats", "quota"), "sources")

    # A source's row count is that of sources, not of documents; Spark decides by its size whether to broadcast it.
    in_shards = rows.alias("d").join(goals.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source"))).select("d.*", "s.source_size", "s.target", "s.block", "s.quota", F.pmod(F.col("d.__h"), F.col("s.shards")).alias("shard"))
    shards = in_shards.groupBy("source", "shard").agg(F.sum("size").alias("length"), F.first("block").alias("block"), F.first("quota").alias("quota"))
    shards = sainte_lague(shards, ["source"], "shard", "length", "quota", "picks")
    blocks = F.ceil(F.col("length") / F.col("block")).cast("long")
    shards = shards.select("source", "shard", F.greatest(blocks, F.lit(1)).alias("n"), F.least(F.col("picks"), CAP * blocks).alias("picks"))
    shards = shards.withColumn("offset", F.pmod(F.xxhash64("source", "shard", F.lit(seed + 1)), F.col("n")))
    shards = scratch.write(shards, "shards")

    lined = in_shards.alias("d").join(shards.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")) & (F.col("d.shard") == F.col("s.shard"))).select("d.*", "s.n", "s.picks", "s.offset")
    line = Window.partitionBy("source", "shard").orderBy("__h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    lined = lined.withColumn("__to", F.sum("size").over(line))

    def chosen(x: Column) -> Column:
        """Words of the line before x that are in chosen blocks; block j is chosen when the running count of picks rises there."""
        rest = F.col("picks") % F.col("n")
        upto = lambda j: F.floor((j * rest + F.col("offset")) / F.col("n")).cast("long")
        j = F.floor(x / F.col("block")).cast("long")
        return F.col("block") * upto(j) + (x % F.col("block")) * (upto(j + 1) - upto(j))

    rounds = F.floor(F.col("picks") / F.col("n")).cast("long")
    taken = rounds * F.col("size") + chosen(F.col("__to")) - chosen(F.col("__to") - F.col("size"))
    return lined.select(*kept, "size", "source_size", "target", F.least(taken, CAP * F.col("size")).cast("long").alias("taken"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def whole_documents(docs: DataFrame, text_col: str = "text", seed: int = SEED, scratch: Scratch | None = None) -> DataFrame:
    """``docs`` with ``__copies`` (columns of any other names are kept as they are): how often each whole document is taken so that a source's words meet its target.

    As in ``mix``, all words of the mix are apportioned to the sources by highest quotients (here single
    words and no blocks, so that a quota is its target to a word), then a source's to its shards, and a
    seeded systematic selection picks within a shard. Documents are taken whole, so a source's shards are
    those of its sizes: each size, longest first, gets what its words and what was left over so far come to,
    rounded to documents, and the rest is carried to the next smaller size; a size's copies are
    apportioned to its lines, shards of LINE documents or so, by highest quotients. No document gets fewer
    copies than its source's rate rounded down or more than it rounded up (equal quotients bound a line's
    seats by these multiples of its documents), so the source misses its target by half its shortest
    documents where these can take up the rest.
    """
    scratch = scratch or Scratch(docs.sparkSession, "whole")
    rows = docs.select(F.struct("*").alias("__row"), "source", "doc_id", n_words(F.col(text_col)).alias("__size"), F.xxhash64(F.col("doc_id"), F.col(text_col), F.lit(seed)).alias("__h"))
    rows = scratch.write(rows, "sized")
    counts = scratch.write(rows.groupBy("source", "__size").agg(F.count(F.lit(1)).alias("n")), "sizes")
    goals = targets(counts.groupBy("source").agg(F.sum(F.col("__size") * F.col("n")).alias("source_size")))
    one = Window.partitionBy(F.lit(0))
    goals = goals.withColumns({"__seats": F.round(F.sum("target").over(one)).cast("long"), "__one": F.lit(0)})
    goals = goals.select("source", "source_size", "target", F.col("__seats").alias("seats"), F.col("__one").alias("one"))
    goals = scratch.write(sainte_lague(goals, ["one"], "source", "target", "seats", "quota"), "sources")
    rates = goals.where("source_size > 0").select("source", (F.col("quota") / F.col("source_size")).alias("rate"))

    # One array a source: its distinct sizes, not its documents.
    sizes = counts.where("__size > 0").groupBy("source").agg(F.array_sort(F.collect_list(F.struct((-F.col("__size")).alias("s"), F.col("n").alias("n")))).alias("sizes"))
    sizes = sizes.alias("a").join(rates.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source"))).select("a.source", "a.sizes", "b.rate")
    pick = "struct<size:bigint,n:bigint,picks:bigint>"
    none, nothing = F.array().cast(f"array<{pick}>"), F.struct(F.lit(0.0).alias("carry"), F.array().cast(f"array<array<{pick}>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        size, rate = -x["s"], F.col("rate")
        want = acc["carry"] + rate * size * x["n"]
        picks = F.least(F.ceil(rate) * x["n"], F.greatest(F.floor(rate) * x["n"], F.floor(want / size + 0.5))).cast("long")
        return F.struct((want - picks * size).alias("carry"), F.concat(acc["out"], F.array(F.struct(size.alias("size"), x["n"].alias("n"), picks.alias("picks")))).alias("out"))

    def chunked(acc: Column, chunk: Column) -> Column:
        """CHUNK sizes at once, so that the array of all is not copied once a size."""
        made = F.aggregate(chunk, F.struct(acc["carry"].alias("carry"), none.alias("out")), step)
        return F.element_at(F.transform(F.array(made), lambda v: F.struct(v["carry"].alias("carry"), F.concat(acc["out"], F.array(v["out"])).alias("out"))), 1)

    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size("sizes") - 1) / CHUNK).cast("int")), lambda g: F.slice("sizes", g * CHUNK + 1, F.lit(CHUNK)))
    picked = sizes.select("source", "rate", chunks.alias("chunks")).select("source", F.explode(F.flatten(F.aggregate("chunks", nothing, chunked, lambda acc: acc["out"]))).alias("x"))
    picked = scratch.write(picked.select("source", F.col("x.size").alias("size"), F.col("x.n").alias("n"), F.col("x.picks").alias("picks")), "picked")

    # A common size is split by hash into lines of LINE documents or so, which share its copies.
    same = F.col("d.source").eqNullSafe(F.col("s.source")) & (F.col("d.__size") == F.col("s.size"))
    lined = rows.alias("d").join(picked.alias("s"), same).select("d.*", "s.picks", F.pmod(F.col("d.__h"), F.ceil(F.col("s.n") / LINE)).alias("__line"))
    lines = lined.groupBy("source", F.col("__size").alias("size"), F.col("__line").alias("line")).agg(F.count(F.lit(1)).alias("m"), F.first("picks").alias("picks"))
    lines = scratch.write(sainte_lague(lines, ["source", "size"], "line", "m", "picks", "seats").select("source", "size", "line", "m", "seats"), "lines")
    same = F.col("a.source").eqNullSafe(F.col("b.source")) & (F.col("a.__size") == F.col("b.size")) & (F.col("a.__line") == F.col("b.line"))
    lined = lined.alias("a").join(lines.alias("b"), same).select("a.*", "b.m", "b.seats")
    at = F.row_number().over(Window.partitionBy("source", "__size", "__line").orderBy("__h", "doc_id"))
    offset = F.pmod(F.xxhash64("source", "__size", "__line", F.lit(seed + 1)), F.col("m"))
    upto = lambda i: F.floor((i * F.col("seats") + offset) / F.col("m"))
    lined = lined.withColumn("__at", at)
    return lined.select("__row.*", (upto(F.col("__at")) - upto(F.col("__at") - 1)).cast("int").alias("__copies"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: whole documents, repeated or left out so that each source meets its target, by the
    apportionment and the systematic selection of ``mix``.

    Documents without words take no part in the mix and go; very long ones are taken whole or not. A null source is a source of its own; an
    empty table stays empty; all columns are kept, whatever their names."""
    rows = whole_documents(docs)
    return rows.withColumn("__copy", F.explode(F.sequence(F.lit(0), F.col("__copies")))).where(F.col("__copy") > 0).select(*docs.columns)
