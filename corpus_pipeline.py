"""A corpus pipeline over ``documents`` in five stages.

Toxic documents go; of each group of near copies one document stays; documents that hold benchmark
windows go; sources are mixed to target weights; what is left is written as token ids. Each stage's
result is written as Parquet and read again as the next one's input.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.common import Owned, Scratch, table
from tessera.llm.decontaminate import drop_contaminated
from tessera.llm.jaccard import keep_one
from tessera.llm.mixing import mixed
from tessera.llm.tokens import token_table
from tessera.llm.toxicity import drop_toxic

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", keep_one),
    ("benchmark_decontamination", drop_contaminated),
    ("source_mixing", mixed),
    ("token_output", token_table),
]

#: A trained model decides in the first stage, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        with Owned() as steps:
            docs = scratch.write(stage(spark, docs, sf_dir), name)
        steps.discard()  # what the stage wrote on its way
        if i:
            scratch.drop(STAGES[i - 1][0])
    return docs
