"""Streams with state by key: first rows over all batches and restarts, and answers that expire."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_rows(rows: DataFrame, key: str, order: str, fail: bool = False) -> DataFrame:
    """The first row of each ``key`` of a stream, and none of a key that an earlier batch had, before a restart too.

    Within a batch the row with the smallest ``order`` counts. With ``fail`` a key that comes twice raises
    instead, so that the batch does not count. Null keys raise. Before rows are brought together by key each
    partition leaves out what can't be first, so a key with very many rows makes no large task.
    """
    schema, keep = rows.schema, 2 if fail else 1
    checked = F.when(F.col(key).isNotNull(), F.col(key)).otherwise(F.raise_error(F.lit(f"a row without {key}")).cast(schema[key].dataType))

    def fewer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.sort_values(order, kind="stable").groupby(key, sort=False).head(keep)

    def first(group: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, best = 0, None
        for b in batches:
            n += len(b)
            some = b if best is None else pd.concat([best, b])
            best = some.sort_values(order, kind="stable").head(1)
        if fail and (state.exists or n > 1):
            raise RuntimeError(f"duplicate {key}: {group[0]}")
        if not state.exists and best is not None:
            state.update((True,))
            yield best

    thinned = rows.withColumn(key, checked).mapInPandas(fewer, schema)
    return thinned.groupBy(key).applyInPandasWithState(first, schema, "seen boolean", "append", "NoTimeout")


ANSWERS = "qid long, key string, answer string, asked boolean"


def answered(queries: DataFrame, answer: Callable[[str], str], seconds: float | None = 604_800) -> DataFrame:
    """(qid, key, answer, asked) for a stream of queries (qid, query, key): ``answer`` is asked once a key, and
    again when its answer is older than ``seconds``. An expired answer stays in the state until its key comes
    again: a stream with processing-time timers would never end under ``availableNow``."""

    def held(group: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        now, (known, until) = int(time.time() * 1000), state.get if state.exists else (None, 0)
        for b in batches:
            asked = until <= now
            if asked:
                known, until = answer(b["query"].iloc[0]), now + int(seconds * 1000) if seconds is not None else 1 << 62
                state.update((known, until))
            yield pd.DataFrame({"qid": b["qid"], "key": group[0], "answer": known, "asked": [asked, *[False] * (len(b) - 1)]})

    rows = queries.select(F.col("qid").cast("long").alias("qid"), "query", "key").groupBy("key")
    return rows.applyInPandasWithState(held, ANSWERS, "answer string, until long", "append", "NoTimeout")
