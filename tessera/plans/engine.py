"""Composed query plans: retrieval with plans, synthesis, caching."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ids import cache_key
from ..functions.text import normalise_query
from ..operators import answering as A
from ..operators import retrieval as R
from ..operators.ledger import Ledger
from ..schemas import HIT_FIELDS
from ..session import shared
from ..trace import logger

log = logger(__name__)


def run(points: DataFrame, queries: DataFrame, k: int = 5, rewriter=None, planner=A.mock_plan_text, embed=A.mock_embed, model=None, ledger: Ledger | None = None, search=R.hybrid_search) -> DataFrame:
    """(qid, answer, sources, plan_steps): rewrite, plan, hybrid search for every step in one batch,
    best chunks over the steps, synthesis.

    Each stage is written before the next one starts, and model replies go to the ``ledger``, so a model is
    asked once for each distinct prompt, and the steps that are returned are those that were searched. A
    stage that fails, in its set-up or on its rows, falls back: the query as it is, a plan of one step, no
    chunks, an empty answer. Models that give null are no failure; their operators say what then holds.
    ``search`` takes (points, queries, k) as ``hybrid_search`` does.
    """
    spark = queries.sparkSession
    ledger = ledger or Ledger(spark)
    work = f"{shared(spark)}/run-{uuid.uuid4().hex}"

    def kept(rows: DataFrame, stage: str) -> DataFrame:
        rows.write.parquet(f"{work}/{stage}")
        return spark.read.schema(rows.schema).parquet(f"{work}/{stage}")

    asked = kept(queries.select("qid", "query"), "asked")
    if rewriter:
        reply = lambda _: F.col("reply")  # noqa: E731 - the model's, from the ledger
        asked = _or(lambda: kept(ledger.ask(asked, "rewrite", rewriter, "query").select("qid", A.rewrite("query", reply).alias("query")), "rewritten"), asked, "rewrite")
    one = asked.withColumn("steps", A.single_step("query"))
    asked = _or(lambda: kept(ledger.ask(asked, "plan", planner, "query").select("qid", "query", A.plan("query", lambda _: F.col("reply")).alias("steps")), "planned"), one, "plan")
    hits = _or(lambda: kept(step_hits(points, asked, k, embed, search), "hits"), None, "execute")
    if hits is None:
        hits = spark.createDataFrame([], HIT_FIELDS.replace("qid long", f"qid {asked.schema['qid'].dataType.simpleString()}") + ", step_no int, rank int")
    gathered = A.gather(asked.select("qid", "query"), A.all_chunks(hits))
    nothing = gathered.select("qid", F.lit("").alias("answer"), F.array().cast("array<string>").alias("sources"))

    def answers() -> DataFrame:
        if model is None:
            return A.synthesize(gathered)
        prompts = kept(A.prompt_context(gathered), "prompts")
        return A.answered(ledger.ask(prompts, "synthesis", model, "query", "context"))

    made = _or(lambda: kept(answers(), "answers"), nothing, "synthesize")
    return made.join(asked.select("qid", F.transform("steps", lambda s: s["query"]).alias("plan_steps")), "qid")


def _or(stage, fallback, name: str):
    try:
        return stage()
    except Exception as error:  # noqa: BLE001 - any failure of a stage means its fallback
        log.warning("%s failed (%s); using its fallback", name, str(error)[:300])
        return fallback


def step_hits(points: DataFrame, asked: DataFrame, k: int, embed, search=R.hybrid_search) -> DataFrame:
    """Hits (qid, step_no, id, ...) of all steps of all queries in one retrieval; a step's key is its
    query's with its number."""
    steps = asked.select("qid", F.posexplode("steps").alias("step_no", "step"))
    keyed = steps.select(F.struct("qid", "step_no").alias("qid"), F.col("step.query").alias("query"), embed(normalise_query("step.query")).alias("vector"))
    hits = search(points, keyed, k)
    return hits.select("qid.qid", "qid.step_no", *[c for c in hits.columns if c != "qid"])


def retrieve(points: DataFrame, queries: DataFrame, k: int = 10, sources: list[str] | None = None, embed=A.mock_embed, rewriter=None, prefilter: bool = False) -> DataFrame:
    """Dense hits as answer rows. With ``sources`` five times k hits are fetched and then filtered;
    ``prefilter`` filters the points instead, which finds k rows where there are as many. Blank
    queries give no rows."""
    asked = queries.select("qid", normalise_query(A.rewrite("query", rewriter) if rewriter else F.col("query")).alias("query")).where("query <> ''")
    asked = asked.select("qid", embed(F.col("query")).alias("vector"))
    requested = F.array(*map(F.lit, sources or [])).cast("array<string>")
    court = F.col("payload.court_name") if "court_name" in points.schema["payload"].dataType.names else F.lit(None).cast("string")
    tags = R.source_tags(F.col("payload.source"), court)
    if prefilter and sources:
        found = R.dense_search(points.where(R.matches_sources(tags, requested)), asked, k)
        kept = points
    else:
        found, kept = R.dense_search(points, asked, R.raw_limit(k, bool(sources))), points
    found = found.join(kept.select("id", "payload"), "id")
    return R.retrieved_rows(R.filtered_retrieve(found, tags, requested, k))


def search(points: DataFrame, queries: DataFrame, k: int = 5, embed=A.mock_embed, rewriter=None) -> DataFrame:
    """Hybrid search with a rule-based answer and the strategy of each query."""
    asked = queries.withColumn("original", F.col("query")).withColumn("query", A.rewrite("query", rewriter) if rewriter else F.col("query"))
    hits = R.hybrid_search(points, asked.withColumn("vector", embed(normalise_query("query"))), k)
    rows = A.gather(asked.select("qid", F.col("original").alias("query")), hits)
    return A.rule_answer(rows).join(rows.select("qid", A.strategy(F.size("chunks")).alias("strategy")), "qid")


def cached(queries: DataFrame, cache: DataFrame, answer, corpus_version: str, now, ttl_seconds: int | None = 604_800) -> tuple[DataFrame, DataFrame]:
    """Answers from ``cache`` (key, answer, sources, plan_steps, expires_at) where it has them and they
    have not expired, else from ``answer(queries)``; and the rows to add to the cache."""
    keyed = queries.withColumn("key", cache_key("query", corpus_version))
    live = cache.where(F.col("expires_at").isNull() | (F.col("expires_at") > now)).drop("expires_at")
    hits = keyed.join(live, "key").select("qid", "answer", "sources", "plan_steps")
    misses = keyed.join(live.select("key"), "key", "left_anti")
    made = answer(misses.select("qid", "query")).select("qid", "answer", "sources", "plan_steps")
    expires = (now + F.expr(f"INTERVAL {ttl_seconds} SECONDS")) if ttl_seconds and ttl_seconds > 0 else F.lit(None).cast("timestamp")
    new = misses.join(made, "qid").dropDuplicates(["key"]).select("key", "answer", "sources", "plan_steps", expires.alias("expires_at"))
    return hits.unionByName(made), new
