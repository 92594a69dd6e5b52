"""Plans, strategies, prompts and answers; model calls are injected functions over columns."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import _col, strip, three_decimals

MAX_STEPS, MAX_CASES, MAX_EXCERPTS, EXCERPT, PROMPT_CHUNKS, PROMPT_CHARS = 5, 5, 3, 300, 5, 800
# Texts of the deterministic answers.
NO_RESULTS = "Nenalezeny žádné relevantní případy."
SUMMARY = "Na základě judikatury Ústavního soudu byly nalezeny relevantní případy týkající se: "
NO_EXCERPTS = "(žádné úryvky)"
EXPANSION = "ústavní soud judikatura právní věta základní práva"
MODEL_FAILED, NO_PLAN, PLANNER_FAILED = "fallback — LLM error", "fallback — empty plan", "orchestrator fallback"
REWRITE_MARK = "Přepsaný dotaz:"
PLAN_STEPS = ((" Haagská úmluva", "mezinárodní aspekt dotazu"), ("rodičovská odpovědnost únos dítěte", "určení příslušnosti soudu"), ("návrat dítěte do země obvyklého bydliště", "výkon rozhodnutí"))
SYNTHESIS = (
    "## Shrnutí\nNa základě dostupné judikatury Ústavního soudu lze konstatovat následující.\n\n## Klíčové závěry\n"
    "Ústavní soud opakovaně zdůraznil ochranu základních práv dotčených osob.\n\n## Relevantní rozhodnutí\nViz citovaná rozhodnutí v úryvcích výše."
)


def rewrite_prompt(query) -> Column:
    """The prompt of a rewrite: the query stands on the line before the mark."""
    return F.concat(F.lit("Přeformuluj dotaz pro vyhledávání v judikatuře.\n\n"), _col(query), F.lit(f"\n\n{REWRITE_MARK}"))


def mock_text_model(prompt) -> Column:
    """The last line before the mark with legal terms behind it; the terms alone where there is no mark.
    Blank lines do not count; a mark on the first line takes the prompt's last."""
    lines = F.filter(F.transform(F.split(_col(prompt), "\r\n|\r|\n"), strip), lambda x: x != "")
    at = F.array_position(lines, F.lit(REWRITE_MARK)).cast("int")
    line = F.when(at > 1, F.try_element_at(lines, F.greatest(at - 1, F.lit(1)))).when(at == 1, F.try_element_at(lines, F.lit(-1))).otherwise(F.lit(""))
    return strip(F.concat_ws(" ", line, F.lit(EXPANSION)))


def mock_rewrite(query) -> Column:
    """The query with legal terms behind it; a blank one gives the terms alone."""
    return strip(F.concat_ws(" ", strip(query), F.lit(EXPANSION)))


def prompted(model=mock_text_model):
    """A rewriter of a text model: query to prompt to reply."""
    return lambda query: model(rewrite_prompt(query))


def rewrite(query, model=mock_rewrite) -> Column:
    """The model's stripped text; the query itself where that is blank or null."""
    made = strip(model(_col(query)))
    return F.coalesce(F.nullif(made, F.lit("")), _col(query))


def mock_plan_text(query) -> Column:
    (tail, first), *rest = PLAN_STEPS
    return F.concat(F.lit("1. "), F.coalesce(F.nullif(strip(query), F.lit("")), F.lit("právní dotaz")), F.lit(f"{tail} | {first}"), *[F.lit(f"\n{i}. {q} | {r}") for i, (q, r) in enumerate(rest, 2)])


def parse_plan(text) -> Column:
    """Lines 'N. query | reason' to an array of (query, reason), five at most; other lines are dropped."""
    lines = F.transform(F.split(_col(text), "\r\n|\r|\n"), strip)
    lines = F.transform(lines, lambda x: F.when(x.rlike(r"^\p{Nd}[^.]*\."), strip(F.regexp_replace(x, r"^[^.]*\.", ""))).otherwise(x))
    lines = F.filter(lines, lambda x: F.contains(x, F.lit("|")))
    steps = F.transform(lines, lambda x: F.struct(strip(F.substring_index(x, "|", 1)).alias("query"), strip(F.regexp_replace(x, r"^[^|]*\|", "")).alias("reason")))
    return F.slice(F.filter(steps, lambda s: s["query"] != ""), 1, MAX_STEPS)


def plan(query, model=mock_plan_text) -> Column:
    """Parsed steps, or the query as the only one where the model gives none."""
    text = model(_col(query))
    single = lambda why: F.array(F.struct(_col(query).alias("query"), F.lit(why).alias("reason")))
    steps = parse_plan(text)
    return F.when(text.isNull(), single(MODEL_FAILED)).when(F.size(steps) == 0, single(NO_PLAN)).otherwise(steps)


def strategy(n) -> Column:
    """struct(mode, reason) of a number of results."""
    of = lambda mode, reason: F.struct(F.lit(mode).alias("mode"), F.lit(reason).alias("reason"))
    return (
        F.when(n == 0, of("no_results", "empty retrieval")).when(n == 1, of("direct_answer", "single chunk"))
        .when(n >= 3, of("llm_summary", "multi-source synthesis")).otherwise(of("direct_answer", "default fallback"))
    )


def gather(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """``queries`` with ``chunks``: their hits in rank order; queries without hits get none."""
    ordered = F.array_sort(F.collect_list(F.struct("rank", "id", "text", "score")))
    return queries.join(hits.groupBy("qid").agg(ordered.alias("chunks")), "qid", "left").withColumn("chunks", F.coalesce("chunks", F.array().cast("array<struct<rank:int,id:string,text:string,score:double>>")))


def distinct_ids(chunks="chunks") -> Column:
    return F.array_distinct(F.transform(_col(chunks), lambda c: c["id"]))


def rule_answer(rows: DataFrame, *more: Column) -> DataFrame:
    """(qid, query, summary, top_cases, excerpts) of gathered rows, and ``more`` columns over them."""
    some = F.size("chunks") > 0
    excerpts = F.transform(F.filter(F.slice("chunks", 1, MAX_EXCERPTS), lambda c: F.coalesce(c["text"], F.lit("")) != ""), lambda c: F.substring(c["text"], 1, EXCERPT))
    return rows.select("qid", "query", F.when(some, F.concat(F.lit(SUMMARY), "query")).otherwise(NO_RESULTS).alias("summary"), F.slice(distinct_ids(), 1, MAX_CASES).alias("top_cases"), excerpts.alias("excerpts"), *more)


def hybrid_answer(rows: DataFrame, model) -> DataFrame:
    """Rule answers of fewer than two chunks; ``model(query, chunks)`` writes the others."""
    base = rule_answer(rows).drop("query")
    return rows.join(base, "qid").withColumn("answer", F.when(F.size("chunks") < 2, F.col("summary")).otherwise(model(F.col("query"), F.col("chunks")))).drop("chunks")


def all_chunks(hits: DataFrame) -> DataFrame:
    """Hits of all steps (qid, step_no, rank, id, ...): each id's best, score first, then first seen."""
    w = Window.partitionBy("qid", "id")
    slot = F.struct("step_no", "rank")
    best = hits.withColumns({"slot": F.min(slot).over(w), "nth": F.row_number().over(w.orderBy(F.desc("score"), slot))}).where("nth = 1")
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "slot"))).drop("nth", "slot", "step_no")


def single_step(query, reason: str = PLANNER_FAILED) -> Column:
    """A plan whose only step is the query."""
    return F.array(F.struct(_col(query).alias("query"), F.lit(reason).alias("reason")))


def step_totals(hits: DataFrame) -> DataFrame:
    """(qid, total_chunks): the number of hits of all steps of a query, repeated ones counted."""
    return hits.groupBy("qid").agg(F.count(F.lit(1)).alias("total_chunks"))


def prompt_context(rows: DataFrame, exact: bool = True) -> DataFrame:
    """``rows`` with ``context``: '[id] (skóre: 0.123)' and text of each chunk."""
    show = three_decimals if exact else (lambda c: F.format_string("%.3f", c))
    flat = rows.select("qid", F.explode("chunks").alias("c"))
    flat = flat.withColumn("part", F.concat(F.lit("["), F.col("c.id"), F.lit("] (skóre: "), show(F.col("c.score")), F.lit(")\n"), F.col("c.text")))
    parts = flat.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct(F.col("c.rank").alias("rank"), "part"))).alias("parts"))
    joined = F.array_join(F.transform("parts", lambda p: p["part"]), "\n\n---\n\n")
    return rows.join(parts.select("qid", joined.alias("context")), "qid", "left").withColumn("context", F.coalesce("context", F.lit(NO_EXCERPTS)))


def synthesize(rows: DataFrame, model=None) -> DataFrame:
    """(qid, answer, sources); a model that gives null leaves an empty answer and keeps the sources."""
    made = model(F.col("query"), F.col("context")) if model else F.lit(SYNTHESIS)
    return answered(prompt_context(rows).withColumn("reply", made))


def answered(rows: DataFrame) -> DataFrame:
    """(qid, answer, sources) of gathered rows with the ``reply`` of a model."""
    return rows.select("qid", F.coalesce("reply", F.lit("")).alias("answer"), distinct_ids().alias("sources"))


def escape(c) -> Column:
    return F.translate(_col(c), "{}", "()")


def rag_messages(query, chunks, system: str, template: str) -> Column:
    """Two messages; ``template`` has {query} and {chunks}. Five chunks of 800 characters at most."""
    parts = F.transform(F.slice(_col(chunks), 1, PROMPT_CHUNKS), lambda c: F.concat(F.lit("["), c["id"], F.lit("] "), escape(F.substring(c["text"], 1, PROMPT_CHARS))))
    body = F.replace(F.replace(F.lit(template), F.lit("{query}"), escape(query)), F.lit("{chunks}"), F.coalesce(F.nullif(F.array_join(parts, "\n\n"), F.lit("")), F.lit(NO_EXCERPTS)))
    return F.array(F.struct(F.lit("system").alias("role"), F.lit(system).alias("content")), F.struct(F.lit("user").alias("role"), body.alias("content")))


def split_system(messages) -> Column:
    """struct(system, messages): the last system message apart from all others, '' if there is none."""
    system = F.filter(_col(messages), lambda m: m["role"] == "system")
    return F.struct(F.coalesce(F.try_element_at(system, F.lit(-1))["content"], F.lit("")).alias("system"), F.filter(_col(messages), lambda m: m["role"] != "system").alias("messages"))


def first_text_block(body) -> Column:
    """Text of a reply's first block of type text."""
    blocks = F.from_json(_col(body), "content array<struct<type:string,text:string>>")["content"]
    return F.try_element_at(F.filter(blocks, lambda b: b["type"] == "text"), F.lit(1))["text"]


def parse_reply(text: str | None, ids: list[str]) -> dict:
    """A reply to answer, reasoning, sources, confidence: JSON, fenced or not, else plain text."""
    empty = {"answer": "", "reasoning": "", "sources": [], "confidence": 0.0}
    text = (text or "").strip()
    if text.startswith("```"):
        lines = text.splitlines()[1:]
        if lines and lines[-1].strip() in ("```", "```json"):
            lines.pop()
        text = "\n".join(lines).strip()
    if not text:
        return empty
    try:
        data = json.loads(text)
    except json.JSONDecodeError:
        data = None
    if not isinstance(data, dict):
        return {"answer": text, "reasoning": "", "sources": ids[:3], "confidence": 0.0}
    answer = str(data.get("answer", "")).strip()
    if not answer:
        return empty
    try:
        confidence = float(data.get("confidence", 0.0))
    except (TypeError, ValueError):
        confidence = 0.0
    sources = data.get("sources", [])
    clamped = 1.0 if confidence != confidence else max(0.0, min(1.0, confidence))
    return {"answer": answer, "reasoning": str(data.get("reasoning", "")).strip(), "sources": [str(s) for s in sources] if isinstance(sources, list) else [], "confidence": clamped}


REPLY = T.StructType([
    T.StructField("answer", T.StringType()), T.StructField("reasoning", T.StringType()), T.StructField("sources", T.ArrayType(T.StringType())), T.StructField("confidence", T.DoubleType()),
])


@F.pandas_udf(REPLY)
def parse_replies(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for texts, ids in batches:
        yield pd.DataFrame([parse_reply(t, list(i) if i is not None else []) for t, i in zip(texts, ids, strict=True)], columns=["answer", "reasoning", "sources", "confidence"])


def mock_llm(query, chunks) -> Column:
    return F.struct(F.concat(F.lit("Mock odpověď na: "), _col(query)).alias("answer"), F.lit("").alias("reasoning"), F.slice(F.transform(_col(chunks), lambda c: c["id"]), 1, 3).alias("sources"), F.lit(0.5).alias("confidence"))


def mock_embed(text, dim: int = 10) -> Column:
    return F.array_repeat(F.lit(0.1).cast("float"), dim)


def embedder(encode, batch: int = 32):
    """A column function for ``encode(list of texts) -> vectors``, called once a batch of ``batch`` texts;
    a call that returns another number of vectors raises."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def embed(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for t in texts:
            values, out = t.fillna("").tolist(), []
            for i in range(0, len(values), batch):
                part = values[i : i + batch]
                out += [list(map(float, v)) for _, v in zip(part, encode(part), strict=True)]
            yield pd.Series(out)

    return embed


_models: dict = {}


def sentence_embedder(load, name: str = "model", batch: int = 32, normalise: bool = True):
    """A column function for a sentence model that ``load()`` makes, once in each Python worker and not
    before it is needed. Vectors get length 1 unless ``normalise`` is off; zero vectors stay."""

    def encode(texts: list[str]):
        model = _models.get(name) or _models.setdefault(name, load())
        vectors = np.asarray(model.encode(texts), "float64")
        if normalise and len(vectors):
            length = np.sqrt((vectors**2).sum(1, keepdims=True))
            vectors = vectors / np.where(length > 0, length, 1.0)
        return vectors

    return embedder(encode, batch)


def dimension(load) -> int:
    """The number of components of a sentence model's vectors."""
    return len(load().encode(["test"])[0])
