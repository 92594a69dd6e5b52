"""The registered queries of the engine and SQL with equal results.

Roles of the tables: documents are decisions, embeddings are vector points, pages are HTML,
benchmark items and user turns are queries.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import html as H
from ..functions import ids as I
from ..functions import text as X
from ..operators import answering as A
from ..operators import corpus as C
from ..operators import points as P
from ..operators import retrieval as R
from ..schemas import DECISION_FIELDS, _schema
from ..session import shared
from ..sources import files as S
from . import engine as E

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _corpus(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), "text", F.col("doc_id").alias("pos"))


def _asked(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))


def _points(spark: SparkSession, d: str) -> DataFrame:
    v = _t(spark, d, "embeddings").select(F.col("vec_id").alias("pos"), F.col("embedding").alias("vector"))
    return v.join(_t(spark, d, "documents").select(F.col("doc_id").alias("pos"), "text", "source"), "pos").withColumn("id", F.col("pos").cast("string"))


def _vector_queries(spark: SparkSession, d: str) -> DataFrame:
    v = _t(spark, d, "embeddings").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vector"))
    return _asked(spark, d).join(v, "qid")


_WORDS = r"list_filter(string_split_regex(lower(query), '\s+'), lambda w: length(w) >= 3)"
_NORMAL = r"trim(regexp_replace(lower(query), '\s+', ' ', 'g'))"
_KEYWORD = f"""q AS (SELECT item_id AS qid, text AS query, {_WORDS.replace('query', 'text')} AS words FROM benchmark),
dl AS (SELECT doc_id, text, lower(text) AS low FROM documents),
m AS (SELECT qid, doc_id, text, len(list_filter(words, lambda w: contains(low, w))) AS m FROM dl, q),
kw AS (SELECT qid, doc_id, text, least(CAST(0.3 AS DOUBLE) + CAST(0.1 AS DOUBLE) * m, CAST(0.9 AS DOUBLE)) AS score FROM m WHERE m > 0),
kt AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM kw) WHERE rank <= 10)"""
_DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE)))"
_COS = f"{_DOT.format(a='p.embedding', b='v.embedding')} / sqrt({_DOT.format(a='p.embedding', b='p.embedding')} * {_DOT.format(a='v.embedding', b='v.embedding')})"
_DENSE = f"""pts AS (SELECT e.vec_id, e.embedding, d.text, d.source FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id),
vq AS (SELECT e.vec_id AS qid, e.embedding FROM embeddings e JOIN benchmark b ON b.item_id = e.vec_id),
ds AS (SELECT v.qid, p.vec_id AS doc_id, p.text, p.source, {_COS} AS score FROM pts p, vq v),
dn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM ds) WHERE rank <= 10)"""
_FUSE = """bo AS (SELECT qid, doc_id, score, 0 AS list, rank FROM dn UNION ALL SELECT qid, doc_id, score, 1, rank FROM ktp),
fb AS (SELECT qid, doc_id, max(score) AS score, min(list * 1000 + rank) AS slot FROM bo GROUP BY qid, doc_id),
fu AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, slot) AS rank FROM fb) WHERE rank <= 10)"""
#: Vectors that a text gives by itself: how often each of 16 letters occurs, less the mean, times 16. All are
#: whole numbers, so sums are exact and cosines equal everywhere.
_ALPHABET = "etaoinshrdlcumfp"


@F.pandas_udf(T.ArrayType(T.FloatType()))
def _letter_counts(low: pd.Series) -> pd.Series:
    at = np.frombuffer(_ALPHABET.encode(), "uint8")
    counts = (np.bincount(np.frombuffer(text.encode(), "uint8"), minlength=128)[at] for text in low)
    return pd.Series([(16 * n - n.sum()).astype("float32") for n in counts], dtype=object)


def letter_vector(text) -> Column:
    """One pass over a text; as expressions, each of the letters would be one, for each use of the vector."""
    return _letter_counts(F.lower(F.coalesce(X._col(text), F.lit(""))))


def _vectors(rows: str, key: str, text: str) -> str:
    """SQL of (key, v) for the texts of ``rows``."""
    counts = f"list_transform(string_split('{' '.join(_ALPHABET)}', ' '), lambda c: length(lower({text})) - length(replace(lower({text}), c, '')))"
    return f"(SELECT {key}, list_transform(n, lambda x: CAST(16 * x - list_sum(n) AS DOUBLE)) AS v FROM (SELECT {key}, {counts} AS n FROM {rows}))"


def _hybrid_sql(queries: str, k: int, docs: str = "documents WHERE doc_id IN (SELECT vec_id FROM embeddings)") -> str:
    """CTEs that end in fu (qid, doc_id, score, rank), the fused best of ``queries``, SQL of (qid, query), and in
    dn, the nearest alone. Words are those of the normalised query, once each."""
    cos = _COS.replace("p.embedding", "p.v").replace("v.embedding", "u.v")
    return f"""nq AS (SELECT qid, {_NORMAL} AS query FROM ({queries})),
q AS (SELECT qid, list_distinct(list_filter(string_split(query, ' '), lambda w: length(w) >= 3)) AS words FROM nq),
dl AS (SELECT doc_id, lower(text) AS low FROM {docs}),
m AS (SELECT qid, doc_id, len(list_filter(words, lambda w: contains(low, w))) AS m FROM dl, q),
kw AS (SELECT qid, doc_id, least(CAST(0.3 AS DOUBLE) + CAST(0.1 AS DOUBLE) * m, CAST(0.9 AS DOUBLE)) AS score FROM m WHERE m > 0),
ktp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM kw) WHERE rank <= {k}),
pv AS {_vectors("(SELECT * FROM " + docs + ")", "doc_id", "text")}, uv AS {_vectors("nq", "qid", "query")},
ds AS (SELECT u.qid, p.doc_id, {cos} AS score FROM pv p, uv u WHERE list_sum(list_transform(p.v, lambda x: x * x)) > 0 AND list_sum(list_transform(u.v, lambda x: x * x)) > 0),
dn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM ds) WHERE rank <= {k}), {_FUSE.replace("rank <= 10", f"rank <= {k}")}"""


_KEYWORD_POINTS = _KEYWORD.replace("FROM documents)", "FROM documents WHERE doc_id IN (SELECT vec_id FROM embeddings))").replace("FROM benchmark)", "FROM benchmark WHERE item_id IN (SELECT vec_id FROM embeddings))").replace(_WORDS.replace("query", "text"), f"list_distinct({_WORDS.replace('query', 'text')})").replace("kt AS", "ktp AS")


@query(f"WITH {_KEYWORD_POINTS}, {_DENSE}, {_FUSE} SELECT qid, CAST(rank AS INT) AS rank, CAST(doc_id AS VARCHAR) AS id, round(score, 6) AS score FROM fu")
def q01_hybrid(spark, d):
    found = R.hybrid_search(_points(spark, d), _vector_queries(spark, d), 10)
    return found.select("qid", "rank", "id", F.round("score", 6).alias("score"))


flagship = q01_hybrid


@query(f"WITH {_KEYWORD} SELECT qid, CAST(rank AS INT) AS rank, CAST(doc_id AS VARCHAR) AS id, round(score, 6) AS score FROM kt")
def q02_keyword_topk(spark, d):
    return R.keyword_search(_corpus(spark, d), _asked(spark, d), 10).select("qid", "rank", "id", F.round("score", 6).alias("score"))


@query(f"WITH {_DENSE} SELECT qid, CAST(rank AS INT) AS rank, CAST(doc_id AS VARCHAR) AS id, round(score, 6) AS score FROM dn")
def q03_dense_knn(spark, d):
    return R.dense_search(_points(spark, d), _vector_queries(spark, d), 10).select("qid", "rank", "id", F.round("score", 6).alias("score"))


@query(f"WITH {_KEYWORD.replace('kt AS', 'ktp AS')}, {_DENSE}, {_FUSE} SELECT qid, CAST(rank AS INT) AS rank, CAST(doc_id AS VARCHAR) AS id, round(score, 6) AS score FROM fu")
def q04_fuse(spark, d):
    dense = R.dense_search(_points(spark, d), _vector_queries(spark, d), 10)
    return R.fuse(dense, R.keyword_search(_corpus(spark, d), _asked(spark, d), 10), 10).select("qid", "rank", "id", F.round("score", 6).alias("score"))


@query(f"""WITH {_KEYWORD}, r AS (SELECT kt.qid, doc_id, kt.rank AS before, score + CAST(0.05 AS DOUBLE) * len(list_filter(q.words, lambda w: contains(lower(kt.text), w))) AS score FROM kt JOIN q USING (qid))
SELECT qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, before) AS INT) AS rank, CAST(doc_id AS VARCHAR) AS id, round(score, 6) AS score FROM r QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, before) <= 5""")
def q05_rerank(spark, d):
    asked = _asked(spark, d)
    return R.rerank(R.keyword_search(_corpus(spark, d), asked, 10), asked, 5).select("qid", "rank", "id", F.round("score", 6).alias("score"))


_CHUNKS = r"""t AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '[ \t]+', ' ', 'g'), '^\s+', ''), '\s+$', '') AS t FROM documents),
n AS (SELECT doc_id, t, greatest(CAST(ceil((length(t) - 200) / 1300.0) AS INT), 1) AS n FROM t WHERE t <> ''),
c AS (SELECT doc_id, CAST(i AS INT) AS chunk_index, substring(t, i * 1300 + 1, 1500) AS chunk_text FROM (SELECT doc_id, t, unnest(generate_series(0, n - 1)) AS i FROM n))"""


@query(f"WITH {_CHUNKS} SELECT * FROM c")
def q06_chunk(spark, d):
    return C.chunk(_t(spark, d, "documents").select("doc_id", "text")).select("doc_id", "chunk_index", "chunk_text")


@query(f"WITH {_CHUNKS} SELECT count(DISTINCT doc_id) AS documents, count(*) AS chunks, CAST(round_even(avg(length(chunk_text)), 0) AS BIGINT) AS mean_length FROM c")
def q07_chunk_stats(spark, d):
    return C.chunk_stats(C.chunk(_t(spark, d, "documents").select("doc_id", "text")), "doc_id")


@query(r"SELECT doc_id, CASE WHEN s = '' THEN 'unknown' ELSE trim(regexp_replace(translate(s, ' /', '__'), '_+', '_', 'g'), '_') END AS prefix FROM (SELECT doc_id, source || '. ' || lang || ' ' || doc_id || '/' || n_chars AS s FROM documents)")
def q08_reference_prefix(spark, d):
    return _t(spark, d, "documents").select("doc_id", X.reference_prefix(F.concat("source", F.lit(". "), "lang", F.lit(" "), "doc_id", F.lit("/"), "n_chars")).alias("prefix"))


_TURNS = "u AS (SELECT conv_id, turn, text AS query FROM conversations WHERE role = 'user')"


@query(rf"WITH {_TURNS}, n AS (SELECT conv_id, turn, {_NORMAL} AS normal FROM u), w AS (SELECT conv_id, turn, normal, w, min(i) AS i FROM (SELECT conv_id, turn, normal, unnest(string_split(normal, ' ')) AS w, generate_subscripts(string_split(normal, ' '), 1) AS i FROM n) WHERE length(w) >= 3 GROUP BY ALL) SELECT n.conv_id, n.turn, n.normal, coalesce(string_agg(w.w, ' ' ORDER BY w.i), '') AS keywords FROM n LEFT JOIN w ON n.conv_id = w.conv_id AND n.turn = w.turn GROUP BY ALL")
def q09_query_keywords(spark, d):
    rows = _t(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", X.normalise_query("text").alias("normal"))
    return rows.select("conv_id", "turn", "normal", F.array_join(X.keywords("normal"), " ").alias("keywords"))


#: A mapping on words that the test tables have.
_MAP = (("the", ("article",)), ("tion", ("noun", "abstract")), ("ing", ("gerund",)), ("er", ("comparative", "noun")))


@query("WITH " + _TURNS + ", m(key, ord, concept) AS (VALUES ('the', 1, 'article'), ('tion', 2, 'noun'), ('tion', 3, 'abstract'), ('ing', 4, 'gerund'), ('er', 5, 'comparative'), ('er', 6, 'noun')), w AS (SELECT conv_id, turn, unnest(string_split(" + _NORMAL + ", ' ')) AS w, generate_subscripts(string_split(" + _NORMAL + ", ' '), 1) AS i FROM u), f AS (SELECT conv_id, turn, concept, min(i * 100 + ord) AS o FROM w, m WHERE length(w) >= 3 AND contains(w, key) GROUP BY ALL) SELECT u.conv_id, u.turn, coalesce(string_agg(concept, ',' ORDER BY o), '') AS concepts FROM u LEFT JOIN f ON u.conv_id = f.conv_id AND u.turn = f.turn GROUP BY ALL")
def q10_concepts(spark, d):
    rows = _t(spark, d, "conversations").where("role = 'user'")
    return rows.select("conv_id", "turn", F.array_join(X.concepts(X.keywords(X.normalise_query("text")), _MAP), ",").alias("concepts"))


_PLAIN = "html"
for _p in (r"(?is)<script\b[^>]*>.*?</script\s*>", r"(?is)<style\b[^>]*>.*?</style\s*>", r"(?s)<!--.*?-->", r"(?s)<[^>]+>"):
    _PLAIN = f"regexp_replace({_PLAIN}, '{_p}', chr(10), 'g')"
for _e, _v in H.ENTITIES:
    _PLAIN = f"replace({_PLAIN}, '{_e}', '{_v.replace(chr(39), chr(39) * 2)}')"
_PLAIN = rf"regexp_replace(regexp_replace(regexp_replace({_PLAIN}, '[^\S\n]+', ' ', 'g'), ' ?\n[ \n]*', chr(10), 'g'), '^[ \n]+|[ \n]+$', '', 'g')"


@query(f"SELECT page_id, {_PLAIN} AS text FROM pages")
def q11_plain_text(spark, d):
    return _t(spark, d, "pages").select("page_id", H.plain_text("html").alias("text"))


@query(r"SELECT page_id, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS title, len(regexp_extract_all(html, '(?i)<a\s[^>]*href=')) AS links, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host FROM pages")
def q12_html_fields(spark, d):
    title = F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1)
    return _t(spark, d, "pages").select("page_id", title.alias("title"), F.regexp_count("html", F.lit(r"(?i)<a\s[^>]*href=")).cast("long").alias("links"), F.regexp_extract("url", r"^[a-z]+://([^/]+)", 1).alias("host"))


@query("""WITH r AS (SELECT doc_id, md5(text) AS k, source, n_chars, row_number() OVER (PARTITION BY md5(text) ORDER BY (lang = 'en') DESC, n_chars DESC, doc_id) AS rn, min(doc_id) OVER (PARTITION BY md5(text)) AS pos FROM documents) SELECT doc_id, pos, source FROM r WHERE rn = 1""")
def q13_dedup(spark, d):
    rows = _t(spark, d, "documents").withColumn("pos", F.col("doc_id"))
    return C.dedup_best(rows, F.md5("text"), [F.col("lang") == "en", F.col("n_chars")], "pos").select("doc_id", "pos", "source")


@query("WITH g AS (SELECT md5(text) AS k, count(*) AS n FROM documents GROUP BY 1) SELECT CAST(sum(n) AS BIGINT) AS total_points, count(*) AS unique_ids, count(*) FILTER (n > 1) AS duplicate_groups, CAST(sum(n) - count(*) AS BIGINT) AS extra_points FROM g")
def q14_duplicate_report(spark, d):
    return P.duplicate_report(_t(spark, d, "documents").select("text"), F.md5("text"))


def _chunks(spark, d) -> DataFrame:
    rows = C.chunk(_t(spark, d, "documents"))
    return rows.select(F.concat_ws("_", "doc_id", "chunk_index").alias("id"), F.col("chunk_text").alias("text"), F.concat("source", F.lit(" "), "doc_id").alias("case_reference"), F.lit(None).cast("string").alias("ecli"), F.lit("2026-01-15").alias("decision_date"), F.col("lang").alias("judge"), F.lit(None).cast("string").alias("text_url"), "chunk_index", F.col("doc_id").alias("document_id"))


_UUID = """(SELECT substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab89ab89ab89ab', instr('0123456789abcdef', substr(h, 17, 1)), 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) FROM (SELECT sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode('tessera-chunk:' || doc_id || '_' || chunk_index)) AS h))"""
_CHECK = """sha256('{"case_reference":"' || source || ' ' || doc_id || '","chunk_index":' || chunk_index || ',"decision_date":"2026-01-15","document_id":' || doc_id || ',"ecli":null,"judge":"' || lang || '","original_id":"' || doc_id || '_' || chunk_index || '","point_id_scheme":"uuid5","source":"corpus","text":' || CAST(to_json(chunk_text) AS VARCHAR) || ',"text_url":null}')"""


@query(f"WITH {_CHUNKS} SELECT {_UUID} AS id, doc_id || '_' || chunk_index AS original_id, {_CHECK} AS checksum FROM c JOIN documents USING (doc_id)")
def q15_repair(spark, d):
    """Points with a legacy copy of every third: the deterministic ones stay."""
    points = P.make_points(_chunks(spark, d)).withColumn("vector", A.mock_embed("id"))
    legacy = points.where(F.col("payload.document_id") % 3 == 0).withColumn("id", F.concat(F.lit("legacy-"), "id"))
    return P.repair(points.unionByName(legacy)).select("id", F.col("payload.original_id").alias("original_id"), F.col("payload.content_checksum").alias("checksum"))


@query(f"WITH {_CHUNKS} SELECT doc_id || '_' || chunk_index AS original_id, {_CHECK} AS checksum FROM c JOIN documents USING (doc_id)")
def q16_checksum(spark, d):
    return P.make_points(_chunks(spark, d)).select(F.col("payload.original_id").alias("original_id"), F.col("payload.content_checksum").alias("checksum"))


@query(f"WITH {_CHUNKS} SELECT {_UUID} AS id, doc_id || '_' || chunk_index AS original_id FROM c")
def q16b_point_ids(spark, d):
    return P.make_points(_chunks(spark, d)).select("id", F.col("payload.original_id").alias("original_id"))


@query(f"WITH {_CHUNKS} SELECT count(*) AS total_chunks, count(*) FILTER (doc_id % 2 = 1) AS inserted_points, count(*) FILTER (doc_id % 2 = 0 AND doc_id % 10 = 0) AS updated_points, count(*) FILTER (doc_id % 2 = 0 AND doc_id % 10 <> 0) AS skipped_points FROM c")
def q17_ingest_classify(spark, d):
    """Chunks of even documents are stored, those of every tenth with another judge."""
    chunks = _chunks(spark, d)
    stored = chunks.where("document_id % 2 = 0").withColumn("judge", F.when(F.col("document_id") % 10 == 0, "old").otherwise(F.col("judge")))
    existing = P.make_points(stored).withColumn("vector", A.mock_embed("id"))
    return P.ingest_stats(P.classify(P.make_points(chunks), existing))


@query(f"WITH {_DENSE.replace('rank <= 10', 'rank <= 25')} SELECT qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY rank) AS INT) AS rank, CAST(doc_id AS VARCHAR) AS id FROM dn WHERE source IN ('src1', 'src3', 'src5', 'src7') QUALIFY row_number() OVER (PARTITION BY qid ORDER BY rank) <= 5")
def q18_source_filter(spark, d):
    points = _points(spark, d)
    hits = R.dense_search(points, _vector_queries(spark, d), R.raw_limit(5, True)).drop("source").join(points.select("id", "source"), "id")
    requested = F.array(*map(F.lit, ("SRC1", " src3", "src5", "src7")))
    return R.filtered_retrieve(hits, R.source_tags(F.col("source"), F.lit(None).cast("string")), requested, 5).select("qid", "rank", "id")


@query("""SELECT CAST(event_id AS VARCHAR) AS chunk_id, event_type AS source, nullif(CASE WHEN user_id % 2 = 0 THEN 'case ' || user_id ELSE '' END, '') AS reference, CAST(regexp_extract(props, '\\d+') AS INT) AS chunk_index FROM events""".replace("\\\\", "\\"))
def q19_retrieved_rows(spark, d):
    rows = _t(spark, d, "events").select(
        F.col("event_id").cast("string").alias("id"), F.lit("").alias("text"), F.col("value").alias("score"),
        F.struct(F.col("event_type").alias("source"), F.lit(" ").alias("case_reference"), F.when(F.col("user_id") % 2 == 0, F.concat(F.lit("case "), "user_id")).otherwise("").alias("reference"), F.get_json_object("props", "$.k").alias("chunk_index")).alias("payload"),
    )
    rows = rows.withColumn("payload", F.col("payload").withField("case_reference", F.lit("")))
    return R.retrieved_rows(rows).select("chunk_id", "source", "reference", "chunk_index")


@query(rf"WITH {_TURNS} SELECT conv_id, turn, CAST(0 AS INT) AS step_no, trim(regexp_replace(query, '\s+', ' ', 'g')) AS query, 'reason ' || turn AS reason FROM u UNION ALL SELECT conv_id, turn, 1, 'second', 'b | c' FROM u")
def q20_plan_parse(spark, d):
    rows = _t(spark, d, "conversations").where("role = 'user'")
    line = F.trim(F.regexp_replace("text", r"\s+", " "))
    text = F.concat(F.lit("7. "), line, F.lit(" | reason "), "turn", F.lit("\n\nno pipe here\n2. second | b | c\n3.  | no query"))
    steps = rows.select("conv_id", "turn", F.posexplode(A.parse_plan(text)).alias("step_no", "s"))
    return steps.select("conv_id", "turn", "step_no", "s.query", "s.reason")


_STEPS = _KEYWORD.replace("q AS (SELECT item_id AS qid, text AS query, " + _WORDS.replace("query", "text") + " AS words FROM benchmark)", "s AS (SELECT item_id AS id0, unnest([0, 1, 2]) AS step, text FROM benchmark), q AS (SELECT id0 * 5 + step AS qid, list_filter(string_split_regex(lower(split_part(text, '.', CAST(step + 1 AS INT))), '\\s+'), lambda w: length(w) >= 3) AS words FROM s)").replace("rank <= 10", "rank <= 5")


@query(f"WITH {_STEPS}, b AS (SELECT qid // 5 AS q0, doc_id, max(score) AS score, min(qid % 5 * 1000 + rank) AS slot FROM kt GROUP BY ALL) SELECT q0 AS qid, CAST(doc_id AS VARCHAR) AS id, CAST(row_number() OVER (PARTITION BY q0 ORDER BY score DESC, slot) AS INT) AS rank, round(score, 6) AS score FROM b")
def q21_multi_step(spark, d):
    """Each item's first three sentences as the steps of a plan."""
    part = lambda n: F.split_part("query", F.lit("."), F.lit(n + 1))
    steps = _asked(spark, d).select("qid", F.posexplode(F.array(*[part(n) for n in range(3)])).alias("step_no", "query"))
    hits = R.keyword_search(_corpus(spark, d), steps.select(F.struct("qid", "step_no").alias("qid"), "query"), 5)
    hits = hits.select("qid.qid", "qid.step_no", *[c for c in hits.columns if c != "qid"])
    return A.all_chunks(hits).select("qid", "id", "rank", F.round("score", 6).alias("score"))


def _gathered(spark, d) -> DataFrame:
    asked = _asked(spark, d)
    return A.gather(asked, R.keyword_search(_corpus(spark, d), asked, 10))


@query(f"""WITH {_KEYWORD}, a AS (SELECT qid, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY rank) FILTER (rank <= 5) AS cases, string_agg(substring(text, 1, 300), '|' ORDER BY rank) FILTER (rank <= 3 AND text <> '') AS excerpts, count(*) AS n FROM kt GROUP BY qid)
SELECT q.qid, CASE WHEN n > 0 THEN '{A.SUMMARY}' || q.query ELSE '{A.NO_RESULTS}' END AS summary, coalesce(cases, '') AS cases, coalesce(excerpts, '') AS excerpts, CASE WHEN coalesce(n, 0) = 0 THEN 'no_results' WHEN n >= 3 THEN 'llm_summary' ELSE 'direct_answer' END AS mode FROM q LEFT JOIN a USING (qid)""")
def q22_rule_answer(spark, d):
    rows = A.rule_answer(_gathered(spark, d), A.strategy(F.size("chunks"))["mode"].alias("mode"))
    return rows.select("qid", "summary", F.array_join("top_cases", ",").alias("cases"), F.array_join("excerpts", "|").alias("excerpts"), "mode")


@query(f"""WITH {_KEYWORD} SELECT q.qid, coalesce(string_agg('[' || doc_id || '] (skóre: ' || printf('%.3f', score) || ')' || chr(10) || kt.text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank), '{A.NO_EXCERPTS}') AS context FROM q LEFT JOIN kt USING (qid) GROUP BY q.qid""")
def q23_prompt_context(spark, d):
    return A.prompt_context(_gathered(spark, d)).select("qid", "context")


@query(r"""WITH u AS (SELECT conv_id, turn, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM conversations WHERE regexp_matches(text, '\w'))
SELECT conv_id, turn, CASE WHEN turn % 5 = 3 THEN '' ELSE t END AS answer, CASE turn % 5 WHEN 1 THEN 'r' ELSE '' END AS reasoning, CASE turn % 5 WHEN 0 THEN 'x,y,z' WHEN 4 THEN 'x,y,z' WHEN 1 THEN 's,' || conv_id ELSE '' END AS sources, CAST(CASE turn % 5 WHEN 1 THEN 1 WHEN 2 THEN 0.25 ELSE 0 END AS DOUBLE) AS confidence FROM u""")
def q24_reply_parse(spark, d):
    """Turns as replies of a model: plain, JSON, fenced JSON, JSON without an answer, and an array."""
    turns = _t(spark, d, "conversations").where(F.col("text").rlike(r"\w"))
    text = F.regexp_replace("text", r"^\s+|\s+$", "")
    whole = F.to_json(F.struct(F.col("text").alias("answer"), F.lit("r").alias("reasoning"), F.array(F.lit("s"), F.col("conv_id").cast("string")).alias("sources"), F.lit(5.0).alias("confidence")))
    fenced = F.concat(F.lit("```json\n"), F.to_json(F.struct(text.alias("answer"), F.lit("none").alias("sources"), F.lit(0.25).alias("confidence"))), F.lit("\n```"))
    forms = (F.concat(F.lit("\n "), F.col("text")), whole, fenced, F.lit('{"answer": " "}'), F.col("text"))
    reply = F.element_at(F.array(*forms), (F.col("turn") % 5).cast("int") + 1)
    out = turns.select("conv_id", "turn", A.parse_replies(reply, F.array(*map(F.lit, "xyzw"))).alias("r"))
    return out.select("conv_id", "turn", "r.answer", "r.reasoning", F.array_join("r.sources", ",").alias("sources"), "r.confidence")


@query("SELECT conv_id, coalesce(arg_max(text, turn) FILTER (role = 'system'), '') AS system, count(*) FILTER (role <> 'system') AS n, coalesce(string_agg(role || ':' || text, '|' ORDER BY turn) FILTER (role <> 'system'), '') AS messages FROM conversations GROUP BY conv_id")
def q25_message_payload(spark, d):
    turns = _t(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    split = turns.select("conv_id", A.split_system(F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content")))).alias("p"))
    joined = F.array_join(F.transform("p.messages", lambda m: F.concat_ws(":", m["role"], m["content"])), "|")
    return split.select("conv_id", "p.system", F.size("p.messages").cast("long").alias("n"), joined.alias("messages"))


@query(r"""SELECT item_id, 'rag-query:' || sha256('{"corpus_version":"v7","model":"m","prompt_version":"v1","provider":"p","query":' || CAST(to_json(trim(regexp_replace(lower(text), '\s+', ' ', 'g'))) AS VARCHAR) || '}') AS key FROM benchmark""")
def q26_cache_key(spark, d):
    return _t(spark, d, "benchmark").select("item_id", I.cache_key("text", "v7", "P ", "m").alias("key"))


@query(f"""WITH {_CHUNKS} SELECT '{{"id":"' || doc_id || '_' || chunk_index || '","text":' || CAST(to_json(chunk_text) AS VARCHAR) || ',"metadata":{{"case_reference":"' || source || ' ' || doc_id || '","ecli":null,"decision_date":"2026-01-15","judge":"' || lang || '","text_url":null,"chunk_index":' || chunk_index || ',"source":"corpus"}}}}' AS value FROM c JOIN documents USING (doc_id)""")
def q27_jsonl(spark, d):
    return S.chunk_records(_chunks(spark, d))


@query("SELECT d.doc_id, p.url, length(p.html) AS html_length FROM documents d LEFT JOIN pages p ON p.page_id = d.doc_id")
def q28_enrich(spark, d):
    docs = _t(spark, d, "documents").select("doc_id", F.col("doc_id").alias("text_url"))
    pages = _t(spark, d, "pages").select(F.col("page_id").alias("text_url"), F.struct("url", "html").alias("full_text"))
    return C.enrich(docs, pages).select("doc_id", "full_text.url", F.length("full_text.html").cast("long").alias("html_length"))


@query("SELECT d.doc_id, l.quality FROM (SELECT doc_id FROM documents ORDER BY doc_id LIMIT 100) d LEFT JOIN labels l USING (doc_id)")
def q29_limit_before_enrich(spark, d):
    first = _t(spark, d, "documents").select(F.col("doc_id").alias("text_url")).orderBy("text_url").limit(100)
    return C.enrich(first, _t(spark, d, "labels").select(F.col("doc_id").alias("text_url"), F.col("quality").alias("full_text"))).select(F.col("text_url").alias("doc_id"), F.col("full_text").alias("quality"))


@query("SELECT event_type, date_trunc('day', ts) AS start, count(*) AS n FROM events GROUP BY ALL")
def q30_stream_windows(spark, d):
    """The events as a stream, in one pass over what is there; the memory table holds the last result."""
    from ..streaming.ingest import windowed_counts

    name = f"s{uuid.uuid4().hex}"
    events = spark.readStream.schema(_t(spark, d, "events").schema).option("pathGlobFilter", "events.parquet").parquet(d).withColumn("ts", F.col("ts").cast("timestamp"))
    writer = windowed_counts(events, "ts", "event_type").writeStream.outputMode("complete").format("memory").queryName(name)
    stream = writer.option("checkpointLocation", f"{shared(spark)}/{name}").trigger(availableNow=True).start()
    stream.awaitTermination()
    return spark.table(name).select("event_type", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query(r"SELECT item_id, coalesce(nullif(lower(trim(regexp_replace(strip_accents(replace(text, 'ß', '')), '[^0-9A-Za-z]+', '_', 'g'), '_')), ''), 'results') AS slug FROM benchmark")
def q31_slugify(spark, d):
    return _t(spark, d, "benchmark").select("item_id", X.slugify("text").alias("slug"))


_STEP_ROWS = f"SELECT item_id * 5 AS qid, trim(string_split(trim(text), chr(10))[-1]) || '{A.PLAN_STEPS[0][0]}' AS query FROM benchmark UNION ALL SELECT item_id * 5 + 1, '{A.PLAN_STEPS[1][0]}' FROM benchmark UNION ALL SELECT item_id * 5 + 2, '{A.PLAN_STEPS[2][0]}' FROM benchmark"


@query(f"""WITH {_hybrid_sql(_STEP_ROWS, 5)}, b AS (SELECT qid // 5 AS q0, doc_id, max(score) AS score, min(qid % 5 * 1000 + rank) AS slot FROM fu GROUP BY ALL)
SELECT item_id AS qid, '{A.SYNTHESIS.replace("'", "''")}' AS answer, coalesce((SELECT string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY score DESC, slot) FROM b WHERE q0 = item_id), '') AS sources, trim(string_split(trim(text), chr(10))[-1]) || '{"|".join([A.PLAN_STEPS[0][0], *[q for q, _ in A.PLAN_STEPS[1:]]])}' AS plan_steps FROM benchmark""")
def q32_engine_run(spark, d):
    """The full plan with deterministic models over the items, on documents with vectors of their letters."""
    out = E.run(_points(spark, d).withColumn("vector", letter_vector("text")), _asked(spark, d), 5, embed=letter_vector)
    return out.select("qid", "answer", F.array_join("sources", ",").alias("sources"), F.array_join("plan_steps", "|").alias("plan_steps"))


@query(r"WITH h AS (SELECT page_id, len(regexp_extract_all(html, '(?i)<script\b')) AS scripts, len(regexp_extract_all(html, '(?i)<li\b')) AS items FROM pages) SELECT page_id, scripts, items FROM h")
def q33_tag_counts(spark, d):
    count = lambda p: F.regexp_count("html", F.lit(p)).cast("long")
    return _t(spark, d, "pages").select("page_id", count(r"(?i)<script\b").alias("scripts"), count(r"(?i)<li\b").alias("items"))


@query(f"WITH {_DENSE.replace('rank <= 10', 'rank <= 3')} SELECT qid, CAST(rank AS INT) AS rank, CAST(doc_id AS VARCHAR) AS chunk_id, source FROM dn")
def q34_retrieve(spark, d):
    points = _points(spark, d).withColumn("payload", F.struct("source", F.col("pos").alias("document_id")))
    found = R.dense_search(points, _vector_queries(spark, d), 3).join(points.select("id", "payload"), "id")
    return R.retrieved_rows(found).select("qid", "rank", "chunk_id", "source")


@query(f"WITH {_CHUNKS}, {_KEYWORD.replace('SELECT doc_id, text, lower(text) AS low FROM documents', 'SELECT doc_id * 1000000 + chunk_index AS doc_id, chunk_text AS text, lower(chunk_text) AS low FROM c')} SELECT qid, CAST(rank AS INT) AS rank, (doc_id // 1000000) || '_' || (doc_id % 1000000) AS id, round(score, 6) AS score FROM kt")
def q35_ingest_retrieve(spark, d):
    """Chunks are ingested into a durable table of points, a part of them a second time, and searched from there."""
    from ..streaming.ingest import PointTable

    table = PointTable(spark, f"{shared(spark)}/points-{uuid.uuid4().hex}")
    table.upsert(_chunks(spark, d), A.mock_embed)
    table.upsert(_chunks(spark, d).where("document_id % 3 = 0"), A.mock_embed)
    return R.keyword_search(R.as_hits(table.read()), _asked(spark, d), 10).select("qid", "rank", "id", F.round("score", 6).alias("score"))


_PAGE_SQL = """SELECT doc_id AS page, CAST(2 * doc_id AS INT) AS start_result, CAST(n_chars AS INT) AS total_results, CAST(greatest(doc_id + 1, 7) AS INT) AS total_pages, CAST(doc_id AS INT) AS page_index,
CAST(doc_id * 10 + i AS BIGINT) AS result_id, source || ' ' || doc_id || '/' || i AS case_reference, CASE WHEN i = 0 THEN 'ECLI:' || source || ':' || doc_id END AS ecli, CASE WHEN i = 0 THEN 'Judge ' || lang ELSE 'ECLI-less' END AS judge,
'P' || doc_id AS petitioner, CASE WHEN i = 0 THEN 'Name of & ' || lang END AS popular_name, '1. 1. 2024' AS decision_date, '3. 3. 2024' AS announcement_date, 'r1,r1,r' || doc_id AS regulations, 'Nález' AS decision_form, lang AS importance, 'zamítnuto zcela' AS verdict,
CASE WHEN i = 0 THEN 'https://example.org/Search/GetText.aspx?sz=' || doc_id || '-' || i || '&x=' || lang END AS text_url FROM documents, (VALUES (0), (1)) v(i)"""


@query(_PAGE_SQL)
def q36_result_pages(spark, d):
    """Result pages made of documents, two results each, parsed again."""
    docs = _t(spark, d, "documents")
    cell = lambda *parts: F.concat(F.lit("<td>"), *[p if not isinstance(p, str) else F.lit(p) for p in parts], F.lit("</td>"))
    c = F.col

    def result(i: int):
        n = F.concat(c("doc_id"), F.lit(f"/{i}"))
        case = [F.lit('<a href="ResultDetail.aspx?id='), n, F.lit('">'), c("source"), F.lit(" "), n, F.lit("</a><br>")]
        rest = [F.lit("ECLI:"), c("source"), F.lit(":"), c("doc_id"), F.lit("<br>Judge "), c("lang")] if i == 0 else [F.lit("ECLI-less")]
        name = [F.lit("<br>Name of &amp; "), c("lang")] if i == 0 else []
        cells = F.concat(
            cell('<input type="checkbox" name="x" id="sel_', (c("doc_id") * 10 + i).cast("string"), '">'), cell(*case, *rest), cell("P", c("doc_id").cast("string"), "<br>P", c("doc_id").cast("string"), *name),
            cell("1. 1. 2024<br>(-)<br> 3. 3. 2024"), cell("r1<br>r1<br>r", c("doc_id").cast("string")), cell("Nález<br>", c("lang")), cell("<b>zamítnuto</b> zcela"), cell(""), cell("t1<br>t1"), cell(""),
        )
        link = F.concat(F.lit("""<a href="#" onclick="window.open('/Search/GetText.aspx?sz="""), c("doc_id"), F.lit(f"-{i}&amp;x="), c("lang"), F.lit("""')">text</a>""")) if i == 0 else F.lit("<a href='#'>no text</a>")
        return F.concat(F.lit(f'<tr class="resultData{i}">'), cells, F.lit("</tr><tr><td>"), link, F.lit("</td></tr>"))

    head = F.concat(
        F.lit('<a href="#">2024</a><table><tr class="resultHeaderCount"><td>Výsledky '), c("doc_id") * 2, F.lit(" - "), c("doc_id") * 2 + 1, F.lit(" z celkem "), c("n_chars"),
        F.lit(' <input name="pageNumber" value="'), c("doc_id") + 1, F.lit('"> <a href="?page=6">7</a> <a>99</a></td></tr></table><table><tr id="headerRowFirst"><td>h</td></tr>'),
    )
    pages = docs.select(F.concat(head, result(0), result(1), F.lit("</table>")).alias("html"), c("doc_id").cast("string").alias("query"))
    rows = H.parse_result_pages(pages, "https://example.org/Search/").select("*", F.explode("results").alias("r"))
    same = ["start_result", "total_results", "total_pages", "page_index", "r.result_id", "r.case_reference", "r.ecli", F.col("r.judge_rapporteur").alias("judge"), "r.petitioner", "r.popular_name", "r.decision_date", "r.announcement_date", "r.decision_form", "r.importance", "r.verdict", "r.text_url"]
    return rows.select(F.col("query").cast("long").alias("page"), *same, F.array_join("r.related_regulations", ",").alias("regulations"))


@query(f"""WITH {_hybrid_sql("SELECT item_id AS qid, text AS query FROM benchmark", 100)} SELECT qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY rank) AS INT) AS rank, CAST(doc_id AS VARCHAR) AS chunk_id, source, doc_id AS document_id
FROM dn JOIN documents USING (doc_id) WHERE source IN ('src1', 'src3') QUALIFY row_number() OVER (PARTITION BY qid ORDER BY rank) <= 20""")
def q37_engine_retrieve(spark, d):
    """Retrieval with requested sources: five times the wanted rows are fetched, then filtered."""
    points = _points(spark, d).select("id", "text", "pos", letter_vector("text").alias("vector"), F.struct("source", F.col("pos").alias("document_id")).alias("payload"))
    rows = E.retrieve(points, _asked(spark, d), 20, ["SRC1 ", "src3"], embed=letter_vector)
    return rows.select("qid", "rank", "chunk_id", "source", F.col("document_id").cast("long").alias("document_id"))


@query(f"WITH {_KEYWORD} SELECT qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY length(text) DESC, rank) AS INT) AS rank, CAST(doc_id AS VARCHAR) AS id, CAST(length(text) AS DOUBLE) AS score FROM kt QUALIFY row_number() OVER (PARTITION BY qid ORDER BY length(text) DESC, rank) <= 5")
def q38_cross_encoder(spark, d):
    """Reranking by a model that scores a pair by the length of its text."""
    asked = _asked(spark, d)
    hits = R.keyword_search(_corpus(spark, d), asked, 10)
    return R.cross_encoder_rerank(hits, asked, lambda pairs: [len(t) for _, t in pairs], 5).select("qid", "rank", "id", "score")


@query(f"""WITH {_KEYWORD}, a AS (SELECT qid, string_agg('[' || doc_id || '] ' || translate(substring(text, 1, 800), '{{}}', '()'), chr(10) || chr(10) ORDER BY rank) AS chunks FROM kt WHERE rank <= 5 GROUP BY qid)
SELECT q.qid, 'Answer from the excerpts.' AS system, 'Q: ' || translate(q.query, '{{}}', '()') || chr(10) || coalesce(chunks, '{A.NO_EXCERPTS}') AS content FROM q LEFT JOIN a USING (qid)""")
def q39_rag_messages(spark, d):
    rows = _gathered(spark, d).select("qid", A.rag_messages("query", "chunks", "Answer from the excerpts.", "Q: {query}\n{chunks}").alias("m"))
    return rows.select("qid", F.col("m")[0]["content"].alias("system"), F.col("m")[1]["content"].alias("content"))


@query(f"WITH {_CHUNKS} SELECT trim(regexp_replace(translate(source || '. ' || doc_id, ' /', '__'), '_+', '_', 'g'), '_') || '_' || chunk_index AS id, chunk_text AS text, doc_id AS document_id FROM c JOIN documents USING (doc_id)")
def q40_build_corpus(spark, d):
    """Decisions that each occur three times, shortened twice, to a corpus of chunks of the whole ones."""
    docs = _t(spark, d, "documents")
    none, lists = F.lit(None).cast("string"), F.array().cast("array<string>")
    whole = docs.select(
        F.col("doc_id").alias("result_id"), F.concat("source", F.lit(". "), "doc_id").alias("case_reference"), *[none.alias(n) for n in ("ecli", "judge_rapporteur", "petitioner", "popular_name", "decision_date", "announcement_date", "filing_date", "publication_date")],
        lists.alias("related_regulations"), *[none.alias(n) for n in ("decision_form", "importance", "verdict")], lists.alias("topics_and_keywords"), none.alias("detail_url"), none.alias("text_url"), F.col("text").alias("full_text"), (F.col("doc_id") * 3 + 1).alias("pos"),
    )
    shorter = whole.where("length(full_text) > 0").withColumns({"full_text": F.expr("substring(full_text, 1, length(full_text) - 1)"), "pos": F.col("pos") - 1})
    empty = whole.withColumns({"full_text": none, "pos": F.col("pos") + 1})
    return C.build_corpus(whole.unionByName(shorter).unionByName(empty)).select("id", "text", "document_id")


@query(f"WITH {_KEYWORD}, a AS (SELECT qid, count(*) AS n, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY rank) FILTER (rank <= 3) AS ids FROM kt GROUP BY qid) SELECT q.qid, CASE WHEN coalesce(n, 0) < 2 THEN CASE WHEN coalesce(n, 0) = 0 THEN '{A.NO_RESULTS}' ELSE '{A.SUMMARY}' || q.query END ELSE 'Mock odpověď na: ' || q.query || ' ' || ids END AS answer FROM q LEFT JOIN a USING (qid)")
def q41_hybrid_answer(spark, d):
    """A model answers where there are two chunks or more, the rule elsewhere."""
    model = lambda q, c: F.concat(A.mock_llm(q, c)["answer"], F.lit(" "), F.array_join(A.mock_llm(q, c)["sources"], ","))
    return A.hybrid_answer(_gathered(spark, d), model).select("qid", "answer")


@query("SELECT page_id, 'v' || page_id || '&' AS state, 'last' AS again, '__EVENTVALIDATION' AS lacks, length(url) AS n FROM pages")
def q42_hidden_fields(spark, d):
    """Forms with hidden fields, escaped, repeated, and one of the required ones missing."""
    form = F.concat(F.lit('<form><input type="hidden" name="__VIEWSTATE" value="v'), "page_id", F.lit('&amp;"/><input type="hidden" name="a" value="first"><input type="text" name="t" value="no"><INPUT TYPE="hidden" name="a" value="last"><input type="hidden" name="__VIEWSTATEGENERATOR" value="'), "url", F.lit('"></form>'))
    rows = _t(spark, d, "pages").select("page_id", H.hidden_fields(form).alias("f"))
    lacks = F.array_join(H.missing_fields("f", H.FORM_FIELDS), ",")
    return rows.select("page_id", F.col("f")["__VIEWSTATE"].alias("state"), F.col("f")["a"].alias("again"), lacks.alias("lacks"), F.length(F.col("f")["__VIEWSTATEGENERATOR"]).cast("long").alias("n"))


@query("SELECT item_id AS qid, CASE WHEN item_id % 3 = 0 THEN 'kept' ELSE 'made ' || length(text) END AS answer, CASE WHEN item_id % 3 = 0 THEN 0 ELSE 1 END AS added FROM benchmark")
def q43_cache(spark, d):
    """A cache that has every third answer, has let every third expire, and lacks the others."""
    asked, now = _asked(spark, d), F.lit("2026-01-02 00:00:00").cast("timestamp")
    none = F.array().cast("array<string>")
    expires = F.when(F.col("qid") % 3 == 0, F.expr("timestamp'2026-01-03 00:00:00'")).otherwise(F.expr("timestamp'2026-01-01 00:00:00'"))
    cache = asked.where("qid % 3 < 2").select(I.cache_key("query", "v1").alias("key"), F.lit("kept").alias("answer"), none.alias("sources"), none.alias("plan_steps"), expires.alias("expires_at"))
    made = lambda q: q.select("qid", F.concat(F.lit("made "), F.length("query")).alias("answer"), none.alias("sources"), none.alias("plan_steps"))
    found, new = E.cached(asked, cache, made, "v1", now, 3600)
    late = new.where(F.col("expires_at") == F.expr("timestamp'2026-01-02 01:00:00'")).select("key", F.lit(1).alias("added"))
    keys = asked.select("qid", I.cache_key("query", "v1").alias("key")).join(late, "key", "left").select("qid", F.coalesce("added", F.lit(0)).alias("added"))
    return found.select("qid", "answer").join(keys, "qid")


@query("SELECT CAST(doc_id * 10 + i AS BIGINT) AS result_id, source || ' ' || doc_id || '/' || i AS case_reference, 'text ' || doc_id AS full_text FROM documents, (VALUES (0), (1)) v(i) WHERE doc_id BETWEEN 5 AND 60 ORDER BY doc_id, i LIMIT 90")
def q44_collect_results(spark, d):
    """The first 90 results of pages 5 to 60, cut before their texts are joined; each page comes twice."""
    docs = _t(spark, d, "documents")
    result = lambda i: F.struct(*[
        {"result_id": (F.col("doc_id") * 10 + i), "case_reference": F.concat("source", F.lit(" "), "doc_id", F.lit(f"/{i}")), "text_url": F.concat(F.lit("u"), "doc_id")}.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name)
        for f in _schema(DECISION_FIELDS).fields
    ])
    pages = docs.select(F.col("doc_id").cast("int").alias("page_index"), F.array(result(0), result(1)).alias("results"))
    texts = docs.select(F.concat(F.lit("u"), "doc_id").alias("text_url"), F.concat(F.lit("text "), "doc_id").alias("full_text"))
    found = S.collect_results(pages.unionByName(pages), texts, 5, 60, 90, skip_duplicates=True)
    return found.select("result_id", "case_reference", "full_text")


@query("SELECT doc_id AS result_id, text AS full_text, source AS case_reference, 1 AS lists FROM documents")
def q45_batch_files(spark, d):
    """Decisions as files of JSON arrays, beside a manifest, read again."""
    root = f"{shared(spark)}/batches-{uuid.uuid4().hex}"
    item = F.to_json(F.struct(F.col("doc_id").alias("result_id"), F.col("source").alias("case_reference"), F.col("text").alias("full_text"), F.lit(None).cast("array<string>").alias("topics_and_keywords")))
    arrays = _t(spark, d, "documents").groupBy(F.floor(F.col("doc_id") / 100).alias("n")).agg(F.concat(F.lit("["), F.array_join(F.collect_list(item), ",\n"), F.lit("]")).alias("value"))
    arrays.write.partitionBy("n").text(f"{root}/files")  # one row and so one file each
    rows = S.read_decisions(spark, f"{root}/files")
    return rows.select("result_id", "full_text", "case_reference", F.when(F.size("topics_and_keywords") == 0, 1).otherwise(0).alias("lists"))


@query(f"WITH {_CHUNKS}, p AS (SELECT {_UUID} AS id, doc_id FROM c) SELECT count(*) + count(*) FILTER (doc_id % 3 = 0) AS before, count(*) AS after, count(*) AS ids, true AS stable, false AS stable_before, 'b' AS target FROM p")
def q46_collections(spark, d):
    """A collection with legacy copies is reported on, repaired into one like it, and its alias swapped."""
    held = P.Collections(spark, f"{shared(spark)}/collections-{uuid.uuid4().hex}")
    held.create("a", 10)
    points = P.make_points(_chunks(spark, d)).withColumn("vector", A.mock_embed("id"))
    legacy = points.where(F.col("payload.document_id") % 3 == 0).withColumn("id", F.concat(F.lit("legacy-"), "id"))
    points.unionByName(legacy).write.mode("overwrite").parquet(held.path("a"))
    held.swap_alias("live", "a")
    before = P.supports_stable_sync(held.read("live")).select(F.col("stable").alias("stable_before"))
    found = held.repair("live", "b")
    held.swap_alias("live", "b")
    after = P.duplicate_report(held.read("live")).select(F.col("total_points").alias("after"), F.col("unique_ids").alias("ids"))
    one = after.crossJoin(P.supports_stable_sync(P.require_vectors(held.read("live"), 10))).crossJoin(before)  # of one row each
    return one.select(F.lit(found["total_points"]).cast("long").alias("before"), "after", "ids", "stable", "stable_before", F.lit(held.aliases()["live"]).alias("target"))


@query(f"WITH {_CHUNKS} SELECT doc_id || '_' || chunk_index AS id, CASE WHEN doc_id % 2 = 0 THEN 'again' ELSE lang END AS judge FROM c JOIN documents USING (doc_id)")
def q47_stream_upsert(spark, d):
    """Two batches of a stream: all chunks, then those of even documents with another judge."""
    from ..schemas import CHUNK_FIELDS
    from ..streaming.ingest import PointTable, ingest_stream

    root = f"{shared(spark)}/stream-{uuid.uuid4().hex}"
    table, chunks = PointTable(spark, f"{root}/points"), _chunks(spark, d)
    for n, rows in enumerate((chunks, chunks.where("document_id % 2 = 0").withColumn("judge", F.lit("again")))):
        rows.write.parquet(f"{root}/in/{n}")
        ingest_stream(spark.readStream.schema(CHUNK_FIELDS).parquet(f"{root}/in/*"), table, A.mock_embed, f"{root}/check").awaitTermination()
    return table.read().select(F.col("payload.original_id").alias("id"), "payload.judge")


@query(f"""WITH q AS (SELECT item_id AS qid, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '')[-1] || ' {A.EXPANSION}' AS q FROM benchmark)
SELECT qid, q AS rewritten, CAST(i AS INT) AS step_no, CASE i WHEN 0 THEN q || '{A.PLAN_STEPS[0][0]}' WHEN 1 THEN '{A.PLAN_STEPS[1][0]}' ELSE '{A.PLAN_STEPS[2][0]}' END AS step, CASE i WHEN 0 THEN '{A.PLAN_STEPS[0][1]}' WHEN 1 THEN '{A.PLAN_STEPS[1][1]}' ELSE '{A.PLAN_STEPS[2][1]}' END AS reason, 'fallback — empty plan' AS other FROM q, (VALUES (0), (1), (2)) v(i)""")
def q48_rewrite_and_plan(spark, d):
    """The prompt's last line before its mark is rewritten and planned; a reply without steps gives one."""
    rows = _asked(spark, d).select("qid", A.rewrite("query", A.prompted()).alias("rewritten"))
    other = A.plan("rewritten", A.mock_text_model)[0]["reason"]
    rows = rows.withColumns({"other": other, "steps": A.plan("rewritten")})
    steps = rows.select("qid", "rewritten", "other", F.posexplode("steps").alias("step_no", "s"))
    return steps.select("qid", "rewritten", "step_no", F.col("s.query").alias("step"), "s.reason", "other")


_REWRITTEN = f"SELECT item_id AS qid, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '')[-1] || ' {A.EXPANSION}' AS query FROM benchmark"


@query(f"""WITH {_hybrid_sql(_REWRITTEN, 5)}, a AS (SELECT qid, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY rank) AS cases, count(*) AS n FROM fu GROUP BY qid)
SELECT item_id AS qid, CASE WHEN n > 0 THEN '{A.SUMMARY}' || text ELSE '{A.NO_RESULTS}' END AS summary, coalesce(cases, '') AS cases, CASE WHEN coalesce(n, 0) = 0 THEN 'no_results' WHEN n >= 3 THEN 'llm_summary' ELSE 'direct_answer' END AS mode FROM benchmark LEFT JOIN a ON qid = item_id""")
def q49_engine_search(spark, d):
    """Hybrid search with a rule-based answer; the answer has the query as it was asked, the search the rewritten one."""
    out = E.search(_points(spark, d).withColumn("vector", letter_vector("text")), _asked(spark, d), 5, embed=letter_vector, rewriter=A.prompted())
    return out.select("qid", "summary", F.array_join("top_cases", ",").alias("cases"), "strategy.mode")


@query("SELECT page_id // 50 AS batch, substring(sha256(string_agg(url || '|' || length(html) || '|' || page_id, chr(10) ORDER BY url || '|' || length(html) || '|' || page_id)), 1, 16) AS version FROM pages GROUP BY 1")
def q50_corpus_version(spark, d):
    """The versions of corpora of fifty files each."""
    files = _t(spark, d, "pages").select(F.floor(F.col("page_id") / 50).alias("batch"), F.col("url").alias("name"), F.length("html").alias("size"), F.col("page_id").alias("modified"))
    return C.corpus_version(files, "batch")


@query("SELECT doc_id, lang || ',' || source || ' x,' || lang || ',' || lang AS lines, lang || ',' || source || ' x,' || lang AS collapsed, 'I_' || doc_id || '-' || lang AS ids FROM documents")
def q51_cells(spark, d):
    """Lines of a cell without blanks and dashes, repeats collapsed, and ids of links."""
    rows = _t(spark, d, "documents")
    cell = F.concat("lang", F.lit("\r\n (-) \n "), "source", F.lit("   x\n\n"), "lang", F.lit("\n "), "lang")
    urls = F.array(F.concat(F.lit("https://example.org/GetText.aspx?sz=I_"), "doc_id", F.lit("-"), "lang", F.lit("&a=b")), F.lit(None), F.lit("https://example.org/none"))
    return rows.select("doc_id", F.array_join(X.cell_lines(cell), ",").alias("lines"), F.array_join(X.collapse_repeats(X.cell_lines(cell)), ",").alias("collapsed"), F.array_join(H.document_ids(urls), ",").alias("ids"))


@query("SELECT conv_id, turn, text AS block, 'Mock odpověď na: ' || text AS answer, 0.5::DOUBLE AS confidence FROM conversations WHERE role = 'user' AND length(text) > 0")
def q52_model_replies(spark, d):
    """The first text block of a reply, and the deterministic model."""
    rows = _t(spark, d, "conversations").where("role = 'user' and length(text) > 0")
    blocks = F.array(F.struct(F.lit("image").alias("type"), F.lit("no").alias("text")), F.struct(F.lit("text").alias("type"), F.col("text").alias("text")), F.struct(F.lit("text").alias("type"), F.lit("later").alias("text")))
    reply = F.to_json(F.struct(blocks.alias("content")))
    made = A.mock_llm("text", F.array(F.struct(F.lit("c").alias("id"))))
    return rows.select("conv_id", "turn", A.first_text_block(reply).alias("block"), made["answer"].alias("answer"), made["confidence"].alias("confidence"))


@query(f"WITH {_CHUNKS} SELECT doc_id || '_' || chunk_index AS id, chunk_text AS text, source || ' ' || doc_id AS case_reference, chunk_index FROM c JOIN documents USING (doc_id)")
def q53_corpus_or_seed(spark, d):
    """The corpus, which is there, so that the seed does not stand in for it."""
    return S.or_seed(_chunks(spark, d)).select("id", "text", "case_reference", "chunk_index")


@query("SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY ALL")
def q54_stream_first_seen(spark, d):
    """The first event of each user and type, from a stream that keeps the keys that it has seen."""
    from ..streaming.keyed import first_rows

    root = f"{shared(spark)}/first-{uuid.uuid4().hex}"
    events = spark.readStream.schema(_t(spark, d, "events").schema).option("pathGlobFilter", "events.parquet").parquet(d)
    keyed = events.select("user_id", "event_type", "event_id", F.concat_ws("|", "user_id", "event_type").alias("key"))
    stream = first_rows(keyed, "key", "event_id").writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/check")
    stream.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(keyed.schema).parquet(f"{root}/out").drop("key")


@query("WITH t AS (SELECT doc_id, md5(text) AS k FROM documents), f AS (SELECT k, min(doc_id) FILTER (doc_id % 2 = 0) AS early, min(doc_id) AS any_id FROM t GROUP BY k) SELECT coalesce(early, any_id) AS doc_id, k AS ecli FROM f")
def q58_crawl_stream(spark, d):
    """Decisions that come in two batches, copies of one text with one ecli: each is kept where it came first."""
    from ..streaming.keyed import first_rows

    root = f"{shared(spark)}/crawl-{uuid.uuid4().hex}"
    docs = _t(spark, d, "documents").select("doc_id", F.md5("text").alias("ecli"), F.lit(None).cast("string").alias("case_reference"))
    for n in (0, 1):
        docs.where(F.col("doc_id") % 2 == n).write.parquet(f"{root}/in/{n}")
        rows = spark.readStream.schema(docs.schema).parquet(f"{root}/in/*").withColumn("identity", S.decision_identity())
        stream = first_rows(rows, "identity", "doc_id").writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/check")
        stream.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(docs.schema).parquet(f"{root}/out").select("doc_id", "ecli")


@query(r"WITH u AS (SELECT trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS k FROM conversations WHERE role = 'user') SELECT k AS key, count(*) AS n, 1 AS asked, 'answer to ' || length(k) AS answer FROM u GROUP BY k")
def q59_answer_stream(spark, d):
    """User turns as a stream of queries: each distinct one is answered once, whichever batch it comes in."""
    from ..streaming.keyed import ANSWERS, answered

    root = f"{shared(spark)}/answers-{uuid.uuid4().hex}"
    turns = _t(spark, d, "conversations").where("role = 'user'").select(F.col("conv_id").alias("qid"), X.normalise_query("text").alias("query"), X.normalise_query("text").alias("key"), "turn")
    for n in (0, 1):
        turns.where(F.col("turn") % 2 == n).write.parquet(f"{root}/in/{n}")
        made = answered(spark.readStream.schema(turns.schema).parquet(f"{root}/in/*"), lambda q: f"answer to {len(q)}")
        stream = made.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/check")
        stream.trigger(availableNow=True).start().awaitTermination()
    out = spark.read.schema(ANSWERS).parquet(f"{root}/out")
    return out.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.count_if("asked").cast("int").alias("asked"), F.max("answer").alias("answer"))


@query(SQL["q02_keyword_topk"])
def q55_keyword_index(spark, d):
    """Keyword search from the index: built over shortened texts and some that go again, then updated."""
    from ..operators.keyword_index import KeywordIndex

    corpus = _corpus(spark, d)
    first = corpus.withColumn("text", F.when(F.col("pos") % 3 == 0, F.substring("text", 1, 40)).otherwise(F.col("text")))
    extra = corpus.where("pos % 5 = 0").withColumns({"id": F.concat(F.lit("x"), "id"), "pos": F.col("pos") + (1 << 40)})
    index = KeywordIndex(spark, f"{shared(spark)}/index-{uuid.uuid4().hex}").build(first.unionByName(extra))
    index.update(corpus.where("pos % 3 = 0"), extra.select("id"))
    return index.search(_asked(spark, d), 10).select("qid", "rank", "id", F.round("score", 6).alias("score"))


@query(f"""WITH {_hybrid_sql("SELECT item_id AS qid, text AS query FROM benchmark", 10, "documents")} SELECT qid, CAST(rank AS INT) AS rank, CAST(doc_id AS VARCHAR) AS id, round(score, 6) AS score FROM dn""")
def q56_cells(spark, d):
    """The nearest documents from a table that is laid out by cells and then partly changed; as many cells are
    searched as there are, so that the result is the exact one."""
    from ..operators.point_table import PointTable

    chunks = lambda rows: rows.select(F.col("doc_id").cast("string").alias("id"), "text", F.lit(None).cast("string").alias("case_reference"), F.lit(None).cast("string").alias("ecli"), F.lit(None).cast("string").alias("decision_date"), F.lit(None).cast("string").alias("judge"), F.lit(None).cast("string").alias("text_url"), F.lit(0).alias("chunk_index"), F.col("doc_id").alias("document_id"))
    docs = _t(spark, d, "documents")
    table = PointTable(spark, f"{shared(spark)}/cells-{uuid.uuid4().hex}")
    table.upsert(chunks(docs.withColumn("text", F.when(F.col("doc_id") % 4 == 0, F.reverse(F.substring("text", 1, 200))).otherwise(F.col("text")))), letter_vector)
    table.fit(16)
    table.upsert(chunks(docs.where("doc_id % 4 = 0")), letter_vector)
    asked = _asked(spark, d).select("qid", letter_vector(X.normalise_query("query")).alias("vector"))
    return table.near(asked, 10, 16).select("qid", "rank", "id", F.round("score", 6).alias("score"))


def _saved_site(spark, docs: DataFrame) -> str:
    """A site of result pages, saved by tasks with twenty documents a page; its rows leave out the end tags."""
    numbered = C.numbered(docs.select("doc_id"), "doc_id").withColumn("page", F.floor(F.col("n") / 20).cast("int"))
    row = F.concat(
        F.lit('<tr class="resultData0"><td><input id="sel_'), "doc_id", F.lit('"><td><a href="ResultDetail.aspx?id='), "doc_id", F.lit('">c '), "doc_id", F.lit("/24</a>"),
        F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("<br>ECLI:"), "doc_id")).otherwise(F.lit("")), F.lit("<td>" * 8 + '<tr><td><a href="/Search/GetText.aspx?sz='), "doc_id", F.lit('">t</a>'),
    )
    rows = numbered.groupBy("page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", row.alias("h")))), lambda x: x["h"]), "").alias("rows"), F.min("n").alias("first"), F.max("n").alias("last"))  # 20 rows a group
    total = docs.count()
    head = F.concat(F.lit('<table><tr class="resultHeaderCount"><td>Výsledky '), F.col("first") + 1, F.lit(" - "), F.col("last") + 1, F.lit(f' z celkem {total} <input name="pageNumber" value="'), F.col("page") + 1, F.lit(f'"><a href="x">{-(-total // 20)}</a></table><table><tr id="headerRowFirst"><td>h'))
    root = f"{shared(spark)}/site-{uuid.uuid4().hex}".removeprefix("file://").removeprefix("file:")

    def save(batches):
        for b in batches:
            for page, text in zip(b["page"], b["value"], strict=True):
                folder = os.path.join(root, f"page={page}")
                os.makedirs(folder, exist_ok=True)
                made = os.path.join(folder, f".{uuid.uuid4().hex}")
                with open(made, "w", encoding="utf-8") as out:
                    out.write(text + "\n")
                os.replace(made, os.path.join(folder, "part-0.txt"))  # whole, also when a task runs again
            yield b[["page"]]

    # Spark's writer starts processes to set the rights of each of the files and folders.
    rows.select("page", F.concat(head, "rows", F.lit("</table>")).alias("value")).mapInPandas(save, "page int").write.format("noop").mode("overwrite").save()
    return root


@query("SELECT doc_id AS result_id, 'c ' || doc_id || '/24' AS case_reference, CASE WHEN doc_id % 2 = 0 THEN 'ECLI:' || doc_id END AS ecli, 'https://example.org/Search/GetText.aspx?sz=' || doc_id AS text_url, CAST((row_number() OVER (ORDER BY doc_id) - 1) // 20 AS INT) AS page_index, text AS full_text FROM documents WHERE length(trim(text)) > 0")
def q57_saved_site(spark, d):
    """A saved site is crawled by the page source, parsed and joined with its texts."""
    from ..sources.pages import result_pages

    docs = _t(spark, d, "documents").where("length(trim(text)) > 0")
    root = _saved_site(spark, docs)
    pages = result_pages(spark, folder=root, form="", query="q", pause="0")
    texts = docs.select(F.concat(F.lit("https://example.org/Search/GetText.aspx?sz="), "doc_id").alias("text_url"), F.col("text").alias("full_text"))
    found = S.collect_results(H.parse_result_pages(pages, "https://example.org/Search/"), texts)
    return found.select("result_id", "case_reference", "ecli", "text_url", F.col("pos.page_index").alias("page_index"), "full_text")


@query(f"WITH {_STEPS} SELECT qid // 5 AS qid, count(*) AS total_chunks FROM kt GROUP BY 1")
def q60_step_totals(spark, d):
    """How many chunks the steps of each query's plan found, repeated ones counted."""
    part = lambda n: F.split_part("query", F.lit("."), F.lit(n + 1))
    steps = _asked(spark, d).select("qid", F.posexplode(F.array(*[part(n) for n in range(3)])).alias("step_no", "query"))
    hits = R.keyword_search(_corpus(spark, d), steps.select(F.struct("qid", "step_no").alias("qid"), "query"), 5)
    return A.step_totals(hits.select("qid.qid", "qid.step_no", "id"))


@query("SELECT doc_id AS result_id, 'c ' || doc_id || '/24' AS case_reference, CASE WHEN doc_id % 2 = 0 THEN 'ECLI:' || doc_id END AS ecli, 'https://example.org/Search/GetText.aspx?sz=' || doc_id AS text_url FROM documents WHERE length(trim(text)) > 0 ORDER BY doc_id LIMIT greatest((SELECT count(*) FROM documents) // 2, 1)")
def q61_scrape_job(spark, d):
    """The scrape job over a saved site, stopped at half of its decisions; its JSON file read again."""
    from .. import jobs

    docs = _t(spark, d, "documents").where("length(trim(text)) > 0")
    root = _saved_site(spark, docs)
    wanted = max(_t(spark, d, "documents").count() // 2, 1)
    options = {"folder": root, "form": "", "pause": "0"}
    args = jobs.parser().parse_args(["scrape", "--query", "q", "--max-results", str(wanted), "--fetch-full-text", "no", "--batch-sleep-seconds", "0", "--base-url", "https://example.org/Search/", "--output-path", f"{root}/found.json", *[x for k, v in options.items() for x in ("--option", f"{k}={v}")]])
    jobs.scrape(spark, args)
    return S.read_decisions(spark, f"file://{root}/found.json").select("result_id", "case_reference", "ecli", "text_url")


@query(f"""WITH {_hybrid_sql("SELECT item_id AS qid, text AS query FROM benchmark", 5)} SELECT item_id AS qid, '' AS answer, '' AS sources, text AS plan_steps, coalesce((SELECT count(*) FROM fu WHERE fu.qid = item_id), 0) AS found FROM benchmark""")
def q62_engine_fallbacks(spark, d):
    """Models that fail on their rows: the query as it is, a plan of one step, and an empty answer; the search
    that this leaves finds what it finds."""
    @F.pandas_udf("string")
    def fails(text: pd.Series) -> pd.Series:
        raise OSError("no model")

    points = _points(spark, d).withColumn("vector", letter_vector("text"))
    out = E.run(points, _asked(spark, d), 5, rewriter=fails, planner=fails, embed=letter_vector, model=lambda q, c: fails(q))
    one = _asked(spark, d).withColumn("steps", A.single_step("query"))
    found = A.step_totals(E.step_hits(points, one, 5, letter_vector)).select("qid", F.col("total_chunks").alias("found"))
    rows = out.join(found, "qid", "left")
    return rows.select("qid", "answer", F.array_join("sources", ",").alias("sources"), F.array_join("plan_steps", "|").alias("plan_steps"), F.coalesce("found", F.lit(0)).cast("long").alias("found"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL")
def x01_pricing(spark, d):
    rows = _t(spark, d, "lineitem").where("l_shipdate <= timestamp'1998-09-02'")
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("SELECT n_name, count(*) AS orders, round(sum(o_totalprice), 2) AS total, CAST(rank() OVER (ORDER BY count(*) DESC, n_name) AS INT) AS place FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY n_name")
def x02_orders_by_nation(spark, d):
    rows = _t(spark, d, "orders").join(_t(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey")).join(_t(spark, d, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    out = rows.groupBy("n_name").agg(F.count(F.lit(1)).alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    return out.withColumn("place", F.rank().over(Window.orderBy(F.desc("orders"), "n_name")))  # one row a nation
