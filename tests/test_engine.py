import re
import time
import random
import uuid
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.functions import html as H
from tessera.functions import ids as I
from tessera.functions import text as X
from tessera.operators import answering as A
from tessera.operators import corpus as C
from tessera.operators import points as P
from tessera.operators import retrieval as R
from tessera.plans import catalogue, engine
from tessera.schemas import CHUNK_FIELDS, DECISION_FIELDS, PAGE_FIELDS, _schema
from tessera.sources import files as S
from tessera.streaming.ingest import PointTable, first_seen, ingest_stream

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def one(spark, expression, **values):
    rows = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return rows.select(expression).first()[0]


@pytest.mark.parametrize("text,want", [("III.ÚS 255/26", "III.ÚS_255_26"), ("I/II/26", "I_II_26"), ("A  B//C", "A_B_C"), ("", "unknown"), (None, "unknown")])
def test_reference_prefix(spark, text, want):
    assert one(spark, X.reference_prefix("t"), t=text) == want


def test_query_processing(spark):
    got = one(spark, X.process_query("t"), t="  Únos DÍTĚTE  do Ruska do ruska ")
    assert got.normalized_query == "únos dítěte do ruska do ruska"
    assert got.keywords == ["únos", "dítěte", "ruska"]
    assert got.legal_concepts == ["mezinárodní únos dítěte", "rodičovská odpovědnost", "mezinárodní prvek"]


def test_cells(spark):
    assert one(spark, X.cell_lines("t"), t=" a  b \n\n(-)\nc") == ["a b", "c"]
    assert spark.range(1).select(X.collapse_repeats(F.array(*map(F.lit, "aabba")))).first()[0] == ["a", "b", "a"]
    assert one(spark, X.slugify("t"), t="Únos dítěte / 2") == "unos_ditete_2"


def test_ids(spark):
    assert one(spark, I.point_id("t"), t="III.ÚS_1") == str(uuid.uuid5(uuid.NAMESPACE_URL, "tessera-chunk:III.ÚS_1"))
    with pytest.raises(Exception, match="needs an id"):
        one(spark, I.point_id("t"), t="  ")
    assert one(spark, I.canonical_json({"b": F.col("t"), "a": F.lit(None).cast("int")}), t="x\x1f\"") == '{"a":null,"b":"x\\u001f\\""}'


@pytest.mark.parametrize("text,size,overlap,n", [("A" * 300, 100, 0, 3), ("x" * 100, 50, 10, 3), ("x" * 80, 50, 10, 2), ("x", 50, 10, 1), (" ", 50, 10, 0), (None, 50, 10, 0)])
def test_chunk(spark, text, size, overlap, n):
    rows = C.chunk(spark.createDataFrame([(text,)], "text string"), size=size, overlap=overlap).orderBy("chunk_index").collect()
    assert [r.chunk_text for r in rows] == [text[i * (size - overlap) : i * (size - overlap) + size] for i in range(n)]


def test_chunk_needs_a_step(spark):
    with pytest.raises(ValueError):
        C.chunk(spark.createDataFrame([("a",)], "text string"), size=10, overlap=10)


def _decisions(spark, rows):
    names = [f.split(" ")[0] for f in DECISION_FIELDS.split(", ")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], DECISION_FIELDS).withColumn("pos", F.monotonically_increasing_id())


def test_corpus_keeps_the_longer_text(spark):
    base = {"case_reference": "I.ÚS 1/24", "ecli": "E1", "text_url": "u", "related_regulations": [], "topics_and_keywords": []}
    rows = C.build_corpus(_decisions(spark, [base | {"full_text": "short"}, base | {"full_text": "x" * 80}]), 50, 10).collect()
    assert sorted(r.id for r in rows) == ["I.ÚS_1_24_0", "I.ÚS_1_24_1"]
    with pytest.raises(Exception, match="no identity"):
        C.dedup_decisions(_decisions(spark, [{"full_text": "a"}])).collect()


def _chunks(spark, *rows):
    return spark.createDataFrame([(i, t, "ref", None, "2026-01-15", "J", None, n, 7) for n, (i, t) in enumerate(rows)], CHUNK_FIELDS)


def test_ingest_is_idempotent(spark):
    first = P.make_points(_chunks(spark, ("a", "t1"), ("b", "t2")))
    empty = first.where("false").withColumn("vector", A.mock_embed("id"))
    stored = P.merge(empty, P.classify(first, empty), A.mock_embed)
    again = P.make_points(_chunks(spark, ("a", "t1"), ("b", "new"), ("c", "t3")))
    assert P.ingest_stats(P.classify(again, stored)).first() == (3, 1, 1, 1)
    assert P.merge(stored, P.classify(again, stored), A.mock_embed).count() == 3
    assert P.supports_stable_sync(stored).first()[0]


def test_duplicates_and_repair(spark):
    points = P.make_points(_chunks(spark, ("a", "t1"), ("b", "t2"))).withColumn("vector", A.mock_embed("id"))
    both = points.unionByName(points.where("payload.original_id = 'a'").withColumn("id", F.lit("1")))
    assert P.duplicate_report(both).first() == (3, 2, 1, 1)
    assert sorted(r.id for r in P.repair(both).collect()) == sorted(r.id for r in points.collect())


def test_keyword_scores_and_ties(spark):
    corpus = spark.createDataFrame([("a", "Únos dítěte", 0), ("b", "dítěte únos", 1), ("c", "jiné", 2)], "id string, text string, pos long")
    asked = spark.createDataFrame([(1, "únos únos dítěte do"), (2, "xx")], "qid long, query string")
    got = R.keyword_search(corpus, asked, 2).orderBy("rank").collect()
    assert [(r.id, round(r.score, 6)) for r in got] == [("a", 0.6), ("b", 0.6)]
    again = R.rerank(R.keyword_search(corpus, asked, 2), asked, 1).collect()
    assert [(r.id, round(r.score, 6)) for r in again] == [("a", 0.75)]


def test_fusion_keeps_the_higher_score(spark):
    row = lambda i, s, src, rank: (1, i, "t", s, src, 0, rank)
    schema = "qid long, id string, text string, score double, source string, pos long, rank int"
    dense = spark.createDataFrame([row("a", 0.5, "dense", 1), row("b", 0.4, "dense", 2)], schema)
    keyword = spark.createDataFrame([row("b", 0.5, "keyword", 1), row("a", 0.5, "keyword", 2)], schema)
    assert [(r.id, r.source) for r in R.fuse(dense, keyword).orderBy("rank").collect()] == [("a", "dense"), ("b", "keyword")]


def test_cross_encoder_falls_back(spark):
    hits = spark.createDataFrame([(1, "a", "x", 0.5, "dense", 0, 1), (1, "b", "yy", 0.4, "dense", 1, 2)], "qid long, id string, text string, score double, source string, pos long, rank int")
    asked = spark.createDataFrame([(1, "q")], "qid long, query string")
    assert [r.id for r in R.cross_encoder_rerank(hits, asked, lambda p: [len(t) for _, t in p]).orderBy("rank").collect()] == ["b", "a"]
    assert [r.id for r in R.cross_encoder_rerank(hits, asked, lambda p: 1 / 0).orderBy("rank").collect()] == ["a", "b"]


def test_source_filter(spark):
    tags = spark.range(1).select(R.source_tags(F.lit("corpus"), F.lit("Nejvyšší správní soud"))).first()[0]
    assert tags == ["corpus", "constitutional", "nejvyšší správní soud", "administrative"]
    ok = lambda *want: spark.range(1).select(R.matches_sources(F.array(*map(F.lit, tags)), F.array(*map(F.lit, want)).cast("array<string>"))).first()[0]
    assert ok() and ok("Constitutional ") and not ok("supreme")


def test_plans_and_strategy(spark):
    text = "1. a | b | c\nno pipe\n\n2.  | x\nq | r\n" + "\n".join(f"{i}. s{i} | t" for i in range(3, 9))
    assert [(s.query, s.reason) for s in one(spark, A.parse_plan("t"), t=text)] == [("a", "b | c"), ("q", "r"), ("s3", "t"), ("s4", "t"), ("s5", "t")]
    assert one(spark, A.plan("t", lambda q: F.lit("nothing")), t="q")[0].reason == "fallback — empty plan"
    assert [spark.range(1).select(A.strategy(F.lit(n))).first()[0].mode for n in range(4)] == ["no_results", "direct_answer", "direct_answer", "llm_summary"]


@pytest.mark.parametrize("text,want", [('{"answer":"a","confidence":5.0}', ("a", [], 1.0)), ('{"answer":"a","confidence":-1}', ("a", [], 0.0)), ("plain", ("plain", ["x"], 0.0)), ("[1]", ("[1]", ["x"], 0.0)), ("", ("", [], 0.0)), ('```\n{"answer":"b","sources":[1]}\n```', ("b", ["1"], 0.0))])
def test_reply(text, want):
    got = A.parse_reply(text, ["x"])
    assert (got["answer"], got["sources"], got["confidence"]) == want


PAGE = """<form><input type="hidden" name="a" value="x&amp;y"></form><table><tr class="resultHeaderCount"><td>Výsledky 11 - 12 z celkem 40<input name="pageNumber" value="2"><a href="?page=2">3</a></td></tr></table>
<table><tr id="headerRowFirst"><td>h</td></tr>
<tr class="resultData0"><td><input id="sel_7"></td><td><a href="ResultDetail.aspx?id=7">I.ÚS 1/24</a><br>
ECLI:CZ:1<br>
Novák</td><td>P<br>
Name</td><td>1. 1. 2024<br>
(-)</td><td>r1</td><td>Nález<br>
2</td><td>zamítnuto</td><td></td><td>t1</td><td></td></tr>
<tr><td><a href="/Search/GetText.aspx?sz=1-1-24">text</a></td></tr></table>"""


def test_result_page(spark, tmp_path):
    page = H.parse_result_page(PAGE, "q", "https://example.org/Search/")
    d = page["results"][0]
    assert (page["page_number"], page["total_pages"], page["total_results"], page["page_size"]) == (2, 3, 40, 1)
    assert (d["result_id"], d["case_reference"], d["ecli"], d["judge_rapporteur"], d["petitioner"], d["popular_name"], d["related_regulations"]) == (7, "I.ÚS 1/24", "ECLI:CZ:1", "Novák", "P", "Name", ["r1"])
    assert d["text_url"] == "https://example.org/Search/GetText.aspx?sz=1-1-24"
    with pytest.raises(RuntimeError):
        H.parse_result_page("<p></p>")
    pages = H.parse_result_pages(spark.createDataFrame([(PAGE, "q")], "html string, query string"), "https://example.org/Search/")
    texts = spark.createDataFrame([(d["text_url"], "full")], "text_url string, full_text string")
    assert S.collect_results(pages, texts).first().full_text == "full"
    with pytest.raises(Exception, match="duplicate decision: ECLI:CZ:1"):
        S.collect_results(pages.union(pages)).collect()
    assert S.collect_results(pages.union(pages), skip_duplicates=True).count() == 1
    assert one(spark, H.hidden_fields("t"), t=PAGE) == {"a": "x&y"}


def test_files(spark, tmp_path):
    (tmp_path / "b.json").write_text('\n [\n  {"result_id": 1,\n "case_reference": "é"},\n {"result_id": 2}]\n')
    (tmp_path / "manifest.json").write_text("{}")
    rows = S.read_decisions(spark, f"{tmp_path}/*.json").orderBy("pos").collect()
    assert [(r.result_id, r.case_reference, r.topics_and_keywords) for r in rows] == [(1, "é", []), (2, None, [])]
    (tmp_path / "c.json").write_text('{"a": 1}')
    with pytest.raises(Exception, match="not a JSON array"):
        S.read_decisions(spark, f"{tmp_path}/c.json").collect()
    assert S.output_name("x", 5) == "results_x_5.json"


def test_html_forms_agree(spark):
    rows = spark.read.parquet(f"{D}/pages.parquet").select(H.plain_text("html").alias("a"), H.full_plain_text("html").alias("b")).collect()
    assert rows and all(r.a == r.b for r in rows)


def test_streaming_upsert(spark, tmp_path):
    table = PointTable(spark, str(tmp_path / "points"))
    for n, rows in enumerate([(("a", "t1"), ("b", "t2")), (("a", "t1"), ("b", "new"), ("c", "t3"))]):
        _chunks(spark, *rows).coalesce(1).write.parquet(str(tmp_path / f"in/{n}"))
        stream = spark.readStream.schema(CHUNK_FIELDS).parquet(str(tmp_path / "in/*"))
        ingest_stream(stream, table, A.mock_embed, str(tmp_path / "check")).awaitTermination()
    assert sorted((r.o, r.t) for r in table.read().select(F.col("payload.original_id").alias("o"), F.col("payload.text").alias("t")).collect()) == [("a", "t1"), ("b", "new"), ("c", "t3")]
    assert first_seen(spark.createDataFrame([(1,), (1,)], "k int"), "k").count() == 1


def test_cache(spark):
    asked = spark.createDataFrame([(1, "A  b"), (2, "c")], "qid long, query string")
    answer = lambda q: q.select("qid", F.lit("new").alias("answer"), F.array().cast("array<string>").alias("sources"), F.array().cast("array<string>").alias("plan_steps"))
    now = F.lit("2026-01-01").cast("timestamp")
    empty = spark.createDataFrame([], "key string, answer string, sources array<string>, plan_steps array<string>, expires_at timestamp")
    _, rows = engine.cached(asked.where("qid = 1"), empty, answer, "v", now)
    got, new = engine.cached(asked, rows.withColumn("answer", F.lit("old")), answer, "v", now)
    assert {r.qid: r.answer for r in got.collect()} == {1: "old", 2: "new"} and new.count() == 1


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    df = catalogue.QUERIES[name](spark, D)
    want = con.sql(catalogue.SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    mine = sorted(repr(tuple(r[c] for c in sorted(df.columns))) for r in df.collect())
    theirs = sorted(repr(tuple(dict(zip(want.columns, r, strict=True))[c] for c in sorted(want.columns))) for r in want.fetchall())
    assert mine == theirs


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


# Result pages


def page(rows="", header='Výsledky 11 - 12 z celkem 40 <input name="pageNumber" value="2"><a href="?p=3">3</a>'):
    head = f'<tr class="resultHeaderCount"><td>{header}</td></tr>' if header is not None else ""
    return f'<a href="#">2024</a><table>{head}</table><table><tr id="headerRowFirst"><td>h</td></tr>{rows}</table>'


def test_cells_of_a_result_page():
    row = """<tr class="resultData1"><td><input name="other" id="sel_7"></td><td><a href="d?id=7">A</a><br>J</td><td>A<br>A<br>Pop</td><td></td>
    <td>reg1<br>reg1</td><td>Nález<br>2</td><td>v <i>w</i></td><td></td><td>t<br>t</td><td><script>x</script></td></tr>
    <tr><td><a href='#' onclick="open(&quot;https://example.org:443/Search/GetText.aspx?sz=1-1_24%20x.y&quot;)">t</a></td></tr>"""
    got = H.parse_result_page(page(row))
    d = got["results"][0]
    assert (got["page_number"], got["total_pages"], got["page_index"], got["page_size"]) == (2, 3, 1, 1)
    assert (d["result_id"], d["petitioner"], d["popular_name"], d["related_regulations"], d["decision_form"], d["importance"]) == (7, "A", "Pop", ["reg1", "reg1"], "Nález", "2")
    assert (d["judge_rapporteur"], d["verdict"], d["topics_and_keywords"], d["text_url"]) == ("J", "v w", ["t", "t"], "https://example.org:443/Search/GetText.aspx?sz=1-1_24%20x.y")


@pytest.mark.parametrize("html,message", [
    ("<p></p>", "no header"), (page(header="nothing"), "no result counts"), (page(header="Výsledky 1 - 2 z celkem 3"), "no page number"),
    ('<table><tr class="resultHeaderCount"><td>Výsledky 1 - 2 z celkem 3<input name="pageNumber" value="1"></td></tr></table>', "no result table"),
])
def test_errors_of_a_result_page(html, message):
    with pytest.raises(RuntimeError, match=message):
        H.parse_result_page(html)


FORM = "".join(f'<input type="hidden" name="{n}" value="v&amp;">' for n in ("__VIEWSTATE", "__EVENTVALIDATION", "__VIEWSTATEGENERATOR"))


def _site(folder, n=3):
    row = lambda p: f'<tr class="resultData0"><td><input id="sel_{p}"></td><td><a href="ResultDetail.aspx?id={p}">I.ÚS {p}/24</a></td><td></td><td></td><td></td><td></td><td></td><td></td><td></td><td></td></tr><tr><td><a href="https://example.org/Search/GetText.aspx?sz={p}">t</a></td></tr>'
    (folder / "form.html").write_text(FORM)
    for p in range(n):
        (folder / f"page_{p}.html").write_text(page(row(p), f'Výsledky {p + 1} - {p + 1} z celkem {n} <input name="pageNumber" value="{p + 1}"><a href="x">{n}</a>'))
        (folder / f"GetText_aspx_sz_{p}.html").write_text(f"<p>text {p}</p>")


def _counting(folder):
    """A client of a saved site that writes down what it is asked for."""
    from tessera.sources.client import FolderClient, SearchSite

    class Counting(FolderClient):
        def _read(self, name, url):
            with open(self.folder / "asked", "a") as out:
                out.write(name + "\n")
            return super()._read(name, url)

    url = "https://example.org/Search/Results.aspx"
    return SearchSite("https://example.org/Search/Search.aspx", url, "query"), Counting(folder, url)


def test_page_source(spark, tmp_path):
    from tessera.sources.pages import ResultPages, result_pages

    _site(tmp_path)
    spark.dataSource.register(ResultPages)
    rows = spark.read.format("result_pages").options(folder=str(tmp_path), query="q", batch_pages="1").load()
    assert sorted(r.page for r in rows.collect()) == [0, 1, 2] and rows.rdd.getNumPartitions() == 3
    read = lambda **o: sorted(r.page for r in spark.read.format("result_pages").options(folder=str(tmp_path), pause="0", **o).load().collect())
    assert read(page_start="1", page_end="1") == [1] and read(page_start="1", page_end="9") == [1, 2] and read(max_results="2", batch_pages="1") == [0, 1]
    assert [r.page for r in result_pages(spark, folder=str(tmp_path)).where("page > 0 and page in (0, 2, 5) and query = ''").collect()] == [2]
    assert result_pages(spark, folder=str(tmp_path)).where("page = 7").count() == 0
    for options, message in (({"page_start": "9"}, "failed to load page 10"), ({"page_start": "2", "page_end": "1"}, "range"), ({"max_results": "0"}, "positive"), ({"batch_pages": "0"}, "one page at least")):
        with pytest.raises(Exception, match=message):
            read(**options)
    out, seen = str(tmp_path / "out"), []
    for _ in range(2):  # the second run goes on where the first ended
        stream = spark.readStream.format("result_pages").options(folder=str(tmp_path), query="q", batch_pages="2").load()
        query = stream.writeStream.foreachBatch(lambda b, n: seen.append(sorted(r.page for r in b.collect()))).option("checkpointLocation", out).start()
        query.processAllAvailable()
        query.stop()
    assert sorted(p for b in seen for p in b) == [0, 1, 2] and max(map(len, seen)) <= 2


def test_wanted_results_read_the_pages_they_need_once(spark, tmp_path, monkeypatch):
    import sys
    import types

    from tessera.sources.pages import result_pages

    _site(tmp_path, 9)
    here = types.ModuleType("counting_site")
    here.make = lambda: _counting(tmp_path)
    (tmp_path / "counting_site.py").write_text(f"import sys\nsys.path.insert(0, {str(Path(__file__).parent)!r})\nfrom test_engine import _counting\nfrom pathlib import Path\ndef make():\n    return _counting(Path({str(tmp_path)!r}))\n")
    monkeypatch.syspath_prepend(str(tmp_path))
    monkeypatch.setenv("PYTHONPATH", f"{tmp_path}:{sys.path[1]}")
    spark.sparkContext.addPyFile(str(tmp_path / "counting_site.py"))
    from tessera.sources.pages import _Limits, _Reader

    reader = _Reader(_Limits({"client": "counting_site:make", "query": "q", "max_results": "4", "batch_pages": "3", "pause": "0"}))
    got = [row[0] for part in reader.partitions() for row in reader.read(part)]
    asked = [x for x in (tmp_path / "asked").read_text().split() if x != "form.html"]
    assert got == [0, 1, 2, 3] and sorted(set(asked)) == [f"page_{i}.html" for i in range(4)]
    assert all(asked.count(f"page_{i}.html") == 1 for i in range(1, 4)), "the first page comes with each search, the others once"
    assert result_pages(spark, folder=str(tmp_path), max_results="4").count() == 4


def _pages_of(spark, *pages):
    """Parsed pages of (page_index, [(ecli, reference)])."""
    fields = _schema(DECISION_FIELDS).names
    one = lambda e, r: tuple({"ecli": e, "case_reference": r, "text_url": f"u{e or r}"}.get(f) for f in fields)
    rows = [("q", i, i + 1, len(found), 0, 0, 0, 9, [one(*f) for f in found]) for i, found in pages]
    return spark.createDataFrame(rows, PAGE_FIELDS)


def test_crawl_identity_and_errors(spark):
    """Duplicates by ecli, else reference; empty pages; decisions without identity; only pages before the limit count."""
    found = lambda pages, **o: [(r.ecli, r.case_reference) for r in S.collect_results(pages, **o).orderBy("pos").collect()]
    fine = _pages_of(spark, (0, [("E1", "r1"), (None, "r2")]), (1, [("E3", "r1"), ("", "r4")]))
    assert found(fine) == [("E1", "r1"), (None, "r2"), ("E3", "r1"), ("", "r4")]
    assert found(fine, max_results=3) == [("E1", "r1"), (None, "r2"), ("E3", "r1")] and found(fine, page_start=1) == [("E3", "r1"), ("", "r4")]
    twice = _pages_of(spark, (0, [("E1", "r1"), (None, "r2")]), (1, [("E1", "other"), ("E5", "r5")]), (2, [(None, "r2"), ("E6", "r6")]))
    with pytest.raises(Exception, match="duplicate decision"):
        found(twice)
    with pytest.raises(Exception, match="duplicate decision"):  # page 1 is read for the third
        found(twice, max_results=3)
    assert found(twice, max_results=2) == [("E1", "r1"), (None, "r2")]
    assert found(twice, skip_duplicates=True) == [("E1", "r1"), (None, "r2"), ("E5", "r5"), ("E6", "r6")] and len(found(twice, skip_duplicates=True, max_results=3)) == 3
    for pages, message in ((_pages_of(spark, (0, [("E1", "r1")]), (1, [])), "empty page 2"), (_pages_of(spark, (0, [(None, "")])), "lacks both"), (_pages_of(spark, (0, [("E1", None)])), "lacks its reference")):
        with pytest.raises(Exception, match=message):
            found(pages)
    asked = []
    fetch = lambda rows: (asked.append(rows.count()), rows.select("text_url", F.concat(F.lit("text "), "text_url").alias("full_text")))[1]
    assert S.collect_results(fine, fetch, max_results=2).count() == 2 and asked == [2]
    with pytest.raises(Exception, match="lacks its reference, url or text"):
        S.collect_results(fine, lambda rows: rows.select("text_url", F.lit("").alias("full_text"))).collect()


def test_end_tags_may_be_left_out():
    cells = "".join(f"<td>{c}" for c in ('<input id="sel_3">', '<a href="d?id=3">I.ÚS 3/24</a><br>ECLI:CZ:3', "<p>P<p>Name", "1. 1. 2024", "<ul><li>r1<li>r2</ul>", "Nález", "zamítnuto", "", "t", ""))
    html = f'<table><tr class="resultHeaderCount"><td>Výsledky 1 - 1 z celkem 1 <input name="pageNumber" value="1"></table><table><tbody><tr id="headerRowFirst"><td>h<tr class="resultData0">{cells}<tr><td><a href="/GetText.aspx?sz=3">t</a></table>'
    found = H.parse_result_page(html, "q", "https://example.org/Search/")["results"]
    assert [(d["result_id"], d["case_reference"], d["ecli"], d["petitioner"], d["popular_name"], d["related_regulations"], d["text_url"]) for d in found] == [(3, "I.ÚS 3/24", "ECLI:CZ:3", "P", "Name", ["r1", "r2"], "https://example.org/GetText.aspx?sz=3")]
    tree = H._Tree()
    tree.feed("<table><tr><td>a<table><tr><td>inner</td></tr></table>after</td><td>b</table>")
    assert [len(r.nodes("td", direct=True)) for r in H._rows(tree.root.nodes("table")[0])] == [2]


def test_scrape_job(spark, tmp_path, monkeypatch, capsys):
    import argparse
    import json

    from tessera import jobs

    _site(tmp_path)
    target = tmp_path / "found.json"
    monkeypatch.setenv("TESSERA_OUTPUT_PATH", str(target))
    monkeypatch.setenv("TESSERA_PAGE_END", "8")  # beyond the last page
    options = ["scrape", "--query", "rodina", "--option", f"folder={tmp_path}", "--option", "pause=0", "--base-url", "https://example.org/Search/", "--batch-sleep-seconds", "0"]
    assert jobs.main(options, spark) == 0
    found = json.loads(target.read_text())
    assert [(d["result_id"], d["case_reference"], d["full_text"], d["ecli"]) for d in found] == [(i, f"I.ÚS {i}/24", f"text {i}", None) for i in range(3)]
    assert target.read_text().startswith("[\n  {\n    ")
    (tmp_path / "GetText_aspx_sz_2.html").unlink()  # cut away, so its text is not missed
    assert jobs.main([*options, "--max-results", "2"], spark) == 0 and [d["result_id"] for d in json.loads(target.read_text())] == [0, 1]
    assert json.loads(capsys.readouterr().out.strip().splitlines()[-1]) == {"query": "rodina", "pages": 2, "decisions": 2, "file": str(target)}
    for bad in (["--page-start", "x"], ["--page-start", "9"], ["--fetch-full-text", "maybe"], ["--batch-sleep-seconds", "-1"], ["--max-results", "0"]):
        with pytest.raises(SystemExit):
            jobs.main([*options, *bad], spark)
    named = lambda most, first, last: jobs.target(argparse.Namespace(output_path=None, query="Únos dítěte", max_results=most, page_start=first, page_end=last))
    assert [named(*x) for x in ((None, 1, 1), (5, 1, None), (None, 1, 4))] == ["results.json", "results_unos_ditete_5.json", "results_unos_ditete_pages_1_4.json"]


def test_clients(tmp_path):
    from tessera.sources import client as K

    _site(tmp_path)
    site = K.SearchSite("https://example.org/Search/Search.aspx", "https://example.org/Search/Results.aspx", "text")
    held = K.FolderClient(str(tmp_path), site.results_url)
    assert K.fetch_page(site, held, 1, "q") == (tmp_path / "page_1.html").read_text()
    with pytest.raises(ValueError):
        site.page(held, "q", -1)
    with pytest.raises(RuntimeError, match="__EVENTVALIDATION, __VIEWSTATE, __VIEWSTATEGENERATOR"):
        K.form_fields("<input type='hidden' name='a' value='b'>")
    assert K.form_fields(FORM)["__VIEWSTATE"] == "v&"
    calls, waits = [], []

    def failing(*_):
        calls.append(1)
        raise OSError("down")

    assert K.with_retries(failing, "u", sleep=waits.append) is None and len(calls) == 3 and waits == [1.0, 1.0]
    with pytest.raises(RuntimeError, match="failed to load"):
        K.fetch_decision(K.FolderClient(str(tmp_path / "none"), "r"), "https://example.org/x", sleep=lambda _: None)


def test_model_clients(monkeypatch):
    import json

    from tessera.sources import client as K

    waits, answers = [], [OSError("net"), K.Response("", status=503), K.Response("ok", status=404)]

    def post(url, payload):
        answer = answers.pop(0)
        if isinstance(answer, Exception):
            raise answer
        return answer

    assert K.ModelClient("p", post, retries=2, sleep=waits.append).post("u", {}).status == 404 and waits == [0.5, 1.0]
    answers[:] = [K.Response("", status=500)] * 3
    assert K.ModelClient("p", post, retries=2, sleep=waits.append).post("u", {}) is None
    with pytest.raises(ValueError, match="unknown provider"):
        K.text_model("nobody", post)
    asked = []
    K.register("c", K.chat_provider("https://example.org/c", "m"))
    K.register("b", K.block_provider("https://example.org/b", "m"))
    reply = {"choices": [{"message": {"content": "chat"}}], "content": [{"type": "image"}, {"type": "text", "text": "block"}]}
    ask = lambda name: K.text_model(name, lambda u, p: asked.append(p) or K.Response(json.dumps(reply)))([{"role": "system", "content": "s1"}, {"role": "user", "content": "u"}, {"role": "system", "content": "s2"}])
    monkeypatch.setenv("LLM_MODEL_B", "other")
    assert (ask("c"), ask("b")) == ("chat", "block")
    assert asked[0]["model"] == "m" and len(asked[0]["messages"]) == 3 and (asked[1]["model"], asked[1]["system"], len(asked[1]["messages"])) == ("other", "s2", 1)
    assert K.text_model("c", lambda u, p: K.Response("not json"))([]) is None
    monkeypatch.setenv("LLM_PROVIDER", "New")
    with pytest.raises(ValueError, match="LLM_URL"):
        K.configured()
    monkeypatch.setenv("LLM_URL", "https://example.org/n")
    assert K.configured() == "new" and "new" in K.PROVIDERS
    assert {n: K.text_model(n, lambda u, p: asked.append((u, p["model"])) or K.Response(json.dumps(reply)))([]) for n in ("openai", "deepseek", "claude")} == {"openai": "chat", "deepseek": "chat", "claude": "block"}
    assert [u.split("/")[2] for u, _ in asked[-3:]] == ["api.openai.com", "api.deepseek.com", "api.anthropic.com"]
    assert K.headers("openai", "k")["Authorization"] == "Bearer k" and K.headers("claude", "k")["x-api-key"] == "k"


def test_trace(caplog):
    import logging

    from tessera.trace import logger, trace

    log = logger("t")
    logging.getLogger("tessera").setLevel("DEBUG")
    try:
        with caplog.at_level("DEBUG", "tessera"):
            trace(log, "a.b", n=1, s="é", o=object)
    finally:
        logging.getLogger("tessera").setLevel("INFO")
    assert caplog.messages == [f'TRACE a.b | n=1 s="é" o={object}']


# Points


def test_points_outlive_a_restart(spark, tmp_path):
    root = str(tmp_path / "points")
    table = PointTable(spark, root)
    assert table.version == -1 and table.read().count() == 0
    table.upsert(_chunks(spark, ("a", "t1"), ("b", "t2")), A.mock_embed)
    again = PointTable(spark, root)
    assert again.read().count() == 2
    for i in range(10):  # beyond one compaction; each batch comes twice
        for _ in range(2):
            PointTable(spark, root).upsert(_chunks(spark, ("b", f"new {i}"), (f"c{i}", "t")), A.mock_embed)
    got = {r.o: r.t for r in PointTable(spark, root).read().select(F.col("payload.original_id").alias("o"), F.col("payload.text").alias("t")).collect()}
    assert got == {"a": "t1", "b": "new 9"} | {f"c{i}": "t" for i in range(10)}
    (tmp_path / "points" / "v999").mkdir()  # a version that broke off
    assert PointTable(spark, root).read().count() == 12


def test_last_write_wins_and_absent_checksums_are_computed(spark):
    rows = _chunks(spark, ("a", "first"), ("a", "last")).withColumn("pos", F.col("chunk_index"))
    points = P.make_points(rows)
    empty = P.make_points(rows).where("false").drop("pos").withColumn("vector", A.mock_embed("id"))
    assert [r.payload.text for r in P.merge(empty, P.classify(points, empty), A.mock_embed).collect()] == ["last"]
    one = P.make_points(_chunks(spark, ("a", "t1")))
    bare = one.withColumn("payload", F.col("payload").withField("content_checksum", F.lit(None).cast("string"))).withColumn("vector", A.mock_embed("id"))
    assert P.ingest_stats(P.classify(one, bare)).first().skipped_points == 1


def test_collections(spark, tmp_path):
    held = P.Collections(spark, str(tmp_path))
    assert held.create("a", 10) and not held.create("a", 10)
    with pytest.raises(ValueError, match="10 components, not 5"):
        held.create("a", 5)
    points = P.make_points(_chunks(spark, ("a", "t1"), ("b", "t2"))).withColumn("vector", A.mock_embed("id"))
    legacy = points.where("payload.original_id = 'a'").withColumn("id", F.lit("1"))
    points.unionByName(legacy).write.mode("overwrite").parquet(f"{tmp_path}/a")
    assert held.repair("a", "b") == {"total_points": 3, "unique_ids": 2, "duplicate_groups": 1, "extra_points": 1, "written_points": 2}
    with pytest.raises(ValueError, match="exists"):
        held.repair("a", "b")
    held.swap_alias("live", "a")
    assert held.read("live").count() == 3 and held.exists("live")
    held.swap_alias("live", "b")
    again = P.Collections(spark, str(tmp_path))
    assert again.aliases() == {"live": "b"} and again.read("live").count() == 2 and again.properties("live")["dim"] == "10"
    with pytest.raises(ValueError, match="no collection"):
        held.swap_alias("live", "none")
    assert P.require_vectors(again.read("live"), 10).count() == 2
    with pytest.raises(Exception, match="has not 9 components"):
        P.require_vectors(again.read("live"), 9).collect()


def test_repair_job(spark, tmp_path, capsys):
    from tessera import jobs

    P.make_points(_chunks(spark, ("a", "t1"), ("b", "t2"))).withColumn("vector", A.mock_embed("id")).write.parquet(f"{tmp_path}/s")
    assert jobs.main(["report", "--root", str(tmp_path), "--source", "s"], spark) == 0
    assert '"unique_ids": 2' in capsys.readouterr().out
    assert jobs.main(["repair", "--root", str(tmp_path), "--source", "s", "--alias", "live"], spark) == 0
    assert P.Collections(spark, str(tmp_path)).aliases()["live"].startswith("s_repaired_2") and P.Collections(spark, str(tmp_path)).read("live").count() == 2


def test_ingest_status(spark, tmp_path):
    from tessera.streaming.ingest import Ingest

    assert Ingest(lambda: None, blocked="legacy ids").run().join() == "blocked"
    assert Ingest(lambda: None).run().join(10) == "completed"
    tries = []

    def failing():
        tries.append(1)
        raise OSError("not ready")

    failed = Ingest(failing, retries=2, pause=0).run()
    assert failed.join(10) == "error" and len(tries) == 3 and "not ready" in failed.message
    _chunks(spark, ("a", "t1")).coalesce(1).write.parquet(str(tmp_path / "in/0"))
    table = PointTable(spark, str(tmp_path / "points"))
    stream = lambda: ingest_stream(spark.readStream.schema(CHUNK_FIELDS).parquet(str(tmp_path / "in/*")), table, A.mock_embed, str(tmp_path / "check"))
    assert Ingest(stream).run().join(120) == "completed" and table.read().count() == 1


# Search and plans


def test_search_in_blocks_equals_one_batch(spark, monkeypatch):
    corpus, asked = catalogue._corpus(spark, D), catalogue._asked(spark, D)
    points, vectors = catalogue._points(spark, D), catalogue._vector_queries(spark, D)
    rows = lambda df: sorted((r.qid, r["rank"], r.id, round(r.score, 9)) for r in df.collect())
    whole = rows(R.keyword_search(corpus, asked, 3)), rows(R.dense_search(points, vectors, 3))
    monkeypatch.setattr(R, "MAX_QUERIES", 7)
    assert (rows(R.keyword_search(corpus, asked, 3)), rows(R.dense_search(points, vectors, 3))) == whole
    big = asked.where("qid < 3").select((F.col("qid") + (1 << 60) + 1).alias("qid"), "query")
    assert {r.qid for r in R.keyword_search(corpus, big, 1).collect()} == {(1 << 60) + 1 + i for i in range(3)}
    assert R.keyword_search(corpus, asked, 0).count() == 0 and R.keyword_search(corpus, asked.where("false"), 3).count() == 0


def test_search_without_the_automaton(monkeypatch):
    import builtins

    words = ["ab", "b", "c"]
    fast = R._finder(words)
    real = builtins.__import__
    monkeypatch.setattr(builtins, "__import__", lambda name, *a, **k: (_ for _ in ()).throw(ImportError()) if name == "ahocorasick" else real(name, *a, **k))
    slow = R._finder(words)
    assert all(sorted(fast(t)) == sorted(slow(t)) for t in ("", "abc", "xx", "cab"))


def test_vectors_that_take_no_part(spark):
    rows = [("a", "t", 1, [1.0, 0.0]), ("b", "t", 0, [1.0, 0.0]), ("c", "t", 2, None), ("d", "t", 3, [0.0, 0.0]), ("e", "t", 4, [1.0]), ("f", "t", 5, [float("nan"), 1.0]), ("g", "t", 6, [-1.0, 0.0])]
    points = spark.createDataFrame(rows, "id string, text string, pos long, vector array<float>")
    asked = spark.createDataFrame([(1, [2.0, 0.0]), (2, None), (3, [0.0, 0.0])], "qid long, vector array<float>")
    got = R.dense_search(points, asked, 5).orderBy("rank").collect()
    assert [(r.qid, r.id, round(r.score, 9)) for r in got] == [(1, "b", 1.0), (1, "a", 1.0), (1, "g", -1.0)]


def test_one_failing_query_keeps_the_others(spark):
    hits = spark.createDataFrame([(q, i, t, 0.5, "dense", n, n + 1) for q in (1, 2) for n, (i, t) in enumerate((("a", "x"), ("b", "yy")))], "qid long, id string, text string, score double, source string, pos long, rank int").coalesce(1)
    asked = spark.createDataFrame([(1, "bad"), (2, "good")], "qid long, query string")

    def predict(pairs):
        if any(q == "bad" for q, _ in pairs):
            raise ValueError
        return [len(t) for _, t in pairs]

    got = {(r.qid, r["rank"]): r.id for r in R.cross_encoder_rerank(hits, asked, predict).collect()}
    assert [got[q, n] for q in (1, 2) for n in (1, 2)] == ["a", "b", "b", "a"]


def test_as_hits(spark):
    points = P.make_points(_chunks(spark, ("a", "t1"), ("b", None))).withColumn("vector", A.mock_embed("id"))
    bare = points.where("payload.original_id = 'a'").withColumns({"id": F.lit("own"), "payload": F.col("payload").withField("original_id", F.lit(""))})
    assert sorted((r.id, r.text, r.pos) for r in R.as_hits(points.unionByName(bare)).collect()) == [("a", "t1", 7_000_000), ("b", "", 7_000_001), ("own", "t1", 7_000_000)]


def _hits_table(spark):
    points = P.make_points(_chunks(spark, ("a", "únos dítěte"), ("b", "stát"), ("c", "jiné"))).withColumn("vector", A.mock_embed("id"))
    return R.as_hits(points)


def test_engine_run_and_its_fallbacks(spark):
    points, asked = _hits_table(spark), spark.createDataFrame([((1 << 60) + 1, "únos")], "qid long, query string")
    got = engine.run(points, asked, 2, rewriter=A.prompted()).first()
    assert got.qid == (1 << 60) + 1 and got.answer == A.SYNTHESIS and got.sources == ["a", "b"]
    assert got.plan_steps[0].startswith(f"únos {A.EXPANSION}") and len(got.plan_steps) == 3

    def broken(*_):
        raise ValueError

    fell = engine.run(points, asked, 2, rewriter=broken, planner=broken).first()
    assert fell.plan_steps == ["únos"] and fell.sources == ["a", "b"]
    assert spark.range(1).select(A.single_step(F.lit("q"))).first()[0][0].reason == "orchestrator fallback"
    assert engine.run(points, asked, 2, embed=broken).first().sources == []
    failed = engine.run(points, asked, 2, model=broken).first()
    assert (failed.answer, failed.sources) == ("", [])
    null = engine.run(points, asked, 2, model=lambda q, c: F.lit(None).cast("string")).first()
    assert (null.answer, null.sources) == ("", ["a", "b"])
    steps = engine.step_hits(points, asked.withColumn("steps", A.plan("query")), 2, A.mock_embed)
    assert A.step_totals(steps).first().total_chunks == 6


def test_models_are_asked_once_a_prompt(spark, tmp_path):
    """Nine queries of three texts: three calls of each model, however often the result is computed; a second run asks nothing."""
    from tessera.operators.ledger import Ledger

    points = _hits_table(spark)
    asked = spark.createDataFrame([(i, f"únos {i % 3}") for i in range(9)], "qid long, query string")

    def counted(name, reply):
        log = str(tmp_path / name)

        @F.pandas_udf("string")
        def model(text: pd.Series, other: pd.Series) -> pd.Series:
            with open(log, "a") as out:
                out.writelines("x\n" for _ in text)
            return reply(text)

        return lambda query, context=F.lit(""): model(query, context)

    models = {"rewriter": counted("r", lambda t: t + " více"), "planner": counted("p", lambda t: "1. " + t + " | a\n2. stát | b"), "model": counted("m", lambda t: "k " + t)}
    calls = lambda: {n: len((tmp_path / n).read_text().split()) for n in "rpm"}
    ledger = Ledger(spark, str(tmp_path / "ledger"))
    for _ in range(2):
        out = engine.run(points, asked, 2, ledger=ledger, **models)
        for _ in range(2):
            rows = {r.qid: r for r in out.collect()}
            assert rows[4].answer == "k únos 1 více" and rows[4].plan_steps == ["únos 1 více", "stát"] and rows[4].sources == ["a", "b"]
        assert calls() == {"r": 3, "p": 3, "m": 3}


def test_failures_on_rows_fall_back(spark):
    """A model or an embedder that fails when its rows are computed counts like one that can't be set up."""
    points, asked = _hits_table(spark), spark.createDataFrame([(1, "únos")], "qid long, query string")

    @F.pandas_udf("string")
    def fails(text: pd.Series) -> pd.Series:
        raise OSError("no model")

    @F.pandas_udf("array<float>")
    def no_vector(text: pd.Series) -> pd.Series:
        raise OSError("no model")

    got = engine.run(points, asked, 2, rewriter=fails, planner=fails, model=lambda q, c: fails(q)).first()
    assert (got.answer, got.sources, got.plan_steps) == ("", [], ["únos"])
    got = engine.run(points, asked, 2, embed=no_vector).first()
    assert got.sources == [] and got.answer == A.SYNTHESIS and len(got.plan_steps) == 3


def test_engine_search_and_retrieve(spark):
    points, asked = _hits_table(spark), spark.createDataFrame([(1, "únos"), (2, " ")], "qid long, query string")
    got = {r.qid: r for r in engine.search(points, asked, 2, rewriter=A.prompted()).collect()}
    assert got[1].query == "únos" and got[1].top_cases == ["a", "b"] and got[1].strategy.mode == "direct_answer"
    rows = engine.retrieve(points, asked, 2).orderBy("rank").collect()
    assert [(r.qid, r.chunk_id, r.case_reference) for r in rows] == [(1, "a", "ref"), (1, "b", "ref")]
    assert engine.retrieve(points, asked, 2, sources=["constitutional"]).count() == 2
    assert engine.retrieve(points, asked, 2, sources=["supreme"], prefilter=True).count() == 0


def test_text_models(spark):
    assert one(spark, A.mock_text_model("t"), t="a\n\n b \nPřepsaný dotaz:\n") == f"b {A.EXPANSION}"
    assert one(spark, A.mock_text_model("t"), t="no mark") == A.EXPANSION
    assert one(spark, A.mock_text_model("t"), t="Přepsaný dotaz:\nlast") == f"last {A.EXPANSION}"
    assert one(spark, A.rewrite("t", A.prompted()), t="q") == f"q {A.EXPANSION}"
    assert one(spark, A.rewrite("t", lambda q: F.lit(" ")), t="q") == "q"
    chunks = F.array(*[F.struct(F.lit(f"c{i}").alias("id"), F.lit("{x}" * 400).alias("text")) for i in range(6)])
    messages = one(spark, A.rag_messages(F.col("t"), chunks, "S", "{query}: {chunks}"), t="q{1}")
    assert [m.role for m in messages] == ["system", "user"] and messages[1].content.startswith("q(1): [c0] (x)") and messages[1].content.count("[c") == 5 and len(messages[1].content) == 6 + 5 * 805 + 4 * 2 - 0 - 0
    assert one(spark, A.mock_llm("t", chunks), t="q") == ("Mock odpověď na: q", "", ["c0", "c1", "c2"], 0.5)
    assert one(spark, A.first_text_block("t"), t='{"content":[{"type":"image"},{"type":"text","text":"x"},{"type":"text","text":"y"}]}') == "x"
    rows = A.gather(spark.createDataFrame([(1, "q"), (2, "r")], "qid long, query string"), spark.createDataFrame([(1, 1, "a", "t", 0.5), (1, 2, "b", "u", 0.4), (2, 1, "a", "t", 0.5)], "qid long, rank int, id string, text string, score double"))
    got = {r.qid: r.answer for r in A.hybrid_answer(rows, lambda q, c: F.concat(F.lit("model "), q)).collect()}
    assert got == {1: "model q", 2: A.SUMMARY + "r"}


def test_embedders(spark):
    class Model:
        def encode(self, texts):
            return [[3.0, 4.0] if t else [0.0, 0.0] for t in texts]

    rows = spark.createDataFrame([("a",), ("",), (None,)], "t string")
    got = [list(r.v) for r in rows.select(A.sentence_embedder(Model)("t").alias("v")).collect()]
    assert got == [[pytest.approx(0.6), pytest.approx(0.8)], [0.0, 0.0], [0.0, 0.0]] and A.dimension(Model) == 2
    with pytest.raises(Exception, match="zip"):
        rows.coalesce(1).select(A.embedder(lambda texts: [[1.0]])("t")).collect()


def test_service(spark):
    from tessera.plans.service import NotReady, Service

    stub = Service(spark)
    assert stub.retrieve("q") == [] and stub.search("q")["strategy"]["mode"] == "no_results" and not stub.health()["ready"]
    with pytest.raises(NotReady, match="broken"):
        Service(spark, strict=True, error="broken").query("q")
    live = Service(spark, _hits_table(spark), "v1")
    first = live.query("únos")
    live.planner = lambda q: F.lit("1. other | r")
    assert live.query("  ÚNOS ") == first and live.health()["cached_answers"] == 1
    assert [r["chunk_id"] for r in live.retrieve("únos", 2)] == ["a", "b"] and live.search("únos", 2)["top_cases"] == ["a", "b"]


def test_hot_identities_are_cut_before_the_shuffle(spark):
    rows = spark.range(20_000).select(F.lit("same").alias("k"), F.col("id").alias("pos"), (F.col("id") % 7).alias("n"), F.lit("text").alias("text"))
    best = C.dedup_best(rows, F.col("k"), [F.col("n")], "pos")
    assert best.first().asDict() == {"k": "same", "pos": 0, "n": 6, "text": "text"}
    assert "partial_min_by" in best._jdf.queryExecution().executedPlan().toString()


def test_seed_and_paths(spark, monkeypatch):
    empty = spark.createDataFrame([], CHUNK_FIELDS)
    seed = S.or_seed(empty).collect()
    assert [r.id for r in seed] == [str(i) for i in range(1, 9)] and all(r.case_reference == r.id and r.ecli == "" for r in seed)
    assert S.resolved("a/b", "/r") == "/r/a/b" and S.resolved("/a", "/r") == "/a" and S.resolved("s3://b/a", "/r") == "s3://b/a"
    monkeypatch.setenv("TESSERA_RESULTS_PATH", "x/results.json")
    assert S.batches_folder(root="/r") == "/r/x"
    monkeypatch.setenv("TESSERA_BATCHES_DIR", "/own")
    assert S.batches_folder(root="/r") == "/own"


# Chunks in one pass


@pytest.mark.parametrize("size,overlap", [(50, 10), (300, 200), (10, 0), (7, 6), (300, 100)])
def test_chunks_equal_slices(spark, size, overlap):
    texts = ["x" * n for n in (0, 1, 5, 9, 10, 11, 40, 41, 49, 50, 51, 100, 101, 299, 300, 301, 400)] + ["\U0001f600ab\ncd" * 100]
    want = {}
    for i, t in enumerate(texts):
        for k in range(max(-(-(len(t) - overlap) // (size - overlap)), 1) if t else 0):
            want[i, k] = t[k * (size - overlap) : k * (size - overlap) + size]
    rows = C.chunk(spark.createDataFrame(list(enumerate(texts)), "i int, text string").withColumn("chunk_index", F.lit("own")), "text", size, overlap)
    assert {(r.i, r.chunk_index): r.chunk_text for r in rows.collect()} == want


def test_chunk_time_follows_the_text(spark):
    def took(mb):
        rows = spark.range(1).select(F.repeat(F.lit("some words in \u010desk\u00e9 texts\n\n "), mb * 1_000_000 // 26).alias("text"))
        start = time.perf_counter()
        assert C.chunk(rows).agg(F.sum(F.length("chunk_text"))).first()[0] > 0.9e6 * mb
        return time.perf_counter() - start

    took(1)
    assert took(8) < 10
    blanks = spark.range(1).select(F.concat(F.lit("a"), F.repeat(F.lit("\n"), 2_000_000), F.lit("b")).alias("text"))
    start = time.perf_counter()
    assert C.chunk(blanks).count() == 1539 and time.perf_counter() - start < 10


# Keyword index


def _plain_hits(spark, texts, asked, k):
    rows = spark.createDataFrame([(i, t, p) for i, (t, p) in texts.items()], "id string, text string, pos long")
    return sorted((r.qid, r["rank"], r.id, round(r.score, 9)) for r in R.keyword_search(rows, asked, k).collect())


def test_keyword_index_equals_a_scan(spark, tmp_path, monkeypatch):
    """Builds, updates, replacements and deletions; shards of a few texts; very long words."""
    from tessera.operators import keyword_index as K

    monkeypatch.setattr(K, "SHARD_TEXTS", 5)
    monkeypatch.setattr(K, "BUCKETS", 4)
    rng = random.Random(3)
    words = ["alpha", "alphabet", "beta", "betatest", "gam", "ga", "dalet", "\u010desk\u00e9", "ALPHA", "x" * 80 + "needle" + "y" * 50, "q" * 40]
    text = lambda: " ".join(rng.choices(words, k=rng.randrange(6)))
    held = {f"d{i}": (text(), i * 7 % 41) for i in range(40)} | {"none": (None, 99), "empty": ("", 98)}
    queries = ["alpha beta", "alph ALPHA beta beta dalet gam bet", "needle", "xxx" + "needle" + "y" * 45, "q" * 40, "ga", "", "   ", None, "nothing here", "\u010desk", "yyneedle"]
    asked = spark.createDataFrame(list(enumerate(queries)), "qid long, query string")
    frame = lambda some: spark.createDataFrame([(i, *held[i]) for i in some], "id string, text string, pos long").repartition(3)
    index = K.KeywordIndex(spark, str(tmp_path / "index"))
    assert index.search(asked, 4).count() == 0
    index.build(frame(held))
    found = lambda k: sorted((r.qid, r["rank"], r.id, round(r.score, 9)) for r in index.search(asked, k).collect())
    assert found(4) == _plain_hits(spark, held, asked, 4) and found(100) == _plain_hits(spark, held, asked, 100)
    for step in range(2):
        changed = [f"d{i}" for i in range(step, 40, 3)] + [f"new{step}"]
        held |= {i: (text(), 100 * (step + 1) + n) for n, i in enumerate(changed)}
        gone = [f"d{5 + step * 7}"]
        for i in gone:
            held.pop(i, None)
        index.update(frame([i for i in changed if i in held]), spark.createDataFrame([(i,) for i in gone], "id string"))
        assert found(4) == _plain_hits(spark, held, asked, 4)
    index.update(frame(held).where("false"))
    again = K.KeywordIndex(spark, str(tmp_path / "index"))
    assert len(again.segments()) == 4 and not again.due()
    texts = again.search(asked, 2, frame(held)).collect()
    assert texts and all(r.text == held[r.id][0] for r in texts)
    monkeypatch.setattr(K, "MAX_MATCHED", 1)
    assert found(4) == _plain_hits(spark, held, asked, 4)
    (tmp_path / "index/seg-00000009/postings").mkdir(parents=True)  # a segment that broke off
    assert len(again.segments()) == 4
    index.build(frame(held))
    assert len(index.segments()) == 1 and found(4) == _plain_hits(spark, held, asked, 4)


def test_keyword_index_reads_postings_of_its_words(spark, tmp_path):
    """The plan reads folders of the words asked for, and no text."""
    from tessera.operators.keyword_index import KeywordIndex

    corpus = catalogue._corpus(spark, D)
    index = KeywordIndex(spark, str(tmp_path / "index")).build(corpus)
    found = index.search(spark.createDataFrame([(1, "onesen")], "qid long, query string"), 5)
    assert found.count() > 0
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "documents" not in plan and re.search(r"PartitionFilters: \[[^\]]*bucket", plan)


def test_keyword_index_compares_many_words_in_tasks(spark, tmp_path):
    """A block of very many words passes over the postings once and joins them with no trigrams."""
    from tessera.operators.keyword_index import KeywordIndex

    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcd", k=rng.randrange(3, 7)))
    held = {f"d{i}": (" ".join(word() for _ in range(rng.randrange(20))), i * 7 % 61) for i in range(60)}
    frame = spark.createDataFrame([(i, *v) for i, v in held.items()], "id string, text string, pos long").repartition(3)
    asked = spark.createDataFrame([(n, " ".join(word() for _ in range(60))) for n in range(40)], "qid long, query string")
    found = KeywordIndex(spark, str(tmp_path / "index")).build(frame).search(asked, 5)
    assert sorted((r.qid, r["rank"], r.id, round(r.score, 9)) for r in found.collect()) == _plain_hits(spark, held, asked, 5)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "grams" not in plan


def test_strip_reads_the_ends_alone(spark):
    """All code points that white space may be, at both ends and between; texts are cleaned once for their chunks."""
    from tessera.functions import text as X
    from tessera.operators import corpus as C

    rows = spark.createDataFrame([(chr(i),) for i in range(1, 0x3100)], "c string")
    text = F.concat("c", "c", F.lit("a"), "c", F.lit("b"), "c")
    plain = F.regexp_replace(text, f"^{X.SPACE}+|{X.SPACE}+$", "")
    assert rows.where(~X.strip(text).eqNullSafe(plain)).count() == 0
    texts = spark.createDataFrame([(1, " \t\u3000 "), (2, None), (3, ""), (4, " a  b ")], "n int, text string")
    cut = C.chunk(texts)
    assert [tuple(r) for r in cut.select("n", "chunk_index", "chunk_text").collect()] == [(4, 0, "a b")]
    plan = cut._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("[ \t]+") == 1


# The table's runs and cells


def _state(table):
    return {r.o: r.t for r in table.read().select(F.col("payload.original_id").alias("o"), F.col("payload.text").alias("t")).collect()}


def test_bytes_written_follow_the_changes(spark, tmp_path):
    """Many small upserts beside a large first one: the large run is not written again, nothing is written
    where nothing changed, and the number of runs grows with the logarithm of the upserts."""
    table = PointTable(spark, str(tmp_path / "points"))
    assert table.upsert(_chunks(spark, *[(f"c{i}", random.Random(i).randbytes(500).hex()) for i in range(1500)]), A.mock_embed)
    want, first = _state(table), table.bytes_of("v0")
    earlier = table.read()
    for i in range(9):
        batch = (("c1", f"new {i}"), (f"x{i}", "t"))
        assert table.upsert(_chunks(spark, *batch), A.mock_embed)
        assert not table.upsert(_chunks(spark, *batch), A.mock_embed)
        want |= dict(batch)
        if i == 1:
            assert earlier.count() == 1500  # still there for results that were not read yet
    assert _state(table) == want and table.version == 9
    names = [n for _, _, n in table.runs()]
    assert names[0] == "v0" and table.bytes_of("v0") == first and len(names) <= 5
    assert sum(table.bytes_of(n) for n in names[1:]) < first
    left = sorted(p.name for p in (tmp_path / "points").iterdir())
    assert len(left) <= len(names) + 5
    table.compact()
    assert [n for _, _, n in table.runs()] == ["v0-9"] and _state(table) == want
    assert _state(PointTable(spark, str(tmp_path / "points"))) == want


def test_upserts_read_no_vectors_of_the_table(spark, tmp_path):
    table = PointTable(spark, str(tmp_path / "points"))
    for i in range(3):
        table.upsert(_chunks(spark, ("a", f"t{i}"), (f"b{i}", "t")), A.mock_embed)
    plan = table.sums()._jdf.queryExecution().executedPlan().toString()
    assert "vector:array" not in plan and "content_checksum" in plan
    asked = table.sums([r.id for r in table.read().limit(2).collect()])
    assert asked.count() == 2
    assert table.sums([]).count() == 0 and table.sums(["none"]).count() == 0


def _cloud(spark, n, seed):
    """Vectors about 12 directions, and chunks that name them."""
    rng = np.random.default_rng(seed)
    centres = np.random.default_rng(1).normal(size=(12, 8))
    vectors = {f"p{i:04d}": (centres[i % 12] * 3 + rng.normal(size=8)).astype("float32").tolist() for i in range(n)}
    return vectors, _chunks(spark, *[(i, f"{seed} {i}") for i in vectors])


def test_cells(spark, tmp_path):
    vectors, chunks = _cloud(spark, 400, 2)
    held = spark.sparkContext.broadcast(vectors)
    embed = A.embedder(lambda texts: [held.value[t.split()[1]] for t in texts])
    table = PointTable(spark, str(tmp_path / "points"))
    assert table.fit(4).near(spark.createDataFrame([], "qid long, vector array<float>"), 3).count() == 0
    table = PointTable(spark, str(tmp_path / "more"))
    table.upsert(chunks, embed)
    asked = spark.createDataFrame([(i, vectors[f"p{i * 7:04d}"]) for i in range(30)] + [(98, None), (99, [0.0] * 8), (97, [1.0])], "qid long, vector array<float>")
    rows = lambda df: sorted((r.qid, r["rank"], r.id, round(r.score, 9)) for r in df.collect())
    exact = rows(table.near(asked, 5))
    assert len(exact) == 150
    table.fit(12)
    assert rows(table.near(asked, 5, None)) == exact and rows(table.near(asked, 5, 12)) == exact
    assert table.recall(asked, 5, 3) >= 0.9 >= 0.3 > 0 < table.recall(asked, 5, 1) <= 1
    plan = table.near(asked.where("qid = 3"), 5, 1)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*cell", plan)
    moved, _ = _cloud(spark, 400, 3)  # other vectors, and so other cells, for some of the points
    held = spark.sparkContext.broadcast(moved)
    some = [f"p{i:04d}" for i in range(0, 400, 9)]
    table.upsert(_chunks(spark, *[(i, f"again {i}") for i in some]), A.embedder(lambda texts: [moved[t.split()[1]][::-1] for t in texts]))
    want = {i: (moved[i][::-1] if i in some else v) for i, v in vectors.items()}
    assert {r.o: r.vector for r in table.read().select(F.col("payload.original_id").alias("o"), "vector").collect()} == want
    assert rows(table.near(asked, 5, 12)) == rows(table.near(asked, 5, None))
    assert len({r[0] for r in rows(table.near(asked, 5, 2))}) == 30
    table.fit(6)
    assert rows(table.near(asked, 5, 6)) == rows(table.near(asked, 5, None)) and table.read().count() == 400


def test_rows_without_an_id_take_no_place(spark):
    corpus = spark.createDataFrame([(None, "alpha beta", 0, [1.0, 0.0]), ("b", "alpha", 1, [1.0, 0.1])], "id string, text string, pos long, vector array<float>")
    asked = spark.createDataFrame([(1, "alpha beta", [1.0, 0.0])], "qid long, query string, vector array<float>")
    assert [r.id for r in R.keyword_search(corpus, asked, 1).collect()] == ["b"]
    assert [r.id for r in R.dense_search(corpus, asked, 1).collect()] == ["b"]


@pytest.mark.parametrize("name", ["q32_engine_run", "q49_engine_search"])
def test_engine_queries_need_the_keyword_search(spark, monkeypatch, name):
    """With keyword search switched off the engine's queries give other rows."""
    rows = lambda: sorted(map(str, catalogue.QUERIES[name](spark, D).collect()))
    want, real = rows(), R.keyword_search
    monkeypatch.setattr(R, "keyword_search", lambda corpus, queries, k: real(corpus.where("false"), queries, k))
    assert rows() != want


# Keyed streams


def test_first_rows_over_batches_and_restarts(spark, tmp_path):
    from tessera.streaming.keyed import first_rows

    def run(n, rows, fail=False):
        spark.createDataFrame(rows, "k string, o long").repartition(3).write.parquet(str(tmp_path / f"in{fail}/{n}"))
        stream = first_rows(spark.readStream.schema("k string, o long").parquet(str(tmp_path / f"in{fail}/*")), "k", "o", fail)
        query = stream.writeStream.format("parquet").option("path", str(tmp_path / f"out{fail}")).option("checkpointLocation", str(tmp_path / f"check{fail}")).trigger(availableNow=True).start()
        query.awaitTermination()
        return sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / f"out{fail}")).collect())

    assert run(0, [("a", 3), ("a", 1), ("b", 2)]) == [("a", 1), ("b", 2)]
    assert run(1, [("a", 0), ("c", 9), ("c", 8)]) == [("a", 1), ("b", 2), ("c", 8)]
    assert run(0, [("a", 3), ("b", 2)], True) == [("a", 3), ("b", 2)]
    with pytest.raises(Exception, match="duplicate k: a"):  # over a restart
        run(1, [("a", 5), ("c", 1)], True)
    with pytest.raises(Exception, match="a row without k"):
        run(2, [(None, 1)])


def test_answers_expire(spark, tmp_path):
    from tessera.streaming.keyed import answered

    log = str(tmp_path / "log")

    def answer(query):
        with open(log, "a") as out:
            out.write(query + "\n")
        return query.upper()

    def run(n, rows, seconds):
        spark.createDataFrame(rows, "qid long, query string, key string").write.parquet(str(tmp_path / f"in/{n}"))
        made = answered(spark.readStream.schema("qid long, query string, key string").parquet(str(tmp_path / "in/*")), answer, seconds)
        made.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
        return open(log).read().split()

    assert run(0, [(1, "a", "a"), (2, "a", "a"), (3, "b", "b")], 3600).count("a") == 1
    assert run(1, [(4, "a", "a")], 3600).count("a") == 1
    assert sorted((r.qid, r.answer) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [(1, "A"), (2, "A"), (3, "B"), (4, "A")]
    assert run(2, [(5, "c", "c")], 0.001).count("c") == 1
    time.sleep(0.1)
    assert run(3, [(6, "c", "c")], 0.001).count("c") == 2


def test_counts_and_status_come_from_the_writing_pass(spark, tmp_path):
    from tessera.streaming.ingest import Ingest

    table = PointTable(spark, str(tmp_path / "points"))
    table.upsert(_chunks(spark, ("a", "t1"), ("b", "t2")), A.mock_embed)
    assert table.counts == {"total": 2, "inserted": 2, "updated": 0, "skipped": 0}
    _chunks(spark, ("a", "t1"), ("b", "new"), ("c", "t3")).coalesce(1).write.parquet(str(tmp_path / "in/0"))
    ingest = Ingest(lambda: ingest_stream(spark.readStream.schema(CHUNK_FIELDS).parquet(str(tmp_path / "in/*")), table, A.mock_embed, str(tmp_path / "check"))).run()
    assert ingest.join(120) == "completed" and table.counts == {"total": 3, "inserted": 1, "updated": 1, "skipped": 1}


def test_rows_scored_in_parts_give_the_same_hits(spark, monkeypatch):
    corpus, asked = catalogue._corpus(spark, D), catalogue._asked(spark, D)
    rows = lambda: sorted((r.qid, r["rank"], r.id, round(r.score, 9)) for r in R.keyword_search(corpus, asked, 4).collect())
    whole = rows()
    monkeypatch.setattr(R, "MATCH_CELLS", 100)
    assert rows() == whole


def test_the_table_keeps_its_index(spark, tmp_path):
    """The index follows the upserts, also after one that broke off before its points were indexed."""
    table = PointTable(spark, str(tmp_path / "points"))
    asked = spark.createDataFrame([(1, "alpha beta"), (2, "beta gamma beta"), (3, "delta")], "qid long, query string")
    texts = lambda n: (("a", f"alpha {n}"), ("b", "beta gamma"), ("c", f"betamax {n}"), (f"d{n}", "delta alpha"))
    table.upsert(_chunks(spark, *texts(0)), A.mock_embed)
    with pytest.raises(ValueError, match="no index"):
        table.find(asked)
    table.index_keywords()
    rows = lambda hits: sorted((r.qid, r["rank"], r.id, round(r.score, 9)) for r in hits.collect())
    for n in (1, 2):
        if n == 2:  # as if the points of version 1 had not been indexed
            table._indexed_upto(0)
        table.upsert(_chunks(spark, *texts(n)), A.mock_embed)
        assert rows(table.find(asked, 3)) == rows(R.keyword_search(R.as_hits(table.read()), asked, 3))
    assert len(table.keywords().segments()) == 1 and not table.upsert(_chunks(spark, *texts(2)), A.mock_embed)


def test_rows_are_numbered_in_order(spark):
    rows = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k"), "id").repartition(5)
    assert all(r.k == r.n for r in C.numbered(rows, "k").collect()) and C.numbered(rows.where("false"), "k").count() == 0


def test_dense_search_computes_a_vector_once(spark):
    """A vector may be costly to make: passing over unusable ones must not make it again."""
    made = spark.sparkContext.accumulator(0)

    @F.pandas_udf("array<double>")
    def embed(texts: pd.Series) -> pd.Series:
        made.add(len(texts))
        return texts.map({"a": [1.0, 0.0], "b": [0.0, 0.0], "c": [None, 1.0], "d": [float("nan"), 1.0], "e": None, "f": [1.0], "g": [1.0, 1.0]}.get)

    points = spark.createDataFrame([(t, t, i) for i, t in enumerate("abcdefg")], "id string, text string, pos long").withColumn("vector", embed("text"))
    asked = spark.createDataFrame([(1, [1.0, 0.0])], "qid long, vector array<double>")
    got = R.dense_search(points, asked, 5).orderBy("rank").collect()
    assert [(r.id, round(r.score, 6)) for r in got] == [("a", 1.0), ("g", 0.707107)]
    assert made.value == 7


def test_searches_bound_the_batches_of_texts(spark):
    """10,000 texts of a batch may be 20,000 words each."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    asked = spark.createDataFrame([(1, "word", [1.0])], "qid long, query string, vector array<double>")
    corpus = spark.createDataFrame([("a", "word", 0, [1.0])], "id string, text string, pos long, vector array<double>")
    for search in (R.keyword_search, R.dense_search):
        spark.conf.unset(key)
        assert search(corpus, asked, 1).count() == 1
        assert int(spark.conf.get(key)) <= 1000


def test_a_json_array_is_written_by_tasks(spark, tmp_path, monkeypatch):
    """Rows don't come to the driver, however many; the file is the same as json.dumps makes it."""
    import json

    monkeypatch.setattr(type(spark.range(1)), "toLocalIterator", None)
    for n, parts in ((0, 1), (1, 1), (7, 3)):
        rows = spark.range(n).select("id", F.concat(F.lit("č,\n\""), "id").alias("t"), F.array(F.lit("a")).alias("l")).repartitionByRange(parts, "id").sortWithinPartitions("id")
        assert S.write_json_array(rows, f"{tmp_path}/a.json") == n
        want = [{"id": i, "t": f'č,\n"{i}', "l": ["a"]} for i in range(n)]
        assert (tmp_path / "a.json").read_text("utf-8") == json.dumps(want, ensure_ascii=False, indent=2)


def test_large_json_arrays_are_read_in_parts(spark, tmp_path, monkeypatch):
    """Parts that end anywhere, also in strings with braces, quotes and escapes, give what the whole file gives."""
    import json

    from tessera.sources import json_arrays as J

    rng = random.Random(3)
    texts = ["", "}", "{[", '",{"', "\\", '\\"}', "],[", "č\n}\t", "x" * 90]
    rows = [{"result_id": i, "full_text": "".join(rng.choices(texts, k=rng.randrange(6))), "topics_and_keywords": rng.choices(texts, k=2), "other": [{"a": {}}, [rng.choice(texts)]]} for i in range(120)]
    for name, some, indent in (("a", rows[:70], 2), ("b", rows[70:], None), ("c", [], None)):
        (tmp_path / f"{name}.json").write_text(" " + json.dumps(some, ensure_ascii=False, indent=indent) + "\n")
    read = lambda paths=f"{tmp_path}/?.json": [(r.result_id, r.full_text, r.topics_and_keywords) for r in S.read_decisions(spark, paths).orderBy("pos").collect()]
    want = [(d["result_id"], d["full_text"], d["topics_and_keywords"]) for d in rows]
    assert read() == want
    bad = ['[{"a": 1}, ', '[{"a": 1}', '[{"a": 1},]', '[{"a": 1}] 2', '[{"a": 1}][{"a": 2}]', '[{"a": }]', '[{"a": 1} {"a": 2}]', '["{}"]', "[null]", '{"a": [1]}', "[1, {}]", " "]
    for large in (False, True):
        if large:
            monkeypatch.setattr(J, "LARGE", 1)
        for text in bad:
            (tmp_path / "bad").write_text(text)
            with pytest.raises(Exception, match="not a JSON"):
                read(f"{tmp_path}/bad")
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for part, split in ((1, "100000"), (50, "700"), (1, "97"), (100_000, "300")):
            monkeypatch.setattr(J, "PART", part)
            for k in before:
                spark.conf.set(k, split)
            assert read() == want
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_the_cut_to_many_results_is_not_made_in_one_task(spark):
    """A limit of half a large site's decisions would be held by a task; null fields are cut as well as others."""
    pages = _pages_of(spark, *[(i, [(f"E{i}", f"r{i}"), (None, f"s{i}")]) for i in range(9)])
    found = S.collect_results(pages, max_results=7)
    assert "Limit" not in found._jdf.queryExecution().toString() and "TakeOrdered" not in found._jdf.queryExecution().toString()
    assert [r.case_reference for r in found.orderBy("pos").collect()] == ["r0", "s0", "r1", "s1", "r2", "s2", "r3"]


def test_result_pages_are_parsed_a_few_at_a_time(spark, monkeypatch):
    """The rows of a batch are cut, so that the results of 10,000 pages are never held at once."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.unset(key)
    pages = spark.createDataFrame([], "html string, query string")
    H.parse_result_pages(pages)
    assert int(spark.conf.get(key)) <= 1000 and H.PAGES_AT_ONCE <= 1000
