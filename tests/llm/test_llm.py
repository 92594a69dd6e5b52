import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import ann, decontaminate, jaccard, language_model, mixing, quality, queries, secrets, spans, tokens, toxicity
from tessera.llm.common import table

D = "/root/testdata/sf0.001"
LONG = "word thing other more " * 30_000
#: Nulls, empty, blank and very long texts, ties, repeated rows, null ids and sources.
ROWS = [
    (1, None, "s", 0), (2, "", "s", 0), (3, " \n\t", None, 3), (4, LONG, "t", 1), (5, "a b c d e f g h i j k l", "t", 1), (5, "a b c d e f g h i j k l", "t", 1),
    (None, "A b c d e f g h i j k l", "t", 1), (7, "a b c", "é", 1), (8, "A B C", "é", 1), (9, "password = 'abc12345' x", "u", 1),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Edge rows with columns whose names clash with those that operators add."""
    rows = spark.createDataFrame(ROWS, "doc_id long, text string, source string, size int")
    return rows.withColumns({"score": F.lit("x"), "n_words": F.lit(1), "start": F.lit(1)})


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, D, "documents").toPandas().set_index("doc_id")


def test_odd_rows_in_every_operator(spark, odd):
    labels = spark.createDataFrame([(4, 1, 0), (5, 1, 0), (7, 0, 1), (9, 0, 1)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, "c d e f g h i j k l"), (2, None), (3, "a b c")], "item_id long, text string")
    for rows, n in ((odd, len(ROWS)), (odd.where("false"), 0)):
        scored = quality.score(rows, quality.learn(rows, labels)).collect()
        assert len(scored) == n and all(0 <= r.score <= 1 for r in scored)
        assert toxicity.score(rows, toxicity.learn(rows, labels)).count() == n
        got = decontaminate.scan(rows, bench, clean=True).collect()
        assert len(got) == n and all(r.clean_text == r.text for r in got if not r.hit_words)
        assert secrets.scan(rows).count() == n
        mixed = mixing.mix(rows).collect()
        assert len(mixed) == n and all(0 <= r.taken <= 3 * r.size for r in mixed)
        found = jaccard.join(rows).collect()
        assert len(found) == n
        assert spans.dedup(rows).count() == n
        assert language_model.score(rows, F.lit(True)).where("score <= 0").count() == n
        files = tokens.write_ids(rows, tokens.Scratch(spark, "t"))
        assert tokens.with_starts(files, tokens.digests(files)).count() == n
    by = {(r.doc_id, r.n_shingles): r.component_id for r in jaccard.join(odd).collect()}
    assert by[(5, 9)] == 5 and by[(None, 9)] == 5 and by[(8, 1)] == 7 and by[(2, 0)] == 2


def test_quality_and_toxicity_held_out(spark):
    labels = table(spark, "/root/testdata/sf0.1", "labels")
    d = "/root/testdata/sf0.1"
    q = quality.op1_quality(spark, d).join(labels, "doc_id").where("held_out").toPandas()
    assert ((q.score >= 0.7) == (q.quality == 1)).mean() > 0.95
    t = toxicity.op8_toxicity(spark, d).join(labels, "doc_id").where("held_out").toPandas()
    assert (t.rejected == (t.toxic == 1)).mean() > 0.97


def test_language_model_base_scores(spark, docs):
    got = language_model.op2_language_model(spark, D).toPandas().set_index("doc_id")
    counts: Counter = Counter()
    for i, x in docs.text.items():
        if zlib.crc32(str(i).encode()) % 10:
            counts.update([*x.encode().lower().split(), b""])
    n, v = sum(counts.values()), len(counts)
    for i, x in docs.text.items():
        words = [*x.encode().lower().split(), b""]
        base = sum(math.log10((counts.get(w, 0) + 0.1) / (n + 0.1 * (v + 1))) for w in words)
        assert got.base_score[i] == pytest.approx(base, rel=1e-9) and got.n_known[i] == sum(w in counts for w in words) and got.train_tokens[i] == n
    assert got.score.sum() > got.base_score.sum()


def test_language_model_is_a_probability():
    words = [str(i).encode() for i in range(300)]
    v = language_model.Vocabulary(words, np.arange(300, 0, -1.0), 60_000, 5000, {})
    net = language_model.Network(v)
    every = [np.array([5, 7, i], "int32") for i in range(301)]
    last = net.score(every, v) - net.score([np.array([5, 7], "int32")], v)
    assert sum(10 ** x * (1 if i < 300 else v.tail_z) for i, x in enumerate(last)) == pytest.approx(1, rel=1e-3)


def _plain_spans(texts):
    """Removed sentences by the definition, for sentences that end at a stop and have eight words at most."""
    split = {i: re.findall(r"[^.]+\.\s*", t) for i, t in texts}
    seen, gone = set(), {i: set() for i, _ in texts}
    for i, _ in sorted(texts):
        count = [len(x.split()) for x in split[i]]
        spans_of = []
        for a in range(len(count)):
            ends = [b for b in range(a + 3, len(count) + 1) if sum(count[a:b]) >= 10]
            spans_of += [(a, ends[0])] if ends else []
        tails = [a for a in range(len(count) - 2) if sum(count[a:]) >= 10]
        end = (tails[-1] if tails else 0, len(count))
        spans_of += [end] if count and end not in spans_of else []
        for a, b in spans_of:
            key = " ".join("".join(split[i][a:b]).lower().split())
            if key in seen:
                gone[i].update(range(a, b))
            seen.add(key)
    return {i: (sorted(gone[i]), "".join(p for n, p in enumerate(split[i]) if n not in gone[i]), len(split[i])) for i, _ in texts}


def test_spans_against_brute_force(spark):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(400)]
    sentence = lambda n: " ".join(rng.choices(words, k=n)) + "."
    shared = [[sentence(rng.choice([1, 2, 3, 8])) for _ in range(rng.randrange(1, 9))] for _ in range(12)]
    texts = []
    for i in range(150):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            parts += rng.choice(shared) if rng.random() < 0.5 else [sentence(rng.randrange(1, 9)) for _ in range(rng.randrange(1, 5))]
        texts.append((i, rng.choice([" ", "  "]).join(parts)))
    texts += [(200, "Two of. These."), (201, "two  of. these."), (202, "One two three four five."), (203, "one two three four five."), (204, "One two three four five. "), (205, "A b c d. E f g."), (206, "A b c d. E f g."), (207, "A b c d. E f h.")]
    texts += [(i, "w1 w2 w3 w4 w5 w6 w7 w8. a b c. d. e. f. g.") for i in (300, 301)] + [(302, "Word."), (303, "word.")]
    got = {r.doc_id: (sorted(r.removed), r.text, r.n_sentences) for r in spans.dedup(spark.createDataFrame(texts, "doc_id long, text string").repartition(4)).collect()}
    assert got == _plain_spans(texts)
    assert [got[i][1] for i in (200, 201, 203, 204, 206, 301, 303)] == ["Two of. These.", "", "", "", "", "", ""] and got[207][1]


def test_span_query_keeps_the_rest_of_each_text(spark, docs):
    for r in spans.op3_spans(spark, D).collect():
        parts = spans.sentences(docs.text[r.doc_id])
        assert "".join(parts) == docs.text[r.doc_id] and len(parts) == r.n_sentences and len(r.removed) == r.n_removed
        assert r.text == "".join(p for i, p in enumerate(parts) if i not in set(r.removed))


def test_secrets_against_brute_force(spark, docs):
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    got = secrets.op5_secrets(spark, D).toPandas().set_index("doc_id")
    for i, x in docs.text.items():
        found = [(m.start(), 0, "assign", m.end()) for m in assign.finditer(x) if len(m[2]) >= 6]
        found += [(m.start(), 1, "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", x) if len(m[0]) >= 20]
        found += [(m.start(), 2, "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", x) if len(m[0]) >= 24]
        want = ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(found))
        assert got.base_sha256[i] == hashlib.sha256(want.encode()).hexdigest()


def test_random_tokens_are_added(spark):
    rng = np.random.default_rng(1)
    keys = ["".join(rng.choice(list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"), 48)) for _ in range(20)]
    rows = [(i, f"the key {k} here") for i, k in enumerate(keys)] + [(100, "an internationalization1aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa word")]
    got = {r.doc_id: r.added for r in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(bool(got[i]) for i in range(20)) >= 18 and not got[100]
    assert [(s.start, s.end) for s in got[0]] == [(8, 56)]


def test_mixing(spark):
    got = mixing.op6_mixing(spark, "/root/testdata/sf0.01").toPandas()
    again = mixing.op6_mixing(spark, "/root/testdata/sf0.01").toPandas()
    assert sorted(map(tuple, got.values.tolist())) == sorted(map(tuple, again.values.tolist()))
    by = got.groupby("target").agg(t=("taken", "sum"), n=("source_size", "nunique"))
    assert (abs(by.t / (by.index * by.n) - 1) < 0.02).all() and (got.taken <= 3 * got["size"]).all()
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), (None, 500)], "source string, source_size long")
    assert {r.source: r.target for r in mixing.targets(sizes).collect()} == {"a": 30.0, "b": pytest.approx(1480 * 2 / 3), None: pytest.approx(1480 / 3)}


def test_jaccard_against_brute_force(spark, docs):
    got = jaccard.op7_jaccard(spark, D).toPandas().set_index("doc_id")
    sets = {i: frozenset(tuple(w[j : j + 4]) for j in range(len(w) - 3)) if len(w := x.encode().lower().split()) >= 4 else frozenset([tuple(w)] if w else []) for i, x in docs.text.items()}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                    x, y = sorted((root(a), root(b)))
                    parent[y] = x
    for i in sets:
        assert (got.n_shingles[i], got.component_id[i]) == (len(sets[i]), root(i))


def test_bitmaps_never_rule_a_link_out():
    rng = np.random.default_rng(2)
    for _ in range(300):
        n = int(rng.integers(1, 400))
        a = np.unique(rng.integers(-(2**62), 2**62, n))
        b = np.unique(np.concatenate([a[: int(len(a) * rng.uniform(0.7, 1))], rng.integers(-(2**62), 2**62, int(n * 0.1))]))
        if jaccard.linked(a, b, 85):
            assert jaccard.may_link(jaccard.parity(a), len(a), jaccard.parity(b), len(b), 85)


def test_tokens_round_trip(spark, docs):
    from tokenizers import Tokenizer

    got = tokens.op9_tokens(spark, D).toPandas().sort_values("doc_id")
    tok = Tokenizer.from_file(tokens.vocabulary_path())
    want = [[*e.ids, 2] for e in tok.encode_batch(docs.sort_index().text.tolist(), add_special_tokens=False)]
    assert got.n_tokens.tolist() == [len(w) for w in want]
    assert got.start.tolist() == np.concatenate([[0], np.cumsum([len(w) for w in want])[:-1]]).tolist()
    assert got.ids_crc32.tolist() == [zlib.crc32(np.array(w, "<u4").tobytes()) for w in want]
    for text in ("Xab, c. d.. e,. İ, ß.", "<|EndOfText|> A<|endoftext|>b.", "don't  é 5, x². ́a", "\x0bq\x0c"):
        assert tokens.Encoder(tokens.vocabulary_path()).encode([text])[0].tolist() == [*tok.encode(text, add_special_tokens=False).ids, 2]


def test_ann_recall(spark):
    rows = table(spark, "/root/testdata/sf0.1", "embeddings").toPandas()
    x, ids = np.array(rows.embedding.tolist(), float), rows.vec_id.to_numpy()
    q, v, _ = ann.nearest(x[ids % 100 == 0], ids[ids % 100 == 0], x, ids, 10)
    got = ann.op10_ann(spark, "/root/testdata/sf0.1").toPandas()
    assert len(set(zip(q, v)) & set(zip(got.query_id, got.vec_id))) >= 0.9 * len(q)


def test_ann_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [None, 1.0]), (7, [2.0, 0.0]), (None, [1.0, 1.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = ann.search(vectors, F.col("id") % 100 == 0).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(1, 0.0), (2, 0.0), (7, 1.0)]
    assert ann.search(vectors.where("false"), F.lit(True)).count() == 0


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    assert sorted(map(tuple, queries.QUERIES[name](spark, D).collect())) == sorted(con.sql(queries.SQL[name]).fetchall())
