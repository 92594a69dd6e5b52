"""Edge cases of operators and pipeline stages, and brute-force versions of what SQL can't express."""

import glob
import heapq
import itertools
import math
import os
import random
import re
import string
import time
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import ann, common, decontaminate, jaccard, mixing, secrets, tokens, toxicity
from tessera.llm.common import table

D = "/root/testdata/sf0.001"
LONG = "word thing other more " * 20_000
NAMES = "severity p_toxic rejected n_words hit_words items size target n picks before k component prefix bits one part local_start c taken".split()
ROWS = [
    (1, None, "s"), (2, "", "s"), (2, "", "s"), (3, " \n\t", None), (4, LONG, "t"), (5, "a b c d e f g h i j k l", "t"), (5, "a b c d e f g h i j k l", "t"),
    (5, "quite another text under the same number here", "t"), (None, "A b c d e f g h i j k l", "t"), (None, "one two three", "t"), (7, "a b c", "é"), (9, "x y z", "u"),
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = spark.createDataFrame(ROWS, "doc_id long, text string, source string")
    return rows.select(*rows.columns, *[F.concat(F.lit(f"{n} "), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))).alias(n) for n in NAMES])


def test_odd_rows_and_clashing_names_in_every_stage(spark, odd):
    own = lambda r: all(r[n] == f"{n} {r['doc_id'] if r['doc_id'] is not None else '-'}" for n in NAMES)
    left = {}
    for name, stage in corpus_pipeline.STAGES:
        for rows in (odd, odd.where("false")):
            out = stage(spark, rows, D)
            got = [r.asDict() for r in out.collect()]
            if name == "token_output":
                assert out.columns == [*[c for c in odd.columns if c != "text"], "start", "n_tokens", "ids"]
            else:
                assert out.columns == odd.columns
            assert all(own(r) for r in got)
            left.setdefault(name, got)
        assert not got
    assert len(left["toxicity"]) == len(left["benchmark_decontamination"]) == len(left["token_output"]) == len(ROWS)
    kept = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in left["ngram_jaccard_join"])
    want = [r for i, r in enumerate(ROWS) if i not in (6, 8)]  # the repeated row, and the null id with a copy
    assert kept == sorted((r[0] is None, r[0] or 0, r[1] or "") for r in want)
    assert sorted(r["start"] for r in left["token_output"]) == [int(x) for x in np.cumsum([0, *[r["n_tokens"] for r in sorted(left["token_output"], key=lambda r: r["start"])][:-1]])]


def folders(spark):
    return {p: sorted(os.listdir(p)) for p in glob.glob(f"{common.shared_folder(spark).removeprefix('file://').removeprefix('file:')}/*") if os.path.isdir(p)}


def test_pipeline_leaves_only_its_result(spark):
    before, ids = folders(spark), {r.doc_id for r in table(spark, D, "documents").select("doc_id").collect()}
    out = corpus_pipeline.run(spark, D).toPandas()
    assert len(corpus_pipeline.STAGES) == 5 and set(out.doc_id) <= ids and 0 < len(out) and (out.n_tokens == out.ids.map(len)).all()
    assert [tags for p, tags in folders(spark).items() if p not in before and tags] == [[corpus_pipeline.STAGES[-1][0]]]


def test_labels_of_both_classes_count_as_zero(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 1)], "doc_id long, quality int")
    assert sorted(common.labelled_sample(docs, labels, "quality", 5, 10)) == [("a", 0), ("b", 1)]


def test_seats_are_those_of_the_highest_quotients(spark):
    rng = random.Random(3)
    rows = [(p, i, rng.choice([0, 1, 7, rng.randrange(1, 5000)]), s) for p, s in ((0, 1), (1, 17), (2, 400), (3, 0)) for i in range(30)]
    got = {(r.p, r.i): r.out for r in mixing.sainte_lague(spark.createDataFrame(rows, "p int, i int, w long, s long"), ["p"], "i", "w", "s", "out").collect()}
    for p in range(4):
        own = [(i, w) for q, i, w, _ in rows if q == p]
        seats = next(s for q, _, _, s in rows if q == p)
        heap, won = [(-w, i, 1) for i, w in own if w], dict.fromkeys([i for i, _ in own], 0)
        heapq.heapify(heap)
        weights = dict(own)
        for _ in range(seats):
            _, i, k = heapq.heappop(heap)
            won[i] += 1
            heapq.heappush(heap, (-weights[i] / (2 * k + 1), i, k + 1))
        assert {i: got[p, i] for i, _ in own} == won


def test_one_very_long_token(spark):
    rng = random.Random(1)
    token = "".join(rng.choices(string.ascii_letters + string.digits + "+/", k=1_000_000))
    many = " ".join(f"password=abc{i:06d}" for i in range(50_000))
    docs = spark.createDataFrame([(1, f"a {token} b"), (2, many)], "doc_id long, text string")
    began = time.perf_counter()
    got = {r.doc_id: r for r in secrets.scan(docs).collect()}
    assert time.perf_counter() - began < 90
    assert [(s.start, s.end) for s in got[1].added] == [(2, 1_000_002)]
    assert len(got[2].base) == 50_000 and (got[2].base[-1].start, got[2].base[-1].end) == (19 * 49_999, 19 * 49_999 + 18)


def test_battery_tells_order_from_chance(spark):
    rng = random.Random(2)
    plain = ["abcdefghijklmnopqrstuvwxyz0123456789", "a1" * 15, "0" * 23 + "a", "some-long-file-name_2023_final_version_2", "zyxwvutsrqponmlkjihgfedcba9876543210"]
    chance = ["".join(rng.choices(a, k=40)) for a in (string.ascii_letters + string.digits, string.digits + "abcdef", string.ascii_uppercase + "234567") for _ in range(3)]
    docs = spark.createDataFrame(list(enumerate(plain + chance)), "i int, text string")
    found = secrets._battery(secrets._matches(F.col("text"), secrets.CANDIDATE, 0, 3, "random", 20))
    p = {r.i: r.c[0].p for r in docs.select("i", found.alias("c")).collect()}
    assert min(p[i] for i in range(len(plain))) > 0.05 and max(p[i] for i in range(len(plain), len(p))) < 0.02


def test_benchmark_in_blocks_and_without_items(spark):
    docs = table(spark, D, "documents").select("doc_id", "text")
    bench = table(spark, D, "benchmark")
    whole = {r.doc_id: (r.n_words, sorted(r.hit_words), r["items"]) for r in decontaminate.scan(docs, bench).collect()}
    size, decontaminate.BLOCK_BYTES = decontaminate.BLOCK_BYTES, 2000
    try:
        parts = {r.doc_id: (r.n_words, sorted(r.hit_words), r["items"]) for r in decontaminate.scan(docs, bench).collect()}
    finally:
        decontaminate.BLOCK_BYTES = size
    assert parts == whole and any(w[1] for w in whole.values())
    none = {r.doc_id: (r.n_words, r.hit_words, r["items"]) for r in decontaminate.scan(docs, bench.where("false")).collect()}
    assert none == {i: (w[0], [], []) for i, w in whole.items()}


def test_groups_open_only_by_their_overlap(spark):
    """Prefixes of linked sets share as many tokens as the matrix asks for."""
    rng = np.random.default_rng(5)
    for _ in range(400):
        n = int(rng.integers(1, 60))
        a = rng.choice(100, n, replace=False)
        b = np.unique(np.concatenate([a[: int(n * rng.uniform(0.8, 1))], rng.choice(100, int(rng.integers(0, 4)), replace=False)]))
        a = np.sort(a)
        if len(b) and jaccard.linked(a, b, 85):
            pa, pb = (x[: jaccard.prefix_length(len(x), 85, jaccard.SHARE)] for x in (a, b))
            need = min(jaccard.SHARE, -(-85 * len(a) // 100), -(-85 * len(b) // 100))
            assert len(np.intersect1d(pa, pb)) >= need  # so do any unions that hold them
            assert len(np.intersect1d(pa[: jaccard.prefix_length(len(a), 85)], pb[: jaccard.prefix_length(len(b), 85)])) >= 1


def test_links_that_only_the_matrix_finds(spark):
    """Chains of near copies in one bucket, far from its leaders: brute force gives the same components."""
    rng = random.Random(8)
    shared = [f"s{i}" for i in range(40)]
    rows = []
    for family in range(25):
        words = shared + [f"f{family}_{i}" for i in range(60)]
        for copy in range(4):
            words = list(words)
            words[rng.randrange(len(words))] = f"x{family}_{copy}"
            rows.append((len(rows), " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {i: frozenset(tuple(w[j : j + 4]) for j in range(len(w) - 3)) for i, t in rows for w in [t.split()]}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in sets:
        for b in range(a + 1, len(rows)):
            both = len(sets[a] & sets[b])
            if 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    rounds, jaccard.ROUNDS = jaccard.ROUNDS, 0
    try:
        got = {r.doc_id: r.component_id for r in jaccard.join(docs).collect()}
    finally:
        jaccard.ROUNDS = rounds
    assert got == {i: root(i) for i in sets} and len(set(got.values())) < len(rows)


def test_token_files_can_be_read_in_part(spark):
    docs = table(spark, D, "documents").select("doc_id", "text")
    scratch = common.Scratch(spark, "t")
    files = tokens.write_ids(docs, scratch)
    written = sorted(glob.glob(f"{scratch.root.removeprefix('file://').removeprefix('file:')}/ids/*.parquet"))
    last, groups = -1, 0
    for name in written:
        meta = pq.ParquetFile(name).metadata
        for g in range(meta.num_row_groups):
            groups += 1
            columns = {meta.row_group(g).column(i).path_in_schema: meta.row_group(g).column(i) for i in range(meta.num_columns)}
            ids = next(c for p, c in columns.items() if p.startswith("ids"))
            assert all(any("DICTIONARY" in e or "DELTA" in e for e in c.encodings) for c in (columns["n_tokens"], ids)), (columns["n_tokens"], ids)
            assert all(c.has_column_index and c.has_offset_index for c in columns.values())
            assert columns["doc_id"].statistics.min > last  # row groups in ascending order tell where a document is
            last = columns["doc_id"].statistics.max
    assert groups > 1
    one = files.where("doc_id = 17").select("ids")
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(doc_id,17)" in plan and "ReadSchema: struct<doc_id:bigint,ids:array<int>>" in plan
    assert len(one.collect()) == 1
    assert "ReadSchema: struct<n_tokens:bigint>" in files.select("n_tokens")._jdf.queryExecution().executedPlan().toString()


def test_other_tokenizers_are_encoded_plainly():
    from tokenizers import Tokenizer

    path = tokens.vocabulary_path("byte_bpe_50k.json")
    texts = ["Ab, c.  d..\n\te", "", "ÉÀ 12"]
    ids, counts = tokens.Encoder(path).encode(texts)
    want = [[*e.ids, 2] for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    assert ids.tolist() == [i for w in want for i in w] and counts.tolist() == [len(w) for w in want]
    assert tokens.Encoder(tokens.vocabulary_path()).by_words and not tokens.Encoder(path).by_words


def test_every_query_gets_its_neighbours(spark):
    """Clusters smaller than k: the walk goes on until enough vectors are at hand."""
    rng = np.random.default_rng(4)
    centres = rng.normal(0, 100, (150, 8))
    rows = [(int(i), [float(v) for v in centres[i % 150] + rng.normal(0, 0.01, 8)]) for i in range(600)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    calibrate, ann._calibrate = ann._calibrate, lambda *a: 1
    try:
        got = ann.search(vectors, F.col("id") % 20 == 0).groupBy("query_id").count().collect()
    finally:
        ann._calibrate = calibrate
    assert len(got) == 30 and all(r["count"] == 10 for r in got)


def test_vectors_at_the_ends_of_the_range(spark):
    rows = [(0, [1e200, 0.0]), (1, [1e200, 1e190]), (2, [-1e308, 1e308]), (3, [1.0, 2.0]), (4, [1e-200, 0.0]), (5, [3e-200, 0.0]), (6, [1.0])]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("id").isin(0, 4), k=3)
    by = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in got.collect()}
    assert by[0, 1] == (1, pytest.approx(1e190)) and by[4, 1] == (5, pytest.approx(2e-200)) and by[4, 2] == (3, pytest.approx(5**0.5)) and len(by) == 6


def test_the_tree_grows_with_the_table(spark, monkeypatch):
    rng = np.random.default_rng(6)
    centres = rng.normal(0, 1, (200, 16))
    x = np.repeat(centres, 20, 0) + rng.normal(0, 0.2, (4000, 16))
    vectors = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    trees, calibrate = [], ann._calibrate
    monkeypatch.setattr(ann, "SAMPLE", 500)
    monkeypatch.setattr(ann, "_calibrate", lambda *a: trees.append((a[3], calibrate(*a))) or trees[0][1])
    got = ann.search(vectors, F.col("id") % 20 == 0).collect()
    tree, visits = trees[0]
    assert tree.n_leaves > 40 and visits < tree.n_leaves / 2  # 500 vectors alone make a dozen
    assert sorted(set(tree.assign(x).tolist())) == list(range(tree.n_leaves)) and sorted(tree.visit(x[0], tree.n_leaves)) == list(range(tree.n_leaves))
    q, v, _ = ann.nearest(x[::20], np.arange(0, 4000, 20), x, np.arange(4000), 10)
    assert len(set(zip(q.tolist(), v.tolist(), strict=True)) & {(r.query_id, r.vec_id) for r in got}) >= 0.93 * len(q)


def _rejected(model, text):
    counts = Counter(f for w in re.findall(r"[^\W\d_]+", text.lower()) for f in toxicity.word_features(w) if f in model["weights"])
    eta = sum(model["weights"][f] * math.log1p(n) for f, n in counts.items())
    return 1 / (1 + math.exp(-max(-30, min(30, eta - model["cuts"][0])))) >= toxicity.REJECT


def _first_of_components(rows, size, percent):
    words = {i: t.encode().lower().split() for i, t in rows.items()}
    sets = {i: frozenset(tuple(w[j : j + size]) for j in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else []) for i, w in words.items()}
    root = {i: i for i in rows}
    for a, b in itertools.combinations(sorted(rows), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((root[a], root[b]))
            root = {i: x if r == y else r for i, r in root.items()}
    return {i for i, r in root.items() if i == r}


def _has_window(text, windows):
    words = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.encode().lower())
    return any(tuple(words[i : i + n]) in found for n, found in windows.items() for i in range(len(words) - n + 1))


def test_pipeline_against_a_plain_version(spark):
    """Every stage, on what the one before kept, against loops over all its rows."""
    from tokenizers import Tokenizer

    stages, docs = dict(corpus_pipeline.STAGES), table(spark, D, "documents")
    model = toxicity.learn(docs, table(spark, D, "labels"))
    scratch, rows = common.Scratch(spark, "plain"), {r.doc_id: r for r in docs.collect()}
    texts = {i: r.text for i, r in rows.items()}

    def step(name, frame):
        out = scratch.write(stages[name](spark, frame, D), name)
        return out, sorted(r.doc_id for r in out.select("doc_id").collect())

    kept, ids = step("toxicity", docs)
    assert ids == sorted(i for i, t in texts.items() if not _rejected(model, t)) and len(ids) < len(texts)
    kept, now = step("ngram_jaccard_join", kept)
    assert now == sorted(_first_of_components({i: texts[i] for i in ids}, 5, 80)) and len(now) < len(ids)
    windows: dict = {}
    for r in table(spark, D, "benchmark").collect():
        w = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", r.text.encode().lower())
        n = min(10, len(w))
        windows.setdefault(n, set()).update(tuple(w[i : i + n]) for i in range(len(w) - n + 1) if n)
    windows.pop(0, None)
    kept, clean = step("benchmark_decontamination", kept)
    assert clean == [i for i in now if not _has_window(texts[i], windows)] and len(clean) < len(now)
    kept, mixed = step("source_mixing", kept)
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", texts[i])) for i in clean}
    total = Counter()
    for i in clean:
        total[rows[i].source] += size[i]
    order = sorted(total)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, open_ = {}, set(order)
    left = sum(total.values())
    while True:  # a target stops at three times its source; the excess goes to the others by weight
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level > 3 * total[s]}
        if not full:
            break
        target |= {s: 3 * total[s] for s in full}
        left -= sum(target[s] for s in full)
        open_ -= full
    target |= {s: weight[s] * level for s in open_}
    copies = Counter(mixed)
    for s in order:
        rate, carry = target[s] / total[s], 0.0
        for n in sorted({size[i] for i in clean if rows[i].source == s and size[i]}, reverse=True):
            own = [i for i in clean if rows[i].source == s and size[i] == n]
            want = carry + rate * n * len(own)
            picks = min(math.ceil(rate) * len(own), max(math.floor(rate) * len(own), math.floor(want / n + 0.5)))
            assert abs(sum(copies[i] for i in own) - picks) <= 1e-9 and all(math.floor(rate) <= copies[i] <= math.ceil(rate) for i in own)
            carry = want - picks * n
    kept, last = step("token_output", kept)
    assert last == mixed
    tokenizer, at = Tokenizer.from_file(tokens.vocabulary_path()), 0
    for r in sorted(kept.collect(), key=lambda r: r.start):
        want = [*tokenizer.encode(texts[r.doc_id], add_special_tokens=False).ids, 2]
        assert (r.start, r.n_tokens, list(r.ids)) == (at, len(want), want)
        at += len(want)
    scratch.discard()


def _plain_random_spans(texts):
    """The spans of kind random of each text by the definition: three tests, Stouffer's rule, false discoveries."""
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    tested = []
    for i, text in enumerate(texts):
        base = [m.span() for m in assign.finditer(text) if len(m[2]) >= 6] + [m.span() for m in re.finditer("AKIA[A-Z0-9]{16,}|[0-9a-f]{24,}", text)]
        for m in re.finditer("[A-Za-z0-9+/_-]{20,}", text):
            body, n = m[0], len(m[0])
            if any(a < m.end() and m.start() < b for a, b in base) or not re.search("[0-9]", body) or not re.search("[A-Za-z]", body):
                continue
            k = next(k for k, p in ((16, "[0-9a-f]+|[0-9A-F]+"), (32, "[A-Z2-7]+"), (36, "[A-Z0-9]+|[a-z0-9]+"), (62, "[A-Za-z0-9]+"), (64, ".+")) if re.fullmatch(p, body))
            excess = k * (0.1 if k == 16 else 0.065) - 1
            chi2 = sum(body.count(c) ** 2 for c in set(body)) * k / n - n
            uniformity = (chi2 - (k - 1) - n * excess) / math.sqrt(2 * (k - 1 + 2 * n * excess))
            d = (6 if k == 32 else 10) / k
            change = 2 * d * (1 - d)
            expected, changes = (n - 1) * change, len(re.findall("[0-9]+|[^0-9]+", body)) - 1
            runs = (abs(changes - expected) - 0.5 * expected) / math.sqrt(max(expected * (1 - change), 0.25))
            codes = [ord(c) - sum(map(ord, body)) / n for c in body]
            serial = (abs(sum(a * b for a, b in zip(codes, codes[1:], strict=False)) / sum(c * c for c in codes)) - 0.3) * math.sqrt(n)
            p = math.erfc(-(uniformity + runs + serial) / math.sqrt(3) / math.sqrt(2)) / 2
            tested.append((p, min(400, math.floor(-math.log10(max(p, 1e-30)) * 20)), i, m.span()))
    bins = sorted({b for _, b, _, _ in tested if b > 0 and 10 ** (-b / 20) <= 0.1 * sum(x[1] >= b for x in tested) / len(tested)})
    return sorted((i, span) for p, _, i, span in tested if bins and p <= 10 ** (-bins[0] / 20))


def test_random_spans_against_brute_force(spark):
    rng = random.Random(11)
    alphabets = [string.ascii_letters + string.digits, string.digits + "abcdef", string.ascii_uppercase + "234567", string.ascii_lowercase + string.digits, string.ascii_letters + string.digits + "+/"]
    texts = []
    for i in range(400):
        words = ["".join(rng.choices(string.ascii_lowercase, k=rng.randrange(2, 9))) for _ in range(20)]
        for _ in range(rng.randrange(3)):
            words.insert(rng.randrange(20), rng.choice(["key=", "token: ", "", "", ""]) + "".join(rng.choices(alphabets[i % 5], k=rng.randrange(20, 60))))
        words.insert(3, rng.choice(["a_long_file_name_of_2023_version_2", "some-very-common-slug-with-2-numbers-14", "aaaaaaaaaaaaaaaaaaaaaa1", "w" * 30, "password=" + "abc123" * 5]))
        texts.append(" ".join(words))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted((r.doc_id, (s.start, s.end)) for r in secrets.scan(docs).collect() for s in r.added)
    assert got == _plain_random_spans(texts) and len(got) > 100


def test_base32_keys_are_found_as_often_as_base36(spark):
    rng = random.Random(8)
    chance = {k: ["".join(rng.choices(a, k=40)) for _ in range(60)] for k, a in ((32, string.ascii_uppercase + "234567"), (36, string.ascii_uppercase + string.digits))}
    found = secrets._battery(secrets._matches(F.col("text"), secrets.CANDIDATE, 0, 3, "random", 20))
    rows = spark.createDataFrame([(k, t) for k, ts in chance.items() for t in ts], "k int, text string").select("k", F.element_at(found, 1)["p"].alias("p")).collect()
    low = {k: sorted(r.p for r in rows if r.k == k)[30] for k in chance}
    assert low[32] < 10 * low[36]


def test_the_normal_tail_is_right(spark):
    zs = [-30.0, -12.0, -8.0, -6.0, -3.0, -1.0, 0.0, 0.5, 2.0, 6.0]
    for r in spark.createDataFrame([(z,) for z in zs], "z double").select("z", secrets._normal_below(F.col("z")).alias("p")).collect():
        assert r.p == pytest.approx(math.erfc(-r.z / math.sqrt(2)) / 2, rel=1e-6)


def test_many_candidates_and_base_spans_in_one_text(spark):
    """A text of token lines: time in proportion to the lines, and only tokens apart from base spans are kept."""
    rng = random.Random(4)
    line = lambda: f"token={''.join(rng.choices('abcdef0123456789', k=8))} x {''.join(rng.choices(string.ascii_letters + string.digits, k=24))}"

    def took(n):
        docs = spark.createDataFrame([(1, "\n".join(line() for _ in range(n)))], "doc_id long, text string")
        began = time.perf_counter()
        row = secrets.scan(docs).first()
        assert len(row.base) == n and all(s.end - s.start == 24 for s in row.added) and len(row.added) > n // 2
        return time.perf_counter() - began

    took(1000)
    assert took(32_000) < 8 * max(took(8000), 2)


def test_merged_halves_lose_no_group():
    """Two members share SHARE tokens of which two have equal low halves; a member without such halves lowers nothing."""
    rng = np.random.default_rng(2)
    low = rng.integers(0, 1 << 31, jaccard.SHARE - 1)
    tokens = np.concatenate([low, low[:1] + (7 << 32)])
    halves = tokens.astype("int32")
    merged = len(halves) - len(np.unique(halves))
    shared = len(np.intersect1d(np.unique(halves), np.unique(halves)))
    big = np.array([1000])
    assert merged == 1 and shared >= jaccard.needed_overlap(big, big, np.array([merged]), np.array([merged]), 85)[0]
    assert jaccard.needed_overlap(big, big, np.array([merged]), np.array([0]), 85)[0] == jaccard.SHARE


def test_sizes_in_chunks_give_the_same_copies(spark, monkeypatch):
    rng = random.Random(12)
    rows = [(i, rng.choice("ab"), "w " * rng.randrange(1, 60)) for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    copies = lambda: sorted((r.doc_id, r["__copies"]) for r in mixing.whole_documents(docs).collect())
    whole = copies()
    monkeypatch.setattr(mixing, "CHUNK", 7)
    assert copies() == whole and len({c for _, c in whole}) > 1


def test_a_block_discards_its_own_tables_alone(spark):
    other = common.Scratch(spark, "other")
    kept = other.write(spark.range(3), "t")
    with common.Owned() as outer:
        before = common.Scratch(spark, "before").write(spark.range(2), "t")
        with common.Owned() as own:
            common.Scratch(spark, "own").write(spark.range(1), "t")
            path = own.held[0].path("t").removeprefix("file://").removeprefix("file:")
        assert os.path.exists(path)
        own.discard()
        assert not os.path.exists(path) and before.count() == 2 and len(outer.held) == 1
    assert kept.count() == 3
