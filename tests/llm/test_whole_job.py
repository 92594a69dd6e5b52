"""Tests that an operator does its whole job, on planted rows."""

import random
import string
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import common, jaccard, language_model, mixing, secrets, spans
from tessera.llm.common import table


def test_mixed_documents_meet_the_targets(spark):
    for sf, most in (("0.001", 0.02), ("0.01", 0.01)):
        docs = table(spark, f"/root/testdata/sf{sf}", "documents")
        size = mixing.n_words(F.col("text"))
        goals = {r.source: r for r in mixing.targets(docs.groupBy("source").agg(F.sum(size).alias("source_size"))).collect()}
        out = mixing.mixed(spark, docs, "")
        assert out.columns == docs.columns
        kept = {r.source: r.n for r in out.groupBy("source").agg(F.sum(size).alias("n")).collect()}
        missed = sum(abs(kept.get(s, 0) - g.target) for s, g in goals.items())
        assert missed < most * sum(g.target for g in goals.values())
        copies = mixing.whole_documents(docs).select("source", "__copies", size.alias("size")).where("size > 0").collect()
        assert all(g - 1 < c["__copies"] < g + 1 for c in copies for g in [goals[c["source"]].target / goals[c["source"]].source_size])


def test_whole_documents_are_apportioned_by_highest_quotients(spark, monkeypatch):
    """Words to sources and a size's copies to its lines; no line gets other copies than rounded rates."""
    calls, own = [], mixing.sainte_lague

    def seen(rows, part, key, weight, seats, out):
        made = own(rows, part, key, weight, seats, out)
        calls.append((key, made))
        return made

    monkeypatch.setattr(mixing, "sainte_lague", seen)
    monkeypatch.setattr(mixing, "LINE", 7)
    docs = spark.createDataFrame([(i, "ab"[i % 3 == 0], "w " * (1 + i % 4)) for i in range(600)], "doc_id long, source string, text string")
    out = mixing.whole_documents(docs).cache()
    assert [k for k, _ in calls] == ["source", "line"]
    quotas = {r.source: r.quota for r in calls[0][1].collect()}
    assert sum(quotas.values()) == round(sum(r.target for r in calls[0][1].collect())) == 1500
    size = mixing.n_words(F.col("text"))
    for r in out.groupBy("source").agg(F.sum(size * F.col("__copies")).alias("words"), F.sum(size).alias("whole"), F.min("__copies").alias("low"), F.max("__copies").alias("high")).collect():
        assert abs(r.words - quotas[r.source]) <= 1 and r.low >= quotas[r.source] // r.whole and r.high <= -(-quotas[r.source] // r.whole)
    lines = calls[1][1].collect()
    for source, n in {(r.source, r.size) for r in lines}:
        ours = [r for r in lines if (r.source, r.size) == (source, n)]
        ranked = sorted(((r.m / (2 * k - 1), -r.line) for r in ours for k in range(1, 60)), reverse=True)[: ours[0].picks]
        won = {r.line: sum(-x == r.line for _, x in ranked) for r in ours}
        assert {r.line: r.seats for r in ours} == won and len(ours) > 1


def whole_windows(rows, most=51):
    """Windows of words, by the documents that still hold them whole."""
    seen = {}
    for r in rows:
        w = r.text.lower().split()
        for i in range(len(w) - most + 1):
            seen.setdefault(" ".join(w[i : i + most]), []).append((r.doc_id, i))
    return seen


def test_spans_leave_no_repeated_window(spark):
    rng = random.Random(4)
    new = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    unmarked = [w for w in new(4000) if xxhash.xxh32_intdigest(w) % 4][:60]
    passages = [
        " ".join(f"{w}." for w in new(51)), " ".join(f"{a} {b}!!" for a, b in zip(new(26), new(26), strict=True)), "\n".join(new(55)),
        " ".join(["same"] * 60), " ".join(["two", "words"] * 30), " ".join(unmarked), " ".join(new(51)), " ".join(f"{w} {'x' * (i % 3)}" for i, w in enumerate(new(70))),
    ]
    rows, i = [], 0
    for p in passages:
        for _ in range(3):
            rows.append((i, " ".join(new(rng.randrange(30))) + " " + p + " " + " ".join(new(rng.randrange(30)))))
            i += 1
    docs = spark.createDataFrame([*rows, (i, passages[0]), (i + 1, passages[5])], "doc_id long, text string").repartition(3)
    got = spans.dedup(docs).collect()
    before, after = whole_windows(docs.collect()), whole_windows(got)
    assert sum(len({d for d, _ in at}) > 1 for at in before.values()) >= len(passages)
    assert not [w for w, at in after.items() if len(at) > 1]
    real = spans.dedup(table(spark, "/root/testdata/sf0.001", "documents").where("text is not null")).collect()
    originals = whole_windows(table(spark, "/root/testdata/sf0.001", "documents").where("text is not null").collect())
    assert not [w for w, at in whole_windows(real).items() if len(at) > 1 and len(originals.get(w, ())) > 1]


def test_language_model_learns_from_every_document(spark):
    line = "one two three four five six seven eight nine ten "
    docs = spark.createDataFrame([(i, line * 4000) for i in range(3)], "doc_id long, text string")
    learned, every = [], language_model.learn_all
    language_model.learn_all = lambda *a: learned.append(every(*a))
    try:
        got = language_model.score(docs, F.lit(True)).collect()
    finally:
        language_model.learn_all = every
    assert learned == [3 * 40_001] and got[0].train_tokens == learned[0]
    # each word follows from the one before; the counts alone give about one digit a word
    assert all(r.score > 0.9 * r.base_score for r in got)


def test_plain_long_words_are_no_hypotheses_of_secrets(spark):
    rng = random.Random(2)
    keys = ["".join(rng.choices(string.ascii_letters + string.digits, k=21)) for _ in range(10)]
    words = [(100 + i, "".join(rng.choices("etaoinshrdlu", k=30))) for i in range(40000)]
    docs = spark.createDataFrame([*enumerate(keys), *words], "doc_id long, text string")
    got = {r.doc_id: r.added for r in secrets.scan(docs).collect()}
    assert sum(bool(got[i]) for i in range(10)) >= 8 and not any(got[i] for i, _ in words)


def test_language_model_without_training_documents(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None), (3, "")], "doc_id long, text string")
    got = {r.doc_id: r for r in language_model.score(docs, F.lit(False)).collect()}
    # every word is unknown: c = N = V = 0, so each token has probability one
    assert all(r.n_known == 0 and r.train_tokens == 0 and r.base_score == 0 and abs(r.score) < 1e-5 for r in got.values())
    assert [got[i].n_tokens for i in (1, 2, 3)] == [3, 1, 1]


def test_network_gradient_is_that_of_its_loss():
    words = [str(i).encode() for i in range(100)]
    v = language_model.Vocabulary(words, np.arange(100, 0, -1.0), 10_000, 500, {})
    net = language_model.Network(v)
    rng = np.random.default_rng(1)
    hs = np.hstack([rng.uniform(-1, 1, (40, language_model.HIDDEN)), np.ones((40, 1))]).astype("float32")
    of = rng.integers(0, 101, 40).astype("int32")
    grad = {}
    _, _, dh = net.loss(hs, of, v, grad)
    total = lambda: -float(sum(x.astype("float64").sum() for x in net.loss(hs, of, v)[:2]))
    for name, at in (("c", (3, 1)), ("bc", (0,)), ("w", (0, 2, 5)), ("bw", (1, 3))):
        net.p[name][at] += 0.01
        up = total()
        net.p[name][at] -= 0.02
        down = total()
        net.p[name][at] += 0.01
        assert grad[name][at] == pytest.approx((up - down) / 0.02, abs=0.02)
    hs[7, 4] += 0.01
    up = total()
    hs[7, 4] -= 0.02
    assert dh[7, 4] == pytest.approx((up - total()) / 0.02, abs=0.02)


def test_training_by_windows_equals_one_window():
    """Carried states and gradients: a network trained in windows learns a period that spans them."""
    words = [str(i).encode() for i in range(8)]
    v = language_model.Vocabulary(words, np.full(8, 100.0), 800, 8, {})
    net = language_model.Network(v)
    docs = [np.arange(i, i + 400, dtype="int32") % 8 for i in range(8)]
    before = net.score(docs, v).sum()
    moments = {}
    for _ in range(20):
        net.train(docs, v, 0.01, moments)
    assert net.score(docs, v).sum() > 0.2 * before


def test_parameters_are_averaged_in_a_tree(spark, monkeypatch):
    """Nodes of two copies give what one node of all gives, up to rounding."""
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * j) % 7}" for j in range(300))) for i in range(12)], "doc_id long, text string").repartition(6).cache()
    score = lambda: {r.doc_id: r.score for r in language_model.score(docs, F.lit(True)).collect()}
    whole = score()
    monkeypatch.setattr(language_model, "FAN", 2)
    assert score() == pytest.approx(whole, rel=1e-3)


def test_jaccard_holds_no_table_that_is_read_no_more(spark, monkeypatch):
    """When groups are opened, the tables of earlier steps are gone, and the components are those of brute force."""
    live, write = {}, common.Scratch.write

    def watched(self, df, tag, *rest, **options):
        live[tag] = set(self.written)
        return write(self, df, tag, *rest, **options)

    monkeypatch.setattr(jaccard, "ROUNDS", 0)
    monkeypatch.setattr(common.Scratch, "write", watched)
    rng, rows = random.Random(4), {}
    for family in range(6):
        start = [f"w{rng.randrange(5000)}" for _ in range(60)]
        for i in range(9):  # one changed word leaves a link to the first text, more do not
            changed = rng.sample(range(4, 56), max(0, i - 2)) if i > 3 else [9 * i] * (i > 0)
            rows[10 * family + i] = [f"x{family}-{i}" if j in changed else w for j, w in enumerate(start)]
    sets = {i: {tuple(w[j : j + 4]) for j in range(57)} for i, w in rows.items()}
    smallest = {i: i for i in rows}
    for _ in rows:
        for a in rows:
            for b in rows:
                if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                    smallest[a] = min(smallest[a], smallest[b])
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in rows.items()], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in jaccard.join(docs).collect()} == smallest
    assert not live["inside"] & {"buckets", "shared", "rows-1", "mixed-1", "matrix"}
    assert not live["named"] & {"inside", "groups", "opened"}


def test_gates_take_no_tanh_and_keep_their_limits(monkeypatch):
    """The gates are those of the formulas, also for inputs whose exp overflows, and come from exp alone."""
    words = [str(i).encode() for i in range(8)]
    v = language_model.Vocabulary(words, np.full(8, 100.0), 800, 8, {})
    net = language_model.Network(v)
    k, rng = language_model.HIDDEN, np.random.default_rng(1)
    h, x = rng.uniform(-1, 1, (k, 5)), rng.normal(0, 2, (5, 3 * k))
    x[0], x[1] = 500, -500
    hu = net.p["u"].T @ h + net.p["bu"][:, None]
    z, r = np.split((1 + np.tanh((x.T[: 2 * k] + hu[: 2 * k]) / 2)) / 2, 2)
    n = np.tanh(x.T[2 * k :] + r * hu[2 * k :])
    monkeypatch.setattr(np, "tanh", None)
    with np.errstate(all="raise", under="ignore"):
        after = net.step(h.astype("float32"), x.astype("float32"))[0]
    assert np.allclose(after, n + z * (h - n), atol=1e-5)


def test_words_are_cut_and_numbered_by_columns():
    """Arrow's kernels give the words, numbers and lost words of the plain way, for any bytes."""
    odd = [b"", None, b"  a B\tc\x0b d\x0c ", b"\xff\xfe A\xc3\x84 \xe2\x80\x83x\x00y\x1c z", b" ", b"one", b"\n\r x \n", b"zz zz q ZZ", "É ÀZ   q".encode()]
    rng = random.Random(8)
    texts = [*odd, *(" ".join(f"w{int(rng.expovariate(0.001))}" for _ in range(2000)).encode() for _ in range(100))]
    known = [b"", b"a", b"x", *(f"w{i}".encode() for i in range(3000))]
    for words in (known, known[1:], []):  # the end's number is lost in the last two
        v = language_model.Vocabulary(words, np.ones(len(words)), 10_000, 4000, {})
        plain = [language_model.words_of(x or b"") for x in texts]
        numbers = [language_model.numbers(v, x) for x in plain]
        lost = [Counter(x for x in [*own, b""] if x not in v.number) for own in plain]
        parts = [language_model.split_words(pa.array(x, pa.binary())) for x in (texts[:5], texts[5:])]
        cut, sizes = [x for x, _ in parts], [x for _, x in parts]
        flat, starts = language_model.numbers_of_texts(v, pa.array(v.words, pa.binary()), cut, sizes)
        of, rest, n = language_model.lost_words(flat, starts, cut, len(words))
        assert [x for part in cut for x in part.to_pylist()] == [x for own in plain for x in own]
        assert np.array_equal(flat, np.concatenate(numbers)) and np.diff(starts).tolist() == [len(x) for x in numbers]
        found = {(i, x): m for i, x, m in zip(of.tolist(), rest.to_pylist(), n.tolist(), strict=True)}
        assert len(found) == len(of) and found == {(i, x): m for i, own in enumerate(lost) for x, m in own.items()}


def test_training_follows_the_gradient_of_whole_documents(monkeypatch):
    """One window over lanes of unlike lengths, with documents that begin within a lane: the gradient is that
    of the sum of the documents' losses, each from a state of zeros."""
    v = language_model.Vocabulary([str(i).encode() for i in range(100)], np.arange(100, 0, -1.0), 10_000, 500, {})
    net, k, rng = language_model.Network(v), language_model.HIDDEN, np.random.default_rng(2)
    docs = [rng.integers(0, 101, n).astype("int32") for n in (20, 3, 9, 1, 14, 2)]

    def total() -> float:
        out = 0.0
        for doc in docs:
            h = np.zeros((k, 1), "float32")
            for word in doc:
                log_c, inner, _ = net.loss(np.append(h[:, 0], np.float32(1))[None], np.array([word], "int32"), v)
                out -= float(log_c[0]) + float(inner[0])
                h = net.step(h, net.p["x"][v.inputs[[word]]])[0]
        return out

    lanes, moments, start = language_model.lanes, {}, net.flat()
    monkeypatch.setattr(language_model, "lanes", lambda docs, _: lanes(docs, 3))
    net.train(docs, v, 0.0, moments)
    assert np.array_equal(net.flat(), start) and moments["steps"] == 1
    ratios = []
    for name in ("x", "u", "bu", "c", "bc", "w", "bw"):
        mean = moments["mean"][name]
        for at in np.abs(mean).ravel().argsort()[-4:]:
            at = np.unravel_index(at, mean.shape)
            held = net.p[name][at]
            net.p[name][at] = held + np.float32(0.02)
            up = total()
            net.p[name][at] = held - np.float32(0.02)
            ratios.append(float(mean[at]) / ((up - total()) / 0.04))
            net.p[name][at] = held
    assert ratios == pytest.approx([np.median(ratios)] * len(ratios), rel=0.03) and np.median(ratios) > 0
