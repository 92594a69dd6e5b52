"""Infilling, ranked search and byte pairs against plain versions of their contracts."""

import base64
import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import byte_pairs, infill, ranked
from tessera.llm.common import Scratch, table

D = "/root/testdata/sf0.001"
LONG = "word thing  other\tmore \n" * 20_000
ODD = [
    (1, None), (2, ""), (3, " \n\t"), (4, LONG), (5, "a b c d e f"), (5, "a b c d e f"), (None, "A b c d"), (None, None), (7, "é ü ß  "),
    (8, "x <P> y"), (9, "a<<S"), (10, ">b <S"), (11, "<P"), (12, "> <M>"), (13, "<M"), (14, "日本 語\U0001f600 "), (15, "a" * 3000), (16, "-----  ==== '''s"),
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = spark.createDataFrame(ODD, "doc_id long, text string")
    return rows.withColumns({"n": F.lit("x"), "t": F.lit(1), "h0": F.lit(1), "ids": F.lit(2), "form": F.lit("q"), "score": F.lit(3)}).repartition(3)


# --- infilling -----------------------------------------------------------------------------------------


def plain_infill(doc_id, text):
    text = text or ""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 80:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def test_infill_odd_rows(odd):
    for rows, n in ((odd, len(ODD)), (odd.where("false"), 0)):
        made = infill.restore(infill.infill(rows)).collect()
        assert Counter((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in made) == Counter((i, *plain_infill(i, t)) for i, t in ODD[:n])
        assert Counter((r["doc_id"], r["restored"]) for r in made) == Counter((i, t or "") for i, t in ODD[:n])


def test_infill_every_form_of_odd_texts(spark):
    """Each text under many ids, so that each form and many cuts occur."""
    texts = [t for _, t in ODD if t and len(t) < 5000]
    rows = [(i, texts[i % len(texts)]) for i in range(1500)]
    made = infill.restore(infill.infill(spark.createDataFrame(rows, "doc_id long, text string"))).collect()
    assert {r["form"] for r in made} == {"plain", "spm", "psm"}
    assert {(r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"], r["restored"]) for r in made} == {(i, *plain_infill(i, t), t) for i, t in rows}


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("<PSM> \ta é\n"), max_size=12), min_size=1, max_size=8), st.integers(0, 10**6))
def test_infill_kernel(texts, seed):
    draw = [np.array([random.Random(f"{seed}{i}{j}").randrange(2**32) for j in range(len(texts))]) for i in range(4)]
    sliced = pa.array(["ahead", *texts, "behind"]).slice(1, len(texts))  # an array that starts inside its buffer
    n, form, _, _, output = infill._infill(sliced, draw, 100, 50)
    assert n.to_pylist() == [len(re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", t)) for t in texts]
    assert [f == "plain" for f in form.to_pylist()] == [not t or any(m in t for m in ("<P>", "<S>", "<M>")) for t in texts]
    assert infill._restored(output, np.array(form.to_pylist(), "<U5")).to_pylist() == texts


def test_infill_query_matches_plain(spark):
    docs = {r["doc_id"]: r["text"] for r in table(spark, D, "documents").collect()}
    for r in infill.op11_infill(spark, D).collect():
        n, form, prefix, middle, output = plain_infill(r["doc_id"], docs[r["doc_id"]])
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"]) == (n, form, prefix, middle)
        assert r["output_sha256"] == hashlib.sha256(output.encode()).hexdigest()
        assert r["restored_sha256"] == hashlib.sha256((docs[r["doc_id"]] or "").encode()).hexdigest()


# --- ranked search -------------------------------------------------------------------------------------


def plain_search(docs, items, k=50):
    split = lambda t: re.findall(ranked.TERM, re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    held = [(i, Counter(w)) for i, t in docs if (w := split(t))]
    n, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    queries = {}
    for i, t in items:
        queries.setdefault(i, set()).update(split(t))
    found = []
    for item, terms in queries.items():
        scores = []
        for doc_id, c in held:
            m = 50 + 50 * sum(c.values()) * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in terms if t in c)
            if s > 0:
                scores.append((-s, doc_id is None, doc_id or 0))
        found += [(item, rank, None if null else doc_id, -s) for rank, (s, null, doc_id) in enumerate(sorted(scores)[:k], 1)]
    return found


def rows_of(df):
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect()), key=str)


@pytest.mark.parametrize(("shard", "block", "k"), [(ranked.SHARD_BYTES, ranked.BLOCK_TERMS, 50), (2_000, 60, 3), (1, 150, 1)])
def test_ranked_matches_plain(spark, shard, block, k):
    """Shards of a document or so and blocks of a term or so give what one shard and one block give."""
    docs = [(r["doc_id"], r["text"]) for r in table(spark, D, "documents").collect()] + [(i, t) for i, t in ODD if i != 4]
    items = [(r["item_id"], r["text"]) for r in table(spark, D, "benchmark").collect()][:12] + [(900, None), (901, ""), (902, "a b"), (902, "d A"), (None, "b"), (903, "unheardof")]
    index = ranked.build_index(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), Scratch(spark, "t"), shard_bytes=shard)
    made = ranked.search(index, spark.createDataFrame(items, "item_id long, text string").withColumn("term", F.lit(1)), k=k, block_terms=block)
    assert rows_of(made) == sorted(plain_search(docs, items, k), key=str)


def test_ranked_empty_tables(spark, odd):
    items = spark.createDataFrame([(1, "word")], "item_id long, text string")
    nothing = ranked.build_index(odd.where("false"), Scratch(spark, "t"))
    assert ranked.search(nothing, items).collect() == []
    index = ranked.build_index(odd, Scratch(spark, "t"))
    assert ranked.search(index, items.where("false")).collect() == []
    assert [(r["item_id"], r["rank"], r["doc_id"]) for r in ranked.search(index, items).collect()] == [(1, 1, 4)]


def test_max_score_leaves_postings_alone():
    """Probing counts: with a floor in reach of the rare term alone, the common term's postings are not scored."""
    m = np.full(1000, 100, "int64")
    part = ranked._part(np.array([1]), m[:1])[0]
    rare = (50 * int(part), 50, np.array([7, 500], "int32"), np.array([1, 1], "int32"))
    common = (3 * int(part), 3, np.arange(1000, dtype="int32"), np.ones(1000, "int32"))
    found, score = ranked.max_score([common, rare], m, floor=10 * int(part), k=5)
    assert found.tolist() == [7, 500] and score.tolist() == [53 * part] * 2
    full, scores = ranked.max_score([common, rare], m, floor=1, k=5)
    assert len(full) == 1000 and sorted(scores.tolist())[-2:] == [53 * part] * 2


def test_row_groups_hold_few_shards(spark):
    """A reader holds a row group, so its size is bounded, however many shards a file has."""
    from pathlib import Path

    import pyarrow.parquet as pq

    scratch = Scratch(spark, "t")
    docs = spark.createDataFrame([(i, " ".join(f"w{i}x{j}" for j in range(300_000))) for i in range(12)], "doc_id long, text string").coalesce(1)
    assert ranked.build_index(docs, scratch, shard_bytes=1).count() == 12
    files = list(Path(scratch.path("index").removeprefix("file://").removeprefix("file:")).glob("*.parquet"))
    meta = [pq.ParquetFile(f).metadata for f in files]
    assert sum(m.num_rows for m in meta) == 12
    assert max(m.row_group(i).total_byte_size for m in meta for i in range(m.num_row_groups)) < 64 << 20


# --- byte pairs ----------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def plain():
    import public_tokenizers as P
    import tiktoken

    with open(P.path(byte_pairs.VOCABULARY), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def own():
    return byte_pairs.Encoder(byte_pairs.vocabulary_path(), byte_pairs._pattern())


def encoded(own, texts):
    ids, counts = own.encode(texts)
    return [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] if texts else []


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=40), st.text(st.sampled_from("aābeinrst -=\n'0"), max_size=60)), max_size=12))
def test_byte_pairs_as_the_library(plain, own, texts):
    texts = [t for t in texts if t.isprintable() or not any(0xD800 <= ord(c) < 0xE000 for c in t)]
    assert encoded(own, texts) == [plain.encode_ordinary(t) for t in texts]


def test_runs_and_very_long_words(plain, own):
    texts = ["a" * 5000, "ab" * 3000, " " * 4000 + "x", "=" * 999, "\n" * 77, "0" * 1234, "é" * 2001, "<|endoftext|>", "", "日本語" * 500, "haha" * 1000]
    texts += ["".join(random.Random(i).choices("abcdefghijklmnopqrstuvwxyz", k=2000)) for i in range(20)]
    assert encoded(own, texts) == [plain.encode_ordinary(t) for t in texts]
    ids, counts = own.encode(texts)
    data, ends = own.decode(ids, counts)
    assert [bytes(x).decode() for x in np.split(data, ends[1:-1])] == texts if len(ends) == len(texts) + 1 else bytes(data).decode() == "".join(texts)


def test_replay_equals_one_word_at_a_time(own):
    rng = random.Random(5)
    words = list({bytes(rng.choices(b"abcehinorst\xc3\xa9\xd0\xb0", k=rng.randrange(1, 30))) for _ in range(3000)})
    ids, counts = own.merges.replay(words)
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [own.merges.alone(w) for w in words]


def test_pairs_whose_turn_is_over(tmp_path):
    """A vocabulary in which a merge makes a pair of lower rank than its own."""
    tokens = [bytes([b]) for b in range(256)] + [b"xab", b"bc", b"ab", b"xa"]
    path = tmp_path / "ranks"
    path.write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % i for i, t in enumerate(tokens)))
    merges = byte_pairs.Merges(str(path))
    words = [b"xab", b"xabxab", b"abc", b"xabcxab", b"abab", b"xaxab", b"q"]
    import tiktoken

    plain = tiktoken.Encoding("t", pat_str=r"\w+", mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    ids, counts = merges.replay(words)
    made = [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]
    assert made == [merges.alone(w) for w in words]
    assert [m for m, w in zip(made, words, strict=True) if w not in tokens] == [plain.encode_ordinary(w.decode()) for w in words if w not in tokens]


def test_cache_overflow_changes_nothing(plain, monkeypatch):
    monkeypatch.setattr(byte_pairs, "CACHE", 5)
    monkeypatch.setattr(byte_pairs, "GROUP_CHARS", 30)
    monkeypatch.setattr(byte_pairs, "REPLAY_BYTES", 8)
    own = byte_pairs.Encoder(byte_pairs.vocabulary_path(), byte_pairs._pattern())
    texts = ["Some words are here", "and words are there", "", "once more: some other words"]
    for _ in range(2):
        assert encoded(own, texts) == [plain.encode_ordinary(t) for t in texts]


def test_byte_pairs_odd_rows(spark, odd, plain):
    for rows, n in ((odd, len(ODD)), (odd.where("false"), 0)):
        made = byte_pairs.decode(byte_pairs.encode(rows)).collect()
        assert Counter((r["doc_id"], tuple(r["ids"]), bytes(r["decoded"]).decode()) for r in made) == Counter((i, tuple(plain.encode_ordinary(t or "")), t or "") for i, t in ODD[:n])
    assert byte_pairs.decode(spark.createDataFrame([(None,)], "ids array<int>")).first()["decoded"] == b""


def test_unknown_ids_raise(spark):
    for ids in ([60_000], [-1], [1, None]):
        with pytest.raises(Exception, match="vocabulary lacks|null among ids"):
            byte_pairs.decode(spark.createDataFrame([(ids,)], "ids array<int>")).collect()


def test_byte_pair_query_matches_library(spark, plain):
    docs = {r["doc_id"]: r["text"] or "" for r in table(spark, D, "documents").collect()}
    made = byte_pairs.op13_byte_pairs(spark, D).collect()
    assert len(made) == len(docs)
    for r in made:
        ids = plain.encode_ordinary(docs[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(docs[r["doc_id"]].encode()).hexdigest()
