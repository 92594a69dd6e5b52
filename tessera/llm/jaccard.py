"""Exact Jaccard join of word-shingle sets with a token-group matrix.

Documents with one word sequence collapse to a representative. Each set's prefix, its rarest tokens,
meets every partner at the threshold; a longer prefix holds at least SHARE tokens of every partner
(fewer where a smaller overlap is enough to link). Similar documents of like size form groups of
bounded size with the union of their longer prefixes. The token-group matrix tells which groups meet;
the tokens that their unions share bound the overlap of any two members, and only groups that reach
the least overlap at which members could link are opened and their members verified exactly.

Links are only needed between components: in each round the documents of a token's bucket are
compared with one leader (a star, not all pairs); after that, whole groups of the query's own
component are skipped, so a large family of copies is not compared pair by pair.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, map_texts, small_batches, table

SHINGLE = 4
PERCENT = 85
GROUP = 32
ROUNDS = 2
#: Tokens that the longer prefixes of two linked sets share at least.
SHARE = 6
#: Frequent shingles that the token order knows; a bound, as any fixed order gives the same links.
FREQUENT = 300_000
#: Shingle hashes that a task counts at once.
COUNTED = 1_500_000
#: Hot tokens: those with over this share of all rows, fewer than HOT; their rows are not shuffled by token.
HOT = 1000
GROUP_BYTES = 1 << 18
MOST_BITS = 1 << 14
#: Odd multipliers of the 64-bit hashes.
P, Q, R, S = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_VALUES = np.random.default_rng(0x5EED).integers(1, 1 << 63, 256, dtype="uint64") * np.uint64(2) + np.uint64(1)
_VALUES[65:91] = _VALUES[97:123]  # A-Z count as a-z
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64."""
    held = _powers.get(base)
    if held is None or len(held) < n:
        held = np.full(max(n, GROUP_BYTES + 1), base, "uint64")
        held[0] = 1
        _powers[base] = held = np.cumprod(held, dtype="uint64")
    return held[:n]


def _segments(values: np.ndarray, base: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sum of values[i] * base ** (i - start) over each segment, from one running sum."""
    total = np.concatenate([np.zeros(1, "uint64"), np.cumsum(values * _power(base, len(values)), dtype="uint64")])
    inverse = pow(base, -1, 1 << 64)
    return (total[ends] - total[starts]) * _power(inverse, len(values) + 1)[starts]


def _mix(h: np.ndarray, by: int) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(by)
    return h ^ (h >> np.uint64(29))


def hashed(texts: list[bytes], size: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """For each text its number of words, the 64-bit hash of its word sequence and its sorted distinct
    shingle hashes. Whole groups of texts are hashed in vector operations; no word becomes an object.

    Words are split at ASCII white space, A-Z count as a-z. Fewer words than ``size`` make one shingle.
    """
    group: list[bytes] = []
    held = 0
    for i, text in enumerate(texts):
        group.append(text)
        held += len(text)
        if held > GROUP_BYTES or i + 1 == len(texts):
            yield from _hash_group(group, size)
            group, held = [], 0


def _hash_group(texts: list[bytes], size: int) -> Iterator[tuple[int, int, np.ndarray]]:
    data = np.frombuffer(b" ".join([b"", *texts, b""]), "uint8")
    space = _SPACE[data]
    edge = space[1:] != space[:-1]
    at = np.flatnonzero(edge) + 1
    starts, ends = at[::2], at[1::2]
    words = _mix(_segments(_VALUES[data], P, starts, ends) + (ends - starts).astype("uint64"), R)
    begins = np.cumsum([1] + [len(t) + 1 for t in texts])
    first = np.searchsorted(starts, begins)  # of each text's words, and the end
    n = np.diff(first)
    sequence = _mix(_segments(_mix(words, S), Q, first[:-1], first[1:]) + n.astype("uint64") * np.uint64(R), S).view("int64")
    m = max(0, len(words) - size + 1)
    shingles = np.zeros(m, "uint64")
    for j in range(size):
        shingles = _mix(shingles, P) + words[j : j + m]
    shingles = _mix(shingles, S).view("int64")
    for i in range(len(texts)):
        if n[i] >= size:
            found = np.unique(shingles[first[i] : first[i + 1] - size + 1])
        else:
            found = sequence[i : i + 1] if n[i] else np.zeros(0, "int64")
        yield int(n[i]), int(sequence[i]), found


def prefix_length(n: int, percent: int, share: int = 1) -> int:
    """Tokens of a set of n that hold ``share`` tokens of every set that it links with.

    Linked sets have ceil(percent * n / 100) tokens in common at least; where that is fewer than
    ``share``, the prefix is the whole set and holds that many.
    """
    common = -(-percent * n // 100)
    return n - common + min(share, common) if n else 0


def parity(tokens: np.ndarray) -> bytes:
    """A bitmap with as many bits as the set has tokens or up to twice that; a bit tells whether an
    odd number of tokens fall on it. Two sets differ in as many tokens at least as their bitmaps do."""
    n = 64
    while n < len(tokens) and n < MOST_BITS:
        n *= 2
    return np.packbits(np.bincount(tokens & (n - 1), minlength=n) & 1, bitorder="little").tobytes()


def may_link(a: bytes, na: int, b: bytes, nb: int, percent: int) -> bool:
    """False only where sizes or bitmaps rule a link out; the longer bitmap folds to the other's length.

    J >= p means that the sets differ in (1 - p) / (1 + p) of the sum of their sizes at most.
    """
    if 100 * min(na, nb) < percent * max(na, nb):
        return False
    x, y = np.frombuffer(a, "uint64"), np.frombuffer(b, "uint64")
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum()) * (100 + percent) <= (100 - percent) * (na + nb)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _frequent(docs: DataFrame, size: int) -> np.ndarray:
    """Pairs (hash, count) of frequent shingles, sorted by hash; they only order tokens.

    A task counts the shingles of its distinct texts and reports those that it has seen twice, so a
    passage that many documents share is known even if no task has many of them. The most frequent
    ones are taken, down to the count at which FREQUENT is reached.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: list[np.ndarray] = []
        seen: set[int] = set()
        held = 0

        def out() -> pa.RecordBatch:
            values = np.concatenate([*sets, np.zeros(0, "int64")])
            sets.clear()
            values.sort()
            same = values[1:] == values[:-1]
            again = values[1:][same]  # one less than its count of each value that repeats
            edges = np.flatnonzero(np.concatenate([again[:1] == again[:1], again[1:] != again[:-1]]))
            counts = np.diff(np.append(edges, len(again))) + 1
            return pa.RecordBatch.from_arrays([pa.array(again[edges]), pa.array(counts.astype("int64"))], names=["h", "n"])

        for b in batches:
            for _, sequence, found in hashed(b.column(0).to_pylist(), size):
                if sequence not in seen:
                    seen.add(sequence)
                    sets.append(found)
                    held += len(found)
            if held > COUNTED:
                yield out()
                held = 0
                if len(seen) > COUNTED:
                    seen.clear()
        yield out()

    texts = docs.select(F.col("text").cast("binary").alias("text")).where("text is not null")
    scratch = Scratch(docs.sparkSession, "frequent")
    counts = scratch.write(texts.mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")), "counts")
    bins = counts.groupBy(F.floor(F.log2("n") * 32).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("m"), F.min("n").alias("n")).orderBy(F.desc("bin")).collect()
    least, held = None, 0
    for r in bins:  # a bounded number of bins
        held += r["m"]
        if held > FREQUENT:
            break
        least = r["n"]
    if least is None:
        scratch.discard()
        return np.zeros((0, 2), "int64")
    top = counts.where(F.col("n") >= least).toArrow()
    scratch.discard()
    rows = np.stack([top.column("h").to_numpy(), top.column("n").to_numpy()], 1)
    return rows[np.argsort(rows[:, 0])]


def _by_token(rows: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows`` joined with ``found`` (one row per token t, nb: its number of rows) on t: the rows of
    hot tokens, which stay in their partitions, and all others, which are shuffled by token."""
    least = max(1, (found.agg(F.sum("nb")).first()[0] or 0) // HOT)
    hot = F.broadcast(found.where(F.col("nb") > least))  # fewer than HOT rows, as their counts sum to the total at most
    cold = rows.join(hot.select("t"), "t", "left_anti").join(found.where(F.col("nb") <= least), "t")
    return rows.join(hot, "t"), cold


def _lists(parts: list[np.ndarray], kind: str) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype("int32")
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*parts, np.zeros(0, kind)])))


def _base(docs: DataFrame, frequent: np.ndarray, size: int, percent: int) -> DataFrame:
    """``docs`` without the text, with k, n, prefix, rare, bits: k is the hash of the word sequence (null
    without words), n the set's size, prefix its rarest tokens, enough to share one with every partner,
    rare the low halves of the tokens behind it, up to those that share SHARE with every partner (``_rare``
    has all of their halves), bits its parity bitmap."""
    held = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(texts: list[bytes]) -> dict:
        known, often = np.ascontiguousarray(held.value[:, 0]), np.ascontiguousarray(held.value[:, 1])
        keys, sizes, prefixes, rare, bits = [], [], [], [], []
        for n_words, sequence, tokens in hashed(texts, size):
            bits.append(parity(tokens))
            m = prefix_length(len(tokens), percent)
            if len(known) and len(tokens):
                place = np.minimum(np.searchsorted(known, tokens), len(known) - 1)
                rank = np.where(known[place] == tokens, often[place], 0)
                if rank.any():
                    tokens = tokens[np.argsort(rank, kind="stable")]
            keys.append(sequence if n_words else None)
            sizes.append(len(tokens))
            prefixes.append(tokens[:m])
            rare.append(tokens[m : prefix_length(len(tokens), percent, SHARE)].astype("int32"))
        return {"k": keys, "n": sizes, "prefix": _lists(prefixes, "int64"), "rare": _lists(rare, "int32"), "bits": bits}

    fields = {"k": T.LongType(), "n": T.LongType(), "prefix": T.ArrayType(T.LongType()), "rare": T.ArrayType(T.IntegerType()), "bits": T.BinaryType()}
    rest = [c for c in docs.columns if c != "text"]
    return map_texts(docs.select(*rest, F.col("text").cast("binary").alias("__b")), run, fields, "__b", keep=rest)


def _rare():
    """The low halves of the longer prefix, of a row of ``_base``."""
    halves = F.transform("prefix", lambda t: F.shiftright(F.shiftleft(t, 32), 32).cast("int"))
    return F.concat(halves, "rare").alias("rare")


def _sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(k, tokens) of the representatives ``wanted`` (k, doc), from their whole texts."""
    texts = docs.select(F.col("doc_id").alias("__d"), F.col("text").cast("binary").alias("__b"))
    joined = wanted.join(texts, F.col("doc").eqNullSafe(F.col("__d"))).where("__b is not null").select("k", "__b")
    schema = T.StructType([T.StructField("k", T.LongType()), T.StructField("tokens", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, tokens = [], []
            for k, (n_words, sequence, found) in zip(b.column(0).to_pylist(), hashed(b.column(1).to_pylist(), size), strict=True):
                if n_words and sequence == k:  # rows that repeat a doc_id may have other texts
                    keys.append(k)
                    tokens.append(found)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), _lists(tokens, "int64")], names=schema.names)

    return joined.mapInArrow(run, schema)


def _possible(pairs: DataFrame, profiles: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that sizes and bitmaps let through; the left one's bitmap is only sent where sizes do."""
    left = profiles.select(F.col("k").alias("a"), F.col("n").alias("na"))
    right = profiles.select(F.col("k").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("bb"))
    rows = pairs.join(left, "a").join(right, "b").where(_compatible(F.col("na"), F.col("nb"), percent))
    rows = rows.join(profiles.select(F.col("k").alias("a"), F.col("bits").alias("ba")), "a").select("a", "b", "na", "nb", "ba", "bb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            na, nb, ba, bb = (b.column(i).to_pylist() for i in range(2, 6))
            good = [may_link(x, n, y, m, percent) for x, n, y, m in zip(ba, na, bb, nb, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    return rows.mapInArrow(run, "a long, b long")


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that link."""
    left = sets.select(F.col("k").alias("a"), F.col("tokens").alias("ta"))
    right = sets.select(F.col("k").alias("b"), F.col("tokens").alias("tb"))
    rows = pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ta, tb = b.column(2), b.column(3)
            xa, xb = ta.flatten().to_numpy(), tb.flatten().to_numpy()
            oa, ob = ta.offsets.to_numpy() - ta.offsets[0].as_py(), tb.offsets.to_numpy() - tb.offsets[0].as_py()
            good = [linked(xa[oa[i] : oa[i + 1]], xb[ob[i] : ob[i + 1]], percent) for i in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    return rows.mapInArrow(run, "a long, b long")


def components(edges: DataFrame, scratch: Scratch, tag: str) -> DataFrame:
    """(k, c) for every node of the edges (a, b): the smallest node that links reach.

    Smallest-neighbour steps and pointer jumps alternate; both shrink long chains fast. Each step is
    written, nothing is collected but the number of changed nodes.
    """
    both = scratch.write(edges.select("a", "b").union(edges.select("b", "a")).distinct(), f"{tag}-edges")
    labels = scratch.write(both.groupBy(F.col("a").alias("k")).agg(F.min("b").alias("m")).select("k", F.least("k", "m").alias("c")), f"{tag}-0")
    step = 0
    while True:
        step += 1
        seen = both.join(labels.select(F.col("k").alias("b"), F.col("c").alias("cb")), "b").groupBy(F.col("a").alias("k")).agg(F.min("cb").alias("m"))
        nearer = labels.join(seen, "k").select("k", F.col("c").alias("old"), F.least("c", "m").alias("c"))
        jump = labels.select(F.col("k").alias("c"), F.col("c").alias("cc"))
        new = scratch.write(nearer.join(jump, "c", "left").select("k", "old", F.least("c", F.coalesce("cc", "c")).alias("c")), f"{tag}-{step}")
        changed = new.where(F.col("c") != F.col("old")).limit(1).count()
        labels = new.select("k", "c")
        scratch.drop(f"{tag}-{step - 1}")
        if not changed:
            scratch.drop(f"{tag}-edges")
            return labels


def _compatible(n, m, percent: int):
    return F.least(n, m) * 100 >= F.greatest(n, m) * percent


def join(docs: DataFrame, text_col: str = "text", size: int = SHINGLE, percent: int = PERCENT, scratch: Scratch | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_shingles, component_id): one row per row of ``docs``; exact but for collisions of
    64-bit hashes. With ``keys``, columns that are kept, also ``component``: a number of its own for each
    component, null without words (component_id may be that of two where rows repeat a doc_id).

    Documents link when 100 * intersection >= percent * union of their shingle sets; component_id is
    the smallest doc_id reachable by links, itself included. Null, empty and wordless texts have
    empty sets and link with nothing; very long texts are hashed whole; an empty table gives no rows.
    Repeated rows and ids each get a row; a null doc_id never becomes a component_id unless its
    component has no other. Other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "jaccard")
    docs = docs.select("doc_id", *keys, F.col(text_col).alias("text"))
    base = scratch.write(_base(docs, _frequent(docs, size), size, percent), "base")
    tokens = base.select("k", F.explode("prefix").alias("t"))
    # tokens of two representatives or more, each with one as its leader; copies count once in min and max
    buckets = scratch.write(tokens.groupBy("t").agg(F.min("k").alias("lk"), F.max("k").alias("uk"), F.count(F.lit(1)).alias("nb")).where("lk < uk").select("t", "lk", "nb"), "buckets")
    scratch.free_shuffles()
    hot, cold = (x.select("t", "k", "lk").distinct() for x in _by_token(tokens, buckets))
    shared = scratch.write(hot.unionByName(cold), "shared")
    scratch.drop("buckets")
    scratch.free_shuffles()
    reps = scratch.write(base.where("k is not null").groupBy("k").agg(F.min("doc_id").alias("doc"), F.min("n").alias("n"), F.first("bits").alias("bits")), "reps")
    members = scratch.write(shared.groupBy("k").agg(F.min("lk").alias("g")).join(reps, "k"), "members")
    sets: DataFrame | None = None

    def verified(pairs: DataFrame, turn: int) -> DataFrame:
        """Those of the pairs that link; texts are read for the sets that no earlier round made."""
        nonlocal sets
        if turn <= ROUNDS:  # the groups are opened with sizes and bitmaps already
            pairs = scratch.write(_possible(pairs, members, percent), f"possible-{turn}")
        wanted = pairs.select(F.col("a").alias("k")).union(pairs.select("b")).distinct()
        if sets is not None:
            wanted = wanted.join(sets.select("k"), "k", "left_anti")
        wanted = scratch.write(wanted.join(members, "k").select("k", "doc"), f"wanted-{turn}")
        if wanted.limit(1).count():
            new = scratch.write(_sets(docs, wanted, size), f"sets-{turn}")
            sets = new if sets is None else sets.unionByName(new)
            scratch.free_shuffles()
        if sets is None:
            return pairs
        found = scratch.write(_verify(pairs, sets, percent), f"edges-{turn}")
        scratch.drop(f"possible-{turn}")
        scratch.drop(f"wanted-{turn}")
        scratch.free_shuffles()
        return found

    stars = shared.where("k <> lk").select(F.col("lk").alias("a"), F.col("k").alias("b")).distinct()
    tried = scratch.write(stars, "tried-0")
    labels = components(verified(tried, 0), scratch, "c0")
    open_rows, last = shared.select("t", "k").join(members.select("k", "n"), "k").select("t", "k", "n"), "shared"

    for turn in range(1, ROUNDS + 2):
        rows = scratch.write(open_rows.join(labels, "k", "left").select("t", "k", "n", F.coalesce("c", "k").alias("c")), f"rows-{turn}")
        scratch.drop(last)
        scratch.free_shuffles()
        # a bucket of one component needs nothing more
        mixed = rows.groupBy("t").agg(F.min("c").alias("c0"), F.max("c").alias("c1"), F.min(F.struct(F.xxhash64("k", F.lit(turn)).alias("h"), F.col("k").alias("k"), F.col("n").alias("n"), F.col("c").alias("c"))).alias("lead"), F.count(F.lit(1)).alias("nb"))
        # nor does one of two documents, which were compared in the first round
        mixed = mixed.where("c0 <> c1 and nb > 2").select("t", F.col("lead.k").alias("lk"), F.col("lead.n").alias("ln"), F.col("lead.c").alias("lc"), "nb")
        hot, cold = _by_token(rows, scratch.write(mixed, f"mixed-{turn}"))
        rows, last = scratch.write(hot.unionByName(cold).drop("nb"), f"open-{turn}"), f"open-{turn}"
        scratch.drop(f"rows-{turn}")
        scratch.drop(f"mixed-{turn}")
        scratch.free_shuffles()
        open_rows = rows.select("t", "k", "n")
        if turn <= ROUNDS:
            pairs = rows.where((F.col("c") != F.col("lc")) & _compatible(F.col("n"), F.col("ln"), percent)).select(F.least("k", "lk").alias("a"), F.greatest("k", "lk").alias("b"))
        else:
            pairs = _open_groups(rows, members, base, scratch, percent)
        pairs = scratch.write(pairs.distinct().join(tried, ["a", "b"], "left_anti"), f"tried-{turn}")
        for tag in ("inside", "opened") if turn > ROUNDS else ():
            scratch.drop(tag)
        if not pairs.limit(1).count():
            continue
        tried = tried.unionByName(pairs)
        edges = verified(pairs, turn)
        between = edges.join(labels.select(F.col("k").alias("a"), F.col("c").alias("ca")), "a", "left").join(labels.select(F.col("k").alias("b"), F.col("c").alias("cb")), "b", "left")
        between = scratch.write(between.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")).where("a <> b").distinct(), f"between-{turn}")
        if not between.limit(1).count():
            continue
        merged = components(between, scratch, f"c{turn}").select(F.col("k").alias("c"), F.col("c").alias("cc"))
        nodes = labels.unionByName(merged.select(F.col("c").alias("k"), F.col("c")).join(labels.select("k"), "k", "left_anti"))
        labels = scratch.write(nodes.join(merged, "c", "left").select("k", F.coalesce("cc", "c").alias("c")), f"labels-{turn}")

    labelled = reps.select("k", "doc").join(labels, "k", "left").select("k", "doc", F.coalesce("c", "k").alias("c"))
    smallest = labelled.groupBy("c").agg(F.min("doc").alias("smallest"))
    named = scratch.write(labelled.join(smallest, "c").select("k", "c", "smallest"), "named")
    scratch.discard("base", "named")
    out = base.select("doc_id", *keys, "k", F.col("n").alias("n_shingles")).join(named, "k", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("smallest", "doc_id").alias("component_id"), *keys, *([F.col("c").alias("component")] if keys else []))


def needed_overlap(la: np.ndarray, lb: np.ndarray, ma: np.ndarray, mb: np.ndarray, percent: int) -> np.ndarray:
    """How many low halves the unions of two groups share at least if members link: SHARE tokens, or as many
    as an overlap of their smallest sets (``la``, ``lb``) has, less what halves may merge. Of a pair's
    shared tokens some have one half only if both of its own prefixes have that twice, at most ``ma`` and
    ``mb`` times in any member."""
    least = np.minimum(-(-percent * la // 100), -(-percent * lb // 100))
    return np.minimum(SHARE, least) - np.minimum(ma, mb)


def _open_groups(rows: DataFrame, members: DataFrame, base: DataFrame, scratch: Scratch, percent: int) -> DataFrame:
    """Pairs of queries and members of the groups that the token-group matrix lets through, as far
    as sizes and bitmaps allow a link.

    A group holds GROUP documents or so of one size band, of one component where that is larger than one
    document. The matrix row of a token and a group has the range of sizes and components of the members
    with it. Queries are asked by group too: two groups meet where they have a token and sizes and
    components allow a link. The tokens that their unions share are an upper bound for what the longer
    prefixes of any two members share, so they are opened only if there are SHARE of them (or as many as
    the smallest overlap of the groups' sizes). Groups meet by token and size band, so a token that very
    many groups have is split by their sizes. Only the unions go to every group that is met, the members
    to those that are opened; what a step has shuffled and no later one reads is given up after it.
    """
    band = F.floor(F.log(F.col("n").cast("double")) / math.log(100 / percent)).cast("int")  # linked sizes are in one band or in neighbours
    held = rows.select("k", "n", "c").distinct().join(members.select("k", "g"), "k").withColumn("band", band)
    sizes = held.groupBy("c").agg(F.count(F.lit(1)).alias("nc"))
    held = held.join(sizes, "c").withColumn("of", F.when(F.col("nc") > 1, F.col("c")).otherwise(F.col("g")))
    counts = held.groupBy("of", "band").agg(F.count(F.lit(1)).alias("no"))
    held = held.join(counts, ["of", "band"]).withColumn("gid", F.xxhash64("of", "band", F.pmod(F.xxhash64("k"), F.ceil(F.col("no") / GROUP))))
    held = scratch.write(held.select("k", "n", "c", "band", "gid"), "groups")
    matrix = rows.select("t", "k").join(held, "k").groupBy("t", "gid", "band").agg(F.min("n").alias("n0"), F.max("n").alias("n1"), F.min("c").alias("c0"), F.max("c").alias("c1"))
    matrix = scratch.write(matrix, "matrix")
    scratch.free_shuffles()
    twice = matrix.withColumn("key", F.explode(F.array(F.col("band"), F.col("band") - 1)))
    bound = F.least(F.col("p.n1"), F.col("m.n1")) * 100 >= F.greatest(F.col("p.n0"), F.col("m.n0")) * percent
    other = (F.col("p.c0") != F.col("p.c1")) | (F.col("m.c0") != F.col("m.c1")) | (F.col("p.c0") != F.col("m.c0"))
    once = (F.col("p.band") != F.col("m.band")) | (F.col("p.gid") <= F.col("m.gid"))
    met = matrix.alias("p").join(twice.alias("m"), (F.col("p.t") == F.col("m.t")) & (F.col("p.band") == F.col("m.key")) & once & bound & other)
    met = scratch.write(met.select(F.col("p.gid").alias("g1"), F.col("m.gid").alias("g2")).distinct(), "met")
    scratch.drop("matrix")
    scratch.free_shuffles()
    rare = base.select("k", _rare()).join(held.select("k"), "k", "left_semi").groupBy("k").agg(F.first("rare").alias("rare"))  # copies have the same
    inside = held.join(members.select("k", "bits"), "k").join(rare, "k").groupBy("gid").agg(  # GROUP documents or so
        F.collect_list(F.struct("k", "n", "c", "bits")).alias("inside"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("rare")))).alias("union"), F.min("n").alias("least"),
        F.max(F.size("rare") - F.size(F.array_distinct("rare"))).alias("merged"),
    )
    inside = scratch.write(inside, "inside")
    scratch.drop("groups")
    scratch.free_shuffles()

    def both(pairs: DataFrame, *columns: str) -> DataFrame:
        """``pairs`` (g1, g2) with the columns of either group, with 1 or 2 behind their names."""
        for i in (1, 2):
            pairs = pairs.join(inside.select(F.col("gid").alias(f"g{i}"), *[F.col(c).alias(f"{c}{i}") for c in columns]), f"g{i}")
        return pairs.select("g1", "g2", *[f"{c}{i}" for i in (1, 2) for c in columns])

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Those pairs of groups that could have members that link."""
        for b in batches:
            out = np.zeros(b.num_rows, bool)
            needed = needed_overlap(*(b.column(i).to_numpy() for i in (3, 6, 4, 7)), percent)
            (x, ox), (y, oy) = ((c.flatten().to_numpy(), c.offsets.to_numpy() - c.offsets[0].as_py()) for c in (b.column(2), b.column(5)))
            for i in range(b.num_rows):
                shared = np.intersect1d(x[ox[i] : ox[i + 1]], y[oy[i] : oy[i + 1]], assume_unique=True)
                out[i] = len(shared) >= needed[i]
            yield b.select([0, 1]).filter(pa.array(out))

    asked = scratch.write(both(met, "union", "least", "merged").mapInArrow(opened, "g1 long, g2 long"), "opened")
    scratch.drop("met")
    scratch.free_shuffles()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            left, right = b.column(2).to_pylist(), b.column(3).to_pylist()
            pairs: set[tuple[int, int]] = set()
            for xs, ys in zip(left, right, strict=True):
                for x in xs:
                    k, n, c, bits = x["k"], x["n"], x["c"], x["bits"]
                    low, high = n * percent, 100 * n
                    for y in ys:
                        m = y["n"]
                        if c != y["c"] and 100 * m >= low and m * percent <= high and may_link(bits, n, y["bits"], m, percent):
                            pairs.add((k, y["k"]) if k < y["k"] else (y["k"], k))
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], names=["a", "b"])

    return both(asked, "inside").mapInArrow(run, "a long, b long")


def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark, 500, "4m")
    return join(table(spark, sf_dir, "documents").select("doc_id", "text"))


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each component of five-word shingles at 0.8 the row with the smallest doc_id.

    Documents without words (null, empty and blank texts) link with nothing and all stay. Of rows that
    repeat both doc_id and text one stays; rows that repeat a doc_id with another, unlinked text are
    documents of their own. A null doc_id is kept only where its component has no other. Very long texts are
    compared whole; an empty table stays empty; columns of any names are kept."""
    from pyspark.sql import Window

    small_batches(spark, 500, "4m")
    scratch = Scratch(spark, "keep")
    keys = {"__k1": F.xxhash64("doc_id", "text"), "__k2": F.hash("text", "doc_id")}  # of the row, neither is null
    found = join(docs.withColumns(keys), size=5, percent=80, scratch=scratch, keys=tuple(keys))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", *keys)).alias("first")
    best = found.where("component is not null").groupBy("component").agg(first).select(*[F.col(f"first.{k}").alias(k) for k in keys])
    alone = found.where("component is null").select(*keys).distinct()
    rows = docs.withColumns(keys).join(best.withColumn("__worded", F.lit(True)).unionByName(alone.withColumn("__worded", F.lit(False))), list(keys))
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(F.lit(0)))
    return rows.withColumn("__r", F.when(F.col("__worded"), nth).otherwise(1)).where("__r = 1").select(*docs.columns)
