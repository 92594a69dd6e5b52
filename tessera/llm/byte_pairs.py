"""Byte-level BPE by replaying merges over many words at once.

The distinct words of the texts at hand stand one behind another as linked tokens. An index from each
mergeable pair to the positions where it stands is read in the order of ranks; each merge touches its two
neighbours, which enter the index under the pairs that they now form. Words seen before keep their ids.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from heapq import heappop, heappush
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches, table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Words that a worker keeps; later ones are encoded for the texts at hand only, which bounds memory.
CACHE = 600_000
#: Characters of text split at a time, and bytes of words replayed at a time (one word at least).
GROUP_CHARS, REPLAY_BYTES = 2_000_000, 1 << 20
_SHIFT = 20

ENCODED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType()))])


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Merges:
    """The ranks of a vocabulary: a token's id is its rank, and a pair merges to the token of its joined bytes."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:  # part of the Python environment, like the library that reads it
            self.rank = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        if max(self.rank.values()) >> _SHIFT:
            raise ValueError(f"{path}: ids of {1 << _SHIFT} and more")
        self.pair = {
            (left << _SHIFT) | right: rank
            for token, rank in self.rank.items()
            for i in range(1, len(token))
            if (left := self.rank.get(token[:i])) is not None and (right := self.rank.get(token[i:])) is not None
        }
        self.byte = np.array([self.rank[bytes([b])] for b in range(256)], "int32")
        self.bytes_pair = np.array([[self.rank.get(bytes([a, b]), -1) for b in range(256)] for a in range(256)], "int32")
        size = np.zeros(max(self.rank.values()) + 1, "int64")
        for token, rank in self.rank.items():
            size[rank] = len(token)
        self.ends = np.cumsum(size)
        self.flat = np.zeros(int(self.ends[-1]), "uint8")
        for token, rank in self.rank.items():
            self.flat[self.ends[rank] - len(token) : self.ends[rank]] = np.frombuffer(token, "uint8")
        self.size = size

    def replay(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the words (none empty) and the number of ids of each."""
        data = np.frombuffer(b"".join(words), "uint8")
        ends = np.cumsum([len(w) for w in words])
        here = np.arange(len(data), dtype="int32")
        after, before = here + 1, here - 1
        after[ends - 1] = -1
        before[np.concatenate([[0], ends[:-1]])] = -1
        token, after, before = array("i", self.byte[data].tobytes()), array("i", after.tobytes()), array("i", before.tobytes())
        ranks = np.append(self.bytes_pair[data[:-1], data[1:]], -1)
        ranks[ends - 1] = -1
        at = np.flatnonzero(ranks >= 0)
        at = at[np.argsort(ranks[at], kind="stable")]
        waiting, first = np.unique(ranks[at], return_index=True)
        index: dict[int, list[int] | np.ndarray] = dict(zip(waiting.tolist(), np.split(at, first[1:]), strict=True)) if len(at) else {}
        order = waiting.tolist()  # ascending, so a heap
        pair, again = self.pair, set()
        while order:
            rank = heappop(order)
            positions = index.pop(rank)
            for p in sorted(positions.tolist() if isinstance(positions, np.ndarray) else positions):
                q = after[p]
                if q < 0 or pair.get((token[p] << _SHIFT) | token[q]) != rank or token[p] < 0:
                    continue  # a merge before this one took part of the pair
                token[p], token[q] = rank, -1
                after[p] = beyond = after[q]
                after[q] = -1
                touched = []
                if beyond >= 0:
                    before[beyond] = p
                    touched.append((p, pair.get((rank << _SHIFT) | token[beyond])))
                if (ahead := before[p]) >= 0:
                    touched.append((ahead, pair.get((token[ahead] << _SHIFT) | rank)))
                for start, made in touched:
                    if made is None:
                        continue
                    if made < rank:  # its turn is over for other words, so this one goes by itself
                        again.add(p)
                    elif made in index:
                        found = index[made]
                        if isinstance(found, np.ndarray):
                            index[made] = found = found.tolist()
                        found.append(start)
                    else:
                        index[made] = [start]
                        heappush(order, made)
        ids = np.frombuffer(token, "int32")
        alive = ids >= 0
        counts = np.diff(np.concatenate([[0], np.cumsum(alive)[ends - 1]]))
        if not again:
            return ids[alive], counts
        parts = np.split(ids[alive], np.cumsum(counts)[:-1])
        for w in np.unique(np.searchsorted(ends, sorted(again), "right")).tolist():
            parts[w] = np.array(self.alone(words[w]), "int32")
        return np.concatenate(parts), np.array([len(x) for x in parts], "int64")

    def alone(self, word: bytes) -> list[int]:
        """The ids of one word: of the pairs with the lowest rank the first one merges, again and again."""
        tokens = self.byte[np.frombuffer(word, "uint8")].tolist()
        while True:
            ranks = [self.pair.get((a << _SHIFT) | b, 1 << _SHIFT) for a, b in zip(tokens, tokens[1:], strict=False)]
            if not ranks or (lowest := min(ranks)) == 1 << _SHIFT:
                return tokens
            i = ranks.index(lowest)
            tokens[i : i + 2] = [lowest]


class Encoder:
    """Splits texts by a pattern and gives each word its ids: those of the word as a whole if it is a
    token, else what the replayed merges leave."""

    def __init__(self, path: str, pattern: str):
        import regex

        self.merges = Merges(path)
        self.split = regex.compile(pattern).findall
        self.number: dict[str, int] = {}
        self.flat, self.sizes = np.zeros(0, "int32"), np.zeros(0, "int64")

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of distinct words and the number of ids of each."""
        encoded = [w.encode() for w in words]
        whole = np.array(list(map(self.merges.rank.get, encoded, repeat(-1))), "int32")
        sizes = np.ones(len(words), "int64")
        rest = np.flatnonzero(whole < 0).tolist()
        found, group, held = [], [], 0
        for i in rest:
            group.append(encoded[i])
            held += len(encoded[i])
            if held >= REPLAY_BYTES:
                found.append(self.merges.replay(group))
                group, held = [], 0
        if group:
            found.append(self.merges.replay(group))
        if not found:
            return whole, sizes
        sizes[rest] = np.concatenate([f[1] for f in found])
        ids = np.empty(int(sizes.sum()), "int32")
        split = np.repeat(whole < 0, sizes)
        ids[~split] = whole[whole >= 0]
        ids[split] = np.concatenate([f[0] for f in found])
        return ids, sizes

    def _some(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        words: list[str] = []
        ends = []
        for text in texts:
            words.extend(self.split(text))
            ends.append(len(words))
        index = np.fromiter(map(self.number.get, words, repeat(-1)), "int64", len(words))
        missing = np.flatnonzero(index < 0).tolist()
        flat, sizes = self.flat, self.sizes
        if missing:
            unseen = [words[i] for i in missing]
            new = {w: i for i, w in enumerate(dict.fromkeys(unseen), len(sizes))}
            ids, n = self._words(list(new))
            flat, sizes = np.concatenate([flat, ids]), np.concatenate([sizes, n])
            index[missing] = [new[w] for w in unseen]
            if len(sizes) <= CACHE:
                self.number.update(new)
                self.flat, self.sizes = flat, sizes
        each = sizes[index]
        upto = np.concatenate([[0], np.cumsum(each)])
        starts = np.cumsum(sizes) - sizes
        ids = flat[np.repeat(starts[index] - upto[:-1], each) + np.arange(upto[-1])]
        return ids, np.diff(np.concatenate([[0], upto[ends]]))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts and the number of ids of each."""
        made, group, held = [], [], 0
        for text in texts:
            group.append(text)
            held += len(text)
            if held >= GROUP_CHARS:
                made.append(self._some(group))
                group, held = [], 0
        if group:
            made.append(self._some(group))
        return np.concatenate([np.zeros(0, "int32"), *[m[0] for m in made]]), np.concatenate([np.zeros(0, "int64"), *[m[1] for m in made]])

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all ids, and where each row's bytes end."""
        merges = self.merges
        if len(ids) and (ids.min() < 0 or ids.max() >= len(merges.size) or not merges.size[ids].all()):
            raise ValueError("an id that the vocabulary lacks")
        size = merges.size[ids]
        upto = np.concatenate([[0], np.cumsum(size)])
        data = merges.flat[np.repeat(merges.ends[ids] - size - upto[:-1], size) + np.arange(upto[-1])]
        return data, upto[np.cumsum(counts)]


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, pattern: str) -> Encoder:
    """The encoder of this Python worker, kept between tasks."""
    return _encoders.get((path, pattern)) or _encoders.setdefault((path, pattern), Encoder(path, pattern))


def _pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def encode(docs: DataFrame, text_col: str = "text", vocabulary: str = VOCABULARY, pattern: str | None = None) -> DataFrame:
    """doc_id and ids (array of int) of each text.

    Null texts count as empty and give no ids; strings of special tokens are ordinary text; equal rows
    give equal rows; null doc_ids stay null; an empty table gives no rows; other columns are left out,
    whatever their names. A text is encoded whole; a single word takes some 60 bytes of memory for each
    of its bytes.
    """
    path, pattern = vocabulary_path(vocabulary), pattern or _pattern()
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, counts = encoder(path, pattern).encode(batch.column(1).to_pylist())
            offsets = np.concatenate([[0], np.cumsum(counts)]).astype("int32")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))], names=ENCODED.names)

    return source.mapInArrow(run, ENCODED)


def decode(encoded: DataFrame, ids_col: str = "ids", vocabulary: str = VOCABULARY, pattern: str | None = None) -> DataFrame:
    """Adds ``decoded``, the bytes of each row's ids (any ids may not be valid UTF-8 together).

    All columns but ``decoded`` are kept. Null ids give no bytes; an id that the vocabulary lacks, or a
    null among ids, raises."""
    path, pattern = vocabulary_path(vocabulary), pattern or _pattern()
    kept = [c for c in encoded.columns if c != "decoded"]
    source = encoded.select(*[F.col(f"`{c}`") for c in kept], F.coalesce(F.col(ids_col), F.array().cast("array<int>")).alias("__ids"))
    schema = T.StructType([*source.schema.fields[:-1], T.StructField("decoded", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(batch.num_columns - 1)
            flat = ids.flatten()
            if flat.null_count:
                raise ValueError("a null among ids")
            data, ends = encoder(path, pattern).decode(flat.to_numpy(), np.diff(ids.offsets.to_numpy()))
            offsets = np.concatenate([[0], ends]).astype("int32")
            made = pa.BinaryArray.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], made], names=schema.names)

    return source.mapInArrow(run, schema)


def op13_byte_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    rows = decode(encode(table(spark, sf_dir, "documents")))
    joined = F.array_join(F.col("ids").cast("array<string>"), ",")
    return rows.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined.cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )
