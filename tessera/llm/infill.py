"""Fill-in-the-middle texts, made by one numpy kernel for each Arrow batch.

A batch's texts lie one behind another in one UTF-8 buffer. A table of byte classes marks white space, a
comparison of adjacent bytes marks where tokens begin, a running count over the buffer, less its value at
each text's start, numbers the tokens of each text, and one binary search finds the cuts of all rows.
White space is ASCII, so no cut falls inside a character.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches, table

SEED = 42
#: Per cent of the texts that are transformed, and of those that put the suffix first.
FIM_PERCENT, SPM_PERCENT = 50, 80
#: Marks in front of prefix, suffix and middle.
MARKS = {"prefix": "<P>", "suffix": "<S>", "middle": "<M>"}

#: 1 for the ASCII white space characters.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LETTERS = np.zeros(256, bool)
_LETTERS[[ord(m[1]) for m in MARKS.values()]] = True

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("n", T.LongType()), T.StructField("form", T.StringType()),
    T.StructField("prefix_chars", T.LongType()), T.StructField("middle_chars", T.LongType()), T.StructField("output", T.StringType()),
])


def draws(doc_id: Column, seed: int = SEED) -> list[Column]:
    """Four numbers below 2^32 from the hash of the seed and the id; a null id counts as no digits."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def _buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array's texts, and where each starts and the last ends."""
    offsets = np.frombuffer(texts.buffers()[1], "int32", len(texts) + 1, 4 * texts.offset).astype("int64")
    held = texts.buffers()[2]
    data = np.frombuffer(held, "uint8") if held is not None else np.zeros(0, "uint8")
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _marks(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where marks begin, and the text that each is in; those made up by two adjacent texts don't count."""
    if len(data) < 3:
        return np.zeros(0, "int64"), np.zeros(0, "int64")
    at = np.flatnonzero((data[:-2] == ord("<")) & _LETTERS[data[1:-1]] & (data[2:] == ord(">")))
    own = np.searchsorted(bounds, at, "right") - 1
    inside = at + 3 <= bounds[own + 1]
    return at[inside], own[inside]


def _pieces(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The texts between byte positions; the pieces may overlap or lie in any order."""
    sizes = ends - starts
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    held = memoryview(data)
    joined = b"".join([held[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])
    return pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets.astype("int32")), pa.py_buffer(joined))


def cuts(data: np.ndarray, bounds: np.ndarray, draw: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For all texts the number of tokens and the byte positions where prefix and middle end."""
    space = _SPACE[data]
    begins = np.ones(len(data), bool)
    np.logical_and(space[1:], ~space[:-1], out=begins[1:])  # white space behind a word starts a token
    filled = bounds[:-1] < bounds[1:]
    begins[bounds[:-1][filled]] = True
    counted = np.cumsum(begins, dtype="int32")
    before = np.concatenate([[0], counted])[bounds]  # tokens of the batch ahead of each text
    n = np.diff(before).astype("int64")
    units = [draw[i] % (n + 1) for i in (0, 1)]
    # Token k of a text is where the count first exceeds k; behind the last one that is the next text's start.
    first, second = (np.searchsorted(counted, before[:-1] + k + 1) for k in (np.minimum(*units), np.maximum(*units)))
    return n, np.minimum(first, bounds[1:]), np.minimum(second, bounds[1:])


def _joined(form: np.ndarray, prefix: pa.Array, middle: pa.Array, suffix: pa.Array) -> pa.Array:
    """The transformed texts. A plain row has the whole text as its suffix and no marks."""
    suffix_first, marked = pa.array(form == "spm"), pa.array(form != "plain")
    p, s, m = (pc.if_else(marked, MARKS[k], "") for k in ("prefix", "suffix", "middle"))
    ahead = [pc.if_else(suffix_first, s, p), pc.if_else(suffix_first, suffix, prefix)]
    behind = [pc.if_else(suffix_first, p, s), pc.if_else(suffix_first, prefix, suffix)]
    return pc.binary_join_element_wise(*ahead, *behind, m, middle, "")


def _infill(texts: pa.Array, draw: list[np.ndarray], fim_percent: int, spm_percent: int) -> list[pa.Array]:
    data, bounds = _buffer(texts)
    n, first, second = cuts(data, bounds, draw)
    plain = (bounds[:-1] == bounds[1:]) | (draw[2] % 100 >= fim_percent)
    plain[_marks(data, bounds)[1]] = True
    form = np.where(plain, "plain", np.where(draw[3] % 100 < spm_percent, "spm", "psm"))
    first, second = np.where(plain, bounds[:-1], first), np.where(plain, bounds[:-1], second)
    prefix, middle, suffix = _pieces(data, bounds[:-1], first), _pieces(data, first, second), _pieces(data, second, bounds[1:])
    chars = [pa.array(pc.utf8_length(x).to_numpy(zero_copy_only=False).astype("int64"), mask=plain) for x in (prefix, middle)]
    return [pa.array(n), pa.array(form.tolist(), pa.string()), *chars, _joined(form, prefix, middle, suffix)]


def infill(docs: DataFrame, text_col: str = "text", seed: int = SEED, fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT) -> DataFrame:
    """doc_id, n (tokens), form (plain, psm, spm), prefix_chars, middle_chars (null if plain), output.

    A token is a word with the white space before it, or the white space that ends the text. Null and
    empty texts stay plain, as do texts that hold a mark. Equal rows give equal rows; rows with a null
    doc_id draw by the seed alone; an empty table gives no rows; other columns are left out, whatever
    their names. A text is handled whole, at about 20 bytes of memory for each of its own.
    """
    doc = F.col("doc_id").cast("long")
    source = docs.select(doc.alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"), *[d.alias(f"h{i}") for i, d in enumerate(draws(doc, seed))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            draw = [c.to_numpy() for c in batch.columns[2:]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *_infill(batch.column(1), draw, fim_percent, spm_percent)], names=SCHEMA.names)

    return source.mapInArrow(run, SCHEMA)


def _restored(texts: pa.Array, form: np.ndarray) -> pa.Array:
    data, bounds = _buffer(texts)
    marked = form != "plain"
    at, own = _marks(data, bounds)
    at = at[marked[own]].reshape(-1, 3)  # a transformed text holds each mark once
    ends = bounds[1:]
    cut = np.repeat(bounds[:-1, None], 6, 1)  # starts and ends of the three pieces, empty where plain
    cut[marked] = np.column_stack([at[:, 0] + 3, at[:, 1], at[:, 1] + 3, at[:, 2], at[:, 2] + 3, ends[marked]])
    one, two, middle = (_pieces(data, cut[:, i], cut[:, i + 1]) for i in (0, 2, 4))
    whole = _pieces(data, bounds[:-1], np.where(marked, bounds[:-1], ends))
    suffix_first = pa.array(form == "spm")
    return pc.binary_join_element_wise(pc.if_else(suffix_first, two, one), middle, pc.if_else(suffix_first, one, two), whole, "")


def restore(made: DataFrame) -> DataFrame:
    """Adds ``restored``, the text that ``output`` was made from, by output and form alone.

    All columns but ``restored`` are kept; a null output counts as empty and a null form as plain."""
    kept = [c for c in made.columns if c != "restored"]
    source = made.select(*[F.col(f"`{c}`") for c in kept], F.coalesce("output", F.lit("")).alias("__output"), F.coalesce("form", F.lit("plain")).alias("__form"))
    schema = T.StructType([*source.schema.fields[:-2], T.StructField("restored", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            form = np.array(batch.column(batch.num_columns - 1).to_pylist(), dtype="<U5")
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], _restored(batch.column(batch.num_columns - 2), form)], names=schema.names)

    return source.mapInArrow(run, schema)


def op11_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    made = restore(infill(table(spark, sf_dir, "documents")))
    digests = [F.sha2(F.col(c).cast("binary"), 256).alias(f"{c}_sha256") for c in ("output", "restored")]
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)
