"""Files of one JSON array each as rows of their elements; a large file is cut by many tasks.

A large file is read in parts that end somewhere in it. What a part does to the state of a reader (inside a
string or not, depth, elements so far) is noted for both states of strings that it may begin with; the
states at the parts' begins follow from these notes, and then each part is cut by itself. An element that
goes over parts is put together again. Every element is parsed and what stands between elements is checked,
so that a file that is not an array of objects raises.
"""

from __future__ import annotations

import json
import re
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared, small_batches

#: Bytes from which on a file is read in parts, and characters of a part.
LARGE, PART = 8 << 20, 1 << 20

_ESCAPED, _MARKS = re.compile(r"\\.", re.DOTALL), re.compile(r"[\[\]{},]")
_STEP = {"[": 1, "{": 1, "]": -1, "}": -1, ",": 0}
_BLANK = " \t\r\n"


def _marks(text: str, inside: bool) -> Iterator[tuple[int, str]]:
    """Places of the brackets and commas outside of strings; no part ends between a backslash and what it escapes."""
    at = 0
    for i, some in enumerate((_ESCAPED.sub("..", text) if "\\" in text else text).split('"')):
        if i % 2 == inside:
            for m in _MARKS.finditer(some):
                yield at + m.start(), m[0]
        at += len(some) + 1


def _note(text: str, inside: bool) -> dict:
    """Whether a reader is inside a string behind a text, by how much its depth changes, and the cuts at each depth."""
    depth, cuts = 0, Counter()
    for _, mark in _marks(text, inside):
        if mark in "[],":
            cuts[depth + (mark == "[")] += 1
        depth += _STEP[mark]
    return {"inside": inside ^ (_ESCAPED.sub("", text).count('"') % 2 == 1), "depth": depth, "cuts": dict(cuts)}


def _fragments(text: str, inside: bool, depth: int, n: int) -> Iterator[tuple[int, str, str, str]]:
    """What stands between the marks of the outer array: number, the mark before, text, the mark behind; at
    the ends of the text there is none."""
    before, at = "", 0
    for place, mark in _marks(text, inside):
        level = depth + (mark == "[")
        depth += _STEP[mark]
        if level == 1 and mark in "[],":
            yield n, before, text[at:place], mark
            n, before, at = n + 1, mark, place + 1
    yield n, before, text[at:], ""


def _is_element(file: str, before: str, text: str, after: str) -> bool:
    """Whether a fragment is an object, and not the blank around an array or in an empty one; others raise."""
    blank, marks = not text.strip(_BLANK), (before, after)
    if blank and marks in (("", "["), ("[", "]"), ("]", "")):
        return False
    if before not in ("[", ",") or after not in (",", "]"):
        raise ValueError(f"not a JSON array: {file}")
    if not text.lstrip(_BLANK).startswith("{"):
        raise ValueError(f"not a JSON object in {file}")
    try:
        json.loads(text)
    except ValueError as error:
        raise ValueError(f"not a JSON array: {file}: {error}") from None
    return True


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _batches(rows: Iterable[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Batches of a bounded number of characters; the last column has the text."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[-1])
        if size >= PART or len(held) == 1000:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in held], schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in held], schema)


_ITEM = pa.schema([("file", pa.string()), ("n", pa.int64()), ("item", pa.string())])
_ITEM_FIELDS = "file string, n long, item string"
_NOTE = "struct<inside:boolean,depth:long,cuts:map<long,long>>"


def _checked(batches):
    """(file, n, before, after, text) to elements."""
    return _batches(((file, n - 1, text) for file, n, before, after, text in _rows(batches) if _is_element(file, before, text, after)), _ITEM)


def _whole(batches):
    """(file, text) of whole files to elements."""
    return _batches(((file, n - 1, item) for file, text in _rows(batches) for n, before, item, after in _fragments(text, False, 0, 0) if _is_element(file, before, item, after)), _ITEM)


def _parts(size: int):
    """(file, start, value) to parts of a size; values begin behind a brace, but a file's first one."""
    note = pa.struct([("inside", pa.bool_()), ("depth", pa.int64()), ("cuts", pa.map_(pa.int64(), pa.int64()))])
    schema = pa.schema([("file", pa.string()), ("start", pa.int64()), ("i", pa.int64()), ("out", note), ("in", note), ("text", pa.string())])

    def noted(file, start, i, text):
        found = [x | {"cuts": list(x["cuts"].items())} for x in (_note(text, False), _note(text, True))]
        return file, start, i, *found, text

    def cut(batches):
        for (file, start), rows in groupby(_rows(batches), lambda row: row[:2]):
            i, held, length = 0, [], 0
            for k, (_, _, value) in enumerate(rows):
                held.append(value if k == start == 0 else "}" + value)
                length += len(held[-1])
                if length >= size:
                    yield noted(file, start, i, "".join(held))
                    i, held, length = i + 1, [], 0
            if held:
                yield noted(file, start, i, "".join(held))

    return lambda batches: _batches(cut(batches), schema)


def _states(notes: pd.DataFrame) -> pd.DataFrame:
    """The states of a reader at the begins of a file's parts."""
    inside, depth, n, out = False, 0, 0, []
    for row in notes.sort_values(["start", "i"]).to_dict("records"):
        out.append((row["file"], row["start"], row["i"], inside, depth, n))
        note = row["in" if inside else "out"]
        n += dict(note["cuts"]).get(1 - depth, 0)
        inside, depth = note["inside"], depth + note["depth"]
    return pd.DataFrame(out, columns=["file", "start", "i", "inside", "depth", "n"])


def _cut(border: bool):
    """Parts with their states to the elements within them, or to the fragments at their ends."""
    schema = pa.schema([("file", pa.string()), ("n", pa.int64()), ("start", pa.int64()), ("i", pa.int64()), ("before", pa.string()), ("after", pa.string()), ("text", pa.string())])

    def found(batches):
        for file, start, i, inside, depth, n, text in _rows(batches):
            for m, before, item, after in _fragments(text, inside, depth, n):
                at_end = not (before and after)
                if border and at_end:
                    yield file, m, start, i, before, after, item
                elif not border and not at_end and _is_element(file, before, item, after):
                    yield file, m - 1, item

    return lambda batches: _batches(found(batches), schema if border else _ITEM)


def elements(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, n, item) of files that hold one JSON array of objects; files named manifest.json are passed over.
    A path that is given twice is read once. Parts of large files are written to the shared folder."""
    small_batches(spark)
    paths = paths if isinstance(paths, str) else list(dict.fromkeys(paths))
    size, kept = F.col("_metadata.file_size"), ~F.col("file").endswith("/manifest.json")
    name = F.input_file_name().alias("file")
    small = spark.read.text(paths, wholetext=True).where(size < LARGE).select(name, "value").where(kept).mapInArrow(_whole, _ITEM_FIELDS)
    pieces = spark.read.text(paths, lineSep="}").where(size >= LARGE).select(name, F.col("_metadata.file_block_start").alias("start"), "value").where(kept)
    if pieces.isEmpty():
        return small
    folder = f"{shared(spark)}/json-{uuid.uuid4().hex}"
    pieces.mapInArrow(_parts(PART), f"file string, start long, i long, out {_NOTE}, `in` {_NOTE}, text string").write.parquet(folder)
    parts, key = spark.read.parquet(folder), ["file", "start", "i"]
    states = parts.drop("text").groupBy("file").applyInPandas(_states, "file string, start long, i long, inside boolean, depth long, n long")
    parts = parts.select(*key, "text").join(states, key).select(*key, "inside", "depth", "n", "text")
    inner = parts.mapInArrow(_cut(False), _ITEM_FIELDS)
    ends = parts.mapInArrow(_cut(True), "file string, n long, start long, i long, before string, after string, text string")
    held = F.array_sort(F.collect_list(F.struct("start", "i", "before", "after", "text")))  # of one element, as a rule from two parts
    ends = ends.groupBy("file", "n").agg(held.alias("x")).select("file", "n", F.col("x")[0]["before"].alias("before"), F.element_at("x", -1)["after"].alias("after"), F.array_join("x.text", "").alias("text"))
    return small.unionByName(inner).unionByName(ends.mapInArrow(_checked, _ITEM_FIELDS))
