"""Text functions over columns."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space as Python's str.split sees it; Java's \s alone is narrower.
SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"
#: The same characters one by one.
SPACES = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))

# A keyword that contains a key gets the key's concepts, in this order.
LEGAL_CONCEPTS = (
    ("únos", ("mezinárodní únos dítěte",)),
    ("unos", ("mezinárodní únos dítěte",)),
    ("unesl", ("mezinárodní únos dítěte",)),
    ("unesení", ("mezinárodní únos dítěte",)),
    ("přemíst", ("mezinárodní únos dítěte",)),
    ("haag", ("mezinárodní únos dítěte", "Haagská úmluva")),
    ("dítě", ("rodičovská odpovědnost",)),
    ("dítět", ("rodičovská odpovědnost",)),
    ("dite", ("rodičovská odpovědnost",)),
    ("péče", ("svěření do péče", "rodičovská odpovědnost")),
    ("pece", ("svěření do péče", "rodičovská odpovědnost")),
    ("svěř", ("svěření do péče",)),
    ("custody", ("svěření do péče",)),
    ("styk", ("styk s dítětem",)),
    ("aliment", ("vyživovací povinnost",)),
    ("výživ", ("vyživovací povinnost",)),
    ("vyziv", ("vyživovací povinnost",)),
    ("cizin", ("mezinárodní prvek",)),
    ("rusk", ("mezinárodní prvek",)),
    ("zahrani", ("mezinárodní prvek",)),
    ("rozvod", ("rodinné právo",)),
    ("manžel", ("rodinné právo",)),
    ("rozluk", ("rodinné právo",)),
    ("rodič", ("rodičovská odpovědnost", "rodinné právo")),
)


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c) -> Column:
    """Without white space at both ends; what lies between is not read."""
    return F.btrim(_col(c), F.lit(SPACES))


def blank_to_null(c) -> Column:
    """Stripped text; null where nothing is left."""
    return F.nullif(strip(c), F.lit(""))


def first_truthy(*columns) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.nullif(_col(c), F.lit("")) for c in columns])


def normalise_query(c) -> Column:
    return F.lower(strip(F.regexp_replace(_col(c), f"{SPACE}+", " ")))


def split_words(c) -> Column:
    return F.filter(F.split(_col(c), f"{SPACE}+"), lambda w: w != "")


def scoring_words(c) -> Column:
    """Lower-cased words of three characters or more; repeats count."""
    return F.filter(split_words(F.lower(_col(c))), lambda w: F.length(w) >= 3)


def keywords(c) -> Column:
    """Distinct words of a normalised query, first occurrence first."""
    return F.array_distinct(F.filter(split_words(_col(c)), lambda w: F.length(w) >= 3))


def concepts(words, mapping=LEGAL_CONCEPTS) -> Column:
    """Distinct concepts in keyword order, then mapping order."""
    nothing = F.array().cast("array<string>")

    def of(word: Column) -> Column:
        return F.concat(*[F.when(F.contains(word, F.lit(key)), F.array(*map(F.lit, found))).otherwise(nothing) for key, found in mapping])

    return F.array_distinct(F.flatten(F.transform(_col(words), of)))


def process_query(c) -> Column:
    """struct(original_query, normalized_query, keywords, legal_concepts)."""
    normal = normalise_query(c)
    words = keywords(normal)
    return F.struct(_col(c).alias("original_query"), normal.alias("normalized_query"), words.alias("keywords"), concepts(words).alias("legal_concepts"))


def clean_chunk_text(c) -> Column:
    return strip(F.regexp_replace(_col(c), "[ \t]+", " "))


def reference_prefix(c) -> Column:
    """'III.ÚS 255/26' -> 'III.ÚS_255_26'; null or empty -> 'unknown'."""
    text = F.btrim(F.regexp_replace(F.translate(_col(c), " /", "__"), "_+", "_"), F.lit("_"))
    return F.when(F.coalesce(_col(c), F.lit("")) == "", F.lit("unknown")).otherwise(text)


def clean_cell(c) -> Column:
    text = strip(F.regexp_replace(F.regexp_replace(_col(c), " ", " "), f"{SPACE}+", " "))
    return F.when(text.isin("", "(-)"), F.lit(None)).otherwise(text)


def cell_lines(c) -> Column:
    return F.filter(F.transform(F.split(_col(c), "\r\n|\r|\n"), clean_cell), lambda x: x.isNotNull())


def collapse_repeats(c) -> Column:
    """Drops an element that equals the one before it."""
    return F.filter(_col(c), lambda x, i: (i == 0) | (x != F.get(_col(c), i - 1)))


def slug_of(text: str | None) -> str:
    """ASCII-folded, runs of other characters as one underscore, lower case; 'results' if empty."""
    folded = unicodedata.normalize("NFKD", text or "").encode("ascii", "ignore").decode()
    return re.sub(r"[^0-9A-Za-z]+", "_", folded).strip("_").lower() or "results"


@F.pandas_udf(T.StringType())
def slugify(texts: pd.Series) -> pd.Series:
    return texts.map(slug_of)


@F.pandas_udf(T.StringType())
def three_decimals(values: pd.Series) -> pd.Series:
    """'%.3f' with exact binary rounding, which format_string does not have."""
    return values.map(lambda v: f"{v:.3f}")
