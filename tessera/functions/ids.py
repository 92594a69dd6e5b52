"""Deterministic ids, checksums and cache keys, all as JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import SPACE, _col, strip

URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"
#: Set this to an existing store's prefix to get its ids.
POINT_PREFIX = "tessera-chunk:"
SCHEME = "uuid5"
CHECKSUM_KEYS = ("original_id", "text", "case_reference", "ecli", "decision_date", "judge", "text_url", "chunk_index", "document_id", "source", "point_id_scheme")


def uuid5(name, namespace: str = URL_NAMESPACE) -> Column:
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(_col(name), "UTF-8")))
    variant = F.substring(F.lit("89ab89ab89ab89ab"), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") + 1), F.lit(1))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def point_id(original_id, prefix: str = POINT_PREFIX) -> Column:
    """UUIDv5 of a chunk id; blank ids raise."""
    text = strip(original_id)
    return F.when(F.coalesce(text, F.lit("")) == "", F.raise_error(F.lit("a point needs an id"))).otherwise(uuid5(F.concat(F.lit(prefix), text)))


def canonical_json(fields: dict[str, Column]) -> Column:
    """Compact JSON with sorted keys and nulls, control characters in lower-case escapes."""
    text = F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})
    lower = text
    for digit in "ABCDEF":
        lower = F.regexp_replace(lower, rf"(?<!\\)((?:\\\\)*)\\u00([01]){digit}", rf"$1\\u00$2{digit.lower()}")
    return F.when(text.rlike(r"\\u00[01][A-F]"), lower).otherwise(text)  # few texts have such characters


def payload_checksum(payload: str = "payload") -> Column:
    return F.sha2(canonical_json({k: F.col(f"{payload}.{k}") for k in CHECKSUM_KEYS}), 256)


def cache_key(query, corpus_version: str, provider: str = "", model: str = "", prompt_version: str = "v1") -> Column:
    text = F.lower(strip(F.regexp_replace(_col(query), f"{SPACE}+", " ")))
    fields = {"query": text, "corpus_version": F.lit(corpus_version), "provider": F.lit(provider.strip().lower()), "model": F.lit(model), "prompt_version": F.lit(prompt_version.strip() or "v1")}
    return F.concat(F.lit("rag-query:"), F.sha2(canonical_json(fields), 256))
