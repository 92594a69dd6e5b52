"""The engine as functions of single requests, with a state, a cache of answers and a health report."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import UTC, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession

from ..functions.ids import cache_key
from ..operators import answering as A
from ..operators.ledger import Ledger
from ..schemas import POINT_FIELDS
from ..streaming.ingest import Ingest
from ..trace import logger, trace
from . import engine

log = logger(__name__)
#: Answers that a service keeps.
MOST_CACHED = 10_000


class NotReady(RuntimeError):
    """A strict service has no points to answer from."""


@dataclass
class Service:
    """Answers over points to search (id, text, pos, vector, payload). Without points it is a stub that
    finds nothing, or refuses to answer where it is ``strict``."""

    spark: SparkSession
    points: DataFrame | None = None
    corpus_version: str = "seed-corpus"
    strict: bool = False
    embed: object = A.mock_embed
    rewriter: object = None
    planner: object = A.mock_plan_text
    model: object = None
    ttl_seconds: int | None = 604_800
    ledger: Ledger | None = None
    ingest: Ingest | None = None
    error: str | None = None
    #: Answers by key, with the time until which they hold; the MOST_CACHED newest.
    cache: dict[str, tuple[dict, datetime | None]] = field(default_factory=dict)

    def _held(self) -> DataFrame:
        if self.points is not None:
            return self.points
        if self.strict:
            raise NotReady(self.error or "no points are loaded")
        return self.spark.createDataFrame([], f"{POINT_FIELDS}, text string, pos long")

    def _one(self, query: str) -> DataFrame:
        return self.spark.createDataFrame([(0, query)], "qid long, query string")

    def search(self, query: str, top_k: int = 5) -> dict:
        """A rule-based answer with the strategy that it took."""
        row = engine.search(self._held(), self._one(query), top_k, self.embed, self.rewriter).first()
        return row.asDict(recursive=True)

    def retrieve(self, query: str, top_k: int = 10, sources: list[str] | None = None, prefilter: bool = False) -> list[dict]:
        """Rows of the best points, as far as they are of the requested sources."""
        rows = engine.retrieve(self._held(), self._one(query), top_k, sources, self.embed, self.rewriter, prefilter)
        return [r.asDict() for r in rows.orderBy("rank").collect()]

    def query(self, query: str, top_k: int = 5) -> dict:
        """The whole plan, from the cache where it has an answer that has not expired."""
        now, asked = datetime.now(UTC), self._one(query)
        key = asked.select(cache_key("query", self.corpus_version)).first()[0]
        answer, until = self.cache.get(key, (None, None))
        if answer is None or until is not None and until <= now:
            row = engine.run(self._held(), asked, top_k, self.rewriter, self.planner, self.embed, self.model, self.ledger).first()
            answer = {k: row[k] for k in ("answer", "sources", "plan_steps")}
            trace(log, "service.query", query=query, sources=len(row["sources"]))
            expires = now + timedelta(seconds=self.ttl_seconds) if self.ttl_seconds and self.ttl_seconds > 0 else None
            self.cache.pop(key, None)
            self.cache[key] = (answer, expires)
            while len(self.cache) > MOST_CACHED:
                del self.cache[next(iter(self.cache))]
        return dict(answer)

    def health(self) -> dict:
        return {
            "status": "ok", "ready": self.points is not None, "error": self.error, "strict": self.strict, "corpus_version": self.corpus_version,
            "ingest_status": self.ingest.status if self.ingest else "idle", "ingest_message": self.ingest.message if self.ingest else "", "cached_answers": len(self.cache),
        }
