"""Calls to services, through a client that the caller gives: retries, search forms, model providers.

A client is any object with ``get(url, params)`` and ``post(url, data)`` that return a Response; none is
opened here, so that everything also runs offline.
"""

from __future__ import annotations

import json
import os
import re
import time
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from html import unescape
from pathlib import Path
from typing import Protocol

from ..functions.html import FORM_FIELDS
from ..trace import logger

log = logger(__name__)


@dataclass
class Response:
    text: str
    url: str = ""
    status: int = 200


class Client(Protocol):
    def get(self, url: str, params: dict | None = None) -> Response: ...

    def post(self, url: str, data: dict) -> Response: ...


def with_retries(call: Callable[[], Response], url: str, attempts: int = 3, pause: float = 1.0, sleep=time.sleep) -> Response | None:
    """The first response without an error or an error status; None when all attempts failed."""
    for attempt in range(attempts):
        try:
            response = call()
            if response.status < 400:
                return response
            failure = f"status {response.status}"
        except Exception as error:  # noqa: BLE001 - any failure of a request is tried again
            failure = str(error)
        log.warning("request %s of %s to %s failed: %s", attempt + 1, attempts, url, failure)
        if attempt + 1 < attempts:
            sleep(pause)
    return None


def form_fields(page: str) -> dict[str, str]:
    """Hidden fields of a search form; a form without the required ones raises."""
    found = {}
    for tag in re.findall(r"<input[^>]*>", page, re.IGNORECASE | re.DOTALL):
        kind, name, value = (re.search(rf"""\b{a}\s*=\s*["'](.*?)["']""", tag, re.IGNORECASE | re.DOTALL) for a in ("type", "name", "value"))
        if kind and kind[1].lower() == "hidden" and name:
            found[name[1]] = unescape(value[1]) if value else ""
    if lacks := sorted(set(FORM_FIELDS) - set(found)):
        raise RuntimeError(f"missing form fields: {', '.join(lacks)}")
    return found


@dataclass
class SearchSite:
    """A site with a search form that leads to pages of results."""

    form_url: str
    results_url: str
    query_field: str
    fields: tuple[tuple[str, str], ...] = ()
    marker: str = "Výsledky"
    page_marker: str = "ResultDetail.aspx"

    def search(self, client: Client, query: str, **retries) -> Response:
        """The first page of results."""
        form = with_retries(lambda: client.get(self.form_url), self.form_url, **retries)
        if form is None:
            raise RuntimeError(f"failed to load the search page {self.form_url}")
        data = form_fields(form.text) | {"__EVENTTARGET": "", "__EVENTARGUMENT": ""} | dict(self.fields) | {self.query_field: query}
        found = with_retries(lambda: client.post(self.form_url, data), self.form_url, **retries)
        if found is None:
            raise RuntimeError(f"failed to submit the search to {self.form_url}")
        if not found.url.endswith(self.results_url.rsplit("//", 1)[-1].split("/", 1)[-1]):
            raise RuntimeError(f"the search did not lead to results but to {found.url}")
        if self.marker not in found.text:
            raise RuntimeError(f"the page of results lacks {self.marker!r}")
        return found

    def page(self, client: Client, query: str, page: int = 0, **retries) -> str:
        """The HTML of page ``page``, counted from 0."""
        if page < 0:
            raise ValueError("pages are counted from 0")
        return next(self.pages(client, query, [page], **retries))

    def pages(self, client: Client, query: str, numbers: Iterable[int], **retries) -> Iterator[str]:
        """The HTML of pages, counted from 0, after one search for all."""
        first = self.search(client, query, **retries)
        for page in numbers:
            if page == 0:
                yield first.text
                continue
            found = with_retries(lambda page=page: client.get(self.results_url, {"page": page}), self.results_url, **retries)
            if found is None or self.page_marker not in found.text:
                raise RuntimeError(f"failed to load page {page + 1} of the results")
            yield found.text


def fetch_page(site: SearchSite, client: Client, page: int, query: str) -> str:
    return site.page(client, query, page)


def fetch_decision(client: Client, url: str, **retries) -> str:
    """The HTML of a decision."""
    found = with_retries(lambda: client.get(url), url, **retries)
    if found is None:
        raise RuntimeError(f"failed to load {url}")
    return found.text


class FolderClient:
    """A site that was saved to a folder that tasks see: form.html, page_0.html, page_1.html and so on, or the
    folders page=0, page=1 that Spark writes, and other urls by their last part. ``form`` stands for form.html."""

    def __init__(self, folder: str, results_url: str, form: str | None = None):
        self.folder, self.results_url, self.form = Path(folder), results_url, form

    def _read(self, name: str, url: str) -> Response:
        at = self.folder / name
        if name == "form.html" and self.form is not None:
            return Response(self.form, url)
        if page := re.fullmatch(r"page_(\d+)\.html", name):
            at = next((self.folder / f"page={page[1]}").glob("part-*"), at)
        return Response(at.read_text("utf-8"), url) if at.exists() else Response("", url, 404)

    def get(self, url: str, params: dict | None = None) -> Response:
        if url == self.results_url:
            return self._read(f"page_{(params or {}).get('page', 0)}.html", url)
        last = re.sub(r"[^A-Za-z0-9_-]+", "_", url.rsplit("/", 1)[-1])
        return self._read("form.html" if not (self.folder / f"{last}.html").exists() else f"{last}.html", url)

    def post(self, url: str, data: dict) -> Response:
        return self._read("page_0.html", self.results_url)


#: Extra attempts of a model call and the seconds before them.
RETRIES, DELAYS = int(os.environ.get("LLM_RETRY", "2")), (0.5, 1.0)


class ModelClient:
    """Calls of a model: tried again after time-outs, network errors and statuses of 500 and more; any
    other response is returned as it is, None when all attempts failed."""

    def __init__(self, provider: str, post: Callable[[str, dict], Response], retries: int = RETRIES, sleep=time.sleep):
        self.provider, self._post, self._retries, self._sleep = provider, post, retries, sleep

    def post(self, url: str, payload: dict) -> Response | None:
        began, size = time.monotonic(), len(json.dumps(payload, ensure_ascii=False))
        for attempt in range(self._retries + 1):
            try:
                response = self._post(url, payload)
                if response.status < 500:
                    log.info("provider=%s model=%s latency_ms=%d input_length=%d output_length=%d retry_count=%d", self.provider, payload.get("model", ""), (time.monotonic() - began) * 1000, size, len(response.text), attempt)
                    return response
                failure = f"status {response.status}"
            except (OSError, TimeoutError) as error:  # time-outs and connections
                failure = f"{type(error).__name__}: {error}"
            if attempt < self._retries:
                self._sleep(DELAYS[min(attempt, len(DELAYS) - 1)])
        log.warning("provider=%s failed: %s", self.provider, failure)
        return None


def chat_text(body: str) -> str | None:
    """The text of a chat reply: the first choice's message."""
    return json.loads(body)["choices"][0]["message"]["content"]


def block_text(body: str) -> str | None:
    """The text of a reply in blocks: the first of type text."""
    return next((b.get("text", "") for b in json.loads(body).get("content", []) if b.get("type") == "text"), None)


@dataclass(frozen=True)
class Provider:
    """How a model service is asked: its url, default model, reply reader, and whether the system message
    stands apart from the others."""

    url: str
    model: str
    read: Callable[[str], str | None]
    system_apart: bool = False


def chat_provider(url: str, model: str) -> Provider:
    """A service that takes all messages in one list and replies with choices."""
    return Provider(url, model, chat_text)


def block_provider(url: str, model: str) -> Provider:
    """A service that takes the system message apart and replies with blocks."""
    return Provider(url, model, block_text, system_apart=True)


# The public services, and the header that carries a key to each. ``register`` adds others.
PROVIDERS: dict[str, Provider] = {
    "openai": chat_provider("https://api.openai.com/v1/chat/completions", "gpt-4o-mini"),
    "deepseek": chat_provider("https://api.deepseek.com/chat/completions", "deepseek-chat"),
    "claude": block_provider("https://api.anthropic.com/v1/messages", "claude-3-haiku-20240307"),
}


def headers(name: str, key: str) -> dict[str, str]:
    """Headers of a call to a provider."""
    if PROVIDERS[name].system_apart:
        return {"x-api-key": key, "anthropic-version": "2023-06-01", "Content-Type": "application/json"}
    return {"Authorization": f"Bearer {key}", "Content-Type": "application/json"}


def register(name: str, provider: Provider) -> None:
    PROVIDERS[name] = provider


def configured() -> str | None:
    """Registers the provider that the environment describes and returns its name, None without one:
    LLM_PROVIDER (name), LLM_URL, LLM_MODEL and LLM_FORMAT (chat or blocks)."""
    name = os.environ.get("LLM_PROVIDER", "").strip().lower()
    if not name or name in PROVIDERS:
        return name or None
    make = {"chat": chat_provider, "blocks": block_provider}.get(os.environ.get("LLM_FORMAT", "chat"))
    if make is None or not os.environ.get("LLM_URL"):
        raise ValueError(f"provider {name!r} needs LLM_URL and an LLM_FORMAT of chat or blocks")
    register(name, make(os.environ["LLM_URL"], os.environ.get("LLM_MODEL", "")))
    return name


def text_model(name: str, post: Callable[[str, dict], Response], max_tokens: int = 512, **options) -> Callable[[list[dict]], str | None]:
    """A function from messages to the reply's text, None where the call or its reply fails; an unknown
    provider raises. The model is that of LLM_MODEL_<NAME> in the environment, else the provider's."""
    if name not in PROVIDERS:
        raise ValueError(f"unknown provider {name!r}; known: {', '.join(sorted(PROVIDERS)) or 'none'}")
    provider, client = PROVIDERS[name], ModelClient(name, post, **options)

    def ask(messages: list[dict]) -> str | None:
        payload: dict = {"model": os.environ.get(f"LLM_MODEL_{name.upper()}", provider.model), "max_tokens": max_tokens, "messages": messages}
        if provider.system_apart:
            system = [m["content"] for m in messages if m["role"] == "system"]
            payload |= {"system": system[-1] if system else "", "messages": [m for m in messages if m["role"] != "system"]}
        response = client.post(provider.url, payload)
        if response is None or response.status >= 400:
            return None
        try:
            return provider.read(response.text)
        except (ValueError, KeyError, IndexError, TypeError, AttributeError):
            return None

    return ask
