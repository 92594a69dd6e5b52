"""Logging and trace events."""

from __future__ import annotations

import json
import logging
import os

ROOT = "tessera"


def logger(name: str) -> logging.Logger:
    """A logger under the package's own, whose level TESSERA_LOG_LEVEL sets (INFO without it)."""
    root = logging.getLogger(ROOT)
    if not root.handlers:
        handler = logging.StreamHandler()
        handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(name)s %(message)s"))
        root.addHandler(handler)
        root.setLevel(os.environ.get("TESSERA_LOG_LEVEL", "INFO").upper())
    return logging.getLogger(name if name.startswith(ROOT) else f"{ROOT}.{name}")


def trace(log: logging.Logger, event: str, **fields) -> None:
    """'TRACE event | key=json ...' at debug level; values that JSON can't express as text."""
    if not log.isEnabledFor(logging.DEBUG):
        return

    def shown(value) -> str:
        try:
            return json.dumps(value, ensure_ascii=False)
        except (TypeError, ValueError):
            return str(value)

    log.debug("TRACE %s | %s", event, " ".join(f"{k}={shown(v)}" for k, v in fields.items()))
