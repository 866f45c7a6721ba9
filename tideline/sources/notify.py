"""Alerts to a chat: nothing happens until a token and a chat are set, and a failure never reaches the caller."""

from __future__ import annotations

import html
import json
import logging
import os
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

log = logging.getLogger(__name__)


def post(url: str, payload: dict, seconds: float = 15.0) -> None:
    """POSTs JSON; raises on any status but success."""
    request = urllib.request.Request(url, json.dumps(payload).encode(), {"Content-Type": "application/json"})
    with urllib.request.urlopen(request, timeout=seconds):
        pass


@dataclass(frozen=True)
class Chat:
    """Where alerts go. ``deliver`` takes a URL and a payload."""

    token: str | None = field(default_factory=lambda: os.environ.get("TELEGRAM_BOT_TOKEN"))
    chat: str | None = field(default_factory=lambda: os.environ.get("TELEGRAM_CHAT_ID"))
    deliver: Callable[[str, dict], None] = post

    def send(self, text: str) -> bool:
        """Whether the text was delivered. It is sent as HTML, so what HTML would read as markup is escaped."""
        if not (self.token and self.chat):
            log.info("no chat is set; not sent: %s", text[:120])
            return False
        payload = {"chat_id": self.chat, "text": html.escape(text), "parse_mode": "HTML"}
        try:
            self.deliver(f"https://api.telegram.org/bot{self.token}/sendMessage", payload)
        except Exception as e:
            log.error("an alert was lost: %s: %s", type(e).__name__, text[:200])
            return False
        return True


def alert_rows(df: DataFrame, chat: Chat, column: str = "message", most: int = 20) -> int:
    """Sends the texts of a small result, the first ``most`` in order, and how many more there are; returns how many were delivered."""
    rows = df.select(column).orderBy(column).limit(most).collect()
    more = df.count() - len(rows)
    texts = [r[0] for r in rows if r[0] is not None] + ([f"and {more} more"] if more else [])
    return sum(chat.send(t) for t in texts)
