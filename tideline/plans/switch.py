"""The on/off switch before external models are called: an environment variable, or a flag file with an expiry. Closed when in doubt."""

from __future__ import annotations

import datetime as dt
import json
import os

VARIABLE = "TIDELINE_MODELS"


class Disabled(RuntimeError):
    """Calls of external models are off."""


class Switch:
    def __init__(self, path: str, variable: str = VARIABLE):
        self.path, self.variable = path, variable

    def on(self, hours: float, now: dt.datetime | None = None) -> dt.datetime:
        """Opens for some hours (above 0, at most a week) and returns until when."""
        if not 0 < hours <= 168:
            raise ValueError("hours must be above 0 and at most 168")
        until = (now or dt.datetime.now(dt.UTC)) + dt.timedelta(hours=hours)
        os.makedirs(os.path.dirname(self.path) or ".", exist_ok=True)
        side = f"{self.path}.new"
        with open(side, "w", encoding="utf-8") as f:
            json.dump({"until": until.isoformat()}, f)
        os.replace(side, self.path)
        return until

    def off(self) -> None:
        if os.path.exists(self.path):
            os.remove(self.path)

    def until(self) -> dt.datetime | None:
        """When the flag expires; None if there is none, or one that can't be read."""
        try:
            with open(self.path, encoding="utf-8") as f:
                found = dt.datetime.fromisoformat(json.load(f)["until"])
            return found if found.tzinfo else None
        except (OSError, ValueError, KeyError, TypeError):
            return None

    def enabled(self, now: dt.datetime | None = None) -> bool:
        if os.environ.get(self.variable, "").strip().lower() in ("1", "true", "on", "yes"):
            return True
        until = self.until()
        return until is not None and (now or dt.datetime.now(dt.UTC)) < until

    def status(self, now: dt.datetime | None = None) -> dict:
        return {"enabled": self.enabled(now), "until": self.until(), "variable": os.environ.get(self.variable)}

    def ensure(self, what: str) -> None:
        if not self.enabled():
            raise Disabled(f"{what}: calls of external models are off; set {self.variable}=1 or switch them on for some hours")
