"""Logging as a pipeline's settings ask for: text or JSON, console and a rotating file."""

from __future__ import annotations

import datetime as dt
import gzip
import json
import logging
import logging.handlers
import os
import shutil
import sys
import time
from pathlib import Path

from .plans.config import Block


class JsonLines(logging.Formatter):
    def format(self, record: logging.LogRecord) -> str:
        out = {"time": dt.datetime.fromtimestamp(record.created, dt.UTC).isoformat(), "level": record.levelname, "logger": record.name, "msg": record.getMessage()}
        if record.exc_info:
            out["error"] = self.formatException(record.exc_info)
        return json.dumps(out, ensure_ascii=False)


class Rolling(logging.handlers.BaseRotatingHandler):
    """A file that is renamed by size, age or time of day; old ones are compressed and removed."""

    def __init__(self, path: str, rotation: dict, retention: dict | None, gzip_old: bool):
        Path(path).parent.mkdir(parents=True, exist_ok=True)
        super().__init__(path, "a", encoding="utf-8")
        self.rotation, self.retention, self.gzip_old = rotation, retention, gzip_old
        self.due = self._next(time.time())

    def _next(self, now: float) -> float:
        if "seconds" in self.rotation:
            return now + self.rotation["seconds"]
        if "daily_at" in self.rotation:
            hour, minute = self.rotation["daily_at"]
            at = dt.datetime.fromtimestamp(now).replace(hour=hour, minute=minute, second=0, microsecond=0)
            return (at if at.timestamp() > now else at + dt.timedelta(days=1)).timestamp()
        return float("inf")

    def shouldRollover(self, record: logging.LogRecord) -> bool:  # noqa: N802
        if "bytes" in self.rotation:
            self.stream.seek(0, 2)
            return self.stream.tell() > 0 and self.stream.tell() + len(self.format(record).encode()) + 1 > self.rotation["bytes"]
        return time.time() >= self.due

    def doRollover(self) -> None:  # noqa: N802
        self.stream.close()
        old = f"{self.baseFilename}.{time.time_ns()}"
        os.replace(self.baseFilename, old)
        if self.gzip_old:
            with open(old, "rb") as source, gzip.open(f"{old}.gz", "wb") as target:
                shutil.copyfileobj(source, target)
            os.remove(old)
        self._remove_old()
        self.due = self._next(time.time())
        self.stream = self._open()

    def _remove_old(self) -> None:
        base = Path(self.baseFilename)
        old = sorted(p for p in base.parent.glob(base.name + ".*") if p.name[len(base.name) + 1 :].split(".")[0].isdigit())
        if not self.retention:
            return
        if "files" in self.retention:
            gone = old[: max(0, len(old) - self.retention["files"])]
        else:
            gone = [p for p in old if p.stat().st_mtime < time.time() - self.retention["seconds"]]
        for p in gone:
            p.unlink()


def set_up(settings: Block, name: str = "tidelog") -> logging.Logger:
    """The package's logger with the handlers that were asked for; without any, the console's."""
    logger = logging.getLogger(name)
    logger.setLevel({"WARN": "WARNING"}.get(settings.level, settings.level))
    for h in list(logger.handlers):
        logger.removeHandler(h)
        h.close()
    handlers: list[logging.Handler] = []
    if settings.console or not settings.file:
        handlers.append(logging.StreamHandler(sys.stdout if settings.console and settings.console.stream == "stdout" else sys.stderr))
    if settings.file:
        handlers.append(Rolling(settings.file.path, settings.file.rotation, settings.file.retention, settings.file.gzip))
    for h in handlers:
        h.setFormatter(JsonLines() if settings.format == "json" else logging.Formatter("%(asctime)s %(levelname)s %(name)s %(message)s"))
        logger.addHandler(h)
    return logger
