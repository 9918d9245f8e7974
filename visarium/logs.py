"""The engine's log, to the console and to a file that starts anew when it is full."""

from __future__ import annotations

import logging
from logging.handlers import RotatingFileHandler


def setup_logging(level: int = logging.INFO, path: str | None = None, most_bytes: int = 10 << 20, kept: int = 5) -> logging.Logger:
    """The logger `visarium` with one console handler and, with a path, one rotating file; calling it again changes no more."""
    log = logging.getLogger("visarium")
    log.setLevel(level)
    form = logging.Formatter("%(asctime)s %(name)s %(levelname)s %(message)s")
    wanted = [("console", logging.StreamHandler)] + ([(path, lambda: RotatingFileHandler(path, maxBytes=most_bytes, backupCount=kept))] if path else [])
    for name, make in wanted:
        if name not in {h.get_name() for h in log.handlers}:
            handler = make()
            handler.set_name(name)
            handler.setFormatter(form)
            log.addHandler(handler)
    return log
