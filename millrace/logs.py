"""Progress events as closed sets of words, and their way into the standard library's logging."""

from __future__ import annotations

import logging
import os

from millrace.errors import MillraceError

OPERATIONS = ("register", "write_all")
PHASES = ("load_source", "cache", "output")
KINDS = ("started", "finished")
#: The variable that overrides the filter given in code.
VARIABLE = "MILLRACE_LOG"
_LEVELS = {"error": logging.ERROR, "warn": logging.WARNING, "info": logging.INFO, "debug": logging.DEBUG}


def init_logging(filter: str | None = None, logger: str = "millrace") -> bool:
    """Let events of this level and above reach the named logger; True if the level has changed.

    The environment's level goes before the given one; without either it is `info`.
    """
    level = (os.environ.get(VARIABLE) or filter or "info").lower()
    if level not in _LEVELS:
        raise MillraceError("configure", "invalid_option", f"unknown log level {level}", option="filter")
    log = logging.getLogger(logger)
    was = log.level
    log.setLevel(_LEVELS[level])
    return was != log.level


def event(operation: str, phase: str, kind: str, **facts: object) -> dict:
    """An event; words outside the closed sets are a mistake of the caller."""
    for word, known in ((operation, OPERATIONS), (phase, PHASES), (kind, KINDS)):
        if word not in known:
            raise ValueError(f"{word} is no known word of a progress event")
    logging.getLogger("millrace").info("%s %s %s", operation, phase, kind, extra={"facts": facts})
    return {"operation": operation, "phase": phase, "kind": kind, **facts}
