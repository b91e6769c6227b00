"""One error type with a closed set of kinds; messages never carry secrets or control characters."""

from __future__ import annotations

import re


def clean(text: str) -> str:
    """Control characters escaped; user info, query and fragment of URIs removed."""
    text = re.sub(r"([a-z][a-z0-9+.-]*://)[^/\s@]*@", r"\1", str(text), flags=re.I)
    text = re.sub(r"([a-z][a-z0-9+.-]*://[^\s?#]*)[?#][^\s]*", r"\1", text, flags=re.I)
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"\\x{ord(m[0]):02x}", text)


class MillraceError(Exception):
    """phase: where it arose; kind: what it is; context: facts for a report."""

    def __init__(self, phase: str, kind: str, message: str, **context: object):
        super().__init__(clean(message))
        self.phase, self.kind, self.message, self.context = phase, kind, clean(message), context
