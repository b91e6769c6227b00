"""Names of sources, aliases and outputs."""

from __future__ import annotations

import re
from collections.abc import Iterable

from millrace.errors import MillraceError

#: Words that can't be names.
RESERVED = set(
    """
    all alter analyze and anti as asof by case connect cross delete distinct distribute drop else end except exists
    explain false fetch for format from full global group having in inner insert intersect into is join lateral left
    like limit minus natural not null offset on open or order outer partition pivot prewhere qualify returning right
    sample select semi set settings sort start table tablesample then top true union unpivot update using values view
    when where window with
    """.split()
)


def check_name(name: str, taken: Iterable[str] = ()) -> str:
    """The name, if it is valid and free; an invalid name is reported before a taken one."""
    if not name:
        why = "a name must not be empty"
    elif not re.match(r"[A-Za-z_]", name):
        why = "a name must start with an ASCII letter or underscore"
    elif not re.fullmatch(r"[A-Za-z0-9_]+", name):
        why = "a name may contain only ASCII letters, digits and underscores"
    elif name.lower() in RESERVED:
        why = "a name must not be an SQL keyword"
    elif name.lower() in {t.lower() for t in taken}:
        raise MillraceError("register", "duplicate_name", f"the name {name} is taken", name=name)
    else:
        return name
    raise MillraceError("register", "invalid_name", f"{why}: {name!r}", name=name)


def fnv1a64(text: str) -> str:
    """FNV-1a over the UTF-8 bytes, 16 hex digits: identifies a query in reports without its text."""
    value = 0xCBF29CE484222325
    for byte in text.encode():
        value = (value ^ byte) * 0x100000001B3 % (1 << 64)
    return f"{value:016x}"
