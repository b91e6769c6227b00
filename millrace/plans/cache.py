"""Which registered aliases several outputs share and are worth keeping while the outputs run."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from millrace.errors import MillraceError


@dataclass
class Alias:
    """A registered derived table: the tables its query reads, whether that is fully known, its order of registration."""

    name: str
    reads: list[str]
    complete: bool = True
    order: int = 0


@dataclass
class CachePlan:
    mode: str
    selected: list[str] = field(default_factory=list)
    covered: list[str] = field(default_factory=list)
    skipped: str | None = None


def reachable(start: Sequence[str], aliases: Mapping[str, Alias]) -> set[str]:
    """All tables behind `start`, itself included."""
    seen: set[str] = set()
    todo = list(start)
    while todo:
        if (name := todo.pop()) not in seen:
            seen.add(name)
            todo += aliases[name].reads if name in aliases else []
    return seen


def plan_cache(mode: str | Sequence[str], outputs: Sequence[Sequence[str]], aliases: Mapping[str, Alias], known: Sequence[bool] | None = None) -> CachePlan:
    """outputs: the tables each output reads directly (an output that is an alias reads just that).

    auto: of the aliases that two or more outputs share, those not behind another one shared by the
    same outputs (the deepest: everything behind them is then computed once). explicit: as listed,
    if each is known, shared rules hold and everything that reads it can be replayed.
    """
    uses = [reachable(o, aliases) for o in outputs]
    shared = {n: {i for i, u in enumerate(uses) if n in u} for n in aliases}
    eligible = [n for n in aliases if len(shared[n]) >= 2 and aliases[n].complete]
    if mode == "disabled":
        return CachePlan("disabled", skipped="disabled")
    if mode == "auto":
        if len(outputs) < 2:
            return CachePlan("auto", skipped="fewer_than_two_outputs")
        above = {n: {m for m in eligible if m != n and n in reachable([m], aliases)} for n in eligible}
        frontier = [n for n in eligible if not any(shared[m] == shared[n] for m in above[n])]
        chosen = sorted(frontier, key=lambda n: aliases[n].order)
        return CachePlan("auto", chosen, sorted(set(eligible) - set(chosen)), None if chosen else "nothing_shared")
    names = [n.lower() for n in mode]
    if not names:
        raise MillraceError("plan_cache", "empty_list", "name at least one alias")
    if len(set(names)) < len(names):
        raise MillraceError("plan_cache", "duplicate_alias", "an alias is listed twice")
    for n in names:
        if n not in aliases:
            raise MillraceError("plan_cache", "unknown_alias", f"{n} is no registered alias")
        if n not in eligible:
            raise MillraceError("plan_cache", "not_eligible", f"{n} is not shared by two outputs with known lineage")
    for n in names:
        # whatever stands between an output and the alias is planned anew over it, so all of it must be known
        between = {m for use in uses if n in use for m in use if m in aliases and m != n and n in reachable([m], aliases)}
        behind = {m for m in reachable([n], aliases) if m in aliases}
        lost = sorted(m for m in between | behind if not aliases[m].complete)
        if lost or known and not all(known[i] for i in shared[n]):
            raise MillraceError("plan_cache", "not_replayable", f"{n} can't be kept: the lineage of {lost[0] if lost else 'an output'} is unknown")
    return CachePlan("explicit", sorted(names, key=lambda n: aliases[n].order))
