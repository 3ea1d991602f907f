"""Keyed machines with alarms: what a library watcher decides from one key's events in time order.

A machine is plain state and two moves: an event, and an alarm that comes due.
``galena.streaming.timed`` runs the same machine over tables and over streams.
Times are microseconds; an alarm comes before events of its own time. State is
what ``vars`` gives, in terms of JSON.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

MS = 1000


class Machine:
    """``fields`` are the event columns it takes, ``output`` the columns of what it emits after the time."""

    fields: tuple[str, ...] = ()
    output: str = ""

    def start(self) -> dict[str, Any]:
        """State of a key before its first event."""
        return {}

    def on(self, s: dict, at: int, event: tuple) -> Iterator[tuple]:
        """Take an event; yield (time, *output)."""
        raise NotImplementedError

    def due(self, s: dict) -> int | None:
        """When the next alarm comes."""
        return None

    def fire(self, s: dict, at: int) -> Iterator[tuple]:
        """The alarm of time ``at``."""
        return iter(())


def advance(machine: Machine, state: dict, events: Iterator[tuple[int, tuple]], until: int | None) -> Iterator[tuple]:
    """Feed ``events`` in their order and fire what comes due before them, and by ``until``."""
    for at, event in events:
        while (t := machine.due(state)) is not None and t <= at:
            yield from machine.fire(state, t)
        yield from machine.on(state, at, event)
    while until is not None and (t := machine.due(state)) is not None and t <= until:
        yield from machine.fire(state, t)


class Spaced(Machine):
    """Events at least ``spacing_ms`` after the last accepted one of their key; a refused one does not extend the span.

    A key is forgotten six spacings after its last accepted event.
    """

    output = "accepted boolean, id long"
    fields = ("id",)

    def __init__(self, spacing_ms: int = 3000):
        self.spacing = spacing_ms * MS

    def start(self) -> dict:
        return {"last": None}

    def on(self, s: dict, at: int, event: tuple) -> Iterator[tuple]:
        ok = s["last"] is None or at - s["last"] >= self.spacing
        s["last"] = at if ok else s["last"]
        yield at, ok, event[0]

    def due(self, s: dict) -> int | None:
        return None if s["last"] is None else s["last"] + 6 * self.spacing

    def fire(self, s: dict, at: int) -> Iterator[tuple]:
        s["last"] = None
        return iter(())


class Watch(Machine):
    """What becomes of a path: synced, skipped or removed.

    An add or change waits for ``settle_ms`` of quiet; then the file is looked
    at every ``probe_ms``, at most ``probes`` times, until two looks in a row
    find the same size, over zero, and time. A path that is gone at a look, or
    never stable, is skipped. An unlink waits ``delay_ms``, anew with each
    unlink; a path that is back by then is looked at at once, in place of a
    wait still open, and one that is not is removed.
    """

    output = "outcome string"
    fields = ("kind", "size", "mtime")

    def __init__(self, settle_ms: int = 700, delay_ms: int = 3000, probe_ms: int = 250, probes: int = 8):
        self.settle, self.delay, self.every, self.probes = settle_ms * MS, delay_ms * MS, probe_ms * MS, probes

    def start(self) -> dict:
        return {"seen": None, "settle": None, "delete": None, "looks": []}

    def on(self, s: dict, at: int, event: tuple) -> Iterator[tuple]:
        kind, size, mtime = event
        if kind == "unlink":
            s["seen"], s["delete"] = None, at + self.delay
        else:
            s["seen"], s["settle"] = [size, mtime], at + self.settle
        return iter(())

    def due(self, s: dict) -> int | None:
        return min((t for t in (s["delete"], s["settle"], *(look[0] for look in s["looks"])) if t is not None), default=None)

    def fire(self, s: dict, at: int) -> Iterator[tuple]:
        if s["delete"] is not None and s["delete"] <= at:
            s["delete"] = None
            if s["seen"] is None:
                yield at, "removed"
            else:
                s["settle"] = at
        elif s["settle"] is not None and s["settle"] <= at:
            s["settle"] = None
            s["looks"].append([at, 0, None])
        else:
            look = min(s["looks"], key=lambda x: x[:2])
            s["looks"].remove(look)
            _, n, before = look
            now = s["seen"]
            if n == self.probes or now is None:
                yield at, "skipped"
            elif now == before and (now[0] or 0) > 0:
                yield at, "synced"
            else:
                s["looks"].append([at + self.every, n + 1, now if (now[0] or 0) > 0 else before])
        if s["seen"] is not None and self.due(s) is None:
            s["seen"] = None  # nothing waits: the next event says anew what is there


class Throttle(Machine):
    """Changes counted by kind, told ``span_ms`` after the first of them; the next event after that begins anew.

    Spans without any of the ``changes`` are not told.
    """

    output = "added long, updated long, removed long, scanned long"
    fields = ("kind",)

    def __init__(self, span_ms: int = 500, changes: tuple[str, ...] = ("added", "updated", "removed")):
        self.span, self.changes = span_ms * MS, changes

    def start(self) -> dict:
        return {"flush": None, "n": {}}

    def on(self, s: dict, at: int, event: tuple) -> Iterator[tuple]:
        s["n"][event[0]] = s["n"].get(event[0], 0) + 1
        if s["flush"] is None:
            s["flush"] = at + self.span
        return iter(())

    def due(self, s: dict) -> int | None:
        return s["flush"]

    def fire(self, s: dict, at: int) -> Iterator[tuple]:
        n, s["n"], s["flush"] = s["n"], {}, None
        if any(n.get(k) for k in self.changes):
            yield (at, *(n.get(k, 0) for k in self.changes), sum(n.values()))


class ScanGate(Machine):
    """Scans that requests start: ``delay_ms`` after the request, ``startup_ms`` at startup, each request in place of one still waiting.

    A focus within ``least_ms`` of the last scan starts none (and the one that
    waited goes too).
    """

    output = "reason string"
    fields = ("reason",)

    def __init__(self, least_ms: int = 60_000, delay_ms: int = 300, startup_ms: int = 1000):
        self.least, self.delay, self.startup = least_ms * MS, delay_ms * MS, startup_ms * MS

    def start(self) -> dict:
        return {"last": None, "scan": None, "reason": None}

    def on(self, s: dict, at: int, event: tuple) -> Iterator[tuple]:
        s["scan"], s["reason"] = at + (self.startup if event[0] == "startup" else self.delay), event[0]
        if event[0] == "focus" and s["last"] is not None and at - s["last"] < self.least:
            s["scan"] = s["reason"] = None
        return iter(())

    def due(self, s: dict) -> int | None:
        if s["scan"] is not None:
            return s["scan"]
        return None if s["last"] is None else s["last"] + self.least  # the last scan is forgotten

    def fire(self, s: dict, at: int) -> Iterator[tuple]:
        if s["scan"] is None:
            s["last"] = None
        else:
            reason, s["last"] = s["reason"], at
            s["scan"] = s["reason"] = None
            yield at, reason


class SingleFlight(Machine):
    """Runs that wakes start, one at a time: wakes of a busy key are one run after it, whether it is done or has failed.

    A run that reports nothing for ``lease_ms`` counts as failed. Emits starts
    and ``lost`` runs.
    """

    output = "move string"
    fields = ("kind",)

    def __init__(self, lease_ms: int = 600_000):
        self.lease = lease_ms * MS

    def start(self) -> dict:
        return {"ends": None, "dirty": False}

    def on(self, s: dict, at: int, event: tuple) -> Iterator[tuple]:
        if event[0] == "wake":
            if s["ends"] is None:
                s["ends"] = at + self.lease
                yield at, "start"
            else:
                s["dirty"] = True
        elif s["ends"] is not None:
            yield from self.ended(s, at)

    def ended(self, s: dict, at: int) -> Iterator[tuple]:
        again, s["dirty"], s["ends"] = s["dirty"], False, None
        if again:
            s["ends"] = at + self.lease
            yield at, "start"

    def due(self, s: dict) -> int | None:
        return s["ends"]

    def fire(self, s: dict, at: int) -> Iterator[tuple]:
        yield at, "lost"
        yield from self.ended(s, at)


class IdBatches(Machine):
    """Ids gathered until ``quiet_ms`` pass without one, each once; one row an id.

    Ids of a failed batch come back as events of kind ``failed``: they wait
    for the next id and start no batch themselves.
    """

    output = "id long"
    fields = ("kind", "id")

    def __init__(self, quiet_ms: int = 800):
        self.quiet = quiet_ms * MS

    def start(self) -> dict:
        return {"ids": [], "flush": None}

    def on(self, s: dict, at: int, event: tuple) -> Iterator[tuple]:
        kind, own = event
        if own not in s["ids"]:
            s["ids"].append(own)
        if kind != "failed":
            s["flush"] = at + self.quiet
        return iter(())

    def due(self, s: dict) -> int | None:
        return s["flush"]

    def fire(self, s: dict, at: int) -> Iterator[tuple]:
        ids, s["ids"], s["flush"] = s["ids"], [], None
        for own in ids:
            yield at, own
