"""The recording state machine: commands, what the windows say of movement, and timers, as one transition table over event time.

A device is off, in standby, recording, asleep (sleeping, deepSleeping) or in a wakeup between. Standing still for long
enough puts it to sleep; asleep it wakes every cycle; a wakeup without a fix falls asleep again. Timers fire at their own
times, also where no event comes: whoever feeds events says up to when time has run.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from wayfold.operators.folds import fold


@dataclass(frozen=True)
class Cycles:
    """Seconds: still before sleep, from sleep to wakeup, from wakeup to sleep without a fix, and the least deep sleep (fixed values)."""

    still: float = 180.0
    sleep: float = 60.0
    fallback: float = 30.0
    least_deep: float = 900.0


CYCLES = Cycles()
ASLEEP = ("sleeping", "deepSleeping")


class Recorder:
    """A machine of few numbers; ``handle`` and ``run_until`` yield transitions (t, state before, state, cause)."""

    def __init__(self, state: str = "off", since: float | None = None, due: float | None = None, cycles: Cycles = CYCLES):
        self.state, self.since, self.due, self.cycles = state, since, due, cycles

    def _go(self, t: float, state: str, cause: str):
        before, self.state = self.state, state
        # sleep is followed by a wakeup, a wakeup by a look at what it has seen; other states wait for events
        self.due = {"sleeping": t + self.cycles.sleep, "wakeup": t + self.cycles.fallback}.get(state)
        if before != state:
            yield t, before, state, cause

    def run_until(self, t: float):
        """Fires the timers that are due before ``t`` or at it."""
        while self.due is not None and self.due <= t:
            at = self.due
            if self.state in ASLEEP:
                yield from self._go(at, "wakeup", "timer")
            else:  # a wakeup that saw no fix
                yield from self._go(at, "sleeping", "timer")

    def handle(self, t: float, kind: str, value: str | float | None = None):
        """An event: a command (start, stop, standby, wakeup, deep with the time to wake) or ``fix`` with the moving state."""
        if kind == "stop":
            yield from self._go(t, "off", kind)
        elif kind == "start":
            self.since = None
            yield from self._go(t, "recording", kind)
        elif kind == "standby":
            yield from self._go(t, "standby", kind)
        elif kind == "wakeup":
            if self.state not in ("wakeup", "recording"):
                # an app in standby that is woken takes over the recording
                yield from self._go(t, "recording" if self.state == "standby" else "wakeup", kind)
        elif kind == "deep":
            if value - t >= self.cycles.least_deep:
                yield from self._go(t, "deepSleeping", kind)
                self.due = value
        elif kind == "fix":
            yield from self._fix(t, value)

    def _fix(self, t: float, moving: str):
        self.since = (t if self.since is None else self.since) if moving == "stationary" else None
        if self.state in ("off", "standby"):
            return
        if self.state == "wakeup":
            if moving != "uncertain":
                yield from self._go(t, "recording" if moving == "moving" else "sleeping", "fix")
            else:
                self.due = t + self.cycles.fallback  # it goes on looking
            return
        rested = self.since is not None and t - self.since > self.cycles.still
        if moving == "moving" or (self.state == "recording" and not rested):
            if self.state != "recording":
                yield from self._go(t, "recording", "fix")
        elif self.state not in ASLEEP:
            yield from self._go(t, "sleeping", "fix")


TRANSITIONS = "device_id bigint, t double, state_before string, state string, cause string"


def transitions(events: DataFrame, cycles: Cycles = CYCLES) -> DataFrame:
    """(device_id, t, state_before, state, cause) of ``events`` (device_id, t, event_id, kind, moving, until), each device from off.

    Events at one time go by event_id. Timers run up to a device's last event. The machine's state is a few numbers; a
    batch of events at a time is held.
    """
    d = events.select("device_id", "t", "event_id", "kind", "moving", "until")

    def step(machine: Recorder, r: tuple):
        device, t, _, kind, moving, until = r
        found = [*machine.run_until(t), *machine.handle(t, kind, moving if kind == "fix" else until)]
        return (device, [(float(a), *x) for a, *x in found]) if found else None

    made = fold(d, lambda: Recorder(cycles=cycles), step, "device_id bigint, found array<struct<t:double,state_before:string,state:string,cause:string>>", order=("t", "event_id"))
    return made.selectExpr("device_id", "inline(found)")
