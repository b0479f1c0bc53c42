"""Structured Streaming twins: watermarked windows, ordered folds with timers, debounced changes, and upserts of each micro-batch."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from wayfold.operators.folds import Kalman
from wayfold.operators.recorder import CYCLES, TRANSITIONS, Cycles, Recorder
from wayfold.operators.store import latest


def windowed(fixes: DataFrame, late: str = "60 seconds", width: str = "5 minutes") -> DataFrame:
    """Counts and mean speeds by device and window; fixes later than ``late`` are dropped."""
    w = fixes.withWatermark("date", late).groupBy("device_id", F.window("date", width))
    return w.agg(F.count(F.lit(1)).alias("n"), F.avg("speed").alias("speed")).select("device_id", F.col("window.start").alias("start"), "n", "speed")


class Fold:
    """What in_order() runs for a key: ``load`` from and ``save`` to plain values, ``step`` for a row, ``until`` for time that has run, ``due`` for the next timer."""

    due: float | None = None

    def load(self, saved: list) -> None:
        raise NotImplementedError

    def save(self) -> list:
        raise NotImplementedError

    def step(self, key: tuple, row: list) -> Iterator[tuple]:
        raise NotImplementedError

    def until(self, key: tuple, t: float) -> Iterator[tuple]:
        return iter(())


def in_order(rows: DataFrame, make: Callable[[], Fold], schema: str, order: list[str], *, key: str = "device_id", late: str = "60 seconds", forget: float | None = None) -> DataFrame:
    """A fold over each key's rows in the order of time, as a stateful operator on event time.

    ``rows`` have a timestamp ``date``, seconds ``t``, the key and what ``order`` names first. They wait in the state until the watermark
    (``late`` behind the newest) has passed them and are then taken by ``order``: what comes out depends neither on the order of arrival
    nor on how rows are cut into batches. Rows later than the watermark are dropped. A timer wakes the key when its next row or
    the fold's own timer is due; with ``forget``, a key without rows for so many seconds of event time leaves the state and begins anew.
    A key holds the rows of ``late`` seconds and of one micro-batch.
    """
    names = [c for c in rows.columns if c not in ("date", key)]
    t_at, by = names.index("t"), [names.index(c) for c in order]
    out = [c.split()[0] for c in schema.split(", ")]

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        fold, waiting, taken = make(), [], None
        if state.exists:
            saved, waiting, taken = json.loads(state.get[0])
            fold.load(saved)
        for b in batches:
            b = b[names].astype(object)
            waiting.extend(list(r) for r in b.where(b.notna(), None).itertuples(index=False, name=None))
        now = state.getCurrentWatermarkMs() / 1000
        waiting.sort(key=lambda r: [r[i] for i in by])
        ready = [r for r in waiting if r[t_at] <= now]
        waiting = waiting[len(ready) :]
        found = []
        for r in ready:
            if forget is not None and taken is not None and r[t_at] - taken >= forget:
                fold = make()
            found.extend(fold.until(k, r[t_at]))
            found.extend(fold.step(k, r))
            taken = r[t_at]
        found.extend(fold.until(k, now) if now > 0 else ())
        if forget is not None and taken is not None and not waiting and now >= taken + forget:
            state.remove()
        else:
            state.update((json.dumps([fold.save(), waiting, taken]),))
            due = [waiting[0][t_at] if waiting else None, fold.due, None if forget is None or taken is None else taken + forget]
            due = [x for x in due if x is not None]
            if due:
                state.setTimeoutTimestamp(int(max(min(due), now) * 1000) + 1)
        yield pd.DataFrame(found, columns=out)

    d = rows.withWatermark("date", late)
    return d.groupBy(key).applyInPandasWithState(run, schema, "saved string", "append", GroupStateTimeout.EventTimeTimeout)


class _Filter(Fold):
    def __init__(self, q: float):
        self.k = Kalman(q)

    def load(self, saved: list) -> None:
        self.k.variance, self.k.t, values = saved
        self.k.values = values and tuple(values)

    def save(self) -> list:
        return [self.k.variance, self.k.t, self.k.values]

    def step(self, key: tuple, row: list) -> Iterator[tuple]:
        t, sample, lat, lng, acc = row
        if lat is None or lng is None or acc is None or acc < 0 or (lat == 0 and lng == 0) or (self.k.t is not None and t <= self.k.t):
            return
        yield (sample, key[0], t, *self.k.update(t, acc, (lat, lng)))


def filtered(fixes: DataFrame, q: float = 4.0, late: str = "60 seconds", forget: float | None = None) -> DataFrame:
    """The coordinate filter over a stream with a timestamp ``date``: what the batch form says of all fixes that weren't late."""
    d = fixes.select("date", "device_id", "t", "sample_id", "latitude", "longitude", "h_acc")
    return in_order(d, lambda: _Filter(q), "sample_id bigint, device_id bigint, t bigint, latitude double, longitude double", ["t", "sample_id"], late=late, forget=forget)


class _Recording(Fold):
    def __init__(self, cycles: Cycles):
        self.machine = Recorder(cycles=cycles)

    @property
    def due(self) -> float | None:
        return self.machine.due

    def load(self, saved: list) -> None:
        self.machine.state, self.machine.since, self.machine.due = saved

    def save(self) -> list:
        return [self.machine.state, self.machine.since, self.machine.due]

    def step(self, key: tuple, row: list) -> Iterator[tuple]:
        t, _, kind, moving, until = row
        for at, *x in self.machine.handle(t, kind, moving if kind == "fix" else until):
            yield (key[0], float(at), *x)

    def until(self, key: tuple, t: float) -> Iterator[tuple]:
        for at, *x in self.machine.run_until(t):
            yield (key[0], float(at), *x)


def recording(events: DataFrame, cycles: Cycles = CYCLES, late: str = "60 seconds") -> DataFrame:
    """recorder.transitions() over a stream of events with a timestamp ``date``; timers fire with the watermark, without any event."""
    d = events.select("date", "device_id", "t", "event_id", "kind", "moving", "until")
    return in_order(d, lambda: _Recording(cycles), TRANSITIONS, ["t", "event_id"], late=late)


def debounced(changes: DataFrame, quiet: str = "1 second", late: str | None = None, key: str = "device_id", id_col: str = "sample_id") -> DataFrame:
    """(key, since, until, n_changes, changed): changes of a key held back until more than ``quiet`` has passed without any, then told once.

    ``changes`` have a timestamp ``date``. Repeated changes of an id are one in ``changed``, a sorted list. On a stream ``late`` is
    needed: an update comes when the watermark has passed its end, and changes later than that are dropped.
    """
    d = changes.withWatermark("date", late) if late else changes
    g = d.groupBy(key, F.session_window("date", quiet).alias("w"))
    g = g.agg(F.min("date").alias("since"), F.max("date").alias("until"), F.count(F.lit(1)).alias("n_changes"), F.sort_array(F.collect_set(id_col)).alias("changed"))
    return g.drop("w")


def upserts(changes: DataFrame, path: str, keys: list[str], order: list[str], checkpoint: str, on_update: Callable[[DataFrame], None] | None = None):
    """Writes each micro-batch's last row of each key as a new version under ``path``; readers take latest() of all versions."""

    def write(batch: DataFrame, number: int) -> None:
        rows = latest(batch, keys, order)
        rows.write.mode("overwrite").parquet(f"{path}/version={number}")
        if on_update:
            on_update(rows)

    return changes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
