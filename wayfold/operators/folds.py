"""Sequential operators: state that runs along a device's rows in the order of time.

Rows are dealt out by device and sorted; each task reads its rows a batch at a time and carries only the state of the
device at hand, so memory doesn't grow with a device's history.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from wayfold.schemas import LIMITS, SLEEP_STATES, Thresholds


def fold(df: DataFrame, start: Callable[[], object], step: Callable[[object, tuple], tuple | None], schema: str, order: tuple[str, ...] = ("t", "sample_id"), key: str = "device_id") -> DataFrame:
    """Runs ``step(state, row)`` over each device's rows in order and keeps what isn't None; ``start()`` makes a state."""
    names = df.columns
    at = names.index(key)
    out = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, device = None, object()
        for b in batches:
            rows = []
            for r in b.astype(object).where(b.notna(), None).itertuples(index=False, name=None):
                if r[at] != device:
                    state, device = start(), r[at]
                made = step(state, r)
                if made is not None:
                    rows.append(made)
            yield pd.DataFrame(rows, columns=out)

    return df.repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, schema)


def throttled(fixes: DataFrame, seconds: float) -> DataFrame:
    """Drops a fix if the last accepted one is at least as accurate and younger than ``seconds``."""
    d = fixes.select("device_id", "t", "sample_id", "h_acc")

    def step(state: dict, r: tuple):
        if state and r[1] - state["t"] < seconds and state["acc"] <= r[3]:
            return None
        state.update(t=r[1], acc=r[3])
        return r[2], r[0], r[1]

    return fold(d, dict, step, "sample_id bigint, device_id bigint, t bigint")


def rate_limited(samples: DataFrame, per_minute: float) -> DataFrame:
    """Keeps a sample if the last kept one is at least a minute's share older."""
    d = samples.select("device_id", "t", "sample_id")

    def step(state: dict, r: tuple):
        if state and r[1] - state["t"] < 60 / per_minute:
            return None
        state["t"] = r[1]
        return r[2], r[0], r[1]

    return fold(d, dict, step, "sample_id bigint, device_id bigint, t bigint")


class Kalman:
    """Scalar filter: variance in squared metres, growing with time, shared by the values it carries."""

    def __init__(self, q: float):
        self.q, self.variance, self.t, self.values = q, -1.0, None, None

    def update(self, t: float, accuracy: float, values: tuple[float, ...]) -> tuple[float, ...]:
        if self.variance < 0:
            self.variance, self.t, self.values = accuracy**2, t, values
            return values
        if t > self.t:
            self.variance += (t - self.t) * self.q**2
            self.t = t
        k = self.variance / (self.variance + accuracy**2)
        self.values = tuple(v + k * (x - v) for v, x in zip(self.values, values))
        self.variance *= 1 - k
        return self.values


def kalman(fixes: DataFrame, q_place: float = 4.0, q_height: float = 3.0, trust: DataFrame | None = None) -> DataFrame:
    """Filtered fixes: (sample_id, device_id, t, latitude, longitude, variance, altitude, v_acc).

    With ``trust``, a table as stats.coordinate_trust() makes it or another's judgement of places, fixes in places that aren't trusted are followed less.

    A fix that is unusable or not newer than the last is left out. Heights need a vertical accuracy above 0 and may be
    of the same time; the first is taken as it is; before it, altitude is 0 and v_acc -1.
    """
    if trust is not None:
        from wayfold.operators.stats import worsened

        fixes = worsened(fixes, trust)
    d = fixes.select("device_id", "t", "sample_id", "latitude", "longitude", "h_acc", "altitude", "v_acc")

    def start():
        return {"place": Kalman(q_place), "height": Kalman(q_height)}

    def step(s: dict, r: tuple):
        device, t, sample, lat, lng, acc, alt, v_acc = r
        if v_acc is not None and v_acc > 0 and alt is not None and (s["height"].t is None or t >= s["height"].t):
            s["height"].update(t, v_acc, (alt,))
        if lat is None or lng is None or acc is None or acc < 0 or (lat == 0 and lng == 0) or (s["place"].t is not None and t <= s["place"].t):
            return None
        lat, lng = s["place"].update(t, acc, (lat, lng))
        height = s["height"].values
        return sample, device, t, lat, lng, s["place"].variance, height[0] if height else 0.0, s["height"].variance**0.5 if height else -1.0

    return fold(d, start, step, "sample_id bigint, device_id bigint, t bigint, latitude double, longitude double, variance double, altitude double, v_acc double")


def recorded_items(samples: DataFrame, limits: Thresholds = LIMITS) -> DataFrame:
    """Items as a recorder makes them: (sample_id, device_id, item_no, is_visit), with types and speeds deciding between paths.

    A new item after a gap and when moving flips; two moving samples share one if the type is the path's commonest
    moving type so far, or if both are faster than the mode-shift speed. Counts by type are the only state that grows.
    """
    d = samples.select("device_id", "t", "sample_id", "moving_state", "recording_state", "confirmed_type", "classified_type", "speed")

    def step(s: dict, r: tuple):
        device, t, sample, state, recording, confirmed, classified, speed = r
        kind, moves = confirmed or classified, state != "stationary"
        gap = moves and recording == "off"
        same = bool(s) and s["moves"] == moves and s["gap"] == gap
        if same and moves and not gap and kind != s["kind"]:
            fast = limits.mode_shift_kmh / 3.6
            same = s["speed"] is not None and speed is not None and s["speed"] > fast and speed > fast
        if not same:
            s.update(no=s.get("no", 0) + 1, moves=moves, gap=gap, counts={}, kind=None)
        if kind != "stationary":
            s["counts"][kind] = s["counts"].get(kind, 0) + 1
            s["kind"] = max(s["counts"], key=lambda k: (s["counts"][k], k or ""))
        s["speed"] = speed
        return sample, device, s["no"], not moves

    return fold(d, dict, step, "sample_id bigint, device_id bigint, item_no bigint, is_visit boolean")


def pruned_sleep(samples: DataFrame, limits: Thresholds = LIMITS) -> DataFrame:
    """Leaves out samples of an item's trailing sleep: older than the time kept, and too soon after the last kept one.

    ``samples`` carry item_no and the item's end_t. The oldest and newest of the run stay. The run is found from the
    end by a window; the spacing is a fold.
    """
    from pyspark.sql import Window as W
    from pyspark.sql import functions as F

    back = W.partitionBy("device_id", "item_no").orderBy(F.desc("t"), F.desc("sample_id")).rowsBetween(W.unboundedPreceding, 0)
    asleep = F.col("recording_state").isin(*SLEEP_STATES)
    d = samples.withColumn("_run", F.min(asleep.cast("int")).over(back)).withColumn("_newest", F.row_number().over(W.partitionBy("device_id", "item_no").orderBy(F.desc("t"), F.desc("sample_id"))) == 1)
    d = d.select("device_id", "t", "sample_id", "item_no", "end_t", "_run", "_newest")

    def step(s: dict, r: tuple):
        device, t, sample, item, end, run, newest = r
        if not run:
            return sample, device, item
        if s.get("item") != item:
            s.update(item=item, kept=t)
        elif not newest and end - t >= limits.sleep_keep_s and t - s["kept"] < limits.sleep_apart_s:
            return None
        else:
            s["kept"] = t
        return sample, device, item

    return fold(d, dict, step, "sample_id bigint, device_id bigint, item_no bigint")
