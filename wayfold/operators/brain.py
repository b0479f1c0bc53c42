"""The present and past windows that decide between moving and stationary, as a fold over filtered fixes."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.operators.folds import Kalman, fold
from wayfold.schemas import EARTH_M, SLEEP_STATES

#: Fixes in the present window, how many it may be ahead of the past, the worst accuracy, the farthest bound, and fixes that are enough awake and frozen.
MIN_N, MAX_N, EXTRA, WORST_ACC, LEAST_BOUND, ENOUGH, CERTAIN = 10, 60, 4, 300.0, 65.0, 6, 10


def centre(fixes: list[tuple]) -> tuple[float, float, float]:
    """Weighted centre and accuracy of (t, lat, lng, acc, speed)."""
    if len(fixes) == 1:
        return fixes[0][1:4]
    worst = max(f[3] for f in fixes)
    x = y = z = w = acc = 0.0
    for _, lat, lng, a, _ in fixes:
        k, la, lo = 1 - a / (worst + 1), math.radians(lat), math.radians(lng)
        x, y, z = x + k * math.cos(la) * math.cos(lo), y + k * math.cos(la) * math.sin(lo), z + k * math.sin(la)
        w, acc = w + k, acc + k * a
    return math.degrees(math.atan2(z, math.hypot(x, y))), math.degrees(math.atan2(y, x)), acc / w


def metres(a: tuple, b: tuple) -> float:
    la, lb = math.radians(a[0]), math.radians(b[0])
    s = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * EARTH_M * math.asin(min(1.0, math.sqrt(s)))


def required(accuracy: float, speed: float) -> int:
    """How many fixes the present window holds: more where fixes are worse or slower."""
    if speed < 0:
        return MIN_N
    return max(MIN_N, min(MAX_N, int(accuracy + max(0.0, min(10.0, 10 - speed * 3.6)))))


class Brain:
    """Both windows of a device, at most 60 fixes each, and what they say after each fix.

    Frozen, the past stays as it was when sleep began, the present begins anew and has to grow to ``CERTAIN`` fixes before
    it is trusted; the filter takes the first fix after waking nearly as it is.
    """

    def __init__(self):
        self.place, self.now, self.past = Kalman(4.0), [], []
        self.frozen, self.since = False, None

    def freeze(self) -> None:
        self.frozen, self.since, self.now = True, None, []
        if self.place.t is not None:
            self.place.variance = WORST_ACC**2

    def take(self, t: float, lat: float, lng: float, acc: float, speed: float) -> tuple | None:
        """(n_present, n_past, latitude, longitude, accuracy, state, frozen, since) after a fix, None for one that isn't newer than the last."""
        if self.place.t is not None and t <= self.place.t:
            return None
        lat, lng = self.place.update(t, acc, (lat, lng))
        now, past = self.now, self.past
        now.append((t, lat, lng, acc, speed))
        known = [f[4] for f in now if f[4] is not None and f[4] >= 0]
        need = required(self.place.variance**0.5, sum(known) / len(known) if known else -1.0)
        while len(now) > need or (not self.frozen and len(now) > len(past) + EXTRA and len(now) > 1):
            oldest = now.pop(0)
            if not self.frozen:
                past.append(oldest)
        while not self.frozen and len(past) > 2 and len(past) > len(now):
            past.pop(0)
        here = centre(now)
        bound = max(here[2], 0.0) if self.frozen else min(max(here[2], 0.0), LEAST_BOUND)
        if here[2] > WORST_ACC:
            state = "uncertain"
        elif past and metres(here, centre(past)) <= bound:
            state = "stationary"
        else:
            state = "moving" if len(now) >= (CERTAIN if self.frozen else ENOUGH) else "uncertain"
        self.since = (t if self.since is None else self.since) if state == "stationary" else None
        frozen = self.frozen
        if len(now) >= (CERTAIN if frozen else ENOUGH):
            self.frozen = False
        return len(now), len(past), *here, state, frozen, self.since


BRAIN = "n_present bigint, n_past bigint, latitude double, longitude double, accuracy double, state string, frozen boolean, since bigint"


def states(fixes: DataFrame, sleeps: bool = False) -> DataFrame:
    """(sample_id, device_id, t, n_present, n_past, latitude, longitude, accuracy, state, frozen, since) of each usable fix.

    The place is the present window's weighted centre; ``since`` is when the standstill began. With ``sleeps`` a device's past freezes
    when its recording_state falls asleep. Windows hold at most 60 fixes each, so a device's state is bounded however long its history.
    """
    asleep = F.col("recording_state").isin(*[x for x in SLEEP_STATES if x != "wakeup"]) if sleeps else F.lit(False)
    usable = "latitude is not null and longitude is not null and h_acc >= 0 and not (latitude = 0 and longitude = 0)"
    d = fixes.filter(usable).select("device_id", "t", "sample_id", "latitude", "longitude", "h_acc", "speed", asleep.alias("asleep"))

    def start():
        return {"brain": Brain(), "asleep": False}

    def step(s: dict, r: tuple):
        device, t, sample, lat, lng, acc, speed, sleeps_now = r
        if sleeps_now and not s["asleep"]:
            s["brain"].freeze()
        s["asleep"] = bool(sleeps_now)
        made = s["brain"].take(t, lat, lng, acc, speed)
        return made and (sample, device, t, *made)

    return fold(d, start, step, f"sample_id bigint, device_id bigint, t bigint, {BRAIN}")
