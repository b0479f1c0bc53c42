"""Names, thresholds and orders that the timeline operators share."""

from __future__ import annotations

from dataclasses import dataclass

#: Activity types in the order that settles ties, those that every region has first.
BASE_TYPES = ("stationary", "walking", "running", "cycling", "car", "airplane")
EXTENDED_TYPES = (
    "train", "bus", "motorcycle", "boat", "tram", "tractor", "tuktuk", "songthaew", "skateboarding", "inlineSkating", "snowboarding", "skiing", "horseback",
    "scooter", "metro", "cableCar", "funicular", "chairlift", "skiLift", "taxi", "swimming", "golf", "wheelchair", "rowing", "kayaking", "bogus",
)
TYPES = BASE_TYPES + EXTENDED_TYPES
#: Types whose steps count, and names that aren't their type's own.
STEP_TYPES = ("walking", "running", "cycling", "golf", "rowing", "kayaking")
DISPLAY_NAMES = {"tuktuk": "tuk-tuk", "inlineSkating": "inline skating", "cableCar": "cable car", "skiLift": "ski lift"}
SLEEP_STATES = ("wakeup", "sleeping", "deepSleeping")
ACTIVE_STATES = ("recording", *SLEEP_STATES)
RECORDING_STATES = ("off", "standby", *ACTIVE_STATES)


@dataclass(frozen=True)
class Thresholds:
    """Limits that decide what a visit, a path and a gap are (fixed values by default). Seconds and metres."""

    visit_valid_s: float = 10.0
    visit_keeper_s: float = 120.0
    path_valid_s: float = 10.0
    path_valid_m: float = 10.0
    path_valid_samples: int = 2
    path_keeper_s: float = 60.0
    path_keeper_m: float = 20.0
    gap_valid_s: float = 60.0
    gap_keeper_s: float = 86400.0
    radius_min_m: float = 10.0
    radius_max_m: float = 150.0
    data_gap_s: float = 300.0
    mode_shift_kmh: float = 2.0
    samples_per_minute: float = 10.0
    sleep_keep_s: float = 1200.0
    sleep_apart_s: float = 300.0
    edge_gap_s: float = 600.0


LIMITS = Thresholds()
EARTH_M = 6_371_008.8
