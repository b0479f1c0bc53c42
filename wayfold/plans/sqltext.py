"""Pieces of DuckDB SQL that the twins share."""

from wayfold.schemas import TYPES
from wayfold.sources.samples import SAMPLES

R = "6371008.8"


def hav(a: str, b: str, c: str, d: str) -> str:
    h = f"(sin((radians({c}) - radians({a})) / 2) ^ 2 + cos(radians({a})) * cos(radians({c})) * sin((radians({d}) - radians({b})) / 2) ^ 2)"
    return f"(2 * {R} * asin(CASE WHEN sqrt({h}) > 1 THEN 1.0 ELSE sqrt({h}) END))"


USABLE = "coalesce(h_acc >= 0 AND latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180 AND NOT (latitude = 0 AND longitude = 0), false)"
S = f"WITH samples AS ({SAMPLES})"
#: Live samples with item numbers.
N = (
    S
    + """, live AS (SELECT *, moving_state <> 'stationary' AS m, moving_state <> 'stationary' AND recording_state = 'off' AS g, coalesce(confirmed_type, classified_type) AS activity_type FROM samples WHERE NOT deleted),
flagged AS (SELECT *, CASE WHEN row_number() OVER o = 1 OR m IS DISTINCT FROM lag(m) OVER o OR g IS DISTINCT FROM lag(g) OVER o THEN 1 ELSE 0 END AS f FROM live WINDOW o AS (PARTITION BY device_id ORDER BY t, sample_id)),
numbered AS (SELECT *, (sum(f) OVER (PARTITION BY device_id ORDER BY t, sample_id ROWS UNBOUNDED PRECEDING))::BIGINT AS item_no FROM flagged)"""
)
I = (  # noqa: E741
    N
    + f""", usable AS (SELECT *, max(h_acc) OVER (PARTITION BY device_id, item_no) AS worst, count(*) OVER (PARTITION BY device_id, item_no) AS nu FROM numbered WHERE {USABLE}),
weighed AS (SELECT *, (1 - h_acc / (worst + 1)) * CASE WHEN activity_type = 'stationary' THEN 3.0 ELSE 1.0 END AS w FROM usable),
xyz AS (
  SELECT device_id, item_no, max(nu) AS n_usable, max(latitude) AS la, max(longitude) AS lo, sum(w * cos(radians(latitude)) * cos(radians(longitude))) / sum(w) AS x,
         sum(w * cos(radians(latitude)) * sin(radians(longitude))) / sum(w) AS y, sum(w * sin(radians(latitude))) / sum(w) AS z FROM weighed GROUP BY ALL),
centre AS (
  SELECT device_id, item_no, n_usable, CASE WHEN n_usable = 1 THEN la ELSE degrees(atan2(z, sqrt(x * x + y * y))) END AS latitude,
         CASE WHEN n_usable = 1 THEN lo ELSE degrees(atan2(y, x)) END AS longitude FROM xyz),
radius AS (
  SELECT u.device_id, u.item_no, CASE WHEN max(c.n_usable) = 1 THEN max(h_acc) ELSE avg({hav("u.latitude", "u.longitude", "c.latitude", "c.longitude")}) END AS radius_mean,
         CASE WHEN max(c.n_usable) = 1 THEN 0.0 ELSE stddev_pop({hav("u.latitude", "u.longitude", "c.latitude", "c.longitude")}) END AS radius_sd
  FROM usable u JOIN centre c ON u.device_id = c.device_id AND u.item_no = c.item_no GROUP BY ALL),
steps AS (SELECT device_id, item_no, {hav("lag(latitude) OVER k", "lag(longitude) OVER k", "latitude", "longitude")} AS d FROM usable WINDOW k AS (PARTITION BY device_id, item_no ORDER BY t, sample_id)),
dist AS (SELECT device_id, item_no, sum(coalesce(d, 0)) AS distance FROM steps GROUP BY ALL),
base AS (
  SELECT device_id, item_no, min(t) AS start_t, max(t) AS last_t, count(*) AS n_samples, NOT arg_min(m, (t, sample_id)) AS is_visit,
         arg_min(m, (t, sample_id)) AND bool_and(recording_state = 'off') AS is_gap FROM numbered GROUP BY ALL),
ended AS (SELECT *, CASE WHEN lead(start_t) OVER k > start_t THEN lead(start_t) OVER k ELSE last_t END AS end_t FROM base WINDOW k AS (PARTITION BY device_id ORDER BY item_no)),
joined AS (
  SELECT b.*, (end_t - start_t)::DOUBLE AS duration, coalesce(n_usable, 0) AS n_usable, latitude, longitude, coalesce(radius_mean, 0.0) AS radius_mean, coalesce(radius_sd, 0.0) AS radius_sd, coalesce(distance, 0.0) AS distance
  FROM ended b LEFT JOIN centre USING (device_id, item_no) LEFT JOIN radius USING (device_id, item_no) LEFT JOIN dist USING (device_id, item_no)),
valued AS (
  SELECT *, CASE WHEN is_visit THEN n_samples >= 1 AND n_usable > 0 AND duration >= 10 WHEN is_gap THEN duration >= 60
                 ELSE n_samples >= 2 AND duration >= 10 AND (n_usable = 0 OR distance >= 10) END AS valid FROM joined),
items AS (
  SELECT *, CASE WHEN is_visit THEN valid AND duration >= 120 WHEN is_gap THEN duration >= 86400 ELSE valid AND duration >= 60 AND distance >= 20 END AS keeper,
         CASE WHEN CASE WHEN is_visit THEN valid AND duration >= 120 WHEN is_gap THEN duration >= 86400 ELSE valid AND duration >= 60 AND distance >= 20 END THEN 2 WHEN valid THEN 1 ELSE 0 END AS keepness FROM valued)"""
)
RANK = "list_position([" + ", ".join(f"'{t}'" for t in TYPES) + "], activity_type)"
