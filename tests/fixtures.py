"""Small sample sets with hand-computed expectations; times in seconds.

Fixed values: the metric names, times and values of these sets are the dialect's
published cases, which an engine for it must reproduce.
"""

from tidemark.model import LABELS, finish

SCHEMA = f"metric string, labels {LABELS}, ts long, seq long, value double, is_stale boolean"


def samples(spark, *series):
    """``series``: (metric, {label: value}, [(ts, value or None for stale)])."""
    rows, seq = [], 0
    for metric, labels, points in series:
        for ts, v in points:
            rows.append((metric, sorted(labels.items()), ts, seq, float("nan") if v is None else float(v), v is None))
            seq += 1
    return finish(spark.createDataFrame(rows, SCHEMA))


COUNTER = [
    ("http_requests_total", {"method": "GET", "status": "200"}, [(60 * m, 60 * m) for m in range(11)]),
    ("http_requests_total", {"method": "POST", "status": "200"}, [(60 * m, 30 * m) for m in range(11)]),
]
RANGES = [
    ("reset_metric", {"job": "api"}, [(0, 1), (60, 4), (120, 2), (180, 7)]),
    ("gauge_metric", {"job": "api"}, [(0, 0), (60, 120), (120, 240), (180, 360)]),
    ("sparse_counter_total", {"job": "api"}, [(t, t) for t in (390, 450, 510, 570)]),
    ("sparse_gauge", {"job": "api"}, [(t, t) for t in (390, 450, 510, 570)]),
    ("boundary_metric", {}, [(0, 1), (60, 2), (120, 3), (180, 4)]),
    ("future_metric", {}, [(600, 1), (660, 7)]),
    ("stale_metric", {"job": "api"}, [(0, 1), (60, 2), (120, None)]),
    ("revived_metric", {"job": "api"}, [(0, 1), (60, None), (120, 7)]),
]
MATCHING = [
    ("left_metric", {"instance": "a", "job": "api", "region": "west"}, [(60, 5)]),
    ("left_metric", {"instance": "b", "job": "api", "region": "west"}, [(60, 10)]),
    ("right_metric", {"job": "api", "team": "core"}, [(60, 2)]),
    ("compare_left", {"job": "api", "region": "west"}, [(60, 3)]),
    ("compare_right", {"instance": "a", "job": "api"}, [(60, 3)]),
    ("compare_right", {"instance": "b", "job": "api"}, [(60, 3)]),
    ("nan_metric", {"instance": "a"}, [(60, float("nan"))]),
    ("nan_metric", {"instance": "b"}, [(60, 1)]),
    ("nan_metric", {"instance": "c"}, [(60, 2)]),
    ("up", {"instance": "a", "job": "api"}, [(600, 1)]),
    ("target_info", {"instance": "a", "job": "api", "k8s_cluster_name": "old", "team": "core"}, [(540, 1)]),
    ("target_info", {"instance": "a", "job": "api", "k8s_cluster_name": "prod", "team": "platform"}, [(600, 1)]),
    ("build_info", {"build_version": "1.2.3", "instance": "a", "job": "api"}, [(600, 1)]),
]
BUCKETS = [
    ("request_duration_seconds_bucket", {"instance": i, "job": "api", "le": le}, [(60, n)]) for i in "ab" for le, n in (("0.1", 2), ("0.5", 5), ("1", 9), ("+Inf", 10))
] + [("incomplete_duration_seconds_bucket", {"job": "api", "le": le}, [(60, n)]) for le, n in (("0.5", 5), ("1", 9))]
