"""Stateful stream operators, keyed so that each key's state is small and expires.

All take rows with ``ts_ms`` (epoch ms) and an event-time column ``ts``, drop rows later than the
watermark and handle the rows of a micro-batch in time order. Each has a batch twin that gives the
same answer on the same rows.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

LATENESS = "2 hours"
STATE = "payload string"


def stateful(df: DataFrame, keys: Sequence[str], out: str, step: Callable, ttl_ms: int,
             lateness: str = LATENESS, on_silence: Callable | None = None) -> DataFrame:
    """Run ``step(key, rows, memory) -> list of tuples`` per key with a memory that outlives batches.

    ``rows`` is one micro-batch of the key sorted by time. The memory is a JSON object and
    is dropped after ``ttl_ms`` of event time without rows, when ``on_silence`` may emit rows too.
    A memory with a time under ``wake`` is given to ``on_silence`` once the watermark passes it, and kept for ``ttl_ms`` more.
    """
    keys = list(keys)
    names = [f.name for f in T.StructType.fromDDL(out).fields]

    def run(key: tuple, batches: Iterable[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        memory = json.loads(held.get[0]) if held.exists else {}
        if held.hasTimedOut:
            found = on_silence(key, memory) if on_silence else []
            if memory.pop("wake", None) is None:
                held.remove()
            else:
                held.update((json.dumps(memory),))
                held.setTimeoutTimestamp(held.getCurrentWatermarkMs() + ttl_ms)
        else:
            rows = pd.concat(list(batches), ignore_index=True).sort_values("ts_ms", kind="stable")
            found = step(key, rows, memory)
            held.update((json.dumps(memory),))
            now = held.getCurrentWatermarkMs()
            held.setTimeoutTimestamp(max(memory["wake"], now + 1) if "wake" in memory else max(int(rows["ts_ms"].max()), now) + ttl_ms)
        if found:
            yield pd.DataFrame([(*key, *row) for row in found], columns=keys + names)

    kinds = {f.name: f.dataType for f in df.schema.fields}
    schema = T.StructType([T.StructField(k, kinds[k]) for k in keys] + T.StructType.fromDDL(out).fields)
    return df.withWatermark("ts", lateness).groupBy(*keys).applyInPandasWithState(
        run, schema, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def suppress(alerts: DataFrame, keys: Sequence[str], window_ms: int = 30_000, lateness: str = LATENESS) -> DataFrame:
    """Let an alert through unless one of its key was let through at most ``window_ms`` before."""

    def step(key, rows, memory):
        found = []
        for ts in rows["ts_ms"]:
            if "last" not in memory or ts - memory["last"] > window_ms:
                memory["last"] = int(ts)
                found.append((int(ts),))
        return found

    return stateful(alerts, keys, "ts_ms bigint", step, window_ms, lateness=lateness)


def rule_alerts(tracks: DataFrame, rules: dict, window_ms: int = 30_000, ttl_ms: int = 3_600_000, lateness: str = LATENESS) -> DataFrame:
    """Loitering, perimeter and wrong-direction candidates per track: ``event_type, zone_id, ts_ms``.

    Keyed by camera and track, so that a busy camera spreads; feed the result to ``suppress``,
    keyed by camera, type and zone, in a second query.
    """
    zones = {z: _ring(r) for z, r in rules.get("zones", {}).items() if len(r) >= 3}
    lines = {n: e for n, e in rules.get("lines", {}).items() if len(e) == 2}
    dwell = rules.get("dwell_threshold_ms", 30_000)
    steps, limit = rules.get("history_frames", 5), np.cos(np.radians(180.0 - rules.get("angle_threshold", 90.0)))
    ax, ay = np.array(rules.get("allowed_direction", (1.0, 0.0))) / np.hypot(*rules.get("allowed_direction", (1.0, 0.0)))
    wanted = set(rules.get("detect", ("loitering", "perimeter_breach", "wrong_direction")))

    def step(key, rows, memory):
        past, entered, found = memory.setdefault("past", []), memory.setdefault("entered", {}), []
        for ts, x, y in zip(rows["ts_ms"], rows["cx"], rows["cy"]):
            ts = int(ts)
            for zone, ring in zones.items():
                inside = _within(x, y, ring)
                if not inside:
                    entered.pop(zone, None)
                elif ts - entered.setdefault(zone, ts) >= dwell:
                    found.append(("loitering", zone, ts))
                if past and inside and not _within(*past[-1], ring):
                    found.append(("perimeter_breach", zone, ts))
            if past:
                found.extend(("perimeter_breach", n, ts) for n, (a, b) in lines.items() if _meets(past[-1], (x, y), a, b))
            past.append((float(x), float(y)))
            del past[:-steps]
            if len(past) == steps:
                mx, my = x - past[0][0], y - past[0][1]
                pace = np.hypot(mx, my)
                if pace >= 10.0 and (mx * ax + my * ay) / pace < limit:
                    found.append(("wrong_direction", rules.get("zone_id") or "", ts))
        return [f for f in found if f[0] in wanted]

    return stateful(tracks, ["camera_id", "track_id"], "event_type string, zone_id string, ts_ms bigint", step, ttl_ms, lateness=lateness)


def track_states(tracks: DataFrame, frame_gap_ms: int, min_hits: int = 2, max_lost_ms: int = 30_000, lateness: str = LATENESS) -> DataFrame:
    """Lifecycle of each track: its state at every sighting, and lost or deleted after silence.

    Restart continues from the checkpointed memory: hits, confidence sum, last sighting and state.
    """

    def step(key, rows, memory):
        found = []
        for ts, score in zip(rows["ts_ms"], rows["score"]):
            ts = int(ts)
            gap = None if "last" not in memory else ts - memory["last"]
            fresh = gap is None or gap > max_lost_ms or (memory["state"] == "tentative" and gap > frame_gap_ms)
            if fresh:
                memory.update(born=ts, hits=0, total=0.0, state="tentative")
            memory["hits"] += 1
            memory["total"] += float(score)
            memory["last"] = ts
            if memory["hits"] >= min_hits:
                memory["state"] = "confirmed"
            found.append((ts, memory["state"], memory["born"], memory["hits"], memory["total"] / memory["hits"]))
        return found

    def gone(key, memory):
        return [(memory["last"], "deleted", memory["born"], memory["hits"], memory["total"] / memory["hits"])]

    return stateful(tracks, ["camera_id", "track_id"],
                    "ts_ms bigint, state string, born_ms bigint, hits bigint, avg_confidence double", step, max_lost_ms, on_silence=gone, lateness=lateness)


def camera_silence(heartbeats: DataFrame, stale_ms: int = 30_000, lateness: str = LATENESS) -> DataFrame:
    """``online`` at a camera's first report and after an outage, ``offline`` once it has been silent."""

    def step(key, rows, memory):
        found = []
        for ts in rows["ts_ms"]:
            ts = int(ts)
            if "last" not in memory:
                found.append((ts, "online"))
            elif ts - memory["last"] > stale_ms:
                found += [(memory["last"] + stale_ms + 1, "offline"), (ts, "online")]
            memory["last"] = ts
        return found

    return stateful(heartbeats, ["camera_id"], "ts_ms bigint, status string", step, stale_ms + 1,
                    on_silence=lambda key, memory: [(memory["last"] + stale_ms + 1, "offline")], lateness=lateness)


def camera_verdicts(reports: DataFrame, target_fps: float, window_ms: int = 2_000, stale_ms: int = 30_000, errors: tuple[int, int] = (5, 20),
                    ratios: tuple[float, float] = (0.7, 0.3), error_window_ms: int | None = None, ttl_ms: int = 86_400_000,
                    lateness: str = LATENESS) -> DataFrame:
    """A row whenever a camera's status changes: healthy, degraded, critical or offline.

    ``reports``: camera_id, ts, ts_ms, is_error; a report is a frame or an error, and those of one moment count together. Errors are counted over
    ``error_window_ms`` (all so far if None) and come before the frame rate of the last frame's window; a rate from a single frame does not count.
    A timer of event time reports a camera offline once it gave no frame for ``stale_ms``. The memory holds two rings, no longer than their limits.
    """
    degraded, critical = errors
    enough = max(2, int(np.ceil(ratios[0] * target_fps * window_ms / 1000.0)) + 1)

    def noted(memory, ts, status):
        if memory.get("status") == status:
            return []
        memory["status"] = status
        return [(ts, status)]

    def step(key, rows, memory):
        frames, failed, found = memory.setdefault("frames", []), memory.setdefault("errors", []), []
        moments = rows.groupby("ts_ms")["is_error"].agg(["size", "sum"])
        for ts, n, wrong in zip(moments.index.tolist(), moments["size"].tolist(), moments["sum"].tolist()):
            last, wrong = memory.get("last"), int(wrong)
            if last is not None and ts - last > stale_ms:
                found += noted(memory, last + stale_ms + 1, "offline")
            failed[:] = [t for t in failed + [ts] * min(wrong, critical) if error_window_ms is None or t > ts - error_window_ms][-critical:]
            if n > wrong:
                memory["last"] = last = ts
                frames[:] = [t for t in frames + [ts] * min(n - wrong, enough) if t > ts - window_ms][-enough:]
                memory["fps"] = len(frames) / (window_ms / 1000.0) if len(frames) > 1 else 0.0
            ratio = memory.get("fps", 0.0) / target_fps
            if last is not None and ts - last > stale_ms:
                status = "offline"
            elif len(failed) >= critical or len(failed) < degraded and 0 < ratio < ratios[1]:
                status = "critical"
            elif len(failed) >= degraded or 0 < ratio < ratios[0]:
                status = "degraded"
            else:
                status = "healthy"
            found += noted(memory, ts, status)
        memory.pop("wake", None)
        if "last" in memory and memory["status"] != "offline":
            memory["wake"] = memory["last"] + stale_ms + 1
        return found

    def silent(key, memory):
        return noted(memory, memory["wake"], "offline") if "wake" in memory else []

    return stateful(reports, ["camera_id"], "ts_ms bigint, status string", step, ttl_ms, on_silence=silent, lateness=lateness)


def dwell_alerts(tracks: DataFrame, limits: dict[str, float], vehicles: Sequence[str], ttl_ms: int = 3_600_000, lateness: str = LATENESS) -> DataFrame:
    """A track's first moment beyond the limit of its category in seconds. ``tracks``: camera_id, track_id, class_label, ts, ts_ms."""

    def step(key, rows, memory):
        if memory.get("told"):
            return []
        for ts, label in zip(rows["ts_ms"], rows["class_label"]):
            dwell = (int(ts) - memory.setdefault("first", int(ts))) / 1000.0
            limit = limits["person" if label == "person" else "vehicle" if label in vehicles else "object"]
            if dwell > limit:
                memory["told"] = True
                return [(int(ts), dwell, limit)]
        return []

    return stateful(tracks, ["camera_id", "track_id"], "ts_ms bigint, dwell_s double, limit_s double", step, ttl_ms, lateness=lateness)


def distinct_frames(frames: DataFrame, distance: int = 4, window: int = 300, ttl_ms: int = 86_400_000, lateness: str = LATENESS) -> DataFrame:
    """Frames not within ``distance`` bits of the camera's last ``window`` kept ones. Rows need ``sketch``."""

    def step(key, rows, memory):
        kept, found = memory.setdefault("kept", []), []
        for ts, v in zip(rows["ts_ms"], rows["sketch"]):
            recent = np.asarray(kept[-window:], dtype=np.int64)
            if not len(recent) or not (np.bitwise_count((recent ^ np.int64(v)).view(np.uint64)) <= distance).any():
                kept.append(int(v))
                found.append((int(ts), int(v)))
        del kept[:-window]
        return found

    return stateful(frames, ["camera_id"], "ts_ms bigint, sketch bigint", step, ttl_ms, lateness=lateness)


def rate_limit(requests: DataFrame, allowed: int = 100, width_ms: int = 3_600_000, lateness: str = LATENESS) -> DataFrame:
    """Requests beyond ``allowed`` in the window opened by a user's first one."""

    def step(key, rows, memory):
        found = []
        for ts in rows["ts_ms"]:
            ts = int(ts)
            if "opened" not in memory or ts - memory["opened"] >= width_ms:
                memory.update(opened=ts, count=0)
            memory["count"] += 1
            if memory["count"] > allowed:
                found.append((ts, memory["opened"]))
        return found

    return stateful(requests, ["user_id"], "ts_ms bigint, opened_ms bigint", step, width_ms, lateness=lateness)


def lockouts(failures: DataFrame, burst: int = 5, within_ms: int = 600_000, pause_ms: int = 900_000, lateness: str = LATENESS) -> DataFrame:
    """Moments at which an account locks after ``burst`` failures inside ``within_ms``."""

    def step(key, rows, memory):
        found = []
        for ts in rows["ts_ms"]:
            ts = int(ts)
            if ts < memory.get("until", ts):
                continue
            if not memory.get("count") or ts - memory["opened"] >= within_ms:
                memory.update(opened=ts, count=0)
            memory["count"] += 1
            if memory["count"] >= burst:
                memory.update(until=ts + pause_ms, count=0)
                found.append((ts,))
        return found

    return stateful(failures, ["user_id"], "locked_ms bigint", step, within_ms + pause_ms, lateness=lateness)


def _ring(vertices):
    ring = [(float(x), float(y)) for x, y in vertices]
    return ring[:-1] if len(ring) > 1 and ring[0] == ring[-1] else ring


def _within(x, y, ring) -> bool:
    inside = False
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
        if (abs((x2 - x1) * (y - y1) - (y2 - y1) * (x - x1)) < 1e-9 and min(x1, x2) <= x <= max(x1, x2)
                and min(y1, y2) <= y <= max(y1, y2)):
            return False
        if (y1 > y) != (y2 > y) and x < (y - y1) * (x2 - x1) / (y2 - y1) + x1:
            inside = not inside
    return inside


def _meets(p, q, r, s) -> bool:
    def turn(a, b, c):
        return np.sign((b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0]))

    def on(a, b, c):
        return min(a[0], b[0]) <= c[0] <= max(a[0], b[0]) and min(a[1], b[1]) <= c[1] <= max(a[1], b[1])

    d1, d2, d3, d4 = turn(p, q, r), turn(p, q, s), turn(r, s, p), turn(r, s, q)
    if d1 * d2 < 0 and d3 * d4 < 0:
        return True
    return bool((d1 == 0 and on(p, q, r)) or (d2 == 0 and on(p, q, s)) or (d3 == 0 and on(r, s, p)) or (d4 == 0 and on(r, s, q)))
