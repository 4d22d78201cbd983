"""Stateful operators on typed state: the rules of a track, and the quality of rows.

State variables have schemas of their own, so a checkpoint can be read by the state data
source, and they live in RocksDB, on the executors' disks. Every variable is bounded: a
track's last points, one entry for a line or zone, and the rows that the watermark hasn't
passed or that lie within the allowed delay. Timers, or a time to live, clear idle keys.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocks_state(spark: SparkSession):
    """While queries with typed state are started: they take this session's state store with them."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)


def contains(points: list[tuple[float, float]], x: float, y: float) -> bool:
    """Whether a polygon holds a point; its boundary belongs to it."""
    inside = False
    for (ax, ay), (bx, by) in zip(points, [*points[1:], points[0]], strict=True):
        if abs((bx - ax) * (y - ay) - (by - ay) * (x - ax)) <= 1e-9 and min(ax, bx) <= x <= max(ax, bx) and min(ay, by) <= y <= max(ay, by):
            return True
        if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
            inside = not inside
    return inside


def crosses(before: tuple[float, float], now: tuple[float, float], line: tuple[float, float, float, float]) -> bool:
    """Whether a step changes the line's side within the line's ends."""
    (px, py), (x, y), (ax, ay, bx, by) = before, now, line
    side = lambda u, v: (bx - ax) * (v - ay) - (by - ay) * (u - ax)
    reach = lambda u, v: (x - px) * (v - py) - (y - py) * (u - px)
    s0, s1 = side(px, py), side(x, y)
    return ((s0 > 1e-9 and s1 < -1e-9) or (s0 < -1e-9 and s1 > 1e-9)) and reach(ax, ay) * reach(bx, by) <= 1e-9


RECORD = "video_id string, track_id long, kind string, place string, frame_index long"
_RECORD = Row("video_id", "track_id", "kind", "place", "frame_index")
_WAITING = "ms long, frame_index long, timestamp_seconds double, source_id string, class_name string, center_x double, center_y double"
_POINT = "frame_index long, center_x double, center_y double"
_ZONE = "inside boolean, streak int, confirmed boolean, stay_first double, stay_last double, stay_told boolean, still_first double, still_last double, still_told boolean"
_NEW_ZONE = (None, 0, False, None, None, False, None, None, False)


class TrackRules(StatefulProcessor):
    """One track's lines, zones, wrong way and stays, in the order of frames."""

    def __init__(self, scene: dict, idle_ms: int):
        self.scene, self.idle_ms = scene, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", _WAITING)
        self.history = handle.getListState("history", _POINT)
        self.crossed = handle.getMapState("crossed", "line string", "frame_index long")
        self.zones = handle.getMapState("zones", "zone string", _ZONE)
        self.due = handle.getValueState("due", "ms long")

    def _wake(self, ms: int) -> None:
        """One timer for a key: the earlier of the one that stands and ``ms``."""
        if self.due.exists():
            (now,) = self.due.get()
            if now <= ms:
                return
            self.handle.deleteTimer(now)
        self.handle.registerTimer(ms)
        self.due.update((ms,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        new = [(r.ms, r.frame_index, r.timestamp_seconds, r.source_id, r.class_name, r.center_x, r.center_y) for r in rows]
        self.waiting.appendList(new)
        self._wake(max(min(r[0] for r in new), timerValues.getCurrentWatermarkInMs() + 1))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.due.clear()
        mark = timerValues.getCurrentWatermarkInMs()
        rows = sorted(map(tuple, self.waiting.get())) if self.waiting.exists() else []
        if not rows:  # idle
            for state in (self.waiting, self.history, self.crossed, self.zones):
                state.clear()
            return
        ready, rest = [r for r in rows if r[0] <= mark], [r for r in rows if r[0] > mark]
        if rest:
            self.waiting.put(rest)
        else:
            self.waiting.clear()
        self._wake(rest[0][0] if rest else mark + self.idle_ms)
        if ready:
            history = [tuple(p) for p in self.history.get()] if self.history.exists() else []
            crossed = {k[0]: v[0] for k, v in self.crossed.iterator()} if self.crossed.exists() else {}
            zones = {k[0]: tuple(v) for k, v in self.zones.iterator()} if self.zones.exists() else {}
            known, were = set(crossed), dict(zones)
            for _, frame, seconds, source, kind, x, y in ready:
                for record, place in advance(history, crossed, zones, (frame, seconds, source, kind, x, y), self.scene):
                    yield _RECORD(*key, record, place, frame)
            self.history.put(history)
            for line in set(crossed) - known:
                self.crossed.updateValue((line,), (crossed[line],))
            for zone, value in zones.items():
                if were.get(zone) != value:
                    self.zones.updateValue((zone,), value)

    def close(self) -> None:
        pass


def advance(history: list, crossed: dict, zones: dict, row: tuple, scene: dict) -> list[tuple[str, str]]:
    """(kind, line or zone) of the records that an observation makes; the three states move on in place.

    An observation whose frame isn't after the last one changes nothing.
    """
    frame, seconds, source, kind, x, y = row
    if history and frame <= history[-1][0]:
        return []
    history.append((frame, x, y))
    del history[: -scene["history"]]
    last = history[-2] if len(history) > 1 else history[-1]
    gap, step = frame - last[0], math.sqrt((x - last[1]) * (x - last[1]) + (y - last[2]) * (y - last[2]))
    out: list[tuple[str, str]] = []
    if 1 <= gap <= scene["gap"] and step >= scene["movement"]:
        for line, ends in scene["lines"].get(source, {}).items():
            if line not in crossed and crosses(last[1:], (x, y), ends):
                crossed[line] = frame
                out.append(("LINE_CROSSING", line))
    nx, ny = x - history[0][1], y - history[0][2]
    net = math.sqrt(nx * nx + ny * ny)
    sector = round(math.degrees(math.atan2(-ny, nx)) / 45) % 8
    astray = gap == 1 and kind in scene["wrong_classes"] and net >= max(scene["wrong_net"], 5) and sector not in scene["allowed"]
    quiet = gap <= 1 and net / scene["diagonal"] <= scene["still_net"] and kind in scene["still_classes"]
    for zone, points in scene["zones"].get(source, {}).items():
        was, streak, confirmed, *spells = zones.get(zone, _NEW_ZONE)
        here = contains(points, x, y)
        if was is not None and here != was:
            out.append(("ZONE_ENTRY" if here else "ZONE_EXIT", zone))
        streak = streak + 1 if here and astray else 0
        if streak == scene["needed"] and not confirmed:
            confirmed = True
            out.append(("WRONG_WAY", zone))
        still, told = _spell(spells[3:], here and quiet, seconds, scene["missing"], scene["still_seconds"])
        if told:
            out.append(("STATIONARY_VEHICLE", zone))
        stay, told = _spell(spells[:3], here, seconds, scene["missing"], scene["dwell"])
        if told:
            out.append(("LONG_DWELL", zone))
        zones[zone] = (here, streak, confirmed, *stay, *still)
    return out


def _spell(spell: list, holds: bool, seconds: float, missing: float, needed: float) -> tuple[tuple, bool]:
    """A spell (first, last, told) after one more observation, and whether it has only now lasted long enough."""
    first, last, told = spell
    if not holds:
        return (None, None, False), False
    if first is None or seconds - last > missing:
        first, told = seconds, False
    now = not told and seconds - first >= needed
    return (first, seconds, told or now), now


def track_rules(stream: DataFrame, scene: dict, idle_ms: int = 60_000) -> DataFrame:
    """Records of all per-track rules, as rows of RECORD. Start the query inside :func:`rocks_state`.

    Rows wait in state until the watermark has passed them, so mixed rows are handled in
    frame order; rows behind the watermark are dropped, and counted, by Spark. The state of a track that
    has been idle for ``idle_ms`` of event time is removed.
    """
    rows = stream.withColumn("ms", F.unix_millis("event_ts"))
    return rows.groupBy("video_id", "track_id").transformWithState(TrackRules(scene, idle_ms), RECORD, "Append", "EventTime")


class Quality(StatefulProcessor):
    """Classifies the rows of one clock: what was accepted within the allowed delay, and the latest time of it."""

    def __init__(self, identity: list[str], identity_schema: str, time_col: str, delay: float, idle_ms: int):
        self.identity, self.identity_schema, self.time_col, self.delay, self.idle_ms = identity, identity_schema, time_col, delay, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.latest = handle.getValueState("latest", "seconds double, due long")
        self.accepted = handle.getListState("accepted", f"seconds double, {self.identity_schema}")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        latest, due = self.latest.get() if self.latest.exists() else (None, None)
        bound = None if latest is None else latest - self.delay
        kept = [tuple(r) for r in self.accepted.get()] if self.accepted.exists() else []
        seen, fresh, named = {r[1:] for r in kept}, [], None
        last = timerValues.getCurrentWatermarkInMs()
        for row in sorted(rows, key=lambda r: [(v is not None, v) for v in (r[self.time_col], *r)]):
            *values, good, ms = row
            seconds, name = row[self.time_col], tuple(row[c] for c in self.identity)
            if not good or seconds is None:
                quality = "BAD"
            elif bound is not None and seconds < bound:
                quality = "LATE"
            elif name in seen:
                quality = "DUPLICATE"
            else:
                quality = "GOOD"
                seen.add(name)
                fresh.append((seconds, *name))
                last = max(last, ms)
            named = named or Row(*row.__fields__[:-2], "quality")
            yield named(*values, quality)
        if fresh:
            # Rows before the new bound are late whatever they are: nothing older is kept.
            latest = max([x[0] for x in fresh] + [latest] * (latest is not None))
            if due is not None:
                self.handle.deleteTimer(due)
            self.handle.registerTimer(last + self.idle_ms)
            self.latest.update((latest, last + self.idle_ms))
            self.accepted.put([x for x in kept + fresh if x[0] >= latest - self.delay])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.latest.clear()
        self.accepted.clear()
        return iter(())

    def close(self) -> None:
        pass


def classified(stream: DataFrame, is_good: Column, clock: list[str], identity: list[str], delay_seconds: float, time_col: str = "timestamp_seconds", idle_ms: int = 86_400_000) -> DataFrame:
    """``stream``, which has a watermark on event_ts, without that column and with ``quality``: GOOD, BAD, LATE or DUPLICATE. Start the query inside :func:`rocks_state`.

    BAD: ``is_good`` doesn't hold, or the time is null. LATE: more than ``delay_seconds`` before
    the latest row that earlier batches accepted for the same ``clock`` columns (a track's or a camera's own
    clock). DUPLICATE: a row of the same ``identity`` columns was accepted; bad rows hide nothing. Of several rows of one identity in
    a batch the first by time, then by all columns, is accepted. No row is dropped: the operator doesn't see the event time, so
    Spark doesn't hold rows against the watermark.

    State is one entry for each row accepted within the delay, and one time for each clock; a clock that the
    watermark has left ``idle_ms`` behind is forgotten. A batch reads no earlier rows.
    """
    fields = {f.name: f for f in stream.schema.fields if f.name != "event_ts"}
    schema = T.StructType([*fields.values(), T.StructField("quality", T.StringType())])
    held = ", ".join(f"{c} {fields[c].dataType.simpleString()}" for c in identity)
    ms = F.coalesce(F.unix_millis("event_ts"), F.lit(0))
    rows = stream.select(*fields, F.coalesce(is_good, F.lit(False)).alias("_good"), ms.alias("_ms"))
    return rows.groupBy(*clock).transformWithState(Quality(identity, held, time_col, delay_seconds, idle_ms), schema, "Append", "EventTime")
