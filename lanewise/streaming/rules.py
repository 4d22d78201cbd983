"""Streaming forms: event time, watermarks and state with expiry."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lanewise.operators.tracks import person_vehicle_pairs, scene_dim

BASE = "2020-01-01 00:00:00"


def stream_observations(spark: SparkSession, path: str, schema, files_per_trigger: int = 4, delay: str = "5 seconds") -> DataFrame:
    """Track observations as a stream with event time ``event_ts`` = base + timestamp_seconds to the nearest microsecond, and a watermark."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    micros = F.round(F.col("timestamp_seconds") * 1_000_000).cast("long")
    return rows.withColumn("event_ts", F.timestamp_micros(F.unix_micros(F.lit(BASE).cast("timestamp")) + micros)).withWatermark("event_ts", delay)


def traffic_over_time(crossings: DataFrame, length: str = "1 second", slide: str | None = None) -> DataFrame:
    """Crossing counts by tumbling, or sliding, windows."""
    w = F.window("event_ts", length, slide) if slide else F.window("event_ts", length)
    return crossings.groupBy(w.alias("w"), "video_id", "source_id").agg(F.count("*").alias("total_crossing_count")).select("video_id", "source_id", (F.unix_micros("w.start") / 1e6 - F.unix_micros(F.lit(BASE).cast("timestamp")) / 1e6).cast("long").alias("interval_start_seconds"), "total_crossing_count")


def dwell_sessions(inside: DataFrame, missing: str = "1 second") -> DataFrame:
    """Stays as gap sessions of rows inside a zone; a row exactly ``missing`` after the last one, in microseconds, stays in its session."""
    s = F.session_window("event_ts", missing)
    return inside.groupBy(s.alias("s"), "video_id", "zone_id", "track_id").agg(F.count("*").alias("rows"), F.min("timestamp_seconds").alias("first_seconds"), F.max("timestamp_seconds").alias("last_seconds"))


def zone_occupancy(zone_obs: DataFrame, length: str = "1 second") -> DataFrame:
    """Exact numbers of distinct tracks inside each zone by tumbling window.

    Two stateful operators: the first row of each track, zone and window goes on, then windows
    count rows. The watermark clears the state of both.
    """
    first = zone_obs.where("inside").select("video_id", "zone_id", "track_id", F.window("event_ts", length).alias("w")).dropDuplicates(["video_id", "zone_id", "track_id", "w"])
    counts = first.groupBy("w", "video_id", "zone_id").agg(F.count("*").alias("tracks"))
    return counts.select("video_id", "zone_id", (F.unix_micros("w.start") / 1e6 - F.unix_micros(F.lit(BASE).cast("timestamp")) / 1e6).cast("long").alias("interval_start_seconds"), "tracks")


def event_dedup(events: DataFrame, key: list[str]) -> DataFrame:
    """The first event of each key within the watermark's delay."""
    return events.dropDuplicatesWithinWatermark(key)


def enrich(events: DataFrame, policy: DataFrame) -> DataFrame:
    """Severity and status from a static table."""
    return events.join(scene_dim(policy), "event_type", "left")


PAIR = "video_id string, zone_id string, frame_index long, person_track_id long, vehicle_track_id long"
BY_PAIR = ["person_track_id", "vehicle_track_id", "needed"]
#: State of a group of pairs: those that have been seen, with what their rows have left, and rows that wait for the watermark.
LIVE = {**dict.fromkeys(BY_PAIR, "int64"), "last": "int64", "ms": "int64", "run": "int64", "told": "bool"}
WAITING = {**dict.fromkeys(BY_PAIR, "int64"), "frame_index": "int64", "ms": "int64", "near": "bool"}
PAIR_STATE = ", ".join(f"{name}_{c} array<{'boolean' if t == 'bool' else 'long'}>" for name, columns in (("live", LIVE), ("waiting", WAITING)) for c, t in columns.items())
#: Groups that the pairs of a zone are dealt to, each with a state of its own.
PAIR_GROUPS = 256


def runs_of_pairs(rows: pd.DataFrame, live: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
    """Rows at which a pair triggers, and what each pair's rows leave.

    ``rows`` (WAITING): within the release distance, in the order of pairs and frames; ``live`` (LIVE): what rows before
    have left. A frame without such a row starts a segment, in which a pair triggers once; a row that isn't near ends a run.
    """
    if rows.empty:
        return rows, live
    before = rows[BY_PAIR].merge(live[[*BY_PAIR, "last", "run", "told"]], "left", BY_PAIR)
    frame, near = rows["frame_index"].to_numpy(), rows["near"].to_numpy()
    new = (rows[BY_PAIR] != rows[BY_PAIR].shift()).any(axis=1).to_numpy()
    goes_on = np.where(new, frame - before["last"].to_numpy(float), np.diff(frame, prepend=frame[0])) == 1
    carried, told = new & goes_on, np.zeros(len(rows), bool)
    told[carried] = before["told"].to_numpy()[carried].astype(bool)
    segment = np.cumsum(new | ~goes_on) - 1
    told = told[np.flatnonzero(new | ~goes_on)][segment]
    steps = near + np.where(carried & near, before["run"].fillna(0).to_numpy(), 0)
    runs = pd.Series(steps).groupby(np.cumsum(new | ~goes_on | ~near)).cumsum().to_numpy()
    hit = near & (runs == rows["needed"].to_numpy()) & ~told
    first = hit & (pd.Series(hit).groupby(segment).cumsum().to_numpy() == 1)
    ends = np.r_[new[1:], True]
    left = rows[BY_PAIR].assign(last=frame, ms=rows["ms"], run=np.where(near, runs, 0), told=told | pd.Series(hit).groupby(segment).cummax().to_numpy())[ends]
    return rows[first], pd.concat([left, live]).drop_duplicates(BY_PAIR).astype(LIVE)


def pair_runs(rows: pd.DataFrame, last: int | None, run: int, told: bool, needed: int) -> tuple[list[int], int, bool]:
    """:func:`runs_of_pairs` for one pair: frames at which it triggers, its last run of near rows, and whether its last segment has triggered."""
    one = dict.fromkeys(BY_PAIR, needed)
    hits, left = runs_of_pairs(rows.assign(**one, ms=0), pd.DataFrame([] if last is None else [{**one, "last": last, "ms": 0, "run": run, "told": told}], columns=list(LIVE)).astype(LIVE))
    return hits["frame_index"].tolist(), int(left["run"].iloc[0]), bool(left["told"].iloc[0])


def proximity(stream: DataFrame, rules: DataFrame, width: int, height: int, idle_ms: int = 60_000) -> DataFrame:
    """Proximity warnings. ``stream``: observations inside zones, with zone_id and boxes; ``rules`` as for person_vehicle_pairs.

    Persons meet vehicles in a stream-stream join on zone, frame, grid cell and event time, whose state
    the watermark clears. Riders, and pairs beyond the release distance, go no further: as
    an unseen frame does, such a row ends a pair's segment. A zone's pairs are dealt to PAIR_GROUPS groups by a hash, so a busy
    video is spread over tasks, and all pairs of a group take their steps at once; a pair that has been idle for ``idle_ms`` is
    dropped from its group's state. The watermark is that of the slower of persons and vehicles.
    """
    pairs = person_vehicle_pairs(stream.withColumn("inside", F.lit(True)), rules, width, height, at=("event_ts",), near=True)
    close = pairs.where(~F.col("rider"))
    group = F.pmod(F.xxhash64("person_track_id", "vehicle_track_id"), F.lit(PAIR_GROUPS)).alias("pair_group")
    rows = close.select("video_id", "zone_id", group, "person_track_id", "vehicle_track_id", "frame_index", (F.col("normalized_distance") <= F.col("trigger")).alias("near"), F.col("needed").cast("long"), F.unix_millis("event_ts").alias("ms"), "event_ts")

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else [[]] * (len(LIVE) + len(WAITING))
        live = pd.DataFrame({c: list(x) for c, x in zip(LIVE, held, strict=False)}).astype(LIVE)
        old = pd.DataFrame({c: list(x) for c, x in zip(WAITING, held[len(LIVE) :], strict=True)}).astype(WAITING)
        waiting = pd.concat([old, *(f[list(WAITING)] for f in frames)]).astype(WAITING)
        waiting = waiting.drop_duplicates([*BY_PAIR, "frame_index"]).sort_values([*BY_PAIR, "frame_index"], ignore_index=True)
        mark = state.getCurrentWatermarkMs()
        ready, waiting = waiting[waiting.ms <= mark].reset_index(drop=True), waiting[waiting.ms > mark]
        hits, live = runs_of_pairs(ready, live)
        live = live[live.ms > mark - idle_ms]
        if waiting.empty and live.empty:
            if state.exists:
                state.remove()
        else:
            state.update(tuple(x.tolist() for df in (live, waiting) for _, x in df.items()))
            state.setTimeoutTimestamp(max(mark + 1, int(waiting.ms.min()) if len(waiting) else mark + idle_ms))
        if len(hits):
            yield hits.assign(video_id=key[0], zone_id=key[1])[["video_id", "zone_id", "frame_index", "person_track_id", "vehicle_track_id"]]

    return rows.groupBy("video_id", "zone_id", "pair_group").applyInPandasWithState(step, PAIR, PAIR_STATE, "append", GroupStateTimeout.EventTimeTimeout)
