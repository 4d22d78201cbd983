"""Registered queries that run the streaming forms over stored tracks until all are read."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanewise.operators import tracks as tk
from lanewise.operators.storage import saved
from lanewise.plans.derived import BUCKET, HEIGHT, MISSING_SECONDS, SOURCES, VEHICLES, WIDTH, Scene
from lanewise.plans.track_queries import CTE
from lanewise.streaming import rules as st
from lanewise.streaming import stateful as sf

SCENE = {
    "history": 30, "gap": 5, "movement": 3.0, "needed": 8, "wrong_net": 20.0, "missing": MISSING_SECONDS, "dwell": 2.0,
    "wrong_classes": ("car", "motorcycle", "bus", "truck"), "allowed": (0, 1, 7),
    "lines": {s: {f"{s}_line": (960.0, 200.0, 960.0, 1000.0)} for s in SOURCES}, "zones": {s: {f"{s}_zone": [(400.0, 300.0), (1500.0, 300.0), (1500.0, 900.0), (400.0, 900.0)]} for s in SOURCES},
    "diagonal": float((WIDTH**2 + HEIGHT**2) ** 0.5), "still_classes": VEHICLES, "still_net": 0.003, "still_seconds": 1.0,
}


def _stream(s: Scene, rows: DataFrame, delay: str = "5 seconds", after: DataFrame | None = None) -> DataFrame:
    """A stored table as a stream, in files by time; ``after``: rows that come in a file behind all others."""
    stored = saved(rows.repartitionByRange(8, "timestamp_seconds"), "stream")
    files = sorted(stored.inputFiles())
    folder = files[0].rsplit("/", 1)[0]
    if after is not None:
        after.coalesce(1).write.mode("append").parquet(folder)
        files += sorted(set(stored.sparkSession.read.parquet(folder).inputFiles()) - set(files))
    # A stream reads files in the order of their times.
    hadoop = s.spark._jvm.org.apache.hadoop.fs
    store = hadoop.Path(folder).getFileSystem(s.spark._jsc.hadoopConfiguration())
    for i, f in enumerate(files):
        store.setTimes(hadoop.Path(f), 1_577_836_800_000 + 1000 * i, -1)
    return st.stream_observations(s.spark, folder, stored.schema, delay=delay)


def _run(stream: DataFrame, mode: str, name: str) -> DataFrame:
    """All rows that a stream writes until its input is read; the last batch in complete mode."""
    spark = stream.sparkSession
    base = f"{spark.conf.get('spark.checkpoint.dir').rstrip('/')}/{name}-{uuid.uuid4().hex}"
    schema, last = stream.schema, []

    def write(batch: DataFrame, batch_id: int) -> None:
        last.append(batch_id)
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={batch_id}")

    stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    where = f"{base}/out/batch={last[-1]}" if mode == "complete" else f"{base}/out"
    return spark.read.schema(schema).parquet(where).select(*schema.names)


def _track_rules(s: Scene) -> DataFrame:
    # A last row for each track, far ahead, moves the watermark past all others.
    rows = s.tracks.select("video_id", "source_id", "track_id", "frame_index", "timestamp_seconds", "class_name", "center_x", "center_y")
    end = rows.select("video_id", "source_id", "track_id").distinct().selectExpr("*", "1000000L as frame_index", "100000D as timestamp_seconds", "'end' as class_name", "0D as center_x", "0D as center_y")
    later = end.withColumn("timestamp_seconds", F.lit(200000.0)).limit(1)
    with sf.rocks_state(s.spark):
        return _run(sf.track_rules(_stream(s, rows.unionByName(end).unionByName(later)), SCENE), "append", "track-rules").where("frame_index < 1000000")


def _traffic(s: Scene) -> DataFrame:
    return _run(st.traffic_over_time(_stream(s, s.crossings), f"{BUCKET} second"), "complete", "traffic")


def _dwell(s: Scene) -> DataFrame:
    inside = tk.zone_observations(s.tracks, s.zones).where("inside").select("video_id", "zone_id", "track_id", "timestamp_seconds")
    return _run(st.dwell_sessions(_stream(s, inside)).drop("s"), "complete", "dwell")


def _dedup(s: Scene) -> DataFrame:
    rows = s.crossings.select("video_id", "line_id", "track_id", "timestamp_seconds")
    return _run(st.event_dedup(_stream(s, rows.unionByName(rows), "3600 seconds"), ["video_id", "line_id", "track_id"]).drop("event_ts"), "append", "dedup")


def _enrich(s: Scene) -> DataFrame:
    rows = s.crossings.select("video_id", "track_id", "timestamp_seconds", F.lit("LINE_CROSSING").alias("event_type"))
    return _run(st.enrich(_stream(s, rows), s.policy).drop("event_ts"), "append", "enrich")


def _proximity(s: Scene) -> DataFrame:
    columns = ["video_id", "zone_id", "source_id", "frame_index", "timestamp_seconds", "track_id", "class_name", "x1", "y1", "x2", "y2"]
    rows = tk.zone_observations(s.tracks, s.zones).where("inside").select(*columns)
    # A person and a vehicle far ahead, in no zone, move the watermark of both sides past all others.
    ahead = f"explode(array(named_struct('t', 100000D, 'c', 'person'), named_struct('t', 200000D, 'c', 'person'), named_struct('t', 100000D, 'c', '{VEHICLES[0]}'), named_struct('t', 200000D, 'c', '{VEHICLES[0]}')))"
    end = rows.select("video_id", "source_id").distinct().limit(1).selectExpr("*", f"{ahead} as e")
    end = end.selectExpr("video_id", "'none' as zone_id", "source_id", "1000000L as frame_index", "e.t as timestamp_seconds", "-1L as track_id", "e.c as class_name", *[f"0D as {c}" for c in columns[7:]])
    return _run(st.proximity(_stream(s, rows.unionByName(end)), s.proximity_rules, WIDTH, HEIGHT), "append", "proximity")


def _occupancy(s: Scene) -> DataFrame:
    inside = tk.zone_observations(s.tracks, s.zones).where("inside").select("video_id", "zone_id", "track_id", "timestamp_seconds", "inside")
    # Rows far ahead, in no zone, move the watermark past all windows.
    end = inside.limit(1).selectExpr("video_id", "'none' as zone_id", "-1L as track_id", "explode(array(100000D, 200000D)) as timestamp_seconds", "true as inside")
    return _run(st.zone_occupancy(_stream(s, inside.unionByName(end))), "append", "occupancy").where("zone_id <> 'none'")


def _quality(s: Scene) -> DataFrame:
    """Tracks in files by time whose every seventh row comes twice, and whose every eleventh comes behind all others."""
    rows = s.tracks.select("video_id", "track_id", "frame_index", "timestamp_seconds", "confidence")
    twice = rows.unionByName(rows.where("frame_index % 7 = 0"))
    stream = _stream(s, twice.where("frame_index % 11 <> 0"), after=twice.where("frame_index % 11 = 0"))
    with sf.rocks_state(s.spark):
        found = _run(sf.classified(stream, F.col("confidence") >= 0.5, ["video_id", "track_id"], ["frame_index"], 0.5), "append", "quality")
    return found.groupBy("video_id", "track_id", "quality").agg(F.count("*").alias("rows"))


#: Of rows that come in time order none is late; the others are held against the latest good one of their track.
QUALITY = """
select video_id, track_id, quality, count(*) as rows from (
  select video_id, track_id, case when confidence < 0.5 then 'BAD' when frame_index % 11 = 0 and timestamp_seconds < latest - 0.5 then 'LATE' when copy = 2 then 'DUPLICATE' else 'GOOD' end as quality
  from (select *, max(case when confidence >= 0.5 and frame_index % 11 <> 0 then timestamp_seconds end) over (partition by video_id, track_id) as latest from tracks) t, (values (1), (2)) c(copy)
  where copy = 1 or frame_index % 7 = 0)
group by video_id, track_id, quality
"""

QUERIES = {
    "stream_proximity": (_proximity, "select video_id, zone_id, frame_index, person_track_id, vehicle_track_id from proximity"),
    "stream_zone_occupancy": (_occupancy, "select video_id, zone_id, cast(floor(timestamp_seconds) as bigint) as interval_start_seconds, count(distinct track_id) as tracks from zone_obs where inside group by all"),
    "stream_quality": (_quality, QUALITY),
    "stream_track_rules": (_track_rules, "select video_id, track_id, 'LINE_CROSSING' as kind, line_id as place, frame_index from crossings union all select video_id, track_id, case transition when 'ENTER' then 'ZONE_ENTRY' else 'ZONE_EXIT' end, zone_id, frame_index from zone_obs where transition in ('ENTER', 'EXIT') union all select video_id, track_id, 'WRONG_WAY', zone_id, frame_index from wrong_way union all select video_id, track_id, 'LONG_DWELL', zone_id, frame_index from dwell union all select video_id, track_id, 'STATIONARY_VEHICLE', zone_id, frame_index from stationary"),
    "stream_traffic_over_time": (_traffic, "select video_id, source_id, interval_start_seconds, total_crossing_count from ot"),
    "stream_dwell_sessions": (_dwell, "select video_id, zone_id, track_id, count(*) as rows, min(timestamp_seconds) as first_seconds, max(timestamp_seconds) as last_seconds from (select *, sum(case when round(timestamp_seconds * 1000000) - round(b * 1000000) <= 1000000 then 0 else 1 end) over (partition by video_id, track_id order by frame_index) as e from (select *, lag(timestamp_seconds) over (partition by video_id, track_id order by frame_index) as b from zone_obs where inside)) group by video_id, zone_id, track_id, e"),
    "stream_event_dedup": (_dedup, "select video_id, line_id, track_id, timestamp_seconds from crossings"),
    "stream_enrich_events": (_enrich, "select video_id, track_id, timestamp_seconds, 'LINE_CROSSING' as event_type, 'INFO' as severity, 'CONFIRMED' as status from crossings"),
}


def queries():
    return {n: (lambda f: lambda spark, sf_dir: f(Scene(spark, sf_dir)))(f) for n, (f, _) in QUERIES.items()}


def oracle_sql():
    return {n: CTE + sql for n, (_, sql) in QUERIES.items() if sql}
