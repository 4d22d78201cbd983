"""Registered queries over tracks, events and reports, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lanewise.functions import geometry as g
from lanewise.operators import events as ev
from lanewise.operators import reports as rp
from lanewise.operators import tracks as tk
from lanewise.plans.derived import BUCKET, FPS, HEIGHT, POLICY, WIDTH, Scene

DIAGONAL = (WIDTH**2 + HEIGHT**2) ** 0.5

#: Common table expressions in the order in which they build on one another.
CTE = f"""
with g as (
  select *, row_number() over (partition by user_id order by ts, event_id) - 1 as rn,
    coalesce(sum(case when event_id % 13 = 0 then event_id % 4 else 0 end) over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding), 0) as gp from events),
p as (
  select concat('v', cast(user_id % 8 as varchar)) as video_id, ['highway', 'downtown', 'urban', 'aerial'][user_id % 4 + 1] as source_id,
    user_id as track_id, cast(rn + gp as bigint) as frame_index, event_id, user_id, ['person', 'bicycle', 'car', 'motorcycle', 'bus', 'truck'][user_id % 6 + 1] as class_name,
    (user_id * 137) % 1920 + ((user_id // 6) % 7 - 3) * 6 * rn + event_id % 5 - 2 as ux, (user_id * 89) % 1080 + ((user_id // 6) % 5 - 2) * 5 * rn + event_id % 3 - 1 as uy from g),
q as (select *, ((ux % 3840) + 3840) % 3840 as mx, ((uy % 2160) + 2160) % 2160 as my from p),
r as (
  select video_id, source_id, frame_index, cast(frame_index as double) / {FPS} as timestamp_seconds, track_id, class_name, cast(15 + event_id % 85 as double) / 100 as confidence,
    cast(case when mx < 1920 then mx else 3840 - mx end as double) as center_x, cast(case when my < 1080 then my else 2160 - my end as double) as center_y,
    cast(40 + 20 * (user_id % 4) as double) as w, cast(40 + 20 * (user_id % 3) as double) as h from q),
tracks as (select * exclude (w, h), center_x - w / 2 as x1, center_y - h / 2 as y1, center_x + w / 2 as x2, center_y + h / 2 as y2 from r),
videos as (select video_id, source_id, max(frame_index) + 1 as frame_count from tracks group by all),
t1 as (
  select *, coalesce(lag(center_x) over w, center_x) as prev_center_x, coalesce(lag(center_y) over w, center_y) as prev_center_y, frame_index - coalesce(lag(frame_index) over w, frame_index) as frame_gap,
    cast(least(row_number() over w, 30) as integer) as history_length, center_x - first_value(center_x) over h as net_x, center_y - first_value(center_y) over h as net_y
  from tracks window w as (partition by video_id, track_id order by frame_index), h as (partition by video_id, track_id order by frame_index rows between 29 preceding and current row)),
t2 as (select *, center_x - prev_center_x as delta_x, center_y - prev_center_y as delta_y, sqrt(net_x * net_x + net_y * net_y) as net_displacement from t1),
traj as (select *, sqrt(delta_x * delta_x + delta_y * delta_y) as step_displacement,
  case when net_displacement < 5 then 'STATIONARY' else ['RIGHT', 'UP_RIGHT', 'UP', 'UP_LEFT', 'LEFT', 'DOWN_LEFT', 'DOWN', 'DOWN_RIGHT'][(cast(round_even(degrees(atan2(-net_y, net_x)) / 45, 0) as integer) % 8 + 8) % 8 + 1] end as direction from t2),
l1 as (select *, 800 * (960 - prev_center_x) as s0, 800 * (960 - center_x) as s1 from traj where history_length >= 2 and frame_gap between 1 and 5 and step_displacement >= 3),
l2 as (select *, case when s0 > 1e-9 and s1 < -1e-9 then 'A_TO_B' when s0 < -1e-9 and s1 > 1e-9 then 'B_TO_A' end as crossing_direction,
  delta_x * (200 - prev_center_y) - delta_y * (960 - prev_center_x) as u0, delta_x * (1000 - prev_center_y) - delta_y * (960 - prev_center_x) as u1 from l1),
l3 as (select *, row_number() over (partition by video_id, track_id order by frame_index) as n from l2 where crossing_direction is not null and u0 * u1 <= 1e-9),
crossings as (select video_id, source_id, source_id || '_line' as line_id, frame_index, timestamp_seconds, track_id, class_name, crossing_direction, center_x, center_y from l3 where n = 1),
z1 as (select *, source_id || '_zone' as zone_id, center_x between 400 and 1500 and center_y between 300 and 900 as inside from traj),
z2 as (select *, lag(inside) over (partition by video_id, track_id order by frame_index) as was from z1),
zone_obs as (select *, case when inside then case when was is null or was then 'INSIDE' else 'ENTER' end else case when was then 'EXIT' else 'OUTSIDE' end end as transition from z2),
occ as (select video_id, source_id, zone_id, frame_index, cast(sum(case when inside then 1 else 0 end) as bigint) as occupancy from zone_obs group by all),
zs as (
  select v.video_id, v.source_id, v.source_id || '_zone' as zone_id,
    coalesce((select max(occupancy) from occ o where o.video_id = v.video_id), 0) as peak_observed_occupancy,
    coalesce((select max(occupancy) from occ o where o.video_id = v.video_id and o.frame_index = v.frame_count - 1), 0) as current_observed_occupancy,
    (select count(distinct track_id) from zone_obs z where z.video_id = v.video_id and inside) as tracks_observed_inside,
    (select count(*) from zone_obs z where z.video_id = v.video_id and transition = 'ENTER') as zone_entry_count,
    (select count(*) from zone_obs z where z.video_id = v.video_id and transition = 'EXIT') as zone_exit_count from videos v),
w1 as (select *, coalesce(inside and frame_gap = 1 and class_name in ('car', 'motorcycle', 'bus', 'truck') and direction <> 'STATIONARY' and net_displacement >= 20 and direction not in ('RIGHT', 'UP_RIGHT', 'DOWN_RIGHT'), false) as violates from zone_obs),
w2 as (select *, sum(case when violates then 0 else 1 end) over (partition by video_id, track_id order by frame_index) as island from w1),
w3 as (select *, row_number() over (partition by video_id, track_id, island order by frame_index) as run from w2 where violates),
w4 as (select *, row_number() over (partition by video_id, track_id order by frame_index) as n from w3 where run = 8),
wrong_way as (select video_id, source_id, zone_id, frame_index, timestamp_seconds, track_id, class_name, direction as observed_direction, cast(run as integer) as consecutive_violation_count, net_displacement from w4 where n = 1),
d1 as (select *, lag(inside) over w as was_good, lag(timestamp_seconds) over w as last_ts from zone_obs window w as (partition by video_id, track_id order by frame_index)),
d2 as (select *, sum(case when was_good is null or not was_good or timestamp_seconds - last_ts > 1 then 1 else 0 end) over (partition by video_id, track_id order by frame_index) as episode from d1 where inside),
d3 as (select *, min(timestamp_seconds) over (partition by video_id, track_id, episode) as start_timestamp from d2),
d4 as (select *, row_number() over (partition by video_id, track_id, episode order by frame_index) as n from d3 where timestamp_seconds - start_timestamp >= 2),
dwell as (select video_id, source_id, zone_id, track_id, class_name, frame_index, start_timestamp as first_inside_timestamp, timestamp_seconds as trigger_timestamp, timestamp_seconds - start_timestamp as observed_dwell_seconds, 2.0::double as threshold_seconds from d4 where n = 1),
s1 as (select *, net_displacement / {DIAGONAL!r} as normalized_displacement from zone_obs),
s2 as (select *, coalesce(inside and class_name <> 'person' and frame_gap <= 1 and normalized_displacement <= 0.003, false) as good from s1),
s3 as (select *, lag(good) over w as was_good, lag(timestamp_seconds) over w as last_ts from s2 window w as (partition by video_id, track_id order by frame_index)),
s4 as (select *, sum(case when was_good is null or not was_good or timestamp_seconds - last_ts > 1 then 1 else 0 end) over (partition by video_id, track_id order by frame_index) as episode from s3 where good),
s5 as (select *, min(timestamp_seconds) over (partition by video_id, track_id, episode) as start_timestamp from s4),
s6 as (select *, row_number() over (partition by video_id, track_id, episode order by frame_index) as n from s5 where timestamp_seconds - start_timestamp >= 1),
stationary as (select video_id, source_id, zone_id, track_id, class_name, frame_index, start_timestamp as stationary_start_timestamp, timestamp_seconds as trigger_timestamp, timestamp_seconds - start_timestamp as stationary_duration_seconds, normalized_displacement, 0.003::double as movement_threshold from s6 where n = 1),
pv as (
  select a.video_id, a.zone_id, a.frame_index, a.source_id, a.timestamp_seconds, a.track_id as person_track_id, b.track_id as vehicle_track_id, b.class_name as vehicle_class,
    greatest(a.x1 - b.x2, b.x1 - a.x2, 0) as gx, greatest(a.y1 - b.y2, b.y1 - a.y2, 0) as gy,
    greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) as common, least((a.x2 - a.x1) * (a.y2 - a.y1), (b.x2 - b.x1) * (b.y2 - b.y1)) as smaller,
    (a.x1 + a.x2) / 2 between b.x1 and b.x2 and a.y2 between b.y1 and b.y2 as standing
  from zone_obs a join zone_obs b using (video_id, zone_id, frame_index) where a.inside and b.inside and a.class_name = 'person' and b.class_name <> 'person'),
pairs as (select * exclude (gx, gy, common, smaller, standing), vehicle_class in ('bicycle', 'motorcycle') and (case when smaller > 0 then common / smaller else 0 end >= 0.25 or standing) as rider, sqrt(gx * gx + gy * gy) / {DIAGONAL!r} as normalized_distance from pv),
n1 as (select *, rider or normalized_distance > 0.020 as ends, coalesce(frame_index - lag(frame_index) over w, 0) <> 1 as gap from pairs window w as (partition by video_id, zone_id, person_track_id, vehicle_track_id order by frame_index)),
n2 as (select *, sum(case when ends or gap then 1 else 0 end) over (partition by video_id, zone_id, person_track_id, vehicle_track_id order by frame_index) as segment, not ends and normalized_distance <= 0.012 as near from n1),
n3 as (select *, sum(case when near then 0 else 1 end) over (partition by video_id, zone_id, person_track_id, vehicle_track_id, segment order by frame_index) as pause from n2),
n4 as (select *, case when near then sum(case when near then 1 else 0 end) over (partition by video_id, zone_id, person_track_id, vehicle_track_id, segment, pause order by frame_index) else 0 end as run from n3),
n5 as (select *, row_number() over (partition by video_id, zone_id, person_track_id, vehicle_track_id, segment order by frame_index) as n from n4 where near and run = 3),
proximity as (select video_id, source_id, zone_id, frame_index, timestamp_seconds, person_track_id, vehicle_track_id, vehicle_class, normalized_distance, 0.012::double as trigger_threshold, cast(run as bigint) as consecutive_observations from n5 where n = 1),
e1 as (
  select video_id, source_id, 'LINE_CROSSING' as event_type, frame_index, timestamp_seconds, track_id, null::bigint as secondary_track_id, class_name, null::varchar as secondary_class_name, null::varchar as zone_id, line_id, 'spatial.line_crossing' as rule_source, crossing_direction as rule_value, 'finite_segment_intersection' as threshold, 0 as stage from crossings
  union all select video_id, source_id, case transition when 'ENTER' then 'ZONE_ENTRY' else 'ZONE_EXIT' end, frame_index, timestamp_seconds, track_id, null, class_name, null, zone_id, null, 'spatial.zone', transition, 'bbox_center_in_polygon', 1 from zone_obs where transition in ('ENTER', 'EXIT')
  union all select video_id, source_id, 'PEDESTRIAN_INTRUSION', frame_index, timestamp_seconds, track_id, null, class_name, null, zone_id, null, 'events.pedestrian_intrusion', 'person_zone_enter', 'restricted_for_person=true', 1 from zone_obs where transition = 'ENTER' and class_name = 'person' and source_id in ('highway', 'urban')
  union all select video_id, source_id, 'WRONG_WAY', frame_index, timestamp_seconds, track_id, null, class_name, null, zone_id, null, 'spatial.direction', observed_direction, 'allowed=DOWN_RIGHT|RIGHT|UP_RIGHT;consecutive=8', 2 from wrong_way
  union all select video_id, source_id, 'LONG_DWELL', frame_index, trigger_timestamp, track_id, null, class_name, null, zone_id, null, 'spatial.dwell', printf('observed_seconds=%.6f', observed_dwell_seconds), 'seconds>=2', 3 from dwell
  union all select video_id, source_id, 'STATIONARY_VEHICLE', frame_index, trigger_timestamp, track_id, null, class_name, null, zone_id, null, 'spatial.dwell', printf('normalized_displacement=%.9f', normalized_displacement), 'movement<=0.003;duration>=1s', 4 from stationary
  union all select video_id, source_id, 'PROXIMITY_WARNING', frame_index, timestamp_seconds, person_track_id, vehicle_track_id, 'person', vehicle_class, zone_id, null, 'spatial.proximity', printf('normalized_distance=%.9f', normalized_distance), 'trigger<=0.012', 5 from proximity),
pol(event_type, severity0, status) as (values {", ".join(str(x) for x in POLICY)}),
e2 as (select e1.*, case when event_type = 'PEDESTRIAN_INTRUSION' and source_id = 'highway' then 'CRITICAL' else severity0 end as severity, status from e1 join pol using (event_type)),
ev as (select * exclude (stage), printf('%s-EVT-%06d', video_id, row_number() over (partition by video_id order by frame_index, stage, track_id, zone_id, line_id, event_type = 'PEDESTRIAN_INTRUSION', secondary_track_id, rule_value)) as event_id from e2),
ct as (select video_id, source_id, count(*) as total_line_crossing_count, count(*) filter (class_name = 'person') as person_crossing_count, count(*) filter (class_name in ('car', 'motorcycle', 'bus', 'truck')) as motorized_vehicle_crossing_count, count(*) filter (class_name = 'bicycle') as bicycle_crossing_count from crossings group by all),
ot as (select video_id, source_id, cast(floor(timestamp_seconds / {BUCKET}) * {BUCKET} as bigint) as interval_start_seconds, cast(floor(timestamp_seconds / {BUCKET}) * {BUCKET} as bigint) + {BUCKET} as interval_end_seconds, count(*) as total_crossing_count,
  count(*) filter (class_name = 'person') as person_crossing_count, count(*) filter (class_name in ('car', 'motorcycle', 'bus', 'truck')) as motorized_vehicle_crossing_count, count(*) filter (class_name = 'bicycle') as bicycle_crossing_count from crossings group by all),
pk as (select video_id, source_id, interval_start_seconds as peak_interval_start_seconds, interval_end_seconds as peak_interval_end_seconds, total_crossing_count as peak_interval_count from ot qualify row_number() over (partition by video_id, source_id order by total_crossing_count desc, interval_start_seconds) = 1),
cd as (select video_id, source_id, class_name, count(*) as crossing_count, round(100.0 * count(*) / sum(count(*)) over (partition by video_id, source_id), 6) as percentage from crossings group by video_id, source_id, class_name),
dd as (select video_id, source_id, crossing_direction, count(*) as crossing_count, round(100.0 * count(*) / sum(count(*)) over (partition by video_id, source_id), 6) as percentage from crossings group by video_id, source_id, crossing_direction),
td(source_id, low, medium) as (values ('highway', 4, 9), ('downtown', 4, 9), ('urban', 4, 9), ('aerial', 4, 9))
"""

_BOX = "video_id, frame_index, track_id"


def _boxes(s: Scene):
    t = s.tracks
    b = g.box()
    area = g.bbox_area_normalized(b, F.lit(WIDTH), F.lit(HEIGHT))
    cx, cy = g.bbox_center(b)
    px, py = g.to_pixels(F.lit(0.5), F.lit(0.5), F.lit(WIDTH), F.lit(HEIGHT))
    return t.select("video_id", "frame_index", "track_id", cx.alias("cx"), cy.alias("cy"), F.round(area, 9).alias("area"), g.size_bin(area).alias("size_bin"), px.alias("mid_x"), py.alias("mid_y"))


def _neighbours(s: Scene):
    """Two boxes of one frame with neighbouring track ids of the same video."""
    t = s.tracks.select("video_id", "frame_index", "track_id", "x1", "y1", "x2", "y2")
    u = t.select("video_id", "frame_index", (F.col("track_id") - 8).alias("track_id"), *[F.col(c).alias(f"o_{c}") for c in ("x1", "y1", "x2", "y2")])
    p, q = g.box(), g.box("o_")
    return t.join(u, ["video_id", "frame_index", "track_id"]).select("video_id", "frame_index", "track_id", F.round(g.bbox_gap(p, q), 6).alias("gap"), F.round(g.overlap_smaller(p, q), 9).alias("overlap"), F.round(g.box_iou(p, q), 9).alias("iou"))


QUERIES = {
    # A, B
    "scan_observations": (lambda s: s.tracks, "select * from tracks"),
    "flatten_zone_summary": (lambda s: s.zone_summary, "select * from zs"),
    "duration_lookup": (lambda s: s.durations, f"select video_id, frame_count / {float(FPS)} as duration_seconds from videos"),
    "filter_detections": (lambda s: s.tracks.where(F.col("class_name").isin("person", "car", "bus") & (F.col("confidence") >= 0.5)), "select * from tracks where class_name in ('person', 'car', 'bus') and confidence >= 0.5"),
    "box_measures": (_boxes, f"select {_BOX}, (x1 + x2) / 2 as cx, (y1 + y2) / 2 as cy, round(a, 9) as area, case when a < 0.01 then 'SMALL_LT_0.01' when a < 0.09 then 'MEDIUM_0.01_TO_LT_0.09' else 'LARGE_GE_0.09' end as size_bin, 959.5::double as mid_x, 539.5::double as mid_y from (select *, (x2 - x1) * (y2 - y1) / {float(WIDTH * HEIGHT)} as a from tracks)"),
    "box_pairs": (_neighbours, f"select {_BOX}, round(sqrt(gx * gx + gy * gy), 6) as gap, round(c / least(a, b), 9) as overlap, round(c / (a + b - c), 9) as iou from (select p.video_id, p.frame_index, p.track_id, greatest(p.x1 - q.x2, q.x1 - p.x2, 0) as gx, greatest(p.y1 - q.y2, q.y1 - p.y2, 0) as gy, greatest(0, least(p.x2, q.x2) - greatest(p.x1, q.x1)) * greatest(0, least(p.y2, q.y2) - greatest(p.y1, q.y1)) as c, (p.x2 - p.x1) * (p.y2 - p.y1) as a, (q.x2 - q.x1) * (q.y2 - q.y1) as b from tracks p join tracks q on p.video_id = q.video_id and p.frame_index = q.frame_index and p.track_id = q.track_id - 8)"),
    # D
    "trajectory": (lambda s: s.trajectory.select("video_id", "track_id", "frame_index", "prev_center_x", "prev_center_y", "delta_x", "delta_y", "frame_gap", "history_length", "direction", F.round("step_displacement", 6).alias("step_displacement"), F.round("net_displacement", 6).alias("net_displacement")), "select video_id, track_id, frame_index, prev_center_x, prev_center_y, delta_x, delta_y, frame_gap, history_length, direction, round(step_displacement, 6) as step_displacement, round(net_displacement, 6) as net_displacement from traj"),
    "trail_points": (lambda s: tk.trail_points(s.tracks).select("video_id", "track_id", "frame_index", F.size("trail").alias("points"), F.to_json("trail").alias("trail")), "select video_id, track_id, frame_index, cast(len(l) as integer) as points, '[' || array_to_string(l, ',') || ']' as trail from (select *, list('{\"x\":' || cast(center_x as integer) || ',\"y\":' || cast(center_y as integer) || '}') over (partition by video_id, track_id order by frame_index rows between 29 preceding and current row) as l from tracks)"),
    "line_crossing": (lambda s: s.crossings, "select * from crossings"),
    "line_counts": (lambda s: s.crossings.groupBy("line_id", "class_name", "crossing_direction").agg(F.count("*").alias("crossings")), "select line_id, class_name, crossing_direction, count(*) as crossings from crossings group by all"),
    "zone_state": (lambda s: s.zone_obs.select("video_id", "zone_id", "track_id", "frame_index", "class_name", "transition"), "select video_id, zone_id, track_id, frame_index, class_name, transition from zone_obs"),
    "zone_transitions": (lambda s: s.zone_obs.where(F.col("transition").isin("ENTER", "EXIT")).groupBy("zone_id", "class_name", "transition").agg(F.count("*").alias("rows")), "select zone_id, class_name, transition, count(*) as rows from zone_obs where transition in ('ENTER', 'EXIT') group by all"),
    "zone_summary": (lambda s: s.zone_summary, "select * from zs"),
    "occupancy_series": (lambda s: tk.zone_occupancy(s.zone_obs), "select * from occ"),
    "wrong_way": (lambda s: s.wrong_way.drop("allowed_directions").withColumn("net_displacement", F.round("net_displacement", 6)), "select * replace (round(net_displacement, 6) as net_displacement) from wrong_way"),
    "long_dwell": (lambda s: s.long_dwell.withColumn("observed_dwell_seconds", F.round("observed_dwell_seconds", 6)), "select * replace (round(observed_dwell_seconds, 6) as observed_dwell_seconds) from dwell"),
    "stationary_vehicle": (lambda s: s.stationary.drop("duration_seconds").withColumns({c: F.round(c, 9) for c in ("stationary_duration_seconds", "normalized_displacement")}), "select * replace (round(stationary_duration_seconds, 9) as stationary_duration_seconds, round(normalized_displacement, 9) as normalized_displacement) from stationary"),
    "person_vehicle_pairs": (lambda s: s.pairs.select("video_id", "zone_id", "frame_index", "person_track_id", "vehicle_track_id", "rider", F.round("normalized_distance", 9).alias("normalized_distance")), "select video_id, zone_id, frame_index, person_track_id, vehicle_track_id, rider, round(normalized_distance, 9) as normalized_distance from pairs"),
    "proximity": (lambda s: s.proximity.withColumn("normalized_distance", F.round("normalized_distance", 9)), "select * replace (round(normalized_distance, 9) as normalized_distance) from proximity"),
    "rider_exclusions": (lambda s: tk.rider_exclusions(s.pairs), "select video_id, zone_id, count(distinct (person_track_id, vehicle_track_id)) filter (rider) as excluded_pairs, count(*) filter (not rider) as pair_comparisons from pairs group by all"),
    "active_pairs": (lambda s: tk.active_pairs(s.proximity_runs), "select video_id, zone_id, frame_index, person_track_id, vehicle_track_id from (select *, max(case when near and run = 3 then 1 else 0 end) over (partition by video_id, zone_id, person_track_id, vehicle_track_id, segment order by frame_index) as a from n4) where a = 1 and not ends"),
    "pedestrian_intrusion": (lambda s: s.normalized.where("event_type = 'PEDESTRIAN_INTRUSION'").select("video_id", "zone_id", "track_id", "frame_index"), "select video_id, zone_id, track_id, frame_index from e1 where event_type = 'PEDESTRIAN_INTRUSION'"),
    "frame_gap_candidates": (lambda s: tk.frame_gaps(s.tracks), "select video_id, count(*) filter (gap > 1) as frame_gap_candidates from (select video_id, frame_index - lag(frame_index) over (partition by video_id, track_id order by frame_index) as gap from (select distinct video_id, track_id, frame_index from tracks)) group by all"),
    "activity_heatmap": (lambda s: tk.activity_heatmap(s.tracks, 120, ("person", "car")), "select video_id, cast(floor((x1 + x2) / 2 / 120) as bigint) as cell_x, cast(floor(y2 / 120) as bigint) as cell_y, count(*) as observations from tracks where class_name in ('person', 'car') group by all"),
    "rule_counts": (lambda s: s.wrong_way.groupBy("zone_id", "class_name", "observed_direction").agg(F.count("*").alias("records")), "select zone_id, class_name, observed_direction, count(*) as records from wrong_way group by all"),
    # E
    "normalize_events": (lambda s: _text_id(s.normalized), "select * exclude (stage) replace (cast(secondary_track_id as varchar) as secondary_track_id) from e1"),
    "event_policy": (lambda s: ev.apply_policy(s.normalized, s.policy, s.restricted).groupBy("event_type", "zone_id", "severity", "status").agg(F.count("*").alias("events")), "select event_type, zone_id, severity, status, count(*) as events from e2 group by all"),
    "event_dedup": (lambda s: _text_id(ev.deduplicated(s.normalized.unionByName(s.normalized))), "select * exclude (stage) replace (cast(secondary_track_id as varchar) as secondary_track_id) from e1"),
    "event_ids": (lambda s: _text_id(s.events), "select * replace (cast(secondary_track_id as varchar) as secondary_track_id) from ev"),
    "event_counts": (lambda s: ev.event_counts(s.events), "select event_type, severity, status, count(*) as events from ev group by all"),
    "evidence_select": (lambda s: _evidence(s).select("event_id", "event_type", "evidence_path", "issue"), "select event_id, event_type, 'evidence/' || event_id || '.jpg' as evidence_path, null::varchar as issue from ev where event_type in ('WRONG_WAY', 'PROXIMITY_WARNING', 'PEDESTRIAN_INTRUSION') and (severity = 'CRITICAL' or status = 'REVIEW_REQUIRED')"),
    "evidence_tracks": (lambda s: ev.evidence_tracks(_evidence(s), s.tracks).select("event_id", F.col("primary_box.x1").alias("primary_x1"), F.col("secondary_box.x1").alias("secondary_x1")), "select event_id, a.x1 as primary_x1, b.x1 as secondary_x1 from ev left join tracks a on a.video_id = ev.video_id and a.frame_index = ev.frame_index and a.track_id = ev.track_id left join tracks b on b.video_id = ev.video_id and b.frame_index = ev.frame_index and b.track_id = ev.secondary_track_id where event_type in ('WRONG_WAY', 'PROXIMITY_WARNING', 'PEDESTRIAN_INTRUSION') and (severity = 'CRITICAL' or status = 'REVIEW_REQUIRED')"),
    "evidence_trace": (lambda s: ev.evidence_trace(s.event_table.where("track_id % 3 = 0").select("event_id", (F.col("frame_index") + F.when(F.col("track_id") % 2 == 0, 1).otherwise(0)).alias("expected_frame"), F.col("track_id").alias("expected_track_id")), s.event_table, ev.evidence_manifest(_evidence(s, s.event_table))), "select event_id, concat_ws(';', case when not c then 'manifest_exists' end, case when track_id % 2 = 0 then 'frame_matches_event' end, case when not c or track_id % 2 = 0 then 'frame_matches_manifest' end, case when not c then 'path_matches' end) as failures, case when c and track_id % 2 = 1 then 'PASS' else 'FAIL' end as trace_status from (select *, event_type in ('WRONG_WAY', 'PROXIMITY_WARNING', 'PEDESTRIAN_INTRUSION') and (severity = 'CRITICAL' or status = 'REVIEW_REQUIRED') as c from ev where track_id % 3 = 0)"),
    "evidence_counts": (lambda s: _evidence(s).groupBy("event_type").agg(F.count("*").alias("evidence")), "select event_type, count(*) as evidence from ev where event_type in ('WRONG_WAY', 'PROXIMITY_WARNING', 'PEDESTRIAN_INTRUSION') and (severity = 'CRITICAL' or status = 'REVIEW_REQUIRED') group by all"),
    "evidence_manifest": (lambda s: ev.evidence_manifest(_evidence(s)).drop("file_size_bytes"), "select event_id, video_id, frame_index, timestamp_seconds, event_type, severity, status, 'evidence/' || event_id || '.jpg' as evidence_path from ev where event_type in ('WRONG_WAY', 'PROXIMITY_WARNING', 'PEDESTRIAN_INTRUSION') and (severity = 'CRITICAL' or status = 'REVIEW_REQUIRED')"),
    "event_filter": (lambda s: ev.filter_view(s.events, "warning").select("event_id", "severity"), "select event_id, severity from ev where severity in ('WARNING', 'CRITICAL')"),
    "events_by_id": (lambda s: _text_id(s.events.where("video_id = 'v1'")), "select * replace (cast(secondary_track_id as varchar) as secondary_track_id) from ev where video_id = 'v1'"),
    "event_id_parity": (lambda s: ev.id_parity(s.event_table, s.event_table.where("event_type <> 'WRONG_WAY'")), "select 0::bigint as repeated_ids, count(*) filter (event_type = 'WRONG_WAY') as only_here, 0::bigint as only_there from ev"),
    # F
    "crossing_totals": (lambda s: rp.crossing_totals(s.crossings), "select * from ct"),
    "class_distribution": (lambda s: rp.distribution(s.crossings, "class_name"), "select * from cd"),
    "direction_distribution": (lambda s: rp.distribution(s.crossings, "crossing_direction"), "select * from dd"),
    "traffic_over_time": (lambda s: s.over_time, "select * from ot"),
    "peak_interval": (lambda s: rp.peak_interval(s.over_time), "select * from pk"),
    "traffic_summary": (lambda s: rp.traffic_summary(s.crossings, s.zone_summary, s.thresholds, BUCKET), "select ct.*, pk.* exclude (video_id, source_id), peak_observed_occupancy as zone_peak_occupancy, case when peak_observed_occupancy <= low then 'LOW' when peak_observed_occupancy <= medium then 'MEDIUM' else 'HIGH' end as density from ct join pk using (video_id, source_id) join zs using (video_id, source_id) join td using (source_id)"),
    "empty_traffic_summary": (lambda s: rp.with_empty_videos(rp.crossing_totals(s.crossings.where("class_name = 'truck'")), s.videos), "select video_id, source_id, coalesce(n, 0) as total_line_crossing_count, 0::bigint as person_crossing_count, coalesce(n, 0) as motorized_vehicle_crossing_count, 0::bigint as bicycle_crossing_count from videos left join (select video_id, count(*) as n from crossings where class_name = 'truck' group by all) using (video_id)"),
    "reconcile_totals": (lambda s: rp.reconcile_totals(rp.crossing_totals(s.crossings), rp.distribution(s.crossings, "class_name"), rp.distribution(s.crossings, "crossing_direction")), "select video_id, source_id, total_line_crossing_count, total_line_crossing_count as class_total, total_line_crossing_count as direction_total, 'PASS' as reconciliation_status from ct"),
    "reconcile_events": (lambda s: rp.reconcile_events(rp.crossing_totals(s.crossings), s.events), "select video_id, source_id, total_line_crossing_count, total_line_crossing_count as event_total, 'PASS' as reconciliation_status from ct"),
    "event_summary": (lambda s: rp.event_summary(s.events, s.durations), f"select video_id, source_id, metric, category, event_count, round(100.0 * event_count / sum(event_count) over (partition by video_id, source_id, metric), 6) as percentage, round(event_count / (frame_count / {float(FPS)}) * 60, 6) as events_per_minute from (select video_id, source_id, metric, category, count(*) as event_count from (select video_id, source_id, unnest(['EVENT_TYPE', 'SEVERITY', 'STATUS']) as metric, unnest([event_type, severity, status]) as category from ev) group by all) join videos using (video_id, source_id)"),
    "video_report": (lambda s: rp.video_report(rp.traffic_summary(s.crossings, s.zone_summary, s.thresholds, BUCKET), rp.distribution(s.crossings, "class_name"), rp.distribution(s.crossings, "crossing_direction")), "select video_id, source_id, '{\"total_line_crossing_count\":' || total_line_crossing_count || ',\"peak_interval_count\":' || peak_interval_count || ',\"classes\":[' || (select string_agg('{\"class_name\":\"' || class_name || '\",\"crossing_count\":' || crossing_count || '}', ',' order by class_name) from cd where cd.video_id = ct.video_id) || '],\"directions\":[' || (select string_agg('{\"crossing_direction\":\"' || crossing_direction || '\",\"crossing_count\":' || crossing_count || '}', ',' order by crossing_direction) from dd where dd.video_id = ct.video_id) || ']}' as document from ct join pk using (video_id, source_id)"),
    "overview_kpis": (lambda s: rp.overview_kpis(rp.crossing_totals(s.crossings), s.events, rp.distribution(s.crossings, "class_name"), rp.peak_interval(s.over_time)), "select ct.video_id, ct.source_id, total_line_crossing_count, coalesce((select count(*) from ev where ev.video_id = ct.video_id and severity <> 'INFO'), 0) as attention_events, (select class_name from cd where cd.video_id = ct.video_id and class_name <> 'person' order by crossing_count desc, class_name limit 1) as top_class, peak_interval_start_seconds from ct join pk using (video_id, source_id)"),
    "chart_rows": (lambda s: rp.distribution(s.crossings, "class_name").select(F.col("class_name").alias("label"), F.col("crossing_count").alias("value"), "video_id"), "select class_name as label, crossing_count as value, video_id from cd"),
    "track_summary": (lambda s: rp.track_summary(s.tracks), "select video_id, source_id, count(*) as observations, count(distinct track_id) as tracks from tracks group by all"),
    "trajectory_summary": (lambda s: s.trajectory.groupBy("direction", "frame_gap").agg(F.count("*").alias("observations")), "select direction, frame_gap, count(*) as observations from traj group by all"),
    "detection_summary": (lambda s: rp.class_tracks(s.tracks), "select class_name, count(*) as observations, count(distinct (video_id, track_id)) as tracks from tracks group by all"),
    "run_benchmark": (lambda s: rp.run_benchmark(s.tracks.groupBy("video_id", (F.col("track_id") % 3).alias("stage_no")).agg(F.count("*").alias("frames"), F.sum("confidence").alias("seconds"))).select("video_id", "stage_no", "frames", F.round("fps", 6).alias("fps"), F.round("ratio", 6).alias("ratio")), "select video_id, a.stage_no, frames, round(fps, 6) as fps, round(fps / p, 6) as ratio from (select video_id, track_id % 3 as stage_no, count(*) as frames, count(*) / sum(confidence) as fps from tracks group by all) a left join (select video_id, track_id % 3 + 1 as stage_no, count(*) / sum(confidence) as p from tracks group by all) b using (video_id, stage_no)"),
    "counter_with_resets": (lambda s: rp.counter_with_resets(s.tracks.select("track_id", "frame_index", F.expr("cast(frame_index % 7 as double)").alias("elapsed")), "track_id", "frame_index", "elapsed"), "select track_id, sum(case when v < b then b else 0 end) + arg_max(v, frame_index) as total from (select track_id, frame_index, cast(frame_index % 7 as double) as v, lag(cast(frame_index % 7 as double)) over (partition by track_id order by frame_index) as b from tracks) group by track_id"),
}


def _text_id(events):
    """The second track as text, as it is null in most rows."""
    return events.withColumn("secondary_track_id", F.col("secondary_track_id").cast("string"))


def _evidence(s: Scene, events=None):
    return ev.select_evidence(s.events if events is None else events, ("WRONG_WAY", "PROXIMITY_WARNING", "PEDESTRIAN_INTRUSION"), ("CRITICAL",), ("REVIEW_REQUIRED",))


def queries():
    return {n: (lambda f: lambda spark, sf_dir: f(Scene(spark, sf_dir)))(f) for n, (f, _) in QUERIES.items()}


def oracle_sql():
    return {n: CTE + sql for n, (_, sql) in QUERIES.items() if sql}
