"""Trajectories, line crossings, zones and the rules over them, as window queries.

The main table holds track observations: video_id, source_id, frame_index,
timestamp_seconds, track_id, class_name and box columns. All per-track windows partition
by (video_id, track_id) or by that and the zone, which the first hash partitioning
satisfies, so one exchange serves the trajectory, the zones and every rule. Scene tables
(lines, zones, rules) are configuration: a few rows for each source, broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanewise.functions import grid
from lanewise.functions.geometry import bbox_gap, box, crossing_side, direction8, distance, point_in_polygon, rider_overlap, segments_intersect

BY_TRACK = ("video_id", "track_id")
BY_ZONE = ("video_id", "track_id", "zone_id")


def _by(keys) -> Window:
    return Window.partitionBy(*keys).orderBy("frame_index")


def scene_dim(df: DataFrame, most: int = 100_000) -> DataFrame:
    """A scene table for broadcasting, after a check that it is as small as configuration is."""
    if df.isLocal() or df.limit(most + 1).count() <= most:
        return F.broadcast(df)
    return df


def shuffle_tasks(df: DataFrame) -> int:
    """The session's number of tasks after a shuffle: given to a repartition, it holds also where rows are few bytes each and Spark would join millions of them in one task."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def trajectory(tracks: DataFrame, history: int = 30, minimum_displacement: float = 5.0) -> DataFrame:
    """``tracks`` with previous centre, steps, net displacement over the last ``history`` observations, direction, history length and frame gap.

    A track's first row is its own predecessor and has gap 0.
    """
    w = _by(BY_TRACK)
    recent = w.rowsBetween(-(history - 1), 0)
    before = lambda c: F.coalesce(F.lag(c).over(w), F.col(c))
    out = tracks.withColumns({"prev_center_x": before("center_x"), "prev_center_y": before("center_y"), "frame_gap": F.col("frame_index") - before("frame_index"), "history_length": F.least(F.row_number().over(w), F.lit(history)), "origin_x": F.first("center_x").over(recent), "origin_y": F.first("center_y").over(recent)})
    out = out.withColumns({"delta_x": F.col("center_x") - F.col("prev_center_x"), "delta_y": F.col("center_y") - F.col("prev_center_y"), "net_x": F.col("center_x") - F.col("origin_x"), "net_y": F.col("center_y") - F.col("origin_y")})
    out = out.withColumns({"step_displacement": distance(F.col("delta_x"), F.col("delta_y")), "net_displacement": distance(F.col("net_x"), F.col("net_y")), "direction": direction8(F.col("net_x"), F.col("net_y"), minimum_displacement)})
    return out.drop("origin_x", "origin_y", "net_x", "net_y")


def trail_points(tracks: DataFrame, length: int = 30) -> DataFrame:
    """Each observation's recent trail as whole-pixel points, oldest first; the array is bounded by ``length``."""
    recent = _by(BY_TRACK).rowsBetween(-(length - 1), 0)
    return tracks.withColumn("trail", F.collect_list(F.struct(F.rint("center_x").cast("int").alias("x"), F.rint("center_y").cast("int").alias("y"))).over(recent))


def line_crossings(traj: DataFrame, lines: DataFrame, maximum_gap: int = 5, minimum_movement: float = 3.0) -> DataFrame:
    """The first crossing of each line by each track. ``lines``: source_id, line_id, ax, ay, bx, by in pixels."""
    moving = traj.where((F.col("history_length") >= 2) & F.col("frame_gap").between(1, maximum_gap) & (F.col("step_displacement") >= minimum_movement))
    met = moving.join(scene_dim(lines), "source_id")
    previous, current = (F.col("prev_center_x"), F.col("prev_center_y")), (F.col("center_x"), F.col("center_y"))
    start, end = (F.col("ax"), F.col("ay")), (F.col("bx"), F.col("by"))
    met = met.withColumn("crossing_direction", crossing_side(previous, current, start, end)).where(F.col("crossing_direction").isNotNull() & segments_intersect(previous, current, start, end))
    first = F.row_number().over(Window.partitionBy(*BY_TRACK, "line_id").orderBy("frame_index"))
    kept = met.withColumn("_n", first).where("_n = 1")
    return kept.select("video_id", "source_id", "line_id", "frame_index", "timestamp_seconds", "track_id", "class_name", "crossing_direction", "center_x", "center_y")


def zone_observations(tracks: DataFrame, zones: DataFrame) -> DataFrame:
    """Each observation x zone of its source with transition OUTSIDE, ENTER, INSIDE or EXIT; other columns stay.

    ``zones``: source_id, zone_id, points (array of x, y in pixels). A track's first row in
    a zone is INSIDE, not ENTER; rows that don't exist cause no EXIT.
    """
    seen = tracks.join(scene_dim(zones.select("source_id", "zone_id", "points")), "source_id")
    x = F.transform("points", lambda p: p["x"])
    y = F.transform("points", lambda p: p["y"])
    near = F.col("center_x").between(F.array_min(x), F.array_max(x)) & F.col("center_y").between(F.array_min(y), F.array_max(y))
    seen = seen.withColumn("inside", F.when(near, point_in_polygon(F.col("center_x"), F.col("center_y"), F.col("points"))).otherwise(False)).drop("points")
    was = F.lag("inside").over(_by(BY_ZONE))
    here = F.col("inside")
    transition = F.when(here, F.when(was.isNull() | was, "INSIDE").otherwise("ENTER")).otherwise(F.when(F.coalesce(was, F.lit(False)), "EXIT").otherwise("OUTSIDE"))
    return seen.withColumn("transition", transition)


def zone_occupancy(zone_obs: DataFrame) -> DataFrame:
    """Tracks inside, for each (video, zone, frame) with observations."""
    return zone_obs.groupBy("video_id", "source_id", "zone_id", "frame_index").agg(F.count_if("inside").alias("occupancy"))


def zone_summary(zone_obs: DataFrame, videos: DataFrame, zones: DataFrame) -> DataFrame:
    """Peak and current occupancy, distinct tracks inside, entries and exits; every zone of every video has a row.

    Current is the occupancy at the video's last frame, 0 if nothing was seen there.
    ``videos``: video_id, source_id, frame_count.
    """
    keys = ["video_id", "source_id", "zone_id"]
    all_zones = videos.select("video_id", "source_id", "frame_count").join(scene_dim(zones.select("source_id", "zone_id")), "source_id")
    frames = zone_occupancy(zone_obs).groupBy(*keys).agg(F.max("occupancy").alias("peak"), F.max_by("occupancy", "frame_index").alias("last"), F.max("frame_index").alias("last_frame"))
    counts = zone_obs.groupBy(*keys).agg(F.count_distinct(F.when(F.col("inside"), F.col("track_id"))).alias("tracks"), F.count_if(F.col("transition") == "ENTER").alias("entries"), F.count_if(F.col("transition") == "EXIT").alias("exits"))
    out = all_zones.join(frames, keys, "left").join(counts, keys, "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return out.select(
        *keys,
        zero(F.col("peak")).alias("peak_observed_occupancy"),
        zero(F.when(F.col("last_frame") == F.col("frame_count") - 1, F.col("last"))).alias("current_observed_occupancy"),
        zero(F.col("tracks")).alias("tracks_observed_inside"),
        zero(F.col("entries")).alias("zone_entry_count"),
        zero(F.col("exits")).alias("zone_exit_count"),
    )


def _with_runs(rows: DataFrame, good: str, by, starts: str | None = None) -> DataFrame:
    """``rows`` with their number ``n`` and the length ``run`` of the run of ``good`` rows that each ends (0 if it isn't good); ``starts`` marks rows at which a run begins anew.

    The length is a row's number less that of the last row before its run, over one window: a window
    for each run would sort the rows again, and a task would hold them once for each sort.
    """
    w = _by(by)
    before = F.when(~F.col(good), F.col("n"))
    if starts:
        before = before.when(F.col(starts), F.col("n") - 1)
    rows = rows.withColumn("n", F.row_number().over(w))
    last = F.coalesce(F.max(before).over(w), F.lit(0))
    return rows.withColumn("run", F.when(F.col(good), F.col("n") - last).otherwise(0))


def wrong_way(zone_traj: DataFrame, rules: DataFrame) -> DataFrame:
    """First confirmation for each (video, zone, track): ``needed`` violating rows one after another.

    ``zone_traj`` is zone_observations of a trajectory. ``rules``: zone_id, classes, allowed,
    needed, minimum_net. A row violates if it is inside, follows the frame before, its
    class applies, it isn't STATIONARY, moved far enough and in no allowed direction.
    """
    seen = zone_traj.join(scene_dim(rules), "zone_id")
    violates = F.col("inside") & (F.col("frame_gap") == 1) & F.array_contains("classes", F.col("class_name")) & (F.col("direction") != "STATIONARY") & (F.col("net_displacement") >= F.col("minimum_net")) & ~F.array_contains("allowed", F.col("direction"))
    seen = seen.withColumn("violates", F.coalesce(violates, F.lit(False)))
    seen = _with_runs(seen, "violates", BY_ZONE).where(F.col("violates") & (F.col("run") == F.col("needed")))
    seen = seen.withColumn("_n", F.row_number().over(_by(BY_ZONE))).where("_n = 1")
    return seen.select("video_id", "source_id", "zone_id", "frame_index", "timestamp_seconds", "track_id", "class_name", F.col("direction").alias("observed_direction"), F.array_sort("allowed").alias("allowed_directions"), F.col("run").alias("consecutive_violation_count"), "net_displacement")


def _episodes(rows: DataFrame, good: Column, seconds: Column, maximum_missing: float) -> DataFrame:
    """First row of each episode that has lasted ``seconds``: rows where ``good`` holds, unbroken by others or by long absence."""
    w = _by(BY_ZONE)
    rows = rows.withColumn("good", F.coalesce(good, F.lit(False))).withColumn("was_good", F.lag("good").over(w)).withColumn("last_ts", F.lag("timestamp_seconds").over(w)).where("good")
    broken = F.col("was_good").isNull() | ~F.col("was_good") | (F.col("timestamp_seconds") - F.col("last_ts") > maximum_missing)
    rows = rows.withColumn("broken", broken).withColumn("episode", F.sum(F.col("broken").cast("int")).over(w))
    # An episode starts at its broken row: the last one up to here, over the same window.
    rows = rows.withColumn("start_timestamp", F.last(F.when(F.col("broken"), F.col("timestamp_seconds")), ignorenulls=True).over(w)).withColumn("elapsed", F.col("timestamp_seconds") - F.col("start_timestamp")).where(F.col("elapsed") >= seconds)
    in_episode = _by((*BY_ZONE, "episode"))
    return rows.withColumn("_n", F.row_number().over(in_episode)).where("_n = 1").drop("_n", "good", "was_good", "last_ts", "broken")


def long_dwell(zone_obs: DataFrame, rules: DataFrame, maximum_missing: float = 1.0) -> DataFrame:
    """One record for each stay in a zone that reaches its threshold. ``rules``: zone_id, classes, threshold_seconds."""
    seen = zone_obs.join(scene_dim(rules), "zone_id")
    done = _episodes(seen, F.col("inside") & F.array_contains("classes", F.col("class_name")), F.col("threshold_seconds"), maximum_missing)
    return done.select("video_id", "source_id", "zone_id", "track_id", "class_name", "frame_index", F.col("start_timestamp").alias("first_inside_timestamp"), F.col("timestamp_seconds").alias("trigger_timestamp"), F.col("elapsed").alias("observed_dwell_seconds"), "threshold_seconds")


def stationary_vehicles(zone_traj: DataFrame, rules: DataFrame, width: int, height: int, maximum_missing: float = 1.0) -> DataFrame:
    """One record for each spell of little movement that lasts. ``rules``: zone_id, classes, movement_threshold, duration_seconds."""
    seen = zone_traj.join(scene_dim(rules), "zone_id").withColumn("normalized_displacement", F.col("net_displacement") / float((width**2 + height**2) ** 0.5))
    good = F.col("inside") & F.array_contains("classes", F.col("class_name")) & (F.col("frame_gap") <= 1) & (F.col("normalized_displacement") <= F.col("movement_threshold"))
    done = _episodes(seen, good, F.col("duration_seconds"), maximum_missing)
    return done.select("video_id", "source_id", "zone_id", "track_id", "class_name", "frame_index", F.col("start_timestamp").alias("stationary_start_timestamp"), F.col("timestamp_seconds").alias("trigger_timestamp"), F.col("elapsed").alias("stationary_duration_seconds"), "normalized_displacement", "movement_threshold", "duration_seconds")


#: Blocks to which a frame's vehicles are dealt where all pairs are formed; and how many times as many tasks as usual rows of pairs, the largest table here, are dealt to.
PAIR_BLOCKS, PAIR_TASKS = 8, 4


def _all_pairs(people: DataFrame, vehicles: DataFrame, keys: list[str], tasks: int | None) -> DataFrame:
    """All pairs with equal ``keys``. Vehicles of a frame are dealt to blocks, persons, which are fewer, go to each of them, so that a crowded frame is many tasks' work."""
    if tasks is None:
        return people.join(vehicles, keys)
    people = people.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(PAIR_BLOCKS - 1))))
    vehicles = vehicles.withColumn("_block", F.pmod(F.hash("vehicle_track_id"), F.lit(PAIR_BLOCKS)))
    by = [*keys, "_block"]
    people, vehicles = (df.repartition(PAIR_TASKS * tasks, *by) for df in (people, vehicles))
    return people.join(vehicles, by).drop("_block")


def person_vehicle_pairs(zone_obs: DataFrame, rules: DataFrame, width: int, height: int, at: tuple[str, ...] = (), near: bool = False) -> DataFrame:
    """Person x vehicle inside the same enabled zone and frame, with their distance and whether they are rider and own vehicle.

    ``rules``: zone_id, enabled, vehicle_classes, trigger, release, needed, rider_ratio. Both
    sides are cut down before the join; it is an equality join on (video, zone, frame), and
    on ``at``, a stream's event time, if given. With ``near``, only pairs within the release
    distance are formed, cell by cell of a grid of a sixteenth of the diagonal: all that
    warnings need, as a pair beyond it ends a segment just as an unseen frame does. Without it
    a frame's rows grow with the square of its tracks, and are dealt to many tasks.
    """
    diagonal = float((width**2 + height**2) ** 0.5)
    keys = ["video_id", "zone_id", "frame_index", *at]
    live = zone_obs.where("inside").join(scene_dim(rules.where("enabled")), "zone_id")
    b = ("x1", "y1", "x2", "y2")
    people = live.where("class_name = 'person'").select(*keys, "source_id", "timestamp_seconds", F.col("track_id").alias("person_track_id"), *[F.col(c).alias(f"p_{c}") for c in b], "trigger", "release", "needed", "rider_ratio")
    vehicles = live.where(F.array_contains("vehicle_classes", F.col("class_name"))).select(*keys, F.col("track_id").alias("vehicle_track_id"), F.col("class_name").alias("vehicle_class"), *[F.col(c).alias(f"v_{c}") for c in b])
    # A little more than the release distance, so that rounding loses no pair.
    tasks = None if zone_obs.isStreaming else shuffle_tasks(zone_obs)
    pairs = grid.meeting(people, vehicles, keys, diagonal / 16, "p_", "v_", F.col("release") * (diagonal * (1 + 1e-9)) + diagonal * 1e-9, tasks) if near else _all_pairs(people, vehicles, keys, tasks)
    person, vehicle = box("p_"), box("v_")
    pairs = pairs.withColumn("rider", rider_overlap(person, vehicle, F.col("vehicle_class"), F.col("rider_ratio")))
    pairs = pairs.withColumn("normalized_distance", bbox_gap(person, vehicle) / diagonal).drop(*[f"{s}_{c}" for s in "pv" for c in b])
    return pairs.where("normalized_distance <= release") if near else pairs


#: A pair of tracks in a zone.
BY_PAIR = ("video_id", "zone_id", "person_track_id", "vehicle_track_id")


def proximity_runs(pairs: DataFrame) -> DataFrame:
    """Pairs with their segment, and the length of the run of near rows that each row ends (0 if not near).

    A rider row, a distance beyond release, or an unseen frame ends a segment, in which a
    pair can trigger once; a row beyond trigger ends a run. Rows are dealt to a fixed number of
    tasks, as joined ones would read many times more rows than their few bytes in a shuffle let expect, and sorted once.
    """
    w = _by(BY_PAIR)
    pairs = pairs.repartition(PAIR_TASKS * shuffle_tasks(pairs), *BY_PAIR)
    ends = F.col("rider") | (F.col("normalized_distance") > F.col("release"))
    gap = F.coalesce(F.col("frame_index") - F.lag("frame_index").over(w), F.lit(0)) != 1
    rows = pairs.withColumns({"ends": ends, "starts": ends | gap})
    rows = rows.withColumn("segment", F.sum(F.col("starts").cast("int")).over(w))
    rows = rows.withColumn("near", ~F.col("ends") & (F.col("normalized_distance") <= F.col("trigger")))
    return _with_runs(rows, "near", BY_PAIR, "starts")


def proximity(runs: DataFrame) -> DataFrame:
    """The first row of each segment at which enough near rows have followed one another."""
    hit = runs.where(F.col("near") & (F.col("run") == F.col("needed")))
    hit = hit.withColumn("_n", F.row_number().over(_by((*BY_PAIR, "segment")))).where("_n = 1")
    return hit.select("video_id", "source_id", "zone_id", "frame_index", "timestamp_seconds", "person_track_id", "vehicle_track_id", "vehicle_class", "normalized_distance", F.col("trigger").alias("trigger_threshold"), F.col("run").alias("consecutive_observations"))


def rider_exclusions(pairs: DataFrame) -> DataFrame:
    """Distinct excluded pairs and compared rows for each (video, zone)."""
    pair = F.struct("person_track_id", "vehicle_track_id")
    return pairs.groupBy("video_id", "zone_id").agg(F.count_distinct(F.when(F.col("rider"), pair)).alias("excluded_pairs"), F.count_if(~F.col("rider")).alias("pair_comparisons"))


def active_pairs(runs: DataFrame) -> DataFrame:
    """Rows of pairs that have triggered and not been released."""
    w, n = _by(BY_PAIR), F.col("n")
    told = F.max(F.when(F.col("near") & (F.col("run") == F.col("needed")), n)).over(w) >= F.max(F.when(F.col("starts"), n)).over(w)
    return runs.withColumn("active", told).where(F.col("active") & ~F.col("ends")).select("video_id", "zone_id", "frame_index", "person_track_id", "vehicle_track_id")


def frame_gaps(tracks: DataFrame) -> DataFrame:
    """Gaps of more than one frame between a track's consecutive distinct frames, by video."""
    frames = tracks.select("video_id", "track_id", "frame_index").dropDuplicates()
    gap = F.col("frame_index") - F.lag("frame_index").over(_by(BY_TRACK))
    return frames.withColumn("gap", gap).groupBy("video_id").agg(F.count_if(F.col("gap") > 1).alias("frame_gap_candidates"))


def activity_heatmap(tracks: DataFrame, cell: int, classes: tuple[str, ...]) -> DataFrame:
    """Observations of some classes by grid cell of the box's bottom centre."""
    rows = tracks.where(F.col("class_name").isin(*classes))
    return rows.groupBy("video_id", F.floor((F.col("x1") + F.col("x2")) / 2 / cell).alias("cell_x"), F.floor(F.col("y2") / cell).alias("cell_y")).agg(F.count("*").alias("observations"))
