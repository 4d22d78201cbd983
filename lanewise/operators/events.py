"""One event table from all rules: normalised, given a policy, deduplicated and numbered."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanewise.operators.storage import saved
from lanewise.operators.tracks import PAIR_TASKS, scene_dim, shuffle_tasks

#: Event types in the order in which rules of one frame emit them.
TYPES = ("LINE_CROSSING", "ZONE_ENTRY", "ZONE_EXIT", "PEDESTRIAN_INTRUSION", "WRONG_WAY", "LONG_DWELL", "STATIONARY_VEHICLE", "PROXIMITY_WARNING")
STAGES = {"LINE_CROSSING": 0, "ZONE_ENTRY": 1, "ZONE_EXIT": 1, "PEDESTRIAN_INTRUSION": 1, "WRONG_WAY": 2, "LONG_DWELL": 3, "STATIONARY_VEHICLE": 4, "PROXIMITY_WARNING": 5}
KEY = ("event_type", "video_id", "frame_index", "track_id", "secondary_track_id", "zone_id", "line_id", "rule_source", "rule_value")
COLUMNS = ("video_id", "source_id", "event_type", "frame_index", "timestamp_seconds", "track_id", "secondary_track_id", "class_name", "secondary_class_name", "zone_id", "line_id", "rule_source", "rule_value", "threshold")


def _event(df: DataFrame, kind: str, source: str, value: Column, threshold: Column, **given: Column) -> DataFrame:
    text, number = F.lit(None).cast("string"), F.lit(None).cast("long")
    named = {
        "event_type": F.lit(kind), "rule_source": F.lit(source), "rule_value": value, "threshold": threshold, "secondary_track_id": number, "secondary_class_name": text,
        "zone_id": F.col("zone_id") if "zone_id" in df.columns else text, "line_id": F.col("line_id") if "line_id" in df.columns else text, **given,
    }
    return df.select(*[named.get(c, F.col(c) if c in df.columns else text).alias(c) for c in COLUMNS])


def normalize_events(crossings: DataFrame, zone_obs: DataFrame, restricted: DataFrame, wrong: DataFrame, dwell: DataFrame, stationary: DataFrame, near: DataFrame, labels: DataFrame) -> DataFrame:
    """All rule tables as events. ``restricted``: zone_id where persons may not enter; ``labels``: event_type, zone_id, label of thresholds."""
    moved = zone_obs.where(F.col("transition").isin("ENTER", "EXIT"))
    intruders = moved.where("transition = 'ENTER' and class_name = 'person'").join(scene_dim(restricted.select("zone_id").distinct()), "zone_id", "left_semi")
    allowed = F.concat(F.lit("allowed="), F.array_join("allowed_directions", "|"), F.lit(";consecutive="), F.col("consecutive_violation_count"))
    label = lambda df, kind: df.join(scene_dim(labels.where(F.col("event_type") == kind).select("zone_id", "label")), "zone_id", "left")
    parts = [
        _event(crossings, "LINE_CROSSING", "spatial.line_crossing", F.col("crossing_direction"), F.lit("finite_segment_intersection")),
        _event(moved.where("transition = 'ENTER'"), "ZONE_ENTRY", "spatial.zone", F.col("transition"), F.lit("bbox_center_in_polygon")),
        _event(moved.where("transition = 'EXIT'"), "ZONE_EXIT", "spatial.zone", F.col("transition"), F.lit("bbox_center_in_polygon")),
        _event(intruders, "PEDESTRIAN_INTRUSION", "events.pedestrian_intrusion", F.lit("person_zone_enter"), F.lit("restricted_for_person=true")),
        _event(wrong, "WRONG_WAY", "spatial.direction", F.col("observed_direction"), allowed),
        _event(label(dwell, "LONG_DWELL"), "LONG_DWELL", "spatial.dwell", F.format_string("observed_seconds=%.6f", "observed_dwell_seconds"), F.col("label"), timestamp_seconds=F.col("trigger_timestamp")),
        _event(label(stationary, "STATIONARY_VEHICLE"), "STATIONARY_VEHICLE", "spatial.dwell", F.format_string("normalized_displacement=%.9f", "normalized_displacement"), F.col("label"), timestamp_seconds=F.col("trigger_timestamp")),
        _event(
            label(near, "PROXIMITY_WARNING"), "PROXIMITY_WARNING", "spatial.proximity", F.format_string("normalized_distance=%.9f", "normalized_distance"), F.col("label"),
            track_id=F.col("person_track_id"), secondary_track_id=F.col("vehicle_track_id"), class_name=F.lit("person"), secondary_class_name=F.col("vehicle_class"),
        ),
    ]
    return reduce(DataFrame.unionByName, parts)


def apply_policy(events: DataFrame, policy: DataFrame, restricted: DataFrame) -> DataFrame:
    """Severity and status by type; a restricted zone's own severity wins for intrusions. ``policy``: event_type, severity, status; ``restricted``: zone_id, zone_severity."""
    out = events.join(scene_dim(policy), "event_type", "left").join(scene_dim(restricted), "zone_id", "left")
    own = F.when(F.col("event_type") == "PEDESTRIAN_INTRUSION", F.col("zone_severity"))
    return out.withColumn("severity", F.coalesce(own, F.col("severity"))).drop("zone_severity")


def deduplicated(events: DataFrame) -> DataFrame:
    """One event for each key, the first by all other columns; null ids are equal. Keys are dealt to a fixed number of tasks: events are small in a shuffle and large in memory."""
    rest = [c for c in events.columns if c not in KEY]
    first = F.row_number().over(Window.partitionBy(*KEY).orderBy(*rest))
    return events.repartition(PAIR_TASKS * shuffle_tasks(events), *KEY).withColumn("_first", first).where("_first = 1").drop("_first")


def numbered(events: DataFrame) -> DataFrame:
    """event_id ``{video}-EVT-000001`` in the order in which the rules emit.

    Only the events of one track, frame and stage are put in order together, as warnings of a frame grow with the square of
    its tracks. The counts of the tracks and stages before in the frame, and of the frames before, are added: one small row
    for each. The events are written once to the shared folder, as they are read for both.
    """
    stage = F.create_map(*[x for k, v in STAGES.items() for x in (F.lit(k), F.lit(v))])
    # Structs are equal where their fields are, null or not: one key deals, orders and joins without a further shuffle.
    rows = saved(events, "unnumbered").withColumn("_own", F.struct("video_id", "frame_index", F.element_at(stage, F.col("event_type")).alias("stage"), "track_id"))
    order = ("zone_id", "line_id", F.col("event_type") == "PEDESTRIAN_INTRUSION", "secondary_track_id", "rule_value")
    tasks = shuffle_tasks(rows)
    up_to = lambda by, of: F.coalesce(F.sum("here").over(Window.partitionBy(*by).orderBy(of).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = rows.groupBy("_own").agg(F.count("*").alias("here")).withColumn("_frame", F.struct("_own.video_id", "_own.frame_index")).repartition(tasks, "_frame")
    frames = counts.groupBy("_frame").agg(F.sum("here").alias("here")).select("_frame", up_to(["_frame.video_id"], "_frame.frame_index").alias("earlier"))
    before = counts.withColumn("before", up_to(["_frame"], "_own")).join(frames, "_frame").select("_own", F.col("earlier").alias("_earlier"), F.col("before").alias("_before"))
    placed = rows.repartition(PAIR_TASKS * tasks, "_own").withColumn("_n", F.row_number().over(Window.partitionBy("video_id", "frame_index", "_own").orderBy(*order)))
    met = placed.join(before, "_own")
    return met.select(*events.columns, F.format_string("%s-EVT-%06d", "video_id", F.col("_earlier") + F.col("_before") + F.col("_n")).alias("event_id"))


def event_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("event_type", "severity", "status").agg(F.count("*").alias("events"))


def select_evidence(events: DataFrame, types, severities, statuses) -> DataFrame:
    """Events worth a picture, with its path; ids that aren't safe in a path are marked."""
    chosen = events.where(F.col("event_type").isin(*types) & (F.col("severity").isin(*severities) | F.col("status").isin(*statuses)))
    safe = F.col("event_id").rlike("^[A-Za-z0-9._-]+$")
    return chosen.withColumn("evidence_path", F.when(safe, F.concat(F.lit("evidence/"), "event_id", F.lit(".jpg")))).withColumn("issue", F.when(~safe, "UNSAFE_EVENT_ID"))


def evidence_tracks(evidence: DataFrame, tracks: DataFrame) -> DataFrame:
    """Boxes of an event's primary and secondary track in its frame."""
    b = ("x1", "y1", "x2", "y2")
    at = lambda side, key: tracks.select("video_id", "frame_index", F.col("track_id").alias(key), F.struct(*b).alias(f"{side}_box"))
    out = evidence.join(at("primary", "track_id"), ["video_id", "frame_index", "track_id"], "left")
    return out.join(at("secondary", "secondary_track_id"), ["video_id", "frame_index", "secondary_track_id"], "left")


def evidence_manifest(evidence: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """One row for each captured event; sizes from a listing (evidence_path, file_size_bytes) where there is one."""
    out = evidence.where("evidence_path is not null").select("event_id", "video_id", "frame_index", "timestamp_seconds", "event_type", "severity", "status", "evidence_path")
    return out.withColumn("file_size_bytes", F.lit(None).cast("long")) if files is None else out.join(files, "evidence_path", "left")


def evidence_trace(review: DataFrame, events: DataFrame, manifest: DataFrame) -> DataFrame:
    """Checks of reviewed events against events and manifest; failing checks joined by ``;``. ``review``: event_id, expected_frame, expected_track_id."""
    e = events.select("event_id", F.col("frame_index").alias("event_frame"), "track_id", "secondary_track_id").withColumn("known", F.lit(True))
    m = manifest.select("event_id", F.col("frame_index").alias("manifest_frame"), "evidence_path").withColumn("captured", F.lit(True))
    out = review.join(e, "event_id", "left").join(m, "event_id", "left")
    same = lambda a, b: F.coalesce(F.col(a) == F.col(b), F.lit(False))
    checks = {
        "event_exists": F.col("known").isNotNull(),
        "manifest_exists": F.col("captured").isNotNull(),
        "frame_matches_event": same("expected_frame", "event_frame"),
        "frame_matches_manifest": same("expected_frame", "manifest_frame"),
        "track_matches": same("expected_track_id", "track_id") | same("expected_track_id", "secondary_track_id"),
        "path_matches": F.coalesce(F.col("evidence_path") == F.concat(F.lit("evidence/"), "event_id", F.lit(".jpg")), F.lit(False)),
    }
    failing = F.concat_ws(";", *[F.when(~ok, name) for name, ok in checks.items()])
    return out.select("event_id", failing.alias("failures"), F.when(failing == "", "PASS").otherwise("FAIL").alias("trace_status"))


def filter_view(events: DataFrame, view: str) -> DataFrame:
    """all, warning (WARNING or CRITICAL), info, or review."""
    by = {"all": F.lit(True), "warning": F.col("severity").isin("WARNING", "CRITICAL"), "info": F.col("severity") == "INFO", "review": F.col("status") == "REVIEW_REQUIRED"}
    return events.where(by[view])


def id_parity(ours: DataFrame, earlier: DataFrame) -> DataFrame:
    """One row: repeated ids, and ids that only one of two runs has, each as often as it has more of them. Each run is read once."""
    one = lambda df, here, there: df.select("event_id", F.lit(here).alias("a"), F.lit(there).alias("b"))
    ids = one(ours, 1, 0).unionAll(one(earlier, 0, 1)).groupBy("event_id").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    more = lambda x, y: F.coalesce(F.sum(F.greatest(F.col(x) - F.col(y), F.lit(0))), F.lit(0))
    return ids.agg(F.count_if(F.col("a") > 1).alias("repeated_ids"), more("a", "b").alias("only_here"), more("b", "a").alias("only_there"))
