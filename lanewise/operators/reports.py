"""Traffic reports over crossings, zones and events. All are aggregates of small results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanewise.operators.tracks import scene_dim

VIDEO = ["video_id", "source_id"]
MOTORISED = ("car", "motorcycle", "bus", "truck")


def _groups() -> list[Column]:
    return [
        F.count_if(F.col("class_name") == "person").alias("person_crossing_count"),
        F.count_if(F.col("class_name").isin(*MOTORISED)).alias("motorized_vehicle_crossing_count"),
        F.count_if(F.col("class_name") == "bicycle").alias("bicycle_crossing_count"),
    ]


def crossing_totals(crossings: DataFrame) -> DataFrame:
    return crossings.groupBy(*VIDEO).agg(F.count("*").alias("total_line_crossing_count"), *_groups())


def distribution(rows: DataFrame, column: str, count: str = "crossing_count") -> DataFrame:
    """Count and percentage of each video's total for each value of a column."""
    out = rows.groupBy(*VIDEO, column).agg(F.count("*").alias(count))
    return out.withColumn("percentage", F.round(100.0 * F.col(count) / F.sum(count).over(Window.partitionBy(*VIDEO)), 6))


def traffic_over_time(crossings: DataFrame, bucket: int = 10) -> DataFrame:
    """Counts by tumbling bucket; empty buckets are absent."""
    start = (F.floor(F.col("timestamp_seconds") / bucket) * bucket).cast("long")
    out = crossings.groupBy(*VIDEO, start.alias("interval_start_seconds")).agg(F.count("*").alias("total_crossing_count"), *_groups())
    return out.withColumn("interval_end_seconds", F.col("interval_start_seconds") + bucket)


def peak_interval(over_time: DataFrame) -> DataFrame:
    """Each video's busiest bucket, the earliest on ties."""
    best = F.max_by(F.struct("interval_start_seconds", "interval_end_seconds", "total_crossing_count"), F.struct("total_crossing_count", -F.col("interval_start_seconds")))
    return over_time.groupBy(*VIDEO).agg(best.alias("p")).select(*VIDEO, F.col("p.interval_start_seconds").alias("peak_interval_start_seconds"), F.col("p.interval_end_seconds").alias("peak_interval_end_seconds"), F.col("p.total_crossing_count").alias("peak_interval_count"))


def density_class(peak: Column, low: Column, medium: Column) -> Column:
    return F.when(peak <= low, "LOW").when(peak <= medium, "MEDIUM").otherwise("HIGH")


def traffic_summary(crossings: DataFrame, zones: DataFrame, thresholds: DataFrame, bucket: int = 10, strict: bool = True) -> DataFrame:
    """Totals, peak interval, zone peak and density. ``thresholds``: source_id, low, medium; a missing threshold or zone row is an error when strict."""
    peaks = zones.groupBy(*VIDEO).agg(F.max("peak_observed_occupancy").alias("zone_peak_occupancy"))
    out = crossing_totals(crossings).join(peak_interval(traffic_over_time(crossings, bucket)), VIDEO).join(peaks, VIDEO, "left").join(scene_dim(thresholds), "source_id", "left")
    if strict:
        missing = F.when(F.col("low").isNull(), F.raise_error(F.concat(F.lit("missing density threshold for "), "source_id"))).when(F.col("zone_peak_occupancy").isNull(), F.raise_error(F.concat(F.lit("missing zone occupancy summary for "), "video_id")))
        out = out.withColumn("zone_peak_occupancy", F.coalesce(missing.cast("long"), F.col("zone_peak_occupancy")))
    return out.withColumn("density", density_class(F.col("zone_peak_occupancy"), F.col("low"), F.col("medium"))).drop("low", "medium")


def with_empty_videos(summary: DataFrame, videos: DataFrame) -> DataFrame:
    """The summary with a row of zeros for videos without crossings."""
    counts = [c for c in summary.columns if c.endswith("_count")]
    out = videos.select(*VIDEO).join(summary.select(*VIDEO, *counts), VIDEO, "left")
    return out.select(*VIDEO, *[F.coalesce(c, F.lit(0)).alias(c) for c in counts])


def reconcile_totals(totals: DataFrame, classes: DataFrame, directions: DataFrame, strict: bool = False) -> DataFrame:
    """PASS or FAIL for each video: classes and directions must sum to the total."""
    summed = lambda df, name: df.groupBy(*VIDEO).agg(F.sum("crossing_count").alias(name))
    out = totals.select(*VIDEO, "total_line_crossing_count").join(summed(classes, "class_total"), VIDEO, "full").join(summed(directions, "direction_total"), VIDEO, "full")
    return _reconciled(out, F.col("total_line_crossing_count").eqNullSafe(F.col("class_total")) & F.col("total_line_crossing_count").eqNullSafe(F.col("direction_total")), strict)


def reconcile_events(totals: DataFrame, events: DataFrame, strict: bool = False) -> DataFrame:
    """PASS or FAIL for each video: as many LINE_CROSSING events as crossings."""
    seen = events.where("event_type = 'LINE_CROSSING'").groupBy(*VIDEO).agg(F.count("*").alias("event_total"))
    out = totals.select(*VIDEO, "total_line_crossing_count").join(seen, VIDEO, "full")
    return _reconciled(out, F.col("total_line_crossing_count").eqNullSafe(F.col("event_total")), strict)


def _reconciled(df: DataFrame, ok: Column, strict: bool) -> DataFrame:
    bad = F.raise_error(F.concat(F.lit("totals do not reconcile for "), "video_id")) if strict else F.lit("FAIL")
    return df.withColumn("reconciliation_status", F.when(ok, "PASS").otherwise(bad))


def event_summary(events: DataFrame, durations: DataFrame) -> DataFrame:
    """Counts, percentages and events a minute by type, severity and status, in long form. ``durations``: video_id, duration_seconds."""
    long = events.select(*VIDEO, F.explode(F.create_map(F.lit("EVENT_TYPE"), "event_type", F.lit("SEVERITY"), "severity", F.lit("STATUS"), "status")).alias("metric", "category"))
    out = long.groupBy(*VIDEO, "metric", "category").agg(F.count("*").alias("event_count"))
    out = out.withColumn("percentage", F.round(100.0 * F.col("event_count") / F.sum("event_count").over(Window.partitionBy(*VIDEO, "metric")), 6))
    out = out.join(scene_dim(durations), "video_id", "left")
    return out.withColumn("events_per_minute", F.round(F.try_divide(F.col("event_count"), F.col("duration_seconds")) * 60.0, 6)).drop("duration_seconds")


def video_report(summary: DataFrame, classes: DataFrame, directions: DataFrame) -> DataFrame:
    """One JSON document for each video."""
    listed = lambda df, key, name: df.groupBy(*VIDEO).agg(F.array_sort(F.collect_list(F.struct(key, "crossing_count"))).alias(name))
    out = summary.join(listed(classes, "class_name", "classes"), VIDEO, "left").join(listed(directions, "crossing_direction", "directions"), VIDEO, "left")
    return out.select(*VIDEO, F.to_json(F.struct("total_line_crossing_count", "peak_interval_count", "classes", "directions")).alias("document"))


def overview_kpis(totals: DataFrame, events: DataFrame, classes: DataFrame, peaks: DataFrame) -> DataFrame:
    """Crossings, attention events, most frequent class other than persons (first by name on ties), and the peak's start."""
    attention = events.groupBy(*VIDEO).agg(F.count_if(F.col("severity") != "INFO").alias("attention_events"))
    top = classes.where("class_name <> 'person'").groupBy(*VIDEO).agg(F.min(F.struct((-F.col("crossing_count")).alias("n"), "class_name")).alias("t")).select(*VIDEO, F.col("t.class_name").alias("top_class"))
    return totals.select(*VIDEO, "total_line_crossing_count").join(attention, VIDEO, "left").join(top, VIDEO, "left").join(peaks.select(*VIDEO, "peak_interval_start_seconds"), VIDEO, "left").withColumn("attention_events", F.coalesce("attention_events", F.lit(0)))


def track_summary(tracks: DataFrame) -> DataFrame:
    return tracks.groupBy(*VIDEO).agg(F.count("*").alias("observations"), F.count_distinct("track_id").alias("tracks"))


def class_tracks(tracks: DataFrame) -> DataFrame:
    return tracks.groupBy("class_name").agg(F.count("*").alias("observations"), F.count_distinct("video_id", "track_id").alias("tracks"))


def counter_with_resets(values: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Total of a counter that starts again: its last value and what it had reached before each drop."""
    w = Window.partitionBy(key).orderBy(order)
    before = F.lag(value).over(w)
    rows = values.withColumn("_lost", F.when(F.col(value) < before, before).otherwise(0.0))
    return rows.groupBy(key).agg((F.sum("_lost") + F.max_by(value, order)).alias("total"))


def run_benchmark(runs: DataFrame) -> DataFrame:
    """Throughput of each run and its ratio to the stage before. ``runs``: video_id, stage, stage_no, frames, seconds."""
    out = runs.withColumn("fps", F.try_divide(F.col("frames").cast("double"), F.col("seconds")))
    before = out.select("video_id", (F.col("stage_no") + 1).alias("stage_no"), F.col("fps").alias("previous_fps"))
    return out.join(before, ["video_id", "stage_no"], "left").withColumn("ratio", F.try_divide("fps", "previous_fps"))
