"""Contracts, data quality, confidence statistics and run checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanewise.functions.geometry import bbox_area_normalized, box
from lanewise.functions.percentiles import exact_percentiles


def require_columns(df: DataFrame, columns, name: str) -> None:
    """Fail before planning if columns are missing."""
    if missing := sorted(set(columns) - set(df.columns)):
        raise ValueError(f"{name} is missing columns: {missing}")


def observation_quality(tracks: DataFrame, classes: tuple[str, ...], mode: str = "report") -> DataFrame:
    """(video_id, track_id, frame_index, issue): rows that break the contract. ``mode`` fail raises on the first one."""
    b = box()
    finite = reduce(Column.__and__, [~F.isnan(c) & (F.abs(c) != float("inf")) for c in b])
    w = Window.partitionBy("video_id", "track_id", "frame_index")
    before = Window.partitionBy("video_id", "track_id").orderBy("timestamp_seconds", "frame_index").rowsBetween(Window.unboundedPreceding, -1)
    rules = {
        "BAD_BOX": ~finite | (b[2] < b[0]) | (b[3] < b[1]),
        "BAD_CONFIDENCE": ~F.col("confidence").between(0, 1),
        "UNKNOWN_CLASS": ~F.col("class_name").isin(*classes),
        "NEGATIVE_ID": (F.col("track_id") < 0) | (F.col("frame_index") < 0),
        "DUPLICATE_OBSERVATION": F.count("*").over(w) > 1,
    }
    if "timestamp_seconds" in tracks.columns:  # in the order of time frames must advance; repeated frames are the duplicates above
        rules["NON_ADVANCING_FRAME"] = F.coalesce(F.col("frame_index") < F.max("frame_index").over(before), F.lit(False))
    issues = F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(True)), name) for name, bad in rules.items()]))
    out = tracks.withColumn("issues", issues).withColumn("issue", F.explode("issues"))
    if mode == "fail":
        out = out.withColumn("issue", F.raise_error(F.concat(F.col("issue"), F.lit(" in "), F.col("video_id"))).cast("string"))
    return out.select("video_id", "track_id", "frame_index", "issue")


def runtime_profile(sources: DataFrame, profiles: DataFrame, default: str) -> DataFrame:
    """Each source's profile, or the default. ``profiles``: source_id, profile."""
    return sources.join(F.broadcast(profiles) if profiles.isLocal() else profiles, "source_id", "left").withColumn("profile", F.coalesce("profile", F.lit(default)))


def video_metadata_validate(metadata: DataFrame) -> DataFrame:
    """PASS, WARNING or FAIL with messages, for rows of video_id, width, height, fps, frame_count."""
    errors = F.array_compact(F.array(F.when((F.col("width") <= 0) | (F.col("height") <= 0), "invalid resolution"), F.when(F.coalesce(F.col("fps") <= 0, F.lit(True)), "invalid fps"), F.when(F.col("frame_count") <= 0, "no frames")))
    warnings = F.array_compact(F.array(F.when(F.col("fps") > 120, "unusual fps"), F.when(F.col("frame_count") < 10, "short video")))
    status = F.when(F.size(errors) > 0, "FAIL").when(F.size(warnings) > 0, "WARNING").otherwise("PASS")
    return metadata.withColumn("status", status).withColumn("message", F.concat_ws("; ", F.concat(errors, warnings)))


def run_validation(runs: DataFrame) -> DataFrame:
    """PASS or FAIL with messages, for rows of expected_frames, processed_frames, output_frames."""
    messages = F.array_compact(F.array(F.when(F.col("processed_frames") != F.col("expected_frames"), "processed frames differ"), F.when(F.col("output_frames") != F.col("processed_frames"), "output frames differ")))
    return runs.withColumn("status", F.when(F.size(messages) == 0, "PASS").otherwise("FAIL")).withColumn("message", F.concat_ws("; ", messages))


def table_fingerprint(rows: DataFrame, columns, key: str, buckets: int = 64) -> DataFrame:
    """One row: a SHA-256 of a table that doesn't depend on its order, by way of buckets of row digests.

    Digests in a bucket are summed as numbers, so no list of rows is ever gathered.
    """
    digest = F.sha2(F.to_json(F.struct(*columns)), 256)
    part = lambda i: F.conv(F.substring(digest, 1 + 12 * i, 12), 16, 10).cast("decimal(38,0)")
    per = rows.groupBy(F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(buckets)).alias("bucket")).agg(F.count("*").alias("n"), *[F.sum(part(i)).alias(f"s{i}") for i in range(4)])
    line = F.concat_ws(":", "bucket", "n", *[f"s{i}" for i in range(4)])
    return per.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "|"), 256).alias("fingerprint"), F.sum("n").alias("rows"))


def integrity_compare(expected: DataFrame, observed: DataFrame) -> DataFrame:
    """(asset, status): MATCH, CHANGED, MISSING or UNEXPECTED by full outer join of (asset, digest)."""
    e, o = expected.select("asset", F.col("digest").alias("e")), observed.select("asset", F.col("digest").alias("o"))
    status = F.when(F.col("o").isNull(), "MISSING").when(F.col("e").isNull(), "UNEXPECTED").when(F.col("e").eqNullSafe(F.col("o")), "MATCH").otherwise("CHANGED")
    return e.join(o, "asset", "full").select("asset", status.alias("status"))


def confidence_stats(detections: DataFrame, by: str = "class_name") -> DataFrame:
    """Count, mean and exact interpolated percentiles of confidence."""
    out = detections.groupBy(by).agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("mean"))
    q = exact_percentiles(detections, by, "confidence", {f"p{p}": p / 100 for p in (10, 25, 50, 75, 90)})
    return out.join(q, by, "left").select(by, "n", "mean", *[F.round(f"p{p}", 6).alias(f"p{p}") for p in (10, 25, 50, 75, 90)])


def confidence_distribution(detections: DataFrame) -> DataFrame:
    """Percentiles over all detections and over each class; scope ALL or the class."""
    scopes = detections.select(F.explode(F.array(F.lit("ALL"), F.col("class_name"))).alias("scope"), "confidence")
    q = exact_percentiles(scopes, "scope", "confidence", {"p10": 0.1, "p50": 0.5, "p90": 0.9})
    return scopes.groupBy("scope").agg(F.count("*").alias("n")).join(q, "scope", "left").select("scope", "n", *[F.round(c, 6).alias(c) for c in ("p10", "p50", "p90")])


def diagnostic_rows(detections: DataFrame, width: int, height: int, small: float = 0.01) -> DataFrame:
    """Detections with their area as a share of the frame and whether that is small."""
    area = bbox_area_normalized(box(), F.lit(width), F.lit(height))
    return detections.withColumns({"normalized_bbox_area": F.round(area, 8), "small_bbox": area < small})


def runtime_metrics(tracks: DataFrame, width: int, height: int, low: float, high: float, by: str = "source_id") -> DataFrame:
    """Detections, small vehicles, low-confidence rows and tracks for each experiment."""
    small = bbox_area_normalized(box(), F.lit(width), F.lit(height)) < 0.01
    return tracks.groupBy(by).agg(
        F.count("*").alias("detections"), F.count_if((F.col("class_name") != "person") & small).alias("small_vehicles"), F.count_if((F.col("confidence") >= low) & (F.col("confidence") < high)).alias("low_band"), F.count_distinct("video_id", "track_id").alias("tracks"),
    )


def experiment_deltas(metrics: DataFrame, baseline: str, by: str = "source_id") -> DataFrame:
    """Each experiment's metrics minus the baseline's, which is one row."""
    names = [c for c in metrics.columns if c != by]
    base = metrics.where(F.col(by) == baseline).agg(*[F.max(c).alias(f"b_{c}") for c in names])  # one row
    return metrics.crossJoin(base).select(by, *[(F.col(c) - F.col(f"b_{c}")).alias(f"delta_{c}") for c in names])


def experiment_matrix(tracks: DataFrame, experiments: list[str], by: str = "source_id") -> DataFrame:
    return tracks.groupBy("class_name").pivot(by, experiments).agg(F.count(F.lit(1))).fillna(0)


def synchronized_frames(videos: DataFrame, seconds: list[float], fps: float) -> DataFrame:
    """The frame at each relative second, where it is in range; distinct."""
    at = F.explode(F.array(*map(F.lit, seconds))).alias("second")
    return videos.select("video_id", "frame_count", at).withColumn("frame_index", F.rint(F.col("second") * fps).cast("long")).where(F.col("frame_index") < F.col("frame_count")).select("video_id", "frame_index").distinct()
