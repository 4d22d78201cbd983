"""Reading and writing: explicit schemas, nested summaries, rounded outputs, file fingerprints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of the main tables.
TRACK = "video_id string, source_id string, frame_index long, timestamp_seconds double, track_id long, class_id int, class_name string, confidence double, x1 double, y1 double, x2 double, y2 double"
DETECTION = "video_id string, source_id string, frame_index long, timestamp_seconds double, class_id int, class_name string, confidence double, x1 double, y1 double, x2 double, y2 double"
EVENT = "event_id string, video_id string, source_id string, event_type string, frame_index long, timestamp_seconds double, track_id long, secondary_track_id long, class_name string, secondary_class_name string, zone_id string, line_id string, severity string, status string, rule_source string, rule_value string, threshold string"
ZONE_SUMMARY = "video_id string, source_id string, zones map<string, struct<peak_observed_occupancy: long, current_observed_occupancy: long, tracks_observed_inside: long, zone_entry_count: long, zone_exit_count: long>>"
#: Decimal places of written columns.
PLACES = {"timestamp_seconds": 6, "normalized_distance": 9, "normalized_displacement": 9, **{c: 3 for c in ("center_x", "center_y", "x1", "y1", "x2", "y2", "net_displacement", "step_displacement")}}


def read_observations(spark: SparkSession, paths, schema: str = TRACK, form: str = "parquet") -> DataFrame:
    """A typed table from Parquet or CSV; nothing is inferred, and empty CSV fields are null."""
    reader = spark.read.schema(schema)
    return reader.option("header", True).csv(paths) if form == "csv" else reader.parquet(paths)


def runtime_sources(manifest: DataFrame) -> DataFrame:
    """Videos that the runtime demo uses."""
    return manifest.where((F.col("asset_type") == "video") & (F.col("role") == "runtime_demo"))


def flatten_zone_summary(summaries: DataFrame) -> DataFrame:
    """One row for each zone of summaries read with the ZONE_SUMMARY schema."""
    return summaries.select("video_id", "source_id", F.explode("zones").alias("zone_id", "z")).select("video_id", "source_id", "zone_id", "z.*")


def track_records(detections: DataFrame, names: DataFrame) -> DataFrame:
    """Detections with class names by id, other classes dropped, and box centres. ``names``: class_id, class_name."""
    rows = detections.join(F.broadcast(names) if names.isLocal() else names, "class_id")
    return rows.withColumns({"center_x": (F.col("x1") + F.col("x2")) / 2, "center_y": (F.col("y1") + F.col("y2")) / 2})


def rounded(df: DataFrame) -> DataFrame:
    """The table as it is written: known columns to their decimal places."""
    return df.withColumns({c: F.round(c, p) for c, p in PLACES.items() if c in df.columns})


def write_tables(tables: dict[str, DataFrame], path: str, form: str = "parquet") -> None:
    """Each table, rounded, under ``path``/name, partitioned by source where it has one; nulls are empty in CSV only."""
    for name, df in tables.items():
        writer = rounded(df).write.mode("overwrite")
        if "source_id" in df.columns:
            writer = writer.partitionBy("source_id")
        writer.option("header", True).format(form).save(f"{path.rstrip('/')}/{name}")


def file_fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """(name, length, digest): SHA-256 of every file under a path; files are read where they are hashed."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "length", F.sha2("content", 256).alias("digest"))


def tree_fingerprint(files: DataFrame) -> DataFrame:
    """One row: a digest of many files' names and digests in any order, by way of 256 buckets."""
    line = F.concat_ws(":", "name", "digest")
    part = lambda i: F.conv(F.substring(F.sha2(line, 256), 1 + 12 * i, 12), 16, 10).cast("decimal(38,0)")
    buckets = files.groupBy(F.pmod(F.crc32(line.cast("binary")), F.lit(256)).alias("b")).agg(F.count("*").alias("n"), *[F.sum(part(i)).alias(f"s{i}") for i in range(4)])
    return buckets.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "b", "n", "s0", "s1", "s2", "s3"))), "|"), 256).alias("tree"), F.sum("n").alias("files"))
