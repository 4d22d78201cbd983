"""Tables that the registered queries derive from the given ones, and the scene that they use.

No given table holds boxes, so track observations are derived from ``events`` with integer
arithmetic: one track for each user, one observation for each event.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lanewise.operators import events as ev
from lanewise.operators import reports as rp
from lanewise.operators import tracks as tk
from lanewise.operators.storage import saved

WIDTH, HEIGHT, FPS = 1920, 1080, 10
SOURCES = ("highway", "downtown", "urban", "aerial")
CLASSES = ("person", "bicycle", "car", "motorcycle", "bus", "truck")
VEHICLES = CLASSES[1:]
MISSING_SECONDS, BUCKET = 1.0, 1
#: The policy of event types.
POLICY = (
    ("LINE_CROSSING", "INFO", "CONFIRMED"), ("ZONE_ENTRY", "INFO", "CONFIRMED"), ("ZONE_EXIT", "INFO", "CONFIRMED"), ("PEDESTRIAN_INTRUSION", "WARNING", "CANDIDATE"),
    ("WRONG_WAY", "WARNING", "REVIEW_REQUIRED"), ("LONG_DWELL", "INFO", "CANDIDATE"), ("STATIONARY_VEHICLE", "WARNING", "CANDIDATE"), ("PROXIMITY_WARNING", "WARNING", "REVIEW_REQUIRED"),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def values(spark: SparkSession, columns: str, rows) -> DataFrame:
    """A few configuration rows as a local relation; each row is a tuple of SQL literals."""
    return spark.sql(f"select * from values {', '.join('(' + ', '.join(r) + ')' for r in rows)} as t({columns})")


def quoted(names) -> str:
    return "array(" + ", ".join(f"'{n}'" for n in names) + ")"


def derive_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    skipped = F.when(F.expr("event_id % 13 = 0"), F.expr("event_id % 4")).otherwise(F.lit(0))
    # Dealt to a fixed number of tasks: a few bytes an event in the shuffle become a wide row, of which joined tasks would hold millions.
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    e = e.repartition(tk.shuffle_tasks(e), "user_id")
    e = e.withColumn("rn", F.row_number().over(w) - 1).withColumn("gp", F.coalesce(F.sum(skipped).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    e = e.selectExpr(
        "concat('v', cast(user_id % 8 as string)) as video_id",
        "element_at(array('highway', 'downtown', 'urban', 'aerial'), cast(user_id % 4 as int) + 1) as source_id",
        "rn + gp as frame_index", "user_id as track_id", "user_id", "event_id",
        "element_at(array('person', 'bicycle', 'car', 'motorcycle', 'bus', 'truck'), cast(user_id % 6 as int) + 1) as class_name",
        "pmod((user_id * 137) % 1920 + ((user_id div 6) % 7 - 3) * 6 * rn + event_id % 5 - 2, 3840) as mx",
        "pmod((user_id * 89) % 1080 + ((user_id div 6) % 5 - 2) * 5 * rn + event_id % 3 - 1, 2160) as my",
    )
    e = e.selectExpr(
        "video_id", "source_id", "frame_index", f"cast(frame_index as double) / {FPS} as timestamp_seconds", "track_id", "class_name", "cast(15 + event_id % 85 as double) / 100 as confidence",
        "cast(if(mx < 1920, mx, 3840 - mx) as double) as center_x", "cast(if(my < 1080, my, 2160 - my) as double) as center_y",
        "cast(40 + 20 * (user_id % 4) as double) as w", "cast(40 + 20 * (user_id % 3) as double) as h",
    )
    return e.selectExpr("*", "center_x - w / 2 as x1", "center_y - h / 2 as y1", "center_x + w / 2 as x2", "center_y + h / 2 as y2").drop("w", "h")


class Scene:
    """All track tables of one data folder, built lazily; each property is a DataFrame that runs nothing."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def _dim(self, columns: str, row) -> DataFrame:
        return values(self.spark, columns, [row(s) for s in SOURCES])

    @cached_property
    def tracks(self) -> DataFrame:
        return derive_tracks(self.spark, self.sf_dir)

    @cached_property
    def videos(self) -> DataFrame:
        return self.tracks.groupBy("video_id", "source_id").agg((F.max("frame_index") + 1).alias("frame_count"))

    @cached_property
    def durations(self) -> DataFrame:
        return self.videos.select("video_id", (F.col("frame_count") / FPS).alias("duration_seconds"))

    @cached_property
    def lines(self) -> DataFrame:
        return self._dim("source_id, line_id, ax, ay, bx, by", lambda s: (f"'{s}'", f"'{s}_line'", "960D", "200D", "960D", "1000D"))

    @cached_property
    def zones(self) -> DataFrame:
        corners = ", ".join(f"named_struct('x', {x}D, 'y', {y}D)" for x, y in ((400, 300), (1500, 300), (1500, 900), (400, 900)))
        return self._dim("source_id, zone_id, points", lambda s: (f"'{s}'", f"'{s}_zone'", f"array({corners})"))

    @cached_property
    def direction_rules(self) -> DataFrame:
        return self._dim("zone_id, classes, allowed, needed, minimum_net", lambda s: (f"'{s}_zone'", quoted(("car", "motorcycle", "bus", "truck")), quoted(("RIGHT", "UP_RIGHT", "DOWN_RIGHT")), "8", "20D"))

    @cached_property
    def dwell_rules(self) -> DataFrame:
        return self._dim("zone_id, classes, threshold_seconds", lambda s: (f"'{s}_zone'", quoted(CLASSES), "2D"))

    @cached_property
    def stationary_rules(self) -> DataFrame:
        return self._dim("zone_id, classes, movement_threshold, duration_seconds", lambda s: (f"'{s}_zone'", quoted(VEHICLES), "0.003D", "1D"))

    @cached_property
    def proximity_rules(self) -> DataFrame:
        return self._dim("zone_id, enabled, vehicle_classes, trigger, release, needed, rider_ratio", lambda s: (f"'{s}_zone'", "true", quoted(VEHICLES), "0.012D", "0.020D", "3", "0.25D"))

    @cached_property
    def labels(self) -> DataFrame:
        kinds = {"LONG_DWELL": f"seconds>={2.0:g}", "STATIONARY_VEHICLE": f"movement<={0.003:g};duration>={1.0:g}s", "PROXIMITY_WARNING": f"trigger<={0.012:g}"}
        return values(self.spark, "event_type, zone_id, label", [(f"'{k}'", f"'{s}_zone'", f"'{v}'") for k, v in kinds.items() for s in SOURCES])

    @cached_property
    def restricted(self) -> DataFrame:
        return values(self.spark, "zone_id, zone_severity", [("'highway_zone'", "'CRITICAL'"), ("'urban_zone'", "'WARNING'")])

    @cached_property
    def policy(self) -> DataFrame:
        return values(self.spark, "event_type, severity, status", [tuple(f"'{x}'" for x in p) for p in POLICY])

    @cached_property
    def thresholds(self) -> DataFrame:
        return self._dim("source_id, low, medium", lambda s: (f"'{s}'", "4", "9"))

    @cached_property
    def trajectory(self) -> DataFrame:
        return tk.trajectory(self.tracks)

    @cached_property
    def crossings(self) -> DataFrame:
        return tk.line_crossings(self.trajectory, self.lines)

    @cached_property
    def zone_obs(self) -> DataFrame:
        return tk.zone_observations(self.trajectory, self.zones)

    @cached_property
    def zone_summary(self) -> DataFrame:
        return tk.zone_summary(self.zone_obs, self.videos, self.zones)

    @cached_property
    def wrong_way(self) -> DataFrame:
        return tk.wrong_way(self.zone_obs, self.direction_rules)

    @cached_property
    def long_dwell(self) -> DataFrame:
        return tk.long_dwell(self.zone_obs, self.dwell_rules, MISSING_SECONDS)

    @cached_property
    def stationary(self) -> DataFrame:
        return tk.stationary_vehicles(self.zone_obs, self.stationary_rules, WIDTH, HEIGHT, MISSING_SECONDS)

    @cached_property
    def pairs(self) -> DataFrame:
        return tk.person_vehicle_pairs(self.zone_obs, self.proximity_rules, WIDTH, HEIGHT)

    @cached_property
    def near_pairs(self) -> DataFrame:
        return tk.person_vehicle_pairs(self.zone_obs, self.proximity_rules, WIDTH, HEIGHT, near=True)

    @cached_property
    def proximity_runs(self) -> DataFrame:
        return tk.proximity_runs(self.near_pairs)

    @cached_property
    def proximity(self) -> DataFrame:
        return tk.proximity(self.proximity_runs)

    @cached_property
    def normalized(self) -> DataFrame:
        # Six rules read the zone rows: they are written once to the shared folder.
        zones = saved(self.zone_obs, "zone-rows")
        pairs = tk.person_vehicle_pairs(zones, self.proximity_rules, WIDTH, HEIGHT, near=True)
        dealt = zones.repartition(tk.shuffle_tasks(zones), *tk.BY_ZONE)
        return ev.normalize_events(
            self.crossings, zones, self.restricted, tk.wrong_way(dealt, self.direction_rules), tk.long_dwell(dealt, self.dwell_rules, MISSING_SECONDS),
            tk.stationary_vehicles(dealt, self.stationary_rules, WIDTH, HEIGHT, MISSING_SECONDS), tk.proximity(tk.proximity_runs(pairs)), self.labels,
        )

    @cached_property
    def events(self) -> DataFrame:
        return ev.numbered(ev.deduplicated(ev.apply_policy(self.normalized, self.policy, self.restricted)))

    @cached_property
    def event_table(self) -> DataFrame:
        """The events, written once: for queries that read them several times."""
        return saved(self.events, "events")

    @cached_property
    def over_time(self) -> DataFrame:
        return rp.traffic_over_time(self.crossings, BUCKET)


def analyze(tracks: DataFrame, scene: Scene) -> dict[str, DataFrame]:
    """All tables of the track pipeline for any table of observations, under a scene's configuration."""
    own = Scene(scene.spark, scene.sf_dir)
    own.__dict__["tracks"] = tracks
    names = ("trajectory", "crossings", "zone_obs", "zone_summary", "wrong_way", "long_dwell", "stationary", "proximity", "events", "over_time")
    return {n: getattr(own, n) for n in names}
