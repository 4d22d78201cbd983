"""Streams with typed state: quality of rows, restarts, expiry, exact occupancy."""

import os
import random
import uuid

import duckdb
from pyspark.sql import functions as F

from lanewise.plans.stream_queries import QUERIES
from lanewise.streaming import rules as st
from lanewise.streaming import stateful as sf


class Feed:
    """Files that a stream reads one by one, and what it has written so far."""

    def __init__(self, spark, folder, schema):
        self.spark, self.folder, self.schema, self.n = spark, folder, schema, 0
        (folder / "in").mkdir(parents=True)

    def add(self, rows):
        stage = self.folder / uuid.uuid4().hex
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.parquet(str(stage))
        (part,) = stage.glob("*.parquet")
        part.rename(self.folder / "in" / f"{self.n}.parquet")
        os.utime(self.folder / "in" / f"{self.n}.parquet", (1_000_000 + self.n,) * 2)
        self.n += 1

    def run(self, build):
        """Read what is new; the batches' input rows."""
        stream = st.stream_observations(self.spark, str(self.folder / "in"), self.spark.createDataFrame([], self.schema).schema, files_per_trigger=1, delay="1 second")

        def write(batch, i):
            batch.withColumn("batch", F.lit(i)).write.mode("overwrite").parquet(str(self.folder / f"out/part={i}"))

        with sf.rocks_state(self.spark):
            query = build(stream).writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", str(self.folder / "state")).trigger(availableNow=True).start()
        query.awaitTermination()
        return [p["numInputRows"] for p in query.recentProgress if p["numInputRows"]]

    def out(self):
        return self.spark.read.parquet(str(self.folder / "out")).collect()

    def state(self, name):
        return self.spark.read.format("statestore").option("stateVarName", name).load(str(self.folder / "state")).collect()


def test_all_kinds_of_quality(spark, tmp_path):
    feed = Feed(spark, tmp_path, "cam long, frame_index long, timestamp_seconds double, confidence double")
    feed.add([(1, 0, 0.0, 0.9), (1, 100, 10.0, 0.9), (1, 100, 10.0, 0.9), (1, 101, 10.1, 0.1), (2, 0, 1.0, 0.9)])
    feed.add([(1, 100, 10.0, 0.9), (1, 90, 9.0, 0.9), (1, 20, 2.0, 0.9), (1, 101, 10.1, 0.9), (1, 110, 11.0, 0.1), (1, 120, 12.0, 0.9), (1, 121, None, 0.9), (2, 1, 1.1, None)])
    feed.add([(1, 0, 0.0, 0.9), (2, 0, 1.0, 0.9), (1, 110, 11.0, 0.9)])
    build = lambda s: sf.classified(s, F.col("confidence") >= 0.5, ["cam"], ["frame_index"], 5.0)
    assert feed.run(build) == [5, 8, 3]  # a batch reads its own rows only
    assert sorted((r.batch, r.cam, r.quality, r.frame_index) for r in feed.out()) == sorted([
        (0, 1, "DUPLICATE", 100), (0, 1, "GOOD", 0), (0, 1, "GOOD", 100), (0, 1, "BAD", 101), (0, 2, "GOOD", 0),
        (1, 1, "DUPLICATE", 100), (1, 1, "GOOD", 90), (1, 1, "LATE", 20), (1, 1, "GOOD", 101), (1, 1, "BAD", 110), (1, 1, "GOOD", 120), (1, 1, "BAD", 121), (1, 2, "BAD", 1),
        (2, 1, "LATE", 0), (2, 2, "DUPLICATE", 0), (2, 1, "GOOD", 110),
    ])
    # What lies before the delay isn't kept.
    assert sorted(r.list_element.frame_index for r in feed.state("accepted") if r.key.cam == 1) == [90, 100, 101, 110, 120]


def test_quality_of_many_rows_equals_a_model(spark, tmp_path):
    rng = random.Random(4)
    feed = Feed(spark, tmp_path, "cam long, frame_index long, timestamp_seconds double, confidence double")
    want, latest, seen = [], {}, {}
    for batch in range(4):
        rows = [(rng.randrange(3), f := max(0, 20 * batch + rng.randrange(-30, 20)), f / 10, rng.choice((0.2, 0.9, 0.9))) for _ in range(60)]
        feed.add(rows)
        bound = {c: t - 1.5 for c, t in latest.items()}
        for c, f, t, conf in sorted(rows, key=lambda r: (r[2], r)):
            kind = "BAD" if conf < 0.5 else "LATE" if t < bound.get(c, -1) else "DUPLICATE" if f in seen.setdefault(c, set()) else "GOOD"
            if kind == "GOOD":
                seen[c].add(f)
                latest[c] = max(latest.get(c, 0), t)
            want.append((batch, c, f, kind))
    feed.run(lambda s: sf.classified(s, F.col("confidence") >= 0.5, ["cam"], ["frame_index"], 1.5))
    assert sorted((r.batch, r.cam, r.frame_index, r.quality) for r in feed.out()) == sorted(want)
    assert {k for *_, k in want} == {"GOOD", "BAD", "LATE", "DUPLICATE"}


SCENE = {
    "history": 5, "gap": 3, "movement": 1.0, "needed": 2, "wrong_net": 5.0, "missing": 0.5, "dwell": 0.6, "wrong_classes": ("car",), "allowed": (0,), "diagonal": 141.0,
    "still_classes": ("car",), "still_net": 0.1, "still_seconds": 0.3, "lines": {"s": {"l": (50.0, 0.0, 50.0, 100.0)}}, "zones": {"s": {"z": [(20.0, 20.0), (80.0, 20.0), (80.0, 80.0), (20.0, 80.0)]}},
}
OBSERVED = "video_id string, source_id string, track_id long, frame_index long, timestamp_seconds double, class_name string, center_x double, center_y double"


def test_track_rules_go_on_after_a_restart_and_forget_idle_tracks(spark, tmp_path):
    rng = random.Random(8)
    walks = []
    for t in range(6):
        x, y = rng.uniform(10, 90), rng.uniform(10, 90)
        for f in range(40):
            x, y = (min(95.0, max(5.0, v + rng.choice((-9, -4, 0, 0, 4, 9)))) for v in (x, y))
            walks.append(("v", "s", t, f, f / 10, "car", x, y))
    end = [("v", "s", t, 10_000, 1000.0, "end", 0.0, 0.0) for t in range(6)] + [("v", "s", 9, 20_000, 2000.0, "end", 0.0, 0.0)]
    last = [("v", "s", 9, 30_000, 3000.0, "end", 0.0, 0.0)]
    cuts = [[r for r in walks if lo <= r[3] < lo + 10] for lo in range(0, 40, 10)]
    for part in cuts:  # within a file rows come in any order
        rng.shuffle(part)
    build = lambda s: sf.track_rules(s, SCENE, idle_ms=60_000)
    found = []
    for name, runs in (("once", [[*cuts, end]]), ("restarted", [cuts[:1], cuts[1:3], [cuts[3], end]])):
        feed = Feed(spark, tmp_path / name, OBSERVED)
        for files in runs:
            for rows in files:
                feed.add(rows)
            feed.run(build)
        found.append(sorted((r.track_id, r.kind, r.place, r.frame_index) for r in feed.out() if r.frame_index < 10_000))
    want, states = [], {}
    for _, s, t, f, sec, cls, x, y in sorted(walks, key=lambda r: (r[2], r[3])):
        want += [(t, kind, place, f) for kind, place in sf.advance(*states.setdefault(t, ([], {}, {})), (f, sec, s, cls, x, y), SCENE)]
    assert found[0] == found[1] == sorted(want)
    assert {k for _, k, *_ in want} == {"LINE_CROSSING", "ZONE_ENTRY", "ZONE_EXIT", "WRONG_WAY", "LONG_DWELL", "STATIONARY_VEHICLE"}
    # Typed state of bounded size while tracks live; none once the watermark has left them behind.
    assert {r.key.track_id for r in feed.state("history")} == set(range(6))
    assert max(sum(r.key.track_id == t for r in feed.state("history")) for t in range(6)) <= SCENE["history"]
    feed.add(last)
    feed.run(build)
    for name in ("history", "crossed", "zones"):
        assert [r for r in feed.state(name) if r.key.track_id < 6] == []


def test_occupancy_counts_each_track_once(spark, tmp_path):
    feed = Feed(spark, tmp_path, "video_id string, zone_id string, track_id long, timestamp_seconds double, inside boolean")
    rng = random.Random(2)
    rows = sorted((("v", rng.choice("ab"), rng.randrange(30), rng.randrange(60) / 10, rng.random() < 0.8) for _ in range(900)), key=lambda r: r[3])
    for lo in range(0, 900, 300):
        feed.add(rows[lo : lo + 300])
    feed.add([("v", "end", 0, t, True) for t in (100.0, 200.0)])
    feed.run(st.zone_occupancy)
    want = {}
    for _, z, t, s, inside in rows:
        if inside:
            want.setdefault((z, int(s)), set()).add(t)
    got = {(r.zone_id, r.interval_start_seconds): r.tracks for r in feed.out() if r.zone_id != "end"}
    assert got == {k: len(v) for k, v in want.items()}


def test_a_row_one_second_after_the_last_stays_in_its_session(spark, tmp_path):
    """Also where tenths of a second are no exact doubles (9.2 - 8.2 < 1 < 4.4 - 3.4), and in SQL; one frame later is a new session."""
    feed = Feed(spark, tmp_path, "video_id string, zone_id string, track_id long, timestamp_seconds double")
    rows = [("v", "z", 2 * f + late, t / 10) for f in range(300) for late in (0, 1) for t in (f, f + 10 + late)]
    feed.add(sorted(rows, key=lambda r: r[3]))
    feed.add([("v", "end", 0, t) for t in (1000.0, 2000.0)])
    feed.run(lambda s: st.dwell_sessions(s).drop("s"))
    got = sorted((r.track_id, r.rows, r.first_seconds, r.last_seconds) for r in feed.out() if r.zone_id == "z")
    want = sorted(x for f in range(300) for x in ((2 * f, 2, f / 10, (f + 10) / 10), (2 * f + 1, 1, f / 10, f / 10), (2 * f + 1, 1, (f + 11) / 10, (f + 11) / 10)))
    assert got == want
    seen = ", ".join(f"('v', 'z', {k}, {round(t * 10)}, {t!r}::double, true)" for _, _, k, t in rows)
    sql = f"with zone_obs(video_id, zone_id, track_id, frame_index, timestamp_seconds, inside) as (values {seen}) {QUERIES['stream_dwell_sessions'][1]}"
    assert sorted(r[2:] for r in duckdb.sql(sql).fetchall()) == want
