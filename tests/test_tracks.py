"""Window forms against small sequential models of the same rules, and the edge cases of each rule."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lanewise.operators import events as ev
from lanewise.operators import reports as rp
from lanewise.operators import tracks as tk
from lanewise.plans.derived import Scene, values
from lanewise.streaming import rules as st
from lanewise.streaming.rules import pair_runs
from lanewise.streaming.stateful import advance

SCHEMA = "video_id string, source_id string, track_id long, frame_index long, timestamp_seconds double, class_name string, center_x double, center_y double, x1 double, y1 double, x2 double, y2 double, confidence double"


def observed(spark, points, cls="car", video="v", source="s"):
    """points: (track, frame, x, y)."""
    return spark.createDataFrame([(video, source, t, f, f / 10, cls, float(x), float(y), x - 5.0, y - 5.0, x + 5.0, y + 5.0, 0.5) for t, f, x, y in points], SCHEMA)


def zones(spark):
    return values(spark, "source_id, zone_id, points", [("'s'", "'z'", "array(named_struct('x', 20D, 'y', 20D), named_struct('x', 80D, 'y', 20D), named_struct('x', 80D, 'y', 80D), named_struct('x', 20D, 'y', 80D))")])


def test_trajectory_history_and_gaps(spark, rows):
    t = tk.trajectory(observed(spark, [(1, 0, 0, 0), (1, 1, 10, 0), (1, 4, 10, 10), (2, 0, 5, 5)]), history=2)
    assert rows(t, "track_id", "frame_index", "frame_gap", "history_length", "step_displacement", "direction") == [
        (1, 0, 0, 1, 0.0, "STATIONARY"), (1, 1, 1, 2, 10.0, "RIGHT"), (1, 4, 3, 2, 10.0, "DOWN"), (2, 0, 0, 1, 0.0, "STATIONARY"),
    ]


@pytest.mark.parametrize(("dx", "dy", "name"), [(9, 0, "RIGHT"), (9, -9, "UP_RIGHT"), (0, -9, "UP"), (-9, -9, "UP_LEFT"), (-9, 0, "LEFT"), (-9, 9, "DOWN_LEFT"), (0, 9, "DOWN"), (9, 9, "DOWN_RIGHT"), (3, 3, "STATIONARY")])
def test_directions(spark, rows, dx, dy, name):
    assert rows(tk.trajectory(observed(spark, [(1, 0, 50, 50), (1, 1, 50 + dx, 50 + dy)])).where("frame_index = 1"), "direction") == [(name,)]


def test_line_crossing_cases(spark, rows):
    lines = values(spark, "source_id, line_id, ax, ay, bx, by", [("'s'", "'l'", "50D", "0D", "50D", "40D")])
    cross = lambda pts: rows(tk.line_crossings(tk.trajectory(observed(spark, pts)), lines), "track_id", "frame_index", "crossing_direction")
    assert cross([(1, 0, 40, 10), (1, 1, 60, 10), (1, 2, 40, 10)]) == [(1, 1, "A_TO_B")]  # repeats count once
    assert cross([(1, 0, 60, 10), (1, 1, 40, 10)]) == [(1, 1, "B_TO_A")]
    assert cross([(1, 0, 40, 60), (1, 1, 60, 60)]) == []  # beyond the segment
    assert cross([(1, 0, 40, 10), (1, 9, 60, 10)]) == []  # gap too large
    assert cross([(1, 0, 49, 10), (1, 1, 51, 10)]) == []  # too little movement
    assert cross([]) == []


def test_zone_states(spark, rows):
    t = observed(spark, [(1, 0, 50, 50), (1, 1, 90, 50), (1, 2, 80, 50), (1, 9, 50, 50), (2, 0, 0, 0)])
    assert [r[1] for r in rows(tk.zone_observations(t, zones(spark)), "frame_index", "transition")] == ["INSIDE", "OUTSIDE", "EXIT", "ENTER", "INSIDE"]


def test_polygon_edges(spark, rows):
    tri = values(spark, "source_id, zone_id, points", [("'s'", "'z'", "array(named_struct('x', 0D, 'y', 0D), named_struct('x', 10D, 'y', 0D), named_struct('x', 0D, 'y', 10D))")])
    t = observed(spark, [(i, 0, x, y) for i, (x, y) in enumerate([(0, 0), (5, 5), (6, 6), (1, 1), (10, 0), (0, 11), (5, 0)])])
    assert [r[1] for r in rows(tk.zone_observations(t, tri), "track_id", "inside")] == [True, True, False, True, True, False, True]


def test_rules_equal_sequential_model(spark):
    rng = random.Random(7)
    points = []
    for t in range(60):
        f, x, y = 0, rng.randrange(100), rng.randrange(100)
        for _ in range(60):
            f += rng.choice((1, 1, 1, 1, 2, 13))
            x, y = min(120, max(0, x + rng.choice((-9, -6, 0, 6, 3)))), min(120, max(0, y + rng.choice((-4, 0, 4))))
            points.append((t, f, x, y))
    traj = tk.trajectory(observed(spark, points))
    obs = tk.zone_observations(traj, zones(spark))
    got = {(r.track_id, "WRONG_WAY", r.frame_index) for r in tk.wrong_way(obs, values(spark, "zone_id, classes, allowed, needed, minimum_net", [("'z'", "array('car')", "array('RIGHT', 'UP')", "2", "20D")])).collect()}
    got |= {(r.track_id, "LONG_DWELL", r.frame_index) for r in tk.long_dwell(obs, values(spark, "zone_id, classes, threshold_seconds", [("'z'", "array('car')", "1D")]), 1.0).collect()}
    got |= {(r.track_id, "STATIONARY_VEHICLE", r.frame_index) for r in tk.stationary_vehicles(obs, values(spark, "zone_id, classes, movement_threshold, duration_seconds", [("'z'", "array('car')", "0.1D", "0.3D")]), 100, 100, 1.0).collect()}
    got |= {(r.track_id, "ZONE_ENTRY" if r.transition == "ENTER" else "ZONE_EXIT", r.frame_index) for r in obs.where(F.col("transition").isin("ENTER", "EXIT")).collect()}
    scene = {"history": 30, "gap": 5, "movement": 3.0, "needed": 2, "wrong_net": 20.0, "missing": 1.0, "dwell": 1.0, "wrong_classes": ("car",), "allowed": (0, 2), "lines": {}, "zones": {"s": {"z": [(20.0, 20.0), (80.0, 20.0), (80.0, 80.0), (20.0, 80.0)]}}}
    scene |= {"diagonal": float((2 * 100**2) ** 0.5), "still_classes": ("car",), "still_net": 0.1, "still_seconds": 0.3}
    want, states = set(), {}
    for t, f, x, y in sorted(points):
        want |= {(t, k, f) for k, _ in advance(*states.setdefault(t, ([], {}, {})), (f, f / 10, "s", "car", float(x), float(y)), scene)}
    assert got == want
    assert {k for _, k, _ in got} == {"WRONG_WAY", "LONG_DWELL", "STATIONARY_VEHICLE", "ZONE_ENTRY", "ZONE_EXIT"}


def test_proximity_hysteresis_equals_model(spark):
    rng = random.Random(3)
    people, cars = [], []
    for pair in range(40):
        f = 0
        for _ in range(40):
            f += rng.choice((1, 1, 1, 2))
            people.append((pair * 2, f, 30 + pair % 3, 50))
            cars.append((pair * 2 + 1, f, 30 + pair % 3 + 10 + rng.choice((1, 2, 3, 6, 9)), 50))
    tracks = observed(spark, people, "person").unionByName(observed(spark, cars))
    tracks = tracks.withColumn("video_id", F.concat(F.lit("v"), F.expr("track_id div 2")))
    rules = values(spark, "zone_id, enabled, vehicle_classes, trigger, release, needed, rider_ratio", [("'z'", "true", "array('car')", "0.02D", "0.05D", "2", "0.25D")])
    runs = tk.proximity_runs(tk.person_vehicle_pairs(tk.zone_observations(tracks, zones(spark)), rules, 100, 100))
    got = {(r.person_track_id, r.frame_index) for r in tk.proximity(runs).collect()}
    want, diagonal = set(), (2 * 100**2) ** 0.5
    for pair in range(40):
        run, active, last = 0, False, None
        ps, cs = [p for p in people if p[0] == pair * 2], [c for c in cars if c[0] == pair * 2 + 1]
        for p, c in zip(ps, cs, strict=True):
            if not (20 <= c[2] <= 80):
                continue
            if last is not None and p[1] != last + 1:
                run, active = 0, False
            last = p[1]
            d = max(0, c[2] - 5 - (p[2] + 5)) / diagonal
            if active:
                if d > 0.05:
                    active, run = False, 0
                continue
            run = run + 1 if d <= 0.02 else 0
            if run == 2:
                active = True
                want.add((p[0], p[1]))
    assert got == want
    assert got


def test_pair_runs_in_pieces_equal_one_pass():
    """A pair's rows in batches of any size trigger where a walk over all of them does; riders and released rows are absent frames."""
    rng = random.Random(8)
    for _ in range(300):
        rows, f = [], 0
        for _ in range(rng.randrange(1, 40)):
            f += rng.choice((1, 1, 1, 1, 2))
            rows.append((f, rng.random() < 0.7))
        needed = rng.randrange(1, 4)
        want, run, told, last = [], 0, False, None
        for frame, near in rows:
            if last is not None and frame != last + 1:
                run, told = 0, False
            last, run = frame, run + 1 if near else 0
            if run == needed and not told:
                told = True
                want.append(frame)
        got, left = [], (None, 0, False)
        while rows:
            size = rng.randrange(1, 6)
            piece, rows = pd.DataFrame(rows[:size], columns=["frame_index", "near"]), rows[size:]
            hits, run, told = pair_runs(piece, *left, needed)
            got, left = got + hits, (int(piece.frame_index.iloc[-1]), run, told)
        assert got == want


def test_steps_of_many_pairs_equal_those_of_each():
    rng = np.random.default_rng(6)
    rows = pd.DataFrame({"person_track_id": rng.integers(0, 6, 3_000), "vehicle_track_id": rng.integers(0, 5, 3_000), "needed": rng.integers(2, 4, 3_000), "frame_index": rng.integers(0, 60, 3_000), "near": rng.random(3_000) < 0.8})
    by = ["person_track_id", "vehicle_track_id", "needed"]
    rows = rows.drop_duplicates([*by, "frame_index"]).sort_values([*by, "frame_index"], ignore_index=True).assign(ms=0)
    want = {(*map(int, key), f) for key, of in rows.groupby(by) for f in st.pair_runs(of[["frame_index", "near"]].reset_index(drop=True), None, 0, False, key[2])[0]}
    got, live = set(), pd.DataFrame(columns=list(st.LIVE)).astype(st.LIVE)
    for lo in range(0, 60, 7):
        hits, live = st.runs_of_pairs(rows[rows.frame_index.between(lo, lo + 6)].reset_index(drop=True), live)
        got |= {tuple(map(int, r)) for r in hits[[*by, "frame_index"]].itertuples(index=False)}
    assert got == want and len(want) > 50 and len(live) == 60


def test_events_policy_and_ids(spark, rows):
    s = Scene(spark, "/root/testdata/sf0.001")
    e = s.events.cache()
    assert e.select("event_id").distinct().count() == e.count()
    assert e.where("event_type = 'PEDESTRIAN_INTRUSION' and class_name <> 'person'").count() == 0
    twice = ev.deduplicated(s.normalized.unionByName(s.normalized))
    assert twice.count() == e.count()
    assert rows(ev.id_parity(e, e)) == [(0, 0, 0)]


def test_reports(spark, rows):
    c = spark.createDataFrame([("v", "s", t, k, "A_TO_B") for t, k in ((1.0, "person"), (2.0, "car"), (11.0, "car"), (12.0, "bus"), (23.0, "bicycle"))], "video_id string, source_id string, timestamp_seconds double, class_name string, crossing_direction string")
    peak = rp.peak_interval(rp.traffic_over_time(c, 10))
    assert rows(peak, "peak_interval_start_seconds", "peak_interval_count") == [(0, 2)]  # the earliest on ties
    z = spark.createDataFrame([("v", "s", "z", 4)], "video_id string, source_id string, zone_id string, peak_observed_occupancy long")
    low = values(spark, "source_id, low, medium", [("'s'", "2", "5")])
    assert rows(rp.traffic_summary(c, z, low), "density", "motorized_vehicle_crossing_count") == [("MEDIUM", 3)]
    with pytest.raises(Exception, match="missing density threshold"):
        rp.traffic_summary(c, z, values(spark, "source_id, low, medium", [("'t'", "2", "5")])).collect()
    bad = rp.distribution(c, "class_name").where("class_name <> 'bus'")
    assert rows(rp.reconcile_totals(rp.crossing_totals(c), bad, rp.distribution(c, "crossing_direction")), "reconciliation_status") == [("FAIL",)]
    assert rp.crossing_totals(c.limit(0)).count() == 0


def test_one_exchange_for_track_windows(spark):
    s = Scene(spark, "/root/testdata/sf0.001")
    stored = observed(spark, [(1, 0, 0, 0)])
    plan = tk.zone_observations(tk.trajectory(stored), s.zones)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert "CartesianProduct" not in plan
    assert "Python" not in plan


def test_rules_over_runs_sort_rows_once(spark):
    """A sort by run or episode of all rows would hold them in a task once more; rows of pairs aren't joined into few tasks."""
    from lanewise.plans.derived import Scene

    s = Scene(spark, "/root/testdata/sf0.001")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    active = plan(tk.active_pairs(s.proximity_runs))
    assert active.count("Sort [video_id") == plan(s.near_pairs).count("Sort [video_id") + 1
    assert "REPARTITION_BY_NUM" in active
    zones_once = plan(s.zone_obs).count("Sort [")
    assert plan(s.wrong_way).count("Sort [") <= zones_once + 1


def test_events_are_numbered_frame_by_frame(spark):
    """No task orders a whole video, and numbers go on over frames."""
    types = ("LINE_CROSSING", "ZONE_ENTRY", "WRONG_WAY")
    rows = [(f"v{i % 2}", types[i % 3], i // 40, (i * 7) % 40, None, "z", "l", "r") for i in range(2_000)]
    df = ev.numbered(spark.createDataFrame(rows, "video_id string, event_type string, frame_index long, track_id long, secondary_track_id long, zone_id string, line_id string, rule_value string"))
    got = sorted((r.event_id, r.frame_index, types.index(r.event_type), r.track_id) for r in df.collect())
    want = []
    for v in ("v0", "v1"):
        mine = sorted((r[2], types.index(r[1]), r[3]) for r in rows if r[0] == v)
        want += [(f"{v}-EVT-{n:06d}", *r) for n, r in enumerate(mine, 1)]
    assert got == want
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number() windowspecdefinition(video_id" in plan
    assert all("frame_index" in (part := w.split(",", 2)[1]) and "ASC" not in part for w in plan.split("row_number() windowspecdefinition(")[1:])


def test_events_of_a_crowded_frame_are_numbered_track_by_track(spark):
    """No task orders the warnings of a whole frame, which grow with the square of its tracks; ids that are null come first."""
    kinds = ("LINE_CROSSING", "ZONE_ENTRY", "PEDESTRIAN_INTRUSION", "PROXIMITY_WARNING")
    rows = [(f"v{f % 2}", k, f // 2, t or None, s if k == kinds[3] else None, None if t % 5 == 0 else "z", None, "r") for f in range(4) for k in kinds for t in range(12) for s in range(9 if k == kinds[3] else 1)]
    df = ev.numbered(spark.createDataFrame(rows, "video_id string, event_type string, frame_index long, track_id long, secondary_track_id long, zone_id string, line_id string, rule_value string").repartition(5))
    first = lambda v: (v is not None, v)
    place = lambda r: (r[2], ev.STAGES[r[1]], first(r[3]), first(r[5]), r[1] == kinds[2], first(r[4]))
    want = [(f"{v}-EVT-{n:06d}", *r) for v in ("v0", "v1") for n, r in enumerate(sorted((r for r in rows if r[0] == v), key=place), 1)]
    assert sorted((r.event_id, *r[:-1]) for r in df.collect()) == want
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    (window,) = plan.split("row_number() windowspecdefinition(")[1:]
    assert "_own" in window.split(" ASC")[0]


def test_tracks_of_events_are_dealt_to_a_fixed_number_of_tasks(spark):
    """Spark would join tasks by the few bytes of an event in the shuffle, and a task would hold millions of wide rows."""
    plan = Scene(spark, "/root/testdata/sf0.001").trajectory._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert "REPARTITION_BY_NUM" in plan
