"""Forms made for skew and size: percentiles, running sums, components, against plain models."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lanewise.functions.percentiles import exact_percentiles, narrowed
from lanewise.functions.scan import running_sums
from lanewise.operators import duplicates as du
from lanewise.operators import evaluation as el


def test_percentiles_of_skewed_groups_equal_sorted_values(spark):
    rng = np.random.default_rng(1)
    groups = {
        "log": np.r_[np.exp(rng.normal(0, 3, 30_000)), [1e12, -1e12]], "same": np.full(20_000, 7.0), "mixed": np.r_[np.full(15_000, 1.0), rng.normal(1, 1e-6, 9_000)],
        "few": np.array([3.0, 1.0]), "one": np.array([5.0]), None: rng.integers(0, 5, 8_000).astype(float),
    }
    rows = [(g, float(v)) for g, values in groups.items() for v in values] + [("few", None), ("few", float("nan")), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(8)
    wanted = {"p0": 0.0, "p10": 0.1, "p33": 0.333, "p50": 0.5, "p99": 0.99, "p100": 1.0}
    for most, ranges in ((4_000_000, 256), (500, 16), (50, 64)):
        got = {r.g: r for r in exact_percentiles(df, "g", "v", wanted, most, ranges).collect()}
        assert set(got) == set(groups)
        for g, values in groups.items():
            assert [got[g][c] for c in wanted] == pytest.approx([np.percentile(values, 100 * q) for q in wanted.values()], rel=1e-12), g


def test_narrowed_ranges_are_even_however_values_are_spread(spark):
    rng = np.random.default_rng(2)
    values = np.r_[np.exp(rng.normal(0, 4, 40_000)), np.full(20_000, 2.5), [1e300]]
    df = spark.createDataFrame([("k", float(v)) for v in values], "k string, v double")
    targets = spark.createDataFrame([("k", r) for r in (0, 6_000, 30_000, 60_000)], "k string, rank long")
    held, asked = narrowed(df, targets, most=1_000, ranges=64)
    sizes = {r.k: (r.n, r.distinct) for r in held.groupBy("k").agg(F.count("*").alias("n"), F.count_distinct("v").alias("distinct")).collect()}
    assert all(n <= 1_000 or distinct == 1 for n, distinct in sizes.values())
    assert {(r.of, r.asked) for r in asked.collect()} == {("k", r) for r in (0, 6_000, 30_000, 60_000)}


@pytest.mark.parametrize("by", [["g"], [], ["g", "h"]])
def test_running_sums_equal_a_window(spark, by):
    rng = random.Random(len(by))
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.choice([1, 1, 1, 2]), rng.choice([1.0, 1.0, 2.0]), i, rng.choice([None, -3, 1, 5])) for i in range(3_000)]
    df = spark.createDataFrame(rows, "g string, h int, conf double, id long, x long").withColumn("one", F.lit(1).cast("long"))
    got = {r.id: (r.n, r.s) for r in running_sums(df, by, [F.desc("conf"), F.col("id")], {"n": "one", "s": "x"}, 16).collect()}
    want, sums = {}, {}
    for g, h, conf, i, x in sorted(rows, key=lambda r: (-r[2], r[3])):
        key = tuple({"g": g, "h": h}[c] for c in by)
        n, s = sums.get(key, (0, 0))
        want[i] = sums[key] = (n + 1, s + (x or 0))
    assert got == want


def test_running_sums_deal_one_group_over_tasks(spark):
    df = spark.range(20_000).select(F.lit("g").alias("g"), F.lit(0.5).alias("conf"), "id", F.lit(1).cast("long").alias("one"))
    out = running_sums(df, ["g"], [F.desc("conf"), F.col("id")], {"n": "one"}, 8)
    assert out.where("n <> id + 1").isEmpty()
    stored = spark.read.parquet(out.inputFiles()[0].rsplit("/", 1)[0])
    assert sorted(r["count"] for r in stored.groupBy("range_").count().collect())[-1] < 6_000


def brute_ap(truth, predictions, matches):
    """(class, threshold) -> ap, recall, precision."""
    out = {}
    for cls in {p[2] for p in predictions}:
        order = sorted((p for p in predictions if p[2] == cls), key=lambda p: (-p[3], p[0], p[1]))
        targets = sum(t[2] == cls for t in truth)
        for t in el.THRESHOLDS:
            tp, points = 0, []
            for n, p in enumerate(order, 1):
                tp += (p[0], t, p[1]) in matches
                points.append((tp / targets, tp / n))
            ap = sum(max((p for r, p in points if r * 100 + 1e-9 >= level), default=0) for level in range(101)) / 101
            out[cls, t] = (ap, points[-1][0], points[-1][1])
    return out


def test_average_precision_with_one_confidence_for_all(spark):
    rng = random.Random(4)
    box = lambda x, y: (x, y, x + 10.0, y + 10.0)
    truth = [(f"i{i}", g, rng.choice(["a", "a", "b"]), *box(30.0 * g, 0.0)) for i in range(40) for g in range(4)]
    preds = [(i, 10 * g + k, cls, rng.choice([0.5, 0.5, 0.5, 0.9]), *box(x1 + rng.choice([0, 0.5, 1, 2, 4]), y1)) for i, g, cls, x1, y1, *_ in truth for k in range(rng.randrange(3))]
    b = "x1 double, y1 double, x2 double, y2 double"
    t = spark.createDataFrame(truth, f"image_id string, gt long, class_name string, {b}")
    p = spark.createDataFrame(preds, f"image_id string, pred long, class_name string, conf double, {b}")
    matches = {(r.image_id, r.threshold, r.pred) for r in el.match_predictions(t, p).collect()}
    got = {(r.class_name, r.threshold): (r.ap, r.recall, r.precision) for r in el.average_precision(t, p).collect()}
    want = brute_ap(truth, preds, matches)
    assert set(got) == set(want)
    assert all(got[k] == pytest.approx(want[k]) for k in want)


def roots(edges, nodes):
    parent = {n: n for n in nodes}

    def find(v):
        while parent[v] != v:
            parent[v] = parent[parent[v]]
            v = parent[v]
        return v

    for x, y in edges:
        a, b = find(x), find(y)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components_equal_union_find(spark, monkeypatch):
    monkeypatch.setattr(du, "HUB_EDGES", 20)
    rng = random.Random(9)
    nodes = list(range(600))
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(250)] + [(500, i) for i in range(501, 570)] + [(5, 5), (7, 8), (8, 7)]
    df = spark.createDataFrame(edges, "x long, y long")
    got = {r.id: r.root for r in du.connected(df, spark.createDataFrame([(n,) for n in nodes], "id long")).collect()}
    assert got == roots(edges, nodes)


def test_long_paths_and_large_stars_shrink(spark):
    """A path of 10,000 in order loses about half of its edges a round; a star of 200,000 around its smallest node all of them in one."""
    path = spark.range(9_999).select(F.col("id").alias("x"), (F.col("id") + 1).alias("y"))
    rounds, sizes = du.contracted(path)
    assert sizes[0] == 9_999
    assert all(b <= 0.75 * a for a, b in zip(sizes[1:], sizes[2:], strict=False) if a > 100)
    assert len(rounds) <= 20
    star = spark.range(1, 200_000).select(F.lit(0).cast("long").alias("x"), F.col("id").alias("y"))
    assert du.contracted(star)[1] == [199_999]


def test_duplicate_groups_with_hot_copies(spark):
    """A third of all rows share sha and print; they are one node before edges are made."""
    rows = [(i, "hot", 1, None) for i in range(3_000)] + [(3_000 + i, f"s{i}", (1 << 40) + (i << 8), "g" if i < 5 else None) for i in range(6_000)] + [(20_000, "own", 3, None), (20_001, None, None, None)]
    df = spark.createDataFrame(rows, "id long, sha string, print long, source_group string")
    got = {r.id: r for r in du.duplicate_groups(df, 1).collect()}
    assert len(got) == len(rows)
    assert {(got[i].group_root, got[i].group_size, got[i].exact_group_size, got[i].basis) for i in range(3_000)} == {(0, 3_001, 3_000, "EXACT_AND_NEAR")}
    assert (got[20_000].group_root, got[20_000].basis) == (0, "NEAR")
    assert (got[20_001].group_root, got[20_001].exact_group_size, got[20_001].basis) == (20_001, 1, "SINGLETON")
    assert len({got[3_000 + i].group_root for i in range(5)}) == 1


def test_ranges_meet_frames_by_bucket(spark):
    from lanewise.operators import sampling as sm

    rng = random.Random(3)
    ranges = [("v", lo := rng.randrange(40_000), lo + rng.randrange(-3, 30)) for _ in range(1_500)] + [("v", 0, 5), ("v", 6, 9), ("v", 20_000, 23_000), ("w", 7, 7), ("w", 7, 7)]
    frames = [("v", f) for f in range(0, 41_000, 3)] + [("w", f) for f in range(20)] + [("x", 1), (None, 1), ("v", None)]
    covered = {(v, f) for v, lo, hi in ranges for f in range(lo, hi + 1)}
    r = spark.createDataFrame(ranges, "video_id string, start_frame long, end_frame long")
    f = spark.createDataFrame(frames, "video_id string, frame_index long")
    for bucket in (16, 256):
        out = sm.exclude_ranges(f, r, bucket)
        assert sorted(map(tuple, out.collect()), key=str) == sorted((x for x in frames if x not in covered), key=str)
    merged = sorted((m.start_frame, m.end_frame) for m in sm.merged_ranges(r).where("video_id = 'v'").collect())
    assert all(b[0] > a[1] + 1 for a, b in zip(merged, merged[1:], strict=False))
    assert sum(hi - lo + 1 for lo, hi in merged) == len({f for v, f in covered if v == "v"})


def test_many_ranges_of_one_video_need_no_nested_loop(spark):
    from lanewise.operators import sampling as sm

    r = spark.range(100_000).select(F.lit("v").alias("video_id"), (F.col("id") * 10).alias("start_frame"), (F.col("id") * 10 + 3).alias("end_frame"))
    f = spark.range(1_000_000).select(F.lit("v").alias("video_id"), F.col("id").alias("frame_index"))
    out = sm.exclude_ranges(f, r)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan
    assert "Cartesian" not in plan
    assert out.count() == 600_000


def _boxes(spark, rows, prefix, name):
    return spark.createDataFrame(rows, f"image_id long, {name} long, {prefix}x1 double, {prefix}y1 double, {prefix}x2 double, {prefix}y2 double")


def _gap(a, b):
    return math.hypot(max(a[2] - b[4], b[2] - a[4], 0.0), max(a[3] - b[5], b[3] - a[5], 0.0))


@pytest.mark.parametrize(("cell", "reach"), [(7.0, 0.0), (64.0, 0.0), (16.0, 25.0), (1e6, 3.0)])
def test_boxes_meet_by_cells_as_by_pairs(spark, cell, reach):
    from lanewise.functions import grid

    rng = random.Random(int(cell))

    def some(n):
        corners = [(rng.uniform(-60, 60), rng.uniform(-60, 60)) for _ in range(n)]
        return [(i % 3, i, x, y, x + rng.choice((0.0, 4.0, 30.0, 200.0)), y + rng.choice((0.0, 5.0, 14.0))) for i, (x, y) in enumerate(corners)]

    # Edges on the grid's own lines, equal boxes, one without a corner.
    left = [*some(150), (0, 900, 0.0, 0.0, 14.0, 14.0), (0, 901, 0.0, 0.0, 14.0, 14.0)]
    right = [*some(150), (0, 900, 14.0, 14.0, 28.0, 28.0), (0, 901, 0.0, 0.0, 14.0, 14.0)]
    p, q = _boxes(spark, [*left, (0, 999, None, 0.0, 1.0, 1.0)], "p_", "a"), _boxes(spark, [*right, (0, 999, 0.0, 0.0, None, 1.0)], "q_", "b")
    p = p.withColumn("reach", F.lit(reach))
    met = [(r.a, r.b) for r in grid.meeting(p, q, ["image_id"], cell, "p_", "q_", F.col("reach")).collect()]
    assert len(met) == len(set(met))
    want = {(a[1], b[1]) for a in left for b in right if a[0] == b[0] and _gap(a, b) <= reach}
    assert len(want) > 100
    assert want <= set(met)


def test_a_crowded_frame_forms_few_pairs(spark):
    from lanewise.functions import grid
    from lanewise.operators.evaluation import candidate_matches

    rng = random.Random(4)
    rows = [(1, i, x := rng.uniform(0, 3800), y := rng.uniform(0, 2100), x + rng.uniform(10, 60), y + rng.uniform(10, 60)) for i in range(5_000)]
    truth, found = _boxes(spark, rows, "", "gt").withColumn("class_name", F.lit("car")), _boxes(spark, [(a, i, x + 3, y, u + 3, v) for a, i, x, y, u, v in rows], "", "pred").withColumn("class_name", F.lit("car"))
    named = lambda df, s: df.select("image_id", *[F.col(c).alias(f"{s}_{c}") for c in ("x1", "y1", "x2", "y2")])
    formed = grid.meeting(named(truth, "t"), named(found, "p"), ["image_id"], 64.0, "t_", "p_").count()
    x1, y1, x2, y2 = (np.array([r[k] for r in rows]) for k in range(2, 6))
    meet = int(((x1[:, None] <= x2 + 3) & (x1 + 3 <= x2[:, None]) & (y1[:, None] <= y2) & (y1 <= y2[:, None])).sum())
    assert meet <= formed < 8 * meet < 25_000_000 / 20
    assert candidate_matches(truth, found).where("gt = pred").count() == sum(u - x >= 9.0 for _, _, x, _, u, _ in rows)


def test_near_pairs_give_the_same_warnings(spark):
    from lanewise.operators import tracks as tk
    from lanewise.plans.derived import HEIGHT, WIDTH, Scene

    s = Scene(spark, "/root/testdata/sf0.001")
    every = tk.proximity_runs(s.pairs)
    columns = ["video_id", "zone_id", "frame_index", "person_track_id", "vehicle_track_id"]
    for rules in (tk.proximity, tk.active_pairs):
        assert sorted(map(tuple, rules(every).select(columns).collect())) == sorted(map(tuple, rules(s.proximity_runs).select(columns).collect()))
    wide = s.proximity_rules.withColumns({"trigger": F.lit(0.1), "release": F.lit(0.15)})
    far, near = (tk.person_vehicle_pairs(s.zone_obs, wide, WIDTH, HEIGHT, near=n) for n in (False, True))
    want = sorted(map(tuple, far.where("normalized_distance <= 0.15").select(*columns, "rider").collect()))
    assert want
    assert sorted(map(tuple, near.select(*columns, "rider").collect())) == want
    assert len(want) < far.count()
    ran = sorted(map(tuple, tk.proximity(tk.proximity_runs(far)).select(columns).collect()))
    assert ran
    assert sorted(map(tuple, tk.proximity(tk.proximity_runs(near)).select(columns).collect())) == ran


def test_one_event_table_for_a_query_and_an_empty_folder_after_it(spark):
    from lanewise.operators import storage
    from lanewise.plans import track_queries

    path = lambda df: df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.saved_path)
    for name in ("evidence_trace", "event_id_parity"):
        before = {x.saved_path for x in storage._written}
        with storage.scratch():
            df = track_queries.queries()[name](spark, "/root/testdata/sf0.001")
            new = [x for x in storage._written if x.saved_path not in before]
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert sum("/events-" in x.saved_path for x in new) == 1
            assert "lineitem.parquet" not in plan
            assert "events.parquet" not in plan
            assert df.count()
        assert new
        assert not any(path(x).getFileSystem(spark._jsc.hadoopConfiguration()).exists(path(x)) for x in new)
        assert {x.saved_path for x in storage._written} == before


def test_id_parity_counts_every_extra_row(spark):
    from lanewise.operators.events import id_parity

    ours, earlier = (spark.createDataFrame([(x,) for x in ids], "event_id string") for ids in (["a", "a", "a", "b", "c"], ["a", "c", "c", "d"]))
    assert tuple(id_parity(ours, earlier).first()) == (1, 3, 2)
    assert tuple(id_parity(ours.limit(0), earlier.limit(0)).first()) == (0, 0, 0)


def test_keys_of_near_prints_are_not_broadcast(spark):
    # A few bytes a print in the file, but a row for each mask: Spark's estimate would broadcast what doesn't fit a driver.
    prints = spark.range(1, 4_000).select(F.xxhash64("id").alias("print"))
    ones = prints.withColumn("print", F.col("print").bitwiseXOR(F.lit(5)))
    pairs = du.near_pairs(prints.unionByName(ones), 6)
    overlap = du.near_overlap(prints, ones, 6)
    for df in (pairs, overlap):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert pairs.count() == overlap.count() == 3_999


def test_metrics_of_models_leave_a_few_rows_in_the_folder(spark):
    from lanewise.operators import storage
    from lanewise.plans.governance_queries import Datasets

    before = {x.saved_path for x in storage._written}
    metrics = Datasets(spark, "/root/testdata/sf0.001").metrics
    left = [x for x in storage._written if x.saved_path not in before]
    assert sum(x.count() for x in left) == 6
    assert metrics.count() == 8


def test_running_sums_write_kept_columns_only(spark):
    df = spark.range(5_000).select(F.expr("id % 3").alias("g"), "id", F.lit("x").alias("wide"), F.lit(1).cast("long").alias("one"), F.expr("id % 2").alias("odd"))
    out = running_sums(df, ["g"], [F.col("id")], {"n": "one", "m": "odd"}, 8, keep=["g", "id"])
    assert out.columns == ["g", "id", "n", "m"]
    assert set(spark.read.parquet(out.inputFiles()[0].rsplit("/", 1)[0]).columns) == {"g", "id", "n", "m", "range_"}
    assert out.where("n <> id div 3 + 1").isEmpty()
    wanted = df.select("id", F.sum("odd").over(Window.partitionBy("g").orderBy("id")).alias("w"))
    assert out.join(wanted, "id").where("m <> w").isEmpty()


def test_percentiles_read_a_large_group_once(spark, tmp_path):
    spark.range(200_000).select((F.col("id") % 50).cast("double").alias("v"), F.lit("g").alias("g")).repartition(4).write.parquet(str(tmp_path / "rows"))
    read = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def seen(v):
        read.add(1)
        return v

    rows = spark.read.parquet(str(tmp_path / "rows")).select("g", seen.asNondeterministic()("v").alias("v"))
    (got,) = exact_percentiles(rows, "g", "v", {"p10": 0.1, "p50": 0.5}, most=20, ranges=8).collect()
    assert (got.p10, got.p50) == (np.percentile(np.repeat(np.arange(50.0), 4_000), 10), 24.5)
    assert read.value == 200_000


def test_all_pairs_of_a_crowded_frame_are_several_tasks_work(spark):
    from lanewise.operators import tracks as tk
    from lanewise.plans.derived import Scene

    columns = "video_id string, source_id string, zone_id string, frame_index long, timestamp_seconds double, track_id long, class_name string, inside boolean, x1 double, y1 double, x2 double, y2 double"
    rows = [("v", "s", "urban_zone", 0, 0.0, i, "person" if i % 4 == 0 else "car", True, float(i), 0.0, i + 9.0, 9.0) for i in range(400)]
    joins = "spark.sql.autoBroadcastJoinThreshold"
    kept = spark.conf.get(joins)
    spark.conf.set(joins, "-1")
    try:
        pairs = tk.person_vehicle_pairs(spark.createDataFrame(rows, columns), Scene(spark, "").proximity_rules, 1920, 1080)
        got = pairs.select("person_track_id", "vehicle_track_id", F.spark_partition_id().alias("task")).collect()
    finally:
        spark.conf.set(joins, kept)
    assert sorted((r.person_track_id, r.vehicle_track_id) for r in got) == [(p, v) for p in range(0, 400, 4) for v in range(400) if v % 4]
    assert len({r.task for r in got}) > 2


def _clustered(n: int) -> list[int]:
    """Prints in dense clusters, as those of texts in one language are, beside lone ones."""
    rng = random.Random(71)
    centre = [rng.getrandbits(64) for _ in range(3)]
    dense = {c ^ sum(1 << b for b in rng.sample(range(40), rng.randrange(5))) for c in centre for _ in range(n // 4)}
    return sorted({x - 2**63 for x in [*dense, *(rng.getrandbits(64) for _ in range(n // 4))]})


def _apart(a: int, b: int) -> int:
    return ((a ^ b) & (2**64 - 1)).bit_count()


@pytest.mark.parametrize("key_block", [40, 4_096])
def test_dense_prints_give_all_pairs_and_few_links(spark, monkeypatch, key_block):
    monkeypatch.setattr(du, "KEY_BLOCK", key_block)
    prints = _clustered(1_200)
    df = spark.createDataFrame([(p, 10 * i + k) for i, p in enumerate(prints) for k in range(1 + i % 2)], "print long, id long")
    want = {(a, b): _apart(a, b) for i, a in enumerate(prints) for b in prints[i + 1 :] if _apart(a, b) <= 6}
    place = {p: 10 * i for i, p in enumerate(prints)}
    got = du.near_pairs(df, 6, "id").collect()
    assert sorted((r.a, r.b, r.distance, r.a_name, r.b_name) for r in got) == sorted((a, b, d, place[a], place[b]) for (a, b), d in want.items())
    # Components need no pairs: links grow with the prints, and connect the same.
    links = du.near_links(df, 6, "id")
    masks = len(du.block_masks(6, len(prints)))
    n = links.distinct().count()
    assert n < min(len(want) / 2, masks * len(prints))
    edges = spark.createDataFrame([(place[a], place[b]) for a, b in want], "x long, y long")
    assert sorted(map(tuple, du.connected(links, df).collect())) == sorted(map(tuple, du.connected(edges, df).collect()))
    # Crowded keys: pairs of their lists meet in more than one task.
    left, right = df.where(F.col("id") % 30 < 20), df.where(F.col("id") % 30 >= 10)
    of = lambda side: {r.print: r.id for r in side.groupBy("print").agg(F.min("id").alias("id")).collect()}
    lows, highs = of(left), of(right)
    near = du.near_overlap(left, right, 6, named=True).collect()
    assert sorted((r.candidate, r.reference, r.distance) for r in near) == sorted((x, y, _apart(a, b)) for a, x in lows.items() for b, y in highs.items() if _apart(a, b) <= 6)


def test_overlap_counts_references_of_other_digests(spark):
    rng = random.Random(5)
    prints = [0, 1, 3, 1 << 20, (1 << 20) + 7, 12_345_678_901]
    table = lambda start: [(start + i, rng.choice(["a", "b", "c", "d", f"own{start + i}", None]), rng.choice(prints)) for i in range(120)]
    left, right = table(0), table(1_000)
    df = lambda rows: spark.createDataFrame(rows, "id long, sha string, print long")
    got = du.overlap_report(df(left), {"r": df(right)}, threshold=2)
    want = []
    for c, cs, cp in left:
        if same := [r for r, rs, _ in right if rs == cs and cs is not None]:
            want.append((c, "r", "EXACT", min(same), len(same)))
        for p in prints:
            if _apart(cp, p) <= 2 and (other := [r for r, rs, rp in right if rp == p and None not in (rs, cs) and rs != cs]):
                want.append((c, "r", "NEAR", min(other), len(other)))
    assert sorted((r.candidate, r.dataset, r.match_type, r.reference, r.references) for r in got.collect()) == sorted(want)


def _overlapping(rng, n: int, images: int):
    """Boxes that often overlap, of two classes; the first image holds a third of them."""
    at = lambda i: 0 if i % 3 == 0 else rng.randrange(1, images)
    return [(at(i), i, rng.choice(["a", "b"]), x := rng.randrange(90), y := rng.randrange(90), x + rng.randrange(15, 30), y + rng.randrange(15, 30)) for i in range(n)]


def test_best_targets_of_crowded_images_and_others(spark):
    rng = random.Random(72)
    truth = spark.createDataFrame([tuple(map(float, r[3:])) + r[:3] for r in _overlapping(rng, 400, 40)], "x1 double, y1 double, x2 double, y2 double, image_id long, gt int, class_name string")
    preds = spark.createDataFrame([tuple(map(float, r[3:])) + r[:3] for r in _overlapping(rng, 500, 60)], "x1 double, y1 double, x2 double, y2 double, image_id long, pred int, class_name string")
    got = [sorted(map(tuple, el.best_targets(truth, preds, ["class_name"], crowd).select("image_id", "pred", "class_name", "gt", "iou", "taken").collect()), key=str) for crowd in (0, 100, 10_000)]
    assert got[0] == got[1] == got[2]
    assert len(got[0]) == 500
    assert sum(r[5] is not None for r in got[0]) > 10
    # The rule, threshold by threshold, from the pairs.
    pairs = [tuple(r) for r in el.candidate_matches(truth, preds).collect()]
    want = set()
    for t in el.THRESHOLDS:
        best, first = {}, {}
        for image, gt, pred, iou in pairs:
            if iou >= t:
                best[image, pred] = min(best.get((image, pred), (0, 0)), (-iou, gt))
        for (image, pred), (_, gt) in best.items():
            first[image, gt] = min(first.get((image, gt), pred), pred)
        want |= {(image, t, pred, gt) for (image, gt), pred in first.items()}
    assert {tuple(r) for r in el.match_predictions(truth, preds).collect()} == want


def test_matches_shuffle_only_the_boxes(spark):
    from lanewise.plans.governance_queries import Datasets

    d = Datasets(spark, "/root/testdata/sf0.001")
    plan = el.match_predictions(d.truth, d.predictions)._jdf.queryExecution().executedPlan().toString()
    # Boxes are dealt by image when they get their numbers; ten thresholds, cells and ranks used to be four more shuffles.
    assert plan.count("Exchange hashpartitioning") == 2
    assert "Generate" not in plan.split("SortMergeJoin")[-1]
