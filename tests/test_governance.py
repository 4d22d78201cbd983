"""Checks of annotations, duplicates, splits, evaluation and sampling on small tables."""

import hashlib
import json
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from lanewise.functions.percentiles import exact_percentiles
from lanewise.operators import annotations as an
from lanewise.operators import diagnostics as dg
from lanewise.operators import duplicates as du
from lanewise.operators import evaluation as el
from lanewise.operators import manifests as mf
from lanewise.operators import sampling as sm
from lanewise.plans import governance_queries, manifest_queries
from lanewise.plans.derived import Scene, values


def test_normalized_boxes_first_issue_wins(spark, rows):
    text = "0 0.5 0.5 0.2 0.2\n0 0.5 0.5 0.2 0.2\n\n1 2\n9 0.5 0.5 0.1 0.1\n0 nan 0.5 0.1 0.1\n0 1.5 0.5 0.1 0.1\n0 0.5 0.5 0 0.1\n0 0.01 0.5 0.2 0.1\nx 1 1 1 1"
    lines = an.annotation_lines(spark.createDataFrame([("i", text)], "image_id string, text string"))
    got = [r[1] for r in sorted(rows(an.qa_normalized_boxes(lines, 3), "line_number", "issue"))]
    assert got == [None, "DUPLICATE_ANNOTATION", "BLANK_ROW", "INVALID_ROW_FORMAT", "INVALID_CLASS_ID", "INVALID_COORDINATES", "INVALID_COORDINATES", "INVALID_BOX_SIZE", "BOX_OUTSIDE_IMAGE", "INVALID_ROW_FORMAT"]


def test_license_evidence(spark, rows):
    page = '<script type="application/ld+json">{"@graph":[{"@type":"Person"},{"@type":"ImageObject","license":"L","acquireLicensePage":"A","contentUrl":"C","creator":{"name":"N"}}]}</script>'
    df = spark.createDataFrame([(1, page), (2, "<p>none</p>"), (3, None)], "page_id int, html string")
    assert rows(an.license_evidence(df), "page_id", "observed_license_url", "creator") == [(1, "L", "N"), (2, None, None), (3, None, None)]


def test_near_pairs_equal_brute_force(spark):
    rng = random.Random(1)
    base = [rng.getrandbits(64) - 2**63 for _ in range(20)]
    prints = [b ^ sum(1 << rng.randrange(63) for _ in range(rng.randrange(5))) for b in base for _ in range(6)]
    got = {(r.a, r.b, r.distance) for r in du.near_pairs(spark.createDataFrame([(p,) for p in prints], "print long"), 6).collect()}
    uniq = sorted(set(prints))
    want = {(a, b, ((a ^ b) & (2**64 - 1)).bit_count()) for i, a in enumerate(uniq) for b in uniq[i + 1 :] if ((a ^ b) & (2**64 - 1)).bit_count() <= 6}
    assert got == want


def test_prints_are_majorities_of_word_digests(spark, monkeypatch):
    rng = random.Random(2)
    texts = [None, "", "--- ...", "One", "one two two", "é-word x", *(" ".join(f"w{rng.randrange(300)}" for _ in range(n)) for n in (5, 64, 3000)), " ".join(map(str, range(20000)))]
    got = {r.i: r.print for r in spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", du.simhash("text").alias("print")).collect()}
    for i, text in enumerate(texts):
        digests = [int(hashlib.md5(w.encode()).hexdigest()[:16], 16) for w in re.split("[^A-Za-z0-9]+", text or "") if w]
        want = sum(1 << b for b in range(64) if 2 * sum(d >> b & 1 for d in digests) > len(digests))
        assert got[i] & (2**64 - 1) == want
    monkeypatch.setattr(du, "_VOTERS", 7)
    monkeypatch.setattr(du, "_DIGESTS", 10)
    assert [du._majority(t, {}) for t in texts[:-1]] == [got[i] for i in range(len(texts) - 1)]


def test_near_overlap_equals_brute_force(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(64) - 2**63 for _ in range(8)]
    near = lambda: [b ^ sum(1 << rng.randrange(63) for _ in range(rng.randrange(9))) for b in base for _ in range(5)]
    left, right = near(), near()
    got = du.near_overlap(*(spark.createDataFrame([(p,) for p in [*side, side[0], None]], "print long") for side in (left, right)), 6).collect()
    apart = lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count()
    assert sorted(map(tuple, got)) == sorted((a, b, apart(a, b)) for a in set(left) for b in set(right) if apart(a, b) <= 6)


def test_groups_never_cross_splits(spark, rows):
    data = spark.createDataFrame([(i, f"s{i % 7}", i % 11, None if i % 3 else f"g{i % 2}") for i in range(60)], "id long, sha string, print long, source_group string")
    groups = du.duplicate_groups(data, 0)
    split = du.group_split(groups, {"TRAIN": 0.6, "VAL": 0.2, "LOCKED_TEST": 0.2})
    assert rows(split.groupBy("group_root").agg(F.count_distinct("split").alias("n")).where("n > 1")) == []
    chain = du.connected(spark.createDataFrame([(i, i + 1) for i in range(40)], "x long, y long"), spark.range(45))
    assert {r.root for r in chain.where("id <= 40").collect()} == {0}
    assert rows(chain.where("id = 44"), "root") == [(44,)]


def test_overlap_is_the_only_use(spark):
    with pytest.raises(ValueError, match="only be used"):
        du.overlap_report(None, {}, purpose="training")


def test_matching_keeps_first_prediction(spark, rows):
    box = "x1 double, y1 double, x2 double, y2 double"
    truth = spark.createDataFrame([(1, 0, "car", 0.0, 0.0, 10.0, 10.0)], f"image_id int, gt int, class_name string, {box}")
    preds = spark.createDataFrame([(1, 0, "car", 0.4, 1.0, 0.0, 11.0, 10.0), (1, 1, "car", 0.9, 0.0, 0.0, 10.0, 10.0), (1, 2, "bus", 0.9, 0.0, 0.0, 10.0, 10.0)], f"image_id int, pred int, class_name string, conf double, {box}")
    got = rows(el.match_predictions(truth, preds).where("threshold in (0.5, 0.95)"), "threshold", "pred")
    assert got == [(0.5, 0), (0.95, 1)]
    names = values(spark, "class_name", [("'car'",), ("'truck'",)])
    metrics = {r.class_name: r for r in el.detection_metrics(truth, preds, names).collect()}
    assert metrics["truck"].map50 == 0
    assert metrics["car"].recall == 1.0


def test_promotion(spark, rows):
    m = [("before", "overall", "ALL", 0.5, 0.5, 0.5, 0.5), ("after", "overall", "ALL", 0.6, 0.4, 0.6, 0.6)]
    comparison = el.model_comparison(spark.createDataFrame(m, "model string, scope string, class_name string, precision double, recall double, map50 double, map50_95 double"), "before", "after")
    rule = lambda verdict, metric, least: ("1", f"'{verdict}'", "'overall'", "'ALL'", f"'{metric}'", least)
    decide = lambda *r: rows(el.promotion_decision(comparison, values(spark, "rule_no, verdict, scope, class_name, metric, least_delta", r)), "decision")
    assert decide(rule("HOLD", "recall", "-0.05D"), rule("REJECT", "recall", "-0.05D")) == [("REJECT",)]
    assert decide(rule("HOLD", "recall", "-0.05D")) == [("HOLD",)]
    assert decide(rule("HOLD", "map50", "0D")) == [("PROMOTE",)]
    with pytest.raises(Exception, match="missing comparison metric"):
        decide(rule("HOLD", "speed", "0D"))


def test_quality_and_contract(spark, rows):
    t = spark.createDataFrame([("v", 1, 0, "car", 0.5, 0.0, 0.0, 1.0, 1.0), ("v", 1, 0, "car", 0.5, 0.0, 0.0, 1.0, 1.0), ("v", 2, 0, "ufo", 1.5, 2.0, 0.0, 1.0, 1.0), ("v", 3, -1, "car", None, 0.0, 0.0, 1.0, 1.0)], "video_id string, track_id long, frame_index long, class_name string, confidence double, x1 double, y1 double, x2 double, y2 double")
    got = rows(dg.observation_quality(t, ("car",)), "track_id", "issue")
    assert got == [(1, "DUPLICATE_OBSERVATION"), (1, "DUPLICATE_OBSERVATION"), (2, "BAD_BOX"), (2, "BAD_CONFIDENCE"), (2, "UNKNOWN_CLASS"), (3, "BAD_CONFIDENCE"), (3, "NEGATIVE_ID")]
    with pytest.raises(ValueError, match="missing columns"):
        dg.require_columns(t, ("nope",), "tracks")
    a, b = (dg.table_fingerprint(x, ["track_id"], "track_id").first().fingerprint for x in (t, t.orderBy(F.desc("track_id"))))
    assert a == b


def brute_digest(lines, buckets):
    """Of (text that gives the bucket, line): sums of parts of each bucket's digests, hashed together."""
    sums: dict = {}
    for key, line in lines:
        sha = hashlib.sha256(line.encode()).hexdigest()
        s = sums.setdefault(zlib.crc32(key.encode()) % buckets, [0] * 5)
        for i, v in enumerate([1, *[int(sha[12 * j : 12 * j + 12], 16) for j in range(4)]]):
            s[i] += v
    return hashlib.sha256("|".join(sorted(":".join(map(str, (b, *s))) for b, s in sums.items())).encode()).hexdigest()


def test_registered_digests_depend_on_whole_texts(spark, tmp_path):
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    long = "word " * 5000
    said = []
    for last in ("a", "b"):
        table = [(i, f"text {i} \"q\" é") for i in range(300)] + [(300, long + last), (300, long + last)]
        spark.createDataFrame(table, "doc_id long, text string").write.parquet(str(tmp_path / last / "documents.parquet"))
        content = governance_queries.queries()["content_digest"](spark, str(tmp_path / last)).first()
        tree = manifest_queries.queries()["tree_digest"](spark, str(tmp_path / last)).first()
        lines = [(str(i), json.dumps({"doc_id": i, "text": t}, separators=(",", ":"), ensure_ascii=False)) for i, t in table]
        assert (content.fingerprint, content.rows) == (brute_digest(lines, 64), 302)
        lines = [f"{i}:{sha(t)}" for i, t in table]
        assert (tree.tree, tree.files) == (brute_digest([(x, x) for x in lines], 256), 302)
        said.append((content.fingerprint, tree.tree))
    assert all(a != b for a, b in zip(*said, strict=True))


def test_greedy_selection_and_leaders(spark, rows):
    f = spark.createDataFrame([("v", i, "uniform", float(i % 4)) for i in range(30)], "video_id string, frame_index long, sampling_method string, priority_score double")
    got = [r[1] for r in sorted(rows(sm.temporal_select(f, 5, 4, {"uniform": 1.0})))]
    assert len(got) == 5
    assert min(b - a for a, b in zip(got, got[1:], strict=False)) >= 4
    g = spark.createDataFrame([(0, "v", 0, "a", 0), (1, "v", 1, "b", 1), (2, "v", 2, "c", 3), (3, "v", 50, "d", 0), (4, "w", 0, "a", 9)], "candidate_id long, video_id string, frame_index long, sha string, print long")
    gaps = spark.createDataFrame([("v", 10), ("w", 10)], "video_id string, max_gap int")
    got = {r.candidate_id: r for r in sm.leader_groups(g, 1, gaps).collect()}
    names = [got[i].duplicate_group_id for i in range(5)]
    assert [names.index(n) for n in names] == [0, 0, 2, 3, 0]  # no chaining, no match beyond the window


def test_leader_groups_equal_a_sequential_model(spark):
    rng = random.Random(31)
    table = [(i, f"v{rng.randrange(3)}", rng.randrange(120), f"s{rng.randrange(60)}", rng.randrange(8)) for i in range(150)]
    gaps = {"v0": 3, "v1": 10, "v2": 25}
    groups, of_sha, leaders = [], {}, {}
    for c, v, f, sha, p in sorted(table, key=lambda r: (r[1], r[2], r[0])):
        at = of_sha.get(sha)
        if at is None:
            at = next((g for lf, g, lp in reversed(leaders.get(v, [])) if f - lf <= gaps[v] and (p ^ lp).bit_count() <= 1), None)
            if at is None:
                at = len(groups)
                groups.append([])
                leaders.setdefault(v, []).append((f, at, p))
            of_sha[sha] = at
        groups[at].append((c, sha))
    want = {}
    for n, members in enumerate(groups, 1):
        for c, sha in members:
            exact = sum(s == sha for _, s in members)
            want[c] = (f"V2_FRAME_DUP_{n:05d}", len(members), exact, "EXACT" if exact > 1 else "NEAR" if len(members) > 1 else "SINGLETON")
    df = spark.createDataFrame(table, "candidate_id long, video_id string, frame_index long, sha string, print long")
    got = {r[0]: tuple(r)[1:] for r in sm.leader_groups(df, 1, spark.createDataFrame(list(gaps.items()), "video_id string, max_gap int")).collect()}
    assert got == want


def test_balanced_choice_equals_a_sequential_model(spark):
    rng = random.Random(32)
    methods = {"density": 0.25, "occlusion": 0.25, "uniform": 0.5}
    table = [(f"v{v}", f, rng.choice(list(methods)), float(rng.randrange(6))) for v in range(4) for f in rng.sample(range(400), 250)]
    df = spark.createDataFrame(table, "video_id string, frame_index long, sampling_method string, priority_score double")
    for target, gap, shares in ((8, 5, methods), (5, 9, {"density": 0.0, "occlusion": 0.2, "uniform": 0.8})):
        want = set()
        for v in range(4):
            rows, taken = sorted((r for r in table if r[0] == f"v{v}"), key=lambda r: (-r[3], r[1])), []
            free = lambda f: all(abs(f - t) >= gap for t in taken)  # noqa: E731, B023
            for m in sorted(shares):
                got = 0
                for r in (r for r in rows if r[2] == m):
                    if free(r[1]):
                        taken.append(r[1])
                        got += 1
                    if got >= round(target * shares[m]):
                        break
            for r in rows:
                if len(taken) < target and free(r[1]):
                    taken.append(r[1])
            want |= {(f"v{v}", f) for f in taken}
        assert {(r.video_id, r.frame_index) for r in sm.temporal_select(df, target, gap, shares).collect()} == want


def test_keys_of_near_prints_are_few():
    rng = random.Random(33)
    for n in (1_000, 100_000):
        masks = du.block_masks(6, n)
        prints = [rng.getrandbits(64) for _ in range(1_000)]
        meeting = sum(sum((a & m) == (b & m) for m in masks) for a, b in zip(prints, prints[1:] + prints[:1], strict=True)) / 1_000
        assert meeting * n <= 3 * len(masks)  # chance candidates of a print among n
        for _ in range(200):
            a = rng.getrandbits(64)
            b = a
            for bit in rng.sample(range(64), 6):
                b ^= 1 << bit
            assert any((a & m) == (b & m) for m in masks)


def test_percentiles_equal_sorted_values(spark):
    import numpy as np

    rng = random.Random(34)
    table = [(g, v) for g, values in (("a", [rng.random() ** 6 for _ in range(700)]), ("b", [5.0] * 40 + [1.0]), ("c", [2.5]), (None, [1.0, 2.0]), ("d", [None, float("nan")])) for v in values]
    got = {r[0]: tuple(r)[1:] for r in exact_percentiles(spark.createDataFrame(table, "g string, v double"), "g", "v", {"p0": 0.0, "p10": 0.1, "p50": 0.5, "p100": 1.0}).collect()}
    assert set(got) == {"a", "b", "c", None}
    for g in got:
        assert got[g] == pytest.approx(np.quantile([v for h, v in table if h == g], [0, 0.1, 0.5, 1]))


def test_merges_are_checked(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b")], "k long, x string")
    assert sorted(map(tuple, mf.merge_checked(left, spark.createDataFrame([(2, 9)], "k long, y long"), "k").collect())) == [(1, "a", None), (2, "b", 9)]
    with pytest.raises(Exception, match="repeated key in the right table: 2"):
        mf.merge_checked(left, spark.createDataFrame([(2, 9), (2, 8)], "k long, y long"), "k").collect()
    with pytest.raises(ValueError, match="overlap"):
        du.usage_guard("training")


def test_event_table_scans_its_input_once(spark):
    plan = Scene(spark, "/root/testdata/sf0.001").events._jdf.queryExecution().executedPlan().toString()
    assert plan.count("events.parquet") <= 1  # the crossings; all other rules read the stored zone rows
