"""Choosing frames and candidates for review."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanewise.functions import grid
from lanewise.functions.geometry import box, overlap_smaller
from lanewise.functions.scan import running_sums
from lanewise.operators.storage import saved
from lanewise.operators.tracks import scene_dim

#: Fixed value: how groups of frames are named.
GROUP_PREFIX = "V2_FRAME_DUP_"


def ranked_frames(detections: DataFrame, reason: str, limit: int, class_name: str | None = None) -> DataFrame:
    """Each video's ``limit`` best frames by one of: low_confidence, density, smallest_box; one row for a frame."""
    density = F.count("*").over(Window.partitionBy("video_id", "frame_index"))
    area = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))
    rows = detections.withColumn("density", density).withColumn("area", area)
    if class_name:
        rows = rows.where(F.col("class_name") == class_name)
    score = {"low_confidence": F.col("confidence"), "density": -F.col("density").cast("double"), "smallest_box": F.col("area")}[reason]
    rows = rows.withColumn("score", score)
    one = F.row_number().over(Window.partitionBy("video_id", "frame_index").orderBy("score", "track_id"))
    rows = rows.withColumn("_n", one).where("_n = 1")
    place = F.row_number().over(Window.partitionBy("video_id").orderBy("score", "frame_index"))
    return rows.withColumn("place", place).where(F.col("place") <= limit).select("video_id", "frame_index", "place", "density", F.lit(reason).alias("reason"))


def uniform_frames(videos: DataFrame, n: int) -> DataFrame:
    """``n`` frames of each video at even distances, the last one included."""
    i = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    return videos.select("video_id", "frame_count", i.alias("i")).select("video_id", F.expr(f"i * (frame_count - 1) div {n - 1}").alias("frame_index")).distinct()


def review_samples(detections: DataFrame, videos: DataFrame, uniform: int = 12, targeted: int = 12) -> DataFrame:
    """Uniform frames and, of the others, the best targeted ones: low confidence, small boxes, then density."""
    even = uniform_frames(videos, uniform)
    lists = [ranked_frames(detections, r, targeted).withColumn("priority", F.lit(k)) for k, r in enumerate(("low_confidence", "smallest_box", "density"))]
    rest = lists[0].unionByName(lists[1]).unionByName(lists[2]).join(even, ["video_id", "frame_index"], "left_anti")
    one = F.row_number().over(Window.partitionBy("video_id", "frame_index").orderBy("priority", "place"))
    rest = rest.withColumn("_n", one).where("_n = 1")
    n = F.row_number().over(Window.partitionBy("video_id").orderBy("place", "priority", "frame_index"))
    rest = rest.withColumn("n", n).where(F.col("n") <= targeted)
    return even.withColumn("reason", F.lit("uniform")).unionByName(rest.select("video_id", "frame_index", "reason"))


def frame_features(tracks: DataFrame, overlap: float = 0.20, cell: float = 128.0) -> DataFrame:
    """Per frame: objects, persons, smallest area, whether any two boxes overlap enough, method and score.

    Boxes meet by grid cells of side ``cell``; ``overlap`` is above 0.
    """
    keys = ["video_id", "frame_index"]
    area = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))
    counts = tracks.groupBy(*keys).agg(F.count("*").alias("objects"), F.count_if(F.col("class_name") == "person").alias("persons"), F.min(area).alias("smallest"))
    side = lambda s: tracks.select(*keys, F.col("track_id").alias(f"{s}_id"), *[F.col(c).alias(f"{s}_{c}") for c in ("x1", "y1", "x2", "y2")])
    pairs = grid.meeting(side("t"), side("o"), keys, cell, "t_", "o_").where("t_id < o_id")
    close = pairs.where(overlap_smaller(box("t_"), box("o_")) >= overlap).select(*keys).distinct().withColumn("occluded", F.lit(True))
    out = counts.join(close, keys, "left").withColumn("occluded", F.coalesce("occluded", F.lit(False)))
    method = F.when(F.col("occluded"), "occlusion").when(F.col("objects") >= 5, "density").otherwise("uniform")
    return out.withColumn("sampling_method", method).withColumn("priority_score", (F.col("objects") + 2 * F.col("persons") + F.when(F.col("occluded"), 3).otherwise(0)).cast("double"))


def temporal_select(rows: DataFrame, target: int, gap: int, fractions: dict[str, float]) -> DataFrame:
    """Best frames of each scene under method quotas, at least ``gap`` frames apart.

    Of rows of one frame the one with the highest score counts, ties to the first method by
    name. Each choice depends on those before, but a taken frame rules out at most
    2 * gap - 1 frames: so of each method, and of all, only the first frames by score that
    can matter are looked at, a number that doesn't grow with the scene. ``rows``: video_id,
    frame_index, sampling_method, priority_score.
    """
    quotas = {m: round(target * share) for m, share in sorted(fractions.items())}
    enough = (sum(max(q, 1) for q in quotas.values()) + target) * (2 * gap - 1) + 1

    def pick(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["priority_score", "frame_index"], ascending=[False, True])
        taken: list[int] = []

        def free(f: int) -> bool:
            return all(abs(f - t) >= gap for t in taken)

        for method, quota in quotas.items():
            got = 0
            for f in group.loc[group.sampling_method == method, "frame_index"]:
                if free(f):
                    taken.append(f)
                    got += 1
                if got >= quota:
                    break
        for f in group.frame_index:
            if len(taken) >= target:
                break
            if free(f):
                taken.append(f)
        return group[group.frame_index.isin(taken)].sort_values("frame_index")

    rows = rows.select("video_id", "frame_index", "sampling_method", "priority_score")
    one = F.row_number().over(Window.partitionBy("video_id", "frame_index").orderBy(F.desc("priority_score"), "sampling_method"))
    single = rows.withColumn("_n", one).where("_n = 1").drop("_n")
    best = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("priority_score"), "frame_index"))
    few = single.withColumn("_m", best("video_id", "sampling_method")).where(F.col("_m") <= enough).unionByName(single.withColumn("_m", best("video_id")).where(F.col("_m") <= enough)).drop("_m").distinct()
    return few.groupBy("video_id").applyInPandas(pick, rows.schema)


def leader_groups(rows: DataFrame, threshold: int, gaps: DataFrame) -> DataFrame:
    """(candidate_id, duplicate_group_id, group_size, exact_duplicate_group_size, grouping_basis).

    Equal shas are one group anywhere; a near print joins the latest leader of its video
    within the video's largest gap of frames, and near rows don't chain. ``rows``:
    candidate_id, video_id, frame_index, sha, print; ``gaps``: video_id, max_gap.

    Equal shas are collapsed to their first row. A video is cut where neighbouring frames
    are further apart than its gap, as no leader reaches across; the cuts are dealt over tasks
    and streamed in the order of frames, with the leaders within the gap as the only state.
    """
    first = F.row_number().over(Window.partitionBy("sha").orderBy("video_id", "frame_index", "candidate_id"))
    heads = rows.withColumn("_n", first).where("_n = 1").select("candidate_id", "video_id", "frame_index", "sha", "print").join(scene_dim(gaps), "video_id")
    order = Window.partitionBy("video_id").orderBy("frame_index", "candidate_id")
    cut = F.coalesce((F.col("frame_index") - F.lag("frame_index").over(order) > F.col("max_gap")).cast("int"), F.lit(1))
    heads = heads.withColumn("island", F.sum(cut).over(order))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, leaders = None, deque()
        for b in batches:
            led = []
            for video, island, f, c, p, gap in zip(*(b[n].to_pylist() for n in ("video_id", "island", "frame_index", "candidate_id", "print", "max_gap")), strict=True):
                if now != (video, island):
                    now, leaders = (video, island), deque()
                while leaders and f - leaders[0][0] > gap:
                    leaders.popleft()
                found = next((lc for _, lc, lp in reversed(leaders) if ((p ^ lp) & (2**64 - 1)).bit_count() <= threshold), None)
                if found is None:
                    leaders.append((f, c, p))
                led.append(c if found is None else found)
            yield pa.RecordBatch.from_arrays([b["candidate_id"], pa.array(led, b["candidate_id"].type)], ["head", "leader"])

    kind = rows.schema["candidate_id"].dataType.simpleString()
    led = heads.repartition("video_id", "island").sortWithinPartitions("video_id", "island", "frame_index", "candidate_id").mapInArrow(walk, f"head {kind}, leader {kind}")
    led = saved(led, "leaders")  # one walk, whatever is made of it
    # Groups are numbered in the order of their leaders, over ranges of leaders.
    chosen = heads.join(led.where("head = leader"), F.col("candidate_id") == F.col("head")).select("leader", "video_id", "frame_index", "candidate_id", F.lit(1).cast("long").alias("one"))
    chosen = running_sums(chosen, [], [F.col("video_id"), F.col("frame_index"), F.col("candidate_id")], {"n": "one"})
    named = chosen.select("leader", F.format_string(f"{GROUP_PREFIX}%05d", F.col("n")).alias("duplicate_group_id"))
    # Sizes are counted by sha and by group before they meet the rows, so a hot sha is a row.
    shas = rows.groupBy("sha").agg(F.count("*").alias("exact_duplicate_group_size")).join(heads.select("sha", F.col("candidate_id").alias("head")), "sha").join(led, "head").join(named, "leader")
    sizes = shas.groupBy("duplicate_group_id").agg(F.sum("exact_duplicate_group_size").alias("group_size"))
    out = rows.select("candidate_id", "sha").join(shas.join(sizes, "duplicate_group_id"), "sha")
    basis = F.when(F.col("exact_duplicate_group_size") > 1, "EXACT").when(F.col("group_size") > 1, "NEAR").otherwise("SINGLETON")
    return out.select("candidate_id", "duplicate_group_id", "group_size", "exact_duplicate_group_size", basis.alias("grouping_basis"))


def duplicate_representatives(rows: DataFrame) -> DataFrame:
    """The best row of each group, with a reason for every row. ``rows``: candidate_id, duplicate_group_id, priority_score, frame_index."""
    n = F.row_number().over(Window.partitionBy("duplicate_group_id").orderBy(F.desc("priority_score"), "frame_index", "candidate_id"))
    reason = F.concat(F.when(n == 1, "DUPLICATE_GROUP_REPRESENTATIVE:").otherwise("DUPLICATE_REDUCED:"), F.col("duplicate_group_id").cast("string"))
    return rows.withColumn("selected", n == 1).withColumn("reason", reason)


def seeded(seed: int, *columns: str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *columns))


def pilot_selection(profiles: DataFrame, limit: int, seed: int) -> DataFrame:
    """The first ``limit`` candidates by rare context, traffic, capped hardness, then a seeded order."""
    rare = F.when(F.col("context_tags").rlike("PERSON_(BUS|TRUCK|MOTORCYCLE|BICYCLE)"), 0).otherwise(1)
    hard = F.least(F.col("small_person_count") + F.col("occluded_person_count"), F.lit(3))
    return profiles.where("candidate_status = 'ELIGIBLE'").orderBy(rare, F.desc("traffic_box_count"), F.desc(hard), seeded(seed, "image_id"), "image_id").limit(limit)


#: Frames of a bucket in which frames meet ranges.
BUCKET_FRAMES = 256


def merged_ranges(ranges: DataFrame) -> DataFrame:
    """(video_id, start_frame, end_frame): what inclusive ranges cover, as ranges that neither overlap nor touch. Ranges that end before they start cover nothing."""
    w = Window.partitionBy("video_id").orderBy("start_frame", "end_frame")
    before = F.max("end_frame").over(w.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.coalesce((F.col("start_frame") > before + 1).cast("int"), F.lit(1))
    islands = ranges.where("start_frame <= end_frame").select("video_id", "start_frame", "end_frame").withColumn("_new", begins).withColumn("_n", F.sum("_new").over(w))
    return islands.groupBy("video_id", "_n").agg(F.min("start_frame").alias("start_frame"), F.max("end_frame").alias("end_frame")).drop("_n")


def bucketed_ranges(ranges: DataFrame, bucket: int = BUCKET_FRAMES) -> DataFrame:
    """(video_id, bucket_, lo_, hi_): merged ranges cut at the ends of buckets of frames."""
    number = lambda c: F.floor(F.col(c) / bucket).cast("long")
    cut = merged_ranges(ranges).withColumn("bucket_", F.explode(F.sequence(number("start_frame"), number("end_frame"))))
    return cut.select("video_id", "bucket_", F.greatest(F.col("start_frame"), F.col("bucket_") * bucket).alias("lo_"), F.least(F.col("end_frame"), (F.col("bucket_") + 1) * bucket - 1).alias("hi_"))


def exclude_ranges(frames: DataFrame, ranges: DataFrame, bucket: int = BUCKET_FRAMES) -> DataFrame:
    """Frames outside every inclusive range of their video. ``ranges``: video_id, start_frame, end_frame.

    Frames and ranges meet by video and bucket of frames, in an equality join, so a video with
    very many ranges is spread over tasks and a frame is held against the few merged ranges of its bucket.
    Rows without a video or a frame lie in no range.
    """
    inside = bucketed_ranges(ranges, bucket).withColumnRenamed("video_id", "video_")
    keyed = frames.withColumn("bucket_of_", F.floor(F.col("frame_index") / bucket).cast("long"))
    met = (F.col("video_id") == F.col("video_")) & (F.col("bucket_of_") == F.col("bucket_")) & F.col("frame_index").between(F.col("lo_"), F.col("hi_"))
    return keyed.join(inside, met, "left_anti").drop("bucket_of_")


def previews_per_class(boxes: DataFrame, n: int) -> DataFrame:
    images = boxes.select("class_name", "image_id").distinct()
    place = F.row_number().over(Window.partitionBy("class_name").orderBy("image_id"))
    return images.withColumn("place", place).where(F.col("place") <= n)


def selection_report(selected: DataFrame) -> DataFrame:
    """(section, name, value): selected frames by scene, method and tag, and the smallest distance between neighbours of each scene.

    ``selected``: video_id, frame_index, sampling_method, tags array.
    """
    count = lambda section, names: names.groupBy("name").agg(F.count("*").alias("value")).select(F.lit(section).alias("section"), "name", "value")
    named = lambda c: selected.select(F.col(c).alias("name"))
    d = F.col("frame_index") - F.lag("frame_index").over(Window.partitionBy("video_id").orderBy("frame_index"))
    gaps = selected.withColumn("d", d).groupBy(F.col("video_id").alias("name")).agg(F.min("d").alias("value")).select(F.lit("smallest_gap").alias("section"), "name", "value")
    return count("scene", named("video_id")).unionByName(count("method", named("sampling_method"))).unionByName(count("tag", selected.select(F.explode("tags").alias("name")))).unionByName(gaps)
