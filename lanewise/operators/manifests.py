"""Checks and selections over manifests: images, models, ranges, candidates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanewise.functions.labels import OTHER_TITLE, RARE_TAGS, TRAFFIC_TITLE, title_pattern
from lanewise.operators.annotations import first_issue
from lanewise.operators.sampling import duplicate_representatives, seeded, temporal_select
from lanewise.operators.tracks import scene_dim


def valid_box(width, height):
    """A finite pixel box with area inside its image; columns x1, y1, x2, y2."""
    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    total = x1 + y1 + x2 + y2
    return F.coalesce(~F.isnan(total) & (F.abs(total) != float("inf")) & (x1 >= 0) & (y1 >= 0) & (x2 > x1) & (y2 > y1) & (x2 <= width) & (y2 <= height), F.lit(False))


def resolve_classes(catalog: DataFrame, targets: DataFrame) -> DataFrame:
    """(display_name, class_id, status): each target's source id; MISSING or AMBIGUOUS where there isn't exactly one."""
    found = catalog.groupBy("display_name").agg(F.count_distinct("class_id").alias("n"), F.min("class_id").alias("class_id"))
    out = targets.join(found, "display_name", "left")
    status = F.when(F.col("n").isNull(), "MISSING").when(F.col("n") > 1, "AMBIGUOUS").otherwise("RESOLVED")
    return out.select("display_name", F.when(status == "RESOLVED", F.col("class_id")).alias("class_id"), status.alias("status"))


def annotation_audit(images: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: images with and without label files, labels without images, and the dataset's suitability. Both have a stem."""
    j = images.select("stem").distinct().withColumn("i", F.lit(1)).join(labels.select("stem").distinct().withColumn("l", F.lit(1)), "stem", "full")
    out = j.agg(F.count_if(F.col("i").isNotNull() & F.col("l").isNotNull()).alias("paired"), F.count_if(F.col("l").isNull()).alias("images_only"), F.count_if(F.col("i").isNull()).alias("labels_only"))
    gate = F.when(F.col("paired") == 0, "NO_ANNOTATIONS").when(F.col("images_only") + F.col("labels_only") > 0, "PARTIALLY_PAIRED").otherwise("DETECTION_CANDIDATE")
    return out.withColumn("suitability", gate)


def image_coverage(images: DataFrame) -> DataFrame:
    return images.groupBy("category", "time_of_day", "disposition").agg(F.count("*").alias("images"))


def resolution_issues(images: DataFrame, width: int, height: int) -> DataFrame:
    """(image_id, issue): unreadable images and ones of another size."""
    found = F.array_compact(F.array(F.when(~F.col("readable"), "UNREADABLE_IMAGE"), F.when(F.col("readable") & ((F.col("width") != width) | (F.col("height") != height)), "NON_STANDARD_RESOLUTION")))
    return images.select("image_id", F.explode(found).alias("issue"))


def pool_report(pool: DataFrame) -> DataFrame:
    """Images and boxes by split, source and class, and totals at each level. ``pool``: split, source, class_name, image_id."""
    out = pool.groupingSets([["split", "source", "class_name"], ["split", "source"], ["split"], []], "split", "source", "class_name").agg(F.count_distinct("image_id").alias("images"), F.count("*").alias("boxes"))
    return out.select(*[F.coalesce(c, F.lit("ALL")).alias(c) for c in ("split", "source", "class_name")], "images", "boxes")


def decode_labels(boxes: DataFrame) -> DataFrame:
    """Normalised labels (xc, yc, wn, hn, width, height) to pixel corners."""
    half_w, half_h = F.col("wn") * F.col("width") / 2, F.col("hn") * F.col("height") / 2
    cx, cy = F.col("xc") * F.col("width"), F.col("yc") * F.col("height")
    return boxes.withColumns({"x1": cx - half_w, "y1": cy - half_h, "x2": cx + half_w, "y2": cy + half_h})


def canonical_predictions(predictions: DataFrame, names: DataFrame) -> DataFrame:
    """Predictions with shared class ids by name; other classes are dropped. ``names``: model_class, class_id."""
    return predictions.join(F.broadcast(names) if names.isLocal() else names, "model_class")


def model_manifest_check(manifests: DataFrame, required: tuple[str, ...], forbidden: tuple[str, ...]) -> DataFrame:
    """(model, issue) of manifests of (model, status, entries map): missing keys, forbidden splits in training data, status other than COMPLETE."""
    keys = F.map_keys("entries")
    issues = [F.when(~F.array_contains(keys, k), f"MISSING_{k.upper()}") for k in required]
    issues += [F.when(F.contains(F.coalesce(F.element_at("entries", "train_splits"), F.lit("")), F.lit(s)), f"FORBIDDEN_{s}") for s in forbidden]
    issues.append(F.when(F.col("status") != "COMPLETE", "NOT_COMPLETE"))
    return manifests.select("model", F.explode(F.array_compact(F.array(*issues))).alias("issue"))


def controlled_validation(cases: DataFrame) -> DataFrame:
    """One row: cases, and those whose observed result is the expected one."""
    return cases.agg(F.count("*").alias("cases"), F.count_if(F.col("expected").eqNullSafe(F.col("observed"))).alias("passed"))


def evaluation_ranges_check(ranges: DataFrame, videos: DataFrame) -> DataFrame:
    """(video_id, issue): ranges of unknown videos, reversed or beyond the end; videos without a range."""
    j = ranges.join(videos.select("video_id", "frame_count"), "video_id", "left")
    bad = j.withColumn("issue", first_issue([("UNKNOWN_VIDEO", F.col("frame_count").isNull()), ("REVERSED_RANGE", F.col("start_frame") > F.col("end_frame")), ("BEYOND_VIDEO", (F.col("start_frame") < 0) | (F.col("end_frame") >= F.col("frame_count")))])).where("issue is not null")
    free = videos.join(ranges, "video_id", "left_anti").select("video_id", F.lit("NOT_COVERED").alias("issue"))
    return bad.select("video_id", "issue").unionByName(free)


def review_row_check(rows: DataFrame, results: tuple[str, ...]) -> DataFrame:
    """(review_id, issue): results that aren't allowed, and misses that name a class."""
    issue = first_issue([("INVALID_RESULT", ~F.col("review_result").isin(*results)), ("CLASS_ON_FALSE_NEGATIVE", (F.col("review_result") == "FALSE_NEGATIVE") & F.col("class_name").isNotNull())])
    return rows.withColumn("issue", issue).where("issue is not null").select("review_id", "issue")


def final_selection(candidates: DataFrame, target: int, gap: int, fractions: dict[str, float], least_sharpness: float) -> DataFrame:
    """(candidate_id, selection_status, selection_reason) of every candidate.

    Of each duplicate group the representative goes on, if it is sharp enough; each scene's
    balanced selection then chooses. ``candidates``: candidate_id, video_id, frame_index,
    duplicate_group_id, priority_score, sampling_method, sharpness; a frame of a video is one candidate.
    """
    judged = duplicate_representatives(candidates)
    sharp = F.col("sharpness") >= least_sharpness
    chosen = temporal_select(judged.where(F.col("selected") & sharp), target, gap, fractions).select("video_id", "frame_index").withColumn("c", F.lit(True))
    rows = judged.join(chosen, ["video_id", "frame_index"], "left")
    outcome = (
        F.when(~F.col("selected"), F.struct(F.lit("REJECTED_NEAR_DUPLICATE").alias("s"), F.col("reason").alias("r")))
        .when(~sharp, F.struct(F.lit("REJECTED_LOW_SHARPNESS").alias("s"), F.lit(f"LAPLACIAN_VARIANCE_LT_{least_sharpness:g}").alias("r")))
        .when(F.col("c").isNotNull(), F.struct(F.lit("SELECTED_FOR_ANNOTATION").alias("s"), F.lit("COVERAGE_BALANCED_DUPLICATE_REPRESENTATIVE").alias("r")))
        .otherwise(F.struct(F.lit("NOT_SELECTED_BALANCE").alias("s"), F.lit("FINAL_SCENE_METHOD_BALANCE").alias("r")))
    )
    return rows.withColumn("o", outcome).select("candidate_id", F.col("o.s").alias("selection_status"), F.col("o.r").alias("selection_reason"))


def candidate_check(candidates: DataFrame, ranges: DataFrame, allowed_tags: tuple[str, ...], methods: tuple[str, ...], required: tuple[str, ...]) -> DataFrame:
    """(candidate_id, issue): the first of repeated ids, frames in excluded ranges, unknown tags or methods, a status other than NOT_ANNOTATED, and empty required fields.

    ``candidates``: candidate_id, video_id, frame_index, tags array, sampling_method,
    annotation_status and ``required``; ``ranges``: video_id, start_frame, end_frame, both included.
    """
    n = F.count("*").over(Window.partitionBy("candidate_id"))
    closed = ranges.groupBy("video_id").agg(F.collect_list(F.struct("start_frame", "end_frame")).alias("ranges"))
    rows = candidates.withColumn("n", n).join(scene_dim(closed), "video_id", "left")
    excluded = F.coalesce(F.exists("ranges", lambda r: F.col("frame_index").between(r["start_frame"], r["end_frame"])), F.lit(False))
    empty = reduce(Column.__or__, [F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == "" for c in required])
    rules = [("DUPLICATE_CANDIDATE", F.col("n") > 1), ("EXCLUDED_RANGE", excluded), ("UNKNOWN_TAG", F.size(F.array_except("tags", F.array(*map(F.lit, allowed_tags)))) > 0)]
    rules += [("UNKNOWN_METHOD", ~F.col("sampling_method").isin(*methods)), ("ALREADY_ANNOTATED", F.col("annotation_status") != "NOT_ANNOTATED"), ("MISSING_FIELD", empty)]
    return rows.withColumn("issue", first_issue(rules)).where("issue is not null").select("candidate_id", "issue")


def review_score() -> Column:
    """How much a candidate helps: rare contexts, hard persons and the title. Columns: context_tags, small_person_count, occluded_person_count, title."""
    tags, title = F.split(F.coalesce("context_tags", F.lit("")), ";"), F.coalesce("title", F.lit(""))
    has = lambda *names: F.arrays_overlap(tags, F.array(*map(F.lit, names))).cast("int")
    context = 4 * has("PERSON_MOTORCYCLE") + 4 * has("PERSON_BICYCLE") + 3 * has("PERSON_MULTI_TRAFFIC") + 2 * has("PERSON_BUS", "PERSON_TRUCK")
    hard = F.least(F.coalesce("small_person_count", F.lit(0)), F.lit(4)) + F.least(F.coalesce("occluded_person_count", F.lit(0)), F.lit(3))
    return context + hard + 2 * title.rlike(title_pattern(TRAFFIC_TITLE)).cast("int") - 8 * title.rlike(title_pattern(OTHER_TITLE)).cast("int")


def review_candidates(rows: DataFrame, limit: int, seed: int) -> DataFrame:
    """The first ``limit`` candidates with a traffic context: forced ones, then by score, then by a seeded order."""
    wanted = F.arrays_overlap(F.split(F.coalesce("context_tags", F.lit("")), ";"), F.array(*map(F.lit, (*RARE_TAGS, "PERSON_CAR"))))
    return rows.where(wanted).withColumn("score", review_score()).orderBy(F.desc("forced"), F.desc("score"), seeded(seed, "image_id"), "image_id").limit(limit)


def merge_checked(left: DataFrame, right: DataFrame, key: str, unique_left: bool = True) -> DataFrame:
    """``left`` with the columns of ``right``; an error if ``right`` repeats a key, or ``left`` does where it must not.

    The checks are aggregates of keys that run with the join: a repeated key fails the query.
    """
    n = F.count("*").over(Window.partitionBy(key))
    once = lambda df, side: df.withColumn("_n", n).withColumn("_ok", F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit(f"repeated key in the {side} table: "), F.col(key).cast("string")))).cast("boolean")).where("_ok is null").drop("_n", "_ok")
    return (once(left, "left") if unique_left else left).join(once(right, "right"), key, "left")


def manifest_map(annotations: DataFrame, manifest: DataFrame) -> DataFrame:
    """Annotations with the split and group of their image, one row each; an image that the manifest lacks is UNASSIGNED."""
    out = merge_checked(annotations, manifest.select("image_id", "split", "group_id"), "image_id", unique_left=False)
    return out.withColumn("split", F.coalesce("split", F.lit("UNASSIGNED")))


def map_classes(rows: DataFrame, mapping: DataFrame) -> DataFrame:
    """Rows with application class and disposition by source and source class; UNMAPPED without a class where the mapping has none. ``mapping``: source, source_class, class_name, disposition."""
    out = rows.join(scene_dim(mapping), ["source", "source_class"], "left")
    return out.withColumn("disposition", F.coalesce("disposition", F.lit("UNMAPPED")))


def pilot_check(pilot: DataFrame, expected: int) -> DataFrame:
    """One row: size, distinct images, rows with missing fields, and PASS or FAIL."""
    out = pilot.agg(F.count("*").alias("size"), F.count_distinct("image_id").alias("distinct_images"), F.count_if(F.col("image_id").isNull() | F.col("context_tags").isNull()).alias("missing_fields"))
    return out.withColumn("status", F.when((F.col("size") == expected) & (F.col("distinct_images") == expected) & (F.col("missing_fields") == 0), "PASS").otherwise("FAIL"))
