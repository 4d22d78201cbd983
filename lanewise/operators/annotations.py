"""Checks of annotation rows and coverage reports over datasets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanewise.functions.geometry import size_bin
from lanewise.functions.labels import OTHER_TITLE, TRAFFIC_TITLE, context_tags, rare_tags, title_pattern
from lanewise.functions.percentiles import exact_percentiles
from lanewise.operators.tracks import scene_dim


def first_issue(rules: list[tuple[str, Column]]) -> Column:
    """The name of the first rule that fails (its condition holds), null if none does."""
    out = F.lit(None).cast("string")
    for name, failing in reversed(rules):
        out = F.when(F.coalesce(failing, F.lit(True)), name).otherwise(out)
    return out


def annotation_lines(files: DataFrame, id_col: str = "image_id", text_col: str = "text") -> DataFrame:
    """(image_id, line_number, raw): the lines of label files, from 1."""
    return files.select(id_col, F.posexplode(F.split(text_col, r"\r\n|\n|\r")).alias("p", "raw")).select(id_col, (F.col("p") + 1).alias("line_number"), "raw")


def _marked_duplicates(rows: DataFrame, key: list[str]) -> DataFrame:
    """Among rows without an issue, all but the first of equal ones get DUPLICATE_ANNOTATION."""
    n = F.row_number().over(Window.partitionBy("image_id", F.col("issue").isNull(), *key).orderBy("line_number"))
    return rows.withColumn("issue", F.when(F.col("issue").isNull() & (n > 1), "DUPLICATE_ANNOTATION").otherwise(F.col("issue")))


def qa_normalized_boxes(lines: DataFrame, class_count: int) -> DataFrame:
    """Rows ``class x y w h`` in [0, 1] with their first issue; exact repeats count among otherwise good rows."""
    parts = F.split(F.trim(F.regexp_replace("raw", r"\s+", " ")), " ")
    rows = lines.withColumn("parts", parts).withColumns({"class_id": F.get("parts", F.lit(0)).try_cast("int"), **{c: F.get("parts", F.lit(i)).try_cast("double") for i, c in enumerate("xywh", 1)}})
    x, y, w, h = (F.col(c) for c in "xywh")
    finite = F.lit(True)
    for c in (x, y, w, h):
        finite = finite & ~F.isnan(c) & (F.abs(c) != float("inf"))
    rows = rows.withColumn(
        "issue",
        first_issue(
            [
                ("BLANK_ROW", F.trim("raw") == ""),
                ("INVALID_ROW_FORMAT", (F.size("parts") != 5) | F.col("class_id").isNull() | x.isNull() | y.isNull() | w.isNull() | h.isNull()),
                ("INVALID_CLASS_ID", ~F.col("class_id").between(0, class_count - 1)),
                ("INVALID_COORDINATES", ~finite | ~x.between(0, 1) | ~y.between(0, 1)),
                ("INVALID_BOX_SIZE", (w <= 0) | (h <= 0) | (w > 1) | (h > 1)),
                ("BOX_OUTSIDE_IMAGE", (x - w / 2 < -1e-6) | (x + w / 2 > 1 + 1e-6) | (y - h / 2 < -1e-6) | (y + h / 2 > 1 + 1e-6)),
            ]
        ),
    )
    return _marked_duplicates(rows, ["class_id", *[F.round(c, 9) for c in "xywh"]]).drop("parts")


def qa_pixel_boxes(lines: DataFrame, sizes: DataFrame, classes: tuple[int, ...]) -> DataFrame:
    """Rows ``left,top,w,h,score,class,truncation,occlusion`` with their first issue. ``sizes``: image_id, width, height. Blank rows are left out."""
    text = F.regexp_replace(F.trim("raw"), ",+$", "")
    names = ("left", "top", "w", "h", "score", "class_id", "truncation", "occlusion")
    rows = lines.withColumn("parts", F.split(text, ",")).where(text != "").join(sizes, "image_id", "left")
    rows = rows.withColumns({c: F.trim(F.get("parts", F.lit(i))).try_cast("double" if i < 4 else "int") for i, c in enumerate(names)})
    left, top, w, h = (F.col(c) for c in names[:4])
    rows = rows.withColumn(
        "issue",
        first_issue(
            [
                ("MALFORMED_ROW", (F.size("parts") != 8) | F.greatest(*[F.col(c).isNull() for c in names])),
                ("INVALID_BBOX", F.isnan(left + top + w + h) | (F.abs(left + top + w + h) == float("inf"))),
                ("INVALID_CLASS_ID", ~F.col("class_id").isin(*classes)),
                ("INVALID_SCORE", ~F.col("score").isin(0, 1)),
                ("INVALID_BBOX_SIZE", (w <= 0) | (h <= 0)),
                ("BBOX_OUTSIDE_IMAGE", (left < 0) | (top < 0) | (left + w > F.col("width")) | (top + h > F.col("height"))),
                ("INVALID_TRUNCATION", ~F.col("truncation").isin(0, 1)),
                ("INVALID_OCCLUSION", ~F.col("occlusion").isin(0, 1, 2)),
            ]
        ),
    )
    return _marked_duplicates(rows, list(names)).drop("parts")


def qa_attributed_boxes(boxes: DataFrame, mapping: DataFrame) -> DataFrame:
    """Corner boxes with five flags of -1, 0 or 1, with application class and first issue. ``mapping``: source_class, class_name."""
    rows = boxes.join(scene_dim(mapping), "source_class", "left")
    c = [F.col(x) for x in ("xmin", "xmax", "ymin", "ymax")]
    flags = F.lit(False)
    for f in ("is_occluded", "is_truncated", "is_group_of", "is_depiction", "is_inside"):
        flags = flags | ~F.col(f).isin(-1, 0, 1)
    bounds = (c[0] >= 0) & (c[0] < c[1]) & (c[1] <= 1) & (c[2] >= 0) & (c[2] < c[3]) & (c[3] <= 1)
    issue = first_issue([("UNMAPPED_CLASS", F.col("class_name").isNull()), ("INVALID_BOUNDS", F.isnan(c[0] + c[1] + c[2] + c[3]) | ~bounds), ("INVALID_ATTRIBUTE", flags)])
    return rows.withColumn("issue", issue).withColumn("box_status", F.when(F.col("is_depiction") == 1, "EXCLUDED_DEPICTION").when(F.col("is_group_of") == 1, "EXCLUDED_GROUP_OF").otherwise("ELIGIBLE"))


def candidate_profile(boxes: DataFrame) -> DataFrame:
    """Per image: person and traffic boxes, small and occluded persons, tags and status, from checked boxes."""
    ok = F.col("box_status") == "ELIGIBLE"
    person, traffic = ok & (F.col("class_name") == "person"), ok & F.col("class_name").isin("bicycle", "car", "motorcycle", "bus", "truck")
    small = (F.col("xmax") - F.col("xmin")) * (F.col("ymax") - F.col("ymin")) < 0.01
    out = boxes.groupBy("image_id").agg(
        F.array_sort(F.collect_set(F.when(ok, F.col("class_name")))).alias("classes"),
        F.count_if(person).alias("person_box_count"),
        F.count_if(traffic).alias("traffic_box_count"),
        F.count_if(person & small).alias("small_person_count"),
        F.count_if(person & (F.col("is_occluded") == 1)).alias("occluded_person_count"),
    )
    out = out.withColumn("context_tags", F.array_join(context_tags(F.col("classes")), ";")).withColumn("candidate_status", F.when(F.col("person_box_count") > 0, "ELIGIBLE").otherwise("EXCLUDED_NO_ELIGIBLE_PERSON"))
    return out.withColumn("application_classes", F.array_join("classes", ";")).drop("classes")


def normalize_boxes(boxes: DataFrame) -> DataFrame:
    """Pixel boxes to normalised centre, size and area."""
    w, h = F.col("w") / F.col("width"), F.col("h") / F.col("height")
    return boxes.withColumns({"xc": (F.col("left") + F.col("w") / 2) / F.col("width"), "yc": (F.col("top") + F.col("h") / 2) / F.col("height"), "wn": w, "hn": h, "area": w * h})


def inventory(images: DataFrame, labels: DataFrame, issues: DataFrame) -> DataFrame:
    """One row for each image or label: annotation count, sorted distinct reasons, status. ``images``: image_id; ``labels``: image_id, annotations; ``issues``: image_id, issue."""
    out = images.select("image_id").withColumn("has_image", F.lit(True)).join(labels.select("image_id", "annotations").withColumn("has_label", F.lit(True)), "image_id", "full")
    reasons = issues.where("issue is not null").groupBy("image_id").agg(F.collect_set("issue").alias("found"))
    out = out.join(reasons, "image_id", "left")
    found = F.concat(F.coalesce("found", F.array().cast("array<string>")), F.array_compact(F.array(F.when(F.col("has_image").isNull(), "MISSING_IMAGE"), F.when(F.col("has_label").isNull(), "MISSING_LABEL"))))
    out = out.withColumn("exclusion_reason", F.array_join(F.array_sort(found), ";"))
    return out.select("image_id", F.coalesce("annotations", F.lit(0)).alias("annotations"), "exclusion_reason", F.when(F.col("exclusion_reason") == "", "PASS").otherwise("EXCLUDED").alias("qa_status"))


def class_coverage(boxes: DataFrame, classes: DataFrame, splits: DataFrame) -> DataFrame:
    """Images and boxes for each split and class, with rows of zeros. Both dims are lists of names."""
    grid = scene_dim(splits).crossJoin(scene_dim(classes))
    seen = boxes.groupBy("split", "class_name").agg(F.count_distinct("image_id").alias("images"), F.count("*").alias("boxes"))
    return grid.join(seen, ["split", "class_name"], "left").fillna(0, ["images", "boxes"])


def size_distribution(boxes: DataFrame) -> DataFrame:
    """Boxes by class and size bin, and their percentage within the class. ``boxes``: class_name, area."""
    out = boxes.groupBy("class_name", size_bin(F.col("area")).alias("size_bin")).agg(F.count("*").alias("boxes"))
    return out.withColumn("percentage", F.round(100.0 * F.col("boxes") / F.sum("boxes").over(Window.partitionBy("class_name")), 6))


def occlusion_distribution(boxes: DataFrame) -> DataFrame:
    label = F.element_at(F.array(*map(F.lit, ("NONE", "PARTIAL", "HEAVY"))), F.col("occlusion") + 1)
    return boxes.groupBy("class_name", size_bin(F.col("area")).alias("size_bin"), label.alias("occlusion"), F.when(F.col("truncation") == 1, "PARTIAL").otherwise("NONE").alias("truncation")).agg(F.count("*").alias("boxes"))


def attribute_distribution(boxes: DataFrame) -> DataFrame:
    """Boxes by class with sums of the occluded and truncated flags; -1 counts as -1."""
    return boxes.groupBy("class_name").agg(F.count("*").alias("boxes"), F.sum("is_occluded").alias("occluded"), F.sum("is_truncated").alias("truncated"))


def context_distribution(profiles: DataFrame) -> DataFrame:
    """Images for each tag."""
    tags = profiles.select("image_id", F.explode(F.split("context_tags", ";")).alias("tag")).where("tag <> ''")
    return tags.groupBy("tag").agg(F.count_distinct("image_id").alias("images"))


def area_profile(boxes: DataFrame) -> DataFrame:
    """One row: smallest, p10, median, p90 and largest area, and boxes in each bin."""
    out = boxes.agg(F.min("area").alias("smallest"), F.max("area").alias("largest"), F.count_if(F.col("area") < 0.01).alias("small"), F.count_if((F.col("area") >= 0.01) & (F.col("area") < 0.09)).alias("medium"), F.count_if(F.col("area") >= 0.09).alias("large"))
    q = exact_percentiles(boxes.select(F.lit("ALL").alias("scope"), "area"), "scope", "area", {"p10": 0.1, "median": 0.5, "p90": 0.9})
    return out.crossJoin(q.drop("scope")).select(*[F.round(c, 9).alias(c) for c in ("smallest", "largest", "p10", "median", "p90")], "small", "medium", "large")


def sequence_groups(images: DataFrame) -> DataFrame:
    return images.groupBy("sequence").agg(F.count("*").alias("images"), F.min("image_id").alias("first_id"), F.max("image_id").alias("last_id"))


def qa_acceptance(issues: DataFrame, critical: tuple[str, ...], overlap: DataFrame) -> DataFrame:
    """One row: REJECT if any critical issue or overlapping row exists."""
    found = issues.agg(F.count_if(F.col("issue").isin(*critical)).alias("critical_issues")).crossJoin(overlap.agg(F.count("*").alias("overlaps")))
    return found.withColumn("decision", F.when((F.col("critical_issues") > 0) | (F.col("overlaps") > 0), "REJECT").otherwise("ACCEPT"))


def image_class_pivot(boxes: DataFrame, classes: list[str]) -> DataFrame:
    """Boxes of each class for each image, zeros where absent."""
    return boxes.groupBy("image_id").pivot("class_name", classes).agg(F.count(F.lit(1))).fillna(0)


def license_review(rows: DataFrame, allowed: str) -> DataFrame:
    """Verdict by metadata, page status and page evidence; the first failing check wins.

    Columns: image_id, license_reference, original_url, author, license_url, http_status,
    observed_license_url, acquire_license_page, content_url.
    """
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    missing = blank("image_id") | blank("license_reference") | blank("original_url") | blank("author") | blank("license_url")
    page = lambda c: F.rtrim(F.coalesce(F.col(c), F.lit("")), F.lit("/"))
    photo = F.regexp_extract(page("license_reference"), r"/photos/[^/]+/(\d+)", 1)
    verdict = (
        F.when(missing, "MISSING_LICENSE_METADATA")
        .when(F.col("http_status") != 200, "REQUIRES_REVIEW")
        .when((F.col("license_url") != allowed) | (F.coalesce(F.col("observed_license_url"), F.lit("")) != allowed), "REJECTED")
        .when(page("acquire_license_page") != page("license_reference"), "REQUIRES_REVIEW")
        .when((photo == "") | ~F.contains(F.coalesce(F.col("content_url"), F.lit("")), photo), "REQUIRES_REVIEW")
        .otherwise("LICENSE_APPROVED")
    )
    return rows.withColumn("license_review_status", verdict)


def license_evidence(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """License, acquire page, content URL and creator of the first image object with a license in a page's JSON-LD.

    Objects at the top level, in a top-level array and in ``@graph`` are looked at, in page order.
    """
    scripts = F.regexp_extract_all(F.coalesce(F.col(html_col), F.lit("")), F.lit(r'(?is)<script[^>]*type="application/ld\+json"[^>]*>(.*?)</script>'), 1)
    kind = "array<struct<`@type`:string,license:string,acquireLicensePage:string,contentUrl:string,creator:struct<name:string>>>"
    nodes = lambda s: F.concat(
        F.coalesce(F.from_json(s, kind), F.array().cast(kind)),
        F.coalesce(F.from_json(F.get_json_object(s, "$.@graph"), kind), F.array().cast(kind)),
    )
    image = F.filter(F.flatten(F.transform(scripts, nodes)), lambda o: (o["@type"] == "ImageObject") & o["license"].isNotNull())
    out = pages.withColumn("_o", F.get(image, F.lit(0)))
    return out.select(*pages.columns, F.col("_o.license").alias("observed_license_url"), F.col("_o.acquireLicensePage").alias("acquire_license_page"), F.col("_o.contentUrl").alias("content_url"), F.col("_o.creator.name").alias("creator"))


def training_gate(rows: DataFrame) -> DataFrame:
    """The first failing gate of license, domain, annotation and source reviews, or ALL_GATES_PASS.

    Columns: license_review_status, domain_relevance, domain_review_notes, context_tags,
    annotation_review_status, candidate_status; what is null is MISSING.
    """
    said = lambda c: F.coalesce(F.when(F.col(c) != "", F.col(c)), F.lit("MISSING"))
    unjustified = (F.size(rare_tags(F.col("context_tags"))) == 0) | (F.trim(F.coalesce("domain_review_notes", F.lit(""))) == "")
    gate = (
        F.when(said("license_review_status") != "LICENSE_APPROVED", F.concat(F.lit("LICENSE:"), said("license_review_status")))
        .when(~said("domain_relevance").isin("TRAFFIC_RELEVANT", "PARTIALLY_RELEVANT"), F.concat(F.lit("DOMAIN:"), said("domain_relevance")))
        .when((F.col("domain_relevance") == "PARTIALLY_RELEVANT") & unjustified, "DOMAIN:PARTIAL_WITHOUT_RARE_COVERAGE_JUSTIFICATION")
        .when(~said("annotation_review_status").isin("ACCEPTABLE", "ACCEPTABLE_WITH_NOTE"), F.concat(F.lit("ANNOTATION:"), said("annotation_review_status")))
        .when(~said("candidate_status").isin("QUARANTINED_LICENSE_REVIEW", "ELIGIBLE", "APPROVED_FOR_V2_TRAINING"), F.concat(F.lit("SOURCE_CANDIDATE:"), said("candidate_status")))
        .otherwise("ALL_GATES_PASS")
    )
    return rows.withColumn("gate_reason", gate).withColumn("passes", gate == "ALL_GATES_PASS")


def _reviewed(rows: DataFrame, result: str, notes: str, method: str, rules: list[tuple[Column, str, Column | str, str]]) -> DataFrame:
    """Result, notes and method of the first rule (condition, result, notes, method) that holds; the last one always does."""
    out = None
    for holds, said, why, how in rules:
        row = F.struct(F.lit(said).alias("r"), (F.lit(why) if isinstance(why, str) else why).alias("n"), F.lit(how).alias("m"))
        out = F.when(F.coalesce(holds, F.lit(False)), row) if out is None else out.when(F.coalesce(holds, F.lit(False)), row)
    return rows.withColumn("_said", out).withColumns({result: F.col("_said.r"), notes: F.col("_said.n"), method: F.col("_said.m")}).drop("_said")


def domain_review(rows: DataFrame) -> DataFrame:
    """Relevance by title words, then by rare tags, with notes and method. Columns: license_review_status, title, context_tags."""
    rare, title = rare_tags(F.col("context_tags")), F.coalesce("title", F.lit(""))
    return _reviewed(
        rows, "domain_relevance", "domain_review_notes", "domain_review_method",
        [
            (F.coalesce(F.col("license_review_status") != "LICENSE_APPROVED", F.lit(True)), "AMBIGUOUS", "LICENSE_BLOCKED_NOT_PROMOTED", "RULE_ASSISTED"),
            (title.rlike(title_pattern(OTHER_TITLE)), "NON_TRAFFIC", "the title names an event, a display or a recreation off the road", "RULE_ASSISTED"),
            (title.rlike(title_pattern(TRAFFIC_TITLE)), "TRAFFIC_RELEVANT", "the title names a road, transit or a city", "RULE_ASSISTED"),
            (F.size(rare) > 0, "PARTIALLY_RELEVANT", F.concat(F.lit("kept for rare coverage: "), F.array_join(rare, ",")), "RULE_ASSISTED"),
            (F.lit(True), "AMBIGUOUS", "a person and a car alone say nothing of a road", "RULE_ASSISTED"),
        ],
    )


def annotation_review(rows: DataFrame) -> DataFrame:
    """Acceptability by license, readability and box counts, with notes and method. Columns: license_review_status, image_readable, person_boxes, total_boxes."""
    person, total = F.coalesce("person_boxes", F.lit(0)), F.coalesce("total_boxes", F.lit(0))
    return _reviewed(
        rows, "annotation_review_status", "annotation_review_notes", "annotation_review_method",
        [
            (F.coalesce(F.col("license_review_status") != "LICENSE_APPROVED", F.lit(True)), "REJECTED_AMBIGUOUS", "blocked by its license", "RULE_ASSISTED"),
            (~F.coalesce("image_readable", F.lit(False)), "REJECTED_AMBIGUOUS", "the image can't be read", "AUTOMATED_QA"),
            ((person <= 0) | (total <= 0), "REJECTED_INCOMPLETE", "no person or no target is left", "AUTOMATED_QA"),
            ((person >= 20) | (total >= 35), "REJECTED_AMBIGUOUS", "too dense for a contact sheet", "RULE_ASSISTED"),
            (F.lit(True), "ACCEPTABLE_WITH_NOTE", "boxes and classes pass; completeness isn't proven", "RULE_ASSISTED"),
        ],
    )
