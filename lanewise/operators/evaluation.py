"""Detection metrics, model comparison and review metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanewise.functions import grid
from lanewise.functions.geometry import box, box_iou
from lanewise.functions.scan import running_sums
from lanewise.operators.storage import saved
from lanewise.operators.tracks import scene_dim

#: The ten overlap thresholds.
THRESHOLDS = tuple(round(0.5 + 0.05 * i, 2) for i in range(10))
METRICS = ("precision", "recall", "map50", "map50_95")
#: Side of the grid cells in which boxes meet, in the boxes' unit (pixels).
CELL = 64.0
#: Predictions of an image from which its boxes meet by grid cells.
CROWD = 64


def candidate_matches(truth: DataFrame, predictions: DataFrame, cell: float = CELL) -> DataFrame:
    """(image_id, gt, pred, iou) of same-class boxes that overlap by the least threshold, met by grid cell. ``truth``: image_id, gt, class_name, box; ``predictions``: image_id, pred, class_name, conf, box."""
    b = ("x1", "y1", "x2", "y2")
    t = truth.select("image_id", "class_name", "gt", *[F.col(c).alias(f"t_{c}") for c in b])
    p = predictions.select("image_id", "class_name", "pred", *[F.col(c).alias(f"p_{c}") for c in b])
    return grid.meeting(t, p, ["image_id", "class_name"], cell, "t_", "p_").withColumn("iou", box_iou(box("t_"), box("p_"))).where(F.col("iou") >= THRESHOLDS[0]).select("image_id", "gt", "pred", "iou")


def _kept(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """One row for a prediction (image_id, pred and other ``keys``) with its best target ``gt`` (null without one), its ``iou``, and ``taken``: the best overlap of an earlier prediction with that target.

    A prediction's best target is the same at all thresholds that it reaches, and it is the target's first one at those that no earlier one reaches.
    """
    best = pairs.groupBy(*keys).agg(F.min(F.when(F.col("gt").isNotNull(), F.struct((-F.col("iou")).alias("i"), "gt"))).alias("b"))
    best = best.select(*keys, F.col("b.gt").alias("gt"), (-F.col("b.i")).alias("iou"))
    earlier = Window.partitionBy("image_id", "gt").orderBy("pred").rowsBetween(Window.unboundedPreceding, -1)
    return best.withColumn("taken", F.when(F.col("gt").isNotNull(), F.max("iou").over(earlier)))


def _true_at(threshold: float) -> Column:
    """Whether a row of :func:`best_targets` is a true positive at a threshold."""
    return (F.col("iou") >= threshold) & (F.coalesce(F.col("taken"), F.lit(0.0)) < threshold)


def best_targets(truth: DataFrame, predictions: DataFrame, keep: list[str], crowd: int = CROWD) -> DataFrame:
    """All predictions (image_id, pred, ``keep``) with gt, iou and taken, see :func:`_kept`.

    Predictions meet the targets of their image by the image alone, which is how tables of images are
    dealt already, so nothing but these is shuffled. Images of more than ``crowd`` predictions meet by grid cells instead.
    """
    keys, b = ["image_id", "pred", *keep], ("x1", "y1", "x2", "y2")
    crowded = saved(predictions.groupBy("image_id").agg(F.count("*").alias("n")).where(F.col("n") > crowd).select("image_id"), "crowded")
    several = not crowded.isEmpty()
    of = (lambda df, how: df.join(crowded, "image_id", how)) if several else (lambda df, how: df)
    t = of(truth, "left_anti").select(F.col("image_id").alias("t_image"), F.col("class_name").alias("t_class"), "gt", *[F.col(c).alias(f"t_{c}") for c in b])
    p = of(predictions, "left_anti").select(*dict.fromkeys([*keys, "class_name"]), *[F.col(c).alias(f"p_{c}") for c in b])
    # Inside the overlap the class is no key of the join, which would deal all rows anew.
    iou = F.when(F.col("class_name") == F.col("t_class"), box_iou(box("t_"), box("p_"))).otherwise(0.0)
    pairs = p.join(t.hint("merge"), (F.col("image_id") == F.col("t_image")) & (iou >= THRESHOLDS[0]), "left")
    out = _kept(pairs.select(*keys, "gt", F.when(F.col("gt").isNotNull(), iou).alias("iou")), keys)
    if several:
        many = of(predictions, "left_semi")
        met = many.select(*keys).join(candidate_matches(of(truth, "left_semi"), many), ["image_id", "pred"], "left")
        out = out.unionByName(_kept(met.select(*keys, "gt", "iou"), keys))
    return out


def match_predictions(truth: DataFrame, predictions: DataFrame) -> DataFrame:
    """(image_id, threshold, pred, gt): true positives at each threshold.

    A prediction keeps its best target, ties to the smaller gt; then a target keeps its
    first prediction by index, whatever its overlap, and the others aren't matched again.
    """
    hits = F.filter(F.array(*[F.when(_true_at(t), F.lit(t)) for t in THRESHOLDS]), lambda x: x.isNotNull())
    return best_targets(truth, predictions, []).where("gt is not null").select("image_id", F.explode(hits).alias("threshold"), "pred", "gt")


def average_precision(truth: DataFrame, predictions: DataFrame) -> DataFrame:
    """(class_name, threshold, ap, recall, precision): 101-point AP over the precision envelope; recall and precision after all predictions.

    Predictions go by confidence, ties by image and index. A prediction is one row with a
    counter for each threshold; the counters run over ranges of predictions of about equal
    size, so neither a class nor one confidence that all share is one task's.
    """
    rows = best_targets(truth, predictions, ["class_name", "conf"])
    hit = lambda t: F.coalesce(_true_at(t), F.lit(False)).cast("long")
    rows = rows.select("image_id", "pred", "class_name", "conf", F.lit(1).cast("long").alias("one"), *[hit(t).alias(f"t{i}") for i, t in enumerate(THRESHOLDS)])
    sums = {"n": "one"} | {f"tps{i}": f"t{i}" for i in range(len(THRESHOLDS))}
    rows = running_sums(rows, ["class_name"], [F.desc("conf"), F.col("image_id"), F.col("pred")], sums, keep=["class_name"])
    targets = truth.groupBy("class_name").agg(F.count("*").alias("targets"))
    counts = F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(f"tps{i}").alias("tps")) for i, t in enumerate(THRESHOLDS)])
    # Spread over thresholds only here, where sums by recall level take the rows in at once.
    rows = rows.select("class_name", "n", F.explode(counts).alias("c")).join(scene_dim(targets), "class_name").select("class_name", "n", "targets", "c.*")
    keys = ["class_name", "threshold"]
    rows = rows.withColumn("p", F.col("tps") / F.col("n")).withColumn("r", F.col("tps") / F.col("targets"))
    # The envelope at a recall level is the best precision at that recall or beyond.
    best = rows.groupBy(*keys, F.floor(F.col("r") * 100 + 1e-9).cast("int").alias("reach")).agg(F.max("p").alias("p"), F.max("r").alias("r"), F.max_by("p", "n").alias("last_p"), F.max("n").alias("n"))
    ahead = Window.partitionBy(*keys).orderBy(F.desc("reach"))
    best = best.withColumn("envelope", F.max("p").over(ahead.rowsBetween(Window.unboundedPreceding, 0))).withColumn("next", F.coalesce(F.lead("reach").over(ahead), F.lit(-1)))
    return best.groupBy(*keys).agg((F.sum(F.col("envelope") * (F.col("reach") - F.col("next"))) / 101).alias("ap"), F.max("r").alias("recall"), F.max_by("last_p", "n").alias("precision"))


def detection_metrics(truth: DataFrame, predictions: DataFrame, classes: DataFrame) -> DataFrame:
    """Per class: targets, precision and recall at 0.5, mAP50 and mAP50-95; a class without predictions or targets has zeros."""
    ap = average_precision(truth, predictions)
    at50 = F.col("threshold") == 0.5
    m = ap.groupBy("class_name").agg(F.max(F.when(at50, F.col("precision"))).alias("precision"), F.max(F.when(at50, F.col("recall"))).alias("recall"), F.max(F.when(at50, F.col("ap"))).alias("map50"), (F.sum("ap") / len(THRESHOLDS)).alias("map50_95"))
    targets = truth.groupBy("class_name").agg(F.count("*").alias("targets"))
    return classes.join(targets, "class_name", "left").join(m, "class_name", "left").fillna(0).select("class_name", "targets", *METRICS)


def error_summary(truth: DataFrame, predictions: DataFrame) -> DataFrame:
    """Targets, true positives at 0.5 and misses for each class."""
    found = match_predictions(truth, predictions).where("threshold = 0.5").select("image_id", "gt").withColumn("tp", F.lit(1))
    rows = truth.select("image_id", "gt", "class_name").join(found, ["image_id", "gt"], "left")
    return rows.groupBy("class_name").agg(F.count("*").alias("targets"), F.count("tp").alias("true_positives"), F.count_if(F.col("tp").isNull()).alias("false_negatives"))


def object_outcomes(truth: DataFrame, predictions: DataFrame, cell: float = CELL) -> DataFrame:
    """MATCHED, CONFUSED (with the best overlapping other class) or MISSED for each target, at overlap 0.5."""
    b = ("x1", "y1", "x2", "y2")
    t = truth.select("image_id", "gt", F.col("class_name").alias("target_class"), *[F.col(c).alias(f"t_{c}") for c in b])
    p = predictions.select("image_id", "pred", F.col("class_name").alias("pred_class"), *[F.col(c).alias(f"p_{c}") for c in b])
    pairs = grid.meeting(t, p, ["image_id"], cell, "t_", "p_").withColumn("iou", box_iou(box("t_"), box("p_"))).where("iou >= 0.5")
    same = F.col("pred_class") == F.col("target_class")
    got = pairs.groupBy("image_id", "gt").agg(F.max(same.cast("int")).alias("same"), F.min(F.when(~same, F.struct((-F.col("iou")).alias("i"), "pred_class"))).alias("o"))
    out = truth.select("image_id", "gt", "class_name").join(got, ["image_id", "gt"], "left")
    return out.select("image_id", "gt", "class_name", F.when(F.col("same") == 1, "MATCHED").when(F.col("o").isNotNull(), "CONFUSED").otherwise("MISSED").alias("outcome"), F.when(F.coalesce(F.col("same"), F.lit(0)) == 0, F.col("o.pred_class")).alias("confused_with"))


def hard_examples(outcomes: DataFrame, truth: DataFrame, k: int = 2) -> DataFrame:
    """The ``k`` smallest targets of each class that weren't matched."""
    area = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))
    rows = outcomes.where("outcome <> 'MATCHED'").join(truth.select("image_id", "gt", area.alias("area")), ["image_id", "gt"])
    n = F.row_number().over(Window.partitionBy("class_name").orderBy("area", "image_id", "gt"))
    return rows.withColumn("place", n).where(F.col("place") <= k).select("class_name", "place", "image_id", "gt", "area", "outcome")


def model_comparison(metrics: DataFrame, before: str, after: str, tolerance: float = 0.0) -> DataFrame:
    """(scope, class_name, metric, before, after, delta, regression). ``metrics``: model, scope, class_name and the four metrics."""
    long = metrics.unpivot(["model", "scope", "class_name"], list(METRICS), "metric", "value")
    side = lambda m, name: long.where(F.col("model") == m).select("scope", "class_name", "metric", F.col("value").alias(name))
    out = side(before, "before").join(side(after, "after"), ["scope", "class_name", "metric"]).withColumn("delta", F.col("after") - F.col("before"))
    return out.withColumn("regression", F.col("delta") < -tolerance)


def promotion_decision(comparison: DataFrame, rules: DataFrame) -> DataFrame:
    """One row: REJECT, HOLD or PROMOTE with reasons in rule order. ``rules``: rule_no, verdict, scope, class_name, metric, least_delta; a missing metric is an error."""
    joined = scene_dim(rules).join(comparison, ["scope", "class_name", "metric"], "left")
    joined = joined.withColumn("delta", F.coalesce("delta", F.raise_error(F.concat(F.lit("missing comparison metric: "), "scope", F.lit("/"), "class_name", F.lit("/"), "metric")).cast("double")))
    failing = F.when(F.col("delta") < F.col("least_delta"), F.struct("rule_no", F.concat_ws(" ", "class_name", "metric", F.lit("below"), F.col("least_delta").cast("string")).alias("reason")))
    of = lambda v: F.array_sort(F.collect_list(F.when(F.col("verdict") == v, failing))).alias(v)
    out = joined.agg(of("REJECT"), of("HOLD"))
    decision = F.when(F.size("REJECT") > 0, "REJECT").when(F.size("HOLD") > 0, "HOLD").otherwise("PROMOTE")
    reasons = F.when(decision == "PROMOTE", F.array(F.lit("all promotion gates passed"))).otherwise(F.transform(F.when(decision == "REJECT", F.col("REJECT")).otherwise(F.col("HOLD")), lambda r: r["reason"]))
    return out.select(decision.alias("decision"), F.array_join(reasons, "; ").alias("reasons"))


def tracking_review(review: DataFrame) -> DataFrame:
    """One row of counts over reviewed objects: fragmentation_count, id_switch_observed; the rate is null without rows."""
    clean = F.col("fragmentation_count") == 0
    return review.agg(
        F.count("*").alias("objects_reviewed"), F.count_if(clean).alias("unfragmented_objects"), F.count_if(~clean).alias("fragmented_objects"), F.coalesce(F.sum("fragmentation_count"), F.lit(0)).alias("fragmentation_count"),
        F.count_if("id_switch_observed").alias("id_switch_objects"), F.try_divide(F.count_if(clean), F.count("*")).alias("unfragmented_rate"),
    )


def crossing_confusion(review: DataFrame) -> DataFrame:
    """One row: true and false positives, misses, precision and recall over review_category CORRECT, FALSE, DUPLICATE, MISSED."""
    n = lambda *c: F.count_if(F.col("review_category").isin(*c))
    tp, fp, fn = n("CORRECT"), n("FALSE", "DUPLICATE"), n("MISSED")
    return review.agg(tp.alias("true_positive"), fp.alias("false_positive"), fn.alias("false_negative"), F.try_divide(tp, tp + fp).alias("sample_precision"), F.try_divide(tp, tp + fn).alias("sample_recall"))


def event_review(review: DataFrame) -> DataFrame:
    return review.groupBy("source_type", "event_type", "review_result").agg(F.count("*").alias("reviews"))
