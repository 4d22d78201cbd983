"""Registered queries over sources, manifests and selections; each with its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lanewise.functions import labels as lb
from lanewise.functions.geometry import in_ranges, size_bin
from lanewise.operators import annotations as an
from lanewise.operators import diagnostics as dg
from lanewise.operators import duplicates as du
from lanewise.operators import manifests as mf
from lanewise.operators import merkle as mk
from lanewise.operators import sampling as sm
from lanewise.operators.storage import saved
from lanewise.plans.derived import HEIGHT, WIDTH, values
from lanewise.plans.governance_queries import BASE, Datasets
from lanewise.plans.track_queries import CTE as TRACKS
from lanewise.sources import tables as tb

_PAGE = "case page_id % 3 when 0 then 'video' when 1 then 'image' else 'audio' end"


def _pages(d: Datasets):
    return d.table("pages").selectExpr("page_id", f"{_PAGE} as asset_type", "if(page_id % 2 = 0, 'runtime_demo', 'training') as role")


def _zone_json(d: Datasets):
    """Zone summaries as nested JSON text, read back with an explicit schema."""
    z = d.scene.zone_summary
    counts = [c for c in z.columns if c.endswith(("occupancy", "inside", "count"))]
    text = z.groupBy("video_id", "source_id").agg(F.map_from_entries(F.collect_list(F.struct("zone_id", F.struct(*counts)))).alias("zones")).select(F.to_json(F.struct("video_id", "source_id", "zones")).alias("j"))
    return text.select(F.from_json("j", tb.ZONE_SUMMARY).alias("s")).select("s.*")


def _written(d: Datasets):
    shared = saved(d.scene.videos, "videos").inputFiles()[0].rsplit("/", 2)[0]
    path = f"{shared}/tables-{uuid.uuid4().hex}"
    tb.write_tables({"tracks": d.scene.tracks}, path)
    back = d.spark.read.parquet(f"{path}/tracks")
    return back.groupBy("source_id").agg(F.count("*").alias("rows"), F.round(F.sum("center_x"), 3).alias("sum_x"))


def _candidates(d: Datasets):
    return d.scene.tracks.selectExpr("track_id * 1000 + frame_index as candidate_id", "video_id", "frame_index", "array(class_name) as tags", "if(track_id % 10 = 3, 'random', 'uniform') as sampling_method", "if(track_id % 23 = 0, 'ANNOTATED', 'NOT_ANNOTATED') as annotation_status", "if(track_id % 29 = 0, ' ', 'path') as image_path")


def _closed(d: Datasets):
    return values(d.spark, "video_id, start_frame, end_frame", [("'v1'", "5L", "9L"), ("'v1'", "12L", "20L"), ("'v4'", "0L", "14L")])


def _titled(d: Datasets):
    return d.profiles.selectExpr("image_id", "image_id % 500 = 0 as forced", "context_tags", "small_person_count", "occluded_person_count", "case image_id % 3 when 0 then 'Old bus stop' when 1 then 'Car show downtown' else 'Untitled' end as title")


_SCORE = "4 * (context_tags like '%PERSON_BICYCLE%')::int + 3 * (context_tags like '%PERSON_MULTI_TRAFFIC%')::int + least(small_person_count, 4) + least(occluded_person_count, 3) + case image_id % 3 when 0 then 2 when 1 then -6 else 0 end"


def _assigned(d: Datasets):
    """A split for all orders but some, by whole orders."""
    orders = d.table("orders").where("o_orderkey % 7 <> 0").select(F.col("o_orderkey").alias("image_id"), F.col("o_orderkey").alias("group_root"))
    return du.group_split(orders, {"TRAIN": 0.7, "VAL": 0.3}).withColumnRenamed("group_root", "group_id")


def _ranges(d: Datasets):
    return d.scene.videos.where("video_id <> 'v7'").selectExpr("video_id", "if(video_id = 'v1', 50L, 5L) as start_frame", "if(video_id = 'v2', 1000000L, 20L) as end_frame").unionByName(values(d.spark, "video_id, start_frame, end_frame", [("'x9'", "1L", "2L")]))


def _normalized(d: Datasets):
    rows = d.boxes.selectExpr("image_id", "line", "x1 as left", "y1 as top", "w", "h", "1000 as width", "700 as height")
    return an.normalize_boxes(rows)


#: The tree of (name, digest) by the first digits of the names' MD5, straight from the rows.
TREE = """
with f as (select cast(doc_id as varchar) as name, sha256(text) as digest from documents),
h as (select md5(name) as path, md5(concat('V' || length(name) || ':' || name, case when digest is null then 'N' else 'V64:' || digest end)) as h from f)
select level, case when level = 2 then 'root' else substr(path, 1, 2 - level) end as node, count(*) as rows,
  cast(sum(('0x' || substr(h, 1, 16))::ubigint::hugeint) % 18446744073709551616 as varchar) || ':' || cast(sum(('0x' || substr(h, 17, 16))::ubigint::hugeint) % 18446744073709551616 as varchar) as digest
from h, (values (0), (1), (2)) l(level) group by 1, 2
"""

QUERIES = {
    "runtime_sources": (lambda d: tb.runtime_sources(_pages(d)), "select page_id, 'video' as asset_type, 'runtime_demo' as role from pages where page_id % 6 = 0"),
    "zone_summary_json": (lambda d: tb.flatten_zone_summary(_zone_json(d)), TRACKS + "select * from zs"),
    "track_records": (lambda d: tb.track_records(d.scene.tracks.drop("class_name", "center_x", "center_y").withColumn("class_id", (F.col("track_id") % 6).cast("int")), values(d.spark, "class_id, class_name", [("0", "'person'"), ("2", "'car'")])).select("track_id", "frame_index", "class_name", "center_x", "center_y"), TRACKS + "select track_id, frame_index, class_name, (x1 + x2) / 2 as center_x, (y1 + y2) / 2 as center_y from tracks where class_name in ('person', 'car')"),
    "write_tables": (_written, TRACKS + "select source_id, count(*) as rows, round(sum(center_x), 3) as sum_x from tracks group by all"),
    "tree_fingerprint": (lambda d: mk.digests(mk.tree(d.table("documents").select(F.col("doc_id").cast("string").alias("name"), F.sha2("text", 256).alias("digest")), mk.name_leaf("name", 2), mk.name_parent, 2, "name", "digest")), TREE),
    "tree_digest": (lambda d: tb.tree_fingerprint(d.table("documents").select(F.col("doc_id").cast("string").alias("name"), F.sha2("text", 256).alias("digest"))), None),
    "in_ranges": (lambda d: d.scene.tracks.select("track_id", "frame_index", in_ranges(F.col("frame_index"), [(3, 9), (30, 41)]).alias("inside")), TRACKS + "select track_id, frame_index, frame_index between 3 and 9 or frame_index between 30 and 41 as inside from tracks"),
    "context_tags": (lambda d: d.areas.groupBy("image_id").agg(F.collect_set("class_name").alias("c")).select("image_id", F.array_join(lb.context_tags(F.col("c")), ";").alias("tags")), BASE + "select image_id, case when not bool_or(class_name = 'person') then '' when bool_or(class_name = 'bicycle') and bool_or(class_name = 'car') then 'PERSON_BICYCLE;PERSON_CAR;PERSON_MULTI_TRAFFIC' when bool_or(class_name = 'bicycle') then 'PERSON_BICYCLE' when bool_or(class_name = 'car') then 'PERSON_CAR' else 'PERSON_ONLY' end as tags from ar group by all"),
    "size_bin": (lambda d: d.areas.groupBy(size_bin(F.col("area")).alias("size_bin")).agg(F.count("*").alias("boxes")), BASE + "select size_bin, count(*) as boxes from bins group by all"),
    "qa_generic_bbox": (lambda d: d.scene.tracks.select("track_id", "frame_index", mf.valid_box(WIDTH, HEIGHT).alias("valid")), TRACKS + f"select track_id, frame_index, x1 >= 0 and y1 >= 0 and x2 > x1 and y2 > y1 and x2 <= {WIDTH} and y2 <= {HEIGHT} as valid from tracks"),
    "resolve_classes": (lambda d: mf.resolve_classes(d.boxes.select(F.col("class_name").alias("display_name"), F.when(F.col("class_name") == "car", F.col("truncation")).otherwise(F.lit(7)).alias("class_id")), values(d.spark, "display_name", [("'person'",), ("'car'",), ("'ship'",)])).fillna(-1), "select * from (values ('person', 7, 'RESOLVED'), ('car', -1, 'AMBIGUOUS'), ('ship', -1, 'MISSING')) t(display_name, class_id, status)"),
    "normalize_boxes": (lambda d: _normalized(d).select("image_id", "line", F.round("xc", 9).alias("xc"), F.round("area", 9).alias("area")), BASE + "select image_id, line, round((x1 + w / 2) / 1000, 9) as xc, round((w / 1000) * (h / 700), 9) as area from bx"),
    "decode_labels": (lambda d: mf.decode_labels(_normalized(d)).select("image_id", "line", F.round("x1", 6).alias("x1"), F.round("y2", 6).alias("y2")), BASE + "select image_id, line, round(x1, 6) as x1, round(y1 + h, 6) as y2 from bx"),
    "annotation_audit": (lambda d: mf.annotation_audit(d.table("orders").select(F.col("o_orderkey").alias("stem")), d.table("lineitem").select(F.col("l_orderkey").alias("stem"))), "select paired, images_only, labels_only, case when paired = 0 then 'NO_ANNOTATIONS' when images_only + labels_only > 0 then 'PARTIALLY_PAIRED' else 'DETECTION_CANDIDATE' end as suitability from (select count(*) filter (i and l) as paired, count(*) filter (l is null) as images_only, count(*) filter (i is null) as labels_only from (select distinct o_orderkey as k, true as i from orders) full join (select distinct l_orderkey as k, true as l from lineitem) using (k))"),
    "image_coverage": (lambda d: mf.image_coverage(d.table("pages").select(lb.first_token(F.col("url"), {"blog": ("blog.",), "mobile": ("//m.",)}).alias("category"), F.when(F.col("page_id") % 4 == 0, "night").otherwise("day").alias("time_of_day"), F.when(F.length("html") > 3000, "KEEP").otherwise("REVIEW").alias("disposition"))), "select case when contains(lower(url), 'blog.') then 'blog' when contains(lower(url), '//m.') then 'mobile' else 'unknown' end as category, case when page_id % 4 = 0 then 'night' else 'day' end as time_of_day, case when length(html) > 3000 then 'KEEP' else 'REVIEW' end as disposition, count(*) as images from pages group by all"),
    "resolution_issues": (lambda d: mf.resolution_issues(d.table("part").selectExpr("p_partkey as image_id", "p_partkey % 9 <> 0 as readable", "if(p_size > 40, 640, 1920) as width", "1080 as height"), 1920, 1080), "select p_partkey as image_id, case when p_partkey % 9 = 0 then 'UNREADABLE_IMAGE' else 'NON_STANDARD_RESOLUTION' end as issue from part where p_partkey % 9 = 0 or p_size > 40"),
    "pool_report": (lambda d: mf.pool_report(d.areas.select("split", F.concat(F.lit("s"), F.col("image_id") % 2).alias("source"), "class_name", "image_id")), BASE + "select coalesce(split, 'ALL') as split, coalesce(source, 'ALL') as source, coalesce(class_name, 'ALL') as class_name, count(distinct image_id) as images, count(*) as boxes from (select *, 's' || (image_id % 2) as source from ar) group by grouping sets ((split, source, class_name), (split, source), (split), ())"),
    "canonical_predictions": (lambda d: mf.canonical_predictions(d.predictions.withColumnRenamed("class_name", "model_class"), values(d.spark, "model_class, class_id", [("'person'", "0"), ("'car'", "2")])).groupBy("class_id").agg(F.count("*").alias("predictions")), BASE + "select case class_name when 'person' then 0 else 2 end as class_id, count(*) as predictions from preds where class_name in ('person', 'car') group by all"),
"model_manifest_check": (lambda d: mf.model_manifest_check(d.table("supplier").select(F.col("s_suppkey").alias("model"), F.when(F.col("s_suppkey") % 4 == 0, "RUNNING").otherwise("COMPLETE").alias("status"), F.map_from_arrays(F.array(F.lit("train_splits"), F.when(F.col("s_suppkey") % 3 == 0, "seed").otherwise("epochs")), F.array(F.when(F.col("s_suppkey") % 5 == 0, "TRAIN,LOCKED_TEST").otherwise("TRAIN"), F.lit("1"))).alias("entries")), ("train_splits", "seed"), ("LOCKED_TEST",)), "select s_suppkey as model, 'MISSING_SEED' as issue from supplier where s_suppkey % 3 <> 0 union all select s_suppkey, 'FORBIDDEN_LOCKED_TEST' from supplier where s_suppkey % 5 = 0 union all select s_suppkey, 'NOT_COMPLETE' from supplier where s_suppkey % 4 = 0"),
    "controlled_validation": (lambda d: mf.controlled_validation(d.table("labels").select(F.col("quality").alias("expected"), F.col("toxic").alias("observed"))), "select count(*) as cases, count(*) filter (quality is not distinct from toxic) as passed from labels"),
    "evaluation_manifest_check": (lambda d: mf.evaluation_ranges_check(_ranges(d), d.scene.videos), TRACKS + "select video_id, case when video_id = 'v1' then 'REVERSED_RANGE' when video_id = 'v2' then 'BEYOND_VIDEO' else 'NOT_COVERED' end as issue from videos where video_id in ('v1', 'v2', 'v7') union all select 'x9', 'UNKNOWN_VIDEO'"),
    "review_row_check": (lambda d: mf.review_row_check(d.table("labels").selectExpr("doc_id as review_id", "case when toxic = 1 then 'FALSE_NEGATIVE' when doc_id % 7 = 0 then 'MAYBE' else 'CORRECT' end as review_result", "if(quality = 1, 'car', null) as class_name"), ("CORRECT", "FALSE_NEGATIVE")), "select doc_id as review_id, case when coalesce(toxic, 0) <> 1 then 'INVALID_RESULT' else 'CLASS_ON_FALSE_NEGATIVE' end as issue from labels where (coalesce(toxic, 0) <> 1 and doc_id % 7 = 0) or (toxic = 1 and quality = 1)"),
    "candidate_check": (lambda d: mf.candidate_check(_candidates(d), _closed(d), ("person", "car", "bus"), ("uniform",), ("image_path",)), TRACKS + "select track_id * 1000 + frame_index as candidate_id, case when (video_id = 'v1' and (frame_index between 5 and 9 or frame_index between 12 and 20)) or (video_id = 'v4' and frame_index <= 14) then 'EXCLUDED_RANGE' when class_name not in ('person', 'car', 'bus') then 'UNKNOWN_TAG' when track_id % 10 = 3 then 'UNKNOWN_METHOD' when track_id % 23 = 0 then 'ALREADY_ANNOTATED' when track_id % 29 = 0 then 'MISSING_FIELD' end as issue from tracks where issue is not null"),
    "review_candidates": (lambda d: mf.review_candidates(_titled(d), 50, 9).select("image_id", "score"), BASE + f"select image_id, cast(s as integer) as score from (select image_id, image_id % 500 = 0 as forced, {_SCORE} as s from pf where context_tags like '%PERSON_BICYCLE%' or context_tags like '%PERSON_CAR%' or context_tags like '%PERSON_MULTI_TRAFFIC%') order by forced desc, s desc, md5('9:' || image_id), image_id limit 50"),
    "pilot_check": (lambda d: mf.pilot_check(sm.pilot_selection(d.profiles, 100, 5), 100), BASE + "select least(n, 100) as size, least(n, 100) as distinct_images, 0::bigint as missing_fields, case when n >= 100 then 'PASS' else 'FAIL' end as status from (select count(*) as n from pf where candidate_status = 'ELIGIBLE')"),
    "metadata_merge": (lambda d: mf.merge_checked(d.table("documents").select("doc_id", "source"), d.table("labels").select("doc_id", "quality", "toxic"), "doc_id"), "select doc_id, source, quality, toxic from documents left join labels using (doc_id)"),
    "manifest_map": (lambda d: mf.manifest_map(d.boxes.select("image_id", "line", "class_name"), _assigned(d)), BASE + "select image_id, line, class_name, case when image_id % 7 = 0 then 'UNASSIGNED' when ('0x' || substr(md5('1601:' || image_id), 1, 8))::bigint < round(0.7 * 4294967296) then 'TRAIN' else 'VAL' end as split, case when image_id % 7 <> 0 then image_id end as group_id from bx"),
    "class_dispositions": (lambda d: mf.map_classes(d.boxes.selectExpr("if(image_id % 2 = 0, 'a', 'b') as source", "class_name as source_class"), values(d.spark, "source, source_class, class_name, disposition", [("'a'", "'person'", "'person'", "'MAPPED'"), ("'a'", "'car'", "'car'", "'MAPPED'"), ("'b'", "'person'", "'person'", "'MAPPED'"), ("'b'", "'bicycle'", "cast(null as string)", "'IGNORED'")])).groupBy("source", "source_class", "class_name", "disposition").agg(F.count("*").alias("boxes")), BASE + "select source, source_class, case when disposition = 'MAPPED' then source_class end as class_name, disposition, count(*) as boxes from (select *, case when source_class = 'person' or (source = 'a' and source_class = 'car') then 'MAPPED' when source = 'b' and source_class = 'bicycle' then 'IGNORED' else 'UNMAPPED' end as disposition from (select case when image_id % 2 = 0 then 'a' else 'b' end as source, class_name as source_class from bx)) group by all"),
    "diagnostic_rows": (lambda d: dg.diagnostic_rows(d.scene.tracks, WIDTH, HEIGHT, 0.002).select("track_id", "frame_index", "normalized_bbox_area", "small_bbox"), TRACKS + f"select track_id, frame_index, round((x2 - x1) * (y2 - y1) / {float(WIDTH * HEIGHT)}, 8) as normalized_bbox_area, (x2 - x1) * (y2 - y1) / {float(WIDTH * HEIGHT)} < 0.002 as small_bbox from tracks"),
}


def queries():
    return {n: (lambda f: lambda spark, sf_dir: f(Datasets(spark, sf_dir)))(f) for n, (f, _) in QUERIES.items()}


def oracle_sql():
    return {n: sql for n, (_, sql) in QUERIES.items() if sql}
