"""Registered queries over datasets: checks, duplicates, splits, evaluation, sampling; each with its SQL.

Boxes, labels and detections are derived from ``lineitem`` (an image is an order), 64-bit
prints from ``embeddings``, content groups from ``documents``.
"""

from __future__ import annotations

from functools import cached_property, reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lanewise.functions import labels as lb
from lanewise.functions.geometry import size_bin
from lanewise.operators import annotations as an
from lanewise.operators import diagnostics as dg
from lanewise.operators import duplicates as du
from lanewise.operators import evaluation as el
from lanewise.operators import manifests as mf
from lanewise.operators import merkle as mk
from lanewise.operators import sampling as sm
from lanewise.operators.storage import saved, scratch
from lanewise.plans.derived import CLASSES, FPS, HEIGHT, WIDTH, Scene, table, values
from lanewise.plans.track_queries import CTE as TRACKS

NAMES = ("person", "bicycle", "car")


class Datasets:
    """Derived dataset tables of one data folder."""

    def __init__(self, spark, sf_dir: str):
        self.spark, self.sf_dir, self.scene = spark, sf_dir, Scene(spark, sf_dir)

    def table(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)

    @property
    def lines(self) -> DataFrame:
        """``lineitem`` with a number that is unique within an order; the given line numbers repeat."""
        order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
        return self.table("lineitem").withColumn("line", F.row_number().over(order))

    @property
    def boxes(self) -> DataFrame:
        rows = self.lines.selectExpr(
            "l_orderkey as image_id", "line", "element_at(array('person', 'bicycle', 'car'), cast(l_suppkey % 3 as int) + 1) as class_name", "element_at(array('person', 'bicycle', 'car'), cast((l_suppkey + if(l_partkey % 10 = 0, 1, 0)) % 3 as int) + 1) as pred_class",
            "cast((l_partkey * 37) % 800 as double) as x1", "cast((l_partkey * 53) % 600 as double) as y1", "cast(20 + l_partkey % 60 as double) as w", "cast(20 + l_suppkey % 50 as double) as h",
            "cast(l_suppkey % 7 as double) as shift", "l_returnflag as flag", "l_quantity", "l_discount", "cast(l_partkey % 3 as int) as occlusion", "cast(l_suppkey % 2 as int) as truncation", "l_shipdate",
        )
        return rows

    @property
    def truth(self) -> DataFrame:
        return self.boxes.where("flag <> 'R'").selectExpr("image_id", "line as gt", "class_name", "x1", "y1", "x1 + w as x2", "y1 + h as y2")

    @property
    def predictions(self) -> DataFrame:
        return self.boxes.selectExpr("image_id", "line as pred", "pred_class as class_name", "(30 + cast(round(l_discount * 100) as int) * 5 + image_id % 7) / 100D as conf", "x1 + shift as x1", "y1", "x1 + w + shift as x2", "y1 + h as y2")

    @property
    def areas(self) -> DataFrame:
        return self.boxes.selectExpr("image_id", "class_name", "w * h / 20000D as area", "occlusion", "truncation", "element_at(array('TRAIN', 'VAL', 'LOCKED_TEST'), cast(image_id % 3 as int) + 1) as split")

    @property
    def attributed(self) -> DataFrame:
        return self.boxes.selectExpr("image_id", "case when l_quantity = 50 then 'odd' else class_name end as source_class", "x1 / 1000 as xmin", "(x1 + w) / 1000 as xmax", "y1 / 1000 as ymin", "(y1 + case when l_quantity = 49 then -y1 - 1 else h end) / 1000 as ymax", "cast(image_id % 3 as int) - 1 as is_occluded", "truncation as is_truncated", "case when l_quantity = 48 then 7 when line = 5 then 1 else 0 end as is_group_of", "case when line = 6 then 1 else 0 end as is_depiction", "0 as is_inside")

    @property
    def checked(self) -> DataFrame:
        mapping = values(self.spark, "source_class, class_name", [(f"'{n}'", f"'{n}'") for n in NAMES])
        return an.qa_attributed_boxes(self.attributed, mapping)

    @property
    def label_files(self) -> DataFrame:
        rows = self.lines.selectExpr("l_orderkey as image_id", "line", f"{_NORMAL.format(cat='string', div='div')} as raw")
        lines = F.transform(F.array_sort(F.collect_list(F.struct("line", "raw"))), lambda x: x["raw"])
        return rows.groupBy("image_id").agg(F.array_join(lines, "\n").alias("text"))

    @property
    def pixel_files(self) -> DataFrame:
        rows = self.lines.selectExpr("l_orderkey as image_id", "line", f"{_PIXEL.format(cat='string', div='div')} as raw")
        lines = F.transform(F.array_sort(F.collect_list(F.struct("line", "raw"))), lambda x: x["raw"])
        return rows.groupBy("image_id").agg(F.array_join(lines, "\n").alias("text"))

    @property
    def prints(self) -> DataFrame:
        return self.table("embeddings").select(F.col("vec_id").alias("id"), F.sha2(F.col("label").cast("string"), 256).alias("sha"), du.fingerprint("embedding").alias("print"))

    @cached_property
    def texts(self) -> DataFrame:
        """Documents with digest and 64-bit similarity print; ``known`` says that reviewers have labelled them, ``source_group`` that some come from one place.

        Written once to the shared folder, as its queries read it several times and it is small beside the texts.
        """
        labelled = self.table("labels").select(F.col("doc_id").alias("id")).distinct().withColumn("known", F.lit(True))
        group = F.expr("if(id % 50 = 0, concat('g', cast(id % 3 as string)), null)").alias("source_group")
        rows = self.table("documents").withColumnRenamed("doc_id", "id").select("id", F.sha2("text", 256).alias("sha"), group, du.simhash("text").alias("print"))
        return du.saved(rows.join(labelled, "id", "left").withColumn("known", F.coalesce("known", F.lit(False))), "texts")

    @cached_property
    def items(self) -> DataFrame:
        return du.saved(self.table("benchmark").select(F.col("item_id").alias("id"), F.sha2("text", 256).alias("sha"), du.simhash("text").alias("print")), "items")

    @property
    def contents(self) -> DataFrame:
        return self.table("documents").select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("sha"), "source")

    @property
    def profiles(self) -> DataFrame:
        return an.candidate_profile(self.checked.where("issue is null"))

    @property
    def manifest(self) -> DataFrame:
        groups = self.contents.groupBy("sha").agg(F.min("id").alias("group_root"))
        rows = self.contents.join(groups, "sha").select(F.col("id").alias("image_id"), "group_root")
        return du.group_split(rows, {"TRAIN": 0.7, "VAL": 0.15, "LOCKED_TEST": 0.15}).withColumnRenamed("group_root", "group_id")

    @property
    def features(self) -> DataFrame:
        return sm.frame_features(self.scene.tracks)

    @property
    def metrics(self) -> DataFrame:
        names = values(self.spark, "class_name", [(f"'{n}'",) for n in NAMES])
        # A few rows for each model, written once: several columns read them, and a model's running sums are deleted before the next one's.
        both = []
        for model, found in (("before", self.predictions.where("conf >= 0.55")), ("after", self.predictions)):
            with scratch() as kept:
                kept.append(saved(el.detection_metrics(self.truth, found, names).withColumn("model", F.lit(model)), "metrics"))
            both += kept
        both = both[0].unionByName(both[1])
        overall = both.groupBy("model").agg(*[F.avg(m).alias(m) for m in el.METRICS]).withColumns({"scope": F.lit("overall"), "class_name": F.lit("ALL")})
        return both.withColumn("scope", F.lit("per_class")).drop("targets").unionByName(overall.select("class_name", *el.METRICS, "model", "scope"))


_NORMAL = "case when l_orderkey % 11 = 0 and l_linenumber = 1 then '' when l_orderkey % 13 = 0 and l_linenumber = 2 then '1 0.5 0.5' when l_orderkey % 17 = 0 then concat('9 0.5 0.5 0.1 0.', cast(100 + l_partkey % 900 as {cat})) when l_partkey % 19 = 0 then '0 1.5 0.5 0.1 0.1' when l_partkey % 23 = 0 then '2 0.5 0.5 0 0.1' when l_partkey % 29 = 0 then '1 0.01 0.5 0.9 0.1' when l_orderkey % 5 = 0 then '2 0.5 0.5 0.25 0.25' else concat(cast(l_suppkey % 6 as {cat}), ' 0.', cast(300 + l_partkey % 400 as {cat}), ' 0.', cast(300 + l_suppkey % 400 as {cat}), ' 0.1 0.2') end"
_PIXEL = "case when l_orderkey % 13 = 0 and l_linenumber = 2 then '1,2,3' when l_partkey % 19 = 0 then '10,10,5,5,1,99,0,0' when l_partkey % 23 = 0 then '10,10,5,5,2,1,0,0' when l_partkey % 29 = 0 then '10,10,0,5,1,1,0,0' when l_partkey % 31 = 0 then '990,10,50,5,1,1,0,0' when l_partkey % 37 = 0 then '10,10,5,5,1,1,3,0' when l_orderkey % 5 = 0 then '1,1,9,9,1,2,0,1,' else concat(cast(l_partkey % 800 as {cat}), ',', cast(l_suppkey % 500 as {cat}), ',20,30,1,', cast(l_suppkey % 6 as {cat}), ',', cast(l_suppkey % 2 as {cat}), ',', cast(l_partkey % 3 as {cat})) end"

_BITS = [(half, bit) for half in (0, 1) for bit in reversed(range(32))]
_VOTES = ", ".join(f"sum(case when (h{h} >> {b}) & 1 = 1 then 1 else -1 end) as b{h}_{b}" for h, b in _BITS)
_PRINT = " || ".join(f"case when b{h}_{b} > 0 then '1' else '0' end" for h, b in _BITS)
_SIMHASH = f"""
all_texts as (select 'd' as kind, doc_id as id, text from documents union all select 'b', item_id, text from benchmark),
sim_words as (select kind, id, md5(unnest(list_filter(regexp_split_to_array(coalesce(text, ''), '[^A-Za-z0-9]+'), lambda x: x <> ''))) as m from all_texts),
sim_votes as (select kind, id, {_VOTES} from (select kind, id, ('0x' || substr(m, 1, 8))::bigint as h0, ('0x' || substr(m, 9, 8))::bigint as h1 from sim_words) group by kind, id),
sims as (select a.kind, a.id, sha256(a.text) as sha, coalesce(v.bits, repeat('0', 64)) as bits from all_texts a left join (select kind, id, {_PRINT} as bits from sim_votes) v using (kind, id)),
tx as (select id, sha, bits, case when id % 50 = 0 then 'g' || (id % 3) end as source_group, id in (select doc_id from labels) as known from sims where kind = 'd'),
bm as (select id, sha, bits from sims where kind = 'b'),
tr as (select bits, min(id) as id from tx group by bits),
np as (select least(a.id, b.id) as x, greatest(a.id, b.id) as y, bit_count(xor(a.bits::bit, b.bits::bit)) as distance from tr a join tr b on a.bits < b.bits where bit_count(xor(a.bits::bit, b.bits::bit)) <= 6),
"""

BASE = """
with li as (select *, cast(row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) as integer) as line from lineitem),
bx as (
  select l_orderkey as image_id, line, ['person', 'bicycle', 'car'][l_suppkey % 3 + 1] as class_name, ['person', 'bicycle', 'car'][(l_suppkey + case when l_partkey % 10 = 0 then 1 else 0 end) % 3 + 1] as pred_class,
    cast((l_partkey * 37) % 800 as double) as x1, cast((l_partkey * 53) % 600 as double) as y1, cast(20 + l_partkey % 60 as double) as w, cast(20 + l_suppkey % 50 as double) as h, cast(l_suppkey % 7 as double) as shift, l_returnflag as flag, l_quantity, l_discount,
    cast(l_partkey % 3 as integer) as occlusion, cast(l_suppkey % 2 as integer) as truncation from li),
truth as (select image_id, line as gt, class_name, x1, y1, x1 + w as x2, y1 + h as y2 from bx where flag <> 'R'),
preds as (select image_id, line as pred, pred_class as class_name, (30 + cast(round(l_discount * 100) as integer) * 5 + image_id % 7) / 100.0::double as conf, x1 + shift as x1, y1, x1 + w + shift as x2, y1 + h as y2 from bx),
ar as (select image_id, class_name, w * h / 20000.0::double as area, occlusion, truncation, ['TRAIN', 'VAL', 'LOCKED_TEST'][image_id % 3 + 1] as split from bx),
bins as (select *, case when area < 0.01 then 'SMALL_LT_0.01' when area < 0.09 then 'MEDIUM_0.01_TO_LT_0.09' else 'LARGE_GE_0.09' end as size_bin from ar),
atx as (select image_id, case when l_quantity = 50 then 'odd' else class_name end as source_class, x1 / 1000 as xmin, (x1 + w) / 1000 as xmax, y1 / 1000 as ymin, (y1 + case when l_quantity = 49 then -y1 - 1 else h end) / 1000 as ymax, cast(image_id % 3 as integer) - 1 as is_occluded, truncation as is_truncated, case when l_quantity = 48 then 7 when line = 5 then 1 else 0 end as is_group_of, case when line = 6 then 1 else 0 end as is_depiction, 0 as is_inside from bx),
ck as (select *, case when source_class = 'odd' then null else source_class end as class_name, case when source_class = 'odd' then 'UNMAPPED_CLASS' when not (xmin >= 0 and xmin < xmax and xmax <= 1 and ymin >= 0 and ymin < ymax and ymax <= 1) then 'INVALID_BOUNDS' when is_group_of = 7 then 'INVALID_ATTRIBUTE' end as issue, case when is_depiction = 1 then 'EXCLUDED_DEPICTION' when is_group_of = 1 then 'EXCLUDED_GROUP_OF' else 'ELIGIBLE' end as box_status from atx),
pf0 as (select image_id, list_sort(list(distinct class_name) filter (box_status = 'ELIGIBLE')) as cl, count(*) filter (box_status = 'ELIGIBLE' and class_name = 'person') as person_box_count, count(*) filter (box_status = 'ELIGIBLE' and class_name in ('bicycle', 'car')) as traffic_box_count,
  count(*) filter (box_status = 'ELIGIBLE' and class_name = 'person' and (xmax - xmin) * (ymax - ymin) < 0.01) as small_person_count, count(*) filter (box_status = 'ELIGIBLE' and class_name = 'person' and is_occluded = 1) as occluded_person_count from ck where issue is null group by image_id),
pf as (select image_id, person_box_count, traffic_box_count, small_person_count, occluded_person_count, case when person_box_count = 0 then '' when list_contains(cl, 'bicycle') and list_contains(cl, 'car') then 'PERSON_BICYCLE;PERSON_CAR;PERSON_MULTI_TRAFFIC' when list_contains(cl, 'bicycle') then 'PERSON_BICYCLE' when list_contains(cl, 'car') then 'PERSON_CAR' else 'PERSON_ONLY' end as context_tags,
  case when person_box_count > 0 then 'ELIGIBLE' else 'EXCLUDED_NO_ELIGIBLE_PERSON' end as candidate_status, coalesce(array_to_string(cl, ';'), '') as application_classes from pf0),
pm as (select t.image_id, gt, pred, t.class_name, c / ((t.x2 - t.x1) * (t.y2 - t.y1) + pa - c) as iou from truth t join (select *, (x2 - x1) * (y2 - y1) as pa from preds) p on p.image_id = t.image_id and p.class_name = t.class_name, lateral (select greatest(0, least(t.x2, p.x2) - greatest(t.x1, p.x1)) * greatest(0, least(t.y2, p.y2) - greatest(t.y1, p.y1)) as c)),
th as (select unnest([0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95]::double[]) as threshold),
m1 as (select image_id, threshold, gt, pred, row_number() over (partition by image_id, threshold, pred order by iou desc, gt) as n from pm join th on iou >= threshold),
mt as (select image_id, threshold, pred, gt from m1 where n = 1 qualify row_number() over (partition by image_id, threshold, gt order by pred) = 1),
tg as (select class_name, count(*) as targets from truth group by all),
rk as (select p.class_name, t.threshold, sum(case when mt.gt is null then 0 else 1 end) over w as tps, row_number() over w as n from preds p cross join th t left join mt on mt.image_id = p.image_id and mt.pred = p.pred and mt.threshold = t.threshold window w as (partition by p.class_name, t.threshold order by conf desc, p.image_id, p.pred)),
pr as (select rk.class_name, threshold, n, tps / n as p, tps / targets as r from rk join tg using (class_name)),
rc as (select class_name, threshold, cast(floor(r * 100 + 1e-9) as integer) as reach, max(p) as p from pr group by all),
ap as (select class_name, threshold, sum(v) / 101 as ap from (select c.class_name, c.threshold, coalesce((select max(p) from rc where rc.class_name = c.class_name and rc.threshold = c.threshold and reach >= i), 0) as v from (select distinct class_name, threshold from pr) c, range(101) as g(i)) group by all),
dm as (select class_name, targets, (select arg_max(p, n) from pr where pr.class_name = tg.class_name and threshold = 0.5) as precision, (select max(r) from pr where pr.class_name = tg.class_name and threshold = 0.5) as recall, (select ap from ap where ap.class_name = tg.class_name and threshold = 0.5) as map50, (select sum(ap) / 10 from ap where ap.class_name = tg.class_name) as map50_95 from tg),
ct as (select doc_id as id, sha256(text) as sha, source from documents),
mf as (select id as image_id, min(id) over (partition by sha) as group_id from ct),
ms as (select *, case when p < round(0.7 * 4294967296) then 'TRAIN' when p < round(0.85 * 4294967296) then 'VAL' else 'LOCKED_TEST' end as split from (select *, ('0x' || substr(md5('1601:' || group_id), 1, 8))::bigint as p from mf)),
pt as (select vec_id as id, sha256(cast(label as varchar)) as sha, list_reduce(list_transform(embedding[1:64], lambda x: (case when x > 0 then '1' else '0' end)), lambda a, b: a || b) as bits from embeddings),
SIMHASH
nl as (select l_orderkey as image_id, line as line_number, NORMAL as raw from li),
n1 as (select image_id, line_number, raw, string_split(trim(raw), ' ') as parts from nl),
n2 as (select *, try_cast(parts[1] as integer) as class_id, try_cast(parts[2] as double) as x, try_cast(parts[3] as double) as y, try_cast(parts[4] as double) as w, try_cast(parts[5] as double) as h from n1),
n3 as (select *, case when trim(raw) = '' then 'BLANK_ROW' when len(parts) <> 5 then 'INVALID_ROW_FORMAT' when class_id not between 0 and 5 then 'INVALID_CLASS_ID' when x not between 0 and 1 or y not between 0 and 1 then 'INVALID_COORDINATES' when w <= 0 or h <= 0 or w > 1 or h > 1 then 'INVALID_BOX_SIZE' when x - w / 2 < -1e-6 or x + w / 2 > 1 + 1e-6 or y - h / 2 < -1e-6 or y + h / 2 > 1 + 1e-6 then 'BOX_OUTSIDE_IMAGE' end as i0 from n2),
nb as (select image_id, line_number, class_id, x, y, w, h, case when i0 is null and row_number() over (partition by image_id, i0 is null, class_id, x, y, w, h order by line_number) > 1 then 'DUPLICATE_ANNOTATION' else i0 end as issue from n3),
pl as (select l_orderkey as image_id, line as line_number, rtrim(PIXEL, ',') as raw from li),
p2 as (select *, string_split(raw, ',') as f from pl),
p3 as (select *, case when len(f) <> 8 then 'MALFORMED_ROW' when f[6]::int not between 0 and 11 then 'INVALID_CLASS_ID' when f[5]::int not in (0, 1) then 'INVALID_SCORE' when f[3]::double <= 0 or f[4]::double <= 0 then 'INVALID_BBOX_SIZE' when f[1]::double + f[3]::double > 1000 or f[2]::double + f[4]::double > 700 then 'BBOX_OUTSIDE_IMAGE' when f[7]::int not in (0, 1) then 'INVALID_TRUNCATION' when f[8]::int not in (0, 1, 2) then 'INVALID_OCCLUSION' end as i0 from p2),
pb as (select image_id, line_number, case when i0 is null and row_number() over (partition by image_id, i0 is null, raw order by line_number) > 1 then 'DUPLICATE_ANNOTATION' else i0 end as issue from p3)
""".replace("SIMHASH", _SIMHASH).replace("NORMAL", _NORMAL.format(cat="varchar", div="//")).replace("PIXEL", _PIXEL.format(cat="varchar", div="//"))

_R6 = ("precision", "recall", "map50", "map50_95")


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def _lines(d: Datasets) -> DataFrame:
    return an.annotation_lines(d.label_files)


def _normal(d: Datasets) -> DataFrame:
    return an.qa_normalized_boxes(_lines(d), 6)


def _pixel(d: Datasets) -> DataFrame:
    lines = an.annotation_lines(d.pixel_files)
    sizes = d.pixel_files.select("image_id", F.lit(1000).alias("width"), F.lit(700).alias("height"))
    return an.qa_pixel_boxes(lines, sizes, tuple(range(12)))


def _inventory(d: Datasets) -> DataFrame:
    images = d.table("orders").select(F.col("o_orderkey").alias("image_id")).where("image_id % 7 <> 0")
    counts = _normal(d).groupBy("image_id").agg(F.count_if(F.col("issue").isNull()).alias("annotations"))
    return an.inventory(images, counts, _normal(d))


def _review(d: Datasets) -> DataFrame:
    """Verdicts over labels: quality and toxic as what reviewers said."""
    return d.table("labels").selectExpr("doc_id", "case when quality = 1 and toxic = 0 then 'CORRECT' when quality = 1 then 'DUPLICATE' when toxic = 1 then 'FALSE' else 'MISSED' end as review_category", "cast(doc_id % 3 as int) as fragmentation_count", "toxic = 1 as id_switch_observed", "if(doc_id % 2 = 0, 'NATURAL', 'CONTROLLED_SYNTHETIC') as source_type", "concat('T', cast(doc_id % 4 as string)) as event_type")


_RV = "(select doc_id, case when quality = 1 and toxic = 0 then 'CORRECT' when quality = 1 then 'DUPLICATE' when toxic = 1 then 'FALSE' else 'MISSED' end as review_category, doc_id % 3 as fragmentation_count, toxic = 1 as sw, case when doc_id % 2 = 0 then 'NATURAL' else 'CONTROLLED_SYNTHETIC' end as source_type, 'T' || (doc_id % 4) as event_type from labels)"


def _licensed(d: Datasets) -> DataFrame:
    u = "'https://creativecommons.org/licenses/by/2.0/'"
    rows = d.table("documents").selectExpr("doc_id as image_id", "concat('https://host/photos/a/', cast(doc_id as string), '/') as license_reference", "if(doc_id % 9 = 0, ' ', 'u') as original_url", "source as author", f"{u} as license_url", "if(doc_id % 7 = 0, 404, 200) as http_status", f"if(doc_id % 5 = 0, 'x', {u}) as observed_license_url", "concat('https://host/photos/a/', cast(if(doc_id % 11 = 0, 1, doc_id) as string)) as acquire_license_page", "concat('https://c/', cast(if(doc_id % 13 = 0, -1, doc_id) as string), '.jpg') as content_url", "if(doc_id % 2 = 0, 'A busy street', if(doc_id % 3 = 0, 'Toy museum', 'Untitled')) as title", "if(doc_id % 4 = 1, 'PERSON_BUS', if(doc_id % 8 = 3, 'PERSON_CAR;PERSON_MULTI_TRAFFIC', 'PERSON_CAR')) as context_tags", "doc_id % 6 <> 0 as image_readable", "doc_id % 25 as person_boxes", "doc_id % 40 as total_boxes", "if(doc_id % 17 = 0, 'REJECTED', if(doc_id % 19 = 0, null, 'ELIGIBLE')) as candidate_status")
    return an.training_gate(an.annotation_review(an.domain_review(an.license_review(rows, "https://creativecommons.org/licenses/by/2.0/"))))


_GATE = "(select *, case when v <> 'LICENSE_APPROVED' then 'LICENSE:' || v when dom not in ('TRAFFIC_RELEVANT', 'PARTIALLY_RELEVANT') then 'DOMAIN:' || dom when ann <> 'ACCEPTABLE_WITH_NOTE' then 'ANNOTATION:' || ann when doc_id % 17 = 0 then 'SOURCE_CANDIDATE:REJECTED' when doc_id % 19 = 0 then 'SOURCE_CANDIDATE:MISSING' else 'ALL_GATES_PASS' end as gate from (select *, case when v <> 'LICENSE_APPROVED' then 'AMBIGUOUS' when doc_id % 2 = 0 then 'TRAFFIC_RELEVANT' when doc_id % 3 = 0 then 'NON_TRAFFIC' when doc_id % 4 = 1 or doc_id % 8 = 3 then 'PARTIALLY_RELEVANT' else 'AMBIGUOUS' end as dom, case when v <> 'LICENSE_APPROVED' then 'blocked' when doc_id % 2 = 0 then 'road' when doc_id % 3 = 0 then 'off' when doc_id % 4 = 1 then 'kept for rare coverage: PERSON_BUS' when doc_id % 8 = 3 then 'kept for rare coverage: PERSON_MULTI_TRAFFIC' else 'none' end as note, case when v <> 'LICENSE_APPROVED' or doc_id % 6 = 0 then 'REJECTED_AMBIGUOUS' when doc_id % 25 <= 0 or doc_id % 40 <= 0 then 'REJECTED_INCOMPLETE' when doc_id % 25 >= 20 or doc_id % 40 >= 35 then 'REJECTED_AMBIGUOUS' else 'ACCEPTABLE_WITH_NOTE' end as ann from (select doc_id, case when doc_id % 9 = 0 then 'MISSING_LICENSE_METADATA' when doc_id % 7 = 0 then 'REQUIRES_REVIEW' when doc_id % 5 = 0 then 'REJECTED' when doc_id % 11 = 0 and doc_id <> 1 then 'REQUIRES_REVIEW' when doc_id % 13 = 0 and doc_id <> 1 then 'REQUIRES_REVIEW' else 'LICENSE_APPROVED' end as v from documents)))"


def _near(d: Datasets) -> DataFrame:
    """Near pairs of prints, each named by its smallest document."""
    return du.near_pairs(d.texts, 6, "id").select(F.least("a_name", "b_name").alias("x"), F.greatest("a_name", "b_name").alias("y"), "distance")


def _near_overlap(d: Datasets) -> DataFrame:
    return du.near_overlap(d.texts.where("not known"), d.texts.where("known"), 6, named=True).select("candidate", "reference", "distance")


def _acceptance(d: Datasets) -> DataFrame:
    """Of all annotation rows beside documents that repeat labelled ones, and of the accepted rows beside test items that documents repeat."""
    rows, critical = d.texts, ("INVALID_CLASS_ID", "BOX_OUTSIDE_IMAGE")
    of = lambda name, issues, overlap: an.qa_acceptance(issues, critical, overlap).withColumn("dataset", F.lit(name))
    repeated = rows.where("not known").join(rows.where("known").select("sha").distinct(), "sha", "left_semi")
    return of("all", _normal(d), repeated).unionByName(of("accepted", _normal(d).where("issue is null"), d.items.join(rows.select("sha").distinct(), "sha", "left_semi")))


def _evidence(d: Datasets) -> DataFrame:
    """Pages with JSON-LD of several shapes behind their own html."""
    image = """concat('{"@type":"ImageObject","license":"https://creativecommons.org/licenses/by/', cast(page_id % 3 as string), '.0/","acquireLicensePage":"https://host/', cast(page_id as string), '","contentUrl":"https://c/', cast(page_id as string), '.jpg","creator":{"name":"n', cast(page_id as string), '"}}')"""
    script = lambda x: f"""concat(html, '<script type="application/ld+json">', {x}, '</script>')"""
    shapes = f"""case page_id % 5 when 0 then {script(image)} when 1 then {script(f"concat('[{{\"@type\":\"WebPage\"}},', {image}, ']')")} when 2 then {script(f"concat('{{\"@context\":\"x\",\"@graph\":[', {image}, ']}}')")} when 3 then {script("'{\"@type\":\"ImageObject\",\"contentUrl\":\"x\"}'")} else html end"""
    return an.license_evidence(d.table("pages").selectExpr("page_id", f"{shapes} as html")).drop("html")


FRACTIONS = {"uniform": 0.5, "density": 0.25, "occlusion": 0.25}


def _frames(d: Datasets) -> DataFrame:
    """Frames as candidates, four neighbours of a video to a duplicate group."""
    return d.features.selectExpr("concat(video_id, ':', frame_index) as candidate_id", "video_id", "frame_index", "concat(video_id, ':', frame_index div 4) as duplicate_group_id", "priority_score", "sampling_method", "cast(10 + frame_index % 40 as double) as sharpness")


def _selected(d: Datasets) -> DataFrame:
    chosen = sm.temporal_select(d.features, 8, 5, FRACTIONS)
    return chosen.withColumn("tags", F.expr("filter(array(if(priority_score > 3, 'busy', null), concat('tag', cast(frame_index % 3 as string))), x -> x is not null)"))


def _leaders(d: Datasets) -> DataFrame:
    rows = d.scene.tracks.selectExpr("track_id * 1000 + frame_index as candidate_id", "video_id", "frame_index", "concat(track_id, ':', frame_index div 3) as sha", "cast(floor(center_x / 200) as long) as print")
    gaps = d.scene.videos.selectExpr("video_id", "if(video_id < 'v4', 10, 6) as max_gap")
    return sm.leader_groups(rows, 1, gaps)


def _balanced(name: str, source: str) -> str:
    """CTEs for the greedy choice from ``source`` (video_id, frame_index, sampling_method, priority_score): each step tries the next frame of a video."""
    return f""", {name}_seq as (select video_id, frame_index, phase, row_number() over (partition by video_id order by phase, priority_score desc, frame_index) as k
    from (select *, case sampling_method when 'density' then 1 when 'occlusion' then 2 else 3 end as phase from {source} union all select *, 4 from {source})),
{name}_run as (
  select distinct video_id, 0::bigint as k, []::bigint[] as taken, 0 as phase, 0 as got from {source}
  union all
  select video_id, k, case when ok then list_append(taken, frame_index) else taken end, phase, g + ok::int from (
    select r.video_id, q.k, r.taken, q.frame_index, q.phase, case when q.phase = r.phase then r.got else 0 end as g,
      case when q.phase = 4 then len(r.taken) < 8 else case when q.phase = r.phase then r.got else 0 end < [2, 2, 4][q.phase] end and len(list_filter(r.taken, lambda t: abs(t - q.frame_index) < 5)) = 0 as ok
    from {name}_run r join {name}_seq q on q.video_id = r.video_id and q.k = r.k + 1)),
{name} as (select video_id, unnest(arg_max(taken, k)) as frame_index from {name}_run group by video_id)
"""


def _recursive(sql: str) -> str:
    return sql.lstrip().replace("with ", "with recursive ", 1)


def _hits(d: Datasets) -> DataFrame:
    return el.match_predictions(d.truth, d.predictions)


_BEFORE = BASE.replace("preds as (select", "preds as (select * from (select").replace("from bx),\nar as", "from bx) where conf >= 0.55),\nar as")
_LONG = "select class_name, unnest(['precision', 'recall', 'map50', 'map50_95']) as metric, unnest([precision, recall, map50, map50_95]) as v from dm"
_COMPARED = f"""(with a as ({BASE} {_LONG}), b as ({_BEFORE} {_LONG}), c as (select 'per_class' as scope, class_name, metric, b.v as before, a.v as after from a join b using (class_name, metric))
  select *, after - before as delta from (select * from c union all select 'overall', 'ALL', metric, avg(before), avg(after) from c group by metric))"""


def _comparison(d: Datasets) -> DataFrame:
    return el.model_comparison(d.metrics, "before", "after")


def _ranked(d: Datasets) -> DataFrame:
    return sm.ranked_frames(d.scene.tracks, "low_confidence", 5)


def _counts(s: Scene):
    return dg.runtime_metrics(s.tracks, WIDTH, HEIGHT, 0.15, 0.25)


_RM = f"(select source_id, count(*) as detections, count(*) filter (class_name <> 'person' and (x2 - x1) * (y2 - y1) / {float(WIDTH * HEIGHT)} < 0.01) as small_vehicles, count(*) filter (confidence >= 0.15 and confidence < 0.25) as low_band, count(distinct (video_id, track_id)) as tracks from tracks group by all)"
_FF = "(select video_id, frame_index, count(*) as objects, count(*) filter (class_name = 'person') as persons, min((x2 - x1) * (y2 - y1)) as smallest, exists (select 1 from tracks a join tracks b on a.video_id = b.video_id and a.frame_index = b.frame_index and a.track_id < b.track_id where a.video_id = t.video_id and a.frame_index = t.frame_index and greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) / least((a.x2 - a.x1) * (a.y2 - a.y1), (b.x2 - b.x1) * (b.y2 - b.y1)) >= 0.2) as occluded from tracks t group by all)"

_FEATURES = f"select *, case when occluded then 'occlusion' when objects >= 5 then 'density' else 'uniform' end as sampling_method, cast(objects + 2 * persons + case when occluded then 3 else 0 end as double) as priority_score from {_FF}"
_LEADERS = """, lead_rows as materialized (select track_id * 1000 + frame_index as candidate_id, video_id, frame_index, track_id || ':' || (frame_index // 3) as sha, cast(floor(center_x / 200) as bigint) as p from tracks),
lead_heads as materialized (select *, row_number() over (partition by video_id order by frame_index, candidate_id) as k from (select * from lead_rows qualify row_number() over (partition by sha order by video_id, frame_index, candidate_id) = 1)),
run as (
  select distinct video_id, 0::bigint as k, []::struct(f bigint, c bigint, p bigint)[] as leaders, null::bigint as leader, null::varchar as sha from lead_heads
  union all
  select r.video_id, q.k, case when found is null then list_append(near, {'f': q.frame_index, 'c': q.candidate_id, 'p': q.p}) else near end, coalesce(found, q.candidate_id), q.sha
  from run r join lead_heads q on q.video_id = r.video_id and q.k = r.k + 1,
    lateral (select list_filter(r.leaders, lambda l: q.frame_index - l.f <= case when q.video_id < 'v4' then 10 else 6 end) as near),
    lateral (select list_filter(near, lambda l: bit_count(xor(l.p, q.p)) <= 1)[-1].c as found)),
lead_of as (select sha, leader from run where k > 0),
lead_names as (select lead_heads.candidate_id as leader, row_number() over (order by lead_heads.video_id, lead_heads.frame_index, lead_heads.candidate_id) as n from lead_heads join lead_of using (sha) where lead_of.leader = lead_heads.candidate_id)
"""

_DIGEST = "md5(concat(case when doc_id is null then 'N' else 'V' || length(cast(doc_id as varchar)) || ':' || doc_id end, case when text is null then 'N' else 'V' || length(text) || ':' || text end))"
#: Every level of the tree, straight from the rows.
MERKLE = f"""
with d as (select doc_id, {_DIGEST} as h from documents),
r as (select doc_id, ('0x' || substr(h, 1, 16))::ubigint::hugeint as a, ('0x' || substr(h, 17, 16))::ubigint::hugeint as b from d)
select level, case when level = 3 then 'root' else cast(cast(floor(doc_id / (256 * power(16, level))) as bigint) as varchar) end as node, count(*) as rows,
  cast(sum(a) % 18446744073709551616 as varchar) || ':' || cast(sum(b) % 18446744073709551616 as varchar) as digest
from r, (values (0), (1), (2), (3)) l(level) group by 1, 2
"""
CHANGED = "select doc_id, case when doc_id % 97 = 1 then 'MISSING' when doc_id % 97 = 2 then 'CHANGED' else 'UNEXPECTED' end as status from documents where doc_id % 97 between 1 and 3 and doc_id % 1000 < 300"


def _changed(d: Datasets) -> DataFrame:
    """Documents against a copy in which some ranges have lost, changed and gained rows."""
    rows = d.table("documents").select("doc_id", "text")
    touched = F.expr("doc_id % 1000 < 300")
    left = rows.where(~(touched & (F.col("doc_id") % 97 == 3)))
    right = rows.where(~(touched & (F.col("doc_id") % 97 == 1))).withColumn("text", F.when(touched & (F.col("doc_id") % 97 == 2), F.concat(F.coalesce("text", F.lit("")), F.lit("."))).otherwise(F.col("text")))
    leaf = mk.id_leaf("doc_id")
    trees = [saved(mk.tree(side, leaf, mk.id_parent, 3, "doc_id", "text"), "tree") for side in (left, right)]
    return mk.changed_rows(left, right, mk.differing_leaves(*trees, 3), leaf, "doc_id", "doc_id", "text")


#: Contracts that hold and contracts that don't, by table.
_WANTED = {"events": ("event_id", "user_id", "ts"), "orders": ("o_orderkey", "o_custkey"), "documents": ("doc_id", "checksum", "author"), "pages": ("page_id", "status")}
CONTRACTS = """
select 'events' as name, '' as missing, count(*) as rows from events union all select 'orders', '', count(*) from orders
union all select 'documents', 'author,checksum', 0 union all select 'pages', 'status', 0
"""


def _contracts(d: Datasets) -> DataFrame:
    """The guard's verdict on several tables; those that pass are read and counted."""
    out = []
    for name, columns in _WANTED.items():
        table = d.table(name)
        missing = ""
        try:
            dg.require_columns(table, columns, name)
        except ValueError:
            missing = ",".join(sorted(set(columns) - set(table.columns)))
        counted = table.agg(F.count("*").alias("rows")) if not missing else d.spark.range(1).select(F.lit(0).cast("long").alias("rows"))
        out.append(counted.select(F.lit(name).alias("name"), F.lit(missing).alias("missing"), "rows"))
    return reduce(DataFrame.unionByName, out)


def _usage(d: Datasets) -> DataFrame:
    """Every locked item under every purpose, and whether the guard lets it through."""
    out = []
    for purpose in ("overlap_only", "training", "evaluation"):
        try:
            du.usage_guard(purpose)
            allowed = True
        except ValueError:
            allowed = False
        out.append(d.items.select("id", F.lit(purpose).alias("purpose"), F.lit(allowed).alias("allowed")))
    return reduce(DataFrame.unionByName, out)


QUERIES = {
    # A, B
    "observation_quality": (lambda d: dg.observation_quality(d.scene.tracks.withColumn("confidence", F.when(F.col("track_id") % 50 == 0, 1.5).otherwise(F.col("confidence"))).withColumn("x2", F.when(F.col("track_id") % 41 == 0, F.lit(-1.0)).otherwise(F.col("x2"))).withColumn("timestamp_seconds", F.when(F.col("track_id") % 37 == 0, -F.col("timestamp_seconds")).otherwise(F.col("timestamp_seconds"))), CLASSES), TRACKS + "select video_id, track_id, frame_index, 'BAD_CONFIDENCE' as issue from tracks where track_id % 50 = 0 union all select video_id, track_id, frame_index, 'BAD_BOX' from tracks where track_id % 41 = 0 and -1 < x1 or (track_id % 41 <> 0 and x2 < x1) union all select video_id, track_id, frame_index, 'NON_ADVANCING_FRAME' from (select *, max(frame_index) over (partition by video_id, track_id) as m from tracks) where track_id % 37 = 0 and frame_index < m"),
    "require_columns": (_contracts, CONTRACTS),
    "video_metadata_validate": (lambda d: dg.video_metadata_validate(d.scene.videos.select("video_id", F.when(F.col("video_id") == "v1", 0).otherwise(1920).alias("width"), F.lit(1080).alias("height"), F.when(F.col("video_id") == "v2", 240.0).otherwise(10.0).alias("fps"), "frame_count")), TRACKS + "select video_id, case when video_id = 'v1' then 0 else 1920 end as width, 1080 as height, case when video_id = 'v2' then 240.0 else 10.0 end as fps, frame_count, case when video_id = 'v1' then 'FAIL' when video_id = 'v2' then 'WARNING' else 'PASS' end as status, case when video_id = 'v1' then 'invalid resolution' when video_id = 'v2' then 'unusual fps' else '' end as message from videos"),
    "run_validation": (lambda d: dg.run_validation(d.scene.videos.select("video_id", F.col("frame_count").alias("expected_frames"), (F.col("frame_count") - (F.col("video_id") == "v3").cast("int")).alias("processed_frames"), F.col("frame_count").alias("output_frames"))), TRACKS + "select video_id, frame_count as expected_frames, frame_count - (video_id = 'v3')::int as processed_frames, frame_count as output_frames, case when video_id = 'v3' then 'FAIL' else 'PASS' end as status, case when video_id = 'v3' then 'processed frames differ; output frames differ' else '' end as message from videos"),
    "runtime_profile": (lambda d: dg.runtime_profile(d.scene.videos.select("video_id", "source_id"), values(d.spark, "source_id, profile", [("'aerial'", "'aerial_960'")]), "default_640"), TRACKS + "select source_id, video_id, case when source_id = 'aerial' then 'aerial_960' else 'default_640' end as profile from videos"),
    "content_fingerprint": (lambda d: mk.digests(mk.tree(d.table("documents"), mk.id_leaf("doc_id"), mk.id_parent, 3, "doc_id", "text")), MERKLE),
    "changed_ranges": (_changed, CHANGED),
    "content_digest": (lambda d: dg.table_fingerprint(d.table("documents"), ["doc_id", "text"], "doc_id"), None),
    "integrity_compare": (lambda d: dg.integrity_compare(d.contents.select(F.col("id").alias("asset"), F.col("sha").alias("digest")).where("id % 10 <> 1"), d.contents.select(F.col("id").alias("asset"), F.when(F.col("id") % 10 == 2, F.lit("x")).otherwise(F.col("sha")).alias("digest")).where("id % 10 <> 3")), "select doc_id as asset, case doc_id % 10 when 1 then 'UNEXPECTED' when 3 then 'MISSING' when 2 then 'CHANGED' else 'MATCH' end as status from documents"),
    "map_class": (lambda d: d.boxes.select(lb.map_class(F.col("class_name"), {"person": "PERSON", "car": "VEHICLE"}).alias("mapped")).groupBy("mapped").agg(F.count("*").alias("rows")), BASE + "select case class_name when 'person' then 'PERSON' when 'car' then 'VEHICLE' end as mapped, count(*) as rows from bx group by all"),
    "sequence_group": (lambda d: an.sequence_groups(d.table("pages").select(lb.sequence_group(F.concat(F.col("page_id") % 10, F.lit("_"), F.col("page_id"), F.lit(".jpg"))).alias("sequence"), F.col("page_id").alias("image_id"))), "select cast(page_id % 10 as varchar) as sequence, count(*) as images, min(page_id) as first_id, max(page_id) as last_id from pages group by all"),
    "path_category": (lambda d: d.table("pages").select("page_id", lb.first_token(F.col("url"), {"blog": ("blog.",), "mobile": ("//m.",), "web": ("www.",)}).alias("category")), "select page_id, case when contains(lower(url), 'blog.') then 'blog' when contains(lower(url), '//m.') then 'mobile' when contains(lower(url), 'www.') then 'web' else 'unknown' end as category from pages"),
    "format_clock": (lambda d: d.table("lineitem").select("l_orderkey", "l_linenumber", lb.format_clock((F.col("l_partkey") * 3).cast("double")).alias("clock")), "select l_orderkey, l_linenumber, case when l_partkey * 3 >= 3600 then printf('%02d:', (l_partkey * 3) // 3600) else '' end || printf('%02d:%02d.00', ((l_partkey * 3) // 60) % 60, (l_partkey * 3) % 60) as clock from lineitem"),
    "candidate_id": (lambda d: d.scene.tracks.select("track_id", "frame_index", lb.candidate_id(F.concat(F.lit(" Main "), F.col("source_id")), F.col("frame_index")).alias("candidate_id")), TRACKS + "select track_id, frame_index, printf('main_%s_frame_%06d', source_id, frame_index) as candidate_id from tracks"),
    "row_digest": (lambda d: d.table("lineitem").groupBy("l_orderkey").agg(F.sha2(F.to_json(F.array_sort(F.collect_list(F.struct(F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"))))), 256).alias("digest")), "select l_orderkey, sha256('[' || string_agg('{\"line\":' || l_linenumber || ',\"part\":' || l_partkey || '}', ',' order by l_linenumber, l_partkey) || ']') as digest from lineitem group by all"),
    "event_labels": (lambda d: d.scene.events.select("event_id", lb.event_label(F.col("event_type")).alias("label"), lb.event_interpretation(F.col("status")).alias("interpretation")), TRACKS + "select event_id, upper(event_type[1]) || lower(replace(event_type[2:], '_', ' ')) as label, case status when 'CONFIRMED' then 'Observed by the rule' when 'CANDIDATE' then 'Candidate for review' else 'Needs manual review' end as interpretation from ev"),
    "license_status": (lambda d: d.table("documents").select("doc_id", lb.license_status(F.lit("o"), F.lit("l"), F.when(F.col("doc_id") % 3 == 0, "https://creativecommons.org/licenses/by/2.0/").otherwise("https://example.org"), F.lit("p"), F.when(F.col("doc_id") % 5 == 0, " ").otherwise("a")).alias("status")), "select doc_id, case when doc_id % 5 = 0 or doc_id % 3 = 0 then 'REQUIRES_REVIEW' else 'REJECTED' end as status from documents"),
    # C
    "exclude_ranges": (lambda d: sm.exclude_ranges(d.scene.tracks.select("video_id", "frame_index", "track_id"), values(d.spark, "video_id, start_frame, end_frame", [("'v1'", "5", "20"), ("'v4'", "0", "40")])), TRACKS + "select video_id, frame_index, track_id from tracks where not (video_id = 'v1' and frame_index between 5 and 20) and not (video_id = 'v4' and frame_index between 0 and 40)"),
    "asset_pairing": (lambda d: _inventory(d), BASE + "select coalesce(o.image_id, n.image_id) as image_id, coalesce(a, 0) as annotations, array_to_string(list_sort(list_filter(list_concat(coalesce(i, []), [case when o.image_id is null then 'MISSING_IMAGE' end, case when n.image_id is null then 'MISSING_LABEL' end]), lambda x: x is not null)), ';') as exclusion_reason, case when exclusion_reason = '' then 'PASS' else 'EXCLUDED' end as qa_status from (select o_orderkey as image_id from orders where o_orderkey % 7 <> 0) o full join (select image_id, count(*) filter (issue is null) as a, list(distinct issue) filter (issue is not null) as i from nb group by all) n on o.image_id = n.image_id"),
    "exact_overlap": (lambda d: d.contents.where("id % 2 = 0").select(F.col("id").alias("candidate"), "sha").join(d.contents.where("id % 2 = 1").groupBy("sha").agg(F.min("id").alias("reference")), "sha").select("candidate", "reference"), BASE + "select a.id as candidate, min(b.id) as reference from ct a join ct b on a.sha = b.sha where a.id % 2 = 0 and b.id % 2 = 1 group by all"),
    # G
    "confidence_stats": (lambda d: dg.confidence_stats(d.scene.tracks), TRACKS + "select class_name, count(*) as n, round(avg(confidence), 6) as mean, round(quantile_cont(confidence, 0.1), 6) as p10, round(quantile_cont(confidence, 0.25), 6) as p25, round(quantile_cont(confidence, 0.5), 6) as p50, round(quantile_cont(confidence, 0.75), 6) as p75, round(quantile_cont(confidence, 0.9), 6) as p90 from tracks group by all"),
    "confidence_distribution": (lambda d: dg.confidence_distribution(d.scene.tracks), TRACKS + "select coalesce(class_name, 'ALL') as scope, count(*) as n, round(quantile_cont(confidence, 0.1), 6) as p10, round(quantile_cont(confidence, 0.5), 6) as p50, round(quantile_cont(confidence, 0.9), 6) as p90 from tracks group by grouping sets ((class_name), ())"),
    "runtime_metrics": (lambda d: _counts(d.scene), TRACKS + f"select * from {_RM}"),
    "experiment_deltas": (lambda d: dg.experiment_deltas(_counts(d.scene), "highway"), TRACKS + f"select a.source_id, a.detections - b.detections as delta_detections, a.small_vehicles - b.small_vehicles as delta_small_vehicles, a.low_band - b.low_band as delta_low_band, a.tracks - b.tracks as delta_tracks from {_RM} a, {_RM} b where b.source_id = 'highway'"),
    "experiment_matrix": (lambda d: dg.experiment_matrix(d.scene.tracks, ["highway", "downtown", "urban", "aerial"]), TRACKS + "select class_name, count(*) filter (source_id = 'highway') as highway, count(*) filter (source_id = 'downtown') as downtown, count(*) filter (source_id = 'urban') as urban, count(*) filter (source_id = 'aerial') as aerial from tracks group by all"),
    "synchronized_frames": (lambda d: dg.synchronized_frames(d.scene.videos, [0.0, 1.5, 4.0, 9.9], FPS), TRACKS + "select video_id, cast(f as bigint) as frame_index from videos, (select unnest([0, 15, 40, 99]) as f) where f < frame_count"),
    # H
    "annotation_lines": (lambda d: _lines(d), BASE + "select image_id, cast(line_number as integer) as line_number, raw from nl"),
    "qa_normalized_boxes": (lambda d: _normal(d).select("image_id", "line_number", F.coalesce("class_id", F.lit(-1)).alias("class_id"), "x", "w", "issue"), BASE + "select image_id, cast(line_number as integer) as line_number, coalesce(class_id, -1) as class_id, x, w, issue from nb"),
    "qa_pixel_boxes": (lambda d: _pixel(d).select("image_id", "line_number", "issue"), BASE + "select image_id, cast(line_number as integer) as line_number, issue from pb"),
    "qa_attributed_boxes": (lambda d: d.checked.groupBy("class_name", "issue", "box_status").agg(F.count("*").alias("boxes")), BASE + "select class_name, issue, box_status, count(*) as boxes from ck group by all"),
    "candidate_profile": (lambda d: d.profiles, BASE + "select * from pf"),
    "class_coverage": (lambda d: an.class_coverage(d.areas, values(d.spark, "class_name", [("'person'",), ("'car'",), ("'bus'",)]), values(d.spark, "split", [("'TRAIN'",), ("'VAL'",)])), BASE + "select s.split, c.class_name, count(distinct image_id) as images, count(image_id) as boxes from (values ('TRAIN'), ('VAL')) s(split) cross join (values ('person'), ('car'), ('bus')) c(class_name) left join ar using (split, class_name) group by all"),
    "size_distribution": (lambda d: an.size_distribution(d.areas), BASE + "select class_name, size_bin, count(*) as boxes, round(100.0 * count(*) / sum(count(*)) over (partition by class_name), 6) as percentage from bins group by class_name, size_bin"),
    "occlusion_distribution": (lambda d: an.occlusion_distribution(d.areas), BASE + "select class_name, size_bin, ['NONE', 'PARTIAL', 'HEAVY'][occlusion + 1] as occlusion, case when truncation = 1 then 'PARTIAL' else 'NONE' end as truncation, count(*) as boxes from bins group by all"),
    "coverage_by_difficulty": (lambda d: d.areas.groupBy("class_name", size_bin(F.col("area")).alias("size_bin"), "occlusion").agg(F.count_distinct("image_id").alias("images"), F.count("*").alias("boxes")), BASE + "select class_name, size_bin, occlusion, count(distinct image_id) as images, count(*) as boxes from bins group by all"),
    "context_distribution": (lambda d: an.context_distribution(d.profiles), BASE + "select tag, count(*) as images from (select unnest(string_split(context_tags, ';')) as tag from pf) where tag <> '' group by all"),
    "attribute_distribution": (lambda d: an.attribute_distribution(d.checked.where("class_name is not null")), BASE + "select class_name, count(*) as boxes, cast(sum(is_occluded) as bigint) as occluded, cast(sum(is_truncated) as bigint) as truncated from ck where class_name is not null group by all"),
    "area_profile": (lambda d: an.area_profile(d.areas), BASE + "select round(min(area), 9) as smallest, round(max(area), 9) as largest, round(quantile_cont(area, 0.1), 9) as p10, round(quantile_cont(area, 0.5), 9) as median, round(quantile_cont(area, 0.9), 9) as p90, count(*) filter (area < 0.01) as small, count(*) filter (area >= 0.01 and area < 0.09) as medium, count(*) filter (area >= 0.09) as large from ar"),
    "qa_acceptance": (_acceptance, BASE + "select *, case when critical_issues > 0 or \"overlaps\" > 0 then 'REJECT' else 'ACCEPT' end as decision from (select 'all' as dataset, (select count(*) from nb where issue in ('INVALID_CLASS_ID', 'BOX_OUTSIDE_IMAGE')) as critical_issues, (select count(*) from tx where not known and sha in (select sha from tx where known)) as \"overlaps\" union all select 'accepted', 0, (select count(*) from bm where sha in (select sha from tx)))"),
    "image_class_pivot": (lambda d: an.image_class_pivot(d.areas, list(NAMES)), BASE + "select image_id, count(*) filter (class_name = 'person') as person, count(*) filter (class_name = 'bicycle') as bicycle, count(*) filter (class_name = 'car') as car from ar group by all"),
    "license_evidence": (_evidence, "select page_id, case when page_id % 5 < 3 then 'https://creativecommons.org/licenses/by/' || (page_id % 3) || '.0/' end as observed_license_url, case when page_id % 5 < 3 then 'https://host/' || page_id end as acquire_license_page, case when page_id % 5 < 3 then 'https://c/' || page_id || '.jpg' end as content_url, case when page_id % 5 < 3 then 'n' || page_id end as creator from pages"),
    "license_review": (lambda d: _licensed(d).select("image_id", "license_review_status"), f"select doc_id as image_id, v as license_review_status from {_GATE}"),
    "domain_review": (lambda d: _licensed(d).selectExpr("image_id", "domain_relevance", "annotation_review_status", "case when domain_review_notes like 'kept%' then domain_review_notes end as rare_note", "domain_review_method"), f"select doc_id as image_id, dom as domain_relevance, ann as annotation_review_status, case when note like 'kept%' then note end as rare_note, 'RULE_ASSISTED' as domain_review_method from {_GATE}"),
    "training_gate": (lambda d: _licensed(d).groupBy("gate_reason", "passes").agg(F.count("*").alias("rows")), f"select gate as gate_reason, gate = 'ALL_GATES_PASS' as passes, count(*) as rows from {_GATE} group by all"),
    # I
    "exact_duplicates": (lambda d: du.exact_duplicates(d.contents.select("id", "sha")).select("id", "exact_group_size"), BASE + "select id, count(*) over (partition by sha) as exact_group_size from ct"),
    "near_pairs": (_near, BASE + "select x, y, distance from np"),
    "near_overlap": (_near_overlap, BASE + ", cr as (select known, bits, min(id) as id from tx group by all) select a.id as candidate, b.id as reference, bit_count(xor(a.bits::bit, b.bits::bit)) as distance from cr a join cr b on not a.known and b.known and bit_count(xor(a.bits::bit, b.bits::bit)) <= 6"),
    "duplicate_groups": (lambda d: du.duplicate_groups(d.texts.select("id", "sha", "print", "source_group"), 6), _recursive(BASE) + ", ed as (select min(id) over (partition by sha) as x, id as y from tx union select min(id) over (partition by bits), id from tx union select min(id) over (partition by source_group), id from tx where source_group is not null union select x, y from np), e2 as (select x, y from ed union select y, x from ed), cl(a, b) as (select x, y from e2 union select c.a, e.y from cl c join e2 e on e.x = c.b), rt as (select a as id, min(b) as group_root from cl group by a), sz as (select tx.id, group_root, count(*) over (partition by group_root) as group_size, count(*) over (partition by sha) as exact_group_size from tx join rt using (id)) select *, case when group_size = 1 then 'SINGLETON' when exact_group_size = group_size then 'EXACT' when exact_group_size > 1 then 'EXACT_AND_NEAR' else 'NEAR' end as basis from sz"),
    "group_split": (lambda d: d.manifest, BASE + "select image_id, group_id, split from ms"),
    "source_group_split": (lambda d: du.source_group_split(d.contents.select("source", F.col("sha").alias("group_id"))), BASE + "select source, sha as group_id, case when row_number() over (partition by source order by md5('7:' || sha), sha) <= greatest(1, least(count(*) over (partition by source) - 1, round_even(count(*) over (partition by source) * 0.2, 0))) then 'VAL' else 'TRAIN' end as split from (select distinct source, sha from ct)"),
    "split_validation": (lambda d: du.split_violations(d.manifest.withColumn("split", F.when(F.col("image_id") % 97 == 0, "VAL").otherwise(F.col("split"))), ("TRAIN", "VAL", "LOCKED_TEST", "HOLDOUT")), BASE + "select 'GROUP_CROSSES_SPLITS' as violation, cast(group_id as varchar) as key from (select *, case when image_id % 97 = 0 then 'VAL' else split end as s from ms) group by group_id having count(distinct s) > 1 union all select 'ABSENT_SPLIT', 'HOLDOUT'"),
    "isolation_check": (lambda d: du.isolation_check(d.manifest.where("split = 'TRAIN' or image_id % 50 = 0"), d.manifest, ("TRAIN",)), BASE + "select 0::bigint as missing, count(*) filter (split <> 'TRAIN' and image_id % 50 = 0) as forbidden, case when count(*) filter (split <> 'TRAIN' and image_id % 50 = 0) = 0 then 'PASS' else 'FAIL' end as status from ms"),
    "materialize_split": (lambda d: du.materialize_split(d.manifest.join(d.contents.select(F.col("id").alias("image_id"), F.when(F.col("id") % 31 == 0, F.lit("x")).otherwise(F.col("sha")).alias("sha256")), "image_id"), d.table("documents").select(F.col("doc_id").alias("image_id"), F.col("text").alias("content")).where("image_id % 29 <> 0"), du.fresh_path(d.spark, "split")).select("image_id", "split", "status"), BASE + "select image_id, split, case when image_id % 29 = 0 then 'MISSING' when image_id % 31 = 0 then 'DIFFERENT' else 'VERIFIED' end as status from ms where split in ('TRAIN', 'VAL')"),
    "cross_dataset_overlap": (lambda d: du.overlap_report(d.texts.where("not known"), {"labelled": d.texts.where("known"), "benchmark": d.items}, 6), BASE + ", rf as (select 'labelled' as dataset, id, sha, bits from tx where known union all select 'benchmark', id, sha, bits from bm) select c.id as candidate, dataset, 'EXACT' as match_type, min(r.id) as reference, count(*) as \"references\" from tx c join rf r using (sha) where not c.known group by c.id, dataset union all select c.id, dataset, 'NEAR', min(r.id), count(*) from tx c join rf r on c.sha <> r.sha and bit_count(xor(c.bits::bit, r.bits::bit)) <= 6 where not c.known group by c.id, dataset, r.bits"),
    "usage_guard": (_usage, BASE + "select id, 'overlap_only' as purpose, true as allowed from bm union all select id, 'training', false from bm union all select id, 'evaluation', false from bm"),
    "cross_partition_groups": (lambda d: d.contents.groupBy("sha").agg(F.count_distinct("source").alias("partitions")).where("partitions > 1"), BASE + "select sha, count(distinct source) as partitions from ct group by sha having count(distinct source) > 1"),
    # J
    "match_predictions": (lambda d: _hits(d), BASE + "select image_id, threshold, pred, gt from mt"),
    "detection_metrics": (lambda d: _rounded(el.detection_metrics(d.truth, d.predictions, values(d.spark, "class_name", [(f"'{n}'",) for n in NAMES])), *_R6), BASE + "select class_name, targets, round(precision, 6) as precision, round(recall, 6) as recall, round(map50, 6) as map50, round(map50_95, 6) as map50_95 from dm"),
    "error_summary": (lambda d: el.error_summary(d.truth, d.predictions), BASE + "select class_name, count(*) as targets, count(mt.gt) as true_positives, count(*) - count(mt.gt) as false_negatives from truth t left join mt on mt.image_id = t.image_id and mt.gt = t.gt and threshold = 0.5 group by all"),
    "object_outcomes": (lambda d: el.object_outcomes(d.truth, d.predictions), BASE + ", xo as (select t.image_id, t.gt, t.class_name, p.class_name as pc, c / ((t.x2 - t.x1) * (t.y2 - t.y1) + (p.x2 - p.x1) * (p.y2 - p.y1) - c) as iou from truth t join preds p using (image_id), lateral (select greatest(0, least(t.x2, p.x2) - greatest(t.x1, p.x1)) * greatest(0, least(t.y2, p.y2) - greatest(t.y1, p.y1)) as c)), oo as (select t.image_id, t.gt, t.class_name, (select count(*) from xo where xo.image_id = t.image_id and xo.gt = t.gt and iou >= 0.5 and pc = t.class_name) as s, (select pc from xo where xo.image_id = t.image_id and xo.gt = t.gt and iou >= 0.5 and pc <> t.class_name order by iou desc, pc limit 1) as o from truth t) select image_id, gt, class_name, case when s > 0 then 'MATCHED' when o is not null then 'CONFUSED' else 'MISSED' end as outcome, case when s = 0 then o end as confused_with from oo"),
    "model_comparison": (lambda d: _rounded(_comparison(d), "before", "after", "delta"), f"select scope, class_name, metric, round(before, 6) as before, round(after, 6) as after, round(delta, 6) as delta, delta < 0 as regression from {_COMPARED}"),
    "promotion_decision": (lambda d: el.promotion_decision(_comparison(d), values(d.spark, "rule_no, verdict, scope, class_name, metric, least_delta", [("1", "'REJECT'", "'per_class'", "'person'", "'recall'", "-0.05D"), ("2", "'HOLD'", "'overall'", "'ALL'", "'map50'", "0.9D")])), f"select case when r < -0.05 then 'REJECT' when h < 0.9 then 'HOLD' else 'PROMOTE' end as decision, case when r < -0.05 then 'person recall below -0.05' when h < 0.9 then 'ALL map50 below 0.9' else 'all promotion gates passed' end as reasons from (select max(delta) filter (class_name = 'person' and metric = 'recall') as r, max(delta) filter (scope = 'overall' and metric = 'map50') as h from {_COMPARED})"),
    "tracking_review": (lambda d: _rounded(el.tracking_review(_review(d)), "unfragmented_rate"), f"select count(*) as objects_reviewed, count(*) filter (fragmentation_count = 0) as unfragmented_objects, count(*) filter (fragmentation_count > 0) as fragmented_objects, cast(sum(fragmentation_count) as bigint) as fragmentation_count, count(*) filter (sw) as id_switch_objects, round(count(*) filter (fragmentation_count = 0) / count(*), 6) as unfragmented_rate from {_RV}"),
    "crossing_confusion": (lambda d: _rounded(el.crossing_confusion(_review(d)), "sample_precision", "sample_recall"), f"select *, round(true_positive / (true_positive + false_positive), 6) as sample_precision, round(true_positive / (true_positive + false_negative), 6) as sample_recall from (select count(*) filter (review_category = 'CORRECT') as true_positive, count(*) filter (review_category in ('FALSE', 'DUPLICATE')) as false_positive, count(*) filter (review_category = 'MISSED') as false_negative from {_RV})"),
    "event_review": (lambda d: el.event_review(_review(d).withColumnRenamed("review_category", "review_result")), f"select source_type, event_type, review_category as review_result, count(*) as reviews from {_RV} group by all"),
    # K
    "ranked_frames": (lambda d: _ranked(d), TRACKS + ", k1 as (select *, count(*) over (partition by video_id, frame_index) as density from tracks), k2 as (select * from k1 qualify row_number() over (partition by video_id, frame_index order by confidence, track_id) = 1) select video_id, frame_index, cast(row_number() over (partition by video_id order by confidence, frame_index) as integer) as place, density, 'low_confidence' as reason from k2 qualify place <= 5"),
    "uniform_frames": (lambda d: sm.uniform_frames(d.scene.videos, 12), TRACKS + "select distinct video_id, (i * (frame_count - 1)) // 11 as frame_index from videos, range(12) as g(i)"),
    "review_samples": (lambda d: sm.review_samples(d.scene.tracks, d.scene.videos), TRACKS + ", ev0 as (select distinct video_id, (i * (frame_count - 1)) // 11 as frame_index from videos, range(12) as g(i)), k0 as (select *, count(*) over (partition by video_id, frame_index) as density, (x2 - x1) * (y2 - y1) as area from tracks), k1 as (select video_id, frame_index, track_id, unnest(['low_confidence', 'smallest_box', 'density']) as reason, unnest([0, 1, 2]) as priority, unnest([confidence, area, -density::double]) as score from k0), k2 as (select * from k1 qualify row_number() over (partition by priority, video_id, frame_index order by score, track_id) = 1), k3 as (select *, row_number() over (partition by priority, video_id order by score, frame_index) as place from k2 qualify place <= 12), k4 as (select * from k3 anti join ev0 using (video_id, frame_index) qualify row_number() over (partition by video_id, frame_index order by priority, place) = 1), k5 as (select * from k4 qualify row_number() over (partition by video_id order by place, priority, frame_index) <= 12) select video_id, frame_index, 'uniform' as reason from ev0 union all select video_id, frame_index, reason from k5"),
    "frame_features": (lambda d: d.features, TRACKS + f"select *, case when occluded then 'occlusion' when objects >= 5 then 'density' else 'uniform' end as sampling_method, cast(objects + 2 * persons + case when occluded then 3 else 0 end as double) as priority_score from {_FF}"),
    "duplicate_representatives": (lambda d: sm.duplicate_representatives(d.scene.tracks.select((F.col("track_id") * 1000 + F.col("frame_index")).alias("candidate_id"), F.col("track_id").alias("duplicate_group_id"), F.col("confidence").alias("priority_score"), "frame_index")).where("selected").select("candidate_id", "reason"), TRACKS + "select track_id * 1000 + frame_index as candidate_id, 'DUPLICATE_GROUP_REPRESENTATIVE:' || track_id as reason from tracks qualify row_number() over (partition by track_id order by confidence desc, frame_index, candidate_id) = 1"),
    "pilot_selection": (lambda d: sm.pilot_selection(d.profiles, 100, 5).select("image_id"), BASE + "select image_id from pf where candidate_status = 'ELIGIBLE' order by case when regexp_matches(context_tags, 'PERSON_(BUS|TRUCK|MOTORCYCLE|BICYCLE)') then 0 else 1 end, traffic_box_count desc, least(small_person_count + occluded_person_count, 3) desc, md5('5:' || image_id), image_id limit 100"),
    "previews_per_class": (lambda d: sm.previews_per_class(d.areas, 3), BASE + "select class_name, image_id, cast(row_number() over (partition by class_name order by image_id) as integer) as place from (select distinct class_name, image_id from ar) qualify place <= 3"),
    "temporal_select": (lambda d: sm.temporal_select(d.features, 8, 5, FRACTIONS), _recursive(TRACKS) + ", ff as materialized (" + _FEATURES + "), fr as materialized (select video_id, frame_index, sampling_method, priority_score from ff)" + _balanced("ts", "fr") + "select video_id, frame_index, sampling_method, priority_score from fr join ts using (video_id, frame_index)"),
    "final_selection": (lambda d: mf.final_selection(_frames(d), 8, 5, FRACTIONS, 15.0), _recursive(TRACKS) + ", ff as materialized (" + _FEATURES + "), jd as materialized (select *, video_id || ':' || frame_index as candidate_id, video_id || ':' || (frame_index // 4) as grp, row_number() over (partition by video_id, frame_index // 4 order by priority_score desc, frame_index) as n, 10 + frame_index % 40 as sharp from ff), fr as materialized (select video_id, frame_index, sampling_method, priority_score from jd where n = 1 and sharp >= 15)" + _balanced("ts", "fr") + "select candidate_id, case when n > 1 then 'REJECTED_NEAR_DUPLICATE' when sharp < 15 then 'REJECTED_LOW_SHARPNESS' when ts.frame_index is not null then 'SELECTED_FOR_ANNOTATION' else 'NOT_SELECTED_BALANCE' end as selection_status, case when n > 1 then 'DUPLICATE_REDUCED:' || grp when sharp < 15 then 'LAPLACIAN_VARIANCE_LT_15' when ts.frame_index is not null then 'COVERAGE_BALANCED_DUPLICATE_REPRESENTATIVE' else 'FINAL_SCENE_METHOD_BALANCE' end as selection_reason from jd left join ts on ts.video_id = jd.video_id and ts.frame_index = jd.frame_index"),
    "selection_report": (lambda d: sm.selection_report(_selected(d)), _recursive(TRACKS) + ", ff as materialized (" + _FEATURES + "), fr as materialized (select video_id, frame_index, sampling_method, priority_score from ff)" + _balanced("ts", "fr") + ", se as (select * from fr join ts using (video_id, frame_index)) select 'scene' as section, video_id as name, count(*) as value from se group by all union all select 'method', sampling_method, count(*) from se group by all union all select 'tag', unnest(case when priority_score > 3 then ['busy', 'tag' || (frame_index % 3)] else ['tag' || (frame_index % 3)] end) as t, count(*) from se group by t union all select 'smallest_gap', video_id, min(d) from (select video_id, frame_index - lag(frame_index) over (partition by video_id order by frame_index) as d from se) group by all"),
    "leader_groups": (_leaders, _recursive(TRACKS) + _LEADERS + "select c.candidate_id, printf('V2_FRAME_DUP_%05d', gn.n) as duplicate_group_id, count(*) over (partition by hd.leader) as group_size, count(*) over (partition by c.sha) as exact_duplicate_group_size, case when count(*) over (partition by c.sha) > 1 then 'EXACT' when count(*) over (partition by hd.leader) > 1 then 'NEAR' else 'SINGLETON' end as grouping_basis from lead_rows c join lead_of hd using (sha) join lead_names gn using (leader)"),
    "hard_examples": (lambda d: el.hard_examples(el.object_outcomes(d.truth, d.predictions), d.truth).select("class_name", "place", "image_id", "gt", "outcome"), BASE + ", xo as (select t.image_id, t.gt, t.class_name, p.class_name as pc, c / ((t.x2 - t.x1) * (t.y2 - t.y1) + (p.x2 - p.x1) * (p.y2 - p.y1) - c) as iou from truth t join preds p using (image_id), lateral (select greatest(0, least(t.x2, p.x2) - greatest(t.x1, p.x1)) * greatest(0, least(t.y2, p.y2) - greatest(t.y1, p.y1)) as c)), oo as (select t.image_id, t.gt, t.class_name, (t.x2 - t.x1) * (t.y2 - t.y1) as area, (select count(*) from xo where xo.image_id = t.image_id and xo.gt = t.gt and iou >= 0.5 and pc = t.class_name) as s, (select pc from xo where xo.image_id = t.image_id and xo.gt = t.gt and iou >= 0.5 and pc <> t.class_name order by iou desc, pc limit 1) as o from truth t) select class_name, cast(row_number() over (partition by class_name order by area, image_id, gt) as integer) as place, image_id, gt, case when o is not null then 'CONFUSED' else 'MISSED' end as outcome from oo where s = 0 qualify place <= 2"),
}


def queries():
    return {n: (lambda f: lambda spark, sf_dir: f(Datasets(spark, sf_dir)))(f) for n, (f, _) in QUERIES.items()}


def oracle_sql():
    return {n: sql for n, (_, sql) in QUERIES.items() if sql}


