"""Hard-negative mining by slot-decomposed selection.

*Positives.* Anchors meet all rows in blocks; each task keeps, for each anchor, the best
rows of its label only, so a shuffle carries at most ``positives`` rows for an anchor and task.

*Slots.* A positive's negatives lie in a window of scores that ends at the positive's own
score. The windows of one anchor overlap, but their upper limits, in falling order, split
the scores into disjoint slots: slot j holds the scores at or below limit j and above limit j + 1. In
the second pass a task adds each row of another label to one slot, and keeps the best
``negatives`` rows for each anchor and slot: a combiner of bounded size, merged by score after the shuffle.

*Suffix merges.* The best at or below limit j are the best of slots j, j + 1 and so on. Slots are
disjoint and fall, so from the last slot upwards one concatenation for each slot, cut to
``negatives`` rows, answers all windows; the lower limit then cuts off a tail.

Scores are integers and exact. Rows and anchors are packed into blocks, and the blocks are dealt to stripes of
rows and groups of anchors; every stripe meets every group in an equality join on both, so neither side has to fit into a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lanewise.llm.common import read_table, write_scratch

#: Rows of a packed block and anchors of a packed block, at most.
BLOCK_ROWS, ANCHOR_ROWS = 4_096, 512
#: Blocks of a stripe of rows, about, and of a group of anchors.
STRIPE_BLOCKS, GROUP_BLOCKS = 64, 64
#: Components lie in this range, so that a product of two rows of MOST_DIMENSIONS fits in 63 bits.
COMPONENT_LIMIT, MOST_DIMENSIONS = 1 << 24, 1 << 14


def usable(df: DataFrame, id_col: str, vector_col: str, label_col: str, scale: int) -> DataFrame:
    """(id, label, v): one row for an id, components as integers floor(scale * x)."""
    v = F.col(vector_col)
    good = df.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & v.isNotNull()).where(
        (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != F.lit(float("inf"))))
    )
    whole = F.transform(v, lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("long"))
    rows = good.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), whole.alias("v"))
    # Of rows that repeat an id the smallest counts; equal rows are one.
    return rows.groupBy("id").agg(F.min(F.struct("label", "v")).alias("one")).select("id", "one.*")


def _packed(rows: DataFrame, size: int) -> DataFrame:
    """(d, ids, labels, v[, limits]): blocks of at most ``size`` rows of one length, as binary columns."""
    with_limits = "limits" in rows.columns

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple]] = {}

        def block(d: int, part: list[tuple]) -> pa.RecordBatch:
            ids, labels, v, limits = zip(*part, strict=True)
            x = np.array(v, np.int64)
            if np.abs(x).max() > COMPONENT_LIMIT or d > MOST_DIMENSIONS:
                raise ValueError(f"vectors need scaled components of at most {COMPONENT_LIMIT} and {MOST_DIMENSIONS} dimensions for exact scores")
            columns = [np.array(ids, np.int64), np.array(labels, np.int64), x]
            out = [pa.array([d], pa.int32()), *[pa.array([c.tobytes()], pa.binary()) for c in columns]]
            return pa.RecordBatch.from_arrays(out + [pa.array([list(limits)], pa.list_(pa.list_(pa.int64())))] * with_limits, ["d", "ids", "labels", "v"] + ["limits"] * with_limits)

        for b in batches:
            limits = b["limits"].to_pylist() if with_limits else [None] * b.num_rows
            for row in zip(b["id"].to_pylist(), b["label"].to_pylist(), b["v"].to_pylist(), limits, strict=True):
                part = held.setdefault(len(row[2]), [])
                part.append(row)
                if len(part) >= size:
                    yield block(len(row[2]), held.pop(len(row[2])))
        for d, part in held.items():
            yield block(d, part)

    return rows.mapInArrow(work, "d int, ids binary, labels binary, v binary" + ", limits array<array<long>>" * with_limits)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products of all rows of ``a`` with all of ``b``: in doubles where these hold every partial sum."""
    bound = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64) if bound < 2**53 else a @ b.T


def best(parts: list[tuple], k: int) -> tuple[np.ndarray, ...]:
    """Of (anchor, slot, score, id) the ``k`` best of each anchor and slot: highest scores, ties to smaller ids."""
    anchor, slot, score, row = map(np.concatenate, zip(*parts, strict=True))
    order = np.lexsort((row, -score, slot, anchor))
    anchor, slot, score, row = anchor[order], slot[order], score[order], row[order]
    new = np.r_[True, (anchor[1:] != anchor[:-1]) | (slot[1:] != slot[:-1])][: len(anchor)]
    at = np.arange(len(anchor))
    keep = at - np.maximum.accumulate(np.where(new, at, 0)) < k
    return anchor[keep], slot[keep], score[keep], row[keep]


def leading(score: np.ndarray, use: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of at least the ``k`` best usable columns of each row; equal scores at the last place all stay."""
    low = np.iinfo(np.int64).min
    masked = np.where(use, score, low)
    top = min(k, masked.shape[1])
    least = np.partition(masked, masked.shape[1] - top, axis=1)[:, masked.shape[1] - top]
    return np.nonzero(use & (masked >= least[:, None]))


def _selected(anchors: DataFrame, blocks: DataFrame, k: int, rows: int, asking: int) -> DataFrame:
    """(anchor, slot, score, id): candidates for the ``k`` best of each slot, cut down within tasks.

    Without limits there is one slot of the rows with the anchor's label, else the slots of other labels.
    ``rows`` and ``asking`` are the numbers of rows and anchors.
    """
    kinds = "anchor long, slot int, score long, id long"
    with_limits = "limits" in anchors.columns
    tasks = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    groups = -(-asking // (ANCHOR_ROWS * GROUP_BLOCKS)) or 1
    stripes = max(-(-tasks // groups), -(-rows // (BLOCK_ROWS * STRIPE_BLOCKS)))
    number = lambda n: F.pmod(F.xxhash64("ids"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    keys = ["stripe", "group", "d"]
    # A number of partitions is given, so that they aren't put together by their size: it is the work that counts.
    dealt = blocks.withColumn("stripe", number(stripes)).withColumn("group", every(groups)).repartition(tasks, *keys)
    asked = anchors.withColumn("group", number(groups)).withColumn("stripe", every(stripes)).withColumnsRenamed({"ids": "a_ids", "labels": "a_labels", "v": "a_v"}).repartition(tasks, *keys)
    meet = dealt.join(asked.hint("merge"), keys)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        rows = 0
        for b in batches:
            limits = b["limits"].to_pylist() if with_limits else [None] * b.num_rows
            for d, *raw, cuts in zip(*(b[c].to_pylist() for c in ("d", "ids", "labels", "v", "a_ids", "a_labels", "a_v")), limits, strict=True):
                ids, labels, v, a_ids, a_labels, a_v = (np.frombuffer(x, np.int64) for x in raw)
                score = products(a_v.reshape(-1, d), v.reshape(-1, d))
                same = a_labels[:, None] == labels[None]
                if cuts is None:
                    pairs = [(0, *leading(score, same & (a_ids[:, None] != ids[None]), k))]
                else:
                    most = max(map(len, cuts))
                    limit = np.array([c + [np.iinfo(np.int64).min] * (most + 1 - len(c)) for c in cuts], np.int64)
                    pairs = [(j, *leading(score, ~same & (score <= limit[:, j, None]) & (score > limit[:, j + 1, None]), k)) for j in range(most)]
                for slot, at, to in pairs:
                    held.append((a_ids[at], np.full(len(at), slot, np.int32), score[at, to], ids[to]))
                    rows += len(at)
                if rows > 400_000:
                    held = [best(held, k)]
                    rows = len(held[0][0])
                    if rows > 200_000:
                        yield pa.RecordBatch.from_arrays(list(map(pa.array, held[0])), ["anchor", "slot", "score", "id"])
                        held, rows = [], 0
        if held:
            yield pa.RecordBatch.from_arrays(list(map(pa.array, best(held, k))), ["anchor", "slot", "score", "id"])

    return meet.mapInArrow(work, kinds)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """(anchor, slot, top): the ``k`` best of each anchor and slot as an array, best first."""
    order = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "id")
    top = found.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k)
    return top.groupBy("anchor", "slot").agg(F.array_sort(F.collect_list(F.struct("r", "score", "id"))).alias("top"))


def hard_negatives(
    df: DataFrame,
    is_anchor,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str | Column = "label",
    positives: int = 5,
    negatives: int = 5,
    low: int = 80,
    high: int = 100,
    scale: int = 256,
) -> DataFrame:
    """For each anchor and each of its positives, the best rows of other labels within a window below the positive.

    Positives are the first ``positives`` other rows of the anchor's label by integer inner
    product (ties to smaller ids); the window is low * p <= 100 * n <= high * p with p the
    positive's score and n the negative's.
    Returns (anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Rows without an id, a label or a vector, with an empty vector, or with a null or non-finite
    component take no part. Rows that repeat an id count once (the smallest by label, then vector). Rows of
    different lengths have no product and never meet. Fewer rows than asked for: all. A
    positive of negative score has an empty window. An empty table gives an empty result; other columns are ignored.
    """
    label = F.col(label_col) if isinstance(label_col, str) else label_col
    named = df.select(F.col(id_col).alias("id_"), F.col(vector_col).alias("v_"), label.alias("label_"))
    rows = write_scratch(usable(named, "id_", "v_", "label_", scale), "hardneg-rows")
    blocks = write_scratch(_packed(rows, BLOCK_ROWS), "hardneg-blocks")
    asking = rows.where(is_anchor(F.col("id")))
    sizes = rows.agg(F.count("*"), F.count_if(is_anchor(F.col("id")))).first()
    near = _ranked(_selected(_packed(asking, ANCHOR_ROWS), blocks, positives, *sizes), positives)
    near = write_scratch(near.select(F.col("anchor").alias("id"), F.col("top").alias("chosen")), "hardneg-positives")
    # The upper limits fall with the positives' scores: 100 * n <= high * p.
    scaled = lambda x: F.lit(high) * x["score"]
    limits = F.transform("chosen", lambda x: F.call_function("div", scaled(x) - F.pmod(scaled(x), F.lit(100)), F.lit(100)))
    limited = asking.join(near, "id").withColumn("limits", limits).select("id", "label", "v", "limits")
    slots = _ranked(_selected(_packed(limited, ANCHOR_ROWS), blocks, negatives, *sizes), negatives)
    by_anchor = slots.groupBy(F.col("anchor").alias("id")).agg(F.map_from_entries(F.collect_list(F.struct("slot", "top"))).alias("slots"))
    none = F.expr("cast(array() as array<struct<r:int,score:bigint,id:bigint>>)")
    merged: list[Column] = [none] * (positives + 1)
    out = near.join(by_anchor, "id")
    for j in reversed(range(positives)):
        # Slot j above the merged lower slots: both in falling order, so one concatenation orders them.
        out = out.withColumn(f"from_{j}", F.slice(F.concat(F.coalesce(F.try_element_at("slots", F.lit(j)), none), merged[j + 1]), 1, negatives))
        merged[j] = F.col(f"from_{j}")
    windows = F.transform("chosen", lambda p, j: F.struct(p["id"].alias("positive_id"), p["score"].alias("positive_score"), F.element_at(F.array(*merged[:positives]), j + 1).alias("top")))
    each = out.select(F.col("id").alias("anchor_id"), F.explode(windows).alias("w")).select("anchor_id", "w.*")
    inside = F.filter("top", lambda x: F.lit(low) * F.col("positive_score") <= F.lit(100) * x["score"])
    return each.select("anchor_id", "positive_id", "positive_score", F.posexplode(inside).alias("place", "n")).select(
        "anchor_id", "positive_id", (F.col("place") + 1).cast("int").alias("rank"), F.col("n.id").alias("negative_id"), "positive_score", F.col("n.score").alias("negative_score")
    )


def op11_hardneg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives for every row whose id is divisible by 100; the labels of every seventh id are moved on by one."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(read_table(spark, sf_dir, "embeddings"), lambda i: i % 100 == 0, label_col=label)


ORACLE_SQL = """
with rows_ as (
  select vec_id as id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v
  from embeddings where label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (
  select a.id as anchor, a.label <> b.label as other, b.id as id, cast(list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2])) as bigint) as score
  from rows_ a join rows_ b on a.id % 100 = 0 and a.id <> b.id),
positives as (select * from scored where not other qualify row_number() over (partition by anchor order by score desc, id) <= 5)
select p.anchor as anchor_id, p.id as positive_id, cast(row_number() over (partition by p.anchor, p.id order by n.score desc, n.id) as integer) as rank,
  n.id as negative_id, p.score as positive_score, n.score as negative_score
from positives p join scored n on n.anchor = p.anchor and n.other and 80 * p.score <= 100 * n.score and 100 * n.score <= 100 * p.score
qualify rank <= 5
"""
