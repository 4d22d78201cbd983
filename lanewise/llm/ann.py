"""Approximate nearest neighbours: a forest of random-projection trees over Spark.

*Fit.* Each tree is a complete binary tree whose inner nodes split a bounded
sample at the median of its projection on the line between two random sample
points. The sample's size is a parameter; the forest is a few MB whatever the
table's size and is the only thing that is shipped to every task.

*Index.* Every row descends every tree and becomes a member of one leaf in each.
The rows of a leaf are packed into blocks of bounded size, and a leaf of any size
is dealt over tasks by salt.

*Search.* One priority queue is shared by all trees: a subtree's priority falls by the
square of each margin that the way to it crosses, so the queue pops leaves, over all
trees, in order of how far they are off. For a block of queries at once this is a
running sum down each level and a selection of the largest values over the leaves of
all trees together; the tests compare it with a heap. How many leaves are popped follows
from the wanted recall, which is measured on the sample: data of low intrinsic dimension
need few leaves, directions that are spread evenly over 64 dimensions about a third.

*Rerank.* Queries meet the popped leaves' blocks by an equality join; the exact
inner products of original vectors, in double precision, choose the nearest. Each
query brings a floor: the ``k + 1``-th largest score of the sample rows that lie in
leaves it pops. They are met in the join too, so what scores less can't be among the
nearest found, and tasks hand on few partial results however many there are.

Inner product is turned into an angle by one more coordinate that makes all rows
equally long (zero in a query), so vectors need no normalisation.

Equal vectors are one point of the index: their scores are equal, so no result
can hold more of them than its own length, and the smallest ids win ties. The
``k + 1`` smallest ids of each distinct vector hence give whole results, and a
vector that a third of all rows hold costs no more than another.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lanewise.llm.common import read_table, write_scratch

#: Rows of the sample that the forest is fitted on, at most, and of those that ask when recall is measured on it.
SAMPLE_ROWS, SAMPLE_QUERIES = 32_768, 512
#: Levels of a tree at least, where the sample has four rows for each leaf.
LEAST_DEPTH = 4
#: Rows of a packed block, at most.
BLOCK_ROWS = 2_048
#: Blocks of each part that a leaf is dealt over, about.
SALT_BLOCKS = 8
#: Rows of the sample that floors are taken from: so many, or a sixteenth of all points where that is more.
FLOOR_ROWS = 8_192
#: Rows of partial results that a task holds, at most.
BUFFER_ROWS = 1_000_000


class Forest:
    """Complete random-projection trees of one depth, fitted on sample rows."""

    def __init__(self, sample: np.ndarray, trees: int, depth: int, seed: int):
        rng = np.random.default_rng(seed)
        self.trees, self.depth = trees, depth
        inner = (1 << self.depth) - 1
        d = sample.shape[1]
        self.normals = np.zeros((trees, inner, d), np.float32)
        self.cuts = np.zeros((trees, inner), np.float32)
        for t in range(trees):
            members = {0: np.arange(len(sample))}
            for node in range(inner):
                rows = members.pop(node)
                here = sample[rows]
                normal = rng.standard_normal(d)
                if len(rows) >= 2:
                    a, b = rng.choice(len(rows), 2, replace=False)
                    if (gap := here[a] - here[b]).any():
                        normal = gap
                normal = (normal / np.linalg.norm(normal)).astype(np.float32)
                side = here @ normal
                cut = np.float32(np.median(side)) if len(rows) else np.float32(0)
                self.normals[t, node], self.cuts[t, node] = normal, cut
                members[2 * node + 1], members[2 * node + 2] = rows[side < cut], rows[side >= cut]

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row in each tree, as rows x trees; numbered over the whole forest."""
        out = np.empty((len(x), self.trees), np.int32)
        for t in range(self.trees):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                margin = np.einsum("nd,nd->n", x, self.normals[t][node]) - self.cuts[t][node]
                node = 2 * node + 1 + (margin >= 0)
            out[:, t] = node - ((1 << self.depth) - 1) + (t << self.depth)
        return out

    def priorities(self, x: np.ndarray) -> np.ndarray:
        """The priority of each leaf of the forest, for each row."""
        priority = np.empty((len(x), self.trees, 1 << self.depth), np.float32)
        for t in range(self.trees):
            margins = x @ self.normals[t].T - self.cuts[t] if self.depth else np.empty((len(x), 0), np.float32)
            level = np.zeros((len(x), 1), np.float32)
            for h in range(self.depth):
                m = margins[:, (1 << h) - 1 : (2 << h) - 1]
                crossed = np.minimum(np.stack([-m, m], axis=2).reshape(len(x), -1), 0)
                level = np.repeat(level, 2, axis=1) - crossed * crossed
            priority[:, t] = level
        return priority.reshape(len(x), -1)

    def popped(self, x: np.ndarray, probes: int) -> np.ndarray:
        """The leaves that a priority queue over all trees pops first, for each row."""
        flat = self.priorities(x)
        probes = min(probes, flat.shape[1])
        return np.argpartition(-flat, probes - 1, axis=1)[:, :probes].astype(np.int32)

    def probes_for(self, sample: np.ndarray, rows: np.ndarray, queries: np.ndarray, k: int, recall: float) -> int:
        """How many leaves are popped until the wanted share of the ``k`` nearest sample rows of the sample rows ``queries`` has been met.

        ``sample`` are the original vectors, ``rows`` the lengthened ones.
        """
        leaf = self.leaves(rows)
        needed = []
        for lo in range(0, len(queries), 64):
            q = queries[lo : lo + 64]
            score = sample[q] @ sample.T
            score[np.arange(len(q)), q] = -np.inf
            top = min(k, len(sample) - 1)
            near = np.argpartition(-score, top - 1, axis=1)[:, :top]
            order = np.argsort(-self.priorities(directions(sample[q])), axis=1, kind="stable")
            place = np.empty_like(order)
            np.put_along_axis(place, order, np.arange(order.shape[1])[None], axis=1)
            needed.append(place[np.arange(len(q))[:, None, None], leaf[near]].min(axis=2).ravel())
        needed = np.sort(np.concatenate(needed))
        return int(needed[math.ceil(recall * len(needed)) - 1]) + 1


def floors(sample: np.ndarray, leaf: np.ndarray, q: np.ndarray, popped: np.ndarray, leaves: int, k: int) -> np.ndarray:
    """For each query the ``k``-th largest score of the sample rows that lie in leaves it pops, less what rounding can make; -inf where there are fewer.

    ``leaf``: the leaves of each sample row; ``popped``: those of each query.
    """
    if len(sample) < k:
        return np.full(len(q), -np.inf)
    opened = np.zeros((len(q), leaves), bool)
    np.put_along_axis(opened, popped, True, axis=1)
    met = np.zeros((len(q), len(sample)), bool)
    for t in range(leaf.shape[1]):
        met |= opened[:, leaf[:, t]]
    sample, q = sample.astype(np.float64), q.astype(np.float64)
    score = np.where(met, q @ sample.T, -np.inf)
    longest = np.sqrt((sample * sample).sum(axis=1).max())
    return np.partition(score, len(sample) - k, axis=1)[:, len(sample) - k] - 1e-12 * longest * np.sqrt((q * q).sum(axis=1))


def lengthened(x: np.ndarray, longest: float) -> np.ndarray:
    """Rows with one more coordinate, equally long, then scaled to length one."""
    x = x.astype(np.float64)
    rest = np.sqrt(np.maximum(longest**2 - (x * x).sum(axis=1), 0))
    return (np.column_stack([x, rest]) / longest).astype(np.float32)


def directions(x: np.ndarray) -> np.ndarray:
    """Queries as directions, with zero as the further coordinate."""
    x = x.astype(np.float64)
    return np.column_stack([x / np.linalg.norm(x, axis=1, keepdims=True), np.zeros(len(x))]).astype(np.float32)


def inner_products(query: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products of paired rows in double precision, summed in one fixed order."""
    return (query.astype(np.float64) * rows.astype(np.float64)).sum(axis=1)


def _vectors(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 1))


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v): rows with an id whose vector has no null or non-finite component and isn't zero."""
    v = F.col("v")
    return (
        df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"))
        .where(F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0))
        .where(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))))
        .where(F.exists(v, lambda x: x != 0))
    )


def nearest_neighbours(
    df: DataFrame,
    is_query,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = 20,
    trees: int = 4,
    leaf_rows: int = 1_600,
    recall: float = 0.96,
    sample_rows: int = SAMPLE_ROWS,
    seed: int = 7,
) -> DataFrame:
    """The ``k`` nearest of all other rows for each row of ``df`` that ``is_query`` (a condition on vec_id) chooses.

    Returns (query_id, rank from 1, vec_id, score), ties by smaller vec_id. Null
    ids and unusable vectors (null, empty, zero, null or non-finite components)
    take no part; vectors of another length than the most frequent one take no part
    either, as no inner product with them is defined. Of rows that repeat an id one
    counts, that with the smallest vector in array order. Fewer than ``k`` others: all
    that were found. An empty table gives an empty result. Other columns are ignored.
    Trees have leaves of about ``leaf_rows`` rows, and LEAST_DEPTH levels at least; they have no more than
    a leaf for four sample rows, so beyond ``leaf_rows * sample_rows / 4`` rows leaves grow with the
    table, and are dealt over the more tasks. The recall that decides how many leaves are popped is measured on the sample.
    """
    spark = df.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    rows = usable(df, id_col, vector_col)
    lengths = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    if lengths is None:
        return spark.createDataFrame([], schema)
    rows = rows.where(F.size("v") == lengths["d"])
    one = F.row_number().over(Window.partitionBy("vec_id").orderBy("v"))
    single = lambda df: df.withColumn("one", one).where("one = 1").select("vec_id", "v")
    # Of each distinct vector the k + 1 smallest ids: the group limit acts before the shuffle, so a hot vector is cut down in each task.
    by_vector = Window.partitionBy("v", "asks").orderBy("vec_id")
    points = (
        single(rows)
        .withColumn("asks", is_query(F.col("vec_id")))
        .withColumn("place", F.row_number().over(by_vector))
        .where(F.col("place") <= k + 1)
        .groupBy("v")
        .agg(F.slice(F.array_sort(F.collect_list("vec_id")), 1, k + 1).alias("ids"), F.max("asks").alias("asks"))
        .withColumn("point", F.col("ids")[0])
    )
    points = write_scratch(points, "ann-points")
    kind = "float" if dict(df.dtypes)[vector_col] == "array<float>" else "double"
    if kind == "double":
        points = points.withColumn("v", F.col("v").cast("array<double>"))
    size = np.dtype(np.float32 if kind == "float" else np.float64)
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    stats = points.agg(F.max(norm).alias("longest"), F.count("*").alias("n")).first()
    longest, n = stats["longest"] * (1 + 1e-9), stats["n"]
    sample = points.select("v", F.xxhash64("point", F.lit(seed)).alias("h")).orderBy("h").limit(sample_rows).drop("h").toArrow()
    # A row of the sample for each leaf at least; four where there are more.
    most = math.floor(math.log2(max(1, sample.num_rows / 4)))
    depth = min(most, max(LEAST_DEPTH, math.floor(math.log2(max(1, n / leaf_rows)))))
    vectors = _vectors(sample["v"])
    lengthy = lengthened(vectors, longest)
    forest = Forest(lengthy, trees, depth, seed)
    probes = trees << depth
    if sample.num_rows > 1:
        queries = np.random.default_rng(seed).permutation(sample.num_rows)[:SAMPLE_QUERIES]
        probes = forest.probes_for(vectors.astype(np.float64), lengthy, queries, k, recall)
    few = slice(max(FLOOR_ROWS, n // 16))
    shared = spark.sparkContext.broadcast((forest, longest, probes, vectors[few], forest.leaves(lengthy[few])))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, longest, *_ = shared.value
        for b in batches:
            if b.num_rows:
                leaf = forest.leaves(lengthened(_vectors(b["v"]), longest))
                at = np.repeat(np.arange(b.num_rows), forest.trees)
                yield pa.RecordBatch.from_arrays([pa.array(leaf.reshape(-1)), b["point"].take(pa.array(at)), b["v"].take(pa.array(at))], ["leaf", "point", "v"])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, _, probes, sample, lie = shared.value
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                x = _vectors(part["v"])
                leaf = forest.popped(directions(x), probes)
                least = floors(sample, lie, x, leaf, forest.trees << forest.depth, k + 1)
                at = np.repeat(np.arange(part.num_rows), leaf.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(leaf.reshape(-1)), part["point"].take(pa.array(at)), part["v"].take(pa.array(at)), pa.array(least[at])], ["leaf", "point", "v", "least"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted rows of (leaf, point, v) to blocks of (leaf, points, vectors) of bounded size; a query's floors go along."""
        held: dict[int, list] = {}
        for b in batches:
            leaf, point, v = b["leaf"].to_numpy(), b["point"].to_numpy(), _vectors(b["v"])
            least = [b["least"].to_numpy()] if "least" in b.schema.names else []
            cuts = np.flatnonzero(np.diff(leaf)) + 1
            for lo, hi in zip(np.r_[0, cuts], np.r_[cuts, len(leaf)], strict=True):
                key = int(leaf[lo])
                for other in [x for x in held if x != key]:
                    yield from _blocks(other, held.pop(other))
                held.setdefault(key, []).append([x[lo:hi] for x in (point, v, *least)])
                if sum(len(p) for p, *_ in held[key]) >= BLOCK_ROWS:
                    yield from _blocks(key, held.pop(key))
        for key, parts in held.items():
            yield from _blocks(key, parts)

    packed = "leaf int, points array<long>, vectors binary"
    placed = points.mapInArrow(place, f"leaf int, point long, v array<{kind}>")
    # A leaf is dealt over several tasks: no leaf, however large, is one task's.
    blocks = placed.repartition(F.col("leaf"), F.pmod(F.xxhash64("point"), F.lit(4))).sortWithinPartitions("leaf").mapInArrow(pack, packed)
    asked = points.where("asks").select("point", "v").mapInArrow(ask, f"leaf int, point long, v array<{kind}>, least double")
    asked = asked.repartition(F.col("leaf"), F.pmod(F.xxhash64("point"), F.lit(4))).sortWithinPartitions("leaf").mapInArrow(pack, f"{packed}, least binary")
    # A leaf's blocks are dealt over salts, and each block of its queries goes to all of them: no leaf is one task's in the join either.
    salts = max(1, math.ceil((n >> depth) / (SALT_BLOCKS * BLOCK_ROWS)))
    salted = blocks.withColumn("salt", F.pmod(F.xxhash64("points"), F.lit(salts)).cast("int"))
    queries = asked.select("leaf", F.col("points").alias("q"), F.col("vectors").alias("qv"), "least", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    meet = salted.join(queries, ["leaf", "salt"])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each query's nearest points in this task's leaves: partial results are merged in a buffer of bounded size."""
        held: list[tuple] = []
        rows = 0
        for b in batches:
            for points, vectors, q, qv, ql in zip(*(b[c] for c in ("points", "vectors", "q", "qv", "least")), strict=True):
                ids, queries = points.values.to_numpy(), q.values.to_numpy()
                x = np.frombuffer(vectors.as_py(), size).reshape(len(ids), -1).astype(np.float64)
                y = np.frombuffer(qv.as_py(), size).reshape(len(queries), -1).astype(np.float64)
                floor = np.frombuffer(ql.as_py(), np.float64)
                longest = np.sqrt((x * x).sum(axis=1).max())
                for lo in range(0, len(y), 256):
                    part = y[lo : lo + 256]
                    rough = part @ x.T
                    top = min(len(ids), k + 1)
                    # All that reach the last place but for rounding: ties go to the smaller id, whatever its place here.
                    least = np.partition(rough, len(ids) - top, axis=1)[:, len(ids) - top] - 1e-12 * longest * np.sqrt((part * part).sum(axis=1))
                    at, best = np.nonzero(rough >= np.maximum(least, floor[lo : lo + 256])[:, None])
                    exact = np.concatenate([inner_products(part[at[i : i + BLOCK_ROWS]], x[best[i : i + BLOCK_ROWS]]) for i in range(0, max(1, len(at)), BLOCK_ROWS)])
                    new = (queries[lo + at], ids[best], exact)
                    held.append(nearest([new], k + 1) if len(at) > top * len(part) else new)
                    rows += len(held[-1][0])
                if rows > BUFFER_ROWS:
                    held = [nearest(held, k + 1)]
                    rows = len(held[0][0])
                    if rows > BUFFER_ROWS // 2:
                        yield pa.RecordBatch.from_arrays(list(map(pa.array, held[0])), ["query", "point", "score"])
                        held, rows = [], 0
        if held:
            yield pa.RecordBatch.from_arrays(list(map(pa.array, nearest(held, k + 1))), ["query", "point", "score"])

    found = meet.mapInArrow(score, "query long, point long, score double").dropDuplicates(["query", "point"])
    by_query = Window.partitionBy("query").orderBy(F.desc("score"), "point")
    found = found.withColumn("r", F.row_number().over(by_query)).where(F.col("r") <= k + 1)
    # Points to the ids that hold them, still nearest first and ties by id.
    members = points.select("point", "ids")
    listed = (
        found.join(members, "point")
        .select("query", "score", F.explode("ids").alias("vec_id"))
        .withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")))
        .where(F.col("r") <= k + 1)
        .groupBy("query")
        .agg(F.array_sort(F.collect_list(F.struct("r", "vec_id", "score"))).alias("near"))
    )
    # All rows that ask, also those beyond the ids kept for a point.
    asking = single(rows.where(is_query(F.col("vec_id")))).join(points.select("v", "point"), "v").select(F.col("vec_id").alias("query_id"), F.col("point").alias("query"))
    return (
        asking.join(listed, "query")
        .select("query_id", F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k).alias("near"))
        .select("query_id", F.posexplode("near").alias("place", "x"))
        .select("query_id", (F.col("place") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))
    )


def nearest(parts: list[tuple], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of (query, point, score) rows each query's ``k`` best distinct points, ties to smaller ids."""
    query, point, score = map(np.concatenate, zip(*parts, strict=True))
    order = np.lexsort((point, -score, query))
    query, point, score = query[order], point[order], score[order]
    keep = np.ones(len(query), bool)
    keep[1:] = (query[1:] != query[:-1]) | (point[1:] != point[:-1])  # a point's score is the same wherever it was met
    query, point, score = query[keep], point[keep], score[keep]
    first = np.searchsorted(query, query)
    keep = np.arange(len(query)) - first < k
    return query[keep], point[keep], score[keep]


def _blocks(leaf: int, parts: list) -> Iterator[pa.RecordBatch]:
    ids, *columns = map(np.concatenate, zip(*parts, strict=True))
    names = ["leaf", "points", "vectors", "least"][: 2 + len(columns)]
    for lo in range(0, len(ids), BLOCK_ROWS):
        yield pa.RecordBatch.from_arrays([pa.array([leaf], pa.int32()), pa.array([ids[lo : lo + BLOCK_ROWS].tolist()], pa.list_(pa.int64())), *[pa.array([x[lo : lo + BLOCK_ROWS].tobytes()], pa.binary()) for x in columns]], names)


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of all other rows, for every row whose id is divisible by 20."""
    return nearest_neighbours(read_table(spark, sf_dir, "embeddings"), lambda i: i % 20 == 0)
