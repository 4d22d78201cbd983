"""MinHash near-duplicates with tensored banding and exact confirmation.

*Sketch.* A document's set is its distinct word shingles. Two collections, A and B, of
``m`` short minhash groups each are computed, ``2 * m * r`` minhashes in all.

*Tensoring.* Table keys are all pairs (A_i, B_j): ``m * m`` tables out of ``2 * m``
groups. A pair of sets with similarity s shares a key unless no A or no B group
agrees, so it is missed with probability below ``2 * (1 - s**r)**m``: at s = 0.8, r = 3
and m = 18 this is 5e-6. Rows are shuffled by A_i alone, carrying their B groups, and
only rows whose A_i occurs twice pair up with the B_j inside their partition. So m, not
m * m, rows are shuffled for each distinct set.

*Confirm.* Links are confirmed on full sets, in two rounds. First, each key's members
meet the key's first member; three orders of ids take turns over the keys, so a document
meets a few centers. Members that are then not connected with the largest component of a
key of theirs are strays. Second, each stray meets every document of these keys that it
isn't connected with and with which it shares a rare shingle: two sets of the wanted
similarity have an overlap of at least ``o = ceil(s / (1 + s) * (n + m))``, so the first
shingle that they share, in any one order of all shingles, is among the first
``n - o + 1`` and ``m - o + 1``. This loses nothing, while documents that only share a common
passage don't meet. Their sketches must also agree in LEAST_AGREE groups, which
two sets of similarity 0.8 fail with a probability below 1e-5. A group of n near copies
so costs some n comparisons, not n * n.

*Group.* Components are the smallest id reachable over confirmed links.

Documents with equal sets are one class throughout (128-bit hash of the sorted set), with
a number of its own, so unlike texts that share an id stay apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewise.llm.common import drop_scratch, mix64, read_table, shingle_sets, word_groups, write_scratch

#: Groups in a collection (m) and minhashes in a group (r).
GROUPS, MINHASHES = 18, 3
#: Of all groups of two documents that are compared exhaustively, so many must agree.
LEAST_AGREE = 6
#: Cells in which the second round counts how frequent shingles are.
COUNTERS = 1 << 19
#: Lanes of a packed sketch: four of 15 bits in a 64-bit number.
_LANE, _LANES = 15, 4
_LOW, _HIGH = (sum(v << (_LANE * i) for i in range(_LANES)) for v in ((1 << (_LANE - 1)) - 1, 1 << (_LANE - 1)))


def _multipliers(count: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 2**63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _set_hashes(sets: np.ndarray, at: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """128 bits of each set, in two columns; ``at`` says where the sets begin, none is empty."""
    return np.stack([mix64(np.add.reduceat(mix64(sets + np.uint64(salt)), at) ^ counts.astype(np.uint64)) for salt in (0x9AE16A3B2F90404F, 0xC949D7C7509E6557)], axis=1)


def sketch_batch(texts: list[str | None], words: int, groups: int, minhashes: int, seed: int):
    """(set sizes, 128-bit set hashes as two columns, A groups, B groups as rows of integers)."""
    many = _multipliers(2 * groups * minhashes, seed)
    n = len(texts)
    size = np.zeros(n, np.int64)
    whole = np.zeros((n, 2), np.uint64)
    band = np.zeros((n, 2 * groups), np.uint64)
    for first, last, hashes, offsets in word_groups(texts):
        sets, bounds = shingle_sets(hashes, offsets, words)
        counts = np.diff(bounds)
        size[first:last] = counts
        full = np.flatnonzero(counts)
        if not len(full):
            continue
        at = bounds[:-1][full]
        whole[first + full] = _set_hashes(sets, at, counts[full])
        for g in range(2 * groups):
            acc = np.full(len(full), np.uint64(g + 1))
            for a in many[g * minhashes : (g + 1) * minhashes]:
                acc = mix64(acc * np.uint64(0xD6E8FEB86659FD93) + np.minimum.reduceat(sets * a, at))
            band[first + full, g] = acc
    return size, whole, band


def _lists(values: np.ndarray) -> pa.Array:
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * width, width, dtype=np.int32)), pa.array(values.reshape(-1)))


def packed(band: np.ndarray) -> np.ndarray:
    """Short forms of all groups, four to a number."""
    lanes = (band & np.uint64((1 << _LANE) - 1)).astype(np.int64)
    lanes = np.pad(lanes, ((0, 0), (0, -lanes.shape[1] % _LANES)))
    return sum(lanes[:, i::_LANES] << (_LANE * i) for i in range(_LANES))


def agreement(p: list, q: list):
    """In how many groups two packed sketches agree, as a column."""
    total = F.lit(0)
    for x, y in zip(p, q, strict=True):
        d = x.bitwiseXOR(y)
        nonzero = (d.bitwiseAND(F.lit(_LOW)) + F.lit(_LOW)).bitwiseOR(d).bitwiseAND(F.lit(_HIGH))
        total = total + F.lit(_LANES) - F.bit_count(nonzero)
    return total


def _sketches(docs: DataFrame, words: int, groups: int, minhashes: int, seed: int) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, whole, band = sketch_batch(b["text"].to_pylist(), words, groups, minhashes, seed)
            # A B group is a further key within an A key: 32 bits of it suffice.
            low = (band[:, groups:] >> np.uint64(32)).astype(np.uint32).view(np.int32)
            columns = [pa.array(size), pa.array(whole[:, 0].view(np.int64)), pa.array(whole[:, 1].view(np.int64)), _lists(band[:, :groups].view(np.int64)), _lists(low), _lists(packed(band))]
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["t"], *columns], ["doc_id", "t", "n", "h1", "h2", "a", "b", "lanes"])

    return docs.mapInArrow(work, "doc_id long, t long, n long, h1 long, h2 long, a array<long>, b array<int>, lanes array<long>")


def _full_sets(docs: DataFrame, words: int) -> DataFrame:
    """(id, elements): sorted distinct 64-bit shingle hashes, as bytes, of the rows of ``docs`` (id, h1, h2, text) whose set has the hash."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            wanted = np.stack([b["h1"].to_numpy(), b["h2"].to_numpy()], axis=1).view(np.uint64)
            for first, last, hashes, offsets in word_groups(b["text"].to_pylist()):
                sets, bounds = shingle_sets(hashes, offsets, words)
                counts = np.diff(bounds)
                full = np.flatnonzero(counts)
                full = full[(_set_hashes(sets, bounds[:-1][full], counts[full]) == wanted[first + full]).all(axis=1)] if len(full) else full
                yield pa.RecordBatch.from_arrays([b["id"].take(pa.array(first + full)), pa.array([sets[bounds[i] : bounds[i + 1]].tobytes() for i in full], pa.binary())], ["id", "elements"])

    return docs.mapInArrow(work, "id long, elements binary")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (x, y) whose full sets have 100 * intersection >= percent * union."""
    left = sets.select(F.col("id").alias("x"), F.col("elements").alias("ex"))
    right = sets.select(F.col("id").alias("y"), F.col("elements").alias("ey"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = np.zeros(b.num_rows, bool)
            for i, (ex, ey) in enumerate(zip(b["ex"], b["ey"], strict=True)):
                x, y = np.frombuffer(ex.as_buffer(), np.uint64), np.frombuffer(ey.as_buffer(), np.uint64)
                both = np.sort(np.concatenate([x, y]), kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                keep[i] = 100 * common >= percent * (len(x) + len(y) - common)
            mask = pa.array(keep)
            yield pa.RecordBatch.from_arrays([b["x"].filter(mask), b["y"].filter(mask)], ["x", "y"])

    return pairs.join(left, "x").join(right, "y").mapInArrow(work, "x long, y long")


def _rarest(sets: DataFrame, percent: int) -> DataFrame:
    """(id, shingle, place from 1): the first shingles of each set, rarest first, of which two similar sets share at least one.

    The order is the number of sets that hold the shingle, counted in COUNTERS cells, then
    its hash. Cells are summed in each task, so what is gathered is bounded by COUNTERS.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(COUNTERS, np.int64)
        for b in batches:
            for e in b["elements"]:
                np.add.at(cells, (np.frombuffer(e.as_buffer(), np.uint64) % np.uint64(COUNTERS)).astype(np.int64), 1)
        at = np.flatnonzero(cells)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(cells[at])], ["cell", "n"])

    cells = np.zeros(COUNTERS, np.int64)
    got = sets.select("elements").mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    cells[got["cell"].to_numpy()] = got["n"].to_numpy()
    shared = sets.sparkSession.sparkContext.broadcast(cells)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, out, place = [], [], []
            for i, e in zip(b["id"].to_pylist(), b["elements"], strict=True):
                x = np.frombuffer(e.as_buffer(), np.uint64)
                first = len(x) - -(-percent * len(x) // 100) + 1
                order = np.lexsort((x, shared.value[(x % np.uint64(COUNTERS)).astype(np.int64)]))[:first]
                out.append(x[order].view(np.int64))
                ids.append(np.full(len(order), i, np.int64))
                place.append(np.arange(1, len(order) + 1))
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (ids, out, place)], ["id", "shingle", "place"])

    return sets.mapInArrow(work, "id long, shingle long, place long")


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """(id, component) for the ids of ``links`` (x, y); component is the smallest id reachable.

    Each round every id takes the smallest id next to it, then its label's label, and the
    links are contracted to links between labels. A component's smallest id keeps itself,
    all others move to smaller ones, so links shrink fast; the loop ends when none is left.
    """
    spark = links.sparkSession
    edges = write_scratch(links.where("x != y").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).dropDuplicates(["x", "y"]), f"{name}-edges")
    total = None
    while not edges.isEmpty():
        both = edges.select("x", "y").unionByName(edges.select(F.col("y").alias("x"), F.col("x").alias("y")))
        near = both.groupBy(F.col("x").alias("id")).agg(F.least(F.min("y"), F.col("x")).alias("l"))
        near = write_scratch(near, f"{name}-near")
        label = near.select("id", "l").join(near.select(F.col("id").alias("l"), F.col("l").alias("far")), "l").select("id", F.col("far").alias("l"))
        label = write_scratch(label, f"{name}-label")
        at = lambda key: label.select(F.col("id").alias(key), F.col("l").alias(f"l{key}"))  # noqa: E731, B023
        left = edges.join(at("x"), "x").join(at("y"), "y").where("lx != ly").select(F.least("lx", "ly").alias("x"), F.greatest("lx", "ly").alias("y")).dropDuplicates(["x", "y"])
        left = write_scratch(left, f"{name}-edges")
        if total is None:
            total = label.select("id", F.col("l").alias("component"))
        else:
            moved = label.select(F.col("id").alias("component"), "l")
            total = write_scratch(total.join(moved, "component", "left").select("id", F.coalesce("l", "component").alias("component")), f"{name}-total")
        drop_scratch(edges)
        drop_scratch(near)
        edges = left
    return total if total is not None else spark.createDataFrame([], "id long, component long")


def near_duplicates(
    docs: DataFrame,
    words: int = 5,
    percent: int = 80,
    groups: int = GROUPS,
    minhashes: int = MINHASHES,
    seed: int = 11,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``docs`` with an id.

    Texts are lower-cased (A-Z only) and cut at ASCII white space. Documents are linked
    if 100 * intersection >= percent * union of their distinct ``words``-word shingles; a
    text of fewer words has its whole sequence as its one shingle, and one without words,
    or null, has none and is its own component. component_id is the smallest id
    reachable, kept says that it is the row's own. Rows that repeat an id are linked by
    their texts alone and are all returned; rows with a null id are left out, as they can't
    be named. An empty table gives an empty result; other columns are ignored.
    """
    out, _ = _grouped(docs, words, percent, groups, minhashes, seed, id_col, text_col)
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


def _grouped(docs: DataFrame, words: int, percent: int, groups: int, minhashes: int, seed: int, id_col: str, text_col: str) -> tuple[DataFrame, bool]:
    """(doc_id, t, n, h1, h2, component_id, first) for each row, and whether ids repeat.

    ``t`` is a hash of the text, ``first`` says that the row's set is the one that stands for its component.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where(F.col("doc_id").isNotNull())
    sketches = write_scratch(_sketches(source.withColumn("t", F.xxhash64("text")), words, groups, minhashes, seed), "dup-sketches")
    repeats = not sketches.groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1").isEmpty()
    # One member for each distinct set: partial minima, so the largest class of copies is one row a task.
    classes = sketches.where("n > 0").groupBy("h1", "h2").agg(F.min("doc_id").alias("doc_id"), F.min_by(F.struct("n", "a", "b", "lanes"), "doc_id").alias("s"))
    classes = write_scratch(classes.select("h1", "h2", "doc_id", "s.*").withColumn("id", F.monotonically_increasing_id()), "dup-classes")

    fits = lambda p, q: 100 * F.least(p, q) >= percent * F.greatest(p, q)  # noqa: E731  sizes alone rule the others out
    # Documents that share some A_i; only they carry their B groups on.
    narrow = classes.select("id", F.posexplode("a").alias("i", "ai")).select("id", "i", F.xxhash64("i", "ai").alias("akey"))
    narrow = narrow.join(narrow.groupBy("akey").agg(F.count("*").alias("c")).where("c > 1"), "akey", "left_semi")
    keyed = narrow.join(classes.select("id", "n", "b"), "id").select("akey", "i", F.posexplode("b").alias("j", "bj"), "id", "n")
    keyed = keyed.select(F.xxhash64("akey", "j", "bj").alias("key"), F.pmod("i", F.lit(3)).alias("turn"), "id", "n")
    order = F.when(F.col("turn") == 0, F.col("id")).otherwise(F.xxhash64("id", "turn"))
    centers = keyed.groupBy("key").agg(F.count("*").alias("c"), F.min_by(F.struct("id", "n"), order).alias("center")).where("c > 1").select("key", "center")
    keys = write_scratch(keyed.join(centers, "key").select("key", "id", "n", "center"), "dup-keys")
    wanted = classes.select("id", "doc_id", "h1", "h2").join(keys.select("id").dropDuplicates(), "id", "left_semi")
    sets = _full_sets(source.join(wanted, "doc_id").select("id", "h1", "h2", "text"), words)
    sets = write_scratch(sets.dropDuplicates(["id"]) if repeats else sets, "dup-sets")

    def ordered(pairs: DataFrame, x, y, name: str) -> DataFrame:
        return write_scratch(pairs.select(F.least(x, y).alias("x"), F.greatest(x, y).alias("y")).dropDuplicates(["x", "y"]), name)

    first = ordered(keys.where((F.col("id") != F.col("center.id")) & fits(F.col("n"), F.col("center.n"))), F.col("id"), F.col("center.id"), "dup-pairs")
    links = write_scratch(_confirmed(first, sets, percent), "dup-links")

    # Keys' members with their labels, and the main label, that of the largest component, of keys where labels differ.
    label = components(links, "dup")
    label = write_scratch(label.join(label.groupBy("component").agg(F.count("*").alias("many")), "component").select("id", F.col("component").alias("label"), "many"), "dup-label")
    member = keys.select("key", "id", "n").join(label, "id", "left").select("key", "id", "n", F.coalesce("label", "id").alias("label"), F.coalesce("many", F.lit(1)).alias("many"))
    main = member.groupBy("key").agg(F.max_by("label", F.struct("many", "label")).alias("main"), F.min("label").alias("lo"), F.max("label").alias("hi"))
    main = main.where("lo != hi").select("key", "main")
    mixed = member.join(main, "key").groupBy("id").agg(F.max((F.col("label") != F.col("main")).cast("int")).alias("stray"), F.first("label").alias("label"))
    mixed = write_scratch(mixed.join(classes.select("id", "n", *[F.get("lanes", F.lit(i)).alias(f"s{i}") for i in range(-(-2 * groups // _LANES))]), "id"), "dup-mixed")
    lanes = mixed.columns[4:]
    rare = _rarest(sets.join(mixed.select("id"), "id", "left_semi"), percent).join(mixed, "id")
    stray = rare.where("stray = 1").select("shingle", *[F.col(c).alias(f"x_{c}") for c in ("id", "n", "label", "place", *lanes)])
    overlap = F.ceil(percent * (F.col("n") + F.col("x_n")) / (100 + percent))
    second = stray.join(rare, "shingle").where(
        (F.col("label") != F.col("x_label"))
        & fits(F.col("n"), F.col("x_n"))
        & (F.col("place") <= F.col("n") - overlap + 1)
        & (F.col("x_place") <= F.col("x_n") - overlap + 1)
        & ((F.col("stray") == 0) | (F.col("x_id") < F.col("id")))
        & (agreement([F.col(f"x_{c}") for c in lanes], [F.col(c) for c in lanes]) >= LEAST_AGREE + -2 * groups % _LANES)
    )
    second = ordered(second, F.col("id"), F.col("x_id"), "dup-pairs").join(first, ["x", "y"], "left_anti")
    # The second round's links join the first one's components.
    more = _confirmed(second, sets, percent)
    for end in ("x", "y"):
        more = more.join(label.select(F.col("id").alias(end), F.col("label").alias(f"l{end}")), end, "left").withColumn(f"l{end}", F.coalesce(f"l{end}", end))
    merged = components(more.select(F.col("lx").alias("x"), F.col("ly").alias("y")), "dup-merged")
    grouped = classes.select("h1", "h2", "doc_id", "id").join(label, "id", "left").select("h1", "h2", "doc_id", F.coalesce("label", "id").alias("label"))
    grouped = grouped.join(merged.withColumnRenamed("id", "label"), "label", "left").select("h1", "h2", "doc_id", F.coalesce("component", "label").alias("component"))
    low = grouped.groupBy("component").agg(F.min(F.struct("doc_id", "h1", "h2")).alias("low"))
    grouped = grouped.join(low, "component").select("h1", "h2", F.col("low.doc_id").alias("component_id"), ((F.col("low.h1") == F.col("h1")) & (F.col("low.h2") == F.col("h2"))).alias("first"))
    out = sketches.select("doc_id", "t", "n", "h1", "h2").withColumns({"h1": F.when(F.col("n") > 0, F.col("h1")), "h2": F.when(F.col("n") > 0, F.col("h2"))})
    out = out.join(grouped, ["h1", "h2"], "left").withColumns({"component_id": F.coalesce("component_id", "doc_id"), "first": F.coalesce("first", F.lit(True))})
    return out, repeats


def op4_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents on two-word shingles."""
    return near_duplicates(read_table(spark, sf_dir, "documents"), words=2)


def deduplicated(docs: DataFrame) -> DataFrame:
    """One document of each near-duplicate group (five-word shingles), with its columns unchanged.

    Unlike texts under one id are documents of their own. Of rows that repeat the kept id
    and text one stays; rows with a null id stay.
    """
    out, repeats = _grouped(docs, 5, 80, GROUPS, MINHASHES, 11, "doc_id", "text")
    kept = out.where("first and doc_id = component_id").select("doc_id", "t", "h1", "h2")
    named = docs.where(F.col("doc_id").isNotNull())
    if not repeats:
        one = kept.select(F.col("doc_id").alias("kept"))
        named = named.join(one, named["doc_id"] == one["kept"], "left_semi")
    else:
        # One text for each id and set, and all texts without words.
        one = kept.where("h1 is not null").groupBy("doc_id", "h1", "h2").agg(F.min("t").alias("t")).select("doc_id", "t")
        one = one.unionByName(kept.where("h1 is null").select("doc_id", "t")).dropDuplicates().select(F.col("doc_id").alias("kept"), F.col("t").alias("kept_t"))
        t = "_t"
        while t in docs.columns:
            t += "_"  # a name that no column has
        named = named.withColumn(t, F.xxhash64("text"))
        named = named.join(one, (named["doc_id"] == one["kept"]) & (named[t] == one["kept_t"]), "left_semi").dropDuplicates(["doc_id", t]).drop(t)
    return named.unionByName(docs.where(F.col("doc_id").isNull()))
