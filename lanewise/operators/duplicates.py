"""Exact and near duplicates by 64-bit fingerprints, groups, splits and leakage checks."""

from __future__ import annotations

import hashlib
import itertools
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from lanewise.functions import hamming
from lanewise.functions.geometry import hamming64
from lanewise.operators.storage import dropped, fresh_path, saved  # noqa: F401


def exact_duplicates(rows: DataFrame) -> DataFrame:
    """``rows`` (id, sha) with the size of each exact group; sizes are aggregated before they are joined, so a hot group is a row."""
    return rows.join(rows.groupBy("sha").agg(F.count("*").alias("exact_group_size")), "sha")


def _blocks(threshold: int, n: int) -> tuple[list[int], int]:
    """(blocks of the 64 bits as masks, how many must agree) for prints within the threshold among ``n``; see :func:`block_masks`."""

    def cost(blocks: int) -> float:
        keys = math.comb(blocks, blocks - threshold)
        return keys * (1 + n / 2.0 ** (64 * (blocks - threshold) / blocks))

    blocks = min(range(threshold + 1, min(64, threshold + 7) + 1), key=cost)
    edges = [64 * i // blocks for i in range(blocks + 1)]
    return [((1 << hi) - 1) ^ ((1 << lo) - 1) for lo, hi in itertools.pairwise(edges)], blocks - threshold


def block_masks(threshold: int, n: int) -> list[int]:
    """Masks over 64 bits such that two prints within the threshold agree under at least one.

    The bits are cut into blocks, of which at most ``threshold`` differ; a mask takes as
    many blocks as must then agree. More blocks mean more, but longer, keys: the number is
    the one with the least keys and expected chance candidates for a row among ``n``.
    """
    parts, agree = _blocks(threshold, n)
    return [sum(c) for c in itertools.combinations(parts, agree)]


def _signed(masks: list[int]) -> list[int]:
    return [m - (1 << 64) if m >= 1 << 63 else m for m in masks]


def _passed_over(threshold: int, n: int) -> np.ndarray:
    """For each mask the blocks before its last one that it leaves out. Masks are in the order of their blocks, so two prints that agree under it do so under no earlier mask exactly if these all differ."""
    parts, agree = _blocks(threshold, n)
    rows = [[parts[i] for i in range(c[-1]) if i not in c] for c in itertools.combinations(range(len(parts)), agree)]
    return np.array([r + [(1 << 64) - 1] * (threshold - len(r)) for r in rows], np.uint64).reshape(len(rows), threshold)


#: Prints of one key that are compared with each other in one step, and rows of keys for each task, about.
KEY_BLOCK, KEY_ROWS = 4_096, 250_000


def _packed(prints: DataFrame, held: list[str], masks: list[int], tasks: int) -> DataFrame:
    """(bits, mask, block, blocks, lists): the prints with the same bits under a mask, and the columns ``held`` of them, as lists of KEY_BLOCK prints at most. Keys of one print meet nothing and are left out.

    A print has a row for each mask, which Spark's estimate of a table's size leaves out: rows are dealt to a fixed number of tasks before they get their keys, and after.
    """
    lists = ["print", *held]
    schema = pa.schema([("bits", pa.int64()), ("mask", pa.int32()), ("block", pa.int32()), ("blocks", pa.int32()), *[(c, pa.list_(pa.int64())) for c in lists]])

    def packed(columns: list[np.ndarray]) -> pa.RecordBatch:
        bits, mask = columns[:2]
        begin = np.flatnonzero(np.r_[True, (bits[1:] != bits[:-1]) | (mask[1:] != mask[:-1])])
        sizes = np.diff(np.r_[begin, len(bits)])
        several = np.repeat(sizes > 1, sizes)
        begin, sizes = begin[sizes > 1], sizes[sizes > 1]
        blocks = -(-sizes // KEY_BLOCK)
        block = np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        offsets = pa.array(np.r_[np.repeat(np.cumsum(sizes) - sizes, blocks) + block * KEY_BLOCK, sizes.sum()].astype(np.int32))
        of = np.repeat(begin, blocks)
        arrays = [pa.array(bits[of]), pa.array(mask[of]), pa.array(block.astype(np.int32)), pa.array(np.repeat(blocks, blocks).astype(np.int32))]
        return pa.RecordBatch.from_arrays([*arrays, *[pa.ListArray.from_arrays(offsets, pa.array(c[several])) for c in columns[2:]]], schema=schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: list[list[np.ndarray]] = []  # parts of the key that the next batch may go on with
        together = lambda: [np.concatenate(c) for c in zip(*open_, strict=True)]
        for b in batches:
            if not b.num_rows:
                continue
            columns = [b[c].to_numpy() for c in ("bits", "mask", *lists)]
            bits, mask = columns[:2]
            ends = [*(np.flatnonzero((bits[1:] != bits[:-1]) | (mask[1:] != mask[:-1])) + 1).tolist(), b.num_rows]
            done = 0
            if open_ and (open_[-1][0][-1], open_[-1][1][-1]) == (bits[0], mask[0]):
                done = ends.pop(0)
                open_.append([c[:done] for c in columns])
            if ends:
                if open_:
                    yield packed(together())
                last = ends[-2] if len(ends) > 1 else done
                if last > done:
                    yield packed([c[done:last] for c in columns])
                open_ = [[c[last:] for c in columns]]
        if open_:
            yield packed(together())

    keys = F.posexplode(F.transform(F.array(*map(F.lit, _signed(masks))), lambda m: m.bitwiseAND(F.col("print")))).alias("mask", "bits")
    keyed = prints.select(*lists).repartition(tasks).select(*lists, keys)
    types = "bits long, mask int, block int, blocks int, " + ", ".join(f"{c} array<long>" for c in lists)
    return keyed.repartition(tasks, "bits", "mask").sortWithinPartitions("bits", "mask", "print").mapInArrow(work, types)


def _met(prints: DataFrame, held: list[str], threshold: int, of_pairs, types: str) -> DataFrame:
    """What ``of_pairs`` makes of the prints that agree under a mask: distinct prints (``print``, and the longs ``held``).

    Keys are lists of prints, compared in vector operations. The lists of a crowded key meet each other in all pairs, by an
    equality join over as many tasks; they are merged, never broadcast. ``of_pairs`` takes the masks' numbers, the
    columns, and for each key the place and length of its prints, or for a pair of lists of one key those of both.
    """
    n = prints.count()
    masks = block_masks(threshold, n)
    tasks = max(3 * prints.sparkSession.sparkContext.defaultParallelism, n * len(masks) // KEY_ROWS)
    lists, at = ["print", *held], ["bits", "mask", "other"]
    keys = saved(_packed(prints, held, masks, tasks), "keys")
    left = keys.withColumn("other", F.explode(F.sequence("block", F.col("blocks") - 1)))
    right = keys.where("block > 0").select("bits", "mask", F.col("block").alias("other"), *[F.col(c).alias(f"o_{c}") for c in lists])
    # No fewer tasks than the session's: Spark would deal the rows anew.
    dealt = lambda df: df.repartition(max(tasks, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *at)
    pairs = dealt(left).join(dealt(right).hint("merge"), at, "left")
    passed = _passed_over(threshold, n)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            alone = b.filter(pc.equal(b["block"], b["other"]))
            if alone.num_rows:
                flat = [alone[c].flatten().to_numpy() for c in lists]
                sizes = pc.list_value_length(alone["print"]).to_numpy().astype(np.int64)
                yield from of_pairs(alone["mask"].to_numpy(), flat, np.cumsum(sizes) - sizes, sizes, None, passed)
            two = b.filter(pc.not_equal(b["block"], b["other"]))
            for r in range(two.num_rows):
                x, y = ([two[f"{o}{c}"][r].values.to_numpy() for c in lists] for o in ("", "o_"))
                sizes = np.array([len(x[0])])
                yield from of_pairs(two["mask"].to_numpy()[r : r + 1], [np.concatenate(c) for c in zip(x, y, strict=True)], np.array([0]), sizes, len(y[0]), passed)

    return pairs.select("mask", "block", "other", *lists, *[f"o_{c}" for c in lists]).mapInArrow(work, types)


def _near_rows(threshold: int, rows, names: list[str]):
    """An ``of_pairs`` for :func:`_met`: ``rows`` makes result columns of close pairs (columns, i, j), each pair under the first mask that it meets under, so that no pairs are shuffled."""

    def of_pairs(mask, columns, starts, sizes, other, passed) -> Iterator[pa.RecordBatch]:
        x = columns[0].view(np.uint64)
        if other is None:
            under, found = np.repeat(mask, sizes), hamming.within(x, starts, sizes, threshold)
        else:
            size = int(sizes[0])
            under, found = np.repeat(mask, size), ((i, j + size) for i, j in hamming.across(x[:size], x[size:], threshold))
        for i, j in found:
            differ, over = x[i] ^ x[j], passed[under[i]]
            first = ((differ[:, None] & over) != 0).all(axis=1)
            i, j = i[first], j[first]
            if len(i):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in rows(columns, i, j, np.bitwise_count(differ[first]).astype(np.int32))], names)

    return of_pairs


def near_pairs(prints: DataFrame, threshold: int = 6, name: str | None = None) -> DataFrame:
    """(a, b, distance): distinct prints at most ``threshold`` bits apart, a < b. Equal prints are collapsed first, so a hot print is one row.

    With ``name``, a long column, also a_name and b_name: the smallest of each print.
    """
    grouped = prints.where("print is not null").groupBy("print")
    distinct = saved(grouped.agg(F.min(name).alias("name")) if name else grouped.agg(F.count("*")).select("print"), "prints")
    held = ["name"] if name else []
    names = ["a", "b", "distance", *[f"{o}_{c}" for c in held for o in ("a", "b")]]
    # Prints are sorted in a key and so in its lists: the first of a pair is the smaller one.
    rows = lambda c, i, j, d: [c[0][i], c[0][j], d, *[v[k] for v in c[1:] for k in (i, j)]]
    return _met(distinct, held, threshold, _near_rows(threshold, rows, names), "a long, b long, distance int" + "".join(f", a_{c} long, b_{c} long" for c in held))


def near_links(prints: DataFrame, threshold: int = 6, name: str = "print") -> DataFrame:
    """(x, y) over the smallest ``name`` of each print, a long column: few links that connect what :func:`near_pairs` connect.

    Dense prints have pairs by the square of their number; of links each has one for each mask at most.
    """
    distinct = saved(prints.where("print is not null").groupBy("print").agg(F.min(name).alias("name")), "prints")

    def of_pairs(mask, columns, starts, sizes, other, passed) -> Iterator[pa.RecordBatch]:
        both = sizes if other is None else sizes + other
        for i, j in hamming.links(columns[0].view(np.uint64), starts, both, threshold):
            if len(i):
                yield pa.RecordBatch.from_arrays([pa.array(columns[1][i]), pa.array(columns[1][j])], ["x", "y"])

    return _met(distinct, ["name"], threshold, of_pairs, "x long, y long")


def _overlap(candidates: DataFrame, references: DataFrame, threshold: int, held: dict[str, Column]) -> DataFrame:
    """(candidate_print, reference_print, distance) and longs of the two prints: ``held`` aggregates a print's rows, of which ``side`` is 1 for candidates and 2 for references; ``candidate`` is the candidate print's, all others the reference print's."""
    side = lambda df, c: df.where("print is not null").select("print", *(["id"] if held else []), F.lit(c).alias("side"))
    # Which datasets hold the print is one number: 1, 2, or 3 for both.
    grouped = side(candidates, 1).unionByName(side(references, 2)).groupBy("print")
    distinct = saved(grouped.agg(F.sum_distinct("side").alias("sides"), *[F.coalesce(v, F.lit(0)).cast("long").alias(c) for c, v in held.items()]), "prints")
    more = list(held)
    names = ["candidate_print", "reference_print", "distance", *more]

    def rows(c, i, j, d):
        left, right = np.r_[i, j], np.r_[j, i]
        keep = (c[1][left] & 1 > 0) & (c[1][right] & 2 > 0)
        left, right = left[keep], right[keep]
        return [c[0][left], c[0][right], np.r_[d, d][keep], *[v[left if n == "candidate" else right] for n, v in zip(more, c[2:], strict=True)]]

    pairs = _met(distinct, ["sides", *more], threshold, _near_rows(threshold, rows, names), "candidate_print long, reference_print long, distance int" + "".join(f", {c} long" for c in more))
    same = distinct.where("sides = 3").select(F.col("print").alias("candidate_print"), F.col("print").alias("reference_print"), F.lit(0).alias("distance"), *more)
    return pairs.unionByName(same)


def near_overlap(candidates: DataFrame, references: DataFrame, threshold: int = 6, named: bool = False) -> DataFrame:
    """(candidate_print, reference_print, distance) across two datasets of prints; ``named`` adds candidate and reference, the smallest ``id`` of each print."""
    least = lambda c: F.min(F.when(F.col("side") == c, F.col("id")))
    return _overlap(candidates, references, threshold, {"candidate": least(1), "reference": least(2)} if named else {})


#: A label that more edges than this end at is dealt over SALTS tasks where edges meet labels.
HUB_EDGES, SALTS = 20_000, 32


def _relabelled(edges: DataFrame, labels: DataFrame, end: str, hubs: DataFrame | None) -> DataFrame:
    """``edges`` with the label of ``end`` in its place. ``hubs`` (node): few, since each has many edges; their rows are dealt by salt."""
    other = "y" if end == "x" else "x"
    if hubs is None:
        return edges.join(labels.withColumnRenamed("node", end), end).select(F.col("label").alias(end), other)
    flagged = edges.join(F.broadcast(hubs.select(F.col("node").alias(end), F.lit(True).alias("hub"))), end, "left")
    salted = flagged.withColumn("salt", F.when(F.col("hub"), F.pmod(F.xxhash64(other), F.lit(SALTS)).cast("int")).otherwise(0)).drop("hub")
    copies = labels.join(F.broadcast(hubs.select("node", F.lit(True).alias("hub"))), "node", "left")
    copies = copies.select(F.col("node").alias(end), "label", F.explode(F.when(F.col("hub"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))).alias("salt"))
    return salted.join(copies, [end, "salt"]).select(F.col("label").alias(end), other)


def contracted(edges: DataFrame, seed: int = 1) -> tuple[list[DataFrame], list[int]]:
    """Rounds of (node, label), each over the labels of the round before, until no edges are left; and the edges of each round.

    In a round every node takes the neighbour, or itself, whose hash of this round is smallest, and edges
    become edges between labels: loops and repeats go, and about half of all nodes. The first round takes ids for
    hashes, so a star around its smallest node is one node after it, whatever its size. Minima are taken in each task before the shuffle, so a hub's edges never meet.
    """
    edges = saved(edges.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).where("x <> y").distinct(), "edges")
    rounds, sizes = [], []
    while n := edges.count():
        sizes.append(n)
        drawn = (lambda c: F.xxhash64(c, F.lit(seed + len(sizes)))) if rounds else (lambda c: F.lit(0))  # noqa: E731, B023
        rank = lambda c: F.struct(drawn(c).alias("h"), F.col(c).alias("v"))  # noqa: E731, B023
        both = edges.select(F.col("x").alias("node"), rank("y").alias("r")).unionByName(edges.select(F.col("y").alias("node"), rank("x").alias("r")))
        best = both.groupBy("node").agg(F.min("r").alias("r"), F.count("*").alias("degree"))
        labels = saved(best.select("node", F.least("r", rank("node"))["v"].alias("label"), "degree"), "labels")
        rounds.append(labels.select("node", "label"))
        hubs = labels.where(F.col("degree") > HUB_EDGES).select("node")
        hubs = None if n <= HUB_EDGES or hubs.isEmpty() else hubs
        moved = _relabelled(_relabelled(edges, rounds[-1], "x", hubs), rounds[-1], "y", hubs)
        after = saved(moved.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).where("x <> y").distinct(), "edges")
        dropped(edges)
        edges = after
    dropped(edges)
    return rounds, sizes


def connected(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, root): the smallest id reachable over ``edges`` (x, y), for all ``nodes`` (id)."""
    rounds, _ = contracted(edges)
    final = None
    for labels in reversed(rounds):  # from the smallest round back: a label's own label, or itself
        step = labels if final is None else labels.join(final.select(F.col("node").alias("label"), F.col("label").alias("last")), "label", "left").select("node", F.coalesce("last", "label").alias("label"))
        final = saved(step, "labels")
    every = nodes.select("id").distinct()
    if final is None:
        return every.withColumn("root", F.col("id"))
    # The last label names a class; its smallest member is the root.
    smallest = final.groupBy("label").agg(F.min("node").alias("low"))
    named = final.join(smallest.select("label", F.least("low", "label").alias("root")), "label").select(F.col("node").alias("id"), "root")
    return every.join(named, "id", "left").select("id", F.coalesce("root", "id").alias("root"))


def duplicate_groups(rows: DataFrame, threshold: int = 6) -> DataFrame:
    """Groups over equal sha, near prints and equal source groups. ``rows``: id, sha, print, source_group (may be null).

    Rows of one sha, print and source group are one node before any edge is made; equal shas, prints and source groups are
    then stars to their smallest node, never all pairs. Returns id, group_root, group_size,
    exact_group_size (1 without a sha), basis. ``rows`` is read several times: write it to a table first if it is costly.
    """
    keys = ["sha", "print", "source_group"]
    alike = saved(rows.groupBy(*keys).agg(F.min("id").alias("node"), F.count("*").alias("copies")), "alike")
    star = lambda key: alike.where(F.col(key).isNotNull()).join(alike.groupBy(key).agg(F.min("node").alias("x"), F.count("*").alias("nodes")).where("nodes > 1"), key).select("x", F.col("node").alias("y"))
    near = near_links(alike, threshold, "node")
    roots = connected(star("sha").unionByName(star("source_group")).unionByName(star("print")).unionByName(near), alike.select(F.col("node").alias("id")))
    sized = alike.join(roots.withColumnRenamed("id", "node"), "node")
    sizes = sized.groupBy("root").agg(F.sum("copies").alias("group_size"))
    exact = alike.where("sha is not null").groupBy("sha").agg(F.sum("copies").alias("exact_group_size"))
    # One row for a node; its members meet it by a key of all three columns.
    classes = sized.join(sizes, "root").join(exact, "sha", "left").withColumn("exact_group_size", F.coalesce("exact_group_size", F.lit(1)))
    named = classes.select(*[F.col(k).alias(f"n_{k}") for k in keys], "root", "group_size", "exact_group_size")
    met = F.lit(True)
    for k in keys:
        met = met & F.col(k).eqNullSafe(F.col(f"n_{k}"))
    basis = F.when(F.col("group_size") == 1, "SINGLETON").when(F.col("exact_group_size") == F.col("group_size"), "EXACT").when(F.col("exact_group_size") > 1, "EXACT_AND_NEAR").otherwise("NEAR")
    return rows.select("id", *keys).join(named, met).select("id", F.col("root").alias("group_root"), "group_size", "exact_group_size", basis.alias("basis"))


def group_split(groups: DataFrame, ratios: dict[str, float], seed: int = 1601) -> DataFrame:
    """Whole groups to splits near the ratios, by a seeded hash that any engine has: the first 8 hex digits of an MD5."""
    point = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("group_root").cast("string"))), 1, 8), 16, 10).cast("long")
    out, total = None, 0.0
    for name, share in ratios.items():
        total += share
        hit = point < F.lit(round(total * 2**32))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return groups.withColumn("split", out.otherwise(list(ratios)[-1]))


def source_group_split(groups: DataFrame, val_fraction: float = 0.2, seed: int = 7) -> DataFrame:
    """In each source max(1, min(n - 1, round(n * val))) of its n groups go to VAL. ``groups``: source, group_id."""
    g = groups.select("source", "group_id").distinct()
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.col("group_id").cast("string")))
    w = Window.partitionBy("source")
    target = F.greatest(F.lit(1), F.least(F.count("*").over(w) - 1, F.bround(F.count("*").over(w) * val_fraction, 0).cast("long")))
    return g.withColumn("split", F.when(F.row_number().over(w.orderBy(key, "group_id")) <= target, "VAL").otherwise("TRAIN"))


def split_violations(manifest: DataFrame, splits: tuple[str, ...]) -> DataFrame:
    """(violation, key): repeated images, groups in several splits, missing fields, absent splits. ``manifest``: image_id, group_id, split."""
    spark = manifest.sparkSession
    named = lambda df, name, key: df.select(F.lit(name).alias("violation"), F.col(key).cast("string").alias("key"))
    repeated = manifest.groupBy("image_id").count().where("count > 1")
    crossing = manifest.groupBy("group_id").agg(F.count_distinct("split").alias("n")).where("n > 1")
    missing = manifest.where(F.col("split").isNull() | F.col("group_id").isNull())
    wanted = spark.sql("select explode(array(" + ", ".join(f"'{s}'" for s in splits) + ")) as split")
    absent = wanted.join(manifest.select("split").distinct(), "split", "left_anti")
    return named(repeated, "DUPLICATE_IMAGE", "image_id").unionByName(named(crossing, "GROUP_CROSSES_SPLITS", "group_id")).unionByName(named(missing, "MISSING_FIELD", "image_id")).unionByName(named(absent, "ABSENT_SPLIT", "split"))


def isolation_check(selected: DataFrame, manifest: DataFrame, allowed: tuple[str, ...]) -> DataFrame:
    """One row: ids of allowed splits not selected, selected ids outside them, and PASS or FAIL."""
    ids = manifest.where(F.col("split").isin(*allowed)).select("image_id")
    count = lambda df, name: df.agg(F.count("*").alias(name))
    out = count(ids.exceptAll(selected.select("image_id")), "missing").crossJoin(count(selected.select("image_id").exceptAll(ids), "forbidden"))
    return out.withColumn("status", F.when((F.col("missing") == 0) & (F.col("forbidden") == 0), "PASS").otherwise("FAIL"))


def usage_guard(purpose: str) -> None:
    """A locked dataset may be used for nothing but to look for overlap."""
    if purpose != "overlap_only":
        raise ValueError("a locked dataset may only be used to look for overlap")


def overlap_report(candidates: DataFrame, references: dict[str, DataFrame], threshold: int = 6, purpose: str = "overlap_only") -> DataFrame:
    """(candidate, dataset, match_type, reference, references): exact and near matches of a dataset against locked ones. Tables hold id, sha, print.

    A candidate has a row for each class of references with equal digests, or with equal
    prints, that it matches: the class's smallest id and its size. So no pairs of copies are listed.
    """
    usage_guard(purpose)
    parts = []
    for name, ref in references.items():
        same = ref.groupBy("sha").agg(F.min("id").alias("reference"), F.count("*").alias("references"), F.collect_set("print").alias("own"))
        exact = candidates.select(F.col("id").alias("candidate"), "sha").join(same.drop("own"), "sha").select("candidate", F.lit("EXACT").alias("match_type"), "reference", "references")
        # Of a print's references those with another digest than the candidate's. All of them, but for the prints of references with just that digest.
        left, right = candidates.where("sha is not null"), ref.where("sha is not null")
        known = left.select(F.col("id").alias("candidate"), F.col("print").alias("candidate_print"), F.col("sha").alias("cs")).join(same.select(F.col("sha").alias("cs"), "own"), "cs", "left")
        of_ref = lambda f, c: f(F.when(F.col("side") == 2, c))
        pairs = _overlap(left, right, threshold, {"reference": of_ref(F.min, F.col("id")), "references": of_ref(F.count, F.lit(1))})
        near = known.join(pairs, "candidate_print").where(F.col("own").isNull() | ~F.array_contains("own", F.col("reference_print"))).select("candidate", "reference", "references")
        alike = right.groupBy(F.col("print").alias("reference_print"), F.col("sha").alias("cs")).agg(F.min("id").alias("low"), F.count("*").alias("n"))
        place = F.row_number().over(Window.partitionBy("reference_print").orderBy("low", "cs"))
        at = lambda k, c: F.max(F.when(F.col("place") == k, F.col(c))).alias(f"{c}{k}")
        totals = alike.withColumn("place", place).groupBy("reference_print").agg(at(1, "cs"), at(1, "low"), at(2, "low"), F.sum("n").alias("all"))
        shared = known.select("candidate", "candidate_print", "cs", F.explode("own").alias("reference_print")).where(hamming64(F.col("candidate_print"), F.col("reference_print")) <= threshold)
        shared = shared.join(alike.select("reference_print", "cs", "n"), ["reference_print", "cs"]).join(totals, "reference_print").where(F.col("all") > F.col("n"))
        shared = shared.select("candidate", F.when(F.col("cs1") == F.col("cs"), F.col("low2")).otherwise(F.col("low1")).alias("reference"), (F.col("all") - F.col("n")).alias("references"))
        parts.append(exact.unionByName(near.unionByName(shared).select("candidate", F.lit("NEAR").alias("match_type"), "reference", "references")).withColumn("dataset", F.lit(name)))
    return reduce(DataFrame.unionByName, parts)


def materialize_split(manifest: DataFrame, contents: DataFrame, path: str, splits: tuple[str, ...] = ("TRAIN", "VAL")) -> DataFrame:
    """Writes the contents of the chosen splits, partitioned by split, and reads them back: (image_id, split, sha256, status).

    ``manifest``: image_id, split, sha256; ``contents``: image_id, content. VERIFIED if
    what was written has the manifest's digest, else DIFFERENT; MISSING without content.
    """
    chosen = manifest.where(F.col("split").isin(*splits)).select("image_id", "split", "sha256")
    chosen.join(contents.select("image_id", "content"), "image_id").write.partitionBy("split").parquet(path)
    written = manifest.sparkSession.read.parquet(path).select("image_id", F.sha2("content", 256).alias("observed"))
    status = F.when(F.col("observed").isNull(), "MISSING").when(F.col("observed") == F.col("sha256"), "VERIFIED").otherwise("DIFFERENT")
    return chosen.join(written, "image_id", "left").select("image_id", "split", "sha256", status.alias("status"))


_WORD = re.compile("[A-Za-z0-9]+")
#: Distinct words that a text's votes are taken from at a time, and digests that a task remembers.
_VOTERS, _DIGESTS = 1 << 14, 1 << 18


def _majority(text: str | None, digests: dict[str, bytes]) -> int:
    counts = Counter(_WORD.findall(text or ""))
    ones = np.zeros(64, np.int64)
    words = iter(counts)
    while part := list(itertools.islice(words, _VOTERS)):
        if len(digests) > _DIGESTS:
            digests.clear()
        for w in part:
            if w not in digests:
                digests[w] = hashlib.md5(w.encode(), usedforsecurity=False).digest()[:8]
        bits = np.unpackbits(np.frombuffer(b"".join([digests[w] for w in part]), np.uint8).reshape(-1, 8), axis=1)
        ones += np.array([counts[w] for w in part]) @ bits
    return int(np.packbits(2 * ones > counts.total()).view(">i8")[0])


def simhash(text: str) -> Column:
    """64 bits, each the majority of that bit over the MD5 digests of a text's words; texts without words, or null, have print 0.

    A column of the row itself: words are counted inside it, so they are neither exploded nor shuffled.
    """

    def prints(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        digests = {}
        for texts in batches:
            yield pd.Series([_majority(t, digests) for t in texts], dtype="int64")

    return F.pandas_udf(prints, LongType())(F.col(text))


def fingerprint(vector: str):
    """64 bits from the signs of a vector's first 64 components."""
    signs = F.transform(F.slice(vector, 1, 64), lambda x: F.when(x > 0, F.lit(1)).otherwise(F.lit(0)).cast("long"))
    return F.aggregate(signs, F.lit(0).cast("long"), lambda a, v: F.shiftleft(a, 1).bitwiseOR(v))
