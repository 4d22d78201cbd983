"""Range-tree fingerprints: order, arithmetic, descent to a change."""

import hashlib
import random

from pyspark.sql import functions as F

from lanewise.operators import merkle as mk

SCHEMA = "id long, text string"
LEAF = "id"  # the key; columns need a session


def tree(df):
    return mk.tree(df, mk.id_leaf(LEAF), mk.id_parent, 3, "id", "text")


def nodes(df):
    return {(r.level, r.node): (r.rows, int(r.a), int(r.b)) for r in df.collect()}


def sample(n=3_000, seed=1):
    rng = random.Random(seed)
    return [(rng.randrange(-5_000, 60_000), rng.choice(["", "a", "aé", None, "b" * 50])) for _ in range(n)] + [(None, "x"), (None, None), (7, "same"), (7, "same")]


def test_tree_equals_plain_sums(spark):
    rows = sample()
    want = {}
    for i, t in rows:
        line = "".join("N" if v is None else f"V{len(str(v))}:{v}" for v in (i, t))
        h = hashlib.md5(line.encode()).hexdigest()
        node = -(1 << 62) if i is None else i // mk.LEAF
        for level in range(4):
            key = (level, None if level == 3 else node)
            n, a, b = want.get(key, (0, 0, 0))
            want[key] = (n + 1, (a + int(h[:16], 16)) % 2**64, (b + int(h[16:], 16)) % 2**64)
            node //= mk.FAN
    assert nodes(tree(spark.createDataFrame(rows, SCHEMA).repartition(7))) == want


def test_trees_add_and_subtract(spark):
    rows = sample()
    part = rows[:500]
    whole, rest, change = (tree(spark.createDataFrame(r, SCHEMA)) for r in (rows, rows[500:], part))
    assert nodes(mk.combined(rest, change)) == nodes(whole)
    assert nodes(mk.combined(whole, change, -1)) == nodes(rest)
    assert nodes(mk.combined(whole, whole, -1)) == {}


def test_fields_cannot_run_together(spark):
    df = spark.createDataFrame([("ab", "c"), ("a", "bc"), (None, "N"), ("N", None), ("", None), (None, "")], "x string, y string")
    assert df.select(mk.content("x", "y")).distinct().count() == 6


def test_one_changed_character_is_found_on_one_path(spark, tmp_path):
    rows = [(i, f"text {i}") for i in range(20_000)]
    left = spark.createDataFrame(rows, SCHEMA)
    right = left.withColumn("text", F.when(F.col("id") == 12_345, "text 1234S").otherwise(F.col("text")))
    for name, side in (("l", left), ("r", right)):
        tree(side).write.partitionBy("level").parquet(str(tmp_path / name))
    l, r = (spark.read.parquet(str(tmp_path / name)) for name in "lr")
    leaves = mk.differing_leaves(l, r, 3)
    assert [x.node for x in leaves.collect()] == [12_345 // mk.LEAF]
    assert [tuple(x) for x in mk.changed_rows(left, right, leaves, mk.id_leaf(LEAF), "id", "id", "text").collect()] == [(12_345, "CHANGED")]
    assert mk.differing_leaves(l, l, 3).collect() == []
    # On the way down one node of each level differs.
    for level in range(4):
        a, b = (nodes(t.where(F.col("level") == level)) for t in (l, r))
        assert sum(a[k] != b[k] for k in a) == 1


def test_lost_added_and_repeated_rows(spark):
    rows = sample(400)
    left = spark.createDataFrame([*rows, (90_000, "left"), (5, None), (6, "twice")], SCHEMA)
    right = spark.createDataFrame([*rows, (-90_000, "right"), (5, ""), (6, "twice"), (6, "twice")], SCHEMA)
    found = mk.changed_rows(left, right, mk.differing_leaves(tree(left), tree(right), 3), mk.id_leaf(LEAF), "id", "id", "text")
    assert {(r.id, r.status) for r in found.collect()} == {(90_000, "MISSING"), (-90_000, "UNEXPECTED"), (5, "CHANGED"), (6, "CHANGED")}
    empty = spark.createDataFrame([], SCHEMA)
    assert {r.status for r in mk.changed_rows(empty, right, mk.differing_leaves(tree(empty), tree(right), 3), mk.id_leaf(LEAF), "id", "id", "text").collect()} == {"UNEXPECTED"}
