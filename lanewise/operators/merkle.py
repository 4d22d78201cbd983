"""Fingerprints of tables as trees of ranges: equal tables have equal trees, and a change is found by descending.

A node holds the number of its rows and a multiset hash of them: both halves of each row's
MD5 digest as unsigned 64-bit numbers, summed modulo 2^64. The hash doesn't depend on the order of
rows, tells how often a row stands there, and adds and subtracts: a tree is kept up to date
from the rows that come and go alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Ids of a leaf, and nodes of one level that are one node of the next.
LEAF, FAN = 256, 16
_MODULUS = "18446744073709551616"


def content(*columns: str) -> Column:
    """A row's columns as one text that tells any two rows apart: N for null, else V, the length, a colon and the value."""
    value = lambda c: F.col(c).cast("string")
    return F.concat(*[F.when(F.col(c).isNull(), "N").otherwise(F.concat(F.lit("V"), F.length(value(c)).cast("string"), F.lit(":"), value(c))) for c in columns])


def id_leaf(key: str) -> Column:
    """The leaf of an integer id; null ids have a leaf of their own, below all others."""
    return F.coalesce(F.floor(F.col(key).cast("decimal(20,0)") / LEAF).cast("long"), F.lit(-(1 << 62)))


def id_parent(node: Column) -> Column:
    return F.floor(node.cast("decimal(20,0)") / FAN).cast("long")


def name_leaf(key: str, digits: int = 3) -> Column:
    """The leaf of a name: the first hexadecimal digits of its MD5; null names have their own."""
    return F.coalesce(F.substring(F.md5(F.col(key)), 1, digits), F.lit("-" * digits))


def name_parent(node: Column) -> Column:
    return F.substring(node, F.lit(1), F.length(node) - 1)


def _sum(c: str) -> Column:
    return F.pmod(F.sum(c), F.expr(f"cast({_MODULUS} as decimal(38,0))")).cast("decimal(20,0)").alias(c)


def leaves(rows: DataFrame, leaf: Column, *columns: str) -> DataFrame:
    """(node, rows, a, b) of the lowest level; rows are summed in each task before the shuffle."""
    digest = F.md5(content(*columns))
    half = lambda lo: F.conv(F.substring(digest, lo, 16), 16, 10).cast("decimal(38,0)")
    each = rows.select(leaf.alias("node"), half(1).alias("a"), half(17).alias("b"))
    return each.groupBy("node").agg(F.count("*").alias("rows"), _sum("a"), _sum("b"))


def tree(rows: DataFrame, leaf: Column, parent: Callable[[Column], Column], levels: int, *columns: str) -> DataFrame:
    """(level, node, parent, rows, a, b): level 0 holds the leaves, each further one their parents, and ``levels`` the root alone (node null)."""
    part = leaves(rows, leaf, *columns)
    out = None
    for level in range(levels + 1):
        kind = part.schema["node"].dataType
        above = F.lit(None).cast(kind) if level >= levels - 1 else parent(F.col("node"))
        row = part.select(F.lit(level).alias("level"), "node", above.alias("parent"), "rows", "a", "b")
        out = row if out is None else out.unionByName(row)
        part = row.groupBy(F.col("parent").alias("node")).agg(F.sum("rows").alias("rows"), _sum("a"), _sum("b"))
    return out


def combined(before: DataFrame, change: DataFrame, sign: int = 1) -> DataFrame:
    """The tree of a table to which the rows of ``change`` are added (sign 1) or from which they are taken (-1). Nodes without rows go."""
    whole = F.expr(f"cast({_MODULUS} as decimal(38,0))")
    signed = change if sign > 0 else change.withColumn("rows", -F.col("rows")).withColumns({c: F.pmod(whole - F.col(c), whole) for c in ("a", "b")})
    keys = ["level", "node", "parent"]
    wide = lambda df: df.select(*keys, "rows", *[F.col(c).cast("decimal(38,0)").alias(c) for c in ("a", "b")])
    return wide(before).unionByName(wide(signed)).groupBy(*keys).agg(F.sum("rows").alias("rows"), _sum("a"), _sum("b")).where("rows <> 0")


def differing_leaves(left: DataFrame, right: DataFrame, levels: int) -> DataFrame:
    """(node): the leaves in which two trees differ. From the root down, only children of differing nodes are compared; the trees can be stored by level."""
    at = None
    for level in range(levels, -1, -1):
        sides = [t.where(F.col("level") == level).select("node", "parent", *[F.col(c).alias(f"{name}_{c}") for c in ("rows", "a", "b")]) for name, t in (("l", left), ("r", right))]
        if at is not None:
            top = F.broadcast(at) if level == levels - 1 else at  # the root alone
            sides = [s.join(top.withColumnRenamed("node", "above"), F.col("parent").eqNullSafe(F.col("above")), "left_semi") for s in sides]
        l, r = (s.drop("parent") for s in sides)
        same = F.col("l_rows").eqNullSafe(F.col("r_rows")) & F.col("l_a").eqNullSafe(F.col("r_a")) & F.col("l_b").eqNullSafe(F.col("r_b"))
        met = l.join(r.withColumnRenamed("node", "other"), F.col("node").eqNullSafe(F.col("other")), "full")
        at = met.where(~same).select(F.coalesce("node", "other").alias("node")).distinct()
    return at


def changed_rows(left: DataFrame, right: DataFrame, nodes: DataFrame, leaf: Column, key: str, *columns: str) -> DataFrame:
    """(key, status): ids of the given leaves that are CHANGED, MISSING (from the right) or UNEXPECTED. Rows of one id are compared as a multiset."""
    inside = lambda df: df.withColumn("node_", leaf).join(nodes.withColumnRenamed("node", "node_"), "node_", "left_semi")
    digest = lambda df, name: inside(df).groupBy(F.col(key).alias(f"{name}_key")).agg(F.array_sort(F.collect_list(F.md5(content(*columns)))).alias(name))
    met = digest(left, "l").join(digest(right, "r"), F.col("l_key").eqNullSafe(F.col("r_key")), "full")
    status = F.when(F.col("r").isNull(), "MISSING").when(F.col("l").isNull(), "UNEXPECTED").when(F.col("l") != F.col("r"), "CHANGED")
    return met.withColumn("status", status).where("status is not null").select(F.coalesce("l_key", "r_key").alias(key), "status")


def digests(nodes: DataFrame) -> DataFrame:
    """(level, node, rows, digest) of a tree, with names as text and both sums in one digest."""
    return nodes.select("level", F.coalesce(F.col("node").cast("string"), F.lit("root")).alias("node"), "rows", F.concat_ws(":", F.col("a").cast("string"), F.col("b").cast("string")).alias("digest"))
