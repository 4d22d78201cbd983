"""Joins of boxes that meet, or nearly meet, by the cells of a grid instead of by all pairs of a frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _cells(df: DataFrame, prefix: str, cell: float, reach: Column | float) -> DataFrame:
    """A row for each cell that a box, widened by ``reach``, touches; ``{prefix}cells`` names the first of them."""
    x, y = (F.col(f"{prefix}x1"), F.col(f"{prefix}x2")), (F.col(f"{prefix}y1"), F.col(f"{prefix}y2"))
    first = lambda a: F.floor((F.least(*a) - reach) / cell)
    last = lambda a: F.floor((F.greatest(*a) + reach) / cell)
    touched = F.flatten(F.transform(F.sequence(first(x), last(x)), lambda i: F.transform(F.sequence(first(y), last(y)), lambda j: F.struct(i.alias("x"), j.alias("y")))))
    df = df.withColumn(f"{prefix}cells", F.struct(first(x).alias("x"), first(y).alias("y"))).withColumn("_cell", F.explode(touched))
    return df.withColumn("_cell_x", F.col("_cell.x")).withColumn("_cell_y", F.col("_cell.y")).drop("_cell")


def meeting(left: DataFrame, right: DataFrame, keys: list[str], cell: float, p: str = "p_", q: str = "q_", reach: Column | float = 0.0, tasks: int | None = None) -> DataFrame:
    """Pairs of ``left`` and ``right`` with equal ``keys`` whose boxes can lie within ``reach`` of each other, each pair once.

    Boxes are the columns x1, y1, x2, y2 with the prefixes ``p`` and ``q``; other names but
    ``keys`` must differ. The join is an equality on keys and cell, so a crowded frame is
    spread over its cells, and a pair is kept at the first cell that it has in common: no
    pair within reach is lost or doubled, some beyond it come along and are for the caller
    to filter. ``reach`` may be a column of ``left``. ``cell`` is best about as
    large as usual boxes are: a box of w by h touches (w / cell + 1) * (h / cell + 1) cells on average.
    Boxes with a null corner meet nothing. With ``tasks`` cells are dealt to so many, where else
    a task's rows follow from the bytes of the boxes, of which pairs may be many times more.
    """
    a, b = _cells(left, p, cell, reach), _cells(right, q, cell, 0.0)
    if tasks:
        a, b = (df.repartition(tasks, *keys, "_cell_x", "_cell_y") for df in (a, b))
    pairs = a.join(b, [*keys, "_cell_x", "_cell_y"])
    at = lambda c: F.col(f"_cell_{c}") == F.greatest(F.col(f"{p}cells.{c}"), F.col(f"{q}cells.{c}"))
    return pairs.where(at("x") & at("y")).drop("_cell_x", "_cell_y", f"{p}cells", f"{q}cells")
