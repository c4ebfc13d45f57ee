"""Dense numbers and running values over whole tables, without a window that holds a table or a hot key in one task."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelane.storage import Tables

_ROWS = (1 << 33) - 1  # monotonically_increasing_id(): partition above, row of the partition in the low 33 bits


def dense_numbers(df: DataFrame, order: Sequence[Column], name: str = "number", start: int = 0, tables: Tables | None = None) -> DataFrame:
    """``df`` with ``name``: start, start + 1, ... in ``order``, which should leave no ties but between equal rows.

    One shuffle: rows are dealt to ranges of the order and written with their place in the
    range; the rows of each range are counted and the counts before it added.
    """
    tables = tables or Tables(df.sparkSession)
    place = f"__{name}_place"
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(place, F.monotonically_increasing_id())
    placed = tables.keep(f"{name}_ranges", placed)
    part, before = f"__{name}_part", f"__{name}_before"
    sizes = placed.groupBy(F.shiftright(place, 33).alias(part)).agg(F.count(F.lit(1)).alias("__rows"))
    above = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)  # a row for each range, so no more than shuffle partitions
    offsets = sizes.select(part, F.coalesce(F.sum("__rows").over(above), F.lit(0)).alias(before))
    joined = placed.withColumn(part, F.shiftright(place, 33)).join(F.broadcast(offsets), part)
    number = F.col(before) + F.col(place).bitwiseAND(F.lit(_ROWS)) + start
    return joined.select(*(F.col(f"`{c}`") for c in df.columns), number.alias(name))


#: How two partial values are put together, by the aggregate that made them.
_PAIR: dict[str, Callable[[Column, Column], Column]] = {
    "sum": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)),
    "bit_xor": lambda a, b: F.coalesce(a, F.lit(0)).bitwiseXOR(F.coalesce(b, F.lit(0))),
    "max": lambda a, b: F.greatest(a, b),
    "min": lambda a, b: F.least(a, b),
}


def running(df: DataFrame, key: str, position: str, values: dict[str, tuple[str, str]], backwards: bool = False, this_row: bool = True, block: int = 4096) -> DataFrame:
    """``df`` with running aggregates in each ``key`` by ``position`` (a number from 0, once a key), with ``this_row`` or up to the one before.

    ``values``: new column -> (sum, bit_xor, max or min; column).  A key's rows are cut into
    blocks of positions: running values within each block, then over the blocks' totals, so no
    task gets a key's rows but for one in ``block``.  ``df`` is read twice: write it first.
    """
    at = "__block"
    df = df.withColumn(at, F.floor(F.col(position) / block))
    order = lambda c: F.col(c).desc() if backwards else F.col(c)
    own = Window.partitionBy(key, at).orderBy(order(position)).rowsBetween(Window.unboundedPreceding, 0 if this_row else -1)
    within = df.withColumns({name: getattr(F, how)(column).over(own) for name, (how, column) in values.items()})
    before = Window.partitionBy(key).orderBy(order(at)).rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(key, at).agg(*(getattr(F, how)(column).alias(f"__{name}") for name, (how, column) in values.items()))
    carried = totals.withColumns({f"__{name}": getattr(F, how)(f"__{name}").over(before) for name, (how, _) in values.items()} | {"__first": F.row_number().over(Window.partitionBy(key).orderBy(order(at)))})
    carried = carried.where("__first > 1").drop("__first")  # most keys have one block, and nothing is carried into it
    joined = within.join(carried, [key, at], "left")
    return joined.withColumns({name: _PAIR[how](F.col(name), F.col(f"__{name}")) for name, (how, _) in values.items()}).drop(at, *(f"__{name}" for name in values))
