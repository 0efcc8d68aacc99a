"""Spatial joins as equi-joins on grid cells.

The left side is points, each in one cell. The right side is boxes, exploded to
every cell they overlap, so a right row meets exactly the points of those cells
and no pair is produced twice. Cells whose pair count is high are split: the
left rows are spread over salts and the right rows repeated once per salt.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import in_tasks, materialize

PAIRS_PER_TASK = 50_000_000
#: hot cells that are broadcast
FEW_CELLS = 10_000
CELL_KEYS = ["cell_x", "cell_y", "salt"]


def _cell(value: Column, size: float) -> Column:
    return F.floor(value / F.lit(float(size))).cast("long")


def point_cells(df: DataFrame, x: str, y: str, size: float) -> DataFrame:
    return df.withColumns({"cell_x": _cell(F.col(x), size), "cell_y": _cell(F.col(y), size)})


def box_cells(df: DataFrame, x0: Column, y0: Column, x1: Column, y1: Column, size: float) -> DataFrame:
    """One row per cell that the box overlaps."""
    columns = F.explode(F.sequence(_cell(x0, size), _cell(x1, size)))
    rows = F.explode(F.sequence(_cell(y0, size), _cell(y1, size)))
    return df.withColumn("cell_x", columns).withColumn("cell_y", rows)


#: cell sizes double from level to level; 2^40 half-metre cells span more than the earth
MAX_LEVEL = 40


def box_level(x0: Column, y0: Column, x1: Column, y1: Column, size: float) -> Column:
    """Level whose cells, size * 2^level wide, are no smaller than the box, so that it meets at most four of them."""
    wide = F.greatest(x1 - x0, y1 - y0, F.lit(float(size)))
    return F.least(F.ceil(F.log2(wide / F.lit(float(size)))), F.lit(MAX_LEVEL)).cast("int")


def _level_cell(value: Column, size: float, level: Column) -> Column:
    return F.floor(value / (F.lit(float(size)) * F.pow(F.lit(2.0), level))).cast("long")


def _keyed(cell_x: Column, level: Column) -> Column:
    """Cells of different levels never share a key: the level sits in the low six bits."""
    return cell_x * 64 + level


def cover_cells(boxes: DataFrame, x0: Column, y0: Column, x1: Column, y1: Column, size: float) -> DataFrame:
    """One row per cell that a box meets at its own level: four at most, however wide the box; adds `level`."""
    rows = boxes.withColumn("level", box_level(x0, y0, x1, y1, size))
    level = F.col("level")
    rows = rows.withColumn("cell_x", F.explode(F.sequence(_level_cell(x0, size, level), _level_cell(x1, size, level))))
    rows = rows.withColumn("cell_y", F.explode(F.sequence(_level_cell(y0, size, level), _level_cell(y1, size, level))))
    return rows.withColumn("cell_x", _keyed(F.col("cell_x"), level))


def levels_of(covered: DataFrame) -> list[int]:
    """Levels that some box uses, at most MAX_LEVEL + 1 numbers."""
    return sorted(r[0] for r in covered.select("level").distinct().collect() if r[0] is not None)


def point_levels(points: DataFrame, x: str, y: str, size: float, levels: list[int]) -> DataFrame:
    """One row per point and level, with the point's cell there."""
    if not levels:
        return points.withColumns({"level": F.lit(0), "cell_x": F.lit(0).cast("long"), "cell_y": F.lit(0).cast("long")}).filter(F.lit(False))
    rows = points.withColumn("level", F.explode(F.array(*map(F.lit, levels))))
    level = F.col("level")
    return rows.withColumns({"cell_x": _keyed(_level_cell(F.col(x), size, level), level), "cell_y": _level_cell(F.col(y), size, level)})


def box_levels(boxes: DataFrame, x0: Column, y0: Column, x1: Column, y1: Column, size: float, levels: list[int]) -> DataFrame:
    """One row per box, level and cell that the box meets there; for boxes no wider than a few of the finest cells."""
    rows = boxes.withColumn("level", F.explode(F.array(*map(F.lit, levels))) if levels else F.lit(0))
    rows = rows if levels else rows.filter(F.lit(False))
    level = F.col("level")
    rows = rows.withColumn("cell_x", F.explode(F.sequence(_level_cell(x0, size, level), _level_cell(x1, size, level))))
    rows = rows.withColumn("cell_y", F.explode(F.sequence(_level_cell(y0, size, level), _level_cell(y1, size, level))))
    return rows.withColumn("cell_x", _keyed(F.col("cell_x"), level))


def cell_of(x: Column, y: Column, size: float, level: Column) -> tuple[Column, Column]:
    """Key columns of the cell that a place has at a level."""
    return _keyed(_level_cell(x, size, level), level), _level_cell(y, size, level)


def hot_cells(left: DataFrame, right: DataFrame, pairs_per_task: int) -> tuple[DataFrame | None, int, float]:
    """(cells that would make one task examine too many pairs, with their salt count, or None; rows of both sides; pairs of all cells)."""
    one, no = F.lit(1).cast("long"), F.lit(0).cast("long")
    both = left.select("cell_x", "cell_y", one.alias("l"), no.alias("r")).union(right.select("cell_x", "cell_y", no, one))
    cells = both.groupBy("cell_x", "cell_y").agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
    pairs = F.col("l").cast("double") * F.col("r")
    salts = F.when(F.col("cell_x").isNotNull() & F.col("cell_y").isNotNull(), F.least(F.col("l"), F.ceil(pairs / F.lit(float(pairs_per_task)))).cast("int"))
    cells = cells.withColumn("salts", salts)
    # four numbers
    most, n_left, n_right, n_pairs = cells.agg(F.max("salts"), F.sum("l"), F.sum("r"), F.sum(pairs)).first()
    hot = materialize(cells.filter("salts > 1").select("cell_x", "cell_y", "salts"), "hot") if (most or 0) > 1 else None
    return hot, (n_left or 0) + (n_right or 0), n_pairs or 0.0


def _with_salts(left: DataFrame, right: DataFrame, left_id: str, hot: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    if hot is None:
        return left.withColumn("salt", F.lit(0)), right.withColumn("salt", F.lit(0))
    hot = F.broadcast(hot) if hot.count() <= FEW_CELLS else hot
    salts = F.coalesce(F.col("salts"), F.lit(1))
    left = (left.join(hot, ["cell_x", "cell_y"], "left")
            .withColumn("salt", F.pmod(F.xxhash64(left_id), salts.cast("long")).cast("int"))
            .drop("salts"))
    right = (right.join(hot, ["cell_x", "cell_y"], "left")
             .withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1)))
             .drop("salts"))
    return left, right


def salted(left: DataFrame, right: DataFrame, left_id: str, pairs_per_task: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with a salt: in hot cells left rows are spread over salts and right rows repeated once per salt.

    The hot cells are found first. Mostly there are none or few: then no row is shuffled
    to meet them, and each side is shuffled once, for the join itself. Both sides are
    dealt by the cell over as many tasks as their pairs ask for: rows are few and small
    where pairs are many, so tasks sized by bytes would be too few and unlike.
    """
    hot, _, pairs = hot_cells(left, right, pairs_per_task)
    # fewer pairs still go to every core, down to a tenth of a task's
    tasks = max(1, -(-pairs // pairs_per_task), min(left.sparkSession.sparkContext.defaultParallelism, 10 * pairs // pairs_per_task))
    left, right = (side.repartition(int(tasks), *CELL_KEYS) for side in _with_salts(left, right, left_id, hot))
    return left, right


def cell_join(left: DataFrame, right: DataFrame, left_id: str, condition: Column | None = None,
              how: str = "inner", pairs_per_task: int | None = PAIRS_PER_TASK) -> DataFrame:
    """Join point cells to box cells; the result keeps cell_x, cell_y and salt.

    Those three columns are the hash keys of the output, so grouping by them and
    the left id needs no further shuffle. `condition` refers to the two sides by
    plain column names, which must not clash. pairs_per_task=None skips salting
    for sides that are already known to be small per cell.

    Both sides are shuffled, never broadcast: the planner takes a box for one row
    however many cells it is exploded to, and would send them all to the driver.
    Large sides are dealt over as many tasks as their rows need, so that a task's
    memory doesn't grow with the tables.
    """
    hot, rows, _ = (None, 0, 0.0) if pairs_per_task is None else hot_cells(left, right, pairs_per_task)
    left, right = _with_salts(left, right, left_id, hot)
    # a salt that is the same everywhere is no key
    left, right = (in_tasks(side, rows, *(CELL_KEYS if hot is not None else CELL_KEYS[:2])) for side in (left, right))
    keys = {k: f"_right_{k}" for k in CELL_KEYS}
    right = right.withColumnsRenamed(keys)
    on = None
    for k, renamed in keys.items():
        match = F.col(k) == F.col(renamed)
        on = match if on is None else on & match
    if condition is not None:
        on = on & condition
    joined = left.join(right.hint("merge"), on, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*keys.values())
