"""Nearest of many centroids through a grid that refines itself.

The space is one square cell at first.  In every round a cell with more than ``TARGET``
candidate centroids is split ``STEP`` times in each direction, and a part keeps only the
candidates that can be nearest to one of its places: all but those that the centroid nearest
to the part's middle beats everywhere in it.  That is a linear condition, so it holds in the
whole part if it holds at its corners.  Crowded places get small cells, empty ones large
cells, and a point meets about ``TARGET`` centroids however many there are.

A round's (cell, candidate) rows are written to the shared folder.  While there are few
cells, what the parts need is aggregated and joined back to the candidates, which stay where
they are; later one shuffle deals the candidates by cell, before they are split, and a
group is at most the table of centroids, which a window spills beyond memory.  Nothing but
the box and row counts reaches the driver.  A point finds
its cell by an equi-join on (level, cell), one key for each level that has final cells.
Spark broadcasts the cells when it measures them as small; otherwise the join shuffles, and
a cell with a large share of the points is split by AQE.

The result equals a comparison with all centroids: squared distance, ties to the smaller name.
A point with a coordinate that is null, not a number or beyond 1e150 gets a null name; a
centroid with such a coordinate or without a name is left out.  Without centroids, all names
are null.  Rows may repeat; other columns pass through, and only columns that begin with
``__grid_`` are reserved.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import add, and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ratewise.session import materialise, one_row

TARGET = 8
STEP = 2
DEPTH = 40
FEW = 4096  # cells up to which their pivots and counts are broadcast
FARTHEST = 1e150
LEVEL, CANDIDATES = "__grid_level", "__grid_candidates"


@dataclass
class CentroidGrid:
    """Final cells with their candidates, and what leads a point to its cell."""

    cells: DataFrame
    levels: list[int]
    low: list[float]
    width: float

    def index(self, at: Column, dim: int, level: Column) -> Column:
        """Cell number along one dimension; a level's numbers are those of the next, halved."""
        number = F.floor((at - F.lit(self.low[dim])) / F.lit(self.width) * F.pow(F.lit(2.0), level))
        return F.least(number, F.pow(F.lit(2.0), level).cast("long") - 1)


def _usable(cols: Sequence[Column]) -> Column:
    # NaN is larger than any number in Spark, so it fails the comparison too.
    return reduce(and_, (F.coalesce(F.abs(c) < F.lit(FARTHEST), F.lit(False)) for c in cols))


def _doubles(cols: Sequence[str]) -> list[Column]:
    return [F.col("`" + c.replace("`", "``") + "`").cast("double") for c in cols]


def _squares(parts: Sequence[Column]) -> Column:
    return reduce(add, (p * p for p in parts))


def _split(open_cells: DataFrame, dims: int, low: list[float], width: float, few: bool) -> DataFrame:
    """Open cells split, written with the candidates that each part keeps and their number ``n``."""
    cell, own = [LEVEL] + [f"i{d}" for d in range(dims)], [f"p{d}" for d in range(dims)]
    parts = open_cells.drop("n").withColumn(LEVEL, F.col(LEVEL) + STEP).withColumns({p: F.col(f"i{d}") for d, p in enumerate(own)})
    if not few:
        # Each candidate is shuffled once, not once for each part of its cell: the window
        # groups by cell and part, which rows dealt by cell already meet.
        parts = parts.repartition(*own)
    for d in range(dims):
        first = F.col(f"p{d}") * (1 << STEP)
        parts = parts.withColumn(f"i{d}", F.explode(F.sequence(first, first + (1 << STEP) - 1)))
    size = F.lit(width) / F.pow(F.lit(2.0), F.col(LEVEL))
    off = [F.col(f"c{d}") - (F.lit(low[d]) + (F.col(f"i{d}") + 0.5) * size) for d in range(dims)]
    parts = parts.select(*own, *cell, "name", *[f"c{d}" for d in range(dims)], *[o.alias(f"o{d}") for d, o in enumerate(off)])
    parts = parts.withColumn("d", _squares([F.col(f"o{d}") for d in range(dims)]))
    group = Window.partitionBy(*own, *cell[1:])
    nearest = F.min(F.struct("d", *[f"o{d}" for d in range(dims)]))
    if few:
        parts = parts.join(F.broadcast(parts.groupBy(*cell).agg(nearest.alias("pivot"))), cell)
    else:
        parts = parts.withColumn("pivot", nearest.over(group))
    # Half a cell, and what rounding may add to it and to the distances.
    reach = max(abs(x) for x in low) + width
    half = F.lit(width) / F.pow(F.lit(2.0), F.col(LEVEL) + 1) + F.lit(1e-14 * reach)
    apart = reduce(add, (F.abs(F.col(f"o{d}") - F.col(f"pivot.o{d}")) for d in range(dims)))
    slack = F.lit(1e-12) * (F.col("d") + F.col("pivot.d") + half * half * dims)
    kept = parts.where(F.col("pivot.d") - F.col("d") + 2 * half * apart >= -slack)
    out, n = [*cell, "name", *[f"c{d}" for d in range(dims)]], F.count(F.lit(1))
    if not few:
        return materialise(kept.select(*out, n.over(group).alias("n")), "grid-round")
    kept = materialise(kept.select(*out), "grid-round")
    return kept.join(F.broadcast(kept.groupBy(*cell).agg(n.alias("n"))), cell)


def build_grid(points: DataFrame, cents: DataFrame, cols: Sequence[str] = ("longitude", "latitude"),
               name_col: str = "cluster_name") -> CentroidGrid:
    """The grid of ``cents`` over the box that holds both tables."""
    dims = len(cols)
    own = cents.select(F.col(name_col).alias("name"), *[c.alias(f"c{d}") for d, c in enumerate(_doubles(cols))])
    own = own.where(F.col("name").isNotNull() & _usable([F.col(f"c{d}") for d in range(dims)]))
    places = materialise(own.groupBy(*[f"c{d}" for d in range(dims)]).agg(F.min("name").alias("name")), "grid-places")
    there = points.select(*[c.alias(f"c{d}") for d, c in enumerate(_doubles(cols))]).where(_usable([F.col(f"c{d}") for d in range(dims)]))
    box = there.unionByName(places.drop("name")).agg(
        *[F.min(f"c{d}").alias(f"lo{d}") for d in range(dims)], *[F.max(f"c{d}").alias(f"hi{d}") for d in range(dims)])
    box = one_row(box)
    low = [box[f"lo{d}"] or 0.0 for d in range(dims)]
    width = max((box[f"hi{d}"] or 0.0) - low[d] for d in range(dims)) or 1.0
    n = places.count()
    step = places.select(F.lit(0).alias(LEVEL), *[F.lit(0).cast("long").alias(f"i{d}") for d in range(dims)], "name",
                         *[f"c{d}" for d in range(dims)], F.lit(n).cast("long").alias("n"))
    final, levels, level = [], [], 0
    while True:
        done = (F.col("n") <= TARGET) | F.lit(level >= DEPTH)
        n_done, n_open = one_row(step.agg(F.count_if(done), F.count_if(~done)))
        if n_done:
            final.append(step.where(done))
            levels.append(level)
        if not n_open:
            break
        waiting = step.where(~done)
        step = _split(waiting, dims, low, width, 1 << dims * (level + STEP) <= FEW)
        level += STEP
    cell = [F.col(LEVEL), *[F.col(f"i{d}").alias(f"__grid_i{d}") for d in range(dims)]]
    rows = reduce(DataFrame.unionByName, final or [step]).groupBy(*cell).agg(
        F.collect_list(F.struct("name", *[f"c{d}" for d in range(dims)])).alias(CANDIDATES))
    return CentroidGrid(materialise(rows, "grid-cells"), levels, low, width)


def nearest_in_grid(points: DataFrame, grid: CentroidGrid, cols: Sequence[str] = ("longitude", "latitude"),
                    name_col: str = "cluster_name", met_col: str | None = None) -> DataFrame:
    """``points`` with the nearest centroid's name, and in ``met_col`` how many candidates were compared."""
    dims = len(cols)
    at = _doubles(cols)
    usable = _usable(at)
    keys = F.array(*[F.lit(v) for v in grid.levels]) if grid.levels else F.lit(None).cast("array<int>")
    keyed = points.select("*", usable.alias("__grid_usable"), F.explode_outer(F.when(usable, keys)).alias(LEVEL))
    for d in range(dims):
        keyed = keyed.withColumn(f"__grid_i{d}", F.when(F.col("__grid_usable"), grid.index(at[d], d, F.col(LEVEL))))
    found = keyed.join(grid.cells, [LEVEL] + [f"__grid_i{d}" for d in range(dims)], "left")
    found = found.where(F.col(CANDIDATES).isNotNull() | ~F.col("__grid_usable") | F.col(LEVEL).isNull())
    gaps = F.transform(CANDIDATES, lambda c: F.struct(
        _squares([at[d] - c[f"c{d}"] for d in range(dims)]).alias("d"), c["name"].alias("name")))
    out = found.withColumn(name_col, F.array_min(gaps)["name"])
    if met_col:
        out = out.withColumn(met_col, F.coalesce(F.size(CANDIDATES), F.lit(0)))
    return out.select(*[F.col("`" + c.replace("`", "``") + "`") for c in points.columns if c not in (name_col, met_col)],
                      name_col, *([met_col] if met_col else []))


def nearest_centroid_indexed(points: DataFrame, cents: DataFrame, cols: Sequence[str] = ("longitude", "latitude"),
                             name_col: str = "cluster_name") -> DataFrame:
    """Each point's nearest row of a centroid table of any length."""
    return nearest_in_grid(points, build_grid(points, cents, cols, name_col), cols, name_col)
