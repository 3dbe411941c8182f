"""Values by lookup in tables on a grid: weather by distance, height and time, performance by type, mode, height and speed.

A grid is a table of its nodes. It is turned into one of cells, each with the values at its corners, so a
sample needs one equi-join on the cell it lies in and is interpolated there by column arithmetic.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Axis:
    """Nodes at first, first + step and on, `count` of them."""

    name: str
    first: float
    step: float
    count: int

    def __post_init__(self) -> None:
        if self.step <= 0 or self.count < 1:
            raise ValueError(f"axis {self.name} needs a step above zero and one node or more")

    def last_cell(self) -> int:
        return max(self.count - 2, 0)

    def place(self) -> Column:
        """Position in steps, held at the ends; null for null and NaN."""
        at = (F.col(self.name) - self.first) / self.step
        held = F.greatest(F.least(at, F.lit(self.count - 1.0)), F.lit(0.0))
        return F.when(at.isNotNull() & ~F.isnan(at.cast("double")), held)


@dataclass(frozen=True)
class Grid:
    """A regular grid over some axes, one for each value of the keys (which may be none)."""

    axes: tuple[Axis, ...]
    values: tuple[str, ...]
    keys: tuple[str, ...] = ()

    def cells(self, nodes: DataFrame) -> DataFrame:
        """keys, cell and for each value the struct of its corners, from nodes (keys, axes, values).

        A node belongs to every cell that it is a corner of; of nodes at one place the greatest value counts, nodes off the
        grid are ignored. A corner without a node is null, and so is what is interpolated with weight from it.
        """
        found, corners = nodes, []
        for axis in self.axes:
            index = F.round((F.col(axis.name) - axis.first) / axis.step)
            on = (F.abs(F.col(axis.name) - (index * axis.step + axis.first)) <= 1e-6 * axis.step) & index.between(0, axis.count - 1)
            found = found.where(on).withColumn(f"i_{axis.name}", index.cast("long"))
            corners.append((0, 1) if axis.count > 1 else (0,))
        shifts = F.array(*(F.array(*(F.lit(b) for b in bits)) for bits in product(*corners)))
        spread = found.withColumn("corner", F.explode(shifts))
        cell, inside = F.lit(0).cast("long"), F.lit(True)
        for k, axis in enumerate(self.axes):
            own = F.col(f"i_{axis.name}") - F.col("corner")[k]
            inside = inside & own.between(0, axis.last_cell())
            cell = cell * (axis.last_cell() + 1) + own
        spread = spread.where(inside).withColumn("cell", cell)
        at = lambda bits: F.col("corner") == F.array(*(F.lit(b) for b in bits))
        name = lambda bits: "c" + "".join(map(str, bits))
        made = [F.struct(*(F.max(F.when(at(bits), F.col(v).cast("double"))).alias(name(bits)) for bits in product(*corners))).alias(f"corners_{v}") for v in self.values]
        return spread.groupBy(*self.keys, "cell").agg(*made)

    def sample(self, rows: DataFrame, nodes: DataFrame) -> DataFrame:
        """rows (keys, axes, others) with the values interpolated linearly along every axis; exact at nodes, held beyond the edge.

        Rows whose keys the grid lacks, or with a null place, get nulls. The cells are few beside the rows; whether they are
        broadcast is left to Spark's check of their size. Else one shuffle by cell, where adaptive execution splits a crowded one.
        """
        placed, cell = rows, F.lit(0).cast("long")
        for axis in self.axes:
            low = F.when(axis.place().isNotNull(), F.least(F.floor(axis.place()), F.lit(axis.last_cell())).cast("long"))
            placed = placed.withColumns({f"low_{axis.name}": low, f"part_{axis.name}": axis.place() - low})
            cell = cell * (axis.last_cell() + 1) + F.col(f"low_{axis.name}")
        met = placed.withColumn("cell", cell).join(self.cells(nodes), [*self.keys, "cell"], "left")

        def value(v: str, bits: str = "") -> Column:
            if len(bits) == len(self.axes):
                return F.col(f"corners_{v}")[f"c{bits}"]
            axis = self.axes[len(bits)]
            part, low = F.col(f"part_{axis.name}"), value(v, bits + "0")
            if axis.count == 1:
                return F.when(part.isNotNull(), low)
            high = value(v, bits + "1")
            return F.when(part == 0, low).when(part == 1, high).otherwise(low * (1.0 - part) + high * part)

        return met.select(*rows.columns, *(value(v).alias(v) for v in self.values))


def weather(s: Axis, h: Axis, t: Axis) -> Grid:
    """Wind (east, north) and temperature offset by distance to go, height and time."""
    return Grid((s, h, t), ("wind_east", "wind_north", "delta_isa"))


def performance(h: Axis, v: Axis) -> Grid:
    """Idle and greatest thrust, and drag, of a type in a mode, by height and speed."""
    return Grid((h, v), ("idle", "thrust_upper", "drag"), ("type", "mode"))
