"""Cells around pivots: which parts of a table of vectors can hold pairs within a radius."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strayline.operators.moments import matrix_of

#: Pivots are chosen among a sample of about so many rows. Both numbers bound what the
#: driver holds and what every task knows; cells beyond them grow, and become blocks.
MOST_PIVOTS, SAMPLE_ROWS = 256, 4096
#: A cell has about so many rows, as long as there are pivots left; small tables have some
#: cells, too, of a few rows at least.
CELL_ROWS, FEWEST_PIVOTS, FEWEST_ROWS = 2048, 64, 8


@dataclass
class Pivots:
    """Points that cells are made around: a row is in the cell of its nearest pivot."""

    places: np.ndarray

    def squares(self, x: np.ndarray) -> np.ndarray:
        """Squared distances of rows from all pivots."""
        middle = self.places.mean(axis=0)
        a, b = x - middle, self.places - middle
        return np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2.0 * (a @ b.T), 0.0)

    def apart(self) -> np.ndarray:
        return np.sqrt(((self.places[:, None] - self.places[None]) ** 2).sum(axis=2))


def farthest_first(sample: np.ndarray, wanted: int) -> np.ndarray:
    """Points of the sample, each the farthest from those before it; fewer if all others are copies."""
    chosen = [0]
    gaps = ((sample - sample[0]) ** 2).sum(axis=1)
    while len(chosen) < wanted and gaps.max() > 0:
        chosen.append(int(gaps.argmax()))
        gaps = np.minimum(gaps, ((sample - sample[chosen[-1]]) ** 2).sum(axis=1))
    return sample[chosen]


def choose_pivots(rows: DataFrame, n: int, width: int) -> Pivots:
    """Pivots for ``n`` rows with ``id, v``, from a sample drawn by a hash of the id."""
    wanted = min(MOST_PIVOTS, max(n // CELL_ROWS, min(FEWEST_PIVOTS, n // FEWEST_ROWS), 1))
    low = F.pmod(F.xxhash64(F.lit(17), "id"), F.lit(1 << 20)) < F.lit(int((1 << 20) * min(1.0, SAMPLE_ROWS / max(n, 1))) or 1)
    drawn = matrix_of(rows.filter(low).select("id", "v").limit(2 * SAMPLE_ROWS).orderBy("id").toArrow().column("v"), width)
    if not len(drawn):
        drawn = matrix_of(rows.select("v").limit(1).toArrow().column("v"), width)
    return Pivots(farthest_first(drawn, wanted) if len(drawn) else np.zeros((1, width)))


def with_cell(rows: DataFrame, pivots: Pivots, cell: str = "c0") -> DataFrame:
    """``id, v, _by`` with the number of the nearest pivot, the lowest one on ties."""
    shared, width = rows.sparkSession.sparkContext.broadcast(pivots), pivots.places.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                nearest = shared.value.squares(matrix_of(batch.column("v"), width)).argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nearest.astype(np.int64))], [*batch.schema.names, cell])

    return rows.mapInArrow(run, f"id bigint, v array<double>, _by bigint, {cell} bigint")


def near_cells(celled: DataFrame, pivots: Pivots, radius: float, cell: str = "c0") -> np.ndarray:
    """Pairs ``p <= q`` of cells that may hold two rows within the radius.

    Two bounds leave the others out. The planes that part cell p from cell q lie
    between them: what rows of p and rows of q keep from that plane at least, added up,
    is less than any distance across it. And by the triangle inequality two balls
    around pivots are at least as far apart as their pivots less both radii. Tasks
    take the smallest margin of each cell to each other pivot, Spark the smallest of
    all tasks; at most ``MOST_PIVOTS`` squared numbers reach the driver.
    """
    shared, width = celled.sparkSession.sparkContext.broadcast(pivots), pivots.places.shape[1]
    k = len(pivots.places)
    apart = pivots.apart()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = np.full((k, k), np.inf)
        for batch in batches:
            if not batch.num_rows:
                continue
            own = np.asarray(batch.column(cell))
            squares = shared.value.squares(matrix_of(batch.column("v"), width))
            mine = squares[np.arange(len(own)), own]
            margins = (squares - mine[:, None]) / (2.0 * np.maximum(apart[own], 1e-300))
            margins[np.arange(len(own)), own] = -np.sqrt(mine)  # the smallest is minus the cell's radius
            np.minimum.at(least, own, margins)
        p, q = np.nonzero(np.isfinite(least))
        yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(q), pa.array(least[p, q])], ["p", "q", "margin"])

    found = celled.mapInArrow(run, "p bigint, q bigint, margin double").groupBy("p", "q").agg(F.min("margin").alias("margin")).toArrow()
    least = np.full((k, k), np.inf)
    least[np.asarray(found.column("p")), np.asarray(found.column("q"))] = np.asarray(found.column("margin"))
    balls = -np.diag(least)  # minus infinity where a cell is empty
    room = radius + 1e-9 * (1.0 + radius + np.abs(pivots.places).max(initial=0.0))
    across = least + least.T
    np.fill_diagonal(across, -np.inf)
    may = (across <= room) & (apart - balls[:, None] - balls[None, :] <= room)
    return np.argwhere(np.triu(may))
