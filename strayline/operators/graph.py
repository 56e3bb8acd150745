"""Similarity graphs and sparse matrix products.

A matrix is a table of ``(src, dst, weight)`` entries.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strayline.lineage import cut
from strayline.operators.features import fit_scaler
from strayline.operators.pivots import choose_pivots, near_cells, with_cell
from strayline.operators.skew import hot_keys, replicated, salted, salted_join

# Rows of a block: a share of the table, so that there is work for all, within limits. Every
# row goes to about half as many tasks as there are blocks, so blocks are large.
FEWEST_BLOCKS, LEAST_ROWS, MOST_ROWS, BLOCK_BYTES = 32, 128, 1 << 15, 16 << 20
# Rows of both blocks that are compared at a time.
COMPARED_ROWS = 1024
# The same where all weights of a tile are kept: it stays in a core's cache.
TILE_ROWS, TILE_COLUMNS = 256, 1024
# A block's partners are dealt out over so many tasks.
PARTS = 4
# Where all blocks meet, their bytes at most, and how many pairs of strips of them a core has to compare.
STRIP_BLOCK_BYTES, CORE_PAIRS = 4 << 20, 4
# Blocks of a strip: more make more strips.
STRIP_BLOCKS = 8
# Cells around pivots are dropped if more than this share of their pairs must meet.
MOST_NEAR = 0.5
# Distances by the fast form are taken if they move no weight by more than this.
WEIGHT_ERROR = 1e-12
GRID_DIMENSIONS = 3


def radius_of(sigma: float, tol: float) -> float:
    """Distance at which the RBF weight falls to the tolerance."""
    return float(sigma) * math.sqrt(-math.log(tol))


def _grid_axes(spans: list[float], radius: float) -> list[int]:
    """The widest dimensions in which cells of one radius can prune anything."""
    useful = [i for i, span in enumerate(spans) if span > 2 * radius]
    return sorted(useful, key=lambda i: -spans[i])[:GRID_DIMENSIONS]


def similarity_edges(
    df: DataFrame,
    id_col: str = "id",
    features: str | Iterable[str] = "features",
    sigma: float = 0.42,
    tol: float = 1e-9,
    standardize: bool = True,
    block_rows: int | None = None,
    by: str | None = None,
    extent: tuple[list[float], int] | None = None,
) -> DataFrame:
    """All pairs ``src >= dst`` with weight ``exp(-|x - y|^2 / sigma^2) > tol``.

    Exact. The tolerance bounds the distance of a pair. Where up to three axes are
    wider than two radii, space is cut into cells one radius wide, and rows only meet
    rows of their own and the adjacent cells, taken in one direction so that no pair
    comes twice. Otherwise, as in many dimensions, cells lie around pivots, and
    only those cells meet that can hold a pair by the rows' own margins
    (``pivots.near_cells``). A row without an id or with a NULL or NaN feature is near to
    nothing and has no edge. Rows of a cell are packed into blocks of about
    ``block_rows`` by hash, so a crowded cell becomes many blocks and its pairs a grid of
    tiles. ``extent``, the widths of a vector column's axes and about how many rows there are,
    spares the pass that finds them. With ``by`` only rows that agree in that column meet: the graphs of many tables in
    one job. Joined pairs of blocks, each of bounded size, are spread over
    the cluster and compared in Arrow batches; only edges leave the comparison.
    """
    found, partners, width = _block_pairs(df, id_col, features, sigma, tol, standardize, block_rows, by, extent)
    blocks, pairs = as_places(found, partners)
    return met_blocks(blocks, pairs, strips_of(pairs)).select("same", "l_ids", "l_vs", "r_ids", "r_vs").mapInArrow(
        _edge_finder(width, float(sigma), float(tol)), "src bigint, dst bigint, weight double"
    )


def as_places(blocks: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Blocks ``_at, ids, vs`` and pairs ``_l, _r, same, _part``, each block named by one column."""
    keys = [c for c in blocks.columns if c not in ("ids", "vs", "_block")]
    mine = [F.col("_by"), *[F.col(f"_{k}").alias(k) for k in keys if k != "_by"], F.col("_from").alias("_block")]
    same = F.col("_own") & (F.col("_from") == F.col("_block"))
    named = pairs.select(F.struct(*mine).alias("_l"), F.struct(*keys, "_block").alias("_r"), same.alias("same"))
    return blocks.select(F.struct(*keys, "_block").alias("_at"), "ids", "vs"), named.withColumn(
        "_part", F.pmod(F.xxhash64("_l"), F.lit(PARTS)).cast("int")
    )


def most_strips(spark: SparkSession) -> int:
    """Strips whose pairs are enough work for all cores."""
    return max(2, round(math.sqrt(2 * CORE_PAIRS * spark.sparkContext.defaultParallelism)))


def strips_of(pairs: DataFrame) -> int:
    """How many strips to deal blocks to if all meet all others, else 0."""
    found = pairs.agg(F.count(F.lit(1)).alias("n"), F.count_if("same").alias("blocks")).first()
    n = found["blocks"]
    if not n or found["n"] < n * (n + 1) // 2:
        return 0
    return min(n, max(most_strips(pairs.sparkSession), -(-n // STRIP_BLOCKS)))


def met_blocks(blocks: DataFrame, pairs: DataFrame, strips: int = 0) -> DataFrame:
    """Every pair of blocks as one row, ``same, l_ids, l_vs, .., r_ids, r_vs, ..``, spread over the cluster.

    The first block of a pair is sent to its partner, which is sent to ``PARTS`` tasks at most. Where
    all blocks meet, they are shuffled once, into ``strips``, and a task reads the two strips it compares.
    """
    columns = [c for c in blocks.columns if c != "_at"]
    spark = blocks.sparkSession
    if strips:
        cells = [F.col(f"_at.{c}") for c in blocks.schema["_at"].dataType.names if c != "_block"]
        blocks = blocks.withColumn("_strip", F.pmod(F.pmod(F.xxhash64(*cells), F.lit(strips)) + F.col("_at._block"), F.lit(strips)).cast("int"))
        blocks, columns = blocks.repartitionById(strips, "_strip"), [*columns, "_strip"]
    left = blocks.withColumnsRenamed({"_at": "_l", **{c: f"l_{c}" for c in columns}})
    right = blocks.withColumnsRenamed({"_at": "_r", **{c: f"r_{c}" for c in columns}})
    if strips:
        # All pairs of two strips are one task's.
        i, j = F.col("l__strip"), F.col("r__strip")
        once = F.when(i == j, F.col("_l") >= F.col("_r")).otherwise((i > j) == (F.pmod(i + j, F.lit(2)) == 0))
        return left.join(right.hint("shuffle_replicate_nl"), once).withColumn("same", F.col("_l") == F.col("_r"))
    # Small in bytes but long in work: a fixed number of partitions keeps Spark
    # from merging them by size.
    n_partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    own = pairs.join(left, "_l").repartition(n_partitions, "_r", "_part")
    there = pairs.select("_r", "_part").distinct().join(right, "_r")
    # A task's partners are few: hashed, so that no pair of blocks is sorted.
    return own.join(there.hint("shuffle_hash"), ["_r", "_part"])


def _block_pairs(
    df, id_col, features, sigma, tol, standardize, block_rows, by, extent=None, fewest=FEWEST_BLOCKS
) -> tuple[DataFrame, DataFrame, int]:
    """Blocks ``_by, c0.., _block, ids, vs``, the pairs of them that must meet, and the vectors' width.

    A pair names one block by ``_c0.., _from``, the other by ``c0.., _block``.
    """
    if not tol > 0:
        raise ValueError("tol must be above 0: without a bound every pair is an edge")
    if extent is not None:
        vector, (spans, n) = F.col(features).cast("array<double>"), extent
    else:
        scaler = fit_scaler(df, features)
        vector, spans, n = scaler.vector(standardize), scaler.ranges(standardize), scaler.rows
    # A hair wider than the bound, so that rounding cannot part a pair by two cells.
    radius = radius_of(sigma, tol) * (1 + 1e-9) if tol < 1 else 0.0
    axes = _grid_axes(spans, radius) if radius > 0 else []
    most = max(1, min(MOST_ROWS, BLOCK_BYTES // (8 * max(1, len(spans)))))
    rows = df.select(
        F.col(id_col).cast("bigint").alias("id"), vector.alias("v"), (F.col(by) if by else F.lit(0)).cast("bigint").alias("_by")
    ).filter("id IS NOT NULL AND _by IS NOT NULL AND NOT exists(v, x -> x IS NULL OR isnan(x))")
    keys = [f"c{i}" for i in range(max(1, len(axes)))]
    near = None
    if axes:
        cells = [F.floor(F.get("v", F.lit(a)) / radius).alias(k) for k, a in zip(keys, axes)]
        rows = rows.select("id", "v", "_by", *cells)
    else:
        pivots = choose_pivots(rows, n, len(spans))
        rows = cut(with_cell(rows, pivots))
        near = near_cells(rows, pivots, radius)
        if len(near) > MOST_NEAR * len(pivots.places) * (len(pivots.places) + 1) / 2:
            # Nearly all would meet: blocks of the whole table are fewer than those of cells.
            rows, near = rows.withColumn("c0", F.lit(0).cast("bigint")), np.zeros((1, 2), dtype=np.int64)
    places, keys = keys, ["_by", *keys]
    sizes = cut(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")))
    if block_rows is None:
        cells = sizes.limit(2).collect()
        block_rows = min(most, max(LEAST_ROWS, n // fewest))
        if len(cells) == 1 and not axes:
            # All blocks meet: they are as many as strips, or a multiple of that.
            most = min(most, max(1, STRIP_BLOCK_BYTES // (8 * max(1, len(spans)))))
            n, strips = cells[0]["_n"], most_strips(df.sparkSession)
            block_rows = max(min(most, LEAST_ROWS), -(-n // (strips * -(-n // (strips * most)))))
    counts = sizes.select(*keys, F.ceil(F.col("_n") / block_rows).cast("int").alias("_blocks"))
    part = F.pmod(F.xxhash64("id"), F.coalesce("_blocks", F.lit(1))).cast("int")
    blocks = (
        rows.join(counts.filter("_blocks > 1"), keys, "left")
        .withColumn("_block", part)
        .groupBy(*keys, "_block")
        .agg(F.collect_list(F.struct("id", "v")).alias("_members"))
        .select(*keys, "_block", F.col("_members.id").alias("ids"), F.flatten("_members.v").alias("vs"))
    )
    partners = _adjacent(counts, places) if near is None else _listed(counts, near)
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    pairs = (
        partners.join(counts, keys)
        .select(*keys, *[f"_{k}" for k in places], "_own", "_here", numbers("_blocks").alias("_block"))
        .select("*", numbers("_here").alias("_from"))
        .drop("_here")
        # Each two blocks of a cell once, and every block as often first as second.
        .filter("NOT _own OR _from = _block OR (_from > _block) = (pmod(_from + _block, 2) = 0)")
    )
    return blocks, pairs, len(spans)


def _adjacent(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Each cell of a grid ``_c0..`` with itself and every later adjacent cell ``c0..``."""
    origin = (0,) * len(keys)
    steps = [s for s in itertools.product((-1, 0, 1), repeat=len(keys)) if s >= origin]
    targets = F.array(
        *[
            F.struct(*[(F.col(f"_{k}") + F.lit(d)).alias(k) for k, d in zip(keys, step)], F.lit(step == origin).alias("_own"))
            for step in steps
        ]
    )
    here = counts.select("_by", *[F.col(k).alias(f"_{k}") for k in keys], F.col("_blocks").alias("_here"))
    return here.select("*", F.inline(targets))


def _listed(counts: DataFrame, near: np.ndarray) -> DataFrame:
    """The same for cells around pivots, whose pairs are few enough to be listed."""
    table = pa.table({"_c0": pa.array(near[:, 0], pa.int64()), "c0": pa.array(near[:, 1], pa.int64())})
    listed = counts.sparkSession.createDataFrame(table).withColumn("_own", F.col("_c0") == F.col("c0"))
    return listed.join(counts.select("_by", F.col("c0").alias("_c0"), F.col("_blocks").alias("_here")), "_c0")


def block_pairs(
    df: DataFrame, id_col: str = "id", features: str | Iterable[str] = "features", sigma: float = 0.42,
    tol: float = 1e-9, standardize: bool = True, block_rows: int | None = None,
) -> DataFrame:
    """The pairs of blocks that ``similarity_edges`` compares, without comparing them."""
    return _block_pairs(df, id_col, features, sigma, tol, standardize, block_rows, None)[1]


def near_weights(a: np.ndarray, b: np.ndarray, sigma: float, tol: float):
    """``at, to, i, j, weight`` for a tile of two blocks after the other: what is above the tolerance in it.

    ``i`` and ``j`` count from the tile's corner ``at, to``. Distances come from a matrix product.
    Those near the bound are worked out again from the differences, all of them where rounding could show in a weight.
    """
    a, b = (np.asarray(v, np.float64) for v in (a, b))
    bound = -math.log(tol) * sigma**2 if tol < 1 else 0.0
    p, q, p2, q2, room, exact = _centered(a, b, sigma)
    for at in range(0, len(a), COMPARED_ROWS):
        for to in range(0, len(b), COMPARED_ROWS):
            x, y = slice(at, at + COMPARED_ROWS), slice(to, to + COMPARED_ROWS)
            gaps = p[x] @ q[y].T
            gaps *= -2.0
            gaps += p2[x, None]
            gaps += q2[None, y]
            # Places in the flat tile: numpy finds them faster than pairs.
            found = np.flatnonzero(gaps <= bound + room)
            if not len(found):
                continue
            i, j = np.divmod(found, gaps.shape[1])
            squares = np.maximum(gaps.ravel()[found], 0.0)
            again = np.arange(len(i)) if exact else np.flatnonzero(squares >= bound - room)
            for part in range(0, len(again), 1 << 16):
                some = again[part : part + (1 << 16)]
                apart = a[at + i[some]] - b[to + j[some]]
                squares[some] = np.einsum("ij,ij->i", apart, apart)
            weight = np.exp(-squares / sigma**2)
            if len(again):
                kept = weight > tol
                i, j, weight = i[kept], j[kept], weight[kept]
            yield at, to, i, j, weight


def _centered(a: np.ndarray, b: np.ndarray, sigma: float):
    """Both blocks around the first one's middle, their squares, how far a bound may be missed, and if rounding could show."""
    middle = a.mean(axis=0)
    p, q = a - middle, b - middle
    p2, q2 = np.einsum("ij,ij->i", p, p), np.einsum("ij,ij->i", q, q)
    most = p2.max() + q2.max()
    return p, q, p2, q2, 1e-9 * (1.0 + most), 1e-15 * (8 + a.shape[1]) * most > WEIGHT_ERROR * sigma**2


def weight_tiles(a: np.ndarray, b: np.ndarray, sigma: float, tol: float):
    """``at, to, weights``: all weights of a tile of two blocks after the other, 0 where not above the tolerance.

    Tiles without any are left out; the next tile overwrites the weights. As in ``near_weights``, distances near the
    bound are worked out again, all of them where rounding could show. Exponents come from one matrix product.
    """
    a, b = (np.asarray(v, np.float64) for v in (a, b))
    p, q, p2, q2, room, exact = _centered(a, b, sigma)
    if exact:
        for at, to, i, j, weight in near_weights(a, b, sigma, tol):
            tile = np.zeros((min(COMPARED_ROWS, len(a) - at), min(COMPARED_ROWS, len(b) - to)))
            tile[i, j] = weight
            yield at, to, tile
        return
    square = sigma**2
    least, room = math.log(tol) if tol < 1 else 0.0, room / square
    left = np.hstack([p * (2 / square), -p2[:, None] / square, np.ones((len(a), 1))])
    right = np.vstack([q.T, np.ones(len(b)), -q2 / square])
    held = np.empty(TILE_ROWS * TILE_COLUMNS)
    for at in range(0, len(a), TILE_ROWS):
        for to in range(0, len(b), TILE_COLUMNS):
            x, y = left[at : at + TILE_ROWS], right[:, to : to + TILE_COLUMNS]
            tile = np.matmul(x, y, out=held[: len(x) * y.shape[1]].reshape(len(x), y.shape[1]))
            near = tile > least - room
            found, sure = np.count_nonzero(near), np.count_nonzero(tile > least + room)
            if not found:
                continue
            i, j = np.nonzero(near & (tile <= least + room)) if sure < found else ((), ())
            np.exp(tile, out=tile)
            tile *= near
            for part in range(0, len(i), 1 << 16):
                k, m = i[part : part + (1 << 16)], j[part : part + (1 << 16)]
                apart = a[at + k] - b[to + m]
                weight = np.exp(-np.einsum("ij,ij->i", apart, apart) / square)
                tile[k, m] = np.where(weight > tol, weight, 0.0)
            yield at, to, tile


def block_numbers(column, row: int) -> np.ndarray:
    """The values of one row of a list column."""
    return column[row].values.to_numpy(zero_copy_only=False)


def _edge_finder(width: int, sigma: float, tol: float):
    """The Arrow function that compares joined pairs of blocks."""

    def find(batches):
        for batch in batches:
            same, *columns = batch.columns
            for row in range(batch.num_rows):
                l_ids, l_vs, r_ids, r_vs = (block_numbers(c, row) for c in columns)
                own = same[row].as_py()
                for at, to, i, j, weight in near_weights(l_vs.reshape(-1, width), r_vs.reshape(-1, width), sigma, tol):
                    x, y = l_ids[at + i], r_ids[to + j]
                    if own:
                        once = x >= y
                        x, y, weight = x[once], y[once], weight[once]
                    if len(x):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.maximum(x, y)), pa.array(np.minimum(x, y)), pa.array(weight)], ["src", "dst", "weight"]
                        )

    return find


def mirrored(edges: DataFrame) -> DataFrame:
    """Both directions of every edge of a triangle, the diagonal once."""
    there = F.struct("src", "dst")
    back = F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"))
    ways = F.when(F.col("src") == F.col("dst"), F.array(there)).otherwise(F.array(there, back))
    return edges.select(F.inline(ways), "weight")


def symmetric_graph(
    df: DataFrame,
    id_col: str = "id",
    features: str | Iterable[str] = "features",
    sigma: float = 0.7,
    tol: float = 1e-9,
    standardize: bool = True,
) -> DataFrame:
    """All ordered pairs, both directions and the diagonal, above the tolerance."""
    return mirrored(similarity_edges(df, id_col, features, sigma, tol, standardize))


def mean_symmetric(entries: DataFrame) -> DataFrame:
    """Mirror every entry and average what meets in one cell."""
    there = F.struct("src", "dst")
    back = F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return (
        entries.select(F.inline(F.array(there, back)), "weight")
        .groupBy("src", "dst")
        .agg(F.avg("weight").alias("weight"))
    )


def degrees(edges: DataFrame) -> DataFrame:
    """Row sums of the symmetric matrix that a triangle stands for.

    An edge counts for both its ends. The ends are exploded from one scan
    instead of a union of two.
    """
    both = F.array("src", "dst")
    ends = F.when(F.col("src") == F.col("dst"), F.array("src")).otherwise(both)
    return (
        edges.select(F.explode(ends).alias("id"), "weight")
        .groupBy("id")
        .agg(F.sum("weight").alias("degree"))
    )


def matrix_product(a: DataFrame, b: DataFrame, symmetric: bool = False) -> DataFrame:
    """``C = A x B`` over entries; ``symmetric`` mirrors and averages A first.

    An inner key with very many entries on either side is split on that side, and
    only its partners are copied.
    """
    left = mean_symmetric(a) if symmetric else a
    left = left.select(F.col("src"), F.col("dst").alias("_inner"), F.col("weight").alias("_a"))
    right = b.select(F.col("src").alias("_inner"), F.col("dst"), F.col("weight").alias("_b"))
    keys, hot = ["_inner"], hot_keys(right, ["_inner"])
    if hot is not None:
        right = salted(right, ["_inner"], hot, ["dst"]).withColumnRenamed("_salt", "_part")
        left = replicated(left, ["_inner"], hot).withColumnRenamed("_salt", "_part")
        keys = ["_inner", "_part"]
    return (
        salted_join(left, right, keys, spread_by=["src"])
        .groupBy("src", "dst")
        .agg(F.sum(F.col("_a") * F.col("_b")).alias("weight"))
    )


def _divided(edges: DataFrame, sums: DataFrame, key: str) -> DataFrame:
    by = sums.select(F.col("id").alias(key), "degree")
    other = "src" if key == "dst" else "dst"
    return salted_join(edges, by, [key], spread_by=[other]).select(
        "src", "dst", (F.col("weight") / F.col("degree")).alias("weight")
    )


def transition_matrix(edges: DataFrame, normalization: str = "row_stochastic") -> DataFrame:
    """Transition matrix of a triangle of edges.

    ``row_stochastic`` divides the whole symmetric matrix by column sums, then by
    row sums, and gives every entry. ``folded`` does the same to the stored
    triangle, with sums that count each entry for both its ends, and gives a
    triangle that is mirrored on use. The entries are read several times, so they
    are written out first.
    """
    if normalization == "row_stochastic":
        full = cut(mirrored(edges))
        by_column = cut(_divided(full, _sums(full, "dst"), "dst"))
        return _divided(by_column, _sums(by_column, "src"), "src")
    if normalization == "folded":
        edges = cut(edges)
        by_column = cut(_divided(edges, degrees(edges), "dst"))
        return _divided(by_column, degrees(by_column), "src")
    raise ValueError(f"unknown normalization {normalization!r}")


def _sums(entries: DataFrame, key: str) -> DataFrame:
    return entries.groupBy(F.col(key).alias("id")).agg(F.sum("weight").alias("degree"))


def rows_of(entries: DataFrame, k: int, output: str = "scores") -> DataFrame:
    """Matrix entries as one array of ``k`` values per row."""
    cells = [
        F.coalesce(F.sum(F.when(F.col("dst") == c, F.col("weight"))), F.lit(0.0)) for c in range(k)
    ]
    return entries.groupBy(F.col("src").alias("id")).agg(F.array(*cells).alias(output))

