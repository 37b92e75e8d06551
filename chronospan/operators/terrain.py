"""Horizon profiles over an elevation grid, and the share of the sky path above them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Cells of a tile in each direction; a tile also holds the first cells of the tiles behind it.
TILE = 64


def tiles(dem: DataFrame, size: int = TILE) -> DataFrame:
    """tile_row, tile_col, at (places in a square of size + 1), z: the grid (row, col, elevation) in tiles with a halo of one cell."""
    r, c = F.col("row"), F.col("col")
    own = lambda x: F.when(F.pmod(x, F.lit(size)) == 0, F.array(F.floor(x / size), F.floor(x / size) - 1)).otherwise(F.array(F.floor(x / size)))
    placed = dem.where("elevation is not null").select("elevation", r.alias("r"), c.alias("c"), F.explode(own(r)).alias("tile_row"), own(c).alias("_cols"))
    placed = placed.select("elevation", "r", "c", "tile_row", F.explode("_cols").alias("tile_col"))
    at = ((F.col("r") - F.col("tile_row") * size) * (size + 1) + F.col("c") - F.col("tile_col") * size).cast("int")
    grouped = placed.groupBy("tile_row", "tile_col").agg(F.collect_list(F.struct(at.alias("at"), F.col("elevation").cast("double").alias("z"))).alias("_cells"))
    return grouped.select("tile_row", "tile_col", F.col("_cells.at").alias("at"), F.col("_cells.z").alias("z"))


def horizon_profile(points: DataFrame, dem: DataFrame, by: list[str], n_directions: int = 360, max_distance: float = 5000.0, step: float = 20.0, res_x: float = 1.0, res_y: float = 1.0, compass: bool = True, tile: int = TILE) -> DataFrame:
    """by, azimuth, horizon (degrees): the highest elevation angle along each ray from each point.

    points: by, row0, col0 (nearest cells of the elevation grid); dem: row, col, elevation. Rays go through
    ``distances`` = step, 2 step, ... up to max_distance; a sample is interpolated between its four cells and is
    missing if one of them is. Azimuth k * 360 / n_directions turns clockwise from North (falling rows), or, without ``compass``,
    counter-clockwise from the first axis (rising columns). A ray without a sample has no horizon (NULL). Points outside the grid raise.

    Rays depend on the cell alone, so they are cast once for each cell that has points, however many stand there. A cell meets
    each tile that one of its rays crosses once, and gets one maximum per ray and tile back.
    """
    # A step more than the last below max_distance, as far as max_distance + step (exclusive).
    count = -int(-(max_distance + step) // step) - 1
    start = points.select("row0", "col0").distinct().join(dem.select(F.col("row").alias("row0"), F.col("col").alias("col0"), F.col("elevation").cast("double").alias("z0")), ["row0", "col0"], "left")
    start = start.withColumn("z0", F.when(F.col("z0").isNull(), F.raise_error(F.lit("a point lies outside the elevation grid")).cast("double")).otherwise(F.col("z0")))
    start = start.select(F.col("row0").cast("double").alias("row0"), F.col("col0").cast("double").alias("col0"), "z0")

    def rays(row0: float, col0: float) -> tuple[np.ndarray, np.ndarray]:
        """Rows and columns of all samples of a point: direction by distance. Nine digits: a ray along an axis stays on it."""
        angle = np.radians(np.arange(n_directions) * (360.0 / n_directions))[:, None]
        north, east = (np.cos(angle), np.sin(angle)) if compass else (np.sin(angle), np.cos(angle))
        d = np.arange(1, count + 1) * step
        return np.round(row0 - north * d / res_y, 9), np.round(col0 + east * d / res_x, 9)

    def cross(batches):
        for b in batches:
            keep, rows, cols, directions = [], [], [], []
            for i, (r0, c0) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
                y, x = rays(r0, c0)
                crossed = np.unique(np.stack([np.floor(y / tile).ravel(), np.floor(x / tile).ravel(), np.repeat(np.arange(n_directions), count)]), axis=1).astype(np.int64)
                cuts = np.flatnonzero((np.diff(crossed[:2]) != 0).any(axis=0)) + 1
                for part in np.split(crossed, cuts, axis=1):
                    keep, rows, cols = [*keep, i], [*rows, part[0, 0]], [*cols, part[1, 0]]
                    directions.append(part[2].tolist())
            yield pa.RecordBatch.from_arrays([*[c.take(pa.array(keep, pa.int32())) for c in b.columns], pa.array(rows, pa.int64()), pa.array(cols, pa.int64()), pa.array(directions, pa.list_(pa.int64()))], [*b.schema.names, "tile_row", "tile_col", "directions"])

    def highest(batches):
        for b in batches:
            keep, which, best = [], [], []
            columns = [c.to_pylist() for c in b.columns]
            for i, (r0, c0, z0, tile_row, tile_col, directions, at, z) in enumerate(zip(*columns, strict=True)):
                cells = np.full((tile + 1) * (tile + 1), np.nan)
                if at is not None:
                    cells[at] = z
                cells = np.pad(cells.reshape(tile + 1, tile + 1), ((0, 1), (0, 1)), constant_values=np.nan)
                y, x = (v[directions] for v in rays(r0, c0))
                r, c = np.floor(y), np.floor(x)
                here = (np.floor(y / tile) == tile_row) & (np.floor(x / tile) == tile_col)
                i0, j0 = (np.where(here, v - k * tile, 0).astype(int) for v, k in ((r, tile_row), (c, tile_col)))
                height = np.zeros(y.shape)
                for di in (0, 1):
                    for dj in (0, 1):
                        w = np.where(di, y - r, 1 - (y - r)) * np.where(dj, x - c, 1 - (x - c))
                        # Corners of no weight need not exist: a sample may lie on the last row or column.
                        height += np.where(w > 0, w * cells[i0 + di, j0 + dj], 0.0)
                up = np.degrees(np.arctan2(height - z0, np.arange(1, count + 1) * step))
                top = np.where(here & ~np.isnan(up), up, -np.inf).max(axis=1)
                keep += [i] * len(directions)
                which += directions
                best.append(np.where(np.isfinite(top), top, np.nan))
            yield pa.RecordBatch.from_arrays([*[c.take(pa.array(keep, pa.int32())) for c in b.columns[:2]], pa.array(which, pa.int64()), pa.array(np.concatenate([*best, np.empty(0)]), from_pandas=True)], ["row0", "col0", "_a", "h"])

    crossed = start.mapInArrow(cross, "row0 double, col0 double, z0 double, tile_row long, tile_col long, directions array<long>")
    met = crossed.join(tiles(dem, tile), ["tile_row", "tile_col"], "left").select("row0", "col0", "z0", "tile_row", "tile_col", "directions", "at", "z")
    found = met.mapInArrow(highest, "row0 double, col0 double, _a long, h double")
    profile = found.groupBy("row0", "col0", "_a").agg(F.max("h").alias("h")).groupBy("row0", "col0").agg(F.collect_list(F.struct("_a", "h")).alias("_rays"))
    here = points.select(*by, F.col("row0").cast("double").alias("row0"), F.col("col0").cast("double").alias("col0"))
    rows = here.join(profile, ["row0", "col0"]).select(*by, F.explode("_rays").alias("_ray"))
    return rows.groupBy(*by, (F.lit(360.0 / n_directions) * F.col("_ray._a")).alias("azimuth")).agg(F.max("_ray.h").alias("horizon"))


def illuminated_fraction(path: DataFrame, profile: DataFrame, by: list[str], day: str, order: str, altitude: str, per_day: int = 360) -> DataFrame:
    """by, day, fraction: samples whose altitude is at least the horizon's of the same number, over per_day.

    path: by, day, order (0, 1, ... within the day), altitude; profile: by, order, horizon. Sample k meets horizon k by
    its number, whatever its azimuth. Samples with a missing altitude or horizon are not above it.
    """
    met = path.join(profile.select(*by, order, "horizon"), [*by, order], "left")
    above = F.coalesce(F.col(altitude) >= F.col("horizon"), F.lit(False))
    return met.groupBy(*by, day).agg((F.count(F.when(above, 1)) / per_day).alias("fraction"))
