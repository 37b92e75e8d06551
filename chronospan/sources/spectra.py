"""Reading measurements: regularisation to the grid, overlaps, derived channels, ranges, metadata."""

from __future__ import annotations

import math
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.grid import UTC_FORMAT, UTC_SPARK, time_index
from ..functions.maths import magnitude, phase

CHANNELS = ("pol00", "pol11", "pol01_mag", "pol01_phase")
COMPONENTS = ("pol00", "pol11", "pol01r", "pol01i")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def timestamp_dirs(files: DataFrame, path: str = "path") -> DataFrame:
    """files below a directory whose name is exactly ten digits, with those as unix_s and the file's component name."""
    return files.withColumn("unix_s", F.regexp_extract(path, r"/(\d{10})/[^/]+$", 1)).where("unix_s <> ''").withColumn("unix_s", F.col("unix_s").cast("long")).withColumn("component", F.regexp_extract(path, r"/(pol[^/.]+)\.[^/]+$", 1))


def component_paths(files: DataFrame, path: str = "path") -> DataFrame:
    """dir, unix_s and the path of each component's file (NULL where there is none), from the files of timestamp_dirs()."""
    dirs = timestamp_dirs(files, path).withColumn("dir", F.regexp_extract(path, r"^(.*)/[^/]+$", 1))
    return dirs.groupBy("dir", "unix_s").pivot("component", list(COMPONENTS)).agg(F.max(path))


def join_components(parts: dict[str, DataFrame], keys: list[str], value: str = "values") -> DataFrame:
    """keys and one column per component, from a table (keys, value) for each; keys that a component lacks keep a NULL there. An equi-join on the keys."""
    out = None
    for name in COMPONENTS:
        part = parts[name].select(*keys, F.col(value).alias(name))
        out = part if out is None else out.join(part, keys, "full")
    return out


def _raise_if_none(n: Column, value: Column, what: str) -> Column:
    return F.when(n == 0, F.raise_error(F.lit(what))).otherwise(value)


def in_range(dirs: DataFrame, start: float, stop: float, need: bool = False) -> DataFrame:
    """Directories from floor(start) to ceil(stop), both included, in time order; with ``need``, none at all raises at once."""
    found = dirs.where(F.col("unix_s").between(math.floor(start), math.ceil(stop))).orderBy("unix_s")
    if need and found.isEmpty():
        raise FileNotFoundError(f"no directory between {start} and {stop}")
    return found


def bounds(rows: DataFrame, ts: str) -> DataFrame:
    """start and stop of a timestamp column as texts; raises when computed if there is no time."""
    n = F.count(ts)
    text = lambda x: _raise_if_none(n, F.date_format(x, UTC_SPARK), "no time to take bounds from").cast("string")
    return rows.agg(text(F.min(ts)).alias("start"), text(F.max(ts)).alias("stop"))


def reject_reason(width: int, blocks: bool = False) -> Column:
    """Why a row of component arrays can't be used: missing, shape (unequal sizes), width; NULL if it can.

    blocks: components are arrays of spectra (arrays), which have to be equally many and all ``width`` wide.
    """
    missing, unequal = F.lit(False), F.lit(False)
    for c in COMPONENTS:
        missing = missing | F.col(c).isNull()
        unequal = unequal | (F.size(c) != F.size(COMPONENTS[0]))
        if blocks:
            unequal = unequal | F.exists(c, lambda x: F.coalesce(F.size(x), F.lit(-1)) != F.size(F.element_at(COMPONENTS[0], 1)))
    wide = F.size(F.element_at(COMPONENTS[0], 1)) if blocks else F.size(COMPONENTS[0])
    return F.when(missing, "missing").when(unequal, "shape").when(wide != width, "width")


def complete(rows: DataFrame, width: int, blocks: bool = False) -> DataFrame:
    """Rows whose four component arrays are present, of equal shape and as wide as they should be."""
    return rows.where(reject_reason(width, blocks).isNull())


def reject_counts(rows: DataFrame, width: int, blocks: bool = False) -> DataFrame:
    """reason, n of the rows that complete() leaves out."""
    return rows.select(reject_reason(width, blocks).alias("reason")).where("reason is not null").groupBy("reason").agg(F.count("*").alias("n"))


def place_blocks(rows: DataFrame, unix_s: str, t0: float, dt: float, nt: int, values: list[str], out: str = "t_idx") -> DataFrame:
    """One row per spectrum of each block: ``values`` are equally long arrays, whose k-th entries belong to the block's index + k; cut off at the grid's ends."""
    others = [c for c in rows.columns if c not in values]
    placed = rows.withColumn("_i0", time_index(F.col(unix_s), t0, dt)).where(F.col("_i0") < nt)
    spread = placed.select(*others, "_i0", F.posexplode(F.arrays_zip(*values)).alias("_k", "_v"))
    return spread.withColumn(out, F.col("_i0") + F.col("_k")).where(F.col(out).between(0, nt - 1)).select(*others, out, *[F.col(f"_v.{v}").alias(v) for v in values])


def dense(rows: DataFrame, nt: int, by: list[str] | None = None, t: str = "t_idx") -> DataFrame:
    """rows and, for each index of the grid (of each group ``by``) without a row, one of NULLs."""
    by = by or []
    grid = rows.sparkSession.range(nt).withColumnRenamed("id", t)
    if by:
        grid = rows.select(*by).distinct().withColumn(t, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(nt - 1).cast("long"))))
    return grid.join(rows, [*by, t], "left")


def regularize(rows: DataFrame, unix_s: str, t0: float, dt: float, nt: int, out: str = "t_idx") -> DataFrame:
    """rows with their nearest grid index (halves up); those off the grid drop out."""
    return rows.withColumn(out, time_index(F.col(unix_s), t0, dt)).where(F.col(out).between(0, nt - 1))


def last_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of rows with equal keys, the latest in ``order``."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order]))
    return rows.withColumn("_r", rank).where("_r = 1").drop("_r")


def derive_channels(rows: DataFrame) -> DataFrame:
    """The four channels from component arrays."""
    zip_ = lambda f: F.zip_with("pol01r", "pol01i", f)
    return rows.select(*[c for c in rows.columns if c not in ("pol01r", "pol01i")], zip_(magnitude).alias("pol01_mag"), zip_(phase).alias("pol01_phase"))


def time_range(rows: DataFrame, start: float, stop: float, t0: float, dt: float, nt: int, t: str = "t_idx") -> DataFrame:
    """Samples of [start, stop): from floor to ceil of the bounds' indices, clipped to the grid; may be empty."""
    if stop <= start:
        raise ValueError("stop must lie after start")
    lo, hi = max(0, math.floor((start - t0) / dt)), min(nt, math.ceil((stop - t0) / dt))
    return rows.where((F.col(t) >= lo) & (F.col(t) < hi))


def write_spectra(rows: DataFrame, path: str, partitions: tuple[str, ...] = ("station", "date")) -> None:
    rows.write.mode("overwrite").partitionBy(*[p for p in partitions if p in rows.columns]).option("compression", "zstd").parquet(path)


#: The keys of a measurement's description that are shown, in order.
META_KEYS = ["station", "startutc", "stoputc", "created_utc", "nt", "nchan", "dt_seconds", "f0_mhz", "df_mhz", "source_root"]


def cube_meta(spark: SparkSession, station: str, t0: float, dt: float, nt: int, nchan: int, f0_mhz: float, df_mhz: float, source_root: str, created: datetime | None = None) -> DataFrame:
    """One row that describes a measurement; it lies as a small table beside the spectra."""
    text = lambda s: datetime.fromtimestamp(s, timezone.utc).strftime(UTC_FORMAT)
    made = (created or datetime.now(timezone.utc)).strftime(UTC_FORMAT)
    row = (station, text(t0), text(t0 + nt * dt), made, nt, nchan, float(dt), float(t0), float(f0_mhz), float(df_mhz), source_root, list(CHANNELS))
    return spark.createDataFrame([row], "station string, startutc string, stoputc string, created_utc string, nt long, nchan long, dt_seconds double, t0_unix_seconds double, f0_mhz double, df_mhz double, source_root string, channel_labels array<string>")


def open_spectra(spark: SparkSession, path: str, meta_path: str) -> tuple[DataFrame, dict]:
    """The spectra below path with each sample's time (``ts``, from its index), and their description as a dict."""
    found = spark.read.parquet(meta_path).first()
    if found is None:
        raise FileNotFoundError(f"no description in {meta_path}")
    meta = found.asDict()
    us = F.floor((F.lit(meta["t0_unix_seconds"]) + F.col("t_idx") * meta["dt_seconds"]) * 1e6 + 0.5).cast("long")
    return spark.read.parquet(path).withColumn("ts", F.timestamp_micros(us)), meta


def meta_rows(meta: DataFrame, keys: list[str] | None = None, all_keys: bool = False) -> DataFrame:
    """One row per key in order (META_KEYS if none are given); ``<missing>`` where the table lacks it or it is null. all_keys: the table's other columns follow."""
    keys = list(META_KEYS if keys is None else keys)
    if all_keys:
        keys += [c for c in meta.columns if c not in keys]
    have = set(meta.columns)
    pairs = [F.struct(F.lit(i).alias("i"), F.lit(k).alias("key"), F.coalesce(F.col(k).cast("string") if k in have else F.lit(None).cast("string"), F.lit("<missing>")).alias("value")) for i, k in enumerate(keys)]
    return meta.select(F.explode(F.array(*pairs)).alias("p")).select("p.*")
