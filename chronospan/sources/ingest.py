"""From a tree of raw files to a cube and its description: listing by name, decoding, validation, the grid, overlaps, channels, writing.

Directories are named by the second they begin at, ten digits. A range of time is turned into globs over digits, so directories
outside it are not even listed, whatever store the tree lies in. Files come as bytes, and a decoder, a function of these, gives a matrix
(times by frequencies) or None; nothing here knows a file format.
"""

from __future__ import annotations

import gzip
import math
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.grid import time_index
from . import spectra

DIGITS = 10


def covering(lo: int, hi: int, digits: int = DIGITS) -> list[str]:
    """The fewest prefixes whose numbers of ``digits`` digits are those from lo to hi: at most 18 for each digit."""

    def walk(prefix: str) -> list[str]:
        rest = digits - len(prefix)
        low, high = int((prefix or "") + "0" * rest), int((prefix or "") + "9" * rest)
        if high < lo or low > hi:
            return []
        if lo <= low and high <= hi:
            return [prefix]
        return [p for d in "0123456789" for p in walk(prefix + d)]

    return walk("")


def globs(lo: int, hi: int, digits: int = DIGITS) -> str:
    """One glob for the names of ``digits`` digits from lo to hi."""
    found = [p + "[0-9]" * (digits - len(p)) for p in covering(lo, hi, digits)]
    if not found:
        raise FileNotFoundError(f"no name from {lo} to {hi}")
    return found[0] if len(found) == 1 else "{" + ",".join(found) + "}"


def text_decoder(content: bytes) -> np.ndarray | None:
    """Lines of numbers with commas between them, compressed or not; None if they are no matrix."""
    try:
        lines = (gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content).decode().split("\n")
        rows = [np.array(line.split(","), np.float32) for line in lines if line]
    except (ValueError, OSError, EOFError):
        return None
    return np.stack(rows) if rows and len({len(r) for r in rows}) == 1 else None


def raw_files(spark: SparkSession, root: str, start: float | None = None, stop: float | None = None, parents: str = "*/", name: str = "", files: str = "pol*") -> DataFrame:
    """path, unix_s, component, content of the files of directories from floor(start) to ceil(stop), both included.

    parents: what lies between root and these directories, as a glob; name: what their names have before the digits; files: a glob of
    their files, or of what leads there. Raises if there is none.
    """
    lo = 0 if start is None else math.floor(start)
    hi = 10**DIGITS - 1 if stop is None else math.ceil(stop)
    where = f"{root.rstrip('/')}/{parents}{name}{globs(lo, hi)}/{files}"
    try:
        # The directories' names are no partition columns.
        found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(where)
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            raise FileNotFoundError(f"no directory of {root} from {lo} to {hi}") from e
        raise
    unix = F.regexp_extract("path", rf"/{name}(\d{{{DIGITS}}})/", 1).cast("long")
    directory = F.regexp_extract("path", rf"^(.*/{name}\d{{{DIGITS}}})/", 1)
    component = F.regexp_extract("path", rf"/{name}\d{{{DIGITS}}}/(?:[^/]*=)?({'|'.join(sorted(spectra.COMPONENTS, key=len, reverse=True))})\b", 1)
    return found.select("path", directory.alias("dir"), unix.alias("unix_s"), component.alias("component"), "content").where("component <> ''")


def decoded(files: DataFrame, decoder: Callable[[bytes], np.ndarray | None]) -> DataFrame:
    """dir, unix_s, component, n (times), width, values (flat) of each file; what the decoder refuses has NULLs."""
    kinds = "dir string, unix_s long, component string, n int, width int, values array<float>"

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):  # one file at a time
                b = batch.slice(i, 1)
                x = decoder(b.column(3)[0].as_py())
                x = None if x is None or x.ndim != 2 or not x.size else np.ascontiguousarray(x, np.float32)
                facts = [None, None, None] if x is None else [x.shape[0], x.shape[1], x.ravel()]
                yield pa.RecordBatch.from_arrays([*b.columns[:3], *(pa.array([v], t) for v, t in zip(facts, (pa.int32(), pa.int32(), pa.list_(pa.float32())), strict=True))], ["dir", "unix_s", "component", "n", "width", "values"])

    return files.select("dir", "unix_s", "component", "content").mapInArrow(run, kinds)


def directories(parts: DataFrame, width: int) -> DataFrame:
    """dir, unix_s, n, a column of flat values for each component, and reason: missing, shape (unequal sizes), width; NULL if all is well."""
    of = lambda c: F.max(F.when(F.col("component") == c, F.struct("n", "width", "values"))).alias(c)
    rows = parts.where("values is not null").groupBy("dir", "unix_s").agg(*map(of, spectra.COMPONENTS))
    rows = parts.select("dir", "unix_s").distinct().join(rows, ["dir", "unix_s"], "left")
    missing, unequal, first = F.lit(False), F.lit(False), spectra.COMPONENTS[0]
    for c in spectra.COMPONENTS:
        missing = missing | F.col(c).isNull()
        unequal = unequal | (F.col(f"{c}.n") != F.col(f"{first}.n")) | (F.col(f"{c}.width") != F.col(f"{first}.width"))
    reason = F.when(missing, "missing").when(unequal, "shape").when(F.col(f"{first}.width") != width, "width")
    return rows.select("dir", "unix_s", F.col(f"{first}.n").alias("n"), *[F.col(f"{c}.values").alias(c) for c in spectra.COMPONENTS], reason.alias("reason"))


def spectra_of(rows: DataFrame, t0: float, dt: float, nt: int, width: int) -> DataFrame:
    """t_idx and the four channels as arrays, one row for each index that a directory holds. Of overlapping ones the later directory
    wins, with all its values, missing ones included; the grid ends at nt."""
    spread = rows.where("reason is null").withColumn("_i0", time_index(F.col("unix_s"), t0, dt)).select("dir", "unix_s", "_i0", *spectra.COMPONENTS, F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("_k"))
    spread = spread.withColumn("t_idx", F.col("_i0") + F.col("_k")).where(F.col("t_idx").between(0, nt - 1))
    one = F.struct(*[F.slice(c, F.col("_k") * width + 1, F.lit(width)).alias(c) for c in spectra.COMPONENTS])
    latest = spread.select("t_idx", F.struct("unix_s", "dir").alias("_order"), one.alias("_v")).groupBy("t_idx").agg(F.max_by("_v", "_order").alias("_v"))
    return spectra.derive_channels(latest.select("t_idx", "_v.*"))


@dataclass(frozen=True)
class Ingested:
    """Where the cube and its description lie, and the directories that were left out, with the reason."""

    cube: str
    meta: str
    rejects: DataFrame


def ingest(spark: SparkSession, root: str, out: str, station: str, decoder: Callable[[bytes], np.ndarray | None], dt: float, width: int, start: float | None = None, stop: float | None = None, infer_stop: str = "data_end", f0_mhz: float = 0.0, df_mhz: float = 1.0, created: datetime | None = None, **layout) -> Ingested:
    """Reads the tree (see raw_files) and writes the cube, by station and date, and its description below ``out``; what is there for these dates is replaced.

    Without a start the grid begins with the first directory. Without a stop it ends with the last one's data (infer_stop="data_end") or
    with that one's first sample ("dir_start"). The same tree gives the same cube, however often it is read.
    """
    if infer_stop not in ("data_end", "dir_start"):
        raise ValueError("infer_stop is data_end or dir_start")
    rows = directories(decoded(raw_files(spark, root, start, stop, **layout), decoder), width)
    ends = rows.agg(F.min("unix_s").alias("lo"), F.max("unix_s").alias("hi"), F.max(F.when(F.col("reason").isNull(), F.col("unix_s") + F.col("n") * dt)).alias("end")).first()
    t0 = float(ends["lo"] if start is None else start)
    if stop is not None:
        nt = math.ceil((stop - t0) / dt)
    elif infer_stop == "dir_start":
        nt = math.floor((ends["hi"] - t0) / dt + 0.5) + 1
    else:
        nt = math.floor(((ends["end"] or t0) - t0) / dt + 0.5)
    cube = spectra_of(rows, t0, dt, nt, width).withColumn("station", F.lit(station)).withColumn("date", F.to_date(F.timestamp_seconds(F.lit(t0) + F.col("t_idx") * dt)))
    cube.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("station", "date").parquet(f"{out}/cube")
    meta = spectra.cube_meta(spark, station, t0, dt, nt, width, f0_mhz, df_mhz, root, created)
    meta.write.mode("overwrite").parquet(f"{out}/meta")
    return Ingested(f"{out}/cube", f"{out}/meta", rows.where("reason is not null").select("dir", "unix_s", "reason"))
