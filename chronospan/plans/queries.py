"""Queries over the given tables and the DuckDB SQL that gives the same rows.

``events`` stands in for a time-frequency cube: hourly samples from 2024-01-01 (720 of them), 16 channels
(user_id % 16), power = sum(value); where stations are told apart, there are three of them (event_id % 3).
Stand-ins for gaps: NaN and infinities at fixed places (``gappy``). ``lineitem`` stands in for four polarisation products
per row.
"""

from __future__ import annotations

import random
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import maths, selection
from ..functions.grid import FramePlan, plan_frames, unix_seconds
from ..operators import background, cube, frames, metrics, order_stats, pixel_pca, range_finder, rois, rolling, search, series, terrain
from ..sources import ingest, spectra
from ..sources.tables import shared_folder, written
from .pipeline import Pipeline, db_step, stokes_i_step
from .recipes import INSTRUMENTAL, STOKES_FRACTIONAL, stokes_pipeline

T0, DT, NT, NF = 1_704_067_200.0, 3600.0, 720, 16
MASK = (3, 6)
KEPT = selection.FreqMask.without(NF, *MASK)
WINDOW, STEP = 6, 2
SIZE = WINDOW * KEPT.size

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def r(x, digits: int = 6):
    return F.round(x, digits) + F.lit(0.0)


# ---- stand-ins ------------------------------------------------------------------------------------------------


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spectra.table(spark, sf_dir, "events")
    return spectra.regularize(events.withColumn("unix_s", unix_seconds(F.col("ts"))), "unix_s", T0, DT, NT).withColumn("f_idx", F.col("user_id") % NF)


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples(spark, sf_dir).groupBy("t_idx", "f_idx").agg(F.sum("value").alias("power"))


def masked(cells_: DataFrame) -> DataFrame:
    return KEPT.rows(cells_)


def gappy(x: str) -> Column:
    """x of a cell (t_idx, f_idx) with NaN, +inf and -inf at fixed places."""
    k = (F.col("t_idx") * 7 + F.col("f_idx")) % 29
    return F.when(k.isin(3, 11, 20), float("nan")).when(k == 5, float("inf")).when(k == 17, float("-inf")).otherwise(F.col(x))


def station_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = samples(spark, sf_dir).withColumn("station", F.concat(F.lit("S"), F.col("event_id") % 3))
    return rows.groupBy("station", "t_idx", "f_idx").agg(F.sum("value").alias("power"))


def start_us(frame: Column, step: int = 2) -> Column:
    """When a frame begins, of frames every ``step`` samples."""
    return F.lit(int(T0) * 1_000_000) + frame * int(step * DT) * 1_000_000


def plan():
    return plan_frames(NT, T0, DT, T0, T0 + NT * DT, WINDOW * DT, STEP * DT)


def framed(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready = masked(cells(spark, sf_dir)).withColumn("db", maths.safe_db(F.col("power")))
    return frames.assign(ready, plan())


def frame_scores(spark: SparkSession, sf_dir: str, method: str = "p99", **options) -> DataFrame:
    return metrics.score(framed(spark, sf_dir), ["frame_idx"], "db", SIZE, method, **({"min_finite_frac": 0.5} | options))


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spectra.table(spark, sf_dir, "lineitem")
    re, im = F.col("l_discount") - 0.05, F.col("l_tax") - 0.04
    return rows.select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("pol00"), (F.col("l_extendedprice") / 1000).alias("pol11"), maths.magnitude(re, im).alias("pol01_mag"), maths.phase(re, im).alias("pol01_phase"))


_SAMPLES = """samples AS (
  SELECT *, CAST(floor((epoch_us(ts) / 1e6 - 1704067200.0) / 3600.0 + 0.5) AS BIGINT) AS t_idx, user_id % 16 AS f_idx FROM events
  WHERE floor((epoch_us(ts) / 1e6 - 1704067200.0) / 3600.0 + 0.5) BETWEEN 0 AND 719
), cells AS (SELECT t_idx, f_idx, sum(value) AS power FROM samples GROUP BY ALL)"""
_FRAMED = _SAMPLES + """, framed AS (
  SELECT k AS frame_idx, t_idx, f_idx, 10 * log10(greatest(power, 1e-12)) AS db
  FROM range(358) AS x(k) JOIN cells ON t_idx >= 2 * k AND t_idx < 2 * k + 6 WHERE NOT (f_idx >= 3 AND f_idx < 6)
)"""
_PRODUCTS = """products AS (
  SELECT l_orderkey, l_linenumber, l_quantity AS pol00, l_extendedprice / 1000 AS pol11,
         sqrt((l_discount - 0.05) ** 2 + (l_tax - 0.04) ** 2) AS pol01_mag, atan2(l_tax - 0.04, l_discount - 0.05) AS pol01_phase FROM lineitem
)"""


_STATIONS = """station_cells AS (
  SELECT 'S' || (event_id % 3) AS station, t_idx, f_idx, sum(value) AS power FROM samples GROUP BY ALL)"""
_GAPPY = "CASE WHEN ({t} * 7 + {f}) % 29 IN (3, 11, 20) THEN 'nan'::DOUBLE WHEN ({t} * 7 + {f}) % 29 = 5 THEN 'infinity'::DOUBLE WHEN ({t} * 7 + {f}) % 29 = 17 THEN '-infinity'::DOUBLE ELSE {x} END"


def _metric_sql(expression: str, frac: float = 0.5, source: str = "framed") -> str:
    return f"WITH {_FRAMED} SELECT frame_idx, count(db) AS n_finite, round(CASE WHEN count(db) >= {frac} * 78 THEN {expression} END, 6) AS score FROM {source} GROUP BY frame_idx"


# ---- sources --------------------------------------------------------------------------------------------------


@query(f"WITH {_SAMPLES} SELECT t_idx, f_idx, round(power, 4) AS power FROM cells")
def grid_regularize(spark, sf_dir):
    return cells(spark, sf_dir).withColumn("power", r("power", 4))


@query(f"WITH {_SAMPLES} SELECT t_idx, f_idx, event_id, value FROM samples QUALIFY row_number() OVER (PARTITION BY t_idx, f_idx ORDER BY ts DESC, event_id DESC) = 1")
def grid_overlap_last_wins(spark, sf_dir):
    return spectra.last_wins(samples(spark, sf_dir), ["t_idx", "f_idx"], ["ts", "event_id"]).select("t_idx", "f_idx", "event_id", "value")


@query("SELECT strftime(min(ts), '%Y%m%d_%H%M%S') AS start, strftime(max(ts), '%Y%m%d_%H%M%S') AS stop FROM events")
def infer_bounds(spark, sf_dir):
    return spectra.bounds(spectra.table(spark, sf_dir, "events"), "ts")


@query(f"WITH {_PRODUCTS} SELECT l_orderkey, l_linenumber, round(pol01_mag, 6) AS mag, round(pol01_phase, 6) + 0.0 AS phase FROM products")
def derive_mag_phase(spark, sf_dir):
    return products(spark, sf_dir).select("l_orderkey", "l_linenumber", r("pol01_mag").alias("mag"), r("pol01_phase").alias("phase"))


@query(f"WITH {_SAMPLES} SELECT t_idx, f_idx, round(power, 4) AS power FROM cells WHERE t_idx >= 100 AND t_idx < 148")
def time_range_read(spark, sf_dir):
    return spectra.time_range(cells(spark, sf_dir), T0 + 100.25 * DT, T0 + 147.5 * DT, T0, DT, NT).withColumn("power", r("power", 4))


@query(f"WITH {_PRODUCTS} SELECT l_orderkey, l_linenumber, round(pol00, 6) AS pol00 FROM products")
def channel_select(spark, sf_dir):
    return selection.select_channels(products(spark, sf_dir), 0, ["l_orderkey", "l_linenumber"]).withColumn("pol00", r("pol00"))


@query(f"WITH {_PRODUCTS} SELECT l_orderkey, l_linenumber, round(pol11, 6) AS first, round(pol00, 6) AS second FROM products")
def channel_stack(spark, sf_dir):
    rows = selection.select_channels(products(spark, sf_dir), [1, 0], ["l_orderkey", "l_linenumber"], stacked="values")
    return rows.select("l_orderkey", "l_linenumber", r(F.col("values")[0]).alias("first"), r(F.col("values")[1]).alias("second"))


@query(f"WITH {_SAMPLES} SELECT t_idx, f_idx, round(f_idx * 125.0 / 2048, 6) AS mhz, round(power, 4) AS power FROM cells WHERE f_idx >= 4 AND f_idx < 9")
def freq_slice(spark, sf_dir):
    return selection.freq_slice(cells(spark, sf_dir), 4, 9, NF).select("t_idx", "f_idx", r(F.col("f_idx") * 125.0 / 2048).alias("mhz"), r("power", 4).alias("power"))


@query("SELECT DISTINCT user_id AS f_idx, round(user_id * 125.0 / 2048, 6) AS mhz FROM events")
def freq_axis(spark, sf_dir):
    """The frequencies of the channels that occur; users stand in for channels."""
    return spectra.table(spark, sf_dir, "events").select(F.col("user_id").alias("f_idx")).distinct().select("f_idx", r(F.col("f_idx") * 125.0 / 2048).alias("mhz"))


@query("SELECT * FROM (SELECT unnest([{'i': 0, 'key': 'station', 'value': min(n_name)}, {'i': 1, 'key': 'nt', 'value': CAST(count(*) AS VARCHAR)}, {'i': 2, 'key': 'created_utc', 'value': '<missing>'}], recursive := true) FROM nation)")
def meta_kv(spark, sf_dir):
    meta = spectra.table(spark, sf_dir, "nation").agg(F.min("n_name").alias("station"), F.count("*").alias("nt"))
    return spectra.meta_rows(meta, ["station", "nt", "created_utc"])


# ---- frames and expressions ---------------------------------------------------------------------------------


@query(f"WITH {_SAMPLES}, n AS (SELECT max(t_idx) + 1 AS nt FROM samples) SELECT k AS frame_idx, 2 * k AS t_start_idx, 2 * k + 6 AS t_end_idx, CAST((1704067200 + 7200 * k) * 1000000 AS BIGINT) AS start_us FROM range(100000) AS x(k), n WHERE 2 * k + 6 <= nt")
def frame_plan(spark, sf_dir):
    """The frames of as many samples as the table has."""
    nt = samples(spark, sf_dir).agg(F.max("t_idx") + 1).first()[0]
    return frames.frames(spark, plan_frames(nt, T0, DT, T0, T0 + nt * DT, WINDOW * DT, STEP * DT))


@query(f"WITH {_FRAMED} SELECT frame_idx, count(*) AS n_cells, min(t_idx) AS first_t, max(t_idx) AS last_t FROM framed GROUP BY frame_idx")
def frame_assign(spark, sf_dir):
    return framed(spark, sf_dir).groupBy("frame_idx").agg(F.count("*").alias("n_cells"), F.min("t_idx").alias("first_t"), F.max("t_idx").alias("last_t"))


@query(f"WITH {_SAMPLES} SELECT f_idx, count(*) AS n FROM cells WHERE NOT (f_idx >= 3 AND f_idx < 6) GROUP BY f_idx")
def rfi_mask(spark, sf_dir):
    return masked(cells(spark, sf_dir)).groupBy("f_idx").agg(F.count("*").alias("n"))


@query(f"WITH {_SAMPLES} SELECT t_idx, f_idx, round(10 * log10(greatest(power, 1e-12)), 6) AS db FROM cells")
def safe_db(spark, sf_dir):
    return Pipeline(("power",)).add(db_step()).apply(cells(spark, sf_dir)).select("t_idx", "f_idx", r("power").alias("db"))


@query(f"WITH {_PRODUCTS} SELECT l_orderkey, l_linenumber, round(0.5 * (pol00 + pol11), 6) AS stokes_i FROM products")
def stokes_i(spark, sf_dir):
    rows = products(spark, sf_dir).select("l_orderkey", "l_linenumber", "pol00", "pol11")
    return Pipeline(("pol00", "pol11")).add(stokes_i_step()).apply(rows).withColumn("stokes_i", r("stokes_i"))


_IQUV = "0.5 * (pol00 + pol11) AS i, 0.5 * (pol00 - pol11) AS q, pol01_mag * cos(pol01_phase) AS u, pol01_mag * sin(pol01_phase) AS v"


def _stokes(spark, sf_dir):
    return stokes_pipeline().apply(products(spark, sf_dir))


@query(f"WITH {_PRODUCTS}, s AS (SELECT l_orderkey, l_linenumber, {_IQUV} FROM products) SELECT l_orderkey, l_linenumber, round(i, 6) + 0.0 AS stokes_i, round(q, 6) + 0.0 AS stokes_q, round(u, 6) + 0.0 AS stokes_u, round(v, 6) + 0.0 AS stokes_v FROM s")
def stokes_iquv(spark, sf_dir):
    return _stokes(spark, sf_dir).select("l_orderkey", "l_linenumber", *[r(f"stokes_{c}").alias(f"stokes_{c}") for c in "iquv"])


@query(f"WITH {_PRODUCTS}, s AS (SELECT l_orderkey, l_linenumber, {_IQUV} FROM products) SELECT l_orderkey, l_linenumber, round(10 * log10(greatest(i, 1e-12)), 6) AS i_db, round(q / i, 5) + 0.0 AS q_i, round(u / i, 5) + 0.0 AS u_i, round(v / i, 5) + 0.0 AS v_i FROM s")
def stokes_fractional(spark, sf_dir):
    found = STOKES_FRACTIONAL.apply(products(spark, sf_dir), ["l_orderkey", "l_linenumber"], stokes_pipeline())
    return found.select("l_orderkey", "l_linenumber", r("stokes_i_db").alias("i_db"), *[r(f"{c}_i", 5).alias(f"{c}_i") for c in "quv"])


@query(f"WITH {_PRODUCTS} SELECT l_orderkey, l_linenumber, round(10 * log10(greatest(pol00, 1e-12)), 6) AS p00_db, round(10 * log10(greatest(pol11, 1e-12)), 6) AS p11_db, round(10 * log10(greatest(CASE WHEN pol01_mag > 1e-9 THEN pol01_mag ELSE 0 END, 1e-12)), 4) AS mag_db, round(CASE WHEN pol01_mag > 1e-9 THEN pol01_phase ELSE 0 END, 6) + 0.0 AS phase FROM products")
def instrumental_quicklook(spark, sf_dir):
    # A magnitude of about 0 is 0, and so is its phase.
    there = F.col("pol01_mag") > 1e-9
    rows = products(spark, sf_dir).withColumn("pol01_phase", F.when(there, F.col("pol01_phase")).otherwise(0.0)).withColumn("pol01_mag", F.when(there, F.col("pol01_mag")).otherwise(0.0))
    found = INSTRUMENTAL.apply(rows, ["l_orderkey", "l_linenumber"])
    return found.select("l_orderkey", "l_linenumber", r("pol00_db").alias("p00_db"), r("pol11_db").alias("p11_db"), r("pol01_mag_db", 4).alias("mag_db"), r("pol01_phase").alias("phase"))


# ---- metrics ------------------------------------------------------------------------------------------------

_TOP = _FRAMED + ", ranked AS (SELECT *, row_number() OVER (PARTITION BY frame_idx ORDER BY db DESC) AS k FROM framed)"


def _metric(name: str, sql: str, method: str, **options) -> None:
    def run(spark, sf_dir):
        return frame_scores(spark, sf_dir, method, **options).withColumn("score", F.round("score", 6))

    run.__name__ = name
    query(sql)(run)


for _name, _q in (("p99", 0.99), ("p995", 0.995), ("p999", 0.999)):
    _metric(f"metric_{_name}", _metric_sql(f"quantile_cont(db, {_q})"), _name)
_metric("metric_percentile", _metric_sql("quantile_cont(db, 0.75)"), "percentile", q=75.0)
_metric("metric_topk_sum", f"WITH {_TOP} SELECT frame_idx, count(db) AS n_finite, round(CASE WHEN count(db) >= 39 AND count(db) >= 8 THEN sum(db) FILTER (k <= 8) END, 6) AS score FROM ranked GROUP BY frame_idx", "topk_sum", topk=8)
_metric("metric_excess_mass", _metric_sql("sum(greatest(db - 20.0, 0))"), "excess_mass", thr=20.0)
_metric("metric_l1", _metric_sql("sum(abs(db))"), "l1")
_metric("metric_l2", _metric_sql("sqrt(sum(db * db))"), "l2")
_metric("metric_lp", _metric_sql("pow(sum(pow(abs(db), 4.0)), 0.25)"), "lp", p=4.0)
_metric("metric_normalized", _metric_sql("sum(abs(db)) * (78.0 / count(db))"), "l1", normalize_missing=True)
_metric("quiet_scores", _metric_sql("quantile_cont(db, 0.99)", 1.0), "p99", min_finite_frac=1.0)


@query("""WITH k AS (SELECT l_returnflag, l_extendedprice AS v, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice DESC) AS k FROM lineitem)
SELECT l_returnflag, count(*) AS n, round(quantile_cont(v, 0.99), 4) AS p99, round(quantile_cont(v, 0.5), 4) AS median, round(sum(v) FILTER (k <= 2048), 2) AS top FROM k GROUP BY l_returnflag""")
def wide_order_statistics(spark, sf_dir):
    """Percentiles and the sum of the 2,048 largest values of three groups that hold the whole table."""
    found = order_stats.order_statistics(spectra.table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice", {"p99": 0.99, "median": 0.5}, {"top": 2048})
    return found.select("l_returnflag", "n", F.round("p99", 4).alias("p99"), F.round("median", 4).alias("median"), F.round("top", 2).alias("top"))


@query(f"WITH {_FRAMED} SELECT frame_idx, round(count(db) / 78.0, 6) AS fraction FROM framed GROUP BY frame_idx")
def finite_fraction(spark, sf_dir):
    return frame_scores(spark, sf_dir).select("frame_idx", F.round(F.col("n_finite") / SIZE, 6).alias("fraction"))


_SFRAMED = f"""{_SAMPLES}, {_STATIONS}, station_framed AS (
  SELECT station, k AS frame_idx, t_idx, f_idx, 10 * log10(greatest(power, 1e-12)) AS db
  FROM range(358) AS x(k) JOIN station_cells ON t_idx >= 2 * k AND t_idx < 2 * k + 6 WHERE NOT (f_idx >= 3 AND f_idx < 6)
), wanted AS (SELECT station, k AS frame_idx FROM (SELECT DISTINCT station FROM station_cells), range(358) AS x(k)
), station_scores AS (
  SELECT station, frame_idx, CAST((1704067200 + 7200 * frame_idx) * 1000000 AS BIGINT) AS time_us, count(db) AS n_finite, CASE WHEN count(db) >= 0.05 * 78 THEN quantile_cont(db, 0.99) END AS score
  FROM wanted LEFT JOIN station_framed USING (station, frame_idx) GROUP BY station, frame_idx
)"""


def station_framed(spark, sf_dir) -> DataFrame:
    return frames.assign(masked(station_cells(spark, sf_dir)).withColumn("db", maths.safe_db(F.col("power"))), plan())


def station_scores(spark, sf_dir) -> DataFrame:
    """All frames of the plan of each station, those without samples included."""
    scored = metrics.score(station_framed(spark, sf_dir), ["station", "frame_idx"], "db", SIZE, "p99", min_finite_frac=0.05)
    scored = written(scored, "frame-scores")  # their stations are told from them, not from the cells again
    return frames.with_plan(scored, plan(), ("n_finite",), scored.select("station").distinct()).withColumn("time_us", start_us(F.col("frame_idx")))


@query(f"WITH {_SFRAMED} SELECT station, frame_idx, n_finite, round(score, 6) AS score FROM station_scores")
def planned_scores(spark, sf_dir):
    return station_scores(spark, sf_dir).select("station", "frame_idx", "n_finite", F.round("score", 6).alias("score"))


_GAP_CELLS = f"{_SAMPLES}, cells2 AS (SELECT t_idx, f_idx, {_GAPPY.format(t='t_idx', f='f_idx', x='power')} AS power FROM cells)"
_GAP_FRAMED = f"""{_GAP_CELLS}, framed AS (
  SELECT k AS frame_idx, CASE WHEN isnan(power) OR power = '-infinity'::DOUBLE THEN NULL WHEN power = 'infinity'::DOUBLE THEN power ELSE 10 * log10(greatest(power, 1e-12)) END AS db
  FROM range(358) AS x(k) JOIN cells2 ON t_idx >= 2 * k AND t_idx < 2 * k + 6 WHERE NOT (f_idx >= 3 AND f_idx < 6)
), finite AS (SELECT frame_idx, CASE WHEN isfinite(db) THEN db END AS db, db AS any_db FROM framed)"""


def _gappy_scores(spark, sf_dir, method: str, **options) -> DataFrame:
    ready = masked(cells(spark, sf_dir).withColumn("power", gappy("power"))).withColumn("db", maths.safe_db(F.col("power")))
    return metrics.score(frames.assign(ready, plan()), ["frame_idx"], "db", SIZE, method, min_finite_frac=0.3, normalize_missing=True, **options).withColumn("score", F.round("score", 6))


@query(f"WITH {_GAP_FRAMED} SELECT frame_idx, count(db) AS n_finite, round(CASE WHEN count(db) >= 0.3 * 78 THEN sqrt(sum(db * db) * 78 / count(db)) END, 6) AS score FROM finite GROUP BY frame_idx")
def metric_gaps_l2(spark, sf_dir):
    return _gappy_scores(spark, sf_dir, "l2")


@query(f"WITH {_GAP_FRAMED}, k AS (SELECT *, row_number() OVER (PARTITION BY frame_idx ORDER BY db DESC NULLS LAST) AS k FROM finite) SELECT frame_idx, count(db) AS n_finite, round(CASE WHEN count(db) >= 0.3 * 78 AND count(db) >= 8 THEN sum(db) FILTER (k <= 8) * 78 / count(db) END, 6) AS score FROM k GROUP BY frame_idx")
def metric_gaps_topk(spark, sf_dir):
    return _gappy_scores(spark, sf_dir, "topk_sum", topk=8)


@query(f"WITH {_GAP_FRAMED} SELECT frame_idx, count(db) AS n_finite, round(CASE WHEN count(db) >= 0.3 * 78 THEN sum(abs(any_db)) * 78 / count(db) END, 6) AS score FROM finite GROUP BY frame_idx")
def metric_gaps_l1(spark, sf_dir):
    return _gappy_scores(spark, sf_dir, "l1")


@query(f"WITH {_SFRAMED}, k AS (SELECT *, row_number() OVER (PARTITION BY station ORDER BY score, frame_idx) AS r, count(*) OVER (PARTITION BY station) AS n FROM station_scores WHERE score IS NOT NULL) SELECT station, frame_idx, round(score, 6) AS score FROM k WHERE r <= greatest(1, floor(n * 0.3))")
def quiet_select(spark, sf_dir):
    return background.select_quiet(station_scores(spark, sf_dir), ["station"], 0.3).select("station", "frame_idx", F.round("score", 6).alias("score"))


@query(f"WITH {_SFRAMED}, k AS (SELECT *, row_number() OVER (PARTITION BY station ORDER BY score, frame_idx) AS r FROM station_scores WHERE score IS NOT NULL) SELECT station, frame_idx, round(score, 6) AS score FROM k WHERE r <= 20")
def quiet_fixed(spark, sf_dir):
    return background.select_quiet(station_scores(spark, sf_dir), ["station"], 0.3, n_quiet=20).select("station", "frame_idx", F.round("score", 6).alias("score"))


@query(f"WITH {_SFRAMED} SELECT station, frame_idx, round(score, 6) AS score, row_number() OVER (PARTITION BY station ORDER BY score DESC NULLS FIRST, frame_idx) AS rank FROM station_scores")
def rank_scores(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("station").orderBy(F.col("score").desc_nulls_first(), "frame_idx")
    return station_scores(spark, sf_dir).withColumn("rank", F.row_number().over(w).cast("long")).select("station", "frame_idx", F.round("score", 6).alias("score"), "rank")


_ONE_FRAME = "SELECT CAST({i} AS BIGINT) AS frame_idx, t_idx, f_idx, round(power, 4) AS power FROM cells WHERE t_idx >= {lo} AND t_idx < {lo} + 6"


def _frame_rows(df: DataFrame) -> DataFrame:
    return df.select("frame_idx", "t_idx", "f_idx", r("power", 4).alias("power"))


@query(f"WITH {_SAMPLES} {_ONE_FRAME.format(i=-1, lo=101)}")
def frame_load(spark, sf_dir):
    return _frame_rows(frames.load_at(cells(spark, sf_dir), plan(), 101, nt=NT))


@query(f"WITH {_SAMPLES} {_ONE_FRAME.format(i=5, lo=10)}")
def frame_at(spark, sf_dir):
    return _frame_rows(frames.frame_at(cells(spark, sf_dir), plan(), 5))


@query(f"WITH {_SAMPLES} {_ONE_FRAME.format(i=random.Random(7).randrange(358), lo=2 * random.Random(7).randrange(358))}")
def frame_random(spark, sf_dir):
    return _frame_rows(frames.random_frame(cells(spark, sf_dir), plan(), 7))


@query(f"WITH {_SAMPLES} SELECT CAST(pos AS BIGINT) AS pos, CAST(i AS BIGINT) AS frame_idx, t_idx, f_idx, round(power, 4) AS power FROM (VALUES (0, 5), (1, 0), (2, 5), (3, 357)) AS b(pos, i) JOIN cells ON t_idx >= 2 * i AND t_idx < 2 * i + 6")
def frame_batch(spark, sf_dir):
    return frames.frame_batch(cells(spark, sf_dir), plan(), [5, 0, 5, 357]).select("pos", "frame_idx", "t_idx", "f_idx", r("power", 4).alias("power"))


# A cube of three stations with gaps: NaN, infinities, absent rows.
_CUBE = f"""{_SAMPLES}, {_STATIONS}, cube AS (SELECT station, t_idx, f_idx, {_GAPPY.format(t='t_idx', f='f_idx', x='power')} AS power FROM station_cells WHERE (t_idx // 20) % 5 <> 2),
place AS (SELECT station, k AS frame_idx, t_idx, (t_idx - 2 * k) * 13 + CASE WHEN f_idx < 3 THEN f_idx ELSE f_idx - 3 END AS place, f_idx, CASE WHEN isnan(power) OR power = '-infinity'::DOUBLE THEN 'nan'::DOUBLE ELSE CAST(10 * log10(greatest(power, 1e-12)) AS FLOAT)::DOUBLE END AS v
  FROM range(358) AS x(k) JOIN cube ON t_idx >= 2 * k AND t_idx < 2 * k + 6)"""


def cube_rows(spark, sf_dir) -> DataFrame:
    present = station_cells(spark, sf_dir).where(F.floor(F.col("t_idx") / 20) % 5 != 2).withColumn("power", gappy("power"))
    return cube.pack(present.withColumn("db", maths.safe_db(F.col("power"))), ["station", "t_idx"], "f_idx", "db", NF)


@query(f"""WITH {_CUBE} SELECT station, frame_idx, CAST((1704067200 + 7200 * frame_idx) * 1000000 AS BIGINT) AS start_us, count(*) FILTER (f_idx NOT IN (3, 4, 5) AND isfinite(v)) AS n_finite,
round(coalesce(sum(v) FILTER (f_idx NOT IN (3, 4, 5) AND isfinite(v)), 0), 3) + 0.0 AS total, round(coalesce(sum(v * (place + 1)) FILTER (f_idx NOT IN (3, 4, 5) AND isfinite(v)), 0), 2) + 0.0 AS placed FROM place GROUP BY station, frame_idx""")
def frame_vectors(spark, sf_dir):
    """One array of 78 values per frame, told by its sum and by the sum of its values times their places."""
    found = cube.frame_vectors(cube_rows(spark, sf_dir), plan(), ["station"], NF, mask=KEPT)
    there = lambda v: F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v.cast("double"))
    of = lambda f: F.aggregate(F.transform("features", f), F.lit(0.0), lambda s, v: s + F.coalesce(v, F.lit(0.0)))
    n = F.size(F.filter("features", lambda v: there(v).isNotNull())).cast("long")
    return found.select("station", "frame_idx", "start_us", n.alias("n_finite"), r(of(there), 3).alias("total"), r(of(lambda v, i: there(v) * (i + 1)), 2).alias("placed"))


@query(f"""WITH {_CUBE}, fin AS (SELECT station, frame_idx, CASE WHEN f_idx NOT IN (3, 4, 5) AND isfinite(v) THEN v END AS v FROM place), ranked AS (SELECT *, row_number() OVER (PARTITION BY station, frame_idx ORDER BY v DESC NULLS LAST) AS k FROM fin)
SELECT station, frame_idx, count(v) AS n_finite, round(CASE WHEN count(v) >= 0.3 * 78 AND count(v) >= 8 THEN sum(v) FILTER (k <= 8) * 78 / count(v) END, 4) AS score FROM ranked GROUP BY station, frame_idx""")
def cube_scores(spark, sf_dir):
    """Scores of the same frames; their vectors stay in the task that makes them."""
    found = cube.frame_scores(cube_rows(spark, sf_dir), plan(), ["station"], NF, "topk_sum", mask=KEPT, topk=8, min_finite_frac=0.3, normalize_missing=True)
    return found.withColumn("score", F.round("score", 4))


# ---- windows and backgrounds --------------------------------------------------------------------------------

_H = 3_600_000_000
FIRST, LAST = int(T0) * 1_000_000, int(T0 + NT * DT) * 1_000_000


@query("WITH b AS (SELECT CAST(ceil(min(epoch_us(ts)) / 3600e6) AS BIGINT) AS lo, max(epoch_us(ts)) AS hi FROM events) SELECT (lo + k) * 3600000000 AS window_us FROM b, range(100000) AS x(k) WHERE (lo + k) * 3600000000 < hi")
def score_windows(spark, sf_dir):
    times = spectra.table(spark, sf_dir, "events").select(F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    return rolling.starts(times, [], "t").select("window_us")


def _windowed(spark, sf_dir, gap: int) -> DataFrame:
    """Windows over the frames of each station that have samples: all windows of the grid whose context is whole."""
    have = station_framed(spark, sf_dir).select("station", "frame_idx").distinct().withColumn("start_us", start_us(F.col("frame_idx")))
    return rolling.windows(have, FIRST + 12 * _H, LAST, 24 * _H, stride_us=4 * _H, score_us=4 * _H, gap_us=gap, by=["station"])


_WINDOWS = _SFRAMED + """, f AS (SELECT DISTINCT station, frame_idx, CAST((1704067200 + 7200 * frame_idx) * 1000000 AS BIGINT) AS t FROM station_framed), l AS (SELECT station, max(t) AS last FROM f GROUP BY station),
w AS (SELECT CAST((1704067200 + 43200 + 14400 * k) * 1000000 AS BIGINT) AS h FROM range(177) AS x(k)), H AS (SELECT 3600000000 AS hour),
g AS (SELECT station, h AS window_us, frame_idx, (t >= h - 12 * hour AND t < h + 12 * hour{gap}) AS in_fit, (t >= h AND t < h + 4 * hour) AS in_score FROM f JOIN l USING (station), w, H WHERE last >= h + 12 * hour)
SELECT station, window_us, count(*) FILTER (in_fit) AS n_context, count(*) FILTER (in_score) AS n_scored FROM g WHERE in_fit OR in_score GROUP BY station, window_us"""


def _window_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("station", "window_us").agg(F.count(F.when(F.col("in_fit"), 1)).alias("n_context"), F.count(F.when(F.col("in_score"), 1)).alias("n_scored"))


@query("WITH " + _WINDOWS.replace("{gap}", ""))
def centered_context(spark, sf_dir):
    return _window_counts(_windowed(spark, sf_dir, 0))


@query("WITH " + _WINDOWS.replace("{gap}", " AND NOT (t >= h - hour AND t < h + 5 * hour)"))
def donut_context(spark, sf_dir):
    return _window_counts(_windowed(spark, sf_dir, 2 * _H))


def _vectors(spark, sf_dir) -> DataFrame:
    return spectra.table(spark, sf_dir, "embeddings").select("label", F.col("vec_id").alias("frame_idx"), F.col("embedding").cast("array<double>").alias("features"), (F.col("vec_id") % 3 < 2).alias("quiet"))


@query("WITH x AS (SELECT label, vec_id AS frame_idx, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS pix FROM embeddings), m AS (SELECT label, pix, avg(v) AS mu FROM x WHERE frame_idx % 3 < 2 GROUP BY ALL) SELECT label, frame_idx, round(max(greatest(v - mu, 0)), 5) AS peak, round(sum(abs(v - mu)), 4) AS l1 FROM x JOIN m USING (label, pix) GROUP BY label, frame_idx")
def pca_mean_residual(spark, sf_dir):
    res = background.pca_residuals(_vectors(spark, sf_dir), ["label"], 0)
    return res.groupBy("label", "frame_idx").agg(F.round(F.max(background.positive("residual")), 5).alias("peak"), F.round(F.sum(F.abs("residual")), 4).alias("l1"))


def _broken_vectors(spark, sf_dir) -> DataFrame:
    """Vectors with missing entries; a fifth of them has one or more."""
    gone = lambda v, i: F.when((F.col("frame_idx") * 64 + i) % 311 == 3, float("nan")).otherwise(v)
    return _vectors(spark, sf_dir).withColumn("features", F.transform("features", gone))


def _residual_arrays(spark, sf_dir, k: int) -> DataFrame:
    rows = _broken_vectors(spark, sf_dir)
    return background.residual_arrays(rows.select("label", "frame_idx", "features"), background.fit_groups(rows, ["label"], k), ["label"])


@query("""WITH x AS (SELECT label, vec_id AS frame_idx, unnest(embedding)::DOUBLE AS v0, generate_subscripts(embedding, 1) - 1 AS pix FROM embeddings), x2 AS (SELECT *, CASE WHEN (frame_idx * 64 + pix) % 311 = 3 THEN NULL ELSE v0 END AS v FROM x),
whole AS (SELECT label, frame_idx FROM x2 GROUP BY ALL HAVING count(v) = 64), m AS (SELECT label, pix, avg(v) AS mu FROM x2 JOIN whole USING (label, frame_idx) WHERE frame_idx % 3 < 2 GROUP BY label, pix),
res AS (SELECT label, frame_idx, greatest(v - mu, 0) + CASE WHEN v IS NULL THEN NULL ELSE 0 END AS x FROM x2 JOIN m USING (label, pix)), k AS (SELECT *, row_number() OVER (PARTITION BY label, frame_idx ORDER BY x DESC NULLS LAST) AS k FROM res)
SELECT label, frame_idx, count(x) AS n_finite, round(CASE WHEN count(x) >= 0.7 * 64 THEN sum(x) FILTER (k <= 8) * 64 / count(x) END, 5) AS score FROM k GROUP BY label, frame_idx""")
def outlier_scores(spark, sf_dir):
    return background.array_outlier_scores(_residual_arrays(spark, sf_dir, 0), ["label", "frame_idx"], topk=8).withColumn("score", F.round("score", 5))


@query()
def pca_residual_score(spark, sf_dir):
    return background.array_outlier_scores(_residual_arrays(spark, sf_dir, 8), ["label", "frame_idx"], method="p99").withColumn("score", F.round("score", 6))


@query()
def pca_singular_values(spark, sf_dir):
    return background.singular_values(_vectors(spark, sf_dir), ["label"], 8).withColumn("value", F.round("value", 6))


# Frames of 4 hours by 4 channels; an absent channel is missing. Contexts of 96 hours, a window every 12 hours.
_ROLL = f"""{_SAMPLES}, coarse AS (SELECT 'S' || (event_id % 3) AS station, t_idx // 4 AS frame_idx, f_idx % 4 AS f, sum(value) AS power FROM samples GROUP BY ALL),
vals AS (SELECT station, frame_idx, f, CAST(10 * log10(greatest(power, 1e-12)) AS FLOAT)::DOUBLE AS v FROM coarse),
fr AS (SELECT station, frame_idx, CAST((1704067200 + 14400 * frame_idx) * 1000000 AS BIGINT) AS t, CASE WHEN count(*) = 4 THEN quantile_cont(v, 0.99) END AS q FROM vals GROUP BY station, frame_idx),
w AS (SELECT CAST((1704067200 + 172800 + 43200 * k) * 1000000 AS BIGINT) AS h FROM range(56) AS x(k)), l AS (SELECT station, max(t) AS last FROM fr GROUP BY station),
ctx AS (SELECT fr.*, h FROM fr JOIN w ON t >= h - 172800000000 AND t < h + 172800000000 JOIN l USING (station) WHERE last >= h + 172800000000),
rk AS (SELECT *, row_number() OVER (PARTITION BY station, h ORDER BY q, frame_idx) AS r, count(*) OVER (PARTITION BY station, h) AS nq FROM ctx WHERE q IS NOT NULL),
quiet AS (SELECT station, h, frame_idx FROM rk WHERE r <= greatest(1, floor(nq * 0.3))),
mu AS (SELECT station, h, f, avg(v) AS mu FROM quiet JOIN vals USING (station, frame_idx) GROUP BY station, h, f),
rolled AS (SELECT ctx.station AS station, ctx.h AS h, ctx.frame_idx AS frame_idx, ctx.t AS time_us, CASE WHEN count(*) >= 2 THEN sqrt(sum(greatest(v - mu, 0) ** 2) * 4 / count(*)) END AS score
  FROM ctx JOIN vals ON vals.station = ctx.station AND vals.frame_idx = ctx.frame_idx JOIN mu ON mu.station = ctx.station AND mu.h = ctx.h AND mu.f = vals.f WHERE t >= ctx.h AND t < ctx.h + 43200000000 GROUP BY ALL)"""


def coarse_rows(spark, sf_dir) -> DataFrame:
    """The rows of a cube of 4 hours by 4 channels, in decibels."""
    rows = samples(spark, sf_dir).withColumn("station", F.concat(F.lit("S"), F.col("event_id") % 3))
    coarse = rows.groupBy("station", F.floor(F.col("t_idx") / 4).alias("t_idx"), (F.col("f_idx") % 4).alias("f")).agg(F.sum("value").alias("power"))
    return cube.pack(coarse.withColumn("db", maths.safe_db(F.col("power"))), ["station", "t_idx"], "f", "db", 4)


def _rolled(spark, sf_dir, k: int, window: int = 1, **more) -> search.Search:
    """From samples to regions; frames of ``window`` samples of 4 hours, one after each sample."""
    config = rolling.RollingConfig(context_us=96 * _H, stride_us=12 * _H, score_us=12 * _H, k=k, method="l2", score_options={"min_finite_frac": 0.5, "normalize_missing": True}, **more)
    grid = FramePlan(0, NT // 4, window, 1, 4 * DT, T0)
    return search.search_cube(coarse_rows(spark, sf_dir), grid, 4, FIRST + 48 * _H, LAST, config, ["station"], nsig=1.0, pad_us=_H, merge_gap_us=4 * _H)


_STATUS = f"""{_ROLL}, n AS (SELECT station, h, count(*) AS n_context, count(*) FILTER (t >= h AND t < h + 43200000000) AS n_scored FROM ctx GROUP BY ALL), whole AS (SELECT station, h, count(*) AS n_quiet FROM quiet GROUP BY ALL),
st AS (SELECT l.station AS station, w.h AS window_us, coalesce(n_context, 0) AS n_context, coalesce(n_quiet, 0) AS n_quiet,
  CASE WHEN last < w.h + 172800000000 THEN 'not_fired' WHEN n_context IS NULL THEN 'empty_context' WHEN n_quiet IS NULL THEN 'no_quiet' WHEN n_scored = 0 THEN 'nothing_to_score' ELSE 'scored' END AS status
  FROM l CROSS JOIN w LEFT JOIN n ON n.station = l.station AND n.h = w.h LEFT JOIN whole ON whole.station = l.station AND whole.h = w.h)"""


@query(f"WITH {_STATUS} SELECT station, window_us, status, n_context, n_quiet FROM st")
def rolling_windows(spark, sf_dir):
    return _rolled(spark, sf_dir, 0).windows.select("station", "window_us", "status", "n_context", "n_quiet")


@query(f"WITH {_STATUS} SELECT station, status, count(*) AS n FROM st GROUP BY ALL")
def rolling_status(spark, sf_dir):
    return rolling.status_counts(_rolled(spark, sf_dir, 0).windows, ["station"])


@query(f"WITH {_ROLL} SELECT station, time_us, frame_idx, round(score, 4) AS score FROM rolled")
def rolling_mean_scores(spark, sf_dir):
    return _rolled(spark, sf_dir, 0).scores.withColumn("score", F.round("score", 4))


@query()
def rolling_scores(spark, sf_dir):
    """As rolling_mean_scores, against two components of each window's quiet frames."""
    return _rolled(spark, sf_dir, 2).scores.withColumn("score", F.round("score", 6))


_ROLL3 = _ROLL.replace("), l AS (SELECT", "), l AS (SELECT").replace("vals AS (SELECT station, frame_idx, f, CAST", "one AS (SELECT station, frame_idx, f, CAST").replace(
    "fr AS (SELECT", "vals AS (SELECT station, frame_idx - j AS frame_idx, f + 4 * j AS f, v FROM one, range(3) AS x(j) WHERE frame_idx - j BETWEEN 0 AND 177),\nfr AS (SELECT"
).replace("count(*) = 4 THEN", "count(*) = 12 THEN").replace("count(*) >= 2 THEN sqrt(sum(greatest(v - mu, 0) ** 2) * 4 / count(*))", "count(*) >= 6 THEN sqrt(sum(greatest(v - mu, 0) ** 2) * 12 / count(*))")


@query(f"WITH {_ROLL3} SELECT station, time_us, frame_idx, round(score, 4) AS score FROM rolled")
def pixel_mean_scores(spark, sf_dir):
    """The mean of each window's quiet frames taken off, by blocks of 5 pixels (frames of 12 values)."""
    return _by_pixels(spark, sf_dir, 0).withColumn("score", F.round("score", 4))


@query()
def pixel_scores(spark, sf_dir):
    """The same against two components."""
    return _by_pixels(spark, sf_dir, 2).withColumn("score", F.round("score", 6))


def _by_pixels(spark, sf_dir, k: int) -> DataFrame:
    config = rolling.RollingConfig(context_us=96 * _H, stride_us=12 * _H, score_us=12 * _H, k=k, method="l2", score_options={"min_finite_frac": 0.5, "normalize_missing": True})
    grid = FramePlan(0, NT // 4, 3, 1, 4 * DT, T0)
    vectors = cube.frame_vectors(coarse_rows(spark, sf_dir), grid, ["station"], 4)
    found = rolling.frame_scores(pixel_pca.run(written(vectors, "vectors"), FIRST + 48 * _H, LAST, config, ["station"], pixels=5), ["station"])
    return found.select("station", cube.start_us(grid, F.col("frame_idx")).alias("time_us"), "frame_idx", "score")


@query()
def pca_range_finder(spark, sf_dir):
    """The largest singular values by random directions, rounded to what they are sure to."""
    found = range_finder.fit_groups(_vectors(spark, sf_dir), ["label"], 4, n_iter=8, oversample=16)
    return found.select("label", F.posexplode("singular").alias("i", "value")).withColumn("i", F.col("i").cast("long")).withColumn("value", F.round("value", 3))


# ---- regions of interest ------------------------------------------------------------------------------------


def _limit_sql(s: str, nsig: int) -> str:
    return f"""m AS (SELECT station, median(score) AS med, quantile_cont(score, 0.999) AS high FROM {s} GROUP BY station), d0 AS (SELECT station, 1.4826 * median(abs(score - med)) AS sigma FROM {s} JOIN m USING (station) GROUP BY station),
t AS (SELECT station, med AS median, sigma, CASE WHEN sigma > 0 THEN med + {nsig} * sigma ELSE high END AS threshold FROM m JOIN d0 USING (station))"""


def _roi_sql(s: str) -> str:
    return f"""{_limit_sql(s, 1)}, a AS (SELECT s.*, coalesce(score > threshold, false) AS act FROM {s} AS s JOIN t USING (station)),
b AS (SELECT *, sum((NOT act)::INT) OVER (PARTITION BY station ORDER BY time_us) AS run FROM a),
c AS (SELECT station, min(time_us) - 3600000000 AS a0, max(time_us) + 3600000000 AS a1, max(score) AS peak, sum(score) AS total, count(*) AS n FROM b WHERE act GROUP BY station, run),
d AS (SELECT *, CASE WHEN a0 - max(a1) OVER (PARTITION BY station ORDER BY a0 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= 14400000000 THEN 0 ELSE 1 END AS new FROM c),
e AS (SELECT *, sum(new) OVER (PARTITION BY station ORDER BY a0) AS roi FROM d)
SELECT station, min(a0) AS start_us, max(a1) AS stop_us, round(max(peak), 4) AS peak_score, round(sum(total), 4) AS sum_score, CAST(sum(n) AS BIGINT) AS n_frames FROM e GROUP BY station, roi"""


def _regions(df: DataFrame) -> DataFrame:
    return df.select("station", "start_us", "stop_us", F.round("peak_score", 4).alias("peak_score"), F.round("sum_score", 4).alias("sum_score"), "n_frames")


@query(f"WITH {_SFRAMED}, {_limit_sql('station_scores', 3)} SELECT station, round(median, 6) AS median, round(sigma, 6) AS sigma, round(threshold, 6) AS threshold FROM t")
def robust_threshold(spark, sf_dir):
    return metrics.robust_threshold(station_scores(spark, sf_dir), 3.0, ["station"]).select("station", *[F.round(c, 6).alias(c) for c in ("median", "sigma", "threshold")])


@query(f"WITH {_SFRAMED}, {_roi_sql('station_scores')}")
def roi_search(spark, sf_dir):
    """Events to cells, frames, decibels, p99 per frame, threshold, runs, padding and merging."""
    return _regions(rois.find_rois(station_scores(spark, sf_dir), ["station"], nsig=1.0, pad_us=_H, merge_gap_us=4 * _H))


@query(f"WITH {_ROLL}, {_roi_sql('rolled')}")
def rolling_roi(spark, sf_dir):
    """The whole search: frames against their rolling quiet background, then regions of interest."""
    return _regions(_rolled(spark, sf_dir, 0).regions)


@query(f"WITH {_ROLL3}, {_roi_sql('rolled')}")
def cube_roi(spark, sf_dir):
    """The whole search from samples, with frames that overlap: 12 hours every 4 hours, 12 values each."""
    return _regions(_rolled(spark, sf_dir, 0, 3).regions)


EVENTS = [("20240103_010000", "20240103_090000"), ("20240103_080000", "20240104_000000"), ("20240115_120000", "20240120_000000")]


@query("SELECT CAST(row_number() OVER () - 1 AS BIGINT) AS event, CAST(i AS BIGINT) AS roi_index, epoch_us(strptime(a, '%Y%m%d_%H%M%S')) AS start_us, epoch_us(strptime(b, '%Y%m%d_%H%M%S')) AS stop_us FROM (VALUES " + ", ".join(f"({i}, '{a}', '{b}')" for i, (a, b) in zip(rois.CURATED_INDICES, rois.CURATED, strict=True)) + ") AS v(i, a, b)")
def curated_events(spark, sf_dir):
    return rois.curated(spark)


@query(f"WITH {_SFRAMED}, ev AS (SELECT CAST(e AS BIGINT) AS event, epoch_us(strptime(a, '%Y%m%d_%H%M%S')) AS lo, epoch_us(strptime(b, '%Y%m%d_%H%M%S')) AS hi FROM (VALUES " + ", ".join(f"({k}, '{a}', '{b}')" for k, (a, b) in enumerate(EVENTS)) + ") AS v(e, a, b)) SELECT event, station, frame_idx, time_us, round(score, 6) AS score FROM station_scores JOIN ev ON time_us BETWEEN lo AND hi")
def event_scores(spark, sf_dir):
    """Scores within hand-picked events, both ends included."""
    found = rois.within(station_scores(spark, sf_dir), rois.curated(spark, EVENTS), ["event"])
    return found.select("event", "station", "frame_idx", "time_us", F.round("score", 6).alias("score"))


# ---- series -------------------------------------------------------------------------------------------------

_NAN = "CASE WHEN (t_idx * 7 + {f}) % 29 IN (3, 11, 20) THEN NULL ELSE {x} END"


def some_nan(x: str, f: Column) -> Column:
    return F.when(((F.col("t_idx") * 7 + f) % 29).isin(3, 11, 20), float("nan")).otherwise(F.col(x))


for _how, _sql in (("mean", "avg(p)"), ("median", "median(p)"), ("sum", "coalesce(sum(p), 0)")):

    def _curve(spark, sf_dir, how=_how):
        rows = cells(spark, sf_dir).withColumn("power", some_nan("power", F.col("f_idx")))
        return series.light_curve(rows, ["t_idx"], "power", how).withColumn("flux", F.round("flux", 6))

    _curve.__name__ = f"lightcurve_{_how}"
    query(f"WITH {_SAMPLES}, g AS (SELECT t_idx, {_NAN.format(f='f_idx', x='power')} AS p FROM cells) SELECT t_idx, round({_sql}, 6) AS flux FROM g GROUP BY t_idx")(_curve)

_TWO = f"{_SAMPLES}, c AS (SELECT event_type AS series, t_idx, sum(value) AS flux FROM samples GROUP BY ALL)"


def curves(spark, sf_dir) -> DataFrame:
    return samples(spark, sf_dir).groupBy(F.col("event_type").alias("series"), "t_idx").agg(F.sum("value").alias("flux"))


@query(f"WITH {_TWO}, g AS (SELECT series, t_idx, {_NAN.format(f=0, x='flux')} AS flux FROM c) SELECT series, t_idx, round((flux - min(flux) OVER w) / (max(flux) OVER w - min(flux) OVER w), 6) AS scaled FROM g WINDOW w AS (PARTITION BY series)")
def minmax_normalize(spark, sf_dir):
    rows = curves(spark, sf_dir).withColumn("flux", some_nan("flux", F.lit(0)))
    return series.minmax(rows, "flux", ["series"], "scaled").select("series", "t_idx", F.round("scaled", 6).alias("scaled"))


_STATION_CURVES = f"{_SAMPLES}, {_STATIONS}, curve AS (SELECT station, t_idx, avg(power) AS flux FROM station_cells GROUP BY ALL)"


@query(f"WITH {_STATION_CURVES} SELECT station, t_idx, round((flux - min(flux) OVER w) / (max(flux) OVER w - min(flux) OVER w), 6) AS scaled FROM curve WINDOW w AS (PARTITION BY station)")
def station_curves(spark, sf_dir):
    curve = series.light_curve(station_cells(spark, sf_dir), ["station", "t_idx"], "power")
    return series.minmax(curve, "flux", ["station"], "scaled", guard=False).select("station", "t_idx", F.round("scaled", 6).alias("scaled"))


_FLUX = "SELECT epoch_us(ts) AS time_us, event_id, round(value * 1e-8, 12) AS xrsa_flux, round(value * 1e-7, 12) AS xrsb_flux FROM events"


@query("""WITH f AS (SELECT DISTINCT '/flux/' || strftime(ts, '%Y') || '/xrs_d' || strftime(ts, '%Y%m%d') || '_v' || (event_id % 3) || '.nc' AS path, strftime(ts, '%Y%m%d') AS day FROM events)
SELECT path FROM f WHERE day BETWEEN '20240103' AND '20240109'""")
def flux_files(spark, sf_dir):
    """Daily files, named after the days of events, in up to three versions: those of a range that ends within a day."""
    ts = F.col("ts").cast("timestamp")
    path = F.concat(F.lit("/flux/"), F.date_format(ts, "yyyy"), F.lit("/xrs_d"), F.date_format(ts, "yyyyMMdd"), F.lit("_v"), (F.col("event_id") % 3).cast("string"), F.lit(".nc"))
    files = spectra.table(spark, sf_dir, "events").select(path.alias("path")).distinct()
    return series.daily_files(files, datetime(2024, 1, 3, 6), datetime(2024, 1, 9, 18))


@query(f"WITH x AS ({_FLUX}) SELECT * FROM x WHERE time_us >= 1704240000000000 AND time_us < 1704672000000000")
def flux_load(spark, sf_dir):
    """Two tables of fluxes (users with even and odd ids) as one series of 2024-01-03 to 2024-01-07."""
    rows = spectra.table(spark, sf_dir, "events").select(F.unix_micros(F.col("ts").cast("timestamp")).alias("time_us"), "event_id", "user_id", F.round(F.col("value") * 1e-8, 12).alias("xrsa_flux"), F.round(F.col("value") * 1e-7, 12).alias("xrsb_flux"))
    parts = [rows.where(F.col("user_id") % 2 == k) for k in (0, 1)]
    return series.load_series(parts, F.lit(1_704_240_000_000_000), F.lit(1_704_672_000_000_000), ("time_us", "event_id", "xrsa_flux", "xrsb_flux"))


@query(f"WITH x AS ({_FLUX}), o AS (SELECT min(time_us) AS lo, max(time_us) AS hi FROM x WHERE event_id % 97 = 5) SELECT time_us, event_id, xrsb_flux FROM x, o WHERE time_us BETWEEN lo AND hi")
def flux_clip(spark, sf_dir):
    rows = spectra.table(spark, sf_dir, "events").select(F.unix_micros(F.col("ts").cast("timestamp")).alias("time_us"), "event_id", F.round(F.col("value") * 1e-7, 12).alias("xrsb_flux"))
    return series.clip_to(rows, rows.where(F.col("event_id") % 97 == 5), "time_us")


@query("WITH x AS (SELECT o_orderkey, o_orderkey * 50000.0 AS s FROM orders), n AS (SELECT o_orderkey, CAST(946728000000000 + round(s * 1e6) AS BIGINT) AS us FROM x) SELECT o_orderkey, us + 1000000 * (SELECT count(*) FROM (VALUES ('2006-01-01'), ('2009-01-01'), ('2012-07-01'), ('2015-07-01'), ('2017-01-01')) AS d(l) WHERE us >= epoch_us(CAST(l AS TIMESTAMP))) AS us FROM n")
def leap_second_decode(spark, sf_dir):
    return spectra.table(spark, sf_dir, "orders").select("o_orderkey", maths.decode_leap_seconds(F.col("o_orderkey") * 50000.0).cast("long").alias("us"))


@query(f"""WITH {_TWO}, k AS (SELECT series, t_idx * 1.0 AS x, flux AS y FROM c WHERE t_idx % 3 = 0), p AS (SELECT DISTINCT series, t_idx * 1.0 AS x FROM c WHERE t_idx % 3 <> 0),
a AS (SELECT p.series, p.x, k.x AS xa, k.y AS ya FROM p ASOF LEFT JOIN k ON p.series = k.series AND p.x >= k.x), b AS (SELECT a.*, k.x AS xb, k.y AS yb FROM a ASOF LEFT JOIN k ON a.series = k.series AND a.x <= k.x)
SELECT series, x, round(CASE WHEN xa IS NULL THEN yb WHEN xb IS NULL OR xa = x THEN ya ELSE ya + (yb - ya) * (x - xa) / (xb - xa) END, 4) AS y FROM b""")
def interp_linear(spark, sf_dir):
    c = curves(spark, sf_dir).select("series", F.col("t_idx").cast("double").alias("x"), F.col("flux").alias("y"), "t_idx")
    found = series.interpolate(c.where("t_idx % 3 = 0").drop("t_idx"), c.where("t_idx % 3 <> 0").select("series", "x"), ["series"])
    return found.select("series", "x", F.round("y", 4).alias("y"))


@query(f"""WITH {_SAMPLES}, c AS (SELECT 'S' || (event_id % 3) AS station, event_type AS series, t_idx, sum(value) AS flux FROM samples GROUP BY ALL),
p AS (SELECT station, t_idx, max(flux) FILTER (series = 'purchase') AS a, {_NAN.format(f=0, x="max(flux) FILTER (series = 'view')")} AS b FROM c GROUP BY station, t_idx),
q AS (SELECT station, row_number() OVER (PARTITION BY station ORDER BY t_idx) - 1 AS i, (a - avg(a) OVER w) / stddev_pop(a) OVER w AS a, (b - avg(b) OVER w) / stddev_pop(b) OVER w AS b, count(*) OVER w AS n FROM p WHERE a IS NOT NULL AND b IS NOT NULL WINDOW w AS (PARTITION BY station))
SELECT x.station AS station, x.i - y.i AS lag, round(sum(x.a * y.b) / any_value(x.n), 6) + 0.0 AS corr FROM q x JOIN q y ON x.station = y.station AND abs(x.i - y.i) <= 12 WHERE x.n >= 3 GROUP BY x.station, lag""")
def xcorr_lag(spark, sf_dir):
    c = samples(spark, sf_dir).groupBy(F.concat(F.lit("S"), F.col("event_id") % 3).alias("station"), F.col("event_type").alias("series"), "t_idx").agg(F.sum("value").alias("flux"))
    of = lambda name: F.max(F.when(F.col("series") == name, F.col("flux")))
    pairs = c.groupBy("station", "t_idx").agg(of("purchase").alias("a"), of("view").alias("b")).withColumn("b", some_nan("b", F.lit(0)))
    return series.cross_correlation(pairs, ["station"], "t_idx", "a", "b", 12).select("station", F.col("lag").cast("long").alias("lag"), r("corr").alias("corr"))


@query(f"WITH {_GAP_CELLS}, q AS (SELECT quantile_cont(power, 0.01) AS lo, quantile_cont(power, 0.99) AS hi FROM cells2 WHERE isfinite(power)) SELECT round(CASE WHEN lo < hi THEN lo ELSE 0 END, 4) AS lo, round(CASE WHEN lo < hi THEN hi ELSE 1 END, 4) AS hi, round(CASE WHEN greatest(abs(lo), abs(hi)) > 0 THEN greatest(abs(lo), abs(hi)) ELSE 1 END, 4) AS symmetric FROM q")
def color_limits(spark, sf_dir):
    found = series.color_limits(cells(spark, sf_dir).withColumn("power", gappy("power")), "power")
    return found.select(*[F.round(c, 4).alias(c) for c in ("lo", "hi", "symmetric")])


_STEPS = f"{_SAMPLES}, {_STATIONS}, d AS (SELECT DISTINCT station, t_idx FROM station_cells), s AS (SELECT station, t_idx, lag(t_idx) OVER w AS p, lead(t_idx) OVER w AS n FROM d WINDOW w AS (PARTITION BY station ORDER BY t_idx)), m AS (SELECT station, median(t_idx - p) AS step FROM s GROUP BY station)"


@query(f"WITH {_STEPS} SELECT station, round(step, 6) AS cadence FROM m")
def median_cadence(spark, sf_dir):
    return series.median_cadence(station_cells(spark, sf_dir), ["station"], "t_idx").withColumn("cadence", F.round("cadence", 6))


@query(f"WITH {_STEPS} SELECT station, t_idx, round(coalesce((t_idx + p) / 2.0, t_idx - step / 2), 6) AS lo, round(coalesce((t_idx + n) / 2.0, t_idx + step / 2), 6) AS hi FROM s JOIN m USING (station)")
def cell_edges(spark, sf_dir):
    return series.cell_edges(station_cells(spark, sf_dir), ["station"], "t_idx").select("station", "t_idx", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"))


@query(f"WITH {_SAMPLES} SELECT t_idx // 24 AS day, round(min(power), 4) AS lo, round(max(power), 4) AS hi, CASE WHEN min(power) > 10 THEN 'day' WHEN max(power) < 10 THEN 'night' ELSE 'twilight' END AS kind FROM cells GROUP BY day")
def daily_envelope(spark, sf_dir):
    lo, hi = F.min("power"), F.max("power")
    return cells(spark, sf_dir).groupBy(F.floor(F.col("t_idx") / 24).alias("day")).agg(F.round(lo, 4).alias("lo"), F.round(hi, 4).alias("hi"), F.when(lo > 10, "day").when(hi < 10, "night").otherwise("twilight").alias("kind"))


# ---- terrain ------------------------------------------------------------------------------------------------

# The elevation grid: part k lies in row k // 40 and column k % 40, as high as its size; suppliers are the points.
_DEM = "dem AS (SELECT p_partkey // 40 AS row, p_partkey % 40 AS col, p_size * 1.0 AS z FROM part), pts AS (SELECT s_suppkey AS point, s_suppkey % 5 AS row0, (s_suppkey * 7) % 40 AS col0 FROM supplier)"
_HORIZON = f"""{_DEM}, ray AS (SELECT point, a * 45.0 AS azimuth, k * 1.0 AS d, dem.z AS z0, round(row0 - sin(radians(a * 45.0)) * k, 9) AS y, round(col0 + cos(radians(a * 45.0)) * k, 9) AS x FROM pts JOIN dem ON row = row0 AND col = col0, range(8) AS u(a), range(1, 7) AS v(k)),
corner AS (SELECT point, azimuth, d, z0, floor(y) + i AS row, floor(x) + j AS col, (CASE WHEN i = 1 THEN y - floor(y) ELSE 1 - (y - floor(y)) END) * (CASE WHEN j = 1 THEN x - floor(x) ELSE 1 - (x - floor(x)) END) AS w FROM ray, range(2) AS p(i), range(2) AS q(j)),
smp AS (SELECT point, azimuth, d, z0, CASE WHEN count(*) = count(z) THEN sum(w * z) END AS z FROM corner LEFT JOIN dem ON dem.row = corner.row AND dem.col = corner.col WHERE w > 0 GROUP BY point, azimuth, d, z0),
hz AS (SELECT point, azimuth, max(degrees(atan2(z - z0, d))) AS horizon FROM smp GROUP BY point, azimuth)"""


def _horizon(spark, sf_dir, compass: bool = False) -> DataFrame:
    k = F.col("p_partkey")
    dem = spectra.table(spark, sf_dir, "part").select(F.floor(k / 40).alias("row"), (k % 40).alias("col"), F.col("p_size").cast("double").alias("elevation"))
    s = F.col("s_suppkey")
    points = spectra.table(spark, sf_dir, "supplier").select(s.alias("point"), (s % 5).alias("row0"), ((s * 7) % 40).alias("col0"))
    return terrain.horizon_profile(points, dem, ["point"], n_directions=8, max_distance=6.0, step=1.0, compass=compass, tile=16)


@query(f"WITH {_HORIZON} SELECT point, azimuth, round(horizon, 6) + 0.0 AS horizon FROM hz")
def horizon_profile(spark, sf_dir):
    return _horizon(spark, sf_dir).withColumn("horizon", r("horizon"))


@query("WITH " + _HORIZON.replace("row0 - sin(", "row0 - cos(").replace("col0 + cos(", "col0 + sin(") + " SELECT point, azimuth, round(horizon, 6) + 0.0 AS horizon FROM hz")
def horizon_compass(spark, sf_dir):
    """Azimuths clockwise from North."""
    return _horizon(spark, sf_dir, True).withColumn("horizon", r("horizon"))


@query(f"WITH {_HORIZON}, o AS (SELECT o_custkey % 10 AS point, o_orderkey // 8 AS day, o_orderkey % 8 AS k, o_totalprice / 10000 AS alt FROM orders) SELECT o.point, day, round(count(*) FILTER (alt >= horizon) / 8.0, 6) AS fraction FROM o LEFT JOIN hz ON hz.point = o.point AND azimuth = k * 45.0 GROUP BY o.point, day")
def illuminated_fraction(spark, sf_dir):
    """Orders stand in for a sky path: eight samples a day, of which sample k meets horizon k."""
    k = F.col("o_orderkey")
    path = spectra.table(spark, sf_dir, "orders").select((F.col("o_custkey") % 10).alias("point"), F.floor(k / 8).alias("day"), (k % 8).alias("k"), (F.col("o_totalprice") / 10000).alias("altitude"))
    profile = _horizon(spark, sf_dir).select("point", F.round(F.col("azimuth") / 45).cast("long").alias("k"), "horizon")
    return terrain.illuminated_fraction(path, profile, ["point"], "day", "k", "altitude", 8).withColumn("fraction", F.round("fraction", 6))


# ---- raw files ----------------------------------------------------------------------------------------------

# Paths made from events: every seventh directory has nine digits; files of four components.
_PATHS = "paths AS (SELECT '/raw/' || (event_id % 5) || '/' || CASE WHEN event_id % 7 = 0 THEN '17040672' || (10 + event_id % 90) % 10 ELSE CAST(1704067200 + (event_id // 3) * 600 AS VARCHAR) END || '/' || (['pol00', 'pol11', 'pol01r', 'pol01i'])[CAST(event_id % 4 AS INT) + 1] || '.scio.bz2' AS path FROM events)"
_DIRS = f"{_PATHS}, dirs AS (SELECT path, CAST(regexp_extract(path, '/(\\d{{10}})/[^/]+$', 1) AS BIGINT) AS unix_s, regexp_extract(path, '/(pol[^/.]+)\\.[^/]+$', 1) AS component FROM paths WHERE regexp_extract(path, '/(\\d{{10}})/[^/]+$', 1) <> '')"


def _paths(spark, sf_dir) -> DataFrame:
    k = F.col("event_id")
    folder = F.when(k % 7 == 0, F.concat(F.lit("17040672"), ((10 + k % 90) % 10).cast("string"))).otherwise((F.lit(1_704_067_200) + F.floor(k / 3) * 600).cast("string"))
    name = F.element_at(F.array(*map(F.lit, spectra.COMPONENTS)), (k % 4 + 1).cast("int"))
    return spectra.table(spark, sf_dir, "events").select(F.concat(F.lit("/raw/"), (k % 5).cast("string"), F.lit("/"), folder, F.lit("/"), name, F.lit(".scio.bz2")).alias("path"))


@query(f"WITH {_DIRS} SELECT path, unix_s, component FROM dirs")
def timestamp_dirs(spark, sf_dir):
    return spectra.timestamp_dirs(_paths(spark, sf_dir)).select("path", "unix_s", "component")


@query(f"WITH {_DIRS} SELECT path, unix_s FROM dirs WHERE unix_s BETWEEN 1704240000 AND 1704672001")
def dirs_in_range(spark, sf_dir):
    return spectra.in_range(spectra.timestamp_dirs(_paths(spark, sf_dir)), 1_704_240_000.5, 1_704_672_000.5, need=True).select("path", "unix_s")


@query(f"WITH {_DIRS} SELECT regexp_extract(path, '^(.*)/[^/]+$', 1) AS dir, unix_s, max(path) FILTER (component = 'pol00') AS pol00, max(path) FILTER (component = 'pol11') AS pol11, max(path) FILTER (component = 'pol01r') AS pol01r, max(path) FILTER (component = 'pol01i') AS pol01i FROM dirs GROUP BY ALL")
def component_paths(spark, sf_dir):
    return spectra.component_paths(_paths(spark, sf_dir))


# Component arrays made from embeddings: some are missing, some short.
_PARTS = "parts AS (SELECT vec_id, embedding AS pol00, CASE WHEN vec_id % 11 = 0 THEN NULL ELSE embedding END AS pol11, CASE WHEN vec_id % 13 = 0 THEN embedding[1:60] ELSE embedding END AS pol01r, CASE WHEN vec_id % 13 = 0 THEN embedding[1:60] ELSE embedding END AS pol01i FROM embeddings)"


def _parts(spark, sf_dir) -> DataFrame:
    e, k = F.col("embedding"), F.col("vec_id")
    rows = spectra.table(spark, sf_dir, "embeddings")
    short = F.when(k % 13 == 0, F.slice(e, 1, 60)).otherwise(e)
    values = {"pol00": e, "pol11": F.when(k % 11 != 0, e), "pol01r": short, "pol01i": short}
    return spectra.join_components({n: rows.select("vec_id", x.alias("values")) for n, x in values.items()}, ["vec_id"])


@query(f"WITH {_PARTS}, x AS (SELECT CASE WHEN pol11 IS NULL THEN 'missing' WHEN len(pol01r) <> len(pol00) THEN 'shape' END AS reason FROM parts) SELECT reason, count(*) AS n FROM x WHERE reason IS NOT NULL GROUP BY reason")
def row_rejects(spark, sf_dir):
    return spectra.reject_counts(_parts(spark, sf_dir), 64)


@query(f"WITH {_PARTS} SELECT vec_id, round(list_sum(pol00::DOUBLE[]), 4) AS total FROM parts WHERE pol11 IS NOT NULL AND len(pol01r) = 64")
def row_validation(spark, sf_dir):
    return spectra.complete(_parts(spark, sf_dir), 64).select("vec_id", F.round(F.aggregate("pol00", F.lit(0.0), lambda s, v: s + v), 4).alias("total"))


@query(f"WITH {_PARTS}, x AS (SELECT vec_id, unnest(pol01r)::DOUBLE AS re, unnest(list_reverse(pol01i))::DOUBLE AS im FROM parts WHERE pol11 IS NOT NULL AND len(pol01r) = 64) SELECT vec_id, round(sum(sqrt(re * re + im * im)), 4) AS mag, round(sum(atan2(im, re)), 4) + 0.0 AS phase FROM x GROUP BY vec_id")
def derive_arrays(spark, sf_dir):
    rows = spectra.complete(_parts(spark, sf_dir), 64)
    for c in ("pol01r", "pol01i"):
        rows = rows.withColumn(c, F.col(c).cast("array<double>"))
    done = spectra.derive_channels(rows.withColumn("pol01i", F.reverse("pol01i")))
    total = lambda c: r(F.aggregate(c, F.lit(0.0), lambda s, v: s + v), 4)
    return done.select("vec_id", total("pol01_mag").alias("mag"), total("pol01_phase").alias("phase"))


@query("WITH x AS (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS k FROM embeddings) SELECT vec_id, CAST(floor(vec_id * 77.0 / 10 + 0.5) + k AS BIGINT) AS t_idx, round(v::DOUBLE, 5) AS v FROM x")
def block_regularize(spark, sf_dir):
    """Blocks of 64 samples that begin every 77 seconds, on a grid of 10 seconds that holds them all."""
    rows = spectra.table(spark, sf_dir, "embeddings").select("vec_id", (F.col("vec_id") * 77.0).alias("unix_s"), F.col("embedding").alias("v"))
    return spectra.place_blocks(rows, "unix_s", 0.0, 10.0, 1 << 40, ["v"]).select("vec_id", "t_idx", F.round(F.col("v").cast("double"), 5).alias("v"))


@query(f"WITH {_SAMPLES}, {_STATIONS}, s AS (SELECT DISTINCT station, f_idx FROM station_cells) SELECT s.station, s.f_idx, g.t AS t_idx, round(power, 4) AS power FROM s CROSS JOIN range(720) AS g(t) LEFT JOIN station_cells AS c ON c.station = s.station AND c.f_idx = s.f_idx AND c.t_idx = g.t")
def dense_grid(spark, sf_dir):
    return spectra.dense(station_cells(spark, sf_dir), NT, ["station", "f_idx"]).select("station", "f_idx", "t_idx", r("power", 4).alias("power"))


@query("SELECT CAST(row_number() OVER () - 1 AS INT) AS i, key, value FROM (SELECT unnest([{'key': 'station', 'value': min(n_name)}, {'key': 'startutc', 'value': '20240101_000000'}, {'key': 'stoputc', 'value': '20240131_000000'}, {'key': 'created_utc', 'value': '20240201_000000'}, {'key': 'nt', 'value': '720'}, {'key': 'nchan', 'value': '16'}, {'key': 'dt_seconds', 'value': '3600.0'}, {'key': 'f0_mhz', 'value': '0.0'}, {'key': 'df_mhz', 'value': '0.25'}, {'key': 'source_root', 'value': '/raw'}], recursive := true) FROM nation)")
def cube_meta(spark, sf_dir):
    station = spectra.table(spark, sf_dir, "nation").agg(F.min("n_name").alias("name"))
    meta = spectra.cube_meta(spark, "", T0, DT, NT, NF, 0.0, 0.25, "/raw", datetime(2024, 2, 1, tzinfo=timezone.utc)).drop("station")
    return spectra.meta_rows(station.withColumnRenamed("name", "station").crossJoin(F.broadcast(meta)))


# Directories of 50 vectors every 45 samples; some lack a component, some have one of another width. Rows: t_idx and what the cube holds there.
_TREE = """v AS (SELECT vec_id // 50 AS run, (vec_id // 50) * 45 + vec_id % 50 AS t_idx, embedding AS e FROM embeddings), good AS (SELECT * FROM v WHERE run % 7 NOT IN (3, 5)),
won AS (SELECT * FROM good QUALIFY row_number() OVER (PARTITION BY t_idx ORDER BY run DESC) = 1)"""


def _ingested(spark, sf_dir, times: int = 1) -> ingest.Ingested:
    """A cube on disk from raw files that Spark makes of embeddings."""
    rows = spectra.table(spark, sf_dir, "embeddings").select("vec_id", F.floor(F.col("vec_id") / 50).alias("k"), "embedding", F.reverse("embedding").alias("back"))
    values = {"pol00": F.col("embedding"), "pol11": F.col("back"), "pol01r": F.when(F.col("k") % 7 == 5, F.slice("embedding", 1, 60)).otherwise(F.col("embedding")), "pol01i": F.col("back")}
    parts = F.explode(F.array(*[F.struct(F.lit(c).alias("component"), F.array_join(v.cast("array<string>"), ",").alias("line")) for c, v in values.items()])).alias("p")
    lines = rows.select("vec_id", (F.lit(int(T0)) + F.col("k") * 450).alias("run"), "k", parts).where("not (k % 7 = 3 and p.component = 'pol11')").select("run", "p.component", "vec_id", "p.line")
    root = shared_folder(spark, "raw")
    lines.repartition("run", "component").sortWithinPartitions("run", "component", "vec_id").select("run", "component", "line").write.partitionBy("run", "component").option("compression", "gzip").text(root)
    created = datetime(2024, 2, 1, tzinfo=timezone.utc)
    for _ in range(times):
        found = ingest.ingest(spark, root, f"{root}-cube", "S0", ingest.text_decoder, 10.0, 64, parents="", name="run=", files="component=*", df_mhz=0.0625, created=created)
    return found


@query(f"""WITH {_TREE}, m AS (SELECT t_idx, unnest(e)::DOUBLE AS a, unnest(list_reverse(e))::DOUBLE AS b FROM won)
SELECT t_idx, round(sum(a), 4) + 0.0 AS p00, round(sum(b), 4) + 0.0 AS p11, round(sum(sqrt(a * a + b * b)), 4) AS mag, round(sum(atan2(b, a)), 3) + 0.0 AS phase FROM m GROUP BY t_idx""")
def ingest_tree(spark, sf_dir):
    """Raw files to a cube on disk; it is ingested twice and read back."""
    found = _ingested(spark, sf_dir, 2)
    total = lambda c, n: r(F.aggregate(F.col(c).cast("array<double>"), F.lit(0.0), lambda s, v: s + v), n)
    cube_, _ = spectra.open_spectra(spark, found.cube, found.meta)
    return cube_.select("t_idx", total("pol00", 4).alias("p00"), total("pol11", 4).alias("p11"), total("pol01_mag", 4).alias("mag"), total("pol01_phase", 3).alias("phase"))


@query("""WITH v AS (SELECT vec_id // 50 AS run, count(*) AS n FROM embeddings GROUP BY run), e AS (SELECT max(run * 45 + n) FILTER (run % 7 NOT IN (3, 5)) AS nt FROM v)
SELECT CAST(i AS INT) AS i, key, value FROM e, LATERAL (VALUES (0, 'station', 'S0'), (1, 'startutc', '20240101_000000'), (2, 'stoputc', strftime(make_timestamp(1704067200000000 + nt * 10000000), '%Y%m%d_%H%M%S')), (3, 'nt', CAST(nt AS VARCHAR)), (4, 'nchan', '64'), (5, 'dt_seconds', '10.0'), (6, 'df_mhz', '0.0625')) AS x(i, key, value)""")
def ingest_meta(spark, sf_dir):
    """The description that the ingest leaves beside the cube: the grid that the accepted directories span."""
    return spectra.meta_rows(spark.read.parquet(_ingested(spark, sf_dir).meta), ["station", "startutc", "stoputc", "nt", "nchan", "dt_seconds", "df_mhz"])


@query("WITH v AS (SELECT DISTINCT vec_id // 50 AS run FROM embeddings) SELECT 1704067200 + run * 450 AS unix_s, CASE WHEN run % 7 = 3 THEN 'missing' ELSE 'shape' END AS reason FROM v WHERE run % 7 IN (3, 5)")
def ingest_rejects(spark, sf_dir):
    """Directories that the ingest leaves out, and why."""
    return _ingested(spark, sf_dir).rejects.select("unix_s", "reason")
