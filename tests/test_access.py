"""Sources, channels, masks, single frames, series, terrain and labels."""

import math
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from chronospan.functions import selection
from chronospan.functions.grid import FramePlan
from chronospan.operators import background, frames, rois, series, terrain
from chronospan.plans import pipeline
from chronospan.plans.pipeline import Pipeline, db_step, stokes_i_step
from chronospan.sources import spectra

NAN = float("nan")


def test_selection(spark):
    rows = spark.createDataFrame([(1, 1.0, 2.0, 3.0, 4.0)], "k long, pol00 double, pol11 double, pol01_mag double, pol01_phase double")
    assert selection.select_channels(rows, 2, ["k"], stacked="v").first()["v"] == 3.0
    assert selection.select_channels(rows, [3, 0], ["k"], stacked="v").first()["v"] == [4.0, 1.0]
    assert selection.channel_names([0, 3, 7]) == ("pol00", "pol01_phase", "chan7") and selection.channel_names(1) == ("pol11",)
    for bad in ([], [4], -1):
        with pytest.raises(ValueError):
            selection.check_channels(bad)
    for bad in ((3, 3), (-1, 2), (0, 9)):
        with pytest.raises(ValueError):
            selection.check_slice(*bad, 8)


def test_masks(spark):
    m = selection.FreqMask.without(8, -5, 3)
    assert m.size == 5 and selection.FreqMask.without(8, 5, 5).size == 8 and selection.FreqMask.without(8, 6, 99).size == 6
    assert selection.FreqMask.of([False, False, False, True, True, True, True, True]) == m
    df = spark.range(8).withColumnRenamed("id", "f_idx")
    assert [r[0] for r in m.rows(df).orderBy("f_idx").collect()] == [3, 4, 5, 6, 7]
    assert spark.range(1).select(m.array(F.array(*map(F.lit, range(8))))).first()[0] == [3, 4, 5, 6, 7]


PLAN = FramePlan(4, 60, 6, 2, 1.0, 0.0)


def test_frames(spark):
    samples = spark.createDataFrame([(t, float(t)) for t in range(64) if not 20 <= t < 40], "t_idx long, x double")
    count = frames.assign(samples, PLAN).groupBy("frame_idx").agg(F.count("*").alias("n"))
    full = {r["frame_idx"]: r["n"] for r in frames.with_plan(count, PLAN, ("n",)).collect()}
    assert len(full) == PLAN.n_frames == 26 and full[0] == 6 and full[10] == 0
    assert [r["t_idx"] for r in frames.frame_at(samples, PLAN, 1).orderBy("t_idx").collect()] == [6, 7, 8, 9, 10, 11]
    assert {r["frame_idx"] for r in frames.load_at(samples, PLAN, 9).collect()} == {-1}
    for bad in (-1, 26):
        with pytest.raises(IndexError):
            frames.frame_at(samples, PLAN, bad)
        with pytest.raises(IndexError):
            frames.frame_batch(samples, PLAN, [0, bad])
    with pytest.raises(ValueError):
        frames.load_at(samples, PLAN, 60, nt=64)
    batch = frames.frame_batch(samples, PLAN, [3, 0, 3]).collect()
    assert sorted((r["pos"], r["t_idx"]) for r in batch) == sorted((p, t) for p, i in enumerate([3, 0, 3]) for t in range(4 + 2 * i, 10 + 2 * i))
    assert frames.frame_batch(samples, PLAN, []).count() == 0
    one = {r["frame_idx"] for r in frames.random_frame(samples, PLAN, 5).collect()}
    assert one == {r["frame_idx"] for r in frames.random_frame(samples, PLAN, 5).collect()}
    order = [r["frame_idx"] for r in frames.in_order(frames.assign(samples, PLAN), "t_idx").toLocalIterator()]
    assert order == sorted(order)


def test_quiet(spark):
    rows = [("a", 0, 3.0), ("a", 1, -math.inf), ("a", 2, math.inf), ("a", 3, NAN), ("a", 4, None), ("a", 5, 1.0), ("b", 6, NAN)]
    df = spark.createDataFrame(rows, "g string, frame_idx long, score double")
    got = background.select_quiet(df, ["g"], 0.5, on_none="skip").collect()
    assert [r["frame_idx"] for r in got] == [5]
    assert {r["frame_idx"] for r in background.select_quiet(df, ["g"], 0.1, n_quiet=9, on_none="skip").collect()} == {0, 5}
    with pytest.raises(Exception, match="no finite quiet score"):
        background.select_quiet(df, ["g"], 0.5).collect()
    with pytest.raises(ValueError):
        background.select_quiet(df, ["g"], 0.0)


def test_series(spark):
    df = spark.createDataFrame([("a", 0, 1.0), ("a", 1, NAN), ("a", 2, 3.0), ("b", 0, 2.0), ("b", 1, 2.0), ("c", 0, NAN)], "s string, t long, v double")
    got = {(r["s"], r["t"]): r["o"] for r in series.minmax(df, "v", ["s"], "o").collect()}
    assert got == {("a", 0): 0.0, ("a", 1): None, ("a", 2): 1.0, ("b", 0): 0.5, ("b", 1): 0.5, ("c", 0): None}
    free = {(r["s"], r["t"]): r["o"] for r in series.minmax(df, "v", ["s"], "o", guard=False).collect()}
    assert free["b", 0] is None and free["a", 2] == 1.0
    curve = lambda how: {r["s"]: r["flux"] for r in series.light_curve(df, ["s"], "v", how).collect()}
    assert curve("mean") == {"a": 2.0, "b": 2.0, "c": None} and curve("sum") == {"a": 4.0, "b": 4.0, "c": 0.0} and curve("median")["c"] is None
    with pytest.raises(ValueError):
        series.light_curve(df, ["s"], "v", "max")
    a, b = [0, 0, 1, 0, 0, 0, 5], [1, 0, 0, 0, 0, 0, NAN]
    pairs = spark.createDataFrame([("x", i, float(p), float(q)) for i, (p, q) in enumerate(zip(a, b))], "g string, i long, a double, b double")
    best = series.best_lag(series.cross_correlation(pairs, ["g"], "i", "a", "b", 5), ["g"]).first()
    assert best["lag"] == 2 and abs(best["corr"] - 0.933333) < 1e-5 and best["relation"] == "lags"
    limits = series.color_limits(spark.createDataFrame([(NAN,), (None,)], "v double"), "v").first()
    assert tuple(limits) == (0.0, 1.0, 1.0)


def test_flux(spark):
    utc = lambda *a: datetime(*a, tzinfo=timezone.utc)
    assert series.days_of(utc(2024, 7, 30, 22), utc(2024, 8, 1)) == ["20240730", "20240731", "20240801"]
    names = ["/g/2024/s_d20240730_v1.nc", "/g/2024/s_d20240730_v2.nc", "/g/2023/s_d20240731_v1.nc", "/g/2024/s_d20240802_v1.nc", "/g/2024/s_d20240801_v1.nc"]
    files = spark.createDataFrame([(n,) for n in names], "path string")
    assert [r[0] for r in series.daily_files(files, utc(2024, 7, 30), utc(2024, 8, 1)).collect()] == [names[0], names[1], names[4]]
    t = spark.createDataFrame([(3, 1.0, 2.0), (1, 1.0, 2.0), (9, 0.0, 0.0)], "time long, xrsa_flux double, xrsb_flux double")
    assert [r["time"] for r in series.load_series([t, t], F.lit(1), F.lit(9)).collect()] == [1, 1, 3, 3]
    with pytest.raises(KeyError):
        series.load_series([t.drop("xrsb_flux")], F.lit(1), F.lit(9))
    with pytest.raises(FileNotFoundError):
        series.load_series([], F.lit(1), F.lit(9))
    with pytest.raises(ValueError):
        series.days_of(utc(2024, 8, 1), utc(2024, 8, 1))
    assert [r["time"] for r in series.clip_to(t, t.where("time < 4"), "time").orderBy("time").collect()] == [1, 3]


def test_terrain(spark):
    dem = spark.createDataFrame([(r, c, 10.0 if (r, c) == (2, 4) else 0.0) for r in range(5) for c in range(7)], "row long, col long, elevation double")
    point = spark.createDataFrame([("p", 2, 2)], "p string, row0 long, col0 long")
    got = {r["azimuth"]: r["horizon"] for r in terrain.horizon_profile(point, dem, ["p"], n_directions=4, max_distance=3.0, step=1.0, compass=False).collect()}
    assert abs(got[0.0] - math.degrees(math.atan2(10, 2))) < 1e-9 and got[90.0] == 0.0 and got[180.0] == 0.0
    with pytest.raises(Exception, match="outside the elevation grid"):
        terrain.horizon_profile(point.withColumn("row0", F.lit(9).cast("long")), dem, ["p"], 4, 3.0, 1.0).collect()
    path = spark.createDataFrame([("p", 0, k, a) for k, a in enumerate([80.0, 1.0, -1.0, NAN])], "p string, day long, k long, alt double")
    profile = spark.createDataFrame([("p", k, h) for k, h in enumerate([78.0, 2.0, -2.0])], "p string, k long, horizon double")
    assert terrain.illuminated_fraction(path, profile, ["p"], "day", "k", "alt", 4).first()["fraction"] == 0.5


def test_sources(spark, tmp_path):
    files = spark.createDataFrame([("/r/a/1704067200/pol00.scio.bz2",), ("/r/a/1704067200/pol11.scio.bz2",), ("/r/170406720/pol00.scio.bz2",), ("/r/17040672001/pol00.scio.bz2",), ("/r/1704067260/pol01i.scio.bz2",)], "path string")
    got = {r["unix_s"]: r for r in spectra.component_paths(files).collect()}
    assert set(got) == {1704067200, 1704067260} and got[1704067200]["pol11"].endswith("pol11.scio.bz2") and got[1704067200]["pol01r"] is None
    dirs = spectra.timestamp_dirs(files)
    assert spectra.in_range(dirs, 1704067200.2, 1704067259.1).count() == 3
    with pytest.raises(FileNotFoundError):
        spectra.in_range(dirs, 5, 6, need=True)
    with pytest.raises(Exception, match="no time"):
        spectra.bounds(spark.createDataFrame([], "ts timestamp"), "ts").collect()
    blocks = spark.createDataFrame([(1, 15.0, [1.0, 2.0, 3.0]), (2, 80.0, [9.0, 8.0, 7.0]), (3, 500.0, [0.0])], "k long, u double, v array<double>")
    placed = {(r["k"], r["t_idx"]): r["v"] for r in spectra.place_blocks(blocks, "u", 0.0, 10.0, 10, ["v"]).collect()}
    assert placed == {(1, 2): 1.0, (1, 3): 2.0, (1, 4): 3.0, (2, 8): 9.0, (2, 9): 8.0}
    a = [[0.0] * 3] * 2
    parts = spark.createDataFrame([(1, a, a, a, a), (2, a, a, a, None), (3, a, a, a, a[:1]), (4, a, a, a, [[0.0] * 3, [0.0]]), (5, [x[:2] for x in a]) + ([x[:2] for x in a],) * 3], "k long, " + ", ".join(f"{c} array<array<double>>" for c in spectra.COMPONENTS))
    assert {r["reason"]: r["n"] for r in spectra.reject_counts(parts, 3, blocks=True).collect()} == {"missing": 1, "shape": 2, "width": 1}
    assert [r["k"] for r in spectra.complete(parts, 3, blocks=True).collect()] == [1]
    meta = spectra.cube_meta(spark, "M3", 1704067200.0, 0.5, 8, 4, 1.0, 0.25, "/r")
    keys = [(r["key"], r["value"]) for r in spectra.meta_rows(meta, all_keys=True).orderBy("i").collect()]
    assert [k for k, _ in keys[:10]] == spectra.META_KEYS and keys[2] == ("stoputc", "20240101_000004") and keys[-1][0] == "channel_labels"
    spectra.write_spectra(spark.createDataFrame([("M3", 3, [1.0])], "station string, t_idx long, pol00 array<double>"), str(tmp_path / "s"))
    meta.write.parquet(str(tmp_path / "m"))
    cube, described = spectra.open_spectra(spark, str(tmp_path / "s"), str(tmp_path / "m"))
    assert described["nt"] == 8 and cube.select(F.unix_micros("ts")).first()[0] == 1704067201500000
    assert spectra.dense(spark.createDataFrame([("x", 1, 5.0)], "s string, t_idx long, v double"), 3, ["s"]).count() == 3


def test_labels_and_intervals(spark):
    label = rois.metric_label
    assert [label("lp", p=4), label("lp", p=2.5), label("lp"), label("topk_sum", topk=2048), label("topk_sum"), label("percentile", q=99.0), label("percentile", q=99.5), label("percentile"), label("l1"), label()] == ["l4", "lp2.5", "lp", "topk2048", "topk", "p99", "p99.5", "percentile", "l1", "unknown"]
    assert rois.file_tag("-a b/ü_1-") == "a-b-ü_1" and rois.file_tag("//") == "unknown"
    events = rois.curated(spark).collect()
    assert len(events) == len(rois.CURATED_INDICES) == 30 and events[0]["start_us"] == 1721526300000000
    scores = spark.createDataFrame([(t * 60_000_000,) for t in range(0, 200, 10)], "time_us long")
    spans = spark.createDataFrame([(0, 50 * 60_000_000, 70 * 60_000_000), (1, 70 * 60_000_000, 70 * 60_000_000)], "event long, start_us long, stop_us long")
    got = sorted((r["event"], r["time_us"] // 60_000_000) for r in rois.within(scores, spans, ["event"]).collect())
    assert got == [(0, 50), (0, 60), (0, 70), (1, 70)]
    assert len(rois.within(scores, spans, ["event"], pad_us=600_000_000).collect()) == 8


def test_pipeline_more(tmp_path):
    p = Pipeline(("pol00", "pol11")).add(stokes_i_step()).add(db_step())
    with pytest.raises(ValueError):
        p.with_input_channels("pol11", "pol00")
    with pytest.raises(ValueError):
        p.with_input_desc(("pol00", "pol11"), "db")
    assert Pipeline(("a",)).add(db_step()).with_input_channels("b").output() == (("b",), "db")
    with pytest.raises(ValueError):
        pipeline.reject_db(p, "quick look")
    pipeline.reject_db(Pipeline(("a",)), "quick look")
    p.save_json(str(tmp_path / "x/p.json"))
    assert (tmp_path / "x/p.json").read_text() == p.to_json()
    assert [pipeline.panel_layout(n) for n in (1, 2, 3, 4, 5)] == [(1, 1), (1, 2), (2, 2), (2, 2), (3, 2)]
    assert pipeline.panel_labels(1, pipeline=p) == ["stokes_i"] and pipeline.panel_labels(2, channels=[3, 9]) == ["pol01_phase", "chan9"] and pipeline.panel_labels(3) == ["ch0", "ch1", "ch2"]
    with pytest.raises(ValueError):
        pipeline.panel_labels(2, labels=["x"])
