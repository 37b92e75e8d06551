"""Quick looks over numbers and arrays, what they refuse, and ranges padded by half a context."""

import math
from datetime import datetime, timezone

import pytest

from chronospan.functions.grid import padded_range
from chronospan.plans.pipeline import Pipeline, db_step
from chronospan.plans.recipes import INSTRUMENTAL, STOKES_FRACTIONAL, stokes_pipeline

NAMES = ("pol00", "pol11", "pol01_mag", "pol01_phase")
ROWS = [(1, 10.0, 100.0, 0.0, 0.5), (2, 3.0, -3.0, 2.0, 1.0), (3, float("nan"), 4.0, 1.0, -2.0)]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, "k int, " + ", ".join(f"{c} double" for c in NAMES))


def test_instrumental(spark, rows):
    got = {r["k"]: r for r in INSTRUMENTAL.apply(rows, ["k"]).collect()}
    assert (got[1]["pol00_db"], got[1]["pol11_db"], got[1]["pol01_mag_db"], got[1]["pol01_phase"]) == pytest.approx((10, 20, -120, 0.5))
    assert got[2]["pol11_db"] == -120 and got[3]["pol00_db"] is None and INSTRUMENTAL.labels == ("pol00_db", "pol11_db", "pol01_mag_db", "pol01_phase")
    arrays = spark.createDataFrame([(7, *([r[i] for r in ROWS] for i in range(1, 5)))], "k int, " + ", ".join(f"{c} array<double>" for c in NAMES))
    wide = INSTRUMENTAL.apply(arrays, ["k"]).first()
    assert [wide[c] for c in INSTRUMENTAL.labels] == [[got[k][c] for k in (1, 2, 3)] for c in INSTRUMENTAL.labels]


def test_stokes(rows):
    got = {r["k"]: r for r in STOKES_FRACTIONAL.apply(rows, ["k"], stokes_pipeline()).collect()}
    assert got[1]["stokes_i_db"] == pytest.approx(10 * math.log10(55)) and got[1]["q_i"] == pytest.approx(-45 / 55)
    assert got[2]["q_i"] is None and got[2]["stokes_i_db"] == -120  # no power to divide by
    with pytest.raises(ValueError, match="needs channels"):
        STOKES_FRACTIONAL.apply(rows, ["k"])


def test_decibels_are_refused(rows):
    db, linear = Pipeline(NAMES).add(db_step(), validate=False), Pipeline(NAMES)
    for recipe in (INSTRUMENTAL, STOKES_FRACTIONAL):
        with pytest.raises(ValueError, match="linear"):
            recipe.apply(rows, ["k"], pipeline=db)
        with pytest.raises(ValueError, match="linear"):
            recipe.apply(rows, ["k"], data_pipeline=db)
    assert INSTRUMENTAL.apply(rows, ["k"], pipeline=linear, data_pipeline=db).count() == 3  # its own goes before the data's


def test_padded_range():
    utc = lambda *x: datetime(*x, tzinfo=timezone.utc)
    assert padded_range(utc(2024, 7, 20), utc(2024, 7, 21, 6), 24) == ("20240719_120000", "20240721_180000")
    assert padded_range(utc(2024, 3, 1, 0, 0, 0, 900_000), utc(2024, 3, 1), 1) == ("20240229_233000", "20240301_003000")  # seconds are cut
