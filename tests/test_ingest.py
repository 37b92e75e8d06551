"""From a tree of raw files to a cube: names, decoding, reasons, overlaps, the end of the grid, and reading twice."""

import gzip
from datetime import datetime, timezone

import numpy as np
import pytest

from chronospan.sources import ingest, spectra

T0, DT, WIDTH = 1_704_067_200, 10.0, 6


@pytest.fixture
def tree(tmp_path):
    """Eight directories of 5 spectra every 40 s (so the next one begins with this one's last spectrum), below two parents."""
    rng = np.random.default_rng(0)
    data = {}
    for k in range(8):
        at = tmp_path / "raw" / ("left" if k % 2 else "right") / str(T0 + 40 * k)
        at.mkdir(parents=True)
        for c in spectra.COMPONENTS:
            x = rng.normal(size=(5, WIDTH)).astype(np.float32)
            if k == 3 and c == "pol01r":
                x = x[:4]
            if k == 4 and c == "pol11":
                continue
            if k == 5:
                x = x[:, :4]
            if k == 6:
                x[0, 2] = np.nan
            data[k, c] = x
            text = "\n".join(",".join(repr(float(v)) for v in r) for r in x).encode()
            (at / f"{c}.txt.gz").write_bytes(gzip.compress(text))
    (tmp_path / "raw" / "left" / "notes").mkdir()
    (tmp_path / "raw" / "left" / "notes" / "pol00.txt.gz").write_bytes(b"")
    (tmp_path / "raw" / "right" / str(T0) / "pol11.txt.gz").touch()
    return str(tmp_path / "raw"), data


def test_names():
    assert ingest.covering(0, 99, 2) == [""] and ingest.covering(7, 12, 2) == ["07", "08", "09", "10", "11", "12"]
    for lo, hi in ((0, 999), (123, 456), (199, 200), (990, 1500)):
        got = sorted(n for p in ingest.covering(lo, hi, 4) for n in range(int(p.ljust(4, "0")), int(p.ljust(4, "9")) + 1))
        assert got == list(range(lo, hi + 1))
    assert len(ingest.covering(1_704_067_201, 1_735_689_599)) < 100
    with pytest.raises(FileNotFoundError):
        ingest.globs(5, 4)


def read(spark, found):
    rows, meta = spectra.open_spectra(spark, found.cube, found.meta)
    return {r["t_idx"]: r for r in rows.collect()}, meta


def test_ingest_twice(spark, tree, tmp_path):
    root, data = tree
    of = lambda: ingest.ingest(spark, root, str(tmp_path / "out"), "S1", ingest.text_decoder, DT, WIDTH, created=datetime(2024, 2, 1, tzinfo=timezone.utc))
    found = of()
    rows, meta = read(spark, found)
    assert {(r["unix_s"], r["reason"]) for r in found.rejects.collect()} == {(T0 + 120, "shape"), (T0 + 160, "missing"), (T0 + 200, "width")}
    want = {}
    for k in (0, 1, 2, 6, 7):
        for i in range(5):
            want[4 * k + i] = (k, i)  # the later directory wins
    assert rows.keys() == want.keys() and meta["nt"] == 33 and meta["station"] == "S1"
    for t, (k, i) in want.items():
        re, im = data[k, "pol01r"][i].astype(float), data[k, "pol01i"][i].astype(float)
        for name, v in (("pol00", data[k, "pol00"][i]), ("pol11", data[k, "pol11"][i]), ("pol01_mag", np.hypot(re, im)), ("pol01_phase", np.arctan2(im, re))):
            assert np.allclose(rows[t][name], v, rtol=1e-6, equal_nan=True)
        assert rows[t]["ts"].replace(tzinfo=timezone.utc).timestamp() == T0 + t * DT
    assert np.isnan(rows[24]["pol00"][2])  # a missing value of the later directory wins as well
    again, meta2 = read(spark, of())
    assert str(sorted(again.items())) == str(sorted(rows.items())) and meta2 == meta


def test_ranges_and_ends(spark, tree, tmp_path):
    root, _ = tree
    files = ingest.raw_files(spark, root, T0 + 40, T0 + 119.5)
    assert {r["unix_s"] for r in files.select("unix_s").collect()} == {T0 + 40, T0 + 80, T0 + 120} and all("notes" not in f and str(T0) not in f.rsplit("/", 2)[1] for f in files.inputFiles())
    of = lambda **k: read(spark, ingest.ingest(spark, root, str(tmp_path / f"out{len(k)}{sorted(k)[0]}"), "S", ingest.text_decoder, DT, WIDTH, **k))
    rows, meta = of(infer_stop="dir_start")
    assert max(rows) == 28 and meta["nt"] == 29  # of the last directory one sample
    rows, meta = of(start=T0 + 40, stop=T0 + 100)
    assert sorted(rows) == [0, 1, 2, 3, 4, 5] and meta["nt"] == 6
    with pytest.raises(FileNotFoundError):
        ingest.raw_files(spark, root, 5, 9)
    with pytest.raises(ValueError):
        of(infer_stop="guess")


def test_decoder_refuses():
    assert ingest.text_decoder(b"1,2\n3") is None and ingest.text_decoder(b"") is None and ingest.text_decoder(b"a,b") is None and ingest.text_decoder(b"\x1f\x8bxx") is None
    assert ingest.text_decoder(b"1,2\n3,nan\n").shape == (2, 2)
