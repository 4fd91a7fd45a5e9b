import math

import numpy as np
import pandas as pd
import pytest

from kinfold.operators import features as ft
from kinfold.operators import matching as mt
from kinfold.operators import signal as sg


def peaks(spark, rows):
    return spark.createDataFrame(rows, "row_id string, mass double, intensity double")


def test_binning_normalises_rows(spark):
    df = peaks(spark, [("a", 2000.2, 1.0), ("a", 2000.8, 2.0), ("a", 2001.2, 3.0), ("b", 2002.4, 4.0)])
    got = {(r["row_id"], r["bin"]): r["value"] for r in ft.bin_peaks(df, mass_min=2000, mass_max=2004, bin_width=1).collect()}
    assert got == {("a", 0): 0.5, ("a", 1): 0.5, ("b", 2): 1.0}


def test_invalid_peaks_are_dropped(spark):
    bad = [("a", 2001.0, math.nan), ("a", 2001.0, math.inf), ("a", math.nan, 1.0), ("a", 2001.0, -1.0), ("a", 1999.9, 1.0),
           ("a", 2004.0, 1.0), ("a", 2003.9, 2.0)]
    assert ft.valid_peaks(peaks(spark, bad), 2000, 2004).count() == 1


def test_rebin_drops_the_partial_tail_and_rejects_bad_widths(spark):
    df = spark.createDataFrame([("a", 0, 0.25), ("a", 1, 0.25), ("a", 3, 0.25), ("a", 4, 0.25)], "row_id string, bin int, value double")
    got = {r["bin"]: r["value"] for r in ft.rebin(df, source_width=1, target_width=2, n_bins=5).collect()}
    assert got == {0: 0.5, 1: 0.25}
    with pytest.raises(ValueError):
        ft.rebin(df, source_width=1, target_width=0.5, n_bins=5)
    with pytest.raises(ValueError):
        ft.rebin(df, source_width=1, target_width=1.5, n_bins=5)


def test_zero_vector_stays_zero(spark):
    df = spark.createDataFrame([("a", 0, 0.0), ("b", 0, 3.0), ("b", 1, 4.0)], "row_id string, bin int, value double")
    got = {(r["row_id"], r["bin"]): r["value"] for r in ft.l2_normalise(df).collect()}
    assert got == {("a", 0): 0.0, ("b", 0): 0.6, ("b", 1): 0.8}


def profile(n=200):
    x = np.arange(n, dtype=float)
    baseline = 5 + 0.02 * x
    signal = sum(40 * np.exp(-0.5 * ((x - c) / 3.0) ** 2) for c in (50, 120))
    return x, baseline, signal


def test_smoothing_keeps_cubics_and_matches_least_squares(spark):
    x = np.arange(60, dtype=float)
    y = 2 + 0.5 * x - 0.01 * x**2 + 0.0003 * x**3
    df = peaks(spark, [("a", float(a), float(b)) for a, b in zip(x, y)])
    got = [r["intensity"] for r in sg.smooth(df, 10).orderBy("mass").collect()]
    assert np.allclose(got, y, atol=1e-8)
    noisy = y + np.sin(x * 3)
    df = peaks(spark, [("a", float(a), float(b)) for a, b in zip(x, noisy)])
    got = np.array([r["intensity"] for r in sg.smooth(df, 10).orderBy("mass").collect()])
    centre = 30
    fit = np.polyfit(x[centre - 10:centre + 11], noisy[centre - 10:centre + 11], 3)
    assert abs(got[centre] - np.polyval(fit, x[centre])) < 1e-6
    edge = np.polyfit(x[:21], noisy[:21], 3)
    assert abs(got[2] - np.polyval(edge, x[2])) < 1e-6


def test_short_profiles_pass_unsmoothed(spark):
    df = peaks(spark, [("a", float(i), float(i % 3)) for i in range(5)])
    assert [r["intensity"] for r in sg.smooth(df).orderBy("mass").collect()] == [0, 1, 2, 0, 1]


def test_baseline_and_peaks_on_a_known_profile(spark):
    x, baseline, signal = profile()
    df = peaks(spark, [("a", float(a), float(b)) for a, b in zip(x, baseline + signal)])
    flat = sg.remove_baseline(df, 40).orderBy("mass").toPandas()
    assert (flat.intensity >= 0).all()
    assert np.abs(flat.intensity.to_numpy() - signal)[20:180].max() < 1.5
    found = {r["mass"] for r in sg.detect_peaks(spark.createDataFrame(flat)).filter("intensity > 10").collect()}
    assert found == {50.0, 120.0}


def test_nearest_mass_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    ref = [(g, float(np.round(m, 3))) for g in "abc" for m in rng.uniform(0, 2000, 40)]
    loc = [(g, float(np.round(m, 3))) for g in "ab" for m in rng.uniform(300, 900, 15)]
    cols = "g string, mass double"
    got = mt.nearest_mass(spark.createDataFrame(ref, cols), spark.createDataFrame(loc, cols), ["g"], bucket_width=50).collect()
    assert len(got) == len(ref)
    for r in got:
        near = [abs(m - r["mass"]) for g, m in loc if g == r["g"]]
        assert (r["distance"] is None) if not near else math.isclose(r["distance"], min(near), abs_tol=1e-9)


def test_match_quality(spark):
    d = spark.createDataFrame([("s", 0.5), ("s", 1.5), ("s", 9.0), ("t", None)], "c string, distance double")
    got = {r["c"]: r for r in mt.match_quality(d, ["c"]).collect()}
    assert (got["s"]["matched"], got["s"]["median_error"], got["s"]["max_error"]) == (2, 1.5, 9.0)
    assert abs(got["s"]["match_share"] - 2 / 3) < 1e-12 and got["t"]["match_share"] is None
