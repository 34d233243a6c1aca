"""Quantiles, Otsu's cut and shares from counts, against numpy over all values."""

import numpy as np
import pytest

from sigmaspark.operators import summaries


def by_hand(x, low, high, bins):
    lo, hi = np.quantile(x, [low, high])
    if hi <= lo:
        return len(x), lo, hi, None, None
    x = np.clip(x, lo, hi)
    width = (hi - lo) / bins
    at = np.minimum(np.floor((x - lo) / width), bins - 1).astype(int)
    n = np.bincount(at, minlength=bins)
    used = np.flatnonzero(n)
    share, centre = n[used] / n.sum(), lo + (used + 0.5) * width
    omega, mu, total = np.cumsum(share), np.cumsum(share * centre), (share * centre).sum()
    with np.errstate(all="ignore"):
        part = np.where(omega < 1 - 1e-12, np.round((total * omega - mu) ** 2 / (omega * (1 - omega)), 9), -1)
    best = used[int(np.argmax(part))]
    cut = lo + (best + 0.5) * width
    return len(x), lo, hi, cut, (x <= cut).mean()


@pytest.mark.parametrize("fine", [3, 64, 4096])
def test_against_numpy(spark, fine):
    r = np.random.default_rng(5)
    scenes = {
        "two": np.concatenate([r.normal(-20, 2, 4000), r.normal(-8, 3, 3000)]), "flat": np.full(300, -7.25), "steps": r.integers(0, 9, 1000) / 4.0, "few": np.array([1.0, 2.0, 4.0]), "one": np.array([3.5]),
        "wide": r.normal(0, 40, 2000), "ties": np.repeat([1.0, 1.0, 5.0, 9.0], 50),
    }
    rows = [(s, float(v), 1) for s, x in scenes.items() for v in x] + [("two", None, 1), ("two", float("nan"), 1), ("none", None, 1)]
    df = spark.createDataFrame(rows, "scene string, db double, n int")
    got = {x.scene: x for x in summaries.clipped_cut(df, "scene", "db", 0.02, 0.98, bins=32, fine=fine).collect()}
    assert set(got) == set(scenes)
    for s, x in scenes.items():
        n, lo, hi, cut, below = by_hand(x, 0.02, 0.98, 32)
        g = got[s]
        assert g.n == n and g.lo == pytest.approx(lo, abs=1e-9) and g.hi == pytest.approx(hi, abs=1e-9), s
        if cut is None:
            assert g.otsu is None and g.below is None
        else:
            assert g.otsu == pytest.approx(cut, abs=1e-9) and g.below == pytest.approx(below, abs=1e-12), s


def test_limits_and_empty(spark):
    df = spark.createDataFrame([("s", float(k)) for k in range(50)], "scene string, db double")
    assert summaries.clipped_cut(df, "scene", "db", 0.1, 0.9, least=51).first().otsu is None
    assert summaries.clipped_cut(df, "scene", "db", 0.1, 0.9, contrast=1000.0).first().otsu is None
    assert summaries.clipped_cut(df.limit(0), "scene", "db", 0.1, 0.9).count() == 0
