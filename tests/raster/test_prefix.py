"""Running sums and quantiles over ranges against plain loops."""

import math
import random

import numpy as np
import pytest

from gridloom.operators import monitor, prefix


def rows_of(seed=4):
    r = random.Random(seed)
    out = {}
    for _ in range(400):
        out[r.choice(["a", "a", "a", "b", None]), r.choice([r.random() * 100, 5.0, 1e9, -3.0])] = r.randint(-2, 3)
    out |= {("a", math.inf): 1, ("a", -math.inf): 2, ("b", math.nan): 1}
    return [(g, t, n) for (g, t), n in out.items()]


@pytest.mark.parametrize("by", [["g"], []])
@pytest.mark.parametrize("ranges", [4096, 3])
def test_running_sums_match_a_loop(spark, monkeypatch, by, ranges):
    monkeypatch.setattr(prefix, "RANGES", ranges)
    rows = rows_of() if by else [("x", t, n) for t, n in {t: n for _, t, n in rows_of()}.items()]
    got = {(x.g, str(x.t)): (x.running, str(x.following)) for x in prefix.running(spark.createDataFrame(rows, "g string, t double, n int"), by, ["t"], "n").collect()}
    want = {}
    for g in {g for g, _, _ in rows}:
        own = sorted((x for x in rows if x[0] == g), key=lambda x: (math.isnan(x[1]), x[1]))
        total = 0
        for x, after in zip(own, own[1:] + [None]):
            total += x[2]
            want[g, str(x[1])] = (total, str(after and after[1]))
    assert got == want


def test_quantiles_match_numpy(spark):
    r = np.random.default_rng(0)
    rows = [(["a", "b", None][int(r.integers(3))], float(x)) for x in r.integers(0, 50, 500)] + [("empty", None), ("one", 7.0)]
    got = {x.g: x for x in prefix.quantiles(spark.createDataFrame(rows, "g string, v double"), "v", {"p5": 0.05, "p95": 0.95}, ["g"]).collect()}
    for g in ("a", "b", None, "one"):
        v = [x for k, x in rows if k == g]
        assert got[g]["count"] == len(v) and (got[g].p5, got[g].p95) == pytest.approx(np.quantile(v, [0.05, 0.95]))
    assert got["empty"]["count"] == 0 and got["empty"].p5 is None
    assert prefix.quantiles(spark.createDataFrame([], "g string, v double"), "v", {"p5": 0.05}, ["g"]).count() == 0
    assert prefix.quantiles(spark.createDataFrame([], "v double"), "v", {"p5": 0.05}).first().p5 is None


def test_sweeps_of_groups_match_a_loop(spark, monkeypatch):
    monkeypatch.setattr(prefix, "RANGES", 5)
    r = random.Random(2)
    spans = [(g, float(a), float(a + r.randint(0, 5))) for g in ("x", None) for a in (r.randint(0, 60) for _ in range(40))]
    got = {x.g: x.elapsed for x in monitor.time_elapsed(spark.createDataFrame(spans, "g string, started double, ended double"), ["g"]).collect()}
    for g in ("x", None):
        assert got[g] == sum(any(k == g and a <= t < b for k, a, b in spans) for t in range(70))
