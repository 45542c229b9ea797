"""Principal axes, ranks, time-respecting minima, rebalanced baskets, ladders and triplets against plain versions on small fixtures."""

import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from shapewright.operators import axes, funds, triplets
from shapewright.operators import search as S
from shapewright.plans import QUERIES

from conftest import SF


def test_axes_equal_numpy(spark):
    r = np.random.default_rng(0)
    x = r.normal(size=(500, 6)) @ r.normal(size=(6, 6)) + 3
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [1.0]), (902, [float("nan")] * 6), (903, [None, *[1.0] * 5])]
    df = spark.createDataFrame(rows, "id long, v array<double>").repartition(7)
    a = axes.fitted(df, "v", 6, 4)
    values, vectors = np.linalg.eigh(np.cov(x.T))
    want = vectors[:, ::-1][:, :4]
    want = want * np.sign(want[np.abs(want).argmax(axis=0), range(4)])
    assert np.allclose(a.variances, values[::-1][:4], atol=1e-9) and np.allclose(a.axes, want, atol=1e-6) and a.n == 500
    assert np.allclose(a.shares, np.cumsum(values[::-1])[:4] / values.sum())
    got = {r["id"]: r["z"] for r in axes.projected(df, "v", a, "z").collect()}
    assert np.allclose([got[i] for i in range(500)], (x - x.mean(axis=0)) @ want, atol=1e-6) and got[900] is got[901] is got[903] is None
    with pytest.raises(ValueError):
        axes.fitted(df.limit(0), "v", 6, 2)


def test_self_ranks(spark):
    r = np.random.default_rng(1)
    base = r.normal(size=(80, 5))
    changed = base + r.normal(size=(80, 5)) * 0.8
    frame = lambda x: spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    unit = lambda x: x / np.linalg.norm(x, axis=1)[:, None]
    d = 1 - unit(changed) @ unit(base).T
    want = [int((d[i] < d[i, i]).sum()) + 1 for i in range(80)]
    got = {r["id"]: r["rank"] for r in axes.self_ranks(frame(changed).where("id % 3 = 0"), frame(base)).collect()}
    assert got == {i: want[i] for i in range(0, 80, 3)} and max(want) > 1


def test_minima_agree_on_a_group(spark, monkeypatch):
    """Profiles meet only rows of their own group; those that meet none are left out."""
    r = np.random.default_rng(3)
    c = np.round(r.random((40, 20)), 2)
    rows = [(i, 1990, i % 3, v.tolist(), 0.5) for i, v in enumerate(c)]
    df = spark.createDataFrame(rows, "entity int, year int, t int, c array<double>, tau double")
    monkeypatch.setattr(S, "HELD", 3)
    held = df.where("entity < 20 AND t < 2").drop("tau")
    got = {x["entity"]: x for x in S.soft_minima(df, held, group="t").collect()}
    assert {i % 3 for i in got} == {0, 1}
    for i, x in got.items():
        d = np.array([5 * np.abs(c[i] - c[j]).sum() for j in range(20) if j % 3 == i % 3])
        two = np.sort(d)[:2]
        assert np.allclose((x["least"], x["second"], x["soft"]), (*two, two[0] - 0.5 * np.log(np.exp(-(d - two[0]) / 0.5).sum())))


def test_rebalanced_equals_a_fold_over_days(spark):
    """Holdings in units, day by day, against stretches between marks; a leg that has no bar yet gives no multiple."""
    r = np.random.default_rng(5)
    days = [dt.date(2024, 1, 1) + dt.timedelta(i) for i in range(40)]
    price = {leg: np.exp(np.cumsum(r.normal(size=40) * 0.05)) for leg in "abc"}
    bars = [(leg, days[i], float(price[leg][i])) for leg in "abc" for i in range(40) if not (leg == "b" and i % 3 == 1) and not (leg == "c" and i < 12)]
    marks = [days[i] for i in (6, 13, 20, 27, 34)]
    share = lambda day, rule: {"a": 0.5, "b": 0.5} if rule == "x" or day < days[13] else {"a": 0.3, "b": 0.3, "c": 0.4}

    def weights(day, rule):
        two, three = (F.create_map(*[F.lit(v) for kv in w.items() for v in kv]) for w in (share(days[0], "x"), share(days[20], "y")))
        return F.when((rule == "x") | (day < F.lit(days[13])), two).otherwise(three)

    windows = [(days[i], days[j], rule) for rule in "xy" for i in range(0, 39, 5) for j in range(i + 1, 40, 7)]
    prices = funds.aligned(spark.createDataFrame(bars, "leg string, day date, price double"), "a")
    out = funds.rebalanced(spark.createDataFrame(windows, "entry date, exit date, rule string"), prices, spark.createDataFrame([(m,) for m in marks], "day date"), weights)
    held = {}
    for leg in "abc":
        last = None
        for day in days:
            last = next((p for k, d, p in bars if k == leg and d == day), last)
            held[leg, day] = last
    for row in out.collect():
        value, units, n = 1.0, None, 0
        for day in days[days.index(row["entry"]) : days.index(row["exit"]) + 1]:
            if units:
                value = sum(u * held[k, day] for k, u in units.items())
            if units is None or (day in marks and day < row["exit"]):
                units, n = {k: value * w / held[k, day] for k, w in share(day, row["rule"]).items()}, n + 1
        assert row["gross"] == pytest.approx(value, rel=1e-9) and row["n_marks"] == n


def test_ladder_states(spark):
    doc = lambda **k: (json.dumps(k),)
    years = lambda *r: [{"year": 2000 + i, "tr_nav": x} for i, x in enumerate(r)]
    docs = [
        doc(ticker="runs", years=years(0.5, 0.1, -0.2, 0.3)),
        doc(ticker="open", years=years(0.5, None, -0.2, 0.3)),
        doc(ticker="pct", years=[{"year": 2001, "tr_pct": 10.0}, {"year": 2002, "tr_pct": -20.0}, {"year": 2003, "tr_nav": 0.3}]),
        doc(ticker="liq", last_trading_day="2002-06-30", years=years(0.5, 0.1), partial_periods=[{"period": "2002-01-01..2002-06-30", "tr_nav": -0.4}]),
        doc(ticker="stub", liquidation_date="2002-06-30", years=years(0.5, 0.1), partial_periods=[{"period": "2002-01-01..2002-03-31", "tr_pct": -40.0}]),
        doc(ticker="paid", last_trading_day="2002-03-01", years=years(0.5, 0.1), cash_ladder={"reference_day": "2001-12-31", "nav": 20.0, "distributions": 8.0, "residual": 1.0}),
        doc(ticker="halt", last_trading_day="2002-03-01", years=years(0.5, 0.1, -0.9), cash_ladder={"nav": None, "implied_nav": 10.0, "distributions": 4.0}),
        doc(ticker="none", last_trading_day="2002-03-01"),
    ]
    f = funds.funds(spark.createDataFrame(docs, "doc string"))
    kinds = {(r["ticker"], r["year"]): r["kind"] for r in funds.ladder(f).where("kind <> 'calendar_year'").collect()}
    assert kinds == {("liq", 2002): "liquidation", ("stub", 2002): "partial"}
    windows = spark.createDataFrame([(2000, 2003)], "first int, last int")
    got = {r["ticker"]: (round(r["gross"], 9), r["n_open"], r["state"]) for r in funds.compounded(f, windows).collect()}
    assert got == {
        "runs": (round(1.1 * 0.8 * 1.3, 9), 0, "running"), "open": (round(0.8 * 1.3, 9), 1, "incomplete"), "pct": (round(1.1 * 0.8 * 1.3, 9), 0, "running"),
        "liq": (round(1.1 * 0.6, 9), 0, "liquidated"), "stub": (round(1.1 * 0.6, 9), 1, "incomplete"), "paid": (round(1.1 * 0.45, 9), 0, "liquidated"),
        "halt": (round(1.1 * 0.1, 9), 1, "incomplete"), "none": (1.0, 2, "incomplete"),
    }
    row = funds.gap_sensitivity(f, windows).collect()
    mean = np.mean([v[0] for v in got.values()])
    assert len(row) == 1 and row[0]["ticker"] == "halt" and row[0]["mark"] == pytest.approx(0.11) and row[0]["recovered"] == pytest.approx(1.1 * 0.4)
    assert row[0]["basket_alt"] == pytest.approx(np.log(mean + (0.44 - 0.11) / 8) / 3)
    with pytest.raises(Exception, match="MALFORMED|malformed"):
        funds.funds(spark.createDataFrame([("{not json",)], "doc string")).collect()


def test_triplets_fill_quotas_evenly(spark):
    rows = [r.asDict() for r in QUERIES["triplet_items"](spark, SF).collect()]
    first = [r for r in rows if r["duplicate_of"] is None]
    assert len({r["entity"] for r in first}) == len(first)
    assert all((r["e1"], r["y1"]) != (r["e2"], r["y2"]) and r["entity"] not in (r["e1"], r["e2"]) for r in first)
    by = {r["item"]: r for r in rows}
    for r in rows:
        if r["duplicate_of"] is not None:
            o = by[r["duplicate_of"]]
            assert r["item"] - o["item"] >= 6 and o["left"] != r["left"] and all(r[c] == o[c] for c in ("stratum", "entity", "m1", "m2", "e1", "e2"))
    for s, quota in (("visual", 4), ("numeric", 8), ("opposite", 8)):
        own = [r for r in first if r["stratum"] == s]
        assert len(own) == quota
    # the same whatever the partitioning
    from shapewright.operators import corpus as C

    p = C.profiles(spark, SF)
    strata = {"numeric": (False, [("l2", "w1sex"), ("blend", "hel"), ("hel", "l2")])}
    def pick(n):
        got = triplets.disagreements(triplets.extremes(p.where("year = 1998").repartition(n), p.repartition(n)), strata)
        return sorted(tuple(r) for r in triplets.chosen(got, {"numeric": 7}, {"numeric": 3}, 3, 5).collect())
    one = pick(1)
    assert one == pick(9) and len(one) == 7
    uses = [sum(r[2:4] == pair for r in one) for pair in strata["numeric"][1]]
    assert max(uses) - min(uses) <= 1
