"""Blobs, panel regressions and blocks met by blocks on small fixtures, against plain versions."""

import gzip

import numpy as np
import pytest
from pyspark.sql import functions as F

from shapewright.operators import blocks, codec, panel
from shapewright.operators import search as S


def trajectory(n, width, seed=0):
    r = np.random.default_rng(seed)
    u = r.integers(0, 1 << 16, (n, width))
    u[0], u[1 % n], u[2 % n] = 0, 65535, 0
    return u.astype(np.uint16)


@pytest.mark.parametrize("n,width", [(1, 1), (2, 3), (7, 42), (151, 20)])
def test_blob_round_trip_with_extremes(n, width):
    u = trajectory(n, width)
    blob = codec.encode(u)
    assert blob[:2] == b"\x1f\x8b" and blob == codec.encode(u.copy())
    assert (codec.decode(blob, n, width) == u).all() and (codec.decode(gzip.decompress(blob), n, width) == u).all()
    for rows, columns in ((n + 1, width), (n, width + 1)):
        with pytest.raises(ValueError):
            codec.decode(blob, rows, columns)


def test_deltas_wrap_and_low_bytes_come_first():
    u = np.array([[0x0102, 0x0304], [0x0101, 0x0304]], np.uint16)
    assert codec.deltas(u).tolist() == [[0x0102, 0x0304], [0xFFFF, 0]]
    assert gzip.decompress(codec.encode(u)) == bytes([2, 4, 0xFF, 0, 1, 3, 0xFF, 0])
    assert codec.zigzag(np.array([0, 1, 0xFFFF, 2, 0xFFFE, 0x7FFF, 0x8000], np.uint16)).tolist() == [0, 2, 1, 4, 3, 65534, 65535]


def test_packed_files_and_refusals(spark, tmp_path):
    rows = [(e, 1990 + y, trajectory(9, 5, e)[y].tolist()) for e in range(6) for y in range(9) if (e, y) != (2, 4)]  # one has a gap
    df = spark.createDataFrame(rows, "entity int, year int, u array<int>").repartition(4)
    codec.write_packed(df, str(tmp_path / "p"), 3)
    key = lambda x: sorted((r["entity"], r["year"], tuple(r["u"])) for r in x.collect())
    assert key(codec.read_packed(spark, str(tmp_path / "p"))) == key(df)
    assert key(codec.read_packed(spark, str(tmp_path / "p"), [2, 5], 1993, 1995)) == key(df.where("entity IN (2, 5) AND year BETWEEN 1993 AND 1995"))
    assert key(codec.read_packed(spark, str(tmp_path / "p"), [77])) == [] and codec.pack(df.limit(0)).count() == 0
    for bad in ([(0, 1, [1]), (0, 1, [2])], [(0, 1, [1]), (0, 2, [1, 2])], [(0, 1, [65536])], [(0, 1, [-1])]):
        with pytest.raises(Exception, match="trajectory|16 bits"):
            codec.pack(spark.createDataFrame(bad, "entity int, year int, u array<int>")).collect()
    smooth = spark.createDataFrame([(0, y, [1000 + 3 * y + i for i in range(40)]) for y in range(150)], "entity int, year int, u array<int>")
    size = {r["layout"]: r["n_compressed"] for r in codec.layout_report(smooth).collect()}
    assert size["delta"] < size["raw"] and size["transposed"] == len(codec.encode(np.array([[1000 + 3 * y + i for i in range(40)] for y in range(150)], np.uint16)))


def test_half_floats(spark):
    values = [[0.0, -0.0, 1.0, 65504.0, 6e-8, -3.14159, 1e-4], None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v array<double>")
    got = codec.from_half(codec.to_half(df, "v", "h"), "h", "b", 7).orderBy("i").collect()
    assert got[0]["b"] == [float(np.float16(x)) for x in values[0]] and got[1]["b"] is None
    with pytest.raises(Exception, match="half floats"):
        codec.from_half(codec.to_half(df, "v", "h"), "h", "b", 6).collect()


def panel_rows(n=400, seed=1):
    r = np.random.default_rng(seed)
    out = []
    for i in range(n):
        region, t = int(r.integers(4)), int(r.integers(8))
        a, b = r.normal() + region, r.normal()
        out.append((i % 25, t, region, t // 2, float(a), float(b), float(0.7 * a - 0.3 * b + region * 0.5 + (t // 2) * 0.1 + r.normal() * 0.2)))
    return out


def dummies(rows, cells):
    return np.array([[r[4], r[5], *[float((r[2], r[3]) == c) for c in cells]] for r in rows])


def test_absorbed_effects_equal_dummies(spark):
    rows = panel_rows()
    df = spark.createDataFrame(rows, "e int, t int, region int, block int, a double, b double, y double").repartition(5)
    cells = sorted({(r[2], r[3]) for r in rows})
    x, y = dummies(rows, cells), np.array([r[6] for r in rows])
    beta = np.linalg.lstsq(x, y, rcond=None)[0]
    fit = panel.fitted(df, "y", ["a", "b"], ["region", "block"])
    assert np.allclose(fit.beta, beta[:2]) and fit.n == len(rows) and fit.n_cells == len(cells)
    u = y - x @ beta
    assert fit.r2 == pytest.approx(1 - (u @ u) / ((y - y.mean()) ** 2).sum())
    got = {(r["region"], r["block"]): r["effect"] for r in panel.effects(df, fit, "y", ["region", "block"]).collect()}
    assert np.allclose([got[c] for c in cells], beta[2:])
    # two-way clustered standard errors with all dummies in the design
    inverse = np.linalg.inv(x.T @ x)
    meat = 0
    for sign, key in ((1, lambda r: r[0]), (1, lambda r: r[1]), (-1, lambda r: r[:2])):
        for k in {key(r) for r in rows}:
            s = sum(x[i] * u[i] for i, r in enumerate(rows) if key(r) == k)
            meat = meat + sign * np.outer(s, s)
    spec = panel.spec_rows(df, "y", {"S": ["a", "b"]}, ["region", "block"], "e", "t", 2)
    assert np.allclose([r[4] for r in spec], np.sqrt(np.maximum(np.diag(inverse @ meat @ inverse)[:2], 0)))


def test_holdout_carries_the_latest_effect(spark):
    rows = [r for r in panel_rows() if not (r[2] == 3 and r[1] < 5)]  # a region that the fit has not seen
    df = spark.createDataFrame(rows, "e int, t int, region int, block int, a double, b double, y double")
    train, test = [r for r in rows if r[1] <= 4], [r for r in rows if r[1] >= 6 and r[2] != 3]
    cells = sorted({(r[2], r[3]) for r in train})
    beta = np.linalg.lstsq(dummies(train, cells), np.array([r[6] for r in train]), rcond=None)[0]
    last = {g: max(c[1] for c in cells if c[0] == g) for g in range(3)}
    want = sorted((r[6], r[4] * beta[0] + r[5] * beta[1] + beta[2 + cells.index((r[2], last[r[2]]))]) for r in test)
    out = panel.held_out(df, "y", {"S": ["a", "b"]}, "region", "block", F.col("t") <= 4, F.col("t") >= 6)
    got = sorted((r["y"], r["pred_S"]) for r in out.collect())
    assert np.allclose(got, want)
    import pandas as pd

    rho = {r["t"]: r["rho"] for r in panel.rank_correlations(out, F.col("pred_S"), F.col("y"), "t").collect()}
    for t in (6, 7):
        own = [(r["y"], r["pred_S"]) for r in out.where(F.col("t") == t).collect()]
        assert rho[t] == pytest.approx(pd.DataFrame(own).rank().corr().iloc[0, 1])


def test_blocks_meet_once(spark):
    """Every pair of rows is compared once, whatever the blocks."""
    import pyarrow as pa

    a, b = spark.range(37).withColumnRenamed("id", "a"), spark.range(91).withColumnRenamed("id", "b")

    def cross(x, y):
        i, j = np.meshgrid(x.column("a").to_numpy(), y.column("b").to_numpy())
        return pa.RecordBatch.from_arrays([pa.array(i.ravel()), pa.array(j.ravel())], names=["a", "b"])

    for asked, held in ((5, 10), (100, 1000), (1, 91)):
        got = blocks.met(a, b, cross, "a long, b long", ["a"], ["b"], asked, held).collect()
        assert len(got) == 37 * 91 == len(set(map(tuple, got)))
    assert blocks.met(a.limit(0), b, cross, "a long, b long", ["a"], ["b"]).count() == 0
    assert blocks.met(a, b.limit(0), cross, "a long, b long", ["a"], ["b"]).count() == 0


def test_a_worker_holds_few_blocks(spark):
    """What two blocks keep in a worker does not grow with the pairs of blocks that it compares."""
    import pyarrow as pa
    from pyspark.sql import functions as F

    rows = lambda n, name: spark.range(n).select(F.col("id").alias(name), F.transform(F.sequence(F.lit(1), F.lit(64)), lambda x: x + F.rand(1)).alias("v"))

    def watched(x, y):
        return pa.RecordBatch.from_arrays([pa.array([k]) for k in (len(x) * len(y), len(x), len(y), x.get_total_buffer_size() + y.get_total_buffer_size())], names=["n", "a", "b", "held"])

    got = blocks.met(rows(12_000, "a"), rows(30_000, "b"), watched, "n long, a long, b long, held long", ["a"], ["b"], 128, 1024).agg(F.sum("n"), F.max("a"), F.max("b"), F.max("held")).first()
    assert got[0] == 12_000 * 30_000 and got[1] < 256 and got[2] < 2048 and got[3] < 8 << 20, got


def test_groups_that_ask_are_bounded(spark):
    """With one pair of groups, or many rows that ask, every pair of rows still meets once, and rows of one key stay in one block."""
    import pyarrow as pa
    from pyspark.sql import functions as F

    a, b = spark.range(3000).withColumnRenamed("id", "a"), spark.range(600).select(F.col("id").alias("b"), (F.col("id") % 7).alias("k"))

    def counted(x, y):
        keys = np.unique(y.column("k").to_numpy())
        return pa.RecordBatch.from_arrays([pa.array([len(x) * len(y)]), pa.array([keys.tolist()], pa.list_(pa.int64()))], names=["n", "keys"])

    out = blocks.met(a, b, counted, "n long, keys array<long>", ["a"], ["k"], 10, 4)
    assert out.agg(F.sum("n")).first()[0] == 3000 * 600
    met = out.select(F.explode("keys").alias("k")).groupBy("k").count().select("count").distinct().collect()
    assert len(met) == 1  # every key meets each block that asks in one block


def test_soft_minima_over_blocks(spark, monkeypatch):
    r = np.random.default_rng(3)
    c = np.round(r.random((60, 20)), 2)
    c[5] = c[6]
    df = spark.createDataFrame([(i, 1990, v.tolist()) for i, v in enumerate(c)], "entity int, year int, c array<double>")
    monkeypatch.setattr(S, "HELD", 4)
    got = {x["entity"]: x for x in S.soft_minima(df, df.where("entity < 30")).collect()}
    d = 5 * np.abs(c[:, None] - c[None, :30]).sum(axis=2)
    for i in range(60):
        two = np.sort(d[i])[:2]
        assert np.allclose((got[i]["least"], got[i]["second"], got[i]["soft"]), (*two, two[0] - 0.25 * np.log(np.exp(-(d[i] - two[0]) / 0.25).sum())))
    assert S.soft_minima(df, df.where("entity = 3")).where("entity = 4").first()["second"] is None


def test_both_sides_of_a_large_search_are_sent_about_as_often(spark):
    sizes = [(10**7, 10**9, 16_000), (10, 10, 16), (1, 10**6, 16), (10**6, 1, 16), (0, 5, 16), (5, 0, 16), (175, 175, 16)]
    df = spark.createDataFrame(sizes, "a long, h long, p int")
    for a, h, pairs in sizes:
        g = blocks.grid(F.col("a"), F.col("h"), 1024, 8192, pairs)
        r = df.where((F.col("a") == a) & (F.col("h") == h)).select(*[c.alias(n) for n, c in g.items()]).first()
        assert 1 <= r["held_groups"] <= r["held_blocks"] and 1 <= r["asked_groups"] <= r["asked_blocks"]
        assert r["held_groups"] <= max(1, h) and r["asked_groups"] <= max(1, a)
        if a > 10**5 and h > 10**5:
            sent = (a * r["held_groups"], h * r["asked_groups"])
            assert max(sent) < 1.2 * min(sent) and sum(sent) < 30 * h and r["held_groups"] * r["asked_groups"] >= pairs
            assert r["held_blocks"] >= h / 8192 and r["asked_blocks"] >= a / 1024
