"""The store's refresh, exported files, archived revisions and draws on small fixtures."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from shapewright.operators import stats as St
from shapewright.operators import vintage as V
from shapewright.sources import export, store


def tables():
    doubled = lambda t: t["rows"].select("part", "k", (F.col("v") * 2).alias("w"))
    capped = lambda t: t["doubled"].groupBy("part").agg(F.least(F.max("w"), F.lit(10)).alias("top"))
    total = lambda t: t["capped"].agg(F.lit("x").alias("part"), F.sum("top").alias("sum"))
    return [store.Derived("total", "part", total, whole=("capped",)), store.Derived("capped", "part", capped, ("doubled",)), store.Derived("doubled", "part", doubled, ("rows",))]


def test_refresh_rewrites_what_changed(spark, tmp_path):
    path = str(tmp_path / "s")
    frame = lambda rows: spark.createDataFrame(rows, "part string, k int, v int")
    rows = [("a", 1, 1), ("a", 2, 3), ("b", 1, 7), ("b", 1, 7), (None, 5, 2)]
    run = lambda r: {(n, p): s for n, p, s in store.refresh(spark, path, {"rows": (frame(r).where("part IS NOT NULL"), "part")}, tables())}
    assert set(run(rows).values()) == {"written"}
    assert set(run(rows[::-1]).values()) == {"kept"}  # the same rows in another order
    assert store.manifest_path(spark, path)[0] == 1
    changed = run([("a", 1, 1), ("a", 2, 4), *rows[2:]])
    assert changed == {("doubled", "a"): "written", ("doubled", "b"): "kept", ("capped", "a"): "written", ("capped", "b"): "kept", ("total", "all"): "written"}
    assert store.read(spark, path, "total").first()["sum"] == 8 + 10
    # b changes, its capped value does not, so the total stays
    assert run([("a", 1, 1), ("a", 2, 4), ("b", 1, 9)]) == {("doubled", "a"): "kept", ("doubled", "b"): "written", ("capped", "a"): "kept", ("capped", "b"): "written", ("total", "all"): "kept"}
    gone = run([("a", 1, 1), ("a", 2, 4)])
    assert gone["doubled", "b"] == gone["capped", "b"] == "removed" and store.read(spark, path, "total").first()["sum"] == 8
    assert sorted(r["w"] for r in store.read(spark, path, "doubled").collect()) == [2, 8]
    held = store.read(spark, path, "doubled").count()
    assert store.swept(spark, path) > 3 and store.read(spark, path, "doubled").count() == held and run([("a", 1, 1), ("a", 2, 4)])["doubled", "a"] == "kept"
    with pytest.raises(ValueError, match="each other"):
        store.ordered([store.Derived("x", "p", None, ("y",)), store.Derived("y", "p", None, ("x",))], set())


def test_a_failed_refresh_leaves_the_store(spark, tmp_path):
    path = str(tmp_path / "s")
    good = spark.createDataFrame([("a", 1, 1)], "part string, k int, v int")
    store.refresh(spark, path, {"rows": (good, "part")}, tables())
    broken = tables()[:2] + [store.Derived("doubled", "part", lambda t: t["rows"].select("part", "k", F.raise_error(F.lit("no")).cast("int").alias("w")), ("rows",))]
    with pytest.raises(Exception, match="no"):
        store.refresh(spark, path, {"rows": (good.withColumn("v", F.lit(9)), "part")}, broken)
    assert [r["w"] for r in store.read(spark, path, "doubled").collect()] == [2]


@pytest.mark.parametrize("n", [0, 1, 7, 93, 94, 95, 930, 1240, 12_400])
def test_a_file_holds_its_own_size(n):
    blob = export.packed({"title": "x"}, {"a": np.arange(n, dtype="<f8"), "b": np.arange(3, dtype="<i2")})
    header, arrays = export.unpacked(blob)
    assert header["size"] == len(blob) and arrays["a"].tolist() == list(range(n)) and arrays["b"].tolist() == [0, 1, 2]
    with pytest.raises(ValueError, match="says"):
        export.unpacked(blob + b"\0")


def test_export_guards_and_nulls(spark):
    df = spark.createDataFrame([("p", 2, None, 5), ("p", 1, 1.5, None), ("secret", 1, 2.0, 1)], "part string, at int, x double, y int")
    files = export.exported(df, "part", ["at"], ["at", "x", "y"], "t")
    got = {r["part"]: export.unpacked(r["blob"])[1] for r in files.collect()}
    assert got["p"]["at"].tolist() == [1, 2] and np.isnan(got["p"]["x"][1]) and got["p"]["y"].tolist() == [-(2**31), 5]
    assert {r["name"][:2] for r in files.collect()} == {"t."} and len({r["name"] for r in files.collect()}) == 2
    assert {r["what"] for r in export.violations(files, F.lit(10), 20).collect()} == {"part p", "part secret", "total"} and export.violations(files, F.lit(10_000), 20_000).count() == 0
    with pytest.raises(Exception, match="must not be exported"):
        export.exported(df, "part", ["at"], ["at"], "t", "secret").collect()


def test_ladders_of_other_widths(spark):
    rows = [("short", b, 10.0 + b) for b in range(4)] + [("same", b, 1.0) for b in range(6)] + [("long", b, 2.0) for b in range(9)]
    out = V.realigned(spark.createDataFrame(rows, "rev string, bin int, pop double"), "rev", 5).collect()
    got = {r["rev"]: sorted((x["bin"], x["pop"]) for x in out if x["rev"] == r["rev"]) for r in out}
    assert got["short"] == [(b, 10.0 + b) for b in range(4)] and got["same"] == [(b, 1.0) for b in range(6)] and got["long"] == [(b, 2.0) for b in range(5)] + [(5, 8.0)]
    for bad in ([("x", 1, 1.0)], [("x", 0, 1.0), ("x", 2, 1.0)]):
        with pytest.raises(ValueError, match="irregular"):
            V.realigned(spark.createDataFrame(bad, "rev string, bin int, pop double"), "rev", 5)


def test_predecessors_stand_in_for_the_absent_only(spark):
    codes = spark.createDataFrame([(1, 5), (1, 90), (1, 91), (1, 92), (2, 90), (2, 95)], "revision int, code int")
    entities = spark.createDataFrame([(5, 50), (6, 60), (7, 70)], "code int, entity int")
    older = spark.createDataFrame([(90, 50), (91, 60), (92, 60), (95, 70)], "code int, entity int")
    got = {(r["revision"], r["code"]): (r["entity"], r["via"]) for r in V.mapped(codes, entities, older).collect()}
    assert got == {(1, 5): (50, "own"), (1, 90): (None, None), (1, 91): (60, "predecessor"), (1, 92): (None, None), (2, 90): (50, "predecessor"), (2, 95): (70, "predecessor")}


def test_what_was_known_at_an_origin(spark):
    slices = spark.createDataFrame([(10, 9), (10, 10), (12, 10), (12, 14)], "revision int, year int")
    got = sorted(tuple(r) for r in V.known_at(slices, spark.createDataFrame([(9,), (10,), (11,), (12,), (20,)], "t int")).collect())
    assert got == [(10, 10, 10), (11, 10, 10), (12, 12, 10), (20, 12, 14)]


def test_continuity_of_ranks(spark):
    r = np.random.default_rng(2)
    now, then = np.round(r.random(30), 2), np.round(r.random(30), 2)
    df = spark.createDataFrame([(1, i, float(a), float(b)) for i, (a, b) in enumerate(zip(now, then, strict=True))] + [(1, 99, None, 0.1)], "t int, e int, now double, then double")
    row = V.continuity(df, ["t"], "e", "now", "then", 6).first()
    p = pd.DataFrame({"a": now, "b": then})
    first = lambda c: p[c].rank(method="first")
    top = first("a") <= 6
    assert row["n"] == 30 and row["rho"] == pytest.approx(p.rank().corr().iloc[0, 1])
    assert row["median_rank"] == first("b")[top].median() and row["max_rank"] == first("b")[top].max()
    both = int((top & (first("b") <= 6)).sum())
    assert row["within_k"] == both and row["within_2k"] == int((top & (first("b") <= 12)).sum()) and row["jaccard"] == pytest.approx(both / (12 - both))


def test_draws_are_distinct_and_even(spark):
    rows = spark.createDataFrame([(g, i, float(i)) for g, n in ((1, 5), (2, 2), (3, 1)) for i in range(n)], "g int, i int, v double")
    out = St.draws_of(rows, ["g"], "i", "v", 3, 2000, 4).toPandas()
    sizes = out.groupby(["draw", "g"]).v.agg(["count", "nunique"])
    assert (sizes["count"] == sizes["nunique"]).all() and sizes["count"].unstack().drop_duplicates().values.tolist() == [[3, 2, 1]]
    share = out[out.g == 1].groupby("v").size() / 2000
    assert ((share - 0.6).abs() < 0.04).all()  # three of five
    pairs = out[out.g == 1].groupby("draw").v.apply(lambda v: tuple(sorted(v))).value_counts() / 2000
    assert len(pairs) == 10 and (pairs - 0.1).abs().max() < 0.03
