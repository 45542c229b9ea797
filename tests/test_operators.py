"""Properties of operators on small fixtures."""

import pytest
from pyspark.sql import functions as F

from shapewright import session
from shapewright.functions import text, vec
from shapewright.operators import corpus as C
from shapewright.operators import metrics as M
from shapewright.operators import relational as R
from shapewright.operators import search as S
from shapewright.operators import series as T
from shapewright.operators import stats as St
from shapewright.sources import files

COUNTS = [(e, y, b, s, float((e * 7 + y * 3 + b * 5 + len(s)) % 11 + (s == "F"))) for e in range(4) for y in (1995, 1996, 1997) for b in range(10) for s in ("O", "F") if (e + b) % 4]


@pytest.fixture(scope="module")
def profiles(spark):
    return C.vectors(C.dense(spark.createDataFrame(COUNTS, "entity int, year int, bin int, side string, pop double"))).cache()


def test_dense_fills_all_cells(spark, profiles):
    assert {r[0] for r in profiles.select(F.size("s")).collect()} == {20}
    assert all(abs(r[0] - 1) < 1e-12 for r in profiles.select(vec.total(F.col("s"))).collect())


@pytest.mark.parametrize("name", sorted(M.METRICS))
def test_distances_are_symmetric_and_zero_on_themselves(profiles, name):
    p = M.prepared(profiles)
    met = C.pairs(p, p, F.lit(True), [*S.FIELDS, "sm", "sq", "clr"]).select("entity", "year", "b_entity", "b_year", M.distance(name).alias("d"))
    d = {tuple(r[:4]): r[4] for r in met.collect()}
    for (e, y, f, z), v in d.items():
        assert v > -1e-9 and abs(v - d[f, z, e, y]) < 1e-9
        assert (e, y) != (f, z) or abs(v) < 1e-9


def test_unknown_names_are_refused():
    with pytest.raises(ValueError):
        M.distance("nothing")
    with pytest.raises(ValueError):
        S.Query(mode="never")


def test_range_is_swapped():
    assert (S.Query("range", first=2000, last=1990).first, S.Query("range", first=2000, last=1990).last) == (1990, 2000)


def test_own_entity_is_no_candidate_and_dedupe_keeps_one_year(profiles):
    found = S.similar(profiles, S.Query("any"), 10).collect()
    assert all(r["entity"] != r["b_entity"] for r in found)
    assert len({(r["entity"], r["year"], r["b_entity"]) for r in found}) == len(found)


def test_mmr_without_diversity_is_farthest(profiles):
    a = {(r["entity"], r["year"], r["b_entity"]) for r in S.diversified(profiles, S.Query(), 2, 0.0).collect()}
    assert a == {(r["entity"], r["year"], r["b_entity"]) for r in S.different(profiles, S.Query(), 2).collect()}


def test_quantised_sums_and_round_trip(spark):
    q = C.quantised(C.shares(C.dense(spark.createDataFrame(COUNTS, "entity int, year int, bin int, side string, pop double"))))
    assert {r[0] for r in q.groupBy("entity", "year").agg(F.sum("u").alias("u")).select("u").collect()} == {C.FULL}
    coded = C.deltas(q)
    assert {tuple(r) for r in C.undeltas(coded.drop("u")).select("entity", "year", "pos", "u").collect()} == {tuple(r) for r in q.select("entity", "year", "pos", "u").collect()}


def test_remap_counts_orphans_and_refuses_unexpected(spark):
    rows, known = spark.createDataFrame([("A", 1990), ("B", 1991), ("B", 1995)], "code string, year int"), spark.createDataFrame([("A",)], "k string")
    good, bad = R.remap(rows, "code", known, "k")
    assert [tuple(r) for r in bad.collect()] == [("B", 2, 1991, 1995)] and good.count() == 1
    with pytest.raises(ValueError):
        R.remap(rows, "code", known, "k", expected=("C",))


def test_as_of_takes_equal_times_and_none_before(spark):
    a = spark.createDataFrame([("x", 5), ("x", 1)], "k string, t int")
    b = spark.createDataFrame([("x", 5, 2.0), ("x", 3, 1.0)], "k string, u int, v double")
    assert sorted((r["t"], r["as_of_value"]) for r in R.as_of(a, b, ["k"], "t", "u", "v").collect()) == [(1, None), (5, 2.0)]


def test_splice_stops_at_the_first_gap(spark):
    rows = [(1, 2000, 10.0, 1.0, None), (1, 2001, None, 2.0, None), (1, 2002, None, None, None), (1, 2003, None, 5.0, None)]
    out = {r["year"]: r["level"] for r in T.spliced(spark.createDataFrame(rows, "entity int, year int, base double, w1 double, w2 double")).collect()}
    assert out[2001] == pytest.approx(20.0) and out[2002] is None and out[2003] is None


def test_statistics(spark):
    assert St.sign_test(8, 0) == pytest.approx(2 / 256) and St.sign_test(0, 0) == 1.0
    assert St.normal_p(1.959964) == pytest.approx(0.05, abs=1e-6)
    assert St.long_run_variance([1.0, 2.0, 3.0, 4.0], 0) == pytest.approx(1.25)
    rows = spark.createDataFrame([(float(i), 2.0 * i + 1, i % 3) for i in range(12)], "x double, y double, c int")
    fit = St.clustered_ols(rows, "y", ["x"], "c")
    assert fit[0][0] == pytest.approx(1.0) and fit[1][0] == pytest.approx(2.0) and fit[1][1] < 1e-6


def test_fuzzy_tiers(spark):
    names = ["JAPAN", "japanese", "new japan", "the xjapanx", "jxaxpxaxn", "peru"]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "n string").select(text.fuzzy_score(F.lit("japan"), F.col("n"))).collect()]
    assert got[:4] == [100, 80, 70, 40] and 10 <= got[4] < 20 and got[5] is None


def test_slug(spark):
    assert spark.createDataFrame([("  Côte d'Ivoire!",)], "n string").select(text.slug(F.col("n"))).first()[0] == "cote-d-ivoire"


def test_population_keeps_the_code_na(spark, tmp_path):
    path = tmp_path / "p.csv"
    path.write_text("LocID,Location,ISO3_code,LocTypeName,Time,AgeGrpStart,PopMale,PopFemale\n516,Namibia,NA,Country,2000,0,1.5,1.4\n900,World,,,2000,0,9,9\n")
    assert [(r["iso3"], r["pop_male"]) for r in files.population(spark, str(path)).collect()] == [("NA", 1.5)]


def test_indicators_pages_and_manifest(spark, tmp_path):
    (tmp_path / "i.csv").write_text("LocID,Time,TFR\n4,2024,4.8\n4,1900,9\n4,2020,x\n4,2019,5\n")
    got = sorted((r["year"], r["value"], r["is_forecast"]) for r in files.indicators(spark, str(tmp_path / "i.csv"), {"tfr": "TFR"}).collect())
    assert got == [(2019, 5.0, False), (2024, 4.8, True)]
    (tmp_path / "p.json").write_text('[{"page":1},[{"countryiso3code":"FRA","date":"2001","value":2.5,"indicator":{"id":"G"}},{"countryiso3code":"EUU","date":"2001","value":1.0,"indicator":{"id":"G"}}]]\n')
    agg = spark.createDataFrame([("EUU",)], "code string")
    assert [tuple(r) for r in files.json_pages(spark, str(tmp_path / "p.json"), agg).collect()] == [("FRA", 2001, "G", 2.5)]
    m = files.manifest(spark, str(tmp_path))
    assert m.count() == 2 and files.changed(m, m).count() == 0


def test_shards_and_results(spark, tmp_path):
    rows = spark.createDataFrame([(1, 2000, 0.12345678), (2, 2001, 1.0)], "entity int, year int, v double")
    files.write_shards(rows, str(tmp_path / "s"), "year")
    assert files.read_shard(spark, str(tmp_path / "s"), "year", 2001).count() == 1
    files.write_results(rows, str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).where("entity = 1").first()["v"] == "0.123457"


def test_console_reads_only(spark):
    assert session.console(spark, "/root/testdata/sf0.001", "select count(*) as n from nation").first()["n"] == 25
    with pytest.raises(ValueError):
        session.console(spark, "/root/testdata/sf0.001", "drop table nation")


def test_totals_before_and_average_ranks(spark):
    import numpy as np

    from pyspark.sql import functions as F

    from shapewright.operators import stats as St

    rng = np.random.default_rng(3)
    values = rng.integers(0, 400, 3000).tolist()
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, v long")
    got = {r["i"]: r["r"] for r in St.average_ranks(frame, "v", "r").collect()}
    order = np.sort(values)
    assert got == {i: (np.searchsorted(order, v) + np.searchsorted(order, v, side="right") + 1) / 2 for i, v in enumerate(values)}
    before = {r["i"]: r["before"] for r in St.totals_before(frame, "i", F.col("v")).collect()}
    assert before == dict(enumerate([0, *np.cumsum(values)[:-1].tolist()]))
    assert St.totals_before(frame.limit(0), "i", F.col("v")).count() == 0


def test_scans_equal_joins(spark):
    from conftest import SF

    from shapewright.operators import corpus as C
    from shapewright.operators import search as S

    p = C.profiles(spark, SF)
    for q, far in ((S.Query("any"), False), (S.Query("any"), True), (S.Query("today"), False), (S.Query("range", first=1996, last=1998), False), (S.Query("any", era_cut=1998), False), (S.Query("any", trend=2, floor=100.0), True), (S.Query("near", n=2), False)):
        want = S.best_of_entity(S.matches(p, q), far).select("entity", "year", "b_entity", "b_year", "dy", "d")
        got = S.best_of_entity(S.scanned(p, q, far).drop("lo", "hi"), far)
        rows = lambda f: sorted(tuple(r) for r in f.select(want.columns).collect())
        assert rows(got) == rows(want)
    few = S.scanned(p, S.Query("any"), queries=p.where("entity = 3"))
    assert {r["entity"] for r in few.select("entity").distinct().collect()} == {3}


def test_kept_cells_follow_their_tables(spark, tmp_path):
    from conftest import SF

    from shapewright.operators import corpus as C

    folder = str(tmp_path)
    for name in ("lineitem", "orders", "customer"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"{folder}/{name}.parquet")
    first = C.cells(spark, folder)
    total = first.agg({"pop": "sum"}).first()[0]
    assert C.cells(spark, folder) is first and first.is_cached
    spark.read.parquet(f"{SF}/lineitem.parquet").where("l_quantity > 10").write.mode("overwrite").parquet(f"{folder}/lineitem.parquet")
    assert 0 < C.cells(spark, folder).agg({"pop": "sum"}).first()[0] < total
    kept = C.cells(spark, folder)
    C.forget(spark, folder)
    assert not kept.storageLevel.useMemory
