"""Queries do the whole job: all rows, all hits, all components, held against plain Python over the tables."""

import hashlib
import re
import unicodedata
from collections import Counter

import numpy as np
from conftest import SF

from shapewright.plans import QUERIES
from shapewright.plans.evaluation import DENY


def table(duck, sql):
    return duck.execute(sql).fetchall()


def test_deny_list_returns_every_occurrence(spark, duck):
    want = Counter()
    for doc, text in table(duck, "select doc_id, text from documents"):
        for w in DENY:
            for m in re.finditer(re.escape(w), text or "", re.IGNORECASE):
                a = max(m.start() - 30, 0)
                want[doc, w, text[a : a + len(w) + 60]] += 1
    got = Counter((r["doc_id"], r["word"], r["context"]) for r in QUERIES["deny_list_hits"](spark, SF).collect())
    assert got == want
    assert max(Counter((doc, w) for doc, w, _ in want.elements()).values()) > 1  # some text has a word twice


def test_slugs_cover_whole_texts(spark, duck):
    plain = lambda t: "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)).lower()
    latin = {i: t for i, t in table(duck, "select doc_id, text from documents") if t is not None and all(ord(c) < 256 or not c.isalnum() for c in t)}
    got = {r["doc_id"]: r["slug"] for r in QUERIES["slugify"](spark, SF).collect()}
    assert len(got) == len(table(duck, "select doc_id from documents")) and latin
    assert {i: got[i] for i in latin} == {i: re.sub("[^a-z0-9]+", "-", plain(t)).strip("-") for i, t in latin.items()}
    assert max(len(got[i]) for i in latin) > 80


def test_moments_cover_all_components(spark, duck):
    x = np.array([r[0] for r in table(duck, "select embedding from embeddings")], float)
    got = {(r["i"], r["j"]): r["cov"] for r in QUERIES["embedding_moments"](spark, SF).collect()}
    want = np.cov(x.T, bias=True)
    assert set(got) == {(i + 1, j + 1) for i in range(x.shape[1]) for j in range(i, x.shape[1])}
    assert all(abs(got[i, j] - want[i - 1, j - 1]) < 2e-6 for i, j in got)


def test_pairs_of_all_entities_are_explained(spark, duck):
    from shapewright.operators import corpus as C
    from shapewright.plans.profile import TABLED

    years = {}
    for e, y in C.cells(spark, SF).select("entity", "year").distinct().collect():
        years.setdefault(y, set()).add(e)
    pairs = {(a, y, b) for y, es in years.items() for a in es for b in es if a != b}
    key = lambda r: (r["entity"], r["year"], r["b_entity"])
    run = lambda name: QUERIES[name](spark, SF).collect()
    assert Counter(map(key, run("explain_alike_differs"))) == Counter(pairs)
    assert Counter(map(key, run("decompose_top_bins"))) == Counter({p: 3 for p in pairs})
    shown = run("pair_feature_table")
    assert len(TABLED) == 8 and Counter((*key(r), r["feature"]) for r in shown) == Counter((*p, f) for p in pairs for f in TABLED)
    back = {(*key(r), r["feature"]): r for r in shown}
    assert all((r["a"], r["b"]) == (back[b, y, a, f]["b"], back[b, y, a, f]["a"]) for (a, y, b, f), r in back.items())
    near = {}
    for r in run("dist_blend"):
        near.setdefault((r["entity"], r["year"]), []).append((r["d"], r["b_entity"]))
    ranks = {}
    for (a, _), found in near.items():
        for rank, (_, b) in enumerate(sorted(found), 1):
            ranks.setdefault((a, b), []).append(rank)
    got = {(r["entity"], r["b_entity"]): (r["at5"], r["at10"], r["best"]) for r in run("window_ranks_hits")}
    assert got == {k: (sum(r <= 5 for r in v), sum(r <= 10 for r in v), min(v)) for k, v in ranks.items()}


def test_all_profiles_meet_all_prototypes(spark, duck):
    from shapewright.operators import corpus as C

    c = {(r["entity"], r["year"]): np.array(r["c"]) for r in C.profiles(spark, SF).select("entity", "year", "c").collect()}
    proto = [c[k] for r in QUERIES["prototype_top_decile"](spark, SF).collect() if (k := (r["entity"], r["year"])) in c]
    got = {(r["entity"], r["year"]): (r["least"], r["second"], r["soft"]) for r in QUERIES["min_soft_min"](spark, SF).collect()}
    assert set(got) == set(c) and len(proto) > 5
    for k, v in c.items():
        d = np.sort([5 * np.abs(v - q).sum() for q in proto])
        assert np.allclose(got[k], (d[0], d[1], d[0] - 0.25 * np.log(np.exp(-(d - d[0]) / 0.25).sum())), atol=2e-6)


def tiers(rows, width):
    out = {}
    for k, g, y in rows:
        pool = [(j, v) for j, h, v in rows if h == g and j != k]
        cuts = np.quantile([v for _, h, v in rows if h == g], np.linspace(0, 1, 11)[1:-1])
        tenth = lambda v, cuts=cuts: np.searchsorted(cuts, v, side="right")
        for tier, found in (("caliper", [j for j, v in pool if abs(v - y) <= width]), ("decile", [j for j, v in pool if tenth(v) == tenth(y)]), ("any", [j for j, _ in pool])):
            if found:
                out[k] = (len(found), min(found), tier)
                break
    return out


def test_every_customer_has_its_partners(spark, duck):
    rows = [(k, g, float(np.log(b))) for k, g, b in table(duck, "select c_custkey, c_nationkey, c_acctbal from customer where c_acctbal > 1000")]
    got = {r["custkey"]: (r["n"], r["first"], r["tier"]) for r in QUERIES["caliper_band_join"](spark, SF).collect()}
    assert got == tiers(rows, 0.35) and any(k % 5 for k in got)


def test_tiers_of_a_caliper(spark):
    from shapewright.operators import relational as R

    rows = [(9, 1, 0.0), (3, 1, 0.1), (4, 1, 0.1), (1, 1, 5.0), (2, 2, 1.0), (5, 3, 1.0), (6, 3, 9.0), *[(20 + i, 4, float(i)) for i in range(31)], (60, 4, 4.0)]
    for width in (0.35, 0.01):
        got = {r["k"]: (r["n"], r["first"], r["tier"]) for r in R.band_tiers(spark.createDataFrame(rows, "k long, g int, y double"), "k", "y", width, "g").collect()}
        assert got == tiers(rows, width) and {t for *_, t in got.values()} == {"caliper", "decile", "any"}


def uniform(*key):
    return int(hashlib.md5(":".join(map(str, key)).encode()).hexdigest()[:13], 16) / 2**52


def test_bootstrap_has_both_schemes_and_all_draws(spark, duck):
    from shapewright.plans.series import excess

    rows = [tuple(r) for r in excess(spark, SF).select("entity", "year", "e").collect()]

    def ends(place, seed, block):
        groups = sorted({r[place] for r in rows})
        sums = np.array([[sum(r[2] for r in rows if r[place] == g), sum(r[place] == g for r in rows)] for g in groups])
        m = len(groups)
        means = []
        for draw in range(5000):
            i = [(int(uniform(seed, draw, slot // block) * m) + slot % block) % m for slot in range(m)]
            means.append(sums[i, 0].sum() / sums[i, 1].sum())
        return tuple(np.percentile(means, [2.5, 97.5]))

    entity, block = ends(0, 7, 1), ends(1, 8, 2)
    got = QUERIES["block_bootstrap_ci"](spark, SF).collect()
    assert len(got) == 1
    got = got[0]
    assert np.allclose([got[c] for c in ("entity_low", "entity_high", "block_low", "block_high")], [*entity, *block], atol=2e-6)
    wide = max((entity, "entity"), (block, "block"), key=lambda x: x[0][1] - x[0][0])
    assert np.allclose((got["low"], got["high"]), wide[0], atol=2e-6) and got["scheme"] == wide[1]
    assert got["degenerate"] == (len({r[1] for r in rows}) <= 2)
    assert QUERIES["null_n1"](spark, SF).select("draw").distinct().count() == 5000


def test_blocks_of_queries_find_the_same(spark):
    from pyspark.sql import functions as F

    from shapewright.plans.evaluation import search_vectors

    e = spark.read.parquet(f"{SF}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"), "label")
    rows = lambda block: sorted(map(tuple, search_vectors(e.where("id % 10 = 0"), e, 5, block).collect()))
    assert rows(7) == rows(2048) and len(rows(7)) == 5 * e.where("id % 10 = 0").count()


def peak_of(compare, asked, held):
    import tracemalloc

    tracemalloc.start()
    out = compare(asked, held)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return out, peak


def block_of(n, start, seed):
    import numpy as np
    import pyarrow as pa

    v = np.round(np.random.default_rng(seed).normal(size=(n, 64)), 1)
    v[1::5] = v[0]  # copies, so that distances tie
    v[2], v[3, 0] = 0, np.nan
    return v, pa.RecordBatch.from_arrays([pa.array(range(start, start + n)), pa.array([i % 3 for i in range(n)], pa.int32()), *[pa.array(v.tolist(), pa.list_(pa.float64()))] * 2], names=["id", "label", "v", "o"])


def test_whole_blocks_are_compared_in_strips(spark, monkeypatch):
    """A block of the largest size that asks meets one that is held without a matrix of all their distances; ties go to the smaller id."""
    import numpy as np

    from shapewright.operators import axes, blocks
    from shapewright.plans.evaluation import QUERY_BLOCK, SLICE, search_vectors

    caught = []
    monkeypatch.setattr(blocks, "met", lambda asked, held, compare, schema, *a: caught.append(compare) or spark.createDataFrame([], schema))
    (q, asked), (v, held) = block_of(QUERY_BLOCK, 500, 1), block_of(SLICE, 0, 2)
    frame = spark.createDataFrame([], "id long, label int, v array<double>")
    search_vectors(frame, frame, 7)
    out, peak = peak_of(caught.pop(), asked, held)
    with np.errstate(all="ignore"):
        d = np.round(1 - (q @ v.T) / (np.sqrt((q * q).sum(axis=1))[:, None] * np.sqrt((v * v).sum(axis=1))[None, :] + 1e-12), 9)
    want = []
    for i in range(QUERY_BLOCK):
        near = sorted((x, j) for j, x in enumerate(d[i].tolist()) if j != i + 500 and np.isfinite(x))[:7]
        want += [(i + 500, i % 3, j, j % 3, x) for x, j in near]
    got = list(zip(*[c.to_pylist() for c in out.columns], strict=True))
    assert [r[:4] for r in got] == [r[:4] for r in want] and np.allclose([r[4] for r in got], [r[4] for r in want], atol=2e-9)
    assert peak < 24 << 20

    axes.self_ranks(frame.select("id", "v"), frame.select("id", "v"))
    (q, asked), (v, held) = block_of(blocks.ASKED, 500, 3), block_of(blocks.HELD, 0, 4)
    out, peak = peak_of(caught.pop(), asked, held)
    assert out.num_rows == blocks.ASKED and peak < 32 << 20


def test_fuzzy_tiers(spark):
    from pyspark.sql import functions as F

    from shapewright.functions import text as X

    rows = [("nation 3", "nt", [], 19), ("Côte d'Ivoire", "divoire", [], 70), ("Ivory Coast", "ci", ["CI"], 100), ("abc", "b", [], 40), ("abc", "x", [], None), ("abc", "", [], None), ("a long name", "zq", ["z-q"], 19)]
    frame = spark.createDataFrame([(i, n, q, a) for i, (n, q, a, _) in enumerate(rows)], "i int, n string, q string, a array<string>")
    got = {r["i"]: r["s"] for r in frame.select("i", X.fuzzy_score(F.col("q"), F.col("n"), F.col("a")).alias("s")).collect()}
    assert got == {i: s for i, (*_, s) in enumerate(rows)}


def test_fuzzy_scores_of_given_queries_are_compiled(spark):
    """A query as a str scores as one in a column does, and no array is walked a row."""
    import io
    from contextlib import redirect_stdout

    from pyspark.sql import functions as F

    from shapewright.functions import text as X
    from shapewright.plans import QUERIES

    names = ["Widget", "hot widget", "new-widget", "Ünïted wídget's", "w i d", "xxwidgetxx", "x[y]^z", "a\tbc", "", "  ring ", "wwiiddggeett", "d.i.w.g", None, "Brand#12", "a-b c", "a\nb"]
    aliases = ["Brand#12", "w", None, "", "x^", "hot w", "ring-a", "widget"]
    queries = ["widget", "hot w", "w", "it", "", " ' ", "Wídget's", "y]", "^z", "d#1", "ab", "a\tb", "-w", "xz", "]^", "zq", ".g", "a\nb", "bc"]
    pairs = spark.createDataFrame([(n, a) for n in names for a in aliases], "n string, a string")
    for q in queries:
        q_, n, a = F.lit(q), F.col("n"), F.col("a")
        for two, slow in (([a], F.array("a")), ([], None), ([a, n], F.array("a", "n"))):
            got = pairs.select("n", "a", X.fuzzy_score(q, n, two).alias("x"), X.fuzzy_score(q_, n, slow).alias("y"))
            assert got.where(~F.col("x").eqNullSafe(F.col("y"))).collect() == [], q
    frame = QUERIES["fuzzy_score"](spark, SF)
    with redirect_stdout(io.StringIO()) as said:
        frame.explain()
    assert "lambda" not in said.getvalue() and "split(" not in said.getvalue()
