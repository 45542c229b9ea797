"""Clustering by two trees, top-k by thresholds and fill-in-the-middle against brute force, on small tables full of edges."""

import hashlib
import math
import random

import numpy as np
import pyarrow as pa
import pytest

from shapewright.llm import fim, kmeans, topk

NAN, INF = float("nan"), float("inf")


def vectors(n, dim, seed, spread=0.2):
    """Clustered vectors; some equal, some the same but for their sign."""
    r = random.Random(seed)
    homes = [[r.uniform(-1, 1) for _ in range(dim)] for _ in range(5)]
    out = [[x + r.uniform(-spread, spread) for x in homes[r.randrange(5)]] for _ in range(n)]
    return out + [out[0]] * 20 + [[-x for x in out[1]]] + [[0.0] * dim] * 3


def plain_lloyd(rows, k, rounds, dim):
    kept = [(key, [math.floor(1024 * x) for x in v]) for key, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) and abs(x) <= kmeans.LARGEST / 1024 for x in v)]
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]
    centres = [v for _, v in first]
    gap = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda v: min(range(len(centres)), key=lambda j: (gap(v, centres[j]), j))
    for _ in range(rounds):
        own = [nearest(v) for _, v in kept]
        for j in range(len(centres)):
            if mine := [v for (_, v), o in zip(kept, own, strict=True) if o == j]:
                centres[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    own = [nearest(v) for _, v in kept]
    d = [gap(v, centres[j]) for (_, v), j in zip(kept, own, strict=True)]
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(((str(key), j, x, sum(y for y, o in zip(d, own, strict=True) if o == j), sum(d), digest[j]) for (key, _), j, x in zip(kept, own, d, strict=True)))


ODD = [(None, [0.5, 0.25, 1.0]), (7, None), (8, []), (9, [1.0, None, 2.0]), (10, [NAN, 1.0, 1.0]), (11, [INF, 1.0, 1.0]), (12, [1.0, 2.0]), (13, [1e300, 0.0, 0.0]), (3, [0.5, 0.5, 0.5]), (3, [0.5, 0.5, 0.5]), (3, [-0.5, 0.1, 0.0])]


@pytest.mark.parametrize("k,dim,size,leaf,scale", [(3, 3, 40, 4, 1), (8, 3, 7, 1, 1), (40, 4, 64, 2, 1), (500, 3, 50, 4, 1), (5, 3, 60, 4, 40_000)])
def test_two_trees_equal_plain_rounds(spark, monkeypatch, k, dim, size, leaf, scale):
    rows = [(i, [scale * x for x in v]) for i, v in enumerate(vectors(150, dim, k))] + (ODD if dim == 3 else [])
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    planted = kmeans.planted
    monkeypatch.setattr(kmeans, "planted", lambda rows, key, dim: planted(rows, key, dim, size))
    monkeypatch.setattr(kmeans, "LEAF", leaf)
    got = kmeans.cluster(df, "vec_id", "embedding", k, 4, dim).collect()
    assert sorted((str(r[0]), *r[1:]) for r in got) == plain_lloyd(rows, k, 4, dim)


def test_clusters_of_nothing_and_clashing_columns(spark):
    df = spark.createDataFrame(ODD, "vec_id long, embedding array<double>").selectExpr("vec_id", "embedding", "1 AS cluster", "2 AS v", "3 AS key", "4 AS distance")
    assert kmeans.cluster(df, "vec_id", "embedding").count() == 0  # none has 64 components
    assert kmeans.cluster(df.limit(0), "vec_id", "embedding", dim=3).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    got = kmeans.cluster(df, "vec_id", "embedding", 2, 3, 3).collect()
    assert sorted((str(r[0]), *r[1:]) for r in got) == plain_lloyd(ODD, 2, 3, 3)


def test_cover_tree_covers_and_separates():
    points = np.array([[math.floor(1024 * x) for x in v] for v in vectors(300, 6, 1)], np.int64)
    tree = kmeans.Tree.over(points, 1)
    assert (tree.points == points[tree.order]).all() and sorted(tree.order) == list(range(len(points)))
    gap = lambda i, j: math.sqrt(((tree.points[i] - tree.points[j]) ** 2).sum())
    for b, e, first, last, radius in zip(tree.begin, tree.end, tree.first_child, tree.last_child, tree.radius, strict=True):
        assert max(gap(b, i) for i in range(b, e)) == radius
        kids = range(first, last)
        if kids:
            assert tree.begin[first] == b and tree.end[last - 1] == e and all(tree.end[i] == tree.begin[i + 1] for i in kids[:-1])
            assert all(tree.radius[i] <= radius / 2 for i in kids)
            assert all(gap(tree.begin[i], tree.begin[j]) > radius / 2 for i in kids for j in kids if i < j)
        else:
            assert radius == 0 or e - b == 1


def test_two_trees_prune_and_agree_with_all_pairs():
    points = np.array([[math.floor(1024 * x) for x in v] for v in vectors(2000, 8, 5, 0.01)], np.int64)
    centres = points[[0, 3, 9, 30, 31, 100, 0, 200]]  # two are equal
    tree = kmeans.Tree.over(points, 4)
    label, compared = kmeans.nearest(tree, *kmeans.centroid_tree(centres))
    d = ((tree.points[:, None] - centres[None]) ** 2).sum(axis=2)
    assert (label == d.argmin(axis=1)).all()
    assert compared < d.size / 2


def plain_top(rows, k):
    kept = {(i, tuple(math.floor(1024 * x) for x in v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) and abs(x) <= topk.LARGEST / 1024 for x in v)}
    out = set()
    for i, v in kept:
        if i % 100 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j) for j, w in kept if j != i and len(v) == len(w))[:k]
            out |= {(i, n + 1, j, -s) for n, (s, j) in enumerate(best)}
    return sorted(out)


@pytest.mark.parametrize("parts,asked,held,scale", [(2, 4, 40, 1), (1, 100, 1000, 1), (3, 2, 15, 1), (2, 50, 30, 12_000)])
def test_thresholds_equal_all_pairs(spark, monkeypatch, parts, asked, held, scale):
    rows = [(10 * i, [scale * x for x in v]) for i, v in enumerate(vectors(400, 7, parts, 0.5))] + ODD
    rows += [(9000 + i, rows[40][1]) for i in range(150)]  # one vector of very many rows, some of which ask
    rows += [(200, [1.0] * 7), (100, [2.0, 1.0]), (101, [1.0, 1.0]), (300, []), (301, [])]  # no other has id 200; others are of other lengths
    rows = [r for r in rows if r != (200, rows[20][1])] + rows[-30:]
    monkeypatch.setattr(topk, "ASKED", asked)
    monkeypatch.setattr(topk, "HELD", held)
    df = spark.createDataFrame(rows, "id long, v array<double>").selectExpr("id AS vec_id", "v AS embedding", "1 AS q", "2 AS num", "3 AS d", "4 AS score").repartition(5)
    e = df.selectExpr("vec_id AS id", "embedding")
    scaled = e.select("id", topk.scaled(e["embedding"]).alias("v"))
    got = topk.search(scaled, scaled.where("id % 100 = 0"), 10, parts)
    assert sorted(tuple(r) for r in got.collect()) == plain_top(rows, 10)
    assert topk.nearest_documents(df.limit(0)).count() == 0


def test_few_vectors_have_few_neighbours(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [0.5, 0.5]), (100, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert sorted(tuple(r) for r in topk.nearest_documents(df).collect()) == plain_top([(0, [1.0, 2.0]), (1, [0.5, 0.5]), (100, [1.0, 2.0])], 10)


def test_the_second_phase_gathers_few(spark):
    """Of the entries of unrelated vectors a small part reaches the threshold."""
    r = np.random.default_rng(1)
    v = r.normal(size=(4000, 64))
    v = np.floor(1024 * v / np.linalg.norm(v, axis=1)[:, None]).astype(int)
    side = lambda a, **more: pa.RecordBatch.from_pydict({"num": list(range(len(a))), "first": list(range(len(a))), "v": pa.array(a.tolist(), pa.list_(pa.int32()))} | more)
    whole = v[:20] @ v.T
    lists = topk.best_lists(11, 2)(side(v[:20]), side(v)).to_pandas()
    cutoff = lists.groupby("q").score.apply(lambda s: s.nlargest(11).min())
    assert (cutoff.to_numpy() <= np.sort(whole, axis=1)[:, -11]).all()
    found = topk.beyond(2)(side(v[:20], cutoff=cutoff.tolist()), side(v)).to_pandas()
    assert all(set(np.flatnonzero(whole[q] >= cutoff[q])) <= set(found[found.q == q].x) for q in range(20))
    assert len(found) < 0.15 * whole.size


TEXTS = ["", None, "a", "ab<P>c", "x<", "<<S>", "<M", ">", "<P", "<SM>", "é😀ß<", "日本語のテキスト" * 30, "<" * 70 + "P>", "plain text " * 40, "\x00\n<P>" * 20, "😀" * 33, "a<P" + "b" * 50 + ">", "<P<S<M", "S>M>P>" * 9, "İ́" * 25]


def plain_fim(key, text):
    t = text or ""
    digits = hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digits[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(t)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return key, n, "plain", None, None, t
    if h4 % 100 < 20:
        return key, n, "spm", a, b - a, f"<S>{t[b:]}<P>{t[:a]}<M>{t[a:b]}"
    return key, n, "psm", a, b - a, f"<P>{t[:a]}<S>{t[b:]}<M>{t[a:b]}"


@pytest.mark.parametrize("width,piece,giant", [(fim.CHUNK, fim.PIECE, fim.GIANT), (1, 3, 5), (2, 7, 20), (5, 5, 0), (64, 64, 64)])
def test_cuts_equal_plain_ones(spark, width, piece, giant):
    long = [(f"{t}"[:1] or "-") * 3 + (t or "") * 40 for t in TEXTS]
    rows = [(i, t) for i, t in enumerate(TEXTS + long)] + [(None, "no key"), (None, None), (5, "again"), (5, "again"), (-3, "minus")] + [(3, "hot giant " * 20)] * 9
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 AS whole", "2 AS form", "3 AS who", "4 AS h1", "5 AS c0").repartition(3)
    out = fim.fill_in_middle(df, width=width, piece=piece, giant=giant)
    assert out.columns == ["doc_id", "text", "whole", "who", "h1", "c0", "n", "form", "prefix_chars", "middle_chars", "fim"]
    got = sorted(map(str, (tuple(r) for r in out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "fim").collect())))
    assert got == sorted(map(str, (plain_fim(*r) for r in rows)))
    assert out.where(~fim.restored(out["fim"], out["form"]).eqNullSafe(out["text"]) & out["text"].isNotNull()).count() == 0
    assert fim.fill_in_middle(df.limit(0), width=width, piece=piece, giant=giant).count() == 0


def test_a_very_long_text(spark):
    text = "".join(random.Random(1).choices("ab<PSM é日😀\n", [5, 5, 3, 1, 1, 1, 9, 2, 2, 2, 1], k=2_000_000))
    row = fim.fill_in_middle(spark.createDataFrame([(77, text)], "doc_id long, text string")).collect()[0]
    assert (row["doc_id"], row["n"], row["form"], row["prefix_chars"], row["middle_chars"], row["fim"]) == plain_fim(77, text)


def test_functions_compose_associatively():
    """Any way to cut a text's bytes into chunks gives the function of the whole."""
    data = np.frombuffer("é<P>日<<S>😀<M>x".encode() * 7, np.uint8)
    whole = fim.functions(fim.KINDS[data][:, None])
    for width in range(1, len(data) + 1):
        scan = fim.Scan(data, np.zeros(1, np.int64), np.array([len(data)]), width)
        assert (scan.end[scan.last] == whole[0]).all() and (scan.count[scan.last] == whole[1]).all()
    assert whole[1][0, fim.READY] == fim.MARK * 21 + len("é<P>日<<S>😀<M>x" * 7)


def test_bytes_that_are_no_text_stay_whole(spark):
    df = spark.sql("SELECT 12 AS doc_id, CAST(X'80C3' AS STRING) || repeat(CAST(X'41E697' AS STRING), 30) || 'z' AS text")
    out = fim.fill_in_middle(df, width=4, piece=8, giant=10)
    assert out.where(fim.restored(out["fim"], out["form"]).cast("binary") != out["text"].cast("binary")).count() == 0
