"""Queries of embeddings, evaluation, text functions, codecs and judgments."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import vec
from ..operators import corpus as C
from ..operators import features as Fe
from ..operators import relational as R
from ..operators import search as S
from ..operators import stats as St
from ..session import table
from .profile import BLEND, FEATURES, STAGE, over_pairs, search_sql
from .registry import on_profiles, query, r6

K = 10
EMB = "e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label FROM embeddings)"
NEAR = EMB + f""", nn AS (SELECT a.id, a.label, b.id AS b_id, b.label AS b_label, round(1 - list_inner_product(a.v, b.v) / (sqrt(list_inner_product(a.v, a.v)) * sqrt(list_inner_product(b.v, b.v)) + 1e-12), 9) AS d FROM e a JOIN e b ON a.id <> b.id AND a.id % 10 = 0),
top AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, b_id)::INT AS rank FROM nn QUALIFY rank <= {K})"""


def nearest(spark, d, k=K):
    """The k nearest by cosine of every tenth vector, against all: blocks of queries meet blocks of vectors in the executors.

    Each block of queries keeps k candidates of each slice of vectors, of which each task sends k rows for each query.
    """
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"), "label")
    return search_vectors(e.where("id % 10 = 0"), e, k)


QUERY_BLOCK, SLICE, STRIP = 1024, 4096, 128
"""Vectors of a block that asks, of one that is held, and of a strip of the first that is compared at once."""


def search_vectors(queries, vectors, k, block=QUERY_BLOCK, held=SLICE):
    """k nearest of each query (id, label, v), itself left out: blocks of queries meet blocks of vectors in the executors, each pair gives k candidates of a query."""
    import numpy as np
    import pyarrow as pa

    from ..operators.blocks import matrix, met

    def nearest_of(asked, other):
        q, v = matrix(asked.column("v")), matrix(other.column("v"))
        own, ids, keep = asked.column("id").to_numpy(), other.column("id").to_numpy(), min(k, len(other))
        lengths = np.sqrt((v * v).sum(axis=1))[None, :]
        rows, cols, far = [], [], []
        for at in range(0, len(q), STRIP):
            strip = q[at : at + STRIP]
            dist = np.round(1 - (strip @ v.T) / (np.sqrt((strip * strip).sum(axis=1))[:, None] * lengths + vec.COS_EPS), 9)
            dist[(own[at : at + STRIP, None] == ids[None, :]) | ~np.isfinite(dist)] = np.inf
            row, col = np.nonzero((dist <= np.partition(dist, keep - 1, axis=1)[:, keep - 1 : keep]) & np.isfinite(dist))  # with ties for the last place
            order = np.lexsort((ids[col], dist[row, col], row))
            row, col = row[order], col[order]
            first = np.arange(len(row)) - np.searchsorted(row, row) < keep
            row, col = row[first], col[first]
            rows.append(row + at)
            cols.append(col)
            far.append(dist[row, col])
        row, col = pa.array(np.concatenate(rows)), pa.array(np.concatenate(cols))
        arrays = [asked.column("id").take(row), asked.column("label").take(row), other.column("id").take(col), other.column("label").take(col), pa.array(np.concatenate(far))]
        return pa.RecordBatch.from_arrays(arrays, names=["id", "label", "b_id", "b_label", "d"])

    near = met(queries.select("id", "label", "v"), vectors.select("id", "label", "v"), nearest_of, "id long, label int, b_id long, b_label int, d double", ["id"], ["id"], block, held)
    w = Window.partitionBy("id").orderBy("d", "b_id")
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


@query("knn_cosine", f"WITH {NEAR} SELECT id, b_id, rank, round(d, 6) + 0.0 AS d FROM top")
def knn_cosine(spark, d):
    return nearest(spark, d).select("id", "b_id", "rank", r6("d").alias("d"))


@query("knn_label_agreement", f"WITH {NEAR} SELECT label, round(avg((label = b_label)::INT), 6) + 0.0 AS agreement FROM top GROUP BY label")
def knn_label_agreement(spark, d):
    return nearest(spark, d).groupBy("label").agg(r6(F.avg((F.col("label") == F.col("b_label")).cast("int"))).alias("agreement"))


@query("precision_at_k_mrr", f"WITH {NEAR}, g AS (SELECT label, count(*) AS n FROM e GROUP BY label) SELECT id, round(sum((label = b_label)::INT) / least({K}, any_value(n) - 1), 6) + 0.0 AS p_at_k, round(coalesce(max(CASE WHEN label = b_label THEN 1.0 / rank END), 0), 6) + 0.0 AS mrr FROM top JOIN g USING (label) GROUP BY id")
def precision_at_k_mrr(spark, d):
    hit = F.col("label") == F.col("b_label")
    sizes = table(spark, d, "embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    each = nearest(spark, d).join(F.broadcast(sizes), "label").groupBy("id").agg(F.sum(hit.cast("int")).alias("h"), F.first("n").alias("n"), F.max(F.when(hit, 1.0 / F.col("rank"))).alias("m"))
    return each.select("id", r6(F.try_divide(F.col("h").cast("double"), F.least(F.lit(K), F.col("n") - 1))).alias("p_at_k"), r6(F.coalesce("m", F.lit(0.0))).alias("mrr"))


@query("label_recall_vote", f"WITH {NEAR}, v AS (SELECT id, any_value(label) AS label, b_label, count(*) AS n FROM top GROUP BY id, b_label), w AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, b_label) AS r FROM v) SELECT label, count(*) AS n, sum((label = b_label)::INT)::BIGINT AS hits FROM w WHERE r = 1 GROUP BY label")
def label_recall_vote(spark, d):
    votes = nearest(spark, d).groupBy("id", "b_label").agg(F.first("label").alias("label"), F.count(F.lit(1)).alias("n"))
    best = votes.groupBy("id").agg(F.min_by(F.struct("label", "b_label"), F.struct(-F.col("n"), "b_label")).alias("m")).select("m.*")
    return best.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("label") == F.col("b_label")).cast("int")).alias("hits"))


@query("embedding_moments", f"WITH {EMB}, x AS (SELECT id, unnest(v) AS v, generate_subscripts(v, 1)::INT AS i FROM e WHERE TRUE) SELECT a.i, b.i AS j, round(avg(a.v * b.v) - avg(a.v) * avg(b.v), 6) + 0.0 AS cov FROM x a JOIN x b ON a.id = b.id AND a.i <= b.i GROUP BY ALL")
def embedding_moments(spark, d):
    """Covariances of all components: the moments that a projection on principal axes starts from.

    Each partition adds the products of its vectors to one matrix, so what is shuffled is a row for each pair of components and
    partition. Components that are null or beyond a vector's end are left out of their pairs.
    """
    import numpy as np
    import pyarrow as pa

    def run(batches):
        sums = np.zeros((4, 0, 0))  # of each pair (i, j): rows that have both, x_i, x_j, x_i * x_j
        for batch in batches:
            v = batch.column("v").drop_null()
            flat, sizes = v.flatten(), v.value_lengths().to_numpy(zero_copy_only=False)
            width = int(sizes.max(initial=0))
            place = np.repeat(np.arange(len(v)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            x, has = np.zeros((2, len(v), width))
            has[place] = known = flat.is_valid().to_numpy(zero_copy_only=False)
            x[place] = np.where(known, flat.to_numpy(zero_copy_only=False), 0.0)
            if width > sums.shape[1]:
                more = width - sums.shape[1]
                sums = np.pad(sums, ((0, 0), (0, more), (0, more)))
            sums[:, :width, :width] += np.stack([has.T @ has, x.T @ has, has.T @ x, x.T @ x])
        i, j = np.triu_indices(sums.shape[1])
        n, sx, sy, sxy = sums[:, i, j]
        yield pa.RecordBatch.from_arrays([pa.array(i + 1, pa.int32()), pa.array(j + 1, pa.int32()), *map(pa.array, (n, sx, sy, sxy))], names=["i", "j", "n", "sx", "sy", "sxy"])

    e = table(spark, d, "embeddings").select(F.col("embedding").cast("array<double>").alias("v"))
    sums = e.mapInArrow(run, "i int, j int, n double, sx double, sy double, sxy double").groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxy")])
    mean = lambda c: F.col(c) / F.col("n")
    return sums.where("n > 0").select("i", "j", r6(mean("sxy") - mean("sx") * mean("sy")).alias("cov"))


ANY = search_sql("TRUE")[1]


@query("continuity_topk", on_profiles("SELECT entity, count(*) AS n, sum(hit)::BIGINT AS hits FROM (SELECT entity, year, (arg_min(b_entity, (round(d, 9), abs(b_year - year), b_year, b_entity)) = entity)::INT AS hit FROM dist GROUP BY entity, year) GROUP BY entity", over_pairs(BLEND, where="NOT (a.entity = b.entity AND a.year = b.year)")))
def continuity_topk(spark, d):
    """How often a profile's nearest is the same entity in another year."""
    found = S.scanned(C.profiles(spark, d), S.Query("any"), own_years=True)
    best = found.groupBy("entity", "year").agg(F.min_by("b_entity", F.struct("d", F.abs("dy"), "b_year", "b_entity")).alias("e"))
    return best.groupBy("entity").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("e") == F.col("entity")).cast("int")).alias("hits"))


@query("method_jaccard", on_profiles("SELECT x.entity, x.year, round(count(*) FILTER (y.b_entity IS NOT NULL) / (10.0 - count(*) FILTER (y.b_entity IS NOT NULL)), 6) + 0.0 AS jaccard FROM (SELECT * FROM ranked WHERE rank <= 5) x LEFT JOIN (SELECT entity, year, b_entity FROM (SELECT *, row_number() OVER (PARTITION BY entity, year ORDER BY round(d, 9), b_entity) AS rank FROM dh) WHERE rank <= 5) y USING (entity, year, b_entity) GROUP BY ALL", search_sql("a.year = b.year")[1] + "," + over_pairs("sqrt(sum((sqrt(a.s) - sqrt(b.s)) * (sqrt(a.s) - sqrt(b.s)))) / sqrt(2)").replace("dist AS", "dh AS")))
def method_jaccard(spark, d):
    """Overlap of the five nearest by two distances."""
    from ..operators.metrics import prepared

    p = prepared(C.profiles(spark, d))
    sets = lambda m, extra: S.top(S.matches(p, S.Query(), m, extra), 5).groupBy("entity", "year").agg(F.collect_set("b_entity").alias(m))
    return sets("blend", ()).join(sets("hel", ("sq",)), ["entity", "year"]).select("entity", "year", r6(R.jaccard(F.col("blend"), F.col("hel"))).alias("jaccard"))


@query("stage_agreement", on_profiles(f"SELECT st.stage, count(*) AS n, sum((st.stage = sb.stage)::INT)::BIGINT AS same FROM ranked JOIN st USING (entity, year) JOIN st sb ON sb.entity = b_entity AND sb.year = b_year WHERE rank <= 5 GROUP BY st.stage", search_sql("a.year = b.year")[1] + "," + FEATURES + f", st AS (SELECT entity, year, {STAGE} AS stage FROM fe)"))
def stage_agreement(spark, d):
    p = C.profiles(spark, d)
    st = Fe.features(p).select("entity", "year", Fe.stage(F.col("median_value")).alias("stage"))
    other = st.select(F.col("entity").alias("b_entity"), F.col("year").alias("b_year"), F.col("stage").alias("other"))
    met = S.similar(p, S.Query()).join(st, ["entity", "year"]).join(other, ["b_entity", "b_year"])
    return met.groupBy("stage").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("stage") == F.col("other")).cast("int")).alias("same"))


@query("opposites_regions", on_profiles("SELECT entity, year, count(DISTINCT n_regionkey) AS regions FROM ranked JOIN nation ON n_nationkey = b_entity WHERE rank <= 5 GROUP BY ALL", search_sql("a.year = b.year", True)[1]))
def opposites_regions(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("b_entity"), "n_regionkey")
    return S.different(C.profiles(spark, d), S.Query()).join(n, "b_entity").groupBy("entity", "year").agg(F.countDistinct("n_regionkey").alias("regions"))


@query("window_ranks_hits", on_profiles("SELECT entity, b_entity, count(*) FILTER (rank <= 5) AS at5, count(*) FILTER (rank <= 10) AS at10, min(rank) AS best FROM ranked GROUP BY ALL", search_sql("a.year = b.year")[1]))
def window_ranks_hits(spark, d):
    w = Window.partitionBy("entity", "year").orderBy("d", F.abs("dy"), "b_year", "b_entity")
    found = S.best_of_entity(S.matches(C.profiles(spark, d), S.Query())).withColumn("rank", F.row_number().over(w))
    return found.groupBy("entity", "b_entity").agg(F.count(F.when(F.col("rank") <= 5, 1)).alias("at5"), F.count(F.when(F.col("rank") <= 10, 1)).alias("at10"), F.min("rank").alias("best"))


# judgments ---------------------------------------------------------------------------------------------------------

JUDGED = "j AS (SELECT l.doc_id, quality, toxic, lang, n_chars, (quality = (n_chars > 300)::INT) AS a, (quality = (doc_id % 3 > 0)::INT) AS b FROM labels l JOIN documents USING (doc_id))"


def judged(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", "n_chars")
    j = table(spark, d, "labels").join(docs, "doc_id")
    return j.withColumn("a", F.col("quality") == (F.col("n_chars") > 300).cast("int")).withColumn("b", F.col("quality") == (F.col("doc_id") % 3 > 0).cast("int"))


@query("agreement_by_stratum", f"WITH {JUDGED} SELECT lang AS stratum, count(*) AS n, round(avg(a::INT), 6) + 0.0 AS agree_a, round(avg(b::INT), 6) + 0.0 AS agree_b FROM j GROUP BY lang")
def agreement_by_stratum(spark, d):
    return judged(spark, d).groupBy(F.col("lang").alias("stratum")).agg(F.count(F.lit(1)).alias("n"), r6(F.avg(F.col("a").cast("int"))).alias("agree_a"), r6(F.avg(F.col("b").cast("int"))).alias("agree_b"))


@query("sign_test_counts", f"WITH {JUDGED} SELECT lang, count(*) FILTER (a AND NOT b) AS wins, count(*) FILTER (b AND NOT a) AS losses FROM j GROUP BY lang")
def sign_test_counts(spark, d):
    a, b = F.col("a"), F.col("b")
    return judged(spark, d).groupBy("lang").agg(F.count(F.when(a & ~b, 1)).alias("wins"), F.count(F.when(b & ~a, 1)).alias("losses"))


@query("sign_test_p", f"WITH {JUDGED}, c AS (SELECT lang, count(*) FILTER (a AND NOT b) AS wins, count(*) FILTER (b AND NOT a) AS losses FROM j GROUP BY lang), n AS (SELECT lang, wins + losses AS n, least(wins, losses) AS k FROM c), t AS (SELECT lang, n, unnest(range(k + 1)) AS i FROM n) SELECT n.lang, round(CASE WHEN any_value(n.n) = 0 THEN 1 ELSE least(1, 2 * sum(exp(lgamma(n.n + 1) - lgamma(i + 1) - lgamma(n.n - i + 1) - n.n * ln(2)))) END, 9) AS p FROM n JOIN t USING (lang) GROUP BY n.lang")
def sign_test_p(spark, d):
    """Exact two-sided p of each language's discordant judgments."""
    return sign_test_counts(spark, d).select("lang", F.round(St.sign_p(F.col("wins"), F.col("losses")), 9).alias("p"))


CUTS = (100, 200, 300, 500, 1000)


@query("loo_grid", f"WITH {JUDGED}, g AS (SELECT doc_id, cut, (quality = (n_chars > cut)::INT)::INT AS hit FROM j, (VALUES {', '.join(f'({c})' for c in CUTS)}) t(cut)), s AS (SELECT cut, sum(hit) AS total FROM g GROUP BY cut), o AS (SELECT doc_id, cut, hit, total - hit AS rest FROM g JOIN s USING (cut)), b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY rest DESC, cut) AS r FROM o) SELECT cut::INT AS cut, count(*) AS n, sum(hit)::BIGINT AS hits FROM b WHERE r = 1 GROUP BY cut")
def loo_grid(spark, d):
    """Each judgment is predicted by the cut that does best on all others: totals less its own."""
    g = judged(spark, d).select("doc_id", "quality", "n_chars", F.explode(F.array(*map(F.lit, CUTS))).alias("cut")).withColumn("hit", (F.col("quality") == (F.col("n_chars") > F.col("cut")).cast("int")).cast("int"))
    totals = F.broadcast(g.groupBy("cut").agg(F.sum("hit").alias("total")))  # a row for each cut
    best = g.join(totals, "cut").groupBy("doc_id").agg(F.min_by(F.struct("cut", "hit"), F.struct(F.col("hit") - F.col("total"), "cut")).alias("m"))
    return best.groupBy("m.cut").agg(F.count(F.lit(1)).alias("n"), F.sum("m.hit").alias("hits"))


# text --------------------------------------------------------------------------------------------------------------

SQL_SLUG = "regexp_replace(regexp_replace(lower(translate({}, '" + X.ACCENTED + "', '" + X.PLAIN + "')), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"


@query("slugify", f"SELECT doc_id, {SQL_SLUG.format('text')} AS slug FROM documents")
def slugify(spark, d):
    """A slug of each document's whole text."""
    return table(spark, d, "documents").select("doc_id", X.slug(F.col("text")).alias("slug"))


def span_sql(q: str, text: str) -> str:
    """From the first to the last of a query's characters in a text, each as early as can be; null where one is missing."""
    pattern = q[0] + "".join(f"[^{c}]*{c}" for c in q[1:])
    return f"(nullif(length(regexp_extract({text}, '{pattern}')), 0) - 1)"


def fuzzy_sql(q: str, name: str, alias: str) -> str:
    best = f"least(coalesce({span_sql(q, name)}, {span_sql(q, alias)}), coalesce({span_sql(q, alias)}, {span_sql(q, name)}))"
    gaps = f"WHEN {best} IS NOT NULL THEN 10 + round(10 * greatest(0.0, 1 - ({best} - {len(q) - 1}) / greatest(length({name}), 1)::DOUBLE))" if len(q) > 1 else ""
    return f"""CASE WHEN {name} = '{q}' OR {alias} = '{q}' THEN 100 WHEN starts_with({name}, '{q}') THEN 80 WHEN len(list_filter(regexp_split_to_array({name}, '[\\s-]+'), lambda w: starts_with(w, '{q}'))) > 0 THEN 70
    WHEN starts_with({alias}, '{q}') THEN 60 WHEN contains({name}, '{q}') OR contains({alias}, '{q}') THEN 40 {gaps} END::INT"""


ASKED = ("widget", "hot w", "ring", "Brand#12", "d#1", "hwd", "nt", "n'ew", "x")
ASKED_SQL = " UNION ALL ".join(f"SELECT p_partkey, '{q.replace(chr(39), chr(39) * 2)}' AS q, {fuzzy_sql(q.lower().replace(chr(39), ''), 'n', 'b')} AS score FROM (SELECT p_partkey, lower(p_name) AS n, lower(p_brand) AS b FROM part)" for q in ASKED)


@query("fuzzy_score", ASKED_SQL)
def fuzzy_score(spark, d):
    """Several queries against the names and brands of all parts, in all tiers: texts are made matchable once, and each query is compiled.

    Rows are few bytes and much work, so they are dealt over all cores, however few splits their file has.
    """
    parts = table(spark, d, "part").repartition(2 * spark.sparkContext.defaultParallelism, "p_partkey").select("p_partkey", X.matchable(F.col("p_name")).alias("n"), X.matchable(F.col("p_brand")).alias("b"))
    scores = [X.score_of(X.asked_text(q), F.col("n"), [F.col("b")]) for q in ASKED]
    return parts.select("p_partkey", F.inline(F.array(*[F.struct(F.lit(q).alias("q"), s.alias("score")) for q, s in zip(ASKED, scores, strict=True)])))


@query("fuzzy_subsequence", f"SELECT n_nationkey, {fuzzy_sql('nto', 'lower(n_name)', 'lower(n_name)')} AS score FROM nation")
def fuzzy_subsequence(spark, d):
    """Names that hold the letters of a query in order only; 10 to 20 by how tightly."""
    return table(spark, d, "nation").select("n_nationkey", X.fuzzy_score(F.lit("nto"), F.col("n_name")).alias("score"))


@query("alias_resolve", "SELECT o.k, min(n_nationkey) AS entity FROM (VALUES ('nation_3'), ('NATION_7'), ('nowhere')) o(k) LEFT JOIN nation ON lower(n_name) = lower(k) GROUP BY o.k")
def alias_resolve(spark, d):
    asked = spark.createDataFrame([("nation_3",), ("NATION_7",), ("nowhere",)], "k string")
    names = table(spark, d, "nation").groupBy(F.lower("n_name").alias("low")).agg(F.min("n_nationkey").alias("entity"))
    return asked.join(names, F.lower("k") == F.col("low"), "left").select("k", "entity")


DENY = ["license", "password", "token"]


DENY_SQL = " UNION ALL ".join(
    f"SELECT doc_id, '{w}' AS word, substr(text, greatest(pos - 30, 1), {len(w) + 60}) AS context FROM (SELECT doc_id, text, unnest(list_transform(range(1, len(parts)), lambda i: (list_sum(list_transform(parts[1:i], lambda x: length(x))) + (i - 1) * {len(w)} + 1)::BIGINT)) AS pos "
    f"FROM (SELECT doc_id, text, string_split(lower(text), '{w}') AS parts FROM documents WHERE contains(lower(text), '{w}')))"
    for w in DENY
)


@query("deny_list_hits", DENY_SQL)
def deny_list_hits(spark, d):
    return table(spark, d, "documents").select("doc_id", F.inline(X.hits(F.col("text"), DENY)))


@query("licence_guard", "SELECT source, count(*) FILTER (regexp_matches(text, 'Creative Commons|CC BY-NC|All rights reserved')) AS guarded FROM documents GROUP BY source")
def licence_guard(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.count(F.when(F.col("text").rlike("Creative Commons|CC BY-NC|All rights reserved"), 1)).alias("guarded"))


@query("bin_labels", on_profiles("SELECT DISTINCT pos, CASE WHEN pos < 10 THEN 'O ' ELSE 'F ' END || CASE WHEN pos % 10 = 9 THEN '46+' ELSE (pos % 10 * 5 + 1) || '-' || (pos % 10 * 5 + 5) END AS label FROM cells"))
def bin_labels(spark, d):
    return C.cells(spark, d).select("pos").distinct().select("pos", X.bin_label(F.col("pos")).alias("label"))


@query("restated_query", on_profiles("SELECT entity, year, 'top 5 · ' || CASE WHEN year % 2 = 0 THEN 'same year' ELSE 'any year' END || CASE WHEN entity > 10 THEN ' · at least ' || entity ELSE '' END AS said FROM k"))
def restated_query(spark, d):
    k = C.cells(spark, d).select("entity", "year").distinct()
    return k.select("entity", "year", X.restated(F.when(F.col("year") % 2 == 0, "same").otherwise("any"), F.lit(5), F.when(F.col("entity") > 10, F.col("entity")).otherwise(0)).alias("said"))


@query("json_props", "SELECT event_type, sum((props->>'$.k')::BIGINT)::BIGINT AS total, count(*) AS n FROM events GROUP BY event_type")
def json_props(spark, d):
    return table(spark, d, "events").select("event_type", F.from_json("props", "k long")["k"].alias("k")).groupBy("event_type").agg(F.sum("k").alias("total"), F.count(F.lit(1)).alias("n"))


@query("typed_codec", "SELECT o_orderkey, CASE WHEN o_totalprice IS NULL OR o_totalprice <= 0 THEN -32768 ELSE least(greatest(floor(ln(o_totalprice) * 1024 + 0.5), -32767), 32767)::INT END::INT AS code FROM orders")
def typed_codec(spark, d):
    """Positive values as 16-bit logarithms, a sentinel for none."""
    v = F.col("o_totalprice")
    code = F.least(F.greatest(F.floor(F.log(v) * 1024 + 0.5), F.lit(-32767)), F.lit(32767)).cast("int")
    return table(spark, d, "orders").select("o_orderkey", F.when(v.isNull() | (v <= 0), -32768).otherwise(code).alias("code"))


@query("corpus_hash", on_profiles("SELECT entity, sha256(string_agg(u::VARCHAR, ',' ORDER BY year, pos)) AS digest FROM (SELECT entity, year, pos, (pop * 1)::BIGINT AS u FROM cells) GROUP BY entity"))
def corpus_hash(spark, d):
    listed = C.cells(spark, d).groupBy("entity").agg(F.sort_array(F.collect_list(F.struct("year", "pos", F.col("pop").cast("long").cast("string").alias("u")))).alias("x"))
    return listed.select("entity", F.sha2(F.array_join(F.transform("x", lambda s: s["u"]), ",").cast("binary"), 256).alias("digest"))
