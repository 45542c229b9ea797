"""Queries of panel regressions: growth on levels, shares and distances to prototypes, with effects of regions and blocks of years."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import corpus as C
from ..operators import panel as P
from ..operators import search as S
from ..operators import stats as St
from ..session import shared_folder, table
from .registry import on_profiles, query, r6
from .series import SPACED, growths, levels, prototypes

SPECS = {"S0": ["lny"], "S1": ["lny", "wa", "dwa"], "S2": ["lny", "dist"], "S3": ["lny", "wa", "dwa", "dist"]}
LAGS, H = 2, 2
LEARN_TO, TEST_FROM, PROTOTYPES_TO = 1997, 1998, 1997
CLIP = 1e-9

SAMPLE = SPACED + f""", wa AS (SELECT entity, year, sum(s) FILTER (bin BETWEEN 3 AND 6) AS wa FROM prof GROUP BY ALL),
pt AS (SELECT entity, year FROM (SELECT entity, year FROM a1 UNION ALL SELECT entity, year FROM a2 UNION ALL SELECT entity, year FROM a3) WHERE year <= {PROTOTYPES_TO}),
near AS (SELECT entity, year, min(d) AS d FROM (SELECT a.entity, a.year, 5 * sum(abs(a.c - b.c)) AS d FROM p a JOIN p b ON a.pos = b.pos JOIN pt ON pt.entity = b.entity AND pt.year = b.year GROUP BY a.entity, a.year, b.entity, b.year) GROUP BY ALL),
low AS (SELECT min(d) AS floor FROM near WHERE d > {CLIP}),
smp AS (SELECT gr.entity, gr.year AS t, gr.g, ln(lv.y) AS lny, w.wa, w.wa - v.wa AS dwa, ln(greatest(near.d, {CLIP})) AS dist, ln(greatest(near.d, low.floor)) AS dist_floor, n_regionkey AS region, (floor((gr.year - 1995) / 2))::INT AS block,
  EXISTS (SELECT 1 FROM pt WHERE pt.entity = gr.entity AND pt.year = gr.year) AS self, EXISTS (SELECT 1 FROM pt WHERE pt.entity = gr.entity AND abs(pt.year - gr.year) < {H}) AS overlap
  FROM gr JOIN lv USING (entity, year) JOIN wa w USING (entity, year) JOIN wa v ON v.entity = gr.entity AND v.year = gr.year - 1 JOIN near ON near.entity = gr.entity AND near.year = gr.year JOIN nation ON n_nationkey = gr.entity, low WHERE gr.h = {H})"""


def spaced_prototypes(spark, d):
    from pyspark.sql import Window

    ranked = prototypes(spark, d).withColumn("r", F.row_number().over(Window.partitionBy("entity").orderBy(F.desc(F.round("g", 9)), "year")))
    return St.spaced(ranked, "entity", "year", "r", 3, 2).select("entity", "year").where(F.col("year") <= PROTOTYPES_TO)


def sample(spark, d):
    """entity, t, g, regressors, region, block, self and overlap; kept in the shared folder, as every fit reads it several times."""
    shared_folder(spark)
    p, proto = C.profiles(spark, d), spaced_prototypes(spark, d).checkpoint()
    held = p.join(proto, ["entity", "year"], "left_semi").select("entity", "year", "c")
    near = S.soft_minima(p.select("entity", "year", "c"), held).select("entity", "year", F.col("least").alias("d")).checkpoint()
    wa = p.select("entity", "year", F.aggregate(F.zip_with("s", F.sequence(F.lit(0), F.lit(19)), lambda s, i: F.when((i % 10).between(3, 6), s).otherwise(0.0)), F.lit(0.0), lambda t, x: t + x).alias("wa"))
    before = wa.select("entity", (F.col("year") + 1).alias("year"), F.col("wa").alias("was"))
    rows = growths(spark, d).where(F.col("h") == H).drop("h").join(levels(spark, d), ["entity", "year"]).join(wa, ["entity", "year"]).join(before, ["entity", "year"]).join(near, ["entity", "year"])
    own = proto.select(F.col("entity").alias("pe"), F.col("year").alias("py"))
    gap = rows.select("entity", "year").join(own, F.col("entity") == F.col("pe")).groupBy("entity", "year").agg(F.min(F.abs(F.col("year") - F.col("py"))).alias("gap"))
    rows = rows.join(gap, ["entity", "year"], "left").join(table(spark, d, "nation").select(F.col("n_nationkey").alias("entity"), F.col("n_regionkey").alias("region")), "entity")
    floor = near.where(F.col("d") > CLIP).agg(F.min("d")).scalar()
    out = rows.select("entity", F.col("year").alias("t"), "g", F.log("y").alias("lny"), "wa", (F.col("wa") - F.col("was")).alias("dwa"), F.log(F.greatest("d", F.lit(CLIP))).alias("dist"), F.log(F.greatest("d", floor)).alias("dist_floor"), "region", F.floor((F.col("year") - 1995) / 2).cast("int").alias("block"), (F.coalesce("gap", F.lit(99)) == 0).alias("self"), (F.coalesce("gap", F.lit(99)) < H).alias("overlap")).checkpoint()
    return out


# SQL of the same estimates: the inverse of the moments by cofactors ------------------------------------------------------


def minor(rows: list[int], cols: list[int]) -> str:
    """Determinant of the rows and columns of a symmetric matrix whose entries are named a_ij with i <= j."""
    if not rows:
        return "1.0"
    entry = lambda i, j: f"a{min(i, j)}{max(i, j)}"
    if len(rows) == 1:
        return entry(rows[0], cols[0])
    return "(" + " + ".join(f"{'' if k % 2 == 0 else '-'}{entry(rows[0], c)} * {minor(rows[1:], cols[:k] + cols[k + 1 :])}" for k, c in enumerate(cols)).replace("+ -", "- ") + ")"


def fit_sql(n: str, source: str, xs: list[str]) -> str:
    """CTEs w_, i_ and b_ of a fit: within values, inverse moments and coefficients c1, c2, ...; n: a suffix of their names."""
    ks = list(range(1, len(xs) + 1))
    all_ = lambda k: [i for i in ks if i != k]
    w = ", ".join(f"{x} - avg({x}) OVER c AS x{k}" for k, x in zip(ks, xs, strict=True))
    sums = ", ".join([*[f"sum(x{i} * x{j}) AS a{i}{j}" for i in ks for j in ks if i <= j], *[f"sum(x{i} * y) AS b{i}" for i in ks]])
    inverse = ", ".join(f"{'' if (i + j) % 2 == 0 else '-'}{minor(all_(i), all_(j))} / det AS i{i}{j}" for i in ks for j in ks)
    beta = ", ".join(" + ".join(f"i{i}{j} * b{j}" for j in ks) + f" AS c{i}" for i in ks)
    return f"""w_{n} AS (SELECT entity, t, g, g - avg(g) OVER c AS y, {w} FROM {source} WINDOW c AS (PARTITION BY region, block)), a_{n} AS (SELECT {sums} FROM w_{n}),
i_{n} AS (SELECT *, {inverse} FROM (SELECT *, {minor(ks, ks)} AS det FROM a_{n})), b_{n} AS (SELECT {beta} FROM i_{n})"""


def spec_sql(n: str, source: str, xs: list[str], label: str) -> tuple[str, str]:
    """CTEs of a fit with both kinds of standard errors, and the SELECT of its rows."""
    ks = list(range(1, len(xs) + 1))
    h = ", ".join(f"sum(u * x{k}) AS h{k}" for k in ks)
    cross = ", ".join(f"sum(f * (p.h{i} * q.h{j} + q.h{i} * p.h{j}) / 2) AS m{i}{j}" for i in ks for j in ks)
    squared = lambda by, name: f"{name}_{n} AS (SELECT {', '.join(f'sum(h{i} * h{j}) AS m{i}{j}' for i in ks for j in ks)} FROM (SELECT {h} FROM u_{n} GROUP BY {by}))"
    ctes = f"""{fit_sql(n, source, xs)}, u_{n} AS (SELECT w_{n}.*, y - {" - ".join(f"c{k} * x{k}" for k in ks)} AS u FROM w_{n}, b_{n}),
h_{n} AS (SELECT t, {h}, row_number() OVER (ORDER BY t) AS k FROM u_{n} GROUP BY t),
d_{n} AS (SELECT {cross} FROM (SELECT p, q, CASE WHEN p.k = q.k THEN 1.0 ELSE 2 * (1 - (p.k - q.k) / {LAGS + 1}.0) END AS f FROM h_{n} p JOIN h_{n} q ON p.k - q.k BETWEEN 0 AND {LAGS})),
{squared("entity", "e")}, {squared("t", "y")}, {squared("entity, t", "z")}, r_{n} AS (SELECT 1 - sum(u * u) / (SELECT sum((g - (SELECT avg(g) FROM {source})) ** 2) FROM {source}) AS r2, count(*) AS n FROM u_{n})"""
    variance = lambda k, m: " + ".join(f"i{k}{i} * {m}.m{i}{j} * i{j}{k}" for i in ks for j in ks)
    term = lambda k, x: f"SELECT {label}, '{x}' AS term, round(c{k}, 6) + 0.0 AS beta, round(sqrt(greatest({variance(k, 'd')}, 0)), 6) AS se_dk, round(sqrt(greatest({variance(k, 'e')} + {variance(k, 'y')} - ({variance(k, 'z')}), 0)), 6) AS se_2way, round(r2, 6) AS r2, n, (SELECT count(DISTINCT (region, block)) FROM {source}) AS n_cells FROM b_{n}, i_{n}, d_{n} d, e_{n} e, y_{n} y, z_{n} z, r_{n}"
    return ctes, " UNION ALL ".join(term(k, x) for k, x in zip(ks, xs, strict=True))


def specs_sql(refits: dict[str, tuple[str, dict[str, list[str]]]]) -> str:
    parts = [spec_sql(f"{name}_{s}", f"f_{name}", xs, f"'{name}' AS refit, '{s}' AS spec") for name, (_, specs) in refits.items() for s, xs in specs.items()]
    frames = [f"f_{name} AS ({select})" for name, (select, _) in refits.items()]
    return on_profiles(" UNION ALL ".join(p[1] for p in parts), ", ".join([SAMPLE, *frames, *[p[0] for p in parts]]))


def estimates(spark, frames):
    rows = [(name, *r) for name, (frame, specs) in frames.items() for r in P.spec_rows(frame, "g", specs, ["region", "block"], "entity", "t", LAGS)]
    out = spark.createDataFrame(rows, "refit string, spec string, term string, beta double, se_dk double, se_2way double, r2 double, n long, n_cells long")
    return out.select("refit", "spec", "term", *[r6(c).alias(c) for c in ("beta", "se_dk", "se_2way", "r2")], "n", "n_cells")


@query("panel_specs", specs_sql({"all": ("SELECT * FROM smp", SPECS)}))
def panel_specs(spark, d):
    """Coefficients of four sets of regressors with absorbed effects of regions' blocks of years, and two kinds of standard errors."""
    return estimates(spark, {"all": (sample(spark, d), SPECS)})


LAST = {"S3": SPECS["S3"]}
REFITS = {
    "ex_selfmatch": ("SELECT * FROM smp WHERE NOT self", LAST),
    "ex_overlap": ("SELECT * FROM smp WHERE NOT overlap", LAST),
    "floor": ("SELECT * REPLACE (dist_floor AS dist) FROM smp", LAST),
}


@query("panel_robustness", specs_sql(REFITS))
def panel_robustness(spark, d):
    """The last spec without rows that are prototypes, without rows whose window overlaps a prototype's of their own, and with a floor under distances."""
    s = sample(spark, d)
    return estimates(spark, {"ex_selfmatch": (s.where(~F.col("self")), LAST), "ex_overlap": (s.where(~F.col("overlap")), LAST), "floor": (s.withColumn("dist", F.col("dist_floor")), LAST)})


def holdout_sql() -> str:
    """Effects of the latest block learned from, predictions and their errors."""
    fits, effects, preds = [], [], []
    for s, xs in SPECS.items():
        fits.append(fit_sql(s, "tr", xs))
        value = " - ".join(f"c{k} * avg({x})" for k, x in enumerate(xs, 1))
        effects.append(f"e_{s} AS (SELECT region, block, avg(g) - {value} AS effect FROM tr, b_{s} GROUP BY region, block, {', '.join(f'c{k}' for k in range(1, len(xs) + 1))})")
        preds.append(f"SELECT '{s}' AS spec, te.t, te.g, effect + {' + '.join(f'c{k} * te.{x}' for k, x in enumerate(xs, 1))} AS pred FROM te JOIN latest USING (region) JOIN e_{s} e ON e.region = te.region AND e.block = latest.last, b_{s}")
    ctes = ", ".join([
        SAMPLE, f"tr AS (SELECT * FROM smp WHERE t <= {LEARN_TO})", f"te AS (SELECT * FROM smp WHERE t >= {TEST_FROM})", "latest AS (SELECT region, max(block) AS last FROM tr GROUP BY region)", *fits, *effects,
        f"pr_ AS ({' UNION ALL '.join(preds)})", "mean_ AS (SELECT sum((te.g - (SELECT avg(g) FROM tr)) ** 2) AS sse FROM te JOIN latest USING (region))", "sse AS (SELECT spec, sum((g - pred) ** 2) AS sse, count(*) AS n FROM pr_ GROUP BY spec)",
        "rk_ AS (SELECT spec, t, rank() OVER (PARTITION BY spec, t ORDER BY round(pred, 9)) + (count(*) OVER (PARTITION BY spec, t, round(pred, 9)) - 1) / 2.0 AS a, rank() OVER (PARTITION BY spec, t ORDER BY round(g, 9)) + (count(*) OVER (PARTITION BY spec, t, round(g, 9)) - 1) / 2.0 AS b FROM pr_)",
        "rho AS (SELECT spec, avg(rho) AS rho, avg((rho > 0)::INT) AS positive FROM (SELECT spec, t, corr(a, b) AS rho FROM rk_ GROUP BY spec, t HAVING count(*) >= 3) GROUP BY spec)",
    ])
    of = lambda s: f"(SELECT sse FROM sse WHERE spec = '{s}')"
    return on_profiles(f"SELECT spec, n, round(sse, 6) AS sse, round(1 - sse / (SELECT sse FROM mean_), 6) + 0.0 AS vs_mean, round(1 - sse / {of('S0')}, 6) + 0.0 AS vs_s0, round(1 - sse / {of('S1')}, 6) + 0.0 AS vs_s1, round(rho, 6) + 0.0 AS rho, round(positive, 6) AS positive FROM sse JOIN rho USING (spec)", ctes)


@query("panel_holdout", holdout_sql())
def panel_holdout(spark, d):
    """Fits up to a year, predictions of later ones by the latest effects: errors against the mean and two simpler specs, and rank correlations by year."""
    told = P.held_out(sample(spark, d), "g", SPECS, "region", "block", F.col("t") <= LEARN_TO, F.col("t") >= TEST_FROM).checkpoint()
    error = lambda c: F.sum((F.col("g") - F.col(f"pred_{c}")) ** 2)
    sums = told.agg(F.count(F.lit(1)).alias("n"), *[error(c).alias(c) for c in ("mean", *SPECS)])
    against = lambda s, c: r6(1 - F.col(s) / F.col(c))
    wide = F.inline(F.array(*[F.struct(F.lit(s).alias("spec"), "n", F.round(s, 6).alias("sse"), against(s, "mean").alias("vs_mean"), against(s, "S0").alias("vs_s0"), against(s, "S1").alias("vs_s1")) for s in SPECS]))
    rho = None
    for s in SPECS:
        new = P.rank_correlations(told, F.col(f"pred_{s}"), F.col("g"), "t").agg(r6(F.avg("rho")).alias("rho"), F.round(F.avg((F.col("rho") > 0).cast("int")), 6).alias("positive")).withColumn("spec", F.lit(s))
        rho = new if rho is None else rho.unionByName(new)
    return sums.select(wide).join(rho, "spec")


@query("panel_sample", on_profiles("SELECT entity, t, region, block, self, overlap, round(g, 6) + 0.0 AS g, round(lny, 6) + 0.0 AS lny, round(wa, 6) + 0.0 AS wa, round(dwa, 6) + 0.0 AS dwa, round(dist, 6) + 0.0 AS dist, round(dist_floor, 6) + 0.0 AS dist_floor FROM smp", SAMPLE))
def panel_sample(spark, d):
    """The rows that the panel is fitted to: growth of a window, level, share and its change, distance to prototypes, and whether the row is or overlaps one."""
    return sample(spark, d).select("entity", "t", "region", "block", "self", "overlap", *[r6(c).alias(c) for c in ("g", "lny", "wa", "dwa", "dist", "dist_floor")])


@query("panel_report", on_profiles("SELECT count(*) AS n, count(DISTINCT entity) AS entities, min(t) AS first, max(t) AS last, (SELECT count(*) FROM pt) AS prototypes, count(*) FILTER (self) AS n_self, count(*) FILTER (overlap) AS n_overlap, round(avg((g >= q)::INT) FILTER (self), 6) + 0.0 AS top_of_self, round(avg(g) FILTER (overlap), 6) + 0.0 AS mean_overlap, round(avg(g) FILTER (NOT overlap), 6) + 0.0 AS mean_other, round(median(dist), 6) + 0.0 AS median_dist FROM smp, (SELECT quantile_cont(g, 0.9) AS q FROM smp)", SAMPLE))
def panel_report(spark, d):
    """How large the sample is and how much of it is its own prototype: counts, the share of such rows in the top decile of growth, mean growth with and without overlap."""
    s = sample(spark, d)
    top = s.agg(F.percentile("g", 0.9)).scalar()
    held = spaced_prototypes(spark, d).agg(F.count(F.lit(1))).scalar()
    when = lambda c, v: r6(F.avg(F.when(c, v)))
    return s.agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("entity").alias("entities"), F.min("t").alias("first"), F.max("t").alias("last"), held.alias("prototypes"), F.count(F.when(F.col("self"), 1)).alias("n_self"), F.count(F.when(F.col("overlap"), 1)).alias("n_overlap"),
        when(F.col("self"), (F.col("g") >= top).cast("int")).alias("top_of_self"), when(F.col("overlap"), F.col("g")).alias("mean_overlap"), when(~F.col("overlap"), F.col("g")).alias("mean_other"), r6(F.percentile("dist", 0.5)).alias("median_dist"),
    )


SURE, SMALL_GAIN, SMALL_R2, GAIN = 1.959964, 0.02, 0.03, (0.02, 0.10)
"""The standard errors of a two-sided level of 5 %, and what gains of fit count as small or as expected."""


def predictions_sql() -> str:
    parts = [spec_sql(f"all_{s}", "smp", xs, f"'{s}' AS spec") for s, xs in SPECS.items()]
    whole = holdout_sql()
    inner = whole[whole.index("tr AS (SELECT * FROM smp") : whole.rindex(") SELECT spec, n, ") + 1]
    body = whole[whole.rindex(" SELECT spec, n, ") + 1 :]
    ctes = ", ".join([SAMPLE, *[p[0] for p in parts], f"es AS ({' UNION ALL '.join(p[1] for p in parts)})", inner, f"ho AS ({body})"])
    term = lambda t, s="S3": f"(SELECT {{}} FROM es WHERE spec = '{s}' AND term = '{t}')"
    sure = lambda t: term(t).format(f"beta > 0 AND beta > {SURE} * se_dk")
    rows = [
        ("P6", "wa", sure("wa")), ("P6", "dwa", sure("dwa")), ("P7", "dist below 0", term("dist").format("beta < 0")),
        ("P7", "small gain of fit", f"(SELECT max(r2) FILTER (spec = 'S3') - max(r2) FILTER (spec = 'S1') < {SMALL_R2} FROM es)"),
        ("P7", "small gain held out", f"(SELECT vs_s1 < {SMALL_GAIN} FROM ho WHERE spec = 'S3')"), ("P8", "gain held out", f"(SELECT vs_s0 BETWEEN {GAIN[0]} AND {GAIN[1]} FROM ho WHERE spec = 'S1')"),
    ]
    told = " UNION ALL ".join(f"SELECT '{p}' AS prediction, '{c}' AS clause, {sql} AS ok" for p, c, sql in rows)
    return on_profiles("SELECT *, bool_and(ok) OVER (PARTITION BY prediction) AS met FROM told", f"{ctes}, told AS ({told})")


@query("panel_predictions", predictions_sql())
def panel_predictions(spark, d):
    """Which clauses of three predictions about the panel hold, and which predictions are met as a whole."""
    from pyspark.sql import Window

    es, ho = panel_specs(spark, d), panel_holdout(spark, d)
    term = lambda t: es.where((F.col("spec") == "S3") & (F.col("term") == t))
    sure = lambda t: term(t).agg(F.max((F.col("beta") > 0) & (F.col("beta") > SURE * F.col("se_dk"))))
    r2 = lambda s: F.max(F.when(F.col("spec") == s, F.col("r2")))
    of = lambda s: ho.where(F.col("spec") == s)
    rows = [
        ("P6", "wa", sure("wa")), ("P6", "dwa", sure("dwa")), ("P7", "dist below 0", term("dist").agg(F.max(F.col("beta") < 0))), ("P7", "small gain of fit", es.agg(r2("S3") - r2("S1") < SMALL_R2)),
        ("P7", "small gain held out", of("S3").agg(F.max(F.col("vs_s1") < SMALL_GAIN))), ("P8", "gain held out", of("S1").agg(F.max(F.col("vs_s0").between(*GAIN)))),
    ]
    told = None
    for p, c, frame in rows:
        new = frame.toDF("ok").select(F.lit(p).alias("prediction"), F.lit(c).alias("clause"), "ok")
        told = new if told is None else told.unionAll(new)
    return told.withColumn("met", F.min("ok").over(Window.partitionBy("prediction")))
