"""Quality rules: robust multivariate outliers.

Each text gives counts of words, symbols, repeated lines and repeated three-word windows, and from them a transformed vector of DIM
statistics. Per language and source, a minimum-covariance-determinant estimate of location and scatter is made by concentration
steps from two starts: the distances are ranked, the nearest share H of the group gives the next mean and covariance, and when the
determinants no longer change the start with the smaller one wins and is reweighted. A text is rejected if its Mahalanobis distance
is beyond CUTOFF, or if it fails the base rule.

Every language and source has its own estimate, whatever its size: in each step its moments are joined by those of PRIOR rows like
its language's, and these by those of PRIOR rows like all. So a group of few rows leans on its language and a large one hardly does,
without a size at which one way changes to the other.

The main path has DataFrame functions only. Texts are read once and not moved; the statistics are kept in the shared folder, and
every later step aggregates them by group with partial sums, so that a hot group is no hot task. What is joined back to rows are one
row for each group. Quantiles are taken from counts of fine bins, which are the same however the rows are dealt out.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cut, quoted, released

WORD_BREAK = r"[\x20\x09-\x0D]+"
SYMBOLS = "[#*$%&|<>]"
STATS = ("x0", "x1", "x2", "x3")
DIM = len(STATS)
H = 0.75
MOST_STEPS = 8
STEADY = 1e-3
"""Largest change of a logarithm of a determinant that ends the concentration steps."""
PRIOR = 40.0
"""Rows that a group's estimate borrows from its language's, and a language's from that of all rows."""
FLOOR = (0.06, 0.08, 0.08, 0.08)
"""Least standard deviation of each statistic; keeps the scatter regular where a statistic hardly varies."""
FINE = 4096.0
"""Bins of a unit of a statistic, for the quantiles that the starts are scaled by."""
OCTAVE = 64.0
"""Bins of a doubling of squared distance, for the nearest share."""
FEW_GROUPS = 20_000
"""Up to so many groups, of under 400 bytes each, are broadcast."""
SALTS = 32


def chi2(x: float, dim: int) -> float:
    """Distribution function of chi-square for an even number of degrees of freedom."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(dim // 2))


def chi2_quantile(p: float, dim: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if chi2(middle, dim) < p else (low, middle)
    return high


CONSISTENCY = H / chi2(chi2_quantile(H, DIM), DIM + 2)
REWEIGHT = chi2_quantile(0.975, DIM)
CUTOFF = 2.5 * chi2_quantile(0.999, DIM)
"""Squared distance beyond which a text is rejected: the 0.999 quantile for normal data, times 2.5 for tails longer than normal ones."""


def counts(df: DataFrame, text: str = "text") -> DataFrame:
    """df with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) and n_capitals of its text."""
    t = F.coalesce(F.col(text), F.lit(""))
    out = df.withColumn("_t", t).withColumn("_w", F.array_remove(F.split("_t", WORD_BREAK), ""))
    lines = F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = out.withColumns({
        "_n": F.size("_w"),
        "_l": lines,
        "_h": F.transform("_w", lambda w: F.xxhash64(w)),
        "word_chars": F.length(F.array_join("_w", "")).cast("long"),
        "n_symbols": F.regexp_count("_t", F.lit(SYMBOLS)).cast("long"),
        "n_capitals": F.length(F.regexp_replace("_t", "[^A-Z!]+", "")).cast("long"),
    })
    out = out.withColumns({
        "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"),
        # a window's hash; its place goes into the low bits of a copy, so that one sort of longs brings equal windows together
        "_g": F.when(F.col("_n") >= 3, F.transform(F.sequence(F.lit(0), F.col("_n") - 3), lambda i: F.xxhash64(F.get("_h", i), F.get("_h", i + 1), F.get("_h", i + 2)))),
        "_m": F.call_function("shiftleft", F.lit(1).cast("long"), F.ceil(F.log2(F.col("_n") + 1.0)).cast("int")) - 1,
    })
    out = out.withColumn("_some", F.coalesce(F.size(F.array_distinct("_g")) < F.size("_g"), F.lit(False)))
    out = out.withColumn("_s", F.when(F.col("_some"), F.sort_array(F.transform("_g", lambda h, i: h.bitwiseAND(F.bitwise_not("_m")).bitwiseOR(i.cast("long"))))))
    at = lambda x: F.get("_g", x.bitwiseAND(F.col("_m")).cast("int"))
    # where two windows differ only in the bits that places took, whole hashes are sorted instead
    high = lambda x: x.bitwiseAND(F.bitwise_not("_m"))
    mixed = F.size(F.array_distinct(F.transform("_s", high))) < F.size(F.array_distinct("_g"))
    out = out.withColumn("_s", F.when(mixed, F.transform(F.sort_array(F.transform("_g", lambda h, i: F.struct(h.alias("h"), i.cast("long").alias("i")))), lambda x: x["i"])).otherwise(F.col("_s")))
    out = out.withColumn("_p", F.when(F.col("_some"), F.filter("_s", lambda x, i: (at(x) == at(F.get("_s", i - 1))) | (at(x) == at(F.get("_s", i + 1))))))
    place = lambda k: F.transform("_p", lambda x: (x.bitwiseAND(F.col("_m")) + k).cast("int"))
    covered = F.size(F.array_distinct(F.concat(place(0), place(1), place(2))))
    out = out.withColumns({"n_words": F.col("_n").cast("long"), "n_repeat_words": F.when(F.col("_some"), covered).otherwise(0).cast("long")})
    return out.drop("_t", "_w", "_n", "_l", "_h", "_g", "_m", "_some", "_s", "_p")


def statistics() -> dict[str, Column]:
    """The transformed vector: log of the mean word length, root of symbols a word, and angles of the shares of repeated words and of capitals."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    share = lambda c: F.asin(F.sqrt(F.least(F.col(c) / F.greatest(F.col("word_chars" if c == "n_capitals" else "n_words"), F.lit(1)), F.lit(1.0))))
    return {"x0": F.log(F.greatest(F.col("word_chars"), F.lit(1)) / n), "x1": F.sqrt(F.col("n_symbols") / n), "x2": share("n_repeat_words"), "x3": share("n_capitals")}


def attached(rows: DataFrame, small: DataFrame, keys: list[str], few: bool) -> DataFrame:
    """rows joined with one row for each group: broadcast where groups are few, else with groups dealt out over SALTS parts each.

    A row's part is its stored column salt, so that rows recomputed after a loss go where they went before.
    """
    if few:
        return rows.join(F.broadcast(small), keys)  # FEW_GROUPS rows at most, counted before
    salted = small.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.join(salted, [*keys, "salt"])


SUMS = [(a, b) for i, a in enumerate(STATS) for b in STATS[: i + 1]]
GROUP = ["g", "level", "parent"]


def moments(inside: Column) -> list[Column]:
    """Number, means and mean products of the rows inside; a group that has none keeps its row, with 0."""
    mean = lambda c, name: F.coalesce(F.avg(F.when(inside, c)), F.lit(0.0)).alias(name)
    return [F.count(F.when(inside, 1)).cast("double").alias("n"), *[mean(F.col(a), f"m_{a}") for a in STATS], *[mean(F.col(a) * F.col(b), f"s_{a}{b}") for a, b in SUMS]]


def borrowed(sums: DataFrame) -> DataFrame:
    """Moments by g, level, parent and start; each level's joined by PRIOR rows of its parent's, from the top."""
    names = [*[f"m_{a}" for a in STATS], *[f"s_{a}{b}" for a, b in SUMS]]
    above = out = sums.where("level = 0")
    for level in (1, 2):
        upper = above.select(F.col("g").alias("parent"), "start", *[F.col(c).alias(f"up_{c}") for c in names])
        met = sums.where(F.col("level") == level).join(upper, ["parent", "start"])
        above = met.select(*GROUP, "start", "n", *[((F.col("n") * F.col(c) + PRIOR * F.col(f"up_{c}")) / (F.col("n") + PRIOR)).alias(c) for c in names])
        out = out.unionByName(above)
    return out


def factored(sums: DataFrame, scale: float) -> DataFrame:
    """g, start, n, means, the Cholesky factor l_ij of the scaled covariance with FLOOR, and the logarithm of its determinant."""
    out = borrowed(sums)
    for i in range(DIM):
        for j in range(i + 1):
            a, b = STATS[i], STATS[j]
            cov = scale * (F.col(f"s_{a}{b}") - F.col(f"m_{a}") * F.col(f"m_{b}"))
            out = out.withColumn(f"l_{i}{j}", F.greatest(cov, F.lit(0.0)) + FLOOR[i] ** 2 if i == j else cov)
    for j in range(DIM):
        for i in range(j, DIM):
            v = F.col(f"l_{i}{j}") - sum((F.col(f"l_{i}{k}") * F.col(f"l_{j}{k}") for k in range(j)), F.lit(0.0))
            out = out.withColumn(f"l_{i}{j}", F.sqrt(F.greatest(v, F.lit(1e-9))) if i == j else v / F.col(f"l_{j}{j}"))
    det = sum((2 * F.log(f"l_{i}{i}") for i in range(DIM)), F.lit(0.0))
    return out.select("g", "start", "n", *[f"m_{a}" for a in STATS], *[f"l_{i}{j}" for i in range(DIM) for j in range(i + 1)], det.alias("log_det"))


def distances(rows: DataFrame, estimates: DataFrame, keys: list[str], few: bool, name: str = "d2") -> DataFrame:
    """rows with their squared Mahalanobis distance to their group's estimate."""
    out = attached(rows, estimates, keys, few)
    for i in range(DIM):
        z = F.col(STATS[i]) - F.col(f"m_{STATS[i]}") - sum((F.col(f"l_{i}{k}") * F.col(f"_z{k}") for k in range(i)), F.lit(0.0))
        out = out.withColumn(f"_z{i}", z / F.col(f"l_{i}{i}"))
    total = sum((F.col(f"_z{i}") * F.col(f"_z{i}") for i in range(DIM)), F.lit(0.0))
    return out.select(*rows.columns, total.alias(name))


def octave(d2: Column) -> Column:
    return F.floor(OCTAVE * F.log2(F.greatest(d2, F.lit(1e-9)))).cast("int")


def concentrate(distance: DataFrame, few: bool) -> DataFrame:
    """Moments of each group's share H of rows that are nearest, up to the first bin of distance that reaches it.

    The exact quantile of bins keeps a count of each bin, some hundreds at most, and merges what each task has counted.
    """
    keys = ["g", "start"]
    binned = distance.withColumn("bin", octave(F.col("d2")))
    limits = binned.groupBy(*keys).agg(F.expr(f"percentile_disc({H}) WITHIN GROUP (ORDER BY bin)").alias("limit"))
    return cut(attached(binned, limits, keys, few).groupBy(*GROUP, "start").agg(*moments(F.col("bin") <= F.col("limit"))))


def refined(sums: DataFrame) -> DataFrame:
    """Estimates of kept moments, kept in their place: each later plan reads one row for each group and start and nothing before it."""
    found = cut(factored(sums, CONSISTENCY))
    released(sums)
    return found


def estimate(rows: DataFrame, few: bool) -> DataFrame:
    """Reweighted minimum-covariance-determinant estimates by the column g of rows."""
    fine = lambda a: F.floor(F.col(a) * FINE).cast("int")
    first = cut(rows.groupBy("g").agg(*[F.percentile(fine(a), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(f"q_{a}") for a in STATS]))
    scaled = attached(rows, first, ["g"], few)
    at = lambda a, i: (F.get(f"q_{a}", F.lit(i)) + 0.5) / FINE
    z = [(F.col(a) - at(a, 1)) / F.greatest((at(a, 2) - at(a, 0)) / 1.349, F.lit(f)) for a, f in zip(STATS, FLOOR, strict=True)]
    # start 0 ranks by the sum of squared robust scores, start 1 by their largest, which another half of the group may lead
    starts = F.array(F.struct(F.lit(0).alias("start"), sum((c * c for c in z), F.lit(0.0)).alias("d2")), F.struct(F.lit(1).alias("start"), F.greatest(*[F.abs(c) for c in z]).alias("d2")))
    begun = scaled.select(*GROUP, "salt", *STATS, F.inline(starts))
    both = rows.select(*GROUP, "salt", *STATS, F.explode(F.array(F.lit(0), F.lit(1))).alias("start"))
    found = refined(concentrate(begun, few))
    for _ in range(MOST_STEPS - 1):
        last, found = found, refined(concentrate(distances(both, found, ["g", "start"], few), few))
        spread = found.unionAll(last).groupBy("g", "start").agg((F.max("log_det") - F.min("log_det")).alias("moved"))
        moved = spread.agg(F.max("moved")).first()[0]
        released(last)
        if moved is None or moved < STEADY:
            break
    best = found.groupBy("g").agg(F.min_by(F.struct(*[c for c in found.columns if c not in ("g", "start")]), F.struct("log_det", "start")).alias("e")).select("g", "e.*")
    last = distances(rows.select(*GROUP, "salt", *STATS), best, ["g"], few).withColumn("start", F.lit(0))
    return cut(factored(cut(last.groupBy(*GROUP, "start").agg(*moments(F.col("d2") <= REWEIGHT))), 0.975 / chi2(REWEIGHT, DIM + 2)))


def judge(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """doc_id (the key), the six counts, base_failed, d2 and kept for each row of df.

    base_failed: fewer than 50 words, or over half of them in repeated windows. Such rows take no part in estimates; the others are
    kept unless d2 is beyond CUTOFF. A null text counts as empty and fails. A null language or source is a group of its own. A group
    whose rows are all equal, or that has one row only, has a scatter borrowed from its language's. Rows with equal or null keys are
    rows like others. Other columns are not read. An empty table gives an empty one.
    """
    name = lambda c: F.coalesce(F.concat(F.lit("="), quoted(c).cast("string")), F.lit("-"))
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    measured = counts(df.select(quoted(key).alias("doc_id"), quoted(text).alias("text"), name(lang).alias("_lang"), name(source).alias("_source"))).drop("text")
    salt = F.floor(F.rand(7) * SALTS).cast("int")  # drawn before the cut, never again
    measured = cut(measured.withColumn("base_failed", base).withColumn("salt", salt).withColumns(statistics()))
    good = measured.where("NOT base_failed")
    every, by_lang = F.lit("*"), F.concat(F.length("_lang").cast("string"), F.lit(":"), "_lang")
    own = F.concat(by_lang, F.lit("/"), "_source")
    level = lambda i, g, parent: F.struct(F.lit(i).alias("level"), g.alias("g"), parent.alias("parent"))
    rows = good.select(F.inline(F.array(level(0, every, F.lit("")), level(1, by_lang, every), level(2, own, by_lang))), "salt", *STATS)
    few = rows.select("g").distinct().count() <= FEW_GROUPS
    far = distances(good.select("doc_id", own.alias("g"), "salt", *COUNTS, "base_failed", *STATS), estimate(rows, few), ["g"], few).select("doc_id", *COUNTS, "base_failed", "d2")
    failed = measured.where("base_failed").select("doc_id", *COUNTS, "base_failed", F.lit(None).cast("double").alias("d2"))
    return far.unionAll(failed).withColumn("kept", ~F.col("base_failed") & (F.col("d2") <= CUTOFF))


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_capitals")


def judged_documents(docs: DataFrame) -> DataFrame:
    """op3: every document judged."""
    return judge(docs).select("doc_id", *COUNTS[:5], "base_failed", "kept", "d2")
