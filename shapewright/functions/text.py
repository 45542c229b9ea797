"""Text functions as columns: slugs, fuzzy scores, labels, deny lists, templates."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters of Latin-1 and their plain forms, one for one.
ACCENTED = "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝàáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
PLAIN = "AAAAAACEEEEIIIINOOOOOUUUUYaaaaaaceeeeiiiinooooouuuuyy"


def folded(text: Column) -> Column:
    return F.lower(F.translate(text, ACCENTED, PLAIN))


def slug(text: Column) -> Column:
    """Plain lower-case letters and digits, runs of anything else one hyphen, none at the ends."""
    return F.regexp_replace(F.regexp_replace(folded(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def matchable(text: Column) -> Column:
    """Folded, without apostrophes, trimmed: how a query and what it is held against are written."""
    return F.trim(F.regexp_replace(folded(text), "[\u2019'`]", ""))


def subsequence_span(query: Column, name: Column) -> Column:
    """From the first to the last place in name that holds query's characters in order, each found as early as can be; null where it has none."""
    found = lambda c, a: F.call_function("locate", c, name, a["at"] + 1)
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("first"))
    step = lambda a, c: F.struct(
        F.when(a["at"] < 0, -1).otherwise(F.when(found(c, a) > 0, found(c, a)).otherwise(-1)).alias("at"),
        F.when(a["first"] == 0, found(c, a)).otherwise(a["first"]).alias("first"),
    )
    end = F.aggregate(F.split(query, ""), start, step)
    return F.when(end["at"] > 0, end["at"] - end["first"])


def fuzzy_score(query: Column | str, name: Column, aliases: Column | list[Column] | None = None) -> Column:
    """100 equal to the name or an alias, 80 prefix, 70 prefix of a word, 60 prefix of an alias, 40 inside either, 10 to 20 in order with gaps; null for none.

    A query that is a str, with aliases as a list of columns or none, needs no arrays and is compiled: far faster for many rows.
    """
    if isinstance(query, str):
        return score_of(asked_text(query), matchable(name), [matchable(a) for a in aliases or []])
    q, n = matchable(query), matchable(name)
    others = F.transform(F.coalesce(aliases, F.array().cast("array<string>")) if aliases is not None else F.array().cast("array<string>"), matchable)
    some = lambda test: F.exists(others, test)
    span = F.array_min(F.array_compact(F.concat(F.array(subsequence_span(q, n)), F.transform(others, lambda a: subsequence_span(q, a)))))
    tight = 1 - (span - (F.length(q) - 1)) / F.greatest(F.length(n), F.lit(1))
    out = F.when(q == "", None).when((q == n) | some(lambda a: a == q), 100).when(F.startswith(n, q), 80)
    out = out.when(F.exists(F.split(n, r"[\s-]+"), lambda w: F.startswith(w, q)), 70).when(some(lambda a: F.startswith(a, q)), 60)
    out = out.when(F.contains(n, q) | some(lambda a: F.contains(a, q)), 40)
    return out.when((F.length(q) >= 2) & span.isNotNull(), 10 + F.round(10 * F.greatest(F.lit(0.0), tight))).cast("int")


def asked_text(query: str) -> str:
    """matchable() of a query at hand."""
    return re.sub("[\u2019'`]", "", query.translate(str.maketrans(ACCENTED, PLAIN)).lower()).strip(" ")


def score_of(q: str, n: Column, others: list[Column]) -> Column:
    """fuzzy_score() of matchable texts, without arrays. The pattern finds each character of q as early as can be, from the first one on."""
    if not q:
        return F.lit(None).cast("int")
    some = lambda test, *more: reduce(or_, [*more, *map(test, others)], F.lit(False))
    at = [f"\\x{{{ord(c):x}}}" for c in q]
    out = F.when(some(lambda a: a == q, n == q), 100).when(F.startswith(n, F.lit(q)), 80)
    if not re.search(r"[ \t\n\x0b\f\r-]", q):  # else no word holds it
        out = out.when(n.rlike(r"(?:^|[\s-])" + "".join(at)), 70)
    out = out.when(some(lambda a: F.startswith(a, F.lit(q))), 60).when(some(lambda a: F.contains(a, F.lit(q)), F.contains(n, F.lit(q))), 40)
    if len(q) > 1:
        pattern = at[0] + "".join(f"[^{c}]*{c}" for c in at[1:])
        spans = [F.when(x.rlike(pattern), F.length(F.regexp_extract(x, pattern, 0)) - 1) for x in (n, *others)]
        span = F.least(*spans) if others else spans[0]
        tight = 1 - (span - (len(q) - 1)) / F.greatest(F.length(n), F.lit(1))
        out = out.when(some(lambda a: a.rlike(pattern), n.rlike(pattern)), 10 + F.round(10 * F.greatest(F.lit(0.0), tight)))
    return out.cast("int")


def bin_label(pos: Column, bins: int = 10, width: int = 5) -> Column:
    k = pos % bins
    side = F.when(pos < bins, "O").otherwise("F")
    return F.concat(side, F.lit(" "), F.when(k == bins - 1, F.concat((k * width + 1).cast("string"), F.lit("+"))).otherwise(F.concat_ws("-", (k * width + 1).cast("string"), ((k + 1) * width).cast("string"))))


def starts(text: Column, word: str) -> Column:
    """Array of the places, from 1, of all occurrences of a word in any case, from left to right without overlap."""
    parts = F.split(text, r"(?iu)\Q" + word + r"\E")
    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<int>").alias("all"))
    step = lambda a, part: F.struct((a["at"] + F.length(part) + len(word)).alias("at"), F.concat(a["all"], F.array(a["at"] + F.length(part))).alias("all"))
    return F.aggregate(F.slice(parts, 1, F.size(parts) - 1), start, step)["all"]  # a part before each occurrence, and a last one behind


def hits(text: Column, words: list[str], reach: int = 30) -> Column:
    """Array of (word, context) for each occurrence of each word of a deny list, context the occurrence with reach characters around it."""
    context = lambda w: lambda at: F.struct(F.lit(w).alias("word"), F.substring(text, F.greatest(at - reach, F.lit(1)), F.lit(len(w) + 2 * reach)).alias("context"))
    return F.concat(*[F.transform(starts(text, w), context(w)) for w in words])


def restated(mode: Column, k: Column, floor: Column) -> Column:
    """A search in words."""
    return F.concat_ws(" · ", F.concat(F.lit("top "), k.cast("string")), F.when(mode == "same", "same year").when(mode == "any", "any year").otherwise(mode), F.when(floor > 0, F.concat(F.lit("at least "), floor.cast("string"))))
