"""Language identification by a string kernel.

The kernel of two texts compares which byte n-grams of 1, 2 and 3 bytes they hold (presence, not counts): for each length the
number of shared ones over the geometric mean of both numbers, averaged over the lengths. n-grams of one length are dealt into a
fixed number of buckets. A sample of LANDMARKS texts spans a Nyström approximation of the kernel, in which one ridge regression
for each language separates it from the rest.

The kernel against the landmarks is a product of presence rows with the landmarks' presence matrix, and the score a product of that
with the regression's weights; both matrices are multiplied once when the model is fitted, and texts are scored in batches by one
product of their presence rows with the result.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import append_columns, cut, place_of, quoted, remainder, slices

BUCKETS = (256, 4096, 32768)
"""Buckets of n-grams of 1, 2 and 3 bytes."""
WIDTH = sum(BUCKETS)
STARTS = np.cumsum([0, *BUCKETS])
PER_LANGUAGE = 400
"""Labelled rows wanted of each language for fitting, chosen by hash."""
MOST_ROWS = 4000
"""Bound on all rows used for fitting; with more than MOST_ROWS / PER_LANGUAGE languages each gets fewer."""
PLENTY = 8
"""Times as many keys as are wanted that the first thinning leaves; far more than an estimate of 5 % can err."""
LANDMARKS = 240
RIDGE = 1e-3
SHARPNESS = 4.0
BATCH = 64
"""Presence rows multiplied at once."""
UNKNOWN = "und"
WORDY = re.compile(r"[^\W\d_]")
A_LETTER = r"\p{L}"
FOLDS, HELD_OUT = 3, 1


def has_letter(text: str) -> bool:
    """Whether some character is a letter; fractions and other numerals, which also are word characters, are none."""
    return any(m[0].isalpha() for m in WORDY.finditer(text))


def mark(text: str, row: np.ndarray) -> None:
    """Sets the buckets of a text's n-grams in a row of zeros; then scales each length by the root of its number of buckets set."""
    a = np.frombuffer(text.lower().encode("utf-8", "replace"), np.uint8).astype(np.uint32)
    row[a] = 1
    if len(a) > 1:
        two = a[:-1] << 8 | a[1:]
        row[STARTS[1] + ((two * np.uint32(2654435761)) >> 20)] = 1
        if len(a) > 2:
            row[STARTS[2] + (((two[:-1] << 8 | a[2:]) * np.uint32(2654435761)) >> 17)] = 1


def scale(rows: np.ndarray) -> np.ndarray:
    for b, e in zip(STARTS[:-1], STARTS[1:], strict=True):
        n = rows[:, b:e].sum(axis=1, keepdims=True)
        rows[:, b:e] /= np.sqrt(np.maximum(n, 1) * len(BUCKETS))
    return rows


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray
    """[WIDTH, languages]: landmarks times regression."""
    bias: np.ndarray

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[float]]:
        """Language, score and likeness of each text.

        likeness is the best one-versus-rest value on a scale that is 0 for a text unlike all landmarks, whatever the number of
        languages, and about 1 for the texts learned from; with one language it is 1, as there is nothing to tell it from.
        """
        languages, scores, likeness = [UNKNOWN] * len(texts), [0.0] * len(texts), [0.0] * len(texts)
        known = [i for i, t in enumerate(texts) if t and has_letter(t)] if self.languages else []
        rows = np.zeros((min(BATCH, len(known)), WIDTH), np.float32)
        for at in range(0, len(known), BATCH):
            part = known[at : at + BATCH]
            rows[:] = 0
            for k, i in enumerate(part):
                mark(texts[i], rows[k])
            values = scale(rows)[: len(part)] @ self.weights + self.bias
            odds = np.exp(SHARPNESS * (values - values.max(axis=1, keepdims=True)))
            best = values.argmax(axis=1)
            for k, i in enumerate(part):
                languages[i] = self.languages[best[k]]
                likeness[i] = float((values[k, best[k]] - self.bias[best[k]]) / (1 - self.bias[best[k]])) if len(self.languages) > 1 else 1.0
                scores[i] = float(odds[k, best[k]] / odds[k].sum()) if len(self.languages) > 1 else float(np.clip(values[k, 0], 0, 1))
        return languages, scores, likeness


def fit_model(bits: list[bytes], labels: list[str]) -> Model:
    """The model of packed presence rows and their languages, rows in an order that doesn't depend on the language."""
    languages = sorted(set(labels))
    if not languages:
        return Model([], np.zeros((WIDTH, 0), np.float32), np.zeros(0, np.float32))
    unpack = lambda part: scale(np.unpackbits(np.frombuffer(b"".join(part), np.uint8).reshape(len(part), -1), axis=1, count=WIDTH).astype(np.float32))
    by_language = {x: [i for i, y in enumerate(labels) if y == x] for x in languages}
    share = max(1, LANDMARKS // len(languages))
    chosen = [i for x in languages for i in by_language[x][:share]]
    landmarks = unpack([bits[i] for i in chosen])
    values, vectors = np.linalg.eigh((landmarks @ landmarks.T).astype(np.float64))
    good = values > 1e-6 * values[-1]
    root = vectors[:, good] / np.sqrt(values[good])
    kernel = np.concatenate([unpack(bits[i : i + BATCH]) @ landmarks.T for i in range(0, len(bits), BATCH)]).astype(np.float64)
    features = kernel @ root
    targets = np.where(np.array(labels)[:, None] == np.array(languages)[None, :], 1.0, -1.0 if len(languages) > 1 else 0.0)
    weight = np.array([len(labels) / (len(languages) * len(by_language[x])) for x in labels])
    bias = np.average(targets, axis=0, weights=weight)
    gram = (features * weight[:, None]).T @ features + RIDGE * len(labels) * np.eye(features.shape[1])
    ridge = np.linalg.solve(gram, (features * weight[:, None]).T @ (targets - bias))
    return Model(languages, (landmarks.T @ (root @ ridge).astype(np.float32)).astype(np.float32), bias.astype(np.float32))


def learned_from(key: str) -> Column:
    """Rows that may be learned from."""
    return F.coalesce(remainder(quoted(key), FOLDS) != HELD_OUT, F.lit(False))


def fit(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """A model of a bounded sample of labelled rows: PER_LANGUAGE of each language, or fewer where MOST_ROWS would be exceeded.

    Only rows with a language and a letter whose key's crc32 modulo FOLDS isn't HELD_OUT are used, of each key and language one, so that
    a key of very many rows counts as any other and no language loses its share to another. The sample is chosen from narrow columns;
    its texts are turned into bits where they lie, and only these come to the driver, MOST_ROWS * WIDTH / 8 bytes at most.
    """
    labelled = df.where(learned_from(key) & quoted(lang).isNotNull() & quoted(text).rlike(A_LETTER)).select(quoted(key).cast("string").alias("key"), quoted(lang).alias("lang"), quoted(text).alias("text"))
    chosen = F.broadcast(cut(sampled(labelled.select("key", "lang", F.xxhash64("text").alias("h")))))  # MOST_ROWS rows at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[str, str]] = set()  # MOST_ROWS at most; a row's copies are passed over
        for whole in batches:
            for part in slices(whole, "text"):
                out = []
                for k, x, t in zip(*(part.column(c).to_pylist() for c in ("key", "lang", "text")), strict=True):
                    if (k, x) not in seen:
                        seen.add((k, x))
                        row = np.zeros(WIDTH, np.uint8)
                        if has_letter(t):
                            mark(t, row)
                        out.append((k, x, np.packbits(row).tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate((pa.string(), pa.string(), pa.binary()))], names=["key", "lang", "bits"])

    met = labelled.withColumn("h", F.xxhash64("text")).join(chosen, ["key", "lang", "h"], "left_semi").select("key", "lang", "text")
    rows = met.mapInArrow(run, "key string, lang string, bits binary").dropDuplicates(["key", "lang"])
    sample = rows.orderBy(F.xxhash64(F.lit("sample"), "key"), "key", "lang").toArrow()
    kept = [(b, x) for b, x in zip(sample.column("bits").to_pylist(), sample.column("lang").to_pylist(), strict=True) if any(b)]
    return fit_model([b for b, _ in kept], [x for _, x in kept])


def sampled(rows: DataFrame) -> DataFrame:
    """key, lang and h of the rows to learn from, by hash of the key: one row of a key, an equal share of MOST_ROWS for each language.

    Keys are thinned out by their hash before any are dealt out; their number in a language is estimated for that only, and PLENTY times as many
    as are wanted stay. Of a key's rows Spark's group limit lets one of each task pass.
    """
    order = F.xxhash64(F.lit("sample"), "key")
    about = rows.groupBy("lang").agg(F.approx_count_distinct("key", 0.05).alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_ROWS)  # more languages than rows have no share
    share = F.least(F.lit(PER_LANGUAGE), F.greatest(F.lit(1), F.floor(F.lit(MOST_ROWS) / about.agg(F.count(F.lit(1))).scalar())))
    chance = (order.bitwiseAND(F.lit((1 << 52) - 1)).cast("double") / float(1 << 52)) * F.col("n")
    near = rows.join(F.broadcast(about), "lang").where(chance < PLENTY * (share + PLENTY)).select("key", "lang", "h", order.alias("o"))
    first = lambda of, by, at, n: of.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*at))).where(F.col("_n") <= n).drop("_n")
    one = first(near, ["key", "lang"], ["h"], 1)
    return first(one, ["lang"], ["o", "key"], share).orderBy("o", "key", "lang").limit(MOST_ROWS).select("key", "lang", "h")


def identify(df: DataFrame, model: Model, text: str = "text", names: tuple[str, ...] = ("lang_pred", "score")) -> DataFrame:
    """df with lang_pred, score and, where a third name is given, likeness of its text, under these names.

    lang_pred is a language of the model, or `und` with score 0 where the text is null or has no letter, or the model has learned
    nothing. Whole texts are read. Ties go to the language that comes first by name. Rows stay as they are; columns named like the
    new ones are replaced. No row is moved.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)  # WIDTH * languages floats; its size doesn't follow the rows
    kinds = (pa.string(), pa.float64(), pa.float64())[: len(names)]

    def make() -> Callable[[list], list[pa.Array]]:
        own = shared.value
        return lambda texts: [pa.array(x, kind) for x, kind in zip(own.predict(texts), kinds, strict=False)]

    fields = [T.StructField(n, T.StringType() if i == 0 else T.DoubleType()) for i, n in enumerate(names)]
    return append_columns(df, text, make, fields)


def identified_documents(docs: DataFrame) -> DataFrame:
    """op5: the language of every document. A null doc_id has no remainder: it is neither learned from nor held out."""
    out = identify(docs.select("doc_id", "text"), fit(docs))
    return out.select("doc_id", F.coalesce(remainder(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), "lang_pred", "score")


LEAST_LIKENESS = 0.15
"""Texts less alike to every learned language than this are of none of them. Chosen by folds of the rows that may be learned from: one in
a thousand of a fold's texts lies below it for the model of the others, and of a language that is left out 13 to 94 % of the texts do."""


def keep_known(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of docs that are of a learned language, by LEAST_LIKENESS; columns as in docs, whatever their names.

    Null texts and those without a letter go; where no language could be learned, all go.
    """
    names = docs.columns
    inner = docs.toDF(*[f"c{i}" for i in range(len(names))])
    told = identify(inner, fit(docs, text=text), f"c{place_of(docs, text)}", ("told", "score", "likeness"))
    return told.where((F.col("told") != UNKNOWN) & (F.col("likeness") >= LEAST_LIKENESS)).drop("told", "score", "likeness").toDF(*names)
