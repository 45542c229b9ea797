"""Toxicity by weak supervision.

Many voters, each a lexicon entry, a word stem or a pattern over a whole text, vote for one of two labels or abstain. A generative
label model is estimated by expectation maximisation from a first guess by the voters alone: for each voter and class the rate at which it
fires, from which its accuracy follows, and for pairs of voters that depend on each other within a class, joined into a forest, the
rate at which both fire, so that what a voter repeats of another counts once. The model's posteriors label the sample on which a
sparse linear classifier of word stems and patterns is trained; only the classifier is used on documents. As the classifier is
linear in a text's distinct words, a worker computes each distinct word's weight once.

No lexicon is at hand for every language of a corpus, so entries beside the fixed ones are induced from the labelled rows that may
be learned from. Labels do no more than that and give the prior: the label model never sees them.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import append_columns, cut, quoted, remainder, slices

FOLDS, HELD_OUT = 5, 0
PER_LABEL = 6000
"""Labelled rows of each label used for fitting at most, chosen by hash."""
TEXTS_OF_KEY = 1
"""Documents of one key used for fitting."""
FEATURES = 6000
"""Stems kept for fitting, by how far their shares of toxic and other rows differ."""
LEAST_ROWS = 4
"""Rows of the sample that a stem must be in."""
VOTERS = 96
"""Voters of label 1 at most."""
VOTER_PRECISION = 0.9
"""Least share of toxic rows of a lexicon entry's, when SUPPORT rows like all are added to them."""
SUPPORT = 0.5
DEPENDENT = 0.2
"""Least correlation inside the classes of two voters that are joined."""
STEMS = (3, 4, 5, 6)
"""Lengths of word beginnings that are features beside whole words."""
ROUNDS = 60
L1 = 2e-4
STEPS = 400
MEMO = 400_000
WORD = re.compile(r"[^\W\d_]+")
INSULTS = frozenset(
    (
        "idiot idiots moron morons stupid dumb fool loser losers scum trash garbage pathetic worthless disgusting clown filthy vermin ugly hate "
        "abschaum dreckig dummkopf dumm ekelhaft hässlich idioten trottel versager widerlich wertlos "
        "abruti abrutis crétin crétins débile dégoûtant imbécile imbéciles minable ordure ordures pathétique "
        "asco asqueroso basura escoria estúpido estúpidos idiota idiotas imbécil imbéciles inútil patético"
    ).split()
)
"""A lexicon of the four languages that needs no labels."""
PATTERNS = {
    "\x01you-are": re.compile(r"\b(?:you(?:'re| are)\s+(?:an?|such|so|the)|du bist\s+(?:ein|eine|so)|tu es\s+(?:un|une|si)|eres\s+(?:un|una|tan))\s+\w+", re.I),
    "\x01shut-up": re.compile(r"\b(?:shut\s+up|halt die klappe|ta gueule|ferme-la|cállate)\b", re.I),
    "\x01shouted": re.compile(r"(?:\b[^\W\d_a-z]{4,}\b\W+){4}"),
    "\x01marks": re.compile(r"[!?]{3}"),
}
ADDRESS = "you your yours du dich dir dein deine ihr euch tu te toi ton vous votre tú ti usted ustedes vosotros"
COURTESY = "please thanks thank sorry welcome bitte danke entschuldigung merci pardon bienvenue gracias perdón bienvenido"
CALM_PATTERNS = {
    "\x01impersonal": re.compile(rf"\A(?!.*\b(?:{ADDRESS.replace(' ', '|')})\b)", re.I | re.S),
    "\x01courteous": re.compile(rf"\b(?:{COURTESY.replace(' ', '|')})\b", re.I),
}
"""Patterns that vote 0: nobody is addressed, a word of courtesy. They are voters only, no features of the classifier."""


def stems(word: str) -> list[str]:
    return [word[:n] + "*" for n in STEMS if len(word) > n] + [word]


def words_of(text: str | None) -> set[str]:
    """Distinct lower-cased words of a text, with a mark for each pattern it holds and for two or more words of the lexicon."""
    if not text:
        return set()
    out = set(WORD.findall(text.lower()))
    if len(out & INSULTS) > 1:
        out.add("\x01insults")
    return out


def features_of(text: str | None) -> set[str]:
    out = {s for w in words_of(text) for s in (stems(w) if w[0] != "\x01" else [w])}
    return out | {name for name, p in (PATTERNS | CALM_PATTERNS).items() if text and p.search(text)}


@dataclass
class Classifier:
    """score = logistic(bias + weights of distinct words' stems and of patterns)."""

    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -20.0
    memo: dict[str, float] = field(default_factory=dict, repr=False)

    def weight(self, word: str) -> float:
        if len(self.memo) >= MEMO:
            self.memo.clear()
        get = self.weights.get
        got = self.memo[word] = sum(get(s, 0.0) for s in stems(word)) if word[0] != "\x01" else get(word, 0.0)
        return got

    def score(self, text: str | None) -> float:
        get, weight = self.memo.get, self.weight
        total = self.bias
        for w in words_of(text):
            x = get(w)
            total += weight(w) if x is None else x
        for name, p in PATTERNS.items():
            if name in self.weights and text and p.search(text):
                total += self.weights[name]
        return float(1 / (1 + np.exp(-np.clip(total, -500, 500))))


@dataclass
class Rows:
    """Sets of feature numbers, one for each row."""

    at: np.ndarray
    ends: np.ndarray
    width: int

    @classmethod
    def of(cls, lists: list[list[int]], width: int) -> Rows:
        ends = np.cumsum([0, *map(len, lists)])
        return cls(np.fromiter((i for x in lists for i in x), np.int64, ends[-1]), ends, width)

    @property
    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.ends) - 1), np.diff(self.ends))

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.owner, w[self.at], len(self.ends) - 1)

    def back(self, r: np.ndarray) -> np.ndarray:
        return np.bincount(self.at, r[self.owner], self.width)


def choose_voters(rows: Rows, toxic: np.ndarray, wanted: np.ndarray) -> list[int]:
    """Up to VOTERS of the wanted feature numbers; each adds the most toxic rows that have fewer than three voters."""
    good, need, chosen = wanted.copy(), np.where(toxic, 3.0, 0.0), []
    owner = rows.owner
    while len(chosen) < VOTERS:
        gain = np.where(good, rows.back((need > 0).astype(float)), 0)
        best = int(gain.argmax())
        if gain[best] < 2:
            break
        chosen.append(best)
        good[best] = False
        need[owner[rows.at == best]] -= 1
    return chosen


def first_guess(votes: np.ndarray, label: np.ndarray, prior: float) -> np.ndarray:
    """Probabilities to start from, by the voters alone: likely 1 where any votes 1, else likely 0 where any votes 0, else the prior."""
    return np.where((votes[:, label == 1] > 0).any(axis=1), 0.9, np.where((votes[:, label == 0] > 0).any(axis=1), 0.1, prior))


def joined(votes: np.ndarray, p: np.ndarray, one: np.ndarray, zero: np.ndarray) -> np.ndarray:
    """[edges, 2]: a forest of the voters whose correlation inside the classes is largest, DEPENDENT at least (Kruskal)."""
    centred = votes - (p[:, None] * one + (1 - p[:, None]) * zero)
    cov = centred.T @ centred / len(votes)
    sd = np.sqrt(np.maximum(np.diag(cov), 1e-9))
    corr = np.triu(cov / np.outer(sd, sd), 1)
    root, edges = list(range(votes.shape[1])), []

    def top(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    i, j = np.nonzero(corr > DEPENDENT)
    for k in np.argsort(-corr[i, j], kind="stable"):
        a, b = top(int(i[k])), top(int(j[k]))
        if a != b:
            root[b] = a
            edges.append((int(i[k]), int(j[k])))
    return np.array(edges, int).reshape(-1, 2)


def posteriors(votes: np.ndarray, label: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Probability of label 1 by the label model for each row of votes [rows, voters] of 0 and 1; rates [2, voters], edges and what each adds.

    label: what a voter votes for. A voter that stays silent abstains, as an entry of one language says nothing of a text in another;
    that all voters of label 1 are silent is a voter for label 0, the last of what is counted. A row's evidence is the sum of its
    voters' log ratios of rates, and for each edge whose two voters fire, of how much more often than by chance both do; this takes
    back one voter's evidence at most, without which the model may drift to classes that are not the voters'.
    """
    silent = ~(votes[:, label == 1] > 0).any(axis=1, keepdims=True)
    votes, label = np.concatenate((votes, silent), axis=1).astype(float), np.append(label, 0)
    p = first_guess(votes, label, prior)
    edges, both = np.zeros((0, 2), int), np.zeros((len(votes), 0))
    for round_ in range(ROUNDS):
        n1, n0 = p.sum() + 1, (1 - p).sum() + 1
        one, zero = (votes.T @ p + 0.5) / n1, (votes.T @ (1 - p) + 0.05) / n0
        if round_ % 10 == 5:
            edges = joined(votes, p, one, zero)
            both = votes[:, edges[:, 0]] * votes[:, edges[:, 1]]
        one2, zero2 = (both.T @ p + 0.5) / n1, (both.T @ (1 - p) + 0.05) / n0
        i, j = edges.T
        alone = np.log(one / zero)
        most = np.minimum(np.abs(alone[i]), np.abs(alone[j]))
        added = np.clip(np.log(one2 / (one[i] * one[j])) - np.log(zero2 / (zero[i] * zero[j])), -most, most)
        logit = np.log(prior / (1 - prior)) + votes @ alone + both @ added
        p = 1 / (1 + np.exp(-np.clip(logit, -500, 500)))
    return p, np.stack((zero, one)), edges, added


def train(rows: Rows, targets: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression with an L1 penalty on probabilities, by accelerated proximal steps; classes weigh alike."""
    share = np.clip(targets.mean(), 1e-3, 1 - 1e-3)
    sample = np.where(targets >= 0.5, 0.5 / share, 0.5 / (1 - share)) / len(targets)
    w, bias = np.zeros(rows.width), -1.0
    look, look_bias, t = w.copy(), bias, 1.0
    norm = np.sqrt(np.maximum(rows.back(np.ones(len(targets))), 1) / len(targets))
    step = 4.0 / (1 + max(1.0, float(rows.times(np.ones(rows.width)).mean())) / 20)
    for _ in range(STEPS):
        wrong = sample * (1 / (1 + np.exp(-np.clip(rows.times(look) + look_bias, -500, 500))) - targets)
        moved = look - step * rows.back(wrong)
        new = np.sign(moved) * np.maximum(np.abs(moved) - step * L1 * (1 + 20 * norm), 0)
        new_bias, new_t = look_bias - step * float(wrong.sum()), (1 + np.sqrt(1 + 4 * t * t)) / 2
        look, look_bias = new + (t - 1) / new_t * (new - w), new_bias + (t - 1) / new_t * (new_bias - bias)
        w, bias, t = new, new_bias, new_t
    return w, bias


def fit_classifier(names: list[str], lists: list[list[int]], toxic: list[int], clean_weight: float = 1.0) -> Classifier:
    """The classifier from the features of labelled rows; clean_weight: how many clean rows one of the sample stands for, over the same of toxic ones."""
    y = np.array(toxic, bool)
    if not names or not y.any() or y.all():
        return Classifier(bias=20.0 if len(y) and y.all() else -20.0)
    rows = Rows.of(lists, len(names))
    mean = float(y.mean())
    hits, misses = rows.back(y.astype(float)), rows.back((~y).astype(float)) * clean_weight
    share = mean / (mean + (1 - mean) * clean_weight)
    named = np.array([n in CALM_PATTERNS for n in names])
    toxic = choose_voters(rows, y, ((hits + SUPPORT * share) / (hits + misses + SUPPORT) >= VOTER_PRECISION) & (hits >= LEAST_ROWS) & ~named)
    calm = np.flatnonzero(named).tolist()
    if not toxic:
        return Classifier()
    voters = toxic + calm
    place = np.full(len(names), -1)
    place[voters] = np.arange(len(voters))
    own = place[rows.at] >= 0
    votes = np.zeros((len(y), len(voters)))
    votes[rows.owner[own], place[rows.at[own]]] = 1
    labels, *_ = posteriors(votes, np.repeat([1, 0], [len(toxic), len(calm)]), float(np.clip(mean, 0.01, 0.99)))
    keep = ~named[rows.at]
    owner = rows.owner[keep]
    rows = Rows(rows.at[keep], np.searchsorted(owner, np.arange(len(y) + 1)), rows.width)
    w, bias = train(rows, labels)
    return Classifier({names[i]: float(w[i]) for i in np.flatnonzero(w)}, float(bias))


def learnable(labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """key and toxic of each labelled key that may be learned from; a key with both labels counts as toxic."""
    open_ = F.coalesce(remainder(F.col("key"), FOLDS) != HELD_OUT, F.lit(False))
    return labels.where(F.col("toxic").isin(0, 1)).groupBy(quoted(key).cast("string").alias("key")).agg(F.max("toxic").cast("int").alias("toxic")).where(open_)


def sampled(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, h, text and toxic of documents of PER_LABEL labelled keys of each label at most, by hash of the key; never of held-out keys.

    Of the documents of a key the TEXTS_OF_KEY with the least h, a hash of the text, are used, so that a key of very many documents
    counts as any other.
    """
    known = learnable(labels, key)
    order = F.xxhash64(F.lit("sample"), "key")
    keyed = docs.select(quoted(key).cast("string").alias("key"), quoted(text).alias("text")).withColumn("h", F.xxhash64("text"))
    there = known.join(keyed.select("key").distinct(), "key", "left_semi")
    part = lambda y: there.where(F.col("toxic") == y).orderBy(order, "key").limit(PER_LABEL)
    chosen = F.broadcast(part(0).unionAll(part(1)))  # 2 * PER_LABEL rows at most
    of_key = F.row_number().over(Window.partitionBy("key").orderBy("h"))
    rows = cut(keyed.select("key", "h").join(chosen, "key").withColumn("n", of_key).where(F.col("n") <= TEXTS_OF_KEY).drop("n"))
    return keyed.join(F.broadcast(rows), ["key", "h"])


def fit(docs: DataFrame, labels: DataFrame) -> Classifier:
    """A classifier from a bounded sample of labelled rows; FEATURES names and the sample's feature numbers come to the driver."""

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[str, int]] = set()  # as many as the sample has rows; a row's copies are passed over
        for whole in batches:
            for part in slices(whole, "text"):
                rows = [r for r in part.to_pylist() if not ((r["key"], r["h"]) in seen or seen.add((r["key"], r["h"])))]
                yield pa.RecordBatch.from_pylist([r | {"f": sorted(features_of(r.pop("text")))} for r in rows], pa.schema([("key", pa.string()), ("h", pa.int64()), ("toxic", pa.int32()), ("f", pa.list_(pa.string()))]))

    found = sampled(docs, labels).select("key", "h", "text", "toxic").mapInArrow(words, "key string, h long, toxic int, f array<string>")
    marked = cut(found.groupBy("key", "h").agg(F.first("toxic").alias("toxic"), F.first("f").alias("f")))
    sizes = dict(marked.groupBy("toxic").count().collect())
    share = F.sum("toxic") / max(1, sizes.get(1, 0)) - F.sum(1 - F.col("toxic")) / max(1, sizes.get(0, 0))
    counted = marked.select("toxic", F.explode("f").alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.abs(share).alias("d")).where(F.col("n") >= LEAST_ROWS)
    names = [r[0] for r in counted.orderBy(F.desc("d"), "name").limit(FEATURES).select("name").collect()]
    number = marked.sparkSession.sparkContext.broadcast({x: i for i, x in enumerate(names)})  # FEATURES names

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [[number.value[x] for x in f if x in number.value] for f in b.column("f").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("toxic"), pa.array(own, pa.list_(pa.int32()))], names=["toxic", "f"])

    found = marked.mapInArrow(numbered, "toxic int, f array<int>").toArrow()
    order = sorted(zip(found.column("f").to_pylist(), found.column("toxic").to_pylist(), strict=True))
    whole = dict(learnable(labels).groupBy("toxic").count().collect())
    taken = {y: max(1, min(PER_LABEL, whole.get(y, 0))) for y in (0, 1)}
    weight = (whole.get(0, 0) / taken[0]) / max(1.0, whole.get(1, 0) / taken[1])
    return fit_classifier(names, [f for f, _ in order], [y for _, y in order], max(weight, 1e-6))


def score_toxicity(df: DataFrame, classifier: Classifier, text: str = "text") -> DataFrame:
    """df with score (0 to 1) and predicted (1 from 0.5) of its text.

    Null and empty texts get the classifier's bias. Rows stay as they are; columns named like the new ones are replaced. No row is moved.
    """
    shared = df.sparkSession.sparkContext.broadcast(classifier)  # FEATURES weights at most

    def make() -> Callable[[list], list[pa.Array]]:
        own = Classifier(shared.value.weights, shared.value.bias)

        def step(texts: list) -> list[pa.Array]:
            scores = [own.score(t) for t in texts]
            return [pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())]

        return step

    return append_columns(df, text, make, [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])


def held_out(key: Column) -> Column:
    return F.coalesce(remainder(key, FOLDS) == HELD_OUT, F.lit(False))


def scored_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """op10: every document's toxicity. A null doc_id has no remainder: it is neither learned from nor held out."""
    out = score_toxicity(docs.select("doc_id", "text"), fit(docs, labels))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
