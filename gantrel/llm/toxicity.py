"""Toxicity by weak supervision.

Voters are of three kinds: lexicon words and word starts that lean towards toxic documents in a bounded labelled sample,
words that lean towards clean ones, and patterns of a token's shape, which are chosen without looking at labels. A
generative label model estimates by EM how often each votes in either class and how reliable the given labels themselves
are. Voters that repeat each other within a class are one clique, whose number of votes has a distribution of its own in
either class, so that their correlation is part of the likelihood. The posterior labels train a linear classifier on the
voters' counts, which scores every text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import frugal, hash_rank, hashed_share

#: Bounds of the fitted sample, for each label, and of the voters.
TRAIN_ROWS, VOTERS, CLEAN_VOTERS = 4000, 400, 40
STARTS = (4, 5, 6)
MIN_DOCS, MIN_LEAN = 3, 0.93
#: Voters correlate when their votes do so much, beyond what the class explains; votes of a clique are counted so far.
CORRELATED, COUNTED = 0.3, 3
EM_ROUNDS, RIDGE = 12, 0.3
CACHE = 1 << 16
_EDGES = re.compile(r"^[\W\d_]+|[\W\d_]+$")


#: Shapes of a token that vote whatever the labels: shouting, repeated marks, a drawn-out letter, signs inside a word.
PATTERNS = {
    "~caps": re.compile(r"[^a-z]*[A-Z]{3,}[^a-z]*"),
    "~marks": re.compile(r".*[!?]{2,}"),
    "~drawn": re.compile(r"(?i).*([a-z])\1\1.*"),
    "~masked": re.compile(r".*[^\W\d_][*@#$%0-9]+[^\W\d_].*"),
}


def cues(token: str) -> list[str]:
    """What voters can look at in a token: the lower-cased word without other signs at its ends, its starts, and the
    token's shape."""
    word = _EDGES.sub("", token.lower())
    found = [name for name, shape in PATTERNS.items() if shape.fullmatch(token)]
    return [*found, f"={word}", *[f"^{word[:n]}" for n in STARTS if len(word) > n]] if len(word) > 1 else found


class Model(NamedTuple):
    voters: list[str]
    weights: np.ndarray
    bias: float
    #: What the label model found: vote rates in clean and toxic documents, and the clique of each voter.
    rates: np.ndarray
    cliques: np.ndarray


class _Votes(dict):
    """Token to the voters it raises, found once for each distinct token."""

    def __init__(self, voters: list[str]):
        super().__init__()
        self.number = {v: i for i, v in enumerate(voters)}

    def __missing__(self, token: str) -> tuple[int, ...]:
        hits = tuple(i for c in cues(token) if (i := self.number.get(c)) is not None)
        self[token] = hits
        return hits

    def count(self, text: str) -> dict[int, int]:
        if len(self) > CACHE:
            self.clear()
        out: dict[int, int] = {}
        for hits in filter(None, map(self.__getitem__, text.split())):
            for i in hits:
                out[i] = out.get(i, 0) + 1
        return out


def cliques_of(votes: np.ndarray, posterior: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The clique of each voter: voters are joined where their votes, less what is expected in each class, correlate."""
    mass = np.stack((weight * (1 - posterior), weight * posterior))
    rates = (mass @ votes + 0.02) / (mass.sum(axis=1, keepdims=True) + 1.0)
    rest = (votes - np.outer(1 - posterior, rates[0]) - np.outer(posterior, rates[1])) * np.sqrt(weight)[:, None]
    scale = np.sqrt(np.maximum((rest**2).sum(axis=0), 1e-12))
    linked = (rest.T @ rest) / np.outer(scale, scale) > CORRELATED
    names = np.arange(votes.shape[1])
    while True:  # the least number of those linked, until nothing moves
        least = np.where(linked | np.eye(len(names), dtype=bool), names[None, :], len(names)).min(axis=1, initial=len(names))
        if (least == names).all():
            return np.unique(names, return_inverse=True)[1]
        names = least


def label_model(votes: np.ndarray, gold: np.ndarray, prior: float, sample_weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of the toxic class for each document, vote rates by class and each voter's clique.

    ``votes``: documents by voters, 0 or 1. ``gold``: given labels, themselves a voter whose reliability is estimated; -1
    where one is not given. Given the class, cliques are independent, and the number of votes of a clique, up to
    ``COUNTED``, has any distribution.
    """
    posterior = np.where(gold == 1, 0.95, np.where(gold == 0, 0.05, prior))
    base = np.log(prior / (1 - prior))
    for step in range(EM_ROUNDS):
        if step in (0, 2, 5):
            cliques = cliques_of(votes, posterior, sample_weight)
            sizes = np.zeros((votes.shape[1], int(cliques.max(initial=-1)) + 1))
            sizes[np.arange(len(cliques)), cliques] = 1
            counted = np.minimum(votes @ sizes, COUNTED).astype(np.int64)
        mass = np.stack((sample_weight * (1 - posterior), sample_weight * posterior))
        total = mass.sum(axis=1, keepdims=True)
        rates = (mass @ votes + 0.02) / (total + 1.0)
        logit = np.full(len(votes), base)
        for n in range(COUNTED + 1):
            share = (mass @ (counted == n) + (0.02 if n else 0.94)) / (total + 1.0)
            logit += (counted == n) @ np.log(share[1] / share[0])
        trust = np.clip((mass @ np.stack((gold == 0, gold == 1), axis=1).astype(float) + 0.5) / (total + 1.0), 1e-3, 1 - 1e-3)
        logit += np.where(gold == 1, np.log(trust[1, 1] / trust[0, 1]), np.where(gold == 0, np.log(trust[1, 0] / trust[0, 0]), 0.0))
        posterior = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
    return posterior, rates, cliques


def linear(x: np.ndarray, target: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Ridge logistic regression on soft labels by Newton steps; the last weight is the bias."""
    design = np.concatenate((x, np.ones((len(x), 1))), axis=1)
    w = np.zeros(design.shape[1])
    penalty = np.full(len(w), RIDGE)
    penalty[-1] = 1e-3
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        grad = design.T @ (weight * (p - target)) + penalty * w
        hess = design.T @ (design * (weight * np.maximum(p * (1 - p), 1e-4))[:, None]) + np.diag(penalty)
        move = np.linalg.solve(hess, grad)
        w -= move
        if np.abs(move).max() < 1e-6:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Fit on at most ``TRAIN_ROWS`` labelled documents of either label, chosen by a hash of the id. Null labels, ids and
    texts take no part; of several labels for one id the largest counts, of several texts one by its hash. Without rows of both labels the model has no
    voters and gives every text the same score, 1 or 0 as the rows' only label, 0 without any."""
    known = labels.select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("y")).filter("id is not null and y in (0, 1)").groupBy("id").agg(F.max("y").alias("y"))
    totals = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not (totals.get(0) and totals.get(1)):
        return Model([], np.zeros(0), 30.0 if totals.get(1) else -30.0, np.zeros((2, 0)), np.zeros(0))

    total = F.when(F.col("y") == 1, F.lit(totals[1])).otherwise(F.lit(totals[0]))
    order = Window.partitionBy("y").orderBy(hash_rank("id"), "id")
    candidates = known.filter(hashed_share(hash_rank("id"), TRAIN_ROWS, total))
    chosen = candidates.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= TRAIN_ROWS).select("id", "y")

    def distinct_cues(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([sorted({c for token in set(t.as_py().split()) for c in cues(token)}) for t in batch], pa.list_(pa.string()))

    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).filter("text is not null").join(F.broadcast(chosen), "id")
    rows = rows.groupBy("id", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    sizes = {y: min(n, TRAIN_ROWS) for y, n in totals.items()}
    seen = rows.select("y", F.explode(F.arrow_udf(distinct_cues, "array<string>")("text")).alias("cue")).groupBy("cue").agg(F.sum("y").alias("t"), F.sum(1 - F.col("y")).alias("c"))
    share_t, share_c = F.col("t") / F.lit(sizes[1]), (F.col("c") + F.lit(0.5)) / F.lit(sizes[0])
    lean = share_t / (share_t + share_c)
    best = seen.filter((F.col("t") >= max(MIN_DOCS, sizes[1] // 250)) & (lean >= MIN_LEAN)).orderBy(F.desc(share_t * F.log(share_t / share_c)), "cue").limit(VOTERS)
    clean = seen.filter((F.col("c") >= max(MIN_DOCS, sizes[0] // 50)) & (lean <= 1 - MIN_LEAN)).orderBy(F.desc("c"), "cue").limit(CLEAN_VOTERS)
    leaning = [r["cue"] for r in best.collect()]
    if not leaning:
        prior = totals[1] / (totals[0] + totals[1])
        return Model([], np.zeros(0), float(np.log(prior / (1 - prior))), np.zeros((2, 0)), np.zeros(0))
    voters = list(dict.fromkeys([*leaning, *[r["cue"] for r in clean.collect()], *PATTERNS]))

    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table = _Votes(voters)
        for batch in batches:
            yield pa.array([list(table.count(t.as_py()).items()) for t in batch], pa.map_(pa.int32(), pa.int32()))

    got = sorted(rows.select("id", "y", F.arrow_udf(count, "map<int,int>")("text").alias("votes")).collect(), key=lambda r: r["id"])
    gold = np.array([r["y"] for r in got])
    if not voters or len(set(gold.tolist())) < 2:
        prior = totals[1] / (totals[0] + totals[1])
        return Model([], np.zeros(0), float(np.log(prior / (1 - prior))), np.zeros((2, 0)), np.zeros(0))
    counts = np.zeros((len(got), len(voters)))
    for i, r in enumerate(got):
        for j, n in r["votes"].items():
            counts[i, j] = n
    weight = np.where(gold == 1, totals[1] / (gold == 1).sum(), totals[0] / (gold == 0).sum())
    weight *= len(gold) / weight.sum()
    prior = totals[1] / (totals[0] + totals[1])
    posterior, rates, cliques = label_model((counts > 0).astype(float), gold, prior, weight)
    w = linear(_features(counts), posterior, weight)
    return Model(voters, w[:-1], float(w[-1]), rates, cliques)


def _features(counts: np.ndarray) -> np.ndarray:
    return np.concatenate((np.log1p(counts), np.log1p(counts.sum(axis=1, keepdims=True))), axis=1)


def score(model: Model, text: Column) -> Column:
    """Probability that the whole text is toxic; null and empty texts, which raise no voter, get the classifier's bias.
    A pure function of the text, so repeated rows get equal scores."""

    @frugal
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table = _Votes(model.voters)
        for batch in batches:
            out = []
            for value in batch:
                z = model.bias
                if model.voters and (hits := table.count(value.as_py() or "")):
                    z += sum(float(model.weights[i]) * np.log1p(n) for i, n in hits.items()) + float(model.weights[-1]) * np.log1p(sum(hits.values()))
                out.append(1 / (1 + np.exp(-min(30.0, max(-30.0, z)))))
            yield pa.array(out, pa.float64())

    return F.arrow_udf(predict, "double")(text)
