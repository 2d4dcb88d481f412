"""Language identification with blended-spectrum string kernels.

A text is the set of its byte n-grams, n from 1 to 4, hashed into a fixed number of buckets; the kernel of two texts
is the number of buckets they share, over the geometric mean of their numbers. Landmark texts give a Nyström map of
that kernel, on which a one-versus-rest kernel ridge regression is fitted. As the map is linear in the bucket
presences, scoring a batch is one matrix product of its presences with the folded weights.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import chunks, frugal, hash_rank, hashed_share

BITS = 18
ORDERS = (1, 2, 3, 4)
#: Bounds of the fitted sample: labelled texts and landmarks of a language, and texts in all, which many languages share.
TRAIN_TEXTS, LANDMARKS, SAMPLE = 240, 32, 61_440
RIDGE = 1e-2
#: A text is of no learned language if the landmarks know less than this part of what they know of all but the strangest
#: twentieth of the fitted texts.
STRANGE, TWENTIETH = 0.7, 0.05
UNKNOWN = "und"
_FOLD = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))
_SPACES = re.compile(rb" {2,}")


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def buckets(text: str) -> np.ndarray:
    """Buckets of all n-grams of the lower-cased text, in which any run of other ASCII than letters is one space."""
    data = np.frombuffer(_SPACES.sub(b" ", b" " + text.lower().encode("utf-8", "replace").translate(_FOLD) + b" "), np.uint8).astype(np.uint32)
    out, code = [], np.zeros(len(data), np.uint32)
    for n in ORDERS:
        if len(data) < n:
            break
        code = data if n == 1 else (code[:-1] << np.uint32(8)) | data[n - 1 :]
        out.append(((code + np.uint32(n)) * np.uint32(2654435761)) >> np.uint32(32 - BITS))
    return np.concatenate(out)


def presence(text: str, seen: np.ndarray) -> np.ndarray:
    """Distinct buckets in order; ``seen`` is an all-false work array, left so."""
    codes = buckets(text)
    seen[codes] = True
    found = np.flatnonzero(seen)
    seen[codes] = False
    return found


class Model(NamedTuple):
    """``columns``: bucket to row of ``weights`` (0: a bucket that no landmark has, whose weights are 0).
    ``least_known``: the share of a text's buckets that landmarks must have for it to be of one of the languages."""

    languages: list[str]
    columns: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    least_known: float = 0.0


def fit(sets: list[np.ndarray], labels: list[str]) -> Model:
    """Kernel ridge regression on the bucket sets, landmarks first of each language in the order given."""
    languages = sorted(set(labels))
    if not languages:
        return Model([], np.zeros(1 << BITS, np.int32), np.zeros((1, 0), np.float32), np.zeros(0, np.float32))
    picked = [i for lang in languages for i in [j for j, got in enumerate(labels) if got == lang][:LANDMARKS]]
    vocabulary, holders = np.unique(np.concatenate([sets[i] for i in picked]), return_counts=True)
    columns = np.zeros(1 << BITS, np.int32)
    columns[vocabulary] = np.arange(1, len(vocabulary) + 1)
    scaled = np.zeros((len(picked), len(vocabulary) + 1), np.float32)
    for row, i in enumerate(picked):
        scaled[row, columns[sets[i]]] = 1 / np.sqrt(len(sets[i]))
    within = (scaled @ scaled.T).astype(np.float64)
    values, vectors = np.linalg.eigh(within)
    whiten = vectors / np.sqrt(np.maximum(values, 1e-8 * values.max()))
    kernel = np.zeros((len(sets), len(picked)))
    for start in range(0, len(sets), 64):
        part = sets[start : start + 64]
        rows = np.zeros((len(part), len(vocabulary) + 1), np.float32)
        for r, s in enumerate(part):
            rows[r, columns[s]] = 1 / np.sqrt(max(1, len(s)))
        rows[:, 0] = 0
        kernel[start : start + len(part)] = rows @ scaled.T
    held = np.zeros(1 << BITS, np.int32)
    held[vocabulary] = holders
    own = np.isin(np.arange(len(sets)), picked)  # a landmark is judged by the others
    shares = [float((held[s] > mine).mean()) for s, mine in zip(sets, own) if len(s)]
    least_known = STRANGE * float(np.quantile(shares, TWENTIETH)) if shares else 0.0
    mapped = kernel @ whiten
    target = np.where(np.array(labels)[:, None] == np.array(languages)[None, :], 1.0, -1.0)
    counts = (target > 0).sum(axis=0)
    weight = (1.0 / counts)[target.argmax(axis=1)]
    weight = weight / weight.mean()
    design = np.concatenate((mapped, np.ones((len(sets), 1))), axis=1)
    penalty = RIDGE * np.eye(design.shape[1])
    penalty[-1, -1] = 1e-6
    solved = np.linalg.solve(design.T @ (design * weight[:, None]) + penalty, design.T @ (target * weight[:, None]))
    folded = scaled.T @ (whiten @ solved[:-1])
    folded[0] = 0
    return Model(languages, columns, folded.astype(np.float32), solved[-1].astype(np.float32), least_known)


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """Fit on at most ``TRAIN_TEXTS`` texts of each language, ``SAMPLE`` in all (one of a language at least), chosen by a
    hash of id and text among rows whose text holds a letter and whose language is not null. Equal rows count once, and
    different texts of a repeated id each for itself. Bucket sets are made on the executors; the driver receives only
    those of the sample. Without a usable row the model knows no language."""
    usable = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).alias("id"), F.col(lang).alias("lang"), F.col(text).alias("text"), hash_rank(doc_id, lang, text).alias("rank"))
    totals = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    wanted = max(1, min(TRAIN_TEXTS, SAMPLE // max(1, len(totals))))
    total = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in totals.items() for x in pair]), F.col("lang")) if totals else F.lit(None), F.lit(1))
    order = Window.partitionBy("lang").orderBy("rank", "id")
    candidates = usable.filter(hashed_share(F.col("rank"), wanted, total)).select("id", "lang", "rank").distinct()
    chosen = candidates.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= wanted)

    def sets(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        seen = np.zeros(1 << BITS, bool)
        for batch in batches:
            yield pa.array([presence(t.as_py(), seen).astype("<i4").tobytes() if has_letter(t.as_py()) else None for t in batch], pa.binary())

    found = usable.join(F.broadcast(chosen), ["id", "lang", "rank"]).dropDuplicates(["lang", "n"])
    sample = found.select("id", "n", "lang", F.arrow_udf(sets, "binary")("text").alias("set"))
    rows = sorted((r for r in sample.collect() if r["set"] is not None), key=lambda r: (r["lang"], r["n"]))
    return fit([np.frombuffer(r["set"], "<i4") for r in rows], [r["lang"] for r in rows])


def score_texts(model: Model, texts: list[str | None], seen: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language and confidence of each text, 1 where the winning regression is at its target, 0 where it is at the
    others', and whether it is of a learned language at all. The confidence cannot tell: the regressions' sum is fixed, so
    some language always lies at its share of it or above."""
    sets = [presence(t, seen) if t is not None and has_letter(t) else None for t in texts]
    rows = np.zeros((len(texts), len(model.weights)), np.float32)
    norm = np.ones((len(texts), 1), np.float32)
    fits = np.zeros(len(texts), bool)
    for r, s in enumerate(sets):
        if s is not None:
            rows[r, model.columns[s]] = 1
            norm[r] = np.sqrt(len(s))
            fits[r] = np.count_nonzero(model.columns[s]) >= model.least_known * len(s)
    values = (rows @ model.weights) / norm + model.bias
    best = values.argmax(axis=1)
    sure = ((values[np.arange(len(values)), best] + 1) / 2).clip(0, 1)
    known = [s is not None for s in sets]
    return [model.languages[b] if k else UNKNOWN for b, k in zip(best, known)], np.where(known, sure, 0.0), fits


def identify(model: Model, text: Column) -> Column:
    """Struct of lang_pred, score and fits (whether the text is of a learned language) for each whole text.

    ``und``, 0 and false for null, empty and letterless texts, and for every text if the model knows no language; of equal
    scores, the first language by name. A pure function of the text, so repeated rows get equal results.
    """

    @frugal
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        seen = np.zeros(1 << BITS, bool)
        for batch in batches:
            langs, sure, fits = [], [], []
            for part in chunks(batch, 64):
                texts = part.to_pylist()
                if model.languages:
                    a, b, c = score_texts(model, texts, seen) if texts else ([], np.zeros(0), np.zeros(0, bool))
                else:
                    a, b, c = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
                langs += a
                sure.append(b)
                fits.append(c)
            yield pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(np.concatenate([np.zeros(0), *sure]), pa.float64()), pa.array(np.concatenate([np.zeros(0, bool), *fits]), pa.bool_())], names=["lang_pred", "score", "fits"])

    return F.arrow_udf(predict, "struct<lang_pred:string,score:double,fits:boolean>")(text)
