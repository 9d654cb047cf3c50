"""Language of a text by multinomial logistic regression on character n-grams.

Features are hashed n-grams of one to three characters of the lower-cased text,
runs of anything but letters counting as one space.  A feature's value is its share
of the text's n-grams times its inverse document frequency.  The weights are
learned by follow-the-regularised-leader (FTRL-proximal) with an elastic net, and a
temperature fitted on rows kept apart turns the scores into probabilities.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernel import slices
from .shared import class_sample, in_small_batches, release, trimmed

BITS = 15
SCALE = 100.0
UNKNOWN = "und"
#: Characters whose n-grams are held at once, about; a longer text is held whole.
SLICE = 500_000

_LETTER = np.array([chr(c).isalpha() for c in range(0x10000)])
_FACTORS = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D))


def letters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the lower-cased texts, other runs as one space, and each one's text."""
    lowered = [t.lower() + " " for t in texts]
    code = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    doc = np.repeat(np.arange(len(texts), dtype=np.int32), [len(t) for t in lowered])
    letter = _LETTER[np.minimum(code, 0xFFFF)]
    for i in np.flatnonzero(code > 0xFFFF):
        letter[i] = chr(code[i]).isalpha()
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    return np.where(letter, code, np.uint32(32))[keep], doc[keep]


def ngrams(code: np.ndarray, doc: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For n of 1 to 3 the features of the n-grams within one text, and their texts."""
    for n in (1, 2, 3):
        size = len(code) - n + 1
        if size <= 0:
            return
        h = np.full(size, n, dtype=np.uint32)
        for k in range(n):
            h = (h + code[k : k + size]) * _FACTORS[k]
            h ^= h >> np.uint32(15)
        h *= np.uint32(0x27D4EB2F)
        whole = doc[:size] == doc[n - 1 :]
        yield (h >> np.uint32(32 - BITS))[whole].astype(np.int32), doc[:size][whole]


def counts(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Features of each text, in order, and how often each occurs."""
    grams = list(ngrams(*letters(texts)))
    found = [[] for _ in texts]
    for feature, doc in grams:
        for i, part in enumerate(np.split(feature, np.searchsorted(doc, np.arange(1, len(texts))))):
            found[i].append(part)
    return [np.unique(np.concatenate(parts), return_counts=True) if parts else (np.zeros(0, np.int32), np.zeros(0, np.int64)) for parts in found]


@dataclass
class Model:
    """Classes and, for each feature and class, its weight with the inverse document frequency in it."""

    languages: list[str]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0

    def scores(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Scores of each text before the temperature, and whether it has a letter."""
        code, doc = letters(texts)
        total = np.zeros((len(texts), len(self.languages)))
        n = np.zeros(len(texts))
        for feature, of in ngrams(code, doc):
            n += np.bincount(of, minlength=len(texts))
            for c in range(len(self.languages)):
                total[:, c] += np.bincount(of, weights=self.weights[c][feature], minlength=len(texts))
        return total * (SCALE / np.maximum(n, 1))[:, None] + self.bias, n > 0

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        scores, known = self.scores(["" if t is None else t for t in texts])
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        p = softmax(scores / self.temperature)
        best = p.argmax(axis=1)
        return [self.languages[b] if k else UNKNOWN for b, k in zip(best, known)], np.where(known, p.max(axis=1), 0.0)


def softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def follow_the_leader(
    rows: list[tuple[np.ndarray, np.ndarray]],
    labels: np.ndarray,
    classes: int,
    size: int,
    alpha: float = 0.5,
    beta: float = 1.0,
    l1: float = 0.02,
    l2: float = 0.1,
    passes: int = 2,
) -> tuple[np.ndarray, np.ndarray]:
    """FTRL-proximal over sparse rows (features, values); returns weights (classes, size) and bias.

    A feature whose summed gradient stays within l1 has weight 0; l2 shrinks the rest.
    """
    z, n = np.zeros((size + 1, classes)), np.zeros((size + 1, classes))

    def weights(at) -> np.ndarray:
        pull = z[at]
        return np.where(np.abs(pull) <= l1, 0.0, -(pull - np.sign(pull) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2))

    for k in range(passes):
        for i in np.random.default_rng(k).permutation(len(rows)):
            feature, value = rows[i]
            at, x = np.append(feature, size), np.append(value, 1.0)
            w = weights(at)
            p = softmax((x @ w)[None])[0]
            p[labels[i]] -= 1.0
            g = x[:, None] * p
            step = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - step * w
            n[at] += g * g
    w = weights(np.arange(size + 1))
    return w[:size].T.copy(), w[size]


def fitted_temperature(scores: np.ndarray, labels: np.ndarray) -> float:
    """The temperature with the least log loss, by golden section on its logarithm."""

    def loss(t: float) -> float:
        p = softmax(scores / np.exp(t))
        return -float(np.log(np.maximum(p[np.arange(len(labels)), labels], 1e-300)).mean())

    low, high, golden = np.log(0.05), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(60):
        a, b = high - golden * (high - low), low + golden * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def _narrow(counts: np.ndarray) -> np.ndarray:
    """Counts in two bytes each if they fit, else in four or eight."""
    most = int(counts.max()) if len(counts) else 0
    return counts.astype(np.uint16 if most < 1 << 16 else np.uint32 if most < 1 << 32 else np.uint64)


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """In how many texts each feature occurs, and the number of texts, over all rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros(1 << BITS, dtype=np.int64), 0
        seen = np.zeros(1 << BITS, dtype=bool)
        for batch in batches:
            for part in slices(batch["text"], SLICE):
                texts = [t for t in batch["text"].iloc[part] if t is not None]
                n += len(texts)
                grams = [(f, np.searchsorted(d, np.arange(len(texts) + 1))) for f, d in ngrams(*letters(texts))]
                for i in range(len(texts)):
                    for feature, cut in grams:
                        seen[feature[cut[i] : cut[i + 1]]] = True
                    total += seen
                    seen[:] = False
        at = np.flatnonzero(total)
        yield pd.DataFrame({"feature": np.append(at, -1), "n": np.append(total[at], n)})

    rows = in_small_batches(docs.select("text")).mapInPandas(trimmed(run), "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect()
    found = np.zeros(1 << BITS, dtype=np.int64)
    n = 0
    for feature, count in rows:
        if feature < 0:
            n = count
        else:
            found[feature] = count
    return found, n


def fit(labelled: DataFrame, sample: int = 6000, classes: int = 256) -> Model:
    """Learn from labelled rows (doc_id, text, lang).

    Document frequencies are counted over all of them.  The weights are learned from
    a sample of at most ``sample`` rows in all, about as many of each language, chosen
    by a hash of doc_id; a fifth of it serves the temperature alone.  The ``classes`` most
    frequent languages are learned, equally frequent ones by code point, so that a column
    of junk can't fill the driver.  Rows with a null text or lang are left out; without
    any the model knows no language.
    """
    labelled = labelled.where("text is not null and lang is not null").select("doc_id", "text", "lang")
    found, n = document_frequencies(labelled)
    idf = np.log((1.0 + n) / (1.0 + found)) + 1.0
    kinds = labelled.groupBy("lang").agg(F.count("*").alias("class_rows")).orderBy(F.col("class_rows").desc(), "lang").limit(classes).collect()
    each = max(1, sample // max(len(kinds), 1))
    kinds = labelled.sparkSession.createDataFrame(kinds, "lang string, class_rows long")
    chosen = class_sample(labelled, "lang", kinds, each, 3).orderBy("h", "doc_id", "lang", "text").limit(sample)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = counts(batch["text"].tolist())
            yield pd.DataFrame(
                {
                    "h": batch["h"],
                    "lang": batch["lang"],
                    "feature": [f.astype(np.uint16).tobytes() for f, _ in made],
                    "n": [_narrow(c).tobytes() for _, c in made],
                }
            )

    rows = chosen.select("h", "lang", "text").mapInPandas(trimmed(run), "h long, lang string, feature binary, n binary").collect()
    names = sorted({r["lang"] for r in rows})
    if not names:
        return Model([], np.zeros((0, 1 << BITS), dtype=np.float32), np.zeros(0))
    place = {name: i for i, name in enumerate(names)}
    sparse, labels, apart = [], [], []
    rows.reverse()
    while rows:  # each row's bytes go as soon as they are read
        r = rows.pop()
        feature = np.frombuffer(r["feature"], dtype=np.uint16)
        if len(feature):
            count = np.frombuffer(r["n"], dtype=f"u{len(r['n']) // len(feature)}").astype(np.float64)
            sparse.append((feature, (SCALE * count / count.sum() * idf[feature]).astype(np.float32)))
            labels.append(place[r["lang"]])
            apart.append(r["h"] % 5 == 0)
    labels, apart = np.array(labels, dtype=int), np.array(apart, dtype=bool)
    learn, held = np.flatnonzero(~apart), np.flatnonzero(apart)
    w, bias = follow_the_leader([sparse[i] for i in learn], labels[learn], len(names), 1 << BITS)
    temperature = 1.0
    if len(held):
        scores = np.array([w[:, f] @ v + bias for f, v in (sparse[i] for i in held)])
        temperature = fitted_temperature(scores, labels[held])
    made = Model(names, (w * idf).astype(np.float32), bias, temperature)
    del sparse, w
    release()
    return made


def predict(docs: DataFrame, model: Model, keep: bool = False) -> DataFrame:
    """The language of every whole text.

    docs needs text.  Returns all its columns with keep, else doc_id, and lang_pred
    (a learned language, or ``und`` where the text is null or has no letter) and score
    (the calibrated probability; 0 for ``und``).  Of equally probable languages the
    first by code point is told.  With keep, columns of docs of those names are
    replaced.  Repeated rows are judged one by one; very long texts are judged whole.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # bounded: features times languages
    docs = docs.drop("lang_pred", "score") if keep else docs.select("doc_id", "text")
    kept = docs.columns if keep else ["doc_id"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in slices(batch["text"], SLICE):
                some = batch.iloc[part]
                names, p = shipped.value.predict(some["text"].tolist())
                yield some[kept].assign(lang_pred=names, score=p)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in kept)
    return in_small_batches(docs).mapInPandas(trimmed(run), f"{schema}, lang_pred string, score double")
