"""Toxic spans by a linear-chain conditional random field.

A token is a run of letters and digits.  Each has hashed features (the word, its
first three to eight bytes, its last four) whose weights give the score of the
label *toxic*; *clean* scores 0.  Neighbouring labels have transition weights.
Labels come with whole documents, so tokens are labelled first: in a toxic document
those words are toxic that the sample's clean documents hardly ever use.
Forward-backward gives each token's marginal; a document's score is a logistic
function of its marginals, fitted on the same rows.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel
from .shared import class_sample, in_small_batches, release, trimmed

BITS = 18
PREFIXES = (3, 4, 5, 6, 7, 8)
SUFFIX = 4
FEATURES = 2 + len(PREFIXES)
BLOCK = 64
#: What marks a word as toxic: how many times its share of the clean texts its share of the toxic ones surely is, alone
#: and for texts that no such word tells, how many standard deviations make sure, and the fewest texts.
#: Chosen by log loss over folds of training rows only (doc_ids whose crc32 mod 4 is not 2).
STRONG, FAIR, DEVIATIONS, LEAST_TEXTS = 20, 2, 1.0, 3
#: Tokens of a batch in training, about; a text is never cut.
BATCH = 100_000

_TOKEN = np.zeros(256, dtype=bool)
for _low, _high in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B), (0x80, 0x100)):
    _TOKEN[_low:_high] = True


@dataclass
class Tokens:
    """Byte spans of the tokens of a batch, the text of each, and their features."""

    buf: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    doc: np.ndarray
    features: np.ndarray  # tokens x FEATURES
    n_docs: int


def tokens(texts: list[str | None]) -> Tokens:
    raw = [b"" if t is None else t.lower().encode("utf-8", "surrogatepass") for t in texts]
    offsets = np.zeros(len(raw) + 1, dtype=np.int64)
    np.cumsum([len(b) + 1 for b in raw], out=offsets[1:])
    buf = np.frombuffer(b" ".join(raw) + b" " if raw else b"", dtype=np.uint8)
    inside = np.zeros(len(buf) + 2, dtype=np.int8)
    inside[1:-1] = _TOKEN[buf]
    step = np.diff(inside)
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    doc = np.searchsorted(offsets, starts, side="right") - 1
    spans = kernel.Words(buf, offsets, starts, ends, doc, np.zeros(0, dtype=np.int64))
    made = [kernel.word_hashes(spans, 7)]
    for i, size in enumerate(PREFIXES):
        cut = kernel.Words(buf, offsets, starts, np.minimum(ends, starts + size), doc, spans.first)
        made.append(kernel.word_hashes(cut, 8 + i))
    cut = kernel.Words(buf, offsets, np.maximum(starts, ends - SUFFIX), ends, doc, spans.first)
    made.append(kernel.word_hashes(cut, 20))
    features = np.stack([(h >> np.uint64(64 - BITS)).astype(np.int32) for h in made], axis=1) if len(starts) else np.zeros((0, FEATURES), np.int32)
    return Tokens(buf, offsets, starts, ends, doc, features, len(raw))


def forward_backward(score: np.ndarray, first: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward vectors, each up to a factor, of the tokens of chains laid one after the other.

    score: of label 1 of each token (label 0 scores 0).  first: where a chain begins.
    transitions: exp of the score of going from label y to label z; a chain begins
    from both labels alike.  Steps are 2 x 2 matrices; they are multiplied inside
    blocks, all blocks at once, then from block to block, so long chains cost no more
    than short ones.
    """
    n = len(score)
    if not n:
        return np.zeros((0, 2)), np.zeros((0, 2))
    blocks = -(-n // BLOCK)
    phi = np.ones((blocks * BLOCK, 2))
    phi[:n, 1] = np.exp(np.clip(score, -30, 30))
    step = transitions[None] * phi[:, None, :]
    step[:n][first] = 0.5 * phi[:n][first][:, None, :]
    step[n:] = 0.5  # what fills the last block is a chain of its own
    step = step.reshape(blocks, BLOCK, 2, 2)
    whole = np.broadcast_to(np.eye(2), (blocks, 2, 2)).copy()
    for k in range(BLOCK):
        whole = whole @ step[:, k]
        whole /= whole.sum(axis=(1, 2), keepdims=True)
    ahead, behind = np.empty((blocks, 2)), np.empty((blocks, 2))
    v0 = v1 = 0.5
    rows = whole.reshape(blocks, 4).tolist()
    for b, (m00, m01, m10, m11) in enumerate(rows):
        ahead[b] = v0, v1
        v0, v1 = v0 * m00 + v1 * m10, v0 * m01 + v1 * m11
        v0, v1 = v0 / (v0 + v1), v1 / (v0 + v1)
    v0 = v1 = 0.5
    for b in range(blocks - 1, -1, -1):
        m00, m01, m10, m11 = rows[b]
        behind[b] = v0, v1
        v0, v1 = m00 * v0 + m01 * v1, m10 * v0 + m11 * v1
        v0, v1 = v0 / (v0 + v1), v1 / (v0 + v1)
    forward = np.empty((blocks, BLOCK, 2))
    v = ahead
    for k in range(BLOCK):
        v = np.einsum("by,byz->bz", v, step[:, k])
        v = v / v.sum(axis=1, keepdims=True)
        forward[:, k] = v
    backward = np.empty((blocks, BLOCK, 2))
    v = behind
    for k in range(BLOCK - 1, -1, -1):
        backward[:, k] = v
        v = np.einsum("byz,bz->by", step[:, k], v)
        v = v / v.sum(axis=1, keepdims=True)
    return forward.reshape(-1, 2)[:n], backward.reshape(-1, 2)[:n]


def marginals(score: np.ndarray, first: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """The probability of label 1 of each token."""
    both = np.multiply(*forward_backward(score, first, transitions))
    return both[:, 1] / both.sum(axis=1)


def _log_likelihood_gradient(score, first, labels, transitions):
    """Gradients of the log likelihood by token scores and by transition scores."""
    forward, backward = forward_backward(score, first, transitions)
    both = forward * backward
    p = both[:, 1] / both.sum(axis=1)
    at = np.flatnonzero(~first)
    after = backward[at]
    after[:, 1] *= np.exp(np.clip(score[at], -30, 30))
    pair = forward[at - 1][:, :, None] * transitions[None] * after[:, None, :]
    pair /= pair.sum(axis=(1, 2), keepdims=True)
    seen = np.bincount(labels[at - 1] * 2 + labels[at], minlength=4).reshape(2, 2)
    return labels - p, seen - pair.sum(axis=0)


@dataclass
class Model:
    """Feature weights, transitions, and the logistic function from marginals to a score."""

    weights: np.ndarray
    transitions: np.ndarray
    logistic: np.ndarray

    def tag(self, texts: list[str | None]) -> tuple[Tokens, np.ndarray]:
        found = tokens(texts)
        return found, self.marginals(found)

    def marginals(self, found: Tokens) -> np.ndarray:
        score = self.weights[found.features].sum(axis=1) + self.weights[-1]
        first = np.ones(len(score), dtype=bool)
        first[1:] = found.doc[1:] != found.doc[:-1]
        return marginals(score, first, self.transitions)

    def scores(self, found: Tokens, p: np.ndarray) -> np.ndarray:
        x = _aggregates(found.doc, p, found.n_docs)
        return 1 / (1 + np.exp(-np.clip(x @ self.logistic, -40, 40)))


def _aggregates(doc: np.ndarray, p: np.ndarray, n: int) -> np.ndarray:
    """For each text: 1, its largest marginal, and the logarithm of one more than its expected number of toxic tokens."""
    most = np.zeros(n)
    np.maximum.at(most, doc, p)
    total = np.bincount(doc, weights=np.where(p > 0.05, p, 0.0), minlength=n)
    return np.stack([np.ones(n), most, np.log1p(total)], axis=1)


def _fit_chain(features, first, labels, passes: int, rate: float = 0.5, l2: float = 1e-3):
    """Maximum likelihood by AdaGrad over all tokens; gradients are added up over batches of whole chains."""
    weights, seen = np.zeros((1 << BITS) + 1), np.full((1 << BITS) + 1, 1e-3)
    arcs, arcs_seen = np.zeros((2, 2)), np.full((2, 2), 1e-3)
    weights[-1] = -2.0
    chains = np.flatnonzero(first)
    at = np.unique(chains[np.searchsorted(chains, np.arange(0, len(first), BATCH), side="right") - 1]) if len(chains) else chains
    batches = [slice(x, y) for x, y in zip(at, np.append(at[1:], len(first)))]
    for _ in range(passes):
        g, by_arc = np.zeros((1 << BITS) + 1), np.zeros((2, 2))
        for part in batches:
            own = features[part]
            score = weights[own].sum(axis=1) + weights[-1]
            by_token, arc = _log_likelihood_gradient(score, first[part], labels[part], np.exp(arcs))
            g += np.bincount(own.ravel(), weights=np.repeat(by_token, FEATURES), minlength=(1 << BITS) + 1)
            g[-1] += by_token.sum()
            by_arc += arc
        g -= l2 * weights
        seen += g * g
        weights += rate * g / np.sqrt(seen)
        by_arc = by_arc - l2 * arcs
        arcs_seen += by_arc * by_arc
        arcs += rate * by_arc / np.sqrt(arcs_seen)
    return weights.astype(np.float32), np.exp(arcs)


def _fit_logistic(x: np.ndarray, y: np.ndarray, share: float, ridge: float = 1e-2) -> np.ndarray:
    """Newton steps for a logistic regression; toxic rows weigh so that their share is as in all rows."""
    w = np.zeros(x.shape[1])
    weight = np.where(y == 1, share / max(y.mean(), 1e-9), (1 - share) / max(1 - y.mean(), 1e-9))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        g = x.T @ (weight * (y - p)) - ridge * w
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w = w + np.linalg.solve(h, g)
    return w


def _unlike(words: np.ndarray, at: np.ndarray, marks: int = 8, run: int = 3) -> Iterator[int]:
    """Texts that share few of their smallest hashes of ``run`` words with earlier ones, so that copies don't count as evidence."""
    seen: set[tuple[int, int]] = set()
    for i in range(len(at) - 1):
        own = words[at[i] : at[i + 1]]
        if not len(own):
            continue
        if len(own) >= run:
            runs = own[: len(own) - run + 1]
            for k in range(1, run):
                runs = kernel.mix64(runs * np.uint64(0x9E3779B97F4A7C15) + own[k : len(own) - run + 1 + k])
            own = runs
        least = {(k, int(kernel.mix64(own ^ np.uint64(0x9E3779B97F4A7C15 * (k + 1) % 2**64)).min())) for k in range(marks)}
        if len(least & seen) < marks // 2:
            yield i
        seen |= least


def learn(texts: list[str], y: np.ndarray, share: float, passes: int = 30) -> Model | None:
    """A model from texts with labels y (1: toxic), for tables where ``share`` of the rows is toxic."""
    if len(set(y.tolist())) < 2:
        return None
    found = tokens(texts)
    at = np.searchsorted(found.doc, np.arange(len(texts) + 1))
    label = _marked(found, at, y).astype(np.int64) * y[found.doc]
    first = np.zeros(len(label), dtype=bool)
    first[at[:-1][np.diff(at) > 0]] = True
    weights, transitions = _fit_chain(found.features, first, label, passes)
    model = Model(weights, transitions, np.zeros(3))
    p = model.marginals(found)
    model.logistic = _fit_logistic(_aggregates(found.doc, p, len(texts)), y, share)
    return model


def _surely(n: np.ndarray) -> np.ndarray:
    """A count less what chance may have added."""
    return n - DEVIATIONS * np.sqrt(n)


def _marked(found: Tokens, at: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Tokens whose word, or one of whose beginnings, tells toxic texts.

    A stem that is STRONG times as frequent in toxic texts as in clean ones is marked.  Toxic
    texts without such a stem are then covered: the stem that tells most of them, if it
    is still FAIR times as frequent in them, is marked, until none is.  Copies of a text
    count once.
    """
    words = found.features[:, 0].astype(np.uint64) << np.uint64(BITS) | found.features[:, 1].astype(np.uint64)
    chosen = list(_unlike(words, at))
    n = np.maximum(np.bincount(y[chosen], minlength=2), 1)
    use = np.zeros(len(at) - 1, dtype=bool)
    use[chosen] = True
    out = np.zeros(len(found.doc), dtype=bool)
    held, open_ = use[found.doc], use & (y == 1)
    fair = []
    for column in (0, *range(2, 1 + len(PREFIXES))):
        # a stem is told by two hashes; each text counts once
        stem = found.features[:, column].astype(np.int64) << BITS | found.features[:, 1]
        names, of = np.unique(stem, return_inverse=True)
        pairs = np.unique(of[held] * np.int64(len(at)) + found.doc[held])
        name, doc = np.divmod(pairs, len(at))
        toxic, clean = (np.bincount(name[y[doc] == k], minlength=len(names)) for k in (1, 0))
        base = (clean + 1) / n[0]
        strong = _surely(toxic) / n[1] > STRONG * base
        out |= strong[of]
        open_[doc[strong[name]]] = False
        some = np.flatnonzero(~strong & (toxic >= LEAST_TEXTS) & (_surely(toxic) / n[1] > FAIR * base))
        place = np.full(len(names), -1)
        place[some] = np.arange(len(some))
        own = (place[name] >= 0) & (y[doc] == 1)
        fair.append((names[some], column, base[some], place[name[own]], doc[own]))
    if not any(len(f[0]) for f in fair):
        return out
    start = np.cumsum([0] + [len(f[0]) for f in fair])
    base = np.concatenate([f[2] for f in fair])
    of, doc = (np.concatenate([f[k] + (start[i] if k == 3 else 0) for i, f in enumerate(fair)]) for k in (3, 4))
    while True:
        left = np.bincount(of[open_[doc]], minlength=len(base)).astype(float)
        fits = (left >= LEAST_TEXTS) & (_surely(left) / n[1] > FAIR * base)
        if not fits.any():
            return out
        best = int(np.argmax(np.where(fits, left * np.log(np.maximum(left, 1) / n[1] / base), -1.0)))
        kind = int(np.searchsorted(start, best, side="right") - 1)
        names, column = fair[kind][:2]
        out |= (found.features[:, column].astype(np.int64) << BITS | found.features[:, 1]) == names[best - start[kind]]
        open_[doc[of == best]] = False


def fit(docs: DataFrame, labels: DataFrame, sample: int = 1500, passes: int = 30, characters: int = 8_000_000) -> Model | None:
    """Learn from docs (doc_id, text) and labels (doc_id, toxic).

    About ``sample`` rows of each label, or all of a rarer one, are chosen by a hash of
    doc_id, each row alone.  Rows that repeat a doc_id with the same text are one.  In the order
    of that hash the first 2 * ``sample`` texts of a label come to the driver as long as they have
    no more than half of ``characters`` together, which bounds the driver's memory; a longer
    text is left out of the training, not of the scoring.  Rows without a text or label are
    left out.  The chain is trained on all tokens of the texts.  Where a label occurs in no
    row there is nothing to learn, and the result is None.
    """
    labels = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    classes = labels.groupBy("toxic").agg(F.count("*").alias("class_rows"))
    counts = {r["toxic"]: r["class_rows"] for r in classes.collect()}
    if len(counts) < 2:
        return None
    chosen = F.broadcast(class_sample(labels, "toxic", classes, sample, 8))  # bounded: about two samples
    rows = docs.where("text is not null").select("doc_id", "text").join(chosen, "doc_id")
    rows = rows.withColumn("digest", F.xxhash64("text"))
    one = rows.groupBy("toxic", "h", "doc_id", "digest").agg(F.max(F.length("text")).alias("size"))
    wanted = []
    for toxic in (0, 1):
        # bounded: two samples of a label, without texts
        first, held = one.where(F.col("toxic") == toxic).orderBy("h", "doc_id", "digest").limit(2 * sample), 0
        for r in first.collect():
            if held + r["size"] <= characters // 2:
                held += r["size"]
                wanted.append((r["doc_id"], r["digest"]))
    if not wanted:
        return None
    keys = docs.sparkSession.createDataFrame(wanted, "doc_id long, digest long")
    # bounded: each wanted text once
    rows = rows.join(F.broadcast(keys), ["doc_id", "digest"]).groupBy("toxic", "h", "doc_id", "digest").agg(F.min("text").alias("text")).collect()
    rows.sort(key=lambda r: (r["h"], r["doc_id"], r["text"]))
    model = learn([r["text"] for r in rows], np.array([r["toxic"] for r in rows], dtype=np.int64), counts[1] / (counts[0] + counts[1]), passes)
    del rows
    release()
    return model


def _origins(text: str) -> np.ndarray | None:
    """For each code point of the lower-cased text the one it comes from; None where they are the same."""
    if len(text.lower()) == len(text):
        return None
    return np.repeat(np.arange(len(text)), [len(c.lower()) for c in text])


def score(docs: DataFrame, model: Model | None, spans: bool = True, threshold: float = 0.5) -> DataFrame:
    """Score every whole text.

    docs needs doc_id and text; other columns are ignored.  Returns for each row
    doc_id, score (0 to 1) and, with spans, spans: (start, end, marginal) in code
    points of the text for tokens whose marginal is ``threshold`` or more.  A null or
    empty text has no tokens and gets the score of none.  Without a model every score
    is 0.  Repeated rows are scored one by one; a very long text is tagged whole.  An
    empty table gives an empty result.
    """
    schema = "doc_id long, score double" + (", spans array<struct<start:long,end:long,marginal:double>>" if spans else "")
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # bounded: 2^18 weights

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shipped.value
        for batch in batches:
            for part in kernel.slices(batch["text"], 1_000_000):
                some = batch.iloc[part]
                rows = {"doc_id": some["doc_id"].astype("Int64").array, "score": np.zeros(len(some))}
                found = [[] for _ in range(len(some))]
                if model is not None:
                    tagged, p = model.tag(some["text"].tolist())
                    rows["score"] = model.scores(tagged, p)
                    if spans:
                        lead = np.concatenate([[0], np.cumsum((tagged.buf & 0xC0) != 0x80)])
                        origins: dict[int, np.ndarray | None] = {}
                        for i in np.flatnonzero(p >= threshold):
                            doc = int(tagged.doc[i])
                            if doc not in origins:
                                origins[doc] = _origins(some["text"].iloc[doc])
                            at, back = lead[tagged.offsets[doc]], origins[doc]
                            start, end = int(lead[tagged.starts[i]] - at), int(lead[tagged.ends[i]] - at)
                            if back is not None:
                                start, end = int(back[start]), int(back[end - 1]) + 1
                            found[doc].append({"start": start, "end": end, "marginal": float(p[i])})
                if spans:
                    rows["spans"] = found
                yield pd.DataFrame(rows)

    return in_small_batches(docs.select("doc_id", "text")).mapInPandas(trimmed(run), schema)
