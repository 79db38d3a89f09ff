"""Quality classifier by positive-unlabelled learning.

Method.  Each text has a vector of surface statistics.  A small network scores
it and minimises the non-negative unbiased risk
    prior * R_p(+) + max(0, R_u(-) - prior * R_p(-))
over trusted positives and unlabelled web text, with the sigmoid loss; where
the negative part falls below zero, its gradient is reversed.  The class prior is
estimated from the same two samples: half of each trains a network, and on the
other halves the share of unlabelled texts above a threshold, over the share of
positives above it, bounds the prior from above; the threshold with the least
confidence bound gives the estimate.  Negative labels serve for nothing.

Bounds: at most about ``sample_rows`` positives and as many unlabelled rows,
drawn by a hash of doc_id, meet the driver, as vectors of fixed length.  Unlabelled
are the documents on the learning side, whether they bear a label or not.

Defined results: null text counts as empty; every text has a score in 0..1; no
positives or no documents to learn from: every score is 0.5; repeated rows have equal scores; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.bpe import LETTER, NUMBER, WS_MID, _classes, slices
from weftgraph.llm.langid import fold
from weftgraph.llm.hashing import mix
from weftgraph.llm.shingles import words

SAMPLE_ROWS = 5_000
_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: code points to columns: punctuation one by one, then other kinds
_KINDS = len(_MARKS) + 8
N_FEATURES = _KINDS + 8

_TABLE: np.ndarray | None = None


def _kinds() -> np.ndarray:
    global _TABLE
    if _TABLE is None:
        base = len(_MARKS)
        table = np.full(0x110000, base, np.uint8)  # other symbols
        table[_classes() == NUMBER] = base + 1
        table[_classes() == LETTER] = base + 2
        table[_classes() == WS_MID] = base + 4
        for c in range(0x250):
            if chr(c).isalpha() and chr(c).isupper():
                table[c] = base + 3
        table[10] = base + 5
        table[:32] = np.where(table[:32] == base, base + 6, table[:32])
        table[0x80:0x250] = np.where(table[0x80:0x250] == base + 2, base + 7, table[0x80:0x250])
        for i, c in enumerate(_MARKS):
            table[ord(c)] = i
        _TABLE = table
    return _TABLE


def features(texts: list[str]) -> np.ndarray:
    """(texts, N_FEATURES) float32."""
    n = len(texts)
    joined = "\n".join(texts) + "\n"
    cps = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = _kinds()[cps]
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    owner = np.repeat(np.arange(n), sizes)
    counts = np.bincount(owner * _KINDS + kind, minlength=n * _KINDS).reshape(n, _KINDS).astype(np.float64)
    out = np.zeros((n, N_FEATURES))
    chars = sizes.astype(np.float64)
    out[:, :_KINDS] = np.sqrt(counts / chars[:, None])
    hashes, number = words(texts)
    own = np.repeat(np.arange(n), number)
    nw = np.maximum(number, 1)
    # repeated words, word pairs and lines: 1 - distinct / all
    pair = mix(hashes[:-1] * np.uint64(3) + hashes[1:]) if len(hashes) > 1 else hashes[:0]
    inner = own[1:] == own[:-1] if len(own) > 1 else np.zeros(0, bool)
    for column, (keys, of) in enumerate(((hashes, own), (pair[inner], own[1:][inner]))):
        distinct = np.unique(mix(keys ^ mix(of.astype(np.uint64) + np.uint64(1))) if len(keys) else keys, return_index=True)[1]
        have = np.bincount(of, minlength=n)
        out[:, _KINDS + column] = 1 - np.bincount(of[distinct], minlength=n) / np.maximum(have, 1)
    lines = [[line for line in t.split("\n") if line] for t in texts]
    out[:, _KINDS + 2] = [1 - len(set(x)) / max(len(x), 1) for x in lines]
    out[:, _KINDS + 3] = np.log1p(number)
    out[:, _KINDS + 4] = counts[:, len(_MARKS) + 2 : len(_MARKS) + 4].sum(1) / nw / 10
    out[:, _KINDS + 5] = np.log1p([len(x) for x in lines]) - np.log1p(number)
    upper = counts[:, len(_MARKS) + 3]
    out[:, _KINDS + 6] = upper / np.maximum(upper + counts[:, len(_MARKS) + 2], 1)
    out[:, _KINDS + 7] = counts[:, : len(_MARKS)].sum(1) / nw
    return out.astype(np.float32)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    prior: float
    turned: int = 0  # steps whose gradient was reversed

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability-like score of label 1."""
        h = np.tanh(np.clip((x - self.mean) / self.scale, -8, 8) @ self.w1 + self.b1)
        return 1 / (1 + np.exp(-np.clip(h @ self.w2 + self.b2, -30, 30)))


def _forward(p: list[np.ndarray], x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h = np.tanh(x @ p[0] + p[1])
    return h, 1 / (1 + np.exp(-np.clip(h @ p[2] + p[3][0], -30, 30)))  # sigmoid loss: 1 - s for label 1, s for label 0


def risks(p: list[np.ndarray], xp: np.ndarray, xu: np.ndarray, prior: float) -> tuple[float, float]:
    """(prior * R_p(+), R_u(-) - prior * R_p(-)): positive and negative part of the risk."""
    sp, su = _forward(p, xp)[1], _forward(p, xu)[1]
    return float(prior * (1 - sp).mean()), float(su.mean() - prior * sp.mean())


def gradient(p: list[np.ndarray], xp: np.ndarray, xu: np.ndarray, prior: float) -> tuple[list[np.ndarray], bool]:
    """(direction that a step goes against, is it reversed): the gradient of the risk while its
    negative part is not below zero, else that of the negative part, turned round."""
    x, k = np.concatenate([xp, xu]), len(xp)
    h, s = _forward(p, x)
    slope = s * (1 - s)
    turned = bool(s[k:].mean() - prior * s[:k].mean() < 0)
    dg = np.empty(len(x))
    if turned:
        dg[:k], dg[k:] = prior * slope[:k] / k, -slope[k:] / len(xu)
    else:
        dg[:k], dg[k:] = -2 * prior * slope[:k] / k, slope[k:] / len(xu)
    dh = np.outer(dg, p[2]) * (1 - h * h)
    return [x.T @ dh, dh.sum(0), h.T @ dg, np.array([dg.sum()])], turned


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, hidden: int = 16, steps: int = 300, rate: float = 0.02, decay: float = 1e-4, seed: int = 5) -> Model | None:
    """Minimises the non-negative unbiased risk by full-batch Adam."""
    if not len(positive) or not len(unlabelled):
        return None
    both = np.concatenate([positive, unlabelled]).astype(np.float64)
    mean, scale = both.mean(0), both.std(0) + 1e-3
    xp, xu = (np.clip((x - mean) / scale, -8, 8) for x in (positive.astype(np.float64), unlabelled.astype(np.float64)))
    rng = np.random.default_rng(seed)
    p = [rng.normal(0, both.shape[1] ** -0.5, (both.shape[1], hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), np.zeros(1)]
    m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    reversals = 0
    for step in range(1, steps + 1):
        grads, turned = gradient(p, xp, xu, prior)
        reversals += turned
        grads = [d + decay * a if a.ndim == 2 or a is p[2] else d for d, a in zip(grads, p, strict=True)]
        for i, d in enumerate(grads):
            m[i] = 0.9 * m[i] + 0.1 * d
            v[i] = 0.999 * v[i] + 0.001 * d * d
            p[i] = p[i] - rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    return Model(mean, scale, p[0], p[1], p[2], float(p[3][0]), prior, reversals)


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, confidence: float = 0.9) -> float:
    """Share of positives among unlabelled texts, within 0.02 and 0.98.

    Above any threshold there are at most q_u / q_p positives for one unlabelled text; where a
    network has put positives alone, that is the prior itself."""
    order = lambda x: x[np.random.default_rng(3).permutation(len(x))]
    (p1, p2), (u1, u2) = (np.array_split(order(x), 2) for x in (positive, unlabelled))
    model = fit(p1, u1, 0.5) if len(p2) and len(u2) else None
    if model is None:
        return 0.5
    sp, su = np.sort(model.score(p2.astype(np.float64))), np.sort(model.score(u2.astype(np.float64)))
    above = lambda s: (len(s) - np.searchsorted(s, sp)) / len(s)
    qp, qu = above(sp), above(su)
    slack = lambda n: np.sqrt(np.log(4 / (1 - confidence)) / (2 * n))
    bound = np.where(qp > slack(len(sp)), (qu + slack(len(su))) / np.maximum(qp - slack(len(sp)), 1e-9), np.inf)
    best = int(np.argmin(bound))
    return float(np.clip(qu[best] / qp[best], 0.02, 0.98)) if np.isfinite(bound[best]) else float(np.clip(qu[0] / qp[0], 0.02, 0.98))


def vectors(docs: DataFrame) -> DataFrame:
    """(doc_id, x array<float>)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in slices(texts):
                x = features(texts[a:b])
                values = pa.ListArray.from_arrays(np.arange(0, x.size + 1, N_FEATURES, dtype=np.int32), x.ravel())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), values], names=["doc_id", "x"])

    return docs.select("doc_id", docs["text"].cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, x array<float>")


def _drawn(df: DataFrame, rows: int) -> DataFrame:
    """About ``rows`` rows at most, by a hash of doc_id."""
    n = max(df.count(), 1)
    return df.filter(F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("draw")), F.lit(1 << 30)) < int(min(1.0, rows / n) * (1 << 30)))


def chosen_rows(docs: DataFrame, marked: DataFrame) -> DataFrame:
    """(doc_id, p, text): a row for each of the drawn ids ``marked`` (doc_id, p); of rows with one id, the least text."""
    rows = docs.select("doc_id", docs["text"].cast("string").alias("text")).join(F.broadcast(marked.select("doc_id", "p").distinct()), "doc_id")
    return rows.groupBy("doc_id", "p").agg(F.min("text").alias("text"))


def train(docs: DataFrame, labels: DataFrame, learn: Column, sample_rows: int = SAMPLE_ROWS) -> Model | None:
    """Fits on the positive labels of learning rows and on the texts of learning rows."""
    known = labels.filter(learn & F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    positive = _drawn(known.filter("quality = 1").select("doc_id"), sample_rows)
    free = _drawn(docs.filter(learn & F.col("doc_id").isNotNull()).select("doc_id"), sample_rows)
    marked = positive.withColumn("p", F.lit(1)).unionByName(free.withColumn("p", F.lit(0)))  # bounded by the draw
    chosen = chosen_rows(docs, marked)
    xs = {1: [], 0: []}
    found = vectors(chosen.select(F.concat_ws(":", "p", F.col("doc_id").cast("string")).alias("doc_id"), "text"))
    for r in found.collect():
        xs[int(r["doc_id"][0])].append((r["doc_id"], r["x"]))
    # rows come in any order; sorted, a model depends on the data alone
    positives, unlabelled = (np.array([x for _, x in sorted(xs[k])], np.float32).reshape(-1, N_FEATURES) for k in (1, 0))
    return fit(positives, unlabelled, estimate_prior(positives, unlabelled)) if len(positives) and len(unlabelled) else None


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, score double)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in slices(texts):
                value = model.score(features(texts[a:b]).astype(np.float64)) if model else np.full(b - a, 0.5)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(value)], names=["doc_id", "score"])

    return docs.select("doc_id", docs["text"].cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, score double")


def held_out_scores(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted), learnt from the labels that are not held out."""
    found = score(docs, train(docs, labels, ~fold(1, 3), sample_rows))
    return found.select("doc_id", fold(1, 3).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep(docs: DataFrame, model: Model | None, least: float = 0.5) -> DataFrame:
    """The documents whose score is ``least`` or more, with all their columns."""
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(place).to_pylist()]
            for a, b in slices(texts):
                value = model.score(features(texts[a:b]).astype(np.float64)) if model else np.full(b - a, 0.5)
                yield batch.slice(a, b - a).filter(pa.array(value >= least))

    return docs.mapInArrow(run, docs.schema)
