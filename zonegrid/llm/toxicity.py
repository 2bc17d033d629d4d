"""Toxicity severity by cumulative-link (proportional-odds) ordinal regression.

Grades are ordered: 0 not toxic, 1 toxic, 2 strongly toxic. ``labels`` only
tells toxic from not, so the upper two grades split the labelled toxic texts at
the median density of words that go with the toxic label. One weight vector is
shared by all grades; ordered thresholds t1 < t2 cut the same score:

    P(grade >= k) = sigmoid(w . x - t_k),   severity = P(>=1) + P(>=2).

Features are sparse: the distinct words of the whole text and the beginnings of
its words, where they are associated with the label (chi-square test, counted in
Spark), each as log(1 + count), the vector scaled to length 1. The classifier is fitted on
a bounded sample of labelled rows (``max_labelled``, the smallest hashes of
doc_id); scoring covers every row and whole texts.

Defined results
  null or empty text     no features: severity of the bare thresholds, kept
  very long text         read whole
  repeated rows          each row is scored by itself, alike for equal texts
  null / repeated labels a row with null toxic is no label; of several labels of
                         a document the largest counts
  no labels, or one class only   no model: severity 0.0, nothing rejected
  empty table            empty result
  extra columns          kept; added names never replace a column unless it is
                         the requested output name
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import col, free_name, small_batches

WORD = re.compile(r"\w+")
PREFIXES = (4, 5, 6, 7)


@dataclass(frozen=True)
class Params:
    max_labelled: int = 8_000    # bound of the labelled sample the model is fitted on
    max_features: int = 2_048    # features kept, by chi-square
    min_docs: int = 5            # labelled documents a feature must occur in
    min_chi2: float = 30.0       # p < 1e-7 with one degree of freedom: chance words stay out
    l2: float = 0.1
    steps: int = 1500


@dataclass
class Model:
    names: list[str] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    thresholds: np.ndarray = field(default_factory=lambda: np.array([np.inf, np.inf]))
    reject_at: float = 1.1   # P(grade >= 1) from which a text is rejected; calibrated by fit


def features(text: str | None) -> Counter:
    """Feature -> count of a whole text: its distinct words, the beginnings of its
    distinct words (``abcd*``, several words may share one)."""
    words = set(WORD.findall(text.lower())) if text else set()
    found = Counter(words)
    for k in PREFIXES:
        found.update([w[:k] + "*" for w in words if len(w) > k])
    return found


def weighed(text: str | None, weight: dict[str, float]) -> float:
    """w . x of a text, added in a fixed order; x has unit length."""
    found = features(text)
    both = [(weight[f], math.log1p(found[f])) for f in sorted(weight.keys() & found.keys())]
    return sum(w * v for w, v in both) / math.sqrt(sum(v * v for _, v in both)) if both else 0.0


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * z))


def fit_ordinal(rows: np.ndarray, cols: np.ndarray, vals: np.ndarray, y: np.ndarray,
                n_features: int, l2: float, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds by gradient ascent (Adam) on the likelihood.

    ``rows``/``cols``/``vals`` are the non-zero entries of the feature matrix, ``y`` the
    grades 0..K. Thresholds are t1, t1 + exp(d2), ...: their order is built in.
    """
    n, k = len(y), int(y.max())
    share = np.clip([np.mean(y >= j) for j in range(1, k + 1)], 1e-6, 1 - 1e-6)
    start = np.log((1 - share) / share)
    theta = np.concatenate([np.zeros(n_features), start[:1],
                            np.log(np.maximum(np.diff(start), 1e-3))])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        w, t1, gaps = theta[:n_features], theta[n_features], np.exp(theta[n_features + 1:])
        t = t1 + np.concatenate([[0.0], np.cumsum(gaps)])
        score = np.bincount(rows, weights=w[cols] * vals, minlength=n)
        above = np.hstack([np.ones((n, 1)), sigmoid(score[:, None] - t), np.zeros((n, 1))])
        slope = above * (1 - above)
        at = np.arange(n)
        p = np.maximum(above[at, y] - above[at, y + 1], 1e-12)
        d_score = (slope[at, y] - slope[at, y + 1]) / p
        g_w = np.bincount(cols, weights=d_score[rows] * vals, minlength=n_features) - l2 * w
        g_t = np.zeros(k)
        for j in range(1, k + 1):   # threshold j bounds grade j from below, j - 1 from above
            g_t[j - 1] = -np.sum(slope[y == j, j] / p[y == j]) + np.sum(
                slope[y == j - 1, j] / p[y == j - 1])
        grad = np.concatenate([g_w, [g_t.sum()],
                               [g_t[j:].sum() * gaps[j - 1] for j in range(1, k)]])
        m = 0.9 * m + 0.1 * grad
        v = 0.999 * v + 0.001 * grad * grad
        theta = theta + 0.05 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    w, t1 = theta[:n_features], theta[n_features]
    return w, t1 + np.concatenate([[0.0], np.cumsum(np.exp(theta[n_features + 1:]))])


def best_cut(p: np.ndarray, toxic: np.ndarray) -> float:
    """The probability cut of the largest F1, midway in its gap between scores."""
    order = np.argsort(-p, kind="stable")
    p, hit = p[order], np.cumsum(toxic[order])
    f1 = 2 * hit / (np.arange(1, len(p) + 1) + toxic.sum())
    last = np.append(p[1:] < p[:-1], True)     # a cut can't part equal scores
    best = int(np.argmax(np.where(last, f1, -1.0)))
    below = p[best + 1] if best + 1 < len(p) else 0.0
    return float((p[best] + below) / 2)


def calibrated_cut(rows: np.ndarray, cols: np.ndarray, vals: np.ndarray, y: np.ndarray,
                   n_features: int, params: "Params") -> float:
    """The rejection cut, from scores of documents their model has not seen."""
    fold = np.arange(len(y)) % 2
    p = np.zeros(len(y))
    for held in (0, 1):
        seen = fold != held
        at = np.cumsum(seen) - 1
        pick = seen[rows]
        w, t = fit_ordinal(at[rows[pick]], cols[pick], vals[pick], y[seen], n_features,
                           params.l2, params.steps)
        z = np.bincount(rows, weights=w[cols] * vals, minlength=len(y))
        p[~seen] = sigmoid(z[~seen] - t[0])
    return best_cut(p, y > 0)


def labelled_sample(docs: DataFrame, labels: DataFrame, params: Params) -> DataFrame:
    """(doc, toxic, body): the bounded labelled sample with its whole texts."""
    lab = (labels.select(F.col("doc_id").alias("doc"), F.col("toxic").cast("int").alias("toxic"))
           .where("doc is not null and toxic is not null")
           .groupBy("doc").agg(F.max("toxic").alias("toxic"))
           .orderBy(F.xxhash64("doc"), "doc").limit(params.max_labelled))
    texts = docs.select(F.col("doc_id").alias("doc"), F.col("text").alias("body"))
    # The sample has at most max_labelled rows of two integers: safe to broadcast.
    return texts.join(F.broadcast(lab), "doc")


def fit(docs: DataFrame, labels: DataFrame, params: Params = Params()) -> Model:
    """Fit on the labelled sample. Features are counted in Spark; the driver gets
    at most ``max_features`` of them and the numbers of ``max_labelled`` rows."""
    spark = docs.sparkSession
    small_batches(spark)
    sample = labelled_sample(docs, labels, params)

    def spread(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            found = [list(features(t)) for t in part["body"]]
            yield pd.DataFrame({"toxic": np.repeat(part["toxic"].to_numpy(), [len(x) for x in found]),
                                "feature": [f for x in found for f in x]})

    total = {r["toxic"]: r["n"] for r in
             sample.groupBy((F.col("toxic") > 0).alias("toxic")).agg(F.count("*").alias("n")).collect()}
    n1, n0 = total.get(True, 0), total.get(False, 0)
    if not n1 or not n0:
        return Model()
    n = float(n1 + n0)
    a, b = F.col("in_toxic"), F.col("in_all") - F.col("in_toxic")
    margin = F.col("in_all") * (n - F.col("in_all")) * (n1 * float(n0))
    chi2 = n * F.pow(a * (n0 - b) - b * (n1 - a), F.lit(2.0)) / margin
    counts = (sample.select("toxic", "body").mapInPandas(spread, "toxic int, feature string")
              .groupBy("feature").agg(F.sum((F.col("toxic") > 0).cast("double")).alias("in_toxic"),
                                      F.count("*").cast("double").alias("in_all"))
              .where((F.col("in_all") >= params.min_docs) & (F.col("in_all") < n))
              .withColumn("chi2", chi2).where(F.col("chi2") >= params.min_chi2)
              .orderBy(F.desc("chi2"), "feature").limit(params.max_features).collect())
    names = [r["feature"] for r in counts]
    if not names:
        return Model()
    place = {f: i for i, f in enumerate(names)}
    on_toxic_side = {place[r["feature"]] for r in counts
                     if r["in_toxic"] / n1 > (r["in_all"] - r["in_toxic"]) / n0}

    def numbers(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            got = [features(t) for t in part["body"]]
            at = [{place[f]: c for f, c in x.items() if f in place} for x in got]
            yield pd.DataFrame({"doc": part["doc"], "toxic": part["toxic"],      # ids as text: of any type
                                "n": [len(x) for x in got],
                                "at": [list(x) for x in at], "c": [list(x.values()) for x in at]})

    got = (sample.withColumn("doc", F.col("doc").cast("string"))
           .mapInPandas(numbers, "doc string, toxic int, n long, at array<int>, c array<int>").toPandas())
    if isinstance(sample.schema["doc"].dataType, T.IntegralType):
        got["doc"] = got["doc"].astype("int64")           # numbers go by size
    got = got.iloc[np.lexsort([got["n"], got["doc"]])].reset_index(drop=True)
    rows = np.repeat(np.arange(len(got)), [len(x) for x in got["at"]])
    cols = np.array([i for x in got["at"] for i in x], dtype=np.int64)
    vals = np.log1p(np.array([c for x in got["c"] for c in x], dtype=float))
    vals /= np.sqrt(np.bincount(rows, weights=vals * vals, minlength=len(got)))[rows]
    toxic = (got["toxic"] > 0).to_numpy()
    density = np.array([sum(k for i, k in zip(at, c) if i in on_toxic_side) / max(1, length)
                        for at, c, length in zip(got["at"], got["c"], got["n"])])
    y = toxic.astype(np.int64)
    y[toxic & (density > np.median(density[toxic]))] = 2
    size = len(names)
    w, t = fit_ordinal(rows, cols, vals, y, size, params.l2, params.steps)
    both = all(len(set(np.minimum(y[i::2], 1))) == 2 for i in (0, 1))
    return Model(names, w, t,
                 calibrated_cut(rows, cols, vals, y, size, params) if both else 0.5)


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "toxicity") -> DataFrame:
    """``docs`` with a struct column ``out``: severity (0 to 2), p_toxic, grade."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(   # at most max_features entries
        (dict(zip(model.names, model.weights.tolist())), model.thresholds))

    @F.pandas_udf("severity double, p_toxic double, grade int")
    def grade(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        weight, thresholds = shared.value
        for texts in parts:
            z = np.array([weighed(t, weight) for t in texts], dtype=float)
            above = sigmoid(z[:, None] - thresholds)
            p = np.hstack([1 - above[:, :1], -np.diff(above, axis=1), above[:, -1:]])
            yield pd.DataFrame({"severity": above.sum(axis=1), "p_toxic": above[:, 0],
                                "grade": p.argmax(axis=1).astype("int32")})

    return docs.withColumn(out, grade(col(text)))


def reject(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not rejected, with their own columns only."""
    name = free_name(docs, "toxicity")
    kept = score(docs, model, text, name).where(col(name)["p_toxic"] < model.reject_at)
    return kept.drop(name)
