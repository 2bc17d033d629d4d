"""Language identification by interpolated Kneser-Ney character models.

One model of order 4 per language. A text is the lower-cased sequence of its
letters, with one blank for whatever parts them. The n-grams of all languages
stand in sorted arrays of 64-bit hashes, one an order, each beside the log
probabilities it has under every language, so one binary search serves all of
them; what is unseen backs off by the context's weight. A text gets the language
of least cross-entropy per character.

Learning takes about ``docs_per_lang`` labelled texts of each language, those of
the least hashes of doc_id (the share is set from exact counts over all labelled
rows). A tenth of them is kept out of the counts and calibrates two numbers: the
sharpness of ``score``, and the cross-entropy beyond which a text is unlike any
learned language (``rejected``). Prediction reads the text alone.

Defined results
  null text, no letter    lang ``und``, score 0, rejected
  very long text          read whole, in blocks of documents
  ties                    the language that sorts first
  repeated rows           one result each, alike for equal texts
  null lang               not learned from, predicted like others
  no labelled text        every row ``und``, score 0, rejected
  empty table             empty result
  extra columns           kept by ``predict``
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, small_batches

ORDER = 4
BASE = 0x9E3779B97F4A7C15              # fixed value: 2^64 / golden ratio, odd
BLOCK = 1 << 20                        # characters scored at once
UND = "und"


@dataclass(frozen=True)
class Params:
    docs_per_lang: int = 1_000       # bound of the labelled sample of a language (expected number)
    calibration_share: int = 10      # every tenth of them calibrates
    keep_share: float = 0.995        # share of calibration texts that must not be rejected
    max_langs: int = 10_000          # most different labels
    max_model_bytes: int = 256 << 20


@dataclass
class Model:
    langs: list[str]
    grams: list[np.ndarray]      # per order 1..4: sorted hashes
    logp: list[np.ndarray]       # per order: (grams, languages)
    contexts: list[np.ndarray]   # per context length 1..3: sorted hashes
    backoff: list[np.ndarray]    # per context length: log weights
    unseen: np.ndarray           # log probability of a letter nobody has seen
    sharpness: float = 1.0
    limit: float = np.inf

    def size(self) -> int:
        return sum(a.nbytes for x in (self.grams, self.logp, self.contexts, self.backoff) for a in x)


class Letters:
    """code point -> itself if a letter, else 0; looked up once per code point."""

    def __init__(self) -> None:
        self.table = np.zeros(0x110000, dtype=np.uint32)
        self.known = np.zeros(0x110000, dtype=bool)

    def __call__(self, text: str | None) -> np.ndarray:
        """The symbols of a text: letters, single 0 between words, none at its ends."""
        if not text:
            return np.zeros(0, dtype=np.uint32)
        points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        new = points[~self.known[points]]
        if len(new):
            new = np.unique(new)
            self.table[new] = [p if chr(p).isalpha() else 0 for p in new.tolist()]
            self.known[new] = True
        out = self.table[points]
        keep = out > 0
        keep[1:] |= out[:-1] > 0
        out = out[keep]
        return out[:-1] if len(out) and not out[-1] else out


def joined(each: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of several texts behind each other, each after 3 zeros; the places
    that are predicted; and the text each place belongs to."""
    pad = np.zeros(ORDER - 1, dtype=np.uint32)
    line = np.concatenate([x for e in each for x in (pad, e)] or [pad])
    sizes = np.array([len(e) for e in each], dtype=np.int64)
    owner = np.repeat(np.arange(len(each)), sizes)
    return line, np.arange(len(owner)) + (ORDER - 1) * (owner + 1), owner


def hashes(line: np.ndarray, places: np.ndarray, order: int) -> np.ndarray:
    """The hash of the ``order`` symbols that end at each place."""
    out = line[places].astype(np.uint64)
    for back in range(1, order):
        out += line[places - back] * np.uint64(pow(BASE, back, 1 << 64))
    return out


def find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, found) of keys in a sorted table."""
    if not len(table):
        return np.zeros(len(keys), dtype=np.int64), np.zeros(len(keys), dtype=bool)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


def log_probs(model: Model, line: np.ndarray, places: np.ndarray) -> np.ndarray:
    """(places, languages): log P(symbol | up to 3 symbols before it)."""
    out = np.zeros((len(places), len(model.langs)), dtype=np.float32)
    open_ = np.arange(len(places))
    for order in range(ORDER, 0, -1):
        at, hit = find(model.grams[order - 1], hashes(line, places[open_], order))
        out[open_[hit]] += model.logp[order - 1][at[hit]]
        open_ = open_[~hit]
        if not len(open_):
            return out
        if order > 1:   # unseen here: the context's weight, and one symbol less of it
            at, hit = find(model.contexts[order - 2], hashes(line, places[open_] - 1, order - 1))
            out[open_[hit]] += model.backoff[order - 2][at[hit]]
    out[open_] += model.unseen
    return out


def cross_entropies(model: Model, each: list[np.ndarray]) -> np.ndarray:
    """(texts, languages): mean bits per symbol; infinite for texts without letters."""
    out = np.full((len(each), len(model.langs)), np.inf)
    sums, counts = np.zeros((len(each), len(model.langs))), np.array([len(e) for e in each])
    line, places, owner = joined(each)
    for a in range(0, len(places), BLOCK):
        own = owner[a:a + BLOCK]
        first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        sums[own[first]] += np.add.reduceat(
            log_probs(model, line, places[a:a + BLOCK]).astype(np.float64), first, axis=0)
    some = counts > 0
    out[some] = -sums[some] / counts[some, None] / np.log(2)
    return out


def kneser_ney(counts: pd.DataFrame, langs: list[str]) -> Model:
    """The model from (lang, gram, n): counts of 4-symbol strings, blanks for 0."""
    symbols = np.array([[0 if c == " " else ord(c) for c in g] for g in counts["gram"]],
                       dtype=np.uint32).reshape(-1, ORDER)
    lang = counts["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy(dtype=np.int64)
    n = counts["n"].to_numpy(dtype=np.float64)
    levels = []   # per order, highest first: (lang, symbols, count)
    for order in range(ORDER, 0, -1):
        levels.append((lang, symbols, n))
        # Below the highest order an n-gram counts the different symbols before it.
        rows = np.column_stack([lang.astype(np.uint32), symbols[:, 1:]])
        rows, n = np.unique(rows, axis=0, return_counts=True)
        lang, symbols, n = rows[:, 0].astype(np.int64), rows[:, 1:], n.astype(np.float64)
    alphabet = len(np.unique(levels[-1][1])) + 1
    size = len(langs)
    grams, logp, contexts, backoff = [], [], [], []
    below = np.full((1, size), 1.0 / alphabet)
    unseen = None
    for order, (lang, symbols, n) in enumerate(reversed(levels), start=1):
        ends = np.full(len(symbols), order - 1)
        line, base = symbols.ravel(), np.arange(len(symbols)) * order
        keys = hashes(line, base + ends, order)
        table = np.unique(keys)
        row = np.searchsorted(table, keys)
        ctx = hashes(line, base + ends - 1, order - 1) if order > 1 else np.zeros(len(keys), dtype=np.uint64)
        ctx_table = np.unique(ctx)
        ctx_row = np.searchsorted(ctx_table, ctx)
        one = np.array([np.sum(n[lang == i] == 1) for i in range(size)], dtype=float)
        two = np.array([np.sum(n[lang == i] == 2) for i in range(size)], dtype=float)
        discount = np.clip(one / np.maximum(one + 2 * two, 1), 0.1, 0.95)
        total, kinds = np.zeros((len(ctx_table), size)), np.zeros((len(ctx_table), size))
        np.add.at(total, (ctx_row, lang), n)
        np.add.at(kinds, (ctx_row, lang), 1)
        weight = np.where(total > 0, discount * kinds / np.maximum(total, 1), 1.0)
        counted = np.zeros((len(table), size))
        np.add.at(counted, (row, lang), np.maximum(n - discount[lang], 0))
        ctx_of = np.zeros(len(table), dtype=np.int64)
        ctx_of[row] = ctx_row
        if order > 1:
            low = np.zeros(len(table), dtype=np.int64)
            low[row] = np.searchsorted(below_table, hashes(line, base + ends, order - 1))
            prior = below[low]
        else:
            prior = np.repeat(below, len(table), axis=0)
            unseen = np.log(weight[0] / alphabet) if len(weight) else np.zeros(size)
        now = counted / np.maximum(total[ctx_of], 1) + weight[ctx_of] * prior
        grams.append(table)
        logp.append(np.log(now).astype(np.float32))
        if order > 1:
            contexts.append(ctx_table)
            backoff.append(np.log(weight).astype(np.float32))
        below, below_table = now, table
    return Model(langs, grams, logp, contexts, backoff, unseen.astype(np.float32))


def gram_counts(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    letters = Letters()
    for part in parts:
        rows = []
        for lang, own in part.groupby("lang"):
            line, places, _ = joined([letters(t) for t in own["body"]])
            if len(places):
                _, first, n = np.unique(hashes(line, places, ORDER), return_index=True, return_counts=True)
                for i, c in zip(places[first].tolist(), n.tolist()):
                    rows.append((lang, "".join(chr(x) if x else " " for x in line[i - 3:i + 1].tolist()), c))
        yield pd.DataFrame(rows, columns=["lang", "gram", "n"])


def labelled_sample(docs: DataFrame, params: Params, doc: str, text: str, lang: str) -> DataFrame:
    """(doc, lang, body, tenth): about ``docs_per_lang`` texts with letters a language."""
    rows = (docs.select(col(doc).alias("doc"), col(lang).cast("string").alias("lang"), col(text).alias("body"))
            .where(F.col("lang").isNotNull() & (F.col("lang") != UND)
                   & F.coalesce(F.col("body").rlike(r"\p{L}"), F.lit(False)))
            .withColumn("hash", F.xxhash64("doc")))
    counts = rows.groupBy("lang").count().limit(params.max_langs + 1).collect()
    if len(counts) > params.max_langs:
        raise ValueError(f"over {params.max_langs} different labels: these are not languages")
    share = docs.sparkSession.createDataFrame(
        [(r["lang"], params.docs_per_lang / r["count"]) for r in counts], "lang string, share double")
    unit = F.pmod("hash", F.lit(1 << 30)) / float(1 << 30)
    return (rows.join(F.broadcast(share), "lang").where(unit < F.col("share"))
            .select("doc", "lang", "body",
                    F.pmod(F.shiftright("hash", 32), F.lit(params.calibration_share)).alias("tenth")))


def fit(docs: DataFrame, params: Params = Params(), doc: str = "doc_id", text: str = "text",
        lang: str = "lang") -> Model | None:
    """Learn from the labelled rows of ``docs``; n-grams are counted in Spark. None
    if there is nothing to learn from."""
    small_batches(docs.sparkSession)
    sample = labelled_sample(docs, params, doc, text, lang)
    counts = (sample.where("tenth <> 0").select("lang", "body")
              .mapInPandas(gram_counts, "lang string, gram string, n long")
              .groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas())
    if not len(counts):
        return None
    counts = counts.sort_values(["lang", "gram"]).reset_index(drop=True)
    model = kneser_ney(counts, sorted(counts["lang"].unique()))
    if model.size() > params.max_model_bytes:
        raise ValueError(f"the model has {model.size()} bytes: too large to broadcast")
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))

    def judge(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        letters, m = Letters(), Model(**shared.value)
        for part in parts:
            h = cross_entropies(m, [letters(t) for t in part["body"]])
            yield pd.DataFrame({"lang": part["lang"], "n": [len(letters(t)) for t in part["body"]],
                                "h": list(h)})

    held = (sample.where("tenth = 0").select("lang", "body")
            .mapInPandas(judge, "lang string, n long, h array<double>").toPandas())
    return calibrated(model, held, params)


def calibrated(model: Model, held: pd.DataFrame, params: Params) -> Model:
    held = held[held["lang"].isin(model.langs)]
    if len(held):
        h = np.vstack(held["h"].to_list())
        own = held["lang"].map({x: i for i, x in enumerate(model.langs)}).to_numpy()
        at = np.arange(len(h))
        tries = [2.0 ** k for k in range(-2, 9)]
        model.sharpness = min(tries, key=lambda s: -np.log(np.maximum(share_of(h, s)[at, own], 1e-9)).mean())
        model.limit = float(np.quantile(h.min(axis=1), params.keep_share) * 1.1)
    return model


def share_of(h: np.ndarray, sharpness: float) -> np.ndarray:
    e = np.exp(-sharpness * (h - h.min(axis=1, keepdims=True)))
    return e / e.sum(axis=1, keepdims=True)


def predict(docs: DataFrame, model: Model | None, text: str = "text", out: str = "language") -> DataFrame:
    """``docs`` with a struct ``out``: lang, score, cross_entropy, rejected."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(   # at most max_model_bytes
        vars(model) if model is not None else None)

    @F.pandas_udf("lang string, score double, cross_entropy double, rejected boolean")
    def judge(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        letters, m = Letters(), Model(**shared.value) if shared.value is not None else None
        for texts in parts:
            each = [letters(t) for t in texts]
            lang = np.full(len(each), UND, dtype=object)
            score, best = np.zeros(len(each)), np.full(len(each), np.nan)
            some = np.array([len(e) > 0 for e in each], dtype=bool)
            if m is not None and some.any():
                h = cross_entropies(m, each)[some]
                lang[some] = np.array(m.langs, dtype=object)[h.argmin(axis=1)]
                score[some], best[some] = share_of(h, m.sharpness).max(axis=1), h.min(axis=1)
            limit = m.limit if m is not None else -np.inf
            yield pd.DataFrame({"lang": lang, "score": score, "cross_entropy": best,
                                "rejected": ~(best <= limit)})

    return docs.withColumn(out, judge(col(text)))


def held_out(doc: Column) -> Column:
    """Whether a document is kept out of learning: crc32 of its id, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc.cast("string").cast("binary")) % 4 == 2, F.lit(False))
