"""Language-model scoring by masked pseudo-likelihood.

Each token of a text is predicted from the ``side`` tokens before and after it,
itself hidden, by a small window network trained in numpy:

    h = tanh(sum of position-wise embeddings + a)
    P(class | both sides) = softmax(h T + t)[group] * softmax(h W_group + b_group)[class]

A document's score is the sum of the log probabilities of all its tokens.
Tokens are lower-cased words and single marks. The vocabulary is every word of the
corpus, counted in Spark, in classes by frequency: the most frequent words are classes
of their own, the ``KNOWN`` next ones share a class with the words of about their count
(half an octave), all others one with the words of their form (marks, numbers, letters
by length). Classes stand in order of frequency, ``GROUP`` behind each other in a group,
so a token costs two short softmaxes. Then

    P(token) = P(class | both sides) * P(word | class),   P(word | class) = n / N

with n the word's count in the corpus and N that of its class (N + 1 in the classes by
form; the 1 is for a word that the counts don't hold). Counts of the known words go to
the tasks; what else a text holds is joined with the count table on the word. The
biases start at the corpus's log frequencies. ``fit_and_score`` splits and numbers the texts
once and keeps the classes of their tokens, two bytes each, for training and scoring. A sample bounded in documents (about
``sample_docs``, drawn with a fixed seed) and in windows (``sample_tokens``, as many from
each document) gives the network its start; then every token of every document trains
it: each task takes steps over its documents from that start, and the networks that
the tasks arrive at are averaged, weighted by their tokens. So scores depend a little
on how the rows lie in partitions.

Defined results
  null or empty text    no tokens: score 0, mean null
  very long text        read whole, in blocks of tokens
  texts at their ends   a boundary token stands outside, so one token is scored
  ties in counts        the word that sorts first gets the smaller number
  repeated rows         count as often as they stand; equal texts score alike, up
                        to rounding
  new words             count as one word seen once in the class of their form
  empty table           empty result
  extra columns         kept by ``score``
"""

from __future__ import annotations

import math
import re
import string
import sys
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, free_name, small_batches, stored

TOKEN = re.compile(r"\w+|[^\w\s]")
DIGIT = re.compile(r"\d")
MARKS = string.punctuation.replace("_", "")
GROUP = 16            # classes of a group
FORMS = 13            # classes by form
BLOCK = 1 << 11       # tokens scored at once
HELD = 300_000        # distinct blank-delimited pieces a task holds
HELD_CHARS = 1 << 25  # characters of text a task counts before it passes its words on
LONG = 64             # characters of the longest piece that is held
KNOWN = 200_000       # words whose counts go to the tasks; the others are joined
UNUSED = -30.0        # bias of numbers that no token has


@dataclass(frozen=True)
class Params:
    words: int = 159          # words with classes of their own
    side: int = 3             # tokens seen on each side
    width: int = 16
    sample_docs: int = 2_000  # bound of the sample the network starts from (expected number)
    sample_tokens: int = 200_000   # bound of the windows drawn from it
    passes: int = 3
    rate: float = 0.01
    rounds: int = 1           # passes over all documents after the start
    seed: int = 11


@dataclass
class Model:
    number: dict[str, int]   # classes of the frequent words; 0 is the boundary
    known: dict[str, int]    # counts of the next frequent words
    bands: dict[int, int]    # their classes, by band of the count
    forms: int               # class of form 0; the other forms follow
    embed: np.ndarray        # (2 side, numbers, width)
    shift: np.ndarray
    top: np.ndarray          # (width, groups)
    lean: np.ndarray
    out: np.ndarray          # (width, numbers): those of a group side by side
    bias: np.ndarray
    totals: np.ndarray       # by class: log N, 0 of a frequent word
    counts: DataFrame | None = None   # (word, n) of the words that are in neither

    @property
    def numbers(self) -> int:
        return len(self.bias)

    def classes(self) -> dict[str, int]:
        of = {n: self.bands[band(n)] for n in set(self.known.values())}
        return {**self.number, **dict(zip(self.known, map(of.__getitem__, self.known.values())))}

    def shared(self) -> dict:
        """What tasks need of it; its size is set by Params and KNOWN."""
        return {k: v for k, v in vars(self).items() if k != "counts"}

    def network(self) -> dict:
        """What tasks need that read numbered texts."""
        return {**self.shared(), "number": {}, "known": {}}


def band(n: int) -> int:
    return math.floor(2 * math.log2(n))


def form(word: str) -> int:
    """Marks, numbers, words with digits, then letters by length, those outside ASCII apart."""
    if not (word[0].isalnum() or word[0] == "_"):
        return 0
    if not word.isalpha() and DIGIT.search(word):
        return 1 if word.isdecimal() else 2
    return (3 if word.isascii() else 8) + min((len(word) - 1) // 3, 4)


class Codes(dict):
    """Blank-delimited piece -> numbers of its tokens (the bytes of an int32 array), by
    ``index`` or from ``forms`` on by form; no token goes across a blank. A piece of several
    tokens is made of theirs. Forgets all between texts when too large."""

    def __init__(self, index: dict[str, int], forms: int) -> None:
        super().__init__()
        self.index, self.forms = index, forms
        self.own = [n.to_bytes(4, sys.byteorder) for n in range(forms + FORMS)]   # one object a number

    def __missing__(self, piece: str) -> bytes:
        words = split(piece)
        if len(words) == 1:
            n = self.index.get(piece) or self.other(piece)
            found = self.own[n] if n < len(self.own) else n.to_bytes(4, sys.byteorder)
        else:
            found = b"".join(map(self.__getitem__, words))
        if len(piece) <= LONG:
            self[piece] = found
        return found

    def other(self, word: str) -> int:
        return self.forms + form(word)

    def of(self, text: str | None) -> np.ndarray:
        if len(self) > HELD:
            self.clear()
        return np.frombuffer(b"".join(map(self.__getitem__, pieces_of(text))), dtype=np.int32)


class Named(Codes):
    """Numbers words outside ``index`` apart, from ``forms`` on, ``GROUP`` for each: its form
    is added, and ``words`` holds them until the next text."""

    def __init__(self, index: dict[str, int], forms: int) -> None:
        super().__init__(index, forms)
        self.words: list[str] = []

    def other(self, word: str) -> int:
        self.words.append(word)
        return self.forms + GROUP * (len(self.words) - 1) + form(word)

    def of(self, text: str | None) -> np.ndarray:
        if len(self) > HELD or len(self.words) > HELD:
            self.clear()
            self.words = []
        return super().of(text)

    def others(self, numbers: np.ndarray) -> Counter:
        """The words outside ``index`` among ``numbers``, those of the last text."""
        return Counter(self.words[k] for k in ((numbers[numbers >= self.forms] - self.forms) // GROUP).tolist())


def split(piece: str) -> list[str]:
    """The tokens of a piece without blanks; most are a word, or one with marks behind it."""
    if piece.isalnum():
        return [piece]
    word = piece.rstrip(MARKS)
    return [word, *piece[len(word):]] if word.isalnum() else TOKEN.findall(piece)


def pieces_of(text: str | None) -> list[str]:
    return text.lower().split() if text else []


def tokens_of(text: str | None) -> list[str]:
    return TOKEN.findall(text.lower()) if text else []


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, n) over every token of the corpus; tasks combine before the shuffle and split
    each distinct piece once."""
    small_batches(docs.sparkSession)

    def words_of(held: Counter) -> pd.DataFrame:
        words: dict[str, int] = {}
        for piece, n in held.items():
            for w in split(piece):
                words[w] = words.get(w, 0) + n
        return pd.DataFrame(words.items(), columns=["word", "n"]).astype({"word": object, "n": "int64"})

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, chars = Counter(), 0
        for part in parts:
            for body in part["body"]:
                held.update(pieces_of(body))
                chars += len(body or "")
                if len(held) > HELD or chars > HELD_CHARS:
                    yield words_of(held)
                    held, chars = Counter(), 0
        yield words_of(held)

    return (docs.select(col(text).alias("body")).mapInPandas(count, "word string, n long")
            .groupBy("word").agg(F.sum("n").alias("n")))


def joined(codes: list[np.ndarray], side: int) -> tuple[np.ndarray, np.ndarray]:
    """(line, places): texts behind each other, ``side`` boundaries around each."""
    pad = np.zeros(side, dtype=np.int64)
    line = np.concatenate([pad, *(x for c in codes for x in (c, pad))])
    return line, np.flatnonzero(line)   # 0 is the boundary alone


def hidden(m: Model, line: np.ndarray, places: np.ndarray, side: int) -> np.ndarray:
    """tanh of what stands around each place, without what stands there; the places lie in
    a run of the line."""
    a, b, width = places.min(), places.max() + 1, len(m.shift)
    every = m.embed.transpose(1, 0, 2).reshape(m.numbers, -1).take(line[a - side:b + side], axis=0)
    h = np.tile(m.shift, (b - a, 1))
    for i, back in enumerate([*range(-side, 0), *range(1, side + 1)]):
        h += every[side + back:side + back + b - a, i * width:(i + 1) * width]
    h = h.take(places - a, axis=0)
    return np.tanh(h, out=h)


def chosen(z: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log softmax of each column of ``z`` at its row ``own``; ``z`` becomes the softmax but
    for a factor, its columns' sums, which are returned second."""
    z -= z.max(axis=0)
    log = z[own, np.arange(len(own))]
    np.exp(z, out=z)
    total = z.sum(axis=0)
    return log - np.log(total), total


def by_group(m: Model, line: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, list[tuple[int, slice, slice]]]:
    """(places in order of their group, (group, its places, its numbers) for those that occur)."""
    group = (line[at] // GROUP).astype(np.int16)
    order = np.argsort(group, kind="stable")
    ends = np.cumsum(np.bincount(group, minlength=m.numbers // GROUP)).tolist()
    parts = [(g, slice(a, b), slice(g * GROUP, (g + 1) * GROUP))
             for g, (a, b) in enumerate(zip([0, *ends], ends)) if a < b]
    return order, parts


def predict(m: Model, line: np.ndarray, at: np.ndarray, parts: list, side: int) -> tuple[np.ndarray, ...]:
    """(h, weights of the groups, their sums, weights in the group, their sums, log P) for
    places ``at`` in order of their group; P is a weight by its sum."""
    y = line[at]
    h = hidden(m, line, at, side)
    groups = m.top.T @ h.T
    groups += m.lean[:, None]
    inside = np.empty((GROUP, len(at)), dtype=np.float32)
    for _, rows, own in parts:
        np.add(m.out[:, own].T @ h[rows].T, m.bias[own, None], out=inside[:, rows])
    first, all_groups = chosen(groups, y // GROUP)
    second, all_inside = chosen(inside, y % GROUP)
    return h, groups, all_groups, inside, all_inside, first + second


class Steps:
    """Adam on a model, changed in place; gradients by hand."""

    NAMES = ("embed", "shift", "top", "lean", "out", "bias")

    def __init__(self, m: Model, side: int, rate: float, batch: int) -> None:
        self.m, self.side, self.rate, self.batch, self.step = m, side, rate, batch, 0
        self.first = {k: np.zeros_like(getattr(m, k)) for k in self.NAMES}
        self.second = {k: np.zeros_like(getattr(m, k)) for k in self.NAMES}

    def over(self, line: np.ndarray, places: np.ndarray, random: np.random.RandomState) -> None:
        """Steps over runs of places, the runs in any order."""
        for k in random.permutation(-(-len(places) // self.batch)):
            self.take(line, places[k * self.batch:(k + 1) * self.batch])

    def gradients(self, line: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean negative log probability of the tokens at ``at``."""
        m = self.m
        order, parts = by_group(m, line, at)
        at = at[order]
        h, groups, all_groups, inside, all_inside, _ = predict(m, line, at, parts, self.side)
        y, row = line[at], np.arange(len(at))
        share = np.float32(1 / len(at))
        for z, total, own in (groups, all_groups, y // GROUP), (inside, all_inside, y % GROUP):
            z *= share / total
            z[own, row] -= share
        dh = groups.T @ m.top.T
        grads = {"top": h.T @ groups.T, "lean": groups.sum(axis=1), "out": np.zeros_like(m.out),
                 "bias": np.zeros_like(m.bias), "embed": np.zeros_like(m.embed)}
        for _, rows, own in parts:
            dh[rows] += inside[:, rows].T @ m.out[:, own].T
            grads["out"][:, own] = (inside[:, rows] @ h[rows]).T
            grads["bias"][own] = inside[:, rows].sum(axis=1)
        dh *= 1 - h * h
        grads["shift"] = dh.sum(axis=0)
        a, b, width, side = at.min(), at.max() + 1, len(m.shift), self.side
        spread = np.zeros((b - a, width), dtype=dh.dtype)
        spread[at - a] = dh
        wide = np.zeros((b - a + 2 * side, 2 * side * width), dtype=dh.dtype)
        for i, back in enumerate([*range(-side, 0), *range(1, side + 1)]):
            wide[side + back:side + back + b - a, i * width:(i + 1) * width] = spread
        seen = line[a - side:b + side].astype(np.int16)
        order = np.argsort(seen, kind="stable")
        seen = seen[order]
        starts = np.flatnonzero(np.diff(seen, prepend=-1))
        sums = np.add.reduceat(wide.take(order, axis=0), starts, axis=0)
        grads["embed"][:, seen[starts]] = sums.reshape(len(starts), 2 * side, width).transpose(1, 0, 2)
        return grads

    def take(self, line: np.ndarray, at: np.ndarray) -> None:
        grads = self.gradients(line, at)
        self.step += 1
        for k in self.NAMES:
            self.first[k] += 0.1 * (grads[k] - self.first[k])
            self.second[k] += 0.001 * (grads[k] ** 2 - self.second[k])
            value = getattr(self.m, k)
            value -= (self.rate * (self.first[k] / (1 - 0.9 ** self.step))
                      / (np.sqrt(self.second[k] / (1 - 0.999 ** self.step)) + 1e-8)).astype(np.float32)


def drawn(codes: np.ndarray, side: int, limit: int, seed: int) -> np.ndarray:
    """At most ``limit`` windows of a text, behind each other: each has a token and its sides."""
    line, places = joined([codes], side)
    if len(places) > limit:
        places = np.random.RandomState(seed).choice(places, limit, replace=False)
    return line[places[:, None] + np.arange(-side, side + 1)].astype(np.int16).ravel()


def train(m: Model, windows: np.ndarray, p: Params) -> None:
    """Passes over shuffled windows of the sample."""
    random, size = np.random.RandomState(p.seed), 2 * p.side + 1
    steps = Steps(m, p.side, p.rate, 512)
    places = np.arange(p.side, len(windows), size)
    for _ in range(p.passes):
        steps.over(random.permutation(windows.reshape(-1, size)).ravel(), places, random)


def train_round(numbers: DataFrame, m: Model, p: Params) -> None:
    """One pass over all of ``numbers``: the mean of the tasks' networks."""
    small_batches(numbers.sparkSession)
    shared = numbers.sparkSession.sparkContext.broadcast(m.network())

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Model(**shared.value)
        for k in Steps.NAMES:
            setattr(own, k, getattr(own, k).copy())   # tasks of a worker share what is broadcast
        steps = Steps(own, p.side, p.rate, 2048)
        random, n = np.random.RandomState(p.seed), 0
        for part in parts:
            line, places = joined([classes_in(c) for c in part["codes"]], p.side)
            steps.over(line, places, random)
            n += len(places)
        flat = np.concatenate([getattr(own, k).ravel() for k in Steps.NAMES] if n else [np.zeros(0)])
        yield pd.DataFrame({"place": np.arange(len(flat), dtype=np.int32), "value": flat.astype(np.float64),
                            "n": np.full(len(flat), n, dtype=np.int64)})

    texts = numbers.select("lm.codes").where(F.col("codes").isNotNull())
    mean = (texts.mapInPandas(run, "place int, value double, n long").groupBy("place")
            .agg((F.sum(F.col("value") * F.col("n")) / F.sum("n")).alias("value")).toPandas().sort_values("place"))
    if len(mean):
        flat, begin = mean["value"].to_numpy(dtype=np.float32), 0
        for k in Steps.NAMES:
            old = getattr(m, k)
            setattr(m, k, flat[begin:begin + old.size].reshape(old.shape))
            begin += old.size


def known_words(counts: DataFrame) -> tuple[dict[str, int], DataFrame]:
    """(counts of the most frequent words, table of the others): whole levels of the
    count, from the top, as long as they are at most ``KNOWN`` words. So a word of the
    others is rare enough for a join."""
    level = F.floor(F.log2("n") * 4)
    least, total = None, 0
    for r in sorted(counts.groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect(), reverse=True):
        total += r["n"]
        if total > KNOWN:
            break
        least = r["level"]
    if least is None:
        return {}, counts
    some = counts.where(level >= least).toPandas()
    return dict(zip(some["word"], some["n"].tolist())), counts.where(level < least)


def begin(docs: DataFrame, params: Params, text: str) -> tuple[Model, DataFrame]:
    """(model, counts): the network after its start on the sample, and the corpus counts."""
    p = params
    counts = stored(word_counts(docs, text), "word-counts")
    top = counts.orderBy(F.desc("n"), "word").limit(p.words).collect()
    number = {r["word"]: i + 1 for i, r in enumerate(top)}
    known, others = known_words(counts.where(~F.col("word").isin(list(number))))
    sums: Counter = Counter()
    for n in known.values():
        sums[band(n)] += n
    bands = {b: len(number) + 1 + i for i, b in enumerate(sorted(sums, reverse=True))}
    forms = len(number) + 1 + len(bands)

    @F.pandas_udf("int")
    def form_of(words: pd.Series) -> pd.Series:
        return words.map(form)

    unknown = dict(others.groupBy(form_of("word").alias("form")).agg(F.sum("n").alias("n")).collect())
    groups = -(-(forms + FORMS) // GROUP)
    n = np.concatenate([[0.0], [r["n"] for r in top], [sums[b] for b in bands],
                        [unknown.get(f, 0) + 1 for f in range(FORMS)]])
    bias = np.full(groups * GROUP, UNUSED)
    bias[1:len(n)] = np.log(n[1:])
    totals = np.zeros(len(bias))
    totals[len(number) + 1:len(n)] = np.log(n[len(number) + 1:])
    lean = np.logaddexp.reduce(bias.reshape(groups, GROUP), axis=1)
    random = np.random.RandomState(p.seed)

    def small(*shape: int) -> np.ndarray:
        return random.normal(0, 0.1, shape).astype(np.float32)

    model = Model(number, known, bands, forms, small(2 * p.side, len(bias), p.width), np.zeros(p.width, dtype=np.float32),
                  small(p.width, groups), (lean - np.logaddexp.reduce(lean)).astype(np.float32),
                  small(p.width, len(bias)), (bias - np.repeat(lean, GROUP)).astype(np.float32), totals, others)
    body = col(text)
    some = docs.where(body.isNotNull() & (body != "")).select(body.alias("body"))
    rows = some.count()
    share = p.sample_docs / max(1, rows)   # a share of the rows, so that no text is moved to be ordered
    limit = p.sample_tokens // max(1, min(p.sample_docs, rows))
    shared = docs.sparkSession.sparkContext.broadcast(model.shared())

    @F.pandas_udf("array<short>")
    def windows(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = Model(**shared.value)
        codes = Codes(m.classes(), m.forms)
        for texts in parts:
            yield texts.map(lambda t: drawn(codes.of(t), p.side, limit, zlib.crc32(t.encode()) ^ p.seed))

    sample = some.where(F.rand(p.seed) < share).select(windows("body").alias("codes")).toPandas()
    line = np.concatenate([np.zeros(0), *sample["codes"]]).astype(np.int64)
    if len(line):
        train(model, line, p)
    return model, counts


def fit(docs: DataFrame, params: Params = Params(), text: str = "text") -> tuple[Model, DataFrame]:
    """(model, counts): the network, and the corpus counts (word, n) it rests on."""
    model, counts = begin(docs, params, text)
    for _ in range(params.rounds):
        train_round(numbered(docs, model, text, []), model, params)
    return model, counts


def fit_and_score(docs: DataFrame, params: Params = Params(), text: str = "text", out: str = "lm",
                  keep: list[str] | None = None) -> DataFrame:
    """``score`` by the model of ``fit``, the texts numbered once for both."""
    model, _ = begin(docs, params, text)
    numbers = stored(numbered(docs, model, text, keep or docs.columns), "lm-numbers")
    for _ in range(params.rounds):
        train_round(numbers, model, params)
    return scored(numbers, model, params, out)


def log_probabilities(m: Model, codes: list[np.ndarray], side: int) -> np.ndarray:
    """Per text the summed log P of its tokens' classes, each from both sides."""
    line, places = joined(codes, side)
    each = np.empty(len(places))
    for a in range(0, len(places), BLOCK):
        at = places[a:a + BLOCK]
        order, parts = by_group(m, line, at)
        each[a + order] = predict(m, line, at[order], parts, side)[-1]
    sizes = np.array([len(c) for c in codes], dtype=np.int64)
    total, some = np.zeros(len(codes)), sizes > 0
    if some.any():
        total[some] = np.add.reduceat(each, (np.cumsum(sizes) - sizes)[some])
    return total


def classes_in(codes: bytes | None) -> np.ndarray:
    return np.frombuffer(codes or b"", dtype=np.int16)


def numbered(docs: DataFrame, model: Model, text: str, keep: list[str]) -> DataFrame:
    """(given, row, lm): the columns ``keep``, a number for the row, and of its text the classes
    of its tokens (null without text), the sum of their log P(word | class), the number of
    them, and the words that are to be joined with their counts."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model.shared())

    @F.pandas_udf("codes binary, own double, n_tokens long, words array<string>, times array<long>")
    def number(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = Model(**shared.value)
        level = {n: i for i, n in enumerate(set(m.known.values()), len(m.number) + 1)}   # a number for each count
        first = len(m.number) + len(level) + 1
        codes = Named({**m.number, **dict(zip(m.known, map(level.__getitem__, m.known.values())))}, first)
        of = np.array([0, *m.number.values(), *(m.bands[band(n)] for n in level),
                       *range(m.forms, m.forms + FORMS)], dtype=np.int16)
        own = -m.totals[of]                                              # log P(word | class), or what
        own[len(m.number) + 1:first] += np.log([*level])                 # the joined count adds to
        for texts in parts:
            classes, sums, n, words, times = [], [], [], [], []
            for t in texts:
                given = codes.of(t)
                at = np.where(given < first, given, first + (given - first) % GROUP)
                others = codes.others(given)
                classes.append(of[at].tobytes() if t else None)
                sums.append(own[at].sum())
                n.append(len(at))
                words.append([*others])
                times.append([*others.values()])
            yield pd.DataFrame({"codes": classes, "own": sums, "n_tokens": n, "words": words, "times": times})

    return docs.select(F.struct(*[col(c) for c in keep]).alias("given") if keep else F.lit(None).alias("given"),
                       F.monotonically_increasing_id().alias("row"), number(col(text)).alias("lm"))


def scored(numbers: DataFrame, model: Model, params: Params, out: str) -> DataFrame:
    """What ``numbers`` (stored, so that a row keeps its number) was given, with the struct ``out``."""
    small_batches(numbers.sparkSession)
    shared = numbers.sparkSession.sparkContext.broadcast(model.network())

    @F.pandas_udf("double")
    def judge(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = Model(**shared.value)
        for codes in parts:
            yield pd.Series(log_probabilities(m, [classes_in(c) for c in codes], params.side))

    judged = numbers.select("given", "row", "lm.n_tokens", (judge("lm.codes") + F.col("lm.own")).alias("classes"))
    rest = numbers.select("row", F.inline(F.arrays_zip("lm.words", "lm.times"))).toDF("row", "word", "times")
    more = (rest.join(model.counts, "word").groupBy("row").agg(F.sum(F.col("times") * F.log("n")).alias("more")))
    log_prob = F.col("classes") + F.coalesce("more", F.lit(0.0))
    found = free_name(numbers.select("given.*"), "lm_found")
    return (judged.join(more, "row", "left")
            .select("given.*", F.struct(log_prob.alias("log_prob"), "n_tokens", F.when(
                F.col("n_tokens") > 0, log_prob / F.col("n_tokens")).alias("mean_log_prob")).alias(found))
            .withColumn(out, F.col(found)).drop(found))


def score(docs: DataFrame, model: Model, params: Params = Params(), text: str = "text",
          out: str = "lm", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with a struct ``out``: log_prob, n_tokens,
    mean_log_prob."""
    return scored(stored(numbered(docs, model, text, keep or docs.columns), "lm-numbers"), model, params, out)
